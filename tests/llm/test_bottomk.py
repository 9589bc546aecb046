import hashlib
import random
import re
import string

import numpy as np
import pytest
import xxhash

from tesserae.llm import bottomk as b
from tesserae.llm.shingles import shingles


def test_estimates():
    r = np.random.default_rng(1)
    pool = np.unique(r.integers(0, 2**64, 12_000, dtype=np.uint64))
    pool = r.permutation(pool)
    x, y, k = pool[:9000], pool[3000:], 1024
    j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    low = lambda v: np.sort(v)[:k]
    assert b.resemblance(low(x), low(y), k) == pytest.approx(j, abs=0.06)
    assert b.containment(low(x), low(y), k) == pytest.approx(len(np.intersect1d(x, y)) / len(x), abs=0.08)
    assert b.distinct(low(x), k) == pytest.approx(len(x), rel=0.1)
    assert (b.read(b.written(low(x))) == low(x)).all() and b.read("").size == 0
    assert (b.resemblance(x[:0], x[:0]), b.resemblance(x[:0], x[:3]), b.resemblance(x[:3], x[:3])) == (1.0, 0.0, 1.0)


def rows():
    r = random.Random(2)
    out = [(r.randrange(-500, 5000), " ".join(r.choices(["ab", "Ço", "d🙂", "e1", "ff"], k=r.choice([0, 1, 4, 60])))) for _ in range(150)]
    return [*out, (7, None), (7, ""), (7, "same text"), (7, "same text"), (9000, out[0][1])]


@pytest.mark.parametrize("size", [b.RANGE, 8_000, 300])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(b, "RANGE", size)
    data = rows() + [(None, "no id")]
    df = spark.createDataFrame([(*x, 1.0) for x in data], "doc_id long, text string, key double").repartition(4)
    got = [tuple("" if v is None else v for v in r[:7]) for r in b.digest(df).collect()]
    order = sorted(((d, t or "") for d, t in data), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    want = []
    for (d, t), (_, o) in zip(order, [*order[1:], order[0]], strict=True):
        new = t[: len(t) - len(t) // 2] + o[: len(t) // 2]
        f = [np.unique(shingles(x))[: b.K] for x in (t, new, o)]
        want.append(("" if d is None else d, len(t), hashlib.sha256(new.encode()).hexdigest(), b.written(f[0]), b.written(f[1]), b.resemblance(f[0], f[1]), b.resemblance(f[0], f[2])))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_merged_is_the_fingerprint_of_the_union(spark):
    data = [(i, i % 2, " ".join(f"w{j}" for j in range(i * 7, i * 7 + 40))) for i in range(10)]
    df = spark.createDataFrame(data, "doc_id long, part long, text string")
    got = {r.part: r.hashes for r in b.merged(b.sketch(df, keep=("part",)).select("kept.part", "hashes"), "part").collect()}
    for p in (0, 1):
        every = np.unique(np.concatenate([shingles(t) for _, q, t in data if q == p]))[: b.K]
        assert got[p] == every.view(np.int64).tolist()


def test_one_and_none(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    r = b.digest(one).first()
    assert (r.doc_id, r.n_chars, r.near_next) == (5, 15, 1.0)
    assert b.digest(one.limit(0)).count() == 0


def by_hand(text, width=5):
    """Shingle hashes from their definition: a polynomial of the words' hashes, then a bijective mix."""
    m, out = 2**64, []
    words = ["".join(c.lower() if c in string.ascii_letters else c for c in w) for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    h += [0] * (width - len(h)) if h else []
    for i in range(len(h) - width + 1):
        x = 0
        for v in h[i : i + width]:
            x = (x * 0x9E3779B97F4A7C15 + v) % m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ x >> 27) * 0x94D049BB133111EB % m
        out.append(x ^ x >> 31)
    return out


def test_shingles_by_hand():
    for text in ("", "?!", "One", "a b c d", "A b, c d e!", "the Öl of the Öl of the Öl of x1 y2", "x " * 40):
        assert shingles(text).tolist() == by_hand(text)
        assert b.bottom(text, 3).tolist() == sorted(set(by_hand(text)))[:3]
