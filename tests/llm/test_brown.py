import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import brown


def likelihood(pairs, of):
    n = np.zeros((of.max() + 1,) * 2)
    np.add.at(n, (of[:, None], of[None]), pairs)
    f = lambda x: sum(v * math.log(v) for v in x if v > 0)
    return f(n.ravel()) - f(n.sum(0)) - f(n.sum(1))


def test_exchange_never_lowers_and_ends_at_a_local_best():
    r = np.random.default_rng(1)
    pairs = r.poisson(2, (14, 14)).astype(float)
    pairs[:5, 5:9] += 20
    of = brown.exchange(pairs, 12, 3, 50)
    best = likelihood(pairs, of)
    assert best >= likelihood(pairs, np.concatenate([np.arange(12) % 3, [3, 4]])) and of[12:].tolist() == [3, 4]
    for w in range(12):
        for c in range(3):
            other = of.copy()
            other[w] = c
            assert likelihood(pairs, other) <= best + 1e-6


def docs(n=60):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["The", "cat", "saw", "a", "dog", "é", f"rare{i % 9}", f"new{i}"], k=r.choice([0, 3, 30])))) for i in range(n)]
    return [*rows, (3, "The cat"), (3, "The cat"), (200, None), (201, "a\x0bb\xa0c\x85d")]


def small(monkeypatch, head):
    for name, value in (("HEAD", head), ("EACH", 2), ("CLASSES", 2), ("HELD", 50)):
        monkeypatch.setattr(brown, name, value)


def classes_of(model, others):
    """(count, class) of every word."""
    out = {w: (int(model.counts[i]), int(model.of[i])) for w, i in model.ids.items()}
    return out | {r.word.encode(): (r.n, r["class"]) for r in others.collect()}


@pytest.mark.parametrize("head", [0, 6, 1000])
def test_against_brute_force(spark, monkeypatch, head):
    small(monkeypatch, head)
    rows = docs()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    training = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for t in training for w in [*brown.tokens(t or ""), None])
    total, distinct = sum(counts.values()), len(counts)
    model, others = brown.train(spark.createDataFrame([(0, t) for t in training], "doc_id long, text string"))
    of = classes_of(model, others)
    assert {w: n for w, (n, _) in of.items()} == {w: n for w, n in counts.items() if w}
    # The words that were not exchanged are where their neighbours make them most likely.
    first, end = list(model.ids)[: model.clustered], model.classes + 1
    assert sorted(counts[w] for w in first) == sorted((n for w, n in counts.items() if w), reverse=True)[: model.clustered][::-1]
    near = lambda w: end if w is None else of[w][1] if w in first else model.classes
    sums: dict = {}
    for t in training:
        whole = [None, *brown.tokens(t or ""), None]
        for a, w, b in zip(whole, whole[1:], whole[2:]):
            if w not in first:
                sums[w] = sums.get(w, 0) + model.weights[near(b)] + model.weights[end + 1 + near(a)]
    for w, x in sums.items():
        assert x[of[w][1]] == pytest.approx(x.max(), abs=1e-5)
    # Class bigrams and emissions from these classes.
    size = model.classes + 1
    n = np.zeros((size, size))
    for t in training:
        c = [model.classes, *(of[w][1] for w in brown.tokens(t or "")), model.classes]
        np.add.at(n, (c[:-1], c[1:]), 1)
    share = (n.sum(0) + 1) / (n.sum() + size)
    step = (n + brown.SMOOTH * share) / (n.sum(1, keepdims=True) + brown.SMOOTH)
    assert step.sum(1) == pytest.approx(1)
    mass, types = np.zeros(size), np.zeros(size)
    for k, c in of.values():
        mass[c] += k
        types[c] += 1
    rare = int(types.argmax())
    types[rare] += 1
    want = []
    for d, t in rows:
        found = brown.tokens(t or "")
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in [*found, None])
        before, score = model.classes, 0.0
        for w in [*found, None]:
            k, c = (0, model.classes) if w is None else of.get(w, (0, rare))
            score += math.log10(step[before, c] * (1.0 if w is None else (k + 1) / (mass[c] + types[c])))
            before = c
        want.append((d, zlib.crc32(str(d).encode()) % 7 == 2, len(found) + 1, sum(counts[w] > 0 for w in [*found, None]), total, round(base, 6), round(score, 6)))
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in brown.digest(df).collect()]
    assert sorted(got) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert brown.digest(df).count() == 0
    rows = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, learn boolean")
    assert [(r.base_score, r.n_known, r.n_tokens, r.train_tokens) for r in brown.score(rows, "learn").collect()] == [(0.0, 0, 3, 0)]


def test_words_as_frequent_as_all_others(spark, monkeypatch):
    small(monkeypatch, 2)
    df = spark.createDataFrame([(i, "a b c d e f", True) for i in range(5)], "doc_id long, text string, learn boolean")
    model, _ = brown.train(df)
    assert list(model.ids) == [b"a", b"b", b"c", b"d"]  # the store holds none, those to be exchanged are the first by word
    for r in brown.score(df, "learn").collect():
        assert (r.n_tokens, r.n_known) == (7, 7) and r.base_score == pytest.approx(7 * math.log10(6 / 43)) and math.isfinite(r.score)


def test_rare_words_get_their_neighbours_classes(spark, monkeypatch):
    """Names and verbs, frequent and rare, alternate: each kind is in classes of its own."""
    small(monkeypatch, 60)
    monkeypatch.setattr(brown, "EACH", 4)
    r = random.Random(3)
    pick = lambda k: k + str(r.choice([r.randrange(4), r.randrange(4), r.randrange(20), r.randrange(200)]))
    rows = [(i, " ".join(pick("nv"[j % 2]) for j in range(20)), True) for i in range(300)] + [(1001, "n1 v199", False), (1002, "n1 n199", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    model, others = brown.train(docs.where("learn"))
    kinds: dict = {}
    for word, (_, c) in classes_of(model, others).items():
        kinds.setdefault(c, Counter())[word[:1]] += 1
    assert others.count() > 100 and all(max(k.values()) / k.total() > 0.95 for k in kinds.values())
    bad, good = (x.score for x in sorted(brown.score(docs, "learn").where("doc_id > 1000").collect(), key=lambda x: -x.doc_id))
    assert math.isfinite(good) and good > bad + 0.5


def test_a_long_text(spark, monkeypatch):
    small(monkeypatch, 6)
    text = " ".join(f"w{i % 5000}" for i in range(100_000))
    df = spark.createDataFrame([(1, text, True), (2, "x" * 1_000_000, True), (3, "w1", False)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in brown.score(df, "learn").collect()}
    assert got == {1: (100_001, 100_001), 2: (2, 2), 3: (2, 2)}
