import time
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest

from tesserae.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("side", [langid.SIDE, 3])
def test_forward_and_expected_are_sums_over_all_segmentations(monkeypatch, side):
    monkeypatch.setattr(langid, "SIDE", side)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    v = langid.Vocabulary(pieces)
    r = np.random.default_rng(1)
    p = r.random((v.size, 2))
    p /= p.sum(0)
    words = ["ab", "abab", "b", "axb", "bababab" * 3, "x"]

    def all_of(w, g):
        @cache
        def rest(i):
            if i == len(w):
                return [(1.0, ())]
            out = []
            for k, x in enumerate(pieces):
                if w.startswith(x, i):
                    out += [(p[k, g] * q, (k, *s)) for q, s in rest(i + len(x))]
            if w[i] not in pieces:
                out += [(p[-1, g] * q, (len(pieces), *s)) for q, s in rest(i + 1)]
            return out

        return rest(0)

    got = langid.forward(v, words, p)
    counts = np.arange(1.0, 7.0)
    for g in (0, 1):
        want = np.zeros(v.size)
        for i, w in enumerate(words):
            ways = all_of("▁" + w, g)
            z = sum(q for q, _ in ways)
            assert got[i, g] == pytest.approx(np.log(z))
            for q, s in ways:
                for k in s:
                    want[k] += counts[i] * q / z
        assert langid.expected(v, words, counts, p[:, g]) == pytest.approx(want)


def test_long_words_do_not_vanish():
    v = langid.Vocabulary(langid.load_pieces(PATH))
    p = np.full((v.size, 1), 1 / v.size)
    x = langid.forward(v, ["zñ漢" * 21, "q" * 64, "a"], p)
    assert np.isfinite(x).all() and x[0] < x[2]
    one = np.full((v.size, 1), 1e-200)  # far beyond the range of doubles, and no logarithm is lost
    assert np.isfinite(langid.forward(v, ["the" * 50], one)).all()
    assert np.isfinite(langid.expected(v, ["the" * 50, "q"], np.array([2.0, 3.0]), one[:, 0])).all()


def test_a_word_of_a_million_characters():
    v = langid.Vocabulary(langid.load_pieces(PATH))
    p = np.full((v.size, 1), 1 / v.size)
    began = time.process_time()
    x = langid.forward(v, ["ab" * 500_000, "abcd" * 12, "漢字仮名" * 50_000], p)
    assert np.isfinite(x).all() and time.process_time() - began < 90
    parts = v.arcs(["漢字仮名" * 500])
    assert len(parts.first) > 1_000  # places that no piece crosses cut it
    half = langid.forward(v, ["ab" * 250_000], p)
    assert x[0, 0] == pytest.approx(2 * half[0, 0], rel=1e-4)


def test_predict(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog of this house", "en"), ("der hund und die katze von dem haus", "de"), ("el perro y la casa de los gatos", "es")] * 12)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, "12 34 --", "de", "s"), (103, "the house of the dog", None, "s"), (104, "x" * 5000, None, "s"), (104, "die katze", None, "s")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double").repartition(4)
    got = [tuple(r) for r in langid.digest(docs, PATH).collect()]
    assert len(got) == len(rows)
    for d, _, pred, score in got:
        if d < 36:
            assert pred == rows[d][2] and 0 < score <= 1
    assert {(d, q) for d, _, q, _ in got if 100 <= d < 104} == {(100, "und"), (101, "und"), (102, "und"), (103, "en")}
    assert langid.digest(docs.limit(0), PATH).count() == 0
    assert {r.lang_pred for r in langid.digest(docs.drop("lang").selectExpr("*", "cast(null as string) lang"), PATH).collect()} == {"und"}


def by_definition(rows):
    """(lang_pred, score) of each row: expectation maximisation and scores place by place, word by word."""
    pieces = {x: k for k, x in enumerate(langid.load_pieces(PATH))}
    size, longest = len(pieces) + 1, max(map(len, pieces))

    def arcs(w):
        out = [(i, j, pieces[w[i:j]]) for i in range(len(w)) for j in range(i + 1, min(len(w), i + longest) + 1) if w[i:j] in pieces]
        return out + [(i, i + 1, size - 1) for i in range(len(w)) if w[i] not in pieces]

    def before(w, p):
        a = [1.0] + [0.0] * len(w)
        for i, j, k in sorted(arcs(w)):
            a[j] += a[i] * p[k]
        return a

    learned = [(t, lang) for d, t, lang in rows if d is not None and t is not None and lang is not None and zlib.crc32(str(d).encode()) % 5]
    langs = sorted({lang for _, lang in learned})
    counts = {g: Counter(w for t, lang in learned if lang == g for w in t.split()) for g in langs}
    p = {g: np.full(size, 1 / size) for g in langs}
    for _ in range(langid.ROUNDS):
        for g in langs:
            sums = np.zeros(size)
            for word, n in counts[g].items():
                w = "▁" + word
                a, z = before(w, p[g]), [0.0] * len(w) + [1.0]
                for i, j, k in sorted(arcs(w), reverse=True):
                    z[i] += p[g][k] * z[j]
                for i, j, k in arcs(w):
                    sums[k] += n * a[i] * p[g][k] * z[j] / a[-1]
            p[g] = (sums + langid.ADDED) / (sums.sum() + langid.ADDED * size)
    out = []
    for _, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        x = np.array([np.log(sum(lang == g for _, lang in learned) / len(learned)) + sum(np.log(before("▁" + w, p[g])[-1]) for w in t.split()) for g in langs])
        q = np.exp(x - x.max())
        out.append((langs[int(x.argmax())], q.max() / q.sum()))
    return out


def test_query_by_definition(spark):
    stems = {"en": "the house of this dog was near", "de": "der hund war nah bei dem haus über", "fr": "la maison du chien était près élève", "xx": "日本 語 zz qu漢"}
    r = np.random.default_rng(8)
    rows = []
    for i in range(120):
        lang = list(stems)[i % 4]
        mixed = stems[lang].split() + stems[list(stems)[(i + 1) % 4]].split()[: i % 3]
        rows.append((i, " ".join(r.choice(mixed, r.integers(1, 6))), lang if i % 11 else None))
    rows += [(None, "the house", "en"), (500, None, "de"), (501, "", "de"), (502, "12 !", "fr"), (503, "zzz unseen wörds", None), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = [(x.lang_pred, x.score) for x in langid.digest(docs, PATH).collect()]
    want = by_definition(rows)
    assert [g for g, _ in got] == [g for g, _ in want] and len({g for g, _ in want}) == 5
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-7)
