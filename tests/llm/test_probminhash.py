import random

import numpy as np
import pytest

from tesserae.llm import probminhash as p
from tesserae.llm.shingles import shingles


def slow_similarity(a, b):
    x, y = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def test_similarity_and_estimate():
    r = np.random.default_rng(1)
    a = (np.unique(r.integers(0, 99, 60).astype(np.uint64)), None)
    b = (np.unique(r.integers(0, 99, 70).astype(np.uint64)), None)
    a, b = (a[0], 1 + r.random(len(a[0])) * 3), (b[0], 1 + r.random(len(b[0])) * 3)
    exact = p.similarity(a, b)[0]
    assert exact == pytest.approx(slow_similarity(a, b))
    marks, _ = p.signatures([a, b, a], 4000)
    assert (marks[0] == marks[2]).all()
    assert (marks[0] == marks[1]).mean() == pytest.approx(exact, abs=0.04)
    one = lambda x: (x[0], np.ones(len(x[0])))
    mixed = (a[0], np.where(np.arange(len(a[0])) % 3 > 0, 1.0, a[1]))  # some shingles have weight 1
    own, unit = p.signatures([mixed, b], 200)
    assert (unit == p.signatures([one(mixed), one(b)], 200)[0]).all() and (own[1] == p.signatures([b], 200)[0][0]).all() and (own[0] != unit[0]).any()
    assert p.similarity((a[0], np.ones(len(a[0]))), (b[0], np.ones(len(b[0]))))[0] == pytest.approx(p.similarity(a, b)[1])


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    docs = []
    for _ in range(30):
        base = [word() for _ in range(r.choice([3, 40, 120]))]
        docs.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 4])):
            near = list(base)
            for _ in range(r.choice([0, 1, 2])):
                near[r.randrange(len(near))] = word()
            docs.append(" ".join(near))
    docs += ["", None, "", "one", "one", "Two WORDS", "two, words!"]
    r.shuffle(docs)
    return list(enumerate(docs))


def brute(docs):
    from itertools import combinations

    root = {d: d for d, _ in docs}
    find = lambda x: x if root[x] == x else find(root[x])
    w = {d: p.weighted(t or "") for d, t in docs}
    for a, b in combinations(root, 2):
        if len(w[a][0]) and len(w[b][0]) and max(slow_similarity(w[a], w[b]), p.similarity(w[a], w[b])[1]) >= p.LEAST:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in root}


def test_classes_are_brute_forces(spark):
    docs = corpus(5)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, class_id string").repartition(3)
    assert {r.doc_id: r.class_id for r in p.classes(df).collect()} == brute(docs)
    kept = p.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(docs).values()))


def test_chain_of_copies_in_large_buckets(spark, monkeypatch):
    r = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(base)))
        for _ in range(3):
            base[r.randrange(len(base))] = f"x{r.randrange(10**6)}"
    monkeypatch.setattr(p, "FEW", 3)
    monkeypatch.setattr(p, "BLOCK", 16)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.class_id for x in p.classes(df).collect()} == brute(docs)


@pytest.mark.parametrize("divide", [8, 10_000])
def test_large_mixed_buckets_are_divided_once_more(spark, monkeypatch, divide):
    """Texts of one passage (not links) and of pairs (links), so that buckets hold many classes."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(24):
        own = [*passage, *(word() for _ in range(25))]
        docs += [" ".join(own), " ".join([*own[:-1], word()])]
    monkeypatch.setattr(p, "FEW", 4)
    monkeypatch.setattr(p, "DIVIDE", divide)
    monkeypatch.setattr(p, "BLOCK", 16)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert len(set(want.values())) > 20
    assert {x.doc_id: x.class_id for x in p.classes(df).collect()} == want


def test_repeated_lines_are_found_by_their_plain_likeness(spark):
    """Plain Jaccard 1, probability Jaccard about 0.55: found because such texts have bands without weights too."""
    r = random.Random(12)
    docs = []
    for i in range(60):
        line = [f"w{r.randrange(10**6)}" for _ in range(24)]
        whole = line + [f"w{r.randrange(10**6)}" for _ in range(80)]
        docs += [(2 * i, " ".join(whole)), (2 * i + 1, " ".join(line * 300 + whole))]
    low = [p.similarity(p.weighted(docs[2 * i][1]), p.weighted(docs[2 * i + 1][1])) for i in range(60)]
    assert max(x for x, _ in low) < 0.75 and min(y for _, y in low) >= 0.8
    got = {x.doc_id: x.class_id for x in p.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(60)) >= 54  # a recall of 0.9


def test_recall_near_the_threshold():
    """Pairs with a similarity of 0.8 to 0.85 meet in a band, in the bands and in the finer ones."""
    r = random.Random(13)
    met = finer = whole = 0
    while whole < 200:
        a = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 200))]
        b = [x if r.random() > 0.025 else "x" for x in a]
        near = max(p.similarity(p.weighted(" ".join(a)), p.weighted(" ".join(b))))
        if 0.8 <= near <= 0.85:
            whole += 1
            for count, at in ((p.BANDS, 0), (p.FINE, 1)):
                x, y = p._keys([" ".join(a), " ".join(b)], count)
                if set(x) & set(y):
                    met, finer = (met + 1, finer) if at == 0 else (met, finer + 1)
    assert met >= 198 and finer >= 199


def test_hot_copies_ids_of_text_and_repeated_ids(spark, monkeypatch):
    """Keys above LIGHT take the broadcast way; ids may be strings; one id may stand with several texts."""
    from tesserae.llm import common

    monkeypatch.setattr(common, "LIGHT", 5)
    monkeypatch.setattr(p, "LIGHT", 5)
    long, other = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(40))
    rows = [(f"k{i:03}", long if i % 2 else long.replace("w7 ", f"x{i} ")) for i in range(80)] + [("a", other), ("a", "quite another text of this id"), ("b", other), ("z", "single")]
    df = spark.createDataFrame([(*x, "1") for x in rows], "doc_id string, text string, copy string").repartition(5)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in p.classes(df).collect())
    assert got == sorted([(d, "k000", 80) for d, _ in rows[:80]] + [("a", "a", 3)] * 2 + [("b", "a", 3), ("z", "z", 1)])
    kept = [tuple(r) for r in p.keep_one(df).collect()]
    assert sorted(d for d, *_ in kept) == ["a", "a", "k000", "z"] and {("a", other, "1"), ("a", "quite another text of this id", "1")} < set(kept)  # two texts, no copies of each other


def test_a_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(100_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in p.classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, None), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.class_size) for r in p.classes(df).collect()))
    assert got == [(0, 0, 1), (0, 0, 1), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 1)]
    assert p.classes(df.limit(0)).count() == 0
    assert len(shingles("a b")) == 1 and len(shingles("")) == 0


def test_rows_are_the_members(spark):
    """Texts that share an id are judged each on its own; exact repeats, wordless texts and rows without an id as stated."""
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, long, "a"), (5, other, "a"), (5, other, "b"), (2, other, "z"), (7, long, "a"), (7, "!", "a"), (7, "!", "b"), (None, long, "c"), (3, None, "d"), (3, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy string")
    kept = sorted((r.doc_id or 0, r.text or "", r.copy) for r in p.keep_one(df).collect())
    assert kept == sorted([(0, long, "c"), (2, other, "z"), (5, long, "a"), (7, "!", "a"), (7, "!", "b"), (3, "", "d"), (3, "", "e")])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {r.node: r.root for r in p.components(links).collect()} == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
