import random

import numpy as np

from tesserae.llm import fm_index


def brute(docs, items, width):
    out = []
    for d, text in docs:
        w = fm_index.words((text or "").encode())
        hit, found = set(), set()
        for item, t in items:
            b = fm_index.words((t or "").encode())
            for g in {tuple(b[i : i + width]) for i in range(max(1, len(b) - width + 1))} if b else ():
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        found.add(item)
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out)


def cases(seed):
    r = random.Random(seed)
    vocabulary = ["the", "Of", "ab1", "çà", "x\xa0y", "q", "zz"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 6, 12])))) for i in range(8)] + [(90, None), (91, "?!"), (92, "unknown words that stand nowhere else"), (93, "the Of ab1 the Of ab1 the Of ab1")]
    docs = [(i, "-".join(r.choices([*vocabulary, "other"], k=r.choice([0, 2, 30, 80])))) for i in range(40)] + [(7, "THE of AB1 " * 30), (7, "THE of AB1 " * 30), (55, None), (56, "")]
    return docs, items


def test_index_is_exact():
    r = np.random.default_rng(3)
    text = np.concatenate([[0], r.integers(0, 4, 3000), [0]])
    index = fm_index.FMIndex(text, 3)
    rows = np.array([(0, 0, 1), (0, 2, 3), (1, 1, 2), (3, 3, 3)])
    for row, low, high in zip(rows, *index.search(rows), strict=True):
        p = row[row > 0]
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low, high))) == want


def test_against_brute_force(spark):
    for seed, block in ((1, fm_index.BLOCK), (2, 60)):
        docs, items = cases(seed)
        if block == 60:
            items = [x for x in items if x[1] and len(x[1].split()) != 1]
        df = spark.createDataFrame([(*x, [1]) for x in docs], "doc_id long, text string, items array<int>").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        found = fm_index.find(df, bench, 4, block)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()) == brute(docs, items, 4)


def test_long_texts_are_cut_into_shards_that_overlap(monkeypatch):
    docs, items = cases(5)
    look = fm_index.Windows([t or "" for _, t in items], 4)
    for size in (7, 50, 500_000):
        monkeypatch.setattr(fm_index, "SHARD", size)
        sizes, hits = fm_index._hits([(t or "").encode() for _, t in docs], look, 4)
        got = [(d, n, *((sum(e - b for b, e in hits[i][0]), sorted({items[k][0] for k in hits[i][1]})) if i in hits else (0, []))) for i, ((d, _), n) in enumerate(zip(docs, sizes, strict=True))]
        assert sorted(got) == brute(docs, items, 4)


def test_ids_of_other_kinds(spark):
    from decimal import Decimal

    bench = spark.createDataFrame([(Decimal("1.50"), "one two three"), (None, "two three")], "item_id decimal(9,2), text string")
    docs = spark.createDataFrame([("a", "One two, three."), ("b", "x")], "doc_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in fm_index.find(docs, bench).collect()}
    assert got == {"a": (3, [Decimal("1.50")]), "b": (0, [])}
    assert {r.doc_id: r.n_hit for r in fm_index.find(docs, bench, block=8).collect()} == {"a": 3, "b": 0}


def test_remove_and_empty(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Say ONE, two three: four! end"), (2, "one two three four"), (3, None), (4, "clean 🙂 text")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in fm_index.remove(fm_index.find(docs, bench)).collect()}
    assert left == {1: "Say ! end", 3: "", 4: "clean 🙂 text"}
    assert fm_index.find(docs.limit(0), bench).count() == 0
    assert fm_index.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert fm_index.digest(docs, bench).count() == 4
