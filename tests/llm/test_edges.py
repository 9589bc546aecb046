"""All queries of the subpackage and the pipeline over empty tables, null ids, texts and labels, repeated rows and ids, very long texts, and extra columns whose names clash."""

import weakref

import pytest

import corpus_pipeline
from tesserae.llm import common
from tesserae.llm.queries import QUERIES

SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
NULLS = {
    "documents": [(None,) * 5, (None, "some words here now then", None, None, None), (1,) + (None,) * 4, (1,) + (None,) * 4, *[(2, "the cat sat on the mat today", None, None, 3)] * 2, (3, "", "en", "s", 0)],
    "labels": [(None,) * 3, (2, None, 1), (2, 1, 0)],
    "benchmark": [(None, None), (1, None), (2, "")],
}
PASSAGE = "a passage of the benchmark that is more than ten words long in all"
LONG = {
    "documents": [
        (1, "xé" * 60_000, "en", "s", 1), (2, " ".join(f"w{i % 3000}" for i in range(60_000)) + " " + PASSAGE, "en", "s", 1), (3, "0" * 5_000 + ".1.1.1 and " + "9" * 100_000, "de", "s", 1),
        (4, "a1@b.cd " * 20_000, "de", "t", 1), (5, "a!" * 100_000, "de", "t", 1), (6, "漢字" * 40_000, "de", "t", 1), (7, "one text of this id", "en", "t", 1), (7, "and another one of it", "en", "t", 1),
        (8, "0" + "𠀀" * 1_000_000, "de", "t", 1), (9, "key1" + "Zqthe" * 200_000 + " end", "en", "t", 1),
    ],
    "labels": [(1, 1, 0), (2, 1, 1), (4, 0, 1), (6, 0, 0)],
    "benchmark": [(1, PASSAGE), (2, "z" * 100_000)],
}
#: Extra columns with the names that the operators use inside.
CLASH = "*, 1 AS kept, 'x' AS row, 0.5D AS score, 2 AS node, 'y' AS key, 3 AS n, array(1) AS bands, 'z' AS word, true AS learn, 'v' AS spans, 7 AS fold, 'q' AS digest"


@pytest.fixture(scope="module", params=["empty", "nulls", "long"])
def tables(request, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    rows = {"empty": {}, "nulls": NULLS, "long": LONG}[request.param]
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        (df.selectExpr(*CLASH.split(", ")) if request.param != "empty" else df).write.parquet(f"{d}/{name}.parquet")
    return request.param, str(d)


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_edges(spark, tables, name):
    kind, d = tables
    rows = (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, d).collect()
    if kind != "long":
        want = {"op4_secrets": 0, "op11_variants": 0, "pipeline": 2}.get(name, 7) if kind == "nulls" else 0
        assert len(rows) == want
    elif name == "pipeline":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, 9} and len(rows) == 10
    elif name == "op11_variants":
        assert {r.word: r.n for r in rows} == {}
    elif name == "op4_secrets":
        assert 9 in {r.doc_id for r in rows}
    else:
        by = {r.doc_id: r for r in rows}
        assert len(rows) == 10 and len(by) == 9
        if name == "op2_pii":
            assert by[3].n_ip == 1 and by[4].n_email == 20_000
        if name == "op8_fm_index":
            assert by[2].contaminated and not by[1].contaminated
        if name == "op10_langid":
            assert all(r.lang_pred in ("en", "de") for r in rows)


def test_a_worker_holds_one_operators_state():
    class Large:
        pass

    source = Large()
    first = common.worker_holds("first", source, Large)
    assert common.worker_holds("first", source, Large) is first
    seen = weakref.ref(first)
    del first
    common.worker_holds("second", source, Large)
    assert seen() is None  # freed once the second operator asked


def test_tables_that_were_stored_are_freed(spark):
    begun = common.written()
    df = common.stored(spark.range(1000), "numbers")
    path = common._written[-1]
    assert df.count() == 1000 and common.written() == begun + 1
    common.free(spark, begun)
    assert spark.read.parquet(path).count() == 0 and common.written() == begun


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())


def test_a_frequent_key_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 10)
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [("none", -1)]
    left = spark.createDataFrame(rows, "key string, i long")
    right = left.where("i >= 0").groupBy("key").count().withColumnRenamed("count", "n")
    out = common.spread_join(left, right, "key", "n")
    assert sorted((r.key, r.i, r.n) for r in out.collect()) == sorted((k, i, 200 if k == "hot" else 1) for k, i in rows[:-1])
    assert "Union" in out._jdf.queryExecution().toString()


def test_most_frequent_is_exact(spark):
    rows = [(f"w{i:03}", 1 + (i % 7 == 0) * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "word string, n long").repartition(5)
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    for k in (0, 1, 9, 30, 200, 500):
        assert sorted(tuple(r) for r in common.most_frequent(df, k).collect()) == sorted(order[:k])
        few = [tuple(r) for r in common.frequent(df, k).collect()]
        assert len(few) <= k and (not few or min(n for _, n in few) >= max([n for w, n in rows if (w, n) not in set(few)], default=0))
