import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from tesserae.llm import bpe, pii


def test_stages_in_turn(spark, tmp_path):
    english = "the house and the dog of this street were seen by all of them on that day in the old town near the river"
    rows = [(i, f"{english} number{'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]} " + " ".join(f"w{'abcdefghijklmnopqrst'[(i * j) % 20]}{'uvwxyz'[i % 6]}" for j in range(40)), "en", "s", 9) for i in range(40)]
    rows += [(50, "12 34 55", "en", "s", 1), (51, None, None, "s", 0), (52, rows[3][1], "en", "s", 3), (53, "mail me at some.body@mail.example.com or +1 (222) 555-4321 the dog", "en", "s", 4)]
    passage = "this secret benchmark passage has more than ten words so that it makes a few windows"
    rows += [(54, f"before it {passage}, after it", "en", "s", 5), (55, passage, "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {r[0] for r in rows} - seen["language_id"].keys() == {50, 51}
    assert 52 not in seen["near_dedup"] and {3, 53, 54, 55} < seen["near_dedup"].keys()
    assert 55 not in seen["decontaminate"] and seen["decontaminate"][54] == "before it , after it"
    assert seen["personal_data"][53] == "mail me at [EMAIL] or [PHONE] the dog"
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.RANKS), special_tokens={})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in out} == {d: (len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in seen["personal_data"].items()}
    assert all(not pii.base(t) for t in seen["personal_data"].values())
