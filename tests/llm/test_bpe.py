import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tesserae.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, "a", "don't  stop\n\n\n now 12345 <|endoftext|> äöü ñ 漢字🙂  ", "x" * 700, "  \n \t" * 90, "we'll've'd " * 60, "word one two\r\n" * 70, "é" * 301 + " " * 200 + "7" * 333]


OWN = bpe.Tokens(public_tokenizers.PATTERN, RANKS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80)))
def test_ids_are_the_librarys(xs):
    assert list(OWN.encode(xs)) == [LIBRARY.encode_ordinary(x) for x in xs]


@settings(max_examples=50, deadline=None)
@given(st.text("abdeghilnorst", min_size=1, max_size=150))
def test_both_merges(x):
    assert bpe.merge(x.encode(), RANKS) == OWN.merges([x])[0] == LIBRARY.encode_ordinary(x)


@pytest.mark.parametrize(("chunk", "overlap"), [(10_000, 100), (64, 16), (17, 5), (200, 40)])
def test_chunks_stitch(spark, chunk, overlap):
    docs = spark.createDataFrame([(i % 7, x, "l", "s") for i, x in enumerate(TEXTS + TEXTS)], "doc_id long, text string, ids string, row string").repartition(3)
    rows = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN, chunk, overlap), PATH).collect()
    want = sorted((i % 7, LIBRARY.encode_ordinary(x or ""), (x or "").encode()) for i, x in enumerate(TEXTS + TEXTS))
    assert sorted((r.doc_id, r.ids, bytes(r.bytes)) for r in rows) == want


def test_digest(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in bpe.digest(docs, PATH, public_tokenizers.PATTERN).collect():
        x = TEXTS[r.doc_id] or ""
        ids = LIBRARY.encode_ordinary(x)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    assert bpe.digest(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
