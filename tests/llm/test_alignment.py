import hashlib
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, it's 1234 years old.", "", None, "a", " ", "  two  spaces ", "tabs\tand\r\nlines\n\n", "naïve Ünïcödé ÀÉ", "漢字かな交じり文", "😀👍🏽 emoji", "<|endoftext|> is text, </s> too", "<0x41> and <unk>", "a▁b is not given back",
    "x" * 300, "é" * 500, "\x00\x01 control", "zero​width   　", "for(i=0;i<10;i++){}", "The quick brown fox, it's 1234 years old.", "don't DON'T won't", "end with spaces   ",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES), {i: t for t, i in a.get_vocab().items()}, alignment.byte_alphabet()


def brute(text, libraries):
    """ids, byte ends of both, groups as text, links counted by comparing all token pairs."""
    a, b, names, alphabet = libraries
    text = text or ""
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(alphabet[c] for c in names[i]) for i in ids_a]
    raw_b = [bytes([int(p[3:5], 16)]) if (p := b.id_to_piece(i)).startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], [], "", Counter()
    spans = []
    for raw in (raw_a, raw_b):
        end, out = 0, []
        for t in raw:
            out.append((end, end := end + len(t)))
        spans.append(out)
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = [([], []) for _ in cuts]
    for side, ids in ((0, ids_a), (1, ids_b)):
        for i, (_, e) in zip(ids, spans[side], strict=True):
            groups[bisect_left(cuts, e)][side].append(str(i))
    links = Counter((i, j) for i, (s, e) in zip(ids_a, spans[0], strict=True) for j, (u, v) in zip(ids_b, spans[1], strict=True) if s < v and u < e)
    return ids_a, ids_b, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups), links


def test_query_against_brute_force(spark, libraries):
    docs = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row string").repartition(3)
    got = Counter(tuple(r) for r in alignment.digest(docs, BYTES, PIECES, public_tokenizers.PATTERN).collect())
    found = [brute(t, libraries) for t in TEXTS]
    held = Counter(p for *_, links in found for p in links)
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    want = Counter(
        (i // 2, len(a), len(b), groups.count(";") + bool(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, (a, b, groups, links) in enumerate(found)
    )
    assert got == want and sum(not g for *_, g, _ in found) == 3


def test_relational_form_gives_the_same_links(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 50)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "row long, text string")
    rows = {r.row: r for r in alignment.align(docs, BYTES, PIECES, public_tokenizers.PATTERN).collect()}
    a, b, names, alphabet = libraries
    size_b = {i: len(alignment.piece_bytes(b.id_to_piece(i))) for i in range(b.get_piece_size())}
    tokens = []
    for i, t in enumerate(TEXTS):
        ids_a, ids_b, *_ = brute(t, libraries)
        tokens.append((i, [(x, len(names[x])) for x in ids_a], [(x, size_b[x]) for x in ids_b]))
    links = alignment.relational(spark.createDataFrame(tokens, "row long, a array<struct<id:int,size:int>>, b array<struct<id:int,size:int>>"))
    got = {r.row: r for r in links.groupBy("row").agg(F.count("*").alias("n"), F.max("group").alias("last"), F.collect_list(F.struct("a", "b")).alias("pairs")).collect()}
    for i, r in rows.items():
        if r.n_a:
            assert (got[i].n, got[i].last + 1) == (r.n_links, r.n_groups)
            assert Counter(p.a << alignment.BITS | p.b for p in got[i].pairs) == {x.pair: x.times for x in r.links}
        else:
            assert i not in got


def test_groups_and_links_of_one_text(spark, libraries):
    row = alignment.align(spark.createDataFrame([(3, "it's an unbelievable café")], "doc_id long, text string"), BYTES, PIECES, public_tokenizers.PATTERN).first()
    ids_a, ids_b, groups, links = brute("it's an unbelievable café", libraries)
    assert row.groups == groups and (row.n_a, row.n_b) == (len(ids_a), len(ids_b))
    assert row.n_links == row.n_a + row.n_b - row.n_groups == sum(links.values())


def test_empty(spark):
    assert alignment.digest(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES, public_tokenizers.PATTERN).count() == 0
    rows = alignment.digest(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"), BYTES, PIECES, public_tokenizers.PATTERN).collect()
    assert [tuple(r) for r in rows] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2
