"""Alignment of two tokenizers over the same bytes (operator 13).

A byte-level vocabulary (A) encodes a space and the text, a piece vocabulary (B) the text, before which it puts a
space itself. Token sizes in bytes add up to ends; an end that both have is a cut, and cuts part the tokens into
groups. A link is an occurrence of an A and a B token that share a byte. Between two neighbouring ends of either
kind lies one link, so there are as many links as different ends.

Ends, cuts and links of a text come from cumulative sums over the token sizes of many texts at once, inside the task
that encodes them. `relational` says the same with a full equi-join on text and end and windows; the tests hold both to
the same links. It makes several rows a token and can't meet the check tool's limits (README has the figures).
How many texts hold a linked pair, and the most frequent partners of an A id, are Spark aggregates over all
rows; frequent pairs, which may be in every text, are joined without a shuffle.

A text that is null, empty, or that one of the vocabularies doesn't give back byte for byte has no tokens. Rows are
kept one for one, repeated rows and ids too; a repeated row counts as a text of its own. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, slices, spread_join, stored, texts, worker_holds

#: Characters that are encoded together; ids of a vocabulary stay below 2 ** BITS.
PART, BITS = 2_000_000, 20
NOTHING = ""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_entries(vocabulary: bytes) -> dict[bytes, int]:
    """The ids of a byte-level vocabulary file by their bytes, special tokens left out; ids are in the order of merges."""
    held, alphabet = json.loads(vocabulary), byte_alphabet()
    special = {t["content"] for t in held["added_tokens"]}
    return {bytes(alphabet[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: <0xHH> is one byte, U+2581 a space."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """One worker's two vocabularies."""

    def __init__(self, byte_level: bytes, pieces: bytes, pattern: str):
        ranks = byte_entries(byte_level)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_b = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size_a[list(ranks.values())] = [len(t) for t in ranks]
        self.size_b = np.array([len(t) for t in self.bytes_b])
        self.ids = max(len(self.size_a), len(self.size_b))
        if self.ids >= 1 << BITS:
            raise ValueError("the vocabularies have too many ids")
        self.written = [f"{i}{sign}" for sign in ",|;" for i in range(self.ids)]

    @classmethod
    def of(cls, held) -> Pair:
        """held: a broadcast of the two files and the pattern."""
        return worker_holds("alignment", held.value, lambda: cls(*held.value))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both, or none where one of them loses bytes."""
        whole = f" {text}"
        a, b = self.a.encode_ordinary(whole), self.b.encode(text)
        raw = whole.encode()
        if not text or b"".join(map(self.bytes_b.__getitem__, b)) != raw or self.a.decode_bytes(a) != raw:
            return [], []
        return a, b


class Aligned:
    """Texts of one part: n_a, n_b, n_groups, n_links of each; group_a, group_b of the tokens; a link's text, a_at and b_at (places of its tokens)."""

    def __init__(self, pair: Pair, encoded: list[tuple[list[int], list[int]]]):
        self.pair, n = pair, len(encoded)
        self.n_a, self.n_b = (np.array([len(x[i]) for x in encoded], np.int64) for i in (0, 1))
        self.a, self.b = (np.fromiter(chain.from_iterable(x[i] for x in encoded), np.int64, k.sum()) for i, k in ((0, self.n_a), (1, self.n_b)))
        # Both cover a text's bytes, so ends over all texts of the part match, and a text's end is a cut.
        end_a, end_b = pair.size_a[self.a].cumsum(), pair.size_b[self.b].cumsum()
        kind = np.zeros(end_a[-1] + 1 if len(end_a) else 1, np.uint8)
        kind[end_a] |= 1
        kind[end_b] |= 2
        self.cut_a, self.cut_b = kind[end_a] == 3, kind[end_b] == 3
        self.group_a, self.group_b = self.cut_a.cumsum() - self.cut_a, self.cut_b.cumsum() - self.cut_b
        at = np.flatnonzero(kind)
        self.a_at, self.b_at = (((kind[at] & bit) > 0).cumsum() - ((kind[at] & bit) > 0) for bit in (1, 2))
        self.text_a = np.repeat(np.arange(n), self.n_a)
        self.link_text = self.text_a[self.a_at]
        self.n_links = np.bincount(self.link_text, minlength=n)
        self.n_groups = np.bincount(self.text_a[self.cut_a], minlength=n)

    def groups(self) -> Iterator[str]:
        """Of each text: ids of A, a bar, ids of B, groups parted by semicolons."""
        in_a, in_b = np.bincount(self.group_a), np.bincount(self.group_b)
        sign = np.empty(len(self.a) + len(self.b), np.int64)
        sign[np.arange(len(self.a)) + (in_b.cumsum() - in_b)[self.group_a]] = self.a + self.pair.ids * self.cut_a
        sign[np.arange(len(self.b)) + in_a.cumsum()[self.group_b]] = self.b + 2 * self.pair.ids * self.cut_b
        end = 0
        for k in (self.n_a + self.n_b).tolist():
            yield "".join(map(self.pair.written.__getitem__, sign[end : end + k].tolist()))[:-1]
            end += k

    def links(self) -> pa.ListArray:
        """Of each text: its different pairs (a << BITS | b), and how many links each has."""
        pairs = self.a[self.a_at] << BITS | self.b[self.b_at]
        order = np.lexsort((pairs, self.link_text))
        pairs, text = pairs[order], self.link_text[order]
        first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])][: len(pairs)])
        times = np.diff(np.r_[first, len(pairs)])
        offsets = np.searchsorted(text[first], np.arange(len(self.n_a) + 1))
        rows = pa.StructArray.from_arrays([pa.array(pairs[first]), pa.array(times.astype(np.int32))], ["pair", "times"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def align(docs: DataFrame, byte_level_path: str, pieces_path: str, pattern: str) -> DataFrame:
    """docs' ids (doc_id) and `row`, if there, with n_a, n_b, n_groups, n_links, groups (text), links (array of pair, times) of each row."""
    files = []
    for path in (byte_level_path, pieces_path):
        with open(path, "rb") as f:
            files.append(f.read())
    held = docs.sparkSession.sparkContext.broadcast((*files, pattern))
    carried = [c for c in ("row", "doc_id") if c in docs.columns]
    docs = docs.select(*carried, F.coalesce("text", F.lit(NOTHING)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(held)
        for batch in slices(batches):
            begin, size, encoded = 0, 0, []
            for i, x in enumerate(batch.column("text")):
                text = x.as_py()
                encoded.append(pair.encode(text))
                size += len(text)
                if size > PART or i == batch.num_rows - 1:
                    found = Aligned(pair, encoded)
                    counts = [pa.array(c.astype(np.int64)) for c in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                    ids = [batch.column(c).slice(begin, len(encoded)) for c in carried]
                    yield pa.RecordBatch.from_arrays([*ids, *counts, pa.array(list(found.groups()), pa.large_string()), found.links()], [*carried, "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
                    begin, size, encoded = i + 1, 0, []

    return docs.mapInArrow(run, f"{fields(docs, *carried)}n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair:bigint,times:int>>")


def relational(tokens: DataFrame) -> DataFrame:
    """Links (row, end, a, b, group) of tokens (row, a, b: arrays of struct<id, size>): ends by windowed sums, a full equi-join on row and end, running cut counts as groups.

    A link ends where one of its tokens does; from the last end back, its tokens are the last ones met.
    """

    def ends(side: str) -> DataFrame:
        rows = tokens.select("row", F.posexplode(side).alias("pos", "token"))
        return rows.select("row", F.sum("token.size").over(Window.partitionBy("row").orderBy("pos")).alias("end"), F.col("token.id").alias(side))

    back = Window.partitionBy("row").orderBy(F.desc("end"))
    before = Window.partitionBy("row").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("long")
    both = ends("a").join(ends("b"), ["row", "end"], "full").withColumn("cut", cut)
    return both.select("row", "end", F.last("a", True).over(back).alias("a"), F.last("b", True).over(back).alias("b"), F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("group"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (rows of links that have it), best (no pair of the same A id has more) of links (row, pair), one row a row and pair."""
    counts = links.groupBy("pair").agg(F.count("*").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", BITS)))  # at most as many rows as B has ids
    return counts.select("pair", "count", (F.col("count") == top).cast("long").alias("best"))


def digest(docs: DataFrame, byte_level_path: str, pieces_path: str, pattern: str) -> DataFrame:
    """The contract of operator 13."""
    rows = align(texts(docs).withColumn("row", F.monotonically_increasing_id()), byte_level_path, pieces_path, pattern)
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stored(rows.withColumn("groups", sha).withColumnRenamed("groups", "groups_sha256"), "aligned")
    links = rows.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.times")
    met = spread_join(links, pair_counts(links), "pair", "count")
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
