"""Byte-level BPE: overlapping chunk encoding and byte decoding (operator 1).

Texts up to `chunk` characters are one piece. Longer ones are cut into chunks that
overlap their successor by `overlap` characters; chunks are pre-tokenised on
their own, wherever they lie. A pre-token depends only on where it starts and on the
characters to at most LOOK places behind its end, so two runs over one text agree for
good after any boundary they share. The first boundary that a chunk's sound tail
shares with its successor's head is the stitch; pieces between stitches are encoded
in parallel. Where an overlap holds no shared boundary (a pre-token longer
than the overlap), the document is put together again and pre-tokenised as one piece.

Null and empty texts give no ids and empty bytes. Rows are kept one for one, repeated
rows and repeated ids too; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IntTable, map_batches, stored, texts, worker_holds

#: Characters behind the end of a pre-token that can still decide it: contractions and trailing white space.
LOOK = 3
#: Pre-tokens remembered by one Python worker; characters that it pre-tokenises at a time.
REMEMBERED, PART = 120_000, 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token of any length: the pair of lowest rank merges first, leftmost among equals."""
    n, none = len(piece), -1
    parts: list = [piece[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), none], [none, *range(n - 1)]
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else none
        if j == none or parts[i] + parts[j] != pair:
            continue  # one of the two has merged since
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[j] != none:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if none not in (a, b) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p is not None]


class Merges:
    """Merges many short pre-tokens at once: a row each, one merge a row and round."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.none = ranks, len(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = {a << 20 | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.pairs = IntTable(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))

    def __call__(self, pieces: list[str]) -> list[list[int]]:
        found = [p.encode() for p in pieces]
        out: list = [None] * len(found)
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        while order and len(found[order[-1]]) > 64:
            i = order.pop()
            out[i] = merge(found[i], self.ranks)
        for c in range(0, len(order), 4096):
            part = order[c : c + 4096]
            for i, ids in zip(part, self._rows([found[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _rows(self, found: list[bytes]) -> list[list[int]]:
        width = len(found[-1])
        ids = self.byte[np.frombuffer(b"".join(f.ljust(width, b"\0") for f in found), np.uint8).reshape(-1, width)]
        size = np.array([len(f) for f in found])
        column = np.arange(width)
        rank = np.full(ids.shape, self.none)  # of the pair that begins in each place
        r, k = np.nonzero(column[None] < size[:, None] - 1)
        rank[r, k] = self.pairs.get(ids[r, k] << 20 | ids[r, k + 1], self.none)
        rows, done = np.arange(len(found)), [None] * len(found)
        while len(rows):
            at = rank.argmin(1)
            low = rank[np.arange(len(rows)), at]
            for i in np.flatnonzero(low == self.none).tolist():
                done[rows[i]] = ids[i, : size[i]].tolist()
            left = low < self.none
            rows, ids, rank, size, at, low = (x[left] for x in (rows, ids, rank, size, at, low))
            if not len(rows):
                break
            here = np.arange(len(rows))
            source = np.minimum(column[None] + (column[None] > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            size -= 1
            ids[here, at] = low
            rank[here, size - 1] = self.none
            i = np.flatnonzero(at > 0)
            rank[i, at[i] - 1] = self.pairs.get(ids[i, at[i] - 1] << 20 | low[i], self.none)
            i = np.flatnonzero(at < size - 1)
            rank[i, at[i]] = self.pairs.get(low[i] << 20 | ids[i, at[i] + 1], self.none)
        return done


class Tokens:
    """One worker's pattern, merges and memory of pre-tokens."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        self.find = regex.compile(pattern)
        self.merges = Merges(ranks)
        self.names = {v: k for k, v in ranks.items()}
        self.ids: dict[str, list[int]] = {}

    @classmethod
    def of(cls, pattern: str, ranks) -> Tokens:
        """ranks: a broadcast; a worker keeps what it made for the last one."""
        return worker_holds(f"bpe {pattern}", ranks.value, lambda: cls(pattern, ranks.value))

    def meet(self, pieces: list[list[str]]) -> None:
        """Sees to it that ids has all these pre-tokens."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        new = list(set().union(*pieces) - self.ids.keys())
        self.ids.update(zip(new, self.merges(new), strict=True))

    def of_pieces(self, pieces: list[list[str]]) -> Iterator[list[int]]:
        """The ids of each list of pre-tokens."""
        self.meet(pieces)
        return (list(chain.from_iterable(map(self.ids.__getitem__, p))) for p in pieces)

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text; about PART characters are pre-tokenised together."""
        part, size = [], 0
        for x in texts:
            part.append(self.find.findall(x))
            size += len(x)
            if size > PART:
                yield from self.of_pieces(part)
                part, size = [], 0
        yield from self.of_pieces(part)


def _lists(rows: Iterable[list[int] | None]) -> pa.ListArray:
    """An Arrow list array from lists made one at a time, of which only the packed integers are held."""
    packed = [None if row is None else np.array(row, np.int32) for row in rows]
    offsets = np.cumsum([0, *(0 if x is None else len(x) for x in packed)])
    values = np.concatenate([np.empty(0, np.int32), *(x for x in packed if x is not None)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array([x is None for x in packed]))


def _decoded(ids: pa.ListArray, names: dict[int, bytes]) -> pa.BinaryArray:
    return pa.array([b"".join(map(names.__getitem__, x.values.to_numpy().tolist() if x.is_valid else ())) for x in ids], pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 65_536, overlap: int = 1_024, back: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs (doc_id, text); back: and bytes, what decode makes of the ids."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    docs = texts(docs)

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = Tokens.of(pattern, ranks)
        ids = _lists(t.encode(x.as_py() for x in batch.column("text")))
        more = [_decoded(ids, t.names)] if back else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, *more], ["doc_id", "ids", "bytes"][: 2 + len(more)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, ids array<int>" + ", bytes binary" * back
    short = map_batches(docs.where(F.length("text") <= chunk), whole, out)

    def chunks(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(r, d, k, x[s : s + chunk + overlap], s + chunk + overlap >= len(x)) for r, d, x in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True) for k, s in enumerate(range(0, len(x) - overlap, chunk))]
        return pa.RecordBatch.from_arrays([pa.array(c) if i != 1 else pa.array(c, batch.schema.field("doc_id").type) for i, c in enumerate(zip(*rows, strict=True))], ["row", "doc_id", "k", "text", "last"])

    def bounds(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = Tokens.of(pattern, ranks)
        heads, tails, starts = [], [], []
        for x, last in zip(batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True):
            at = [m.start() for m in t.find.finditer(x)]
            starts.append(at)
            heads.append([p for p in at if p <= overlap])
            tails.append([] if last else [p - chunk for p in at if chunk <= p <= len(x) - LOOK])
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "k", "text", "last")), *(pa.array(c, ints) for c in (starts, heads, tails))], ["row", "doc_id", "k", "text", "last", "starts", "head", "tail"])

    # The chunk that reaches the end of its text is the last: a later one would lie within it.
    # Long texts are stored with their row numbers, which would not be the same if they were made again.
    long = stored(docs.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    parts = map_batches(long, chunks, f"row long, doc_id {kind}, k long, text string, last boolean")
    parts = map_batches(parts.repartition("row", "k"), bounds, f"row long, doc_id {kind}, k long, text string, last boolean, starts array<int>, head array<int>, tail array<int>")
    order, all_of = Window.partitionBy("row").orderBy("k"), Window.partitionBy("row")
    parts = (
        parts.withColumn("begin", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))))
        .withColumn("end", F.lead("begin").over(order) + chunk)
        .withColumn("apart", F.max(F.col("begin").isNull()).over(all_of))
        .drop("head", "tail")
    )

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = Tokens.of(pattern, ranks)
        ids, raw = [], []
        for x, last, starts, b, e, apart in zip(*(batch.column(c).to_pylist() for c in ("text", "last", "starts", "begin", "end", "apart")), strict=True):
            if apart:
                ids.append(None)
                raw.append(x if last else x[:chunk])
            else:
                e = len(x) if e is None else e
                at = [p for p in starts if b <= p < e]
                ids += t.of_pieces([[x[p:q] for p, q in zip(at, [*at[1:], e], strict=True)]])
                raw.append(None)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "k")), _lists(ids), pa.array(raw, pa.string())], ["row", "doc_id", "k", "ids", "raw"])

    done = map_batches(parts, pieces, f"row long, doc_id {kind}, k long, ids array<int>, raw string").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids", "raw"))).alias("parts"))
    stitched = done.where(F.col("parts")[0]["raw"].isNull()).select("doc_id", F.flatten("parts.ids").alias("ids"))
    stitched = decode(stitched, ranks_path) if back else stitched
    joined = map_batches(done.where(F.col("parts")[0]["raw"].isNotNull()).select("doc_id", F.array_join("parts.raw", "").alias("text")), whole, out)
    return short.unionByName(stitched).unionByName(joined)


def decode(ids: DataFrame, ranks_path: str) -> DataFrame:
    """Adds bytes (binary): the vocabulary's bytes of the column ids, in order; unknown ids raise KeyError."""
    names = ids.sparkSession.sparkContext.broadcast({v: k for k, v in load_ranks(ranks_path).items()})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column("ids"), names.value)], [*batch.schema.names, "bytes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema.fields)
    return map_batches(ids, run, f"{kinds}, bytes binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The contract of operator 1: ids and decoded bytes as digests."""
    return encode(docs, ranks_path, pattern, back=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
