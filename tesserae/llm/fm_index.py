"""Benchmark decontamination by an FM-index per shard of documents (operator 8).

A shard is what one task gathers from its own partition, up to SHARD symbols; nothing is
shuffled. A longer document is cut into shards that overlap by one word less than a window. A shard's text is the documents' words as symbols of the benchmark's vocabulary. Words
outside that vocabulary can't be part of a window, nor can runs of known words shorter than
the shortest window: both become separators. The index is a suffix array, the Burrows-Wheeler
transform in a wavelet matrix, and suffix positions sampled every SAMPLE symbols of
a run. All windows of a block of items are searched backward at once, occurrences are located
by walking to a sampled position, and their spans are merged per document.

A benchmark of at most BLOCK bytes is one block, broadcast as it is. A larger one is dealt to blocks by a hash; each takes a pass over
the documents, which are stored with a row number first, and only one block at a time is with the driver.

Null and empty texts have no words and are never hit. Rows are kept one for one, also where ids repeat; items
without words have no window; equal windows of several items count for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, slices, stored, texts, words, worker_holds

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SHARD = 500_000
SAMPLE = 8
#: Bytes of benchmark texts whose windows are searched in one pass.
BLOCK = 4_000_000
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


class Windows:
    """A block of items as rows of symbols, right-aligned, with the items (by their place in the block) that hold each."""

    def __init__(self, found: list[str], width: int):
        self.symbol: dict[bytes, int] = {}
        rows, owner = [np.zeros((0, width), np.int64)], [np.zeros(0, np.int64)]
        for i, text in enumerate(found):
            x = np.array([self.symbol.setdefault(w, len(self.symbol) + 1) for w in words(text.encode())], np.int64)
            if len(x):
                x = np.concatenate([np.zeros(max(0, width - len(x)), np.int64), x])
                rows.append(np.unique(np.lib.stride_tricks.sliding_window_view(x, width), axis=0))
                owner.append(np.full(len(rows[-1]), i))
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.sizes = (self.rows > 0).sum(1)
        self.least = int(self.sizes.min()) if len(self.rows) else 0
        order = np.argsort(which.reshape(-1), kind="stable")
        self.owner = np.concatenate(owner)[order]  # of all windows, those of one row together
        self.first = np.concatenate([[0], np.cumsum(np.bincount(which.reshape(-1), minlength=len(self.rows)))])

    def items(self, windows: np.ndarray) -> set[int]:
        return set().union(*(self.owner[self.first[w] : self.first[w + 1]].tolist() for w in windows.tolist()))


class FMIndex:
    """Counts and locates words over symbols 1, 2, ...; 0 separates runs and begins the text."""

    def __init__(self, text: np.ndarray, symbols: int):
        n, self.levels = len(text), max(1, int(symbols).bit_length())
        gaps = text == 0
        # Every separator is smaller than all symbols and unlike any other, so a comparison ends with its run.
        rank = np.where(gaps, np.cumsum(gaps) - 1, text + gaps.sum())
        step = 1
        while True:
            after = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])
            key = rank * (int(rank.max()) + 2 + n) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.n = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.bwt = text[order - 1]
        begins = np.maximum.accumulate(np.where(gaps, np.arange(n) + 1, 0))
        kept = gaps | ((np.arange(n) - begins) % SAMPLE == 0)
        self.sampled = kept[order]
        self.position = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.zeros, self.ones = [], []
        level = self.bwt
        for b in reversed(range(self.levels)):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands in the transform before place at."""
        low, high = np.zeros_like(at), at
        for b, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            bit = ((symbol >> b) & 1).astype(bool)
            one, two = ones[low], ones[high]
            low, high = np.where(bit, zeros + one, low - one), np.where(bit, zeros + two, high - two)
        return high - low

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each row of symbols (right-aligned, 0 for none)."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        alive = np.arange(len(rows))
        for column in reversed(range(rows.shape[1])):
            alive = alive[(rows[alive, column] > 0) & (low[alive] < high[alive])]
            if not len(alive):
                break
            c = rows[alive, column]
            low[alive] = self.first[c] + self.rank(c, low[alive])
            high[alive] = self.first[c] + self.rank(c, high[alive])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: steps back to the nearest sampled one."""
        steps, out, todo = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.copy()
        while len(todo):
            ready = self.sampled[at[todo]]
            done = todo[ready]
            out[done] = self.position[self.sample_rank[at[done]]] + steps[done]
            todo = todo[~ready]
            c = self.bwt[at[todo]]
            at[todo] = self.first[c] + self.rank(c, at[todo])
            steps[todo] += 1
        return out


def _merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Unions of overlapping or touching [begin, end)."""
    out: list[list[int]] = []
    for b, e in sorted(zip(begin.tolist(), end.tolist(), strict=True)):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def _scan(shard: list[tuple[int, int, np.ndarray]], look: Windows) -> list[tuple[int, np.ndarray, np.ndarray, set[int]]]:
    """(row, begins and ends of word spans, items) of the rows of a shard that have any; shard: row, place of the first symbol in it, symbols."""
    pieces, runs = [np.zeros(1, np.int64)], []
    place = 1
    for d, first, symbols in shard:
        edge = np.diff(np.concatenate([[0], (symbols > 0).view(np.int8), [0]]))
        for b, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e - b >= look.least:
                runs.append((place, d, first + b))
                pieces += [symbols[b:e], np.zeros(1, np.int64)]
                place += e - b + 1
    if not runs:
        return []
    index = FMIndex(np.concatenate(pieces), len(look.symbol))
    low, high = index.search(look.rows)
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    if not len(found):
        return []
    window = np.repeat(found, times)
    at = index.locate(np.repeat(low[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    starts, owner, offset = (np.array(x, np.int64) for x in zip(*runs, strict=True))
    run = np.searchsorted(starts, at, "right") - 1
    d, begin = owner[run], offset[run] + at - starts[run]
    end, order = begin + look.sizes[window], np.argsort(d, kind="stable")
    cuts = np.flatnonzero(np.diff(d[order])) + 1
    return [(int(d[g[0]]), begin[g], end[g], look.items(np.unique(window[g]))) for g in np.split(order, cuts)]


def _hits(found: list[bytes], look: Windows, width: int) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[int]]]]:
    """The number of words of each text, and for those that are hit the word spans, merged, and the items."""
    sizes, shard, held, parts = [], [], 0, []
    get = look.symbol.get
    for d, text in enumerate(found):
        own = words(text)
        sizes.append(len(own))
        symbols = np.fromiter((get(w, 0) for w in own), np.int64, len(own))
        for first in range(0, len(symbols), SHARD):
            shard.append((d, first, symbols[first : first + SHARD + width - 1]))
            held += len(shard[-1][2]) + 100
            if held >= SHARD:
                parts += _scan(shard, look) if len(look.rows) else []
                shard, held = [], 0
    parts += _scan(shard, look) if shard and len(look.rows) else []
    by: dict[int, list] = {}
    for d, *rest in parts:
        by.setdefault(d, []).append(rest)
    return sizes, {d: (_merged(np.concatenate([x[0] for x in p]), np.concatenate([x[1] for x in p])), set().union(*(x[2] for x in p))) for d, p in by.items()}


def _in_text(text: str, at: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word spans as spans of code points."""
    where = [m.span() for m in WORD.finditer(text)]
    return [{"begin": where[b][0], "end": where[e - 1][1]} for b, e in at]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about as many characters as make a shard."""
    held: list[pa.RecordBatch] = []
    for batch in slices(batches):
        held.append(batch)
        if sum(x.column("text").nbytes for x in held) >= 5 * SHARD:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, n_words, n_hit, spans (words hit, [begin, end) in code points, merged) and items of each row of docs, and the columns to keep as the struct kept.

    benchmark: item_id, text; block: bytes of its texts that are searched in one pass.
    """
    spark = docs.sparkSession
    docs = texts(docs, keep)
    carried = docs.columns
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    item_kind, id_type = items.schema["item_id"].dataType.simpleString(), items.select("item_id").limit(0).toArrow().schema.field(0).type
    out = f"{fields(docs, *carried)}n_words long, n_hit long, spans array<struct<begin:long,end:long>>, items array<{item_kind}>"
    blocks = -(-items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block)
    if blocks <= 1:
        held = spark.sparkContext.broadcast(items.orderBy("item_id").toArrow().to_pylist())

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = worker_holds("windows", held.value, lambda: Windows([x["text"] for x in held.value], width))
            for batch in _together(batches):
                sizes, hits = _hits([x.as_buffer().to_pybytes() for x in batch.column("text")], look, width)
                spans = [_in_text(batch.column("text")[i].as_py(), hits[i][0]) if i in hits else [] for i in range(batch.num_rows)]
                hit = [sum(e - b for b, e in hits[i][0]) if i in hits else 0 for i in range(batch.num_rows)]
                ids = [sorted({held.value[k]["item_id"] for k in hits[i][1]} - {None}) if i in hits else [] for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, SPANS), pa.array(ids, pa.list_(id_type))], [*carried, "n_words", "n_hit", "spans", "items"])

        return docs.mapInArrow(whole, out)

    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    dealt = stored(items.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks))), "items")
    found = None
    for k in range(blocks):
        part = spark.sparkContext.broadcast(dealt.where(F.col("block") == k).orderBy("item_id").toArrow().to_pylist())

        def scan(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            look = worker_holds("windows", part.value, lambda: Windows([x["text"] for x in part.value], width))
            for batch in _together(batches):
                _, hits = _hits([x.as_buffer().to_pybytes() for x in batch.column("text")], look, width)
                row = batch.column("row").to_pylist()
                columns = [pa.array([row[i] for i in hits], pa.int64()), pa.array([[{"begin": b, "end": e} for b, e in at] for at, _ in hits.values()], SPANS), pa.array([sorted({part.value[j]["item_id"] for j in x} - {None}) for _, x in hits.values()], pa.list_(id_type))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "at", "items"])

        hit = stored(rows.select("row", "text").mapInArrow(scan, f"row long, at array<struct<begin:long,end:long>>, items array<{item_kind}>"), "hits")
        part.unpersist()
        found = hit if found is None else found.unionByName(hit)
    found = found.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.join(found, "row", "left")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, hit, spans = [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                at = _merged(np.array([x["begin"] for x in at]), np.array([x["end"] for x in at])) if at else []
                sizes.append(len(words(text.encode())))
                spans.append(_in_text(text, at) if at else [])
                hit.append(sum(e - b for b, e in at))
            ids = [x or [] for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, SPANS), pa.array(ids, pa.list_(id_type))], [*carried, "n_words", "n_hit", "spans", "items"])

    return joined.mapInArrow(placed, out)


def remove(found: DataFrame) -> DataFrame:
    """The columns doc_id, text and kept without the spans in text; a hit text of which no word is left is dropped."""
    left = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, (s["begin"] - a["at"]).cast("int"))).alias("out"), s["end"].alias("at")),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, F.length("text"))),
    )
    return found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))).select("doc_id", *[c for c in found.columns if c == "kept"], F.when(F.size("spans") == 0, F.col("text")).otherwise(left).alias("text"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract of operator 8."""
    found = find(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
