"""Token counts that follow edits (operator 3).

A document's state is its text and two segment trees over the same slots, in heaps: characters and tokens of each leaf, where
tree[1] is the whole count and tree[i] = tree[2i] + tree[2i + 1]. A slot holds at most 2 * LEAF pre-tokens or is spare (0 characters); at
first every second one is spare. An edit goes down the tree of characters to the leaf LOOK characters
before it and re-encodes from there until a pre-token begins where an old leaf began, behind the edit:
from there both texts have the same pre-tokens. The new pre-tokens are dealt to the slots in between, and the sums above these are
renewed: a number that grows with the logarithm of the leaves. Only where more pre-tokens come than these slots may hold is the tree laid out anew.

Null and empty texts have no leaves and count 0. Edits of one document follow each other, each in the
positions of the text as it then stands, positions beyond its end meaning the end. Rows are kept one for one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LOOK, PART, Tokens, load_ranks
from .common import fields, map_batches, texts

LEAF, TOGETHER = 32, 2_000


def _leaves(pieces: list[str], tokens: Tokens, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf of `size` pre-tokens."""
    if not pieces:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(0, len(pieces), size)
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = np.fromiter(map(len, map(tokens.ids.__getitem__, pieces)), np.int64, len(pieces))
    return np.add.reduceat(chars, at), np.add.reduceat(counts, at)


def grown(leaves: np.ndarray) -> np.ndarray:
    """The segment tree over the leaves with a spare slot behind each, in a heap whose second half they fill."""
    half = 1 << max(0, 2 * len(leaves) - 1).bit_length()
    tree = np.zeros(2 * half, np.int64)
    tree[half : half + 2 * len(leaves) : 2] = leaves
    for i in reversed(range(half.bit_length() - 1)):
        tree[1 << i : 2 << i] = tree[2 << i : 4 << i].reshape(-1, 2).sum(1)
    return tree


def slot_at(chars: np.ndarray, at: int) -> tuple[int, int]:
    """The slot that holds the character at `at` (the last one beyond the end), and where it begins."""
    i, begin, at = 1, 0, min(at, int(chars[1]) - 1)
    while 2 * i < len(chars):
        left = int(chars[2 * i])
        i, begin = (2 * i, begin) if at < begin + left else (2 * i + 1, begin + left)
    return i - len(chars) // 2, begin


def reach(text: str, chars: np.ndarray, start: int, stop: int, new: str, tokens: Tokens) -> tuple[str, int, int, list[str]]:
    """The text after [start, stop) has become new, and the pre-tokens that replace those of the slots [i, j)."""
    start = min(start, len(text))
    stop = min(max(start, stop), len(text))
    moved, half = len(new) - (stop - start), len(chars) // 2
    after = text[:start] + new + text[stop:]
    i, begin = slot_at(chars, max(0, start - LOOK)) if text else (0, 0)
    pieces, j, k, at = [], half, i, begin
    for m in tokens.find.finditer(after, begin):
        was = m.start() - moved
        if m.start() >= start + len(new) and was >= stop:
            while k < half and (at < was or not chars[half + k]):  # spare slots go with the leaf before them
                at += int(chars[half + k])
                k += 1
            if at == was and k > i and k < half:
                j = k
                break
        pieces.append(m[0])
    return after, i, j, pieces


def renew(chars: np.ndarray, tree: np.ndarray, i: int, j: int, pieces: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, int]:
    """The state once the slots [i, j) hold these pre-tokens, and how many sums were renewed; changes the arrays in place where it can."""
    half = len(tree) // 2
    if len(pieces) > 2 * LEAF * (j - i):
        both = [np.concatenate([x[half : half + i], y, x[half + j :]]) for x, y in zip((chars, tree), _leaves(pieces, tokens), strict=True)]
        kept = both[0] > 0
        chars, tree = (grown(x[kept]) for x in both)
        return chars, tree, len(tree)
    chars[half + i : half + j] = tree[half + i : half + j] = 0
    if pieces:
        many = min(j - i, -(-len(pieces) // LEAF))
        c, n = _leaves(pieces, tokens, -(-len(pieces) // many))
        at = half + i + np.arange(len(c)) * ((j - i) // many)
        chars[at], tree[at] = c, n
    low, high, sums = (half + i) // 2, (half + j - 1) // 2, 0
    while low:
        for x in (chars, tree):
            x[low : high + 1] = x[2 * low : 2 * high + 2].reshape(-1, 2).sum(1)
        sums += high - low + 1
        low, high = low // 2, high // 2
    return chars, tree, sums


def edit(text: str, chars: np.ndarray, tree: np.ndarray, start: int, stop: int, new: str, tokens: Tokens) -> tuple[str, np.ndarray, np.ndarray, int, int]:
    """Text and state after one edit, how many characters were encoded again and how many sums were renewed."""
    after, i, j, pieces = reach(text, chars, start, stop, new, tokens)
    tokens.meet([pieces])
    chars, tree, sums = renew(chars.copy(), tree.copy(), i, j, pieces, tokens)
    return after, chars, tree, sum(map(len, pieces)), sums


def build(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple = ()) -> DataFrame:
    """doc_id, text, chars, tree of each row of docs (doc_id, text), and kept."""
    docs = texts(docs, keep)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = Tokens.of(pattern, ranks)
        chars, trees, part, size = [], [], [], 0

        def flush() -> None:
            tokens.meet(part)
            for pieces in part:
                c, n = _leaves(pieces, tokens)
                chars.append(grown(c))
                trees.append(grown(n))
            part.clear()

        for text in batch.column("text"):
            part.append(tokens.find.findall(x := text.as_py()))
            size += len(x)
            if size > PART:
                flush()
                size = 0
        flush()
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(chars, longs), pa.array(trees, longs)], [*batch.schema.names, "chars", "tree"])

    return map_batches(docs, run, f"{fields(docs, *docs.columns)}chars array<bigint>, tree array<bigint>")


def apply(state: DataFrame, edits: Column, ranks_path: str, pattern: str) -> DataFrame:
    """The state after edits (an array of start, stop, text for each row), with n_again: characters encoded again, and n_sums: sums renewed."""
    ranks = state.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    state = state.withColumn("edits", edits)
    carried = [c for c in state.columns if c not in ("text", "chars", "tree", "edits", "n_again", "n_sums")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = Tokens.of(pattern, ranks)
        rows = [[text.as_py(), chars.values.to_numpy().copy(), tree.values.to_numpy().copy(), 0, 0] for text, chars, tree in zip(*(batch.column(c) for c in ("text", "chars", "tree")), strict=True)]
        todo = [x or () for x in batch.column("edits").to_pylist()]
        for k in range(max(map(len, todo))):  # the k-th edit of all rows together: what they need is encoded at once
            for c in range(0, len(rows), TOGETHER):
                part = [(row, reach(row[0], row[1], e[k]["start"], e[k]["stop"], e[k]["text"] or "", tokens)) for row, e in zip(rows[c : c + TOGETHER], todo[c : c + TOGETHER], strict=True) if k < len(e)]
                tokens.meet([found[3] for _, found in part])
                for row, (after, i, j, pieces) in part:
                    row[0], (row[1], row[2], sums) = after, renew(row[1], row[2], i, j, pieces, tokens)
                    row[3] += sum(map(len, pieces))
                    row[4] += sums
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*carried, "text", "chars", "tree", "n_again", "n_sums"])

    return map_batches(state, run, f"{fields(state, *carried)}text string, chars array<bigint>, tree array<bigint>, n_again long, n_sums long")


def sample_edits() -> Column:
    """Two edits of each text: its first 12 characters instead of 10 from a third on, and a word and the id's last digits inserted at two thirds."""
    n = F.length("text")
    one = F.struct((n / 3).cast("long").alias("start"), ((n / 3).cast("long") + 10).alias("stop"), F.substring("text", 1, 12).alias("text"))
    two = F.struct((n * 2 / 3).cast("long").alias("start"), (n * 2 / 3).cast("long").alias("stop"), F.concat(F.lit(" edited "), F.coalesce(F.col("doc_id") % 1000, F.lit(0)).cast("string")).alias("text"))
    return F.array(one, two)


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts before and after the sample edits, and how much was encoded again."""
    state = build(docs, ranks_path, pattern).withColumn("n_tokens", F.col("tree")[1])
    after = apply(state, sample_edits(), ranks_path, pattern)
    return after.select("doc_id", "n_tokens", F.col("tree")[1].alias("edited_n_tokens"), F.length("text").cast("long").alias("edited_n_chars"), F.sha2("text", 256).alias("edited_sha256"), "n_again", "n_sums")
