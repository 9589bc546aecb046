"""Spelling variants: words one edit apart, by merging light subtrees of a trie (operator 11).

The corpus's words make a trie. At each node the child with the most words is heavy (of equals the first), the others
and a word that ends there are light. A pair of words that differ by one inserted, deleted or replaced character parts at one
node, and at most one of the two goes on by the heavy child. So the light words are merged into that node's errata trie: with
their next character skipped, with the heavy character in its place, and with the heavy character put before it. Coinciding terminals
are the pairs. Each word is light at no more than log2 of the number of words nodes (small-to-large), so that
many terminals are made of it at most, whatever its length or its number of neighbours.

Words are dealt in ranges by their first KEY characters, sorted, and a task builds the trie of one range. Nodes that several ranges
share are prefixes of range limits, at most KEY a limit: their children are counted over all ranges, and their heavy
characters sent to the tasks. Terminals of nodes within a range are known to coincide there and else left out; the terminals that
are left meet by an equi-join. Words that share KEY characters are in one task.

Null texts have no words. The id of a row without one counts as empty text. Rows are counted as they come, repeated ones too. Of equally
frequent near words the first in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, stored

SHORTEST, LEAST, RATIO, EDITED = 7, 2, 10, 31
#: Characters of words that a range is meant to hold; first characters of a word that decide its range.
RANGE, KEY = 2_000_000, 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")
SKIPPED = -1


def runs(doc_id, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text and how often it has them: runs of letters, A-Z lower-cased, some of them with a character left out."""
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().translate(LOWER).decode())).items():
        h = zlib.crc32(run.encode(), begin)
        if h % EDITED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        yield run, n


def words(docs: DataFrame) -> DataFrame:
    """word, n of all texts, those that occur LEAST times or more."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        total: Counter = Counter()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for run, n in runs(doc_id, text.as_py()):
                total[run] += n
        if total:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    counts = map_batches(docs.where("text IS NOT NULL").select("doc_id", "text"), count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def common(a: str, b: str, at: int = 0) -> int:
    """How many first characters two texts share, at least `at`."""
    step = 1
    while step:
        if a[at : at + step] == b[at : at + step] and at + step <= min(len(a), len(b)):
            at += step
            step *= 2
        else:
            step //= 2
    return at


class Trie:
    """The words of one range, sorted, and the heavy characters of nodes that ranges share."""

    def __init__(self, words: list[str], shared: dict[str, str]):
        self.words, self.known, self.shared = words, set(words), shared

    def children(self, lo: int, hi: int, d: int) -> tuple[bool, list[tuple[str, int, int]]]:
        """Of the node at depth d over words lo to hi: whether a word ends there, and the range of each child."""
        ends = len(self.words[lo]) == d
        at, out = lo + ends, []
        while at < hi:
            c = self.words[at][d]
            end = bisect_left(self.words, self.words[at][:d] + chr(ord(c) + 1), at, hi)
            out.append((c, at, end))
            at = end
        return ends, out

    def node(self, lo: int, d: int, ends: bool, children: list[tuple[str, int, int]], heavy: str, whole: bool) -> Iterator[tuple[str, int, str]]:
        """The terminals (text, depth or SKIPPED, word) that merging one node's light words makes; whole: all words of the node are here."""
        v = self.words[lo][:d]
        here = (lambda t: t in self.known) if whole else (lambda t: True)
        if ends and here(v + heavy):
            yield v + heavy, SKIPPED, v
        replaced = defaultdict(list)
        for c, i, j in children:
            if c == heavy:
                continue
            for w in self.words[i:j]:
                rest = w[d + 1 :]
                replaced[rest].append(w)
                if not rest.startswith(c) and here(v + rest):  # else the two part at a later node
                    yield v + rest, SKIPPED, w
                if here(v + heavy + c + rest):
                    yield v + heavy + c + rest, SKIPPED, w
        for rest, light in replaced.items():
            if len(light) > 1 or here(v + heavy + rest):
                for w in light:
                    yield v + heavy + rest, d, w

    def terminals(self) -> Iterator[tuple[str, int, str]]:
        ends = {w[:d] for w in (self.words[0], self.words[-1]) for d in range(min(len(w), KEY) + 1)}
        for v in ends & self.shared.keys():
            lo, hi = bisect_left(self.words, v), bisect_left(self.words, v + "￿")
            yield from self.node(lo, len(v), *self.children(lo, hi, len(v)), self.shared[v], False)
        left = [(0, len(self.words), 0)]
        while left:
            lo, hi, d = left.pop()
            if hi - lo > 1:
                d = common(self.words[lo], self.words[hi - 1], d)
                ended, children = self.children(lo, hi, d)
                if self.words[lo][:d] not in self.shared:
                    heavy = max(children, key=lambda x: x[2] - x[1])[0]
                    yield from self.node(lo, d, ended, children, heavy, True)
                left += [(i, j, d + 1) for _, i, j in children]


def heavy_characters(ranges: DataFrame) -> dict[str, str]:
    """The heavy character of each node that ranges (word, part) share: a row a range and at most KEY nodes a limit reach the driver."""
    limits = ranges.groupBy("part").agg(F.min(F.substring("word", 1, KEY)).alias("low"), F.max(F.substring("word", 1, KEY)).alias("high")).collect()
    limits.sort(key=lambda r: r.low)
    shared = {b.low[:d] for a, b in zip(limits, limits[1:], strict=False) for d in range(common(a.high, b.low) + 1)}
    if not shared:
        return {}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes: Counter = Counter()
        for w in batch.column("word").to_pylist():
            for d, c in enumerate(w):
                if w[:d] not in shared:
                    break
                sizes[w[:d], c] += 1
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in sizes], pa.string()) for i in (0, 1)] + [pa.array(sizes.values(), pa.int64())], ["node", "c", "n"])

    sizes = map_batches(ranges.select("word"), count, "node string, c string, n long").groupBy("node", "c").agg(F.sum("n").alias("n"))
    return {r.node: r.c for r in sizes.groupBy("node").agg(F.min_by("c", F.struct(-F.col("n"), "c")).alias("c")).collect()}


def errata(counts: DataFrame) -> DataFrame:
    """terminal, depth, word, n: what merging the light subtrees of the trie of counts (word, n) makes."""
    n = 1 + counts.agg(F.coalesce(F.sum(F.length("word").cast("long")), F.lit(0))).first()[0] // RANGE
    ranges = stored(counts.repartitionByRange(n, F.substring("word", 1, KEY)).withColumn("part", F.spark_partition_id()), "ranges")
    held = counts.sparkSession.sparkContext.broadcast(heavy_characters(ranges))
    names = ["terminal", "depth", "word", "n"]

    def merge(table: pa.Table) -> pa.Table:
        n = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
        rows = list(Trie(sorted(n), held.value).terminals())
        columns = [[r[i] for r in rows] for i in range(3)] + [[n[r[2]] for r in rows]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names)

    return ranges.groupBy("part").applyInArrow(merge, "terminal string, depth int, word string, n long")


def nearest(counts: DataFrame) -> DataFrame:
    """word, n_near, best (struct of less, the negative count, and word: of the most frequent near word) of each of counts (word, n) that has a near word."""
    terminals = stored(errata(counts), "errata")
    known = counts.select(F.col("word").alias("terminal"), F.struct((-F.col("n")).alias("less"), "word").alias("met"))
    mine = F.struct((-F.col("n")).alias("less"), "word")
    skipped = terminals.where(F.col("depth") == SKIPPED).select("terminal", mine.alias("own")).join(known, "terminal")
    one = F.lit(1).cast("long")
    pairs = skipped.select(F.explode(F.array(F.struct(F.col("own.word").alias("word"), one.alias("near"), F.col("met").alias("best")), F.struct(F.col("met.word").alias("word"), one.alias("near"), F.col("own").alias("best")))).alias("x")).select("x.*")
    # Light words of a node with the same rest, at most one a character, and the heavy one, if it is a word.
    alike = terminals.where(F.col("depth") != SKIPPED).groupBy("terminal", "depth").agg(F.collect_list(mine).alias("light")).join(known, "terminal", "left")
    alike = alike.select(F.array_sort(F.when(F.col("met").isNull(), F.col("light")).otherwise(F.array_append("light", F.col("met")))).alias("all")).where(F.size("all") > 1)
    each = alike.select("all", F.posexplode("all").alias("at", "x"))
    replaced = each.select("x.word", (F.size("all") - 1).cast("long").alias("near"), F.when(F.col("at") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    return pairs.unionByName(replaced).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): each round doubles the forms that are followed; as counts grow tenfold a step, the rounds are few."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = cut(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        if state.where("went").isEmpty():
            return state.select("word", "root")
        state = state.drop("went")


def digest(docs: DataFrame) -> DataFrame:
    """The contract of operator 11."""
    counts = stored(words(docs), "words")
    near = counts.join(nearest(counts), "word", "left")
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    found = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "near")
    roots = rooted(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
