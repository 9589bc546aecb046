"""Near copies by ProbMinHash over weighted shingles, banding and verification (operator 7).

Every distinct shingle of five words runs a Poisson process whose rate is its weight
(1 + ln of its count in the text); each arrival falls on one of M registers, and the first
to reach a register marks it. A shingle stops once its arrival comes later than all
registers' firsts. Two texts agree on a register with probability equal to the probability
Jaccard similarity of their weights. BANDS bands of ROWS registers find candidates: a pair
at 0.8 meets in a band with probability 1 - (1 - 0.8^5)^20 = 0.9996. Candidates are verified
on their whole texts; a link is a probability Jaccard or a plain Jaccard similarity of
shingles of at least 0.8. For the plain one, a text with repeated shingles has the bands of its shingles
without weights too; a text without repeats has the same bands with and without. So either kind of link is found with that probability.

Exact copies become one text before banding. In a bucket, members are first compared with its
lead, the text that meets most others over all bands: in a group of copies, what they were
made from. Where a bucket then still holds several classes, its members of different classes are
compared: all pairs of them in buckets of up to FEW texts; in larger ones in blocks of two parts of BLOCK texts
each, which emit only links that join classes. A bucket of more than DIVIDE texts is first divided once more by FINE
finer bands of FINE_ROWS registers, in which a pair at 0.8 meets again with probability 1 - (1 - 0.8^4)^25 = 0.999998.
The work in a bucket of texts that agree on their registers, but aren't linked with their lead, grows with its square, and the
texts sent to blocks with the square of its members over BLOCK. Classes are the connected components of the links.

One row per row of docs: doc_id, class_id (the smallest id in its class), class_size (its rows). Texts
without words are never copies: each is a class of its own. A null id is a class of its own
with a null class_id. Rows with words that share an id share a class, whatever their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LIGHT, cut, map_batches, spread_join, stored, texts
from .shingles import mix, shingles

M, BANDS, LEAST = 100, 20, 0.8
ROWS = M // BANDS
FINE, FINE_ROWS = 25, 4
#: Members of a bucket up to which its pairs of different classes are listed, and beyond which it is divided once more; members of a part.
FEW, DIVIDE, BLOCK = 32, 8_192, 2_048
#: Shared shingles that are compared at a time.
COLUMNS = 2_048
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights."""
    found, counts = np.unique(shingles(text), return_counts=True)
    return found, 1 + np.log(counts)


def _arrive(text: np.ndarray, shingle: np.ndarray, rate: np.ndarray, first: np.ndarray, mark: np.ndarray) -> None:
    """Lets the shingles of texts (rows of first and mark) arrive at their registers; first and mark are changed in place.

    All texts of a batch run together: each round draws the next arrival of every shingle that is
    still early enough for its text.
    """
    n, m = first.shape
    flat_first, flat_mark = first.reshape(-1), mark.reshape(-1)
    time, last, draw = np.zeros(len(text)), first.max(1), 0
    while len(text):
        draw += 1
        r = mix(shingle + np.array([draw], _U) * _GOLD)
        time = time - np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        early = time < last[text]
        text, shingle, rate, time, r = text[early], shingle[early], rate[early], time[early], r[early]
        place = text * m + (mix(r ^ _GOLD) % _U(m)).astype(np.int64)
        better = np.flatnonzero(time < flat_first[place])
        better = better[np.argsort(-time[better], kind="stable")]  # the earliest is written last
        flat_first[place[better]], flat_mark[place[better]] = time[better], shingle[better]
        last = first.max(1)


def signatures(weights: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> tuple[np.ndarray, np.ndarray]:
    """The marks of each text's registers, a row a text, and those that its shingles without weights make; texts need at least one shingle.

    Shingles of weight 1 arrive alike in both, so they are drawn once, and the others then join them with their weights or without.
    """
    n, sizes = len(weights), np.array([len(s) for s, _ in weights])
    text = np.repeat(np.arange(n), sizes)
    shingle, rate = (np.concatenate(x) for x in zip(*weights, strict=True))
    first, mark = np.full((n, m), np.inf), np.zeros((n, m), _U)
    alone = sizes == 1  # its only shingle marks every register
    mark[alone] = shingle[alone[text]][:, None]
    plain, heavy = ~alone[text] & (rate == 1), ~alone[text] & (rate != 1)
    _arrive(text[plain], shingle[plain], rate[plain], first, mark)
    other, unit = first.copy(), mark.copy()
    _arrive(text[heavy], shingle[heavy], rate[heavy], first, mark)
    _arrive(text[heavy], shingle[heavy], np.ones(int(heavy.sum())), other, unit)
    return mark, unit


def bands(marks: np.ndarray, count: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band of registers."""
    parts = marks.reshape(len(marks), count, -1)
    key = np.arange(count, dtype=_U) + np.zeros((len(marks), 1), _U)
    for i in range(parts.shape[2]):
        key = mix(key * _GOLD + parts[:, :, i])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard of the weights, and Jaccard of the shingles."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    x, y = a[1][i], b[1][j]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    low = a[1].sum() - x.sum() + np.cumsum(x)
    high = b[1].sum() - np.cumsum(y)
    return float((1 / (low / x + high / y)).sum()), len(both) / (len(a[0]) + len(b[0]) - len(both))


def _keys(found: list[str], count: int) -> list[list[int]]:
    """The keys of `count` bands of each text, and those of its shingles without weights where they differ; none for texts without words."""
    keys: list[list[int]] = [[] for _ in found]
    part: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
    held = 0

    def flush() -> None:
        if part:
            marks, unit = signatures([w for _, w in part])
            other = (marks != unit).any(1)
            for (i, _), own, plain, differs in zip(part, bands(marks, count).tolist(), bands(unit, count).tolist(), other.tolist(), strict=True):
                keys[i] = sorted({*own, *plain}) if differs else own
            part.clear()

    for i, text in enumerate(found):
        w = weighted(text)
        if len(w[0]):
            part.append((i, w))
            held += len(w[0])
        if held > 500_000:
            flush()
            held = 0
    flush()
    return keys


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = batch.column("text").to_pylist()
    copy = [hashlib.sha256(x.encode()).digest()[:16] for x in found]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(copy, pa.binary()), pa.array(_keys(found, BANDS), pa.list_(pa.int64()))], ["doc_id", "copy", "bands"])


def _finer(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(_keys(batch.column("text").to_pylist(), FINE), pa.list_(pa.int64()))], ["node", "fine"])


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    same, last, kept = [], None, None
    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
        if x != last:
            last, kept = x, weighted(x)
        same.append(max(similarity(kept, weighted(y))) >= LEAST)
    return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same)], ["a", "b", "same"])


def _block(rows: pa.Table) -> pa.Table:
    """Links between the classes of two parts of a bucket (or within one part); of those that join the same classes, one.

    Shared shingles of all pairs are counted by products of matrices whose columns are the block's shared shingles.
    """
    doc, root, part, i, j = (rows.column(c).to_numpy() for c in ("node", "root", "part", "i", "j"))
    held = [weighted(x) for x in rows.column("text").to_pylist()]
    shingle, owner = np.concatenate([s for s, _ in held]), np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
    weight = np.concatenate([w for _, w in held])
    shared, column, times = np.unique(shingle, return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    x, y = np.flatnonzero(part == i), np.flatnonzero(part == j)
    both, mine, yours = (np.zeros((len(x), len(y)), np.float32) for _ in range(3))
    for c in range(0, int((times > 1).sum()), COLUMNS):
        here = (column >= c) & (column < c + COLUMNS)
        ones = np.zeros((len(held), COLUMNS), np.float32)
        heavy = ones.copy()
        ones[owner[here], column[here] - c] = 1
        heavy[owner[here], column[here] - c] = weight[here]
        both += ones[x] @ ones[y].T
        mine += heavy[x] @ ones[y].T
        yours += ones[x] @ heavy[y].T
    size, total = np.array([len(s) for s, _ in held]), np.array([w.sum() for _, w in held])
    plain = both / (size[x][:, None] + size[y][None] - both)
    # No probability Jaccard exceeds either text's share of weight on common shingles.
    bound = np.minimum(mine / total[x][:, None], yours / total[y][None])
    out: list[tuple] = []
    above: dict = {}

    def top(r):
        while r in above:
            r = above[r]
        return r

    for p, q in np.argwhere((np.maximum(plain, bound) >= LEAST - 1e-4) & (root[x][:, None] != root[y][None])).tolist():
        a, b = x[p], y[q]
        u, v = top(root[a]), top(root[b])
        if u != v and max(similarity(held[a], held[b])) >= LEAST:
            above[max(u, v)] = min(u, v)
            out.append((doc[a], doc[b]))
    return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it is linked with, over any number of links) of the links' ends.

    links: a, b. Alternates two steps until nothing moves: each node's larger neighbours, then its smaller
    ones, are linked to its smallest neighbour. The number of rounds grows with the logarithm of the longest path.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).where("n > 0").withColumn("m", F.least("a", "m"))
        big = spread_join(both.where("b > a"), low, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = now


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of members (key, node, root) whose key has several roots, and n, the key's rows."""
    members = cut(members)
    several = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
    return cut(spread_join(members, several, "key", "n"))


def _across(few: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that share a key; at most FEW rows share one."""
    x, y = few.select("key", F.col("node").alias("a"), F.col("root").alias("ra")), few.select("key", F.col("node").alias("b"), F.col("root").alias("rb"))
    return x.join(y, "key").where("ra < rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verified(pairs: DataFrame, needed: DataFrame) -> DataFrame:
    """same, for each pair (a, b); needed: node, text. The text of a node that is a in many pairs is sent once for each LIGHT of them."""
    pairs = stored(pairs, "pairs")
    n = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / LIGHT).cast("int")
    dealt = spread_join(pairs, n, "a", "n").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    x = n.join(needed.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").select("a", "x", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    y = needed.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return cut(map_batches(dealt.join(y, "b").join(x, ["a", "salt"]).select("a", "b", "x", "y"), _verify, "a long, b long, same boolean"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root once links (a, b) join classes of roots (node, root) or nodes outside."""
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    new = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("now"))
    old = roots.join(new, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return old.unionByName(new.join(roots, F.col("node") == new["root"], "left_anti").select(F.col("root").alias("node"), F.col("now").alias("root")))


def _digest(text: Column) -> Column:
    """The half digest that tells texts apart, as _sketch makes it."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _found(known: DataFrame, ids_join: bool) -> tuple[DataFrame, DataFrame]:
    """(sketches, named) of docs (doc_id, text) with ids: doc_id, copy, bands of each row; and copy, doc (its least id), rows, root of each different text with words.

    ids_join: texts of one id are of one class whatever they say.
    """
    kind = known.schema["doc_id"].dataType.simpleString()
    sketches = stored(map_batches(known, _sketch, f"doc_id {kind}, copy binary, bands array<bigint>"), "sketches")
    worded = sketches.where(F.size("bands") > 0)
    # One node for each different text.
    copies = worded.groupBy("copy").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    copies = stored(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    members = copies.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(spread_join(members, buckets, "key", "n"))
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    leads = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("lead"), F.count("*").alias("n")).select("key", "n", F.col("lead.node").alias("lead"))
    # The texts that stand in any bucket with another: only those are read again, one row each.
    wanted = copies.join(met, "node", "left_semi").select("node", F.col("doc").alias("doc_id"), "copy")
    needed = stored(known.withColumn("copy", _digest(F.col("text"))).join(wanted, ["doc_id", "copy"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    to_lead = spread_join(members.drop("n"), leads, "key", "n").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    done = _verified(to_lead, needed)
    roots = components(done.where("same"))
    # What is left: members of a bucket that are in different classes, among which its lead linked nothing.
    grouped = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = _mixed(grouped)
    large = mixed.where(F.col("n") > DIVIDE)
    finer = map_batches(needed.join(large.select("node").distinct(), "node", "left_semi"), _finer, "node long, fine array<bigint>")
    again = _mixed(large.join(finer, "node").select("node", "root", F.explode(F.transform("fine", lambda f: F.xxhash64("key", f))).alias("key")))
    buckets = mixed.where(F.col("n") <= DIVIDE).unionByName(again)
    tried = done.select("a", "b").unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = _across(buckets.where(F.col("n") <= FEW)).distinct()
    links = _verified(across.join(tried, ["a", "b"], "left_anti"), needed).where("same").select("a", "b")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = (
        buckets.where(F.col("n") > FEW)
        .withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .select("key", "node", "root", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("key", "node", "root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .join(needed, "node")
    )
    links = links.unionByName(blocks.groupBy("key", "i", "j").applyInArrow(_block, "a long, b long"))
    if ids_join:
        links = links.unionByName(_of_one_id(worded, copies))
    links = cut(links)
    if not links.isEmpty():
        roots = _joined(roots, links)
    return sketches, stored(copies.select("copy", "doc", "rows", "node").join(roots, "node", "left").select("copy", "doc", "rows", F.coalesce("root", "node").alias("root")), "named")


def _of_one_id(worded: DataFrame, copies: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of texts that stand with one id."""
    ids = worded.groupBy("doc_id").agg(F.min("copy").alias("low"), F.max("copy").alias("high"), F.count("*").alias("n")).where("low < high").select("doc_id", "low", "n")
    node = copies.select("copy", "node")
    twice = spread_join(worded.select("doc_id", "copy"), ids, "doc_id", "n").select("low", "copy").distinct()
    twice = twice.join(node.withColumnRenamed("node", "b"), "copy").join(node.select(F.col("copy").alias("low"), F.col("node").alias("a")), "low").select("a", "b").where("a <> b")
    return twice


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size: one row per row of docs. Rows of one id are of one class."""
    docs = texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches, named = _found(docs.where(F.col("doc_id").isNotNull()), True)
    worded = sketches.where(F.size("bands") > 0)
    whole = named.groupBy("root").agg(F.min("doc").alias("class_id"), F.sum("rows").alias("class_size"), F.count("*").alias("n"))
    named = spread_join(named.select("copy", "rows", "root"), whole, "root", "n").select("copy", "rows", "class_id", "class_size")
    out = spread_join(worded.select("doc_id", "copy"), named, "copy", "rows").select("doc_id", "class_id", "class_size")
    alone = F.lit(1).cast("long").alias("class_size")
    empty = sketches.where(F.size("bands") == 0).select("doc_id", F.col("doc_id").alias("class_id"), alone)
    return out.unionByName(empty).unionByName(docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast(kind).alias("class_id"), alone))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class of near copies the row with the smallest id, of several texts of that id in the class the first by digest.

    Members are rows, so different texts that share an id are judged each on its own. Of rows of one id and one text the greatest by its columns in order stays, so
    the choice can be repeated. Texts without words, and rows with a null id, all stay.
    """
    sketches, named = _found(texts(docs).where(F.col("doc_id").isNotNull()), False)
    firsts = named.groupBy("root").agg(F.min(F.struct("doc", "copy")).alias("first")).select(F.col("first.doc").alias("doc_id"), F.col("first.copy").alias("copy"))
    counts = sketches.where(F.size("bands") > 0).join(firsts, ["doc_id", "copy"], "left_semi").groupBy("doc_id", "copy").agg(F.count("*").alias("n"))
    wordless = sketches.where(F.size("bands") == 0).select("doc_id", "copy").distinct().withColumn("n", F.lit(1).cast("long"))
    kept = stored(counts.unionByName(wordless).withColumnsRenamed({"doc_id": "_id", "copy": "_copy"}), "kept")
    rows = docs.withColumns({"_id": F.col("doc_id"), "_copy": _digest(F.coalesce("text", F.lit("")))})
    one = rows.join(kept.where("n = 1").select("_id", "_copy"), ["_id", "_copy"], "left_semi").select(docs.columns)
    again = rows.join(kept.where("n > 1").select("_id", "_copy"), ["_id", "_copy"], "left_semi").groupBy("_id", "_copy").agg(F.max(F.struct(*docs.columns)).alias("most")).select("most.*")
    return one.unionByName(again).unionByName(docs.where(F.col("doc_id").isNull()))
