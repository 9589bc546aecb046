"""Secrets among candidates by a random forest (operator 4).

Candidates are runs of at least SHORTEST key characters with a digit or of mixed case, strings of the
known key formats wherever they stand alone, and values of at least 8 characters of any kind
assigned to words like password or token: all within the quotes, or all up to white space or a quote without the
punctuation behind. Findings are labelled where there is no doubt: known key formats
and assigned values of great variety are secrets; candidates that are part of an address, a
number or a plain word, or that repeat few characters, are false positives. All others have no label: bare strings such as
digests, and assigned values that may be words, names or placeholders. The forest decides on every candidate. It
doesn't see formats, labels or assignments: it sees the length, how likely the characters' transitions are in the corpus,
the share of characters within dictionary words, the variety of characters and their kinds, the path (the hashed
source), and the hashed words before and after.

A fifth of the labelled findings, by a hash of their string, is held out: the forest never learns from these, and `held_out` marks them, so
that precision and recall can be read from the result. The dictionary is every word of 4 to 16 letters that the texts have
at least KNOWN times, the transitions are counted over all
texts, and at most SAMPLE findings, drawn by hash, train the forest. Without findings of both
kinds a candidate's own label decides and the score is null. One row for each candidate; null and
empty texts have none; repeated rows have theirs each.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .brown import counted
from .common import drawn, map_batches, slices, spread_join, stored, texts

SHORTEST, SAMPLE, TREES, DEPTH, SEED = 16, 50_000, 40, 8, 7
#: Occurrences from which on a word is in the dictionary; lengths of its words; buckets of hashed neighbours and paths.
KNOWN, LENGTHS, BUCKETS = 20, range(4, 17), 32
#: Characters of a token whose pieces are made at a time.
PART = 20_000
#: Values with which key strings of well-known services begin, and how they go on.
_KEYS = r"(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+)"
FORMATS = re.compile(rf"\A{_KEYS}\Z")
#: A key that stands alone.
BARE = re.compile(rf"(?<![\w+/=.@-]){_KEYS}(?![\w])")
_NAMES = r"(?<![a-z])(?:password|passwd|pwd|token|secret|api_?key|access_?key|auth)"
ASSIGNED = re.compile(rf"(?i){_NAMES}\s*[=:]\s*[\"']?\Z")
#: A value and what it is assigned to; one of the groups is the value.
VALUE = re.compile(rf"(?i){_NAMES}[\"']?\s*[=:]\s*(?:\"([^\"\n]{{8,}})\"|'([^'\n]{{8,}})'|[\"']?([^\s\"']{{7,}}[^\s\"',;.)\]}}>]))")
CANDIDATE = re.compile(r"(?<![\w+/=.@-])[A-Za-z0-9_+/-]{16,}={0,2}|(?<=[=:\"'])[A-Za-z0-9_+/.-]{8,}={0,2}")
MARKED = re.compile("[0-9A-Z]")
LETTERS = re.compile(r"[^\W\d_]{4,}")
WORDLIKE = re.compile(r"\A[A-ZÀ-Þ]?[a-zß-ÿ]+\Z|\A[A-Z]+\Z")


def candidates(text: str) -> list[tuple[int, int, bool, bool]]:
    """(begin, end, assigned, part of something larger) of each candidate."""
    spans = {m.span(m.lastindex): (True, False) for m in VALUE.finditer(text)}
    for m in BARE.finditer(text):
        spans.setdefault(m.span(), (False, False))
    # What lies within one of these is no candidate of its own, unless a quoted value is several words.
    taken = sorted(s for s in spans if not any(map(str.isspace, text[s[0] : s[1]])))
    for m in CANDIDATE.finditer(text):
        b, e = m.span()
        i = bisect(taken, (b, len(text))) - 1
        if i >= 0 and e <= taken[i][1] or not MARKED.search(text, b, e):
            continue
        assigned = bool(ASSIGNED.search(text, max(0, b - 30), b))
        if assigned or e - b >= SHORTEST:
            larger = (b > 0 and text[b - 1] in "@.") or text[e : e + 1] in ("@", ".") and text[e + 1 : e + 2].isalnum()
            spans.setdefault((b, e), (assigned, larger))
    return [(*s, *spans[s]) for s in sorted(spans)]


def label(token: str, assigned: bool, larger: bool) -> int | None:
    """1 for a finding known to be a secret, 0 for a known false positive, None where no rule speaks."""
    if FORMATS.match(token):
        return 1
    if larger or token.isdigit() or WORDLIKE.match(token) or len(set(token)) <= 3:
        return 0
    return 1 if assigned and len(set(token)) >= 10 and sum(map(str.isdigit, token)) * 5 >= len(token) else None


def _transitions(docs: DataFrame) -> np.ndarray:
    """Log probabilities of the next character among 128 (those beyond are one), from all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128 * 128, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                x = np.minimum(np.frombuffer(text.as_buffer(), np.uint8), 127).astype(np.int64)
                if len(x) > 1:
                    total += np.bincount(x[:-1] * 128 + x[1:], minlength=128 * 128)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    table = np.ones(128 * 128)
    for r in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most 16,384 rows
        table[r.k] += r.n
    table = table.reshape(128, 128)
    return np.log(table / table.sum(1, keepdims=True))


def features(token: str, before: str, after: str, path: str, transitions: np.ndarray) -> list[float]:
    """All but the dictionary's coverage."""
    x = np.minimum(np.frombuffer(token.encode(), np.uint8), 127)
    counts = Counter(token)
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    share = lambda f: sum(map(f, token)) / len(token)
    kind = lambda c: 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3
    changes = sum(kind(a) != kind(b) for a, b in zip(token, token[1:], strict=False)) / max(1, len(token) - 1)
    hashed = lambda s: [float(xxhash.xxh32_intdigest(s) % BUCKETS == i) for i in range(BUCKETS)]
    return [float(len(token)), float(transitions[x[:-1], x[1:]].mean()) if len(x) > 1 else 0.0, entropy, share(str.isdigit), share(str.isupper), share(str.islower), changes, len(counts) / len(token), *hashed(before.lower()), *hashed(after.lower()), *hashed(path)]


def pieces(token: str, start: int = 0, stop: int | None = None) -> list[tuple[int, str]]:
    """(begin, lower-cased text) of each run of 4 to 16 letters that a dictionary word could cover, of those that begin from start to before stop."""
    low = token.lower() if len(token.lower()) == len(token) else token
    stop = len(low) if stop is None else stop
    return [(i, low[i : i + n]) for m in LETTERS.finditer(low) for n in LENGTHS for i in range(max(start, m.start()), min(stop, m.end() - n + 1))]


def coverage(spans: DataFrame, key: str) -> DataFrame:
    """key and inside, the number of characters within its spans (key, begin, size), overlapping ones once: each adds what lies behind the farthest end before it."""
    before = Window.partitionBy(key).orderBy("begin", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("begin") + F.col("size")
    more = F.greatest(F.lit(0), end - F.greatest(F.col("begin"), F.coalesce(F.max(end).over(before), F.lit(0))))
    return spans.withColumn("_more", more).groupBy(key).agg(F.sum("_more").alias("inside"))


def _covered(found: DataFrame, counts: DataFrame) -> DataFrame:
    """digest, n (rows of found), covered of each different token: pieces of tokens are joined with the dictionary, neither is gathered anywhere."""
    tokens = found.groupBy("digest").agg(F.count("*").alias("n"), F.first("token").alias("token"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of PART characters of a token at a time."""
        for batch in slices(batches, 100):
            rows = []
            for d, t in zip(batch.column("digest").to_pylist(), batch.column("token").to_pylist(), strict=True):
                for begin in range(0, len(t), PART):
                    rows += [(d, b, p) for b, p in pieces(t, begin, begin + PART)]
                    if len(rows) >= PART:
                        yield as_batch(rows)
                        rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["digest", "begin", "word"])

    parts = stored(tokens.select("digest", "token").mapInArrow(cut, "digest binary, begin long, word string"), "pieces")
    known = counts.where(F.col("n") >= KNOWN).select("word").join(parts.groupBy("word").agg(F.count("*").alias("times")), "word")
    spans = spread_join(parts, known, "word", "times").select("digest", "begin", F.length("word").alias("size"))
    inside = coverage(spans, "digest")
    return tokens.join(inside, "digest", "left").select("digest", "n", (F.coalesce("inside", F.lit(0)) / F.length("token")).alias("covered"))


def find(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """doc_id, begin, end, secret (0 or 1), score, labelled (0, 1 or null), held_out of each candidate; docs: doc_id, text and a path."""
    spark = docs.sparkSession
    whole = texts(docs)
    held = spark.sparkContext.broadcast(_transitions(whole))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for doc, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path")), strict=True):
            for b, e, assigned, larger in candidates(text):
                token = text[b:e]
                before, after = text[max(0, b - 40) : b].split(), text[e : e + 40].split()
                digest = hashlib.sha256(token.encode()).digest()
                out.append((doc, b, e, token, digest, label(token, assigned, larger), digest[0] % 5 == 0, features(token, before[-1] if before else "", after[0] if after else "", path, held.value)))
        if out:
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.bool_(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "begin", "end", "token", "digest", "labelled", "apart", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = stored(map_batches(rows, run, f"doc_id {kind}, begin long, end long, token string, digest binary, labelled int, apart boolean, x array<double>"), "candidates")
    covered = _covered(found, counted(whole))
    held_out = (F.col("labelled").isNotNull() & F.col("apart")).alias("held_out")
    found = spread_join(found, covered, "digest", "n").select("doc_id", "begin", "end", "labelled", held_out, F.concat("x", F.array("covered")).alias("x"))
    known = drawn(found.where("labelled IS NOT NULL AND NOT held_out"), SAMPLE, "doc_id", "begin").orderBy("doc_id", "begin", "x").select(F.col("labelled").cast("double").alias("label"), array_to_vector("x").alias("features"))
    if known.select("label").distinct().count() < 2:
        return found.select("doc_id", "begin", "end", F.coalesce("labelled", F.lit(0)).alias("secret"), F.lit(None).cast("double").alias("score"), "labelled", "held_out")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=SEED).fit(known)
    scored = forest.transform(found.withColumn("features", array_to_vector("x"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "begin", "end", (F.col("score") >= 0.5).cast("int").alias("secret"), "score", "labelled", "held_out")


def digest(docs: DataFrame) -> DataFrame:
    """Every candidate with its score to nine places, as the forest's sums may differ beyond."""
    return find(docs).select("doc_id", "begin", "end", "secret", F.round("score", 9).alias("score"), "labelled", "held_out")
