"""Bottom-k fingerprints of word shingles (operator 9).

A fingerprint is the K smallest hashes of a text's distinct shingles of five words. Equal texts
have equal fingerprints; the fingerprint of a union is made of its parts' fingerprints. From two of
them follow resemblance (Jaccard), containment and the number of distinct shingles.

A text of fewer than five words is one shingle; one without words has an empty fingerprint,
like itself (1.0) and like nothing else (0.0). Rows are kept one for one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, map_batches, texts
from .shingles import shingles

K = 64
#: Characters of text that a range of ids is meant to hold, and the most ranges.
RANGE, RANGES = 8_000_000, 20_000
LOWEST = -(2**63)


def bottom(text: str, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    return np.unique(shingles(text))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both: how many of the union's k smallest are in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that are in b."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct(np.union1d(a, b)[:k], k) / distinct(a, k))


def written(a: np.ndarray) -> str:
    """A fingerprint as text: base64 of its hashes, eight bytes each, largest byte first."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketch(docs: DataFrame, k: int = K, keep: tuple = ()) -> DataFrame:
    """doc_id, hashes (array of long, in the order of unsigned integers) of each row of docs (doc_id, text), and kept."""
    docs = texts(docs, keep)
    carried = [c for c in docs.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [bottom(x.as_py(), k).view(np.int64) for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(hashes, pa.list_(pa.int64()))], [*carried, "hashes"])

    return map_batches(docs, run, f"{fields(docs, *carried)}hashes array<bigint>")


def merged(sketches: DataFrame, by: str, k: int = K) -> DataFrame:
    """One fingerprint of all parts with the same value of `by`; each task passes on at most k hashes of a value."""
    order = F.col("h").bitwiseXOR(F.lit(LOWEST))  # the order of unsigned integers
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    low = sketches.select(by, F.explode("hashes").alias("h")).distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return low.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"]).alias("hashes"))


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as many first characters of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, edge, key, doc_id, text), a partition for each range of ids, from the largest id down, followed by an edge: the row that comes next.

    Texts are shuffled once. Range limits are quantiles of the ids, as many as the texts' length asks for; an edge is the first
    row of the range below, for the last range the first row of all. Equal ids follow each other by text; null ids come last.
    """
    spark = docs.sparkSession
    docs = texts(docs).withColumn("key", F.coalesce(F.col("doc_id"), F.lit(LOWEST)))
    n = min(RANGES, 1 + docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0] // RANGE)
    limits = docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 100_000).alias("q")).first().q or []
    limits = np.unique(np.array(limits, np.int64))

    @F.pandas_udf("int")
    def bucket(key):
        import pandas as pd

        return pd.Series(np.searchsorted(limits, key.to_numpy()).astype("int32"))

    docs = docs.withColumn("bucket", bucket("key"))
    tops = sorted((r.bucket, r.key) for r in docs.groupBy("bucket").agg(F.max("key").alias("key")).collect())  # a row a range
    if not tops:
        return docs.select("bucket", F.lit(False).alias("edge"), "key", "doc_id", "text")
    targets = spark.createDataFrame([(key, tops[(i + 1) % len(tops)][0]) for i, (_, key) in enumerate(tops)], "key long, target int")
    first = docs.drop("bucket").join(F.broadcast(targets), "key").groupBy("key", "target").agg(F.min("text").alias("text"))
    edges = first.select(F.col("target").alias("bucket"), F.lit(True).alias("edge"), "key", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")
    rows = docs.select("bucket", F.lit(False).alias("edge"), "key", "doc_id", "text").unionByName(edges)
    return rows.repartitionById(len(limits) + 1, "bucket").sortWithinPartitions("bucket", "edge", F.desc("key"), "text")


def digest(docs: DataFrame) -> DataFrame:
    """The contract of operator 9."""
    rows = with_next(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for edge, doc, text in zip(*(batch.column(c).to_pylist() for c in ("edge", "doc_id", "text")), strict=True):
                mine = bottom(text)
                if before:
                    last, was, own = before
                    new = edited(was, text)
                    changed = bottom(new)
                    out.append((last, len(was), hashlib.sha256(new.encode()).hexdigest(), written(own), written(changed), resemblance(own, changed), resemblance(own, mine), distinct(own), containment(own, changed)))
                before = None if edge else (doc, text, mine)
            if out:
                kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "kept_share"]
    return rows.mapInArrow(run, f"{fields(rows, 'doc_id')}n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept_share double")
