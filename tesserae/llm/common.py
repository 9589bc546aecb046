"""What the operators share: reading tables, cutting lineage, and driving Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lower-cases A-Z; every other ASCII character but digits and a-z becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of letters and digits of a UTF-8 text, A-Z lower-cased; characters beyond ASCII are letters."""
    return text.translate(FOLD).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id and text, null texts as empty ones, and the columns to keep as one struct, kept; no other column can clash afterwards."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))


def fields(df: DataFrame, *names: str) -> str:
    """The named columns of df, those that it has, as the beginning of a schema text."""
    return "".join(f"{n} {df.schema[n].dataType.simpleString()}, " for n in names if n in df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves a session whose tasks all run on it; on a cluster that is an error, as executors
    couldn't read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later stages read it again after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a Parquet table in the shared folder, and read from there; free() empties it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Empties the tables that stored() has written in this process (those from the first to before the last), once nothing reads them any more."""
    for path in _written[first:last]:
        spark.range(0).write.mode("overwrite").parquet(path)
    del _written[first:last]


def written() -> int:
    """How many tables stored() has written and free() not emptied."""
    return len(_written)


_slot: list = [None, None, None]


def release() -> None:
    """Hands memory that is no longer in use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the usual C library of Linux has it
    if trim:
        trim(0)


def worker_holds(name: str, source: Any, make: Callable[[], Any]) -> Any:
    """make(), made once in a worker for a name and a source (by identity) and held until another operator asks for something else.

    Spark uses its Python workers again, so what one operator holds would stay in memory beside the next one's.
    """
    if _slot[0] != name or _slot[1] is not source:
        _slot[:] = None, None, None
        release()
        _slot[:] = name, source, make()
    return _slot[2]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, so that few texts at a time become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies f to parts of each Arrow batch; rows of a partition never meet in one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dictionary that computes what it lacks; trim() empties it once it is over its size."""

    def __init__(self, f: Callable, size: int):
        super().__init__()
        self.f, self.size = f, size

    def __missing__(self, key):
        value = self[key] = self.f(key)
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.clear()


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Rows of (word, n) with the greatest n, at most `limit`: all from a threshold on.

    The threshold comes from a histogram of at most a thousand buckets, so no task and no driver ranks all words. Words as frequent as
    those of the first bucket that would not fit stay out: for what is a store of often needed words, not a choice.
    """
    bucket = F.floor(F.log2("n") * 16).cast("int")
    left, least = limit, None
    for r in sorted(counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.b):
        if r.k > left:
            break
        left, least = left - r.k, r.b
    return counts.where(bucket >= least) if least is not None else counts.limit(0)


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Exactly the `limit` rows of (word, n) with the greatest n, or all: of equals those first by word.

    Only words from the histogram's last bucket that is needed on are ranked, at most `limit` a task.
    """
    bucket = F.floor(F.log2("n") * 16).cast("int")
    left, least = limit, -1
    for r in sorted(counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.b):
        least, left = r.b, left - r.k
        if left <= 0:
            break
    return counts.where(bucket >= least).orderBy(F.desc("n"), "word").limit(limit)


#: Rows of a table that may be broadcast by spread_join; rows of a key up to which one task may get them all.
HEAVY, LIGHT = 100_000, 1_000


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """left joined with right (one row a key, whose column n says how many rows of left have it), without a task that gets all rows of a frequent key.

    Keys with more than LIGHT rows and more than one in HEAVY of all rows are fewer than HEAVY: these are broadcast, and their rows of left stay
    where they are. The other rows are shuffled.
    """
    right = stored(right, "keys")
    whole, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(LIGHT, whole // HEAVY)
    if most <= least:
        return left.join(right, key)
    heavy = right.where(F.col(n) > least)
    light = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(right.where(F.col(n) <= least), key)
    return left.join(F.broadcast(heavy), key).unionByName(light)


def drawn(df: DataFrame, limit: int, *key: str) -> DataFrame:
    """All rows, or about 95 of a hundred of `limit`, drawn by a hash of their key."""
    share = 0.95 * limit / max(1, df.count())
    return df if share >= 0.95 else df.where(F.pmod(F.xxhash64(*key), F.lit(1_000_003)) < int(1_000_003 * share))


class IntTable:
    """A map of non-negative 64-bit integers that looks many up at once: open addressing over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        at = self._at(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], default)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            found = self.keys[at[left]]
            same = found == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (found != -1)]
        return out


def held_out(buckets: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo the number of buckets."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % buckets
