"""The streaming layer: monthly accumulators, a polled worklist, and rolling states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """Event files of a folder as they come, ts as a timestamp."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def accumulators(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Number and sum of values by type and period; what comes later than `late` is left out, and a period is given out once it is final."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def monthly(events: DataFrame) -> DataFrame:
    """Running number and sum by month: complete output, a row a month."""
    return events.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def lasting_runs(events: DataFrame, threshold: float, persist: int) -> DataFrame:
    """event_type, since: given out each time a type's values have stayed above the threshold for `persist` events in a row.

    The state of a type is the length and begin of its present run.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, since = state.get if state.exists else (0, 0)
        out = []
        for pdf in frames:
            for ts, v in pdf.sort_values("ts")[["ts", "value"]].itertuples(index=False):
                run, since = (run + 1, since if run else int(ts.value // 1000)) if v > threshold else (0, 0)
                if run == persist:
                    out.append((key[0], since))
        state.update((run, since))
        yield pd.DataFrame(out, columns=["event_type", "since"])

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, since long", "run long, since long", "append", "NoTimeout")


def poll(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls work for each batch of new targets; a batch is repeated after a failure, so work must overwrite what it wrote. Without `every`, all that is there is worked off once."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def refreshed(stream: DataFrame, update: Callable[[DataFrame | None, DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps a table up to date: each batch makes the next version of it, path/v=N, from the last one and the new rows.

    A repeated batch writes its version again from the one before it, so nothing is counted twice.
    """

    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={n - 1}") if n else None
        update(old, batch).write.mode("overwrite").parquet(f"{path}/v={n}")

    return poll(stream, work, checkpoint, every)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a refreshed table."""
    df = spark.read.parquet(path)
    return df.join(F.broadcast(df.agg(F.max("v").alias("v"))), "v").drop("v")  # one row
