"""Trend tests that are defined on all pairs of a series, without a row or a step a pair: a series is one row of arrays, a kernel counts in n log n steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import pairs


def pair_trends(series: DataFrame, by: list[str]) -> DataFrame:
    """by, rises (less falls), every (pairs at different times), differ (those of different values), sen (the median slope) of v over t in each group; missing values don't count, and groups without a pair have no row."""
    rows = series.where("t IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)").groupBy(*by)
    rows = rows.agg(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"))).alias("_x")).where(F.size("_x") > 1)
    arrays = rows.select(*by, F.transform("_x", lambda x: x["t"]).alias("_t"), F.transform("_x", lambda x: x["v"]).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, v in zip(batch.column("_t"), batch.column("_v"), strict=True):
                t, v = (x.values.to_numpy(zero_copy_only=False) for x in (t, v))
                out.append((*pairs.kendall(t, v), pairs.median_slope(t, v)))
            columns = [np.array([r[i] for r in out], kind) for i, kind in enumerate((np.int64, np.int64, np.int64, float))]
            yield pa.RecordBatch.from_arrays([*(batch.column(b) for b in by), *map(pa.array, columns)], [*by, "rises", "every", "differ", "sen"])

    kinds = "".join(f"`{b}` {series.schema[b].dataType.simpleString()}, " for b in by)
    return arrays.mapInArrow(run, f"{kinds}rises long, every long, differ long, sen double").where("every > 0")
