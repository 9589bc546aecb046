"""Per-series kernels on Spark: each series is one row of arrays, a batch of rows one call of a NumPy kernel."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import kernels
from tesserae.functions.scalar import EARTH_KM
from tesserae.operators.radius import KM_PER_DEGREE
from tesserae.sources.files import kept


def as_rows(field: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """by, ts and values: one row a series, in order of t."""
    rows = field.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", F.col(v).alias("v")))).alias("_x"))
    return rows.select(*by, F.transform("_x", lambda s: s["t"]).alias("ts"), F.transform("_x", lambda s: s["v"].cast("double")).alias("values"))


def as_field(rows: DataFrame, by: list[str], *names: str) -> DataFrame:
    """One row a time again, with the named arrays as columns."""
    return rows.select(*by, F.explode(F.arrays_zip("ts", *names)).alias("_z")).select(*by, F.col("_z.ts").alias("t"), *[F.col(f"_z.{n}").alias(n) for n in names])


def apply_rows(rows: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """Adds arrays that the kernel makes of rows of equal length; a series with a gap gets nulls."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values").to_pylist()
            out: dict[str, list] = {n: [[None] * len(v) for v in values] for n in names}
            lengths: dict[int, list[int]] = {}
            for i, v in enumerate(values):
                if v and None not in v:
                    lengths.setdefault(len(v), []).append(i)
            for at in lengths.values():
                made = kernel(np.array([values[i] for i in at], float))
                for n in names:
                    for i, row in zip(at, made[n], strict=True):
                        out[n][i] = [None if x != x else x for x in row.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[n], pa.list_(pa.float64())) for n in names)], [*batch.schema.names, *names])

    return rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{n} array<double>" for n in names))


def bandpass(field: DataFrame, by: list[str], longest: float, shortest: float, order: int = 4) -> DataFrame:
    """by, t, f: zero-phase Butterworth between two periods (in samples)."""
    sections = kernels.butterworth(order, 2 / longest, 2 / shortest)
    return as_field(apply_rows(as_rows(field, by), lambda x: {"f": kernels.zero_phase(sections, x)}, ["f"]), by, "f")


def lowpass(field: DataFrame, by: list[str], period: float, order: int = 4) -> DataFrame:
    sections = kernels.butterworth(order, None, 2 / period)
    return as_field(apply_rows(as_rows(field, by), lambda x: {"f": kernels.zero_phase(sections, x)}, ["f"]), by, "f")


def phase_of(field: DataFrame, by: list[str], longest: float, shortest: float, order: int = 4) -> DataFrame:
    """by, t, amplitude, phase of the band-passed signal."""
    sections = kernels.butterworth(order, 2 / longest, 2 / shortest)

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        z = kernels.analytic(kernels.zero_phase(sections, x))
        return {"amplitude": np.abs(z), "phase": np.angle(z)}

    return as_field(apply_rows(as_rows(field, by), kernel, ["amplitude", "phase"]), by, "amplitude", "phase")


def wavelet_phase(field: DataFrame, by: list[str], period: float) -> DataFrame:
    return as_field(apply_rows(as_rows(field, by), lambda x: {"phase": kernels.morlet_phase(x, period)}, ["phase"]), by, "phase")


def spectrum(field: DataFrame, by: list[str], segment: int = 16) -> DataFrame:
    """by, frequency, power (area one) of each series."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = kernels.welch(pdf.sort_values("t")["v"].to_numpy(float), segment)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * len(f) for b in by}, "frequency": f, "power": p})

    kinds = ", ".join(f"{b} {field.schema[b].dataType.simpleString()}" for b in by)
    return field.select(*by, "t", "v").groupBy(*by).applyInPandas(one, f"{kinds}, frequency double, power double")


def surrogate_envelope(spark: SparkSession, field: DataFrame, replicates: int, quantiles: list[float], longest: float, shortest: float, seed: int = 11) -> DataFrame:
    """t, q, r: quantiles over replicates of R(t) where every series has random phases.

    Each (series, replicate) is a row of its own with its own seed; R is a mean over rows, not held by any task.
    """
    rows = as_rows(field, ["cell"]).crossJoin(spark.range(replicates).withColumnRenamed("id", "replicate"))  # the stated replicates
    sections = kernels.butterworth(4, 2 / longest, 2 / shortest)
    rows = rows.withColumn("values", F.concat(F.array(F.pmod(F.xxhash64("cell", "replicate", F.lit(seed)), F.lit(2**31)).cast("double")), "values"))

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        made = np.array([kernels.surrogate(row[1:], np.random.default_rng(int(row[0]))) for row in x])
        return {"phase": np.angle(kernels.analytic(kernels.zero_phase(sections, made)))}

    phases = as_field(apply_rows(rows, kernel, ["phase"]), ["cell", "replicate"], "phase")
    c, s = F.avg(F.cos("phase")), F.avg(F.sin("phase"))
    r = phases.groupBy("replicate", "t").agg(F.sqrt(c * c + s * s).alias("r"))
    return r.groupBy("t").agg(F.percentile("r", quantiles).alias("x")).select("t", F.posexplode("x").alias("k", "r")).select("t", F.element_at(F.array(*map(F.lit, quantiles)), F.col("k") + 1).alias("q"), "r")


def transfer(pairs: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """by, nats each way of each group of (t, source, target)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        s, y = pdf["source"].to_numpy(float), pdf["target"].to_numpy(float)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "forward": [kernels.transfer_entropy(s, y, k)], "backward": [kernels.transfer_entropy(y, s, k)]})

    kinds = ", ".join(f"{b} {pairs.schema[b].dataType.simpleString()}" for b in by)
    return pairs.select(*by, "t", "source", "target").groupBy(*by).applyInPandas(one, f"{kinds}, forward double, backward double")


UNDECIDED, MEMBER, SEED = -1, 0, 1


def spatial_blocks(places: DataFrame, by: list[str], km: float, strip_km: float = 5_000.0) -> DataFrame:
    """by, cell, block: greedy blocks in order of cell, as one scan makes them: a place within km / 2 of a seed before it joins the nearest of those, others become seeds.

    A task scans one strip of latitude, with the places of the adjacent strips within the distance. A place beside an earlier seed is none; beside
    an earlier place that is undecided it waits for the next round; else it is a seed. Each round decides the first place that is left, at least, and mostly a whole strip.
    """
    radius = km / 2
    height = max(strip_km, km) / KM_PER_DEGREE
    edge = radius / KM_PER_DEGREE * 1.0001
    own = F.floor((F.col("lat") + 90) / height).cast("int")
    inside = F.col("lat") + 90 - own * height
    sent_to = F.array_compact(F.array(own, F.when(inside <= edge, own - 1), F.when(height - inside <= edge, own + 1)))
    kinds = "".join(f"`{b}` {places.schema[b].dataType.simpleString()}, " for b in by) + f"cell {places.schema['cell'].dataType.simpleString()}, lat double, lon double, "

    def in_strips(df: DataFrame, scan: Callable[[pd.DataFrame], pd.DataFrame], last: str) -> DataFrame:
        dealt = df.withColumn("_strip", F.explode(sent_to)).withColumn("_own", F.col("_strip") == own)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            out = scan(pdf.sort_values("cell", ignore_index=True))
            return out[out["_own"]].drop(columns=["_strip", "_own"])

        return kept(dealt.groupBy(*by, "_strip").applyInPandas(one, f"{kinds}{last}"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(state=kernels.decided(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["state"].to_numpy(), pdf["_own"].to_numpy(), radius))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(block=kernels.nearest_seed(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["block"].to_numpy(), radius))

    state = places.select(*by, "cell", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.lit(UNDECIDED).alias("state"))
    while True:
        state = in_strips(state, decide, "state int")
        if state.where(F.col("state") == UNDECIDED).isEmpty():
            break
    number = F.row_number().over(Window.partitionBy(*by).orderBy("cell")) - 1  # of seeds, some thousands
    numbered = state.where(F.col("state") == SEED).select(*by, "cell", "lat", "lon", number.cast("long").alias("block"))
    others = state.where(F.col("state") == MEMBER).select(*by, "cell", "lat", "lon", F.lit(-1).cast("long").alias("block"))
    return in_strips(numbered.unionByName(others), join, "block long").select(*by, "cell", "block")


def largest_patches(cells: DataFrame, by: list[str], strip: int = 256) -> DataFrame:
    """by, area: the largest area of edge-connected cells (lat_idx, lon_idx, area) in each group.

    A task labels the cells of one strip of rows; labels that touch across the edges of strips are joined over rounds.
    """
    cells = cells.select(*by, F.col("lat_idx").cast("long").alias("lat_idx"), F.col("lon_idx").cast("long").alias("lon_idx"), F.col("area").cast("double").alias("area"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(label=kernels.patch_labels(pdf["lat_idx"].to_numpy(), pdf["lon_idx"].to_numpy())).drop(columns="_strip")

    kinds = "".join(f"`{b}` {cells.schema[b].dataType.simpleString()}, " for b in by)
    labelled = kept(cells.withColumn("_strip", F.floor(F.col("lat_idx") / strip)).groupBy(*by, "_strip").applyInPandas(label, f"{kinds}lat_idx long, lon_idx long, area double, label long"))
    areas = labelled.groupBy(*by, "label").agg(F.sum("area").alias("area"))
    low = labelled.where(F.pmod("lat_idx", F.lit(strip)) == 0).select(*by, (F.col("lat_idx") - 1).alias("lat_idx"), "lon_idx", F.col("label").alias("a"))
    high = labelled.where(F.pmod(F.col("lat_idx") + 1, F.lit(strip)) == 0).select(*by, "lat_idx", "lon_idx", F.col("label").alias("b"))
    touching = low.join(high, [*by, "lat_idx", "lon_idx"]).select(*by, "a", "b").distinct()
    patches = areas.join(merged_labels(touching, by), [*by, "label"], "left").groupBy(*by, F.coalesce("root", "label").alias("_root")).agg(F.sum("area").alias("area"))
    return patches.groupBy(*by).agg(F.max("area").alias("area"))


def merged_labels(touching: DataFrame, by: list[str]) -> DataFrame:
    """by, label, root of labels in pairs (by, a, b): the least label that each is linked with.

    In each round every root takes the least root beside it, then chains of roots are followed by doubling; rounds end when no pair has two roots.
    """
    edges = kept(touching)
    roots = edges.select(*by, F.col("a").alias("label")).union(edges.select(*by, F.col("b").alias("label"))).distinct().withColumn("root", F.col("label"))
    while not edges.isEmpty():
        both = edges.union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        up = kept(both.groupBy(*by, "a").agg(F.least("a", F.min("b")).alias("to")))
        while True:
            above = up.select(*by, F.col("a").alias("to"), F.col("to").alias("_next"))
            up = kept(up.join(above, [*by, "to"]).select(*by, "a", F.col("_next").alias("to"), (F.col("_next") < F.col("to")).alias("_went")))
            if up.where("_went").isEmpty():
                break
            up = up.drop("_went")
        step = up.select(*by, F.col("a").alias("root"), "to")
        roots = kept(roots.join(step, [*by, "root"], "left").select(*by, "label", F.coalesce("to", "root").alias("root")))
        ends = lambda c, n: step.withColumnsRenamed({"root": c, "to": n})
        edges = kept(edges.join(ends("a", "_a"), [*by, "a"]).join(ends("b", "_b"), [*by, "b"]).where("_a <> _b").select(*by, F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    return roots


def closures(cells: DataFrame, by: list[str], forms: dict = kernels.CLOSURES) -> DataFrame:
    """by, family, k, params, ss, chi2, aic, bic, best: fits of r against d in each group (one basin's cells), in order of AIC; none with fewer than six cells."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna()
        found = kernels.scored(forms, pdf["d"].to_numpy(float), pdf["r"].to_numpy(float)) if len(pdf) > 5 else []
        out = pd.DataFrame(found, columns=["family", "k", "params", "ss", "chi2", "aic", "bic"])
        for b in by:
            out[b] = pdf[b].iloc[0] if len(pdf) else None
        out["best"] = out.index == 0
        return out[[*by, "family", "k", "params", "ss", "chi2", "aic", "bic", "best"]]

    kinds = ", ".join(f"{b} {cells.schema[b].dataType.simpleString()}" for b in by)
    return cells.select(*by, "d", "r").groupBy(*by).applyInPandas(one, f"{kinds}, family string, k int, params array<double>, ss double, chi2 double, aic double, bic double, best boolean")


#: Waves of a random field.
WAVES = 400


def gaussian_fields(spark: SparkSession, places: DataFrame, numbers: int, km: float, seed: int = 1, waves: int = WAVES) -> DataFrame:
    """number, cell, v: standardised random fields of covariance exp(-d^2 / (2 km^2)), d the chord between two places (cell, lat, lon).

    A field is a sum of plane waves in space with normal wave vectors of spread 1 / km and random phases, all drawn from a digest of (seed, number, wave): close to
    Gaussian for many waves, the same in every engine, and a sum of its own at each place, so that no task needs two places.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("number"), F.col("wave")).cast("binary"))
    u = [(F.conv(F.substring(digest, 6 * i + 1, 6), 16, 10).cast("double") + 0.5) / 2.0**24 for i in range(5)]
    normal = lambda a, b, f: F.sqrt(-2 * F.log(a)) * f(2 * math.pi * b) / km
    drawn = spark.range(numbers).withColumnRenamed("id", "number").withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    wave = F.struct(normal(u[0], u[1], F.cos).alias("x"), normal(u[0], u[1], F.sin).alias("y"), normal(u[2], u[3], F.cos).alias("z"), (2 * math.pi * u[4]).alias("p"))
    sets = drawn.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("wave", wave.alias("k")))).alias("_w"))  # a row a field, its size a parameter
    lat, lon = F.radians("lat"), F.radians("lon")
    at = places.select("cell", (EARTH_KM * F.cos(lat) * F.cos(lon)).alias("_x"), (EARTH_KM * F.cos(lat) * F.sin(lon)).alias("_y"), (EARTH_KM * F.sin(lat)).alias("_z"))
    phase = lambda w: w["k"]["x"] * F.col("_x") + w["k"]["y"] * F.col("_y") + w["k"]["z"] * F.col("_z") + w["k"]["p"]
    v = F.aggregate("_w", F.lit(0.0), lambda s, w: s + F.cos(phase(w)))
    rows = at.crossJoin(F.broadcast(sets)).select("number", "cell", v.alias("v"))  # the stated fields at every place
    spread = rows.groupBy("number").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return rows.join(F.broadcast(spread), "number").select("number", "cell", F.when(F.col("_s") > 0, (F.col("v") - F.col("_m")) / F.col("_s")).alias("v"))
