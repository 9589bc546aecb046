"""Files that fields, proxies, indices and results come in, and the sinks they go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERDICT = "Q_X double, p_perm double, tau_fit double, tau_obs_NA double, chi2_nu double, verdict string, n_cells long, drift_K_per_year double, reason string"
#: Names under which products hold the same axis or variable.
ALIASES = {"lat": ["lat", "latitude", "nav_lat"], "lon": ["lon", "longitude", "nav_lon"], "level": ["plev", "level", "pressure_level"], "u": ["ua", "uwnd", "u"]}


def normalised(df: DataFrame, aliases: dict[str, list[str]] = ALIASES, required: list[str] = ()) -> DataFrame:
    """Columns renamed to their common names, NaN turned to null in doubles; a required name that no alias gives raises ValueError."""
    for name, others in aliases.items():
        for o in others:
            if name not in df.columns and o in df.columns:
                df = df.withColumnRenamed(o, name)
    if missing := [r for r in required if r not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir; where it is unset, of this machine for a session that runs all its tasks there."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: what reads it later sees the same rows, also after an executor is lost, and rounds don't repeat each other's work."""
    scratch(df.sparkSession, "kept")
    return df.checkpoint(eager=True)


def monthly_grids(spark: SparkSession, path: str, first: int, last: int, pattern: str = r"_(\d{6})\D*$") -> DataFrame:
    """Parquet grids of the months [first, last], with their stamp YYYYMM as ym.

    Where the grids are partitioned by ym, other months' folders aren't read; else the stamp is read from the file name, so files
    outside are listed but not kept.
    """
    df = spark.read.parquet(path)
    if "ym" not in df.columns:
        df = df.withColumn("ym", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)).where(F.col("ym") != "").withColumn("ym", F.col("ym").cast("int"))
    return df.where(F.col("ym").between(first, last))


def surface(grids: DataFrame, depth: str, axes: DataFrame) -> DataFrame:
    """The uppermost level of each grid, with the places of its regular axes. grids: lat_idx, lon_idx, depth, ...; axes: axis, idx, value (a few hundred rows)."""
    lat, lon = (F.broadcast(axes.where(F.col("axis") == a).select(F.col("idx").alias(f"{a}_idx"), F.col("value").alias(a))) for a in ("lat", "lon"))
    return grids.where(F.col(depth) == 0).join(lat, "lat_idx").join(lon, "lon_idx")


def first_of_month(files: DataFrame) -> DataFrame:
    """Of files (ym, path) the first path by order of each month."""
    return files.groupBy("ym").agg(F.min("path").alias("path"))


def coverage(files: DataFrame) -> DataFrame:
    """year, variable, months present and whether all are. files: variable, ym."""
    out = files.groupBy("variable", F.floor(F.col("ym") / 100).cast("int").alias("year")).agg(F.count_distinct(F.col("ym") % 100).alias("months"))
    return out.withColumn("complete", F.col("months") == 12)


def large_enough(df: DataFrame, least: int) -> DataFrame:
    """Rows of files of at least `least` bytes; smaller ones count as corrupt."""
    return df.where(F.col("_metadata.file_size") >= least)


def product_window(products: DataFrame, first: str, last: str) -> DataFrame:
    """Each product's dates within the wanted ones; products without any are dropped. products: product, t0, t1."""
    out = products.withColumn("t0", F.greatest("t0", F.lit(first).cast("date"))).withColumn("t1", F.least("t1", F.lit(last).cast("date")))
    return out.where("t0 <= t1")


def product(products: DataFrame, name: str) -> DataFrame:
    """The product's row; an unknown name raises ValueError."""
    row = products.where(F.col("product") == name)
    if row.isEmpty():
        raise ValueError(f"unknown product {name!r}")
    return row


def catalogue_pick(catalogue: DataFrame, by: list[str], grid_preference: Column) -> DataFrame:
    """One entry for each key: the preferred grid, then the first member by number, then the newest version."""
    number = F.regexp_extract("member", r"r(\d+)", 1).cast("int")
    o = Window.partitionBy(*by).orderBy(grid_preference, number, "member", F.desc("version"))
    return catalogue.withColumn("_k", F.row_number().over(o)).where("_k = 1").drop("_k")


def yearly_table(spark: SparkSession, path: str, missing: float = -99.0) -> DataFrame:
    """year, month, v of text lines YEAR and twelve values; other lines are skipped, values at or below `missing` are null."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) == 13).select(parts[0].try_cast("int").alias("year"), F.posexplode(F.slice(parts, 2, 12)).alias("k", "x"))
    v = F.col("x").try_cast("double")
    return rows.where("year IS NOT NULL").select("year", (F.col("k") + 1).alias("month"), F.when(v > missing, v).alias("v"))


def core_table(spark: SparkSession, path: str, header: str = "Depth") -> DataFrame:
    """depth, age_ka, v, year of a tab-separated archive file whose comment ends before the header line; lines of other shape are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith(header) & (F.size(parts) >= 3)).select(*[parts[i].try_cast("double").alias(n) for i, n in enumerate(("depth", "age_ka", "v"))])
    return rows.where("depth IS NOT NULL AND age_ka IS NOT NULL").withColumn("year", 1950 - 1000 * F.col("age_ka"))


def proxy_table(spark: SparkSession, path: str) -> DataFrame:
    """year, v of a CSV of two numeric columns: rows that aren't numbers and years below 0 are dropped."""
    rows = spark.read.csv(path, header=False).toDF("year", "v").select(F.col("year").try_cast("double").alias("year"), F.col("v").try_cast("double").alias("v"))
    return rows.where("year >= 0 AND v IS NOT NULL")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """tag and fields of one JSON document a file, both shapes; files that aren't JSON or have no verdict are left out. The tag is what follows the last underscore of p6_verdict_."""
    rows = spark.read.schema(VERDICT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    tag = F.regexp_extract(F.col("_metadata.file_name"), r"verdict_(.+)\.json$", 1)
    return rows.select(tag.alias("tag"), "*").where("verdict IS NOT NULL")


def corridor_documents(spark: SparkSession, path: str) -> DataFrame:
    """model, centre, q of result documents with parallel arrays; those without the arrays are left out."""
    schema = "model string, basin string, window_years int, pi_p95_threshold double, hist_Q array<double>, hist_centres array<int>, first_exit_year int"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where("hist_Q IS NOT NULL AND hist_centres IS NOT NULL AND model IS NOT NULL")
    flat = rows.select("model", F.col("pi_p95_threshold").alias("threshold"), F.explode(F.arrays_zip("hist_centres", "hist_Q")).alias("z"))
    return flat.select("model", "threshold", F.col("z.hist_centres").alias("centre"), F.nanvl(F.col("z.hist_Q"), F.lit(None)).alias("q"))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """file, member, start, q of log lines: an 'open' line names the member of the Q lines behind it, in each file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    named = lines.withColumn("open", F.expr(r"nullif(regexp_extract(line, 'open(?:ing|ed)? +(\\S+)', 1), '')"))
    o = Window.partitionBy("path").orderBy("n")
    rows = named.withColumn("member", F.last("open", True).over(o)).where(F.col("line").rlike(r"Q\s*="))
    return rows.where("member IS NOT NULL").select("file", "member", F.regexp_extract("line", r"(\d{4})\s*[-:]", 1).try_cast("int").alias("start"), F.regexp_extract("line", r"Q\s*=\s*([-+0-9.eE]+)", 1).try_cast("double").alias("q"))


def pixel_lookup(spark: SparkSession, rings: int) -> DataFrame:
    """pix, lat, lon of an equal-area sphere in `rings` steps of the ring scheme: 12 rings^2 pixels, each polar ring four longer than the one before."""
    n = rings
    p = spark.range(12 * n * n).withColumnRenamed("id", "pix")
    north = F.col("pix") < 2 * n * (n - 1)
    south = F.col("pix") >= 12 * n * n - 2 * n * (n - 1)
    q = F.when(south, 12 * n * n - 1 - F.col("pix")).otherwise(F.col("pix"))
    i = F.floor((F.sqrt(2 * (q + 1) - 1 + F.lit(1e-9)) + 1) / 2)
    i = F.when(2 * i * (i - 1) > q, i - 1).when(2 * (i + 1) * i <= q, i + 1).otherwise(i)
    j = q - 2 * i * (i - 1)
    zc, lc = 1 - i * i / (3.0 * n * n), 90.0 / i * (j + 0.5)
    k = F.col("pix") - 2 * n * (n - 1)
    ring = F.floor(k / (4 * n)) + n
    ze, le = (2.0 * n - ring) * 2 / (3.0 * n), 90.0 / n * (k % (4 * n) + F.when((ring - n) % 2 == 0, 0.5).otherwise(0.0))
    z = F.when(north, zc).when(south, -zc).otherwise(ze)
    lon = F.when(north, lc).when(south, 360 - lc).otherwise(le)
    return p.select("pix", F.degrees(F.asin(z)).alias("lat"), lon.alias("lon"))


def depth_bins(profiles: DataFrame, width: float) -> DataFrame:
    """month, bin, n, mean of float profiles (month, pressure, v)."""
    return profiles.where("pressure >= 0 AND v IS NOT NULL").groupBy("month", F.floor(F.col("pressure") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def worklist(targets: DataFrame, done: DataFrame, failed: DataFrame, now: Column, cool_hours: int = 6) -> DataFrame:
    """Targets without a result that haven't failed within the last hours. done: target; failed: target, failed_at."""
    recent = failed.where(F.col("failed_at") > now - F.make_dt_interval(hours=F.lit(cool_hours)))
    return targets.join(done, "target", "left_anti").join(recent, "target", "left_anti")


def write_bundle(rows: DataFrame, path: str) -> None:
    """Named arrays, a row a series, as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def read_bundle(spark: SparkSession, path: str, by: list[str], names: list[str]) -> DataFrame:
    """Rows of the bundle's arrays again, in long form: by, place and the named values. Missing names raise ValueError."""
    df = spark.read.parquet(path)
    if missing := [n for n in [*by, *names] if n not in df.columns]:
        raise ValueError(f"missing arrays: {missing}")
    return df.select(*by, F.posexplode(F.arrays_zip(*names)).alias("place", "_z")).select(*by, "place", *[F.col(f"_z.{n}").alias(n) for n in names])


def cleaned(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles as nulls, for JSON."""
    return df.select(*[F.when(~F.isnan(F.col(f.name)) & (F.abs(F.col(f.name)) != float("inf")), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def write_field(field: DataFrame, path: str) -> None:
    """A field as Parquet by field name and year or month stamp."""
    field.write.mode("overwrite").partitionBy(*[c for c in ("field", "year", "ym") if c in field.columns]).parquet(path)


def write_summary(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed order of columns with a header, missing values empty."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """JSON documents, published whole by the writer's commit."""
    cleaned(rows).write.mode("overwrite").json(path)


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One Markdown line a row (column `line`), missing values blank."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))
