"""Queries on archives: cores and workbooks are packed from the provided tables by tasks, then read back (2.A)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tesserae.queries import query
from tesserae.sources import archives, files
from tesserae.sources.fields import nation_month, segment_month

COLUMNS = "array<struct<number:int,variableName:string,units:string,calibration:struct<calibrationDOI:string>>>"


def columns(*named: tuple[str, str, str | None]) -> Column:
    """Metadata of a table's columns: name, units, calibration."""
    return F.array(*[F.struct(F.lit(i + 1).alias("number"), F.lit(n).alias("variableName"), F.lit(u).alias("units"), F.struct(F.lit(c).alias("calibrationDOI")).alias("calibration")) for i, (n, u, c) in enumerate(named)]).cast(COLUMNS)


def tables(*named: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("filename"), c.alias("columns")) for f, c in named])


DEPTH, AGE, LAST = ("depth", "cm", None), ("age", "yr ka", None), ("temperature", "degC", None)
FIRST_ALKENONE, OTHER_ALKENONE = archives.ALKENONE_CALIBRATIONS[:2]
FIRST_MAGNESIUM = archives.MAGNESIUM_CALIBRATIONS[0]


def kinds() -> list[Column]:
    """Five kinds of core: the preferred of two calibrations; magnesium by name; no age in the first table; too few rows in it; its file missing."""
    return [
        tables(("long.csv", columns(DEPTH, AGE, ("UK37", "index", None), ("temperature", "degC", OTHER_ALKENONE), ("Temperature", "degc", FIRST_ALKENONE)))),
        tables(("long.csv", columns(DEPTH, AGE, ("Mg/Ca", "mmol/mol", None), ("temperature", "degC", "10.1/other"), ("temperature", "K", FIRST_MAGNESIUM)))),
        tables(("long.csv", columns(DEPTH, ("age", "yr", None), ("x", "", None), LAST, LAST)), ("long.csv", columns(DEPTH, AGE, ("x", "", None), ("temperature", "degC", FIRST_MAGNESIUM), LAST))),
        tables(("short.csv", columns(DEPTH, AGE, ("x", "", None), LAST, LAST)), ("long.csv", columns(DEPTH, AGE, ("x", "", None), ("temperature", "degC", "10.1/other"), LAST))),
        tables(("missing.csv", columns(DEPTH, AGE, ("x", "", None), LAST, LAST)), ("long.csv", columns(DEPTH, AGE, ("C37alkenone", "", None), LAST, ("mg_ca", "", None)))),
    ]


@query(
    "a9_core_archives", "n", "lat lon age v", "site modality calibration", views="f",
    sql=f"""SELECT 'core' || cell AS site, CASE cell % 5 WHEN 0 THEN 'alkenone' WHEN 1 THEN 'mgca' WHEN 2 THEN 'mgca' WHEN 3 THEN 'unknown' ELSE 'alkenone' END AS modality,
  CASE cell % 5 WHEN 0 THEN '{FIRST_ALKENONE}' WHEN 1 THEN '10.1/other' WHEN 2 THEN '{FIRST_MAGNESIUM}' WHEN 3 THEN '10.1/other' ELSE 'unknown' END AS calibration,
  lat, lon, count(*) AS n, avg(t / 10.0) AS age, avg(CASE WHEN cell % 5 = 0 THEN v + 1 ELSE v END) AS v FROM f WHERE lat <= 22 GROUP BY cell, lat, lon HAVING count(*) >= 3""",
)
def _(spark, d):
    """A core a nation, months as ages, months without orders as NaN; the five kinds of tables in turn; cores within a box."""
    path = files.scratch(spark, "cores")
    months = nation_month(spark, d)
    span = months.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence("a", "b")).alias("t"))
    cells = months.select("cell", "lat", "lon").distinct()
    every = cells.crossJoin(F.broadcast(span)).join(months.select("cell", "t", "v"), ["cell", "t"], "left")  # the months of the calendar
    text = lambda c: F.coalesce(c.cast("string"), F.lit("NaN"))
    line = F.concat_ws(",", (F.col("t") * 2).cast("string"), (F.col("t") / 10.0).cast("string"), text(F.col("v") * 10), text(F.col("v")), text(F.col("v") + 1))
    lines = every.groupBy("cell", "lat", "lon").agg(F.array_sort(F.collect_list(F.struct("t", line.alias("line"), F.col("v").isNotNull().alias("known")))).alias("lines"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["line"]), "\n")
    kind = F.element_at(F.array(*kinds()), (F.col("cell") % 5 + 1).cast("int"))
    metadata = F.to_json(F.struct(F.concat(F.lit("core"), "cell").alias("dataSetName"), F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry")).alias("geo"), F.array(F.struct(kind.alias("measurementTable"))).alias("paleoData")))
    few = F.slice(F.filter("lines", lambda x: x["known"]), 1, 2)
    parts = F.array(*[F.struct(F.lit(m).alias("member"), c.alias("content")) for m, c in ((archives.METADATA, metadata), (f"{archives.DATA}long.csv", joined(F.col("lines"))), (f"{archives.DATA}short.csv", joined(few)))])
    archives.write_archives(lines.select(F.concat(F.lit("core"), "cell", F.lit(".lpd")).alias("archive"), F.explode(parts).alias("p")).select("archive", "p.member", "p.content"), path)
    read = archives.cores(spark, path, (-90.0, 22.0, -180.0, 180.0))
    return read.groupBy("site", "modality", "calibration", "lat", "lon").agg(F.count("*").alias("n"), F.avg("age_ka").alias("age"), F.avg("v").alias("v"))


@query(
    "a10_spreadsheet", "", "year v", "file sheet core", views="s",
    sql="""SELECT 'proxies ' || model || '.xlsx' AS file, 'Sheet <' || model || '>' AS sheet, 'first' AS core, 1995 + t / 12.0 AS year, v FROM s
  UNION ALL SELECT 'proxies ' || model || '.xlsx', 'Second', 'first', 1995 + t / 12.0, 2 * v FROM s UNION ALL SELECT 'proxies ' || model || '.xlsx', 'Second', 'second', 300.0 - 10 * t, -v FROM s WHERE 300 - 10 * t >= 0""",
)
def _(spark, d):
    """A workbook a segment: a sheet of one core, and one of two beside each other, under headers in shared strings and a row of units."""
    path = files.scratch(spark, "sheets")
    place = F.row_number().over(Window.partitionBy("model").orderBy("t")) + 2
    rows = segment_month(spark, d).withColumn("row", place.cast("string"))
    cell = lambda letter, row, kind, text: F.struct(F.concat(F.lit(letter), row).alias("ref"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    shared = lambda letter, i: cell(letter, F.lit("1"), "s", F.lit(i))
    year, later = 1995 + F.col("t") / 12.0, 300.0 - 10 * F.col("t")
    of_row = lambda *c: F.array_sort(F.collect_list(F.struct("t", F.array(*c).alias("c"))))
    row = F.col("row")
    made = rows.groupBy("model").agg(
        of_row(cell("A", row, "n", year), cell("B", row, "n", F.col("v"))).alias("one"),
        of_row(cell("A", row, "n", year), cell("B", row, "n", 2 * F.col("v")), cell("G", row, "n", later), cell("H", row, "n", -F.col("v"))).alias("two"),
    )
    units = F.array(cell("A", F.lit("2"), "str", F.lit("a <year>")), cell("B", F.lit("2"), "str", F.lit("K & more")))
    body = lambda name, *head: archives.sheet_xml(F.concat(F.array(F.array(*head), units), F.transform(name, lambda x: x["c"])))
    sheets = made.select(F.concat(F.lit("proxies "), "model", F.lit(".xlsx")).alias("archive"), F.explode(F.array(
        F.struct(F.concat(F.lit("Sheet &lt;"), "model", F.lit("&gt;")).alias("name"), body("one", shared("A", 0), shared("B", 1)).alias("xml")),
        F.struct(F.lit("Second").alias("name"), body("two", shared("A", 0), shared("B", 1), shared("G", 0), shared("H", 2)).alias("xml")),
    )).alias("s")).select("archive", "s.name", "s.xml")
    archives.write_archives(archives.workbook(sheets, ["year", "value", "d18O &amp; others"]), path)
    values = archives.cells(spark, path)
    first = archives.sheet_series(values).withColumn("core", F.lit("first"))
    second = archives.sheet_series(values.where("sheet = 'Second'"), 6, 7).withColumn("core", F.lit("second"))
    named = F.url_decode(F.regexp_extract("path", "([^/]+)$", 1))
    return first.unionByName(second).select(named.alias("file"), "sheet", "core", "year", "v")
