"""Queries on the shapes of sources: prunings, picks, inventories, scrapes (2.A, 2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scalar
from tesserae.operators import spectral
from tesserae.queries import query
from tesserae.sources import files
from tesserae.sources.fields import nation_month, segment_month, ship_month, table
from tesserae.streaming import monitors


def order_files(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym"), F.format_string("dir%d/file_%06d", F.col("o_orderkey") % 7, F.col("o_orderkey")).alias("path"), F.col("o_orderstatus").alias("variable"), "o_totalprice", "o_orderdate")


YM = "fl AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS ym, printf('dir%d/file_%06d', o_orderkey % 7, o_orderkey) AS path, o_orderstatus AS variable, o_totalprice FROM orders)"


@query("a1_stamped_scan", "ym n", "v", ctes=YM, sql="SELECT ym, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM fl WHERE ym BETWEEN 199601 AND 199812 GROUP BY ym", places=2)
def _(spark, d):
    """Monthly grids are written by their stamps, then the reader takes the months asked for."""
    path = files.scratch(spark, "grids")
    files.write_field(order_files(spark, d).select("ym", "path", "o_totalprice"), path)
    return files.monthly_grids(spark, path, 199601, 199812).groupBy("ym").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))


@query("a2_surface_level", "lat_idx lon_idx n", "lat lon v", ctes="gr AS (SELECT l_suppkey % 20 AS lat_idx, l_partkey % 30 AS lon_idx, l_quantity AS v FROM lineitem WHERE l_linenumber = 1)", sql="SELECT lat_idx, lon_idx, -9.5 + lat_idx AS lat, 100.25 + 0.5 * lon_idx AS lon, count(*) AS n, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM gr WHERE -9.5 + lat_idx <= 0 GROUP BY ALL", places=2)
def _(spark, d):
    """Level 0 of grids on regular axes, which give each cell its place, within a basin (south of the line)."""
    lat = spark.range(20).select(F.lit("lat").alias("axis"), F.col("id").alias("idx"), (F.col("id") - 9.5).alias("value"))
    axes = lat.unionByName(spark.range(30).select(F.lit("lon").alias("axis"), F.col("id").alias("idx"), (100.25 + 0.5 * F.col("id")).alias("value")))
    grids = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("lat_idx"), (F.col("l_partkey") % 30).alias("lon_idx"), (F.col("l_linenumber") - 1).alias("depth"), F.col("l_quantity").alias("v"))
    rows = files.surface(grids, "depth", axes).where(scalar.in_box(F.col("lat"), F.col("lon"), -10.0, 0.0, 100.0, 120.0))
    return rows.groupBy("lat_idx", "lon_idx", "lat", "lon").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(18,2)")).alias("v"))


@query("a3_first_file_of_month", "ym", "", "path", ctes=YM, sql="SELECT ym, min(path) AS path FROM fl GROUP BY ym")
def _(spark, d):
    return files.first_of_month(order_files(spark, d))


@query("a4_product_window", "", "", "product t0 t1", sql="SELECT n_name AS product, greatest(min(o_orderdate)::DATE, DATE '1996-03-01') AS t0, least(max(o_orderdate)::DATE, DATE '1999-12-31') AS t1 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def _(spark, d):
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    span = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("product")).agg(F.min("o_orderdate").cast("date").alias("t0"), F.max("o_orderdate").cast("date").alias("t1"))
    return files.product_window(span, "1996-03-01", "1999-12-31")


@query("a5_series_slice", "n", "v", sql="SELECT count(*) AS n, avg(value) AS v FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'view' AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    return e.agg(F.count("*").alias("n"), F.avg("value").alias("v"))


@query("a6_coverage", "year months", "", "variable complete", ctes=YM, sql="SELECT variable, ym // 100 AS year, count(DISTINCT ym % 100) AS months, count(DISTINCT ym % 100) = 12 AS complete FROM fl GROUP BY ALL")
def _(spark, d):
    return files.coverage(order_files(spark, d))


@query("a7_catalogue_pick", "version", "", "model member", ctes="ca AS (SELECT p_brand AS model, printf('r%di1', p_size) AS member, p_size AS num, p_type AS grid, p_partkey AS version FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN grid = 'ECONOMY' THEN 0 ELSE 1 END, num, member, version DESC) AS k FROM ca)", sql="SELECT model, member, version FROM k WHERE k = 1")
def _(spark, d):
    ca = table(spark, d, "part").select(F.col("p_brand").alias("model"), F.format_string("r%di1", "p_size").alias("member"), F.col("p_type").alias("grid"), F.col("p_partkey").alias("version"))
    return files.catalogue_pick(ca, ["model"], F.when(F.col("grid") == "ECONOMY", 0).otherwise(1))


@query("a11_core_table", "year n", "age v", views="p", sql="SELECT year, count(*) AS n, avg(t / 100.0) AS age, avg(x) AS v FROM p GROUP BY year")
def _(spark, d):
    """A core a year, each written as an archive file, comment and header first; then all are read."""
    path = files.scratch(spark, "core")
    line = F.concat_ws("\t", F.concat("year", F.lit("."), "month"), (F.col("t") / 100.0).cast("string"), F.col("x").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("t", line.alias("line")))), lambda x: x["line"])
    head = "/* DATA DESCRIPTION:\nAuthor(s):\tsomeone\tin 1999\n*/\nDepth sed [m]\tAge [ka BP]\tSS avg [um]\n"
    cores = ship_month(spark, d).groupBy("year").agg(lines.alias("lines")).select(F.concat(F.lit(head), F.array_join("lines", "\n")).alias("value"), F.col("year").alias("core"))
    cores.write.partitionBy("core").text(path)
    return files.core_table(spark, path).groupBy(F.floor("depth").alias("year")).agg(F.count("*").alias("n"), F.avg("age_ka").alias("age"), F.avg("v").alias("v"))


@query("a12_yearly_table", "year month", "v", views="p", sql="SELECT year, month, CASE WHEN y > 0 THEN y END AS v FROM p WHERE year IN (SELECT year FROM p GROUP BY year HAVING count(*) = 12)")
def _(spark, d):
    path = files.scratch(spark, "yearly")
    years = ship_month(spark, d).groupBy("year").agg(F.array_sort(F.collect_list(F.struct("month", "y"))).alias("m"))
    lines = years.select(F.concat_ws("  ", F.col("year").cast("string"), F.array_join(F.transform("m", lambda x: x["y"].cast("string")), " ")).alias("value"))
    lines.unionByName(spark.createDataFrame([("1948 2026",), ("monthly means of a made index",), ("-99.99",)], "value string")).write.text(path)
    return files.yearly_table(spark, path, 0.0)


@query("a13_proxy_table", "year", "v", views="p", sql="SELECT year, avg(z) AS v FROM p GROUP BY year")
def _(spark, d):
    path = files.scratch(spark, "proxy")
    rows = ship_month(spark, d).select(F.col("year").cast("string").alias("year"), F.col("z").cast("string").alias("v"))
    rows.unionByName(spark.createDataFrame([("year", "index"), ("-3", "1.0"), ("1999", "n/a")], "year string, v string")).write.csv(path)
    return files.proxy_table(spark, path).groupBy("year").agg(F.avg("v").alias("v"))


@query("a14_result_documents", "centre", "q threshold", "model", views="s", ctes="y AS (SELECT model, year, avg(v) AS q FROM s GROUP BY ALL)", sql="SELECT model, year AS centre, q, max(q) OVER (PARTITION BY model) AS threshold FROM y")
def _(spark, d):
    """A JSON document a model, in a folder of its own, read with its parallel arrays side by side."""
    path = files.scratch(spark, "documents")
    years = segment_month(spark, d).groupBy("model", "year").agg(F.avg("v").alias("q"))
    docs = years.groupBy("model").agg(F.max("q").alias("pi_p95_threshold"), F.array_sort(F.collect_list(F.struct("year", "q"))).alias("a"))
    docs = docs.select("model", F.col("model").alias("of"), "pi_p95_threshold", F.transform("a", lambda x: x["year"]).alias("hist_centres"), F.transform("a", lambda x: x["q"]).alias("hist_Q"))
    files.cleaned(docs).write.partitionBy("of").json(path)
    return files.corridor_documents(spark, path)


@query("a15_log_scrape", "start", "q", "member", views="f", sql="SELECT n_name AS member, year AS start, avg(v) AS q FROM f JOIN nation ON cell = n_nationkey GROUP BY ALL")
def _(spark, d):
    """A log a nation, opened by its name and followed by a line a year; then the scrape."""
    path = files.scratch(spark, "logs")
    years = nation_month(spark, d).groupBy("cell", "year").agg(F.avg("v").alias("q")).join(table(spark, d, "nation"), F.col("cell") == F.col("n_nationkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("year", "q"))), lambda x: F.concat_ws("", F.lit("["), x["year"].cast("string"), F.lit("-: ] Q = "), x["q"].cast("string"), F.lit(" after 28 s")))
    logs = years.groupBy("n_name").agg(lines.alias("l")).select(F.concat(F.lit("run begins\nopening "), "n_name", F.lit("\n"), F.array_join("l", "\n")).alias("value"), F.col("n_name").alias("of"))
    logs.write.partitionBy("of").text(path)
    return files.run_log(spark, path)


RING = """n AS (SELECT 8 AS n), px AS (SELECT n, unnest(range(0, 12 * 64)) AS pix FROM n), z0 AS (SELECT *, pix < 2 * n * (n - 1) AS north, pix >= 12 * n * n - 2 * n * (n - 1) AS south FROM px),
z1 AS (SELECT *, CASE WHEN south THEN 12 * n * n - 1 - pix ELSE pix END AS q FROM z0), z2 AS (SELECT *, CASE WHEN north OR south THEN (SELECT max(i) FROM range(1, 9) t(i) WHERE 2 * i * (i - 1) <= q) END AS i FROM z1),
z3 AS (SELECT *, q - 2 * i * (i - 1) AS j, pix - 2 * n * (n - 1) AS k FROM z2)"""


@query("a16_equal_area_pixels", "pix n", "lat lon v", ctes=RING + ", cu AS (SELECT c_custkey % 768 AS pix, count(*) AS n, avg(c_acctbal) AS v FROM customer GROUP BY 1)", sql="SELECT pix, cu.n, v, degrees(asin(CASE WHEN north THEN 1 - i * i / (3.0 * z3.n * z3.n) WHEN south THEN i * i / (3.0 * z3.n * z3.n) - 1 ELSE (2.0 * z3.n - (k // (4 * z3.n) + z3.n)) * 2 / (3.0 * z3.n) END)) AS lat, CASE WHEN north THEN 90.0 / i * (j + 0.5) WHEN south THEN 360 - 90.0 / i * (j + 0.5) ELSE 90.0 / z3.n * (k % (4 * z3.n) + CASE WHEN (k // (4 * z3.n)) % 2 = 0 THEN 0.5 ELSE 0.0 END) END AS lon FROM z3 JOIN cu USING (pix)")
def _(spark, d):
    """Values by pixel, as models on the equal-area sphere give them, get their pixels' places."""
    values = table(spark, d, "customer").groupBy((F.col("c_custkey") % 768).alias("pix")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("v"))
    return values.join(files.pixel_lookup(spark, 8), "pix")


@query("a17_large_files", "n", "v", sql="SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders", places=2)
def _(spark, d):
    """Files with rows beside one without: the small one is taken for corrupt."""
    path = files.scratch(spark, "sized")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    o.write.parquet(path)
    o.limit(0).write.mode("append").parquet(path)
    rows = files.large_enough(spark.read.parquet(path).select("*", "_metadata"), 1_500)
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))


@query("a18_depth_bins", "month bin n", "mean", sql="SELECT month(l_shipdate) AS month, floor(l_quantity / 10) AS bin, count(*) AS n, avg(l_discount) AS mean FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("pressure"), F.col("l_discount").alias("v"))
    return files.depth_bins(rows, 10.0)


@query("a23_worklist", "n", "", "status", sql="SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderdate <= TIMESTAMP '2001-07-01' GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("target"), "o_orderstatus", "o_orderdate")
    failed = o.select("target", F.col("o_orderdate").alias("failed_at"))
    left = files.worklist(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target")).distinct(), failed, F.lit("2001-07-01 06:00:00").cast("timestamp_ntz"))
    return left.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("h1_regex_scan", "n", "", "domain", sql="SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "https?://([^/]+)", 1).alias("domain")).agg(F.count("*").alias("n"))


@query("h13_json_props", "k n", "v", sql="SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, avg(value) AS v FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("v"))


@query("a19_field_sink", "cell t", "v", views="f", sql="SELECT cell, t, v FROM f")
def _(spark, d):
    path = files.scratch(spark, "field")
    files.write_field(nation_month(spark, d).withColumn("field", F.lit("v")), path)
    return spark.read.parquet(path)


@query("a20_document_sink", "t", "v", "model", views="s", sql="SELECT model, t, CASE WHEN v > 45 THEN v END AS v FROM s")
def _(spark, d):
    """Values that JSON has no words for become nulls."""
    path = files.scratch(spark, "json")
    files.write_documents(segment_month(spark, d).select("model", "t", F.when(F.col("v") > 45, F.col("v")).otherwise(float("nan")).alias("v")), path)
    return spark.read.schema("model string, t long, v double").json(path)


@query("a21_summary_sink", "n", "v", "model line", views="s", ctes="m AS (SELECT model, count(*) AS n, round(avg(v), 3) AS v FROM s GROUP BY model)", sql="SELECT model, n, v, '| ' || model || ' | ' || n || ' |' AS line FROM m")
def _(spark, d):
    path = files.scratch(spark, "summary")
    m = segment_month(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("v"))
    files.write_summary(m, path, ["model", "n", "v"])
    back = spark.read.option("header", True).schema("model string, n long, v double").csv(path)
    lines = files.markdown(back, ["model", "n"])
    return back.join(lines.withColumn("model", F.regexp_extract("line", r"\| (\S+) \|", 1)), "model")


@query("a22_array_bundle", "place ts", "values", "model", views="s", sql='SELECT model, row_number() OVER (PARTITION BY model ORDER BY t) - 1 AS place, t AS ts, v AS "values" FROM s')
def _(spark, d):
    path = files.scratch(spark, "bundle")
    files.write_bundle(spectral.as_rows(segment_month(spark, d), ["model"]), path)
    return files.read_bundle(spark, path, ["model"], ["ts", "values"])


def parts(rows, size: int = 1_000_000) -> int:
    """Files of about `size` rows, three at least, for a stream to take up one by one."""
    return max(3, -(-rows.count() // size))


def event_files(spark, d) -> str:
    """The events in files by time."""
    path, events = files.scratch(spark, "events"), table(spark, d, "events")
    events.repartitionByRange(parts(events), "ts").write.parquet(path)
    return path


@query("p1_polled_worklist", "n", "", "status", sql="SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    """Targets arrive as files; each batch's results are written by its number, so that a repeated batch replaces them."""
    path, out = files.scratch(spark, "targets"), files.scratch(spark, "results")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_orderstatus").alias("status"))
    o.repartition(parts(o), "target").write.parquet(path)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(path)
    work = lambda batch, n: batch.groupBy("status").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={n}")
    monitors.poll(stream, work, files.scratch(spark, "poll")).awaitTermination()
    return spark.read.parquet(out).groupBy("status").agg(F.sum("n").alias("n"))


@query("p2_status_refresh", "n last", "", "model", sql="SELECT event_type AS model, count(*) AS n, max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)) AS last FROM events GROUP BY event_type")
def _(spark, d):
    """A status table that each new file of events renews."""
    hour = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")

    def update(old, batch):
        new = batch.select(F.col("event_type").alias("model"), F.lit(1).cast("long").alias("n"), hour.cast("long").alias("last"))
        both = new if old is None else old.select("model", "n", "last").unionByName(new)
        return both.groupBy("model").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    path = files.scratch(spark, "status")
    monitors.refreshed(monitors.events_stream(spark, event_files(spark, d)), update, path, files.scratch(spark, "refresh")).awaitTermination()
    return monitors.newest(spark, path)


@query("p3_monthly_accumulators", "n", "total", "month", sql="SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n, sum(value) AS total FROM events GROUP BY 1", places=2)
def _(spark, d):
    """The running number and sum of each month, as the stream leaves them."""
    path = files.scratch(spark, "months")
    sums = monitors.monthly(monitors.events_stream(spark, event_files(spark, d)))
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/v={n}")
    sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", files.scratch(spark, "sums")).trigger(availableNow=True).start().awaitTermination()
    return monitors.newest(spark, path).select(F.date_format("month", "yyyy-MM").alias("month"), "n", "total")
