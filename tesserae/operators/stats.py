"""Statistical tests, resampling and regressions as aggregates.

Replicates are rows: each draw is a hash of (replicate, position), so that resampling is one
job, the same on every cluster and in every engine that has the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import safe_corr
from tesserae.operators.trends import pair_trends
from tesserae.sources.files import kept


def pseudo_draw(replicate: Column, position: Column, n: Column, seed: int = 7) -> Column:
    """An integer in [0, n): a linear congruential mix of replicate and position in 64-bit arithmetic."""
    x = (replicate * 7919 + position * 104729 + seed * 15485863) % 2147483647
    x = (x * 48271) % 2147483647
    x = (x * 69621 + replicate) % 2147483647
    return x % n


def mann_kendall(series: DataFrame, by: list[str]) -> DataFrame:
    """s, its tie-corrected variance, z with continuity correction, and Sen's slope (the median pairwise one)."""
    rows = series.where("v IS NOT NULL")
    pair = pair_trends(rows, by).select(*by, F.col("rises").cast("double").alias("s"), "sen")
    ties = rows.groupBy(*by, "v").agg(F.count("*").alias("_g")).groupBy(*by).agg(F.sum("_g").alias("n"), F.sum(F.col("_g") * (F.col("_g") - 1) * (2 * F.col("_g") + 5)).alias("tie"))
    out = pair.join(ties, by)
    out = out.withColumn("var", (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("tie")) / 18.0)
    z = F.when(F.col("var") > 0, F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var")).otherwise(0.0))
    return out.select(*by, "n", "s", "var", z.alias("z"), "sen")


def kendall_tau(series: DataFrame, by: list[str]) -> DataFrame:
    """Kendall's tau-b of v against t."""
    p = pair_trends(series, by)
    return p.select(*by, F.try_divide(F.col("rises"), F.sqrt(F.col("every").cast("double") * F.col("differ"))).alias("tau"))


def sliding_sen(series: DataFrame, by: list[str], width: int, stride: int, least: int = 3) -> DataFrame:
    """Sen's slope in each window of `width` that starts on the stride and holds at least `least` points."""
    last = F.floor(F.col("t") / stride).cast("int") * stride
    first = F.ceil((F.col("t") - width) / stride).cast("int") * stride
    rows = series.where("v IS NOT NULL").withColumn("start", F.explode(F.sequence(first, last, F.lit(stride))))
    counts = rows.groupBy(*by, "start").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return pair_trends(rows, [*by, "start"]).select(*by, "start", F.col("sen").alias("slope")).join(counts, [*by, "start"])


def fdr(tests: DataFrame, p: str = "p", by: list[str] = ()) -> DataFrame:
    """Adds q: Benjamini-Hochberg adjusted p-values, of all rows or of each group of `by` (one family of tests a task); null p stays null and isn't counted."""
    if by:
        o = Window.partitionBy(*by, F.col(p).isNull()).orderBy(p)
        raw = F.count(p).over(Window.partitionBy(*by)) * F.col(p) / F.row_number().over(o)
        out = tests.withColumn("_raw", F.when(F.col(p).isNotNull(), raw))
        back = Window.partitionBy(*by, F.col(p).isNull()).orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing)
        return out.withColumn("q", F.least(F.min("_raw").over(back), F.when(F.col(p).isNotNull(), F.lit(1.0)))).drop("_raw")
    known = tests.where(F.col(p).isNotNull())
    n = known.count()
    ranked = ranked_rows(known, [p, *[c for c in tests.columns if c != p]], keep=True).withColumn("_raw", n * F.col(p) / F.col("rank"))
    least = {r["_part"]: r.m for r in ranked.groupBy("_part").agg(F.min("_raw").alias("m")).collect()}  # a row a partition
    later = {k: min((m for q, m in least.items() if q > k), default=1.0) for k in least} or {0: 1.0}
    behind = F.create_map(*[F.lit(x) for pair in later.items() for x in pair])[F.col("_part")]
    inside = F.min("_raw").over(Window.partitionBy("_part").orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = ranked.withColumn("q", F.least(inside, behind, F.lit(1.0))).drop("_raw", "_part", "rank")
    return out.unionByName(tests.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def average_rank(v: Column, by: list[str], order: list) -> Column:
    """Ranks of equal values share their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(*order)) + (F.count("*").over(Window.partitionBy(*by, v)) - 1) / 2


def mann_whitney(values: DataFrame, group: str, one) -> DataFrame:
    """U of the group `one` against the others, and both sizes. Equal values share their mean rank; ranks run over ranges of values, not in one task."""
    ranked = ranked_rows(values.where("v IS NOT NULL").select("v", (F.col(group) == one).alias("_one")), ["v", "_one"])
    by = ranked.groupBy("v").agg(F.avg("rank").alias("_r"), F.count_if("_one").alias("_a"), F.count_if(~F.col("_one")).alias("_b"))
    n = F.coalesce(F.sum("_a"), F.lit(0))
    return by.agg(n.alias("n1"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n2"), (F.sum(F.col("_r") * F.col("_a")) - n * (n + 1) / 2).alias("u"))


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    rows = pairs.where("x IS NOT NULL AND y IS NOT NULL")
    ranked = rows.withColumn("_x", average_rank(F.col("x"), by, ["x"])).withColumn("_y", average_rank(F.col("y"), by, ["y"]))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(F.col("_x"), F.col("_y")).alias("rho"))


def resampled(spark: SparkSession, series: DataFrame, replicates: int, block: int, wrap: bool = True, seed: int = 7) -> DataFrame:
    """Block bootstrap: (replicate, place, and the columns of the row drawn). series: i = 0 .. n - 1, ...

    Circular blocks wrap around and are cut to n places; moving blocks don't wrap, and there are floor(n / block) of them.
    """
    n = series.agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block) if wrap else F.floor(F.col("n") / block)
    starts = F.col("n") if wrap else F.col("n") - block + 1
    r = spark.range(replicates).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(n))
    rows = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))).withColumn("start", pseudo_draw(F.col("replicate"), F.col("k"), starts, seed))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("place", F.col("k") * block + F.col("o")).where("place < n")
    rows = rows.withColumn("i", F.pmod(F.col("start") + F.col("o"), F.col("n")))
    return rows.select("replicate", "place", "i").join(series, "i")


def interval(replicates: DataFrame, v: str, by: list[str] = (), level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return replicates.groupBy(*by).agg(F.percentile(v, a).alias("low"), F.percentile(v, 1 - a).alias("high"), F.percentile(v, 0.5).alias("median"))


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Confidence limits of a correlation by Fisher's z with n effective samples; null for n of 3 and less."""
    spread = F.when(n > 3, z / F.sqrt(n - 3))
    return F.tanh(F.atanh(r) - spread), F.tanh(F.atanh(r) + spread)


def block_bootstrap(spark: SparkSession, cells: DataFrame, replicates: int, by: list[str] = (), seed: int = 7) -> DataFrame:
    """by, n_cells, n, rho_cells, rho, low, high, boot_low, boot_high of the correlation of x and y over spatial blocks.

    The unit is the block's mean: rho and its interval by Fisher's z with as many samples as blocks; and percentiles of the correlation of blocks
    drawn with replacement, in the scale of z. Fewer than ten cells or four blocks give nulls. cells: by, block, x, y.
    """
    by = list(by)
    rows = cells.where("x IS NOT NULL AND y IS NOT NULL")
    means = rows.groupBy(*by, "block").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    one = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # one basin's blocks
    means = means.withColumn("n", F.count("*").over(one)).withColumn("i", (F.row_number().over(one.orderBy("block")) - 1).cast("long"))
    head = rows.groupBy(*by).agg(F.count("*").alias("n_cells"), safe_corr(F.col("x"), F.col("y")).alias("rho_cells"))
    whole = means.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("rho"))
    low, high = fisher_interval(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("rho"))), F.col("n"))
    draws = whole.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    drawn = draws.withColumn("i", pseudo_draw(F.col("replicate"), F.col("k"), F.col("n"), seed)).drop("n").join(means.drop("n"), [*by, "i"])
    z = drawn.groupBy(*by, "replicate").agg(safe_corr(F.col("x"), F.col("y")).alias("c")).withColumn("z", F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("c")))))
    boot = z.groupBy(*by).agg(F.tanh(F.percentile("z", 0.025)).alias("boot_low"), F.tanh(F.percentile("z", 0.975)).alias("boot_high"))
    join = lambda a, b: a.join(b, by) if by else a.crossJoin(F.broadcast(b))  # noqa: E731  one row beside one
    out = join(join(head, whole), boot)
    enough = (F.col("n_cells") >= 10) & (F.col("n") >= 4)
    when = lambda c, name: F.when(enough, c).alias(name)
    return out.select(*by, "n_cells", "n", "rho_cells", "rho", when(low, "low"), when(high, "high"), when(F.col("boot_low"), "boot_low"), when(F.col("boot_high"), "boot_high"))


def block_permutation(cells: DataFrame, replicates: int, by: list[str] = (), seed: int = 7) -> DataFrame:
    """by, n_cells, n_blocks, rho (over cells), p: share of shuffles of the blocks' means of x with as large a correlation, at least 1 / replicates.

    A shuffle is the order of a draw from (replicate, block), so replicates are rows and no basin is one. Fewer than ten cells or four blocks give
    nulls. cells: by, block, x, y.
    """
    by = list(by)
    key = by or ["_all"]
    rows = cells.where("x IS NOT NULL AND y IS NOT NULL")
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    rows = kept(rows.select(*key, "block", "x", "y"))  # what the cells come from is worked out once
    means = rows.groupBy(*key, "block").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    means = means.withColumn("i", (F.row_number().over(Window.partitionBy(*key).orderBy("block")) - 1).cast("long"))
    draws = means.select(*key, "i", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("replicate"))
    draw = pseudo_draw(F.col("replicate"), F.col("i"), F.lit(2147483647), seed)
    shuffled = draws.withColumn("place", (F.row_number().over(Window.partitionBy(*key, "replicate").orderBy(draw, "i")) - 1).cast("long"))
    null = shuffled.select(*key, "replicate", "x", "place").join(means.select(*key, F.col("i").alias("place"), "y"), [*key, "place"]).groupBy(*key, "replicate").agg(safe_corr(F.col("x"), F.col("y")).alias("null"))
    seen = means.groupBy(*key).agg(F.count("*").alias("n_blocks"), safe_corr(F.col("x"), F.col("y")).alias("seen"))
    p = null.join(seen, key).groupBy(*key).agg(F.when(F.count("null") > 0, F.greatest(F.avg((F.abs("null") >= F.abs("seen") - 1e-12).cast("double")), F.lit(1 / replicates))).alias("p"))
    head = rows.groupBy(*key).agg(F.count("*").alias("n_cells"), safe_corr(F.col("x"), F.col("y")).alias("rho"))
    enough = (F.col("n_cells") >= 10) & (F.col("n_blocks") >= 4)
    return head.join(seen, key).join(p, key, "left").select(*by, "n_cells", "n_blocks", F.when(enough, F.col("rho")).alias("rho"), F.when(enough, F.col("p")).alias("p"))


def block_p(spark: SparkSession, rows: DataFrame, by: list[str], predictor: DataFrame, replicates: int, block: int) -> DataFrame:
    """by, n, slope of y on x, and p: the share of circular block resamples of the predictor with a slope as large, one added to both counts.

    rows: by, t, y; predictor: t, x, one series, which is what is resampled, so every group meets the same draws.
    """
    x = predictor.withColumn("i", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("t")) - 1).cast("long"))  # one series
    places = rows.join(x.select("t", "x", F.col("i").alias("place")), "t").where("y IS NOT NULL AND x IS NOT NULL")
    seen = places.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"))
    drawn = resampled(spark, x.select("i", F.col("x").alias("xr")), replicates, block).select("replicate", "place", "xr")
    null = places.select(*by, "place", "y").join(drawn, "place").groupBy(*by, "replicate").agg(F.regr_slope("y", "xr").alias("b"))
    hits = null.join(seen, by).groupBy(*by, "n", "slope").agg(((1 + F.count_if(F.abs("b") >= F.abs("slope") - 1e-12)) / F.lit(replicates + 1.0)).alias("p"))
    return hits


def effective_n(n: Column, r1: Column, r2: Column) -> Column:
    """n (1 - r1 r2) / (1 + r1 r2), autocorrelations clamped to 0.95, at least 5."""
    clamp = lambda c: F.greatest(F.lit(-0.95), F.least(F.lit(0.95), c))
    p = clamp(r1) * clamp(r2)
    return F.greatest(F.lit(5.0), n * (1 - p) / (1 + p))


def partial_correlation(rows: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of x and y once z has been regressed out of both, from the three pairwise ones."""
    c = rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("xy"), safe_corr(F.col("x"), F.col("z")).alias("xz"), safe_corr(F.col("y"), F.col("z")).alias("yz"))
    return c.select(*by, "n", ((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))).alias("r"))


def residual(rows: DataFrame, by: list[str], y: str, z: str, out: str) -> DataFrame:
    """Adds what least squares on z leave of y."""
    w = Window.partitionBy(*by)
    b = F.covar_pop(y, z).over(w) / F.when(F.var_pop(z).over(w) > 0, F.var_pop(z).over(w))
    return rows.withColumn(out, F.col(y) - F.avg(y).over(w) - b * (F.col(z) - F.avg(z).over(w)))


def commonality(rows: DataFrame, by: list[str]) -> DataFrame:
    """Shares of y's variance: by x alone, by z alone, by either, left over; from pairwise correlations, clipped at 0."""
    c = rows.groupBy(*by).agg(safe_corr(F.col("x"), F.col("y")).alias("xy"), safe_corr(F.col("z"), F.col("y")).alias("zy"), safe_corr(F.col("x"), F.col("z")).alias("xz"))
    both = (F.pow("xy", 2) + F.pow("zy", 2) - 2 * F.col("xy") * F.col("zy") * F.col("xz")) / (1 - F.pow("xz", 2))
    c = c.withColumn("_b", both)
    clip = lambda e: F.greatest(F.lit(0.0), e)
    return c.select(*by, clip(F.col("_b") - F.pow("zy", 2)).alias("only_x"), clip(F.col("_b") - F.pow("xy", 2)).alias("only_z"), clip(F.pow("xy", 2) + F.pow("zy", 2) - F.col("_b")).alias("shared"), clip(1 - F.col("_b")).alias("left_over"))


def exceedance(values: DataFrame, observed: DataFrame) -> DataFrame:
    """name, x, share of control values at or below each observed one, and a verdict at one and five per cent. values: v; observed: name, x.

    An observed value's rank among both less its rank among the observed is the number of control values before it; control values go first among equals.
    """
    control = values.where("v IS NOT NULL").select(F.col("v").alias("x"), F.lit(0).alias("_seen"), F.lit(None).cast("string").alias("name"))
    total = max(1, control.count())
    both = ranked_rows(control.unionByName(observed.where("x IS NOT NULL").select("x", F.lit(1).alias("_seen"), F.col("name").cast("string"))), ["x", "_seen", "name"])
    among = ranked_rows(both.where("_seen = 1").withColumnRenamed("rank", "_all"), ["_all"])
    share = among.select("name", "x", ((F.col("_all") - F.col("rank")) / total).alias("share"))
    return share.withColumn("verdict", F.when(F.col("share") <= 0.01, "detected").when(F.col("share") <= 0.05, "likely").otherwise("within"))


def band(values: DataFrame, by: list[str]) -> DataFrame:
    """Median and 16th and 84th percentiles across members, interpolated."""
    q = F.percentile("v", [0.16, 0.5, 0.84])
    return values.groupBy(*by).agg(F.count("v").alias("n"), q.alias("q")).select(*by, "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))


def empirical_cdf(values: DataFrame, v: str) -> DataFrame:
    """Sorted values with rank / total, where missing ones count in the total; equal values in the order of the other columns."""
    total = max(1, values.count())
    order = [v, *[c for c in values.columns if c != v]]
    return ranked_rows(values.where(F.col(v).isNotNull()), order).withColumn("cdf", F.col("rank") / total).drop("rank")


def sign_agreement(values: DataFrame, by: list[str]) -> DataFrame:
    """The share of the commoner sign among members, and their mean."""
    return values.groupBy(*by).agg(F.try_divide(F.greatest(F.count_if(F.col("v") > 0), F.count_if(F.col("v") < 0)), F.count("v")).alias("agreement"), F.avg("v").alias("mean"))


def jackknife_median(values: DataFrame, member: str, v: str) -> DataFrame:
    """The median without each member in turn: it lies at or beside the middle of all, so only the few values there are gathered."""
    n = values.where(F.col(v).isNotNull()).count()
    if n < 2:
        return values.select(F.col(member).alias("without"), F.lit(None).cast("double").alias("median"))
    ranked = ranked_rows(values.where(F.col(v).isNotNull()), [v, member])
    middle = {r.rank: r.x for r in ranked.where(F.col("rank").between((n - 1) // 2, n // 2 + 2)).select("rank", F.col(v).cast("double").alias("x")).collect()}  # at most four rows

    def median(skipped: Column, at: list[int]) -> Column:
        """Mean of the values at these ranks (from 1) of the others: those at or behind the one left out move up by one."""
        pick = lambda k: F.when(skipped > k, F.lit(middle.get(k))).otherwise(F.lit(middle.get(k + 1)))
        return sum(pick(k) for k in at) / len(at)

    others = n - 1
    at = [(others + 1) // 2] if others % 2 else [others // 2, others // 2 + 1]
    return ranked.select(F.col(member).alias("without"), median(F.col("rank"), at).alias("median"))


def ranked_rows(rows: DataFrame, order: list[str], keep: bool = False) -> DataFrame:
    """Adds rank, from 1, over all rows in the order of these columns: rows are dealt to ranges, counted, and numbered within them, so no task sees all of them. keep: and _part, the range."""
    dealt = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # ranges are drawn by sampling, so all uses must see the same
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("rank", (F.col("_inside") + F.col("_before")).cast("long")).drop("_inside", "_before")
    out = out.select(*rows.columns, "_part", "rank")
    return out if keep else out.drop("_part")


#: Bandwidths beyond which a point adds nothing to a density: each pair left out is below exp(-18), 1.6e-8 of a point at the place itself.
REACH = 6.0


def kernel_sums(points: DataFrame, places: DataFrame, key: list[str], bandwidth: float) -> DataFrame:
    """key, total: the sum over points (x, y) of a Gaussian kernel at each place (key, gx, gy), in units of each axis' spread of the points times the bandwidth; and n, sx, sy.

    Places meet the points of their own and the eight bins around by an equi-join; a bin is REACH wide. Places without a point in reach have no row.
    """
    s = points.agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))  # one row
    scaled = lambda df, x, y: df.crossJoin(F.broadcast(s)).withColumns({"_u": F.col(x) / (F.col("sx") * bandwidth), "_w": F.col(y) / (F.col("sy") * bandwidth)})
    bins = lambda c: F.floor(F.col(c) / REACH).cast("long")
    p = scaled(points, "x", "y").select(F.col("_u").alias("pu"), F.col("_w").alias("pw"), bins("_u").alias("bu"), bins("_w").alias("bw"))
    around = F.array(*[F.struct((bins("_u") + i).alias("bu"), (bins("_w") + j).alias("bw")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    g = scaled(places, "gx", "gy").select(*key, "n", "sx", "sy", "_u", "_w", F.explode(around).alias("_b")).select("*", "_b.bu", "_b.bw")
    du, dw = F.col("_u") - F.col("pu"), F.col("_w") - F.col("pw")
    near = g.join(p, ["bu", "bw"]).withColumn("_d", du * du + dw * dw).where(F.col("_d") <= REACH * REACH)
    return near.groupBy(*key, "n", "sx", "sy").agg(F.sum(F.exp(-0.5 * F.col("_d"))).alias("total"))


def density(points: DataFrame, at: DataFrame, bandwidth: float) -> DataFrame:
    """Two-dimensional Gaussian kernel density at a stated grid of places; points: x, y, at: gx, gy. Bandwidth in units of each axis' spread."""
    sums = kernel_sums(points, at, ["gx", "gy"], bandwidth)
    scale = 2 * 3.141592653589793 * bandwidth**2
    found = sums.select("gx", "gy", (F.col("total") / F.col("n") / (scale * F.col("sx") * F.col("sy"))).alias("density"))
    return at.join(found, ["gx", "gy"], "left").select("gx", "gy", F.coalesce("density", F.lit(0.0)).alias("density"))


def label_permutations(spark: SparkSession, means: DataFrame, label: str, chosen: int) -> DataFrame:
    """All ways to choose so many of a few labelled values: their number, how many have as large a sum as the first ones by name, and the share.

    means: label, v; at most twenty labels (each choice is a number whose bits are the labels).
    """
    n = means.count()
    if n > 20:
        raise ValueError("more than twenty labels")
    rows = means.withColumn("i", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(label)) - 1).cast("int"))
    seen = rows.where(F.col("i") < chosen).agg(F.round(F.sum("v"), 9).alias("o"))
    bit = F.expr("shiftright(mask, i)").bitwiseAND(F.lit(1).cast("long")) == 1
    picks = spark.range(2**n).withColumnRenamed("id", "mask").crossJoin(F.broadcast(rows)).groupBy("mask").agg(F.count_if(bit).alias("k"), F.round(F.sum(F.when(bit, F.col("v"))), 9).alias("a"))
    hit = (F.col("a") >= F.col("o")).cast("double")
    return picks.where(F.col("k") == chosen).crossJoin(F.broadcast(seen)).agg(F.count("*").alias("chosen"), F.sum(hit).cast("long").alias("as_extreme"), F.avg(hit).alias("share"))


def exit_fraction(points: DataFrame, bandwidth: float, q: float) -> DataFrame:
    """How many points lie below the q-quantile contour of their own kernel density (unnormalised), and its level. points: t, x, y."""
    places = points.select("t", F.col("x").alias("gx"), F.col("y").alias("gy"))
    d = kernel_sums(points, places, ["t"], bandwidth).select("t", (F.col("total") / F.col("n")).alias("d"))
    level = d.agg(F.percentile("d", q).alias("level"))
    return d.crossJoin(F.broadcast(level)).groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("d") < F.col("level")).alias("outside"))
