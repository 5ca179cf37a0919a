"""Queries on audits: distributions, bootstraps, concentration, held-out errors, totals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.operators import evidence, grid, statistics
from tellurion.plans import rasters, records
from tellurion.sources.tables import points, vertices

SEED, REPLICATES, HELD = 20260101, 200, 5


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in names})


def _by_line(spark, sf_dir) -> DataFrame:
    spans = evidence.runs(evidence.edges(vertices(spark, sf_dir)))
    judged = evidence.promotions(evidence.span_records(spans))
    return judged.groupBy("line_id").agg(F.count("*").alias("spans"), F.count_if("promoted").alias("promoted"))


def promotion_distribution(spark, sf_dir):
    """How the lines' promotion rates are distributed, by whether a line has many spans; lines of under three are not rated."""
    rated = _by_line(spark, sf_dir).where("spans >= 3").withColumns({"rate": F.col("promoted") / F.col("spans"), "many": F.col("spans") >= 9})
    return rounded(statistics.distribution(rated, ["many"], "rate"), "least", "q1", "median", "q3", "greatest")


def promotion_bootstrap(spark, sf_dir):
    """Bootstrap over whole lines of the share of spans promoted: bounds by the lower rule and by linear quantiles."""
    ratios = statistics.bootstrap_ratio(_by_line(spark, sf_dir), "line_id", "promoted", "spans", SEED, REPLICATES)
    out = ratios.agg(F.array_sort(F.collect_list("ratio")).alias("r"), F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("replicates"))  # REPLICATES rows
    named = out.select("replicates", statistics.lower_quantile(F.col("r"), 0.025).alias("low"), statistics.lower_quantile(F.col("r"), 0.975).alias("high"), statistics.upper_median(F.col("r")).alias("middle"), F.get("q", F.lit(0)).alias("linear_low"), F.get("q", F.lit(1)).alias("linear_high"))
    return rounded(named, "low", "high", "middle", "linear_low", "linear_high")


def promotion_concentration(spark, sf_dir):
    out = statistics.concentration(_by_line(spark, sf_dir), "promoted", "spans", "line_id")
    return rounded(out, *out.columns)


def spread_median(spark, sf_dir):
    """Median of the cells' spread of heights by site, every cell weighted by its points."""
    cells = grid.to_cells(points(spark, sf_dir)).groupBy(*grid.CELL).agg(F.count("*").alias("n"), F.round(F.max("z") - F.min("z"), 4).alias("spread"))
    return statistics.weighted_median(cells, "site", "spread", "n")


def heldout_error(spark, sf_dir):
    """Errors of cell means against held-out points in the same cells, by site and grade of the cell built without them."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    held = (F.col("l_orderkey") + F.col("l_linenumber")) % HELD == 0
    x, y = (F.col("l_partkey") % 1000) / 10.0, (F.col("l_orderkey") % 1000) / 10.0
    p = t.select(F.col("l_returnflag").alias("site"), x.alias("x"), y.alias("y"), (0.08 * x + 0.06 * y + 5 * F.col("l_tax")).alias("z"), held.alias("held"))
    # Both sides by cell in one aggregate.
    of = lambda h: F.when(F.col("held") == h, F.col("z"))
    cells = grid.binned(p).groupBy(*grid.CELL).agg(F.count(of(False)).alias("n"), F.avg(of(False)).alias("built"), F.avg(of(True)).alias("check"), F.count(of(True)).alias("checks"))
    built = grid.support(cells.where("n > 0"))
    e = built.where("checks > 0").withColumns({"error": F.col("check") - F.col("built"), "grade": grid.grade(F.col("confidence"))})
    out = e.groupBy("site", "grade").agg(F.count("*").alias("cells"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    middle = statistics.quantiles(e.select(F.struct("site", "grade").alias("by"), F.abs("error").alias("off")), "by", "off", {"median_error": 0.5}).select("by.*", "median_error")
    return rounded(out.join(middle, ["site", "grade"]), "rmse", "median_error")


def support_totals(spark, sf_dir):
    """Cells and points by site and grade, by site, and in all."""
    graded = grid.support(grid.to_cells(points(spark, sf_dir)).groupBy(*grid.CELL).agg(F.count("*").alias("n"))).withColumn("grade", grid.grade(F.col("confidence")))
    out = graded.rollup("site", "grade").agg(F.count("*").alias("cells"), F.sum("n").alias("points"), F.grouping_id().alias("level"))
    return out.select("site", "grade", "cells", "points", F.col("level").cast("int").alias("level"))


def promotion_prevalence(spark, sf_dir):
    """Share of lines with a promoted span and its interval, and how large the promotions are."""
    spans = evidence.promotions(evidence.span_records(evidence.runs(evidence.edges(vertices(spark, sf_dir)))))
    per = spans.groupBy("line_id").agg(F.count_if("promoted").alias("promoted")).agg(F.count("*").alias("lines"), F.count_if(F.col("promoted") > 0).alias("with_promotion"))
    sizes = statistics.quantiles(spans.where("promoted").withColumn("all", F.lit(1)), "all", "promotion", {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}).withColumnRenamed("n", "promoted")
    low, high = statistics.wilson(F.col("with_promotion"), F.col("lines"))
    met = per.join(F.broadcast(sizes), F.lit(True), "left").withColumn("promoted", F.coalesce("promoted", F.lit(0).cast("long")))  # one row each
    out = met.select("lines", "with_promotion", low.alias("low"), high.alias("high"), "promoted", "q1", "median", "q3", "p95")
    return rounded(out, "low", "high", "q1", "median", "q3", "p95")


QUERIES = {f.__name__: f for f in (promotion_prevalence, promotion_distribution, promotion_bootstrap, promotion_concentration, spread_median, heldout_error, support_totals)}

_LINES = f"""{records._EDGES}, a AS (SELECT line_id, span, least(arg_min({{'v': m}}, seq).v, arg_max({{'v': m}}, seq).v) - min(m) AS more FROM s GROUP BY line_id, span),
o AS (SELECT line_id, count(*) AS spans, count(*) FILTER (more > 1e-12) AS promoted FROM a GROUP BY line_id)"""
_SUPPORT = f"""{rasters._CELLS}, r AS (SELECT site, "row", col, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT site, quantile_cont(n, 0.5) AS target FROM r GROUP BY site),
s AS (SELECT r.*, floor(100 * least(1.0::DOUBLE, n / target) * n / (n + 3) + 0.5) AS f FROM r JOIN t USING (site)),
g AS (SELECT site, n, CASE WHEN f >= 66 THEN 'solid' WHEN f >= 33 THEN 'dashed' ELSE 'gap' END AS grade FROM s)"""

SQL = {
    "promotion_prevalence": f"""WITH {_LINES}, h AS (SELECT count(*) AS n, count(*) FILTER (promoted > 0) AS k, 1.959963984540054::DOUBLE AS z FROM o), q AS (SELECT count(*) AS promoted, quantile_cont(more, [0.25, 0.5, 0.75, 0.95]) AS q FROM a WHERE more > 1e-12)
        SELECT n AS lines, k AS with_promotion, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS low,
        round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS high, promoted, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3, round(q[4], 6) AS p95 FROM h, q""",
    "promotion_distribution": f"""WITH {_LINES} SELECT spans >= 9 AS many, count(*) AS units, round(min(promoted / spans), 6) AS least, round(quantile_cont(promoted / spans, 0.25), 6) AS q1, round(quantile_cont(promoted / spans, 0.5), 6) AS median,
        round(quantile_cont(promoted / spans, 0.75), 6) AS q3, round(max(promoted / spans), 6) AS greatest FROM o WHERE spans >= 3 GROUP BY 1""",
    "promotion_bootstrap": f"""WITH {_LINES}, b0 AS (SELECT *, row_number() OVER (ORDER BY line_id % 1024, line_id) - 1 AS number, count(*) OVER () AS total FROM o),
        b1 AS (SELECT r, total, CAST(({SEED} + ((r * total + number + 1)::HUGEINT * {0x6D2B79F5}) % 4294967296) % 4294967296 AS UHUGEINT) AS a FROM b0, range({REPLICATES}) x(r)),
        b2 AS (SELECT r, total, (xor(a, a >> 15) * (a | 1)) % 4294967296 AS t FROM b1), b3 AS (SELECT r, total, xor((t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296, t) AS t FROM b2),
        b4 AS (SELECT r, CAST(floor(CAST(xor(t, t >> 14) AS DOUBLE) / 4294967296.0::DOUBLE * total) AS BIGINT) AS number FROM b3),
        b5 AS (SELECT r, sum(promoted) / sum(spans) AS ratio FROM b4 JOIN b0 USING (number) GROUP BY r), b6 AS (SELECT list_sort(list(ratio)) AS v, count(*) AS k, quantile_cont(ratio, 0.025) AS ql, quantile_cont(ratio, 0.975) AS qh FROM b5)
        SELECT k AS replicates, round(v[CAST(floor(0.025::DOUBLE * (k - 1)) AS BIGINT) + 1], 6) AS low, round(v[CAST(floor(0.975::DOUBLE * (k - 1)) AS BIGINT) + 1], 6) AS high, round(v[k // 2 + 1], 6) AS middle, round(ql, 6) AS linear_low, round(qh, 6) AS linear_high FROM b6""",
    "promotion_concentration": f"""WITH {_LINES}, t AS (SELECT sum(promoted) AS t, sum(spans) AS b FROM o), k AS (SELECT sum(promoted) AS kt, sum(spans) AS kb FROM (SELECT * FROM o ORDER BY promoted DESC, line_id LIMIT 3)),
        l AS (SELECT min((t - promoted) / (b - spans)) AS lo, max((t - promoted) / (b - spans)) AS hi FROM o, t)
        SELECT round(kt / t, 6) AS top_share, round(t / b, 6) AS pooled, round((t - kt) / (b - kb), 6) AS pooled_without_top, round(lo, 6) AS least_without_one, round(hi, 6) AS most_without_one FROM t, k, l""",
    "spread_median": f"""WITH {rasters._CELLS}, r AS (SELECT site, count(*) AS n, round(max(z) - min(z), 4) AS spread FROM c GROUP BY site, "row", col), v AS (SELECT site, spread, sum(n) AS w FROM r GROUP BY ALL),
        u AS (SELECT site, spread, sum(w) OVER (PARTITION BY site ORDER BY spread) AS upto, sum(w) OVER (PARTITION BY site) AS total FROM v) SELECT site, min(spread) AS median FROM u WHERE upto * 2 >= total GROUP BY site""",
    "heldout_error": f"""WITH p AS (SELECT l_returnflag AS site, (l_partkey % 1000) / 10.0::DOUBLE AS x, (l_orderkey % 1000) / 10.0::DOUBLE AS y, l_tax, (l_orderkey + l_linenumber) % {HELD} = 0 AS held FROM lineitem),
        c AS (SELECT site, floor(y) AS r, floor(x) AS c, held, 0.08::DOUBLE * x + 0.06::DOUBLE * y + 5 * l_tax AS z FROM p),
        a AS (SELECT site, r, c, count(*) FILTER (NOT held) AS n, avg(z) FILTER (NOT held) AS built, avg(z) FILTER (held) AS chk FROM c GROUP BY ALL), b AS (SELECT * FROM a WHERE n > 0), t AS (SELECT site, quantile_cont(n, 0.5) AS target FROM b GROUP BY site),
        f AS (SELECT site, floor(100 * least(1.0::DOUBLE, n / target) * n / (n + 3) + 0.5) AS f, chk - built AS e FROM b JOIN t USING (site) WHERE chk IS NOT NULL)
        SELECT site, CASE WHEN f >= 66 THEN 'solid' WHEN f >= 33 THEN 'dashed' ELSE 'gap' END AS grade, count(*) AS cells, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS median_error FROM f GROUP BY 1, 2""",
    "support_totals": f"WITH {_SUPPORT} SELECT site, grade, count(*) AS cells, CAST(sum(n) AS BIGINT) AS points, CAST(grouping(site, grade) AS INTEGER) AS level FROM g GROUP BY ROLLUP (site, grade)",
}
