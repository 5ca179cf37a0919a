"""Named queries over the given tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.operators import contours, evidence, grid, statistics
from tellurion.plans import attribution, audits, bootstraps, claims, exchange, lines, rasters, records, terrain
from tellurion.sources.tables import points, vertices


def _rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in names})


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.to_cells(points(spark, sf_dir))


def support_by_grade(spark, sf_dir):
    graded = grid.support(_cells(spark, sf_dir).groupBy(*grid.CELL).agg(F.count("*").alias("n"))).withColumn("grade", grid.grade(F.col("confidence")))
    return _rounded(graded.groupBy("site", "grade").agg(F.count("*").alias("cells"), F.sum("n").alias("returns"), F.avg("confidence").alias("mean_confidence")), "mean_confidence")


def raster_cells(spark, sf_dir):
    return _rounded(grid.raster(_cells(spark, sf_dir)), "mean", "least", "median", "p90")


def raster_robust(spark, sf_dir):
    return _rounded(grid.robust_raster(_cells(spark, sf_dir)), "robust")


def coarse_support(spark, sf_dir):
    supported = grid.support(_cells(spark, sf_dir).groupBy(*grid.CELL).agg(F.count("*").alias("n")))
    return _rounded(grid.coarsened(supported, 4), "average")


def _spans(spark, sf_dir):
    return evidence.runs(evidence.edges(vertices(spark, sf_dir)))


def span_records(spark, sf_dir):
    return _rounded(evidence.span_records(_spans(spark, sf_dir)).drop("prov_end"), "len", "m_mean", "m_ge66", "m_ge33", to=5)


def promotion_by_line(spark, sf_dir):
    p = evidence.promotions(evidence.span_records(_spans(spark, sf_dir)))
    return p.groupBy("line_id").agg(F.count("*").alias("spans"), F.count_if("promoted").alias("promoted"), F.max("promotion").alias("max_promotion"))


def threshold_accounting(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return _rounded(evidence.accounting(spans, 33), "correct_accept", "false_accept", "wrong_reject", "correct_reject", to=5)


def contour_segments(spark, sf_dir):
    cells = grid.support(_cells(spark, sf_dir).groupBy(*grid.CELL).agg(F.count("*").alias("n"), F.min("z").alias("z")))
    s = contours.segments(cells, 1.0)
    return _rounded(s.withColumn("grade", grid.grade(F.col("confidence"))), "x1", "y1", "x2", "y2")


def support_rank_correlation(spark, sf_dir):
    counted = _cells(spark, sf_dir).groupBy(*grid.CELL).agg(F.count("*").alias("n"), F.round(F.max("z") - F.min("z"), 3).alias("spread"))
    return _rounded(statistics.rank_correlation(counted, "site", "n", "spread"), "rho")


def promotion_interval(spark, sf_dir):
    """A channel-wise share of spans promoted over all lines, with its interval, and the quartiles of lines' shares."""
    per = promotion_by_line(spark, sf_dir)
    share = F.try_divide(F.col("promoted"), F.col("spans"))
    total = per.agg(F.sum("spans").alias("spans"), F.sum("promoted").alias("promoted"))
    shares = statistics.quantiles(per.select(F.lit(1).alias("all"), share.alias("share")), "all", "share", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    low, high = statistics.wilson(F.col("promoted"), F.col("spans"))
    out = total.join(F.broadcast(shares), F.lit(True), "left").select("spans", "promoted", low.alias("low"), high.alias("high"), "q1", "q2", "q3")  # one row each
    return _rounded(out, "low", "high", "q1", "q2", "q3")


QUERIES = attribution.QUERIES | bootstraps.QUERIES | claims.QUERIES | exchange.QUERIES | lines.QUERIES | terrain.QUERIES | records.QUERIES | rasters.QUERIES | audits.QUERIES | {
    f.__name__: f
    for f in (
        support_by_grade,
        raster_cells,
        raster_robust,
        coarse_support,
        span_records,
        promotion_by_line,
        threshold_accounting,
        contour_segments,
        support_rank_correlation,
        promotion_interval,
    )
}

_POINTS = """p AS (SELECT l_returnflag AS site, (l_partkey % 1000) / 10.0::DOUBLE AS x, (l_orderkey % 1000) / 10.0::DOUBLE AS y, l_tax FROM lineitem),
c AS (SELECT site, CAST(least(99, floor(y)) AS INTEGER) AS "row", CAST(least(99, floor(x)) AS INTEGER) AS col,
             0.08::DOUBLE * x + 0.06::DOUBLE * y + 5 * l_tax AS z FROM p)"""
_SUPPORT = f"""{_POINTS}, r AS (SELECT site, "row", col, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT site, quantile_cont(n, 0.5) AS target FROM r GROUP BY site),
s AS (SELECT r.*, CAST(floor(100 * least(1.0::DOUBLE, n / target) * n / (n + 3) + 0.5) AS BIGINT) AS confidence FROM r JOIN t USING (site))"""
_SPANS = records.VERTICES + """,
n AS (SELECT *, lead(x) OVER q AS x2, lead(y) OVER q AS y2, lead(prov) OVER q AS prov2, lead(m) OVER q AS m2, lead(i) OVER q AS i2 FROM w WINDOW q AS (PARTITION BY line_id ORDER BY seq)),
e AS (SELECT line_id, seq, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len, CASE WHEN prov = prov2 THEN prov ELSE 'X' END AS prov, least(m, m2) AS m, least(i, i2) AS i
      FROM n WHERE prov <> 'U' AND prov2 <> 'U'),
g AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY line_id ORDER BY seq) = 1 THEN 0 ELSE 1 END AS starts FROM e),
s AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY line_id ORDER BY seq) AS BIGINT) AS span FROM g),
a AS (SELECT line_id, span, min(seq) AS src_from, max(seq) + 1 AS src_to, sum(len) AS len, array_to_string(list_sort(list(DISTINCT prov)), '|') AS prov, min(m) AS m_min, min(i) AS i_min,
  sum(m * len) / sum(len) FILTER (m IS NOT NULL) AS m_mean, coalesce(sum(len) FILTER (m >= 66), 0) / sum(len) FILTER (m IS NOT NULL) AS m_ge66,
  coalesce(sum(len) FILTER (m >= 33), 0) / sum(len) FILTER (m IS NOT NULL) AS m_ge33, arg_min({'m': m, 'i': i, 'prov': prov}, seq) AS fst, arg_max({'m': m, 'i': i, 'prov': prov}, seq) AS lst FROM s GROUP BY line_id, span),
d AS (SELECT * EXCLUDE (fst, lst), least(fst.m, lst.m) AS m_end, least(fst.i, lst.i) AS i_end FROM a)"""
SQL = attribution.SQL | bootstraps.SQL | claims.SQL | exchange.SQL | lines.SQL | terrain.SQL | records.SQL | rasters.SQL | audits.SQL | {
    "support_by_grade": f"""WITH {_SUPPORT} SELECT site, CASE WHEN confidence >= 66 THEN 'solid' WHEN confidence >= 33 THEN 'dashed' ELSE 'gap' END AS grade, count(*) AS cells,
        CAST(sum(n) AS BIGINT) AS returns, round(avg(confidence), 6) AS mean_confidence FROM s GROUP BY 1, 2""",
    "raster_cells": f"""WITH {_POINTS} SELECT site, "row", col, count(*) AS n, round(avg(z), 6) AS mean, round(min(z), 6) AS least, round(quantile_cont(z, 0.5), 6) AS median,
        round(quantile_cont(z, 0.9), 6) AS p90 FROM c GROUP BY ALL""",
    "raster_robust": f"""WITH {_POINTS}, m AS (SELECT *, quantile_cont(z, 0.5) OVER (PARTITION BY site, "row", col) AS mid FROM c), o AS (SELECT *, abs(z - mid) AS off FROM m),
        d AS (SELECT *, quantile_cont(off, 0.5) OVER (PARTITION BY site, "row", col) AS mad FROM o)
        SELECT site, "row", col, round(avg(z) FILTER (off <= 3 * 1.4826::DOUBLE * mad), 6) AS robust, count(*) FILTER (off <= 3 * 1.4826::DOUBLE * mad) AS kept FROM d GROUP BY ALL""",
    "coarse_support": f"""WITH {_SUPPORT} SELECT site, CAST("row" // 4 AS INTEGER) AS "row", CAST(col // 4 AS INTEGER) AS col, round(avg(confidence), 6) AS average, min(confidence) AS least,
        count(*) AS cells FROM s GROUP BY 1, 2, 3""",
    "span_records": f"WITH {_SPANS} SELECT * REPLACE (round(len, 5) AS len, round(m_mean, 5) AS m_mean, round(m_ge66, 5) AS m_ge66, round(m_ge33, 5) AS m_ge33) FROM d",
    "promotion_by_line": f"""WITH {_SPANS} SELECT line_id, count(*) AS spans, count(*) FILTER (m_end - m_min > 1e-12) AS promoted,
        max(CASE WHEN m_end - m_min > 1e-12 THEN m_end - m_min ELSE 0 END) AS max_promotion FROM d GROUP BY line_id""",
    "threshold_accounting": f"""WITH {_SPANS}, z AS (SELECT line_id, span, least(fst.m, lst.m) AS m_end, CASE WHEN fst.prov = lst.prov THEN fst.prov ELSE 'X' END AS prov_end FROM a), f AS (SELECT s.line_id, s.len, coalesce(s.m >= 33, false) AND s.prov = 'M' AS passes, coalesce(a.m_end >= 33, false) AND a.prov_end = 'M' AS says
        FROM s JOIN z a ON s.line_id = a.line_id AND s.span = a.span)
        SELECT line_id, round(coalesce(sum(len) FILTER (passes AND says), 0), 5) AS correct_accept, round(coalesce(sum(len) FILTER (NOT passes AND says), 0), 5) AS false_accept,
        round(coalesce(sum(len) FILTER (passes AND NOT says), 0), 5) AS wrong_reject, round(coalesce(sum(len) FILTER (NOT passes AND NOT says), 0), 5) AS correct_reject FROM f GROUP BY line_id""",
    "contour_segments": f"WITH {_POINTS}"
    + """, r AS (SELECT site, "row", col, count(*) AS n, min(z) AS z FROM c GROUP BY ALL), t AS (SELECT site, quantile_cont(n, 0.5) AS target FROM r GROUP BY site),
        s AS (SELECT site, "row", col, z, CAST(floor(100 * least(1.0::DOUBLE, n / target) * n / (n + 3) + 0.5) AS BIGINT) AS f FROM r JOIN t USING (site)),
        b AS (SELECT a.site, a."row", a.col, a.z AS z0, b.z AS z1, d.z AS z2, e.z AS z3, least(a.f, b.f, d.f, e.f) AS confidence FROM s a
          JOIN s b ON b.site = a.site AND b."row" = a."row" AND b.col = a.col + 1 JOIN s d ON d.site = a.site AND d."row" = a."row" + 1 AND d.col = a.col + 1
          JOIN s e ON e.site = a.site AND e."row" = a."row" + 1 AND e.col = a.col),
        l AS (SELECT *, unnest(range(CAST(floor(least(z0, z1, z2, z3)) AS BIGINT) + 1, CAST(floor(greatest(z0, z1, z2, z3)) AS BIGINT) + 1)) AS k FROM b),
        v AS (SELECT *, k * 1.0::DOUBLE AS level FROM l),
        e AS (SELECT *, list_filter([
            {'x': col + 0.5::DOUBLE + (level - z0) / (z1 - z0), 'y': "row" + 0.5::DOUBLE, 'hit': (z0 >= level) <> (z1 >= level)},
            {'x': col + 1.5::DOUBLE, 'y': "row" + 0.5::DOUBLE + (level - z1) / (z2 - z1), 'hit': (z1 >= level) <> (z2 >= level)},
            {'x': col + 0.5::DOUBLE + (level - z3) / (z2 - z3), 'y': "row" + 1.5::DOUBLE, 'hit': (z3 >= level) <> (z2 >= level)},
            {'x': col + 0.5::DOUBLE, 'y': "row" + 0.5::DOUBLE + (level - z0) / (z3 - z0), 'hit': (z0 >= level) <> (z3 >= level)}], lambda h: h.hit) AS e,
          (CASE WHEN z0 + z2 - z1 - z3 = 0 THEN (z0 + z1 + z2 + z3) / 4 ELSE (z0 * z2 - z1 * z3) / (z0 + z2 - z1 - z3) END >= level) = (z0 >= level) AS joined FROM v),
        o AS (SELECT site, level, "row", col, confidence, unnest(CASE WHEN len(e) = 2 THEN [{'p': e[1], 'q': e[2]}] WHEN joined THEN [{'p': e[1], 'q': e[2]}, {'p': e[3], 'q': e[4]}]
          ELSE [{'p': e[1], 'q': e[4]}, {'p': e[2], 'q': e[3]}] END) AS g FROM e)
        SELECT site, level, "row", col, confidence, round(g.p.x, 6) AS x1, round(g.p.y, 6) AS y1, round(g.q.x, 6) AS x2, round(g.q.y, 6) AS y2,
          CASE WHEN confidence >= 66 THEN 'solid' WHEN confidence >= 33 THEN 'dashed' ELSE 'gap' END AS grade FROM o WHERE g.p.x <> g.q.x OR g.p.y <> g.q.y""",
    "support_rank_correlation": f"""WITH {_POINTS}, r AS (SELECT site, count(*) AS n, round(max(z) - min(z), 3) AS spread FROM c GROUP BY site, "row", col),
        k AS (SELECT site, rank() OVER (PARTITION BY site ORDER BY n) + (count(*) OVER (PARTITION BY site, n) - 1) / 2.0 AS a,
          rank() OVER (PARTITION BY site ORDER BY spread) + (count(*) OVER (PARTITION BY site, spread) - 1) / 2.0 AS b FROM r)
        SELECT site, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY site""",
    "promotion_interval": f"""WITH {_SPANS}, o AS (SELECT line_id, count(*) AS spans, count(*) FILTER (m_end - m_min > 1e-12) AS promoted FROM d GROUP BY line_id),
        h AS (SELECT CAST(sum(spans) AS BIGINT) AS n, CAST(sum(promoted) AS BIGINT) AS k, quantile_cont(promoted / spans, [0.25, 0.5, 0.75]) AS q, 1.959963984540054::DOUBLE AS z FROM o)
        SELECT n AS spans, k AS promoted, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS low,
          round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS high,
          round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3 FROM h""",
}
