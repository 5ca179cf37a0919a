"""Queries on contours of the support field as lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.operators import contours, stitching
from tellurion.plans.rasters import _TYPED, field_cells, rounded


def field_segments(spark, sf_dir) -> DataFrame:
    """Segments of the support field's contours at every metre, numbered."""
    return stitching.numbered(contours.segments(rounded(field_cells(spark, sf_dir), "z"), 1.0, parts=True))


def stitched_lines(spark, sf_dir):
    """Vertices of the field's contours, joined into lines and rings."""
    return rounded(stitching.line_vertices(stitching.stitched(field_segments(spark, sf_dir), tile=32)), "x", "y", to=5)


def line_evidence(spark, sf_dir):
    """Lines of the field's contours with what their segments carry: count and length by provenance, whether closed, the least support."""
    e = stitching.stitched(field_segments(spark, sf_dir), tile=32)
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    out = e.groupBy("site", "level", "line", "closed").agg(F.count("*").alias("segments"), F.sum(length).alias("length"), F.coalesce(F.sum(F.when(F.col("prov") == "M", length)), F.lit(0.0)).alias("measured"), F.min("m").alias("m"), F.min("i").alias("i"), F.min("confidence").alias("confidence"))
    return rounded(out, "length", "measured", to=4)


QUERIES = {f.__name__: f for f in (stitched_lines, line_evidence)}

#: Ends paired at every point; a walk from each segment either way gives its line's least, and from that one the places.
_LINES = f"""{_TYPED},
  gs AS MATERIALIZED (SELECT site, level, (CAST("row" AS BIGINT) << 33) + (CAST(col AS BIGINT) << 1) + o.k AS seg, o.p.x AS x1, o.p.y AS y1, o.q.x AS x2, o.q.y AS y2, confidence, m, i,
        floor(o.p.x / 0.001::DOUBLE + 0.5) AS ax, floor(o.p.y / 0.001::DOUBLE + 0.5) AS ay, floor(o.q.x / 0.001::DOUBLE + 0.5) AS bx, floor(o.q.y / 0.001::DOUBLE + 0.5) AS by_ FROM sg WHERE o.p.x <> o.q.x OR o.p.y <> o.q.y),
  gw AS (SELECT * FROM gs WHERE ax <> bx OR ay <> by_),
  pe AS (SELECT *, row_number() OVER (PARTITION BY site, level, kx, ky ORDER BY seg, e) - 1 AS rn FROM (SELECT site, level, seg, 0 AS e, ax AS kx, ay AS ky FROM gw UNION ALL SELECT site, level, seg, 1, bx, by_ FROM gw)),
  jn AS MATERIALIZED (SELECT a.site, a.level, a.seg, a.e, b.seg AS seg2, b.e AS e2 FROM pe a JOIN pe b ON b.site = a.site AND b.level = a.level AND b.kx = a.kx AND b.ky = a.ky AND b.rn = xor(a.rn, 1)),
  wk AS (SELECT site, level, seg AS seg0, d AS d0, seg, d, 0 AS k FROM gw, (VALUES (0), (1)) v(d)
    UNION ALL SELECT w.site, w.level, w.seg0, w.d0, j.seg2, j.e2, w.k + 1 FROM wk w JOIN jn j ON j.site = w.site AND j.level = w.level AND j.seg = w.seg AND j.e = 1 - w.d WHERE j.seg2 <> w.seg0),
  fl AS (SELECT site, level, seg0 AS seg, min(seg) AS line FROM wk GROUP BY ALL),
  rg AS (SELECT a.site, a.level, a.seg0 AS line, count(*) > 0 AS ring FROM wk a JOIN jn j ON j.site = a.site AND j.level = a.level AND j.seg = a.seg AND j.e = 1 - a.d AND j.seg2 = a.seg0 AND j.e2 = 0 WHERE a.d0 = 0 GROUP BY ALL),
  pl AS (SELECT w.site, w.level, w.seg0 AS line, w.seg, CASE WHEN w.d0 = 0 THEN w.d ELSE 1 - w.d END AS back, CASE WHEN w.d0 = 0 THEN w.k ELSE -w.k END AS k, coalesce(rg.ring, false) AS ring
    FROM wk w JOIN fl ON fl.site = w.site AND fl.level = w.level AND fl.seg = w.seg0 AND fl.line = w.seg0 LEFT JOIN rg ON rg.site = w.site AND rg.level = w.level AND rg.line = w.seg0 WHERE w.d0 = 0 OR (w.k > 0 AND rg.ring IS NULL)),
  ln AS (SELECT pl.site, pl.level, pl.line, pl.k - min(pl.k) OVER q AS place, pl.ring AND count(*) OVER q >= 3 AS closed, count(*) OVER q AS n, CASE WHEN back = 0 THEN x1 ELSE x2 END AS x1, CASE WHEN back = 0 THEN y1 ELSE y2 END AS y1,
        CASE WHEN back = 0 THEN x2 ELSE x1 END AS x2, CASE WHEN back = 0 THEN y2 ELSE y1 END AS y2, confidence, m, i, pl.seg FROM pl JOIN gw ON gw.site = pl.site AND gw.level = pl.level AND gw.seg = pl.seg WINDOW q AS (PARTITION BY pl.site, pl.level, pl.line))"""

SQL = {
    "stitched_lines": f"""WITH RECURSIVE {_LINES}, ev AS (SELECT site, level, line, closed, place AS seq, x1 AS x, y1 AS y, confidence, true AS starts FROM ln UNION ALL SELECT site, level, line, closed, CASE WHEN closed THEN (place + 1) % n ELSE place + 1 END, x2, y2, confidence, false FROM ln)
        SELECT site, level, line, CAST(seq AS BIGINT) AS seq, round(arg_max(x, starts), 5) AS x, round(arg_max(y, starts), 5) AS y, min(confidence) AS confidence, closed FROM ev GROUP BY site, level, line, seq, closed""",
    "line_evidence": f"""WITH RECURSIVE {_LINES}, le AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS length FROM ln)
        SELECT site, level, line, closed, count(*) AS segments, round(sum(length), 4) AS length, round(coalesce(sum(length) FILTER (i IS NULL), 0), 4) AS measured, min(m) AS m, min(i) AS i, min(confidence) AS confidence FROM le GROUP BY site, level, line, closed""",
}
