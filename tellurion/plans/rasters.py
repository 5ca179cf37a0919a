"""Queries on points and grids: binning, accounting, floors, the support field and its resampling, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.operators import contours, fill, grid, predicates, profiles
from tellurion.sources.tables import points

ROWS = COLS = 100
RADIUS = 8


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in names})


def blundered(spark, sf_dir) -> DataFrame:
    """Points of which some have no height, and some lie off the grid of 95 cells a side."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = (F.col("l_partkey") % 1000) / 10.0, (F.col("l_orderkey") % 1000) / 10.0
    z = F.when(F.col("l_suppkey") % 97 == 0, float("nan")).when(F.col("l_suppkey") % 101 == 0, float("inf")).otherwise(0.08 * x + 0.06 * y + 5 * F.col("l_tax"))
    return t.select(F.col("l_returnflag").alias("site"), x.alias("x"), y.alias("y"), z.alias("z"))


def binning_rules(spark, sf_dir):
    """A site's cells and points by every rule, and the cells whose count differs from the plain rule's."""
    every = F.array(*(F.struct(F.lit(rule).alias("rule"), grid.bin_of(COLS, ROWS, **options).alias("at")) for rule, options in grid.BINNING.items()))
    counted = points(spark, sf_dir).select("site", F.explode(every).alias("b")).where("b.at is not null").select("b.rule", "site", "b.at.row", "b.at.col")
    n = counted.groupBy(*grid.CELL).pivot("rule", list(grid.BINNING)).count()
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(r, F.lit(0).cast("long")).alias("n"), F.coalesce("floor", F.lit(0).cast("long")).alias("plain")) for r in grid.BINNING))
    e = n.select("site", F.explode(rows).alias("r")).select("site", "r.*")
    return e.groupBy("site", "rule").agg(F.count_if(F.col("n") > 0).alias("cells"), F.sum("n").alias("points"), F.count_if(F.col("n") != F.col("plain")).alias("differ"))


def raster_accounting(spark, sf_dir):
    p = blundered(spark, sf_dir)
    return grid.accounting(p, 95, 95).join(grid.extents(p, aligned=True), "site")


def raster_percentile(spark, sf_dir):
    """Heights of cells at a level of 0.25, and at levels that are out of range or no number."""
    cells = grid.to_cells(points(spark, sf_dir), COLS, ROWS)
    levels = {"q25": 0.25, "top": 1.7, "odd": float("nan")}
    return rounded(cells.groupBy(*grid.CELL).agg(*(F.percentile("z", F.lit(grid.quantile_level(p))).alias(n) for n, p in levels.items())), *levels)


def despiked_floor(spark, sf_dir):
    return rounded(grid.despiked(grid.to_cells(points(spark, sf_dir), COLS, ROWS), 5), "floor")


def field_cells(spark, sf_dir, where: str = "true") -> DataFrame:
    """The support field of the given points, or of those for whose rows ``where`` holds."""
    cells = grid.to_cells(points(spark, sf_dir, where), COLS, ROWS).groupBy(*grid.CELL).agg(F.count("*").alias("n"), F.avg("z").alias("z"))
    return fill.support_field(cells, ROWS, COLS, radius=RADIUS, tile=32)


def support_field(spark, sf_dir):
    return rounded(field_cells(spark, sf_dir).drop("n"), "z", "slope")


def coarse_resample(spark, sf_dir):
    """What near, average and least of coarse blocks claim beyond the least of the cells that carry the band, by site and factor."""
    field, out = field_cells(spark, sf_dir), None
    for factor in (2, 4):
        b = grid.resampled(field, factor)
        bands = ("m", "i")
        more = lambda how: sum((F.coalesce((F.col(f"{c}_{how}") - F.col(f"{c}_least") > 1e-6), F.lit(False)).cast("int") for c in bands[1:]), F.coalesce((F.col(f"m_{how}") - F.col("m_least") > 1e-6), F.lit(False)).cast("int")) > 0
        mixed = (F.col("m_count") > 0) & (F.col("i_count") > 0)
        one = b.groupBy("site").agg(
            F.count("*").alias("scored"),
            *(F.count_if(more(how)).alias(f"promoted_{how}") for how in ("near", "average")),
            F.count_if(mixed | F.col("near").isNull()).alias("lost_near"),
            F.count_if(mixed).alias("lost_mode"),
            F.count_if(F.col("partial")).alias("over_unsupported"),
            F.count_if((F.col("mode") == "measured") & mixed).alias("mixed_as_measured"),
        )
        one = one.select("site", F.lit(factor).alias("factor"), *one.columns[1:])
        out = one if out is None else out.unionByName(one)
    return out


def support_profiles(spark, sf_dir):
    """Cells by site, profile and grade, and their mean confidence: of the field's own rule and of two others."""
    cells = grid.to_cells(points(spark, sf_dir), COLS, ROWS)
    field = field_cells(spark, sf_dir)
    named = {"reference": field, "exponential": profiles.exponential(field), "survey": profiles.survey(field, profiles.standard_errors(cells))}
    out = None
    for name, f in named.items():
        one = f.select("site", F.lit(name).alias("profile"), grid.grade(F.col("confidence")).alias("grade"), "confidence")
        out = one if out is None else out.unionByName(one)
    return rounded(out.groupBy("site", "profile", "grade").agg(F.count("*").alias("cells"), F.avg("confidence").alias("mean_confidence")), "mean_confidence")


def crop_counts(spark, sf_dir):
    """Points of the nine crops of 20 a side of every site, and whether they are enough."""
    p = points(spark, sf_dir)
    ends = p.groupBy("site").agg(*(f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))))
    crops = predicates.crop_origins(ends, 20).select("site", "crop", "ox", "oy")
    inside = predicates.cropped(p.join(F.broadcast(crops), "site"), F.col("ox"), F.col("oy"), 20)  # nine rows a site
    out = inside.groupBy("site", "crop", "ox", "oy").agg(F.count("*").alias("points"), F.avg("x").alias("mean_x"), F.avg("z").alias("mean_z"))
    return rounded(out.withColumn("valid", F.col("points") >= predicates.MIN_RETURNS), "mean_x", "mean_z")


def guarded_field(spark, sf_dir):
    """Interpolated cells by site of a field that is guarded against data on one side: all, and their mean confidence."""
    cells = grid.to_cells(points(spark, sf_dir), COLS, ROWS).where("(row + col) % 7 > 1").groupBy(*grid.CELL).agg(F.count("*").alias("n"), F.avg("z").alias("z"))
    field = fill.support_field(cells.where("row between 10 and 80 and col < 90"), ROWS, COLS, radius=RADIUS, tile=32, guard=3, drop_single=True)
    return rounded(field.where("coverage = 'interpolated'").groupBy("site").agg(F.count("*").alias("cells"), F.avg("confidence").alias("mean_confidence"), F.sum("dist").alias("dist")), "mean_confidence")


def opened_floor(spark, sf_dir):
    """The despiked floor, opened by squares of five cells a side, and its steepness where it is measured."""
    floor = grid.despiked(grid.to_cells(points(spark, sf_dir), COLS, ROWS), 5).select(*grid.CELL, F.col("floor").alias("z"))
    out = fill.opened(floor, ROWS, COLS, 2, tile=32).join(fill.steepest(floor).select(*grid.CELL, "steepest"), grid.CELL, "left")
    return rounded(out, "opened", "steepest")


def typed_segments(spark, sf_dir):
    """Contour segments of the support field by site, provenance and grade: how many, their length, and the least supports of either kind."""
    found = contours.segments(rounded(field_cells(spark, sf_dir), "z"), 1.0).withColumns({"grade": grid.grade(F.col("confidence")), "length": F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))})
    out = found.groupBy("site", "prov", "grade").agg(F.count("*").alias("segments"), F.sum("length").alias("length"), F.sum("m").alias("m"), F.sum("i").alias("i"), F.count_if((F.col("prov") == "M") & (F.col("grade") == "dashed")).alias("measured_dashed"))
    return rounded(out, "length", to=4)


QUERIES = {f.__name__: f for f in (typed_segments, guarded_field, opened_floor, support_profiles, crop_counts, binning_rules, raster_accounting, raster_percentile, despiked_floor, support_field, coarse_resample)}

_POINTS = "p AS (SELECT l_returnflag AS site, (l_partkey % 1000) / 10.0::DOUBLE AS x, (l_orderkey % 1000) / 10.0::DOUBLE AS y, l_tax, l_suppkey FROM lineitem)"
_CELLS = f"""{_POINTS}, c AS (SELECT site, CAST(least(99, floor(y)) AS INTEGER) AS "row", CAST(least(99, floor(x)) AS INTEGER) AS col, 0.08::DOUBLE * x + 0.06::DOUBLE * y + 5 * l_tax AS z FROM p)"""


def _rule(name: str, x: str, y: str, row: str, col: str, where: str = "true") -> str:
    return f"""SELECT '{name}' AS rule, site, r AS "row", c AS col FROM (SELECT site, {col} AS c, {row} AS r FROM (SELECT site, {x} AS fx, {y} AS fy FROM p) WHERE {where}) WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 99"""


_ON = "fx BETWEEN 0 AND 100 AND fy BETWEEN 0 AND 100"
_RULES = " UNION ALL ".join([
    _rule("floor", "x", "y", "floor(fy)", "floor(fx)"),
    _rule("north_up", "x", "y", "ceil(fy) - 1", "floor(fx)"),
    _rule("north_up_1mm_boundary", "round_even(x / 0.001::DOUBLE, 0) * 0.001::DOUBLE", "round_even(y / 0.001::DOUBLE, 0) * 0.001::DOUBLE", f"CASE WHEN {_ON} THEN greatest(0, least(99, ceil(fy) - 1)) ELSE ceil(fy) - 1 END", f"CASE WHEN {_ON} THEN greatest(0, least(99, floor(fx))) ELSE floor(fx) END"),
    _rule("floor_centres", "x", "y", "floor(fy)", "floor(fx)", "fx BETWEEN 0.5 AND 99.5 AND fy BETWEEN 0.5 AND 99.5"),
])
#: The field by joining every empty cell with the measured ones around it, then every cell with its eight neighbours.
_FIELD = f"""{_CELLS}, m AS (SELECT site, "row" AS r, col AS c, count(*) AS n, avg(z) AS z FROM c GROUP BY ALL),
  a AS (SELECT s.site, i.r, j.c FROM (SELECT DISTINCT site FROM m) s, range(100) i(r), range(100) j(c)),
  o AS (SELECT a.* FROM a LEFT JOIN m ON m.site = a.site AND m.r = a.r AND m.c = a.c WHERE m.n IS NULL),
  w AS (SELECT o.site, o.r, o.c, greatest(abs(m.r - o.r), abs(m.c - o.c)) AS d, 1.0::DOUBLE / ((m.r - o.r) ** 2 + (m.c - o.c) ** 2) AS w, m.z FROM o JOIN m ON m.site = o.site AND abs(m.r - o.r) <= {RADIUS} AND abs(m.c - o.c) <= {RADIUS}),
  k AS (SELECT site, r, c, d, sum(count(*)) OVER (PARTITION BY site, r, c ORDER BY d) AS found FROM w GROUP BY site, r, c, d),
  l AS (SELECT site, r, c, min(d) AS dist, coalesce(min(d) FILTER (found >= 12) + 1, {RADIUS}) AS upto FROM k GROUP BY site, r, c),
  h AS (SELECT w.site, w.r, w.c, sum(w.w * w.z) / sum(w.w) AS z, any_value(l.dist) AS dist FROM w JOIN l ON l.site = w.site AND l.r = w.r AND l.c = w.c AND w.d <= l.upto GROUP BY w.site, w.r, w.c),
  f AS (SELECT site, r, c, n, z, 0 AS dist FROM m UNION ALL SELECT site, r, c, NULL, z, dist FROM h),
  e AS (SELECT f.site, f.r, f.c, f.z, dr, dc, CASE WHEN f.r + dr NOT BETWEEN 0 AND 99 THEN 'r' WHEN f.r IN (0, 99) THEN 'k' WHEN f.c + dc NOT BETWEEN 0 AND 99 THEN 'c' ELSE 'k' END AS how,
        least(99, greatest(0, f.r + dr)) AS nr, least(99, greatest(0, f.c + dc)) AS nc FROM f, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc)),
  v AS (SELECT e.*, coalesce(CASE WHEN how = 'k' OR a.z IS NULL OR b.z IS NULL THEN a.z ELSE 2 * a.z - b.z END, e.z) AS v FROM e LEFT JOIN f a ON a.site = e.site AND a.r = e.nr AND a.c = e.nc
        LEFT JOIN f b ON b.site = e.site AND b.r = CASE WHEN how = 'r' THEN e.nr - dr ELSE e.nr END AND b.c = CASE WHEN how = 'c' THEN e.nc - dc ELSE e.nc END),
  g AS (SELECT site, r, c, sqrt((sum(v * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / 8.0::DOUBLE) ** 2 + (sum(v * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / 8.0::DOUBLE) ** 2) AS slope FROM v GROUP BY site, r, c),
  t AS (SELECT site, quantile_cont(n, 0.5) AS target FROM m GROUP BY site),
  s AS (SELECT f.site, CAST(f.r AS INTEGER) AS "row", CAST(f.c AS INTEGER) AS col, f.z, CASE WHEN f.n IS NULL THEN 'interpolated' ELSE 'measured' END AS coverage, CAST(f.dist AS INTEGER) AS dist, g.slope,
        CAST(floor(100 * CASE WHEN f.n IS NOT NULL THEN least(1.0::DOUBLE, f.n / t.target) * f.n / (f.n + 3) ELSE 1.0::DOUBLE / (1 + f.dist) * (1 - 0.8::DOUBLE * least(1.0::DOUBLE, g.slope)) END + 0.5) AS BIGINT) AS confidence
        FROM f JOIN g ON g.site = f.site AND g.r = f.r AND g.c = f.c JOIN t ON t.site = f.site)"""


def _coarse(k: int) -> str:
    def more(how: str) -> str:
        return f"(coalesce(m_{how} - m_least > 1e-6, false) OR coalesce(i_{how} - i_least > 1e-6, false))"

    return f"""SELECT site, {k} AS factor, count(*) AS scored, count(*) FILTER (WHERE {more('near')}) AS promoted_near, count(*) FILTER (WHERE {more('average')}) AS promoted_average,
      count(*) FILTER (WHERE (m_count > 0 AND i_count > 0) OR near IS NULL) AS lost_near, count(*) FILTER (WHERE m_count > 0 AND i_count > 0) AS lost_mode, count(*) FILTER (WHERE cells < {k * k}) AS over_unsupported,
      count(*) FILTER (WHERE m_count > i_count AND i_count > 0) AS mixed_as_measured FROM (
        SELECT site, "row" // {k} AS br, col // {k} AS bc, count(*) AS cells, avg(confidence) FILTER (coverage = 'measured') AS m_average, min(confidence) FILTER (coverage = 'measured') AS m_least, count(*) FILTER (coverage = 'measured') AS m_count,
          avg(confidence) FILTER (coverage = 'interpolated') AS i_average, min(confidence) FILTER (coverage = 'interpolated') AS i_least, count(*) FILTER (coverage = 'interpolated') AS i_count,
          max(confidence) FILTER (coverage = 'measured' AND "row" % {k} = {k // 2 - 1} AND col % {k} = {k // 2}) AS m_near, max(confidence) FILTER (coverage = 'interpolated' AND "row" % {k} = {k // 2 - 1} AND col % {k} = {k // 2}) AS i_near,
          max(coverage) FILTER ("row" % {k} = {k // 2 - 1} AND col % {k} = {k // 2}) AS near FROM s GROUP BY ALL) GROUP BY site"""


_GUARDED = _FIELD.replace("avg(z) AS z FROM c GROUP BY ALL)", """avg(z) AS z FROM c WHERE ("row" + col) % 7 > 1 AND "row" BETWEEN 10 AND 80 AND col < 90 GROUP BY ALL)""", 1)

#: Segments of the field: blocks, levels, crossings of edges, pairs of these.
_TYPED = f"""{_FIELD}, s6 AS (SELECT * REPLACE (round(z, 6) AS z) FROM s), b AS (SELECT a.site, a."row", a.col, a.z AS z0, b.z AS z1, d.z AS z2, e.z AS z3, least(a.confidence, b.confidence, d.confidence, e.confidence) AS confidence,
          list_min(list_transform(list_filter([a, b, d, e], lambda q: q.coverage = 'measured'), lambda q: q.confidence)) AS m, list_min(list_transform(list_filter([a, b, d, e], lambda q: q.coverage = 'interpolated'), lambda q: q.confidence)) AS i FROM s6 a
          JOIN s6 b ON b.site = a.site AND b."row" = a."row" AND b.col = a.col + 1 JOIN s6 d ON d.site = a.site AND d."row" = a."row" + 1 AND d.col = a.col + 1 JOIN s6 e ON e.site = a.site AND e."row" = a."row" + 1 AND e.col = a.col),
        lv AS (SELECT *, unnest(range(CAST(floor(least(z0, z1, z2, z3) - 1e-9) AS BIGINT) + 1, CAST(floor(greatest(z0, z1, z2, z3) + 1e-9) AS BIGINT) + 1)) * 1.0::DOUBLE AS level FROM b),
        cr AS (SELECT *, list_filter([{{'x': col + 0.5::DOUBLE + least(1, greatest(0, (level - z0) / (z1 - z0))), 'y': "row" + 0.5::DOUBLE, 'hit': (z0 >= level) <> (z1 >= level)}}, {{'x': col + 1.5::DOUBLE, 'y': "row" + 0.5::DOUBLE + least(1, greatest(0, (level - z1) / (z2 - z1))), 'hit': (z1 >= level) <> (z2 >= level)}},
            {{'x': col + 0.5::DOUBLE + least(1, greatest(0, (level - z3) / (z2 - z3))), 'y': "row" + 1.5::DOUBLE, 'hit': (z3 >= level) <> (z2 >= level)}}, {{'x': col + 0.5::DOUBLE, 'y': "row" + 0.5::DOUBLE + least(1, greatest(0, (level - z0) / (z3 - z0))), 'hit': (z0 >= level) <> (z3 >= level)}}], lambda h: h.hit) AS e,
          (CASE WHEN abs(z0 + z2 - z1 - z3) < 1e-12 THEN (z0 + z1 + z2 + z3) / 4 ELSE (z0 * z2 - z1 * z3) / (z0 + z2 - z1 - z3) END >= level) = (z0 >= level) AS joined FROM lv),
        sg AS (SELECT *, unnest(CASE WHEN len(e) = 2 THEN [{{'p': e[1], 'q': e[2], 'k': 0}}] WHEN len(e) < 2 THEN [] WHEN joined THEN [{{'p': e[1], 'q': e[2], 'k': 0}}, {{'p': e[3], 'q': e[4], 'k': 1}}] ELSE [{{'p': e[1], 'q': e[4], 'k': 0}}, {{'p': e[2], 'q': e[3], 'k': 1}}] END) AS o FROM cr)"""

SQL = {
    "typed_segments": f"""WITH {_TYPED},
        tg AS (SELECT site, m, i, sqrt((o.p.x - o.q.x) ** 2 + (o.p.y - o.q.y) ** 2) AS len, CASE WHEN i IS NULL THEN 'M' WHEN m IS NULL THEN 'I' ELSE 'X' END AS prov, CASE WHEN confidence >= 66 THEN 'solid' WHEN confidence >= 33 THEN 'dashed' ELSE 'gap' END AS grade
          FROM sg WHERE o.p.x <> o.q.x OR o.p.y <> o.q.y)
        SELECT site, prov, grade, count(*) AS segments, round(sum(len), 4) AS length, CAST(sum(m) AS BIGINT) AS m, CAST(sum(i) AS BIGINT) AS i, count(*) FILTER (prov = 'M' AND grade = 'dashed') AS measured_dashed FROM tg GROUP BY site, prov, grade""",
    "guarded_field": f"""WITH {_GUARDED}, ry AS (SELECT s.site, s."row", s.col, s.dist, s.slope, list_sort(list(DISTINCT CASE WHEN m.r = s."row" THEN CASE WHEN m.c > s.col THEN 0 ELSE 180 END WHEN m.c = s.col THEN CASE WHEN m.r > s."row" THEN 90 ELSE 270 END
          WHEN m.r > s."row" THEN CASE WHEN m.c > s.col THEN 45 ELSE 135 END ELSE CASE WHEN m.c > s.col THEN 315 ELSE 225 END END) FILTER (m.n IS NOT NULL)) AS hits
        FROM s LEFT JOIN m ON m.site = s.site AND greatest(abs(m.r - s."row"), abs(m.c - s.col)) BETWEEN 1 AND 3 AND (m.r = s."row" OR m.c = s.col OR abs(m.r - s."row") = abs(m.c - s.col)) WHERE s.coverage = 'interpolated' GROUP BY ALL),
        gp AS (SELECT *, greatest(360 - hits[-1] + hits[1], coalesce(list_max(list_transform(range(1, len(hits)), lambda k: hits[k + 1] - hits[k])), 0)) > 180 AS aside FROM ry WHERE len(hits) > 1)
        SELECT site, count(*) AS cells, round(avg(floor(100 * 1.0::DOUBLE / (1 + dist) * (1 - 0.8::DOUBLE * least(1.0::DOUBLE, slope)) * CASE WHEN aside THEN 0.5 ELSE 1 END + 0.5)), 6) AS mean_confidence, CAST(sum(dist) AS BIGINT) AS dist FROM gp GROUP BY site""",
    "opened_floor": f"""WITH {_CELLS}, z0 AS (SELECT site, "row" AS r, col AS c, list_sort(list(z)) AS zs FROM c GROUP BY ALL), z1 AS (SELECT site, r, c, zs[least(len(zs) - 1, greatest(CAST(ceil(0.05::DOUBLE * len(zs)) AS BIGINT) - 1, CASE WHEN len(zs) >= 3 THEN 1 ELSE 0 END)) + 1] AS z FROM z0),
        z2 AS (SELECT site, r + dr AS r, c + dc AS c, min(z) AS z FROM z1, range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE r + dr BETWEEN 0 AND 99 AND c + dc BETWEEN 0 AND 99 GROUP BY ALL),
        z3 AS (SELECT site, r + dr AS r, c + dc AS c, max(z) AS z FROM z2, range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE r + dr BETWEEN 0 AND 99 AND c + dc BETWEEN 0 AND 99 GROUP BY ALL),
        st AS (SELECT a.site, a.r, a.c, coalesce(max(abs(a.z - b.z)), 0) AS steepest FROM z1 a LEFT JOIN z1 b ON b.site = a.site AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND b.r BETWEEN a.r - 1 AND a.r + 1 GROUP BY ALL)
        SELECT z3.site, CAST(z3.r AS INTEGER) AS "row", CAST(z3.c AS INTEGER) AS col, round(z3.z, 6) AS opened, round(st.steepest, 6) AS steepest FROM z3 LEFT JOIN st ON st.site = z3.site AND st.r = z3.r AND st.c = z3.c""",
    "support_profiles": f"""WITH {_FIELD}, se AS (SELECT site, "row" AS r, col AS c, sqrt((coalesce(var_samp(z), 0) + 0.0025::DOUBLE) / count(*)) AS se FROM c GROUP BY ALL),
        mid AS (SELECT site, list_sort(list(se))[count(*) // 2 + 1] AS se_mid FROM se GROUP BY site),
        pr AS (SELECT s.*, m.n, se.se, mid.se_mid FROM s LEFT JOIN m ON m.site = s.site AND m.r = s."row" AND m.c = s.col LEFT JOIN se ON se.site = s.site AND se.r = s."row" AND se.c = s.col JOIN mid ON mid.site = s.site),
        al AS (SELECT site, 'reference' AS profile, confidence AS f FROM pr UNION ALL
          SELECT site, 'exponential', floor(CASE WHEN coverage = 'measured' THEN 100 * (1 - exp(-n / 2.0::DOUBLE)) ELSE 50 * exp(-(dist - 1) / 1.5::DOUBLE) END + 0.5) FROM pr UNION ALL
          SELECT site, 'survey', floor(100 * exp(-(CASE WHEN coverage = 'measured' THEN se * se ELSE se_mid * se_mid + (0.05::DOUBLE * dist) ** 2 END) / 0.02::DOUBLE) + 0.5) FROM pr)
        SELECT site, profile, CASE WHEN f >= 66 THEN 'solid' WHEN f >= 33 THEN 'dashed' ELSE 'gap' END AS grade, count(*) AS cells, round(avg(f), 6) AS mean_confidence FROM al GROUP BY 1, 2, 3""",
    "crop_counts": f"""WITH {_POINTS}, e AS (SELECT site, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY site),
        o AS (SELECT site, CAST(i * 3 + j AS INTEGER) AS crop, CAST(floor(x0 + (j + 1) * 0.25::DOUBLE * (x1 - x0) - 10) AS BIGINT) AS ox, CAST(floor(y0 + (i + 1) * 0.25::DOUBLE * (y1 - y0) - 10) AS BIGINT) AS oy FROM e, range(3) a(i), range(3) b(j))
        SELECT o.site, crop, ox, oy, count(*) AS points, round(avg(x - ox), 6) AS mean_x, round(avg(0.08::DOUBLE * x + 0.06::DOUBLE * y + 5 * l_tax), 6) AS mean_z, count(*) >= 1000 AS valid
        FROM o JOIN p ON p.site = o.site AND x >= ox AND x < ox + 20 AND y >= oy AND y < oy + 20 GROUP BY ALL""",
    "binning_rules": f"""WITH {_POINTS}, u AS ({_RULES}), n AS (SELECT rule, site, "row", col, count(*) AS n FROM u GROUP BY ALL), k AS (SELECT DISTINCT site, "row", col FROM n),
        g AS (SELECT k.site, r.rule, coalesce(n.n, 0) AS n, coalesce(f.n, 0) AS plain FROM k CROSS JOIN (SELECT DISTINCT rule FROM n) r LEFT JOIN n ON n.rule = r.rule AND n.site = k.site AND n."row" = k."row" AND n.col = k.col
          LEFT JOIN n f ON f.rule = 'floor' AND f.site = k.site AND f."row" = k."row" AND f.col = k.col)
        SELECT site, rule, count(*) FILTER (n > 0) AS cells, CAST(sum(n) AS BIGINT) AS points, count(*) FILTER (n <> plain) AS differ FROM g GROUP BY site, rule""",
    "raster_accounting": f"""WITH {_POINTS}, q AS (SELECT site, x, y, l_suppkey % 97 <> 0 AND l_suppkey % 101 <> 0 AS ok FROM p), i AS (SELECT *, ok AND x <= 95 + 1e-6 AND y <= 95 + 1e-6 AS inside FROM q),
        a AS (SELECT site, count(*) AS source, count(*) FILTER (NOT ok) AS skipped, count(*) FILTER (ok AND NOT inside) AS outside, count(*) FILTER (inside) AS analysed,
          count(DISTINCT least(94, floor(y)) * 95 + least(94, floor(x))) FILTER (inside) AS filled, floor(min(x) FILTER (ok)) AS x0, floor(min(y) FILTER (ok)) AS y0, max(x) FILTER (ok) AS x1, max(y) FILTER (ok) AS y1 FROM i GROUP BY site)
        SELECT site, source, skipped, outside, analysed, filled, array_to_string(list_filter([CASE WHEN skipped > 0 THEN skipped || ' not finite' END, CASE WHEN outside > 0 THEN outside || ' outside' END,
          CASE WHEN filled < 9025 THEN (9025 - filled) || ' cells empty' END], lambda w: w IS NOT NULL), '; ') AS warnings, x0, y0, CAST(floor(x1 - x0) + 1 AS INTEGER) AS cols, CAST(floor(y1 - y0) + 1 AS INTEGER) AS rows FROM a""",
    "raster_percentile": f"""WITH {_CELLS} SELECT site, "row", col, round(quantile_cont(z, 0.25), 6) AS q25, round(max(z), 6) AS top, round(quantile_cont(z, 0.5), 6) AS odd FROM c GROUP BY ALL""",
    "despiked_floor": f"""WITH {_CELLS}, g AS (SELECT site, "row", col, list_sort(list(z)) AS zs FROM c GROUP BY ALL)
        SELECT site, "row", col, round(zs[least(len(zs) - 1, greatest(CAST(ceil(0.05::DOUBLE * len(zs)) AS BIGINT) - 1, CASE WHEN len(zs) >= 3 THEN 1 ELSE 0 END)) + 1], 6) AS floor, len(zs) AS n FROM g""",
    "support_field": f"""WITH {_FIELD} SELECT site, "row", col, round(z, 6) AS z, coverage, dist, round(slope, 6) AS slope, confidence FROM s""",
    "coarse_resample": f"WITH {_FIELD} {_coarse(2)} UNION ALL {_coarse(4)}",
}
