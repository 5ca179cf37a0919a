"""Queries on ground: nearest data, floors without holes, ground points, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.operators import geodesic, grid, ground, nearest, profiles
from tellurion.plans.rasters import _CELLS, _FIELD, COLS, RADIUS, ROWS, field_cells, rounded
from tellurion.sources.tables import points

WIDEST, PERCENT = 3, 5
RULE = {"slope": 0.0503, "base": 0.1501, "cap": 0.2851}
SCALE = 0.0307
#: Every how many suppliers' returns are classed as ground by whoever took them.
CLASSED = 3


def inpainted_floor(spark, sf_dir):
    """The despiked floor of every cell, where there is none that of the nearest cell."""
    floor = grid.despiked(grid.to_cells(points(spark, sf_dir), COLS, ROWS), PERCENT)
    return rounded(nearest.inpainted(floor.select(*grid.CELL, F.col("floor").alias("z")), ROWS, COLS, tile=32, reach=2), "z")


def ground_points(spark, sf_dir):
    """By cell: the ground's height and steepness, all points and those on the ground."""
    placed = grid.to_cells(points(spark, sf_dir), COLS, ROWS)
    found = ground.ground_surface(placed, ROWS, COLS, WIDEST, percent=PERCENT, tile=32, **RULE)
    labelled = ground.on_ground(placed, found, RULE["base"], SCALE, RULE["cap"])
    out = labelled.groupBy(*grid.CELL).agg(F.min("surface").alias("surface"), F.count("*").alias("points"), F.count_if("ground").alias("ground"), F.max(F.when(F.col("ground"), F.col("z"))).alias("highest"))
    return rounded(out, "surface", "highest")


def trusted_surface(spark, sf_dir):
    """The least height by cell of the points that are classed as ground, the nearest one's in cells without."""
    classed = points(spark, sf_dir).withColumn("class", F.when(F.floor(F.col("x") * 10 + 0.5).cast("long") % CLASSED == 0, 2).otherwise(1))
    least = grid.to_cells(ground.trusted(classed), COLS, ROWS).groupBy(*grid.CELL).agg(F.min("z").alias("z"))
    return rounded(nearest.inpainted(least, ROWS, COLS, tile=32), "z")


def distance_to_data(spark, sf_dir):
    """How far the cells without data are from any, by steps and in a straight line: cells at each distance."""
    cells = grid.to_cells(points(spark, sf_dir), COLS, ROWS).select(*grid.CELL).distinct()
    both = [nearest.nearest(cells, ROWS, COLS, tile=32, reach=2, straight=s).where("dist > 0").select("site", F.lit(name).alias("how"), "dist", (F.col("near_row") * COLS + F.col("near_col")).alias("source")) for name, s in (("steps", False), ("line", True))]
    return both[0].unionByName(both[1]).groupBy("site", "how", "dist").agg(F.count("*").alias("cells"), F.sum("source").alias("sources"))


def geodesic_heights(spark, sf_dir):
    """Mean heights of the cells, empty ones filled by distance over the ground."""
    cells = grid.to_cells(points(spark, sf_dir), COLS, ROWS).groupBy(*grid.CELL).agg(F.avg("z").alias("z"))
    return rounded(geodesic.geodesic_fill(cells, ROWS, COLS, radius=RADIUS, tile=32), "z")


def kriging_support(spark, sf_dir):
    """Support of the field's cells by the variance that their neighbours leave."""
    return profiles.kriging(field_cells(spark, sf_dir), ROWS, COLS, tile=32).select("site", "row", "col", "coverage", "confidence")


def slope_aspect(spark, sf_dir):
    """Slope and aspect of the field's cells, on cells half as wide as high, and which of them rest on cells that aren't there."""
    return rounded(ground.derivatives(field_cells(spark, sf_dir).where("dist < 2"), ROWS, COLS, (0.5, 1.0), 2.0, tile=32), "slope", "aspect", to=5)


QUERIES = {f.__name__: f for f in (slope_aspect, geodesic_heights, kriging_support, inpainted_floor, ground_points, trusted_surface, distance_to_data)}

_FLOOR = f"""{_CELLS}, fz AS (SELECT site, "row" AS r, col AS c, list_sort(list(z)) AS zs FROM c GROUP BY ALL),
  d0 AS (SELECT site, r, c, zs[least(len(zs) - 1, greatest(CAST(ceil({PERCENT / 100}::DOUBLE * len(zs)) AS BIGINT) - 1, CASE WHEN len(zs) >= 3 THEN 1 ELSE 0 END)) + 1] AS z FROM fz)"""


def _filled(data: str) -> str:
    """Every cell of the grid with the height of the nearest cell of ``data``."""
    return f"""ga AS (SELECT s.site, i.r, j.c FROM (SELECT DISTINCT site FROM {data}) s, range(100) i(r), range(100) j(c)),
  go AS (SELECT ga.* FROM ga ANTI JOIN {data} d ON d.site = ga.site AND d.r = ga.r AND d.c = ga.c),
  w0 AS (SELECT site, r, c, z, true AS had_data FROM {data} UNION ALL
    SELECT go.site, go.r, go.c, arg_min(d.z, greatest(abs(d.r - go.r), abs(d.c - go.c)) * 1000000 + d.r * 1000 + d.c), false FROM go JOIN {data} d ON d.site = go.site GROUP BY go.site, go.r, go.c)"""


def _progressive() -> str:
    out = ""
    for b in range(1, WIDEST + 1):
        most = min(max(RULE["cap"], RULE["base"]), RULE["base"] + RULE["slope"] * b)
        window = f"range(-{b}, {b + 1}) a(dr), range(-{b}, {b + 1}) b(dc) WHERE r + dr BETWEEN 0 AND 99 AND c + dc BETWEEN 0 AND 99 GROUP BY ALL"
        out += f""", e{b} AS (SELECT site, r + dr AS r, c + dc AS c, min(z) AS z FROM w{b - 1}, {window}), o{b} AS (SELECT site, r + dr AS r, c + dc AS c, max(z) AS z FROM e{b}, {window}),
  w{b} AS (SELECT w.site, w.r, w.c, CASE WHEN w.z - o.z > {most!r}::DOUBLE THEN o.z ELSE w.z END AS z FROM w{b - 1} w JOIN o{b} o ON o.site = w.site AND o.r = w.r AND o.c = w.c)"""
    return out


#: Ways from every empty cell over the filled ground, shortened until none gets shorter; they end at measured cells.
_WAYS = f"""{_FIELD}, gf AS MATERIALIZED (SELECT site, CAST(r * 100 + c AS INTEGER) AS cell, r, c, z, n IS NOT NULL AS have FROM f),
  gn AS MATERIALIZED (SELECT a.site, a.cell, b.cell AS to_, b.r, b.c, sqrt(((dr <> 0)::INTEGER + (dc <> 0)::INTEGER)::DOUBLE + (b.z - a.z) ** 2) AS step FROM gf a, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc), gf b
    WHERE NOT a.have AND (dr <> 0 OR dc <> 0) AND b.site = a.site AND b.cell = a.cell + dr * 100 + dc AND b.c = a.c + dc),
  gw(site, start, cell, cost) USING KEY (site, start, cell) AS (SELECT site, cell, cell, 0.0::DOUBLE FROM gf WHERE NOT have
    UNION SELECT q.site, q.start, q.cell, q.cost FROM (SELECT w.site, w.start, n.to_ AS cell, min(w.cost + n.step) AS cost FROM gw w JOIN gn n ON n.site = w.site AND n.cell = w.cell
        WHERE abs(n.r - w.start // 100) <= {RADIUS} AND abs(n.c - w.start % 100) <= {RADIUS} GROUP BY ALL) q LEFT JOIN recurring.gw o ON o.site = q.site AND o.start = q.start AND o.cell = q.cell WHERE o.cost IS NULL OR q.cost < o.cost),
  gk AS (SELECT w.site, w.start, w.cost, d.z, row_number() OVER (PARTITION BY w.site, w.start ORDER BY w.cost, w.cell) AS k FROM gw w JOIN gf d ON d.site = w.site AND d.cell = w.cell AND d.have),
  gb AS (SELECT site, start, sum(z / cost ** 2) / sum(1 / cost ** 2) AS z FROM gk WHERE k <= 12 GROUP BY ALL)"""


def _eliminated() -> str:
    """The matrix of covariances with its vector below and beside, eliminated row by row; its corner is the share, less."""
    out, last = "", "k0"
    for p in range(1, profiles.USED + 1):
        out += f""", k{p} AS (SELECT * REPLACE (CASE WHEN k < {p} THEN m ELSE list_transform(m, lambda o, i: CASE WHEN i > {p} THEN list_transform(o, lambda v, j: v - o[{p}] / m[{p}][{p}] * m[{p}][j]) ELSE o END) END AS m) FROM {last})"""
        last = f"k{p}"
    return out


_KRIGING = f"""{_FIELD}, nb AS (SELECT s.site, s."row" AS r, s.col AS c, s.coverage, coalesce(list({{'r': m.r, 'c': m.c, 'n': m.n, 'h': sqrt((m.r - s."row") ** 2 + (m.c - s.col) ** 2)}} ORDER BY (m.r - s."row") ** 2 + (m.c - s.col) ** 2, m.r, m.c) FILTER (m.n IS NOT NULL), [])[1:{profiles.USED}] AS nb
    FROM s LEFT JOIN m ON m.site = s.site AND abs(m.r - s."row") <= {profiles.REACH} AND abs(m.c - s.col) <= {profiles.REACH} GROUP BY ALL),
  k0 AS (SELECT site, r, c, coverage, len(nb) AS k, list_append(list_transform(nb, lambda p, i: list_append(list_transform(nb, lambda q, j: exp(-sqrt((p.r - q.r) ** 2 + (p.c - q.c) ** 2) / 3.0::DOUBLE) + CASE WHEN i = j THEN 0.5::DOUBLE / p.n ELSE 0 END), exp(-p.h / 3.0::DOUBLE))),
    list_append(list_transform(nb, lambda q: exp(-q.h / 3.0::DOUBLE)), 0.0::DOUBLE)) AS m FROM nb){_eliminated()}"""

_OUT = 'SELECT site, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(z, 6) AS z, had_data FROM w0'
_DISTANCE = """SELECT site, '{how}' AS how, CAST(key // 1000000 AS BIGINT) AS dist, count(*) AS cells, CAST(sum(key % 1000000) AS BIGINT) AS sources FROM
  (SELECT go.site, go.r, go.c, min(CAST({by} AS BIGINT) * 1000000 + d.r * 100 + d.c) AS key FROM go JOIN d0 d ON d.site = go.site GROUP BY go.site, go.r, go.c) GROUP BY ALL"""
#: The field less its cells far from data; neighbours are looked up there.
_NEAR = _FIELD.replace("e AS (SELECT f.site, f.r", "fd AS (SELECT * FROM f WHERE dist < 2), e AS (SELECT f.site, f.r", 1)
_NEAR = _NEAR.replace("y(dc)),", "y(dc) WHERE f.dist < 2),", 1).replace("LEFT JOIN f a ON", "LEFT JOIN fd a ON", 1).replace("LEFT JOIN f b ON", "LEFT JOIN fd b ON", 1)
SQL = {
    "slope_aspect": f"""WITH {_NEAR}, gr AS (SELECT site, r, c, sum(v * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / 4.0::DOUBLE AS dx, sum(v * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / 8.0::DOUBLE AS dy, r IN (0, 99) OR c IN (0, 99) AS edge FROM v GROUP BY site, r, c),
        hl AS (SELECT a.site, a.r, a.c, count(*) AS near FROM fd a JOIN fd b ON b.site = a.site AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 GROUP BY ALL)
        SELECT gr.site, CAST(gr.r AS INTEGER) AS "row", CAST(gr.c AS INTEGER) AS col, round(2 * sqrt(dx ** 2 + dy ** 2), 5) AS slope, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE atan2(-dy, -dx) END, 5) AS aspect, edge OR near < 9 AS synthesised FROM gr JOIN hl ON hl.site = gr.site AND hl.r = gr.r AND hl.c = gr.c""",
    "geodesic_heights": f"""WITH RECURSIVE {_WAYS} SELECT gf.site, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(coalesce(gb.z, gf.z), 6) AS z, have AS measured FROM gf LEFT JOIN gb ON gb.site = gf.site AND gb.start = gf.cell""",
    "kriging_support": f"""WITH {_KRIGING} SELECT site, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, coverage, CAST(floor(100 * least(1, greatest(0, -m[k + 1][k + 1])) + 0.5) AS BIGINT) AS confidence FROM k{profiles.USED}""",
    "inpainted_floor": f"WITH {_FLOOR}, {_filled('d0')} {_OUT}",
    "ground_points": f"""WITH {_FLOOR}, {_filled('d0')}{_progressive()},
  st AS (SELECT a.site, a.r, a.c, any_value(a.z) AS z, coalesce(max(abs(a.z - b.z)), 0) AS slope FROM w{WIDEST} a LEFT JOIN w{WIDEST} b ON b.site = a.site AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND b.r BETWEEN a.r - 1 AND a.r + 1 GROUP BY a.site, a.r, a.c),
  lb AS (SELECT c.*, st.z AS surface, c.z - st.z <= least({max(RULE["cap"], RULE["base"])!r}::DOUBLE, {RULE["base"]!r}::DOUBLE + {SCALE!r}::DOUBLE * st.slope) AS ground FROM c JOIN st ON st.site = c.site AND st.r = c."row" AND st.c = c.col)
  SELECT site, "row", col, round(min(surface), 6) AS surface, count(*) AS points, count(*) FILTER (ground) AS ground, round(max(z) FILTER (ground), 6) AS highest FROM lb GROUP BY site, "row", col""",
    "trusted_surface": f"""WITH {_CELLS.replace("AS z FROM p)", f"AS z FROM p WHERE CAST(floor(x * 10 + 0.5) AS BIGINT) % {CLASSED} = 0)")}, d0 AS (SELECT site, "row" AS r, col AS c, min(z) AS z FROM c GROUP BY ALL), {_filled('d0')} {_OUT}""",
    "distance_to_data": f"""WITH {_CELLS}, d0 AS (SELECT DISTINCT site, "row" AS r, col AS c, 0 AS z FROM c), {_filled('d0')} {_DISTANCE.format(how="steps", by="greatest(abs(d.r - go.r), abs(d.c - go.c))")} UNION ALL {_DISTANCE.format(how="line", by="(d.r - go.r) ** 2 + (d.c - go.c) ** 2")}""",
}
