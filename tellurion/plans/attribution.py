"""Queries on where segments come from, what chords pass over, and points in polygons, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.operators import attribution, chords, contours, grid, simplify, stitching
from tellurion.plans.lines import _LINES, field_segments
from tellurion.plans.rasters import COLS, ROWS, field_cells, rounded
from tellurion.plans.records import TOLERANCE, VERTICES, _thinned
from tellurion.sources.tables import vertices

#: Tolerance of simplified contours, in cells.
CELL_TOLERANCE = 1.0


def recovered_blocks(spark, sf_dir):
    """Segments of the field's contours and the blocks that they are found to come from."""
    cells = rounded(field_cells(spark, sf_dir), "z")
    segments = stitching.numbered(contours.segments(cells, 1.0, parts=True)).select("site", "level", "seg", "x1", "y1", "x2", "y2", "confidence")
    out = attribution.source_blocks(segments, cells, ["level", "seg"])
    return out.select("site", "level", "seg", F.col("block_row").cast("int").alias("row"), F.col("block_col").cast("int").alias("col"), F.col("block_prov").alias("prov"), "block_confidence", "candidates", "alike")


def midpoint_evidence(spark, sf_dir):
    """Segments of the field's contours with the evidence at their middle, of one cell and of four."""
    cells = field_cells(spark, sf_dir)
    s = field_segments(spark, sf_dir).select("site", "level", "seg", "x1", "y1", "x2", "y2")
    out = attribution.block_evidence(attribution.cell_evidence(s, cells), cells, ROWS, COLS)
    return out.drop("x1", "y1", "x2", "y2")


def chords_over_gaps(spark, sf_dir):
    """Contours of the measured cells alone, simplified: by line the spans, those of several segments, and chords and sources over cells without data."""
    cells = rounded(field_cells(spark, sf_dir).where("coverage = 'measured'"), "z")
    v = stitching.line_vertices(stitching.stitched(stitching.numbered(contours.segments(cells, 1.0, parts=True)), tile=32))
    n = F.count("*").over(stitching.Window.partitionBy("site", "level", "line"))
    again = v.withColumn("n", n).where("closed and seq = 0").withColumn("seq", F.col("n")).drop("n")
    v = rounded(v.unionByName(again), "x", "y").select("site", F.concat_ws("/", "site", F.col("level").cast("long"), "line").alias("line_id"), F.lit(0).alias("run"), "seq", "x", "y")
    kept = simplify.thinned(v, CELL_TOLERANCE, {"keep": None})
    span = F.count_if("keep").over(stitching.Window.partitionBy("line_id").orderBy("seq"))
    source = chords.chords_of(kept.withColumn("span", span), ["site", "line_id"])
    spans = chords.chords_of(kept.where("keep"), ["site", "line_id"])
    whole = grid.to_cells(_grid_points(spark, sf_dir)).select(*grid.CELL).distinct().join(cells.select(*grid.CELL), grid.CELL, "left_anti")
    over = chords.over_cells(spans, whole, ["line_id", "seq"], ROWS, COLS).groupBy("site", "line_id").agg(F.count("*").alias("spans"), F.count_if(F.col("seq2") - F.col("seq") > 1).alias("several"), F.count_if("over").alias("over"))
    under = chords.over_cells(source, whole, ["line_id", "seq"], ROWS, COLS).groupBy("site", "line_id").agg(F.count("*").alias("segments"), F.count_if("over").alias("sources_over"))
    return over.join(under, ["site", "line_id"])


def _grid_points(spark, sf_dir):
    """A point in every cell of every site's grid."""
    sites = field_cells(spark, sf_dir).select("site").distinct()
    at = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return sites.withColumn("r", at(ROWS)).withColumn("c", at(COLS)).select("site", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"), F.lit(0.0).alias("z"))


def gap_bridges(spark, sf_dir):
    """Simplified lines by line: chords, and those over a vertex without support; of lines as a whole and of stretches between gaps."""
    v = vertices(spark, sf_dir)
    gap = F.col("prov") == "U"
    whole = chords.bridges(simplify.thinned(v.withColumn("run", F.lit(0)), TOLERANCE, {"keep": None}), ["line_id"], "keep", gap)
    parts = simplify.simplified(v, TOLERANCE).select("line_id", "run", "seq", "x", "y", "prov", "keep")
    every = parts.unionByName(v.where(gap).select("line_id", F.lit(None).cast("long").alias("run"), "seq", "x", "y", "prov", F.lit(False).alias("keep")))
    between = chords.bridges(every, ["line_id"], "keep", gap, "run")
    out = whole.select(F.lit("whole").alias("how"), "line_id", "bridge").unionByName(between.select(F.lit("between gaps").alias("how"), "line_id", "bridge"))
    return out.groupBy("how", "line_id").agg(F.count("*").alias("chords"), F.count_if("bridge").alias("bridges"))


def points_in_contours(spark, sf_dir):
    """Points inside the closed contours of every level, rings within rings counted out again."""
    edges = stitching.stitched(field_segments(spark, sf_dir), tile=32).where("closed")
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = t.select(F.col("l_returnflag").alias("site"), "l_orderkey", "l_linenumber", ((F.col("l_partkey") % 1000) / 10.0 + 0.013).alias("x"), ((F.col("l_orderkey") % 1000) / 10.0 + 0.017).alias("y"))
    found = attribution.inside(p, edges, ["site"], ["level"], ["l_orderkey", "l_linenumber", "x", "y"])
    return found.groupBy("site", "level").agg(F.count("*").alias("points"), F.sum("l_orderkey").alias("orders"), F.sum("l_linenumber").alias("lines"))


QUERIES = {f.__name__: f for f in (recovered_blocks, midpoint_evidence, chords_over_gaps, gap_bridges, points_in_contours)}

_BLOCK = """SELECT a.site, a."row" AS r, a.col AS c, least(a.confidence, b.confidence, d.confidence, e.confidence) AS confidence, list_sort(list_distinct([a.coverage, b.coverage, d.coverage, e.coverage])) AS kinds, {more}
    FROM s6 a JOIN s6 b ON b.site = a.site AND b."row" = a."row" AND b.col = a.col + 1 JOIN s6 d ON d.site = a.site AND d."row" = a."row" + 1 AND d.col = a.col + 1 JOIN s6 e ON e.site = a.site AND e."row" = a."row" + 1 AND e.col = a.col"""
_MEASURED = _LINES.replace("FROM s), b AS", "FROM s WHERE coverage = 'measured'), b AS", 1)
#: A chord and a cell: the share of the chord in the cell's interior.
_OVER = """(SELECT count(DISTINCT (q.line_id, q.seq)) FROM {0} q JOIN un ON un.site = q.site AND un.r BETWEEN floor(least(q.y, q.y2)) AND floor(greatest(q.y, q.y2)) AND un.c BETWEEN floor(least(q.x, q.x2)) AND floor(greatest(q.x, q.x2))
    WHERE q.line_id = {1} AND (abs(q.x2 - q.x) >= 1e-15 OR (q.x > un.c AND q.x < un.c + 1)) AND (abs(q.y2 - q.y) >= 1e-15 OR (q.y > un.r AND q.y < un.r + 1))
    AND least(1, CASE WHEN abs(q.x2 - q.x) < 1e-15 THEN 1 ELSE greatest((un.c - q.x) / (q.x2 - q.x), (un.c + 1 - q.x) / (q.x2 - q.x)) END, CASE WHEN abs(q.y2 - q.y) < 1e-15 THEN 1 ELSE greatest((un.r - q.y) / (q.y2 - q.y), (un.r + 1 - q.y) / (q.y2 - q.y)) END)
      - greatest(0, CASE WHEN abs(q.x2 - q.x) < 1e-15 THEN 0 ELSE least((un.c - q.x) / (q.x2 - q.x), (un.c + 1 - q.x) / (q.x2 - q.x)) END, CASE WHEN abs(q.y2 - q.y) < 1e-15 THEN 0 ELSE least((un.r - q.y) / (q.y2 - q.y), (un.r + 1 - q.y) / (q.y2 - q.y)) END) > 1e-9)"""
_PLAIN_LINES = "fl2 AS (SELECT *, lag(seq) OVER q IS NULL OR lead(seq) OVER q IS NULL AS is_end FROM {0} WINDOW q AS (PARTITION BY line_id, run ORDER BY seq)), ol2 AS (SELECT *, NULL AS len FROM fl2)"

SQL = {
    "recovered_blocks": f"""WITH RECURSIVE {_LINES}, bk AS ({_BLOCK.format(more="0 AS nothing")}),
        cd AS (SELECT g.site, g.level, g.seg, g.confidence AS own, bk.*, (((g.x1 + g.x2) / 2) - (bk.c + 1)) ** 2 + (((g.y1 + g.y2) / 2) - (bk.r + 1)) ** 2 AS off FROM gs g JOIN bk ON bk.site = g.site AND bk.c BETWEEN floor(least(g.x1, g.x2)) - 2 AND floor(greatest(g.x1, g.x2)) + 1 AND bk.r BETWEEN floor(least(g.y1, g.y2)) - 2 AND floor(greatest(g.y1, g.y2)) + 1
          WHERE least(g.x1, g.x2) >= bk.c + 0.5::DOUBLE - 1e-9 AND greatest(g.x1, g.x2) <= bk.c + 1.5::DOUBLE + 1e-9 AND least(g.y1, g.y2) >= bk.r + 0.5::DOUBLE - 1e-9 AND greatest(g.y1, g.y2) <= bk.r + 1.5::DOUBLE + 1e-9),
        pk AS (SELECT *, count(*) OVER (PARTITION BY site, level, seg) AS candidates, row_number() OVER (PARTITION BY site, level, seg ORDER BY confidence <> own, off, r, c) AS k FROM cd)
        SELECT gs.site, gs.level, gs.seg, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CASE WHEN len(kinds) = 2 THEN 'X' WHEN kinds[1] = 'measured' THEN 'M' ELSE 'I' END AS prov, pk.confidence AS block_confidence, coalesce(candidates, 0) AS candidates, pk.confidence = own AS alike
        FROM gs LEFT JOIN pk ON pk.site = gs.site AND pk.level = gs.level AND pk.seg = gs.seg AND k = 1""",
    "midpoint_evidence": f"""WITH RECURSIVE {_LINES}, ce AS (SELECT s.site, s."row" AS r, s.col AS c, coalesce(m.n, 0) AS n, s.dist, s.z FROM s LEFT JOIN m ON m.site = s.site AND m.r = s."row" AND m.c = s.col),
        q AS (SELECT site, level, seg, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM gs),
        k4 AS (SELECT q.site, q.level, q.seg, min(ce.n) FILTER (ce.n > 0) AS block_m, -max(ce.dist) FILTER (ce.n = 0) AS block_i, q.level BETWEEN min(ce.z) - 1e-6 AND max(ce.z) + 1e-6 AS bracketed FROM q JOIN ce ON ce.site = q.site
          AND ce.r - greatest(0, least(98, floor(my - 0.5))) BETWEEN 0 AND 1 AND ce.c - greatest(0, least(98, floor(mx - 0.5))) BETWEEN 0 AND 1 GROUP BY q.site, q.level, q.seg)
        SELECT q.site, q.level, q.seg, CASE WHEN ce.n > 0 THEN ce.n END AS cell_m, CASE WHEN ce.n = 0 THEN -ce.dist::DOUBLE END AS cell_i, block_m, block_i::DOUBLE AS block_i, bracketed FROM q LEFT JOIN ce ON ce.site = q.site AND ce.r = floor(my) AND ce.c = floor(mx) JOIN k4 ON k4.site = q.site AND k4.level = q.level AND k4.seg = q.seg""",
    "chords_over_gaps": f"""WITH RECURSIVE {_MEASURED}, lv2 AS (SELECT site, site || '/' || CAST(level AS BIGINT) || '/' || line AS line_id, 0 AS run, place AS seq, round(x1, 6) AS x, round(y1, 6) AS y FROM ln
          UNION ALL SELECT site, site || '/' || CAST(level AS BIGINT) || '/' || line, 0, place + 1, round(x2, 6), round(y2, 6) FROM ln WHERE place = n - 1), {_PLAIN_LINES.format("lv2")}, {_thinned('dp', 'is_end', CELL_TOLERANCE, 'fl2', 'ol2')},
        un AS MATERIALIZED (SELECT s0.site, i.r, j.c FROM (SELECT DISTINCT site FROM m) s0, range(100) i(r), range(100) j(c) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.site = s0.site AND m.r = i.r AND m.c = j.c)),
        sc AS (SELECT * FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fl2 WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL),
        sp AS (SELECT * FROM (SELECT f.*, lead(f.seq) OVER w AS seq2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fl2 f JOIN dp_k k ON k.line_id = f.line_id AND k.seq = f.seq WINDOW w AS (PARTITION BY f.line_id ORDER BY f.seq)) WHERE x2 IS NOT NULL)
        SELECT a.site, a.line_id, a.spans, a.several, coalesce({_OVER.format('sp', 'a.line_id')}, 0) AS over, b.segments, coalesce({_OVER.format('sc', 'a.line_id')}, 0) AS sources_over FROM (SELECT site, line_id, count(*) AS spans, count(*) FILTER (seq2 - seq > 1) AS several FROM sp GROUP BY ALL) a
        JOIN (SELECT line_id, count(*) AS segments FROM sc GROUP BY line_id) b ON b.line_id = a.line_id""",
    "gap_bridges": " UNION ALL ".join(
        f"""(WITH RECURSIVE {VERTICES}, lv2 AS ({rows}), {_PLAIN_LINES.format("lv2")}, {_thinned('dp', 'is_end', f='fl2', o='ol2')}, ch AS (SELECT * FROM (SELECT f.line_id, f.seq, lead(f.seq) OVER (PARTITION BY f.line_id, f.run ORDER BY f.seq) AS seq2 FROM fl2 f WHERE f.is_end OR (line_id, seq) IN (SELECT (line_id, seq) FROM dp_k)) WHERE seq2 IS NOT NULL)
        SELECT '{how}' AS how, ch.line_id, count(*) AS chords, count(*) FILTER (EXISTS (SELECT 1 FROM w u WHERE u.line_id = ch.line_id AND u.prov = 'U' AND u.seq > ch.seq AND u.seq < ch.seq2)) AS bridges FROM ch GROUP BY ch.line_id)"""
        for how, rows in (("whole", "SELECT line_id, 0 AS run, seq, x, y FROM w"), ("between gaps", "SELECT * FROM (SELECT line_id, sum(CASE WHEN prov = 'U' THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY seq) AS run, seq, x, y, prov FROM w) WHERE prov <> 'U'"))
    ),
    "points_in_contours": f"""WITH RECURSIVE {_LINES}, pt AS (SELECT l_returnflag AS site, l_orderkey, l_linenumber, (l_partkey % 1000) / 10.0::DOUBLE + 0.013::DOUBLE AS x, (l_orderkey % 1000) / 10.0::DOUBLE + 0.017::DOUBLE AS y FROM lineitem),
        cr2 AS (SELECT pt.site, ln.level, l_orderkey, l_linenumber, x, count(*) AS times FROM pt JOIN ln ON ln.site = pt.site AND (ln.y1 > pt.y) <> (ln.y2 > pt.y) WHERE ln.closed AND pt.x < (ln.x2 - ln.x1) * (pt.y - ln.y1) / (ln.y2 - ln.y1) + ln.x1 GROUP BY ALL)
        SELECT site, level, count(*) AS points, CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM cr2 WHERE times % 2 = 1 GROUP BY site, level""",
}
