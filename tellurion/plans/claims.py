"""Queries on what records claim: checkpoints, dissolved lines, position uncertainty, provenance by grade, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tellurion.operators import audits, contours, evidence, grid, profiles, simplify, stitching
from tellurion.plans.attribution import _MEASURED, _PLAIN_LINES, CELL_TOLERANCE
from tellurion.plans.rasters import _FIELD, COLS, ROWS, field_cells, rounded
from tellurion.plans.records import _EDGES, _PLACED, TOLERANCE, _thinned
from tellurion.sources.tables import points, vertices

#: Every how many points are checkpoints, how far these are moved, and how much is added to their height.
EVERY, MOVED, RAISED = 7, 2.5, 0.05
#: A target count that is given, spans that are reported, widths of bins of support, and a tolerance wider than the usual.
GIVEN, WORST, BINS, WIDER = 4.0, 10, (0, 10, 25), 30.0


def checkpoint_audit(spark, sf_dir):
    """Errors of the support field at checkpoints by channel and band of support; those off the grid or on cells without support are counted."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = (F.col("l_partkey") % 1000) / 10.0, (F.col("l_orderkey") % 1000) / 10.0
    checks = t.where(F.col("l_suppkey") % EVERY == 0).select(F.col("l_returnflag").alias("site"), (x + MOVED).alias("x"), y.alias("y"), (0.08 * x + 0.06 * y + 5 * F.col("l_tax") + RAISED).alias("z"))
    e = audits.checkpoint_errors(checks, field_cells(spark, sf_dir).where("dist < 2"), ROWS, COLS).withColumn("band", grid.grade(F.col("confidence")))
    scored = F.col("error").isNotNull()
    out = e.groupBy("site", "channel", F.when(scored, F.col("band")).alias("band")).agg(F.count("*").alias("checkpoints"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.percentile("error", F.lit(0.5)).alias("median_error"))
    return rounded(out, "rmse", "median_error", to=5)


def dissolve_audit(spark, sf_dir):
    """Lines whose edges are dissolved into one record by each rule: those that claim more support or less provenance than their edges have."""
    return audits.dissolve_scores(audits.dissolved(evidence.edges(vertices(spark, sf_dir))))


def provenance_by_grade(spark, sf_dir):
    """Spans by display grade, and those whose provenance can't be told from the grade, or from their two end edges."""
    edges = evidence.runs(evidence.edges(vertices(spark, sf_dir)))
    grade = grid.grade(F.min(F.least("m", "i")))
    found = audits.provenance_losses(edges, ["line_id", "span"], grade)
    return found.groupBy("grade").agg(F.count("*").alias("spans"), F.count_if("grade_loss").alias("grade_loss"), F.count_if("typed_loss").alias("typed_loss"))


def _spans_of(cells):
    """Segments of the contours of cells with the span of simplified lines that replaces each: ``site, line_id, span, seq, row, col, len, confidence``."""
    edges = stitching.stitched(stitching.numbered(contours.segments(cells, 1.0, parts=True)), tile=32)
    key = F.concat_ws("/", "site", F.col("level").cast("long"), "line").alias("line_id")
    v = stitching.line_vertices(edges)
    again = v.withColumn("n", F.count("*").over(Window.partitionBy("site", "level", "line"))).where("closed and seq = 0").withColumn("seq", F.col("n")).drop("n")
    v = rounded(v.unionByName(again), "x", "y").select("site", key, F.lit(0).alias("run"), "seq", "x", "y")
    kept = simplify.thinned(v, CELL_TOLERANCE, {"keep": None}).withColumn("span", F.count_if("keep").over(Window.partitionBy("line_id").orderBy("seq")))
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return edges.select("site", key, F.col("place").alias("seq"), "row", "col", length.alias("len"), "confidence").join(kept.select("line_id", "seq", "span"), ["line_id", "seq"])


def hidden_edges(spark, sf_dir):
    """Contours of half of the points, checked by the other half: spans whose ends hide weaker edges, how often these have the larger error,
    and spans that are solid by their ends, kept by all edges or not, with their mean greatest error."""
    built = rounded(field_cells(spark, sf_dir, "(l_orderkey + l_linenumber) % 2 = 0").where("coverage = 'measured'"), "z")
    held = grid.to_cells(points(spark, sf_dir, "(l_orderkey + l_linenumber) % 2 = 1"), COLS, ROWS).groupBy(*grid.CELL).agg(F.avg("z").alias("held"))
    errors = audits.block_errors(built.join(held, grid.CELL, "left").select(*grid.CELL, F.abs(F.col("held") - F.col("z")).alias("error")))
    found = audits.hidden_errors(_spans_of(built).join(errors, grid.CELL), ["line_id", "span"], grid.SOLID)
    both = F.col("promoted") & F.col("hidden").isNotNull() & F.col("ends").isNotNull()
    scored = F.col("solid") & F.col("most").isNotNull()
    out = found.groupBy("site").agg(
        F.count("*").alias("spans"), F.count_if("promoted").alias("promoted"), F.count_if(both).alias("scored"), F.count_if(both & (F.round(F.col("hidden") - F.col("ends"), 9) > 0)).alias("worse"),
        F.count_if(scored & F.col("all_solid")).alias("kept"), F.count_if(scored & ~F.col("all_solid")).alias("downgraded"), F.avg(F.when(scored & ~F.col("all_solid"), F.col("most"))).alias("error_downgraded"), F.avg(F.when(scored & F.col("all_solid"), F.col("most"))).alias("error_kept"),
    )
    return rounded(out, "error_downgraded", "error_kept", to=5)


def position_uncertainty(spark, sf_dir):
    """Horizontal uncertainty of simplified contours by site, and what records of the two end edges understate of it."""
    measured = grid.to_cells(points(spark, sf_dir), COLS, ROWS)
    cells = rounded(field_cells(spark, sf_dir).where("coverage = 'measured'"), "z")
    placed = _spans_of(cells)
    u = audits.block_uncertainty(cells.join(profiles.standard_errors(measured), grid.CELL))
    out = audits.understatement(audits.understated(placed.join(u, grid.CELL), ["line_id", "span"]))
    return rounded(out, *(c for c in out.columns if c not in ("site", "spans")), to=4)


def shared_targets(spark, sf_dir):
    """Mean confidence of the sites' measured cells by their own target count, one shared by all, and a given one."""
    cells = grid.to_cells(points(spark, sf_dir), COLS, ROWS).groupBy(*grid.CELL).agg(F.count("*").alias("n"))
    out = None
    for name, options in {"own": {}, "shared": {"shared": True}, "given": {"target": GIVEN}}.items():
        one = grid.support(cells, **options).groupBy("site").agg(F.lit(name).alias("target_of"), F.first("target").alias("target"), F.count("*").alias("cells"), F.avg("confidence").alias("mean_confidence"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean_confidence")


def worst_spans(spark, sf_dir):
    """The ten spans whose endpoint record claims most beyond their edges."""
    judged = evidence.promotions(evidence.span_records(evidence.runs(evidence.edges(vertices(spark, sf_dir)))))
    return rounded(audits.worst(judged, "promotion", "len", ["line_id", "span"], WORST).select("line_id", "span", "promotion", "len"), "promotion", "len", to=5)


def split_bins(spark, sf_dir):
    """Stretches simplified with forced vertices where an edge's class changes, by the width of the bins of support (0: every value):
    vertices retained, as a multiple of plain chords', and how many percent fewer than the source's."""
    placed = simplify.with_boundaries(simplify.stretches(vertices(spark, sf_dir)), {f"at{w}": ("bin", w) for w in BINS})
    kept = simplify.thinned(placed, TOLERANCE, {"dp": None, **{f"b{w}": F.col(f"at{w}") for w in BINS}})
    total = kept.agg(F.count("*").alias("source"), F.count_if("dp").alias("dp"), *(F.count_if(f"b{w}").alias(f"b{w}") for w in BINS))
    rows = F.array(*(F.struct(F.lit(w).alias("width"), F.col(f"b{w}").alias("retained")) for w in BINS))
    e = total.select("source", "dp", F.explode(rows).alias("r")).select("r.*", "source", "dp")
    return rounded(e.withColumns({"multiple": F.col("retained") / F.col("dp"), "reduction": 100 * (1 - F.col("retained") / F.col("source"))}), "multiple", "reduction", to=5)


def compared_tolerances(spark, sf_dir):
    """Lines whose retained vertices differ between two tolerances, and those that only one of two selections has."""
    def counts(tolerance: float, least: int):
        kept = simplify.simplified(vertices(spark, sf_dir), tolerance)
        return kept.groupBy("line_id").agg(F.count_if("keep").alias("retained"), F.max(F.when(F.col("keep") & (F.col("seq") > 3), F.col("seq"))).alias("last")).where(F.col("retained") >= least)

    met = audits.compared(counts(TOLERANCE, 36), counts(WIDER, 35), ["line_id"], ["retained", "last"])
    return met.groupBy("state").agg(F.count("*").alias("lines"), F.sum("retained").alias("retained"), F.sum("last").alias("last"))


QUERIES = {f.__name__: f for f in (hidden_edges, shared_targets, worst_spans, split_bins, compared_tolerances, checkpoint_audit, dissolve_audit, provenance_by_grade, position_uncertainty)}

_BAND = "CASE WHEN {0} >= 66 THEN 'solid' WHEN {0} >= 33 THEN 'dashed' ELSE 'gap' END"
_SETS = "CASE {0} WHEN 'X' THEN ['I', 'M'] ELSE [{0}] END"
#: Vertices of the lines, simplified.
_SPANS = f"""lv2 AS (SELECT site, site || '/' || CAST(level AS BIGINT) || '/' || line AS line_id, 0 AS run, place AS seq, round(x1, 6) AS x, round(y1, 6) AS y FROM ln
          UNION ALL SELECT site, site || '/' || CAST(level AS BIGINT) || '/' || line, 0, place + 1, round(x2, 6), round(y2, 6) FROM ln WHERE place = n - 1), {_PLAIN_LINES.format("lv2")}, {_thinned('dp', 'is_end', CELL_TOLERANCE, 'fl2', 'ol2')}"""
_HALF = _MEASURED.replace("l_suppkey FROM lineitem)", "l_suppkey FROM lineitem WHERE (l_orderkey + l_linenumber) % 2 = 0)", 1)
_CLASS = "prov || '|' || coalesce(CAST({m} AS VARCHAR), '-') || '|' || coalesce(CAST({i} AS VARCHAR), '-')"
_BINNED = ", ".join(f"fb{w} AS (SELECT line_id, run, seq, x, y, is_end, coalesce(k <> lag(k) OVER q, false) AS at_bin FROM (SELECT *, {_CLASS.format(m='m' if w == 0 else f'CAST(floor(m / {w}) AS BIGINT)', i='i' if w == 0 else f'CAST(floor(i / {w}) AS BIGINT)')} AS k FROM f) WINDOW q AS (PARTITION BY line_id, run ORDER BY seq)), {_thinned(f'bin{w}', 'is_end OR at_bin', f=f'fb{w}')}" for w in BINS)
SQL = {
    "hidden_edges": f"""WITH RECURSIVE {_HALF}, {_SPANS},
        hc AS (SELECT l_returnflag AS site, CAST(least(99, floor(y)) AS INTEGER) AS r, CAST(least(99, floor(x)) AS INTEGER) AS c, avg(0.08::DOUBLE * x + 0.06::DOUBLE * y + 5 * l_tax) AS held FROM (SELECT *, (l_partkey % 1000) / 10.0::DOUBLE AS x, (l_orderkey % 1000) / 10.0::DOUBLE AS y FROM lineitem WHERE (l_orderkey + l_linenumber) % 2 = 1) GROUP BY ALL),
        he AS (SELECT s6.site, s6."row" AS r, s6.col AS c, abs(hc.held - s6.z) AS e FROM s6 JOIN hc ON hc.site = s6.site AND hc.r = s6."row" AND hc.c = s6.col WHERE s6.coverage = 'measured'),
        hd AS (SELECT ln.site, dp_s.line_id, dp_s.span, ln.place, any_value(ln.confidence) AS confidence, sqrt(avg(he.e * he.e)) AS error FROM ln JOIN dp_s ON dp_s.line_id = ln.site || '/' || CAST(ln.level AS BIGINT) || '/' || ln.line AND dp_s.seq = ln.place
          LEFT JOIN he ON he.site = ln.site AND he.r - (ln.seg >> 33) BETWEEN 0 AND 1 AND he.c - ((ln.seg >> 1) & 4294967295) BETWEEN 0 AND 1 GROUP BY ln.site, dp_s.line_id, dp_s.span, ln.place),
        hs AS (SELECT *, least(first_value(confidence) OVER w, last_value(confidence) OVER w) AS says, min(place) OVER p AS a, max(place) OVER p AS b FROM hd WINDOW p AS (PARTITION BY site, line_id, span), w AS (PARTITION BY site, line_id, span ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        hg AS (SELECT site, line_id, span, any_value(says) AS says, min(confidence) AS least, max(error) AS most, count(*) FILTER (place > a AND place < b AND confidence < says - 1e-12) > 0 AS promoted, avg(error) FILTER (place > a AND place < b AND confidence < says - 1e-12) AS hidden,
          list_avg(list_filter([arg_min({{'e': error}}, place).e, arg_max({{'e': error}}, place).e], lambda v: v IS NOT NULL)) AS ends FROM hs GROUP BY ALL)
        SELECT site, count(*) AS spans, count(*) FILTER (promoted) AS promoted, count(*) FILTER (promoted AND hidden IS NOT NULL AND ends IS NOT NULL) AS scored, count(*) FILTER (promoted AND hidden IS NOT NULL AND ends IS NOT NULL AND round(hidden - ends, 9) > 0) AS worse,
          count(*) FILTER (says >= 66 AND most IS NOT NULL AND least >= 66) AS kept, count(*) FILTER (says >= 66 AND most IS NOT NULL AND least < 66) AS downgraded, round(avg(most) FILTER (says >= 66 AND least < 66), 5) AS error_downgraded, round(avg(most) FILTER (says >= 66 AND least >= 66), 5) AS error_kept FROM hg GROUP BY site""",
    "shared_targets": f"""WITH {_FIELD}, ct AS (SELECT site, 'own' AS target_of, quantile_cont(n, 0.5) AS target FROM m GROUP BY site UNION ALL SELECT s0.site, 'shared', (SELECT quantile_cont(n, 0.5) FROM m) FROM (SELECT DISTINCT site FROM m) s0 UNION ALL SELECT DISTINCT site, 'given', {GIVEN} FROM m)
        SELECT m.site, target_of, ct.target::DOUBLE AS target, count(*) AS cells, round(avg(floor(100 * least(1.0::DOUBLE, n / ct.target) * n / (n + 3) + 0.5)), 6) AS mean_confidence FROM m JOIN ct ON ct.site = m.site GROUP BY ALL""",
    "worst_spans": f"""WITH {_EDGES}, ws AS (SELECT line_id, span, sum(len) AS len, least(arg_min({{'v': m}}, seq).v, arg_max({{'v': m}}, seq).v) - min(m) AS promotion FROM s GROUP BY line_id, span)
        SELECT line_id, span, round(promotion, 5) AS promotion, round(len, 5) AS len FROM ws WHERE promotion > 1e-12 ORDER BY ws.promotion DESC, ws.len DESC, line_id, span LIMIT {WORST}""",
    "split_bins": f"""WITH RECURSIVE {_PLACED}, {_thinned('dp', 'is_end')}, {_BINNED}, tl AS (SELECT (SELECT count(*) FROM f) AS source, {", ".join(f"(SELECT count(*) FROM f WHERE is_end OR (line_id, seq) IN (SELECT (line_id, seq) FROM {k}_k)) AS {k}" for k in ("dp", *(f"bin{w}" for w in BINS)))}),
        tr AS ({" UNION ALL ".join(f"SELECT CAST({w} AS INTEGER) AS width, bin{w} AS retained, source, dp FROM tl" for w in BINS)}) SELECT *, round(retained / dp, 5) AS multiple, round(100 * (1 - retained / source), 5) AS reduction FROM tr""",
    "compared_tolerances": f"""WITH RECURSIVE {_PLACED}, {_thinned('dp', 'is_end')}, {_thinned('dw', 'is_end', WIDER)}, {", ".join(f"{t} AS (SELECT line_id, count(*) AS retained, max(seq) FILTER (seq > 3) AS last FROM f WHERE is_end OR (line_id, seq) IN (SELECT (line_id, seq) FROM {k}_k) GROUP BY line_id HAVING count(*) >= {n})" for t, k, n in (("ca", "dp", 36), ("cb", "dw", 35)))},
        cc AS (SELECT CASE WHEN cb.line_id IS NULL THEN 'left only' WHEN ca.line_id IS NULL THEN 'right only' WHEN ca.retained <> cb.retained OR ca.last IS DISTINCT FROM cb.last THEN 'differs' ELSE 'same' END AS state, cb.retained - ca.retained AS retained, cb.last - ca.last AS last FROM ca FULL JOIN cb ON cb.line_id = ca.line_id)
        SELECT state, count(*) AS lines, CAST(sum(retained) AS BIGINT) AS retained, CAST(sum(last) AS BIGINT) AS last FROM cc GROUP BY state""",
    "checkpoint_audit": f"""WITH {_FIELD}, ck AS (SELECT l_returnflag AS site, (l_partkey % 1000) / 10.0::DOUBLE + {MOVED} AS x, (l_orderkey % 1000) / 10.0::DOUBLE AS y, 0.08::DOUBLE * ((l_partkey % 1000) / 10.0::DOUBLE) + 0.06::DOUBLE * ((l_orderkey % 1000) / 10.0::DOUBLE) + 5 * l_tax + {RAISED} AS z FROM lineitem WHERE l_suppkey % {EVERY} = 0),
        er AS (SELECT ck.site, CASE WHEN floor(ck.x) > 99 OR floor(ck.y) > 99 THEN 'off grid' WHEN s.z IS NULL THEN 'unsupported' ELSE s.coverage END AS channel, s.confidence, abs(s.z - ck.z) AS error FROM ck LEFT JOIN (SELECT * FROM s WHERE dist < 2) s ON s.site = ck.site AND s."row" = floor(ck.y) AND s.col = floor(ck.x))
        SELECT site, channel, CASE WHEN error IS NOT NULL THEN {_BAND.format('confidence')} END AS band, count(*) AS checkpoints, round(sqrt(avg(error * error)), 5) AS rmse, round(quantile_cont(error, 0.5), 5) AS median_error FROM er GROUP BY 1, 2, 3""",
    "dissolve_audit": f"""WITH {_EDGES}, dr AS (SELECT line_id, count(*) AS n, min(m) AS m, min(i) AS i, list_sort(list_distinct(flatten(list({_SETS.format('prov')})))) AS truth, arg_min(m, seq) FILTER (m IS NOT NULL) AS fm, arg_min(i, seq) FILTER (i IS NOT NULL) AS fi, arg_max(m, seq) FILTER (m IS NOT NULL) AS lm, arg_max(i, seq) FILTER (i IS NOT NULL) AS li,
          avg(m) AS am, avg(i) AS ai, {_SETS.format('arg_min(prov, seq)')} AS fp, {_SETS.format('arg_max(prov, seq)')} AS lp FROM e GROUP BY line_id),
        dv AS (SELECT 'reference' AS rule, n, m, i, m AS rm, i AS ri, truth, truth AS rp FROM dr UNION ALL SELECT 'first', n, m, i, fm, fi, truth, fp FROM dr UNION ALL SELECT 'last', n, m, i, lm, li, truth, lp FROM dr UNION ALL SELECT 'mean', n, m, i, am, ai, truth, NULL FROM dr)
        SELECT rule, count(*) FILTER (n > 1) AS lines, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1 AND (coalesce(rm > m + 1e-9, false) OR coalesce(ri > i + 1e-9, false))) AS promoted,
          CASE WHEN rule <> 'mean' THEN count(*) FILTER (n > 1 AND len(list_filter(truth, lambda p: NOT list_contains(rp, p))) > 0) END AS lost FROM dv GROUP BY rule""",
    "provenance_by_grade": f"""WITH {_EDGES}, gl AS (SELECT line_id, span, min(least(m, i)) AS c, list_distinct(flatten(list({_SETS.format('prov')}))) AS truth, list_concat({_SETS.format('arg_min(prov, seq)')}, {_SETS.format('arg_max(prov, seq)')}) AS typed FROM s GROUP BY line_id, span),
        gg AS (SELECT *, {_BAND.format('c')} AS grade FROM gl) SELECT grade, count(*) AS spans, count(*) FILTER (len(list_filter(truth, lambda p: p <> CASE grade WHEN 'solid' THEN 'M' WHEN 'dashed' THEN 'I' ELSE 'U' END)) > 0) AS grade_loss,
          count(*) FILTER (len(list_filter(truth, lambda p: NOT list_contains(typed, p))) > 0) AS typed_loss FROM gg GROUP BY grade""",
    "position_uncertainty": f"""WITH RECURSIVE {_MEASURED}, {_SPANS},
        sd AS (SELECT site, "row" AS r, col AS c, sqrt((coalesce(var_samp(z), 0) + 0.0025::DOUBLE) / count(*)) AS se FROM c GROUP BY ALL),
        q4 AS (SELECT s6.site, s6."row" AS r, s6.col AS c, s6.z, sd.se FROM s6 JOIN sd ON sd.site = s6.site AND sd.r = s6."row" AND sd.c = s6.col WHERE s6.coverage = 'measured'),
        bu AS (SELECT a.site, a.r, a.c, greatest(a.se, b.se, d.se, e.se) AS se, sqrt((((b.z + d.z) - (a.z + e.z)) / 2) ** 2 + (((d.z + e.z) - (a.z + b.z)) / 2) ** 2) AS slope FROM q4 a JOIN q4 b ON b.site = a.site AND b.r = a.r AND b.c = a.c + 1 JOIN q4 d ON d.site = a.site AND d.r = a.r + 1 AND d.c = a.c + 1 JOIN q4 e ON e.site = a.site AND e.r = a.r + 1 AND e.c = a.c),
        eu AS (SELECT ln.site, dp_s.line_id, dp_s.span, ln.place, sqrt((ln.x2 - ln.x1) ** 2 + (ln.y2 - ln.y1) ** 2) AS len, bu.se / greatest(0.05::DOUBLE, bu.slope) AS u, bu.slope > 0.05::DOUBLE AS steep FROM ln JOIN dp_s ON dp_s.line_id = ln.site || '/' || CAST(ln.level AS BIGINT) || '/' || ln.line AND dp_s.seq = ln.place
          JOIN bu ON bu.site = ln.site AND bu.r = ln.seg >> 33 AND bu.c = (ln.seg >> 1) & 4294967295),
        us AS (SELECT site, line_id, span, sum(len) AS len, max(u) AS truth, greatest(arg_min(u, place), arg_max(u, place)) AS says, bool_and(steep) AS steep FROM eu GROUP BY ALL), uu AS (SELECT *, says < truth - 1e-9 AS under FROM us)
        SELECT site, round(sum(len), 4) AS length, round(coalesce(sum(len) FILTER (under), 0), 4) AS under_length, count(*) FILTER (under) AS spans, round(coalesce(sum(len) FILTER (steep), 0), 4) AS steep_length, round(coalesce(sum(len) FILTER (steep AND under), 0), 4) AS steep_under,
          round(max(truth / says) FILTER (under), 4) AS factor_most, round(max(truth - says) FILTER (under), 4) AS more_most, round((list_sort(list(truth / says) FILTER (under)))[count(*) FILTER (under) // 2 + 1], 4) AS factor_middle, round((list_sort(list(truth - says) FILTER (under)))[count(*) FILTER (under) // 2 + 1], 4) AS more_middle FROM uu GROUP BY site""",
}
