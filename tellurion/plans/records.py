"""Queries on records of lines: meets, wrapped records, profiles, simplification and its methods, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurion.operators import evidence, match, meet, simplify
from tellurion.sources.tables import vertices

#: Tolerance of simplification, and arcs of so many vertices.
TOLERANCE, ARC = 20.0, 8
#: Area up to which a vertex's triangle may be taken away.
AREA = 400.0
#: Name, retained vertices and rule of the methods compared.
METHODS = (("DP", "dp", "endpoint"), ("BOUNDARY", "boundary", "endpoint"), ("SPLIT-T", "split", "endpoint"), ("SPLIT-T-EC", "split", "complete"), ("DP-MEAN", "dp", "length_mean"), ("EC-DP", "dp", "complete"))


def rounded(df: DataFrame, *names: str, to: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in names})


def arc_records(spark, sf_dir) -> DataFrame:
    """Vertices as evidence records: every 17th lacks the value its channels apply to, every third states a scope."""
    v = vertices(spark, sf_dir).where("prov <> 'U'")
    terms = F.when(F.col("seq") % 3 == 1, F.array(F.lit("bare"), F.lit("forest"))).when(F.col("seq") % 15 == 2, F.array(F.lit("urban"))).when(F.col("seq") % 3 == 2, F.array(F.lit("bare")))
    prov = F.when(F.col("prov") == "X", F.array(F.lit("interpolated"), F.lit("measured"))).when(F.col("prov") == "M", F.array(F.lit("measured"))).otherwise(F.array(F.lit("interpolated")))
    channels = [meet.channel(F.when(F.col("seq") % 17 != 0, F.col(c) / 100), evidence.applies(c), terms).alias(c) for c in ("m", "i")]
    return v.select("line_id", F.floor(F.col("seq") / ARC).alias("arc"), "seq", prov.alias("provenance"), *channels, F.array(F.concat(F.lit("tile"), (F.col("seq") % 5).cast("string"))).alias("lineage"))


def evidence_meet(spark, sf_dir):
    """The meet of every arc, reached through meets of its halves."""
    records = meet.validated(arc_records(spark, sf_dir), ["m", "i"])
    halves = meet.meet(records.withColumn("half", F.floor(F.col("seq") / (ARC // 2))), ["line_id", "arc", "half"], ["m", "i"])
    out = meet.meet(halves, ["line_id", "arc"], ["m", "i"])
    columns = [x for c in ("m", "i") for x in (meet.state(c).alias(f"{c}_state"), F.col(f"{c}.value").alias(f"{c}_value"), F.array_join(f"{c}.scope", "|").alias(f"{c}_scope"))]
    return out.select("line_id", "arc", F.array_join("provenance", "|").alias("provenance"), *columns, F.array_join("lineage", "|").alias("lineage"))


def _spans(spark, sf_dir) -> DataFrame:
    return evidence.runs(evidence.edges(vertices(spark, sf_dir)))


def wrapped_records(spark, sf_dir):
    """Complete records of every span with a state a channel; edges whose ``seq`` divides by 17 lack their values."""
    lacking = _spans(spark, sf_dir).withColumns({c: F.when(F.col("seq") % 17 != 0, F.col(c)) for c in ("m", "i")})
    out = evidence.wrapped(evidence.profiles(lacking, ["line_id", "span"]))
    return rounded(out, "len", *(f"{c}_ge{t}" for c in "mi" for t in (66, 33)))


def profile_merge(spark, sf_dir):
    """The record of every line from the profiles of its spans."""
    parts = evidence.profiles(_spans(spark, sf_dir), ["line_id", "span"])
    out = evidence.wrapped(evidence.merged(parts, ["line_id"]))
    return rounded(out, "len", *(f"{c}_ge{t}" for c in "mi" for t in (66, 33)))


def profile_accounting(spark, sf_dir):
    """Well-supported length by channel and threshold: the true one, and what endpoint, least and profile state."""
    spans = evidence.profiles(_spans(spark, sf_dir), ["line_id", "span"])
    ends = evidence.span_records(_spans(spark, sf_dir)).select("line_id", "span", "m_end", "i_end")
    rows = []
    for c in evidence.CHANNELS:
        for t in evidence.THRESHOLDS:
            rows.append(F.struct(F.lit(c).alias("channel"), F.lit(t).alias("threshold"), F.col(f"{c}_len").alias("len"), F.col(f"{c}_len{t}").alias("true"), F.col(f"{c}_end").alias("end"), F.col(f"{c}_least").alias("least")))
    e = spans.join(ends, ["line_id", "span"]).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("len > 0")
    stated = {"endpoint": F.when(F.col("end") >= F.col("threshold"), F.col("len")).otherwise(0.0), "least": F.when(F.col("least") >= F.col("threshold"), F.col("len")).otherwise(0.0), "profile": F.col("true")}
    sums = [F.sum("len").alias("length"), F.sum("true").alias("true_length")]
    for name, says in stated.items():
        sums += [F.sum(says).alias(f"{name}_length"), F.sum(F.greatest(says - F.col("true"), F.lit(0.0))).alias(f"{name}_over"), F.sum(F.greatest(F.col("true") - says, F.lit(0.0))).alias(f"{name}_under")]
    out = e.groupBy("channel", "threshold").agg(*sums)
    return rounded(out, *(c for c in out.columns if c not in ("channel", "threshold")), to=3)


def scalar_bound(spark, sf_dir):
    """Spans whose endpoint record says more than their least value: the threshold halfway accepts a span with a failing edge."""
    spans = evidence.carried(_spans(spark, sf_dir), "endpoint").withColumn("halfway", (F.col("m_says") + F.col("m_true")) / 2)
    per = spans.where(F.col("m_says") > F.col("m_true")).groupBy("line_id", "span").agg(F.max("halfway").alias("halfway"), F.count_if(F.col("m") < F.col("halfway")).alias("failing"), F.max("m_says").alias("says"))
    return per.groupBy("line_id").agg(F.count("*").alias("spans"), F.count_if((F.col("failing") > 0) & (F.col("says") >= F.col("halfway"))).alias("refuted"), F.sum("failing").alias("failing_edges"))


def _kept(spark, sf_dir) -> DataFrame:
    placed = simplify.with_boundaries(simplify.stretches(vertices(spark, sf_dir)), {"at_prov": ("prov",), "at_band": ("band",)})
    return simplify.thinned(placed, TOLERANCE, {"dp": None, "boundary": F.col("at_prov"), "split": F.col("at_band")})


def simplification_audit(spark, sf_dir):
    """Per line: edges, spans after simplification between gaps, and promoted spans."""
    spans = simplify.spans(simplify.simplified(vertices(spark, sf_dir), TOLERANCE))
    judged = evidence.promotions(evidence.span_records(spans)).withColumn("edges", F.col("src_to") - F.col("src_from"))
    return judged.groupBy("line_id").agg(F.sum("edges").alias("edges"), F.count("*").alias("spans"), F.count_if("promoted").alias("promoted"), F.max("promotion").alias("max_promotion"))


def method_comparison(spark, sf_dir):
    """Methods of cutting and of attribution over all lines: vertices, promotions, losses, lengths over- and understated."""
    kept = _kept(spark, sf_dir)
    scored = evidence.compared(simplify.edges_within(kept, "dp", "boundary", "split"), {n: (k, r) for n, k, r in METHODS})
    per = kept.groupBy("line_id", "run").agg(F.count("*").alias("n"), *(F.count_if(k).alias(k) for k in ("dp", "boundary", "split")), *(F.bool_or(F.col(k) != F.col("dp")).alias(f"{k}_differs") for k in ("boundary", "split"))).where("n > 1")
    totals = per.agg(F.count("*").alias("lines"), F.sum("n").alias("source_vertices"), *(F.sum(k).alias(k) for k in ("dp", "boundary", "split")), *(F.count_if(f"{k}_differs").alias(f"{k}_differs") for k in ("boundary", "split")))
    named = F.array(*(F.struct(F.lit(n).alias("method"), F.col(k).alias("retained"), (F.lit(0).cast("long") if k == "dp" else F.col(f"{k}_differs")).alias("lines_changed")) for n, k, _ in METHODS))
    vertices_ = totals.select("lines", "source_vertices", F.col("dp").alias("of_dp"), F.explode(named).alias("c")).select("lines", "source_vertices", "of_dp", "c.*")
    out = scored.join(F.broadcast(vertices_), "method")  # a row a method
    share = lambda x: F.try_divide(100 * F.col(x), F.col("length"))
    out = out.select(
        "method", "lines", "source_vertices", "retained", (F.col("retained") - F.col("of_dp")).alias("extra_vertices"), "lines_changed", "spans", "promoted", "max_promotion", "provenance_loss",
        share("over_length").alias("over_pct"), share("under_length").alias("under_pct"), (share("over_points") / 100).alias("over_points"), (share("under_points") / 100).alias("under_points"),
    )
    return rounded(out, "over_pct", "under_pct", "over_points", "under_points")


def query_retention(spark, sf_dir):
    """What a query for measured support at 66 and 33 gets from endpoint and complete records of simplified lines."""
    edges = simplify.spans(simplify.simplified(vertices(spark, sf_dir), TOLERANCE))
    choices = F.array(*(F.struct(F.lit(n).alias("method"), F.lit(r).alias("rule")) for n, r in (("endpoint", "endpoint"), ("complete", "complete"))))
    said = evidence.carried(edges.withColumn("c", F.explode(choices)).select("c.*", *edges.columns), F.col("rule"), ("method", "line_id", "span"))
    said = said.withColumn("threshold", F.explode(F.array(F.lit(66), F.lit(33))))
    says, holds = evidence.passes(F.col("m_says"), F.col("prov_says"), F.col("threshold")), evidence.passes(F.col("m"), F.col("prov"), F.col("threshold"))
    total = lambda x: F.sum(F.when(x, F.col("len")).otherwise(0.0))
    sums = said.groupBy("method", "threshold").agg(F.sum("len").alias("scored"), total(holds).alias("qualifying"), total(says & ~holds).alias("false_accept"), total(~says & holds).alias("wrong_reject"), total(says & holds).alias("correct_accept"))
    out = sums.select("method", "threshold", "scored", "qualifying", F.try_divide(1000 * F.col("false_accept"), F.col("scored")).alias("false_accept_per_km"), F.try_divide(1000 * F.col("wrong_reject"), F.col("scored")).alias("wrong_reject_per_km"), F.try_divide(100 * F.col("correct_accept"), F.col("qualifying")).alias("retention_pct"))
    return rounded(out, "scored", "qualifying", "false_accept_per_km", "wrong_reject_per_km", "retention_pct", to=3)


def recovered_records(spark, sf_dir):
    """Records of the spans of simplified lines of which only the coordinates are known, matched back to their sources.

    A line is a stretch between gaps here; both numbers name it. Spans are numbered in it.
    """
    placed = simplify.stretches(vertices(spark, sf_dir))
    key = ["line_id", "run"]
    thin = simplify.thinned(placed, TOLERANCE, {"keep": None}).where("keep").select(*key, "seq", "x", "y")
    found = match.matched(placed, thin, tuple(key)).where("state = 'matched'").select(*key, "seq", "keep")
    edges = simplify.edges_within(placed.join(found, [*key, "seq"]), "keep").withColumn("span", F.col("keep") - F.min("keep").over(Window.partitionBy(*key)) + 1)
    out = evidence.wrapped(evidence.profiles(edges, [*key, "span"]))
    return rounded(out, "len", *(f"{c}_ge{t}" for c in "mi" for t in (66, 33)))


def area_simplified(spark, sf_dir):
    """Stretches of lines simplified by the area of triangles: their vertices, those retained, and the sum of these one's numbers."""
    kept = simplify.thinned(simplify.stretches(vertices(spark, sf_dir)), AREA, {"keep": None}, choose=simplify.by_area)
    return kept.groupBy("line_id", "run").agg(F.count("*").alias("vertices"), F.count_if("keep").alias("retained"), F.sum(F.when(F.col("keep"), F.col("seq"))).alias("numbers"))


def fewest_vertices(spark, sf_dir):
    """Vertices of stretches: all, those retained by chords, and the fewest that the tolerance allows under each condition."""
    choose = {"dp": lambda *given, columns: simplify.retained(*given)} | {c: partial(simplify.fewest, condition=c) for c in simplify.CONDITIONS}
    kept = simplify.thinned(simplify.stretches(vertices(spark, sf_dir)), TOLERANCE, dict.fromkeys(choose), choose=choose, columns=("prov", "m", "i"))
    return kept.groupBy("line_id", "run").agg(F.count("*").alias("vertices"), *(F.count_if(name).alias(name) for name in choose)).where("vertices > 1")


QUERIES = {f.__name__: f for f in (fewest_vertices, area_simplified, recovered_records, evidence_meet, wrapped_records, profile_merge, profile_accounting, scalar_bound, simplification_audit, method_comparison, query_retention)}

VERTICES = """v AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) / 3.6e9::DOUBLE AS x, value AS y,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'M' WHEN event_type = 'view' THEN 'I' WHEN event_type = 'click' THEN 'X' ELSE 'U' END AS prov,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
w AS (SELECT *, CASE WHEN prov IN ('M', 'X') THEN k END AS m, CASE WHEN prov IN ('I', 'X') THEN k END AS i FROM v)"""
_EDGES = f"""{VERTICES}, n AS (SELECT *, lead(x) OVER q AS x2, lead(y) OVER q AS y2, lead(prov) OVER q AS prov2, lead(m) OVER q AS m2, lead(i) OVER q AS i2 FROM w WINDOW q AS (PARTITION BY line_id ORDER BY seq)),
e AS (SELECT line_id, seq, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len, CASE WHEN prov = prov2 THEN prov ELSE 'X' END AS prov, least(m, m2) AS m, least(i, i2) AS i
      FROM n WHERE prov <> 'U' AND prov2 <> 'U'),
g AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY line_id ORDER BY seq) = 1 THEN 0 ELSE 1 END AS starts FROM e),
s AS (SELECT * EXCLUDE (starts), CAST(sum(starts) OVER (PARTITION BY line_id ORDER BY seq) AS BIGINT) AS span FROM g)"""


def _state(c: str, own: str) -> str:
    return f"CASE WHEN NOT bool_or(prov IN ('{own}', 'X')) THEN 'not_applicable' WHEN bool_or(prov IN ('{own}', 'X') AND {c} IS NULL) THEN 'unavailable' ELSE 'value' END"


def _wrapped(by: str, source: str) -> str:
    parts = [f"SELECT {by}, round(sum(len), 5) AS len, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN prov = 'X' THEN ['I', 'M'] ELSE [prov] END)))), '|') AS prov"]
    for c, own in (("m", "M"), ("i", "I")):
        on = f"prov IN ('{own}', 'X') AND {c} IS NOT NULL"
        parts += [f"{_state(c, own)} AS {c}_state", f"CASE WHEN {_state(c, own)} = 'value' THEN min({c}) FILTER ({on}) END AS {c}_min"]
        parts += [f"round(CASE WHEN {_state(c, own)} = 'value' THEN coalesce(sum(len) FILTER ({on} AND {c} >= {t}), 0) / nullif(sum(len) FILTER ({on}), 0) END, 5) AS {c}_ge{t}" for t in (66, 33)]
    return ", ".join(parts) + f" FROM {source} GROUP BY {by}"


def _met(c: str, own: str) -> str:
    """Columns of one channel's meet over raw records; a term is common if every record with a scope has it."""
    on = f"prov IN ('{own}', 'X')"
    scoped = f"count(*) FILTER ({on} AND scope IS NOT NULL)"
    terms = [f"CASE WHEN count(*) FILTER ({on} AND list_contains(scope, '{t}')) = {scoped} THEN '{t}' END" for t in ("bare", "forest", "urban")]
    common = f"list_filter([{', '.join(terms)}], lambda t: t IS NOT NULL)"
    state = f"CASE WHEN NOT bool_or({on}) THEN 'not_applicable' WHEN bool_or({on} AND seq % 17 = 0) OR ({scoped} > 0 AND len({common}) = 0) THEN 'unavailable' ELSE 'value' END"
    return f"{state} AS {c}_state, CASE WHEN {state} = 'value' THEN min({c}) FILTER ({on}) END AS {c}_value, CASE WHEN {state} = 'value' AND {scoped} > 0 THEN array_to_string({common}, '|') END AS {c}_scope"


def _thinned(name: str, forced: str, tolerance: float = TOLERANCE, f: str = "f", o: str = "o") -> str:
    """Chords of the recursion by halves, and the vertices it retains."""
    return f"""{name}_c(line_id, a, b) AS (SELECT line_id, a, b FROM (SELECT line_id, seq AS a, lead(seq) OVER (PARTITION BY line_id, run ORDER BY seq) AS b FROM {f} WHERE {forced}) WHERE b IS NOT NULL
  UNION ALL SELECT line_id, unnest([a, k]), unnest([k, b]) FROM (SELECT line_id, a, b, m.d AS d, -m.s AS k FROM (
    SELECT h.line_id, h.a, h.b, max({{'d': CASE WHEN q.x = p.x AND q.y = p.y THEN sqrt((f.x - p.x) ** 2 + (f.y - p.y) ** 2)
        ELSE abs((f.x - p.x) * (q.y - p.y) - (f.y - p.y) * (q.x - p.x)) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) END, 's': -f.seq}}) AS m
    FROM {name}_c h JOIN {f} p ON p.line_id = h.line_id AND p.seq = h.a JOIN {f} q ON q.line_id = h.line_id AND q.seq = h.b JOIN {f} f ON f.line_id = h.line_id AND f.seq > h.a AND f.seq < h.b GROUP BY ALL)) WHERE d > {tolerance}),
{name}_k AS (SELECT DISTINCT line_id, unnest([a, b]) AS seq FROM {name}_c),
{name}_s AS (SELECT o.*, count(k.seq) OVER (PARTITION BY o.line_id ORDER BY o.seq) AS span FROM {o} o LEFT JOIN {name}_k k ON k.line_id = o.line_id AND k.seq = o.seq),
{name}_e AS (SELECT * FROM {name}_s WHERE len IS NOT NULL)"""


_PLACED = f"""{VERTICES}, r AS (SELECT *, sum(CASE WHEN prov = 'U' THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY seq) AS run FROM w),
o AS (SELECT line_id, run, seq, x, y, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS len, CASE WHEN prov = prov2 THEN prov WHEN prov2 IS NOT NULL THEN 'X' END AS prov, least(m, m2) AS m, least(i, i2) AS i,
      prov2 IS NULL AS ends, (SELECT NULL) AS nothing FROM (SELECT *, lead(x) OVER q AS x2, lead(y) OVER q AS y2, lead(prov) OVER q AS prov2,
      lead(m) OVER q AS m2, lead(i) OVER q AS i2 FROM r WHERE prov <> 'U' WINDOW q AS (PARTITION BY line_id, run ORDER BY seq))),
cl AS (SELECT *, CASE WHEN prov IS NOT NULL THEN prov || '|' || CASE WHEN m IS NULL THEN '-' WHEN m >= 66 THEN '2' WHEN m >= 33 THEN '1' ELSE '0' END || '|' || CASE WHEN i IS NULL THEN '-' WHEN i >= 66 THEN '2' WHEN i >= 33 THEN '1' ELSE '0' END END AS class FROM o),
f AS (SELECT *, lag(seq) OVER q IS NULL OR ends AS is_end, coalesce(prov <> lag(prov) OVER q, false) AS at_prov, coalesce(class <> lag(class) OVER q, false) AS at_band FROM cl WINDOW q AS (PARTITION BY line_id, run ORDER BY seq))"""

#: What the spans of one method say, edge by edge; ``rule`` is a column.
_CARRIED = """SELECT *, min(m) OVER p AS m_true, min(i) OVER p AS i_true, CASE WHEN min(prov) OVER p = max(prov) OVER p THEN min(prov) OVER p ELSE 'X' END AS prov_true,
  CASE rule WHEN 'endpoint' THEN least(first_value(m) OVER w, last_value(m) OVER w) WHEN 'complete' THEN min(m) OVER p ELSE sum(len * m) OVER p / nullif(sum(CASE WHEN m IS NOT NULL THEN len END) OVER p, 0) END AS m_says,
  CASE rule WHEN 'endpoint' THEN least(first_value(i) OVER w, last_value(i) OVER w) WHEN 'complete' THEN min(i) OVER p ELSE sum(len * i) OVER p / nullif(sum(CASE WHEN i IS NOT NULL THEN len END) OVER p, 0) END AS i_says,
  CASE WHEN rule = 'endpoint' THEN CASE WHEN first_value(prov) OVER w = last_value(prov) OVER w THEN first_value(prov) OVER w ELSE 'X' END
       WHEN min(prov) OVER p = max(prov) OVER p THEN min(prov) OVER p ELSE 'X' END AS prov_says
  FROM {0} WINDOW p AS (PARTITION BY method, line_id, span), w AS (PARTITION BY method, line_id, span ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

_METHOD_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS method, '{r}' AS rule, line_id, seq, len, prov, m, i, span FROM {k}_e" for n, k, r in METHODS)
_METHOD_VERTICES = " UNION ALL ".join(f"SELECT '{n}' AS method, (SELECT count(*) FROM {k}_k) AS retained, (SELECT count(DISTINCT (line_id, run)) FROM f WHERE (line_id, seq) IN (SELECT (line_id, seq) FROM {k}_k) <> ((line_id, seq) IN (SELECT (line_id, seq) FROM dp_k))) AS lines_changed" for n, k, _ in METHODS)

SQL = {
    "evidence_meet": f"""WITH {VERTICES}, r AS (SELECT line_id, seq, seq // {ARC} AS arc, prov, CASE WHEN seq % 17 <> 0 THEN m / 100 END AS m, CASE WHEN seq % 17 <> 0 THEN i / 100 END AS i,
        CASE WHEN seq % 3 = 1 THEN ['bare', 'forest'] WHEN seq % 15 = 2 THEN ['urban'] WHEN seq % 3 = 2 THEN ['bare'] END AS scope FROM w WHERE prov <> 'U')
        SELECT line_id, arc, array_to_string(list_filter([CASE WHEN bool_or(prov IN ('M', 'X')) THEN 'measured' END, CASE WHEN bool_or(prov IN ('I', 'X')) THEN 'interpolated' END], lambda p: p IS NOT NULL), '|') AS provenance,
        {_met('m', 'M')}, {_met('i', 'I')}, array_to_string(list_sort(list(DISTINCT 'tile' || (seq % 5))), '|') AS lineage FROM r GROUP BY line_id, arc""",
    "wrapped_records": f"WITH {_EDGES}, z AS (SELECT * REPLACE (CASE WHEN seq % 17 <> 0 THEN m END AS m, CASE WHEN seq % 17 <> 0 THEN i END AS i) FROM s) {_wrapped('line_id, span', 'z')}",
    "fewest_vertices": f"""WITH RECURSIVE {_PLACED}, {_thinned('dp', 'is_end')}, fv AS (SELECT *, row_number() OVER (PARTITION BY line_id, run ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY line_id, run) AS n FROM f),
        pr AS (SELECT a.line_id, a.run, a.k AS i, b.k AS j, a.n, a.prov AS p1, (SELECT struct_pack(m := e.m, i := e.i, prov := e.prov) FROM fv e WHERE e.line_id = b.line_id AND e.run = b.run AND e.k = b.k - 1) AS last, a.m AS m1, a.i AS i1, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM fv a JOIN fv b ON b.line_id = a.line_id AND b.run = a.run AND b.k > a.k),
        sp AS (SELECT pr.line_id, pr.run, pr.i, pr.j, any_value(pr.n) AS n, any_value(p1) AS p1, any_value(last) AS last, any_value(m1) AS m1, any_value(i1) AS i1, min(e.m) FILTER (e.k < pr.j) AS m_least, min(e.i) FILTER (e.k < pr.j) AS i_least, list_distinct(list(e.prov) FILTER (e.k < pr.j)) AS provs,
            count(DISTINCT (e.prov, coalesce(e.m, -1), coalesce(e.i, -1))) FILTER (e.k < pr.j) AS kinds,
            coalesce(max(CASE WHEN ax = bx AND ay = by_ THEN sqrt((e.x - ax) ** 2 + (e.y - ay) ** 2) ELSE abs((e.x - ax) * (by_ - ay) - (e.y - ay) * (bx - ax)) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) END) FILTER (e.k > pr.i AND e.k < pr.j), 0) AS far
            FROM pr JOIN fv e ON e.line_id = pr.line_id AND e.run = pr.run AND e.k >= pr.i AND e.k <= pr.j GROUP BY ALL),
        ok AS (SELECT line_id, run, i, j, n, c FROM sp, (VALUES ('any'), ('safe'), ('exact')) v(c) WHERE far <= {TOLERANCE} AND CASE c WHEN 'any' THEN true WHEN 'exact' THEN kinds = 1
            ELSE coalesce(least(m1, last.m) <= m_least + 1e-12, true) AND coalesce(least(i1, last.i) <= i_least + 1e-12, true) AND (p1 IN ('M', 'X') OR last.prov IN ('M', 'X') OR NOT list_has_any(provs, ['M', 'X'])) AND (p1 IN ('I', 'X') OR last.prov IN ('I', 'X') OR NOT list_has_any(provs, ['I', 'X'])) END),
        pt AS (SELECT DISTINCT line_id, run, c, n, 0::BIGINT AS k, 1 AS used FROM ok UNION SELECT pt.line_id, pt.run, pt.c, pt.n, ok.j, used + 1 FROM pt JOIN ok ON ok.line_id = pt.line_id AND ok.run = pt.run AND ok.c = pt.c AND ok.i = pt.k),
        bs AS (SELECT line_id, run, c, min(used) AS used FROM pt WHERE k = n - 1 GROUP BY ALL)
        SELECT b.line_id, CAST(b.run AS BIGINT) AS run, any_value(f0.n) AS vertices, any_value(f0.dp) AS dp, CAST(max(used) FILTER (c = 'any') AS BIGINT) AS "any", CAST(max(used) FILTER (c = 'safe') AS BIGINT) AS safe, CAST(max(used) FILTER (c = 'exact') AS BIGINT) AS exact FROM bs b
        JOIN (SELECT f.line_id, f.run, count(*) AS n, count(*) FILTER (is_end OR k.seq IS NOT NULL) AS dp FROM f LEFT JOIN dp_k k ON k.line_id = f.line_id AND k.seq = f.seq GROUP BY ALL) f0 ON f0.line_id = b.line_id AND f0.run = b.run GROUP BY b.line_id, b.run""",
    "area_simplified": f"""WITH RECURSIVE {_PLACED}, va AS (SELECT line_id, run, list({{'x': x, 'y': y, 's': seq}} ORDER BY seq) AS p, count(*) AS n FROM f GROUP BY line_id, run
          UNION ALL SELECT line_id, run, list_concat(p[:list_position(a, list_min(a))], p[list_position(a, list_min(a)) + 2:]), n
          FROM (SELECT *, list_transform(range(2, len(p)), lambda k: abs((p[k - 1].x - p[k].x) * (p[k + 1].y - p[k].y) - (p[k + 1].x - p[k].x) * (p[k - 1].y - p[k].y)) / 2) AS a FROM va) WHERE len(p) > 2 AND list_min(a) <= {AREA})
        SELECT line_id, CAST(run AS BIGINT) AS run, n AS vertices, CAST(len(p) AS BIGINT) AS retained, CAST(list_sum(list_transform(p, lambda q: q.s)) AS BIGINT) AS numbers FROM (SELECT *, row_number() OVER (PARTITION BY line_id, run ORDER BY len(p)) AS k FROM va) WHERE k = 1""",
    "recovered_records": f"""WITH RECURSIVE {_PLACED}, {_thinned('dp', 'is_end')}, y AS (SELECT *, span - min(span) OVER (PARTITION BY line_id, run) + 1 AS part FROM dp_e),
        z AS (SELECT line_id, CAST(run AS BIGINT) AS run, CAST(part AS BIGINT) AS span, len, prov, m, i FROM y) {_wrapped('line_id, run, span', 'z')}""",
    "profile_merge": f"WITH {_EDGES} {_wrapped('line_id', 's')}",
    "profile_accounting": f"WITH {_EDGES}, p AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS channel, {t} AS threshold, sum(len) FILTER (prov IN ('{own}', 'X') AND {c} IS NOT NULL) AS len, coalesce(sum(len) FILTER (prov IN ('{own}', 'X') AND {c} >= {t}), 0) AS truth,
        least(arg_min({{'v': {c}}}, seq).v, arg_max({{'v': {c}}}, seq).v) AS e, min({c}) AS l FROM s GROUP BY line_id, span"""
        for c, own in (("m", "M"), ("i", "I"))
        for t in (66, 33)
    )
    + """), q AS (SELECT channel, threshold, len, truth, CASE WHEN e >= threshold THEN len ELSE 0 END AS e, CASE WHEN l >= threshold THEN len ELSE 0 END AS l FROM p WHERE len > 0)
        SELECT channel, threshold, round(sum(len), 3) AS length, round(sum(truth), 3) AS true_length, round(sum(e), 3) AS endpoint_length, round(sum(greatest(e - truth, 0)), 3) AS endpoint_over,
        round(sum(greatest(truth - e, 0)), 3) AS endpoint_under, round(sum(l), 3) AS least_length, round(sum(greatest(l - truth, 0)), 3) AS least_over, round(sum(greatest(truth - l, 0)), 3) AS least_under,
        round(sum(truth), 3) AS profile_length, 0.0::DOUBLE AS profile_over, 0.0::DOUBLE AS profile_under FROM q GROUP BY channel, threshold""",
    "scalar_bound": f"""WITH {_EDGES}, t AS (SELECT 'x' AS method, 'endpoint' AS rule, * FROM s), c AS ({_CARRIED.format('t')}), h AS (SELECT *, (m_says + m_true) / 2 AS halfway FROM c WHERE m_says > m_true),
        b AS (SELECT line_id, span, count(*) FILTER (m < halfway) AS failing, max(m_says) AS says, max(halfway) AS halfway FROM h GROUP BY line_id, span)
        SELECT line_id, count(*) AS spans, count(*) FILTER (failing > 0 AND says >= halfway) AS refuted, CAST(sum(failing) AS BIGINT) AS failing_edges FROM b GROUP BY line_id""",
    "simplification_audit": f"""WITH RECURSIVE {_PLACED}, {_thinned('dp', 'is_end')}, b AS (SELECT line_id, span, count(*) AS edges, least(arg_min({{'v': m}}, seq).v, arg_max({{'v': m}}, seq).v) - min(m) AS more FROM dp_e GROUP BY line_id, span)
        SELECT line_id, CAST(sum(edges) AS BIGINT) AS edges, count(*) AS spans, count(*) FILTER (more > 1e-12) AS promoted, max(CASE WHEN more > 1e-12 THEN more ELSE 0 END) AS max_promotion FROM b GROUP BY line_id""",
    "method_comparison": f"""WITH RECURSIVE {_PLACED}, {_thinned('dp', 'is_end')}, {_thinned('boundary', 'is_end OR at_prov')}, {_thinned('split', 'is_end OR at_band')}, t AS ({_METHOD_ROWS}), c AS ({_CARRIED.format('t')}),
        u AS (SELECT *, greatest(CASE WHEN m_says - m > 1e-12 THEN m_says - m ELSE 0 END, CASE WHEN i_says - i > 1e-12 THEN i_says - i ELSE 0 END) AS ov,
              greatest(CASE WHEN m - m_says > 1e-12 THEN m - m_says ELSE 0 END, CASE WHEN i - i_says > 1e-12 THEN i - i_says ELSE 0 END) AS un FROM c),
        p AS (SELECT method, line_id, span, max(greatest(coalesce(m_says - m_true, 0), coalesce(i_says - i_true, 0))) AS pr, bool_or(prov_says <> prov_true AND prov_says <> 'X') AS lost, sum(len) AS len,
              coalesce(sum(len) FILTER (ov > 0), 0) AS ol, coalesce(sum(len) FILTER (ov = 0 AND un > 0), 0) AS ul, sum(len * ov) AS op, sum(CASE WHEN ov > 0 THEN 0 ELSE len * un END) AS up FROM u GROUP BY ALL),
        k AS (SELECT method, count(*) AS spans, count(*) FILTER (pr > 1e-12) AS promoted, max(CASE WHEN pr > 1e-12 THEN pr ELSE 0 END) AS max_promotion, count(*) FILTER (lost) AS provenance_loss,
              sum(len) AS len, sum(ol) AS ol, sum(ul) AS ul, sum(op) AS op, sum(up) AS up FROM p GROUP BY method),
        n AS (SELECT count(*) AS lines, CAST(sum(n) AS BIGINT) AS source_vertices FROM (SELECT count(*) AS n FROM f GROUP BY line_id, run) WHERE n > 1), y AS ({_METHOD_VERTICES})
        SELECT method, lines, source_vertices, retained, retained - (SELECT count(*) FROM dp_k) AS extra_vertices, lines_changed, spans, promoted, max_promotion, provenance_loss,
        round(100 * ol / len, 5) AS over_pct, round(100 * ul / len, 5) AS under_pct, round(op / len, 5) AS over_points, round(up / len, 5) AS under_points FROM k JOIN y USING (method), n""",
    "query_retention": f"""WITH RECURSIVE {_PLACED}, {_thinned('dp', 'is_end')}, t AS (SELECT unnest(['endpoint', 'complete']) AS method, unnest(['endpoint', 'complete']) AS rule, * FROM dp_e), c AS ({_CARRIED.format('t')}),
        u AS (SELECT method, threshold, len, coalesce(m_says >= threshold, false) AND prov_says = 'M' AS says, coalesce(m >= threshold, false) AND prov = 'M' AS holds FROM c, (VALUES (66), (33)) h(threshold))
        SELECT method, threshold, round(sum(len), 3) AS scored, round(coalesce(sum(len) FILTER (holds), 0), 3) AS qualifying, round(1000 * coalesce(sum(len) FILTER (says AND NOT holds), 0) / sum(len), 3) AS false_accept_per_km,
        round(1000 * coalesce(sum(len) FILTER (holds AND NOT says), 0) / sum(len), 3) AS wrong_reject_per_km, round(100 * coalesce(sum(len) FILTER (says AND holds), 0) / nullif(sum(len) FILTER (holds), 0), 3) AS retention_pct
        FROM u GROUP BY method, threshold""",
}
