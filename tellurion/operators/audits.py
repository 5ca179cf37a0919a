"""Audits of what records claim: against checkpoints, after dissolving lines, of position uncertainty and of provenance by grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.operators.contours import blocks
from tellurion.operators.evidence import CHANNELS
from tellurion.operators.statistics import running

#: Least slope that a horizontal uncertainty is told from, and slack of two uncertainties.
FLOOR, SLACK = 0.05, 1e-9


# -- sets of provenance ------------------------------------------------------------------------------------------


def prov_set(prov: Column) -> Column:
    """The kinds in a provenance: X is measured and interpolated, unknown ones none."""
    return F.when(prov == "X", F.array(F.lit("I"), F.lit("M"))).when(prov.isin("M", "I", "U"), F.array(prov)).otherwise(F.array().cast("array<string>"))


def grade_set(grade: Column) -> Column:
    """What a display grade lets a reader assume: solid measured, dashed interpolated, else unsupported."""
    return F.array(F.when(grade == "solid", "M").when(grade == "dashed", "I").otherwise("U"))


def misses(got: Column, truth: Column) -> Column:
    return F.size(F.array_except(truth, got)) > 0


def joined_sets(sets: Column) -> Column:
    """Aggregate: the kinds in any of the sets, of which there are three."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sets))))


def provenance_losses(edges: DataFrame, keys: list[str], grade: Column) -> DataFrame:
    """By span ``keys`` of ``edges(keys, seq, prov, ...)``: whether its grade (an aggregate) and its two end edges miss some of its provenance."""
    ends = [f("prov", "seq") for f in (F.min_by, F.max_by)]
    out = edges.groupBy(*keys).agg(grade.alias("grade"), joined_sets(prov_set(F.col("prov"))).alias("truth"), *(e.alias(n) for n, e in zip(("first", "last"), ends, strict=True)))
    typed = F.array_union(prov_set(F.col("first")), prov_set(F.col("last")))
    return out.select(*keys, "grade", misses(grade_set(F.col("grade")), F.col("truth")).alias("grade_loss"), misses(typed, F.col("truth")).alias("typed_loss"))


# -- dissolved lines ---------------------------------------------------------------------------------------------

#: How tools make one record of a line's edges.
DISSOLVES = ("reference", "first", "last", "mean")


def dissolved(edges: DataFrame, line: str = "line_id") -> DataFrame:
    """``line, edges`` and of each rule a record: ``<rule>_m, <rule>_i, <rule>_prov``; the reference has the least values and all provenance.

    The first and last value are those of the first and last edge by ``seq`` that has one, as tools take them; a mean has no provenance.
    """
    out = [F.count("*").alias("edges")]
    order = {"first": F.min_by, "last": F.max_by}
    for c in CHANNELS:
        out += [F.min(c).alias(f"reference_{c}"), F.avg(c).alias(f"mean_{c}")]
        out += [pick(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"{rule}_{c}") for rule, pick in order.items()]
    out += [joined_sets(prov_set(F.col("prov"))).alias("reference_prov")]
    out += [prov_set(pick("prov", "seq")).alias(f"{rule}_prov") for rule, pick in order.items()]
    return edges.groupBy(line).agg(*out)


def dissolve_scores(records: DataFrame) -> DataFrame:
    """``rule, lines, single, promoted, lost``: lines of two edges and more, those of one, and those whose record claims more support or less provenance than the reference."""
    rows = []
    for rule in DISSOLVES:
        more = F.lit(False)
        for c in CHANNELS:
            more = more | F.coalesce(F.col(f"{rule}_{c}") > F.col(f"reference_{c}") + SLACK, F.lit(False))
        lost = F.lit(None).cast("boolean") if rule == "mean" else misses(F.col(f"{rule}_prov"), F.col("reference_prov"))
        rows.append(F.struct(F.lit(rule).alias("rule"), more.alias("more"), lost.alias("lost")))
    scored = records.select((F.col("edges") > 1).alias("several"), F.explode(F.array(*rows)).alias("r")).select("several", "r.*")
    return scored.groupBy("rule").agg(F.count_if("several").alias("lines"), F.count_if(~F.col("several")).alias("single"), F.count_if(F.col("several") & F.col("more")).alias("promoted"), F.sum(F.when(F.col("several"), F.col("lost").cast("long"))).alias("lost"))


# -- checkpoints -------------------------------------------------------------------------------------------------


def checkpoint_errors(checkpoints: DataFrame, field: DataFrame, rows: int, cols: int, size: float = 1.0) -> DataFrame:
    """``checkpoints(site, x, y, z, ...)`` with the cell they lie in (strictly half open), its ``channel``, ``confidence`` and their ``error``.

    ``channel`` is ``off grid`` or ``unsupported`` where there is nothing to compare with, so that none is lost.
    """
    placed = checkpoints.withColumns({"row": F.floor(F.col("y") / size).cast("int"), "col": F.floor(F.col("x") / size).cast("int")})
    known = field.select("site", "row", "col", F.col("z").alias("__z"), "coverage", "confidence")
    on = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    met = placed.join(known, ["site", "row", "col"], "left")
    channel = F.when(~F.coalesce(on, F.lit(False)), "off grid").when(F.col("__z").isNull() | F.isnan("__z"), "unsupported").otherwise(F.col("coverage"))
    scored = met.withColumn("channel", channel)
    error = F.when(~F.col("channel").isin("off grid", "unsupported"), F.abs(F.col("__z") - F.col("z")))
    return scored.withColumn("error", error).drop("__z", "coverage")


# -- position uncertainty ----------------------------------------------------------------------------------------


def block_uncertainty(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """``site, row, col, u, steep`` of blocks of ``cells(site, row, col, z, se)``: the greatest standard error of the four heights over the
    block's slope, ``FLOOR`` at least, which is the horizontal uncertainty of a contour there; and whether the slope is above it."""
    b = blocks(cells, "z", "se")
    z = [F.col(f"z{k}") for k in range(4)]
    slope = F.sqrt(F.pow(((z[1] + z[2]) - (z[0] + z[3])) / (2 * size), 2) + F.pow(((z[2] + z[3]) - (z[0] + z[1])) / (2 * size), 2))
    return b.select("site", "row", "col", (F.greatest(*(F.col(f"se{k}") for k in range(4))) / F.greatest(F.lit(FLOOR), slope)).alias("u"), (slope > FLOOR).alias("steep"))


def understated(edges: DataFrame, keys: list[str]) -> DataFrame:
    """By span of ``edges(site, keys, seq, len, u, steep)``: length, the greatest uncertainty and that of the two end edges, whether the
    ends understate it, and whether all of the span is steep."""
    ends = F.greatest(F.min_by("u", "seq"), F.max_by("u", "seq"))
    out = edges.groupBy("site", *keys).agg(F.sum("len").alias("len"), F.max("u").alias("truth"), ends.alias("says"), F.bool_and("steep").alias("steep"))
    return out.withColumn("under", F.col("says") < F.col("truth") - SLACK)


def upper_middle(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, <value>_middle``: the middle value, or the upper of two, from running sums over distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("w"))
    half = counts.groupBy(by).agg(F.floor(F.sum("w") / 2).alias("__half"))
    return running(counts, by, value, "w").join(half, by).where(F.col("upto") > F.col("__half")).groupBy(by).agg(F.min(value).alias(f"{value}_middle"))


def understatement(spans: DataFrame) -> DataFrame:
    """By site of ``understated`` spans: lengths, how much is understated, by what factor and difference in the middle and at most, and on steep spans alone."""
    some = spans.where("under").withColumns({"factor": F.col("truth") / F.col("says"), "more": F.col("truth") - F.col("says")})
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("len"))), F.lit(0.0))
    under, steep = F.col("under"), F.col("steep")
    out = spans.groupBy("site").agg(F.sum("len").alias("length"), total(under).alias("under_length"), F.count_if("under").alias("spans"), total(steep).alias("steep_length"), total(steep & under).alias("steep_under"))
    most = some.groupBy("site").agg(F.max("factor").alias("factor_most"), F.max("more").alias("more_most"))
    for t in (most, upper_middle(some, "site", "factor"), upper_middle(some, "site", "more")):
        out = out.join(t, "site", "left")
    return out


# -- errors that records hide ------------------------------------------------------------------------------------


def block_errors(cells: DataFrame) -> DataFrame:
    """``site, row, col, error`` of blocks of ``cells(site, row, col, error)``: the root mean square over those of the four cells that have an error; null if none has."""
    b = blocks(cells, "error")
    e = [F.col(f"error{k}") for k in range(4)]
    known = sum((x.isNotNull().cast("int") for x in e[1:]), e[0].isNotNull().cast("int"))
    square = sum((F.coalesce(x * x, F.lit(0.0)) for x in e[1:]), F.coalesce(e[0] * e[0], F.lit(0.0)))
    return b.select("site", "row", "col", F.when(known > 0, F.sqrt(square / known)).alias("error"))


def hidden_errors(edges: DataFrame, keys: list[str], solid: float) -> DataFrame:
    """By span ``site, keys`` of ``edges(site, keys, seq, confidence, error)``: whether the record of its end edges claims more than some
    edge between them has (``promoted``), the mean error of those edges (``hidden``) and of the ends (``ends``), the greatest error (``most``),
    and whether the ends are solid and all of its edges are.
    """
    inner = F.array_sort(F.collect_list(F.struct("seq", "confidence", "error")))  # the edges of one span
    s = edges.groupBy("site", *keys).agg(inner.alias("e"), F.min("confidence").alias("least"), F.max("error").alias("most"))
    first, last = F.element_at("e", 1), F.element_at("e", -1)
    s = s.withColumn("says", F.least(first["confidence"], last["confidence"]))
    between = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    hidden = F.filter(between, lambda x: x["confidence"] < F.col("says") - 1e-12)
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.size(a))
    errors = lambda a: F.filter(F.transform(a, lambda x: x["error"]), lambda v: v.isNotNull())
    return s.select("site", *keys, (F.size(hidden) > 0).alias("promoted"), mean(errors(hidden)).alias("hidden"), mean(errors(F.array(first, last))).alias("ends"), "most", (F.col("says") >= solid).alias("solid"), (F.col("least") >= solid).alias("all_solid"))


# -- results compared --------------------------------------------------------------------------------------------


def compared(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """``keys, state`` and each value's difference: rows of two results by their unique keys, ``left only``, ``right only``, ``differs`` or ``same``.

    Two nulls are the same; a null and a value differ, and their difference is null. No row has state ``left only`` or ``right only`` if the
    results have the same keys.
    """
    a = left.select(*keys, *(F.col(v).alias(f"__a_{v}") for v in values), F.lit(True).alias("__a"))
    b = right.select(*keys, *(F.col(v).alias(f"__b_{v}") for v in values), F.lit(True).alias("__b"))
    met = a.join(b, keys, "full")
    differs = F.lit(False)
    for v in values:
        x, y = F.col(f"__a_{v}"), F.col(f"__b_{v}")
        differs = differs | F.when(x.isNull() | y.isNull(), x.isNull() != y.isNull()).otherwise(F.abs(x - y) > tolerance)
    state = F.when(F.col("__b").isNull(), "left only").when(F.col("__a").isNull(), "right only").when(differs, "differs").otherwise("same")
    return met.select(*keys, state.alias("state"), *((F.col(f"__b_{v}") - F.col(f"__a_{v}")).alias(v) for v in values))


def worst(spans: DataFrame, promotion: str, length: str, ties: list[str], k: int = 1) -> DataFrame:
    """The ``k`` spans with the largest promotion; of equal ones the longer, then the first by ``ties``. Spans without promotion take no part."""
    return spans.where(F.col(promotion) > 0).orderBy(F.desc(promotion), F.desc(length), *ties).limit(k)
