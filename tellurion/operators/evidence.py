"""Edges, spans and their records: what a derived span may claim of the edges it replaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_line():
    return Window.partitionBy("line_id").orderBy("seq")


def length() -> Column:
    """From a vertex to the next, ``x2, y2``."""
    return F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))


def edges(vertices: DataFrame) -> DataFrame:
    """Edges between supported neighbours: ``line_id, seq, len, prov, m, i``, supports the least over both ends."""
    after = {f"{c}2": F.lead(c).over(in_line()) for c in ("x", "y", "prov", "m", "i")}
    e = vertices.withColumns(after).where((F.col("prov") != "U") & (F.col("prov2") != "U"))
    return e.select("line_id", "seq", length().alias("len"), F.when(F.col("prov") == F.col("prov2"), F.col("prov")).otherwise("X").alias("prov"), F.least("m", "m2").alias("m"), F.least("i", "i2").alias("i"))


def runs(edges: DataFrame) -> DataFrame:
    """Add ``span``: the number of the maximal stretch of contiguous edges in the line."""
    starts = F.when(F.col("seq") - F.lag("seq").over(in_line()) == 1, 0).otherwise(1)
    return edges.withColumn("starts", starts).withColumn("span", F.sum("starts").over(in_line())).drop("starts")


def at_least(value: Column, threshold: float) -> Column:
    return F.sum(F.when(value >= threshold, F.col("len")).otherwise(0.0))


def span_records(spans: DataFrame) -> DataFrame:
    """Complete, endpoint and length-weighted records of every span, with its support profile at 66 and 33."""
    first, last = F.min_by(F.struct("m", "i", "prov"), "seq"), F.max_by(F.struct("m", "i", "prov"), "seq")
    out = spans.groupBy("line_id", "span").agg(
        F.min("seq").alias("src_from"),
        (F.max("seq") + 1).alias("src_to"),
        F.sum("len").alias("len"),
        F.array_join(F.array_sort(F.collect_set("prov")), "|").alias("prov"),
        F.min("m").alias("m_min"),
        F.min("i").alias("i_min"),
        (F.sum(F.col("m") * F.col("len")) / F.sum(F.when(F.col("m").isNotNull(), F.col("len")))).alias("m_mean"),
        (at_least(F.col("m"), 66) / F.sum(F.when(F.col("m").isNotNull(), F.col("len")))).alias("m_ge66"),
        (at_least(F.col("m"), 33) / F.sum(F.when(F.col("m").isNotNull(), F.col("len")))).alias("m_ge33"),
        first.alias("a"),
        last.alias("b"),
    )
    ends = F.when(F.col("a.prov") == F.col("b.prov"), F.col("a.prov")).otherwise("X")
    return out.withColumns({"m_end": F.least("a.m", "b.m"), "i_end": F.least("a.i", "b.i"), "prov_end": ends}).drop("a", "b")


def promotions(records: DataFrame) -> DataFrame:
    """Add, a span, whether its endpoint record claims more than its complete record, and by how much."""
    more = F.col("m_end") - F.col("m_min")
    return records.withColumn("promoted", F.coalesce(more > 1e-12, F.lit(False))).withColumn("promotion", F.when(more > 1e-12, more).otherwise(0.0))


def passes(support: Column, provenance: Column, threshold: float) -> Column:
    """The attribute query: measured support of at least the threshold, and measured provenance only."""
    return F.coalesce(support >= threshold, F.lit(False)) & F.coalesce(provenance == "M", F.lit(False))


def _total(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("len")).otherwise(0.0))


def accounting(spans: DataFrame, threshold: float) -> DataFrame:
    """Lengths a line by what the span's endpoint record answers to the query and what holds for the edge.

    The endpoint record has the least support and the provenance of the span's first and last edge. The span's
    ends are found by windows over the line, which is how the edges lie already.
    """
    whole = Window.partitionBy("line_id", "span").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"{c}_{side}": by(c).over(whole) for c in ("m", "prov") for side, by in (("first", F.first), ("last", F.last))}
    met = spans.withColumns(ends)
    end_prov = F.when(F.col("prov_first") == F.col("prov_last"), F.col("prov_first")).otherwise("X")
    met = met.withColumns({"says": passes(F.least("m_first", "m_last"), end_prov, threshold), "holds": passes(F.col("m"), F.col("prov"), threshold)})
    says, holds = F.col("says"), F.col("holds")
    return met.groupBy("line_id").agg(_total(holds & says).alias("correct_accept"), _total(~holds & says).alias("false_accept"), _total(holds & ~says).alias("wrong_reject"), _total(~holds & ~says).alias("correct_reject"))


# -- records with a state, profiles that merge -----------------------------------------------------------------

#: Channels and the provenance of the edges that each applies to.
CHANNELS = {"m": ("M", "X"), "i": ("I", "X")}
THRESHOLDS = (66, 33)


def applies(channel: str) -> Column:
    return F.col("prov").isin(*CHANNELS[channel])


def profiles(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Profile of every span and channel, ``c_applies, c_missing, c_least, c_len`` and ``c_len66, c_len33``: whether the
    channel applies and lacks a value anywhere, its least value, the length that carries it and that above a threshold.

    Lengths, not shares: the profile of spans put together is the sum (``merged``).
    """
    out = []
    for c in CHANNELS:
        carried = applies(c) & F.col(c).isNotNull()
        out += [F.bool_or(applies(c)).alias(f"{c}_applies"), F.bool_or(applies(c) & F.col(c).isNull()).alias(f"{c}_missing"), F.min(F.when(carried, F.col(c))).alias(f"{c}_least"), _total(carried).alias(f"{c}_len")]
        out += [_total(carried & (F.col(c) >= t)).alias(f"{c}_len{t}") for t in THRESHOLDS]
    prov = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("prov") == "X", F.array(F.lit("I"), F.lit("M"))).otherwise(F.array("prov")))))), "|")
    return spans.groupBy(*keys).agg(F.sum("len").alias("len"), prov.alias("prov"), *out)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles of the union of spans from the profiles of the spans: exactly those of all their edges."""
    out = []
    for c in CHANNELS:
        out += [F.bool_or(f"{c}_{x}").alias(f"{c}_{x}") for x in ("applies", "missing")] + [F.min(f"{c}_least").alias(f"{c}_least")] + [F.sum(f"{c}_{x}").alias(f"{c}_{x}") for x in ("len", *(f"len{t}" for t in THRESHOLDS))]
    prov = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("prov", r"\|"))))), "|")
    return parts.groupBy(*keys).agg(F.sum("len").alias("len"), prov.alias("prov"), *out)


def wrapped(profiled: DataFrame) -> DataFrame:
    """State, least value and shares of every profile and channel.

    ``not_applicable`` if the channel applies to no edge, ``unavailable`` if it lacks a value on an edge it applies
    to; then there is no least value and no share, never those of the other edges.
    """
    columns = {}
    for c in CHANNELS:
        state = F.when(~F.col(f"{c}_applies"), "not_applicable").when(F.col(f"{c}_missing"), "unavailable").otherwise("value")
        columns[f"{c}_state"] = state
        columns[f"{c}_min"] = F.when(state == "value", F.col(f"{c}_least"))
        columns |= {f"{c}_ge{t}": F.when(state == "value", F.try_divide(F.col(f"{c}_len{t}"), F.col(f"{c}_len"))) for t in THRESHOLDS}
    drop = [f"{c}_{x}" for c in CHANNELS for x in ("applies", "missing", "least", "len", *(f"len{t}" for t in THRESHOLDS))]
    return profiled.withColumns(columns).drop(*drop)


# -- methods compared ------------------------------------------------------------------------------------------

#: How a span's record is made of its edges: of its two end edges, of all, or their mean weighted by length.
RULES = ("endpoint", "complete", "length_mean")
EPS = 1e-12


def carried(edges: DataFrame, rule: str | Column, keys: tuple[str, ...] = ("line_id", "span")) -> DataFrame:
    """``edges(keys, seq, len, prov, m, i)`` with what their span carries by one of ``RULES``: ``m_says, i_says,
    prov_says``, and of all its edges the least values ``m_true, i_true`` and the provenance ``prov_true``."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return edges.withColumns(_of_span(keys)).withColumns(_says(rule)).drop("prov_ends", *(f"{c}_{x}" for c in CHANNELS for x in ("ends", "mean")))


def _of_span(keys: tuple[str, ...]) -> dict[str, Column]:
    """Of an edge's span: its provenance and channels by all edges (``true``), by its end edges (``ends``), and their mean."""
    part = Window.partitionBy(*keys)
    whole = part.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b = F.first("prov").over(whole), F.last("prov").over(whole)
    columns = {"prov_true": F.when(F.size(F.collect_set("prov").over(part)) == 1, F.min("prov").over(part)).otherwise("X")}
    for c in CHANNELS:
        columns[f"{c}_true"] = F.min(c).over(part)
        columns[f"{c}_ends"] = F.least(F.first(c).over(whole), F.last(c).over(whole))
        columns[f"{c}_mean"] = F.try_divide(F.sum(F.col("len") * F.col(c)).over(part), F.sum(F.when(F.col(c).isNotNull(), F.col("len"))).over(part))
    columns["prov_ends"] = F.when(a == b, a).otherwise("X")
    return columns


def _says(rule: Column) -> dict[str, Column]:
    says = {f"{c}_says": F.when(rule == "endpoint", F.col(f"{c}_ends")).when(rule == "complete", F.col(f"{c}_true")).otherwise(F.col(f"{c}_mean")) for c in CHANNELS}
    return says | {"prov_says": F.when(rule == "endpoint", F.col("prov_ends")).otherwise(F.col("prov_true"))}


def _scored(says: dict[str, Column]) -> dict[str, Column]:
    """Of an edge: how much its span says more and less than it has, how much more than its least value, and whether its provenance lacks some."""
    def gap(c: str) -> Column:
        return says[f"{c}_says"] - F.col(c)

    over = F.greatest(*(F.when(gap(c) > EPS, gap(c)).otherwise(0.0) for c in CHANNELS))
    under = F.when(over > 0, 0.0).otherwise(F.greatest(*(F.when(gap(c) < -EPS, -gap(c)).otherwise(0.0) for c in CHANNELS)))
    promotion = F.greatest(*(F.coalesce(says[f"{c}_says"] - F.col(f"{c}_true"), F.lit(0.0)) for c in CHANNELS))
    lost = (says["prov_says"] != F.col("prov_true")) & (says["prov_says"] != "X")
    return {"over": over, "under": under, "promotion": promotion, "lost": lost}


def compared(edges: DataFrame, methods: dict[str, tuple[str, str]]) -> DataFrame:
    """Methods ``name: (span, rule)`` over ``edges(line_id, seq, len, prov, m, i)`` and the columns that ``span`` names, which number spans of a line: a
    row a method with the totals of ``scores``.

    Every edge is one row for all methods, and a span's own totals are taken at its first edge, so nothing is grouped by span.
    """
    out, cuts = edges, [span for span, _ in methods.values()]
    for cut in sorted(set(cuts), key=cuts.count):  # the most columns last
        own = {k: F.lit(rule) for k, (span, rule) in enumerate(methods.values()) if span == cut}
        told = out.withColumns(_of_span(("line_id", cut)) | {"__first": F.min("seq").over(Window.partitionBy("line_id", cut)) == F.col("seq")})
        made = []
        for k, rule in own.items():
            of = _scored(_says(rule))
            made += [of["over"].alias(f"__over{k}"), of["under"].alias(f"__under{k}"), F.when(F.col("__first"), of["promotion"]).alias(f"__promotion{k}"), (F.col("__first") & of["lost"]).alias(f"__lost{k}")]
        out = told.select(*out.columns, *made)
    rows = []
    for k, name in enumerate(methods):
        up = F.col(f"__promotion{k}") > EPS
        rows.append(F.struct(
            F.lit(name).alias("method"),
            F.count(f"__promotion{k}").alias("spans"),
            F.count_if(up).alias("promoted"),
            F.max(F.when(up, F.col(f"__promotion{k}")).otherwise(0.0)).alias("max_promotion"),
            F.count_if(f"__lost{k}").alias("provenance_loss"),
            F.sum("len").alias("length"),
            *(_total(F.col(f"__{x}{k}") > 0).alias(f"{x}_length") for x in ("over", "under")),
            *(F.sum(F.col("len") * F.col(f"__{x}{k}")).alias(f"{x}_points") for x in ("over", "under")),
        ))
    return out.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("spans > 0")


def scores(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of ``carried`` edges by ``keys``: spans, those promoted (a channel says more than its least value) and by
    how much at most, those whose provenance lacks some, and lengths over- and understated, with points times length.

    An edge is overstated if its span says more than it has in some channel, else understated if less in some.
    """
    of = _scored({c: F.col(c) for c in (*(f"{c}_says" for c in CHANNELS), "prov_says")})
    by_span = edges.withColumns({x: of[x] for x in ("over", "under")}).groupBy(*keys, "line_id", "span").agg(
        F.max(of["promotion"]).alias("promotion"),
        F.bool_or(of["lost"]).alias("lost"),
        F.sum("len").alias("length"),
        *(_total(F.col(x) > 0).alias(f"{x}_length") for x in ("over", "under")),
        *(F.sum(F.col("len") * F.col(x)).alias(f"{x}_points") for x in ("over", "under")),
    )
    up = F.col("promotion") > EPS
    return by_span.groupBy(*keys).agg(
        F.count("*").alias("spans"),
        F.count_if(up).alias("promoted"),
        F.max(F.when(up, F.col("promotion")).otherwise(0.0)).alias("max_promotion"),
        F.count_if("lost").alias("provenance_loss"),
        *(F.sum(x).alias(x) for x in ("length", "over_length", "under_length", "over_points", "under_points")),
    )
