"""Simplified lines matched back to the vertices of their sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: decimals to which coordinates must agree.
PLACES = 9


def _leftmost(out: list[tuple], source: list[tuple]) -> list[int] | None:
    """Indices of the first way to find ``out`` in order in ``source``, its last vertex at the source's last."""
    if not out or not source or out[0] != source[0] or out[-1] != source[-1] or (len(out) == 1) != (len(source) == 1):
        return None
    at, k = [0], 1
    for p in out[1:-1]:
        while k < len(source) - 1 and source[k] != p:
            k += 1
        if k >= len(source) - 1:
            return None
        at.append(k)
        k += 1
    return at if len(source) == 1 else at + [len(source) - 1]


def recovered(out: list[tuple], source: list[tuple]) -> tuple[str, list[int]]:
    """``matched`` with the source's indices, ``ambiguous`` if there is more than one way, ``unmatched`` if none.

    Both ends are pinned, so that a lone vertex matches a lone vertex only. The first and the last way to match agree only
    if there is no other.
    """
    first = _leftmost(out, source)
    if first is None:
        return "unmatched", []
    last = [len(source) - 1 - k for k in _leftmost(out[::-1], source[::-1])][::-1]
    return ("matched", first) if first == last else ("ambiguous", [])


def _by_search(source: DataFrame, simplified: DataFrame, line: list[str]) -> DataFrame:
    """``matched`` for lines that come to a point twice. A task holds one line of both tables, as tuples: such lines are rare."""
    kinds = {f.name: f.dataType.simpleString() for f in source.schema if f.name in line}

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = {c: (left if len(left) else right)[c].iloc[0] for c in line}
        left, right = left.sort_values("seq"), right.sort_values("seq")
        state, at = recovered(list(zip(right["x"], right["y"], strict=True)), list(zip(left["x"], left["y"], strict=True))) if len(left) and len(right) else ("unmatched", [])
        if state != "matched":
            return pd.DataFrame({**{c: [v] for c, v in names.items()}, "state": [state], "seq": [None], "keep": [None]}).astype({"seq": "Int64", "keep": "boolean"})
        keep = pd.Series(False, range(len(left)))
        keep.iloc[at] = True
        return pd.DataFrame({**names, "state": state, "seq": left["seq"].to_numpy(), "keep": keep.to_numpy()})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in line) + ", state string, seq long, keep boolean"
    return source.groupBy(*line).cogroup(simplified.groupBy(*line)).applyInPandas(one, schema)


def matched(source: DataFrame, simplified: DataFrame, line: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """``line, state, seq, keep``: a row for every vertex of ``source(line, seq, x, y)`` whose line is matched by
    ``simplified(line, seq, x, y)``, and one with null ``seq`` for every line that is not.

    Coordinates must agree to ``PLACES`` decimals. A line (all columns of ``line`` together) that comes to no point twice is
    matched by a join on its points; only the others are searched one by one.
    """
    line = list(line)
    at = {c: F.bround(c, PLACES) for c in ("x", "y")}
    source, simplified = (t.select(*line, "seq", "x", "y").withColumns(at) for t in (source, simplified))
    point, whole, order = Window.partitionBy(*line, "x", "y"), Window.partitionBy(*line), Window.partitionBy(*line).orderBy("seq")
    marked = source.withColumn("same", F.count("*").over(point)).withColumn("twice", F.max("same").over(whole) > 1).drop("same")
    out = simplified.select(*line, "x", "y", F.col("seq").alias("out"), F.count("*").over(point).alias("same"))
    twice = marked.where("twice").select(*line).distinct()
    # Of the other lines, a vertex of the result that has no source, or comes twice, or goes back, is no match.
    met = marked.where(~F.col("twice")).join(out.join(twice, line, "left_anti"), [*line, "x", "y"], "full")
    before = F.max("out").over(order.rowsBetween(Window.unboundedPreceding, -1))
    at_end = F.lag("seq").over(order).isNull() | F.lead("seq").over(order).isNull()
    right = F.col("seq").isNotNull() & F.when(F.col("out").isNull(), ~at_end).otherwise((F.col("same") == 1) & F.coalesce(before < F.col("out"), F.lit(True)))
    judged = met.withColumn("right", right).withColumn("fits", F.bool_and("right").over(whole))
    good = judged.where("fits").select(*line, F.lit("matched").alias("state"), "seq", F.col("out").isNotNull().alias("keep"))
    bad = judged.where(~F.col("fits")).select(*line).distinct().select(*line, F.lit("unmatched").alias("state"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("boolean").alias("keep"))
    searched = _by_search(marked.where("twice").drop("twice"), simplified.join(twice, line, "left_semi"), line)
    return good.unionByName(bad).unionByName(searched)
