"""Contour segments joined into lines at their quantised ends.

Where two segments meet, they follow each other. Where more do, their ends are paired in the order of segments, so that what
is joined with what can be told from the ends at one point alone. Every segment then has at most one neighbour at
either end, and lines are paths or rings. Tiles, each with the segments of the blocks around it, walk these into
fragments; fragments are linked over tiles by pointer doubling, in as many rounds as the logarithm of the fragments of the
longest line. So the lines are the same for any size of tile, and none has to fit into a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.sources.shared import dropped, written

LINE = ["site", "level"]
#: Fixed value: parts of a cell that ends are told apart by.
PARTS = 1000


def quantum(size: float | None) -> float:
    """The step of ends: a thousandth of a cell, or of a metre where the cell has no good size."""
    return size / PARTS if size is not None and 0 < size < float("inf") else 1 / PARTS


def end_key(v: Column, step: float) -> Column:
    return F.floor(v / step + 0.5)


def numbered(segments: DataFrame) -> DataFrame:
    """``segments`` with ``seg``, their number in a site and level: by row, column and part of the block."""
    return segments.withColumn("seg", F.shiftleft(F.col("row").cast("long"), 33) + F.shiftleft(F.col("col").cast("long"), 1) + F.col("part"))


def partners(level: np.ndarray, ends: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """For the two ends of each segment (2k, 2k + 1), the end that it is joined with, or -1. ``ends`` has a row x, y of step numbers an end."""
    n = len(seg)
    group = np.repeat(level, 2), ends[:, 0], ends[:, 1]
    order = np.lexsort((np.arange(2 * n) % 2, np.repeat(seg, 2), *group))
    new = np.ones(2 * n, bool)
    new[1:] = np.any([g[order][1:] != g[order][:-1] for g in group], axis=0)
    place = np.arange(2 * n)
    place -= np.maximum.accumulate(np.where(new, place, 0))
    out = np.full(2 * n, -1)
    second = np.nonzero(place % 2)[0]
    out[order[second]], out[order[second - 1]] = order[second - 1], order[second]
    return out


def walked(joined: np.ndarray, own: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments of the own segments: of each, its fragment (by the first of its segments in ``order``), place in it,
    whether it is passed from end 0 to end 1, the fragment's count, and whether it is a ring."""
    n = len(own)
    head, at, forward, count, ring = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
    links = np.where((joined >= 0) & own[joined // 2] & np.repeat(own, 2), joined, -1).tolist()
    for first in order.tolist():
        if not own[first] or head[first] >= 0:
            continue
        chain, closed = [(first, True)], False
        for leave in (1, 0):  # on from the far end, then back from the near one
            side, end = [], 2 * first + leave
            while (end := links[end]) >= 0:
                k = end // 2
                if k == first:
                    closed = True
                    break
                # On the way on, a segment is passed forward if it is entered at end 0; on the way back the other way round.
                side.append((k, (end % 2 == 0) == (leave == 1)))
                end ^= 1
            if closed:
                chain += side
                break
            chain = chain + side if leave else side[::-1] + chain
        for place, (k, ahead) in enumerate(chain):
            head[k], at[k], forward[k], count[k], ring[k] = first, place, ahead, len(chain), closed
    return head, at, forward, count, ring


def fragments(segments: DataFrame, step: float, tile: int) -> DataFrame:
    """``segments`` with ``frag, at, forward, count, ring`` and, at the fragment's ends, ``to0, to1``: the ends beyond, as 2 * seg + end.

    Segments with both ends at one point are left out.
    """
    near = lambda c: F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile))
    keys = {f"__{c}": end_key(F.col(c), step) for c in ("x1", "y1", "x2", "y2")}
    whole = segments.withColumns(keys).where("__x1 != __x2 or __y1 != __y2")
    sent = whole.withColumn("__tr", F.explode(near("row"))).withColumn("__tc", F.explode(near("col")))
    keep = segments.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema) + ", frag long, at long, forward boolean, count long, ring boolean, to0 long, to1 long"

    def one(key: tuple, t: pa.Table) -> pa.Table:
        tr, tc = key[1].as_py(), key[2].as_py()
        own = (t["row"].to_numpy() // tile == tr) & (t["col"].to_numpy() // tile == tc)
        seg = t["seg"].to_numpy()
        ends = np.stack([np.stack([t[f"__x{k}"].to_numpy(), t[f"__y{k}"].to_numpy()], axis=1) for k in (1, 2)], axis=1).reshape(-1, 2)
        joined = partners(t["level"].to_numpy(), ends, seg)
        head, at, forward, count, ring = walked(joined, own, np.argsort(seg, kind="stable"))
        beyond = np.where((joined >= 0) & ~own[joined // 2], 2 * seg[joined // 2] + joined % 2, -1).reshape(-1, 2)
        enter, leave = np.where(forward, 0, 1), np.where(forward, 1, 0)
        k = np.arange(len(seg))
        to0, to1 = np.where(at == 0, beyond[k, enter], -1), np.where(at == count - 1, beyond[k, leave], -1)
        pick = np.nonzero(own)[0]
        out = t.select(keep).take(pa.array(pick))
        values = {"frag": seg[head], "at": at, "forward": forward, "count": count, "ring": ring}
        for name, v in values.items():
            out = out.append_column(name, pa.array(v[pick]))
        for name, v in (("to0", to0), ("to1", to1)):
            out = out.append_column(name, pa.array(v[pick], mask=v[pick] < 0))
        return out

    return sent.groupBy("site", "__tr", "__tc").applyInArrow(one, schema)


def placed(walks: DataFrame) -> DataFrame:
    """``site, level, frag, line, back, before, total, circle`` of the fragments that are linked with others.

    ``back`` says that the line passes the fragment against its own direction, ``before`` how many segments of the line
    are before it. A line has the number and direction of its least segment, at which a ring (``circle``) starts, too.
    """
    ends = walks.select(*LINE, "frag", "count", "seg", F.explode(F.array(
        F.struct((2 * F.col("seg") + (~F.col("forward")).cast("int")).alias("end"), F.lit(0).alias("side"), F.col("to0").alias("to")),
        F.struct((2 * F.col("seg") + F.col("forward").cast("int")).alias("end"), F.lit(1).alias("side"), F.col("to1").alias("to")),
    )).alias("e")).select(*LINE, "frag", "count", "e.*").where("to is not null")
    ends = written(ends)
    # A node is a fragment and a direction: it is left at the other end, and the next fragment is passed from where it is entered.
    entry = ends.select(*LINE, F.col("end").alias("to"), (2 * F.col("frag") + F.col("side")).alias("next"))
    out = ends.join(entry, [*LINE, "to"]).select(*LINE, (2 * F.col("frag") + 1 - F.col("side")).alias("node"), "next")
    both = ends.select(*LINE, "frag", "count").distinct().withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("node", 2 * F.col("frag") + F.col("way"))
    # low: the first least fragment ahead with its way, gap: segments until there, ahead: segments to the end, last: the last node.
    nodes = written(both.join(out, [*LINE, "node"], "left").select(*LINE, "node", "next", F.col("node").alias("low"), F.lit(0).cast("long").alias("gap"), F.col("count").alias("ahead"), F.col("node").alias("last"), F.lit(True).alias("moved"), "count"))
    dropped(ends)
    open_ = None
    while True:
        left, moved = nodes.agg(F.count("next"), F.count_if(F.col("moved") & F.col("next").isNotNull())).first()
        if not left or left == open_ and not moved:
            break
        open_ = left
        ahead = nodes.select(*LINE, F.col("node").alias("next"), *(F.col(c).alias(f"{c}2") for c in ("next", "low", "gap", "ahead", "last")))
        lower = F.coalesce(F.floor(F.col("low2") / 2) < F.floor(F.col("low") / 2), F.lit(False))
        step = nodes.drop("moved").join(ahead, [*LINE, "next"], "left").select(
            *LINE, "node", F.col("next2").alias("next"), F.when(lower, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("ahead") + F.col("gap2")).otherwise(F.col("gap")).alias("gap"),
            (F.col("ahead") + F.coalesce("ahead2", F.lit(0))).alias("ahead"), F.coalesce("last2", "last").alias("last"), lower.alias("moved"), "count",
        )
        step = written(step)
        dropped(nodes)
        nodes = step
    way = F.col("node") % 2
    named = nodes.withColumns({"frag": F.shiftright("node", 1), "way": way})
    lines = named.groupBy(*LINE, "frag").agg(F.min(F.shiftright("low", 1)).alias("line"))
    named = named.join(lines, [*LINE, "frag"])
    heads = named.groupBy(*LINE, "line").agg(F.sum(F.when(F.col("way") == 0, F.col("count"))).alias("total"), F.max(F.when((F.col("frag") == F.col("line")) & (F.col("way") == 0), F.col("last"))).alias("headed"))
    ring = F.col("next").isNotNull()
    right = F.when(ring, F.col("low") % 2 == 0).otherwise(F.col("last") == F.col("headed"))
    starts = walks.where("seg = frag").select(*LINE, F.col("seg").alias("line"), F.col("at").alias("start"))
    before = F.when(ring, F.pmod(F.col("total") - F.col("gap") - F.col("start"), F.col("total"))).otherwise(F.col("total") - F.col("ahead"))
    out = written(named.join(heads.join(starts, [*LINE, "line"]), [*LINE, "line"]).where(right).select(*LINE, "frag", "line", (F.col("way") == 1).alias("back"), before.alias("before"), "total", ring.alias("circle")))
    dropped(nodes)
    return out


def stitched(segments: DataFrame, size: float | None = 1.0, tile: int = 256) -> DataFrame:
    """``segments`` (numbered, with ``site, level, seg, row, col, x1, y1, x2, y2``) with ``line``, ``place`` in it from 0, and ``closed``.

    Ends are turned so that each segment starts where the one before ends; all other columns stay, so what is known of a
    segment needs no join. ``line`` is the least ``seg`` in it and its direction the line's; a ring of three segments or
    more is closed and starts there. Segments whose ends fall together are in no line.
    """
    walks = written(fragments(segments, quantum(size), tile))
    met = walks.join(placed(walks), [*LINE, "frag"], "left")
    back = F.coalesce("back", F.lit(False))
    ahead = F.col("forward") != back
    turned = {f"{c}{k}": F.when(ahead, F.col(f"{c}{k}")).otherwise(F.col(f"{c}{3 - k}")) for c in "xy" for k in (1, 2)}
    place = F.coalesce("before", F.lit(0)) + F.when(back, F.col("count") - 1 - F.col("at")).otherwise(F.col("at"))
    total = F.coalesce("total", "count")
    circle = F.coalesce("circle", "ring")
    made = {"line": F.coalesce("line", "frag"), "place": F.when(circle, place % total).otherwise(place), "closed": circle & (total >= 3)}
    return met.select(*(turned.get(c, F.col(c)).alias(c) for c in segments.columns), *(v.alias(k) for k, v in made.items()))


def line_vertices(edges: DataFrame) -> DataFrame:
    """``site, level, line, seq, x, y, confidence, closed`` of lines as by ``stitched``.

    A vertex has the lesser support of the segments that meet there. A closed line's first vertex isn't repeated.
    """
    start = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("place").alias("seq"), "confidence", F.lit(True).alias("starts"))
    end = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), (F.col("place") + 1).alias("seq"), "confidence", F.lit(False).alias("starts"))
    n = edges.groupBy(*LINE, "line").agg(F.count("*").alias("n"))
    v = edges.select(*LINE, "line", "closed", F.explode(F.array(start, end)).alias("v")).select(*LINE, "line", "closed", "v.*").join(n, [*LINE, "line"])
    v = v.withColumn("seq", F.when(F.col("closed"), F.col("seq") % F.col("n")).otherwise(F.col("seq")))
    # Where a segment starts, its own coordinates; the end of an open line has those of the last.
    at = F.max(F.struct("starts", "x", "y"))
    out = v.groupBy(*LINE, "line", "seq", "closed").agg(at.alias("p"), F.min("confidence").alias("confidence"))
    return out.select(*LINE, "line", "seq", "p.x", "p.y", "confidence", "closed")


def with_records(edges: DataFrame, records: DataFrame) -> DataFrame:
    """``edges`` with the columns of ``records(site, level, x1, y1, x2, y2, ...)``, whichever way round its edges run.

    Both are matched by the unordered pair of quantised ends; of several edges with the same ends, the k-th
    of ``edges`` (by line and place) takes the k-th record (by ``n``).
    """
    step = quantum(1.0)

    def keyed(df: DataFrame, order: list[str]) -> DataFrame:
        a, b = (F.struct(end_key(F.col(f"x{k}"), step).alias("x"), end_key(F.col(f"y{k}"), step).alias("y")) for k in (1, 2))
        df = df.withColumns({"__a": F.least(a, b), "__b": F.greatest(a, b)})
        return df.withColumn("__k", F.row_number().over(Window.partitionBy(*LINE, "__a", "__b").orderBy(*order)))

    on = [*LINE, "__a", "__b", "__k"]
    right = keyed(records, ["n"]).drop("x1", "y1", "x2", "y2", "n")
    return keyed(edges, ["line", "place"]).join(right, on, "left").drop("__a", "__b", "__k")
