"""Line simplification between gaps, and the spans that its retained vertices make of the edges.

Lines are dealt by ``line_id`` and lie in order in their task, which every window over the line then uses as well.
What Spark's functions cannot say, the recursive choice of vertices, is done by numpy over all stretches of a batch
at once, chord by chord of one level.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tellurion.operators.evidence import in_line, length

#: Rows of a batch that are handed to numpy, at least; a line's open stretch is carried into the next.
ROWS = 1 << 16


def retained(x: np.ndarray, y: np.ndarray, fixed: np.ndarray, tolerance: float, clamped: bool = False) -> np.ndarray:
    """Which vertices stay: those ``fixed``, of which the first and last are one each, and between two neighbours
    of them, again and again, the first that lies farthest from the chord if that is farther than ``tolerance``.

    Distances are to the chord's line, or ``clamped`` to the chord itself; a chord without length is a point.
    """
    keep, at = fixed.copy(), np.nonzero(fixed)[0]
    a, b = at[:-1], at[1:]
    while len(a := a[wide := b - a >= 2]):
        b = b[wide]
        inner = b - a - 1
        first = np.cumsum(inner) - inner
        of = np.repeat(np.arange(len(a)), inner)
        k = np.arange(len(of)) - first[of] + a[of] + 1
        dx, dy, px, py = (x[b] - x[a])[of], (y[b] - y[a])[of], x[k] - x[a][of], y[k] - y[a][of]
        square = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            if clamped:
                t = np.where(square > 0, np.clip((px * dx + py * dy) / square, 0, 1), 0)
                far = np.hypot(px - t * dx, py - t * dy)
            else:
                far = np.where(square > 0, np.abs(px * dy - py * dx) / np.sqrt(square), np.hypot(px, py))
        most = np.maximum.reduceat(far, first)
        split = np.minimum.reduceat(np.where(far == most[of], k, len(x)), first)
        more = most > tolerance
        a, b, split = a[more], b[more], split[more]
        keep[split] = True
        a, b = np.concatenate([a, split]), np.concatenate([split, b])
    return keep


def by_area(x: np.ndarray, y: np.ndarray, fixed: np.ndarray, tolerance: float, clamped: bool = False) -> np.ndarray:
    """Which vertices stay if again and again the one goes whose triangle with its neighbours is smallest, up to an area of ``tolerance``.

    Of equal triangles the first goes; vertices that are ``fixed``, the first and last among them, stay. A heap holds triangles as they
    were when a neighbour went; those that have had another one since are passed over.
    """
    n = len(x)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    keep, free, px, py = [True] * n, (~fixed).tolist(), x.tolist(), y.tolist()

    def area(a: int, k: int, b: int) -> float:
        return abs((px[a] - px[k]) * (py[b] - py[k]) - (px[b] - px[k]) * (py[a] - py[k])) / 2

    heap = [(size, k, k - 1, k + 1) for k in range(1, n - 1) if free[k] and (size := area(k - 1, k, k + 1)) <= tolerance]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        if not keep[k] or before[k] != a or after[k] != b:
            continue
        keep[k] = False
        after[a], before[b] = b, a
        for j in (a, b):
            if free[j]:
                size = area(before[j], j, after[j])
                if size <= tolerance:
                    heapq.heappush(heap, (size, j, before[j], after[j]))
    return np.array(keep)


#: Pieces of fewer edges are taken side by side by ``fewest``, so that no array has more entries than ``TOGETHER``.
SHORT, TOGETHER = 64, 1 << 18
#: Conditions on the spans of ``fewest``: none; the record of the two end edges claims no more than that of all; all edges alike.
CONDITIONS = ("any", "safe", "exact")


def _edges_of(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the edges between neighbours: their provenance, and both channels' values (infinite without)."""
    prov = columns["prov"]
    joined = np.where(prov[1:] == prov[:-1], prov[1:], "X")
    values = []
    for c in ("m", "i"):
        v = np.where(np.isnan(x := columns[c].astype(float)), np.inf, x)
        values.append(np.minimum(v[1:], v[:-1]))
    return joined, values


def fewest(x: np.ndarray, y: np.ndarray, fixed: np.ndarray, tolerance: float, clamped: bool = False, columns: dict[str, np.ndarray] | None = None, condition: str = "any") -> np.ndarray:
    """The fewest vertices between those ``fixed`` such that each span has all its vertices within ``tolerance`` of the line
    through its ends and meets the ``condition``: a shortest path over spans, of several the one with the first predecessors.

    A span that fails does so by some vertex; that one is tried first on the spans after it, so that few are measured whole.
    ``columns`` has the vertices' ``prov, m, i`` where there is a condition.
    """
    keep, at = fixed.copy(), np.nonzero(fixed)[0]
    a, b = at[:-1], at[1:]
    short, long = (b - a >= 2) & (b - a < SHORT), b - a >= SHORT
    _fewest_short(x, y, a[short], b[short], tolerance, keep, _allowed(columns, condition, SHORT) if condition != "any" and short.any() else None)
    for a, b in zip(a[long].tolist(), b[long].tolist(), strict=True):
        px, py, n = x[a : b + 1], y[a : b + 1], b - a + 1
        allowed = _allowed({k: v[a : b + 1] for k, v in columns.items()}, condition) if condition != "any" else None
        best, back = np.full(n, n + 1), np.zeros(n, np.int64)
        best[0] = 1
        for i in range(n - 1):
            if best[i] > n:
                continue
            to = np.arange(i + 1, n)
            if allowed is not None:
                to = to[allowed(i, to)]
            to = to[best[to] > best[i] + 1]
            dx, dy = px - px[i], py - py[i]
            length = np.hypot(dx, dy)

            def off(k, j, dx=dx, dy=dy, length=length, px=px, py=py):
                long = length[j]
                with np.errstate(divide="ignore", invalid="ignore"):
                    return np.where(long > 0, np.abs(dx[k] * dy[j] - dy[k] * dx[j]) / long, length[k])

            fits = []
            while len(to):
                j = int(to[0])
                far = off(np.arange(i + 1, j), j)
                if j == i + 1 or far.max() <= tolerance:
                    fits.append(j)
                    to = to[1:]
                else:
                    k = i + 1 + int(far.argmax())
                    to = to[(to <= k) | (off(k, to) <= tolerance)]
            best[fits], back[fits] = best[i] + 1, i
        k = n - 1
        while k:
            keep[a + k] = True
            k = int(back[k])
    return keep


def _fewest_short(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float, keep: np.ndarray, allowed: Callable | None) -> None:
    """``fewest`` between the vertices ``a`` and ``b`` of many short pieces, marked in ``keep``: pieces of as many vertices side by side, every span measured whole."""
    for n in np.unique(b - a + 1).tolist():
        of = a[b - a + 1 == n]
        for first in np.array_split(of, -(-len(of) * n * n // TOGETHER)):
            px, py = x[at := first[:, None] + np.arange(n)], y[at]
            best, back = np.full((len(first), n), n + 1), np.zeros((len(first), n), np.int64)
            best[:, 0] = 1
            for i in range(n - 1):
                dx, dy = px[:, i + 1 :] - px[:, i : i + 1], py[:, i + 1 :] - py[:, i : i + 1]
                length = np.hypot(dx, dy)
                long = length[:, None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = np.where(long > 0, np.abs(dx[:, :, None] * dy[:, None, :] - dy[:, :, None] * dx[:, None, :]) / long, length[:, :, None])
                inner = np.triu(np.ones((n - 1 - i, n - 1 - i), bool), 1)
                better = (np.where(inner, far, 0).max(1) <= tolerance) & (best[:, i + 1 :] > best[:, i : i + 1] + 1)
                if allowed is not None:
                    better &= allowed(at[:, i : i + 1], at[:, i + 1 :])
                best[:, i + 1 :] = np.where(better, best[:, i : i + 1] + 1, best[:, i + 1 :])
                back[:, i + 1 :][better] = i
            row, k = np.arange(len(first)), np.full(len(first), n - 1)
            while len(row):
                keep[first[row] + k] = True
                k = back[row, k]
                row, k = row[k > 0], k[k > 0]


def _allowed(columns: dict[str, np.ndarray], condition: str, most: int | None = None) -> Callable:
    """A test of spans, of up to ``most`` edges, from one vertex to several others, or from each of several, by their edges alone."""
    prov, values = _edges_of(columns)
    if condition == "exact":
        alike = (prov[1:] == prov[:-1]) & (values[0][1:] == values[0][:-1]) & (values[1][1:] == values[1][:-1])
        run = np.concatenate([[0], np.cumsum(~alike)])
        return lambda i, to: run[to - 1] == run[i]
    # Least values of 2**k edges, and how many edges of either kind come before.
    tables = []
    for v in values:
        levels = [v]
        while 2 << (len(levels) - 1) <= min(len(v), most or len(v)):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        tables.append(levels)
    carries = [(prov == own) | (prov == "X") for own in ("M", "I")]
    kinds = [np.concatenate([[0], np.cumsum(x)]) for x in carries]
    other = np.concatenate([[0], np.cumsum(~(carries[0] | carries[1]))])

    def safe(i: int | np.ndarray, to: np.ndarray) -> np.ndarray:
        ok, size = other[to] == other[i], to - i
        start, level = np.broadcast_to(i, to.shape), np.frexp(size)[1] - 1
        for v, levels in zip(values, tables, strict=True):
            least = np.empty(to.shape)
            for k in np.unique(level).tolist():
                on = level == k
                least[on] = np.minimum(levels[k][start[on]], levels[k][to[on] - (1 << k)])
            ends = np.minimum(v[i], v[to - 1])
            ok &= np.isinf(ends) | (ends <= least + 1e-12)
        for has, upto in zip(carries, kinds, strict=True):
            ok &= has[i] | has[to - 1] | (upto[to] == upto[i])
        return ok

    return safe


def stretches(vertices: DataFrame) -> DataFrame:
    """Supported vertices with ``run``, their stretch between gaps: vertices of provenance ``U`` and breaks in ``seq``."""
    gaps = F.sum(F.when(F.col("prov") == "U", 1).otherwise(0)).over(in_line())
    return vertices.withColumn("run", gaps).where(F.col("prov") != "U")


def thinned(placed: DataFrame, tolerance: float, methods: dict[str, Column | None], clamped: bool = False, choose: Callable | dict[str, Callable] = retained, columns: tuple[str, ...] = ()) -> DataFrame:
    """``placed(line_id, run, seq, x, y, ...)`` with a boolean column a method: whether it retains the vertex.

    The ends of every stretch (``line_id, run``) are retained, and the vertices where the method's column is
    true: so no chord crosses a gap or a forced vertex. Coordinates must not be null. An empty table gives no
    rows, a vertex alone is retained. ``choose(x, y, fixed, tolerance, clamped)`` is any way to choose vertices (``retained``,
    ``by_area``, ``fewest``), which also gets those of ``columns``, or one a method. A task holds the batch and the stretch that is open at its end.
    """
    marked = placed.select(*placed.columns, *((F.lit(False) if m is None else F.coalesce(m, F.lit(False))).alias(f"__{k}") for k, m in enumerate(methods.values())))
    schema = StructType([*placed.schema.fields, *(StructField(m, BooleanType()) for m in methods)])
    given, made = placed.columns, list(methods)
    keys = [given.index(c) for c in ("line_id", "run", "x", "y")]

    def keeps(t: pa.Table) -> pa.Table:
        line, run, x, y = (t.column(k).to_numpy() for k in keys)
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (run[1:] != run[:-1])])
        last = np.append(new[1:], True)
        more = {"columns": {c: t.column(given.index(c)).to_numpy() for c in columns}} if columns else {}
        found = []
        for k in range(len(made)):
            fixed = t.column(len(given) + k).to_numpy().astype(bool) | new | last
            # The end of one stretch and the start of the next are neighbours, so no chord lies between them.
            pick = choose[made[k]] if isinstance(choose, dict) else choose
            found.append(pa.array(pick(x.astype(float), y.astype(float), fixed, tolerance, clamped, **more)))
        return pa.Table.from_arrays([*t.columns[: len(given)], *found], names=[*given, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows >= ROWS:
                line, runs = (held.column(k).to_numpy() for k in keys[:2])
                open_ = np.nonzero((line != line[-1]) | (runs != runs[-1]))[0]
                if len(open_):
                    cut = int(open_[-1]) + 1
                    yield from keeps(held.slice(0, cut).combine_chunks()).to_batches()
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from keeps(held.combine_chunks()).to_batches()

    return marked.repartition("line_id").sortWithinPartitions("line_id", "seq").mapInArrow(run, schema)


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """Supported vertices with ``run``, their stretch between gaps, and ``keep``."""
    return thinned(stretches(vertices), tolerance, {"keep": None})


def edges_within(kept: DataFrame, *methods: str) -> DataFrame:
    """The edges within stretches, and a column a method: the number of vertices it retains up to the edge's start in
    the line, which names the span that replaces the edge."""
    # All by the line's own order: a stretch is a part of it, and another window would sort anew.
    after = {f"{c}2": F.lead(c).over(in_line()) for c in ("run", "x", "y", "prov", "m", "i")}
    e = kept.withColumns({m: F.count_if(m).over(in_line()) for m in methods} | after).where((F.col("run2") == F.col("run")) & F.col("prov2").isNotNull())
    prov = F.when(F.col("prov") == F.col("prov2"), F.col("prov")).otherwise("X")
    return e.select("line_id", "run", "seq", *methods, length().alias("len"), prov.alias("prov"), F.least("m", "m2").alias("m"), F.least("i", "i2").alias("i"))


def spans(kept: DataFrame) -> DataFrame:
    return edges_within(kept.withColumnRenamed("keep", "span"), "span").drop("run")


# -- where lines must be cut ---------------------------------------------------------------------------------


def band(value: Column) -> Column:
    """Support band of an edge's channel: 2 from 66 on, 1 from 33 on, 0 below, - without a value."""
    return F.when(value.isNull(), "-").when(value >= 66, "2").when(value >= 33, "1").otherwise("0")


def binned(value: Column, width: float) -> Column:
    """A channel's value in bins of ``width``; of width 0, the value itself."""
    return F.coalesce((value if width == 0 else F.floor(value / width)).cast("string"), F.lit("-"))


def edge_class(prov: Column, m: Column, i: Column, kind: str, width: float = 0) -> Column:
    """Class of an edge: its provenance (``kind`` prov), with the ``band`` or the ``bin`` of both its channels."""
    if kind == "prov":
        return prov
    of = band if kind == "band" else lambda v: binned(v, width)
    return F.concat_ws("|", prov, of(m), of(i))


def with_boundaries(placed: DataFrame, kinds: dict[str, tuple]) -> DataFrame:
    """``placed`` with a boolean column a kind ``(name, bin width)``: whether the vertex parts two edges of its stretch of another class."""
    in_run = Window.partitionBy("line_id", "run").orderBy("seq")
    after = {c: F.lead(c).over(in_run) for c in ("prov", "m", "i")}
    joined = F.when(F.col("prov") == after["prov"], F.col("prov")).when(after["prov"].isNotNull(), F.lit("X"))
    e = placed.withColumns({"__p": joined, "__m": F.least("m", after["m"]), "__i": F.least("i", after["i"])})
    e = e.withColumns({f"__{n}": F.when(F.col("__p").isNotNull(), edge_class(F.col("__p"), F.col("__m"), F.col("__i"), *k)) for n, k in kinds.items()})
    return e.select(*placed.columns, *(F.coalesce(F.col(f"__{n}") != F.lag(f"__{n}").over(in_run), F.lit(False)).alias(n) for n in kinds))
