"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into halves, each quantised by its own k-means codebook; a pair of centroids is a cell. For a
query the two lists of centroids, ordered by inner product with the query's halves, are traversed in order of
their sum by a heap, until the cells hold a share of all entries. That share is measured: it is what the sample's
own queries need for ``RECALL`` of their neighbours there. Entries of the cells that a query visits are ranked by the
exact inner product. In the exact mode a cell is visited unless its bound (inner product with the centroids plus the
query's norm times the cell's radius) lies under a floor that cells of the sample give, so the result is that of brute
force. Entries lie in groups of neighbouring cells or of parts of a hot cell, which queries that visit one meet in
blocks, so neither a hot cell nor a popular one is one task's work.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion.llm._util import cut, join_small, table

#: Vectors that the codebooks are fitted on, and centroids a half. Every row is indexed.
SAMPLE, CENTROIDS, ROUNDS = 20_000, 32, 12
#: Share of the true neighbours that the traversal is to find, and the rows of the sample that tell how far it has to go.
RECALL, ASKED = 0.97, 512
#: Vectors of the sample that a query is compared with for its floor. More only make the floor tighter.
FLOOR = 2_000
#: Entries and queries that meet in a task, and the queries scored at once there.
ENTRIES, QUERIES, AT_ONCE = 4_096, 4_096, 128
TOP = 20


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) of vectors that aren't null or zero and hold only finite numbers; of rows that repeat a ``vec_id``, one."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # The least by value, so that reruns agree.
    return v.where(fine & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of Lloyd's k-means, started by a farthest-point pass from the first row."""
    at, near = [0], np.full(len(x), np.inf)
    while len(at) < min(k, len(x)):
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
        at.append(int(near.argmax()))
    c = x[at].copy()
    for _ in range(ROUNDS):
        own = nearest(x, c)
        count = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in descending order of ``a[i] + b[j]`` until they hold ``enough`` entries; empty cells are passed over."""
    oa, ob = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    heap, seen, got, cells = [(-(a[oa[0]] + b[ob[0]]), 0, 0)], {(0, 0)}, 0, []
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        n = int(counts[oa[i], ob[j]])
        if n:
            cells.append(oa[i] * len(ob) + ob[j])
            got += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(oa) and q < len(ob) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(a[oa[p]] + b[ob[q]]), p, q))
    return cells


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def slack(width: int, size: np.ndarray) -> np.ndarray:
    """More than rounding can move an inner product of vectors whose norms have the product ``size``."""
    return 8 * (width + 8) * np.finfo(float).eps * size


def measured_share(x: np.ndarray, cell: np.ndarray, sums: np.ndarray, top: int) -> float:
    """The share of entries in cells by descending ``sums`` (a row for each of the first rows of ``x``) that holds ``RECALL`` of those rows' ``top`` nearest.

    In a table of more rows than the sample, neighbours are nearer and need less.
    """
    n, need = len(x), []
    counts = np.bincount(cell, minlength=sums.shape[1])
    score = x[: len(sums)] @ x.T
    score[np.arange(len(sums)), np.arange(len(sums))] = -np.inf
    for near, row in zip(score, sums, strict=True):
        order = np.argsort(-row, kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        best = np.argsort(-near, kind="stable")[: min(top, n - 1)]
        need.append(upto[cell[best]] / n)
    return float(np.quantile(np.concatenate(need), RECALL, method="higher")) if n > 1 else 1.0


def _best(left: pd.DataFrame, right: pd.DataFrame, top: int) -> pd.DataFrame:
    """The ``top`` entries (right) of each query (left) of one block in the cells that it visits, the query's own row left out.

    Queries are taken together by their cell, so that those that visit much the same cells are; cells that none of them visits aren't scored.
    """
    if left.empty or right.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    left, right = left.sort_values(["cell", "query_id"]), right.sort_values("vec_id")
    queries, q, every, cells = left["query_id"].to_numpy(), np.stack(left["v"]), np.stack(right["v"]), right["cell"].to_numpy()
    visits = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in left["visits"]]), axis=1).astype(bool)
    room, out = slack(q.shape[1], np.linalg.norm(q, axis=1) * np.linalg.norm(every, axis=1).max()), []
    for at in range(0, len(q), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        met = np.nonzero(visits[some].any(0)[cells])[0]
        if not len(met):
            continue
        ids, e = right["vec_id"].to_numpy()[met], every[met]
        rough = q[some] @ e.T
        passed = ~visits[some][:, cells[met]] | (queries[some, None] == ids)
        rough[passed] = -np.inf
        least = np.partition(rough, -top, axis=1)[:, -top] - room[some] if len(ids) > top else np.full(len(rough), -np.inf)
        who, which = np.nonzero(~(rough < least[:, None]) & ~passed)
        score = np.zeros(len(who))
        for j in range(q.shape[1]):  # in one fixed order, so that equal vectors get equal scores
            score += q[at + who, j] * e[which, j]
        order = np.lexsort((which, -score, who))
        who, which, score = who[order], which[order], score[order]
        good = np.arange(len(who)) - np.searchsorted(who, who) < top
        out.append(pd.DataFrame({"query_id": queries[at + who[good]], "vec_id": ids[which[good]], "score": score[good]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


def grouped(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each cell: small cells in turn share one of about ``ENTRIES`` entries."""
    first, parts, at, held = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // ENTRIES)), 0, 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > ENTRIES:
            at, held = at + 1, 0
        first[c] = at
        at, held = (at + parts[c], 0) if parts[c] > 1 else (at, held + n)
    return first, parts


def search(vectors: DataFrame, is_query: Column, top: int = TOP, exact: bool = True) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row of ``vectors(vec_id, embedding)`` its ``top`` nearest.

    ``exact`` finds all of them, otherwise about ``RECALL`` of them in the cells that the traversal comes to.

    Nearness is the inner product in double precision of the original vectors; ties go to the smaller
    ``vec_id``. Null and zero vectors, and those with a null or non-finite number or another length than most
    of the sample, take no part, nor do rows without ``vec_id``. A query never finds its own row; with fewer
    candidates it gets all of those. Rows that repeat a ``vec_id`` are one; equal vectors under different ids are
    entries of their own; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    fine = cut(usable(vectors))
    sample = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # SAMPLE rows
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return empty
    lengths = pc.list_value_length(sample["v"]).to_numpy()
    width = int(np.bincount(lengths).argmax())
    sample = sample.filter(pa.array(lengths == width))
    x, known = _matrix(sample["v"].combine_chunks()), sample["vec_id"].to_numpy()
    if width == 1:  # a second half that is nought changes no inner product
        fine, x = fine.select("vec_id", F.concat("v", F.array(F.lit(0.0))).alias("v")), np.pad(x, ((0, 0), (0, 1)))
        width = 2
    half = width // 2
    one, two = codebook(x[:, :half], CENTROIDS), codebook(x[:, half:], CENTROIDS)
    books = spark.sparkContext.broadcast((one, two))  # CENTROIDS rows each

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                i, j = nearest(m[:, :half], one), nearest(m[:, half:], two)
                far = np.hypot(np.linalg.norm(m[:, :half] - one[i], axis=1), np.linalg.norm(m[:, half:] - two[j], axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((i * len(two) + j).astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    index = cut(fine.where(F.size("v") == width).mapInArrow(place, "vec_id long, v array<double>, cell int, far double"))
    counts, radius = np.zeros(len(one) * len(two), np.int64), np.zeros(len(one) * len(two))
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most CENTROIDS squared
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    first, parts = grouped(counts)
    cell = nearest(x[:, :half], one) * len(two) + nearest(x[:, half:], two)
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(len(counts) + 1))
    shared = spark.sparkContext.broadcast((x[order], known[order], starts))  # SAMPLE rows
    some = x[:ASKED]
    sums = ((some[:, :half] @ one.T)[:, :, None] + (some[:, half:] @ two.T)[:, None]).reshape(len(some), -1)
    enough = 0 if exact else math.ceil(measured_share(x, cell, sums, top) * counts.sum())

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        x, known, starts = shared.value
        sampled = np.diff(starts).reshape(len(one), len(two))
        members = [range(f, f + p) if n else range(0) for f, p, n in zip(first.tolist(), parts.tolist(), counts.tolist(), strict=True)]
        reach = np.hypot(np.linalg.norm(one, axis=1)[:, None], np.linalg.norm(two, axis=1)[None]).ravel() + radius

        def cells(own: int, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
            if enough:
                return np.array(traverse(r, s, counts.reshape(len(one), len(two)), enough))
            rows = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in traverse(r, s, sampled, FLOOR)])
            rows = rows[known[rows] != own]
            floor = np.partition(x[rows] @ q, -top)[-top] if len(rows) >= top else -np.inf
            norm = np.linalg.norm(q)
            bound = (r[:, None] + s[None]).ravel() + norm * radius + slack(width, norm * reach)
            return np.nonzero(~(bound < floor))[0]

        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                met, marks = [], []
                for row in zip(b.column(0).to_pylist(), m, m[:, :half] @ one.T, m[:, half:] @ two.T, strict=True):
                    mark = np.zeros(len(counts), bool)
                    mark[cells(*row)] = True
                    met.append(sorted({g for c in np.nonzero(mark)[0].tolist() for g in members[c]}))
                    marks.append(np.packbits(mark).tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.binary()), pa.array(met, pa.list_(pa.int64()))], names=["query_id", "v", "cell", "visits", "met"])

    visits = cut(index.where(is_query).select("vec_id", "v", "cell").mapInArrow(visit, "query_id long, v array<double>, cell int, visits binary, met array<long>").select("query_id", "v", "cell", "visits", F.explode("met").alias("g")))
    asked = cut(visits.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")))  # a row a group
    cells = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in np.nonzero(counts)[0].tolist()], "cell int, first long, parts long")  # at most CENTROIDS squared
    entries = index.join(F.broadcast(cells), "cell").select("vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("g"))
    entries = join_small(entries, asked, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("q"), "vec_id", "v", "cell")
    queries = join_small(visits, asked, "g").select("g", F.pmod(F.xxhash64("query_id"), "blocks").alias("q"), "query_id", "v", "cell", "visits")
    found = queries.groupBy("g", "q").cogroup(entries.groupBy("g", "q")).applyInPandas(lambda left, right: _best(left, right, top), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, exact=False)
