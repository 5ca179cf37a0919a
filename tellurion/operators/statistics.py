"""Statistics of audits: rank correlation, shares with their intervals, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.sources.shared import written

#: Fixed value: the normal deviate of a two-sided 95 % interval.
Z95 = 1.959963984540054


#: Quantiles of a group that part its values for running sums.
PARTS = 256


def running(counts: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """``counts(by, value, weight)`` with ``upto``, the sum of ``weight`` over the group's values up to this one.

    Values are unique in their group and numbers. A group is parted at approximate quantiles of its values, and only
    the parts' sums are summed across them, so that no task holds a large group's values.
    """
    cuts = counts.groupBy(by).agg(F.percentile_approx(value, F.lit([k / PARTS for k in range(1, PARTS)]), F.lit(10_000)).alias("__cuts"))
    parted = counts.join(cuts, by).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sums = parted.groupBy(by, "__part").agg(F.sum(weight).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(weight).over(Window.partitionBy(by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return parted.join(sums.select(by, "__part", before.alias("__before")), [by, "__part"]).withColumn("upto", within + F.col("__before")).drop("__part", "__before")


def rank_correlation(df: DataFrame, by: str, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Spearman's coefficient of ``a`` and ``b`` a group, ties at their average rank: ``by, n, rho``. A row counts ``weight`` (whole) times.

    Rows are counted by pair of values first, so that windows see distinct values and never a group's rows.
    Rows with a null take no part; ``rho`` is null under three rows or where a column doesn't vary.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, a, b).agg((F.sum(weight) if weight else F.count("*")).alias("w"))

    def ranks(value: str, name: str) -> DataFrame:
        upto = running(pairs.groupBy(by, value).agg(F.sum("w").alias("w")), by, value, "w")
        return upto.select(by, value, (F.col("upto") - (F.col("w") - 1) / 2.0).alias(name))

    # Ranks grow with the values: merged, so that they don't pass the driver.
    met = pairs.join(ranks(a, "ra").hint("merge"), [by, a]).join(ranks(b, "rb").hint("merge"), [by, b])
    n, mean = F.sum("w"), (F.sum("w") + 1) / 2.0
    dot = F.sum(F.col("w") * F.col("ra") * F.col("rb")) - n * mean * mean
    va, vb = (F.sum(F.col("w") * F.col(r) * F.col(r)) - n * mean * mean for r in ("ra", "rb"))
    out = met.groupBy(by).agg(n.alias("n"), dot.alias("dot"), va.alias("va"), vb.alias("vb"))
    rho = F.when((F.col("n") >= 3) & (F.col("va") > 0) & (F.col("vb") > 0), F.col("dot") / F.sqrt(F.col("va") * F.col("vb")))
    return out.select(by, "n", rho.alias("rho"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share of ``k`` in ``n``; null where ``n`` is 0."""
    p, zz = F.try_divide(k, n), Z95 * Z95
    middle, width = p + F.try_divide(F.lit(zz), 2.0 * n), Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(zz), 4.0 * n * n))
    whole = 1 + F.try_divide(F.lit(zz), n)
    return (middle - width) / whole, (middle + width) / whole


# -- quantiles ---------------------------------------------------------------------------------------------------


def lower_quantile(values: Column, q: float) -> Column:
    """Of a sorted array, the value at ``floor(q (n - 1))``."""
    return F.get(values, F.floor(q * (F.size(values) - 1)).cast("int"))


def upper_median(values: Column) -> Column:
    """Of a sorted array, the middle value, or the upper of the two."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def weighted_median(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """``by, median``: the least value up to which half of the group's weight lies. Nulls and weights of 0 take no part."""
    counts = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(by, value).agg(F.sum(weight).alias("w"))
    total = counts.groupBy(by).agg(F.sum("w").alias("total"))
    return running(counts, by, value, "w").join(total, by).where(F.col("upto") * 2 >= F.col("total")).groupBy(by).agg(F.min(value).alias("median"))


def quantiles(df: DataFrame, by: str, value: str, levels: dict[str, float]) -> DataFrame:
    """``by, n`` and a column a level: the group's quantiles, interpolated linearly, from running sums over distinct values, so that no task holds a group. Nulls take no part."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("w"))
    total = counts.groupBy(by).agg(F.sum("w").alias("n"))
    ranked = running(counts, by, value, "w").join(total, by)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    out = []
    for name, q in levels.items():
        h = (F.col("n") - 1) * F.lit(q)
        low = F.floor(h)
        out += [at(low).alias(f"__{name}"), at(F.least(low + 1, F.col("n") - 1)).alias(f"__{name}2"), F.first(h - low).alias(f"__{name}h")]
    met = ranked.groupBy(by).agg(F.first("n").alias("n"), *out)
    return met.select(by, "n", *((F.col(f"__{c}") + F.col(f"__{c}h") * (F.col(f"__{c}2") - F.col(f"__{c}"))).alias(c) for c in levels))


def distribution(by_unit: DataFrame, keys: list[str], rate: str) -> DataFrame:
    """Units, least, quartiles and greatest of ``rate``, interpolated linearly; null rates take no part."""
    levels = {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "greatest": 1.0}
    out = quantiles(by_unit.withColumn("__by", F.struct(*keys)), "__by", rate, levels)
    return out.select("__by.*", F.col("n").alias("units"), *levels)


# -- seeded draws ------------------------------------------------------------------------------------------------

#: Draws that one task makes or takes.
DRAWS = 1 << 19
_MASK = 0xFFFFFFFF


def _times(x: Column, y: Column) -> Column:
    """Lower 32 bits of a product of two numbers of 32 bits, without overflow."""
    high = F.shiftleft((x * F.shiftright(y, 16)).bitwiseAND(0xFFFF), 16)
    return (x * y.bitwiseAND(0xFFFF) + high).bitwiseAND(_MASK)


def with_draw(df: DataFrame, seed: int, k: Column, name: str) -> DataFrame:
    """``df`` with the ``k``-th number (from 0) in [0, 1) of the mulberry32 generator with this seed.

    Its state only counts up, so that draws need no order. Each step is a column, so that none is computed twice.
    """
    t, c = F.col("__t"), F.col("__c")
    step = _times(F.lit(0x6D2B79F5).cast("long"), (k + 1).bitwiseAND(_MASK))
    out = df.withColumn("__t", (F.lit(seed & _MASK) + step).bitwiseAND(_MASK))
    for shift, mask in ((15, 1), (7, 61)):
        out = out.withColumn("__c", t.bitwiseXOR(F.shiftright(t, shift))).withColumn("__c", _times(c, t.bitwiseOR(mask)))
        out = out.withColumn("__t", c if shift == 15 else (t + c).bitwiseAND(_MASK).bitwiseXOR(t))
    return out.withColumn(name, t.bitwiseXOR(F.shiftright(t, 14)) / float(1 << 32)).drop("__t", "__c")


def numbered(df: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """``df`` with ``number``, from 0 on, in order of ``key`` modulo ``buckets`` and then ``key`` (a unique integer).

    Rows are numbered within buckets; only the buckets' counts pass one task.
    """
    bucket = F.pmod(F.col(key), F.lit(buckets))
    placed = df.withColumn("__bucket", bucket)
    counts = placed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most ``buckets`` rows
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(key)) - 1
    return placed.join(F.broadcast(counts.select("__bucket", before.alias("__before"))), "__bucket").withColumn("number", (own + F.col("__before")).cast("long")).drop("__bucket", "__before")


def parts(units: int, replicates: int) -> int:
    """Tasks that make, or take, the draws of so many units and replicates: each about ``DRAWS`` of them, so that its memory doesn't grow with the units."""
    return max(1, -(-units * replicates // DRAWS))


def dealt(drawn: DataFrame, placed: DataFrame, units: int, replicates: int) -> DataFrame:
    """``drawn(number, ...)`` with the units of these numbers. Both are dealt by number over ``parts``; a task holds its own units and passes the draws by."""
    k = parts(units, replicates)
    return drawn.repartition(k, "number").join(placed.repartition(k, "number").hint("shuffle_hash"), "number").drop("number")


def bootstrap_ratio(units: DataFrame, key: str, top: str, bottom: str, seed: int, replicates: int) -> DataFrame:
    """``replicate, ratio``: the ratio of sums over as many units as there are, drawn with replacement.

    Draw ``j`` of replicate ``r`` takes unit ``floor(u n)`` of the generator's number ``r n + j``.
    """
    placed = written(numbered(units.select(key, top, bottom), key))
    n = placed.count()
    ids = units.sparkSession.range(0, n * replicates, 1, parts(n, replicates))
    drawn = with_draw(ids.withColumn("replicate", F.floor(F.col("id") / n).cast("int")), seed, F.col("id"), "u")
    # Never null, so that the join adds no test of it, which would go down through all the steps of a draw.
    drawn = drawn.select("replicate", F.coalesce(F.floor(F.col("u") * n), F.lit(0)).alias("number"))
    met = dealt(drawn, placed, n, replicates)
    return met.groupBy("replicate").agg(F.try_divide(F.sum(top), F.sum(bottom)).alias("ratio"))


def concentration(units: DataFrame, top: str, bottom: str, key: str, k: int = 3) -> DataFrame:
    """Share of the ``k`` units with most of ``top``, the pooled ratio, without them, and with any one unit left out at least and most."""
    total = units.agg(F.sum(top).alias("t"), F.sum(bottom).alias("b"))
    # The first k of all, by a sort with a limit; ties to the smaller key.
    most = units.orderBy(F.desc(top), key).limit(k).agg(F.sum(top).alias("kt"), F.sum(bottom).alias("kb"))
    one = F.try_divide(F.col("t") - F.col(top), F.col("b") - F.col(bottom))
    left = units.join(F.broadcast(total)).agg(F.min(one).alias("least_without_one"), F.max(one).alias("most_without_one"))
    return total.join(F.broadcast(most)).join(F.broadcast(left)).select(F.try_divide("kt", "t").alias("top_share"), F.try_divide("t", "b").alias("pooled"), F.try_divide(F.col("t") - F.col("kt"), F.col("b") - F.col("kb")).alias("pooled_without_top"), "least_without_one", "most_without_one")
