"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's sketch holds the smallest hashes of its word shingles, a fixed share of its set. That share is such
that a similar pair has at least ``spare`` values in both sketches, so (prefix filtering) it meets in the lists of
each sketch's rarest values: no similar pair is missed. The sketch of the union bounds the similarity from above
and filters, and what passes is confirmed by the Jaccard coefficient of the full sets. Documents with equal sets
are one class throughout.

In a list, all members are compared with pivots, one at first; classes that this leaves apart are compared likewise in
lists of their full sets, with many times as many pivots in each further round, and a pivot that has met its list
leaves it. Members of one component are not compared again, and a list ends once its
members are one component, so a group of copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._joins import components, counted_join, spread_join
from tellurion.llm._util import cut, free, join_small, lean, table
from tellurion.llm._words import FOLD, chunks, run_codes, stirred, word_codes

WORDS, SIMILARITY = 5, 75
#: Of a set of n, a similar pair shares at least 0.75 n; a sketch holds the n / 4 values beyond that and one value
#: more for every so many of the set. More make the filter sharper and the sketches larger.
SPARE = 8
#: Pivots of a list in the first round over full sets, and in each round as a multiple of those in the one before.
FIRST_PIVOTS, MORE_PIVOTS = 8, 16
_TOP = np.uint64(1 << 63)


def least_common(n: int) -> int:
    """Fewest values that a set of ``n`` shares with a similar one."""
    return (SIMILARITY * n + 99) // 100


def spare(n: int) -> int:
    return (n + SPARE - 1) // SPARE


#: ``least_common(n)`` and ``spare(least_common(n))`` as SQL.
_LEAST = f"({SIMILARITY} * n + 99) div 100"
_MET = f"({_LEAST} + {SPARE - 1}) div {SPARE}"


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its word n-grams; of fewer words, of the whole sequence."""
    code, at = word_codes([t.translate(FOLD) for t in texts])
    runs = run_codes(code, words)
    return [np.unique(runs[s : e - words + 1]) if e - s >= words else run_codes(code[s:e], e - s)[: min(1, e - s)] for s, e in zip(at.tolist(), at[1:].tolist(), strict=False)]


def _mapped(docs: DataFrame, schema: str, row, kinds: list) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches):
            rows = [row(x) for x in shingles(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(run), schema)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n, key, sketch``: set size, a digest of the full set, and its smallest hashes, with the top bit
    flipped so that they have the same order as signed longs."""

    def row(x: np.ndarray) -> tuple:
        from xxhash import xxh3_128_digest

        return len(x), xxh3_128_digest(x.tobytes()), (x[: len(x) - least_common(len(x)) + spare(len(x))] ^ _TOP).view(np.int64)

    return _mapped(docs, "doc_id long, n long, key binary, sketch array<long>", row, [pa.int64(), pa.binary(), pa.list_(pa.int64())])


def full_sets(docs: DataFrame) -> DataFrame:
    return _mapped(docs, "doc_id long, full array<long>", lambda x: (x.view(np.int64),), [pa.list_(pa.int64())])


def inverted_lists(classes: DataFrame, met: str) -> DataFrame:
    """``value, doc_id, n, k, at, weight`` of each class's rarest retained values, as many as leave no similar pair
    apart: its set's and sketch's sizes and how many of its retained values are rarer still.

    A pair has at least ``met`` (SQL of ``n``) values in common in its sketches, so it meets among each one's rarest
    values but for that many less one.
    """
    posted = classes.select(F.explode("sketch").alias("value"), "doc_id", F.struct("n", F.size("sketch").cast("long").alias("k")).alias("of"))
    shared = cut(posted.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > 1).withColumn("df", F.col("n")))
    held = counted_join(posted, shared, "value").groupBy("doc_id", "of").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"), F.sum("df").alias("weight"))
    per = held.select("doc_id", "of.n", "of.k", "weight", "held").withColumn("rare", F.size("held") - F.expr(met) + 1).where(F.col("rare") > 0)
    per = per.select("doc_id", "n", "k", "weight", (F.col("k") - F.size("held")).alias("alone"), F.posexplode(F.slice("held", F.lit(1), F.col("rare").cast("int"))["value"]).alias("at", "value"))
    lists = cut(per.select("value", "doc_id", "n", "k", (F.col("alone") + F.col("at")).alias("at"), "weight"))
    free(shared)
    return lists


def _fits(common, na, nb):
    return 100 * common >= SIMILARITY * (na + nb - common)


def _meets_here() -> F.Column:
    """Whether a similar pair of sizes ``n, na`` can have this value as its rarest common one.

    It has ``(n + na) * 75 / 175`` values in common, of which both sketches lack at most what one of them leaves
    out; the rarest of the others lies before all of them in both sketches.
    """
    common = F.expr(f"({SIMILARITY} * (n + na) + {99 + SIMILARITY}) div {100 + SIMILARITY}") - F.greatest(F.col("n") - F.col("k"), F.col("na") - F.col("ka"))
    common = F.greatest(common, F.lit(1))
    return (F.col("at") + common <= F.col("k")) & (F.col("pa") + common <= F.col("ka"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame | None) -> DataFrame:
    """The pairs ``a, b`` of ``pairs(a, b, na, nb)`` that the sketches let pass and the full sets confirm.

    Up to the smaller of their last values both sketches are complete; beyond, the smaller rest at most is
    common. A sketch that holds its whole set is complete everywhere.
    """
    sketch = classes.select("doc_id", "sketch")
    both = spread_join(pairs, sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    last = [F.when(F.size(s) < F.col(n), F.element_at(s, -1)) for s, n in (("sa", "na"), ("sb", "nb"))]
    both = both.withColumn("upto", F.coalesce(F.least(*last), F.lit((1 << 63) - 1)))
    rest = F.least(*(F.col(n) - F.size(F.filter(s, lambda x: x <= F.col("upto"))) for s, n in (("sa", "na"), ("sb", "nb"))))
    likely = cut(both.where(_fits(F.size(F.array_intersect("sa", "sb")) + rest, F.col("na"), F.col("nb"))).select("a", "b"))
    if docs is None:  # the sketches are the full sets
        return likely
    nodes = cut(likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct())
    sets = cut(full_sets(join_small(docs, nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"])))
    full = spread_join(likely, sets.toDF("a", "fa"), "a").join(sets.toDF("b", "fb"), "b")
    linked = cut(full.where(_fits(F.size(F.array_intersect("fa", "fb")), F.size("fa"), F.size("fb"))).select("a", "b"))
    free(likely, nodes, sets)
    return linked


def _placed(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    """``lists`` with each class's ``component`` and its ``size``, those of lists whose members are one component left out."""
    if found is None:
        placed = lists.withColumns({"component": F.col("doc_id"), "size": F.lit(1).cast("long")})
    else:
        sizes = spread_join(found, found.groupBy("component").agg(F.count("*").alias("size")), "component").withColumnRenamed("node", "doc_id")
        placed = lists.join(sizes, "doc_id", "left").withColumns({"component": F.coalesce("component", "doc_id"), "size": F.coalesce("size", F.lit(1).cast("long"))})
    placed = cut(placed)
    apart = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    live = cut(placed.join(apart, "value", "left_semi"))
    free(placed)
    return live


def _pivots(live: DataFrame, pivots: int) -> DataFrame:
    """``value, a, na, ka, pa, ca``: one pivot a list and salt, of the smallest component the class whose values most hold."""
    order = F.struct((-F.col("size")).alias("size"), "weight", (-F.col("doc_id")).alias("p"), "n", "k", "at", "component")
    salted = live.groupBy("value", F.pmod(F.xxhash64("doc_id", F.lit(pivots)), F.lit(pivots)).alias("salt")).agg(F.max(order).alias("x"))
    return cut(salted.select("value", (-F.col("x.p")).alias("a"), F.col("x.n").alias("na"), F.col("x.k").alias("ka"), F.col("x.at").alias("pa"), F.col("x.component").alias("ca")))


def _links(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """``node, component`` of every class that is linked with another; None if none is.

    One round over the lists of sketches joins what a pivot joins. Classes that then still meet in a list but lie in
    different components get lists of their full sets, whose rarest values are far fewer: between them, a pair
    must share all but 0.14 of each set, and a set's own values come first.
    """
    links = found = None
    lists, pivots = inverted_lists(classes, _MET), 1
    while True:
        live = _placed(lists, found)
        free(lists)
        if live.isEmpty():
            free(live, *([classes] if pivots > FIRST_PIVOTS else []))
            return found
        if pivots == FIRST_PIVOTS:
            nodes = cut(live.select("doc_id").distinct())
            sets = full_sets(join_small(docs, nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
            classes = cut(sets.select("doc_id", F.size("full").cast("long").alias("n"), F.col("full").alias("sketch")))
            lists = inverted_lists(classes, _LEAST)
            free(live, nodes)
            live = _placed(lists, found)
            free(lists)
        chosen = _pivots(live, pivots)
        open_ = (F.col("ca") != F.col("component")) & (100 * F.least("na", "n") >= SIMILARITY * F.greatest("na", "n")) & _meets_here()
        pairs = cut(spread_join(live, chosen, "value").where(open_).select("a", F.col("doc_id").alias("b"), "na", F.col("n").alias("nb")).distinct())
        new = _confirmed(pairs, classes, docs if pivots < FIRST_PIVOTS else None)
        before = [new]
        if not new.isEmpty():
            before += [t for t in (links, found) if t is not None]
            links = cut(new if links is None else links.unionByName(new))
            found = components(links)
        # A pivot has met its whole list and leaves it.
        lists = cut(live.join(chosen.select("value", F.col("a").alias("doc_id")), ["value", "doc_id"], "left_anti").drop("component", "size"))
        free(live, chosen, pairs, *before)
        if pivots >= FIRST_PIVOTS:
            pivots *= MORE_PIVOTS
        else:
            pivots = FIRST_PIVOTS


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of ``docs(doc_id, text)``.

    Words are lower-cased in A-Z only. Two documents are linked where the Jaccard coefficient of their sets
    is at least 0.75; a component is named by its smallest ``doc_id``, which is kept. Words and shingles are
    compared by 64-bit hashes: among a billion different shingles some collision is likely, but two documents
    are joined or parted by one only if it decides at the very bound. Null, empty and wordless texts have an
    empty set and are linked with nothing; a text of under five words is one shingle. A repeated row gives a row
    each time, of one document (a ``doc_id`` has one text); a null ``doc_id`` is left out. Empty tables give no
    rows; other columns are not read. Any text length: a document's own set is the most a task holds.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    signed = cut(sketches(docs))
    own = cut(signed.select("doc_id", "n", "key"))
    first = cut(own.where(F.col("n") > 0).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    classes = cut(signed.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "sketch"))
    free(signed)
    found = _links(classes, docs)
    free(classes)
    groups = first if found is None else first.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = F.coalesce("component", "rep") if found is not None else F.col("rep")
    groups = cut(groups.select("key", named.alias("component")).where("copies > 1" if found is None else "copies > 1 or component is not null"))
    out = spread_join(own, groups, "key", how="left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component")), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
