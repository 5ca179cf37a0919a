"""Exact deduplication of batches of documents against immutable snapshots.

A snapshot is a set of documents that no longer changes: its exact table has one row a text (by SHA-256 of what is left
without white space), in buckets by hash, and a static binary-fuse filter a bucket. An incoming batch is first grouped by
digest on its own. Its digests are screened by the filters; what no filter may hold is new without any join. The others
join the exact tables, and their texts are compared byte by byte. What is new becomes the next snapshot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm import _fuse
from tellurion.llm._joins import counted_join
from tellurion.llm._util import cut, free, table

#: Texts a bucket holds about; its filter has some nine bits for each.
BUCKET = 1 << 16
#: Digests of a batch that meet one bucket's filter in one task.
SHARE = 1 << 18
#: Texts to compare up to which their keys (48 bytes each) are broadcast to where the documents lie; beyond it, texts are shuffled.
SENT = 200_000
#: Batches that a table without an arrival order is taken in.
BATCHES = 3
SPACE = r"[\x20\x09-\x0D]+"


def bare(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(bare(text), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, chars, digest`` of every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), digest_of(F.col("text")).alias("digest"))


def grouped(keys: DataFrame) -> DataFrame:
    """``digest, size, chars, doc_id``: the rows of each digest, and its longest text's, smallest ``doc_id`` (null last)."""
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("back"))).alias("best")
    return keys.groupBy("digest").agg(F.count("*").alias("size"), best).select("digest", "size", "best.chars", F.bitwise_not("best.back").alias("doc_id"))


@dataclass(frozen=True)
class Snapshot:
    """``docs`` as they were, ``exact(digest, size, chars, doc_id)`` with one row a text, and ``filters(bucket, seed, segment, cells)``, a bucket for each value of a code's top ``bits``."""

    docs: DataFrame
    exact: DataFrame
    filters: DataFrame
    bits: int

    def free(self) -> None:
        free(self.exact, self.filters)


def _bucket(bits: int) -> Column:
    return F.shiftrightunsigned("code", 64 - bits) if bits else F.lit(0).cast("long")


def snapshot(docs: DataFrame, exact: DataFrame) -> Snapshot:
    """Freeze the texts ``exact`` of ``docs``, a table as ``screen`` gives it; the filters are written beside it."""
    bits = max(0, math.ceil(math.log2(max(1, exact.count()) / BUCKET)))

    def one(key: tuple, t: pa.Table) -> pa.Table:
        seed, segment, cells = _fuse.build(t["code"].to_numpy().view(np.uint64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "seed": [seed], "segment": [segment], "cells": pa.array([cells], pa.binary())})

    codes = exact.select(F.xxhash64("digest").alias("code")).withColumn("bucket", _bucket(bits))
    return Snapshot(docs, exact, cut(codes.groupBy("bucket").applyInArrow(one, "bucket long, seed long, segment long, cells binary")), bits)


def screened(groups: DataFrame, rows: int, old: Snapshot) -> DataFrame:
    """``digest`` of the ``rows`` rows of ``groups`` that the snapshot's filters may hold: all that it holds, and about one in 256 others.

    A bucket's digests and its filter meet in one task; where a batch is far larger than the snapshot, in several, each
    with a copy of the filter.
    """
    salts = max(1, -(-rows // (SHARE << old.bits)))
    codes = groups.select("digest", F.xxhash64("digest").alias("code")).withColumns({"bucket": _bucket(old.bits), "salt": F.pmod("code", F.lit(salts))})
    copies = old.filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def one(asked: pa.Table, filters: pa.Table) -> pa.Table:
        if not asked.num_rows or not filters.num_rows:
            return asked.select(["digest"]).slice(0, 0)
        f = filters.to_pylist()[0]
        return asked.select(["digest"]).filter(pa.array(_fuse.held(asked["code"].to_numpy().view(np.uint64), f["seed"], f["segment"], f["cells"])))

    return codes.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInArrow(one, "digest binary")


def _texts(docs: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """``digest, bare`` of the rows of ``docs`` that ``wanted(digest, chars, doc_id)`` names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("of"), "text", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("long"))
    named = F.broadcast(wanted) if small else wanted  # at most SENT rows
    met = rows.join(named, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("long") == F.col("chars")))
    return met.select("digest", bare(F.col("text")).alias("bare")).where(F.unhex(F.sha2("bare", 256)) == F.col("digest"))


def confirmed(found: DataFrame, batch: DataFrame, old: Snapshot) -> DataFrame:
    """``digest`` of ``found`` (positives of ``batch``) whose text is that of the snapshot, byte for byte.

    Positives join the exact table; one text of either side is fetched for each that is there, and both are compared.
    Two texts of one SHA-256 would be an error.
    """
    theirs = old.exact.select("digest", F.col("chars").alias("chars2"), F.col("doc_id").alias("doc_id2"))
    pairs = cut(found.join(theirs, "digest"))
    small = pairs.count() <= SENT
    mine = _texts(batch, pairs.select("digest", "chars", "doc_id"), small)
    both = mine.unionByName(_texts(old.docs, pairs.select("digest", F.col("chars2").alias("chars"), F.col("doc_id2").alias("doc_id")), small))
    same = both.groupBy("digest").agg((F.min("bare") == F.max("bare")).alias("same"))
    out = cut(same.select("digest", F.when(F.col("same"), True).otherwise(F.raise_error(F.lit("two texts have one digest"))).alias("same")))
    free(pairs)
    return out


def screen(batch: DataFrame, old: list[Snapshot]) -> tuple[DataFrame, DataFrame]:
    """``batch(doc_id, text)`` against all snapshots: the groups of texts that one of these holds, and those of new texts.

    Both are as by ``grouped`` and lie in the shared folder.
    """
    groups = cut(grouped(keyed(batch)))
    rows = groups.count()
    known = []
    for s in old:
        maybe = cut(screened(groups, rows, s))
        known.append(confirmed(groups.join(maybe, "digest", "left_semi"), batch, s))
        free(maybe)
    if not known:
        return groups.limit(0), groups
    held = reduce(DataFrame.unionByName, known).select("digest")
    parts = cut(groups.join(held, "digest", "left_semi")), cut(groups.join(held, "digest", "left_anti"))
    free(groups, *known)
    return parts


def exact_duplicates(docs: DataFrame, batches: list[DataFrame] | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs(doc_id, text)``.

    Texts are equal if they are without white space. Of equal texts the one with the most code points stays, then the
    smallest ``doc_id``. ``batches``, parts of ``docs`` in the order of their arrival, are taken one after the other against
    the snapshots of those before; by default ``docs`` is dealt into ``BATCHES`` by a hash of ``doc_id``. The result doesn't
    depend on it.

    Null text counts as empty, and all texts without a character are equal. A null ``doc_id`` is last among equals and
    is kept alone if it has no other (``keep_id`` is null then, ``kept`` true). Rows that repeat are rows of the
    group, and ``kept`` for each row of the ``doc_id`` that stays. Whole texts of any length are compared; an empty table gives no
    rows; other columns are not read.
    """
    if batches is None:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
        batches = [docs.where(part == k) for k in range(BATCHES)]
    old, known = [], []
    for k, batch in enumerate(batches):
        met, fresh = screen(batch, old)
        known += [met] if old else []
        if k < len(batches) - 1:
            old.append(snapshot(batch, fresh))
        else:
            last = fresh
    every = reduce(DataFrame.unionByName, [*(s.exact for s in old), *known, last])
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("back"))).alias("best")
    classes = cut(every.groupBy("digest").agg(F.sum("size").alias("n"), best).select("digest", "n", F.col("n").alias("group_size"), F.bitwise_not("best.back").alias("keep_id")))
    for s in old:
        s.free()
    free(last, *known)
    rows = cut(keyed(docs).drop("chars"))
    out = counted_join(rows, classes, "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op13_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  h AS (SELECT doc_id, length(text) AS chars, sha256(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS digest FROM t),
  k AS (SELECT doc_id, digest, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size FROM h
        WINDOW w AS (PARTITION BY digest ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, digest AS text_sha256 FROM k
"""
