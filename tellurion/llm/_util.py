"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts the UTF-8 form at just these bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a per-source or per-cell summary is broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 20_000
#: A written table needs its shuffle no more; Spark then drops the shuffle's files at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def named(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def apart(docs: DataFrame, *made: str) -> tuple[Column, list[Column]]:
    """All columns of ``docs`` as one struct ``row``, so that none of their names meets another, and these columns out of it but those
    called like one of ``made``, in whatever case."""
    row = F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row")
    return row, [F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in made]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set, a temporary folder if all of Spark is on this machine, else an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a materialised summary: broadcast after its rows were counted, else a shuffle join."""
    return left.join(F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right, on, how)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over batches; at the end of its task, memory that was freed goes back to the system.

    Workers wait for the tasks of other stages, beside executors that need the memory then.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
