"""The given tables read as points and as lines with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def points(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """``site, x, y, z`` of lineitem rows, or of those for which ``where`` holds."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(where)
    x, y = (F.col("l_partkey") % 1000) / 10.0, (F.col("l_orderkey") % 1000) / 10.0
    return t.select(F.col("l_returnflag").alias("site"), x.alias("x"), y.alias("y"), (0.08 * x + 0.06 * y + 5 * F.col("l_tax")).alias("z"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, seq, x, y, prov, m, i`` of events: hours, value, provenance and support a channel."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prov = F.when(F.col("event_type").isin("purchase", "signup"), "M").when(F.col("event_type") == "view", "I").when(F.col("event_type") == "click", "X").otherwise("U")
    v = t.select(
        F.col("user_id").alias("line_id"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("x"),
        F.col("value").alias("y"),
        prov.alias("prov"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    return v.select("line_id", "seq", "x", "y", "prov", F.when(F.col("prov").isin("M", "X"), F.col("k")).alias("m"), F.when(F.col("prov").isin("I", "X"), F.col("k")).alias("i"))
