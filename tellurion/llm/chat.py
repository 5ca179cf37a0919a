"""Perspective rotation of multi-party dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._util import table

#: Roles that set the scene and never become the assistant.
CONTEXT_ROLES = ("system",)
#: Turn numbers that are gathered first, before a dialogue is put together.
STRETCH = 256


def perspectives(turns: DataFrame) -> DataFrame:
    """Render ``turns(conv_id, turn, role, text)`` once for every participant, that speaker as assistant.

    For each conversation and participant: ``messages`` (an array of ``turn, role, name, content, train``),
    ``rendered`` (the dialogue as text), ``mask`` (a digit per message, 1 where loss is taken),
    ``trained_spans`` (start and length in characters of each trained content in ``rendered``) and
    ``trained_chars``. The participant's own turns become ``assistant`` and are trained on; the others become
    ``user`` with their role as name; context roles stay as they are and only set the scene.

    A dialogue of any length is rendered whole; its turns are gathered by stretches of turn numbers first, so
    that only the dialogue itself, which is one row of the result, meets in one task. Null role: a participant
    named ``unknown``. Null text: empty. A null turn number: before the others. A null conv_id is a
    conversation of its own. Equal turn numbers are ordered by role and text; repeated rows are kept. A
    conversation of context turns only has no participant and no rows; an empty table gives none. Other
    columns are not read.
    """
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # Fields that are null come first in the order of structs, as turns without a number do.
    stretches = rows.groupBy("conv_id", F.floor(F.col("turn") / STRETCH).alias("at")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"), F.collect_set("role").alias("roles"))
    whole = stretches.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "said"))).alias("parts"), F.array_distinct(F.flatten(F.collect_list("roles"))).alias("roles"))
    speakers = F.explode(F.filter("roles", lambda r: ~r.isin(*CONTEXT_ROLES)))
    seen = whole.select("conv_id", F.flatten(F.transform("parts", lambda p: p["said"])).alias("said"), speakers.alias("speaker"))

    def message(x):
        own = x.role == F.col("speaker")
        context = x.role.isin(*CONTEXT_ROLES)
        return F.struct(
            x.turn.alias("turn"),
            F.when(own, "assistant").when(context, x.role).otherwise("user").alias("role"),
            F.when(own | context, F.lit(None)).otherwise(x.role).alias("name"),
            x.text.alias("content"),
            own.alias("train"),
        )

    def line(m):
        return F.concat(F.lit("<|"), m.role, F.coalesce(F.concat(F.lit(" name="), m["name"]), F.lit("")), F.lit("|>\n"), m.content, F.lit("\n"))

    def span(at, m):
        start = at["end"] + F.char_length(line(m)) - F.char_length(m.content) - 1
        return F.struct((at["end"] + F.char_length(line(m))).alias("end"), F.when(m.train, F.array_append(at["spans"], F.struct(start.alias("start"), F.char_length(m.content).alias("length")))).otherwise(at["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    shown = seen.withColumn("messages", F.transform("said", message))
    return shown.select(
        "conv_id",
        "speaker",
        "messages",
        F.array_join(F.transform("messages", line), "").alias("rendered"),
        F.array_join(F.transform("messages", lambda m: F.when(m.train, "1").otherwise("0")), "").alias("mask"),
        F.aggregate("messages", none, span, lambda x: x["spans"]).alias("trained_spans"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.when(m.train, F.char_length(m.content)).otherwise(0)).alias("trained_chars"),
    )


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = perspectives(table(spark, sf_dir, "conversations"))
    return shown.select("conv_id", "speaker", F.size("messages").cast("long").alias("n_messages"), "mask", "trained_chars", "rendered")


OP4_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
     s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system')
SELECT s.conv_id, s.speaker, CAST(count(*) AS BIGINT) AS n_messages,
       string_agg(CASE WHEN r.role = s.speaker THEN '1' ELSE '0' END, '' ORDER BY r.turn NULLS FIRST, r.role, r.text) AS mask,
       CAST(sum(CASE WHEN r.role = s.speaker THEN length(r.text) ELSE 0 END) AS BIGINT) AS trained_chars,
       string_agg('<|' || CASE WHEN r.role = s.speaker THEN 'assistant' WHEN r.role = 'system' THEN 'system' ELSE 'user name=' || r.role END
                  || '|>' || chr(10) || r.text || chr(10), '' ORDER BY r.turn NULLS FIRST, r.role, r.text) AS rendered
FROM s JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY s.conv_id, s.speaker
"""
