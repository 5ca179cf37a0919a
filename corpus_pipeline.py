"""The corpus pipeline: ``documents`` to packed training windows.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``, works on all that its
predecessor kept and returns a DataFrame, which is written as Parquet and reread as the next one's ``docs``.

``documents`` needs ``doc_id, text, lang, source``; other columns pass through up to packing, whatever their names. Null
and letterless texts, and those that no learned language explains, go in the first stage. A null ``doc_id`` passes the first two and the near duplicates as it is
and is mixed and packed like any other; rows that repeat are documents of their own but for near duplicates, where
those of one ``doc_id`` are one document. A null source is a source. Texts of any length pass whole. An empty table
gives no windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm import langid, linedup, mixing, neardup, packing
from tellurion.llm._util import named, shared_folder, table


def _apart(docs: DataFrame, *made: str) -> tuple[DataFrame, list]:
    """``docs`` with its columns of these names renamed, and all its columns under their own names again."""
    names = {c: f"__docs_{c}" for c in docs.columns if c.lower() in made}
    return docs.withColumnsRenamed(names), [named(names.get(c, c)).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null text, text without a letter, and text that its mixture of learned languages makes less likely than if all trigrams
    were as likely: other scripts, keys, random letters. Where nothing is learned, all goes."""
    given, back = _apart(docs, "lang_pred", "score", "langs", "fit", "held_out")
    return langid.language_of(given).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("fit") >= 0)).select(back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated blocks of lines; a document of which no word is left goes."""
    given, back = _apart(docs, "n_lines", "n_removed")
    out = linedup.drop_repeated_lines(given)
    out = out.where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0))
    counted = next((c for c in given.columns if c.lower() == "n_chars"), "n_chars")
    return out.withColumn(counted, F.char_length("text").cast("long")).select(back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select([named(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    given, back = _apart(docs, "size", "source_size", "target", "rate", "copies", "copy")
    return mixing.mix(given).where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(back)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed windows, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("packing", windows)]

#: Language inference, patience diff and packing have no SQL form; tests/llm holds every stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; tables between them lie in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
