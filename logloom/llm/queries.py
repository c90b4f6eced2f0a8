"""The thin queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe_count, decontaminate, html_text, langid, line_dedup, mixing, near_dup, quality, secrets, toxicity
from logloom.llm.base import table
from logloom.operators.lineage import new_table_path

VOCABULARY = "byte_bpe_50k.json"
#: The setting that names a ledger of scanned blobs to go on with.
LEDGER = "spark.logloom.secrets.ledger"


def fold(parts: int, which: int) -> Column:
    """Whether the CRC-32 of ``doc_id`` as text has remainder ``which``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == which, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the ledger that the session names, or else a new one, so that all is scanned."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    ledger = spark.conf.get(LEDGER, None) or new_table_path(spark, "secret-ledger")
    return secrets.digest(secrets.scan_into(docs, ledger))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(4, 2)
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_deleted", "text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_count.count(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.oracle(), "op2_secret_scans": secrets.oracle(), "op5_line_dedup": line_dedup.oracle(), "op6_decontamination": decontaminate.oracle(), "op9_near_duplicates": near_dup.oracle()}
