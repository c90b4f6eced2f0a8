"""The corpus pipeline: five stages, each one operator, from documents to a mixing plan.

All stages but the last return the columns of their documents, which may have any names beside ``doc_id``, ``text`` and
``source``. No stage fails on nulls in any column, empty or very long texts, ties, repeated rows or empty tables; what each does
with them is said below and, in full, with its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from logloom.llm.base import fresh, table
from logloom.llm.queries import fold
from logloom.operators.lineage import cut_lineage

#: A document with at least this probability of toxicity goes.
REJECTED = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the held-out fold, does not reject.

    A null text is scored as an empty one, repeated rows alike. Without labels of both kinds nothing is rejected.
    """
    labels = table(spark, sf_dir, "labels").where(~fold(5, 0))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    (name,) = fresh(docs.columns, "toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < REJECTED).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that an earlier place has; ``n_chars`` follows the text.

    A null text stays null, a text of which nothing is left becomes empty, and rows equal in id and text stay alike.
    """
    names = docs.columns
    counts = tuple(fresh(names, "n_lines", "n_deleted"))
    out = line_dedup.dedup(docs, counts=counts)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(*counts)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, one row of it.

    Null and empty texts are one class, texts of white space only are classes of equal ones. A null id stands for its class only where there is no other.
    """
    return near_dup.kept(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none, and an empty benchmark drops nothing."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null and empty texts have none, a null source is one, repeated rows are documents of their own."""
    return mixing.mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the classifier; ``tests/llm/test_pipeline.py`` holds each stage against a brute-force version over its whole input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
