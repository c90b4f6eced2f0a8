"""Queries by name, each bound to the driver's tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, ranked: bool = True) -> DataFrame:
    """Events as a log stream: ``event_id, rank, effective_ts, unit, message`` and the raw columns.

    The unit of grouping is a user's day; the message is the type and the key in the properties.
    """
    from logloom.operators.chronology import chronological

    e = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    out = e.select(
        "event_id", "user_id", "event_type", "value",
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("effective_ts"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format(ts, "yyyy-MM-dd")).alias("unit"),
        F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")).alias("message"),
    )
    return chronological(out, "effective_ts", "event_id") if ranked else out


#: The same stream in SQL, as the first common table expression.
STREAM = """
s AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS effective_ts,
        CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS unit,
        event_type || '|' || json_extract_string(props, '$.k') AS message,
        row_number() OVER (ORDER BY ts, event_id) - 1 AS rank FROM events)"""

#: Two expert scores of labelled documents: length, and the share of words that are long.
SCORED = """
u AS (SELECT d.doc_id, source, lang, toxic, quality, CAST(n_chars AS DOUBLE) AS a,
        round(len(list_filter(string_split(text, ' '), lambda w: length(w) > 7)) * 1.0 / len(string_split(text, ' ')), 4) AS b
      FROM documents d JOIN labels l USING (doc_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ", -1)
    b = F.round(F.size(F.filter(words, lambda w: F.length(w) > 7)) / F.size(words), 4)
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("a"), b.alias("b"))
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")


def one_row(spark: SparkSession, **values) -> DataFrame:
    """A row of literals."""
    return spark.range(1).select(*[v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()])
