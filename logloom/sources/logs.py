"""Log sources: files to lines, and lines of four systems to one canonical record."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.functions.identity import rows_digest
from logloom.operators.ordering import carried

#: What stands for the message of a line that has none.
EMPTY_CONTENT = "EMPTY_CONTENT"


def resolve_files(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """``path, file_rank``: files of each glob by name, globs in the given order, each file once; none at all is an error."""
    parts = []
    for i, g in enumerate(globs):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{root.rstrip('/')}/{g}")
        parts.append(found.select("path", F.lit(i).alias("glob")))
    paths: list[str] = []
    for df in parts:
        paths += [r[0] for r in df.orderBy("path").collect() if r[0] not in paths]
    if not paths:
        raise FileNotFoundError(f"no file matches {globs} in {root}")
    return spark.createDataFrame(list(enumerate(paths)), "file_rank int, path string").select("path", "file_rank")


def lines(spark: SparkSession, paths: list[str], most: int | None = None) -> DataFrame:
    """``source_file, file_rank, line, raw, terminator, valid_utf8, raw_sha256`` of every line, exactly numbered from 1.

    Files of any size are read in splits: a line's number is its place in its split and the lines of the splits before.
    Only a file's last line may lack a terminator, which its size tells; an empty file has no lines. A byte-order mark, which
    the reader drops, is put back. Files are plain: a compressed one is no text here.
    """
    ranks = spark.createDataFrame(list(enumerate(paths)), "file_rank int, __path string")
    split = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_block_start", "start"), ("file_size", "size"))]
    read = spark.read.option("lineSep", "\n").text(paths).select(F.col("value").cast("binary").alias("value"), *split, F.monotonically_increasing_id().alias("id"))
    # rows of a split stand together in one task, in order
    splits = read.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    table = splits.select(
        F.col("path").alias("__p"), F.col("start").alias("__s"), "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all"), F.sum("bytes").over(whole).alias("bytes")
    )
    placed = read.join(table, (F.col("path") == F.col("__p")) & (F.col("start") == F.col("__s"))).withColumn("line", F.col("id") - F.col("first") + F.col("before") + 1)
    lost = F.col("size") - F.col("bytes")  # 0; -1 without a last terminator; 3 more with a byte-order mark
    value = F.when((F.col("line") == 1) & (lost >= 2), F.concat(F.lit(b"\xef\xbb\xbf"), F.col("value"))).otherwise(F.col("value"))
    ended = (F.col("line") < F.col("all")) | lost.isin(0, 3)
    rows = placed.join(F.broadcast(ranks), F.expr("endswith(path, regexp_replace(__path, '^[a-z]+:/*', '/'))")).select(F.col("path").alias("source_file"), "file_rank", "line", value.alias("value"), ended.alias("ended"))
    return_ = F.substring("value", -1, 1) == F.lit(b"\r")
    raw = F.when(return_, F.expr("substring(value, 1, octet_length(value) - 1)")).otherwise(F.col("value"))
    out = rows.select(
        "source_file",
        "file_rank",
        F.col("line").cast("long").alias("line"),
        raw.alias("raw"),
        F.when(F.col("ended"), F.when(return_, "CRLF").otherwise("LF")).otherwise(F.when(return_, "CR").otherwise("NONE")).alias("terminator"),
        F.is_valid_utf8(raw.cast("string")).alias("valid_utf8"),
        F.sha2(raw, 256).alias("raw_sha256"),
    )
    if most is not None:
        out = out.orderBy("file_rank", "line").limit(most)
    return out


def _record(df: DataFrame, ok: Column, status: Column, time: Column, otherwise: str = "MALFORMED", **fields: Column) -> DataFrame:
    names = ("level", "service", "component", "node_id", "session_id", "trace_id")
    always = {k: v for k, v in fields.items() if k.startswith("always_")}
    pick = lambda n: always.get(f"always_{n}", F.when(ok, fields.get(n, F.lit(None)))).cast("string").alias(n)
    bad = "CONTINUATION" if otherwise == "CONTINUATION" else "UNPARSEABLE"
    return df.select(
        "source_file",
        "line",
        F.when(ok, F.unix_micros(time)).alias("timestamp_us"),
        F.when(~ok, bad).otherwise(status).alias("timestamp_status"),
        *[pick(n) for n in names],
        F.when(ok, fields["message"]).otherwise(F.col("text")).alias("message"),
        F.when(ok, "OK").otherwise(otherwise).alias("parse_status"),
    )


def _utc(text_: Column, form: str) -> Column:
    """A time without a zone, read as UTC whatever the session's; null for one that cannot be."""
    return F.try_to_timestamp(F.concat(text_, F.lit(" +0000")), F.lit(f"{form} xx"))


def _parsed(time: Column) -> Column:
    return F.when(time.isNull(), "UNPARSEABLE").otherwise("PARSED")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


#: The line formats of the four systems are in the parsers' patterns below.


def parse_hdfs(df: DataFrame) -> DataFrame:
    """``(source_file, line, text)`` of the form ``yymmdd HHMMSS pid LEVEL component: content``; other lines are MALFORMED.

    A date that cannot be is UNPARSEABLE; two-digit years are of this century.
    """
    p = r"(?s)^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Za-z]+)\s+(\S+):\s(.*)$"
    g = lambda i: F.regexp_extract("text", p, i)
    time = _utc(F.concat_ws(" ", g(1), g(2)), "yyMMdd HHmmss")
    return _record(
        df, F.col("text").rlike(p), _parsed(time), time, level=g(4), component=g(5), service=_filled(F.split_part(g(5), F.lit("."), F.lit(1))),
        session_id=_filled(F.regexp_extract(g(6), r"blk_-?\d+", 0)), message=g(6),
    )


def parse_bgl(df: DataFrame) -> DataFrame:
    """Nine fields and a message between white space; the first field, a label, is dropped unread."""
    parts = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+", 10)
    ok = (F.size(parts) >= 9) & (parts[0] != "")
    time = _utc(F.get(parts, F.lit(4)), "yyyy-MM-dd-HH.mm.ss.SSSSSS")
    f = lambda i: F.get(parts, F.lit(i))
    return _record(df, ok, _parsed(time), time, level=f(8), service=f(6), component=f(7), node_id=f(3), message=F.coalesce(f(9), F.lit(EMPTY_CONTENT)))


def parse_hadoop(df: DataFrame) -> DataFrame:
    """``date time,ms LEVEL [thread] component: content``; any other line continues the one before."""
    p = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) ([A-Z]+) (?:\[([^\]]*)\] )?([^:]+): (.*)$"
    g = lambda i: F.regexp_extract("text", p, i)
    time = _utc(g(1), "yyyy-MM-dd HH:mm:ss,SSS")
    component = F.trim(g(4))
    service = F.regexp_extract(component, r"^org\.apache\.hadoop\.([^.]+)", 1)
    thread = F.when(F.col("text").rlike(r"^\S+ \S+ [A-Z]+ \["), g(3))
    return _record(
        df, F.col("text").rlike(p), _parsed(time), time, "CONTINUATION", level=g(2), component=component, service=_filled(service), node_id=thread, message=g(5),
        always_session_id=_filled(F.regexp_extract("source_file", r"(?:^|/)(application_[^/]*)", 1)),
        always_trace_id=_filled(F.regexp_replace(F.regexp_extract("source_file", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")),
    )


def parse_openstack(df: DataFrame) -> DataFrame:
    """``file.log date time.ms pid LEVEL component content``; other lines are MALFORMED."""
    p = r"(?s)^(\S+) (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) (\d+) ([A-Z]+) (\S+) (.*)$"
    g = lambda i: F.regexp_extract("text", p, i)
    time = _utc(g(2), "yyyy-MM-dd HH:mm:ss.SSS")
    return _record(
        df, F.col("text").rlike(p), _parsed(time), time, level=g(4), component=g(5), service=_filled(F.split_part(g(1), F.lit(".log"), F.lit(1))),
        session_id=_filled(F.regexp_extract(g(6), r"\[instance: ([0-9a-fA-F-]{36})\]", 1)), trace_id=_filled(F.regexp_extract(g(6), r"\breq-([0-9a-fA-F-]{36})\b", 1)), message=g(6),
    )


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"hdfs": parse_hdfs, "bgl": parse_bgl, "hadoop": parse_hadoop, "openstack": parse_openstack}


def canonical(parsed: DataFrame, dataset: str, architecture: str, version: str = "1") -> DataFrame:
    """Parsed lines as canonical records: NUL-free and normalised message, digests, statuses; one record per line."""
    clean = text.escape_nul(F.col("message"))
    return parsed.select(
        F.lit(version).alias("schema_version"),
        F.lit(dataset).alias("dataset_id"),
        F.lit(architecture).alias("architecture_id"),
        "source_file",
        F.col("line").alias("source_line_number"),
        "timestamp_us",
        F.timestamp_micros("timestamp_us").alias("timestamp_utc"),
        "timestamp_status",
        "level",
        "service",
        "component",
        "node_id",
        "session_id",
        "trace_id",
        clean.alias("canonical_message"),
        F.sha2("message", 256).alias("raw_message_sha256"),
        text.normalize(clean).alias("normalized_message"),
        text.nul_status(F.col("message")).alias("normalization_status"),
        F.lit(None).cast("string").alias("template_id"),
        F.lit(None).cast("string").alias("template_source"),
        "parse_status",
    )


def strict(parsed: DataFrame) -> DataFrame:
    """Fail on the first line that did not parse."""
    bad = F.raise_error(F.concat(F.lit("line does not parse: "), F.col("source_file"), F.lit(":"), F.col("line").cast("string")))
    return parsed.withColumn("parse_status", F.when(F.col("parse_status") == "OK", F.col("parse_status")).otherwise(bad.cast("string")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzipped or not; anything that is no object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``window_id, nll``: null for abstentions; no file gives no rows."""
    kind = "window_id string, status string, nll_mean double"
    try:
        found = spark.read.schema(kind).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], kind)
    return found.select("window_id", F.when(F.col("status") != "ABSTAIN", F.col("nll_mean")).alias("nll"))


def read_block_labels(spark: SparkSession, path: str) -> DataFrame:
    """``block_id, anomaly`` of a CSV ``BlockId,Label``; any label but Normal and Anomaly is an error."""
    raw = spark.read.option("header", True).option("enforceSchema", False).schema("BlockId string, Label string").csv(path)
    flag = F.when(F.col("Label") == "Anomaly", True).when(F.col("Label") == "Normal", False).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.col("Label"))).cast("boolean"))
    return raw.select(text.normalize_block_id(F.col("BlockId")).alias("block_id"), flag.alias("anomaly"))


def read_sectioned_labels(lines_: DataFrame) -> DataFrame:
    """``session_id, section`` of text with headers such as ``Normal:`` above items ``+ application_...``; input ``(line, text)``."""
    header = F.when(F.col("text").rlike(r"^\s*[^+].*:\s*$"), F.regexp_extract("text", r"^\s*(.*?):\s*$", 1))
    told = carried(lines_.withColumn("__header", header), "__header", F.col("line").asc(), name="section")
    return told.where(F.col("text").rlike(r"^\s*\+\s*application_")).select(F.regexp_extract("text", r"(application_\S+)", 1).alias("session_id"), "section")


def read_inline_labels(lines_: DataFrame) -> DataFrame:
    """``line, anomaly`` of lines that begin with a marker: ``-`` for normal, any other first word for an alert; a line without one has none."""
    marker = F.substring_index("text", " ", 1)
    return lines_.where(marker != "").select("line", (marker != "-").alias("anomaly"))


def read_listed_labels(lines_: DataFrame) -> DataFrame:
    """``session_id`` of each line that is one instance's id and nothing else: all of them are anomalous, the rest is not listed."""
    found = F.regexp_extract("text", r"^\s*([0-9a-fA-F-]{36})\s*$", 1)
    return lines_.where(found != "").select(found.alias("session_id")).distinct()


def label_inventory(labels: DataFrame, anomaly: str = "anomaly") -> DataFrame:
    """``positives, negatives, total``; a null label is neither."""
    return labels.agg(F.count_if(F.col(anomaly)).alias("positives"), F.count_if(~F.col(anomaly)).alias("negatives"), F.count(anomaly).alias("total"))


def write_stream(stream: DataFrame, path: str) -> None:
    """A stream as zstd Parquet by architecture and segment; an existing one is never overwritten."""
    by = [c for c in ("architecture_id", "segment") if c in stream.columns]
    stream.write.mode("errorifexists").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str, key: str, by: str | None = None, only_digest: bool = False) -> tuple[int, str]:
    """Gzipped JSON lines, split by ``by``, in order of ``key`` within each file, and (rows, digest): of the rows, which part files do not change."""
    told = rows_digest(df).first()
    if not only_digest:
        writer = df.sortWithinPartitions(*filter(None, (by, key))).write.mode("errorifexists").option("compression", "gzip")
        (writer.partitionBy(by) if by else writer).json(path)
    return told["rows"], told["digest"]


def write_scores(scores: DataFrame, path: str, name: str) -> None:
    """The scores of one expert as JSON lines under its name, never overwritten: ``window_id, status, nll_mean`` and more."""
    missing = {"window_id", "status", "nll_mean"} - set(scores.columns)
    if missing or not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"scores of {name!r} lack {sorted(missing)}")
    scores.write.mode("errorifexists").option("compression", "gzip").json(f"{path.rstrip('/')}/{name}")


def canonical_payload(value: object) -> tuple[bytes, str]:
    """A small object as gzipped JSON with sorted keys and its digest: the same bytes on every run."""
    raw = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()
    return gzip.compress(raw, mtime=0), hashlib.sha256(raw).hexdigest()


def write_corpus(records: DataFrame, path: str, key: str, by: str) -> dict[str, tuple[int, str]]:
    """Canonical records as gzipped JSON lines for each value of ``by``, and (rows, digest) of each; a value's rows are split over files."""
    found = {r[by]: (r["rows"], r["digest"]) for r in rows_digest(records, by).collect()}
    records.sortWithinPartitions(by, key).write.mode("errorifexists").option("compression", "gzip").partitionBy(by).json(path)
    return found


def verify_manifest(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``path, state`` of each file of a manifest: OK, CHANGED or MISSING; compared by size and digest."""
    paths = [r[0] for r in manifest.select("path").collect()]
    there = [p for p in paths if _exists(spark, p)]
    now = file_manifest(spark, there).select("path", F.col("sha256").alias("__now")) if there else spark.createDataFrame([], "path string, __now string")
    joined = manifest.join(now, "path", "left")
    return joined.select("path", F.when(F.col("__now").isNull(), "MISSING").when(F.col("__now") == F.col("sha256"), "OK").otherwise("CHANGED").alias("state"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def file_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, size_bytes, sha256, utf8`` of each file."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))


def write_registry(df: DataFrame, path: str) -> None:
    """A small table as CSV and JSON side by side."""
    df.write.mode("errorifexists").option("header", True).csv(f"{path}/csv")
    df.write.mode("errorifexists").json(f"{path}/json")
