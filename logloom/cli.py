"""Command line: ``python -m logloom.cli COMMAND ...``; every command writes what it makes to new files and prints one line of JSON."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import chronology, governance, metadata, metrics, templates
from logloom.operators import records as record_tables
from logloom.plans import catalog, target_view
from logloom.sources import logs

Command = Callable[[SparkSession, argparse.Namespace], dict]


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("logloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _records(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    paths = [r["path"] for r in logs.resolve_files(spark, args.root, args.files).orderBy("file_rank").collect()]
    read = logs.lines(spark, paths).select("source_file", "line", F.col("raw").cast("string").alias("text"))
    return logs.canonical(logs.ADAPTERS[args.adapter](read), args.dataset, args.architecture or args.adapter)


def manifest(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Sizes and digests of files."""
    paths = [r["path"] for r in logs.resolve_files(spark, args.root, args.files).collect()]
    logs.file_manifest(spark, paths).write.mode("errorifexists").json(args.out)
    return {"files": len(paths)}


def verify(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Whether files are still those of a manifest."""
    states = {r["state"]: r["count"] for r in logs.verify_manifest(spark, spark.read.json(args.manifest)).groupBy("state").count().collect()}
    return states | {"failed": any(k != "OK" for k in states)}


def records(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Canonical records of log files, as Parquet."""
    _records(spark, args).write.mode("errorifexists").parquet(args.out)
    told = spark.read.parquet(args.out).groupBy("parse_status").count().collect()
    return {r["parse_status"]: r["count"] for r in told}


def streams(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A stream with ranks, times and segments from canonical records."""
    read = spark.read.parquet(args.records).withColumn("unit", F.coalesce("session_id", "trace_id"))
    timed = chronology.effective_timestamp(read, "timestamp_us", "source_file", "source_line_number")
    ranked = chronology.chronological(timed, "effective_ts", "source_file", "source_line_number")
    units = chronology.spans(ranked, "unit", "effective_ts")
    cuts = chronology.choose_cuts(ranked, units)
    out = chronology.assign_segments(ranked, units, tuple(c["chosen"] for c in cuts))
    logs.write_stream(out, args.out)
    return {"cuts": cuts}


def split(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The floor split of a stream: part, records, ranks."""
    s = spark.read.parquet(args.stream)
    starts = chronology.floor_boundaries(s.count())
    part = F.lit(len(starts) - 2)
    for i in range(len(starts) - 3, -1, -1):
        part = F.when(F.col("rank") < starts[i + 1], i).otherwise(part)
    governance.component_rule(s.withColumn("part", part), "unit", "part").write.mode("errorifexists").parquet(args.out)
    return {"boundaries": list(starts)}


def fit_templates(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Templates of the messages of one segment, as Parquet."""
    s = spark.read.parquet(args.stream)
    templates.fit(s.where(F.col("segment") == args.segment), "normalized_message", "rank").write.mode("errorifexists").parquet(args.out)
    return {"templates": spark.read.parquet(args.out).count()}


def events(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Records with event ids and their parameters, from frozen templates."""
    found = templates.transform(spark.read.parquet(args.stream), "normalized_message", spark.read.parquet(args.templates))
    found.write.mode("errorifexists").parquet(args.out)
    return {r["seen"]: r["count"] for r in found.groupBy(F.when(F.col("event_id") == templates.UNSEEN, "unseen").otherwise("seen").alias("seen")).count().collect()}


def view(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The target view of a stream."""
    s = spark.read.parquet(args.stream).withColumnRenamed("normalized_message", "message").withColumn("group", F.coalesce("unit", F.lit("GLOBAL")))
    s = s.select("rank", "effective_ts", "segment", "group", "unit", "message", F.coalesce("template_id", "message").alias("template"))
    return json.loads(target_view.write(target_view.build(s, "group", "unit", "message", "template", sample=args.sample), args.out))


def audit(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The isolation checks of all folds of a stream; fails where one does."""
    s = spark.read.parquet(args.stream).withColumn("raw_h", F.col("raw_message_sha256")).withColumn("norm_h", F.md5("normalized_message"))
    found = governance.audit(governance.fold_members(s))
    found.write.mode("errorifexists").json(args.out)
    states = {r["verdict"]: r["count"] for r in spark.read.json(args.out).groupBy("verdict").count().collect()}
    return states | {"failed": "FAIL" in states}


def purge(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Sizes and label shares of retained and purged units; the labels are opened through their gate."""
    told = spark.read.parquet(args.split)
    labels = governance.Labels(spark, args.labels, args.log).open("INVENTORY", args.reason)
    joined = told.join(labels.select(F.col("unit").alias("component"), "anomaly"), "component", "left")
    rows = joined.groupBy("disposition").agg(F.count("*").alias("units"), F.count_if("anomaly").alias("anomalies")).collect()
    return {r["disposition"]: [r["units"], r["anomalies"]] for r in rows}


def freeze_split(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A table with a ``partition`` column as a frozen split, with the digests of its partitions."""
    return {r["partition"]: [r["rows"], r["digest"]] for r in record_tables.write_split(spark.read.parquet(args.table), args.out).collect()}


def check_split(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Whether the rows of a frozen split are still those of its digests; fails where a partition's are not."""
    states = {r["partition"]: r["state"] for r in record_tables.validate_split(spark, args.split).collect()}
    return states | {"failed": any(s != "OK" for s in states.values())}


def line_metadata(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Block ids, components and issues of the lines of log files, as Parquet."""
    paths = [r["path"] for r in logs.resolve_files(spark, args.root, args.files).orderBy("file_rank").collect()]
    read = logs.lines(spark, paths).select("source_file", "line", "raw_sha256", "terminator", "valid_utf8", F.col("raw").cast("string").alias("message"))
    metadata.line_metadata(read).drop("message").write.mode("errorifexists").parquet(args.out)
    return {r["measure"]: r["lines"] for r in metadata.metadata_summary(spark.read.parquet(args.out)).collect()}


def seal(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The state of a sealed test set; with a grant it is unlocked."""
    found = governance.Seal(args.seal)
    if args.grant:
        found.unlock(args.grant)
    return {"state": found.state}


def evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Metrics of score columns of a table with a label, and gains of the first over the others."""
    df = spark.read.parquet(args.table)
    singles, tests = metrics.evaluate(df, tuple(args.scores), {"first": (args.scores[0], tuple(args.scores[1:]))} if len(args.scores) > 1 else {}, args.label, args.cluster, reps=args.reps)
    return {"methods": [r.asDict() for r in singles.collect()], "tests": [r.asDict() for r in tests.collect()] if tests is not None else []}


def query(spark: SparkSession, args: argparse.Namespace) -> dict:
    """One of the library's queries over the tables of a folder, as Parquet."""
    catalog.queries()[args.name](spark, args.tables).write.mode("errorifexists").parquet(args.out)
    return {"rows": spark.read.parquet(args.out).count()}


COMMANDS: dict[str, tuple[Command, dict[str, dict]]] = {
    "manifest": (manifest, {"--root": {}, "--files": {"nargs": "+"}, "--out": {}}),
    "verify": (verify, {"--manifest": {}}),
    "records": (records, {"--root": {}, "--files": {"nargs": "+"}, "--adapter": {"choices": sorted(logs.ADAPTERS)}, "--dataset": {}, "--architecture": {"required": False}, "--out": {}}),
    "streams": (streams, {"--records": {}, "--out": {}}),
    "split": (split, {"--stream": {}, "--out": {}}),
    "templates": (fit_templates, {"--stream": {}, "--segment": {"type": int, "required": False, "default": 0}, "--out": {}}),
    "events": (events, {"--stream": {}, "--templates": {}, "--out": {}}),
    "target-view": (view, {"--stream": {}, "--sample": {"type": int, "required": False, "default": 500}, "--out": {}}),
    "audit": (audit, {"--stream": {}, "--out": {}}),
    "purge-audit": (purge, {"--split": {}, "--labels": {}, "--log": {}, "--reason": {}}),
    "freeze-split": (freeze_split, {"--table": {}, "--out": {}}),
    "check-split": (check_split, {"--split": {}}),
    "metadata": (line_metadata, {"--root": {}, "--files": {"nargs": "+"}, "--out": {}}),
    "seal": (seal, {"--seal": {}, "--grant": {"required": False}}),
    "evaluate": (evaluate, {"--table": {}, "--scores": {"nargs": "+"}, "--label": {}, "--cluster": {}, "--reps": {"type": int, "required": False, "default": 2000}}),
    "query": (query, {"--name": {}, "--tables": {}, "--out": {}}),
}


def main(argv: list[str] | None = None) -> int:
    """0, or 1 where a check fails; errors of use end with 2."""
    parser = argparse.ArgumentParser(prog="logloom")
    parts = parser.add_subparsers(dest="command", required=True)
    for name, (run, flags) in COMMANDS.items():
        own = parts.add_parser(name, help=(run.__doc__ or "").strip())
        for flag, how in flags.items():
            own.add_argument(flag, **({"required": True} | how))
    args = parser.parse_args(argv)
    out = getattr(args, "out", None)
    if out and "://" not in out and Path(out).exists():
        parser.error(f"{out} is there already")
    told = COMMANDS[args.command][0](_session(), args)
    print(json.dumps(told, sort_keys=True, default=str))
    return int(bool(told.get("failed")))


if __name__ == "__main__":
    sys.exit(main())
