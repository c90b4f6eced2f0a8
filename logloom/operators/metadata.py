"""Structural metadata of lines: block tokens, the component that they belong to, and what is wrong with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators.graph import connected_components
from logloom.operators.lineage import cut_lineage


def line_metadata(lines: DataFrame, message: str = "message") -> DataFrame:
    """``lines`` with ``block_ids, duplicate_block_ids, malformed_block_tokens, issues, component, status, reason``.

    Block ids that stand in one line are connected; a component is named by its smallest id as text. A line with ids is
    ASSIGNED to theirs. Others are UNASSIGNED, with a reason: DECODE_ERROR (``valid_utf8`` is there and false),
    MALFORMED_BLOCK_TOKEN or NO_BLOCK_ID, as is a null message. ``terminator`` NONE, where there, is an issue. Only lines
    with ids pass the join with the components, so the others meet in no task.
    """
    c = F.col
    told = lines.withColumn("__t", text.block_tokens(F.coalesce(c(message), F.lit(""))))
    told = told.select(*lines.columns, c("__t.ids").alias("block_ids"), c("__t.duplicates").alias("duplicate_block_ids"), c("__t.malformed").alias("malformed_block_tokens"))
    undecoded = ~F.coalesce(c("valid_utf8"), F.lit(True)) if "valid_utf8" in lines.columns else F.lit(False)
    endless = F.coalesce(c("terminator") == "NONE", F.lit(False)) if "terminator" in lines.columns else F.lit(False)
    issues = {
        "DUPLICATE_BLOCK_ID": F.size("duplicate_block_ids") > 0,
        "MALFORMED_BLOCK_TOKEN": F.size("malformed_block_tokens") > 0,
        "MISSING_LINE_TERMINATOR": endless,
        "MULTIPLE_BLOCK_IDS": F.size("block_ids") > 1,
    }
    reason = F.when(undecoded, "DECODE_ERROR").when(issues["MALFORMED_BLOCK_TOKEN"], "MALFORMED_BLOCK_TOKEN").otherwise("NO_BLOCK_ID")
    told = cut_lineage(told.withColumn("issues", F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in issues.items()]))).withColumn("__reason", reason))
    some = F.size("block_ids") > 0
    near = F.transform("block_ids", lambda b: F.struct(c("block_ids")[0].alias("src"), b.alias("dst")))
    edges = told.where(some).select(F.explode(near).alias("e")).select("e.*").distinct()
    found = connected_components(edges).select(c("vertex").alias("__v"), "component")
    names = [*told.columns[:-1]]
    assigned = told.where(some).join(found, c("block_ids")[0] == c("__v")).select(*names, "component", F.lit("ASSIGNED").alias("status"), F.lit(None).cast("string").alias("reason"))
    rest = told.where(~some).select(*names, F.lit(None).cast("string").alias("component"), F.lit("UNASSIGNED").alias("status"), c("__reason").alias("reason"))
    return assigned.unionByName(rest)


def metadata_summary(metadata: DataFrame) -> DataFrame:
    """``measure, lines`` of :func:`line_metadata`: all lines, those of each status, ``reason:`` and ``issue:``, and the number of components."""
    named = F.concat(F.array_compact(F.array(F.concat(F.lit("reason:"), "reason"))), F.transform("issues", lambda i: F.concat(F.lit("issue:"), i)))
    told = metadata.select(F.concat(F.array(F.lit("lines"), "status"), named).alias("m"))
    counts = told.select(F.explode("m").alias("measure")).groupBy("measure").agg(F.count("*").alias("lines"))
    components = metadata.agg(F.lit("components").alias("measure"), F.count_distinct("component").alias("lines"))
    return reduce(DataFrame.unionByName, [counts, components.select("measure", "lines")])
