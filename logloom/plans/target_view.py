"""The target view of a fold: buffer, memory, calibration sample, evaluation units and windows, drift."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.identity import membership_digest
from logloom.operators import sampling, windows

#: Shares of strata, counted from the end, that the recent part of the calibration sample is drawn from.
RECENT = 0.2


def build(segmented: DataFrame, group: str, unit: str, message: str, template: str, strata: int = 10, chunk_lines: int = 64, embargo_us: int = 0, sample: int = 500, tag: str = "TV") -> dict[str, DataFrame]:
    """Seven frames by name, from a stream with ``rank, effective_ts, segment`` and the named columns.

    The buffer is the first segment, the evaluation the last; label-shaped columns must be gone before.
    """
    early, late = segmented.where("segment = 0"), segmented.where("segment = 3")
    units = windows.build_units(late, unit, strata, chunk_lines, embargo_us)
    units = sampling.hash_sample(units, sample, f"{tag}|EVAL").withColumnRenamed("selected", "in_sample")
    base = windows.build_units(early, unit, strata, chunk_lines, 0).drop("embargo", "chunk")
    uniform = sampling.hash_sample(base, sample, f"{tag}|CAL-UNIFORM").withColumnRenamed("selected", "cal_uniform")
    recent = sampling.hash_sample(base.where(F.col("stratum") >= round(strata * (1 - RECENT))), sample, f"{tag}|CAL-RECENT")
    recent = recent.where("selected").select(F.col("unit_id").alias("__r"))
    calibration = uniform.join(recent, F.col("unit_id") == F.col("__r"), "left").withColumn("cal_recent", F.col("__r").isNotNull()).drop("__r").where("cal_uniform or cal_recent")
    frames = lambda s, part: windows.context_windows(s, group, message, F.lit("TARGET"), F.lit(part)).drop("context_messages", "target_message")
    chosen = early.join(calibration.select(F.col("unit_id").alias(unit)), unit, "left_semi").select(F.col("rank").alias("target_rank"))
    told = early.select(F.explode(F.array(F.struct(F.lit("template").alias("field"), F.col(template).alias("value")), F.struct(F.lit("message").alias("field"), F.col(message).alias("value")))).alias("x"))
    return {
        "buffer/records": early.drop("segment"),
        "buffer/memory": told.groupBy("x.field", "x.value").agg(F.count("*").alias("count")),
        "buffer/calibration_units": calibration,
        "buffer/calibration_windows": frames(early, "TARGET_BURN_IN").join(chosen, "target_rank", "left_semi"),
        "evaluation/events": late.drop("segment"),
        "evaluation/units": units,
        "evaluation/windows": frames(late, "TARGET_EVALUATION"),
    }


def invariants(segmented: DataFrame) -> DataFrame:
    """``before_in_rank, before_in_time``: whether the buffer ends before the evaluation begins."""
    at = lambda f, c, s: f(F.when(F.col("segment") == s, F.col(c)))
    return segmented.agg((at(F.max, "rank", 0) < at(F.min, "rank", 3)).alias("before_in_rank"), (at(F.max, "effective_ts", 0) <= at(F.min, "effective_ts", 3)).alias("before_in_time"))


def write(frames: dict[str, DataFrame], path: str) -> str:
    """Write all frames as zstd Parquet, refuse to overwrite any, and return a manifest as JSON."""
    manifest = {}
    for name, df in frames.items():
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}.parquet")
        manifest[name] = {"rows": df.sparkSession.read.parquet(f"{path}/{name}.parquet").count()}
    buffer = frames["buffer/records"]
    manifest["buffer/records"]["membership_sha256"] = membership_digest(buffer).first()["digest"]
    return json.dumps(manifest, sort_keys=True)
