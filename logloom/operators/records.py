"""Records that refer to each other: references, rules by type, split tables, faults of a window view, labels of windows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.functions import identity
from logloom.operators.governance import Seal

#: Record type, its field, and the type that the field refers to ("*" is any).
REFERENCES = (
    ("architecture", "parent_architecture_id", "architecture"),
    ("variant", "architecture_id", "architecture"),
    ("variant", "parent_variant_id", "variant"),
    ("dataset", "event_schema_id", "event_schema"),
    ("dataset", "transform_id", "transform"),
    ("transform", "input_dataset_id", "dataset"),
    ("split", "dataset_id", "dataset"),
    ("run_bridge", "architecture_id", "architecture"),
    ("run_bridge", "variant_id", "variant"),
    ("run_bridge", "dataset_id", "dataset"),
    ("run_bridge", "event_schema_id", "event_schema"),
    ("run_bridge", "transform_id", "transform"),
    ("run_bridge", "split_id", "split"),
    ("run_bridge", "artifact_manifest_id", "artifact_manifest"),
    ("incident", "linked_run_ids", "run_bridge"),
    ("protocol_deviation", "affected_run_ids", "run_bridge"),
    ("seal", "split_id", "split"),
    ("access", "seal_id", "seal"),
    ("lineage_edge", "subject_id", "*"),
    ("lineage_edge", "object_id", "*"),
)
#: The partition that ordinary readers cannot open.
TEST = "TEST"
TRAINING, VALIDATION = ("BASE_TRAIN", "FUSION_TRAIN"), ("VAL_EXPERT", "VAL_FUSION")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def reference_faults(records: dict[str, DataFrame], ids: dict[str, str], references=REFERENCES) -> DataFrame:
    """``record_type, field, value, fault`` of records of several types, however many, in one join.

    ORPHAN: no record of the type that the field refers to has this id. SELF: a record supersedes itself. REPEATED: two
    records of a type have one id. ``ids`` names each type's id column. A field may be an array; nulls and empty strings
    refer to nothing. A type without the field has no such reference, and every type may have ``supersedes_id``.
    """
    key = lambda t: F.col(ids[t]).cast("string")
    known = _union([r.select(F.lit(t).alias("type"), key(t).alias("value")) for t, r in records.items()]).where("value is not null")
    counted = known.groupBy("type", "value").agg(F.count("*").alias("n"))
    named = [*references, *((t, "supersedes_id", t) for t in records)]
    parts = []
    for kind, field, target in named:
        if kind not in records or field not in records[kind].columns:
            continue
        many = records[kind].schema[field].dataType.typeName() == "array"
        value = F.explode(F.col(field).cast("array<string>")) if many else F.col(field).cast("string")
        parts.append(records[kind].select(F.lit(kind).alias("record_type"), F.lit(field).alias("field"), F.lit(target).alias("type"), value.alias("value")))
    told = [counted.where("n > 1").select(F.col("type").alias("record_type"), F.lit("id").alias("field"), "value", F.lit("REPEATED").alias("fault"))]
    if parts:
        used = _union(parts).where("value <> ''").distinct()
        anywhere = counted.select("value").distinct().withColumn("type", F.lit("*"))
        targets = counted.select("type", "value").unionByName(anywhere)
        told.append(used.join(targets, ["type", "value"], "left_anti").select("record_type", "field", "value", F.lit("ORPHAN").alias("fault")))
    for kind, r in records.items():
        if "supersedes_id" in r.columns:
            own = r.where(F.col("supersedes_id").cast("string") == key(kind))
            told.append(own.select(F.lit(kind).alias("record_type"), F.lit("supersedes_id").alias("field"), key(kind).alias("value"), F.lit("SELF").alias("fault")))
    return _union(told)


def _if(condition: Column, then: Column) -> Column:
    """An implication that is never null: an unknown condition does not bind, an unknown outcome breaks it."""
    return ~F.coalesce(condition, F.lit(False)) | F.coalesce(then, F.lit(False))


def _supervision(partition: Column) -> dict[str, Column]:
    """Which partitions show labels, and for what; ``label`` and ``label_access`` are null where there is no label."""
    label, access = F.col("label"), F.col("label_access")
    return {
        "test_without_label": _if(partition == TEST, label.isNull()),
        "labels_elsewhere": _if((partition != TEST) & F.col("dataset_key").isin("hdfs", "bgl"), label.isNotNull()),
        "training_is_normal": _if(partition.isin(*TRAINING), (label == "NORMAL") & (access == "NORMAL_POOL_FILTERING")),
        "validation_access": _if(partition.isin(*VALIDATION), label.isNotNull() & (access == "VALIDATION_EVALUATION")),
    }


def event_rules() -> dict[str, Column]:
    """Rules of an event record (``dataset_key, group_kind, partition, label, label_access, label_granularity``), for ``violations``."""
    c = F.col
    kind, grain = c("group_kind"), c("label_granularity")
    return {
        "hdfs_by_block": _if(c("dataset_key") == "hdfs", (kind == "HDFS_BLOCK") & (c("label").isNull() | (grain == "BLOCK_SESSION"))),
        "bgl_without_group": _if(c("dataset_key") == "bgl", (kind == "NONE") & (c("label").isNull() | (grain == "EVENT"))),
        **_supervision(c("partition")),
    }


def sequence_rules() -> dict[str, Column]:
    """Rules of a sequence record, for ``violations``.

    ``record_ids, event_ids, source_line_numbers, chronological_indices`` are arrays; also ``content_sha256, strategy,
    dataset_key, target_window_size, is_residual_window, partition, label, label_access``.
    """
    c = F.col
    n = F.size("event_ids")
    return {
        "aligned": (n == F.size("record_ids")) & (n == F.size("source_line_numbers")) & (n == F.size("chronological_indices")),
        "content": c("content_sha256") == identity.ordered_hash(c("event_ids")),
        "block_session": _if(c("strategy") == "HDFS_BLOCK_SESSION", (c("dataset_key") == "hdfs") & c("target_window_size").isNull() & ~c("is_residual_window")),
        "parent_window": _if(c("strategy") == "BGL_FIXED_PARENT_WINDOW", (c("dataset_key") == "bgl") & (c("target_window_size") == 100) & (n == 100) & ~c("is_residual_window")),
        **_supervision(c("partition")),
    }


def mutation_rules() -> dict[str, Column]:
    """Rules of a mutation record, for ``violations``: lengths and positions by operation.

    ``source_partition, operation, expected_length, observed_length, expected_sha256, observed_sha256`` and the arrays
    ``token_positions, gap_positions, transition_positions``. Positions are of the observed sequence; a gap may stand at its end.
    """
    c = F.col
    grown = c("observed_length") - c("expected_length")
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    tokens, gaps, steps = (some(f"{x}_positions") for x in ("token", "gap", "transition"))
    inside = lambda x, end: F.forall(x, lambda p: (p >= 0) & (p < end))
    moved = c("operation").isin("REPLACEMENT", "REORDER")
    return {
        "not_of_test": c("source_partition") != TEST,
        "changed": c("expected_sha256") != c("observed_sha256"),
        "all_positions": c("token_positions").isNotNull() & c("gap_positions").isNotNull() & c("transition_positions").isNotNull(),
        "missing": _if(c("operation") == "MISSING", (grown == -1) & gaps & ~tokens),
        "extra": _if(c("operation").isin("EXTRA", "REPEATED"), (grown == 1) & tokens & ~gaps),
        "moved": _if(moved, (grown == 0) & tokens & steps & ~gaps),
        "inside": inside("token_positions", c("observed_length")) & inside("gap_positions", c("observed_length") + 1) & inside("transition_positions", c("observed_length") - 1),
    }


def destruction_rules() -> dict[str, Column]:
    """Rules of a record of destroyed order, for ``violations``: only the order may change, and a no-op says why.

    ``partition, label, label_access, original_length, destroyed_length, original_sha256, destroyed_sha256,
    original_multiset, destroyed_multiset, status, no_op_reason``.
    """
    c = F.col
    same = c("original_sha256") == c("destroyed_sha256")
    return {
        "partition": c("partition").isin("VAL_EXPERT", TEST),
        "test_without_label": _if(c("partition") == TEST, c("label").isNull() & c("label_access").isNull()),
        "validation_access": _if(c("partition") == "VAL_EXPERT", c("label").isNotNull() & (c("label_access") == "VALIDATION_EVALUATION")),
        "length": c("original_length") == c("destroyed_length"),
        "multiset": c("original_multiset") == c("destroyed_multiset"),
        "applied": _if(c("status") == "APPLIED", ~same & c("no_op_reason").isNull()),
        "no_op": _if(c("status") != "APPLIED", same & c("no_op_reason").isNotNull()),
    }


def view_faults(windows: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """``rule, faults``: what speaks against a view of windows, as counts; all 0 in a sound view.

    ``windows`` have ``window_id, sequence_id, target_rank, context_ranks, context_record_count, target_effective_ts,
    context_last_effective_ts``, ``events`` ``rank, sequence_id``. ``horizon`` counts contexts of no or over ``most``
    records, ``order`` those not wholly before their target, ``unknown`` and ``elsewhere`` references to an event that is not there or is of another sequence.
    """
    c = F.col
    n = F.size("context_ranks")
    here = {
        "nulls": F.count_if(reduce(Column.__or__, [c(x).isNull() for x in windows.columns])),
        "count": F.count_if(n != c("context_record_count")),
        "horizon": F.count_if((n < 1) | (n > most)),
        "order": F.count_if((F.array_max("context_ranks") >= c("target_rank")) | (c("context_last_effective_ts") > c("target_effective_ts"))),
    }
    each = lambda names: F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(c(k), F.lit(0)).cast("long").alias("faults")) for k in names]))
    rows = windows.agg(*[v.alias(k) for k, v in here.items()]).select(each(here).alias("x")).select("x.*")
    twice = windows.groupBy("window_id").count().agg(F.sum(c("count") - 1).alias("identity")).select(each(["identity"]).alias("x")).select("x.*")
    used = windows.select(c("sequence_id").alias("__q"), F.explode(F.concat(F.array("target_rank"), "context_ranks")).alias("rank"))
    found = used.join(events.select("rank", "sequence_id"), "rank", "left")
    lost = found.agg(F.count_if(c("sequence_id").isNull()).alias("unknown"), F.count_if(c("sequence_id") != c("__q")).alias("elsewhere"))
    return _union([rows, twice, lost.select(each(["unknown", "elsewhere"]).alias("x")).select("x.*")])


def window_labels(windows: DataFrame, labels: DataFrame, unit: str, strict: bool = True) -> DataFrame:
    """``window_id, target_rank, unit_id, anomaly, fault``: each window with the label of its target's line.

    ``labels`` has ``rank, anomaly``, once a rank. ``unit`` names the column whose windows are judged together. A window
    without a label is MISSING, one whose unit has both labels is CONFLICT; ``strict`` stops at either. One shuffle by rank and one by unit.
    """
    found = windows.select("window_id", "target_rank", F.col(unit).alias("unit_id")).join(labels.select(F.col("rank").alias("target_rank"), "anomaly"), "target_rank", "left")
    units = found.groupBy(F.col("unit_id").alias("__unit")).agg((F.min("anomaly") != F.max("anomaly")).alias("__mixed"))
    fault = F.when(F.col("anomaly").isNull(), "MISSING").when(F.col("__mixed"), "CONFLICT")
    out = found.join(units, F.col("unit_id").eqNullSafe(F.col("__unit")), "left").select("window_id", "target_rank", "unit_id", "anomaly", fault.alias("fault"))
    if strict:
        stop = F.raise_error(F.concat(F.col("fault"), F.lit(" label of window "), F.col("window_id").cast("string")))
        out = out.withColumn("anomaly", F.when(F.col("fault").isNotNull(), stop).otherwise(F.col("anomaly")))
    return out


def write_split(rows: DataFrame, path: str, partition: str = "partition") -> DataFrame:
    """Write a split and its table of partitions (``partition, rows, digest``), which is returned; never over an old one."""
    rows.write.mode("errorifexists").partitionBy(partition).parquet(f"{path}/rows")
    spark = rows.sparkSession
    identity.rows_digest(spark.read.schema(rows.schema).parquet(f"{path}/rows"), partition).write.mode("errorifexists").parquet(f"{path}/partitions")
    return spark.read.parquet(f"{path}/partitions")


def _split_rows(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """Rows of a written split; folder names are read as the type that its table of partitions has, not as what they look like."""
    kind = spark.read.parquet(f"{path}/partitions").schema[partition]
    inner = [f for f in spark.read.parquet(f"{path}/rows").schema.fields if f.name != partition]
    return spark.read.schema(StructType([*inner, kind])).parquet(f"{path}/rows")


def validate_split(spark: SparkSession, path: str, partition: str = "partition") -> DataFrame:
    """``partition, rows, state`` of a written split by its rows as they are now: OK, CHANGED, MISSING or UNKNOWN (not in its table)."""
    now = identity.rows_digest(_split_rows(spark, path, partition), partition).select(F.col(partition).alias("__p"), F.col("rows").alias("__n"), F.col("digest").alias("__d"))
    old = spark.read.parquet(f"{path}/partitions")
    both = old.join(now, F.col(partition).eqNullSafe(F.col("__p")), "full")
    state = F.when(F.col("__n").isNull(), "MISSING").when(F.col("rows").isNull(), "UNKNOWN").when((F.col("digest") == F.col("__d")) & (F.col("rows") == F.col("__n")), "OK").otherwise("CHANGED")
    return both.select(F.coalesce(partition, "__p").alias(partition), F.coalesce("__n", "rows").alias("rows"), state.alias("state"))


def compare_splits(one: DataFrame, two: DataFrame, partition: str = "partition") -> DataFrame:
    """Partitions on which two tables of partitions differ, by rows or by digest; none where the builds agree."""
    a, b = (x.select(partition, "rows", "digest") for x in (one, two))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select(partition).distinct()


def read_partition(spark: SparkSession, path: str, wanted: str, partition: str = "partition", seal: Seal | None = None) -> DataFrame:
    """The rows of one partition; those of TEST only by an unlocked seal, which this opens."""
    read = lambda: _split_rows(spark, path, partition).where(F.col(partition) == wanted)
    if wanted != TEST:
        return read()
    if seal is None:
        raise PermissionError("the test partition opens by its seal only")
    return seal.open(read)


def sequence_probes(context: Column, target: Column, unexpected: Column, foreign: Column) -> Column:
    """``array<kind, context, target>``: changed copies of a sequence, for diagnosis only, never for training or selection.

    ``unexpected`` stands for the target, ``foreign`` for the first record of the context. The second record is left out, the last one repeated, the first one moved to the end.
    """
    n = F.size(context)
    cases = {
        "event_permutation": (F.reverse(context), target),
        "missing_event": (F.concat(F.slice(context, 1, 1), F.slice(context, 3, n)), target),
        "duplicate_event": (F.concat(context, F.slice(context, n, 1)), target),
        "unexpected_next_event": (context, unexpected),
        "long_range_dependency_violation": (F.concat(F.array(foreign), F.slice(context, 2, n)), target),
        "locally_plausible_globally_invalid": (F.concat(F.slice(context, 2, n), F.slice(context, 1, 1)), target),
    }
    structs = [F.struct(F.lit(k).alias("kind"), x.alias("context"), t.alias("target")) for k, (x, t) in cases.items()]
    return F.when(n > 0, F.array(*structs))


def scored(df: DataFrame, key: str, text: str, scorer: Callable[[], Callable[[list[str]], list[float | None]]], rows: int = 256) -> DataFrame:
    """``key, score_raw, status`` by a model of the caller's: ``scorer()`` loads it, once in each task.

    Each distinct text is scored once in a batch of at most ``rows`` texts of like length. A text that is null, or for
    which the model returns None, is UNSCORABLE with a null score; all others are OK.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        model = scorer()
        for frame in frames:
            texts = sorted({t for t in frame[text] if t is not None}, key=lambda t: (len(t), t))
            known: dict[str, float | None] = {}
            for i in range(0, len(texts), rows):
                part = texts[i : i + rows]
                told = model(part)
                if len(told) != len(part):
                    raise ValueError(f"the model gave {len(told)} scores for {len(part)} texts")
                known.update(zip(part, told))
            found = [known.get(t) if t is not None else None for t in frame[text]]
            yield pd.DataFrame({key: frame[key], "score_raw": pd.array(found, dtype="Float64"), "status": ["UNSCORABLE" if s is None else "OK" for s in found]})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, score_raw double, status string")
