"""References, record rules, splits, window labels, digests and JSON keys on small frames."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import identity, text
from logloom.operators import governance, metadata, records
from logloom.operators.governance import Seal, violations


def test_references_by_type_by_array_and_anywhere(spark):
    run = spark.createDataFrame([("r1", "a1", None), ("r2", "a9", "r1"), ("r3", "", "r3")], "run_id string, architecture_id string, supersedes_id string")
    found = {
        "run_bridge": run,
        "architecture": spark.createDataFrame([("a1", None), ("a1", "a1")], "id string, parent_architecture_id string"),
        "incident": spark.createDataFrame([("i1", ["r1", "r7"]), ("i2", []), ("i3", None)], "id string, linked_run_ids array<string>"),
        "lineage_edge": spark.createDataFrame([("e1", "r1", "nowhere")], "id string, subject_id string, object_id string"),
    }
    ids = {"run_bridge": "run_id", "architecture": "id", "incident": "id", "lineage_edge": "id"}
    got = {tuple(r) for r in records.reference_faults(found, ids).collect()}
    assert got == {
        ("run_bridge", "architecture_id", "a9", "ORPHAN"), ("incident", "linked_run_ids", "r7", "ORPHAN"), ("lineage_edge", "object_id", "nowhere", "ORPHAN"),
        ("run_bridge", "supersedes_id", "r3", "SELF"), ("architecture", "id", "a1", "REPEATED"),
    }


EVENT = "dataset_key string, group_kind string, partition string, label string, label_access string, label_granularity string"


@pytest.mark.parametrize(
    ("row", "broken"),
    [
        (("hdfs", "HDFS_BLOCK", "BASE_TRAIN", "NORMAL", "NORMAL_POOL_FILTERING", "BLOCK_SESSION"), set()),
        (("bgl", "NONE", "TEST", None, None, None), set()),
        (("bgl", "HDFS_BLOCK", "VAL_EXPERT", "ANOMALY", "VALIDATION_EVALUATION", "EVENT"), {"bgl_without_group"}),
        (("hdfs", "HDFS_BLOCK", "TEST", "NORMAL", None, "BLOCK_SESSION"), {"test_without_label"}),
        (("hdfs", "HDFS_BLOCK", "FUSION_TRAIN", "ANOMALY", "NORMAL_POOL_FILTERING", "BLOCK_SESSION"), {"training_is_normal"}),
        (("hdfs", "HDFS_BLOCK", "VAL_FUSION", None, None, None), {"labels_elsewhere", "validation_access"}),
        (("other", "NONE", None, None, None, None), set()),
    ],
)
def test_event_rules(spark, row, broken):
    assert set(violations(spark.createDataFrame([row], EVENT), records.event_rules()).first()["violations"]) == broken


def test_sequence_rules(spark):
    schema = "record_ids array<string>, event_ids array<string>, source_line_numbers array<int>, chronological_indices array<int>, strategy string, dataset_key string, target_window_size int, is_residual_window boolean, partition string, label string, label_access string"
    good = (["r"], ["e"], [1], [0], "HDFS_BLOCK_SESSION", "hdfs", None, False, "TEST", None, None)
    short = (["r"], ["e"], [1], [], "BGL_FIXED_PARENT_WINDOW", "bgl", 100, False, "TEST", None, None)
    df = spark.createDataFrame([good, short], schema).withColumn("content_sha256", identity.ordered_hash(F.col("event_ids")))
    assert [sorted(r["violations"]) for r in violations(df, records.sequence_rules()).collect()] == [[], ["aligned", "parent_window"]]
    wrong = df.withColumn("content_sha256", F.lit("0"))
    assert all("content" in r["violations"] for r in violations(wrong, records.sequence_rules()).collect())


def test_split_is_validated_compared_and_sealed(spark, tmp_path):
    rows = spark.createDataFrame([(i, "TEST" if i % 5 == 0 else "BASE_TRAIN") for i in range(50)] + [(7, "BASE_TRAIN")], "id long, partition string")
    one = records.write_split(rows, str(tmp_path / "one"))
    two = records.write_split(rows.repartition(3), str(tmp_path / "two"))
    assert records.compare_splits(one, two).count() == 0
    state = lambda: {r["partition"]: r["state"] for r in records.validate_split(spark, str(tmp_path / "one")).collect()}
    assert state() == {"TEST": "OK", "BASE_TRAIN": "OK"}
    third = records.write_split(rows.distinct(), str(tmp_path / "three"))
    assert [r[0] for r in records.compare_splits(one, third).collect()] == ["BASE_TRAIN"]
    with pytest.raises(Exception, match="exist"):
        records.write_split(rows, str(tmp_path / "one"))
    rows.limit(1).withColumn("partition", F.lit("TEST")).write.mode("append").partitionBy("partition").parquet(str(tmp_path / "one" / "rows"))
    rows.limit(1).withColumn("partition", F.lit("NEW")).write.mode("append").partitionBy("partition").parquet(str(tmp_path / "one" / "rows"))
    assert state() == {"TEST": "CHANGED", "BASE_TRAIN": "OK", "NEW": "UNKNOWN"}
    assert records.read_partition(spark, str(tmp_path / "two"), "BASE_TRAIN").count() == 41
    with pytest.raises(PermissionError):
        records.read_partition(spark, str(tmp_path / "two"), "TEST")
    seal = Seal(str(tmp_path / "seal"))
    with pytest.raises(PermissionError):
        records.read_partition(spark, str(tmp_path / "two"), "TEST", seal=seal)
    seal.unlock("grant")
    assert records.read_partition(spark, str(tmp_path / "two"), "TEST", seal=seal).count() == 10
    assert seal.state == "OPENED"


def test_split_by_numbers_that_are_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "01"), (2, "01"), (3, "2")], "id long, partition string")
    records.write_split(rows, str(tmp_path / "s"))
    assert {r["partition"]: (r["rows"], r["state"]) for r in records.validate_split(spark, str(tmp_path / "s")).collect()} == {"01": (2, "OK"), "2": (1, "OK")}
    assert records.read_partition(spark, str(tmp_path / "s"), "01").count() == 2


def test_strict_labels_stop(spark):
    windows = spark.createDataFrame([("w1", 1, "u"), ("w2", 2, "u"), ("w3", 3, None)], "window_id string, target_rank long, sequence_id string")
    labels = spark.createDataFrame([(1, True), (2, True), (3, False)], "rank long, anomaly boolean")
    got = {r.window_id: (r.unit_id, r.anomaly, r.fault) for r in records.window_labels(windows, labels, "sequence_id").collect()}
    assert got == {"w1": ("u", True, None), "w2": ("u", True, None), "w3": (None, False, None)}
    with pytest.raises(Exception, match="MISSING label of window w3"):
        records.window_labels(windows, labels.where("rank < 3"), "sequence_id").collect()
    mixed = labels.withColumn("anomaly", F.col("rank") == 1)
    with pytest.raises(Exception, match="CONFLICT label"):
        records.window_labels(windows, mixed, "sequence_id").collect()


def test_digest_of_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    one = lambda d: tuple(identity.rows_digest(d).first())
    assert one(df) == one(df.repartition(3)) == one(df.select("v", "k"))
    assert len({one(df), one(df.distinct()), one(df.where("k = 1")), one(df.fillna("")), one(df.limit(0))}) == 5
    assert one(df.limit(0))[0] == 0


def test_json_keys(spark):
    cases = [
        ('{"A": {"b": [1, {"C" : "x: \\"d\\": 1"}]}, "a": null}', ["a", "b", "c"]),
        ('{"e\\"f": ":", "\\u00e9": "{\\\\"}', ['e"f', "é"]),
        ("[]", []), ('"g"', []), ("{", None), (None, None),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string").orderBy("i").select(text.json_keys(F.col("j"))).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]


def test_scored_refuses_lost_texts(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "b"), (4, "aa")], "k long, t string")
    got = {r.k: (r.score_raw, r.status) for r in records.scored(df, "k", "t", lambda: lambda ts: [None if t == "aa" else 1.5 for t in ts], rows=1).collect()}
    assert got == {1: (1.5, "OK"), 2: (None, "UNSCORABLE"), 3: (1.5, "OK"), 4: (None, "UNSCORABLE")}
    with pytest.raises(Exception, match="0 scores for 2 texts"):
        records.scored(df.coalesce(1), "k", "t", lambda: lambda ts: []).collect()


def test_line_metadata(spark):
    rows = [(1, "blk_1 blk_2", True, "LF"), (2, "blk_02 blk_7 blk_7", True, "LF"), (3, "blk_9", True, "NONE"), (4, "blk_x", True, "LF"), (5, "none", False, "LF"), (6, None, True, "LF")]
    meta = metadata.line_metadata(spark.createDataFrame(rows, "line int, message string, valid_utf8 boolean, terminator string"))
    got = {r.line: (r.component, r.status, r.reason, r.issues) for r in meta.collect()}
    assert got == {
        1: ("blk_1", "ASSIGNED", None, ["MULTIPLE_BLOCK_IDS"]), 2: ("blk_1", "ASSIGNED", None, ["DUPLICATE_BLOCK_ID", "MULTIPLE_BLOCK_IDS"]),
        3: ("blk_9", "ASSIGNED", None, ["MISSING_LINE_TERMINATOR"]), 4: (None, "UNASSIGNED", "MALFORMED_BLOCK_TOKEN", ["MALFORMED_BLOCK_TOKEN"]),
        5: (None, "UNASSIGNED", "DECODE_ERROR", []), 6: (None, "UNASSIGNED", "NO_BLOCK_ID", []),
    }
    told = {r.measure: r.lines for r in metadata.metadata_summary(meta).collect()}
    assert told["lines"] == 6 and told["ASSIGNED"] == 3 and told["components"] == 2 and told["issue:MULTIPLE_BLOCK_IDS"] == 2
    assert metadata.line_metadata(spark.createDataFrame([], "message string")).count() == 0


def test_gate_receipt_fails_closed():
    good = governance.gate_receipt({"a": True}, {"t": "x"}, {"t": "x", "u": "y"})
    assert good["open"] and good["unexpected"] == ["u"]
    shut = [({"a": None}, {}, {}), ({"a": False}, {}, {}), ({}, {}, {}), ({"a": True}, {"t": "x"}, {}), ({"a": True}, {"t": "x"}, {"t": "x "})]
    receipts = [governance.gate_receipt(*x) for x in shut]
    assert not any(r["open"] for r in receipts) and receipts[-1]["mismatched"] == ["t"] and receipts[0]["criteria"] == {"a": "UNKNOWN"}
    assert len({r["digest"] for r in [good, *receipts]}) == 6


def test_reconciliation_of_small_and_empty_splits(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "p string, i int")
    got = {r.partition: (r.raw, r.windows, r.retained, r.residual) for r in governance.window_reconciliation(df, "p", 3).collect()}
    assert got == {"a": (7, 2, 6, 1), "b": (1, 0, 0, 1)}
    assert governance.window_reconciliation(df.where("p = 'b'"), "p", 3).first().retained_ratio is None
    assert tuple(governance.component_reconciliation(df.limit(0), "p", "i").first()) == (0, 0, 0, 0, True)
