"""Chronology, windows, sampling and set operators on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import chronology, governance, sampling, windows
from logloom.operators.graph import connected_components
from logloom.operators.ordering import carried, global_rank, previous, quantiles, running_max, running_sums


def test_global_rank_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 40), i) for i in range(500)] + [(None, 1000)]
    got = {r.i: r.rank for r in global_rank(spark.createDataFrame(rows, "k long, i long"), F.col("k"), F.col("i").asc()).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert got == want


def test_running_sums_by_group(spark):
    rows = [(g, k, k % 7) for g in ("a", "b") for k in range(200)]
    got = {(r.g, r.k): r.s for r in running_sums(spark.createDataFrame(rows, "g string, k long, v long"), -F.col("k"), sums={"s": F.col("v")}, by=("g",)).collect()}
    assert all(got[g, k] == sum(x % 7 for x in range(k, 200)) for g in ("a", "b") for k in range(200))


def test_boundaries():
    assert chronology.floor_boundaries(20) == (0, 12, 14, 16, 18, 20)
    assert chronology.floor_boundaries(3) == (0, 1, 2, 2, 2, 3)
    assert chronology.boundaries(100) == (50, 55, 70)


def test_effective_timestamp_and_inversions(spark):
    df = spark.createDataFrame([("f", 1, None), ("f", 2, 5), ("f", 3, None), ("f", 4, 3), ("g", 1, None)], "file string, line int, ts long")
    got = {(r.file, r.line): r.effective_ts for r in chronology.effective_timestamp(df, "ts", "file", "line").collect()}
    assert got == {("f", 1): 0, ("f", 2): 5, ("f", 3): 5, ("f", 4): 3, ("g", 1): 0}
    e = chronology.effective_timestamp(df, "ts", "file", "line")
    assert {r.file: r.inversions for r in chronology.inversions(e, "effective_ts", "file", "line").collect()} == {"f": 1, "g": 0}


def test_quiet_instants_and_cuts(spark):
    units = spark.createDataFrame([("a", 0, 10, 3), ("b", 5, 20, 2), ("c", 30, 40, 4), ("d", 41, 41, 1)], "unit string, first long, last long, records long")
    assert sorted(r.instant for r in chronology.quiet_instants(units).collect()) == [21, 41, 42]
    assert {r.cut: (r.units, r.records) for r in chronology.alive_at(units, {"x": 10, "y": 21, "z": 0}).collect()} == {"x": (2, 5), "y": (0, 0), "z": (0, 0)}


def test_cut_selection_prefers_the_cheaper(spark):
    rows = [(i, i * 10, "u" if 40 <= i <= 60 else f"v{i}") for i in range(100)]
    s = spark.createDataFrame(rows, "rank long, effective_ts long, unit string")
    cuts = chronology.choose_cuts(s, chronology.spans(s, "unit", "effective_ts"))
    assert cuts[0]["strategy"] == "SNAPPED_TO_QUIET_INSTANT" and cuts[0]["displaced"] == 10
    assert [c["chosen"] for c in cuts] == sorted({c["chosen"] for c in cuts})


def test_segments_exclude_straddling_units(spark):
    s = spark.createDataFrame([(0, 0, "a"), (1, 5, "a"), (2, 6, "b"), (3, 12, "b"), (4, 30, None)], "rank long, effective_ts long, unit string")
    got = chronology.assign_segments(s, chronology.spans(s, "unit", "effective_ts"), (10, 20, 30)).orderBy("rank").collect()
    assert [r.segment for r in got] == [0, 0, 255, 255, 3]


def test_context_windows(spark):
    rows = [(100 + i, i, "GLOBAL", f"h{i}") for i in range(12)]
    w = windows.context_windows(spark.createDataFrame(rows, "rank long, effective_ts long, g string, m string"), "g", "m", F.lit("A"), F.lit("P")).orderBy("target_rank").collect()
    assert len(w) == 11 and w[-1].context_ranks == list(range(103, 111)) and all(max(r.context_ranks) < r.target_rank for r in w)
    groups = ["G1", "G2", "G1", "GLOBAL", "G2", "G1"]
    w = windows.context_windows(spark.createDataFrame([(100 + i, i, g, "h") for i, g in enumerate(groups)], "rank long, effective_ts long, g string, m string"), "g", "m", F.lit("A"), F.lit("P"), 2)
    got = {r.target_rank: r.context_ranks for r in w.collect()}
    assert got == {102: [100], 104: [101], 105: [100, 102]}


def test_dedupe_keys_of_equal_inputs(spark):
    w = windows.context_windows(spark.createDataFrame([(i, i, "g", "h") for i in range(7)], "rank long, effective_ts long, g string, m string"), "g", "m", F.lit("A"), F.lit("P"), 2)
    keys = [r.dedupe_key for r in w.orderBy("target_rank").collect()]
    assert keys[0] != keys[1] and len(set(keys[1:])) == 1


def test_units_strata_chunks_embargo(spark):
    df = spark.createDataFrame([(i, i * 1_000_000, f"u{i:02d}") for i in range(40)], "rank long, effective_ts long, unit string")
    u = windows.build_units(df, "unit", 4, 10, 5_000_000).collect()
    assert sorted([r.stratum for r in u].count(k) for k in range(4)) == [10] * 4
    assert sum(r.embargo for r in u) == 5 and max(r.chunk for r in u) == 3


def test_count_windows_drop_residuals(spark):
    df = spark.range(1037).withColumnRenamed("id", "line")
    starts = list(chronology.floor_boundaries(1037))
    assert starts == [0, 622, 725, 829, 933, 1037]
    w = windows.count_windows(df, "line", starts).collect()
    assert [sum(r.complete for r in w if r.part == p) for p in range(5)] == [6, 1, 1, 1, 1]
    assert [sum(r.lines for r in w if r.part == p and not r.complete) for p in range(5)] == [22, 3, 4, 4, 4]


@pytest.mark.parametrize(("total", "expected"), [(11, 11), (0, 100), (500, 100)])
def test_quotas(spark, total, expected):
    q = sampling.quotas(spark.createDataFrame([(0, 50), (1, 30), (2, 20)], "stratum int, size long"), total).orderBy("stratum").collect()
    assert sum(r.quota for r in q) == expected and [r.quota for r in q] == sorted((r.quota for r in q), reverse=True)


def test_hash_sample_is_stable(spark):
    df = spark.createDataFrame([(f"u{i}", i % 3) for i in range(90)], "unit_id string, stratum int")
    a = {r.unit_id for r in sampling.hash_sample(df, 30, "t").where("selected").collect()}
    assert a == {r.unit_id for r in sampling.hash_sample(df.repartition(7), 30, "t").where("selected").collect()} and len(a) == 30


def test_top_membership_shares_the_border(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])], "i int, s double")
    got = {r.i: r.weight for r in sampling.top_membership(df, "s", 3).collect()}
    assert got[0] == 1 and got[4] == 0 and got[1] == got[2] == got[3] == pytest.approx(2 / 3)


def test_components(spark):
    edges = [(1, 3), (1, 2), (2, 3), (4, 4), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (None, 1)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4} | {i: 10 for i in range(10, 16)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_a_long_shuffled_path(spark):
    order = list(range(300))
    random.Random(5).shuffle(order)
    edges = list(zip(order, order[1:], strict=False))
    assert {r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()} == {0}


def test_component_rule(spark):
    lines = [(i, "blk_99" if i in (11, 12) else f"blk_{i}") for i in range(20)]
    starts = chronology.floor_boundaries(20)
    df = spark.createDataFrame([(c, next(p for p in range(5) if starts[p] <= i < starts[p + 1])) for i, c in lines], "c string, part int")
    got = governance.component_rule(df, "c", "part").collect()
    purged = [r for r in got if r.disposition == "PURGED_BOUNDARY"]
    assert len(purged) == 1 and purged[0].lines == 2 and sum(r.lines for r in got if r.disposition == "ASSIGNED") == 18


def test_one_to_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    assert governance.one_to_one(a, a.withColumnRenamed("a", "b"), "k").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        governance.one_to_one(a, a.unionByName(a).withColumnRenamed("a", "b"), "k").collect()


def test_cover_and_equality(spark):
    df = spark.range(5).withColumnRenamed("id", "i")
    assert governance.exact_cover(df, "i").first()["exact"] and not governance.exact_cover(df.where("i <> 2"), "i").first()["exact"]
    assert governance.same_rows(df, df.repartition(3)) and not governance.same_rows(df, df.unionAll(df))
    gaps = governance.contiguous(spark.createDataFrame([(0, 3), (3, 5), (6, 7)], "s int, e int"), "s", "e").first()
    assert (gaps["gaps"], gaps["overlaps"]) == (1, 0)


def test_no_single_partition_window_over_rows(spark, sf_dir):
    """The ranked stream never passes through one task: only the small table of ranges does."""
    from logloom.plans.registry import stream

    plan = stream(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows_ = [x for x in plan.split("\n") if "Window [" in x]
    assert all("__part" in x for x in windows_)


def test_running_values_against_lists(spark):
    """Ranges cut groups, keys repeat or are null, and one key has most rows."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([1, 1, 1, None, rng.randint(0, 9)]), rng.choice([None, None, rng.randint(0, 99)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g string, k long, v long")
    key = lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[0])
    ranks, last, before = {}, {}, {}
    for g in ("a", "b", None):
        own, seen = sorted((r for r in rows if r[1] == g), key=key), None
        for n, r in enumerate(own):
            seen = r[3] if r[3] is not None else seen
            ranks[r[0]], last[r[0]], before[r[0]] = n, seen, own[n - 1][3] if n else None
    order = (F.col("k").asc_nulls_first(), F.col("i").asc())
    assert {r.i: r.rank for r in global_rank(df, F.col("k"), F.col("i").asc(), by=("g",)).collect()} == ranks
    assert {r.i: r.x for r in carried(df, "v", *order, name="x", by=("g",)).collect()} == last
    assert {r.i: r.x for r in previous(df, "v", *order, name="x", by=("g",)).collect()} == before
    most, want = None, {}
    for r in sorted(rows):
        want[r[0]], most = most, r[3] if most is None else max(most, r[3] if r[3] is not None else most)
    assert {r.i: r.x for r in running_max(df, "v", F.col("i").asc(), name="x").collect()} == want
    got = {r.g: (r.low, r.mid) for r in quantiles(df, "v", {"low": 0.1, "mid": 0.5}, ("g",)).where("g is not null").collect()}
    import numpy as np

    for g in "ab":
        values = [r[3] for r in rows if r[1] == g and r[3] is not None]
        assert got[g] == pytest.approx((np.quantile(values, 0.1), np.quantile(values, 0.5)))


def test_large_groups_are_cut_with_their_context(spark):
    rng = random.Random(7)
    rows = [(i, i, rng.choice(["GLOBAL"] * 9 + ["x", None]), f"m{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "rank long, effective_ts long, g string, m string")
    one, many = (sorted(map(str, windows.context_windows(df, "g", "m", F.lit("A"), F.lit("P"), 3, large).collect())) for large in (1000, 20))
    assert one == many and len(one) > 280


def test_hash_sample_equals_a_sort(spark):
    import hashlib

    rows = [(f"u{i}", i % 7 and 1) for i in range(5000)]
    got = {r.unit_id for r in sampling.hash_sample(spark.createDataFrame(rows, "unit_id string, stratum int"), 777, "t").where("selected").collect()}
    quota = {r.stratum: r.quota for r in sampling.quotas(spark.createDataFrame([(0, 715), (1, 4285)], "stratum int, size long"), 777).collect()}
    want = set()
    for k, n in quota.items():
        want |= set(sorted((u for u, s in rows if s == k), key=lambda u: (hashlib.sha256(f"t|{u}".encode()).hexdigest(), u))[:n])
    assert got == want


def test_batches_equal_the_loop(spark):
    rng = random.Random(1)
    for budget in (1, 50, 100, 1000):
        lengths = [rng.choice([0, 1, 3, 10, 10, 10, 40, 200]) for _ in range(120)]
        got = {r.i: r.batch for r in sampling.batches(spark.createDataFrame(list(enumerate(lengths)), "i long, l long"), "l", "i", budget).collect()}
        want, batch, held = {}, 0, 0
        for n, i in sorted((n, i) for i, n in enumerate(lengths)):
            if held and max(n, 1) * (held + 1) > budget:
                batch, held = batch + 1, 0
            want[i], held = batch, held + 1
        assert got == want, budget


def test_seeded_draws(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "i long, g string")
    for replace in (False, True):
        a, b = (sorted(map(tuple, sampling.seeded(x, "g", "i", 15, 3, replace).collect())) for x in (df, df.repartition(5)))
        assert a == b and len(a) == 30 and (len({r[0] for r in a}) == 30) != replace


def test_raw_positions(spark):
    raw = [(0, 5, "x"), (1, 3, "y"), (2, 5, "z"), (3, 9, "w")]
    rawdf = spark.createDataFrame(raw, "file_position long, effective_ts long, raw_hash string")
    s = spark.createDataFrame([(0, 3, "y"), (1, 5, "x"), (2, 5, "z"), (3, 9, "w")], "rank long, effective_ts long, raw_hash string")
    assert {r.rank: r.file_position for r in windows.locate(s, rawdf).collect()} == {0: 1, 1: 0, 2: 2, 3: 3}
    for bad in (s.where("rank < 3"), s.withColumn("raw_hash", F.lit("q"))):
        with pytest.raises(Exception, match="differ from the stream"):
            windows.locate(bad, rawdf).collect()
    texts = rawdf.withColumn("text", F.upper("raw_hash"))
    wanted = spark.createDataFrame([(2, "z"), (0, "x")], "file_position long, norm_hash string")
    assert {r.file_position: r.text for r in windows.at_positions(texts, wanted, "text", "raw_hash").collect()} == {2: "Z", 0: "X"}
    with pytest.raises(Exception, match="no such text"):
        windows.at_positions(texts, wanted.withColumn("norm_hash", F.lit("?")), "text", "raw_hash").collect()


def test_position_in_unit(spark):
    df = spark.createDataFrame([(3, "u"), (1, "u"), (2, None), (5, "v")], "o long, u string")
    assert {r.o: r.position for r in windows.position_in_unit(df, "u", "o").collect()} == {1: 0, 3: 1, 2: None, 5: 0}


def test_label_gate_and_seal(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "l"))
    labels = governance.Labels(spark, str(tmp_path / "l"), str(tmp_path / "log"))
    assert labels.open("EVALUATION", "metrics").count() == 3
    for scope, reason in (("TRAINING", "x"), ("EVALUATION", " ")):
        with pytest.raises(PermissionError):
            labels.open(scope, reason)
    assert len((tmp_path / "log").read_text().splitlines()) == 3
    seal = governance.Seal(str(tmp_path / "seal"))
    with pytest.raises(PermissionError):
        seal.open(lambda: 1)
    seal.unlock("grant 1")
    assert seal.open(lambda: 7) == 7 and seal.state == "OPENED"
    with pytest.raises(PermissionError):
        seal.unlock("again")
    (tmp_path / "seal").write_text((tmp_path / "seal").read_text().replace("grant 1", "grant 2"))
    with pytest.raises(ValueError, match="chain"):
        _ = seal.state


def test_record_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert governance.append_new(spark, str(tmp_path / "r"), rows, "id") == 2
    with pytest.raises(ValueError, match="there already"):
        governance.append_new(spark, str(tmp_path / "r"), rows.limit(1), "id")
    child = spark.createDataFrame([(["a", "z"],)], "refs array<string>")
    assert [r.key for r in governance.foreign_keys(child, "refs", rows, "id", many=True).collect()] == ["z"]


def test_paths_and_forbidden_columns(spark):
    assert governance.safe_relative("a/b.log") and not any(map(governance.safe_relative, ["/a", "../a", "a/../b", "C:/x", "a\nb", ""]))
    df = spark.sql("select 1 as x, 2 as anomaly_flag, named_struct('label', 1) as s")
    assert governance.forbidden_columns(df) == ["anomaly_flag", "s.label"]


def test_audits(spark):
    rows = [("S1", 0, 1, 0, "u1", "x", "X"), ("S1", 1, 5, 2, "u2", "y", "Y"), ("S2", 0, 1, 0, "u3", "z", "X"), ("S2", 1, 2, 2, "u4", "w", "W"), ("T", 0, 3, 0, "u5", "x", "X"), ("T", 1, 9, 2, "u6", "x", "X"), ("T", 2, 8, 3, "u6", "q", "Q")]
    s = spark.createDataFrame(rows, "architecture_id string, rank long, effective_ts long, segment int, unit string, raw_h string, norm_h string")
    told = {(r.fold_id, r.check_id): (r.verdict, r.observation) for r in governance.audit(governance.fold_members(s)).collect()}
    assert told["LOAO-T", "L06"] == ("FAIL", 1) and told["LOAO-T", "L02"] == ("INFORMATIONAL", 1) and told["LOAO-T", "L07"] == ("PASS", 0)
    assert all(told["LOAO-T", k][0] == "PASS" for k in ("L01", "L04", "L05", "L07", "L08", "L14", "L16"))
    bad = governance.fold_members(s).unionByName(governance.fold_members(s).where("partition = 'TARGET_BURN_IN'").withColumn("partition", F.lit("TARGET_EVALUATION")))
    told = {(r.fold_id, r.check_id): r.observation for r in governance.audit(bad).collect()}
    assert told["LOAO-T", "L04"] == told["LOAO-T", "L08"] == told["LOAO-T", "L05"] == told["LOAO-T", "L07"] == 1
    files = {x["check_id"]: x["verdict"] for x in governance.audit_files({"a": "import os", "b": "from pkg.labels import open"}, ("1", "1"), {"f": "1", "g": "1"}, {"m": '{"p": "/home/me/x"}'}, [{"id": "E1"}], "pkg.labels")}
    assert files == {"L09": "FAIL", "L10": "PASS", "L11": "INFORMATIONAL", "L12": "INFORMATIONAL", "L13": "FAIL", "L15": "FAIL", "L17": "FAIL"}


def test_build_comparison(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2), (3, "z", 3)], "k int, a string, b int")
    b = spark.createDataFrame([(1, "x", 9), (2, None, 2), (4, "z", 3)], "k int, a string, b int")
    assert {r.field: tuple(r)[1:] for r in governance.compare_builds(a, b, ["k"], ["a", "b"]).collect()} == {"a": (2, 0, 1, 1), "b": (1, 1, 1, 1)}


def test_folds_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(a, s, i) for i, (a, s) in enumerate((a, s) for a in ("x", "y", "z", None) for s in range(4))]
    df = spark.createDataFrame(rows, "architecture_id string, segment int, rank long")
    told = lambda: sorted((r.fold_id, r.partition, r.rank) for r in governance.fold_members(df).collect())
    small = told()
    monkeypatch.setattr(governance, "MAX_BROADCAST_ARCHITECTURES", 2)
    assert told() == small and len(small) == 3 * (2 * 2 + 3)
    assert governance.fold_members(df.limit(0)).count() == 0
