"""Adapters and line scans on tiny files."""

import pytest
from pyspark.sql import functions as F

from logloom.operators.governance import canonical_rules, violations
from logloom.sources import logs


def parse(spark, kind, *texts, file="f.log"):
    df = spark.createDataFrame([(file, i + 1, t) for i, t in enumerate(texts)], "source_file string, line long, text string")
    return logs.ADAPTERS[kind](df).orderBy("line").collect()


def test_hdfs(spark):
    a, b, c = parse(spark, "hdfs", "081109 203518 143 INFO dfs.DataNode$X: Received block blk_-16 of size", "no header", "081399 203518 1 INFO a.b: x")
    assert (a.parse_status, a.level, a.service, a.component, a.session_id, a.message) == ("OK", "INFO", "dfs", "dfs.DataNode$X", "blk_-16", "Received block blk_-16 of size")
    assert a.timestamp_us == 1226262918000000
    assert (b.parse_status, b.timestamp_status, b.message) == ("MALFORMED", "UNPARSEABLE", "no header")
    assert (c.parse_status, c.timestamp_status, c.timestamp_us) == ("OK", "UNPARSEABLE", None)


def test_bgl(spark):
    a, b, c = parse(
        spark, "bgl", "- 1117838570 2005.06.03 R02 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO instruction cache  parity", "- 1 2 R02 bad R02 RAS KERNEL INFO", "too short"
    )
    assert (a.message, a.node_id, a.service, a.component, a.level, a.timestamp_us) == ("instruction cache  parity", "R02", "RAS", "KERNEL", "INFO", 1117813370363779)
    assert (b.message, b.timestamp_status, b.parse_status) == (logs.EMPTY_CONTENT, "UNPARSEABLE", "OK")
    assert c.parse_status == "MALFORMED"


def test_hadoop(spark):
    f = "logs/application_1445_0001/container_01.log"
    a, b = parse(spark, "hadoop", "2015-10-18 18:01:47,978 INFO [main] org.apache.hadoop.mapreduce.v2.X: Created: it", "\tat java.lang.Thread", file=f)
    assert (a.service, a.node_id, a.component, a.session_id, a.trace_id, a.message) == ("mapreduce", "main", "org.apache.hadoop.mapreduce.v2.X", "application_1445_0001", "container_01", "Created: it")
    assert (b.parse_status, b.timestamp_status, b.session_id, b.message) == ("CONTINUATION", "CONTINUATION", "application_1445_0001", "\tat java.lang.Thread")


def test_openstack(spark):
    u = "b9000564-fe1a-409b-b8cc-1e88b294cd1d"
    (a,) = parse(spark, "openstack", f"nova-api.log.1 2017-05-16 00:00:00.008 25746 INFO nova.osapi [req-{u} x] [instance: {u}] GET")
    assert (a.service, a.session_id, a.trace_id, a.timestamp_us) == ("nova-api", u, u, 1494892800008000)


def test_lines_keep_numbers_and_endings(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\n\nlast \xff")
    (tmp_path / "empty.log").write_bytes(b"")
    paths = logs.resolve_files(spark, str(tmp_path), ["*.log"])
    rows = logs.lines(spark, [r.path for r in paths.orderBy("file_rank").collect()]).orderBy("file_rank", "line").collect()
    assert [(r.line, bytes(r.raw), r.terminator, r.valid_utf8) for r in rows] == [(1, b"one", "CRLF", True), (2, b"two", "LF", True), (3, b"", "LF", True), (4, b"last \xff", "NONE", False)]
    with pytest.raises(Exception):  # noqa: B017
        logs.resolve_files(spark, str(tmp_path), ["*.none"]).collect()


def test_canonical_record_keeps_every_line_and_its_rules(spark):
    df = spark.createDataFrame([("a/b.log", 1, "081109 203518 143 INFO a.b: x\x00 7"), ("a/b.log", 2, "junk")], "source_file string, line long, text string")
    rec = logs.canonical(logs.parse_hdfs(df), "D", "HDFS")
    rows = violations(rec, canonical_rules()).orderBy("source_line_number").collect()
    assert [r.violations for r in rows] == [[], []]
    assert rows[0].canonical_message == "x\\x00 7" and rows[0].normalization_status == "NUL_ESCAPED" and rows[1].parse_status == "MALFORMED"
    with pytest.raises(Exception, match="does not parse"):
        logs.strict(logs.parse_hdfs(df)).collect()


def test_labels_and_scores(spark, tmp_path):
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_007,Normal\nblk_-1,Anomaly\n")
    assert {r.block_id: r.anomaly for r in logs.read_block_labels(spark, str(tmp_path / "l.csv")).collect()} == {"blk_7": False, "blk_-1": True}
    (tmp_path / "s.jsonl").write_text('{"window_id":"a","status":"OK","nll_mean":1.5}\n{"window_id":"b","status":"ABSTAIN","nll_mean":2}\n')
    assert {r.window_id: r.nll for r in logs.read_scores(spark, str(tmp_path / "s.jsonl")).collect()} == {"a": 1.5, "b": None}
    assert logs.read_scores(spark, str(tmp_path / "none.jsonl")).count() == 0
    text = ["Normal:", "+ application_1_1", "Machine down:", "+ application_1_2", "+ application_1_3"]
    df = spark.createDataFrame(list(enumerate(text)), "line int, text string")
    assert {r.session_id: r.section for r in logs.read_sectioned_labels(df).collect()} == {"application_1_1": "Normal", "application_1_2": "Machine down", "application_1_3": "Machine down"}


def test_sinks_refuse_to_overwrite_and_digest_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"m{i}", "A", i % 2) for i in range(20)], "rank long, message string, architecture_id string, segment int")
    logs.write_stream(df, str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)exists"):
        logs.write_stream(df, str(tmp_path / "s"))
    n, d = logs.write_jsonl(df, str(tmp_path / "j"), "rank")
    assert (n, d) == logs.write_jsonl(df.repartition(3), "", "rank", only_digest=True)
    assert d != logs.write_jsonl(df.where(F.col("rank") > 0), "", "rank", only_digest=True)[1]


def test_lines_of_split_files(spark, tmp_path):
    """Many splits, lines that cross them, a mark at the beginning, with and without a last terminator."""
    import random

    rng = random.Random(4)
    made = {}
    for name, head, tail in (("a", b"", b""), ("b", b"\xef\xbb\xbf", b"\n"), ("c", b"", b"\r"), ("d", b"\xef\xbb\xbf", b""), ("e", b"", b"\n")):
        made[name] = head + b"".join(bytes(rng.choice(b"xyz\xff \xc3\xa9") for _ in range(rng.choice([0, 3, 40, 900]))) + rng.choice([b"\n", b"\r\n"]) for _ in range(400)) + b"end" + tail
        (tmp_path / f"{name}.log").write_bytes(made[name])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    rows = logs.lines(spark, [str(tmp_path / f"{n}.log") for n in made]).orderBy("file_rank", "line").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for k, data in enumerate(made.values()):
        parts = data.split(b"\n")
        for i, x in enumerate(parts[:-1] if parts[-1] == b"" else parts):
            ended, back = i < len(parts) - 1, x.endswith(b"\r")
            want.append((k, i + 1, x[:-1] if back else x, {(True, True): "CRLF", (True, False): "LF", (False, True): "CR", (False, False): "NONE"}[ended, back]))
    assert [(r.file_rank, r.line, bytes(r.raw), r.terminator) for r in rows] == want


def test_more_labels_and_sinks(spark, tmp_path):
    df = lambda *x: spark.createDataFrame(list(enumerate(x)), "line int, text string")
    inline = logs.read_inline_labels(df("- 1 ok", "APPREAD 2 bad", "", "- 3", " 4"))
    assert {r.line: r.anomaly for r in inline.collect()} == {0: False, 1: True, 3: False}
    assert tuple(logs.label_inventory(inline).first()) == (1, 2, 3)
    u = "b9000564-fe1a-409b-b8cc-1e88b294cd1d"
    assert [r.session_id for r in logs.read_listed_labels(df(f" {u} ", "These are:", u, "x")).collect()] == [u]
    scores = spark.createDataFrame([("w1", "OK", 1.0), ("w2", "ABSTAIN", 2.0)], "window_id string, status string, nll_mean double")
    logs.write_scores(scores, str(tmp_path), "expert-1")
    assert {r.window_id: r.nll for r in logs.read_scores(spark, str(tmp_path / "expert-1")).collect()} == {"w1": 1.0, "w2": None}
    for bad in (lambda: logs.write_scores(scores, str(tmp_path), "expert-1"), lambda: logs.write_scores(scores.drop("status"), str(tmp_path), "b"), lambda: logs.write_scores(scores, str(tmp_path), "../b")):
        with pytest.raises(Exception):  # noqa: B017
            bad()
    assert logs.canonical_payload({"b": 1, "a": "é"}) == logs.canonical_payload({"a": "é", "b": 1})
    corpus = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)], "i long, kind string")
    told = logs.write_corpus(corpus, str(tmp_path / "corpus"), "i", "kind")
    assert {k: n for k, (n, _) in told.items()} == {"a": 5, "b": 4} and spark.read.json(str(tmp_path / "corpus")).count() == 9
    (tmp_path / "one").write_text("1")
    (tmp_path / "two").write_text("2")
    manifest = spark.createDataFrame(logs.file_manifest(spark, [str(tmp_path / n) for n in ("one", "two")]).collect())
    (tmp_path / "two").write_text("3")
    gone = spark.createDataFrame([(f"file:{tmp_path}/three", 1, "x", True)], "path string, size_bytes long, sha256 string, utf8 boolean")
    assert sorted(r.state for r in logs.verify_manifest(spark, manifest.unionByName(gone)).collect()) == ["CHANGED", "MISSING", "OK"]


def test_sequential_digest(spark):
    import hashlib

    from logloom.functions.identity import sequential_digest

    ranks = spark.range(0, 5000, 3).withColumnRenamed("id", "rank").repartition(5)
    assert sequential_digest(ranks) == hashlib.sha256(b"".join(k.to_bytes(8, "big") for k in range(0, 5000, 3))).hexdigest()
