"""The commands, one after the other, over a few log files."""

import json
import random

import pytest

from logloom import cli


def run(capsys, *args):
    code = cli.main([str(a) for a in args])
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands(spark, tmp_path, capsys):
    rng = random.Random(1)
    (tmp_path / "raw").mkdir()
    at = sorted(rng.randint(0, 86399) for _ in range(400))
    rows = [f"081109 {t // 3600:02d}{t // 60 % 60:02d}{t % 60:02d} 1 INFO dfs.X: Got blk_{i // 4} from node{rng.randint(0, 3)}" for i, t in enumerate(at)]
    (tmp_path / "raw" / "a.log").write_text("\n".join(rows[:200]) + "\n")
    (tmp_path / "raw" / "b.log").write_text("\n".join(rows[200:] + ["junk"]) + "\n")
    t = lambda name: tmp_path / name
    files = ("--root", t("raw"), "--files", "*.log")
    assert run(capsys, "manifest", *files, "--out", t("manifest")) == (0, {"files": 2})
    assert run(capsys, "verify", "--manifest", t("manifest")) == (0, {"OK": 2, "failed": False})
    assert run(capsys, "records", *files, "--adapter", "hdfs", "--dataset", "D", "--out", t("records"))[1] == {"OK": 400, "MALFORMED": 1}
    code, told = run(capsys, "streams", "--records", t("records"), "--out", t("stream"))
    assert code == 0 and len(told["cuts"]) == 3
    assert run(capsys, "split", "--stream", t("stream"), "--out", t("split"))[1] == {"boundaries": [0, 240, 280, 320, 360, 401]}
    assert run(capsys, "templates", "--stream", t("stream"), "--out", t("templates"))[1]["templates"] >= 1
    assert sum(run(capsys, "events", "--stream", t("stream"), "--templates", t("templates"), "--out", t("events"))[1].values()) == 401
    assert "evaluation/windows" in run(capsys, "target-view", "--stream", t("stream"), "--sample", 20, "--out", t("view"))[1]
    code, told = run(capsys, "audit", "--stream", t("stream"), "--out", t("audit"))
    assert told["INFORMATIONAL"] == 2 and code == int("FAIL" in told)
    spark.createDataFrame([(f"blk_{i}", i % 9 == 0) for i in range(100)], "unit string, anomaly boolean").write.parquet(str(t("labels")))
    told = run(capsys, "purge-audit", "--split", t("split"), "--labels", t("labels"), "--log", t("log"), "--reason", "sizes")[1]
    assert sum(n for n, _ in told.values()) == 100 and sum(n for _, n in told.values()) == 12
    assert run(capsys, "seal", "--seal", t("seal"))[1] == {"state": "SEALED"} and run(capsys, "seal", "--seal", t("seal"), "--grant", "g")[1] == {"state": "UNLOCKED"}
    spark.createDataFrame([(i // 5, i % 7 == 0, float(i % 7 == 0) + rng.random(), rng.random()) for i in range(200)], "c int, y boolean, s double, r double").selectExpr("c", "int(y) y", "s", "r").write.parquet(str(t("scores")))
    told = run(capsys, "evaluate", "--table", t("scores"), "--scores", "s", "r", "--label", "y", "--cluster", "c", "--reps", 100)[1]
    assert [m["method"] for m in told["methods"]] == ["s", "r"] and told["tests"][0]["rejected"]
    assert run(capsys, "query", "--name", "unit_spans", "--tables", "/root/testdata/sf0.001", "--out", t("query"))[1]["rows"] > 0
    (tmp_path / "raw" / "a.log").write_text("changed")
    assert run(capsys, "verify", "--manifest", t("manifest"))[0] == 1
    for bad in (["query", "--name", "unit_spans", "--tables", "x", "--out", str(t("query"))], ["records"], []):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_split_and_metadata_commands(spark, tmp_path, capsys):
    t = lambda name: tmp_path / name
    spark.createDataFrame([(i, "TEST" if i > 6 else "BASE_TRAIN") for i in range(9)], "id long, partition string").write.parquet(str(t("rows")))
    told = run(capsys, "freeze-split", "--table", t("rows"), "--out", t("split"))[1]
    assert {k: v[0] for k, v in told.items()} == {"TEST": 2, "BASE_TRAIN": 7}
    assert run(capsys, "check-split", "--split", t("split")) == (0, {"TEST": "OK", "BASE_TRAIN": "OK", "failed": False})
    spark.createDataFrame([(99,)], "id long").write.parquet(str(t("split") / "rows" / "partition=NEW"))
    assert run(capsys, "check-split", "--split", t("split"))[0] == 1
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.log").write_bytes(b"got blk_1 blk_2\nblk_02\nblk_x\n\xff\nlast blk_9")
    told = run(capsys, "metadata", "--root", t("raw"), "--files", "*.log", "--out", t("meta"))[1]
    assert told == {"lines": 5, "ASSIGNED": 3, "UNASSIGNED": 2, "components": 2, "reason:DECODE_ERROR": 1, "reason:MALFORMED_BLOCK_TOKEN": 1, "issue:MALFORMED_BLOCK_TOKEN": 1, "issue:MISSING_LINE_TERMINATOR": 1, "issue:MULTIPLE_BLOCK_IDS": 1}
