"""Masking, the NUL codec, template keys and block tokens on golden cases."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import identity, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("Received block blk_-123 of size 67108864 from 10.250.19.102", "Received block <BLK> of size <HEX> from <IP>"),
        ("src: /10.250.19.102:54106 dest: /10.0.0.1:50010", "src: /<IP>:<PORT> dest: /<IP>:<PORT>"),
        ("GET /v2/54fadb412c4e40cdbaed9335e4c35a9e HTTP/1.1 status: 200", "GET /v2/<HEX> HTTP/1.1 status: <NUM>"),
        ("[instance: b9000564-fe1a-409b-b8cc-1e88b294cd1d] up at 2017-05-16 00:00:04.500", "[instance: <UUID>] up at <TS>"),
        ("container_1445144423722_0020_01_000001 done by x86_64 over TCP", "<YARNID> done by x86_64 over TCP"),
        ("core.2275 on R02-M1-N0-C:J12-U11  generated", "core.<NUM> on <NODE> generated"),
        ("before\x0fafter", "before<CTRL>after"),
        ("  spaced \t out  ", "spaced out"),
        ("", ""),
    ],
)
def test_normalize(spark, message, expected):
    assert one(spark, text.normalize(F.col("m")), m=message) == expected


def test_normalize_null_and_reserved(spark):
    assert spark.sql("select cast(null as string) m").select(text.normalize(F.col("m"))).first()[0] is None
    with pytest.raises(Exception, match="reserved"):
        one(spark, text.normalize(F.col("m")), m="a" + text.SENTINEL)


@pytest.mark.parametrize("message", ["plain", "\x00start", "end\x00", "\x00\x00", "literal \\x00 and \x00", "back\\slash \\\\ \x00", "é\x00ü", "back\\slash only"])
def test_nul_round_trip(spark, message):
    status = text.nul_status(F.col("m"))
    escaped = text.escape_nul(F.col("m"))
    got = spark.range(1).select(F.lit(message).alias("m")).select(escaped.alias("e"), status.alias("s"), text.unescape_nul(escaped, status).alias("b")).first()
    assert got["b"] == message and "\x00" not in got["e"]
    assert got["s"] == ("NUL_ESCAPED" if "\x00" in message else "UNCHANGED")


def test_malformed_escape_is_null(spark):
    assert one(spark, text.unescape_nul(F.col("m"), F.lit("NUL_ESCAPED")), m="bad \\q") is None


def test_template_key_and_spans(spark):
    m = "Receiving block blk_123456 src: /10.250.19.102:54106"
    assert one(spark, text.template_key(F.col("m")), m=m) == "Receiving block <V> src: <V>"
    spans = one(spark, text.volatile_spans(F.col("m")), m=m)
    assert [m[a:b] for a, b in spans] == ["blk_123456", "/10.250.19.102:54106"]


@pytest.mark.parametrize(("raw", "normal"), [("blk_00042", "blk_42"), ("blk_-00042", "blk_-42"), ("blk_-0", "blk_0"), ("blk_bad", None)])
def test_block_id(spark, raw, normal):
    assert one(spark, text.normalize_block_id(F.col("m")), m=raw) == normal


def test_block_tokens(spark):
    got = one(spark, text.block_tokens(F.col("m")), m="blk_7 again blk_007 malformed blk_bad")
    assert (got["ids"], got["duplicates"], got["malformed"]) == (["blk_7"], ["blk_7"], ["blk_bad"])


def test_membership_digest_ignores_order_and_blocks(spark):
    a = identity.membership_digest(spark.createDataFrame([(5,), (1,), (70000,)], "rank long")).first()
    b = identity.membership_digest(spark.createDataFrame([(70000,), (5,), (1,)], "rank long")).first()
    c = identity.membership_digest(spark.createDataFrame([(70000,), (5,)], "rank long")).first()
    assert a == b and a["digest"] != c["digest"] and a["members"] == 3


def test_canonical_json_sorts_and_keeps_nulls(spark):
    assert one(spark, identity.canonical_json(b=F.lit(1), a=F.lit(None).cast("string")), m="x") == '{"a":null,"b":1}'


def test_block_ids_of_any_length(spark):
    long = "9" * 60
    m = f"blk_{long} blk_-{long} blk_000{long} blk_10 blk_9 blk_-10 blk_-9 blk_-0 blk_000 blk_x"
    r = spark.createDataFrame([(m,)], "m string").select(text.block_tokens(F.col("m")).alias("b")).first().b
    assert r.ids == [f"blk_-{long}", "blk_-10", "blk_-9", "blk_0", "blk_9", "blk_10", f"blk_{long}"]
    assert r.duplicates == [f"blk_{long}", "blk_0"] and r.malformed == ["blk_x"]


def test_volatile_words_have_digits_of_any_script(spark):
    words = ["a123", "12b", "\u0661\u0662\u0663", "x\u00b2\u00b3\u00b9", "\u2460\u24611", "\u00bd\u00bd\u00bd", "1\u06622"]
    got = [r.v for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.is_volatile(F.col("w")).alias("v")).collect()]
    assert got == [sum(c.isdigit() for c in w) >= 3 for w in words]


def test_corruption_and_prompts(spark):
    df = spark.createDataFrame([(1, "one two  three four five"), (2, "x"), (3, "  "), (4, None), (5, "a <|b|> c")], "i int, m string")
    got = {r.i: (r.c, r.p) for r in df.select("i", text.corrupt(F.col("m"), 7, 0.4).alias("c"), text.prompt(F.col("m"), 7, 0.0).alias("p")).collect()}
    assert got[1][0].split().count("[MASK]") == 2 and len(got[1][0].split()) == 5 and got[2][0] == "[MASK]" and got[3] == ("", None)
    assert got[1][1].startswith("Restore the log message:\n") and got[1][1].count("[MASK]") == 1 and "< |b| >" in got[5][1].replace("[MASK]", "< |b| >")
    again = df.repartition(3).select("i", text.corrupt(F.col("m"), 7, 0.4).alias("c")).collect()
    assert {r.i: r.c for r in again} == {i: c for i, (c, _) in got.items()}


def test_rule_tables(spark, tmp_path):
    import json


    def load(**changes):
        table = {"preserve": [{"name": "http", "pattern": r"HTTP/\d"}], "masks": [{"name": "n", "pattern": r"\d+", "into": "<N>"}]} | changes
        (tmp_path / "r.json").write_text(json.dumps(table))
        return text.load_rules(str(tmp_path / "r.json"))

    preserve, masks = load()
    assert spark.sql("select 'HTTP/1 7' m").select(text.normalize(F.col("m"), preserve, masks)).first()[0] == "HTTP/1 <N>"
    for bad in ({"masks": [{"name": "http", "pattern": "x", "into": "y"}]}, {"masks": [{"name": "a", "pattern": "(", "into": "y"}]}, {"masks": [{"name": "is_anomaly", "pattern": "x", "into": "y"}]}, {"masks": [{"name": "a", "pattern": "x", "into": "y", "when": "z"}]}, {"more": []}):
        with pytest.raises(Exception):  # noqa: B017
            load(**bad)
