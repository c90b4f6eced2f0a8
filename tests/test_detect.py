"""Detectors, template mining and streaming forms."""

import math
import random
import time

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators import detect, templates
from logloom.streaming import online


def test_baseline_scores(spark):
    train = spark.createDataFrame([("s", i, m) for i, m in enumerate("abab")] + [("t", 0, "a")], "q string, o int, m string")
    got = detect.Baseline(train, "q", "o", "m").score(spark.createDataFrame([("x", 0, "a"), ("x", 1, "b"), ("x", 2, "z")], "q string, o int, m string")).orderBy("o").collect()
    n, v = 5, 3
    assert got[0].frequency == pytest.approx(-math.log(3.5 / (n + 0.5 * v))) and got[0].markov == got[0].frequency
    assert got[1].markov == pytest.approx(-math.log(2.5 / (2 + 0.5 * v)))
    assert got[2].frequency == pytest.approx(-math.log(0.5 / (n + 0.5 * v))) and got[2].markov == pytest.approx(-math.log(0.5 / (1 + 0.5 * v)))


def test_mining_and_matching(spark):
    lines = [f"Receiving block blk_{i} src: /10.0.0.{i}:50010" for i in range(5)] + ["Deleting file a now", "Deleting file b now", "alone"]
    df = spark.createDataFrame(list(enumerate(lines)), "o int, m string")
    found = templates.fit(df, "m", "o")
    told = {r.template: r.records for r in found.collect()}
    assert told == {"Receiving block <HDFS_BLOCK> src: /<IPV4_ENDPOINT>": 5, "Deleting file <*> now": 2, "alone": 1}
    new = spark.createDataFrame([("Deleting file c now",), ("Deleting it",), ("alone",)], "m string")
    got = {r.k: (r.event_id, r.parameters) for r in templates.transform(new.withColumnRenamed("m", "k"), "k", found).collect()}
    assert got["Deleting file c now"] == (templates.event_id("Deleting file <*> now"), ["c"])
    assert got["Deleting it"][0] == templates.UNSEEN and got["alone"][0] == templates.event_id("alone")


def test_tree_limits_children():
    tree = templates.mine([(f"tok{chr(97 + i % 26)}{chr(97 + i // 26)} x", 1) for i in range(200)], max_children=10)
    assert len(tree.children[(2,)]) <= 10 and templates.WILDCARD in tree.children[(2,)]


def plainly_mined(messages, similarity=0.4, room=100):
    """Templates with their numbers of messages: every message is compared with all clusters of its leaf."""
    children, leaves = {}, {}
    for m in messages:
        tokens = m.split()
        where = (len(tokens),)
        for t in tokens[:2]:
            known = children.setdefault(where, set())
            if t not in known and (any(c.isdigit() for c in t) or len(known - {"<*>"}) >= room - 1):
                t = "<*>"
            known.add(t)
            where = (*where, t)
        found, top = None, (-1, -1)
        for c in leaves.setdefault(where, []):
            now = (sum(a == b != "<*>" for a, b in zip(c[0], tokens, strict=True)), c[0].count("<*>"))
            if now > top:
                found, top = c, now
        if found is None or tokens and top[0] / len(tokens) < similarity:
            leaves[where].append([tokens, 1])
        else:
            found[0] = [a if a == b else "<*>" for a, b in zip(found[0], tokens, strict=True)]
            found[1] += 1
    told = {}
    for tokens, n in (c for own in leaves.values() for c in own):
        told[" ".join(tokens)] = told.get(" ".join(tokens), 0) + n
    return told


def test_fit_equals_plain_mining(spark):
    draw = random.Random(5)
    words = ["a", "b", "c", "d", "e", "f", "g", "<*>", "x1", "\u0663", "\u00b2z", "blk"]
    lines = [draw.choice([" ", "\u2003", "\x1c", "\n", "\x85 "]).join(draw.choices(words, k=draw.choice([1, 2, 3, 7, 8, 8, 8, 8]))) for _ in range(1500)]
    lines += [f"w{chr(97 + i % 26)}{chr(97 + i // 26)} {draw.choice('abc')} {draw.choice('abcdef')} z{draw.choice('abc')} e" for i in range(300)] + ["", " "]
    draw.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    df = spark.createDataFrame([(i, m) for i, m in enumerate(lines)] + [(0, None)], "o int, m string").repartition(7)
    rows = templates.fit(df, "m", "o").collect()
    want = plainly_mined(lines)
    assert {r.template: r.records for r in rows} == want and len(rows) == len(want) and any("<*>" in t for t in want)
    assert all(r.event_id == templates.event_id(r.template) for r in rows)


def test_mining_does_not_compare_all_messages():
    draw = random.Random(6)
    lines = [" ".join(["on", "it", *(f"w{draw.randrange(1000)}" for _ in range(58))]) for _ in range(4000)]
    began = time.perf_counter()
    tree = templates.mine((m, 1) for m in lines)
    assert len(tree.children) == 2 and time.perf_counter() - began < 10


def test_matching_equals_a_search_of_all(spark, monkeypatch):
    monkeypatch.setattr(templates, "SLICE", 50)
    draw = random.Random(7)
    frozen = sorted({" ".join(draw.choices(["a", "b", "c", "d", "7", "<*>", "<*>"], k=draw.choice([1, 3, 4, 4, 5]))) for _ in range(250)} | {""})
    lines = sorted({" ".join(draw.choices(["a", "b", "c", "d", "e", "7", "8", "<*>"], k=draw.choice([1, 3, 4, 4, 5, 6]))) for _ in range(700)} | {""})
    tree, leaves = templates.Tree(), {}
    for t in frozen:
        leaves.setdefault(tree.path(t.split(), True), []).append(t)

    def searched(tokens):
        fits = {leaf: [t for t in own if len(t.split()) == len(tokens) and all(a in (b, "<*>") for a, b in zip(t.split(), tokens, strict=True))] for leaf, own in leaves.items()}
        if own := fits.get(tree.path(tokens, False)):
            return max(own, key=lambda t: t.split().count("<*>"))
        return min((t for own in fits.values() for t in own), key=lambda t: t.split().count("<*>"), default=None)

    df = spark.createDataFrame([(m, m) for m in [*lines, None, *lines[:9]]], "m string, k string")
    given = spark.createDataFrame([(t,) for t in frozen], "template string")

    def refuse(self):
        raise AssertionError("templates pass the driver")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", refuse)
        out = templates.transform(df, "k", given)
    rows = out.collect()
    assert len(rows) == len(lines) + 10 and out.columns == ["m", "k", "event_id", "template", "parameters"]
    for r in rows:
        want = searched(r.k.split()) if r.k is not None else None
        assert (r.m, r.template) == (r.k, want)
        assert r.event_id == (templates.UNSEEN if want is None else templates.event_id(want))
        assert r.parameters == ([b for a, b in zip(want.split(), r.k.split(), strict=True) if a == "<*>"] if want else [])


def test_knn_novelty(spark):
    train = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "i int, t string")
    got = {r.i: r.novelty for r in detect.knn_novelty(train, spark.createDataFrame([(7, "B A"), (8, "z"), (9, "a")], "i int, t string"), "i", "t").collect()}
    assert got[7] == pytest.approx(0, abs=1e-9) and got[8] == 1 and 0 < got[9] < 1


def test_knn_counts_distinct_training_texts(spark, monkeypatch):
    monkeypatch.setattr(detect, "KNN_BLOCK", 2)
    texts = ["a b"] * 5 + ["c b", "d e", "a\u2003f g", "b b c"]
    asked = ["a d", "B c", "q", "g a b b", "a b", ""]
    got = {r.i: r.novelty for r in detect.knn_novelty(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(list(enumerate(asked)), "i int, t string"), "i", "t").collect()}
    unique = [t.split() for t in sorted(set(texts))]
    idf = {w: math.log((1 + len(unique)) / (1 + sum(w in u for u in unique))) + 1 for u in unique for w in u}

    def unit(words):
        v = {w: words.count(w) * idf[w] for w in set(words) if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    for i, t in enumerate(asked):
        v = unit(t.lower().split())
        assert got[i] == pytest.approx(1 - max(sum(v.get(w, 0) * x for w, x in unit(u).items()) for u in unique), abs=1e-9), t


def test_pca_keeps_as_many_components_as_the_variance_needs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 70))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    got = {r.i: r.residual for r in detect.pca_residual(df, df, "x").collect()}
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.95) + 1)
    rest = c - c @ vt[:k].T @ vt[:k]
    assert k > 50 and all(got[i] == pytest.approx(v, abs=1e-6) for i, v in enumerate((rest * rest).sum(1)))


def test_order_blind_distance(spark):
    rows = [("a", m) for m in "xxy"] + [("b", m) for m in "xz"] + [("new", m) for m in "qqx"]
    got = {r.s: r for r in detect.novelty_flags(spark.createDataFrame(rows, "s string, m string"), F.col("s") != "new", "s", "m").collect()}
    mean = {"x": 1.5, "y": 0.5, "z": 0.5}
    assert got["new"].unseen == 2 and got["new"].length == 3 and got["new"].distinct_messages == 2
    assert got["new"].distance == pytest.approx(math.sqrt(sum(({"q": 2, "x": 1}.get(m, 0) - mean.get(m, 0)) ** 2 for m in "qxyz")))


def test_trees_draw_from_all_rows(spark):
    rows = [(i, [float(i), 0.0]) for i in range(6000)] + [(9999, [50.0, 77.0])]
    df = spark.createDataFrame(rows, "i int, x array<double>").repartition(8)
    f = {x.i: x.isolation for x in detect.isolation_forest(df, df.where("i % 100 = 0 or i = 9999"), "x", "i", trees=400, sample=64).collect()}
    assert f == {x.i: x.isolation for x in detect.isolation_forest(df.repartition(3), df.where("i % 100 = 0 or i = 9999"), "x", "i", trees=400, sample=64).collect()}
    assert len(f) == 61 and all(0 < v < 1 for v in f.values())


def test_pca_and_forest_find_the_odd_one(spark):
    rows = [(i, [float(i % 10), 2.0 * (i % 10), 1.0]) for i in range(100)]
    odd = [(1000, [5.0, -30.0, 9.0])]
    train, test = spark.createDataFrame(rows, "i int, x array<double>"), spark.createDataFrame(rows[:20] + odd, "i int, x array<double>")
    r = {x.i: x.residual for x in detect.pca_residual(train, test, "x").collect()}
    assert max(r, key=r.get) == 1000 and r[3] < 1e-9
    f = {x.i: x.isolation for x in detect.isolation_forest(test, test, "x", "i").collect()}
    assert max(f, key=f.get) == 1000


def test_streaming_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' m union all select timestamp'2024-01-01 00:20:00', 'a' union all select timestamp'2024-01-01 01:20:00', 'b'").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, m string").parquet(str(tmp_path / "in"))
    q = online.message_counts(source, "ts", "m").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.m, r.n) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
