"""Calibration, fusion and ranking metrics against hand-made values and brute force."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import fusion, metrics


def scores(spark, values, labels=None):
    return spark.createDataFrame([(i, float(s), int(labels[i]) if labels else 0) for i, s in enumerate(values)], "i int, score double, y int")


def test_tail_pvalues(spark):
    ref = scores(spark, [1, 2, 2, 3])
    got = {r.score: r.p for r in fusion.tail_pvalues(ref, scores(spark, [0, 2, 5])).collect()}
    assert got == {0.0: 1.0, 2.0: 0.6, 5.0: 0.2}
    assert {r.score: r.p for r in fusion.tail_pvalues(ref, scores(spark, [2]), mid_rank=False).collect()} == {2.0: 0.8}


def test_transductive_pvalues(spark):
    got = [r.p for r in fusion.transductive_pvalues(scores(spark, [0.3, 0.1, 0.3, 0.9, 0.5])).orderBy("i").collect()]
    assert got == pytest.approx([0.7, 1.0, 0.7, 0.2, 0.4])


def test_ap_auroc_with_ties(spark):
    y, s = [1, 0, 1, 0, 0, 1, 0], [0.9, 0.8, 0.8, 0.3, 0.2, 0.7, 0.1]
    m = metrics.ranking_metrics(scores(spark, s, y), "score", "y").first()
    assert m["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) for b, q in zip(s, y) if p and not q]
    assert m["auroc"] == pytest.approx(sum(pairs) / len(pairs))
    assert metrics.ranking_metrics(scores(spark, s, [0] * 7), "score", "y").first()["auroc"] is None


def test_budget(spark):
    y = [1, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    m = metrics.at_budgets(scores(spark, [10 - i for i in range(10)], y), "score", "y", "i", (0.2,)).first()
    assert (m["flagged"], m["recall"], m["precision"]) == (2, 0.5, 0.5)


def test_normal_quantile_and_rules(spark):
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(fusion.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-7, abs=1e-8)
    copula = lambda a, b: spark.range(1).select(fusion.copula(F.lit(a), F.lit(b), 0.6)).first()[0]
    assert copula(0.9, 0.9) == 0 and copula(0.9, 0.01) > 0
    mean = lambda r, w=0.5: spark.range(1).select(fusion.generalized_mean(F.lit(0.2), F.lit(0.4), r, w)).first()[0]
    assert mean(1.0) == pytest.approx(-math.log(0.3)) and mean(-math.inf) == pytest.approx(-math.log(0.2)) and mean(-200.0) == pytest.approx(-math.log(0.2), abs=0.01)
    with pytest.raises(ValueError, match="weight"):
        mean(1.0, 1.5)
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(fusion.valid(F.lit(0.0))).collect()


def test_delong_against_pairs(spark):
    rng = random.Random(3)
    y = [int(rng.random() < 0.3) for _ in range(60)]
    a, b = [round(rng.random() + v, 1) for v in y], [round(rng.random() + 0.3 * v, 1) for v in y]
    df = spark.createDataFrame(list(zip(a, b, y)), "a double, b double, y int")
    got = metrics.delong(df, "a", "b", "y").first()
    def parts(s):
        pos, neg = [x for x, v in zip(s, y) if v], [x for x, v in zip(s, y) if not v]
        k = lambda x, z: (x > z) + 0.5 * (x == z)
        return np.array([np.mean([k(x, z) for z in neg]) for x in pos]), np.array([np.mean([k(x, z) for x in pos]) for z in neg])
    (a1, a0), (b1, b0) = parts(a), parts(b)
    var = np.var(a1 - b1, ddof=1) / len(a1) + np.var(a0 - b0, ddof=1) / len(a0)
    assert got["delta_auroc"] == pytest.approx(a1.mean() - b1.mean()) and got["z"] == pytest.approx((a1.mean() - b1.mean()) / math.sqrt(var))
    assert got["p_two_sided"] == pytest.approx(2 * (1 - NormalDist().cdf(abs(got["z"]))), abs=1e-6)


def test_holm_and_decision(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "n string, p double")
    assert {r.n: r.rejected for r in metrics.holm(df, "p").collect()} == {"d": True, "a": True, "c": False, "b": False}
    told = spark.createDataFrame([(0.02, 0.03), (-0.05, -0.02), (-0.005, 0.005), (-0.02, 0.02)], "lo double, hi double")
    assert [r[0] for r in told.select(metrics.decision(F.lit(0), F.col("lo"), F.col("hi"))).collect()] == ["GAIN", "HARM", "EQUIVALENCE", "INCONCLUSIVE"]


def test_bootstrap_is_reproducible_and_paired(spark):
    rng = random.Random(1)
    rows = [(rng.random() + (i % 9 == 0), rng.random(), int(i % 9 == 0), i // 6) for i in range(180)]
    df = spark.createDataFrame(rows, "a double, b double, y int, c int")
    one = sorted(metrics.cluster_bootstrap(df, "a", "b", "y", "c", 50).collect())
    assert one == sorted(metrics.cluster_bootstrap(df.repartition(3), "a", "b", "y", "c", 50).collect())
    gains = [r.gain for r in one]
    m = metrics.summarize_interval(spark.createDataFrame([(g,) for g in gains], "g double"), "g", 0.5).first()
    assert m["ci_low"] == pytest.approx(np.quantile(gains, 0.025)) and m["replicates"] == 50 and np.mean(gains) > 0


def test_logistic_and_crossfit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2, -1] - 0.5)))).astype(float)
    w = metrics.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(np.hstack([np.ones((400, 1)), x]) @ w)))
    gradient = np.hstack([np.ones((400, 1)), x]).T @ (p - y) + np.array([0, 1, 1]) * w
    assert np.abs(gradient).max() < 1e-5
    df = spark.createDataFrame([(i, float(a), float(b), int(v), i % 2) for i, ((a, b), v) in enumerate(zip(x, y))], "i int, u double, v double, y int, fold int")
    out = metrics.crossfit(df, ["u", "v"], "y", "fold")
    assert metrics.ranking_metrics(out, "learned", "y").first()["auroc"] > 0.8


def test_gate_equals_permutations_of_rows(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 30, 400).astype(float)
    b = np.where(rng.random(400) < 0.25, a, rng.integers(0, 30, 400)).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double")
    got = metrics.tail_gate(df, "a", "b")

    def weights(s, k):
        border = np.sort(s)[::-1][k - 1]
        w = (s > border).astype(float)
        w[s == border] = (k - w.sum()) / (s == border).sum()
        return w

    wa, wb = weights(a, 20), weights(b, 20)
    null = np.array([wa @ wb[rng.permutation(400)] for _ in range(4000)])
    assert got["overlap"] == pytest.approx(wa @ wb) and got["lift"] == pytest.approx(wa @ wb / 1.0)
    assert got["p_value"] == pytest.approx((1 + (null >= wa @ wb - 1e-12).sum()) / 4001, abs=0.03)
    drawn = metrics.overlap_null(400, (int((wa == 1).sum()), int(((wa > 0) & (wa < 1)).sum()), wa[(wa > 0) & (wa < 1)].max(initial=0)), (int((wb == 1).sum()), int(((wb > 0) & (wb < 1)).sum()), wb[(wb > 0) & (wb < 1)].max(initial=0)), 4000)
    assert drawn.mean() == pytest.approx(null.mean(), abs=0.06) and drawn.std() == pytest.approx(null.std(), abs=0.06)
    assert metrics.tail_gate(df.withColumn("b", F.col("a")), "a", "b")["open"] and not metrics.tail_gate(df.withColumn("b", F.rand(1)), "a", "b")["open"]
    p = df.select(F.lit(0.1).alias("p"), F.lit(0.3).alias("q")).limit(1)
    assert p.select(metrics.gated_score(F.col("p"), F.col("q"), True)).first()[0] == pytest.approx(-math.log(0.2)) and p.select(metrics.gated_score(F.col("p"), F.col("q"), False)).first()[0] == pytest.approx(-math.log(0.1))


def test_evaluation_and_parity(spark):
    import random

    rng = random.Random(2)
    rows = [(i // 5, y, y + rng.random(), rng.random(), y * 0.3 + rng.random()) for i in range(300) for y in (int(rng.random() < 0.2),)]
    df = spark.createDataFrame(rows, "chunk int, y int, good double, noise double, fair double")
    singles, tests = metrics.evaluate(df, ("good", "noise", "fair"), {"good_over_all": ("good", ("noise", "fair")), "noise_over_fair": ("noise", ("fair",))}, "y", "chunk", reps=200)
    told = {r.method: r for r in singles.collect()}
    assert told["good"].average_precision == 1 and told["good"].auroc == 1 and told["noise"].auroc < 0.7 and 0 < told["good"]["recall_at_0.05"] < 1
    found = {r.test: r for r in tests.collect()}
    assert found["good_over_all"].rejected and found["good_over_all"].noninferior and found["good_over_all"].ci_low <= found["good_over_all"].point <= found["good_over_all"].ci_high
    assert not found["noise_over_fair"].rejected
    a, b = (spark.createDataFrame(x, "k string, v double") for x in ([("a", 1.0), ("b", 2.0), ("c", 3.0)], [("a", 1.0001), ("b", 2.1), ("d", 1.0)]))
    assert {r.k: r["pass"] for r in metrics.parity(a, b, "k", "v", 1e-3).collect()} == {"a": True, "b": False, "c": False, "d": False}
