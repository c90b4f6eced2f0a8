"""Made scores of two experts, to compare fusion rules before any real score is seen."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import fusion, metrics

#: Whether both experts see every anomaly, one of them, or a third of them each and a third both; how they correlate; how far anomalies stand out.
REGIMES, CORRELATIONS, SHIFTS = ("AND", "OR", "MIXED"), (0.0, 0.5, 0.8), (1.5, 3.0)


def experts(spark: SparkSession, seeds: int = 30, units: int = 2000, prevalence: float = 0.04) -> DataFrame:
    """``scenario, regime, rho, shift, seed, y, a, b``: binormal scores with a shared part, ``units`` of each scenario and seed."""
    kinds = [(r, c, s) for r in REGIMES for c in CORRELATIONS for s in SHIFTS]
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(r).alias("regime"), F.lit(c).alias("rho"), F.lit(s).alias("shift")) for i, (r, c, s) in enumerate(kinds)]))
    base = spark.range(0, units, 1, 8).select("id", table.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).select("k.*", "seed")
    drawn = base.select("*", (F.rand(1) < prevalence).alias("bad"), F.randn(2).alias("shared"), F.randn(3).alias("e1"), F.randn(4).alias("e2"), F.rand(5).alias("k"))
    see = lambda either, mixed: F.when(F.col("regime") == "AND", F.lit(True)).when(F.col("regime") == "OR", either).otherwise(mixed)
    own = lambda e, seen: F.sqrt("rho") * F.col("shared") + F.sqrt(1 - F.col("rho")) * F.col(e) + F.when(F.col("bad") & seen, F.col("shift")).otherwise(0.0)
    k = F.col("k")
    return drawn.select(
        "scenario", "regime", "rho", "shift", "seed", F.col("bad").cast("int").alias("y"), own("e1", see(k < 0.5, k < 0.66)).alias("a"), own("e2", see(k >= 0.5, k > 0.33)).alias("b")
    )


def rule_gains(rows: DataFrame) -> DataFrame:
    """``regime, rho, shift, rule, best_single, gain``: means over seeds of each rule's average precision, less that of the better expert."""
    from logloom.operators.lineage import cut_lineage

    by = ("scenario", "seed")
    rows = cut_lineage(rows)
    p = fusion.transductive_pvalues(fusion.transductive_pvalues(rows, "a", by, "p"), "b", by, "q")
    x, y = F.col("p"), F.col("q")
    fitted = p.groupBy(*by).agg(
        F.corr(fusion.gaussianise(x), fusion.gaussianise(y)).alias("r"), *[f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    )
    p = p.join(fitted, list(by)).withColumn("r", F.greatest(F.lit(-0.95), F.least(F.lit(0.95), "r")))
    u, v = (F.greatest(fusion.gaussianise(c), F.lit(0.0)) for c in (x, y))
    rules = {n: rule(x, y) for n, rule in fusion.RULES.items()}
    rules["copula"] = (u * u - u * v * 2 * F.col("r") + v * v) / (1 - F.col("r") * F.col("r"))
    rules["zscore"] = ((F.col("a") - F.col("mean_a")) / F.col("sd_a") + (F.col("b") - F.col("mean_b")) / F.col("sd_b")) / 2
    rules |= {"expert a": F.col("a"), "expert b": F.col("b")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("value")) for n, c in rules.items()]))
    found = metrics.ranking_metrics(p.select(*by, "y", each.alias("e")).select(*by, "y", "e.rule", "e.value"), "value", "y", (*by, "rule"))
    best = found.where("rule like 'expert %'").groupBy(*by).agg(F.max("average_precision").alias("best"))
    names = rows.select("scenario", "regime", "rho", "shift").distinct()
    told = found.where("rule not like 'expert %'").join(best, list(by)).join(F.broadcast(names), "scenario")
    return told.groupBy("regime", "rho", "shift", "rule").agg(F.avg("best").alias("best_single"), F.avg(F.col("average_precision") - F.col("best")).alias("gain"))


def expected_single(shift: float) -> float:
    """The area under the curve of an expert that sees every anomaly."""
    return 0.5 * (1 + math.erf(shift / 2))
