"""Ranking metrics with exact ties, on distinct scores, and intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.ordering import global_rank, quantiles, running_sums

Z95 = 1.959963984540054


def score_table(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``score, n, pos`` by distinct score of each group, with ``n_upto`` and ``tp_upto`` from the highest score down."""
    distinct = df.groupBy(*by, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return running_sums(distinct, -F.col("score"), sums={"n_upto": F.col("n"), "tp_upto": F.col("pos")}, by=by)


def ranking_metrics(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group: ``units, positives, average_precision, auroc``; the latter two null without both classes.

    Precision steps over distinct scores; AUROC takes mid-ranks for ties.
    """
    table = score_table(df, score, label, by)
    whole = df.groupBy(*by).agg(F.count("*").alias("units"), F.sum(F.col(label).cast("long")).alias("positives"))
    step = F.col("pos") * F.col("tp_upto") / F.col("n_upto")
    # a positive outranks the negatives below it and half of those beside it
    beaten = F.col("pos") * ((F.col("units") - F.col("positives")) - (F.col("n_upto") - F.col("tp_upto")) + (F.col("n") - F.col("pos")) / 2)
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("units"))
    joined = table.join(whole, list(by)) if by else table.join(F.broadcast(whole))
    sums = joined.groupBy(*by, "units", "positives").agg(F.sum(step).alias("s"), F.sum(beaten).alias("b"))
    return sums.select(
        *by,
        "units",
        "positives",
        F.when(both, F.col("s") / F.col("positives")).alias("average_precision"),
        F.when(both, F.col("b") / (F.col("positives") * (F.col("units") - F.col("positives")))).alias("auroc"),
    )


def best_single(df: DataFrame, scores: tuple[str, ...], label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The greatest average precision of some scores, by group: ``best``."""
    told = [ranking_metrics(df, s, label, by).select(*by, "average_precision") for s in scores]
    out = told[0]
    for other in told[1:]:
        out = out.unionByName(other)
    return out.groupBy(*by).agg(F.max("average_precision").alias("best"))


def rank_configurations(df: DataFrame, scores: dict[str, Column], singles: tuple[str, ...], label: str, by: str, margin: float = -0.02) -> DataFrame:
    """``config, worst, mean, qualifies, place``: settings by their worst gain in average precision over the better single score, then by their mean.

    A gain is taken in each system ``by``; a setting qualifies where its worst gain is not below ``margin`` and one is above 0.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), c.alias("value")) for n, c in scores.items()]))
    spread = df.select(by, label, each.alias("c")).select(by, label, "c.config", "c.value")
    found = ranking_metrics(spread, "value", label, (by, "config")).join(best_single(df, singles, label, (by,)), by)
    gains = found.groupBy("config").agg(
        F.min(F.col("average_precision") - F.col("best")).alias("worst"), F.avg(F.col("average_precision") - F.col("best")).alias("mean"), F.max(F.col("average_precision") - F.col("best")).alias("top")
    )
    order = Window.orderBy(F.desc(F.round("worst", 9)), F.desc(F.round("mean", 9)), "config")  # a row for each setting
    return gains.select("config", "worst", "mean", ((F.col("worst") >= margin) & (F.col("top") > 0)).alias("qualifies"), F.row_number().over(order).cast("long").alias("place"))


def at_budgets(df: DataFrame, score: str, label: str, unit: str, budgets: tuple[float, ...]) -> DataFrame:
    """``budget, flagged, recall, precision, fpr`` of the top max(1, ceil(budget * n)) units; ties by unit order."""
    ranked = global_rank(df.select(score, label, unit), -F.col(score), F.col(unit).asc(), name="__place")
    whole = df.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    told = ranked.select("__place", F.col(label).cast("long").alias("y"), F.explode(F.array(*map(F.lit, budgets))).alias("budget")).join(F.broadcast(whole))
    k = F.greatest(F.lit(1), F.ceil(F.col("budget") * F.col("n")))
    hits = told.where(F.col("__place") < k).groupBy("budget", "n", "p").agg(F.count("*").alias("flagged"), F.sum("y").alias("tp"))
    return hits.select(
        "budget",
        "flagged",
        (F.col("tp") / F.col("p")).alias("recall"),
        (F.col("tp") / F.col("flagged")).alias("precision"),
        ((F.col("flagged") - F.col("tp")) / (F.col("n") - F.col("p"))).alias("fpr"),
    )


def best_f1(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """For each source the threshold of the best F1, the highest of equals; ``source, threshold, f1, precision, recall``."""
    distinct = df.groupBy(F.col(by).alias("source"), F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).persist()
    upto = running_sums(distinct, -F.col("score"), sums={"n_upto": F.col("n"), "tp_upto": F.col("pos")}, by=("source",))
    whole = df.groupBy(F.col(by).alias("source")).agg(F.sum(F.col(label).cast("long")).alias("p")).where("p > 0")
    scored = upto.join(whole, "source").withColumn("f1", F.lit(2.0) * F.col("tp_upto") / (F.col("n_upto") + F.col("p")))
    best = scored.groupBy("source").agg(F.max_by(F.struct("score", "f1", "tp_upto", "n_upto", "p"), F.struct("f1", "score")).alias("b"))
    return best.select("source", F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"), (F.col("b.tp_upto") / F.col("b.n_upto")).alias("precision"), (F.col("b.tp_upto") / F.col("b.p")).alias("recall"))


def mid_ranks(df: DataFrame, score: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with average ranks, 1-based, ascending, inside ``by``."""
    distinct = df.withColumn("__s", F.col(score)).groupBy(*by, "__s").agg(F.count("*").alias("__n")).persist()
    upto = running_sums(distinct, F.col("__s"), sums={"__upto": F.col("__n")}, by=by)
    table = upto.select(*by, "__s", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return df.withColumn("__s", F.col(score)).join(table, [*by, "__s"]).drop("__s")


def spearman(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """``by, units, spearman``: Pearson correlation of mid-ranks inside each group."""
    ranked = mid_ranks(mid_ranks(df, a, "__ra", (by,)), b, "__rb", (by,))
    return ranked.groupBy(by).agg(F.count("*").alias("units"), F.corr("__ra", "__rb").alias("spearman"))


def overlap(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Two boolean flags against the label: Jaccard index, and positives that one, both or neither caught."""
    x, y, z = F.col(a), F.col(b), F.col(label).cast("boolean")
    return df.agg(
        (F.count_if(x & y) / F.count_if(x | y)).alias("jaccard"),
        F.count_if(z & x & ~y).alias("only_a"),
        F.count_if(z & y & ~x).alias("only_b"),
        F.count_if(z & x & y).alias("both"),
        F.count_if(z & ~x & ~y).alias("neither"),
    )


def delong(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Paired test of two AUROCs: ``delta_auroc, z, p_two_sided``; z and p are null where the variance is not positive.

    Placement values come from mid-ranks over all units and inside each class, so no pair is formed.
    """
    out = df.withColumn("__y", F.col(label).cast("boolean"))
    for s, n in ((a, "a"), (b, "b")):
        out = mid_ranks(mid_ranks(out, s, f"__all_{n}"), s, f"__own_{n}", ("__y",))
    counts = df.agg(F.sum(F.col(label).cast("long")).alias("__p"), F.sum(1 - F.col(label).cast("long")).alias("__n"))
    out = out.join(F.broadcast(counts))
    for n in "ab":
        above = F.col(f"__all_{n}") - F.col(f"__own_{n}")
        out = out.withColumn(f"__v_{n}", F.when(F.col("__y"), above / F.col("__n")).otherwise(1 - above / F.col("__p")))
    part = out.groupBy("__y", "__p", "__n").agg(
        (F.var_samp("__v_a") + F.var_samp("__v_b") - F.covar_samp("__v_a", "__v_b") * 2).alias("v"),
        (F.avg("__v_a") - F.avg("__v_b")).alias("d"),
    )
    both = part.agg(
        F.max(F.when(F.col("__y"), F.col("d"))).alias("delta_auroc"),
        F.sum(F.col("v") / F.when(F.col("__y"), F.col("__p")).otherwise(F.col("__n"))).alias("var"),
    )
    z = F.when(F.col("var") > 0, F.col("delta_auroc") / F.sqrt("var"))
    return both.select("delta_auroc", z.alias("z"), two_sided(z).alias("p_two_sided"))


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value, by Abramowitz and Stegun 7.1.26 (absolute error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (x * 0.3275911 + 1)
    #: Coefficients of the approximation.
    poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def holm(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """``df`` (a few tests) with the step-down threshold and whether each is rejected."""
    n = df.count()
    order = Window.orderBy(p, *[c for c in df.columns if c != p])
    placed = df.withColumn("__k", F.row_number().over(order)).withColumn("threshold", F.lit(alpha) / (n - F.col("__k") + 1))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("rejected", F.bool_and(F.col(p) <= F.col("threshold")).over(upto)).drop("__k")


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a share, clamped to [0, 1]."""
    p = x / n
    centre, half = (p + z * z / (n * 2)) / (1 + z * z / n), F.sqrt(p * (1 - p) / n + z * z / (n * n * 4)) * z / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def newcombe(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """Difference of two shares and its interval by Newcombe's method 10, clamped to [-1, 1]."""
    (l1, u1), (l2, u2) = wilson(x1, n1), wilson(x2, n2)
    p1, p2 = x1 / n1, x2 / n2
    d = p1 - p2
    low = d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    high = d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return d, F.greatest(F.lit(-1.0), low), F.least(F.lit(1.0), high)


def robust_summary(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Count, extremes, six exact quantiles with linear interpolation, and the interquartile range; a null group is a group."""
    shares = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    out = df.groupBy(*by).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"))
    told = quantiles(df, x, shares, by)
    joined = out.join(told, list(by), "left") if by else out.join(F.broadcast(told))
    return joined.select(*by, "count", "min", *shares, "max", (F.col("q75") - F.col("q25")).alias("iqr"))


def summarize_interval(values: DataFrame, x: str, point: float, alpha: float = 0.05) -> DataFrame:
    """``point, ci_low, ci_high, one_sided_p_le_0, replicates`` of bootstrap replicates."""
    q = F.percentile(x, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return values.agg(q.alias("q"), F.count_if(F.col(x) <= 0).alias("k"), F.count(x).alias("replicates")).select(
        F.lit(point).alias("point"), F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), ((F.col("k") + 1) / (F.col("replicates") + 1)).alias("one_sided_p_le_0"), "replicates"
    )


def decision(point: Column, low: Column, high: Column, delta: float = 0.01) -> Column:
    """GAIN, HARM, EQUIVALENCE or INCONCLUSIVE from an interval and a margin."""
    return F.when(low > delta, "GAIN").when(high < -delta, "HARM").when((low >= -delta) & (high <= delta), "EQUIVALENCE").otherwise("INCONCLUSIVE")


def _ap(y: np.ndarray, s: np.ndarray) -> float:
    value, inverse = np.unique(-s, return_inverse=True)
    pos, n = np.bincount(inverse, weights=y), np.bincount(inverse)
    return float((pos * np.cumsum(pos) / np.cumsum(n)).sum() / y.sum())


#: A cluster's replicates need its units on one worker; beyond this many units the frame must be aggregated first.
MAX_BOOTSTRAP_UNITS = 5_000_000


def cluster_bootstrap(df: DataFrame, a: str, b: str, label: str, cluster: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """``replicate, gain``: average precision of ``a`` less that of ``b`` over resampled whole clusters.

    The cohort, a table of scored units of checked size, is sent to all workers; each replicate
    has a seed of its own, and draws without both classes are drawn again, 20 times at most.
    """
    n = df.count()
    if n > MAX_BOOTSTRAP_UNITS:
        raise ValueError(f"{n} units; aggregate them to at most {MAX_BOOTSTRAP_UNITS}")
    rows = df.select(a, b, F.col(label).cast("double").alias("y"), F.col(cluster).cast("string").alias("c")).orderBy("c", a, b, "y").toPandas()
    shared = df.sparkSession.sparkContext.broadcast((rows[a].to_numpy(), rows[b].to_numpy(), rows["y"].to_numpy(), rows["c"].factorize()[0]))

    def run(frames):
        x, z, y, c = shared.value
        order = np.argsort(c, kind="stable")
        head = np.searchsorted(c[order], np.arange(c.max() + 2))
        for frame in frames:
            out = []
            for r in frame["id"]:
                rng = np.random.default_rng([seed, int(r)])
                for _ in range(20):
                    take = np.concatenate([order[head[k] : head[k + 1]] for k in rng.integers(0, c.max() + 1, c.max() + 1)])
                    if 0 < y[take].sum() < len(take):
                        out.append((int(r), _ap(y[take], x[take]) - _ap(y[take], z[take])))
                        break
            yield pd.DataFrame(out, columns=["replicate", "gain"])

    return df.sparkSession.range(0, reps, 1, 8).mapInPandas(run, "replicate bigint, gain double")


def tail_lift(df: DataFrame, a: str, b: str, q: float = 0.05) -> DataFrame:
    """``n, k, overlap, expected, lift`` of the fractional top shares of two scores."""
    from logloom.operators.sampling import top_membership

    n = df.count()
    k = max(1, math.ceil(q * n))
    both = top_membership(top_membership(df, a, k, "__wa"), b, k, "__wb")
    return both.agg(F.sum(F.col("__wa") * F.col("__wb")).alias("overlap")).select(
        F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"), "overlap", F.lit(k * k / n).alias("expected"), (F.col("overlap") / F.lit(k * k / n)).alias("lift")
    )


#: Permutations of the gate's test.
PERMUTATIONS = 2000


def overlap_null(n: int, first: tuple[int, int, float], second: tuple[int, int, float], permutations: int = PERMUTATIONS, seed: int = 42) -> np.ndarray:
    """Overlaps of two fractional top shares whose units are matched at random.

    Each share is (units inside, units at its border, weight of those). A permutation only matters by how many units of each kind
    meet, and those numbers are hypergeometric, so no unit is drawn.
    """
    rng = np.random.default_rng(seed)
    (a1, at, fa), (b1, bt, fb) = first, second
    # of the second share's inner units: how many fall on the first's inner and border units; then the same of its border units
    inner = rng.multivariate_hypergeometric([a1, at, n - a1 - at], b1, permutations, method="marginals")
    border = np.array([rng.multivariate_hypergeometric(left, bt, method="marginals") for left in np.array([a1, at, n - a1 - at]) - inner])
    return inner[:, 0] + fa * inner[:, 1] + fb * (border[:, 0] + fa * border[:, 1])


def tail_gate(df: DataFrame, a: str, b: str, q: float = 0.05, permutations: int = PERMUTATIONS, seed: int = 42) -> dict:
    """``n, k, overlap, expected, lift, p_value, open`` of two scores' top shares: whether their extremes meet more often than by chance."""
    from logloom.operators.sampling import top_membership

    n = df.count()
    k = max(1, math.ceil(q * n))
    both = top_membership(top_membership(df, a, k, "__wa"), b, k, "__wb")
    told = [F.sum(F.col("__wa") * F.col("__wb")).alias("overlap")]
    for w in ("__wa", "__wb"):
        part = (F.col(w) > 0) & (F.col(w) < 1)
        told += [F.count_if(F.col(w) == 1).alias(f"{w}1"), F.count_if(part).alias(f"{w}t"), F.coalesce(F.max(F.when(part, F.col(w))), F.lit(0.0)).alias(f"{w}f")]
    row = both.agg(*told).first()
    null = overlap_null(n, *[(row[f"{w}1"], row[f"{w}t"], row[f"{w}f"]) for w in ("__wa", "__wb")], permutations, seed)
    out = {"n": n, "k": k, "overlap": row["overlap"], "expected": k * k / n, "lift": row["overlap"] / (k * k / n), "p_value": float((1 + (null >= row["overlap"] - 1e-12).sum()) / (1 + permutations))}
    return out | {"open": gate_is_open(out["lift"], out["p_value"])}


def gated_score(p: Column, q: Column, is_open: bool) -> Column:
    """The mean of two tail p-values behind an open gate, the first alone behind a closed one; minus the log."""
    from logloom.operators.fusion import vovk_wang

    return vovk_wang(p, q) if is_open else -F.ln(p)


def paired_gain(df: DataFrame, score: str, against: tuple[str, ...], label: str, cluster: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """``point, ci_low, ci_high, one_sided_p_le_0, replicates`` of a score's average precision less that of the best of some others.

    The best is the one on the whole cohort; the interval is of resampled whole clusters.
    """
    found = {s: ranking_metrics(df, s, label).first()["average_precision"] for s in (score, *against)}
    best = max(against, key=lambda s: found[s])
    return summarize_interval(cluster_bootstrap(df, score, best, label, cluster, reps, seed), "gain", found[score] - found[best])


def evaluate(df: DataFrame, methods: tuple[str, ...], tests: dict[str, tuple[str, tuple[str, ...]]], label: str, cluster: str, budgets: tuple[float, ...] = (0.01, 0.05), reps: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Metrics of each method, and the gain of each test ``name: (score, scores to beat)`` with its interval, Holm's decision and non-inferiority.

    The first frame has ``method, units, positives, average_precision, auroc`` and a recall for each budget.
    """
    unit = "__unit"
    rows = df.select(F.monotonically_increasing_id().alias(unit), label, *methods)
    singles, gains = None, None
    for m in methods:
        told = ranking_metrics(rows, m, label).select(F.lit(m).alias("method"), "units", "positives", "average_precision", "auroc")
        recalls = at_budgets(rows, m, label, unit, budgets).agg(*[F.max(F.when(F.col("budget") == b, F.col("recall"))).alias(f"recall_at_{b:g}") for b in budgets])
        told = told.join(F.broadcast(recalls))
        singles = told if singles is None else singles.unionByName(told)
    for name, (score, against) in tests.items():
        told = paired_gain(df, score, against, label, cluster, reps).select(F.lit(name).alias("test"), "*", (F.col("ci_low") > NONINFERIORITY).alias("noninferior"))
        gains = told if gains is None else gains.unionByName(told)
    return singles, holm(gains, "one_sided_p_le_0") if gains is not None else None


#: A gain whose interval lies above this is no loss.
NONINFERIORITY = -0.02


def parity(recorded: DataFrame, got: DataFrame, key: str, value: str, relative: float = 0.0, absolute: float = 0.0) -> DataFrame:
    """``key, recorded, got, pass``: whether values agree within the larger of two tolerances; what one side lacks fails."""
    both = recorded.select(key, F.col(value).alias("recorded")).join(got.select(key, F.col(value).alias("got")), key, "full")
    near = F.abs(F.col("got") - F.col("recorded")) <= F.greatest(F.abs("recorded") * relative, F.lit(float(absolute)))
    return both.withColumn("pass", F.coalesce(near, F.lit(False)))


def gate_is_open(lift: float, p_value: float, least: float = 2.0, alpha: float = 0.01) -> bool:
    return lift >= least and p_value < alpha


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression with an unpenalised bias by iteratively reweighted least squares."""
    if y.min() == y.max():
        raise ValueError("both classes are needed")
    design = np.hstack([np.ones((len(x), 1)), x])
    ridge = l2 * np.eye(design.shape[1])
    ridge[0, 0] = 0.0
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        eta = np.clip(design @ beta, -30, 30)
        mu = 1 / (1 + np.exp(-eta))
        var = np.maximum(mu * (1 - mu), 1e-12)
        working = design @ beta + (y - mu) / var
        new = np.linalg.solve(design.T @ (design * var[:, None]) + ridge + 1e-9 * np.eye(len(beta)), design.T @ (var * working))
        done, beta = np.abs(new - beta).max() < 1e-8, new
        if done:
            break
    return beta


def crossfit(df: DataFrame, features: list[str], label: str, fold: str, l2: float = 1.0) -> DataFrame:
    """``df`` with ``learned``: scores of a model fitted on the other folds, as minus the log of the tail rank inside the fold.

    A fit needs the sums over a fold only, so the few folds are fitted on the driver's side by
    their design matrices of two or three features; rows are scored by expressions.
    """
    from logloom.operators.fusion import transductive_pvalues

    rows = df.select(fold, F.col(label).cast("double").alias("__y"), *[F.col(f).cast("double") for f in features])
    if rows.count() > MAX_BOOTSTRAP_UNITS:
        raise ValueError("aggregate the units first")
    table = rows.toPandas()
    linear = F.lit(None).cast("double")
    for k in sorted(table[fold].unique().tolist()):
        other = table[table[fold] != k]
        beta = fit_logistic(other[features].to_numpy(), other["__y"].to_numpy(), l2)
        value = sum((F.col(f) * float(w) for f, w in zip(features, beta[1:], strict=True)), F.lit(float(beta[0])))
        linear = F.when(F.col(fold) == k, value).otherwise(linear)
    scored = transductive_pvalues(df.withColumn("__linear", linear), "__linear", (fold,), "__p")
    return scored.withColumn("learned", -F.ln("__p")).drop("__linear", "__p")
