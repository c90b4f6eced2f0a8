"""Queries over scored units: calibration, fusion, metrics, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import fusion, metrics, sampling
from logloom.plans.registry import SCORED, STREAM, one_row, query, read, scored, stream
from logloom.plans.stream_queries import B0, CUTS, b0

R9 = "round({}, 9)"


@query(f"""WITH {STREAM}, r AS (SELECT value AS v FROM s WHERE effective_ts < {CUTS[0]}), t AS (SELECT event_id, value AS v FROM s WHERE effective_ts >= {CUTS[0]}),
d AS (SELECT v, count(*) AS k FROM r GROUP BY 1), n AS (SELECT count(*) AS n FROM r), x AS (SELECT DISTINCT v FROM t),
y AS (SELECT v, coalesce((SELECT sum(k) FROM d WHERE d.v > x.v), 0) AS above, coalesce((SELECT sum(k) FROM d WHERE d.v = x.v), 0) AS eq FROM x)
SELECT event_id, round((1 + above + 0.5 * eq) / (n + 1), 9) AS p FROM t JOIN y USING (v), n""")
def tail_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir, False)
    early, late = s.where(F.col("effective_ts") < CUTS[0]), s.where(F.col("effective_ts") >= CUTS[0])
    return fusion.tail_pvalues(early, late, "value").select("event_id", F.round("p", 9).alias("p"))


@query(f"""WITH {B0}, r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY markov DESC) - 1 AS above, count(*) OVER (PARTITION BY event_type, markov) AS eq, count(*) OVER (PARTITION BY event_type) AS n
  FROM (SELECT event_id, event_type, round(markov, 9) AS markov FROM sc))
SELECT event_id, round((1 + above + 0.5 * (eq - 1)) / n, 9) AS p FROM r""")
def transductive_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b0(spark, sf_dir).withColumn("markov", F.round("markov", 9))
    return fusion.transductive_pvalues(s, "markov", ("event_type",)).select("event_id", F.round("p", 9).alias("p"))


PAIRS = f"""{SCORED},
pa AS (SELECT *, (rank() OVER (ORDER BY a DESC) + 0.5 * (count(*) OVER (PARTITION BY a) - 1)) / count(*) OVER () AS p,
          (rank() OVER (ORDER BY b DESC) + 0.5 * (count(*) OVER (PARTITION BY b) - 1)) / count(*) OVER () AS q FROM u)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.transductive_pvalues(fusion.transductive_pvalues(scored(spark, sf_dir), "a", name="p"), "b", name="q")


def _rule(name: str, sql: str, build) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("doc_id", F.round(build(F.col("p"), F.col("q")), 7).alias("score"))

    run.__name__ = name
    query(f"WITH {PAIRS} SELECT doc_id, round({sql}, 7) AS score FROM pa" if sql else None)(run)


_rule("fuse_vovk_wang", "-ln((p + q) / 2)", fusion.vovk_wang)
_rule("vovk_wang_pvalue", "least(1.0, p + q)", fusion.vovk_wang_pvalue)
_rule("fuse_bonferroni", "-ln(least(1.0, 2 * least(p, q)))", fusion.bonferroni)
_rule("fuse_cauchy", "0.5 * (tan((0.5 - greatest(1e-12, least(1 - 1e-12, p))) * pi()) + tan((0.5 - greatest(1e-12, least(1 - 1e-12, q))) * pi()))", fusion.cauchy)
_rule("fuse_fisher", "-ln(p) - ln(q)", fusion.fisher)


def _quantile_sql(p: str) -> str:
    """The normal quantile in SQL, by the same approximation."""

    def poly(c: tuple[float, ...], x: str) -> str:
        out = f"({c[0]!r}::DOUBLE)"
        for k in c[1:]:
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    x = f"greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, {p}))"
    low, high, q = f"sqrt(-2 * ln({x}))", f"sqrt(-2 * ln(1 - {x}))", f"({x} - 0.5::DOUBLE)"
    tail = lambda t: f"{poly(fusion._TAIL, t)} / {poly((*fusion._TAIL_D, 1.0), t)}"
    middle = f"{poly(fusion._MID, f'({q} * {q})')} * {q} / {poly((*fusion._MID_D, 1.0), f'({q} * {q})')}"
    return f"CASE WHEN {x} < 0.02425::DOUBLE THEN {tail(low)} WHEN {x} > (1 - 0.02425::DOUBLE) THEN -({tail(high)}) ELSE {middle} END"


GAUSS = f"{PAIRS}, gz AS (SELECT *, {_quantile_sql('(1 - p)')} AS gp, {_quantile_sql('(1 - q)')} AS gq FROM pa)"


@query(f"WITH {GAUSS} SELECT doc_id, round((gp + gq) / sqrt(2), 6) AS score FROM gz")
def fuse_stouffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", F.round(fusion.stouffer(F.col("p"), F.col("q")), 6).alias("score"))


@query(f"""WITH {PAIRS} SELECT doc_id, round(-(0.5 * ln(p) + 0.5 * ln(q)), 7) AS geometric, round(-ln(greatest(p, q)), 7) AS largest, round(-ln(least(p, q)), 7) AS smallest,
  round(-ln((0.5 + 1e-12) / p + (0.5 + 1e-12) / q) / -1, 7) AS harmonic, round(-ln((0.3 + 1e-12) * pow(p, 2) + (0.7 + 1e-12) * pow(q, 2)) / 2, 7) AS square, round(-ln(p), 7) AS first FROM pa""")
def fuse_generalized_mean_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lambda r, w=0.5: F.round(fusion.generalized_mean(F.col("p"), F.col("q"), r, w), 7)
    inf = float("inf")
    return _pairs(spark, sf_dir).select(
        "doc_id", g(0.0).alias("geometric"), g(inf).alias("largest"), g(-inf).alias("smallest"), g(-1.0).alias("harmonic"), g(2.0, 0.3).alias("square"), g(1.0, 1.0).alias("first")
    )


@query(f"WITH {SCORED}, m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM u WHERE quality = 1) SELECT doc_id, round(((a - ma) / sa + (b - mb) / sb) / 2, 7) AS score FROM u, m")
def fuse_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = scored(spark, sf_dir)
    m = u.where("quality = 1").agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b")).first()
    return u.select("doc_id", F.round(fusion.zscore_mean(u, {"a": (m[0], m[1]), "b": (m[2], m[3])}), 7).alias("score"))


@query(f"""WITH {GAUSS}, rh AS (SELECT greatest(-0.95::DOUBLE, least(0.95::DOUBLE, coalesce(corr(gp, gq), 0))) AS r FROM gz), w AS (SELECT doc_id, greatest(gp, 0) AS x, greatest(gq, 0) AS y FROM gz)
SELECT doc_id, round((x * x - x * y * (2 * r) + y * y) / (1 - r * r), 6) AS score FROM w, rh""")
def fuse_copula(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    rho = fusion.copula_correlation(p, "p", "q")
    return p.select("doc_id", F.round(fusion.copula(F.col("p"), F.col("q"), rho), 6).alias("score"))


@query()
def fuse_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_pairs(spark, sf_dir).select("doc_id", "p", "q"), "p", "q")


AP = """{0}d AS (SELECT {1} AS sc, count(*) AS n, sum(toxic)::BIGINT AS pos FROM u GROUP BY 1),
{0}c AS (SELECT *, sum(n) OVER (ORDER BY sc DESC) AS nu, sum(pos) OVER (ORDER BY sc DESC) AS tu FROM {0}d),
{0}m AS (SELECT sum(n) AS n, sum(pos) AS p, sum(pos * tu / nu) / sum(pos) AS ap FROM {0}c),
{0}r AS (SELECT sum(pos * ((m.n - m.p) - (nu - tu) + (c.n - pos) / 2.0)) / max(m.p * (m.n - m.p)) AS auroc FROM {0}c c, {0}m m)"""


@query(f"WITH {SCORED}, {AP.format('x', 'a')} SELECT round(ap, 9) AS average_precision FROM xm")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(scored(spark, sf_dir), "a", "toxic").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {SCORED}, {AP.format('x', 'b')} SELECT round(auroc, 9) AS auroc FROM xr")
def auroc_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(scored(spark, sf_dir), "b", "toxic").select(F.round("auroc", 9).alias("auroc"))


BUDGETS = (0.01, 0.05, 0.1)


@query(f"""WITH {SCORED}, g AS (SELECT *, row_number() OVER (ORDER BY a DESC, doc_id) AS r, count(*) OVER () AS n, sum(toxic) OVER () AS p FROM u), b(budget) AS (VALUES (0.01), (0.05), (0.1))
SELECT CAST(budget AS DOUBLE) AS budget, count(*) AS flagged, round(sum(toxic) / max(p), 9) AS recall, round(sum(toxic) / count(*), 9) AS "precision", round((count(*) - sum(toxic)) / (max(n) - max(p)), 9) AS fpr
FROM g, b WHERE r <= greatest(1, ceil(CAST(budget AS DOUBLE) * n)) GROUP BY 1""")
def recall_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.at_budgets(scored(spark, sf_dir), "a", "toxic", "doc_id", BUDGETS)
    return m.select("budget", "flagged", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "fpr")])


@query(f"""WITH {SCORED}, {AP.format('x', 'a')}, {AP.format('y', 'b')} SELECT 'a' AS method, CAST(xm.n AS BIGINT) AS units, CAST(xm.p AS BIGINT) AS positives, round(ap, 9) AS ap, round(auroc, 9) AS auroc FROM xm, xr
UNION ALL SELECT 'b', CAST(ym.n AS BIGINT), CAST(ym.p AS BIGINT), round(ap, 9), round(auroc, 9) FROM ym, yr""")
def single_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = scored(spark, sf_dir)
    one = lambda s: metrics.ranking_metrics(u, s, "toxic").select(F.lit(s).alias("method"), "units", "positives", F.round("average_precision", 9).alias("ap"), F.round("auroc", 9).alias("auroc"))
    return one("a").unionByName(one("b"))


@query(f"""WITH {SCORED}, f AS (SELECT *, -ln((p + q) / 2) AS fused FROM ({PAIRS.split('pa AS (', 1)[1].strip().removesuffix(')')})),
z AS (SELECT 'a' AS m, a AS sc, toxic FROM f UNION ALL SELECT 'b', b, toxic FROM f UNION ALL SELECT 'f', round(fused, 12), toxic FROM f),
d AS (SELECT m, sc, count(*) AS n, sum(toxic) AS pos FROM z GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY m ORDER BY sc DESC) AS nu, sum(pos) OVER (PARTITION BY m ORDER BY sc DESC) AS tu FROM d),
ap AS (SELECT m, sum(pos * tu / nu) / sum(pos) AS ap FROM c GROUP BY 1)
SELECT round((SELECT ap FROM ap WHERE m = 'f') - (SELECT max(ap) FROM ap WHERE m <> 'f'), 9) AS gain""")
def gain_over_best_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).withColumn("f", F.round(fusion.vovk_wang(F.col("p"), F.col("q")), 12))
    one = lambda s, n: metrics.ranking_metrics(p, s, "toxic").select(F.col("average_precision").alias(n))
    return one("f", "f").join(one("a", "a")).join(one("b", "b")).select(F.round(F.col("f") - F.greatest("a", "b"), 9).alias("gain"))


@query(f"""WITH {SCORED}, d AS (SELECT lang AS source, a AS sc, count(*) AS n, sum(toxic) AS pos FROM u GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY sc DESC) AS nu, sum(pos) OVER (PARTITION BY source ORDER BY sc DESC) AS tu, sum(pos) OVER (PARTITION BY source) AS p FROM d),
r AS (SELECT *, 2.0 * tu / (nu + p) AS f1, row_number() OVER (PARTITION BY source ORDER BY 2.0 * tu / (nu + p) DESC, sc DESC) AS k FROM c WHERE p > 0)
SELECT source, sc AS threshold, round(f1, 9) AS f1, round(tu / nu, 9) AS "precision", round(tu / p, 9) AS recall FROM r WHERE k = 1""")
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.best_f1(scored(spark, sf_dir), "a", "toxic", "lang")
    return m.select("source", "threshold", *[F.round(c, 9).alias(c) for c in ("f1", "precision", "recall")])


@query(f"""WITH {SCORED}, r AS (SELECT toxic, rank() OVER (PARTITION BY toxic ORDER BY a) + (count(*) OVER (PARTITION BY toxic, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY toxic ORDER BY b) + (count(*) OVER (PARTITION BY toxic, b) - 1) / 2.0 AS rb FROM u)
SELECT toxic, count(*) AS units, round(corr(ra, rb), 9) AS spearman FROM r GROUP BY 1""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(scored(spark, sf_dir), "a", "b", "toxic").select("toxic", "units", F.round("spearman", 9).alias("spearman"))


@query(f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (ORDER BY a DESC, doc_id) <= 40 AS x, row_number() OVER (ORDER BY b DESC, doc_id) <= 40 AS y FROM u)
SELECT round(count(*) FILTER (x AND y) / count(*) FILTER (x OR y), 9) AS jaccard, count(*) FILTER (toxic = 1 AND x AND NOT y) AS only_a, count(*) FILTER (toxic = 1 AND y AND NOT x) AS only_b,
  count(*) FILTER (toxic = 1 AND x AND y) AS both, count(*) FILTER (toxic = 1 AND NOT x AND NOT y) AS neither FROM k""")
def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.operators.ordering import global_rank

    u = scored(spark, sf_dir)
    for s in "ab":
        u = global_rank(u, -F.col(s), F.col("doc_id").asc(), name=f"r{s}")
    return metrics.overlap(u.withColumn("x", F.col("ra") < 40).withColumn("y", F.col("rb") < 40), "x", "y", "toxic").withColumn("jaccard", F.round("jaccard", 9))


@query("""WITH t AS (SELECT lang, count(*) AS n, sum(toxic) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT lang, round(1.0 / (1 + k), 9) AS p FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY p, lang) AS i, count(*) OVER () AS n FROM p), h AS (SELECT *, 0.05::DOUBLE / (n - i + 1) AS threshold FROM r)
SELECT lang, p, threshold, bool_and(p <= threshold) OVER (ORDER BY i) AS rejected FROM h""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scored(spark, sf_dir).groupBy("lang").agg(F.sum("toxic").alias("k")).select("lang", F.round(F.lit(1.0) / (1 + F.col("k")), 9).alias("p"))
    return metrics.holm(t, "p")


@query(f"""WITH {SCORED}, n AS (SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS q FROM u),
v AS (SELECT x.toxic, avg(CASE WHEN x.toxic = 1 THEN (x.a > y.a)::INT + 0.5 * (x.a = y.a)::INT ELSE (y.a > x.a)::INT + 0.5 * (x.a = y.a)::INT END) AS va,
        avg(CASE WHEN x.toxic = 1 THEN (x.b > y.b)::INT + 0.5 * (x.b = y.b)::INT ELSE (y.b > x.b)::INT + 0.5 * (x.b = y.b)::INT END) AS vb
      FROM u x JOIN u y ON x.toxic <> y.toxic GROUP BY x.doc_id, x.toxic),
s AS (SELECT toxic, var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb) AS v, avg(va) - avg(vb) AS d FROM v GROUP BY 1)
SELECT round(max(d) FILTER (toxic = 1), 9) AS delta_auroc, round(max(d) FILTER (toxic = 1) / sqrt(sum(v / CASE WHEN toxic = 1 THEN p ELSE q END)), 7) AS z FROM s, n""")
def delong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.delong(scored(spark, sf_dir), "a", "b", "toxic").select(F.round("delta_auroc", 9).alias("delta_auroc"), F.round("z", 7).alias("z"))


TOP = f"""{SCORED}, n AS (SELECT count(*) AS n, greatest(1, ceil(0.05::DOUBLE * count(*)))::BIGINT AS k FROM u),
r AS (SELECT doc_id, rank() OVER (ORDER BY a DESC) - 1 AS ra, count(*) OVER (PARTITION BY a) AS ca, rank() OVER (ORDER BY b DESC) - 1 AS rb, count(*) OVER (PARTITION BY b) AS cb FROM u),
w AS (SELECT doc_id, CASE WHEN ra + ca <= k THEN 1.0 WHEN ra < k THEN (k - ra) / ca ELSE 0.0 END AS wa, CASE WHEN rb + cb <= k THEN 1.0 WHEN rb < k THEN (k - rb) / cb ELSE 0.0 END AS wb FROM r, n)"""


@query(f"WITH {TOP} SELECT doc_id, CAST(round(wb, 9) AS DOUBLE) AS weight FROM w")
def fractional_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    u = scored(spark, sf_dir)
    k = max(1, math.ceil(0.05 * u.count()))
    return sampling.top_membership(u, "b", k).select("doc_id", F.round("weight", 9).alias("weight"))


@query(f"WITH {TOP} SELECT n, k, round(sum(wa * wb), 9) AS overlap, round(max(k * k / n), 9) AS expected, round(sum(wa * wb) / max(k * k / n), 9) AS lift FROM w, n GROUP BY n, k")
def tail_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.tail_lift(scored(spark, sf_dir), "a", "b")
    return m.select("n", "k", *[F.round(c, 9).alias(c) for c in ("overlap", "expected", "lift")])


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cluster_bootstrap(scored(spark, sf_dir), "a", "b", "toxic", "source", reps=500)


@query()
def crossfit_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _pairs(spark, sf_dir).withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)).cast("int"))
    logs = u.withColumn("x", -F.ln("p")).withColumn("y", -F.ln("q"))
    return metrics.crossfit(logs, ["x", "y"], "toxic", "fold").select("doc_id", "fold", "learned")


@query("""WITH v AS (SELECT value - 50 AS x FROM events) SELECT 1.5::DOUBLE AS point, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high,
  round((count(*) FILTER (x <= 0) + 1) / (count(*) + 1), 9) AS one_sided_p_le_0, count(*) AS replicates FROM v""")
def summarize_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "events").select((F.col("value") - 50).alias("x"))
    return metrics.summarize_interval(v, "x", 1.5).withColumn("one_sided_p_le_0", F.round("one_sided_p_le_0", 9))


@query("""WITH t AS (SELECT quality, count(*) AS n, sum(toxic) AS k FROM labels GROUP BY 1), a AS (SELECT n AS n1, k AS k1 FROM t WHERE quality = 1), b AS (SELECT n AS n2, k AS k2 FROM t WHERE quality = 0),
z AS (SELECT 1.959963984540054::DOUBLE AS z), w AS (SELECT k1 / n1 AS p1, k2 / n2 AS p2, n1, n2, z FROM a, b, z),
i AS (SELECT p1, p2, (p1 + z * z / (2 * n1)) / (1 + z * z / n1) AS c1, z * sqrt(p1 * (1 - p1) / n1 + z * z / (4.0 * n1 * n1)) / (1 + z * z / n1) AS h1,
        (p2 + z * z / (2 * n2)) / (1 + z * z / n2) AS c2, z * sqrt(p2 * (1 - p2) / n2 + z * z / (4.0 * n2 * n2)) / (1 + z * z / n2) AS h2 FROM w)
SELECT round(p1 - p2, 9) AS difference, round(p1 - p2 - sqrt(pow(p1 - (c1 - h1), 2) + pow(c2 + h2 - p2, 2)), 9) AS low, round(p1 - p2 + sqrt(pow(c1 + h1 - p1, 2) + pow(p2 - (c2 - h2), 2)), 9) AS high,
  round(c1 - h1, 9) AS wilson_low, round(c1 + h1, 9) AS wilson_high, round(p1 / p2, 9) AS ratio FROM i""")
def wilson_newcombe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "labels").agg(
        F.count_if(F.col("quality") == 1).alias("n1"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("k1"),
        F.count_if(F.col("quality") == 0).alias("n2"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("k2"),
    )
    c = F.col
    d, low, high = metrics.newcombe(c("k1"), c("n1"), c("k2"), c("n2"))
    a, b = metrics.wilson(c("k1"), c("n1"))
    ratio = F.try_divide(c("k1") / c("n1"), c("k2") / c("n2"))
    return t.select(*[F.round(x, 9).alias(n) for n, x in (("difference", d), ("low", low), ("high", high), ("wilson_low", a), ("wilson_high", b), ("ratio", ratio))])


@query("""WITH t AS (SELECT lang, avg(CAST(toxic AS DOUBLE)) - 0.12 AS m, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), i AS (SELECT lang, m, m - 1 / sqrt(n) AS lo, m + 1 / sqrt(n) AS hi FROM t)
SELECT lang, CASE WHEN lo > 0.01 THEN 'GAIN' WHEN hi < -0.01 THEN 'HARM' WHEN lo >= -0.01 AND hi <= 0.01 THEN 'EQUIVALENCE' ELSE 'INCONCLUSIVE' END AS region FROM i""")
def decision_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scored(spark, sf_dir).groupBy("lang").agg((F.avg(F.col("toxic").cast("double")) - 0.12).alias("m"), (1 / F.sqrt(F.count("*"))).alias("h"))
    return t.select("lang", metrics.decision(F.col("m"), F.col("m") - F.col("h"), F.col("m") + F.col("h")).alias("region"))


GRID = {f"r={r:g}|w={w:g}": (r, w) for r in (1.0, 0.0, -1.0, -4.0, float("-inf")) for w in (0.3, 0.5, 0.8)}


def _mean_sql(r: float, w: float) -> str:
    if r == 0:
        return f"-({w} * ln(p) + {1 - w!r} * ln(q))"
    if r == float("-inf"):
        return "-ln(least(p, q))"
    return f"-ln(({w} + 1e-12) * pow(p, {r}) + ({1 - w!r} + 1e-12) * pow(q, {r})) / {r}"


@query(f"""WITH {SCORED}, pl AS (SELECT *, (rank() OVER (PARTITION BY lang ORDER BY a DESC) + 0.5 * (count(*) OVER (PARTITION BY lang, a) - 1)) / count(*) OVER (PARTITION BY lang) AS p,
          (rank() OVER (PARTITION BY lang ORDER BY b DESC) + 0.5 * (count(*) OVER (PARTITION BY lang, b) - 1)) / count(*) OVER (PARTITION BY lang) AS q FROM u),
z AS ({" UNION ALL ".join(f"SELECT lang, '{n}' AS config, round({_mean_sql(*k)}, 9) AS sc, toxic FROM pl" for n, k in GRID.items())} UNION ALL SELECT lang, 'a', a, toxic FROM pl UNION ALL SELECT lang, 'b', b, toxic FROM pl),
d AS (SELECT lang, config, sc, count(*) AS n, sum(toxic) AS pos FROM z GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY lang, config ORDER BY sc DESC) AS nu, sum(pos) OVER (PARTITION BY lang, config ORDER BY sc DESC) AS tu FROM d),
ap AS (SELECT lang, config, sum(pos * tu / nu) / sum(pos) AS ap FROM c GROUP BY ALL HAVING sum(pos) > 0 AND sum(pos) < sum(n)),
g AS (SELECT config, ap - best AS gain FROM ap JOIN (SELECT lang, max(ap) AS best FROM ap WHERE config IN ('a', 'b') GROUP BY 1) USING (lang) WHERE config NOT IN ('a', 'b')),
s AS (SELECT config, min(gain) AS worst, avg(gain) AS mean, max(gain) AS top FROM g GROUP BY 1)
SELECT config, round(worst, 7) AS worst, round(mean, 7) AS mean, worst >= -0.02 AND top > 0 AS qualifies, row_number() OVER (ORDER BY round(worst, 9) DESC, round(mean, 9) DESC, config) AS place FROM s""")
def config_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and weights of the generalised mean by their worst gain over the better score, with languages as the systems."""
    by = ("lang",)
    p = fusion.transductive_pvalues(fusion.transductive_pvalues(scored(spark, sf_dir), "a", by, "p"), "b", by, "q")
    grid = {n: F.round(fusion.generalized_mean(F.col("p"), F.col("q"), r, w), 9) for n, (r, w) in GRID.items()}
    ranked = metrics.rank_configurations(p, grid, ("a", "b"), "toxic", "lang")
    return ranked.select("config", F.round("worst", 7).alias("worst"), F.round("mean", 7).alias("mean"), "qualifies", "place")


@query(f"""WITH {STREAM}, m AS (SELECT unit, event_type AS seed, CASE WHEN max(value) > 60 THEN NULL ELSE avg(value) END AS nll FROM s GROUP BY ALL)
SELECT unit, round(avg(nll), 9) AS mean, max(nll) AS max, count(nll) AS masks, CASE WHEN count(nll) = 0 THEN 'ABSTAIN' ELSE 'OK' END AS status FROM m GROUP BY 1""")
def multi_mask_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and maximum over masks; a unit abstains only if every mask does."""
    m = stream(spark, sf_dir, False).groupBy("unit", "event_type").agg(F.when(F.max("value") <= 60, F.avg("value")).alias("nll"))
    return m.groupBy("unit").agg(F.round(F.avg("nll"), 9).alias("mean"), F.max("nll").alias("max"), F.count("nll").alias("masks"), F.when(F.count("nll") == 0, "ABSTAIN").otherwise("OK").alias("status"))


@query(f"""WITH {SCORED}, m AS (SELECT median(a) AS m FROM u WHERE quality = 1), x AS (SELECT doc_id, CASE WHEN quality = 1 THEN a END AS v FROM u) SELECT doc_id, coalesce(v, m, 0.0) AS score, v IS NULL AS imputed FROM x, m""")
def score_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units without a score get the cohort's median, or 0 where there is none."""
    u = scored(spark, sf_dir).withColumn("v", F.when(F.col("quality") == 1, F.col("a")))
    m = u.agg(F.median("v").alias("m"))
    return u.join(F.broadcast(m)).select("doc_id", F.coalesce("v", "m", F.lit(0.0)).alias("score"), F.col("v").isNull().alias("imputed"))


@query(f"WITH {SCORED}, s AS (SELECT lang, avg(b) AS nll FROM u GROUP BY 1) SELECT round(avg(nll), 9) AS mean_of_sources, round((SELECT avg(b) FROM u), 9) AS mean_of_units, round(exp(least(avg(nll), 700)), 9) AS perplexity FROM s")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over sources and the mean over units are different numbers; perplexity is of the former."""
    u = scored(spark, sf_dir)
    s = u.groupBy("lang").agg(F.avg("b").alias("nll"))
    return s.agg(F.round(F.avg("nll"), 9).alias("mean_of_sources"), F.round(F.exp(F.least(F.avg("nll"), F.lit(700.0))), 9).alias("perplexity")).join(u.agg(F.round(F.avg("b"), 9).alias("mean_of_units")))


@query("""WITH w AS (SELECT doc_id, unnest(z) AS word, unnest(range(1, len(z) + 1)) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS z FROM documents)),
r AS (SELECT doc_id, pos, word, row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, pos) AS k FROM w)
SELECT doc_id, string_agg(word, '|' ORDER BY k) AS words FROM r WHERE k <= 5 GROUP BY 1""")
def token_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest words of each document, earlier ones first: localisation of the tokens with the highest scores."""
    scored_ = F.transform(F.split("text", " ", -1), lambda w, i: F.struct((-F.length(w)).alias("s"), i.alias("i"), w.alias("w")))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(F.sort_array(scored_), 1, 5)["w"], "|").alias("words"))


@query()
def rule_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenarios, two seeds each: the rules' gains on made scores of two experts. It reads no table."""
    from logloom.operators import simulate

    return simulate.rule_gains(simulate.experts(spark, 2))


@query()
def tail_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label-free gate of two scores; its p-value is of random matchings, so SQL has no equal."""
    found = metrics.tail_gate(scored(spark, sf_dir), "a", "b")
    return spark.createDataFrame([found], "n long, k long, overlap double, expected double, lift double, p_value double, open boolean")


@query()
def gated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    opened = metrics.tail_gate(p, "a", "b")["open"]
    return p.select("doc_id", metrics.gated_score(F.col("p"), F.col("q"), opened).alias("score"))


@query(f"""WITH {SCORED}, {AP.format('x', 'a')}, {AP.format('y', 'b')},
g AS (SELECT toxic, row_number() OVER (ORDER BY a DESC, doc_id) AS ra, row_number() OVER (ORDER BY b DESC, doc_id) AS rb, count(*) OVER () AS n, sum(toxic) OVER () AS p FROM u)
SELECT 'a' AS method, round(max(xm.ap), 9) AS average_precision, round(max(xr.auroc), 9) AS auroc, round((SELECT sum(toxic) FROM g WHERE ra <= ceil(0.05::DOUBLE * n)) / (SELECT max(p) FROM g), 9) AS recall_at_5 FROM xm, xr
UNION ALL SELECT 'b', round(max(ym.ap), 9), round(max(yr.auroc), 9), round((SELECT sum(toxic) FROM g WHERE rb <= ceil(0.05::DOUBLE * n)) / (SELECT max(p) FROM g), 9) FROM ym, yr""")
def evaluation_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each method of an evaluation, as its report has them."""
    u = scored(spark, sf_dir).orderBy("doc_id").coalesce(1)  # ties of a few labelled units go by document
    singles, _ = metrics.evaluate(u, ("a", "b"), {}, "toxic", "source", (0.05,))
    return singles.select("method", F.round("average_precision", 9).alias("average_precision"), F.round("auroc", 9).alias("auroc"), F.round(F.col("`recall_at_0.05`"), 9).alias("recall_at_5"))


@query()
def evaluation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains with intervals of resampled sources, Holm's decision and non-inferiority."""
    f = _pairs(spark, sf_dir).withColumn("vw", fusion.vovk_wang(F.col("p"), F.col("q"))).withColumn("cauchy", fusion.cauchy(F.col("p"), F.col("q")))
    _, tests = metrics.evaluate(f.select("a", "b", "vw", "cauchy", "toxic", "source"), ("vw",), {"H1": ("vw", ("a", "b")), "H4": ("cauchy", ("a",))}, "toxic", "source", reps=300)
    return tests


@query("""WITH a AS (SELECT lang, avg(n_chars) AS r, avg(n_chars) + CASE WHEN lang = 'en' THEN 5 ELSE 0.0001 END AS g FROM documents GROUP BY 1)
SELECT lang, round(r, 6) AS recorded, round(CASE WHEN lang <> 'es' THEN g END, 6) AS got, coalesce(lang <> 'es' AND abs(g - r) <= greatest(1e-5 * abs(r), 0.001), false) AS pass FROM a""")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded values against values with an error each, one of them missing."""
    a = read(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("v"))
    b = a.where("lang <> 'es'").select("lang", (F.col("v") + F.when(F.col("lang") == "en", 5).otherwise(0.0001)).alias("v"))
    out = metrics.parity(a, b, "lang", "v", 1e-5, 0.001)
    return out.select("lang", F.round("recorded", 6).alias("recorded"), F.round("got", 6).alias("got"), "pass")
