"""Queries over the event stream: order, segments, windows, units, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import identity
from logloom.operators import chronology, detect, governance, graph, metrics, sampling, templates, windows
from logloom.operators.ordering import global_rank, previous
from logloom.plans.registry import STREAM, query, read, stream

DAY = 86_400_000_000
#: Cuts of the tests on events: literal times, so that both sides cut alike.
CUTS = tuple(1704067200_000_000 + int(d * DAY) for d in (15.0, 16.5, 21.0))
LONG = "CAST({} AS BIGINT)"


@query(f"WITH {STREAM} SELECT event_id, rank, effective_ts FROM s")
def stream_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).select("event_id", "rank", "effective_ts")


@query("""
SELECT event_id, CAST(coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS effective_ts
FROM (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) END AS t FROM events)""")
def effective_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, False).withColumn("t", F.when(F.col("event_type") != "error", F.col("effective_ts"))).drop("effective_ts")
    return chronology.effective_timestamp(e, "t", "user_id", "event_id").select("event_id", "effective_ts")


@query("""
SELECT o_orderpriority AS file, count(*) AS lines, count(*) FILTER (o_orderdate < above) AS inversions
FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS above FROM orders) GROUP BY 1""")
def inversion_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronology.inversions(read(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", "o_orderkey").withColumnRenamed("o_orderpriority", "file")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).withColumn("group", F.col("user_id").cast("string"))
    return windows.context_windows(s, "group", "message", F.lit("EVENTS"), F.lit("ALL"))


WINDOWS = f"""{STREAM},
w AS (SELECT event_id, rank, effective_ts, message, CAST(user_id AS VARCHAR) AS grp,
        list(rank) OVER f AS cr, list(message) OVER f AS cm, list(effective_ts) OVER f AS ct
      FROM s WINDOW f AS (PARTITION BY user_id ORDER BY rank ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 'win-' || sha256('EVENTS|ALL|' || CAST(rank AS VARCHAR)) AS window_id, 'seq-' || substr(sha256('EVENTS|ALL|' || grp), 1, 24) AS sequence_id,
        substr(sha256(array_to_string(cm, ',') || '|' || message), 1, 32) AS dedupe_key FROM w WHERE len(cr) > 0)"""


@query(f"""WITH {WINDOWS}
SELECT window_id, sequence_id, rank AS target_rank, array_to_string(cr, ',') AS context, CAST(len(cr) AS BIGINT) AS context_record_count,
       effective_ts AS target_effective_ts, ct[-1] AS context_last_effective_ts, dedupe_key FROM c""")
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    return w.select(
        "window_id", "sequence_id", "target_rank", F.array_join(F.col("context_ranks").cast("array<string>"), ",").alias("context"),
        "context_record_count", "target_effective_ts", "context_last_effective_ts", "dedupe_key",
    )


@query(f"""WITH {WINDOWS}
SELECT count(*) AS windows, count(DISTINCT dedupe_key) AS distinct_windows,
       count(*) FILTER (list_max(cr) < rank AND ct[-1] <= effective_ts) AS causal FROM c""")
def causal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    return w.agg(F.count("*").alias("windows"), F.count_distinct("dedupe_key").alias("distinct_windows"), F.count_if(windows.causal(w)).alias("causal"))


@query(f"""WITH {STREAM},
w AS (SELECT event_type, rank, count(*) OVER (PARTITION BY event_type, user_id ORDER BY rank ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS n FROM s),
h AS (SELECT event_type, rank, n, count(*) OVER (PARTITION BY event_type) AS eligible,
        row_number() OVER (PARTITION BY event_type ORDER BY sha256('P2.2-v1|' || event_type || '|' || CAST(rank AS VARCHAR)), rank) AS place FROM w WHERE n > 0)
SELECT event_type AS architecture, rank AS target_rank, eligible, n AS context_record_count FROM h WHERE place <= 50""")
def topk_hash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).withColumn("group", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
    w = windows.context_windows(s, "group", "message", F.col("event_type"), F.lit("ALL")).withColumn("architecture", F.substring_index("group", "|", 1))
    out = windows.bounded_candidates(w, ["architecture"], 50)
    return out.select("architecture", "target_rank", "eligible", "context_record_count")


@query(f"""WITH {STREAM}, b AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY rank) AS previous, event_type AS message FROM s)
SELECT previous, message, count(*) AS n FROM b WHERE previous IS NOT NULL GROUP BY ALL""")
def prev_event_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = detect.Baseline(stream(spark, sf_dir), "user_id", "rank", "event_type")
    return base.transitions.withColumnRenamed("c2", "n")


UNITS = f"{STREAM}, un AS (SELECT unit, min(effective_ts) AS first, max(effective_ts) AS last, count(*) AS records FROM s GROUP BY 1)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronology.spans(stream(spark, sf_dir, False), "unit", "effective_ts")


def _seg(t: str) -> str:
    return f"CASE WHEN {t} < {CUTS[0]} THEN 0 WHEN {t} < {CUTS[1]} THEN 1 WHEN {t} < {CUTS[2]} THEN 2 ELSE 3 END"


STRADDLES = " OR ".join(f"(first < {c} AND last >= {c})" for c in CUTS)
SEGMENTED = f"""{UNITS},
g AS (SELECT unit, CASE WHEN {STRADDLES} THEN 255 ELSE {_seg("last")} END AS gs FROM un),
seg AS (SELECT s.*, coalesce(gs, {_seg("effective_ts")}) AS segment FROM s LEFT JOIN g USING (unit))"""


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with the segments of the literal cuts."""
    return chronology.assign_segments(stream(spark, sf_dir), _units(spark, sf_dir), CUTS)


@query(f"WITH {UNITS} SELECT unit, first, last, records FROM un")
def unit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir)


@query(f"WITH {SEGMENTED} SELECT event_id, CAST(segment AS SMALLINT) AS segment FROM seg")
def segment_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(spark, sf_dir).select("event_id", "segment")


@query(f"""WITH {SEGMENTED}, n(segment, name) AS (VALUES (0, 'EARLY'), (1, 'GUARD'), (2, 'MID'), (3, 'LATE'), (255, 'EXCLUDED')),
a AS (SELECT segment, count(*) AS records, min(effective_ts) AS first_ts, max(effective_ts) AS last_ts, count(DISTINCT message) AS messages FROM seg GROUP BY 1)
SELECT segment, name, coalesce(records, 0) AS records, first_ts, last_ts, coalesce(messages, 0) AS messages FROM n LEFT JOIN a USING (segment)""")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronology.segment_summary(segmented(spark, sf_dir))


@query(f"""WITH {SEGMENTED}, p AS (
  SELECT segment, 'big' AS field, (CASE WHEN value > 50 THEN value END) IS NOT NULL AS there FROM seg UNION ALL
  SELECT segment, 'signup', event_type = 'signup' FROM seg)
SELECT segment, field, count(*) FILTER (there) AS present, round(avg(CAST(there AS INTEGER)), 6) AS ratio FROM p GROUP BY ALL""")
def segment_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segmented(spark, sf_dir).withColumn("big", F.when(F.col("value") > 50, F.col("value"))).withColumn("signup", F.when(F.col("event_type") == "signup", 1))
    return chronology.field_coverage(s, ["big", "signup"])


@query(f"""WITH {SEGMENTED},
r AS (SELECT unit, count(DISTINCT {_seg("effective_ts")}) AS k, count(*) AS n FROM s GROUP BY 1)
SELECT count(*) AS units, count(*) FILTER (k > 1) AS straddling, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS records FROM r""")
def unit_straddle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir, False).withColumn("own", chronology.segment_of(F.col("effective_ts"), CUTS))
    per = s.groupBy("unit").agg(F.count_distinct("own").alias("k"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("units"), F.count_if(F.col("k") > 1).alias("straddling"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("records"))


QUIET = f"""{UNITS},
o AS (SELECT *, max(last) OVER (ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM un),
i AS (SELECT *, sum(CASE WHEN e IS NULL OR first > e THEN 1 ELSE 0 END) OVER (ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS k FROM o),
q AS (SELECT max(last) + 1 AS instant FROM i GROUP BY k)"""


@query(f"WITH {QUIET} SELECT instant FROM q")
def quiet_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronology.quiet_instants(_units(spark, sf_dir))


def _cut_sql() -> str:
    parts = []
    for f in chronology.FRACTIONS:
        parts.append(f"""
SELECT r AS rank, t AS nominal, cost AS nominal_cost, CAST(best AS BIGINT) AS snap_cost FROM (
  SELECT r, t, (SELECT coalesce(sum(records), 0) FROM un WHERE first < t AND last >= t)::BIGINT AS cost,
         (SELECT min(abs(b - r)) FROM (SELECT (SELECT count(*) FROM s WHERE effective_ts < instant) AS b FROM q)) AS best
  FROM (SELECT CAST(trunc(count(*) * CAST({f} AS DOUBLE)) AS BIGINT) AS r FROM s) x JOIN (SELECT rank, effective_ts AS t FROM s) y ON y.rank = x.r)""")
    return f"WITH {QUIET}" + " UNION ALL ".join(parts)


@query(_cut_sql())
def cut_displacement_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nominal cut: the records it would exclude, and the least displacement of a quiet instant."""
    s, u = stream(spark, sf_dir), _units(spark, sf_dir)
    total = s.count()
    nominal = s.where(F.col("rank").isin(*chronology.boundaries(total))).select("rank", F.col("effective_ts").alias("nominal"))
    # few cuts against all units: a broadcast of three rows
    crossing = u.join(F.broadcast(nominal), (F.col("first") < F.col("nominal")) & (F.col("last") >= F.col("nominal")))
    cost = crossing.groupBy("rank").agg(F.sum("records").alias("nominal_cost"))
    both = s.select(F.col("effective_ts").alias("t"), F.lit(1).alias("kind")).unionByName(chronology.quiet_instants(u).select(F.col("instant").alias("t"), F.lit(0).alias("kind")))
    from logloom.operators.ordering import running_sums

    before = running_sums(both, F.col("t"), F.col("kind"), sums={"before": F.col("kind")}).where("kind = 0")
    snap = before.join(F.broadcast(nominal.select("rank"))).groupBy("rank").agg(F.min(F.abs(F.col("before") - F.col("rank"))).alias("snap_cost"))
    return nominal.join(cost, "rank", "left").join(snap, "rank").select("rank", "nominal", F.coalesce("nominal_cost", F.lit(0)).alias("nominal_cost"), "snap_cost")


def _chosen_sql() -> str:
    """Each cut in turn, from the records before every instant; a cut must lie after the one before."""
    parts, least = [f"WITH {QUIET}, qb AS (SELECT instant, (SELECT count(*) FROM s WHERE effective_ts < instant) AS b FROM q)"], "-1"
    for i, f in enumerate(chronology.FRACTIONS):
        parts.append(f"""
n{i} AS (SELECT rank AS r, effective_ts AS t, (SELECT coalesce(sum(records), 0) FROM un WHERE first < effective_ts AND last >= effective_ts)::BIGINT AS cost FROM s
  WHERE rank = (SELECT CAST(trunc(count(*) * CAST({f} AS DOUBLE)) AS BIGINT) FROM s)),
b{i} AS (SELECT instant, abs(b - r) AS d FROM qb, n{i} WHERE instant > {least} ORDER BY d, instant LIMIT 1),
x{i} AS (SELECT r, t, CASE WHEN d < cost THEN instant ELSE t END AS c, CASE WHEN d < cost THEN d ELSE cost END AS k, coalesce(d < cost, false) AS snap, cost FROM n{i} LEFT JOIN b{i} ON true),
c{i} AS (SELECT r AS rank, t AS nominal, CASE WHEN c <= {least} THEN {least} + 1 ELSE c END AS chosen, CAST(CASE WHEN c <= {least} THEN cost ELSE k END AS BIGINT) AS displaced,
  CASE WHEN c <= {least} THEN 'FORCED_MONOTONIC' WHEN snap THEN 'SNAPPED_TO_QUIET_INSTANT' ELSE 'NOMINAL_CUT_WITH_UNIT_EXCLUSION' END AS strategy FROM x{i})""")
        least = f"(SELECT chosen FROM c{i})"
    return ",".join(parts) + " UNION ALL ".join(f" SELECT rank, nominal, CAST(chosen AS BIGINT) AS chosen, displaced, strategy FROM c{i}" for i in range(len(chronology.FRACTIONS)))


@query(_chosen_sql())
def cut_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = chronology.choose_cuts(stream(spark, sf_dir), _units(spark, sf_dir))
    return spark.createDataFrame([(c["rank"], c["nominal"], c["chosen"], int(c["displaced"]), c["strategy"]) for c in chosen], "rank bigint, nominal bigint, chosen bigint, displaced bigint, strategy string")


@query(f"WITH {UNITS} " + " UNION ALL ".join(f"SELECT 'c{i}' AS cut, count(*) FILTER (first < {c} AND last >= {c}) AS units, CAST(coalesce(sum(records) FILTER (first < {c} AND last >= {c}), 0) AS BIGINT) AS records FROM un" for i, c in enumerate(CUTS)))
def units_alive_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronology.alive_at(_units(spark, sf_dir), {f"c{i}": c for i, c in enumerate(CUTS)})


BUFFER = f"""{SEGMENTED}, e AS (SELECT * FROM seg WHERE segment = 0),
gap AS (SELECT effective_ts - lag(effective_ts) OVER (ORDER BY rank) AS d FROM e),
m AS (SELECT (SELECT count(*) FROM e)::DOUBLE AS records, (SELECT (max(effective_ts) - min(effective_ts)) / 1e6 FROM e) AS span_s, (SELECT max(d) / 1e6 FROM gap) AS max_gap_s,
        (SELECT 1 - count(DISTINCT message) / count(*) FROM e) AS duplicate_ratio)"""


def _buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = segmented(spark, sf_dir).where("segment = 0")
    gap = previous(e, "effective_ts", F.col("rank").asc(), name="above").withColumn("d", F.col("effective_ts") - F.col("above"))
    return gap.agg(
        F.count("*").cast("double").alias("records"), ((F.max("effective_ts") - F.min("effective_ts")) / 1e6).alias("span_s"),
        (F.max("d") / 1e6).alias("max_gap_s"), (1 - F.count_distinct("message") / F.count("*")).alias("duplicate_ratio"),
    ).withColumn("relative_gap", F.col("max_gap_s") / F.col("span_s")).withColumn("labels_seen", F.lit(None).cast("double"))


@query(f"WITH {BUFFER} SELECT records, round(span_s, 6) AS span_s, round(max_gap_s, 6) AS max_gap_s, round(max_gap_s / span_s, 9) AS relative_gap, round(duplicate_ratio, 9) AS duplicate_ratio FROM m")
def buffer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buffer(spark, sf_dir).select("records", F.round("span_s", 6).alias("span_s"), F.round("max_gap_s", 6).alias("max_gap_s"), F.round("relative_gap", 9).alias("relative_gap"), F.round("duplicate_ratio", 9).alias("duplicate_ratio"))


READY = {"records": ("min", 1000), "span_s": ("min", 3600), "relative_gap": ("max", 0.2), "duplicate_ratio": ("max", 0.5), "labels_seen": ("max", 0)}


@query(f"""WITH {BUFFER}, c AS (
  SELECT 'records' AS k, records AS v, 'min' AS o, 1000 AS t FROM m UNION ALL SELECT 'span_s', span_s, 'min', 3600 FROM m UNION ALL
  SELECT 'relative_gap', max_gap_s / span_s, 'max', 0.2 FROM m UNION ALL SELECT 'duplicate_ratio', duplicate_ratio, 'max', 0.5 FROM m UNION ALL SELECT 'labels_seen', NULL, 'max', 0 FROM m)
SELECT k AS "check", CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN (o = 'min' AND v >= t) OR (o = 'max' AND v <= t) THEN 'READY' ELSE 'NOT_READY' END AS verdict FROM c""")
def max_gap_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.readiness(_buffer(spark, sf_dir), READY).select("check", "verdict")


B0 = f"""{STREAM}, p AS (SELECT *, lag(message) OVER (PARTITION BY user_id ORDER BY rank) AS previous FROM s),
tr AS (SELECT * FROM p WHERE effective_ts < {CUTS[0]}),
c AS (SELECT message, count(*) AS c FROM tr GROUP BY 1), c2 AS (SELECT previous, message, count(*) AS c2 FROM tr WHERE previous IS NOT NULL GROUP BY ALL),
c1 AS (SELECT previous, sum(c2) AS c1 FROM c2 GROUP BY 1), z AS (SELECT sum(c) AS n, count(*) + 1 AS v FROM c),
te AS (SELECT event_id, user_id, rank, message, unit, event_type, lag(message) OVER (PARTITION BY user_id ORDER BY rank) AS previous FROM s WHERE effective_ts >= {CUTS[0]}),
sc AS (SELECT te.*, -ln((coalesce(c, 0) + 0.5) / (n + 0.5 * v)) AS frequency,
        CASE WHEN te.previous IS NULL THEN -ln((coalesce(c, 0) + 0.5) / (n + 0.5 * v)) ELSE -ln((coalesce(c2, 0) + 0.5) / (coalesce(c1, 0) + 0.5 * v)) END AS markov
      FROM te LEFT JOIN c USING (message) LEFT JOIN c2 ON te.previous = c2.previous AND te.message = c2.message LEFT JOIN c1 ON te.previous = c1.previous, z)"""


def b0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both baseline scores of the events after the first cut, fitted on those before."""
    s = stream(spark, sf_dir)
    base = detect.Baseline(s.where(F.col("effective_ts") < CUTS[0]), "user_id", "rank", "message")
    return base.score(s.where(F.col("effective_ts") >= CUTS[0]))


@query(f"WITH {B0} SELECT event_id, round(frequency, 9) AS frequency FROM sc")
def b0_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b0(spark, sf_dir).select("event_id", F.round("frequency", 9).alias("frequency"))


@query(f"WITH {B0} SELECT event_id, previous, round(markov, 9) AS markov FROM sc")
def b0_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b0(spark, sf_dir).select("event_id", "previous", F.round("markov", 9).alias("markov"))


@query(f"""WITH {B0}, k AS (SELECT unit, markov, row_number() OVER (PARTITION BY unit ORDER BY markov DESC) AS r FROM sc)
SELECT unit, round(avg(markov), 9) AS mean, round(max(markov), 9) AS max, round(avg(markov) FILTER (r <= 3), 9) AS top3 FROM k GROUP BY 1""")
def unit_mean_max_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.slice(F.sort_array(F.collect_list("markov"), False), 1, 3)
    mean = F.aggregate(top, F.lit(0.0), lambda a, b: a + b) / F.size(top)
    return b0(spark, sf_dir).groupBy("unit").agg(F.round(F.avg("markov"), 9).alias("mean"), F.round(F.max("markov"), 9).alias("max"), F.round(mean, 9).alias("top3"))


@query(f"""WITH {STREAM}, u AS (SELECT unit AS unit_id, min(rank) AS first_rank, max(rank) AS last_rank, min(effective_ts) AS first_ts, max(effective_ts) AS last_ts, count(*) AS n_lines FROM s GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY last_rank, unit_id) - 1 AS o, count(*) OVER () AS n FROM u)
SELECT unit_id, first_rank, last_rank, first_ts, last_ts, n_lines, CAST(floor(o * 10 / n) AS INTEGER) AS stratum, CAST(o // 64 AS BIGINT) AS chunk,
       first_ts < (SELECT min(effective_ts) FROM s) + 3600000000 * 24 AS embargo FROM o""")
def strata_chunks_embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.build_units(stream(spark, sf_dir), "unit", 10, 64, DAY)


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata_chunks_embargo(spark, sf_dir).select("unit_id", "stratum", "n_lines", "last_rank")


STRATA = f"""{STREAM}, u AS (SELECT unit AS unit_id, max(rank) AS last_rank, count(*) AS n_lines FROM s GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY last_rank, unit_id) - 1 AS o, count(*) OVER () AS n FROM u),
st AS (SELECT unit_id, last_rank, n_lines, CAST(floor(o * 10 / n) AS INTEGER) AS stratum FROM o),
z AS (SELECT stratum, count(*) AS size FROM st GROUP BY 1), q0 AS (SELECT stratum, size, 501.0::DOUBLE * size / sum(size) OVER () AS raw FROM z),
q1 AS (SELECT *, floor(raw) AS f, row_number() OVER (ORDER BY floor(raw) - raw, stratum) AS r FROM q0),
q AS (SELECT stratum, size, CASE WHEN 501 >= sum(size) OVER () THEN size ELSE CAST(f + CASE WHEN r <= 501 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) END AS quota FROM q1)"""


@query(f"WITH {STRATA} SELECT stratum, size, quota FROM q")
def quota_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quotas(_strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("size")), 501)


@query(f"""WITH {STRATA}, h AS (SELECT st.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256('EVAL|' || unit_id), unit_id) AS r FROM st)
SELECT unit_id, stratum, r <= quota AS selected FROM h JOIN q USING (stratum)""")
def hash_sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(_strata(spark, sf_dir), 501, "EVAL").select("unit_id", "stratum", "selected")


@query(f"""WITH {STREAM}, u AS (SELECT user_id, unit, max(rank) AS last_rank FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_rank) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM u)
SELECT unit, CAST(p // 64 AS BIGINT) AS time_chunk, CASE WHEN p * 2 < n THEN 0 ELSE 1 END AS crossfit_fold FROM o""")
def time_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = stream(spark, sf_dir).groupBy("user_id", "unit").agg(F.max("rank").alias("last_rank"))
    return windows.time_chunks(u, "last_rank", "user_id").select("unit", "time_chunk", "crossfit_fold")


@query(f"WITH {STREAM} SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS r FROM s) WHERE r <= 32")
def per_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped(stream(spark, sf_dir), "user_id", "rank", 32).select("event_id", "user_id")


@query(f"WITH {STREAM} SELECT unit, event_id FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY sha256('E3-single|' || CAST(event_id AS VARCHAR))) AS r FROM s) WHERE r = 1")
def single_window_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.least_hash_per(stream(spark, sf_dir, False), "unit", "event_id", "E3-single").select("unit", "event_id")


@query(f"""WITH {STREAM} SELECT unit FROM (SELECT DISTINCT unit FROM s WHERE unit NOT IN (SELECT unit FROM s WHERE event_type = 'signup')) ORDER BY sha256('NEW|' || unit), unit LIMIT 100""")
def new_units_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir, False)
    return sampling.new_by_hash(s, s.where("event_type = 'signup'"), "unit", 100, "NEW")


@query(f"""WITH {STREAM}, c AS (SELECT * FROM (VALUES (0, 0.6), (1, 0.7), (2, 0.8), (3, 0.9), (4, 1.0)) v(part, f)),
n AS (SELECT count(*) AS n FROM s),
l AS (SELECT rank, CASE WHEN rank < 60 * n // 100 THEN 0 WHEN rank < 70 * n // 100 THEN 1 WHEN rank < 80 * n // 100 THEN 2 WHEN rank < 90 * n // 100 THEN 3 ELSE 4 END AS part, n FROM s, n),
b AS (SELECT *, CASE part WHEN 0 THEN 0 WHEN 1 THEN 60 * n // 100 WHEN 2 THEN 70 * n // 100 WHEN 3 THEN 80 * n // 100 ELSE 90 * n // 100 END AS st FROM l)
SELECT part, CAST((rank - st) // 100 AS BIGINT) AS "window", min(rank) AS first, max(rank) AS last, count(*) AS lines, count(*) = 100 AS complete FROM b GROUP BY ALL""")
def count_windows_100_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    return windows.count_windows(s, "rank", list(chronology.floor_boundaries(s.count())))


@query(f"""WITH {STREAM}, n AS (SELECT count(*) AS n FROM s)
SELECT CASE WHEN rank < 60 * n // 100 THEN 0 WHEN rank < 70 * n // 100 THEN 1 WHEN rank < 80 * n // 100 THEN 2 WHEN rank < 90 * n // 100 THEN 3 ELSE 4 END AS part,
       count(*) AS lines, min(rank) AS first, max(rank) AS last, round(count(*) / max(n), 6) AS ratio FROM s, n GROUP BY 1""")
def cumulative_floor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    n = s.count()
    part = _part(n)
    return s.groupBy(part.alias("part")).agg(F.count("*").alias("lines"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.round(F.count("*") / n, 6).alias("ratio"))


def _part(n: int):
    starts, part = chronology.floor_boundaries(n), F.lit(4)
    for i in range(3, -1, -1):
        part = F.when(F.col("rank") < starts[i + 1], i).otherwise(part)
    return part


@query(f"""WITH {STREAM}, el AS (SELECT *, CASE WHEN event_type <> 'error' THEN unit END AS c FROM s),
er AS (SELECT *, row_number() OVER (ORDER BY rank) - 1 AS er, count(*) OVER () AS n FROM el WHERE c IS NOT NULL),
p AS (SELECT c, CASE WHEN er < 60 * n // 100 THEN 0 WHEN er < 70 * n // 100 THEN 1 WHEN er < 80 * n // 100 THEN 2 WHEN er < 90 * n // 100 THEN 3 ELSE 4 END AS part FROM er)
SELECT c AS component, count(*) AS lines, CASE WHEN min(part) = max(part) THEN 'ASSIGNED' ELSE 'PURGED_BOUNDARY' END AS disposition, CASE WHEN min(part) = max(part) THEN min(part) END AS "partition" FROM p GROUP BY 1""")
def component_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = stream(spark, sf_dir).where("event_type <> 'error'").drop("rank")
    ranked = global_rank(eligible, F.col("effective_ts"), F.col("event_id").asc())
    return governance.component_rule(ranked.withColumn("part", _part(ranked.count())), "unit", "part")


@query(f"""WITH RECURSIVE {STREAM}, u AS (SELECT DISTINCT effective_ts // 60000000 AS minute, user_id FROM s), f AS (SELECT minute, min(user_id) AS low FROM u GROUP BY 1),
e0 AS (SELECT DISTINCT user_id AS x, low AS y FROM u JOIN f USING (minute) WHERE user_id <> low), e AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0),
r AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS vertex, min(y) AS component FROM r GROUP BY 1""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that were active in the same minute, and users whose chain of such minutes meets."""
    s = stream(spark, sf_dir, False).select("user_id", F.floor(F.col("effective_ts") / 60_000_000).alias("minute")).distinct()
    first = s.groupBy("minute").agg(F.min("user_id").alias("low"))
    edges = s.join(first, "minute").where("user_id <> low").select(F.col("user_id").alias("src"), F.col("low").alias("dst"))
    return graph.connected_components(edges)


@query(f"""WITH {STREAM}, v AS (SELECT message, count(*) AS n, min(rank) AS first FROM s GROUP BY 1)
SELECT message, row_number() OVER (ORDER BY n DESC, first) AS "column" FROM v ORDER BY n DESC, first LIMIT 99""")
def vocabulary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.vocabulary(stream(spark, sf_dir), "message", "rank", 100).withColumn("column", F.col("column").cast("bigint"))


@query(f"""WITH {STREAM}, v AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, min(rank)) AS col FROM s GROUP BY 1 QUALIFY col <= 3),
x AS (SELECT unit, coalesce(col, 0) AS col, count(*) AS n FROM s LEFT JOIN v USING (event_type) GROUP BY ALL),
t AS (SELECT count(DISTINCT unit) AS nn FROM x), f AS (SELECT col, count(DISTINCT unit) AS df FROM x GROUP BY 1)
SELECT unit, col AS "column", n, round(n * (ln((1 + nn) / (1 + df)) + 1), 9) AS weight FROM x JOIN f USING (col), t""")
def count_vectors_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    vocab = detect.vocabulary(s, "event_type", "rank", 4)
    v = detect.counts_by_window(s, "unit", "event_type", vocab)
    return detect.tfidf(v, "unit", F.lit(True)).select("unit", F.col("column").cast("bigint").alias("column"), "n", F.round("weight", 9).alias("weight"))


def _unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    v = detect.counts_by_window(s, "unit", "event_type", detect.vocabulary(s, "event_type", "rank", 6))
    return detect.dense(detect.tfidf(v, "unit", F.lit(True)), "unit", "column", "weight", 6)


@query()
def pca_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _unit_vectors(spark, sf_dir)
    return detect.pca_residual(v, v, "vector").select("unit", "residual")


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _unit_vectors(spark, sf_dir)
    return detect.isolation_forest(v, v, "vector", "unit")


@query(f"""WITH {STREAM}, tr AS (SELECT * FROM s WHERE effective_ts < {CUTS[0]}), k AS (SELECT count(DISTINCT unit) AS k FROM tr), t AS (SELECT message, count(*) / max(k) AS mu FROM tr, k GROUP BY 1), z AS (SELECT sum(mu * mu) AS sq FROM t),
c AS (SELECT unit, message, count(*) AS n FROM s GROUP BY ALL)
SELECT unit, CAST(coalesce(sum(n) FILTER (t.message IS NULL), 0) AS BIGINT) AS unseen, CAST(sum(n) AS BIGINT) AS length, count(*) AS distinct_messages,
  round(sqrt(greatest(0, sum(pow(n - coalesce(mu, 0), 2) - pow(coalesce(mu, 0), 2)) + max(sq))), 7) AS distance FROM c LEFT JOIN t USING (message), z GROUP BY 1""")
def order_blind_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir, False)
    return detect.novelty_flags(s, F.col("effective_ts") < CUTS[0], "unit", "message").withColumn("distance", F.round("distance", 7))


@query(f"""WITH {STREAM}, a AS (SELECT unit, list(event_type ORDER BY rank) AS x FROM s GROUP BY 1), b AS (SELECT *, len(x) AS n, len(x) // 2 AS m FROM a)
SELECT unit, array_to_string(CASE WHEN n < 2 THEN x ELSE list_concat(x[1:m], x[m+2:]) END, ',') AS missing,
  array_to_string(CASE WHEN n < 2 THEN x ELSE list_concat(list_concat(x[1:m], ['<OTHER>']), x[m+1:]) END, ',') AS extra,
  array_to_string(CASE WHEN n < 2 THEN x ELSE list_concat(x[1:m+1], x[m+1:]) END, ',') AS repeated,
  array_to_string(CASE WHEN n < 2 THEN x ELSE list_concat(list_concat(x[1:m], ['<OTHER>']), x[m+2:]) END, ',') AS replaced,
  array_to_string(CASE WHEN n < 2 THEN x ELSE list_concat(list_concat(list_concat(x[1:m-1], [x[m+1]]), [x[m]]), x[m+2:]) END, ',') AS swapped,
  array_to_string(list_sort(x), ',') AS sorted FROM b""")
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.array_sort(F.collect_list(F.struct("rank", "event_type")))["event_type"]
    m = detect.mutations(stream(spark, sf_dir).groupBy("unit").agg(seq.alias("items")), "items")
    return m.select("unit", *[F.array_join(c, ",").alias(c) for c in ("missing", "extra", "repeated", "replaced", "swapped", "sorted")])


@query(f"WITH {WINDOWS}, n AS (SELECT rank, list(message ORDER BY i) AS x FROM (SELECT c.rank, t.message, g.i FROM c, LATERAL (SELECT unnest(cr) AS r, generate_subscripts(cr, 1) AS i) g JOIN s t ON t.rank = g.r) GROUP BY 1) SELECT rank AS target_rank, array_to_string(x, '>') AS context FROM n")
def hydrate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    return windows.hydrate(_windows(spark, sf_dir), s).select("target_rank", F.array_join("context", ">").alias("context"))


@query(f"""WITH {WINDOWS}, ev AS (SELECT rank, 'seq-' || substr(sha256('EVENTS|ALL|' || CAST(user_id AS VARCHAR)), 1, 24) AS q FROM s WHERE event_type <> 'signup'),
x AS (SELECT rank AS target_rank, sequence_id, unnest(list_concat([rank], cr)) AS r FROM c)
SELECT target_rank, r AS rank, 'MISSING' AS fault FROM x LEFT JOIN ev ON ev.rank = r WHERE ev.rank IS NULL
UNION ALL SELECT target_rank, r, 'OTHER_SEQUENCE' FROM x JOIN ev ON ev.rank = r WHERE q <> sequence_id""")
def window_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).where("event_type <> 'signup'")
    ev = s.select("rank", identity.sequence_id(F.lit("EVENTS"), F.lit("ALL"), F.col("user_id").cast("string")).alias("sequence_id"))
    return windows.referential_faults(_windows(spark, sf_dir), ev)


@query(f"WITH {WINDOWS}, d AS (SELECT dedupe_key, count(*) AS windows, min(rank) AS scored FROM c GROUP BY 1) SELECT rank AS target_rank, scored, windows FROM c JOIN d USING (dedupe_key)")
def distinct_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a scorer cannot tell apart are scored once, and the score is spread again."""
    w = _windows(spark, sf_dir).select("target_rank", "dedupe_key")
    once = w.groupBy("dedupe_key").agg(F.count("*").alias("windows"), F.min("target_rank").alias("scored"))
    return w.join(once, "dedupe_key").select("target_rank", "scored", "windows")


@query()
def drain_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("text").alias("m"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    return templates.fit(c, "m", "o")


@query(f"""WITH {STREAM}, d AS (SELECT rank // 65536 AS b, sha256(unhex(string_agg(lpad(lower(hex(rank)), 16, '0'), '' ORDER BY rank))) AS d, count(*) AS n FROM s GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS members FROM d""")
def membership_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.membership_digest(stream(spark, sf_dir))


@query(f"""WITH {STREAM}, a AS (SELECT unit, list(message ORDER BY rank) AS x FROM s GROUP BY 1)
SELECT unit, sha256(array_to_string(x, chr(0))) AS ordered, sha256(array_to_string(list_sort(x), chr(0))) AS multiset FROM a""")
def event_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.array_sort(F.collect_list(F.struct("rank", "message")))["message"]
    return stream(spark, sf_dir).groupBy("unit").agg(seq.alias("x")).select("unit", identity.ordered_hash(F.col("x")).alias("ordered"), identity.multiset_hash(F.col("x")).alias("multiset"))


@query(f"WITH {STREAM} SELECT count(*) AS rows, count(DISTINCT rank) AS distinct, max(rank) + 1 AS expected, count(*) = count(DISTINCT rank) AND count(*) = max(rank) + 1 AND min(rank) = 0 AS exact FROM s")
def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.exact_cover(stream(spark, sf_dir), "rank")


@query(f"""WITH {STREAM}, g AS (SELECT effective_ts - lag(effective_ts) OVER (PARTITION BY unit ORDER BY rank) AS d FROM s)
SELECT count(*) AS "count", min(d) AS min, round(quantile_cont(d, 0.05), 3) AS q05, round(quantile_cont(d, 0.25), 3) AS q25, round(quantile_cont(d, 0.5), 3) AS median, round(quantile_cont(d, 0.75), 3) AS q75, round(quantile_cont(d, 0.95), 3) AS q95,
  round(quantile_cont(d, 0.99), 3) AS q99, max(d) AS max, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 3) AS iqr FROM g WHERE d IS NOT NULL""")
def robust_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("effective_ts") - F.lag("effective_ts").over(Window.partitionBy("unit").orderBy("rank"))
    told = metrics.robust_summary(stream(spark, sf_dir).withColumn("d", gap), "d")
    return told.select("count", "min", *[F.round(c, 3).alias(c) for c in ("q05", "q25", "median", "q75", "q95", "q99")], "max", F.round("iqr", 3).alias("iqr"))


@query(f"WITH {STREAM} SELECT event_id, row_number() OVER (PARTITION BY unit ORDER BY rank) - 1 AS position FROM s")
def position_in_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.position_in_unit(stream(spark, sf_dir), "unit", "rank").select("event_id", "position")


@query(f"WITH {STREAM} SELECT rank, event_id AS file_position, message FROM s WHERE event_type IN ('signup', 'error')")
def raw_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks found again in the raw order, and the texts of some at their places there."""
    s = stream(spark, sf_dir).withColumn("raw_hash", F.md5("message"))
    raw = stream(spark, sf_dir, False).select(F.col("event_id").alias("file_position"), "effective_ts", F.md5("message").alias("raw_hash"), "message")
    found = windows.locate(s.select("rank", "effective_ts", "raw_hash", "event_type"), raw).where("event_type in ('signup', 'error')")
    texts = windows.at_positions(raw, found.select("rank", "file_position", F.col("raw_hash").alias("norm_hash")), "message", "raw_hash")
    return texts.select("rank", "file_position", "message")


@query(f"""WITH {WINDOWS}, n AS (SELECT rank, window_id, cr, ('0x' || substr(sha256('suffix|' || window_id), 1, 8))::BIGINT % len(cr) + 1 AS k FROM c) SELECT rank AS target_rank, array_to_string(cr[len(cr) - k + 1:], ',') AS context FROM n""")
def context_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random suffix of each window's context that training sees."""
    w = windows.random_suffix(_windows(spark, sf_dir), "suffix")
    return w.select("target_rank", F.array_join(F.col("context_ranks").cast("array<string>"), ",").alias("context"))


@query(f"""WITH {STREAM}, h AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('11|' || CAST(event_id AS VARCHAR)), event_id) - 1 AS draw FROM s) SELECT event_id, event_type, draw FROM h WHERE draw < 40""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded(stream(spark, sf_dir, False), "event_type", "event_id", 40, 11).select("event_id", "event_type", "draw")


@query("""WITH RECURSIVE o AS (SELECT doc_id, n_chars AS l, row_number() OVER (ORDER BY n_chars, doc_id) AS i FROM documents),
b AS (SELECT i, doc_id, CAST(0 AS BIGINT) AS batch, 1 AS held FROM o WHERE i = 1
  UNION ALL SELECT o.i, o.doc_id, CASE WHEN o.l * (b.held + 1) > 65536 THEN b.batch + 1 ELSE b.batch END, CASE WHEN o.l * (b.held + 1) > 65536 THEN 1 ELSE b.held + 1 END FROM b JOIN o ON o.i = b.i + 1)
SELECT doc_id, batch FROM b""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches by length, a batch's padded size within a budget."""
    return sampling.batches(read(spark, sf_dir, "documents"), "n_chars", "doc_id", 65536).select("doc_id", "batch")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'error' THEN epoch_us(ts) END AS t FROM events),
c AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM e),
a AS (SELECT *, lag(own) OVER (PARTITION BY user_id ORDER BY event_id) AS above FROM c)
SELECT user_id, count(*) AS lines, count(t) AS parsed, count(own) - count(t) AS inherited, count(*) - count(own) AS undated, count(*) FILTER (own < above) AS inversions, min(t) AS first_ts, max(t) AS last_ts, count(DISTINCT event_type) AS messages FROM a GROUP BY 1""")
def chronology_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, False).withColumn("t", F.when(F.col("event_type") != "error", F.col("effective_ts")))
    return chronology.counters(e, "t", "user_id", "event_id", "event_type")


@query()
def template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of the first turns, matched to all turns: mining depends on the order of messages, so SQL has no equal."""
    c = read(spark, sf_dir, "conversations").withColumn("o", F.col("conv_id") * 1000 + F.col("turn"))
    found = templates.fit(c.where("turn <= 1"), "text", "o")
    return templates.transform(c.select("conv_id", "turn", "text"), "text", found).select("conv_id", "turn", "event_id", "template")
