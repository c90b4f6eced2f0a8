"""Queries over records: references, rules, split tables, faults and labels of windows, probes, scores of a model, structural metadata, populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import identity, text
from logloom.operators import detect, governance, metadata, records
from logloom.operators.lineage import new_table_path
from logloom.plans.registry import STREAM, query, read, stream
from logloom.plans.stream_queries import WINDOWS, _windows


@query("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0),
u AS (SELECT DISTINCT 'order' AS record_type, 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS "value" FROM o ANTI JOIN c ON o_custkey = c_custkey
  UNION ALL SELECT DISTINCT 'line', 'l_orderkey', CAST(l_orderkey AS VARCHAR) FROM lineitem ANTI JOIN o ON l_orderkey = o_orderkey)
SELECT *, 'ORPHAN' AS fault FROM u UNION ALL
SELECT 'line', 'id', CAST(l_partkey AS VARCHAR), 'REPEATED' FROM lineitem GROUP BY l_partkey HAVING count(*) > 1 UNION ALL
SELECT 'order', 'supersedes_id', CAST(o_orderkey AS VARCHAR), 'SELF' FROM o WHERE o_orderkey = o_custkey UNION ALL
SELECT DISTINCT 'order', 'supersedes_id', CAST(o_custkey AS VARCHAR), 'ORPHAN' FROM o ANTI JOIN (SELECT o_orderkey AS k FROM o) ON o_custkey = k""")
def reference_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three types of records; an order's customer also stands for the order that it supersedes."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("supersedes_id"))
    found = {"customer": read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"), "order": orders, "line": read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")}
    ids = {"customer": "c_custkey", "order": "o_orderkey", "line": "l_partkey"}
    return records.reference_faults(found, ids, (("order", "o_custkey", "customer"), ("line", "l_orderkey", "order")))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'BASE_TRAIN' WHEN 'O' THEN 'TEST' ELSE 'VAL_EXPERT' END AS \"partition\", count(*) AS rows, 'OK' AS state FROM orders GROUP BY 1")
def split_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split is written, and its rows are held against its table of partitions."""
    part = F.when(F.col("o_orderstatus") == "F", "BASE_TRAIN").when(F.col("o_orderstatus") == "O", "TEST").otherwise("VAL_EXPERT")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", part.alias("partition"))
    path = new_table_path(spark, "split")
    records.write_split(rows, path)
    return records.validate_split(spark, path)


@query(f"""WITH {WINDOWS}, ev AS (SELECT rank, 'seq-' || substr(sha256('EVENTS|ALL|' || CAST(user_id AS VARCHAR)), 1, 24) AS q FROM s WHERE event_type <> 'signup'),
x AS (SELECT sequence_id, unnest(list_concat([rank], cr)) AS r FROM c), y AS (SELECT q, sequence_id FROM x LEFT JOIN ev ON ev.rank = r)
SELECT 'nulls' AS rule, 0 AS faults UNION ALL SELECT 'count', 0 UNION ALL SELECT 'identity', count(*) - count(DISTINCT window_id) FROM c
UNION ALL SELECT 'horizon', count(*) FILTER (len(cr) > 6) FROM c UNION ALL SELECT 'order', count(*) FILTER (list_max(cr) >= rank OR ct[-1] > effective_ts) FROM c
UNION ALL SELECT 'unknown', count(*) FILTER (q IS NULL) FROM y UNION ALL SELECT 'elsewhere', count(*) FILTER (q <> sequence_id) FROM y""")
def view_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8 records against a horizon of 6, and events without sign-ups."""
    ev = stream(spark, sf_dir).where("event_type <> 'signup'")
    known = ev.select("rank", identity.sequence_id(F.lit("EVENTS"), F.lit("ALL"), F.col("user_id").cast("string")).alias("sequence_id"))
    kept = _windows(spark, sf_dir).select("window_id", "sequence_id", "target_rank", "context_ranks", "context_record_count", "target_effective_ts", "context_last_effective_ts")
    return records.view_faults(kept, known, 6)


@query(f"""WITH {WINDOWS}, lb AS (SELECT rank, event_type = 'error' AS anomaly FROM s WHERE event_type <> 'signup'),
f AS (SELECT c.rank AS target_rank, sequence_id AS unit_id, anomaly FROM c LEFT JOIN lb USING (rank)), m AS (SELECT unit_id, min(anomaly) <> max(anomaly) AS mixed FROM f GROUP BY 1)
SELECT target_rank, unit_id, anomaly, CASE WHEN anomaly IS NULL THEN 'MISSING' WHEN mixed THEN 'CONFLICT' END AS fault FROM f JOIN m USING (unit_id)""")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).where("event_type <> 'signup'")
    out = records.window_labels(_windows(spark, sf_dir), s.select("rank", (F.col("event_type") == "error").alias("anomaly")), "sequence_id", strict=False)
    return out.drop("window_id")


@query("SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(json_keys(props), lambda k: lower(k)))), ',') AS keys FROM events")
def nested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.array_join(text.json_keys(F.col("props")), ",").alias("keys"))


SEQUENCES = f"{STREAM}, a AS (SELECT unit, list(event_type ORDER BY rank) AS x FROM s GROUP BY 1)"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.array_sort(F.collect_list(F.struct("rank", "event_type")))["event_type"]
    return stream(spark, sf_dir).groupBy("unit").agg(seq.alias("items"))


@query(f"""WITH {SEQUENCES}, r AS (SELECT unit, list_sort(x) <> x AS changed FROM a)
SELECT unit, CASE WHEN changed THEN '' ELSE 'applied' END AS violations FROM r""")
def destruction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in sorted order, all claimed to be changed: those that were sorted before break a rule."""
    c, out = F.col, F.array_sort(F.col("items"))
    told = _sequences(spark, sf_dir).select(
        "unit", F.lit("VAL_EXPERT").alias("partition"), F.lit("NORMAL").alias("label"), F.lit("VALIDATION_EVALUATION").alias("label_access"), F.size("items").alias("original_length"), F.size(out).alias("destroyed_length"),
        identity.ordered_hash(c("items")).alias("original_sha256"), identity.ordered_hash(out).alias("destroyed_sha256"), identity.multiset_hash(c("items")).alias("original_multiset"), identity.multiset_hash(out).alias("destroyed_multiset"),
        F.lit("APPLIED").alias("status"), F.lit(None).cast("string").alias("no_op_reason"),
    )
    return governance.violations(told, records.destruction_rules()).select("unit", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {SEQUENCES}, o(operation) AS (VALUES ('MISSING'), ('EXTRA'), ('REPLACEMENT'))
SELECT unit, operation, CASE WHEN len(x) >= 2 THEN '' WHEN operation = 'MISSING' THEN 'changed,missing' WHEN operation = 'EXTRA' THEN 'changed,extra' ELSE 'changed,inside' END AS violations FROM a, o""")
def mutation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three operations on every unit; units of one event are not changed, which breaks the rules."""
    m = F.floor(F.size("items") / 2).cast("int")
    none = F.array().cast("array<int>")
    each = {"MISSING": ("missing", none, F.array(m), none), "EXTRA": ("extra", F.array(m), none, none), "REPLACEMENT": ("replaced", F.array(m), none, F.array(m - 1))}
    cases = [F.struct(F.lit(op).alias("operation"), F.col(col).alias("observed"), t.alias("token_positions"), g.alias("gap_positions"), s.alias("transition_positions")) for op, (col, t, g, s) in each.items()]
    told = detect.mutations(_sequences(spark, sf_dir), "items").select("unit", "items", F.explode(F.array(*cases)).alias("r")).select("unit", "items", "r.*")
    told = told.select(
        "*", F.lit("VAL_EXPERT").alias("source_partition"), F.size("items").alias("expected_length"), F.size("observed").alias("observed_length"),
        identity.ordered_hash(F.col("items")).alias("expected_sha256"), identity.ordered_hash(F.col("observed")).alias("observed_sha256"),
    )
    return governance.violations(told, records.mutation_rules()).select("unit", "operation", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query(f"""WITH {SEQUENCES}, b AS (SELECT unit, x[:-2] AS c, x[-1] AS t FROM a WHERE len(x) > 1), p AS (
  SELECT unit, 'event_permutation' AS kind, list_reverse(c) AS c, t FROM b UNION ALL SELECT unit, 'missing_event', list_concat(c[1:1], c[3:]), t FROM b
  UNION ALL SELECT unit, 'duplicate_event', list_concat(c, [c[-1]]), t FROM b UNION ALL SELECT unit, 'unexpected_next_event', c, 'denied' FROM b
  UNION ALL SELECT unit, 'long_range_dependency_violation', list_concat(['cancelled'], c[2:]), t FROM b UNION ALL SELECT unit, 'locally_plausible_globally_invalid', list_concat(c[2:], c[1:1]), t FROM b)
SELECT unit, kind, array_to_string(c, ',') AS context, t AS target FROM p""")
def sequence_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.col("items")
    cases = records.sequence_probes(F.slice(items, F.lit(1), F.size(items) - 1), F.element_at(items, -1), F.lit("denied"), F.lit("cancelled"))
    told = _sequences(spark, sf_dir).where(F.size("items") > 1).select("unit", F.explode(cases).alias("p"))
    return told.select("unit", "p.kind", F.array_join("p.context", ",").alias("context"), "p.target")


def _vowels():
    """A stand-in for a model: the share of vowels; a text without letters has none."""

    def score(texts: list[str]) -> list[float | None]:
        letters = [[x for x in t if "a" <= x <= "z"] for t in texts]
        return [round(sum(x in "aeiou" for x in found) / len(found), 6) if found else None for found in letters]

    return score


@query("""WITH l AS (SELECT event_id, regexp_replace(event_type, '[^a-z]', '', 'g') AS x, event_type = 'error' AS e FROM events)
SELECT event_id, CASE WHEN e OR x = '' THEN NULL ELSE round(length(regexp_replace(x, '[^aeiou]', '', 'g')) / length(x), 6) END AS score_raw, CASE WHEN e OR x = '' THEN 'UNSCORABLE' ELSE 'OK' END AS status FROM l""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a caller's model; errors have no text."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("text"))
    return records.scored(e, "event_id", "text", _vowels)


@query(f"""WITH RECURSIVE {STREAM}, t AS (SELECT effective_ts // 60000000 AS minute, event_type = 'error' AS bad, 'blk_' || CAST(user_id AS VARCHAR) AS id FROM s),
u AS (SELECT minute, id, count(*) AS n FROM t WHERE NOT bad GROUP BY ALL), g AS (SELECT minute, min(id) AS low FROM u GROUP BY 1),
e0 AS (SELECT DISTINCT id AS x, low AS y FROM u JOIN g USING (minute)), e AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0),
r AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), k AS (SELECT x, min(y) AS component FROM r GROUP BY 1),
l AS (SELECT minute, bool_or(bad) AS bad, count(DISTINCT id) FILTER (NOT bad) AS n FROM t GROUP BY 1), d AS (SELECT minute, max(n) > 1 AS twice FROM u GROUP BY 1)
SELECT minute, array_to_string(list_filter([CASE WHEN twice THEN 'DUPLICATE_BLOCK_ID' END, CASE WHEN bad THEN 'MALFORMED_BLOCK_TOKEN' END, CASE WHEN n > 1 THEN 'MULTIPLE_BLOCK_IDS' END], lambda x: x IS NOT NULL), ',') AS issues,
  component, CASE WHEN n > 0 THEN 'ASSIGNED' ELSE 'UNASSIGNED' END AS status, CASE WHEN n = 0 THEN 'MALFORMED_BLOCK_TOKEN' END AS reason
FROM l LEFT JOIN d USING (minute) LEFT JOIN g USING (minute) LEFT JOIN k ON k.x = g.low""")
def line_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per minute names its users as padded block ids; those of errors are malformed."""
    token = F.concat(F.when(F.col("event_type") == "error", "blk_x").otherwise("blk_00"), F.col("user_id").cast("string"))
    s = stream(spark, sf_dir, False).groupBy(F.floor(F.col("effective_ts") / 60_000_000).alias("minute")).agg(F.array_join(F.collect_list(token), " ").alias("message"))
    return metadata.line_metadata(s).select("minute", F.array_join("issues", ",").alias("issues"), "component", "status", "reason")


@query("""WITH f AS (SELECT lang, 'chars' AS field, CAST(n_chars AS DOUBLE) AS v FROM documents UNION ALL SELECT lang, 'bytes', CAST(strlen(text) AS DOUBLE) FROM documents)
SELECT lang AS population, field, count(*) AS "count", min(v) AS min, round(quantile_cont(v, 0.05), 5) AS q05, round(quantile_cont(v, 0.25), 5) AS q25, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q75,
  round(quantile_cont(v, 0.95), 5) AS q95, round(quantile_cont(v, 0.99), 5) AS q99, max(v) AS max, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 5) AS iqr FROM f GROUP BY ALL""")
def population_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("chars"), F.octet_length("text").alias("bytes"))
    told = governance.population_summaries(d, "lang", ["chars", "bytes"])
    return told.select("population", "field", "count", "min", "max", *[F.round(c, 5).alias(c) for c in ("q05", "q25", "median", "q75", "q95", "q99", "iqr")])


@query("""WITH p AS (SELECT event_type AS "partition", count(*) AS raw, count(*) // 100 AS windows FROM events GROUP BY 1), w AS (SELECT sum(raw) AS r, sum(windows * 100) AS k FROM p)
SELECT "partition", raw, windows, windows * 100 AS retained, raw - windows * 100 AS residual, round(raw / r, 9) AS raw_ratio, round(windows * 100 / k, 9) AS retained_ratio FROM p, w""")
def window_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = governance.window_reconciliation(read(spark, sf_dir, "events"), "event_type")
    return told.select("partition", "raw", "windows", "retained", "residual", F.round("raw_ratio", 9).alias("raw_ratio"), F.round("retained_ratio", 9).alias("retained_ratio"))


@query(f"""WITH {STREAM}, l AS (SELECT CASE WHEN event_type <> 'error' THEN user_id END AS c, value > 50 AS part FROM s),
m AS (SELECT c, count(*) AS n, min(part) = max(part) AS one FROM l WHERE c IS NOT NULL GROUP BY 1)
SELECT count(*) AS raw, count(*) FILTER (c IS NULL) AS ineligible, CAST((SELECT coalesce(sum(n) FILTER (one), 0) FROM m) AS BIGINT) AS assigned, CAST((SELECT coalesce(sum(n) FILTER (NOT one), 0) FROM m) AS BIGINT) AS purged, true AS holds FROM l""")
def component_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stream(spark, sf_dir, False).select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("c"), (F.col("value") > 50).alias("part"))
    return governance.component_reconciliation(lines, "c", "part")
