"""Queries over text, labels, folds and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import identity, text
from logloom.operators import detect, governance, sampling
from logloom.operators.ordering import previous, quantiles
from logloom.plans.registry import STREAM, query, read, stream
from logloom.plans.stream_queries import SEGMENTED, segmented
from logloom.sources import logs

TEMPLATE = "array_to_string(list_transform(string_split({}, ' '), lambda w: CASE WHEN length(regexp_replace(w, '[^0-9]', '', 'g')) >= 3 THEN '<V>' ELSE w END), ' ')"


@query(f"SELECT doc_id, {TEMPLATE.format('text')} AS template_key FROM documents")
def template_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.template_key(F.col("text")).alias("template_key"))


@query()
def volatile_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform(text.volatile_spans(F.col("text")), lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(spans, ",").alias("spans"))


@query()
def normalize_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'NUL_ESCAPED' ELSE 'UNCHANGED' END AS status, true AS round_trip FROM documents")
def nul_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the texts get a NUL and a backslash; escaping and its inverse give them back."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\\x00\x00\\"))).otherwise(F.col("text")).alias("m"))
    status = text.nul_status(F.col("m"))
    return d.select("doc_id", status.alias("status"), (text.unescape_nul(text.escape_nul(F.col("m")), status) == F.col("m")).alias("round_trip"))


@query("""SELECT l_orderkey, array_to_string(list_transform(list_sort(list_distinct(list(l_partkey))), lambda x: 'blk_' || CAST(x AS VARCHAR)), ',') AS ids FROM lineitem GROUP BY 1""")
def block_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys written as padded block tokens in a message per order, and read back."""
    li = read(spark, sf_dir, "lineitem")
    msg = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("got blk_00"), F.col("l_partkey").cast("string"))), ", ").alias("m"))
    return msg.select("l_orderkey", F.array_join(text.block_tokens(F.col("m"))["ids"], ",").alias("ids"))


@query(f"WITH {SEGMENTED}, e AS (SELECT * FROM seg WHERE segment = 0) SELECT 'template' AS field, event_type AS \"value\", count(*) AS \"count\" FROM e GROUP BY 2 UNION ALL SELECT 'message', message, count(*) FROM e GROUP BY 2")
def template_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = segmented(spark, sf_dir).where("segment = 0")
    told = e.select(F.explode(F.array(F.struct(F.lit("template").alias("field"), F.col("event_type").alias("value")), F.struct(F.lit("message").alias("field"), F.col("message").alias("value")))).alias("x"))
    return told.groupBy("x.field", "x.value").agg(F.count("*").alias("count"))


DRIFT = f"""{SEGMENTED}, e AS (SELECT message, count(*) AS n FROM seg WHERE segment = 0 GROUP BY 1), t AS (SELECT CAST(segment AS INTEGER) AS stratum, message, count(*) AS n FROM seg WHERE segment IN (1, 2, 3) GROUP BY ALL)"""


@query(f"""WITH {DRIFT} SELECT stratum, CAST(sum(t.n) AS BIGINT) AS lines, round(coalesce(sum(t.n) FILTER (e.message IS NULL), 0) / sum(t.n), 9) AS unseen_rate FROM t LEFT JOIN e USING (message) GROUP BY 1""")
def unseen_rate_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segmented(spark, sf_dir)
    seen = s.where("segment = 0").select(F.col("message").alias("__m")).distinct()
    late = s.where("segment in (1, 2, 3)").join(seen, F.col("message") == F.col("__m"), "left")
    return late.groupBy(F.col("segment").cast("int").alias("stratum")).agg(F.count("*").alias("lines"), F.round(F.avg(F.col("__m").isNull().cast("int")), 9).alias("unseen_rate"))


@query(f"""WITH {DRIFT}, ks AS (SELECT DISTINCT stratum FROM t), a AS (SELECT message, n / sum(n) OVER () AS p FROM e), b AS (SELECT stratum, message, n / sum(n) OVER (PARTITION BY stratum) AS q FROM t),
x AS (SELECT ks.stratum, a.message, a.p, b.q FROM ks CROSS JOIN a LEFT JOIN b ON b.stratum = ks.stratum AND b.message = a.message UNION ALL SELECT b.stratum, b.message, 0, b.q FROM b ANTI JOIN a USING (message)),
y AS (SELECT stratum, coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM x)
SELECT stratum, round(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 6) AS jsd FROM y GROUP BY 1""")
def drift_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jensen-Shannon divergence in bits between the first segment's messages and each later one's."""
    s = segmented(spark, sf_dir)
    base = s.where("segment = 0").groupBy("message").agg(F.count("*").alias("n"))
    late = s.where("segment in (1, 2, 3)").groupBy(F.col("segment").cast("int").alias("stratum"), "message").agg(F.count("*").alias("k"))
    nb, nl = base.agg(F.sum("n").alias("bn")), late.groupBy("stratum").agg(F.sum("k").alias("ln"))
    # what both have, and what each has alone: the latter adds half of its own share
    both = late.join(base, "message").join(F.broadcast(nl), "stratum").join(F.broadcast(nb))
    p, q = F.col("n") / F.col("bn"), F.col("k") / F.col("ln")
    m = (p + q) / 2
    part = both.groupBy("stratum").agg(F.sum(p * F.log2(p / m) + q * F.log2(q / m)).alias("x"), F.sum(p).alias("ps"), F.sum(q).alias("qs"))
    return nl.join(part, "stratum", "left").select("stratum", F.round((F.coalesce("x", F.lit(0.0)) + (1 - F.coalesce("ps", F.lit(0.0))) + (1 - F.coalesce("qs", F.lit(0.0)))) / 2, 6).alias("jsd"))


@query("SELECT source AS unit, count(DISTINCT toxic) AS labels, count(*) AS rows FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT toxic) > 1")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return governance.label_conflicts(j, "source", "toxic").withColumnRenamed("source", "unit")


@query("""SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matched, count(*) FILTER (d.doc_id IS NULL) AS unknown, count(*) FILTER (l.doc_id IS NULL) AS missing
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.label_coverage(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"), "doc_id")


@query("SELECT lang, count(*) FILTER (toxic = 1) AS positive, count(*) FILTER (toxic = 0) AS negative FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("positive"), F.count_if(F.col("toxic") == 0).alias("negative"))


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Events as log lines of one form; every tenth is junk."""
    e = read(spark, sf_dir, "events").select(F.lit("app/application_1_2/c.log").alias("source_file"), F.col("event_id").alias("line"), F.date_format(F.col("ts"), "yyMMdd HHmmss").alias("short"), F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSS").alias("long"), "*")
    return e.select("source_file", "line", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("junk "), F.col("event_id").cast("string"))).otherwise(F.expr(text)).alias("text"))


PARSED = ("line", "timestamp_us", "timestamp_status", "level", "service", "component", "node_id", "session_id", "trace_id", "message", "parse_status")


def _parsed_sql(micros: str, otherwise: str, always: str = "NULL, NULL", **fields: str) -> str:
    bad = "CONTINUATION" if otherwise == "CONTINUATION" else "UNPARSEABLE"
    cols = ", ".join(f"CASE WHEN ok THEN {fields.get(n, 'NULL')} END AS {n}" for n in ("level", "service", "component", "node_id"))
    session, trace = always.split(", ")
    ends = f"CASE WHEN ok THEN {fields.get('session_id', session)} ELSE {session} END AS session_id, CASE WHEN ok THEN {fields.get('trace_id', trace)} ELSE {trace} END AS trace_id"
    return f"""SELECT event_id AS line, CASE WHEN ok THEN {micros} END AS timestamp_us, CASE WHEN ok THEN 'PARSED' ELSE '{bad}' END AS timestamp_status, {cols}, {ends},
  CASE WHEN ok THEN {fields['message']} ELSE 'junk ' || CAST(event_id AS VARCHAR) END AS message, CASE WHEN ok THEN 'OK' ELSE '{otherwise}' END AS parse_status FROM (SELECT *, event_id % 10 <> 0 AS ok FROM events)"""


@query(_parsed_sql("epoch_us(date_trunc('second', ts))", "MALFORMED", level="'INFO'", service="'app'", component="'app.' || event_type", session_id="'blk_' || CAST(event_id AS VARCHAR)", message="'got blk_' || CAST(event_id AS VARCHAR)"))
def parse_hdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_hdfs(_lines(spark, sf_dir, "concat(short, ' ', user_id, ' INFO app.', event_type, ': got blk_', event_id)")).select(*PARSED)


@query(_parsed_sql("epoch_us(date_trunc('second', ts))", "MALFORMED", level="'INFO'", service="'RAS'", component="'APP'", node_id="'R' || CAST(user_id AS VARCHAR)", message="event_type || ' seen'"))
def parse_bgl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_bgl(_lines(spark, sf_dir, "concat('- 1 2 R', user_id, ' ', date_format(ts, 'yyyy-MM-dd-HH.mm.ss'), '.000000 R RAS APP INFO ', event_type, ' seen')")).select(*PARSED)


@query(_parsed_sql("epoch_us(ts) // 1000 * 1000", "CONTINUATION", "'application_1_2', 'c'", level="'WARN'", service="'yarn'", component="'org.apache.hadoop.yarn.' || event_type", node_id="'main'", message="'did: it'"))
def parse_hadoop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_hadoop(_lines(spark, sf_dir, "concat(replace(long, '.', ','), ' WARN [main] org.apache.hadoop.yarn.', event_type, ': did: it')")).select(*PARSED)


UUID = "'b9000564-fe1a-409b-b8cc-1e88b294cd1d'"


@query(_parsed_sql("epoch_us(ts) // 1000 * 1000", "MALFORMED", level="'INFO'", service="'nova'", component="'nova.api'", session_id=UUID, trace_id=UUID, message=f"'[req-' || {UUID} || ' -] [instance: ' || {UUID} || '] ' || event_type"))
def parse_openstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_openstack(_lines(spark, sf_dir, f"concat('nova.log.1 ', long, ' 25 INFO nova.api [req-', {UUID}, ' -] [instance: ', {UUID}, '] ', event_type)")).select(*PARSED)


@query("SELECT count(*) FILTER (event_type = 'error' AND event_id % 10 <> 0 OR event_id % 10 = 0) AS positives, count(*) FILTER (event_type <> 'error' AND event_id % 10 <> 0) AS negatives, count(*) AS total FROM events")
def inline_label_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are the first word of each line."""
    return logs.label_inventory(logs.read_inline_labels(_lines(spark, sf_dir, "concat(if(event_type = 'error', 'ALERT', '-'), ' ', event_id)")))


@query("""WITH w AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS z FROM conversations),
h AS (SELECT conv_id, turn, i, z[i] AS word, greatest(1, CAST(round_even(len(z) * 0.3::DOUBLE, 0) AS INTEGER)) AS k, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sha256('5|' || text || '|' || CAST(i - 1 AS VARCHAR) || '|' || z[i]), i) AS place
  FROM (SELECT *, unnest(range(1, len(z) + 1)) AS i FROM w))
SELECT conv_id, turn, string_agg(CASE WHEN place <= k THEN '[MASK]' ELSE word END, ' ' ORDER BY i) AS corrupted FROM h GROUP BY ALL""")
def corrupted_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.corrupt(F.col("text"), 5, 0.3).alias("corrupted"))


@query("""WITH b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'), j AS (SELECT a.o_orderkey AS x, b.o_orderkey AS y, a.o_totalprice = b.o_totalprice AS p, a.o_orderpriority = b.o_orderpriority AS q FROM orders a LEFT JOIN b USING (o_orderkey))
SELECT 'o_totalprice' AS field, count(*) FILTER (p) AS equal, count(*) FILTER (NOT p) AS different, count(*) FILTER (y IS NULL) AS only_one, count(*) FILTER (x IS NULL) AS only_two FROM j
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (q), count(*) FILTER (NOT q), count(*) FILTER (y IS NULL), count(*) FILTER (x IS NULL) FROM j""")
def build_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against a build without the pending ones, in which some prices changed."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    other = o.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return governance.compare_builds(o, other, ["o_orderkey"], ["o_totalprice", "o_orderpriority"])


@query(f"WITH {STREAM}, n AS (SELECT unit FROM s GROUP BY 1 HAVING bool_and(event_type <> 'error')) SELECT event_id, unit FROM s SEMI JOIN n USING (unit)")
def normal_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of units without any error."""
    s = stream(spark, sf_dir, False)
    good = s.groupBy("unit").agg(F.bool_and(F.col("event_type") != "error").alias("ok")).where("ok").select("unit")
    return s.join(good, "unit", "left_semi").select("event_id", "unit")


@query(f"""WITH {STREAM}, n AS (SELECT unit, bool_or(event_type = 'error') AS bad, count(*) AS k FROM s GROUP BY 1)
SELECT CAST(sum(k) AS BIGINT) AS authorised, CAST(sum(k) FILTER (NOT bad) AS BIGINT) AS emitted, CAST(sum(k) FILTER (bad) AS BIGINT) AS excluded, sum(k) = sum(k) FILTER (NOT bad) + sum(k) FILTER (bad) AS balanced FROM n""")
def canonical_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir, False)
    n = s.groupBy("unit").agg(F.bool_or(F.col("event_type") == "error").alias("bad"), F.count("*").alias("k"))
    t = n.agg(F.sum("k").alias("authorised"), F.sum(F.when(~F.col("bad"), F.col("k"))).alias("emitted"), F.sum(F.when(F.col("bad"), F.col("k"))).alias("excluded"))
    return t.withColumn("balanced", F.col("authorised") == F.col("emitted") + F.col("excluded"))


FOLDS = f"""{SEGMENTED}, ar AS (SELECT DISTINCT event_type AS t FROM s), ro(p, side, sg) AS (VALUES ('SOURCE_TRAIN', 'source', 0), ('SOURCE_VALIDATION', 'source', 2), ('TARGET_BURN_IN', 'target', 0), ('TARGET_EVALUATION', 'target', 2), ('TARGET_EVALUATION', 'target', 3)),
fm AS (SELECT 'LOAO-' || t AS fold_id, p AS "partition", seg.* FROM seg, ar, ro WHERE segment = sg AND ((side = 'target') = (event_type = t)))"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.fold_members(segmented(spark, sf_dir), "event_type")


@query(f"""WITH {FOLDS} SELECT fold_id, "partition", event_type AS architecture, count(*) AS records, min(rank) AS first_rank, max(rank) AS last_rank, count(DISTINCT message) AS messages FROM fm GROUP BY ALL""")
def fold_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).groupBy("fold_id", "partition", F.col("event_type").alias("architecture")).agg(
        F.count("*").alias("records"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.count_distinct("message").alias("messages")
    )


@query(f"""WITH {FOLDS}, a AS (SELECT fold_id, count(DISTINCT event_type) FILTER ("partition" = 'SOURCE_TRAIN') AS sources, count(DISTINCT event_type) FILTER ("partition" LIKE 'TARGET%') AS targets,
  max(effective_ts) FILTER ("partition" = 'TARGET_BURN_IN') AS b, min(effective_ts) FILTER ("partition" = 'TARGET_EVALUATION') AS e, count(*) FILTER (segment IN (1, 255)) AS g FROM fm GROUP BY 1)
SELECT fold_id, sources >= 3 AS enough_sources, targets = 1 AS one_target, b < e AS burn_in_before, g = 0 AS guard_unused FROM a""")
def fold_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    is_ = lambda p: F.col("partition") == p
    a = m.groupBy("fold_id").agg(
        F.count_distinct(F.when(is_("SOURCE_TRAIN"), F.col("event_type"))).alias("s"), F.count_distinct(F.when(F.col("partition").startswith("TARGET"), F.col("event_type"))).alias("t"),
        F.max(F.when(is_("TARGET_BURN_IN"), F.col("effective_ts"))).alias("b"), F.min(F.when(is_("TARGET_EVALUATION"), F.col("effective_ts"))).alias("e"), F.count_if(F.col("segment").isin(1, 255)).alias("g"),
    )
    return a.select("fold_id", (F.col("s") >= 3).alias("enough_sources"), (F.col("t") == 1).alias("one_target"), (F.col("b") < F.col("e")).alias("burn_in_before"), (F.col("g") == 0).alias("guard_unused"))


@query(f"""WITH {FOLDS}, o AS (SELECT fold_id, message, string_agg(DISTINCT "partition", ',' ORDER BY "partition") AS partitions, count(DISTINCT "partition") AS k FROM fm GROUP BY ALL) SELECT fold_id, message, partitions FROM o WHERE k > 1""")
def audit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.overlaps(_members(spark, sf_dir), ["fold_id", "message"]).select("fold_id", "message", F.array_join("partitions", ",").alias("partitions"))


@query(f"""WITH {FOLDS}, b AS (SELECT fold_id, count(*) FILTER (segment = 1) AS guard_used, count(*) - count(DISTINCT rank) AS repeated FROM fm GROUP BY 1),
i AS (SELECT fold_id, count(*) FILTER (effective_ts < above) AS inversions FROM (SELECT fold_id, effective_ts, lag(effective_ts) OVER (PARTITION BY fold_id, "partition", event_type ORDER BY rank) AS above FROM fm) GROUP BY 1)
SELECT fold_id, 'L04' AS check_id, CASE WHEN repeated = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, repeated AS observation FROM b
UNION ALL SELECT fold_id, 'L06', CASE WHEN inversions = 0 THEN 'PASS' ELSE 'FAIL' END, inversions FROM i UNION ALL SELECT fold_id, 'L16', CASE WHEN guard_used = 0 THEN 'PASS' ELSE 'FAIL' END, guard_used FROM b""")
def audit_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    i = previous(m, "effective_ts", F.col("rank").asc(), name="above", by=("fold_id", "partition", "event_type")).groupBy("fold_id").agg(F.count_if(F.col("effective_ts") < F.col("above")).alias("L06"))
    b = m.groupBy("fold_id").agg((F.count("*") - F.count_distinct("rank")).alias("L04"), F.count_if(F.col("segment") == 1).alias("L16"))
    told = b.join(i, "fold_id").select("fold_id", F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(k).alias("observation")) for k in ("L04", "L06", "L16")])).alias("c"))
    return told.select("fold_id", "c.check_id", F.when(F.col("c.observation") == 0, "PASS").otherwise("FAIL").alias("verdict"), "c.observation")


@query("""WITH a AS (SELECT DISTINCT text FROM documents WHERE source < 'src15'), b AS (SELECT DISTINCT text FROM documents WHERE source >= 'src15')
SELECT (SELECT count(*) FROM b) AS evaluation_distinct, (SELECT count(*) FROM b SEMI JOIN a USING (text)) AS shared, round((SELECT count(*) FROM b SEMI JOIN a USING (text)) / (SELECT count(*) FROM b), 9) AS ratio""")
def content_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return governance.content_overlap(d.where("source < 'src15'"), d.where("source >= 'src15'"), "text").withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH {FOLDS}, k AS (SELECT fold_id, count(*) FILTER ("partition" LIKE 'SOURCE%' AND substr(fold_id, 6) = event_type) AS l14, count(*) FILTER (segment = 1) AS l16 FROM fm GROUP BY 1),
o4 AS (SELECT fold_id, event_type, rank, list(DISTINCT "partition") AS ps FROM fm GROUP BY ALL HAVING len(ps) > 1), o5 AS (SELECT fold_id, event_type, unit, list(DISTINCT "partition") AS ps FROM fm GROUP BY ALL HAVING len(ps) > 1),
o2 AS (SELECT fold_id, message || '|' || CAST(value AS VARCHAR) AS h, list(DISTINCT "partition") AS ps FROM fm GROUP BY ALL), o3 AS (SELECT fold_id, message AS h, list(DISTINCT "partition") AS ps FROM fm GROUP BY ALL),
i AS (SELECT fold_id, count(*) FILTER (effective_ts < above) AS n FROM (SELECT fold_id, effective_ts, lag(effective_ts) OVER (PARTITION BY fold_id, "partition", event_type ORDER BY rank) AS above FROM fm) GROUP BY 1),
e AS (SELECT fold_id, event_type, max(effective_ts) FILTER ("partition" = 'SOURCE_TRAIN') AS a, min(effective_ts) FILTER ("partition" = 'SOURCE_VALIDATION') AS b, max(effective_ts) FILTER ("partition" = 'TARGET_BURN_IN') AS c, min(effective_ts) FILTER ("partition" = 'TARGET_EVALUATION') AS d FROM fm GROUP BY ALL),
r AS (SELECT fold_id, 'L01' AS check_id, CASE WHEN l14 > 0 THEN 1 ELSE 0 END AS observation FROM k UNION ALL SELECT fold_id, 'L14', l14 FROM k UNION ALL SELECT fold_id, 'L16', l16 FROM k
  UNION ALL SELECT fold_id, 'L02', (SELECT count(*) FROM o2 WHERE o2.fold_id = k.fold_id AND list_contains(ps, 'SOURCE_TRAIN') AND list_contains(ps, 'TARGET_EVALUATION')) FROM k
  UNION ALL SELECT fold_id, 'L03', (SELECT count(*) FROM o3 WHERE o3.fold_id = k.fold_id AND list_contains(ps, 'SOURCE_TRAIN') AND list_contains(ps, 'TARGET_EVALUATION')) FROM k
  UNION ALL SELECT fold_id, 'L04', (SELECT count(*) FROM o4 WHERE o4.fold_id = k.fold_id) FROM k UNION ALL SELECT fold_id, 'L05', (SELECT count(*) FROM o5 WHERE o5.fold_id = k.fold_id) FROM k
  UNION ALL SELECT fold_id, 'L06', n FROM i UNION ALL SELECT fold_id, 'L07', count(*) FILTER (a >= b) + count(*) FILTER (c >= d) FROM e GROUP BY 1
  UNION ALL SELECT fold_id, 'L08', (SELECT count(*) FROM o4 WHERE o4.fold_id = k.fold_id AND list_contains(ps, 'TARGET_BURN_IN') AND list_contains(ps, 'TARGET_EVALUATION')) FROM k)
SELECT fold_id, check_id, CASE WHEN check_id IN ('L02', 'L03') THEN 'INFORMATIONAL' WHEN observation = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, CAST(observation AS BIGINT) AS observation FROM r""")
def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All isolation checks that rows can decide."""
    m = _members(spark, sf_dir).withColumn("raw_h", F.concat_ws("|", "message", F.col("value").cast("string"))).withColumn("norm_h", F.col("message"))
    return governance.audit(m, "event_type")


@query("""WITH b AS (SELECT source, doc_id // 4096 AS block, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS d FROM documents GROUP BY ALL),
p AS (SELECT source || ':' || sha256(string_agg(d, ',' ORDER BY block)) AS x FROM b GROUP BY source) SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS fingerprint, count(*) AS files FROM p""")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ids in blocks, so that no cell holds all ids of a source."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    blocks = read(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 4096).alias("block")).agg(F.sha2(ids, 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), ",")
    p = blocks.groupBy("source").agg(F.concat(F.col("source"), F.lit(":"), F.sha2(joined, 256)).alias("x"))
    return p.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("fingerprint"), F.count("*").alias("files"))


@query("""SELECT event_id, 'EVT-' || sha256('events' || chr(0) || CAST(user_id AS VARCHAR) || chr(0) || event_type) AS record_id,
  sha256('{"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}') AS json_id FROM events""")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", identity.nul_joined_id("EVT-", F.lit("events"), F.col("user_id"), F.col("event_type")).alias("record_id"),
        F.sha2(identity.canonical_json(user_id=F.col("user_id"), event_type=F.col("event_type")), 256).alias("json_id"),
    )


@query("SELECT doc_id, 'old' AS origin FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'new' FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def keyed_union_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("old").alias("origin"))
    new = read(spark, sf_dir, "documents").select("doc_id", F.lit("new").alias("origin"))
    return sampling.keyed_union(old, new, ["doc_id"])


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").distinct()


@query("SELECT true AS same, false AS changed")
def frame_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    b = a.repartition(3)
    changed = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") > 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return spark.createDataFrame([(governance.same_rows(a, b), governance.same_rows(a, changed))], "same boolean, changed boolean")


@query("SELECT doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id)")
def join_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return governance.one_to_one(d, read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "toxic")


@query("SELECT DISTINCT o_custkey AS key FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 0) USING (o_custkey)")
def foreign_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.foreign_keys(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query(f"WITH {STREAM}, x AS (SELECT DISTINCT unit FROM s WHERE event_type = 'purchase') SELECT event_id FROM s ANTI JOIN x USING (unit)")
def unit_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir, False)
    return s.join(s.where("event_type = 'purchase'").select("unit").distinct(), "unit", "left_anti").select("event_id")


@query("SELECT o_orderkey, CASE WHEN n_regionkey IS NULL THEN -1 ELSE n_regionkey END AS stratum FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def line_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("o_orderkey", F.coalesce("n_regionkey", F.lit(-1)).alias("stratum"))


@query("""SELECT doc_id, string_agg(r, ',' ORDER BY r) AS violations FROM (
  SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN NOT regexp_matches(text, '[.]$') THEN 'open_end' END], lambda x: x IS NOT NULL)) AS r FROM documents) GROUP BY 1""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"long": F.col("n_chars") <= 5000, "foreign": F.col("lang") == "en", "open_end": F.col("text").rlike(r"[.]\z")}
    v = governance.violations(read(spark, sf_dir, "documents"), rules).where(F.size("violations") > 0)
    return v.select("doc_id", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query("""WITH all_tr AS (SELECT p_name FROM part WHERE p_size <= 25 UNION ALL SELECT p_name FROM part WHERE p_size <= 9), tr AS (SELECT p_name AS p_partkey, p_name FROM (SELECT DISTINCT p_name FROM all_tr)), te AS (SELECT p_partkey, p_name FROM part WHERE p_size > 25),
w1 AS (SELECT p_partkey AS id, word, count(*) AS tf FROM (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '\\s+')) AS word FROM tr) WHERE word <> '' GROUP BY ALL),
w2 AS (SELECT p_partkey AS id, word, count(*) AS tf FROM (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '\\s+')) AS word FROM te) WHERE word <> '' GROUP BY ALL),
n AS (SELECT count(*) AS n FROM tr), f AS (SELECT word, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM w1, n GROUP BY 1),
x1 AS (SELECT id, word, tf * idf AS w FROM w1 JOIN f USING (word)), x2 AS (SELECT id, word, tf * idf AS w FROM w2 JOIN f USING (word)),
y1 AS (SELECT id, word, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x1), y2 AS (SELECT id, word, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x2),
c AS (SELECT y2.id, y1.id AS o, sum(y1.w * y2.w) AS c FROM y2 JOIN y1 USING (word) GROUP BY ALL), m AS (SELECT id, max(c) AS c FROM c GROUP BY 1)
SELECT p_partkey, round(1 - coalesce(c, 0), 7) AS novelty FROM te LEFT JOIN m ON id = p_partkey""")
def knn_tfidf_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some training texts come twice; distinct ones count."""
    p = read(spark, sf_dir, "part")
    out = detect.knn_novelty(p.where("p_size <= 25").unionByName(p.where("p_size <= 9")), p.where("p_size > 25"), "p_partkey", "p_name")
    return out.select("p_partkey", F.round("novelty", 7).alias("novelty"))


@query("""WITH p AS (SELECT 'RETAINED' AS population, doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT 'PURGED', doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT population, count(*) AS units, CAST(sum(toxic) AS BIGINT) AS anomalies, round(avg(toxic), 9) AS prevalence, quantile_cont(n_chars, 0.5) AS median_size, quantile_cont(n_chars, 0.99) AS q99_size FROM p GROUP BY 1""")
def purge_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("population", F.when(F.col("quality") == 1, "RETAINED").otherwise("PURGED"))
    told = j.groupBy("population").agg(F.count("*").alias("units"), F.sum("toxic").alias("anomalies"), F.round(F.avg("toxic"), 9).alias("prevalence"))
    return told.join(quantiles(j, "n_chars", {"median_size": 0.5, "q99_size": 0.99}, ("population",)), "population")


@query(f"""WITH {SEGMENTED} SELECT 'buffer' AS part, count(*) AS records, count(DISTINCT unit) AS units, count(DISTINCT message) AS messages FROM seg WHERE segment = 0
UNION ALL SELECT 'evaluation', count(*), count(DISTINCT unit), count(DISTINCT message) FROM seg WHERE segment = 3""")
def target_view_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segmented(spark, sf_dir).where("segment in (0, 3)")
    return s.groupBy(F.when(F.col("segment") == 0, "buffer").otherwise("evaluation").alias("part")).agg(F.count("*").alias("records"), F.count_distinct("unit").alias("units"), F.count_distinct("message").alias("messages"))
