"""Secret scans with an incremental ledger of content-addressed blobs.

Only DataFrame operations and built-in functions are used. A blob is the SHA-256
of a text; the ledger is a Parquet table with a row for each (blob, rule version) that was ever
scanned. A run scans the blobs without such a row, each once however many paths
hold it, appends them to the ledger, and joins the ledger's spans back to all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.lineage import cut_lineage

RULE_VERSION = "3"
#: (kind, cheap test that every match implies, pattern, group whose length counts, least length).
#: The first three are the base kinds; their order is the order of equal starts.
RULES = (
    ("assign", None, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", None, r"[0-9a-f]{32,}", 0, 32),
    ("github", "_", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", "xox", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", "eyJ", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("pem", "PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("url", "://", r"://[^\x20\x09-\x0D:/@]++:[^\x20\x09-\x0D:/@]++@", 0, 7),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"
#: Lengths are summed in blocks, and blocks in larger ones: a match costs two blocks and the number of the largest.
BLOCK = 256


def _spans(text: Column, ordinal: int, kind: str, needle: str | None, pattern: str, group: int, least: int) -> Column:
    """All spans of one kind as (start, ord, end, kind), in code points, end exclusive.

    The text between matches and the matches give every start by addition.
    """
    p = F.lit(pattern)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    part_of = lambda xs, size: F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / size).cast("int")), lambda b: total(F.slice(xs, b * size + 1, F.lit(size))))

    def place(z: Column) -> Column:
        match, part, lens = z["match"], z["part"], z["lens"]

        def with_blocks(sums: Column) -> Column:
            def one(g: Column, i: Column) -> Column:
                block, large = F.floor(i / BLOCK).cast("int"), F.floor(i / (BLOCK * BLOCK)).cast("int")
                before = total(F.slice(sums["large"], F.lit(1), large))
                before += total(F.slice(sums["small"], large * BLOCK + 1, block - large * BLOCK)) + total(F.slice(lens, block * BLOCK + 1, i - block * BLOCK))
                start = before + F.length(part[i])
                return F.struct(
                    start.alias("start"), F.lit(ordinal).alias("ord"), (start + F.length(match[i])).alias("end"), F.lit(kind).alias("kind"), F.length(g).alias("n")
                )

            return F.transform(z["group"], one)

        both = F.transform(F.array(part_of(lens, BLOCK)), lambda x: F.struct(x.alias("small"), part_of(x, BLOCK).alias("large")))
        return F.transform(both, with_blocks)[0]

    found = F.struct(
        F.regexp_extract_all(text, p, F.lit(0)).alias("match"),
        F.split(text, pattern, -1).alias("part"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("group"),
    )
    with_lens = F.transform(
        F.array(found),
        lambda z: F.struct(
            z["match"].alias("match"), z["part"].alias("part"), z["group"].alias("group"),
            F.transform(z["match"], lambda m, i: F.length(m) + F.length(z["part"][i])).alias("lens"),
        ),
    )
    placed = F.transform(with_lens, place)[0]
    kept = F.transform(
        F.filter(placed, lambda s: s["n"] >= least),
        lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    test = text.rlike(pattern) if needle is None else F.contains(text, F.lit(needle)) & text.rlike(pattern)
    return F.when(test, kept).otherwise(F.array().cast(SPAN))


def spans(text: Column, rules=RULES) -> Column:
    """All spans of a text, by start and then by the order of the rules."""
    return F.sort_array(F.concat(*[_spans(text, i, *rule) for i, rule in enumerate(rules)]))


def _unseen(versions: DataFrame, seen: DataFrame | None, rule_version: str) -> DataFrame:
    """``blob, rule_version, spans`` of the blobs of ``(path, blob, text)`` that ``seen (blob)`` lacks, each scanned once."""
    # one path per blob stands for the text, so only that row's text is moved
    blobs = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if seen is not None:
        blobs = blobs.join(seen, "blob", "left_anti")
    chosen = blobs.select(F.col("path").alias("chosen"), F.col("blob").alias("chosen_blob")).hint("shuffle_hash")
    texts = versions.select("path", "text").join(chosen, F.col("path").eqNullSafe(F.col("chosen"))).where(F.sha2("text", 256) == F.col("chosen_blob"))
    scanned = texts.select(F.col("chosen_blob").alias("blob"), spans(F.col("text")).alias("spans"))
    return scanned.dropDuplicates(["blob"]).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def _named(versions: DataFrame) -> DataFrame:
    return versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan ``(path, text)`` and return ``(findings, ledger)``.

    ``findings`` has ``path, blob, spans`` for every input row; ``ledger`` the
    given rows and one for each newly scanned blob, for the next run. A null text
    is an empty one; a null path is a path like any other; a row given twice
    comes out twice; an empty table has no findings. Other columns of ``versions`` are ignored, whatever
    their names. A text is scanned as a whole.
    """
    named = _named(versions)
    seen = None if ledger is None else ledger.where(F.col("rule_version") == rule_version).select("blob")
    fresh = cut_lineage(_unseen(named, seen, rule_version))
    book = fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    return _findings(named, book, rule_version), book


def scan_into(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """The findings of :func:`scan`, with the ledger as a Parquet table at ``ledger``, in storage that executors share.

    What the table lacks is scanned and appended in one commit, so a failed run leaves it as it was;
    the findings are read from it. Two runs at once may both append a blob; its rows are equal.
    """
    spark, named = versions.sparkSession, _named(versions)
    found = f"blob string, rule_version string, spans {SPAN}"
    spark.createDataFrame([], found).write.mode("append").parquet(ledger)  # there from the first run on
    seen = spark.read.schema(found).parquet(ledger).where(F.col("rule_version") == rule_version).select("blob").distinct()
    _unseen(named, seen, rule_version).write.mode("append").parquet(ledger)
    book = spark.read.schema(found).parquet(ledger).dropDuplicates(["blob", "rule_version"])
    return _findings(named, book, rule_version)


def _findings(named: DataFrame, book: DataFrame, rule_version: str) -> DataFrame:
    current = book.where(F.col("rule_version") == rule_version).select("blob", "spans")
    return named.select("path", "blob").join(current, "blob", "left").select("path", "blob", "spans")


def digest(findings: DataFrame) -> DataFrame:
    """The contract's columns from ``path, spans``."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_KINDS))
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")
    return findings.select(
        F.col("path").alias("doc_id"),
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    """The same in DuckDB SQL, without the ledger: it only saves work."""
    parts = []
    for i, (kind, _, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''").replace("}+", "}").replace("++", "+")  # possessive or not, the matches are the same
        parts.append(f"""
SELECT rid, {i} AS ord, '{kind}' AS kind, s AS start, s + length(m[i]) AS stop FROM (
  SELECT *, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s FROM (
    SELECT rid, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS p, regexp_extract_all(t, '{p}', {group}) AS g
      FROM d WHERE regexp_matches(t, '{p}')))) WHERE length(g[i]) >= {least}""")
    union = " UNION ALL ".join(parts)
    item = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({union}),
a AS (SELECT rid, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2,
        string_agg({item}, ',' ORDER BY start, ord) FILTER (ord < 3) AS b, string_agg({item}, ',' ORDER BY start, ord) AS w FROM s GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(w, '') AS spans FROM d LEFT JOIN a USING (rid)"""
