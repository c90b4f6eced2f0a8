"""Quality rules: a threshold table compiled into one Spark projection.

Only built-in expressions are used; there is no shuffle and no user function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.base import SPACE_CLASS, words_of

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in that is was for it with as on be at by this are from or",
    "de": "der die das und in zu den von mit ist des sich auf für im dem nicht ein eine als",
    "fr": "le la les de des et un une du en est que qui dans pour pas sur au avec par",
    "es": "el la los las de y que en un una es del por con para no se su al como",
}
#: (rule, left part, its factor, comparison, right part, its factor): whole numbers, so no rounding decides.
THRESHOLDS = (
    ("short_words", "word_chars", 10, ">=", "n_words", 15),
    ("long_words", "word_chars", 1, "<=", "n_words", 20),
    ("symbols", "n_symbols", 10, "<=", "n_words", 1),
    ("stop_words", "n_stop_words", 50, ">=", "n_words", 1),
    ("dup_lines", "n_dup_lines", 2, "<=", "n_lines", 1),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


#: Bits for a word's place beside a window's hash.
PLACE_BITS = 24
PLACE_MASK = (1 << PLACE_BITS) - 1


def _positions(pairs: Column, place) -> Column:
    """Words in the windows of the pairs."""
    at = F.transform(pairs, lambda z: F.array(*[place(z[side]) + k for side in ("x", "y") for k in range(3)]))
    return F.size(F.array_distinct(F.flatten(at)))


def _hashed_pairs(w: Column, n: Column) -> Column:
    """Neighbours of equal hash after a sort of (hash, place), both packed in a long."""
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~PLACE_MASK)).bitwiseOR(i.cast("long")),
    )
    return F.when((n >= 4) & (n <= PLACE_MASK), F.sort_array(packed))


def _exact(w: Column, n: Column) -> Column:
    """The same count by a sort of the words themselves: for texts where two windows share a hash, or very long ones."""
    zipped = F.arrays_zip(w.alias("w0"), F.slice(w, F.lit(2), n).alias("w1"), F.slice(w, F.lit(3), n).alias("w2"), F.sequence(F.lit(0), n - 1).alias("place"))

    def count(ordered: Column) -> Column:
        near = F.arrays_zip(F.slice(ordered, F.lit(2), F.size(ordered)).alias("y"), ordered.alias("x"))
        same = F.filter(near, lambda z: reduce(Column.__and__, [z["x"][k] == z["y"][k] for k in ("w0", "w1", "w2")]))
        return _positions(same, lambda z: z["place"])

    return F.transform(F.array(F.sort_array(F.slice(zipped, F.lit(1), n - 2))), count)[0]


def measure(docs: DataFrame) -> DataFrame:
    """The parts of every ratio for each row of ``(doc_id, text)``.

    A null text is an empty one. Words are runs of anything but a space and the
    characters from tab to carriage return; lines are split at ``\\n`` and count
    if they hold a word; a line is a duplicate if an earlier line equals it.
    Repeated rows and null ids are kept as they are; other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), words_of(F.col("text")).alias("w"))
    n = F.size("w")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    stop = sorted({x for words in STOP_WORDS.values() for x in words.split()})
    parts = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
        lines.alias("lines"),
        "w",
        _hashed_pairs(F.col("w"), n).alias("ordered"),
    )
    near = F.arrays_zip(F.slice("ordered", F.lit(2), F.size("ordered")).alias("y"), F.col("ordered").alias("x"))
    paired = parts.withColumn("pairs", F.filter(near, lambda z: F.shiftright(z["x"], PLACE_BITS) == F.shiftright(z["y"], PLACE_BITS)))
    word = lambda z, side, k: F.col("w")[z[side].bitwiseAND(F.lit(PLACE_MASK)).cast("int") + k]
    alike = F.forall("pairs", lambda z: reduce(Column.__and__, [word(z, "x", k) == word(z, "y", k) for k in range(3)]))
    found = F.col("n_words") >= 4
    repeats = (
        F.when(found & F.coalesce(alike, F.lit(False)), _positions(F.col("pairs"), lambda z: z.bitwiseAND(F.lit(PLACE_MASK))))
        .when(found, _exact(F.col("w"), F.size("w")))
        .otherwise(0)
    )
    return paired.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        "n_stop_words",
        F.size("lines").cast("long").alias("n_lines"),
    )


def rule_columns(thresholds=THRESHOLDS) -> dict[str, Column]:
    """One boolean column for each row of the threshold table."""
    out = {}
    for name, left, by, sign, right, times in thresholds:
        a, b = F.col(left) * by, F.col(right) * times
        out[name] = a >= b if sign == ">=" else a <= b
    return out


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Measures, base verdict, the table's verdict and the names of the failed rules.

    ``base_failed`` is fewer than 50 words, or more than half of the words inside
    repeated 3-word windows. ``kept`` needs the base and every rule of the table.
    """
    rules = rule_columns(thresholds)
    failed_base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    named = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return measure(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed_base.alias("base_failed"),
        (~failed_base & reduce(Column.__and__, rules.values())).alias("kept"),
        "n_stop_words",
        "n_lines",
        F.array_join(named, ",").alias("failed_rules"),
    )


def oracle() -> str:
    """The same in DuckDB SQL."""
    stop = ",".join("'" + x + "'" for x in sorted({x for words in STOP_WORDS.values() for x in words.split()}))
    rules = {name: f"{left}*{by} {sign} {right}*{times}" for name, left, by, sign, right, times in THRESHOLDS}
    names = ",".join(f"CASE WHEN NOT ({x}) THEN '{name}' END" for name, x in rules.items())
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM base WHERE len(w) >= 3),
win AS (SELECT rid, p, w[p] AS a, w[p+1] AS b, w[p+2] AS c FROM pos),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM win) WHERE k >= 2),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, p + unnest([0, 1, 2]) AS q FROM rep) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM base),
m AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM base b JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(rules.values())}) AS kept, n_stop_words, n_lines,
       array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM f"""
