"""Line dedup by winnowing over line hashes.

A window is the shortest run of lines, from a line on or up to a line, of at least
``LEAST_WORDS`` words. Of each window the line with the smallest hash is selected, the last
of equal ones; the selected lines are the fingerprints. Any run of that many words that two places share
contains a whole window, so both places select the same line of it. Positions are
joined by fingerprint; a position that shares its fingerprint is extended both ways by the
windows that selected it, which know all their lines by a 128-bit digest. Windows of equal
lines are grouped, each group's earliest place is found, and the others, merged where they
overlap, are the match as far as it goes. The lines of every later place are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import base
from logloom.llm.base import PLAIN, fresh, group_join, mix, named, row_chunks, schema, small_batches, string_bytes, tokens
from logloom.operators.lineage import cut_lineage

LEAST_WORDS = 50
#: Lines end at a newline only.
LINES = base.byte_table(b"\n")
_B = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def fingerprints(data: np.ndarray, offsets: np.ndarray, least: int = LEAST_WORDS) -> dict[str, np.ndarray]:
    """All windows of the rows by the line that each selects: row, that line and its hash, first and last line, two digests.

    Lines are counted from 0, blank ones too; ``line`` counts those with a word, over all rows.
    """
    line, row, begin, end = tokens(data, offsets, LINES)
    none = {k: np.zeros(0, np.int64) for k in ("row", "line", "low", "first", "last", "d1", "d2")}
    if not len(line):
        return none
    second = _second(data, begin, end)
    words = tokens(data, offsets, PLAIN)[2]
    count = np.bincount(np.searchsorted(begin, words, "right") - 1, minlength=len(line)) if len(words) else np.zeros(len(line), np.int64)
    some = count > 0
    line, second, row, begin, count = line[some], second[some], row[some], begin[some], count[some]
    if not len(line):
        return none
    newlines = np.concatenate(([0], np.cumsum(data == 10)))
    number = newlines[begin] - newlines[offsets[row]]
    upto = np.concatenate(([0], np.cumsum(count)))
    head, tail = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right") - 1
    at = np.arange(len(line))
    last = np.searchsorted(upto, upto[:-1] + least, "left") - 1
    first = np.searchsorted(upto, upto[1:] - least, "right") - 1
    forward, backward = (last <= tail), (first >= head)
    i = np.concatenate((at[forward], first[backward]))
    j = np.concatenate((last[forward], at[backward]))
    pair = np.unique(i * (len(line) + 1) + j)
    i, j = pair // (len(line) + 1), pair % (len(line) + 1)
    if not len(i):
        return none
    edges = np.stack((i, j + 1), axis=1).ravel()
    padded = np.append(line, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = np.minimum.reduceat(padded, edges)[::2]
    power, back = _powers(_B, len(line)), _powers(_INVERSE, len(line))
    digest = []
    with np.errstate(over="ignore"):
        for hashed in (line, second):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashed) * power, dtype=np.uint64)))
            digest.append(mix((total[j + 1] - total[i]) * back[i] + (j - i + 1).astype(np.uint64)))
    # the last line of the window with the smallest hash: places by hash, then by order
    value, place = np.unique(line, return_inverse=True)
    keyed = place * (len(line) + 1) + at
    by_hash = np.sort(keyed)
    chosen = by_hash[np.searchsorted(by_hash, np.searchsorted(value, low) * (len(line) + 1) + j, "right") - 1] % (len(line) + 1)
    order = np.argsort(chosen, kind="stable")
    signed = [x.view(np.int64)[order] for x in (low, *digest)]
    return dict(zip(none, (row[i][order], chosen[order], signed[0], number[i][order], number[j][order], *signed[1:]), strict=True))


def _second(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash of each line, from sums over byte places with other factors."""
    size = end - begin
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    place = at - np.repeat(begin, size)
    head = np.concatenate(([0], np.cumsum(size)[:-1]))
    with np.errstate(over="ignore"):
        value = mix(data[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)))
        return np.add.reduceat(value, head)


WINDOWS = "array<struct<first:int,last:int,d1:bigint,d2:bigint>>"


def _selected(least: int):
    """A row for each selected line, with the windows that selected it."""

    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(2))
            for i, j in row_chunks(offsets):
                found = fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least)
                head = np.flatnonzero(np.append(True, np.diff(found["line"]) > 0)[: len(found["line"])])
                take = pa.array(found["row"][head] + i, pa.int64())
                parts = [pa.array(found[k], kind) for k, kind in (("first", pa.int32()), ("last", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()))]
                windows = pa.ListArray.from_arrays(pa.array(np.append(head, len(found["line"])), pa.int32()), pa.StructArray.from_arrays(parts, ["first", "last", "d1", "d2"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found["low"][head], pa.int64()), windows], names=["doc_id", "th", "fp", "windows"])

    return run


def selected(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, th, fp, windows``: the fingerprints of ``(doc_id, text)``, a row for each selected line."""
    small_batches(docs.sparkSession)
    told = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return told.mapInArrow(_selected(least), schema(docs, "doc_id", th="bigint", fp="bigint", windows=WINDOWS))


def repeated_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, th, rows``: the lines to delete, for each (id, text hash) that has any.

    A window's earliest place is the least of (id, text hash, line), a null id first. A
    window that begins inside its own earlier copy gives up only the lines after that.
    """
    found = cut_lineage(selected(docs, least))
    shared = cut_lineage(found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"))
    # extension: all windows around the joined positions, known by their whole lines
    near = cut_lineage(group_join(found, shared, ["fp"], "n").select("doc_id", "th", F.inline("windows")))
    key = ["d1", "d2"]
    place = F.struct("doc_id", "th", "first")
    origin = near.groupBy(*key).agg(F.min(place).alias("o"), F.max(place).alias("z"), F.count("*").alias("n")).where("o <> z")
    later = group_join(near, cut_lineage(origin.select(*key, "o", "n")), key, "n").where(~place.eqNullSafe(F.col("o")))
    same = F.col("doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("th") == F.col("o.th"))
    size = F.col("last") - F.col("first")
    begin = F.when(same, F.greatest("first", F.col("o.first") + size + 1)).otherwise(F.col("first"))
    ranges = later.select("doc_id", "th", begin.alias("begin"), "last").where("begin <= last")
    lines = F.array_distinct(F.flatten(F.collect_list(F.sequence("begin", "last"))))
    return ranges.distinct().groupBy("doc_id", "th").agg(lines.alias("rows"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the numbered lines."""

    def body(z: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(z) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: z[i]), "\n")

    return F.transform(F.array(F.split(text, "\n", -1)), body)[0]


def dedup(docs: DataFrame, least: int = LEAST_WORDS, counts: tuple[str, str] | None = ("n_lines", "n_deleted")) -> DataFrame:
    """All columns of ``docs``, with later repeats gone from ``text``, and the numbers of lines and of deleted ones.

    A run of lines is a repeat if it has at least ``least`` words and its lines, blank ones
    left out, stand in the same order at an earlier place: in a document with a
    smaller id (a null one first), or higher up in the same one. Rows equal in id and text are one
    document and stay alike. A null text stays null; a text of which nothing is
    left becomes empty, and its row stays. An empty table stays empty. Of a very long text only the
    deleted lines' numbers and its windows are held beside it. Columns of ``docs`` may have any names; one that is named like a count is
    replaced by it, and without ``counts`` there are none.
    """
    names = docs.columns
    id_, th, rows = fresh(names, "id", "th", "rows")
    gone = repeated_lines(docs.select("doc_id", "text"), least).toDF(id_, th, rows)
    match = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th))
    joined = docs.join(gone, match, "left")
    text = F.when(F.col(rows).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(rows)))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    told = [F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long"), F.coalesce(F.size(rows), F.lit(0)).cast("long")]
    new = {n.lower() for n in counts or ()}
    return joined.select(
        *[(text if c.lower() == "text" else named(c)).alias(c) for c in names if c.lower() not in new],
        *[c.alias(n) for c, n in zip(told, counts or (), strict=False)],
    )


def oracle() -> str:
    """The same in DuckDB SQL, by the lines themselves; ids are unique there."""
    words = r"len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))"
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS z FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, k, line, {words} AS n FROM (SELECT doc_id, unnest(range(0, len(z))) AS k, unnest(z) AS line FROM d)),
l AS (SELECT *, row_number() OVER w AS r, sum(n) OVER w AS upto FROM a WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT DISTINCT doc_id, r1, r2 FROM (
  SELECT x.doc_id, x.r AS r1, min(y.r) AS r2 FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.r >= x.r AND y.upto - x.upto + x.n >= {LEAST_WORDS} GROUP BY ALL
  UNION ALL SELECT y.doc_id, max(x.r), y.r FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.r >= x.r AND y.upto - x.upto + x.n >= {LEAST_WORDS} GROUP BY ALL)),
p AS (SELECT doc_id, list(line ORDER BY r) AS z, list(k ORDER BY r) AS ks FROM l GROUP BY 1),
v AS (SELECT doc_id, r1, r2, ks[r1] AS first, ks[r2] AS last, md5(array_to_string(z[r1:r2], chr(10))) AS key FROM w JOIN p USING (doc_id)),
o AS (SELECT key, min({{'doc_id': doc_id, 'first': first, 'last': last}}) AS o FROM v GROUP BY 1),
g AS (SELECT v.doc_id, CASE WHEN v.doc_id = o.o.doc_id THEN greatest(first, o.o.first + last - first + 1) ELSE first END AS begin, last
      FROM v JOIN o USING (key) WHERE v.doc_id <> o.o.doc_id OR v.first <> o.o.first),
k AS (SELECT DISTINCT doc_id, unnest(range(begin, last + 1)) AS k FROM g WHERE begin <= last),
t AS (SELECT a.doc_id, coalesce(string_agg(line, chr(10) ORDER BY a.k) FILTER (k.k IS NULL), '') AS text, count(k.k) AS gone FROM a LEFT JOIN k ON a.doc_id = k.doc_id AND a.k = k.k GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(t.gone, 0) AS n_deleted, t.text FROM documents d LEFT JOIN t USING (doc_id)"""
