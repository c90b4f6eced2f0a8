"""Benchmark decontamination by a broadcast set of normalised n-grams.

Words are runs of ASCII letters, digits and all that is not ASCII, with A-Z in
lower case. A window is ``n`` consecutive words of an item, or a whole item of
fewer words. The windows of the benchmark are sorted 64-bit hashes that point into one byte buffer of
normalised words. Windows of the corpus are compared by the same rolling hash in
numpy, and each hit is verified by its words. The set is broadcast in blocks of a
bounded number of windows; a few blocks are scanned in one pass, and a benchmark of more of
them costs one more pass over the corpus for each few, not more memory.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.base import ALNUM, fresh, map_rows, mix, named, row_chunks, small_batches, string_bytes, tokens
from logloom.operators.lineage import cut_lineage

N = 10
#: Windows that one broadcast may hold, at 28 bytes each, and bytes of their words.
MAX_WINDOWS, MAX_BYTES = 1 << 20, 16 << 20
#: Blocks that one pass over the corpus scans; each is held by a worker of its own.
AT_ONCE = 4


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode().translate(_TRANSLATE).split()


_TRANSLATE = bytes(int(x) if x else 32 for x in ALNUM)
_P = np.uint64(0xD6E8FEB86659FD93)


def _rolling(hashed: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = hashed[: len(hashed) - size + 1].copy()
        for k in range(1, size):
            out = out * _P + hashed[k : len(hashed) - size + 1 + k]
    return mix(out)


@dataclass
class Grams:
    """Windows of some benchmark items: by length in words, sorted hashes, the windows' places in ``words``, and their items' numbers."""

    words: bytes
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    ids: list[str | None]

    def __post_init__(self):
        self.bits = {}
        for size, (known, *_) in self.tables.items():
            self.bits[size] = np.zeros(1 << 20, bool)
            self.bits[size][known >> np.uint64(44)] = True

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[int]]]]:
        """Words of each row, and for rows with hits the byte ranges of hit words and the items' numbers."""
        hashed, row, begin, end = tokens(data, offsets, ALNUM)
        count = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
        marked, items = np.zeros(len(hashed), bool), defaultdict(set)
        for size, (known, start, stop, item) in self.tables.items():
            if len(hashed) < size:
                continue
            value = _rolling(hashed, size)
            at = np.flatnonzero(self.bits[size][value >> np.uint64(44)])
            at = at[row[at] == row[at + size - 1]]
            low = np.searchsorted(known, value[at])
            high = np.searchsorted(known, value[at], "right")
            some = np.flatnonzero(high > low)
            for i, j, k in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                own = b" ".join(bytes(data[begin[i] : end[i + size - 1]]).translate(_TRANSLATE).split())
                who = [int(item[x]) for x in range(j, k) if self.words[start[x] : stop[x]] == own]
                if who:
                    marked[i : i + size] = True
                    items[int(row[i])].update(who)
        out = {}
        if items:
            hit = np.flatnonzero(marked)
            for r, who in items.items():
                own = hit[np.searchsorted(row[hit], r) : np.searchsorted(row[hit], r, "right")]
                out[r] = (list(zip(begin[own].tolist(), end[own].tolist(), strict=True)), who)
        return count, out


def gram_blocks(items: Iterable[tuple[str | None, str | None]], n: int = N, windows: int | None = None, text_bytes: int | None = None) -> Iterator[Grams]:
    """Blocks of at most ``windows`` windows, and of about ``text_bytes`` bytes of words (a longer window is its own block).

    An item's windows may lie in several blocks. There is one empty block where there are no windows.
    """
    windows, text_bytes = windows or MAX_WINDOWS, text_bytes or MAX_BYTES
    words, ids, held, free, tables = [], [], 0, windows, defaultdict(list)

    def block() -> Grams:
        done = {}
        for size, parts in tables.items():
            value, start, stop, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(value, kind="stable")
            done[size] = (value[order], start[order], stop[order], item[order])
        return Grams(b" ".join(words), done, ids)

    for name, text in items:
        whole = normal_words(text)
        size, first = min(n, len(whole)), 0
        while size and first + size <= len(whole):
            if not free or held >= text_bytes:
                yield block()
                words, ids, held, free, tables = [], [], 0, windows, defaultdict(list)
            # as many windows as the block has room for, a part of the words at a time
            take = min(free, len(whole) - size + 1 - first, 1 << 16)
            joined = np.frombuffer(b" ".join(whole[first : first + take + size - 1]), np.uint8)
            hashed, _, begin, end = tokens(joined, np.array([0, len(joined)]), ALNUM)
            value = _rolling(hashed, size)
            ids.append(name)
            tables[size].append((value, held + begin[:take], held + end[size - 1 :], np.full(take, len(ids) - 1, np.int32)))
            words.append(joined.tobytes())
            held += len(joined) + 1
            free -= take
            first += take
    yield block()


def benchmark_items(benchmark: DataFrame) -> Iterator[tuple[str | None, str | None]]:
    """Ids as strings and texts; the driver holds a part of the benchmark at a time."""
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        yield row[0], row[1]


FOUND = ("n_all", "places", "items")


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, names: tuple[str, str, str] = FOUND) -> DataFrame:
    """All columns of ``docs`` and, after them, three of the given names; columns that have these names are replaced.

    The first counts the words of the text; the second has the UTF-8 byte range
    (begin, end, begin, end, ...) of each word inside an occurrence of a window;
    the third the distinct item ids of such windows as strings in string order, and a null last if an item without an id has one. Null
    or wordless texts and an empty benchmark have no hits; items that differ only
    in id are separate items; a third of the items may be copies.
    Repeated rows come out repeated, an empty table stays empty, other columns may have any names. Nothing is shuffled; a very long text
    is held once with some 60 bytes for each of its words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select(*[named(c) for c in docs.columns if c.lower() not in {x.lower() for x in names}])
    added = list(zip(names, (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())), strict=True))
    at = [c.lower() for c in out.columns].index("text")
    blocks, k = gram_blocks(benchmark_items(benchmark), n), 0
    while some := list(islice(blocks, AT_ONCE)):
        if k:
            out = cut_lineage(out)  # the workers of the blocks before are gone
        for block in some:
            out = map_rows(out, _mapper(spark.sparkContext.broadcast(block), at, k > 0), added, 3 if k else 0)
            k += 1
    return out


def without_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` without any hit, with the columns of ``docs``, whatever their names.

    Null and empty texts stay, repeated rows stay repeated, an empty table or benchmark drops nothing; see :func:`find` for long texts.
    """
    names = tuple(fresh(docs.columns, *FOUND))
    return find(docs, benchmark, n, names).where(F.size(names[1]) == 0).drop(*names)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with every hit word, and what stands between neighbouring hit words, cut out of its text.

    Columns are those of ``docs``, whatever their names; null and empty texts and repeated rows stay as they are; see :func:`find` for long texts.
    """
    names = tuple(fresh(docs.columns, *FOUND))
    found = find(docs, benchmark, n, names)
    at = [c.lower() for c in docs.columns].index("text")

    def cut(batches):
        for batch in batches:
            texts = []
            for text, places in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True):
                if places:
                    raw, kept, last = text.encode(), [], 0
                    for begin, end in zip(places[::2], places[1::2], strict=True):
                        between = raw[last:begin]
                        if last == 0 or between.translate(_TRANSLATE).split():
                            kept.append(between)
                        last = end
                    text = (b"".join(kept) + raw[last:]).decode()
                texts.append(text)
            columns = batch.columns[:-3]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield columns

    return map_rows(found, cut, [], 3)


_CACHE: dict = {}


def _mapper(shared, text_at: int, more: bool):
    """Scan with one block; from the second block on, add to what the earlier ones found."""
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _CACHE:  # a worker serves many tasks
            _CACHE.clear()
            _CACHE[key] = shared.value
        grams = _CACHE[key]
        for batch in batches:
            data, offsets = string_bytes(batch.column(text_at))
            total, places, items = [], [], []
            old_places = batch.column(batch.num_columns - 2).to_pylist() if more else None
            old_items = batch.column(batch.num_columns - 1).to_pylist() if more else None
            for i, j in row_chunks(offsets):
                base = offsets[i]
                count, hits = grams.scan(data[base : offsets[j]], offsets[i : j + 1] - base)
                total.extend(count.tolist())
                for r in range(j - i):
                    ranges, who = hits.get(r, ((), ()))
                    start = int(offsets[i + r] - base)
                    at = [x - start for pair in ranges for x in pair]
                    ids = {grams.ids[w] for w in who}
                    if more:
                        old = old_places[i + r]
                        pairs = sorted(set(zip(at[::2], at[1::2], strict=True)) | set(zip(old[::2], old[1::2], strict=True)))
                        at = [x for pair in pairs for x in pair]
                        ids.update(old_items[i + r])
                    places.append(at)
                    items.append(sorted(ids, key=lambda x: (x is None, x or "")))
            own = batch.columns[:-3] if more else batch.columns
            yield [*own, pa.array(total, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    return run


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns. Items without an id count as one item, which has no place among the ids."""
    hits = F.floor(F.size("places") / 2).cast("long")
    return find(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("n_all").alias("n_words"),
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def oracle() -> str:
    """The same in DuckDB SQL."""
    w = "regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')"
    return f"""
WITH b AS (SELECT item_id, {w} AS w FROM benchmark),
bw AS (SELECT item_id, w, least({N}, len(w)) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM bw)),
ks AS (SELECT DISTINCT k FROM g),
d AS (SELECT row_number() OVER () AS rid, doc_id, {w} AS w FROM documents),
dw AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, p, dw.k, item_id FROM dw JOIN g USING (k, gram)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) + max(CAST(item_id IS NULL AS INTEGER)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)"""
