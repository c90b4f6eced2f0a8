"""Near-duplicates by BagMinHash signatures, bands, and a check of the multisets.

A text is the multiset of its 5-word shingles. A shingle of weight w owns the
interval [0, w). Dyadic blocks [0,1), [1,2), [2,4), [4,8)... each carry a Poisson
process, the same in every text, of a rate equal to the block's length; a point has a
time, a register and a position, and counts where its position is below w.
A register keeps its first point. Two texts agree in a register with the probability
of their weighted Jaccard similarity, and a process stops once its time exceeds
the latest register. Bands of registers name buckets. Every member of a bucket is
checked against its leader, the member that shares most buckets with others: of a
group of edited copies that is one near the original. Components are formed, and
members of a bucket that are still apart are compared with each other inside tasks. They are dealt by
component, so members that are joined already do not meet again: a large component has chunks
of its own, which meet the other chunks only, and chunks are bounded in rows and in
shingles. What passes on is a spanning set of links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.base import PLAIN, fresh, mix, named, row_chunks, schema, shingles, small_batches, string_bytes, tokens
from logloom.operators.graph import connected_components
from logloom.operators.lineage import cut_lineage

#: The similarity is no parameter: bands, blocks and the check of the texts belong together.
WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 4 registers: two texts of similarity 0.8 miss each other in all of them once in 20 million.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Members of a bucket that are compared with as many others in one task at a time, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Blocks compare shingles by 32-bit hashes; links this near the threshold are decided by the texts.
MARGIN = 0.01
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def bag(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and weight of the distinct shingles of each row, by row; the weight is the count."""
    hashed, row, _, _ = tokens(data, offsets, PLAIN)
    value, where = shingles(hashed, row, len(offsets) - 1, WORDS)
    # the row in the high bits and 44 bits of the hash in the low ones: one sort groups both
    key = np.sort((where.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    weight = np.diff(np.append(head, len(key)))
    key = key[head]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), weight


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers of each row, as the bits of the time of the first point; rows without elements keep infinity."""
    first = np.full(rows * registers, np.inf)
    levels = [(row, mix(element + _GAMMA), weight, 0.0, 1.0)]
    low = 1
    while len(at := np.flatnonzero(weight > low)):
        with np.errstate(over="ignore"):
            seed = mix(element[at] + _GAMMA * np.uint64(low + 1))
        levels.append((row[at], seed, weight[at], float(low), float(low)))
        low *= 2
    own = np.concatenate([x[0] for x in levels])
    seed = np.concatenate([x[1] for x in levels])
    limit = np.concatenate([x[2] for x in levels]).astype(np.float64)
    start = np.concatenate([np.full(len(x[0]), x[3]) for x in levels])
    length = np.concatenate([np.full(len(x[0]), x[4]) for x in levels])
    time = np.zeros(len(own))
    step = np.uint64(0)
    while len(own):
        step += np.uint64(2)
        with np.errstate(over="ignore"):
            a, b = mix(seed + _GAMMA * step), mix(seed + _GAMMA * (step + np.uint64(1)))
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        position = start + length * ((b >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        register = (b & np.uint64(registers - 1)).astype(np.int64)
        ok = position < limit
        np.minimum.at(first, own[ok] * registers + register[ok], time[ok])
        latest = first.reshape(rows, registers).max(axis=1)
        go = time < latest[own]
        own, seed, limit, start, length, time = own[go], seed[go], limit[go], start[go], length[go], time[go]
    return first.reshape(rows, registers).view(np.uint64)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band."""
    with np.errstate(over="ignore"):
        part = signature.reshape(len(signature), BANDS, ROWS)
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GAMMA, part.shape[:2]).copy()
        for k in range(ROWS):
            out = mix(out ^ part[:, :, k]) + _GAMMA
    return out.view(np.int64)


def _signed(batches):
    for batch in batches:
        data, offsets = string_bytes(batch.column(2))
        n, out = [], []
        for i, j in row_chunks(offsets):
            row, element, weight = bag(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n.append(np.bincount(row, weights=weight, minlength=j - i).astype(np.int64))
            out.append(bands(signatures(row, element, weight, j - i)))
        flat = np.concatenate(out).ravel() if out else np.zeros(0, np.int64)
        n = np.concatenate(n) if n else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), lists], names=["doc_id", "digest", "n", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Multiset Jaccard similarity of the shingles of two texts of each row, exact but for 64-bit hashes."""
    rows = len(a[1]) - 1
    size, keys = [], []
    for data, offsets in (a, b):
        hashed, row, _, _ = tokens(data, offsets, PLAIN)
        value, where = shingles(hashed, row, rows, WORDS)
        size.append(np.bincount(where, minlength=rows) if len(where) else np.zeros(rows, np.int64))
        with np.errstate(over="ignore"):
            key = mix(value ^ mix(where.astype(np.uint64) * _GAMMA + np.uint64(1)))
        order = np.argsort(key)
        key, where = key[order], where[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        keys.append((key[head], where[head], np.diff(np.append(head, len(key)))))
    (ka, ra, ca), (kb, _, cb) = keys
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(ra[i], weights=np.minimum(ca[i], cb[j]), minlength=rows)
    union = size[0] + size[1] - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


def _compared(batches):
    for batch in batches:
        a, b = string_bytes(batch.column(2)), string_bytes(batch.column(3))
        out = [np.zeros(0)]
        for i, j in row_chunks(a[1] + b[1]):
            out.append(similarity(*[(data[at[i] : at[j]], at[i : j + 1] - at[i]) for data, at in (a, b)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out))], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts ``(v, text)`` have at least the similarity."""
    left = texts.select(F.col("v").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_compared, "a bigint, b bigint, similarity double").where(F.col("similarity") >= least)


def _elements(batches):
    """A text's multiset as a set of 32-bit numbers: each occurrence of a shingle is an element of its own."""
    for batch in batches:
        data, offsets = string_bytes(batch.column(1))
        parts, sizes = [np.zeros(0, np.int32)], []
        for i, j in row_chunks(offsets):
            hashed, row, _, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], PLAIN)
            value, where = shingles(hashed, row, j - i, WORDS)
            order = np.lexsort((value, where))
            value, where = value[order], where[order]
            new = np.append(True, (value[1:] != value[:-1]) | (where[1:] != where[:-1])) if len(value) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            nth = np.arange(len(value)) - np.repeat(head, np.diff(np.append(head, len(value))))
            with np.errstate(over="ignore"):
                element = mix(value + nth.astype(np.uint64) * _GAMMA) >> np.uint64(32)
            parts.append(element.astype(np.uint32).view(np.int32))
            sizes += np.bincount(where, minlength=j - i).tolist()
        at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts), pa.int32()))], names=["v", "elements"])


def _apart(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of one block: enough of them to join what belongs together, and all doubtful ones.

    A pair is compared only in the first band in which it agrees.
    """
    _, i, j = key
    frame = frame.sort_values("v", kind="stable").reset_index(drop=True)  # chunk i and chunk j of a bucket, or one alone
    side = frame["chunk"].to_numpy()
    bands_ = np.stack(frame["bands"].to_list())
    band = int(frame["band"].iloc[0])
    v, n, part = frame["v"].to_numpy(), frame["n"].to_numpy(), frame["component"].to_numpy()
    length = frame["elements"].map(len).to_numpy()
    names, element = np.unique(np.concatenate(frame["elements"].to_list()), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(length)))
    mark = np.zeros(len(names), bool)
    root = {c: c for c in part.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for x in np.flatnonzero(side == i):
        near = (part != part[x]) & (np.minimum(n, n[x]) >= (SIMILARITY - MARGIN) * np.maximum(n, n[x]))
        near &= (np.arange(len(v)) > x) if i == j else (side == j)
        near = np.flatnonzero(near)
        if band:
            near = near[~(bands_[near, :band] == bands_[x, :band]).any(axis=1)]
        if not len(near):
            continue
        own = element[at[x] : at[x + 1]]
        mark[own] = True
        take = np.repeat(at[near] - np.concatenate(([0], np.cumsum(length[near])[:-1])), length[near]) + np.arange(length[near].sum())
        both = np.add.reduceat(mark[element[take]].astype(np.int64), np.concatenate(([0], np.cumsum(length[near])[:-1])))
        mark[own] = False
        alike = both / (length[near] + length[x] - both)
        for y, s in zip(near[alike >= SIMILARITY - MARGIN].tolist(), alike[alike >= SIMILARITY - MARGIN].tolist(), strict=True):
            a, b = find(part[x]), find(part[y])
            if a != b or s < SIMILARITY + MARGIN:
                out.append((min(v[x], v[y]), max(v[x], v[y])))
            if a != b and s >= SIMILARITY + MARGIN:
                root[a] = b
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, class_id, class_digest, kept`` for every row of ``(doc_id, text)``; other columns are ignored.

    ``class_id`` is the smallest id of the component that links of at least
    the similarity form, ``class_digest`` the digest of that document's text; ``kept`` is true for one row of that id and text. Equal texts share a
    class, and are one vertex. A text of 1 to 4 words is one shingle; a null text or one without words shares its class with
    equal texts only (a null text counts as empty). Null ids are kept and are the class id
    only where a class has no other. Repeated rows come out repeated, an empty table stays empty. A very long text is
    one row of 8 bytes for each of its words while it is compared.
    """
    small_batches(docs.sparkSession)
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    signed = plain.select("doc_id", "digest", "text").mapInArrow(_signed, schema(docs, "doc_id", digest="string", n="bigint", bands="array<bigint>"))
    signed = cut_lineage(signed.withColumn("row", F.monotonically_increasing_id()))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    distinct = signed.groupBy("digest").agg(head.alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    vertices = cut_lineage(distinct.withColumn("v", F.monotonically_increasing_id()))
    buckets = vertices.where("n > 0").select("v", "n", F.posexplode("bands").alias("band", "bucket"))
    crowds = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    buckets = cut_lineage(buckets.join(crowds, "bucket"))

    # every member against the leader of each of its buckets
    shared = buckets.groupBy("v").agg(F.sum("members").alias("crowd"))
    leaders = buckets.join(shared, "v").groupBy("bucket").agg(F.max(F.struct("crowd", "v")).alias("top")).select("bucket", F.col("top.v").alias("leader"))
    star = buckets.join(leaders, "bucket").where("v <> leader")
    first = cut_lineage(star.select(F.least("v", "leader").alias("a"), F.greatest("v", "leader").alias("b")).distinct())

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()

    # every vertex that shares a bucket is in a pair; their texts are fetched once
    chosen = ends(first).join(vertices.select("v", F.col("head.doc_id").alias("first_id"), F.col("digest").alias("own")), "v")
    own = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("own"))
    texts = cut_lineage(plain.join(chosen, own).select("v", "text").dropDuplicates(["v"]))
    edges = cut_lineage(verified(first, texts, SIMILARITY).select("a", "b"))
    parts = connected_components(edges, "a", "b")

    # members of a bucket that no chain of links joins yet
    told = vertices.join(parts, vertices["v"] == parts["vertex"], "left").select("v", "bands", F.coalesce("component", "v").alias("component"))
    spread = buckets.select("v", "n", "band", "bucket").join(told.select("v", "component"), "v")
    split = spread.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    open_ = cut_lineage(spread.join(split.where("low <> high and members > 2").select("bucket"), "bucket"))
    # chunks: of one large component, or of several small ones
    sizes = open_.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    filled = F.greatest(F.col("rows") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)
    owners = cut_lineage(sizes.select("bucket", "component", "rows", "shingles", F.when(filled > 0.5, F.col("component")).otherwise(-1).alias("owner")))
    dealt = owners.groupBy("bucket", "owner").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")).select("bucket", "owner", F.ceil(filled).cast("int").alias("chunks"))
    chunk = lambda owner, k: F.concat_ws(":", owner.cast("string"), k.cast("string"))
    every = dealt.select("bucket", "owner", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))
    every = every.groupBy("bucket").agg(F.collect_list(F.struct("owner", chunk(F.col("owner"), F.col("k")).alias("name"))).alias("every"))
    elements = texts.join(open_.select("v").distinct(), "v", "left_semi").mapInArrow(_elements, "v bigint, elements array<int>")
    short = F.transform("bands", lambda x: F.hash(x))  # 32 bits are enough to tell bands apart
    members = cut_lineage(elements.join(told.select("v", short.alias("bands")), "v"))
    owned = open_.join(owners.select("bucket", "component", "owner"), ["bucket", "component"]).join(dealt, ["bucket", "owner"])
    # a small component stays in one chunk; a large one is spread over its own
    key = F.when(F.col("owner") < 0, F.col("component")).otherwise(F.col("v"))
    named_ = owned.withColumn("chunk", chunk(F.col("owner"), F.pmod(F.xxhash64(key), F.col("chunks"))))
    meeting = F.filter("every", lambda x: (x["owner"] != F.col("owner")) | (F.col("owner") < 0))
    met = named_.join(every, "bucket").select("bucket", "chunk", "band", "v", "n", "component", F.explode(meeting).alias("other"))
    pairs = met.select("bucket", F.least("chunk", "other.name").alias("i"), F.greatest("chunk", "other.name").alias("j"), "chunk", "band", "v", "n", "component")
    blocks = pairs.join(members, "v")
    second = cut_lineage(blocks.groupBy("bucket", "i", "j").applyInPandas(_apart, "a bigint, b bigint").distinct())
    more = cut_lineage(verified(second, texts, SIMILARITY).select("a", "b"))
    if more.limit(1).count():
        parts = connected_components(edges.unionByName(more), "a", "b")
    labelled = vertices.join(parts, vertices["v"] == parts["vertex"], "left").select("digest", "head", F.coalesce("component", "v").alias("component"))
    order = F.struct("head.none", F.col("head.doc_id").alias("class_id"), F.col("digest").alias("class_digest"), F.col("head.row").alias("class_row"))
    heads = labelled.groupBy("component").agg(F.min(order).alias("top")).select("component", "top.class_id", "top.class_digest", "top.class_row")
    found = cut_lineage(labelled.join(heads, "component").select("digest", "class_id", "class_digest", "class_row"))
    return signed.join(found, "digest").select("doc_id", "digest", "class_id", "class_digest", (F.col("row") == F.col("class_row")).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one of each: that of the class's smallest id.

    Of rows equal in id and text one stays. Columns are those of ``docs``, whatever their names; nulls, empty and very long texts as in :func:`classes`.
    """
    names = docs.columns
    id_, digest, times = fresh(names, "id", "digest", "times")
    keys = classes(docs.select("doc_id", "text"))
    head = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    keys = cut_lineage(keys.where(head).groupBy("doc_id", "digest").agg(F.count("*").alias("times")).toDF(id_, digest, times))
    rows = docs.join(keys, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.md5(F.coalesce("text", F.lit(""))) == F.col(digest)))
    own = [named(c) for c in names]
    once = rows.where(F.col(times) == 1).select(*own)
    if not keys.where(F.col(times) > 1).limit(1).count():
        return once
    return once.unionByName(rows.where(F.col(times) > 1).dropDuplicates([id_, digest]).select(*own))


def oracle() -> str:
    """The same in DuckDB SQL, by all pairs that share a shingle; ids are unique there."""
    return """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)) GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * m >= 8 * (a.n + b.n - m) UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.t = b.t AND a.doc_id < b.doc_id),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS doc_id, min(y) AS class_id, x = min(y) AS kept FROM r GROUP BY x"""
