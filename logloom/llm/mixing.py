"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled order by a hash of their ids and texts;
their words, in that order, are cut into blocks of equally many, up to one word. A
source has blocks of its own size, a small part of its words and of its target, so
how near it comes to its target does not depend on the other sources. Slot k of the
schedule stands at the fraction of k times the golden ratio; that point, mapped
through the sources' cumulative numbers of slots, names the slot's source, and the
slot's rank among those of its source names the block to take. Slots beyond a source's
number are not used, and those that the schedule still owes it follow at the end. A
block is taken as often as ranks fall on it, at most three times.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.base import small_batches, words_of
from logloom.operators.lineage import cut_lineage

#: A block has the words of the corpus through this, at most.
SLOTS = 1 << 20
#: A block is this part of its source and of its source's target, at most, down to a word.
LEAST_BLOCKS = 512
#: Slots that are ranked together before the chunks' counts are added up.
CHUNK = 4096
#: A source's words are used so often, at most.
MOST = 3
#: Weights that repeat over the sources in code point order, a null source last.
WEIGHTS = (1, 2, 3)
#: Sources are a table on the driver, 8 bytes each in the schedule's workers; more than this is an error, not a cut.
MAX_SOURCES = 1_000_000
#: Bytes of that table, names and numbers, up to which it is broadcast; beyond them it is joined by a shuffle.
MAX_BROADCAST_BYTES = 16 << 20
_POWER = 31
_GOLDEN = 1327217885  # 2**31 divided by the golden ratio, to the nearest odd number


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Shares of the sum of ``sizes`` by weight; what exceeds ``most`` times a size is shared again."""
    out, rest, free = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), list(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] > Fraction(most * sizes[i]) * whole]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / whole
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
        rest -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_hash`` of every row; a null text has size 0."""
    return docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def _schedule(spark, slots: int, cuts: np.ndarray) -> DataFrame:
    """``chunk, idx, place`` for each slot: its source and its rank among the slots of its chunk."""
    small_batches(spark)
    n_chunks = -(-slots // CHUNK)

    def run(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                k = np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.int64)
                point = (k * _GOLDEN) % (1 << _POWER)
                idx = np.searchsorted(cuts, point, "right")
                order = np.argsort(idx, kind="stable")
                head = np.flatnonzero(np.append(True, np.diff(idx[order]) > 0))
                place = np.empty(len(k), np.int64)
                place[order] = np.arange(len(k)) - np.repeat(head, np.diff(np.append(head, len(k))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), chunk), pa.int64()), pa.array(idx, pa.int32()), pa.array(place, pa.int64())], names=["chunk", "idx", "place"]
                )

    return spark.range(0, n_chunks, 1, max(1, min(n_chunks // 16, 64))).mapInArrow(run, "chunk bigint, idx int, place bigint")


def mix(docs: DataFrame, slots: int = SLOTS, seed: int = 5) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``(doc_id, source, text)``.

    A null or empty text has size 0 and is never taken; a null source is a source of its
    own; repeated rows are separate documents; an empty table stays empty; other columns are ignored, whatever their names. With no words at all every
    target and take is 0. The schedule depends on ids, texts and sizes only, so a rerun agrees. A very long document
    has as many rows, while it is spread, as it has blocks.
    """
    spark = docs.sparkSession
    rows = cut_lineage(sized(docs))
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in found]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    total = sum(sizes)
    block = max(1, -(-total // slots))
    n_blocks, need = [], []
    for n, t in zip(sizes, goal, strict=True):
        fine = LEAST_BLOCKS * max(1, math.ceil(n / t)) if t else 1
        n_blocks.append(max(-(-n // block), min(n, fine)))
        need.append(math.floor(t * n_blocks[-1] / n + Fraction(1, 2)) if n else 0)
    fields = "own_source string, idx int, source_size bigint, target double, n_blocks bigint, need bigint, windows int"
    dim = spark.createDataFrame([(r[0], i, sizes[i], float(goal[i]), n_blocks[i], need[i], 1 + math.isqrt(r[2])) for i, r in enumerate(found)], fields)
    if sum(len((r[0] or "").encode()) + 64 for r in found) <= MAX_BROADCAST_BYTES:
        dim = F.broadcast(dim)
    sourced = rows.join(dim, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")
    hashed = sourced.withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    sure = cut_lineage(hashed.withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 33) * F.col("windows").cast("long"), 31)).drop("text_hash"))

    # where each document's words begin in its source: a sum inside hash buckets, of which a source has the root of its documents, and the buckets before
    inside = Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sure.groupBy("idx", "bucket").agg(F.sum("size").alias("held")).select(
        "idx", "bucket", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before")
    )
    placed = sure.where("size > 0").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["idx", "bucket"])
    placed = placed.withColumn("begin", F.col("inside") + F.col("before"))

    # how often each block is taken
    whole = sum(need)
    cuts = np.array([c * (1 << _POWER) // whole for c in accumulate(need[:-1])], np.int64) if whole else np.zeros(0, np.int64)
    plan = _schedule(spark, whole, cuts)
    counted = plan.groupBy("chunk", "idx").agg(F.count("*").alias("n"))
    before = counted.select(
        "chunk", "idx", F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")
    )
    ranked = plan.join(before, ["chunk", "idx"]).select("idx", (F.col("place") + F.col("earlier")).alias("rank"))
    had = counted.groupBy("idx").agg(F.sum("n").alias("had"))
    owed = dim.select("idx", "need").join(had, "idx", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    ranked = ranked.unionByName(owed.select("idx", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank")))
    uses = (
        ranked.join(dim.select("idx", "n_blocks", "need"), "idx")
        .where("rank < need")
        .groupBy("idx", (F.col("rank") % F.col("n_blocks")).alias("block"))
        .agg(F.count("*").alias("times"))
    )

    end = F.col("begin") + F.col("size")

    # block k begins at word k * source_size div n_blocks, so longer blocks are spread evenly; products may exceed a long
    def block_of(word: str) -> Column:
        return F.expr(f"(cast({word} + 1 as decimal(19, 0)) * cast(n_blocks as decimal(18, 0)) - 1) div source_size")

    def block_at(k: str) -> Column:
        return F.expr(f"(cast({k} as decimal(19, 0)) * cast(source_size as decimal(18, 0))) div n_blocks")

    spread = placed.select(
        "idx", "doc_id", "source", "size", "source_size", "target", "begin", "n_blocks",
        F.explode(F.sequence(block_of("begin"), block_of("begin + size - 1"))).alias("block"),
    )
    part = F.least(end, block_at("block + 1")) - F.greatest(F.col("begin"), block_at("block"))
    taken = (
        spread.join(uses, ["idx", "block"], "left")
        .groupBy("idx", "begin", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum(part * F.coalesce("times", F.lit(0))).alias("taken"))
    )
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return taken.select(*out).unionByName(sure.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))
