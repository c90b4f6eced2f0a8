"""Content-addressed ids and digests, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence_id(architecture: Column, partition: Column, group: Column) -> Column:
    return F.concat(F.lit("seq-"), F.substring(F.sha2(F.concat_ws("|", architecture, partition, group), 256), 1, 24))


def window_id(architecture: Column, partition: Column, rank: Column) -> Column:
    return F.concat(F.lit("win-"), F.sha2(F.concat_ws("|", architecture, partition, rank.cast("string")), 256))


def selection_hash(tag: str, key: Column) -> Column:
    """Order for deterministic draws: fixed-width hex, so text order is the numbers' order."""
    return F.sha2(F.concat_ws("|", F.lit(tag), key.cast("string")), 256)


def dedupe_key(context: Column, target: Column) -> Column:
    """The same for windows that a scorer can't tell apart: hashes of the context and of the target."""
    return F.substring(F.sha2(F.concat(F.array_join(context, ","), F.lit("|"), target), 256), 1, 32)


def nul_joined_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the SHA-256 of the parts between NULs."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def ordered_hash(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, "\x00"), 256)


def multiset_hash(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(ids), "\x00"), 256)


def packed(rank: Column) -> Column:
    """A rank as the hex of 8 big-endian bytes."""
    return F.lpad(F.lower(F.hex(rank)), 16, "0")


def membership_digest(ranks: DataFrame, rank: str = "rank", block: int = 1 << 16) -> DataFrame:
    """SHA-256 over ascending packed ranks: ``digest, members`` in one row.

    Blocks of ranks are digested in parallel and the digests are digested in block
    order, so no task holds more than one block.
    """
    parts = ranks.groupBy(F.floor(F.col(rank) / block).alias("block")).agg(
        F.sha2(F.unhex(F.array_join(F.array_sort(F.collect_list(packed(F.col(rank)))), "")), 256).alias("d"), F.count("*").alias("n")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), "")
    return parts.agg(F.sha2(joined, 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def sequential_digest(ranks: DataFrame, rank: str = "rank") -> str:
    """SHA-256 over ascending ranks of 8 bytes each, in one chain: comparable with digests made line by line.

    The chain is sequential by its nature, so ranks pass through the driver, a part at a time.
    """
    digest = hashlib.sha256()
    for row in ranks.select(rank).orderBy(rank).toLocalIterator():
        digest.update(int(row[0]).to_bytes(8, "big"))
    return digest.hexdigest()


def rows_digest(df: DataFrame, *by: str) -> DataFrame:
    """``rows, digest`` of each group of ``by``, whatever the order of rows and the part files.

    The digest is of sums of the parts of the rows' own digests, so rows combine before the shuffle, no cell grows with
    their number and a repeated row counts each time. Columns are taken by name, so their order does not matter.
    """
    own = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring("__own", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    told = df.select(*by, own.alias("__own")).groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(x).alias(f"__{i}") for i, x in enumerate(parts)])
    return told.select(*by, "rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(f"__{i}", F.lit(0)) for i in range(8)]), 256).alias("digest"))
