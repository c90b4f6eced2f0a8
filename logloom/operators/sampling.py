"""Deterministic draws: quotas, hash samples, caps and top shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.identity import selection_hash
from logloom.operators.ordering import global_rank, running_sums


def quotas(sizes: DataFrame, total: int, stratum: str = "stratum", size: str = "size") -> DataFrame:
    """``stratum, size, quota``: proportional shares, the largest remainders rounded up, ties by stratum.

    A total of zero or less, or of everything or more, takes all. The frame has one row per stratum.
    """
    whole = sizes.agg(F.sum(size).alias("__all"))
    raw = sizes.join(F.broadcast(whole)).withColumn("__raw", F.lit(float(total)) * F.col(size) / F.col("__all"))
    floors = raw.withColumn("__floor", F.floor("__raw")).withColumn("__rest", F.col("__floor") - F.col("__raw"))
    left = floors.agg((F.lit(total) - F.sum("__floor")).alias("__left"))
    order = Window.orderBy("__rest", stratum)
    placed = floors.join(F.broadcast(left)).withColumn("__place", F.row_number().over(order))
    share = F.col("__floor") + (F.col("__place") <= F.col("__left")).cast("long")
    takes_all = (F.lit(total) <= 0) | (F.lit(total) >= F.col("__all"))
    return placed.select(stratum, size, F.when(takes_all, F.col(size)).otherwise(share).cast("long").alias("quota"))


def hash_sample(units: DataFrame, total: int, tag: str, key: str = "unit_id", stratum: str = "stratum") -> DataFrame:
    """``units`` with ``selected``: the quota of least salted hashes in each stratum.

    Units are counted by stratum and the first four digits of their hash. Below the digits in which a stratum's quota
    ends all are selected, above none; only units with those digits are ranked, in small groups.
    """
    share = quotas(units.groupBy(stratum).agg(F.count("*").alias("size")), total, stratum).select(F.col(stratum).alias("__s"), "quota")
    hashed = units.withColumn("__hash", selection_hash(tag, F.col(key))).withColumn("__first", F.substring("__hash", 1, 4))
    counts = hashed.groupBy(stratum, "__first").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(stratum).orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.withColumn("__before", before).join(share, F.col(stratum).eqNullSafe(F.col("__s")))
    border = told.where((F.col("__before") < F.col("quota")) & (F.col("__before") + F.col("__n") >= F.col("quota"))).select("__s", F.col("__first").alias("__border"), (F.col("quota") - F.col("__before")).alias("__left"))
    place = F.row_number().over(Window.partitionBy(stratum, "__first").orderBy("__hash", key))
    joined = hashed.withColumn("__place", place).join(border, F.col(stratum).eqNullSafe(F.col("__s")), "left")
    chosen = (F.col("__first") < F.col("__border")) | ((F.col("__first") == F.col("__border")) & (F.col("__place") <= F.col("__left")))
    return joined.withColumn("selected", F.coalesce(chosen, F.lit(False))).drop("__hash", "__first", "__s", "__border", "__left", "__place")


def seeded(df: DataFrame, by: str, key: str, n: int, seed: int, replace: bool = False) -> DataFrame:
    """``n`` rows of each group by the order of a salted hash of their key, with ``draw`` from 0.

    With replacement a draw takes the row whose salted place it falls on, so a row may come several times. The draws are those of a hash,
    not of a random generator: the same on every run and partitioning.
    """
    place = Window.partitionBy(by).orderBy(selection_hash(str(seed), F.col(key)), key)
    if not replace:
        return df.withColumn("draw", F.row_number().over(place).cast("long") - 1).where(F.col("draw") < n)
    ranked = global_rank(df, F.col(key), name="__place", by=(by,))
    sizes = df.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("__by").cast("string"), F.col("draw").cast("string")), 256), 1, 15), 16, 10).cast("long")
    draws = draws.withColumn("__at", F.pmod(number, F.col("__n")))
    return ranked.join(draws, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__place") == F.col("__at"))).drop("__by", "__at", "__place", "__n")


def batches(df: DataFrame, length: str, key: str, budget: int) -> DataFrame:
    """``df`` with ``batch``: rows in the order of length and key, a new batch where the padded size would pass ``budget``.

    The padded size is the longest length times the rows. Lengths alone decide, so the batches are laid out by the
    counts of distinct lengths, which the driver holds, and each row finds its own by its rank.
    """
    counts = df.groupBy(F.col(length).alias("l")).agg(F.count("*").alias("n")).orderBy("l").collect()
    parts, done, batch, held = [], 0, 0, 0  # length, first rank, rows that the open batch still takes, its number, rows of each later one
    for row in counts:
        room = max(1, budget // max(1, row["l"]))
        first = min(row["n"], max(0, room - held)) if held else min(row["n"], room)
        parts.append((row["l"], done, first, batch, room))
        rest = row["n"] - first
        batch, held = (batch, held + first) if not rest else (batch + -(-rest // room), (rest - 1) % room + 1)
        done += row["n"]
    table = df.sparkSession.createDataFrame(parts, "__l long, __low long, __room long, __batch long, __size long")
    ranked = global_rank(df, F.col(length), F.col(key).asc(), name="__place").join(table, F.col(length) == F.col("__l"))
    inside = F.col("__place") - F.col("__low")
    later = F.col("__batch") + F.floor((inside - F.col("__room")) / F.col("__size")) + 1
    return ranked.withColumn("batch", F.when(inside < F.col("__room"), F.col("__batch")).otherwise(later).cast("long")).drop("__place", "__l", "__low", "__room", "__batch", "__size")


def least_hash_per(df: DataFrame, by: str, key: str, tag: str) -> DataFrame:
    """One row for each ``by``: that of the least salted hash of ``key``."""
    best = df.groupBy(by).agg(F.min(F.struct(selection_hash(tag, F.col(key)).alias("hash"), F.col(key).alias("key"))).alias("best"))
    return df.join(best.select(F.col(by).alias("__by"), F.col("best.key").alias("__key")), (F.col(by) == F.col("__by")) & (F.col(key) == F.col("__key"))).drop("__by", "__key")


def new_by_hash(candidates: DataFrame, used: DataFrame, key: str, n: int, tag: str) -> DataFrame:
    """The ``n`` keys of least hash that are not used yet."""
    return candidates.select(key).distinct().join(used.select(key), key, "left_anti").orderBy(selection_hash(tag, F.col(key)), key).limit(n)


def capped(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__place") <= most).drop("__place")


def top_membership(df: DataFrame, score: str, k: int, name: str = "weight") -> DataFrame:
    """Membership in the ``k`` highest scores; equal scores at the border share what is left.

    Works on distinct scores, so that only their counts are ordered.
    """
    distinct = df.groupBy(F.col(score).alias("__score")).agg(F.count("*").alias("__n")).persist()
    above = running_sums(distinct, -F.col("__score"), sums={"__upto": F.col("__n")})
    before = F.col("__upto") - F.col("__n")
    weight = F.when(F.col("__upto") <= k, 1.0).when(before < k, (F.lit(k) - before) / F.col("__n")).otherwise(0.0)
    return df.join(above.select("__score", weight.alias(name)), F.col(score) == F.col("__score")).drop("__score")


def keyed_union(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both with one row per key; an old row wins over a new one."""
    both = old.withColumn("__source", F.lit(0)).unionByName(new.withColumn("__source", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy("__source", *rest)
    return both.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place", "__source")
