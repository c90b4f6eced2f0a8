"""Chronological order, cuts between segments, and the rule that no unit straddles a cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.ordering import carried, global_rank, previous, running_max, running_sums

#: Codes and names of the segments; a unit that straddles a cut is excluded.
EARLY, GUARD, MID, LATE, EXCLUDED = 0, 1, 2, 3, 255
SEGMENT_NAMES = {EARLY: "EARLY", GUARD: "GUARD", MID: "MID", LATE: "LATE", EXCLUDED: "EXCLUDED"}
FRACTIONS = (0.50, 0.55, 0.70)


def effective_timestamp(df: DataFrame, ts: str, file: str, line: str, name: str = "effective_ts") -> DataFrame:
    """The last parsed time at or before each line of its file, 0 where there is none yet."""
    return carried(df, ts, F.col(line).asc(), name=name, by=(file,)).withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def chronological(df: DataFrame, ts: str, *tie: str, name: str = "rank") -> DataFrame:
    """0-based rank by time; ``tie`` is the file order and must be unique."""
    return global_rank(df, F.col(ts), *[F.col(c).asc() for c in tie], name=name)


def inversions(df: DataFrame, ts: str, file: str, line: str) -> DataFrame:
    """``file, lines, inversions``: rows whose time lies before that of the line above."""
    told = previous(df, ts, F.col(line).asc(), name="__above", by=(file,))
    return told.groupBy(file).agg(F.count("*").alias("lines"), F.count_if(F.col(ts) < F.col("__above")).alias("inversions"))


def counters(df: DataFrame, ts: str, file: str, line: str, message: str) -> DataFrame:
    """``file, lines, parsed, inherited, undated, inversions, first_ts, last_ts, messages``, by file.

    A line without a time inherits that of the last one above that has one; without any it is undated. Inversions are of the times that lines then have.
    """
    told = carried(df, ts, F.col(line).asc(), name="__own", by=(file,))
    turned = previous(told, "__own", F.col(line).asc(), name="__above", by=(file,))
    own, had = F.col("__own"), F.col(ts).isNotNull()
    return turned.groupBy(file).agg(
        F.count("*").alias("lines"), F.count_if(had).alias("parsed"), F.count_if(~had & own.isNotNull()).alias("inherited"), F.count_if(own.isNull()).alias("undated"),
        F.count_if(own < F.col("__above")).alias("inversions"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_distinct(message).alias("messages"),
    )


def boundaries(total: int, fractions: tuple[float, ...] = FRACTIONS) -> tuple[int, ...]:
    """Ranks at which segments end: the product in double arithmetic, truncated."""
    return tuple(int(total * f) for f in fractions)


def floor_boundaries(total: int, percents: tuple[int, ...] = (0, 60, 70, 80, 90, 100)) -> tuple[int, ...]:
    """Cumulative floors in whole numbers."""
    return tuple(p * total // 100 for p in percents)


def spans(df: DataFrame, unit: str, ts: str) -> DataFrame:
    """``unit, first, last, records``; rows without a unit are left out."""
    return df.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("records"))


def quiet_instants(units: DataFrame) -> DataFrame:
    """``instant``: one after the end of each group of overlapping unit intervals.

    A unit that begins after all earlier ones have ended closes their group; the last group is closed by the end of all.
    """
    opened = running_max(units.select("first", "last"), "last", F.col("first").asc(), F.col("last").asc(), name="__end")
    closed = opened.where(F.col("first") > F.col("__end")).select((F.col("__end") + 1).alias("instant"))
    return closed.unionByName(units.agg((F.max("last") + 1).alias("instant")).where("instant is not null"))


def alive_at(units: DataFrame, cuts: dict[str, int]) -> DataFrame:
    """``cut, units, records``: units with first < cut <= last, for a few literal cuts, in one pass."""
    parts = [F.struct(F.lit(n).alias("cut"), ((F.col("first") < t) & (F.col("last") >= t)).alias("alive")) for n, t in cuts.items()]
    told = units.select("records", F.explode(F.array(*parts)).alias("c")).select("records", "c.cut", "c.alive")
    return told.groupBy("cut").agg(F.count_if("alive").alias("units"), F.coalesce(F.sum(F.when(F.col("alive"), F.col("records"))), F.lit(0)).alias("records"))


def choose_cuts(stream: DataFrame, units: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> list[dict]:
    """The three cut times, each the cheaper of its nominal time and a quiet instant.

    The nominal time costs the records of units alive across it; an instant costs the
    records between it and the nominal rank. An instant must be strictly cheaper; the earliest of
    the cheapest wins; cuts rise strictly. Only the few chosen numbers reach the driver.
    """
    total = stream.count()
    out, least = [], -1
    instants = quiet_instants(units)
    # records before each instant, in one pass: instants and records in one order
    both = stream.select(F.col("effective_ts").alias("t"), F.lit(1).alias("n"), F.lit(1).alias("kind")).unionByName(
        instants.select(F.col("instant").alias("t"), F.lit(0).alias("n"), F.lit(0).alias("kind"))
    )
    ranked = running_sums(both, F.col("t"), F.col("kind"), sums={"before": F.col("n")}).where("kind = 0").select(F.col("t").alias("instant"), "before")
    ranked = ranked.persist()
    for rank in boundaries(total, fractions):
        nominal = stream.where(F.col("rank") == rank).select("effective_ts").first()
        nominal = nominal[0] if nominal else None
        cost = alive_at(units, {"c": nominal}).first()["records"] if nominal is not None else 0
        best = {"rank": rank, "nominal": nominal, "chosen": nominal, "displaced": cost, "strategy": "NOMINAL_CUT_WITH_UNIT_EXCLUSION"}
        near = (
            ranked.where(F.col("instant") > least)
            .select(F.abs(F.col("before") - rank).alias("cost"), "instant")
            .orderBy("cost", "instant")
            .limit(1)
            .collect()
        )
        if near and near[0]["cost"] < cost:
            best |= {"chosen": near[0]["instant"], "displaced": near[0]["cost"], "strategy": "SNAPPED_TO_QUIET_INSTANT"}
        if best["chosen"] <= least:
            best |= {"chosen": least + 1, "displaced": cost, "strategy": "FORCED_MONOTONIC"}
        least = best["chosen"]
        out.append(best)
    ranked.unpersist()
    return out


def segment_of(ts: Column, cuts: tuple[int, int, int]) -> Column:
    """The segment of a time; a record at a cut belongs to the later one."""
    a, b, c = cuts
    return F.when(ts < a, EARLY).when(ts < b, GUARD).when(ts < c, MID).otherwise(LATE).cast("smallint")


def assign_segments(stream: DataFrame, units: DataFrame, cuts: tuple[int, int, int], unit: str = "unit") -> DataFrame:
    """``stream`` with ``segment``: 255 for units that straddle a cut, else that of the unit's last record; without a unit, the record's own."""
    straddles = F.lit(False)
    for cut in cuts:
        straddles = straddles | ((F.col("first") < cut) & (F.col("last") >= cut))
    placed = units.select(F.col("unit").alias("__unit"), F.when(straddles, F.lit(EXCLUDED)).otherwise(segment_of(F.col("last"), cuts)).cast("smallint").alias("__segment"))
    joined = stream.join(placed, F.col(unit) == F.col("__unit"), "left")
    return joined.withColumn("segment", F.coalesce("__segment", segment_of(F.col("effective_ts"), cuts))).drop("__unit", "__segment")


def segment_summary(segmented: DataFrame, message: str = "message") -> DataFrame:
    """One row for each segment, empty ones too: records, bounds, distinct messages."""
    spark = segmented.sparkSession
    names = spark.createDataFrame([(k, v) for k, v in SEGMENT_NAMES.items()], "segment int, name string")
    found = segmented.groupBy(F.col("segment").cast("int").alias("segment")).agg(
        F.count("*").alias("records"), F.min("effective_ts").alias("first_ts"), F.max("effective_ts").alias("last_ts"), F.count_distinct(message).alias("messages")
    )
    return names.join(found, "segment", "left").select(
        "segment", "name", F.coalesce("records", F.lit(0)).alias("records"), "first_ts", "last_ts", F.coalesce("messages", F.lit(0)).alias("messages")
    )


def field_coverage(segmented: DataFrame, fields: list[str]) -> DataFrame:
    """``segment, field, present, ratio`` (rounded to 6 places)."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("there")) for f in fields]))
    told = segmented.select(F.col("segment").cast("int").alias("segment"), parts.alias("p")).select("segment", "p.*")
    return told.groupBy("segment", "field").agg(F.count_if("there").alias("present"), F.round(F.avg(F.col("there").cast("int")), 6).alias("ratio"))


def presence_flags(fields: list[str]) -> Column:
    """One bit for each field that is there."""
    out = F.lit(0)
    for i, f in enumerate(fields):
        out = out.bitwiseOR(F.when(F.col(f).isNotNull(), 1 << i).otherwise(0))
    return out
