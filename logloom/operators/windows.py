"""Causal context windows, count windows, strata and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import identity
from logloom.operators.ordering import global_rank


def group_key(gid: Column) -> Column:
    """``G<gid>``, or ``GLOBAL`` for records without a group."""
    return F.when(gid >= 0, F.concat(F.lit("G"), gid.cast("string"))).otherwise("GLOBAL")


#: Records of a group that one window task holds; a larger group is cut, with the records before each cut carried over.
LARGE_GROUP = 1 << 20


def context_windows(stream: DataFrame, group: str, message: str, architecture: Column, partition: Column, context: int = 8, large: int | None = None) -> DataFrame:
    """A window for each record with a predecessor in its group: up to ``context`` of them, oldest first.

    One shuffle on the group; the frame holds at most ``context`` rows. Groups of more than ``large`` records, such as
    that of all records without a group, are cut into pieces, each of which begins with the last records of the one before.
    """
    large = large or LARGE_GROUP
    sizes = stream.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n")).where(F.col("__n") > large).select("__g")
    if not sizes.limit(1).count():
        framed = _framed(stream, message, context, group)
    else:
        hot, same = F.broadcast(sizes), F.col(group).eqNullSafe(F.col("__g"))  # at most records / large rows
        placed = global_rank(stream.join(hot, same, "left_semi"), F.col("rank"), name="__place", by=(group,))
        own = F.floor(F.col("__place") / large)
        pieces = F.when(F.pmod("__place", F.lit(large)) >= large - context, F.array(own, own + 1)).otherwise(F.array(own))
        cut = _framed(placed.withColumn("__piece", F.explode(pieces)), message, context, group, "__piece").where(F.col("__piece") == own)
        framed = _framed(stream.join(hot, same, "left_anti"), message, context, group).unionByName(cut.drop("__place", "__piece"))
    past = F.col("__past")
    return framed.where(F.size(past) > 0).select(
        identity.window_id(architecture, partition, F.col("rank")).alias("window_id"),
        identity.sequence_id(architecture, partition, F.col(group)).alias("sequence_id"),
        F.col("rank").alias("target_rank"),
        past["rank"].alias("context_ranks"),
        F.size(past).cast("long").alias("context_record_count"),
        F.col("effective_ts").alias("target_effective_ts"),
        F.element_at(past, -1)["effective_ts"].alias("context_last_effective_ts"),
        identity.dedupe_key(past["text"], F.col(message)).alias("dedupe_key"),
        past["text"].alias("context_messages"),
        F.col(message).alias("target_message"),
        F.col(group).alias("group"),
    )


def _framed(stream: DataFrame, message: str, context: int, *by: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("rank").rowsBetween(-context, -1)
    return stream.withColumn("__past", F.collect_list(F.struct("rank", "effective_ts", F.col(message).alias("text"))).over(before))


def position_in_unit(lines: DataFrame, unit: str, order: str, name: str = "position") -> DataFrame:
    """``lines`` with their 0-based place among all lines of their unit, emitted or not; lines without a unit have none."""
    placed = global_rank(lines, F.col(order), name=name, by=(unit,))
    return placed.withColumn(name, F.when(F.col(unit).isNotNull(), F.col(name)))


def locate(stream: DataFrame, raw: DataFrame) -> DataFrame:
    """``stream`` (``rank, effective_ts, raw_hash``) with ``file_position``, the place of its line in the raw files.

    ``raw`` has ``file_position, effective_ts, raw_hash``; its order by time, then position, must be that
    of the stream, line by line. A line that differs, or that one side lacks, is an error.
    """
    ranked = global_rank(raw, F.col("effective_ts"), F.col("file_position").asc(), name="__rank").select("__rank", "file_position", F.col("effective_ts").alias("__ts"), F.col("raw_hash").alias("__hash"))
    both = stream.join(ranked, F.col("rank") == F.col("__rank"), "full")
    same = F.col("effective_ts").eqNullSafe(F.col("__ts")) & F.col("raw_hash").eqNullSafe(F.col("__hash")) & F.col("rank").isNotNull()
    checked = F.when(same, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("the raw files differ from the stream at rank "), F.coalesce("rank", "__rank").cast("string"))))
    return both.withColumn("rank", checked).drop("__rank", "__ts", "__hash")


def at_positions(raw: DataFrame, wanted: DataFrame, text: str, hash_: str) -> DataFrame:
    """``wanted`` (``file_position, norm_hash``) with the text at each position, whose hash must be the wanted one; a missing line is an error."""
    found = raw.select(F.col("file_position").alias("__at"), F.col(text).alias("__text"), F.col(hash_).alias("__hash"))
    joined = wanted.join(found, F.col("file_position") == F.col("__at"), "left")
    fault = F.raise_error(F.concat(F.lit("no such text at position "), F.col("file_position").cast("string"))).cast("string")
    return joined.withColumn(text, F.when(F.col("__hash") == F.col("norm_hash"), F.col("__text")).otherwise(fault)).drop("__at", "__text", "__hash")


def causal(windows: DataFrame) -> Column:
    """Whether all of a window's context lies before its target."""
    return (F.array_max("context_ranks") < F.col("target_rank")) & (F.col("context_last_effective_ts") <= F.col("target_effective_ts"))


def bounded_candidates(windows: DataFrame, by: list[str], limit: int, tag: str = "P2.2-v1") -> DataFrame:
    """The ``limit`` windows of least hash in each group, with the group's eligible count."""
    key = F.sha2(F.concat_ws("|", F.lit(tag), *[F.col(c) for c in by], F.col("target_rank").cast("string")), 256)
    order = Window.partitionBy(*by).orderBy("__hash", "target_rank")
    chosen = windows.withColumn("__hash", key).withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= limit)
    counts = windows.groupBy(*by).agg(F.count("*").alias("eligible"))
    return chosen.drop("__hash", "__place").join(counts, by)


def build_units(records: DataFrame, unit: str, strata: int, chunk_lines: int, embargo_us: int) -> DataFrame:
    """One row per unit, in the order of last records: span, size, stratum, chunk, embargo.

    Strata are ``floor(order * strata / n)``; a unit is under embargo if it begins before the
    stream's start plus the embargo. Records without a unit form none.
    """
    units = records.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit_id")).agg(
        F.min("rank").alias("first_rank"),
        F.max("rank").alias("last_rank"),
        F.min("effective_ts").alias("first_ts"),
        F.max("effective_ts").alias("last_ts"),
        F.count("*").alias("n_lines"),
    )
    whole = units.agg(F.count("*").alias("__n"))
    start = records.agg(F.min("effective_ts").alias("__start"))
    ordered = global_rank(units, F.col("last_rank"), F.col("unit_id").asc(), name="__order").join(F.broadcast(whole)).join(F.broadcast(start))
    return ordered.select(
        *units.columns,
        F.floor(F.col("__order") * strata / F.col("__n")).cast("int").alias("stratum"),
        F.floor(F.col("__order") / chunk_lines).cast("long").alias("chunk"),
        (F.col("first_ts") < F.col("__start") + embargo_us).alias("embargo"),
    )


def count_windows(lines: DataFrame, line: str, starts: list[int], size: int = 100) -> DataFrame:
    """Windows of exactly ``size`` consecutive lines inside each part; what is left over at a part's end is no window.

    ``starts`` are the parts' borders, the last one the total. Returns ``part, window, first, last, lines, complete``.
    """
    part, begin = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        inside = (F.col(line) >= a) & (F.col(line) < b)
        part, begin = F.when(inside, i).otherwise(part), F.when(inside, F.lit(a)).otherwise(begin)
    placed = lines.withColumn("part", part).withColumn("__begin", begin)
    grouped = placed.withColumn("window", F.floor((F.col(line) - F.col("__begin")) / size).cast("long")).groupBy("part", "window")
    out = grouped.agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count("*").alias("lines"))
    return out.withColumn("complete", F.col("lines") == size)


def time_chunks(units: DataFrame, order: str, by: str, size: int = 64) -> DataFrame:
    """``time_chunk`` of ``size`` units and ``crossfit_fold`` 0 or 1, the halves of each group."""
    placed = global_rank(units, F.col(order), name="__place", by=(by,))
    whole = units.groupBy(by).agg(F.count("*").alias("__n"))
    return (
        placed.join(whole, by)
        .withColumn("time_chunk", F.floor(F.col("__place") / size).cast("long"))
        .withColumn("crossfit_fold", F.when(F.col("__place") * 2 < F.col("__n"), 0).otherwise(1))
        .drop("__place", "__n")
    )


def hydrate(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """``target_rank, context`` with the messages of the context ranks, in their order, by a join on the rank."""
    parts = windows.select("target_rank", F.posexplode("context_ranks").alias("pos", "rank"))
    joined = parts.join(texts.select("rank", "message"), "rank")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "message")))
    return joined.groupBy("target_rank").agg(ordered["message"].alias("context"))


def referential_faults(windows: DataFrame, events: DataFrame) -> DataFrame:
    """``target_rank, fault``: targets or context ranks that no event has, or that another sequence has."""
    known = events.select(F.col("rank").alias("__rank"), F.col("sequence_id").alias("__seq"))
    named = windows.select("target_rank", "sequence_id", F.explode(F.concat(F.array("target_rank"), "context_ranks")).alias("rank"))
    found = named.join(known, F.col("rank") == F.col("__rank"), "left")
    fault = F.when(F.col("__rank").isNull(), "MISSING").when(F.col("__seq") != F.col("sequence_id"), "OTHER_SEQUENCE")
    return found.withColumn("fault", fault).where("fault is not null").select("target_rank", "rank", "fault")


def random_suffix(windows: DataFrame, tag: str) -> DataFrame:
    """A training view: the last n context ranks, n drawn from 1 to all by a hash."""
    n = F.size("context_ranks")
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(tag), F.col("window_id")), 256), 1, 8), 16, 10).cast("long")
    return windows.withColumn("context_ranks", F.slice("context_ranks", -(F.pmod(draw, n) + 1).cast("int"), n))
