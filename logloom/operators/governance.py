"""Folds, leakage checks, splits, populations and record rules, as relations."""

from __future__ import annotations

import json
import re
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.ordering import previous, quantiles

#: Which segments a partition of a fold takes, from the target or from the sources.
ROLES = {"SOURCE_TRAIN": ("source", (0,)), "SOURCE_VALIDATION": ("source", (2,)), "TARGET_BURN_IN": ("target", (0,)), "TARGET_EVALUATION": ("target", (2, 3))}
#: Architectures whose table of folds, 5 rows for a pair at most, is broadcast.
MAX_BROADCAST_ARCHITECTURES = 200
FORBIDDEN = re.compile("label|anomaly|target_role|outcome", re.I)


def fold_members(stream: DataFrame, architecture: str = "architecture_id", segment: str = "segment") -> DataFrame:
    """``stream`` rows by fold: one fold for each architecture as target, ``fold_id`` and ``partition`` added.

    The fold table has a row for each (target, architecture, segment). It is broadcast while there are at most
    ``MAX_BROADCAST_ARCHITECTURES``; beyond, it is made and joined by shuffles. Rows of a null architecture are in no fold.
    """
    roles = [(p, side, s) for p, (side, segments) in ROLES.items() for s in segments]
    own = stream.select(F.col(architecture).cast("string").alias("__a")).where("__a is not null").distinct()
    names = sorted(r[0] for r in own.limit(MAX_BROADCAST_ARCHITECTURES + 1).collect())
    if len(names) <= MAX_BROADCAST_ARCHITECTURES:
        rows = [(f"LOAO-{t}", a, p, s) for t in names for a in names for p, side, s in roles if (side == "target") == (t == a)]
        table = F.broadcast(stream.sparkSession.createDataFrame(rows, "fold_id string, __a string, partition string, __s int"))
    else:
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(side).alias("side"), F.lit(s).alias("s")) for p, side, s in roles]))
        pairs = own.withColumnRenamed("__a", "__t").crossJoin(own).select("__t", "__a", each.alias("r")).where((F.col("r.side") == "target") == (F.col("__t") == F.col("__a")))
        table = pairs.select(F.concat(F.lit("LOAO-"), "__t").alias("fold_id"), "__a", F.col("r.p").alias("partition"), F.col("r.s").alias("__s"))
    return stream.join(table, (F.col(architecture).cast("string") == F.col("__a")) & (F.col(segment).cast("int") == F.col("__s"))).drop("__a", "__s")


def overlaps(members: DataFrame, keys: list[str], partition: str = "partition") -> DataFrame:
    """Keys that stand in two or more partitions, with those: one shuffle in place of a join for each pair."""
    return members.groupBy(*keys).agg(F.array_sort(F.collect_set(partition)).alias("partitions")).where(F.size("partitions") > 1)


def audit(members: DataFrame, architecture: str = "architecture_id", unit: str = "unit") -> DataFrame:
    """``fold_id, check_id, verdict, observation`` of the isolation checks that rows can decide.

    ``members`` are rows of folds (:func:`fold_members`) with ``rank, effective_ts, raw_h, norm_h``.
    An observation counts what speaks against a fold; that of L02 and L03, for information, the distinct texts of the evaluation that training has.
    L05 counts units in two partitions. L07 counts pairs of partitions that are not in time's order.
    """
    c = F.col
    is_ = lambda p: c("partition") == p
    target = F.substring("fold_id", 6, 1 << 20) == c(architecture)
    source = c("partition").startswith("SOURCE")
    folds = members.groupBy("fold_id").agg(F.count_if(source & target).alias("L14"), F.count_if(c("segment") == 1).alias("L16"), F.count_distinct(F.when(source & target, c(architecture))).alias("L01"))
    place = lambda *keys: overlaps(members, ["fold_id", *keys])
    repeated = place(architecture, "rank").groupBy("fold_id").agg(F.count("*").alias("L04"))
    both = F.array_contains("partitions", "TARGET_BURN_IN") & F.array_contains("partitions", "TARGET_EVALUATION")
    burnt = place("rank", architecture).where(both).groupBy("fold_id").agg(F.count("*").alias("L08"))
    split = place(architecture, unit).where(c(unit).isNotNull()).groupBy("fold_id").agg(F.count("*").alias("L05"))
    taught = F.array_contains("partitions", "SOURCE_TRAIN") & F.array_contains("partitions", "TARGET_EVALUATION")
    seen = [place(h).where(taught & c(h).isNotNull()).groupBy("fold_id").agg(F.count("*").alias(k)) for k, h in (("L02", "raw_h"), ("L03", "norm_h"))]
    ordered = previous(members, "effective_ts", c("rank").asc(), name="__above", by=("fold_id", "partition", architecture))
    turned = ordered.groupBy("fold_id").agg(F.count_if(c("effective_ts") < c("__above")).alias("L06"))
    ends = members.groupBy("fold_id", architecture).agg(
        F.max(F.when(is_("SOURCE_TRAIN"), c("effective_ts"))).alias("a"), F.min(F.when(is_("SOURCE_VALIDATION"), c("effective_ts"))).alias("b"),
        F.max(F.when(is_("TARGET_BURN_IN"), c("effective_ts"))).alias("c"), F.min(F.when(is_("TARGET_EVALUATION"), c("effective_ts"))).alias("d"),
    )
    late = ends.groupBy("fold_id").agg((F.count_if(c("a") >= c("b")) + F.count_if(c("c") >= c("d"))).alias("L07"))
    out = folds
    for part in (repeated, burnt, split, *seen, turned, late):
        out = out.join(part, "fold_id", "left")
    names = ("L01", "L02", "L03", "L04", "L05", "L06", "L07", "L08", "L14", "L16")
    told = out.select("fold_id", F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.coalesce(c(k), F.lit(0)).cast("long").alias("observation")) for k in names])).alias("x"))
    verdict = F.when(c("x.check_id").isin("L02", "L03"), "INFORMATIONAL").when(c("x.observation") == 0, "PASS").otherwise("FAIL")
    return told.select("fold_id", "x.check_id", verdict.alias("verdict"), "x.observation")


def audit_files(modules: dict[str, str], rules: tuple[str, str], manifests: dict[str, str], artifacts: dict[str, str], exceptions: list[dict], label_module: str) -> list[dict]:
    """``check_id, verdict, observation`` of the checks that files decide, given their texts or digests.

    L09: adaptation modules (name to source) that import the label module. L10: the rule table's digest now and at the
    scan. L11, L12: declarations, for information. L13: manifests (fold to digest) that collide. L15: artifacts (name to text) that hold a private path.
    L17: registered exceptions without all their fields or a reason.
    """
    import ast

    def imports(source: str) -> set[str]:
        found = set()
        for node in ast.walk(ast.parse(source)):
            found |= {a.name for a in node.names} if isinstance(node, ast.Import) else {node.module or ""} | {f"{node.module}.{a.name}" for a in node.names} if isinstance(node, ast.ImportFrom) else set()
        return found

    fields = {"id", "title", "reason", "blocks", "approver"}
    against = {
        "L09": sorted(n for n, source in modules.items() if any(m == label_module or m.startswith(f"{label_module}.") for m in imports(source))),
        "L10": [] if rules[0] == rules[1] else ["the rule table changed since the scan"],
        "L13": sorted(n for n, d in manifests.items() if list(manifests.values()).count(d) > 1),
        "L15": sorted(n for n, t in artifacts.items() if str(Path.home()) in t or re.search(r'"/(Users|home)/', t)),
        "L17": sorted(str(e.get("id", "?")) for e in exceptions if not fields <= set(e) or not str(e["reason"]).strip()),
    }
    out = [{"check_id": k, "verdict": "FAIL" if v else "PASS", "observation": v} for k, v in against.items()]
    out += [{"check_id": k, "verdict": "INFORMATIONAL", "observation": what} for k, what in (("L11", ["no template is fitted before the split"]), ("L12", ["no statistic is fitted on a partition"]))]
    return sorted(out, key=lambda x: x["check_id"])


def compare_builds(one: DataFrame, two: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``field, equal, different, only_one, only_two``: rows of two builds that agree in each declared field; nulls equal each other."""
    a = one.select(*keys, F.struct(*fields).alias("__a"))
    b = two.select(*keys, F.struct(*fields).alias("__b"))
    both = a.join(b, keys, "full")
    here, there = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")).alias("same")) for f in fields]))
    told = both.select(here.alias("x"), there.alias("y"), each.alias("e"))
    x, y = F.col("x"), F.col("y")
    return told.groupBy("e.field").agg(F.count_if(x & y & F.col("e.same")).alias("equal"), F.count_if(x & y & ~F.col("e.same")).alias("different"), F.count_if(x & ~y).alias("only_one"), F.count_if(y & ~x).alias("only_two"))


def content_overlap(train: DataFrame, evaluation: DataFrame, text: str) -> DataFrame:
    """``evaluation_distinct, shared, ratio`` of distinct texts."""
    a, b = train.select(text).distinct(), evaluation.select(text).distinct()
    shared = b.join(a, text, "left_semi").agg(F.count("*").alias("shared"))
    return b.agg(F.count("*").alias("evaluation_distinct")).join(shared).select("evaluation_distinct", "shared", F.when(F.col("evaluation_distinct") > 0, F.col("shared") / F.col("evaluation_distinct")).alias("ratio"))


def readiness(metrics: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """``check, value, threshold, verdict`` for one row of metrics; a null value is UNKNOWN."""
    checks = [F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.lit(kind).alias("kind")) for n, (kind, t) in rules.items()]
    told = metrics.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    good = F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    verdict = F.when(F.col("value").isNull(), "UNKNOWN").when(good, "READY").otherwise("NOT_READY")
    return told.select("check", "value", "threshold", verdict.alias("verdict"))


def readiness_state(checks: DataFrame) -> DataFrame:
    """REJECTED if any check failed, else INDETERMINATE if any is unknown, else READY."""
    bad, dark = F.bool_or(F.col("verdict") == "NOT_READY"), F.bool_or(F.col("verdict") == "UNKNOWN")
    return checks.agg(F.when(bad, "REJECTED").when(dark, "INDETERMINATE").otherwise("READY").alias("state"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises if either side repeats a key."""
    def counted(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))))

    return counted(left).join(counted(right), key)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same rows, as often."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def exact_cover(df: DataFrame, index: str) -> DataFrame:
    """``rows, distinct, expected, exact``: every index from 0 on once."""
    told = df.agg(F.count("*").alias("rows"), F.count_distinct(index).alias("distinct"), (F.max(index) + 1).alias("expected"), F.min(index).alias("low"))
    return told.select("rows", "distinct", "expected", ((F.col("rows") == F.col("distinct")) & (F.col("rows") == F.col("expected")) & (F.col("low") == 0)).alias("exact"))


def contiguous(df: DataFrame, start: str, end: str) -> DataFrame:
    """``intervals, gaps, overlaps`` of half-open intervals in order."""
    told = previous(df.select(start, end), end, F.col(start).asc(), F.col(end).asc(), name="__b")
    return told.agg(F.count("*").alias("intervals"), F.count_if(F.col(start) > F.col("__b")).alias("gaps"), F.count_if(F.col(start) < F.col("__b")).alias("overlaps"))


def component_rule(lines: DataFrame, component: str, part: str) -> DataFrame:
    """``component, lines, disposition, partition``: assigned where all its lines fall in one part, else purged."""
    told = lines.where(F.col(component).isNotNull()).groupBy(F.col(component).alias("component")).agg(F.count("*").alias("lines"), F.min(part).alias("low"), F.max(part).alias("high"))
    one = F.col("low") == F.col("high")
    return told.select("component", "lines", F.when(one, "ASSIGNED").otherwise("PURGED_BOUNDARY").alias("disposition"), F.when(one, F.col("low")).alias("partition"))


def population_summaries(df: DataFrame, population: str, fields: list[str]) -> DataFrame:
    """``population, field, count, min, q05, q25, median, q75, q95, q99, max, iqr`` of numeric fields, all from one sort."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]))
    long = df.select(F.col(population).alias("population"), each.alias("x")).select("population", "x.*").where("value is not null")
    by = ("population", "field")
    ends = long.groupBy(*by).agg(F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))
    inner = quantiles(long, "value", {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}, by)
    return ends.join(inner, list(by)).select(*by, "count", "min", "q05", "q25", "median", "q75", "q95", "q99", "max", (F.col("q75") - F.col("q25")).alias("iqr"))


def window_reconciliation(lines: DataFrame, partition: str, size: int = 100) -> DataFrame:
    """``partition, raw, windows, retained, residual, raw_ratio, retained_ratio`` of a split cut into whole windows; raw = retained + residual."""
    told = lines.groupBy(F.col(partition).alias("partition")).agg(F.count("*").alias("raw"))
    told = told.withColumn("windows", F.floor(F.col("raw") / size)).withColumn("retained", F.col("windows") * size).withColumn("residual", F.col("raw") - F.col("retained"))
    whole = told.agg(F.sum("raw").alias("__r"), F.sum("retained").alias("__k"))
    return told.join(F.broadcast(whole)).select("partition", "raw", "windows", "retained", "residual", (F.col("raw") / F.col("__r")).alias("raw_ratio"), F.try_divide("retained", "__k").alias("retained_ratio"))


def component_reconciliation(lines: DataFrame, component: str, part: str) -> DataFrame:
    """``raw, ineligible, assigned, purged, holds``: lines without a component, in one part, and in several; together all lines."""
    rule = component_rule(lines, component, part).agg(*[F.coalesce(F.sum(F.when(F.col("disposition") == d, F.col("lines"))), F.lit(0)).alias(n) for d, n in (("ASSIGNED", "assigned"), ("PURGED_BOUNDARY", "purged"))])
    whole = lines.agg(F.count("*").alias("raw"), F.count_if(F.col(component).isNull()).alias("ineligible"))
    return whole.join(F.broadcast(rule)).select("raw", "ineligible", "assigned", "purged", (F.col("raw") == F.col("ineligible") + F.col("assigned") + F.col("purged")).alias("holds"))


def gate_receipt(criteria: dict[str, bool | None], expected: dict[str, str], received: dict[str, str]) -> dict:
    """A gate's receipt: open only if every criterion holds and every payload was received as expected, character for character.

    A criterion of None is unknown and does not hold. The digest is of the receipt's own canonical JSON; nothing is signed.
    """
    missing = sorted(t for t in expected if t not in received)
    mismatched = sorted(t for t in expected if t in received and received[t] != expected[t])
    verdicts = {n: "UNKNOWN" if ok is None else "PASS" if ok else "FAIL" for n, ok in sorted(criteria.items())}
    receipt = {"criteria": verdicts, "missing": missing, "mismatched": mismatched, "unexpected": sorted(set(received) - set(expected))}
    receipt["open"] = bool(criteria) and set(verdicts.values()) == {"PASS"} and not missing and not mismatched
    return receipt | {"digest": _digest("", json.dumps(receipt, sort_keys=True), "")}


def label_conflicts(labels: DataFrame, unit: str, label: str) -> DataFrame:
    """Units with more than one label."""
    return labels.groupBy(unit).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("rows")).where("labels > 1")


def label_coverage(labels: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """``matched, unknown, missing``: labelled units that exist, that do not, and units without a label."""
    a, b = labels.select(unit).distinct().withColumn("__l", F.lit(True)), units.select(unit).distinct().withColumn("__u", F.lit(True))
    return a.join(b, unit, "full").agg(F.count_if(F.col("__l") & F.col("__u")).alias("matched"), F.count_if(F.col("__u").isNull()).alias("unknown"), F.count_if(F.col("__l").isNull()).alias("missing"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``violations``: names of the rules that a row breaks; a rule that is null is broken."""
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*named)))


def canonical_rules() -> dict[str, Column]:
    """Rules of the canonical record that span fields."""
    c = F.col
    return {
        "parsed_has_time": (c("timestamp_status") == "PARSED") == c("timestamp_utc").isNotNull(),
        "template_has_source": c("template_id").isNull() | c("template_source").isNotNull(),
        "no_nul": ~F.contains(c("canonical_message"), F.lit("\x00")),
        "relative_path": ~c("source_file").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"),
        "line_from_one": c("source_line_number") >= 1,
    }


def forbidden_columns(df: DataFrame) -> list[str]:
    """Column names, nested ones too, that could carry a label."""
    def walk(kind, prefix=""):
        for f in getattr(kind, "fields", []):
            yield prefix + f.name
            yield from walk(getattr(f.dataType, "elementType", f.dataType), f"{prefix}{f.name}.")

    return [n for n in walk(df.schema) if FORBIDDEN.search(n)]


def strip_labels(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(names or [c for c in df.columns if FORBIDDEN.search(c)]))


def safe_relative(path: str) -> bool:
    """A relative POSIX path without parent steps, drives or control characters."""
    return bool(path) and not path.startswith(("/", "\\")) and not re.match(r"^[A-Za-z]:", path) and ".." not in path.split("/") and "\\" not in path and not re.search(r"[\x00-\x1f\x7f]", path)


class Labels:
    """The only reader of labels: allowed scopes only, with a reason, and every access on record."""

    ALLOWED = frozenset({"EVALUATION", "INVENTORY"})

    def __init__(self, spark: SparkSession, path: str, log: str):
        self.spark, self.path, self.log = spark, path, Path(log)

    def open(self, scope: str, reason: str) -> DataFrame:
        ok = scope in self.ALLOWED and bool(reason.strip())
        with self.log.open("a") as f:
            f.write(json.dumps({"scope": scope, "reason": reason, "granted": ok, "at": time.time()}) + "\n")
        if not ok:
            raise PermissionError(f"labels are closed to {scope}")
        return self.spark.read.parquet(self.path)


class Seal:
    """A test set that opens once: SEALED, then UNLOCKED by a grant, then OPENED; each step is chained by hash."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _history(self) -> list[dict]:
        rows = [json.loads(x) for x in self.path.read_text().splitlines()] if self.path.exists() else []
        before = ""
        for r in rows:
            if r["before"] != before or r["hash"] != _digest(r["before"], r["state"], r["note"]):
                raise ValueError("the chain of the seal is broken")
            before = r["hash"]
        return rows

    @property
    def state(self) -> str:
        rows = self._history()
        return rows[-1]["state"] if rows else "SEALED"

    def _step(self, state: str, note: str) -> None:
        rows = self._history()
        before = rows[-1]["hash"] if rows else ""
        with self.path.open("a") as f:
            f.write(json.dumps({"before": before, "state": state, "note": note, "hash": _digest(before, state, note)}) + "\n")

    def unlock(self, grant: str) -> None:
        if self.state != "SEALED":
            raise PermissionError("a grant is for a sealed set, once")
        self._step("UNLOCKED", grant)

    def open(self, read):
        """Mark the set opened and call ``read``; the path is resolved by nobody before."""
        if self.state != "UNLOCKED":
            raise PermissionError(f"the test set is {self.state}")
        self._step("OPENED", "read")
        return read()


def _digest(before: str, state: str, note: str) -> str:
    import hashlib

    return hashlib.sha256("\0".join((before, state, note)).encode()).hexdigest()


def foreign_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str, many: bool = False) -> DataFrame:
    """Keys of ``child`` (each element of an array if ``many``) that no parent has; null keys refer to nothing."""
    keys = child.select((F.explode(key) if many else F.col(key)).alias("key")).where("key is not null")
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti").distinct()


def append_new(spark: SparkSession, path: str, rows: DataFrame, key: str) -> int:
    """Append to a Parquet record store; a key that is there already, or twice in ``rows``, is refused."""
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a key is given twice")
    try:
        old = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        if rows.join(old, key, "left_semi").limit(1).count():
            raise ValueError("a key is there already")
    rows.write.mode("append").parquet(path)
    return rows.count()
