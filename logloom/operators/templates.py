"""Template mining with a fixed-depth parse tree, and matching against frozen templates.

The tree follows the published algorithm: messages of one length are led by their
first tokens to a leaf, where the most similar cluster takes them in and turns
differing tokens into wildcards. Mining depends on the order of messages, but only
inside a leaf, and only the first occurrence of each distinct masked message can
change a leaf that matches it again. The leaf of a message depends on its first
tokens and on which tokens came first, so leaves are told before, in parallel, and
each is mined in order by a task of its own. A leaf finds a message's cluster by the
tokens that they share at a place, not by comparing it with all.
Matching against frozen templates has no state and is dealt by length.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WILDCARD = "<*>"
SIMILARITY, DEPTH, MAX_CHILDREN = 0.4, 4, 100
UNSEEN = "EVT_UNSEEN"
#: Masks before mining, and what any text has that holds one.
MASKS = (
    ("HDFS_BLOCK", r"(?<![A-Za-z0-9])blk_-?\d+(?![A-Za-z0-9])", "blk_"),
    ("IPV4_ENDPOINT", r"(?<![A-Za-z0-9])(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?(?![A-Za-z0-9])", r"\d\.\d"),
    ("HEX_LITERAL", r"(?<![A-Za-z0-9])0x[0-9A-Fa-f]+(?![A-Za-z0-9])", "0x"),
)


def masked(message: Column) -> Column:
    """The names of masks hold nothing that another mask looks for, so the message tells which masks to try."""
    out = message
    for name, pattern, hint in MASKS:
        found = message.contains(hint) if "\\" not in hint else message.rlike(hint)
        out = F.when(found, F.regexp_replace(out, pattern, f"<{name}>")).otherwise(out)
    return out


#: Distinct messages of one length that a task matches at most, or about so.
SLICE = 1 << 16
#: Clusters from which a leaf keeps lists of them; fewer are compared one by one.
FEW = 8
#: Columns of the beginning of a message, and of its leaf.
HEAD = ["size", *[f"t{i}" for i in range(DEPTH - 2)]]
LEAF = ["size", *[f"s{i}" for i in range(DEPTH - 2)]]


@dataclass
class Cluster:
    tokens: list[str]
    size: int = 1


@dataclass
class Leaf:
    """Clusters of messages of one length, in the order of their making, and for each place the clusters by their token there."""

    similarity: float = SIMILARITY
    clusters: list = field(default_factory=list)
    places: list = field(default_factory=list)
    least: int = 0

    def near(self, asked: list[str | None]) -> Iterable[int]:
        """The clusters, in order, among which are all that have ``least`` tokens of the message.

        Such a cluster is in ``least`` of the lists that the message's tokens lead to, so it is in one of any
        ``p - least + 1`` of these ``p``: the shortest are read. A token that has become a wildcard stays in its list.
        """
        if not self.places or not self.least:
            return range(len(self.clusters))
        lists = [found for place, t in zip(self.places, asked, strict=True) if (found := place.get(t))]
        if len(lists) < self.least:
            return ()
        return sorted(set().union(*sorted(lists, key=len)[: len(lists) - self.least + 1]))

    def best(self, tokens: list[str]) -> Cluster | None:
        """The cluster with the largest share of equal tokens, then the most wildcards, then the first, if the share is enough."""
        asked = [None if t == WILDCARD else t for t in tokens]
        found, top = None, (self.least, -1)
        for i in self.near(asked):
            own = self.clusters[i].tokens
            same = sum(map(eq, own, asked))
            if same >= top[0] and (now := (same, own.count(WILDCARD))) > top:
                found, top = self.clusters[i], now
        return found

    def keep(self, i: int) -> None:
        for place, t in zip(self.places, self.clusters[i].tokens, strict=True):
            if t in place:
                place[t].append(i)
            elif t != WILDCARD:
                place[t] = [i]

    def add(self, tokens: list[str], times: int = 1) -> Cluster:
        if not self.clusters and tokens:
            self.least = next((k for k in range(len(tokens) + 1) if k / len(tokens) >= self.similarity), len(tokens) + 1)
        cluster = self.best(tokens)
        if cluster is None:
            cluster = Cluster(tokens, times)
            self.clusters.append(cluster)
            if self.places:
                self.keep(len(self.clusters) - 1)
            elif len(self.clusters) == FEW:
                self.places = [{} for _ in tokens]
                for i in range(FEW):
                    self.keep(i)
        else:
            cluster.tokens = [a if a == b else WILDCARD for a, b in zip(cluster.tokens, tokens, strict=True)]
            cluster.size += times
        return cluster


@dataclass
class Tree:
    """Length, then leading tokens, then clusters."""

    similarity: float = SIMILARITY
    depth: int = DEPTH
    max_children: int = MAX_CHILDREN
    leaves: dict = field(default_factory=dict)
    children: dict = field(default_factory=dict)

    def path(self, tokens: list[str], grow: bool) -> tuple | None:
        """The leaf of a message; a token with a digit, or one for which a node has no room, goes with the wildcards."""
        where: tuple = (len(tokens),)
        for token in tokens[: self.depth - 2]:
            known = self.children.setdefault(where, set()) if grow else self.children.get(where, set())
            if token in known:
                step = token
            elif grow:
                numeric = any(c.isdigit() for c in token)
                room = len(known) < self.max_children - (WILDCARD not in known)
                step = WILDCARD if numeric or not room else token
                known.add(step)
            elif WILDCARD in known:
                step = WILDCARD
            else:
                return None
            where = (*where, step)
        return where

    def add(self, message: str, times: int = 1) -> Cluster:
        tokens = message.split()
        return self.leaves.setdefault(self.path(tokens, True), Leaf(self.similarity)).add(tokens, times)


class Frozen:
    """Templates of one length, given in order."""

    def __init__(self, templates: list[str]):
        self.templates, self.tree, leaves = templates, Tree(), {}
        self.tokens = [t.split(" ") if t else [] for t in templates]
        paths = [self.tree.path(own, True) for own in self.tokens]
        self.leaf = [leaves.setdefault(p, len(leaves)) for p in paths]
        self.leaves, self.wild = leaves, [own.count(WILDCARD) for own in self.tokens]
        #: Templates without wildcards by themselves, the others by their rarest token; those of wildcards only fit always.
        self.whole: dict[str, int] = {}
        self.places: list[dict[str, list[int]]] = [{} for _ in (self.tokens[0] if templates else [])]
        self.always: list[int] = []
        seen = Counter(x for own, w in zip(self.tokens, self.wild, strict=True) if w for x in enumerate(own))
        for i, own in enumerate(self.tokens):
            fixed = [x for x in enumerate(own) if x[1] != WILDCARD] if self.wild[i] else []
            if not self.wild[i]:
                self.whole.setdefault(templates[i], i)
            elif fixed:
                place, token = min(fixed, key=lambda x: seen[x])
                self.places[place].setdefault(token, []).append(i)
            else:
                self.always.append(i)

    def match(self, tokens: list[str]) -> str | None:
        """The template that fits token by token: in the message's leaf the one with the most wildcards, else of all that length the one with the fewest."""
        fits = list(self.always)
        if (i := self.whole.get(" ".join(tokens))) is not None:
            fits.append(i)
        for place, t in zip(self.places, tokens, strict=False):
            for i in place.get(t, ()):
                if all(a == b or a == WILDCARD for a, b in zip(self.tokens[i], tokens, strict=True)):
                    fits.append(i)
        if not fits:
            return None
        leaf = self.leaves.get(self.tree.path(tokens, False))
        own = [i for i in fits if self.leaf[i] == leaf]
        return self.templates[min(own, key=lambda i: (-self.wild[i], i)) if own else min(fits, key=lambda i: (self.wild[i], self.leaf[i], i))]


def event_id(template: str, version: str = "1") -> str:
    return "EVT-" + hashlib.sha256("\0".join(("drain", version, "norm", template)).encode()).hexdigest()


def mine(messages: Iterable[tuple[str, int]], **settings) -> Tree:
    """A tree from (masked message, times) in order; ``fit`` finds the same clusters leaf by leaf."""
    tree = Tree(**settings)
    for message, times in messages:
        tree.add(message, times)
    return tree


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages with their number of tokens and their first tokens: a wildcard for one with a digit, empty where there is none."""
    for batch in batches:
        rows = []
        for m in batch.column(0).to_pylist():
            tokens = m.split()
            heads = [WILDCARD if any(map(str.isdigit, t)) else t for t in tokens[: DEPTH - 2]]
            rows.append((len(tokens), *heads, *[""] * (DEPTH - 2 - len(heads))))
        told = _batch(rows, HEAD, [pa.int32(), *[pa.string()] * (DEPTH - 2)])
        yield pa.RecordBatch.from_arrays([*batch.columns, *told.columns], [*batch.schema.names, *HEAD])


def _with_heads(df: DataFrame) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("size", T.IntegerType()), *[T.StructField(t, T.StringType()) for t in HEAD[1:]]])
    return df.mapInArrow(_headed, schema)


def _leaves(heads: DataFrame, order: list[str]) -> DataFrame:
    """``size, t0, t1, ..`` with the steps ``s0, s1, ..`` of the tree: a node has room for the tokens without digits that come first."""
    place, before = ["size"], list(order)
    for t, s in zip(HEAD[1:], LEAF[1:], strict=True):
        heads = heads.withColumn("first", F.min(F.struct(*before)).over(Window.partitionBy(*place, t)))
        heads = heads.withColumn("named", F.col(t) != WILDCARD)
        nth = F.dense_rank().over(Window.partitionBy(*place, "named").orderBy("first", t))
        heads = heads.withColumn(s, F.when((F.col(t) == "") | F.col("named") & (nth < MAX_CHILDREN), F.col(t)).otherwise(F.lit(WILDCARD)))
        place, before = [*place, s], [*before, t]
    return heads.select(*HEAD, *LEAF[1:])


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of leaves that come one after the other, each in order."""
    at, leaf, told = None, Leaf(), []
    for batch in batches:
        message, times, *keys = (batch.column(c).to_pylist() for c in batch.schema.names)
        for m, n, *key in zip(message, times, *keys, strict=True):
            if key != at:
                told += [(" ".join(c.tokens), c.size) for c in leaf.clusters]
                at, leaf = key, Leaf()
            leaf.add(m.split(), n)
        yield _batch(told, ["template", "records"], [pa.string(), pa.int64()])
        told = []
    yield _batch([(" ".join(c.tokens), c.size) for c in leaf.clusters], ["template", "records"], [pa.string(), pa.int64()])


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def fit(df: DataFrame, message: str, order: str) -> DataFrame:
    """``event_id, template, records``: templates of the masked messages, mined in the order of first occurrence.

    Rows of one order are taken by their first tokens, then by their messages; rows without an order come last, null messages nowhere.
    Each leaf is mined by one task over its distinct masked messages, which holds the leaf's clusters; the leaves and the counts are made before.
    """
    lines = df.where(F.col(message).isNotNull()).select(masked(F.col(message)).alias("m"), F.col(order).alias("o"))
    distinct = _with_heads(lines.groupBy("m").agg(F.min("o").alias("o"), F.count("*").alias("n"))).withColumn("late", F.col("o").isNull())
    heads = distinct.groupBy(*HEAD).agg(F.min("o").alias("o")).withColumn("late", F.col("o").isNull())
    dealt = distinct.join(_leaves(heads, ["late", "o"]), HEAD).repartition(*LEAF).sortWithinPartitions(*LEAF, "late", "o", *HEAD[1:], "m")
    found = dealt.select("m", "n", *LEAF).mapInArrow(_mined, "template string, records bigint").groupBy("template").agg(F.sum("records").alias("records"))
    return found.select(F.concat(F.lit("EVT-"), F.sha2(F.concat(F.lit("drain\0" + "1\0norm\0"), "template"), 256)).alias("event_id"), "template", "records")


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages with their templates; of each length and part the templates come first, in order."""
    at, own, frozen = None, [], None
    for batch in batches:
        out = []
        for text, is_message, *key in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            if key != at:
                at, own, frozen = key, [], None
            if not is_message:
                own.append(text)
                continue
            frozen = frozen or Frozen(own)
            tokens = text.split()
            template = frozen.match(tokens)
            values = [t for t, w in zip(tokens, template.split(" "), strict=True) if w == WILDCARD] if template else []
            out.append((text, event_id(template) if template is not None else UNSEEN, template, values))
        yield _batch(out, ["__m", "event_id", "template", "parameters"], [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())])


def transform(df: DataFrame, message: str, templates: DataFrame) -> DataFrame:
    """``df`` with ``event_id``, ``template`` and ``parameters``: the tokens at the wildcards; unseen and null messages get ``EVT_UNSEEN``.

    Distinct masked messages are matched once. They meet the templates of their length; a length of many messages is cut
    into parts of about ``SLICE``, to each of which its templates are sent.
    """
    lines = df.withColumn("__m", masked(F.col(message)))
    asked = _with_heads(lines.where(F.col(message).isNotNull()).select("__m").distinct())
    frozen = _with_heads(templates.select(F.col("template").alias("__m")))
    parts = F.broadcast(asked.groupBy("size").agg(F.ceil(F.count("*") / SLICE).alias("parts")))
    asked = asked.join(parts, "size").select("__m", F.lit(True).alias("is_message"), "size", F.expr("pmod(xxhash64(__m), parts)").alias("part"))
    frozen = frozen.join(parts, "size").select("__m", F.lit(False).alias("is_message"), "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    deal = ["size", "part"]
    dealt = asked.union(frozen).repartition(*deal).sortWithinPartitions(*deal, "is_message", "__m")
    found = dealt.mapInArrow(_matched, "__m string, event_id string, template string, parameters array<string>")
    out = lines.join(found, "__m", "left").drop("__m")
    return out.withColumns({"event_id": F.coalesce("event_id", F.lit(UNSEEN)), "parameters": F.coalesce("parameters", F.array().cast("array<string>"))})
