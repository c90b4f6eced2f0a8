"""Baseline detectors: frequency, Markov, novelty, residuals, isolation."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.lineage import cut_lineage


def bigrams(df: DataFrame, sequence: str, order: str, message: str) -> DataFrame:
    """``df`` with ``previous``, the message before in the sequence, null at its start."""
    return df.withColumn("previous", F.lag(message).over(Window.partitionBy(sequence).orderBy(order)))


class Baseline:
    """Counts of messages and transitions, and the surprise of each under add-half smoothing.

    ``V`` is the number of distinct messages plus one. The total of a context
    counts its outgoing transitions only, so the last message of a sequence adds nothing.
    """

    def __init__(self, train: DataFrame, sequence: str, order: str, message: str):
        pairs = bigrams(train, sequence, order, message).select(F.col(message).alias("message"), "previous")
        self.unigrams = pairs.groupBy("message").agg(F.count("*").alias("c"))
        self.transitions = pairs.where("previous is not null").groupBy("previous", "message").agg(F.count("*").alias("c2"))
        self.contexts = self.transitions.groupBy("previous").agg(F.sum("c2").alias("c1"))
        self.size = self.unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.count("*") + 1).alias("v"))
        self.order, self.sequence, self.message = order, sequence, message

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``previous``, ``frequency`` and ``markov``; without a predecessor the latter is the former."""
        base = bigrams(df, self.sequence, self.order, self.message)
        joined = (
            base.join(self.unigrams.withColumnRenamed("message", "__m"), F.col(self.message) == F.col("__m"), "left")
            .join(self.transitions.select(F.col("previous").alias("__p"), F.col("message").alias("__q"), "c2"), (F.col("previous") == F.col("__p")) & (F.col(self.message) == F.col("__q")), "left")
            .join(self.contexts.withColumnRenamed("previous", "__r"), F.col("previous") == F.col("__r"), "left")
            .join(F.broadcast(self.size))
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        surprise = lambda c, n: -F.ln((zero(c) + 0.5) / (n + F.col("v") * 0.5))
        frequency = surprise("c", F.col("n"))
        markov = F.when(F.col("previous").isNull(), frequency).otherwise(surprise("c2", zero("c1")))
        return joined.select(*[base[c] for c in base.columns], frequency.alias("frequency"), markov.alias("markov"))


def vocabulary(df: DataFrame, message: str, order: str, size: int = 2000) -> DataFrame:
    """``message, column``: the ``size - 1`` commonest, from 1 on, ties by first occurrence; column 0 is for the rest."""
    counts = df.groupBy(message).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = counts.orderBy(F.desc("n"), "first").limit(size - 1)
    return top.withColumn("column", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).select(message, "column")


def counts_by_window(df: DataFrame, window: str, message: str, vocab: DataFrame) -> DataFrame:
    """Sparse window vectors: ``window, column, n``."""
    joined = df.join(F.broadcast(vocab), message, "left").withColumn("column", F.coalesce("column", F.lit(0)))
    return joined.groupBy(window, "column").agg(F.count("*").alias("n"))


def tfidf(vectors: DataFrame, window: str, train: Column) -> DataFrame:
    """``vectors`` with ``weight``: count times ln((1 + N) / (1 + df)) + 1, N and df over the training windows."""
    n = vectors.where(train).agg(F.count_distinct(window).alias("__n"))
    df_ = vectors.where(train).groupBy("column").agg(F.count_distinct(window).alias("__df"))
    joined = vectors.join(F.broadcast(df_), "column", "left").join(F.broadcast(n))
    idf = F.ln((1 + F.col("__n")) / (1 + F.coalesce("__df", F.lit(0)))) + 1
    return joined.withColumn("weight", F.col("n") * idf).drop("__n", "__df")


#: Distinct messages on each side of a block of the nearest-neighbour search.
KNN_BLOCK = 1024


def knn_novelty(train: DataFrame, test: DataFrame, key: str, text: str) -> DataFrame:
    """``key, novelty``: one less the greatest cosine of a test text to any training text, over TF-IDF of lower-case words.

    Document frequencies are of the distinct training texts, and words that none of them has are left out. Distinct texts
    of both sides meet in blocks inside tasks, which pass on the greatest cosine of each test text only, so
    a common word costs no rows. A text that shares no word has novelty 1.
    """
    def words(df: DataFrame) -> DataFrame:
        parts = F.filter(F.split(F.lower(F.col(text)), r"(?U)\s+", -1), lambda w: w != "")
        return df.select(F.col(text).alias("id"), F.explode(parts).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))

    base, asked = cut_lineage(words(train.select(text).distinct())), words(test.select(text).distinct())
    n = train.agg(F.count_distinct(text).alias("n"))
    df_ = base.groupBy("word").agg(F.count("*").alias("df"))
    idf = cut_lineage(df_.join(F.broadcast(n)).select("word", F.monotonically_increasing_id().alias("column"), (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))

    def unit(v: DataFrame) -> DataFrame:
        weighted = v.join(idf, "word").select("id", "column", (F.col("tf") * F.col("idf")).alias("w"))
        rows = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("column", "w")).alias("cells"))
        return rows.select(F.xxhash64("id").alias("h"), "id", F.col("cells.column").alias("columns"), F.transform("cells", lambda c: c["w"] / F.col("norm")).alias("weights"))

    left, right = cut_lineage(unit(base)), cut_lineage(unit(asked))
    parts = [max(1, -(-x.count() // KNN_BLOCK)) for x in (left, right)]
    spread = lambda x, side: x.select(
        F.pmod("h", F.lit(parts[side])).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(parts[1 - side] - 1))).alias("other"), F.lit(side).alias("side"), F.when(F.lit(side == 1), F.col("id")).alias("id"), "columns", "weights"
    )
    met = spread(left, 0).withColumnsRenamed({"own": "i", "other": "j"}).unionByName(spread(right, 1).withColumnsRenamed({"own": "j", "other": "i"}))
    best = met.groupBy("i", "j").applyInPandas(_nearest, "id string, cosine double").groupBy("id").agg(F.max("cosine").alias("cosine"))
    return test.select(key, text).join(best, F.col(text) == F.col("id"), "left").select(key, (1 - F.coalesce("cosine", F.lit(0.0))).alias("novelty"))


def _nearest(frame: pd.DataFrame) -> pd.DataFrame:
    """The greatest cosine of each text of side 1 to those of side 0: products by word, into one matrix of the block."""
    sides = [frame[frame["side"] == k] for k in (0, 1)]
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame({"id": [], "cosine": []}).astype({"id": "object", "cosine": "float64"})
    cells = []
    for x in sides:
        row = np.repeat(np.arange(len(x)), x["columns"].map(len).to_numpy())
        column, weight = np.concatenate(x["columns"].to_list()), np.concatenate(x["weights"].to_list())
        order = np.argsort(column, kind="stable")
        cells.append((column[order], row[order], weight[order]))
    (ca, ra, wa), (cb, rb, wb) = cells
    product = np.zeros((len(sides[1]), len(sides[0])))
    for column in np.intersect1d(ca, cb):
        a, b = slice(*np.searchsorted(ca, [column, column + 1])), slice(*np.searchsorted(cb, [column, column + 1]))
        product[np.ix_(rb[b], ra[a])] += np.outer(wb[b], wa[a])
    return pd.DataFrame({"id": sides[1]["id"].to_numpy(), "cosine": product.max(axis=1)})


def pca_residual(train: DataFrame, test: DataFrame, vector: str, share: float = 0.95) -> DataFrame:
    """``test`` with ``residual``: the squared distance from the space of the leading components of ``train``.

    ``vector`` is an array of doubles. Components are added until ``share`` of the variance is told, however many that
    takes; their matrix, of the vectors' size squared at most, is sent to the workers.
    """
    size = len(train.select(vector).first()[0])
    fitted = PCA(k=size, inputCol="__v", outputCol="__p").fit(train.withColumn("__v", array_to_vector(F.col(vector))))
    told = np.cumsum(fitted.explainedVariance.toArray())
    n = min(size, int(np.searchsorted(told, share) + 1))
    means = train.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.avg("x")).orderBy("k").collect()
    shared = train.sparkSession.sparkContext.broadcast((fitted.pc.toArray()[:, :n], np.array([r[1] for r in means])))

    def distance(series: pd.Series) -> pd.Series:
        axes, mean = shared.value
        if not len(series):
            return pd.Series([], dtype="float64")
        x = np.stack(series.to_numpy()) - mean
        return pd.Series(np.maximum(0.0, (x * x).sum(axis=1) - ((x @ axes) ** 2).sum(axis=1)))

    return test.withColumn("residual", F.pandas_udf(distance, "double")(F.col(vector)))


def dense(df: DataFrame, window: str, column: str, value: str, size: int) -> DataFrame:
    """Sparse vectors as arrays of ``size`` doubles."""
    cells = F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("int"), F.col(value).cast("double"))))
    made = df.groupBy(window).agg(cells.alias("__m"))
    return made.select(window, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("__m", i), F.lit(0.0))).alias("vector"))


def isolation_forest(train: DataFrame, test: DataFrame, vector: str, key: str, trees: int = 200, sample: int = 256, seed: int = 7) -> DataFrame:
    """``key, isolation``: 2 to the minus mean path length over its expectation, by random trees on subsamples of ``sample`` rows.

    Each tree has a draw of its own from all training rows, the ``sample`` of least hash; about as many as are needed are
    dealt to it. Trees are grown in parallel; they, but no rows, come to the driver and go to the workers.
    """
    n = train.count()
    rate = 1.0 if n <= 2 * sample else min(1.0, (sample + 12 * np.sqrt(sample)) / n)
    grid = 1 << 30
    place = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(grid))
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < int(rate * grid))
    dealt = train.select(key, F.col(vector).alias("x"), F.explode(mine).alias("tree")).withColumn("place", place(F.col("tree")))

    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(frame["tree"].iloc[0])])
        rows = frame.sort_values(["place", key], kind="stable").head(sample)

        def grow(x: np.ndarray, depth: int):
            spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
            if depth == 0 or len(spread) == 0:
                return expected(len(x))
            f = int(rng.choice(spread))
            cut = rng.uniform(x[:, f].min(), x[:, f].max())
            left = x[:, f] < cut
            return f, cut, grow(x[left], depth - 1), grow(x[~left], depth - 1)

        tree = grow(np.stack(rows["x"].to_numpy()), int(np.ceil(np.log2(max(2, len(rows))))))
        return pd.DataFrame({"tree": [int(frame["tree"].iloc[0])], "rows": [len(rows)], "grown": [pickle.dumps(tree)]})

    made = dealt.groupBy("tree").applyInPandas(grown, "tree int, rows int, grown binary").orderBy("tree").collect()
    forest = [pickle.loads(r["grown"]) for r in made]  # noqa: S301  made above
    shared, scale = train.sparkSession.sparkContext.broadcast(forest), expected(max((r["rows"] for r in made), default=0)) or 1.0

    def paths(tree, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[at] += depth + tree
            return
        f, cut, left, right = tree
        low = x[at, f] < cut
        paths(left, x, at[low], depth + 1, out)
        paths(right, x, at[~low], depth + 1, out)

    def run(frames):
        for frame in frames:
            x = np.array(frame[vector].to_list(), float)
            total = np.zeros(len(x))
            for tree in shared.value if len(x) else ():
                paths(tree, x, np.arange(len(x)), 0, total)
            yield pd.DataFrame({key: frame[key], "isolation": 2.0 ** (-total / max(1, len(shared.value)) / scale)})

    kind = dict(test.dtypes)[key]
    return test.select(key, vector).mapInPandas(run, f"`{key}` {kind}, isolation double")


def to_array(vector: Column) -> Column:
    return vector_to_array(vector)


def novelty_flags(df: DataFrame, train: Column, sequence: str, message: str) -> DataFrame:
    """Order-blind detectors by sequence: unseen types, length, distinct messages, and the distance of its counts from the mean counts of training.

    The distance is taken over the messages that a sequence has; what training has beside them adds the rest of the mean's own square.
    """
    kept = df.where(train)
    sequences = kept.agg(F.count_distinct(sequence).alias("__k"))
    mean = kept.groupBy(F.col(message).alias("__m")).agg(F.count("*").alias("__c")).join(F.broadcast(sequences)).select("__m", (F.col("__c") / F.col("__k")).alias("__mean"))
    square = mean.agg(F.coalesce(F.sum(F.col("__mean") * F.col("__mean")), F.lit(0.0)).alias("__square"))
    counts = df.groupBy(sequence, message).agg(F.count("*").alias("__n")).join(mean, F.col(message) == F.col("__m"), "left").join(F.broadcast(square))
    mu = F.coalesce("__mean", F.lit(0.0))
    off = F.sum((F.col("__n") - mu) * (F.col("__n") - mu) - mu * mu) + F.max("__square")
    return counts.groupBy(sequence).agg(
        F.coalesce(F.sum(F.when(F.col("__m").isNull(), F.col("__n"))), F.lit(0)).alias("unseen"), F.sum("__n").alias("length"), F.count("*").alias("distinct_messages"),
        F.sqrt(F.greatest(F.lit(0.0), off)).alias("distance"),
    )


def mutations(df: DataFrame, items: str) -> DataFrame:
    """``df`` with one array per mutation: a missing, extra, repeated, replaced or swapped element, and all sorted.

    Each works in the middle; arrays of fewer than two elements stay as they are.
    """
    x, n = F.col(items), F.size(items)
    mid = F.floor(n / 2).cast("int")
    left, right = F.slice(x, F.lit(1), mid), F.slice(x, mid + 2, n)
    here = F.array(x[mid])
    other = F.array(F.lit("<OTHER>"))
    made = {
        "missing": F.concat(left, right),
        "extra": F.concat(left, other, here, right),
        "repeated": F.concat(left, here, here, right),
        "replaced": F.concat(left, other, right),
        "swapped": F.concat(F.slice(x, F.lit(1), mid - 1), here, F.array(x[mid - 1]), right),
        "sorted": F.array_sort(x),
    }
    return df.select("*", *[F.when(n < 2, x).otherwise(v).alias(k) for k, v in made.items()])
