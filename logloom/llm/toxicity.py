"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams, from parts of a syllable to whole words, since
toxic words may be built from syllables that are common elsewhere. Every bucket's presence is scaled by
the log of the ratio of its smoothed shares among toxic and other training rows, moved towards
zero by ``DOUBT`` standard errors of that log: what the sample says nothing of has the scale 0,
at every size of the sample. An L2-regularised logistic regression is fitted on the scaled features. The
product of scale and weight is one table by bucket, which scores whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.base import map_rows, named, row_chunks, small_batches, string_bytes
from logloom.llm.ngrams import character_grams, characters
from logloom.operators.lineage import cut_lineage

BITS, SIZES = 20, (3, 4, 5, 6, 7, 8)
#: Labelled rows that one fit may use, about: toxic ones and others.
TRAIN_TOXIC, TRAIN_OTHER = 1500, 3000
#: Bytes of their texts that one fit may use; a text of more than a sixteenth of that is not used.
TRAIN_BYTES = 16 << 20
SMOOTHING, DOUBT, RIDGE, STEPS = 0.5, 2.0, 1e-3, 200
#: Bytes of text that are scored at once, so that what is made of them stays in the processor's cache.
CACHED = 1 << 17
#: Features whose products are formed at once while fitting.
CHUNK = 1 << 21


@dataclass
class Model:
    table: np.ndarray  # weight by bucket
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        codes, row = characters(texts)
        found = [np.zeros(0, np.int64)]
        for at, bucket in character_grams(codes, SIZES, BITS):
            told = np.flatnonzero(self.table[bucket])
            found.append((row[at[told] - 1] << BITS) | bucket[told])
        present = np.unique(np.concatenate(found))
        value = np.bincount(present >> BITS, weights=self.table[present & ((1 << BITS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(value + self.bias, -30, 30)))


def _buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text."""
    found = [bucket for _, bucket in character_grams(characters([text])[0], SIZES, BITS)]
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


def _counted(batches):
    """``bucket, p, q``: toxic and other texts of the batch that have the bucket."""
    for batch in batches:
        found = [_buckets(t) for t in batch.column(1).to_pylist()]
        marks = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(x) for x in found])
        bucket, at = np.unique(np.concatenate([np.zeros(0, np.int32), *found]), return_inverse=True)
        p, n = np.bincount(at, weights=marks, minlength=len(bucket)), np.bincount(at, minlength=len(bucket))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (bucket, p.astype(np.int32), n - p.astype(np.int32))], names=["bucket", "p", "q"])


def fit(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, other_rows: int = TRAIN_OTHER, text_bytes: int = TRAIN_BYTES, seed: int = 11
) -> Model | None:
    """Fit on the rows of ``docs (doc_id, text)`` that ``labels (doc_id, toxic)`` marks; other columns are ignored.

    Rows without an id, text or mark are not used, and of rows with one id the least text. The
    draw is by the hash of the id, at a rate for each mark that gives about the documented number of
    rows, up to the documented bytes; the intercept is moved back to the true share. The
    driver holds counts by bucket and the drawn rows' buckets of some scale. None if a mark has no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    grid, rows = 1 << 24, {1: toxic_rows, 0: other_rows}
    rate = {k: min(grid, int(grid * most / n[k]) + 1) for k, most in rows.items()}
    drawn = marked.withColumn("ord", F.xxhash64("doc_id", F.lit(seed))).where(
        F.pmod("ord", F.lit(grid)) < F.when(F.col("toxic") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0]))
    )
    # bounded by the rows above, so it may be sent to all executors
    drawn = F.broadcast(drawn.orderBy("ord", "doc_id").limit(2 * (toxic_rows + other_rows)))
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= text_bytes // 16).join(drawn, "doc_id")
    sample = cut_lineage(texts.groupBy("doc_id", "toxic", "ord").agg(F.min("text").alias("text")))
    upto, free = {}, {k: text_bytes * most // (toxic_rows + other_rows) for k, most in rows.items()}
    for toxic, place, size in sample.select("toxic", "ord", F.octet_length("text")).orderBy("ord").collect():
        free[toxic] -= size
        if free[toxic] >= 0:
            upto[toxic] = place
    if len(upto) < 2:
        return None
    used = sample.where(F.col("ord") <= F.when(F.col("toxic") == 1, F.lit(upto[1])).otherwise(F.lit(upto[0])))
    sums = used.select("toxic", "text").mapInArrow(_counted, "bucket int, p int, q int").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    told = sums.toArrow()  # as many rows as buckets, at most
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    p[told["bucket"].to_numpy()], q[told["bucket"].to_numpy()] = told["p"].to_numpy(), told["q"].to_numpy()
    counts = {r[0]: r[1] for r in used.groupBy("toxic").count().collect()}
    scale = ratios(p, q, counts[1], counts[0])
    shared = spark.sparkContext.broadcast(scale != 0)

    def scaled(batches):
        for batch in batches:
            found = [_buckets(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x[shared.value[x]].tobytes() for x in found], pa.binary())], names=["toxic", "ord", "bucket"])

    found = used.select("toxic", "ord", "text").mapInArrow(scaled, "toxic int, ord bigint, bucket binary").orderBy("ord", "toxic", "bucket").collect()
    y = np.array([r[0] for r in found], np.float64)
    w, b = _regression([np.frombuffer(r[2], np.int32) for r in found], y, scale)
    return Model((w * scale).astype(np.float32), float(b - np.log(counts[1] / counts[0]) + np.log(n[1] / n[0])))


def ratios(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int) -> np.ndarray:
    """Log-count ratios of buckets in ``p`` of ``n_p`` toxic and ``q`` of ``n_q`` other rows, nearer to zero by their doubt."""
    ratio = np.log((p + SMOOTHING) / (n_p + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (n_q + 2 * SMOOTHING))
    doubt = DOUBT * np.sqrt(1 / (p + SMOOTHING) + 1 / (q + SMOOTHING))
    return np.where(p + q > 0, np.sign(ratio) * np.maximum(0, np.abs(ratio) - doubt), 0.0)


def _regression(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept: whole-batch logistic regression with adaptive steps, its products formed in parts."""
    size = np.array([len(x) for x in rows])
    index = np.full(len(scale), -1, np.int32)
    known = np.flatnonzero(scale)
    index[known] = np.arange(len(known))
    col = index[np.concatenate(rows)]
    value = scale[known]
    upto = np.concatenate(([0], np.cumsum(size)))
    cuts = np.unique(np.concatenate(([0, len(rows)], np.searchsorted(upto, np.arange(CHUNK, upto[-1], CHUNK)))))
    parts = [(a, b, np.repeat(np.arange(b - a), size[a:b]), col[upto[a] : upto[b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    w, b, m, v, mb, vb = np.zeros(len(known)), 0.0, 0.0, 0.0, 0.0, 0.0
    for step in range(1, STEPS + 1):
        scaled, g, gb = value * w, RIDGE * w, 0.0
        for i, j, row, own in parts:
            z = np.bincount(row, weights=scaled[own], minlength=j - i) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i:j]) / len(y)
            g += value * np.bincount(own, weights=error[row], minlength=len(known))
            gb += error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        pace = 0.02 * (1 - step / (STEPS + 1))
        w -= pace * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b -= pace * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    out = np.zeros(len(scale))
    out[known] = w
    return out, b


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and, last, the probability of toxicity in ``name``; a column of that name is replaced by it.

    A null text is an empty one and gets the score of no features. Without a
    model every score is 0. Repeated rows come out repeated, an empty table stays empty; other columns may have any
    names. A text is scored as a whole, by some 40 bytes for each of its characters. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() != name.lower()])
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at)
            out = [np.zeros(0)]
            for i, j in row_chunks(string_bytes(texts)[1], CACHED):
                out.append(np.zeros(j - i) if model is None else model.scores(texts.slice(i, j - i).to_pylist()))
            yield [*batch.columns, pa.array(np.concatenate(out), pa.float64())]

    return map_rows(docs, run, [(name, T.DoubleType())])
