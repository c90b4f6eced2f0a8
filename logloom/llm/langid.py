"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is trained by stochastic gradient descent in numpy, on a bounded sample
of labelled rows, on the driver; temperature and the rejection threshold are
calibrated on rows that the descent does not see. Prediction reads whole texts:
because the average and the softmax's input are linear, embeddings and output
weights fold into one table of logits by bucket where there are fewer languages than
dimensions; else they stay apart, so the model has 64 bytes for a language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.base import row_chunks, schema, small_batches, string_bytes
from logloom.llm.ngrams import grams, row_sums
from logloom.operators.lineage import cut_lineage

BITS, SIZES, DIM = 14, (2, 3, 4), 16
#: Labelled rows that one fit may use, about, in all; each language gets an even share.
TRAIN_ROWS = 2000
#: Bytes of their texts, in all; a text of more than a sixteenth of that is not used.
TRAIN_BYTES = 8 << 20
#: Share of the true-class probabilities of calibration rows below the rejection threshold.
REJECT_SHARE = 0.01
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter of any script."""
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # by bucket
    output: np.ndarray  # by dimension and language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def __post_init__(self):
        folded = len(self.languages) < DIM
        self.tables = np.ascontiguousarray((self.embedding @ self.output if folded else self.embedding).T)
        self.rest = np.eye(len(self.languages), dtype=np.float32) if folded else self.output

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Unscaled logits by row and language."""
        total, count = np.zeros((len(self.tables), len(offsets) - 1)), np.zeros(len(offsets) - 1)
        for size in SIZES:
            bucket, begin = grams(data, offsets, size, BITS)
            for own, table in zip(total, self.tables, strict=True):
                value, n = row_sums(table[bucket], begin, offsets)
                own += value
            count += n
        return (total / np.maximum(count, 1)).T @ self.rest + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, offsets) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(rows):
    """Distinct buckets and their shares for each (lang, order, text); bounded by the buckets, however long a text is."""
    for batch in rows:
        data, offsets = string_bytes(batch.column(2))
        out = []
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            found = np.concatenate([grams(own, np.array([0, len(own)]), size, BITS)[0] for size in SIZES])
            bucket, count = np.unique(found, return_counts=True)
            out.append((bucket.astype(np.int32).tobytes(), (count / max(1, count.sum())).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "ord", "bucket", "share"]
        )


#: Bytes of a table of languages up to which it is sent to all tasks; a larger one is joined by a shuffle.
MAX_BROADCAST_BYTES = 16 << 20


def _table(df: DataFrame, rows: list[tuple], kind: str) -> DataFrame:
    out = df.sparkSession.createDataFrame(rows, kind)
    return F.broadcast(out) if sum(len(r[0].encode()) + 64 for r in rows) <= MAX_BROADCAST_BYTES else out


def fit(train: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES, epochs: int = 12, seed: int = 7) -> Model | None:
    """Fit on ``(doc_id, text, lang)``; rows without text or language are not used. None if nothing is left.

    Rows are drawn by the hash of their id and text, each language at the rate that
    gives it about its share of ``rows``, one row at least, and up to its share of the bytes. Other columns are ignored.
    """
    small_batches(train.sparkSession)
    usable = train.where(F.col("lang").isNotNull() & (F.octet_length("text") <= text_bytes // 16)).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("ord"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # a row for each learnt value
    if not counts:
        return None
    share, grid = max(1, rows // len(counts)), 1 << 24
    dim = _table(train, [(lang, min(grid, int(grid * share / n) + 1)) for lang, n in counts.items()], "lang string, rate int")
    drawn = usable.join(dim, "lang").where(F.pmod("ord", F.lit(grid)) < F.col("rate")).drop("rate").dropDuplicates(["lang", "ord"])
    drawn = cut_lineage(drawn.orderBy("ord", "lang").limit(2 * share * len(counts)))
    upto, free = {}, dict.fromkeys(counts, text_bytes // len(counts))
    for lang, place, size in drawn.select("lang", "ord", F.octet_length("text")).orderBy("ord").collect():
        free[lang] -= size
        if free[lang] >= 0 or lang not in upto:
            upto[lang] = place
    ends = _table(train, list(upto.items()), "lang string, upto bigint")
    sample = drawn.join(ends, "lang").where("ord <= upto").select("lang", "ord", "text").mapInArrow(_features, "lang string, ord bigint, bucket binary, share binary").orderBy("ord", "lang").collect()
    languages = sorted({r[0] for r in sample})
    x = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in sample]
    y = np.array([languages.index(r[0]) for r in sample])
    keep = np.array([len(b) > 0 for b, _ in x], bool)
    x, y = [v for v, k in zip(x, keep, strict=True) if k], y[keep]
    if not x:
        return None
    rng = np.random.RandomState(seed)
    held = np.arange(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
    train_at = np.flatnonzero(~held)
    emb = (rng.rand(1 << BITS, DIM).astype(np.float32) - 0.5) / DIM
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    batch, steps, step = 16, epochs * max(1, len(train_at) // 16), 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(train_at), max(1, len(train_at) // batch)):
            pace = 0.5 * (1 - step / (steps + 1))
            step += 1
            mean = np.stack([x[i][1] @ emb[x[i][0]] for i in at])
            error = softmax(mean @ out + bias)
            error[np.arange(len(at)), y[at]] -= 1
            back = error @ out.T
            out -= pace * (mean.T @ error)
            bias -= pace * 0.1 * error.mean(axis=0)
            for g, i in zip(back, at, strict=True):
                emb[x[i][0]] -= (pace * 20) * x[i][1][:, None] * g
    model = Model(languages, emb, out, bias)
    check = np.flatnonzero(held) if held.any() else np.arange(len(x))
    raw = np.stack([x[i][1] @ emb[x[i][0]] @ out + bias for i in check])
    loss = lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(check)), y[check]], 1e-12)).mean()
    model.temperature = float(min((2.0**k for k in np.arange(-4, 4.25, 0.25)), key=loss))
    own = softmax(raw / model.temperature)[np.arange(len(check)), y[check]]
    model.threshold = float(np.quantile(own, REJECT_SHARE))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row of ``(doc_id, text)``; ``und`` with score 0 for a null text or one without a letter.

    Repeated rows come out repeated, an empty table stays empty, other columns are ignored. A text is read as a
    whole, by some 50 bytes for each of its own. ``lang_pred`` is the likeliest learned language even where ``rejected`` says
    that its calibrated probability is below the threshold. Without a model all is ``und``.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            data, offsets = string_bytes(texts)
            lang, score = [], []
            for i, j in row_chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                if model is None:
                    lang += ["und"] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                p = model.probabilities(data[offsets[i] : offsets[j]], own)
                best = p.argmax(axis=1)
                for r in range(j - i):
                    ok = has_letter(texts[i + r].as_py())
                    lang.append(model.languages[best[r]] if ok else "und")
                    score.append(float(p[r, best[r]]) if ok else 0.0)
            rejected = [s < (model.threshold if model else 1.0) for s in score]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema(docs, "doc_id", lang_pred="string", score="double", rejected="boolean"))
