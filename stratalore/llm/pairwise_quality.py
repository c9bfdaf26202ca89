"""Quality scores from pairwise preferences (Bradley-Terry).

A labelled good document is preferred to a labelled bad one; the score of a
document is a linear function of features of its text, and its weights minimise
the logistic loss of score differences over preference pairs. The threshold is
the quantile of the training scores at the share of bad labels, and scores are
moved so that it lies at ``CUT``.

Training takes at most ``MAX_ROWS`` labelled rows (the first by a hash of the id)
and ``MAX_PAIRS`` pairs of them, so what reaches the driver is bounded.

Defined results: a null text counts as empty; without both labels every weight is
zero and every score is above the threshold; null labels are left out; several
labels of one id count each; of texts that share an id one is learned from; repeated
rows give a row each; an empty table gives
an empty table; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from stratalore.session import bound_batches, ship

MAX_ROWS, MAX_PAIRS = 20_000, 60_000
CUT, RIDGE, STEPS = 0.3, 1e-3, 25

_SYMBOLS = np.array([*b"#*$%&<>"])
FEATURES = ["log_words", "short", "word_length", "upper", "symbols", "bars", "shouts", "digits", "stops", "lines", "adjacent", "types", "bigrams", "other"]


def features(data: bytes | None) -> list[float]:
    """Features of a whole text, each of the order of 1."""
    data = data or b""
    words = data.split()
    n, size = len(words), max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper = int(count[97:123].sum()), int(count[65:91].sum())
    per_word = lambda k: min(3.0, float(k) / max(1, n))
    types = math.log(len(set(words))) / math.log(n) if n > 1 else 1.0
    return [
        math.log1p(n) / 5,
        1.0 if n < 8 else 0.0,
        min(3.0, size / max(1, n) / 6),
        upper / max(1, upper + lower),
        per_word(count[_SYMBOLS].sum()),
        per_word(count[124]),
        per_word(count[33]),
        min(1.0, float(count[48:58].sum()) / size * 10),
        per_word(count[46] + count[63]) * 4,
        per_word(count[10]) * 4,
        sum(map(eq, words, words[1:])) / max(1, n - 1),
        types * types,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1) if n > 1 else 1.0,
        float(count[128:].sum()) / size,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray) -> Model:
    """Weights from preference pairs of all good with all bad rows, or ``MAX_PAIRS`` drawn from them."""
    width = x.shape[1]
    if not good.any() or good.all():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    rng = np.random.default_rng(0)
    if len(up) * len(down) <= MAX_PAIRS:
        i, j = (a.ravel() for a in np.meshgrid(up, down))
    else:
        i, j = rng.choice(up, MAX_PAIRS), rng.choice(down, MAX_PAIRS)
    d = z[i] - z[j]
    w = np.zeros(width)

    def loss(w):
        return np.logaddexp(0, -d @ w).mean() + RIDGE * w @ w / 2

    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = -(d * p[:, None]).mean(axis=0) + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(width)
        step, rate, now = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        while rate > 1e-4 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0)
    scores = model.raw(x)
    ordered, k = np.sort(scores), int((~good).sum())
    model.threshold = float((ordered[k - 1] + ordered[min(k, len(ordered) - 1)]) / 2)
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from stratalore.llm.pairwise_quality import features

    for b in batches:
        rows = [features(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows that are not held out."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    known = labels.select(labels[id_col].cast("long").alias("id"), (labels[label_col] == 1).alias("good")).where("id is not null and good is not null").where(~held_out(F.col("id")))
    sample = known.orderBy(F.xxhash64("id"), "id", "good").limit(MAX_ROWS).collect()
    picked = docs.sparkSession.createDataFrame(sorted({(r.id,) for r in sample}), "id long")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    # At most MAX_ROWS ids of 8 bytes go out to every task, and one row of features for each comes back, however often ids repeat.
    rows = texts.join(F.broadcast(picked), "id").select("id", "text").mapInArrow(_extract, "id long, x array<double>").groupBy("id").agg(F.min("x").alias("x"))
    found = {r.id: r.x for r in rows.collect()}
    known = [(found[r.id], r.good) for r in sample if r.id in found]
    return fit(np.array([x for x, _ in known], float).reshape(len(known), len(FEATURES)), np.array([good for _, good in known], bool))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; with ``carry`` also ``doc``, all columns as one struct."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    state = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col].cast("long")).alias("held_out"), docs[text_col].cast("string").alias("text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if carry else []))
    kept = [i for i, f in enumerate(state.schema) if f.name != "text"]
    picked = [state.schema[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.pairwise_quality import features

        for b in batches:
            x = np.array([features(t) for t in b.column(2).cast(pa.binary()).to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*(f.name for f in picked), "score", "predicted"])

    schema = StructType([*picked, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return state.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels), **options)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; columns stay as they are."""
    return classify(docs, labels, carry=True).where("predicted = 1").select("doc.*")
