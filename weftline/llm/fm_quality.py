"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions at a cost linear in the words, by the sum-of-squares identity.  x: L2-normalised counts of
hashed words, standardised structure statistics of the text, and log lengths.  Labels are learnt from at most
FIT_ROWS rows (by a hash of their id) outside the held-out fold; every whole text is scored.

Defined results: null and empty texts score by their statistics (all zero); null labels and labels without
a document are not used; without both labels in the sample all scores are 0.5; repeated rows score alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernels as k
from weftline.llm.runtime import few_of

FIT_ROWS = 6_000
BUCKETS = 1 << 15
FACTORS = 4
EPOCHS = 40

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "symbol": [*b"#*$%&|<>"],
    "bang": [*b"!?"],
    "stop": [*b".,;:"],
    "pipe": [*b"|"],
    "line": [10],
    "high": [*range(128, 256)],
}
STATISTICS = len(_CLASSES) + 6


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of hashed words, and the statistics by text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    words = k.Words(data, offsets, fold=True)
    count = np.diff(words.bounds)
    stats = np.zeros((n, STATISTICS))
    for j, members in enumerate(_CLASSES.values()):
        flag = np.zeros(256, dtype=np.int64)
        flag[members] = 1
        sums = np.concatenate([[0], np.cumsum(flag[data])])
        stats[:, j] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)
    text = np.repeat(np.arange(n), count)
    bucket = (words.hashes & k.U64(BUCKETS - 1)).astype(np.int64)
    key, times = np.unique(text * BUCKETS + bucket, return_counts=True)
    text, bucket, value = key // BUCKETS, key % BUCKETS, times.astype(float)
    norm = np.sqrt(np.bincount(text, value * value, minlength=n))
    value = value / norm[text]
    long = np.concatenate([[0], np.cumsum((words.end - words.start))])
    mean = (long[words.bounds[1:]] - long[words.bounds[:-1]]) / np.maximum(count, 1)
    # lines that repeat in one text, by hash
    edge = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1], offsets[1:]]))
    if len(edge) > 1:
        start, end = edge[:-1], edge[1:]
        whose = np.searchsorted(offsets, start, side="right") - 1
        hashes = k.byte_rolling(data).of(start, end)
        _, first = np.unique(np.stack([whose.astype(np.uint64), hashes]), axis=1, return_index=True)
        lines = np.bincount(whose, minlength=n)
        repeated = lines - np.bincount(whose[first], minlength=n)
    else:
        lines = repeated = np.zeros(n)
    j = len(_CLASSES)
    stats[:, j] = mean
    stats[:, j + 1] = np.bincount(text, minlength=n) / np.maximum(count, 1)
    stats[:, j + 2] = repeated / np.maximum(lines, 1)
    stats[:, j + 3] = np.log1p(count)
    stats[:, j + 4] = np.log1p(size)
    stats[:, j + 5] = np.bincount(text, value, minlength=n) / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))
    return text, bucket, value, stats


@dataclass
class Model:
    """Weights of words, then of statistics; how statistics are standardised."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, text: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(stats)
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        where, what = self.w[bucket] * value, self.v[bucket] * value[:, None]
        linear = np.bincount(text, where, minlength=n) + z @ self.w[BUCKETS:]
        own = z[:, :, None] * self.v[None, BUCKETS:]
        total, squares = own.sum(axis=1), (own**2).sum(axis=1)
        for f in range(self.v.shape[1]):
            total[:, f] += np.bincount(text, what[:, f], minlength=n)
            squares[:, f] += np.bincount(text, what[:, f] ** 2, minlength=n)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1)


def train(text: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """Full-batch AdaGrad on the logistic loss."""
    n, m = len(stats), BUCKETS + STATISTICS
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    z = np.clip((stats - mean) / scale, -5, 5)
    rng = np.random.default_rng(7)
    model = Model(float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(m), rng.normal(0, 0.02, (m, FACTORS)), mean, scale)
    seen_w, seen_v, seen_b = np.full(m, 1e-8), np.full((m, FACTORS), 1e-8), 1e-8
    for _ in range(epochs):
        what = model.v[bucket] * value[:, None]
        own = z[:, :, None] * model.v[None, BUCKETS:]
        total = own.sum(axis=1)
        for f in range(FACTORS):
            total[:, f] += np.bincount(text, what[:, f], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(model.logits(text, bucket, value, stats), -30, 30))) - y
        e = error[text] * value
        gw = np.concatenate([np.bincount(bucket, e, minlength=BUCKETS), z.T @ error]) / n + decay * model.w
        gv = np.empty((m, FACTORS))
        for f in range(FACTORS):
            gv[:BUCKETS, f] = np.bincount(bucket, e * (total[text, f] - what[:, f]), minlength=BUCKETS)
            gv[BUCKETS:, f] = ((error[:, None] * z) * (total[:, f][:, None] - own[:, :, f])).sum(axis=0)
        gv = gv / n + decay * model.v
        gb = error.mean()
        seen_w += gw * gw
        seen_v += gv * gv
        seen_b += gb * gb
        model.w -= rate * gw / np.sqrt(seen_w)
        model.v -= 0.3 * rate * gv / np.sqrt(seen_v)
        model.bias -= rate * gb / np.sqrt(seen_b)
    return model


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model | None:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("long").alias("label"))
    few = known.where(few_of(F.col("_id"), rows, known.count()))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(few), "_id").select("label", "text")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in k.slices(batch.column(1)):
                text, bucket, value, stats = features(data, offsets)
                counts = np.bincount(text, minlength=len(stats))
                columns = [batch.column(0).slice(first, len(stats)), k.lists(bucket, counts, pa.int32()), k.lists(value, counts, pa.float32()), k.lists(stats.ravel(), np.full(len(stats), STATISTICS), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "bucket", "value", "stats"])

    # bounded: FIT_ROWS rows of hashed features
    got = sample.mapInArrow(rows_of, "label long, bucket array<int>, value array<float>, stats array<double>").toArrow()
    y = got["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    lists = {c: got[c].combine_chunks() for c in ("bucket", "value", "stats")}
    counts = np.array([len(x) for x in lists["bucket"]])
    flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
    return train(np.repeat(np.arange(len(y)), counts), flat["bucket"].astype(np.int64), flat["value"].astype(float), flat["stats"].reshape(len(y), STATISTICS), y)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in k.slices(batch.column(1)):
                n = len(offsets) - 1
                p = np.full(n, 0.5) if model is None else 1 / (1 + np.exp(-np.clip(model.logits(*features(data, offsets)), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_factorisation_machine(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
