"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(theta_j - w.x): one weight vector shared by all ordered thresholds
theta_1 < theta_2 < ...  A document's score is its expected severity, the sum over j of P(grade >= j).

Features are words (runs of letters, lower case) and beginnings of words that a log-likelihood-ratio test over distinct labelled
texts ties to grades above 0; their value is log(1 + count) in the whole text.  The fit sees at most FIT_ROWS
labelled rows, chosen by a hash of their id; every document is scored.

Where labels are only 0/1, graded() spreads 1 over severity grades: a toxic text is of grade 1, 2 or 3 as it
has up to one, two to three, or more words of a list.  That list is made of the words tied to the labels of one third
of the sample; features and weights are learnt from the other two thirds, so no text's grade comes from words that
its own label has chosen.

Defined results: null and empty texts score what a text without features scores; labels that are null, and
labels without a document, are not used; ids with several labels take the largest; the sample is of about FIT_ROWS
rows however many labels there are; without any toxic label or feature all scores are 0; without grade words (few
toxic labels) every toxic text is of grade 1; repeated rows score alike; an empty table gives an empty result; the scoring
keeps all rows, and in reject() all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import cut, few_of

FIT_ROWS = 20_000
FEATURES = 512
GRADES = 3
#: The least log-likelihood ratio of a feature, and the least share of toxic texts that hold it.
LEAST_G2 = 15.0
LEAST_SHARE = 0.003
#: Expected severity from which a document is rejected.
REJECT_AT = 0.6
#: Lengths of the word beginnings that count as features beside the words themselves.
STEMS = (4, 5, 6)
#: Words that a task remembers.
KNOWN = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    """A word, and its beginnings marked by a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


class Lookup(dict):
    """The features of each word; words are looked at once."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = tuple(self.index[x] for x in terms(word) if x in self.index)
        return found

    def counts(self, text: str) -> tuple[Counter, int]:
        """How often each feature is found, and how many words have any."""
        hits = [x for x in map(self.__getitem__, _WORD.findall(text.lower())) if x]
        return Counter(i for x in hits for i in x), len(hits)


@dataclass
class Model:
    """Weights by word and the ascending thresholds."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, x: np.ndarray) -> np.ndarray:
        """Expected severity of the linear scores w.x."""
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -50, 50)))).sum(axis=1)

    def linear(self, lookup: Lookup, text: str | None) -> tuple[float, int]:
        found, hits = lookup.counts(text or "")
        return sum(self.weights[i] * np.log1p(n) for i, n in found.items()), hits


def _sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    few = known.where(few_of(F.col("_id"), rows, known.count()))
    # at most about FIT_ROWS pairs of integers
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "_id").groupBy("text").agg(F.round(F.avg("label")).cast("long").alias("label"))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted({t for w in set(_WORD.findall(x.lower())) for t in terms(w)}) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])


def features(sample: DataFrame, most: int = FEATURES) -> list[str]:
    """The words tied to labels above 0, strongest first; at most `most` come to the driver."""
    n = sample.agg(F.count_if(F.col("label") > 0).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    if not n.pos or not n.neg:
        return []
    words = sample.select(F.col("label").cast("long").alias("label"), "text").mapInArrow(_word_rows, "label long, words array<string>")
    by = words.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("label") > 0).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    a, b, p, q = F.col("a"), F.col("b"), float(n.pos), float(n.neg)
    share = (a + b) / (p + q)

    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)

    g2 = 2 * (part(a, p * share) + part(b, q * share) + part(p - a, p * (1 - share)) + part(q - b, q * (1 - share)))
    tied = by.where((a >= max(3.0, LEAST_SHARE * p)) & (a / p > 5 * b / q)).withColumn("g2", g2).where(F.col("g2") >= LEAST_G2)
    return [r.word for r in tied.orderBy(F.desc("g2"), "word").limit(most).select("word").collect()]


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent (Adam) of the cumulative-link likelihood; thresholds stay in order as sums of exponentials."""
    n, m = x.shape
    theta = np.zeros(m + grades)
    theta[m] = np.log((np.mean(y == 0) + 1e-3) / (np.mean(y > 0) + 1e-3))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, raw = theta[:m], theta[m:]
        gaps = np.exp(np.clip(raw[1:], -10, 5))
        cuts = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.clip(np.concatenate([np.full((n, 1), -60.0), cuts[None, :] - (x @ w)[:, None], np.full((n, 1), 60.0)], axis=1), -60, 60)
        s = 1 / (1 + np.exp(-z))
        d = s * (1 - s)
        hi, lo = s[np.arange(n), y + 1], s[np.arange(n), y]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = d[np.arange(n), y + 1] / p, d[np.arange(n), y] / p
        gw = -(x.T @ (dhi - dlo)) / n - decay * w
        gcut = np.array([(dhi[y == j].sum() - dlo[y == j + 1].sum()) / n for j in range(grades)])
        graw = np.concatenate([[gcut.sum()], gaps * np.cumsum(gcut[::-1])[::-1][1:]])
        g = np.concatenate([gw, graw])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    raw = theta[m:]
    return theta[:m], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(raw[1:], -10, 5)))])


def graded(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Severity grades 0 to 3 from binary labels and the number of grade words."""
    return np.where(toxic > 0, 1 + (hits >= 2) + (hits >= 4), 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, binary: bool = True) -> Model:
    """binary: the label is 0/1; else it is the grade, 0 to GRADES."""
    sample = cut(lambda: _sample(docs, labels, rows, id_col, text_col, label_col))
    apart = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    grade_words = features(sample.where(apart)) if binary else []
    sample = sample.where(~apart) if binary else sample
    words = features(sample)
    index = {w: i for i, w in enumerate(words)}
    if not words:
        return Model({}, np.zeros(0), np.full(GRADES, 50.0))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, grading = Lookup(index), Lookup({w: i for i, w in enumerate(grade_words)})
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [lookup.counts(x)[0] for x in texts]
            columns = [pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), pa.array([grading.counts(x)[1] for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["label", "at", "n", "hits"])

    # bounded: FIT_ROWS rows of at most FEATURES pairs; order matters to no result
    got = sample.select(F.col("label").cast("long").alias("label"), "text").mapInArrow(counts, "label long, at array<int>, n array<int>, hits long").toPandas()
    x = np.zeros((len(got), len(words)))
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        x[i, np.asarray(at, dtype=np.int64)] = np.log1p(np.asarray(n, dtype=np.float64))
    label = got["label"].to_numpy()
    hits = got["hits"].to_numpy()
    y = graded(label, hits) if binary else np.clip(label, 0, GRADES)
    weights, cuts = fit_ordinal(x, y.astype(np.int64))
    return Model(index, weights, cuts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """(doc_id, severity, n_hits, rejected) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.words)
        for batch in batches:
            got = [model.linear(lookup, x) for x in batch.column(1).to_pylist()]
            severity = model.severity(np.array([x[0] for x in got]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array([x[1] for x in got], pa.int64()), pa.array(severity >= reject_at)], names=["doc_id", "severity", "n_hits", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "doc_id long, severity double, n_hits long, rejected boolean")


def reject(docs: DataFrame, model: Model, text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The documents below the limit, with their own columns; one pass, nothing moves."""
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.words)
        for batch in batches:
            severity = model.severity(np.array([model.linear(lookup, x)[0] for x in batch.column(at).to_pylist()], dtype=float))
            yield batch.filter(pa.array(severity < reject_at))

    return docs.mapInArrow(rows, docs.schema)


def op1_toxicity_ordinal(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
