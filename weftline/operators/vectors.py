"""Embedding of texts by a given function, and generation by a given function: the two hooks for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 2000


class Embedder(Protocol):
    """A named vector space; called in tasks with lists of texts, so it must be picklable."""

    space: str
    dims: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    """A text model: a prompt to a reply, called in tasks."""

    def __call__(self, prompt: str) -> str: ...


class Characters:
    """The built-in embedder: code points modulo the dimensions, counted and scaled to length 1."""

    def __init__(self, dims: int = 8):
        self.dims, self.space = dims, f"characters-{dims}"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = []
        for text in texts:
            counts = np.bincount(np.array([ord(c) % self.dims for c in text], dtype=np.int64), minlength=self.dims).astype(float)
            norm = np.sqrt((counts**2).sum())
            out.append((counts / norm if norm else counts).tolist())
        return out


def text_hash(text: str = "text"):
    return F.substring(F.sha2(F.substring(text, 1, MOST_CHARS), 256), 1, 16)


def pending(events: DataFrame, vectors: DataFrame | None, newest: str = "ts", key: str = "id", limit: int | None = None) -> DataFrame:
    """Events with text whose present text has no vector yet, newest first."""
    rows = events.where("role <> '' and text <> ''").withColumn("text_hash", text_hash())
    if vectors is not None:
        rows = rows.join(vectors.select(key, "text_hash"), [key, "text_hash"], "left_anti")
    rows = rows.orderBy(F.desc(newest), key)
    return rows if limit is None else rows.limit(limit)


def embedded(rows: DataFrame, embedder: Embedder, key: str = "id", batch: int = 64) -> DataFrame:
    """(key, text_hash, space, vector) of rows (key, text, text_hash); only the first MOST_CHARS characters are embedded."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "text_hash": part["text_hash"], "space": embedder.space, "vector": embedder([x[:MOST_CHARS] for x in part["text"]])})

    return rows.select(key, "text_hash", "text").mapInPandas(work, f"{key} {kinds[key]}, text_hash string, space string, vector array<double>")


def append_vectors(events: DataFrame, path: str, embedder: Embedder, **options) -> None:
    """Embed what is pending and append it; a run that ends early goes on where its committed rows end."""
    spark = events.sparkSession
    try:
        stored = spark.read.parquet(path).where(F.col("space") == embedder.space)
    except AnalysisException as error:  # no vectors yet
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = None
    embedded(pending(events, stored, **options), embedder).write.mode("append").parquet(path)


def generated(rows: DataFrame, generator: Callable[[str], str], key: str = "id", prompt: str = "prompt") -> DataFrame:
    """(key, reply): a reply is null where the model failed, so one bad prompt ends no job."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def one(text: str) -> str | None:
        try:
            return generator(text)
        except Exception:  # noqa: BLE001  the hook's own failures
            return None

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "reply": [one(x) for x in frame[prompt]]}, columns=[key, "reply"])

    return rows.select(key, prompt).mapInPandas(work, f"{key} {kinds[key]}, reply string")
