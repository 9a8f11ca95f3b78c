"""Substring dedup over a compacted de Bruijn graph of words.

The k-mers of 13 words are the edges of the graph.  Consecutive k-mers with one minimizer make a path
piece (a super-k-mer, as minimizer-based compaction of de Bruijn graphs has it).  Pieces with equal content
are one nonbranching path and collapse in an aggregate; only where a minimizer has several different
pieces does the graph branch, and only those pieces are opened into their k-mer edges and compared edge by
edge.  Source coordinates (document, first word) then verify each repeated span and cut it out of its text.

Result per document: a word goes if a window of 13 words covers it whose word sequence also starts in a
document with a smaller doc_id, judged on the input.

Defined results: a null text has no words; a document of fewer than 13 words keeps all; a null doc_id
is neither smaller nor larger than any other, so that document keeps all and takes nothing from others;
rows that share a doc_id are judged each by itself and don't remove each other; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernels as k
from weftline.llm import spans
from weftline.llm.runtime import cut

WINDOW = 13
GRAM = 5


def _edges(window: int):
    def make(raw: bytes, first: np.ndarray, count: np.ndarray) -> list:
        words = k.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        edges = k.Rolling(words.hashes, 1).grams(window).view(np.int64)
        return [edges[a : a + n] for a, n in zip(first, count, strict=True)]

    return make


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, spans) of each document; spans in words, end excluded."""
    docs = spans.keyed(docs, id_col, text_col)
    # a document without an id neither loses words nor takes them, so it has no runs
    found = spans.candidates(docs.where("doc_id is not null"), True, gram, window, across=True)
    runs = spans.runs_of(found, True, gram, window)
    # one row for each path piece, with its first source
    first, last = F.min(F.struct("doc_id", "text_key", "place")).alias("first"), F.max("doc_id").alias("last")
    pieces = cut(lambda: runs.groupBy("anchor", "content").agg(first, last).select("anchor", "content", "first.*", "last"))
    branching = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("n > 1 and lo < hi").select("anchor")
    need = pieces.join(branching.hint("shuffle_hash"), "anchor").select("anchor", "content", "doc_id", "text_key", "place")
    opened = cut(lambda: spans.fetched(found, need, _edges(window), "array<long>"))
    edges = opened.select("anchor", "content", "doc_id", F.posexplode("made").alias("at", "edge"))
    least = edges.groupBy("edge").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("edge", "least")
    covered = cut(lambda: edges.join(least.hint("shuffle_hash"), "edge").where("least < doc_id").groupBy("anchor", "content").agg(F.sort_array(F.collect_set("at")).alias("at")))
    sources = pieces.select("anchor", "content", F.col("doc_id").alias("source"), "last").join(covered, ["anchor", "content"], "left")
    sources = sources.where("last > source or at is not null").drop("last")
    hits = spans.hits_of(runs, sources, F.coalesce(F.col("doc_id") > F.col("source"), F.lit(False)))
    gone = spans.removed(found, hits, window, True, False).dropDuplicates(["doc_id", "text_key"])
    every = docs.mapInArrow(spans.digests(True, True), "doc_id long, text_key long, n_units long, sha string")
    return every.join(gone, spans.same_doc(every, gone), "left").select(
        every["doc_id"],
        every["n_units"].alias("n_words"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce(gone["sha"], every["sha"]).alias("kept_sha256"),
        "spans",
    )


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
