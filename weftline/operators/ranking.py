"""Retrieval operators: BM25, exact kNN, reciprocal-rank fusion, relevance floor."""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K1, B = 1.2, 0.75
#: Buckets of terms of a written index.
BUCKETS = 32
RRF_K = 60


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) > 0)


def token_count(text: Column) -> Column:
    """size(tokens(text)) in one pass over the text, without an array of words."""
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_len, term, tf): the full-text index, to be written once and read by bm25()."""
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w")).select("doc_id", F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    return words.groupBy("doc_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(words: Column) -> Column:
    """[(term, tf)] of an array of words: sorted, so that a word's places are side by side; null for none."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        # a lambda's variable is evaluated once for the array
        return F.transform(F.array(starts), lambda b: F.transform(b, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - i).cast("long").alias("tf"))))[0]

    return F.when(F.size(words) > 0, F.transform(F.array(F.sort_array(words)), runs)[0])


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_len) in words."""
    return docs.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("doc_len"))


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The statistics of the batches of an index; None where there is none."""
    try:
        return spark.read.parquet(f"{path}/statistics")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _add(docs: DataFrame, path: str, number: int, id_col: str, text_col: str, have: DataFrame | None = None) -> None:
    """One batch, of documents that are not in have (doc_id): postings by term bucket and in term order, its documents, and last its statistics, which commit it.

    A document's words are counted within its row, so the postings are shuffled once, into parts of buckets of a like
    size. Documents that share id and length have postings of their own; search_index() adds them up.
    """
    spark = docs.sparkSession
    fresh = lambda df: df if have is None else df.join(have, "doc_id", "left_anti")
    texts = fresh(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    words = texts.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("doc_len"), F.explode(counted(F.col("w"))).alias("x"))
    hits = words.select("doc_id", "doc_len", "x.term", "x.tf").withColumn("bucket", bucket(F.col("term")))
    hits.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
    size = fresh(lengths(docs, id_col, text_col))  # the texts stay where they are: ids and lengths are joined
    size.write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
    stored = spark.read.schema(size.schema).parquet(f"{path}/documents/batch={number}")
    stored.agg(F.count(F.lit(1)).alias("n"), F.count("doc_len").alias("counted"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("words")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics/batch={number}")


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """A full-text index in an empty folder: postings in term order within buckets of terms, documents, and their statistics."""
    if _committed(docs.sparkSession, path) is not None:
        raise ValueError(f"there is an index in {path}; fold_new() adds to it")
    _add(docs, path, 0, id_col, text_col)


def fold_new(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Documents that the index lacks are added to it, as a batch of its own; those that it has are left as they are.

    Postings, documents and statistics are read up to the last statistics alone, so a batch that broke off is not seen
    and is written over by the next one.
    """
    spark = docs.sparkSession
    stats = _committed(spark, path)
    if stats is None:
        return _add(docs, path, 0, id_col, text_col)
    last = stats.agg(F.max("batch")).first()[0]
    have = spark.read.parquet(f"{path}/documents").where(F.col("batch") <= last).select("doc_id")
    none = docs.select(F.col(id_col).alias("doc_id")).join(have, "doc_id", "left_anti").isEmpty()
    return None if none else _add(docs, path, last + 1, id_col, text_col, have)


def search_index(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(doc_id, score) by BM25 over a written index; of the postings only the buckets and row groups of the terms are read."""
    # a row for each batch: three numbers come to the driver
    stats = _committed(spark, path).agg(F.max("batch").alias("last"), F.sum("n").alias("n"), (F.sum("words") / F.sum("counted")).alias("mean")).first()
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    hits = spark.read.parquet(f"{path}/postings").where((F.col("batch") <= stats.last) & F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
    hits = hits.groupBy("batch", "doc_id", "doc_len", "term").agg(F.sum("tf").alias("tf"))
    return _scores(hits, spark.range(1).select(F.lit(stats.n).alias("n"), F.lit(stats["mean"]).cast("double").alias("mean")))


def _scores(hits: DataFrame, stats: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """hits: (doc_id, doc_len, term, tf) of the terms asked for; stats: one row; asked: (query, term), for a score by query."""
    held = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row for each term asked for
    tf, df, n = F.col("tf"), F.col("df"), F.col("n")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("mean")))
    joined = hits.join(F.broadcast(held), "term").join(F.broadcast(stats))
    if asked is not None:
        joined = joined.join(F.broadcast(asked), "term")  # a row for each word of the queries
    return joined.groupBy(*(["query"] if asked is not None else []), "doc_id").agg(F.round(F.sum(part), 9).alias("score"))


def term_hits(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_len, term, tf) of the terms; only texts that hold one as a substring are split into words."""
    low = F.lower(text_col)
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    # a text that does not even hold a term as a substring can't hold it as a word
    maybe = F.coalesce(F.greatest(*[F.contains(low, F.lit(t)) for t in terms]) if len(terms) > 1 else F.contains(low, F.lit(terms[0])) if terms else F.lit(False), F.lit(False))
    hits = docs.where(maybe).select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    hits = hits.select("doc_id", F.size("w").alias("doc_len"), F.explode(F.filter("w", lambda x: F.array_contains(wanted, x))).alias("term"))
    return hits.groupBy("doc_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (n, mean): how many documents, and their mean length in words."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(token_count(F.col(text_col))).alias("mean"))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of the documents with any of the terms, without a written index.

    Only texts that may hold a term are split; the others are counted for the statistics by length alone.
    """
    return _scores(term_hits(docs, terms, id_col, text_col), statistics(docs, text_col))


def bm25_many(docs: DataFrame, queries: list[list[str]], limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query, doc_id, score, place): the best `limit` documents of each list of terms, all of them in one pass over the texts."""
    terms = sorted({t for q in queries for t in q})
    asked = docs.sparkSession.createDataFrame([(i, t) for i, q in enumerate(queries) for t in dict.fromkeys(q)], "query int, term string")
    scored = _scores(term_hits(docs, terms, id_col, text_col), statistics(docs, text_col), asked)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


def reciprocal(df: DataFrame, weight: float, *by: Column) -> DataFrame:
    """Adds `part`, weight / (60 + rank), ranks from 0; for short lists such as a top-k."""
    return df.withColumn("part", F.lit(weight) / (RRF_K + F.row_number().over(W.orderBy(*by)) - 1))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest by cosine distance, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector_col, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) * float(sum(x * x for x in query) ** 0.5)
    return vectors.select(F.col(id_col), (F.round(1 - dot / norm, 6) + 0.0).alias("distance")).orderBy("distance", id_col).limit(k)


def fuse(lists: list[tuple[DataFrame, float]], key: str, order: list[list[Column]]) -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (60 + rank) over ranked lists, ranks from 0."""
    ranked = None
    for (df, weight), by in zip(lists, order, strict=True):
        part = reciprocal(df, weight, *by).select(key, "part")
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"))


def relevance_floor(df: DataFrame, score: str = "score", share: float = 0.5) -> DataFrame:
    best = df.agg(F.max(score).alias("_best"))
    return df.join(F.broadcast(best)).where(F.col(score) >= share * F.col("_best")).drop("_best")  # best: one row


def head(ranked: DataFrame, kind: str, score: str, key: str, k: int, most: int = 2, share: float = 0.5, short: bool = False) -> DataFrame:
    """The top k events, and the pages that earned a slot beside them; further pages only fill up to k.

    A page earns its slot with a score above all events, or as one of the first `most` pages with `share` of the
    best event's score.  Pages come in score order, so a page's rank tells how many were taken before it.

    The first rows of each kind come from one pass that ranks before it shuffles; only pages above all events, of
    which there may be any number, are taken from a second one.  A list that is known to be short (short: one that was fused
    of top-k lists) is ranked as a whole instead, in one pass.
    """
    event = F.col(kind) == "event"
    by = [F.desc(score), F.when(event, 0).otherwise(1), F.col(key)]
    few = W.partitionBy()
    first = ranked.withColumn("_at", F.row_number().over(W.partitionBy(kind).orderBy(F.desc(score), key)))
    first = first if short else first.where(F.col("_at") <= k + most)
    # from here on at most k + most rows of each kind
    first = first.withColumn("_best", F.coalesce(F.max(F.when(event, F.col(score))).over(few), F.lit(0.0)))
    first = first.withColumn("_above", ~event & (F.col(score) > F.col("_best")))
    first = first.withColumn("_seats", F.greatest(F.lit(0), F.lit(most) - F.sum(F.col("_above").cast("int")).over(few)))
    first = first.withColumn("_nth", F.row_number().over(W.partitionBy(event, "_above").orderBy(*by)))
    earned = (F.col("_nth") <= F.col("_seats")) & (F.col(score) >= share * F.col("_best"))
    tier = F.when(event, F.when(F.col("_nth") <= k, 0)).when(F.col("_above"), F.lit(0) if short else F.lit(None)).otherwise(F.when(earned, 0).otherwise(1))
    told = first.withColumn("_tier", tier).where("_tier is not null").select(*ranked.columns, "_tier")
    if not short:
        best = ranked.where(event).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("_best"))
        above = ranked.where(~event).join(F.broadcast(best)).where(F.col(score) > F.col("_best"))  # best: one row
        told = told.unionByName(above.select(*ranked.columns, F.lit(0).alias("_tier")))
    told = told.withColumn("place", F.row_number().over(W.orderBy("_tier", *by)).cast("long")).withColumn("_n", F.sum((F.col("_tier") == 0).cast("int")).over(few))
    return told.where(F.col("place") <= F.greatest(F.lit(k), F.col("_n"))).select(*ranked.columns, "place")


def snippet(text: Column, terms: list[str], width: int = 900, before: int = 240) -> Column:
    """A window of the text around the first place of any term."""
    low = F.lower(text)
    first = F.array_min(F.filter(F.array(*[F.instr(low, t) for t in terms]), lambda x: x > 0))
    return F.substring(text, F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - before), F.lit(width))


def bag_vector(text: Column, dims: int = 8) -> Column:
    """The built-in test embedder: code points modulo `dims`, counted and scaled to length 1 (zeros for no text)."""
    bins = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % dims)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(bins, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm)).otherwise(counts)
