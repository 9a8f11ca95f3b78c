"""Quality rules: hashed n-gram log-likelihood ratio between a trusted and a raw multinomial.

Words and pairs of words are hashed to BUCKETS; two multinomials with add-one smoothing are counted, one
over all trusted documents (labelled good), one over all documents.  A document's score is the mean over its
n-grams of log(p_trusted / p_raw); base rules (too few words, too much repetition) and a fixed threshold
decide on every document.  Built-in SQL functions only:
a join with the labels by id, one aggregate of fixed size, then one pass without a shuffle.

Defined results: a null text has no words and fails the base rules; texts of one word have no pairs; without
trusted labels the ratio is even and only the base rules decide; repeated rows give repeated results; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5
#: Mean log-likelihood ratio, in nats per n-gram, from which a document is kept.
THRESHOLD = -0.2


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _hashes(words: Column) -> Column:
    """Each word is hashed once; pairs and windows are hashed from these."""
    return F.transform(words, lambda x: F.xxhash64(x))


def _pairs(h: str) -> Column:
    return F.transform(F.slice(F.col(h), F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col(h), i + 1)))


def _bucket(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[float]:
    """The log ratio of each bucket; BUCKETS numbers come to the driver, whatever the input."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().withColumn("_good", F.lit(1))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    # texts without an id have no label and would all meet in one task of the join
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), text).join(good.hint("shuffle_hash"), "_id", "left").select("_text", "_good")
    texts = named.unionByName(docs.where(F.col(id_col).isNull()).select(text, F.lit(None).cast("int").alias("_good")))
    hashed = texts.select(_hashes(_words(F.col("_text"))).alias("h"), "_good")
    grams = hashed.select("_good", F.explode(F.concat("h", _pairs("h"))).alias("g")).select("_good", _bucket(F.col("g")).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good"))
    one = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 1).alias(c)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", one("raw"), one("good"))
    # BUCKETS rows in one array, whatever the input
    whole = every.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "good"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    ratio = lambda x: F.round(F.log(x["good"] / F.col("n_good")) - F.log(x["raw"] / F.col("n_raw")), 3)
    even = F.array_repeat(F.lit(0.0), BUCKETS)
    return whole.select(F.when(F.col("n_good") == BUCKETS, even).otherwise(F.transform("t", ratio)).alias("r")).first()["r"]


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, _h, _p): the last two are hashes of words and pairs."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(f"[^{SPACES[1:-2]}]"))
    df = df.select("doc_id", _words(F.col("_text")).alias("_words"), F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), lines.alias("_lines"))
    df = df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _hashes(F.col("_words")).alias("_h"),
    )
    df = df.withColumn("_p", _pairs("_h"))
    # five words are two pairs and one word
    count = F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")
    df = df.withColumn("_w", F.transform(F.slice("_p", F.lit(1), count), lambda x, i: F.xxhash64(x, F.get(F.col("_p"), i + 2), F.get(F.col("_h"), i + 4))))
    # only texts with a repeated window are sorted: neighbours of equal hash are its places
    places = F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), places))
    place = lambda x, i: (x["h"] == F.get(F.col("_s"), i + 1)["h"]) | (x["h"] == F.get(F.col("_s"), i - 1)["h"])
    df = df.withColumn("_at", F.array_sort(F.transform(F.filter("_s", lambda x, i: F.coalesce(place(x, i), F.lit(False))), lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate("_at", start, lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(F.lit(WINDOW), p - s["last"])).alias("total")), lambda s: s["total"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_w", "_s", "_at")


def judge(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD, **columns) -> DataFrame:
    """The base metrics with score and kept."""
    table = F.split(F.lit(",".join(f"{x:g}" for x in ratio)), ",").cast("array<double>")
    df = base_metrics(docs, **columns)
    total = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.get(table, _bucket(h)))
    n = F.size("_h") + F.size("_p")
    df = df.withColumn("score", F.when(n > 0, (total("_h") + total("_p")) / n).otherwise(F.lit(0.0)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("_h", "_p")


def op2_llr_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_base_columns(spark, sf_dir: str) -> DataFrame:
    """What the base rules see of every document, without the method's score."""
    return base_metrics(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_h", "_p")
