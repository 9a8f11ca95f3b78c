"""Benchmark decontamination by MinHash containment.

An item's signature is its smallest shingle hashes, as many as pigeonhole asks for: an item with n shingles
of which at least 80 % are in a document shares with it one of any (n - ceil(0.8 n) + 1) of them.  Items are
partitioned by size (powers of four).  In each partition the largest signature value is the highest hash a
document's shingle can have to matter there, so long documents are probed with their small hashes only, and
documents too short to hold 80 % of its smallest item are not probed at all; a tiny item with a high hash opens
only its own partition.  Candidates lose nothing against the exact rule and are verified by exact shingle containment.  Built-in SQL
functions only.

A document is contaminated if at least 80 % of the distinct 5-word shingles (lower case) of an item are
among its own.

Defined results: null and empty texts are clean, items without words match nothing; an item of one to four
words is one shingle, its whole text, and matches documents of just these words; repeated documents are
each judged, rows that share a doc_id share the union of their items; items that share an item_id
are one item for each text; a document with a null id is never flagged and stays; empty tables give no
contamination; further columns are ignored or, in without_leaks(), kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5
#: At least PART of WHOLE shingles of an item.
PART, WHOLE = 4, 5
#: Signature rows up to which they are broadcast; beyond, the join is a shuffle.
MOST_BROADCAST = 500_000
PROBES = "array<struct<size_class:int,hash:bigint>>"


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles, repeats included."""
    return _shingles(F.array_remove(F.split(F.lower(text), SPACES), ""))


def _shingles(words: Column) -> Column:
    n = F.size(words)
    long = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(n >= SHINGLE, long).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))


def _hashed(table: DataFrame, key: str, text_col: str, name: str) -> DataFrame:
    words = table.select(F.col(key).cast("long").alias(name), F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), SPACES), "").alias("_w"))
    return words.select(name, _shingles(F.col("_w")).alias("h"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of each verified pair."""
    items = _hashed(benchmark, item_col, item_text, "item_id").select("item_id", F.sort_array(F.array_distinct("h")).alias("h")).where(F.size("h") > 0)
    items = items.withColumn("n", F.size("h").cast("long")).withColumn("item_key", F.xxhash64("item_id", "h"))
    size_class = F.floor(F.log2("n") / 2).cast("int")
    signature = items.select("item_id", "item_key", "n", size_class.alias("size_class"), F.explode(F.slice("h", F.lit(1), (F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1).cast("int"))).alias("hash"))
    # one row for each power of four
    bounds = signature.groupBy("size_class").agg(F.max("hash").alias("top"), F.min("n").alias("least"), F.count(F.lit(1)).alias("rows")).orderBy("size_class").collect()
    small = sum(r.rows for r in bounds) <= MOST_BROADCAST
    hint = F.broadcast if small else (lambda x: x)
    hashed = _hashed(docs, id_col, text_col, "doc_id")

    def probe(size_class: int, least: int, top: int) -> Column:
        """The hashes that matter in one partition, of documents long enough for it."""
        low = F.transform(F.filter("h", lambda x: x <= F.lit(top)), lambda x: F.struct(F.lit(size_class).alias("size_class"), x.alias("hash")))
        return F.when(F.size("h") * WHOLE >= least * PART, low).otherwise(F.array().cast(PROBES))

    by_class = [probe(r.size_class, r.least, r.top) for r in bounds]
    probes = hashed.select("doc_id", F.explode(F.concat(*by_class) if by_class else F.array().cast(PROBES)).alias("p")).select("doc_id", "p.*")
    candidates = probes.join(hint(signature.select("size_class", "hash", "item_key").distinct()), ["size_class", "hash"]).groupBy("doc_id").agg(F.collect_set("item_key").alias("keys"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    chosen = texts.join(candidates, "doc_id").select("doc_id", "keys", F.array_remove(F.split(F.lower(F.coalesce(F.col("_text").cast("string"), F.lit(""))), SPACES), "").alias("_w"))
    pairs = chosen.select("doc_id", F.array_distinct(_shingles(F.col("_w"))).alias("own"), "keys").select("doc_id", "own", F.explode("keys").alias("item_key"))
    wanted = items.select("item_key", "item_id", "h", "n").dropDuplicates(["item_key"])
    found = pairs.join(hint(wanted), "item_key").select("doc_id", "item_id", F.size(F.array_intersect("own", "h")).cast("long").alias("n_shared"), F.col("n").alias("n_item"))
    return found.where(WHOLE * F.col("n_shared") >= PART * F.col("n_item")).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def flagged(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """(doc_id, n_items, items, contaminated) of every document."""
    ids = docs.select(F.col(columns.get("id_col", "doc_id")).cast("long").alias("doc_id"))
    by = leaks(docs, benchmark, **columns).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return ids.join(by, "doc_id", "left").select("doc_id", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.col("items").isNotNull().alias("contaminated"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].cast("long") == bad["_bad"], "left_anti")


def op5_benchmark_containment(spark, sf_dir: str) -> DataFrame:
    return flagged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['short:' || array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['short:' || array_to_string(w, ' ')] ELSE [] END) AS g FROM iw),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
hit AS (SELECT doc_id, item_id, count(*) AS k FROM s JOIN i USING (g) GROUP BY 1, 2),
bad AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items FROM hit JOIN n USING (item_id) WHERE 5 * k >= 4 * n GROUP BY 1)
SELECT doc_id, coalesce(len(items), 0)::BIGINT AS n_items, coalesce(items, []::BIGINT[]) AS items, items IS NOT NULL AS contaminated FROM documents LEFT JOIN bad USING (doc_id)"""
