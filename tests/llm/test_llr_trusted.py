"""The trusted side counts every good document, whatever their number."""

import collections
import math

from pyspark.sql import functions as F

from weftline.llm import llr_quality


def test_all_good_documents_count(spark):
    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 50, F.lit(" v"), F.col("id") % 7).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "w1 v1"), (None, None), (3, "w3 v3")], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6 == 0, 0).otherwise(1).alias("quality"))
    labels = labels.unionByName(spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int"))
    hashed = docs.select("text").distinct().select("text", llr_quality._hashes(llr_quality._words(F.coalesce("text", F.lit("")))).alias("h"))
    buckets = {r.text: [x % llr_quality.BUCKETS for x in r.g] for r in hashed.select("text", F.concat("h", llr_quality._pairs("h")).alias("g")).collect()}
    raw, good = collections.Counter(), collections.Counter()
    for i, text in [*((i, f"w{i % 50} v{i % 7}") for i in range(n)), (None, "w1 v1"), (None, None), (3, "w3 v3")]:
        raw.update(buckets[text])
        if i is not None and i % 6:
            good.update(buckets[text])
    size = llr_quality.BUCKETS
    n_raw, n_good = sum(raw.values()) + size, sum(good.values()) + size
    got = llr_quality.ratios(docs, labels)
    assert len(got) == size
    assert all(abs(x - (math.log((good[b] + 1) / n_good) - math.log((raw[b] + 1) / n_raw))) < 0.00051 for b, x in enumerate(got))
