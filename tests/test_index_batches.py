"""What a written index holds, and what is shuffled to write it."""

import re

from pyspark.sql import functions as F

from weftline.operators import ranking


def test_words_are_counted_in_their_row(spark):
    rows = [(1, "b a b é b a"), (2, ""), (3, None), (4, "..."), (5, "x"), (6, "x " * 500 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", F.explode(ranking.counted(ranking.tokens(F.col("text")))).alias("x")).select("doc_id", "x.*")
    want = ranking.postings(docs).select("doc_id", "term", "tf")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 6


def test_index_agrees_with_a_search_without_one(spark, tmp_path):
    texts = ["the cat", "the the dog", None, "", "dog dog cat", "a the", "the cat"]
    # ids that come twice with the same and with other lengths, and rows without an id
    docs = spark.createDataFrame([(i, t) for i, t in zip([1, 2, 3, 4, 1, 5, 1], texts, strict=True)] + [(None, "cat"), (None, "cat"), (None, "dog dog")], "doc_id long, text string")
    ranking.write_index(docs, f"{tmp_path}/i")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    for terms in (["cat"], ["the", "dog"], ["nothing"]):
        assert key(ranking.search_index(spark, f"{tmp_path}/i", terms)) == key(ranking.bm25(docs, terms))
    more = spark.createDataFrame([(2, "cat cat"), (7, "dog")], "doc_id long, text string")
    ranking.fold_new(more, f"{tmp_path}/i")
    ranking.fold_new(more, f"{tmp_path}/i")
    assert key(ranking.search_index(spark, f"{tmp_path}/i", ["cat", "dog"])) == key(ranking.bm25(docs.union(more.where("doc_id = 7")), ["cat", "dog"]))
    assert spark.read.parquet(f"{tmp_path}/i/statistics").count() == 2


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    docs, plans = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string").withColumn("other", F.lit("x")), []
    writer = type(docs.write)
    save = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **b: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), save(self, path, *a, **b))[1])
    ranking.write_index(docs, f"{tmp_path}/i")
    plan = next(p for path, p in plans if "/postings/" in path)
    assert len(re.findall(r"Exchange", plan)) == 1 and "REBALANCE" in plan
    ranking.fold_new(docs.withColumn("doc_id", F.col("doc_id") + 25), f"{tmp_path}/i")
    postings = spark.read.parquet(f"{tmp_path}/i/postings")
    assert postings.where("batch = 1").select("doc_id").distinct().count() == 25
