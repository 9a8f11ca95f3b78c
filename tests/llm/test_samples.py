"""Samples of labelled rows of any number, and a fit that is judged on rows it has not seen."""

from pyspark.sql import functions as F

from weftline.llm import fm_quality, toxicity
from weftline.llm.runtime import few_of

DATA = "/root/testdata/sf0.1"


def test_shares_of_very_many_rows(spark):
    rows = spark.range(2_000_000)
    few = rows.where(few_of(F.col("id"), 20_000, 2_000_000)).count()
    assert 18_500 < few < 21_500
    # 10 ** 10 labels: 1,000 of a thousandth of them
    assert 20 < spark.range(50_000_000).where(few_of(F.col("id"), 10_000, 10**10)).count() < 90
    assert rows.where(few_of(F.col("id"), 5, 3)).count() == 2_000_000 and rows.where(few_of(F.col("id"), 0, 10)).count() <= 1


def test_fits_with_a_count_of_ten_billion(spark, monkeypatch):
    """The count is stubbed: the few rows that the share leaves are learnt from, none is no error."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    monkeypatch.setattr(type(labels), "count", lambda self: 10**10)
    assert len(fm_quality.score(docs, fm_quality.fit(docs, labels)).collect()) == 200
    assert len(toxicity.score(docs, toxicity.fit(docs, labels)).collect()) == 200
    monkeypatch.undo()
    assert labels.count() < 10**6


def test_toxicity_on_rows_that_were_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod("doc_id", F.lit(3)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    found = toxicity.score(docs, model).where(held).join(labels, "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r.toxic, r.rejected): r["count"] for r in found}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.9
    assert n.get((0, True), 0) / (n[0, False] + n.get((0, True), 0)) < 0.01
