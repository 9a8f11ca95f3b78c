"""Stratified sampling moves at most `most` rows of a group from each task."""

from pyspark.sql import functions as F

from weftline.operators import sampling


def test_groups_are_pruned_before_they_move(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("g"))
    got = sampling.stratify(df, "g", [F.desc("id")], "id", 10)
    # one for the first items alone, and one for the items that can be taken
    assert got._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2
    groups = {}
    for i in reversed(range(1000)):
        groups.setdefault("hot" if i < 900 else f"g{i % 3}", []).append(i)
    want = [(p + 1, rows[p]) for p in range(10) for rows in groups.values() if p < len(rows)]
    assert [(r.pick, r.id) for r in got.collect()] == want[:10]
