"""Deterministic stratified sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def stratify(df: DataFrame, group: str, order: list[Column], key: str, most: int) -> DataFrame:
    """Round-robin over groups: the k-th item of each group before any (k+1)-th; groups in order of their best item."""
    ranked = df.withColumn("pick", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    # an item's pick is at most its place, and right after row_number() Spark prunes groups before they move
    ranked = ranked.where(F.col("pick") <= most).withColumn("pick", F.col("pick").cast("long"))
    heads = ranked.where("pick = 1").withColumn("group_rank", F.row_number().over(W.orderBy(*order, group)).cast("long")).select(group, "group_rank")
    return ranked.join(F.broadcast(heads), group).orderBy("pick", "group_rank", key).limit(most)


def is_mark(at: Column, n: Column, wanted: Column) -> Column:
    """Whether place `at` of n is one of `wanted` places at even distances, first and last included; a single one is the middle."""
    place = lambda i: F.bround(i * (n - 1) / F.greatest(wanted - 1, F.lit(1)), 0)
    # the only i whose place can be `at` is the nearest one, or a neighbour where distances round
    near = F.floor(at * (wanted - 1) / F.greatest(n - 1, F.lit(1)))
    hit = F.exists(F.sequence(F.lit(-1), F.lit(2)), lambda d: (near + d >= 0) & (near + d < wanted) & (place(near + d) == at))
    return F.when(n <= wanted, True).when(wanted <= 0, False).when(wanted == 1, at == F.floor(n / 2)).otherwise(hit)


def evenly_spaced(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows of each group at even distances; all rows of smaller groups."""
    w = W.partitionBy(group)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(is_mark(F.col("_i"), F.col("_n"), F.lit(n))).drop("_i", "_n")


def horizon(ts: Column, now: Column) -> Column:
    """short, month, quarter or archive by age in days (7, 30, 90); undated is archive."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    day = 86400
    return F.when(ts.isNull(), "archive").when(age <= 7 * day, "short").when(age <= 30 * day, "month").when(age <= 90 * day, "quarter").otherwise("archive")


def topic_material(hits: DataFrame, horizon_col: str, group: str, score: str, key: str, k: int) -> DataFrame:
    """At most k / 4 hits of each horizon, round-robin over its groups, groups in order of their best hit; a share that is not used goes to no other horizon."""
    share = max(1, k // 4)
    queues = W.partitionBy(horizon_col, group)
    ranked = hits.withColumn("pick", F.row_number().over(queues.orderBy(F.desc(score), key)).cast("long")).where(F.col("pick") <= share)
    ranked = ranked.withColumn("_best", F.max(score).over(queues))
    place = F.row_number().over(W.partitionBy(horizon_col).orderBy("pick", F.desc("_best"), group)).cast("long")
    return ranked.withColumn("place", place).where(F.col("place") <= share).drop("_best")


def clipped(text: Column, most: int) -> Column:
    """At most so many characters, an ellipsis marking the cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 2)), F.lit(" …")))


def fitting(sizes: Column, budget: Column) -> Column:
    """(left, taken) of a fold over an ordered array of (size, ...): an item is taken if it fits in what is left, else skipped."""
    start = F.struct(budget.cast("long").alias("left"), F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = x["size"] <= s["left"]
        return F.struct(
            F.when(fits, s["left"] - x["size"]).otherwise(s["left"]).cast("long").alias("left"),
            (s["at"] + 1).cast("long").alias("at"),
            F.when(fits, F.array_append(s["taken"], s["at"])).otherwise(s["taken"]).alias("taken"),
        )

    return F.aggregate(sizes, start, step)


def within_budget(turns: DataFrame, group: str, order: list[str], role: str, text: str, budget: int = 6000, most: int = 700) -> DataFrame:
    """The turns of each group that a reader with a character budget sees: (group, order, role, text).

    Every turn is clipped and costs its length and one.  User turns come first, thinned evenly where all together
    are over the budget; what is left goes to assistant turns at even distances.  A turn that does not fit is
    skipped, later ones may fit.  Thinning is a rank against the group's totals, so what is folded is bounded by
    the budget; only sizes and keys are folded, texts are joined back.
    """
    said = turns.select(group, *order, F.col(role).alias("_role"), clipped(F.trim(F.coalesce(F.col(text), F.lit(""))), most).alias("_text"))
    sizes = said.where("_role in ('user', 'assistant')").select(group, *order, "_role", (F.length("_text") + 1).alias("size"))
    w = W.partitionBy(group, "_role")
    ranked = sizes.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_sum", F.sum("size").over(w))

    def folded(rows: DataFrame, wanted: Column, left: Column) -> DataFrame:
        thin = rows.where(is_mark(F.col("_i"), F.col("_n"), wanted))
        listed = thin.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_i", "size", *order))).alias("_list"), F.first(left).alias("_left"))
        return listed.select(group, "_list", fitting(F.col("_list"), F.col("_left")).alias("_fold"))

    mean = F.col("_sum") / F.col("_n")
    asked = F.when(F.col("_sum") <= budget, F.col("_n")).otherwise(F.greatest(F.lit(1), F.floor(budget / mean)))
    users = folded(ranked.where("_role = 'user'"), asked, F.lit(budget))
    rest = ranked.where("_role = 'assistant'").join(users.select(group, F.col("_fold.left").alias("_rest")), group, "left").withColumn("_rest", F.coalesce("_rest", F.lit(budget))).where("_rest > 0")
    answers = folded(rest, F.least(F.col("_n"), F.floor(F.col("_rest") / mean)), F.col("_rest"))
    taken = users.unionByName(answers).select(group, F.explode(F.transform("_fold.taken", lambda i: F.get(F.col("_list"), i.cast("int")))).alias("_x"))
    chosen = taken.select(group, *[F.col(f"_x.{c}").alias(c) for c in order])
    return said.join(chosen, [group, *order], "left_semi").select(group, *order, F.col("_role").alias(role), F.col("_text").alias(text))
