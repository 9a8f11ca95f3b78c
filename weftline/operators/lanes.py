"""Lanes of a live view: which few keys get a column of their own as activity moves on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reranked(events: DataFrame, view: str, ts: str, lane: str, named: int, span: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """(view, moment, lanes): the named lanes of each view from each rerank on that moved them.

    The busiest keys of the span get the lanes; of equally busy ones the present holders stay, then the smaller key;
    holders keep lanes that nobody claims.  Counting is a windowed aggregate; the fold over a view's reranks carries
    `named` keys, and sees of each rerank only keys that can reach a lane.
    """
    moment = F.window(ts, span, every)["end"]
    counts = events.groupBy(F.col(view), moment.alias("moment"), F.col(lane).alias("lane")).agg(F.count(F.lit(1)).alias("n"))
    # rank() keeps all that tie with the last lane, as a holder may be among them
    busy = counts.withColumn("_r", F.rank().over(W.partitionBy(view, "moment").orderBy(F.desc("n")))).where(F.col("_r") <= named)
    steps = busy.groupBy(view, "moment").agg(F.collect_list(F.struct((-F.col("n")).alias("less"), "lane")).alias("seen"))
    by_view = steps.groupBy(view).agg(F.sort_array(F.collect_list(F.struct("moment", "seen"))).alias("steps"))

    def step(state: Column, now: Column) -> Column:
        held = state["held"]
        ranked = F.array_sort(F.transform(now["seen"], lambda x: F.struct(x["less"].alias("less"), (~F.array_contains(held, x["lane"])).alias("fresh"), x["lane"].alias("lane"))))
        want = F.transform(F.slice(ranked, 1, named), lambda x: x["lane"])
        filled = F.slice(F.concat(want, F.filter(held, lambda x: ~F.array_contains(want, x))), 1, named)
        # a change of order alone moves nothing
        same = (F.size(filled) == F.size(held)) & (F.size(F.array_except(filled, held)) == 0)
        moved = F.array_append(state["moves"], F.struct(now["moment"].alias("moment"), filled.alias("lanes")))
        return F.struct(F.when(same, held).otherwise(filled).alias("held"), F.when(same, state["moves"]).otherwise(moved).alias("moves"))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("held"), F.array().cast("array<struct<moment:timestamp_ntz,lanes:array<string>>>").alias("moves"))
    return by_view.select(view, F.explode(F.aggregate("steps", start, step)["moves"]).alias("x")).select(view, F.col("x.moment").alias("moment"), F.array_join("x.lanes", ",").alias("lanes"))
