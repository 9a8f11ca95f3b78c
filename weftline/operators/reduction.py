"""Digests put together for one summary of a week or a topic: short bodies, quoted, as many as a budget takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.safety import fenced, one_line, safe_meta
from weftline.operators.sampling import clipped

BUDGET, BODY_CHARS, BULLETS, BULLET_CHARS = 24_000, 2_400, 3, 160
#: A quoted digest has at least its opening and closing tag.
LEAST_PIECE = len("<digest n=1 >\n\n</digest>\n")


def body(summary: Column, sections: Column) -> Column:
    """A summary line, then each section (name, bullets) with its first bullets; empty bullets don't count."""

    def listed(section: Column) -> Column:
        bullets = F.slice(F.filter(section["bullets"], lambda x: F.coalesce(x, F.lit("")) != ""), 1, BULLETS)
        shown = F.transform(bullets, lambda x: F.concat(F.lit("- "), clipped(one_line(x), BULLET_CHARS)))
        return F.when(F.size(shown) > 0, F.concat(F.array(F.concat(section["name"], F.lit(":"))), shown)).otherwise(F.array().cast("array<string>"))

    first = F.array(F.concat(F.lit("summary: "), one_line(F.coalesce(summary, F.lit("")))))
    return F.array_join(F.concat(first, F.flatten(F.transform(sections, listed))), "\n")


def within_budget(digests: DataFrame, group: str, key: str, order: list[Column], budget: int = BUDGET) -> DataFrame:
    """(group, n, key, piece) of the digests (group, key, meta array, summary, sections) of each group that fit, in order.

    The first digest that would pass the budget ends its group's list; the very first is taken whatever its size.
    Ranks are bounded by the budget before pieces are made, so a large group is pruned where it is read.
    """
    by = W.partitionBy(group).orderBy(*order)
    near = digests.withColumn("n", F.row_number().over(by)).where(F.col("n") <= max(1, budget // LEAST_PIECE))
    meta = F.array_join(F.transform("meta", lambda x: safe_meta(x)), " · ")
    pieces = near.select(group, F.col("n").cast("long").alias("n"), key, fenced(F.lit("digest"), F.col("n"), meta, body(F.col("summary"), F.col("sections")), BODY_CHARS).alias("piece"))
    spent = F.sum(F.length("piece")).over(W.partitionBy(group).orderBy("n"))
    return pieces.withColumn("_spent", spent).where((F.col("_spent") <= budget) | (F.col("n") == 1)).drop("_spent")
