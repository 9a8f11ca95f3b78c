"""What becomes of sessions that are to be digested by a model: reused, given up, or to be done, and counts of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.operators.vectors import generated

#: Replies for the same events that were no JSON object, after which a session is given up.
MOST_ATTEMPTS = 3


def outcomes(rows: DataFrame, cache: DataFrame, attempts: DataFrame, keys: tuple[str, ...] = ("session", "iso_week"), most: int = MOST_ATTEMPTS) -> DataFrame:
    """rows (keys, event_count) with their outcome.

    A digest in the cache (keys, event_count) is reused if it was made of as many events; else a session that failed
    `most` times at this number of events, by attempts (keys, event_count, attempts), is given up.
    """
    known = cache.select(*keys, F.col("event_count").alias("_made_of"))
    failed = attempts.groupBy(*keys, "event_count").agg(F.max("attempts").alias("_failed"))
    joined = rows.join(known, list(keys), "left").join(failed, [*keys, "event_count"], "left")
    outcome = F.when(F.col("_made_of") == F.col("event_count"), "reused").when(F.col("_failed") >= most, "gave_up").otherwise("todo")
    return joined.select(*keys, "event_count", outcome.alias("outcome"))


def counters(found: DataFrame, *by: str) -> DataFrame:
    """How many rows of each group have which outcome."""
    return found.groupBy(*by).agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("reused", "gave_up", "todo")])


def digested(rows: DataFrame, cache: DataFrame, attempts: DataFrame, generator: Callable[[str], str], told: Observation, prompt: str = "prompt", key: str = "session") -> DataFrame:
    """The rows with the replies of a model for those to be done; `told` counts them all as the result is written.

    A reply without a JSON object is a failure: its digest is null, and its attempts are one more.
    """
    from weftline.operators.citations import first_object

    found = outcomes(rows, cache, attempts, (key,))
    replies = generated(found.where("outcome = 'todo'").join(rows.select(key, prompt), key), generator, key, prompt)
    tried = attempts.groupBy(key, "event_count").agg(F.max("attempts").alias("before"))
    out = found.join(replies.select(key, first_object("reply").alias("digest")), key, "left").join(tried, [key, "event_count"], "left")
    failed = (F.col("outcome") == "todo") & F.col("digest").isNull()
    out = out.withColumn("attempts", F.coalesce("before", F.lit(0)) + F.when(failed, 1).otherwise(0)).drop("before")
    out = out.withColumn("outcome", F.when(failed, "failed").when(F.col("outcome") == "todo", "digested").otherwise(F.col("outcome")))
    return out.observe(told, *[F.count_if(F.col("outcome") == x).alias(x) for x in ("digested", "reused", "failed", "gave_up")])
