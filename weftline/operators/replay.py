"""The newest rows, and windows of them that are played again."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: How far back the newest rows are looked for, one after another; None: all.
WINDOWS = (timedelta(days=14), timedelta(days=90), None)
#: Rows of a replay, how often its window is narrowed at most, and the slack left each time.
REPLAY_ROWS, ROUNDS, MARGIN = 500, 4, 0.8
#: Milliseconds between two rows of a replay, at least and at most.
LEAST_GAP, MOST_GAP = 40, 2500


def newest(rows: DataFrame, limit: int, now: datetime, ts: str = "ts", key: str = "id", windows: tuple = WINDOWS) -> DataFrame:
    """The newest `limit` rows, by time, then key, both descending; rows without a time are none of them.

    First only times and keys are read, in windows that widen until one holds enough rows; they give the time
    from which on whole rows are read, as a literal that reaches the scan.  So long texts are read for these rows alone
    (and others of the same last moment).
    """
    order = [F.desc(ts), F.desc(key)]
    dated = rows.where(F.col(ts).isNotNull())
    for window in windows:
        part = dated if window is None else dated.where(F.col(ts) >= F.lit(now - window).cast(dict(rows.dtypes)[ts]))
        found = part.select(ts, key).orderBy(*order).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("least")).first()
        if found.n >= limit:
            break
    if found.least is None:
        return dated.limit(0)
    return dated.where(F.col(ts) >= F.lit(found.least).cast(dict(rows.dtypes)[ts])).orderBy(*order).limit(limit)


def narrowed(rows: DataFrame, now: Column, minutes: int, limit: int = REPLAY_ROWS, rounds: int = ROUNDS, margin: float = MARGIN, ts: str = "ts") -> DataFrame:
    """One row (minutes, total, trimmed, overflow): the last minutes that hold at most `limit` rows, as far as narrowing finds them.

    A window that is too full is cut in proportion, with some slack, for at most `rounds` times; one that turns out empty is
    given up for the one before.  All windows are answered by one histogram of minutes, in one pass over the times.
    """
    age = F.greatest(F.lit(1), F.ceil((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 60_000_000)).cast("int")
    by = rows.select(age.alias("age")).where(F.col("age") <= minutes).groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    # a row for each minute at most
    whole = by.agg(F.collect_list(F.struct("age", "n")).alias("bars"))
    total = lambda m: F.aggregate(F.filter("bars", lambda x: x["age"] <= m), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    start = F.struct(F.lit(minutes).alias("next"), F.lit(0).alias("minutes"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        seen = F.struct(s["next"].alias("m"), total(s["next"]).alias("n"))
        # the fold's own values once, so that the histogram is summed once a round
        return F.element_at(F.transform(F.array(seen), lambda x: F.when(s["done"], s).when((i > 0) & (x["n"] == 0), F.struct(s["next"].alias("next"), s["minutes"].alias("minutes"), s["total"].alias("total"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.greatest(F.lit(1), F.floor(x["m"] * F.lit(limit) / F.greatest(x["n"], F.lit(1)) * F.lit(margin)).cast("int")).alias("next"), x["m"].alias("minutes"), x["n"].alias("total"), ((x["n"] <= limit) | (i >= rounds) | (x["m"] <= 1)).alias("done"))
        )), 1)

    state = F.aggregate(F.sequence(F.lit(0), F.lit(rounds)), start, step)
    return whole.select(state.alias("s")).select("s.minutes", "s.total", (F.col("s.minutes") < minutes).alias("trimmed"), (F.col("s.total") > limit).alias("overflow"))


def played(rows: DataFrame, window: DataFrame, now: Column, sessions: DataFrame, projects: DataFrame, limit: int = REPLAY_ROWS, speed: float = 10.0, ts: str = "ts", key: str = "id") -> DataFrame:
    """The rows of a narrowed window in the order of time, with their sessions' names and projects, and the wait before the next one.

    Sessions and projects that are not known leave blanks; of a window that stayed too full the newest rows are played.
    """
    inside = rows.join(F.broadcast(window.select("minutes")), F.col(ts) >= now - F.make_dt_interval(mins=F.col("minutes"))).drop("minutes")  # window: one row
    few = inside.orderBy(F.desc(ts), F.desc(key)).limit(limit)
    # at most `limit` rows from here on
    after = F.lead(ts).over(W.orderBy(ts, key))
    gap = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1000 / speed
    few = few.withColumn("wait_ms", F.when(gap.isNotNull(), F.least(F.lit(float(MOST_GAP)), F.greatest(F.lit(float(LEAST_GAP)), gap))))
    named = F.broadcast(few).join(sessions.select("session", "session_name", "project"), "session", "left")
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit(""))
    return named.join(projects.select("project", "path"), "project", "left").withColumn("project_path", path).withColumn("session_name", F.coalesce("session_name", F.col("session").cast("string"))).drop("project", "path")
