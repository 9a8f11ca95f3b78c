"""A store of committed batches: events are appended, of other tables only the rows of touched keys are written.

    folder/<table>/batch=<number>   what a batch added or replaced
    folder/commits/batch=<number>   written last; a batch without it has not happened

The state of a table is the last committed row of each key.  A batch that failed half way is written over by its replay,
one that is committed is left alone, so the effect is exactly once.  There is one writer: the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import ingest


def committed(spark: SparkSession, folder: str) -> int:
    """The number of the last committed batch, -1 before the first."""
    try:
        last = spark.read.parquet(f"{folder}/commits").agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        last = None
    return -1 if last is None else int(last)


def state(spark: SparkSession, folder: str, table: str, upto: int) -> DataFrame:
    """A table as it was after a batch."""
    rows = spark.read.parquet(f"{folder}/{table}").where(F.col("batch") <= upto)
    keys = ingest.KEYS[table]
    if table == "events" or not keys:
        return rows.drop("batch")
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    # a hash aggregate with map-side combine: the last version of each key
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select(*keys, "row.*")


def snapshot(spark: SparkSession, folder: str, upto: int | None = None) -> dict[str, DataFrame] | None:
    """The tables after a committed batch, the last one if none is named; None before the first."""
    last = committed(spark, folder)
    upto = last if upto is None else min(upto, last)
    return None if upto < 0 else {t: state(spark, folder, t, upto) for t in ingest.KEYS}


def commit(batch: DataFrame, folder: str, number: int) -> tuple[DataFrame, DataFrame] | None:
    """Write what a batch adds, then its commit; its (report, inserted rows), read from what was written."""
    spark = batch.sparkSession
    last = committed(spark, folder)

    def write(table: str, rows: DataFrame) -> DataFrame:
        at = f"{folder}/{table}/batch={number}"
        rows.write.mode("overwrite").parquet(at)
        return spark.read.schema(rows.schema).parquet(at)

    if number > last:
        stored = snapshot(spark, folder, last)
        claimed = ingest.claims(batch, stored["sessions"] if stored else None).persist()
        rows = ingest.taken(batch, claimed)
        fresh = ingest.new_events(rows.where(ingest.usable(rows)), stored["events"] if stored else None)
        # the inserted rows are computed once: all that follows reads them from here
        inserted = write("events", fresh)
        out = ingest.settle(claimed, inserted, stored, F.current_timestamp().cast("timestamp_ntz"))
        for table in (*ingest.KEYS, "report"):
            if table != "events":
                write(table, out[table])
        claimed.unpersist()
        spark.range(1).coalesce(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{folder}/commits/batch={number}")
    return tuple(spark.read.parquet(f"{folder}/{t}/batch={number}") for t in ("report", "events"))


def follow(events: DataFrame, folder: str, checkpoint: str, published: Callable[[DataFrame, int], None] | None = None, live: Callable[[DataFrame, int], None] | None = None):
    """A stream writer that commits each micro-batch.

    There is no watermark: an event of any age goes to the week it belongs to.  After the commit `published` gets the
    batch's report and `live` the rows of ingest.live_rows(), so whoever hears of rows can read them; a batch replayed after
    its commit is told again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        report, inserted = commit(batch, folder, number)
        batch.unpersist()
        if published:
            published(report, number)
        if live:
            now = snapshot(spark, folder, number)
            live(ingest.live_rows(inserted, now["sessions"], now["projects"]), number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
