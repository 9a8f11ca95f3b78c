"""A copy of a table that follows its changes by (stamp, id).

Each pull reads what changed since a little before the cursor: the overlap catches rows that were written late, and
what is known already is absorbed.  The cursor is the greatest (stamp, id) seen and never moves back.  As in
weftline.operators.commits a pull is a numbered batch, and its cursor is written last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: How far before the cursor a pull begins.
REWIND = "2 SECONDS"


def cursor(spark: SparkSession, folder: str) -> Row | None:
    """(batch, stamp, id) of the last pull; None before the first."""
    try:
        return spark.read.parquet(f"{folder}/cursor").orderBy(F.desc("batch")).first()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def copy(spark: SparkSession, folder: str, stamp: str = "updated", key: str = "id") -> DataFrame | None:
    """The rows as last pulled: of each id the one of the latest stamp, at a tie the one pulled last."""
    at = cursor(spark, folder)
    if at is None:
        return None
    rows = spark.read.parquet(f"{folder}/rows").where(F.col("batch") <= at.batch)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(stamp, "batch")).alias("row")).select(key, "row.*")


def pull(source: DataFrame, folder: str, stamp: str = "updated", key: str = "id", rewind: str = REWIND) -> int:
    """Bring the changes of a table over; how many rows were new or newer.  Rows without a stamp or id are not followed."""
    spark = source.sparkSession
    at = cursor(spark, folder)
    rows = source.where(F.col(stamp).isNotNull() & F.col(key).isNotNull())
    number = 0
    if at is not None:
        number = at.batch + 1
        since = F.lit(at.stamp).cast(dict(source.dtypes)[stamp]) - F.expr(f"INTERVAL {rewind}")
        rows = rows.where(F.col(stamp) >= since)
        # what the overlap brings again, by id and stamp
        have = spark.read.parquet(f"{folder}/rows").where((F.col("batch") <= at.batch) & (F.col(stamp) >= since)).select(key, stamp)
        rows = rows.join(have, [key, stamp], "left_anti").select(source.columns)
    rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    found = spark.read.schema(source.schema).parquet(f"{folder}/rows/batch={number}").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col(stamp).alias("stamp"), F.col(key).alias("id"))).alias("last")).first()
    if found.n:
        last = found.last if at is None else max((at.stamp, at.id), tuple(found.last))
        spark.createDataFrame([tuple(last)], spark.createDataFrame([], source.select(F.col(stamp).alias("stamp"), F.col(key).alias("id")).schema).schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cursor/batch={number}")
    return found.n


def follow(spark: SparkSession, source: Callable[[], DataFrame], folder: str, checkpoint: str, seconds: int = 15, **options: str):
    """A stream that pulls once for each beat of a clock; `source` gives the table anew, as its files change."""
    beats = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return beats.writeStream.foreachBatch(lambda beat, number: pull(source(), folder, **options)).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint)
