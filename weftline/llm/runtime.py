"""Small helpers around the session: the shared checkpoint folder and partition counts."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_weftline_folder", None) or tempfile.mkdtemp(prefix="spark-")
        spark._weftline_folder = folder
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def few_of(key: Column, rows: int, total: int) -> Column:
    """Whether a row is among about `rows` of `total`, by a hash of its key; as fine as 63 bits, so it holds for any total."""
    least = min((rows << 63) // max(1, total), (1 << 63) - 1)
    return F.shiftrightunsigned(F.xxhash64(key), 1) <= F.lit(least)


def cut(make: Callable[[], DataFrame]) -> DataFrame:
    """Cut the lineage of make() by a checkpoint in the shared folder.

    The plan is made inside, so that nothing refers to it afterwards and Spark can drop its shuffle
    files; the collection only asks the driver's cleaner to look now rather than at some later time.
    """
    df = make()
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df, make
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out
