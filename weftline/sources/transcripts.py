"""JSONL transcripts: file listing, lines, and lines as typed events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftline.functions.text import flattened, truncated
from weftline.functions.times import DEFAULT_ZONE, iso_week

TEXT_BYTES = 8000
_MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("model", T.StringType()), T.StructField("content", T.StringType())])
LINE = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("uuid", "parentUuid", "type", "timestamp", "sessionId", "cwd", "gitBranch", "summary", "content")]
    + [T.StructField("isSidechain", T.BooleanType()), T.StructField("message", _MESSAGE)]
)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, file_size, block, value) with their number and the bytes up to their end within their block of the file."""
    path, block, nth, end = None, None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        paths, blocks = batch.column(0), batch.column(2).to_numpy()
        size = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        new = np.ones(n, dtype=bool)
        new[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)
        new[0] = (paths[0].as_py(), int(blocks[0])) != (path, block)
        bytes_up_to, at = np.cumsum(size), np.arange(n)
        first = np.maximum.accumulate(np.where(new, at, -1))
        carried = first < 0  # the block of the batch before goes on
        ends = bytes_up_to - np.where(carried, -end, (bytes_up_to - size)[np.maximum(first, 0)])
        numbers = at - np.where(carried, -1 - nth, first - 1)
        path, block, nth, end = paths[n - 1].as_py(), int(blocks[n - 1]), int(numbers[-1]), int(ends[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers), pa.array(ends)], names=["path", "file_size", "block", "value", "nth", "end"])


def lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, start_offset, end_offset, file_size, value) of all *.jsonl files below root, folders named memory left out.

    Files are read as lines in blocks, so none has to fit a task.  Lines are placed by two levels of sums: within their
    block as it is read, and of whole blocks (a row for each) before it; the lines themselves are never moved or sorted.
    A line that would end beyond its file has no line break yet and is held back.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(root)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), "value").where(~F.col("path").contains("/memory/"))
    placed = raw.mapInArrow(_placed, "path string, file_size long, block long, value string, nth long, end long")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = placed.groupBy("path", "block").agg(F.max("nth").alias("n"), F.max("end").alias("size"))
    blocks = blocks.select("path", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "size")])
    numbered = placed.join(blocks, ["path", "block"]).withColumn("end_offset", F.col("size_before") + F.col("end")).where("end_offset <= file_size and trim(value) <> ''")
    return numbered.select("path", (F.col("n_before") + F.col("nth")).alias("line_no"), (F.col("end_offset") - F.octet_length("value") - 1).alias("start_offset"), "end_offset", "file_size", "value")


def unread(raw: DataFrame, state: DataFrame) -> DataFrame:
    """The lines (as lines() gives them) that are new by a tail state (path, byte_offset, generation), as a claim that apply() takes.

    A file that is shorter than what was read of it begins a new generation at its first line.
    """
    have = state.select("path", F.col("byte_offset").alias("_read"), F.col("generation").alias("_generation"))
    joined = raw.join(have, "path", "left")
    anew = F.col("file_size") < F.col("_read")
    generation = F.coalesce(F.col("_generation"), F.lit(0)).cast("long") + F.when(anew, 1).otherwise(0)
    fresh = F.col("_read").isNull() | anew | (F.col("start_offset") >= F.col("_read"))
    return joined.withColumn("generation", generation).where(fresh).drop("_read", "_generation")


def records(raw: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Every raw line (path, line_no, value, ...) with its fields; a line that is no event has an empty uuid or no time.

    Columns of raw that place a line (start_offset, end_offset, generation) are kept.
    """
    trimmed = F.trim("value")
    line = F.when(trimmed.startswith("{"), F.from_json(trimmed, LINE, {"mode": "PERMISSIVE"}))
    df = raw.withColumn("j", line)
    ts = F.try_to_timestamp(F.col("j.timestamp"))
    df = df.withColumn("ts", F.date_trunc("millisecond", ts).cast("timestamp_ntz"))
    message = flattened(as_json("j.message.content"))
    df = df.withColumn("m", message).withColumn("c", flattened(as_json("j.content")))
    filled = F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in ("m.text", "j.summary", "c.text")], F.lit(""))
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    return df.select(
        "path",
        text("j.uuid").alias("uuid"),
        text("j.parentUuid").alias("parent_uuid"),
        session_id(F.col("path")).alias("session"),
        "ts",
        iso_week(F.col("ts"), zone).alias("iso_week"),
        text("j.type").alias("type"),
        text("j.message.role").alias("role"),
        text("j.message.model").alias("model"),
        truncated(filled, TEXT_BYTES).alias("text"),
        F.coalesce(F.to_json("m.tools"), F.lit("[]")).alias("tools"),
        text("j.cwd").alias("cwd"),
        text("j.gitBranch").alias("git_branch"),
        F.coalesce("j.isSidechain", F.lit(False)).alias("sidechain"),
        "line_no",
        F.octet_length(trimmed).cast("long").alias("raw_bytes"),
        *[c for c in ("start_offset", "end_offset", "generation") if c in raw.columns],
    )


def events(raw: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Typed events of raw lines (path, line_no, value[, ...]); lines without uuid or a valid time are left out."""
    return records(raw.where(F.trim("value").startswith("{")), zone).where((F.col("uuid") != "") & F.col("ts").isNotNull())


def as_json(name: str) -> Column:
    """A field read as string: JSON arrays and objects as they are, anything else quoted."""
    value = F.col(name)
    quoted = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(value.startswith("[") | value.startswith("{"), value).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def session_id(path: Column) -> Column:
    """The file's stem if it looks like an id (32 characters, four dashes), else stem@folder."""
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    dashes = F.length(stem) - F.length(F.replace(stem, F.lit("-"), F.lit("")))
    return F.when((F.length(stem) >= 32) & (dashes >= 4), stem).otherwise(F.concat_ws("@", stem, folder))


def origin(path: Column, root: str, home: str = "/.claude/projects") -> Column:
    """(project, encoded_dir, tier) of a transcript by where it lies below a root.

    The first folder is the project's directory with slashes written as dashes; deeper files are of subagents.  A root that does
    not end with `home` is a backup.
    """
    base = root.rstrip("/")
    inside = F.split(F.substring(path, len(base) + 2, 100_000), "/")
    encoded = F.get(inside, F.lit(0))
    decoded = F.when(encoded.startswith("-"), F.translate(encoded, "-", "/")).otherwise(encoded)
    if "/uploads/" in base:
        tier = F.lit("import")
    elif not base.endswith(home):
        tier = F.lit("backup")
    else:
        tier = F.when(F.size(inside) > 2, "subagent").otherwise("projects")
    return F.struct(decoded.alias("project"), encoded.alias("encoded_dir"), tier.alias("tier"))


def report(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """(path, lines, events, skipped): what became of the lines of each file."""
    kept = parsed.groupBy("path").agg(F.count(F.lit(1)).alias("events"))
    by = raw.groupBy("path").agg(F.count(F.lit(1)).alias("lines")).join(kept, "path", "left").withColumn("events", F.coalesce("events", F.lit(0)).cast("long"))
    return by.withColumn("skipped", F.col("lines") - F.col("events"))


def unchanged(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, length) that were read to their end and have not changed since."""
    return files.join(state.select("path", F.col("byte_offset").alias("_read")), "path").where(F.col("length") == F.col("_read")).drop("_read")


def batches(raw: DataFrame, parsed: DataFrame, most: int = 500) -> DataFrame:
    """(path, batch, events, lines, start_offset, next_offset): the steps in which a file's new events are handed over.

    raw: (path, line_no, end_offset) of all lines; parsed: those of lines that are events.  A batch holds up to `most`
    events and ends with the line of its last one, the last batch with the file's last line, so what was taken stays
    taken if a later batch fails.  A file without events is one empty batch that moves its offset on.
    """
    at = F.row_number().over(W.partitionBy("path").orderBy("line_no")) - 1
    filled = parsed.select("path", "line_no", "end_offset", F.floor(at / most).alias("batch"))
    filled = filled.groupBy("path", "batch").agg(F.count(F.lit(1)).alias("events"), F.max("line_no").alias("line"), F.max("end_offset").alias("end"))
    whole = raw.groupBy("path").agg(F.max("line_no").alias("_line"), F.max("end_offset").alias("_end"))
    steps = whole.join(filled, "path", "left").withColumn("batch", F.coalesce("batch", F.lit(0)).cast("long"))
    by = W.partitionBy("path").orderBy("batch")
    last = F.lead("batch").over(by).isNull()
    steps = steps.withColumn("line", F.when(last, F.col("_line")).otherwise(F.col("line"))).withColumn("next_offset", F.when(last, F.col("_end")).otherwise(F.col("end")))
    lines = F.col("line") - F.coalesce(F.lag("line").over(by), F.lit(0))
    start = F.coalesce(F.lag("next_offset").over(by), F.lit(0))
    return steps.select("path", "batch", F.coalesce("events", F.lit(0)).cast("long").alias("events"), lines.cast("long").alias("lines"), start.cast("long").alias("start_offset"), F.col("next_offset").cast("long").alias("next_offset"))
