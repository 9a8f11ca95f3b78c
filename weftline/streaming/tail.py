"""A streaming source that follows growing JSONL files.

The offset holds, for each file, its generation and how many of its bytes were taken.  A file that shrank starts a new
generation at its first byte; replayed lines are absorbed by uuid in the sink (weftline.operators.commits.follow).

A batch takes at most maxBytesPerTrigger bytes of at most maxFilesPerTrigger files, in turns over the files, and leaves the
rest to the next ones.  Planning looks at names and sizes only: spans of bytes are cut without regard to lines, and a
line belongs to the span that holds its line break.  The task that reads a span finds where its first line starts by
looking back, so an unfinished last line simply waits for the span that ends it.  Large spans are split over tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes and files of a batch, and bytes of a task, unless options say otherwise.
MOST_BYTES = 1 << 30
MOST_FILES = 10_000
TASK_BYTES = 64 << 20
_STEP = 1 << 16


class Span(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int):
        self.path, self.generation, self.start, self.end = path, generation, start, end


def sizes(root: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files below a folder, by name; folders named memory are left out, files that vanish too."""
    with os.scandir(root) as found:
        entries = sorted(found, key=lambda x: x.name)
    for entry in entries:
        try:
            if entry.is_dir():
                if entry.name != "memory":
                    yield from sizes(entry.path)
            elif entry.name.endswith(".jsonl"):
                yield entry.path, entry.stat().st_size
        except FileNotFoundError:
            continue


def admitted(seen: dict, listing: dict[str, int], most_bytes: int, most_files: int, turn: str) -> tuple[dict, str]:
    """({path: [generation, bytes taken]}, last file served) after one batch more; files behind `turn` come first."""
    ends, left, files, last = dict(seen), most_bytes, 0, turn
    paths = sorted(listing)
    for path in [x for x in paths if x > turn] + [x for x in paths if x <= turn]:
        generation, taken = seen.get(path, (0, 0))
        if listing[path] < taken:  # it was cut or written anew
            generation, taken = generation + 1, 0
        step = min(listing[path] - taken, left)
        if step > 0 and files < most_files:
            ends[path], last = [generation, taken + step], path
            left, files = left - step, files + 1
    return ends, last


class TailReader(DataSourceStreamReader):
    """Files under a folder that driver and executors share."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.most_bytes = int(options.get("maxbytespertrigger", MOST_BYTES))
        self.most_files = int(options.get("maxfilespertrigger", MOST_FILES))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.seen: dict | None = None

    def initialOffset(self) -> dict:
        return {"files": "{}", "turn": ""}

    def latestOffset(self) -> dict:
        at = self.seen or self.initialOffset()
        ends, turn = admitted(json.loads(at["files"]), dict(sizes(self.root)), self.most_bytes, self.most_files, at["turn"])
        self.seen = {"files": json.dumps(ends, sort_keys=True), "turn": turn}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Span]:
        # after a restart Spark asks for the batch that it left first: the next one goes on from there
        self.seen = end if self.seen is None else self.seen
        old, spans = json.loads(start["files"]), []
        for path, (generation, stop) in json.loads(end["files"]).items():
            before, begin = old.get(path, (generation, 0))
            begin = begin if before == generation else 0
            spans += [Span(path, generation, at, min(at + self.task_bytes, stop)) for at in range(begin, stop, self.task_bytes)]
        return spans or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        """Line by line, so a long span is never held whole; a file that is shorter than planned ends its task."""
        if not partition.path:
            return
        try:
            f = open(partition.path, "rb")
        except FileNotFoundError:
            return
        with f:
            at = partition.start
            while at > 0:  # the byte after the line break before the span
                begin = max(0, at - _STEP)
                f.seek(begin)
                found = f.read(at - begin).rfind(b"\n")
                at = begin if found < 0 else begin + found + 1
                if found >= 0:
                    break
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n") or at + len(line) > partition.end:
                    break
                yield partition.path, at, at + len(line), partition.generation, line.decode("utf-8", "replace").strip()
                at += len(line)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, start_offset long, end_offset long, generation long, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


def follow(spark: SparkSession, root: str, **options: object):
    """A streaming frame (path, start_offset, end_offset, generation, value, line_no) of all lines, blank ones too.

    line_no is the line's first byte, which grows with the file; the sink counts lines.  Options: maxBytesPerTrigger,
    maxFilesPerTrigger, taskBytes.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("jsonl_tail")
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(root).selectExpr("*", "start_offset as line_no")
