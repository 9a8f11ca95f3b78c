"""Text expressions and small text helpers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_literal(text: Column, part: str) -> Column:
    """Case-insensitive substring; nothing in it is a wildcard."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def truncated(text: Column, most: int) -> Column:
    """At most so many UTF-8 bytes, cut between characters; short texts never leave the JVM's hands changed."""
    head = F.substring(text.cast("binary"), 1, most)
    # a cut character leaves one to three bytes that are not UTF-8; drop them
    tries = [F.try_validate_utf8(F.substring(text.cast("binary"), 1, most - i).cast("string")) for i in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries, head.cast("string")))


FLAT = T.StructType([T.StructField("text", T.StringType()), T.StructField("tools", T.ArrayType(T.StringType()))])


@F.pandas_udf(FLAT)
def flattened(content: pd.Series) -> pd.DataFrame:
    """Text and tool names of a raw JSON content: a string, or an array of blocks whose results may nest.

    An array that holds anything but objects is void as a whole; reading stops once 8,000 bytes of text are passed.
    """
    most = 8000

    def parts(blocks: list) -> Iterator[tuple[str, str]]:
        """(kind, value) of the blocks in order, those inside of tool results too."""
        for block in blocks:
            kind = block.get("type")
            inner = block.get("content")
            if kind == "text" and block.get("text"):
                yield "text", str(block["text"])
            elif kind == "tool_use" and block.get("name"):
                yield "tool", str(block["name"])
            elif kind == "tool_result" and isinstance(inner, str) and inner:
                yield "text", inner
            elif kind == "tool_result" and well_formed(inner):
                yield from parts(inner)

    def well_formed(value: object) -> bool:
        return isinstance(value, list) and all(isinstance(x, dict) for x in value)

    def flat(raw: str | None) -> tuple[str, list[str]]:
        try:
            value = json.loads(raw) if raw else None
        except ValueError:
            return "", []
        if isinstance(value, str):
            return value, []
        texts, tools, size = [], [], 0
        for kind, part in parts(value) if well_formed(value) else ():
            if kind == "tool":
                tools.append(part)
            else:
                texts.append(part)
                size += len(part.encode()) + (len(texts) > 1)
            if size > most:
                break
        return "\n".join(texts), tools

    return pd.DataFrame([flat(x) for x in content], columns=["text", "tools"])


# Fixed value: listings with numbers, diffs, banners, and JSON or tuples at the start of a line.
DUMP_LINE = r"^\s*(?:\d{1,5}(?::|\s{2,}|\s\d)|\d{1,5}:? {1}[A-Za-z_{\[(#/<]|[-+]{3}\s|@@ |diff --git|=====|\{\s*\"|\[\()"


def tool_output(text: Column, line: str = DUMP_LINE) -> Column:
    """Whether a text is a dump: among its first eight filled lines at least three match, or a match opens a text of several."""
    lines = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, 8)
    marks = F.transform(lines, lambda x: x.rlike(line))
    return (F.size(F.filter(marks, lambda m: m)) >= 3) | (F.coalesce(F.get(marks, F.lit(0)), F.lit(False)) & (F.size(lines) > 1))
