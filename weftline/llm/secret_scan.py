"""Secrets in texts and in what the texts encode: a worklist of layers, unwrapped until nothing is left to unwrap.

A layer is a text with, for each of its characters, the range of the original text that it comes from.  The
document is the first layer.  Each layer is scanned by the fixed patterns, and gives new layers:

- its URL and Unicode escapes (%41, \\u0041, \\u{41}, \\x41, &#65;) decoded in place, all others kept;
- each base64 word (also URL-safe, and wrapped over lines), if its bytes are text or a compressed stream;
- each compressed stream (gzip, zlib, bzip2, xz, zstd) that its characters spell out.

Layers that have been seen at the same place are not done again, so streams that unpack to themselves end.  A span found
in a layer is reported as the range of the original characters that it was made of.

Work is bounded by fuel: the layers of a document may have FUEL + FUEL_SHARE * its own characters in all.  Layers
beyond that (bombs of compression or nesting) are not opened and counted in `unopened`, so nothing is left out silently.
Each task works on its own rows: nothing is shuffled or kept.

Defined results: a null or empty text has no span; repeated rows give repeated results; an empty table gives an
empty result; rows without an id keep none; further columns are ignored, whatever their names; texts of any length
are scanned whole.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, their patterns, and the least characters of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = (6, 20, 24)

#: Characters of all layers of a document: so many, and so many for each of its own.
FUEL = 1 << 24
FUEL_SHARE = 8
#: The least characters of a base64 word.
LEAST_WORD = 16

# a hexadecimal or access match takes its whole run of characters, so the least length can stand in the pattern
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(f"{ACCESS[:-1]}{{{LEAST[1] - 4},}}")
_HEX = re.compile(f"{HEX[:-1]}{{{LEAST[2]},}}")
_ESCAPE = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)"
    r"|\\u(?P<high>[dD][89abAB][0-9A-Fa-f]{2})\\u(?P<low>[dD][c-fC-F][0-9A-Fa-f]{2})"
    r"|\\(?:u(?P<u>[0-9A-Fa-f]{4})|u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|U(?P<wide>[0-9A-Fa-f]{8})|x(?P<x>[0-9A-Fa-f]{2}))"
    r"|&#(?:(?P<decimal>[0-9]{1,7})|[xX](?P<entity>[0-9A-Fa-f]{1,6}));"
)
_LINE = rf"[A-Za-z0-9+/_-]{{{LEAST_WORD},}}"
_WORD = re.compile(rf"{_LINE}(?:\r?\n{_LINE})*(?:\r?\n[A-Za-z0-9+/_-]{{1,{LEAST_WORD - 1}}}(?![A-Za-z0-9+/_-]))?={{0,2}}")
_PART = re.compile(rf"[A-Za-z0-9+]{{{LEAST_WORD},}}={{0,2}}")
#: How compressed streams begin.
_STREAMS = {b"\x1f\x8b\x08": "zlib", b"x\x01": "zlib", b"x\x5e": "zlib", b"x\x9c": "zlib", b"x\xda": "zlib", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
_STREAM = re.compile("|".join(re.escape(x.decode("latin-1")) for x in _STREAMS))
#: What a text needs for any layer or span, as Arrow's patterns: assign, access, hex, escapes, words, streams.
_NEEDS = [
    "(?i)password|passwd|secret|token|api_?key",
    "AKIA[A-Z0-9]{16}",
    "[0-9a-f]{24}",
    r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]",
    f"[A-Za-z0-9+/_-]{{{LEAST_WORD}}}",
    "\x1f\u008b\x08|x\x01|x\\^|x\u009c|xÚ|BZh|ý7zXZ|\\(µ/ý",
]


def matches(text: str, kinds: tuple[bool, ...] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, without overlaps within a kind, the too short ones dropped."""
    found = []
    if kinds[0]:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST[0]]
    if kinds[1]:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if kinds[2]:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _character(m: re.Match) -> str | None:
    """What an escape other than a URL's stands for; None if it is no character."""
    if m["high"]:
        return chr(0x10000 + (int(m["high"], 16) - 0xD800 << 10) + int(m["low"], 16) - 0xDC00)
    digits = m["u"] or m["braced"] or m["wide"] or m["x"] or m["entity"]
    code = int(digits, 16) if digits else int(m["decimal"])
    return chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else None


def unescaped(text: str, lo, hi) -> tuple[str, array, array] | None:
    """The layer with URL and Unicode escapes decoded; None if there are none."""
    out, new_lo, new_hi, at = [], array("q"), array("q"), 0

    def put(chars: str, start: int, end: int) -> None:
        nonlocal at
        if at < start:
            out.append(text[at:start])
            new_lo.extend(lo[at:start])
            new_hi.extend(hi[at:start])
        out.append(chars)
        new_lo.extend([lo[start]] * len(chars))
        new_hi.extend([hi[end - 1]] * len(chars))
        at = end

    for m in _ESCAPE.finditer(text):
        if m["url"] is None:
            if (char := _character(m)) is not None:
                put(char, m.start(), m.end())
            continue
        raw = bytes.fromhex(m["url"].replace("%", ""))
        try:
            chars, widths = (s := raw.decode()), [len(c.encode()) for c in s]
        except UnicodeDecodeError:
            chars, widths = raw.decode("latin-1"), [1] * len(raw)
        start = m.start()
        for char, width in zip(chars, widths, strict=True):
            put(char, start, start + 3 * width)
            start += 3 * width
    if not out:
        return None
    out.append(text[at:])
    new_lo.extend(lo[at:])
    new_hi.extend(hi[at:])
    return "".join(out), new_lo, new_hi


def inflated(raw: bytes, most: int) -> bytes | None:
    """The contents of a compressed stream, at most `most` + 1 bytes, whole or as far as it goes; None if it is none."""
    kind = next((v for k, v in _STREAMS.items() if raw.startswith(k)), None)
    try:
        if kind == "zlib":
            return zlib.decompressobj(47).decompress(raw, most + 1) or None
        if kind == "bz2":
            return bz2.BZ2Decompressor().decompress(raw, most + 1) or None
        if kind == "xz":
            return lzma.LZMADecompressor().decompress(raw, most + 1) or None
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().stream_reader(raw).read(most + 1) or None
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    except Exception as e:  # zstandard's own error class is known only where it is installed
        if type(e).__name__ != "ZstdError":
            raise
    return None


def readable(raw: bytes) -> str | None:
    """The bytes as text, in UTF-8 or UTF-16; None if they are none."""
    wide = len(raw) > 3 and len(raw) % 2 == 0 and raw.count(0) * 3 > len(raw)
    try:
        text = raw.decode("utf-16-le" if wide and not raw[1] else "utf-16-be" if wide else "utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\t\n\r\f\v" for c in text) else None


def _base64(word: str) -> bytes | None:
    """The bytes of a base64 word."""
    word = word.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    if len(word) % 4 == 1:
        return None
    return binascii.a2b_base64(word + "=" * (-len(word) % 4))


class Worklist:
    """The layers of one document that are still to be scanned."""

    def __init__(self, text: str):
        self.found: set[tuple[int, int, int]] = set()
        self.fuel = FUEL + FUEL_SHARE * len(text)
        self.unopened = self.opened = 0
        self.seen: set[tuple] = set()
        self.work: list[tuple] = []

    def add(self, text: str, lo, hi) -> None:
        """A new layer, if there is fuel for it and it wasn't there before."""
        key = text, lo[0], hi[-1]
        if key in self.seen:
            return
        if len(text) > self.fuel:
            self.unopened += 1
            return
        self.seen.add(key)
        self.fuel -= len(text)
        self.opened += 1
        self.work.append((text, lo, hi))

    def bytes_at(self, raw: bytes, start: int, end: int) -> bool:
        """A layer, or several, of what bytes hold, all of which come from one range; False if they hold none."""
        seen = set()
        while (data := inflated(raw, self.fuel)) is not None:
            if len(data) > self.fuel:
                self.unopened += 1
                return True
            self.fuel -= len(data)
            if data in seen:  # a stream that unpacks to itself
                return True
            seen.add(data)
            raw = data
        text = readable(raw)
        if text is None and seen:
            text = raw.decode("utf-8", "replace")
        if text:
            self.add(text, array("q", [start]) * len(text), array("q", [end]) * len(text))
        return bool(text)

    def word_at(self, text: str, lo, hi, start: int, end: int) -> bool:
        raw = _base64(text[start:end])
        return bool(raw) and self.bytes_at(raw, lo[start], hi[end - 1])

    def unwrap(self, text: str, lo, hi, escapes: bool = True, words: bool = True, streams: bool = True) -> None:
        """The layers within a layer."""
        if escapes and (layer := unescaped(text, lo, hi)):
            if layer[0]:
                self.add(*layer)
        for m in _WORD.finditer(text) if words else ():
            # all lines as one word, or all but the last; else the word may stand among others
            whole = [(m.start(), m.end()), *([(m.start(), m.start() + m[0].rindex("\n"))] if "\n" in m[0] else [])]
            if any(self.word_at(text, lo, hi, *x) for x in whole) or not any(c in m[0] for c in "/-_\n"):
                continue
            lines = {x.span() for x in re.finditer(_LINE + "={0,2}", m[0])} if "\n" in m[0] else set()
            for a, b in sorted(lines | {x.span() for x in _PART.finditer(m[0])}):
                if b - a < len(m[0]):
                    self.word_at(text, lo, hi, m.start() + a, m.start() + b)
        for m in _STREAM.finditer(text) if streams else ():
            head = text[m.start() : m.start() + 64].encode("latin-1", "replace")
            if inflated(head, 64) is not None or not head.startswith(b"x"):
                end = next((x.start() for x in re.finditer("[^\x00-\xff]", text[m.start() :])), len(text) - m.start()) + m.start()
                raw = text[m.start() : end].encode("latin-1")
                if inflated(raw, 64) is not None:
                    self.bytes_at(raw, lo[m.start()], hi[end - 1])

    def run(self, text: str, base: list[tuple[int, int, int]], **needs) -> None:
        self.found.update(base)
        self.seen.add((text, 0, len(text)))
        self.unwrap(text, range(len(text)), range(1, len(text) + 1), **needs)
        while self.work:
            text, lo, hi = self.work.pop()
            self.found.update((lo[s], kind, hi[e - 1]) for s, kind, e in matches(text))
            self.unwrap(text, lo, hi)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        needs = list(zip(*(pc.match_substring_regex(texts, x).to_pylist() for x in _NEEDS), strict=True))
        base, spans, opened, unopened = [], [], [], []

        def named(found) -> list[dict]:
            return [{"kind": KINDS[kind], "start": s, "end": e} for s, kind, e in found]

        for text, need in zip(texts, needs, strict=True):
            text = text.as_py() if any(need) else ""
            found = matches(text, need[:3])
            work = Worklist(text)
            if any(need[3:]):
                work.run(text, found, escapes=need[3], words=need[4], streams=need[5])
            base.append(named(found))
            spans.append(named(sorted(work.found)) if work.opened else base[-1])
            opened.append(work.opened)
            unopened.append(work.unopened)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN)), pa.array(opened, pa.int64()), pa.array(unopened, pa.int64())], names=["doc_id", "base", "spans", "layers", "unopened"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans, layers, unopened) of each row: the spans of the text itself, those of all layers, how many were opened or not for lack of fuel.

    Spans have kind, start and end in code points of the text, by start, kind (in the order of KINDS) and end.
    """
    span = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, f"doc_id long, base {span}, spans {span}, layers long, unopened long")


def listed(spans: str) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(x) for x in KINDS], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), "layers", "unopened")


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    return _digest(secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def secret_base_columns(spark, sf_dir: str) -> DataFrame:
    """The columns of the fixed patterns alone, which SQL can express."""
    return op11_secret_scan(spark, sf_dir).drop("spans", "layers", "unopened")


def _anycase(pattern: str) -> str:
    """Letters of the keywords in either case, ASCII only."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


_KEYWORDS, _AFTER = ASSIGN.split(")", 1)
_BEFORE = _AFTER.rsplit("(", 1)[0].replace("'", "''").replace(r"\x20", " ")
_SQL_ASSIGN = f"(?:{_anycase(_KEYWORDS[1:])}){_BEFORE}[A-Za-z0-9+/_.=-]+"


def _positions(kind: int, pattern: str, enough: str) -> str:
    """Matches and the texts between them; their lengths give the places."""
    return f"""SELECT doc_id, {kind} AS k, '{KINDS[kind]}' AS kind, gap + coalesce(sum(gap + len(m)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, len(m) AS n, row, {enough} AS enough
    FROM (SELECT doc_id, row, unnest(m) AS m, unnest(list_transform(between, lambda x: len(x))[:len(m)]) AS gap, generate_subscripts(m, 1) AS i
    FROM (SELECT doc_id, row, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS between FROM d WHERE regexp_matches(t, '{pattern}')))"""


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
f AS ({_positions(0, _SQL_ASSIGN, f"len(regexp_extract(m, '^(?:{_anycase(_KEYWORDS[1:])}){_BEFORE}(.*)$', 1)) >= {LEAST[0]}")}
UNION ALL {_positions(1, ACCESS, f"len(m) >= {LEAST[1]}")}
UNION ALL {_positions(2, HEX, f"len(m) >= {LEAST[2]}")}),
g AS (SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k) AS listed FROM f WHERE enough GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN g USING (row)"""
