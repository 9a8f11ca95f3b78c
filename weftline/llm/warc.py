"""WARC archives: writing through Spark's text sink, and a reader that salvages damaged files.

Writing: one record for each page.  Pages of equal payload of at least 1000 bytes keep one response (the
largest page_id); the others become revisit records that refer to it.  Each record is a gzip member of its own,
as the format advises, so damage costs one record.  The members go as bytes through the text sink, whose line
separator is an empty member, so the files are written by Spark's own commit protocol to any store, bounded in
records each.

Reading: whole bounded files, one after another.  A record is checked by its version line, its header block,
its Content-Length, its closing blank lines and its payload digest.  After a failed check the reader looks
for the next version line (or, in compressed files, for the next gzip member), goes on there, and logs the
bytes in between as a quarantined gap; so one bad record does not cost the later ones.

Defined results: a null page is an empty payload; an empty table writes and gives nothing; repeated rows
give one record each, and rows that share an id are compared by their own payloads; further columns are ignored; urls and headers never break a record, as CR and LF in
them are percent-encoded; a null id is written as an empty id and read back as null.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.runtime import shared_folder

VERSION = "WARC/1.1"
LEAST_BYTES = 1000
RECORDS_PER_FILE = 1000
END = b"\r\n\r\n"
_START = re.compile(rb"WARC/1\.[01]\r?\n")
_GZIP = b"\x1f\x8b\x08"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(value): one record each, without its closing blank lines."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    digest = F.sha1(F.encode(html, "utf-8")).alias("_digest")
    narrow = pages.where(F.octet_length(html) >= least).select(F.col(id_col).cast("long").alias("_id"), digest)
    groups = narrow.groupBy("_digest").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # only ids and digests move here: the revisits, and what they refer to; rows that share an id need not share a payload
    revisits = narrow.join(groups, "_digest").where("_id < _first").groupBy("_id", "_digest").agg(F.max("_first").alias("_first"))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"), html.alias("_html"), digest).join(revisits, ["_id", "_digest"], "left")
    again = F.col("_first").isNotNull()
    crlf = F.lit("\r\n")
    uri = F.replace(F.replace("_url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:weftline:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("_digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.octet_length("_html").cast("string"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("_first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(again, F.lit("0")).otherwise(F.octet_length("_html").cast("string")),
        crlf,
        crlf,
    )
    return rows.select(F.concat(head, F.when(again, F.lit("")).otherwise(F.col("_html"))).alias("value"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [gzip.compress(x.as_py().encode() + END, 6, mtime=0) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **columns) -> None:
    members = records(pages, **columns).mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
    nothing = gzip.compress(b"", mtime=0).decode("latin-1")
    out = members.write.mode("errorifexists").option("encoding", "ISO-8859-1").option("lineSep", nothing)
    out.option("maxRecordsPerFile", records_per_file).text(path)


def _inflate(raw: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, end, data, whole) of each gzip member; after damage, from the next one that opens."""
    at = 0
    while at < len(raw):
        if raw[at : at + 3] != _GZIP:
            found = raw.find(_GZIP, at + 1)
            end = len(raw) if found < 0 else found
            yield at, end, b"", False
            at = end
            continue
        machine, data, whole = zlib.decompressobj(31), bytearray(), True
        try:
            view = memoryview(raw)
            for i in range(at, len(raw), 1 << 16):
                data += machine.decompress(view[i : i + (1 << 16)])
                if machine.eof:
                    break
            end = len(raw) if not machine.eof else min(i + (1 << 16), len(raw)) - len(machine.unused_data)
            whole = machine.eof
        except zlib.error:
            whole = False
        if not whole:
            found = raw.find(_GZIP, at + 3)
            end = len(raw) if found < 0 else found
        yield at, end, bytes(data), whole
        at = end


def parse(data: bytes) -> Iterator[tuple[str, int, int, dict | None, bytes]]:
    """("record", start, end, headers, payload) and ("gap", start, end, None, b"") of uncompressed archive bytes."""
    at, gap = 0, None
    while at < len(data):
        record = _record(data, at)
        if record:
            if gap is not None:
                yield "gap", gap, at, None, b""
                gap = None
            end, headers, payload = record
            yield "record", at, end, headers, payload
            at = end
        else:
            gap = at if gap is None else gap
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
    if gap is not None:
        yield "gap", gap, len(data), None, b""


def _record(data: bytes, at: int) -> tuple[int, dict, bytes] | None:
    opened = _START.match(data, at)
    if not opened:
        return None
    stop = data.find(END, opened.end() - 2, opened.end() + (1 << 20))
    if stop < 0:
        return None
    headers = {}
    for line in data[opened.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        return None
    begin = stop + len(END)
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != END:
        return None
    payload = data[begin:end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.startswith("sha1:") and len(digest) == 45 and hashlib.sha1(payload).hexdigest() != digest[5:].lower():
        return None
    return end + 4, headers, payload


READ_SCHEMA = "file string, kind string, start long, end long, record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload string"


def _reader(with_payload: bool):
    fields = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                packed = raw[:3] == _GZIP or file.endswith(".gz")
                out = []
                # records may go on over members, so whole neighbours are read as one run of bytes
                joined, holes = bytearray(), []
                for start, end, data, whole in _inflate(raw) if packed else [(0, len(raw), raw, True)]:
                    joined += data
                    if not whole:
                        holes.append((file, "gap", start, end, *[None] * 7))
                for kind, start, end, head, payload in parse(bytes(joined)):
                    if kind == "gap":
                        out.append((file, "text gap" if packed else "gap", start, end, *[None] * 7))
                        continue
                    digest = head.get("warc-payload-digest", "")
                    digest = digest[5:].lower() if len(digest) == 45 else hashlib.sha1(payload).hexdigest()
                    size = head.get("x-payload-length", "")
                    out.append((file, "record", start, end, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-type"), head.get("warc-refers-to"), digest, int(size) if size.isdigit() else len(payload), payload.decode("utf-8", "replace") if with_payload else None))
                out += holes
                columns = list(zip(*out, strict=True)) if out else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names=names)

    return rows


def read(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "*") -> DataFrame:
    """All records and gaps below a path: kind is record, gap (bytes of the file) or text gap (bytes of the inflated file)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(_reader(with_payload), READ_SCHEMA)


def page_of(record: str) -> Column:
    found = F.regexp_extract(record, r"page:(-?[0-9]+)>", 1)
    return F.when(found != "", found).cast("long")


def op8_warc_salvage(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = read(spark, folder, with_payload=False, glob="part-*").where("kind = 'record'")
    return back.select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )


#: The whole contract in DuckDB SQL.
SQL = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to FROM g"""
