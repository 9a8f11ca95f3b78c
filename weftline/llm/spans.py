"""Candidates for repeated spans: the windows of all documents, cut into runs by minimizer.

A window is a fixed number of consecutive units (words or bytes) of one text.  Windows are cut into
maximal runs that share a minimizer (a super-k-mer).  Equal windows have equal minimizers, so a window
can only be repeated if the hash of its run's minimizer is, and two runs with equal content are wholly
repeated.  That makes one narrow row per run (a ninth to a seventieth of the windows), counted by a
map-side combined aggregate and joined back by key, so that a hot passage never gathers in one task.

A run is (anchor, content, doc_id, text_key, place): the hash of its minimizer, the hash of its whole
content, the id and the 64-bit hash of its text, and place = first window << 8 | number of windows.  Rows
that share a doc_id, or have none, stay apart by their texts; rows that are wholly equal get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernels as k
from weftline.llm.runtime import cut

COUNT_BITS = 8
RUN_SCHEMA = "anchor long, content long, doc_id long, text_key long, place long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, text_key) of any table, other columns dropped."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def _units(data: np.ndarray, offsets: np.ndarray, by_words: bool) -> tuple[k.Rolling, np.ndarray]:
    if by_words:
        words = k.Words(data, offsets)
        return k.Rolling(words.hashes), words.bounds
    return k.byte_rolling(data), offsets


def run_rows(by_words: bool, gram: int, length: int, with_place: bool) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in k.slices(batch.column(1)):
                rolling, bounds = _units(data, offsets, by_words)
                grams = rolling.grams(gram)
                owner, a, b, p = k.runs_by_minimizer(grams, bounds, gram, length)
                at = pa.array(first + owner)
                columns = [pa.array(grams[p].view(np.int64)), batch.column(0).take(at)]
                if with_place:
                    columns += [batch.column(2).take(at), pa.array((a - bounds[owner]) << COUNT_BITS | (b - a + 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "text_key", "place"][: len(columns)])

    return rows


def digests(by_words: bool, join_words: bool) -> Callable:
    """(doc_id, text_key, n_units, sha256 of the whole) of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_n, out_sha = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                if join_words:
                    words = raw.split()
                    out_n.append(len(words))
                    raw = b" ".join(words)
                else:
                    out_n.append(len(raw))
                out_sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out_n, pa.int64()), pa.array(out_sha, pa.string())], names=["doc_id", "text_key", "n_units", "sha"])

    return rows


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = pa.array([press.compress((x.as_py() or "").encode()) for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), texts], names=["doc_id", "text_key", "packed"])


def same_doc(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def _shared_places(docs: DataFrame, by_words: bool, gram: int, length: int, across: bool) -> DataFrame:
    narrow = docs.mapInArrow(run_rows(by_words, gram, length, False), "anchor long, doc_id long")
    if across:
        found = narrow.where("doc_id is not null").groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    else:
        found = narrow.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    runs = docs.mapInArrow(run_rows(by_words, gram, length, True), "anchor long, doc_id long, text_key long, place long")
    # each anchor is one row of `found`, so the join emits each run once at most; AQE splits hot anchors
    shared = runs.join(found.select("anchor").hint("shuffle_hash"), "anchor")
    return shared.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def _with_text(docs: DataFrame, places: DataFrame) -> DataFrame:
    packed = docs.mapInArrow(pack_texts, "doc_id long, text_key long, packed binary")
    return packed.join(places, same_doc(packed, places)).select(packed["doc_id"], packed["text_key"], "packed", "places")


def candidates(docs: DataFrame, by_words: bool, gram: int, length: int, across: bool) -> DataFrame:
    """One row for each text with a run whose minimizer is found elsewhere: (doc_id, text_key, packed, places), checkpointed.

    `across`: elsewhere is another document; else any other run, in the same document too.
    Two checkpoints, so that the wide shuffles of the first half are gone before texts move.
    """
    places = cut(lambda: _shared_places(docs, by_words, gram, length, across))
    return cut(lambda: _with_text(docs, places))


def runs_of(found: DataFrame, by_words: bool, gram: int, length: int) -> DataFrame:
    """(anchor, content, doc_id, text_key, place) of the runs of candidates()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            anchors, contents, counts, places = [], [], [], []
            for packed, chosen in zip(batch.column(2), batch.column(3), strict=True):
                data = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
                rolling, bounds = _units(data, np.array([0, len(data)]), by_words)
                grams = rolling.grams(gram)
                _, a, b, p = k.runs_by_minimizer(grams, bounds, gram, length)
                chosen = np.sort(chosen.values.to_numpy(zero_copy_only=False))
                at = np.searchsorted(a, chosen >> COUNT_BITS)
                anchors.append(grams[p[at]].view(np.int64))
                contents.append(rolling.of(a[at], b[at] + length).view(np.int64))
                places.append(chosen)
                counts.append(len(chosen))
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (anchors, contents, places)]
            yield pa.RecordBatch.from_arrays([flat[0], flat[1], batch.column(0).take(owner), batch.column(1).take(owner), flat[2]], names=["anchor", "content", "doc_id", "text_key", "place"])

    return found.select("doc_id", "text_key", "packed", "places").mapInArrow(rows, RUN_SCHEMA)


def fetched(found: DataFrame, need: DataFrame, make: Callable[[bytes, int, int], object], kind: str, *extra: str) -> DataFrame:
    """(anchor, content, doc_id, made, extra...) for each row (anchor, content, doc_id, text_key, place, extra...) of need, joined by document: made is make(text, first window, number of windows).

    Rows that are wholly alike are neighbours after the join, and only the first of them is read.
    """
    given = ["anchor", "content", "place", *extra]
    wanted = need.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*given)).alias("wanted"))
    texts = found.select("doc_id", "text_key", "packed")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        field = {"array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[kind]
        before = None
        for batch in batches:
            columns: list[list] = [[] for _ in given]
            made, sizes = [], []
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for key, packed, want in zip(keys, batch.column(2), batch.column(3), strict=True):
                if key == before:
                    sizes.append(0)
                    continue
                before = key
                raw = unpack.decompress(packed.as_py())
                values = [want.values.field(i).to_numpy(zero_copy_only=False) for i in range(len(given))]
                place = values[2]
                made += make(raw, place >> COUNT_BITS, place & ((1 << COUNT_BITS) - 1))
                for column, part in zip(columns, values, strict=True):
                    column.append(part)
                sizes.append(len(place))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in columns]
            yield pa.RecordBatch.from_arrays([*flat[:2], ids, pa.array(made, field), *flat[3:]], names=["anchor", "content", "doc_id", "made", *extra])

    joined = texts.join(wanted, same_doc(texts, wanted)).select(texts["doc_id"], texts["text_key"], "packed", "wanted")
    return joined.mapInArrow(rows, ", ".join(["anchor long", "content long", "doc_id long", f"made {kind}", *(f"{x} long" for x in extra)]))


def hits_of(runs: DataFrame, verdict: DataFrame, whole: Column) -> DataFrame:
    """(doc_id, text_key, hits): all windows of a run where `whole` holds, else the windows that its verdict's `at` lists."""
    whole_run = F.array("place")
    first = F.shiftright("place", COUNT_BITS)
    part = F.transform(F.col("at"), lambda x: F.shiftleft(first + x, COUNT_BITS) + F.lit(1))
    hit = runs.join(verdict, ["anchor", "content"]).where(whole | F.col("at").isNotNull())
    return hit.select("doc_id", "text_key", F.when(whole, whole_run).otherwise(part).alias("hits")).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def removed(found: DataFrame, verdicts: DataFrame, length: int, by_words: bool, keep_text: bool) -> DataFrame:
    """Per candidate text: (doc_id, text_key, n_removed, n_spans, sha, spans[, kept]).

    `verdicts`: (doc_id, text_key, hits), hits an array of first window << 8 | number of windows that go.
    """
    texts = found.select("doc_id", "text_key", "packed")
    joined = texts.join(verdicts, same_doc(texts, verdicts)).select(texts["doc_id"], texts["text_key"], "packed", "hits")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for packed, hits in zip(batch.column(2), batch.column(3), strict=True):
                raw = unpack.decompress(packed.as_py())
                hits = hits.values.to_numpy(zero_copy_only=False)
                first = hits >> COUNT_BITS
                begin, end = k.spans_of(first, first + (hits & ((1 << COUNT_BITS) - 1)) - 1 + length)
                if by_words:
                    words = raw.split()
                    kept, at = [], 0
                    for b, e in zip(begin, end, strict=True):
                        kept += words[at:b]
                        at = e
                    left = b" ".join(kept + words[at:])
                else:
                    kept, at = [], 0
                    for b, e in zip(begin, end, strict=True):
                        kept.append(raw[at:b])
                        at = e
                    left = b"".join([*kept, raw[at:]])
                for column, value in zip(out, (int((end - begin).sum()), len(begin), hashlib.sha256(left).hexdigest(), [{"start": int(b), "end": int(e)} for b, e in zip(begin, end, strict=True)], left.decode("utf-8", "ignore") if keep_text else None), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], span), pa.array(out[4], pa.string())], names=["doc_id", "text_key", "n_removed", "n_spans", "sha", "spans", "kept"])

    return joined.mapInArrow(rows, "doc_id long, text_key long, n_removed long, n_spans long, sha string, spans array<struct<start:long,end:long>>, kept string")
