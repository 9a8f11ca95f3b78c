"""Periodic runs of words: maximal stretches that repeat a block of words three times or more.

The method works on an enhanced suffix array, without tree nodes.  Every boundary between neighbouring suffixes
splits the interval of suffixes that share at least its common prefix d.  Of the two sides the smaller one is
listed, and for each of its suffixes i the inverse array tells whether i + d or i - d stands on the other side:
then a square of two blocks of d words starts at i (or i - d) and ends where its run ends.  Rotating such a square
to the left as long as the words agree gives the run; squares of multiples of a period merge into the same run.

Suffixes are ordered by prefix doubling within their document only, so copies among documents cost nothing.
Words are told apart by their bytes, not by hashes.  Spark deals out the documents; a task works on batches of
BATCH_WORDS words (a longer text is a batch of its own), nothing is shuffled and nothing depends on other rows.

Defined results: a null or empty text has no words and no run; a row without an id is taken as it is (no words of
it are replaced); repeated rows give repeated results; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.suffix_dedup import common_prefixes

#: The least words of a run, and how often its period fits at least.
LEAST_WORDS = 24
LEAST_TIMES = 3
#: Words of documents that are sorted together.
BATCH_WORDS = 1 << 18
#: Suffixes listed at a time.
LISTED = 1 << 22


def stretched(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that are judged: for one id in ten, a periodic tail takes the place of the text's own (fixed rule)."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    block = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (block * (-(-(n - a) // len(block))))[: n - a]


def suffix_ranks(key: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the place of each, by prefix doubling of the groups that are still tied.

    Keys of different texts differ, so no tie reaches across texts; ends: for each position, where its text ends.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    live, h = order, 1
    while len(live):
        r = rank[live]
        same = r[1:] == r[:-1]
        tied = np.zeros(len(live), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        live, r = live[tied], r[tied]
        if not len(live):
            break
        further = live + h
        ahead = np.where(further < ends[live], rank[np.minimum(further, n - 1)] + 1, 0)
        by = np.argsort(r << 32 | ahead)
        live, r, ahead = live[by], r[by], ahead[by]
        group = np.ones(len(live), dtype=bool)
        group[1:] = r[1:] != r[:-1]
        part = group.copy()
        part[1:] |= ahead[1:] != ahead[:-1]
        at = np.arange(len(live))
        rank[live] = r + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        h *= 2
    order[rank] = np.arange(n)
    return order, rank


def nearest_below(values: np.ndarray, at: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For each index of `at`, the nearest one before (step -1) or after (1) with a smaller (or equal) value; both ends of `values` are below all."""
    to = np.arange(len(values)) + step
    live = at
    while True:
        there = values[to[live]]
        live = live[there > values[live] if equal else there >= values[live]]
        if not len(live):
            return to[at]
        to[live] = to[to[live]]


def branching_squares(key: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, d) of each pair of equal neighbouring blocks of d words that the next word does not prolong."""
    n = len(key)
    none = np.zeros(0, dtype=np.int64)
    if n < 2:
        return none, none
    order, rank = suffix_ranks(key, ends)
    prefix = np.full(n + 1, -1, dtype=np.int64)
    prefix[1:n] = common_prefixes(key, ends, order)[1:]
    at = np.flatnonzero(prefix[:n] > 0)
    if not len(at):
        return none, none
    first = nearest_below(prefix, at, -1, True)
    last = nearest_below(prefix, at, 1, False) - 1
    before = at - first <= last - at + 1  # the side before the boundary is the smaller one
    small_at = np.where(before, first, at)
    small = np.where(before, at - first, last - at + 1)
    other_at, other_to = np.where(before, at, first), np.where(before, last, at - 1)
    depth = prefix[at]
    starts, blocks = [], []
    stops = np.cumsum(small)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(stops, np.arange(LISTED, stops[-1], LISTED)) + 1, [len(at)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        sizes = small[a:b]
        whose = np.repeat(np.arange(a, b), sizes)
        i = order[np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + small_at[whose]]
        d, lo, hi = depth[whose], other_at[whose], other_to[whose]
        for to, start in ((i + d, i), (i - d, i - d)):
            r = rank[np.clip(to, 0, n - 1)]
            hit = (to >= 0) & (to < n) & (r >= lo) & (r <= hi)
            starts.append(start[hit])
            blocks.append(d[hit])
    return np.concatenate(starts), np.concatenate(blocks)


def rotations(key: np.ndarray, floor: int, start: int, d: int) -> int:
    """How far the square at `start` can be rotated to the left, not beyond `floor`."""
    done, step = 0, 64
    while True:
        size = min(step, start - floor - done)
        if not size:
            return done
        a, b = start - done - size, start - done
        differ = np.flatnonzero(key[a:b] != key[a + d : b + d])
        if len(differ):
            return done + size - 1 - int(differ[-1])
        done, step = done + size, 2 * step


class _Numbers(dict):
    """Running numbers of words, by their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs_of(texts: list[list[bytes]], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, smallest period) of every run of each text, by start, then period."""
    known = _Numbers()
    codes = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), dtype=np.int64)
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    key = owner * max(1, len(known)) + codes
    begin = stops - sizes
    start, d = branching_squares(key, stops[owner])
    # a run needs so many rotations; a few words tell apart almost all that don't come so far
    need = np.maximum(least, times * d) - 2 * d
    for back in range(1, 17):
        live = (need < back) | (start - back >= 0) & (key[start - back] == key[start + d - back])
        start, d, need = start[live], d[live], need[live]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = np.lexsort((d, start + 2 * d))
    end, same_end = -1, []
    for at, period in zip(start[order].tolist(), d[order].tolist(), strict=True):
        if at + 2 * period != end:
            end, same_end = at + 2 * period, []
        if any(period % p == 0 and 2 * period <= length for length, p in same_end):
            continue
        text = int(owner[at])
        length = rotations(key, int(begin[text]), at, period) + 2 * period
        if length >= max(least, times * period):
            same_end.append((length, period))
            found[text].append((end - length - int(begin[text]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without what runs repeat: of each run its first period stays."""
    keep = np.ones(len(words), dtype=bool)
    for at, length, period in runs:
        keep[at + period : at + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)] if runs else words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _finder(least: int, times: int, stretch: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list, texts: list) -> pa.RecordBatch:
            found = runs_of(texts, least, times)
            runs = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in of_text] for of_text in found]
            kept = pa.array(map(collapsed, texts, found), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(runs, pa.list_(_RUN)), kept], names=["doc_id", "n_words", "runs", "collapsed"])

        ids, texts, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # just at the bytes 0x20 and 0x09 to 0x0D
                ids.append(doc_id.as_py())
                texts.append(stretched(words, ids[-1]) if stretch else words)
                n += len(words)
                if n >= BATCH_WORDS or len(ids) >= BATCH_WORDS:
                    yield done(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield done(ids, texts)

    return rows


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES, stretch: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each document: every run by start, then period, and the text without what runs repeat.

    stretch: judge the words of stretched() in place of the text's own.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(_finder(least, times, stretch), SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def digested(found: DataFrame) -> DataFrame:
    """The runs of each document counted and digested, with the one of the greatest exponent (ties: the first, then the shorter period)."""
    more = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]  # noqa: E731  exact fractions
    top = F.aggregate(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda best, x: F.when(more(x, best), x).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    df = found.withColumn("top", top)
    return df.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digested(periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), stretch=True))
