"""Suffix-array dedup: every byte covered by a 200-byte string that also starts anywhere else goes.

1. Windows of 200 bytes are cut into runs by minimizer (weftline.llm.spans); runs whose minimizer is
   unique hold no repeated window and are dropped.  Runs of equal content are represented by their first and
   their last copy, so that a hot passage is two rows.
2. The representatives go to shards by their minimizer, so equal windows meet in one shard.  A shard's texts get a suffix array by prefix doubling that refines only
   the groups that are not yet split (Larsson-Sadakane), to the depth of a window, and Kasai's common
   prefixes tell which neighbours share a whole window.
3. A minimizer with very many different runs is dealt over several shards.  Each of these gives its
   distinct windows as sorted blocks, cut into ranges, and the blocks of a range are merged by binary
   search.  No group is larger than a bounded shard or a range of it.

Matches never cross documents; strings are judged on the input.

Defined results: a null or empty text has no bytes; texts under 200 bytes keep all; rows that are
repeated (same id, same text) repeat each other; rows that share a doc_id or have none are documents of their
own, told apart by a 64-bit hash of their texts; an empty table gives an empty result; further columns of the
input are ignored or, in without_repeats(), kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernels as k
from weftline.llm import spans
from weftline.llm.runtime import cut

WINDOW = 200
GRAM = 64
#: Different runs of a shard, and of one minimizer before it is dealt over several shards.
SHARD_RUNS = 2500


def suffix_array(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their first `depth` bytes, and ranks (equal for equal strings).

    `ends`: for each position, where its text ends.  Only positions with `depth` bytes before that are
    sorted to the full depth and returned; ranks of others only hold as deep as they reach.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = key << k.U64(8) | padded[j : j + n]
    left = ends - np.arange(n)
    active = np.flatnonzero(left >= 8)
    order = active[np.argsort(key[active])]
    sorted_key = key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.zeros(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = 8
    room = left[order]
    live = order
    while h < depth:
        # a round refines by the ranks one and, where three fit a 64-bit key, two steps ahead
        near = min(h, depth - h)
        far = min(h, depth - h - near) if n < 1 << 21 else 0
        keep = room >= h + near + far  # still in rank order
        live, room = live[keep], room[keep]
        r = rank[live]
        same = r[1:] == r[:-1]
        tied = np.zeros(len(live), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        live, room, r = live[tied], room[tied], r[tied]
        if not len(live):
            break
        ahead = rank[live + near]
        if far:
            ahead = ahead << 21 | rank[live + near + far]
            by = np.argsort(r << 42 | ahead)
        else:
            by = np.argsort(r << 32 | ahead)
        h += near + far
        live, room, r, ahead = live[by], room[by], r[by], ahead[by]
        group = np.ones(len(live), dtype=bool)
        group[1:] = r[1:] != r[:-1]
        sub = group.copy()
        sub[1:] |= ahead[1:] != ahead[:-1]
        index = np.arange(len(live))
        group_at = np.maximum.accumulate(np.where(group, index, 0))
        sub_at = np.maximum.accumulate(np.where(sub, index, 0))
        rank[live] = r + sub_at - group_at
    whole = np.flatnonzero(left >= depth)
    return whole[np.argsort(rank[whole], kind="stable")], rank


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: the common prefix of each position of `order` with the one before it, computed in text order.

    Where both positions moved on by one since the last text position, the prefix is one shorter and
    needs no look at the text; all others are compared at once, eight bytes a round.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.sort(order)
    prev = before[at]
    length = np.zeros(len(at), dtype=np.int64)
    derived = np.zeros(len(at), dtype=bool)
    derived[1:] = (at[1:] == at[:-1] + 1) & (prev[1:] == prev[:-1] + 1) & (prev[:-1] >= 0) & (ends[at[1:]] == ends[at[:-1]]) & (ends[prev[1:]] == ends[prev[:-1]]) & (data[at[:-1]] == data[prev[:-1]])
    todo = np.flatnonzero(~derived & (prev >= 0))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    most = np.minimum(ends[at] - at, np.where(prev >= 0, ends[prev] - prev, 0))
    while len(todo):
        x, y = at[todo] + length[todo], prev[todo] + length[todo]
        equal = words[np.minimum(x, n)] == words[np.minimum(y, n)]
        run = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        length[todo] = np.minimum(length[todo] + run, most[todo])
        todo = todo[(run == 8) & (length[todo] < most[todo])]
    # a chain of derived prefixes starts at the last compared position
    source = np.maximum.accumulate(np.where(~derived, np.arange(len(at)), 0))
    length = length[source] - (np.arange(len(at)) - source)
    out = np.zeros(n, dtype=np.int64)
    out[at] = np.maximum(length, 0)
    return out[order]


def _shard(window: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        # a table's repeated rows bring a copy more than once; two are enough, and one of what is single
        nth = pdf.groupby(["anchor", "content"], sort=False).cumcount().to_numpy()
        pdf = pdf[nth < np.minimum(pdf["n"].to_numpy(), 2)]
        raw = pdf["made"].to_list()
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        stops = np.cumsum(sizes)
        ends = np.repeat(stops, sizes)
        order, _ = suffix_array(data, ends, window)
        prefix = common_prefixes(data, ends, order)
        full = prefix[1:] >= window
        shared = np.zeros(len(data), dtype=bool)
        shared[order[1:][full]] = shared[order[:-1][full]] = True
        places = np.flatnonzero(shared)  # run by run, in order
        owner = np.searchsorted(stops, places, side="right")
        windows = sizes - window + 1
        rows = []
        for i, at in k.runs_of_equal(owner, places - (stops - sizes)[owner]):
            whole = len(at) == windows[i]
            rows.append((pdf["anchor"].iat[i], pdf["content"].iat[i], whole, [] if whole else at, None, None))
        parts = int(pdf["parts"].iat[0])
        if parts > 1:  # the minimizer has further shards: distinct windows as sorted blocks by range
            one = order[~np.concatenate([np.zeros(min(1, len(order)), dtype=bool), full])]  # the first of each distinct window
            rolling = k.byte_rolling(data)
            digest = rolling.of(one, one + window)
            by = np.argsort(digest, kind="stable")
            who = np.searchsorted(stops, one, side="right")
            off = one - (stops - sizes)[who]
            digest, who, off = digest[by], who[by], off[by]
            cuts = np.linspace(0, 2.0**64, parts + 1)[1:-1].astype(np.uint64)
            where = np.concatenate([[0], np.searchsorted(digest, cuts), [len(digest)]])
            contents = pdf["content"].to_numpy()
            for j in range(parts):
                a, b = where[j], where[j + 1]
                if b > a:
                    block = np.rec.fromarrays([digest[a:b], contents[who[a:b]], off[a:b]], names="digest,content,offset")
                    rows.append((pdf["anchor"].iat[0], None, None, None, j, block.tobytes()))
        return pd.DataFrame(rows, columns=["anchor", "content", "whole", "at", "range", "block"], dtype=object)

    return work


_RECORD = np.dtype([("digest", np.uint64), ("content", np.int64), ("offset", np.int64)])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    blocks = [np.frombuffer(x, dtype=_RECORD) for x in pdf["block"]]
    everything = np.sort(np.concatenate([x["digest"] for x in blocks]))
    rows = []
    for block in blocks:
        found = np.searchsorted(everything, block["digest"], side="right") - np.searchsorted(everything, block["digest"], side="left") > 1
        rows += [(pdf["anchor"].iat[0], content, at) for content, at in k.grouped(block["content"][found], block["offset"][found])]
    return pd.DataFrame(rows, columns=["anchor", "content", "at"], dtype=object)


def _bytes(window: int):
    def make(raw: bytes, first: np.ndarray, count: np.ndarray) -> list:
        return [raw[a : a + n - 1 + window] for a, n in zip(first, count, strict=True)]

    return make


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, shard_runs: int = SHARD_RUNS) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, per text with removals: doc_id, text_key, n_removed, n_spans, sha, spans in bytes, kept)."""
    docs = spans.keyed(docs, id_col, text_col)
    found = spans.candidates(docs, False, gram, window, across=False)
    runs = spans.runs_of(found, False, gram, window)
    at = F.struct("doc_id", "text_key", "place")
    pieces = cut(lambda: runs.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last")))
    by = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces"), F.max("n").alias("most")).where("pieces > 1 or most > 1")
    # of equal runs two copies are looked at: rows that are wholly alike are the same place twice
    copies = F.explode(F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array("first"))).alias("copy")
    need = pieces.join(by.hint("shuffle_hash"), "anchor").select("anchor", "content", "n", F.ceil(2 * F.col("pieces") / F.lit(shard_runs)).cast("long").alias("parts"), copies)
    need = need.select("anchor", "content", "n", "parts", "copy.*")
    shards = max(1, -(-need.count() // shard_runs))
    dealt = (
        spans.fetched(found, need, _bytes(window), "binary", "n", "parts")
        .drop("doc_id")
        .withColumn("shard", F.when(F.col("parts") > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
        .withColumn("part", F.when(F.col("parts") > 1, 1 + F.pmod(F.xxhash64("content"), "parts")).otherwise(F.lit(0).cast("long")))
    )
    sorted_out = cut(lambda: dealt.groupBy("shard", "part").applyInPandas(_shard(window), "anchor long, content long, whole boolean, at array<long>, range long, block binary"))
    merged = sorted_out.where("block is not null").groupBy("anchor", "range").applyInPandas(_merge, "anchor long, content long, at array<long>").withColumn("whole", F.lit(False))
    found_at = sorted_out.where("whole is not null").select("anchor", "content", "whole", "at").unionByName(merged)
    verdict = found_at.groupBy("anchor", "content").agg(F.bool_or("whole").alias("whole"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    hits = spans.hits_of(runs, verdict, F.col("whole"))
    return docs, spans.removed(found, hits, window, False, keep_text).dropDuplicates(["doc_id", "text_key"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each document."""
    keyed, gone = repeated_bytes(docs, id_col, text_col, **options)
    every = keyed.mapInArrow(spans.digests(False, False), "doc_id long, text_key long, n_units long, sha string")
    return every.join(gone, spans.same_doc(every, gone), "left").select(
        every["doc_id"],
        every["n_units"].alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce(gone["sha"], every["sha"]).alias("kept_sha256"),
        "spans",
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents with their texts cut (split characters at a cut are dropped) and lengths renewed; all rows stay."""
    _, gone = repeated_bytes(docs, id_col, text_col, keep_text=True, **options)
    gone = gone.select("doc_id", "text_key", "kept")
    # the table's own columns travel in a struct, so that their names can't clash with those of the cuts
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("own"))
    key = F.xxhash64(F.coalesce(F.col("own")[text_col].cast("string"), F.lit("")))
    out = own.join(gone, F.col("own")[id_col].cast("long").eqNullSafe(gone["doc_id"]) & (key == gone["text_key"]), "left")
    text = F.coalesce("kept", F.col("own")[text_col].cast("string"))
    fresh = {text_col: text.cast(docs.schema[text_col].dataType)}
    if length_col in docs.columns:
        fresh[length_col] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[length_col].dataType)
    return out.select(*[fresh.get(c, F.col("own")[c]).alias(c) for c in docs.columns])


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
