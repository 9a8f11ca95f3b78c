"""N-gram Jaccard join: all documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

1. Each text becomes a sorted set of shingle hashes; equal sets are one class, named by a hash of the set.
2. Who can have a partner?  A set of n shingles with a partner of another class shares at least 80 % of them,
   so of its first FRONT * n hashes at most n / 5 are its own.  These front hashes are counted over all
   classes (narrow rows, map-side combined); a class with more than n / 5 front hashes of its own is alone.
   A larger partner's own hashes can push a shared one out of its front; SHORT sizes, where that costs a hit, may
   lack one more.
3. Of what is left, all hashes are counted among each other: a class stays only if it shares at least 80 % of its
   own.  Those are joined to groups by shared hashes of their n / 5 + 1 rarest (each to the smallest class that has
   the hash there, so a hot hash gives one edge for each class and no pairs); partners always share one of these.
4. A group is cut into tiles of bounded size by bands of set size (a factor of 1.25 each), and a tile is packed
   to a fraction of its sets' bytes.  Pairs of tiles of the same band or of neighbouring bands are compared: hashed
   bitmap signatures bound the overlap from above by bit counts, and the pairs that remain are intersected exactly
   by their sorted hashes.  A tile pair gives link counts and spanning edges, not pairs.
5. Components of the links by label propagation over the spanning edges, checkpointed.

No pair of different sets is lost: all bounds are exact, there is no cap on groups or partners.

Defined results: a text of one to four words is one shingle, its whole sequence; null or empty texts have no
shingles and link with nothing; rows that share a doc_id are rows of their own, linked like copies;
a null doc_id takes part and names a component only if all of its documents lack one; an empty table
gives an empty result; further columns are ignored or, in one_of_each(), kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernels as k
from weftline.llm.runtime import cut

SHINGLE = 5
#: Similarity PART / WHOLE.
PART, WHOLE = 4, 5
#: Share of a set's smallest hashes that are counted.
FRONT = 0.25


def _front(n: int) -> int:
    return min(n, int(FRONT * n) + 2)


def _least_hits(n: int) -> int:
    """The fewest front hashes that a set of n can share with the front of a partner of another class."""
    hits = [_front(n)]
    for m in range(-(-PART * n // WHOLE), WHOLE * n // PART + 1):
        # one that shares all it can, and less: common >= PART * (n + m) / (PART + WHOLE)
        for common in range(-(-PART * (n + m) // (PART + WHOLE)), min(n, m) + 1):
            hits.append(min(_front(n) - (n - common), _front(m) - (m - common)))
    return min(hits)


#: Sizes of which one hit more can be missing.  With FRONT a quarter, a set loses at most 1.55 - n / 80 hits to a partner's front, so never two, and none from 45 on.
SHORT = tuple(n for n in range(1, 45) if _least_hits(n) < _front(n) - n // WHOLE)
#: Classes and hashes of a tile at most (one set is never cut), and bits of a signature for each shingle of its largest set.
TILE = 512
TILE_HASHES = 1 << 19
BITS = 2


def _sets(words: k.Words, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted by text and value, number of each text) of distinct shingles."""
    rolling = k.Rolling(words.hashes)
    begin, end = words.bounds[:-1], words.bounds[1:]
    count = np.where(end - begin >= SHINGLE, end - begin - SHINGLE + 1, np.minimum(end - begin, 1))
    text = np.repeat(np.arange(n_texts), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + begin[text]
    hashes = rolling.of(at, np.minimum(at + SHINGLE, end[text]))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.bincount(text, minlength=n_texts)


def _names(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each set; it doesn't depend on order."""
    where = np.concatenate([[0], np.cumsum(counts)])
    sums = np.concatenate([np.zeros(1, k.U64), np.cumsum(k.mix(hashes ^ k.U64(0x51ED270B0A1F39C1)), dtype=np.uint64)])
    return k.mix(sums[where[1:]] - sums[where[:-1]] + counts.astype(np.uint64)).view(np.int64)


def _slices(column: pa.Array):
    for first, data, offsets in k.slices(column):
        hashes, counts = _sets(k.Words(data, offsets, fold=True), len(offsets) - 1)
        yield first, hashes, counts, _names(hashes, counts)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, counts, key in _slices(batch.column(1)):
            row = [batch.column(i).slice(first, len(key)) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([*row, pa.array(counts, pa.int64()), pa.array(key)], names=["doc_id", "text_hash", "n", "key"])


def _fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, hashes, counts, key in _slices(batch.column(1)):
            front = np.minimum(counts, np.floor(FRONT * counts).astype(np.int64) + 2)
            text = np.repeat(np.arange(len(counts)), counts)
            rank = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = rank < front[text]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(key[text[keep]])], names=["hash", "key"])


def _hopeful(narrow: DataFrame, classes: DataFrame) -> DataFrame:
    """(key) of the classes that can have partners, by their front hashes."""
    fronts = narrow.mapInArrow(_fronts, "hash long, key long")
    shared = fronts.groupBy("hash").agg(F.min("key").alias("least_key"), F.max("key").alias("last")).where("least_key < last")
    hit = fronts.join(shared.select("hash").hint("shuffle_hash"), "hash")
    by = hit.groupBy("key").agg(F.count(F.lit(1)).alias("hits"))
    n = F.col("n")
    front = F.least(n, F.floor(n * FRONT) + 2)
    # copies bring the same hashes again
    least = front - F.floor(n / WHOLE) - n.isin(*SHORT).cast("int")
    return by.join(classes, "key").where(F.col("hits") / F.col("copies") >= least).select("key")


def _edges(members: DataFrame) -> DataFrame:
    """(key, leader): classes that share a rare hash, each with the smallest class that has it among its rarest.

    Hashes are ordered by how many members hold them, so a passage that many texts share comes last.  In any one
    order, two sets of which each shares PART of WHOLE of its hashes with the other meet among their first n / WHOLE + 1;
    hashes that no other member has are the first of all, so they leave fewer places for shared ones.
    """
    every = members.select("key", "n", F.explode("set").alias("hash"))
    shared = every.groupBy("hash").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    hit = every.join(shared.hint("shuffle_hash"), "hash")
    by = hit.groupBy("key").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.struct("held", "hash"))).alias("hits"))
    by = by.where(WHOLE * F.size("hits") >= PART * F.col("n"))
    places = F.floor(F.col("n") / WHOLE) + 1 - F.col("n") + F.size("hits")
    first = cut(lambda: by.select("key", F.explode(F.slice("hits", F.lit(1), places.cast("int"))["hash"]).alias("hash")))
    leaders = first.groupBy("hash").agg(F.min("key").alias("leader"), F.max("key").alias("last")).where("leader < last")
    return first.join(leaders.select("hash", "leader").hint("shuffle_hash"), "hash").select("key", "leader").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node reachable; edges are (left, right), loops allowed.

    Each round, every node takes the smallest label of its neighbours, then its label's label; a node has
    few spanning edges, and a round's state is one row for each node.
    """
    both = edges.select(F.col(left).alias("x"), F.col(right).alias("y"))
    both = cut(lambda: both.union(both.select("y", "x")).distinct())
    labels = cut(lambda: both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).select(F.col("x").alias("node"), "root"))
    while True:

        def once(old: DataFrame = labels) -> DataFrame:
            seen = both.join(old.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
            step = old.join(seen, old["node"] == seen["x"], "left").select("node", F.least("root", F.coalesce("near", "root")).alias("new"), F.col("root").alias("old"))
            up = step.select(F.col("node").alias("_up"), F.col("new").alias("up"))
            return step.join(up, step["new"] == up["_up"], "left").select("node", F.least("new", F.coalesce("up", "new")).alias("root"), "old")

        step = cut(once)
        moved = step.where("root < old").limit(1).count()
        labels = step.select("node", "root")
        if not moved:
            return labels


@dataclass
class Tile:
    """Classes of one group and band: keys, numbers of copies and sorted sets."""

    keys: np.ndarray
    copies: np.ndarray
    sets: list

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.sets], dtype=np.int64)

    def packed(self) -> bytes:
        """Sets of a tile overlap, so each value is stored once and a set is the steps between its values' ranks."""
        values, rank = np.unique(np.concatenate(self.sets), return_inverse=True)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        rank = rank[np.lexsort((rank, owner))]
        steps = np.diff(rank, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T
        head = np.array([len(self.sets), len(values)], dtype=np.int64)
        return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in (head, self.keys, self.copies, self.sizes, values, steps)))

    @classmethod
    def unpacked(cls, raw: bytes) -> Tile:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        n, distinct = np.frombuffer(raw, np.int64, 2)
        keys, copies, sizes, values = np.split(np.frombuffer(raw, np.int64, 3 * n + distinct, 16), np.cumsum([n, n, n]))
        steps = np.frombuffer(raw, np.uint8, offset=16 + 8 * (3 * n + distinct)).reshape(4, -1).T
        rank = np.cumsum(np.ascontiguousarray(steps).view("<i4").ravel(), dtype=np.int64)
        return cls(keys, copies, np.split(values[rank], np.cumsum(sizes)[:-1]))

    def links(self, other: Tile | None) -> list[tuple[int, int, int]]:
        """(key, near, links): link counts and spanning edges within the tile, or with another one."""
        second = other or self
        links = _links(self.sets, second.sets, self.sizes, second.sizes)
        if other is None:
            np.fill_diagonal(links, False)
            keys, counts, square = self.keys, links @ self.copies, links
        else:
            keys = np.concatenate([self.keys, other.keys])
            counts = np.concatenate([links @ other.copies, links.T @ self.copies])
            m = len(self.keys)
            square = np.zeros((len(keys), len(keys)), dtype=bool)
            square[:m, m:], square[m:, :m] = links, links.T
        label = keys.copy()
        while True:
            near = np.minimum(label, np.where(square, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (near == label).all():
                break
            label = near
        at = np.flatnonzero(counts)
        return list(zip(keys[at].tolist(), label[at].tolist(), counts[at].tolist(), strict=True))


def _tiles(pdf: pd.DataFrame) -> pd.DataFrame:
    """The links of groups of one tile; the tiles of larger groups, packed."""
    out: list[tuple] = []
    for (root, number), part in pdf.groupby(["root", "tile"], sort=False):
        part = part.drop_duplicates("key")
        tile = Tile(part["key"].to_numpy(), part["copies"].to_numpy(), part["set"].to_list())
        if part["alone"].iat[0]:
            out += [(*row, None, None, None) for row in tile.links(None)]
        else:
            out.append((None, None, None, root, number, tile.packed()))
    return pd.DataFrame(out, columns=["key", "near", "links", "root", "tile", "packed"], dtype=object)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """(key, near, links) of the tile pairs dealt to one task; a tile that no class fell into has no row."""
    out: list[tuple[int, int, int]] = []
    for (_, one, two), pair in pdf.groupby(["root", "one", "two"], sort=False):
        packed = dict(zip(pair["tile"], pair["packed"], strict=True))
        if one in packed and two in packed:
            out += Tile.unpacked(packed[one]).links(None if one == two else Tile.unpacked(packed[two]))
    return pd.DataFrame(out, columns=["key", "near", "links"], dtype="int64")


def _links(left: list, right: list, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Which pairs have a similarity of PART / WHOLE or more, as a matrix."""
    need_left, need_right = n_left[:, None], n_right[None, :]
    # bitmaps: each bit that only one of the two has stands for a shingle that only it has
    width = 1 << max(6, int(BITS * max(n_left.max(), n_right.max()) - 1).bit_length())
    maps = []
    for sets in (left, right):
        bits = np.zeros((len(sets), width), dtype=bool)
        for row, x in enumerate(sets):
            bits[row, (x.view(np.uint64) >> k.U64(20)) & k.U64(width - 1)] = True
        maps.append(np.packbits(bits, axis=1).view(np.uint64))
    apart = np.empty((len(left), len(right)), dtype=np.int64)
    for row in range(len(left)):
        apart[row] = np.bitwise_count(maps[0][row] ^ maps[1]).sum(axis=1)
    # |A| + |B| - 2 common >= apart
    most = (need_left + need_right - apart) // 2
    may = (WHOLE * np.minimum(most, np.minimum(need_left, need_right)) >= PART * (need_left + need_right - most))
    out = np.zeros_like(may)
    if not may.any():
        return out
    # exact: merge the sorted sets of the tile pair once; a shingle's rank stands for it
    whole = np.concatenate([*left, *right])
    values, rank, times = np.unique(whole, return_inverse=True, return_counts=True)
    useful = np.cumsum(times > 1) - 1
    total = int((times > 1).sum())
    marks = np.where(times[rank] > 1, useful[rank], -1)
    ends = np.cumsum([len(x) for x in left] + [len(x) for x in right])
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    step = max(1, (1 << 23) // len(ends))  # ranks at a time bound the memory
    order = np.argsort(marks, kind="stable")
    cuts = np.searchsorted(marks[order], np.arange(0, total + step, step))
    for block in range(len(cuts) - 1):
        at = order[cuts[block] : cuts[block + 1]]
        dense = np.zeros((len(ends), min(step, total - block * step)), dtype=np.float32)
        dense[owner[at], marks[at] - block * step] = 1
        common += dense[: len(left)] @ dense[len(left) :].T
    common = common.astype(np.int64)
    return may & (WHOLE * common >= PART * (need_left + need_right - common))


def narrowed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, text_hash) of any table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def same_text(left: DataFrame, right: DataFrame):
    """By id and text, so that rows without an id meet only equal texts."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = pa.array([press.compress(x.as_py().encode()) for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), texts], names=["doc_id", "text_hash", "packed"])


def _texts(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, n, copies, set) of the wanted classes (doc_id, text_hash, key, ...), one text each; again for rows that are repeated."""
    packed = narrow.mapInArrow(_pack, "doc_id long, text_hash long, packed binary")
    joined = packed.join(wanted, same_text(packed, wanted)).select("packed", "key", "n", "copies")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = pa.array([unpack.decompress(x.as_py()) for x in batch.column(0)], pa.large_binary())
            asked = batch.column(1).to_numpy(zero_copy_only=False)
            for first, hashes, counts, key in _slices(texts):
                fits = key == asked[first : first + len(key)]  # rows may share a doc_id
                part = pa.RecordBatch.from_arrays([*[c.slice(first, len(key)) for c in batch.columns[1:]], k.lists(hashes.view(np.int64), counts, pa.int64())], names=["key", "n", "copies", "set"])
                yield part.filter(pa.array(fits))

    return joined.mapInArrow(rows, "key long, n long, copies long, set array<long>")


def _linked(members: DataFrame) -> DataFrame:
    """(key, near, links) within groups.  Each class moves once, to its tile; packed tiles go to all pairs with tiles of their band or the next one."""
    band = F.floor(F.log("n") / F.log(F.lit(WHOLE / PART))).cast("long")
    members = members.withColumn("band", band)
    full = F.greatest(F.count(F.lit(1)) / F.lit(TILE), F.sum("n") / F.lit(TILE_HASHES))
    total = members.groupBy("root").agg(full.alias("total"))
    parts = members.groupBy("root", "band").agg(F.ceil(full).alias("parts"))
    number = lambda band, part: band * F.lit(1 << 32) + part
    alone = F.col("total") <= 1
    zero = F.lit(0).cast("long")
    tile = F.when(alone, zero).otherwise(number(F.col("band"), F.pmod(F.xxhash64("key"), "parts")))
    placed = members.join(total, "root").join(parts, ["root", "band"]).select("key", "copies", "root", tile.alias("tile"), alone.alias("alone"), "set")
    size = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("hashes")).first()
    bins = max(1, size.n // TILE, size.hashes // TILE_HASHES)
    # a tile is in one bin whole; a bin has a tile or as many small groups
    binned = placed.withColumn("bin", F.pmod(F.xxhash64("root", "tile"), F.lit(bins)))
    tiles = cut(lambda: binned.groupBy("bin").applyInPandas(_tiles, "key long, near long, links long, root long, tile long, packed binary"))

    def pairs(count, band, low):
        others = F.when(count > 0, F.transform(F.sequence(zero, count - 1), lambda j: number(band, j))).otherwise(F.array().cast("array<long>"))
        own = F.col("tile")
        return F.transform(others, lambda o: F.struct(F.when(F.lit(low) | (own <= o), own).otherwise(o).alias("one"), F.when(F.lit(low) | (own <= o), o).otherwise(own).alias("two")))

    up = parts.select("root", (F.col("band") - 1).alias("band"), F.col("parts").alias("parts_up"))
    down = parts.select("root", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_down"))
    sized = parts.join(up, ["root", "band"], "left").join(down, ["root", "band"], "left")
    large = tiles.where("packed is not null").select("root", F.shiftright("tile", 32).alias("band"), "tile", "packed").join(sized, ["root", "band"])
    same = pairs(F.col("parts"), F.col("band"), False)
    upper = pairs(F.coalesce("parts_up", zero), F.col("band") + 1, True)
    lower = F.transform(pairs(F.coalesce("parts_down", zero), F.col("band") - 1, True), lambda p: F.struct(p["two"].alias("one"), p["one"].alias("two")))
    dealt = large.select("root", "tile", F.explode(F.concat(same, upper, lower)).alias("pair"), "packed").select("root", "tile", "pair.*", "packed")
    tasks = max(1, dealt.drop("packed").count() // 4)
    compared = dealt.withColumn("task", F.pmod(F.xxhash64("root", "one", "two"), F.lit(tasks))).groupBy("task").applyInPandas(_compare, "key long, near long, links long")
    return tiles.where("key is not null").select("key", "near", "links").unionByName(compared)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row; n_links counts linked rows, copies included."""
    narrow = narrowed(docs, id_col, text_col)
    rows = cut(lambda: narrow.mapInArrow(_classes, "doc_id long, text_hash long, n long, key long"))
    # a class without any id is still one text
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    classes = rows.where("n > 0").groupBy("key").agg(first, F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    classes = classes.select("key", F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("text_hash"), "copies", "n")
    hopeful = cut(lambda: _hopeful(narrow, classes).join(classes, "key").select(F.col("least").alias("doc_id"), "text_hash", "key", "n", "copies"))
    members = cut(lambda: _texts(narrow, hopeful))
    edges = cut(lambda: _edges(members))
    groups = components(edges, "key", "leader").join(edges.select("key").distinct(), F.col("node") == F.col("key")).select("key", "root")
    # groups of one class have no one to be compared with
    several = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("root")
    grouped = cut(lambda: members.join(groups.join(several, "root"), "key"))
    linked = cut(lambda: _linked(grouped))
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(linked, "key", "near")
    whole = classes.join(counts, "key", "left").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    component = whole.groupBy("root").agg(F.min("least").alias("component"))
    by_class = whole.join(component, "root").select("key", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(by_class, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with all their columns; of rows that share that id, and of rows without an id, all stay."""
    others = joined(docs, id_col, text_col).where("component_id < doc_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others, docs[id_col].cast("long") == others["_other"], "left_anti")


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
