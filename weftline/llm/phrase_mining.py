"""Phrase collocations by SON partitioning: shards mined at a lowered support, then all candidates counted exactly.

Documents are dealt into SHARDS shares by a hash of their id.  A phrase with `least` occurrences has ceil(least / SHARDS)
or more in one of them at least, so each share is mined completely at that local support, level by level: words
and pairs first, then phrases of three and four words all of whose pairs are frequent.  A share is not a
task: its occurrences are counted over a shuffle whose keys are 64-bit hashes that name phrase, language and share, so
a share may be of any size.  Keys travel as sorted blocks with their counts, dealt by ranges of the hash; the number of
ranges follows the size of the texts.

The shares' counts of a phrase lie side by side, so the union of what is locally frequent is counted over all shares
there, by hash.  What is left is kept as a bitmap of 2 ** BITS bits, of the same size whatever the input: a bit may be set
by another phrase too, which only lets a phrase be counted that need not be, and none is ever missed.  The last pass counts every occurrence of the candidates by their words themselves, not by hashes, in one aggregate, so the
counts are exact.  Scores, the test against longer phrases and ranks come from these counts in SQL functions.

Defined results: a null text has no words; a null language is `und`; languages without a candidate give no rows;
repeated rows count each; rows without an id are in one share; an empty table gives an empty result; texts of any
length are read whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import kernels as k
from weftline.llm.runtime import cut

LEAST = 30
LONGEST = 4
MOST = 2000
#: A longer phrase hides one in it if it has so many hundredths of its occurrences.
HIDDEN = 80
SHARDS = 8
BITS = 26
#: Bytes of text that are mined at a time in a task.
SLICE = 1_000_000
#: Keys that a task merges before it hands them on.
KEYS = 2_000_000
#: Bytes of text whose keys are merged together.
PART = 8_000_000
#: Candidates that a task adds up before it hands them on.
NAMED = 100_000
#: Shares of a language's ranking before its last one.
RANKERS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Phrases:
    """The words of a slice of texts, and the hashes of phrases that stay within a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salts: np.ndarray, shards: np.ndarray):
        self.data = _LOWER[data]
        inside = ~_GAP[data]
        filled = offsets[:-1] < offsets[1:]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        at = offsets[:-1][filled]
        begins[at] = inside[at]
        at = offsets[1:][filled] - 1
        ends[at] = inside[at]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        breaks = np.cumsum(_BREAK[data])
        self.piece = breaks[self.start] + self.text if len(self.start) else self.text
        values = k.byte_rolling(self.data).of(self.start, self.end)
        self.rolling = k.Rolling(k.mix(values ^ salts[self.text]))
        self.shard = shards[self.text]

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, whether it stays in a piece) of the phrases of n words from each word on; a key's low bits are its share."""
        hashes = self.rolling.grams(n)
        m = len(hashes)
        return (hashes & ~k.U64(SHARDS - 1)) | self.shard[:m], self.piece[n - 1 :][:m] == self.piece[:m]


def _bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each key, the same for all shares of a phrase."""
    return keys >> k.U64(64 - bits)


def _held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of keys are set in a table of 64-bit words."""
    bits = _bits(keys, 5 + len(table).bit_length())
    return (table[bits >> k.U64(6)] >> (bits & k.U64(63)) & k.U64(1)).astype(bool)


def _frequent(phrases: Phrases, pairs: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, whether all pairs are held) of the phrases of 2 to `longest` words."""
    keys, stays = phrases.of(2)
    held = stays & _held(pairs, keys)
    out = [(keys, held)]
    for n in range(3, longest + 1):
        keys, stays = phrases.of(n)
        m = len(keys)
        for i in range(n - 1):
            stays = stays & held[i : i + m]
        out.append((keys, stays))
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Phrases]]:
    """(first text, number of texts, phrases) of the slices of a batch of (text, lang, shard)."""
    salts: dict[str, int] = {}
    for lang in set(batch.column(1).to_pylist()):
        salts[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
    salt = np.array([salts[x] for x in batch.column(1).to_pylist()], dtype=np.uint64)
    shard = batch.column(2).to_numpy().astype(np.uint64)
    for first, data, offsets in k.slices(batch.column(0), SLICE):
        n = len(offsets) - 1
        yield first, n, Phrases(data, offsets, salt[first : first + n], shard[first : first + n])


def _short(phrases: Phrases) -> list[np.ndarray]:
    """The keys of words and pairs."""
    pairs, stays = phrases.of(2)
    return [phrases.of(1)[0], pairs[stays]]


def _long(pairs: Broadcast, longest: int):
    return lambda phrases: [keys[held] for keys, held in _frequent(phrases, pairs.value, longest)[1:]]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key = np.concatenate(keys)
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first], np.add.reduceat(np.concatenate(counts)[by], first) if len(first) else np.zeros(0, np.int64)


def _blocks(keys_of, parts: int, bits: int):
    """(part, keys, n): sorted distinct keys with their counts as blocks, a part being a range of bits."""

    def block(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = _bits(key, bits) * k.U64(parts) >> k.U64(bits)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True)) if len(first) else []
        columns = [pa.array(part[first].astype(np.int64)), pa.array([key[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in cuts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for _, _, phrases in _slices(batch):
                key, n = np.unique(np.concatenate(keys_of(phrases)), return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) >= KEYS:
                    yield block(*_merged(keys, counts))
                    keys, counts = [], []
        if keys:
            yield block(*_merged(keys, counts))

    return rows


def _frequent_bits(support: int, least: int, bits: int):
    """The words of the bitmap, as blocks, that the phrases of a part set: frequent in a share, and in all shares together."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = lambda column, kind: [np.frombuffer(x, dtype=kind) for x in pdf[column]]
        keys, total = _merged(blocks("keys", np.uint64), [x.astype(np.int64) for x in blocks("n", np.uint32)])
        # the shares of a phrase are neighbours: its candidates are counted over all of them
        phrase = keys >> k.U64(3)
        first = np.flatnonzero(np.concatenate([[True], phrase[1:] != phrase[:-1]])[: len(phrase)])
        candidate = np.maximum.reduceat(total, first) >= support
        keys = keys[first][candidate & (np.add.reduceat(total, first) >= least)]
        bit = np.unique(_bits(keys, bits))
        if not len(bit):
            return pd.DataFrame({"at": [], "mask": []})
        words = bit >> k.U64(6)
        new = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        mask = np.bitwise_or.reduceat(k.U64(1) << (bit & k.U64(63)), new)
        return pd.DataFrame({"at": [words[new].astype(np.uint32).tobytes()], "mask": [mask.tobytes()]})

    return work


class _Named:
    """(lang, words, phrase, n) of candidates, added up over the slices of a task."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.columns: tuple[list, ...] = ([], [], [], [])

    def add(self, key: int, n: int, row) -> None:
        at = self.at.get(key)
        if at is None:
            self.at[key] = len(self.at)
            for column, value in zip(self.columns, (*row(), n), strict=True):
                column.append(value)
        else:
            self.columns[3][at] += n

    def taken(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, kinds, strict=True)], names=["lang", "words", "phrase", "n"])
        self.__init__()
        return out


def _named(short: Broadcast, long: Broadcast, longest: int):
    """(lang, words, phrase, n) of each candidate; words 0: how many words the texts have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = _Named()
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts, phrases in _slices(batch):
                raw, text = phrases.data.tobytes(), phrases.text
                for i, n in enumerate(np.bincount(text, minlength=texts).tolist()):
                    lang = langs[first + i]
                    named.add(lang, n, lambda: (lang, 0, b""))  # noqa: B023  called at once
                single = phrases.of(1)[0]
                found = [(single, _held(short.value, single)), *_frequent(phrases, short.value, longest)]
                for n, (keys, held) in enumerate(found, 1):
                    at = np.flatnonzero(held)
                    if n > 2:
                        at = at[_held(long.value, keys[at])]
                    # one share or another: a phrase is one row
                    key, once, times = np.unique(keys[at] | k.U64(SHARDS - 1), return_index=True, return_counts=True)
                    for key, i, count in zip(key.tolist(), at[once].tolist(), times.tolist(), strict=True):
                        named.add(key, count, lambda: (langs[first + text[i]], n, b" ".join(raw[phrases.start[i] : phrases.end[i + n - 1]].split())))  # noqa: B023
                if len(named.at) >= NAMED:
                    yield named.taken()
        yield named.taken()

    return rows


def _bitmap(texts: DataFrame, keys_of, least: int, parts: int) -> Broadcast:
    """The bits of phrases that may have `least` occurrences; at most 2 ** (BITS - 6) words of it come to the driver, in blocks."""
    blocks = texts.mapInArrow(_blocks(keys_of, parts, BITS), "part long, keys binary, n binary")
    words = blocks.groupBy("part").applyInPandas(_frequent_bits(-(-least // SHARDS), least, BITS), "at binary, mask binary").toArrow()
    table = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    # two parts may meet in one word
    for at, mask in zip(words["at"].to_pylist(), words["mask"].to_pylist(), strict=True):
        table[np.frombuffer(at, dtype=np.uint32)] |= np.frombuffer(mask, dtype=np.uint64)
    return texts.sparkSession.sparkContext.broadcast(table)


def phrase_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, n): every phrase of up to `longest` words with `least` occurrences or more; words 0: all words of the language."""
    texts = docs.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SHARDS)).alias("shard"),
    )
    # a part's keys are merged at once: their number is bounded by the text that they come from
    parts = max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART))
    short = _bitmap(texts, _short, least, parts)
    long = _bitmap(texts, _long(short, longest), least, parts)
    named = texts.mapInArrow(_named(short, long, longest), "lang string, words int, phrase binary, n long")
    counts = named.groupBy("lang", "words", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of each language."""
    found = cut(lambda: phrase_counts(docs, id_col, text_col, lang_col, least, longest))
    total = found.where("words = 0").select("lang", "n")
    part = lambda name: found.where("words > 0").select(F.col("lang"), F.col("phrase").alias(f"{name}_part"), F.col("n").alias(name))
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("l_part"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("r_part"))
    cuts = cuts.join(part("l"), ["lang", "l_part"]).join(part("r"), ["lang", "r_part"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    # a longer candidate speaks for each phrase in it; only the most frequent one decides
    inner = candidates.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = inner.select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    hidden = F.expr(f"coalesce(cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {HIDDEN}, false)")
    kept = best.join(longer, ["lang", "phrase"], "left").where(~hidden)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language is ranked in shares first, so that its last ranking is of a bounded number of rows
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS)))
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN (SELECT unnest(range(1, {LONGEST + 1})) AS k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, (2000000 * u.a) // (x.f + y.f) AS score FROM u
JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, w, k, unnest(range(2, k)) AS size FROM c WHERE k > 2),
j AS (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS pos FROM i),
h AS (SELECT lang, array_to_string(w[pos:pos + size - 1], ' ') AS phrase, max(a) AS longer FROM j GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {HIDDEN} * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= {MOST}"""
