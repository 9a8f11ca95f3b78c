"""Hierarchical multi-length packing of documents into sequences of at most 2048 tokens.

Each document is tokenized and ended by one token.  Its whole 2048-token windows become sequences of their
own; what is left over is routed to the shortest context tier (256, 512, 1024, 2048) that holds it.  Each tier,
from the longest to the shortest, is packed into sequences of its own length: a sequence opens with the
longest piece of its tier, its gap is filled with the longest pieces of this or a shorter tier that fit, and, as
pieces may be cut, the last of the gap takes the head of a short piece.  So every sequence is a full power of two,
but for one padded sequence of each input split with what is left.
All sequences, those of long documents too, are dealt in turns over step groups, tier by tier, so that the groups
of one deal differ by at most one sequence in each tier, and short and long pieces are spread.

Spark partitions the work by input split: each task packs its own texts in batches of bounded size and
carries only the pieces (doc_id, start, length, CRC) of its unfinished sequences.

Defined results: a null or empty text is one token, the end; repeated rows are packed each by itself; an
empty table gives an empty result; further columns are ignored; texts of any length are cut at windows.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of one step group, about.
STEP_TOKENS = 64 * LENGTH
#: Left-over pieces and whole windows that a task packs and deals at a time.
POOL = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: how byte-level BPE files of this kind split a text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBE = "A probe: it's 12,345 tokens -- naïve café,\n\n\tЖук  日本語 🙂 don't!!! x = y|z;  end \r\n"


#: Characters of a run of blanks that the pattern above is spared.
LONG_BLANKS = 10_000
_BLANKS = re.compile(rf"\s{{{LONG_BLANKS}}}")


def _byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a BPE file of `tokenizers`.

    For plain byte-level BPE files whose ids follow their merges, tiktoken applies the same vocabulary several
    times faster; it is used if the file's settings are just these and it agrees on a probe, and never for
    texts that hold a special token.  Its pattern backtracks over runs of blanks, and gives up on very long ones: such
    texts go to `tokenizers` too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._same_in_tiktoken()

    def _same_in_tiktoken(self):
        import tiktoken

        settings = json.loads(self.tokenizer.to_str())
        model, before = settings["model"], settings["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        merged = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model.get("merges", [])]
        if not plain or not split or settings["normalizer"] or merged != sorted(merged):
            return None
        names, ranks = _byte_names(), {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token not in self.special:
                if not all(c in names for c in token):
                    return None
                ranks[bytes(names[c] for c in token)] = i
        if len(ranks) < 256 or any(bytes([x]) not in ranks for x in range(256)):
            return None
        fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return fast if list(fast(_PROBE)) == self._slow(_PROBE) else None

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        slow = self.fast is None or any(x in text for x in self.special) or len(text) > LONG_BLANKS and _BLANKS.search(text)
        try:
            found = (self._slow if slow else self.fast)(text)
        except BaseException as e:  # a panic of its library is no Exception
            if slow or type(e).__name__ != "PanicException":
                raise
            found = self._slow(text)
        ids = array("I", found)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def tier_of(length: int) -> int:
    """The shortest tier that holds a piece."""
    return next(i for i, x in enumerate(TIERS) if length <= x)


def pack(pieces: list[tuple], final: bool) -> tuple[list[tuple], list[tuple]]:
    """(tier, pieces) of full sequences from pieces of (length, key), and what is left; if final, a last shorter sequence.

    Returned pieces are (key, from, length): `from` counts from the piece's start.
    """
    tiers: list[list] = [[] for _ in TIERS]
    for length, key in sorted(pieces, key=lambda x: x[0]):
        tiers[tier_of(length)].append((length, key, 0))
    tokens = [sum(x[0] for x in t) for t in tiers]
    done = []

    def take(t: int, at: int, most: int) -> tuple:
        """Up to `most` tokens of a piece; its rest goes to the tier of its length."""
        length, key, start = tiers[t].pop(at)
        tokens[t] -= length
        if length > most:
            rest = tier_of(length - most)
            bisect.insort(tiers[rest], (length - most, key, start + most), key=lambda x: x[0])
            tokens[rest] += length - most
        return key, start, min(length, most)

    for tier in range(len(TIERS) - 1, -1, -1):
        while tiers[tier] and sum(tokens[: tier + 1]) >= TIERS[tier]:
            gap, window = TIERS[tier], []
            while gap:
                fits = [(t, bisect.bisect_right(tiers[t], gap, key=lambda x: x[0]) - 1) for t in range(min(tier, tier_of(gap)), -1, -1)]
                t, at = next(((t, at) for t, at in fits if at >= 0), (None, 0))
                if t is None:  # only longer pieces are left: the shortest is cut
                    t = next(t for t in range(tier + 1) if tiers[t])
                window.append(take(t, at, gap))
                gap -= window[-1][2]
            done.append((tier, window))
    left = [x for t in tiers for x in t]
    if final and left:
        done.append((tier_of(sum(x[0] for x in left)), [(key, at, length) for length, key, at in left]))
        left = []
    return done, [(length, (key, at)) for length, key, at in left]


def deal(sequences: list[tuple]) -> list[list[tuple]]:
    """(tier, pieces) dealt over step groups: tier by tier, those of most pieces first, each tier going on where the last one ended."""
    groups: list[list] = [[] for _ in range(max(1, round(sum(TIERS[t] for t, _ in sequences) / STEP_TOKENS)))]
    for i, x in enumerate(sorted(sequences, key=lambda x: (-x[0], -len(x[1])))):
        groups[i % len(groups)].append(x)
    return groups


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _packer(path: str | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path or default_tokenizer())
        end = np.array([END_ID], dtype="<u4").tobytes()
        base, sequence, group = None, 0, 0
        out: list[tuple] = []
        pool: list[tuple] = []  # (length, (doc_id, start, ids, doc_tokens))
        whole_windows: list[tuple] = []

        def settle(final: bool) -> None:
            nonlocal pool, sequence, group
            packed, left = pack([(x[0], i) for i, x in enumerate(pool)], final)

            def piece(i: int, at: int, n: int) -> tuple:
                doc_id, start, ids, total = pool[i][1]
                return doc_id, start + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total

            every = whole_windows + [(tier, [piece(*x) for x in window]) for tier, window in packed]
            whole_windows.clear()
            for dealt in deal(every) if every else []:
                for tier, window in dealt:
                    at = 0
                    for doc_id, start, length, crc, total in window:
                        out.append((doc_id, start, length, crc, total, base + sequence, at, TIERS[tier], base + group))
                        at += length
                    sequence += 1
                group += 1
            rest = []
            for n, (i, at) in left:
                doc_id, start, ids, total = pool[i][1]
                rest.append((n, (doc_id, start + at, ids[4 * at : 4 * (at + n)], total)))
            pool = rest

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(9)]
            out.clear()
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                base = part << 40 if base is None else base
                ids = encoder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                whole = total - total % LENGTH
                for at in range(0, whole, LENGTH):
                    whole_windows.append((len(TIERS) - 1, [(doc_id, at, LENGTH, zlib.crc32(ids[4 * at : 4 * (at + LENGTH)]), total)]))
                if whole < total:
                    pool.append((total - whole, (doc_id, whole, ids[4 * whole :], total)))
                if len(pool) + len(whole_windows) >= POOL:
                    settle(False)
                if len(out) >= 50_000:
                    yield flush()
        if base is not None:
            settle(True)
        yield flush()

    return rows


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: where it comes from, the CRC-32 of its ids, and where it stands.

    `tokenizer`: a path on every executor; None for the public byte-level BPE.  sequence_id is the input
    split's number << 40 plus a running number in it, and so is step_group; tier is the length of the sequence, or of
    the tier that holds a padded one.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return narrow.mapInArrow(_packer(tokenizer), SCHEMA)


def op6_hierarchical_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
