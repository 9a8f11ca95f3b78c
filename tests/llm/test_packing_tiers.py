"""Tiers, filled gaps and balanced step groups; the fast encoder against the file's own."""

import collections
import random

import pytest

from weftline.llm import packing

DATA = "/root/testdata/sf0.01"


def test_every_tier_is_packed_full():
    rng = random.Random(2)
    pieces = [(rng.randint(1, 2047 if i % 9 == 0 else 900 if i % 3 == 0 else 300), i) for i in range(3000)]
    done, left = packing.pack(pieces, True)
    assert left == []
    sizes = collections.Counter((t, sum(x[2] for x in w)) for t, w in done)
    full = {x for x in sizes if x[1] == packing.TIERS[x[0]]}
    assert {packing.TIERS[t] for t, _ in full} == set(packing.TIERS) and sum(n for x, n in sizes.items() if x not in full) <= 1
    used = collections.defaultdict(list)
    for _, w in done:
        for key, at, n in w:
            used[key].append((at, n))
    for length, key in pieces:  # each token once
        at = 0
        for start, n in sorted(used[key]):
            assert start == at
            at += n
        assert at == length
    # long sequences are filled from shorter tiers
    assert any(t == 3 and len(w) > 1 and min(x[2] for x in w) <= 256 for t, w in done)
    # a tail that is not yet full is carried
    done, left = packing.pack([(100, 0), (30, 1)], False)
    assert done == [] and sorted(x[0] for x in left) == [30, 100]


def test_step_groups_are_balanced():
    rng = random.Random(4)
    sequences = [(t, [0] * rng.randint(1, 9)) for t in (3,) * 700 + (2,) * 90 + (1,) * 33 + (0,) * 50]
    groups = packing.deal(sequences)
    tokens = [sum(packing.TIERS[t] for t, _ in g) for g in groups]
    pieces = [sum(len(w) for _, w in g) for g in groups]
    assert len(groups) == 12 and max(tokens) - min(tokens) <= sum(packing.TIERS) and max(pieces) - min(pieces) <= 40
    assert sorted(map(repr, sequences)) == sorted(repr(x) for g in groups for x in g)


def test_fast_encoder_gives_the_files_ids():
    pq = pytest.importorskip("pyarrow.parquet")
    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.fast is not None
    for text in pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist():
        assert list(encoder.fast(text or "")) == encoder._slow(text or "")
