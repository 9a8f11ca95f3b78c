"""Packing of very long runs of blanks, which the fast encoder's pattern gives up on."""

import zlib

import numpy as np
import pytest

from weftline.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


def test_same_ids_as_the_tokenizer(encoder):
    for text in (" " * 1_000_000, "\n" * 1_000_000, " \n" * 500_000, "word" + " \t" * 300_000 + "word", "x" + " " * 9_999 + "y", " " * 400_000):
        assert encoder.encode(text) == np.array(encoder._slow(text), dtype="<u4").tobytes()


def test_a_panic_of_the_fast_encoder_is_answered_by_the_slow_one(encoder, monkeypatch):
    monkeypatch.setattr(packing, "LONG_BLANKS", 10**9)
    text = " " * 1_000_000
    assert encoder.encode(text) == np.array(encoder._slow(text), dtype="<u4").tobytes()
    assert encoder.encode("still there") == np.array(encoder._slow("still there"), dtype="<u4").tobytes()


def test_packed_whole(spark, encoder):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a b")], "doc_id long, text string")
    rows = packing.packed(docs).where("doc_id = 1").orderBy("start").collect()
    ids = encoder.encode(" " * 1_000_000) + np.array([packing.END_ID], dtype="<u4").tobytes()
    assert sum(r.length for r in rows) == len(ids) // 4 == rows[0].doc_tokens
    assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in rows)
