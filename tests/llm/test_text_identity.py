"""Rows that share an id or have none: their texts keep them apart."""

import random

from weftline.llm import substring_dedup, suffix_dedup

WORDS = [f"word{i}" for i in range(5000)]


def text(seed, n=60):
    return " ".join(random.Random(seed).sample(WORDS, n))


def test_texts_without_id_are_known_by_all_their_bits(spark):
    """Two texts whose hashes agree in their low 20 bits: what repeats in one must not be cut out of the other."""
    # n * n / 2**21 pairs of 3,000 texts agree in 20 bits
    texts = [text(i, 40) for i in range(3000)]
    low = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) & 1048575 AS low").groupBy("low").agg({"t": "collect_list"}).where("size(`collect_list(t)`) > 1").first()[1]
    a, b = low[:2]
    docs = spark.createDataFrame([(None, a), (None, b), (1, a)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == {(None, len(a), len(a)), (None, len(b), 0), (1, len(a), len(a))}
    same_id = spark.createDataFrame([(5, a), (5, b), (1, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(same_id).collect()) == [(1, len(a)), (5, 0), (5, len(a))]
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.repeated_spans(same_id).collect()) == [(1, 0), (5, 0), (5, 40)]


def test_own_columns_do_not_clash(spark):
    t = text(1)
    docs = spark.createDataFrame([(1, t, 0, "x", "y", "z", "w"), (2, "head " + t, 0, "x", "y", "z", "w"), (3, None, 0, "x", "y", "z", "w")], "doc_id long, text string, n_chars int, own string, kept string, text_key string, _id string")
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert out[1].text == "" and out[2].text == "head " and out[2].n_chars == 5 and out[3].text is None and (out[2].own, out[2].kept, out[2].text_key, out[2]._id) == ("x", "y", "z", "w")
