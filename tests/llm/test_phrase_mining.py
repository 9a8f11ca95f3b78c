"""Phrases against a plain count of all; test_sql compares them with DuckDB."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import phrase_mining as p


def plain(rows, least, most):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for n in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        for x, a in f.items():
            if len(x) < 2 or a < least:
                continue
            score, _, left, right = min((2000000 * a // (f[x[:k]] + f[x[k:]]), k, f[x[:k]], f[x[k:]]) for k in range(1, len(x)))
            longer = [b for y, b in f.items() if len(y) > len(x) and b >= least and any(y[i : i + len(x)] == x for i in range(len(y)))]
            if not any(100 * b >= 80 * a for b in longer):
                scored.append((-score, -a, " ".join(x).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def some_rows(rng):
    words = ["Der", "die", "das", "of", "THE", "é", "É", "x1", "q", "zu"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\v", " - "]) for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice(["", "new york city hall "]) * rng.randrange(3) + text, rng.choice(["en", "de", None, ""])))
    return rows + [(None, None, "en"), (7, "", "fr"), (7, "a b " * 50_000, "long"), (8, "only one", "few"), *rows[:20]]


def test_as_by_counting_everything(spark):
    rng = random.Random(6)
    for least, most in ((5, 50), (30, 2000)):
        rows = some_rows(rng)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit("own")).withColumn("phrase", F.lit(1))
        got = p.collocations(docs.repartition(5), least=least, most=most)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain(rows, least, most)


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    """With few bits nearly all are set: then everything is counted, and the result is the same."""
    monkeypatch.setattr(p, "BITS", 7)
    monkeypatch.setattr(p, "PART", 999)
    rows = some_rows(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, p.collocations(docs, least=5, most=40).collect())) == plain(rows, 5, 40)


def test_empty_and_without_words(spark):
    docs = spark.createDataFrame([(1, " .,", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert p.collocations(docs).count() == 0 and p.collocations(docs.where(F.lit(False))).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts near 2**62, given instead of counted."""
    big = 1 << 62
    counts = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 3)], "lang string, words int, phrase string, n long")
    monkeypatch.setattr(p, "phrase_counts", lambda *a: counts)
    assert [tuple(x) for x in p.collocations(counts).collect()] == [("en", 1, "a b", big - 3, big, big - 1, big, 2000000 * (big - 3) // (2 * big - 1))]

