"""Scores of op1 and op2 against plain computations, and columns whose names clash with the operators' own."""

import math
import random
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weftline.llm import decontaminate, llr_quality, toxicity


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def pair_hash(a, b):
    return xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))


def test_llr_score_and_verdict(spark):
    rng = random.Random(5)
    ratio = [round(rng.uniform(-0.5, 0.3), 3) for _ in range(llr_quality.BUCKETS)]
    words = ["the", "é", "of", "Zu", "x1", "über", "a"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(40)))) for i in range(80)] + [(90, None), (91, " \n"), (92, "one")]
    got = {r.doc_id: r for r in llr_quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), ratio).collect()}
    for i, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
        h = [word_hash(x) for x in w]
        grams = h + [pair_hash(a, b) for a, b in zip(h, h[1:])]
        score = sum(ratio[signed(g) % llr_quality.BUCKETS] for g in grams) / len(grams) if grams else 0.0
        assert math.isclose(got[i].score, score, abs_tol=1e-9)
        windows = {}
        for j in range(len(w) - 4):
            windows.setdefault(tuple(w[j : j + 5]), []).append(j)
        repeated = {j + d for at in windows.values() if len(at) > 1 for j in at for d in range(5)}
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed) == (len(w), len(repeated), failed)
        assert got[i].kept == (not failed and got[i].score >= llr_quality.THRESHOLD)


def test_severity(spark):
    index = {"vile": 0, "vile*": 1, "junk": 2, "rott*": 3}
    model = toxicity.Model(index, np.array([1.5, 0.4, -0.3, 0.9]), np.array([1.0, 2.0, 3.5]))
    rows = [(1, "Vile VILE things, vileness"), (2, "junk"), (3, None), (4, ""), (5, "rotten rotter vile " * 50), (6, "vile1 x-vile")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        x, hits = 0.0, 0
        counts = dict.fromkeys(index, 0)
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            found = [k for k in index if word == k or k.endswith("*") and len(word) > len(k) - 1 and word.startswith(k[:-1])]
            hits += bool(found)
            for k in found:
                counts[k] += 1
        x = sum(model.weights[index[k]] * math.log1p(n) for k, n in counts.items() if n)
        severity = sum(1 / (1 + math.exp(t - x)) for t in model.thresholds)
        assert math.isclose(got[i].severity, severity, abs_tol=1e-9) and got[i].n_hits == hits and got[i].rejected == (severity >= toxicity.REJECT_AT)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words that are here and there again and again for all", "x", 2)], "doc_id long, text string, score string, n_words int")
    docs = docs.withColumn("_h", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("hash", F.lit(3)).withColumn("item_id", F.lit(9))
    assert llr_quality.judge(docs, [0.0] * llr_quality.BUCKETS).first().n_words == 12
    items = spark.createDataFrame([(7, "words that are here and there", "y")], "item_id long, text string, doc_id string")
    assert decontaminate.without_leaks(docs, items).columns == docs.columns
