"""Periodic runs against a plain search of every period at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from weftline.llm import periodic_runs as p


def plain(words, least, times):
    found = set()
    n = len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(all(words[x] == words[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda x: (x[0], x[2]))


def some_texts(rng):
    texts = []
    for _ in range(30):
        words = [rng.choice("ab" if rng.random() < 0.5 else "abcde") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            block = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (block * 12)[: rng.randrange(1, 60)]
        texts.append([w.encode() for w in words])
    return texts


def test_runs_as_by_plain_search():
    rng = random.Random(3)
    for least, times in ((24, 3), (6, 3), (4, 2), (9, 4)):
        for _ in range(6):
            texts = some_texts(rng)
            assert p.runs_of(texts, least, times) == [plain(x, least, times) for x in texts]


def test_one_word_many_times_and_listing_in_parts(monkeypatch):
    monkeypatch.setattr(p, "LISTED", 50)
    texts = [[b"a"] * 3000, [], [b"x", b"y"] * 700 + [b"x"] + [b"q"] * 24, [b"a"] * 23]
    assert p.runs_of(texts) == [[(0, 3000, 1)], [], [(0, 1401, 2), (1401, 24, 1)], []]


def test_best_run_and_what_is_kept(spark):
    text = "a b a b a b a b a b a b a b a b a b a b a b a b z z z z z z z z z z z z z z z z z z z z z z z z end"
    words = text.encode().split()
    runs = p.runs_of([words])[0]
    assert runs == [(0, 24, 2), (24, 24, 1)] and p.collapsed(words, runs) == b"a b z end" and p.collapsed([], []) == b""
    row = p.digested(p.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli, row.n_words) == (2, 24, 24, 1, 24000, 49)
    assert row.runs_sha256 == hashlib.sha256(b"0,24,2\n24,24,1\n").hexdigest() and row.collapsed_sha256 == hashlib.sha256(b"a b z end").hexdigest()


def summary(words, runs):
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    dropped = {i for at, length, q in runs for i in range(at + q, at + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words)


def test_stretched_words():
    words = [str(i).encode() for i in range(50)]
    i = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    g = zlib.crc32(str(i).encode()) // 10
    a = g % 50
    period = 1 + (50 - a) // (3 + g % 8)
    assert p.stretched(words, i) == words[:a] + [words[a + (j - a) % period] for j in range(a, 50)]
    other = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    assert p.stretched(words, other) is words and p.stretched([], i) == [] and p.stretched(words, None) is words


def test_frames_with_nulls_ties_long_texts_and_other_columns(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "é"]) for _ in range(rng.randrange(80))), "x") for i in range(60)]
    rows += [(None, "w\t" * 40, None), (7, None, None), (8, "", "y"), (9, " \n ", "y"), (3, rows[3][1], "x"), (-5, "u v w " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = p.digested(p.periodic_runs(docs, stretch=True)).collect()
    want = []
    for i, text, _ in rows:
        words = p.stretched((text or "").encode().split(), i)
        runs = [(0, 90000, 3)] if i == -5 else plain(words, 24, 3)
        want.append((i, *summary(words, runs)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = p.digested(p.periodic_runs(docs.where(F.lit(False))))
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "n_runs"]

