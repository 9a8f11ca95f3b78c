"""Newest rows, replay windows, bounded memories and followed tables."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from weftline.operators import replay
from weftline.streaming import changes, recent

NOW = dt.datetime(2026, 9, 9, 12)


def test_newest_reads_texts_of_few_rows(spark, tmp_path):
    rows = [(i, NOW - dt.timedelta(days=i % 200, minutes=i), f"text {i}") for i in range(3000)]
    spark.createDataFrame(rows, "id long, ts timestamp_ntz, text string").write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    for where, limit in (("true", 20), ("id % 200 = 150", 10), ("id % 200 >= 199", 400), ("id < 0", 5)):
        kept = df.where(where)
        want = sorted(kept.collect(), key=lambda r: (r.ts, r.id), reverse=True)[:limit]
        assert replay.newest(kept, limit, NOW).collect() == want
    plan = replay.newest(df, 20, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_narrowed_as_round_by_round(spark):
    def plain(ages, minutes, limit):
        over, first = None, minutes
        for i in range(100):
            total = sum(a <= minutes * 60 for a in ages)
            if over and not total:
                return over
            over = (minutes, total, minutes < first, total > limit)
            if total <= limit or i >= 4 or minutes <= 1:
                return over
            minutes = max(1, math.floor(minutes * limit / total * 0.8))

    rng = random.Random(3)
    cases = [[rng.randrange(200_000) for _ in range(900)], [rng.randrange(600) for _ in range(900)], [50_000] * 700, [], [30] * 900, [int(rng.expovariate(1 / 3000)) for _ in range(2000)]]
    for ages in cases:
        df = spark.createDataFrame([(NOW - dt.timedelta(seconds=a),) for a in ages], "ts timestamp_ntz")
        got = replay.narrowed(df, F.lit(NOW).cast("timestamp_ntz"), 3000, 120).first()
        assert tuple(got) == plain(ages, 3000, 120), ages[:5]


def test_memory_of_keys(spark, tmp_path):
    rng = random.Random(1)
    source, batches = tmp_path / "in", []
    for n in range(6):
        rows = [(v, f"k{rng.randrange(7000) if rng.random() < 0.6 else n * 3000 + i}", n * 10_000 + i) for v in ("a", "b") for i in range(2000)]
        batches.append(rows)
        spark.createDataFrame(rows, "viewer string, key string, at long").coalesce(1).write.parquet(str(source / f"n={n}"))
    want = []
    for v in ("a", "b"):
        known = []
        held = set()
        for rows in batches:
            for viewer, key, at in rows:
                if viewer == v and key not in held:
                    known.append(key)
                    held.add(key)
                    want.append((v, key, at))
                    if len(known) > 5000:
                        known = known[-4000:]
                        held = set(known)
    stream = spark.readStream.schema("viewer string, key string, at long").option("maxFilesPerTrigger", 1).parquet(*[str(source / "*")])
    q = recent.unseen(stream, "viewer", "key", ["at"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("viewer", "key", "at").collect()]
    assert len(want) > 12_000 and len(got) == len(set(got)) and sorted(got) == sorted(want)


def test_a_followed_table(spark, tmp_path):
    source, folder = str(tmp_path / "src"), str(tmp_path / "copy")
    t0 = dt.datetime(2026, 9, 9)

    def write(rows):
        spark.createDataFrame([(i, t0 + dt.timedelta(milliseconds=ms), text) for i, ms, text in rows], "id string, updated timestamp_ntz, text string").write.mode("append").parquet(source)

    def now():
        return sorted((r.id, r.text) for r in changes.copy(spark, folder).collect())

    pull = lambda: changes.pull(spark.read.parquet(source), folder)
    write([("a", 1000, "1"), ("b", 5000, "1"), ("c", 5000, "1")])
    assert pull() == 3 and pull() == 0
    at = changes.cursor(spark, folder)
    assert (at.stamp, at.id) == (t0 + dt.timedelta(seconds=5), "c")
    # an equal stamp with a smaller id, and one written late, are within the overlap; the cursor stays
    write([("aa", 5000, "1"), ("late", 3500, "1")])
    assert pull() == 2
    at = changes.cursor(spark, folder)
    assert (at.stamp, at.id) == (t0 + dt.timedelta(seconds=5), "c")
    write([("a", 9000, "2"), (None, 9500, "x"), ("too late", 2000, "1")])
    assert pull() == 1
    assert now() == [("a", "2"), ("aa", "1"), ("b", "1"), ("c", "1"), ("late", "1")]
    # a pull that broke off before its cursor is written over
    spark.createDataFrame([("zz", t0, "?")], "id string, updated timestamp_ntz, text string").write.parquet(f"{folder}/rows/batch={changes.cursor(spark, folder).batch + 1}")
    assert ("zz", "?") not in now()
    write([("d", 9100, "1")])
    q = changes.follow(spark, lambda: spark.read.parquet(source), folder, str(tmp_path / "cp"), 1).start()
    deadline = dt.datetime.now() + dt.timedelta(seconds=90)
    while ("d", "1") not in now() and dt.datetime.now() < deadline:
        q.awaitTermination(1)
    q.stop()
    assert ("d", "1") in now() and ("zz", "?") not in now()


def test_digests_are_counted(spark):
    from pyspark.sql import Observation

    from weftline.operators import digests

    rows = spark.createDataFrame([("a", 5, "ok"), ("b", 6, "ok"), ("c", 7, "bad"), ("d", 8, "raise"), ("e", 9, "ok")], "session string, event_count long, prompt string")
    cache = spark.createDataFrame([("a", 5), ("b", 4)], "session string, event_count long")
    attempts = spark.createDataFrame([("e", 9, 3), ("c", 7, 2), ("b", 4, 3)], "session string, event_count long, attempts long")

    def model(prompt):
        if prompt == "raise":
            raise RuntimeError
        return 'well: {"x": 1} ...' if prompt == "ok" else "no object"

    told = Observation("told")
    got = {r.session: (r.outcome, r.digest, r.attempts) for r in digests.digested(rows, cache, attempts, model, told).collect()}
    assert got == {"a": ("reused", None, 0), "b": ("digested", '{"x":1}', 0), "c": ("failed", None, 3), "d": ("failed", None, 1), "e": ("gave_up", None, 3)}
    assert told.get == {"digested": 1, "reused": 1, "failed": 2, "gave_up": 1}
