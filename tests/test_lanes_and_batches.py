from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftline.operators import lanes, reduction
from weftline.sources import transcripts

START = datetime(2024, 3, 1, 9)


def folded(rows, named):
    """(moment, lanes) by counting anew at each minute."""
    held, out = [], []
    for minute in range(1, 90):
        moment = START + timedelta(minutes=minute)
        seen = {}
        for ts, key in rows:
            if moment - timedelta(minutes=10) <= ts < moment:
                seen[key] = seen.get(key, 0) + 1
        if not seen:
            continue
        want = sorted(seen, key=lambda x: (-seen[x], x not in held, x))[:named]
        want = (want + [x for x in held if x not in want])[:named]
        if set(want) != set(held):
            held = want
            out.append((moment, ",".join(want)))
    return out


def test_lanes_move_as_counted_anew(spark):
    rows = [(START + timedelta(seconds=(i * 7919) % 4200), "abcde"[(i * i + i // 7) % 5]) for i in range(120)]
    df = spark.createDataFrame([("v", ts, key) for ts, key in rows], "view string, ts timestamp_ntz, lane string")
    found = lanes.reranked(df, "view", "ts", "lane", 2).orderBy("moment").collect()
    assert [(r.moment, r.lanes) for r in found] == folded(rows, 2)
    assert lanes.reranked(df.limit(0), "view", "ts", "lane", 2).count() == 0


def test_batches_end_with_their_last_event_and_the_file(spark):
    raw = spark.createDataFrame([("a", n, n * 10) for n in range(1, 8)] + [("b", 1, 4)], "path string, line_no long, end_offset long")
    found = transcripts.batches(raw, raw.where("path = 'a' and line_no in (2, 3, 5)"), 2).orderBy("path", "batch").collect()
    assert [tuple(r) for r in found] == [("a", 0, 2, 3, 0, 30), ("a", 1, 1, 4, 30, 70), ("b", 0, 0, 1, 0, 4)]


def test_reduction_stops_at_the_first_overflow(spark):
    rows = [("w", "a", "x" * 300), ("w", "b", "y" * 900), ("w", "c", "z"), ("v", "d", "long " * 400)]
    df = spark.createDataFrame(rows, "week string, session string, summary string")
    df = df.withColumn("meta", F.array("session")).withColumn("sections", F.array(F.struct(F.lit("open").alias("name"), F.array(F.lit("p" * 200), F.lit(""), F.lit("q")).alias("bullets"))))
    found = {r.session: r for r in reduction.within_budget(df, "week", "session", [F.col("session")], 1000).collect()}
    # b passes what is left, so c is not tried; d is its group's first
    assert sorted(found) == ["a", "d"]
    assert found["a"].piece == "<digest n=1 a>\nsummary: " + "x" * 300 + "\nopen:\n- " + "p" * 158 + " …\n- q\n</digest>\n"
