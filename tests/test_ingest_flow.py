"""The ingest flow over files that grow, shrink and replay, as a stream and as batches."""

import json

from pyspark.sql import functions as F

from weftline.operators import commits, ingest
from weftline.sources import transcripts
from weftline.streaming import tail


def line(uuid, minute, role="user", text="hi", cwd="/srv/app/deep"):
    return json.dumps({"uuid": uuid, "timestamp": f"2026-09-06T20:{minute:02d}:00Z", "type": role, "cwd": cwd, "message": {"role": role, "content": text}}) + "\n"


def typed(raw):
    return transcripts.records(raw).withColumn("project", F.lit("p"))


def test_stream_is_exactly_once(spark, tmp_path):
    logs, store, at = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "cp")
    logs.mkdir()
    file = logs / "s.jsonl"
    file.write_text(line("u1", 1) + line("u2", 2, "assistant") + line("u3", 3)[:30])
    told = []

    def run():
        q = commits.follow(typed(tail.follow(spark, str(logs))), store, at, lambda report, n: told.append(n)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return commits.snapshot(spark, store, max(told))

    out = run()
    assert sorted(r.uuid for r in out["events"].collect()) == ["u1", "u2"]
    file.write_text(line("u1", 1) + line("u2", 2, "assistant") + line("u3", 3, text="later", cwd="/srv/app") + "junk\n" + line("u2", 9))
    out = run()
    assert sorted(r.uuid for r in out["events"].collect()) == ["u1", "u2", "u3"]
    row = out["sessions"].first()
    assert (row.event_count, row.first_prompt, row.byte_offset) == (3, "hi", file.stat().st_size)
    assert [(r.cwd, r.name) for r in out["projects"].collect()] == [("/srv/app", "app")]
    # a file that shrank is read from its start; what was seen before changes nothing
    file.write_text(line("u1", 1))
    out = run()
    row = out["sessions"].first()
    assert (row.byte_offset, row.generation, row.event_count) == (file.stat().st_size, 1, 3)
    file.write_text(line("u1", 1) + line("u4", 4))
    out = run()
    assert sorted(r.uuid for r in out["events"].collect()) == ["u1", "u2", "u3", "u4"] and out["sessions"].first().event_count == 4
    weeks = out["session_weeks"].collect()
    assert [(r.iso_week, r.event_count, r.user_count, r.assistant_count) for r in weeks] == [("2026-W37", 4, 3, 1)]


def test_lines_and_report(spark, tmp_path):
    folder = tmp_path / "-srv-my-app"
    (folder / "memory").mkdir(parents=True)
    (folder / "a.jsonl").write_text(line("u1", 1) + "\nnot json\n" + line("", 2) + line("u2", 3)[:-1])
    (folder / "b.jsonl").write_text(line("u5", 1))
    (folder / "memory" / "c.jsonl").write_text(line("u6", 1))
    raw = transcripts.lines(spark, str(tmp_path))
    assert sorted((r.path[-7:], r.line_no) for r in raw.collect()) == [("a.jsonl", 1), ("a.jsonl", 3), ("a.jsonl", 4), ("b.jsonl", 1)]
    assert raw.agg(F.max("end_offset")).first()[0] <= (folder / "a.jsonl").stat().st_size
    got = {r.path[-7:]: (r.lines, r.events, r.skipped) for r in transcripts.report(raw, transcripts.events(raw)).collect()}
    assert got == {"a.jsonl": (3, 1, 2), "b.jsonl": (1, 1, 0)}
    files = spark.createDataFrame([("a", 10), ("b", 5), ("c", 1)], "path string, length long")
    state = spark.createDataFrame([("a", 10), ("b", 4)], "path string, byte_offset long")
    assert [r.path for r in transcripts.unchanged(files, state).collect()] == ["a"]


def test_origin(spark):
    paths = ["/h/.claude/projects/-opt-x/a.jsonl", "/h/.claude/projects/-opt-x/sub/a.jsonl", "/h/.claude/projects/plain/a.jsonl"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [tuple(r[0]) for r in df.select(transcripts.origin(F.col("path"), "/h/.claude/projects/")).collect()]
    assert got == [("/opt/x", "-opt-x", "projects"), ("/opt/x", "-opt-x", "subagent"), ("plain", "plain", "projects")]
    assert df.select(transcripts.origin(F.col("path"), "/h")).first()[0].tier == "backup"


def test_runs_retention_and_state(spark):
    summary = spark.createDataFrame([("a", 1, 0, 5, False), ("b", 0, 5, 5, False), ("c", 0, 0, 0, True), ("d", 0, 3, 9, False)], "session string, inserted long, from_offset long, to_offset long, created boolean")
    assert sorted(r.session for r in ingest.runs(summary).collect()) == ["a", "c", "d"]
    rows = spark.createDataFrame([("old", 1), ("new", 9), ("none", None)], "id string, created long")
    assert sorted(r.id for r in ingest.retained(rows, F.lit(5)).collect()) == ["new", "none"]
    assert [r.id for r in ingest.without_ids(rows, rows.where("id <> 'new'")).collect()] == ["new"]
    assert ingest.tail_state(spark.createDataFrame([("s", "/f", 3)], "session string, path string, byte_offset long")).first() == ("/f", 3, "s")
