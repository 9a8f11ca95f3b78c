"""Claims, commits and bounded reading of growing files."""

import json
import os
import random

from pyspark.sql import functions as F

from weftline.operators import commits, ingest
from weftline.sources import transcripts
from weftline.streaming import tail

def applied(batch, stored=None):
    """The tables as rows, so that plans of further steps stay small."""
    out = ingest.apply(batch, stored, F.lit("2026-09-07").cast("timestamp_ntz"))
    return {t: batch.sparkSession.createDataFrame(df.collect(), df.schema) for t, df in out.items()}


def line(uuid, minute=1, role="user", text="hi", cwd="/srv/app"):
    return json.dumps({"uuid": uuid, "timestamp": f"2026-09-06T20:{minute:02d}:00Z", "type": role, "cwd": cwd, "message": {"role": role, "content": text}}) + "\n"


def chunk(spark, texts, path="/logs/s.jsonl", start=0, generation=0, project="p"):
    rows = []
    for x in texts:
        size = len(x.encode())
        rows.append((path, start, start + size, generation, x.strip(), start))
        start += size
    raw = spark.createDataFrame(rows, "path string, start_offset long, end_offset long, generation long, value string, line_no long")
    return transcripts.records(raw).withColumn("project", F.lit(project))


def files(folder):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet")}


def test_a_claim_must_go_on_where_the_store_is(spark):
    first = applied(chunk(spark, [line("u1"), line("u2", 2)]), None)
    size = first["sessions"].first().byte_offset
    assert size == len(line("u1") + line("u2", 2))
    ahead = applied(chunk(spark, [line("u9")], start=size + 500), first)
    report = ahead["report"].first()
    assert (report.outcome, report.have, report.want, report.inserted) == ("conflict", size, size + 500, 0)
    assert ahead["sessions"].first().byte_offset == size and ahead["events"].count() == 2 and ahead["import_runs"].count() == 1
    good = applied(chunk(spark, [line("u2", 2), "junk\n", line("u3", 3)], start=size), first)
    report = good["report"].first()
    assert (report.outcome, report.lines, report.inserted, report.skipped, report.replayed) == ("accepted", 3, 1, 1, 1)
    assert {r.uuid: r.line_no for r in good["events"].collect()} == {"u1": 1, "u2": 2, "u3": 5}
    other = applied(chunk(spark, [line("u4")], path="/backup/s.jsonl").withColumn("session", F.first("session").over(ingest.W.partitionBy())), {**first, "sessions": first["sessions"].withColumn("session", F.lit("s@backup"))})
    assert other["report"].first().outcome == "refused"


def test_a_file_that_shrank_restarts_and_an_old_replay_does_not_move_it_back(spark):
    first = applied(chunk(spark, [line("u1"), line("u2", 2)]), None)
    cut = applied(chunk(spark, [line("u1")], generation=1), first)
    row, report = cut["sessions"].first(), cut["report"].first()
    assert (row.byte_offset, row.generation, row.event_count) == (len(line("u1")), 1, 2)
    assert (report.inserted, report.replayed) == (0, 1)
    old = applied(chunk(spark, [line("u3", 3)], start=len(line("u1") + line("u2", 2))), cut)
    assert old["report"].first().outcome == "conflict" and old["sessions"].first().byte_offset == len(line("u1"))
    on = applied(chunk(spark, [line("u4", 4)], start=len(line("u1")), generation=1), cut)
    assert on["report"].first().outcome == "accepted" and {r.uuid: r.line_no for r in on["events"].collect()}["u4"] == 2
    late = applied(chunk(spark, [line("u5")], start=7, generation=2), cut)
    assert late["report"].first().outcome == "conflict"


def test_a_commit_writes_only_its_own_rows(spark, tmp_path):
    store = str(tmp_path / "store")
    many = chunk(spark, [line(f"a{i}", i % 60) for i in range(300)], path="/logs/a.jsonl", project="pa").unionByName(chunk(spark, [line("b1")], path="/logs/b.jsonl", project="pb"))
    commits.commit(many, store, 0)
    before = files(store)
    size = commits.snapshot(spark, store)["sessions"].where("path = '/logs/b.jsonl'").first().byte_offset
    ten = chunk(spark, [line(f"b{i}", i) for i in range(2, 12)], path="/logs/b.jsonl", start=size, project="pb")
    report, inserted = commits.commit(ten, store, 1)
    assert inserted.count() == 10 and report.first().inserted == 10
    after = files(store)
    assert all(after[x] == t for x, t in before.items())
    fresh = {t: spark.read.parquet(*[x for x in after if x not in before and f"/{t}/" in x]).count() for t in ("events", "sessions", "session_weeks", "projects", "import_runs")}
    assert fresh == {"events": 10, "sessions": 1, "session_weeks": 1, "projects": 1, "import_runs": 1}
    now = commits.snapshot(spark, store)
    assert now["events"].count() == 311 and {r.session: r.event_count for r in now["sessions"].collect()} == {"a@logs": 300, "b@logs": 11}
    assert {r.session: r.event_count for r in now["session_weeks"].collect()} == {"a@logs": 300, "b@logs": 11}
    # a committed batch that is replayed, also after a restart, is left alone; its report can be told again
    report, inserted = commits.commit(ten, store, 1)
    assert files(store) == after and inserted.count() == 10 and report.first().inserted == 10
    # one that broke off before its commit is not there, and its replay writes it anew
    ingest_only = chunk(spark, [line("b12", 12)], path="/logs/b.jsonl", start=now["sessions"].where("path = '/logs/b.jsonl'").first().byte_offset, project="pb")
    ingest_only.write.parquet(f"{store}/events/batch=2")
    assert commits.committed(spark, store) == 1 and commits.snapshot(spark, store)["events"].count() == 311
    commits.commit(ingest_only, store, 2)
    assert commits.snapshot(spark, store)["events"].count() == 312 and commits.snapshot(spark, store, 1)["events"].count() == 311


def test_ledger_and_projects_equal_a_recount(spark, tmp_path):
    rng = random.Random(1)
    store, start = str(tmp_path / "store"), dict.fromkeys("xyz", 0)
    for number in range(4):
        batch = None
        for name in "xyz":
            texts = [line(f"{name}{rng.randrange(40)}", rng.randrange(60), rng.choice(["user", "assistant"]), cwd=rng.choice(["", "/srv/app/deep", "/srv/app", "/srv/b"])) for _ in range(8)]
            one = chunk(spark, texts, path=f"/logs/{name}.jsonl", start=start[name], project=f"p{name}")
            start[name] += sum(len(x) for x in texts)
            batch = one if batch is None else batch.unionByName(one)
        commits.commit(batch, store, number)
    now = commits.snapshot(spark, store)
    key = lambda rows: sorted(tuple(sorted(r.asDict().items(), key=str)) for r in rows)
    assert key(now["session_weeks"].collect()) == key(ingest.ledger(now["events"]).collect())
    shortest = {r.project: r.n for r in now["events"].where("cwd <> ''").groupBy("project").agg(F.min(F.length("cwd")).alias("n")).collect()}
    assert {r.project: len(r.cwd) for r in now["projects"].collect()} == shortest


def test_live_rows_after_the_commit(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    (logs / "s.jsonl").write_text("".join(line(f"u{i:02d}", i % 60, text="é" * 200 if i == 3 else "" if i == 4 else f"t{i}") for i in range(50)))
    heard = []

    def live(rows, number):
        heard.append((commits.committed(spark, store), [r.asDict() for r in rows.orderBy("nth").collect()]))

    q = commits.follow(transcripts.records(tail.follow(spark, str(logs))).withColumn("project", F.lit("p")), store, str(tmp_path / "cp"), live=live).trigger(availableNow=True).start()
    q.awaitTermination(120)
    at, rows = heard[-1]
    assert at >= 0 and [r["nth"] for r in rows] == list(range(1, 41)) and rows[0]["uuid"] == "u00" and "u04" not in {r["uuid"] for r in rows}
    assert rows[3]["text"] == "é" * 140 and all(r["truncated"] and r["project_path"] == "/srv/app" for r in rows)


def test_spans_cut_anywhere_give_every_whole_line_once(tmp_path):
    rng = random.Random(5)
    file = tmp_path / "x.jsonl"
    texts = ["é" * rng.randrange(4) + "x" * rng.choice([0, 1, 7, 300, 70_000]) for _ in range(60)]
    data = "\n".join(texts).encode()
    file.write_bytes(data)
    reader = tail.TailReader({"path": str(tmp_path)})
    for _ in range(20):
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randrange(12)))})
        rows = [r for a, b in zip(cuts, cuts[1:]) for r in reader.read(tail.Span(str(file), 0, a, b))]
        assert [r[4] for r in rows] == texts[:-1]
        assert all(x[2] == y[1] for x, y in zip(rows, rows[1:])) and rows[0][1] == 0
    # shorter than planned, or gone: the task ends
    file.write_bytes(b"short\n12")
    assert [r[4] for r in reader.read(tail.Span(str(file), 0, 0, 100))] == ["short"]
    assert list(reader.read(tail.Span(str(file), 0, 50, 100))) == [] and list(reader.read(tail.Span(str(tmp_path / "no"), 0, 0, 9))) == []


def test_admission_is_bounded_and_fair():
    rng = random.Random(2)
    listing = {f"f{i:04d}": rng.randrange(1, 5000) for i in range(1000)}
    seen, turn, steps = {}, "", 0
    while True:
        after, turn = tail.admitted(seen, listing, 100_000, 60, turn)
        if after == seen:
            break
        took = {p: e[1] - seen.get(p, (0, 0))[1] for p, e in after.items() if e != seen.get(p)}
        assert sum(took.values()) <= 100_000 and len(took) <= 60
        seen, steps = after, steps + 1
    assert {p: e[1] for p, e in seen.items()} == listing and steps >= 17
    # a file that always has more doesn't keep the others waiting
    ends, turn = tail.admitted({}, {"a": 10**9, "b": 5}, 100, 9, "")
    ends, turn = tail.admitted(ends, {"a": 10**9, "b": 5}, 100, 9, turn)
    assert ends["b"] == [0, 5]


def test_a_thousand_files_over_many_batches_and_a_restart(spark, tmp_path):
    logs, out, at = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(1000):
        (logs / f"d{i % 10}").mkdir(parents=True, exist_ok=True)
        (logs / f"d{i % 10}" / f"f{i:04d}.jsonl").write_text("".join(line(f"{i}-{j}") for j in range(1 + i % 3)) + '{"half')
    numbers = []

    def keep(rows, number):
        numbers.append(number)
        rows.select("path", "start_offset").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 3:
            raise RuntimeError("stop here")

    def run(write):
        q = tail.follow(spark, str(logs), maxFilesPerTrigger=200, maxBytesPerTrigger=60_000, taskBytes=20_000).writeStream.foreachBatch(write).option("checkpointLocation", at).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    try:
        run(keep)
    except Exception as e:
        assert "stop here" in str(e)
    assert max(numbers) == 3
    run(lambda rows, number: rows.select("path", "start_offset").write.mode("overwrite").parquet(f"{out}/batch={number}"))
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("path", "start_offset").distinct().count() == sum(1 + i % 3 for i in range(1000))
    assert rows.select("batch").distinct().count() >= 5


def test_lines_are_placed_over_blocks(spark, tmp_path):
    rng = random.Random(7)
    want = []
    for i in range(6):
        at, data = 0, b""
        for n in range(rng.randrange(1, 400)):
            value = ("é" * rng.randrange(3) + "x" * rng.choice([0, 3, 50, 900])).encode()
            data += value + b"\n"
            if value:
                want.append((f"f{i}.jsonl", n + 1, at, len(data), value.decode()))
            at = len(data)
        (tmp_path / f"f{i}.jsonl").write_bytes(data + (b"open end" if i % 2 else b""))
    held = {x: spark.conf.get(x) for x in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        df = transcripts.lines(spark, str(tmp_path))
        got = sorted((r.path.rsplit("/", 1)[-1], r.line_no, r.start_offset, r.end_offset, r.value) for r in df.collect())
    finally:
        for x, v in held.items():
            spark.conf.set(x, v)
    assert got == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "value#" not in window[: window.index("MapInArrow")].split("Window", 1)[1].split("Aggregate")[0]


def test_unread_lines_are_a_claim(spark, tmp_path):
    file = tmp_path / "s.jsonl"
    file.write_text(line("u1") + line("u2", 2))
    typed = lambda raw: transcripts.records(raw).withColumn("project", F.lit("p"))
    fresh = lambda out: typed(transcripts.unread(transcripts.lines(spark, str(tmp_path)), ingest.tail_state(out["sessions"])))
    none = spark.createDataFrame([], "path string, byte_offset long, generation long")
    out = applied(typed(transcripts.unread(transcripts.lines(spark, str(tmp_path)), none)))
    assert out["sessions"].first().byte_offset == file.stat().st_size and fresh(out).count() == 0
    file.write_text(file.read_text() + line("u3", 3))
    out = applied(fresh(out), out)
    assert [(r.outcome, r.inserted) for r in out["report"].collect()] == [("accepted", 1)]
    file.write_text(line("u1"))  # cut and rewritten: the offset is set back, what is known is skipped
    out = applied(fresh(out), out)
    report = out["report"].first()
    assert (report.outcome, report.inserted, report.replayed) == ("accepted", 0, 1)
    assert (out["sessions"].first().byte_offset, out["sessions"].first().generation) == (len(line("u1")), 1)
