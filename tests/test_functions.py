import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import markdown, sandbox
from weftline.functions.text import flattened, truncated
from weftline.functions.times import iso_week
from weftline.operators import ingest
from weftline.sources import transcripts
from weftline.streaming import tail


def test_iso_week_by_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 9, 6, 20),), (dt.datetime(2027, 1, 2),)], "ts timestamp_ntz")
    got = df.select(iso_week(F.col("ts"), "UTC"), iso_week(F.col("ts"))).collect()
    assert [tuple(r) for r in got] == [("2026-W36", "2026-W37"), ("2026-W53", "2026-W53")]


def test_truncate_keeps_characters_whole(spark):
    df = spark.createDataFrame([("aé🙂b",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(truncated(F.col("t"), 5)).collect()] == ["aé", "abc", None]


def test_flattened_content(spark):
    nested = [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "run"}, {"type": "tool_result", "content": [{"type": "text", "text": "two"}]}]
    long = [{"type": "text", "text": "x" * 8001}, {"type": "text", "text": "unread"}, {"type": "tool_use", "name": "unread"}]
    df = spark.createDataFrame([(json.dumps(nested),), ('"plain"',), ("{bad",), (None,), (json.dumps([*nested, 3]),), (json.dumps(long),), ('{"type": "text"}',)], "c string")
    got = [(r.r.text, r.r.tools) for r in df.select(flattened("c").alias("r")).collect()]
    # one block that is no object voids the array
    assert got == [("one\ntwo", ["run"]), ("plain", []), ("", []), ("", []), ("", []), ("x" * 8001, []), ("", [])]


@pytest.mark.parametrize("bad", ["a; drop", "a -- b", "a /* b", "repeat(a, 3) = 'x'", "a in (select 1)", "x" * 2001, "`repeat`(a, 3) = 'xxx'", "a = '\\'' or repeat('x',9) = 'xxxxxxxxx'", "length(érepeat(a, 2)) > 1", "length(日repeat(a, 2)) > 1", "random() > 0.5", 'a = "b"', "a = 'open", "transform(a, x -> x)"])
def test_sandbox_refuses(bad):
    with pytest.raises(ValueError):
        sandbox.predicate(bad)


@pytest.mark.parametrize("bad", ["exists (table secrets)", "id in (table secrets)", "id in (from secrets)", "id in (values 3, 4)", "id in ((table secrets))", "id = any(with x as (values 1) table x)", "( from secrets )", "exists(map x)", "id in (\nselect 1)", "coalesce((table secrets), 1) = 1"])
def test_sandbox_refuses_queries(spark, bad):
    spark.createDataFrame([(3,)], "id int").createOrReplaceTempView("secrets")
    with pytest.raises(ValueError):
        sandbox.predicate(bad)


def test_sandbox_allows_literals(spark):
    df = spark.createDataFrame([("repeat(;--",), ("b",)], "a string")
    assert df.where(sandbox.predicate("starts_with(a, 'repeat(;--')")).count() == 1
    assert df.where(sandbox.predicate("lower(a) = 'b' AND length(a) >= 1 and a IN ('b', 'it''s; fine')")).count() == 1
    assert df.where(sandbox.predicate("regexp_match(a, 'b') and not a like '%--x%' and a <> 'é日'")).count() == 1
    assert df.where(sandbox.predicate("  ")).count() == 2 and sandbox.columns("a, ,b") == ["a", "b"]
    assert sandbox.admin_limit("Infinity") == 500 and sandbox.admin_limit("abc") == 50 and sandbox.admin_limit(100000) == 500
    assert sandbox.console_limit(1000, 30, 200) == 30


def column(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_markdown_sections(spark):
    front = "title: 'T'\ntags: [a, b]\ndescription: what\nlist:\n- x\n# no\n\n- 'y'\nother: z\n- no\ntags: c | d"
    got = column(spark, lambda t: F.array(*[markdown.field(t, n) for n in ("title", "tags", "description", "list", "other", "none")]), front)[0]
    assert got == [["T"], ["c | d"], ["what"], ["x", "y"], ["z"], []]
    text = "---\ntitle: 'T'\ntags: [a, b]\ndescription: what\n---\nintro\n# Head\n## One\n````\n## not\n```\n````\nx\n```a`b\n## One\ny\n## one!\nz"
    rows = markdown.sections(spark.createDataFrame([("notes/n.md", text), ("q/plain.md", "\n# Only\n~~~\n## in code\n"), ("e.md", None), ("e.md", " \n")], "path string, text string")).orderBy("path", "position").collect()
    assert [(r.section, r.slug, r.text) for r in rows] == [("", "", "what\n\nintro\n# Head"), ("One", "one", "## One\n````\n## not\n```\n````\nx\n```a`b"), ("One", "one~dup2", "## One\ny"), ("one!", "one~dup3", "## one!\nz"), ("", "", "# Only\n~~~\n## in code")]
    assert {(r.path, r.title, r.tags) for r in rows} == {("notes/n.md", "T", "a,b"), ("q/plain.md", "Only", "")}
    long = "## Head\n\n" + "p" * 4000 + "\n\ntail"
    heads = "## A\n\n" + "## B\n\n" * 400
    exact = "p" * 3600 + "\n\nq\n\n\n\nr"
    got = column(spark, markdown.parts, long, heads, "short", exact, "x" * 1801, "## T\n\n" + "y" * 1799 + "\n\n## End")
    assert got[0] == ["## Head\n\n" + "p" * 1800, "p" * 1800, "p" * 400 + "\n\ntail"]
    assert len(got[1]) == 1 and got[1][0].count("## B") == 400 and got[2] == ["short"]
    assert got[3] == ["p" * 1800, "p" * 1800, "q\n\n\n\nr"] and got[4] == ["x" * 1800, "x"] and got[5] == ["## T\n\n" + "y" * 1799 + "\n\n## End"]
    pages = markdown.sections(spark.createDataFrame([("l.md", "# L\n" + long)], "path string, text string")).orderBy("position").collect()
    assert [(r.slug, r.position, r.text[:12]) for r in pages] == [("", 0.0, "# L"), ("head~1", 1.0, "## Head\n\nppp"), ("head~2", 1.001, "## Head\n\nppp"), ("head~3", 1.002, "## Head\n\nppp")]
    assert column(spark, markdown.slug, "Foo, Bar_baz", "Čas ok", "!!", " - a - ") == ["foo-bar-baz", "čas-ok", "section", "a"]


def _line(uuid, ts, role, text, **more):
    return json.dumps({"uuid": uuid, "timestamp": ts, "type": role, "message": {"role": role, "content": text}, **more})


def test_ingest_is_replay_safe(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    file = folder / "s.jsonl"
    lines = [_line("u1", "2026-09-06T20:00:00Z", "user", "hi there"), _line("u2", "2026-09-07T20:00:00.123Z", "assistant", [{"type": "tool_use", "name": "x"}]), "junk", _line("u1", "2026-09-08T00:00:00Z", "user", "again")]
    file.write_text("\n".join(lines) + "\n" + '{"uuid": "partial')
    got = transcripts.events(transcripts.lines(spark, str(tmp_path)), "UTC")
    new = ingest.new_events(got, None)
    assert sorted((r.uuid, r.text, r.tools) for r in new.collect()) == [("u1", "hi there", "[]"), ("u2", "", '["x"]')]
    assert ingest.new_events(got, new).count() == 0
    assert sorted((r.iso_week, r.user_count, r.tool_count) for r in ingest.ledger(new).collect()) == [("2026-W36", 1, 0), ("2026-W37", 0, 1)]
    fold = ingest.fold_sessions(new).collect()
    assert [(r.session, r.event_count, r.first_prompt) for r in fold] == [("s@p", 2, "hi there")]


def test_tail_stream_holds_back_partial_lines(spark, tmp_path):
    root, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    root.mkdir()
    file = root / "a.jsonl"

    def run():
        q = tail.follow(spark, str(root)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.value for r in spark.read.parquet(str(out)).collect())

    file.write_text("l1\nl2\npart")
    assert run() == ["l1", "l2"]
    with file.open("a") as f:
        f.write("ial\nl4\n")
    assert run() == ["l1", "l2", "l4", "partial"]


def test_budget_sample_takes_users_first_and_skips_what_does_not_fit(spark):
    from weftline.operators.sampling import within_budget

    turns = [(1, 0, "user", "a" * 50), (1, 1, "assistant", "b" * 30), (1, 2, "system", "c"), (1, 3, "assistant", "d" * 9), (2, 0, "user", None)]
    turns += [(3, i, "user", "x" * 9) for i in range(11)]
    got = within_budget(spark.createDataFrame(turns, "s int, t int, role string, text string"), "s", ["t"], "role", "text", budget=60, most=40)
    rows = {(r["s"], r["t"]): r["text"] for r in got.collect()}
    assert rows[1, 0] == "a" * 38 + " …"
    # 19 characters are left for turns of 20.5 on average: none of them is taken
    assert [k for k in rows if k[0] == 1] == [(1, 0)]
    assert rows[2, 0] == ""
    assert sorted(k[1] for k in rows if k[0] == 3) == [0, 2, 4, 6, 8, 10]


def test_tool_output(spark):
    from weftline.functions.text import tool_output

    texts = [("397 def read(", False), ("397 def read(\nnext", True), ("1. do this\n2. do that", False), ("a\n12: x\n13: y\n14: z", True), ("", False), (None, False), ("@@ -1 +1\n\n \nmore", True)]
    rows = spark.createDataFrame(texts, "text string, want boolean").withColumn("got", tool_output(F.col("text"))).collect()
    assert [r["text"] for r in rows if r["got"] != r["want"]] == []
