"""The console's queries over an event store made of the given tables, each with its DuckDB SQL.

Sessions are conversations; their projects are nations.  Everything is derived by Spark from the tables, so the
store grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.sandbox import console_limit
from weftline.functions.safety import one_line
from weftline.functions.text import contains_literal, truncated
from weftline.functions.times import ago, iso_week, local_day, stamp, stamped
from weftline.operators import digests, ingest, lanes, reduction, replay
from weftline.plans.console import query, table
from weftline.sources import transcripts

_START = "2024-01-01 00:00:00"

#: ev: events; se: sessions; pr: projects.
STORE_SQL = f"""WITH ev AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session, turn AS line_no, role, text, CASE WHEN turn % 3 = 2 THEN '["run"]' ELSE '[]' END AS tools, conv_id % 25 AS project,
TIMESTAMP '{_START}' + INTERVAL 1 MINUTE * (conv_id * 300 + turn * 7) AS ts FROM conversations),
ew AS (SELECT *, strftime(ts + INTERVAL 7 HOUR, '%G-W%V') AS iso_week, CAST(ts + INTERVAL 7 HOUR AS DATE) AS day FROM ev),
pr AS (SELECT n_nationkey AS project, '/srv/' || lower(n_name) AS path, n_name AS name, 'h' || n_regionkey AS host FROM nation WHERE n_nationkey % 5 <> 4),
se AS (SELECT session, any_value(project) AS project, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS event_count, substr(arg_min(text, line_no) FILTER (role = 'user' AND trim(text) <> ''), 1, 4000) AS first_prompt FROM ev GROUP BY 1) """


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    minutes = (F.col("conv_id") * 300 + F.col("turn") * 7).cast("int")
    ts = F.lit(_START).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), "role", "text", F.when(F.col("turn") % 3 == 2, '["run"]').otherwise("[]").alias("tools"), (F.col("conv_id") % 25).alias("project"), ts.alias("ts"))
    return rows.withColumn("iso_week", iso_week(F.col("ts"))).withColumn("day", local_day(F.col("ts")))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some sessions have a project that is not there."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4")
    return n.select(F.col("n_nationkey").cast("long").alias("project"), F.concat(F.lit("/srv/"), F.lower("n_name")).alias("path"), F.col("n_name").alias("name"), F.concat(F.lit("h"), "n_regionkey").alias("host"))


def sessions(ev: DataFrame) -> DataFrame:
    asked = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("line_no"))
    return ev.withColumn("asked", asked).groupBy("session").agg(F.first("project").alias("project"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("event_count"), F.substring(F.min_by("text", "asked"), 1, 4000).alias("first_prompt"))


def page(df: DataFrame, order: list, limit: int, full: bool = False) -> DataFrame:
    """The first `limit` rows in order, with a flag that says whether more were there (`full`: whether the page is full)."""
    cut = df.orderBy(*order).limit(limit if full else limit + 1)
    # one pass over the input; the windows see at most limit + 1 rows
    marked = cut.withColumn("_at", F.row_number().over(W.orderBy(*order))).withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy()) >= (limit if full else limit + 1))
    return marked.where(F.col("_at") <= limit).drop("_at")


@query(
    "console_projects",
    STORE_SQL + """SELECT pr.project, path, name, host, count(session) AS sessions, coalesce(sum(event_count), 0)::BIGINT AS events, max(last_ts) AS last_ts
FROM pr LEFT JOIN se USING (project) GROUP BY ALL ORDER BY last_ts DESC NULLS LAST, project LIMIT 12""",
)
def console_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = projects(spark, sf_dir).join(sessions(events(spark, sf_dir)), "project", "left")
    by = joined.groupBy("project", "path", "name", "host").agg(F.count("session").alias("sessions"), F.coalesce(F.sum("event_count"), F.lit(0)).cast("long").alias("events"), F.max("last_ts").alias("last_ts"))
    return by.orderBy(F.desc_nulls_last("last_ts"), "project").limit(console_limit(12, 200, 1000))


def search(ev: DataFrame, pr: DataFrame, text: str = "", project: str = "", role: str = "", session: str = "", limit: object = 30, project_id: object = None) -> DataFrame:
    """Newest events that hold a literal, by project path or id, role and session prefix; a full page counts as truncated."""
    hits = ev.join(pr.select("project", "path", "name"), "project", "left").where("role <> ''")
    if text:
        hits = hits.where(contains_literal(F.col("text"), text))
    if project:
        hits = hits.where(contains_literal(F.coalesce("path", F.lit("")), project))
    if project_id is not None:
        hits = hits.where(F.col("project") == project_id)
    if role:
        hits = hits.where(F.col("role") == role)
    if session:
        hits = hits.where(F.col("session").cast("string").startswith(session))
    most = console_limit(limit, 30, 200)
    shown = page(hits.select("id", "session", "ts", "role", F.coalesce("path", F.lit("")).alias("project_path"), F.substring("text", 1, 600).alias("snippet")), [F.desc("ts"), F.desc("id")], most, full=True)
    return shown


@query(
    "console_search",
    STORE_SQL + """, h AS (SELECT id, session, ts, role, coalesce(path, '') AS project_path, substr(text, 1, 600) AS snippet FROM ev LEFT JOIN pr USING (project) WHERE role <> '' AND role = 'assistant' AND contains(lower(text), 'er') AND contains(coalesce(path, ''), '_1'))
SELECT *, (SELECT count(*) >= 20 FROM h) AS truncated FROM h ORDER BY ts DESC, id DESC LIMIT 20""",
)
def console_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(events(spark, sf_dir), projects(spark, sf_dir), "ER", "_1", "assistant", "", 20)


@query("console_newest", STORE_SQL + """SELECT id, session, ts, role, coalesce(path, '') AS project_path, substr(text, 1, 600) AS snippet, (SELECT count(*) >= 30 FROM ev WHERE session::VARCHAR LIKE '1%') AS truncated FROM ev LEFT JOIN pr USING (project) WHERE session::VARCHAR LIKE '1%' ORDER BY ts DESC, id DESC LIMIT 30""")
def console_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text is the newest window; a limit out of range is the default."""
    return search(events(spark, sf_dir), projects(spark, sf_dir), session="1", limit=5000)


@query(
    "console_project_search",
    STORE_SQL + """, h AS (SELECT id, session, ts, role, coalesce(path, '') AS project_path, substr(text, 1, 600) AS snippet FROM ev LEFT JOIN pr USING (project) WHERE role <> '' AND contains(lower(text), 'th') AND project = 7)
SELECT *, (SELECT count(*) >= 200 FROM h) AS truncated FROM h ORDER BY ts DESC, id DESC LIMIT 200""",
)
def console_project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(events(spark, sf_dir), projects(spark, sf_dir), "Th", project_id=7, limit=200)


@query(
    "console_days",
    STORE_SQL + """, d AS (SELECT day, session, count(*) AS events, count(*) FILTER (role = 'user') AS user_msgs, min(ts) AS first_ts, max(ts) AS last_ts, substr(arg_min(text, (ts, id)) FILTER (role = 'user' AND trim(text) <> ''), 1, 200) AS preview
FROM ew WHERE role <> '' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2)
SELECT d.*, (SELECT count(*) > 15 FROM d) AS truncated FROM d ORDER BY day DESC, last_ts DESC, session LIMIT 15""",
)
def console_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    # half-open, and on the stored time, so that it reaches the scan
    begin, end = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-03", "2024-01-12"))
    rows = events(spark, sf_dir).where((F.col("ts") >= begin) & (F.col("ts") < end) & (F.col("role") != ""))
    asked = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.struct("ts", "id"))
    days = rows.withColumn("asked", asked).groupBy("day", "session").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("role") == "user").alias("user_msgs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.substring(F.min_by("text", "asked"), 1, 200).alias("preview"))
    return page(days, [F.desc("day"), F.desc("last_ts"), F.col("session")], 15)


@query(
    "console_sessions",
    STORE_SQL + """SELECT session, coalesce(path, '') AS project_path, event_count, last_ts, substr(first_prompt, 1, 300) AS first_prompt FROM se LEFT JOIN pr USING (project)
WHERE session IN (SELECT session FROM ew WHERE iso_week = '2024-W02') ORDER BY last_ts DESC, session LIMIT 10""",
)
def console_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    # the ISO week's local days as a range of stored times
    week = ev.where((F.col("ts") >= F.lit("2024-01-07 17:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-14 17:00:00").cast("timestamp_ntz"))).select("session")
    listed = sessions(ev).join(week, "session", "left_semi").join(projects(spark, sf_dir), "project", "left")
    return listed.orderBy(F.desc("last_ts"), "session").limit(10).select("session", F.coalesce("path", F.lit("")).alias("project_path"), "event_count", "last_ts", F.substring("first_prompt", 1, 300).alias("first_prompt"))


@query("console_weeks", STORE_SQL + """SELECT iso_week, session, coalesce(name, '') AS project_name, count(*) AS event_count, count(*) FILTER (role = 'user') AS user_count, max(ts) AS last_ts FROM ew LEFT JOIN pr USING (project) GROUP BY 1, 2, 3 ORDER BY iso_week DESC, last_ts DESC, session LIMIT 25""")
def console_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = events(spark, sf_dir).groupBy("iso_week", "session", "project").agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("role") == "user").alias("user_count"), F.max("ts").alias("last_ts"))
    top = weeks.orderBy(F.desc("iso_week"), F.desc("last_ts"), "session").limit(25)
    return top.join(projects(spark, sf_dir).select("project", "name"), "project", "left").select("iso_week", "session", F.coalesce("name", F.lit("")).alias("project_name"), "event_count", "user_count", "last_ts")


def resolve(names: DataFrame, asked: DataFrame, name: str = "name") -> DataFrame:
    """(prefix, outcome, found) of each prefix asked for: one match, or the exact one among several; blank finds nothing."""
    low, prefix = F.lower(name), F.lower(F.trim("prefix"))
    hit = names.join(F.broadcast(asked), F.col("prefix").isNotNull() & (prefix != "") & low.startswith(prefix))
    # pre-aggregated for each prefix: a count, the least match and the exact one
    by = hit.groupBy("prefix").agg(F.count(F.lit(1)).alias("matches"), F.min(name).alias("least"), F.min(F.when(low == prefix, F.col(name))).alias("exact"))
    found = F.when(F.col("matches") == 1, F.col("least")).otherwise(F.col("exact"))
    outcome = F.when(F.col("matches").isNull(), "none").when(found.isNotNull(), "one").otherwise("ambiguous")
    return asked.join(by, "prefix", "left").select("prefix", outcome.alias("outcome"), found.alias("found"))


@query(
    "resolve_exact",
    """WITH n AS (SELECT 'conv-' || conv_id AS name FROM (SELECT DISTINCT conv_id FROM conversations)), a AS (SELECT * FROM (VALUES ('conv-1'), ('CONV-7'), ('conv-99'), ('conv-'), ('%'), ('zzz'), (' ')) v(prefix)),
m AS (SELECT prefix, count(*) AS k, min(name) AS least, min(name) FILTER (name = lower(prefix)) AS exact FROM a JOIN n ON trim(prefix) <> '' AND starts_with(name, lower(prefix)) GROUP BY 1)
SELECT prefix, CASE WHEN k IS NULL THEN 'none' WHEN k = 1 OR exact IS NOT NULL THEN 'one' ELSE 'ambiguous' END AS outcome, CASE WHEN k = 1 THEN least ELSE exact END AS found FROM a LEFT JOIN m USING (prefix)""",
)
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("name")).distinct()
    return resolve(names, spark.createDataFrame([("conv-1",), ("CONV-7",), ("conv-99",), ("conv-",), ("%",), ("zzz",), (" ",)], "prefix string"))


@query("intake_files", STORE_SQL + ", f AS (SELECT session, sum(strlen(text) + 1)::BIGINT AS file_size, sum(CASE WHEN line_no < 4 THEN strlen(text) + 1 ELSE 0 END)::BIGINT AS byte_offset FROM ev GROUP BY 1) SELECT session, coalesce(path, '') AS project_path, file_size, byte_offset, file_size - byte_offset AS pending, last_ts FROM f JOIN se USING (session) LEFT JOIN pr USING (project) WHERE file_size > byte_offset ORDER BY last_ts DESC, session LIMIT 40")
def intake_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with bytes that were not read, newest first."""
    size = F.octet_length("text") + 1
    files = events(spark, sf_dir).groupBy("session").agg(F.first("project").alias("project"), F.sum(size).alias("file_size"), F.sum(F.when(F.col("line_no") < 4, size).otherwise(0)).alias("byte_offset"), F.max("ts").alias("last_ts"))
    pending = files.where("file_size > byte_offset").orderBy(F.desc("last_ts"), "session").limit(console_limit(40, 100, 1000))
    return pending.join(projects(spark, sf_dir), "project", "left").select("session", F.coalesce("path", F.lit("")).alias("project_path"), F.col("file_size").cast("long"), F.col("byte_offset").cast("long"), (F.col("file_size") - F.col("byte_offset")).cast("long").alias("pending"), "last_ts")


@query("intake_day", "SELECT count(*) AS runs, count(*) FILTER (ts >= m - INTERVAL 24 HOUR) AS runs_24h, (sum(value * 100) FILTER (ts >= m - INTERVAL 24 HOUR))::DECIMAL(18,0)::BIGINT AS cents_24h FROM (SELECT ts, round(value * 100) / 100 AS value FROM events), (SELECT max(ts) AS m FROM events)")
def intake_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    recent = F.col("ts") >= F.col("m") - F.expr("INTERVAL 24 HOURS")
    cents = F.round(F.col("value") * 100).cast("long")
    return rows.join(F.broadcast(rows.agg(F.max("ts").alias("m")))).agg(F.count(F.lit(1)).alias("runs"), F.count_if(recent).alias("runs_24h"), F.sum(F.when(recent, cents)).alias("cents_24h"))


@query("table_lag", "SELECT 'conversations' AS name, (SELECT count(*) FROM conversations) AS source_rows, (SELECT count(*) FROM conversations WHERE turn < 3) AS copy_rows, (SELECT count(*) FROM conversations WHERE turn >= 3) AS lag UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents WHERE doc_id % 2 = 0), (SELECT count(*) FROM documents WHERE doc_id % 2 <> 0)")
def table_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table that its copy lacks."""
    counted = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    out = None
    for name, kept in (("conversations", "turn < 3"), ("documents", "doc_id % 2 = 0")):
        df = table(spark, sf_dir, name)
        row = counted(df).join(counted(df.where(kept)).withColumnRenamed("n", "copy_rows")).select(F.lit(name).alias("name"), F.col("n").alias("source_rows"), "copy_rows", (F.col("n") - F.col("copy_rows")).alias("lag"))
        out = row if out is None else out.unionByName(row)
    return out


@query("name_map", STORE_SQL + "SELECT id, coalesce(session_name, '') AS session_name, coalesce(path, '') AS project_path FROM ev LEFT JOIN (SELECT session, project AS p, 's-' || session AS session_name FROM se WHERE session % 10 <> 3) USING (session) LEFT JOIN pr ON pr.project = p")
def name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the names of their session and project; what is not known has blank names."""
    ev = events(spark, sf_dir)
    names = sessions(ev).where("session % 10 <> 3").select("session", F.concat(F.lit("s-"), "session").alias("session_name"), F.col("project").alias("p"))
    joined = ev.select("id", "session").join(names, "session", "left").join(projects(spark, sf_dir), F.col("project") == F.col("p"), "left")
    return joined.select("id", F.coalesce("session_name", F.lit("")).alias("session_name"), F.coalesce("path", F.lit("")).alias("project_path"))


@query("minute_meter", "WITH m AS (SELECT date_trunc('minute', max(ts)) AS now FROM events), b AS (SELECT now - INTERVAL 1 MINUTE * i AS minute FROM m, range(10) t(i)) SELECT minute, count(ts) AS n FROM b LEFT JOIN events ON date_trunc('minute', ts) = minute GROUP BY 1")
def minute_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten minutes that end now, empty ones too."""
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.date_trunc("minute", F.max("ts")).cast("timestamp_ntz").alias("now"))
    minutes = now.select(F.explode(F.sequence(F.col("now") - F.expr("INTERVAL 9 MINUTES"), F.col("now"), F.expr("INTERVAL 1 MINUTE"))).alias("minute"))
    seen = rows.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 9 MINUTES")).groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return minutes.join(seen, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("live_message", STORE_SQL + ", v AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_no) AS i, count(*) OVER (PARTITION BY session) AS n FROM ev WHERE role <> '' AND (text <> '' OR tools <> '[]')) SELECT id, session, role, strlen(text) > 280 AS cut, CASE WHEN strlen(text) <= 280 THEN text END AS whole, n > 5 AS truncated FROM v WHERE i <= 5")
def live_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live message carries of each session: some rows, short texts, tool calls without text too."""
    by = W.partitionBy("session")
    rows = events(spark, sf_dir).where("role <> '' and (text <> '' or tools <> '[]')").withColumn("n", F.count(F.lit(1)).over(by)).withColumn("i", F.row_number().over(by.orderBy("line_no")))
    short = truncated(F.col("text"), 280)
    return rows.where("i <= 5").select("id", "session", "role", (short != F.col("text")).alias("cut"), F.when(short == F.col("text"), short).alias("whole"), (F.col("n") > 5).alias("truncated"))


@query("live_filter", STORE_SQL + "SELECT id FROM ev WHERE role IN ('user', 'assistant') AND (length(text) >= 20 OR tools <> '[]')")
def live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("role in ('user', 'assistant') and (length(text) >= 20 or tools <> '[]')").select("id")


@query("retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    cutoff = rows.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("cutoff"))
    return ingest.retained(rows.join(F.broadcast(cutoff)), F.col("cutoff"), "ts").select("event_id")  # cutoff: one row


@query("delete_ids", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.without_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("upsert_rows", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0 OR doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 2, 2 FROM documents WHERE doc_id % 3 = 0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("quality"), F.lit(2).alias("toxic"))
    return ingest.upsert(table(spark, sf_dir, "labels"), fresh, ["doc_id"])


@query("coerced_records", "SELECT event_id AS id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(event_type, '') AS type, value > 50 AS flag, props AS raw FROM events")
def coerced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose records in a fixed schema: numbers from strings, blanks for nulls, JSON kept as text, other fields dropped."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)).cast("long").alias("k"), F.coalesce("event_type", F.lit("")).alias("type"), (F.col("value") > 50).alias("flag"), F.col("props").alias("raw"))


@query("set_union", "SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'error'")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.where("event_type in ('purchase', 'error')").select("user_id").distinct()


@query("set_intersection", "SELECT user_id, event_type FROM events WHERE value > 20 INTERSECT SELECT user_id, event_type FROM events WHERE value < 5")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    # one aggregate in place of two scans and a join
    return rows.groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 20).alias("a"), F.bool_or(F.col("value") < 5).alias("b")).where("a and b").select("user_id", "event_type")


@query("pull_with_rewind", "WITH c AS (SELECT max(ts) - INTERVAL 1 DAY AS cursor FROM events) SELECT event_id, ts FROM events, c WHERE ts >= cursor - INTERVAL 2 SECOND ORDER BY ts, event_id LIMIT 1000")
def pull_with_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of changes from two seconds before the cursor; the overlap is absorbed by an upsert."""
    rows = table(spark, sf_dir, "events")
    cursor = rows.agg((F.max("ts") - F.expr("INTERVAL 1 DAY 2 SECONDS")).alias("cursor"))
    return rows.join(F.broadcast(cursor), F.col("ts") >= F.col("cursor")).select("event_id", "ts").orderBy("ts", "event_id").limit(1000)


@query("lanes_with_incumbents", """WITH c AS (SELECT user_id, count(*) AS n, user_id % 2 = 0 AS shown FROM events GROUP BY 1), t AS (SELECT user_id FROM c ORDER BY n DESC, shown DESC, user_id LIMIT 7)
SELECT CASE WHEN t.user_id IS NULL THEN 'other' ELSE CAST(t.user_id AS VARCHAR) END AS lane, count(*) AS n FROM events e LEFT JOIN t USING (user_id) GROUP BY 1""")
def lanes_with_incumbents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest lanes and the rest; of equally busy ones those that are shown already stay."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), (F.col("user_id") % 2 == 0).cast("int").desc(), "user_id").limit(7).select("user_id", F.col("user_id").cast("string").alias("lane"))
    return counts.join(F.broadcast(top), "user_id", "left").groupBy(F.coalesce("lane", F.lit("other")).alias("lane")).agg(F.sum("n").alias("n"))


@query("ring_buffer", "SELECT event_id, ts FROM (SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 256) WHERE event_id > (SELECT max(event_id) - 100 FROM events)")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader that saw all but the last hundred gets from a ring of the newest 256."""
    ring = table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("event_id")).limit(256)
    last = ring.agg((F.max("event_id") - 100).alias("seen"))
    return ring.join(F.broadcast(last), F.col("event_id") > F.col("seen")).select("event_id", "ts")


def _batch(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """A batch of events in file order: turns as lines; text ends where its line ends."""
    ev = events(spark, sf_dir)
    size = F.octet_length("text") + 1
    end = F.sum(size).over(W.partitionBy("session").orderBy("line_no")).cast("long")
    rows = ev.withColumn("end_offset", end).where(where)
    return rows.select(F.concat(F.lit("/logs/"), "session", F.lit(".jsonl")).alias("path"), "project", "session", F.col("id").cast("string").alias("uuid"), "ts", "iso_week", "role", "text", "tools", F.lit("m").alias("model"), F.concat(F.lit("/srv/"), "project", F.when(F.col("line_no") == 1, F.lit("")).otherwise(F.lit("/sub"))).alias("cwd"), F.lit("main").alias("git_branch"), "line_no", "end_offset")


def ingested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables after two batches that overlap, as a replay does; the second also brings a file that claims others' sessions."""
    first = ingest.apply(_batch(spark, sf_dir, "line_no < 4"))
    again = _batch(spark, sf_dir, "line_no >= 2")
    thief = _batch(spark, sf_dir, "line_no >= 2 and session % 7 = 0").withColumn("path", F.lit("/other.jsonl")).withColumn("uuid", F.concat(F.lit("x"), "uuid"))
    nameless = _batch(spark, sf_dir, "session % 5 = 0 and line_no = 2").withColumn("uuid", F.lit("")).withColumn("end_offset", F.lit(0).cast("long"))
    return ingest.apply(again.unionByName(thief).unionByName(nameless), first, F.lit("2024-02-01").cast("timestamp_ntz"))


@query("ingest_ledger", STORE_SQL + "SELECT session, iso_week, count(*) AS event_count, count(*) FILTER (role = 'user') AS user_count, count(*) FILTER (role = 'assistant') AS assistant_count, count(*) FILTER (tools <> '[]') AS tool_count, min(ts) AS first_ts, max(ts) AS last_ts FROM ew GROUP BY 1, 2")
def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir)["session_weeks"]


@query("ingest_sessions", STORE_SQL + "SELECT session, '/logs/' || session || '.jsonl' AS path, se.project, sum(strlen(text) + 1)::BIGINT AS byte_offset, se.first_ts, se.last_ts, se.event_count, se.first_prompt FROM se JOIN ev USING (session) GROUP BY ALL")
def ingest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir)["sessions"].select("session", "path", "project", "byte_offset", "first_ts", "last_ts", "event_count", "first_prompt")


@query("ingest_report", STORE_SQL + """, o AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY session ORDER BY line_no)::BIGINT AS end_offset FROM ev),
a AS (SELECT session, '/logs/' || session || '.jsonl' AS path, true AS accepted, count(*) FILTER (line_no >= 2) + CASE WHEN session % 5 = 0 THEN count(*) FILTER (line_no = 2) ELSE 0 END AS lines, count(*) FILTER (line_no >= 4) AS inserted,
 CASE WHEN session % 5 = 0 THEN count(*) FILTER (line_no = 2) ELSE 0 END AS skipped, coalesce(max(end_offset) FILTER (line_no < 4), 0) AS from_offset, max(end_offset) FILTER (line_no >= 2) AS to_offset FROM o GROUP BY 1 HAVING count(*) FILTER (line_no >= 2) > 0),
b AS (SELECT session, '/other.jsonl' AS path, false AS accepted, count(*) AS lines, 0 AS inserted, 0 AS skipped, 0 AS from_offset, max(end_offset) AS to_offset FROM o WHERE line_no >= 2 AND session % 7 = 0 GROUP BY 1)
SELECT session, path, accepted, lines, inserted, skipped, to_offset, CASE WHEN accepted THEN from_offset END AS from_offset FROM a UNION ALL BY NAME SELECT session, path, accepted, lines, inserted, skipped, to_offset, NULL AS from_offset FROM b""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir)["report"].select("session", "path", "accepted", "lines", "inserted", "skipped", "to_offset", F.when(F.col("accepted"), F.col("from_offset")).alias("from_offset"))


@query("ingest_projects", STORE_SQL + "SELECT project, CASE WHEN bool_or(line_no = 1) THEN '/srv/' || project ELSE '/srv/' || project || '/sub' END AS cwd, CASE WHEN bool_or(line_no = 1) THEN project::VARCHAR ELSE 'sub' END AS name FROM ev GROUP BY 1")
def ingest_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir)["projects"].select("project", "cwd", "name")


@query("ingest_conflicts", STORE_SQL + """, o AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY session ORDER BY line_no)::BIGINT AS end_offset FROM ev),
h AS (SELECT session, max(end_offset) AS have FROM o WHERE line_no < 3 GROUP BY 1),
b AS (SELECT session, min(end_offset - strlen(text) - 1)::BIGINT AS want, max(end_offset) AS to_offset, count(*) AS n FROM o WHERE line_no >= CASE session % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END GROUP BY 1)
SELECT session, CASE WHEN have = want THEN 'accepted' ELSE 'conflict' END AS outcome, have, want, CASE WHEN have = want THEN n ELSE 0 END AS inserted, CASE WHEN have = want THEN to_offset ELSE have END AS byte_offset FROM b JOIN h USING (session)""")
def ingest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch goes on where the first one ended, leaves lines out, or brings some again: only the first is taken."""
    start = F.col("end_offset") - F.octet_length("text") - 1
    lines = lambda where: _batch(spark, sf_dir, where).withColumn("start_offset", start).withColumn("generation", F.lit(0))
    out = ingest.apply(lines("line_no >= CASE session % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END"), ingest.apply(lines("line_no < 3")), F.lit("2024-02-01").cast("timestamp_ntz"))
    return out["report"].select("session", "outcome", "have", "want", "inserted").join(out["sessions"].select("session", "byte_offset"), "session")


@query("live_cut_rows", STORE_SQL + """, v AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_no, id) AS nth, count(*) OVER (PARTITION BY session) AS n FROM ev WHERE role <> '' AND (text <> '' OR tools <> '[]'))
SELECT v.session, nth, id::VARCHAR AS uuid, substr(text, 1, CASE WHEN strlen(text) <= 280 THEN length(text) ELSE len(list_filter(range(1, 281), lambda i: i <= length(text) AND strlen(substr(text, 1, i)) <= 280)) END) AS text, '/srv/' || project AS project_path, n > 5 AS truncated FROM v WHERE nth <= 5""")
def live_cut_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live message carries of a batch after its commit, its texts cut between characters, with the projects looked up."""
    out = ingest.apply(_batch(spark, sf_dir, "true"), None, F.lit("2024-02-01").cast("timestamp_ntz"))
    return ingest.live_rows(out["inserted"], out["sessions"], out["projects"], 5).select("session", F.col("nth").cast("long"), "uuid", "text", "project_path", "truncated")


@query("submit_batches", """WITH r AS (SELECT user_id::VARCHAR AS path, event_type, row_number() OVER w AS line_no, sum(octet_length(encode(props)) + 1) OVER w AS line_end FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT path, line_no, line_end, (row_number() OVER (PARTITION BY path ORDER BY line_no) - 1) // 50 AS batch FROM r WHERE event_type <> 'view'),
b AS (SELECT path, batch, count(*) AS events, max(line_no) AS l, max(line_end) AS e FROM k GROUP BY 1, 2), w AS (SELECT path, max(line_no) AS l, max(line_end) AS e FROM r GROUP BY 1),
j AS (SELECT w.path, coalesce(batch, 0) AS batch, coalesce(events, 0) AS events, CASE WHEN lead(batch) OVER p IS NULL THEN w.l ELSE b.l END AS l, CASE WHEN lead(batch) OVER p IS NULL THEN w.e ELSE b.e END AS e FROM w LEFT JOIN b USING (path) WINDOW p AS (PARTITION BY w.path ORDER BY batch))
SELECT path, batch::BIGINT AS batch, events, (l - coalesce(lag(l) OVER q, 0))::BIGINT AS lines, coalesce(lag(e) OVER q, 0)::BIGINT AS start_offset, e::BIGINT AS next_offset FROM j WINDOW q AS (PARTITION BY path ORDER BY batch)""")
def submit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events are one file's lines; views stand for lines that are not events."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    end = F.sum(F.octet_length("props") + 1).over(by).cast("long")
    lines = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.row_number().over(by).cast("long").alias("line_no"), end.alias("end_offset"), "event_type")
    return transcripts.batches(lines, lines.where("event_type <> 'view'"), 50)


@query("lanes_reranked", """WITH RECURSIVE c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, date_trunc('minute', ts) + INTERVAL 1 MINUTE * j AS moment, event_type AS lane, count(*) AS n FROM events, (SELECT unnest(range(1, 11)) AS j) GROUP BY ALL),
s AS (SELECT day, moment, list({'less': -n, 'lane': lane}) AS seen, row_number() OVER (PARTITION BY day ORDER BY moment) AS i FROM c GROUP BY day, moment),
f AS (SELECT DISTINCT day, 0::BIGINT AS i, NULL::TIMESTAMP AS moment, []::VARCHAR[] AS lanes, false AS moved FROM s UNION ALL
SELECT day, i, moment, CASE WHEN len(filled) = len(held) AND list_has_all(held, filled) THEN held ELSE filled END, NOT (len(filled) = len(held) AND list_has_all(held, filled)) FROM (SELECT day, i, moment, held, list_slice(list_concat(want, list_filter(held, lambda x: NOT list_contains(want, x))), 1, 2) AS filled FROM (
SELECT s.day, s.i, s.moment, lanes AS held, list_transform(list_slice(list_sort(list_transform(seen, lambda x: {'less': x.less, 'fresh': NOT list_contains(lanes, x.lane), 'lane': x.lane})), 1, 2), lambda x: x.lane) AS want FROM f JOIN s ON s.day = f.day AND s.i = f.i + 1)))
SELECT day, moment, array_to_string(lanes, ',') AS lanes FROM f WHERE moved""")
def lanes_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named lanes, reranked each minute over ten minutes; each day is a view opened at midnight."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_type")
    return lanes.reranked(rows, "day", "ts", "event_type", 2)


_BAD = r"[<\r:]|(?i)always|ignore|disregard|end every|from now on|new instruction|you are now"
_ONE = r"trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_SHOWN = f"chr(10) || '{{0}}:' || chr(10) || array_to_string(list_transform(list_slice({{1}}, 1, 3), lambda t: '- ' || CASE WHEN length({_ONE.format('t')}) <= 160 THEN {_ONE.format('t')} ELSE rtrim(substr({_ONE.format('t')}, 1, 158)) || ' …' END), chr(10))"


@query("reduce_budget", STORE_SQL + f""", d AS (SELECT session, min(iso_week) AS iso_week, coalesce(arg_min(text, line_no) FILTER (role = 'assistant'), '') AS summary, coalesce(list(text ORDER BY line_no) FILTER (role = 'user' AND text <> ''), []) AS asked, coalesce(list(text ORDER BY line_no) FILTER (role = 'assistant' AND text <> ''), []) AS told
FROM ew WHERE NOT regexp_matches(text, '{_BAD}') GROUP BY 1),
b AS (SELECT session, iso_week, row_number() OVER (PARTITION BY iso_week ORDER BY session) AS n, trim('summary: ' || {_ONE.format("summary")} || CASE WHEN len(asked) > 0 THEN {_SHOWN.format("decisions", "asked")} ELSE '' END || CASE WHEN len(told) > 0 THEN {_SHOWN.format("open", "told")} ELSE '' END) AS body FROM d),
p AS (SELECT session, iso_week, n, '<digest n=' || n || ' s' || session || '>' || chr(10) || CASE WHEN length(body) > 2400 THEN substr(body, 1, 2400) || ' …' ELSE body END || chr(10) || '</digest>' || chr(10) AS piece FROM b),
z AS (SELECT *, sum(length(piece)) OVER (PARTITION BY iso_week ORDER BY n) AS spent FROM p)
SELECT iso_week, n, session, piece FROM z WHERE spent <= 24000 OR n = 1""")
def reduce_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of sessions: the first answer is a digest's summary, questions and answers its sections."""
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == role) & (F.col("text") != ""), F.struct("line_no", "text")))), lambda x: x["text"])
    rows = events(spark, sf_dir).where(~F.col("text").rlike(_BAD))
    answer = F.when(F.col("role") == "assistant", F.col("line_no"))
    by = rows.withColumn("answer", answer).groupBy("session").agg(F.min("iso_week").alias("iso_week"), F.min_by("text", "answer").alias("summary"), said("user").alias("asked"), said("assistant").alias("told"))
    sections = F.array(F.struct(F.lit("decisions").alias("name"), F.col("asked").alias("bullets")), F.struct(F.lit("open").alias("name"), F.col("told").alias("bullets")))
    digests = by.select("session", "iso_week", F.array(F.concat(F.lit("s"), "session")).alias("meta"), "summary", sections.alias("sections"))
    return reduction.within_budget(digests, "iso_week", "session", [F.col("session")])


@query("newest_events", "SELECT event_id, ts, event_type, props FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 500")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 of some kinds: times first, then whole rows of these alone."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id", "ts", "event_type", "props")
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return replay.newest(rows, 500, now, "ts", "event_id")


@query("newest_widened", STORE_SQL + "SELECT id, session, ts, role, text FROM ev WHERE role = 'system' OR session % 50 = 3 ORDER BY ts DESC, id DESC LIMIT 60")
def newest_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are rare enough for the first windows to fall short."""
    ev = events(spark, sf_dir)
    now = ev.agg(F.max("ts")).first()[0]
    return replay.newest(ev.where("role = 'system' or session % 50 = 3").select("id", "session", "ts", "role", "text"), 60, now)


@query(
    "replay_window",
    STORE_SQL.replace("WITH ev", "WITH RECURSIVE ev") + """, v AS (SELECT *, (SELECT max(ts) FROM ev) AS now FROM ev WHERE role IN ('user', 'assistant') AND (length(text) >= 20 OR tools <> '[]')),
r AS (SELECT 0 AS i, 10080::BIGINT AS m, NULL::BIGINT AS got_m, NULL::BIGINT AS got_n, false AS done UNION ALL
SELECT i + 1, CASE WHEN n > 0 THEN greatest(1, floor(m * 40 / n * 0.8::DOUBLE))::BIGINT ELSE m END, CASE WHEN i > 0 AND n = 0 THEN got_m ELSE m END, CASE WHEN i > 0 AND n = 0 THEN got_n ELSE n END, (i > 0 AND n = 0) OR n <= 40 OR i >= 4 OR m <= 1
FROM (SELECT *, (SELECT count(*) FROM v WHERE ts >= now - INTERVAL 1 MINUTE * m) AS n FROM r WHERE NOT done)),
w AS (SELECT got_m FROM r WHERE done),
p AS (SELECT v.* FROM v, w WHERE ts >= now - INTERVAL 1 MINUTE * got_m ORDER BY ts DESC, id DESC LIMIT 40)
SELECT id, p.session, CASE WHEN p.session % 10 = 3 THEN p.session::VARCHAR ELSE 's-' || p.session END AS session_name, coalesce(CASE WHEN p.session % 10 <> 3 THEN path END, '') AS project_path, p.ts,
CASE WHEN lead(p.ts) OVER (ORDER BY p.ts, id) IS NOT NULL THEN least(2500, greatest(40, date_diff('microsecond', p.ts, lead(p.ts) OVER (ORDER BY p.ts, id)) / 1000 / 10::DOUBLE)) END AS wait_ms FROM p LEFT JOIN pr USING (project)""",
)
def replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week, narrowed until some forty rows are left, with the names of those sessions that are known."""
    ev = events(spark, sf_dir)
    now = F.lit(ev.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    rows = ev.where("role in ('user', 'assistant') and (length(text) >= 20 or tools <> '[]')").select("id", "session", "ts")
    names = sessions(ev).where("session % 10 <> 3").select("session", F.concat(F.lit("s-"), "session").alias("session_name"), "project")
    out = replay.played(rows, replay.narrowed(rows, now, 10_080, 40), now, names, projects(spark, sf_dir), 40)
    return out.select("id", "session", "session_name", "project_path", "ts", "wait_ms")


_ATTEMPTS = "count(*) FILTER (role = 'assistant' AND length(text) >= 300)"


@query("digest_outcomes", STORE_SQL + f""", n AS (SELECT session, iso_week, count(*) AS event_count, count(*) FILTER (line_no < 5) AS then_count, {_ATTEMPTS} AS attempts, bool_or(tools <> '[]') AS cached FROM ew GROUP BY 1, 2)
SELECT session, iso_week, event_count, CASE WHEN cached AND then_count = event_count THEN 'reused' WHEN attempts >= 3 THEN 'gave_up' ELSE 'todo' END AS outcome FROM n""")
def digest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(spark, sf_dir)


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by week: the cache has those with a tool, as of their first lines; long answers are replies that were no JSON."""
    by = events(spark, sf_dir).groupBy("session", "iso_week").agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("line_no") < 5).alias("then_count"), F.count_if((F.col("role") == "assistant") & (F.length("text") >= 300)).alias("attempts"), F.bool_or(F.col("tools") != "[]").alias("cached"))
    cache = by.where("cached").select("session", "iso_week", F.col("then_count").alias("event_count"))
    tries = by.select("session", "iso_week", "event_count", "attempts")
    return digests.outcomes(by.select("session", "iso_week", "event_count"), cache, tries)


@query("digest_counters", STORE_SQL + f""", n AS (SELECT session, iso_week, count(*) AS event_count, count(*) FILTER (line_no < 5) AS then_count, {_ATTEMPTS} AS attempts, bool_or(tools <> '[]') AS cached FROM ew GROUP BY 1, 2)
SELECT iso_week, count(*) FILTER (cached AND then_count = event_count) AS reused, count(*) FILTER (NOT (cached AND then_count = event_count) AND attempts >= 3) AS gave_up, count(*) FILTER (NOT (cached AND then_count = event_count) AND attempts < 3) AS todo FROM n GROUP BY 1""")
def digest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.counters(_digests(spark, sf_dir), "iso_week")


@query("live_cards", STORE_SQL + r""", m AS (SELECT max(ts) AS now FROM ev), c AS (SELECT *, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t, date_diff('second', ts, now) AS age FROM ev, m WHERE id % 7 <> 6)
SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000Z' AS stamp, CASE WHEN age < 60 THEN age || ' s ago' WHEN age < 3600 THEN floor(age / 60 + 0.5::DOUBLE)::BIGINT || ' m ago' ELSE floor(age / 3600 + 0.5::DOUBLE)::BIGINT || ' h ago' END AS ago,
CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '…' ELSE t END AS text, CASE WHEN tools = '[]' THEN '' ELSE 'run' END AS tools FROM c""")
def live_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as cards: stamps of any format read and written anew, those that are none left out, age, one line of text, names of tools."""
    ev = events(spark, sf_dir)
    form = lambda x: F.date_format("ts", x)
    kind = F.col("id") % 7
    written = F.when(kind == 0, form("yyyy-MM-dd HH:mm:ss.SSS'Z'")).when(kind == 1, form("yyyy-MM-dd HH:mm:ss'Z'")).when(kind == 2, form("yyyy-MM-dd HH:mm:ss.S")).when(kind == 3, form("yyyy-MM-dd HH:mm:ss")).when(kind == 4, form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(kind == 5, F.concat(F.lit(" "), form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n"))).otherwise(form("dd.MM.yyyy HH:mm"))
    rows = ev.withColumn("ts", stamp(written)).where("ts is not null").join(F.broadcast(ev.agg(F.max("ts").alias("now"))))  # one row
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000
    line = one_line(F.col("text"))
    names = F.array_join(F.from_json("tools", "array<string>"), ", ")
    return rows.select("id", stamped(F.col("ts")).alias("stamp"), ago(age).alias("ago"), F.when(F.length(line) > 160, F.concat(F.substring(line, 1, 160), F.lit("…"))).otherwise(line).alias("text"), names.alias("tools"))
