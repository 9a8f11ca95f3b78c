"""Registered queries over the given tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import markdown, sandbox
from weftline.functions.text import contains_literal, truncated
from weftline.functions.times import iso_week, local_day
from weftline.operators import ranking, sampling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "week_ledger",
    """SELECT user_id AS session, strftime(ts + INTERVAL 7 HOUR, '%G-W%V') AS iso_week, count(*) AS event_count,
    count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (props <> '' AND props <> '{}') AS tool_count,
    min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""",
)
def week_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("session"), iso_week(F.col("ts")).alias("iso_week"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(F.col("event_type") == "view").alias("view_count"),
            F.count_if((F.col("props") != "") & (F.col("props") != "{}")).alias("tool_count"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    "status_weeks",
    """SELECT iso_week, count(DISTINCT user_id) AS sessions, count(*) AS events, count(*) FILTER (event_type = 'view') AS views
    FROM (SELECT *, strftime(ts + INTERVAL 7 HOUR, '%G-W%V') AS iso_week FROM events) GROUP BY 1 ORDER BY 1 DESC LIMIT 16""",
)
def status_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _events(spark, sf_dir).groupBy("user_id", iso_week(F.col("ts")).alias("iso_week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("v"))
    return ledger.groupBy("iso_week").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.sum("v").alias("views")).orderBy(F.desc("iso_week")).limit(16)


@query("status_totals", "SELECT count(*) AS events, count(DISTINCT user_id) AS sessions, max(ts) AS last_ts, min(ts) AS first_ts FROM events")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("sessions"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"))


@query(
    "day_activity",
    """SELECT CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, user_id AS session, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases,
    min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, (ts, event_id)) AS preview FROM events GROUP BY 1, 2""",
)
def day_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .groupBy(local_day(F.col("ts")).alias("day"), F.col("user_id").alias("session"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min_by("event_type", F.struct("ts", "event_id")).alias("preview"),
        )
    )


@query(
    "project_totals",
    """SELECT c_custkey AS project, count(o_orderkey) AS sessions, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS total, max(o_orderdate) AS last_ts
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def project_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy(F.col("c_custkey").alias("project")).agg(F.count("o_orderkey").alias("sessions"), F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("total"), F.max("o_orderdate").alias("last_ts"))


@query("search_substring", "SELECT conv_id, turn, role, substr(text, 1, 600) AS snippet FROM conversations WHERE contains(lower(text), 'the') AND role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 200")
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "conversations").where(contains_literal(F.col("text"), "THE") & (F.col("role") == "user"))
    return hits.select("conv_id", "turn", "role", F.substring("text", 1, 600).alias("snippet")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(200)


@query("search_literal_wildcards", "SELECT doc_id, source FROM documents WHERE contains(lower(text), '%%') AND NOT contains(text, '_')")
def search_literal_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").where(contains_literal(text, "%%") & ~contains_literal(text, "_")).select("doc_id", "source")


@query("read_session", "SELECT conv_id, turn, role, substr(text, 1, 4000) AS text FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations) AND role <> '' AND text <> '' ORDER BY turn LIMIT 100 OFFSET 1")
def read_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    last = rows.agg(F.max("conv_id").alias("conv_id"))
    return rows.where("role <> '' and text <> ''").join(F.broadcast(last), "conv_id", "left_semi").select("conv_id", "turn", "role", F.substring("text", 1, 4000).alias("text")).orderBy("turn").offset(1).limit(100)


@query("resolve_prefix", "SELECT p AS prefix, count(c_name) AS matches, CASE count(c_name) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS outcome FROM (VALUES ('customer#0000000'), ('customer#000000001'), ('zzz'), ('%')) v(p) LEFT JOIN customer ON starts_with(lower(c_name), p) GROUP BY 1")
def resolve_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"))
    asked = ("customer#0000000", "customer#000000001", "zzz", "%")
    counts = names.agg(*[F.count_if(F.col("name").startswith(p)).alias(str(i)) for i, p in enumerate(asked)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(str(i)).alias("matches")) for i, p in enumerate(asked)])).alias("r")).select("r.*")
    return rows.withColumn("outcome", F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "one").otherwise("ambiguous"))


@query("list_sessions_in_week", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE user_id IN (SELECT user_id FROM events WHERE strftime(ts + INTERVAL 7 HOUR, '%G-W%V') = '2024-W02') GROUP BY 1")
def list_sessions_in_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    week = events.where(iso_week(F.col("ts")) == "2024-W02").select("user_id")
    return events.join(week, "user_id", "left_semi").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "ledger_by_session",
    """SELECT o_custkey AS project, n_name, user_id AS session, iso_week, event_count FROM (SELECT user_id, strftime(ts + INTERVAL 7 HOUR, '%G-W%V') AS iso_week, count(*) AS event_count FROM events GROUP BY 1, 2)
    JOIN (SELECT o_orderkey, o_custkey FROM orders) ON o_orderkey = user_id LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def ledger_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _events(spark, sf_dir).groupBy(F.col("user_id").alias("session"), iso_week(F.col("ts")).alias("iso_week")).agg(F.count(F.lit(1)).alias("event_count"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers, nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = ledger.join(orders, F.col("o_orderkey") == F.col("session")).join(customers, F.col("c_custkey") == F.col("o_custkey"), "left").join(nations, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select(F.col("o_custkey").alias("project"), "n_name", "session", "iso_week", "event_count")


@query("pending_bytes", "SELECT source, count(*) AS files, count(*) FILTER (n_chars > 500) AS pending, sum(CASE WHEN n_chars > 500 THEN n_chars - 500 ELSE 0 END)::BIGINT AS pending_chars, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def pending_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("n_chars") > 500
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(late).alias("pending"), F.sum(F.when(late, F.col("n_chars") - 500).otherwise(0)).cast("long").alias("pending_chars"), F.sum(F.octet_length("text")).alias("bytes"))


@query("writers_activity", "SELECT event_type AS writer, max(ts) AS last_seen, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS runs_24h, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def writers_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    now = events.agg(F.max("ts").alias("now"))
    recent = F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS")
    return events.join(F.broadcast(now)).groupBy(F.col("event_type").alias("writer")).agg(F.max("ts").alias("last_seen"), F.count_if(recent).alias("runs_24h"), F.countDistinct("user_id").alias("sessions"))


@query("hosts_list", "SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS hosts FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def hosts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("hosts"))


@query("dedup_first_wins", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("uuid")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("uuid")


@query("anti_pending", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "hash_diff",
    """WITH old AS (SELECT doc_id, substr(sha256(substr(text, 1, 2000)), 1, 16) AS h FROM documents WHERE doc_id % 3 <> 0),
    new AS (SELECT doc_id, substr(sha256(substr(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END, 1, 2000)), 1, 16) AS h FROM documents WHERE doc_id % 7 <> 0)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS outcome FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""",
)
def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = lambda text: F.substring(F.sha2(F.substring(text, 1, 2000), 256), 1, 16)
    old = docs.where("doc_id % 3 <> 0").select("doc_id", name(F.col("text")).alias("old"))
    new = docs.where("doc_id % 7 <> 0").select("doc_id", name(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("new"))
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return old.join(new, "doc_id", "full_outer").select("doc_id", outcome.alias("outcome"))


@query("reconcile_shortest", "SELECT p_brand AS project, arg_min(p_name, (length(p_name), p_name)) AS cwd FROM part WHERE p_name <> '' GROUP BY 1")
def reconcile_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_name <> ''").groupBy(F.col("p_brand").alias("project")).agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("cwd"))


@query(
    "session_fold",
    """SELECT conv_id AS session, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS event_count, substr(arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> ''), 1, 300) AS first_prompt, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1""",
)
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("asked", asked)
    return rows.groupBy(F.col("conv_id").alias("session")).agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("event_count"), F.substring(F.min_by("text", "asked"), 1, 300).alias("first_prompt"), F.max_by("role", "turn").alias("last_role"))


@query("jsonl_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, sum(CAST(value * 100 AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1")
def jsonl_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


BM25_SQL = r"""WITH t0 AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 0) AS w FROM documents),
f AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'idiot')) AS a, len(list_filter(w, lambda x: x = 'trash')) AS b FROM t0),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f),
r AS (SELECT doc_id, round(CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) ELSE 0 END
 + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) ELSE 0 END, 9) AS score FROM f, s WHERE a > 0 OR b > 0) """


@query("bm25_documents", BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM r")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(table(spark, sf_dir, "documents"), ["idiot", "trash"]).select("doc_id", F.round("score", 6).alias("score"))


@query("relevance_floor", BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM r WHERE score >= 0.5 * (SELECT max(score) FROM r)")
def relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.relevance_floor(ranking.bm25(table(spark, sf_dir, "documents"), ["idiot", "trash"])).select("doc_id", F.round("score", 6).alias("score"))


_KNN = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, label, round(1 - list_inner_product(embedding::DOUBLE[], q) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(q, q)), 6) + 0.0::DOUBLE AS distance FROM embeddings, q) """


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query("knn_cosine", _KNN + "SELECT vec_id, distance FROM d ORDER BY distance, vec_id LIMIT 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10)


@query("knn_where", _KNN + "SELECT vec_id, distance FROM d WHERE label = 1 ORDER BY distance, vec_id LIMIT 10")
def knn_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.knn(table(spark, sf_dir, "embeddings").where("label = 1"), _query_vector(spark, sf_dir), 10)


@query(
    "rrf_hybrid",
    BM25_SQL.rstrip() + ", " + _KNN.replace("WITH q AS", "q AS").rstrip() + """, v AS (SELECT vec_id, distance FROM d ORDER BY distance, vec_id LIMIT 20), t AS (SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 20),
    u AS (SELECT vec_id AS doc_id, 1.0::DOUBLE / (59 + row_number() OVER (ORDER BY distance, vec_id)) AS part FROM v UNION ALL SELECT doc_id, 1.0::DOUBLE / (59 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM t)
    SELECT doc_id, round(sum(part), 9) AS score FROM u GROUP BY 1""",
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ranking.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20).withColumnRenamed("vec_id", "doc_id")
    text = ranking.bm25(table(spark, sf_dir, "documents"), ["idiot", "trash"]).orderBy(F.desc("score"), "doc_id").limit(20)
    return ranking.fuse([(near, 1.0), (text, 1.0)], "doc_id", [[F.col("distance"), F.col("doc_id")], [F.desc("score"), F.col("doc_id")]])


@query(
    "stratify_round_robin",
    """WITH s AS (SELECT event_type AS project, user_id AS session, count(*) AS events, sum(CAST(value * 100 AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY events DESC, cents DESC, session) AS pick FROM s),
    h AS (SELECT project, row_number() OVER (ORDER BY events DESC, cents DESC, session, project) AS group_rank FROM r WHERE pick = 1)
    SELECT project, session, events, cents, pick, group_rank FROM r JOIN h USING (project) ORDER BY pick, group_rank, session LIMIT 40""",
)
def stratify_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _events(spark, sf_dir).groupBy(F.col("event_type").alias("project"), F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return sampling.stratify(sessions, "project", [F.desc("events"), F.desc("cents"), F.col("session")], "session", 40)


@query(
    "evenly_spaced",
    """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, turn, role FROM r WHERE n <= 3 OR i IN (0, round_even((n - 1) / 2.0, 0)::BIGINT, n - 1)""",
)
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], 3)


@query(
    "horizon_buckets",
    """SELECT CASE WHEN age <= 7 * 86400 THEN 'short' WHEN age <= 30 * 86400 THEN 'month' WHEN age <= 90 * 86400 THEN 'quarter' ELSE 'archive' END AS horizon, count(*) AS n
    FROM (SELECT epoch(TIMESTAMP '2024-02-05') - floor(epoch(ts)) AS age FROM events) GROUP BY 1""",
)
def horizon_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(sampling.horizon(F.col("ts"), F.lit("2024-02-05").cast("timestamp")).alias("horizon")).agg(F.count(F.lit(1)).alias("n"))


@query("events_per_minute", "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def events_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "lane_topk_other",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT user_id FROM c ORDER BY n DESC, user_id LIMIT 7)
    SELECT CASE WHEN t.user_id IS NULL THEN 'other' ELSE CAST(t.user_id AS VARCHAR) END AS lane, count(*) AS n FROM events e LEFT JOIN t USING (user_id) GROUP BY 1""",
)
def lane_topk_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "user_id").limit(7).select("user_id", F.col("user_id").cast("string").alias("lane"))
    return counts.join(F.broadcast(top), "user_id", "left").groupBy(F.coalesce("lane", F.lit("other")).alias("lane")).agg(F.sum("n").alias("n"))


@query(
    "replay_gaps",
    """SELECT user_id, event_id, least(2500, greatest(40, coalesce(date_sub('millisecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts), 0) // 600)) AS wait_ms FROM events""",
)
def replay_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.coalesce(F.timestamp_diff("MILLISECOND", before, F.col("ts")), F.lit(0))
    return _events(spark, sf_dir).select("user_id", "event_id", F.least(F.lit(2500), F.greatest(F.lit(40), F.floor(gap / 600))).cast("long").alias("wait_ms"))


@query("stale_keys", "SELECT doc_id FROM documents LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR n_chars > 1000 * (1 + quality)")
def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left").where(F.col("known").isNull() | (F.col("n_chars") > 1000 * (1 + F.col("quality")))).select("doc_id")


@query("keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' OR (o_orderdate = TIMESTAMP '1995-01-01' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1995-01-01").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.where((F.col("o_orderdate") > at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") > 100))).orderBy("o_orderdate", "o_orderkey").limit(1000)


@query("rows_page_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def rows_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(sandbox.predicate("o_orderstatus = 'F'"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.select(*sandbox.columns("o_orderkey, o_totalprice")).orderBy("o_orderkey").offset(100).limit(50).join(F.broadcast(total))


@query("truncate_utf8", "SELECT doc_id, strlen(text) > 300 AS cut, CASE WHEN strlen(text) <= 300 THEN length(text) END AS whole_chars FROM documents")
def truncate_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = truncated(F.col("text"), 300)
    return table(spark, sf_dir, "documents").select("doc_id", (cut != F.col("text")).alias("cut"), F.when(cut == F.col("text"), F.length(cut)).cast("long").alias("whole_chars"))


@query("instruction_lines", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\s*(Licensed|TOKEN)\b'))) AS dropped FROM documents")
def instruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*(Licensed|TOKEN)\b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("dropped"))


@query("markdown_sections")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: every section and part of them; rules are tested on fixtures."""
    return markdown.sections(table(spark, sf_dir, "documents"), "doc_id", "text")
