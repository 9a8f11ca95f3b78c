"""Registered queries of digests, topics, lanes and intake, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import DUMP_LINE, tool_output
from weftline.functions.times import iso_week
from weftline.operators import ingest, ranking, sampling
from weftline.plans.console import BM25_SQL, query, table

TERMS = ["idiot", "trash"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ranking.bm25(docs, TERMS).withColumn("score", F.round("score", 6)).join(docs.select("doc_id", "lang", "source", "text"), "doc_id")


@query("tool_output_filter", f"""WITH l AS (SELECT doc_id, list_slice(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1, 8) AS l FROM documents),
m AS (SELECT doc_id, len(l) AS n, list_transform(l, lambda x: regexp_matches(x, '{DUMP_LINE}')) AS m FROM l)
SELECT doc_id FROM m WHERE NOT (len(list_filter(m, lambda x: x)) >= 3 OR (coalesce(m[1], false) AND n > 1))""")
def tool_output_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(~tool_output(F.col("text"))).select("doc_id")


_SCORED = BM25_SQL.rstrip() + ", h AS (SELECT doc_id, round(score, 6) AS score, lang, source FROM r JOIN documents USING (doc_id)) "


@query("topic_material", _SCORED.rstrip() + f""", l AS (SELECT h.*, list_slice(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1, 8) AS l FROM h JOIN documents USING (doc_id)),
fl AS (SELECT * FROM (SELECT *, list_transform(l, lambda x: regexp_matches(x, '{DUMP_LINE}')) AS m FROM l) WHERE score >= 0.5 * (SELECT max(score) FROM h) AND NOT (len(list_filter(m, lambda x: x)) >= 3 OR (coalesce(m[1], false) AND len(l) > 1))),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id) AS pick, max(score) OVER (PARTITION BY lang, source) AS best FROM fl),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pick, best DESC, source) AS place FROM p WHERE pick <= 12)
SELECT doc_id, lang AS horizon, source, score, pick, place FROM q WHERE place <= 12""")
def topic_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ranking.relevance_floor(_scored(spark, sf_dir)).where(~tool_output(F.col("text"))).select("doc_id", F.col("lang").alias("horizon"), "source", "score")
    return sampling.topic_material(kept, "horizon", "source", "score", "doc_id", 48)


@query("wiki_head", _SCORED.rstrip() + """, k AS (SELECT doc_id, score, CASE WHEN lang = 'en' THEN 'event' ELSE 'wiki' END AS kind FROM h),
b AS (SELECT coalesce(max(score) FILTER (kind = 'event'), 0) AS best FROM k),
a AS (SELECT k.*, best, row_number() OVER (PARTITION BY kind ORDER BY score DESC, doc_id) AS rk FROM k, b),
t AS (SELECT *, CASE WHEN kind = 'event' AND rk <= 10 THEN 0 WHEN kind = 'wiki' AND (score > best OR (rk <= 2 AND score >= 0.5 * best)) THEN 0 WHEN kind = 'wiki' THEN 1 END AS tier FROM a),
o AS (SELECT doc_id, score, kind, row_number() OVER (ORDER BY tier, score DESC, kind, doc_id) AS place, count(*) FILTER (tier = 0) OVER () AS n FROM t WHERE tier IS NOT NULL)
SELECT doc_id, score, kind, place FROM o WHERE place <= greatest(10, n)""")
def wiki_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("lang") == "en", "event").otherwise("wiki")
    return ranking.head(_scored(spark, sf_dir).select("doc_id", "score", kinds.alias("kind")), "kind", "score", "doc_id", 10)


@query("snippet_window", """SELECT doc_id, substr(text, greatest(1, least(CASE WHEN instr(lower(text), 'idiot') > 0 THEN instr(lower(text), 'idiot') END, CASE WHEN instr(lower(text), 'trash') > 0 THEN instr(lower(text), 'trash') END) - 240), 900) AS snippet
FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'trash')""")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    hits = table(spark, sf_dir, "documents").where(F.contains(low, F.lit(TERMS[0])) | F.contains(low, F.lit(TERMS[1])))
    return hits.select("doc_id", ranking.snippet(F.col("text"), TERMS).alias("snippet"))


@query("term_frequencies", r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 0)) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY 1""")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


_BIN = ", ".join(f"round(coalesce(len(list_filter(b, lambda x: x = {i})) / nullif(n, 0), 0), 6) AS v{i}" for i in range(8))


@query("embed_fake_bag", f"""WITH c AS (SELECT conv_id, turn, list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x) % 8) AS b FROM conversations),
s AS (SELECT *, sqrt(list_sum(list_transform(range(8), lambda i: len(list_filter(b, lambda x: x = i)) ** 2))) AS n FROM c) SELECT conv_id, turn, {_BIN} FROM s""")
def embed_fake_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ranking.bag_vector(F.col("text")).alias("v"))
    return rows.select("conv_id", "turn", *[F.round(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in range(8)])


@query("first_seen", "SELECT conv_id, turn, trim(text) AS said FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY conv_id, turn) = 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("said", F.trim("text"))
    least = rows.groupBy(F.lower("said").alias("key")).agg(F.min_by(F.struct("conv_id", "turn", "said"), F.struct("conv_id", "turn")).alias("first"))
    return least.select("first.*")


_WEEKS = "WITH l AS (SELECT user_id AS session, date_trunc('week', ts + INTERVAL 7 HOUR)::DATE AS monday, count(*) AS n FROM events GROUP BY 1, 2) "


@query("previous_week", _WEEKS + "SELECT a.session, a.monday, a.n, coalesce(b.n, 0) AS n_before FROM l a LEFT JOIN l b ON b.session = a.session AND b.monday = a.monday - 7")
def previous_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    monday = F.date_trunc("week", F.col("ts") + F.expr("INTERVAL 7 HOURS")).cast("date")
    weeks = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session"), monday.alias("monday")).agg(F.count(F.lit(1)).alias("n"))
    # a lag over the weeks of a session instead of a self-join: one shuffle on the session
    by = W.partitionBy("session").orderBy("monday")
    before = F.when(F.lag("monday").over(by) == F.date_sub("monday", 7), F.lag("n").over(by))
    return weeks.withColumn("n_before", F.coalesce(before, F.lit(0)))


@query("sliding_lanes", """SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS begin, event_type AS lane, count(*) AS n FROM events GROUP BY 1, 2""")
def sliding_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), F.col("event_type").alias("lane")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("begin"), "lane", "n")


@query("week_stamp", "SELECT strftime(ts + INTERVAL 7 HOUR, '%G-W%V') AS iso_week, max(greatest(ts, ts + INTERVAL 1 MINUTE * user_id)) AS stamp FROM events GROUP BY 1")
def week_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.col("ts") + F.make_dt_interval(mins=F.col("user_id").cast("int"))
    return table(spark, sf_dir, "events").groupBy(iso_week(F.col("ts")).alias("iso_week")).agg(F.max(F.greatest("ts", moved)).alias("stamp"))


@query("digest_sessions", "SELECT conv_id // 4 AS session, count(*) AS events, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') >= 2 AND count(*) >= 10")
def digest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (here of four conversations) with two questions and ten events or more."""
    by = table(spark, sf_dir, "conversations").groupBy(F.expr("conv_id div 4").alias("session"))
    return by.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("role") == "user").alias("users")).where("users >= 2 and events >= 10")


@query("digest_cache", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'gave_up' WHEN n_chars > 1000 THEN 'changed' ELSE 'reused' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)""")
def digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("known"))
    outcome = F.when(F.col("known").isNull(), "missing").when(F.col("toxic") == 1, "gave_up").when(F.col("n_chars") > 1000, "changed").otherwise("reused")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left").select("doc_id", outcome.alias("outcome"))


@query("budget_sample")
def budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As budget_sample_sessions, over the table's own columns."""
    return sampling.within_budget(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", "text", budget=400, most=120)


@query("live_rows", "SELECT conv_id, turn, role, n > 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> '' AND text <> '') WHERE i <= 3")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").where("role <> '' and text <> ''").select("conv_id", "turn", "role")
    rows = rows.withColumn("i", F.row_number().over(by.orderBy("turn"))).withColumn("truncated", F.count(F.lit(1)).over(by) > 3)
    return rows.where("i <= 3").drop("i")


@query("import_runs_page", "SELECT l_orderkey, l_linenumber, o_custkey, c_name, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 100")
def import_runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sort keys are of one table and the join below it keeps rows, so the page is cut before names are looked up
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    page = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(100)
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return F.broadcast(page).join(names, F.col("c_custkey") == F.col("o_custkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "l_shipdate")


@query("vector_counts", "SELECT count(*) AS embeddable, count(vec_id) AS embedded, count(*) - count(vec_id) AS pending FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE text <> ''")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id").join(table(spark, sf_dir, "embeddings").select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left")
    return joined.agg(F.count(F.lit(1)).alias("embeddable"), F.count("vec_id").alias("embedded")).withColumn("pending", F.col("embeddable") - F.col("embedded"))


@query("page_stats", "SELECT count(*) AS rows, count(DISTINCT url) AS paths, max(page_id) AS newest FROM pages")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("url").alias("paths"), F.max("page_id").alias("newest"))


@query("project_upsert", """WITH s AS (SELECT s_suppkey AS project, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name, 'd' AS encoded_dir, 'h' || s_nationkey AS host FROM supplier),
f AS (SELECT c_custkey AS project, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS encoded_dir, 'h' || c_nationkey AS host FROM customer)
SELECT coalesce(s.project, f.project) AS project, coalesce(nullif(s.name, ''), nullif(f.name, ''), '') AS name, coalesce(nullif(f.encoded_dir, ''), nullif(s.encoded_dir, ''), '') AS encoded_dir, coalesce(nullif(f.host, ''), nullif(s.host, ''), '') AS host FROM s FULL JOIN f ON s.project = f.project""")
def project_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("name"), F.lit("d").alias("encoded_dir"), F.concat(F.lit("h"), "s_nationkey").alias("host"))
    fresh = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("encoded_dir"), F.concat(F.lit("h"), "c_nationkey").alias("host"))
    return ingest.upsert_projects(stored, fresh)


@query("offset_claims", """SELECT doc_id AS session, n_chars AS start, quality * n_chars AS have, quality IS NULL OR quality * n_chars = n_chars AS accepted FROM documents LEFT JOIN labels USING (doc_id)""")
def offset_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), F.col("n_chars").alias("start"))
    stored = table(spark, sf_dir, "labels").join(docs, F.col("doc_id") == F.col("session")).select("session", (F.col("quality") * F.col("start")).alias("byte_offset"))
    return ingest.claim(docs, stored)
