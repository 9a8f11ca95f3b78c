"""Questions to context: planned queries, several ranked lists fused, items packed into a character budget."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.safety import fenced, safe_meta
from weftline.functions.times import iso_week
from weftline.operators import ranking

WIKI_WEIGHT, WIKI_K = 0.7, 3
LEAST_CHARS, SNIPPET_CHARS, BUDGET = 80, 1600, 7000
# Words that mean a week, as so many days before today.  Words of a script without blanks count anywhere.
PERIODS = (
    (r"(?i)\b(?:this|current) week\b|\btoday\b|\byesterday\b|\btonight\b", 0),
    ("สัปดาห์นี้|อาทิตย์นี้|วันนี้|เมื่อวาน|เมื่อคืน", 0),
    (r"(?i)\b(?:last|past|previous) week\b", 7),
    ("สัปดาห์ที่แล้ว|สัปดาห์ก่อน|อาทิตย์ที่แล้ว|อาทิตย์ก่อน", 7),
)
NAMED_WEEK = r"(\b[0-9]{4}-W[0-9]{2}\b)"


def valid_week(label: object) -> bool:
    """A week that the calendar has."""
    found = re.fullmatch(r"([0-9]{4})-W([0-9]{2})", label) if isinstance(label, str) else None
    try:
        return bool(found and date.fromisocalendar(int(found[1]), int(found[2]), 1))
    except ValueError:
        return False


def valid_day(value: object) -> str | None:
    """A day that the calendar has, re-written; anything else is no day."""
    try:
        return date.fromisoformat(value.strip()).isoformat() if isinstance(value, str) else None
    except ValueError:
        return None


def week_pages(question: Column, today: Column) -> Column:
    """The names of the pages of the weeks that a question names or means, in order."""
    meant = [F.when(question.rlike(words), F.array(iso_week(today.cast("timestamp_ntz") - F.expr(f"INTERVAL {back} DAYS"), "UTC"))).otherwise(F.array().cast("array<string>")) for words, back in PERIODS]
    weeks = F.array_distinct(F.concat(F.regexp_extract_all(question, F.lit(NAMED_WEEK), F.lit(1)), *meant))
    return F.transform(F.array_sort(weeks), lambda x: F.concat(F.lit("Dream — "), x))


def planned(questions: DataFrame, today: Column, key: str = "id", question: str = "question", asked: str | None = None, most: int = 3) -> DataFrame:
    """(key, place, query): of each question itself, up to `most` queries that a model gave (an array, null if it failed), and those of weeks.

    Queries are trimmed; of those that differ by case alone the first stays, blank ones go.
    """
    text = F.coalesce(F.col(question), F.lit(""))
    given = F.slice(F.coalesce(F.col(asked), F.array().cast("array<string>")), 1, most) if asked else F.array().cast("array<string>")
    told = F.transform(F.concat(F.array(text), given, week_pages(text, today)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    low = F.transform(told, F.lower)
    first = F.filter(F.transform(told, lambda x, i: F.struct(x.alias("query"), (F.array_position(low, F.lower(x)) == i + 1).alias("first"))), lambda x: x["first"] & (x["query"] != ""))
    return questions.select(F.col(key), F.posexplode(first).alias("place", "x")).select(key, (F.col("place") + 1).alias("place"), F.col("x.query").alias("query"))


def allowed(events: DataFrame, text: str = "text", ts: str | None = None, since: str | None = None, least: int = LEAST_CHARS, where: Column | None = None) -> DataFrame:
    """Events that may be retrieved: long enough, not before a valid day, and by the caller's condition."""
    kept = events.where(F.length(text) >= least) if least > 0 else events.where(F.col(text) != "")
    day = valid_day(since)
    kept = kept.where(F.col(ts) >= F.lit(day).cast("timestamp_ntz")) if day and ts else kept
    return kept if where is None else kept.where(where)


def terms_of(query: str) -> list[str]:
    """Words of more than one character, each once."""
    return list(dict.fromkeys(x for x in re.split(r"[^\w]+", query.lower()) if len(x) > 1))


def search_many(queries: list[str], events: DataFrame, wiki: DataFrame | None, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, key, score): the sum over queries of 1 / (60 + rank) for events and 0.7 / (60 + rank) for wiki sections.

    All queries are answered in one pass over the texts of each kind; each list is a top-k, so few rows are ranked.
    """
    asked, fused = [terms_of(x) for x in queries], None
    for df, kind, weight, limit in [(events, "event", 1.0, max(2 * k, 10)), (wiki, "wiki", WIKI_WEIGHT, WIKI_K)]:
        if df is not None:
            top = ranking.bm25_many(df, asked, limit, key, text)
            part = top.select(F.lit(kind).alias("kind"), F.col("doc_id").alias(key), (F.lit(weight) / (ranking.RRF_K + F.col("place") - 1)).alias("part"))
            fused = part if fused is None else fused.unionByName(part)
    return fused.groupBy("kind", key).agg(F.round(F.sum("part"), 5).alias("score"))


def context(hits: DataFrame, budget: int = BUDGET, most: int = SNIPPET_CHARS) -> DataFrame:
    """(n, kind, piece) of the hits (n, kind, meta array, text) that fit a character budget, in order.

    Wiki sections have a reserve of at most half the budget, events the rest.  A piece that doesn't fit is
    skipped, later ones may fit; the very first piece is cut rather than left out.  Hits are the few rows of a head().
    """
    tag = F.when(F.col("kind") == "wiki", F.lit("doc")).otherwise(F.lit("event"))
    meta = F.array_join(F.transform("meta", lambda x: safe_meta(x)), " · ")
    pieces = hits.select("n", "kind", fenced(tag, F.col("n"), meta, F.col("text"), most).alias("piece"))
    rows = pieces.agg(F.sort_array(F.collect_list(F.struct("n", (F.col("kind") == "wiki").alias("doc"), F.length("piece").alias("size")))).alias("rows"))
    docs = F.aggregate(F.col("rows"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["doc"], x["size"]).otherwise(0))
    reserve = F.least(docs, F.lit(budget // 2).cast("long"))
    start = F.struct(reserve.alias("docs"), (budget - reserve).alias("rest"), F.array().cast("array<struct<n:bigint,size:bigint>>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        pool = F.when(x["doc"], s["docs"]).otherwise(s["rest"])
        first = F.size(s["taken"]) == 0
        size = F.when(x["size"] <= pool, x["size"].cast("long")).when(first, F.least(x["size"].cast("long"), F.greatest(F.lit(200).cast("long"), pool)))
        spent = F.coalesce(size, F.lit(0).cast("long"))
        taken = F.when(size.isNotNull(), F.array_append(s["taken"], F.struct(x["n"].cast("long").alias("n"), size.alias("size")))).otherwise(s["taken"])
        return F.struct(F.when(x["doc"], s["docs"] - spent).otherwise(s["docs"]).alias("docs"), F.when(x["doc"], s["rest"]).otherwise(s["rest"] - spent).alias("rest"), taken.alias("taken"))

    taken = rows.select(F.explode(F.aggregate(F.col("rows"), start, step)["taken"]).alias("x")).select(F.col("x.n").alias("_n"), F.col("x.size").alias("_size"))
    return pieces.join(taken, F.col("n") == F.col("_n")).select("n", "kind", F.substring(F.col("piece"), F.lit(1), F.col("_size").cast("int")).alias("piece"))


def sources(hits: DataFrame) -> DataFrame:
    """What a caller sees of a cited hit: its keys, score and the first 200 characters."""
    return hits.withColumn("text", F.substring("text", 1, 200))
