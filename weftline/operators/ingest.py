"""Replay-safe ingest: claims by compare-and-set, first writer wins by uuid, folds of what was inserted.

apply() chains the parts into one step over a batch of events and the stored tables; weftline.operators.commits keeps
the tables and runs the step for each micro-batch of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.text import truncated

#: The tables of a store, and the columns that tell their rows apart.
KEYS = {"events": ["uuid"], "sessions": ["session"], "projects": ["project"], "session_weeks": ["session", "iso_week"], "import_runs": []}
#: Rows of a session that a live message carries, and bytes of each text.
LIVE_ROWS = 40
LIVE_BYTES = 280


def new_events(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The rows of a batch that are inserted: the first of each uuid, if none is stored."""
    first = batch.withColumn("_n", F.row_number().over(W.partitionBy("uuid").orderBy("path", "line_no"))).where("_n = 1").drop("_n")
    if stored is None:
        return first
    # the store is only looked through for the batch's ids: a small batch is broadcast, and the store does not move
    seen = stored.select("uuid").join(batch.select("uuid"), "uuid", "left_semi")
    return first.join(seen, "uuid", "left_anti")


def fold_sessions(inserted: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Session attributes after the inserted rows: extremes, counts, first prompt, last non-empty values."""
    at = F.struct("path", "line_no")
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", at)).alias(c)
    prompt = F.min_by("text", F.when((F.col("role") == "user") & (F.trim("text") != ""), at))
    now = inserted.groupBy("session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("event_count"), F.substring(prompt, 1, 4000).alias("first_prompt"), last("git_branch"), last("cwd"), last("model"))
    if stored is None:
        return now
    old = stored.select("session", *[F.col(c).alias(f"old_{c}") for c in now.columns[1:]])
    both = now.join(old, "session", "full_outer")
    return both.select(
        "session",
        F.least("first_ts", "old_first_ts").alias("first_ts"),
        F.greatest("last_ts", "old_last_ts").alias("last_ts"),
        (F.coalesce("event_count", F.lit(0)) + F.coalesce("old_event_count", F.lit(0))).alias("event_count"),
        F.coalesce("old_first_prompt", "first_prompt").alias("first_prompt"),
        *[F.coalesce(c, f"old_{c}").alias(c) for c in ("git_branch", "cwd", "model")],
    )


def ledger(events: DataFrame) -> DataFrame:
    tools = (F.col("tools") != "[]") & (F.col("tools") != "")
    return events.groupBy("session", "iso_week").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("role") == "user").alias("user_count"),
        F.count_if(F.col("role") == "assistant").alias("assistant_count"),
        F.count_if(tools).alias("tool_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows replace stored rows of the same keys."""
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def merged_ledger(stored: DataFrame | None, inserted: DataFrame) -> DataFrame:
    """The ledger rows of the weeks that received inserts: counts and extremes of the new rows joined to the stored ones.

    Events are never changed or inserted twice, so this is what a recount of all events of those weeks gives.
    """
    fresh = ledger(inserted)
    if stored is None:
        return fresh
    old = stored.join(fresh.select("session", "iso_week"), ["session", "iso_week"], "left_semi").select(fresh.columns)
    counts = ("event_count", "user_count", "assistant_count", "tool_count")
    return old.unionByName(fresh).groupBy("session", "iso_week").agg(*[F.sum(c).alias(c) for c in counts], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def claim(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Compare-and-set: a request (session, start) is accepted if the session is new or its byte offset is the start."""
    have = sessions.select("session", F.col("byte_offset").alias("have"))
    joined = requests.join(have, "session", "left")
    return joined.withColumn("accepted", F.col("have").isNull() | (F.col("have") == F.col("start")))


def upsert_projects(stored: DataFrame, fresh: DataFrame, key: str = "project") -> DataFrame:
    """Project attributes after a batch: a name is set once, directory and host follow the last non-empty value."""
    new = fresh.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in ("name", "encoded_dir", "host")])
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return stored.join(new, key, "full_outer").select(
        key,
        F.coalesce(full("name"), full("new_name"), F.lit("")).alias("name"),
        *[F.coalesce(full(f"new_{c}"), full(c), F.lit("")).alias(c) for c in ("encoded_dir", "host")],
    )


def runs(summary: DataFrame) -> DataFrame:
    """The import runs to append: something was inserted, the offset moved, or the session is new."""
    return summary.where((F.col("inserted") > 0) | (F.col("to_offset") != F.col("from_offset")) | F.col("created"))


def usable(raw: DataFrame) -> Column:
    """Rows with a uuid and a time; others are skipped and counted."""
    return (F.coalesce("uuid", F.lit("")) != "") & F.col("ts").isNotNull()


def shortest_cwd(stored: DataFrame, events: DataFrame) -> DataFrame:
    """(project, cwd, name): the shortest directory ever seen, the first at a tie, named by its last part."""
    seen = events.where("cwd <> ''").groupBy("project").agg(F.min_by("cwd", F.struct(F.length("cwd"), F.col("path"), F.col("line_no"))).alias("new"))
    joined = stored.select("project", F.col("cwd").alias("old")).join(seen, "project", "full_outer")
    old, new = F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    cwd = F.when((old == "") | ((new != "") & (F.length(new) < F.length(old))), new).otherwise(old)
    return joined.select("project", cwd.alias("cwd")).withColumn("name", F.element_at(F.split("cwd", "/"), -1))


def claims(batch: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row for each file of a batch, with its outcome: accepted, refused or conflict.

    A session belongs to the file that brought it first (of several new ones, to the least path); another one is refused.
    Where lines say where they start (start_offset), a file claims to go on where it was left: its first line must
    start at the stored offset, or at 0 in a later generation (a file that was cut or rewritten is read anew).
    Anything else is a conflict: `have` is where the store is, `want` where the batch starts.
    """
    claimed = "start_offset" in batch.columns
    generation = F.max("generation") if "generation" in batch.columns else F.lit(0)
    files = batch.groupBy("session", "path").agg(
        F.first("project").alias("project"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~usable(batch)).alias("skipped"),
        (F.min("start_offset") if claimed else F.lit(None)).cast("long").alias("want"),
        F.max("end_offset").cast("long").alias("to_offset"),
        generation.cast("long").alias("generation"),
    )
    fresh = files if sessions is None else files.join(sessions.select("session"), "session", "left_anti")
    held = fresh.groupBy("session").agg(F.min("path").alias("held_by")).select("session", "held_by", *[F.lit(None).cast("long").alias(c) for c in ("have", "held_generation", "lines_seen")])
    if sessions is not None:
        held = held.unionByName(sessions.select("session", F.col("path").alias("held_by"), F.col("byte_offset").alias("have"), F.col("generation").alias("held_generation"), "lines_seen"))
    follows = (F.col("generation") == F.col("held_generation")) & (F.col("want") == F.col("have"))
    anew = (F.col("generation") > F.col("held_generation")) & (F.col("want") == 0)
    goes_on = F.col("have").isNull() | F.col("want").isNull() | follows | anew
    outcome = F.when(F.col("held_by") != F.col("path"), "refused").when(goes_on, "accepted").otherwise("conflict")
    return files.join(held, "session").withColumn("outcome", outcome).withColumn("lines_seen", F.when(anew, F.lit(0)).otherwise(F.coalesce("lines_seen", F.lit(0))).cast("long"))


def taken(batch: DataFrame, claimed: DataFrame) -> DataFrame:
    """The lines of accepted files; where lines say where they start, numbered on from those that the file had before."""
    accepted = claimed.where("outcome = 'accepted'").select("session", "path", "lines_seen")
    rows = batch.join(accepted, ["session", "path"])
    if "start_offset" in batch.columns:
        nth = F.row_number().over(W.partitionBy("path").orderBy("start_offset"))
        rows = rows.withColumn("line_no", F.col("lines_seen") + nth)
    return rows.drop("lines_seen")


def settle(claimed: DataFrame, inserted: DataFrame, stored: dict[str, DataFrame] | None, now: Column) -> dict[str, DataFrame]:
    """The rows of each table that a batch adds or replaces, once its inserted events are known, and its report."""
    known = stored or {}
    counts = inserted.groupBy("session", "path").agg(F.count(F.lit(1)).alias("inserted"))
    zero = F.lit(0).cast("long")
    report = claimed.join(counts, ["session", "path"], "left").select(
        "session", "path", "project", "outcome", (F.col("outcome") == "accepted").alias("accepted"), F.col("have").isNull().alias("created"), "have", "want",
        F.coalesce("have", zero).alias("from_offset"), "to_offset", "lines", F.coalesce("inserted", zero).alias("inserted"), "skipped",
        F.when(F.col("outcome") == "accepted", F.col("lines") - F.col("skipped") - F.coalesce("inserted", zero)).otherwise(zero).alias("replayed"),
    )
    accepted = claimed.where("outcome = 'accepted'")
    # a claim sets the offset, also back to the start of a new generation; lines without one only move it on
    offset = F.when(F.col("want").isNull(), F.greatest(F.coalesce("have", zero), "to_offset")).otherwise(F.col("to_offset"))
    owners = accepted.select("session", "path", "project", offset.alias("byte_offset"), F.greatest("generation", F.coalesce("held_generation", zero)).alias("generation"), (F.col("lines_seen") + F.col("lines")).alias("lines_seen"))
    before = known["sessions"].join(owners.select("session"), "session", "left_semi") if stored else None
    # a session whose lines were all replays keeps its attributes, one without any event has none yet
    sessions = owners.join(fold_sessions(inserted, before), "session", "left")
    new_runs = runs(report.where("accepted")).select("session", "project", "from_offset", "to_offset", "lines", "inserted", "skipped", now.alias("created"))
    return {
        "events": inserted,
        "sessions": sessions,
        "projects": fold_projects(known.get("projects"), accepted, inserted),
        "session_weeks": merged_ledger(known.get("session_weeks"), inserted),
        "import_runs": new_runs,
        "report": report,
    }


def fold_projects(stored: DataFrame | None, accepted: DataFrame, inserted: DataFrame) -> DataFrame:
    """(project, cwd, name, encoded_dir, host) of the projects of accepted files.

    The shortest directory ever seen names the project; until there is one the name given by a file stands.
    """
    given = [c for c in ("name", "encoded_dir", "host") if c in accepted.columns]
    fresh = accepted.groupBy("project").agg(*[(F.max(c) if c in given else F.lit("")).alias(c) for c in ("name", "encoded_dir", "host")])
    empty = fresh.select("project", *[F.lit("").alias(c) for c in ("cwd", "name", "encoded_dir", "host")])
    old = empty if stored is None else stored.join(fresh.select("project"), "project", "left_semi").unionByName(empty.join(stored.select("project"), "project", "left_anti"))
    named = upsert_projects(old, fresh)
    by_cwd = shortest_cwd(old, inserted).select("project", "cwd", F.col("name").alias("last_part"))
    name = F.when(F.col("cwd") != "", F.col("last_part")).otherwise(F.col("name"))
    return named.join(by_cwd, "project").select("project", "cwd", name.alias("name"), "encoded_dir", "host")


def apply(batch: DataFrame, stored: dict[str, DataFrame] | None = None, now: Column | None = None) -> dict[str, DataFrame]:
    """The tables after a batch of events, and its `report` of one row for each file.

    batch: (path, project, session, uuid, ts, iso_week, role, text, tools, model, cwd, git_branch, line_no, end_offset), where
    line_no orders the lines of a file and end_offset is where a line ends; with start_offset, where a line starts,
    the batch is a claim (see claims()), line_no is counted here, and generation tells how often a file began anew.
    Lines of a batch without claims that overlap what is stored are replays and are skipped by uuid.

    The inserted rows and the claims are persisted, as all tables are made of them; unpersist out["inserted"] and
    out["claims"] when done.  A store that takes many batches is kept by weftline.operators.commits.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    claimed = claims(batch, stored["sessions"] if stored else None).persist()
    rows = taken(batch, claimed)
    inserted = new_events(rows.where(usable(rows)), stored["events"] if stored else None).persist()
    fresh = settle(claimed, inserted, stored, now)
    out = {t: fresh[t] if not stored else upsert(stored[t], fresh[t], keys) if keys and t != "events" else stored[t].unionByName(fresh[t].select(*stored[t].columns)) for t, keys in KEYS.items()}
    return {**out, "report": fresh["report"], "inserted": inserted, "claims": claimed}


def live_rows(inserted: DataFrame, sessions: DataFrame, projects: DataFrame, most: int = LIVE_ROWS, size: int = LIVE_BYTES) -> DataFrame:
    """What a live message carries of the rows of a batch: the first ones of each session that say or call something.

    Texts are cut to `size` bytes, `truncated` tells that a session had more rows, and the session's project is looked up.
    """
    said = inserted.where("role <> '' and (text <> '' or (tools <> '[]' and tools <> ''))").select("session", "uuid", "ts", "role", "text", "tools", "line_no")
    nth = F.row_number().over(W.partitionBy("session").orderBy("line_no", "uuid"))
    rows = said.withColumn("nth", nth).where(F.col("nth") <= most)
    more = said.groupBy("session").agg((F.count(F.lit(1)) > most).alias("truncated"))
    names = sessions.select("session", "project").join(projects.select("project", F.coalesce(F.nullif("cwd", F.lit("")), F.col("project").cast("string")).alias("project_path")), "project", "left")
    rows = rows.join(more, "session").join(names, "session", "left")
    return rows.select("session", "nth", "uuid", "ts", "role", truncated(F.col("text"), size).alias("text"), "tools", "line_no", F.coalesce("project_path", F.lit("")).alias("project_path"), "truncated")


def retained(table: DataFrame, cutoff: Column, created: str = "created") -> DataFrame:
    """Rows not older than the cutoff, and those without a time."""
    return table.where(F.col(created).isNull() | (F.col(created) >= cutoff))


def without_ids(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def tail_state(sessions: DataFrame) -> DataFrame:
    """What a reader of files must know to go on: (path, byte_offset, session), and how often the file began anew."""
    return sessions.select("path", "byte_offset", "session", *[c for c in ("generation",) if c in sessions.columns])
