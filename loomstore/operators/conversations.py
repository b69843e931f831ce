"""Sessions, threads and turns: roll-ups, event folds, appends, hand-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions.text import blank_to_null, comma_list, redact, slug, token_estimate
from loomstore.operators.budget import session_budget, thread_budget
from loomstore.plans.schemas import ROLES


def turn_stats(turns: DataFrame) -> DataFrame:
    """Per session: turns, tokens, last record, first user message."""
    return turns.groupBy("session_id").agg(
        F.count("*").alias("turn_count"), F.coalesce(F.sum("token_est"), F.lit(0)).alias("token_total"), F.max("recorded_at").alias("last_turn_at"),
        F.min_by("content", F.when(F.col("role") == "user", F.col("turn_index"))).alias("first_user_message"),
    )


def list_sessions(sessions: DataFrame, turns: DataFrame, source: str | None = None, search: str | None = None, limit: int | None = 50, status: list[str] | None = None) -> DataFrame:
    """Sessions with their turns' figures, the latest first. Every filter restricts, and before the limit."""
    rows = sessions
    if status:
        rows = rows.where(F.col("status").isin(status))
    if source:
        rows = rows.where((F.col("source_tool") == source) | (F.col("llm_name") == source))
    if search:
        rows = rows.where(F.concat_ws("\n", "id", "working_on", "summary").ilike(f"%{search}%"))
    rows = rows.join(turn_stats(turns), F.col("id") == F.col("session_id"), "left").drop("session_id")
    rows = rows.withColumn("turn_count", F.coalesce("turn_count", F.lit(0))).withColumn("token_total", F.coalesce("token_total", F.lit(0)))
    rows = rows.withColumn("last_at", F.coalesce("last_turn_at", "ended_at", "started_at")).orderBy(F.col("last_at").desc(), "id")
    return rows.limit(limit) if limit else rows


def session_files(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """(session_id, files): those listed as modified and those in the change log, sorted."""
    listed = sessions.select(F.col("id").alias("session_id"), F.explode(comma_list(F.col("files_modified"))).alias("path"))
    logged = changes.where("session_id is not null and file_path is not null").select("session_id", F.col("file_path").alias("path"))
    return listed.union(logged).distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("path")).alias("files"))


def threads_by_activity(threads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Threads with the number of their sessions (0 too) and the latest start, the most active first."""
    per = sessions.where("thread_id is not null").groupBy("thread_id").agg(F.count("id").alias("session_count"), F.max("started_at").alias("last_session_at"))
    rows = threads.join(per, threads["id"] == per["thread_id"], "left").drop("thread_id")
    rows = rows.withColumn("session_count", F.coalesce("session_count", F.lit(0)))
    return rows.orderBy(F.coalesce("last_session_at", "updated_at", "created_at").desc(), "id")


def latest_thread(threads: DataFrame, sessions: DataFrame) -> DataFrame:
    return threads_by_activity(threads.where("status = 'active'"), sessions).limit(1)


def create_threads(threads: DataFrame, new: DataFrame) -> DataFrame:
    """Threads with those of `new` (id, title, created_at) that have no row yet; ids may be null and are made from the title."""
    made = new.select(F.coalesce("id", F.concat(F.lit("thread-"), slug(F.col("title")), F.lit("-"), F.substring(F.md5(F.concat_ws("|", "title", "created_at")), 1, 8))).alias("id"), "title", "created_at", F.col("created_at").alias("updated_at"), F.lit("active").alias("status"))
    return threads.unionByName(made.dropDuplicates(["id"]).join(threads, "id", "left_anti"))


def fold_sessions(events: DataFrame) -> DataFrame:
    """Current sessions from the event log (event_id, ts, op, session_id, llm_name, thread_id, and what a save may set).

    Ops: start, save, end, link, unlink.  A later start of the same LLM
    interrupts an active session; a save keeps what it leaves blank and leaves
    the session interrupted, also after its end; an end completes it.
    """
    order = Window.partitionBy("session_id").orderBy("event_id")
    end = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keep = lambda c: F.last(blank_to_null(F.col(c)), ignorenulls=True).over(end).alias(c)
    starts = events.where("op = 'start'").select("llm_name", "event_id")
    next_start = F.lead("event_id").over(Window.partitionBy("llm_name").orderBy("event_id"))
    nexts = starts.withColumn("next_start", next_start).select(F.col("event_id").alias("start_id"), "next_start")
    rows = events.where("op in ('start', 'save', 'end', 'link', 'unlink')").select(
        "session_id",
        F.first(F.when(F.col("op") == "start", F.col("llm_name")), ignorenulls=True).over(end).alias("llm_name"),
        F.min(F.when(F.col("op") == "start", F.col("ts"))).over(end).alias("started_at"),
        F.max(F.when(F.col("op") == "end", F.col("ts"))).over(end).alias("ended_at"),
        F.min(F.when(F.col("op") == "start", F.col("event_id"))).over(end).alias("start_id"),
        F.last(F.when(F.col("op").isin("start", "save", "end"), F.col("op")), ignorenulls=True).over(end).alias("last_op"),
        F.last(F.when(F.col("op").isin("start", "save", "end"), F.col("event_id")), ignorenulls=True).over(end).alias("last_id"),
        F.last(F.when(F.col("op").isin("start", "link", "unlink"), F.struct(F.when(F.col("op") != "unlink", F.col("thread_id")).alias("id"))), ignorenulls=True).over(end)["id"].alias("thread_id"),
        *[keep(c) for c in ("working_on", "summary", "conversation_context", "files_modified", "tags")],
        F.row_number().over(order).alias("place"),
    )
    rows = rows.where("place = 1").drop("place").join(nexts, "start_id", "left")
    status = F.when(F.col("last_op") == "end", "completed").when(F.col("last_op") == "save", "interrupted").when(F.col("next_start").isNotNull(), "interrupted").otherwise("active")
    return rows.withColumn("status", status).withColumnRenamed("session_id", "id").drop("start_id", "last_op", "last_id", "next_start")


def prepared_turns(turns: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): valid turns are redacted and have an estimate; others have an unknown role."""
    ok = F.coalesce(F.col("role").isin(ROLES), F.lit(False))
    valid = turns.where(ok).withColumn("content", redact(F.col("content")))
    return valid.withColumn("token_est", F.coalesce(F.nullif(F.col("token_est"), F.lit(0)), token_estimate(F.col("content"), least)).cast("int")), turns.where(~ok)


def append_turns(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New turns numbered on from each session's last; `incoming` has session_id, pos and the turn's own columns."""
    valid, _ = prepared_turns(incoming)
    last = existing.groupBy("session_id").agg(F.max("turn_index").alias("last"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return valid.join(last, "session_id", "left").withColumn("turn_index", (F.coalesce("last", F.lit(-1)) + place).cast("int")).drop("last", "pos")


def append_tail(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """The idempotent import: of the turns at positions 0, 1, ... of each session, those beyond the number it has already."""
    have = existing.groupBy("session_id").agg(F.count("*").alias("have"))
    valid, _ = prepared_turns(imported, 1)
    rows = valid.join(have, "session_id", "left").where(F.col("pos") >= F.coalesce("have", F.lit(0)))
    return rows.withColumn("turn_index", F.col("pos").cast("int")).drop("have", "pos")


def import_summary(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Sessions and turns that are new, updated and unchanged, in one row."""
    have = existing.groupBy("session_id").agg(F.count("*").alias("have"))
    per = imported.groupBy("session_id").agg(F.count("*").alias("n")).join(have, "session_id", "left")
    new = F.greatest(F.lit(0), F.col("n") - F.coalesce("have", F.lit(0)))
    return per.agg(F.count_if(F.col("have").isNull()).alias("imported"), F.count_if(F.col("have").isNotNull() & (new > 0)).alias("updated"), F.coalesce(F.sum(new), F.lit(0)).alias("inserted"), F.coalesce(F.sum(F.col("n") - new), F.lit(0)).alias("skipped"))


def handoff(sessions: DataFrame, turns: DataFrame, tokens: int | None, session_id: str | None = None, thread_id: str | None = None) -> DataFrame:
    """Turns of a session, of a thread, or of the latest session (an open one if there is one), within a budget, in order."""
    if thread_id:
        rows = turns.join(sessions.where(F.col("thread_id") == thread_id).select(F.col("id").alias("session_id"), "thread_id", "started_at"), "session_id")
        return thread_budget(rows, tokens).orderBy("started_at", "session_id", "turn_index")
    if session_id:
        chosen = sessions.where(F.col("id") == session_id)
    else:
        chosen = sessions.orderBy(F.col("status").isin("active", "interrupted").desc(), F.col("started_at").desc(), "id").limit(1)
    rows = turns.join(chosen.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return session_budget(rows, tokens).orderBy("session_id", "turn_index")


def resolve_session(sessions: DataFrame, preferred: str | None = None) -> DataFrame:
    """The session that an import continues: the given one, else the newest open one of the claude family."""
    if preferred:
        return sessions.where(F.col("id") == preferred)
    family = F.col("llm_name").startswith("claude") | (F.col("llm_name") == "unknown")
    return sessions.where(family & F.col("status").isin("active", "interrupted")).orderBy(F.col("started_at").desc(), "id").limit(1)


def imported_id(tool: Column, source_id: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), tool, F.lit("-"), F.substring(F.replace(source_id, F.lit("-"), F.lit("")), 1, 12))
