"""Streams: new files and transcripts, conflicts on writes, locks, and polls of a folder.

All sinks are idempotent by key, so a batch that is replayed after a failure
changes nothing.  Streams read folders that all executors see.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomstore.functions.text import slashes
from loomstore.operators import conversations, files, locks
from loomstore.operators.snapshots import Store, delete
from loomstore.plans.schemas import conform
from loomstore.plans.shared import materialize
from loomstore.sources import transcripts

CHANGES = "event_id bigint, ts timestamp, op string, file_path string, session_id string, llm_name string"


def drop_zone(spark: SparkSession, folder: str, store: Store, checkpoint: str, now: Callable[[], object]) -> DataFrame:
    """A query that takes each .md or .json file put into a folder once: turns are appended, the file is noted."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{md,json}").load(folder).select(F.input_file_name().alias("source_path"), F.col("value").alias("content"))

    def take(batch: DataFrame, _: int) -> None:
        new = batch.join(store.read("handoff_drops").select(F.col("file_path").alias("source_path")), "source_path", "left_anti")
        # Not a filter: what it drops might be parsed before it is dropped
        listed = new.withColumn("content", F.when(F.col("source_path").endswith(".json"), F.col("content")))
        parsed = transcripts.json_array(listed).unionByName(transcripts.markdown(new.where("source_path like '%.md'")))
        turns = parsed.withColumn("session_id", F.concat_ws("-", transcripts.llm_of_file(F.col("source_path")), F.substring(F.md5("source_path"), 1, 8)))
        tail = conversations.append_tail(store.turns(), turns.withColumn("token_est", F.lit(0)))
        store.append("turns", conform(tail.withColumn("recorded_at", F.lit(now())), "conversation_turns"))
        store.upsert("handoff_drops", new.select(F.col("source_path").alias("file_path"), F.lit(None).cast("string").alias("session_id"), F.lit(now()).cast("timestamp").alias("ingested_at")))

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def imported_before(sources: DataFrame, tool: str) -> tuple[DataFrame, DataFrame]:
    """(source_path, by_path) and (session_key, by_id): the session that a transcript was imported to, found by its place or by its id."""
    mine = sources.where((F.col("adapter_name") == tool) & F.col("session_id").isNotNull())
    newest = lambda key, name: mine.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("session_id", "last_seen_at").alias(name))
    return newest("source_path", "by_path"), newest("source_id", "by_id").withColumnRenamed("source_id", "session_key")


def poll_transcripts(spark: SparkSession, tool: str, folder: str, store: Store, project: str | None = None, into: str | None = None, now: object = None) -> DataFrame:
    """One poll of a tool's folder: turns beyond those stored are appended; gives the summary row.

    A transcript goes on in the session that it was imported to before, by its place or its id; the newest claude transcript
    else in `into`, if that is given; any other makes a session of its own.
    """
    turns = materialize(transcripts.read(spark, tool, folder, project), "transcripts")
    by_path, by_id = imported_before(store.read("conversation_sources"), tool)
    rows = turns.join(by_path, "source_path", "left").join(by_id, "session_key", "left")
    known = F.coalesce("by_path", "by_id")
    if into and tool == "claude":
        last = rows.agg(F.max("source_path").alias("p")).first()["p"]
        known = F.coalesce(known, F.when(F.col("source_path") == last, F.lit(into)))
    rows = rows.withColumn("session_id", F.coalesce(known, conversations.imported_id(F.lit(tool), F.col("session_key")))).drop("by_path", "by_id").withColumn("token_est", F.lit(0))
    rows = materialize(rows, "turns")
    have = store.turns()
    summary = spark.createDataFrame(conversations.import_summary(have, rows).collect(), "imported bigint, updated bigint, inserted bigint, skipped bigint")
    store.append("turns", conform(conversations.append_tail(have, rows).withColumn("recorded_at", F.lit(now).cast("timestamp")), "conversation_turns"))
    heads = rows.groupBy("session_id").agg(F.max("llm_name").alias("llm_name"), F.max("started_at").alias("started_at"))
    found = transcripts.sessions_of(rows, tool).withColumn("key", F.col("source_id")).join(rows.select(F.col("session_key").alias("key"), "session_id").distinct(), "key").drop("llm_name").join(heads, "session_id")
    found = found.select(F.col("session_id").alias("id"), "llm_name", "started_at", "working_on", "source_tool", "source_path", "source_id", "thread_id", F.array_join("files_touched", ",").alias("files_modified"), F.lit("completed").alias("status"))
    found = materialize(found.where(F.col("id") != F.lit(into or "")), "sessions")
    store.upsert("sessions", found)
    places = rows.groupBy("source_path").agg(F.max("session_id").alias("session_id"), F.max("session_key").alias("source_id"), (F.max("pos") + 1).cast("bigint").alias("position"))
    places = materialize(places.select("*", F.lit(tool).alias("adapter_name"), F.lit(project).cast("string").alias("project_path"), F.lit(now).cast("timestamp").alias("last_seen_at"), F.lit(now).cast("timestamp").alias("last_synced_at")), "places")
    store.upsert("conversation_sources", places)
    store.upsert("sync_checkpoints", places)
    return summary


def snapshot_changes(spark: SparkSession, store: Store, current: DataFrame, now: object, session_id: str | None = None) -> DataFrame:
    """One look at a project's files (rows of `files`): events against the stored snapshot, in which what changed is then replaced.

    A file stream reports new files only, so changes and deletions are found by comparing snapshots.
    """
    before = store.read("files")
    events = materialize(files.change_events(before, current), "change-events")
    n = events.count()
    if not n:
        return spark.createDataFrame([], "id bigint, file_path string, change_type string, session_id string, changed_at timestamp")
    last = store.changes().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    first = store.reserve("changes", n, last + 1)  # two looks at once never give the same ids
    sizes = materialize(events.withColumn("part", F.spark_partition_id()), "change-parts")
    place = F.row_number().over(Window.partitionBy("part").orderBy("file_path")) - 1
    before_part = sizes.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # a row a part
    numbered = sizes.withColumn("place", place).join(F.broadcast(before_part), "part")
    new = numbered.select((F.col("place") + F.col("earlier") + first).alias("id"), "file_path", "change_type", F.lit(session_id).cast("string").alias("session_id"), F.lit(now).cast("timestamp").alias("changed_at"))
    new = materialize(new, "changes")
    store.append("changes", conform(new, "changes"))
    # Only rows of changed paths are replaced, and only the parts that hold them written
    paths = new.select(F.col("file_path").alias("path")).distinct()
    rows = materialize(conform(current.join(paths, "path", "left_semi").withColumn("indexed_at", F.lit(now)).withColumn("llm_notes", F.lit(None).cast("string")), "files"), "files")
    store.change("files", lambda old: delete(old, paths, ["path"]).unionByName(rows), store.buckets_of("files", paths))
    return new


def conflict_stream(writes: DataFrame, owners: Callable[[], DataFrame]) -> DataFrame:
    """A stream of writes (event_id, ts, file_path, session_id) joined to the owners of now: conflicts as they come."""
    return locks.write_conflicts(owners(), writes)


ROUTED = "project string, event_id bigint, op string, file_path string, session_id string"


class _Routing(StatefulProcessor):
    """Of a session: the files that it has claimed, to which it sends its releases of everything."""

    def init(self, handle) -> None:
        self.files = handle.getMapState("files", "file_path string", "n int")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        import pandas as pd

        out = []
        for e in pd.concat(list(rows)).sort_values("event_id").itertuples():
            if e.op in ("release_all", "end_session"):
                out += [(key[0], e.event_id, "release", path, key[1]) for (path,) in list(self.files.keys())]
                self.files.clear()
                continue
            if e.op == "claim":
                self.files.updateValue((e.file_path,), (1,))
            out.append((key[0], e.event_id, e.op, e.file_path, key[1]))
        yield pd.DataFrame(out, columns=["project", "event_id", "op", "file_path", "session_id"])

    def close(self) -> None:
        pass


class _Owning(StatefulProcessor):
    """Of a file: the session that owns it."""

    def init(self, handle) -> None:
        self.owner = handle.getValueState("owner", "session_id string")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        import pandas as pd

        owner = self.owner.get()[0] if self.owner.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values("event_id").itertuples():
            granted = None
            if e.op == "claim":
                granted = owner in (None, e.session_id)
                owner = e.session_id if granted else owner
            elif e.op == "release":
                granted = owner is not None and owner == e.session_id
                owner = None if granted else owner
            out.append((key[0], e.event_id, key[1], e.session_id, e.op, granted, owner))
        if owner is None:
            self.owner.clear()
        else:
            self.owner.update((owner,))
        yield pd.DataFrame(out, columns=["project", "event_id", "file_path", "session_id", "op", "granted", "owner"])

    def close(self) -> None:
        pass


def lock_stream(events: DataFrame) -> DataFrame:
    """A stream of lock events: what happened to each event and file, with the file's owner after it.

    Two keyed states follow each other: of a session the files it claimed, so that a
    release of everything, or the session's end, becomes a release of each of them;
    and of a file its owner.  So no state is larger than one session's files, and no
    group holds a project.  `project` tells projects apart; without that column all
    events are of one.  Within a batch a file's events are taken in the order of
    event_id; batches must come in order.  The session's state store must keep several
    column families, as RocksDB does; it is set here if it was not.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.withColumn("project", F.col("project") if "project" in events.columns else F.lit("")).withColumn("file_path", slashes(F.col("file_path")))
    routed = rows.select(*(c.split()[0] for c in ROUTED.split(", "))).groupBy("project", "session_id").transformWithStateInPandas(_Routing(), ROUTED, "Append", "None")
    return routed.groupBy("project", "file_path").transformWithStateInPandas(_Owning(), "project string, event_id bigint, file_path string, session_id string, op string, granted boolean, owner string", "Append", "None")


def watch_project(spark: SparkSession, look: Callable[[], object], checkpoint: str, every: str = "30 seconds", once: bool = False):
    """A running query that calls `look` (an index, a poll) at each tick of a clock; with `once` it looks a single time and ends."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    made = ticks.writeStream.foreachBatch(lambda batch, _: look()).option("checkpointLocation", checkpoint)
    if not once:
        return made.trigger(processingTime=every).start()
    query = made.trigger(processingTime="0 seconds").start()
    while query.lastProgress is None and query.isActive:
        query.awaitTermination(1)
    query.stop()
    return query


def changes_by_window(changes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes by time window and type, late ones dropped after `late`: beyond what a single project needs."""
    return changes.withWatermark("changed_at", late).groupBy(F.window("changed_at", width), "change_type").agg(F.count("*").alias("n"))
