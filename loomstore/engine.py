"""One project's memory behind one object, by the groups of its commands.

State that changes in small steps (sessions, locks, changes, turns) is kept in
append-only logs and folded when it is read; the file index and the graph are
versioned tables.  Everything returns DataFrames, or strings where it says so.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.functions.text import PRIVACY_RULES, slashes
from loomstore.operators import budget, conversations, extract, files, graph, locks, search, segments
from loomstore.operators.snapshots import EACH, Store, insert_missing, of_projects, replace_files, with_project
from loomstore.plans import render
from loomstore.plans.schemas import KEYS, TABLES, conform
from loomstore.plans.shared import materialize
from loomstore.sources import git, project, transcripts

SESSION_EVENTS = "event_id bigint, ts timestamp, op string, session_id string, llm_name string, thread_id string, working_on string, summary string, conversation_context string, files_modified string, tags string"
LOCK_EVENTS = "event_id bigint, ts timestamp, op string, file_path string, session_id string, llm_name string"


class Engine:
    def __init__(self, spark: SparkSession, root: str, clock=lambda: datetime.now(UTC).replace(tzinfo=None)):
        self.spark, self.store, self.root, self.clock = spark, Store(spark, root), root, clock
        self.sessions, self.threads, self.sync, self.context = Sessions(self), Threads(self), Sync(self), Context(self)
        self.graph, self.locks, self.privacy = Graph(self), Locks(self), Privacy(self)

    # The project

    def index(self, folder: str, more_ignored: list[str] | None = None) -> DataFrame:
        """Read the project's tree into the file index; returns the changes since the last index."""
        from loomstore.streaming.watch import snapshot_changes

        tree = project.read_tree(self.spark, folder, more_ignored)
        facts = project.project_facts(tree.where("path not like '%/%'").select("path", F.decode("content", "UTF-8").alias("content")))
        self.store.upsert("project_meta", facts.withColumn("updated_at", F.lit(self.clock())))
        events = snapshot_changes(self.spark, self.store, project.index_files(tree), self.clock(), self._active_id())
        for e in events.where("change_type <> 'deleted'").select("file_path").collect() if self._active_id() else ():
            self.locks.write(e["file_path"], self._active_id())
        return events

    def _active_id(self) -> str | None:
        row = self.sessions.table().where("status = 'active'").orderBy(F.col("started_at").desc(), "id").limit(1).collect()
        return row[0]["id"] if row else None

    def files(self) -> DataFrame:
        return self.store.read("files")

    def changes(self) -> DataFrame:
        return self.store.changes()

    def meta(self) -> DataFrame:
        return self.store.read("project_meta")

    def watch(self, folder: str, checkpoint: str, every: str = "30 seconds", once: bool = False):
        """Index the folder and poll all tools again and again, until the query that this returns is stopped."""
        from loomstore.streaming.watch import watch_project

        return watch_project(self.spark, lambda: (self.index(folder), self.sync.all()), checkpoint, every, once)

    def vacuum(self, keep: int = 5) -> int:
        """Delete what only commits before the last `keep` need."""
        return sum(self.store.vacuum(t, keep) for t in KEYS)

    def status(self) -> DataFrame:
        return files.overview_counts(self.files(), self.sessions.table(), self.changes(), F.lit(self.clock()))

    def query(self, what: str = "overview", value: str | None = None, limit: int = 20) -> DataFrame:
        """overview, find, recent, sessions, types, purposes or file."""
        if what == "overview":
            return self.status()
        if what == "find":
            return files.find_files(self.files(), value or "", 50)
        if what == "recent":
            return files.recent_changes(self.changes(), self.sessions.table(), limit)
        if what == "sessions":
            return self.sessions.list(limit=limit)
        if what == "types":
            return files.type_counts(self.files(), limit)
        if what == "purposes":
            return files.purposes_by_type(self.files())
        if what == "file":
            info = files.file_info(self.files(), value or "")
            history = files.file_history(self.changes()).groupBy(F.col("file_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct("changed_at", "id", "change_type")), False).alias("history"))
            return info.join(history, "path", "left")
        raise ValueError(f"no query {what!r}")

    def find(self, text: str, sources: tuple[str, ...] = ("graph", "chat", "file"), limit: int = 20, mode: str = "compat") -> DataFrame:
        given = {"nodes": self.graph.nodes() if "graph" in sources else None, "turns": self.sessions.turns() if "chat" in sources else None, "files": self.files() if "file" in sources else None}
        given |= {"nodes_index": self.store.node_index() if "graph" in sources else None, "turns_index": self.store.turn_index() if "chat" in sources else None}
        return search.unified_find(text, F.lit(self.clock()), limit=limit, mode=mode, stemmed=True, **given)

    def export(self, form: str = "context", path: str | None = None) -> str | None:
        """markdown or context give a string; json, and markdown with a path, write below it."""
        if form == "json":
            return render.export_json(path, self.meta(), self.files(), self.sessions.table(), self.changes())
        if form == "markdown" and path:
            return render.write_markdown(path, self.meta(), self.files(), self.sessions.table(), self.changes(), str(self.clock()))
        if form == "markdown":
            return render.export_markdown(self.meta(), self.files(), self.sessions.table(), self.changes(), str(self.clock()))
        return render.export_context(self.meta(), self.files(), self.sessions.table())


class _Part:
    def __init__(self, engine: Engine):
        self.e, self.spark, self.store = engine, engine.spark, engine.store



class Sessions(_Part):
    def _event(self, op: str, session_id: str, **values) -> None:
        self.store.put_event("session_events", {"ts": self.e.clock().isoformat(), "op": op, "session_id": session_id} | values)

    def table(self) -> DataFrame:
        """Sessions of the log, and imported ones."""
        own = conversations.fold_sessions(self.store.events("session_events", SESSION_EVENTS))
        return insert_missing(conform(own, "sessions"), self.store.read("sessions"), ["id"])

    def turns(self) -> DataFrame:
        return self.store.turns()

    def start(self, llm_name: str, working_on: str = "", thread_id: str | None = None, session_id: str | None = None) -> str:
        """A new session in a thread (a new one unless given); an active one of the same LLM is interrupted."""
        session_id = session_id or f"{llm_name}-{uuid.uuid4().hex[:8]}"
        self._event("start", session_id, llm_name=llm_name, working_on=working_on, thread_id=thread_id or self.e.threads.create(working_on or f"{llm_name} session"))
        return session_id

    def save(self, session_id: str, **values: str) -> None:
        """working_on, summary, conversation_context, files_modified, tags; blank ones keep what is there."""
        self._event("save", session_id, **values)

    def end(self, session_id: str, **values: str) -> None:
        self._event("end", session_id, **values)
        self.e.locks._snapshot(self.e.locks._event("end_session", None, session_id))

    def list(self, **filters) -> DataFrame:
        return conversations.list_sessions(self.table(), self.turns(), **filters)

    def add_turns(self, session_id: str, rows: list[tuple[str, str]]) -> int:
        """(role, content) pairs, redacted and numbered on; an unknown role is an error."""
        new = self.spark.createDataFrame([(session_id, r, c, 0, k) for k, (r, c) in enumerate(rows)], "session_id string, role string, content string, token_est int, pos int")
        if bad := conversations.prepared_turns(new)[1].count():
            raise ValueError(f"{bad} turns have an unknown role")
        own = self.turns().where(F.col("session_id") == session_id)
        base = 1 + own.agg(F.coalesce(F.max("turn_index"), F.lit(-1))).first()[0]
        # Numbers from 1 on, so that two writers at once never number the same
        first = self.store.reserve(f"turns/sessions/{md5(session_id.encode()).hexdigest()}", len(rows), base + 1) - 1 if rows else base
        made = conversations.append_turns(own.where("false"), new).withColumn("turn_index", (F.col("turn_index") + first).cast("int")).withColumn("recorded_at", F.lit(self.e.clock()))
        self.store.append("turns", conform(made, "conversation_turns").coalesce(1))
        return len(rows)

    def add_turns_from_file(self, session_id: str, path: str) -> int:
        """Turns of a JSON array of {role, content}."""
        found = transcripts.json_array(transcripts.whole_files(self.spark, path)).orderBy("pos").collect()
        return self.add_turns(session_id, [(r["role"], r["content"]) for r in found])

    def search(self, query: str, **filters) -> DataFrame:
        return search.search_turns(self.turns(), self.table(), query, index=self.store.turn_index(), **filters)

    def handoff_data(self, tokens: int | None = None, session_id: str | None = None, thread_id: str | None = None) -> dict:
        """Turns within a budget, how many older ones were cut, and the budget; an unknown session or thread is an error."""
        table, turns = self.table(), self.turns()
        known = table.where(F.col("id") == session_id) if session_id else self.e.threads.table().where(F.col("id") == thread_id) if thread_id else None
        if known is not None and known.isEmpty():
            raise ValueError(f"no session or thread {session_id or thread_id!r}")
        kept, every = (conversations.handoff(table, turns, t, session_id, thread_id) for t in (tokens, None))
        n = kept.count()
        return {"turns": kept, "turns_truncated": every.count() - n, "budget_applied": tokens}

    def handoff(self, tokens: int = 4000, session_id: str | None = None, thread_id: str | None = None) -> str:
        return render.handoff_markdown(self.table(), self.turns(), tokens, session_id, thread_id)

    def show(self, session_id: str) -> str:
        session = self.table().where(F.col("id") == session_id).first()
        if session is None:
            raise ValueError(f"no session {session_id!r}")
        touched = conversations.session_files(self.table().where(F.col("id") == session_id), self.e.changes().where(F.col("session_id") == session_id)).collect()
        last = budget.last_turns(self.turns().where(F.col("session_id") == session_id), 10).orderBy("turn_index").collect()
        return render.session_markdown(session, touched[0]["files"] if touched else [], last)

    def load(self, tokens: int = 4000) -> str:
        """What the latest open session left, for a new one to take up."""
        return self.handoff(tokens)

    def graph(self, session_id: str) -> tuple[DataFrame, DataFrame]:
        touched = conversations.session_files(self.table().where(F.col("id") == session_id), self.e.changes().where(F.col("session_id") == session_id))
        return graph.session_scope(self.e.graph.nodes(), self.e.graph.edges(), touched.select(F.explode("files").alias("path")))


class Threads(_Part):
    def table(self) -> DataFrame:
        return self.store.read("threads")

    def create(self, title: str, thread_id: str | None = None) -> str:
        thread_id = thread_id or f"thread-{uuid.uuid4().hex[:8]}"
        new = self.spark.createDataFrame([(thread_id, title, self.e.clock())], "id string, title string, created_at timestamp")
        self.store.change("threads", lambda old: conversations.create_threads(old, new))
        return thread_id

    def list(self) -> DataFrame:
        return conversations.threads_by_activity(self.table(), self.e.sessions.table())

    def show(self, thread_id: str, tokens: int = 4000) -> str:
        return self.e.sessions.handoff(tokens, thread_id=thread_id)

    def link(self, thread_id: str, session_id: str) -> None:
        self.e.sessions._event("link", session_id, thread_id=thread_id)

    def unlink(self, session_id: str) -> None:
        self.e.sessions._event("unlink", session_id)


class Sync(_Part):
    def configure(self, tool: str, source_path: str, enabled: bool = True) -> None:
        self.store.upsert("tool_sources", self.spark.createDataFrame([(tool, source_path, enabled, self.e.clock())], TABLES["tool_sources"]))

    def tool(self, name: str, path: str, project: str | None = None, session_id: str | None = None) -> DataFrame:
        """Import a tool's transcripts below a path, a project's alone if its folder is given; only turns beyond those stored are added.

        The newest claude transcript goes on in the given session, else in the newest open one of the claude family.
        """
        from loomstore.streaming.watch import poll_transcripts

        into = None
        if name == "claude":
            found = conversations.resolve_session(self.e.sessions.table().where("source_tool is null"), session_id).collect()
            into = found[0]["id"] if found else session_id
        out = poll_transcripts(self.spark, name, path, self.store, project, into, self.e.clock())
        return out.withColumn("tool", F.lit(name)).withColumn("fallback", F.lit(name in transcripts.EMPTY_TOOLS))

    def hook(self, payload: str) -> DataFrame:
        """What a hook passes on its standard input, as JSON: the transcript at transcript_path of the project at cwd is imported."""
        given = json.loads(payload)
        if not isinstance(given, dict) or not given.get("transcript_path"):
            raise ValueError("hook: no transcript_path")
        return self.tool("claude", given["transcript_path"], given.get("cwd"))

    def all(self) -> DataFrame:
        """Every enabled tool source."""
        out = self.spark.createDataFrame([], "imported bigint, updated bigint, inserted bigint, skipped bigint, tool string, fallback boolean")
        for r in self.store.read("tool_sources").where("enabled").orderBy("tool_name", "source_path").collect():
            out = out.unionByName(self.tool(r["tool_name"], r["source_path"]))
        return out

    def ingest(self, folder: str, checkpoint: str) -> None:
        """Take what lies in a drop folder, each file once."""
        from loomstore.streaming.watch import drop_zone

        drop_zone(self.spark, folder, self.store, checkpoint, self.e.clock).trigger(availableNow=True).start().awaitTermination()


class Context(_Part):
    def current(self, tokens: int = 4000) -> str:
        """The latest thread's turns within a budget; without threads the latest session's."""
        latest = conversations.latest_thread(self.e.threads.table(), self.e.sessions.table()).collect()
        return self.e.sessions.handoff(tokens, thread_id=latest[0]["id"] if latest else None)

    def search(self, query: str, limit: int = 5) -> DataFrame:
        return self.e.sessions.search(query, limit=limit)

    def thread(self, thread_id: str, tokens: int = 4000) -> str:
        return self.e.threads.show(thread_id, tokens)

    def pack(self, tokens: int = 4000, session_id: str | None = None, path: str | None = None, query: str = "") -> str:
        """Hits of a query, the session's last turns, files and changes under one budget; written to a file below the path as well, if one is given."""
        e = self.e
        hits = e.find(query, limit=20, mode="bm25") if query.strip() else None
        made = render.context_pack(e.sessions.table(), e.sessions.turns(), e.changes(), tokens, session_id, hits=hits, overview=graph.overview(e.graph.nodes(), e.files()))
        if path:
            self.spark.createDataFrame([(made,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return made

    def changed_in_git(self, folder: str) -> DataFrame:
        """(path): files of a repository that are changed, staged or not."""
        rows = git.sides(self.spark, folder)
        return files.staged_or_not(git.staged(rows), git.unstaged(rows))

    def unified(self, changed: list[str] | DataFrame, query: str = "") -> dict[str, DataFrame]:
        """What a change (paths, or rows of them as `changed_in_git` gives) touches: impacted nodes, turns that mention its files, and hits for a query."""
        paths = changed if isinstance(changed, DataFrame) else self.spark.createDataFrame([(p,) for p in changed], "path string")
        hit = graph.impact(self.e.graph.nodes(), self.e.graph.edges(), paths)
        out = {"impacted": hit, "mentions": search.mentions(graph.impacted_files(hit).select(F.col("file_path").alias("path")).union(paths), self.e.sessions.turns(), index=self.store.turn_index())}
        return out | ({"hits": self.search(query)} if query else {})


class Graph(_Part):
    def nodes(self) -> DataFrame:
        return self.store.read("code_nodes")

    def edges(self) -> DataFrame:
        return self.store.read("code_edges")

    def _sources(self, folder: str) -> DataFrame:
        tree = project.read_tree(self.spark, folder)
        return extract.parseable(tree).select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("file_hash"))

    def build(self, folder: str, full: bool = False) -> DataFrame:
        """Parse what changed since the last build (everything if full); files that are gone leave the graph.

        Files are compared by a listing; only those of another length or time
        are opened, and parsed if their content is another too.  Returns a row of
        counts: files, parsed, skipped (as they were), removed, failed (no tree).
        """
        listed = materialize(extract.parseable(project.list_tree(self.spark, folder)), "listed")
        known = self.nodes().where("kind = 'File'").select(F.col("file_path").alias("path"), "file_hash", F.col("extra").alias("mark"))
        gone = files.removed(known, listed)
        other = project.read_files(self.spark, folder, materialize(listed if full else files.changed(known, listed, "path", "mark"), "other"))
        read = materialize(other.select("path", "mark", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("file_hash")), "read")
        todo = read if full else files.changed(known, read, "path", "file_hash")
        python = todo.where(extract.language(F.col("path")) == "python")
        by_tree, by_lines = extract.parse_python(python.select("path", "content")), extract.scan_lines(todo.where(extract.language(F.col("path")) != "python"))
        marks = todo.select(F.col("path").alias("file_path"), "file_hash", F.col("mark").alias("extra"))
        nodes = by_tree[0].unionByName(by_lines[0]).join(marks, "file_path").withColumn("updated_at", F.lit(self.e.clock()))
        edges = by_tree[1].unionByName(by_lines[1]).withColumn("confidence", F.lit(1.0)).withColumn("updated_at", F.lit(self.e.clock()))
        paths = materialize(todo.select(F.col("path").alias("file_path")).union(gone), "paths")
        touched = read.join(todo.select("path"), "path", "left_anti").select(F.col("path").alias("file_path"), F.col("mark").alias("new_mark"))
        failed = by_tree[2].count()
        new = {"code_nodes": conform(nodes, "code_nodes"), "code_edges": conform(edges, "code_edges")}
        for table, rows in new.items():  # only the parts that the files lie in
            rows, parts = materialize(rows, table), self.store.buckets_of(table, paths)
            if parts:
                self.store.change(table, lambda old, table=table, rows=rows: replace_files(old, rows, paths, KEYS[table]), parts)
        if parts := self.store.buckets_of("code_nodes", touched):  # of another time, but as they were
            marked = lambda old: old.join(touched, "file_path", "left").withColumn("extra", F.coalesce("new_mark", "extra")).drop("new_mark")
            self.store.change("code_nodes", marked, parts)
        every, parsed, removed = listed.count(), todo.count(), gone.count()
        return self.spark.createDataFrame([(every, parsed - failed, every - parsed, removed, failed)], "files bigint, parsed bigint, skipped bigint, removed bigint, failed bigint")

    update = build

    def bench_summary(self, folder: str, most: int = 200) -> dict:
        """Files parsed, total and mean milliseconds, and the ten slowest."""
        times = materialize(self.bench(folder, most), "times")
        total = times.agg(F.count("*").alias("files"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"), F.avg("ms").alias("mean_ms")).first()
        return total.asDict() | {"slowest": times.orderBy(F.col("ms").desc(), "path").limit(10)}

    def bench(self, folder: str, most: int = 200) -> DataFrame:
        """(path, ms) of parsing the first `most` Python files, the slowest first."""
        sample = self._sources(folder).where(extract.language(F.col("path")) == "python").orderBy("path").limit(most)

        def run(batches):
            import time

            import pyarrow as pa

            for batch in batches:
                paths, spent = batch.column(0).to_pylist(), []
                for path, text in zip(paths, batch.column(1).to_pylist()):
                    began = time.perf_counter()
                    extract.timed_rows(path, text, extract.PARSE_SECONDS)
                    spent.append(1000 * (time.perf_counter() - began))
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(spent, pa.float64())], names=["path", "ms"])

        return sample.select("path", "content").mapInArrow(run, "path string, ms double").orderBy(F.col("ms").desc(), "path")

    def status(self) -> DataFrame:
        return graph.stats(self.nodes(), self.edges())

    def impact(self, paths: list[str], depth: int = 3, most: int = 500) -> DataFrame:
        return graph.impact(self.nodes(), self.edges(), self.spark.createDataFrame([(p,) for p in paths], "path string"), depth, most)

    def gaps(self) -> DataFrame:
        return graph.test_gaps(self.nodes(), self.edges())

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search.search_nodes(self.nodes(), query, limit, index=self.store.node_index())

    def overview(self, tokens: int = 2000, prefix: str = "") -> str:
        """Folders, files and symbols within a budget; of a folder or file alone if a prefix is given."""
        return render.overview_markdown(graph.below(self.nodes(), prefix) if prefix else self.nodes(), self.e.files(), tokens)

    def impact_text(self, paths: list[str], depth: int = 3) -> str:
        """The impact of a change, for people: files, and the edges among what is hit."""
        return render.impact_text(self.impact(paths, depth), self.edges())

    def _centre(self, name: str) -> str:
        found = graph.resolve_name(self.nodes(), name).collect()
        return found[0]["qualified_name"] if found else name

    def neighbours(self, name: str, hops: int = 1) -> DataFrame:
        return graph.neighbours(self.nodes(), self.edges(), self._centre(name), hops)

    def neighbours_text(self, name: str, hops: int = 1) -> str:
        return render.neighbourhood_markdown(self._centre(name), self.neighbours(name, hops).orderBy("hop", "role", "kind", "other").collect())

    def subtree_text(self, root: str, depth: int = 8) -> str:
        return render.subtree_text(self.subtree(root, depth).collect())

    def subtree(self, root: str, depth: int = 8) -> DataFrame:
        """The first 500 nodes below a node, in preorder by line and name."""
        return graph.tree(self.nodes(), self.edges(), root, depth).orderBy("place")

    def export(self, kinds: list[str] | None = None, edge_kinds: list[str] | None = None, text: str = "") -> tuple[DataFrame, DataFrame]:
        """(nodes with degree and state, edges among them), for a drawing: of chosen kinds, and with a text in the name or path."""
        nodes, edges = graph.drawn(self.nodes(), self.edges(), kinds, edge_kinds, text)
        day = self.e.changes().where(F.col("changed_at") >= F.lit(self.e.clock()) - F.expr("interval 24 hours")).select("file_path")
        blast = graph.impact(self.nodes(), self.edges(), day.select(F.col("file_path").alias("path")), 1).select("qualified_name")
        states = graph.overlay(nodes, self.e.locks.list().select("file_path"), day, blast)
        ends = graph.degree(edges).withColumnRenamed("node", "qualified_name")
        return states.join(ends, "qualified_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), edges


class Locks(_Part):
    def _event(self, op: str, path: str | None, session_id: str, llm_name: str | None = None) -> int:
        path = path.replace("\\", "/") if path else path
        return self.store.put_event("lock_events", {"ts": self.e.clock().isoformat(), "op": op, "file_path": path, "session_id": session_id, "llm_name": llm_name})

    def _state(self) -> tuple[int, DataFrame, DataFrame]:
        """The newest snapshot: its last event, who owned which file then, and the conflicts up to it."""
        n, folder = self.store.snapshot("lock_events")
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{folder}/{name}") if folder else self.spark.createDataFrame([], schema)
        return n, read("owners", locks.OWNERS), read("conflicts", "event_id bigint, file_path string, session_a string, session_b string")

    def _folded(self, path: str | None = None, upto: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The events after the newest snapshot, of every file or one, folded; and the snapshot's owners and conflicts."""
        n, owners, known = self._state()
        events = self.store.events("lock_events", LOCK_EVENTS, n)
        if upto is not None:
            events = events.where(F.col("event_id") <= upto)
        if path:
            path = path.replace("\\", "/")
            events, owners = events.where(F.col("file_path").isNull() | (F.col("file_path") == path)), owners.where(F.col("file_path") == path)
        return locks.fold_locks(events, owners), owners, known

    def _snapshot(self, n: int) -> None:
        """Write who owns what after every EACH events, so that no one reads more than the events since."""
        if n % EACH == 0 and self.store.snapshot("lock_events")[0] < n:
            folded, owners, known = self._folded(upto=n)
            folded = materialize(folded, "folded")
            self.store.put_snapshot("lock_events", n, {"owners": locks.owners_after(owners, folded), "conflicts": known.unionByName(locks.conflicts(folded))})

    def claim(self, path: str, session_id: str, llm_name: str | None = None) -> bool:
        """Whether the session has the file now; a refused claim is logged as a conflict.

        Events have numbers without gaps, given one after another, so all that came before this claim is there to be folded.
        """
        return self._granted(path, self._event("claim", path, session_id, llm_name))

    def release(self, path: str, session_id: str) -> bool:
        return self._granted(path, self._event("release", path, session_id))

    def _granted(self, path: str, n: int) -> bool:
        granted = self._folded(path)[0].where(F.col("event_id") == n).first()
        if granted is None:  # another writer's snapshot has taken it in meanwhile
            granted = locks.fold_locks(self.store.events("lock_events", LOCK_EVENTS).where(F.col("event_id") <= n)).where(F.col("event_id") == n).first()
        self._snapshot(n)
        return granted["granted"]

    def write(self, path: str, session_id: str) -> None:
        self._snapshot(self._event("write", path, session_id))

    def list(self) -> DataFrame:
        folded, owners, _ = self._folded()
        return locks.owners_after(owners, folded)

    def conflicts(self, resolved: bool = False) -> DataFrame:
        done = self.store.read_log("resolved_conflicts", "event_id bigint, resolved_at timestamp, resolved_by string")
        folded, _, known = self._folded()
        rows = known.unionByName(locks.conflicts(folded)).join(done, "event_id", "left")
        return rows if resolved else rows.where("resolved_at is null").drop("resolved_at", "resolved_by")

    def resolve(self, by: str, conflict_id: int | None = None, path: str | None = None) -> int:
        """Resolve an open conflict by its id, or all open ones of a file; returns how many."""
        chosen = self.conflicts().where((F.col("event_id") == conflict_id) if conflict_id is not None else (F.col("file_path") == path))
        rows = chosen.select("event_id", F.lit(self.e.clock()).alias("resolved_at"), F.lit(by).alias("resolved_by"))
        n = rows.count()
        if n:
            self.store.append("resolved_conflicts", rows.coalesce(1))
        return n


class Privacy(_Part):
    def audit(self) -> dict:
        return {"redaction_enabled": True, "built_in_rules": PRIVACY_RULES, "cloud_sync": False, "network_interception": False}


class Registry:
    """Projects of a machine or a cluster, and what spans them."""

    def __init__(self, spark: SparkSession, root: str, clock=lambda: datetime.now(UTC).replace(tzinfo=None)):
        self.spark, self.store, self.clock = spark, Store(spark, root), clock

    def register(self, project_path: str, db_path: str, name: str) -> None:
        self.store.upsert("project_registry", self.spark.createDataFrame([(project_path, db_path, name, self.clock())], TABLES["project_registry"]))

    def projects(self) -> DataFrame:
        return self.store.read("project_registry").orderBy(F.col("last_seen_at").desc(), "project_path")

    def status(self) -> dict:
        return {"root": self.store.root, "projects": self.store.read("project_registry").count()}

    def _turns(self) -> DataFrame:
        """All projects' turns, in one scan."""
        projects, folders = of_projects(self.spark, self.projects(), "turns/log")
        if not folders:
            return conform(None, "conversation_turns", self.spark).withColumns({"project_path": F.lit(""), "project_name": F.lit("")})
        rows = with_project(self.spark.read.schema(TABLES["conversation_turns"]).option("recursiveFileLookup", True).parquet(*folders), projects, "turns/log")
        return rows.join(self.projects().select("project_path", F.col("name").alias("project_name")), "project_path")

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """The best turns of all projects, each ranked by its own statistics, from their stored indexes (which are brought up to date first)."""
        projects, _ = of_projects(self.spark, self.projects(), "turns/log")
        for db in projects:
            Store(self.spark, db).turn_index()
        turns = self._turns()
        return search.search_projects(turns, query, limit, True, index=segments.of_projects(self.spark, projects, "turns_index") if projects else None)

    def handoff(self, tokens: int = 2000) -> str:
        """What the latest session of each project left, the projects seen last first; those without turns are left out."""
        parts = []
        for r in self.projects().collect():
            e = Engine(self.spark, r["db_path"], self.clock)
            if not e.sessions.turns().isEmpty():
                parts.append(f"# {r['name']}\n\n" + e.sessions.handoff(tokens))
        return "\n\n".join(parts)
