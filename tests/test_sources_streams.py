import json
import sqlite3
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomstore.operators import files, locks, snapshots
from loomstore.plans import render
from loomstore.plans.schemas import TABLES
from loomstore.sources import project, transcripts
from loomstore.streaming import watch

T0 = datetime(2024, 1, 1)


def lines(spark, name, objects):
    return spark.createDataFrame([(name, i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], "source_path string, line_no int, line string")


def got(df):
    return [(r["role"], r["content"]) for r in df.orderBy("source_path", "pos").collect()]


def test_claude_lines(spark):
    m = lambda t, content, **k: {"type": t, "message": {"role": t, "content": content}, **k}
    rows = lines(spark, "/p/s1.jsonl", [m("user", " hi "), m("assistant", [{"type": "text", "text": "a "}, {"type": "image"}, {"type": "text", "text": "b"}]), m("user", "side", isSidechain=True), m("summary", "x"), m("user", ""), "{broken", m("assistant", 5), {"type": "user"}, m("user", "[not a list]")])
    assert got(transcripts.claude(rows)) == [("user", "hi"), ("assistant", "a\nb"), ("user", "[not a list]")]
    assert transcripts.claude(rows).first()["session_key"] == "s1"


def test_cursor_lines(spark):
    use = {"type": "tool_use", "name": "edit", "input": {"path": "src/main.py", "file_path": 7}}
    result = {"type": "tool_result", "content": [{"type": "text", "text": "y" * 500}]}
    rows = lines(spark, "/c/s2.jsonl", [{"role": "user", "message": {"content": "Do\nit"}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "ok"}, use, result, {"type": "tool_use", "input": {"target_file": "src/utils.py"}}]}}, {"role": "robot", "message": {"content": "x"}}, {"role": "user", "message": "no"}])
    turns = transcripts.cursor(rows)
    assert got(turns) == [("user", "Do\nit"), ("assistant", "ok\n[tool_use: edit]\n[tool_result] " + "y" * 400 + "\n[tool_use: tool]")]
    s = transcripts.sessions_of(turns, "cursor").first()
    assert (s["id"], s["thread_id"], s["working_on"], s["files_touched"]) == ("cursor-s2", "thread-cursor-s2", "Do it", ["src/main.py", "src/utils.py"])


def test_codex_rollouts(spark):
    item = lambda role, text, kind="input_text": {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": kind, "text": text}]}}
    call = {"type": "response_item", "payload": {"type": "function_call", "name": "edit", "arguments": json.dumps({"file": "/w/app/src/x.py", "n": 1})}}
    rows = lines(spark, "/r/rollout-1.jsonl", [{"type": "session_meta", "payload": {"id": "abc-def-0123456789", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w/app/", "cli_version": "0.119.0"}}, item("user", "<environment_context> x"), item("user", "see lib/y.ts now"), call, item("assistant", "done", "output_text"), "nonsense"])
    turns, heads = transcripts.codex(rows)
    assert got(turns) == [("user", "<environment_context> x"), ("user", "see lib/y.ts now"), ("assistant", "done")]
    h = heads.first()
    assert (h["llm_name"], h["cwd"], h["call_paths"]) == ("codex-0.119.0", "/w/app/", ["/w/app/src/x.py"])
    s = transcripts.sessions_of(turns, "codex").first()
    assert (s["id"], s["working_on"], s["files_touched"]) == ("codex-abcdef012345", "see lib/y.ts now", ["lib/y.ts"])
    assert spark.range(1).select(transcripts.same_folder(F.lit("/W/App/"), F.lit("/w/app"))).first()[0]
    assert spark.range(1).select(transcripts.relative_to(F.lit("/w/app/src/x.py"), F.lit("/w/app/"))).first()[0] == "src/x.py"


def test_json_and_markdown_files(spark):
    one = lambda text, name="/d/codex-20260410.md": spark.createDataFrame([(name, text)], "source_path string, content string")
    assert got(transcripts.json_array(one('[{"role":"user","content":"a"},{"role":"system"}]'))) == [("user", "a"), ("system", "")]
    for bad in ('{"role":"user"}', '[{"role":"robot","content":"x"}]', "nope"):
        with pytest.raises(Exception, match="not a JSON array|invalid role"):
            transcripts.json_array(one(bad)).collect()
    assert got(transcripts.markdown(one("x <!-- role: User -->\n hi \n<!-- role: assistant --> <!--role:system-->s"))) == [("user", "hi"), ("system", "s")]
    assert got(transcripts.markdown(one(" just text "))) == [("assistant", "just text")]
    names = {"/d/codex-20260410.md": "codex", "claude-abc.json": "claude", "12345.md": "unknown", "My_LLM_2.md": "my_llm"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["l"] for r in df.select("n", transcripts.llm_of_file(F.col("n")).alias("l")).collect()} == names
    assert transcripts.read(spark, "copilot", "/nowhere").count() == 0
    with pytest.raises(ValueError):
        transcripts.read(spark, "other", "/nowhere")


def test_project_tree(spark, tmp_path):
    for name, text in {"src/auth.py": '"""Auth."""\n', "src/api.py": "# The api\nx\n", "README.md": "# Demo\n", "requirements.txt": "Flask==2\n", "node_modules/big.js": "x", ".git/config": "x", "a.png": "x", "Dockerfile": "FROM x", "src/.hid/z.py": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    tree = project.read_tree(spark, str(tmp_path))
    rows = {r["path"]: r for r in project.index_files(tree).collect()}
    assert set(rows) == {"src/auth.py", "src/api.py", "README.md", "requirements.txt", "Dockerfile"}
    assert (rows["src/auth.py"]["purpose"], rows["src/api.py"]["purpose"], rows["README.md"]["purpose"], rows["src/api.py"]["line_count"], rows["src/api.py"]["file_type"]) == ("Auth.", "The api", "Demo", 2, "py")
    facts = project.project_facts(tree.select("path", F.decode("content", "UTF-8").alias("content")))
    assert {r["key"]: r["value"] for r in facts.collect()} == {"language": "Python", "framework": "Flask", "has_docker": "true"}
    node = spark.createDataFrame([("package.json", '{"name":"w","dependencies":{"react":"1"},"devDependencies":{"vue":"2"}}'), ("go.mod", "")], "path string, content string")
    assert {r["key"]: r["value"] for r in project.project_facts(node).collect()} == {"name": "w", "language": "Go", "framework": "React"}


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "p.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (a INTEGER, b TEXT, c REAL)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"x{i}", i / 2) for i in range(50)])
    spark.dataSource.register(project.SqliteTable)
    df = spark.read.format("sqlite-table").option("path", path).option("dbtable", "t").option("numpartitions", "3").load()
    assert df.agg(F.count("*"), F.sum("a"), F.sum("c")).first()[:] == (50, 1225, 612.5) and df.columns == ["a", "b", "c"]


def test_store_keeps_versions_and_upserts(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "db"))
    row = lambda p, n: spark.createDataFrame([(p, n)], "path string, line_count int")
    store.upsert("files", row("a", 1))
    store.upsert("files", row("b", 2))
    store.upsert("files", row("a", 3))
    assert {r["path"]: r["line_count"] for r in store.read("files").collect()} == {"a": 3, "b": 2} and store.version("files") == 3
    old = spark.createDataFrame([("a", "x", "y")], "id string, p string, q string")
    assert snapshots.update_blanks(old, spark.createDataFrame([("a", "", "z")], "id string, p string, q string"), ["id"], ["p", "q"]).first()[:] == ("a", "x", "z")
    assert snapshots.insert_missing(old, old, ["id"]).count() == 1 and snapshots.delete(old, old, ["id"]).count() == 0
    registry = spark.createDataFrame([("/one", str(tmp_path / "db"), "one"), ("/two", str(tmp_path / "none"), "two")], "project_path string, db_path string, name string")
    assert {r["project_name"] for r in project.read_projects(spark, registry, "files").collect()} == {"one"}


LOCKS = [(1, "claim", "a.py", "s1"), (2, "claim", "a.py", "s1"), (3, "claim", "a.py", "s2"), (4, "write", "a.py", "s2"), (5, "write", "a.py", "s1"), (6, "release", "a.py", "s2"), (7, "claim", "b.py", "s1"), (8, "end_session", None, "s1"), (9, "claim", "a.py", "s2"), (10, "write", "c.py", "s1")]


def lock_events(spark, rows=LOCKS):
    return spark.createDataFrame([(i, T0, op, p, s, f"llm-{s}") for i, op, p, s in rows], watch.CHANGES)


def test_lock_fold(spark):
    folded = locks.fold_locks(lock_events(spark))
    assert {(r["event_id"], r["file_path"]): r["granted"] for r in folded.where("op <> 'write'").collect()} == {(1, "a.py"): True, (2, "a.py"): True, (3, "a.py"): False, (6, "a.py"): False, (7, "b.py"): True, (8, "a.py"): True, (8, "b.py"): True, (9, "a.py"): True}
    assert [(r["event_id"], r["session_a"], r["session_b"]) for r in locks.conflicts(folded).orderBy("event_id").collect()] == [(3, "s1", "s2"), (4, "s1", "s2")]
    assert [r[:] for r in locks.current_locks(folded).collect()] == [("a.py", "s2", "llm-s2")]
    open_ = spark.createDataFrame([(1, "a.py", "s1", "s2", "x", "y", T0, False, None, None), (2, "a.py", "s1", "s3", "x", "y", T0, True, T0, "old")], TABLES["conflicts"])
    done = {r["id"]: r["resolved_by"] for r in locks.resolve(open_, F.lit(T0), "me", path="a.py").collect()}
    assert done == {1: "me", 2: "old"}


def test_lock_stream_equals_the_batch_fold(spark, tmp_path):
    """With a restart in the middle, after which state goes on from the checkpoint."""
    src = str(tmp_path / "in")
    for k in range(2):
        spark.createDataFrame([(i, T0, op, p, s, "l") for i, op, p, s in LOCKS if (i > 5) == bool(k)], watch.CHANGES).coalesce(1).write.mode("append").parquet(src)
        stream = watch.lock_stream(spark.readStream.schema(watch.CHANGES).parquet(src))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(240)
        assert q.exception() is None and not q.isActive
    got = {(r["event_id"], r["file_path"]): (r["granted"], r["owner"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["event_id"], r["file_path"]): (r["granted"], r["owner"]) for r in locks.fold_locks(lock_events(spark)).collect()}
    # The batch also tells releases of what the session claimed only later
    assert {k: v for k, v in want.items() if k in got} == got and not any(v[0] for k, v in want.items() if k not in got)


def test_drop_zone_takes_each_file_once(spark, tmp_path):
    zone, store = tmp_path / "zone", snapshots.Store(spark, str(tmp_path / "db"))
    zone.mkdir()
    (zone / "codex-1.md").write_text("<!-- role: user -->token=abc")
    (zone / "claude-2.json").write_text('[{"role":"user","content":"hey"}]')
    run = lambda: watch.drop_zone(spark, str(zone), store, str(tmp_path / "cp"), lambda: T0).trigger(availableNow=True).start().awaitTermination(120)
    run()
    (zone / "codex-3.md").write_text("plain")
    run()
    rows = store.turns().collect()
    assert sorted(r["content"] for r in rows) == ["hey", "plain", "token=[REDACTED]"] and store.read("handoff_drops").count() == 3


def test_polls_are_idempotent(spark, tmp_path):
    store, folder = snapshots.Store(spark, str(tmp_path / "db")), tmp_path / "t"
    folder.mkdir()
    line = lambda r, t: json.dumps({"role": r, "message": {"content": t}})
    (folder / "s.jsonl").write_text(line("user", "a") + "\n" + line("assistant", "b"))
    assert watch.poll_transcripts(spark, "cursor", str(folder), store).first().asDict() == {"imported": 1, "updated": 0, "inserted": 2, "skipped": 0}
    (folder / "s.jsonl").write_text("\n".join([line("user", "a"), line("assistant", "b"), line("user", "c")]))
    assert watch.poll_transcripts(spark, "cursor", str(folder), store).first().asDict() == {"imported": 0, "updated": 1, "inserted": 1, "skipped": 2}
    assert watch.poll_transcripts(spark, "cursor", str(folder), store).first()["inserted"] == 0
    assert store.turns().count() == 3 and store.read("sessions").first()["id"] == "cursor-s"


def snapshot(spark, rows):
    return spark.createDataFrame([(p, "py", 1, 1, None, None, T0, c) for p, c in rows], "path string, file_type string, line_count int, size_bytes bigint, purpose string, tags string, last_modified timestamp, checksum string")


def test_changes_between_snapshots(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "db"))
    look = lambda rows: sorted((r["file_path"], r["change_type"]) for r in watch.snapshot_changes(spark, store, snapshot(spark, rows), T0).collect())
    assert look([("a", "1"), ("b", "2"), ("c", "3")]) == [("a", "created"), ("b", "created"), ("c", "created")]
    assert look([("a", "9"), ("d", "2")]) == [("a", "modified"), ("b", "deleted"), ("c", "deleted"), ("d", "moved")]
    assert look([("a", "9"), ("d", "2")]) == [] and store.changes().count() == 7
    assert files.changed(snapshot(spark, [("a", "1")]), snapshot(spark, [("a", "2"), ("b", "1")])).count() == 2


def test_renderers(spark, tmp_path):
    meta = spark.createDataFrame([("name", "demo"), ("language", "Python")], "key string, value string")
    index = snapshot(spark, [("src/a.py", "1"), ("b.py", "2")]).withColumn("purpose", F.lit("does it"))
    sessions = spark.createDataFrame([("s1", "cursor", "active", T0, "login", "so far"), ("s2", "claude", "interrupted", T0, "logout", None)], "id string, llm_name string, status string, started_at timestamp, working_on string, summary string")
    turns = spark.createDataFrame([("s1", "user", "hello " * 300, 10, 0, T0)], TABLES["conversation_turns"])
    changes = spark.createDataFrame([(1, "b.py", "modified", "s1", T0, None)], TABLES["changes"])
    full = render.export_markdown(meta, index, sessions, changes, "now")
    assert "**Total files**: 2" in full and "### .py (2 files)" in full and "`src/a.py`: does it" in full and "| `b.py` | modified" in full
    render.write_markdown(str(tmp_path / "md"), meta, index, sessions, changes, "now")
    assert "\n".join(x for f in sorted((tmp_path / "md").glob("part-*")) for x in f.read_text().split("\n")[:-1]) == full
    short = render.export_context(meta, index, sessions)
    assert "**claude** `s2`: logout" in short and "`.py`: 2 files" in short and "cursor" not in short
    render.export_json(str(tmp_path / "x"), meta, index, sessions, changes)
    assert spark.read.json(str(tmp_path / "x/files")).count() == 2 and json.loads(spark.read.text(str(tmp_path / "x/project")).first()[0])["meta"]["name"] == "demo"
    pack = render.context_pack(sessions, turns, changes, 100)
    assert len(pack) <= 100 * 4 + 20 and "`s1`" in pack and "## Last changes" in pack
    hits = spark.createDataFrame([("chat", f"k{k}", f"title {k}", "said", None, 1.0 / k, T0) for k in range(1, 40)], "source string, key string, title string, snippet string, path string, score double, ts timestamp")
    overview = spark.createDataFrame([(f"src/f{k:02}.py", ["def a", "def b"]) for k in range(60)], "file_path string, symbols array<string>")
    for tokens in (60, 120, 400, 1500):
        pack = render.context_pack(sessions, turns, changes, tokens, hits=hits, overview=overview)
        assert len(pack) <= 4 * tokens + 20 and "title 1: said" in pack and (tokens != 400 or len(pack) > 3 * tokens)
    assert all(x in pack for x in ("hello hello", "src/f00.py", "modified `b.py`"))
    assert "hello" in render.handoff_markdown(sessions, turns, 1000) and json.loads(render.to_json(meta))[0]["key"] == "name"
    assert render.subtree_text([{"node": "r", "depth": 0}, {"node": "b", "depth": 1}, {"node": "c", "depth": 2}]) == "r\n  b\n    c"
    assert render.find_markdown("q", []) == "No results for q" and render.trim("x" * 50, 10).startswith("x" * 40)
