import os
from datetime import datetime, timedelta

import pytest

from loomstore import __main__ as cli
from loomstore.engine import Engine, Registry

SOURCES = {"src/service.py": '"""Serves users."""\nfrom src.utils import helper\n\n\nclass UserService:\n    def login(self):\n        return helper()\n', "src/utils.py": '"""Helps."""\n\n\ndef helper():\n    return 1\n', "src/test_service.py": "def test_login():\n    pass\n", "app.js": "export function start() {\n", "requirements.txt": "fastapi\n"}


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 1)

    def __call__(self):
        self.now += timedelta(minutes=1)
        return self.now


@pytest.fixture
def tree(tmp_path):
    for name, text in SOURCES.items():
        p = tmp_path / "src_tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "src_tree"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"), Clock())


def test_index_query_and_find(engine, tree):
    assert engine.index(str(tree)).count() == 5
    assert engine.status().first()["files"] == 5
    assert {r["key"]: r["value"] for r in engine.meta().collect()}["framework"] == "FastAPI"
    assert [r["path"] for r in engine.query("find", "SERVES").collect()] == ["src/service.py"]
    assert engine.query("file", "utils").first()["history"][0]["change_type"] == "created"
    (tree / "src/utils.py").write_text("x = 1\n")
    (tree / "app.js").unlink()
    assert sorted((r["file_path"], r["change_type"]) for r in engine.index(str(tree)).collect()) == [("app.js", "deleted"), ("src/utils.py", "modified")]
    assert "Files: 4" in engine.export() and "src/utils.py" in engine.export("markdown")
    with pytest.raises(ValueError):
        engine.query("nothing")


def test_graph(engine, tree):
    engine.index(str(tree))
    assert engine.graph.build(str(tree)).first().asDict() == {"files": 4, "parsed": 4, "skipped": 0, "removed": 0, "failed": 0}
    names = {r["qualified_name"] for r in engine.graph.nodes().collect()}
    assert {"src/service.py::UserService::login", "src/utils.py::helper", "src/test_service.py::test_login", "app.js::start"} <= names
    before = engine.graph.edges().count()
    (tree / "src/utils.py").write_text("def other():\n    pass\n")
    (tree / "app.js").unlink()
    assert engine.graph.update(str(tree)).first().asDict() == {"files": 3, "parsed": 1, "skipped": 2, "removed": 1, "failed": 0}
    names = {r["qualified_name"] for r in engine.graph.nodes().collect()}
    assert "src/utils.py::other" in names and not names & {"src/utils.py::helper", "app.js::start"} and engine.graph.edges().count() == before - 1
    # Of another time only: opened, but not parsed; a file that is no Python: told, and kept as a file
    os.utime(tree / "src/service.py", (1, 1))
    (tree / "src/bad [1].py").write_text("def x(:\n")
    assert engine.graph.update(str(tree)).first().asDict() == {"files": 4, "parsed": 0, "skipped": 3, "removed": 0, "failed": 1}
    marks = {r["file_path"]: r["extra"] for r in engine.graph.nodes().where("kind = 'File'").collect()}
    assert marks["src/service.py"].endswith("@1000000") and "src/bad [1].py" in marks
    (tree / "src/bad [1].py").unlink()
    assert engine.graph.update(str(tree)).first().asDict() == {"files": 3, "parsed": 0, "skipped": 3, "removed": 1, "failed": 0}
    assert [r["qualified_name"] for r in engine.graph.search("login").collect()][:1] and "UserService" in engine.graph.overview()
    assert {r["source"] for r in engine.find("login").collect()} == {"graph"}
    assert [r["ms"] > 0 for r in engine.graph.bench(str(tree)).collect()] == [True] * 3
    nodes, edges = engine.graph.export(["Class", "Function"])
    assert "degree" in nodes.columns and edges.count() >= 1


def test_sessions_threads_and_handoff(engine):
    a = engine.sessions.start("claude", "fix login", session_id="a")
    engine.sessions.add_turns(a, [("user", "please fix the authentication, token=abc"), ("assistant", "done")])
    b = engine.sessions.start("claude", "go on", session_id="b")
    engine.sessions.add_turns(b, [("user", "more")])
    engine.sessions.add_turns(a, [("user", "late")])
    rows = {r["id"]: r for r in engine.sessions.list().collect()}
    assert rows["a"]["status"] == "interrupted" and rows["b"]["status"] == "active" and rows["a"]["turn_count"] == 3
    hits = engine.sessions.search("authenticate").collect()
    assert [h["session_id"] for h in hits] == ["a"] and "token=[REDACTED]" in hits[0]["content"]
    thread = rows["a"]["thread_id"]
    engine.threads.link(thread, b)
    assert {r["id"]: r["session_count"] for r in engine.threads.list().collect()}[thread] == 2
    assert "late" in engine.context.thread(thread) and "more" in engine.context.thread(thread)
    engine.threads.unlink(b)
    assert "more" not in engine.context.thread(thread)
    engine.sessions.save(b, summary="half")
    assert "more" in engine.sessions.handoff() and "interrupted" in engine.sessions.show(b) and "# Context pack" in engine.context.pack()
    with pytest.raises(ValueError):
        engine.sessions.add_turns(a, [("robot", "x")])
    data = engine.sessions.handoff_data(2, "a")
    assert (data["turns"].count(), data["turns_truncated"], data["budget_applied"]) == (2, 1, 2)
    for wrong in (lambda: engine.sessions.show("nobody"), lambda: engine.sessions.handoff_data(5, "nobody")):
        with pytest.raises(ValueError):
            wrong()


def test_locks(engine):
    assert engine.locks.claim("src\\a.py", "s1", "claude") and engine.locks.claim("src/a.py", "s1") and not engine.locks.claim("src/a.py", "s2")
    engine.locks.write("src/a.py", "s2")
    assert not engine.locks.release("src/a.py", "s2") and [r["session_id"] for r in engine.locks.list().collect()] == ["s1"]
    assert engine.locks.conflicts().count() == 2 and engine.locks.resolve("me", path="src/a.py") == 2 and engine.locks.conflicts().count() == 0
    assert engine.locks.conflicts(True).count() == 2 and engine.locks.resolve("me", 999) == 0
    engine.sessions.end("s1")
    assert engine.locks.list().count() == 0 and engine.locks.claim("src/a.py", "s2")


def test_sync_and_registry(spark, engine, tmp_path):
    import json

    folder = tmp_path / "cursor"
    folder.mkdir()
    (folder / "x1.jsonl").write_text(json.dumps({"role": "user", "message": {"content": "the retry loop hangs"}}))
    engine.sync.configure("cursor", str(folder))
    engine.sync.configure("copilot", "/nowhere")
    rows = {r["tool"]: r for r in engine.sync.all().collect()}
    assert rows["cursor"]["inserted"] == 1 and rows["copilot"]["fallback"]
    registry = Registry(spark, str(tmp_path / "registry"), Clock())
    registry.register("/app", engine.root, "app")
    registry.register("/other", str(tmp_path / "none"), "other")
    assert [r["project_path"] for r in registry.search("retries").collect()] == ["/app"] and registry.status()["projects"] == 2
    assert "retry loop" in registry.handoff() and "# other" not in registry.handoff()
    assert engine.privacy.audit()["redaction_enabled"]


def test_command_line(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "db")]
    cli.main([*root, "session", "start", "claude", "a task", "session_id=s"])
    cli.main([*root, "session", "add-turns", "s", '[["user", "hello"]]'])
    cli.main([*root, "session", "list", "limit=5"])
    cli.main([*root, "locks", "claim", "a.py", "s"])
    cli.main([*root, "privacy", "audit"])
    out = capsys.readouterr().out
    assert out.startswith("s\n1\n") and '"turn_count":1' in out and "True" in out and "slack_tokens" in out
    for bad in (["session", "_event"], ["session", "nothing"]):
        with pytest.raises(SystemExit):
            cli.main([*root, *bad])


def test_sync_is_of_one_project_and_goes_on_where_it_was(engine, tmp_path):
    import json

    home = tmp_path / "tools"
    rollout = lambda name, cwd, texts: (home / "codex" / f"rollout-{name}.jsonl").write_text("\n".join([json.dumps({"type": "session_meta", "payload": {"id": f"id-{name}", "cwd": cwd, "cli_version": "0.9", "timestamp": "2024-03-01T10:00:00Z"}}), *(json.dumps({"type": "response_item", "payload": {"role": "user", "content": [{"type": "input_text", "text": t}]}}) for t in texts)]))
    (home / "codex").mkdir(parents=True)
    rollout("1", "/work/App/", ["look at /work/app/src/a.py and /elsewhere/b.py"])
    rollout("2", "/other", ["not ours"])
    (home / "codex" / "notes.jsonl").write_text("{}")
    assert engine.sync.tool("codex", str(home / "codex"), "/work/app").first()["inserted"] == 1
    row = engine.sessions.table().where("source_tool = 'codex'").first()
    assert (row["llm_name"], row["files_modified"], str(row["started_at"])) == ("codex-0.9", "src/a.py", "2024-03-01 10:00:00")
    rollout("1", "/work/App/", ["look at /work/app/src/a.py and /elsewhere/b.py", "more"])
    assert engine.sync.tool("codex", str(home / "codex"), "/work/app").first()["inserted"] == 1
    assert engine.store.read("sync_checkpoints").first()["position"] == 2

    cursor = lambda folder, name, text: ((home / "cursor" / folder).mkdir(parents=True, exist_ok=True), (home / "cursor" / folder / f"{name}.jsonl").write_text(json.dumps({"role": "user", "message": {"content": text}})))
    cursor("work-app", "c1", "ours")
    cursor("other-app", "c2", "theirs")
    assert engine.sync.tool("cursor", str(home / "cursor"), "/work/app").first()["inserted"] == 1
    (home / "cursor" / "work-app" / "c1.jsonl").rename(home / "cursor" / "work-app" / "moved.jsonl")

    engine.sessions.start("claude", "open", session_id="open")
    claude = lambda n: (home / "claude.jsonl").write_text("\n".join(json.dumps({"type": "user", "sessionId": "abc", "message": {"role": "user", "content": f"turn {k}"}}) for k in range(n)))
    claude(2)
    engine.sync.hook(json.dumps({"transcript_path": str(home / "claude.jsonl"), "cwd": "/work/app"}))
    assert engine.sessions.turns().where("session_id = 'open'").count() == 2
    engine.sessions.end("open")
    claude(3)
    assert engine.sync.tool("claude", str(home / "claude.jsonl")).first()["inserted"] == 1  # by its place, though the session is closed
    assert engine.sessions.turns().where("session_id = 'open'").count() == 3
    with pytest.raises(ValueError):
        engine.sync.hook("{}")


def test_texts_of_the_graph_and_a_look_by_the_clock(engine, tree, tmp_path):
    query = engine.watch(str(tree), str(tmp_path / "cp"), once=True)
    assert query.exception() is None and engine.files().count() == 5
    engine.graph.build(str(tree))
    assert "src/service.py" in engine.graph.impact_text(["src/utils.py"]) or "nodes in" in engine.graph.impact_text(["src/utils.py"])
    assert "login" in engine.graph.neighbours_text("src/service.py::UserService") and "UserService" in engine.graph.subtree_text("src/service.py")
    assert "app.js" not in engine.graph.overview(prefix="src") and engine.graph.overview(prefix="nowhere").startswith("# Overview: 0 files")
    summary = engine.graph.bench_summary(str(tree))
    assert summary["files"] == 3 and summary["slowest"].count() == 3 and summary["mean_ms"] > 0
    (tmp_path / "turns.json").write_text('[{"role": "user", "content": "from a file"}]')
    engine.sessions.start("claude", session_id="f")
    assert engine.sessions.add_turns_from_file("f", str(tmp_path / "turns.json")) == 1
    assert engine.context.pack(path=str(tmp_path / "pack")) and any((tmp_path / "pack").iterdir())
    engine.store.upsert("project_meta", engine.meta())
    assert engine.vacuum(1) > 0 and engine.files().count() == 5
