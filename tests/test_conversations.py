from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomstore.operators import budget, conversations, search
from loomstore.plans.schemas import TABLES, conform

T0 = datetime(2024, 1, 1)
TURNS = TABLES["conversation_turns"]
SESSIONS = "id string, llm_name string, started_at timestamp, ended_at timestamp, status string, working_on string, summary string, source_tool string, thread_id string, files_modified string"


def turns(spark, rows):
    """(session, index, role, content, estimate)"""
    return spark.createDataFrame([(s, r, c, e, i, T0 + timedelta(minutes=i)) for s, i, r, c, e in rows], TURNS)


def sessions(spark, rows):
    """(id, llm, hours after, status, task, tool, thread)"""
    return spark.createDataFrame([(i, llm, T0 + timedelta(hours=h), None, st, w, None, tool, th, None) for i, llm, h, st, w, tool, th in rows], SESSIONS)


@pytest.mark.parametrize("costs,limit,kept", [([10, 10], 100, [0, 1]), ([50, 50], 60, [1]), ([5, 5, 5], 12, [1, 2]), ([5, 100, 5], 50, [2]), ([10], 9, []), ([10], -5, []), ([], 10, [])])
def test_budget_keeps_the_newest_prefix(spark, costs, limit, kept):
    rows = turns(spark, [("s", i, "user", "x", c) for i, c in enumerate(costs)])
    assert sorted(r["turn_index"] for r in budget.session_budget(rows, limit).collect()) == kept


def test_budget_estimates_what_has_no_estimate(spark):
    rows = turns(spark, [("s", 0, "user", "x" * 40, 0), ("s", 1, "user", "x" * 40, None)])
    assert budget.session_budget(rows, 10).count() == 1 and budget.session_budget(rows, 20).count() == 2


def test_budget_is_maximal(spark):
    rows = turns(spark, [("s", i, "user", "", (i * 7) % 11 + 1) for i in range(20)])
    kept = [r for r in budget.session_budget(rows, 40).collect()]
    used = sum(r["token_est"] for r in kept)
    before = (min(r["turn_index"] for r in kept) - 1) * 7 % 11 + 1
    assert used <= 40 < used + before


def test_thread_budget_and_handoff(spark):
    s = sessions(spark, [("a", "x", 0, "completed", "old", "x", "t"), ("b", "x", 5, "active", "new", "x", "t"), ("c", "y", 1, "interrupted", "other", "y", None)])
    t = turns(spark, [("a", 0, "user", "one", 5), ("a", 1, "assistant", "two", 5), ("b", 0, "user", "three", 5), ("c", 0, "user", "four", 5)])
    assert [r["content"] for r in conversations.handoff(s, t, 12, thread_id="t").collect()] == ["two", "three"]
    assert [r["content"] for r in conversations.handoff(s, t, 100).collect()] == ["three"]
    assert [r["content"] for r in conversations.handoff(s, t, 100, session_id="a").collect()] == ["one", "two"]


def test_first_user_message_is_found_at_index_0(spark):
    t = turns(spark, [("a", 0, "user", "first", 1), ("a", 1, "user", "second", 1), ("b", 0, "assistant", "hi", 1), ("b", 1, "user", "late", 1)])
    assert {r["session_id"]: r["first_user_message"] for r in conversations.turn_stats(t).collect()} == {"a": "first", "b": "late"}


def test_session_filters_restrict_together(spark):
    s = sessions(spark, [("a", "x", 0, "active", "login", "cursor", None), ("b", "x", 1, "active", "other", "cursor", None), ("c", "y", 2, "active", "login", "codex", None)])
    assert [r["id"] for r in conversations.list_sessions(s, turns(spark, []), source="cursor", search="LOGIN").collect()] == ["a"]
    assert [r["id"] for r in conversations.list_sessions(s, turns(spark, []), limit=2).collect()] == ["c", "b"]


def test_append_twice_is_append_once(spark):
    have = turns(spark, [("s", 0, "user", "a", 1), ("s", 1, "assistant", "b", 1)])
    new = spark.createDataFrame([("s", k, r, c, 0) for k, (r, c) in enumerate([("user", "a"), ("assistant", "b"), ("user", "password=x"), ("robot", "no")])] + [("n", 0, "user", "z", 0)], "session_id string, pos int, role string, content string, token_est int")
    tail = conversations.append_tail(have, new)
    rows = {(r["session_id"], r["turn_index"]): (r["content"], r["token_est"]) for r in tail.collect()}
    assert rows == {("s", 2): ("password=[REDACTED]", 4), ("n", 0): ("z", 1)}
    after = have.unionByName(tail, allowMissingColumns=True)
    assert conversations.append_tail(after, new).count() == 0
    assert conversations.import_summary(have, new.where("role <> 'robot'")).first().asDict() == {"imported": 1, "updated": 1, "inserted": 2, "skipped": 2}
    added = conversations.append_turns(have, new.where("session_id = 's' and pos > 1"))
    assert [r["turn_index"] for r in added.collect()] == [2]


def test_session_events(spark):
    rows = [(1, 0, "start", "a", "claude", "t1", None), (2, 1, "save", "a", None, None, "task"), (3, 2, "start", "b", "claude", None, None), (4, 3, "save", "a", None, None, ""), (5, 4, "start", "c", "cursor", None, None), (6, 5, "end", "c", None, None, None), (7, 6, "start", "d", "claude", None, None), (8, 7, "unlink", "a", None, None, None), (9, 8, "end", "e", None, None, None), (10, 9, "save", "c", None, None, "more")]
    events = spark.createDataFrame([(i, T0 + timedelta(hours=h), op, s, llm, t, w, None, None, None, None) for i, h, op, s, llm, t, w in rows], "event_id bigint, ts timestamp, op string, session_id string, llm_name string, thread_id string, working_on string, summary string, conversation_context string, files_modified string, tags string")
    found = {r["id"]: r for r in conversations.fold_sessions(events).collect()}
    assert {k: r["status"] for k, r in found.items()} == {"a": "interrupted", "b": "interrupted", "c": "interrupted", "d": "active", "e": "completed"}
    assert found["a"]["working_on"] == "task" and found["a"]["thread_id"] is None and found["a"]["llm_name"] == "claude"


def test_threads(spark):
    s = sessions(spark, [("a", "x", 5, "active", "", "x", "t1"), ("b", "x", 9, "active", "", "x", "t1")])
    threads = spark.createDataFrame([("t1", "one", T0, T0, "active"), ("t2", "two", T0 + timedelta(days=1), None, "active")], TABLES["threads"])
    assert [(r["id"], r["session_count"]) for r in conversations.threads_by_activity(threads, s).collect()] == [("t2", 0), ("t1", 2)]
    new = spark.createDataFrame([("t1", "again", T0), (None, "Fix the login", T0), (None, "Fix the login", T0)], "id string, title string, created_at timestamp")
    made = conversations.create_threads(threads, new)
    assert made.count() == 3 and made.where("id like 'thread-fix-the-login-%'").count() == 1


def test_search_of_turns(spark):
    s = sessions(spark, [("a", "x", 0, "active", "", "cursor", "t1"), ("b", "y", 1, "active", "", "codex", None)])
    t = turns(spark, [("a", 0, "user", "the authentication flow is complete", 1), ("a", 1, "user", "nothing to see", 1), ("b", 0, "user", "authenticate again and again", 1)])
    hits = lambda q, **k: [(r["session_id"], r["turn_index"]) for r in search.search_turns(t, s, q, **k).collect()]
    assert sorted(hits("authenticate")) == [("a", 0), ("b", 0)] and hits("authenticate", source_tool="codex") == [("b", 0)] and hits("authenticate", thread_id="t1") == [("a", 0)]
    assert hits("") == [] and hits("flow NOT complete") == [] and hits("nothing", stemmed=False) == [("a", 1)]
    many = turns(spark, [("a", i, "user", f"token number {i}", 1) for i in range(10)])
    assert len(search.search_turns(many, s, "token", limit=3).collect()) == 3
    with pytest.raises(ValueError):
        search.search_turns(t, s, "auth.py")
    files = spark.createDataFrame([("src/auth.py",), ("x/flow.py",)], "path string")
    said = turns(spark, [("a", 0, "user", "see auth.py please", 1)])
    assert [r["path"] for r in search.mentions(files, said).collect()] == ["src/auth.py"]


def test_bm25_scores(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c c"), (3, "d"), (4, "e f g")], "id int, content string")
    import math

    got = {r["id"]: r["score"] for r in search.bm25(search.Index.of(docs, ["id"], F.col("content")), "a").collect()}
    avg = 10 / 4
    for i, f, dl in ((1, 1, 2), (2, 2, 4)):
        assert math.isclose(got[i], -1e-6 * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg)))


def test_find_merges_sources(spark):
    now = F.lit(T0 + timedelta(days=7))
    nodes = spark.createDataFrame([("Function", "login", "a.py::login", "a.py", T0)], "kind string, name string, qualified_name string, file_path string, updated_at timestamp")
    files = spark.createDataFrame([("src/login.py", "p", T0 + timedelta(days=7)), ("login/x.py", "p", T0)], "path string, purpose string, last_modified timestamp")
    t = turns(spark, [("a", 0, "user", "the login\nfails", 1)])
    rows = search.unified_find("login", now, nodes, t, files).collect()
    assert [(r["source"], round(r["score"], 2)) for r in rows] == [("file", 1.35), ("graph", 1.25), ("chat", 1.25), ("file", 0.5)] or {r["source"] for r in rows} == {"file", "graph", "chat"}
    assert next(r["snippet"] for r in rows if r["source"] == "chat") == "the login fails"
    assert {r["source"] for r in search.unified_find("é", now, nodes, t, files).collect()} == set()
    assert [r["qualified_name"] for r in search.search_nodes(nodes, "ogi").collect()] == ["a.py::login"]


def test_old_snapshots_are_brought_up_to_date(spark):
    old = spark.createDataFrame([("s", "user", "hi", 0)], "session_id string, role string, content string, turn_index int")
    assert conform(old, "conversation_turns").columns == [c.split()[0] for c in TURNS.split(", ")]
    assert conform(None, "files", spark).count() == 0
