"""Locks folded by transitions of segments, against one step after another; snapshots of the log."""

import random

import pytest

from loomstore import engine as engine_module
from loomstore.engine import Engine
from loomstore.operators import locks, snapshots

SCHEMA = "event_id bigint, ts timestamp, op string, file_path string, session_id string, llm_name string"


def stepwise(events):
    """(event_id, file) -> (granted, owner, llm), one event after another."""
    owner, out = {}, {}
    claimed = {}
    for e, _, op, path, s, llm in events:
        paths = sorted(claimed.get(s, ())) if op in ("release_all", "end_session") else [path.replace("\\", "/")]
        for p in paths:
            o, granted = owner.get(p, (None, None)), None
            if op == "claim":
                granted = o[0] in (None, s)
                o = (s, llm) if granted else o
            elif op != "write":
                granted = o[0] is not None and o[0] == s
                o = (None, None) if granted else o
            owner[p] = o
            out[e, p] = (granted, *o)
        if op == "claim":
            claimed.setdefault(s, set()).add(path.replace("\\", "/"))
    return out


def random_log(n, seed):
    rng = random.Random(seed)
    return [(k, None, op := rng.choices(["claim", "release", "write", "release_all", "end_session"], [8, 6, 3, 1, 1])[0], None if op in ("release_all", "end_session") else rng.choice(["a", "a", "a", "b", "c\\d"]), s := rng.choice("stuv"), f"llm-{s}{rng.randrange(2)}") for k in range(1, n + 1)]


@pytest.mark.parametrize("segment", [3, 512])
def test_transitions_of_segments_equal_single_steps(spark, monkeypatch, segment):
    monkeypatch.setattr(locks, "SEGMENT", segment)
    log = random_log(240, segment)
    want = stepwise(log)
    rows = lambda part: spark.createDataFrame(part, SCHEMA)
    folded = locks.fold_locks(rows(log)).collect()
    got = {(r["event_id"], r["file_path"]): (r["granted"], r["owner"], r["owner_llm"]) for r in folded}
    # A release of everything is told for every file that the session ever claimed, also later
    assert {k: v for k, v in got.items() if k in want} == want and all(not v[0] for k, v in got.items() if k not in want)
    head = locks.fold_locks(rows(log[:100]))
    owners = locks.owners_after(spark.createDataFrame([], locks.OWNERS), head)
    tail = {(r["event_id"], r["file_path"]): (r["granted"], r["owner"], r["owner_llm"]) for r in locks.fold_locks(rows(log[100:]), owners).collect()}
    assert all(v == want[k] for k, v in tail.items() if k in want)
    assert {k for k in want if k[0] > 100 and want[k][0] is not False} <= tail.keys()
    last = {r["file_path"]: (r["session_id"], r["llm_name"]) for r in locks.owners_after(owners, locks.fold_locks(rows(log[100:]), owners)).collect()}
    assert last == {r["file_path"]: (r["session_id"], r["llm_name"]) for r in locks.current_locks(locks.fold_locks(rows(log))).collect()}


def test_a_claim_reads_a_snapshot_and_the_events_since(spark, tmp_path, monkeypatch):
    for module in (engine_module, snapshots):
        monkeypatch.setattr(module, "EACH", 4)
    e = Engine(spark, str(tmp_path / "db"))
    granted = [e.locks.claim(p, s) for p, s in [("a", "s1"), ("a", "s2"), ("b", "s2"), ("a", "s1"), ("b", "s1"), ("a", "s3")]]
    assert granted == [True, False, True, True, False, False]
    n, folder = e.store.snapshot("lock_events")
    assert n == 4 and e.store.events("lock_events", SCHEMA, n).count() == 2 and e.store.events("lock_events", SCHEMA).count() == 6
    e.sessions.end("s1")  # frees what it owned before the snapshot
    assert e.locks.claim("a", "s3") and e.store.snapshot("lock_events")[0] == 8
    assert {r["file_path"]: r["session_id"] for r in e.locks.list().collect()} == {"a": "s3", "b": "s2"}
    assert sorted(r["event_id"] for r in e.locks.conflicts(True).collect()) == [2, 5, 6]
