"""Two writers at once, and searches over a stored index."""

import os
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomstore.engine import Engine
from loomstore.functions import fts
from loomstore.operators import search, segments
from loomstore.operators.segments import Segments
from loomstore.operators.snapshots import Conflict, Store
from loomstore.plans import shared

T0 = datetime(2024, 1, 1)


def row(spark, path, n):
    return spark.createDataFrame([(path, n)], "path string, line_count int")


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    a.upsert("files", row(spark, "start", 0))
    base, parts = a.version("files"), a._parts("files", a.version("files"))
    b.upsert("files", row(spark, "theirs", 1))
    with pytest.raises(Conflict):  # a commit onto the version that b has left behind
        a._commit("files", base, parts, row(spark, "ours", 2).select("path", *[F.lit(None).alias(c) for c in a.read("files").columns if c != "path"]))
    a.upsert("files", row(spark, "ours", 2))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: Store(spark, str(tmp_path / "db")).upsert("files", row(spark, f"p{k}", k)), range(6)))
    assert {r["path"] for r in a.read("files").collect()} == {"start", "theirs", "ours", *(f"p{k}" for k in range(6))} and a.version("files") == 9
    assert a.vacuum("files", 1) >= 0 and a.read("files").count() == 9 and a.vacuum("files", 1) == 0


def test_an_upsert_writes_only_the_parts_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.write("files", spark.createDataFrame([(f"f{k}", k) for k in range(200)], "path string, line_count int").select("path", "line_count", *[F.lit(None).alias(c) for c in store.read("files").columns if c not in ("path", "line_count")]))
    before = store._parts("files", 1)
    store.upsert("files", row(spark, "f7", -1))
    after = store._parts("files", 2)
    assert len(before) == Store.BUCKETS and sum(before[k] != after[k] for k in before) == 1
    assert {r["path"]: r["line_count"] for r in store.read("files").collect()} == {f"f{k}": k if k != 7 else -1 for k in range(200)}


def test_events_get_each_number_once_and_one_claim_wins(spark, tmp_path):
    engines = [Engine(spark, str(tmp_path / "db"), lambda: T0) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: engines[k].locks.claim("src/a.py", f"s{k}", "llm"), range(4)))
    assert sum(got) == 1 and engines[0].locks.conflicts().count() == 3
    ids = sorted(r["event_id"] for r in engines[0].store.events("lock_events", "event_id bigint").collect())
    assert ids == [1, 2, 3, 4]


def plain(tokens, tree):
    """Whether a list of tokens fits a query, word by word."""
    if tree.phrase:
        t, n = tree.phrase.terms, len(tree.phrase.terms)
        same = lambda x, k: x.startswith(t[k]) if tree.phrase.prefix and k == n - 1 else x == t[k]
        return n > 0 and any(all(same(tokens[i + k], k) for k in range(n)) for i in range(len(tokens) - n + 1))
    parts = [plain(tokens, p) for p in tree.parts]
    return all(parts) if tree.op == "and" else any(parts) if tree.op == "or" else parts[0] and not any(parts[1:])


#: The stored index of a test that runs for many queries.
STORED: dict[str, Segments] = {}
QUERIES = ["alpha", "alpha beta", '"alpha beta"', "al*", '"alpha be"*', "alpha OR gamma", "alpha NOT beta", "(alpha OR delta) AND NOT_there", "beta NOT (alpha OR gamma)", "uber OR naïve", "ΆΛΦΑ", "việt", '"delta alpha" OR gamma*', "nothing", "..."]


@pytest.mark.parametrize("query", [q for q in QUERIES if q != "..."])
def test_an_index_finds_what_reading_every_text_finds(spark, tmp_path_factory, query):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "über", "naïve", "άλφα", "Việt", "NOT_there"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id bigint, content string")
    index = search.Index.of(df, ["id"], F.col("content"))
    if "held" not in STORED:  # in two segments, with texts that are taken out again
        STORED["held"] = Segments(Store(spark, str(tmp_path_factory.mktemp("index"))), "texts", ["id"], "id bigint", False)
        STORED["held"].add(df.where("id % 3 = 0").unionByName(spark.createDataFrame([(k, "alpha beta gamma alphabet") for k in range(500, 520)], df.schema)), F.col("content"))
        STORED["held"].add(df.where("id % 3 > 0"), F.col("content"))
        assert STORED["held"].remove(spark.range(500, 530)) == 20 and STORED["held"].remove(spark.range(500, 530)) == 0
    stored = STORED["held"].index()
    token_rows = {r["id"]: r["tokens"] for r in search.indexed(df, F.col("content")).collect()}
    tree = fts.parse(query)
    hits = {r["id"]: r["score"] for r in search.bm25(index, query).collect()}
    again = {r["id"]: r["score"] for r in search.bm25(stored, query).collect()}
    assert set(hits) == {k for k, t in token_rows.items() if plain(t, tree)}
    assert hits.keys() == again.keys() and all(abs(hits[k] - again[k]) < 1e-12 for k in hits)
    for limit in (5,):
        best = [(r["id"], r["score"]) for r in STORED["held"].best(query, limit).collect()]
        assert [k for k, _ in best] == [k for k, _ in sorted(hits.items(), key=lambda x: (round(x[1], 9), x[0]))][:limit] and all(abs(hits[k] - x) < 1e-12 for k, x in best)


def test_segments_stay_few_and_equal_one_index(spark, tmp_path, monkeypatch):
    """Appends, removals and merges, against an index of what is left."""
    monkeypatch.setattr(segments, "SPAN", 4)
    rng = random.Random(8)
    held = Segments(Store(spark, str(tmp_path)), "texts", ["k", "n"], "k string, n int", fan=3)
    rows = {}
    for at in range(11):
        new = [(f"s{at}", n, " ".join(rng.choices(["running", "runs", "walk", "walked", "sun", "the"], k=rng.randrange(0, 12)))) for n in range(rng.randrange(1, 9))]
        rows |= {(k, n): t for k, n, t in new}
        held.add(spark.createDataFrame(new, "k string, n int, content string"), F.col("content"))
        if at % 4 == 2:
            gone = rng.sample(sorted(rows), 3)
            assert held.remove(spark.createDataFrame(gone, "k string, n int")) == 3
            for g in gone:
                del rows[g]
    _, parts = held.manifest()
    assert len(parts) <= 5 and sum(s["texts"] for s in parts) == len(rows)
    fresh = search.Index.of(spark.createDataFrame([(k, n, t) for (k, n), t in rows.items()], "k string, n int, content string"), ["k", "n"], F.col("content"), True)
    assert held.sizes() == (len(rows), pytest.approx(fresh.sizes()["avgdl"]))
    for query in ("run", "walks OR sun", "the NOT running", '"run walk" OR sunned'):
        want = {(r["k"], r["n"]): r["score"] for r in search.bm25(fresh, query).collect()}
        got = {(r["k"], r["n"]): r["score"] for r in held.best(query, 1000).collect()}
        assert got == pytest.approx(want)
        assert [(r["k"], r["n"]) for r in held.best(query, 4).collect()] == [k for k, _ in sorted(want.items(), key=lambda x: (round(x[1], 9), x[0]))][:4]
    assert not held.add(spark.createDataFrame([("x", 1, "a")], "k string, n int, content string"), F.col("content"), ["f"]) or not held.add(spark.createDataFrame([("x", 1, "a")], "k string, n int, content string"), F.col("content"), ["f"])


def test_the_best_of_a_common_word_reads_few_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SPAN", 16)
    rng = random.Random(9)
    held = Segments(Store(spark, str(tmp_path)), "texts", ["id"], "id bigint")
    rows = [(k, " ".join(["common"] * rng.choice([1, 1, 1, 1, 2, 5]) + rng.choices(["other", "words", "stand", "here"], k=rng.randrange(3, 300)))) for k in range(3000)]
    held.add(spark.createDataFrame(rows, "id bigint, content string"), F.col("content"))
    full = [(r["id"], r["score"]) for r in search.bm25(held.index(), "common OR nowhere").orderBy("score", "id").limit(10).collect()]
    assert [(r["id"], pytest.approx(r["score"])) for r in held.best("common OR nowhere", 10).collect()] == full
    read, every = held.read_rows()
    assert every >= 180 and read <= every / 3


def test_a_search_reads_its_terms_alone(spark, tmp_path):
    df = spark.createDataFrame([(k, f"word{k} other{k % 7} {chr(97 + k % 26)}x") for k in range(300)], "id bigint, content string")
    held = Segments(Store(spark, str(tmp_path)), "texts", ["id"], "id bigint", False)
    held.add(df, F.col("content"))
    found = search.bm25(held.index(), "word7")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,word7)" in plan
    assert [r["id"] for r in found.collect()] == [7]


def test_stored_indexes_follow_turns_and_nodes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), lambda: T0)
    s = engine.sessions.start("claude", "x", session_id="s")
    engine.sessions.add_turns(s, [("user", "the first retries"), ("user", "nothing here")])
    assert [r["turn_index"] for r in engine.sessions.search("retry").collect()] == [0]
    engine.sessions.add_turns(s, [("assistant", "retrying now")])
    assert sorted(r["turn_index"] for r in engine.sessions.search("retry").collect()) == [0, 2]
    assert engine.store.turn_index().known == (3, 7 / 3) and engine.sessions.search('"first retries" OR now').count() == 2
    assert engine.graph.search("x").count() == 0 and engine.store.exists("code_nodes_index/000000000000/commits")


def test_two_writers_never_give_the_same_numbers(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "db"), lambda: T0), Engine(spark, str(tmp_path / "db"), lambda: T0)
    s = a.sessions.start("claude", "x", session_id="s")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: (a, b)[k % 2].sessions.add_turns(s, [("user", f"one {k}"), ("assistant", f"two {k}")]), range(4)))
        firsts = list(pool.map(lambda k: (a, b)[k % 2].store.reserve("changes", 5, 3), range(6)))
    turns = {r["turn_index"]: r["content"] for r in a.sessions.turns().collect()}
    assert sorted(turns) == list(range(8)) and all(turns[k + 1] == turns[k].replace("one", "two") for k in range(0, 8, 2))
    assert sorted(firsts) == [3 + 5 * k for k in range(6)]


def test_a_look_rewrites_only_the_parts_that_changed(spark, tmp_path):
    from loomstore.streaming.watch import snapshot_changes

    store = Store(spark, str(tmp_path / "db"))
    index = lambda rows: spark.createDataFrame([(p, c, 1) for p, c in rows], "path string, checksum string, line_count int")
    rows = [(f"f{k}", "1") for k in range(40)]
    first = snapshot_changes(spark, store, index(rows), T0)
    assert sorted(r["id"] for r in first.collect()) == list(range(1, 41))
    before = store._parts("files", store.version("files"))
    again = snapshot_changes(spark, store, index([("f3", "2"), *rows[4:], *rows[:2], ("new", "9")]), T0)
    assert sorted((r["file_path"], r["change_type"]) for r in again.collect()) == [("f2", "deleted"), ("f3", "modified"), ("new", "created")] and sorted(r["id"] for r in again.collect()) == [41, 42, 43]
    after = store._parts("files", store.version("files"))
    assert sum(before.get(k) != after.get(k) for k in before | after) <= 3 and store.read("files").count() == 40
    assert snapshot_changes(spark, store, index([("f3", "2"), *rows[4:], *rows[:2], ("new", "9")]), T0).count() == 0


def test_an_append_stems_and_groups_once(spark, tmp_path, monkeypatch):
    """What is dealt out by ranges is read twice, so it must be written already."""
    plans = []

    def seen(df, name, real=segments.materialize):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(segments, "materialize", seen)
    held = Segments(Store(spark, str(tmp_path / "store")), "texts", ["k"], "k bigint")
    held.add(spark.range(50).selectExpr("id as k", "concat('going words ', id % 7) as t"), F.col("t"))
    assert [name for name, plan in plans if "EvalPython" in plan] == ["tokens"] and "grouped" in {name for name, _ in plans}
    assert not [name for name, plan in plans if "rangepartitioning" in plan and ("EvalPython" in plan or "Aggregate" in plan)]
    assert held.remove(spark.range(0, 50, 7).selectExpr("id as k")) == 8
    dead = {r["term"]: r["n"] for r in spark.read.parquet(*(f"{held.store.root}/texts/dead/{d}/terms" for s in held.manifest()[1] for d in s["dead"])).collect()}
    assert dead == {"go": 8, "word": 8, "0": 8}


def test_a_stored_index_leaves_no_scratch_and_deals_out_in_slices(spark, tmp_path, monkeypatch):
    """Tables on the way and shuffles go as soon as they are used, and what is merged can go; slices and pieces change no result."""
    for name, value in (("SPAN", 4), ("PIECE", 30), ("SLICE", 60), ("KEYS", 2)):
        monkeypatch.setattr(segments, name, value)
    there = lambda: {d for d in os.listdir(shared.shared_dir(spark).removeprefix("file:")) if d.split("-")[0] in ("tokens", "texts", "grouped", "spans", "gone")}
    spark.range(1).write.parquet(shared.scratch(spark, "any") + "/t")
    rng, before = random.Random(4), there()
    rows = {k: " ".join(rng.choices(["running", "runs", "walked", "sun", "über", "the"], k=rng.randrange(0, 14))) for k in range(40)} | {40: "sun runs " * 50, 41: None}
    df = spark.createDataFrame(list(rows.items()), "k bigint, t string")
    held = Segments(Store(spark, str(tmp_path)), "texts", ["k"], "k bigint", fan=3)
    for at in range(3):
        held.add(df.where(f"k % 3 = {at}"), F.col("t"))
    assert len(held.manifest()[1]) == 1 and held.vacuum() == 6 and len(os.listdir(tmp_path / "texts/postings")) == 1
    assert held.remove(spark.range(0, 42, 5).toDF("k")) == 9
    assert there() == before
    assert held.vacuum() == 0
    fresh = search.Index.of(df.where("k % 5 > 0"), ["k"], F.col("t"), True)
    for query in ("run", '"run walk" OR uber', "sun NOT the"):
        want = {r["k"]: r["score"] for r in search.bm25(fresh, query).collect()}
        assert want and {r["k"]: r["score"] for r in search.bm25(held.index(), query).collect()} == pytest.approx(want)
        assert {r["k"]: r["score"] for r in held.best(query, 100).collect()} == pytest.approx(want)
