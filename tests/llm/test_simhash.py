import random
import re

import xxhash
from pyspark.sql import functions as F

from loomstore.llm import simhash as S
from loomstore.llm.components import components


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest member of each node's component, by union-find."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                a_, b_ = sorted((find(a), find(b)))
                parent[b_] = a_
    return {x: find(x) for x in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(make_docs, texts):
    rows = S.fingerprints(make_docs(list(enumerate(texts)))).select("doc_id", S.hex_fp(F.col("fp")).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in rows} == {i: f"{brute_fp(t):016x}" for i, t in enumerate(texts)}


def test_every_pair_within_the_radius_meets_in_a_table():
    rng = random.Random(1)
    masks = S.covering_masks()
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(diff & m == 0 for m in masks)


def near_sets(n, rng):
    """Fingerprints in clusters that chain beyond the radius, and some on their own."""
    out = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n):
            out.append(centre ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 6))))
    return sorted(set(out + [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]))


def test_links_have_the_components_of_all_near_pairs(spark, monkeypatch):
    rng = random.Random(2)
    fps = near_sets(25, rng)
    nodes = spark.createDataFrame([(signed(x), signed(x)) for x in fps], "fp bigint, label bigint")
    want = groups([signed(x) for x in fps], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    for small in (1, 256):  # all buckets through centres, and none
        monkeypatch.setattr(S, "SMALL", small)
        found = {r["node"]: r["component"] for r in components(S.near_links(nodes)).collect()}
        assert {x: found.get(x, x) for x in want} == want


def test_components_of_chains_stars_and_odd_links(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (None, 3), (7, None), (2000, 1999), (1999, 2000), (2000, 1999)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[1000 + i] == 1000 for i in range(300)) and found[2000] == 1999
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for k in range(12):
        base = [word() for _ in range(300)]
        rows += [(k * 10 + j, " ".join(base[: 300 - j])) for j in range(3)] + [(k * 10 + 5, " ".join(base).upper())]
    return rows + [(900, None), (901, ""), (902, "  "), (903, "one two"), (904, "one  TWO"), (10, rows[4][1]), (None, rows[0][1])]


def test_one_row_for_each_document_with_its_class(make_docs):
    rows = corpus()
    fps = {i: brute_fp(t) for i, t in rows if i is not None}
    want = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    found = S.link_duplicates(make_docs(rows)).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    assert len(set(want.values())) < len(want)
    df = make_docs(rows)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))


def test_empty_table(make_docs):
    assert S.link_duplicates(make_docs([])).count() == 0 and S.keep_one(make_docs([])).count() == 0


def test_no_table_that_grows_is_sent_to_the_driver(spark, monkeypatch):
    """With Spark's own limit for broadcasts, which goes by the size of files: buckets are 31 rows a node, links are packed well."""
    from loomstore.llm import components as C

    plans = []

    def seen(df, name, real=S.materialize):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(S, "materialize", seen)
    monkeypatch.setattr(C, "materialize", seen)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower() in ("10485760b", "10485760", "10mb")
    docs = spark.range(300).selectExpr("id as doc_id", "concat('words of a text that goes on for so many more words and so on ', id % 40) as text")
    found = S.link_duplicates(docs)
    plans.append(("members", found._jdf.queryExecution().executedPlan().toString()))
    assert {"buckets", "links", "members"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "BroadcastHashJoin" in plan]
