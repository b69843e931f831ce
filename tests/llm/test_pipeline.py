import corpus_pipeline as P
from loomstore.llm import queries
from loomstore.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    columns, left = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        before = left
        docs = materialize(stage(spark, docs, SF), name)
        rows = docs.collect()
        left = {r["doc_id"] for r in rows}
        assert docs.columns == columns and left <= before and len(rows) == len(left) and left
    final = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in final} == left
    assert sorted(r["ids_sha256"] for r in P.run(spark, SF).collect()) == sorted(r["ids_sha256"] for r in final)


def test_each_filter_agrees_with_its_query(spark):
    docs = table(spark, SF, "documents")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(P.drop_toxic(spark, docs, SF)) == ids(queries.op2_toxicity(spark, SF).where("predicted = 0"))
    assert ids(P.keep_quality(spark, docs, SF)) == ids(queries.op7_quality(spark, SF).where("predicted = 1"))
    assert ids(P.near_dedup(spark, docs, SF)) == ids(queries.op9_simhash(spark, SF).where("doc_id = component_id"))
    assert ids(P.decontamination(spark, docs, SF)) == ids(queries.op3_decontaminate(spark, SF).where("not contaminated"))


def test_names_of_the_registered_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k[:2] == "op") == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "simhash_near_dedup", "decontamination", "byte_bpe"]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Key string, `keep` int, block bigint, part int, `odd ``name` double, _toxicity double, _bad boolean"


def odd_tables(spark, folder):
    """Documents with null, empty, long, repeated, toxic, poor, near-copied and contaminated texts, and columns of names that operators use."""
    import random

    from test_classifiers import synthetic

    rng = random.Random(8)
    rows, labels = synthetic(500)
    clean = [(i, t) for i, t in rows if i % 3 == 0]
    bench = [(k, " ".join(rng.choices("question answer with several plain words of its own".split(), k=20))) for k in range(4)] + [(None, "a benchmark item that has no id but some words in it"), (9, None)]
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, "!?"), (1004, clean[0][1]), (1005, clean[0][1]), (1006, clean[1][1] + " end"), (3, clean[1][1]), (None, clean[2][1]), (None, clean[2][1])]
    odd += [(1010 + k, clean[3 + k][1] + " " + t) for k, (_, t) in enumerate(bench[:5])] + [(1020, " ".join(clean[9][1].split() * 4000)), (1021, "zorkish zorkling " * 3000), (1022, "x" * 300_000)]
    every = rows + odd + [odd[4], odd[4]]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2, 3, 0.5, 9.0, True) for i, t in every], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels + [(77_777, 1, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return every, bench


def test_the_pipeline_equals_brute_force_on_odd_rows(spark, tmp_path):
    """Each stage against its own definition, row by row; the models' scores are tested by definition elsewhere."""
    import hashlib
    from collections import Counter

    import tiktoken
    from test_bpe import ENCODING
    from test_decontaminate import brute as contamination
    from test_simhash import brute_fp, groups

    from loomstore.llm import quality, toxicity

    assert isinstance(ENCODING, tiktoken.Encoding)
    _, bench = odd_tables(spark, tmp_path)
    sf = str(tmp_path)
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    docs = table(spark, sf, "documents")
    columns, labels = docs.columns, table(spark, sf, "labels")

    def passing(module, least, below):
        model = module.fit(docs, labels)
        texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows(docs))], "doc_id bigint, text string")
        score = {r["doc_id"]: r["score"] for r in module.score(texts, model).collect()}
        return Counter({row: n for k, (row, n) in enumerate(rows(docs).items()) if (score[k] < least) == below})

    want = passing(toxicity, 0.3, True)
    docs = materialize(P.drop_toxic(spark, docs, sf), "t")
    assert docs.columns == columns and rows(docs) == want and sum(want.values()) > 100 and not any(i == 1021 for i, _ in want)
    want = passing(quality, 0.5, False)
    docs = materialize(P.keep_quality(spark, docs, sf), "q")
    assert docs.columns == columns and rows(docs) == want and sum(want.values()) > 100

    fps = {t: brute_fp(t) for _, t in want}
    root = groups(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, t in want:
        if i is not None:
            first[root[fps[t]]] = min(i, first.get(root[fps[t]], i))
    docs = materialize(P.near_dedup(spark, docs, sf), "d")
    left = rows(docs)
    assert docs.columns == columns and left <= want
    assert sorted(i for i, _ in left if i is not None) == sorted(first.values()) and max(left[i, t] for i, t in left if i is not None) == 1
    assert sum(n for (i, _), n in left.items() if i is None) == sum(n for (i, _), n in want.items() if i is None)

    bad = {(i, t) for i, t in left for n, h, _ in [contamination(t, [(k, x) for k, x in bench])] if h and 20 * h >= n}
    docs = materialize(P.decontamination(spark, docs, sf), "c")
    assert docs.columns == columns and rows(docs) == Counter({k: n for k, n in left.items() if k not in bad})

    found = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.run(spark, sf).collect())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for (i, t), n in rows(docs).items():
        ids = ENCODING.encode_ordinary((t or "")[:5000]) if len(t or "") <= 5000 else None
        if ids is not None:
            expected[i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())] += n
    long = sum(n for (_, t), n in rows(docs).items() if len(t or "") > 5000)
    assert expected <= found and sum((found - expected).values()) == long


def test_the_pipeline_over_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path / "full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    spark.read.parquet(f"{tmp_path}/full/documents.parquet").where("doc_id < 40").write.parquet(f"{tmp_path}/bare/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/none/{name}.parquet").write.parquet(f"{tmp_path}/bare/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/bare").count() > 30  # nothing was learned, so nothing is rejected but copies
