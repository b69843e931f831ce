from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from loomstore.llm import common


def test_appended_columns_leave_the_others_as_they_are(spark):
    schema = "text string, ts timestamp, d date, m map<string,int>, a array<struct<x:int,y:string>>, n decimal(12,3), b binary, `odd name` double, t timestamp_ntz"
    rows = [("one", datetime(2024, 5, 1, 12), date(2024, 1, 1), {"k": 1}, [(1, "q")], Decimal("1.500"), bytearray(b"\x00\xff"), 0.5, datetime(2020, 1, 1)), (None,) * 9]
    df = spark.createDataFrame(rows, schema)
    out = common.append(df, "text", lambda texts: [len(t or "") for t in texts], "size", "int", rows=1)
    assert out.schema[:-1] == df.schema and out.drop("size").collect() == df.collect() and [r["size"] for r in out.collect()] == [3, 0]
    assert common.append(df.limit(0), "text", lambda texts: [0] * len(texts), "size", "int").count() == 0


def test_appended_columns_beside_nested_ones_of_any_name(spark):
    df = spark.createDataFrame([("ab", (1, {"x y": [2]}))], "text string, `odd name` struct<`a b`: int, `c:d`: map<string, array<int>>>")
    out = common.append(df, "text", lambda texts: [len(t) for t in texts], "size", "int")
    assert out.schema["odd name"] == df.schema["odd name"] and [r.asDict(True) for r in out.collect()] == [{"text": "ab", "odd name": {"a b": 1, "c:d": {"x y": [2]}}, "size": 2}]
    assert common.keep_rows(df, lambda texts: [True] * len(texts)).schema == df.schema


def test_folds(spark):
    import zlib

    ids = [0, 1, 12, 123456789, None, -5]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", common.fold("doc_id", 4).alias("f"), common.held_out("doc_id", 4, 2).alias("h")).collect()
    for r in rows:
        want = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 4
        assert r["f"] == want and r["h"] == (want == 2)


def test_sent_values_arrive_without_their_module(spark):
    class Box:
        def __init__(self, n):
            self.n = n

    get = common.sent(spark, Box(41))
    df = common.map_rows(spark.range(3), lambda c: {"n": [get().n + i for i in c[0]]}, "n bigint", rows=1)
    assert sorted(r["n"] for r in df.collect()) == [41, 42, 43]
    assert df.agg(F.count("*")).first()[0] == 3


def test_labels_without_a_document_take_no_place_in_the_sample(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(8)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id bigint, toxic int")
    sample, sizes = common.labelled_sample(docs, labels, "toxic", 1, 1, 3)
    rows = sample.collect()
    assert sizes == {0: 4, 1: 4} and sorted(r["y"] for r in rows) == [0, 0, 0, 1, 1, 1] and all(r["doc_id"] < 8 for r in rows)


def test_batches_are_cut_by_rows_and_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "PIECE_BYTES", 100)
    texts = ["a" * 30, None, "", "b" * 500, "c" * 60, "d" * 60, "e", "f"]
    batch = pa.RecordBatch.from_pydict({"k": list(range(8)), "t": texts})
    for rows in (1, 3, 100):
        cut = list(common.pieces(batch, rows))
        assert [x for p in cut for x in p.column(1).to_pylist()] == texts and all(p.num_rows <= rows for p in cut)
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 100 for p in cut)
    assert list(common.pieces(batch.slice(0, 0), 5)) == []
    short = pa.RecordBatch.from_pydict({"t": ["x"] * 10})
    assert [p.num_rows for p in common.pieces(short, 4)] == [4, 4, 2]


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Key int, key_ int")
    assert common.free(df, "key") == "key__" and common.free(df, "other") == "other"
