import random
import re

import pytest
from pyspark.sql import functions as F

from loomstore.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items):
    w, hit, ids = words(doc), set(), set()
    for i, text in items:
        b = words(text)
        n = min(13, len(b))
        for window in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == window:
                    hit |= set(range(k, k + n))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def cases():
    rng = random.Random(3)
    vocabulary = ["alpha", "b", "c1", "Ünï", "über", "don't", "x_y", "9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 5, 12, 13, 14, 30, 60, 4, 13])]
    items += [(100, None), (101, ""), (102, "!!"), (103, items[6][1]), (7, items[7][1])]
    docs = [(0, None), (1, ""), (2, "..."), (3, items[6][1].upper()), (4, items[6][1])]
    for k in range(10, 60):
        parts = [" ".join(rng.choices(vocabulary + ["other", "words"], k=rng.randrange(0, 40)))]
        for _ in range(rng.randrange(3)):
            source = words(rng.choice(items)[1])
            at = rng.randrange(len(source) + 1)
            parts.append(" ".join(source[at : at + rng.randrange(1, 40)]))
        docs.append((k, ", ".join(parts)))
    docs += [(10, docs[7][1]), (11, "the cat " * 3000 + items[7][1])]
    return docs, items


def check(rows, docs, items):
    want = sorted((i, *brute(t, items)) for i, t in docs)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in rows) == want
    for r in rows:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"]


@pytest.mark.parametrize("most", [D.MOST_BITS, D.BITMAP])
@pytest.mark.parametrize("gram", [D.GRAM, 3, 13])
def test_equals_brute_force_however_many_pass_the_filter(spark, make_docs, monkeypatch, most, gram):
    monkeypatch.setattr(D, "GRAM", gram)
    monkeypatch.setattr(D, "MOST_BITS", most)
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    check(D.find_contamination(make_docs(docs), bench).collect(), docs, items)
    many = [(10 * k + j, t) for j in range(8) for k, t in items]
    check(D.find_contamination(make_docs(docs[:30]), spark.createDataFrame(many, "item_id bigint, text string")).collect(), docs[:30], many)


def test_fingerprints_are_selected_once_for_all_windows_that_share_them():
    rng = random.Random(4)
    words = D.Words([" ".join(rng.choices("abcdefgh", k=500)).encode(), b"", b"one two", b" ".join(b"w%d" % k for k in range(3000))])
    for size in (1, 2, 9, 11, 13):
        prints, at = words.selected(size)
        gram = min(D.GRAM, size)
        grams, _ = words.windows(gram)
        want = {min(range(k, k + size - gram + 1), key=lambda i: (int(grams[i]), i)) for k in range(len(words.hashes) - size + 1) if words.text_of[k] == words.text_of[k + size - 1]}
        assert at.tolist() == sorted(want) and (prints == grams[at]).all()
    assert len(words.selected(13)[1]) < 0.5 * len(words.hashes)


def test_the_filter_holds_all_fingerprints(spark):
    _, items = cases()
    prints, _ = D.benchmark_prints(spark.createDataFrame(items, "item_id bigint, text string"))
    sizes, bits = D.print_filter(prints)
    assert sizes == sorted({min(13, len(words(t))) for _, t in items} - {0}) and len(bits) == D.LEAST_BITS // 8
    places = {r["print"] % (8 * len(bits)) for r in prints.collect()}
    assert all(bits[p >> 3] >> (p & 7) & 1 for p in places) and sum(b.bit_count() for b in bits) == len(places)


def test_many_items_share_many_windows_of_one_document(spark, make_docs):
    """A passage that all items hold goes as one set of items, not as windows times items."""
    passage = " ".join(f"word{k}" for k in range(2000))
    bench = spark.range(2000).selectExpr("id AS item_id", f"concat('own', id, ' ', 'lead', id % 7, ' ', '{passage}', ' tail', id) AS text")
    rows = D.find_contamination(make_docs([(1, "before " + passage + " after"), (2, passage), (2, passage), (3, "else")]), bench).collect()
    assert sorted((r["doc_id"], r["n_hit"], len(r["item_ids"])) for r in rows) == [(1, 2000, 2000), (2, 2000, 2000), (2, 2000, 2000), (3, 0, 0)]


def test_contaminated_rows_go_with_their_columns_kept(spark, make_docs):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(i for i, t in docs for n, h, _ in [brute(t, items)] if not (h and 20 * h >= n))
    df = make_docs(docs)
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_contamination(make_docs([(1, "a b")]), none).first()["n_hit"] == 0
    assert D.find_contamination(make_docs([]), none).count() == 0
    assert D.drop_contaminated(make_docs([(1, "a b")]), none).count() == 1


def test_rule(spark):
    rows = spark.createDataFrame([(20, 1, True), (21, 1, False), (0, 0, False), (1, 1, True)], "n bigint, h bigint, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", D.contaminated(F.col("n"), F.col("h"))).collect())


def test_items_without_an_id_hit(spark, make_docs, tmp_path):
    import duckdb

    from loomstore.llm.queries import OP3_SQL, op3_decontaminate

    docs, items = cases()
    docs = list(dict(docs).items())  # the SQL adds up rows of one id
    items = [(None if k % 3 == 0 else k, t) for k, t in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(OP3_SQL)
    rows = op3_decontaminate(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in want.columns) for r in rows) == sorted(want.fetchall())
    bad = sorted(r["doc_id"] for r in rows if r["contaminated"])
    assert 4 in bad
    kept = sorted(r["doc_id"] for r in D.drop_contaminated(make_docs(docs), bench).collect())
    assert sorted(kept + bad) == sorted(i for i, _ in docs)
