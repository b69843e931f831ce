from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomstore.functions import fts
from loomstore.functions import text as T
from loomstore.functions.stem import stem, stems


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("token=ghp_" + "a" * 24, "token=[REDACTED]"),
        ("use ghp_" + "a" * 24 + " now", "use [REDACTED_SECRET] now"),
        ("API_KEY = abc, next", "API_KEY=[REDACTED], next"),
        ("sk-live-abcdefgh1 xoxb-1234567890 github_pat_" + "b" * 22, "[REDACTED_SECRET] [REDACTED_SECRET] [REDACTED_SECRET]"),
        ("no secrets here", "no secrets here"),
        ("", ""),
        (None, None),
    ],
)
def test_redaction_and_that_it_is_stable(spark, text, want):
    assert one(spark, text, T.redact) == want
    assert one(spark, want, T.redact) == want


def test_estimates_and_cuts(spark):
    assert one(spark, "x" * 40, T.token_estimate) == 10 and one(spark, "abc", T.token_estimate) == 0
    assert one(spark, "abc", lambda c: T.token_estimate(c, 1)) == 1 and one(spark, None, T.token_estimate) == 0
    assert one(spark, "x" * 101, lambda c: T.shorten(c, 100)) == "x" * 97 + "..." and one(spark, "x" * 100, lambda c: T.shorten(c, 100)) == "x" * 100
    assert one(spark, "x" * 50, lambda c: T.trim_to_tokens(c, 10)).startswith("x" * 40 + "\n")


def test_names_and_paths(spark):
    assert one(spark, "a/b/C.PY", T.extension) == ".py" and one(spark, "a/.gitignore", T.extension) == "" and one(spark, "Makefile", T.extension) == ""
    assert one(spark, "x.py::A::f", T.last_name) == "f" and one(spark, "a\\b", T.slashes) == "a/b"
    assert one(spark, "Fix the Login flow now please", T.slug) == "fix-the-login-flow" and one(spark, "!!", T.slug) == "thread"
    assert one(spark, "C:\\my dir\\foo//bar/", T.folder_slug) == "C-my-dir-foo-bar"
    assert one(spark, " a, ,b,", T.comma_list) == ["a", "b"]


def test_times(spark):
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    at = lambda s: one(spark, s, lambda c: F.round(T.recency(T.timestamp(c), now), 4))
    assert at("2024-01-01T00:00:00Z") == 0.5 and at("2024-01-08 00:00:00") == 1.0 and at("2025-01-01 00:00:00") == 1.0 and at("soon") == 0.3 and at(None) == 0.3
    age = lambda s: one(spark, s, lambda c: T.age(T.timestamp(c), now))
    assert [age(s) for s in ("2024-01-07 23:59:30", "2024-01-07 23:30:00", "2024-01-07 20:00:00", "2024-01-05 00:00:00")] == ["just now", "30m ago", "4h ago", "3d ago"]
    assert one(spark, "2024-01-02 03:04:05", T.timestamp) == datetime(2024, 1, 2, 3, 4, 5)


def test_tokens_fold_marks_and_split_names(spark):
    assert one(spark, "Été get_user v2.0 ÜBER", T.tokens) == ["ete", "get", "user", "v2", "0", "uber"]
    assert one(spark, "<INSTRUCTIONS> do", T.is_preamble) and not one(spark, "do it", T.is_preamble)


def test_stems(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "authentication": "authent", "authenticate": "authent"}
    assert {w: stem(w) for w in pairs} == pairs
    assert one(spark, ["Ünd", "cats", "a1"], stems, "array<string>") == ["Ünd", "cat", "a1"]


def fits(spark, query, text):
    tree = fts.parse(query)
    df = spark.createDataFrame([(text,)], "v string").withColumn("tokens", T.tokens(F.col("v")))
    return df.select(fts.matches(tree, lambda p: fts.frequency(p, F.col("tokens"))).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "query,text,want",
    [
        ("alpha beta", "beta x alpha", True), ("alpha beta", "alpha", False), ("alpha OR beta", "beta", True), ("alpha NOT beta", "alpha beta", False), ("alpha NOT beta", "alpha", True),
        ('"alpha beta"', "x alpha beta", True), ('"alpha beta"', "beta alpha", False), ("alp*", "alphabet", True), ('"one tw"*', "one two", True), ("get_user", "get user", True), ("get_user", "user get", False),
        ("(a OR b) AND c", "b c", True), ("a OR b c", "a", True), ("content: alpha", "alpha", True),
    ],
)
def test_query_language(spark, query, text, want):
    assert fits(spark, query, text) is want


@pytest.mark.parametrize("query", ["auth.py", "(a", "a)", "AND", '"open', "a OR"])
def test_unreadable_queries(query):
    with pytest.raises(ValueError):
        fts.parse(query)


def test_words_query():
    assert fts.words_query("auth.py é x_1") == '"auth" "py" "x_1"' and fts.words_query("é !") is None and fts.parse("  ") is None
