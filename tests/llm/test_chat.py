import random
import re

from loomstore.llm import chat as C

A = "Hello all.\n\nThe plan is to ship on Friday.\nIt is ready."
B = "> The plan is to ship on Friday.\n> It is ready.\n\nWhich Friday?"
D = "On Monday, Bo wrote:\n> > The plan is to ship on Friday.\n> Which Friday?\n\nThis one."


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, hash string, level int")
    return {(r["conv_id"], r["turn"]): r for r in C.link_quotations(df).collect()}


def test_nested_quotes_are_linked_and_removed(spark):
    found = run(spark, [(1, 0, "user", A), (1, 1, "assistant", "Unrelated."), (1, 2, "user", B), (1, 3, "assistant", D), (2, 0, "user", "> it   IS ready.\nWhy?")])
    b, d, far = found[1, 2], found[1, 3], found[2, 0]
    assert b["text"] == "Which Friday?" and (b["n_quotes"], b["max_level"], b["n_linked"]) == (1, 1, 1)
    assert d["text"] == "This one." and (d["n_quotes"], d["max_level"], d["n_linked"]) == (2, 2, 2)
    assert (d["reply_conv"], d["reply_turn"]) == (1, 2)  # its passage of the lowest level
    assert (far["reply_conv"], far["reply_turn"], far["n_linked"]) == (1, 0, 1)
    assert found[1, 1]["reply_turn"] == 0 and found[1, 0]["reply_turn"] is None


def test_replies_follow_their_targets(spark):
    rows = [(1, 0, "u", "alpha"), (1, 1, "a", "beta"), (1, 2, "u", "> beta\ngamma"), (1, 3, "u", "> alpha\ndelta")]
    found = run(spark, rows)
    assert [found[1, t]["position"] for t in range(4)] == [1, 2, 4, 3]
    lines = C.chat_lines(C.link_quotations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).orderBy("position").collect()
    assert [r["line"] for r in lines] == ["<|u|>alpha", "<|a|>beta", "<|u|>delta", "<|u|>gamma"]


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "u", ""), (1, 2, "u", ">"), (1, 2, "u", ">"), (None, None, "u", "> x"), (3, 0, "u", ">>> deep\n>> mid\n> top\nplain"), (4, 0, "u", "> " + "long " * 20000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = C.link_quotations(df).collect()
    assert len(found) == len(rows)
    deep = next(r for r in found if r["conv_id"] == 3)
    assert (deep["n_quotes"], deep["max_level"], deep["text"]) == (3, 3, "plain")
    assert C.link_quotations(df.limit(0)).count() == 0


def test_a_passage_that_many_share_joins_as_one_row(spark):
    rows = [(c, 0, "u", "the same opening line") for c in range(300)] + [(c, 1, "a", "> the same opening line\nanswer") for c in range(300)]
    found = run(spark, rows)
    assert all(found[c, 1]["reply_conv"] == c and found[c, 1]["reply_turn"] == 0 and found[c, 1]["n_linked"] == 1 for c in range(300))


def test_sql_gives_the_same_rows_where_there_are_quotes(spark):
    import duckdb
    import pandas as pd

    from loomstore.llm.queries import OP5_SQL

    rows = [(1, 0, "user", A), (1, 1, "assistant", "Unrelated."), (1, 2, "user", B), (1, 3, "assistant", D), (2, 0, "user", "> it   IS ready.\nWhy?"), (2, 1, "user", "> Why?\n>> it is ready.\n\n> Unrelated.\nok"), (3, 0, "u", None), (3, 1, "u", ">"), (3, 2, "u", "> nowhere\n"), (3, 3, "u", "\n\nok\n\n")]
    columns = ["conv_id", "turn", "role", "text"]
    df = C.link_quotations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=columns))
    found = con.sql(OP5_SQL)
    assert sorted(found.columns) == sorted(df.columns)
    want = sorted(map(repr, (tuple(r[c] for c in found.columns) for r in df.collect())))
    assert sorted(map(repr, found.fetchall())) == want


def test_excerpts_of_several_lines_are_linked(spark):
    long = "one a\ntwo b\nthree c\nfour d"
    paragraphs = "first p\n\nsecond p\n\nthird p"
    rows = [
        (1, 0, "u", long), (1, 1, "a", paragraphs), (1, 2, "u", "filler"), (1, 3, "a", "> two b\n>  THREE c\nyes"), (1, 4, "u", "> second p\n>\n> third p\nno"),
        (1, 5, "a", "> two b\n> four d\nnot a run"), (1, 6, "u", "> one a\nwell\nso\n> four d\nok"), (1, 7, "a", "filler 2"), (1, 8, "u", "> well\n> so\nfine"), (2, 0, "u", "> three c\n> four d\nwhere?"),
    ]
    found = run(spark, rows)
    got = {k: (r["n_linked"], r["reply_conv"], r["reply_turn"]) for k, r in found.items()}
    assert got[1, 3] == (1, 1, 0) and got[1, 4] == (1, 1, 1) and got[1, 8] == (1, 1, 6) and got[2, 0] == (1, 1, 0)
    assert got[1, 5] == (0, 1, 4) and got[1, 6] == (2, 1, 0)


def test_a_source_in_another_conversation_is_found_past_the_own_one(spark):
    rows = [(1, 0, "u", "> shared words\nwhat?"), (1, 1, "a", "shared words"), (2, 0, "u", "shared words"), (3, 5, "u", "shared words"), (3, 1, "u", "> shared words\nand?")]
    found = run(spark, rows)
    assert (found[1, 0]["n_linked"], found[1, 0]["reply_conv"], found[1, 0]["reply_turn"]) == (1, 2, 0)
    assert (found[3, 1]["reply_conv"], found[3, 1]["reply_turn"]) == (1, 1)


def brute(rows):
    """Row by row, by the definition: text, quotes, level, links, reply and place of each (conversation, turn, role, text)."""
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip(" ")
    parsed = []
    for conv, turn, role, text in rows:
        lines = []
        for line in (text or "").split("\n"):
            mark = re.match(r"(?:[ \t]*>)+[ \t]?", line)
            lines.append((mark[0].count(">"), line[mark.end() :]) if mark else (0, line))
        passages, plain = [], []
        for k, (level, line) in enumerate(lines):
            if level and k and lines[k - 1][0] == level:
                passages[-1][1].append(line)
            elif level:
                passages.append((level, [line]))
            elif not (line.rstrip(" ").endswith("wrote:") and k + 1 < len(lines) and lines[k + 1][0]):
                plain.append(line)
        parsed.append((conv, turn, role, "\n".join(plain).strip("\n"), [(level, "\n".join(x)) for level, x in passages]))

    def has(plain, passage):
        """Whether a message has a passage whole, as a paragraph or a line (0), or as a run of its lines (1)."""
        parts = [plain, *re.split(r"\n\s*\n", plain), *plain.split("\n")]
        if norm(passage) in map(norm, parts):
            return 0
        want, own = ([norm(x) for x in t.split("\n") if norm(x)] for t in (passage, plain))
        return 1 if len(want) > 1 and any(own[i : i + len(want)] == want for i in range(len(own))) else None

    out = []
    for conv, turn, role, plain, passages in parsed:
        links = set()
        for place, (level, passage) in enumerate(passages):
            if not norm(passage) or conv is None or turn is None:
                continue
            for how in (0, 1):
                first = {}
                for c, t, _, p, _ in parsed:
                    if c is not None and t is not None and has(p, passage) in ((0, 1) if how else (0,)):
                        first[c] = min(t, first.get(c, t))
                if turn is not None and conv in first and first[conv] < turn:
                    source = conv, first[conv]
                else:
                    source = min(((c, t) for c, t in first.items() if conv is not None and c != conv), default=None)
                if source:
                    links.add((level, place, norm(passage), *source))
                    break
        near = min((x for x in links if x[3] == conv), default=None)
        anywhere = min(((a, b, c, t) for a, b, _, c, t in links), default=None)
        before = max((t for c, t, *_ in parsed if c == conv and t is not None and turn is not None and t < turn), default=None)
        target = near[4] if near else before
        reply = (anywhere[2], anywhere[3]) if near is None and anywhere else (conv if target is not None else None, target)
        out.append([conv, turn, role, plain, len(passages), max([x for x, _ in passages], default=0), len(links), *reply, target])
    return out


def test_random_nested_quotes_equal_brute_force(spark):
    rng = random.Random(11)
    lines = ["alpha one", "Beta  two", "gamma three", "delta", "epsilon five", "", "zeta wrote:"]
    for _ in range(3):
        rows = []
        for conv in [*range(6), None]:
            for turn in range(rng.randrange(1, 6)):
                text = []
                for _ in range(rng.randrange(1, 7)):
                    text.append("> " * rng.choice([0, 0, 1, 1, 2]) + rng.choice(lines))
                rows.append((conv, rng.choice([turn, turn, turn, None]) if conv == 5 else turn, rng.choice(["user", "assistant", None]), "\n".join(text)))
        found = [tuple(r) for r in C.link_quotations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()]
        want = brute(rows)
        assert sorted(map(repr, (r[:9] for r in found))) == sorted(repr(tuple(w[:9])) for w in want)
        targets = {}
        for w in want:
            targets.setdefault(tuple(map(repr, w[:9])), w[9])
        for conv in {r[0] for r in rows}:
            mine = sorted((r for r in found if r[0] == conv), key=lambda r: r[9])
            assert [r[9] for r in mine] == list(range(1, len(mine) + 1))
            keys = [(targets[tuple(map(repr, r[:9]))], r[1], r[2]) for r in mine]
            none_first = [tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in k) for k in keys]
            assert none_first == sorted(none_first, key=lambda k: tuple((a, str(b) if isinstance(b, str) else b) for a, b in k))


def test_a_giant_conversation_is_numbered_over_several_ranges(spark):
    rows = [(None if k % 2 else 1, k // 4, "u", f"text {k}") for k in range(4000)] + [(2, 0, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    ranged = C._ranged(df, "turn")
    assert ranged.where("conv_id = 1").select("range").distinct().count() > 1 and ranged.where("conv_id is null").select("range").distinct().count() > 1
    found = C.link_quotations(df).collect()
    for conv in (None, 1):
        mine = sorted((r for r in found if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(1, 2001)) and [r["turn"] for r in mine] == sorted(r["turn"] for r in mine)
        assert all(r["reply_turn"] == (r["turn"] - 1 if r["turn"] else None) for r in mine)


def test_long_messages_and_many_lengths_of_quotations(spark):
    """One long message, and quotations of 400 lengths out of it: runs are looked for only where one begins."""
    import time

    lines = [f"line number {k} of the long message" for k in range(4000)]
    rows = [(1, 0, "user", "\n".join(lines))] + [(1, k, "assistant", "\n".join("> " + x for x in lines[7 * k : 7 * k + k + 1]) + "\nI see") for k in range(1, 401)]
    rows += [(2, 0, "user", "\n".join(["same"] * 3000)), (2, 1, "assistant", "\n".join(["> same"] * 700))]
    began = time.perf_counter()
    got = {(r["conv_id"], r["turn"]): r for r in C.link_quotations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert time.perf_counter() - began < 60
    assert all(got[1, k]["n_linked"] == 1 and got[1, k]["reply_turn"] == 0 for k in range(1, 401)) and got[2, 1]["reply_turn"] == 0
