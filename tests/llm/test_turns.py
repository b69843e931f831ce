import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from loomstore.llm import turns as R
from loomstore.llm.queries import ORACLE_SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies string, h int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def cheapest(kinds):
    """(cost, audit, lines) of the cheapest edits, by trying states one after another without any pruning but cost."""
    best = {0: (0, "", ())}
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    names = {"u": "user", "a": "assistant"}

    def inserts(layer):
        for _ in range(3):
            for s, (c, a, ls) in list(layer.items()):
                for x in "ua":
                    if s in step[x]:
                        new = (c + 5, a + "I", (*ls, (names[x], "")))
                        t = step[x][s]
                        layer[t] = min(layer.get(t, new), new)
        return layer

    best = inserts(best)
    for role, text, must, cut in kinds:
        after = {}
        for s, (c, a, ls) in best.items():
            ways = [(s, c + 2, "D", ls)]
            if not must:
                if role[:1] in step and s in step[role[:1]]:
                    ways.append((step[role[:1]][s], c + 5 * cut, "K", (*ls, (role, text))))
                ways += [(step[x][s], c + 1 + 5 * cut, "R", (*ls, (names[x], text))) for x in "ua" if s in step[x]]
            for t, cost, letter, lines in ways:
                after[t] = min(after.get(t, (cost, a + letter, lines)), (cost, a + letter, lines))
        best = inserts(after)
    return min(best[s] for s in (0, 3) if s in best)


def brute(rows):
    held, out = damaged(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in held if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            blank, again = not text.strip(SPACE), (role, text) in seen
            cut = not blank and not again and text.rstrip(SPACE)[-1] not in ".!?"
            seen.add((role, text))
            kinds.append((role, text, blank or again, cut))
            counts = [counts[0] + blank, counts[1] + (not blank and again), counts[2] + cut]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        numbers = {r[1] for r in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, lines = cheapest(kinds)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(4)
    rows = []
    for conv in range(150):
        turn = 0
        for _ in range(rng.randrange(1, 14)):
            turn += rng.choice([0, 1, 1, 1, 3])
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "System", "u", "sam"])
            rows.append((conv, rng.choice([turn, turn, turn, None]) if conv % 9 == 0 else turn, role, rng.choice(["Hi.", "hi", "what?", "Fine! ", "no end \n", "", " \t", None, "é!", "x" * 2000 + "."])))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "no"), (None, None, "user", "a!")]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)


def test_equals_brute_force_and_the_sql(spark, tmp_path):
    rows = cases()
    df = rows_of(spark, rows)
    got = sorted((tuple(r) for r in R.repair(R.damage(df)).collect()), key=repr)
    assert got == brute(rows)
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{tmp_path}/c/*.parquet'")
    assert sorted(con.sql(ORACLE_SQL["op12_turn_repair"]).fetchall(), key=repr) == got


def test_cheapest_of_all_edits():
    """The pass against every string of edits of short conversations."""
    names = {"u": "user", "a": "assistant"}
    for roles in product(["user", "assistant", "system", "tool"], repeat=3):
        found = []
        for letters in product("KRDI", repeat=5):
            for edits in {letters[:n] for n in range(6)}:
                state, at, cost, ok = 0, 0, 0, True
                for e in edits:
                    if e == "I" or e == "R":
                        state = R.NEXT[state]
                        cost += 5 if e == "I" else 1
                    elif e == "K" and at < 3:
                        ok = ok and roles[at][0] in R.KEPT[state]
                        state = R.KEPT[state].get(roles[at][0], state)
                    else:
                        cost += 2
                    at += e != "I"
                if ok and at == 3 and state in R.ENDS:
                    found.append((cost, "".join(edits)))
        held = R.Conversation(R.Pass())
        for k, role in enumerate(roles):
            held.add(k, role, b"%d." % k, False, False, False)
        result = held.result()
        assert (result[5], result[6]) == min(found), (roles, names)


def test_long_conversations_need_few_layers_and_little_time(spark):
    passing = R.Pass()
    held = R.Conversation(passing)
    rng = random.Random(5)
    for k in range(100_000):
        held.add(k, rng.choice(["user", "user", "assistant", "tool"]), b"some text %d." % k, rng.random() < 0.05, rng.random() < 0.1, rng.random() < 0.05)
    result = held.result()
    assert len(passing.steps) < 3000 and len(passing.codes) < 100 and sum(c in "KRD" for c in result[6]) == 100_000
    same = R.Conversation(R.Pass())
    for k in range(30_000):  # audits that never have a common beginning again
        same.add(k, "user", b"a%d." % k, False, False, False)
    assert same.result()[5] == 15_000 and len(same.rows) == 4 * 30_000


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, 0, "user", "a")] * 3])
def test_few_rows(spark, rows):
    assert sorted((tuple(r) for r in R.repair(R.damage(rows_of(spark, rows))).collect()), key=repr) == brute(rows)
