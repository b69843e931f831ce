"""Conversation structure repair: the cheapest edits that make each conversation's roles follow a grammar.

Roles must read `(s?(ua)+)?`: nothing, or pairs of user and assistant, after a system
turn at most.  Four states tell what was read last: nothing, s, u or a.  A row is
kept (K), given the role that must come next (R), or deleted (D, which blank and
repeated rows must be); empty turns may be inserted anywhere (I).  The forward pass
carries for each state the least (cost, audit string), and closes each row's layer
with inserts, of which two in a row at most can be cheapest.  Of equally cheap edits
the audit string that is least in ASCII wins.  Of two audits of equal cost after the
same rows neither begins the other, as more letters cost more; so the order of
two, once told, stays, and a pass needs to keep but the few letters that tell it.

A pass is a small automaton: its layers, with costs counted from the least and
audits cut down to those letters, recur (states that can no longer be on a cheapest
way are dropped), and are looked up after their first time.
What is kept for a row is one byte a state, from which the audit is read at the end,
and one running hash a state.

The rows of a conversation are read in order by one task, as the hash of its repaired
text can be made in no other way: Spark sorts them, and they stream past, whatever
their number.  Faults, the search for repeated rows among them, are told before, by
functions and joins that spread a conversation over many tasks.

Rows go by turn, null turns first; equal turns by role and text.  Null roles and texts
are one space.  Rows without a conversation are one conversation.  A role's initial is
its first character, with its case.  Equal rows are repeats of each other.  Texts may
be of any length.  An empty table gives none.  Other columns are ignored, whatever
they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

#: Costs of changing a role, deleting a row, inserting a turn, and leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a.  What a kept role's initial leads to, and the turn that must come next.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
#: White space, as the faults have it.
BLANK = r"\x20\x09-\x0D"

Layer = tuple  # for each state (cost from the least, telling letters of the audit), or None


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows with faults set in by a hash of their place; `copies` is 0 for those dropped."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn)).cast("binary")) % 20
    said = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(as_text(text), "[.!?]", "")).when(fault != 0, as_text(text))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.when(fault == 4, "user").otherwise(as_text(role)).alias("role"), said.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def _faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character that is not white space ends no sentence."""
    return ~text.rlike(f"[^{BLANK}]"), ~text.rlike(rf"[.!?][{BLANK}]*\z")


def layered(layer: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """A layer closed with inserts: two rounds suffice, as no third in a row is cheapest."""
    for _ in range(2):
        for s, (cost, audit) in list(layer.items()):
            made = (cost + INSERT, audit + "I")
            layer[NEXT[s]] = min(layer.get(NEXT[s], made), made)
    return layer


def telling(audits: list[str]) -> list[str]:
    """Short strings in the order of the audits, that also stay so when letters follow."""
    if len(set(audits)) == 1:
        return [""] * len(audits)
    if "" in audits:  # the others go on with inserts only
        return audits
    by: dict[str, list[int]] = {}
    for k, a in enumerate(audits):
        by.setdefault(a[0], []).append(k)
    out = [""] * len(audits)
    for first, ks in by.items():
        for k, rest in zip(ks, telling([audits[k][1:] for k in ks])):
            out[k] = (first if len(by) > 1 else "") + rest
    return out


class Pass:
    """The forward pass over one conversation; its automaton is shared by all passes of a task."""

    def __init__(self) -> None:
        start = layered({0: (0, "")})
        self.start = tuple(start.get(s) for s in range(4))
        self.steps: dict[tuple, tuple] = {}
        self.codes: list[tuple[int, str]] = []  # (state before, letters), by the byte that stands for it
        self.numbers: dict[tuple[int, str], int] = {}

    def step(self, layer: Layer, initial: str, must_go: bool, truncated: bool) -> tuple:
        """(next layer, cost taken off, (state before, letters, their code) of each state)."""
        key = (layer, initial, must_go, truncated)
        if found := self.steps.get(key):
            return found
        row: dict[int, tuple[int, str, int, str]] = {}

        def offer(t: int, cost: int, audit: str, s: int, letters: str) -> None:
            row[t] = min(row.get(t, (cost, audit, s, letters)), (cost, audit, s, letters))

        add = TRUNCATED * truncated
        for s, held in enumerate(layer):
            if held:
                cost, audit = held
                offer(s, cost + DELETE, audit + "D", s, "D")
                if not must_go:
                    if initial in KEPT[s]:
                        offer(KEPT[s][initial], cost + add, audit + "K", s, "K")
                    offer(NEXT[s], cost + REROLE + add, audit + "R", s, "R")
        for _ in range(2):
            for s, (cost, audit, before, letters) in list(row.items()):
                offer(NEXT[s], cost + INSERT, audit + "I", before, letters + "I")
        # What nothing may still gain by: from a on, all can be done that can from nothing on, but a kept s (2 for deleting it), and all that can from s on
        for s, gain in ((0, DELETE), (1, 0)):
            if s in row and row[s][0] > row[3][0] + gain:
                del row[s]
        least = min(x[0] for x in row.values())
        states = sorted(row)
        short = dict(zip(states, telling([row[s][1] for s in states])))
        after = tuple((row[s][0] - least, short[s]) if s in row else None for s in range(4))
        back = tuple(self._code(row[s][2], row[s][3]) if s in row else None for s in range(4))
        self.steps[key] = after, least, back
        return self.steps[key]

    def _code(self, before: int, letters: str) -> tuple[int, str, int]:
        pair = (before, letters)
        if pair not in self.numbers:
            self.numbers[pair] = len(self.codes)
            self.codes.append(pair)
        return before, letters, self.numbers[pair]


def _written(state: int, letters: str, initial: str, role: str, text: bytes) -> bytes:
    """The lines that some edits of a row add to the repaired text, from a state on; each but the very first after a newline."""
    out = b""
    for x in letters:
        if x == "D":
            continue
        after = KEPT[state][initial] if x == "K" else NEXT[state]
        name = role if x == "K" else ROLE[after]
        out += (b"\n" if state else b"") + name.encode() + b":" + (b"" if x == "I" else text)
        state = after
    return out


class Conversation:
    """One conversation on its way through a pass."""

    def __init__(self, passing: Pass):
        self.passing, self.layer, self.cost, self.rows = passing, passing.start, 0, bytearray()
        opening = {0: "", 2: "I", 3: "II"}
        self.hashes = [hashlib.sha256(_written(0, opening[s], "", "", b"")) if s in opening else None for s in range(4)]
        self.blank = self.repeated = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = self.before = None

    def add(self, turn: int | None, role: str, text: bytes, blank: bool, truncated: bool, later: bool) -> None:
        now = (turn, role, text)
        repeated = not blank and (later or now == self.before)
        truncated = truncated and not blank and not repeated
        self.blank, self.repeated, self.truncated = self.blank + blank, self.repeated + repeated, self.truncated + truncated
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        if turn is not None and turn != self.last:  # in order
            self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
        self.initial, self.before = initial, now
        self.layer, least, back = self.passing.step(self.layer, initial if initial in "sua" else "", blank or repeated, truncated)
        self.cost += least
        hashes: list = []
        for way in back:
            if way is None:
                self.rows.append(0)
                hashes.append(None)
                continue
            s, letters, code = way
            self.rows.append(code)
            held = self.hashes[s]
            if letters != "D":  # a hash may be shared, so it is copied before it goes on
                held = held.copy()
                held.update(_written(s, letters, initial, role, text))
            hashes.append(held)
        self.hashes = hashes

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        end = min((s for s in ENDS if self.layer[s]), key=lambda s: self.layer[s])
        state, audit = end, []
        for k in range(len(self.rows) - 4, -1, -4):
            state, letters = self.passing.codes[self.rows[k + state]]
            audit.append(letters)
        audit.append({0: "", 2: "I", 3: "II"}[state])
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.repeated, self.truncated, self.illegal, self.cost + self.layer[end][0], "".join(reversed(audit)), self.hashes[end].hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation of (conv_id, turn, role, text, copies), as `damage` gives them."""
    blank, truncated = _faults(F.col("text"))
    rows = rows.withColumn("h", F.when(F.col("copies") > 0, F.sha2(F.col("text").cast("binary"), 256))).withColumn("order", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    same = [rows["conv_id"], "role", "h"]
    repeats = rows.where("copies > 0").groupBy(*same).agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first")
    rows = rows.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", blank.alias("blank"), truncated.alias("truncated"), F.coalesce(F.col("order") > F.col("first"), F.lit(False)).alias("later"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, passing, done, name, held = to_arrow_schema(schema), Pass(), [], None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
        for batch in batches:
            for part in pieces(batch, 4096):
                texts = part.column(3).cast(pa.binary())
                for conv, turn, role, text, copies, *faults in zip(*(c.to_pylist() for c in [*part.columns[:3], texts, *part.columns[4:]])):
                    if held is None or conv != name:
                        if held is not None:
                            done.append((name, *held.result()))
                        name, held = conv, Conversation(passing)
                    for _ in range(copies):
                        held.add(turn, role, text, *faults)
                if done:
                    yield made()
                    done = []
        if held is not None:
            done = [(name, *held.result())]
            yield made()

    return rows.mapInArrow(run, schema)
