"""Language-model scoring with a weighted backoff automaton of order ORDER.

The n-grams of the learned texts, up to ORDER words, are counted without a cap.
Its states are the root, and every word and every run of up to ORDER - 1 words
that was learned.  The root gives a token w the smoothed unigram probability
(c + 0.5) / (N + 0.5 (V + 1)).  A state h has an arc for each word w that was
learned after it, weighing (c(hw) + PULL p) / (c(h) + PULL), where p is what the
state of h's last words but one gives w; and a failure arc to that state, weighing
PULL / (c(h) + PULL).  So the probabilities of every state sum to one, unseen
words included.  A text is read once from left to right: the state carried is the
longest learned run that ends at the token before; a token takes its arc, or
fails down the chain to the state that has one, or to the root.  The log-
probabilities (base 10) along the way are added up.  A state and its arcs follow
from the last ORDER - 1 words alone, so all positions of a block are read at once.

Size.  Texts are cut into blocks of about BLOCK_TOKENS tokens (see `blocks`).
A block asks for the counts of its own n-grams, level by level, and builds the
part of the automaton that its texts can reach.  If no other block has an n-gram's
first or last words (all but one), it needs no asking: all there is of it is in the
block; nor does it if they were never learned.  No part of the model is on the driver or broadcast, and what is
gathered grows with the texts.  A very long text is cut into pieces that carry the
last ORDER - 1 words over.

Words and n-grams go by 64 bits of a hash, in the counts as well: two of them can
be taken for one with a chance of about (number of n-grams)^2 / 2^65.

A null or empty text has no words, but an end.  A row without an id is scored like
others; `learned` says what is learned from (null: not).  Repeated rows are scored
(and learned from) each; other columns are ignored.  If nothing was learned all
scores are 0.  An empty table has no rows.  Nothing is decided by an order, so there
are no ties.  Ids that are not numbers are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import ASCII_LOWER

ORDER = 3
#: Weight of the shorter run in that of the longer, in tokens.
PULL = 100.0
#: Tokens of a block, and bytes of text that are one piece; both bound a task's memory.
BLOCK_TOKENS, PIECE_BYTES = 1 << 19, 1 << 22
#: Tokens of a block that are written as one row.
ROW_TOKENS = 1 << 16
#: N-grams, on average, that one task adds up at a time.
PART_TOKENS = 1 << 20

START, END = b" s", b" "  # no word holds a space
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
BLOCKS = "block bigint, part int, doc_id array<bigint>, text_block array<bigint>, text_place array<bigint>, size array<int>, lead array<int>, learned array<boolean>, tokens binary, names binary, n bigint, total bigint"
SCORED = "text_block bigint, text_place bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ASCII_LOWER).split()


def pieces_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, a piece of about PIECE_BYTES at a time; one piece at least."""
    text = text or b""
    at = 0
    while len(text) - at > PIECE_BYTES and (gap := _SPACE.search(text, at + PIECE_BYTES)):
        yield words_of(text[at : gap.start()])
        at = gap.start()
    yield words_of(text[at:])


def _type(kind: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    return pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]


def _columns(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(c.split()[0], _type(c.split()[1])) for c in schema.split(", ")]


class Packer:
    """Cuts texts into blocks, and blocks into rows of BLOCKS."""

    def __init__(self):
        self.made, self.kinds = 0, _columns(BLOCKS)
        self._block()

    def _block(self) -> None:
        from xxhash import xxh64_intdigest

        class Names(dict):
            """Word -> its number in the block; new words' hashes are gathered."""

            def __missing__(names, word: bytes) -> int:  # noqa: N805
                self.hashes.append(xxh64_intdigest(word, 7))
                names[word] = n = len(names)
                return n

        self.block, self.part, self.tokens_so_far = B.block_number(self.made), 0, 0
        self.made += 1
        self.hashes: list[int] = []
        self.names = Names()
        self._row()

    def _row(self) -> None:
        self.row = {name: [] for name, _ in self.kinds[2:8]}
        self.tokens: list[int] = []
        self.total = 0
        self.hashes.clear()

    def rows(self, doc_id: int | None, learned: bool, text: bytes | None) -> Iterator[pa.RecordBatch]:
        """Takes a text in; gives the rows that are full."""
        pieces, before, first = pieces_of(text), [START], None
        piece = next(pieces)
        while piece is not None:
            following = next(pieces, None)
            first = first or (self.block, self.tokens_so_far)
            words = [*before, *piece] if following is not None else [*before, *piece, END]
            names = self.names
            self.tokens += [names[w] for w in words]
            counted = len(words) - len(before)
            for name, value in zip(self.row, (doc_id, *first, len(words), len(before), learned)):
                self.row[name].append(value)
            self.total += counted * learned
            self.tokens_so_far += len(words)
            before, piece = words[-(ORDER - 1) :], following
            if self.tokens_so_far > BLOCK_TOKENS:
                yield self.full()
                self._block()
            elif len(self.tokens) > ROW_TOKENS:
                yield self.full()

    def full(self) -> pa.RecordBatch:
        tokens, names = B.packed(np.array(self.tokens, np.uint64)), B.packed(np.array(self.hashes, np.uint64))
        values = (self.block, self.part, *self.row.values(), tokens, names, len(self.tokens), self.total)
        batch = pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, self.kinds)], names=[n for n, _ in self.kinds])
        self.part += 1
        self._row()
        return batch


def pack(rows: DataFrame) -> DataFrame:
    """(doc_id, learned, text) as a table of BLOCKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    yield from packer.rows(*row)
        if packer.tokens:
            yield packer.full()

    return B.write_blocks(rows.mapInArrow(run, BLOCKS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Level:
    """A block's n-grams of one length: which each position ends, how often the block learns them, and which it must ask for."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, counted: np.ndarray):
        """keys: by position; places: of the positions that end a whole n-gram; counted: whether a position is learned."""
        self.keys, self.places = keys, places
        ranked = keys[places]
        order = ranked.argsort()  # which of equal ones comes first does not matter
        ranked = ranked[order]
        new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        self.distinct, self.first = ranked[new], order[new]
        self.which = np.empty(len(order), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - 1
        self.own = np.bincount(self.which, counted[places], len(self.distinct)).astype(np.int64)
        self.asked = np.ones(len(self.distinct), bool)

    def take(self, counts: np.ndarray, elsewhere: np.ndarray) -> None:
        """What was asked for: how often all blocks learn an n-gram, and whether other blocks have it at all."""
        self.counts, self.elsewhere = self.own.copy(), np.zeros(len(self.own), bool)
        self.counts[self.asked], self.elsewhere[self.asked] = counts, elsewhere

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """Values of the distinct n-grams, by position; 0 where none ends."""
        out = np.zeros(size, values.dtype)
        out[self.places] = values[self.which]
        return out


class Automaton:
    """The part of the model that a block's texts can reach: counts of their n-grams, by the positions that they end at."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("part")
        lists = {c: np.array([x for part in rows[c].to_pylist() for x in part]) for c in ("text_block", "text_place", "size", "lead", "learned")}
        self.doc_id = [x for part in rows["doc_id"].to_pylist() for x in part]
        self.text = lists["text_block"], lists["text_place"]
        names = np.concatenate([B.unpacked(x) for x in rows["names"].to_pylist()])
        self.words = names[np.concatenate([B.unpacked(x) for x in rows["tokens"].to_pylist()]).astype(np.int64)]
        size = lists["size"].astype(np.int64)
        starts = np.cumsum(size) - size
        self.piece = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.place = (np.arange(len(self.words)) - starts[self.piece]).astype(np.int32)
        self.read = self.place >= lists["lead"][self.piece]
        learned = lists["learned"].astype(bool)[self.piece]
        self.counted = learned & self.read
        first = (lists["text_block"] == rows["block"][0].as_py()) & (lists["text_place"] == starts)
        self.starts = learned & first[self.piece] & (self.place == 0)  # START is counted as a state alone
        self.levels: list[Level] = []

    def deepen(self) -> Level:
        """The n-grams one word longer than so far; to be asked for are those that other blocks may have, and that may have been learned."""
        n = len(self.levels) + 1
        if n == 1:
            level = Level(self.words, np.arange(len(self.words), dtype=np.int32), self.counted | self.starts)
        else:
            last, size = self.levels[-1], len(self.words)
            keys = np.zeros(size, np.uint64)
            keys[1:] = _mix(last.keys[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + self.words[1:])
            level = Level(keys, np.flatnonzero(self.place >= n - 1).astype(np.int32), self.counted)
            at = level.places[level.first]
            shared = last.spread(last.elsewhere & (last.counts > 0), size)
            level.asked = shared[at - 1] & shared[at]
        self.levels.append(level)
        return level

    def with_answers(self, got: pa.Table | None, levels: int) -> Automaton:
        for n in range(1, levels + 1):
            self.deepen().take(*B.answers_of(got, n))
        return self

    def scores(self, total: int, distinct: int) -> pa.Table:
        """A row of SCORED for each piece."""
        size, norm = len(self.words), total + 0.5 * (distinct + 1)
        here = self.levels[0].spread(self.levels[0].counts, size)
        root = np.log10((here + 0.5) / norm)
        known, weight = here > 0, root
        for level in self.levels[1:]:
            state = np.zeros(size)  # how often the run before the token was learned; 0: no such state, the next shorter one is carried
            state[1:] = here[:-1]
            here = level.spread(level.counts, size)
            failing = np.log10(PULL / (state + PULL)) + weight
            weight = np.where(here > 0, np.log10((here + PULL * 10**weight) / (state + PULL)), failing)
        piece, pieces = self.piece[self.read], len(self.doc_id)
        sums = [np.bincount(piece, x[self.read], pieces) for x in (np.ones(size), known, root, weight)]
        columns = (*self.text, self.doc_id, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], sums[3])
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _columns(SCORED))], names=[n for n, _ in _columns(SCORED)])


def score_texts(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Per row of `docs`: doc_id, n_tokens, n_known, base_score, score; and the number of training tokens.

    `learned` is a condition over `docs`.  To score other texts than those that are learned, unite them first.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.col(text_col).cast("binary").alias("text"))
    table = pack(rows)
    size, total = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART_TOKENS))

    answers = None
    for n in range(1, ORDER + 1):

        def asking(block: int, rows: pa.Table, got: pa.Table | None, n: int = n) -> pa.Table:
            level = Automaton(rows).with_answers(got, n - 1).deepen()
            return B.ask(block, level.distinct[level.asked], level.own[level.asked], parts)

        found = B.answer(B.read_blocks(table, answers, asking, B.ASKED), n)
        if n == 1:
            distinct = found.agg(F.coalesce(F.sum("present"), F.lit(0))).first()[0] - bool(total)  # START is no word
        answers = found if answers is None else answers.unionByName(found)

    scored = B.read_blocks(table, answers, lambda _, rows, got: Automaton(rows).with_answers(got, ORDER).scores(int(total), int(distinct)), SCORED)
    sums = scored.groupBy("text_block", "text_place").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return sums.select("doc_id", "n_tokens", "n_known", F.col("base").alias("base_score"), "score"), int(total)
