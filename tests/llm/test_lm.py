import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstore.llm import lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [" "]


class Automaton:
    """The model written out: states by the words they stand for, arcs as (weight, next state), failure arcs as (weight, next state)."""

    def __init__(self, train):
        runs = Counter()
        for text in train:
            seq = ["<s>", *tokens(text)]
            runs.update(tuple(seq[i : i + n]) for n in range(1, lm.ORDER + 1) for i in range(len(seq) - n + 1))
        words = Counter({k[0]: c for k, c in runs.items() if len(k) == 1 and k != ("<s>",)})
        self.n, self.words = sum(words.values()), words
        self.norm = self.n + 0.5 * (len(words) + 1)
        self.states = {(), *(k for k in runs if len(k) < lm.ORDER and k[-1] != " ")}
        self.arcs = {(): {w: math.log10((c + 0.5) / self.norm) for w, c in words.items()}}
        self.fail = {}
        for state in sorted(self.states - {()}, key=len):
            self.fail[state] = math.log10(lm.PULL / (runs[state] + lm.PULL)), self.shorter(state[1:])
            self.arcs[state] = {}
        for run, c in sorted(runs.items(), key=lambda x: len(x[0])):
            if len(run) > 1:
                lower = 10 ** self.step(self.shorter(run[1:-1]), run[-1])[0]
                self.arcs[run[:-1]][run[-1]] = math.log10((c + lm.PULL * lower) / (runs[run[:-1]] + lm.PULL))

    def shorter(self, run):
        while run not in self.states:
            run = run[1:]
        return run

    def step(self, state, word):
        """Weight of reading a word, and the state that it leads to."""
        weight, at = 0.0, state
        while word not in self.arcs[at]:
            if at == ():
                return weight + math.log10(0.5 / self.norm), ()
            w, at = self.fail[at]
            weight += w
        return weight + self.arcs[at][word], self.shorter((*state, word)[-(lm.ORDER - 1) :])

    def read(self, text):
        state, total = self.shorter(("<s>",)), 0.0
        for word in tokens(text):
            weight, state = self.step(state, word)
            total += weight
        found = tokens(text)
        return len(found), sum(self.words[w] > 0 for w in found), sum(math.log10((self.words[w] + 0.5) / self.norm) for w in found), total


def agree(make_docs, docs, learned):
    rows, total = lm.score_texts(make_docs(docs), F.col("doc_id").isin(*learned))
    model = Automaton([t for i, t in docs if i in learned])
    assert total == model.n
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows.collect()), key=lambda r: (r[:4], round(r[5], 6)))
    want = sorted(((i is None, i or 0, *model.read(t)) for i, t in docs), key=lambda r: (r[:4], round(r[5], 6)))
    assert len(found) == len(want)
    for f, w in zip(found, want):
        assert f[:4] == w[:4] and abs(f[4] - w[4]) < 1e-6 and abs(f[5] - w[5]) < 1e-6, (f, w)


SIZES = [{}, {"BLOCK_TOKENS": 6, "ROW_TOKENS": 3, "PART_TOKENS": 2}, {"BLOCK_TOKENS": 0, "ROW_TOKENS": 0, "PIECE_BYTES": 4}, {"BLOCK_TOKENS": 20, "PIECE_BYTES": 12, "PART_TOKENS": 8}, {"ORDER": 2, "BLOCK_TOKENS": 4}, {"ORDER": 4, "PIECE_BYTES": 9, "BLOCK_TOKENS": 15}]


@pytest.mark.parametrize("sizes", SIZES)
def test_scores_equal_those_of_the_automaton_written_out(make_docs, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lm, name, value)
    train = ["a b c d", "a b c e", "rare1 rare2 a b", "rare1 rare2", "once more", "a rare1 b", None, "c c c", "a b c d a b c d a b"]
    docs = ["a b c d", "A B rare1 rare2", "once more once more", "unseen a b unseen unseen", "b a d c", "", "c c c c", "x a b c"]
    rows = list(enumerate(train + docs)) + [(3, "rare1 rare2"), (30, "a b c d"), (30, "a b c d"), (None, "a b c")]
    agree(make_docs, rows, set(range(len(train))))


def test_odd_texts(make_docs, texts, monkeypatch):
    texts = [t if t is None else t[:3000] for t in texts]
    rows = list(enumerate(texts)) + [(3, texts[3]), (500, "the the zzz the of of"), (500, "the the zzz the of of")]
    agree(make_docs, rows, set(range(5, 20)))
    monkeypatch.setattr(lm, "PIECE_BYTES", 40)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 30)
    agree(make_docs, rows, set(range(5, 20)))


def test_each_state_s_probabilities_sum_to_one():
    model = Automaton(["a b a b c", "a b d", "b b a", "", "c a b"])
    for state in model.states:
        total = sum(10 ** model.step(state, w)[0] for w in [*model.words, "never seen"])
        assert abs(total - 1) < 1e-9, state


def test_the_model_beats_the_base_where_order_tells(make_docs):
    rows = [(i, "red green blue " * 20) for i in range(30)] + [(99, "red green blue red green blue")]
    r = lm.score_texts(make_docs(rows), F.col("doc_id") < 50)[0].where("doc_id = 99").first()
    assert r["score"] > r["base_score"] + 1


def test_nothing_learned(make_docs):
    r = lm.score_texts(make_docs([(1, "a b"), (2, None)]), F.lit(False))[0].orderBy("doc_id").collect()
    assert [(x["n_tokens"], x["n_known"], x["base_score"], x["score"]) for x in r] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert lm.score_texts(make_docs([]), F.lit(True))[0].count() == 0


def test_pieces_hold_the_words_of_the_text(monkeypatch):
    text = ("one two  three\n" * 50 + "x" * 500 + " end").encode()
    whole = lm.words_of(text)
    for size in (1, 7, 100, 10_000):
        monkeypatch.setattr(lm, "PIECE_BYTES", size)
        assert [w for p in lm.pieces_of(text) for w in p] == whole
    assert list(lm.pieces_of(None)) == [[]]
