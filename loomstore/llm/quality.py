"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a row of figures (shares of character classes, repetition, word
and line shapes).  Each figure is cut into at most BINS bins at quantiles of the
sample.  Boosting goes round the figures in turn: each time a shallow tree of at
most LEAVES leaves over one figure's bins is fitted to the residual and added,
damped, to that figure's table.  Then the pairs of figures whose four-way split
explains most of what is left are boosted in the same way with trees of one cut
on each side.  A score is the logistic of the sum of the tables' entries, so
whole batches are scored by look-ups and additions.

The model is fitted on the driver, on the figures of at most PER_CLASS labelled
rows a class (weighed back to the classes' sizes): a documented bound.  Texts
are read whole everywhere.  Null and empty texts have the figures of no words,
and a score like others.  With labels of one class, or none, the score is that
class's share (0.5 without labels).  A figure that ties with a bin's edge falls
into the bin above.  Repeated rows are scored each; a labelled id with several
rows is learned from once.  An empty table gives no rows; other columns are
ignored by `score` and kept as they are by `keep_good`, whatever they are called.
Ids that are not numbers are an error to `score`.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep_rows, labelled_sample, map_rows

PER_CLASS, BINS, LEAVES, ROUNDS, PAIRS, PAIR_BINS, PAIR_ROUNDS, RATE = 8_000, 32, 4, 60, 8, 8, 30, 0.15

_CLASSES = np.zeros((256, 7))
for _c in range(256):
    _CLASSES[_c] = [65 <= _c <= 90, 97 <= _c <= 122, 48 <= _c <= 57, chr(_c) in ".,;:'\"-()", chr(_c) in "!?", _c < 128 and chr(_c) in "#$%&*+/<=>@[\\]^_`{|}~", _c < 33]
FIGURES = ["upper", "lower", "digit", "marks", "shouts", "symbols", "space", "words", "word_length", "distinct", "top_word", "repeats", "odd_ends", "bare", "lines", "line_repeats"]


def figures(text: str | None) -> list[float]:
    """The row of FIGURES."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FIGURES)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / len(raw)
    counts = Counter(words)
    distinct = len(counts)
    odd = sum(k for w, k in counts.items() if w[-1] in b"#$%&*|!@^~+=")
    bare = sum(k for w, k in counts.items() if not any(c > 64 for c in w) or w == b"|")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        *shares.tolist(), math.log(n), sum(map(len, words)) / n, distinct / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n,
        odd / n, bare / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
    ]


def _best_cuts(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The table over bins of a tree with at most `leaves` leaves, grown best first on gradient and weight sums."""
    spans, smooth = [(0, len(g))], 1.0
    gain = lambda a, z: g[a:z].sum() ** 2 / (h[a:z].sum() + smooth)
    while len(spans) < leaves:
        best = (1e-9, None)
        for s, (a, z) in enumerate(spans):
            if z - a < 2:
                continue
            gs, hs = np.cumsum(g[a:z]), np.cumsum(h[a:z])
            each = gs[:-1] ** 2 / (hs[:-1] + smooth) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + smooth) - gain(a, z)
            k = int(each.argmax())
            if each[k] > best[0]:
                best = (float(each[k]), (s, a + k + 1))
        if best[1] is None:
            break
        s, at = best[1]
        a, z = spans.pop(s)
        spans += [(a, at), (at, z)]
    out = np.zeros(len(g))
    for a, z in spans:
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + smooth)
    return out


def _best_cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best cut on each side of a pair's grid."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    full = lambda s: (s, s[:, -1:] - s, s[-1:, :] - s, s[-1, -1] - s[:, -1:] - s[-1:, :] + s)
    parts = list(zip(full(gs), full(hs)))
    each = sum(a**2 / (b + 1.0) for a, b in parts)
    i, j = np.unravel_index(int(each.argmax()), each.shape)
    out = np.zeros_like(g)
    for (a, b), (rows, columns) in zip(parts, ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, columns] = a[i, j] / (b[i, j] + 1.0)
    return float(each[i, j]), out


class Gam:
    """Look-up tables of the figures and of pairs of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges, self.coarse, self.tables, self.pairs = [], [], [], []
        share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
        self.base = math.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3)))
        if len(set(y.tolist())) < 2:
            return
        weight = weight / weight.mean()
        for k in range(x.shape[1]):
            cuts = lambda n: np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1]))  # noqa: B023, E731
            self.edges.append(cuts(BINS))
            self.coarse.append(cuts(PAIR_BINS))
            self.tables.append(np.zeros(len(self.edges[-1]) + 1))
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        total = np.full(len(y), self.base)

        def sums() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return weight * (y - p), weight * p * (1 - p)

        for _ in range(ROUNDS):
            for k, b in enumerate(bins):
                g, h = sums()
                n = len(self.tables[k])
                step = RATE * _best_cuts(np.bincount(b, g, n), np.bincount(b, h, n), LEAVES)
                self.tables[k] += step
                total += step[b]

        def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
            m, n = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            return np.bincount(coarse[i] * n + coarse[j], v, m * n).reshape(m, n)

        g, h = sums()
        ranked = sorted(((_best_cross(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for _, i, j in ranked[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                g, h = sums()
                step = RATE * _best_cross(grid(i, j, g), grid(i, j, h))[1]
                table += step
                total += step[coarse[i], coarse[j]]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for b, table in zip(self._bins(x, self.edges), self.tables):
            total += table[b]
        if self.pairs:
            coarse = self._bins(x, self.coarse)
            for i, j, table in self.pairs:
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, remainder: int = 1) -> Gam:
    sample, sizes = labelled_sample(docs, labels, label, mod, remainder, PER_CLASS)
    rows = map_rows(sample.select("text", "y"), lambda c: {"x": [figures(t) for t in c[0]], "y": c[1]}, "x array<double>, y int").toArrow()
    x, y = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FIGURES)), rows["y"].to_numpy().astype(int)
    weight = np.array([sizes[k] / max(1, int((y == k).sum())) for k in y.tolist()])
    return Gam(x, y, weight)


def score(docs: DataFrame, model: Gam, mod: int = 3, remainder: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, score; other columns are ignored."""

    def scan(columns: list) -> dict[str, list]:
        keys, held, texts = columns
        return {"doc_id": keys, "held_out": held, "score": model.score(np.array([figures(t) for t in texts]))}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", mod, remainder).alias("held_out"), F.col("text"))
    return map_rows(rows, scan, "doc_id bigint, held_out boolean, score double")


def keep_good(docs: DataFrame, model: Gam, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is `least` or more, with their own columns."""
    return keep_rows(docs, lambda texts: (model.score(np.array([figures(t) for t in texts])) >= least).tolist())
