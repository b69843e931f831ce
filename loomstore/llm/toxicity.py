"""Toxicity by weak supervision.

Voters.  From a sample of labelled training documents, words and word beginnings
that are far commoner in toxic texts are counted out; enough are taken that every
toxic text of the sample has COVER of them.  They are dealt to lexicon voters
(whole words) and pattern voters (beginnings of a length), beside voters for
several hits at once, for no hit, and for shouting.  Each says toxic, clean or
nothing.  The label of a text is no voter: it only helps to find the words.

Label model.  Expectation maximisation estimates the share of toxic texts and
each voter's accuracies, without taking any vote for the truth.  The voters'
correlations within a class are estimated from what is left, and a voter's
evidence counts the less the more it repeats others'.

Classifier.  A logistic regression over the words and beginnings, and over the
number of words with a hit, is trained on the posterior labels, and scores any
text whole.

The sample is bounded: at most PER_CLASS labelled documents a class, weighed back
to the classes' sizes; the words and beginnings are as many as its texts tell of.
Null and empty texts have no hits, and the score of such.  Without labels of both
classes no word is telling, and the score is the share of toxic labels (0 without
any).  Of words that tell alike the longer comes first, then by the alphabet.
Texts of any length are read whole.  Repeated rows are scored each; a labelled id
with several rows is learned from once.  An empty table gives no rows; other
columns are ignored by `score` and kept as they are by `keep_clean`, whatever they
are called.  Ids that are not numbers are an error to `score`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep_rows, labelled_sample, map_rows, pieces, sent

PER_CLASS, COVER, LEXICONS = 10_000, 3, 8
PREFIXES = (3, 4, 5, 6)
CACHED_WORDS = 500_000

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> Counter:
    """Lower-cased words of letters, with their counts."""
    return Counter((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).decode().split())


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): texts of either label that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])
            for c in counts:
                c.clear()
            return made

        for batch in batches:
            for text, y in (row for part in pieces(batch, 64) for row in zip(*(c.to_pylist() for c in part.columns))):
                counts[y].update({f for w in words_of(text) for f in features_of(w)})
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield out()
        yield out()

    return sample.select("text", "y").mapInArrow(run, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Hits:
    """Ids of the features that a text has; what a word has is remembered."""

    def __init__(self, features: list[str]):
        self.id, self.known = {f: i for i, f in enumerate(features)}, {}

    def of(self, text: str | None) -> tuple[list[int], int]:
        """The ids, and how many words have one."""
        found: set[int] = set()
        n = 0
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w, k in words_of(text).items():
            got = known.get(w)
            if got is None:
                known[w] = got = [self.id[f] for f in features_of(w) if f in self.id]
            if got:
                found.update(got)
                n += k
        return sorted(found), n


def label_model(votes: np.ndarray, weight: np.ndarray, share: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, accuracies, correlations) from votes of -1 (nothing), 0 (clean), 1 (toxic); texts by voters."""
    says = [(votes == v).astype(float) for v in (-1, 0, 1)]
    posterior = 0.02 + 0.96 * (says[2].sum(1) > says[1].sum(1))
    discount, correlation = np.ones(votes.shape[1]), np.eye(votes.shape[1])
    accuracies = np.zeros((votes.shape[1], 2, 3))
    for k in range(rounds):
        for y, q in enumerate((weight * (1 - posterior), weight * posterior)):
            mass = np.stack([q @ s for s in says], 1) + 0.5
            accuracies[:, y] = mass / mass.sum(1, keepdims=True)
        share = float(np.clip((weight * posterior).sum() / weight.sum(), 1e-3, 1 - 1e-3)) if k else share
        ratio = np.log(accuracies[:, 1]) - np.log(accuracies[:, 0])
        evidence = math.log(share / (1 - share)) + sum(s @ (ratio[:, i] * discount) for i, s in enumerate(says))
        posterior = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
        if k in (9, 19, 29):  # what the classes leave unexplained
            signed = says[2] - says[1]
            mean = accuracies[:, :, 2] - accuracies[:, :, 1]
            left = signed - (np.outer(1 - posterior, mean[:, 0]) + np.outer(posterior, mean[:, 1]))
            cov = (left * weight[:, None]).T @ left / weight.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            correlation = np.clip(cov / np.outer(sd, sd), -1, 1)
            discount = 1 / (1 + np.maximum(correlation - np.eye(len(cov)), 0).sum(1))
    return posterior, accuracies, correlation


def _votes(hits: list[list[int]], several: np.ndarray, features: list[str], shout: np.ndarray) -> np.ndarray:
    words = [i for i, f in enumerate(features) if f[-1] != "*"]
    voter = {i: k % LEXICONS for k, i in enumerate(words)} | {i: LEXICONS + PREFIXES.index(len(f) - 1) for i, f in enumerate(features) if f[-1] == "*"}
    lexicons = LEXICONS + len(PREFIXES)
    votes = np.full((len(hits), lexicons + 4), -1)
    for row, found, n in zip(votes, hits, several.tolist()):
        for i in found:
            row[voter[i]] = 1
        row[lexicons] = 1 if n >= 2 else -1
        row[lexicons + 1] = 1 if n >= 4 else -1
        row[lexicons + 2] = -1 if n > 1 else 0
    votes[:, lexicons + 3] = np.where(shout > 0.5, 1, -1)
    return votes


class Model:
    """Weights of features and of the number of hits."""

    def __init__(self, features: list[str], hits: list[list[int]], several: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 300):
        self.features = features
        n, m = len(hits), len(features)
        at = np.repeat(np.arange(n), [len(x) for x in hits])
        ids = np.array([i for x in hits for i in x], np.int64)
        # Numbers of hits that are told apart: each up to four, then every power of the root of two, up to the sample's largest
        most = max(1, int(several.max(initial=1)))
        self.steps = np.array(sorted({1, 2, 3, *(round(2 ** (k / 2)) for k in range(4, 2 * most.bit_length() + 1))}))
        self.steps = self.steps[self.steps <= most]
        reached = (several[:, None] >= self.steps).astype(float)
        w, c, b = np.zeros(m), np.zeros(len(self.steps)), 0.0
        weight = weight / weight.sum()
        size = np.bincount(ids, weight[at], m) * 0.25 + 1e-4  # of each coordinate, for the step
        for k in range(rounds):
            z = b + reached @ c + np.bincount(at, w[ids], n)
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
            rate = 0.5
            w -= rate * (np.bincount(ids, g[at], m) + 2e-5 * w) / (size * 4 + 1e-3)
            c -= rate * (g @ reached + 1e-4 * c) / (weight @ reached + 1e-3)
            b -= rate * float(g.sum()) * 2
        self.w, self.c, self.b = w, c, b

    def score(self, hits: list[tuple[list[int], int]]) -> np.ndarray:
        z = np.array([self.b + self.c[self.steps <= n].sum() + self.w[x].sum() for x, n in hits])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, remainder: int = 2) -> Model:
    sample, sizes = labelled_sample(docs, labels, label, mod, remainder, PER_CLASS)
    total = {k: min(n, PER_CLASS) for k, n in sizes.items()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not sizes.get(0) or not sizes.get(1):
        model = Model([], [], np.zeros(0), np.zeros(0), np.ones(0), 0)
        model.b = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return model
    odds = ((F.col("toxic") + 0.5) / (total[1] + 1.0)) / ((F.col("clean") + 0.5) / (total[0] + 1.0))
    telling = feature_counts(sample).where((F.col("toxic") >= 4) & (odds >= 6)).withColumn("odds", odds)
    ranked = telling.orderBy(F.desc(F.col("toxic") * F.ln("odds")), F.desc(F.length("feature")), "feature").collect()  # of 2 * PER_CLASS texts
    features = [r["feature"] for r in ranked]

    def scan(columns: list) -> dict[str, list]:
        hits = Hits(features)
        return {"hits": [hits.of(t)[0] for t in columns[0]], "y": columns[1]}

    def count(columns: list) -> dict[str, list]:
        texts, y = columns
        hits = Hits(features)
        loud = [sum(map(str.isupper, t or "")) / max(1, sum(map(str.isalpha, t or ""))) for t in texts]
        found = [hits.of(t) for t in texts]
        return {"hits": [x for x, _ in found], "n": [n for _, n in found], "shout": loud, "y": y}

    rows = map_rows(sample.select("text", "y"), scan, "hits array<int>, y int").toArrow()
    hits, y = rows["hits"].to_pylist(), rows["y"].to_numpy().astype(int)
    # Enough features that each toxic text has COVER of them; strong ones first, so what merely accompanies them stays out
    holders: list[list[int]] = [[] for _ in features]
    for row, (x, label_) in enumerate(zip(hits, y.tolist())):
        if label_:
            for i in x:
                holders[i].append(row)
    covered, kept, same = Counter(), [], set()
    for i, held in enumerate(holders):
        if tuple(held) in same:  # a beginning that says what its word has said
            continue
        if sum(covered[r] < COVER for r in held) >= max(2, 0.25 * len(held)) or (ranked[i]["clean"] == 0 and len(held) >= 0.002 * total[1] and features[i][-1] == "*"):
            kept.append(i)
            same.add(tuple(held))
            covered.update(held)
    place = {i: k for k, i in enumerate(kept)}
    features = [features[i] for i in kept]
    rows = map_rows(sample.select("text", "y"), count, "hits array<int>, n int, shout double, y int").toArrow()
    hits, several, y = rows["hits"].to_pylist(), rows["n"].to_numpy(), rows["y"].to_numpy().astype(int)
    weight = np.array([sizes[k] / max(1, int((y == k).sum())) for k in y.tolist()])
    posterior, _, _ = label_model(_votes(hits, several, features, rows["shout"].to_numpy()), weight, share)
    return Model(features, hits, several, posterior, weight)


def score(docs: DataFrame, model: Model, mod: int = 4, remainder: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, score; other columns are ignored."""

    scores = _scorer(docs, model)

    def scan(columns: list) -> dict[str, list]:
        keys, held, texts = columns
        return {"doc_id": keys, "held_out": held, "score": scores(texts)}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", mod, remainder).alias("held_out"), F.col("text"))
    return map_rows(rows, scan, "doc_id bigint, held_out boolean, score double")


def _scorer(docs: DataFrame, model: Model):
    trained = sent(docs.sparkSession, model)
    ready: list[Hits] = []

    def scores(texts: list) -> np.ndarray:
        if not ready:
            ready.append(Hits(trained().features))
        return trained().score([ready[0].of(t) for t in texts])

    return scores


def keep_clean(docs: DataFrame, model: Model, most: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score is below `most`, with their own columns."""
    scores = _scorer(docs, model)
    return keep_rows(docs, lambda texts: (scores(texts) < most).tolist())
