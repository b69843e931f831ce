"""Language identification, words first.

Each language has the log frequencies of its words and of the character n-grams
of its words.  A word that some language knows adds its log frequency under every
language.  An unseen word is scored by the longest n-grams of it that are known:
those of NGRAMS characters if there are any, else one fewer, down to single
characters.  The language of the largest sum is predicted; the score is its share
among all, from the mean per word, so that it does not saturate on long texts.

The model is fitted on PER_LANGUAGE training rows a language (about that many:
each row is taken or not by the hash of its id and text, so no task sees all rows of
a language; all rows if there are fewer): a documented bound.  All words and n-grams
of those rows are kept, so the model is as large as their texts' vocabulary.

A null text, and one without a letter (`str.isalpha`), is UNKNOWN with score 0, as
is every text when nothing was learned.  A text whose letters make no word that
any n-gram knows scores all languages alike; ties go to the language that sorts
first.  Texts of any length are read whole.  Repeated rows count each; an empty
table gives no rows; other columns are ignored.  Ids that are not numbers are an
error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, map_rows, materialize, pieces, sent

PER_LANGUAGE, NGRAMS, UNKNOWN = 500, 5, "und"
#: Unseen words whose figures a task remembers.
CACHED_WORDS = 200_000
#: How much the mean per word is sharpened to a share.
SHARPNESS = 8.0

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).decode().split()


def ngrams_of(word: str, n: int) -> list[str]:
    """Runs of n characters of the word between two edge marks; single characters go without marks."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


class Model:
    """Languages; words and n-grams by their rows in tables of log frequencies, a column a language."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        """counts: (language, length of n-gram or 0 for words, term, count)."""
        self.languages = sorted({lang for lang, *_ in counts})
        column = {lang: k for k, lang in enumerate(self.languages)}
        self.row: list[dict[str, int]] = []
        self.tables: list[np.ndarray] = []
        for n in range(NGRAMS + 1):
            mine = [(column[lang], term, c) for lang, size, term, c in counts if size == n]
            row = {term: k for k, term in enumerate(sorted({term for _, term, _ in mine}))}
            table = np.zeros((len(row), len(column)))
            for lang, term, c in mine:
                table[row[term], lang] += c
            self.row.append(row)
            self.tables.append(np.log((table + 0.1) / (table.sum(0) + 0.1 * (len(row) + 1))))

    def unseen(self, word: str) -> np.ndarray:
        """Figures of a word that no language knows."""
        for n in range(NGRAMS, 0, -1):
            found = [k for g in ngrams_of(word, n) if (k := self.row[n].get(g)) is not None]
            if found:
                return self.tables[n][found].mean(axis=0)
        return np.zeros(len(self.languages))


class Reader:
    """A model at work: figures of unseen words are worked out once, CACHED_WORDS of them at most."""

    def __init__(self, model: Model):
        self.model, self.row, self.words = model, dict(model.row[0]), len(model.row[0])
        self.table = np.zeros((self.words + CACHED_WORDS, len(model.languages)))
        self.table[: self.words] = model.tables[0]

    def figures(self, words: list[str]) -> np.ndarray:
        rows = list(map(self.row.get, words))
        if None not in rows:
            return self.table[rows]
        new = [w for w, k in zip(words, rows) if k is None]
        if len(new) > CACHED_WORDS:  # a text of more unseen words than are remembered
            unseen = iter(np.array([self.model.unseen(w) for w in new]))
            return np.array([next(unseen) if k is None else self.table[k] for k in rows])
        if len(self.row) + len(new) > len(self.table):
            self.row = dict(self.model.row[0])
            return self.figures(words)
        for w in new:
            k = self.row[w] = len(self.row)
            self.table[k] = self.model.unseen(w)
        return self.table[list(map(self.row.get, words))]

    def read(self, text: str | None) -> tuple[str, float]:
        languages = self.model.languages
        if not languages or not text or not has_letter(text):
            return UNKNOWN, 0.0
        counts = Counter(words_of(text))
        total, n = np.zeros(len(languages)), 0.0
        if counts:
            k = np.fromiter(counts.values(), float, len(counts))
            total, n = k @ self.figures(list(counts)), k.sum()
        z = np.exp(SHARPNESS * (total - total.max()) / max(1.0, n))
        best = int(z.argmax())
        return languages[best], float(z[best] / z.sum())


def fit(docs: DataFrame, mod: int = 3, remainder: int = 1) -> Model:
    learned = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", mod) != remainder))
    sizes = learned.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20)  # rows of one id are chosen each by itself
    sample = learned.join(F.broadcast(sizes), "lang").where(share * F.col("n") < PER_LANGUAGE).select("lang", "text")  # a row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, n, t, c) for (lang, n), x in counts.items() for t, c in x.items()]
            counts.clear()
            columns = zip(*rows) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "n", "term", "c"])

        for batch in batches:
            for part in pieces(batch, 512):
                for lang, text in zip(*(c.to_pylist() for c in part.columns)):
                    counts.setdefault((lang, 0), Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > 300_000:
                    yield out()
        yield out()

    words = sample.mapInArrow(run, "lang string, n int, term string, c bigint").groupBy("lang", "n", "term").agg(F.sum("c").alias("c"))

    def split(columns: list) -> dict[str, list]:
        counts: Counter = Counter()
        for lang, word, c in zip(*columns):
            counts[lang, 0, word] += c
            for n in range(1, NGRAMS + 1):
                for g in ngrams_of(word, n):
                    counts[lang, n, g] += c
        keys = list(counts)
        return {"lang": [k[0] for k in keys], "n": [k[1] for k in keys], "term": [k[2] for k in keys], "c": [counts[k] for k in keys]}

    # Few bytes but much work: dealt out by number, so that the adaptive plan does not join the parts again
    words = words.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "term")
    terms = map_rows(words.select("lang", "term", "c"), split, "lang string, n int, term string, c bigint", 8192).groupBy("lang", "n", "term").agg(F.sum("c").alias("c"))
    kept = materialize(terms, "terms").toArrow()  # the terms of PER_LANGUAGE rows a language
    return Model(list(zip(*(kept[c].to_pylist() for c in ("lang", "n", "term", "c")))))


def predict(docs: DataFrame, model: Model, mod: int = 3, remainder: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    trained, ready = sent(docs.sparkSession, model), []

    def one(text: str | None) -> tuple[str, float]:
        if not ready:
            ready.append(Reader(trained()))
        return ready[0].read(text)

    def scan(columns: list) -> dict[str, list]:
        keys, held, texts = columns
        found = [one(t) for t in texts]
        return {"doc_id": keys, "held_out": held, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", mod, remainder).alias("held_out"), F.col("text"))
    return map_rows(rows, scan, "doc_id bigint, held_out boolean, lang_pred string, score double")
