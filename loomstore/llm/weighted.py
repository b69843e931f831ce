"""Document fingerprints by consistent weighted sampling.

A text is a bag of lower-cased words weighted by their counts.  For each of
SAMPLES samples and each word, two gamma variates r and c and a uniform b are
drawn from the word's hash; the word's weight w gives the step
t = floor(ln w / r + b) and the value ln c - r (t - b) - r, and the word with the
least value is sampled, with its step.  Two bags sample the same (word, step)
with a probability that equals their generalised Jaccard similarity, the sum of
the smaller weights over that of the larger.  A fingerprint is the SAMPLES
samples, 16 bits of hash each, as hexadecimal digits; the likeness of two is the
share of samples that agree.

A null text is empty.  A text without words has a fingerprint of zeros, which
agrees with its equals alone (a sample of words is never 0).  Of words with the
same least value the first in the text's order is sampled; values are of 32 bits,
so that is rare.  Texts of any length are read whole, one at a time.  Repeated rows
are fingerprinted each, one as the next of the other.  An empty table gives no rows;
other columns are ignored, whatever they are called.  Rows of one id, or of none,
are one block: it is read in order, not held, but it is one task.  Ids that are not
numbers are an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER

SAMPLES = 64
#: (word, weight) pairs whose values a task remembers, SAMPLES * 6 bytes each.
REMEMBERED = 120_000
#: Rows of a block of neighbours, on average; a block is read in order, not held.
BLOCK_ROWS = 4_096
#: Tasks at most; from BLOCK_ROWS times as many rows on, blocks grow instead (they are read in order, so memory does not).
MOST_BLOCKS = 100_000


def words_of(text: str) -> Counter:
    return Counter(text.encode("utf-8", "replace").translate(ASCII_LOWER).split())


def _mix(x: np.ndarray) -> np.ndarray:
    """In place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def draw(words: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Values to minimise, and 16-bit names of (word, step), for each pair and sample; words are 64-bit hashes."""
    k = np.arange(samples, dtype=np.uint64)

    def uniforms(j: int) -> tuple[np.ndarray, np.ndarray]:
        """Two of 32 bits from one hash."""
        x = _mix(words[:, None] + (k * np.uint64(3) + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15))
        halves = x.view(np.uint32).reshape(*x.shape, 2).astype(np.float64)
        halves += 0.5
        halves *= 2.0**-32
        return halves[..., 0], halves[..., 1]

    def gamma(j: int) -> np.ndarray:
        u, v = uniforms(j)
        out = np.log(u * v)
        return np.negative(out, out=out)

    r, c = gamma(0), gamma(1)
    b, _ = uniforms(2)
    t = np.log(weights)[:, None] / r
    t += b
    np.floor(t, out=t)
    name = _mix(_mix(t.astype(np.int64).view(np.uint64) + k * np.uint64(0xD6E8FEB86659FD93)) ^ _mix(words.copy())[:, None])
    value = np.log(c, out=c)
    t -= b
    t += 1
    t *= r
    value -= t
    return value.astype(np.float32), np.maximum((name >> np.uint64(48)).astype(np.uint16), np.uint16(1))


class Sampler:
    """Fingerprints of bags, with the pairs met before remembered."""

    def __init__(self, samples: int = SAMPLES):
        self.samples, self.place, self.new = samples, {}, []
        self.values = np.zeros((1024, samples), np.float32)
        self.names = np.zeros((1024, samples), np.uint16)

    def _draw(self) -> None:
        from xxhash import xxh64_intdigest as xxh64

        n, done = len(self.place), len(self.place) - len(self.new)
        if n > len(self.values):
            for name in ("values", "names"):
                old = getattr(self, name)
                grown = np.zeros((max(n, 2 * len(old)), self.samples), old.dtype)
                grown[:done] = old[:done]
                setattr(self, name, grown)
        for at in range(0, len(self.new), 256):  # what stays in a core's cache
            part = [p if type(p) is tuple else (p, 1) for p in self.new[at : at + 256]]
            hashes = np.array([xxh64(w, 8) for w, _ in part], np.uint64)
            self.values[done + at : done + at + len(part)], self.names[done + at : done + at + len(part)] = draw(hashes, np.array([c for _, c in part], float), self.samples)
        self.new.clear()

    def of(self, text: str) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self.place.clear()
        pairs = [w if c == 1 else (w, c) for w, c in words_of(text).items()]  # a word's hash is known, a pair's is not
        if not pairs:
            return np.zeros(self.samples, np.uint16)
        ids = list(map(self.place.get, pairs))
        if None in ids:
            self.new = [p for p, i in zip(pairs, ids) if i is None]
            self.place.update(zip(self.new, range(len(self.place), len(self.place) + len(self.new))))
            self._draw()
            ids = list(map(self.place.get, pairs))
        at = np.array(ids)
        best = self.values[at].argmin(axis=0)
        return self.names[at[best], np.arange(self.samples)]


def to_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _block_names(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n blocks such that each is dealt to a task of its own of n tasks, so tasks are even."""
    dealt = spark.range(40 * n).select(F.col("id").cast("int").alias("name")).withColumn("task", F.pmod(F.hash("name"), F.lit(n)))
    found = sorted(r["name"] for r in dealt.groupBy("task").agg(F.min("name").alias("name")).collect())
    return found + [40 * n + k for k in range(n - len(found))]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the text's fingerprint, its edited text's, and likenesses to that and to the next document's.

    Documents are ordered by id, then by a hash of the text, so repeated ids
    have an order; rows without an id come first, and after the last row comes
    the one of the smallest id.  Rows are dealt out in blocks of neighbouring
    ids, with the first row of the block that follows, so texts move once.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = docs.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)] or [0.5], 10 * MOST_BLOCKS)).first()[0]
    cuts = sorted(set(cuts or [])) if blocks > 1 else []

    names = _block_names(docs.sparkSession, len(cuts) + 1)

    @F.pandas_udf("int")
    def block_of(ids):
        return ids.map(lambda i: names[int(np.searchsorted(cuts, i, "right"))])

    block = block_of(F.coalesce("doc_id", F.lit(-(1 << 63))))
    placed = docs.withColumn("block", block)
    first = sorted((r["doc_id"], r["block"]) for r in docs.select("doc_id").withColumn("block", block).groupBy("block").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").collect())  # a row for each block
    after = [(doc_id, first[k - 1][1]) for k, (doc_id, _) in enumerate(first)]
    guests = docs.sparkSession.createDataFrame(after, "doc_id bigint, block int")
    guests = docs.join(F.broadcast(guests), "doc_id").select("doc_id", "text", "block")
    rows = placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    rows = rows.repartition(len(names), "block").sortWithinPartitions("block", "guest", "doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(), None
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def row(key, text, print_, following, next_print) -> tuple:
            other = edited(text, following)
            edit = print_ if other == text else sampler.of(other)
            return key, len(text), sha256(other.encode("utf-8", "replace")).hexdigest(), to_text(print_), to_text(edit), likeness(print_, edit), likeness(print_, next_print)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for key, text, block, guest in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    if guest and (held is None or held[3] != block):
                        continue  # a second row of the guest's id
                    print_ = sampler.of(text)
                    if held is not None:
                        out.append(row(*held[:3], text, print_) if held[3] == block else row(*held[:3], *held[1:3]))
                    held = None if guest else (key, text, print_, block)
                yield batch_of(out)
        if held is not None:  # no row has an id: no one follows the last
            yield batch_of([row(*held[:3], *held[1:3])])

    return rows.select("doc_id", "text", "block", "guest").mapInArrow(run, SCHEMA)
