"""Benchmark decontamination by winnowing.

Of every window of WINDOW words the smallest hash of its GRAM-word grams, the
leftmost of equals, is selected: a fingerprint, kept once with its place for all
windows that share it.  A window that a document and a benchmark item share has the
same grams on both sides, so the same one of them is selected in both: no shared
span of WINDOW words is missed.  Fingerprints of both sides are joined, and each
meeting is extended word by word to the left and right, as far as windows around the
gram reach; where that makes WINDOW words or more, they are hit.  An item of fewer
words than a window is one window of all its words.

Before the join a document's fingerprints are held against a bitmap of the
benchmark's, of 16 bits for each up to MOST_BITS (past 3 x 10^7 fingerprints, from
some 10^8 words of benchmark, one in twenty passes in vain, and more with more:
rows that the join drops); it is all that is broadcast.  A row is a gram with the
words around it.  Equal rows, of a passage that many documents or items hold, are
one before they meet, so what meets is distinct on both sides; grams are as long as
9 words, so that not every common phrase meets.  Words are compared themselves: a
hash collision never counts.  Items that share their rows go as one set, are told
apart once a document, and are gathered per document only when distinct.  Neither
documents nor benchmark texts move.

Null and empty texts have no words; an empty benchmark hits nothing; equal items
each count.  Items without an id hit like others and stand together as one null
at the end of the item ids.  Texts of any length are read whole, CHUNK_BYTES of
texts at a time or one text if that is longer.  Repeated rows give repeated
results; an empty table gives none; other columns are ignored, whatever they are
called.  Ids that are not numbers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, free, map_rows, materialize, sent

WINDOW, GRAM = 13, 9
#: Bits of the filter for each fingerprint of the benchmark, and the least and most of them in all (64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29
#: Bits of one value of Spark's bitmap functions.
BITMAP = 8 * 4096
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1 << 20

PRINTS = "item string, size int, print bigint, gram binary, lefts array<binary>, rights array<binary>"
SCANNED = "doc_id bigint, k1 bigint, k2 int, n_words bigint, size int, print bigint, place bigint, gram binary, lefts array<binary>, rights array<binary>"
#: What makes two rows one: a gram and the words around it.
CONTEXT = ["size", "print", "gram", "lefts", "rights"]
#: A text, by 96 bits of two hashes.
TEXT = ["k1", "k2"]
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64)
        self.down = self.up

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                factors = np.full(n, b, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _ranges(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hashes of values[start:stop] for each range."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * down[starts])


class Words:
    """The words of some texts, with their hashes; no word or window spans two texts."""

    _low = np.frombuffer(ASCII_LOWER, np.uint8)
    _is = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
    _bytes, _words = _Powers(_B1), _Powers(_B2)

    def __init__(self, texts: list[bytes]):
        self.raw = b"\0".join(texts).translate(ASCII_LOWER)
        data = np.frombuffer(self.raw, np.uint8)
        edge = np.diff(self._is[data].astype(np.int8), prepend=0, append=0)
        self.starts, self.stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text_of = np.searchsorted(ends, self.starts, "right")
        self.bounds = np.searchsorted(self.text_of, np.arange(len(texts) + 1))
        self.hashes = _ranges(data.astype(np.uint64) + np.uint64(1), self.starts, self.stops, self._bytes)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of `size` words from each word on, and whether they lie in one text."""
        n = max(0, len(self.hashes) - size + 1)
        at = np.arange(n)
        return _ranges(self.hashes, at, at + size, self._words), self.text_of[:n] == self.text_of[size - 1 : size - 1 + n]

    def selected(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Winnowing: (hash, place) of the grams that are the smallest, leftmost of equals, of some window of `size` words; once for all such windows."""
        gram = min(GRAM, size)
        grams, _ = self.windows(gram)
        _, whole = self.windows(size)
        n = len(whole)
        at, low = np.arange(n), grams[:n].copy()
        for i in range(1, size - gram + 1):
            less = grams[i : i + n] < low
            at[less] = np.flatnonzero(less) + i
            low[less] = grams[i : i + n][less]
        at = np.unique(at[whole])
        return grams[at], at

    def some(self, first: int, end: int) -> list[bytes]:
        return [self.raw[a:z] for a, z in zip(self.starts[first:end].tolist(), self.stops[first:end].tolist())]

    def around(self, at: int, size: int) -> tuple[bytes, list[bytes], list[bytes]]:
        """A gram, and the words to its left (nearest first) and right that windows of `size` words around it hold."""
        gram, text = min(GRAM, size), self.text_of[at]
        low, high = max(int(self.bounds[text]), at - size + gram), min(int(self.bounds[text + 1]), at + size)
        return b" ".join(self.some(at, at + gram)), self.some(low, at)[::-1], self.some(at + gram, high)


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, Words]]:
    """The words of about CHUNK_BYTES of texts at a time, and the number of the first text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < CHUNK_BYTES):
            size += len(texts[stop] or b"")
            stop += 1
        yield at, Words([t or b"" for t in texts[at:stop]])
        at = stop


def benchmark_prints(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The benchmark's distinct fingerprints with the words around them and the number of the set of items that have them; and (set, item). Both written."""

    def scan(columns: list) -> dict[str, list]:
        ids, texts = columns
        rows: list[tuple] = []
        for first, words in _chunks(texts):
            sizes = np.diff(words.bounds)
            for size in np.unique(np.minimum(sizes[sizes > 0], WINDOW)).tolist():
                for print_, at in zip(*(x.tolist() for x in words.selected(size))):
                    k = int(words.text_of[at])
                    if min(WINDOW, sizes[k]) == size:
                        rows.append((ids[first + k], size, print_ - (print_ >> 63 << 64), *words.around(at, size)))
        columns = list(zip(*rows)) or [()] * 6
        return dict(zip(("item", "size", "print", "gram", "lefts", "rights"), columns))

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("text is not null")
    # A set is as long as that of a document which holds the gram
    ids, unnamed = F.sort_array(F.collect_set("item")), F.count_if(F.col("item").isNull()) > 0
    held = map_rows(items, scan, PRINTS).groupBy(*CONTEXT).agg(F.struct(ids.alias("ids"), unnamed.alias("unnamed")).alias("items"))
    held = materialize(held.withColumn("set", F.struct(F.xxhash64("items"), F.hash("items"))), "prints")
    every = F.when(F.col("items.unnamed"), F.concat("items.ids", F.array(F.lit(None).cast("string")))).otherwise(F.col("items.ids"))
    sets = held.groupBy("set").agg(F.first("items").alias("items")).select("set", F.explode(every).alias("item"))
    return held.drop("items"), materialize(sets, "item-sets")


def print_filter(prints: DataFrame) -> tuple[list[int], bytes]:
    """The sizes of windows, and the bitmap of their fingerprints; a power of two of bits, at most MOST_BITS."""
    sizes = {r["size"]: r["n"] for r in prints.groupBy("size").agg(F.count("*").alias("n")).collect()}  # WINDOW rows at most
    bits_all = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * sum(sizes.values())).bit_length()))
    place = F.pmod("print", F.lit(bits_all))
    rows = prints.groupBy(F.floor(place / BITMAP).alias("at")).agg(F.bitmap_construct_agg((place % BITMAP)).alias("bits")).collect()  # bits_all / BITMAP rows at most
    bits = bytearray(bits_all // 8)
    for r in rows:
        bits[r["at"] * BITMAP // 8 : (r["at"] + 1) * BITMAP // 8] = r["bits"]
    return sorted(sizes), bytes(bits)


def document_prints(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """SCANNED: a row for each fingerprint of a document that passes the filter, and one of size 0 for the document."""
    known = sent(docs.sparkSession, print_filter(prints))

    def scan(columns: list) -> dict[str, list]:
        keys, k1, k2, texts = columns
        sizes, bits = known()
        bits = np.frombuffer(bits, np.uint8)
        out: list[tuple] = []
        for first, words in _chunks(texts):
            for k, n in enumerate(np.diff(words.bounds).tolist(), first):
                out.append((keys[k], k1[k], k2[k], n, 0, k1[k], 0, b"", [], []))
            for size in sizes:
                found, at = words.selected(size)
                place = found & np.uint64(8 * len(bits) - 1)
                near = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                for print_, p in zip(found[near].view(np.int64).tolist(), at[near].tolist()):
                    k = int(words.text_of[p])
                    out.append((None, k1[first + k], k2[first + k], 0, size, print_, p - int(words.bounds[k]), *words.around(p, size)))
        columns = list(zip(*out)) or [()] * 10
        return dict(zip(("doc_id", "k1", "k2", "n_words", "size", "print", "place", "gram", "lefts", "rights"), columns))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *_keys(text), text.cast("binary").alias("text"))
    return map_rows(rows, scan, SCANNED, 2048)


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def _agreeing(mine: str, theirs: str) -> Column:
    """How many words two lists have in common from their starts on."""
    return F.expr(f"coalesce(nullif(array_position(zip_with({mine}, {theirs}, (x, y) -> x <=> y), false), 0) - 1, size({mine}))").cast("int")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, k1 and k2 (hashes of the text), n_words, n_hit, item_ids (of items with occurring windows, sorted, null last), spans of hit words."""
    prints, sets = benchmark_prints(benchmark)
    rows = materialize(document_prints(docs, prints, id_col, text_col), "scanned")
    marks = rows.where("size > 0")
    # Distinct rows of documents meet distinct rows of the benchmark
    theirs = prints.select("size", "print", "gram", F.col("lefts").alias("their_lefts"), F.col("rights").alias("their_rights"), "set")
    meets = marks.select(*CONTEXT).distinct().join(theirs, ["size", "print", "gram"])
    meets = meets.withColumn("left", _agreeing("lefts", "their_lefts")).withColumn("right", _agreeing("rights", "their_rights"))
    meets = materialize(meets.where(F.col("left") + F.least(F.col("size"), F.lit(GRAM)) + F.col("right") >= F.col("size")).select(*CONTEXT, "left", "right", "set"), "meetings")
    # All that meets in one place holds its gram, so it covers one stretch
    reach = meets.groupBy(*CONTEXT).agg(F.max("left").alias("left"), F.max("right").alias("right"))
    spans = marks.join(reach, CONTEXT).select(*TEXT, (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.least(F.col("size"), F.lit(GRAM)) + F.col("right")).alias("stop")).distinct()
    before = F.max("stop").over(Window.partitionBy(*TEXT).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))  # a text's own places
    apart = spans.withColumn("fresh", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    apart = apart.withColumn("island", F.sum("fresh").over(Window.partitionBy(*TEXT).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    islands = apart.groupBy(*TEXT, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    hits = islands.groupBy(*TEXT).agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    held = marks.join(meets.select(*CONTEXT, "set").distinct(), CONTEXT).select(*TEXT, "set").distinct().join(sets, "set").select(*TEXT, "item").distinct()
    unnamed = F.when(F.count_if(F.col("item").isNull()) > 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    held = held.groupBy(*TEXT).agg(F.concat(F.sort_array(F.collect_list("item")), unnamed).alias("item_ids"))
    every = rows.where("size = 0").select("doc_id", *TEXT, "n_words").join(hits, TEXT, "left").join(held, TEXT, "left")
    no_spans = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return every.select("doc_id", *TEXT, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", no_spans).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their own columns."""
    found = find_contamination(docs, benchmark)
    names = [free(docs, k) for k in TEXT]
    # Whether a text is contaminated hangs on the text alone; written first, so that a small table is known to be small
    bad = materialize(found.where(contaminated(F.col("n_words"), F.col("n_hit"))).select(*(F.col(k).alias(n) for k, n in zip(TEXT, names))).distinct(), "contaminated")
    return docs.withColumns(dict(zip(names, _keys(F.coalesce("text", F.lit("")))))).join(bad, names, "left_anti").drop(*names)


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """The rule of the benchmark: a twentieth of the words or more lie in shared windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)
