"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

A text is split by the tokenizer's pattern.  Every word that a task has not met
before is folded once: its bytes are the first pieces, and the adjacent pair of
lowest rank, the leftmost of equals, is joined until no pair has a rank.  The
rank map is a literal of the vocabulary file, keyed by pairs of pieces.  The
texts' ids are then looked up word by word.  Decoding concatenates the binary
pieces of the ids.

`fold_column` is the same fold as Spark higher-order functions, and
`encode_distinct` the whole encoding by it: distinct words of the whole table are
folded once and joined back.  Both give the same ids, at about 70 microseconds a
word against about 6 here; README.md has the figures that decided for the Arrow
form on the main path.

Nulls and empty texts have no tokens.  Of equal ranks the leftmost goes first.
Texts of any length are read whole, CHUNK_CHARS at a time or one text if that is
longer; a very long word is folded with a heap, in time n log n.  Rows are
independent: repeated rows give repeated results, an empty table gives none, and
columns other than the id and the text are ignored, whatever they are called.
Ids that are not numbers are an error.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces

#: Distinct words that a task remembers before it starts afresh; bounds its memory.
MEMORY_WORDS = 400_000
#: Bytes of a word from which a heap folds it.
LONG_WORD = 256
#: Characters of text that are worked on and sent at a time.
CHUNK_CHARS = 2_000_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_text string, decoded binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of base64 tokens."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, Path(path).read_bytes().splitlines())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The literal rank map: ids of two adjacent pieces to the id of their concatenation."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def fold_word(word: bytes, byte_ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ids of one word."""
    if len(word) > LONG_WORD:
        return _fold_long(word, byte_ids, pairs)
    ids = [byte_ids[b] for b in word]
    none = 1 << 30
    ranks = [pairs.get(p, none) for p in zip(ids, ids[1:])]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        ids[i : i + 2] = [best]
        del ranks[i]
        if i:
            ranks[i - 1] = pairs.get((ids[i - 1], best), none)
        if i < len(ranks):
            ranks[i] = pairs.get((best, ids[i + 1]), none)
    return ids


def _fold_long(word: bytes, byte_ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same by a heap of (rank, place) over linked pieces; entries of pieces that have changed are skipped."""
    ids: list[int | None] = [byte_ids[b] for b in word]
    left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
    heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := pairs.get(p)) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = right[i]
        if ids[i] is None or j < 0 or pairs.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j], right[i] = rank, None, right[j]
        if right[i] >= 0:
            left[right[i]] = i
            if (r := pairs.get((rank, ids[right[i]]))) is not None:
                heappush(heap, (r, i))
        if left[i] >= 0 and (r := pairs.get((ids[left[i]], rank))) is not None:
            heappush(heap, (r, left[i]))
    return [i for i in ids if i is not None]


def fold_column(word: Column, ranks: dict[bytes, int], buckets: int = 1 << 15) -> Column:
    """Ids of the words in a binary column, by higher-order functions.

    The rank map is a constant array of buckets [key, id, key, id ...]; keys are
    above all ids, so one look-up tells a miss from a hit.
    """
    spread, base, far, none = 31337, 65536, 1 << 40, 1 << 30
    table: list[list[int]] = [[] for _ in range(buckets)]
    for (a, c), r in pair_ranks(ranks).items():
        table[(a * spread + c) % buckets] += [a * base + c + far, r]
    literal = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")
    byte_ids = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<bigint>")
    end = F.lit(1 << 30)

    def rank(a: Column, c: Column) -> Column:
        bucket = F.get(literal, (a * spread + c) % buckets)
        return F.get(bucket, F.array_position(bucket, a * base + c + far))

    def step(ids: Column, _: Column) -> Column:
        def merge(ranks: Column) -> Column:
            best = F.array_min(ranks)
            i = F.array_position(ranks, best).cast("int")
            return F.when(best < none, F.concat(F.slice(ids, F.lit(1), i - 1), F.array(best), F.slice(ids, i + 2, end))).otherwise(ids)

        return F.element_at(F.transform(F.array(F.zip_with(ids, F.slice(ids, 2, end), rank)), merge), 1)

    hexes = F.hex(word)
    first = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.get(byte_ids, F.conv(F.substr(hexes, i * 2 - 1, F.lit(2)), 16, 10).cast("int")))
    first = F.when(F.octet_length(word) > 0, first).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(F.slice(first, 2, end), first, step)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_text (decimal ids joined by a space), decoded (the ids' bytes).

    `vocabulary` is a path on the driver; its ranks travel with the plan.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        rank = ranks.value
        pairs = pair_ranks(rank)
        byte_ids = [rank[bytes([b])] for b in range(256)]
        piece = {r: t for t, r in rank.items()}

        class Folded(dict):
            """word -> (ids as text, number of ids, decoded bytes)"""

            def __missing__(self, word: str) -> tuple[str, int, bytes]:
                raw = word.encode()
                ids = [rank[raw]] if raw in rank else fold_word(raw, byte_ids, pairs)
                self[word] = out = (" ".join(map(str, ids)), len(ids), b"".join([piece[i] for i in ids]))
                return out

        known = Folded()

        def rows(keys: list, texts: list) -> pa.RecordBatch:
            counts, ids, decoded = [], [], []
            for text in texts:
                if len(known) > MEMORY_WORDS:
                    known.clear()
                found = [known[w] for w in find(text)] if text else ()
                a, n, d = zip(*found) if found else ((), (), ())
                ids.append(" ".join(a))
                counts.append(sum(n))
                decoded.append(b"".join(d))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids_text", "decoded"])

        for batch in batches:
            keys, texts, chars = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                texts.append(text.as_py())
                chars += len(texts[-1] or "")
                if chars > CHUNK_CHARS:
                    yield rows(keys, texts)
                    keys, texts, chars = [], [], 0
            if keys:
                yield rows(keys, texts)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def encode_distinct(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `encode`, by `fold_column` over the distinct words of the whole table, joined back to the places they stand at.

    Words longer than LONG_WORD bytes are folded as in `encode`: a higher-order fold takes the square of a word's length.
    """
    spark = docs.sparkSession
    ranks = load_ranks(vocabulary)
    sent = spark.sparkContext.broadcast(ranks)
    # Regular expressions of the tokenizer are not Java's, so words are split in Arrow batches
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find, n = regex.compile(pattern).findall, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, 512):
                words = [[w.encode() for w in find(t)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(n, n + part.num_rows), pa.int64()), part.column(0), pa.array(words, pa.list_(pa.binary()))], names=["row", "doc_id", "words"])
                n += part.num_rows

    def long_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, byte_ids = pair_ranks(sent.value), [sent.value[bytes([b])] for b in range(256)]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold_word(w, byte_ids, pairs) for w in batch.column(0).to_pylist()], pa.list_(pa.int64()))], names=["word", "ids"])

    texts = materialize(rows.mapInArrow(split, "row bigint, doc_id bigint, words array<binary>"), "split-texts")
    placed = texts.select("row", F.posexplode("words").alias("place", "word"))
    distinct = placed.select("word").distinct()
    short = F.octet_length("word") <= LONG_WORD
    folded = distinct.where(short).select("word", fold_column(F.col("word"), ranks).alias("ids")).unionByName(distinct.where(~short).mapInArrow(long_words, "word binary, ids array<bigint>"))
    pieces_of = F.from_json(F.lit(json.dumps([base64.b64encode(t).decode() for t, _ in sorted(ranks.items(), key=lambda x: x[1])])), "array<string>")
    # Decoding concatenates the pieces of the ids; a word's are worked out once
    folded = materialize(folded.select("word", "ids", F.aggregate("ids", F.lit(b""), lambda a, i: F.concat(a, F.unbase64(F.get(pieces_of, i.cast("int")))))
                                       .alias("decoded")), "folded")
    found = placed.join(folded, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "ids", F.base64("decoded").alias("d")))).alias("w"))
    ids = F.flatten(F.transform("w", lambda x: x["ids"]))
    whole = F.aggregate("w", F.lit(b""), lambda a, x: F.concat(a, F.unbase64(x["d"])))
    out = texts.select("row", "doc_id").join(found, "row", "left")
    return out.select("doc_id", F.coalesce(F.size(ids), F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce(F.array_join(ids.cast("array<string>"), " "), F.lit("")).alias("ids_text"), F.coalesce(whole, F.lit(b"")).alias("decoded"))


def decode(ids_text: list[int], vocabulary: str) -> bytes:
    """Bytes of a list of ids, for files written by `encode`."""
    piece = {r: t for t, r in load_ranks(vocabulary).items()}
    return b"".join(piece[i] for i in ids_text)
