"""Token-id files: directly addressable codes of the ids, in blocks of whole documents in ascending order of their ids.

A block holds the ids of consecutive documents, about BLOCK_TOKENS of them.  Each
id is cut into chunks from its low bits up.  Level k holds, packed, the k-th chunk
of all ids that have one, a bitmap that says which of them go on in level k + 1,
and a rank directory with the number of set bits before every 512.  An id at place
i is read by its chunk i, its bit, and the chunk at rank(i) of the next level, so
that no other id is decoded; the ids of a document are one run of each level.  The
widths of the chunks are those of fewest bits for the block's own ids.

Blocks are rows of Parquet files, whose commits Spark makes safe against lost and
repeated tasks on any file system.  A block's columns say its shard, its place in
it, how many ids lie before it in the shard, and which documents it holds; a second
table says how many ids lie before each shard.

Documents are dealt out in ranges of (id, hash of the text, place in the input), so
that no id, however frequent, is one task.  The tokenizer is applied to each distinct
word between ASCII white space that a Python worker has not met before, in this task
or an earlier one: no rule of it looks across white space.

A null text is empty; an empty text has the end id alone, or no ids without one.
Texts of any length are read whole and stay in one block.  Documents without an id
come first; rows of one id lie in the order of their texts' hashes, equal rows in
that of the input; each row is a document of its own.  An id may be of any type that
Spark can sort.  No documents make no blocks.  Other columns are ignored, whatever
they are called.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

#: Ids after which a block is closed; a longer document makes a longer block.
BLOCK_TOKENS = 1 << 16
#: Distinct words, and bytes of them, that a worker remembers before it forgets those that did not come again; bounds its memory.
MEMORY_WORDS, MEMORY_BYTES = 600_000, 16_000_000
#: Bytes of text for a task, which are sorted, and whose codes are written and read, in an executor's memory; and the most tasks.
TASK_BYTES, MOST_TASKS = 12 << 20, 50_000
#: Bytes of text that are worked on at a time.
TEXT_BYTES = 6 << 20
#: Latin letters, each one code point by itself and in lower case.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words that a tokenizer file gets at a time, as its results are much larger than their ids; and those of LETTERS that are one text.
MANY_WORDS, JOINED_WORDS = 4096, 256
#: Bits between entries of a rank directory.
RANK_BITS = 512
#: Ids of words.
IDS = pa.list_(pa.uint32())


def plain(words: pa.Array) -> pa.Array:
    """Whether each word consists of LETTERS."""
    return pc.match_substring_regex(words, rf"\A[{LETTERS}]+\z")


def size(words: pa.Array) -> int:
    """Bytes of the words."""
    return pc.sum(pc.binary_length(words)).as_py() or 0


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of so many of the values each."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), values)


def best_widths(lengths: np.ndarray) -> list[int]:
    """Chunk widths, low bits first, that need the fewest bits for ids of these lengths in bits."""
    top = int(lengths.max(initial=1))
    left = (len(lengths) - np.cumsum(np.bincount(lengths, minlength=top))).tolist()  # ids that reach beyond bit b
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for a in range(top - 1, -1, -1):
        best[a] = min((left[a] * (z - a + (1 + 32 / RANK_BITS) * (z < top)) + best[z][0], [z - a, *best[z][1]]) for z in range(a + 1, top + 1))
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits, one after another: 64 of them are `width` words of 64 bits."""
    n = len(values)
    columns = np.zeros(-(-n // 64) * 64, np.uint64)
    columns[:n] = values
    columns = np.ascontiguousarray(columns.reshape(-1, 64).T)
    out = np.zeros((width, columns.shape[1]), "<u8")
    for k in range(64):
        word, shift = k * width >> 6, k * width & 63
        out[word] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return out.T.tobytes()[: (n * width + 7) // 8]


def _unpack(data: bytes, first: int, width: int, a: int, z: int) -> np.ndarray:
    """The values from the a-th to before the z-th of those packed from byte `first` on."""
    start = a // 64
    held = data[first + start * width * 8 : first + (z * width + 7) // 8]
    words = np.frombuffer(held.ljust((-(-z // 64) - start) * width * 8, b"\0"), "<u8").reshape(-1, width).T.copy()
    out, mask = np.empty((64, words.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = k * width >> 6, k * width & 63
        out[k] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[k] |= words[word + 1] << np.uint64(64 - shift)
    out &= mask
    return out.T.astype(np.uint32).ravel()[a - 64 * start : z - 64 * start]


def encode_ids(ids: np.ndarray) -> bytes:
    """Ids, each below 2^32, as directly addressable codes."""
    ids = np.asarray(ids, np.uint32)
    lengths = np.maximum(1, np.frexp(ids.astype(np.float64))[1])
    widths = best_widths(lengths)
    parts, head, below = [], [len(widths)], 0
    for k, width in enumerate(widths):
        head += [width, len(ids)]
        parts.append(_pack(ids & ((1 << width) - 1), width))
        ids, below = ids >> np.uint32(width) if width < 32 else ids * 0, below + width
        if k + 1 < len(widths):
            more = lengths > below
            ids, lengths = np.compress(more, ids), np.compress(more, lengths)
            bits = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), RANK_BITS // 8), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
            parts += [bits.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()]
    return np.array(head, "<u4").tobytes() + b"".join(parts) + bytes(8)  # so that 8 bytes can be read from any place


class Codes:
    """Random access to the ids of a block."""

    def __init__(self, data: bytes):
        self.data, self.levels = data, []
        count = int(np.frombuffer(data, "<u4", 1)[0])
        head, at = np.frombuffer(data, "<u4", 2 * count, 4).tolist(), 4 + 8 * count
        for k in range(count):
            width, n = head[2 * k : 2 * k + 2]
            chunks, at = at, at + (n * width + 7) // 8
            bits = ranks = at
            if k + 1 < count:
                ranks = at + (n + 7) // 8
                at = ranks + 4 * -(-n // RANK_BITS)
            self.levels.append((width, n, chunks, bits, ranks))
        self.size = head[1] if count else 0

    def _words(self, first: int) -> np.ndarray:
        """The 8 bytes from any byte on."""
        return np.ndarray(len(self.data) - first - 7, "<u8", self.data, first, (1,))

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place, by the directory and at most RANK_BITS bits of the bitmap."""
        _, n, _, bits, ranks = self.levels[level]
        if not n:
            return at * 0
        block = np.minimum(at // RANK_BITS, -(-n // RANK_BITS) - 1)
        found = np.frombuffer(self.data, "<u4", -(-n // RANK_BITS), ranks)[block].astype(np.int64)
        words = self._words(bits)
        for k in range(RANK_BITS // 64):
            low = np.clip(at - block * RANK_BITS - 64 * k, 0, 64)
            mask = np.where(low >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(low, 63).astype(np.uint64)) - np.uint64(1))
            held = words[np.minimum(bits * 0 + block * (RANK_BITS // 8) + 8 * k, len(words) - 1)]
            found += np.bitwise_count(held & mask).astype(np.int64)
        return found

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places, each read by itself."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.size):
            raise IndexError("no such place in the block")
        ids, live, shift = np.zeros(len(at), np.uint64), np.arange(len(at)), 0
        for k, (width, _, chunks, bits, _) in enumerate(self.levels):
            if not len(live):
                break
            first = at * width
            ids[live] |= ((self._words(chunks)[first >> 3] >> (first & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)) << np.uint64(shift)
            shift += width
            if k + 1 < len(self.levels):
                more = np.frombuffer(self.data, np.uint8, offset=bits)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                live, at = live[more], self._rank(k, at[more])
        return ids.astype(np.uint32)

    def run(self, first: int, end: int) -> np.ndarray:
        """The ids from `first` to before `end`: one run of each level."""
        ids, live, shift, a, z = np.zeros(end - first, np.uint32), np.arange(end - first), 0, first, end
        for k, (width, _, chunks, bits, _) in enumerate(self.levels):
            if z <= a:
                break
            ids[live] |= _unpack(self.data, chunks, width, a, z) << np.uint32(shift)
            shift += width
            if k + 1 < len(self.levels):
                more = np.unpackbits(np.frombuffer(self.data, np.uint8, (z + 7) // 8 - a // 8, bits + a // 8), bitorder="little")[a % 8 :][: z - a] == 1
                a, z = (int(x) for x in self._rank(k, np.array([a, z])))
                live = np.compress(more, live)
        return ids


class Words:
    """Ids of texts by those of their words between ASCII white space, each distinct word tokenized once.

    Signs of `stops` after a letter begin another word.  Words that differ only in
    case and consist of Latin letters are one with `lower`.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]] | pa.ListArray], stops: str = "", lower: bool = False):
        self.encode, self.lower = encode, lower
        self.stops = f"([{LETTERS}])([{re.escape(stops)}])" if stops else ""
        self.clear()

    def clear(self) -> None:
        self.slots, self.ids, self.hits = pa.array([], pa.string()), pa.array([], IDS), np.zeros(0, np.int32)

    def forget(self) -> None:
        """Keep the words that two calls or more had since the last time; none, if these are too many."""
        keep = pa.array(self.hits > 1)
        slots, ids = self.slots.filter(keep), self.ids.filter(keep)
        self.clear()
        if len(slots) <= MEMORY_WORDS // 2 and size(slots) <= MEMORY_BYTES // 2:
            self.slots, self.ids, self.hits = slots, ids, np.ones(len(slots), np.int32)

    def learn(self, new: pa.Array) -> None:
        found = self.encode(new.to_pylist())
        found = found if isinstance(found, pa.Array) else pa.array(found, IDS)
        self.slots, self.ids = pa.concat_arrays([self.slots, new]), pa.concat_arrays([self.ids, found])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int32)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        if len(self.slots) > MEMORY_WORDS or size(self.slots) > MEMORY_BYTES:
            self.forget()
        texts = pc.fill_null(texts, "")
        if self.stops:
            texts = pc.replace_substring_regex(texts, self.stops, r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(split.flatten())
        words, places = coded.dictionary.cast(pa.string()), coded.indices
        if self.lower:
            coded = pc.dictionary_encode(pc.if_else(plain(words), pc.utf8_lower(words), words))
            words, places = coded.dictionary, coded.indices.take(places)
        slots = pc.fill_null(pc.index_in(words, self.slots), -1).to_numpy().copy()
        if len(new := np.flatnonzero(slots < 0)):
            slots[new] = np.arange(len(self.slots), len(self.slots) + len(new))
            self.learn(words.take(pa.array(new)))
        self.hits[slots] += 1
        ids = self.ids.take(pa.array(slots)).take(places)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(), dtype=np.int64)])
        return ids.flatten().to_numpy(), np.diff(ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])])


def tokenizer_words(path: str, lower: bool = False) -> Callable[[list[str]], pa.ListArray]:
    """How a tokenizer file encodes words, without special tokens added.

    With `lower`, words of lower-case Latin letters go to its model at once, as the
    byte alphabet writes them: for byte-level files that lower letters and keep runs
    of them whole.  If the model marks the ends of words, many go as one text, whose
    ids tell where each word ends.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    spelt = np.arange(256, dtype="<u4")  # by the byte; those of LETTERS, and the blank
    for c in map(chr, range(0xC0, 0x100)):
        spelt[list(c.encode())] = list(map(ord, spell(c)[0][0]))
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    marked = not set(suffix) <= {chr(c) for c in spelt.tolist() if chr(c).isalpha() or c > 127}  # else a word may have it inside
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    last[[i for w, i in vocabulary.items() if marked and w.endswith(suffix)]] = True

    def encoded(by: Tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, and how many each has."""
        found = [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def direct(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = " ".join(words)
        words = words if text.isascii() else spelt[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le").split(" ")
        if marked:
            ids, _ = encoded(model, [" ".join(words[k : k + JOINED_WORDS]) for k in range(0, len(words), JOINED_WORDS)])
            ends = np.flatnonzero(last[ids])
            if len(ends) == len(words):  # else one ends with a letter that the model does not know
                return ids, np.diff(ends, prepend=-1)
        return encoded(model, words)

    def some(words: list[str]) -> pa.ListArray:
        plainly = plain(pa.array(words, pa.string())).to_numpy(zero_copy_only=False) if lower else np.zeros(len(words), bool)
        parts = [fn([words[k] for k in at.tolist()]) for fn, at in ((direct, np.flatnonzero(plainly)), (lambda x: encoded(tokenizer, x), np.flatnonzero(~plainly)))]
        ids, counts = (np.concatenate(x) for x in zip(*parts))
        return lists(ids, counts).take(pa.array(np.argsort(np.argsort(~plainly, kind="stable"))))

    return lambda words: pa.concat_arrays([some(words[k : k + MANY_WORDS]) for k in range(0, max(1, len(words)), MANY_WORDS)])


@lru_cache(maxsize=1)
def _kept(path: str, stops: str, lower: bool, state: tuple[int, int]) -> Words:
    return Words(tokenizer_words(path, lower), stops, lower)


def kept_words(path: str, stops: str = "", lower: bool = False) -> Words:
    """The words of a tokenizer file, which a Python worker keeps from task to task; those of a file that changed are made anew."""
    found = os.stat(path)
    return _kept(path, stops, lower, (found.st_mtime_ns, found.st_size))


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, stops: str = "", lower: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode `docs` by a tokenizer file that all executors can read, and write the ids' files below `path`, which must not exist.

    `stops` and `lower` name what the file is known to do (see `Words` and
    `tokenizer_words`), and save time only.
    """
    size = docs.select(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("n"))
    rows = rows.repartitionByRange(min(MOST_TASKS, 1 + size // TASK_BYTES), "id", "h", "n").sortWithinPartitions("id", "h", "n").select("id", "text")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, words = to_arrow_schema(schema), kept_words(tokenizer, stops, lower)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        names, sizes, held, tail = [], [], [], np.zeros(0, np.uint32)

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            columns = [[shard], [block], [start], [pa.concat_arrays(names)], [np.concatenate(sizes)], [encode_ids(ids)]]
            lists = lambda values, k: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(out.field(k).type)
            return pa.RecordBatch.from_arrays([*(pa.array(c, out.field(k).type) for k, c in enumerate(columns[:3])), lists(columns[3][0], 3), lists(pa.array(columns[4][0]), 4), pa.array(columns[5], pa.binary())], schema=out)

        for batch in batches:
            for part in pieces(batch, 1 << 16, TEXT_BYTES):
                ids, counts = words(part.column(1))
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
                ends, first, done = np.cumsum(counts), 0, 0
                while first < len(counts):
                    room = BLOCK_TOKENS - sum(map(len, held))
                    last = min(len(counts), int(np.searchsorted(ends, done + room, "left")) + 1)  # with the document that fills it
                    names.append(part.column(0).slice(first, last - first))
                    sizes.append(counts[first:last])
                    held.append(ids[done : ends[last - 1]])
                    first, done = last, int(ends[last - 1])
                    if sum(map(len, held)) >= BLOCK_TOKENS:
                        yield close()
                        block, start = block + 1, start + sum(map(len, held))
                        names, sizes, held = [], [], []
        if names:
            yield close()

    rows.mapInArrow(run, schema).write.mode("errorifexists").parquet(f"{path}/blocks")
    # A row for each task that wrote
    spark = docs.sparkSession
    spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).coalesce(1).selectExpr(
        "shard", "coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"
    ).write.mode("errorifexists").parquet(f"{path}/shards")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks at `path`, with `start` counted over all shards."""
    shards = spark.read.parquet(f"{path}/shards")
    return spark.read.parquet(f"{path}/blocks").join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens): each document's ids as little-endian unsigned 32-bit integers, read from its block."""
    held = blocks(spark, path).select("start", "ids", "sizes", "codes")
    schema = T.StructType([T.StructField("id", held.schema["ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                codes, sizes = Codes(batch.column(3)[k].as_py()), np.asarray(batch.column(2)[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                data = codes.run(0, codes.size).astype("<u4").tobytes()  # neighbours, read as one run
                ids = [data[4 * (z - n) : 4 * z] for z, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(1)[k].values.cast(out.field(0).type), pa.array(batch.column(0)[k].as_py() + ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())], schema=out)

    return held.mapInArrow(run, schema)


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """(place, token) for the places, counted over all documents, that exist: each block is met once, and no other id of it is decoded."""
    held = blocks(spark, path)
    held = held.withColumn("end", F.col("start") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    span = lambda c: F.shiftright(c, 16)  # noqa: E731  a block meets few spans, as it has as many ids or is a shard's last
    keys = held.select("shard", "block", "start", "end", F.explode(F.sequence(span(F.col("start")), span(F.greatest("start", F.col("end") - 1)))).alias("span"))
    asked = places.select(F.col(place).cast("long").alias("p")).where("p IS NOT NULL").distinct().withColumn("span", span(F.col("p")))
    asked = asked.join(keys, "span").where("p >= start AND p < end").groupBy("shard", "block").agg(F.collect_list("p").alias("places"))  # as many as the block has ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = np.asarray(batch.column(1)[k].as_py(), np.int64)
                ids = Codes(batch.column(2)[k].as_py()).at(at - batch.column(0)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.astype(np.int64))], names=["place", "token"])

    return held.join(asked, ["shard", "block"]).select("start", "places", "codes").mapInArrow(run, "place bigint, token bigint")
