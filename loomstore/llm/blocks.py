"""Blocks of rows that ask a distributed table for what they hold, and read the answers together.

A block is a run of input rows, bounded in size and written once to the shared
folder, bucketed by its number: whatever is keyed by block meets it without
moving it again.  What a block needs to know of the whole input, it asks for
once, however many of its rows need it.  So a key that a third of all rows share
is asked for once by each block, and no task ever sees its rows together.

`ask` sends sorted 64-bit keys with a count each to the tasks that own their
ranges; `answer` adds the counts up over all blocks and sends every block the
sums, in the order it asked.  Keys and counts travel a row for each block and range,
as compressed columns; where ranges are so many that a block has but a few keys in
each, as plain pairs, at worst one a row, as a grouping by key would send them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

ASKED = "part int, block bigint, n int, plain boolean, data binary"
ANSWERED = "block bigint, level int, part int, n int, plain boolean, present bigint, data binary"
#: Keys of a row, on average, below which packing costs more than it saves.
FEW_KEYS = 64


def write_blocks(rows: DataFrame) -> DataFrame:
    """`rows` as a table in the shared folder, bucketed by their column `block`."""
    spark = rows.sparkSession
    path = scratch(spark, "blocks")
    name, buckets = path.rpartition("/")[2].replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.format("parquet").option("compression", "zstd").option("parquet.block.size", 32 << 20)
    # Rows are large: look at the size of a page and of a row group after every few of them
    writer = writer.option("parquet.page.size.row.check.min", 2).option("parquet.block.size.row.check.min", 4).option("parquet.block.size.row.check.max", 16)
    writer.mode("append").bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def block_number(k: int) -> int:
    """A number for the k-th block of the running task, the same when the task is run again."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) + k


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed; plain where they fit in fewer bytes."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not wide[:, used - 1].any():
        used -= 1
    planes = np.ascontiguousarray(wide[:, :used].T).tobytes()
    return bytes([used]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], used * n, "zstd", asbytes=True), np.uint8).reshape(used, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> bytes:
    first = packed(a)
    return len(first).to_bytes(8, "little") + first + packed(b)


def _unpair(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return unpacked(data[8 : 8 + n]), unpacked(data[8 + n :])


def ask(block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """Rows of ASKED for a block's sorted distinct keys; in time linear in the keys, whatever the number of parts below 2^32."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(first, len(keys))
    plain = len(keys) < FEW_KEYS * len(first)
    if plain:  # (key, count) pairs as they are, cut without a look at each row
        pairs = np.stack([keys, counts.astype(np.uint64)], 1).astype("<u8")
        data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 16).astype("<i4").tobytes()), pa.py_buffer(pairs.tobytes())])
    else:
        data = pa.array([_pair(np.diff(keys[a:z], prepend=np.uint64(0)), counts[a:z]) for a, z in zip(first.tolist(), ends[1:].tolist())], pa.binary())
    n = len(first)
    return pa.table([pa.array(part[first], pa.int32()), pa.array(np.full(n, block), pa.int64()), pa.array(np.diff(ends), pa.int32()), pa.array(np.full(n, plain)), data], names=["part", "block", "n", "plain", "data"])


def _asked(data: bytes, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    if plain:
        return tuple(np.frombuffer(data, "<u8").reshape(-1, 2).T)
    diffs, counts = _unpair(data)
    return np.cumsum(diffs, dtype=np.uint64), counts


def answer(asked: DataFrame, level: int) -> DataFrame:
    """ANSWERED, written: for each row of ASKED its keys' counts over all blocks, doubled, plus 1 if another block asked for the key; and (on one row a part) how many keys count more than 0."""

    def add(rows: pa.Table) -> pa.Table:
        found = [_asked(x, p) for x, p in zip(rows["data"].to_pylist(), rows["plain"].to_pylist())]
        keys = np.concatenate([k for k, _ in found])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        del keys
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        sums = np.add.reduceat(np.concatenate([c for _, c in found])[order], first)
        each = np.empty(len(order), np.uint64)
        sizes = np.diff(np.append(first, len(order)))
        each[order] = np.repeat(sums, sizes)
        shared = np.empty(len(order), np.uint64)
        shared[order] = np.repeat(sizes > 1, sizes)
        stops = np.cumsum([len(k) for k, _ in found])
        present = [int((sums > 0).sum())] + [0] * (len(found) - 1)
        data = [x.tobytes() if p else packed(x) for x, p in zip(np.split(each * np.uint64(2) + shared, stops[:-1]), rows["plain"].to_pylist())]
        return pa.table([rows["block"], pa.array([level] * len(found), pa.int32()), rows["part"], rows["n"], rows["plain"], pa.array(present, pa.int64()), pa.array(data, pa.binary())], names=["block", "level", "part", "n", "plain", "present", "data"])

    return materialize(asked.groupBy("part").applyInArrow(add, ANSWERED), "answers")


def answers_of(rows: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts that a block got at a level, in the order of the keys it asked for, and whether other blocks asked for them too."""
    here = rows.filter(pc.equal(rows["level"], level)).sort_by("part")
    got = [np.frombuffer(x, "<u8") if p else unpacked(x) for x, p in zip(here["data"].to_pylist(), here["plain"].to_pylist())]
    both = np.concatenate(got) if got else np.zeros(0, np.uint64)
    return (both >> np.uint64(1)).astype(np.int64), (both & np.uint64(1)).astype(bool)


def read_blocks(blocks: DataFrame, answers: DataFrame | None, fn: Callable[[int, pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """`fn` of each block's number, rows and answers; blocks stay where they are."""
    groups = blocks.groupBy("block")
    if answers is None:
        return groups.applyInArrow(lambda key, rows: fn(key[0].as_py(), rows, None), schema)
    return groups.cogroup(answers.groupBy("block")).applyInArrow(lambda key, rows, got: fn(key[0].as_py(), rows, got), schema)
