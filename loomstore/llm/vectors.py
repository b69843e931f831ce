"""Vector codes: the parts of integer vectors replaced by their nearest entries of small codebooks.

Each component x becomes floor(1024 x); vectors are cut into PARTS equal consecutive
parts, and each part position has a codebook of at most ENTRIES entries, fitted by
ROUNDS rounds over all vectors.  The nearest entry is found by exponion search: from
the entry a of the round before at distance u, an entry nearer than a, or as near,
lies within 2u of a, so only that much of a's list of entries, sorted by their
distance from a, is scanned, in steps that double.  All distances are exact
integers; of equal ones the lower index wins.  They are reckoned in doubles where
every sum stays below 2^53, and else in Python's integers.

The first entries are the parts of the vectors of smallest ids.  Each round sends
out the codebooks, whose size depends on the vectors' length alone, and sums up per
entry, inside tasks first, so that no entry, however common, is one task.  Vectors
never move between executors; a round writes them with their entries, so that a lost
executor costs some tasks and not the rounds before.

Vectors that are null, or hold a null or a component that is not finite, are dropped.
The longest kept vector gives the length, rounded up to a multiple of PARTS; shorter
vectors, empty ones too, are as if filled up with zeros.  Rows without an id, or of
an id that occurs twice, are kept; for the first entries they go by id, nulls last,
then by vector.  Fewer vectors than entries make smaller codebooks; unused entries
stay.  Errors and their sums beyond a long are the largest long.  Empty tables give
no rows.  Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pieces, sent

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Components are multiplied by it and rounded down.
SCALE = 1024
#: Integers below which doubles are exact, and the largest long.
EXACT, LONGEST = 2**53, 2**63 - 1
#: Rows whose radius is looked up at a time, and entries of the first step of a scan.
ROWS, STEP = 1024, 32
#: Bits of a piece of a sum; pieces are summed by Spark whatever the size of the whole.
PIECE = 30


def whole(x: float) -> int:
    """floor(1024 x), exactly."""
    return int(x) * SCALE if abs(x) >= EXACT else int(np.floor(x * SCALE))


class Codebooks:
    """The entries of each part, their distances from each other, and the search for the nearest."""

    def __init__(self, entries: np.ndarray):
        """`entries`: parts x entries x components, whole numbers in doubles or, where these are not exact, Python's integers."""
        self.entries, self.near, self.far = entries, [], []
        for book in entries:
            apart = np.array([((book - e) ** 2).sum(1) for e in book], entries.dtype)
            self.near.append(np.argsort(apart, axis=1, kind="stable"))
            self.far.append(np.take_along_axis(apart, self.near[-1], 1))
        #: Distances reckoned, for those who want to know what the search saves.
        self.scanned = 0

    def nearest(self, part: int, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of `x`, from the entries `before` on."""
        book, near, far = self.entries[part], self.near[part], self.far[part]
        lengths, own, turned = (book**2).sum(1), (x**2).sum(1), np.ascontiguousarray(book.T)
        best, least = before.copy(), ((x - book[before]) ** 2).sum(1)
        reach = np.concatenate([(far[before[k : k + ROWS]] <= 4 * least[k : k + ROWS, None]).sum(1) for k in range(0, len(x), ROWS)]) if len(x) else before
        order = np.lexsort((-reach, before))  # together from the same entry on, those that must look farthest first
        cuts = np.union1d(np.flatnonzero(np.diff(before[order])) + 1, np.arange(ROWS, len(x), ROWS))
        for rows in np.split(order, cuts) if len(x) else ():
            low, high = 0, STEP
            while n := int(np.searchsorted(-reach[rows], -low)):
                held, some = rows[:n], np.sort(near[before[rows[0]], low:high])  # the lowest of equally near ones comes first
                apart = x[held] @ turned[:, some]
                apart *= -2
                apart += lengths[some]
                index = apart.argmin(1)
                found, index = apart[np.arange(n), index] + own[held], some[index]
                self.scanned += apart.size
                better = (found < least[held]) | (found == least[held]) & (index < best[held])
                best[held[better]], least[held[better]] = index[better], found[better]
                low, high = high, 2 * high
        return best, least


def _rows(column: pa.Array, width: int, exact: bool) -> np.ndarray:
    """Vectors of one length, as whole numbers; those written as doubles are yet to be scaled."""
    flat = column.flatten()
    if pa.types.is_floating(flat.type):
        made = np.array([whole(x) for x in flat.to_pylist()], dtype=object)
    else:
        made = flat.to_numpy(zero_copy_only=False).astype(np.float64 if exact else object)
    return made.reshape(len(column), width)


def fit(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> tuple[DataFrame, np.ndarray, bool] | None:
    """((vec_id, label, v, code), codebooks, whether doubles are exact) after all rounds; none without vectors."""
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.where(F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)))
    n, width, most = kept.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return None
    width, small, bound = -(-width // PARTS) * PARTS, (most or 0) < 2**20, whole(most or 0) + 1
    exact = 16 * width * bound * bound < EXACT
    if small:
        kept = kept.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")))
    kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0 if small else 0.0), F.lit(width) - F.size("v"))))
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    entries = np.array([[x if small else whole(x) for x in r["v"]] for r in first], dtype=np.float64 if exact else object)
    entries = entries.reshape(len(first), PARTS, width // PARTS).swapaxes(0, 1)
    rows = kept.withColumn("code", F.unhex(F.lit("00" * PARTS)))
    for k in range(ROUNDS):
        rows = materialize(assign(rows, entries, width, exact).drop("error"), f"vectors-{k}")
        entries = _means(rows, entries, width, exact)
    return rows, entries, exact


def assign(rows: DataFrame, entries: np.ndarray, width: int, exact: bool) -> DataFrame:
    """`rows` with the nearest entries as `code`, one byte a part, and the squared distances' sum as `error`."""
    books, schema = sent(rows.sparkSession, Codebooks(entries)), T.StructType([*rows.schema.fields, T.StructField("error", T.LongType())])
    at, code = rows.columns.index("v"), rows.columns.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces(batch, 1 << 14):
                x, before = _rows(part.column(at), width, exact), np.frombuffer(b"".join(part.column(code).to_pylist()), np.uint8).reshape(-1, PARTS)
                found = [books().nearest(p, x[:, p * width // PARTS : (p + 1) * width // PARTS], before[:, p].astype(np.int64)) for p in range(PARTS)]
                codes = np.stack([e for e, _ in found], 1).astype(np.uint8)
                errors = sum(d for _, d in found)
                made = {code: pa.array([bytes(c) for c in codes], pa.binary()), len(schema) - 1: pa.array([min(int(e), LONGEST) for e in errors], pa.int64())}
                yield pa.RecordBatch.from_arrays([made[k] if k in made else part.column(k).cast(f.type) for k, f in enumerate(out)], schema=out)

    return rows.mapInArrow(run, schema)


def _means(rows: DataFrame, entries: np.ndarray, width: int, exact: bool) -> np.ndarray:
    """Each entry replaced by the mean of its parts, rounded down; what comes to the driver has the size of the codebooks."""
    size = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, ENTRIES, size), dtype=object), np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            for part in pieces(batch, 4096):
                x, codes = _rows(part.column(0), width, exact), np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
                for p in range(PARTS):
                    order = np.argsort(codes[:, p], kind="stable")
                    held, first = np.unique(codes[order, p], return_index=True)
                    counts[p, held] += np.bincount(codes[:, p], minlength=ENTRIES)[held]
                    if size and len(held):
                        added = np.add.reduceat(x[order, p * size : (p + 1) * size], first, axis=0)
                        sums[p, held] += added.astype(np.int64).astype(object) if exact else added
        keys, values = [], []
        for p, e in np.argwhere(counts).tolist():
            spot = (p * ENTRIES + e) * (size + 1)
            for k, total in enumerate([int(counts[p, e]), *sums[p, e].tolist()]):
                sign, total, piece = (-1 if total < 0 else 1), abs(total), 0
                while total:
                    keys.append((spot + k, piece))
                    values.append(sign * (total & (1 << PIECE) - 1))
                    total, piece = total >> PIECE, piece + 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([p for _, p in keys], pa.int32()), pa.array(values, pa.int64())], names=["spot", "piece", "n"])

    found = np.zeros(PARTS * ENTRIES * (size + 1), dtype=object)
    summed = rows.select("v", "code").mapInArrow(run, "spot bigint, piece int, n bigint").groupBy("spot", "piece").agg(F.sum("n").alias("n")).toArrow()
    for spot, piece, n in zip(*(c.to_pylist() for c in summed.columns)):
        found[spot] += n << PIECE * piece
    found = found.reshape(PARTS, ENTRIES, size + 1)[:, : entries.shape[1]]
    counts = found[:, :, :1]
    return np.where(counts > 0, (found[:, :, 1:] // np.where(counts > 0, counts, 1)).astype(entries.dtype), entries)


def encode(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept vector."""
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("vec_id", vectors.schema[id_col].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    fitted = fit(vectors, vector_col, id_col, label_col)
    if not fitted:
        return spark.createDataFrame([], schema)
    rows, entries, exact = fitted
    digest = hashlib.sha256(",".join(str(int(x)) for x in entries.reshape(-1)).encode()).hexdigest()
    width = entries.shape[0] * entries.shape[2]
    done = materialize(assign(rows, entries, width, exact).select("vec_id", "label", "code", "error"), "codes")
    sums = done.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error")).withColumnRenamed("label", "of")
    done = done.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return done.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
