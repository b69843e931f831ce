"""Helpers that the operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstore.plans.shared import materialize, scratch

#: ASCII upper case to lower case, for bytes.translate.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def held_out(doc_id: str | Column, mod: int, remainder: int) -> Column:
    """Whether a row is kept from training; a row without an id is neither held out nor learned from."""
    return F.coalesce(fold(doc_id, mod) == remainder, F.lit(False))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Bytes of an Arrow batch that become Python objects at a time.
PIECE_BYTES = 1 << 22


def pieces(batch: pa.RecordBatch, rows: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and about `most` (PIECE_BYTES) bytes, but of one row at least."""
    most = most or PIECE_BYTES
    size = max(1, batch.nbytes // max(1, batch.num_rows))
    if size * min(rows, batch.num_rows) <= most // 4:  # even with some rows much longer
        ends = list(range(rows, batch.num_rows, rows))
    else:
        widths = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy().astype("int64") for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type)), 0 * np.arange(batch.num_rows))
        ends, first, held = [], 0, 0
        for at, width in enumerate(widths.tolist()):
            if at > first and (at - first >= rows or held + width > most):
                ends.append(at)
                first, held = at, 0
            held += width
    for a, z in zip([0, *ends], [*ends, batch.num_rows]):
        if z > a:
            yield batch.slice(a, z - a)


def map_rows(df: DataFrame, fn: Callable[[list], dict], schema: str, rows: int = 512) -> DataFrame:
    """Run `fn` over column lists, at most `rows` input rows and about PIECE_BYTES bytes at a time; it returns columns by name.

    That bounds the Python objects alive at once, but for a text that is longer.  Binary
    and string columns arrive as bytes and str; nulls as None.
    """
    arrow = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(arrow)
        for batch in batches:
            for part in pieces(batch, rows):
                columns = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, arrow)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y), written: at most `per_class` labelled training documents of each class; and the classes' sizes in documents.

    Documents whose fold is `remainder` are never among them.  A document is chosen
    by the hash of its id, so the sample is the same on every run.  One with several
    labels takes the largest; an id with several rows counts once, with the text of
    the smallest hash; labels without a document count nowhere.
    """
    y = F.col(label).cast("int")
    labels = labels.select(F.col(id_col).alias("doc_id"), y.alias("y")).where(y.isin(0, 1) & (fold(id_col, mod) != remainder))
    labels = labels.groupBy("doc_id").agg(F.max("y").alias("y")).join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    labels = materialize(labels, "labels")
    sizes = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [labels.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = parts[0].union(parts[1])  # 2 * per_class rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("t"))
    return materialize(rows.select("doc_id", "t.text", "y"), "sample"), sizes


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast `value` of bounded size; the result gives it on an executor, which needs no copy of its class's module."""
    data, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not held:
            held.append(pickle.loads(data.value))
        return held[0]

    return get


def append(df: DataFrame, text_col: str, fn: Callable[[list], list], name: str, kind: str, rows: int = 512) -> DataFrame:
    """`df` with a column that `fn` makes of its texts, some at a time as in `map_rows`; the other columns pass through as they are."""
    # By place, as a name may hold anything
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    schema = T.StructType([*plain.schema.fields, *df.sparkSession.createDataFrame([], f"made {kind}").schema.fields])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces(batch, rows):
                made = pa.array(fn(part.column(at).to_pylist()), out.field(len(out) - 1).type)
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns, out)), made], schema=out)

    return plain.mapInArrow(run, schema).toDF(*df.columns, name)


def keep_rows(docs: DataFrame, fn: Callable[[list], list], text_col: str = "text", rows: int = 512) -> DataFrame:
    """The rows of `docs` for whose text `fn` says True, with their own columns."""
    name = free(docs, "keep")
    return append(docs, text_col, fn, name, "boolean", rows).where(F.col(name)).drop(name)
