"""SimHash near-duplicates, with covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 hashes of all
4-word shingles.  To find every pair within RADIUS bits, bit i is given a
non-zero vector a(i) of RADIUS + 1 bits; table v (of 2**(RADIUS+1) - 1) keeps
the bits with <a(i), v> odd.  The vectors of any RADIUS bits leave some v
orthogonal to all of them, so each such pair agrees on the kept bits of table v
and collides there: nothing within the radius is missed.

Equal fingerprints are one node.  Within a bucket of at most SMALL nodes all
pairs are compared in one pass.  The nodes of larger buckets are linked through
centres instead: two fingerprints are within 2t bits exactly if both are within
t of a common centre, so nodes that meet at a centre are all linked to the
smallest of them.  That is exact and takes a fixed number of rows a node, no
matter how large the bucket is.

Null and empty texts have no words and the fingerprint zero, which links like any
other.  Texts of any length are read whole.  Repeated rows, and equal texts, have
equal fingerprints and so one component; nothing is left to ties, as a component is
named by its smallest id.  Rows without an id belong to components but name none.
An empty table gives no rows; other columns are ignored, whatever they are called.
Ids that are not numbers are an error.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, free, map_rows, materialize
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of a bucket up to which its pairs are compared one by one.
SMALL = 256
#: Ids are below this; nodes of documents without ids are called by numbers from here on.
NAMELESS = 1 << 62


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the shingles of the lower-cased words; 0 for a text without words."""
    from xxhash import xxh64_intdigest as xxh64

    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64(joined, SEED)
    stops = list(accumulate(map(len, words), lambda s, n: s + 1 + n))
    starts = [0, *(s + 1 for s in stops)]
    hashes = np.array([xxh64(joined[a:z], SEED) for a, z in zip(starts, stops[shingle - 1 :])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, text_key (a hash of the text), fp (the 64 bits as a signed bigint). Null texts have no words; other columns are ignored."""

    def scan(columns: list) -> dict[str, list]:
        keys, text_keys, texts = columns
        found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        return {"doc_id": keys, "text_key": text_keys, "fp": found}

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    return map_rows(rows, scan, "doc_id bigint, text_key bigint, fp bigint")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Kept bits of each table, as unsigned numbers; vectors are dealt out evenly."""
    n = 1 << (radius + 1)
    vector = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit_sets(most: int, bits: int = BITS) -> list[int]:
    """All numbers with at most `most` of `bits` bits set, as signed 64-bit numbers."""
    from itertools import combinations

    return [_signed(sum(1 << i for i in c)) for n in range(most + 1) for c in combinations(range(bits), n)]


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) of labels whose components are those of all pairs of distinct `fp` within `radius` bits; nodes are (fp, label)."""
    masks = [_signed(m) for m in covering_masks(radius=radius)]
    tables = nodes.select("fp", "label", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes these for as small as the nodes they are exploded from, so it must be told not to send them to the driver
    keyed = materialize(tables.join(sizes.hint("merge"), ["t", "key"]), "buckets")
    few = keyed.where(F.col("n") <= SMALL).groupBy("t", "key").agg(F.array_sort(F.collect_list(F.struct("fp", "label"))).alias("fps"))
    pair = F.expr(f"flatten(transform(fps, (x, i) -> transform(filter(slice(fps, i + 2, size(fps)), y -> bit_count(x.fp ^ y.fp) <= {radius}), y -> struct(x.label as u, y.label as v))))")
    links = few.select(F.explode(pair).alias("p")).select("p.u", "p.v")
    half = radius // 2
    many = keyed.where(F.col("n") > SMALL).select("fp", "label").distinct()
    if radius % 2:
        raise ValueError("centres need an even radius")
    sets = F.from_json(F.lit(str(_bit_sets(half))), "array<bigint>")
    centred = many.select("label", F.explode(F.transform(sets, lambda b: b.bitwiseXOR(F.col("fp")))).alias("c"))
    low = centred.groupBy("c").agg(F.min("label").alias("u"), F.collect_set("label").alias("labels")).where(F.size("labels") > 1)
    return links.union(low.select("u", F.explode("labels").alias("v")).where("u <> v")).distinct()


def link_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, text_key, fp, component_id, the smallest doc_id reachable over links of at most `radius` bits.

    Texts without words have the fingerprint zero and are linked like others.
    A row without an id is no one's representative and takes its group's (null if none has an id).
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # A node is called by its smallest id, so a component's smallest node is its smallest id; without ids, by a number above all
    nodes = materialize(nodes.withColumn("label", F.coalesce("first", F.col("fp").bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS))), "nodes")
    found = materialize(components(near_links(nodes, radius)), "components")
    lowest = F.coalesce("component", "label")
    members = nodes.join(found.hint("merge"), nodes["label"] == found["node"], "left").select("fp", F.when(lowest < NAMELESS, lowest).alias("component_id"))
    return rows.join(members.hint("merge"), "fp").select("doc_id", "text_key", "fp", "component_id")


def hex_fp(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group, that of the smallest id; rows without an id stay. The columns are the documents' own."""
    groups, key = link_duplicates(docs), free(docs, "key")
    first = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.min("text_key").alias(key))
    keyed = docs.where("doc_id is not null").withColumn(key, F.xxhash64("text"))
    kept = keyed.join(first, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return kept.unionByName(docs.where("doc_id is null"))
