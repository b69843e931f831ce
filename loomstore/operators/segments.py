"""A stored full-text index in segments: appends, deletions, tiered merges, and the best texts by block maxima.

A segment is written once and never changed.  Its texts are put in the order of
their length and cut into spans of at most SPAN texts; its postings have a row for
each term and span (several if the span has very many words), with the texts,
frequencies and positions in it, and with their number, greatest frequency and least
length.  They are dealt out to their files in slices, and what is written on the way
is deleted once it is used, so the disk in use stays near that of the index and what
it is merged from.  `vacuum` deletes what merges left.  Rows lie in folders by the term's
first character, in the order of term and span, so a search reads the row groups of
its own terms.  A numbered commit names the segments with the number and length of
their live texts, so the statistics of a search come from that one small file; no
table of texts is read.

Deleted texts are tombstones: their keys by segment and span, and how many of them
hold each term.  When FAN segments are of one tier (a power of FAN in texts), they are
merged into one: spans that are not full are put together, and tombstones are cleared
away.  So n appends leave some FAN * log(n) segments, and a text is rewritten log(n)
times.

`best` ranks without reading all postings.  No text of a span can score more than
the sum over the terms of what the span's greatest frequency and least length give.
The spans of highest bounds are read first; the score of their last result that
is wanted is a threshold, and of all other spans only those whose bound reaches it
are read.  The result is that of the full ranking.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions import fts
from loomstore.functions.stem import stem
from loomstore.operators import search
from loomstore.operators.search import B, BUCKETS, K1, Index
from loomstore.plans.shared import discard, materialize, shuffles_dropped

#: Texts of a span at most; segments of a tier that are merged; spans that are read first by `best`.
SPAN, FAN, SEEDS = 1024, 8, 16
#: Words that a task groups at once; words whose postings are dealt out at once (or a 16th of all, if that is more), as in shuffles they
#: take several times the disk that they take in files; keys of a broadcast.
PIECE, SLICE, KEYS = 1 << 20, 1 << 23, 1 << 19


def _postings_of(batches: Iterator[pa.RecordBatch], key: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """(term, span, hits) of texts (key columns, dl, span, words), which come span by span; a span of over `most` words may give several rows a term."""
    held: list[pa.RecordBatch] = []
    span, words = None, 0
    for batch in batches:
        spans, ends = batch.column("span").to_numpy(), np.cumsum(batch.column("dl").to_numpy(), dtype=np.int64)
        cuts = np.flatnonzero((np.diff(spans) != 0) | (np.diff(ends // most) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(spans)]):
            more = int(ends[b - 1] - (ends[a - 1] if a else 0)) if b else 0
            if held and (spans[a] != span or words + more > most):
                yield _grouped(held, key)
                held, words = [], 0
            if b > a:
                held.append(batch.slice(a, b - a))
                span, words = spans[a], words + more
    if held:
        yield _grouped(held, key)


def _grouped(batches: list[pa.RecordBatch], key: list[str]) -> pa.RecordBatch:
    """The postings of some texts of one span."""
    texts = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    words = pc.split_pattern(texts.column("words"), " ")
    n, found = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
    codes = found.indices.to_numpy()
    order = np.argsort(codes, kind="stable")  # by term, then as the texts and their words stand
    text = np.repeat(np.arange(len(n)), n)[order]
    at = (np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n))[order]
    codes = codes[order]
    begins = np.append(True, np.diff(codes) != 0)
    hit_at, term_at = np.flatnonzero(begins | np.append(True, np.diff(text) != 0)), np.flatnonzero(begins)
    held = texts.select([*key, "dl"]).take(pa.array(text[hit_at]))
    ends = np.append(hit_at, len(codes))
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
    hits = pa.StructArray.from_arrays([*(held.column(k) for k in key), held.column("dl"), pa.array(np.diff(ends), pa.int32()), positions], [*key, "dl", "tf", "positions"])
    hits = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(hit_at, term_at), len(hit_at)), pa.int32()), hits)
    terms = found.dictionary.take(pa.array(codes[term_at]))
    return pa.RecordBatch.from_arrays([terms, texts.column("span").take(pa.array(np.zeros(len(terms), np.int64))), hits], ["term", "span", "hits"])


class Segments:
    """An index at `name` of a store; `key` are the columns that name a text."""

    def __init__(self, store, name: str, key: list[str], key_type: str, stemmed: bool = True, fan: int = FAN):
        self.store, self.spark, self.name, self.key, self.key_type, self.stemmed, self.fan = store, store.spark, name, key, key_type, stemmed, fan
        fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in key_type.split(", "))
        self.hits = f"term string, span bigint, hits array<struct<{fields}, dl: int, tf: int, positions: array<int>>>"
        self.schema = self.hits.replace("hits", "n int, max_tf int, min_dl int, hits") + ", bucket int, segment string"

    # Commits

    def manifest(self) -> tuple[int, list[dict]]:
        """The newest commit's number, and its segments: name, texts, tokens (of live texts), tombstones, files taken in."""
        version = max((int(n) for n in self.store._names(f"{self.name}/commits") if n.isdigit()), default=0)
        return version, json.loads(self.store.text_of(f"{self.name}/commits/{version:012d}")) if version else []

    def _commit(self, version: int, segments: list[dict]) -> bool:
        return self.store._put_new(f"{self.name}/commits/{version + 1:012d}", json.dumps(segments))

    def _path(self, segment: str, kind: str) -> str:
        return f"{self.store.root}/{self.name}/{kind}/segment={segment}"

    # Writing

    def add(self, rows: DataFrame, text: Column, files: list[str] | None = None) -> bool:
        """Take texts in as a new segment, once and for all; merges what has become due.

        With `files`, the names of files that the rows were read from, nothing is
        added (and False returned) if another writer has taken one of them.
        """
        segment = uuid4().hex
        with shuffles_dropped(self.spark):
            texts, tokens = self._add(rows.select(*self.key, text.alias("text")), segment)
        entry = {"name": segment, "texts": texts, "tokens": tokens, "dead": [], "files": files or []}
        while True:
            version, held = self.manifest()
            if files and any(f in s["files"] for s in held for f in files):
                return False
            if self._commit(version, [*held, entry]):
                break
        self.merge()
        return True

    def _add(self, rows: DataFrame, segment: str) -> tuple[int, int]:
        """Write a segment of some texts (key columns, text); their number, and that of their words."""
        # Written first, as dealing out by ranges reads its rows twice; else all is tokenized and stemmed twice
        read = materialize(search.indexed(rows, F.col("text"), self.stemmed).select(*self.key, "dl", F.array_join("tokens", " ").alias("words")), "tokens")
        texts, tokens = read.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if texts:
            ready = read.repartitionByRange(math.ceil((tokens + 1) / PIECE), "dl", *self.key).sortWithinPartitions("dl", *self.key)
            # A partition's rows are numbered in their order; the partition's number stands above bit 33
            at = F.monotonically_increasing_id()
            ready = materialize(ready.withColumn("span", F.shiftleft(F.spark_partition_id().cast("bigint"), 32) + F.floor(at % F.lit(1 << 33) / SPAN)), "texts")
            ready.select(*self.key, "dl", "span").write.option("compression", "zstd").parquet(self._path(segment, "texts"))
            key, piece = self.key, PIECE
            sizes = ready.groupBy(F.shiftright("span", 32).alias("part")).agg(F.sum("dl").alias("dl")).orderBy("part").collect()  # a row for PIECE words
            slices: list[list[int]] = []
            words, most = 0, max(SLICE, tokens / 16)
            for r in sizes:
                if not slices or words + r["dl"] > most:
                    slices.append([r["part"], r["part"]])
                    words = 0
                slices[-1][1], words = r["part"], words + r["dl"]
            for first, last in slices:
                some = ready.where(F.col("span").between(first << 32, (last + 1 << 32) - 1) & (F.col("dl") > 0))
                grouped = materialize(some.mapInArrow(lambda batches: _postings_of(batches, key, piece), self.hits), "grouped")
                self._write(grouped, segment)
                discard(grouped)
            discard(ready)
        discard(read)
        return texts, tokens

    def _write(self, rows: DataFrame, segment: str) -> None:
        """Write postings (term, span, hits: at most SPAN), beside those that are there; dealing out by ranges reads them twice."""
        rows = rows.withColumns({"n": F.size("hits"), "max_tf": F.array_max(F.col("hits.tf")), "min_dl": F.array_min(F.col("hits.dl")), "bucket": F.ascii("term") % BUCKETS})
        rows.repartitionByRange("bucket", "term", "span").sortWithinPartitions("bucket", "term", "span").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(self._path(segment, "postings"))

    def remove(self, keys: DataFrame) -> int:
        """Put tombstones on the texts of these keys; returns how many were live. Starts again if another writer was first."""
        while True:
            version, held = self.manifest()
            live = [s["name"] for s in held if s["texts"]]
            if not live:
                return 0
            gone = self._texts(live).join(keys.select(*self.key).distinct(), self.key)
            if (dead := self._dead(held)) is not None:
                gone = gone.join(dead.select("segment", *self.key), ["segment", *self.key], "left_anti")
            name = uuid4().hex
            with shuffles_dropped(self.spark):
                gone = materialize(gone, "gone")
                sums = {r["segment"]: r for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()}  # a row a segment
                if not sums:
                    return 0
                gone.write.parquet(f"{self.store.root}/{self.name}/dead/{name}/texts")
                # How many of them hold each term: each hit is looked up in KEYS keys at a time, where it is read
                names = [f"k{k}" for k in range(len(self.key))]
                hits = self._postings(list(sums)).select("segment", "term", *(F.col(f"hits.{k}").alias(n) for k, n in zip(self.key, names)))
                hits = hits.select("segment", "term", F.explode(F.arrays_zip(*names)).alias("k")).select("segment", "term", *(F.col(f"k.{n}").alias(k) for k, n in zip(self.key, names)))
                parts = math.ceil(sum(r["n"] for r in sums.values()) / KEYS)
                for part in range(parts):
                    some = gone.select("segment", *self.key).where(F.pmod(F.xxhash64(*self.key), F.lit(parts)) == part)
                    terms = hits.join(F.broadcast(some), ["segment", *self.key])
                    terms.groupBy("segment", "term").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{self.store.root}/{self.name}/dead/{name}/terms")
                discard(gone)
            after = [s | {"texts": s["texts"] - sums[s["name"]]["n"], "tokens": s["tokens"] - sums[s["name"]]["dl"], "dead": [*s["dead"], name]} if s["name"] in sums else s for s in held]
            if self._commit(version, after):
                return sum(r["n"] for r in sums.values())

    def merge(self) -> int:
        """Merge segments, `fan` of a tier at a time, until no tier has as many; returns the number of merges."""
        merged = 0
        while True:
            version, held = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in held:
                tiers.setdefault(int(math.log(max(s["texts"], 1), self.fan)), []).append(s)
            due = next((t for _, t in sorted(tiers.items()) if len(t) >= self.fan), None)
            if due is None:
                return merged
            with shuffles_dropped(self.spark):
                entry = self._merged(due)
            names = {s["name"] for s in due}
            # Only if all of them are as they were: a tombstone set meanwhile would be lost
            if self._commit(version, [*(s for s in held if s["name"] not in names), entry]):
                merged += 1

    def _merged(self, due: list[dict]) -> dict:
        segment, names = uuid4().hex, [s["name"] for s in due if s["texts"]]
        entry = {"name": segment, "texts": sum(s["texts"] for s in due), "tokens": sum(s["tokens"] for s in due), "dead": [], "files": [f for s in due for f in s["files"]]}
        if not names:
            return entry
        texts = self._texts(names)
        if (dead := self._dead(due)) is not None:
            texts = texts.join(dead.select("segment", *self.key), ["segment", *self.key], "left_anti")
        # Spans of up to half of SPAN, shortest texts first, go together by the half that they begin in
        sizes = texts.groupBy("segment", "span").agg(F.count("*").alias("n"), F.min("dl").alias("dl"))
        sizes = sizes.repartitionByRange("dl", "segment", "span").sortWithinPartitions("dl", "segment", "span").withColumn("part", F.spark_partition_id())
        order = Window.partitionBy("part").orderBy("dl", "segment", "span")
        begins = F.coalesce(F.sum(F.when(F.col("n") * 2 <= SPAN, F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        together = F.col("n") * 2 <= SPAN
        to = F.when(together, F.floor(begins * 2 / SPAN)).otherwise(F.row_number().over(order) + (1 << 31))
        spans = materialize(sizes.select("segment", "span", (F.shiftleft(F.col("part").cast("bigint"), 32) + to).alias("to"), together.alias("together")), "spans")
        texts.join(spans, ["segment", "span"]).select(*self.key, "dl", F.col("to").alias("span")).write.option("compression", "zstd").parquet(self._path(segment, "texts"))
        # Some folders at a time; spans that stay as they are need no grouping
        slices = min(BUCKETS, math.ceil((entry["tokens"] + 1) / SLICE))
        for k in range(slices):
            rows = self._live(self._postings(names).where(F.col("bucket").isin(list(range(k, BUCKETS, slices)))), due).join(spans, ["segment", "span"])
            grouped = materialize(rows.where("together").groupBy("term", F.col("to").alias("span")).agg(F.flatten(F.collect_list("hits")).alias("hits")), "grouped")
            self._write(rows.where("NOT together").select("term", F.col("to").alias("span"), "hits").unionByName(grouped), segment)
            discard(grouped)
        discard(spans)
        return entry

    def vacuum(self) -> int:
        """Delete segments and tombstones that the newest commit does not name; returns how many. Readers of older commits must be done, and no writer at work."""
        held = self.manifest()[1]
        used = {s["name"] for s in held} | {d for s in held for d in s["dead"]}
        gone = [f"{self.name}/{kind}/{n}" for kind in ("texts", "postings", "dead") for n in self.store._names(f"{self.name}/{kind}") if n.removeprefix("segment=") not in used]
        for n in gone:
            self.store._fs().delete(self.store._path(f"{self.store.root}/{n}"), True)
        return len(gone)

    # Reading

    def _texts(self, names: list[str]) -> DataFrame:
        """(key columns, dl, span, segment) of segments, tombstones or not."""
        return self.spark.read.schema(f"{self.key_type}, dl int, span bigint, segment string").option("basePath", f"{self.store.root}/{self.name}/texts").parquet(*(self._path(s, "texts") for s in names))

    def _named(self, rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), rf"/{kind}/segment=([0-9a-f]+)/", 1))

    def _postings(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", f"{self.store.root}/{self.name}/postings").parquet(*(self._path(s, "postings") for s in names))

    def _dead(self, held: list[dict]) -> DataFrame | None:
        """(segment, span, key columns) of the tombstones on some segments."""
        folders = sorted({d for s in held for d in s["dead"]})
        if not folders:
            return None
        rows = self.spark.read.schema(f"{self.key_type}, dl int, span bigint, segment string").parquet(*(f"{self.store.root}/{self.name}/dead/{d}/texts" for d in folders))
        return rows.where(F.col("segment").isin([s["name"] for s in held])).select("segment", "span", *self.key)

    def _live(self, rows: DataFrame, held: list[dict]) -> DataFrame:
        """Postings without the texts that have tombstones."""
        dead = self._dead(held)
        if dead is None:
            return rows
        gone = dead.groupBy("segment", "span").agg(F.collect_list(F.struct(*self.key)).alias("gone"))  # SPAN at most
        rows = rows.join(gone, ["segment", "span"], "left")
        held_hits = F.filter("hits", lambda h: ~F.coalesce(F.array_contains("gone", F.struct(*(h[k].alias(k) for k in self.key))), F.lit(False)))
        return rows.withColumn("hits", F.when(F.col("gone").isNull(), F.col("hits")).otherwise(held_hits)).where(F.size("hits") > 0)

    def _exploded(self, rows: DataFrame) -> DataFrame:
        return rows.select("bucket", "term", F.explode("hits").alias("h")).select("bucket", "term", *(F.col(f"h.{c}").alias(c) for c in (*self.key, "tf", "dl", "positions")))

    def sizes(self, held: list[dict] | None = None) -> tuple[int, float]:
        """Number and mean length of the live texts, from the commit alone."""
        held = self.manifest()[1] if held is None else held
        texts = sum(s["texts"] for s in held)
        return texts, sum(s["tokens"] for s in held) / texts if texts else 0.0

    def index(self) -> Index:
        """For `search.bm25`: postings as they are read, and the corpus's size and mean length."""
        held = self.manifest()[1]
        names = [s["name"] for s in held if s["texts"]]
        none = self.spark.createDataFrame([], f"bucket int, term string, {self.key_type}, tf int, dl int, positions array<int>")
        rows = self._exploded(self._live(self._postings(names), held)) if names else none
        return Index(rows, None, self.key, [], self.stemmed, self.sizes(held), self)

    def best(self, query: str, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> DataFrame:
        """(key columns, score) of the `limit` texts that rank first among those that `keep` leaves; ties by key.

        Queries of plain words skip spans; others (prefixes, phrases of several
        words) rank all texts that fit.
        """
        self.read_rows = None
        order = ["score", *self.key]
        full = lambda: keep(search.bm25(self.index(), query)).orderBy(*order).limit(limit)
        tree = fts.parse(query)
        if tree is None:
            return full()
        every, ranked = fts.all_phrases(tree), fts.phrases(tree)
        held = self.manifest()[1]
        names = [s["name"] for s in held if s["texts"]]
        if not names or not ranked or any(p.prefix or len(p.terms) != 1 or p.column not in (None, "content", "name", "qualified_name", "text") for p in every):
            return full()
        term = lambda p: stem(p.terms[0]) if self.stemmed else p.terms[0]
        terms = sorted({term(p) for p in every})
        rows = self._postings(names).where(F.col("bucket").isin(sorted({ord(t[0]) % BUCKETS for t in terms})) & F.col("term").isin(terms))
        # How many texts hold each term: of spans, less tombstones
        found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        folders = sorted({d for s in held for d in s["dead"]})
        if folders:
            dead = self.spark.read.schema("segment string, term string, n bigint").parquet(*(f"{self.store.root}/{self.name}/dead/{d}/terms" for d in folders))
            for r in dead.where(F.col("term").isin(terms) & F.col("segment").isin(names)).groupBy("term").agg(F.sum("n").alias("n")).collect():
                found[r["term"]] = found.get(r["term"], 0) - r["n"]
        docs, mean = self.sizes(held)
        weight = {t: max(search.idf(docs, found.get(t, 0)), search.LEAST_IDF) for t in terms}
        most = lambda t: F.max(F.when(F.col("term") == t, F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_dl") / mean))))
        bounds = rows.groupBy("segment", "span").agg(*(most(t).alias(f"b{k}") for k, t in enumerate(terms)))
        upper = sum((F.coalesce(F.col(f"b{terms.index(term(p))}"), F.lit(0.0)) * weight[term(p)] for p in ranked), F.lit(0.0)) * (1 + 1e-9)
        bounds = materialize(bounds.where(_may_fit(tree, lambda p: F.col(f"b{terms.index(term(p))}").isNotNull())).select("segment", "span", upper.alias("upper")), "bounds")
        seeds = bounds.orderBy(F.col("upper").desc(), "segment", "span").limit(SEEDS)
        scored = lambda spans: keep(self._scored(self._live(rows.join(F.broadcast(spans) if spans is seeds else spans, ["segment", "span"]), held), tree, term, weight, mean))
        first = materialize(scored(seeds.select("segment", "span")).orderBy(*order).limit(limit), "first")
        scores = [r["score"] for r in first.select("score").collect()]  # `limit` rows
        rest = bounds.join(F.broadcast(seeds.select("segment", "span")), ["segment", "span"], "left_anti")
        if len(scores) == limit:
            rest = rest.where(F.col("upper") >= -max(scores))
        rest = materialize(rest.select("segment", "span"), "rest")
        self.read_rows = lambda: (rows.join(seeds.unionByName(rest.withColumn("upper", F.lit(0.0))).select("segment", "span"), ["segment", "span"]).count(), rows.count())  # (rows read, rows of the terms)
        return first.unionByName(scored(rest)).orderBy(*order).limit(limit)

    def _scored(self, rows: DataFrame, tree: fts.Node, term: Callable, weight: dict[str, float], mean: float) -> DataFrame:
        """(key columns, score) of the texts of some postings that fit a query of plain words."""
        every, ranked = fts.all_phrases(tree), fts.phrases(tree)
        terms = sorted({term(p) for p in every})
        hits = self._exploded(rows).groupBy(*self.key).agg(F.first("dl").alias("dl"), *(F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"f{k}") for k, t in enumerate(terms)))
        frequency = lambda p: F.coalesce(F.col(f"f{terms.index(term(p))}"), F.lit(0)) if p.terms else F.lit(0)
        score = F.lit(0.0)
        for p in ranked:
            f = frequency(p)
            score = score + F.lit(weight[term(p)]) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / mean))
        return hits.where(fts.matches(tree, frequency)).select(*self.key, (-score).alias("score"))


def _may_fit(node: fts.Node, present: Callable[[fts.Phrase], Column]) -> Column:
    """Whether a span that holds some terms may hold a text that fits; what NOT excludes may be in other texts."""
    if node.phrase:
        return present(node.phrase) if node.phrase.terms else F.lit(False)
    if node.op == "not":
        return _may_fit(node.parts[0], present)
    out = _may_fit(node.parts[0], present)
    for p in node.parts[1:]:
        out = out | _may_fit(p, present) if node.op == "or" else out & _may_fit(p, present)
    return out


def of_projects(spark, projects: dict[str, str], folder: str) -> Index:
    """The stored turn indexes of several projects (project by database path) in one scan, each with its own statistics."""
    from loomstore.operators.snapshots import Store, with_project

    held = {db: Segments(Store(spark, db), folder, search.TURN, search.TURN_TYPE) for db in projects}
    manifests = {db: s.manifest()[1] for db, s in held.items()}
    sizes = spark.createDataFrame([(projects[db], *held[db].sizes(m)) for db, m in manifests.items()], "project_path string, docs bigint, avgdl double")
    paths = [held[db]._path(s["name"], "postings") for db, m in manifests.items() for s in m if s["texts"]]
    key = ["project_path", *search.TURN]
    schema = f"bucket int, term string, project_path string, {search.TURN_TYPE}, tf int, dl int, positions array<int>"
    if not paths:
        return Index(spark.createDataFrame([], schema), None, key, ["project_path"], True, sizes)
    any_one = next(iter(held.values()))
    # `bucket` is worked out, as folders of several roots have no common base
    rows = spark.read.schema(any_one.schema.rsplit(", bucket", 1)[0]).option("recursiveFileLookup", "true").parquet(*paths)
    rows = with_project(any_one._named(rows, "postings"), projects, f"{folder}/postings").withColumn("bucket", F.ascii("term") % BUCKETS)
    gone = None
    for db, m in manifests.items():
        if (dead := held[db]._dead(m)) is not None:
            gone = dead if gone is None else gone.unionByName(dead)
    if gone is not None:
        gone = gone.groupBy("segment", "span").agg(F.collect_list(F.struct(*search.TURN)).alias("gone"))
        rows = rows.join(gone, ["segment", "span"], "left").withColumn("hits", F.filter("hits", lambda h: ~F.coalesce(F.array_contains("gone", F.struct(*(h[k].alias(k) for k in search.TURN))), F.lit(False))))
    rows = rows.select("bucket", "term", "project_path", F.explode("hits").alias("h")).select("bucket", "term", "project_path", *(F.col(f"h.{c}").alias(c) for c in (*search.TURN, "tf", "dl", "positions")))
    return Index(rows, None, key, ["project_path"], True, sizes)
