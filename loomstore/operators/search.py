"""Ranked full-text search over stored postings, and the hybrid search over graph, chat and files.

An index gives postings: a row for each term and text, with the term's positions.
Stored ones lie in segments (see `segments`), in folders by the term's first
character and in the order of terms.  A search reads the rows of its own terms
only: folders are pruned by the bucket, row groups by the term.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions import fts
from loomstore.functions.stem import stem, stems
from loomstore.functions.text import basename, contains_ignoring_case, one_line, recency, tokens

if TYPE_CHECKING:
    from loomstore.operators.segments import Segments

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Folders of a stored index; a term's is the code of its first character modulo this.
BUCKETS = 64


def indexed(rows: DataFrame, text: Column, stemmed: bool = False) -> DataFrame:
    """`rows` with their tokens and number of tokens."""
    found = tokens(text)
    rows = rows.withColumn("tokens", stems(found) if stemmed else found)
    return rows.withColumn("dl", F.size("tokens"))


def build_postings(rows: DataFrame, *key: str) -> DataFrame:
    """(bucket, term, key columns, tf, dl, positions) of rows of `indexed`."""
    words = rows.select(*key, "dl", F.posexplode("tokens").alias("at", "term"))
    found = words.groupBy("term", *key).agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("at")).alias("positions"))
    return found.withColumn("bucket", F.ascii("term") % BUCKETS)


def missing_from_index(rows: DataFrame, index: DataFrame, *key: str) -> DataFrame:
    known = index.select(*key).distinct()
    for k in key:
        known = known.where(F.col(k).isNotNull())
    return rows.join(known, list(key), "left_anti")


@dataclass
class Index:
    """Postings, and the texts held (key columns, dl) or their number and mean length; `by` names columns of the key that have statistics of their own."""

    postings: DataFrame
    texts: DataFrame | None
    key: list[str]
    by: list[str]
    stemmed: bool
    #: (number, mean length) of the texts, or with `by` a table of its columns, docs and avgdl.
    known: tuple[int, float] | DataFrame | None = None
    #: The stored segments that the postings are of.
    segments: Segments | None = None

    @classmethod
    def of(cls, rows: DataFrame, key: list[str], text: Column, stemmed: bool = False, by: list[str] | None = None) -> Index:
        """The index of `rows`, worked out as it is read."""
        ready = indexed(rows, text, stemmed)
        return cls(build_postings(ready, *key), ready.select(*key, "dl"), key, by or [], stemmed)

    def sizes(self) -> DataFrame | dict[str, float]:
        """docs and avgdl of all texts, or a row of them for each group of `by`."""
        if self.by:
            return self.known if self.known is not None else self.texts.groupBy(*self.by).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
        return dict(zip(("docs", "avgdl"), self.known)) if self.known else self.texts.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).first().asDict()

    def best(self, query: str, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> DataFrame:
        """(key columns, score) of the first `limit` texts that `keep` leaves."""
        if self.segments:
            return self.segments.best(query, limit, keep)
        return keep(bm25(self, query)).orderBy("score", *self.key).limit(limit)


def idf(docs: int, n: int) -> float:
    """How much a term tells that n of the texts hold."""
    return math.log((docs - n + 0.5) / (n + 0.5))


def _stemmed(node: fts.Node) -> fts.Node:
    if node.phrase:
        return fts.Node("phrase", phrase=fts.Phrase([stem(t) for t in node.phrase.terms], node.phrase.prefix, node.phrase.column))
    return fts.Node(node.op, [_stemmed(p) for p in node.parts])


def _followed(starts: Column, following: Column, after: int) -> Column:
    """The starts that have one of the following positions so many tokens on."""
    return F.filter(starts, lambda x: F.array_contains(following, x + after))


def bm25(index: Index, query: str) -> DataFrame:
    """(key columns, score) of the texts of an index that fit the query; scores are below 0, and the smaller the better.

    Only the postings of the query's terms are read and grouped by text.  The
    corpus's size and mean length come from the lengths of the texts held: of all,
    or for each group of `by` (so projects are ranked by their own statistics).
    A blank query finds nothing.
    """
    none = index.postings.where(F.lit(False)).select(*index.key, F.lit(0.0).alias("score"))
    tree = fts.parse(query)
    if tree is None:
        return none
    if index.stemmed:
        tree = _stemmed(tree)
    ranked = fts.phrases(tree)
    for p in ranked:
        if p.column not in (None, "content", "name", "qualified_name", "text"):
            raise ValueError(f"full-text query: no column {p.column!r}")
    every = fts.all_phrases(tree)
    wanted = sorted({(t, p.prefix and k == len(p.terms) - 1) for p in every for k, t in enumerate(p.terms)})
    if not ranked:
        return none
    fits = [(F.col("bucket") == ord(t[0]) % BUCKETS) & (F.col("term").startswith(t) if prefix else F.col("term") == t) for t, prefix in wanted]
    any_fits = fits[0]
    for f in fits[1:]:
        any_fits = any_fits | f
    rows = index.postings.where(F.col("bucket").isin(sorted({ord(t[0]) % BUCKETS for t, _ in wanted}))).where(any_fits)
    places = [F.array_distinct(F.flatten(F.collect_list(F.when(f, F.col("positions"))))).alias(f"p{k}") for k, f in enumerate(fits)]
    rows = rows.groupBy(*index.key).agg(F.first("dl").alias("dl"), *places)
    names = {}
    for k, p in enumerate(every):
        at = [F.col(f"p{wanted.index((t, p.prefix and j == len(p.terms) - 1))}") for j, t in enumerate(p.terms)]
        starts = at[0]
        for j, following in enumerate(at[1:], 1):
            starts = _followed(starts, following, j)
        rows = rows.withColumn(f"f{k}", F.size(starts))
        names[id(p)] = f"f{k}"
    counts = [F.count_if(F.col(names[id(p)]) > 0).alias(f"n{k}") for k, p in enumerate(ranked)]
    found = rows.where(fts.matches(tree, lambda p: F.col(names[id(p)]) if p.terms else F.lit(0)))
    if index.by:
        found = found.join(rows.groupBy(*index.by).agg(*counts), index.by).join(index.sizes(), index.by)
    else:
        for row in (rows.agg(*counts).first().asDict(), index.sizes()):
            found = found.withColumns({name: F.lit(value) for name, value in row.items()})
    score = F.lit(0.0)
    for k, p in enumerate(ranked):
        n, f = F.col(f"n{k}"), F.col(names[id(p)])
        idf = F.ln((F.col("docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.select(*index.key, (-score).alias("score"))


TURN, NODE = ["session_id", "turn_index"], ["qualified_name"]
TURN_TYPE, NODE_TYPE = "session_id string, turn_index int", "qualified_name string"


def turn_index(turns: DataFrame, stemmed: bool = True, by: list[str] | None = None) -> Index:
    return Index.of(turns, [*(by or []), *TURN], F.col("content"), stemmed, by)


def node_index(nodes: DataFrame, stemmed: bool = True) -> Index:
    return Index.of(nodes, NODE, F.concat_ws(" ", "name", "qualified_name"), stemmed)


def _fetched(hits: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Hits (a limited number) with the columns of their rows."""
    return rows.join(F.broadcast(hits), key)


def search_turns(turns: DataFrame, sessions: DataFrame, query: str, session_id: str | None = None, thread_id: str | None = None, source_tool: str | None = None, limit: int = 5, stemmed: bool = True, index: Index | None = None) -> DataFrame:
    """The best turns with their session's LLM, tool and thread. Filters restrict the hits, not the statistics."""
    known = sessions.select(F.col("id").alias("session_id"), "llm_name", "source_tool", "thread_id")
    if session_id:
        known = known.where(F.col("session_id") == session_id)
    if thread_id:
        known = known.where(F.col("thread_id") == thread_id)
    if source_tool:
        known = known.where((F.col("source_tool") == source_tool) | (F.col("llm_name") == source_tool))
    hits = (index or turn_index(turns, stemmed)).best(query, limit, lambda hits: hits.join(known, "session_id"))
    return _fetched(hits, turns, TURN).orderBy("score", *TURN)


def search_nodes(nodes: DataFrame, query: str, limit: int = 20, stemmed: bool = True, index: Index | None = None) -> DataFrame:
    """Graph nodes by full text over both names; by parts of names if that finds none or cannot be read."""
    try:
        hits = (index or node_index(nodes, stemmed)).best(fts.words_query(query) or "", limit).collect()  # `limit` rows
        if hits:
            return _fetched(nodes.sparkSession.createDataFrame(hits, f"{NODE_TYPE}, score double"), nodes, NODE).orderBy("score", *NODE)
    except ValueError:
        pass
    fits = F.lit(True)
    for word in query.split():
        fits = fits & (contains_ignoring_case(F.col("name"), word) | contains_ignoring_case(F.col("qualified_name"), word))
    return nodes.withColumn("score", F.lit(0.0)).where(fits).orderBy("qualified_name").limit(limit)


def combined(relevance: Column, freshness: Column) -> Column:
    return relevance * (1.0 + 0.5 * freshness)


def relevance(score: Column, mode: str) -> Column:
    """compat: 1 for every full-text hit, since its score is below 0. bm25: from 0 to 1 with the score's size."""
    return F.lit(1.0) if mode == "compat" else -score / (1.0 - score)


def _top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


HIT = ["source", "key", "title", "snippet", "path", "score", "ts"]


def unified_find(query: str, now: Column, nodes: DataFrame | None = None, turns: DataFrame | None = None, files: DataFrame | None = None, limit: int = 20, mode: str = "compat", stemmed: bool = False, per_source: int | None = None, nodes_index: Index | None = None, turns_index: Index | None = None) -> DataFrame:
    """(HIT): the best of each source by its own rank, merged by score, one row for each thing.

    nodes need qualified_name, name, kind, file_path, updated_at; turns session_id,
    turn_index, role, content, recorded_at; files path, purpose, last_modified.
    """
    given = [x for x in (nodes, turns, files) if x is not None]
    k = per_source or max(5, math.ceil(limit * 1.5 / max(1, len(given))))
    words = fts.words_query(query)
    parts: list[DataFrame] = []
    if nodes is not None:
        if words:
            hits = (nodes_index or node_index(nodes, stemmed)).best(words, k)
            hits = _fetched(hits, nodes, NODE).withColumn("rank", relevance(F.col("score"), mode))
        else:
            hits = _top(nodes.where(contains_ignoring_case(F.col("name"), query) | contains_ignoring_case(F.col("qualified_name"), query)), [F.col("qualified_name")], k).withColumn("rank", F.lit(0.3))
        parts.append(hits.select(F.lit("graph").alias("source"), F.col("qualified_name").alias("key"), F.concat_ws(" ", "kind", "name").alias("title"), F.col("qualified_name").alias("snippet"), F.col("file_path").alias("path"), combined(F.col("rank"), recency(F.col("updated_at"), now)).alias("score"), F.col("updated_at").alias("ts")))
    if turns is not None and words:
        hits = _fetched((turns_index or turn_index(turns, stemmed)).best(words, k), turns, TURN)
        text = one_line(F.col("content"))
        cut = lambda n, mark: F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)
        parts.append(hits.select(F.lit("chat").alias("source"), F.concat_ws(":", "session_id", "turn_index").alias("key"), F.concat(F.col("role"), F.lit(": "), F.substring(text, 1, 80)).alias("title"), cut(220, "…").alias("snippet"), F.lit(None).cast("string").alias("path"), combined(relevance(F.col("score"), mode), recency(F.col("recorded_at"), now)).alias("score"), F.col("recorded_at").alias("ts")))
    if files is not None:
        hits = _top(files.where(contains_ignoring_case(F.col("path"), query)), [F.col("last_modified").desc(), F.col("path")], k)
        base = F.when(contains_ignoring_case(basename(F.col("path")), query), 0.9).otherwise(0.4)
        parts.append(hits.select(F.lit("file").alias("source"), F.col("path").alias("key"), F.col("path").alias("title"), F.coalesce("purpose", F.lit("")).alias("snippet"), "path", combined(base, recency(F.col("last_modified"), now)).alias("score"), F.col("last_modified").alias("ts")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = Window.partitionBy("source", "key").orderBy(F.col("score").desc(), "title")  # at most k rows a source
    rows = rows.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    return rows.orderBy(F.col("score").desc(), "source", "key").limit(limit)


def search_projects(turns: DataFrame, query: str, limit: int = 20, stemmed: bool = False, project: str = "project_path", index: Index | None = None) -> DataFrame:
    """Each project's best turns by its own statistics, merged by score as they are."""
    hits = bm25(index or turn_index(turns, stemmed, [project]), query)
    place = F.row_number().over(Window.partitionBy(project).orderBy("score", *TURN))  # each task keeps `limit` rows a project before they meet
    order = ["score", project, *TURN]
    hits = hits.withColumn("place", place).where(F.col("place") <= limit).drop("place").orderBy(*order).limit(limit)
    return _fetched(hits, turns, [project, *TURN]).orderBy(*order)


def mentions(files: DataFrame, turns: DataFrame, files_most: int = 10, each: int = 3, index: Index | None = None) -> DataFrame:
    """(path, session_id, turn_index): turns that mention the base name of the first files as a phrase, the newest of each.

    With an index only its postings are read, and times of the turns that are hit.
    """
    paths = files.select("path").distinct().orderBy("path").limit(files_most)
    if index is not None:
        hits = None
        for r in paths.select("path", basename(F.col("path")).alias("name")).collect():  # files_most rows
            one = bm25(index, '"' + r["name"].replace('"', " ") + '"').select(F.lit(r["path"]).alias("path"), *TURN)
            hits = one if hits is None else hits.unionByName(one)
        if hits is None:
            return paths.limit(0).join(turns.select(*TURN), F.lit(True)).select("path", *TURN)
        hits = hits.join(turns.select(*TURN, "recorded_at"), TURN)
        place = F.row_number().over(Window.partitionBy("path").orderBy(F.col("recorded_at").desc(), "session_id", F.col("turn_index").desc()))
        return hits.withColumn("place", place).where(F.col("place") <= each).select("path", *TURN)
    terms = paths.withColumn("terms", tokens(basename(F.col("path")))).where(F.size("terms") > 0)
    text = indexed(turns, F.col("content")).withColumn("joined", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")))
    hits = text.join(F.broadcast(terms), F.col("joined").contains(F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" "))))  # files_most rows
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.col("recorded_at").desc(), "session_id", F.col("turn_index").desc()))
    return hits.withColumn("place", place).where(F.col("place") <= each).select("path", "session_id", "turn_index")
