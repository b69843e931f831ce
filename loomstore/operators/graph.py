"""The code graph: walks, neighbourhoods, gaps, figures.

Nodes are named by qualified_name; edges may end in names that have no node.
Walks are frontier joins, a hop at a time, whose rings are written to the shared
folder: no loop over rows on the driver, no collected node sets, no plan that
repeats the hops before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions.text import last_name
from loomstore.plans.shared import materialize


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): the least number of hops, in either direction, from the seeds (node).

    Edges are written out once in both directions, and each hop's ring after it, so a hop is
    one pass over the edges, whatever came before.
    """
    ends = edges.select(F.col("source_qualified").alias("node"), F.col("target_qualified").alias("other"))
    ends = materialize(ends.union(ends.select("other", "node")).distinct(), "ends")
    rings = [materialize(seeds.select("node").distinct(), "ring")]
    reached = rings[0].withColumn("depth", F.lit(0))
    for hop in range(1, depth + 1):
        touched = ends.join(rings[-1], "node", "left_semi").select(F.col("other").alias("node")).distinct()
        ring = materialize(touched.join(reached, "node", "left_anti"), "ring")
        if ring.isEmpty():
            break
        rings.append(ring)
        reached = reached.union(ring.withColumn("depth", F.lit(hop)))
    return reached


def impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3, most: int = 500) -> DataFrame:
    """Nodes that changed files (path) can affect: qualified_name, file_path, kind, depth, truncated; at most `most`, the nearest first.

    Seeds are the nodes of the changed files; what is reached and is a node counts.
    """
    seeds = nodes.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(F.col("qualified_name").alias("node"))
    found = reach(edges, seeds, depth).where("depth > 0")
    rows = nodes.join(found, nodes["qualified_name"] == found["node"]).select("qualified_name", "file_path", "kind", "depth")
    top = rows.orderBy("depth", "qualified_name").limit(most + 1)
    place = F.row_number().over(Window.orderBy("depth", "qualified_name"))  # over most + 1 rows
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("place", place).withColumn("truncated", n > most).where(F.col("place") <= most).drop("place")


def impacted_files(impacted: DataFrame) -> DataFrame:
    return impacted.select("file_path").where("file_path is not null").distinct().orderBy("file_path")


def edges_among(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends among the names (node)."""
    ends = names.select("node").distinct()
    rows = edges.join(ends.withColumnRenamed("node", "source_qualified"), "source_qualified", "left_semi")
    return rows.join(ends.withColumnRenamed("node", "target_qualified"), "target_qualified", "left_semi").select(*edges.columns)


def edges_touching(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with either end among the names: two equi-joins, so no OR join."""
    ends = names.select("node").distinct()
    a = edges.join(ends, F.col("source_qualified") == F.col("node"), "left_semi")
    b = edges.join(ends, F.col("target_qualified") == F.col("node"), "left_semi")
    rest = b.join(ends, F.col("source_qualified") == F.col("node"), "left_anti")
    return a.unionByName(rest)


def session_scope(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the touched files (path), and edges with either end among them."""
    scope = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    return scope, edges_touching(edges, scope.select(F.col("qualified_name").alias("node")))


def test_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no test points to; files and tests need none."""
    tested = edges.where("kind = 'TESTED_BY'").select(F.col("target_qualified").alias("qualified_name"))
    return nodes.where(~F.col("kind").isin("File", "Test") & ~F.coalesce("is_test", F.lit(False))).join(tested, "qualified_name", "left_anti")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and edges by kind, languages, files."""
    part = lambda df, what, c: df.groupBy(F.col(c).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return part(nodes, "node", "kind").unionByName(part(edges, "edge", "kind")).unionByName(part(nodes.where("language is not null and language <> ''"), "language", "language"))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at each name; a loop counts twice."""
    return edges.select(F.explode(F.array("source_qualified", "target_qualified")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


# What an overlay shows first.
STATES = ["locked", "hot", "blast", "warm", "cold"]


def overlay(nodes: DataFrame, locked: DataFrame, hot: DataFrame, blast: DataFrame) -> DataFrame:
    """Nodes with `state`: by file for locked and hot (file_path), by name for blast (qualified_name), else cold."""
    rows = nodes
    for name, df, key in (("is_locked", locked, "file_path"), ("is_hot", hot, "file_path"), ("is_blast", blast, "qualified_name")):
        rows = rows.join(df.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    state = F.when(F.col("is_locked"), "locked").when(F.col("is_hot"), "hot").when(F.col("is_blast"), "blast").otherwise("cold")
    return rows.withColumn("state", state).drop("is_locked", "is_hot", "is_blast")


def state_histogram(states: DataFrame) -> DataFrame:
    """(state, n) for every state, those without nodes too."""
    n = states.groupBy("state").agg(F.count("*").alias("n"))
    every = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def resolve_name(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that qualified name, else the file node of that path, else the only node of that bare name."""
    exact = nodes.where(F.col("qualified_name") == name).withColumn("how", F.lit(0))
    file = nodes.where((F.col("file_path") == name) & (F.col("kind") == "File")).withColumn("how", F.lit(1))
    bare = nodes.where(F.col("name") == name).withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n = 1").drop("n").withColumn("how", F.lit(2))
    return exact.unionByName(file).unionByName(bare).orderBy("how", "qualified_name").limit(1).drop("how")


def neighbours(nodes: DataFrame, edges: DataFrame, centre: str, hops: int = 1, each_side: int = 50, siblings: int = 30, second: int = 80) -> DataFrame:
    """(role, kind, other, hop): edges out and in of a name, its siblings in the file, and what first neighbours point to."""
    out = edges.where(F.col("source_qualified") == centre).select(F.lit("out").alias("role"), "kind", F.col("target_qualified").alias("other")).distinct().orderBy("kind", "other").limit(each_side)
    into = edges.where(F.col("target_qualified") == centre).select(F.lit("in").alias("role"), "kind", F.col("source_qualified").alias("other")).distinct().orderBy("kind", "other").limit(each_side)
    first = out.unionByName(into)
    own = nodes.where(F.col("qualified_name") == centre).select("file_path", F.col("parent_name").alias("own_parent"))
    beside = nodes.join(F.broadcast(own.limit(1)), "file_path").where(F.col("parent_name").eqNullSafe(F.col("own_parent")) & (F.col("qualified_name") != centre) & (F.col("kind") != "File"))
    beside = beside.select(F.lit("sibling").alias("role"), "kind", F.col("qualified_name").alias("other")).orderBy("other").limit(siblings)
    rows = first.unionByName(beside).withColumn("hop", F.lit(1))
    if hops > 1:
        ring = first.select(F.col("other").alias("node")).distinct()
        far = edges.join(ring, F.col("source_qualified") == F.col("node"), "left_semi").select("kind", F.col("target_qualified").alias("other")).where(F.col("other") != centre)
        far = far.distinct().join(ring, F.col("other") == F.col("node"), "left_anti").orderBy("other", "kind").limit(second)
        rows = rows.unionByName(far.select(F.lit("second").alias("role"), "kind", "other", F.lit(2).alias("hop")))
    return rows


def subtree(edges: DataFrame, root: str, depth: int = 8, most: int | None = 500) -> DataFrame:
    """(node, parent, depth) along CONTAINS edges; of several parents on one level the first by name."""
    links = edges.where("kind = 'CONTAINS'").select(F.col("source_qualified").alias("parent"), F.col("target_qualified").alias("node"))
    found = links.sparkSession.createDataFrame([(root, None, 0)], "node string, parent string, depth int")
    for hop in range(1, depth + 1):
        edge = found.where(F.col("depth") == hop - 1).select(F.col("node").alias("parent"))
        step = links.join(edge, "parent", "left_semi").groupBy("node").agg(F.min("parent").alias("parent")).withColumn("depth", F.lit(hop))
        step = materialize(step.join(found, "node", "left_anti"), "level")
        if step.isEmpty():
            break
        found = found.unionByName(step)
    return found.orderBy("depth", "node").limit(most) if most else found


def tree(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 8, most: int | None = 500) -> DataFrame:
    """(node, parent, depth, name, line, place) along CONTAINS edges, in preorder: under each parent by line and name.

    `place` holds the (line, name, node) of all nodes from the root down, so the
    whole order is one sort.  A node hangs where it is reached first; of several
    parents on one level under the first in that order.
    """
    known = nodes.groupBy(F.col("qualified_name").alias("node")).agg(F.min(F.struct(F.coalesce(F.col("line_start").cast("int"), F.lit(0)).alias("line"), F.coalesce("name", "qualified_name").alias("name"))).alias("n"))
    links = edges.where("kind = 'CONTAINS'").select(F.col("source_qualified").alias("parent"), F.col("target_qualified").alias("node")).distinct()
    links = links.join(known, "node", "left").select("parent", "node", F.coalesce("n.line", F.lit(0)).alias("line"), F.coalesce("n.name", "node").alias("name"))
    found = links.sparkSession.createDataFrame([(root, None, 0, root, 0, [])], "node string, parent string, depth int, name string, line int, place array<struct<line: int, name: string, node: string>>")
    for hop in range(1, depth + 1):
        above = found.where(F.col("depth") == hop - 1).select(F.col("node").alias("parent"), F.col("place").alias("above"))
        step = links.join(above, "parent").withColumn("place", F.concat("above", F.array(F.struct("line", "name", "node"))))
        step = step.groupBy("node").agg(F.min(F.struct("place", "parent", "name", "line")).alias("s")).join(found.select("node"), "node", "left_anti")
        step = materialize(step.select("node", "s.parent", F.lit(hop).alias("depth"), "s.name", "s.line", "s.place"), "level")
        if step.isEmpty():
            break
        found = found.unionByName(step)
    return found.orderBy("place").limit(most) if most else found


def resolve_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CALLS edges whose bare target is the name of exactly one function point to it; others stay as they are."""
    unique = nodes.where("kind in ('Function', 'Test')").groupBy(F.col("name").alias("target_qualified")).agg(F.count("*").alias("n"), F.min("qualified_name").alias("resolved")).where("n = 1").drop("n")
    rows = edges.join(unique, "target_qualified", "left")
    return rows.withColumn("target_qualified", F.when(F.col("kind") == "CALLS", F.coalesce("resolved", "target_qualified")).otherwise(F.col("target_qualified"))).drop("resolved").select(*edges.columns)


def signature(nodes: DataFrame) -> DataFrame:
    """Adds `signature`: kind name params -> return [test]."""
    arrow = F.when(F.col("return_type").isNotNull() & (F.col("return_type") != ""), F.concat(F.lit("-> "), "return_type"))
    name = F.concat("name", F.coalesce("params", F.lit("")))
    return nodes.withColumn("signature", F.concat_ws(" ", "kind", name, arrow, F.when(F.col("is_test"), F.lit("[test]"))))


def compact_context(nodes: DataFrame, edges: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Signatures by file, and the first edges as lines of last names."""
    by_file = signature(nodes.where("kind <> 'File'")).groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "signature"))), lambda x: x["signature"]).alias("signatures"))
    line = F.concat(last_name(F.col("source_qualified")), F.lit(" --"), "kind", F.lit("--> "), last_name(F.col("target_qualified")))
    lines = edges.withColumn("summary", line).select("summary", "source_qualified", "target_qualified", "kind").orderBy("source_qualified", "target_qualified", "kind").limit(most)
    return by_file, lines


def overview(nodes: DataFrame, files: DataFrame, each: int = 8) -> DataFrame:
    """Files with their first symbols by line and figures of the index where it has them."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "qualified_name"))
    top = nodes.where("kind <> 'File' and parent_name is null").withColumn("place", place).where(F.col("place") <= each)
    symbols = top.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind", "name"))), lambda x: F.concat_ws(" ", x["kind"], x["name"])).alias("symbols"))
    rows = nodes.where("kind = 'File'").join(symbols, "file_path", "left").join(files.select(F.col("path").alias("file_path"), F.nullif("line_count", F.lit(0)).alias("lines"), "purpose"), "file_path", "left")
    return rows.select("file_path", "language", F.coalesce("lines", "line_end").alias("lines"), "purpose", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def overview_totals(nodes: DataFrame, files: DataFrame, each: int = 8) -> DataFrame:
    """(files, symbols, languages) of the overview: symbols as shown, `each` a file at most; languages sorted."""
    shown = overview(nodes, files, each)
    return shown.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).cast("bigint").alias("symbols"), F.sort_array(F.collect_set("language")).alias("languages"))


def folder_counts(nodes: DataFrame) -> DataFrame:
    """(folder, n): how many files of the graph each folder holds itself."""
    folder = F.regexp_extract(F.col("file_path"), r"^(.*)/[^/]*$", 1)
    return nodes.where("kind = 'File'").groupBy(F.when(folder == "", ".").otherwise(folder).alias("folder")).agg(F.count("*").alias("n"))


def below(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes of the file or folder of that path."""
    folder = prefix.rstrip("/")
    return nodes.where((F.col("file_path") == folder) | F.col("file_path").startswith(folder + "/"))


def drawn(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, edge_kinds: list[str] | None = None, text: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes of the kinds whose name or path holds the text, and the edges of the kinds among them."""
    if kinds:
        nodes = nodes.where(F.col("kind").isin(kinds))
    if text:
        nodes = nodes.where(F.lower("name").contains(text.lower()) | F.lower("file_path").contains(text.lower()))
    if edge_kinds:
        edges = edges.where(F.col("kind").isin(edge_kinds))
    return nodes, edges_among(edges, nodes.select(F.col("qualified_name").alias("node")))
