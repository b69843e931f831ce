"""The file index: overview, search, history, folders; changes between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions.text import contains_ignoring_case, like_literal


def type_counts(files: DataFrame, limit: int | None = 20) -> DataFrame:
    rows = files.groupBy(F.coalesce("file_type", F.lit("other")).alias("file_type")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "file_type")
    return rows.limit(limit) if limit else rows


def purposes_by_type(files: DataFrame, n: int = 5) -> DataFrame:
    """(file_type, purposes): the first n purposes of each type by path, joined by a bar."""
    place = F.row_number().over(Window.partitionBy("file_type").orderBy("path"))
    top = files.where("purpose is not null and purpose <> ''").withColumn("place", place).where(F.col("place") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "purpose"))), lambda x: x["purpose"]), " | ")
    return top.groupBy("file_type").agg(joined.alias("purposes"))


def overview_counts(files: DataFrame, sessions: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """One row: files, active sessions, changes of the last day."""
    a = files.agg(F.count("*").alias("files"))
    b = sessions.agg(F.count_if(F.col("status") == "active").alias("active_sessions"))
    c = changes.agg(F.count_if(F.col("changed_at") >= now - F.expr("interval 24 hours")).alias("recent_changes"))
    one = F.lit(1).alias("one")
    return a.select(one, "*").join(b.select(one, "*"), "one").join(c.select(one, "*"), "one").drop("one")  # three single rows


def find_files(files: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Files whose path, purpose or tags contain the text; those whose path does come first, longer ones before shorter."""
    in_path = contains_ignoring_case(F.col("path"), text)
    hit = in_path | contains_ignoring_case(F.col("purpose"), text) | contains_ignoring_case(F.col("tags"), text)
    return files.where(hit).orderBy(F.when(in_path, 0).otherwise(1), F.col("line_count").desc(), "path").limit(limit)


def recent_changes(changes: DataFrame, sessions: DataFrame, limit: int = 20) -> DataFrame:
    """The newest changes with the LLM and task of their session, if any; sessions are read for the newest changes alone."""
    newest = changes.orderBy(F.col("changed_at").desc(), F.col("id").desc()).limit(limit)
    return newest.join(sessions.select(F.col("id").alias("session_id"), "llm_name", "working_on"), "session_id", "left").orderBy(F.col("changed_at").desc(), F.col("id").desc())


def file_info(files: DataFrame, path: str) -> DataFrame:
    """The file of that path, else the first whose path contains it."""
    exact = F.col("path") == path
    return files.where(exact | F.col("path").like(f"%{like_literal(path)}%")).orderBy(F.when(exact, 0).otherwise(1), "path").limit(1)


def file_history(changes: DataFrame, n: int = 10) -> DataFrame:
    """The newest n changes of each file."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.col("changed_at").desc(), F.col("id").desc()))
    return changes.withColumn("place", place).where(F.col("place") <= n).drop("place")


def folders(paths: DataFrame) -> DataFrame:
    """(folder, parent, depth, n): every folder above the paths with the number of files anywhere below."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    rows = paths.select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))
    depth = F.size(F.split("folder", "/"))
    return rows.select("folder", F.when(depth > 1, F.array_join(F.slice(F.split("folder", "/"), F.lit(1), depth - 1), "/")).otherwise("").alias("parent"), depth.alias("depth"), "n")


def export_files(files: DataFrame, most: int = 60) -> DataFrame:
    """Files with a purpose for the compact export."""
    return files.where("purpose is not null and purpose <> ''").orderBy("path").limit(most)


def changed(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "checksum") -> DataFrame:
    """Rows of `new` that `old` has not with the same mark: what must be parsed again."""
    return new.join(old.select(key, mark), [key, mark], "left_anti")


def removed(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def change_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change_type) between two snapshots: created, modified, deleted, and moved for a vanished file whose checksum reappears once."""
    a = old.select("path", F.col("checksum").alias("was"))
    b = new.select("path", F.col("checksum").alias("now"))
    both = a.join(b, "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    rows = both.withColumn("change_type", kind).where("change_type is not null")
    gone = rows.where("change_type = 'deleted'").groupBy("was").agg(F.min("path").alias("source"), F.count("*").alias("n")).where("n = 1").drop("n")
    came = rows.where("change_type = 'created'").groupBy("now").agg(F.min("path").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    moves = gone.join(came, gone["was"] == came["now"]).select("source", "target")
    rows = rows.select(F.col("path").alias("file_path"), "change_type").join(moves.select(F.col("target").alias("file_path"), F.lit(True).alias("moved")), "file_path", "left")
    return rows.select("file_path", F.when(F.col("moved"), "moved").otherwise(F.col("change_type")).alias("change_type"))


def staged_or_not(staged: DataFrame, unstaged: DataFrame) -> DataFrame:
    """(path): files changed in either state, each once."""
    return staged.select("path").union(unstaged.select("path")).where("path is not null and path <> ''").distinct()
