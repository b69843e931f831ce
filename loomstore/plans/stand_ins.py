"""The project tables, made from the driver's tables, for the registered queries; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 12:00:00"
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def _minutes(n):
    return F.timestamp_micros(F.unix_micros(F.lit(START).cast("timestamp")) + n * 60_000_000)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), F.floor(F.length("text") / 4).cast("int").alias("token_est"), F.col("turn").cast("int").alias("turn_index"), _minutes(F.col("conv_id") * 60 + F.col("turn")).alias("recorded_at"))


TURNS = f"turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, role, text AS content, CAST(length(text) // 4 AS INTEGER) AS token_est, CAST(turn AS INTEGER) AS turn_index, TIMESTAMP '{START}' + to_minutes(CAST(conv_id * 60 + turn AS BIGINT)) AS recorded_at FROM conversations)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session a conversation: thread conv_id % 10, three LLMs and three states in turn."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("conv_id") % len(xs) + 1).cast("int"))
    return ids.select(
        F.col("conv_id").cast("string").alias("id"), pick("claude", "cursor", "codex").alias("llm_name"), pick("active", "interrupted", "completed").alias("status"), pick("claude", "cursor", "codex").alias("source_tool"),
        F.concat(F.lit("t"), (F.col("conv_id") % 10).cast("string")).alias("thread_id"), _minutes(F.col("conv_id") * 60).alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), F.concat(F.lit("task "), "conv_id").alias("working_on"), F.lit(None).cast("string").alias("summary"),
    )


SESSIONS = f"""sessions AS (SELECT CAST(conv_id AS VARCHAR) AS id, ['claude', 'cursor', 'codex'][CAST(conv_id % 3 + 1 AS INTEGER)] AS llm_name, ['active', 'interrupted', 'completed'][CAST(conv_id % 3 + 1 AS INTEGER)] AS status, ['claude', 'cursor', 'codex'][CAST(conv_id % 3 + 1 AS INTEGER)] AS source_tool,
  't' || CAST(conv_id % 10 AS VARCHAR) AS thread_id, TIMESTAMP '{START}' + to_minutes(CAST(conv_id * 60 AS BIGINT)) AS started_at, 'task ' || conv_id AS working_on FROM (SELECT DISTINCT conv_id FROM conversations))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", F.concat_ws(".", "doc_id", "lang")).alias("path"), F.col("lang").alias("file_type"), F.size(F.split("text", "\n", -1)).alias("line_count"), F.col("n_chars").alias("size_bytes"), F.substring(F.split("text", "\n", -1)[0], 1, 60).alias("purpose"),
        F.lit(None).cast("string").alias("tags"), _minutes(F.col("doc_id")).alias("last_modified"), F.md5("text").alias("checksum"), "doc_id",
    )


FILES = f"""files AS (SELECT source || '/' || doc_id || '.' || lang AS path, lang AS file_type, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count, n_chars AS size_bytes, substring(string_split(text, chr(10))[1], 1, 60) AS purpose, CAST(NULL AS VARCHAR) AS tags,
  TIMESTAMP '{START}' + to_minutes(CAST(doc_id AS BIGINT)) AS last_modified, md5(text) AS checksum, doc_id FROM documents)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("file_path"), F.col("event_type").alias("change_type"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("changed_at"))


CHANGES = "changes AS (SELECT event_id AS id, 'f' || (props ->> '$.k') AS file_path, event_type AS change_type, CAST(user_id AS VARCHAR) AS session_id, ts AS changed_at FROM events)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as a code graph: a region is a file, nations are classes, customers functions, suppliers tests."""
    t = lambda n: table(spark, sf_dir, n)
    region = t("region").select(F.lit("File").alias("kind"), F.col("r_name").alias("name"), F.concat(F.lit("R::"), "r_regionkey").alias("qualified_name"), F.concat(F.lit("R"), "r_regionkey").alias("file_path"), F.lit(None).cast("string").alias("parent_name"))
    nation = t("nation").select(F.lit("Class").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("N::"), "n_nationkey").alias("qualified_name"), F.concat(F.lit("R"), "n_regionkey").alias("file_path"), F.lit(None).cast("string").alias("parent_name"))
    where = t("nation").select("n_nationkey", F.concat(F.lit("R"), "n_regionkey").alias("file_path"), F.col("n_name").alias("parent_name"))
    customer = t("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("Function").alias("kind"), F.col("c_name").alias("name"), F.concat(F.lit("C::"), "c_custkey").alias("qualified_name"), "file_path", "parent_name")
    supplier = t("supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("Test").alias("kind"), F.col("s_name").alias("name"), F.concat(F.lit("S::"), "s_suppkey").alias("qualified_name"), "file_path", "parent_name")
    return region.unionByName(nation).unionByName(customer).unionByName(supplier).withColumn("is_test", F.col("kind") == "Test")


NODES = """nodes AS (
  SELECT 'File' AS kind, r_name AS name, 'R::' || r_regionkey AS qualified_name, 'R' || r_regionkey AS file_path, CAST(NULL AS VARCHAR) AS parent_name, false AS is_test FROM region
  UNION ALL SELECT 'Class', n_name, 'N::' || n_nationkey, 'R' || n_regionkey, NULL, false FROM nation
  UNION ALL SELECT 'Function', c_name, 'C::' || c_custkey, 'R' || n_regionkey, n_name, false FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Test', s_name, 'S::' || s_suppkey, 'R' || n_regionkey, n_name, true FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONTAINS down the geography; orders CALL customers; every 7th customer is TESTED_BY one supplier, ten customers a supplier at most."""
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.alias("source_qualified"), b.alias("target_qualified"))
    name = lambda p, c: F.concat(F.lit(p + "::"), c)
    out = e(t("nation"), "CONTAINS", name("R", "n_regionkey"), name("N", "n_nationkey"))
    out = out.unionByName(e(t("customer"), "CONTAINS", name("N", "c_nationkey"), name("C", "c_custkey"))).unionByName(e(t("supplier"), "CONTAINS", name("N", "s_nationkey"), name("S", "s_suppkey")))
    out = out.unionByName(e(t("orders"), "CALLS", name("O", "o_orderkey"), name("C", "o_custkey")))
    tested = t("supplier").join(t("customer").where("c_custkey % 7 = 0"), F.col("s_suppkey") == F.expr("c_custkey div 70 + 1"))
    return out.unionByName(e(tested, "TESTED_BY", name("S", "s_suppkey"), name("C", "c_custkey")))


EDGES = """edges AS (
  SELECT 'CONTAINS' AS kind, 'R::' || n_regionkey AS source_qualified, 'N::' || n_nationkey AS target_qualified FROM nation
  UNION ALL SELECT 'CONTAINS', 'N::' || c_nationkey, 'C::' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'N::' || s_nationkey, 'S::' || s_suppkey FROM supplier
  UNION ALL SELECT 'CALLS', 'O::' || o_orderkey, 'C::' || o_custkey FROM orders
  UNION ALL SELECT 'TESTED_BY', 'S::' || s_suppkey, 'C::' || c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey // 70 + 1 WHERE c_custkey % 7 = 0)"""
