"""The registered queries, each with the SQL that DuckDB answers the same way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.functions import text as T
from loomstore.operators import budget, conversations, extract, files, graph, locks, search, snapshots
from loomstore.plans import stand_ins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


# Turns and sessions


@query(f"""WITH {S.TURNS} SELECT session_id, count(*) AS turn_count, CAST(sum(token_est) AS BIGINT) AS token_total, max(recorded_at) AS last_turn_at,
  arg_min(content, turn_index) FILTER (WHERE role = 'user') AS first_user_message FROM turns GROUP BY session_id""")
def session_rollup(spark, sf_dir):
    return conversations.turn_stats(S.turns(spark, sf_dir))


_BUDGET = "SELECT {0} FROM (SELECT *, sum(CASE WHEN token_est = 0 THEN length(content) // 4 ELSE token_est END) OVER (PARTITION BY {1} ORDER BY {2} ROWS UNBOUNDED PRECEDING) AS running FROM {3}) WHERE running <= {4}"


@query(f"WITH {S.TURNS} " + _BUDGET.format("session_id, turn_index, role, token_est", "session_id", "turn_index DESC", "turns", 200))
def budget_tail(spark, sf_dir):
    return budget.session_budget(S.turns(spark, sf_dir), 200).select("session_id", "turn_index", "role", "token_est")


@query(f"WITH {S.TURNS}, {S.SESSIONS} " + _BUDGET.format("thread_id, session_id, turn_index, token_est", "thread_id", "started_at DESC, session_id DESC, turn_index DESC", "(SELECT turns.*, thread_id, started_at FROM turns JOIN sessions ON session_id = id)", 500))
def thread_budget_tail(spark, sf_dir):
    s = S.sessions(spark, sf_dir).select(F.col("id").alias("session_id"), "thread_id", "started_at")
    return budget.thread_budget(S.turns(spark, sf_dir).join(s, "session_id"), 500).select("thread_id", "session_id", "turn_index", "token_est")


@query(f"WITH {S.TURNS} SELECT session_id, turn_index, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS r FROM turns) WHERE r <= 3")
def last_n_turns(spark, sf_dir):
    return budget.last_turns(S.turns(spark, sf_dir), 3).select("session_id", "turn_index", "role")


@query(f"WITH {S.TURNS} SELECT session_id, arg_max(content, turn_index) AS content, max(turn_index) AS turn_index FROM turns WHERE role = 'assistant' GROUP BY session_id")
def last_assistant_turn(spark, sf_dir):
    return budget.last_of_role(S.turns(spark, sf_dir))


@query(f"""WITH {S.TURNS}, {S.SESSIONS}, kept AS ({_BUDGET.format("session_id", "session_id", "turn_index DESC", "turns", 200)}), k AS (SELECT session_id, count(*) AS kept FROM kept GROUP BY 1)
SELECT t.session_id, t.total, coalesce(kept, 0) AS kept, t.total - coalesce(kept, 0) AS cut FROM (SELECT session_id, count(*) AS total FROM turns GROUP BY 1) t LEFT JOIN k USING (session_id)""")
def budget_truncation(spark, sf_dir):
    t = S.turns(spark, sf_dir)
    return budget.truncated(t, budget.session_budget(t, 200))


@query(f"""WITH {S.TURNS}, {S.SESSIONS}, a AS (SELECT session_id, count(*) AS turn_count, sum(token_est) AS token_total, max(recorded_at) AS last_turn_at FROM turns GROUP BY 1)
SELECT id, llm_name, status, turn_count, CAST(token_total AS BIGINT) AS token_total, last_turn_at FROM sessions JOIN a ON id = session_id WHERE source_tool = 'cursor' ORDER BY last_turn_at DESC, id LIMIT 50""")
def sessions_list(spark, sf_dir):
    rows = conversations.list_sessions(S.sessions(spark, sf_dir), S.turns(spark, sf_dir), source="cursor")
    return rows.select("id", "llm_name", "status", "turn_count", "token_total", "last_turn_at")


@query(f"""WITH {S.TURNS}, {S.SESSIONS}, chosen AS (SELECT id FROM sessions WHERE status IN ('active', 'interrupted') ORDER BY started_at DESC, id LIMIT 1)
{_BUDGET.format("session_id, turn_index, content", "session_id", "turn_index DESC", "(SELECT turns.* FROM turns JOIN chosen ON session_id = id)", 4000)}""")
def handoff_latest(spark, sf_dir):
    return conversations.handoff(S.sessions(spark, sf_dir), S.turns(spark, sf_dir), 4000).select("session_id", "turn_index", "content")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, count(c_custkey) AS session_count, max(TIMESTAMP '2024-01-01' + to_minutes(CAST(c_custkey AS BIGINT))) AS last_session_at FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 5 <> 0) ON n_nationkey = c_nationkey GROUP BY 1, 2")
def thread_list(spark, sf_dir):
    threads = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    sessions = S.table(spark, sf_dir, "customer").where("c_nationkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("thread_id"), S._minutes(F.col("c_custkey")).alias("started_at"))
    return conversations.threads_by_activity(threads, sessions).select("id", "title", "session_count", "last_session_at")


@query(f"""WITH {S.TURNS}, have AS (SELECT session_id, count(*) AS n FROM turns WHERE turn_index < 2 GROUP BY 1)
SELECT t.session_id, t.role, t.content, t.turn_index, greatest(1, CAST(length(t.content) // 4 AS INTEGER)) AS token_est FROM (SELECT session_id, role,
  regexp_replace(content, '\\b(api[_-]?key|token|secret|password|access[_-]?token)\\s*=\\s*([^\\s,;]+)', '\\1=[REDACTED]', 'gi') AS content, turn_index FROM turns) t LEFT JOIN have h USING (session_id) WHERE t.turn_index >= coalesce(n, 0)""")
def append_new_turns(spark, sf_dir):
    t = S.turns(spark, sf_dir)
    imported = t.select("session_id", F.col("turn_index").alias("pos"), "role", "content", F.lit(0).alias("token_est"))
    return conversations.append_tail(t.where("turn_index < 2"), imported).select("session_id", "role", "content", "turn_index", "token_est")


@query(f"""WITH {S.TURNS}, h AS (SELECT session_id, count(*) AS have FROM turns WHERE turn_index < 2 AND CAST(session_id AS BIGINT) % 3 > 0 GROUP BY 1), p AS (SELECT session_id, count(*) AS n FROM turns GROUP BY 1)
SELECT count(*) FILTER (WHERE have IS NULL) AS imported, count(*) FILTER (WHERE have IS NOT NULL AND n > have) AS updated, CAST(sum(greatest(0, n - coalesce(have, 0))) AS BIGINT) AS inserted, CAST(sum(n - greatest(0, n - coalesce(have, 0))) AS BIGINT) AS skipped FROM p LEFT JOIN h USING (session_id)""")
def import_summary(spark, sf_dir):
    t = S.turns(spark, sf_dir)
    return conversations.import_summary(t.where("turn_index < 2 and cast(session_id as bigint) % 3 > 0"), t)


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ingest_once(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", "lang").join(S.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


# Files


@query("SELECT lang AS file_type, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 20")
def file_type_counts(spark, sf_dir):
    return files.type_counts(S.files(spark, sf_dir))


@query(f"WITH {S.FILES} SELECT file_type, string_agg(purpose, ' | ' ORDER BY r) AS purposes FROM (SELECT *, row_number() OVER (PARTITION BY file_type ORDER BY path) AS r FROM files WHERE purpose <> '') WHERE r <= 5 GROUP BY file_type")
def purposes_topk_per_type(spark, sf_dir):
    return files.purposes_by_type(S.files(spark, sf_dir))


@query(f"WITH {S.FILES} SELECT path, line_count, purpose FROM files WHERE path ILIKE '%src1%' OR purpose ILIKE '%src1%' OR tags ILIKE '%src1%' ORDER BY CASE WHEN path ILIKE '%src1%' THEN 0 ELSE 1 END, line_count DESC, path LIMIT 50")
def find_files_like(spark, sf_dir):
    return files.find_files(S.files(spark, sf_dir), "SRC1").select("path", "line_count", "purpose")


@query(f"WITH {S.FILES} SELECT path, line_count FROM files WHERE path = '12.en' OR path LIKE '%12.en%' ORDER BY CASE WHEN path = '12.en' THEN 0 ELSE 1 END, path LIMIT 1")
def file_info_exact_or_partial(spark, sf_dir):
    return files.file_info(S.files(spark, sf_dir), "12.en").select("path", "line_count")


@query(f"WITH {S.FILES} SELECT path FROM files ORDER BY path LIMIT 60")
def export_key_files(spark, sf_dir):
    return files.export_files(S.files(spark, sf_dir).withColumn("purpose", F.coalesce(F.nullif("purpose", F.lit("")), F.lit("-")))).select("path")


@query(f"WITH {S.CHANGES}, newest AS (SELECT * FROM changes ORDER BY changed_at DESC, id DESC LIMIT 20) SELECT newest.id, file_path, change_type, changed_at, c_name AS llm_name, c_mktsegment AS working_on FROM newest LEFT JOIN customer ON session_id = CAST(c_custkey AS VARCHAR)")
def recent_changes_left_join(spark, sf_dir):
    sessions = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("llm_name"), F.col("c_mktsegment").alias("working_on"))
    return files.recent_changes(S.changes(spark, sf_dir), sessions).select("id", "file_path", "change_type", "changed_at", "llm_name", "working_on")


@query(f"WITH {S.CHANGES}, {S.SESSIONS}, {S.FILES} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM sessions WHERE status = 'active') AS active_sessions, (SELECT count(*) FROM changes WHERE changed_at >= TIMESTAMP '{S.NOW}' - INTERVAL 24 HOUR) AS recent_changes")
def changes_last_24h(spark, sf_dir):
    return files.overview_counts(S.files(spark, sf_dir), S.sessions(spark, sf_dir), S.changes(spark, sf_dir), S.now())


@query(f"WITH {S.CHANGES} SELECT file_path, id, change_type FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY changed_at DESC, id DESC) AS r FROM changes) WHERE r <= 10")
def file_history_topk(spark, sf_dir):
    return files.file_history(S.changes(spark, sf_dir)).select("file_path", "id", "change_type")


@query(r"""WITH u AS (SELECT string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS p FROM pages), f AS (SELECT array_to_string(p[1 : i], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS i FROM u))
SELECT folder, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS parent, CAST(len(string_split(folder, '/')) AS INTEGER) AS depth, count(*) AS n FROM f GROUP BY folder""")
def dir_tree_prefixes(spark, sf_dir):
    return files.folders(S.table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path")))


@query(f"WITH {S.FILES}, old AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE checksum END AS checksum FROM files WHERE doc_id % 7 <> 0) SELECT path, checksum FROM files WHERE (path, checksum) NOT IN (SELECT path, checksum FROM old)")
def incremental_changed_files(spark, sf_dir):
    new = S.files(spark, sf_dir)
    old = new.where("doc_id % 7 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("checksum")))
    return files.changed(old, new).select("path", "checksum")


@query(f"WITH {S.FILES} SELECT path FROM files EXCEPT SELECT path FROM files WHERE doc_id % 7 <> 0")
def removed_files_except(spark, sf_dir):
    old = S.files(spark, sf_dir)
    return files.removed(old, old.where("doc_id % 7 <> 0"))


@query(f"""WITH {S.FILES}, old AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE path END AS checksum FROM files WHERE doc_id % 7 <> 0), new AS (SELECT path, path AS checksum FROM files WHERE doc_id % 11 <> 0)
SELECT coalesce(old.path, new.path) AS file_path, CASE WHEN old.path IS NULL THEN 'created' WHEN new.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type FROM old FULL JOIN new ON old.path = new.path WHERE old.checksum IS DISTINCT FROM new.checksum""")
def snapshot_change_events(spark, sf_dir):
    rows = S.files(spark, sf_dir).withColumn("checksum", F.col("path"))
    old = rows.where("doc_id % 7 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("checksum")))
    return files.change_events(old, rows.where("doc_id % 11 <> 0"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    return snapshots.latest(S.table(spark, sf_dir, "events"), ["user_id"], "event_id").select("event_id", "user_id", "event_type", "value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 9 <> 0 OR c_custkey % 4 = 0")
def upsert_by_key(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return snapshots.upsert(c.where("c_custkey % 9 <> 0"), c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query(f"""WITH {S.CHANGES}, p AS (SELECT session_id, file_path AS path FROM changes UNION SELECT CAST(c_custkey AS VARCHAR), unnest(['f1', 'f2']) FROM customer WHERE c_custkey % 3 = 0)
SELECT session_id, array_to_string(list_sort(list(path)), ',') AS files FROM p GROUP BY session_id""")
def files_touched_union(spark, sf_dir):
    sessions = S.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit(" f1, f2,").alias("files_modified"))
    return conversations.session_files(sessions, S.changes(spark, sf_dir)).select("session_id", F.array_join("files", ",").alias("files"))


# Text


_REDACT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(api[_-]?key|token|secret|password|access[_-]?token)\s*=\s*([^\s,;]+)', '\1=[REDACTED]', 'gi'), '\bsk-(?:live|test)-[A-Za-z0-9_-]{8,}\b', '[REDACTED_SECRET]', 'g'), '\bghp_[A-Za-z0-9_]{20,}\b', '[REDACTED_SECRET]', 'g'), '\bgithub_pat_[A-Za-z0-9_]{20,}\b', '[REDACTED_SECRET]', 'g'), '\bxox[baprs]-[A-Za-z0-9-]{10,}\b', '[REDACTED_SECRET]', 'g')"


@query(f"SELECT doc_id, md5({_REDACT}) AS redacted_md5, {_REDACT} <> text AS redacted FROM documents")
def redact_documents(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").withColumn("r", T.redact(F.col("text")))
    return rows.select("doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("redacted"))


@query("SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS estimate, greatest(1, CAST(length(text) // 4 AS INTEGER)) AS imported, CASE WHEN length(text) > 100 THEN substring(text, 1, 97) || '...' ELSE text END AS title FROM documents")
def token_estimates(spark, sf_dir):
    t = F.col("text")
    return S.table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(t).alias("estimate"), T.token_estimate(t, 1).alias("imported"), T.shorten(t, 100).alias("title"))


@query(f"SELECT event_id, round(0.5 ** (greatest(0, epoch_us(TIMESTAMP '{S.NOW}') - epoch_us(ts)) / 3.6e9 / 168), 6) AS recency FROM events")
def recency_score(spark, sf_dir):
    return S.table(spark, sf_dir, "events").select("event_id", F.round(T.recency(F.col("ts"), S.now()), 6).alias("recency"))


def _bm25_sql(rows: str, key: str, text: str, terms: list[str], groups: str = "") -> str:
    """A WITH chain that ends in hits(key, score) for an AND of words."""
    by = f"{groups}, " if groups else ""
    f = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(terms))
    n = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS n{k}" for k in range(len(terms)))
    idf = lambda k: f"(CASE WHEN ln((docs - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n{k} + 0.5) / (n{k} + 0.5)) END)"
    score = " + ".join(f"{idf(k)} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    return f"""tok AS (SELECT *, regexp_extract_all(lower(strip_accents({text})), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM {rows}), tf AS (SELECT *, len(tokens) AS dl, {f} FROM tok),
st AS (SELECT {by}count(*) AS docs, avg(dl) AS avgdl, {n} FROM tf {"GROUP BY " + groups if groups else ""}), hits AS (SELECT tf.*, -({score}) AS score FROM tf, st WHERE {" AND ".join(f"f{k} > 0" for k in range(len(terms)))}{f" AND tf.{groups} = st.{groups}" if groups else ""})"""


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text', ['the', 'was'])} SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY hits.score, doc_id LIMIT 20")
def bm25_search(spark, sf_dir):
    index = search.Index.of(S.table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"))
    return search.bm25(index, "the was").orderBy("score", "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {S.TURNS}, {S.SESSIONS}, {_bm25_sql('turns', 'session_id', 'content', ['the', 'and'])} SELECT session_id, turn_index, llm_name, thread_id, round(score, 6) AS score FROM hits JOIN sessions ON session_id = id WHERE source_tool = 'codex' ORDER BY hits.score, session_id, turn_index LIMIT 10")
def turn_search(spark, sf_dir):
    rows = search.search_turns(S.turns(spark, sf_dir), S.sessions(spark, sf_dir), '"the" AND "and"', source_tool="codex", limit=10, stemmed=False)
    return rows.select("session_id", "turn_index", "llm_name", "thread_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text', ['the', 'with'], 'source')}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits.score, doc_id) AS place FROM hits) SELECT source AS project_path, doc_id, round(r.score, 6) AS score FROM r WHERE place <= 10 ORDER BY r.score, source, doc_id LIMIT 10")
def global_search_by_project(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").select(F.col("source").alias("project_path"), "doc_id", F.col("doc_id").cast("string").alias("session_id"), F.lit(0).alias("turn_index"), F.col("text").alias("content"))
    return search.search_projects(rows, "the with", 10).select("project_path", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {S.TURNS}, {S.FILES}, {_bm25_sql('turns', 'session_id', 'content', ['the'])},
chat AS (SELECT 'chat' AS source, session_id || ':' || turn_index AS key, 1 + 0.5 * 0.5 ** (greatest(0, epoch_us(TIMESTAMP '{S.NOW}') - epoch_us(recorded_at)) / 3.6e9 / 168) AS score FROM (SELECT * FROM hits ORDER BY score, session_id, turn_index LIMIT 15)),
file AS (SELECT 'file' AS source, path AS key, (CASE WHEN regexp_extract(path, '[^/]*$') ILIKE '%the%' THEN 0.9 ELSE 0.4 END) * (1 + 0.5 * 0.5 ** (greatest(0, epoch_us(TIMESTAMP '{S.NOW}') - epoch_us(last_modified)) / 3.6e9 / 168)) AS score FROM (SELECT * FROM files WHERE path ILIKE '%the%' ORDER BY last_modified DESC, path LIMIT 15))
SELECT source, key, round(score, 6) AS score FROM (SELECT * FROM chat UNION ALL SELECT * FROM file) u ORDER BY u.score DESC, source, key LIMIT 20""")
def unified_find(spark, sf_dir):
    return search.unified_find("the", S.now(), turns=S.turns(spark, sf_dir), files=S.files(spark, sf_dir)).select("source", "key", F.round("score", 6).alias("score"))


@query(f"""WITH {S.NODES}, {S.FILES}, {_bm25_sql('(SELECT n_name AS nm, * FROM nodes JOIN nation ON name = n_name)', 'qualified_name', "name || ' ' || qualified_name", ['n', '1'])},
g AS (SELECT 'graph' AS source, qualified_name AS key, CAST(1 + 0.5 * 0.3 AS DOUBLE) AS score FROM (SELECT * FROM hits ORDER BY score, qualified_name LIMIT 15)),
f AS (SELECT 'file' AS source, path AS key, (CASE WHEN regexp_extract(path, '[^/]*$') ILIKE '%n 1%' THEN 0.9 ELSE 0.4 END) AS score FROM files WHERE path ILIKE '%n 1%')
SELECT source, key, round(score, 6) AS score FROM (SELECT * FROM g UNION ALL SELECT * FROM f) u ORDER BY u.score DESC, source, key LIMIT 20""")
def unified_find_graph(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir).where("kind = 'Class'").withColumn("updated_at", F.lit(None).cast("timestamp"))
    return search.unified_find("n 1", S.now(), nodes=nodes, files=S.files(spark, sf_dir)).select("source", "key", F.round("score", 6).alias("score"))


@query(f"""WITH {S.FILES} SELECT 'file' AS source, path AS key, round((CASE WHEN regexp_extract(path, '[^/]*$') ILIKE '%1.en%' THEN 0.9 ELSE 0.4 END) * (1 + 0.5 * 0.5 ** (greatest(0, epoch_us(TIMESTAMP '{S.NOW}') - epoch_us(last_modified)) / 3.6e9 / 168)), 6) AS score
FROM (SELECT * FROM files WHERE path ILIKE '%1.en%' ORDER BY last_modified DESC, path LIMIT 30) f ORDER BY score DESC, source, key LIMIT 20""")
def unified_find_files(spark, sf_dir):
    return search.unified_find("1.EN", S.now(), files=S.files(spark, sf_dir)).select("source", "key", F.round("score", 6).alias("score"))


@query(f"WITH {S.TURNS} SELECT session_id, turn_index FROM turns WHERE (session_id || ':' || turn_index) NOT IN (SELECT session_id || ':' || turn_index FROM turns WHERE turn_index % 2 = 0)")
def fts_backfill_anti_join(spark, sf_dir):
    rows = S.turns(spark, sf_dir).withColumn("key", F.concat_ws(":", "session_id", "turn_index"))
    return search.missing_from_index(rows, rows.where("turn_index % 2 = 0"), "key").select("session_id", "turn_index")


@query(f"WITH {S.TURNS}, w AS (SELECT session_id || ':' || turn_index AS key, unnest(regexp_extract_all(lower(strip_accents(content)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM turns) SELECT term, key, CAST(count(*) AS INTEGER) AS tf FROM w GROUP BY term, key")
def postings(spark, sf_dir):
    rows = S.turns(spark, sf_dir).select(F.concat_ws(":", "session_id", "turn_index").alias("key"), "content")
    return search.build_postings(search.indexed(rows, F.col("content")), "key").select("term", "key", "tf")


# Graph


@query(f"WITH {S.NODES}, {S.EDGES} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def graph_stats(spark, sf_dir):
    return graph.stats(S.nodes(spark, sf_dir).withColumn("language", F.lit("")), S.edges(spark, sf_dir))




@query(f"""WITH RECURSIVE {S.NODES}, {S.EDGES}, und AS (SELECT source_qualified AS a, target_qualified AS b FROM edges UNION SELECT target_qualified, source_qualified FROM edges),
walk AS (SELECT qualified_name AS node, 0 AS depth FROM nodes WHERE qualified_name IN ('C::1', 'C::2') UNION SELECT b, depth + 1 FROM walk JOIN und ON a = node WHERE depth < 3),
low AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT qualified_name, file_path, kind, depth, (SELECT count(*) FROM low JOIN nodes ON node = qualified_name WHERE depth > 0) > 500 AS truncated FROM low JOIN nodes ON node = qualified_name WHERE depth > 0 ORDER BY depth, qualified_name LIMIT 500""")
def impact_radius(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir)
    own = nodes.withColumn("file_path", F.when(F.col("qualified_name").isin("C::1", "C::2"), "changed").otherwise(F.col("file_path")))
    return graph.impact(own, S.edges(spark, sf_dir), spark.createDataFrame([("changed",)], "path string"))


@query(f"WITH {S.EDGES}, s AS (SELECT 'N::' || n_nationkey AS node FROM nation UNION SELECT 'C::' || c_custkey FROM customer WHERE c_custkey % 3 = 0) SELECT kind, source_qualified, target_qualified FROM edges WHERE source_qualified IN (SELECT node FROM s) AND target_qualified IN (SELECT node FROM s)")
def edges_among(spark, sf_dir):
    names = S.nodes(spark, sf_dir).where("kind = 'Class' or (kind = 'Function' and cast(substring(qualified_name, 4) as bigint) % 3 = 0)").select(F.col("qualified_name").alias("node"))
    return graph.edges_among(S.edges(spark, sf_dir), names)


@query(f"WITH {S.EDGES} SELECT kind, source_qualified, target_qualified FROM edges WHERE source_qualified LIKE 'S::%' OR target_qualified IN (SELECT 'C::' || c_custkey FROM customer WHERE c_custkey % 11 = 0) OR target_qualified LIKE 'S::%'")
def edges_touching(spark, sf_dir):
    names = S.nodes(spark, sf_dir).where("kind = 'Test' or (kind = 'Function' and cast(substring(qualified_name, 4) as bigint) % 11 = 0)").select(F.col("qualified_name").alias("node"))
    return graph.edges_touching(S.edges(spark, sf_dir), names)


@query(f"WITH {S.NODES}, {S.EDGES} SELECT qualified_name, kind FROM nodes n WHERE kind NOT IN ('File', 'Test') AND NOT is_test AND NOT EXISTS (SELECT 1 FROM edges WHERE kind = 'TESTED_BY' AND target_qualified = n.qualified_name)")
def test_gaps_anti_join(spark, sf_dir):
    return graph.test_gaps(S.nodes(spark, sf_dir), S.edges(spark, sf_dir)).select("qualified_name", "kind")


@query(f"""WITH {S.NODES}, {S.EDGES}, scope AS (SELECT qualified_name AS node FROM nodes WHERE file_path IN ('R3', 'R4')) SELECT kind, source_qualified, target_qualified FROM edges WHERE source_qualified IN (SELECT node FROM scope) OR target_qualified IN (SELECT node FROM scope)""")
def session_graph_scope(spark, sf_dir):
    paths = spark.createDataFrame([("R3",), ("R4",)], "path string")
    return graph.session_scope(S.nodes(spark, sf_dir), S.edges(spark, sf_dir), paths)[1]


@query(f"""WITH {S.NODES}, {S.EDGES}, u AS (SELECT name, min(qualified_name) AS q FROM nodes WHERE kind IN ('Function', 'Test') GROUP BY name HAVING count(*) = 1), e AS (SELECT kind, source_qualified, replace(target_qualified, 'C::', 'Customer#') AS t FROM edges WHERE kind = 'CALLS')
SELECT kind, source_qualified, coalesce(q, t) AS target_qualified FROM e LEFT JOIN u ON t = name""")
def resolve_bare_calls(spark, sf_dir):
    e = S.edges(spark, sf_dir).where("kind = 'CALLS'").withColumn("target_qualified", F.replace("target_qualified", F.lit("C::"), F.lit("Customer#")))
    return graph.resolve_calls(S.nodes(spark, sf_dir), e)


@query(f"""WITH {S.NODES} SELECT file_path, array_to_string(list_slice(list('Class ' || name ORDER BY qualified_name), 1, 8), '; ') AS symbols FROM nodes WHERE kind = 'Class' GROUP BY file_path""")
def overview_symbols(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir).withColumns({"line_start": F.lit(1), "line_end": F.lit(1), "language": F.lit("x")})
    return graph.overview(nodes, S.files(spark, sf_dir)).select("file_path", F.array_join("symbols", "; ").alias("symbols"))


@query(f"WITH {S.EDGES} SELECT node, count(*) AS degree FROM (SELECT source_qualified AS node FROM edges UNION ALL SELECT target_qualified FROM edges) GROUP BY node")
def node_degree(spark, sf_dir):
    return graph.degree(S.edges(spark, sf_dir))


_OVERLAY = f"WITH {S.NODES}, {S.EDGES}, o AS (SELECT qualified_name, CASE WHEN file_path = 'R1' THEN 'locked' WHEN file_path IN ('R1', 'R2') THEN 'hot' WHEN qualified_name IN (SELECT target_qualified FROM edges WHERE kind = 'CALLS') THEN 'blast' ELSE 'cold' END AS state FROM nodes)"


def _overlay(spark, sf_dir):
    file = lambda *xs: spark.createDataFrame([(x,) for x in xs], "file_path string")
    blast = S.edges(spark, sf_dir).where("kind = 'CALLS'").select(F.col("target_qualified").alias("qualified_name"))
    return graph.overlay(S.nodes(spark, sf_dir), file("R1"), file("R1", "R2"), blast)


@query(_OVERLAY + " SELECT qualified_name, state FROM o")
def node_state_overlay(spark, sf_dir):
    return _overlay(spark, sf_dir).select("qualified_name", "state")


@query(_OVERLAY + " SELECT s.state, count(qualified_name) AS n FROM (SELECT unnest(['locked', 'hot', 'blast', 'warm', 'cold']) AS state) s LEFT JOIN o ON o.state = s.state GROUP BY s.state")
def state_histogram(spark, sf_dir):
    return graph.state_histogram(_overlay(spark, sf_dir))


_FIRST = "(SELECT * FROM (SELECT DISTINCT 'out' AS role, kind, target_qualified AS other FROM edges WHERE source_qualified = 'C::1') ORDER BY kind, other LIMIT 50) UNION ALL (SELECT * FROM (SELECT DISTINCT 'in' AS role, kind, source_qualified AS other FROM edges WHERE target_qualified = 'C::1') ORDER BY kind, other LIMIT 50)"
_BESIDE = "SELECT 'sibling' AS role, n.kind, n.qualified_name AS other FROM nodes n JOIN nodes c ON c.qualified_name = 'C::1' AND n.file_path = c.file_path AND n.parent_name IS NOT DISTINCT FROM c.parent_name WHERE n.qualified_name <> 'C::1' AND n.kind <> 'File' ORDER BY other LIMIT 30"


@query(f"WITH {S.NODES}, {S.EDGES}, f AS ({_FIRST}), b AS ({_BESIDE}) SELECT *, 1 AS hop FROM f UNION ALL SELECT *, 1 FROM b")
def neighbors_1hop(spark, sf_dir):
    return graph.neighbours(S.nodes(spark, sf_dir), S.edges(spark, sf_dir), "C::1")


@query(f"""WITH {S.NODES}, {S.EDGES}, f AS ({_FIRST}), b AS ({_BESIDE}), s AS (SELECT DISTINCT kind, target_qualified AS other FROM edges WHERE source_qualified IN (SELECT other FROM f) AND target_qualified <> 'C::1' AND target_qualified NOT IN (SELECT other FROM f) ORDER BY other, kind LIMIT 80)
SELECT *, 1 AS hop FROM f UNION ALL SELECT *, 1 FROM b UNION ALL SELECT 'second', kind, other, 2 FROM s""")
def neighbors_2hop(spark, sf_dir):
    return graph.neighbours(S.nodes(spark, sf_dir), S.edges(spark, sf_dir), "C::1", 2)


@query(f"WITH RECURSIVE {S.EDGES}, t AS (SELECT 'R::1' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth UNION ALL SELECT target_qualified, node, depth + 1 FROM t JOIN edges ON source_qualified = node AND kind = 'CONTAINS' WHERE depth < 8) SELECT * FROM t")
def subtree_contains(spark, sf_dir):
    return graph.subtree(S.edges(spark, sf_dir), "R::1", 3, None)


@query(f"WITH {S.EDGES} SELECT regexp_extract(source_qualified, '[^:]*$') || ' --' || kind || '--> ' || regexp_extract(target_qualified, '[^:]*$') AS summary FROM edges ORDER BY source_qualified, target_qualified, kind LIMIT 50")
def edge_summaries(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir).withColumns({"params": F.lit(""), "return_type": F.lit(""), "line_start": F.lit(1)})
    return graph.compact_context(nodes, S.edges(spark, sf_dir))[1].select("summary")


# Locks and attribution


def _writes(spark, sf_dir):
    return S.changes(spark, sf_dir).select(F.col("id").alias("event_id"), "file_path", "session_id")


@query(f"WITH {S.CHANGES}, own AS (SELECT file_path, arg_min(session_id, id) AS session_a FROM changes GROUP BY 1) SELECT id AS event_id, file_path, session_a, session_id AS session_b FROM changes JOIN own USING (file_path) WHERE session_id <> session_a")
def lock_conflicts_theta_join(spark, sf_dir):
    rows = _writes(spark, sf_dir)
    return locks.write_conflicts(rows.groupBy("file_path").agg(F.min_by("session_id", "event_id").alias("session_id")), rows).select("event_id", "file_path", "session_a", "session_b")


def _lock_events(spark, sf_dir):
    op = F.when(F.col("change_type") == "click", "claim").when(F.col("change_type") == "view", "release").otherwise("write")
    return S.changes(spark, sf_dir).select(F.col("id").alias("event_id"), F.col("changed_at").alias("ts"), op.alias("op"), "file_path", "session_id", F.lit("llm").alias("llm_name"))


@query("WITH s AS (SELECT ts, CAST(user_id AS VARCHAR) AS session_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)) SELECT event_id, e.ts, (SELECT session_id FROM s WHERE s.ts <= e.ts ORDER BY s.ts DESC, session_id DESC LIMIT 1) AS session_id FROM events e")
def active_session_at_event(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    return locks.active_session(e.select("event_id", F.col("ts").cast("timestamp").alias("ts")), e.where(F.col("event_type") == kind).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session_id")))


# Extraction and transcripts


def _source_files(spark, sf_dir):
    """Documents as Python-like sources: every third word that starts a line declares, imports repeat."""
    d = S.table(spark, sf_dir, "documents")
    line = lambda x: F.concat(F.element_at(F.array(F.lit("def "), F.lit("class "), F.lit("import ")), (F.length(x) % 3 + 1).cast("int")), F.regexp_replace(F.lower(x), "[^a-z]+", "x"))
    return d.select(F.concat(F.col("doc_id"), F.lit(".py")).alias("path"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("content"))


_SOURCE_LINES = "src AS (SELECT doc_id || '.py' AS file_path, list_transform(string_split(text, chr(10)), lambda x: ['def ', 'class ', 'import '][CAST(length(x) % 3 + 1 AS INTEGER)] || regexp_replace(lower(x), '[^a-z]+', 'x', 'g')) AS ls FROM documents), lines AS (SELECT file_path, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM src)"
_SYMBOLS = _SOURCE_LINES + ", sym AS (SELECT file_path, CASE WHEN text LIKE 'class %' THEN 'Class' ELSE 'Function' END AS kind, regexp_extract(text, '^(?:class|def) (\\w+)', 1) AS base, CAST(line AS INTEGER) AS line FROM lines WHERE regexp_matches(text, '^(class|def) \\w')), named AS (SELECT *, row_number() OVER (PARTITION BY file_path, base ORDER BY line) AS r FROM sym)"


@query(f"WITH {_SYMBOLS} SELECT file_path, CASE WHEN kind = 'Function' AND regexp_matches(base, '^(?i)(test_|test[a-z])') THEN 'Test' ELSE kind END AS kind, CASE WHEN r > 1 THEN base || '__L' || line ELSE base END AS name, line FROM named")
def symbol_line_scan(spark, sf_dir):
    return extract.symbols(extract.lines_of(_source_files(spark, sf_dir)))


@query(f"WITH {_SYMBOLS} SELECT file_path, base || '__L' || line AS name FROM named WHERE r > 1")
def duplicate_symbol_rename(spark, sf_dir):
    return extract.symbols(extract.lines_of(_source_files(spark, sf_dir))).where("name like '%\\\\_\\\\_L%'").select("file_path", "name")


@query(f"WITH {_SOURCE_LINES} SELECT file_path, target, line FROM (SELECT file_path, substring(trim(text), 1, 200) AS target, CAST(line AS INTEGER) AS line, row_number() OVER (PARTITION BY file_path ORDER BY line) AS r FROM lines WHERE text LIKE 'import %') WHERE r <= 40")
def import_edges_cap40(spark, sf_dir):
    return extract.imports(extract.lines_of(_source_files(spark, sf_dir)))


@query("WITH h AS (SELECT doc_id, '# ' || text AS c FROM documents) SELECT doc_id, substring(nullif(trim(regexp_extract(substring(c, 1, 3000), '(?m)^#{1,3}\\s+(.+)', 1)), ''), 1, 200) AS purpose FROM h")
def purpose_extract(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", extract.purpose(F.concat(F.col("doc_id"), F.lit(".md")), F.concat(F.lit("# "), F.col("text"))).alias("purpose"))


def _line_rows(spark, sf_dir, make) -> DataFrame:
    """Conversations as lines of transcripts, a file each."""
    c = S.table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("/x/"), F.col("conv_id"), F.lit(".jsonl")).alias("source_path"), F.col("turn").alias("line_no"), F.to_json(make(F.col("role"), F.col("text"))).alias("line"))


_PARSED = "SELECT CAST(conv_id AS VARCHAR) AS session_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, {0} AS content FROM conversations WHERE {1}"


@query(_PARSED.format("text", "role IN ('user', 'assistant')"))
def parse_transcript_claude(spark, sf_dir):
    from loomstore.sources import transcripts

    rows = _line_rows(spark, sf_dir, lambda role, text: F.struct(role.alias("type"), F.lit(False).alias("isSidechain"), F.struct(role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")).alias("message")))
    return transcripts.claude(rows).select("session_key", "pos", "role", "content")


@query(_PARSED.format("text || chr(10) || '[tool_use: edit]'", "true"))
def parse_transcript_cursor(spark, sf_dir):
    from loomstore.sources import transcripts

    block = lambda kind, **k: F.struct(F.lit(kind).alias("type"), *[k.get(n, F.lit(None).cast("string")).alias(n) for n in ("text", "name")])
    rows = _line_rows(spark, sf_dir, lambda role, text: F.struct(role.alias("role"), F.struct(F.array(block("text", text=text), block("tool_use", name=F.lit("edit"))).alias("content")).alias("message")))
    return transcripts.cursor(rows).select("session_key", "pos", "role", "content")


@query(_PARSED.format("text", "true").replace("CAST(conv_id AS VARCHAR)", "'s' || conv_id"))
def parse_transcript_codex(spark, sf_dir):
    from loomstore.sources import transcripts

    rows = _line_rows(spark, sf_dir, lambda role, text: F.struct(F.lit("response_item").alias("type"), F.struct(role.alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"))).alias("content")).alias("payload")))
    heads = rows.select("source_path").distinct().select("source_path", F.lit(-1).cast("bigint").alias("line_no"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("s"), F.regexp_extract("source_path", r"(\d+)\.", 1)).alias("id"), F.lit("0.1").alias("cli_version")).alias("payload"))).alias("line"))
    return transcripts.codex(rows.unionByName(heads))[0].select("session_key", "pos", "role", "content")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, text AS content FROM conversations")
def parse_transcript_json(spark, sf_dir):
    from loomstore.sources import transcripts

    c = S.table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    files = c.groupBy(F.col("conv_id").cast("string").alias("source_path")).agg(F.to_json(turns).alias("content"))
    return transcripts.json_array(files).select(F.col("source_path").cast("bigint").alias("conv_id"), "pos", "role", "content")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, text AS content FROM conversations WHERE trim(text) <> ''")
def parse_transcript_markdown(spark, sf_dir):
    from loomstore.sources import transcripts

    c = S.table(spark, sf_dir, "conversations")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.lit("<!-- Role: "), F.upper(t["role"]), F.lit(" -->\n"), t["text"]))
    files = c.groupBy(F.col("conv_id").cast("string").alias("source_path")).agg(F.array_join(parts, "\n\n").alias("content"))
    return transcripts.markdown(files).select(F.col("source_path").cast("bigint").alias("conv_id"), "pos", "role", "content")


from loomstore import project_queries  # noqa: E402, F401  registers the rest
