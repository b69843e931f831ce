"""More registered queries: sessions, extraction, paths, changes to tables, search and transcripts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstore.functions import text as T
from loomstore.functions.stem import stem
from loomstore.operators import budget, conversations, extract, files, graph, locks, search, snapshots
from loomstore.operators.segments import Segments
from loomstore.plans import stand_ins as S
from loomstore.plans.shared import scratch
from loomstore.queries import _bm25_sql, _lock_events, query
from loomstore.sources import project, transcripts

# Sessions

_SESSION_EVENTS = """se AS (SELECT event_id, ts, CASE event_id % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'start' WHEN 2 THEN 'save' WHEN 3 THEN 'save' WHEN 4 THEN 'end' WHEN 5 THEN 'link' ELSE 'unlink' END AS op,
  CAST(event_id // 7 % 90 AS VARCHAR) AS session_id, 'llm' || (event_id // 7 % 90 % 40) AS llm_name, CASE WHEN event_id % 7 IN (0, 1, 5) THEN 't' || user_id END AS thread_id,
  CASE WHEN event_id % 7 < 4 THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE 'task ' || event_id END END AS working_on FROM events)"""


def _session_events(spark, sf_dir):
    e, n = S.table(spark, sf_dir, "events"), F.col("event_id") % 7
    number = F.floor(F.col("event_id") / 7) % 90
    ops = F.element_at(F.array(*map(F.lit, ("start", "start", "save", "save", "end", "link", "unlink"))), (n + 1).cast("int"))
    none = F.lit(None).cast("string")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), ops.alias("op"), number.cast("string").alias("session_id"), F.concat(F.lit("llm"), number % 40).alias("llm_name"), F.when(n.isin(0, 1, 5), F.concat(F.lit("t"), "user_id")).alias("thread_id"),
        F.when(n < 4, F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("task "), "event_id"))).alias("working_on"), *[none.alias(c) for c in ("summary", "conversation_context", "files_modified", "tags")],
    )


@query(f"""WITH {_SESSION_EVENTS}, s AS (SELECT session_id AS id, arg_min(llm_name, event_id) FILTER (WHERE op = 'start') AS llm_name, min(ts) FILTER (WHERE op = 'start') AS started_at, max(ts) FILTER (WHERE op = 'end') AS ended_at, min(event_id) FILTER (WHERE op = 'start') AS first_start,
  arg_max(op, event_id) FILTER (WHERE op IN ('start', 'save', 'end')) AS last_op, arg_max_null(CASE WHEN op <> 'unlink' THEN thread_id END, event_id) FILTER (WHERE op IN ('start', 'link', 'unlink')) AS thread_id, arg_max(working_on, event_id) FILTER (WHERE working_on <> '') AS working_on FROM se GROUP BY session_id)
SELECT id, llm_name, started_at, ended_at, thread_id, working_on, CASE WHEN last_op = 'end' THEN 'completed' WHEN last_op = 'save' THEN 'interrupted' WHEN EXISTS (SELECT 1 FROM se WHERE op = 'start' AND se.llm_name = s.llm_name AND event_id > first_start) THEN 'interrupted' ELSE 'active' END AS status FROM s""")
def sessions_fold(spark, sf_dir):
    """Start, save, end, link and unlink events, folded to sessions."""
    return conversations.fold_sessions(_session_events(spark, sf_dir)).select("id", "llm_name", "started_at", "ended_at", "thread_id", "working_on", "status")


_ASSIGNED = r"regexp_replace({0}, '\b(api[_-]?key|token|secret|password|access[_-]?token)\s*=\s*([^\s,;]+)', '\1=[REDACTED]', 'gi')"


@query(rf"""WITH {S.TURNS}, new AS (SELECT session_id, turn_index, CASE WHEN turn_index % 5 = 4 THEN 'robot' ELSE role END AS role, 'token=' || turn_index || ' ' || substring(content, 1, 50) AS content FROM turns WHERE turn_index >= 2), have AS (SELECT session_id, max(turn_index) AS last FROM turns WHERE turn_index < 2 GROUP BY 1)
SELECT session_id, role, content, CAST(coalesce(last, -1) + row_number() OVER (PARTITION BY session_id ORDER BY new.turn_index) AS INTEGER) AS turn_index, CAST(length(content) // 4 AS INTEGER) AS token_est FROM (SELECT session_id, turn_index, role, {_ASSIGNED.format("content")} AS content FROM new WHERE role <> 'robot') new LEFT JOIN have USING (session_id)""")
def append_numbered_turns(spark, sf_dir):
    """Turns numbered on from each session's last, redacted, those of an unknown role left out."""
    t = S.turns(spark, sf_dir)
    new = t.where("turn_index >= 2").select("session_id", F.col("turn_index").alias("pos"), F.when(F.col("turn_index") % 5 == 4, "robot").otherwise(F.col("role")).alias("role"), F.concat(F.lit("token="), "turn_index", F.lit(" "), F.substring("content", 1, 50)).alias("content"), F.lit(0).alias("token_est"))
    return conversations.append_turns(t.where("turn_index < 2"), new).select("session_id", "role", "content", "turn_index", "token_est")


@query(f"WITH {S.TURNS}, new AS (SELECT *, CASE WHEN turn_index % 4 = 3 THEN NULL WHEN turn_index % 4 = 2 THEN 'tool' ELSE role END AS r FROM turns) SELECT session_id, turn_index, r AS role FROM new WHERE r IS NULL OR r NOT IN ('user', 'assistant', 'system')")
def turns_of_unknown_roles(spark, sf_dir):
    t = S.turns(spark, sf_dir)
    return conversations.prepared_turns(t.withColumn("role", F.when(t["turn_index"] % 4 == 2, "tool").when(t["turn_index"] % 4 < 2, F.col("role"))))[1].select("session_id", "turn_index", "role")


@query(f"""WITH {S.TURNS}, {S.SESSIONS}, a AS (SELECT session_id, count(*) AS turn_count, max(recorded_at) AS last_turn_at FROM turns GROUP BY 1)
SELECT id, status, turn_count FROM sessions JOIN a ON id = session_id WHERE status IN ('active', 'interrupted') AND (working_on ILIKE '%TASK 1%' OR id ILIKE '%task 1%') ORDER BY last_turn_at DESC, id LIMIT 20""")
def sessions_searched_by_state(spark, sf_dir):
    """The states and the text restrict before the limit."""
    rows = conversations.list_sessions(S.sessions(spark, sf_dir), S.turns(spark, sf_dir), search="TASK 1", status=["active", "interrupted"], limit=20)
    return rows.select("id", "status", "turn_count")


@query(f"WITH {S.SESSIONS} SELECT id, llm_name, status FROM sessions WHERE (llm_name LIKE 'claude%' OR llm_name = 'unknown') AND status IN ('active', 'interrupted') ORDER BY started_at DESC, id LIMIT 1")
def session_to_continue(spark, sf_dir):
    return conversations.resolve_session(S.sessions(spark, sf_dir)).select("id", "llm_name", "status")


@query(f"WITH {S.TURNS} SELECT session_id, turn_index, role FROM turns WHERE session_id = '7' ORDER BY turn_index")
def turns_of_a_session(spark, sf_dir):
    return conversations.handoff(S.sessions(spark, sf_dir), S.turns(spark, sf_dir), None, "7").select("session_id", "turn_index", "role")


@query("SELECT DISTINCT 'thread-' || CASE WHEN w = '' THEN 'thread' ELSE w END || '-' || substring(md5(title || '|' || '2024-01-01 00:00:00'), 1, 8) AS id, title, 'active' AS status FROM (SELECT n_name || ' of ' || n_nationkey || ' / x y' AS title, array_to_string(regexp_extract_all(lower(n_name || ' of ' || n_nationkey || ' / x y'), '[a-z0-9]+')[1:4], '-') AS w FROM nation)")
def threads_named_by_title(spark, sf_dir):
    new = S.table(spark, sf_dir, "nation").select(F.lit(None).cast("string").alias("id"), F.concat("n_name", F.lit(" of "), "n_nationkey", F.lit(" / x y")).alias("title"), F.lit(S.START).cast("timestamp").alias("created_at"))
    from loomstore.plans.schemas import empty

    return conversations.create_threads(empty(spark, "threads"), new).select("id", "title", "status")


# Imports of other tools' sessions


@query("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS k, turn, role, CASE WHEN turn = 0 THEN '<INSTRUCTIONS> ' || coalesce(text, '') ELSE coalesce(text, '') END AS content FROM conversations WHERE coalesce(text, '') <> ''),
q AS (SELECT k, arg_min(substring(content, 1, 140), turn) FILTER (WHERE role = 'user' AND turn > 0) AS first, count(*) AS turn_count FROM t GROUP BY k), w AS (SELECT k, turn_count, trim(regexp_replace(first, '[\\r\\n]+', ' ', 'g')) AS one FROM q),
x AS (SELECT *, coalesce(CASE WHEN length(one) > 100 THEN substring(one, 1, 97) || '...' ELSE one END, '') AS working_on FROM w)
SELECT 'cursor-' || k AS id, 'thread-cursor-' || k AS thread_id, CASE WHEN working_on <> '' THEN substring(regexp_replace(working_on, '\\s+', ' ', 'g'), 1, 120) ELSE 'cursor session ' || k END AS title, working_on, turn_count FROM x""")
def sessions_of_imported_turns(spark, sf_dir):
    """Ids, titles and tasks of imported sessions; texts that tools put before the first question are no task."""
    c = S.table(spark, sf_dir, "conversations").where("coalesce(text, '') <> ''")
    rows = c.select(F.col("conv_id").cast("string").alias("session_key"), F.lit("/x").alias("source_path"), F.col("turn").cast("int").alias("pos"), "role", F.when(F.col("turn") == 0, F.concat(F.lit("<INSTRUCTIONS> "), "text")).otherwise(F.col("text")).alias("content"))
    return transcripts.sessions_of(rows, "cursor").select("id", "thread_id", "title", "working_on", "turn_count")


@query("SELECT page_id, lower(coalesce(nullif(regexp_extract(f, '^([a-zA-Z][a-zA-Z0-9_]*)[-_][0-9]', 1), ''), nullif(regexp_extract(f, '^(\\p{L}[^-_]*)', 1), ''), 'unknown')) AS llm FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Claude-' || page_id WHEN 1 THEN 'codex_old-' || page_id WHEN 2 THEN 'gemini' ELSE '_' || page_id END AS f FROM pages)")
def llm_of_file_names(spark, sf_dir):
    n = F.col("page_id") % 4
    name = F.when(n == 0, F.concat(F.lit("Claude-"), "page_id")).when(n == 1, F.concat(F.lit("codex_old-"), "page_id")).when(n == 2, "gemini").otherwise(F.concat(F.lit("_"), "page_id"))
    return S.table(spark, sf_dir, "pages").select("page_id", transcripts.llm_of_file(F.concat(F.lit("/drop/"), name, F.lit(".md"))).alias("llm"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/App/' || regexp_replace(url, '^[a-z]+://', '') WHEN 1 THEN '/app' || page_id || '/x.py' ELSE '/APP\\src\\' || page_id || '.py' END AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(lower(translate(path, '\\', '/')), '/app/') THEN substring(translate(path, '\\', '/'), 6) END AS path, lower(rtrim(path, '/\\')) = '/app/src' AS same FROM p""")
def paths_below_a_folder(spark, sf_dir):
    n = F.col("page_id") % 3
    path = F.when(n == 0, F.concat(F.lit("/App/"), F.regexp_replace("url", "^[a-z]+://", ""))).when(n == 1, F.concat(F.lit("/app"), "page_id", F.lit("/x.py"))).otherwise(F.concat(F.lit("/APP\\src\\"), "page_id", F.lit(".py")))
    rows = S.table(spark, sf_dir, "pages").withColumn("p", path)
    return rows.select("page_id", transcripts.relative_to(F.col("p"), F.lit("/app/")).alias("path"), transcripts.same_folder(F.col("p"), F.lit("/App/src/")).alias("same"))


@query("SELECT conv_id, turn, regexp_matches(lower(substring(ltrim(t), 1, 40)), '^(<environment_context>|<instructions>|# agents.md|<user_instructions>|<system)') AS preamble FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '  <SYSTEM x' WHEN 1 THEN '# agents.MD' WHEN 2 THEN '<user_Instructions>' ELSE '' END || coalesce(text, '') AS t FROM conversations)")
def preambles(spark, sf_dir):
    n = F.col("turn") % 5
    text = F.concat(F.when(n == 0, "  <SYSTEM x").when(n == 1, "# agents.MD").when(n == 2, "<user_Instructions>").otherwise(""), F.coalesce("text", F.lit("")))
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_preamble(text).alias("preamble"))


# Paths, times and texts


@query("SELECT page_id, replace(u, '\\', '/') AS path, trim(regexp_replace(regexp_replace(u, '[\\\\/ ]+', '-', 'g'), '-+', '-', 'g'), '-') AS folder FROM (SELECT page_id, '\\' || regexp_replace(url, '^[a-z]+://', '') || ' x' AS u FROM pages)")
def path_slashes_and_folder_slug(spark, sf_dir):
    u = F.concat(F.lit("\\"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit(" x"))
    return S.table(spark, sf_dir, "pages").select("page_id", T.slashes(u).alias("path"), T.folder_slug(u).alias("folder"))


@query(f"SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age FROM (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '{S.NOW}') - epoch_us(ts)) / 1e6) AS BIGINT) AS s FROM events)")
def ages_of_written_times(spark, sf_dir):
    """Times in either stored form, read back and told as ages."""
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    either = F.when(F.col("event_id") % 2 == 0, text).otherwise(F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))
    return S.table(spark, sf_dir, "events").select("event_id", T.age(T.timestamp(either), S.now()).alias("age"))


@query("SELECT doc_id, CASE WHEN t = '' THEN 0 WHEN ends_with(t, chr(10)) THEN len(string_split(t, chr(10))) - 1 ELSE len(string_split(t, chr(10))) END AS n FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END AS t FROM documents WHERE text IS NOT NULL)")
def line_counts(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n").otherwise(""))
    return S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", extract.line_count(text).cast("bigint").alias("n"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'node_modules/x/b.js' WHEN 2 THEN 'a/.git/c.md' WHEN 3 THEN 'img/d.png' WHEN 4 THEN 'Makefile' ELSE 'docs/e.md' END AS path FROM pages)
SELECT page_id, path, page_id % 6 NOT IN (3) AS text, page_id % 6 IN (1, 2) AS ignored FROM p""")
def indexable_paths(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("src/a.py", "node_modules/x/b.js", "a/.git/c.md", "img/d.png", "Makefile", "docs/e.md"))), (F.col("page_id") % 6 + 1).cast("int"))
    return S.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", "path", project.indexable(F.col("path")).alias("text"), project.ignored(F.col("path")).alias("ignored"))


@query("WITH f AS (SELECT doc_id, n_chars * 400 AS length, CASE doc_id % 4 WHEN 0 THEN doc_id || '.py' WHEN 1 THEN doc_id || '.min.js' WHEN 2 THEN doc_id || '.txt' ELSE doc_id || '.go' END AS path FROM documents) SELECT path FROM f WHERE doc_id % 4 IN (0, 3) AND length <= 524288")
def parseable_files(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, (".py", ".min.js", ".txt", ".go"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return extract.parseable(d.select(F.concat("doc_id", ext).alias("path"), (F.col("n_chars") * 400).alias("length"))).select("path")


# Tables


@query("WITH o AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 9 <> 0) SELECT * FROM o UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 9 = 0")
def insert_missing_rows(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return snapshots.insert_missing(c.where("c_custkey % 9 <> 0"), c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey ELSE c_name END AS c_name, c_mktsegment FROM customer")
def update_but_keep_blanks(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("new "), "c_custkey")).otherwise("").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment")).where("c_custkey % 5 < 4 or c_custkey % 3 = 0")
    return snapshots.update_blanks(c, new, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey % 4 <> 0")
def delete_by_key(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    return snapshots.delete(c.select("c_custkey", "c_name", "c_nationkey"), S.table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("c_nationkey")), ["c_nationkey"]).select("c_custkey", "c_name")


@query(f"WITH {S.NODES} SELECT qualified_name, name, file_path FROM nodes WHERE file_path NOT IN ('R1', 'R2') UNION ALL SELECT qualified_name, 'again', file_path FROM nodes WHERE file_path = 'R1' AND kind = 'Class'")
def graph_rows_replaced_by_file(spark, sf_dir):
    n = S.nodes(spark, sf_dir).select("qualified_name", "name", "file_path")
    new = S.nodes(spark, sf_dir).where("file_path = 'R1' and kind = 'Class'").select("qualified_name", F.lit("again").alias("name"), "file_path")
    return snapshots.replace_files(n, new.unionByName(new), spark.createDataFrame([("R1",), ("R2",)], "file_path string"), ["qualified_name"])


@query(f"SELECT event_id AS id, event_id % 3 = 0 OR 'f' || (props ->> '$.k') = 'f3' AS resolved, CASE WHEN event_id % 3 = 0 THEN 'old' WHEN 'f' || (props ->> '$.k') = 'f3' THEN 'me' END AS resolved_by, CASE WHEN event_id % 3 = 0 THEN ts WHEN 'f' || (props ->> '$.k') = 'f3' THEN TIMESTAMP '{S.NOW}' END AS resolved_at FROM events")
def conflicts_resolved_by_file(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    done = F.col("id") % 3 == 0
    rows = c.select("id", "file_path", done.alias("resolved"), F.when(done, F.col("changed_at")).alias("resolved_at"), F.when(done, "old").alias("resolved_by"))
    return locks.resolve(rows, S.now(), "me", path="f3").select("id", "resolved", "resolved_by", "resolved_at")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS llm_name, CAST(NULL AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS source_tool FROM customer")
def older_sessions_conformed(spark, sf_dir):
    from loomstore.plans.schemas import conform

    old = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("llm_name"), F.col("c_acctbal").alias("gone"))
    return conform(old, "sessions").select("id", "llm_name", "thread_id", "source_tool")


# Locks

_FOLD = """ev AS (SELECT event_id, 'f' || (props ->> '$.k') AS file_path, CAST(user_id AS VARCHAR) AS session_id, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'release' ELSE 'write' END AS op FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY event_id) AS n FROM ev),
w AS (SELECT o.*, CASE op WHEN 'claim' THEN true WHEN 'release' THEN false END AS granted, CASE WHEN op = 'claim' THEN session_id END AS owner FROM o WHERE n = 1
  UNION ALL SELECT o.event_id, o.file_path, o.session_id, o.op, o.n, CASE o.op WHEN 'claim' THEN w.owner IS NULL OR w.owner = o.session_id WHEN 'release' THEN coalesce(w.owner = o.session_id, false) END,
    CASE WHEN o.op = 'claim' AND w.owner IS NULL THEN o.session_id WHEN o.op = 'release' AND w.owner = o.session_id THEN NULL ELSE w.owner END FROM w JOIN o ON o.file_path = w.file_path AND o.n = w.n + 1)"""

query(f"WITH RECURSIVE {_FOLD} SELECT event_id, file_path, session_id, op, granted, owner, CASE WHEN owner IS NOT NULL THEN 'llm' END AS owner_llm FROM w", "lock_fold")(lambda spark, sf_dir: locks.fold_locks(_lock_events(spark, sf_dir)))
query(f"WITH RECURSIVE {_FOLD} SELECT event_id, file_path, owner AS session_a, session_id AS session_b FROM w WHERE (op = 'claim' AND NOT granted) OR (op = 'write' AND owner <> session_id)", "lock_conflicts_fold")(lambda spark, sf_dir: locks.conflicts(locks.fold_locks(_lock_events(spark, sf_dir))))


@query(f"WITH RECURSIVE {_FOLD} SELECT file_path, arg_max_null(owner, event_id) AS session_id, 'llm' AS llm_name FROM w GROUP BY file_path HAVING arg_max_null(owner, event_id) IS NOT NULL")
def locks_held(spark, sf_dir):
    return locks.current_locks(locks.fold_locks(_lock_events(spark, sf_dir)))


# Search


def _found(sql_terms: list[str], where: str) -> str:
    """Ids and scores of documents for words and a condition on their counts f0, f1, ..."""
    chain = _bm25_sql("documents", "doc_id", "text", sql_terms)
    every = " AND ".join(f"f{k} > 0" for k in range(len(sql_terms)))
    before, after = chain.rsplit(every, 1)
    return f"WITH {before}{where}{after} SELECT doc_id, round(score, 6) AS score FROM hits"


def _search(spark, sf_dir, text):
    index = search.Index.of(S.table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"))
    return search.bm25(index, text).select("doc_id", F.round("score", 6).alias("score"))


@query(_found(["the", "der"], "(f0 > 0 OR f1 > 0)"))
def search_either_word(spark, sf_dir):
    return _search(spark, sf_dir, "the OR der")


@query(_found(["the"], "f0 > 0 AND NOT list_contains(tokens, 'with')"))
def search_without_a_word(spark, sf_dir):
    return _search(spark, sf_dir, "the NOT with")


_PREFIX = _found(["wi"], "f0 > 0").replace("lambda x: x = 'wi'", "lambda x: starts_with(x, 'wi')")
_PHRASE = _found(["of"], "f0 > 0").replace("len(list_filter(tokens, lambda x: x = 'of'))", "len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'of' AND tokens[i + 1] = 'the'))")


@query(_PREFIX)
def search_by_prefix(spark, sf_dir):
    return _search(spark, sf_dir, "wi*")


@query(_PHRASE)
def search_by_phrase(spark, sf_dir):
    return _search(spark, sf_dir, '"of the"')


@query(f"WITH {_bm25_sql('(SELECT * FROM documents)', 'doc_id', 'text', ['uber'])} SELECT doc_id, round(score, 6) AS score FROM hits")
def search_folds_marks(spark, sf_dir):
    """A marked word is found by its plain letters, and the other way round."""
    return _search(spark, sf_dir, "ÜBER")


def _forms(word: str) -> list[str]:
    """The words of one stem that endings make of it."""
    ends = ["", "s", "e", "ed", "ing", "ful", "ness", "ative", "ly", "al", "er", "y"]
    return sorted(w for w in {word + a + b + c for a in ends for b in ends for c in ends} if stem(w) == word)


def _stemmed_sql(words: list[str], rows: str, where: str) -> str:
    """Scores by the stems of words."""
    chain = _bm25_sql(rows, "doc_id", "text", words)
    for w in words:
        chain = chain.replace(f"lambda x: x = '{w}'", "lambda x: x IN (" + ", ".join(f"'{f}'" for f in _forms(w)) + ")")
    before, after = chain.rsplit(" AND ".join(f"f{k} > 0" for k in range(len(words))), 1)
    return f"WITH {before}{where}{after} SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY hits.score, doc_id"


def _stored(spark, sf_dir) -> Segments:
    """A stored, stemmed index of all documents, taken in by three appends, which are merged."""
    rows = S.table(spark, sf_dir, "documents")
    held = Segments(snapshots.Store(spark, scratch(spark, "index")), "texts", ["doc_id"], "doc_id bigint", fan=3)
    for k in range(3):
        held.add(rows.where(F.pmod("doc_id", F.lit(3)) == k), F.col("text"))
        held.vacuum()  # no one else reads this index
    return held


@query(_stemmed_sql(["hand", "thing"], "documents", "(f0 > 0 OR f1 > 0)") + " LIMIT 20")
def stored_search_best(spark, sf_dir):
    """The best of a stored index by block maxima."""
    return _stored(spark, sf_dir).best("handing OR things", 20).select("doc_id", F.round("score", 6).alias("score"))


@query(_stemmed_sql(["hand", "thing", "with"], "(SELECT * FROM documents WHERE lang <> 'fr')", "(f0 > 0 OR f1 > 0) AND NOT f2 > 0").replace("f2 * 2.2", "0 * 2.2"))
def stored_search_after_removal(spark, sf_dir):
    """All that fits in a stored index that texts were taken out of."""
    held = _stored(spark, sf_dir)
    held.remove(S.table(spark, sf_dir, "documents").where("lang = 'fr'"))
    return search.bm25(held.index(), "(hands OR thinging) NOT with").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {S.NODES} SELECT qualified_name FROM nodes WHERE (lower(name) LIKE '%mer#%' OR lower(qualified_name) LIKE '%mer#%') AND (lower(name) LIKE '%7%' OR lower(qualified_name) LIKE '%7%') ORDER BY qualified_name LIMIT 20")
def nodes_by_parts_of_names(spark, sf_dir):
    """Every part must be in one of the names."""
    return search.search_nodes(S.nodes(spark, sf_dir), "MER# 7", stemmed=False).select("qualified_name")


_MENTIONED = "(SELECT DISTINCT path FROM (SELECT CAST(conv_id AS VARCHAR) || '.py' AS path FROM conversations) ORDER BY path LIMIT 10)"


@query(f"""WITH {S.TURNS}, said AS (SELECT session_id, turn_index, recorded_at, ' ' || array_to_string(regexp_extract_all(lower(strip_accents('see ' || (CAST(session_id AS BIGINT) % 30) || '.py, ' || content)), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS words FROM turns),
m AS (SELECT path, session_id, turn_index, row_number() OVER (PARTITION BY path ORDER BY recorded_at DESC, session_id, turn_index DESC) AS r FROM {_MENTIONED} JOIN said ON contains(words, ' ' || replace(path, '.', ' ') || ' '))
SELECT path, session_id, turn_index FROM m WHERE r <= 3""")
def mentions_of_files(spark, sf_dir):
    t = S.turns(spark, sf_dir).withColumn("content", F.concat(F.lit("see "), F.col("session_id").cast("bigint") % 30, F.lit(".py, "), "content"))
    paths = S.table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(".py")).alias("path"))
    return search.mentions(paths, t)


# Graph


@query(f"WITH {S.NODES} SELECT qualified_name, kind || ' ' || name || '(a)' || CASE WHEN kind = 'Function' THEN ' -> int' ELSE '' END || CASE WHEN is_test THEN ' [test]' ELSE '' END AS signature FROM nodes")
def node_signatures(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir).withColumn("params", F.lit("(a)")).withColumn("return_type", F.when(F.col("kind") == "Function", "int").when(F.col("kind") == "Class", ""))
    return graph.signature(nodes).select("qualified_name", "signature")


@query(f"WITH {S.NODES} SELECT file_path, array_to_string(list(kind || ' ' || name || '(a)' || CASE WHEN is_test THEN ' [test]' ELSE '' END ORDER BY kind || ' ' || name || '(a)' || CASE WHEN is_test THEN ' [test]' ELSE '' END), ';') AS signatures FROM nodes WHERE kind <> 'File' GROUP BY file_path")
def signatures_by_file(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir).withColumns({"params": F.lit("(a)"), "return_type": F.lit(None).cast("string"), "line_start": F.lit(1)})
    return graph.compact_context(nodes, S.edges(spark, sf_dir))[0].select("file_path", F.array_join("signatures", ";").alias("signatures"))


@query(f"WITH {S.NODES} SELECT 'language' AS what, CASE WHEN kind = 'Test' THEN 'python' ELSE 'go' END AS kind, count(*) AS n FROM nodes WHERE kind <> 'File' GROUP BY 2")
def graph_languages(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir).withColumn("language", F.when(F.col("kind") == "Test", "python").when(F.col("kind") != "File", "go"))
    return graph.stats(nodes, S.edges(spark, sf_dir)).where("what = 'language'")


@query(f"WITH {S.NODES}, {S.EDGES}, n AS (SELECT qualified_name FROM nodes WHERE kind IN ('Class', 'Function') AND (name ILIKE '%1%' OR file_path ILIKE '%1%')) SELECT kind, source_qualified, target_qualified FROM edges WHERE kind IN ('CONTAINS') AND source_qualified IN (SELECT * FROM n) AND target_qualified IN (SELECT * FROM n)")
def graph_drawn_in_part(spark, sf_dir):
    """Edges of chosen kinds among nodes of chosen kinds whose name or path holds a text."""
    return graph.drawn(S.nodes(spark, sf_dir), S.edges(spark, sf_dir), ["Class", "Function"], ["CONTAINS"], "1")[1]


@query(f"WITH {S.NODES} SELECT file_path, count(*) AS n FROM nodes WHERE file_path = 'R1' OR starts_with(file_path, 'R1/') GROUP BY file_path")
def nodes_below_a_prefix(spark, sf_dir):
    return graph.below(S.nodes(spark, sf_dir), "R1").groupBy("file_path").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT path FROM (SELECT 'f' || (event_id % 50) AS path FROM events WHERE event_type = 'click' UNION SELECT 'f' || (event_id % 70) FROM events WHERE event_type = 'view')")
def files_changed_in_git(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    path = lambda n, kind: e.where(F.col("event_type") == kind).select(F.concat(F.lit("f"), F.col("event_id") % n).alias("path"))
    return files.staged_or_not(path(50, "click"), path(70, "view"))


# Extraction

_LANGUAGES = [
    ("go", "func {0}(", "Function"), ("rs", "pub struct {0}", "Class"), ("java", "public final class {0}", "Class"), ("cs", "internal record {0}", "Class"), ("rb", "  def {0}", "Function"), ("php", "abstract class {0}", "Class"),
    ("cpp", "struct {0}", "Class"), ("c", "static int {0}(int x) {{", "Function"), ("js", "export async function {0}(", "Function"), ("tsx", "export const {0} = (", "Function"), ("ts", "  export default class {0}", "Class"),
]


def _declared(spark, sf_dir):
    """A line of each document as a declaration, in a language by its number."""
    d = S.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("n_"), "doc_id")
    line, ext = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (e, shape, _) in enumerate(_LANGUAGES):
        before, after = shape.replace("{{", "{").split("{0}")
        here = F.col("doc_id") % len(_LANGUAGES) == k
        line, ext = F.when(here, F.concat(F.lit(before), name, F.lit(after))).otherwise(line), F.when(here, e).otherwise(ext)
    return d.select(F.concat_ws(".", "doc_id", ext).alias("path"), F.concat(F.lit("// x\n"), line, F.lit("\nplain words\n")).alias("content"))


@query(f"SELECT doc_id || '.' || {[e for e, _, _ in _LANGUAGES]}[CAST(doc_id % {len(_LANGUAGES)} + 1 AS INTEGER)] AS file_path, {[k for _, _, k in _LANGUAGES]}[CAST(doc_id % {len(_LANGUAGES)} + 1 AS INTEGER)] AS kind, 'n_' || doc_id AS name, 2 AS line FROM documents")
def symbols_of_other_languages(spark, sf_dir):
    return extract.symbols(extract.lines_of(_declared(spark, sf_dir))).select("file_path", "kind", "name", "line")


_EXTENDS = [("js", "class A{0} extends B{0} {", "B{0}"), ("java", "public class A{0} implements B{0}, C {", "B{0},C"), ("cs", "class A{0} : B{0}", "B{0}"), ("cpp", "class A{0} : public B{0} {", "B{0}"), ("rb", "class A{0} < B{0}", "B{0}"), ("php", "class A{0} extends B{0}", "B{0}"), ("rs", "impl B{0} for A{0} {", "B{0}")]


def _one_of(column, choices):
    return F.regexp_replace(F.element_at(F.array(*map(F.lit, choices)), (F.col(column) % len(choices) + 1).cast("int")), r"\{0\}", F.col(column).cast("string"))


@query(f"""WITH d AS (SELECT doc_id, {[e for e, _, _ in _EXTENDS]}[CAST(doc_id % {len(_EXTENDS)} + 1 AS INTEGER)] AS ext, {[b for _, _, b in _EXTENDS]}[CAST(doc_id % {len(_EXTENDS)} + 1 AS INTEGER)] AS bases FROM documents)
SELECT doc_id || '.' || ext AS file_path, 'A' || doc_id AS name, replace(unnest(string_split(bases, ',')), '{{0}}', CAST(doc_id AS VARCHAR)) AS base, 1 AS line FROM d""")
def classes_made_from_others(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    path = F.concat_ws(".", "doc_id", _one_of("doc_id", [e for e, _, _ in _EXTENDS]))
    return extract.inheritance(extract.lines_of(d.select(path.alias("path"), _one_of("doc_id", [t for _, t, _ in _EXTENDS]).alias("content"))))


@query("""WITH d AS (SELECT doc_id || '.go' AS p, doc_id FROM documents) SELECT p AS file_path, 'first' || doc_id AS caller, 'helper' AS called, 2 AS line FROM d UNION ALL SELECT p, 'first' || doc_id, 'run' || doc_id, 3 FROM d UNION ALL SELECT p, 'second', 'first' || doc_id, 6 FROM d""")
def calls_of_other_languages(spark, sf_dir):
    """Calls belong to the function declared last; keywords, strings and comments call nothing."""
    text = 'func first{0}(x int) {\n\tif helper(x) { say("not(this)") }\n\treturn run{0}(x) // nor(that)\n}\nfunc second() {\n\tfirst{0}(1)\n}\n'
    d = S.table(spark, sf_dir, "documents")
    lines = extract.lines_of(d.select(F.concat(F.col("doc_id"), F.lit(".go")).alias("path"), F.regexp_replace(F.lit(text), r"\{0\}", F.col("doc_id").cast("string")).alias("content")))
    return extract.calls(lines, extract.symbols(lines)).where("called <> 'say'")


#: Python sources out of whole texts: every line is a class with a method and a function in it, a function, or an import, by its number.
_BLOCKS = ("class C{0}(B{0}):\n    def m(self, x, *rest, key=None) -> T{0}:\n        def inner{0}(y):\n            return call{0}(y)\n        return inner{0}(x)", "def f{0}(a):\n    return g{0}(a)", "import m{0}")
_PY = """WITH lines AS (SELECT doc_id || '.py' AS p, i, i % 3 AS k, substring(md5(i || ':' || ls[i + 1]), 1, 8) AS h FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
b AS (SELECT *, 1 + coalesce(sum(CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM lines)"""


def _python(spark, sf_dir):
    marked = lambda x, i: F.substring(F.md5(F.concat_ws(":", i, x)), 1, 8)

    def block(x, i):
        parts = [F.concat_ws("", *(y for k, t in enumerate(b.split("{0}")) for y in ([marked(x, i)] if k else []) + [F.lit(t)])) for b in _BLOCKS]
        return F.when(i % 3 == 0, parts[0]).when(i % 3 == 1, parts[1]).otherwise(parts[2])

    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return S.table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id"), F.lit(".py")).alias("path"), F.array_join(F.transform(lines, block), "\n").alias("content"))


@query(f"""{_PY} SELECT DISTINCT 'File' AS kind, p AS qualified_name, 1 AS line_start, NULL AS parent_name, NULL AS params, NULL AS return_type FROM b
UNION ALL SELECT 'Class', p || '::C' || h, line, NULL, NULL, NULL FROM b WHERE k = 0 UNION ALL SELECT 'Function', p || '::C' || h || '::m', line + 1, 'C' || h, '(self, x, *rest, key)', 'T' || h FROM b WHERE k = 0
UNION ALL SELECT 'Function', p || '::C' || h || '::inner' || h, line + 2, 'C' || h, '(y)', NULL FROM b WHERE k = 0 UNION ALL SELECT 'Function', p || '::f' || h, line, NULL, '(a)', NULL FROM b WHERE k = 1""")
def python_syntax_nodes(spark, sf_dir):
    nodes = extract.parse_python(_python(spark, sf_dir))[0]
    own = F.when(F.col("kind") == "File", F.col("file_path")).otherwise(F.col("qualified_name"))
    return nodes.select("kind", own.alias("qualified_name"), "line_start", "parent_name", "params", "return_type")


@query(f"""{_PY} SELECT DISTINCT * FROM (SELECT 'CONTAINS' AS kind, p AS source_qualified, p || '::C' || h AS target_qualified FROM b WHERE k = 0 UNION ALL SELECT 'CONTAINS', p || '::C' || h, p || '::C' || h || '::m' FROM b WHERE k = 0
UNION ALL SELECT 'CONTAINS', p || '::C' || h, p || '::C' || h || '::inner' || h FROM b WHERE k = 0 UNION ALL SELECT 'CONTAINS', p, p || '::f' || h FROM b WHERE k = 1 UNION ALL SELECT 'INHERITS', p || '::C' || h, 'B' || h FROM b WHERE k = 0
UNION ALL SELECT 'CALLS', p || '::C' || h || '::m', 'inner' || h FROM b WHERE k = 0 UNION ALL SELECT 'CALLS', p || '::C' || h || '::inner' || h, 'call' || h FROM b WHERE k = 0 UNION ALL SELECT 'CALLS', p || '::f' || h, 'g' || h FROM b WHERE k = 1
UNION ALL SELECT 'IMPORTS_FROM', p, 'm' || h FROM b WHERE k = 2)""")
def python_syntax_edges(spark, sf_dir):
    return extract.parse_python(_python(spark, sf_dir))[1].select("kind", "source_qualified", "target_qualified")


#: Sources with functions in functions, three deep, and the whole line of the text in a string: TypeScript of even documents, Rust of odd ones.
_NESTED = (
    'function f{0}(a: number): T{0} {\n  const s = "{1} no({";\n  const g{0} = (b: string): string => {\n    const k{0} = (c) => { return d{0}(c); };\n    return k{0}(b);\n  };\n  /* no{0}(\n  } */ return g{0}(1);\n}',
    'fn f{0}(a: T{0}) -> T{0} {\n    let s = r#"{1} no({"#;\n    fn g{0}(b: u8) -> u8 {\n        fn k{0}(c: u8) -> u8 { d{0}(c) }\n        k{0}(b)\n    }\n    /* no{0}(\n    } */ g{0}(1)\n}',
)
_NESTED_SQL = """WITH b AS (SELECT doc_id || CASE doc_id % 2 WHEN 0 THEN '.ts' ELSE '.rs' END AS p, doc_id % 2 = 0 AS ts, 9 * i AS above, substring(md5(i || ':' || ls[i + 1]), 1, 8) AS h FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"""


def _nested(spark, sf_dir):
    def blocks(shape):
        def block(x, i):
            h = F.substring(F.md5(F.concat_ws(":", i, x)), 1, 8)
            said = F.regexp_replace(x, r'["\\\r]', "")
            return F.replace(F.replace(F.lit(shape), F.lit("{0}"), h), F.lit("{1}"), said)

        return block

    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    made = [F.array_join(F.transform(lines, blocks(t)), "\n") for t in _NESTED]
    even = F.col("doc_id") % 2 == 0
    return S.table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id"), F.when(even, ".ts").otherwise(".rs")).alias("path"), F.when(even, made[0]).otherwise(made[1]).alias("content"))


@query(f"""{_NESTED_SQL} SELECT p AS file_path, 'f' || h AS name, above + 1 AS line_start, above + 9 AS line_end, NULL AS parent_name, CASE WHEN ts THEN '(a: number)' ELSE '(a: T' || h || ')' END AS params, 'T' || h AS return_type FROM b
UNION ALL SELECT p, 'g' || h, above + 3, above + 6, 'f' || h, CASE WHEN ts THEN '(b: string)' ELSE '(b: u8)' END, CASE WHEN ts THEN 'string' ELSE 'u8' END FROM b
UNION ALL SELECT p, 'k' || h, above + 4, above + 4, 'g' || h, CASE WHEN ts THEN '(c)' ELSE '(c: u8)' END, CASE WHEN ts THEN NULL ELSE 'u8' END FROM b""")
def scopes_of_nested_functions(spark, sf_dir):
    """Where functions in functions end, what holds them, what they take and give."""
    nodes = extract.scan_lines(_nested(spark, sf_dir))[0].where("kind <> 'File'")
    return nodes.select("file_path", "name", "line_start", "line_end", "parent_name", "params", "return_type")


@query(f"{_NESTED_SQL} SELECT p AS file_path, 'f' || h AS caller, 'g' || h AS called, above + 8 AS line FROM b UNION ALL SELECT p, 'g' || h, 'k' || h, above + 5 FROM b UNION ALL SELECT p, 'k' || h, 'd' || h, above + 4 FROM b")
def calls_of_nested_functions(spark, sf_dir):
    """Calls by the innermost function; strings and comments of several lines call nothing."""
    found = extract.scan_lines(_nested(spark, sf_dir))[1].where("kind = 'CALLS'")
    return found.select("file_path", F.regexp_extract("source_qualified", "::(.*)$", 1).alias("caller"), F.col("target_qualified").alias("called"), "line")


# Budgets and windows


@query(f"WITH {S.CHANGES} SELECT date_trunc('hour', changed_at) AS hour, change_type, count(*) AS n FROM changes GROUP BY 1, 2")
def changes_by_hour(spark, sf_dir):
    from loomstore.streaming.watch import changes_by_window

    return changes_by_window(S.changes(spark, sf_dir)).select(F.col("window.start").alias("hour"), "change_type", "n")


@query(f"WITH {S.TURNS} SELECT session_id, turn_index FROM (SELECT *, sum(greatest(1, length(content) // 4)) OVER (PARTITION BY session_id ORDER BY turn_index DESC ROWS UNBOUNDED PRECEDING) AS running FROM turns) WHERE running <= 300")
def budget_of_estimates(spark, sf_dir):
    """A budget where every turn costs one token at least."""
    t = S.turns(spark, sf_dir)
    return budget.session_budget(t.withColumn("token_est", T.token_estimate(F.col("content"), 1)), 300).select("session_id", "turn_index")


@query("SELECT doc_id, text[1:400] AS cut, CASE WHEN length(text) > 2000 THEN rtrim(text[1:2000]) || chr(10) || '…(truncated)' ELSE text END AS trimmed FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def trimmed_to_tokens(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.substring(t, 1, 400).alias("cut"), T.trim_to_tokens(t, 500).alias("trimmed"))


# Trees, packs, totals


def _lined(spark, sf_dir):
    """The graph with a line for each node: customers and suppliers by the size of their balance."""
    nodes = S.nodes(spark, sf_dir)
    of = lambda t, p, k, c: S.table(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("qualified_name"), F.floor(F.abs(F.col(c)) / 100).cast("int").alias("line_start"))
    return nodes.join(of("customer", "C::", "c_custkey", "c_acctbal").unionByName(of("supplier", "S::", "s_suppkey", "s_acctbal")), "qualified_name", "left")


@query(f"""WITH RECURSIVE {S.NODES}, {S.EDGES}, lines AS (SELECT 'C::' || c_custkey AS node, CAST(floor(abs(c_acctbal) / 100) AS INTEGER) AS line FROM customer UNION ALL SELECT 'S::' || s_suppkey, CAST(floor(abs(s_acctbal) / 100) AS INTEGER) FROM supplier),
named AS (SELECT qualified_name AS node, name, coalesce(line, 0) AS line FROM nodes LEFT JOIN lines ON node = qualified_name),
t AS (SELECT 'R::1' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, CAST([] AS STRUCT(line INTEGER, name VARCHAR, node VARCHAR)[]) AS place
  UNION ALL SELECT e.target_qualified, t.node, depth + 1, list_append(place, struct_pack(line := n.line, name := n.name, node := n.node)) FROM t JOIN edges e ON e.source_qualified = t.node AND e.kind = 'CONTAINS' JOIN named n ON n.node = e.target_qualified WHERE depth < 8)
SELECT node, parent, depth, row_number() OVER (ORDER BY place) AS number FROM t""")
def subtree_in_preorder(spark, sf_dir):
    """The whole tree below a node, in the order that it is read in."""
    rows = graph.tree(_lined(spark, sf_dir), S.edges(spark, sf_dir), "R::1", most=None)
    return rows.select("node", "parent", "depth", F.row_number().over(Window.orderBy("place")).cast("bigint").alias("number"))


_PACKED = f"""{S.TURNS}, {S.FILES}, {S.CHANGES}, given AS (
  SELECT 'turns' AS section, row_number() OVER (ORDER BY session_id, turn_index) AS rank, token_est AS est FROM turns
  UNION ALL SELECT 'files', row_number() OVER (ORDER BY path), length(path) // 4 FROM files UNION ALL SELECT 'changes', row_number() OVER (ORDER BY changed_at DESC, id DESC), 60 FROM changes WHERE id < 40),
est AS (SELECT section, rank, greatest(est, 1) AS est, CASE section WHEN 'turns' THEN 1 WHEN 'files' THEN 2 ELSE 3 END AS o, CASE section WHEN 'turns' THEN 1500 WHEN 'files' THEN 300 ELSE 1200 END AS quota FROM given),
sums AS (SELECT *, sum(est) OVER (PARTITION BY section ORDER BY rank) <= quota AS first FROM est),
room AS (SELECT *, 3000 - sum(CASE WHEN first THEN est ELSE 0 END) OVER () - coalesce(sum(est) OVER (PARTITION BY first ORDER BY o, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM sums)"""


@query(f"WITH {_PACKED} SELECT section, rank, CAST(CASE WHEN NOT first AND room < est THEN room END AS BIGINT) AS cut FROM room WHERE first OR room > 0")
def pack_under_a_budget(spark, sf_dir):
    """Sections with shares of one budget, and what one leaves for the others."""
    place = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank")
    turns = S.turns(spark, sf_dir).select(F.lit("turns").alias("section"), place("session_id", "turn_index"), F.col("token_est").cast("bigint").alias("est"))
    paths = S.files(spark, sf_dir).select(F.lit("files").alias("section"), place("path"), F.floor(F.length("path") / 4).alias("est"))
    late = S.changes(spark, sf_dir).where("id < 40").select(F.lit("changes").alias("section"), place(F.col("changed_at").desc(), F.col("id").desc()), F.lit(60).cast("bigint").alias("est"))
    rows = budget.pack(turns.unionByName(paths).unionByName(late), {"turns": 0.5, "files": 0.1, "changes": 0.4}, 3000)
    return rows.select("section", "rank", F.col("cut").cast("bigint").alias("cut"))


@query("SELECT 'src/' || source AS folder, count(*) AS n FROM documents GROUP BY 1")
def files_by_folder(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return graph.folder_counts(d.select(F.lit("File").alias("kind"), F.concat(F.lit("src/"), "source", F.lit("/"), "doc_id").alias("file_path")))


@query(f"WITH {S.NODES}, shown AS (SELECT file_path, least(count(*) FILTER (WHERE parent_name IS NULL AND kind <> 'File'), 3) AS n FROM nodes GROUP BY file_path) SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS symbols, 'sql' AS languages FROM shown")
def overview_totals(spark, sf_dir):
    """Files, symbols as shown, and languages of the overview."""
    nodes = S.nodes(spark, sf_dir).withColumns({"line_start": F.lit(1), "line_end": F.lit(9), "language": F.lit("sql")})
    return graph.overview_totals(nodes, S.files(spark, sf_dir), 3).withColumn("languages", F.array_join("languages", ","))


@query(f"WITH {S.SESSIONS} SELECT id, CASE WHEN llm_name = 'cursor' THEN 'purple' WHEN llm_name = 'claude' THEN 'deep-orange' ELSE 'blue' END AS colour FROM sessions")
def colours_of_sessions(spark, sf_dir):
    return S.sessions(spark, sf_dir).select("id", T.tool_colour(F.col("llm_name")).alias("colour"))
