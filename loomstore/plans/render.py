"""Strings for people and prompts, out of small results: exports, packs, hand-offs, overviews.

Spark does the queries; what comes to the driver is bounded by their limits.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions.text import token_estimate
from loomstore.operators import budget, conversations, files, graph


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def trim(text: str, tokens: int) -> str:
    return text if tokens <= 0 or len(text) <= tokens * 4 else text[: tokens * 4].rstrip() + "\n…(truncated)"


def to_json(df: DataFrame) -> str:
    """A JSON array of the rows of a small result."""
    return "[" + ",\n".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()) + "]"


def _meta(meta: DataFrame) -> dict[str, str]:
    return {r["key"]: r["value"] for r in meta.select("key", "value").collect()}


def _open(sessions: DataFrame) -> list:
    return sessions.where("status in ('active', 'interrupted')").orderBy(F.col("started_at").desc(), "id").collect()


def export_json(path: str, meta: DataFrame, file_rows: DataFrame, sessions: DataFrame, changes: DataFrame) -> None:
    """Facts, open sessions and the last changes as one document, and the files beside it as JSON lines: they can be many."""
    spark = meta.sparkSession
    newest = changes.orderBy(F.col("changed_at").desc(), F.col("id").desc()).limit(50)
    head = {"meta": _meta(meta), "active_sessions": [r.asDict() for r in _open(sessions)], "recent_changes": [r.asDict() for r in newest.collect()]}
    spark.createDataFrame([(json.dumps(head, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/project")
    file_rows.select("path", "file_type", "line_count", "purpose", "tags").write.mode("overwrite").json(f"{path}/files")


def markdown_lines(meta: DataFrame, file_rows: DataFrame, sessions: DataFrame, changes: DataFrame, generated: str) -> DataFrame:
    """(part, a, b, c, line): everything, for people, in the order of the other columns; files by type, larger types first."""
    m = _meta(meta)
    rows = file_rows.select(F.coalesce("file_type", F.lit("other")).alias("b"), F.col("path").alias("c"), "purpose")
    kinds = rows.groupBy("b").agg(F.count("*").alias("n"))
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = ["# Project context", "", f"**Generated**: {generated}  ", *[f"**{k.title()}**: {m.get(k, 'unknown')}  " for k in ("name", "language", "framework")], f"**Total files**: {total}", ""]
    if opened := _open(sessions):
        out += ["## Open sessions", ""]
        for s in opened:
            out.append(f"### [{s['llm_name']}] `{s['id']}` ({s['status']})")
            out += [f"**{label}**: {s[c]}" for label, c in (("Working on", "working_on"), ("Summary", "summary")) if s[c]] + [""]
    out += ["## Files", ""]
    newest = changes.orderBy(F.col("changed_at").desc(), F.col("id").desc()).limit(50).collect()
    after = ["## Recent changes", "", "| File | Type | When | Session |", "|---|---|---|---|"] if newest else []
    after += [f"| `{c['file_path']}` | {c['change_type']} | {str(c['changed_at'] or '')[:16]} | {c['session_id'] or ''} |" for c in newest]
    fixed = [(part, k, "", "", line) for part, lines in ((0, out), (2, after)) for k, line in enumerate(lines)]
    told = meta.sparkSession.createDataFrame(fixed, "part int, a bigint, b string, c string, line string")
    line = F.concat(F.lit("- `"), "c", F.lit("`"), F.when(F.coalesce("purpose", F.lit("")) != "", F.concat(F.lit(": "), "purpose")).otherwise(""))
    listed = rows.join(kinds, "b").select(F.lit(1).alias("part"), (-F.col("n")).alias("a"), "b", "c", line.alias("line"))
    heads = kinds.select(F.lit(1).alias("part"), (-F.col("n")).alias("a"), "b", F.lit("").alias("c"), F.concat(F.lit("### ."), "b", F.lit(" ("), "n", F.lit(" files)")).alias("line"))
    ends = kinds.select(F.lit(1).alias("part"), (-F.col("n")).alias("a"), "b", F.lit("\U0010ffff").alias("c"), F.lit("").alias("line"))
    return told.unionByName(heads).unionByName(listed).unionByName(ends)


_ORDER = ["part", "a", "b", "c", "line"]


def export_markdown(meta: DataFrame, file_rows: DataFrame, sessions: DataFrame, changes: DataFrame, generated: str) -> str:
    """`markdown_lines` as one string; `write_markdown` is for indexes too large for one."""
    return "\n".join(r["line"] for r in markdown_lines(meta, file_rows, sessions, changes, generated).orderBy(*_ORDER).toLocalIterator())


def write_markdown(path: str, meta: DataFrame, file_rows: DataFrame, sessions: DataFrame, changes: DataFrame, generated: str) -> None:
    """`markdown_lines` as text files below a path, whose names are in the order of their lines."""
    rows = markdown_lines(meta, file_rows, sessions, changes, generated)
    rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def export_context(meta: DataFrame, file_rows: DataFrame, sessions: DataFrame) -> str:
    """The compact form for a prompt: interrupted sessions, files with a purpose, types."""
    m = _meta(meta)
    out = [f"# {m.get('name', 'project')}: context", "", f"> Language: {m.get('language', '?')} | Framework: {m.get('framework', '?')} | Files: {file_rows.count()}", ""]
    stopped = [s for s in _open(sessions) if s["status"] == "interrupted"]
    if stopped:
        out.append("## Interrupted sessions")
        for s in stopped:
            out.append(f"- **{s['llm_name']}** `{s['id']}`: {s['working_on'] or '(no task)'}")
            if s["summary"]:
                out.append(f"  Summary: {s['summary']}")
        out.append("")
    told = file_rows.where("purpose is not null and purpose <> ''")
    if n := told.count():
        out += ["## Key files", *[f"- `{r['path']}`: {r['purpose']}" for r in files.export_files(file_rows).collect()], *([f"- and {n - 60} more"] if n > 60 else []), ""]
    return "\n".join([*out, "## Files by type", *[f"- `.{r['file_type']}`: {r['n']} files" for r in files.type_counts(file_rows, 12).collect()]])


def handoff_markdown(sessions: DataFrame, turns: DataFrame, tokens: int, session_id: str | None = None, thread_id: str | None = None) -> str:
    """What a session, a thread or the latest session left behind, within a budget."""
    rows = conversations.handoff(sessions, turns, tokens, session_id, thread_id).select("session_id", "role", "content").collect()
    out = [f"# Handoff: {thread_id or session_id or (rows[0]['session_id'] if rows else 'no session')}", "", f"{len(rows)} turns, about {sum(estimate(r['content'] or '') for r in rows)} tokens", ""]
    return "\n".join(out + [f"**{r['role']}**: {r['content']}\n" for r in rows])


def session_markdown(session, first_files: Iterable[str], turns: Iterable, last: int = 10) -> str:
    shown = list(first_files)
    out = [f"# Session {session['id']} ({session['status']})", f"LLM: {session['llm_name']}", f"Task: {session['working_on'] or '(none)'}", "", *[f"- {p}" for p in shown[:30]], *([f"- and {len(shown) - 30} more"] if len(shown) > 30 else []), ""]
    return "\n".join(out + [f"**{t['role']}**: {t['content'][:800]}" for t in list(turns)[-last:]])


def neighbourhood_markdown(centre: str, rows: Iterable) -> str:
    titles = {"out": "Points to", "in": "Pointed to by", "sibling": "Beside it", "second": "Two steps away"}
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["role"], []).append(f"- {r['kind']} `{r['other']}`")
    return "\n".join([f"# {centre}", *[line for role, title in titles.items() if role in by for line in ("", f"## {title}", *by[role])]])


def subtree_text(rows: Iterable) -> str:
    """Rows of `graph.tree`, in their order, each as deep as it lies."""
    return "\n".join("  " * r["depth"] + r["node"] for r in rows)


def find_markdown(query: str, hits: Iterable) -> str:
    out = [f"# Results for {query}"]
    for i, h in enumerate(hits, 1):
        out.append(f"{i}. [{h['source']}] **{h['title']}** ({h['score']:.3f})" + (f" `{h['path']}`" if h["path"] else ""))
        if h["snippet"]:
            out.append(f"   {h['snippet']}")
    return "\n".join(out) if len(out) > 1 else f"No results for {query}"


def overview_markdown(nodes: DataFrame, file_rows: DataFrame, tokens: int = 2000) -> str:
    """Folders with files and symbols; without symbols, then without files, then cut, until it fits the budget."""
    most = max(1, tokens)  # a file, and a folder, takes a token at least
    shown = graph.overview(nodes, file_rows)
    folders = graph.folder_counts(nodes)
    total = folders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = folders.orderBy("folder").limit(most).collect()
    inside: dict[str, list] = {}
    for r in shown.withColumn("folder", F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)).orderBy("folder", "file_path").limit(most).collect():
        inside.setdefault(r["folder"] or ".", []).append(r)

    def text(with_files: bool, with_symbols: bool) -> str:
        out = [f"# Overview: {total} files"]
        for folder, n in counts:
            out.append(f"{folder}/ ({n})")
            for r in inside.get(folder, ()) if with_files else ():
                out.append(f"  {r['file_path'].rpartition('/')[2]}" + (f" ({r['lines']} lines)" if r["lines"] else "") + (f": {', '.join(r['symbols'])}" if with_symbols and r["symbols"] else ""))
        return "\n".join(out)

    for form in ((True, True), (True, False), (False, False)):
        if estimate(made := text(*form)) <= tokens:
            return made
    return trim(made, tokens)


#: Sections of a context pack, their titles and shares of what the heading leaves.
SECTIONS = {"hits": ("Results", 0.3), "turns": ("Last turns", 0.4), "overview": ("Files", 0.2), "changes": ("Last changes", 0.1)}


def context_pack(sessions: DataFrame, turns: DataFrame, changes: DataFrame, tokens: int = 4000, session_id: str | None = None, last: int = 10, note: str = "", hits: DataFrame | None = None, overview: DataFrame | None = None) -> str:
    """The session, hits of a query, its last turns, files with symbols and the last changes, under one limit of four characters a token.

    Each section has a share; what one leaves goes to the others, and the pack is cut where the budget ends.
    """
    chosen = sessions.where(F.col("id") == session_id) if session_id else sessions.orderBy((F.col("status") == "active").desc(), F.col("started_at").desc(), "id").limit(1)
    out = ["# Context pack"]
    line = lambda section, rank, text: (F.lit(section).alias("section"), rank.cast("bigint").alias("rank"), text.alias("text"))
    parts = []
    for s in chosen.collect():
        out += ["", "## Session", f"`{s['id']}` ({s['llm_name']}, {s['status']}): {s['working_on'] or ''}"]
        own = budget.last_turns(turns.where(F.col("session_id") == s["id"]), last)
        parts.append(own.select(*line("turns", -F.col("turn_index"), F.concat(F.lit("**"), "role", F.lit("**: "), F.substring("content", 1, 600)))))
    place = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  of a limited number of rows
    if hits is not None:
        parts.append(hits.select(*line("hits", place(F.col("score").desc(), "source", "key"), F.concat(F.lit("- ["), "source", F.lit("] "), "title", F.lit(": "), F.substring(F.coalesce("snippet", F.lit("")), 1, 220)))))
    if overview is not None:
        few = overview.orderBy("file_path").limit(max(1, tokens))
        parts.append(few.select(*line("overview", place("file_path"), F.concat(F.lit("- `"), "file_path", F.lit("` "), F.array_join("symbols", ", ")))))
    newest = changes.orderBy(F.col("changed_at").desc(), F.col("id").desc()).limit(15)
    parts.append(newest.select(*line("changes", place(F.col("changed_at").desc(), F.col("id").desc()), F.concat(F.lit("- "), "change_type", F.lit(" `"), "file_path", F.lit("`")))))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # A line break belongs to its line, and a title to the heading of its section
    heads = sum(len(f"\n\n## {t}") for t, _ in SECTIONS.values())
    room = max(1, tokens - (len("\n".join(out)) + heads + len(note) + 7) // 4)
    rows = rows.withColumn("est", F.ceil((F.length("text") + 1) / 4))
    kept = budget.pack(rows, {k: share for k, (_, share) in SECTIONS.items()}, room).collect()  # `room` tokens at most
    for k, (title, _) in SECTIONS.items():
        own = sorted((r for r in kept if r["section"] == k), key=lambda r: r["rank"])
        texts = [r["text"] if r["cut"] is None else r["text"][: 4 * r["cut"] - 1] for r in own]
        out += ["", f"## {title}", *(reversed(texts) if k == "turns" else texts)] if own else []
    return trim("\n".join(out + ([note] if note else [])), tokens)


def impact_text(impacted: DataFrame, edges: DataFrame) -> str:
    rows = impacted.orderBy("depth", "qualified_name").limit(500).collect()
    names = impacted.select(F.col("qualified_name").alias("node"))
    among = graph.compact_context(impacted.sparkSession.createDataFrame([], "kind string, name string, file_path string, line_start int, params string, return_type string, is_test boolean"), graph.edges_among(edges, names))[1].collect()
    files_ = sorted({r["file_path"] for r in rows if r["file_path"]})
    return "\n".join([f"{len(rows)} nodes in {len(files_)} files", *[f"- {p}" for p in files_], *[f"  {e['summary']}" for e in among]])
