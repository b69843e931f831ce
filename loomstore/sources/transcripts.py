"""Transcripts of several tools, as turns: (source_path, session_key, pos, role, content) and session facts.

Each reader takes a DataFrame of files or lines and is lazy.  JSON of changing
shape is read as VARIANT, so a content that is a string, a list of blocks or
something else is told apart without errors; lines that are no JSON are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstore.functions.text import folder_slug, is_preamble, one_line, shorten
from loomstore.operators.conversations import imported_id
from loomstore.plans.schemas import ROLES

# Inputs of tools that hold a path, and extensions of paths in free text.
PATH_FIELDS = ["path", "file_path", "target_file", "filePath", "relativePath", "relative_path", "notebook_path", "file"]
PATH_EXTENSIONS = "py ts tsx js jsx json md html css yml yaml toml rs go java c h hpp cpp sh ps1 sql xml ini cfg lock".split()
PATHS = r"""(?i)((?:[a-z]:\\(?:[^\\'",<>|:*?\n]+\\)+[^\\'",<>|:*?\n]+?|(?:\.?/)?(?:[\w\-.]+/)+[\w\-.]+)\.(?:""" + "|".join(PATH_EXTENSIONS) + "))"
MOST_ROLLOUTS = 2000


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, content) of every file below a path."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("source_path"), F.col("value").alias("content"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_path, line_no, line) of every line below a path. Long files are read in splits.

    Lines of a split are numbered as they are read; the split's place in its file, above that, keeps the file's order.
    `line_no` rises along a file and has gaps.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("*", F.monotonically_increasing_id().alias("n"), F.input_file_name().alias("source_path"), F.input_file_block_start().alias("start"))
    # Less than 2**33 lines a task, as the id has it; splits start a byte apart at least, and a file has less than 2**40 bytes
    in_task = F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    line_no = F.struct("start", in_task.alias("n"))
    return rows.select("source_path", line_no.alias("line_no"), F.col("value").alias("line")).where(F.trim("value") != "")


def json_array(files: DataFrame) -> DataFrame:
    """A list of {role, content}. Another shape, or an unknown role, is an error that names the file; a null content has no turns."""
    v = F.try_parse_json(F.col("content"))
    ok = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))
    rows = files.select("source_path", F.when(ok | F.col("content").isNull(), F.from_json("content", "array<struct<role:string,content:string>>")).otherwise(F.raise_error(F.concat(F.lit("not a JSON array: "), "source_path")).cast("array<struct<role:string,content:string>>")).alias("turns"))
    rows = rows.select("source_path", F.posexplode("turns").alias("pos", "t"))
    role = F.when(F.col("t.role").isin(ROLES), F.col("t.role")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("invalid role in"), "source_path", F.lit("turn"), "pos")))
    return rows.select("source_path", F.col("source_path").alias("session_key"), "pos", role.alias("role"), F.coalesce("t.content", F.lit("")).alias("content"))


# Fixed value: how a file marks the role of what follows.
MARKER = r"(?i)<!--\s*role:\s*(user|assistant|system)\s*-->"


def markdown(files: DataFrame) -> DataFrame:
    """Turns between role markers; empty ones go; a file without markers is one turn of the assistant."""
    roles = F.regexp_extract_all("content", F.lit(MARKER), F.lit(1))
    parts = F.slice(F.split("content", MARKER, -1), 2, 1 << 30)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    made = F.filter(F.zip_with(roles, parts, lambda r, c: F.struct(F.lower(r).alias("role"), strip(c).alias("content"))), lambda t: t["content"] != "")
    alone = F.array(F.struct(F.lit("assistant").alias("role"), strip(F.col("content")).alias("content")))
    rows = files.select("source_path", F.posexplode(F.when(F.size(roles) > 0, made).otherwise(alone)).alias("pos", "t"))
    return rows.select("source_path", F.col("source_path").alias("session_key"), "pos", "t.role", "t.content")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _blocks(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _texts(blocks: Column, kinds: list[str]) -> Column:
    """The texts of blocks of these kinds, by line."""
    kept = F.filter(blocks, lambda b: _text(b, "$.type").isin(kinds))
    return F.array_join(F.filter(F.transform(kept, lambda b: _strip(F.coalesce(_text(b, "$.text"), F.lit("")))), lambda x: x != ""), "\n")


def _numbered(rows: DataFrame) -> DataFrame:
    """Keeps turns with content, numbered from 0 in each file."""
    pos = F.row_number().over(Window.partitionBy("source_path").orderBy("line_no")) - 1
    return rows.where("content <> ''").withColumn("pos", pos)


def claude(rows: DataFrame) -> DataFrame:
    """Lines of a main conversation: user and assistant, texts alone."""
    v = F.col("v")
    rows = rows.withColumn("v", F.try_parse_json("line")).where(v.isNotNull())
    side = F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False))
    rows = rows.where(_text(v, "$.type").isin("user", "assistant") & ~side & _text(v, "$.message.role").isin("user", "assistant"))
    kind = _kind(v, "$.message.content")
    content = F.when(kind == "STRING", _strip(_text(v, "$.message.content"))).when(kind.startswith("ARRAY"), _texts(_blocks(v, "$.message.content"), ["text"]))
    key = F.coalesce(_text(v, "$.sessionId"), F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    rows = rows.select("source_path", "line_no", key.alias("session_key"), _text(v, "$.message.role").alias("role"), content.alias("content"))
    return _numbered(rows).select("source_path", "session_key", "pos", "role", "content")


def _cursor_block(b: Column, inner: bool = False) -> Column:
    result = F.coalesce(_text(b, "$.content"), F.lit(""))
    if not inner:
        listed = F.array_join(F.filter(F.transform(_blocks(b, "$.content"), lambda x: _cursor_block(x, True)), lambda x: x != ""), "\n")
        result = F.when(_kind(b, "$.content").startswith("ARRAY"), listed).otherwise(result)
    kind = _text(b, "$.type")
    return (
        F.when(kind == "text", _strip(F.coalesce(_text(b, "$.text"), F.lit(""))))
        .when(kind == "tool_use", F.concat(F.lit("[tool_use: "), F.coalesce(_text(b, "$.name"), F.lit("tool")), F.lit("]")))
        .when(kind == "tool_result", F.concat(F.lit("[tool_result] "), F.substring(result, 1, 400)))
        .otherwise("")
    )


def cursor(rows: DataFrame) -> DataFrame:
    """Lines of role and message; tool uses are named, their results cut. Adds `paths`, from the tools' inputs."""
    v = F.col("v")
    rows = rows.withColumn("v", F.try_parse_json("line")).where(v.isNotNull())
    rows = rows.where(_text(v, "$.role").isin(ROLES) & _kind(v, "$.message").startswith("OBJECT"))
    kind, blocks = _kind(v, "$.message.content"), _blocks(v, "$.message.content")
    content = F.when(kind == "STRING", _strip(_text(v, "$.message.content"))).when(kind.startswith("ARRAY"), _strip(F.array_join(F.filter(F.transform(blocks, lambda b: _cursor_block(b)), lambda x: x != ""), "\n"))).otherwise("")
    uses = F.filter(blocks, lambda b: _text(b, "$.type") == "tool_use")
    paths = F.flatten(F.transform(uses, lambda b: F.array_compact(F.array(*[F.when(_kind(b, f"$.input.{f}") == "STRING", F.nullif(_text(b, f"$.input.{f}"), F.lit(""))) for f in PATH_FIELDS]))))
    stem = F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    rows = rows.select("source_path", "line_no", stem.alias("session_key"), _text(v, "$.role").alias("role"), content.alias("content"), paths.alias("paths"))
    return _numbered(rows).select("source_path", "session_key", "pos", "role", "content", "paths")


def codex(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, headers) of rollouts; turns have `paths` found in their texts, headers (source_path, id, started_at, cwd, llm_name, call_paths)."""
    v = F.col("v")
    rows = rows.withColumn("v", F.try_parse_json("line")).where(v.isNotNull())
    head = rows.where(_text(v, "$.type") == "session_meta").groupBy("source_path").agg(F.min_by(F.struct(_text(v, "$.payload.id").alias("id"), _text(v, "$.payload.timestamp").alias("started_at"), _text(v, "$.payload.cwd").alias("cwd"), _text(v, "$.payload.cli_version").alias("version")), "line_no").alias("h"))
    items = rows.where(_text(v, "$.type") == "response_item")
    calls = items.where(_text(v, "$.payload.type").isin("function_call", "custom_tool_call")).withColumn("arguments", _text(v, "$.payload.arguments"))
    values = F.map_values(F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>"))
    strings = F.transform(F.filter(values, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    blob = F.coalesce(F.array_join(strings, "\n"), F.col("arguments"), F.lit(""))
    call_paths = calls.select("source_path", F.explode(F.regexp_extract_all(blob, F.lit(PATHS), F.lit(1))).alias("p")).groupBy("source_path").agg(F.array_sort(F.collect_set("p")).alias("call_paths"))
    said = items.where(~F.coalesce(_text(v, "$.payload.type").isin("function_call", "custom_tool_call"), F.lit(False)) & _text(v, "$.payload.role").isin(ROLES))
    kind, blocks = _kind(v, "$.payload.content"), _blocks(v, "$.payload.content")
    one = lambda b: F.when(_text(b, "$.type").isin("input_text", "output_text", "text"), _strip(F.coalesce(_text(b, "$.text"), F.lit("")))).when(_text(b, "$.type") == "image", "[image]").otherwise("")
    content = F.when(kind == "STRING", _strip(_text(v, "$.payload.content"))).when(kind.startswith("ARRAY"), F.array_join(F.filter(F.transform(blocks, one), lambda x: x != ""), "\n")).otherwise("")
    stem = F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    turns = said.select("source_path", "line_no", _text(v, "$.payload.role").alias("role"), content.alias("content")).join(head.select("source_path", F.col("h.id").alias("id")), "source_path", "left")
    turns = _numbered(turns.withColumn("session_key", F.coalesce("id", stem))).select("source_path", "session_key", "pos", "role", "content", F.array_distinct(F.regexp_extract_all("content", F.lit(PATHS), F.lit(1))).alias("paths"))
    version = F.when(F.coalesce("h.version", F.lit("")) != "", F.concat(F.lit("codex-"), "h.version")).otherwise("codex")
    headers = turns.select("source_path").distinct().join(head, "source_path", "left").join(call_paths, "source_path", "left").select("source_path", "h.id", "h.started_at", "h.cwd", version.alias("llm_name"), F.coalesce("call_paths", F.array().cast("array<string>")).alias("call_paths"))
    return turns, headers


def newest_rollouts(files: DataFrame, most: int = MOST_ROLLOUTS) -> DataFrame:
    return files.where(F.col("source_path").rlike(r"/rollout-[^/]*\.jsonl$")).orderBy(F.col("source_path").desc()).limit(most)


def same_folder(a: Column, b: Column) -> Column:
    norm = lambda c: F.rtrim(F.lower(c), F.lit("/\\"))
    return F.coalesce(norm(a) == norm(b), F.lit(False))


def sessions_of(turns: DataFrame, tool: str, llm_name: Column | None = None) -> DataFrame:
    """(id, thread_id, title, source_tool, source_id, source_path, llm_name, working_on, turn_count, files_touched) of parsed turns."""
    question = F.when((F.col("role") == "user") & ~is_preamble(F.col("content")), F.col("pos"))
    paths = F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))) if "paths" in turns.columns else F.array().cast("array<string>")
    per = turns.groupBy("session_key").agg(F.min("source_path").alias("source_path"), F.min_by(F.substring("content", 1, 140), question).alias("first"), F.count("*").alias("turn_count"), paths.alias("files_touched"))
    working = F.coalesce(shorten(one_line(F.col("first")), 100), F.lit(""))
    title = F.when(working != "", F.substring(F.regexp_replace(working, r"\s+", " "), 1, 120)).otherwise(F.concat(F.lit(f"{tool} session "), "session_key"))
    t = F.lit(tool)
    return per.select(imported_id(t, F.col("session_key")).alias("id"), imported_id(t, F.col("session_key"), "thread-").alias("thread_id"), title.alias("title"), t.alias("source_tool"), F.col("session_key").alias("source_id"), "source_path", (llm_name if llm_name is not None else t).alias("llm_name"), working.alias("working_on"), "turn_count", "files_touched")


def llm_of_file(path: Column) -> Column:
    """The LLM that a transcript's file name starts with, else unknown."""
    stem = F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    dated, first = F.regexp_extract(stem, r"^([a-zA-Z][a-zA-Z0-9_]*)[-_]\d", 1), F.regexp_extract(stem, r"^(\p{L}[^-_]*)", 1)
    return F.lower(F.coalesce(F.nullif(dated, F.lit("")), F.nullif(first, F.lit("")), F.lit("unknown")))


def relative_to(path: Column, folder: Column) -> Column:
    """The path below the folder, with forward slashes; null outside it."""
    p, f = F.translate(path, "\\", "/"), F.concat(F.rtrim(F.translate(folder, "\\", "/"), F.lit("/")), F.lit("/"))
    return F.when(folder.isNull(), path).when(F.startswith(F.lower(p), F.lower(f)), F.substr(p, F.length(f) + 1))


#: Readers by tool; tools whose stores cannot be read give no rows.
READERS = {"claude": claude, "cursor": cursor, "codex": lambda rows: codex(rows)[0], "aider": markdown}
EMPTY_TOOLS = ["continue", "copilot", "vscode", "kilocode"]
TURNS = "source_path string, session_key string, pos int, role string, content string, paths array<string>, llm_name string, started_at timestamp"


def read(spark: SparkSession, tool: str, path: str, project: str | None = None) -> DataFrame:
    """(TURNS) of a tool's transcripts below a path, for any tool of READERS and EMPTY_TOOLS; of a project alone if one is given.

    A cursor transcript is a project's if it lies below a folder of the project's slug, a codex rollout if it was run in
    the project's folder; of rollouts the newest MOST_ROLLOUTS are read.  Paths that are not in the project go.
    """
    if tool in EMPTY_TOOLS:
        return spark.createDataFrame([], TURNS)
    if tool not in READERS:
        raise ValueError(f"unknown tool {tool!r}")
    if tool == "codex":
        named = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("source_path"))
        chosen = [r["source_path"] for r in newest_rollouts(named).collect()]  # MOST_ROLLOUTS at most
        if not chosen:
            return spark.createDataFrame([], TURNS)
        turns, heads = codex(lines(spark, chosen))
        if project:
            heads = heads.where(same_folder(F.col("cwd"), F.lit(project)))
        heads = heads.select("source_path", "llm_name", F.try_to_timestamp("started_at").alias("started_at"), "call_paths")
        rows = turns.join(heads, "source_path").withColumn("paths", F.array_union("paths", "call_paths")).drop("call_paths")
    else:
        rows = READERS[tool](whole_files(spark, path) if tool == "aider" else lines(spark, path))
        if tool == "cursor" and project:
            rows = rows.where(F.array_contains(F.split(F.lower("source_path"), "/"), F.lower(folder_slug(F.lit(project)))))
        rows = rows.withColumns({"llm_name": F.lit(tool), "started_at": F.lit(None).cast("timestamp")})
        rows = rows if "paths" in rows.columns else rows.withColumn("paths", F.array().cast("array<string>"))
    if project:
        inside = F.transform("paths", lambda p: F.when(p.rlike(r"^(?:/|[A-Za-z]:)"), relative_to(p, F.lit(project))).otherwise(F.translate(p, "\\", "/")))
        rows = rows.withColumn("paths", F.array_distinct(F.array_compact(inside)))
    return rows.select(*(c.split()[0] for c in TURNS.split(", ")))
