"""Rows out of source texts: purposes, symbols and imports by line, and Python's syntax tree.

Line scanners are regular expressions over exploded lines and stay in the JVM, but for
those of declarations with their scopes, which go with the brackets of the whole file.
Python files go through the standard library's parser in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions.text import basename, extension, slashes
from loomstore.operators import scopes

# The language of a file by its extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "csharp", ".kt": "kotlin", ".swift": "swift", ".php": "php",
}

# What a line declares, tried in order; group 1 is the name.
_JS = [("Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*[\(:]"), ("Class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+(\w+)\s*=\s*+(?:async\s*+)?[\(\w]")]
SYMBOLS = {
    "python": [("Class", r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*class\s+(\w+)"), ("Function", r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*def\s+(\w+)")],
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "go": [("Function", r"^func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(")],
    "rust": [("Function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\("), ("Class", r"^\s*(?:pub\s+)?(?:unsafe\s+)?struct\s+(\w+)")],
    "java": [("Class", r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:class|interface|enum)\s+(\w+)")],
    "csharp": [("Class", r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:partial\s+)?(?:class|interface|struct|record)\s+(\w+)")],
    "ruby": [("Class", r"^\s*class\s+(\w+)"), ("Function", r"^\s*def\s+(\w+)")],
    "php": [("Class", r"^\s*(?:abstract\s+)?(?:final\s+)?class\s+(\w+)"), ("Function", r"^\s*function\s+(\w+)\s*\(")],
    "cpp": [("Class", r"^\s*(?:class|struct)\s+(\w+)")],
    "c": [("Function", r"^\s*(?:static\s+)?(?:inline\s+)?\w[\w\s\*]+\s+(?!(?:if|else|for|while|switch|return)\s*\()(\w+)\s*\([^)]*\)\s*\{")],
}
# Beginnings of import lines.
IMPORTS = {"python": r"^(?:import|from) ", "javascript": r"^import |export .* from ", "typescript": r"^import |export .* from ", "tsx": r"^import |export .* from ", "go": r"^import ", "rust": r"^use "}
# What a class is made from, where a line says so; group 1 is the list of names.
BASES = {
    "javascript": r"\bclass\s+\w+\s+extends\s+([\w.]+)", "typescript": r"\b(?:class|interface)\s+\w+(?:<[^>]*>)?\s+(?:extends|implements)\s+([\w.,\s]+)", "tsx": r"\bclass\s+\w+(?:<[^>]*>)?\s+extends\s+([\w.]+)",
    "java": r"\b(?:class|interface|enum)\s+\w+(?:<[^>]*>)?\s+(?:extends|implements)\s+([\w.,\s]+)", "csharp": r"\b(?:class|interface|struct|record)\s+\w+(?:<[^>]*>)?\s*:\s*([\w.,\s]+)", "cpp": r"\b(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*([\w:,\s]+)",
    "ruby": r"\bclass\s+\w+\s*<\s*([\w:]+)", "php": r"\bclass\s+\w+\s+(?:extends|implements)\s+([\w\\,\s]+)", "python": r"\bclass\s+\w+\s*\(([\w.,\s]+)\)", "rust": r"\bimpl(?:<[^>]*>)?\s+([\w:]+)\s+for\b",
}
_NO_BASE = ["public", "private", "protected", "virtual", "extends", "implements", ""]
_NO_CALL = "if for while switch catch return sizeof function func fn def class new await typeof elif print_r and or not in match with except super lambda".split()
IMPORTS_A_FILE, TARGET_CHARS, MOST_BYTES = 40, 200, 512 * 1024
MINIFIED = r"(?i)\.min\.(?:js|mjs|cjs|css)$"
TEST_NAME, TEST_FILE = r"(?i)^(?:test_|test[A-Z])", r"(?i)(?:^test_|_test$|Test$|Spec$|_spec$|\.test\.|\.spec\.)"


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.nullif(extension(path), F.lit("")))


def is_test(name: Column, path: Column) -> Column:
    stem = F.regexp_replace(basename(path), r"\.[^.]+$", "")
    return name.rlike(TEST_NAME) | stem.rlike(TEST_FILE)


def parseable(files: DataFrame) -> DataFrame:
    """Files of a known language that are neither too large nor minified; needs path and length."""
    return files.where(language(F.col("path")).isNotNull() & (F.col("length") <= MOST_BYTES) & ~F.col("path").rlike(MINIFIED))


def lines_of(files: DataFrame) -> DataFrame:
    """(file_path, language, line, text): every line, from 1 on; a last empty line is none."""
    rows = files.select(slashes(F.col("path")).alias("file_path"), F.coalesce("language", language(F.col("path"))).alias("language") if "language" in files.columns else language(F.col("path")).alias("language"), F.posexplode(F.split(F.regexp_replace("content", r"\r?\n$", ""), r"\r?\n")).alias("i", "text"))
    return rows.select("file_path", "language", (F.col("i") + 1).alias("line"), "text")


def _declaring(lines: DataFrame) -> DataFrame:
    """`lines` with the kind and name (`base`) of what each declares, null where it is nothing; functions that are tests as such."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, rules in SYMBOLS.items():
        for what, rule in reversed(rules):
            hit = (F.col("language") == lang) & F.col("text").rlike(rule)
            kind, name = F.when(hit, what).otherwise(kind), F.when(hit, F.regexp_extract("text", rule, 1)).otherwise(name)
    return lines.withColumns({"kind": F.when((kind == "Function") & is_test(name, F.col("file_path")), "Test").otherwise(kind), "base": name})


def symbols(lines: DataFrame) -> DataFrame:
    """(file_path, kind, name, line): declarations; a name's second and later ones in a file are called name__Lline."""
    place = F.row_number().over(Window.partitionBy("file_path", "base").orderBy("line"))
    found = _declaring(lines).where("base is not null")
    return found.select("file_path", "kind", F.when(place > 1, F.concat("base", F.lit("__L"), "line")).otherwise(F.col("base")).alias("name"), "line")


def imports(lines: DataFrame, most: int = IMPORTS_A_FILE) -> DataFrame:
    """(file_path, target, line): import lines as they stand, the first `most` of a file."""
    hit = F.lit(False)
    for lang, rule in IMPORTS.items():
        hit = hit | ((F.col("language") == lang) & F.col("trimmed").rlike(rule))
    found = lines.withColumn("trimmed", F.trim("text")).where(hit)
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("line"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("file_path", F.substring("trimmed", 1, TARGET_CHARS).alias("target"), "line")


def inheritance(lines: DataFrame) -> DataFrame:
    """(file_path, name, base, line): what the classes of a file are made from, as their lines say."""
    names, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, rule in BASES.items():
        hit = (F.col("language") == lang) & F.col("text").rlike(rule)
        found = F.when(hit, F.regexp_extract("text", rule, 1)).otherwise(found)
        names = F.when(hit, F.regexp_extract("text", r"\b(?:class|interface|struct|record|enum)\s+(\w+)", 1)).otherwise(names)
    names = F.when((F.col("language") == "rust") & found.isNotNull(), F.regexp_extract("text", r"\bfor\s+(\w+)", 1)).otherwise(names)
    rows = lines.withColumn("name", names).withColumn("bases", F.split(found, r"[,\s]+")).where("bases is not null and name <> ''")
    return rows.select("file_path", "name", F.explode("bases").alias("base"), "line").where(~F.col("base").isin(_NO_BASE)).distinct()


def calls(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(file_path, caller, called, line): names before a bracket, below a function's declaration (of `symbols`) and before the next one.

    Strings and comments at a line's end are left out; a file is one window, and has MOST_BYTES bytes at most.
    """
    functions = found.where("kind in ('Function', 'Test')").select("file_path", "line", F.col("name").alias("declared"))
    rows = lines.join(functions, ["file_path", "line"], "left")
    owner = F.last("declared", ignorenulls=True).over(Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    bare = F.regexp_replace(F.regexp_replace("text", r"\"[^\"]*\"|'[^']*'", ""), r"(?://|#|--).*$", "")
    rows = rows.withColumn("caller", owner).where("caller is not null").withColumn("called", F.explode(F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))))
    own = F.regexp_replace("declared", r"__L\d+$", "")
    return rows.where(~F.col("called").isin(_NO_CALL) & ~F.coalesce(F.col("called") == own, F.lit(False))).groupBy("file_path", "caller", "called").agg(F.min("line").alias("line"))


NODES = "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, params string, return_type string, is_test boolean"
EDGES = "kind string, source_qualified string, target_qualified string, file_path string, line int, confidence_tier string"


def scan_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (path, content) by lines and brackets: a file node each, its declarations with their scopes, CONTAINS, imports, bases, calls and tests."""
    path, kind = slashes(F.col("path")), F.coalesce("language", language(F.col("path"))) if "language" in files.columns else language(F.col("path"))
    lines = scopes.bare_lines(files, kind)
    none = F.lit(None).cast("string")
    tops = files.select(F.lit("File").alias("kind"), basename(path).alias("name"), F.concat_ws("::", path, basename(path)).alias("qualified_name"), path.alias("file_path"), F.lit(1).alias("line_start"), line_count(F.col("content")).alias("line_end"), kind.alias("language"), none.alias("parent_name"), none.alias("params"), none.alias("return_type"), F.lit(False).alias("is_test"))
    bare = lines.withColumn("text", F.col("bare"))
    tests = F.when((F.col("kind") == "Function") & is_test(F.col("base"), F.col("file_path")), "Test").otherwise(F.col("kind"))
    marked = lambda calling: scopes.marked_lines(files, kind, SYMBOLS, calling).withColumn("kind", tests)
    found = scopes.declared(marked(False).select("file_path", "language", "line", "last", "head", "kind", "base"))
    calling = marked(True).select("file_path", "line", "last", "kind", "base", "bare")
    nodes = found.select("kind", "name", F.concat_ws("::", "file_path", "name").alias("qualified_name"), "file_path", F.col("line").alias("line_start"), F.col("last").alias("line_end"), language(F.col("file_path")).alias("language"), "parent_name", "params", "return_type", (F.col("kind") == "Test").alias("is_test"))
    edges = found.select(F.lit("CONTAINS").alias("kind"), F.concat_ws("::", "file_path", "parent_name").alias("source_qualified"), F.concat_ws("::", "file_path", "name").alias("target_qualified"), "file_path", "line", F.lit("EXTRACTED").alias("confidence_tier"))
    edges = edges.unionByName(imports(lines).select(F.lit("IMPORTS_FROM").alias("kind"), F.col("file_path").alias("source_qualified"), F.col("target").alias("target_qualified"), "file_path", "line", F.lit("HEURISTIC").alias("confidence_tier")))
    inferred = lambda rows, kind, a, b: rows.select(F.lit(kind).alias("kind"), F.concat_ws("::", "file_path", a).alias("source_qualified"), F.col(b).alias("target_qualified"), "file_path", "line", F.lit("INFERRED").alias("confidence_tier"))
    edges = edges.unionByName(inferred(inheritance(bare), "INHERITS", "name", "base")).unionByName(inferred(scopes.calls(calling, _NO_CALL), "CALLS", "caller", "called"))
    edges = edges.unionByName(inferred(found.where("kind = 'Test'"), "TESTED_BY", "name", "file_path"))
    return tops.unionByName(nodes), edges


#: Seconds that a file may take to parse.
PARSE_SECONDS = 10.0


def parse_python(files: DataFrame, seconds: float = PARSE_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, failures) of Python files (path, content) from their syntax trees.

    A file that doesn't parse, or takes longer than its time, has its file node
    alone and a row (file_path, error) of failures; no file ends a task.  A
    function's name is qualified by its class, not by enclosing functions; of
    equal qualified names the last one stands.
    """
    schema = f"node struct<{', '.join(f.replace(' ', ': ', 1) for f in NODES.split(', '))}>, edge struct<{', '.join(f.replace(' ', ': ', 1) for f in EDGES.split(', '))}>, place int, file_path string, error string"
    target = files.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, error = timed_rows(path, text or "", seconds)
                rows += [{"node": n, "edge": e, "place": k, "file_path": path, "error": None} for k, (n, e) in enumerate(found)]
                rows += [{"node": None, "edge": None, "place": None, "file_path": path, "error": error}] if error else []
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in out], schema=out)

    parsed = files.select(slashes(F.col("path")).alias("path"), "content").mapInArrow(run, target)
    last = Window.partitionBy("qualified_name").orderBy(F.col("place").desc())
    nodes = parsed.where("node is not null").select("node.*", "place").withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "place")
    return nodes, parsed.where("edge is not null").select("edge.*").distinct(), parsed.where("error is not null").select("file_path", "error")


def timed_rows(path: str, text: str, seconds: float) -> tuple[list[tuple[dict | None, dict | None]], str | None]:
    """The rows of one file, and what was wrong with it; past its time it has its file node alone."""
    import signal
    import threading

    def late(*_) -> None:
        raise TimeoutError(f"took more than {seconds:g} s")

    timed = threading.current_thread() is threading.main_thread()  # tasks run there
    before = signal.signal(signal.SIGALRM, late) if timed else None
    try:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, seconds)
        return syntax_rows(path, text), None
    except (SyntaxError, ValueError, RecursionError, MemoryError, TimeoutError) as e:
        kind = "timeout" if isinstance(e, TimeoutError) else type(e).__name__
        return [(_file_node(path, text.count("\n") + 1), None)], f"{kind}: {str(e)[:200]}"
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)


def _file_node(path: str, last: int) -> dict:
    return {"kind": "File", "name": path.rsplit("/", 1)[-1], "qualified_name": "::".join((path, path.rsplit("/", 1)[-1])), "file_path": path, "line_start": 1, "line_end": last, "language": "python", "parent_name": None, "params": None, "return_type": None, "is_test": False}


def _params(args) -> str:
    """Names of all parameters, as they are called: a, *rest, key, **more; a bare * before keywords alone."""
    names = [a.arg for a in (*args.posonlyargs, *args.args)]
    if args.vararg:
        names.append("*" + args.vararg.arg)
    elif args.kwonlyargs:
        names.append("*")
    names += [a.arg for a in args.kwonlyargs]
    return "(" + ", ".join(names + (["**" + args.kwarg.arg] if args.kwarg else [])) + ")"


def syntax_rows(path: str, text: str) -> list[tuple[dict | None, dict | None]]:
    """(node, None) and (None, edge) of one file, in the order of the text; raises what its parser does."""
    import ast
    import re

    name = path.rsplit("/", 1)[-1]
    stem = re.sub(r"\.[^.]+$", "", name)
    testing_file = bool(re.search(TEST_FILE, stem))
    rows: list[tuple[dict | None, dict | None]] = []

    def node(kind: str, called: str, first: int, last: int, parent: str | None = None, params: str | None = None, test: bool = False, returns: str | None = None) -> None:
        rows.append(({"kind": kind, "name": called, "qualified_name": "::".join(filter(None, (path, parent, called))), "file_path": path, "line_start": first, "line_end": last, "language": "python", "parent_name": parent, "params": params, "return_type": returns, "is_test": test}, None))

    def edge(kind: str, source: str, target: str, line: int, tier: str = "EXTRACTED") -> None:
        rows.append((None, {"kind": kind, "source_qualified": source, "target_qualified": target, "file_path": path, "line": line, "confidence_tier": tier}))

    tree = ast.parse(text)
    node("File", name, 1, max([1, *(x.end_lineno for x in tree.body)]))
    # Depth first with a stack of (syntax node, class around it, function around it)
    stack = [(x, None, None) for x in reversed(tree.body)]
    while stack:
        at, owner, function = stack.pop()
        if isinstance(at, ast.Import):
            for alias in at.names:
                edge("IMPORTS_FROM", path, alias.name, at.lineno)
        elif isinstance(at, ast.ImportFrom) and at.module:
            edge("IMPORTS_FROM", path, at.module, at.lineno)
        elif isinstance(at, ast.ClassDef):
            own = f"{path}::{at.name}"
            node("Class", at.name, at.lineno, at.end_lineno, owner, None, testing_file or bool(re.search(TEST_NAME, at.name)))
            edge("CONTAINS", path, own, at.lineno)
            for base in at.bases:
                edge("INHERITS", own, ast.unparse(base), at.lineno)
            owner = at.name
        elif isinstance(at, ast.FunctionDef | ast.AsyncFunctionDef):
            test = testing_file or bool(re.search(TEST_NAME, at.name))
            holder, own = "::".join(filter(None, (path, owner))), "::".join(filter(None, (path, owner, at.name)))
            node("Test" if test else "Function", at.name, at.lineno, at.end_lineno, owner, _params(at.args), test, ast.unparse(at.returns) if at.returns else None)
            edge("CONTAINS", holder, own, at.lineno)
            if test:
                edge("TESTED_BY", own, holder, at.lineno)
            function = at.name
        elif isinstance(at, ast.Call) and function:
            called = at.func.id if isinstance(at.func, ast.Name) else at.func.attr if isinstance(at.func, ast.Attribute) else None
            if called:
                edge("CALLS", "::".join(filter(None, (path, owner, function))), called, at.lineno, "INFERRED")
        stack += [(x, owner, function) for x in reversed(list(ast.iter_child_nodes(at)))]
    return rows


def line_count(content: Column) -> Column:
    """Lines of a text; a line break at the end opens no line."""
    breaks = F.size(F.split(content, "\n", -1)) - 1
    return F.when(content == "", 0).when(content.endswith("\n"), breaks).otherwise(breaks + 1)


# Which comment opens a file of which kind.
_COMMENTS = [
    (r"(?m)^#\s+(.+)", [".py", ".rb", ".sh", ".bash", ".zsh", ".fish", ".yaml", ".yml", ".toml", ".r"]),
    (r"(?m)^//\s+(.+)", [".js", ".jsx", ".ts", ".tsx", ".go", ".java", ".kt", ".swift", ".c", ".cpp", ".h", ".rs", ".php"]),
    (r"(?m)^--\s+(.+)", [".sql", ".lua"]),
    (r"<!--\s*(.+?)\s*-->", [".html", ".htm", ".xml", ".svg"]),
]
_HEADED, _DOCUMENTED = [".md", ".mdx", ".rst", ".txt"], [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".svelte"]
_ENTRY_POINTS = ["index.js", "index.ts", "index.py", "main.py", "main.go", "main.rs"]


def purpose(path: Column, content: Column) -> Column:
    """One line on what a file is for: its docstring, heading, doc comment or first comment; else that it is an entry point."""
    head, ext = F.substring(content, 1, 3000), extension(path)
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    first_line = lambda c: some(F.substring_index(F.regexp_replace(c, r"^\s+", ""), "\n", 1))
    doc = F.coalesce(F.nullif(F.regexp_extract(head, r'(?s)^"""(.*?)"""', 1), F.lit("")), F.nullif(F.regexp_extract(head, r"(?s)^'''(.*?)'''", 1), F.lit("")))
    block = F.regexp_extract(head, r"(?s)/\*\*\s*(.*?)\*/", 1)
    told = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+", ""))), lambda x: (x != "") & ~x.startswith("@"))
    found = [F.when(ext == ".py", first_line(doc)), F.when(ext.isin(_HEADED), some(F.regexp_extract(head, r"(?m)^#{1,3}\s+(.+)", 1))), F.when(ext.isin(_DOCUMENTED), F.get(told, 0))]
    found += [F.when(ext.isin(exts), some(F.regexp_extract(head, rule, 1))) for rule, exts in _COMMENTS]
    stem = F.translate(F.regexp_replace(basename(path), r"\.[^.]+$", ""), "_-", "  ")
    found.append(F.when(basename(path).isin(_ENTRY_POINTS), F.concat(F.lit("Entry point — "), stem)))
    return F.when(F.trim(head) != "", F.substring(F.coalesce(*found), 1, 200))
