"""Scopes of source texts by their brackets: where a declaration ends, what holds it, its parameters and its return type.

A file goes once through a small machine that blanks out strings and comments, also
those of several lines, and pairs its brackets.  A declaration reaches from its line
to the bracket that closes the body it opens; of languages without brackets (Ruby),
to the `end` or the last line that stands farther in.  A declaration is held by the
innermost one around its line, and so is a call by the innermost function: the marked
lines of a file, those that declare or may call something, go by once, in their order,
past a stack of what is open.  They come from one row and stay in its task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstore.functions.text import slashes

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*(?:"|$)', r"'(?:\\.|[^'\\\n])*(?:'|$)"
_CHAR = r"'(?:\\[^\n']+|[^'\\\n])'"
#: What is blanked out, by language: comments and strings.
_BLANKED = {
    "javascript": (_C, r"`(?:\\.|[^`\\])*(?:`|\Z)", _DOUBLE, _SINGLE), "go": (_C, r"`[^`]*(?:`|\Z)", _DOUBLE, _CHAR), "rust": (_C, r'r(?<=\br)(#*)".*?(?:"\1|\Z)', r'"(?:\\.|[^"\\])*(?:"|\Z)', _CHAR),
    "java": (_C, r'"""(?:\\.|[^\\])*?(?:"""|\Z)', _DOUBLE, _CHAR), "csharp": (_C, r'@"(?:""|[^"])*(?:"|\Z)', _DOUBLE, _CHAR), "c": (_C, _DOUBLE, _CHAR), "php": (_C, r"\#[^\n]*", r'"(?:\\.|[^"\\])*(?:"|\Z)', r"'(?:\\.|[^'\\])*(?:'|\Z)"),
    "ruby": (r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)", r"\#[^\n]*", _DOUBLE, _SINGLE),
}
_BLANKED |= {"typescript": _BLANKED["javascript"], "tsx": _BLANKED["javascript"], "cpp": _BLANKED["c"], "kotlin": _BLANKED["java"], "swift": _BLANKED["java"]}
#: Alternatives that all begin with a sign of their own let the search skip to the next such sign.
_MACHINES = {k: re.compile("|".join(v), re.S | re.M) for k, v in _BLANKED.items()}
#: What may stand between a declaration's line and its body on a later line.
_GOES_ON = re.compile(r"\s*+(?:$|throws\b|where\b|->|:|extends\b|implements\b|,)")
_SIGNS, _NO_SIGNS = re.compile(r"[(){};]"), re.compile(r"[^(){};]+")
INDENTED = ["ruby"]
LINES = "file_path string, language string, line int, text string, bare string"
MARKED = "file_path string, language string, line int, last int, head string, kind string, base string, bare string"
#: Lines that go to Spark at a time; a file's stay together.
BATCH_LINES = 1 << 14
FUNCTIONS = ("Function", "Test")


def blanked(text: str, language: str) -> str:
    """The text with the inside of strings and comments as spaces; lines stay where they are."""
    machine = _MACHINES.get(language)
    spaces = lambda x: "\n".join(" " * len(y) for y in x.split("\n")) if "\n" in x else " " * len(x)
    return machine.sub(lambda m: spaces(m.group()), text) if machine else text


def line_scopes(bare: str, language: str, wanted: Iterable[int] | None = None) -> list[tuple[int, str]]:
    """For each line of a blanked text, or the `wanted` ones from 0 on: the line on which a body that it opens ends (its own without one), and the text up to the body."""
    lines = bare.split("\n")
    if language in INDENTED:
        found = _by_indent(lines)
        return found if wanted is None else [found[n] for n in wanted]
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    places, signs, pairs, opened = [m.start() for m in _SIGNS.finditer(bare)], _NO_SIGNS.sub("", bare), {}, []
    for k, c in enumerate(signs):
        if c == "{":
            opened.append(k)
        elif c == "}" and opened:
            pairs[opened.pop()] = k
    line_of = lambda at: bisect_right(starts, at)  # noqa: E731  from 1 on
    out = []
    for n in range(len(lines)) if wanted is None else wanted:
        end, stop, depth = n + 1, starts[n] + len(lines[n]), 0
        k = bisect_right(places, starts[n] - 1)
        while k < len(signs):
            at, c = places[k], signs[k]
            if depth <= 0 and at > stop and not (c == "{" and _GOES_ON.match(bare[stop:at])):
                break
            if c == "{" and depth <= 0:
                stop, end = at, line_of(places[pairs[k]]) if k in pairs else len(lines)
                break
            if c in ";}" and depth <= 0:
                stop = min(stop, at)
                break
            depth += (c == "(") - (c == ")")
            if c == ")" and depth == 0 and at > stop:  # parameters of several lines end on another one
                stop = starts[line_of(at)] - 1
            k += 1
        out.append((end, " ".join(bare[starts[n] : stop].split())))
    return out


def _by_indent(lines: list[str]) -> list[tuple[int, str]]:
    """A line ends with the last one that stands farther in, or the `end` after that."""
    out: list[tuple[int, str]] = [(n + 1, " ".join(x.split())) for n, x in enumerate(lines)]
    open_: list[tuple[int, int]] = []  # (indent, line from 0 on)
    last = 0
    for n, line in enumerate([*lines, "<"]):
        if not line.strip() and n < len(lines):
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            _, at = open_.pop()
            closing = n < len(lines) and lines[n].strip() == "end" and indent == len(lines[at]) - len(lines[at].lstrip())
            out[at] = (n + 1 if closing else last + 1, out[at][1])
        open_.append((indent, n))
        last = n
    return out


def _by_file(files: DataFrame, language: Column, schema: str, columns_of: Callable[[str, str, str], list]) -> DataFrame:
    """Rows of files (path, content), some for each: the columns that `columns_of` makes of a path, a language and a text, in order."""
    target = files.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        made = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
        held: list[list] = [[] for _ in out]
        for batch in batches:
            for row in range(batch.num_rows):
                path, kind, text = (c[row].as_py() for c in batch.columns)  # a file has MOST_BYTES at most
                text = text or ""
                text = text[: len(text) - (2 if text.endswith("\r\n") else text.endswith("\n"))].replace("\r\n", "\n")
                for column, more in zip(held, columns_of(path, kind, text)):
                    column.extend(more)
                if len(held[0]) >= BATCH_LINES:
                    yield made(held)
                    held = [[] for _ in out]
        if held[0]:
            yield made(held)

    return files.select(slashes(F.col("path")).alias("path"), language.alias("language"), "content").where("language is not null").mapInArrow(run, target)


def bare_lines(files: DataFrame, language: Column) -> DataFrame:
    """LINES of files (path, content): lines from 1 on, as they are and blanked."""

    def columns_of(path: str, kind: str, text: str) -> list:
        lines = text.split("\n")
        return [[path] * len(lines), [kind] * len(lines), range(1, len(lines) + 1), lines, blanked(text, kind).split("\n")]

    return _by_file(files, language, LINES, columns_of)


def marked_lines(files: DataFrame, language: Column, rules: dict[str, list[tuple[str, str]]], calling: bool = False) -> DataFrame:
    """MARKED of files (path, content): lines whose blanked text declares something, and with `calling` those that have a bracket.

    `rules`: kinds and patterns by language, tried in order from a line's start; their
    one group is the name.  Without `calling` there is no bare text, with it no head.  A
    file's lines follow one another in one task.
    """

    def columns_of(path: str, kind: str, text: str) -> list:
        own = rules.get(kind, ())
        # Kept by the module re; no rule goes on with a space, so none that stands before is given back
        match = re.compile("|".join(f"(?:{rule.replace(r'^\s*', r'^\s*+', 1)})" for _, rule in own) or r"(?!)", re.ASCII).match
        bare = blanked(text, kind)
        lines = bare.split("\n")
        found = {n: (own[m.lastindex - 1][0], m[m.lastindex]) for n, m in enumerate(map(match, lines)) if m}
        scope = dict(zip(found, line_scopes(bare, kind, found))) if found else {}
        at = [n for n, line in enumerate(lines) if n in found or "(" in line] if calling else list(found)
        kinds, bases = zip(*(found.get(n, (None, None)) for n in at)) if at else ((), ())
        ends, heads = zip(*(scope.get(n, (n + 1, None)) for n in at)) if at else ((), ())
        nothing = [None] * len(at)
        return [[path] * len(at), [kind] * len(at), [n + 1 for n in at], ends, nothing if calling else heads, kinds, bases, [lines[n] for n in at] if calling else nothing]

    return _by_file(files, language, MARKED, columns_of)


def surrounded(rows: DataFrame) -> DataFrame:
    """Marked lines (file_path, line, last, kind, base; kind and base null where nothing is declared) with names and what is around them.

    name: the base, and for a file's second and later ones base__Lline; parent_name:
    the innermost declaration that begins on an earlier line and reaches this one;
    caller and caller_line: the innermost function around the line or on it.  Rows
    are those of `marked_lines`, or some of them: a file's follow one another in one
    task, so that nothing is dealt out anew; kept are its names and what is open.
    """
    target = T.StructType([*rows.schema.fields, *rows.sparkSession.createDataFrame([], "name string, parent_name string, caller string, caller_line int").schema.fields])
    names = rows.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, at, now, seen = to_arrow_schema(target), None, 0, set()
        around: list[tuple[int, int, str]] = []  # (last, line, name) of declarations, functions, and those of the line at hand
        functions, begun = list(around), list(around)
        for batch in batches:
            found: list[tuple] = []
            for path, line, last, kind, base in zip(*(batch.column(names.index(c)).to_pylist() for c in ("file_path", "line", "last", "kind", "base"))):
                if path != at or line < now:
                    at, now, seen, around, functions, begun = path, line, set(), [], [], []
                if line != now:
                    around.extend(begun)
                    now, begun = line, []
                # What ended before this line is around no later one either
                for stack in (around, functions):
                    while stack and stack[-1][0] < line:
                        stack.pop()
                name, parent = base, around[-1][2] if around else None
                if base is not None:
                    name = f"{base}__L{line}" if base in seen else base
                    seen.add(base)
                    begun.append((max(last, line), line, name))
                    if kind in FUNCTIONS:
                        functions.append(begun[-1])
                found.append((name, parent, *(functions[-1][2:0:-1] if functions else (None, None))))
            if found:
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, out)), *(pa.array(c, f.type) for c, f in zip(zip(*found), list(out)[-4:]))], schema=out)

    return rows.mapInArrow(run, target)


def declared(found: DataFrame) -> DataFrame:
    """Declarations (file_path, language, kind, base, line, last, head) with name, parent_name, params and return_type."""
    rows = surrounded(found)
    rest = F.regexp_replace(F.expr("substring(head, instr(head, base) + length(base))"), r"^\s*=\s*(?:async\s*)?(?:function\b\s*\w*\s*)?", "")
    brackets = r"^\s*(?:<[^>]*>)?\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))"
    rows = rows.withColumn("rest", rest)
    function = F.col("kind").isin("Function", "Test")
    rows = rows.withColumn("params", F.when(function, F.nullif(F.regexp_extract("rest", brackets, 1), F.lit(""))))
    after = F.trim(F.regexp_replace("rest", brackets, ""))
    given = (
        F.when(F.col("language").isin("rust", "swift"), F.regexp_extract(after, r"->\s*(.+?)(?:\s+where\b.*)?$", 1))
        .when(F.col("language").isin("typescript", "tsx", "php", "kotlin"), F.regexp_extract(after, r"^:\s*(.+?)\s*(?:=>?)?$", 1))
        .when(F.col("language") == "go", after)
        .when(F.col("language").isin("c", "cpp"), F.expr(r"regexp_extract(substring(head, 1, instr(head, base) - 1), '^(?:(?:static|inline|extern)\\s+)*(.*?)\\s*$', 1)"))
    )
    rows = rows.withColumn("return_type", F.when(F.col("params").isNotNull(), F.nullif(given, F.lit(""))))
    return rows.select("file_path", "kind", "name", "line", "last", "parent_name", "params", "return_type")


def calls(marked: DataFrame, no_call: list[str]) -> DataFrame:
    """(file_path, caller, called, line): names before a bracket inside a function's body, told by the innermost function around them.

    `marked` has the declarations and the lines with brackets: file_path, line, last, kind, base, bare.
    """
    rows = surrounded(marked).where("caller is not null").withColumn("called", F.explode(said(F.col("bare")))).where(~F.col("called").isin(no_call))
    itself = (F.col("line") == F.col("caller_line")) & (F.col("called") == F.regexp_replace("caller", r"__L\d+$", ""))
    return rows.where(~itself).groupBy("file_path", "caller", "called").agg(F.min("line").alias("line"))


def said(bare: Column) -> Column:
    """The names before a bracket in a blanked line."""
    return F.when(bare.contains("("), F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))).otherwise(F.array().cast("array<string>"))
