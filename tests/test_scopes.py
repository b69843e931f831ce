"""Declarations with their scopes, against rows made by hand."""

import re

import pytest
from pyspark.sql import functions as F

from loomstore.operators import extract, scopes

FILES = {
    "a.ts": """import { x } from 'y';
export class App extends Base {
  // function not(a) { }
  run = 1;
}
export async function start(a: string, b = "}{", c: (n: number) => void = () => {}): Promise<void> {
  const text = `function also_not(
    ${a} {`;
  const inner = (z: number): number => {
    return helper(z);
  };
  /* call(1) {
     other(2) */
  return inner(3);
}
const short = (q) => q + 1;
function next(
  first: number,
  second: string,
): boolean
{
  return start(first);
}
""",
    "b.go": """package b
type T struct {}
func (s *T) Run(a int, f func(int) error) (int, error) {
\ts := `func no(x) {
`
\treturn helper(s), nil
}
func testIt() {
\tRun(1) // nor(this)
}
""",
    "c.rs": """use std::io;
pub struct P { x: u8 }
pub async fn outer(a: &'static str, c: char) -> Result<u8, String> where u8: Copy {
    let quote = '"'; let raw = r#"fn no() { "#;
    fn inner(b: u8) -> u8 { b }
    inner(1); println!("call({})", 2)
}
fn last() { outer("x", 'y') }
""",
    "d.c": """static int * main(int argc, char **argv) {
  char c = '{';
  if (x) { call(1, "no(2)"); }
  return 0;
}
void g(int a) { main(a); }
""",
    "e.rb": """class A < B
  def one(a, b = 2)
    # def no
    two(a)
  end

  def two
  end
end
def three(x)
  one(x)
end
""",
    "f.php": """<?php
class K extends L {
  # function no() {
}
function show(array $a): string {
  return implode(",", $a);
}
""",
    "g.java": "public class J implements I {\n  enum E { A, B }\n  String s = \"\"\"\n class No { \"\"\";\n}\n",
    "h.cs": "internal class Q\n{\n  struct R\n  {\n    int x;\n  }\n  string s = @\"a\\\";\n}\n",
    "i.cpp": "class V : public W {\n  struct U { int a; };\n};\n",
    "j.js": "function a() { return 1 }\nlet b = async function (x, y) {\n  a()\n}\nfunction broken(x) {\n  a(\n",
}
WANT = {
    ("a.ts", "App"): (2, 5, None, None, None), ("a.ts", "start"): (6, 15, None, "(a: string, b = , c: (n: number) => void = () => {})", "Promise<void>"), ("a.ts", "inner"): (9, 11, "start", "(z: number)", "number"),
    ("a.ts", "short"): (16, 16, None, "(q)", None), ("a.ts", "next"): (17, 23, None, "( first: number, second: string, )", "boolean"),
    ("b.go", "Run"): (3, 7, None, "(a int, f func(int) error)", "(int, error)"), ("b.go", "testIt"): (8, 10, None, "()", None),
    ("c.rs", "P"): (2, 2, None, None, None), ("c.rs", "outer"): (3, 7, None, "(a: &'static str, c: char)", "Result<u8, String>"), ("c.rs", "inner"): (5, 5, "outer", "(b: u8)", "u8"), ("c.rs", "last"): (8, 8, None, "()", None),
    ("d.c", "main"): (1, 5, None, "(int argc, char **argv)", "int *"), ("d.c", "g"): (6, 6, None, "(int a)", "void"),
    ("e.rb", "A"): (1, 9, None, None, None), ("e.rb", "one"): (2, 5, "A", "(a, b = 2)", None), ("e.rb", "two"): (7, 8, "A", None, None), ("e.rb", "three"): (10, 12, None, "(x)", None),
    ("f.php", "K"): (2, 4, None, None, None), ("f.php", "show"): (5, 7, None, "(array $a)", "string"),
    ("g.java", "J"): (1, 5, None, None, None), ("g.java", "E"): (2, 2, "J", None, None), ("h.cs", "Q"): (1, 8, None, None, None), ("h.cs", "R"): (3, 6, "Q", None, None), ("i.cpp", "V"): (1, 3, None, None, None), ("i.cpp", "U"): (2, 2, "V", None, None),
    ("j.js", "a"): (1, 1, None, "()", None), ("j.js", "b"): (2, 4, None, "(x, y)", None), ("j.js", "broken"): (5, 6, None, "(x)", None),
}
CALLS = {
    ("a.ts", "inner", "helper"), ("a.ts", "start", "inner"), ("a.ts", "next", "start"), ("b.go", "Run", "helper"), ("b.go", "testIt", "Run"), ("c.rs", "outer", "inner"), ("c.rs", "last", "outer"), ("d.c", "main", "call"), ("d.c", "g", "main"),
    ("e.rb", "one", "two"), ("e.rb", "three", "one"), ("f.php", "show", "implode"), ("j.js", "b", "a"), ("j.js", "broken", "a"),
}


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges = extract.scan_lines(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    return nodes.collect(), edges.collect()


def test_nested_declarations_of_ten_languages(graph):
    got = {(r["file_path"], r["name"]): (r["line_start"], r["line_end"], r["parent_name"], r["params"] and " ".join(r["params"].split()), r["return_type"]) for r in graph[0] if r["kind"] != "File"}
    want = {k: (*v[:3], v[3] and " ".join(v[3].split()), v[4]) for k, v in WANT.items()}
    assert got == want
    holds = {(r["source_qualified"], r["target_qualified"]) for r in graph[1] if r["kind"] == "CONTAINS"}
    assert ("a.ts::start", "a.ts::inner") in holds and ("e.rb::A", "e.rb::two") in holds and ("a.ts", "a.ts::App") in holds


def test_strings_and_comments_call_nothing(graph):
    assert {(r["file_path"], r["source_qualified"].split("::")[1], r["target_qualified"]) for r in graph[1] if r["kind"] == "CALLS"} == CALLS
    assert ("a.ts", "import { x } from 'y';") in {(r["file_path"], r["target_qualified"]) for r in graph[1] if r["kind"] == "IMPORTS_FROM"}
    assert ("i.cpp::V", "W") in {(r["source_qualified"], r["target_qualified"]) for r in graph[1] if r["kind"] == "INHERITS"}


def test_blanking_keeps_every_line_and_place():
    for path, text in FILES.items():
        kind = extract.LANGUAGES["." + path.split(".")[1]]
        bare = scopes.blanked(text, kind)
        assert len(bare) == len(text) and [k for k, c in enumerate(bare) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]


def test_files_without_lines_or_of_no_language(spark):
    nodes, edges = extract.scan_lines(spark.createDataFrame([("a.js", None), ("b.js", ""), ("c.txt", "function x() {"), ("d.js", "((((" * 1000 + "}}}" * 1000)], "path string, content string"))
    assert nodes.where(F.col("kind") != "File").count() == 0 and edges.count() == 0


def _plan(df):
    """The operators of a plan that has not run, one a line."""
    return re.findall(r"(?m)^[\s:+*()\d-]*([A-Z]\w+)", df.select("*")._jdf.queryExecution().executedPlan().toString())


DEEP = "\n".join([f"function f{k % 700}() {{" for k in range(1400)] + ["g(1)"])


def test_scopes_need_no_row_for_each_line_of_a_body(spark):
    nodes, _ = extract.scan_lines(spark.createDataFrame([("a.js", DEEP)], "path string, content string"))
    nodes = nodes.where("kind <> 'File'")
    name = lambda k: f"f{k}" if k < 700 else f"f{k - 700}__L{k + 1}"
    got = {r["line_start"]: (r["name"], r["parent_name"], r["line_end"]) for r in nodes.collect()}
    assert got == {k + 1: (name(k), name(k - 1) if k else None, 1401) for k in range(1400)}
    assert not [x for x in _plan(nodes) if "Join" in x or x == "Generate"] and _plan(nodes).count("MapInArrow") == 2  # lines, and what is around them


def test_calls_need_no_row_for_each_line_of_a_body(spark):
    _, edges = extract.scan_lines(spark.createDataFrame([("a.js", DEEP + "\nfunction h(x) { h(2); f0(3) }")], "path string, content string"))
    found = edges.where("kind = 'CALLS'")
    assert {(r["source_qualified"], r["target_qualified"], r["line"]) for r in found.collect()} == {("a.js::f699__L1400", "g", 1401), ("a.js::h", "f0", 1402)}
    assert not [x for x in _plan(found) if "Join" in x] and _plan(found).count("MapInArrow") == 2


def test_lines_of_a_file_are_not_dealt_out_anew(spark):
    """Marked lines alone leave the first pass, and stay where they are: only the calls' groups are shuffled."""
    more = [(f"{k}.ts", "const no = 'f(';\nplain words;\n" * k + FILES["a.ts"]) for k in range(40)]
    files = spark.createDataFrame(more, "path string, content string")  # several files in a task
    marked = scopes.marked_lines(files, extract.language(F.col("path")), extract.SYMBOLS).collect()
    assert len(marked) == 40 * 5 and {r["bare"] for r in marked} == {None}
    nodes, edges = extract.scan_lines(files)
    nodes, found = nodes.where("kind <> 'File'"), edges.where("kind = 'CALLS'")
    assert _plan(nodes).count("Exchange") == 0 and _plan(found).count("Exchange") == 1
    assert {(r["file_path"], r["source_qualified"].split("::")[1], r["target_qualified"], r["line"]) for r in found.collect()} == {(f"{k}.ts", a, b, n + 2 * k) for k in range(40) for a, b, n in (("inner", "helper", 10), ("start", "inner", 14), ("next", "start", 22))}
