from pyspark.sql import functions as F

from loomstore.operators import extract, graph

NODES = [("File", "src/auth.py"), ("File", "src/api.py"), ("File", "src/db.py"), ("File", "tests/test_auth.py"), ("Function", "src/auth.py::login"), ("Function", "src/auth.py::verify_token"), ("Function", "src/api.py::handle_request"), ("Function", "src/api.py::get_user"), ("Function", "src/db.py::query_db"), ("Test", "tests/test_auth.py::test_login")]
EDGES = [("CALLS", "src/api.py::handle_request", "src/auth.py::login"), ("CALLS", "src/api.py::get_user", "src/auth.py::verify_token"), ("CALLS", "src/api.py::get_user", "src/db.py::query_db"), ("IMPORTS_FROM", "src/api.py", "src/auth.py"), ("TESTED_BY", "tests/test_auth.py::test_login", "src/auth.py::login")]


def small_graph(spark):
    rows = []
    for kind, q in NODES:
        path = q.split("::")[0]
        name = q.split("::")[-1] if kind != "File" else path.split("/")[-1]
        rows.append((kind, name, q if kind != "File" else f"{path}::{name}", path, 1, 9, "python", None, "(a)", "int", kind == "Test"))
    nodes = spark.createDataFrame(rows, "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, params string, return_type string, is_test boolean")
    contains = [("CONTAINS", q.split("::")[0], q) for kind, q in NODES if kind != "File"]
    return nodes, spark.createDataFrame(EDGES + contains, "kind string, source_qualified string, target_qualified string")


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_a_change_reaches_its_callers_and_gaps_are_found(spark):
    nodes, edges = small_graph(spark)
    hit = graph.impact(nodes, edges, paths(spark, "src/auth.py"))
    assert "src/api.py" in [r["file_path"] for r in graph.impacted_files(hit).collect()]
    gaps = {r["name"] for r in graph.test_gaps(nodes, edges).collect()}
    assert "verify_token" in gaps and "login" not in gaps and "test_login" not in gaps
    assert graph.impact(nodes, edges, paths(spark, "no/such.py")).count() == 0 and graph.impact(nodes, edges, spark.createDataFrame([], "path string")).count() == 0
    cut = graph.impact(nodes, edges, paths(spark, "src/auth.py"), most=1).collect()
    assert len(cut) == 1 and cut[0]["truncated"]


def test_reach_equals_breadth_first_search(spark):
    import random

    rng = random.Random(0)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(80)]
    edges = spark.createDataFrame([("CALLS", a, b) for a, b in links], "kind string, source_qualified string, target_qualified string")
    depth, ring = {"n1": 0}, {"n1"}
    for d in range(1, 4):
        ring = {y for a, b in links for x, y in ((a, b), (b, a)) if x in ring and y not in depth}
        depth |= dict.fromkeys(ring, d)
    found = graph.reach(edges, spark.createDataFrame([("n1",)], "node string"), 3)
    assert {r["node"]: r["depth"] for r in found.collect()} == depth


def test_edge_sets(spark):
    _, edges = small_graph(spark)
    names = spark.createDataFrame([("src/api.py::get_user",), ("src/db.py::query_db",), ("src/api.py::get_user",)], "node string")
    assert {(r["kind"], r["target_qualified"]) for r in graph.edges_among(edges, names).collect()} == {("CALLS", "src/db.py::query_db")}
    assert graph.edges_touching(edges, names).count() == 4
    assert {r["node"]: r["degree"] for r in graph.degree(edges).collect()}["src/api.py::get_user"] == 3


def test_neighbours_subtree_and_names(spark):
    nodes, edges = small_graph(spark)
    rows = {(r["role"], r["other"]) for r in graph.neighbours(nodes, edges, "src/api.py::get_user", 2).collect()}
    assert ("out", "src/db.py::query_db") in rows and ("in", "src/api.py") in rows and ("sibling", "src/api.py::handle_request") in rows and ("second", "src/auth.py") in rows
    tree = graph.subtree(edges, "src/auth.py").collect()
    assert [(r["node"], r["depth"]) for r in tree] == [("src/auth.py", 0), ("src/auth.py::login", 1), ("src/auth.py::verify_token", 1)]
    lined = nodes.where("kind <> 'File'").withColumn("line_start", F.when(F.col("name") == "login", 9).otherwise(3))
    assert [(r["node"], r["parent"]) for r in graph.tree(lined, edges, "src/auth.py").collect()] == [("src/auth.py", None), ("src/auth.py::verify_token", "src/auth.py"), ("src/auth.py::login", "src/auth.py")]
    assert graph.resolve_name(nodes, "login").first()["qualified_name"] == "src/auth.py::login" and graph.resolve_name(nodes, "src/db.py").first()["kind"] == "File" and graph.resolve_name(nodes, "nothing").count() == 0


def test_overlay_priorities_and_histogram(spark):
    nodes, _ = small_graph(spark)
    f = lambda *x: spark.createDataFrame([(p,) for p in x], "file_path string")
    blast = spark.createDataFrame([("src/auth.py::login",), ("src/db.py::query_db",)], "qualified_name string")
    states = graph.overlay(nodes, f("src/auth.py"), f("src/auth.py", "src/api.py"), blast)
    assert {r["qualified_name"]: r["state"] for r in states.collect()}["src/auth.py::login"] == "locked"
    assert {r["state"]: r["n"] for r in graph.state_histogram(states).collect()} == {"locked": 3, "hot": 3, "blast": 1, "warm": 0, "cold": 3}


def test_signatures_and_summaries(spark):
    nodes, edges = small_graph(spark)
    by_file, lines = graph.compact_context(nodes, edges)
    assert {r["file_path"]: r["signatures"] for r in by_file.collect()}["tests/test_auth.py"] == ["Test test_login(a) -> int [test]"]
    assert "get_user --CALLS--> query_db" in [r["summary"] for r in lines.collect()]


SERVICE = '''"""Serves users.

More."""
import os
from app.utils import helper


class UserService(Base):
    def login(self, name):
        return helper(name).strip()

    class Inner:
        pass


def test_login():
    UserService().login("x")


def outer():
    def inner():
        print(1)
    return inner


def other():
    def inner():
        pass
'''


def test_python_syntax(spark):
    files = spark.createDataFrame([("src\\service.py", SERVICE), ("bad.py", "def x(:\n"), ("empty.py", ""), ("null.py", None)], "path string, content string")
    nodes, edges, failures = extract.parse_python(files)
    n = {r["qualified_name"]: r for r in nodes.collect()}
    e = {(r["kind"], r["source_qualified"], r["target_qualified"]) for r in edges.collect()}
    s = "src/service.py"
    assert n[f"{s}::UserService::login"]["params"] == "(self, name)" and n[f"{s}::test_login"]["kind"] == "Test" and n[f"{s}::UserService::Inner"]["parent_name"] == "UserService"
    assert {("INHERITS", f"{s}::UserService", "Base"), ("CONTAINS", f"{s}::UserService", f"{s}::UserService::login"), ("CONTAINS", s, f"{s}::Inner"), ("TESTED_BY", f"{s}::test_login", s), ("CALLS", f"{s}::UserService::login", "helper"), ("CALLS", f"{s}::UserService::login", "strip"), ("CALLS", f"{s}::test_login", "login"), ("CALLS", f"{s}::inner", "print"), ("IMPORTS_FROM", s, "os"), ("IMPORTS_FROM", s, "app.utils")} <= e
    assert [(r["file_path"], r["error"].split(":")[0]) for r in failures.collect()] == [("bad.py", "SyntaxError")]
    assert n[f"{s}::inner"]["line_start"] == 27  # of two inner functions the last one stands
    assert n["bad.py::bad.py"]["kind"] == "File" and sum(q.startswith("bad") for q in n) == 1 and "empty.py::empty.py" in n


def test_parameters_returns_and_files_that_take_too_long(spark):
    text = "async def f(a, /, b: int = 2, *rest, key=None, **more) -> dict[str, int]:\n    pass\ndef g(*, only): ...\n"
    long = "x = 1\n" * 200_000
    nodes, _, failures = extract.parse_python(spark.createDataFrame([("a.py", text), ("deep.py", "(" * 5000), ("nul.py", "a\0b")], "path string, content string"))
    assert {r["name"]: (r["params"], r["return_type"]) for r in nodes.where("kind = 'Function'").collect()} == {"f": ("(a, b, *rest, key, **more)", "dict[str, int]"), "g": ("(*, only)", None)}
    assert {r["file_path"] for r in failures.collect()} == {"deep.py", "nul.py"} and nodes.where("kind = 'File'").count() == 3
    nodes, _, failures = extract.parse_python(spark.createDataFrame([("long.py", long), ("ok.py", "y = 2")], "path string, content string"), 0.05)
    assert [(r["file_path"], r["error"].split(":")[0]) for r in failures.collect()] == [("long.py", "timeout")] and nodes.count() == 2


def test_line_scanners(spark):
    files = spark.createDataFrame(
        [("a.js", "import x from 'y'\nexport default class App {\nconst go = () => 1\nfunction go() {}\nexport { a } from 'b'\n"), ("b.go", "func (s *T) Run(a int) {\nimport \"fmt\"\nfunc testIt() {"), ("c.rs", "use std::io;\npub struct P;\npub async fn q() {"), ("d.c", "static int main(void) {\n  else if (x) {\nint f(int a) {"), ("e.rb", "class A\n  def b"), ("f.swift", "func x() {}")],
        "path string, content string",
    )
    nodes, edges = extract.scan_lines(files)
    found = {(r["file_path"], r["kind"], r["name"]) for r in nodes.collect()}
    assert {("a.js", "Class", "App"), ("a.js", "Function", "go"), ("a.js", "Function", "go__L4"), ("b.go", "Function", "Run"), ("b.go", "Test", "testIt"), ("c.rs", "Class", "P"), ("c.rs", "Function", "q"), ("d.c", "Function", "main"), ("d.c", "Function", "f"), ("e.rb", "Class", "A"), ("e.rb", "Function", "b"), ("f.swift", "File", "f.swift")} <= found
    assert not any(k != "File" for p, k, _ in found if p == "f.swift") and ("d.c", "Function", "if") not in found
    targets = [(r["file_path"], r["target_qualified"]) for r in edges.where("kind = 'IMPORTS_FROM'").collect()]
    assert sorted(targets) == [("a.js", "export { a } from 'b'"), ("a.js", "import x from 'y'"), ("b.go", 'import "fmt"'), ("c.rs", "use std::io;")]
    many = spark.createDataFrame([("m.py", "\n".join(f"import m{i}" for i in range(60)))], "path string, content string")
    assert extract.imports(extract.lines_of(many)).count() == 40


def test_purposes_and_line_counts(spark):
    rows = [("a.py", SERVICE, "Serves users."), ("b.py", "x = 1\n# Does it\n", "Does it"), ("c.md", "intro\n## The Title \n", "The Title"), ("d.ts", "/**\n * @x\n * Real one\n */", "Real one"), ("e.go", "// Go it", "Go it"), ("f.sql", "-- counts", "counts"), ("g.html", "<p><!-- page --></p>", "page"), ("src/index.js", "let x", "Entry point — index"), ("h.txt", "   ", None), ("i.rs", "/// doc\nfn x", None), ("j.py", "x = 2", None)]
    df = spark.createDataFrame([(p, c) for p, c, _ in rows], "path string, content string")
    got = {r["path"]: r["p"] for r in df.select("path", extract.purpose(F.col("path"), F.col("content")).alias("p")).collect()}
    assert got == {p: want for p, _, want in rows}
    counts = spark.createDataFrame([("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)], "c string, want int")
    assert all(r["want"] == r["n"] for r in counts.withColumn("n", extract.line_count(F.col("c"))).collect())
