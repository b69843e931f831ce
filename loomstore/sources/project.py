"""A project's files and manifests, and stored tables of other projects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomstore.functions.text import basename, extension
from loomstore.operators.extract import line_count, purpose

# What is indexed and what is not.
SKIPPED_FOLDERS = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", "out", ".next", ".nuxt", ".output",
    "coverage", ".nyc_output", ".coverage", ".pytest_cache", ".mypy_cache", ".tox", ".ruff_cache", ".idea", ".vscode", "migrations",
]
SKIPPED_EXTENSIONS = [
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib", ".exe", ".bin", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico", ".webp", ".avif",
    ".mp4", ".mp3", ".wav", ".ogg", ".flac", ".avi", ".mov", ".pdf", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".lock",
]
TEXT_EXTENSIONS = [
    ".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".vue", ".svelte", ".astro", ".html", ".htm", ".xml", ".xsl", ".css", ".scss", ".sass", ".less", ".styl",
    ".json", ".json5", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".config", ".md", ".mdx", ".txt", ".rst", ".adoc", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".bat", ".cmd",
    ".go", ".rs", ".java", ".kt", ".kts", ".swift", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx", ".rb", ".php", ".lua", ".r", ".m", ".sql",
    ".ex", ".exs", ".erl", ".hrl", ".clj", ".cljs", ".scala", ".graphql", ".gql", ".proto", ".tf", ".tfvars", ".dockerfile",
]
TEXT_NAMES = [
    "Dockerfile", "Makefile", "Procfile", "Jenkinsfile", "Vagrantfile", "Gemfile", "Rakefile", "Guardfile", ".gitignore", ".gitattributes", ".dockerignore", ".eslintrc",
    ".prettierrc", ".babelrc", ".editorconfig", "LICENSE", "LICENCE", "NOTICE", "AUTHORS", "CONTRIBUTORS",
]


def indexable(path: Column) -> Column:
    ext = extension(path)
    return ~ext.isin(SKIPPED_EXTENSIONS) & (basename(path).isin(TEXT_NAMES) | ext.isin(TEXT_EXTENSIONS))


def ignored(path: Column, more: list[str] | None = None) -> Column:
    """Whether a folder of the path is skipped by name or hidden."""
    names = F.array(*map(F.lit, SKIPPED_FOLDERS + (more or [])))
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.array_contains(names, x) | x.startswith("."))


def _placed(rows: DataFrame, root: str, more_ignored: list[str] | None = None) -> DataFrame:
    """Files with `rel`, their path below a folder, of those that are indexable."""
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    rows = rows.withColumn("rel", F.substr(path, F.length(base) + 1))
    return rows.where(indexable(F.col("rel")) & ~ignored(F.col("rel"), more_ignored))


def read_tree(spark: SparkSession, root: str, more_ignored: list[str] | None = None) -> DataFrame:
    """(path, length, modified, content) of the indexable files below a folder, with paths relative to it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _placed(rows, root, more_ignored).select(F.col("rel").alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, at, length, mark) of the indexable files below a folder: a listing, no file is opened. `mark` changes with a file's length or time."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _placed(rows, root).select(F.col("rel").alias("path"), F.col("path").alias("at"), "length", F.concat_ws("@", "length", F.unix_micros("modificationTime")).alias("mark"))


#: Files that are opened by name; more are read with the whole tree.
FEW_FILES = 10_000


def read_files(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """(path, mark, content) of listed files (path, at, mark); only they are opened."""
    some = [re.sub(r"([{}\[\]*?\\])", r"\\\1", r["at"]) for r in listed.select("at").limit(FEW_FILES + 1).collect()]
    if not some:
        return listed.select("path", "mark", F.lit(None).cast("binary").alias("content"))
    if len(some) > FEW_FILES:
        return read_tree(spark, root).select("path", "content").join(listed.select("path", "mark"), "path").select("path", "mark", "content")
    rows = _placed(spark.read.format("binaryFile").load(some), root).select(F.col("rel").alias("path"), "content")
    return rows.join(listed.select("path", "mark"), "path").select("path", "mark", "content")


def index_files(tree: DataFrame) -> DataFrame:
    """The rows of `files` for a tree."""
    text = F.decode("content", "UTF-8")
    return tree.select("path", F.nullif(F.regexp_replace(extension(F.col("path")), r"^\.", ""), F.lit("")).alias("file_type"), line_count(text).alias("line_count"), F.col("length").alias("size_bytes"), purpose(F.col("path"), text).alias("purpose"), F.lit(None).cast("string").alias("tags"), F.col("modified").alias("last_modified"), F.md5(F.substring("content", 1, 65536)).alias("checksum"))


# Names by which dependencies give a framework away, first come first.
_NODE = [("next", "Next.js"), ("nuxt", "Nuxt"), ("react", "React"), ("vue", "Vue"), ("svelte", "Svelte"), ("astro", "Astro"), ("express", "Express"), ("fastify", "Fastify")]
_PYTHON = [("django", "Django"), ("fastapi", "FastAPI"), ("flask", "Flask"), ("tornado", "Tornado"), ("aiohttp", "aiohttp")]
_PYTHON_FILES = ["requirements.txt", "Pipfile", "setup.cfg", "pyproject.toml"]


def project_facts(manifests: DataFrame) -> DataFrame:
    """(key, value): name, language, framework and tools, from the top-level manifests (path, content as text).

    Of several ecosystems the later of: Node, Python, Go, Rust, Java, Ruby, PHP
    gives the language; a framework found by a dependency stays against a plain one.
    """
    rows = manifests.where(~F.col("path").contains("/"))
    text = lambda name: F.max(F.when(F.col("path") == name, F.col("content")))
    has = lambda *names: F.coalesce(F.max(F.col("path").isin(*names)), F.lit(False))
    facts = rows.agg(
        text("package.json").alias("node"), F.coalesce(*[text(n) for n in _PYTHON_FILES]).alias("python"), text("Gemfile").alias("ruby"),
        has("go.mod").alias("go"), has("Cargo.toml").alias("rust"), has("pom.xml").alias("maven"), has("build.gradle", "build.gradle.kts").alias("gradle"), has("composer.json").alias("php"),
        has("Dockerfile").alias("has_docker"), has("docker-compose.yml", "docker-compose.yaml").alias("has_compose"), has("terraform.tf", "main.tf").alias("has_terraform"),
    )
    v = F.try_parse_json("node")
    parsed = v.isNotNull()
    keys = F.array_union(*[F.coalesce(F.map_keys(F.try_variant_get(v, f"$.{k}", "map<string,variant>")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])

    def first(options: list[tuple[str, str]], test) -> Column:
        return F.coalesce(*[F.when(test(k), name) for k, name in options])

    node = F.when(parsed, F.coalesce(first(_NODE, lambda k: F.array_contains(keys, k)), F.lit("Node.js")))
    python = first(_PYTHON, lambda k: F.lower("python").contains(k))
    ruby = F.when(F.col("ruby").isNotNull(), F.when(F.lower("ruby").contains("rails"), "Rails").otherwise("Ruby"))
    plain = F.coalesce(F.when(F.col("python").isNotNull(), "Python"), F.when(F.col("go"), "Go"), F.when(F.col("rust"), "Rust/Cargo"), F.when(F.col("maven"), "Maven"), F.when(F.col("gradle"), "Gradle"), F.when(F.col("php"), "PHP"))
    language = F.coalesce(F.when(F.col("php"), "PHP"), F.when(F.col("ruby").isNotNull(), "Ruby"), F.when(F.col("maven"), "Java"), F.when(F.col("gradle"), "Kotlin/Java"), F.when(F.col("rust"), "Rust"), F.when(F.col("go"), "Go"), F.when(F.col("python").isNotNull(), "Python"), F.when(parsed, "JavaScript/TypeScript"))
    yes = lambda c: F.when(F.col(c), "true")
    pairs = {"name": F.when(parsed, F.coalesce(F.try_variant_get(v, "$.name", "string"), F.lit(""))), "language": language, "framework": F.coalesce(ruby, python, node, plain), "has_docker": yes("has_docker"), "has_compose": yes("has_compose"), "has_terraform": yes("has_terraform")}
    return facts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in pairs.items()])).alias("x")).select("x.*").where("value is not null")


def read_projects(spark: SparkSession, registry: DataFrame, table: str) -> DataFrame:
    """A table of all registered projects that have it, with their project_path and project_name, in one scan; the registry is small and is read first."""
    from loomstore.operators.snapshots import Store, with_project
    from loomstore.plans.schemas import empty

    folders, projects = [], {}
    for r in registry.select("project_path", "db_path").collect():
        store = Store(spark, r["db_path"])
        if parts := store._parts(table, store.version(table)):
            projects[store.root] = r["project_path"]
            folders += [f"{store.root}/{table}/{v}" for v in parts.values()]
    if not folders:
        return empty(spark, table).withColumns({"project_path": F.lit(None).cast("string"), "project_name": F.lit(None).cast("string")})
    rows = with_project(spark.read.option("mergeSchema", True).parquet(*folders), projects, table)
    kept = {f.name: (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType) for f in empty(spark, table).schema}
    return rows.select(*(c.alias(n) for n, c in kept.items()), "project_path").join(registry.select("project_path", F.col("name").alias("project_name")), "project_path")


class SqliteTable(DataSource):
    """format("sqlite-table"): a table of an SQLite file that executors can open; `key` splits it by ranges of its rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite-table"

    def schema(self) -> str:
        import sqlite3

        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            columns = c.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["dbtable"],)).fetchall()
        return ", ".join(f"`{n}` {kinds.get(t.upper(), 'string')}" for n, t in columns)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, [f.name for f in schema])


class _SqliteReader(DataSourceReader):
    def __init__(self, options, columns):
        self.path, self.table, self.parts, self.columns = options["path"], options["dbtable"].replace('"', '""'), int(options.get("numpartitions", 4)), columns

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._connect() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return []
        step = (high - low) // self.parts + 1
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition):
        names = ", ".join('"' + n.replace('"', '""') + '"' for n in self.columns)
        with self._connect() as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.value)
