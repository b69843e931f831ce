"""python -m loomstore --root FOLDER GROUP COMMAND [ARGS...]: the engine's calls from a shell; tables are printed as JSON lines.

Arguments are passed by position, or by name as name=value.  Examples:
    session start claude "fix login"      session handoff tokens=2000      graph impact src/a.py,src/b.py
    project index /src/app                locks claim src/a.py claude-1    global search "retry loop"
"""

from __future__ import annotations

import argparse
import inspect
import json

from pyspark.sql import DataFrame, SparkSession

from loomstore.engine import Engine, Registry

GROUPS = {"project": None, "session": "sessions", "sync": "sync", "thread": "threads", "context": "context", "graph": "graph", "locks": "locks", "privacy": "privacy", "global": "registry"}


def _typed(parameter: inspect.Parameter, text: str):
    if parameter.annotation is parameter.empty:
        return int(text) if text.isdigit() else text
    kind = str(parameter.annotation)
    if kind.startswith("list[tuple"):
        return [tuple(x) for x in json.loads(text)]
    if kind.startswith("list") or kind.startswith("tuple"):
        return text.split(",")
    return int(text) if kind.startswith("int") else text.lower() in ("1", "true", "yes") if kind.startswith("bool") else text


def call(target: object, command: str, arguments: list[str]) -> object:
    fn = getattr(target, command.replace("-", "_"), None)
    if fn is None or command.startswith("_") or not callable(fn):
        raise SystemExit(f"no command {command!r}")
    parameters = inspect.signature(fn).parameters
    names = [n for n, p in parameters.items() if p.kind is not p.VAR_KEYWORD]
    given, position = {}, 0
    for a in arguments:
        name, eq, value = a.partition("=")
        if eq and (name in names or len(names) < len(parameters)):
            given[name] = _typed(parameters.get(name, inspect.Parameter(name, inspect.Parameter.KEYWORD_ONLY)), value)
        elif position < len(names):
            given[names[position]] = _typed(parameters[names[position]], a)
            position += 1
        else:
            raise SystemExit(f"too many arguments for {command}")
    return fn(**given)


def show(value: object) -> None:
    for part in value if isinstance(value, tuple) else (value,):
        if isinstance(part, DataFrame):
            for line in part.toJSON().toLocalIterator():
                print(line)
        elif isinstance(part, dict):
            print(json.dumps({k: [r.asDict() for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in part.items()}, default=str))
        elif part is not None:
            print(part)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomstore", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--root", required=True, help="folder of the project's tables (of the registry for global)")
    parser.add_argument("group", choices=GROUPS)
    parser.add_argument("command")
    parser.add_argument("arguments", nargs="*")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("loomstore").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Registry(spark, a.root) if a.group == "global" else Engine(spark, a.root)
    part = GROUPS[a.group]
    show(call(engine if part in (None, "registry") else getattr(engine, part), a.command, a.arguments))


if __name__ == "__main__":
    main()
