"""The full-text query language, and its evaluation over arrays of tokens.

    query  = or ; or = and {"OR" and} ; and = not {["AND"] not} ; not = item {"NOT" item}
    item   = word | word"*" | "a phrase" | column ":" item | "(" or ")"

Words of one query item that the tokenizer splits make a phrase.  Anything else
is a ValueError.  A query is compiled to one boolean column, and its phrases to
counts for ranking; no row leaves the JVM unless stems are asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|([()])|([\w]+)\s*:|(\w+)(\*)?)')
_TOKEN = re.compile(r"[^\W_]+")


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    column: str | None = None


@dataclass
class Node:
    op: str  # and, or, not, phrase
    parts: list[Node] = field(default_factory=list)
    phrase: Phrase | None = None


def _terms(text: str) -> list[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return _TOKEN.findall(plain)


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"full-text query: cannot read {text[at:].strip()[:20]!r}")
        quoted, star, bracket, column, word, word_star = m.groups()
        if quoted is not None:
            out.append(("prefix" if star else "phrase", quoted.replace('""', '"')))
        elif bracket:
            out.append((bracket, bracket))
        elif column:
            out.append(("column", column))
        elif word in ("AND", "OR", "NOT"):
            out.append((word, word))
        else:
            out.append(("prefix" if word_star else "phrase", word))
        at = m.end()
    return out


def parse(text: str) -> Node | None:
    """The query's tree; None for a blank query."""
    items = _lex(text)
    if not items:
        return None
    at = 0

    def peek() -> str:
        return items[at][0] if at < len(items) else ""

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(items):
            raise ValueError("full-text query: it ends too early")
        at += 1
        return items[at - 1]

    def either() -> Node:
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both() -> Node:
        parts = [without()]
        while peek() not in ("", ")", "OR"):
            if peek() == "AND":
                take()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def without() -> Node:
        left = item()
        while peek() == "NOT":
            take()
            left = Node("not", [left, item()])
        return left

    def item(column: str | None = None) -> Node:
        kind, value = take()
        if kind == "(":
            inside = either()
            if take()[0] != ")":
                raise ValueError("full-text query: a bracket is open")
            return inside
        if kind == "column":
            return item(value)
        if kind not in ("phrase", "prefix"):
            raise ValueError(f"full-text query: {value!r} is out of place")
        return Node("phrase", phrase=Phrase(_terms(value), kind == "prefix", column))

    tree = either()
    if at < len(items):
        raise ValueError(f"full-text query: {items[at][1]!r} is out of place")
    return tree


def words_query(text: str) -> str | None:
    """All ASCII words of free text, each quoted; None without any. Never a syntax error."""
    words = re.findall(r"[A-Za-z0-9_]+", text)
    return " ".join(f'"{w}"' for w in words) or None


def phrases(node: Node) -> list[Phrase]:
    """The phrases that may add to a rank: not those after NOT."""
    if node.phrase:
        return [node.phrase] if node.phrase.terms else []
    return [p for part in (node.parts[:1] if node.op == "not" else node.parts) for p in phrases(part)]


def all_phrases(node: Node) -> list[Phrase]:
    """Every phrase of the query that has a word, also those after NOT."""
    if node.phrase:
        return [node.phrase] if node.phrase.terms else []
    return [p for part in node.parts for p in all_phrases(part)]


def frequency(phrase: Phrase, tokens: Column) -> Column:
    """How often the phrase occurs in the tokens."""
    same = lambda x, t, last: x.startswith(t) if last and phrase.prefix else x == t
    n = len(phrase.terms)
    if n == 1:
        return F.size(F.filter(tokens, lambda x: same(x, phrase.terms[0], True)))
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, t in enumerate(phrase.terms):
            out = out & same(F.get(tokens, i + k), t, k == n - 1)
        return out

    return F.size(F.filter(starts, here))


def matches(node: Node, frequency_of) -> Column:
    """Whether a row fits; `frequency_of(phrase)` gives a phrase's count."""
    if node.phrase:
        return frequency_of(node.phrase) > 0 if node.phrase.terms else F.lit(False)
    parts = [matches(p, frequency_of) for p in node.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out | p if node.op == "or" else out & ~p if node.op == "not" else out & p
    return out
