"""Column functions over text: redaction, estimates, cuts, names, paths and times.  All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a secret, and what replaces it.
ASSIGNED_SECRET = r"\b(api[_-]?key|token|secret|password|access[_-]?token)\s*=\s*([^\s,;]+)"
STANDALONE_SECRETS = [
    r"\bsk-(?:live|test)-[A-Za-z0-9_-]{8,}\b",
    r"\bghp_[A-Za-z0-9_]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
]
PRIVACY_RULES = ["assignment_secrets", "openai_keys", "github_tokens", "slack_tokens"]


def redact(text: Column) -> Column:
    """Secrets in assignments keep their name; token shapes go whole."""
    out = F.regexp_replace(text, "(?i)" + ASSIGNED_SECRET, "$1=[REDACTED]")
    for shape in STANDALONE_SECRETS:
        out = F.regexp_replace(out, shape, "[REDACTED_SECRET]")
    return out


def token_estimate(text: Column, least: int = 0) -> Column:
    """A quarter of the characters, rounded down; `least` is 1 for imports and budgets."""
    quarter = F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")
    return F.greatest(F.lit(least), quarter) if least else quarter


def shorten(text: Column, most: int, keep: int | None = None, mark: str = "...") -> Column:
    """Texts of over `most` characters are cut to `keep` (most less the mark's length) and marked."""
    keep = most - len(mark) if keep is None else keep
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)


def trim_to_tokens(text: Column, tokens: int, mark: str = "\n…(truncated)") -> Column:
    """At most four characters a token; a limit of 0 or less is none."""
    if tokens <= 0:
        return text
    return F.when(F.length(text) > tokens * 4, F.concat(F.rtrim(F.substring(text, 1, tokens * 4)), F.lit(mark))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\r\n]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def last_name(qualified: Column) -> Column:
    return F.substring_index(qualified, "::", -1)


def slug(text: Column, words: int = 4, default: str = "thread") -> Column:
    found = F.array_join(F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), 1, words), "-")
    return F.when(found == "", default).otherwise(found)


def folder_slug(path: Column) -> Column:
    """A project folder's name as an editor stores it: no drive colon, one dash for separators and spaces."""
    out = F.regexp_replace(path, r"^([A-Za-z]):", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"[\\/ ]+|-+", "-"), r"^-+|-+$|(?<=-)-+", "")


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def recency(ts: Column, now: Column, half_life_hours: float = 168.0, missing: float = 0.3) -> Column:
    """Half after each half-life; times to come count as now, and missing ones as `missing`."""
    hours = (F.unix_micros(now) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9
    return F.when(hours.isNull(), missing).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours) / half_life_hours))


def age(ts: Column, now: Column) -> Column:
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1e6)
    unit = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(u))
    return F.when(ts.isNull(), "").when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def timestamp(text: Column) -> Column:
    """Either stored form, with a space or a T, with or without a zone; unreadable ones are null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


# Letters with marks, and what is left without them; made by rule from every character that is taken apart into a letter and marks.
_MARKED = [(chr(c), d[0]) for c in range(0xC0, 0x3000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(map(unicodedata.combining, d[1:]))]


def fold(text: Column) -> Column:
    """Lower case without diacritics, whether a letter holds its marks or they follow it."""
    bare = F.regexp_replace(text, r"\p{M}+", "")
    return F.lower(F.translate(bare, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def like_literal(text: str) -> str:
    """A LIKE pattern in which % and _ stay wildcards and backslashes are ordinary."""
    return text.replace("\\", "\\\\")


def contains_ignoring_case(col: Column, text: str) -> Column:
    """The LIKE '%text%' of stored data: case is ignored, % and _ in the text are wildcards."""
    return F.lower(col).like(f"%{like_literal(text.lower())}%")


# Beginnings of texts that tools put before the first question.
PREAMBLES = ["<environment_context>", "<INSTRUCTIONS>", "# AGENTS.md", "<user_instructions>", "<system"]


def is_preamble(text: Column) -> Column:
    head = F.lower(F.substring(F.ltrim(text), 1, 40))
    out = F.lit(False)
    for p in PREAMBLES:
        out = out | head.startswith(p.lower())
    return out


# The colours that tools are drawn in.
TOOL_COLOURS = [("cursor", "purple"), ("claude", "deep-orange"), ("codex", "blue"), ("openai", "blue")]


def tool_colour(llm_name: Column) -> Column:
    """The colour of the first tool that an LLM's name tells, else steel."""
    out = F.lit("steel")
    for part, colour in reversed(TOOL_COLOURS):
        out = F.when(F.lower(llm_name).contains(part), colour).otherwise(out)
    return out
