"""Chat formatting by quotation linking.

A line's quote level is the number of ">" marks it starts with (spaces between
them are allowed).  Neighbouring lines of one level, 1 or more, are a quoted
passage.  A passage is normalised (marks off, lower case, runs of white space to
one space) and hashed, and so are the unquoted texts of all messages: whole,
each paragraph, and each line.  A passage is joined to the earliest message that
has it: one before it in its own conversation if there is one, else the first
message of another conversation.  A passage of several lines that no message has
in one of these forms is joined in the same order to the messages that have its
lines in a run (blank lines left out): where a message has a passage's first line,
the run from there of as many lines is hashed, by the lines' own hashes.  The message's reply target is the source of
its first passage of the lowest level in its own conversation, else the turn
before it.  Each conversation is put in reply order: replies to an earlier
message come first, then by turn; a reply never precedes its target.

Only DataFrame functions are used.  The side that passages are joined to holds
one row for each hash (with the first two conversations that have it, as one
may be the passage's own) and one for each hash and conversation, so a passage that
thousands of messages share joins as one row.  Conversations are put in order in
ranges of the whole table: a conversation that holds many of its rows, or all rows
without one, are numbered in several ranges at once, each from where the one
before it ends.

A null text is empty; a message without a conversation or turn is kept, links to
nothing, and sorts first; rows without a conversation are ordered as if they were of one.
A line that only introduces a quote (it ends in "wrote:" right before a quoted line)
goes with the quote.  Texts of any length are read whole.  Repeated rows stay rows,
with places one after another; ties in the order go by role and a hash of the text.
An empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MARKS = r"^(?:[ \t]*>)+[ \t]?"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds `lines` (level, line without marks), `plain` (the text without quotes) and `passages` (level, place, text)."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(_level(x).alias("level"), F.when(_level(x) > 0, F.regexp_replace(x, MARKS, "")).otherwise(x).alias("line")))
    out = messages.withColumn("lines", lines)
    introduces = "lines[i].level = 0 and rtrim(lines[i].line) like '%wrote:' and i + 1 < size(lines) and lines[i + 1].level > 0"
    out = out.withColumn("plain", F.expr(f"trim('\\n', array_join(transform(filter(lines, (x, i) -> x.level = 0 and not ({introduces})), x -> x.line), '\\n'))"))
    starts = "filter(sequence(0, size(lines) - 1), i -> lines[i].level > 0 and (i = 0 or lines[i - 1].level <> lines[i].level))"
    stops = "filter(sequence(0, size(lines) - 1), i -> lines[i].level > 0 and (i = size(lines) - 1 or lines[i + 1].level <> lines[i].level))"
    out = out.withColumn("starts", F.expr(starts)).withColumn("stops", F.expr(stops))
    passages = "transform(starts, (a, k) -> named_struct('level', lines[a].level, 'place', k, 'text', array_join(transform(slice(lines, a + 1, stops[k] - a + 1), x -> x.line), '\\n')))"
    return out.withColumn("passages", F.expr(passages)).drop("starts", "stops")


def _lines(text: Column) -> Column:
    """The normalised lines of a text that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def _sources(own: DataFrame, key: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The first message that has a hash, by conversation and hash, and those of the first two conversations that have it, by hash, from (conv_id, turn, `key`)."""
    own = own.where("turn is not null and conv_id is not null")
    in_conv = own.groupBy("conv_id", key).agg(F.min("turn").alias(f"{prefix}near"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("conv_id"))  # each task keeps two rows a hash before they meet
    first = in_conv.withColumn("place", place).where("place <= 2").groupBy(key)
    return in_conv, first.agg(F.sort_array(F.collect_list(F.struct("conv_id", F.col(f"{prefix}near").alias("turn")))).alias(f"{prefix}far"))  # two at most


def _runs(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """(conv_id, turn, run): hashes of the runs of lines that may be one of `passages` (lines: hashes of theirs).

    A run is hashed where a passage's first line stands, for the lengths of the
    passages that begin with that line.
    """
    first = passages.groupBy(F.get("lines", 0).alias("h")).agg(F.collect_set(F.size("lines")).alias("lengths"))  # at most as many as there are lengths
    held = rows.select("conv_id", "turn", "ls").where("size(ls) > 1").withColumn("m", F.xxhash64("ls")).distinct()
    places = held.select("conv_id", "turn", "m", F.posexplode("ls").alias("place", "h")).groupBy("conv_id", "turn", "m", "h").agg(F.collect_list("place").alias("places"))
    starts = places.join(first, "h").groupBy("conv_id", "turn", "m").agg(F.collect_list(F.struct("places", "lengths")).alias("starts"))
    runs = F.expr("flatten(transform(starts, s -> flatten(transform(s.places, i -> transform(filter(s.lengths, n -> i + n <= size(ls)), n -> xxhash64(slice(ls, i + 1, n)))))))")
    return held.join(starts, ["conv_id", "turn", "m"]).select("conv_id", "turn", F.explode(F.array_distinct(runs)).alias("run"))


def _hashes(text: Column) -> Column:
    return F.transform(_lines(text), lambda x: F.xxhash64(x))


def quote_links(rows: DataFrame) -> DataFrame:
    """(row key columns, level, place, source_conv, source_turn) of the passages of `rows` (of `parsed`, with the lines' hashes `ls`) that have a source."""
    keyed = F.transform(F.filter(F.transform(F.concat(F.array("plain"), F.split("plain", r"\n\s*\n"), F.split("plain", "\n")), normalised), lambda x: x != ""), lambda x: F.xxhash64(x))
    found = rows.select("conv_id", "turn", F.explode("passages").alias("p")).withColumn("hash", F.xxhash64(normalised(F.col("p.text")))).where(normalised(F.col("p.text")) != "").distinct()
    found = found.withColumn("lines", _hashes(F.col("p.text"))).withColumn("run", F.when(F.size("lines") > 1, F.xxhash64("lines")))
    wholes = rows.select("conv_id", "turn", F.explode(F.array_distinct(keyed)).alias("hash"))
    runs = _runs(rows, found.where("run is not null").select("lines"))
    for prefix, key, own in (("", "hash", wholes), ("run_", "run", runs)):
        in_conv, anywhere = _sources(own, key, prefix)
        found = found.join(in_conv, ["conv_id", key], "left").join(anywhere, key, "left")
    source = F.coalesce(*(
        x for k in ("", "run_")
        for x in (F.when(F.col(f"{k}near") < F.col("turn"), F.struct("conv_id", F.col(f"{k}near").alias("turn"))), F.get(F.filter(f"{k}far", lambda s: s["conv_id"] != F.col("conv_id")), 0))
    ))
    found = found.withColumn("source", source).where("source is not null")
    return found.select("conv_id", "turn", F.col("p.level").alias("level"), F.col("p.place").alias("place"), "hash", F.col("source.conv_id").alias("source_conv"), F.col("source.turn").alias("source_turn"))


def _ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """`rows`, written, in ranges of conversations and `order`; `range` numbers the ranges upwards."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(ranges, "conv_id", *order, F.rand(1)).withColumn("range", F.spark_partition_id()), "ranges")


def _with_turn_before(rows: DataFrame) -> DataFrame:
    """Adds `before`, the largest smaller turn of the conversation."""
    turns = _ranged(rows.select("conv_id", "turn").distinct(), "turn")
    here = F.lag("turn").over(Window.partitionBy("conv_id", "range").orderBy("turn"))
    ends = turns.groupBy("conv_id", "range").agg(F.max("turn").alias("last"))  # a row for each range that a conversation lies in
    ends = ends.select("conv_id", "range", F.max("last").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    t, e = turns.withColumn("here", here).alias("t"), ends.alias("e")
    turns = t.join(e, F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("t.range") == F.col("e.range"))).select("t.conv_id", "t.turn", F.coalesce("here", "earlier").alias("before")).where("before is not null")
    r, t = rows.alias("r"), turns.alias("t")
    return r.join(t, F.col("r.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("r.turn") == F.col("t.turn")), "left").select("r.*", "t.before")


def _numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds `position`, from 1 on in each conversation, by `order`."""
    rows = _ranged(rows, *order)
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))  # a row for each range that a conversation lies in
    sizes = sizes.select("conv_id", "range", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    r, s = rows.withColumn("here", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))).alias("r"), sizes.alias("s")
    joined = r.join(s, F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.range") == F.col("s.range")))
    return joined.select("r.*", (F.col("here") + F.col("earlier")).cast("int").alias("position")).drop("range", "here")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, text (without quotes), n_quotes, max_level, n_linked, reply_conv, reply_turn, position."""
    rows = parsed(messages.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", "plain", "passages")
    # Written: a filter on what is parsed would else be pushed into it, and parse all lines anew for each line
    rows = materialize(rows.withColumn("ls", _hashes(F.col("plain"))), "parsed")
    links = quote_links(rows).groupBy("conv_id", "turn", "hash", "level", "place").agg(F.min(F.struct("source_conv", "source_turn")).alias("s"))
    best = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min(F.when(F.col("s.source_conv") == F.col("conv_id"), F.struct("level", "place", F.col("s.source_turn").alias("t")))).alias("near"), F.min(F.struct("level", "place", F.col("s.source_conv").alias("c"), F.col("s.source_turn").alias("t"))).alias("any"))
    levels = F.transform("passages", lambda p: p["level"])
    rows = rows.select("conv_id", "turn", "role", F.col("plain").alias("text"), F.size("passages").alias("n_quotes"), F.coalesce(F.array_max(levels), F.lit(0)).alias("max_level"))
    rows = _with_turn_before(rows).join(best, ["conv_id", "turn"], "left")
    near = F.coalesce(F.col("near.t"), F.col("before"))
    far = F.col("near").isNull() & F.col("any").isNotNull()
    rows = rows.select(
        "conv_id", "turn", "role", "text", "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.when(far, F.col("any.c")).when(near.isNotNull(), F.col("conv_id")).alias("reply_conv"), F.when(far, F.col("any.t")).otherwise(near).alias("reply_turn"), near.alias("target"),
    )
    return _numbered(rows, "target", "turn", "role", F.xxhash64("text")).drop("target")


def chat_lines(linked: DataFrame) -> DataFrame:
    """(conv_id, position, line): the messages as lines of a chat template."""
    return linked.select("conv_id", "position", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>"), "text").alias("line"))
