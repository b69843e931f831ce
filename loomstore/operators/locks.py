"""Exclusive file locks and write conflicts, folded from ordered events.

Events are (event_id, ts, op, file_path, session_id, llm_name); ops are claim,
release, release_all, end_session and write.

What some events of a file do is a transition: from each owner that the file may
have before them to the owner after.  Only sessions that claim or release in them
need an entry; any other owner stays.  Transitions compose, so events are folded in
segments of their numbers, the segments' transitions are composed in order from the
owner that a snapshot gives, and each segment is then gone through from its own
entry.  All of it is done by Spark's own functions; a segment has at most SEGMENT events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions.text import slashes

OWNERS = "file_path string, session_id string, llm_name string"
#: Numbers of events that make a segment.
SEGMENT = 512
#: Stands for the name of the LLM that an owner came with.
_CAME = "'\\u0000'"
_OWNER = "struct<s: string, l: string>"
_NOBODY = f"cast(named_struct('s', null, 'l', null) as {_OWNER})"
#: The owner `o` after the event `e`; then whether `e` took effect.
_AFTER = f"case when e.op = 'claim' and (o.s is null or o.s = e.session_id) then cast(named_struct('s', e.session_id, 'l', e.llm_name) as {_OWNER}) when e.op = 'release' and o.s = e.session_id then {_NOBODY} else o end"
_GRANTED = "case e.op when 'claim' then o.s is null or coalesce(o.s = e.session_id, false) when 'release' then coalesce(o.s = e.session_id, false) end"


def _expanded(events: DataFrame, owners: DataFrame | None) -> DataFrame:
    """Releases of everything, as one release for each file the session claimed, or owned before."""
    rows = events.withColumn("file_path", slashes(F.col("file_path")))
    claimed = rows.where("op = 'claim'").select("file_path", "session_id")
    if owners is not None:
        claimed = claimed.unionByName(owners.select("file_path", "session_id"))
    wide = rows.where("op in ('release_all', 'end_session')").drop("file_path").join(claimed.distinct(), "session_id").withColumn("op", F.lit("release"))
    return rows.where("op not in ('release_all', 'end_session')").unionByName(wide.select(*rows.columns))


def transitions(events: DataFrame) -> DataFrame:
    """(file_path, segment, ev, none, moved): a segment's events in order, whom nobody's file is left to, and (start, end) for the owners that it may move."""
    segment = F.floor(F.col("event_id") / SEGMENT)
    rows = events.groupBy("file_path", segment.alias("segment")).agg(F.sort_array(F.collect_list(F.struct("event_id", "op", "session_id", "llm_name"))).alias("ev"))
    starts = "array_distinct(transform(filter(ev, e -> e.op in ('claim', 'release') and e.session_id is not null), e -> e.session_id))"
    through = lambda start: f"aggregate(ev, {start}, (o, e) -> {_AFTER})"
    came = f"cast(named_struct('s', x, 'l', {_CAME}) as {_OWNER})"
    return rows.withColumn("none", F.expr(through(_NOBODY))).withColumn("moved", F.expr(f"transform({starts}, x -> named_struct('start', x, 'end', {through(came)}))"))


def fold_locks(events: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(event_id, file_path, session_id, op, granted, owner, owner_llm): each event of a file, whether a claim or release took effect, and who owns the file after it.

    The first claim wins; claiming again is granted to the owner; others'
    releases do nothing.  `owners` (OWNERS) is who held files before the events.
    """
    parts = transitions(_expanded(events, owners))
    found = "filter(t.moved, z -> z.start = acc.o.s)[0].end"
    applied = f"case when acc.o.s is null then t.none when size(filter(t.moved, z -> z.start = acc.o.s)) = 0 or ({found}.s = acc.o.s and {found}.l = {_CAME}) then acc.o else {found} end"
    whole = parts.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("segment", "none", "moved"))).alias("ts"))
    if owners is not None:
        whole = whole.join(owners.groupBy("file_path").agg(F.max(F.struct(F.col("session_id").alias("s"), F.col("llm_name").alias("l"))).alias("held")), "file_path", "left")
    start = f"coalesce(held, {_NOBODY})" if owners is not None else _NOBODY
    entries = f"""aggregate(ts, named_struct('o', {start}, 'at', cast(array() as array<struct<segment: bigint, o: {_OWNER}>>)),
      (acc, t) -> named_struct('o', {applied}, 'at', concat(acc.at, array(named_struct('segment', t.segment, 'o', acc.o)))), acc -> acc.at)"""
    entries = whole.select("file_path", F.explode(F.expr(entries)).alias("at")).select("file_path", "at.segment", F.col("at.o").alias("entry"))
    steps = f"""aggregate(ev, named_struct('o', entry, 'out', cast(array() as array<struct<e: struct<event_id: bigint, op: string, session_id: string, llm_name: string>, granted: boolean, o: {_OWNER}>>)),
      (acc, e) -> named_struct('o', {_AFTER.replace("o.s", "acc.o.s").replace("else o end", "else acc.o end")}, 'out', concat(acc.out, array(named_struct('e', e, 'granted', {_GRANTED.replace("o.s", "acc.o.s")}, 'o', {_AFTER.replace("o.s", "acc.o.s").replace("else o end", "else acc.o end")})))), acc -> acc.out)"""
    out = parts.select("file_path", "segment", "ev").join(entries, ["file_path", "segment"]).select("file_path", F.explode(F.expr(steps)).alias("x"))
    return out.select(F.col("x.e.event_id").alias("event_id"), "file_path", F.col("x.e.session_id").alias("session_id"), F.col("x.e.op").alias("op"), F.col("x.granted").alias("granted"), F.col("x.o.s").alias("owner"), F.col("x.o.l").alias("owner_llm"))


def current_locks(folded: DataFrame) -> DataFrame:
    last = folded.groupBy("file_path").agg(F.max_by(F.struct("owner", "owner_llm"), "event_id").alias("o"))
    return last.where("o.owner is not null").select("file_path", F.col("o.owner").alias("session_id"), F.col("o.owner_llm").alias("llm_name"))


def owners_after(owners: DataFrame, folded: DataFrame) -> DataFrame:
    """Who holds files after folded events, of files that had `owners` (OWNERS) before."""
    return owners.join(folded.select("file_path").distinct(), "file_path", "left_anti").unionByName(current_locks(folded))


def conflicts(folded: DataFrame) -> DataFrame:
    """(event_id, file_path, session_a, session_b): refused claims, and writes to a file that another session owns."""
    bad = ((F.col("op") == "claim") & ~F.col("granted")) | ((F.col("op") == "write") & F.col("owner").isNotNull() & (F.col("owner") != F.col("session_id")))
    return folded.where(bad).select("event_id", "file_path", F.col("owner").alias("session_a"), F.col("session_id").alias("session_b"))


def write_conflicts(owners: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes to a file that another session owns: the same file, and a different session. `owners` has a row a file."""
    own = owners.select("file_path", F.col("session_id").alias("session_a"))
    return writes.join(own, "file_path").where(F.col("session_a") != F.col("session_id")).withColumnRenamed("session_id", "session_b")


def resolve(conflicts_: DataFrame, now, by: str, conflict_id: int | None = None, path: str | None = None) -> DataFrame:
    """Open conflicts of an id, or of a file, become resolved."""
    chosen = ~F.coalesce("resolved", F.lit(False)) & ((F.col("id") == conflict_id) if conflict_id is not None else (F.col("file_path") == path))
    for name, value in (("resolved_at", now), ("resolved_by", F.lit(by)), ("resolved", F.lit(True))):
        conflicts_ = conflicts_.withColumn(f"new_{name}", F.when(chosen, value).otherwise(F.col(name)))
    return conflicts_.drop("resolved_at", "resolved_by", "resolved").withColumnsRenamed({f"new_{n}": n for n in ("resolved_at", "resolved_by", "resolved")})


def active_session(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Events (event_id, ts) with the session that started last at or before them: a union and one window, no range join.

    Days are ordered apart: each carries in the last start of the days before it.
    """
    day = lambda c: F.to_date(c)
    both = events.select("event_id", "ts", F.lit(None).cast("string").alias("session_id"), F.lit(1).alias("kind")).unionByName(starts.select(F.lit(None).cast("bigint").alias("event_id"), "ts", "session_id", F.lit(0).alias("kind")))
    both = both.withColumn("day", day("ts"))
    last = starts.withColumn("day", day("ts")).groupBy("day").agg(F.max(F.struct("ts", "session_id")).alias("l"))
    days = both.select("day").distinct().join(last.select("day", "l"), "day", "left")
    carried = days.withColumn("carried", F.last("l", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "carried")  # a row a day
    inside = F.last("session_id", ignorenulls=True).over(Window.partitionBy("day").orderBy("ts", "kind", "session_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("s", inside).where("kind = 1").join(carried, "day", "left")
    return rows.select("event_id", "ts", F.coalesce("s", F.col("carried.session_id")).alias("session_id"))
