"""Windows over turns: token budgets, last turns, appended positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions.text import token_estimate


def cost(estimate: Column, content: Column) -> Column:
    """The stored estimate unless it is missing or 0, else a quarter of the characters."""
    return F.coalesce(F.nullif(estimate, F.lit(0)), token_estimate(content))


def within_budget(turns: DataFrame, tokens: int | None, by: list[str], newest_first: list[Column]) -> DataFrame:
    """The newest turns of each group while their running cost fits (all without a budget); costs are not negative, so the prefix ends at the first that doesn't."""
    if tokens is None:
        return turns
    w = Window.partitionBy(*by).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(cost(F.col("token_est"), F.col("content"))).over(w)
    return turns.withColumn("running", running).where(F.col("running") <= max(0, tokens)).drop("running")


def session_budget(turns: DataFrame, tokens: int | None) -> DataFrame:
    return within_budget(turns, tokens, ["session_id"], [F.col("turn_index").desc()])


def thread_budget(turns: DataFrame, tokens: int | None) -> DataFrame:
    """Over all sessions of a thread: sessions by start, then turns; `turns` has thread_id and started_at."""
    return within_budget(turns, tokens, ["thread_id"], [F.col("started_at").desc(), F.col("session_id").desc(), F.col("turn_index").desc()])


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("turn_index").desc()))
    return turns.withColumn("place", place).where(F.col("place") <= n).drop("place")


def last_of_role(turns: DataFrame, role: str = "assistant") -> DataFrame:
    return turns.where(F.col("role") == role).groupBy("session_id").agg(F.max_by("content", "turn_index").alias("content"), F.max("turn_index").alias("turn_index"))


def truncated(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Per session: turns in all, turns kept, turns cut."""
    n = kept.groupBy("session_id").agg(F.count("*").alias("kept"))
    total = turns.groupBy("session_id").agg(F.count("*").alias("total"))
    return total.join(n, "session_id", "left").select("session_id", "total", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("total") - F.coalesce("kept", F.lit(0))).alias("cut"))


def pack(rows: DataFrame, shares: dict[str, float], tokens: int) -> DataFrame:
    """Of (section, rank, est) the rows that fit one budget, with `cut`: the tokens that a last, partial row has left.

    Each section, in the order of `shares`, first has its share of the budget.
    What sections leave of theirs goes to the rows left over, by section and
    rank; the first of them that does not fit is cut to what remains.  A row takes a
    token at least, so a section's first `tokens` rows are all that can matter.
    """
    order = F.array_position(F.array(*map(F.lit, shares)), F.col("section")).cast("int")
    quota = F.element_at(F.create_map(*(F.lit(x) for k, v in shares.items() for x in (k, int(v * tokens)))), F.col("section"))
    by_section = Window.partitionBy("section").orderBy("rank")
    rows = rows.where(F.col("section").isin(list(shares))).withColumn("est", F.greatest("est", F.lit(1)).cast("bigint")).withColumn("n", F.row_number().over(by_section)).where(F.col("n") <= tokens).drop("n")
    rows = rows.withColumn("sum", F.sum("est").over(by_section.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("first", F.col("sum") <= quota)
    used = F.sum(F.when(F.col("first"), F.col("est")).otherwise(0)).over(Window.partitionBy())  # sections * tokens rows at most
    over = Window.partitionBy("first").orderBy(order, "rank")
    before = F.coalesce(F.sum("est").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.lit(tokens) - used).withColumn("room", F.col("left") - before)
    rows = rows.where(F.col("first") | (F.col("room") > 0))
    return rows.withColumn("cut", F.when(~F.col("first") & (F.col("room") < F.col("est")), F.col("room"))).withColumn("section_order", order).drop("sum", "first", "left", "room")
