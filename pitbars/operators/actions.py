"""Corporate actions, membership and trading status, vendor signers: rows to checked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions import symbols
from pitbars.operators import store


def action_dedup(actions: DataFrame, order: list[Column]) -> DataFrame:
    """One action for each code, effective date, cash and multiplier: the last in the given order."""
    return store.last_by(actions, ["code", "effective", "cash", "multiplier"], order)


def action_coverage(requested: DataFrame, events: DataFrame) -> DataFrame:
    """One row (event_count, zero_event_symbols): a requested code without events is covered, with none."""
    counted = events.groupBy("code").agg(F.count("*").alias("n"))
    known = requested.select("code").distinct().join(counted, "code", "left")
    return known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"), F.count(F.when(F.col("n").isNull(), 1)).alias("zero_event_symbols"))


def land_member_frames(frames: DataFrame) -> DataFrame:
    """Vendor rows (raw, type) of the two main exchanges under their codes; other exchanges are left out, other types are an error."""
    kept = frames.withColumn("code", symbols.exchange_code(F.col("raw"))).where("code is not null")
    stock = F.when(F.col("type").eqNullSafe("stock"), True).otherwise(F.raise_error(F.concat(F.lit("not a stock: "), F.col("raw"))))
    return kept.where(stock).drop("raw", "type")


def judge_status_frames(frames: DataFrame) -> DataFrame:
    """(code, date, is_tradable, status, reason) of every cell of (code, date, paused): active or suspended where exactly one row says 0 or 1;
    else invalid, with is_tradable null and a reason (repeated_row, not_a_flag)."""
    counted = frames.groupBy("code", "date").agg(F.count("*").alias("times"), F.max("paused").alias("paused"))
    reason = F.when(F.col("times") > 1, "repeated_row").when(~F.coalesce(F.col("paused").isin(0, 1), F.lit(False)), "not_a_flag")
    judged = counted.withColumn("reason", reason)
    tradable = F.when(F.col("reason").isNull(), F.col("paused") == 0)
    status = F.when(F.col("reason").isNotNull(), "invalid").when(F.col("paused") == 0, "active").otherwise("suspended")
    return judged.select("code", "date", tradable.alias("is_tradable"), status.alias("status"), "reason")


def land_status_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): code, date, is_tradable, status of cells without a reason against them, and code, date, reason of the others."""
    judged = judge_status_frames(frames)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("code", "date", "reason")


def status_values(market: DataFrame) -> DataFrame:
    """Adds name (trimmed), board, is_st, is_suspended to rows (code, name, trade, volume). valid is false for a blank name or a number
    that is missing or not finite; the flags are null then."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    valid = F.coalesce(F.trim("name") != "", F.lit(False)) & finite("trade") & finite("volume")
    out = market.withColumn("valid", valid).withColumn("name", F.trim("name")).withColumn("board", symbols.board(F.col("code")))
    return out.withColumn("is_st", F.when(F.col("valid"), F.upper("name").contains("ST"))).withColumn("is_suspended", F.when(F.col("valid"), (F.col("trade") <= 0) | (F.col("volume") <= 0)))


def quote_to_final_bar(quotes: DataFrame, start: str, end: str, latest: Column) -> DataFrame:
    """Quotes within the range and no later than the latest final date; lots become shares."""
    day = F.col("date")
    return quotes.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (day <= latest)).withColumn("volume", (F.col("lots") * 100).cast("long")).drop("lots")


def sync_summary(planned: DataFrame, results: DataFrame) -> DataFrame:
    """One row (synced, up_to_date, errors, no_data): codes of a plan (code, status) that had no gap, and what became of the others
    (code, status)."""
    states = planned.where("status = 'up_to_date'").select("code", "status").unionByName(results.select("code", "status")).distinct()
    of = lambda status: F.count_distinct(F.when(F.col("status") == status, F.col("code")))
    return states.agg(of("synced").alias("synced"), of("up_to_date").alias("up_to_date"), of("error").alias("errors"), of("no_data").alias("no_data"))
