"""Joins of bars to their receipts and panels, and the fail-closed readiness reports built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitbars.functions import clock
from pitbars.operators import quality
from pitbars.shared import written


def bars_with_receipts(bars: DataFrame, receipts: DataFrame) -> DataFrame:
    """Bars without a receipt stay visible. They have no key to meet a receipt by, so they are dealt out by code and date instead of all
    meeting in the task of the null key."""
    found = receipts.withColumn("_key", F.struct(F.col("receipt_id").alias("id"), F.lit(0).alias("salt"))).withColumnsRenamed({"source": "receipt_source"}).drop("receipt_id").withColumn("has_receipt", F.lit(True))
    salt = F.when(F.col("receipt_id").isNull(), 1 + F.pmod(F.xxhash64("code", "date"), F.lit(1 << 20)).cast("int")).otherwise(0)
    dealt = bars.withColumn("_key", F.struct(F.coalesce("receipt_id", F.lit(0)).alias("id"), salt.alias("salt")))
    joined = dealt.join(found, "_key", "left").drop("_key")
    return joined.select("receipt_id", *(c for c in joined.columns if c != "receipt_id"))


def panel_select(bars: DataFrame, panel: DataFrame) -> DataFrame:
    return bars.join(panel.select("code", "date"), ["code", "date"], "left_semi")


def panel_missing(panel: DataFrame, rows: DataFrame) -> DataFrame:
    return panel.select("code", "date").join(rows, ["code", "date"], "left_anti")


def cell(code: str = "code", date: str = "date") -> Column:
    return F.concat_ws("@", code, F.col(date).cast("string"))


def failures(rows: DataFrame, checks: dict[str, Column], sample: Column) -> DataFrame:
    """Long (blocker, sample): a row for each check that holds, in one pass."""
    named = F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))
    return rows.select(F.explode(named).alias("blocker"), sample.alias("sample"))


def blockers(found: DataFrame, examples: int = 5) -> DataFrame:
    """(blocker, count, examples): distinct samples and the first of them in order. Distinct samples are counted before they are
    ranked, and only the first few of each task's samples go on, so a blocker that every row has stays small."""
    distinct = written(found.distinct(), "blockers")
    counted = distinct.groupBy("blocker").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("blocker").orderBy("sample"))
    first = distinct.withColumn("rank", rank).where(F.col("rank") <= examples).groupBy("blocker").agg(F.array_sort(F.collect_list("sample")).alias("s"))
    return counted.join(first, "blocker").select("blocker", "count", F.concat_ws(",", "s").alias("examples"))


def receipt_covers_bar(payload: Column) -> Column:
    """Whether a row of the response {"fields": "date,open,...", "rows": [[...]]} has the bar's date and, as numbers, its prices and volume."""
    p = F.from_json(payload, "fields string, rows array<array<string>>")
    at = lambda name: F.array_position(F.split(p["fields"], ","), name).cast("int") - 1
    value = lambda r, name: F.get(r, F.when(at(name) >= 0, at(name)))
    same = lambda r: reduce(lambda a, b: a & b, (value(r, n).try_cast("double").eqNullSafe(F.col(n).cast("double")) for n in ("open", "high", "low", "close", "volume")))
    return F.coalesce(F.exists(p["rows"], lambda r: F.coalesce((value(r, "date") == F.col("date").cast("string")) & same(r), F.lit(False))), F.lit(False))


def price_failures(bars: DataFrame, receipts: DataFrame, panel: DataFrame, sessions: DataFrame | None = None, unobserved_end: bool = False) -> DataFrame:
    """Everything that keeps an exact panel of one price identity from being ready. sessions: dates, of which the one after a bar's ends its
    evidence; by default those of the bars themselves. With unobserved_end, a receipt that was retrieved but has no time of observation also
    fails as unknown_next_session where its session is the last, as the registered queries' SQL has it."""
    chosen = written(panel_select(bars, panel), "chosen")
    joined = bars_with_receipts(chosen, receipts).join(quality.next_session(chosen if sessions is None else sessions), "date")
    late = clock.price_availability_error(F.col("date"), F.col("observed_at"), F.col("next_date"))
    joined = joined.withColumn("late", late)
    sure = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  what is unknown is a failure
    held, hash_ok = F.col("has_receipt").isNotNull() & F.col("payload").isNotNull(), sure(F.col("response_sha256") == F.sha2("payload", 256))
    timed = F.col("observed_at").isNotNull() & F.col("retrieved_at").isNotNull()
    checks = {
        "non_final_rows": ~sure(F.col("is_final")),
        "missing_receipts": ~held,
        "receipt_source_mismatch": held & ~sure(F.col("receipt_source") == F.col("source")),
        "receipt_hash_mismatch": held & ~hash_ok,
        "receipt_response_mismatch": held & hash_ok & ~receipt_covers_bar(F.col("payload")),
        "receipt_timestamp_mismatch": held & timed & (F.col("observed_at") != F.col("retrieved_at")),
        "invalid_availability_timestamp": held & ~timed,
    } | {x: held & (F.col("retrieved_at").isNotNull() if unobserved_end else timed) & (F.col("late") == x) for x in ("availability_precedes_finalization", "unknown_next_session", "post_hoc_availability")}
    parts = [failures(joined, checks, cell()), panel_missing(panel, chosen).select(F.lit("missing_panel_rows").alias("blocker"), cell().alias("sample"))]
    empty = chosen.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no_selected_rows").alias("blocker"), F.lit("panel").alias("sample"))
    return reduce(DataFrame.unionByName, [*parts, empty])


def refresh_failures(path: str, bars: DataFrame, receipts: DataFrame, panel: DataFrame, touched: DataFrame | None = None) -> None:
    """Brings the table of failures at path, partitioned by day, up to date after bars, receipts or cells of some days (touched: date) have
    changed: those days and the session before each, whose evidence ends with it, are judged anew, and only their parts are replaced.
    Without touched, every day is. A day without failures keeps a row without a blocker."""
    sessions = written(panel_select(bars, panel).select("date").distinct(), "sessions")
    days = panel.select("date").distinct()
    if touched is not None:
        asked = touched.select(F.col("date").alias("day")).distinct()
        before = asked.join(F.broadcast(sessions), F.col("date") < F.col("day")).groupBy("day").agg(F.max("date").alias("date")).select("date")  # dates of a calendar
        days = written(asked.select(F.col("day").alias("date")).unionByName(before).distinct(), "days")
        panel, bars = panel.join(days, "date", "left_semi"), bars.join(days, "date", "left_semi")
    found = price_failures(bars, receipts, panel, sessions).where("blocker <> 'no_selected_rows'").withColumn("date", F.element_at(F.split("sample", "@"), -1).try_cast("date"))
    none = days.select(F.lit(None).cast("string").alias("blocker"), F.lit(None).cast("string").alias("sample"), "date")
    found.unionByName(none).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def kept_readiness(failures: DataFrame) -> DataFrame:
    """price_readiness from a table that refresh_failures keeps."""
    return blockers(failures.where("blocker is not null").select("blocker", "sample"))


def price_readiness(bars: DataFrame, receipts: DataFrame, panel: DataFrame, unobserved_end: bool = False) -> DataFrame:
    """No row: ready."""
    return blockers(price_failures(bars, receipts, panel, unobserved_end=unobserved_end))


def priced_panel(bars: DataFrame, receipts: DataFrame, panel: DataFrame) -> DataFrame:
    """Cells whose bar is final and whose receipt agrees in source, digest, content and times, in time."""
    good = receipts.where((F.col("response_sha256") == F.sha2("payload", 256)) & (F.col("observed_at") == F.col("retrieved_at")))
    chosen = panel_select(bars.where("is_final"), panel)
    joined = chosen.join(good, ["receipt_id", "source"]).join(quality.next_session(chosen), "date")
    return joined.where(receipt_covers_bar(F.col("payload")) & clock.price_availability_error(F.col("date"), F.col("observed_at"), F.col("next_date")).isNull())


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().join(right, left.columns, "left_anti").select(F.lit("left").alias("side"), *left.columns).unionByName(right.distinct().join(left, left.columns, "left_anti").select(F.lit("right").alias("side"), *left.columns))


def spine_errors(dates: DataFrame, spine: DataFrame) -> DataFrame:
    """Dates of the spine that do not occur exactly once."""
    counted = dates.groupBy("date").agg(F.count("*").alias("times"))
    return spine.select("date").join(counted, "date", "left").na.fill(0, ["times"]).where("times <> 1")


def set_operations(left: DataFrame, right: DataFrame) -> DataFrame:
    parts = (("common", left.intersect(right)), ("only_left", left.subtract(right)), ("only_right", right.subtract(left)))
    return reduce(DataFrame.unionByName, [x.select(F.lit(name).alias("side"), *x.columns) for name, x in parts])
