"""Agreement of sources and audits against a calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(closes: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """For each (code, date): median close, number of sources, outliers (sorted, comma-joined) and agreement. One shuffle."""
    grouped = closes.groupBy("code", "date").agg(F.median("close").alias("m"), F.collect_list(F.struct("source", "close")).alias("s"))
    out = F.array_sort(F.transform(F.filter("s", lambda x: (F.col("m") == 0) | (F.abs(x["close"] - F.col("m")) / F.abs(F.col("m")) > tolerance)), lambda x: x["source"]))
    return grouped.select("code", "date", F.round("m", 4).alias("consensus"), F.size("s").cast("long").alias("n_sources"), F.concat_ws(",", out).alias("outliers"), (F.size(out) == 0).alias("agreement"), F.col("m").alias("_median"))


def with_realtime(found: DataFrame, quotes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """realtime_match on the quote's date where the median is not zero, else null."""
    near = F.abs(F.col("price") - F.col("_median")) / F.abs(F.col("_median")) <= tolerance
    joined = found.join(quotes.select("code", "date", "price"), ["code", "date"], "left")
    return joined.withColumn("realtime_match", F.when(F.col("price").isNotNull() & (F.col("_median") != 0), near)).drop("price", "_median")


def ohlc_cross_check(bars: DataFrame, k: int = 8, tolerance: float = 0.005) -> DataFrame:
    """For each code over its last k dates common to all its sources: mismatching (date, field) cells and a verdict.

    Bars are dealt by code once; days, sources, the last common days and the verdict all follow from that."""
    fields = ["open", "high", "low", "close"]
    own = bars.select("code", "date", "source", *fields).repartition("code")
    days = own.groupBy("code", "date").agg(F.collect_set("source").alias("s"), *(F.sort_array(F.collect_list(f)).alias(f) for f in fields))
    code = Window.partitionBy("code")
    known = days.withColumn("n_sources", F.size(F.array_distinct(F.flatten(F.collect_set("s").over(code)))))
    common = F.size("s") == F.col("n_sources")
    ranked = known.withColumn("common", common).withColumn("r", F.row_number().over(code.orderBy(F.col("common").desc(), F.col("date").desc())))
    inside = F.col("common") & (F.col("r") <= k)

    def wide(v: str):
        upper = F.get(v, F.floor(F.size(v) / 2).cast("int"))
        return F.when((upper != 0) & ((F.array_max(v) - F.array_min(v)) / F.abs(upper) > tolerance), 1).otherwise(0)  # a median of zero is passed over

    out = ranked.groupBy("code").agg(F.max("n_sources").cast("long").alias("n_sources"), F.count(F.when(inside, 1)).alias("days"), F.coalesce(F.sum(F.when(inside, reduce(lambda a, b: a + b, map(wide, fields)))), F.lit(0)).alias("mismatches"))
    return out.withColumn("verdict", F.when(F.col("n_sources") < 2, "SKIP").when(F.col("mismatches") == 0, "PASS").otherwise(F.concat(F.lit("FAIL("), F.col("mismatches").cast("string"), F.lit(")"))))


def deviation_profile(left: DataFrame, right: DataFrame, limit: float = 0.02) -> DataFrame:
    """Relative deviation, without its sign, of right closes from left closes over common dates: mean, largest, population deviation."""
    both = left.select("code", "date", F.col("close").alias("a")).join(right.select("code", "date", F.col("close").alias("b")), ["code", "date"]).where("a <> 0")
    d = both.withColumn("d", F.abs(F.col("b") - F.col("a")) / F.abs("a"))
    return d.groupBy("code").agg(F.count("*").alias("days"), F.round(F.avg("d"), 4).alias("mean_dev"), F.round(F.max("d"), 4).alias("max_dev"), F.round(F.stddev_pop("d"), 4).alias("std_dev"), (F.stddev_pop("d") < limit).alias("ok"))


def reconcile(left: DataFrame, right: DataFrame, price: float = 1e-8, volume: float = 100) -> DataFrame:
    """Full outer by (code, date): side and the list of fields that differ by more than their tolerance."""
    fields = ["open", "high", "low", "close", "volume"]
    a = left.select("code", "date", *(F.col(f).alias(f"l_{f}") for f in fields), F.lit(1).alias("in_left"))
    b = right.select("code", "date", *(F.col(f).alias(f"r_{f}") for f in fields), F.lit(1).alias("in_right"))
    both = a.join(b, ["code", "date"], "full_outer")
    differ = F.array_compact(F.array(*(F.when(F.abs(F.col(f"l_{f}") - F.col(f"r_{f}")) > (volume if f == "volume" else price), f) for f in fields)))
    return both.select("code", "date", F.when(F.col("in_right").isNull(), "left_only").when(F.col("in_left").isNull(), "right_only").otherwise("both").alias("side"), differ.alias("fields"))


def reconcile_sources(left: DataFrame, right: DataFrame) -> DataFrame:
    r = reconcile(left, right)
    count = lambda c: F.count(F.when(c, 1))
    return r.groupBy("code").agg(count(F.col("side") == "both").alias("matched"), count(F.col("side") == "left_only").alias("left_only"), count(F.col("side") == "right_only").alias("right_only"), count(F.size("fields") > 0).alias("mismatched"))


def reconcile_fields(left: DataFrame, right: DataFrame) -> DataFrame:
    return reconcile(left, right).select("code", F.explode("fields").alias("field")).groupBy("code", "field").agg(F.count("*").alias("mismatches"))


def calendar_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """For each code: trading days missing between its first and last bar (holes), and after its last bar (lag)."""
    trading = calendar.where("is_trading_day").select(F.col("date").alias("day"))
    spans = bars.groupBy("code").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    due = spans.join(F.broadcast(trading), F.col("day") >= F.col("lo")).select("code", "hi", F.col("day").alias("date"))
    absent = due.join(bars.select("code", "date").distinct(), ["code", "date"], "left_anti")
    counted = absent.groupBy("code").agg(F.count(F.when(F.col("date") < F.col("hi"), 1)).alias("holes"), F.count(F.when(F.col("date") > F.col("hi"), 1)).alias("lag"))
    return spans.select("code").join(counted, "code", "left").na.fill(0).withColumn("complete", (F.col("holes") == 0) & (F.col("lag") == 0))


def next_session(dates: DataFrame) -> DataFrame:
    """Each distinct date and the one after it. A calendar has some 250 dates a year, so one ordered window holds them."""
    return dates.select("date").distinct().withColumn("next_date", F.lead("date").over(Window.orderBy("date")))


def daily_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("code", "source").orderBy("date"))
    return bars.withColumn("p", before).where("p is not null and p <> 0").select("code", "source", "date", F.round((F.col("close") / F.col("p") - 1) * 100, 3).alias("ret"))


def return_agreement(bars: DataFrame, left: str, right: str, k: int = 8, limit: float = 0.01) -> DataFrame:
    r = daily_returns(bars)
    both = r.where(F.col("source") == left).select("code", "date", F.col("ret").alias("a")).join(r.where(F.col("source") == right).select("code", "date", F.col("ret").alias("b")), ["code", "date"])
    last = both.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.col("date").desc()))).where(F.col("n") <= k)
    return last.groupBy("code").agg(F.count("*").alias("days"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 3).alias("max_diff")).withColumn("agree", F.col("max_diff") < limit)


def latest_n_per_source(bars: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("code", "source").orderBy(F.col("date").desc()))
    return bars.withColumn("rank", rank).where(F.col("rank") <= n).select("code", "source", F.col("rank").cast("long").alias("rank"), "date", F.round("close", 2).alias("close"))
