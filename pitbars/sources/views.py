"""Bars, receipts, sessions, panels and quotes derived from the event table: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.functions import clock
from pitbars.operators import store

IDENTITY = ["source", "adjustment_mode", "adjustment_version"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark, sf_dir) -> DataFrame:
    user = F.col("user_id")
    head = F.when(user % 3 == 0, "6").when(user % 3 == 1, "0").otherwise("3")
    local = clock.to_local(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").alias("source"), local.alias("local_ts"), local.cast("date").alias("date"), F.concat(head, F.lpad(user.cast("string"), 5, "0"), F.when(user % 3 == 0, ".SH").otherwise(".SZ")).alias("code"))


def bars(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir)
    last = t.agg(F.max("date").alias("last_date"))
    return store.bars_from_ticks(t).crossJoin(last).withColumn("is_final", F.col("date") < F.col("last_date")).drop("last_date")


def receipts(spark, sf_dir, held: DataFrame | None = None) -> DataFrame:
    """Receipts of the bars; held: the bars, where they are written already."""
    r = F.col("receipt_id")
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    off = lambda n: F.when(r % n == 0, 1).otherwise(0)
    row = F.concat_ws('","', F.col("date").cast("string"), money(F.col("open") + off(23)), money(F.col("high")), money(F.col("low")), money(F.col("close") + off(19)), F.col("volume").cast("string"))
    base = (held or bars(spark, sf_dir)).where(r % 7 != 0).select(
        "receipt_id",
        F.when(r % 43 == 0, F.lit(None)).when(r % 13 == 0, "other").otherwise(F.col("source")).alias("source"),
        (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(14), mins=((r % 48) * 30).cast("int"))).alias("observed_at"),
        F.when(r % 29 != 0, F.concat(F.lit('{"fields":"date,open,high,low,close,volume","rows":[["'), row, F.lit('"]]}'))).alias("payload"),
    )
    shifted = F.col("observed_at") - F.make_dt_interval(mins=F.when(r % 17 == 0, 10).otherwise(0))
    digest = F.when(r % 37 == 0, F.lit(None)).when(r % 11 == 0, "bad").otherwise(F.sha2("payload", 256))
    return base.withColumns({"response_sha256": digest, "retrieved_at": F.when(r % 31 != 0, shifted)}).withColumn("observed_at", F.when(r % 41 != 0, F.col("observed_at")))


def sessions(spark, sf_dir) -> DataFrame:
    return ticks(spark, sf_dir).where(F.weekday("date") < 5).select("date").distinct()


def panel(spark, sf_dir, held: DataFrame | None = None) -> DataFrame:
    """All codes in all sessions; held: the bars, where they are written already (each tick is in one)."""
    rows = held or ticks(spark, sf_dir)
    return rows.select("code").distinct().crossJoin(rows.where(F.weekday("date") < 5).select("date").distinct())  # a panel is this product by definition


def calendar(spark, sf_dir) -> DataFrame:
    ends = ticks(spark, sf_dir).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("date")).withColumn("is_trading_day", F.weekday("date") < 5)


def quotes(spark, sf_dir) -> DataFrame:
    last = ticks(spark, sf_dir).groupBy("code").agg(F.max_by("value", F.struct("local_ts", "event_id")).alias("price"), F.max("date").alias("date"))
    return last.withColumn("price", F.col("price") * F.when(F.substring("code", 2, 5).cast("int") % 4 == 0, 1.02).otherwise(1.0))


def batch(spark, sf_dir) -> DataFrame:
    """The last ten days again with a shifted close, and the same days under a new identity."""
    b = bars(spark, sf_dir)
    recent = b.crossJoin(b.agg(F.max("date").alias("m"))).where(F.col("date") > F.date_sub("m", 10)).drop("m")
    shifted = recent.withColumn("close", F.col("close") + 0.5)
    return shifted.unionByName(shifted.where("source = 'click'").withColumn("adjustment_version", F.lit("click-v2")))


def coverage(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).where(F.substring("code", 2, 5).cast("int") % 3 != 0).groupBy("code", *IDENTITY).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def raw_codes(spark, sf_dir) -> DataFrame:
    n, d = F.col("p_partkey") % 4, F.lpad((F.col("p_partkey") % 700 * 997 % 1000000).cast("string"), 6, "0")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(n == 0, F.concat(d, F.lit(".sh"))).when(n == 1, F.concat(F.lit("sz"), d)).when(n == 2, d).otherwise(F.concat(F.lit(" "), d, F.lit(".SZ "))).alias("raw"))
