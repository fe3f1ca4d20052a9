"""Structured Streaming forms of bar building and upserting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitbars.functions import canonical, clock
from pitbars.operators import evidence, quality, store


def stream_bars(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily bars of a tick stream (event_id, ts in UTC, value, source, code), by market day. In append mode a day comes once it is final,
    in update mode as a provisional bar after each batch."""
    at = F.struct("ts", "event_id")
    grouped = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day", "1 day", "16 hours").alias("day"), "code", "source")
    out = grouped.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), (F.count("*") * 100).alias("volume"))
    day = (F.col("day.start") + F.make_dt_interval(hours=F.lit(8))).cast("date")
    return out.select("code", day.alias("date"), "source", F.lit("raw").alias("adjustment_mode"), F.concat("source", F.lit("-v1")).alias("adjustment_version"), "open", "high", "low", "close", "volume")


def stream_receipts(receipts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each payload once within the delay."""
    return receipts.withColumn("response_sha256", F.sha2("payload", 256)).withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["response_sha256"])


def _exists(spark, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def upsert_into(path: str):
    """A foreachBatch function: the batch replaces bars of equal key, in the parts of the table it touches. A ledger beside the table has the
    batches that were taken in; one that is there is not taken in again. Rows are staged under a name of their own for each run."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, ledger = batch.sparkSession, f"{path}__batches/batch={batch_id}"
        if _exists(spark, ledger):
            return
        batch = store.keyed(batch)
        batch.persist()
        try:
            parts = [r["p"] for r in batch.select(store.part_name().alias("p")).distinct().collect()]  # identities, years and buckets of the batch
            columns = [c for c in batch.columns if c not in store.LAYOUT]
            # only the folders of these parts are listed and read
            existing = spark.read.parquet(path).where(store.part_name().isin(parts)).select(columns) if _exists(spark, path) else batch.select(columns).limit(0)
            staged = f"{path}__staged/{uuid4().hex}"  # a path is never overwritten by a plan that reads it
            store.upsert_bars(existing, batch.select(columns)).write.parquet(staged)
            store.write_bars(spark.read.parquet(staged), path)
            spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("overwrite").parquet(ledger)
            folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        finally:
            batch.unpersist()

    return apply


def bind_cohort(spark, path: str, codes: list[str], start: str, identity: tuple[str, str, str]) -> str:
    """Writes what a capture is bound to (codes, start, price identity) beside its table, once; binding anything else later is an error.
    Returns its digest, the SHA-256 of its canonical JSON."""
    spec = {"symbols": sorted(set(codes)), "start": start} | dict(zip(store.IDENTITY, identity, strict=True))
    row = spark.createDataFrame([tuple(spec.values())], "symbols array<string>, start string, " + ", ".join(f"{c} string" for c in store.IDENTITY))
    digest = row.select(F.sha2(canonical.encode(F.struct(*row.columns), row.schema), 256)).first()[0]
    bound = f"{path}__cohort"
    if _exists(spark, bound):
        if spark.read.parquet(bound).first()["cohort_sha256"] != digest:
            raise ValueError("the capture is bound to another cohort")
    else:
        row.withColumn("cohort_sha256", F.lit(digest)).coalesce(1).write.parquet(bound)
    return digest


def outside(bars: DataFrame, cohort: DataFrame, start: str, identity: tuple[str, str, str]) -> DataFrame:
    """(code, date, problem) of bars that are not of the cohort (column code), before its start, or of another price identity."""
    other = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(store.IDENTITY, identity, strict=True)))
    known = bars.join(cohort.select("code", F.lit(True).alias("known")).distinct(), "code", "left")
    problem = F.when(F.col("known").isNull(), "outside the cohort").when(F.col("date") < F.lit(start).cast("date"), "before the start").when(other, "another price identity")
    return known.select("code", "date", problem.alias("problem")).where("problem is not null")


def cohort_guard(cohort: DataFrame, start: str, identity: tuple[str, str, str]):
    """A foreachBatch function that fails on bars of the batch that are not of the bound cohort, its time or its price identity."""

    def check(batch: DataFrame, batch_id: int) -> None:
        found = [tuple(r) for r in outside(batch, cohort, start, identity).limit(5).collect()]
        if found:
            raise ValueError(f"not to be captured: {found}")

    return check


PHASE = "date date, phase string, source string, observed_at timestamp, receipt_id long"


def capture_phases(captures: DataFrame, delay: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a stream of captures (date, source, observed_at, receipt_id).

    records: one for each date, phase and source, the first; later ones, replays and late duplicates are no-ops. What has been recorded is
    kept as state under its key until the watermark passes its day, so a batch costs what it holds, however long the table is. Of one batch
    the earliest counts. rejects: captures outside both windows, or not on their own day."""
    own = captures.withColumn("phase", F.when(F.col("observed_at").cast("date") == F.col("date"), clock.observation_phase(F.col("observed_at"))))

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["observed_at", "receipt_id"])
        if state.exists or rows.empty:
            return
        row = rows.iloc[:1]
        state.update((int(row["receipt_id"].iloc[0]),))
        until = pd.Timestamp(key[0]) + pd.Timedelta(days=1) + pd.Timedelta(delay)
        state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield row[["date", "phase", "source", "observed_at", "receipt_id"]]

    timed = own.where("phase is not null").select("date", "phase", "source", F.col("observed_at").cast("timestamp").alias("observed_at"), F.col("receipt_id").cast("long").alias("receipt_id"))
    records = timed.withWatermark("observed_at", delay).groupBy("date", "phase", "source").applyInPandasWithState(first, PHASE, "receipt_id long", "append", GroupStateTimeout.EventTimeTimeout)
    return records, own.where("phase is null").drop("phase")


def classify_late(receipts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Receipts (date, observed_at, ...) of a stream with `error`: null where the evidence was there in time. sessions: a static calendar."""
    following = quality.next_session(sessions)
    return receipts.join(following, "date", "left").withColumn("error", clock.price_availability_error(F.col("date"), F.col("observed_at"), F.col("next_date"))).drop("next_date")


def bars_with_evidence(bars: DataFrame, receipts: DataFrame, sessions: DataFrame, wait: str = "5 days", delay: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(judged, late) of two streams: bars (receipt_id, code, date, ...) and receipts (receipt_id, date, observed_at).

    judged: each bar with its receipt's observed_at and `error`: null where that was in time, no_receipt where none came within `wait` of
    the bar's day; a bar is judged when its receipt meets it, or when the watermarks of both streams have passed that time. late: receipts
    taken outside the time in which their bar waits, for a side table of their own. Both sides' state ends with the watermarks."""
    days = bars.withColumn("day", F.col("date").cast("timestamp")).withWatermark("day", delay)
    seen = receipts.select(F.col("receipt_id").alias("of"), F.col("observed_at").cast("timestamp").alias("observed_at")).withWatermark("observed_at", delay)
    inside = F.expr(f"receipt_id = of AND observed_at >= day - INTERVAL 1 DAY AND observed_at <= day + INTERVAL {wait}")
    joined = days.join(seen, inside, "left_outer").join(quality.next_session(sessions), "date", "left")
    error = F.when(F.col("observed_at").isNull(), "no_receipt").otherwise(clock.price_availability_error(F.col("date"), F.col("observed_at").cast("timestamp_ntz"), F.col("next_date")))
    judged = joined.withColumn("error", error).drop("day", "of", "next_date")
    at, day = F.col("observed_at").cast("timestamp"), F.col("date").cast("timestamp")
    return judged, receipts.where((at > day + F.expr(f"INTERVAL {wait}")) | (at < day - F.expr("INTERVAL 1 DAY")))


def forward_capture(bars: DataFrame, path: str, checkpoint: str, cohort: DataFrame, receipts: DataFrame, start: str, identity: tuple[str, str, str]) -> DataFrame:
    """Takes all available bars of a stream into the table at path, then says what keeps the cohort's captured days from being ready.

    The capture is bound to its cohort (column code, a bounded list), start and price identity: another binding, or a table that already
    holds something else, is refused before the stream starts, and a batch that does fails it. Prices must be raw."""
    spark = bars.sparkSession
    if identity[1] != "raw":
        raise ValueError("a forward capture takes raw prices")
    bind_cohort(spark, path, [r["code"] for r in cohort.select("code").distinct().collect()], start, identity)
    guard, upsert = cohort_guard(cohort, start, identity), upsert_into(path)
    if _exists(spark, path):
        guard(spark.read.parquet(path), -1)

    def apply(batch: DataFrame, batch_id: int) -> None:
        guard(batch, batch_id)
        upsert(batch, batch_id)

    bars.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    held = spark.read.parquet(path)
    panel = cohort.select("code").distinct().crossJoin(held.select("date").distinct())
    return evidence.price_readiness(held.drop(*store.LAYOUT), receipts, panel)
