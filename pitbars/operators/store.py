"""Bars at rest: producing, upserting, covering, reading. Everything takes and returns DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitbars.functions.symbols import ADJUSTMENT_VERSIONS, normalize_symbol

IDENTITY = ["source", "adjustment_mode", "adjustment_version"]
KEY = ["code", "date", *IDENTITY]


def bars_from_ticks(ticks: DataFrame) -> DataFrame:
    """Daily bars of (event_id, value, source, local_ts, date, code), one shuffle with partial aggregates."""
    at = F.struct("local_ts", "event_id")
    out = ticks.groupBy("code", "date", "source").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), (F.count("*") * 100).alias("volume"), F.min("event_id").alias("receipt_id"))
    return out.select("code", "date", "source", F.lit("raw").alias("adjustment_mode"), F.concat("source", F.lit("-v1")).alias("adjustment_version"), "open", "high", "low", "close", "volume", "receipt_id")


def scan_bars(bars: DataFrame, start: str, end: str, identity: tuple[str, str, str] | None = None, code: str | None = None, finalized_only: bool = False) -> DataFrame:
    """Inclusive range by date; an identity filters all three parts. Without one, rows of several identities are an error."""
    out = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if identity:
        for column, value in zip(IDENTITY, identity, strict=True):
            out = out.where(F.col(column) == value)
    if code:
        out = out.where(F.col("code") == code)
    if not identity:
        require_one_identity(out)
    return (out.where("is_final") if finalized_only else out).orderBy("code", "date")


def require_one_identity(bars: DataFrame) -> None:
    found = bars.select(*IDENTITY).distinct().limit(6).collect()
    if len(found) > 1:
        raise ValueError(f"ambiguous price identity: {[tuple(r) for r in found[:5]]}")


def last_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last in the given order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(c.desc() for c in order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert_bars(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch replace those of equal key; others stay. Of equal keys within the batch the highest receipt stays. What exists is
    held against the batch's keys, not sorted."""
    new = last_by(batch, KEY, [F.col("receipt_id")])
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}")) for c in KEY]
    stay = existing.alias("e").join(new.select(*KEY).alias("n"), reduce(lambda x, y: x & y, same), "left_anti")
    return stay.unionByName(new)


#: Columns of the stored layout beside those of bars: a part of the table is an identity, a year and a bucket of codes.
LAYOUT, CODE_BUCKETS = ["year", "bucket"], 16


def keyed(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"year": F.year("date"), "bucket": F.pmod(F.crc32("code"), F.lit(CODE_BUCKETS)).cast("int")})


def part_name() -> Column:
    """The part of the table that a keyed row lies in."""
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*IDENTITY, *LAYOUT)))


def write_bars(bars: DataFrame, path: str) -> None:
    """Only the parts (identity, year, bucket of codes) that occur in `bars` are replaced. Parts are cut by size, not one task each; rows of a
    file are sorted by code, so its row groups can be skipped."""
    out = keyed(bars).hint("rebalance", *IDENTITY, *LAYOUT).sortWithinPartitions(*IDENTITY, *LAYOUT, "code", "date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*IDENTITY, *LAYOUT).parquet(path)


def stamp_batch(batch: DataFrame, source: str, mode: str, version: str | None = None, retrieved_at: str = "") -> DataFrame:
    """The batch under one price identity (by default the mode's own version): what it says of itself must agree, or it is an error;
    a blank retrieved_at is filled."""
    version = version or ADJUSTMENT_VERSIONS.get(mode)
    if not version:
        raise ValueError(f"no default version of mode {mode}")
    for column, value in zip(IDENTITY, (source, mode, version), strict=True):
        own = F.col(column) if column in batch.columns else F.lit(None).cast("string")
        batch = batch.withColumn(column, F.when(F.coalesce(own, F.lit(value)) == value, value).otherwise(F.raise_error(F.concat(F.lit(f"{column} conflicts with {value}: "), own))))
    own = F.nullif(F.col("retrieved_at").cast("string"), F.lit("")) if "retrieved_at" in batch.columns else F.lit(None).cast("string")
    return batch.withColumn("retrieved_at", F.coalesce(own, F.lit(retrieved_at)))


#: The keys of a receipt.
RECEIPT_KEYS = ["observed_at", "request", "response", "source"]


def land_receipts(raw: DataFrame, source: str) -> DataFrame:
    """(receipt_id, json) to receipts: exactly the four keys and the batch's source, or it is an error."""
    r = raw.withColumn("r", F.from_json("json", "observed_at string, request string, response string, source string"))
    keys = F.coalesce(F.array_sort(F.json_object_keys("json")) == F.array(*map(F.lit, RECEIPT_KEYS)), F.lit(False))
    ok = F.when(keys & F.coalesce(F.col("r.source") == source, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("not a receipt of the batch: "), F.col("receipt_id").cast("string"))))
    return r.where(ok).select("receipt_id", "r.source", F.col("r.request").alias("request"), F.col("r.response").alias("payload"), "r.observed_at", F.sha2("r.response", 256).alias("response_sha256"))


def append_receipts(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Receipts of the batch that are new by digest and id, stamped with the digest of their payload; old ones are never changed."""
    new = batch.withColumn("response_sha256", F.sha2("payload", 256))
    return existing.unionByName(new.join(existing.select("receipt_id"), "receipt_id", "left_anti"))


def merge_sync_coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("code", *IDENTITY).agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))


def to_columnar(bars: DataFrame) -> DataFrame:
    """Parallel arrays by date, one row for each code; no bars, no row."""
    rows = F.array_sort(F.collect_list(F.struct("date", "open", "high", "low", "close", "volume")))
    pick = lambda name: F.transform("r", lambda x: x[name])
    return bars.groupBy("code").agg(rows.alias("r")).select("code", pick("date").alias("time"), *(pick(c).alias(c) for c in ("open", "high", "low", "close", "volume")))


def finalized_view(bars: DataFrame, latest: Column) -> DataFrame:
    """Both the cap and the flag must agree."""
    return bars.where((F.col("date") <= latest) & F.col("is_final"))


def snapshot_rows(bars: DataFrame, as_of: str, mode: str, codes: DataFrame | None = None, source: str | None = None) -> DataFrame:
    out = bars.where((F.col("date") <= F.lit(as_of).cast("date")) & F.col("is_final") & (F.col("adjustment_mode") == mode))
    out = out.where(F.col("source") == source) if source else out
    return (out.join(codes, "code", "left_semi") if codes is not None else out).orderBy("code", "date")


def covered_range(bars: DataFrame, finalized_only: bool = False) -> DataFrame:
    rows = bars.where("is_final") if finalized_only else bars
    return rows.groupBy("code", *IDENTITY).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def identity_coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*IDENTITY).agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("is_final"), 1)).alias("n_final"), F.count("receipt_id").alias("n_linked"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def table_counts(bars: DataFrame, receipts: DataFrame) -> DataFrame:
    linked = bars.join(receipts.select("receipt_id", F.lit(True).alias("linked")), "receipt_id", "left")
    return linked.agg(F.count("*").alias("total"), F.count(F.when(F.col("is_final"), 1)).alias("finalized"), F.count("linked").alias("linked"), (F.count("*") - F.count("linked")).alias("missing_receipt"))


def ambiguous_codes(bars: DataFrame) -> DataFrame:
    return bars.select("code", *IDENTITY).distinct().groupBy("code").agg(F.count("*").alias("identities")).where("identities > 1")


def missing_gaps(covered: DataFrame, start: str, end: str) -> DataFrame:
    """(code, gap_start, gap_end) of what lies left and right of what is covered; holes inside are no gaps. Nothing covered: all of it."""
    a, b, lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date"), F.col("start_date"), F.col("end_date")
    left = F.struct(a.alias("gap_start"), F.least(F.date_sub(lo, 1), b).alias("gap_end"))
    right = F.struct(F.greatest(F.date_add(hi, 1), a).alias("gap_start"), b.alias("gap_end"))
    gaps = F.when(lo.isNull(), F.array(F.struct(a.alias("gap_start"), b.alias("gap_end")))).otherwise(F.array(left, right))
    return covered.select("code", F.explode(F.filter(gaps, lambda g: g["gap_start"] <= g["gap_end"])).alias("g")).select("code", "g.*")


def overlay_today(bars: DataFrame, quote_bars: DataFrame, start: str | None = None, end: str | None = None, today: str | None = None) -> DataFrame:
    """Quote bars replace bars of the same code and date, or are added; they are never final. With a range, only quotes within it count,
    and none where the range ends before today."""
    if start and end:
        quote_bars = quote_bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.lit(not today or end >= today))
    return bars.join(quote_bars, ["code", "date"], "left_anti").unionByName(quote_bars.withColumn("is_final", F.lit(False)))


def get_history(bars: DataFrame, quote_bars: DataFrame, codes: DataFrame, start: str, end: str, today: str, latest: Column, finalized_only: bool = False) -> DataFrame:
    """Bars of one identity for the codes (raw spellings, column raw) within the range, today's quotes laid over them."""
    wanted = codes.select(normalize_symbol(F.col("raw")).alias("code")).where("code is not null").distinct()
    rows = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(wanted, "code", "left_semi")
    return finalized_view(rows, latest) if finalized_only else overlay_today(rows, quote_bars.join(wanted, "code", "left_semi"), start, end, today)


def plan_sync(requested: DataFrame, recorded: DataFrame, covered: DataFrame, start: str, end: str) -> DataFrame:
    """Gaps of each requested code by its recorded coverage, else by its final rows; a code without gaps is up to date."""
    known = requested.join(recorded.select("code", F.col("start_date").alias("s1"), F.col("end_date").alias("e1")), "code", "left").join(covered.select("code", F.col("start_date").alias("s2"), F.col("end_date").alias("e2")), "code", "left")
    known = known.select("code", F.coalesce("s1", "s2").alias("start_date"), F.coalesce("e1", "e2").alias("end_date"))
    gaps = missing_gaps(known, start, end)
    return known.select("code").join(gaps, "code", "left").withColumn("status", F.when(F.col("gap_start").isNull(), "up_to_date").otherwise("gap"))


def apply_sync(gaps: DataFrame, fetched: DataFrame, start: str, end: str, latest: str, identity: tuple[str, str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a fetch makes of planned gaps (code, gap_start, gap_end): results (code, status, written), bars to upsert, coverage to merge.

    fetched: bars with seq (order of arrival), source, adjustment_mode, adjustment_version (null: not said), is_final (null: final). Bars
    outside a gap are left out; of one date the last stays. An unfinished bar, another identity, or a row of column `failed` makes its code
    an error; the others go on. Coverage ends a day early where the range ends on the latest final date and that bar is absent."""
    inside = fetched.join(gaps, "code").where(F.col("date").between(F.col("gap_start"), F.col("gap_end"))).drop("gap_start", "gap_end")
    named = [~F.coalesce(F.col(c) == x, F.lit(True)) for c, x in zip(IDENTITY, identity, strict=True)]
    wrong = (F.col("is_final") == F.lit(False)) | named[0] | named[1] | named[2]
    failed = inside.where(F.coalesce(wrong, F.lit(False))).select("code")
    if "failed" in fetched.columns:
        failed = failed.unionByName(fetched.where("failed").select("code"))
    failed = failed.distinct().withColumn("failed", F.lit(True))
    good = last_by(inside.join(failed, "code", "left_anti"), ["code", "date"], [F.col("seq")])
    bars = good.drop("seq", "failed").withColumns(dict(zip(IDENTITY, map(F.lit, identity), strict=True))).withColumn("is_final", F.lit(True))
    counted = bars.groupBy("code").agg(F.count("*").alias("written"), F.max("date").alias("last"))
    asked = gaps.select("code").distinct().join(failed, "code", "left").join(counted, "code", "left").na.fill(0, ["written"])
    status = F.when(F.col("failed").isNotNull(), "error").when(F.col("written") > 0, "synced").otherwise("no_data")
    results = asked.select("code", status.alias("status"), "written")
    until = F.lit(end).cast("date")
    absent = F.lit(end == latest) & ~F.coalesce(F.col("last") == until, F.lit(False))
    coverage = asked.where("failed is null").select("code", *(F.lit(x).alias(c) for c, x in zip(IDENTITY, identity, strict=True)), F.lit(start).cast("date").alias("start_date"), F.when(absent, F.date_sub(until, 1)).otherwise(until).alias("end_date"))
    return results, bars, coverage.where("start_date <= end_date")
