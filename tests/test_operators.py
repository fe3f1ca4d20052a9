import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from pitbars.functions import clock, symbols
from pitbars.operators import evidence, quality, store

IDENTITY = ("s", "raw", "v1")
BAR = "code string, date date, source string, adjustment_mode string, adjustment_version string, open double, high double, low double, close double, volume long, receipt_id long, is_final boolean"


def bar(code, day, close, receipt=1, final=True, source="s"):
    return (code, dt.date(2024, 1, day), source, "raw", "v1", close, close, close, close, 100, receipt, final)


@pytest.mark.parametrize(("raw", "code"), [("sh600519", "600519.SH"), (" 600519 ", "600519.SH"), ("600519.sh", "600519.SH"), ("000300.SH", "000300.SH"), ("510050", "510050.SH"), ("159941", "159941.SZ"), ("430047", None), ("", None), ("abc", None), (None, None)])
def test_normalize_symbol(spark, raw, code):
    df = spark.createDataFrame([(raw,)], "raw string").select(symbols.normalize_symbol(F.col("raw")).alias("code"))
    assert df.first()["code"] == code


@pytest.mark.parametrize(("available", "following", "error"), [("2020-01-03 15:06", "2020-01-06", None), ("2020-01-06 09:24:59", "2020-01-06", None), ("2020-01-06 09:25", "2020-01-06", "post_hoc_availability"), ("2020-01-03 14:59:59", "2020-01-06", "availability_precedes_finalization"), ("2020-01-06 09:00", None, "unknown_next_session")])
def test_price_availability(spark, available, following, error):
    df = spark.createDataFrame([("2020-01-03", available, following)], "d string, a string, n string")
    got = df.select(clock.price_availability_error(F.to_date("d"), F.col("a").cast("timestamp_ntz"), F.to_date("n")).alias("e")).first()["e"]
    assert got == error


def test_consensus_outlier(spark):
    rows = [("A", dt.date(2024, 1, 2), x, c) for x, c in (("p", 1199.3), ("q", 1199.3), ("r", 1199.3), ("t", 1250.0))]
    got = quality.consensus(spark.createDataFrame(rows, "code string, date date, source string, close double")).first()
    assert (got["consensus"], got["outliers"], got["agreement"]) == (1199.3, "t", False)


def test_upsert_replaces_and_replays(spark):
    old, new = spark.createDataFrame([bar("A", 2, 1.0), bar("B", 2, 2.0)], BAR), spark.createDataFrame([bar("A", 2, 9.0, 5)], BAR)
    once = store.upsert_bars(old, new)
    assert sorted(r["close"] for r in once.collect()) == [2.0, 9.0]
    assert sorted(map(tuple, store.upsert_bars(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_gaps_ignore_interior_holes(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 3), dt.date(2024, 1, 5)), ("B", None, None)], "code string, start_date date, end_date date")
    got = sorted((r["code"], r["gap_start"].day, r["gap_end"].day) for r in store.missing_gaps(df, "2024-01-02", "2024-01-06").collect())
    assert got == [("A", 2, 2), ("A", 6, 6), ("B", 2, 6)]


def test_write_bars_replaces_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_bars(spark.createDataFrame([bar("A", 2, 1.0), bar("A", 2, 1.5, source="t")], BAR), path)
    store.write_bars(spark.createDataFrame([bar("A", 2, 3.0)], BAR), path)
    assert sorted(r["close"] for r in spark.read.parquet(path).collect()) == [1.5, 3.0]


RECEIPT = "receipt_id long, source string, payload string, response_sha256 string, observed_at timestamp_ntz, retrieved_at timestamp_ntz"


PRICES = '{"fields":"date,open,high,low,close,volume","rows":[["2024-01-02",%s]]}'


@pytest.mark.parametrize(("change", "blocker"), [({}, None), ({"payload": None}, "missing_receipts"), ({"source": None}, "receipt_source_mismatch"), ({"response_sha256": None}, "receipt_hash_mismatch"), ({"observed_at": None}, "invalid_availability_timestamp"), ({"retrieved_at": None}, "invalid_availability_timestamp"),
    *(({"payload": PRICES % ",".join(f'"{7 if k == at else 100 if k == 4 else 1}"' for k in range(5))}, "receipt_response_mismatch") for at in range(5)), ({"payload": "junk"}, "receipt_response_mismatch"),  ({"source": "other"}, "receipt_source_mismatch"), ({"response_sha256": "bad"}, "receipt_hash_mismatch"), ({"retrieved_at": dt.datetime(2024, 1, 2, 15, 9)}, "receipt_timestamp_mismatch"), ({"observed_at": dt.datetime(2024, 1, 2, 14, 0), "retrieved_at": dt.datetime(2024, 1, 2, 14, 0)}, "availability_precedes_finalization"), ({"receipt_id": 9}, "missing_receipts")])
def test_one_mutation_one_blocker(spark, change, blocker):
    import hashlib

    payload = '{"fields":"date,close,open,high,low,volume","rows":[["2024-01-01","1","1","1","1","100"],["2024-01-02","1.00","1","1","1","100"]]}'
    at = dt.datetime(2024, 1, 2, 15, 10)
    row = {"receipt_id": 1, "source": "s", "payload": payload, "response_sha256": hashlib.sha256(payload.encode()).hexdigest(), "observed_at": at, "retrieved_at": at} | change
    if "payload" in change and "response_sha256" not in change:
        row["response_sha256"] = hashlib.sha256((row["payload"] or "").encode()).hexdigest()
    panel = spark.createDataFrame([("A", dt.date(2024, 1, 2))], "code string, date date")
    got = [r["blocker"] for r in evidence.price_readiness(spark.createDataFrame([bar("A", 2, 1.0)], BAR), spark.createDataFrame([tuple(row.values())], RECEIPT), panel).collect()]
    assert got == ([blocker] if blocker else [])


def test_unobserved_receipts_of_the_last_session(spark):
    days = [dt.date(2024, 1, k) for k in (2, 3)]
    payload = lambda d: '{"fields":"date,open,high,low,close,volume","rows":[["%s","1","1","1","1","100"]]}' % d
    bars = spark.createDataFrame([bar("A", d.day, 1.0, d.day) for d in days], BAR)
    receipts = spark.createDataFrame([(d.day, "s", payload(d), hashlib.sha256(payload(d).encode()).hexdigest(), None, dt.datetime(2024, 1, d.day, 16)) for d in days], RECEIPT)
    panel = spark.createDataFrame([("A", d) for d in days], "code string, date date")
    got = {r["blocker"]: r["examples"] for r in evidence.price_readiness(bars, receipts, panel, unobserved_end=True).collect()}
    assert got == {"invalid_availability_timestamp": "A@2024-01-02,A@2024-01-03", "unknown_next_session": "A@2024-01-03"}


def test_empty_panel_selection_is_a_blocker(spark):
    panel = spark.createDataFrame([("Z", dt.date(2024, 1, 2))], "code string, date date")
    got = {r["blocker"]: r["count"] for r in evidence.price_readiness(spark.createDataFrame([bar("A", 2, 1.0)], BAR), spark.createDataFrame([], RECEIPT), panel).collect()}
    assert got == {"no_selected_rows": 1, "missing_panel_rows": 1}


def test_kept_failures_equal_a_full_run(spark, tmp_path):
    path, day = str(tmp_path / "failures"), lambda k: dt.date(2024, 1, k)
    at = lambda k, h: dt.datetime(2024, 1, k, h)

    def tables(late=(), gone=(), unlinked=()):
        rows = [(c, k) for c in "AB" for k in (2, 3, 4, 5, 8) if k not in gone]
        bars = [(*bar(c, k, 1.0)[:-2], None if (c, k) in unlinked else 10 * k + (c == "B"), True) for c, k in rows]
        payload = lambda k: '{"fields":"date,open,high,low,close,volume","rows":[["2024-01-%02d","1","1","1","1","100"]]}' % k
        receipts = [(10 * k + (c == "B"), "s", payload(k), hashlib.sha256(payload(k).encode()).hexdigest(), *[at(k + 1, 8) if (c, k) in late else at(k, 16)] * 2) for c, k in rows]
        panel = [(c, day(k)) for c in "AB" for k in (2, 3, 4, 5, 8)]
        return spark.createDataFrame(bars, BAR), spark.createDataFrame(receipts, RECEIPT), spark.createDataFrame(panel, "code string, date date")

    def kept():
        return sorted(map(tuple, evidence.kept_readiness(spark.read.parquet(path)).collect()))

    before = tables(late={("A", 3), ("B", 5)})
    evidence.refresh_failures(path, *before)
    assert kept() == sorted(map(tuple, evidence.price_readiness(*before).collect()))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "failures").rglob("*.parquet")}
    after = tables(late={("A", 3), ("B", 5)}, gone={4}, unlinked={("B", 8)})  # day 4 goes, so day 3 waits for day 5; day 8 loses a link
    evidence.refresh_failures(path, *after, spark.createDataFrame([(day(4),), (day(8),)], "date date"))
    assert kept() == sorted(map(tuple, evidence.price_readiness(*after).collect())) and kept()
    left = {f.parent.name for f, t in files.items() if f.exists() and f.stat().st_mtime_ns == t}
    assert left == {"date=2024-01-02"}  # 3 and 5 are the sessions before 4 and 8


def test_bars_without_receipts_are_dealt_out(spark):
    rows = [(f"{k:06d}", dt.date(2024, 1, 2), "s", "raw", "v1", 1.0, 1.0, 1.0, 1.0, 100, None if k % 2 else k, True) for k in range(4000)]
    receipts = spark.createDataFrame([(k, "s", "x", "h", None, None) for k in range(0, 4000, 4)], RECEIPT)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = evidence.bars_with_receipts(spark.createDataFrame(rows, BAR), receipts)
        sizes = [n for n in joined.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]]
        assert sum(sizes) == 4000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
        assert joined.where("has_receipt").count() == 1000 and joined.columns[0] == "receipt_id"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
