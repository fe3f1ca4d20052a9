import datetime as dt
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pitbars.operators import store
from pitbars.sources import views
from pitbars.streaming import jobs

SF = "/root/testdata/sf0.001"
COLUMNS = ["code", "date", "source", "adjustment_mode", "adjustment_version", "open", "high", "low", "close", "volume"]


def test_stream_equals_batch_but_for_the_last_day(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.parquet(str(tmp_path / "in" / "e"))
    ticks = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "e")).select("event_id", "ts", "value", F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("code"))
    q = jobs.stream_bars(ticks).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("bars").select(*COLUMNS).collect()}
    batch = store.bars_from_ticks(views.ticks(spark, SF).drop("code").join(events.select("event_id", F.col("user_id").cast("string").alias("code")), "event_id"))
    last = views.ticks(spark, SF).agg(F.max("date")).first()[0]
    assert got == {tuple(r) for r in batch.where(F.col("date") < F.lit(last)).select(*COLUMNS).collect()}


KIND = "code string, date date, source string, adjustment_mode string, adjustment_version string, open double, high double, low double, close double, volume long, receipt_id long"
row = lambda c, x, day=2, source="s", year=2024: (c, dt.date(year, 1, day), source, "raw", "v1", x, x, x, x, 100, 1)


def test_upsert_batches_replay(spark, tmp_path):
    path = str(tmp_path / "bars")
    apply = jobs.upsert_into(path)
    batches = [spark.createDataFrame([row("A", 1.0), row("B", 1.0), row("A", 5.0, year=2023)], KIND), spark.createDataFrame([row("A", 2.0)], KIND), spark.createDataFrame([row("A", 3.0)], KIND)]
    state = lambda: sorted((r["code"], r["date"].year, r["close"]) for r in spark.read.parquet(path).collect())
    for k in (0, 1, 1):
        apply(batches[k], k)
    assert state() == [("A", 2023, 5.0), ("A", 2024, 2.0), ("B", 2024, 1.0)]
    apply(batches[2], 1)  # a batch that was taken in is not taken in again, whatever it now holds
    assert state() == [("A", 2023, 5.0), ("A", 2024, 2.0), ("B", 2024, 1.0)]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "bars").rglob("*.parquet")}
    apply(batches[2], 2)
    left = {f for f in before if f.exists() and f.stat().st_mtime_ns == before[f]}
    assert state()[1] == ("A", 2024, 3.0) and {f.parent.parent.name for f in left} == {"year=2023", "year=2024"}
    # unaffected parts are not read
    parts = [r["p"] for r in store.keyed(batches[2]).select(store.part_name().alias("p")).distinct().collect()]
    plan = spark.read.parquet(path).where(store.part_name().isin(parts))
    assert re.search(r"PartitionFilters: \[\(?concat_ws", plan._jdf.queryExecution().executedPlan().toString())


def test_upsert_against_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.choice("ABCDE"), dt.date(2024, 1, rng.randint(1, 3)), rng.choice(["s", None]), "raw", "v1", *[float(rng.randint(1, 9))] * 4, 100, k) for k in range(n)]
    existing, batch = {r[:5]: r for r in make(30)}, make(20)
    due = existing | {r[:5]: r for r in batch}
    got = store.upsert_bars(spark.createDataFrame(list(existing.values()), KIND), spark.createDataFrame(batch, KIND))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, due.values()))


def test_cohort_guard(spark, tmp_path):
    cohort = spark.createDataFrame([("A",), ("B",)], "code string")
    guard = jobs.cohort_guard(cohort, "2024-01-02", ("s", "raw", "v1"))
    guard(spark.createDataFrame([row("A", 1.0), row("B", 1.0, 3)], KIND), 0)
    for bad, what in ((row("C", 1.0), "outside"), (row("A", 1.0, 1), "before the start"), (row("A", 1.0, source="z"), "another price identity")):
        with pytest.raises(ValueError, match=what):
            guard(spark.createDataFrame([bad], KIND), 0)
    bind = lambda codes, start: jobs.bind_cohort(spark, str(tmp_path / "c"), codes, start, ("s", "raw", "v1"))
    spec = {"symbols": ["A", "B"], "start": "2024-01-02", "source": "s", "adjustment_mode": "raw", "adjustment_version": "v1"}
    assert bind(["B", "A"], "2024-01-02") == bind(["A", "B", "A"], "2024-01-02") == hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    with pytest.raises(ValueError, match="another cohort"):
        bind(["A"], "2024-01-02")


def run(spark, df, name, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()


def test_captured_phases(spark, tmp_path):
    day, at = dt.date(2024, 1, 2), lambda h, m=0, d=2: dt.datetime(2024, 1, d, h, m)
    kind = "date date, source string, observed_at timestamp_ntz, receipt_id long"
    batches = [[(day, "m", at(9, 5), 1), (day, "m", at(9), 2), (day, "m", at(12), 3)], [(day, "m", at(8, 40), 4), (day, "m", at(16), 5), (day, "m", at(16, d=3), 6)], [(day, "m", at(9, 10), 7), (dt.date(2024, 1, 5), "m", at(9, d=5), 8)], [(day, "m", at(9, 1), 9)]]
    folder = tmp_path / "in"
    out = tmp_path / "out"
    for k, rows in enumerate(batches):  # each batch is one run of the stream from its checkpoint
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(folder))
        records, rejects = jobs.capture_phases(spark.readStream.schema(kind).parquet(str(folder)))
        for df, name in ((records, "records"), (rejects, "rejects")):
            df.writeStream.format("parquet").option("path", str(out / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["date"].day, r["phase"], r["receipt_id"]) for r in spark.read.parquet(str(out / "records")).collect()) == [(2, "post_close", 5), (2, "pre_open", 2), (5, "pre_open", 8)]
    assert sorted(r["receipt_id"] for r in spark.read.parquet(str(out / "rejects")).collect()) == [3, 6]


def test_bars_with_evidence_equal_batch(spark, tmp_path):
    days = [dt.date(2024, 1, k) for k in (2, 3, 4)]
    bars = [(10 * d.day + k, c, d) for d in days for k, c in enumerate("ABC")] + [(1, "Z", dt.date(2024, 2, 20))]
    stamps = [dt.timedelta(hours=h) for h in (15.5, 14, 33, 57, 200)]
    receipts = [(i, d, dt.datetime.combine(d, dt.time()) + stamps[(i // 10 + i) % 5]) for i, _, d in bars if i % 11 and i > 1] + [(2, dt.date(2024, 3, 1), dt.datetime(2024, 3, 1, 16))]
    spark.createDataFrame(bars, "receipt_id long, code string, date date").coalesce(1).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame(receipts, "receipt_id long, date date, observed_at timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "r"))
    sessions = spark.createDataFrame([(d,) for d in days], "date date")
    stream = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    judged, late = jobs.bars_with_evidence(stream("b"), stream("r"), sessions)
    run(spark, judged, "judged", tmp_path)
    run(spark, late, "late", tmp_path)
    got = {r["receipt_id"]: r["error"] for r in spark.table("judged").collect() if r["code"] != "Z"}
    seen = {i: t for i, d, t in receipts if t <= dt.datetime.combine(d, dt.time()) + dt.timedelta(days=5)}
    static = spark.createDataFrame([(i, d, seen.get(i)) for i, _, d in bars if i > 1], "receipt_id long, date date, observed_at timestamp_ntz")
    due = {r["receipt_id"]: "no_receipt" if r["observed_at"] is None else r["error"] for r in jobs.classify_late(static, sessions).collect()}
    assert got == due and set(due.values()) >= {None, "no_receipt", "post_hoc_availability", "availability_precedes_finalization"}
    assert {r["receipt_id"] for r in spark.table("late").collect()} == {i for i, d, t in receipts if i not in seen}
