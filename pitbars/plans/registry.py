"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitbars.functions import checks, clock, digest, symbols
from pitbars.operators import evidence, quality, store
from pitbars.plans import ledger, more, proofs
from pitbars.plans.oracle import ORACLE_SQL
from pitbars.shared import written
from pitbars.sources import views as v

CLICK = ("click", "raw", "click-v1")
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _click(s, d, held=None):
    b = held or v.bars(s, d)
    for column, value in zip(store.IDENTITY, CLICK, strict=True):
        b = b.where(F.col(column) == value)
    return b


def _quote_bars(s, d):
    q = v.quotes(s, d)
    return q.select("code", "date", F.lit("quote").alias("source"), F.lit("intraday").alias("adjustment_mode"), F.lit("quote-v1").alias("adjustment_version"), *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), F.lit(0).cast("long").alias("volume"), F.lit(None).cast("long").alias("receipt_id"))


@query
def scan_bars(s, d):
    return store.scan_bars(v.bars(s, d), "2024-01-05", "2024-01-20", CLICK, finalized_only=True)


@query
def bars_from_ticks(s, d):
    return store.bars_from_ticks(v.ticks(s, d))


@query
def upsert_bars(s, d):
    return store.upsert_bars(v.bars(s, d), v.batch(s, d))


@query
def dedup_last_wins(s, d):
    return store.last_by(v.batch(s, d).where("adjustment_version <> 'click-v2'"), ["code", "date"], [F.col("receipt_id")]).select("code", "date", "source", "close")


@query
def append_receipts(s, d):
    new = v.batch(s, d).where("adjustment_version <> 'click-v2'").select("receipt_id", "source", F.concat_ws("|", "code", F.col("date").cast("string")).alias("payload"))
    return store.append_receipts(v.receipts(s, d).select("receipt_id", "source", "payload", "response_sha256"), new).drop("payload")


@query
def merge_sync_coverage(s, d):
    return store.merge_sync_coverage(v.coverage(s, d), store.covered_range(v.batch(s, d)))


@query
def to_columnar(s, d):
    out = store.to_columnar(store.scan_bars(v.bars(s, d), "2000-01-01", "2100-01-01", CLICK))
    prices = ("open", "high", "low", "close")
    text = {c: digest.money if c in prices else (lambda x: x.cast("string")) for c in out.columns}
    return out.select(*(F.array_join(F.transform(c, text[c]), ",").alias(c) for c in out.columns if c != "code"), "code")


@query
def covered_range(s, d):
    return store.covered_range(v.bars(s, d), finalized_only=True)


@query
def identity_coverage(s, d):
    return store.identity_coverage(v.bars(s, d))


@query
def table_counts(s, d):
    return store.table_counts(v.bars(s, d), v.receipts(s, d))


@query
def ambiguous_codes(s, d):
    return store.ambiguous_codes(store.upsert_bars(v.bars(s, d), v.batch(s, d)))


@query
def finalized_view(s, d):
    return store.finalized_view(v.bars(s, d), clock.latest_finalized_date(F.lit("2024-01-20 16:00:00").cast("timestamp_ntz")))


@query
def snapshot_rows(s, d):
    return store.snapshot_rows(v.bars(s, d), "2024-01-20", "raw", v.panel(s, d).select("code").distinct(), "click")


@query
def missing_gaps(s, d):
    known = v.bars(s, d).select("code").distinct().join(v.coverage(s, d).where("source = 'click'"), "code", "left")
    return store.missing_gaps(known, "2024-01-01", "2024-02-05")


@query
def overlay_today(s, d):
    return store.overlay_today(_click(s, d), _quote_bars(s, d)).select("code", "date", "close", "is_final")


@query
def plan_sync(s, d):
    codes = v.bars(s, d).select("code").distinct()
    return store.plan_sync(codes, v.coverage(s, d).where("source = 'click'"), store.covered_range(_click(s, d), finalized_only=True), "2024-01-03", "2024-01-28")


@query
def consensus(s, d):
    return quality.consensus(v.bars(s, d)).drop("_median")


@query
def consensus_realtime(s, d):
    return quality.with_realtime(quality.consensus(v.bars(s, d)), v.quotes(s, d))


@query
def cross_check(s, d):
    two = v.bars(s, d).where(F.col("source").isin("click", "view") & F.col("date").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-31").cast("date")))
    return quality.with_realtime(quality.consensus(two), v.quotes(s, d))


@query
def ohlc_cross_check(s, d):
    return quality.ohlc_cross_check(v.bars(s, d))


def _pair(s, d):
    b = v.bars(s, d)
    return b.where("source = 'click'"), b.where("source = 'view'")


@query
def deviation_profile(s, d):
    return quality.deviation_profile(*_pair(s, d))


@query
def reconcile_sources(s, d):
    return quality.reconcile_sources(*_pair(s, d))


@query
def reconcile_fields(s, d):
    return quality.reconcile_fields(*_pair(s, d))


@query
def calendar_gaps(s, d):
    return quality.calendar_gaps(_click(s, d), v.calendar(s, d))


@query
def next_session(s, d):
    return quality.next_session(v.sessions(s, d))


@query
def daily_returns(s, d):
    return quality.daily_returns(v.bars(s, d))


@query
def return_agreement(s, d):
    return quality.return_agreement(v.bars(s, d), "click", "view")


@query
def latest_n_per_source(s, d):
    return quality.latest_n_per_source(v.bars(s, d))


def _codes(s, d):
    return v.raw_codes(s, d).withColumn("code", symbols.normalize_symbol(F.col("raw")))


@query
def normalize_symbol(s, d):
    return _codes(s, d)


@query
def symbol_forms(s, d):
    c = F.col("code")
    return _codes(s, d).where("code is not null").select("p_partkey", symbols.digits(c).alias("digits"), symbols.prefixed(c).alias("prefixed"), symbols.dotted(c).alias("dotted"))


@query
def is_index_or_etf(s, d):
    c = F.col("code")
    return _codes(s, d).where("code is not null").select("p_partkey", symbols.is_index_or_etf(c).alias("index_or_etf"), symbols.is_index(c).alias("is_index"))


@query
def market_symbol(s, d):
    n = F.col("p_partkey") % 3
    x = F.when(n == 0, F.col("raw")).when(n == 1, F.concat(F.lit("bj"), F.trim("raw"))).otherwise(F.concat(F.lit("bj"), F.substring("raw", 1, 6)))
    return v.raw_codes(s, d).select("p_partkey", symbols.market_symbol(x).alias("code"))


@query
def board(s, d):
    c = F.col("code")
    return _codes(s, d).where("code is not null").select("p_partkey", symbols.board(c).alias("context"), symbols.board(c, "export").alias("export"))


@query
def distinct_codes(s, d):
    return _codes(s, d).where("code is not null").select("code").distinct()


@query
def latest_finalized_date(s, d):
    t = F.col("local_ts")
    return v.ticks(s, d).select("event_id", clock.latest_finalized_date(t).alias("latest"), clock.is_final(F.lit("2024-01-15").cast("date"), t).alias("is_final"))


@query
def observation_phase(s, d):
    t = v.ticks(s, d).withColumn("phase", clock.observation_phase(F.col("local_ts")))
    at = lambda p: F.when(F.col("phase") == p, F.col("local_ts"))
    return t.select("event_id", "phase", at("pre_open").alias("decision_available_at"), at("post_close").alias("outcome_observed_at"), at("post_close").alias("finalized_at"))


@query
def capture_admissible(s, d):
    day = F.date_sub(F.col("date"), (F.col("event_id") % 2).cast("int"))
    return v.ticks(s, d).select("event_id", clock.capture_admissible(day, F.col("local_ts")).alias("admissible"))


@query
def price_availability(s, d):
    joined = v.bars(s, d).join(v.receipts(s, d).select("receipt_id", "observed_at"), "receipt_id").join(quality.next_session(v.sessions(s, d)), "date", "left")
    return joined.select("receipt_id", clock.price_availability_error(F.col("date"), F.col("observed_at"), F.col("next_date")).alias("error"))


@query
def execution_cutoff(s, d):
    joined = v.bars(s, d).join(v.receipts(s, d).select("receipt_id", "observed_at"), "receipt_id").withColumn("kind", F.explode(F.array(F.lit("execution_prices"), F.lit("signal_prices"), F.lit("market_rules"))))
    return joined.select("receipt_id", "kind", clock.execution_cutoff_ok(F.col("kind"), F.col("date"), F.col("observed_at")).alias("ok"))


def _record():
    return {"code": F.col("code"), "date": F.col("date"), "source": F.col("source"), "close": digest.money(F.col("close"))}


@query
def record_sha256(s, d):
    return v.bars(s, d).select("receipt_id", digest.record_sha256(**_record()).alias("record_sha256"))


@query
def field_validity(s, d):
    r = v.receipts(s, d).join(v.bars(s, d).select("receipt_id", "code", "date"), "receipt_id")
    n = F.col("receipt_id") % 6
    day = F.col("date").cast("string")
    entry = F.when(n == 0, F.concat("code", F.lit("@"), day)).when(n == 1, F.concat(F.lit("@"), day)).when(n == 2, F.concat("code", F.lit("@2024-02-30"))).when(n == 3, F.concat("code", F.lit("@"), day, F.lit("@x"))).when(n == 4, F.col("code"))
    stamp = F.concat(day, F.element_at(F.array(*map(F.lit, ("T10:00:00+08:00", "T10:00:00", "T25:00:00+08:00", "T10:00:00.000000+08:00", "T10:00:00.000001-05:30", "T10:00:00+99:99"))), n.cast("int") + 1))
    return r.select("receipt_id", checks.valid_sha256(F.col("response_sha256")).alias("sha_ok"), checks.valid_panel_entry(entry).alias("entry_ok"), checks.valid_tz_timestamp(stamp).alias("stamp_ok"))


@query
def legacy_identity(s, d):
    r = F.col("receipt_id")
    parts = checks.filled_identity(F.when(r % 3 == 0, "").otherwise(F.col("source")), F.when(r % 5 != 0, F.col("adjustment_mode")), F.col("adjustment_version"))
    state = checks.filled_state(F.when(r % 4 == 0, "").when(r % 4 == 1, "2024-01-01"), F.when(r % 2 == 0, F.col("is_final")), F.lit("2024-03-01"))
    return v.bars(s, d).select("receipt_id", *(p.alias(n) for p, n in zip([*parts, *state], [*store.IDENTITY, "retrieved_at", "is_final"], strict=True)))


@query
def bars_with_receipts(s, d):
    return evidence.bars_with_receipts(v.bars(s, d), v.receipts(s, d)).select("code", "date", "source", "receipt_id", "receipt_source", "response_sha256", "observed_at")


@query
def panel_select(s, d):
    return evidence.panel_select(_click(s, d), v.panel(s, d))


@query
def panel_missing(s, d):
    return evidence.panel_missing(v.panel(s, d), _click(s, d))


@query
def panel_digest(s, d):
    return digest.panel_digest(v.panel(s, d).select(evidence.cell().alias("panel_entry")))


@query
def content_digest(s, d):
    return digest.content_digest(v.bars(s, d).where("is_final"), _record())


@query
def calendar_spine(s, d):
    b = v.bars(s, d)
    dates = b.where("source = 'click'").select("date").distinct().unionByName(b.where("source = 'view' and day(date) % 7 = 0").select("date").distinct())
    return evidence.spine_errors(dates, v.calendar(s, d))


@query
def date_set_ops(s, d):
    left, right = _pair(s, d)
    return evidence.set_operations(left.select("code", "date"), right.select("code", "date"))


@query
def same_set(s, d):
    return evidence.same_set(v.coverage(s, d).select("code"), v.panel(s, d).select("code"))


@query
def price_readiness(s, d):
    held = written(v.bars(s, d), "bars")
    return evidence.price_readiness(_click(s, d, held), v.receipts(s, d, held), v.panel(s, d, held), unobserved_end=True)


@query
def get_history(s, d):
    latest = clock.latest_finalized_date(F.lit("2024-02-09 10:00:00").cast("timestamp_ntz"))
    rows = store.get_history(_click(s, d), _quote_bars(s, d), v.panel(s, d).select(F.lower(F.concat(F.substring("code", 8, 2), F.substring("code", 1, 6))).alias("raw")), "2024-01-10", "2024-02-10", "2024-02-09", latest)
    return rows.select("code", "date", "close", "is_final").orderBy("code", "date")


@query
def receipt_covers_bar(s, d):
    joined = evidence.bars_with_receipts(v.bars(s, d), v.receipts(s, d))
    return joined.select("receipt_id", evidence.receipt_covers_bar(F.col("payload")).alias("covers"))


QUERIES |= more.QUERIES | ledger.QUERIES | proofs.QUERIES
ORACLE_SQL = ORACLE_SQL | more.ORACLE_SQL | ledger.ORACLE_SQL | proofs.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
