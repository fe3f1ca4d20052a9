"""Queries of actions, membership, status and signers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitbars.functions import checks
from pitbars.operators import actions, store
from pitbars.plans.oracle import CLICK, sql
from pitbars.sources import views as v


def _actions(s, d):
    n, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = lambda keep, back: F.when(keep, F.date_sub(day, back).cast("string")).otherwise("")
    return v.table(s, d, "orders").select(n, F.lpad((F.col("o_custkey") % 150).cast("string"), 6, "0").alias("code"), (n % 4).alias("cash"), text(n % 11 != 0, 0).alias("operate"), text(n % 2 == 0, 10).alias("plan"), text(n % 3 == 0, 5).alias("notice"), F.when(n % 3 == 0, "0.5").otherwise("").alias("stock"), F.when(n % 5 == 0, "0.25").alias("reserve"))


def _terms(s, d):
    effective, _ = checks.event_dates(F.col("operate"))
    multiplier, kind = checks.action_terms(F.col("stock"), F.col("reserve"))
    return _actions(s, d).select("o_orderkey", "code", "cash", effective.alias("effective"), multiplier.alias("multiplier"), kind.alias("type")).where("effective is not null")


def event_dates(s, d):
    effective, announced = checks.event_dates(F.col("operate"), F.col("plan"), F.col("notice"))
    return _actions(s, d).select("o_orderkey", effective.alias("effective"), announced.alias("announcement"))


def action_terms(s, d):
    return actions.action_dedup(_terms(s, d), [F.col("o_orderkey")])


def action_coverage(s, d):
    return actions.action_coverage(_actions(s, d), _terms(s, d).where("type = 'cash_dividend' and cash = 3"))


def land_member_frames(s, d):
    k = F.col("c_custkey")
    head = F.element_at(F.array(*map(F.lit, ("0", "3", "6", "9"))), (k % 4 + 1).cast("int"))
    raw = F.concat(head, F.lpad((k % 100000).cast("string"), 5, "0"), F.when(k % 4 < 2, ".XSHE").otherwise(".XSHG"))
    return actions.land_member_frames(v.table(s, d, "customer").select("c_custkey", raw.alias("raw"), F.lit("stock").alias("type")))


def _status_frames(s, d):
    """Days of a week apart are doubled; on the third of a month the flag is 2."""
    rows = v.panel(s, d).withColumn("paused", F.when(F.day("date") == 3, 2).otherwise((F.day("date") % 5 == 0).cast("int")))
    return actions.judge_status_frames(rows.unionByName(rows.where("day(date) % 7 = 0")))


def land_status_frames(s, d):
    """Every cell of the panel; one that can't be told is invalid."""
    return _status_frames(s, d).drop("reason")


def status_frame_rejects(s, d):
    return _status_frames(s, d).where("reason is not null").select("code", "date", "reason")


def status_values(s, d):
    k = F.col("c_custkey")
    code = F.concat(F.element_at(F.array(*map(F.lit, ("300", "688", "000"))), (k % 3 + 1).cast("int")), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".SZ"))
    name = F.when(k % 7 == 0, "  ").when(k % 5 == 0, F.concat(F.lit(" *st "), "c_name")).otherwise(F.regexp_replace("c_name", "[a-zA-Z]", "x"))
    rows = v.table(s, d, "customer").select("c_custkey", code.alias("code"), name.alias("name"), F.when(k % 13 != 0, F.col("c_acctbal")).alias("trade"), (k % 9).cast("double").alias("volume"))
    return actions.status_values(rows).select("c_custkey", "valid", "board", "is_st", "is_suspended")


def quote_to_final_bar(s, d):
    return actions.quote_to_final_bar(v.quotes(s, d).withColumn("lots", F.lit(12)), "2024-01-20", "2024-02-10", F.lit("2024-01-30").cast("date"))


def sync_summary(s, d):
    """Every code of the click bars synced over its gaps; those of number 11 say another identity, those of 13 are not fetched."""
    codes, click = v.bars(s, d).select("code").distinct(), v.bars(s, d).where("source = 'click'")
    plan = store.plan_sync(codes, v.coverage(s, d).where("source = 'click'"), store.covered_range(click, finalized_only=True), "2024-01-03", "2024-01-28")
    n = F.substring("code", 2, 5).cast("int")
    fetched = v.bars(s, d).where(CLICK).where(n % 13 != 0).withColumns({"seq": F.col("receipt_id"), "is_final": F.lit(None).cast("boolean"), "adjustment_mode": F.when(n % 11 == 0, "qfq")})
    gaps = plan.where("status = 'gap'").select("code", "gap_start", "gap_end")
    results, _, _ = store.apply_sync(gaps, fetched, "2024-01-03", "2024-01-28", "2024-01-28", ("click", "raw", "click-v1"))
    return actions.sync_summary(plan, results)


QUERIES = {f.__name__: f for f in (event_dates, action_terms, action_coverage, land_member_frames, land_status_frames, status_frame_rejects, status_values, quote_to_final_bar, sync_summary)}

ACTIONS = """acts AS (SELECT *, CASE WHEN n % 11 <> 0 THEN CAST(day AS VARCHAR) END AS effective, 1 + CASE WHEN n % 3 = 0 THEN 0.5 ELSE 0 END + CASE WHEN n % 5 = 0 THEN 0.25 ELSE 0 END AS m
  FROM (SELECT o_orderkey AS n, lpad(CAST(o_custkey % 150 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS day FROM orders))"""

ORACLE_SQL = {
    "event_dates": f"WITH {ACTIONS} SELECT n AS o_orderkey, effective, CAST(CASE WHEN n % 2 = 0 THEN day - 10 WHEN n % 3 = 0 THEN day - 5 END AS VARCHAR) AS announcement FROM acts",
    "action_terms": f"WITH {ACTIONS} SELECT max(n) AS o_orderkey, code, n % 4 AS cash, effective, CAST(m AS DOUBLE) AS multiplier, CASE WHEN m = 1 THEN 'cash_dividend' ELSE 'dividend_and_share_distribution' END AS type FROM acts WHERE effective IS NOT NULL GROUP BY ALL",
    "action_coverage": f"WITH {ACTIONS} SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS event_count, count(*) FILTER (k = 0) AS zero_event_symbols FROM (SELECT code, count(*) FILTER (effective IS NOT NULL AND m = 1 AND n % 4 = 3) AS k FROM acts GROUP BY code)",
    "land_member_frames": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '3' ELSE '6' END || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') || CASE WHEN c_custkey % 4 = 2 THEN '.SH' ELSE '.SZ' END AS code FROM customer WHERE c_custkey % 4 <> 3",
    "land_status_frames": sql("SELECT code, date, CASE WHEN day(date) % 7 <> 0 AND day(date) <> 3 THEN day(date) % 5 <> 0 END AS is_tradable, CASE WHEN day(date) % 7 = 0 OR day(date) = 3 THEN 'invalid' WHEN day(date) % 5 = 0 THEN 'suspended' ELSE 'active' END AS status FROM panel"),
    "status_frame_rejects": sql("SELECT code, date, CASE WHEN day(date) = 3 THEN 'not_a_flag' ELSE 'repeated_row' END AS reason FROM panel WHERE day(date) % 7 = 0 OR day(date) = 3"),
    "status_values": "SELECT k AS c_custkey, ok AS valid, CASE k % 3 WHEN 0 THEN 'CHINEXT' WHEN 1 THEN 'STAR' ELSE 'MAIN' END AS board, CASE WHEN ok THEN k % 5 = 0 END AS is_st, CASE WHEN ok THEN c_acctbal <= 0 OR k % 9 = 0 END AS is_suspended FROM (SELECT *, c_custkey AS k, c_custkey % 7 <> 0 AND c_custkey % 13 <> 0 AS ok FROM customer)",
    "quote_to_final_bar": sql("SELECT code, date, price, CAST(1200 AS BIGINT) AS volume FROM quotes WHERE date BETWEEN DATE '2024-01-20' AND DATE '2024-01-30'"),
    "sync_summary": sql("SELECT count(DISTINCT CASE WHEN NOT gap THEN code END) AS up_to_date, count(DISTINCT CASE WHEN gap AND bad THEN code END) AS errors, count(DISTINCT CASE WHEN gap AND NOT bad AND w > 0 THEN code END) AS synced, count(DISTINCT CASE WHEN gap AND NOT bad AND w = 0 THEN code END) AS no_data FROM r",
        "k AS (SELECT q.code, coalesce(c.start_date, f.lo) AS s, coalesce(c.end_date, f.hi) AS e FROM (SELECT DISTINCT code FROM bars) q LEFT JOIN (SELECT * FROM coverage WHERE source = 'click') c USING (code) LEFT JOIN (SELECT code, min(date) AS lo, max(date) AS hi FROM bars WHERE source = 'click' AND is_final GROUP BY code) f USING (code)), p AS (SELECT code, s, e, s IS NULL OR s > DATE '2024-01-03' OR e < DATE '2024-01-28' AS gap FROM k), r AS (SELECT p.code, any_value(p.gap) AS gap, count(f.date) AS w, count(f.date) > 0 AND CAST(substr(p.code, 2, 5) AS INTEGER) % 11 = 0 AS bad FROM p LEFT JOIN (SELECT * FROM bars WHERE " + CLICK + " AND CAST(substr(code, 2, 5) AS INTEGER) % 13 <> 0 AND date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28') f ON f.code = p.code AND (p.s IS NULL OR f.date < p.s OR f.date > p.e) GROUP BY p.code)"),
}
