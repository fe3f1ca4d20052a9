"""Queries of landing, panel and rule operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitbars.functions import symbols
from pitbars.functions.digest import content_digest, money, record_sha256
from pitbars.operators import evidence, panels
from pitbars.plans.oracle import root_of, CLICK, COVERS, sql
from pitbars.sources import landing
from pitbars.sources import views as v


def _click(s, d):
    return v.bars(s, d).where(CLICK)


def land_fields_rows(s, d):
    volume = F.when(F.col("receipt_id") % 5 == 0, "").otherwise(F.col("volume").cast("string"))
    rows = _click(s, d).groupBy("code").agg(F.to_json(F.struct(F.lit("date,close,open,high,low,volume").alias("fields"), F.collect_list(F.array(F.col("date").cast("string"), *(money(F.col(c)) for c in ("close", "open", "high", "low")), volume)).alias("rows"))).alias("payload"))
    return landing.land_fields_rows(rows)


def land_kline_pages(s, d):
    page = F.when(F.day("date") <= 15, F.array(F.lit(1))).when(F.day("date") == 16, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    up = lambda c: money(F.col(c) + F.when(F.col("page_no") == 2, 1).otherwise(0) + 1)
    rows = _click(s, d).withColumn("page_no", F.explode(page)).groupBy("code", "page_no").agg(F.collect_list(F.array(F.col("date").cast("string"), up("open"), up("close"), up("high"), up("low"), (F.col("volume") / 100).cast("long").cast("string"))).alias("qfqday"))
    text = F.concat(F.lit('kline_dayqfq={"code":0,"data":{"'), "code", F.lit('":'), F.to_json(F.struct("qfqday")), F.lit("}}"))
    return landing.land_kline_pages(rows.select("code", "page_no", text.alias("payload")), "qfqday")


def land_quote_lines(s, d):
    q, n = v.quotes(s, d), F.substring("code", 2, 5).cast("int")
    blank = [F.lit("")] * 35
    fields = list(blank)
    fields[3], fields[6] = money(F.when(n % 7 == 0, 0).otherwise(F.col("price"))), F.when(n % 11 == 0, "0").otherwise("12")
    fields[5], fields[30] = F.when(n % 2 == 0, money(F.col("price") + 1)).otherwise(""), F.concat(F.date_format("date", "yyyyMMdd"), F.lit("150003"))
    return landing.land_quote_lines(q.select("code", F.concat(F.lit('v="'), F.concat_ws("~", *fields), F.lit('";')).alias("line")))


def plan_year_pages(s, d):
    c = v.table(s, d, "customer")
    start = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int"))
    return landing.plan_year_pages(c.select(F.col("c_custkey").alias("key"), start.alias("start"), F.date_add(start, (F.col("c_custkey") % 1500).cast("int")).alias("end")))


def panel_product_missing(s, d):
    return panels.panel_product_missing(evidence.panel_select(_click(s, d), v.panel(s, d)).select("code", "date"))


def warmup_panel(s, d):
    return panels.warmup_panel(v.panel(s, d), v.sessions(s, d), "2024-01-15", 3)


def component_grid(s, d):
    p = v.panel(s, d)
    records = p.select(F.explode(F.array(*(F.lit(c) for c in panels.COMPONENTS if c != "decision_context"))).alias("component"), "code", "date", F.day("date").alias("n"))
    twice = records.unionByName(records.where("component = 'instrument_status' and n % 5 = 0")).where("not (component = 'universe' and n % 7 = 0)")
    return panels.component_grid(p, twice)


def cohort_missing(s, d):
    return v.panel(s, d).select("code").distinct().join(_click(s, d).where("date = date '2024-01-10'").select("code"), "code", "left_anti")


def universe_covers_panel(s, d):
    return evidence.panel_missing(v.panel(s, d), v.bars(s, d))


def listing_interval(s, d):
    k = F.col("c_custkey")
    listing = v.table(s, d, "customer").select("c_custkey", F.date_add(F.lit("2023-12-20").cast("date"), (k % 40).cast("int")).alias("ipo"), F.when(k % 3 == 0, F.date_add(F.lit("2024-01-10").cast("date"), (k % 17).cast("int"))).alias("out"))
    return panels.listed_on(listing, v.sessions(s, d)).groupBy("c_custkey").agg(F.count("*").alias("days"))


def rules_asof(s, d):
    rules = [("limit", "MAIN", "2020-01-01", 0.1), ("limit", "CHINEXT", "2020-01-01", 0.1), ("limit", "CHINEXT", "2024-01-15", 0.2), ("stamp", "MAIN", "2023-08-28", 0.0005), ("stamp", "MAIN", "2024-01-20", 0.001)]
    table = s.createDataFrame(rules, "rule string, board string, valid_from string, value double").withColumn("valid_from", F.to_date("valid_from"))
    return panels.rules_asof(_click(s, d).select("code", "date", symbols.board(F.col("code")).alias("board")), table).select("code", "date", "rule", "value")


def daily_record_counts(s, d):
    b = v.bars(s, d)
    return panels.daily_record_counts(_click(s, d), b.where("source = 'view'").groupBy("date").agg(F.count("*").alias("declared")))


def duplicate_records(s, d):
    return panels.duplicate_records(v.bars(s, d), record_sha256(code=F.col("code"), date=F.col("date")))


def snapshot_manifest(s, d):
    rows = _click(s, d).where("is_final and date <= date '2024-01-20'")
    found = content_digest(rows, {"code": F.col("code"), "date": F.col("date"), "close": money(F.col("close"))})
    return found.select(F.concat(F.lit("2024-01-20-"), F.substring("digest", 1, 16)).alias("snapshot_id"), "digest", "row_count")


def priced_panel(s, d):
    return evidence.priced_panel(_click(s, d), v.receipts(s, d), v.panel(s, d)).select("code", "date", "close", "receipt_id")


QUERIES = {f.__name__: f for f in (land_fields_rows, land_kline_pages, land_quote_lines, plan_year_pages, panel_product_missing, warmup_panel, component_grid, cohort_missing, universe_covers_panel, listing_interval, rules_asof, daily_record_counts, duplicate_records, snapshot_manifest, priced_panel)}

M = "CAST(CAST({} AS DECIMAL(18,2)) AS DOUBLE) AS {}"
BOARD = "CASE WHEN substr(code, 1, 3) IN ('300', '301') THEN 'CHINEXT' WHEN substr(code, 1, 3) IN ('688', '689') THEN 'STAR' ELSE 'MAIN' END"
RECORD3 = "CAST(to_json({'close': CAST(CAST(close AS DECIMAL(18,2)) AS VARCHAR), 'code': code, 'date': CAST(date AS VARCHAR)}) AS VARCHAR)"
RECORD2 = "CAST(to_json({'code': code, 'date': CAST(date AS VARCHAR)}) AS VARCHAR)"
COMP = "'corporate_actions', 'decision_context', 'execution_prices', 'instrument_status', 'market_rules', 'signal_prices', 'trading_calendar', 'universe'"
LATE = "CASE WHEN CAST(o AS DATE) < date OR (CAST(o AS DATE) = date AND CAST(o AS TIME) < TIME '15:00:00') THEN 'a' WHEN CAST(o AS DATE) = date THEN NULL WHEN nd IS NULL THEN 'b' WHEN CAST(o AS DATE) <> nd OR CAST(o AS TIME) >= TIME '09:25:00' THEN 'c' END"

ORACLE_SQL = {
    "land_fields_rows": sql("SELECT code, date, " + ", ".join(M.format(c, c) for c in ("open", "high", "low", "close")) + f", CASE WHEN receipt_id % 5 = 0 THEN 0.0 ELSE CAST(volume AS DOUBLE) END AS volume FROM bars WHERE {CLICK}"),
    "land_kline_pages": sql("SELECT code, date, " + ", ".join(M.format(f"{c} + 1 + CASE WHEN day(date) >= 16 THEN 1 ELSE 0 END", c) for c in ("open", "high", "low", "close")) + f", CAST(volume AS DOUBLE) AS volume FROM bars WHERE {CLICK}"),
    "land_quote_lines": sql("SELECT code, date, p AS price, CASE WHEN n % 2 = 0 THEN CAST(CAST(price + 1 AS DECIMAL(18,2)) AS DOUBLE) ELSE p END AS open, p AS high, p AS low, CAST(12 AS DOUBLE) AS lots FROM (SELECT *, CAST(substr(code, 2, 5) AS INTEGER) AS n, CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) AS p FROM quotes) WHERE n % 7 <> 0 AND n % 11 <> 0 AND p > 0"),
    "plan_year_pages": "WITH c AS (SELECT c_custkey AS key, DATE '2020-01-01' + CAST(c_custkey % 700 AS INTEGER) AS a, DATE '2020-01-01' + CAST(c_custkey % 700 + c_custkey % 1500 AS INTEGER) AS b FROM customer), y AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS y FROM c) SELECT key, greatest(a, make_date(y, 1, 1)) AS page_start, least(b, make_date(y, 12, 31)) AS page_end FROM y",
    "panel_product_missing": sql("SELECT code, date FROM (SELECT DISTINCT code FROM k), (SELECT DISTINCT date FROM k) EXCEPT SELECT code, date FROM k", f"k AS (SELECT code, date FROM bars JOIN panel USING (code, date) WHERE {CLICK})"),
    "warmup_panel": sql("SELECT code, date FROM (SELECT DISTINCT code FROM panel), (SELECT date FROM sessions WHERE date < DATE '2024-01-15' ORDER BY date DESC LIMIT 3)"),
    "component_grid": sql(f"SELECT component, code, date, CAST(CASE WHEN component = 'decision_context' OR (component = 'universe' AND day(date) % 7 = 0) THEN 0 ELSE 2 END AS BIGINT) AS times FROM (SELECT unnest([{COMP}]) AS component, code, date FROM panel) WHERE component = 'decision_context' OR (component = 'universe' AND day(date) % 7 = 0) OR (component = 'instrument_status' AND day(date) % 5 = 0)"),
    "cohort_missing": sql(f"SELECT DISTINCT code FROM panel WHERE code NOT IN (SELECT code FROM bars WHERE {CLICK} AND date = DATE '2024-01-10')"),
    "universe_covers_panel": sql("SELECT code, date FROM panel EXCEPT SELECT code, date FROM bars"),
    "listing_interval": sql("SELECT c_custkey, count(*) AS days FROM (SELECT c_custkey, DATE '2023-12-20' + CAST(c_custkey % 40 AS INTEGER) AS ipo, CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-01-10' + CAST(c_custkey % 17 AS INTEGER) END AS o FROM customer) JOIN sessions ON date >= ipo AND (o IS NULL OR date < o) GROUP BY c_custkey"),
    "rules_asof": sql(f"SELECT code, date, 'limit' AS rule, CASE WHEN b = 'CHINEXT' AND date >= DATE '2024-01-15' THEN 0.2 ELSE 0.1 END::DOUBLE AS value FROM k WHERE b IN ('MAIN', 'CHINEXT') UNION ALL SELECT code, date, 'stamp', CASE WHEN date >= DATE '2024-01-20' THEN 0.001 ELSE 0.0005 END::DOUBLE FROM k WHERE b = 'MAIN'", f"k AS (SELECT code, date, {BOARD} AS b FROM bars WHERE {CLICK})"),
    "daily_record_counts": sql(f"SELECT coalesce(a.date, b.date) AS date, coalesce(found, 0) AS found, coalesce(declared, 0) AS declared FROM (SELECT date, count(*) AS found FROM bars WHERE {CLICK} GROUP BY date) a FULL JOIN (SELECT date, count(*) AS declared FROM bars WHERE source = 'view' GROUP BY date) b ON a.date = b.date WHERE coalesce(found, 0) <> coalesce(declared, 0)"),
    "duplicate_records": sql(f"SELECT sha256({RECORD2}) AS record_sha256, count(*) AS times FROM bars GROUP BY code, date HAVING count(*) > 1"),
    "snapshot_manifest": sql(f"SELECT '2024-01-20-' || substr(digest, 1, 16) AS snapshot_id, digest, row_count FROM ({root_of('g')})", f"g AS (SELECT sha256({RECORD3}) AS d FROM bars WHERE {CLICK} AND is_final AND date <= DATE '2024-01-20')"),
    "priced_panel": sql(f"SELECT code, date, close, receipt_id FROM (SELECT sel.*, {LATE} AS late FROM sel JOIN nx USING (date)) WHERE late IS NULL", f"chosen AS (SELECT b.* FROM bars b JOIN panel USING (code, date) WHERE {CLICK} AND is_final), nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM chosen)), sel AS (SELECT c.*, r.observed_at AS o, payload FROM chosen c JOIN receipts r ON r.receipt_id = c.receipt_id AND r.source = c.source WHERE r.response_sha256 = sha256(r.payload) AND r.observed_at = r.retrieved_at AND {COVERS})"),
}
