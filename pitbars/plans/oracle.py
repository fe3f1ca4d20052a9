"""DuckDB statements of the derived views, written independently of the DataFrame code."""

VIEWS = """
ticks AS (SELECT event_id, value, event_type AS source, ts + INTERVAL 8 HOUR AS local_ts, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date,
  CASE user_id % 3 WHEN 0 THEN '6' WHEN 1 THEN '0' ELSE '3' END || lpad(CAST(user_id AS VARCHAR), 5, '0') || CASE user_id % 3 WHEN 0 THEN '.SH' ELSE '.SZ' END AS code FROM events),
bars AS (SELECT code, date, source, 'raw' AS adjustment_mode, source || '-v1' AS adjustment_version,
  arg_min(value, (local_ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (local_ts, event_id)) AS close,
  CAST(count(*) * 100 AS BIGINT) AS volume, min(event_id) AS receipt_id, date < (SELECT max(date) FROM ticks) AS is_final
  FROM ticks GROUP BY code, date, source),
receipts0 AS (SELECT receipt_id, CASE WHEN receipt_id % 43 = 0 THEN NULL WHEN receipt_id % 13 = 0 THEN 'other' ELSE source END AS source,
  CAST(date AS TIMESTAMP) + INTERVAL 14 HOUR + to_minutes(CAST((receipt_id % 48) * 30 AS INTEGER)) AS observed_at,
  CASE WHEN receipt_id % 29 <> 0 THEN '{"fields":"date,open,high,low,close,volume","rows":[["' || date || '","' || CAST(open + CASE WHEN receipt_id % 23 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) || '","' || CAST(high AS DECIMAL(18,2))
  || '","' || CAST(low AS DECIMAL(18,2)) || '","' || CAST(close + CASE WHEN receipt_id % 19 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) || '","' || volume || '"]]}' END AS payload
  FROM bars WHERE receipt_id % 7 <> 0),
receipts AS (SELECT receipt_id, source, payload, CASE WHEN receipt_id % 37 = 0 THEN NULL WHEN receipt_id % 11 = 0 THEN 'bad' ELSE sha256(payload) END AS response_sha256,
  CASE WHEN receipt_id % 31 <> 0 THEN observed_at - to_minutes(CASE WHEN receipt_id % 17 = 0 THEN 10 ELSE 0 END) END AS retrieved_at, CASE WHEN receipt_id % 41 <> 0 THEN observed_at END AS observed_at FROM receipts0),
sessions AS (SELECT DISTINCT date FROM bars WHERE isodow(date) < 6),
nexts AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM sessions),
panel AS (SELECT c.code, s.date FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN sessions s),
calendar AS (SELECT CAST(d AS DATE) AS date, isodow(d) < 6 AS is_trading_day FROM (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM ticks)),
quotes AS (SELECT code, arg_max(value, (local_ts, event_id)) * CASE WHEN CAST(substr(code, 2, 5) AS INTEGER) % 4 = 0 THEN 1.02 ELSE 1.0 END AS price, max(date) AS date FROM ticks GROUP BY code),
batch0 AS (SELECT code, date, source, adjustment_mode, adjustment_version, open, high, low, close + 0.5 AS close, volume, receipt_id, is_final FROM bars WHERE date > (SELECT max(date) FROM bars) - 10),
batch AS (SELECT * FROM batch0 UNION ALL SELECT code, date, source, adjustment_mode, 'click-v2' AS adjustment_version, open, high, low, close, volume, receipt_id, is_final FROM batch0 WHERE source = 'click'),
coverage AS (SELECT code, source, adjustment_mode, adjustment_version, min(date) AS start_date, max(date) AS end_date FROM bars WHERE CAST(substr(code, 2, 5) AS INTEGER) % 3 <> 0 GROUP BY ALL),
raw0 AS (SELECT p_partkey, p_partkey % 4 AS n, lpad(CAST(p_partkey % 700 * 997 % 1000000 AS VARCHAR), 6, '0') AS d FROM part),
raw_codes AS (SELECT p_partkey, CASE n WHEN 0 THEN d || '.sh' WHEN 1 THEN 'sz' || d WHEN 2 THEN d ELSE ' ' || d || '.SZ ' END AS raw FROM raw0),
normal AS (SELECT p_partkey, raw, CASE WHEN regexp_matches(u, '^[0-9]{6}[.](SH|SZ)$') THEN u WHEN regexp_matches(u, '^(SH|SZ)[0-9]{6}$') THEN substr(u, 3) || '.' || substr(u, 1, 2)
  WHEN regexp_matches(u, '^[659][0-9]{5}$') THEN u || '.SH' WHEN regexp_matches(u, '^[031][0-9]{5}$') THEN u || '.SZ' END AS code FROM (SELECT *, upper(trim(raw)) AS u FROM raw_codes))
"""


#: Whether the response of a receipt holds the bar beside it.
COVERS = "coalesce(payload->>'$.rows[0][0]' = CAST(date AS VARCHAR) AND " + " AND ".join(f"CAST(payload->>'$.rows[0][{k}]' AS DOUBLE) = {c}" for k, c in enumerate(("open", "high", "low", "close", "volume"), 1)) + ", false)"
RECORD = "CAST(to_json({'close': CAST(CAST(close AS DECIMAL(18,2)) AS VARCHAR), 'code': code, 'date': CAST(date AS VARCHAR), 'source': source}) AS VARCHAR)"


def root_of(table: str, where: str = "") -> str:
    """Digest and count of the row digests (column d) of a table: count and sums of their four 64-bit words."""
    words = " || ',' || ".join(f"CAST(coalesce(sum(CAST(('0x' || substr(d, {16 * k + 1}, 16))::UBIGINT AS HUGEINT)), 0) % 18446744073709551616 AS VARCHAR)" for k in range(4))
    return f"SELECT sha256(count(*) || ',' || {words}) AS digest, count(*) AS row_count FROM {table} {where}"


def sql(body: str, more: str = "") -> str:
    return f"WITH {VIEWS}{', ' + more if more else ''} {body}"


BAR = "code, date, source, adjustment_mode, adjustment_version, open, high, low, close, volume, receipt_id, is_final"
CLICK = "source = 'click' AND adjustment_mode = 'raw' AND adjustment_version = 'click-v1'"

UPSERT = f"""upserted AS (SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY code, date, source, adjustment_mode, adjustment_version ORDER BY seq DESC, receipt_id DESC) AS rn
  FROM (SELECT *, 0 AS seq FROM bars UNION ALL SELECT *, 1 AS seq FROM batch)) WHERE rn = 1)"""

MEDIANS = """med AS (SELECT code, date, median(close) AS m, count(*) AS n FROM bars GROUP BY code, date),
cons AS (SELECT b.code, b.date, any_value(m) AS m, any_value(n) AS n, string_agg(b.source, ',' ORDER BY b.source) FILTER (m = 0 OR abs(b.close - m) / abs(m) > 0.005) AS o FROM bars b JOIN med USING (code, date) GROUP BY b.code, b.date)"""

RECON = """rec AS (SELECT coalesce(a.code, b.code) AS code, coalesce(a.date, b.date) AS date, a.code IS NOT NULL AS l, b.code IS NOT NULL AS r,
  abs(a.open - b.open) > 1e-8 AS d1, abs(a.high - b.high) > 1e-8 AS d2, abs(a.low - b.low) > 1e-8 AS d3, abs(a.close - b.close) > 1e-8 AS d4, abs(a.volume - b.volume) > 100 AS d5
  FROM (SELECT * FROM bars WHERE source = 'click') a FULL JOIN (SELECT * FROM bars WHERE source = 'view') b ON a.code = b.code AND a.date = b.date)"""

RETURNS = """rets AS (SELECT code, source, date, round((close / p - 1) * 100, 3) AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY code, source ORDER BY date) AS p FROM bars) WHERE p IS NOT NULL AND p <> 0)"""

ORACLE_SQL: dict[str, str] = {
    "scan_bars": sql(f"SELECT {BAR} FROM bars WHERE {CLICK} AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND is_final"),
    "bars_from_ticks": sql("SELECT code, date, source, adjustment_mode, adjustment_version, open, high, low, close, volume, receipt_id FROM bars"),
    "upsert_bars": sql(f"SELECT {BAR} FROM upserted", UPSERT),
    "dedup_last_wins": sql("SELECT code, date, source, close FROM (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY receipt_id DESC) AS rn FROM batch WHERE adjustment_version <> 'click-v2') WHERE rn = 1"),
    "append_receipts": sql("SELECT receipt_id, source, response_sha256 FROM receipts UNION ALL SELECT receipt_id, source, sha256(code || '|' || CAST(date AS VARCHAR)) FROM batch WHERE adjustment_version <> 'click-v2' AND receipt_id NOT IN (SELECT receipt_id FROM receipts)"),
    "merge_sync_coverage": sql("SELECT code, source, adjustment_mode, adjustment_version, min(s) AS start_date, max(e) AS end_date FROM (SELECT code, source, adjustment_mode, adjustment_version, start_date AS s, end_date AS e FROM coverage UNION ALL SELECT code, source, adjustment_mode, adjustment_version, min(date), max(date) FROM batch GROUP BY ALL) GROUP BY code, source, adjustment_mode, adjustment_version"),
    "to_columnar": sql("SELECT code, " + ", ".join(f"string_agg(CAST({e} AS VARCHAR), ',' ORDER BY date) AS {n}" for n, e in (("time", "date"), *((c, f"CAST({c} AS DECIMAL(18,2))") for c in ("open", "high", "low", "close")), ("volume", "volume"))) + f" FROM bars WHERE {CLICK} GROUP BY code"),
    "covered_range": sql("SELECT code, source, adjustment_mode, adjustment_version, min(date) AS start_date, max(date) AS end_date FROM bars WHERE is_final GROUP BY ALL"),
    "identity_coverage": sql("SELECT source, adjustment_mode, adjustment_version, count(*) AS n_rows, count(*) FILTER (is_final) AS n_final, count(receipt_id) AS n_linked, min(date) AS start_date, max(date) AS end_date FROM bars GROUP BY ALL"),
    "table_counts": sql("SELECT count(*) AS total, count(*) FILTER (is_final) AS finalized, count(r.receipt_id) AS linked, count(*) - count(r.receipt_id) AS missing_receipt FROM bars b LEFT JOIN receipts r USING (receipt_id)"),
    "ambiguous_codes": sql("SELECT code, count(*) AS identities FROM (SELECT DISTINCT code, source, adjustment_mode, adjustment_version FROM upserted) GROUP BY code HAVING count(*) > 1", UPSERT),
    "finalized_view": sql(f"SELECT {BAR} FROM bars WHERE is_final AND date <= DATE '2024-01-20'"),
    "snapshot_rows": sql(f"SELECT {BAR} FROM bars WHERE is_final AND date <= DATE '2024-01-20' AND adjustment_mode = 'raw' AND source = 'click' AND code IN (SELECT code FROM panel)"),
    "missing_gaps": sql("""SELECT code, a AS gap_start, b AS gap_end FROM (
        SELECT code, DATE '2024-01-01' AS a, least(s - 1, DATE '2024-02-05') AS b FROM cov WHERE s IS NOT NULL UNION ALL SELECT code, greatest(e + 1, DATE '2024-01-01'), DATE '2024-02-05' FROM cov WHERE s IS NOT NULL
        UNION ALL SELECT code, DATE '2024-01-01', DATE '2024-02-05' FROM cov WHERE s IS NULL) WHERE a <= b""", "cov AS (SELECT q.code, s, e FROM (SELECT DISTINCT code FROM bars) q LEFT JOIN (SELECT code, start_date AS s, end_date AS e FROM coverage WHERE source = 'click') USING (code))"),
    "overlay_today": sql(f"SELECT code, date, close, is_final FROM bars b WHERE {CLICK} AND NOT EXISTS (SELECT 1 FROM quotes q WHERE q.code = b.code AND q.date = b.date) UNION ALL SELECT code, date, price, false FROM quotes"),
    "plan_sync": sql("""SELECT c.code, g.a AS gap_start, g.b AS gap_end, CASE WHEN g.a IS NULL THEN 'up_to_date' ELSE 'gap' END AS status FROM (SELECT code FROM k) c LEFT JOIN (SELECT code, a, b FROM (
        SELECT code, DATE '2024-01-03' AS a, least(s - 1, DATE '2024-01-28') AS b FROM k WHERE s IS NOT NULL UNION ALL SELECT code, greatest(e + 1, DATE '2024-01-03'), DATE '2024-01-28' FROM k WHERE s IS NOT NULL
        UNION ALL SELECT code, DATE '2024-01-03', DATE '2024-01-28' FROM k WHERE s IS NULL) WHERE a <= b) g USING (code)""",
        f"k AS (SELECT q.code, coalesce(c.start_date, f.lo) AS s, coalesce(c.end_date, f.hi) AS e FROM (SELECT DISTINCT code FROM bars) q LEFT JOIN (SELECT * FROM coverage WHERE source = 'click') c USING (code) LEFT JOIN (SELECT code, min(date) AS lo, max(date) AS hi FROM bars WHERE {CLICK} AND is_final GROUP BY code) f USING (code))"),
    "consensus": sql("SELECT code, date, round(m, 4) AS consensus, n AS n_sources, coalesce(o, '') AS outliers, o IS NULL AS agreement FROM cons", MEDIANS),
    "consensus_realtime": sql("SELECT c.code, c.date, round(m, 4) AS consensus, n AS n_sources, coalesce(o, '') AS outliers, o IS NULL AS agreement, CASE WHEN q.price IS NOT NULL AND m <> 0 THEN abs(q.price - m) / abs(m) <= 0.01 END AS realtime_match FROM cons c LEFT JOIN quotes q ON q.code = c.code AND q.date = c.date", MEDIANS),
    "ohlc_cross_check": sql("""SELECT code, ns AS n_sources, coalesce(days, 0) AS days, coalesce(bad, 0) AS mismatches, CASE WHEN ns < 2 THEN 'SKIP' WHEN coalesce(bad, 0) = 0 THEN 'PASS' ELSE 'FAIL(' || bad || ')' END AS verdict
        FROM ns LEFT JOIN (SELECT code, count(*) AS days FROM dd GROUP BY code) USING (code) LEFT JOIN (SELECT code, count(*) AS bad FROM sp WHERE v[len(v) // 2 + 1] <> 0 AND (list_max(v) - list_min(v)) / abs(v[len(v) // 2 + 1]) > 0.005 GROUP BY code) USING (code)""",
        """ns AS (SELECT code, count(DISTINCT source) AS ns FROM bars GROUP BY code),
        dd AS (SELECT code, date FROM (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM (SELECT code, date FROM bars JOIN ns USING (code) GROUP BY code, date, ns HAVING count(DISTINCT source) = ns)) WHERE rn <= 8),
        cells AS (SELECT code, date, 'open' AS f, open AS x FROM bars UNION ALL SELECT code, date, 'high', high FROM bars UNION ALL SELECT code, date, 'low', low FROM bars UNION ALL SELECT code, date, 'close', close FROM bars),
        sp AS (SELECT code, date, f, list(x ORDER BY x) AS v FROM cells JOIN dd USING (code, date) GROUP BY code, date, f)"""),
    "deviation_profile": sql("SELECT code, count(*) AS days, round(avg(d), 4) AS mean_dev, round(max(d), 4) AS max_dev, round(stddev_pop(d), 4) AS std_dev, stddev_pop(d) < 0.02 AS ok FROM (SELECT a.code, abs(b.close - a.close) / abs(a.close) AS d FROM bars a JOIN bars b ON a.code = b.code AND a.date = b.date WHERE a.source = 'click' AND b.source = 'view' AND a.close <> 0) GROUP BY code"),
    "reconcile_sources": sql("SELECT code, count(*) FILTER (l AND r) AS matched, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only, count(*) FILTER (d1 OR d2 OR d3 OR d4 OR d5) AS mismatched FROM rec GROUP BY code", RECON),
    "reconcile_fields": sql("SELECT code, f AS field, count(*) AS mismatches FROM (SELECT code, unnest(['open', 'high', 'low', 'close', 'volume']) AS f, unnest([d1, d2, d3, d4, d5]) AS d FROM rec) WHERE d GROUP BY code, f", RECON),
    "calendar_gaps": sql("""SELECT s.code, coalesce(holes, 0) AS holes, coalesce(lag, 0) AS lag, coalesce(holes, 0) = 0 AND coalesce(lag, 0) = 0 AS complete FROM s LEFT JOIN
        (SELECT code, count(*) FILTER (date < hi) AS holes, count(*) FILTER (date > hi) AS lag FROM (SELECT s.code, s.hi, c.date FROM s JOIN calendar c ON c.is_trading_day AND c.date >= s.lo WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.source = 'click' AND b.code = s.code AND b.date = c.date)) GROUP BY code) g USING (code)""",
        "s AS (SELECT code, min(date) AS lo, max(date) AS hi FROM bars WHERE source = 'click' GROUP BY code)"),
    "next_session": sql("SELECT date, next_date FROM nexts"),
    "daily_returns": sql("SELECT code, source, date, ret FROM rets", RETURNS),
    "return_agreement": sql("SELECT code, count(*) AS days, round(max(abs(a - b)), 3) AS max_diff, round(max(abs(a - b)), 3) < 0.01 AS agree FROM (SELECT x.code, x.ret AS a, y.ret AS b, row_number() OVER (PARTITION BY x.code ORDER BY x.date DESC) AS rn FROM rets x JOIN rets y ON x.code = y.code AND x.date = y.date WHERE x.source = 'click' AND y.source = 'view') WHERE rn <= 8 GROUP BY code", RETURNS),
    "latest_n_per_source": sql("SELECT code, source, rn AS rank, date, round(close, 2) AS close FROM (SELECT *, row_number() OVER (PARTITION BY code, source ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 3"),
    "normalize_symbol": sql("SELECT p_partkey, raw, code FROM normal"),
    "symbol_forms": sql("SELECT p_partkey, substr(code, 1, 6) AS digits, lower(substr(code, 8, 2)) || substr(code, 1, 6) AS prefixed, lower(substr(code, 8, 2)) || '.' || substr(code, 1, 6) AS dotted FROM normal WHERE code IS NOT NULL"),
    "is_index_or_etf": sql("SELECT p_partkey, substr(code, 1, 2) IN ('15', '16', '51', '58') OR (code LIKE '000%' AND code LIKE '%.SH') OR (code LIKE '399%' AND code LIKE '%.SZ') AS index_or_etf, code LIKE '399%' OR (code LIKE '000%' AND code LIKE '%.SH') AS is_index FROM normal WHERE code IS NOT NULL"),
    "market_symbol": sql("SELECT p_partkey, CASE WHEN regexp_matches(x, '^(sh|sz|bj)[0-9]{6}$') THEN substr(x, 3) || '.' || upper(substr(x, 1, 2)) END AS code FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN raw WHEN 1 THEN 'bj' || trim(raw) ELSE 'bj' || substr(raw, 1, 6) END AS x FROM raw_codes)"),
    "board": sql("""SELECT p_partkey, CASE WHEN t IN ('300', '301') THEN 'CHINEXT' WHEN t IN ('688', '689') THEN 'STAR' ELSE 'MAIN' END AS context, CASE WHEN t IN ('300', '301') THEN 'CHINEXT' WHEN t IN ('688', '689') THEN 'STAR' WHEN regexp_matches(code, '^(4|8|92)') THEN 'BSE' ELSE 'MAIN' END AS export
        FROM (SELECT p_partkey, code, substr(code, 1, 3) AS t FROM normal WHERE code IS NOT NULL)"""),
    "distinct_codes": sql("SELECT DISTINCT code FROM normal WHERE code IS NOT NULL"),
    "latest_finalized_date": sql("SELECT event_id, CASE WHEN hour(local_ts) >= 16 THEN date ELSE date - 1 END AS latest, DATE '2024-01-15' <= CASE WHEN hour(local_ts) >= 16 THEN date ELSE date - 1 END AS is_final FROM ticks"),
    "observation_phase": sql("SELECT event_id, p AS phase, CASE WHEN p = 'pre_open' THEN local_ts END AS decision_available_at, CASE WHEN p = 'post_close' THEN local_ts END AS outcome_observed_at, CASE WHEN p = 'post_close' THEN local_ts END AS finalized_at FROM (SELECT *, CASE WHEN t >= TIME '08:30:00' AND t < TIME '09:25:00' THEN 'pre_open' WHEN t >= TIME '15:00:00' THEN 'post_close' END AS p FROM (SELECT *, CAST(local_ts AS TIME) AS t FROM ticks))"),
    "capture_admissible": sql("SELECT event_id, isodow(d) < 6 AND d = date AS admissible FROM (SELECT *, date - CAST(event_id % 2 AS INTEGER) AS d FROM ticks)"),
    "price_availability": sql("""SELECT receipt_id, CASE WHEN CAST(o AS DATE) < date OR (CAST(o AS DATE) = date AND CAST(o AS TIME) < TIME '15:00:00') THEN 'availability_precedes_finalization' WHEN CAST(o AS DATE) = date THEN NULL
        WHEN next_date IS NULL THEN 'unknown_next_session' WHEN CAST(o AS DATE) <> next_date OR CAST(o AS TIME) >= TIME '09:25:00' THEN 'post_hoc_availability' END AS error
        FROM (SELECT b.receipt_id, b.date, r.observed_at AS o, n.next_date FROM bars b JOIN receipts r USING (receipt_id) LEFT JOIN nexts n ON n.date = b.date)"""),
    "execution_cutoff": sql("SELECT receipt_id, kind, CAST(observed_at AS DATE) < date OR (CAST(observed_at AS DATE) = date AND CAST(observed_at AS TIME) <= CASE WHEN kind LIKE '%_prices' THEN TIME '15:05:00' ELSE TIME '09:25:00' END) AS ok FROM bars JOIN receipts USING (receipt_id), (SELECT unnest(['execution_prices', 'signal_prices', 'market_rules']) AS kind)"),
    "record_sha256": sql("SELECT receipt_id, sha256(" + RECORD + ") AS record_sha256 FROM bars"),
    "field_validity": sql("SELECT receipt_id, coalesce(len(response_sha256) = 64, false) AS sha_ok, receipt_id % 6 = 0 AS entry_ok, receipt_id % 6 IN (0, 4) AS stamp_ok FROM receipts"),
    "legacy_identity": sql("SELECT receipt_id, CASE WHEN receipt_id % 3 = 0 THEN 'legacy_unknown' ELSE source END AS source, CASE WHEN receipt_id % 5 = 0 THEN 'unknown' ELSE adjustment_mode END AS adjustment_mode, adjustment_version, CASE WHEN receipt_id % 4 = 1 THEN '2024-01-01' ELSE '2024-03-01' END AS retrieved_at, receipt_id % 2 = 1 OR is_final AS is_final FROM bars"),
    "bars_with_receipts": sql("SELECT b.code, b.date, b.source, b.receipt_id, r.source AS receipt_source, r.response_sha256, r.observed_at FROM bars b LEFT JOIN receipts r USING (receipt_id)"),
    "panel_select": sql(f"SELECT {BAR} FROM bars b WHERE {CLICK} AND EXISTS (SELECT 1 FROM panel p WHERE p.code = b.code AND p.date = b.date)"),
    "panel_missing": sql(f"SELECT code, date FROM panel p WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE {CLICK} AND b.code = p.code AND b.date = p.date)"),
    "panel_digest": sql("SELECT sha256('[\"' || string_agg(e, '\",\"' ORDER BY e) || '\"]') AS digest, count(*) AS entries FROM (SELECT DISTINCT code || '@' || CAST(date AS VARCHAR) AS e FROM panel)"),
    "content_digest": sql(root_of("g"), "g AS (SELECT sha256(" + RECORD + ") AS d FROM bars WHERE is_final)"),
    "calendar_spine": sql("SELECT s.date, coalesce(n, 0) AS times FROM calendar s LEFT JOIN (SELECT date, count(*) AS n FROM (SELECT DISTINCT date FROM bars WHERE source = 'click' UNION ALL SELECT DISTINCT date FROM bars WHERE source = 'view' AND day(date) % 7 = 0) GROUP BY date) USING (date) WHERE coalesce(n, 0) <> 1"),
    "date_set_ops": sql("SELECT 'common' AS side, code, date FROM (SELECT code, date FROM bars WHERE source = 'click' INTERSECT SELECT code, date FROM bars WHERE source = 'view') UNION ALL SELECT 'only_left', code, date FROM (SELECT code, date FROM bars WHERE source = 'click' EXCEPT SELECT code, date FROM bars WHERE source = 'view') UNION ALL SELECT 'only_right', code, date FROM (SELECT code, date FROM bars WHERE source = 'view' EXCEPT SELECT code, date FROM bars WHERE source = 'click')"),
    "same_set": sql("SELECT 'left' AS side, code FROM (SELECT DISTINCT code FROM coverage EXCEPT SELECT DISTINCT code FROM panel) UNION ALL SELECT 'right', code FROM (SELECT DISTINCT code FROM panel EXCEPT SELECT DISTINCT code FROM coverage)"),
    "price_readiness": sql("""SELECT blocker, count(DISTINCT sample) AS count, array_to_string(list_slice(list_sort(list(DISTINCT sample)), 1, 5), ',') AS examples FROM f GROUP BY blocker""", f"""
        sel AS (SELECT b.*, b.code || '@' || CAST(b.date AS VARCHAR) AS sample, r.receipt_id AS rid, r.source AS rsource, r.payload, r.response_sha256 AS sha, r.observed_at AS o, r.retrieved_at AS t FROM bars b JOIN panel p USING (code, date) LEFT JOIN receipts r USING (receipt_id) WHERE b.{CLICK}),
        nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM sel)),
        av AS (SELECT sel.*, CASE WHEN CAST(o AS DATE) < sel.date OR (CAST(o AS DATE) = sel.date AND CAST(o AS TIME) < TIME '15:00:00') THEN 'availability_precedes_finalization' WHEN CAST(o AS DATE) = sel.date THEN NULL WHEN nd IS NULL THEN 'unknown_next_session' WHEN CAST(o AS DATE) <> nd OR CAST(o AS TIME) >= TIME '09:25:00' THEN 'post_hoc_availability' END AS late FROM sel JOIN nx ON nx.date = sel.date),
        f AS (SELECT 'missing_panel_rows' AS blocker, code || '@' || CAST(date AS VARCHAR) AS sample FROM panel p WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.code = p.code AND sel.date = p.date)
          UNION ALL SELECT 'no_selected_rows', 'panel' WHERE NOT EXISTS (SELECT 1 FROM sel)
          UNION ALL SELECT 'non_final_rows', sample FROM av WHERE NOT is_final UNION ALL SELECT 'missing_receipts', sample FROM av WHERE payload IS NULL
          UNION ALL SELECT 'receipt_source_mismatch', sample FROM av WHERE payload IS NOT NULL AND rsource IS DISTINCT FROM source UNION ALL SELECT 'receipt_hash_mismatch', sample FROM av WHERE payload IS NOT NULL AND sha IS DISTINCT FROM sha256(payload)
          UNION ALL SELECT 'receipt_response_mismatch', sample FROM av WHERE sha = sha256(payload) AND NOT {COVERS}
          UNION ALL SELECT 'receipt_timestamp_mismatch', sample FROM av WHERE payload IS NOT NULL AND o <> t UNION ALL SELECT 'invalid_availability_timestamp', sample FROM av WHERE payload IS NOT NULL AND (o IS NULL OR t IS NULL)
          UNION ALL SELECT late, sample FROM av WHERE payload IS NOT NULL AND t IS NOT NULL AND late IS NOT NULL)"""),
    "receipt_covers_bar": sql(f"SELECT receipt_id, {COVERS} AS covers FROM bars LEFT JOIN (SELECT receipt_id, payload FROM receipts) USING (receipt_id)"),
    "get_history": sql(f"SELECT code, date, close, is_final FROM (SELECT code, date, close, is_final FROM bars b WHERE {CLICK} AND NOT EXISTS (SELECT 1 FROM quotes q WHERE q.code = b.code AND q.date = b.date) UNION ALL SELECT code, date, price, false FROM quotes WHERE date <= DATE '2024-02-10') WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-02-10'"),
    "cross_check": sql("SELECT c.code, c.date, round(m, 4) AS consensus, n AS n_sources, coalesce(o, '') AS outliers, o IS NULL AS agreement, CASE WHEN q.price IS NOT NULL AND m <> 0 THEN abs(q.price - m) / abs(m) <= 0.01 END AS realtime_match FROM cons c LEFT JOIN quotes q ON q.code = c.code AND q.date = c.date",
        "two AS (SELECT * FROM bars WHERE source IN ('click', 'view') AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-31'), " + MEDIANS.replace("FROM bars", "FROM two")),
}
