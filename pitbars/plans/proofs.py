"""Queries of landing, context, action, authority and artifact operators, with their SQL. Defects are planted by day and code number."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.functions.digest import money
from pitbars.operators import actions, artifacts, authority, context, evidence, panels, store
from pitbars.plans.oracle import CLICK, root_of, sql
from pitbars.shared import shared_dir, written
from pitbars.sources import landing
from pitbars.sources import views as v

SHA = "a" * 64
PLAN = "每股1.5元 😀"


def _click(s, d):
    return v.bars(s, d).where(CLICK)


def _n():
    return F.substring("code", 2, 5).cast("int")


def _at(hour: int, minute: int = 0):
    return F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))


def land_tick_frame(s, d):
    frame = _click(s, d).select("code", F.concat(F.col("date").cast("string"), F.lit(" 15:00")).alias("datetime"), "open", "high", "low", "close", F.when(F.col("receipt_id") % 2 == 0, F.col("volume")).alias("volume"), F.when(F.col("receipt_id") % 3 == 0, F.col("volume") + 1).alias("vol"))
    return landing.land_tick_frame(frame)


def land_panel(s, d):
    p = v.panel(s, d).groupBy("date").agg(F.collect_list(F.concat(F.substring("code", 1, 6), F.lit("@"), F.col("date").cast("string"))).alias("e"))
    text = F.when(F.day("date") % 3 == 0, F.to_json("e")).when(F.day("date") % 3 == 1, F.to_json(F.struct(F.col("e").alias("panel")))).otherwise(F.to_json(F.struct(F.struct(F.col("e").alias("search-validation")).alias("splits"))))
    return landing.land_panel(p.select(text.alias("payload")))


def _captures(s, d, held=None):
    """A receipt for each day and phase with that day's market, in two pages; days with defects: 7 digest, 5 hour, 11 count, 12 a page that
    is no list of rows, 16 a response that is no JSON."""
    row = F.struct(F.lower(F.concat(F.substring("code", 8, 2), F.substring("code", 1, 6))).alias("symbol"), F.when(_n() % 5 == 0, F.concat(F.lit("*ST "), "code")).otherwise(F.concat(F.lit("Co "), F.substring("code", 1, 6))).alias("name"), money(F.col("close")).alias("trade"), F.col("volume").cast("string").alias("volume"))
    day = F.day("date")
    body = (held or v.bars(s, d)).where(CLICK).groupBy("date").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("phase", F.explode(F.array(F.lit("pre_open"), F.lit("post_close"))))
    half = F.ceil(F.size("rows") / 2).cast("int")
    pages = F.array(F.to_json(F.slice("rows", F.lit(1), half)), F.when(day == 12, '{"rows":[]}').otherwise(F.to_json(F.slice("rows", half + 1, F.size("rows")))))
    response = F.when(day == 16, "<html>busy</html>").otherwise(F.to_json(F.struct((F.size("rows") + F.when(day == 11, 1).otherwise(0)).alias("advertised_count"), pages.alias("raw_pages"))))
    early = F.col("phase") == "pre_open"
    out = body.select("date", "phase", (F.dayofyear("date") * 2 + F.when(early, 0).otherwise(1)).cast("long").alias("receipt_id"), F.lit("m").alias("source"), response.alias("response"), F.when(day == 5, F.when(early, _at(10)).otherwise(_at(14))).when(early, _at(9, 5)).otherwise(_at(16)).alias("observed_at"))
    return out.withColumn("response_sha256", F.when(day == 7, "bad").otherwise(F.sha2("response", 256)))


def land_market_pages(s, d):
    return landing.land_market_pages(_captures(s, d).select("receipt_id", "response"))[0]


def market_page_rejects(s, d):
    return landing.land_market_pages(_captures(s, d).select("receipt_id", "response"))[1]


def _context(s, d, held=None):
    """Stored rows; codes with defects: 17 flags, 13 membership, 19 universe (on day 9)."""
    held = held or v.bars(s, d)
    r = written(_captures(s, d, held), "captures")
    early = F.col("phase") == "pre_open"
    key = r.select("date", "phase", "source", "receipt_id")
    rows = held.where(CLICK).select("code", "date", "close", "volume").join(key, "date")
    name = F.when(_n() % 5 == 0, F.concat(F.lit("*ST "), "code")).otherwise(F.concat(F.lit("Co "), F.substring("code", 1, 6)))
    held = actions.status_values(rows.withColumns({"name": name, "trade": money(F.col("close")).cast("double"), "volume": F.col("volume").cast("double")}))
    status = held.select("code", "date", "phase", "source", "receipt_id", "name", F.lit("listed").alias("listing_status"), "board", (F.col("is_st") != (_n() % 17 == 0)).alias("is_st"), "is_suspended")
    universe = rows.where(~((_n() % 19 == 0) & (F.day("date") == 9))).select("code", "date", "phase", "source", "receipt_id", (_n() % 13 != 0).alias("is_member"))
    phases = r.select("date", "phase", "source", "receipt_id", F.when(early, F.col("observed_at")).alias("decision_available_at"), F.when(~early, F.col("observed_at")).alias("outcome_observed_at"), F.when(~early, F.col("observed_at")).alias("finalized_at"))
    return status, universe, phases, r.select("receipt_id", "source", "response", "response_sha256", "observed_at")


def context_rows(s, d):
    return context.context_rows(*_context(s, d), "m").select("code", "date", "phase", "receipt_id", "is_member", "observed_at")


def context_readiness(s, d, held=None):
    held = held or written(v.bars(s, d), "bars")
    return context.context_readiness(*_context(s, d, held), v.panel(s, d, held), "m")


def _coverage(s, d, held=None):
    """Action coverage of every panel cell from one receipt for each day; days with defects: 7 digest, 5 hour, 9 request, 12 a row that is too
    wide, 16 a response that is no JSON; code number 11 miscounts."""
    ends = F.struct(F.lit(2024).alias("year"), F.array(F.lit("dividOperateDate"), F.lit("dividPlanAnnounceDate"), F.lit("cash"), F.lit("plan")).alias("fields"), F.when(_n() % 3 == 0, F.array(F.array(F.col("date").cast("string"), F.date_sub("date", 9).cast("string"), F.lit("1.5"), F.lit(PLAN)))).otherwise(F.array().cast("array<array<string>>")).alias("rows"))
    p = v.panel(s, d, held)
    day = F.day("date")
    body = p.groupBy("date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("code"), F.array(ends).alias("b"))))).alias("symbols"), F.array_sort(F.collect_list("code")).alias("codes"))
    year = F.year("date") + F.when(day == 9, 1).otherwise(0)
    r = body.select("date", F.dayofyear("date").cast("long").alias("receipt_id"), F.lit("a").alias("source"), F.to_json(F.struct(F.col("date").cast("string").alias("observation_date"), F.col("codes").alias("symbols"), F.array(year - 1, year).alias("years"))).alias("request"), F.when(day == 16, "junk").otherwise(F.replace(F.to_json(F.struct("symbols")), F.lit('"1.5"'), F.when(day == 12, '"1.5","x"').otherwise('"1.5"'))).alias("response"), F.when(day == 5, _at(9, 25)).otherwise(_at(9)).alias("observed_at"))
    r = r.withColumn("response_sha256", F.when(day == 7, "bad").otherwise(F.sha2("response", 256)))
    cover = p.join(r.select("date", "receipt_id", "source", F.col("observed_at").alias("available_at")), "date").withColumn("event_count", (F.when(_n() % 3 == 0, 1).otherwise(0) + F.when(_n() % 11 == 0, 1).otherwise(0)).cast("long"))
    return cover, r.drop("date")


def land_action_batches(s, d):
    return landing.land_action_batches(_coverage(s, d)[1].select("receipt_id", "response"))[0].select("receipt_id", "code", "event_id", "effective_date", "announcement_date")


def action_batch_rejects(s, d):
    return landing.land_action_batches(_coverage(s, d)[1].select("receipt_id", "response"))[1]


def _events(cover, judged):
    """Stored events; those of code number 39 are lost."""
    found = landing.action_events(judged).where("event_id is not null")
    return found.join(cover.select("receipt_id", "code", "date", "source", "available_at"), ["receipt_id", "code"]).where(_n() % 39 != 0)


def coverage_with_receipts(s, d):
    return context.coverage_with_receipts(*_coverage(s, d), "a").select("code", "date", "receipt_id", "event_count", "observed_at")


def events_match(s, d):
    cover, r = _coverage(s, d)
    judged = landing.judge_action_batches(r)
    return context.events_match_receipts(cover.select("code", "date", "receipt_id", "event_count", "available_at"), _events(cover, judged), judged).select("code", "date", "same")


def action_readiness(s, d, held=None):
    held = held or written(v.bars(s, d), "bars")
    cover, r = (written(x, "coverage") for x in _coverage(s, d, held))
    return context.action_readiness(cover, written(_events(cover, landing.judge_action_batches(r)), "events"), r, v.panel(s, d, held), "a")


def full_readiness(s, d):
    held = written(v.bars(s, d), "bars")
    prices = written(evidence.price_readiness(held.where(CLICK), v.receipts(s, d, held), v.panel(s, d, held), unobserved_end=True), "prices")
    return context.full_readiness(prices, prices, context_readiness(s, d, held), action_readiness(s, d, held), "raw")


def _records(s, d):
    """A universe record for each panel cell; cells with defects by receipt number."""
    n = _n() + F.day("date")
    payload = F.when(n % 11 == 0, F.lit('{"is_member":"yes","universe_id":"' + SHA + '"}')).otherwise(F.lit('{"is_member":true,"universe_id":"' + SHA + '"}'))
    receipt = F.sha2(F.concat_ws("@", "code", F.col("date").cast("string")), 256)
    return v.panel(s, d).select(F.lit("universe").alias("component"), evidence.cell().alias("panel_entry"), payload.alias("payload"), F.when(n % 7 == 0, SHA).otherwise(F.sha2(payload, 256)).alias("record_sha256"), F.array(receipt).alias("source_receipt_ids"), F.when(n % 13 == 0, _at(30)).otherwise(_at(9)).alias("effective_at"), F.when(n % 5 == 0, _at(9, 25)).otherwise(_at(8)).alias("available_at"), n.alias("n"))


def _bindings(s, d):
    r = _records(s, d).where("n % 17 <> 0")
    return r.select(r["source_receipt_ids"][0].alias("receipt"), "component", "panel_entry", F.when(F.col("n") % 19 == 0, "x").otherwise(F.col("record_sha256")).alias("record_sha256"), (F.col("available_at") - F.make_dt_interval(mins=F.lit(30))).alias("available_at"))


def _cutoffs(s, d):
    return v.panel(s, d).select(evidence.cell().alias("panel_entry"), _at(9, 25).alias("cutoff_at"))


def _sealed(s, d):
    rows = [("universe", "2024-01-01 09:00:00", "k1", "R"), ("market_rules", "2024-01-01 09:00:00", "k1", "R")]
    return s.createDataFrame(rows, "component string, available_at string, signer string, root string").withColumn("available_at", F.col("available_at").cast("timestamp_ntz"))


def _signers(s):
    return s.createDataFrame([("k0", "R", ["universe", "market_rules"]), ("k1", "R", ["universe"])], "signer string, root string, roles array<string>").withColumns({"valid_from": F.lit("2024-01-01").cast("timestamp_ntz"), "valid_until": F.lit("2024-01-20").cast("timestamp_ntz")})


#: A sound payload and an unsound one of each component.
PAYLOADS = {
    "corporate_actions": ('{"events":[]}', '{"events":{}}'),
    "instrument_status": ('{"is_st":false,"is_suspended":true,"listing_status":"listed"}', '{"is_st":false,"is_suspended":true,"listing_status":"x"}'),
    "market_rules": ('{"board":"MAIN","lot_size":100,"price_limit_policy_id":"' + SHA + '","t_plus_one":true}', '{"board":"MAIN","lot_size":0,"price_limit_policy_id":"' + SHA + '","t_plus_one":true}'),
    "trading_calendar": ('{"decision_cutoff_at":"2024-01-02T09:25:00+08:00","is_trading_day":true}', '{"decision_cutoff_at":"2024-01-02T09:25:00+08:00","is_trading_day":"true"}'),
    "universe": ('{"is_member":true,"universe_id":"' + SHA + '"}', '{"is_member":true,"universe_id":"' + SHA + '","more":1}'),
}


def payload_validity(s, d):
    """Every cell under every component; of the k-th component, cells whose number and k add up to a multiple of 11 are unsound."""
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("component"), F.lit(good).alias("good"), F.lit(bad).alias("bad")) for k, (c, (good, bad)) in enumerate(PAYLOADS.items())))
    rows = v.panel(s, d).select(evidence.cell().alias("panel_entry"), (_n() + F.day("date")).alias("n"), F.explode(kinds).alias("x")).select("panel_entry", "n", "x.*")
    payload = F.when((F.col("n") + F.col("k")) % 11 == 0, F.col("bad")).otherwise(F.col("good"))
    return rows.select("panel_entry", "component", authority.payload_valid(F.col("component"), payload).alias("valid"))


def receipt_bindings(s, d):
    return authority.receipt_bindings(_records(s, d), _bindings(s, d))


def latest_available(s, d):
    """The record decides, its receipt (by an hour, number 3) or the envelope."""
    records = _records(s, d)
    bindings = records.select(records["source_receipt_ids"][0].alias("receipt"), (F.col("available_at") + F.when(_number() % 3 == 0, F.make_dt_interval(hours=F.lit(1))).otherwise(F.make_dt_interval(hours=F.lit(-1)))).alias("available_at"))
    return authority.latest_available(records, bindings, _sealed(s, d))


def _number():
    """The number of a cell from its panel entry."""
    return F.substring("panel_entry", 2, 5).cast("int") + F.day(F.element_at(F.split("panel_entry", "@"), -1).cast("date"))


def blockers(s, d):
    """Three blockers over the click bars; a sample that two rows give counts once."""
    rows = _click(s, d).unionByName(_click(s, d).where("day(date) = 4"))
    checks = {"odd_code": _n() % 2 == 1, "not_final": ~F.col("is_final"), "fourth_day": F.day("date") == 4, "never": F.lit(False)}
    return evidence.blockers(evidence.failures(rows, checks, evidence.cell()))


def cutoff_check(s, d):
    return authority.cutoff_check(_records(s, d), _cutoffs(s, d))


def admit_component(s, d):
    records = _records(s, d)
    both = records.unionByName(records.withColumn("component", F.lit("market_rules")))  # the signer of its envelope has no such role
    return authority.admit_component(both, _bindings(s, d), _sealed(s, d), _cutoffs(s, d), v.panel(s, d).select(evidence.cell().alias("panel_entry")), _signers(s), s.createDataFrame([("R",)], "root string"))


def signer_interval(s, d):
    r = v.receipts(s, d).where("observed_at is not null").select("receipt_id", F.concat(F.lit("k"), F.col("receipt_id") % 3).alias("signer"), F.lit("R").alias("root"), F.when(F.col("receipt_id") % 2 == 0, "universe").otherwise("market_rules").alias("component"), F.col("observed_at").alias("available_at"))
    signers = s.createDataFrame([("k0", "R", ["universe", "market_rules"]), ("k1", "R", ["universe"])], "signer string, root string, roles array<string>").withColumns({"valid_from": F.lit("2024-01-05").cast("timestamp_ntz"), "valid_until": F.lit("2024-01-20").cast("timestamp_ntz")})
    return authority.signer_interval(r, signers, s.createDataFrame([("R",)], "root string")).select("receipt_id", "problem")


def bootstrap_rows(s, d):
    p = v.panel(s, d)
    status, _ = actions.land_status_frames(p.withColumn("paused", (F.day("date") % 5 == 0).cast("int")))
    return artifacts.bootstrap_rows(_click(s, d).select("code", "date").unionByName(p.select("code", "date")), status, p, 10**9)


def availability_records(s, d):
    """Records of all components but those of the calendar on day 9, with defects by number: 7 cutoff of its own, 5 at the cutoff, 3 after it, 17 unbound."""
    cells = v.panel(s, d).select("code", "date", F.explode(F.array(*map(F.lit, panels.COMPONENTS))).alias("component"), (_n() + F.day("date")).alias("n")).where("not (component = 'trading_calendar' and day(date) = 9)")
    records = cells.select("component", evidence.cell().alias("panel_entry"), F.sha2(F.concat_ws("@", "component", "code"), 256).alias("record_sha256"), F.array(F.sha2("code", 256)).alias("source_receipt_ids"), _at(9).alias("effective_at"),
        F.when(F.col("n") % 5 == 0, _at(9, 25)).when(F.col("n") % 3 == 0, _at(9, 26)).otherwise(_at(8)).alias("available_at"), F.when(F.col("n") % 7 == 0, _at(9, 30)).otherwise(_at(9, 25)).alias("decision_cutoff_at"))
    bound = v.panel(s, d).where(_n() % 17 != 0).select(F.sha2("code", 256).alias("receipt")).distinct()
    return authority.availability_records(records, v.panel(s, d), _cutoffs(s, d), bound)


def adjustment_identity(s, d):
    k = F.col("c_custkey")
    role = F.when(k % 2 == 0, "execution").otherwise("signal")
    parts = {"schema_version": F.concat(role, F.lit("-adjustment-identity/1")), "price_role": F.when(k % 7 == 0, "other").otherwise(role), "source": F.concat(F.lit("源 "), "c_name"), "adjustment_mode": F.when(k % 3 == 0, "qfq").otherwise("raw"), "adjustment_version": F.when(k % 11 == 0, "").otherwise("v1")}
    rows = v.table(s, d, "customer").select("c_custkey", role.alias("role"), F.to_json(F.struct(*(c.alias(n) for n, c in parts.items()))).alias("identity"))
    return rows.select("c_custkey", authority.adjustment_identity(F.col("identity"), F.col("role")).alias("digest"))


def closure_digest(s, d):
    """A contract for each customer with its orders as receipts; those of number 7 lack the panel, those of 5 name each receipt twice."""
    c, o = v.table(s, d, "customer"), v.table(s, d, "orders")
    single = c.select(F.col("c_custkey").alias("bundle"), F.explode(F.array(*map(F.lit, authority.SINGLE))).alias("field")).where("not (bundle % 7 = 0 and field = 'exact_panel')").select("bundle", "field", F.concat(F.lit("data-"), "field").alias("kind"), F.sha2(F.concat_ws("|", "bundle", "field"), 256).alias("identifier"), F.concat("field", F.lit("/1")).alias("schema_version"))
    receipts = o.select(F.col("o_custkey").alias("bundle"), F.lit("source_receipts").alias("field"), F.lit("source-receipt").alias("kind"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("identifier"), F.lit("receipt/1").alias("schema_version")).join(c.select(F.col("c_custkey").alias("bundle")), "bundle", "left_semi")
    return authority.closure_digest(single.unionByName(receipts).unionByName(receipts.where("bundle % 5 = 0")), "contract/1", "owner")


def report_consistency(s, d):
    """A bundle for each customer; by number: 3 blocked, 5 blocked without a reason, 7 an aggregate that says otherwise, 11 a component short."""
    c = v.table(s, d, "customer").select(F.col("c_custkey").alias("bundle"))
    k, none = F.col("bundle"), F.array().cast("array<string>")
    down = (k % 3 == 0) & (F.col("component") == "universe")
    components = c.select("bundle", F.explode(F.array(*map(F.lit, authority.REQUIRED))).alias("component")).where(~((k % 11 == 0) & (F.col("component") == "market_rules")))
    components = components.select("bundle", "component", (~down).alias("ready"), F.when(down & (k % 5 != 0), F.array(F.lit("x"))).otherwise(none).alias("blockers"))
    says = (k % 3 != 0) != (k % 7 == 0)
    return authority.report_consistency(components, c.select("bundle", says.alias("ready"), F.when(k % 3 == 0, F.array(F.lit("universe"))).otherwise(none).alias("blocked")))


def register_panel(s, d):
    """A registration of two codes and two sessions for each customer; by number: 3 another order of cells, 5 a repeated code, 7 a Saturday."""
    k = F.col("c_custkey")
    code = lambda n: F.concat(F.lpad((n % 1000000).cast("string"), 6, "0"), F.lit(".SZ"))
    symbols = F.array(code(k), code(F.when(k % 5 == 0, k).otherwise(k + 1)))
    sessions = F.array(F.when(k % 7 == 0, "2024-01-06").otherwise("2024-01-03"), F.lit("2024-01-08"))
    cells = F.array_sort(F.flatten(F.transform(symbols, lambda x: F.transform(sessions, lambda y: F.concat_ws("@", x, y)))))
    text = F.concat(F.lit('["'), F.array_join(F.when(k % 3 == 0, F.reverse(cells)).otherwise(cells), '","'), F.lit('"]'))
    fixed = {"status": "AWAITING_FULL_SNAPSHOT_READINESS", "adjustment_mode": "raw", "source": "s", "adjustment_version": "v", "outcome_feedback_used": False, "workspace_count": 4}
    rows = v.table(s, d, "customer").select(k.alias("id"), symbols.alias("symbols"), sessions.alias("sessions"), *(F.lit(x).alias(n) for n, x in fixed.items()), F.sha2(text, 256).alias("panel_sha256"))
    return authority.register_panel_check(rows, "2024-01-08", 2, 2)


def _root(s):
    return f"{shared_dir(s)}/artifacts-{uuid4().hex}"


def verify_snapshot(s, d):
    """A snapshot of final bars, of which codes of bucket 3 get another price and those of bucket 5 are lost: parts that are not what was written."""
    root = _root(s)
    name = artifacts.write_snapshot(_click(s, d), root, "2024-01-20", "raw")
    for part in ("3", "5"):
        folder = f"{root}/{name}/rows/part_year=2024/part_bucket={part}"
        if artifacts.exists(s, folder):
            rows = written(s.read.parquet(folder), "part")
            (rows.withColumn("close", F.col("close") + 1) if part == "3" else rows.limit(0)).write.mode("overwrite").parquet(folder)
    return artifacts.part_problems(s, root, name, changed_only=True)


def research_manifest(s, d):
    """A history and a calendar as research artifacts, as the inventory has them."""
    root = _root(s)
    rows = _click(s, d).select("code", F.col("date").cast("string").alias("date"), money(F.col("close")).alias("close"))
    for kind, x in (("history", rows), ("calendar", v.sessions(s, d).select(F.col("date").cast("string").alias("date")))):
        artifacts.write_research_artifact(kind, x, root, kind)
    return artifacts.artifact_inventory(s, root)


def export_panel(s, d):
    """The six artifacts of all final cells of one session, each with its receipt, written, and verified as they lie there."""
    root, day = _root(s), "2024-01-10"
    held = written(_click(s, d).where(F.col("is_final") & (F.col("date") == F.lit(day).cast("date"))), "bars")
    text = F.to_json(F.struct(F.lit("date,open,high,low,close,volume").alias("fields"), F.array(F.array(F.col("date").cast("string"), *(money(F.col(c)) for c in ("open", "high", "low", "close")), F.col("volume").cast("string"))).alias("rows")))
    receipts = held.select("receipt_id", "source", _at(15, 30).alias("observed_at"), _at(15, 30).alias("retrieved_at"), text.alias("payload"), F.sha2(text, 256).alias("response_sha256"))
    cells = held.select("code", "date")
    listings = cells.select("code", F.when(_n() % 4 == 0, F.lit("2024-02-01")).otherwise(F.lit("2020-01-01")).cast("date").alias("ipo"), F.lit(None).cast("date").alias("out"))
    daily = cells.select("code", "date", (_n() % 5 == 0).alias("is_st"), (_n() % 9 == 0).alias("is_suspended"))
    ends = cells.select("code", F.col("date").alias("effective_date"), F.lit(1.5).alias("cash"), (1 + (_n() % 2) / 2).alias("multiplier"), F.lit("2024-01-02 15:01:00").cast("timestamp_ntz").alias("announced_at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).where(_n() % 3 == 0)
    rules = s.createDataFrame([("fees", "fee_schedule", "{}"), ("limits", "price_limit_and_lot_rules", "{}")], "rule_id string, rule_type string, parameters string")
    six, guards = artifacts.export_execution_panel(held, receipts, cells.unionByName(cells), listings, daily, ends, cells.withColumn("available_at", _at(8)), rules, day, day)
    name = artifacts.write_execution_snapshot(six, s.createDataFrame([("k",)], "key string"), root, day, guards)
    problems = artifacts.verify_execution_snapshot(s, root, name)
    status = s.read.parquet(f"{root}/{name}/instrument_status")
    counted = [s.read.parquet(f"{root}/{name}/{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("row_count")) for kind in artifacts.EXECUTION_KINDS]
    more = [status.where(c).agg(F.lit(n).alias("kind"), F.count("*").alias("row_count")) for n, c in (("unlisted", "listing_status = 'unlisted'"), ("st", "is_st"))]
    return reduce(DataFrame.unionByName, [*counted, *more]).withColumn("problems", F.lit(len(problems)))


def apply_sync(s, d):
    gaps = store.missing_gaps(_click(s, d).select("code").distinct().withColumns({"start_date": F.lit(None).cast("date"), "end_date": F.lit(None).cast("date")}), "2024-01-10", "2024-01-19")
    fetched = _click(s, d).withColumns({"seq": F.col("receipt_id"), "is_final": ~((_n() % 7 == 0) & (F.day("date") == 12)), "adjustment_mode": F.when(_n() % 11 == 0, "qfq")})
    results, _, coverage = store.apply_sync(gaps, fetched, "2024-01-10", "2024-01-19", "2024-01-19", ("click", "raw", "click-v1"))
    return results.join(coverage.select("code", "end_date"), "code", "left")


def execution_manifest(s, d):
    b = _click(s, d).where("is_final").select("code", F.col("date").cast("string").alias("date"), money(F.col("close")).alias("close"))
    return artifacts.execution_manifest(dict.fromkeys(artifacts.EXECUTION_KINDS, b)).select("kind", "row_count", "columns")


QUERIES = {f.__name__: f for f in (land_tick_frame, land_panel, land_market_pages, market_page_rejects, context_rows, context_readiness, land_action_batches, action_batch_rejects, coverage_with_receipts, events_match, action_readiness, full_readiness, payload_validity, blockers, availability_records, adjustment_identity, closure_digest, report_consistency, register_panel, verify_snapshot, research_manifest, export_panel, receipt_bindings, latest_available, cutoff_check, admit_component, signer_interval, bootstrap_rows, apply_sync, execution_manifest)}

N = "CAST(substr(code, 2, 5) AS INTEGER)"
KC = f"k AS (SELECT *, {N} AS n, day(date) AS dy FROM bars WHERE {CLICK})"
CELL = "code || '@' || CAST(date AS VARCHAR)"
#: Blockers from failing samples.
BLOCKED = "SELECT blocker, count(DISTINCT sample) AS count, array_to_string(list_slice(list_sort(list(DISTINCT sample)), 1, 5), ',') AS examples FROM f GROUP BY blocker"
PHASES = "ph AS (SELECT unnest(['pre_open', 'post_close']) AS phase)"
CONTEXT = f"""{KC}, {PHASES}, stored AS (SELECT * FROM k, ph WHERE isodow(date) < 6 AND NOT (n % 19 = 0 AND dy = 9)),
  f AS (SELECT CASE phase WHEN 'pre_open' THEN 'missing_decision_context_rows' ELSE 'missing_finalized_context_rows' END AS blocker, {CELL} AS sample FROM panel p, ph WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.code = p.code AND s.date = p.date)
  UNION ALL SELECT 'invalid_context_receipts', {CELL} || '@' || phase FROM stored WHERE dy IN (5, 7, 11, 12, 16) OR n % 17 = 0 OR n % 13 = 0
  UNION ALL SELECT 'invalid_context_receipts', 'universe@' || CAST(date AS VARCHAR) || '@' || phase FROM k, ph WHERE isodow(date) < 6 AND dy = 9 AND n % 19 = 0)"""
ACTION = f"""p AS (SELECT *, {N} AS n, day(date) AS dy FROM panel),
  f AS (SELECT 'invalid_corporate_action_receipts' AS blocker, {CELL} AS sample FROM p WHERE dy = 7 OR (dy NOT IN (12, 16) AND (n % 11 = 0 OR n % 39 = 0))
  UNION ALL SELECT 'invalid_corporate_action_receipts', 'response@' || CAST(date AS VARCHAR) FROM p WHERE dy IN (12, 16)
  UNION ALL SELECT 'invalid_corporate_action_receipts', 'request@' || CAST(date AS VARCHAR) FROM p WHERE dy = 9
  UNION ALL SELECT 'corporate_actions_outside_preopen_cutoff', {CELL} FROM p WHERE dy = 5)"""
FIXED = lambda *names: "".join(f" UNION ALL SELECT '{x}', 1, ''" for x in names)
CONTEXT_BODY, ACTION_BODY = BLOCKED + FIXED("signed_session_calendar_not_enrolled"), BLOCKED + FIXED("dividend_observation_not_full_corporate_action_ledger", "corporate_action_revisions_not_supported", "corporate_action_publisher_key_not_enrolled")
RECORDS = f"r AS (SELECT {CELL} AS panel_entry, date, {N} + day(date) AS n, CAST(date AS TIMESTAMP) AS t FROM panel)"
EVENT_ID = """sha256('{"cash":"1.5","dividOperateDate":"' || date || '","dividPlanAnnounceDate":"' || (date - 9) || '","plan":"\\u6bcf\\u80a11.5\\u5143 \\ud83d\\ude00"}')"""


def _full() -> str:
    from pitbars.plans.oracle import ORACLE_SQL as base

    nest = lambda statement: f"SELECT * FROM ({statement})"
    parts = {"execution_prices": base["price_readiness"], "signal_prices": base["price_readiness"], **dict.fromkeys(("decision_context", "universe", "instrument_status"), sql(CONTEXT_BODY, CONTEXT)), "corporate_actions": sql(ACTION_BODY, ACTION)}
    rows = [f"SELECT '{name}' AS component, blocker, count, examples FROM ({nest(x)})" for name, x in parts.items()]
    fixed = {"universe": "forward_universe_publisher_key_not_enrolled", "instrument_status": "instrument_status_is_activity_proxy", "trading_calendar": "signed_trading_calendar_not_enrolled", "market_rules": "official_rulebook_bundle_not_enrolled", "availability_records": "complete_component_availability_records_not_bound"}
    return " UNION ALL ".join([*rows, *(f"SELECT '{k}', '{x}', 1, ''" for k, x in fixed.items())])


def _export() -> str:
    kinds = {"execution_prices": "true", "signal_prices": "true", "instrument_status": "true", "universe": "true", "corporate_actions": "n % 3 = 0", "unlisted": "n % 4 = 0", "st": "n % 5 = 0"}
    counts = " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({c}) AS row_count, 0 AS problems FROM p" for k, c in kinds.items())
    return sql(f"{counts} UNION ALL SELECT 'market_rules', 2, 0", f"p AS (SELECT *, {N} AS n FROM bars WHERE {CLICK} AND is_final AND date = DATE '2024-01-10')")


#: CRC-32 of a code's bytes, bit by bit.
CRC_OF_CODE = "xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(range(1, length(code) + 1), lambda i: [ascii(substr(code, i, 1))::UBIGINT + 8589934592] || list_transform(range(8), lambda b: 17179869184::UBIGINT))), lambda c, x: CASE WHEN x < 17179869184 THEN xor(c, x - 8589934592) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END), 4294967295::UBIGINT)"


def _closure() -> str:
    """The canonical JSON of a contract, put together as text."""
    ref = lambda i, kind, schema: f"""'{{"identifier":"' || {i} || '","kind":"{kind}","schema_version":"{schema}"}}'"""
    single = {name: ref(f"sha256(k || '|{name}')", f"data-{name}", f"{name}/1") for name in authority.SINGLE}
    single["exact_panel"] = f"CASE WHEN k % 7 = 0 THEN 'null' ELSE {single['exact_panel']} END"
    required = ",".join(f'"{c}"' for c in authority.REQUIRED)
    values = single | {"repository_owner": "'\"owner\"'", "required_components": f"'[{required}]'", "schema_version": "'\"contract/1\"'", "source_receipts": "'[' || coalesce(list, '') || ']'"}
    body = " || ',' || ".join(f"""'"{name}":' || {values[name]}""" for name in sorted(values))
    return f"""WITH o AS (SELECT o_custkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS i FROM orders), twice AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE k % 5 = 0),
      r AS (SELECT k, string_agg({ref('i', 'source-receipt', 'receipt/1')}, ',' ORDER BY i) AS list, count(*) > 0 AND count(*) = count(DISTINCT i) AS sound FROM twice GROUP BY k), c AS (SELECT c_custkey AS k FROM customer)
      SELECT k AS bundle, sha256('{{' || {body} || '}}') AS digest, k % 7 <> 0 AND coalesce(sound, false) AS complete FROM c LEFT JOIN r USING (k)"""


ORACLE_SQL = {
    "land_tick_frame": sql("SELECT code, date, open, high, low, close, CAST(CASE WHEN receipt_id % 2 = 0 THEN volume WHEN receipt_id % 3 = 0 THEN volume + 1 ELSE 0 END AS DOUBLE) AS volume FROM k", KC),
    "land_panel": sql("SELECT code, date FROM panel"),
    "land_market_pages": sql("SELECT CAST(dayofyear(date) * 2 + CASE phase WHEN 'pre_open' THEN 0 ELSE 1 END AS BIGINT) AS receipt_id, code, CASE WHEN n % 5 = 0 THEN '*ST ' || code ELSE 'Co ' || substr(code, 1, 6) END AS name, CAST(CAST(close AS DECIMAL(18,2)) AS DOUBLE) AS trade, CAST(volume AS DOUBLE) AS volume FROM k, ph WHERE dy NOT IN (11, 12, 16)", f"{KC}, {PHASES}"),
    "market_page_rejects": sql("SELECT DISTINCT CAST(dayofyear(date) * 2 + CASE phase WHEN 'pre_open' THEN 0 ELSE 1 END AS BIGINT) AS receipt_id, CASE dy WHEN 11 THEN 'count_differs' WHEN 12 THEN 'page_not_rows' ELSE 'not_json' END AS reason FROM k, ph WHERE dy IN (11, 12, 16)", f"{KC}, {PHASES}"),
    "action_batch_rejects": sql("SELECT DISTINCT CAST(dayofyear(date) AS BIGINT) AS receipt_id, CASE day(date) WHEN 12 THEN 'row_width' ELSE 'not_json' END AS reason FROM panel WHERE day(date) IN (12, 16)"),
    "context_rows": sql("SELECT code, date, phase, CAST(dayofyear(date) * 2 + CASE phase WHEN 'pre_open' THEN 0 ELSE 1 END AS BIGINT) AS receipt_id, n % 13 <> 0 AS is_member, CAST(date AS TIMESTAMP) + to_minutes(CASE WHEN dy = 5 AND phase = 'pre_open' THEN 600 WHEN dy = 5 THEN 840 WHEN phase = 'pre_open' THEN 545 ELSE 960 END) AS observed_at FROM k, ph WHERE NOT (n % 19 = 0 AND dy = 9)", f"{KC}, {PHASES}"),
    "context_readiness": sql(CONTEXT_BODY, CONTEXT),
    "land_action_batches": sql(f"SELECT CAST(dayofyear(date) AS BIGINT) AS receipt_id, code, CASE WHEN {N} % 3 = 0 THEN {EVENT_ID} END AS event_id, CASE WHEN {N} % 3 = 0 THEN CAST(date AS VARCHAR) END AS effective_date, CASE WHEN {N} % 3 = 0 THEN CAST(date - 9 AS VARCHAR) END AS announcement_date FROM panel WHERE day(date) NOT IN (12, 16)"),
    "coverage_with_receipts": sql(f"SELECT code, date, CAST(dayofyear(date) AS BIGINT) AS receipt_id, CAST(CASE WHEN {N} % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN {N} % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS event_count, CAST(date AS TIMESTAMP) + to_minutes(CASE WHEN day(date) = 5 THEN 565 ELSE 540 END) AS observed_at FROM panel"),
    "events_match": sql(f"SELECT code, date, {N} % 11 <> 0 AND {N} % 39 <> 0 AND day(date) NOT IN (12, 16) AS same FROM panel"),
    "action_readiness": sql(ACTION_BODY, ACTION),
    "full_readiness": _full(),
    "payload_validity": sql("SELECT panel_entry, component, (n + k) % 11 <> 0 AS valid FROM r, p", f"{RECORDS}, p AS (SELECT unnest({list(PAYLOADS)}) AS component, unnest(range(5)) AS k)"),
    "blockers": sql(BLOCKED, f"{KC}, f AS (SELECT 'odd_code' AS blocker, {CELL} AS sample FROM k WHERE n % 2 = 1 UNION ALL SELECT 'not_final', {CELL} FROM k WHERE NOT is_final UNION ALL SELECT 'fourth_day', {CELL} FROM k WHERE dy = 4)"),
    "receipt_bindings": sql("SELECT 'universe' AS component, panel_entry, sha256(panel_entry) AS receipt, CASE WHEN n % 17 = 0 THEN 'unbound_receipt' ELSE 'record_not_bound' END AS problem FROM r WHERE n % 17 = 0 OR n % 19 = 0", RECORDS),
    "latest_available": sql("SELECT 'universe' AS component, panel_entry, greatest(t + to_minutes(CASE WHEN n % 5 = 0 THEN 565 ELSE 480 END + CASE WHEN n % 3 = 0 THEN 60 ELSE 0 END), TIMESTAMP '2024-01-01 09:00:00') AS available_at FROM r", RECORDS),
    "cutoff_check": sql("SELECT 'universe' AS component, panel_entry, n % 5 <> 0 AND n % 13 <> 0 AS in_time FROM r", RECORDS),
    "admit_component": sql("SELECT 'market_rules' AS component, panel_entry, 'role_not_authorized' AS problem FROM r UNION ALL SELECT 'universe' AS component, panel_entry, CASE WHEN n % 11 = 0 THEN 'invalid_payload' WHEN n % 7 = 0 THEN 'record_hash_drifted' WHEN n % 17 = 0 THEN 'unbound_receipt' WHEN n % 19 = 0 THEN 'record_not_bound' WHEN n % 13 = 0 THEN 'effective_date_differs' WHEN n % 5 = 0 THEN 'post_cutoff' END AS problem FROM r", RECORDS),
    "signer_interval": sql("SELECT receipt_id, CASE WHEN receipt_id % 3 = 2 THEN 'unknown_signer' WHEN receipt_id % 3 = 1 AND receipt_id % 2 = 1 THEN 'role_not_authorized' WHEN observed_at < TIMESTAMP '2024-01-05' OR observed_at > TIMESTAMP '2024-01-20' THEN 'outside_authorization' END AS problem FROM receipts WHERE observed_at IS NOT NULL"),
    "bootstrap_rows": sql(f"SELECT 'instrument_status' AS kind, code, date, day(date) % 5 <> 0 AS is_tradable, CASE WHEN day(date) % 5 = 0 THEN 'suspended' ELSE 'active' END AS status, false AS authoritative FROM panel UNION ALL SELECT 'universe', code, date, NULL, NULL, false FROM (SELECT code, date FROM bars WHERE {CLICK} AND date IN (SELECT date FROM panel) UNION SELECT code, date FROM panel)"),
    "availability_records": sql("SELECT component, panel_entry, 'missing_record' AS problem FROM c WHERE gone UNION ALL SELECT component, panel_entry, 'post_cutoff' FROM c WHERE NOT gone AND n % 5 <> 0 AND n % 3 = 0 UNION ALL SELECT component, panel_entry, 'cutoff_differs' FROM c WHERE NOT gone AND n % 7 = 0 UNION ALL SELECT component, panel_entry, 'unbound_receipt' FROM c WHERE NOT gone AND k % 17 = 0",
        f"comps AS (SELECT unnest({sorted(panels.COMPONENTS)}) AS component), c AS (SELECT component, {CELL} AS panel_entry, {N} AS k, {N} + day(date) AS n, component = 'trading_calendar' AND day(date) = 9 AS gone FROM panel, comps)"),
    "adjustment_identity": """SELECT k AS c_custkey, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 AND (k % 2 = 1 OR k % 3 <> 0) THEN sha256('{"adjustment_mode":"' || CASE WHEN k % 3 = 0 THEN 'qfq' ELSE 'raw' END || '","adjustment_version":"v1","price_role":"' || role || '","schema_version":"' || role || '-adjustment-identity/1","source":"\\u6e90 ' || c_name || '"}') END AS digest
        FROM (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'execution' ELSE 'signal' END AS role FROM customer)""",
    "closure_digest": _closure(),
    "report_consistency": """WITH c AS (SELECT c_custkey AS bundle, c_custkey AS k FROM customer)
        SELECT bundle, 'blocked_without_reason' AS problem FROM c WHERE k % 3 = 0 AND k % 5 = 0 UNION ALL SELECT bundle, 'components_differ' FROM c WHERE k % 11 = 0 UNION ALL SELECT bundle, 'aggregate_disagrees' FROM c WHERE k % 7 = 0""",
    "register_panel": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'invalid_symbols' WHEN c_custkey % 7 = 0 THEN 'not_a_weekday' WHEN c_custkey % 3 = 0 THEN 'panel_drifted' END AS problem FROM customer",
    "verify_snapshot": sql(f"SELECT DISTINCT 'part_year=2024/part_bucket=' || b AS part, CASE b WHEN 3 THEN 'drifted' ELSE 'missing' END AS problem FROM (SELECT {CRC_OF_CODE} % 16 AS b FROM bars WHERE {CLICK} AND is_final AND date <= DATE '2024-01-20') WHERE b IN (3, 5)"),
    "research_manifest": sql(f"SELECT 'history-' || substr(digest, 1, 16) AS id, 'history' AS kind, row_count, true AS valid FROM ({root_of('h')}) UNION ALL SELECT 'calendar-' || substr(digest, 1, 16), 'calendar', row_count, true FROM ({root_of('c')})",
        f"""h AS (SELECT sha256('{{"close":"' || CAST(close AS DECIMAL(18,2)) || '","code":"' || code || '","date":"' || date || '"}}') AS d FROM bars WHERE {CLICK}), c AS (SELECT sha256('{{"date":"' || date || '"}}') AS d FROM sessions)"""),
    "export_panel": _export(),
    "apply_sync": sql("SELECT code, CASE WHEN bad THEN 'error' WHEN w > 0 THEN 'synced' ELSE 'no_data' END AS status, CASE WHEN bad THEN 0 ELSE w END AS written, CASE WHEN NOT bad THEN CASE WHEN last = DATE '2024-01-19' THEN last ELSE DATE '2024-01-18' END END AS end_date FROM g",
        f"{KC}, g AS (SELECT code, coalesce(bool_or(inside AND (n % 11 = 0 OR (n % 7 = 0 AND dy = 12))), false) AS bad, count(*) FILTER (inside) AS w, max(date) FILTER (inside) AS last FROM (SELECT *, date BETWEEN DATE '2024-01-10' AND DATE '2024-01-19' AS inside FROM k) GROUP BY code)"),
    "execution_manifest": sql(f"SELECT unnest(['execution_prices', 'signal_prices', 'universe', 'instrument_status', 'corporate_actions', 'market_rules']) AS kind, count(*) AS row_count, 'code,date,close' AS columns FROM bars WHERE {CLICK} AND is_final"),
}
