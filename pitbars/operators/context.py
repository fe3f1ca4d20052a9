"""Readiness of market context and corporate actions: what was stored must follow from receipts that were taken in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions import clock
from pitbars.functions.symbols import normalize_symbol
from pitbars.operators import actions, evidence
from pitbars.shared import written
from pitbars.sources import landing


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def context_rows(status: DataFrame, universe: DataFrame, context: DataFrame, receipts: DataFrame, source: str) -> DataFrame:
    """Stored status with the membership, the phase record and the receipt of the same capture."""
    key = ["date", "phase", "source", "receipt_id"]
    r = receipts.select("receipt_id", F.col("source").alias("receipt_source"), "response", "response_sha256", "observed_at")
    return status.where(F.col("source") == source).join(universe.select(*key, "code", "is_member"), [*key, "code"]).join(context, key).join(r, "receipt_id")


def context_failures(status: DataFrame, universe: DataFrame, context: DataFrame, receipts: DataFrame, panel: DataFrame, source: str) -> DataFrame:
    """(blocker, sample). Status must be what the response of its receipt says, taken on its day and in its phase; the stored universe must
    be the response's; a decision must come before its outcome. A response that can't be read fails the cells it was stored for, and no others.
    Times are local market time."""
    digests = receipts.select("receipt_id", (F.sha2("response", 256) == F.col("response_sha256")).alias("digest_holds"))  # once for each response
    chosen = context_rows(status, universe, context, receipts, source).drop("response", "response_sha256").join(digests, "receipt_id")
    chosen = written(evidence.panel_select(chosen, panel), "context")
    missing = [panel.join(chosen.where(F.col("phase") == phase), ["code", "date"], "left_anti").select(F.lit(blocker).alias("blocker"), evidence.cell().alias("sample")) for phase, blocker in (("pre_open", "missing_decision_context_rows"), ("post_close", "missing_finalized_context_rows"))]
    judged = written(landing.judge_market_pages(receipts), "market")
    market = landing.market_rows(judged)
    counted = judged.select("receipt_id", F.col("m").isNotNull().alias("readable"), (F.size("m") == F.coalesce("advertised_count", F.size("m"))).alias("whole"))
    derived = actions.status_values(market.where("code is not null")).select("receipt_id", "code", F.struct("name", "board", "is_st", "is_suspended").alias("derived"), "valid")
    timely = _sure((F.col("observed_at").cast("date") == F.col("date")) & (clock.observation_phase(F.col("observed_at")) == F.col("phase")))
    intact = _sure((F.col("receipt_source") == source) & F.col("digest_holds"))
    early = F.col("phase") == "pre_open"
    times = F.col("decision_available_at").eqNullSafe(F.when(early, F.col("observed_at"))) & F.col("outcome_observed_at").eqNullSafe(F.when(~early, F.col("observed_at"))) & F.col("finalized_at").eqNullSafe(F.when(~early, F.col("observed_at")))
    stated = (F.struct("name", "board", "is_st", "is_suspended") == F.col("derived")) & F.col("valid") & (F.col("listing_status") == "listed")
    cells = chosen.join(counted, "receipt_id", "left").join(derived, ["receipt_id", "code"], "left").withColumn("sound", intact & timely & _sure(F.col("readable")))
    bad = cells.where(~(F.col("sound") & _sure(F.col("whole") & stated & F.col("is_member")) & times)).select(F.concat_ws("@", "code", F.col("date").cast("string"), "phase").alias("sample"))
    checked = cells.where("sound").select("date", "phase", "receipt_id").distinct()
    held, due = (x.join(checked, keys, "left_semi") for x, keys in ((universe.select("date", "phase", "receipt_id", "code"), ["date", "phase", "receipt_id"]), (market.join(checked, "receipt_id").select("date", "phase", "receipt_id", "code"), ["date", "phase", "receipt_id"])))
    apart = evidence.same_set(held, due).select(F.concat_ws("@", F.lit("universe"), F.col("date").cast("string"), "phase").alias("sample"))
    at = lambda phase, *columns: chosen.where(F.col("phase") == phase).select("code", "date", *columns)
    both = at("pre_open", "decision_available_at").join(at("post_close", "outcome_observed_at", "finalized_at"), ["code", "date"])
    disordered = both.where(~_sure((F.col("decision_available_at") < F.col("outcome_observed_at")) & (F.col("outcome_observed_at") <= F.col("finalized_at")))).select(F.concat_ws("@", F.lit("timeline"), "code", F.col("date").cast("string")).alias("sample"))
    invalid = [x.select(F.lit("invalid_context_receipts").alias("blocker"), "sample") for x in (bad, apart, disordered)]
    return reduce(DataFrame.unionByName, [*missing, *invalid])


def fixed_blockers(spark, names: list[str]) -> DataFrame:
    """Blockers that stand until an authority is enrolled."""
    return spark.createDataFrame([(x, 1, "") for x in names], "blocker string, count long, examples string")


def context_readiness(status, universe, context, receipts, panel, source: str) -> DataFrame:
    return evidence.blockers(context_failures(status, universe, context, receipts, panel, source)).unionByName(fixed_blockers(panel.sparkSession, ["signed_session_calendar_not_enrolled"]))


def coverage_with_receipts(coverage: DataFrame, receipts: DataFrame, source: str) -> DataFrame:
    r = receipts.select("receipt_id", F.col("source").alias("receipt_source"), "request", "response", "response_sha256", "observed_at")
    return coverage.where(F.col("source") == source).join(r, "receipt_id")


EVENT = ["receipt_id", "code", "event_id", "effective_date", "announcement_date", "payload_json"]


def events_match_receipts(cells: DataFrame, stored: DataFrame, judged: DataFrame) -> DataFrame:
    """Cells (code, date, receipt_id, event_count, available_at) with `same`: whether the stored events are those of the receipt, as many
    as counted. judged: receipts as landing.judge_action_batches gives them; one with a reason against it matches no cell."""
    derived = written(landing.action_events(judged), "events")
    key = ["receipt_id", "code"]
    covered = derived.select(*key).distinct().withColumn("covered", F.lit(True))
    n = derived.groupBy(*key).agg(F.count("event_id").alias("due"))
    due = cells.select(*key, "date", "available_at").join(derived.where("event_id is not null").select(*EVENT), key)
    held = stored.join(cells.select(*key, "date"), [*key, "date"], "left_semi").select(*key, "date", F.col("available_at"), *EVENT[2:])
    apart = evidence.same_set(held.select(sorted(held.columns)), due.select(sorted(due.columns))).select(*key, "date").distinct().withColumn("apart", F.lit(True))
    joined = cells.join(covered, key, "left").join(n, key, "left").join(apart, [*key, "date"], "left")
    return joined.withColumn("same", F.col("covered").isNotNull() & F.col("apart").isNull() & _sure(F.col("due") == F.col("event_count"))).drop("covered", "due", "apart")


def action_failures(coverage: DataFrame, stored: DataFrame, receipts: DataFrame, panel: DataFrame, source: str) -> DataFrame:
    """(blocker, sample): coverage of every cell, from intact receipts of the right request, with the receipt's own events, before the open. A
    response that can't be read is one sample, response@day; all other cells are judged."""
    judged = landing.judge_action_batches(receipts)
    requests = receipts.select("receipt_id", F.from_json("request", "observation_date string, symbols array<string>, years array<int>").alias("q"))
    asked = requests.select("receipt_id", F.explode("q.symbols").alias("symbol")).select("receipt_id", normalize_symbol(F.col("symbol")).alias("code"), F.lit(True).alias("asked"), F.lit(False).alias("held"))
    held = judged.where("symbol is not null").select("receipt_id", "code", F.lit(False).alias("asked"), F.lit(True).alias("held"))
    apart = asked.unionByName(held).groupBy("receipt_id", "code").agg(F.bool_or("asked").alias("asked"), F.bool_or("held").alias("held")).where("not (asked and held)").select("receipt_id").distinct()
    facts = receipts.select("receipt_id", (F.sha2("response", 256) == F.col("response_sha256")).alias("digest_holds"))  # once for each response; no cell carries its symbols
    terms = requests.select("receipt_id", F.col("q.observation_date").alias("asked_date"), F.col("q.symbols").isNotNull().alias("asked"), F.array_sort(F.array_distinct("q.years")).alias("asked_years"))
    facts = facts.join(terms, "receipt_id").join(landing.action_reasons(judged), "receipt_id").join(apart.withColumn("apart", F.lit(True)), "receipt_id", "left")
    facts = written(facts, "facts")
    chosen = coverage_with_receipts(coverage, receipts, source).drop("request", "response", "response_sha256").join(facts, "receipt_id")
    chosen = written(evidence.panel_select(chosen, panel), "coverage")
    missing = evidence.panel_missing(panel, chosen).select(F.lit("missing_corporate_action_coverage").alias("blocker"), evidence.cell().alias("sample"))
    intact = _sure((F.col("receipt_source") == source) & F.col("digest_holds") & (F.col("observed_at") == F.col("available_at")))
    sound = chosen.withColumn("intact", intact)
    broken = sound.where(~F.col("intact")).select(evidence.cell().alias("sample"))
    unread = sound.where("intact AND reason IS NOT NULL").select(F.concat_ws("@", F.lit("response"), F.col("date").cast("string")).alias("sample"))
    good = sound.where("intact AND reason IS NULL")
    year = F.year("date")
    asked = _sure((F.col("asked_date") == F.col("date").cast("string")) & F.col("asked") & F.col("apart").isNull() & (F.col("asked_years") == F.array(year - 1, year)))
    wrong = good.where(~asked).select(F.concat_ws("@", F.lit("request"), F.col("date").cast("string")).alias("sample"))
    matched = events_match_receipts(good.select("code", "date", "receipt_id", "event_count", "available_at"), stored, judged)
    differ = matched.where(~F.col("same")).select(evidence.cell().alias("sample"))
    timely = _sure((F.col("available_at").cast("date") == F.col("date")) & (clock.observation_phase(F.col("available_at")) == "pre_open"))
    late = chosen.where(~timely).select(F.lit("corporate_actions_outside_preopen_cutoff").alias("blocker"), evidence.cell().alias("sample"))
    invalid = [x.select(F.lit("invalid_corporate_action_receipts").alias("blocker"), "sample") for x in (broken, unread, wrong, differ)]
    return reduce(DataFrame.unionByName, [missing, *invalid, late])


def action_readiness(coverage, stored, receipts, panel, source: str) -> DataFrame:
    fixed = ["dividend_observation_not_full_corporate_action_ledger", "corporate_action_revisions_not_supported", "corporate_action_publisher_key_not_enrolled"]
    return evidence.blockers(action_failures(coverage, stored, receipts, panel, source)).unionByName(fixed_blockers(panel.sparkSession, fixed))


#: The components of full readiness, and what blocks those that no authority is enrolled for.
UNENROLLED = {
    "universe": "forward_universe_publisher_key_not_enrolled",
    "instrument_status": "instrument_status_is_activity_proxy",
    "trading_calendar": "signed_trading_calendar_not_enrolled",
    "market_rules": "official_rulebook_bundle_not_enrolled",
    "availability_records": "complete_component_availability_records_not_bound",
}


def full_readiness(execution: DataFrame, signal: DataFrame, context: DataFrame, corporate_actions: DataFrame, adjustment_mode: str) -> DataFrame:
    """Blockers (blocker, count, examples) of each part under their components: ready only without any. Universe and status stand on the
    context. Execution prices must be raw."""
    spark = execution.sparkSession
    parts = {"execution_prices": execution, "signal_prices": signal, "corporate_actions": corporate_actions}
    if adjustment_mode != "raw":
        parts["execution_prices"] = execution.unionByName(fixed_blockers(spark, ["execution_prices_require_raw_adjustment"]))
    tagged = [x.select(F.lit(name).alias("component"), "blocker", "count", "examples") for name, x in parts.items()]
    shared = F.explode(F.array(*map(F.lit, ("decision_context", "universe", "instrument_status"))))  # evaluated once
    tagged.append(context.select(shared.alias("component"), "blocker", "count", "examples"))
    tagged += [fixed_blockers(spark, [x]).select(F.lit(name).alias("component"), "blocker", "count", "examples") for name, x in UNENROLLED.items()]
    return reduce(DataFrame.unionByName, tagged)
