"""Records of components, their receipts, signers and cutoffs: what may be admitted, and why not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitbars.functions import canonical, checks, digest
from pitbars.operators import panels

#: Fixed values of the contracts.
LISTING = ["listed", "suspended", "delisted"]
EVENTS = ["cash_dividend", "delisting", "rights_issue", "split", "stock_dividend", "symbol_change"]
REQUIRED = ["execution_prices", "signal_prices", "decision_context", "trading_calendar", "universe", "instrument_status", "corporate_actions", "market_rules", "availability_records"]
ROLES = {"execution": "execution-adjustment-identity/1", "signal": "signal-adjustment-identity/1"}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kind(payload: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), path, "variant"))


def _keys(payload: Column, *names: str) -> Column:
    return F.array_sort(F.json_object_keys(payload)) == F.array(*map(F.lit, sorted(names)))


def payload_valid(component: Column, payload: Column) -> Column:
    """Keys, types and values of a record's payload (JSON), by its component; other components need any keys at all."""
    text = lambda name: F.get_json_object(payload, f"$.{name}")
    boolean = lambda *names: reduce(lambda a, b: a & b, (_kind(payload, f"$.{n}") == "BOOLEAN" for n in names))
    string = lambda *names: reduce(lambda a, b: a & b, (_kind(payload, f"$.{n}") == "STRING" for n in names))
    events = F.from_json(payload, "events array<string>")["events"]

    def event_ok(e: Column) -> Column:
        at = lambda name: F.get_json_object(e, f"$.{name}")
        day = F.try_to_timestamp(at("effective_date"), F.lit("yyyy-MM-dd")).isNotNull() & at("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}$")
        return _sure(_keys(e, "announcement_at", "effective_date", "event_id", "event_type") & checks.valid_tz_timestamp(at("announcement_at")) & day & checks.valid_sha256(at("event_id")) & at("event_type").isin(EVENTS))

    rules = {
        "trading_calendar": _keys(payload, "decision_cutoff_at", "is_trading_day") & boolean("is_trading_day") & (text("is_trading_day") == "true") & checks.valid_tz_timestamp(text("decision_cutoff_at")),
        "universe": _keys(payload, "is_member", "universe_id") & boolean("is_member") & checks.valid_sha256(text("universe_id")),
        "instrument_status": _keys(payload, "is_st", "is_suspended", "listing_status") & text("listing_status").isin(LISTING) & boolean("is_st", "is_suspended"),
        "corporate_actions": _keys(payload, "events") & _kind(payload, "$.events").startswith("ARRAY") & F.forall(events, event_ok),
        "market_rules": _keys(payload, "board", "lot_size", "price_limit_policy_id", "t_plus_one") & string("board") & (text("board") != "") & (_kind(payload, "$.lot_size") == "BIGINT") & (text("lot_size").try_cast("long") >= 1) & boolean("t_plus_one") & checks.valid_sha256(text("price_limit_policy_id")),
    }
    out = F.size(F.json_object_keys(payload)) > 0
    for name, ok in rules.items():
        out = F.when(component == name, ok).otherwise(out)
    return _sure(out)


def adjustment_identity(identity: Column, role: Column, schemas: dict[str, str] | None = None) -> Column:
    """The digest of a declared adjustment identity (JSON) that fits the role, else null. Execution prices must be raw."""
    schemas = schemas or ROLES
    at = lambda name: F.get_json_object(identity, f"$.{name}")
    names = ("adjustment_mode", "adjustment_version", "price_role", "schema_version", "source")
    schema = reduce(lambda out, x: F.when(role == x[0], x[1]).otherwise(out), schemas.items(), F.lit(None).cast("string"))
    filled = reduce(lambda a, b: a & b, ((_kind(identity, f"$.{n}") == "STRING") & (at(n) != "") for n in names))
    ok = _keys(identity, *names) & filled & (at("price_role") == role) & (at("schema_version") == schema) & ((role != "execution") | (at("adjustment_mode") == "raw"))
    return F.when(_sure(ok), digest.record_sha256(**{n: at(n) for n in names}))


def signer_interval(envelopes: DataFrame, signers: DataFrame, roots: DataFrame) -> DataFrame:
    """Envelopes (signer, root, component, available_at) with `problem`: null where the signer is known, bound to that root, has the role,
    and was authorised then, both ends included."""
    known = signers.select("signer", F.col("root").alias("own_root"), "roles", "valid_from", "valid_until")
    joined = envelopes.join(roots.select("root", F.lit(True).alias("root_known")), "root", "left").join(known, "signer", "left")
    problem = (
        F.when(F.col("root_known").isNull(), "unknown_root").when(F.col("own_root").isNull(), "unknown_signer").when(F.col("own_root") != F.col("root"), "signer_of_another_root")
        .when(~_sure(F.array_contains("roles", F.col("component"))), "role_not_authorized").when(~_sure(F.col("available_at").between(F.col("valid_from"), F.col("valid_until"))), "outside_authorization")
    )
    return joined.withColumn("problem", problem).select(*envelopes.columns, "problem")


def receipt_bindings(records: DataFrame, bindings: DataFrame) -> DataFrame:
    """(component, panel_entry, receipt, problem) of listed receipts that are unbound, or bind another record."""
    key = ["component", "panel_entry", "record_sha256", "receipt"]
    listed = records.select("component", "panel_entry", "record_sha256", F.explode("source_receipt_ids").alias("receipt"))
    bound = bindings.select("receipt").distinct().withColumn("bound", F.lit(True))
    loose = listed.join(bindings.select(*key).distinct(), key, "left_anti").join(bound, "receipt", "left")
    return loose.select("component", "panel_entry", "receipt", F.when(F.col("bound").isNull(), "unbound_receipt").otherwise("record_not_bound").alias("problem"))


def latest_available(records: DataFrame, bindings: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(component, panel_entry, available_at): the latest of the record, its receipts and its component's envelope."""
    listed = records.select("component", "panel_entry", F.explode_outer("source_receipt_ids").alias("receipt")).join(bindings.groupBy("receipt").agg(F.max("available_at").alias("seen")), "receipt", "left")
    receipts = listed.groupBy("component", "panel_entry").agg(F.max("seen").alias("seen"))
    sealed = envelopes.groupBy("component").agg(F.max("available_at").alias("sealed"))
    own = records.groupBy("component", "panel_entry").agg(F.max("available_at").alias("own"))
    return own.join(receipts, ["component", "panel_entry"], "left").join(sealed, "component", "left").select("component", "panel_entry", F.greatest("own", "seen", "sealed").alias("available_at"))


def cutoff_check(cells: DataFrame, cutoffs: DataFrame, strict: bool = True) -> DataFrame:
    """Cells (component, panel_entry, available_at, effective_at) with `in_time`. Strict (admission): both before the cutoff; otherwise
    (records): available by it. A cell without cutoff is not in time."""
    joined = cells.join(cutoffs.select("panel_entry", "cutoff_at"), "panel_entry", "left")
    ok = (F.col("available_at") < F.col("cutoff_at")) & (F.col("effective_at") < F.col("cutoff_at")) if strict else F.col("available_at") <= F.col("cutoff_at")
    return joined.withColumn("in_time", _sure(ok)).select("component", "panel_entry", "in_time")


def admit_component(records: DataFrame, bindings: DataFrame, envelopes: DataFrame, cutoffs: DataFrame, panel: DataFrame, signers: DataFrame, roots: DataFrame) -> DataFrame:
    """(component, panel_entry, problem) for every component of the records and cell of the panel (column panel_entry): the first problem,
    null where the record is admitted. A component without an envelope, or with one whose signer may not sign it then, has no admitted
    record. envelopes, signers and roots as in signer_interval; records: component, panel_entry, payload, record_sha256, source_receipt_ids, effective_at, available_at."""
    key = ["component", "panel_entry"]
    ids = F.col("source_receipt_ids")
    listed = _sure((F.size(ids) > 0) & (ids == F.array_sort(F.array_distinct(ids))) & F.forall(ids, checks.valid_sha256))
    loose = receipt_bindings(records, bindings).groupBy(*key).agg(F.max("problem").alias("loose"))  # unbound_receipt comes first
    late = cutoff_check(latest_available(records, bindings, envelopes).join(records.groupBy(*key).agg(F.max("effective_at").alias("effective_at")), key), cutoffs)
    signed = signer_interval(envelopes, signers, roots).groupBy("component").agg(F.max("problem").alias("unsigned"), F.lit(True).alias("sealed"))
    counted = records.withColumn("times", F.count("*").over(Window.partitionBy(*key)))
    grid = records.select("component").distinct().crossJoin(panel.select("panel_entry").distinct())
    joined = grid.join(counted, key, "full_outer").join(panel.select("panel_entry", F.lit(True).alias("in_panel")).distinct(), "panel_entry", "left").join(loose, key, "left").join(late, key, "left").join(signed, "component", "left")
    problem = (
        F.when(F.col("in_panel").isNull(), "outside_panel").when(F.col("sealed").isNull(), "missing_envelope").when(F.col("unsigned").isNotNull(), F.col("unsigned")).when(F.col("times").isNull(), "missing_record").when(F.col("times") > 1, "repeated_record")
        .when(~payload_valid(F.col("component"), F.col("payload")), "invalid_payload").when(~_sure(F.col("record_sha256") == F.sha2("payload", 256)), "record_hash_drifted")
        .when(~listed, "invalid_receipts").when(F.col("loose").isNotNull(), F.col("loose"))
        .when(~_sure(F.date_format("effective_at", "yyyy-MM-dd") == F.element_at(F.split("panel_entry", "@"), -1)), "effective_date_differs").when(~_sure(F.col("in_time")), "post_cutoff")
    )
    return joined.select(*key, problem.alias("problem")).distinct()


def availability_records(records: DataFrame, panel: DataFrame, cutoffs: DataFrame, receipts: DataFrame) -> DataFrame:
    """(component, panel_entry, problem) of what keeps the records of all components from covering the panel: nothing, if they do. panel: code,
    date. receipts: column receipt, those that are bound. A record's own decision_cutoff_at must be the authoritative one."""
    entry = F.concat_ws("@", "code", F.col("date").cast("string"))
    parts = F.split("panel_entry", "@")
    cells = records.select("component", parts[0].alias("code"), F.to_date(F.element_at(parts, -1)).alias("date"))
    grid = panels.component_grid(panel, cells).select("component", entry.alias("panel_entry"), F.when(F.col("times") == 0, "missing_record").otherwise("repeated_record").alias("problem"))
    outside = records.join(panel.select(entry.alias("panel_entry")), "panel_entry", "left_anti").select("component", "panel_entry", F.lit("outside_panel").alias("problem"))
    ids = F.col("source_receipt_ids")
    shape = records.where(~(checks.valid_sha256(F.col("record_sha256")) & _sure((F.size(ids) > 0) & (ids == F.array_sort(F.array_distinct(ids))) & F.forall(ids, checks.valid_sha256)))).select("component", "panel_entry", F.lit("invalid_record").alias("problem"))
    late = cutoff_check(records, cutoffs, strict=False).where(~F.col("in_time")).select("component", "panel_entry", F.lit("post_cutoff").alias("problem"))
    authoritative = records.join(cutoffs.select("panel_entry", "cutoff_at"), "panel_entry", "left")
    differs = authoritative.where(~F.col("decision_cutoff_at").eqNullSafe(F.col("cutoff_at"))).select("component", "panel_entry", F.lit("cutoff_differs").alias("problem"))
    listed = records.select("component", "panel_entry", F.explode(ids).alias("receipt"))
    unbound = listed.join(receipts.select("receipt").distinct(), "receipt", "left_anti").select("component", "panel_entry", F.lit("unbound_receipt").alias("problem"))
    return reduce(DataFrame.unionByName, [grid, outside, shape, late, differs, unbound]).distinct()


#: The single references of a contract, beside its receipts.
SINGLE = ["checkout", "companion_snapshot", "database", "exact_panel", "execution_adjustment_identity", "readiness_report", "signal_adjustment_identity"]


def closure_digest(references: DataFrame, schema_version: str, owner: str) -> DataFrame:
    """(bundle, digest, complete) of a contract's references (bundle, field, kind, identifier, schema_version): the SHA-256 of its canonical
    JSON, the same wherever it is computed. complete: each single reference once, one receipt or more, none twice, all well formed. A
    bundle names the receipts of one export; they are one row."""
    ref = F.struct("identifier", "kind", "schema_version")
    receipt = F.col("field") == "source_receipts"
    one = lambda name: F.max(F.when(F.col("field") == name, ref))
    formed = checks.valid_sha256(F.col("identifier")) & (F.col("kind") != "") & (F.col("schema_version") != "")
    parts = references.groupBy("bundle").agg(*(one(n).alias(n) for n in SINGLE), F.array_sort(F.collect_list(F.when(receipt, ref))).alias("source_receipts"), F.count_distinct(F.when(~receipt, F.col("field"))).alias("fields"), F.count(F.when(~receipt, 1)).alias("singles"), F.min(_sure(formed & F.col("field").isin(*SINGLE, "source_receipts"))).alias("formed"))
    whole = F.struct(*(F.col(n) for n in SINGLE), F.lit(owner).alias("repository_owner"), F.array(*map(F.lit, REQUIRED)).alias("required_components"), F.lit(schema_version).alias("schema_version"), "source_receipts")
    body = parts.withColumn("whole", whole)
    ids = F.transform("source_receipts", lambda r: r["identifier"])
    ok = (F.col("fields") == len(SINGLE)) & (F.col("singles") == len(SINGLE)) & (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.col("formed")
    return body.select("bundle", F.sha2(canonical.encode(F.col("whole"), body.schema["whole"].dataType), 256).alias("digest"), _sure(ok).alias("complete"))


def report_consistency(components: DataFrame, aggregates: DataFrame) -> DataFrame:
    """(bundle, problem). components: bundle, component, ready, blockers (array); aggregates: bundle, ready, blocked (array of components)."""
    n = F.size("blockers")
    own = F.when(F.col("ready").isNull() | F.col("blockers").isNull(), "malformed").when(~F.col("ready") & (n == 0), "blocked_without_reason").when(F.col("ready") & (n > 0), "ready_with_blockers")
    each = components.select("bundle", own.alias("problem")).where("problem is not null")
    states = components.groupBy("bundle").agg(F.min("ready").alias("all_ready"), F.collect_set(F.when(~F.col("ready"), F.col("component"))).alias("down"), F.array_sort(F.collect_set("component")).alias("c"))
    joined = aggregates.join(states, "bundle", "left")
    due = _sure(F.col("all_ready")) & (F.size("blocked") == 0)
    checks_ = {"components_differ": ~_sure(F.col("c") == F.array(*map(F.lit, sorted(REQUIRED)))), "aggregate_disagrees": F.col("ready") != due, "blocked_components_omitted": ~F.col("ready") & (F.size(F.array_except("down", "blocked")) > 0)}
    whole = joined.select("bundle", F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in checks_.items())))).alias("problem"))
    return each.unionByName(whole).distinct()


def content_sha256(spark, path: str) -> DataFrame:
    """(content_sha256) of a records file's bytes: what an attestation made elsewhere states."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("content_sha256"))


def attest_universe(rows: DataFrame, daily: DataFrame, attested: DataFrame, content: DataFrame) -> DataFrame:
    """(problem, sample) where rows (date) differ from what is attested: daily counts (date, declared), and one row of attested (total, digest,
    start, end), digest being that of the records file (content, see content_sha256). Empty: attested."""
    counted = panels.daily_record_counts(rows, daily).select(F.lit("daily_count_differs").alias("problem"), F.col("date").cast("string").alias("sample"))
    found = rows.agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    both = attested.withColumns({"n": found.select("n").scalar(), "a": found.select("a").scalar(), "b": found.select("b").scalar(), "d": content.scalar()})
    wrong = {"total_differs": ~_sure(F.col("n") == F.col("total")), "digest_differs": ~_sure(F.col("d") == F.col("digest")), "coverage_differs": ~_sure((F.col("start") <= F.col("end")) & (F.col("start") <= F.col("a")) & (F.col("b") <= F.col("end")))}
    return counted.unionByName(both.select(F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in wrong.items())))).alias("problem"), F.lit("all").alias("sample")))


def register_panel_check(registrations: DataFrame, requested: str, n_symbols: int = 12, n_sessions: int = 3) -> DataFrame:
    """Registrations (id, symbols, sessions, status, adjustment_mode, source, adjustment_version, outcome_feedback_used, workspace_count,
    panel_sha256) with `problem`: null where the requested session may be captured."""
    entry = F.flatten(F.transform("symbols", lambda s: F.transform("sessions", lambda d: F.concat_ws("@", s, d))))
    days = F.transform("sessions", lambda d: F.to_date(F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))))
    unique = lambda c, n: (F.size(c) == n) & (F.size(F.array_distinct(c)) == n) & F.forall(c, lambda x: (x != "") & (F.trim(x) == x))
    rules = {
        "outcome_not_blind": ~F.col("outcome_feedback_used"), "not_pending": F.col("status") == "AWAITING_FULL_SNAPSHOT_READINESS", "not_raw": F.col("adjustment_mode") == "raw",
        "invalid_identity": (F.col("source") != "") & (F.col("adjustment_version") != ""), "invalid_workspace_count": F.col("workspace_count") == n_symbols * n_sessions,
        "invalid_symbols": unique("symbols", n_symbols), "invalid_sessions": unique("sessions", n_sessions) & (F.col("sessions") == F.array_sort("sessions")) & F.forall(days, lambda d: d.isNotNull()),
        "not_a_weekday": F.forall(days, lambda d: F.weekday(d) < 5), "not_registered": F.array_contains("sessions", requested), "panel_drifted": F.col("panel_sha256") == digest.panel_sha256(entry),
    }
    problem = F.coalesce(*(F.when(~_sure(ok), name) for name, ok in rules.items()))
    return registrations.select("id", problem.alias("problem"))
