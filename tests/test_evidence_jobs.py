"""Landing, context, actions, authorities, artifacts and captures on literal rows."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pitbars.functions import canonical, checks
from pitbars.operators import artifacts, authority, context, panels, store
from pitbars.plans import registry
from pitbars.sources import landing, views
from pitbars.streaming import jobs

D = dt.date(2024, 1, 2)
SHA = "a" * 64


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def at(h, m=0, day=D):
    return dt.datetime.combine(day, dt.time(h, m))


def test_tick_frame(spark):
    rows = [("A", "2024-01-03 15:00", 1.0, 2.0, 0.5, 1.5, None, 7.0), ("A", "2024-01-02", 1.0, 2.0, 0.5, 1.5, 3.0, 7.0), ("A", "2024-01-04", 1.0, 2.0, 0.5, 1.5, None, None)]
    got = landing.land_tick_frame(spark.createDataFrame(rows, "code string, datetime string, open double, high double, low double, close double, volume double, vol double")).collect()
    assert [(r["date"].day, r["volume"]) for r in got] == [(2, 3.0), (3, 7.0), (4, 0.0)]


def test_component_grid_counts_a_cell_in_one_row(spark):
    panel = spark.createDataFrame([("A", D), ("B", D)], "code string, date date")
    rows = [(c, "A", D) for c in panels.COMPONENTS if c != "universe"] + [("signal_prices", "A", D), ("other", "A", D), ("universe", "C", D), (None, "A", D)]
    got = panels.component_grid(panel, spark.createDataFrame(rows, "component string, code string, date date"))
    assert sorted(map(tuple, got.collect())) == sorted([("universe", "A", D, 0), ("signal_prices", "A", D, 2), *((c, "B", D, 0) for c in panels.COMPONENTS)])
    keys = [line.split("[")[1].split("]")[0] for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line]
    assert keys and not any("component" in k for k in keys)


def test_status_query_has_every_cell(spark):
    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["land_status_frames"](spark, sf)
    cells = views.panel(spark, sf)
    assert got.count() == cells.count() and not cells.join(got, ["code", "date"], "left_anti").count()
    assert {(r["status"], r["is_tradable"]) for r in got.collect()} == {("active", True), ("suspended", False), ("invalid", None)}


def test_code_list(spark):
    lines = spark.createDataFrame([("# all",), (" 600519 ",), ("",), ("000001.SZ",)], "value string")
    assert [r["code"] for r in landing.land_code_list(lines).collect()] == ["600519", "000001.SZ"]


def test_jsonl_strict(spark):
    def read(*rows):
        lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(rows)], "file string, at long, value string")
        good, bad = landing.land_jsonl_strict(lines, "code string, n int")
        return [tuple(r) for r in good.collect()], [(r["at"], r["reason"]) for r in bad.orderBy("at").collect()]

    assert read('{"code":"A","n":1}', '{"code":"B","n":2}') == ([("A", 1), ("B", 2)], [])
    # the same row, however it is escaped or spaced
    assert read('{"n": 1, "code": "\\u5e73\\u5b89"}') == ([("平安", 1)], [])
    assert read('{"code":"A"}', '{"code":"A","n":1,"x":2}', '{"code":"A","n":"x"}', "[]", "junk")[1] == [(0, "wrong_keys"), (1, "wrong_keys"), (2, "wrong_type"), (3, "not_json"), (4, "not_json")]
    assert read('{"code":"A","n":1}', '{"n":1,"code":"A"}')[1] == [(1, "repeated")]
    assert read('{"code":"B","n":1}', '{"code":"A","n":1}')[1] == [(1, "unsorted")]


def test_swapped_pair_across_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "LINES", 7)
    rows = [f'{{"code":"{k:06d}","n":{k}}}' for k in range(400)]
    path, size = tmp_path / "lines.txt", 2048
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        for swapped in (None, *range(380, 400 - 1), size // (len(rows[0]) + 1) - 1):
            text = list(rows)
            if swapped is not None:
                text[swapped], text[swapped + 1] = text[swapped + 1], text[swapped]
            path.write_text("\n".join(text))
            lines = spark.read.text(str(path))
            if swapped is None:
                assert lines.rdd.getNumPartitions() > 1
            numbered = landing.numbered(lines)
            assert swapped is not None or sorted(r["at"] for r in numbered.collect()) == list(range(400))
            bad = landing.land_jsonl_strict(numbered, "code string, n int")[1].collect()
            assert [(r["at"], r["reason"]) for r in bad] == ([] if swapped is None else [(swapped + 1, "unsorted")])
            if swapped is not None and swapped > 381:
                break
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("shape", ['["600519@2024-01-02","000001.SZ@2024-01-03"]', '{"panel":["600519@2024-01-02","000001.SZ@2024-01-03"]}', '{"splits":{"train":[],"search-validation":["600519@2024-01-02","000001.SZ@2024-01-03"]}}'])
def test_land_panel(spark, shape):
    got = landing.land_panel(spark.createDataFrame([(shape,)], "payload string")).collect()
    assert sorted((r["code"], r["date"].day) for r in got) == [("000001.SZ", 3), ("600519.SH", 2)]


@pytest.mark.parametrize("bad", ["[]", '["600519"]', '["600519@2024-01-02","sh600519@2024-01-02"]', '["x@2024-01-02"]'])
def test_land_panel_errors(spark, bad):
    with pytest.raises(Exception, match="panel|security code"):
        landing.land_panel(spark.createDataFrame([(bad,)], "payload string")).collect()


def market(rows, advertised=None):
    return json.dumps({"advertised_count": len(rows) if advertised is None else advertised, "count_raw": "2", "raw_pages": [json.dumps(rows[:1]), json.dumps(rows[1:])]})


ROWS = [{"symbol": "sz000001", "name": "Example", "trade": "10.0", "volume": "1000"}, {"symbol": "sh600000", "name": "*ST x", "trade": "0", "volume": "5"}]


def test_market_pages(spark):
    due = {
        None: market(ROWS), "count_differs": market(ROWS, 3), "repeated_symbol": market([ROWS[0], ROWS[0]]), "invalid_symbol": market([{**ROWS[0], "symbol": "xx1"}]), "not_json": "junk", "no_raw_pages": '{"pages":[]}',
        "page_not_text": '{"raw_pages":[[1]]}', "page_not_rows": json.dumps({"raw_pages": ['[{"symbol":"sz000001"}]', "[1]"]}),
    }
    rows, bad = landing.land_market_pages(spark.createDataFrame(list(enumerate(due.values())), "receipt_id long, response string"))
    assert sorted(tuple(r) for r in rows.collect()) == [(0, "000001.SZ", "Example", 10.0, 1000.0), (0, "600000.SH", "*ST x", 0.0, 5.0)]
    assert {r["receipt_id"]: r["reason"] for r in bad.collect()} == {k: x for k, x in enumerate(due) if x}
    odd = market([{"symbol": "SZ000001 ", "name": None, "trade": "1.0d", "volume": 7}, {"symbol": "bj830001", "name": "x"}])
    got = landing.land_market_pages(spark.createDataFrame([(1, odd)], "receipt_id long, response string"))[0].collect()
    assert sorted(tuple(r)[1:] for r in got) == [("000001.SZ", "", None, 7.0), ("830001.BJ", "x", 0.0, 0.0)]


def test_action_batches(spark):
    batch = lambda rows, fields=("dividOperateDate", "plan"): {"year": 2024, "fields": list(fields), "rows": rows}
    of = lambda **symbols: json.dumps({"symbols": symbols})
    due = [
        (None, json.dumps({"symbols": {"000001.SZ": [batch([["2024-01-05", "每股"], ["2024-01-05", "每股"]]), batch([])], "sh600000": []}})), ("not_json", "junk"), ("no_symbols", '{"symbols":[]}'), ("unknown_symbol", of(x=[])),
        ("batches_not_a_list", of(sh600000={})), ("invalid_batch", of(sh600000=[1])), ("invalid_batch", of(sh600000=[{"fields": []}])), ("row_width", of(sh600000=[batch([["2024-01-05"]])])), ("row_width", of(sh600000=[batch([7])])),
        ("invalid_event", of(sh600000=[batch([["2024-01-05", [1]]])])), ("invalid_date", of(sh600000=[batch([["2024-02-30", "x"]])])),
    ]
    events, bad = landing.land_action_batches(spark.createDataFrame([(k, r) for k, (_, r) in enumerate(due)], "receipt_id long, response string"))
    payload = json.dumps({"dividOperateDate": "2024-01-05", "plan": "每股"}, sort_keys=True, separators=(",", ":"))
    assert sorted((tuple(r) for r in events.collect()), key=str) == [(0, "000001.SZ", sha(payload), "2024-01-05", None, payload), (0, "600000.SH", None, None, None, None)]
    assert {r["receipt_id"]: r["reason"] for r in bad.collect()} == {k: x for k, (x, _) in enumerate(due) if x}


def test_action_batches_are_judged_by_symbol(spark):
    batch = {"year": 2024, "fields": ["dividOperateDate", "plan"], "rows": [["2024-01-05", "x"]]}
    symbols = {f"6{k:05d}.SH": [batch] if k % 3 else [] for k in range(1500)}
    bad = {**symbols, "600007.SH": [batch, {"fields": ["a"], "rows": [[1, 2]]}], "600008.SH": [{**batch, "rows": [["2024-02-30", "x"]]}]}
    receipts = spark.createDataFrame([(k, json.dumps({"symbols": x})) for k, x in enumerate((symbols, bad, {}))], "receipt_id long, response string")
    judged = landing.judge_action_batches(receipts)
    rows = [(r["receipt_id"], r["reason"], r["symbol"], len(r["events"] or [])) for r in judged.collect()]
    assert sorted(x[2:] for x in rows if x[0] == 0) == [(s, len(b)) for s, b in symbols.items()] and {x[1] for x in rows if x[0] == 0} == {None}
    assert len([x for x in rows if x[0] == 1]) == 1500 and {x[1] for x in rows if x[0] == 1} == {"row_width"}  # the first reason, for the whole receipt
    assert [x[1:3] for x in rows if x[0] == 2] == [(None, None)]
    assert sorted(map(tuple, landing.action_reasons(judged).collect())) == [(0, None), (1, "row_width"), (2, None)]
    assert landing.action_events(judged).count() == 1500


def test_canonical_json_as_elsewhere(spark):
    texts = ["", "a", '"q\\ \n\t\r\b\f\x00\x1f\x7f', "é漢字", "😀𝒳 x", "a\nb", "~ !#[]^"]
    for r in spark.createDataFrame([(x,) for x in texts], "s string").select("s", canonical.string(F.col("s")).alias("a"), canonical.string(F.col("s"), False).alias("u")).collect():
        assert (r["a"], r["u"]) == (json.dumps(r["s"]), json.dumps(r["s"], ensure_ascii=False))
    numbers = [0.0, -0.0, 1.5, 100.0, 1e7, 1.25e9, 1e15, 1e16, 1.5e22, 1e-3, 1e-4, 1.5e-4, 1e-5, 1.234e-7, -2.5, float("inf"), 3.14159, 1e100, 12345678.9]
    for r in spark.createDataFrame([(x,) for x in numbers], "x double").select("x", canonical.double(F.col("x")).alias("j")).collect():
        assert r["j"] == json.dumps(r["x"])
    values = ['{"b":1,"a":[1.50,"é",null,true,{"z":"x","y":2}]}', "[]", "{}", '"x"', "12345678901234567890", "1e3", '{"a":"\\u5e73","\\u5b89":-0.5}', "null", "[0.1,1e-7,123456789012.5]"]
    for r in spark.createDataFrame([(x,) for x in values], "s string").select("s", canonical.encode_variant(F.try_parse_json("s")).alias("j")).collect():
        assert r["j"] == json.dumps(json.loads(r["s"]), sort_keys=True, separators=(",", ":"))
    assert spark.sql("select '[[[[1]]]]' s").select(canonical.encode_variant(F.try_parse_json("s"))).first()[0] is None


def context_tables(spark, change):
    phases = {"pre_open": at(9, 5), "post_close": at(16, 30)}
    response = {p: market(ROWS) for p in phases}
    stored = [("000001.SZ", "Example", "MAIN", False, False), ("600000.SH", "*ST x", "MAIN", True, True)]
    ids = {"pre_open": 1, "post_close": 2}
    receipts = [[ids[p], "m", response[p], sha(response[p]), phases[p]] for p in phases]
    status = [[code, D, p, "m", ids[p], name, "listed", board, st, sus] for p in phases for code, name, board, st, sus in stored]
    universe = [[code, D, p, "m", ids[p], True] for p in phases for code, *_ in stored]
    records = [[D, p, "m", ids[p], *([t, None, None] if p == "pre_open" else [None, t, t])] for p, t in phases.items()]
    change(receipts, status, universe, records)
    make = lambda rows, kind: spark.createDataFrame([tuple(r) for r in rows], kind)
    key = "date date, phase string, source string, receipt_id long"
    panel = make([["000001.SZ", D], ["600000.SH", D]], "code string, date date")
    return (make(status, f"code string, {key}, name string, listing_status string, board string, is_st boolean, is_suspended boolean"), make(universe, f"code string, {key}, is_member boolean"),
            make(records, f"{key}, decision_available_at timestamp_ntz, outcome_observed_at timestamp_ntz, finalized_at timestamp_ntz"), make(receipts, "receipt_id long, source string, response string, response_sha256 string, observed_at timestamp_ntz"), panel, "m")


def replaced(table, row, column):
    def change(receipts, status, universe, records):
        rows, value = {"r": receipts, "s": status, "u": universe, "c": records}[table], column[1]
        rows[row][column[0]] = value

    return change


@pytest.mark.parametrize(("change", "samples"), [
    (lambda *x: None, set()),
    (replaced("r", 0, (3, "bad")), {"000001.SZ@2024-01-02@pre_open", "600000.SH@2024-01-02@pre_open"}),
    (replaced("r", 0, (3, None)), {"000001.SZ@2024-01-02@pre_open", "600000.SH@2024-01-02@pre_open"}),
    (replaced("s", 0, (8, True)), {"000001.SZ@2024-01-02@pre_open"}),
    (replaced("s", 3, (7, "STAR")), {"600000.SH@2024-01-02@post_close"}),
    (replaced("u", 0, (5, None)), {"000001.SZ@2024-01-02@pre_open"}),
    (replaced("c", 1, (5, at(16, 0))), {"000001.SZ@2024-01-02@post_close", "600000.SH@2024-01-02@post_close"}),
    (lambda r, s, u, c: (r[0].__setitem__(2, "junk"), r[0].__setitem__(3, sha("junk"))), {"000001.SZ@2024-01-02@pre_open", "600000.SH@2024-01-02@pre_open"}),
    (lambda r, s, u, c: u.append(["000002.SZ", D, "pre_open", "m", 1, True]), {"universe@2024-01-02@pre_open"}),
    (lambda r, s, u, c: (r[0].__setitem__(4, at(10)), c[0].__setitem__(4, at(10))), {"000001.SZ@2024-01-02@pre_open", "600000.SH@2024-01-02@pre_open"}),
])
def test_context_readiness(spark, change, samples):
    tables = context_tables(spark, change)
    got = context.context_failures(*tables).collect()
    assert {r["blocker"] for r in got} == ({"invalid_context_receipts"} if samples else set()) and {r["sample"] for r in got} == samples


def test_context_missing_phase(spark):
    tables = context_tables(spark, lambda r, s, u, c: s.pop(3))
    got = {(r["blocker"], r["count"], r["examples"]) for r in context.context_readiness(*tables).collect()}
    assert got == {("missing_finalized_context_rows", 1, "600000.SH@2024-01-02"), ("signed_session_calendar_not_enrolled", 1, "")}


EVENT = {"fields": ["dividOperateDate", "dividPlanAnnounceDate", "cash"], "rows": [["2024-01-05", "2023-12-01", "1.5"]], "year": 2024}


def action_tables(spark, change):
    body = {"symbols": {"000001.SZ": [EVENT, {"year": 2023, "fields": ["a"], "rows": []}], "600000.SH": []}}
    request = {"observation_date": "2024-01-02", "symbols": ["600000.SH", "000001.SZ"], "years": [2023, 2024]}
    payload = json.dumps(dict(sorted(zip(EVENT["fields"], EVENT["rows"][0]))), separators=(",", ":"))
    state = {"response": json.dumps(body), "request": json.dumps(request), "sha": None, "observed": at(9), "available": at(9), "count": 1, "events": [["000001.SZ", D, 7, "a", sha(payload), "2024-01-05", "2023-12-01", payload]]}
    change(state)
    make = spark.createDataFrame
    coverage = make([(c, D, 7, "a", n, state["available"]) for c, n in (("000001.SZ", state["count"]), ("600000.SH", 0))], "code string, date date, receipt_id long, source string, event_count long, available_at timestamp_ntz")
    events = make([(*e, state["available"]) for e in state["events"]], "code string, date date, receipt_id long, source string, event_id string, effective_date string, announcement_date string, payload_json string, available_at timestamp_ntz")
    receipts = make([(7, "a", state["request"], state["response"], state["sha"] or sha(state["response"]), state["observed"])], "receipt_id long, source string, request string, response string, response_sha256 string, observed_at timestamp_ntz")
    return coverage, events, receipts, make([("000001.SZ", D), ("600000.SH", D)], "code string, date date"), "a"


BOTH = {"000001.SZ@2024-01-02", "600000.SH@2024-01-02"}


@pytest.mark.parametrize(("change", "found"), [
    ({}, set()), ({"sha": "bad"}, BOTH), ({"count": 2}, {"000001.SZ@2024-01-02"}), ({"events": []}, {"000001.SZ@2024-01-02"}),
    ({"request": '{"observation_date":"2024-01-02","symbols":["000001.SZ"],"years":[2023,2024]}'}, {"request@2024-01-02"}),
    ({"request": "junk"}, {"request@2024-01-02"}), ({"observed": at(10)}, BOTH), ({"response": "junk"}, {"response@2024-01-02"}),
    ({"response": '{"symbols":{"000001.SZ":[{"fields":["a"],"rows":[[1,2]]}]}}'}, {"response@2024-01-02"}),
])
def test_action_readiness(spark, change, found):
    got = context.action_failures(*action_tables(spark, lambda s: s.update(change))).collect()
    assert {r["sample"] for r in got} == found and {r["blocker"] for r in got} <= {"invalid_corporate_action_receipts"}


def test_actions_after_the_open(spark):
    late = action_tables(spark, lambda s: s.update(observed=at(9, 25), available=at(9, 25)))
    assert {(r["blocker"], r["count"]) for r in context.action_readiness(*late).collect()} >= {("corporate_actions_outside_preopen_cutoff", 2), ("corporate_action_revisions_not_supported", 1)}


def test_full_readiness(spark):
    none = spark.createDataFrame([], "blocker string, count long, examples string")
    got = {(r["component"], r["blocker"]) for r in context.full_readiness(none, none, context.fixed_blockers(spark, ["x"]), none, "qfq").collect()}
    assert got == {(k, v) for k, v in context.UNENROLLED.items()} | {("execution_prices", "execution_prices_require_raw_adjustment"), *((c, "x") for c in ("decision_context", "universe", "instrument_status"))}


GOOD = {
    "trading_calendar": {"decision_cutoff_at": "2024-01-02T09:25:00+08:00", "is_trading_day": True}, "universe": {"is_member": False, "universe_id": SHA},
    "instrument_status": {"is_st": False, "is_suspended": True, "listing_status": "listed"}, "corporate_actions": {"events": [{"announcement_at": "2024-01-01T15:01:00+08:00", "effective_date": "2024-01-05", "event_id": SHA, "event_type": "split"}]},
    "market_rules": {"board": "MAIN", "lot_size": 100, "price_limit_policy_id": SHA, "t_plus_one": True}, "signal_prices": {"any": 1},
}
BAD = [
    ("trading_calendar", {"is_trading_day": False}), ("trading_calendar", {"is_trading_day": "true"}), ("trading_calendar", {"decision_cutoff_at": "2024-13-02T09:25:00+08:00"}), ("universe", {"universe_id": "x"}), ("universe", {"is_member": 1}),
    ("universe", {"more": 1}), ("instrument_status", {"listing_status": "x"}), ("instrument_status", {"is_st": "false"}), ("corporate_actions", {"events": {}}), ("corporate_actions", {"events": [{"event_type": "x"}]}),
    ("corporate_actions", {"events": [GOOD["corporate_actions"]["events"][0] | {"event_type": "x"}]}), ("market_rules", {"lot_size": 0}), ("market_rules", {"lot_size": True}), ("market_rules", {"lot_size": 1.5}), ("market_rules", {"board": ""}), ("market_rules", {"t_plus_one": 0}),
]


def test_payload_validity(spark):
    rows = [(c, json.dumps(p), True) for c, p in GOOD.items()] + [(c, json.dumps(GOOD[c] | p), False) for c, p in BAD] + [("universe", "junk", False), ("universe", None, False), ("signal_prices", "{}", False), ("corporate_actions", '{"events":[]}', True)]
    got = spark.createDataFrame(rows, "component string, payload string, due boolean").withColumn("ok", authority.payload_valid(F.col("component"), F.col("payload"))).collect()
    assert [r for r in got if r["ok"] != r["due"]] == []


def test_adjustment_identity(spark):
    good = {"adjustment_mode": "raw", "adjustment_version": "v", "price_role": "execution", "schema_version": "execution-adjustment-identity/1", "source": "s"}
    cases = [(good, "execution", True), (good, "signal", False), (good | {"adjustment_mode": "qfq"}, "execution", False), (good | {"source": ""}, "execution", False), (good | {"x": 1}, "execution", False), (good | {"schema_version": "x"}, "execution", False), (good | {"price_role": "signal", "schema_version": "signal-adjustment-identity/1", "adjustment_mode": "qfq"}, "signal", True)]
    rows = spark.createDataFrame([(json.dumps(x), role, ok) for x, role, ok in cases], "i string, role string, due boolean")
    for r, (x, _, ok) in zip(rows.withColumn("d", authority.adjustment_identity(F.col("i"), F.col("role"))).collect(), cases, strict=True):
        assert r["d"] == (sha(json.dumps(x, sort_keys=True, separators=(",", ":"))) if ok else None)


def test_signer_interval(spark):
    signers = spark.createDataFrame([("k", "R", ["universe"], at(8), at(10))], "signer string, root string, roles array<string>, valid_from timestamp_ntz, valid_until timestamp_ntz")
    cases = [("k", "R", "universe", at(8), None), ("k", "R", "universe", at(10), None), ("k", "R", "universe", at(10, 1), "outside_authorization"), ("k", "R", "market_rules", at(9), "role_not_authorized"), ("z", "R", "universe", at(9), "unknown_signer"), ("k", "Q", "universe", at(9), "unknown_root"), ("k", "S", "universe", at(9), "signer_of_another_root")]
    envelopes = spark.createDataFrame([x[:4] for x in cases], "signer string, root string, component string, available_at timestamp_ntz")
    got = {(r["signer"], r["root"], r["component"], r["available_at"], r["problem"]) for r in authority.signer_interval(envelopes, signers, spark.createDataFrame([("R",), ("S",)], "root string")).collect()}
    assert got == set(cases)


@pytest.mark.parametrize(("change", "problem"), [
    ({}, None), ({"payload": '{"is_member":1}'}, "invalid_payload"), ({"record_sha256": SHA}, "record_hash_drifted"), ({"source_receipt_ids": []}, "invalid_receipts"), ({"source_receipt_ids": ["c" * 64]}, "unbound_receipt"),
    ({"source_receipt_ids": ["b" * 64, "d" * 64]}, "record_not_bound"), ({"effective_at": at(9, day=dt.date(2024, 1, 3))}, "effective_date_differs"), ({"available_at": at(9, 25)}, "post_cutoff"), ({"panel_entry": "B@2024-01-02"}, "missing_record"),
])
def test_admit_component(spark, change, problem):
    payload = json.dumps(GOOD["universe"])
    row = {"component": "universe", "panel_entry": "A@2024-01-02", "payload": payload, "record_sha256": sha(payload), "source_receipt_ids": ["b" * 64], "effective_at": at(9), "available_at": at(9)} | change
    if "payload" in change:
        row["record_sha256"] = sha(row["payload"])
    records = spark.createDataFrame([tuple(row.values())], "component string, panel_entry string, payload string, record_sha256 string, source_receipt_ids array<string>, effective_at timestamp_ntz, available_at timestamp_ntz")
    bindings = spark.createDataFrame([("b" * 64, "universe", "A@2024-01-02", row["record_sha256"], at(8)), ("d" * 64, "universe", "A@2024-01-02", SHA, at(8))], "receipt string, component string, panel_entry string, record_sha256 string, available_at timestamp_ntz")
    envelopes = spark.createDataFrame([("universe", at(9, 10), "k", "R")], "component string, available_at timestamp_ntz, signer string, root string")
    signers = spark.createDataFrame([("k", "R", ["universe"], at(8), at(10))], "signer string, root string, roles array<string>, valid_from timestamp_ntz, valid_until timestamp_ntz")
    roots = spark.createDataFrame([("R",)], "root string")
    cutoffs = spark.createDataFrame([("A@2024-01-02", at(9, 25))], "panel_entry string, cutoff_at timestamp_ntz")
    panel = spark.createDataFrame([("A@2024-01-02",)], "panel_entry string")
    got = {(r["panel_entry"], r["problem"]) for r in authority.admit_component(records, bindings, envelopes, cutoffs, panel, signers, roots).collect()}
    if problem is None:  # an envelope that nobody may have signed, or none at all
        of = lambda e: {r["problem"] for r in authority.admit_component(records, bindings, e, cutoffs, panel, signers, roots).collect()}
        assert of(envelopes.withColumn("signer", F.lit("z"))) == {"unknown_signer"} and of(envelopes.limit(0)) == {"missing_envelope"}
        assert of(envelopes.withColumn("available_at", F.lit(at(10, 1)))) == {"outside_authorization"}
    assert ("A@2024-01-02", problem) in got and len(got) == 1 + (row["panel_entry"] != "A@2024-01-02")
    assert {r["available_at"] for r in authority.latest_available(records, bindings, envelopes).collect()} == {max(row["available_at"], at(9, 10))}


def test_availability_records(spark):
    panel = spark.createDataFrame([("A", D)], "code string, date date")
    rows = [(c, "A@2024-01-02", SHA, ["b" * 64], at(9), at(9)) for c in ("corporate_actions", "decision_context", "execution_prices", "instrument_status", "market_rules", "signal_prices", "trading_calendar", "universe")]
    kind = "component string, panel_entry string, record_sha256 string, source_receipt_ids array<string>, available_at timestamp_ntz, decision_cutoff_at timestamp_ntz"
    cutoffs, bound = spark.createDataFrame([("A@2024-01-02", at(9))], "panel_entry string, cutoff_at timestamp_ntz"), spark.createDataFrame([("b" * 64,)], "receipt string")
    check = lambda x: {(r["component"], r["problem"]) for r in authority.availability_records(spark.createDataFrame(x, kind).withColumn("effective_at", F.col("available_at")), panel, cutoffs, bound).collect()}
    assert check(rows) == set()
    bad = [*rows[1:], rows[1], ("universe", "B@2024-01-02", SHA, ["b" * 64], at(9), at(9))]
    bad[1] = (*rows[2][:2], "x", ["b" * 64], at(9, 1), at(9))
    assert check(bad) == {("corporate_actions", "missing_record"), ("decision_context", "repeated_record"), ("execution_prices", "invalid_record"), ("execution_prices", "post_cutoff"), ("universe", "outside_panel"), ("universe", "post_cutoff"), ("universe", "cutoff_differs")}
    assert check([(*rows[0][:3], ["c" * 64], at(9), at(9, 30)), *rows[1:]]) == {("corporate_actions", "unbound_receipt"), ("corporate_actions", "cutoff_differs")}


def test_closure_as_elsewhere(spark):
    ref = lambda field, k: {"kind": f"data-{field}", "identifier": sha(f"{field}{k}"), "schema_version": f"{field}/1"}
    single = {f: ref(f, 1) for f in authority.SINGLE}
    receipts = sorted((ref("r", k) for k in range(3)), key=lambda r: r["identifier"])
    whole = {**single, "source_receipts": receipts, "schema_version": "contract/1", "repository_owner": "owner", "required_components": authority.REQUIRED}
    rows = [(f, r) for f, r in single.items()] + [("source_receipts", r) for r in receipts[::-1]]
    cases = {"whole": rows, "few": rows[1:], "twice": [*rows, rows[-1]], "none": rows[:-3], "bad": [*rows[1:], (rows[0][0], rows[0][1] | {"identifier": "x"})]}
    table = spark.createDataFrame([(b, f, r["kind"], r["identifier"], r["schema_version"]) for b, x in cases.items() for f, r in x], "bundle string, field string, kind string, identifier string, schema_version string")
    got = {r["bundle"]: r for r in authority.closure_digest(table, "contract/1", "owner").collect()}
    assert got["whole"]["digest"] == sha(json.dumps(whole, sort_keys=True, separators=(",", ":")))
    assert {b: r["complete"] for b, r in got.items()} == {"whole": True, "few": False, "twice": False, "none": False, "bad": False}


def test_reports(spark):
    down = lambda b, ready, blockers: [(b, c, ready if c == "universe" else True, blockers if c == "universe" else []) for c in authority.REQUIRED]
    components = spark.createDataFrame([*down("ok", True, []), *down("blocked", False, ["x"]), *down("silent", False, []), *down("both", True, ["x"]), *down("omitted", False, ["x"]), *down("few", True, [])[1:]], "bundle string, component string, ready boolean, blockers array<string>")
    totals = spark.createDataFrame([("ok", True, []), ("blocked", False, ["universe"]), ("silent", False, ["universe"]), ("both", True, []), ("omitted", False, ["market_rules"]), ("few", True, [])], "bundle string, ready boolean, blocked array<string>")
    got = {(r["bundle"], r["problem"]) for r in authority.report_consistency(components, totals).collect()}
    assert got == {("silent", "blocked_without_reason"), ("both", "ready_with_blockers"), ("omitted", "blocked_components_omitted"), ("few", "components_differ")}


def test_attested_universe(spark, tmp_path):
    (tmp_path / "records").write_text("one\ntwo\n")
    rows, content = spark.createDataFrame([(D,), (D,)], "date date"), authority.content_sha256(spark, str(tmp_path / "records"))
    check = lambda n, total, x, day=D: {r["problem"] for r in authority.attest_universe(rows, spark.createDataFrame([(D, n)], "date date, declared long"), spark.createDataFrame([(total, x, day, D)], "total long, digest string, start date, end date"), content).collect()}
    assert check(2, 2, sha("one\ntwo\n")) == set() and check(1, 3, "x") == {"daily_count_differs", "total_differs", "digest_differs"}
    assert check(2, 2, sha("one\ntwo\n"), dt.date(2024, 1, 3)) == {"coverage_differs"}


@pytest.mark.parametrize(("change", "problem"), [({}, None), ({"status": "DONE"}, "not_pending"), ({"adjustment_mode": "qfq"}, "not_raw"), ({"outcome_feedback_used": True}, "outcome_not_blind"), ({"sessions": ["2024-01-06", "2024-01-08"]}, "not_a_weekday"), ({"sessions": ["2024-01-03", "2024-01-02"]}, "invalid_sessions"), ({"sessions": ["2024-01-03", "2024-01-04"]}, "not_registered"), ({"panel_sha256": SHA}, "panel_drifted"), ({"workspace_count": None}, "invalid_workspace_count")])
def test_register_panel(spark, change, problem):
    row = {"id": 1, "symbols": ["A", "B"], "sessions": ["2024-01-02", "2024-01-03"], "status": "AWAITING_FULL_SNAPSHOT_READINESS", "adjustment_mode": "raw", "source": "s", "adjustment_version": "v", "outcome_feedback_used": False, "workspace_count": 4, "panel_sha256": None} | change
    row["panel_sha256"] = row["panel_sha256"] or sha(json.dumps(sorted(f"{s}@{d}" for s in row["symbols"] for d in row["sessions"]), separators=(",", ":")))
    rows = spark.createDataFrame([tuple(row.values())], "id long, symbols array<string>, sessions array<string>, status string, adjustment_mode string, source string, adjustment_version string, outcome_feedback_used boolean, workspace_count int, panel_sha256 string")
    assert authority.register_panel_check(rows, "2024-01-02", 2, 2).first()["problem"] == problem


BAR = "code string, date date, source string, adjustment_mode string, adjustment_version string, open double, high double, low double, close double, volume long, receipt_id long, is_final boolean"


def bar(code, day, close=1.0, final=True, source="s", mode="raw"):
    return (code, dt.date(2024, 1, day), source, mode, "v1", close, close, close, close, 100, 1, final)


def test_apply_sync(spark):
    gaps = spark.createDataFrame([(c, dt.date(2024, 1, 2), dt.date(2024, 1, 4)) for c in "ABCDE"], "code string, gap_start date, gap_end date")
    rows = [bar("A", 2), bar("A", 2, 9.0), bar("A", 4), bar("A", 9), bar("B", 2, final=False), bar("C", 3, source="z"), bar("D", 3, final=None, source=None)]
    fetched = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], BAR + ", seq long")
    results, bars, coverage = store.apply_sync(gaps, fetched, "2024-01-02", "2024-01-04", "2024-01-04", ("s", "raw", "v1"))
    assert sorted(map(tuple, results.collect())) == [("A", "synced", 2), ("B", "error", 0), ("C", "error", 0), ("D", "synced", 1), ("E", "no_data", 0)]
    assert sorted((r["code"], r["date"].day, r["close"], r["source"], r["is_final"]) for r in bars.collect()) == [("A", 2, 9.0, "s", True), ("A", 4, 1.0, "s", True), ("D", 3, 1.0, "s", True)]
    assert sorted((r["code"], r["end_date"].day) for r in coverage.collect()) == [("A", 4), ("D", 3), ("E", 3)]


def test_stamped_batch_and_receipts(spark):
    batch = spark.createDataFrame([("A", None, "")], "code string, source string, retrieved_at string")
    assert tuple(store.stamp_batch(batch, "s", "qfq", retrieved_at="now").first()) == ("A", "s", "now", "qfq", "baostock-adjustflag-2")
    with pytest.raises(Exception, match="conflicts"):
        store.stamp_batch(batch.withColumn("source", F.lit("z")), "s", "raw").collect()
    good = '{"source":"s","request":"q","response":"r","observed_at":"t"}'
    land = lambda x: store.land_receipts(spark.createDataFrame([(1, x)], "receipt_id long, json string"), "s").collect()
    assert land(good)[0]["response_sha256"] == sha("r")
    for bad in (good.replace('"s"', '"z"'), good.replace("request", "q"), "junk"):
        with pytest.raises(Exception, match="not a receipt"):
            land(bad)
    with pytest.raises(ValueError, match="ambiguous"):
        store.scan_bars(spark.createDataFrame([bar("A", 2), bar("A", 2, mode="qfq")], BAR), "2024-01-01", "2024-01-05")


def test_announced_at(spark):
    rows = spark.createDataFrame([("", "2024-01-03", None, "2024-01-02")], "a string, b string, c string, d string")
    assert rows.select(checks.announced_at(*map(F.col, "abcd")).alias("x")).first()["x"] == dt.datetime(2024, 1, 2, 15, 1)
    with pytest.raises(Exception, match="announcement"):
        rows.select(checks.announced_at(F.col("a"), F.col("c"))).collect()


def test_snapshots(spark, tmp_path):
    root, bars = str(tmp_path), spark.createDataFrame([bar("A", 2), bar("B", 3), bar("B", 9), bar("B", 4, final=False)], BAR)
    name = artifacts.write_snapshot(bars, root, "2024-01-05", "raw")
    assert artifacts.write_snapshot(bars.repartition(3), root, "2024-01-05", "raw") == name and artifacts.verify_snapshot(spark, root, name) == []
    assert [tuple(r) for r in artifacts.artifact_inventory(spark, root).collect()] == [(name, "snapshot", 2, True)]
    assert artifacts.part_problems(spark, root, name).count() == artifacts.part_problems(spark, root, name, changed_only=True).count() == 0
    part = next(r["part"] for r in artifacts.file_states(spark, root).collect())
    spark.createDataFrame([bar("A", 2)], BAR).write.mode("append").parquet(f"{root}/{name}/rows/{part}")
    assert artifacts.verify_snapshot(spark, root, name) == ["digest_drifted", "count_drifted"]
    only = artifacts.part_problems(spark, root, name, changed_only=True)
    assert [tuple(r) for r in only.collect()] == [(part, "drifted")] and only.inputFiles() and all(part in f for f in only.inputFiles() if "/rows/" in f)
    assert [r["valid"] for r in artifacts.artifact_inventory(spark, root).collect()] == [False]
    with pytest.raises(ValueError, match="not what it says"):
        artifacts.write_snapshot(bars, root, "2024-01-05", "raw")
    with pytest.raises(ValueError, match="ambiguous"):
        artifacts.write_snapshot(bars.unionByName(spark.createDataFrame([bar("A", 2, source="z")], BAR)), root, "2024-01-05", "raw")


def test_execution_and_research_artifacts(spark, tmp_path):
    root = str(tmp_path)
    rows = {k: spark.createDataFrame([(k, D)], "name string, date date") for k in artifacts.EXECUTION_KINDS}
    signed = spark.createDataFrame([("k",)], "key string")
    name = artifacts.write_execution_snapshot(rows, signed, root, "2024-01-02")
    assert artifacts.write_execution_snapshot(rows, signed, root, "2024-01-02") == name and artifacts.verify_execution_snapshot(spark, root, name) == []
    signed.withColumn("key", F.lit("z")).write.mode("overwrite").parquet(f"{root}/{name}/authorities")
    assert artifacts.verify_execution_snapshot(spark, root, name) == ["drifted:authorities"]
    with pytest.raises(ValueError, match="missing artifacts"):
        artifacts.execution_manifest({"universe": rows["universe"]})
    days = spark.createDataFrame([(dt.date(2024, 1, k), k % 2 == 0) for k in (1, 2, 4)], "date date, is_trading_day boolean")
    broken = artifacts.write_research_artifact("calendar", days, f"{root}/research", "cal")
    assert artifacts.verify_research_artifact(spark, "calendar", f"{root}/research", broken) == ["spine_broken"]
    with pytest.raises(ValueError, match="repeated"):
        artifacts.write_research_artifact("calendar", days.unionByName(days), f"{root}/research", "cal")


def test_bootstrap_rows(spark):
    panel, universe = spark.createDataFrame([("A", D)], "code string, date date"), spark.createDataFrame([("A", D), ("B", D), ("C", dt.date(2024, 1, 3))], "code string, date date")
    status = spark.createDataFrame([("A", D, True, "active")], "code string, date date, is_tradable boolean, status string")
    rows = artifacts.bootstrap_rows(universe, status, panel).collect()
    assert sorted(map(tuple, rows)) == [("instrument_status", "A", D, True, "active", False), ("universe", "A", D, None, None, False), ("universe", "B", D, None, None, False)]
    for all_, state, cap, each in ((universe.where("code <> 'A'"), status, 100_000, 10_000), (universe, status.limit(0), 100_000, 10_000), (universe, status, 10_000, 10_000), (universe, status, 2, 1)):
        with pytest.raises(Exception, match="bootstrap"):
            artifacts.bootstrap_rows(all_, state, panel, cap, each).collect()
    with pytest.raises(ValueError, match="empty panel"):
        artifacts.bootstrap_rows(universe, status, panel.limit(0))


def test_warmup_without_dates(spark):
    codes, days = spark.createDataFrame([("A",), ("B",)], "code string"), spark.createDataFrame([(D,), (dt.date(2024, 1, 3),)], "date date")
    assert sorted((r["code"], r["date"].day) for r in panels.warmup_panel(codes, days, "2024-01-09", 2).collect()) == [("A", 2), ("A", 3), ("B", 2), ("B", 3)]
    for few in (days.limit(0), days.limit(1)):
        with pytest.raises(Exception, match="fewer than 2 dates"):
            panels.warmup_panel(codes, few, "2024-01-09", 2).collect()


def test_intervals_and_rules_without_nested_loops(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    calendar = spark.createDataFrame([(day(k),) for k in range(0, 300, 3)], "date date")
    listings = [(k, day(k * 7 % 310 - 20), None if k % 3 == 0 else day(k * 7 % 310 - 20 + k * 11 % 200)) for k in range(60)]
    found = panels.listed_on(spark.createDataFrame(listings, "id int, ipo date, out date"), calendar)
    assert {(r["id"], r["date"]) for r in found.collect()} == {(i, day(k)) for i, a, b in listings for k in range(0, 300, 3) if a <= day(k) and (b is None or day(k) < b)}
    rules = [("r", "M", day(10), 1.0), ("r", "M", day(20), 2.0), ("r", "M", day(20), 1.5), ("q", "M", day(30), None), ("q", "M", day(15), 7.0), ("r", "N", day(0), 9.0)]
    bars = spark.createDataFrame([(c, b, day(k)) for c, b in (("a", "M"), ("b", "M"), ("c", "X")) for k in (5, 10, 19, 20, 31)], "code string, board string, date date")
    held = panels.rules_asof(bars, spark.createDataFrame(rules, "rule string, board string, valid_from date, value double"))
    due = {(k, "r"): 1.0 for k in (10, 19)} | {(k, "r"): 2.0 for k in (20, 31)} | {(k, "q"): 7.0 for k in (19, 20)} | {(31, "q"): None}
    assert {(r["code"], (r["date"] - day(0)).days, r["rule"], r["value"]) for r in held.collect()} == {(c, k, q, x) for c in "ab" for (k, q), x in due.items()}
    for plan in (found, held):
        assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_artifact_references(spark, tmp_path):
    (tmp_path / "files" / "x").mkdir(parents=True)
    (tmp_path / "files" / "x" / "a").write_text("1")
    refs = spark.createDataFrame([("x/a", sha("1")), ("x/b", SHA)], "name string, sha256 string")
    assert [tuple(r) for r in artifacts.verify_artifact_refs(spark, str(tmp_path / "files"), refs).collect()] == [("x/b", "missing")]
    (tmp_path / "files" / "x" / "a").write_text("2")
    assert sorted(tuple(r) for r in artifacts.verify_artifact_refs(spark, str(tmp_path / "files"), refs).collect()) == [("x/a", "drifted"), ("x/b", "missing")]


RECEIPT = "receipt_id long, source string, payload string, response_sha256 string, observed_at timestamp_ntz, retrieved_at timestamp_ntz"


def evidence_of(spark, code="A"):
    payload = '{"fields":"date,open,high,low,close,volume","rows":[["2024-01-02","1","1","1","1","100"]]}'
    return spark.createDataFrame([(1, "s", payload, sha(payload), at(15, 10), at(15, 10))], RECEIPT)


def test_export_execution_panel(spark, tmp_path):
    day = dt.date(2024, 1, 2)
    make = spark.createDataFrame
    bars, panel = make([bar("600519.SH", 2)], BAR), make([("600519.SH", day)], "code string, date date")
    listings, daily = make([("600519.SH", day, None)], "code string, ipo date, out date"), make([("600519.SH", day, True, False)], "code string, date date, is_st boolean, is_suspended boolean")
    actions = make([("600519.SH", day, 1.0, 1.5, at(15, 1), k) for k in (1, 2)] + [("600519.SH", dt.date(2024, 1, 9), 1.0, 1.0, at(15, 1), 3)], "code string, effective_date date, cash double, multiplier double, announced_at timestamp_ntz, seq int")
    universe, rules, signed = make([("600519.SH", day, at(8))], "code string, date date, available_at timestamp_ntz"), make([("fees", "fee_schedule", "{}")], "rule_id string, rule_type string, parameters string"), make([("k",)], "key string")

    def export(name, panel=panel, listings=listings, daily=daily, actions=actions, universe=universe, start="2024-01-02", receipts=evidence_of(spark)):
        six, guards = artifacts.export_execution_panel(bars, receipts, panel, listings, daily, actions, universe, rules, start, "2024-01-02")
        return artifacts.write_execution_snapshot(six, signed, str(tmp_path / name), "2024-01-02", guards)

    name = export("a")
    assert export("a") == name and artifacts.verify_execution_snapshot(spark, str(tmp_path / "a"), name) == []
    assert [x.name for x in (tmp_path / "a").iterdir()] == [name]
    read = lambda kind: [r.asDict() for r in spark.read.parquet(str(tmp_path / "a" / name / kind)).collect()]
    assert read("instrument_status") == [{"code": "600519.SH", "date": day, "listing_status": "listed", "listing_date": day, "board": "MAIN", "is_st": True, "is_suspended": False}]
    assert [(r["multiplier"], r["action_type"]) for r in read("corporate_actions")] == [(1.5, "dividend_and_share_distribution")] and read("signal_prices")[0]["close"] == 1.0
    two = panel.unionByName(make([("000001.SZ", dt.date(2024, 1, 1))], "code string, date date"))
    for more, what in (
        ({"actions": actions.where("seq = 3")}, "no corporate action"), ({"start": "2024-01-01"}, "a panel of"), ({"receipts": evidence_of(spark).limit(0)}, "no evidence"), ({"panel": two}, "no evidence"),
        ({"listings": listings.unionByName(listings)}, "no single listing"), ({"daily": daily.limit(0)}, "no status"), ({"universe": universe.limit(0)}, "no membership"),
    ):
        with pytest.raises(Exception, match=what):
            export("b", **more)
        assert not list((tmp_path / "b").glob("2024*")) and not list((tmp_path / "b").glob("_staged*"))


def test_streams_of_receipts(spark, tmp_path):
    kind = "date date, payload string, observed_at timestamp_ntz"
    rows = [(D, "a", at(15, 30)), (D, "a", at(15, 40)), (D, "b", at(14)), (dt.date(2024, 1, 3), "c", at(16, day=dt.date(2024, 1, 5)))]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    run = lambda df, name: df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    run(jobs.stream_receipts(stream.withColumn("observed_at", F.col("observed_at").cast("timestamp"))), "once")
    assert sorted(r["payload"] for r in spark.table("once").collect()) == ["a", "b", "c"]
    sessions = spark.createDataFrame([(D,), (dt.date(2024, 1, 3),), (dt.date(2024, 1, 4),)], "date date")
    run(jobs.classify_late(stream, sessions), "late")
    assert sorted((r["payload"], r["error"]) for r in spark.table("late").select("payload", F.coalesce("error", F.lit("")).alias("error")).collect()) == [("a", ""), ("a", ""), ("b", "availability_precedes_finalization"), ("c", "post_hoc_availability")]


def test_forward_capture(spark, tmp_path):
    spark.createDataFrame([bar("A", 2)], BAR).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BAR).parquet(str(tmp_path / "in"))
    def run(codes, name, start="2024-01-02", identity=("s", "raw", "v1")):
        return jobs.forward_capture(stream, str(tmp_path / name), str(tmp_path / f"{name}-c"), spark.createDataFrame([(c,) for c in codes], "code string"), evidence_of(spark), start, identity).collect()

    assert run("A", "one") == []
    assert [tuple(r) for r in run("AB", "two")] == [("missing_panel_rows", 1, "B@2024-01-02")]
    for codes, name, more, what in (("B", "three", {}, "outside the cohort"), ("A", "four", {"start": "2024-01-03"}, "before the start"), ("A", "five", {"identity": ("z", "raw", "v1")}, "another price identity"), ("A", "two", {}, "another cohort"), ("A", "six", {"identity": ("s", "qfq", "v1")}, "raw prices")):
        with pytest.raises(Exception, match=what):
            run(codes, name, **more)
