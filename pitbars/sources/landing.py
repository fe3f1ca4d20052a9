"""Raw vendor payloads, landed as text, to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitbars.functions import canonical
from pitbars.functions.checks import bar_valid, event_dates
from pitbars.functions.symbols import market_symbol, normalize_symbol
from pitbars.shared import written


def number(text):
    """A blank or missing number counts as 0."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast("double"), F.lit(0.0))


def land_fields_rows(payloads: DataFrame) -> DataFrame:
    """(code, payload) with {"fields": "date,open,...", "rows": [[...]]} to bars; columns are aligned by name."""
    p = payloads.select("code", F.from_json("payload", "fields string, rows array<array<string>>").alias("p"))
    rows = p.select("code", F.split("p.fields", ",").alias("f"), F.explode("p.rows").alias("r")).select("code", F.map_from_arrays("f", "r").alias("m"))
    pick = lambda name: F.try_element_at("m", F.lit(name))
    return rows.select("code", pick("date").cast("date").alias("date"), *(number(pick(c)).alias(c) for c in ("open", "high", "low", "close", "volume")))


def land_kline_pages(pages: DataFrame, key: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(code, page_no, payload) of `name={"code":0,"data":{symbol:{key:[[date,open,close,high,low,lots],...]}}}`; a later page wins a date.
    A bar that is not valid is an error; start and end bound the dates, both included."""
    text = F.regexp_replace("payload", r"^[^=]*=", "")
    p = pages.select("code", "page_no", F.from_json(text, f"code int, data map<string, struct<`{key}`: array<array<string>>>>").alias("p"))
    checked = p.withColumn("p", F.when(F.col("p.code") == 0, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("page failed for "), "code"))))
    rows = checked.select("code", "page_no", F.explode("p.data").alias("symbol", "d")).select("code", "page_no", F.posexplode(F.col("d").getField(key)).alias("at", "r"))
    price = lambda k: F.get("r", F.lit(k)).cast("double")
    bars = rows.select("code", F.get("r", F.lit(0)).cast("date").alias("date"), F.struct("page_no", "at", price(1).alias("open"), price(3).alias("high"), price(4).alias("low"), price(2).alias("close"), (price(5) * 100).alias("volume")).alias("b"))
    last = bars.groupBy("code", "date").agg(F.max_by("b", F.struct("b.page_no", "b.at")).alias("b"))
    valid = bar_valid(*(F.col(f"b.{c}") for c in ("open", "high", "low", "close", "volume")))
    for bound, inside in ((start, F.col("date") >= F.lit(start)), (end, F.col("date") <= F.lit(end))):
        last = last.where(inside) if bound else last
    return last.where(F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("bad bar for "), "code")))).select("code", "date", *(F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")))


def land_quote_lines(lines: DataFrame) -> DataFrame:
    """(code, line) of `v="a~b~..."`: price 3, previous close 4, open 5, lots 6, time 30, high 33, low 34. Halted or short: no row. A blank
    open, high or low takes the price; one of 0 stays."""
    f = F.split(F.regexp_extract("line", '"(.*)"', 1), "~")
    at = lambda k: F.get("f", F.lit(k)).try_cast("double")
    rows = lines.select("code", f.alias("f")).where((F.size("f") >= 35) & (F.get("f", F.lit(3)) != ""))
    rows = rows.where((at(3) > 0) & (at(6) > 0))
    raw = lambda k: F.coalesce(F.trim(F.get("f", F.lit(k))), F.lit(""))
    rows = rows.where(reduce(lambda a, b: a & b, ((raw(k) == "") | at(k).isNotNull() for k in (5, 33, 34))))  # a price that is no number: no row
    or_price = lambda k: F.coalesce(at(k), at(3))
    return rows.select("code", F.to_date(F.substring(F.get("f", F.lit(30)), 1, 8), "yyyyMMdd").alias("date"), at(3).alias("price"), or_price(5).alias("open"), or_price(33).alias("high"), or_price(34).alias("low"), at(6).alias("lots"))


def plan_year_pages(ranges: DataFrame) -> DataFrame:
    """One page for each calendar year of (key, start, end)."""
    years = ranges.withColumn("y", F.explode(F.sequence(F.year("start"), F.year("end"))))
    return years.select("key", F.greatest("start", F.make_date("y", F.lit(1), F.lit(1))).alias("page_start"), F.least("end", F.make_date("y", F.lit(12), F.lit(31))).alias("page_end"))


def land_tick_frame(frame: DataFrame) -> DataFrame:
    """Terminal bars (code, datetime, open, high, low, close, volume, vol) by date: its first ten characters; volume, else vol, else 0."""
    volume = F.coalesce(*(F.col(c).cast("double") for c in ("volume", "vol") if c in frame.columns), F.lit(0.0))
    rows = frame.select("code", F.substring(F.col("datetime").cast("string"), 1, 10).cast("date").alias("date"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), volume.alias("volume"))
    return rows.orderBy("code", "date")


def land_code_list(lines: DataFrame) -> DataFrame:
    """Codes of a text file (value): trimmed, without blank lines and comments."""
    return lines.select(F.trim("value").alias("code")).where((F.col("code") != "") & ~F.col("code").startswith("#"))


def _must(ok: Column, what: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(what))


def land_jsonl_strict(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines (value, and file, the line's file, and at, its place there: see `numbered`) with exactly the schema's
    keys and types, each once, in order of their canonical form; escaped or spaced differently, a line is the same row.

    rejects: file, at, reason of not_json, wrong_keys, wrong_type, repeated, unsorted (the line before it comes after it)."""
    kind = T.StructType.fromDDL(schema)
    named = {"string": "STRING", "boolean": "BOOLEAN", "bigint": "BIGINT", "int": "BIGINT", "double": "DOUBLE|DECIMAL.*|BIGINT"}
    v = F.try_parse_json("value")
    keys = F.array_sort(F.json_object_keys("value"))
    wrong = reduce(lambda a, b: a | b, (~_kind(_at(v, f"$.{f.name}")).rlike(f"^({named[f.dataType.simpleString()]})$") for f in kind.fields))
    shape = F.when(~_kind(v).startswith("OBJECT"), "not_json").when(~keys.eqNullSafe(F.array(*map(F.lit, sorted(kind.names)))), "wrong_keys").when(wrong, "wrong_type")
    row = F.from_json("value", kind)
    read = lines.select("file", "at", shape.alias("shape"), F.when(shape.isNull(), canonical.encode(row, kind, ascii_only=False)).alias("text"), row.alias("r"))
    # each line meets the one before it: within a cell of lines by a window, across cells by the last line of the cell before
    cell = F.floor(F.col("at") / LINES)
    here = Window.partitionBy("file", "cell").orderBy("at")
    ends = read.groupBy("file", (cell + 1).alias("cell")).agg(F.max_by("text", "at").alias("before"))
    ordered = read.withColumn("cell", cell).join(ends, ["file", "cell"], "left").withColumn("before", F.coalesce(F.lag("text").over(here), F.when(F.row_number().over(here) == 1, F.col("before"))))
    first = read.where("text is not null").groupBy("text").agg(F.min(F.struct("file", "at")).alias("first"))
    judged = ordered.join(first, "text", "left")
    reason = F.coalesce("shape", F.when(F.struct("file", "at") != F.col("first"), "repeated").when(F.col("before") > F.col("text"), "unsorted"))
    judged = judged.withColumn("reason", reason)
    return judged.where("reason is null").select("r.*"), judged.where("reason is not null").select("file", "at", "reason")


#: Lines of a file that are compared within one window.
LINES = 100_000


def numbered(lines: DataFrame) -> DataFrame:
    """Text lines (value) with file and at, their place in it. A file that Spark splits is read in several tasks: `at` counts from the
    lines before each split, known from one row for each split."""
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    read = lines.select("value", split.alias("s"), F.monotonically_increasing_id().alias("id"))
    counts = read.groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = Window.partitionBy("s.file").orderBy("s.start")
    base = counts.select("s", "low", (F.sum("n").over(before) - F.col("n")).alias("base"))
    return read.join(base, "s").select("value", "s.file", (F.col("base") + F.col("id") - F.col("low")).alias("at"))


def land_panel(payloads: DataFrame) -> DataFrame:
    """(code, date) of a list of symbol@date, of {"panel": [...]} or of {"splits": {"search-validation": [...]}} in column payload. An
    empty list, an entry without date, an unknown symbol and a repeated cell are errors."""
    listed = F.coalesce(F.from_json("payload", "array<string>"), F.from_json("payload", "struct<panel: array<string>>")["panel"], F.from_json("payload", "struct<splits: struct<`search-validation`: array<string>>>")["splits"]["search-validation"])
    rows = payloads.withColumn("entries", listed).where(_must(F.size("entries") > 0, F.lit("a panel without samples"))).select(F.explode("entries").alias("entry"))
    parts = F.split("entry", "@")
    cells = rows.where(_must(F.size(parts) == 2, F.concat(F.lit("not a panel sample: "), "entry"))).select(normalize_symbol(parts[0], strict=True).alias("code"), parts[1].cast("date").alias("date"))
    return cells.withColumn("times", F.count("*").over(Window.partitionBy("code", "date"))).where(_must(F.col("times") == 1, F.concat(F.lit("repeated panel sample: "), "code"))).drop("times")


#: A number as text: no names, no suffixes.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def judge_market_pages(receipts: DataFrame) -> DataFrame:
    """(receipt_id, advertised_count, reason, m) of responses {"advertised_count", "raw_pages": [JSON text of a list of rows, ...]}.

    reason is the first that holds, or null: not_json, no_raw_pages, page_not_text, page_not_rows, invalid_symbol, repeated_symbol,
    count_differs. m: the rows (code, name, trade, volume) of a readable response, else null; a symbol of no known market has code null, a
    missing trade or volume is 0, one that is no finite number null. Nothing here raises: a bad receipt is a row with its reason."""
    r = receipts.select("receipt_id", F.try_parse_json("response").alias("v"))
    raw = _at(F.col("v"), "$.raw_pages")
    r = r.select("receipt_id", "v", _kind(F.col("v")).alias("kind"), _kind(raw).alias("held"), F.transform(_at(F.col("v"), "$.raw_pages", "array<string>"), F.try_parse_json).alias("pages"))
    readable = F.when(~F.col("kind").startswith("OBJECT"), "not_json").when(~F.col("held").startswith("ARRAY") | (F.col("held") == "ARRAY<VOID>"), "no_raw_pages").when(F.col("held") != "ARRAY<STRING>", "page_not_text").when(F.exists("pages", lambda p: ~_kind(p).rlike("^ARRAY<(OBJECT|VOID)")), "page_not_rows")

    def number(x: Column, name: str) -> Column:
        text = _at(x, f"$.{name}", "string")
        return F.when(_at(x, f"$.{name}").isNull(), 0.0).when(text.rlike(NUMBER), text.try_cast("double"))

    def row(x: Column) -> Column:
        return F.struct(market_symbol(F.lower(F.trim(_at(x, "$.symbol", "string")))).alias("code"), F.coalesce(_at(x, "$.name", "string"), F.lit("")).alias("name"), number(x, "trade").alias("trade"), number(x, "volume").alias("volume"))

    rows = F.flatten(F.transform("pages", lambda p: F.transform(_at(p, "$", "array<variant>"), row)))
    read = r.withColumn("reason", readable).select("receipt_id", "reason", _at(F.col("v"), "$.advertised_count", "long").alias("advertised_count"), F.when(F.col("reason").isNull(), rows).alias("m"))
    codes, n = F.transform("m", lambda x: x["code"]), F.size("m")
    content = F.when(F.exists(codes, lambda c: c.isNull()), "invalid_symbol").when(F.size(F.array_distinct(codes)) < n, "repeated_symbol").when(F.coalesce(F.col("advertised_count"), n) != n, "count_differs")
    return read.withColumn("reason", F.coalesce("reason", content)).select("receipt_id", "advertised_count", "reason", "m")


def market_rows(judged: DataFrame) -> DataFrame:
    """(receipt_id, code, name, trade, volume) of what judged receipts hold, sound or not."""
    return judged.select("receipt_id", F.explode("m").alias("m")).select("receipt_id", "m.*")


def rejects(judged: DataFrame) -> DataFrame:
    """(receipt_id, reason) of what was not landed."""
    return judged.where("reason is not null").select("receipt_id", "reason")


def land_market_pages(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the rows of receipts without a reason against them, and the others with theirs."""
    judged = judge_market_pages(receipts)
    return market_rows(judged.where("reason is null")), rejects(judged)


#: Reasons against a receipt of actions, the first that holds first.
REASONS = ["not_json", "no_symbols", "unknown_symbol", "batches_not_a_list", "invalid_batch", "row_width", "invalid_event", "invalid_date"]


def _let(x: Column, use) -> Column:
    """use(x), with x evaluated once, however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def judge_action_batches(receipts: DataFrame) -> DataFrame:
    """(receipt_id, reason, receipt, symbol, code, events) of responses {"symbols": {symbol: [{"fields": [...], "rows": [[...], ...]}, ...]}}: a row for
    each symbol, or one without a symbol where a response has none. receipt is the digest of the response.

    reason holds for the whole receipt and is the first of REASONS that does, or null; invalid_event: values nested too deep. events: an
    array of (event_id, effective_date, announcement_date, payload_json); payload_json is the row as canonical JSON, event_id its SHA-256.
    Nothing here raises. A response is parsed once and then dealt out by symbols: no step holds all of its events."""
    r = receipts.select("receipt_id", F.sha2(F.coalesce("response", F.lit("")), 256).alias("receipt"), F.try_parse_json("response").alias("v"))
    r = r.select("receipt_id", "receipt", "v", _at(F.col("v"), "$.symbols", "map<string,variant>").alias("held"))
    unread = F.when(F.col("held").isNull(), F.when(_kind(F.col("v")).startswith("OBJECT"), "no_symbols").otherwise("not_json"))
    dealt = r.select("receipt_id", "receipt", unread.alias("unread"), F.explode_outer("held").alias("symbol", "held")).repartition("receipt_id", "symbol")
    batches = _at(F.col("held"), "$", "array<variant>")
    batch = lambda b: F.struct(_kind(b).startswith("OBJECT").alias("object"), _kind(_at(b, "$.fields")).startswith("ARRAY").alias("named"), _at(b, "$.fields", "array<string>").alias("fields"), _at(b, "$.rows", "array<variant>").alias("rows"))
    s = dealt.select("receipt_id", "receipt", "unread", "symbol", normalize_symbol("symbol").alias("code"), F.transform(batches, batch).alias("batches"))
    cut = F.transform("batches", lambda b: F.struct(b["object"] & b["named"] & b["rows"].isNotNull(), b["fields"], F.transform(b["rows"], lambda x: _at(x, "$", "array<variant>"))).cast("struct<whole: boolean, fields: array<string>, rows: array<array<variant>>>"))
    s = s.select("receipt_id", "receipt", "unread", "symbol", "code", cut.alias("batches"))
    wide = lambda b: F.forall(b["rows"], lambda x: x.isNotNull() & (F.size(x) == F.size(b["fields"])))
    shape = (
        F.when(F.col("unread").isNotNull() | F.col("symbol").isNull(), F.col("unread")).when(F.col("code").isNull(), "unknown_symbol").when(F.col("batches").isNull(), "batches_not_a_list")
        .when(F.exists("batches", lambda b: ~b["whole"]), "invalid_batch").when(F.exists("batches", lambda b: ~wide(b)), "row_width")
    )

    def event(names: Column, values: Column) -> Column:
        at = lambda name: F.size(names) - F.array_position(F.reverse(names), name).cast("int")  # noqa: E731 (of a repeated name, the last)
        text = lambda name: F.nullif(F.trim(_at(F.get(values, at(F.lit(name))), "$", "string")), F.lit(""))
        given = F.array(*(text(n) for n in ("dividOperateDate", "dividPreNoticeDate", "dividAgmPumDate", "dividPlanAnnounceDate")))

        def made(encoded: Column, days: Column) -> Column:
            order = F.array_sort(F.array_distinct(names))
            payload = F.concat(F.lit("{"), F.array_join(F.transform(order, lambda f: F.concat(canonical.string(f), F.lit(":"), F.get(encoded, at(f)))), ","), F.lit("}"))
            effective, announced = event_dates(*(F.get(days, F.lit(k)) for k in range(4)))
            sound = F.forall(F.array_compact(days), lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull())
            return _let(payload, lambda p: F.struct(F.sha2(p, 256).alias("event_id"), effective.alias("effective_date"), announced.alias("announcement_date"), p.alias("payload_json"), (~F.exists(encoded, lambda x: x.isNull())).alias("whole"), F.coalesce(sound, F.lit(False)).alias("dated")))

        return _let(F.transform(values, lambda x: canonical.encode_variant(x, 0)), lambda encoded: _let(given, lambda days: made(encoded, days)))

    events = F.flatten(F.transform("batches", lambda b: F.transform(b["rows"], lambda x: event(b["fields"], x))))
    read = s.withColumn("shape", shape).select("receipt_id", "receipt", "symbol", "code", "shape", F.when(F.col("shape").isNull(), events).alias("events"))
    bad = lambda what: F.exists("events", lambda e: ~e[what])
    own = F.coalesce("shape", F.when(bad("whole"), "invalid_event").when(bad("dated"), "invalid_date"))
    held = written(read.withColumn("own", F.nullif(F.array_position(F.array(*map(F.lit, REASONS)), own), F.lit(0))).drop("shape"), "symbols")
    first = held.groupBy("receipt").agg(F.get(F.array(*map(F.lit, REASONS)), F.min("own").cast("int") - 1).alias("reason"))
    return held.join(first, "receipt").select("receipt_id", "reason", "receipt", "symbol", "code", "events")


def action_reasons(judged: DataFrame) -> DataFrame:
    """(receipt_id, reason) of every judged receipt, sound or not; one given twice alike is one."""
    return judged.select("receipt_id", "receipt", "reason").distinct().drop("receipt")


def action_events(judged: DataFrame) -> DataFrame:
    """A row for each different event of judged receipts without a reason: receipt_id, code, event_id, effective_date, announcement_date,
    payload_json. A symbol without events keeps one row, all null, as its coverage."""
    symbols = judged.where("reason is null and symbol is not null").select("receipt_id", "code", F.explode_outer(F.array_distinct("events")).alias("e"))
    return symbols.select("receipt_id", "code", "e.event_id", "e.effective_date", "e.announcement_date", "e.payload_json")


def land_action_batches(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): the events of receipts without a reason against them, and the others with theirs."""
    judged = judge_action_batches(receipts)
    return action_events(judged), action_reasons(judged).where("reason is not null")
