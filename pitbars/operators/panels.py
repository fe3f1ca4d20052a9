"""Set algebra of panels, cohorts, listings and dated rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The components every panel cell needs evidence for.
COMPONENTS = ["corporate_actions", "decision_context", "execution_prices", "instrument_status", "market_rules", "signal_prices", "trading_calendar", "universe"]


def panel_product_missing(panel: DataFrame) -> DataFrame:
    """Cells of symbols x dates that the panel lacks. The product is the definition of a full panel."""
    return panel.select("code").distinct().crossJoin(panel.select("date").distinct()).join(panel, ["code", "date"], "left_anti")


def warmup_panel(codes: DataFrame, train_dates: DataFrame, first_search: str, n: int) -> DataFrame:
    """Codes crossed with the last n training dates before the first search date; fewer dates, none among them, are an error."""
    before = train_dates.where(F.col("date") < F.lit(first_search).cast("date")).select("date").distinct().orderBy(F.col("date").desc()).limit(n)
    found = before.agg(F.collect_list("date").alias("dates"))  # one row, n dates at most
    sure = F.when(F.size("dates") == n, F.col("dates")).otherwise(F.raise_error(F.lit(f"fewer than {n} dates before {first_search}")))
    return codes.select("code").distinct().crossJoin(found).select("code", F.explode(sure).alias("date"))


def component_grid(panel: DataFrame, records: DataFrame) -> DataFrame:
    """(component, code, date, times) of cells that have no record or several. Components are counted side by side: a cell is one row until
    what it lacks or repeats is told."""
    counted = records.groupBy("code", "date").agg(*(F.count(F.when(F.col("component") == c, 1)).alias(f"_{c}") for c in COMPONENTS))
    times = F.array(*(F.struct(F.lit(c).alias("component"), F.coalesce(f"_{c}", F.lit(0).cast("long")).alias("times")) for c in COMPONENTS))
    odd = F.filter(times, lambda x: x["times"] != 1)
    return panel.select("code", "date").join(counted, ["code", "date"], "left").select("code", "date", F.explode(odd).alias("x")).select("x.component", "code", "date", "x.times")


#: Days of a bin of the interval join, and copies of each calendar day over which codes are dealt.
BIN, SALTS = 64, 16


def listed_on(listings: DataFrame, days: DataFrame) -> DataFrame:
    """Half-open listing interval: ipo <= day, and day < out where there is one. An equality join on bins of days: an interval is in each
    bin it touches, up to the calendar's last day."""
    span = lambda day: F.floor(F.unix_date(day) / BIN)
    last = days.select(F.max("date")).scalar()
    dealt = days.withColumns({"_bin": span(F.col("date")), "_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    until = F.least(F.coalesce(F.date_sub("out", 1), last), last)
    own = listings.where(F.col("ipo") <= until).withColumns({"_bin": F.explode(F.sequence(span(F.col("ipo")), span(until))), "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    return own.join(dealt, ["_bin", "_salt"]).where((F.col("date") >= F.col("ipo")) & (F.col("out").isNull() | (F.col("date") < F.col("out")))).drop("_bin", "_salt")


def rules_asof(bars: DataFrame, rules: DataFrame) -> DataFrame:
    """The value of each (rule, board) that holds on a bar's date; a rule holds until the next one of its kind. Of two of one kind and day the
    larger value holds.

    Rules and the different (board, date) of the bars are one table, in which each cell takes the last rule before or on it; bars then
    join their cell, so a window holds the days of one kind of rule, however many bars there are."""
    kinds = rules.select("rule", "board").distinct()
    cells = bars.select("board", "date").distinct().join(kinds, "board")
    known = rules.select("rule", "board", F.col("valid_from").alias("date"), F.struct("valid_from", "value").alias("own"))
    both = known.unionByName(cells.withColumn("own", F.lit(None).cast(known.schema["own"].dataType)))
    order = Window.partitionBy("rule", "board").orderBy("date", F.col("own").isNull(), F.col("own.value")).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("held", F.last("own", ignorenulls=True).over(order)).where("own is null and held is not null").select("board", "date", "rule", "held.value", "held.valid_from")
    return bars.join(held, ["board", "date"])


def daily_record_counts(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """Dates whose number of rows is not the declared one."""
    counted = rows.groupBy("date").agg(F.count("*").alias("found"))
    return counted.join(declared, "date", "full_outer").na.fill(0, ["found", "declared"]).where("found <> declared")


def duplicate_records(rows: DataFrame, digest) -> DataFrame:
    return rows.groupBy(digest.alias("record_sha256")).agg(F.count("*").alias("times")).where("times > 1")
