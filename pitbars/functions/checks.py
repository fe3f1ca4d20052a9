"""Validity predicates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def valid_panel_entry(x: Column) -> Column:
    parts = F.split(x, "@")
    day = F.get(parts, 1)
    return F.coalesce((F.size(parts) == 2) & (F.get(parts, 0) != "") & day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).isNotNull(), F.lit(False))


def valid_tz_timestamp(x: Column) -> Column:
    """An existing local time with an explicit offset, in the one form that it is printed in again."""
    shape = x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?[+-]([01]\d|2[0-3]):[0-5]\d$") & ~x.rlike(r"\.000000|-00:00$")
    return F.coalesce(shape & F.try_to_timestamp(F.substring(x, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.lit(False))


def bar_valid(open_: Column, high: Column, low: Column, close: Column, volume: Column) -> Column:
    prices = [open_, high, low, close]
    ok = (volume >= 0) & ~F.isnan(volume)
    for p in prices:
        ok = ok & (p > 0) & ~F.isnan(p) & (p < float("inf"))
    return F.coalesce(ok, F.lit(False))


def filled_identity(source: Column, mode: Column, version: Column) -> list[Column]:
    """Blank or missing parts of a price identity get their legacy names."""
    pick = lambda c, name: F.coalesce(F.nullif(c, F.lit("")), F.lit(name))
    return [pick(source, "legacy_unknown"), pick(mode, "unknown"), pick(version, "legacy_unknown")]


def filled_state(retrieved_at: Column, is_final: Column, loaded_at: Column) -> list[Column]:
    """retrieved_at, the load time where it is blank; is_final, true where it is missing."""
    return [F.coalesce(F.nullif(retrieved_at, F.lit("")), loaded_at), F.coalesce(is_final, F.lit(True))]


def announced_at(*announced: Column) -> Column:
    """The earliest non-blank of the fields at 15:01 local time, as exports stamp it; none is an error."""
    first = F.array_min(F.filter(F.array(*announced), lambda x: x.isNotNull() & (x != "")))
    return F.when(first.isNull(), F.raise_error("an event without an announcement date")).otherwise((F.concat(first, F.lit(" 15:01:00"))).cast("timestamp_ntz"))


def event_dates(operate: Column, *announced: Column) -> tuple[Column, Column]:
    """(effective, announcement): the announcement is the earliest non-blank of its fields."""
    return F.nullif(operate, F.lit("")), F.array_min(F.filter(F.array(*announced), lambda x: x.isNotNull() & (x != "")))


def action_terms(stock: Column, reserve: Column) -> tuple[Column, Column]:
    """(multiplier, type) from share ratios written as text; blank counts as 0, anything else that is no number is an error."""
    number = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")).cast("double"), F.lit(0.0))
    multiplier = 1 + number(stock) + number(reserve)
    return multiplier, F.when(multiplier == 1, "cash_dividend").otherwise("dividend_and_share_distribution")
