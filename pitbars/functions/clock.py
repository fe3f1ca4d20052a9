"""Point-in-time rules as Column functions. Timestamps are local market time (Asia/Shanghai) unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
#: Fixed values of the four clocks.
FINAL_FROM, AVAILABLE_FROM, PRE_OPEN, OPEN, POST_CLOSE, PRICE_CUTOFF = "16:00:00", "15:00:00", "08:30:00", "09:25:00", "15:00:00", "15:05:00"


def to_local(utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc)


def clock(local: Column) -> Column:
    return F.date_format(local, "HH:mm:ss.SSSSSS")


def latest_finalized_date(local_now: Column) -> Column:
    day = local_now.cast("date")
    return F.when(clock(local_now) >= FINAL_FROM, day).otherwise(F.date_sub(day, 1))


def is_final(day: Column, local_now: Column) -> Column:
    return day <= latest_finalized_date(local_now)


def price_availability_error(day: Column, available: Column, next_session: Column) -> Column:
    """Null where the evidence was there in time."""
    seen = available.cast("date")
    return (
        F.when((seen < day) | ((seen == day) & (clock(available) < AVAILABLE_FROM)), "availability_precedes_finalization")
        .when(seen == day, F.lit(None).cast("string"))
        .when(next_session.isNull(), "unknown_next_session")
        .when((seen != next_session) | (clock(available) >= OPEN), "post_hoc_availability")
    )


def observation_phase(local: Column) -> Column:
    """pre_open, post_close, or null outside both windows."""
    t = clock(local)
    return F.when((t >= PRE_OPEN) & (t < OPEN), "pre_open").when(t >= POST_CLOSE, "post_close")


def capture_admissible(capture_day: Column, local_now: Column) -> Column:
    return (F.weekday(capture_day) < 5) & (capture_day == local_now.cast("date"))


def execution_cutoff_ok(kind: Column, effective: Column, available: Column) -> Column:
    """Both kinds of prices are due by 15:05 of their day, other artifacts by 09:25."""
    day = available.cast("date")
    return (day < effective) | ((day == effective) & (clock(available) <= F.when(kind.isin("execution_prices", "signal_prices"), PRICE_CUTOFF + ".000000").otherwise(OPEN + ".000000")))
