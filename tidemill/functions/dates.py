"""Calendar periods and local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from a period's start to that of the period it is compared with; a month goes by calendar months.
PREVIOUS_DAYS = {"week": 7, "day": 7}


def period_start(ts: Column, period: str) -> Column:
    """``month``: the 1st; ``week``: Monday; ``day``: the date."""
    return F.to_date(F.date_trunc(period, ts))


def previous_start(start: Column, period: str) -> Column:
    return F.add_months(start, -1) if period == "month" else F.date_sub(start, PREVIOUS_DAYS[period])


def local(ts: Column, zone: Column, zones: list[str]) -> Column:
    """Local time in an IANA zone; UTC if the zone isn't one of ``zones``."""
    return F.from_utc_timestamp(ts, F.when(zone.isin(zones), zone).otherwise("UTC"))
