"""Civil time without the session time zone: everything is arithmetic on epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
MINUTE = 60_000_000
DAY = 86_400_000_000
#: stands for "for ever" on a bigint time axis, and its counterpart
FOREVER = 2**63 - 1
EVER = -(2**63)


def floor_div(x: Column, n: int) -> Column:
    """Floor division of a bigint, also for negative numbers."""
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("bigint")


def offset_micros(utc: Column, zone: Column | str) -> Column:
    """Offset of ``zone`` at the instant ``utc`` (epoch microseconds), in microseconds."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone)) - utc


def local_micros(ts: Column, zone: Column | str = NEW_YORK) -> Column:
    """Civil time of the timestamp ``ts`` in ``zone`` as microseconds since 1970 on that clock."""
    u = F.unix_micros(ts)
    return u + offset_micros(u, zone)


def local_date(ts: Column, zone: Column | str = NEW_YORK) -> Column:
    return F.date_from_unix_date(floor_div(local_micros(ts, zone), DAY).cast("int"))


def local_minute(ts: Column, zone: Column | str = NEW_YORK) -> Column:
    """Minute of the civil day, 0 to 1439."""
    return floor_div(F.pmod(local_micros(ts, zone), F.lit(DAY)), MINUTE).cast("int")


def midnight_micros(day: Column, zone: str = NEW_YORK) -> Column:
    """Epoch microseconds of 00:00 of the civil date ``day`` in ``zone`` (zones that shift at night by day)."""
    local = F.unix_date(day).cast("bigint") * F.lit(DAY)
    first = local - offset_micros(local, zone)
    return local - offset_micros(first, zone)


def valid_symbol(symbol: Column) -> Column:
    """One spelling per symbol: upper case, no blanks around, a dot before the class letter."""
    s = F.upper(F.regexp_replace(symbol, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.regexp_replace(s, r"^([A-Z0-9]+)[^A-Z0-9]([A-Z])$", "$1.$2")
