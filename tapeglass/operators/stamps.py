"""Mixed timestamp formats and time zones to one instant in UTC.

An ordered cascade of anchored patterns reads a value strictly: the first pattern that matches the
whole value decides, and its fields must make a date and a time that exist.  The zone is the value's
own, else the one looked up for its source, else a default.  Civil times that a zone skips or shows
twice are handled by a stated policy.  All of it is Spark expressions on epoch microseconds.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.functions.timeline import DAY, NEW_YORK, offset_micros

# fixed values: months, weekdays, zone names of feeds with their offset in minutes
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
WEEKDAYS = "MON TUE WED THU FRI SAT SUN".split()
FIXED_ZONES = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240}
CIVIL_ZONES = {"ET": NEW_YORK}

_MON, _DOW = "(" + "|".join(MONTHS) + ")", "(" + "|".join(WEEKDAYS) + ")"
_ZONE = r"(Z|UTC|GMT|EST|EDT|ET|[+-]\d\d:?\d\d)"
_TIME = r"(\d\d):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?"
_CLOCK = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?(?: ?([AP]M))?"

#: the cascade: pattern, and the replacement that puts its groups in the order
#: year|month|day|hour|minute|second|fraction|half of day|zone|weekday
CASCADE = [
    (rf"(\d{{4}})-(\d\d)-(\d\d)(?:[T ]{_TIME} ?{_ZONE}?)?", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    (r"(\d{4})(\d\d)(\d\d)(?:(\d\d)(\d\d)(\d\d))?", "$1|$2|$3|$4|$5|$6||||"),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: {_CLOCK}(?: ?{_ZONE})?)?", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?: {_CLOCK}(?: ?{_ZONE})?)?", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (rf"(\d{{1,2}})-{_MON}-(\d{{4}})(?: {_CLOCK}(?: ?{_ZONE})?)?", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (rf"(?:{_DOW}, )?(\d{{1,2}}) {_MON} (\d{{4}})(?: {_TIME} ?{_ZONE}?)?", "$4|$3|$2|$5|$6|$7|$8||$9|$1"),
    (rf"{_MON} (\d{{1,2}}), (\d{{4}})(?: {_CLOCK}(?: ?{_ZONE})?)?", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
]
PLAIN = r"[12]\d{3}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d{1,6})?"
COUNT = r"\d{9,19}(?:\.\d{1,9})?|\d(?:\.\d+)?E\+?\d{1,2}"
#: units of counts since 1970: how many make a second
UNITS = (1, 1_000, 1_000_000, 1_000_000_000)


def zone_table(spark: SparkSession) -> DataFrame:
    """The zone names of the tz database (about 600 rows): zone."""
    return spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string")


def _read(df: DataFrame, value: str, first_year: int, last_year: int, policy: str, utc: bool) -> DataFrame:
    """``df``, with a valid zone name in ``_zone``, plus ``_micros`` and ``_status``.

    Each step is a projection of its own, so that nothing is worked out twice.
    """
    # the commonest form, with its offset or where the default is UTC, is read at once; for the rest of the
    # cascade such a value is null, over which every step passes
    plain, zoned = F.col(value).rlike(f"^{PLAIN}$"), F.col(value).rlike(f"^{PLAIN}(?:Z|[+-]\\d\\d:\\d\\d)$")
    quick = F.when(zoned, F.col(value))
    if utc:
        quick = quick.when(plain, F.concat(F.col(value), F.lit("Z")))
    df = df.withColumn("_quick", F.unix_micros(quick.try_cast("timestamp")))
    v = F.upper(F.regexp_replace(F.col(value), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    df = df.withColumn("_v", F.when(F.col("_quick").isNull(), v))
    canon = None
    for pattern, order in CASCADE:
        hit, out = F.col("_v").rlike(f"^(?:{pattern})$"), F.regexp_replace("_v", f"^(?:{pattern})$", order)
        canon = F.when(hit, out) if canon is None else canon.when(hit, out)
    df = df.withColumn("_part", F.split(canon, r"\|"))
    part = {n: F.col("_part")[i] for i, n in enumerate("year month day hour minute second fraction half zone weekday".split())}
    number = lambda n: F.coalesce(part[n].try_cast("int"), F.lit(0))
    month = F.coalesce(part["month"].try_cast("int"), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part["month"]).cast("int"))
    df = df.withColumns({
        "_y": part["year"].try_cast("int"), "_m": month, "_d": part["day"].try_cast("int"), "_h": number("hour"), "_half": part["half"], "_own": part["zone"], "_w": part["weekday"],
        "_rest": (number("minute") * 60 + number("second")).cast("bigint") * F.lit(1_000_000) + F.coalesce(F.rpad(F.substring(part["fraction"], 1, 6), 6, "0").try_cast("bigint"), F.lit(0)),
        "_clock": number("minute").between(0, 59) & number("second").between(0, 59),
    })
    within = (F.col("_y") >= 1) & F.col("_m").between(1, 12) & (F.col("_d") >= 1)
    hour = F.when(F.col("_half") == "", F.col("_h")).when(~F.col("_h").between(1, 12), F.lit(99)).otherwise(F.col("_h") % 12 + F.when(F.col("_half") == "PM", 12).otherwise(0))
    df = df.withColumns({"_first": F.when(within, F.make_date("_y", F.when(within, F.col("_m")), F.lit(1))), "_hour": hour})
    df = df.withColumn("_days", F.when(F.col("_d") <= F.day(F.last_day("_first")), F.unix_date("_first") + F.col("_d") - 1))
    hh, mm, own = F.substring("_own", 2, 2).try_cast("int"), F.substring("_own", -2, 2).try_cast("int"), F.col("_own")
    signed = F.when((hh <= 18) & (mm <= 59), (hh * 60 + mm) * F.when(own.startswith("-"), -1).otherwise(1))
    offset = F.when(own.rlike(r"^[+-]"), signed)
    for name, minutes in FIXED_ZONES.items():
        offset = offset.when(own == name, F.lit(minutes))
    civil = F.col("_zone")
    for name, z in CIVIL_ZONES.items():
        civil = F.when(own == name, F.lit(z)).otherwise(civil)
    df = df.withColumns({"_local": F.col("_days").cast("bigint") * F.lit(DAY) + F.col("_hour").cast("bigint") * F.lit(3_600_000_000) + F.col("_rest"), "_offset": offset, "_civil": civil})
    # the instants that may show this civil time: read with the offsets well before and well after it
    local, civil = F.col("_local"), F.col("_civil")
    df = df.withColumns({"_b": local - offset_micros(local - F.lit(DAY), civil), "_a": local - offset_micros(local + F.lit(DAY), civil)})
    b, a = F.col("_b"), F.col("_a")
    df = df.withColumns({"_b_ok": b + offset_micros(b, civil) == local, "_a_ok": a + offset_micros(a, civil) == local})
    b_ok, a_ok = F.col("_b_ok"), F.col("_a_ok")
    count = F.when(F.col("_v").rlike(f"^(?:{COUNT})$"), F.col("_v").try_cast("decimal(38,9)"))
    df = df.withColumn("_count", F.when(F.col("_part").isNull(), count))
    unit = F.lit(None).cast("bigint")
    for u in UNITS:
        lo, hi = _year_micros(first_year) * u // 1_000_000, _year_micros(last_year + 1) * u // 1_000_000
        inside = (F.col("_count") >= F.lit(lo)) & (F.col("_count") < F.lit(hi))
        micros = F.col("_count") * F.lit(1_000_000 // u) if u <= 1_000_000 else F.col("_count") / F.lit(u // 1_000_000)
        unit = F.when(inside, F.floor(micros).cast("bigint")).otherwise(unit)
    df = df.withColumn("_unit", unit)
    by_zone = (own == "") | own.isin(*CIVIL_ZONES)
    right_day = (F.col("_w") == "") | (F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(F.date_from_unix_date("_days")) + 1) == F.col("_w"))
    status = (
        F.when(F.col("_quick").isNotNull(), "ok").when(F.col("_v").isNull() | (F.col("_v") == ""), "missing")
        .when(F.col("_part").isNull(), F.when(F.col("_unit").isNotNull(), "ok").otherwise("unreadable"))
        .when(F.col("_days").isNull(), "no_such_date")
        .when(~right_day | ~F.col("_clock") | ~F.col("_hour").between(0, 23), "unreadable")
        .when(by_zone, F.when((b == a) | (b_ok != a_ok), "ok").when(b_ok & a_ok, "ambiguous").otherwise("skipped"))
        .otherwise(F.when(F.col("_offset").isNull(), "unreadable").otherwise("ok"))
    )
    df = df.withColumn("_status", status)
    chosen = {"reject": F.lit(None).cast("bigint"), "earlier": F.least(b, a), "later": F.greatest(b, a)}[policy]
    instant = F.when(F.col("_quick").isNotNull(), F.col("_quick")).when(F.col("_part").isNull(), F.col("_unit")).when(by_zone, F.when(b_ok, b).otherwise(a)).otherwise(local - F.col("_offset").cast("bigint") * F.lit(60_000_000))
    return df.withColumn("_micros", F.when(F.col("_status") == "ok", instant).when(F.col("_status").isin("ambiguous", "skipped"), chosen))


def _year_micros(year: int) -> int:
    return int(dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def normalise_stamps(df: DataFrame, value: str, zone: str | None, default_zone: str = NEW_YORK, policy: str = "reject", first_year: int = 2015, last_year: int = 2026, micros: str = "utc_micros", status: str = "stamp_status") -> DataFrame:
    """``df`` with the columns ``micros`` (epoch microseconds in UTC) and ``status``.

    Status: ``ok``, ``missing`` (null or blank), ``unreadable``, ``no_such_date``, ``skipped`` or
    ``ambiguous`` (civil times), ``unknown_zone``.  Counts since 1970 get the unit that puts them into
    ``first_year`` to ``last_year``.  ``policy`` for civil times a zone skips or shows twice:
    ``reject``, or ``earlier`` or ``later`` (of a repeated time that instant; a skipped time is read
    with the offset that gives it).  Digits beyond microseconds are cut off.

    ``zone``: column with the source's zone name; null or blank means ``default_zone``, a name that is
    not in the tz database gives ``unknown_zone``.  Defined cases: repeated rows stay; columns of
    ``df`` named like the results are replaced; empty input stays empty.  Names that begin with an
    underscore are taken in ``df``.
    """
    if policy not in ("reject", "earlier", "later"):
        raise ValueError(f"no such policy: {policy}")
    columns = [c for c in df.columns if c not in (micros, status)]
    out = df.withColumn("_raw", F.col(value))
    if zone is None:
        out = out.withColumns({"_zone": F.lit(default_zone), "_known": F.lit(True)})
    else:
        names = F.broadcast(zone_table(df.sparkSession).withColumnRenamed("zone", "_name"))  # about 600 names
        blank = F.col(zone).isNull() | (F.trim(zone) == "")
        out = out.withColumn("_want", F.when(blank, F.lit(default_zone)).otherwise(F.trim(zone))).join(names, F.col("_want") == F.col("_name"), "left")
        out = out.withColumns({"_zone": F.coalesce("_name", F.lit("UTC")), "_known": F.col("_name").isNotNull()})
    out = _read(out, "_raw", first_year, last_year, policy, zone is None and default_zone == "UTC")
    lost = ~F.col("_known") & (F.col("_status") != "missing")
    # a later filter must not be pushed through these projections: with every alias written out it
    # would grow beyond bounds.  Spark moves no filter below a column it holds to be indeterminate.
    here = F.monotonically_increasing_id() >= 0
    return out.select(*columns, F.when(here & ~lost, F.col("_micros")).alias(micros), F.when(here, F.when(lost, "unknown_zone").otherwise(F.col("_status"))).alias(status))
