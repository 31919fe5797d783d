"""Recurring times (RFC 5545 rules) as column expressions: whole periods at a time, from the period that the window begins in.

A rule is expanded in local wall-clock time. What a period holds is an array worked out within its row: days that the BY parts
allow, times of these days, positions of the set. No row is made for anything but an occurrence that is asked for, and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
_DAY = "(?:" + "|".join(WEEKDAYS) + ")"
DAY_SECONDS = 86400


def _numbers(low: int, high: int, signed: bool = False) -> str:
    """A pattern of a list of numbers from ``low`` to ``high``, with a sign if the part counts from both ends."""
    one = "|".join(str(n) for n in range(high, low - 1, -1))
    return rf"(?:{'[+-]?' if signed else ''}0*(?:{one}))"


#: Parts of a rule and what one of their values may be.
PARTS = {
    "INTERVAL": r"0*[1-9]\d{0,5}", "COUNT": r"0*[1-9]\d{0,8}", "UNTIL": r"\d{8}(?:T\d{6})?", "WKST": _DAY, "BYDAY": rf"(?:{_numbers(1, 53, True)})?{_DAY}",
    "BYMONTH": _numbers(1, 12), "BYMONTHDAY": _numbers(1, 31, True), "BYYEARDAY": _numbers(1, 366, True), "BYWEEKNO": _numbers(1, 53, True),
    "BYSETPOS": _numbers(1, 366, True), "BYHOUR": _numbers(0, 23), "BYMINUTE": _numbers(0, 59), "BYSECOND": _numbers(0, 59),
}
FREQUENCIES = ("MINUTELY", "HOURLY", "DAILY", "WEEKLY", "MONTHLY", "YEARLY")


def plain_rule(rule: Column) -> Column:
    """A rule in capitals, without its name in front."""
    return F.regexp_replace(F.upper(rule), "^RRULE:", "")


def rrule_valid(rule: Column) -> Column:
    """Whether a rule has one known frequency, each part once at most, and values within their bounds.

    Times by the second, set positions of minutes and hours, easter days, and an UNTIL in another zone than the start's (``Z``)
    are not allowed.
    """
    single = ("INTERVAL", "COUNT", "UNTIL", "WKST")
    parts = [f"{k}={v}" if k in single else f"{k}={v}(?:,{v})*" for k, v in PARTS.items()]
    fits = plain_rule(rule).rlike(rf"^(?:(?:FREQ=(?:{'|'.join(FREQUENCIES)})|{'|'.join(parts)})(?:;(?!$)|$))+$")
    names = F.transform(F.split(plain_rule(rule), ";"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    once = (F.size(names) == F.size(F.array_distinct(names))) & F.array_contains(names, "FREQ")
    fine = ~(plain_rule(rule).rlike("FREQ=(HOURLY|MINUTELY)") & F.array_contains(names, "BYSETPOS"))
    return F.coalesce(fits & once & fine, F.lit(False))


def _part(rule: Column, name: str) -> Column:
    got = F.regexp_extract(rule, rf"(?:^|;){name}=([^;]+)", 1)
    return F.when(got != "", got)


def _ints(rule: Column, name: str) -> Column:
    return F.transform(F.split(_part(rule, name), ","), lambda x: x.cast("int"))


def _or(numbers: Column, default: Column) -> Column:
    return F.coalesce(numbers, F.array(default))


def _weekday(code: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, WEEKDAYS)), code) - 1).cast("int")


def _date(seconds: Column) -> Column:
    """The day of a local time in seconds, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(seconds / DAY_SECONDS).cast("int"))


def _week_start(day: Column, wkst: Column) -> Column:
    return F.date_sub(day, F.pmod(F.weekday(day) - wkst, F.lit(7)).cast("int"))


def _week_number(day: Column, wkst: Column) -> Column:
    """Number of a day's week in the year that has most of the week."""
    middle = F.date_add(_week_start(day, wkst), 3)
    return F.floor((F.dayofyear(middle) - 1) / 7).cast("int") + 1


def _year_days(day: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))


def _from_both_ends(numbers: Column, place: Column, size: Column) -> Column:
    return F.array_contains(numbers, place) | F.array_contains(numbers, (place - size - 1).cast("int"))


def _parsed(rows: DataFrame) -> DataFrame:
    """Columns __* with the parts of ``__rule``; ``__s0`` is the local start in seconds."""
    rule = F.col("__rule")
    codes = F.split(_part(rule, "BYDAY"), ",")
    days = F.transform(codes, lambda x: F.struct(F.regexp_extract(x, r"^[+-]?\d+", 0).try_cast("int").alias("n"), _weekday(F.right(x, F.lit(2))).alias("wd")))
    rows = rows.withColumns({
        "__freq": _part(rule, "FREQ"), "__every": F.coalesce(_part(rule, "INTERVAL").cast("int"), F.lit(1)), "__count": _part(rule, "COUNT").cast("int"),
        "__until": F.unix_seconds(F.to_timestamp(F.rpad(F.replace(_part(rule, "UNTIL"), F.lit("T"), F.lit("")), 14, "0"), "yyyyMMddHHmmss")),
        "__wkst": F.coalesce(_weekday(_part(rule, "WKST")), F.lit(0)), "__d0": _date(F.col("__s0")), "__days": days,
        "__month": F.array_sort(_ints(rule, "BYMONTH")), "__mday": _ints(rule, "BYMONTHDAY"), "__yday": _ints(rule, "BYYEARDAY"), "__weekno": _ints(rule, "BYWEEKNO"),
        "__setpos": _ints(rule, "BYSETPOS"), "__hour": _ints(rule, "BYHOUR"), "__minute": _ints(rule, "BYMINUTE"), "__second": _ints(rule, "BYSECOND"),
    })
    freq, d0 = F.col("__freq"), F.col("__d0")
    free = F.coalesce("__weekno", "__yday", "__mday").isNull() & F.col("__days").isNull()  # days come from the start
    long = freq.isin("MONTHLY", "YEARLY")
    numbered = F.when(long, F.filter("__days", lambda x: x["n"].isNotNull()))
    plain = F.transform(F.filter("__days", lambda x: x["n"].isNull() | ~long), lambda x: x["wd"])
    rows = rows.withColumns({
        "__nth": F.when(F.size(numbered) > 0, numbered), "__in_month": (freq == "MONTHLY") | F.col("__month").isNotNull(),
        "__wd": F.when(free & (freq == "WEEKLY"), F.array(F.weekday(d0))).otherwise(F.when(F.size(plain) > 0, plain)),
        "__month": F.when(free & (freq == "YEARLY"), _or(F.col("__month"), F.month(d0))).otherwise(F.col("__month")),
        "__mday": F.when(free & long, F.array(F.day(d0))).otherwise(F.col("__mday")),
        "__simple": free & F.coalesce("__month", "__hour", "__minute", "__second", "__setpos").isNull() & freq.isin("DAILY", "WEEKLY"),
    })
    second = F.pmod(F.col("__s0"), F.lit(DAY_SECONDS))
    return rows.withColumns({"__h0": F.floor(second / 3600).cast("int"), "__m0": F.floor(second / 60 % 60).cast("int"), "__sec0": (second % 60).cast("int")})


def _fits(d: Column) -> Column:
    """Whether the BY parts allow a day."""
    fine = lambda c, test: F.col(c).isNull() | test
    month_days = F.day(F.last_day(d))
    place = F.when(F.col("__in_month"), F.day(d)).otherwise(F.dayofyear(d))
    size = F.when(F.col("__in_month"), month_days).otherwise(_year_days(d))
    nth = lambda x: (x["wd"] == F.weekday(d)) & ((x["n"] == F.floor((place - 1) / 7) + 1) | (x["n"] == -F.floor((size - place) / 7) - 1))
    weeks = _week_number(F.make_date(F.year(F.date_add(_week_start(d, F.col("__wkst")), 3)), F.lit(12), F.lit(28)), F.col("__wkst"))
    return (
        fine("__month", F.array_contains("__month", F.month(d))) & fine("__mday", _from_both_ends(F.col("__mday"), F.day(d), month_days))
        & fine("__wd", F.array_contains("__wd", F.weekday(d))) & fine("__nth", F.exists("__nth", nth))
        & fine("__yday", _from_both_ends(F.col("__yday"), F.dayofyear(d), _year_days(d)))
        & fine("__weekno", _from_both_ends(F.col("__weekno"), _week_number(d, F.col("__wkst")), weeks))
        & ((F.col("__freq") != "WEEKLY") | (d >= F.col("__d0")))
    )


def _times(d: Column) -> Column:
    """Seconds of a day at which the rule has occurrences, ascending."""
    freq, apart = F.col("__freq"), F.datediff(d, F.col("__d0"))
    all_hours, all_minutes = F.sequence(F.lit(0), F.lit(23)), F.sequence(F.lit(0), F.lit(59))
    fine = lambda c, x: F.col(c).isNull() | F.array_contains(c, x)
    hours = F.when(freq == "MINUTELY", F.filter(all_hours, lambda h: fine("__hour", h))).when(
        freq == "HOURLY", F.filter(all_hours, lambda h: ((apart * 24 + h - F.col("__h0")) % F.col("__every") == 0) & fine("__hour", h))).otherwise(_or(F.col("__hour"), F.col("__h0")))
    on_turn = lambda h, m: ((apart * 24 + h - F.col("__h0")) * 60 + m - F.col("__m0")) % F.col("__every") == 0
    minutes = lambda h: F.when(freq == "MINUTELY", F.filter(all_minutes, lambda m: on_turn(h, m) & fine("__minute", m))).otherwise(_or(F.col("__minute"), F.col("__m0")))
    at = lambda h: F.flatten(F.transform(minutes(h), lambda m: F.transform(_or(F.col("__second"), F.col("__sec0")), lambda s: h * 3600 + m * 60 + s)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hours, at))))


def _period(k: Column) -> Column:
    """Days of the k-th period."""
    freq, d0 = F.col("__freq"), F.col("__d0")
    at = k * F.col("__every")
    week = F.date_add(_week_start(d0, F.col("__wkst")), (at * 7).cast("int"))
    month = F.add_months(F.trunc(d0, "month"), at.cast("int"))
    year = F.year(d0) + at
    whole = lambda first: F.sequence(first, F.last_day(first))
    of_year = lambda m: whole(F.make_date(year.cast("int"), m, F.lit(1)))
    return (
        F.when(freq == "WEEKLY", F.sequence(week, F.date_add(week, 6))).when(freq == "MONTHLY", whole(month))
        .when(freq == "YEARLY", F.flatten(F.transform(F.coalesce("__month", F.sequence(F.lit(1), F.lit(12))), of_year)))
        .otherwise(F.array(F.date_add(d0, F.when(freq == "DAILY", at).otherwise(k).cast("int"))))
    )


def _index(day: Column) -> Column:
    """How many units of the frequency lie between the first period and the period of a day."""
    freq, d0 = F.col("__freq"), F.col("__d0")
    units = (
        F.when(freq == "WEEKLY", F.floor(F.datediff(day, _week_start(d0, F.col("__wkst"))) / 7))
        .when(freq == "MONTHLY", (F.year(day) - F.year(d0)) * 12 + F.month(day) - F.month(d0)).when(freq == "YEARLY", F.year(day) - F.year(d0))
        .otherwise(F.datediff(day, d0))
    )
    return F.floor(units / F.when(freq.isin("HOURLY", "MINUTELY"), 1).otherwise(F.col("__every"))).cast("int")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _occurrences(low: Column, high: Column) -> Column:
    """Local seconds of the occurrences of the periods from that of ``low`` to that of ``high`` (local seconds), at or after the start.

    A rule with COUNT is counted from its first period, unless each period has one occurrence.
    """
    counted = F.col("__count").isNotNull() & ~F.col("__simple")
    first = F.when(counted, 0).otherwise(F.greatest(F.lit(0), _index(_date(low))))
    last = F.least(_index(_date(high)), F.coalesce(_index(_date(F.col("__until"))), _index(_date(high))), F.when(F.col("__simple"), F.col("__count") - 1))
    ks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    second = lambda d: F.transform(_times(d), lambda t: F.unix_date(d).cast("bigint") * DAY_SECONDS + t)

    def of_period(k: Column) -> Column:
        every = F.flatten(F.transform(F.filter(_period(k), _fits), second))
        chosen = lambda a: F.filter(a, lambda x, i: F.exists("__setpos", lambda p: (p == i + 1) | (p == i - F.size(a))))
        return F.when(F.col("__setpos").isNull(), every).otherwise(_let(every, chosen))

    found = F.filter(F.flatten(F.transform(ks, of_period)), lambda x: (x >= F.col("__s0")) & (F.col("__until").isNull() | (x <= F.col("__until"))))
    return F.when(counted, F.slice(found, F.lit(1), F.col("__count"))).otherwise(found)


def expand_rrules(items: DataFrame, start: datetime | None, end: datetime, timezone: str = "UTC", limit: int | None = None) -> DataFrame:
    """``items`` once per occurrence that overlaps [start, end), with ``start`` and ``end`` of the occurrence, ``limit`` of each at most.

    The rule keeps local wall-clock time across clock changes: a time that a change leaves out is an hour later, one that it
    repeats is the earlier one. An occurrence lasts as long as its precision says. Items without a valid rule or without
    start give nothing.
    """
    from palimpsest.operators.tools import default_length

    local = lambda at: F.unix_seconds(F.from_utc_timestamp(at, timezone))
    rows = items.where(rrule_valid(F.col("rrule")) & F.col("occurred_start").isNotNull())
    rows = rows.withColumns({"__rule": plain_rule(F.col("rrule")), "__s0": local(F.col("occurred_start")), "__length": default_length(F.col("precision")).cast("bigint") * 3600})
    rows = _parsed(rows)
    low = F.col("__s0") if start is None else local(F.lit(start)) - F.col("__length") - DAY_SECONDS
    rows = rows.withColumn("__found", F.transform(_occurrences(low, local(F.lit(end)) + DAY_SECONDS), lambda x: F.to_utc_timestamp(F.timestamp_seconds(x), timezone)))
    ends = lambda x: F.timestamp_seconds(F.unix_seconds(x) + F.col("__length"))
    inside = F.filter("__found", lambda x: (x < F.lit(end)) & (F.lit(start is None) | (ends(x) > F.lit(start or end))))
    rows = rows.withColumn("start", F.explode(F.slice(inside, 1, limit) if limit else inside)).withColumn("end", ends(F.col("start")))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def next_occurrence(items: DataFrame, now: datetime, horizon: datetime, timezone: str = "UTC") -> DataFrame:
    """The occurrence of each routine that runs at or comes next after ``now``."""
    return expand_rrules(items, now, horizon, timezone, limit=1)


def expand_shared(items: DataFrame, start: datetime | None, end: datetime, timezone: str = "UTC", limit: int | None = None) -> DataFrame:
    """As ``expand_rrules`` for items many of which share a rule, start and precision: each of these is expanded once and joins its items."""
    from palimpsest.sources.storage import dealt

    keys = ("rrule", "occurred_start", "precision")
    found = expand_rrules(dealt(items.select(*keys), *keys).distinct(), start, end, timezone, limit)
    found = found.select(*(F.col(k).alias(f"__{k}") for k in keys), "start", "end")
    same = (F.col("rrule") == F.col("__rrule")) & (F.col("occurred_start") == F.col("__occurred_start")) & F.col("precision").eqNullSafe(F.col("__precision"))
    return items.drop("start", "end").join(found, same).drop(*(f"__{k}" for k in keys))
