"""Dates and times as column expressions: local wall clock in, UTC instants out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.recurrence import WEEKDAYS

_DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Hours that parts of the day stand for. Fixed values.
DAY_PARTS = {"morning": 9, "noon": 12, "afternoon": 15, "evening": 19, "night": 21, "midnight": 0}


def local_day(at: Column, timezone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, timezone))


def month_window(start: Column, pad: int, timezone: str) -> Column:
    """(start, end) of the local month of an instant, widened by ``pad`` months on either side."""
    first = F.trunc(local_day(start, timezone), "month")
    utc = lambda d: F.to_utc_timestamp(d.cast("timestamp"), timezone)
    return F.struct(utc(F.add_months(first, -pad)).alias("start"), utc(F.add_months(first, pad + 1)).alias("end"))


def reminder_at(start: Column, precision: Column, lead_minutes: Column, timezone: str) -> Column:
    """When a reminder fires: the lead time before the start; whole-day events count from nine in the morning, local time."""
    nine = F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(local_day(start, timezone).cast("timestamp")) + 9 * 3600), timezone)
    at = F.when(precision == "datetime", start).otherwise(nine)
    return F.timestamp_seconds(F.unix_timestamp(at) - lead_minutes * 60)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _number(word: Column) -> Column:
    words = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "couple": 2, "few": 3}
    out = word.try_cast("int")
    for w, n in words.items():
        out = F.when(word == w, n).otherwise(out)
    return out


def _index(word: Column, names: tuple[str, ...]) -> Column:
    """Place of a name, or of its first three letters, among ``names`` from 1; null if none."""
    out = F.lit(None).cast("int")
    for i, n in enumerate(names, 1):
        out = F.when((word == n) | (word == n[:3]) | ((word == n[:4]) & F.lit(n in ("tuesday", "thursday", "september"))), i).otherwise(out)
    return out


def clock_seconds(text: Column) -> Column:
    """Seconds of the day named in a text (``7:30 pm``, ``7pm``, ``at 19``, ``evening``), or null."""
    t = F.lower(text)
    pattern = r"(?:^|[^\d:])(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
    h12, m12, half = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    hour = h12.try_cast("int") % 12 + F.when(half == "pm", 12).otherwise(0)
    h24, m24 = (F.regexp_extract(t, r"(?:^|[^\d:])([01]?\d|2[0-3]):([0-5]\d)\b", i) for i in (1, 2))
    out = F.lit(None).cast("int")
    for name, at in DAY_PARTS.items():
        out = F.when(t.rlike(rf"\b{name}\b"), at * 3600).otherwise(out)
    out = F.when(h24 != "", h24.try_cast("int") * 3600 + m24.try_cast("int") * 60).otherwise(out)
    return F.when(half != "", hour * 3600 + F.coalesce(m12.try_cast("int"), F.lit(0)) * 60).otherwise(out)


_NUMBERED = r"(?:in )?(\w+) (?:of )?(minute|min|hour|hr|day|week|month|year)s?\b"
_ISO_INSTANT = r"^(\d{4}-\d{2}-\d{2})[t ](\d{1,2}:\d{2}(?::\d{2})?)\s*(z|[+-]\d{2}:?\d{2})?$"


def _step(t: Column) -> Column:
    """Signed number before a unit of time (in, later: ahead; ago, back, earlier: back), or null."""
    sign = F.when(t.rlike(r"\b(ago|back|earlier)\b"), -1).when(t.rlike(r"\bin\b|\bfrom now\b|\blater\b"), 1)
    return _number(F.regexp_extract(t, _NUMBERED, 1)) * sign


def exact_instant(text: Column, now: Column, timezone: str = "UTC") -> Column:
    """The instant of an ISO date and time (local unless it names a zone), or of ``in``/``ago`` n minutes or hours; else null."""
    def read(t: Column) -> Column:
        day, clock, zone = (F.regexp_extract(t, _ISO_INSTANT, i) for i in (1, 2, 3))
        local = F.coalesce(F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd H:mm:ss")), F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd H:mm")))
        shift = F.regexp_extract(zone, r"(\d{2}):?(\d{2})", 1).try_cast("int") * 3600 + F.regexp_extract(zone, r"(\d{2}):?(\d{2})", 2).try_cast("int") * 60
        away = F.when(zone.startswith("-"), -shift).otherwise(F.coalesce(shift, F.lit(0)))
        unit = F.regexp_extract(t, _NUMBERED, 2)
        moved = F.timestamp_seconds(F.unix_timestamp(now) + _step(t) * F.when(unit.isin("hour", "hr"), 3600).otherwise(60))
        iso = F.when(zone == "", F.to_utc_timestamp(local, timezone)).otherwise(F.timestamp_seconds(F.unix_timestamp(local) - away))
        return F.when(day != "", iso).when(unit.isin("minute", "min", "hour", "hr"), moved)

    return let(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), read)


def lead_minutes(text: Column) -> Column:
    """Minutes of a lead time (``30 minutes before``, ``an hour``, ``2 days``), or null."""
    t = F.lower(text)
    per = F.create_map(*[F.lit(x) for kv in {"minute": 1, "min": 1, "hour": 60, "hr": 60, "day": 1440, "week": 10080}.items() for x in kv])
    return _number(F.regexp_extract(t, _NUMBERED, 1)) * F.element_at(per, F.regexp_extract(t, _NUMBERED, 2))


def resolve_time(text: Column, now: Column, timezone: str = "UTC", past: bool = False, lean: str | None = None) -> Column:
    """(start, end, precision, rule) for an expression of time as people write it, or null.

    Rules in order: iso, now-offset (in/ago minutes, hours), relative day, in/ago n days to years, weekday, period
    (this, next, last week, month, year, weekend), day of a named month, month, year. ``lean`` decides which way a
    bare weekday or month points: ``past``, ``future`` or, for months, ``nearest``. A clock time or part of day narrows a
    day to an hour. What several rules need is worked out once.
    """
    lean = lean or ("past" if past else "future")
    days = "|".join([*_DAY_NAMES, "mon", "tues?", "wed", "thu(?:rs)?", "fri", "sat", "sun"])
    months = "|".join([*_MONTH_NAMES, *(m[:3] for m in _MONTH_NAMES), "sept"])

    def parts(t: Column) -> Column:
        number = F.coalesce(
            F.regexp_extract(t, rf"\b(\d{{1,2}})(?:st|nd|rd|th)?(?: of)? (?:{months})\b", 1).try_cast("int"),
            F.regexp_extract(t, rf"\b(?:{months}) (\d{{1,2}})(?:st|nd|rd|th)?\b", 1).try_cast("int"))
        return F.struct(
            t.alias("t"), clock_seconds(t).alias("secs"), _step(t).alias("step"), F.regexp_extract(t, _NUMBERED, 2).alias("unit"),
            _index(F.regexp_extract(t, rf"\b({days})\b", 1), _DAY_NAMES).alias("wd"), _index(F.regexp_extract(t, rf"\b({months})\b", 1), _MONTH_NAMES).alias("mon"),
            number.alias("number"), F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1).try_cast("int").alias("year"),
            F.try_to_date(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)).alias("iso"), F.to_date(F.from_utc_timestamp(now, timezone)).alias("today"))

    def ruled(p: Column) -> Column:
        """(day, end day, precision, rule) by the first rule that fits; an exact instant has no day."""
        t, today, step, unit = p["t"], p["today"], p["step"], p["unit"]
        of = lambda d, e, precision, rule: F.struct(d.cast("date").alias("d"), e.cast("date").alias("e"), F.lit(precision).alias("precision"), F.lit(rule).alias("rule"))
        day = lambda d, rule: of(d, F.lit(None), "day", rule)
        rules: list[tuple[Column, Column]] = [(p["iso"].isNotNull(), day(p["iso"], "iso")), (step.isNotNull() & unit.isin("minute", "min", "hour", "hr"), of(F.lit(None), F.lit(None), "datetime", "now_offset"))]
        for pattern, shift in ((r"\bday before yesterday\b", -2), (r"\bday after tomorrow\b", 2), (r"\byesterday\b|\blast night\b", -1), (r"\btomorrow\b", 1), (r"\btoday\b|\btonight\b|\bthis (morning|afternoon|evening)\b", 0)):
            rules.append((t.rlike(pattern), day(F.date_add(today, shift), "relative_day")))
        rules.append((step.isNotNull() & (unit == "day"), day(F.date_add(today, step), "in_n")))
        rules.append((step.isNotNull() & (unit == "week"), day(F.date_add(today, step * 7), "in_n")))
        rules.append((step.isNotNull() & unit.isin("month", "year"), day(F.add_months(today, step * F.when(unit == "year", 12).otherwise(1)), "in_n")))
        ahead = (p["wd"] - 1 - F.weekday(today) + 7) % 7
        before = F.when(ahead == 0, 7).otherwise(F.lit(7) - ahead)
        move = F.when(t.rlike(r"\bnext\b"), 1).when(t.rlike(r"\b(last|previous)\b"), -1).otherwise(0)
        weekday = F.when(t.rlike(r"\blast\b") | (F.lit(lean == "past") & ~t.rlike(r"\bnext\b")), -before).when(t.rlike(r"\bnext\b") & (ahead == 0), 7).otherwise(ahead)
        rules.append((p["wd"].isNotNull(), day(F.date_add(today, weekday.cast("int")), "weekday")))
        week = F.date_add(F.trunc(today, "week"), (move * 7).cast("int"))
        rules.append((t.rlike(r"\bweekend\b"), of(F.date_add(week, 5), F.date_add(week, 7), "week", "period")))
        rules.append((t.rlike(r"\bweek\b"), of(week, F.date_add(week, 7), "week", "period")))
        month, year = F.add_months(F.trunc(today, "month"), move), F.add_months(F.trunc(today, "year"), move * 12)
        rules.append((t.rlike(r"\bmonth\b"), of(month, F.add_months(month, 1), "month", "period")))
        rules.append((t.rlike(r"\byear\b"), of(year, F.add_months(year, 12), "year", "period")))
        this = F.make_date(F.year(today), p["mon"], F.lit(1))
        off = {"past": F.when(this > today, -1), "future": F.when(F.add_months(this, 1) <= today, 1),
               "nearest": F.when(F.datediff(this, today) > 183, -1).when(F.datediff(this, today) < -183, 1)}[lean]
        first = F.make_date(F.coalesce(p["year"], F.year(today) + F.coalesce(off, F.lit(0))), p["mon"], F.lit(1))
        fits = (p["number"] >= 1) & (p["number"] <= F.day(F.last_day(first)))
        rules.append((p["mon"].isNotNull() & fits, day(F.date_add(first, p["number"] - 1), "day_of_month")))
        rules.append((p["mon"].isNotNull(), of(first, F.add_months(first, 1), "month", "month")))
        jan = F.make_date(p["year"], F.lit(1), F.lit(1))
        rules.append((p["year"].isNotNull(), of(jan, F.add_months(jan, 12), "year", "year")))
        out = F.lit(None)
        for cond, value in reversed(rules):
            out = F.when(F.coalesce(cond, F.lit(False)), value).otherwise(out)
        return F.when(out.isNotNull(), F.struct(out.alias("r"), p["secs"].alias("secs"), step.alias("step"), unit.alias("unit")))

    def instants(x: Column) -> Column:
        r, utc = x["r"], lambda c: F.to_utc_timestamp(c, timezone)
        exact = r["precision"].isin("day") & x["secs"].isNotNull()
        moved = F.timestamp_seconds(F.unix_timestamp(now) + x["step"] * F.when(x["unit"].isin("hour", "hr"), 3600).otherwise(60))
        clock = utc(F.timestamp_seconds(F.unix_timestamp(r["d"].cast("timestamp")) + x["secs"]))
        start = F.when(r["precision"] == "datetime", moved).when(exact, clock).otherwise(utc(r["d"].cast("timestamp")))
        whole = utc(F.coalesce(r["e"], F.date_add(r["d"], 1)).cast("timestamp"))
        short = exact | (r["precision"] == "datetime")
        return F.when(x.isNotNull(), let(start, lambda s: F.struct(
            s.alias("start"), F.when(short, F.timestamp_seconds(F.unix_timestamp(s) + 3600)).otherwise(whole).alias("end"),
            F.when(short, "datetime").otherwise(r["precision"]).alias("precision"), r["rule"].alias("rule"))))

    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return let(let(let(plain, parts), ruled), instants)


def routine_rule(text: Column) -> Column:
    """An RRULE for an English routine (``every monday``, ``every two weeks``, ``daily``, ``on weekdays``), or null."""
    t = F.lower(text)
    days = F.transform(F.regexp_extract_all(t, F.lit(r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)s?\b"), 1), lambda d: F.upper(F.substring(d, 1, 2)))
    order = F.filter(F.array(*map(F.lit, WEEKDAYS)), lambda d: F.array_contains(days, d))
    n = F.when(t.rlike(r"\bevery other\b|\bfortnight"), 2).otherwise(_number(F.regexp_extract(t, r"\bevery (\w+) (?:day|week|month|year)s\b", 1)))
    every = F.when(n > 1, F.concat(F.lit(";INTERVAL="), n.cast("string"))).otherwise("")
    freq = (F.when(t.rlike(r"\bdays?\b|\bdaily\b"), "DAILY").when(t.rlike(r"\bweeks?\b|\bweekly\b|\bfortnight"), "WEEKLY")
            .when(t.rlike(r"\bmonths?\b|\bmonthly\b"), "MONTHLY").when(t.rlike(r"\byears?\b|\byearly\b|\bannually\b"), "YEARLY"))
    repeats = t.rlike(r"\b(every|each|daily|weekly|monthly|yearly|annually|fortnightly)\b") | t.rlike(r"days\b")
    return F.when(t.rlike(r"\bweekdays?\b"), "FREQ=WEEKLY;BYDAY=MO,TU,WE,TH,FR").when(t.rlike(r"\b(every|each) weekend\b|\bweekends\b"), "FREQ=WEEKLY;BYDAY=SA,SU").when(
        repeats & (F.size(order) > 0), F.concat(F.lit("FREQ=WEEKLY"), every, F.lit(";BYDAY="), F.array_join(order, ","))).when(
        repeats & freq.isNotNull(), F.concat(F.lit("FREQ="), freq, every))
