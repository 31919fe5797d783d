"""Dates, routines and blocks of quoted text in words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the wording rules. Fixed values.
WEEKDAYS = {"MO": "Monday", "TU": "Tuesday", "WE": "Wednesday", "TH": "Thursday", "FR": "Friday", "SA": "Saturday", "SU": "Sunday"}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
OPEN, CLOSE = "<<<DATA", "<<<END DATA"
LOOKALIKE = r"(?i)<{2,}\s*(?:/?\s*)?(?:END\s*)?DATA\b[^\n>]*>{0,3}|>{3,}|<{3,}"


def relative(when: Column, now: Column, timezone: str = "UTC") -> Column:
    """``today``, ``tomorrow``, ``12 days ago``, ``in 3 weeks``, by local days; counts round half to even."""
    day = lambda c: F.to_date(F.from_utc_timestamp(c, timezone))
    d = F.datediff(day(when), day(now))
    n = F.abs(d)
    rounded = lambda per: F.bround(n / F.lit(per)).cast("int").cast("string")
    amount = (F.when(n < 14, F.concat(n.cast("string"), F.lit(" days"))).when(n < 60, F.concat(rounded(7.0), F.lit(" weeks")))
              .when(n < 730, F.concat(rounded(30.4), F.lit(" months"))).otherwise(F.concat(rounded(365.25), F.lit(" years"))))
    return (F.when(d == 0, "today").when(d == -1, "yesterday").when(d == 1, "tomorrow")
            .when(d < 0, F.concat(amount, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), amount)))


def clock_time(local: Column) -> Column:
    """``5 pm`` or ``5:30 pm``."""
    hour = ((F.hour(local) + 11) % 12 + 1).cast("string")
    minute = F.when(F.minute(local) == 0, "").otherwise(F.concat(F.lit(":"), F.lpad(F.minute(local).cast("string"), 2, "0")))
    return F.concat(hour, minute, F.when(F.hour(local) < 12, " am").otherwise(" pm"))


def format_when(at: Column, precision: Column, timezone: str = "UTC") -> Column:
    """An absolute date no finer than its precision: ``2027``, ``May 2027``, ``Friday 3 October 2026``, with a time if known."""
    local = F.from_utc_timestamp(at, timezone)
    day = F.date_format(local, "EEEE d MMMM yyyy")
    return (F.when(precision == "year", F.year(local).cast("string")).when(precision == "month", F.date_format(local, "MMMM yyyy"))
            .when(precision == "datetime", F.concat(day, F.lit(", "), clock_time(local))).otherwise(day))


def _named(key: Column, words: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), key)


def joined(words: Column) -> Column:
    """``a, b and c``."""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, 1, n - 1), ", "), F.lit(" and "), F.element_at(words, -1)))


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def rrule_words(rule: Column) -> Column:
    """A recurrence rule in words: ``every Monday and Thursday``, ``on the 15th of every month at 7 am``."""
    field = lambda name: F.regexp_extract(rule, rf"(?:^|[;:]){name}=([^;]*)", 1)
    number = lambda name: F.substring_index(field(name), ",", 1).try_cast("int")
    freq, step = field("FREQ"), F.coalesce(number("INTERVAL"), F.lit(1))
    every = F.when(step == 2, "every other").when(step > 2, F.concat(F.lit("every "), step.cast("string"))).otherwise("every")
    hour, minute = number("BYHOUR"), F.coalesce(number("BYMINUTE"), F.lit(0))
    at = F.when(hour.isNotNull(), F.concat(F.lit(" at "), clock_time(F.make_timestamp(F.lit(2000), F.lit(1), F.lit(1), hour, minute, F.lit(0))))).otherwise("")
    days = F.filter(F.split(field("BYDAY"), ","), lambda d: d != "")
    names = F.transform(days, lambda d: _named(F.substring(d, -2, 2), WEEKDAYS))
    work, end = F.array(*map(F.lit, list(WEEKDAYS.values())[:5])), F.array(*map(F.lit, list(WEEKDAYS.values())[5:]))
    which = F.when(names == work, "weekday").when(names == end, "weekend").when(F.size(names) == 0, "week").otherwise(joined(names))
    nth = F.coalesce(F.regexp_extract(F.get(days, F.lit(0)), r"^([+-]?\d+)", 1).try_cast("int"), number("BYSETPOS"), F.lit(1))
    place = F.when(nth == -1, "last").when(nth == 1, "first").when(nth == 2, "second").when(nth == 3, "third").when(nth == 4, "fourth").otherwise(nth.cast("string"))
    monthly = F.when(F.size(days) > 0, F.concat(F.lit("on the "), place, F.lit(" "), F.get(names, F.lit(0)))).otherwise(
        F.concat(F.lit("on the "), ordinal(F.coalesce(number("BYMONTHDAY"), F.lit(1)))))
    month = F.get(F.array(*map(F.lit, MONTHS)), F.coalesce(number("BYMONTH"), F.lit(1)) - 1)
    yearly = F.when((field("BYMONTHDAY") == "") & (field("BYMONTH") != ""), F.concat(F.lit(" year in "), month)).otherwise(
        F.concat(F.lit(" year on "), F.coalesce(number("BYMONTHDAY"), F.lit(1)).cast("string"), F.lit(" "), month))
    return (F.when(freq == "WEEKLY", F.concat(every, F.lit(" "), which, at)).when(freq == "DAILY", F.concat(every, F.lit(" day"), at))
            .when(freq == "MONTHLY", F.concat(monthly, F.lit(" of "), every, F.lit(" month"), at)).when(freq == "YEARLY", F.concat(every, yearly, at))
            .otherwise(F.concat(F.lit("repeating ("), rule, F.lit(")"))))


def neutralise(text: Column) -> Column:
    """Whatever looks like a delimiter of a data block, with marks that delimit nothing."""
    between, found = F.split(text, LOOKALIKE, -1), F.regexp_extract_all(text, F.lit(LOOKALIKE), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(between, F.transform(found, lambda m: F.translate(m, "<>", "‹›")), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def data_block(label: Column, text: Column) -> Column:
    """A text as quoted data, between delimiters that carry a hash of it, so that no text can hold its own end."""
    clean = neutralise(text)
    tag = F.substring(F.sha2(clean, 256), 1, 12)
    name = F.substring(F.regexp_replace(F.lower(label), "[^a-z0-9 _.-]", ""), 1, 40)
    return F.concat(F.lit(f"{OPEN}:"), tag, F.lit(" label="), name, F.lit(">>>\n"), clean, F.lit(f"\n{CLOSE}:"), tag, F.lit(">>>"))


def well_formed(block: Column) -> Column:
    """Whether a block has one opening and one closing delimiter with one tag."""
    opens = F.regexp_extract_all(block, F.lit(r"<<<DATA:([0-9a-f]{12}) label="), F.lit(1))
    closes = F.regexp_extract_all(block, F.lit(r"<<<END DATA:([0-9a-f]{12})>>>"), F.lit(1))
    return (F.size(opens) == 1) & (opens == closes)
