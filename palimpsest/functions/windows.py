"""Recall windows: the half-open span that a time expression of a question asks for.

Two tables say what an expression can look like: FORMS for spans on the calendar, BESIDE for spans beside an event. A row has
a pattern and the two ends of its span as names of instants; the first row that fits counts. Whatever the number of rows, the
expression that reads a calendar phrase stands in the plan once.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.times import let, local_day, resolve_time

# Words of time expressions, hours of the parts of a day, days of a counted unit, and days that vague words mean. Fixed values.
PARTS = {"morning": (5, 12), "afternoon": (12, 17), "evening": (17, 21), "night": (21, 29)}
UNIT_DAYS = {"day": 1, "week": 7, "fortnight": 14, "month": 30, "year": 365}
BESIDE_DAYS = {"day": 1, "week": 7, "month": 30}
VAGUE_DAYS = 30
ALWAYS = ("ever", "all time", "any time", "anytime", "always")
SOON = ("upcoming", "coming up", "soon", "ahead", "in the future", "later")
LATELY = ("recently", "lately", "of late", "these days")
BACK, AHEAD = ("last", "past", "previous"), ("next", "coming", "following")
UNTIL = ("until", "till", "up to", "by")
LINKS = ("and", "to", "until", "till")
AT_IT, EARLIER, LATER = ("", "during", "at", "on", "when", "in", "at the time", "the same time"), ("before", "earlier", "prior"), ("after", "later", "afterwards")
LEADING = ("on", "at", "in the", "in", "the", "around", "about", "during")

SPAN = "struct<start:timestamp,end:timestamp,rule:string>"


class Row(NamedTuple):
    """``start`` and ``end`` name instants: now, now-n, now+n, a phrase's start or end (1.start, 2.end), or an event's; None is open."""

    rule: str
    pattern: str
    start: str | None
    end: str | None


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_UNIT = "(" + "|".join(UNIT_DAYS) + ")s?"
_N = r"(?:the )?{} {}" + _UNIT
FORMS = (
    Row("open", _any(ALWAYS), None, None),
    Row("upcoming_30_days", _any(SOON), "now", "now+vague"),
    Row("recent_30_days", _any(LATELY), "now-vague", "now"),
    Row("between", f"(?:between|from) (.+?) {_any(LINKS)} (.+)", "1.start", "2.end"),
    Row("since_", "since (.+)", "1.start", "1.since"),
    Row("before_", "before (.+)", None, "1.start"),
    Row("after_", "after (.+)", "1.end", None),
    Row("until_", f"{_any(UNTIL)} (.+)", None, "1.end"),
    Row("last_", _N.format(_any(BACK), r"(\d+) "), "now-n", "now"),
    Row("next_", _N.format(_any(AHEAD), r"(\d+) "), "now", "now+n"),
    Row("last_", _N.format(_any(tuple(w for w in BACK if w != "last")), "()"), "now-n", "now"),
    Row("next_", _N.format("following", "()"), "now", "now+n"),
    Row("", "(.+)", "1.start", "1.end"),
)
_BESIDE_UNIT = r"(?:the )?(?:(\d+) )?(" + "|".join([*BESIDE_DAYS, "weekend"]) + r")s?"
BESIDE = (
    Row("anchor_during", _any(AT_IT), "event.start", "event.end"),
    Row("anchor_before", _any(EARLIER), None, "event.start"),
    Row("anchor_after", _any(LATER), "event.end", None),
    Row("anchor_since", "since", "event.start", "now"),
    Row("anchor_n_before", _BESIDE_UNIT + " before", "event.first-n", "event.first"),
    Row("anchor_n_after", _BESIDE_UNIT + " after", "event.last", "event.last+n"),
)


def _hours(at: Column, n: Column | int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(at) + n * 3600)


def _pick(key: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _span(start: Column, end: Column, rule: Column) -> Column:
    return F.struct(start.cast("timestamp").alias("start"), end.cast("timestamp").alias("end"), rule.alias("rule"))


def _phrase(text: Column, now: Column, timezone: str, direction: str) -> Column:
    """The span of a calendar phrase: a part of a day, or what ``resolve_time`` makes of it; null if neither."""
    part = r"^(?:(this|yesterday|today|tomorrow|last|to)\s?)?(morning|afternoon|evening|night)$"
    name, day = F.regexp_extract(text, part, 2), F.regexp_extract(text, part, 1)
    offset = F.when(day.isin("yesterday", "last"), -1).when(day == "tomorrow", 1).otherwise(0)
    midnight = F.to_utc_timestamp(F.date_add(local_day(now, timezone), offset).cast("timestamp"), timezone)
    of_day = _span(_hours(midnight, _pick(name, {k: v[0] for k, v in PARTS.items()})), _hours(midnight, _pick(name, {k: v[1] for k, v in PARTS.items()})), F.concat(F.lit("part_of_day_"), name))
    bare = F.regexp_replace(text, f"^{_any(LEADING)} ", "")
    lean = {"past": "past", "future": "future"}.get(direction, "nearest")
    resolved = let(let(bare, lambda b: resolve_time(b, now, timezone, lean=lean)), lambda x: F.when(x.isNotNull(), _span(x["start"], x["end"], x["rule"])))
    return F.when(name != "", of_day).otherwise(resolved)


def _first_row(text: Column, table: tuple[Row, ...]) -> Column:
    """The number of the first row that fits, or null."""
    out = F.lit(None).cast("int")
    for i, row in reversed(list(enumerate(table))):
        out = F.when(text.rlike(f"^{row.pattern}$"), i).otherwise(out)
    return out


def _choose(number: Column, table: tuple[Row, ...], f) -> Column:  # noqa: ANN001
    out = F.lit(None)
    for i, row in reversed(list(enumerate(table))):
        out = F.when(number == i, f(row)).otherwise(out)
    return out


def _group(text: Column, number: Column, table: tuple[Row, ...], group: int) -> Column:
    has = [row.pattern.replace("(?:", "").count("(") >= group for row in table]
    return _choose(number, table, lambda row: F.regexp_extract(text, f"^{row.pattern}$", group) if has[table.index(row)] else F.lit(""))


def _on_calendar(rows: DataFrame, at: Column, timezone: str, direction: str) -> DataFrame:
    """``rows(__t)`` with ``window`` by FORMS."""
    rows = rows.withColumn("__form", _first_row(F.col("__t"), FORMS))
    first, second = (_group(F.col("__t"), F.col("__form"), FORMS, g) for g in (1, 2))
    rows = rows.withColumn("__p1", first).withColumn("__p2", second)
    # "between 1 and 7 September" names the month once
    shared = F.col("__p1").rlike(r"^\d{1,2}$") & F.col("__p2").rlike(r"^\d{1,2} [a-z]")
    rows = rows.withColumn("__p1", F.when(shared, F.concat("__p1", F.lit(" "), F.regexp_replace("__p2", r"^\d{1,2} ", ""))).otherwise(F.col("__p1")))
    both = F.transform(F.array("__p1", "__p2"), lambda p: F.when(p != "", _phrase(p, at, timezone, direction)))
    rows = rows.withColumn("__both", both)
    a, b = F.get("__both", F.lit(0)), F.get("__both", F.lit(1))
    n = F.coalesce(F.col("__p1").try_cast("int"), F.lit(1)) * _pick(F.col("__p2"), UNIT_DAYS) * 24
    none = F.lit(None).cast("timestamp")
    instants = {
        None: none, "now": at, "now+vague": _hours(at, VAGUE_DAYS * 24), "now-vague": _hours(at, -VAGUE_DAYS * 24), "now+n": _hours(at, n), "now-n": _hours(at, -n),
        "1.start": a["start"], "1.end": a["end"], "2.end": b["end"], "1.since": F.when(a["start"].isNull() | (a["start"] < at), at)}
    counted = F.concat(F.coalesce(F.nullif(F.col("__p1"), F.lit("")), F.lit("1")), F.lit("_"), F.col("__p2"), F.lit("s"))

    def fits(row: Row) -> Column:
        if row.rule == "between":
            return a["start"].isNotNull() & b.isNotNull()
        return a.isNotNull() if {"1.start", "1.end"} & {row.start, row.end} else F.lit(True)

    def rule(row: Row) -> Column:
        if row.rule and not row.rule.endswith("_"):
            return F.lit(row.rule)
        return F.concat(F.lit(row.rule), counted if "n" in (row.start or "")[3:] + (row.end or "")[3:] and "now" in (row.start, row.end) else a["rule"])

    start = _choose(F.col("__form"), FORMS, lambda row: at if row.rule == "until_" and direction == "future" else instants[row.start])
    span = _span(start, _choose(F.col("__form"), FORMS, lambda row: instants[row.end]), _choose(F.col("__form"), FORMS, rule))
    return rows.withColumn("window", F.when(_choose(F.col("__form"), FORMS, fits), span)).drop("__form", "__p1", "__p2", "__both")


def _beside_event(rows: DataFrame, at: Column, timezone: str) -> DataFrame:
    """``rows(__t, anchor_start, anchor_end, window)`` with ``window`` by BESIDE where there is an event."""
    utc = lambda d: F.to_utc_timestamp(d.cast("timestamp"), timezone)
    said = F.regexp_replace("__t", " (it|that|then|this)$", "")
    rows = rows.withColumn("__s", said).withColumn("__form", _first_row(F.col("__s"), BESIDE))
    rows = rows.withColumn("__first", local_day(F.col("anchor_start"), timezone))
    rows = rows.withColumn("__stop", F.when(F.col("anchor_end") > F.col("anchor_start"), F.col("anchor_end")).otherwise(utc(F.date_add("__first", 1))))
    rows = rows.withColumn("__last", local_day(F.timestamp_micros(F.unix_micros("__stop") - 1), timezone))
    number, unit = (_group(F.col("__s"), F.col("__form"), BESIDE, g) for g in (1, 2))
    rows = rows.withColumn("__unit", unit).withColumn("__n", F.coalesce(number.try_cast("int"), F.lit(1)) * F.coalesce(_pick(F.col("__unit"), BESIDE_DAYS), F.lit(0)))
    # days to the Saturday before the first and after the last day of the event, 1 to 7
    back, ahead = F.pmod(F.weekday("__first") + 1, F.lit(7)) + 1, F.pmod(F.lit(4) - F.weekday("__last"), F.lit(7)) + 1
    weekend = F.when(F.col("__s").endswith("before"), F.date_sub("__first", back.cast("int"))).otherwise(F.date_add("__last", ahead.cast("int")))
    instants = {
        None: F.lit(None).cast("timestamp"), "now": at, "event.start": F.col("anchor_start"), "event.end": F.col("__stop"),
        "event.first-n": utc(F.date_sub("__first", F.col("__n").cast("int"))), "event.first": utc(F.col("__first")),
        "event.last": utc(F.date_add("__last", 1)), "event.last+n": utc(F.date_add("__last", (F.col("__n") + 1).cast("int")))}
    start, end = (_choose(F.col("__form"), BESIDE, lambda row, i=i: instants[row[i]]) for i in (2, 3))
    rule = _choose(F.col("__form"), BESIDE, lambda row: F.lit(row.rule))
    named = F.when(F.col("__unit") != "", F.concat(F.lit("anchor_"), "__unit", F.lit("_"), F.regexp_extract("__s", "(before|after)$", 1))).otherwise(rule)
    is_weekend = F.col("__unit") == "weekend"
    span = _span(F.when(is_weekend, utc(weekend)).otherwise(start), F.when(is_weekend, utc(F.date_add(weekend, 2))).otherwise(end), named)
    window = F.when(F.col("anchor_start").isNull(), F.col("window")).otherwise(F.when(F.col("__form").isNotNull(), span))
    return rows.withColumn("window", window).drop("__s", "__form", "__first", "__stop", "__last", "__unit", "__n")


def recall_windows(rows: DataFrame, now: datetime, text: str = "expression", timezone: str = "UTC", direction: str = "any", anchored: bool = False) -> DataFrame:
    """``rows`` with ``window`` (start, end, rule), null where no row of the tables understands the expression.

    ``direction`` ends a window that straddles now at it (``past``) or starts it there (``future``), and says which way a
    bare month or weekday points; without one the nearer occurrence is meant. With ``anchored``, columns anchor_start and
    anchor_end are the event that the expression is relative to.
    """
    at = F.lit(now).cast("timestamp")
    t = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    rows = rows.withColumn("__t", F.regexp_replace(t, r"^(in|during|over|within|for|from|on|at) (?=the |last|past|next|this)", ""))
    rows = _on_calendar(rows, at, timezone, direction)
    if anchored:
        rows = _beside_event(rows, at, timezone)
    if direction != "any":
        w = F.col("window")
        astride = (w["start"].isNull() | (w["start"] < at)) & (w["end"].isNull() | (w["end"] > at))
        cut = _span(w["start"], at, w["rule"]) if direction == "past" else _span(at, w["end"], w["rule"])
        rows = rows.withColumn("__cut", F.when(w.isNotNull() & astride, cut).otherwise(w)).drop("window").withColumnRenamed("__cut", "window")
    return rows.drop("__t")
