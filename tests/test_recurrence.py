"""Recurring times against another implementation, over random rules and across clock changes."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from dateutil.rrule import rrulestr

from palimpsest.functions import recurrence as rc

ZONES = ("Europe/Berlin", "America/New_York", "UTC")
LOW, HIGH = datetime(2026, 2, 20), datetime(2026, 11, 20)


def rule(rng):
    freq = rng.choice(["DAILY", "WEEKLY", "MONTHLY", "MONTHLY", "YEARLY", "YEARLY", "HOURLY", "MINUTELY"])
    parts = [f"FREQ={freq}"]
    some = lambda n, values: ",".join(str(x) for x in sorted(rng.sample(list(values), n)))
    signed = lambda n: [*range(1, n + 1), *range(-n, 0)]
    if freq == "MINUTELY":
        parts.append(f"INTERVAL={rng.choice([7, 90, 1440, 777])};BYHOUR={some(2, range(24))}")
    elif rng.random() < 0.5:
        parts.append(f"INTERVAL={rng.randrange(1, 8)}")
    if rng.random() < 0.3:
        parts.append(f"WKST={rng.choice(rc.WEEKDAYS)}")
    if rng.random() < 0.3:
        parts.append(f"BYMONTH={some(rng.randrange(1, 4), range(1, 13))}")
    if rng.random() < 0.5:
        n = rng.randrange(1, 4)
        days = rng.sample(rc.WEEKDAYS, n)
        if freq in ("MONTHLY", "YEARLY") and rng.random() < 0.6:
            days = [f"{rng.choice(['', '+'])}{rng.choice([1, 2, 4, 5])}{d}" if rng.random() < 0.5 else f"-{rng.choice([1, 2, 5])}{d}" for d in days]
        parts.append("BYDAY=" + ",".join(days))
    if rng.random() < 0.3 and freq != "WEEKLY":
        parts.append(f"BYMONTHDAY={some(rng.randrange(1, 4), signed(31))}")
    if freq == "YEARLY" and rng.random() < 0.25:
        parts.append(f"BYYEARDAY={some(3, signed(366))}")
    if freq == "YEARLY" and rng.random() < 0.25:
        parts.append(f"BYWEEKNO={some(3, signed(53))}")
    if freq not in ("MINUTELY",) and rng.random() < 0.3:
        parts.append(f"BYHOUR={some(2, range(24))}")
    if rng.random() < 0.2:
        parts.append(f"BYMINUTE={some(2, range(60))}")
    if freq not in ("HOURLY", "MINUTELY") and any(p.startswith("BY") for p in parts) and rng.random() < 0.3:
        parts.append(f"BYSETPOS={some(2, signed(4))}")
    if rng.random() < 0.25:
        parts.append(f"COUNT={rng.randrange(1, 60)}")
    elif rng.random() < 0.3:
        parts.append(rng.choice(["UNTIL=20260801", "UNTIL=20260329T023000", "UNTIL=20250101"]))
    return ";".join(parts)


def until_empty(times):
    try:
        yield from times()
    except ValueError:  # hours that no multiple of the interval meets
        return


@pytest.mark.parametrize("zone", ZONES)
def test_occurrences_are_those_of_another_implementation(spark, zone):
    rng = random.Random(zone)
    tz, rows = ZoneInfo(zone), []
    for i in range(120):
        first = datetime(2026, 3, 1) + timedelta(minutes=rng.randrange(-60 * 24 * 900, 60 * 24 * 90))
        rows.append((i, rule(rng), first, rng.choice(["datetime", "day"])))
    frame = spark.createDataFrame(rows, "item_id int, rrule string, occurred_start timestamp, precision string")
    got = {}
    for r in rc.expand_rrules(frame, LOW, HIGH, zone).collect():
        got.setdefault(r.item_id, []).append((r.start, r.end))
    hits = 0
    for i, text, first, precision in rows:
        length = timedelta(hours=1 if precision == "datetime" else 24)
        local = first.replace(tzinfo=UTC).astimezone(tz).replace(tzinfo=None)
        want = []
        for x in until_empty(lambda: rrulestr(text, dtstart=local).xafter(datetime(2000, 1, 1))):
            if x > HIGH + timedelta(days=3):
                break
            at = x.replace(tzinfo=tz).astimezone(UTC).replace(tzinfo=None)
            if at < HIGH and at + length > LOW:
                want.append((at, at + length))
        assert got.get(i, []) == want, (text, local)
        hits += len(want)
    assert hits > 2000


def test_limits_and_next(spark):
    frame = spark.createDataFrame([(1, "RRULE:freq=monthly;byday=1mo", datetime(2020, 1, 6, 9), "datetime"), (2, "nonsense", datetime(2020, 1, 1), "day"), (3, None, datetime(2020, 1, 1), "day"),
                                   (4, "FREQ=DAILY", None, "day"), (5, "FREQ=DAILY;COUNT=3", datetime(2020, 1, 1), "day")], "item_id int, rrule string, occurred_start timestamp, precision string")
    assert [(r.item_id, r.start) for r in rc.next_occurrence(frame, LOW, HIGH).collect()] == [(1, datetime(2026, 3, 2, 9))]
    assert rc.expand_rrules(frame, None, HIGH, limit=2).groupBy("item_id").count().sort("item_id").collect() == [(1, 2), (5, 2)]
    plan = rc.expand_rrules(frame, LOW, HIGH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


VALID = ["FREQ=DAILY", "RRULE:FREQ=WEEKLY;BYDAY=MO", "freq=monthly;byday=-1FR,2MO", "FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU", "FREQ=DAILY;BYHOUR=7;BYMINUTE=0", "FREQ=MONTHLY;BYMONTHDAY=-1", "FREQ=MONTHLY;BYDAY=MO,TU;BYSETPOS=-1",
         "FREQ=WEEKLY;WKST=SU;INTERVAL=2", "FREQ=YEARLY;BYWEEKNO=20", "FREQ=DAILY;UNTIL=20260101T000000", "COUNT=3;FREQ=HOURLY"]
INVALID = ["", "FREQ=SOMETIMES", "BYDAY=MO", "FREQ=DAILY;FREQ=DAILY", "FREQ=DAILY;BYMONTH=13", "FREQ=DAILY;INTERVAL=0", "FREQ=DAILY;COUNT=x", "FREQ=DAILY;", "FREQ=DAILY;UNTIL=2026", "FREQ=DAILY;BYSETPOS=0", "FREQ=DAILY;COLOUR=1", "FREQ=SECONDLY", None]


def test_what_is_a_rule(spark):
    rows = spark.createDataFrame([(r,) for r in VALID + INVALID], "r string")
    got = {x.r: x.v for x in rows.select("r", rc.rrule_valid(rows["r"]).alias("v")).collect()}
    assert got == {r: r in VALID for r in VALID + INVALID}
    for r in VALID:
        rrulestr(r, dtstart=datetime(2026, 1, 1))


def test_items_of_one_rule_and_start_share_their_occurrences(spark):
    at = datetime(2026, 1, 5, 9)
    rows = [(i, "FREQ=WEEKLY", at, (None, "day", "datetime")[i % 3]) for i in range(9)] + [(9, "FREQ=WEEKLY", None, "day"), (10, "FREQ=OFTEN", at, None), (11, None, at, None)]
    items = spark.createDataFrame(rows, "item_id int, rrule string, occurred_start timestamp, precision string")
    got = rc.expand_shared(items, datetime(2026, 1, 10), datetime(2026, 1, 20))
    hours = {r.item_id: (r.end - r.start).total_seconds() / 3600 for r in got.collect()}
    assert got.count() == 18 and hours == {i: 1 if i % 3 == 2 else 24 for i in range(9)}  # two Mondays each
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [rrule" in text and text.index("Join") < text.index("Aggregate [rrule")
