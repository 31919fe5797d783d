"""Enumerations and state machines of the memory model. The values are fixed: rows are checked against them."""

from __future__ import annotations

# Legal states by kind, the first being the initial one. Fixed values.
STATES: dict[str, tuple[str, ...]] = {
    "fact": ("current", "superseded"),
    "preference": ("current", "superseded"),
    "episode": ("happened",),
    "plan": ("scheduled", "happened", "moved", "cancelled"),
    "task": ("open", "done", "dropped"),
    "intention": ("wanted", "active", "fulfilled", "dropped"),
    "resource": ("saved", "consumed"),
    "note": ("current",),
    "rule": ("proposed", "active", "retired"),
    "pattern": ("proposed", "confirmed", "retired"),
}
LIVE_STATES = ("current", "active", "confirmed", "wanted", "open", "scheduled", "saved")
HISTORY_STATES = ("superseded", "moved", "cancelled", "dropped")
CORE_STATES = ("current", "active", "confirmed")
CLOCKS = ("occurred", "valid", "due", "trigger", "mentioned")
# Lengths of an occurrence in hours, by precision. Fixed values.
LENGTH_HOURS = {"datetime": 1, "day": 24, "month": 24 * 31, "year": 24 * 366}
# Units that make a bare number the value of a named dimension. Fixed values.
DIMENSION_UNITS: dict[str, tuple[str, ...]] = {
    "distance": ("km", "m", "mi", "mile", "miles"),
    "duration": ("min", "mins", "minute", "minutes", "h", "hr", "hour", "hours", "s", "sec"),
    "time": ("min", "mins", "minute", "minutes", "h", "hr", "hour", "hours", "s", "sec"),
    "weight": ("kg", "g", "lb", "lbs"),
    "pages": ("page", "pages"),
}
# Default settings that change results. Fixed values.
RRF_K, POOL, HISTORY_DEMOTION = 60, 200, 0.5
BULK_THRESHOLD, CORE_BUDGET = 5, 1500
QUICK_HORIZON_DAYS, RECENT_DAYS, FREQUENT_MIN = 30, 7, 3
RECONCILE_SIMILARITY, VOCAB_SIMILARITY, TRIGGER_SIMILARITY, COUNT_CHECK = 0.85, 0.8, 0.6, 0.6
RERANK_MIN, ANSWER_TOP, LIST_MAX, SOFT_EXTRAS = 0.5, 8, 20, 8


def legal(kind: str, state: str) -> bool:
    return state in STATES.get(kind, ())
