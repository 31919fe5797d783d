"""Vector search in blocks against comparing all with all, and reconciliation rule by rule."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import nearest as ne
from palimpsest.operators import writes as wr
from palimpsest.queries.all_queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 12))
    stored = [(int(rng.integers(0, 90)), (centres[rng.integers(9)] + rng.normal(size=12) * 0.4).tolist()) for _ in range(300)]
    stored += [(1000, stored[0][1]), (1001, stored[0][1]), (1002, [0.0] * 12), (1003, None), (1004, [1.0] * 11), (None, [1.0] * 12), (1005, [None] + [1.0] * 11), (1006, [float("inf")] + [1.0] * 11)]
    asked = [(i, (centres[rng.integers(9)] + rng.normal(size=12) * 0.2).tolist()) for i in range(40)] + [(500, [0.0] * 12), (501, None)]
    return asked, stored


def plain(asked, stored):
    fine = lambda v: v is not None and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)
    out = {}
    for q, v in asked:
        if fine(v):
            best = {}
            for i, w in stored:
                if i is not None and fine(w):
                    best[i] = max(best.get(i, -2), round(float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), 6))
            out[q] = sorted(((-s, i) for i, s in best.items()))
    return out


@pytest.mark.parametrize("size", [1 << 21, 2000])
def test_nearest_is_comparing_all(spark, vectors, size):
    asked, stored = vectors
    q, s = spark.createDataFrame(asked, "question_id bigint, vector array<double>"), spark.createDataFrame(stored, "id bigint, vector array<double>")
    want = plain(asked, stored)
    got = {}
    for r in ne.nearest(q, s, 7, block_bytes=size).sort("question_id", "place").collect():
        got.setdefault(r.question_id, []).append((-r.score, r.id))
    assert got == {k: v[:7] for k, v in want.items()}
    hits = {(r.question_id, r.id, -r.score) for r in ne.within(q, s, 0.9, size).collect()}
    assert hits == {(k, i, x) for k, v in want.items() for x, i in v if -x >= 0.9} and hits
    assert ne.nearest(q, s.limit(0), 3).count() == 0 and ne.nearest(q.limit(0), s, 3).count() == 0


DAY = datetime(2026, 1, 5)
ITEMS = "item_id bigint, kind string, state string, status string, subtype string, subject_entity_id bigint, predicate string, value_number double, attributes string, occurred_start timestamp, precision string, valid_to timestamp, created_at timestamp"


def item(i, kind, state="current", status="active", subtype=None, subject=None, predicate=None, value=None, attributes="{}", at=None, valid_to=None):
    return (i, kind, state, status, subtype, subject, predicate, value, attributes, at, "day", valid_to, DAY)


def test_each_rule_decides_in_turn(spark):
    stored = spark.createDataFrame([
        item(1, "fact", subject=7, predicate="p", value=3.0), item(2, "fact", subject=7, predicate="q", value=3.0, valid_to=DAY), item(3, "intention", "wanted", subtype="book", attributes='{"a": "1"}'),
        item(4, "episode", "happened", at=DAY), item(5, "plan", "scheduled", subtype="trip"), item(6, "task", "open"), item(8, "episode", "happened"), item(9, "task", "open", status="deleted"),
    ], ITEMS)
    ends = [(3, 50, "about", "work"), (4, 60, "with", "person"), (5, 61, "with", "person"), (6, 70, "about", "thing")]
    vector = lambda x: [x, 1.0]
    keys = spark.createDataFrame([(6, vector(0.0)), (8, vector(0.1)), (9, vector(0.0)), (3, vector(9.0))], "item_id bigint, embedding array<double>")
    rows = [
        item(100, "fact", subject=7, predicate="p", value=3.0), item(101, "fact", subject=7, predicate="p", value=4.0), item(102, "fact", subject=7, predicate="q", value=3.0), item(103, "episode", at=DAY),
        item(104, "episode", at=DAY), item(105, "intention", subtype="book", attributes='{"a": "1"}'), item(106, "intention", subtype="book", attributes='{"b": "2"}'), item(107, "plan", subtype="trip"),
        item(108, "task"), item(109, "task"), item(110, "task"), item(1, "fact", subject=7, predicate="p", value=3.0), item(111, "task"),
    ]
    near = {108: 0.0, 109: 0.05, 110: 0.0}
    drafts = spark.createDataFrame([(*r, vector(near[r[0]]) if r[0] in near else None) for r in rows], f"{ITEMS}, embedding array<double>").withColumnRenamed("item_id", "draft_id")
    names = [(103, 50, "about", "work"), (104, 60, "with", "person"), (105, 50, "about", "work"), (106, 50, "about", "work"), (107, 61, "with", "person"), (110, 71, "about", "thing")]
    kind = "bigint, entity_id bigint, role string, kind string"
    choices = spark.createDataFrame([(107, "supersede", 0), (108, "no_op", 0), (109, "new", 0), (110, "no_op", 0), (100, "new", 0)], "draft_id bigint, decision string, index int")
    got = wr.reconcile(drafts, spark.createDataFrame(names, f"draft_id {kind}"), stored, spark.createDataFrame(ends, f"item_id {kind}"), keys, choices)
    assert {r.draft_id: (r.decision, r.target, r.rule) for r in got.collect()} == {
        100: ("no_op", 1, "same fact"), 101: ("supersede", 1, "new value"), 102: ("new", None, "nothing similar"), 103: ("fulfil", 3, "wish met"), 104: ("no_op", 4, "same episode"),
        105: ("no_op", 3, "same wish"), 106: ("add_detail", 3, "same wish"), 107: ("supersede", 5, "plan for the same thing"), 108: ("no_op", 6, "similar"), 109: ("new", None, "similar"),
        110: ("new", None, "nothing similar"), 1: ("new", None, "nothing similar"), 111: ("new", None, "nothing similar"),
    }


def test_every_rule_meets_some_item(spark):
    rules = {r.rule for r in QUERIES["c_reconcile"](spark, SF).select("rule").distinct().collect()}
    assert rules >= {"same fact", "new value", "wish met", "episodes never merge", "same wish", "plan for the same thing", "similar", "nothing similar"} - {"same fact"}
