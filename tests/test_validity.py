"""Facts with two times against a loop over days; streams of them in any order; mentions of names that begin alike."""

import random
from datetime import datetime, timedelta

from palimpsest.functions import text as tx
from palimpsest.operators import validity as va
from palimpsest.streaming import jobs

DAY = datetime(2020, 1, 1)


def facts(rng, n):
    out = []
    for i in range(n):
        start = rng.randrange(60)
        out.append((i, rng.randrange(3), rng.choice(["p", None]), DAY + timedelta(days=start), rng.choice([None, DAY + timedelta(days=start + rng.randrange(-2, 25))]), DAY + timedelta(days=rng.randrange(40))))
    return out


def held(rows, day, known):
    best = {}
    for i, s, p, a, z, learnt in rows:
        if a <= day and (z is None or z > day) and learnt <= known and (z is None or z > a):
            best[s, p] = max(best.get((s, p), (learnt, i)), (learnt, i))
    return {k: v[1] for k, v in best.items()}


def test_timelines_are_the_days_one_by_one(spark):
    rng = random.Random(3)
    rows = facts(rng, 120)
    frame = spark.createDataFrame(rows + rows[:5] + [(900, 1, "p", None, None, DAY), (901, 1, "p", DAY, None, None)], va.FACT).repartition(4)
    for known in (DAY + timedelta(days=99), DAY + timedelta(days=20)):
        lines = va.timeline(frame, known).collect()
        for d in range(100):
            day = DAY + timedelta(days=d)
            on = [(x.subject_id, x.predicate, x.fact_id) for x in lines if x.valid_from <= day and (x.valid_to is None or x.valid_to > day)]
            assert {(s, p): f for s, p, f in on} == held(rows, day, known) and len(on) == len(set(on))
        day = DAY + timedelta(days=33)
        assert {(x.subject_id, x.predicate): x.fact_id for x in va.as_of(frame, day, known).collect()} == held(rows, day, known)
    by_key = {}
    for x in sorted(lines, key=lambda x: (x.subject_id, str(x.predicate), x.valid_from)):
        before = by_key.get((x.subject_id, x.predicate))
        assert before is None or before.valid_to <= x.valid_from and (before.valid_to < x.valid_from or before.fact_id != x.fact_id)
        by_key[x.subject_id, x.predicate] = x
    assert va.timeline(frame.limit(0)).count() == 0


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    rng = random.Random(4)
    rows = facts(rng, 60)
    rng.shuffle(rows)
    for run, part in enumerate((rows[:25], rows[20:40], rows[40:])):  # some come twice
        spark.createDataFrame(part, va.FACT).coalesce(1).write.parquet(f"{tmp_path}/in/{run}")
        got = va.late_facts(jobs.read_table(spark, f"{tmp_path}/in"), f"{tmp_path}/job")
    assert sorted(map(str, got.collect())) == sorted(map(str, va.timeline(spark.createDataFrame(rows, va.FACT)).collect()))


def test_names_that_begin_alike_meet_by_their_rarest_word(spark):
    names = spark.createDataFrame([(i, f"Customer {i}") for i in range(300)] + [(900, "Customer"), (901, "Of the customer"), (902, "  "), (903, None)], "entity_id int, name string")
    said = spark.createDataFrame([(1, "the customer 17, not customer 18!"), (2, "17 customers"), (3, "out of the customer"), (4, None)], "message_id int, text string")
    found = tx.mentions(said, names)
    assert {tuple(r) for r in found.collect()} == {(1, 17), (1, 18), (1, 900), (3, 900), (3, 901)}
    plan = names.where("entity_id < 300")
    assert {tuple(r) for r in tx.mentions(said, plan).collect()} == {(1, 17), (1, 18)}
