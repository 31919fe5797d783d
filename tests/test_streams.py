"""Streams in several runs over split input: numbers without gaps, counters that a reset sets, triggers that fire once."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.streaming import jobs
from palimpsest.streaming import state as sst

DAY = datetime(2026, 3, 1)


def arrive(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_numbers_go_on_after_a_restart(spark, tmp_path):
    rng, schema = random.Random(1), "turn_id bigint, event_id bigint, ts timestamp"
    events = [(rng.randrange(4), i, DAY + timedelta(minutes=rng.randrange(600))) for i in range(200)]
    early = [e for e in events if e[2] < DAY + timedelta(hours=5)]
    late = [e for e in early if e[2] > DAY + timedelta(hours=4, minutes=20)][::3]  # come an hour late at most, with the others
    runs = [[e for e in early if e not in late], [e for e in events if e not in early] + late, [(9, -1, DAY + timedelta(days=2))]]
    for i, rows in enumerate(runs):
        arrive(spark, tmp_path / "in", i, rows, schema)
        sst.run_job(sst.numbered(jobs.read_table(spark, f"{tmp_path}/in"), "1 hour"), f"{tmp_path}/job")  # each run begins from the checkpoint
        if not i:
            first = {r.event_id: r.seq for r in spark.read.parquet(f"{tmp_path}/job/out").collect()}
    got = spark.read.parquet(f"{tmp_path}/job/out").collect()
    want = {}
    for t, e, ts in sorted(events, key=lambda x: (x[0], x[2], x[1])):
        want[e] = (t, len([1 for x in want.values() if x[0] == t]) + 1)
    assert {r.event_id: (r.turn_id, r.seq) for r in got} == want and len(got) == len(events)
    assert 0 < len(first) < len(early) and all(want[e][1] == n for e, n in first.items())


CALLS = "kind string, owner_id bigint, at timestamp, provider string, cost bigint, totals array<struct<scope: string, name: string, amount: bigint>>"


def counters(spark, tmp_path):
    out = sst.spend_counters(jobs.read_table(spark, f"{tmp_path}/in"), f"{tmp_path}/job")
    return {(r.owner_id, r.scope, r.name): r.amount for r in out.where("scope <> 'reset'").collect()}


def test_a_reset_overwrites_and_old_counters_go(spark, tmp_path):
    call = lambda o, day, p, c, hour=1: ("call", o, DAY + timedelta(days=day, hours=hour), p, c, None)
    arrive(spark, tmp_path / "in", 0, [call(1, 0, "a", 5), call(1, 0, "b", 7), call(1, 2, "a", 1), call(2, 0, "a", 9)], CALLS)
    assert counters(spark, tmp_path) == {(1, "day", "2026-03-01"): 12, (1, "day", "2026-03-03"): 1, (1, "month", "2026-03"): 13, (1, "provider", "a"): 6, (1, "provider", "b"): 7,
                                         (2, "day", "2026-03-01"): 9, (2, "month", "2026-03"): 9, (2, "provider", "a"): 9}
    # the ledger knows of a call that was not counted; a call from before the reset comes with it and is no news
    totals = [("day", "2026-03-04", 2), ("month", "2026-03", 20), ("provider", "a", 13), ("provider", "b", 7)]
    arrive(spark, tmp_path / "in", 1, [("reset", 1, DAY + timedelta(days=3, hours=12), None, None, totals), call(1, 3, "a", 100), call(1, 3, "a", 3, 14)], CALLS)
    after = {(1, "day", "2026-03-04"): 5, (1, "month", "2026-03"): 23, (1, "provider", "a"): 16, (1, "provider", "b"): 7}
    assert {k: v for k, v in counters(spark, tmp_path).items() if k[0] == 1} == after
    # an older reset says nothing; days go after three, months after forty
    arrive(spark, tmp_path / "in", 2, [("reset", 1, DAY, None, None, [("month", "2026-03", 1)]), call(1, 50, "b", 4), call(2, 1, "a", 1), ("call", 3, DAY, "a", 1, None)], CALLS)
    assert counters(spark, tmp_path) == {(1, "day", "2026-04-20"): 4, (1, "month", "2026-04"): 4, (1, "provider", "a"): 16, (1, "provider", "b"): 11, (2, "day", "2026-03-01"): 9, (2, "day", "2026-03-02"): 1,
                                         (2, "month", "2026-03"): 10, (2, "provider", "a"): 10, (3, "day", "2026-03-01"): 1, (3, "month", "2026-03"): 1, (3, "provider", "a"): 1}
    assert counters(spark, tmp_path)  # a run without news leaves them as they are


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    versions = sst.Versions(spark, f"{tmp_path}/v", sst.COUNTERS)
    rows = spark.createDataFrame([("call", 1, DAY, "a", 5, None)], CALLS)
    for batch in (0, 0, 1, 1, 1, 2):
        versions.write(sst.merged_spend(versions.before(batch), rows), batch)
    assert versions.latest().where("scope = 'provider'").select("amount").collect() == [(15,)] and versions.known() == [1, 2]


def test_triggers_fire_once_at_their_first_message(spark, tmp_path):
    triggers = spark.createDataFrame([(1, 10, "person", 7, "pending"), (2, 11, "topic", None, "pending"), (3, 12, "topic", None, "pending"), (4, 13, "person", 7, "fired"), (5, 14, "time", 7, "pending")], "trigger_id bigint, item_id bigint, kind string, entity_id bigint, state string")
    cues = spark.createDataFrame([(2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "trigger_id bigint, vector array<double>")
    schema = "message_id bigint, at timestamp, user bigint, vector array<double>"
    run = lambda: sst.fire_once(jobs.read_table(spark, f"{tmp_path}/in"), lambda m: m.select("message_id", F.col("user").alias("entity_id")), triggers, cues, f"{tmp_path}/job")
    hour = lambda h: DAY + timedelta(hours=h)
    arrive(spark, tmp_path / "in", 0, [(1, hour(3), 7, None), (2, hour(2), 7, [0.1, 1.0]), (3, hour(2), 8, [0.9, 0.1])], schema)
    assert {(r.trigger_id, r.item_id, r.message_id, r.why) for r in run().collect()} == {(1, 10, 2, "person"), (2, 11, 2, "topic")}
    arrive(spark, tmp_path / "in", 1, [(4, hour(1), 7, [0.0, 1.0]), (5, hour(4), 9, [-1.0, 0.2])], schema)
    assert {(r.trigger_id, r.message_id) for r in run().collect()} == {(1, 2), (2, 2), (3, 5)}
    assert run().count() == 3
