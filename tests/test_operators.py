from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from palimpsest.functions import recurrence as rc
from palimpsest.functions import text as tx
from palimpsest.operators import filters as fl
from palimpsest.operators import metrics as me
from palimpsest.operators import ranking as rk
from palimpsest.operators import writes as wr
from palimpsest.sources.derived import load

SF = "/root/testdata/sf0.001"


def test_scope_never_leaks(spark):
    items = load(spark, SF, "items")
    seen = fl.scoped(items, fl.Access(2))
    assert seen.where("sensitivity <> 'normal' or status <> 'active' or workspace_id <> 2").count() == 0
    assert fl.scoped(items, fl.Access(sensitive=True)).where("sensitivity = 'secret'").count() == 0


def test_filters_without_and_describe():
    f = fl.Filters(kinds=("plan",), category="work")
    assert f.without("category") == fl.Filters(kinds=("plan",))
    assert f.without("category", "kinds").empty
    assert f.describe() == {"kinds": "plan", "category": "work"}


def test_fusion_does_not_depend_on_the_order_of_channels(spark):
    items = load(spark, SF, "items")
    a = items.selectExpr("'a' AS channel", "item_id", "item_id % 7 + 1 AS rank")
    b = items.selectExpr("'b' AS channel", "item_id", "item_id % 5 + 1 AS rank")
    one, two = rk.fuse(a.unionByName(b), items, "set"), rk.fuse(b.unionByName(a), items, "set")
    assert one.exceptAll(two).count() == 0


def test_undo_restores_what_was_there(spark):
    items = spark.createDataFrame([(1, "task", "open"), (2, "task", "open")], "item_id bigint, kind string, state string")
    ops = spark.createDataFrame([(1, 1, 1, "done"), (1, 2, 2, "dropped"), (2, 1, 2, "open")], "turn_id bigint, seq int, item_id bigint, state string")
    log = wr.write_log(wr.split_ops(ops, items)["applied"])
    got = {r.item_id: (r.restored, r.conflict) for r in wr.undo(log, 1).collect()}
    assert got == {1: ("open", False), 2: ("open", True)}


def test_a_bulk_turn_is_held_and_bad_states_are_rejected(spark):
    items = spark.createDataFrame([(i, "task", "open") for i in range(9)], "item_id bigint, kind string, state string")
    ops = spark.createDataFrame([(1, i, i, "done") for i in range(7)] + [(2, 1, 8, "superseded"), (2, 2, 77, "done")], "turn_id bigint, seq int, item_id bigint, state string")
    parts = {k: v.count() for k, v in wr.split_ops(ops, items).items()}
    assert parts == {"applied": 0, "held": 7, "rejected": 2}


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)], "k string, v double")
    assert me.nearest_rank(df, ["k"], "v", 0.5, "m").first().m == 2.0  # round(2.5) = 2


def test_routines_keep_their_hour_across_a_clock_change(spark):
    items = spark.createDataFrame([(1, datetime(2026, 3, 27, 8), "FREQ=DAILY", "datetime")], "item_id bigint, occurred_start timestamp, rrule string, precision string")
    out = rc.expand_rrules(items, datetime(2026, 3, 28), datetime(2026, 3, 31), "Europe/Berlin")
    hours = [r.h for r in out.orderBy("start").select(F.hour(F.from_utc_timestamp("start", "Europe/Berlin")).alias("h")).collect()]
    assert set(hours) == {9}


def test_chunks_keep_all_words(spark):
    said = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(60)) + "." for i in range(20))
    docs = spark.createDataFrame([(1, said), (2, None), (3, "")], "doc_id bigint, text string")
    rows = tx.chunks(docs).toPandas()
    assert set(rows["doc_id"]) == {1}
    assert set(" ".join(rows["chunk"]).split()) == set(said.split())


def test_hashed_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([("one two",), ("one two",), (None,)], "t string")
    v = pd.DataFrame(df.select(tx.hashed_embedding()("t").alias("v")).toPandas()["v"].tolist())
    assert (v.iloc[0] == v.iloc[1]).all() and abs((v.iloc[0] ** 2).sum() - 1) < 1e-9 and (v.iloc[2] == 0).all()
