"""Write operations in bulk: creation, changes, closing pairs, edges and entities, and what follows from their log.

Each function takes a table of operations, ordered by (turn_id, seq), and the stored rows. It returns the operations with an
``outcome``: ``applied``, ``skipped`` (there is nothing left to do) or ``rejected`` (not legal). Operations on one row see each
other in order through windows over that row alone; no turn and no table is gathered in one task. Operations are dealt to many
tasks (``dealt``), as what a task sorts is several times larger in memory than what is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.writes import legal_state
from palimpsest.sources.storage import dealt

#: Fields of an item that an operation may change. Fixed values.
ITEM_FIELDS = ("kind", "subtype", "state", "status", "title", "text", "sensitivity", "category", "in_core", "due_at", "valid_to")
TRIGGER_FIELDS = ("state", "fires_at")
#: States in which a memory can still be superseded, and those in which a wish is closed. Fixed values.
OPEN_STATES, CLOSED_WISHES = ("current", "scheduled"), ("fulfilled", "dropped")
LINK_OF = {"supersede": "supersedes", "correct": "corrects", "fulfil": "fulfils"}
#: Fields that a shown difference has. Fixed values.
SHOWN = ("kind", "subtype", "state", "title", "text", "category", "due_at", "valid_to")


#: Operations on one entity that are sorted in one piece, and operations of all entities that a task is dealt.
HEAVY, DEALT = 1 << 15, 1 << 18


def _in_order(*keys: Column | str) -> W:
    return W.partitionBy(*keys).orderBy("turn_id", "seq")


def _outcome(rejected: Column, skipped: Column) -> Column:
    return F.when(rejected, "rejected").when(skipped, "skipped").otherwise("applied")


# ---------------------------------------------------------------- items

def create(ops: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """ops(turn_id, seq, item_id, kind, state, ends array of (entity_id, role)) with ``outcome``.

    A state that is not the kind's, or an end that is no entity, rejects; an item that is there, or that an earlier
    operation makes, is skipped.
    """
    lost = ops.select("turn_id", "seq", F.explode("ends").alias("e")).select("turn_id", "seq", "e.entity_id")
    lost = lost.join(entities.select("entity_id"), "entity_id", "left_anti").select("turn_id", "seq").distinct().withColumn("lost", F.lit(True))
    rows = dealt(dealt(ops, "turn_id", "seq").join(lost, ["turn_id", "seq"], "left"), "item_id").join(items.select("item_id", F.lit(True).alias("there")), "item_id", "left")
    bad = F.col("lost").isNotNull() | ~F.coalesce(legal_state(F.col("kind"), F.col("state")), F.lit(False))
    rows = rows.withColumn("bad", bad).withColumn("nth", F.row_number().over(_in_order("item_id", "bad")))
    return rows.select(*ops.columns, _outcome(F.col("bad"), F.col("there").isNotNull() | (F.col("nth") > 1)).alias("outcome"))


def created_rows(created: DataFrame) -> DataFrame:
    """Log rows (turn_id, seq, target_type, target_id, item_id) of what creation inserted: the item, then its ends."""
    done = created.where("outcome = 'applied'")
    rows = done.select("turn_id", "seq", F.lit("item").alias("target_type"), F.col("item_id").alias("target_id"), "item_id")
    ends = done.select("turn_id", "seq", "item_id", F.explode("ends").alias("e"))
    return rows.unionByName(ends.select("turn_id", "seq", F.lit("item_entity").alias("target_type"), F.col("e.entity_id").alias("target_id"), "item_id"))


def as_changes(ops: DataFrame) -> DataFrame:
    """set_state, delete and restore ops(turn_id, seq, op, item_id, state) as changes of fields; deletion is soft."""
    changes = F.when(F.col("op") == "set_state", F.create_map(F.lit("state"), F.col("state"))).otherwise(
        F.create_map(F.lit("status"), F.when(F.col("op") == "delete", "deleted").otherwise("active")))
    return ops.select("turn_id", "seq", "item_id", changes.alias("changes"))


def change(ops: DataFrame, stored: DataFrame, key: str = "item_id", fields: tuple[str, ...] = ITEM_FIELDS) -> DataFrame:
    """One row per changed field of ops(turn_id, seq, key, changes map), with what it was and becomes; else one per operation.

    An unknown row skips; an unknown field rejects, as does a state that is not the kind's (both as the operation leaves
    them; what it does not name counts as stored). ``before`` is the field's last value before the operation.
    """
    has_kind = "kind" in fields
    fields = tuple(f for f in fields if f in stored.columns)
    old = lambda f: F.col(f"__{f}")
    rows = dealt(ops.select("turn_id", "seq", key, "changes"), key).join(stored.select(key, F.lit(True).alias("there"), *[F.col(f).cast("string").alias(f"__{f}") for f in fields]), key, "left")
    bad = F.exists(F.map_keys("changes"), lambda k: ~k.isin(*fields))
    if has_kind:
        now = lambda f: F.when(F.array_contains(F.map_keys("changes"), f), F.col("changes")[f]).otherwise(old(f))
        bad = bad | ~F.coalesce(legal_state(now("kind"), now("state")), F.lit(False))
    rows = rows.withColumn("outcome", _outcome(F.col("there").isNotNull() & bad, F.col("there").isNull()))
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    each = rows.withColumn("c", F.explode(F.when(F.col("outcome") == "applied", F.map_entries("changes")).otherwise(none)))
    was = F.coalesce(*[F.when(F.col("c.key") == f, old(f)) for f in fields])  # only the field's own value is sorted
    each = each.select("turn_id", "seq", key, F.col("c.key").alias("field"), was.alias("was"), F.col("c.value").cast("string").alias("after"), "outcome")
    last = F.lag(F.struct("after")).over(_in_order(key, "field"))
    before = F.when(last.isNotNull(), last["after"]).otherwise(F.col("was"))
    return each.select("turn_id", "seq", key, "field", F.when(F.col("outcome") == "applied", before).alias("before"), "after", "outcome")


def close(ops: DataFrame, items: DataFrame) -> DataFrame:
    """ops(turn_id, seq, op, old_id, new_id, state, valid_to): supersede, correct or fulfil one memory by another.

    Gives (turn_id, seq, op, old_id, new_id, field, before, after, link_type, outcome). It skips if either is missing or
    deleted, if the old one is no longer open to it, or if an earlier operation of that kind closed it. Superseding also
    sets ``valid_to``; correcting archives the old memory.
    """
    ends = items.select("item_id", "state", "status", "valid_to")
    old = ends.select(F.col("item_id").alias("old_id"), F.col("state").alias("was"), F.col("status").alias("old_status"), F.col("valid_to").alias("old_to"))
    new = ends.select(F.col("item_id").alias("new_id"), F.col("status").alias("new_status"))
    rows = ops.join(old, "old_id", "left").join(new, "new_id", "left")
    there = (F.col("old_status") != "deleted") & (F.col("new_status") != "deleted")
    fit = (F.when(F.col("op") == "supersede", F.col("old_to").isNull() & F.col("was").isin(*OPEN_STATES))
           .when(F.col("op") == "correct", F.col("old_status") == "active").otherwise(~F.col("was").isin(*CLOSED_WISHES)))
    rows = rows.withColumn("fit", F.coalesce(there & fit, F.lit(False)))
    rows = rows.withColumn("nth", F.row_number().over(_in_order("old_id", "op", "fit")))
    correct = F.col("op") == "correct"
    return rows.select(
        "turn_id", "seq", "op", "old_id", "new_id", F.when(correct, "status").otherwise("state").alias("field"),
        F.when(correct, F.col("old_status")).otherwise(F.col("was")).alias("before"), F.when(correct, "archived").otherwise(F.col("state")).alias("after"),
        F.create_map(*[F.lit(x) for kv in LINK_OF.items() for x in kv])[F.col("op")].alias("link_type"),
        _outcome(F.lit(False), ~F.col("fit") | (F.col("nth") > 1)).alias("outcome"))


# ---------------------------------------------------------------- edges, entities

def edges(ops: DataFrame, stored: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """ops(turn_id, seq, op add or remove, edge_id, src, type, dst) with ``outcome``, for links, ends of items and relations.

    Adding needs both ends in ``src(id)`` and ``dst(id)``; adding what is there and removing what is not is skipped.
    """
    known = lambda df, c: df.select(F.col("id").alias(c)).distinct().withColumn(f"has_{c}", F.lit(True))
    rows = dealt(dealt(ops, "src").join(known(src, "src"), "src", "left"), "dst").join(known(dst, "dst"), "dst", "left")
    rows = dealt(rows, "edge_id").join(stored.select("edge_id").distinct().withColumn("there", F.lit(True)), "edge_id", "left")
    fine = (F.col("op") == "remove") | (F.col("has_src").isNotNull() & F.col("has_dst").isNotNull())
    rows = rows.withColumn("fine", fine)
    last = F.lag("op").over(_in_order("edge_id", "fine"))
    present = F.coalesce(last == "add", F.col("there").isNotNull())
    rows = rows.withColumn("present", present)
    return rows.select(*ops.columns, _outcome(F.lit(False), ~F.col("fine") | (F.col("present") == (F.col("op") == "add"))).alias("outcome"))


def edges_after(stored: DataFrame, done: DataFrame) -> DataFrame:
    """The stored edges(edge_id, src, type, dst) after the applied operations: the last one of each edge counts."""
    last = done.where("outcome = 'applied'").groupBy("edge_id").agg(F.max_by(F.struct("op", "src", "type", "dst"), F.struct("turn_id", "seq")).alias("x"))
    kept = stored.groupBy("edge_id").agg(F.collect_list(F.struct(F.lit("add").alias("op"), "src", "type", "dst")).alias("kept"))
    rows = last.join(kept, "edge_id", "full").select("edge_id", F.explode(F.when(F.col("x").isNotNull(), F.array("x")).otherwise(F.col("kept"))).alias("x"))
    return rows.where("x.op = 'add'").select("edge_id", "x.src", "x.type", "x.dst")


def entity_ops(ops: DataFrame, entities: DataFrame) -> DataFrame:
    """ops(turn_id, seq, op create, update or delete, entity_id, name) with (before, after, outcome).

    Creating what exists and changing what does not is skipped; the user's own entity (kind ``self``) is never removed. A
    deleted entity stays as a row whose name is kept.
    """
    old = entities.select("entity_id", F.col("kind").alias("was_kind"), F.col("name").alias("was"))
    order, create = F.struct("turn_id", "seq"), F.col("op") == "create"
    heavy = ops.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)  # no more than the operations over HEAVY; a number is counted without sorting
    theirs = ops.join(F.broadcast(heavy.select("entity_id")), "entity_id").groupBy("entity_id")
    heavy = heavy.join(F.broadcast(theirs.agg(F.min("turn_id").alias("low"), F.max("turn_id").alias("high"), F.min(F.when(create, order)).alias("first"))), "entity_id")
    parts = F.ceil(F.col("n") / HEAVY).cast("int")
    part = F.least(parts - 1, F.floor((F.col("turn_id") - F.col("low")) / (F.col("high") - F.col("low") + 1) * parts).cast("int"))
    skipped = lambda exists: (exists == create) | ((F.col("op") == "delete") & F.coalesce(F.col("was_kind") == "self", F.lit(False)))
    named = lambda skip: F.when(~skip & (F.col("op") != "delete"), F.col("name"))

    # what the last operation of each part of a heavy entity names, for the parts behind it
    cut = ops.join(F.broadcast(heavy.join(old, "entity_id", "left")), "entity_id").withColumn("part", part)
    cut = cut.withColumn("named", named(skipped(F.col("was_kind").isNotNull() | F.coalesce(F.col("first") < order, F.lit(False)))))
    ends = cut.groupBy("entity_id", "part").agg(F.max_by("named", F.when(F.col("named").isNotNull(), order)).alias("named"), F.min("first").alias("first"))
    so_far = F.last("named", ignorenulls=True).over(W.partitionBy("entity_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("entity_id", "part", "first", so_far.alias("carried"))

    old = old.join(F.broadcast(heavy.select("entity_id", parts.alias("parts"))), "entity_id", "left").select("entity_id", "was_kind", "was", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    rows = ops.join(F.broadcast(heavy), "entity_id", "left").withColumn("part", F.when(F.col("n").isNotNull(), part).otherwise(0)).select(*ops.columns, "part")
    rows = dealt(rows, "entity_id", "part", tasks=-(-ops.count() // DEALT)).join(old, ["entity_id", "part"], "left").join(F.broadcast(ends), ["entity_id", "part"], "left")
    before = _in_order("entity_id", "part").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(create).over(before), F.lit(False)) | F.coalesce(F.col("first") < order, F.lit(False))
    rows = rows.withColumn("exists", F.col("was_kind").isNotNull() | earlier)
    rows = rows.withColumn("skip", skipped(F.col("exists")))
    name_before = F.coalesce(F.last(named(F.col("skip")), ignorenulls=True).over(before), F.col("carried"), F.col("was"))
    after = F.when(F.col("op") == "delete", F.lit(None)).otherwise(F.col("name"))
    return rows.select("turn_id", "seq", "op", "entity_id", F.when(F.col("op") != "create", name_before).alias("before"), after.alias("after"), _outcome(F.lit(False), F.col("skip")).alias("outcome"))


# ---------------------------------------------------------------- what follows from the log

def track(log: DataFrame) -> DataFrame:
    """(item_id) whose keys a log(target_type, target_id, src, dst, item_id) makes stale: items, ends of links, items of attached entities."""
    touched = F.array_compact(F.array(
        F.when(F.col("target_type") == "item", F.col("target_id")), F.when(F.col("target_type") == "link", F.col("src")),
        F.when(F.col("target_type") == "link", F.col("dst")), F.when(F.col("target_type") == "item_entity", F.col("item_id"))))
    return log.select(F.explode(touched).alias("item_id")).distinct()


def shown_diff(log: DataFrame) -> DataFrame:
    """(turn_id, seq, target_id, field, before, after) of log rows with maps ``before`` and ``after``: shown fields that differ."""
    both = F.map_zip_with(F.coalesce("before", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")),
                          F.coalesce("after", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = log.select("turn_id", "seq", "target_id", F.explode(F.map_filter(both, lambda k, v: k.isin(*SHOWN) & ~v["a"].eqNullSafe(v["b"]))).alias("field", "v"))
    return rows.select("turn_id", "seq", "target_id", "field", F.col("v.a").alias("before"), F.col("v.b").alias("after"))


def inverse(log: DataFrame, turn_id: int) -> DataFrame:
    """Operations that undo a turn, newest first: (place, op, target_type, target_id, changes); ``conflict`` where a later turn wrote the row.

    log(turn_id, seq, target_type, target_id, before map, after map). What was inserted is deleted, unlinked, detached,
    unrelated or cancelled; what was removed is added; changed fields go back. The user's own entity stays.
    """
    mine = log.where(F.col("turn_id") == turn_id)
    later = log.where(F.col("turn_id") > turn_id).select("target_type", "target_id").distinct().withColumn("later", F.lit(True))
    rows = mine.join(later, ["target_type", "target_id"], "left")
    added, kind = F.col("before").isNull(), F.col("target_type")
    status = lambda m: F.col(m)["status"]
    op = (F.when(kind == "item", F.when(added, "delete").when((status("before") == "active") & (status("after") == "deleted"), "restore")
                 .when((status("before") == "deleted") & (status("after") == "active"), "delete").otherwise("update"))
          .when(kind == "entity", F.when(added & (F.col("after")["kind"] == "self"), None).when(added, "delete").otherwise("update"))
          .when(kind == "link", F.when(added, "unlink").otherwise("link")).when(kind == "item_entity", F.when(added, "detach").otherwise("attach"))
          .when(kind == "relation", F.when(added, "unrelate").otherwise("relate")).otherwise(F.when(added, "cancel").otherwise("update")))
    back = F.map_filter(F.col("before"), lambda k, v: ~v.eqNullSafe(F.col("after")[k]))
    rows = rows.withColumn("op", op).withColumn("changes", F.when(F.col("op") == "update", back)).where("op is not null and (op <> 'update' or size(changes) > 0)")
    place = F.row_number().over(W.orderBy(F.col("seq").desc(), "target_type", "target_id"))  # the rows of one turn
    return rows.select(place.alias("place"), "op", "target_type", "target_id", "changes", F.coalesce("later", F.lit(False)).alias("conflict"))


def decide(held: DataFrame, decisions: DataFrame) -> DataFrame:
    """Held operations(turn_id, seq, ...) after decisions(turn_id, at, confirm): ``confirmed``, ``rejected`` or still ``held``; the first decision counts."""
    first = decisions.groupBy("turn_id").agg(F.min_by("confirm", "at").alias("confirm"))
    return held.join(first, "turn_id", "left").withColumn(
        "status", F.when(F.col("confirm").isNull(), "held").when(F.col("confirm"), "confirmed").otherwise("rejected")).drop("confirm")


def wrong_value(fixes: DataFrame, items: DataFrame, item_entities: DataFrame) -> DataFrame:
    """fixes(item_id, new_id, text) as operations: a new item that is the old one with the right text and its ends, and a correction.

    (op, item_id, other_id, kind, state, text, ends). A blank text gives none.
    """
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = dealt(fixes.withColumn("text", text).where("text <> ''"), "item_id").join(items.select("item_id", "kind", "state"), "item_id")
    ends = dealt(item_entities, "item_id").join(rows.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "role"))).alias("ends"))
    none = F.array().cast("array<struct<entity_id:bigint,role:string>>")
    new = rows.join(ends, "item_id", "left").select(F.lit("create").alias("op"), F.col("new_id").alias("item_id"), F.col("item_id").alias("other_id"), "kind", "state", "text", F.coalesce("ends", none).alias("ends"))
    old = rows.select(F.lit("correct").alias("op"), "item_id", F.col("new_id").alias("other_id"), "kind", "state", F.lit(None).cast("string").alias("text"), none.alias("ends"))
    return new.unionByName(old)


def relation_fix(fixes: DataFrame, relations: DataFrame) -> DataFrame:
    """fixes(a, b, wrong, right) as operations (op, src, relation, dst): what stands open between the two, of the wrong name if one is given, goes; the right one comes."""
    gone = relations.where(~F.col("ended")).join(fixes, ((F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))), "inner")
    back = relations.where(~F.col("ended")).join(fixes, ((F.col("src") == F.col("b")) & (F.col("dst") == F.col("a")) & (F.col("a") != F.col("b"))), "inner")
    gone = gone.unionByName(back).where(F.col("wrong").isNull() | (F.col("relation") == F.col("wrong"))).select(F.lit("remove").alias("op"), "src", "relation", "dst").distinct()
    return gone.unionByName(fixes.select(F.lit("add").alias("op"), F.col("a").alias("src"), F.col("right").alias("relation"), F.col("b").alias("dst")))
