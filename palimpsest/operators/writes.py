"""Write path: operations applied as an append-only log of versions, held batches, undo, reconciliation, policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import adds_detail
from palimpsest.operators.nearest import nearest
from palimpsest.schema import BULK_THRESHOLD, CORE_BUDGET, FREQUENT_MIN, STATES


def legal_state(kind: Column, state: Column) -> Column:
    """Whether a state belongs to a kind."""
    tests = [(kind == k) & state.isin(*s) for k, s in STATES.items()]
    return reduce(lambda a, b: a | b, tests)


def split_ops(ops: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """State changes ops(turn_id, seq, item_id, state) as ``applied``, ``held`` and ``rejected``.

    A turn that edits more than the threshold of items is held as a whole; an unknown item or a state that is not its
    kind's is rejected. Distinct items are counted per turn by two group-bys, so no turn is gathered in one task.
    """
    edited = ops.select("turn_id", "item_id").distinct().groupBy("turn_id").agg(F.count("*").alias("edited"))
    rows = ops.join(items.select("item_id", "kind", F.col("state").alias("old")), "item_id", "left").join(edited, "turn_id")
    fine = F.coalesce(legal_state(F.col("kind"), F.col("state")), F.lit(False))
    bulk = F.col("edited") > BULK_THRESHOLD
    return {"applied": rows.where(fine & ~bulk), "held": rows.where(fine & bulk), "rejected": rows.where(~fine)}


def write_log(applied: DataFrame) -> DataFrame:
    """(turn_id, seq, item_id, before, after, version): each op with the state before it and the version it makes."""
    w = W.partitionBy("item_id").orderBy("turn_id", "seq")
    return applied.select("turn_id", "seq", "item_id", F.coalesce(F.lag("state").over(w), F.col("old")).alias("before"), F.col("state").alias("after"), F.row_number().over(w).alias("version"))


def current_states(items: DataFrame, log: DataFrame) -> DataFrame:
    """(item_id, state): the last version of each item, or the stored state."""
    last = log.groupBy("item_id").agg(F.max_by("after", "version").alias("after"))
    return items.join(last, "item_id", "left").select("item_id", F.coalesce("after", "state").alias("state"))


def undo(log: DataFrame, turn_id: int) -> DataFrame:
    """(item_id, restored, conflict) for a turn: the state before its first change, or a conflict if a later turn changed it."""
    mine = log.where(F.col("turn_id") == turn_id).groupBy("item_id").agg(F.min_by("before", "version").alias("restored"))
    later = log.where(F.col("turn_id") > turn_id).select("item_id").distinct().withColumn("conflict", F.lit(True))
    return mine.join(later, "item_id", "left").select("item_id", "restored", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def core_budget(core: DataFrame, budget: int = CORE_BUDGET) -> DataFrame:
    """(workspace_id, item_id, tokens, held): items in order until the workspace's budget of tokens is spent.

    The running sum is that of the months before plus that within the month, so a large workspace is not one task.
    """
    rows = core.select("workspace_id", "item_id", "created_at", F.ceil(F.length("text") / 4).alias("tokens"), F.trunc("created_at", "month").alias("month"))
    months = rows.groupBy("workspace_id", "month").agg(F.sum("tokens").alias("spent"))
    before = F.sum("spent").over(W.partitionBy("workspace_id").orderBy("month").rowsBetween(W.unboundedPreceding, -1))
    months = months.select("workspace_id", "month", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("tokens").over(W.partitionBy("workspace_id", "month").orderBy("created_at", "item_id"))
    return rows.join(months, ["workspace_id", "month"]).withColumn("held", F.col("before") + within > budget).drop("created_at", "month", "before")


#: Roles and kinds of the things that an item is about; similarity from which an item may be the same one, and how many are looked at. Fixed values.
THING_ROLES, THING_KINDS = ("about", "at", "part_of"), ("work", "thing", "place", "topic", "project")
SAME_AT, SIMILAR, RELATED = 0.85, 5, 5


def _newest(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each key with ``n``; Spark cuts groups before they are shuffled."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.col("created_at").desc(), F.col("item_id").desc()))
    return rows.withColumn("n", place).where(F.col("n") <= n)


def _first(hits: DataFrame, *order: Column | str) -> DataFrame:
    """Of each draft the first hit."""
    return hits.withColumn("__n", F.row_number().over(W.partitionBy("draft_id").orderBy(*order))).where("__n = 1").drop("__n")


def similar_items(drafts: DataFrame, stored: DataFrame, keys: DataFrame, k: int = SIMILAR, floor: float = SAME_AT) -> DataFrame:
    """(draft_id, item_id, score, place) of the ``k`` active items nearest to each draft(draft_id, embedding) that reach ``floor``."""
    live = keys.where("embedding is not null").join(stored.where("status = 'active'").select("item_id"), "item_id", "left_semi")
    asked = drafts.where("embedding is not null").select("draft_id", F.col("embedding").alias("vector"))
    different = asked.groupBy("vector").agg(F.min("draft_id").alias("question_id"))  # copies of a vector ask once
    found = nearest(different, live.select(F.col("item_id").alias("id"), F.col("embedding").alias("vector")), k, floor)
    asked = asked.hint("merge").join(different, "vector").select("draft_id", "question_id")
    return asked.join(found.hint("merge"), "question_id").select("draft_id", F.col("id").alias("item_id"), "score", "place")


def reconcile(drafts: DataFrame, draft_entities: DataFrame, stored: DataFrame, item_entities: DataFrame, keys: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """(draft_id, decision, target, score, rule) of new items against the stored ones; the first rule that meets decides.

    Drafts(draft_id, kind, subtype, subject_entity_id, predicate, value_number, attributes, occurred_start, precision, embedding) may be stored
    under their own id already, which is never their target; draft_entities(draft_id, entity_id, role, kind) are the entities they name.
    A fact or preference meets the newest current one of its kind, subject and predicate: ``no_op`` if both say the same, else ``supersede``. An
    episode fulfils the newest open wish for one of its things, of the first thing that has one; or is the one of the same time, precision,
    subtype and entities (``no_op``); it never merges otherwise. An intention meets an open wish of its subtype for one of its things:
    ``add_detail`` if it has attributes that the wish lacks, else ``no_op``. For a plan, scheduled plans of its subtype with a shared entity, up
    to five, are candidates; else, for any draft, the five nearest active items at 0.85 or above that are no episodes and not about
    other things. Among candidates choices(draft_id, decision, index) decide; without a choice the item is new.
    """
    about = F.col("role").isin(*THING_ROLES)
    live = stored.where("status = 'active'")
    entities = draft_entities.select("draft_id", "entity_id", "role", "kind").distinct()
    things = entities.where(about & F.col("kind").isin(*THING_KINDS)).select("draft_id", "entity_id").distinct()
    subjects = live.where("subject_entity_id is not null").select("item_id", F.col("subject_entity_id").alias("entity_id"))
    held = item_entities.select("item_id", "entity_id").unionByName(subjects).distinct().join(live.hint("merge"), "item_id")

    other = lambda x: x["item_id"] != drafts["draft_id"]
    # facts
    facts = _newest(live.where("kind in ('fact', 'preference') and valid_to is null").select("kind", "subject_entity_id", "predicate", "item_id", "created_at", "value_number"), ["kind", "subject_entity_id", "predicate"], 2)
    on = (drafts["kind"] == facts["kind"]) & (drafts["subject_entity_id"] == facts["subject_entity_id"]) & (drafts["predicate"] == facts["predicate"]) & other(facts)
    fact = drafts.join(facts.hint("merge"), on).select("draft_id", facts["item_id"], "n", drafts["value_number"].eqNullSafe(facts["value_number"]).alias("equal"))
    fact = _first(fact, "n").select("draft_id", F.struct(F.when(F.col("equal"), "no_op").otherwise("supersede").alias("decision"), F.col("item_id").alias("target"), F.lit(1.0).alias("score"), F.when(F.col("equal"), "same fact").otherwise("new value").alias("rule")).alias("fact"))
    # wishes
    open_ = held.where("kind = 'intention' and state in ('wanted', 'active')").select("entity_id", "subtype", "item_id", "created_at", "attributes")
    wish = _newest(open_, ["entity_id"], 1)
    meets = things.join(drafts.where("kind = 'episode'").select("draft_id").hint("merge"), "draft_id").join(wish.hint("merge"), "entity_id")
    fulfil = _first(meets, "entity_id").select("draft_id", F.struct(F.lit("fulfil").alias("decision"), F.col("item_id").alias("target"), F.lit(1.0).alias("score"), F.lit("wish met").alias("rule")).alias("fulfil"))
    wishes = _newest(open_, ["entity_id", "subtype"], 2)
    asked = things.join(drafts.where("kind = 'intention'").select("draft_id", F.col("subtype").alias("s"), F.col("attributes").alias("now")).hint("merge"), "draft_id")
    again = asked.join(wishes.hint("merge"), (asked["entity_id"] == wishes["entity_id"]) & asked["s"].eqNullSafe(wishes["subtype"]) & (asked["draft_id"] != wishes["item_id"])).select("draft_id", asked["entity_id"], "n", "item_id", "now", "attributes")
    more = adds_detail(F.from_json("attributes", "map<string,string>"), F.from_json("now", "map<string,string>"))
    again = _first(again, "entity_id", "n").select("draft_id", F.struct(F.when(more, "add_detail").otherwise("no_op").alias("decision"), F.col("item_id").alias("target"), F.lit(1.0).alias("score"), F.lit("same wish").alias("rule")).alias("again"))
    # episodes: the entities of each as one value
    whole = lambda rows, key: rows.groupBy(key).agg(F.array_sort(F.collect_set("entity_id")).alias("e"))
    told = live.where("kind = 'episode' and occurred_start is not null").select("item_id", "occurred_start", "precision", "subtype", "created_at").join(whole(item_entities, "item_id").hint("merge"), "item_id", "left")
    told = _newest(told.withColumn("e", F.coalesce("e", F.array().cast("array<bigint>"))), ["occurred_start", "precision", "subtype", "e"], 2)
    mine = drafts.where("kind = 'episode' and occurred_start is not null").join(whole(entities, "draft_id").hint("merge"), "draft_id", "left").select("draft_id", "occurred_start", "precision", "subtype", F.coalesce("e", F.array().cast("array<bigint>")).alias("e"))
    equal = [mine[c].eqNullSafe(told[c]) for c in ("occurred_start", "precision", "subtype", "e")]
    twin = mine.join(told.hint("merge"), [*equal, mine["draft_id"] != told["item_id"]]).select("draft_id", "item_id", "n")
    twin = _first(twin, "n").select("draft_id", F.struct(F.lit("no_op").alias("decision"), F.col("item_id").alias("target"), F.lit(1.0).alias("score"), F.lit("same episode").alias("rule")).alias("twin"))
    # plans
    plans = _newest(held.where("kind = 'plan' and state = 'scheduled'").select("entity_id", "subtype", "item_id", "created_at"), ["entity_id", "subtype"], RELATED + 1)
    planned = entities.where("kind <> 'self'").select("draft_id", "entity_id").distinct().join(drafts.where("kind = 'plan'").select("draft_id", F.col("subtype").alias("s")).hint("merge"), "draft_id")
    related = planned.join(plans.hint("merge"), (planned["entity_id"] == plans["entity_id"]) & planned["s"].eqNullSafe(plans["subtype"]) & (planned["draft_id"] != plans["item_id"])).select("draft_id", planned["entity_id"], "n", "item_id")
    related = related.groupBy("draft_id", "item_id").agg(F.min(F.struct("entity_id", "n")).alias("o"))
    listed = lambda rows, order, score: rows.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("item_id").alias("target"), score.alias("score")))).alias("c"))
    related = listed(related, "o", F.lit(None).cast("double")).select("draft_id", F.transform(F.slice("c", 1, RELATED), lambda x: F.struct(x["target"].alias("target"), x["score"].alias("score"))).alias("related"))
    # similar items
    theirs = item_entities.where(about).groupBy("item_id").agg(F.collect_set("entity_id").alias("theirs"))
    ours = things.groupBy("draft_id").agg(F.collect_set("entity_id").alias("ours"))
    near = similar_items(drafts.where("kind <> 'episode'"), stored, keys).join(live.where("kind <> 'episode'").select("item_id").hint("merge"), "item_id").where("item_id <> draft_id")
    near = near.join(theirs.hint("merge"), "item_id", "left").join(ours.hint("merge"), "draft_id", "left").where(F.col("theirs").isNull() | F.col("ours").isNull() | F.arrays_overlap("theirs", "ours"))
    near = listed(near, "place", F.col("score")).select("draft_id", F.transform("c", lambda x: F.struct(x["target"].alias("target"), x["score"].alias("score"))).alias("near"))

    out = drafts.select("draft_id", "kind")
    for part in (fact, fulfil, again, twin, related, near):
        out = out.join(part.hint("merge"), "draft_id", "left")  # as many as drafts: a small file is no small table in memory
    if choices is None:
        out = out.withColumns({"choice": F.lit(None).cast("string"), "index": F.lit(None).cast("int")})
    else:
        out = out.join(choices.groupBy("draft_id").agg(F.min(F.struct(F.col("decision").alias("choice"), "index")).alias("x")).select("draft_id", "x.*").hint("merge"), "draft_id", "left")
    plan = F.col("related").isNotNull()
    candidates = F.when(plan, F.col("related")).otherwise(F.col("near"))
    why = F.when(plan, "plan for the same thing").otherwise("similar")
    chosen = F.when((F.col("choice") != "new") & (F.col("index") >= 0), F.get(candidates, F.col("index")))
    nothing = lambda rule: F.struct(F.lit("new").alias("decision"), F.lit(None).cast("bigint").alias("target"), F.lit(None).cast("double").alias("score"), rule.alias("rule"))
    asked = F.when(chosen.isNotNull(), F.struct(F.col("choice").alias("decision"), chosen["target"].alias("target"), chosen["score"].alias("score"), why.alias("rule"))).otherwise(
        nothing(F.when(candidates.isNull(), "nothing similar").otherwise(why)))
    result = F.coalesce("fact", F.when(F.col("kind") == "episode", F.coalesce("fulfil", "twin", nothing(F.lit("episodes never merge")))), "again", asked)
    return out.select("draft_id", result.alias("r")).select("draft_id", "r.*")


#: Origins that are the user's own, and operations that text read from elsewhere may propose. Fixed values.
USER_ORIGINS, CONTENT_OPS = ("user_message", "undo", "confirm", "ui_edit"), ("create", "link", "upsert_entity")
#: Verdicts by severity: of the rules that apply the first of the most severe ones counts. Fixed values.
VERDICTS = {"allowed": 0, "held": 1, "blocked": 2}


def policy(ops: DataFrame, threshold: int = BULK_THRESHOLD) -> DataFrame:
    """``ops`` with ``verdict`` and ``rule``.

    Columns: op, target, kind, origin, trust, sensitivity, modality, confidence, core_write, creates_trigger,
    edits_existing, layer_only, fills_own_item, and of the turn confirmed, turn_kind, edited_items.
    """
    c = F.col
    content = (c("trust") == "content") & ~(~c("core_write") & (c("op") == "update") & c("fills_own_item") & ~c("creates_trigger"))
    oversteps = (c("kind") == "rule") | c("creates_trigger") | ~c("op").isin(*CONTENT_OPS)
    inferred = ((c("kind") == "pattern") | ((c("confidence") < 1) & (c("turn_kind") == "system"))) & (c("target") == "item") & ~c("op").isin("delete", "unlink", "unrelate")
    edits = ~c("confirmed") & ~c("layer_only") & c("edits_existing")
    rules = [
        ("P-SECRET-1", c("sensitivity") == "secret", "blocked"), ("P-TRUST-1", content & c("core_write"), "held"), ("P-TRUST-1", content & ~c("core_write") & oversteps, "blocked"),
        ("P-MOD-1", (c("modality") == "hypothetical") & (((c("op") == "create") & (c("kind") != "note")) | c("core_write")), "blocked"),
        ("P-INFER-1", inferred & ~c("confirmed") & ~c("layer_only"), "held"), ("P-SENS-1", c("core_write") & (c("sensitivity") == "sensitive") & ~c("confirmed"), "held"),
        ("P-CORE-1", c("core_write") & ~c("confirmed") & ~c("origin").isin(*USER_ORIGINS), "held"),
        ("P-BULK-1", edits & (((c("op") == "delete") & ~c("origin").isin("undo", "system")) | (c("edited_items") > threshold)), "held")]
    hits = F.array(F.struct(F.lit(0).alias("s"), F.lit(-len(rules)).alias("i"), F.lit("P-DEFAULT").alias("rule"), F.lit("allowed").alias("v")), *[
        F.when(cond, F.struct(F.lit(VERDICTS[v]).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("rule"), F.lit(v).alias("v"))) for i, (name, cond, v) in enumerate(rules)])
    worst = F.array_max(F.array_compact(hits))
    return ops.withColumn("__worst", worst).withColumn("verdict", F.col("__worst.v")).withColumn("rule", F.col("__worst.rule")).drop("__worst")


def frequent(access: DataFrame, since: Column, least: int = FREQUENT_MIN) -> DataFrame:
    """Items cited in at least so many distinct turns since an instant."""
    turns = access.where(F.col("cited") & (F.col("at") >= since)).select("item_id", "turn_id").distinct()
    return turns.groupBy("item_id").agg(F.count("*").alias("turns")).where(F.col("turns") >= least)


def quick_reason(items: DataFrame, hot: DataFrame, now: Column, horizon_days: int = 30, recent_days: int = 7) -> DataFrame:
    """(item_id, reason) of the quick layer: due or occurring within the horizon, frequently cited, then recently told; the first reason counts."""
    rows = items.join(hot.select("item_id").withColumn("hot", F.lit(True)), "item_id", "left")
    ahead = lambda c: (F.col(c) >= now) & (F.col(c) < now + F.make_dt_interval(F.lit(horizon_days)))
    reason = F.when(ahead("due_at"), "due").when(ahead("occurred_start"), "ahead").when(F.col("hot"), "frequent").when((F.col("mentioned_at") <= now) & (F.col("mentioned_at") > now - F.make_dt_interval(F.lit(recent_days))), "recent")
    return rows.select("item_id", reason.alias("reason")).where("reason is not null")


def expired_triggers(triggers: DataFrame, now: Column) -> DataFrame:
    """Pending triggers whose time has passed, as expired."""
    return triggers.where((F.col("state") == "pending") & (F.col("fires_at") < now)).withColumn("state", F.lit("expired"))
