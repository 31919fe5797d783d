"""The read tools: lookup with set questions, aggregate, entity walk, timeline, history, upcoming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.recurrence import expand_rrules
from palimpsest.operators.graph import parts
from palimpsest.operators.filters import Access, Filters, Window, apply, entity_items, in_window, live_rank, point_in, scoped
from palimpsest.schema import DIMENSION_UNITS, LENGTH_HOURS


# ---------------------------------------------------------------- set questions

def shared_entity_items(items: DataFrame, item_entities: DataFrame, access: Access, kind: str) -> DataFrame:
    """(item_id) of items whose about or at entity also belongs to another active item of ``kind``."""
    ends = item_entities.where(F.col("role").isin("about", "at")).select("item_id", "entity_id")
    others = scoped(items, access).where(F.col("kind") == kind).select(F.col("item_id").alias("other"))
    theirs = item_entities.select(F.col("item_id").alias("other"), F.col("entity_id").alias("e")).join(others, "other")
    pairs = ends.join(theirs.groupBy("e").agg(F.min("other").alias("low"), F.max("other").alias("high")), F.col("entity_id") == F.col("e"))
    # an entity has another item than this one unless its only one is this one
    return pairs.where((F.col("low") != F.col("item_id")) | (F.col("high") != F.col("item_id"))).select("item_id").distinct()


def without_kind(hits: DataFrame, items: DataFrame, item_entities: DataFrame, access: Access, kind: str) -> DataFrame:
    """Keep hits whose about and at entities have no other active item of ``kind``."""
    return hits.join(shared_entity_items(items, item_entities, access, kind), "item_id", "left_anti")


def shared_with(hits: DataFrame, items: DataFrame, item_entities: DataFrame, access: Access, entity_id: int) -> DataFrame:
    """Keep hits linked with the entity, or whose about or at entity an active item linked with it shares."""
    direct = entity_items(item_entities, (entity_id,))
    active = scoped(items, access).select("item_id")
    near = item_entities.join(direct.join(active, "item_id", "left_semi"), "item_id", "left_semi")
    near = near.groupBy("entity_id").agg(F.min("item_id").alias("low"), F.max("item_id").alias("high"))
    ends = item_entities.where(F.col("role").isin("about", "at")).join(near, "entity_id")
    ends = ends.where((F.col("low") != F.col("item_id")) | (F.col("high") != F.col("item_id"))).select("item_id")
    return hits.join(direct.unionByName(ends).distinct(), "item_id", "left_semi")


# ---------------------------------------------------------------- lookup and aggregate

def lookup(hits: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` hits, live ones first, each with its rank and the total before the limit."""
    total = hits.agg(F.count("*").alias("total"))
    top = hits.orderBy(*live_rank()).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*live_rank()))).crossJoin(F.broadcast(total))


def numeric(field: str) -> Column:
    """A field of an item as a decimal, null unless it is a plain number.

    The field is an attribute, or ``value``; a named dimension that no attribute states is the logged value if its unit
    is one of the dimension's. What the attribute says counts even where it is no number.
    """
    value = F.col("value_number").cast("decimal(38,10)")
    if field in ("value", "value.number"):
        return value
    name = field.removeprefix("attributes.")
    raw = F.get_json_object("attributes", f"$.{name}")
    plain = F.when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), raw.try_cast("decimal(38,10)"))
    units = DIMENSION_UNITS.get(name.lower())
    return F.when(raw.isNotNull(), plain).when(F.lower("value_unit").isin(*units), value) if units else plain


def group_key(by: str, timezone: str = "UTC") -> Column:
    """Day, ISO week or month in local time, or the subtype."""
    if by == "subtype":
        return F.coalesce("subtype", F.lit("(none)"))
    at = F.from_utc_timestamp(F.coalesce("occurred_start", "due_at", "mentioned_at"), timezone)
    if by == "week":
        return F.when(at.isNotNull(), F.concat(F.extract(F.lit("YEAROFWEEK"), at), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0")))
    return F.date_format(at, {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[by])


def aggregate(hits: DataFrame, op: str = "count", field: str | None = None, by: str | None = None, timezone: str = "UTC") -> DataFrame:
    """One row per counted item: (item_id, value, total, grp, grp_value, grp_count).

    count, sum, min, max or average (avg) over the whole and per group. Other ops than count leave rows out that hold no
    number. Both aggregates are group-bys joined back on a small side, so that no window sees all rows in one task.
    """
    rows = hits.withColumn("at", F.coalesce("occurred_start", "due_at", "mentioned_at"))
    rows = rows.withColumn("value", F.lit(1).cast("decimal(38,10)") if op == "count" else numeric(field))
    rows = rows.withColumn("grp", group_key(by, timezone) if by else F.lit(None).cast("string")).where("value is not null")
    rows = rows.select("item_id", "at", "value", "grp")
    agg = F.count("value").cast("double") if op == "count" else getattr(F, {"average": "avg"}.get(op, op))("value").cast("double")
    total = rows.agg(agg.alias("total"))
    groups = rows.where("grp is not null").groupBy("grp").agg(agg.alias("grp_value"), F.count("*").alias("grp_count"), F.min(F.struct("at", "item_id")).alias("first"))
    return rows.join(groups, "grp", "left").crossJoin(F.broadcast(total)).select("item_id", F.col("value").cast("double").alias("value"), "total", "grp", "grp_value", "grp_count", "first")


def aggregate_groups(hits: DataFrame, op: str, field: str | None, by: str, timezone: str = "UTC") -> DataFrame:
    """(grp, grp_value, grp_count, place): groups in the order of their first item by time."""
    out = aggregate(hits, op, field, by, timezone).where("grp is not null").groupBy("grp").agg(
        F.first("grp_value").alias("grp_value"), F.first("grp_count").alias("grp_count"), F.first("first").alias("first"))
    return out.withColumn("place", F.row_number().over(W.orderBy("first", "grp"))).drop("first")


# ---------------------------------------------------------------- graph

def walk(start: DataFrame, relations: DataFrame, entities: DataFrame, hops: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """Entities reached from ``start(entity_id)`` over exactly ``len(hops)`` hops (two at most).

    A hop has the relations followed forwards and those followed backwards. Ended relations and inactive entities
    are left out; each entity is reached once.
    """
    if len(hops) > 2:
        raise ValueError("a path has two hops at most")
    open_rel = relations.where(~F.col("ended"))
    active = entities.where("status = 'active'").select("entity_id")
    cur = start.select("entity_id").distinct()
    for forward, backward in hops:
        steps = []
        if forward:
            steps.append(open_rel.where(F.col("relation").isin(*forward)).select(F.col("src").alias("entity_id"), F.col("dst").alias("to")))
        if backward:
            steps.append(open_rel.where(F.col("relation").isin(*backward)).select(F.col("dst").alias("entity_id"), F.col("src").alias("to")))
        edges = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
        cur = cur.join(edges, "entity_id").select(F.col("to").alias("entity_id")).distinct().join(active, "entity_id", "left_semi")
    return cur


def entity_tool(reached: DataFrame, items: DataFrame, item_entities: DataFrame, access: Access, limit: int = 50) -> DataFrame:
    """Items that are about or linked with the reached entities, ranked live first."""
    ids = reached.select("entity_id")
    linked = item_entities.join(ids, "entity_id", "left_semi").select("item_id")
    subject = items.join(ids, F.col("subject_entity_id") == F.col("entity_id"), "left_semi").select("item_id")
    hits = scoped(items, access).join(linked.unionByName(subject).distinct(), "item_id", "left_semi")
    top = hits.orderBy(*live_rank()).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*live_rank())))


def supersede_chain(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(item_id) of the seeds and all items joined to them by ``supersedes`` links, either way, however long the chain.

    The links are taken apart into connected parts (``graph.parts``), which takes a number of rounds that grows with the logarithm of the
    longest chain; then those of the seeds are looked up.
    """
    found = parts(links.where("link_type = 'supersedes'").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    mine = found.join(seeds.select(F.col("item_id").alias("node")), "node", "left_semi").select("part").distinct()
    joined = found.join(mine, "part", "left_semi").select(F.col("node").alias("item_id"))
    return joined.unionByName(seeds.select(F.col("item_id").cast("bigint").alias("item_id"))).distinct()


def because(chain: DataFrame, links: DataFrame, items: DataFrame, access: Access) -> DataFrame:
    """(item_id) of items linked with the chain by ``because``, either way."""
    edges = links.where("link_type = 'because'")
    out = edges.join(chain.withColumnRenamed("item_id", "src"), "src", "left_semi").select(F.col("dst").alias("item_id"))
    back = edges.join(chain.withColumnRenamed("item_id", "dst"), "dst", "left_semi").select(F.col("src").alias("item_id"))
    return out.unionByName(back).distinct().join(scoped(items, access), "item_id", "left_semi")


def history(seeds: DataFrame, links: DataFrame, items: DataFrame, access: Access) -> DataFrame:
    """(what, item_id, at): the supersede chain of the seeds in order of validity, then what it is linked with by ``because``."""
    chain = supersede_chain(seeds, links)
    at = F.coalesce("valid_from", "occurred_start", "mentioned_at", "created_at").alias("at")
    rows = scoped(items, access).join(chain, "item_id", "left_semi").select(F.lit("history").alias("what"), "item_id", at)
    why = because(chain, links, items, access).join(chain, "item_id", "left_anti")
    why = items.join(why, "item_id", "left_semi").select(F.lit("because").alias("what"), "item_id", at)
    return rows.unionByName(why)


# ---------------------------------------------------------------- timeline

def timeline(
    items: DataFrame, triggers: DataFrame, w: Window, f: Filters, access: Access, now: datetime, timezone: str = "UTC",
    item_entities: DataFrame | None = None, limit: int | None = 100,
) -> DataFrame:
    """(item_id, clock, start, end, upcoming) of what lies in the window, earliest first.

    The occurred clock also shows routines, due dates and pending triggers; other clocks show themselves. Routines
    are plans still scheduled, expanded in local time.
    """
    hits = apply(items, f, access, item_entities, triggers, use_window=False)
    row = lambda df, clock, start, end: df.select("item_id", F.lit(clock).alias("clock"), start.alias("start"), end.alias("end"))
    none = F.lit(None).cast("timestamp")
    parts = []
    if w.clock == "occurred":
        single = hits.where("rrule is null").where(in_window(w))
        parts.append(row(single, "occurred", F.col("occurred_start"), F.col("occurred_end")))
        routines = hits.where("rrule is not null and state = 'scheduled' and occurred_start is not null")
        parts.append(expand_rrules(routines, w.start, w.end, timezone).select("item_id", F.lit("routine").alias("clock"), "start", "end"))
    if w.clock in ("occurred", "due"):
        parts.append(row(hits.where(point_in(F.col("due_at"), w)), "due", F.col("due_at"), none))
    if w.clock in ("occurred", "trigger"):
        fires = triggers.where((F.col("state") == "pending") & point_in(F.col("fires_at"), w)).select("item_id", "fires_at")
        parts.append(row(hits.select("item_id").join(fires, "item_id"), "trigger", F.col("fires_at"), none))
    if w.clock == "valid":
        parts.append(row(hits.where(in_window(w)), "valid", F.col("valid_from"), F.col("valid_to")))
    if w.clock == "mentioned":
        parts.append(row(hits.where(in_window(w)), "mentioned", F.col("mentioned_at"), none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("upcoming", F.col("start") >= F.lit(now))
    return out.orderBy("start", "item_id", "clock").limit(limit) if limit else out


def upcoming_days(entries: DataFrame, items: DataFrame, timezone: str = "UTC") -> DataFrame:
    """(local_day, n, item_ids): entries of open items by local day, one a (item, start)."""
    open_items = items.where(F.col("state").isin("scheduled", "open", "current", "active", "wanted", "saved", "confirmed")).select("item_id")
    one = entries.join(open_items, "item_id", "left_semi").dropDuplicates(["item_id", "start"])
    day = F.to_date(F.from_utc_timestamp("start", timezone))
    return one.groupBy(day.alias("local_day")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("item_ids"))


def due_soon(entries: DataFrame, items: DataFrame, now: datetime, hours: int = 24, shown: int = 3) -> DataFrame:
    """One row: how many entries start within ``hours`` and a note that names the first of them."""
    soon = entries.where((F.col("start") >= F.lit(now)) & (F.col("start") < F.lit(now) + F.expr(f"INTERVAL '{hours}' HOUR")))
    rows = soon.join(items.select("item_id", "title"), "item_id")
    first = rows.orderBy("start", "item_id", "title").limit(shown).agg(F.array_sort(F.collect_list(F.struct("start", "item_id", "title"))).alias("a"))
    names = F.array_join(F.transform("a", lambda x: x["title"]), ", ")
    got = rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first))
    return got.select("n", F.when(F.col("n") > shown, F.concat(names, F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise(names).alias("note"))


def default_length(precision: Column) -> Column:
    """Hours that an occurrence lasts if its end is not known."""
    out = F.lit(LENGTH_HOURS["day"])
    for name in ("datetime", "month", "year"):
        out = F.when(precision == name, LENGTH_HOURS[name]).otherwise(out)
    return out
