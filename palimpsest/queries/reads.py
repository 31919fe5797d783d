"""Queries over scans, filters, joins and the read tools."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import filters as fl
from palimpsest.operators import tools as tl
from palimpsest.operators.filters import Access, Filters, Window
from palimpsest.queries.registry import Tables, query
from palimpsest.queries.words import cases, known
from palimpsest.sources import files
from palimpsest.sources import storage as st
from palimpsest.sources.buckets import BucketTable

ALL = Access()
NOW = datetime(1998, 3, 10, 9, 30)
START, END = datetime(1998, 3, 1), datetime(1998, 4, 1)
SPAN = "TIMESTAMP '1998-03-01' AS s, TIMESTAMP '1998-04-01' AS e"
SCOPE = "i.status = 'active' AND i.sensitivity NOT IN ('secret', 'sensitive')"
LIVE = "i.valid_to IS NULL AND i.state IN ('current', 'active', 'confirmed', 'wanted', 'open', 'scheduled', 'saved')"
RANK = f"({LIVE}) DESC, coalesce(i.occurred_start, i.due_at, i.valid_from, i.mentioned_at) DESC, lower(i.title), i.item_id"
CATEGORY = "(i.category = 'work' OR starts_with(i.category, 'work/'))"


def ids(df: DataFrame) -> DataFrame:
    return df.select("item_id", "kind", "state")


def picked(where: str, joins: str = "") -> str:
    return f"SELECT i.item_id, i.kind, i.state FROM items i {joins} WHERE {SCOPE} AND {where}"


# ---------------------------------------------------------------- scans and sinks

@query(picked("i.workspace_id = 2"))
def scan_scoped(t: Tables) -> DataFrame:
    return ids(fl.scoped(t["items"], Access(2)))


@query("SELECT item_id, kind, state FROM items WHERE item_id IN (3, 7, 14, 500)")
def scan_point(t: Tables) -> DataFrame:
    return ids(st.by_ids(t["items"], [3, 7, 14, 500]))


@query(f"SELECT i.item_id, i.kind, i.state FROM items i WHERE {SCOPE} AND i.kind IN ('plan', 'task') AND i.valid_to IS NULL "
       "ORDER BY i.created_at DESC, i.item_id DESC LIMIT 200")
def scan_find_items(t: Tables) -> DataFrame:
    return ids(st.newest(fl.apply(t["items"], Filters(kinds=("plan", "task"), current_only=True), ALL)))


@query("SELECT DISTINCT src, relation, dst, ended FROM relations WHERE src IN (20000003, 7) OR dst IN (20000003, 7)")
def scan_edges(t: Tables) -> DataFrame:
    return st.touching(t["relations"], t.spark.createDataFrame([(20000003,), (7,)], "node bigint"))


@query("SELECT item_id, kind, state FROM items WHERE item_id < 5000 ORDER BY item_id DESC LIMIT 50")
def page_keyset(t: Tables) -> DataFrame:
    return ids(st.page_before(t["items"], "item_id", 5000, 50))


def stored(t: Tables, rows: DataFrame, key: list[str]) -> BucketTable:
    """A table in buckets that a query writes to."""
    return BucketTable.create(rows, f"{st.shared_dir(t.spark)}/palimpsest/table-{uuid.uuid4().hex}", key, 16)


@query("SELECT * FROM entities WHERE kind = 'place' UNION ALL SELECT entity_id, kind, upper(name), status FROM entities WHERE kind <> 'place' "
       "AND entity_id NOT IN (SELECT entity_id FROM entities WHERE kind = 'place')")
def sink_upsert(t: Tables) -> DataFrame:
    table = stored(t, t["entities"].where("kind = 'place'"), ["entity_id"])
    table.upsert_missing(t["entities"].withColumn("name", F.upper("name")), 1)
    return table.read()


@query("SELECT item_id, entity_id, role FROM item_entities WHERE item_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0) "
       "UNION ALL SELECT o_orderkey, o_custkey, 'by' FROM orders WHERE o_orderkey % 10 = 0")
def sink_replace_set(t: Tables) -> DataFrame:
    new = t["orders"].where("o_orderkey % 10 = 0").selectExpr("o_orderkey AS item_id", "o_custkey AS entity_id", "'by' AS role")
    table = stored(t, t["item_entities"], ["item_id"])
    table.replace_sets(new, 1)
    return table.read()


@query("WITH c AS (SELECT item_id, count(*) AS n FROM access GROUP BY 1) SELECT a.item_id, c.n AS access_count, "
       "CASE WHEN a.item_id % 2 = 0 THEN 'new' ELSE 'old' END AS title FROM (SELECT DISTINCT item_id FROM access) a JOIN c ON a.item_id = c.item_id")
def sink_replace(t: Tables) -> DataFrame:
    before = st.access_counters(t["access"]).select("item_id", "access_count", F.lit("old").alias("title"))
    new = before.where("item_id % 2 = 0").select("item_id", F.lit(0).cast("bigint").alias("access_count"), F.lit("new").alias("title"))
    table = stored(t, before, ["item_id"])
    table.replace_rows(new, 1, ["access_count"])
    return table.read()


@query("SELECT l.turn_id, l.seq, w.owner_id, (l.system OR coalesce(o.o_orderpriority = '5-LOW', FALSE)) AS system FROM ledger l "
       "JOIN workspaces w ON l.workspace_id = w.workspace_id LEFT JOIN orders o ON o.o_orderkey = l.turn_id AND o.o_orderkey % 2 = 0")
def sink_ledger(t: Tables) -> DataFrame:
    turns = t["orders"].where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS turn_id", "CASE WHEN o_orderpriority = '5-LOW' THEN 'system' ELSE 'user' END AS kind")
    return st.ledger_rows(t["ledger"], t["workspaces"], turns).select("turn_id", "seq", "owner_id", "system")


@query("SELECT item_id, count(*) AS access_count, floor(epoch(max(\"at\")))::BIGINT AS last_at, sum(cited::BIGINT)::BIGINT AS cited_count FROM access GROUP BY 1")
def sink_access(t: Tables) -> DataFrame:
    return st.access_counters(t["access"]).select("item_id", "access_count", F.unix_timestamp("last_accessed_at").alias("last_at"), "cited_count")


@query("SELECT kind, count(*) AS n, sum(epoch(occurred_start + to_days(CASE WHEN rrule IS NOT NULL THEN 14 ELSE 17 END)))::BIGINT AS occurred, "
       "sum(epoch(due_at + to_days(17)))::BIGINT AS due FROM items WHERE workspace_id = 1 GROUP BY 1")
def sink_template_copy(t: Tables) -> DataFrame:
    out = st.copy_template(t["items"], t["links"], t["item_entities"], 1, 9, 17)["items"]
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.unix_timestamp("occurred_start")).alias("occurred"), F.sum(F.unix_timestamp("due_at")).alias("due"))


@query("SELECT 'items' AS name, count(*) AS n FROM items WHERE workspace_id NOT IN (SELECT workspace_id FROM workspaces WHERE tier = 'guest') "
       "UNION ALL SELECT 'ledger', count(*) FROM ledger")
def sink_purge(t: Tables) -> DataFrame:
    left = st.purge({"items": t["items"], "ledger": t["ledger"]}, t["workspaces"].where("tier = 'guest'"))
    count = lambda n: left[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return count("items").unionByName(count("ledger"))


@query("SELECT 'run' || c_custkey || '_' || (i + 1) AS key, strftime(TIMESTAMP '2026-01-05' + to_days((i * (c_custkey % 5 + 1))::INT), '%Y-%m-%d') AS day, (['5', '7', '10'])[(i % 3 + 1)::INT] AS distance, c_name AS who "
       "FROM (SELECT c_custkey, c_name, unnest(range(c_custkey % 9)) AS i FROM customer)")
def src_yaml_spec(t: Tables) -> DataFrame:
    """Specifications written as files of lines, one series for each customer, and read back row by row."""
    spec = F.to_json(F.expr("named_struct('name', concat('run', c_custkey), 'count', c_custkey % 9, 'start', '2026-01-05', 'every_days', c_custkey % 5 + 1, "
                            "'fields', named_struct('who', c_name), 'vary', named_struct('distance', array('5', '7', '10')))"))
    path = f"{st.shared_dir(t.spark)}/palimpsest/specs-{uuid.uuid4().hex}"
    t["customer"].select(spec.alias("value")).repartition(4).write.text(path)
    files.register(t.spark)
    out = t.spark.read.format("spec_files").option("lines", "true").load(path)
    return out.select("key", F.substring("at", 1, 10).alias("day"), "distance", "who")


@query(known('text, "at"', [('-12d 07:30', '2026-09-24 02:00'), ('+3d', '2026-10-08 18:30'), ('2026-01-02T10:00Z', '2026-01-02 10:00'), ('2026-01-02T10:00', '2026-01-02 04:30')]))
def src_yaml_time(t: Tables) -> DataFrame:
    rows = cases(t, [("-12d 07:30",), ("+3d",), ("2026-01-02T10:00Z",), ("2026-01-02T10:00",)], "text string")
    at = st.seed_time(F.col("text"), F.lit(datetime(2026, 10, 6, 4, 30)), "Asia/Kolkata")
    return rows.select("text", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


# ---------------------------------------------------------------- filters

@query(picked("i.kind IN ('plan', 'task') AND i.subtype IN ('high', 'low') AND i.state IN ('scheduled', 'open')"))
def f_kinds_subtypes_states(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(kinds=("plan", "task"), subtypes=("high", "low"), states=("scheduled", "open")), ALL))


@query(f"SELECT i.item_id, i.kind, i.state FROM items i WHERE i.status = 'active' AND i.sensitivity <> 'secret' AND {CATEGORY}")
def f_category(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(category="work"), Access(sensitive=True)))


@query(picked("(i.subject_entity_id IN (7, 31) OR i.item_id IN (SELECT item_id FROM item_entities WHERE entity_id IN (7, 31)))"))
def f_entity(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(entity_ids=(7, 31)), ALL, t["item_entities"]))


@query(picked("i.item_id IN (SELECT item_id FROM item_entities WHERE entity_id = 10000003 AND role = 'with')"))
def f_entity_roles(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(entity_ids=(10000003,), roles=("with",)), ALL, t["item_entities"]))


@query(picked("i.predicate = 'p3' AND i.valid_to IS NULL"))
def f_predicate_current(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(predicate="p3", current_only=True), ALL))


@query(picked("lower(trim(json_extract_string(i.attributes, '$.type'))) IN ('running', 'runnings', 'runn', 'run')"))
def f_attribute(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(attribute=("type", "running")), ALL))


@query(picked("i.occurred_start < w.e AND coalesce(i.occurred_end, i.occurred_start + INTERVAL 1 SECOND) > w.s", f"CROSS JOIN (SELECT {SPAN}) w"))
def f_win_occurred(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(window=Window("occurred", START, END)), ALL))


@query(picked("i.due_at >= w.s AND i.due_at < w.e", f"CROSS JOIN (SELECT {SPAN}) w"))
def f_win_due(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(window=Window("due", START, END)), ALL))


@query(picked("i.mentioned_at >= w.s AND i.mentioned_at < w.e", f"CROSS JOIN (SELECT {SPAN}) w"))
def f_win_mentioned(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(window=Window("mentioned", START, END)), ALL))


@query(picked("(i.valid_from IS NULL OR i.valid_from < w.e) AND (i.valid_to IS NULL OR i.valid_to > w.s)", f"CROSS JOIN (SELECT {SPAN}) w"))
def f_win_valid(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(window=Window("valid", START, END)), ALL))


@query(picked("i.item_id IN (SELECT item_id FROM triggers WHERE state = 'pending' AND fires_at >= TIMESTAMP '1998-03-01' AND fires_at < TIMESTAMP '1998-04-01')"))
def f_win_trigger(t: Tables) -> DataFrame:
    return ids(fl.apply(t["items"], Filters(window=Window("trigger", START, END)), ALL, triggers=t["triggers"]))


@query("SELECT i.item_id, i.kind, i.state FROM items i WHERE i.status = 'active' AND i.sensitivity <> 'secret' AND i.in_core AND i.valid_to IS NULL "
       "AND i.state IN ('current', 'active', 'confirmed') AND (i.sensitivity <> 'sensitive' OR i.confirmed)")
def p_core_view(t: Tables) -> DataFrame:
    return ids(fl.core_view(t["items"], ALL))


@query("WITH s AS (SELECT item_id, min(text) AS shown FROM keys WHERE key_kind = 'text' GROUP BY 1), "
       "n AS (SELECT item_id, string_agg(entity_id::VARCHAR || ':' || role, ',' ORDER BY entity_id, role) AS ends FROM item_entities GROUP BY 1) "
       f"SELECT i.item_id, coalesce(s.shown, i.title) AS shown, coalesce(n.ends, '') AS ends FROM items i LEFT JOIN s ON s.item_id = i.item_id LEFT JOIN n ON n.item_id = i.item_id WHERE {SCOPE}")
def p_hydrate(t: Tables) -> DataFrame:
    return hydrated(t, fl.scoped(t["items"], ALL))


def hydrated(t: Tables, hits: DataFrame) -> DataFrame:
    """(item_id, shown, ends) of items: their display text, and entities with roles."""
    shown = t["keys"].where("key_kind = 'text'").groupBy("item_id").agg(F.min("text").alias("key"))
    ends = t["item_entities"].groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "role"))).alias("e"))
    said = F.array_join(F.transform("e", lambda x: F.concat(x["entity_id"].cast("string"), F.lit(":"), x["role"])), ",")
    out = hits.join(shown, "item_id", "left").join(ends, "item_id", "left")
    return out.select("item_id", F.coalesce("key", "title").alias("shown"), F.coalesce(said, F.lit("")).alias("ends"))


# ---------------------------------------------------------------- joins and set questions

_OTHER = ("EXISTS (SELECT 1 FROM item_entities me JOIN item_entities me2 ON me.entity_id = me2.entity_id AND me2.item_id <> me.item_id "
          "JOIN items o ON o.item_id = me2.item_id WHERE me.item_id = i.item_id AND me.role IN ('about', 'at') AND ")


@query(picked(f"i.kind = 'intention' AND NOT {_OTHER} o.kind = 'episode' AND o.status = 'active' AND o.sensitivity NOT IN ('secret', 'sensitive'))"))
def j_anti_without(t: Tables) -> DataFrame:
    hits = fl.apply(t["items"], Filters(kinds=("intention",)), ALL)
    return ids(tl.without_kind(hits, t["items"], t["item_entities"], ALL, "episode"))


@query(picked("(i.item_id IN (SELECT item_id FROM item_entities WHERE entity_id = 7) OR "
              f"{_OTHER} o.status = 'active' AND o.sensitivity NOT IN ('secret', 'sensitive') AND o.item_id IN (SELECT item_id FROM item_entities WHERE entity_id = 7)))"))
def j_exists_shared(t: Tables) -> DataFrame:
    return ids(tl.shared_with(fl.scoped(t["items"], ALL), t["items"], t["item_entities"], ALL, 7))


_HOPS = [(("lives_in",), ()), (("part_of",), ("part_of",))]


@query("WITH a AS (SELECT entity_id FROM entities WHERE status = 'active'), "
       "h1 AS (SELECT DISTINCT dst AS id FROM relations WHERE relation = 'lives_in' AND NOT ended AND src IN (1, 2, 3, 7) AND dst IN (SELECT entity_id FROM a)) "
       "SELECT DISTINCT to_id AS entity_id FROM (SELECT dst AS to_id, src AS at FROM relations WHERE relation = 'part_of' AND NOT ended "
       "UNION ALL SELECT src, dst FROM relations WHERE relation = 'part_of' AND NOT ended) r JOIN h1 ON r.at = h1.id WHERE to_id IN (SELECT entity_id FROM a)")
def j_recursive_walk(t: Tables) -> DataFrame:
    return tl.walk(t.spark.createDataFrame([(1,), (2,), (3,), (7,)], "entity_id bigint"), t["relations"], t["entities"], _HOPS)


_CHAIN = ("WITH RECURSIVE chain(item_id) AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (3, 66, 300, 1500) UNION "
          "SELECT CASE WHEN l.src = c.item_id THEN l.dst ELSE l.src END FROM chain c JOIN links l ON l.link_type = 'supersedes' AND (l.src = c.item_id OR l.dst = c.item_id))")


def _seeds(t: Tables) -> DataFrame:
    return t["items"].where("item_id IN (3, 66, 300, 1500)").select("item_id")


@query(f"{_CHAIN} SELECT item_id FROM chain")
def j_recursive_chain(t: Tables) -> DataFrame:
    return tl.supersede_chain(_seeds(t), t["links"])


@query(f"SELECT i.item_id FROM items i WHERE {SCOPE} AND i.item_id IN (SELECT dst FROM links WHERE link_type = 'because' AND src IN (9, 18, 36, 5, 14) "
       "UNION SELECT src FROM links WHERE link_type = 'because' AND dst IN (9, 18, 36, 5, 14))")
def j_because(t: Tables) -> DataFrame:
    return tl.because(t.spark.createDataFrame([(9,), (18,), (36,), (5,), (14,)], "item_id bigint"), t["links"], t["items"], ALL)


@query(f"SELECT g.trigger_id, i.item_id, g.kind FROM triggers g JOIN items i ON g.item_id = i.item_id WHERE g.state = 'pending' AND {SCOPE}")
def j_trigger_item(t: Tables) -> DataFrame:
    fires = t["triggers"].where("state = 'pending'").select("trigger_id", "item_id", "kind")
    return fires.join(fl.scoped(t["items"], ALL).select("item_id"), "item_id").select("trigger_id", "item_id", "kind")


@query("SELECT DISTINCT r.item_id FROM items i JOIN item_entities a ON a.item_id = i.item_id AND a.role = 'at' JOIN item_entities b ON b.entity_id = a.entity_id "
       "JOIN items r ON r.item_id = b.item_id WHERE i.kind = 'intention' AND i.state = 'wanted' AND r.kind = 'resource' AND r.state = 'saved' AND "
       f"{SCOPE} AND r.status = 'active' AND r.sensitivity NOT IN ('secret', 'sensitive')")
def j_situational(t: Tables) -> DataFrame:
    wanted = fl.apply(t["items"], Filters(kinds=("intention",), states=("wanted",)), ALL).select("item_id")
    topics = t["item_entities"].where("role = 'at'").join(wanted, "item_id", "left_semi").select("entity_id").distinct()
    near = t["item_entities"].join(topics, "entity_id", "left_semi").select("item_id").distinct()
    unread = fl.apply(t["items"], Filters(kinds=("resource",), states=("saved",)), ALL)
    return unread.join(near, "item_id", "left_semi").select("item_id")


# ---------------------------------------------------------------- the tools

@query(f"SELECT item_id, rank, total FROM (SELECT i.item_id, row_number() OVER (ORDER BY {RANK}) AS rank, count(*) OVER () AS total FROM items i "
       f"WHERE {SCOPE} AND i.kind IN ('plan', 'intention')) WHERE rank <= 50")
def t_lookup(t: Tables) -> DataFrame:
    return tl.lookup(fl.apply(t["items"], Filters(kinds=("plan", "intention")), ALL)).select("item_id", F.col("rank").cast("bigint").alias("rank"), "total")


def _counted(value: str, agg: str, grp: str) -> str:
    return (f"WITH r AS (SELECT i.item_id, coalesce(i.occurred_start, i.due_at, i.mentioned_at) AS at, {value} AS v, {grp} AS grp FROM items i WHERE {SCOPE} AND i.kind = 'episode'), "
            f"k AS (SELECT * FROM r WHERE v IS NOT NULL) SELECT item_id, round({agg} OVER (), 4) AS total, grp, round({agg} OVER (PARTITION BY grp), 4) AS grp_value, "
            "count(*) OVER (PARTITION BY grp) AS grp_count FROM k")


_RAW = "json_extract_string(i.attributes, '$.distance')"
_DISTANCE = (f"CASE WHEN {_RAW} IS NOT NULL THEN CASE WHEN regexp_full_match({_RAW}, '-?[0-9]+(\\.[0-9]+)?') THEN {_RAW}::DOUBLE END "
             "WHEN lower(i.value_unit) IN ('km', 'm', 'mi', 'mile', 'miles') THEN i.value_number END")


def _agg(t: Tables, op: str, field: str | None, by: str) -> DataFrame:
    out = tl.aggregate(fl.apply(t["items"], Filters(kinds=("episode",)), ALL), op, field, by, "UTC")
    return out.select("item_id", F.round("total", 4).alias("total"), "grp", F.round("grp_value", 4).alias("grp_value"), "grp_count")


@query(_counted("1::DOUBLE", "sum(v)", "strftime(coalesce(i.occurred_start, i.due_at, i.mentioned_at), '%G-W%V')"))
def t_aggregate(t: Tables) -> DataFrame:
    return _agg(t, "count", None, "week")


@query(_counted(_DISTANCE, "sum(v)", "strftime(coalesce(i.occurred_start, i.due_at, i.mentioned_at), '%Y-%m')"))
def a_sum_month(t: Tables) -> DataFrame:
    return _agg(t, "sum", "distance", "month")


@query(_counted("i.value_number", "avg(v)", "coalesce(i.subtype, '(none)')"))
def a_avg_subtype(t: Tables) -> DataFrame:
    return _agg(t, "avg", "value", "subtype")


@query(_counted(_DISTANCE, "max(v)", "strftime(coalesce(i.occurred_start, i.due_at, i.mentioned_at), '%Y-%m-%d')"))
def a_max_day(t: Tables) -> DataFrame:
    return _agg(t, "max", "distance", "day")


@query("WITH g AS (SELECT strftime(coalesce(i.occurred_start, i.due_at, i.mentioned_at), '%Y-%m') AS grp, min(i.value_number) AS grp_value, count(*) AS grp_count, "
       "min(struct_pack(a := coalesce(i.occurred_start, i.due_at, i.mentioned_at), b := i.item_id)) AS first "
       f"FROM items i WHERE {SCOPE} AND i.kind = 'plan' GROUP BY 1) SELECT grp, grp_value, grp_count, row_number() OVER (ORDER BY first, grp) AS place FROM g WHERE grp IS NOT NULL")
def a_group_order(t: Tables) -> DataFrame:
    out = tl.aggregate_groups(fl.apply(t["items"], Filters(kinds=("plan",)), ALL), "min", "value", "month")
    return out.select("grp", "grp_value", "grp_count", F.col("place").cast("bigint").alias("place"))


@query("SELECT item_id, rank FROM (SELECT i.item_id, row_number() OVER (ORDER BY " + RANK + ") AS rank FROM items i WHERE " + SCOPE +
       " AND (i.subject_entity_id IN (SELECT src FROM relations WHERE relation = 'lives_in' AND dst = 20000003 AND NOT ended AND src IN (SELECT entity_id FROM entities WHERE status = 'active')) "
       "OR i.item_id IN (SELECT item_id FROM item_entities WHERE entity_id IN (SELECT src FROM relations WHERE relation = 'lives_in' AND dst = 20000003 AND NOT ended "
       "AND src IN (SELECT entity_id FROM entities WHERE status = 'active'))))) WHERE rank <= 50")
def t_entity(t: Tables) -> DataFrame:
    start = t.spark.createDataFrame([(20000003,)], "entity_id bigint")
    reached = tl.walk(start, t["relations"], t["entities"], [((), ("lives_in",))])
    return tl.entity_tool(reached, t["items"], t["item_entities"], ALL).select("item_id", F.col("rank").cast("bigint").alias("rank"))


_DAYS = ("SELECT i.item_id, 'routine' AS clock, d AS start, d + CASE i.precision WHEN 'datetime' THEN INTERVAL 1 HOUR ELSE INTERVAL 24 HOUR END AS \"end\" "
         f"FROM items i, (SELECT unnest(generate_series(TIMESTAMP '1998-02-20', TIMESTAMP '1998-04-01', INTERVAL 1 DAY)) AS d) WHERE {SCOPE} AND i.rrule IS NOT NULL AND i.state = 'scheduled' "
         "AND i.occurred_start IS NOT NULL AND d >= i.occurred_start AND d < TIMESTAMP '1998-04-01' AND d + CASE i.precision WHEN 'datetime' THEN INTERVAL 1 HOUR ELSE INTERVAL 24 HOUR END > TIMESTAMP '1998-03-01' "
         "AND CASE WHEN i.rrule LIKE 'FREQ=WEEKLY%' THEN isodow(d) IN (1, 4) ELSE date_diff('day', i.occurred_start, d) % 3 = 0 END")
_LINES = (f"SELECT i.item_id, 'occurred' AS clock, i.occurred_start AS start, i.occurred_end AS \"end\" FROM items i WHERE {SCOPE} AND i.rrule IS NULL AND i.occurred_start < TIMESTAMP '1998-04-01' "
          f"AND coalesce(i.occurred_end, i.occurred_start + INTERVAL 1 SECOND) > TIMESTAMP '1998-03-01' UNION ALL {_DAYS} "
          f"UNION ALL SELECT i.item_id, 'due', i.due_at, NULL FROM items i WHERE {SCOPE} AND i.due_at >= TIMESTAMP '1998-03-01' AND i.due_at < TIMESTAMP '1998-04-01' "
          f"UNION ALL SELECT i.item_id, 'trigger', g.fires_at, NULL FROM items i JOIN triggers g ON g.item_id = i.item_id WHERE {SCOPE} AND g.state = 'pending' "
          "AND g.fires_at >= TIMESTAMP '1998-03-01' AND g.fires_at < TIMESTAMP '1998-04-01'")


def _timeline(t: Tables, limit: int | None) -> DataFrame:
    return tl.timeline(t["items"], t["triggers"], Window("occurred", START, END), Filters(), ALL, NOW, limit=limit)


@query(f"SELECT item_id, clock, epoch(start)::BIGINT AS start, epoch(\"end\")::BIGINT AS \"end\", start >= TIMESTAMP '1998-03-10 09:30:00' AS upcoming FROM ({_LINES}) "
       "ORDER BY start, item_id, clock LIMIT 100")
def t_timeline(t: Tables) -> DataFrame:
    return _timeline(t, 100).select("item_id", "clock", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "upcoming")


@query(f"SELECT item_id, epoch(start)::BIGINT AS start FROM ({_DAYS})")
def d_rrule_expand(t: Tables) -> DataFrame:
    return _timeline(t, None).where("clock = 'routine'").select("item_id", F.unix_timestamp("start").alias("start"))


@query(f"WITH o AS (SELECT DISTINCT l.item_id, l.start FROM ({_LINES}) l JOIN items i ON i.item_id = l.item_id WHERE i.state IN ('scheduled', 'open', 'current', 'active', 'wanted', 'saved', 'confirmed')) "
       "SELECT strftime(start, '%Y-%m-%d') AS local_day, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids FROM o GROUP BY 1")
def t_upcoming(t: Tables) -> DataFrame:
    return tl.upcoming_days(_timeline(t, None), t["items"]).withColumn("local_day", F.col("local_day").cast("string"))


@query(f"WITH s AS (SELECT l.start, l.item_id, i.title FROM ({_LINES}) l JOIN items i ON i.item_id = l.item_id WHERE l.start >= TIMESTAMP '1998-03-10 09:30:00' AND l.start < TIMESTAMP '1998-03-11 09:30:00'), "
       "r AS (SELECT *, row_number() OVER (ORDER BY start, item_id, title) AS k, count(*) OVER () AS n FROM s) "
       "SELECT max(n) AS n, string_agg(title, ', ' ORDER BY k) FILTER (WHERE k <= 3) || CASE WHEN max(n) > 3 THEN ' and ' || (max(n) - 3)::VARCHAR || ' more' ELSE '' END AS note FROM r")
def t_due_soon(t: Tables) -> DataFrame:
    return tl.due_soon(_timeline(t, None), t["items"], NOW)


@query(f"{_CHAIN} SELECT 'history' AS what, i.item_id FROM items i WHERE {SCOPE} AND i.item_id IN (SELECT item_id FROM chain) "
       f"UNION SELECT 'because', i.item_id FROM items i JOIN links l ON l.link_type = 'because' AND (l.src = i.item_id OR l.dst = i.item_id) WHERE {SCOPE} AND i.item_id NOT IN (SELECT item_id FROM chain) "
       "AND CASE WHEN l.src = i.item_id THEN l.dst ELSE l.src END IN (SELECT item_id FROM chain)")
def t_history(t: Tables) -> DataFrame:
    return tl.history(_seeds(t), t["links"], t["items"], ALL).select("what", "item_id")


@query("SELECT item_id, kind, state FROM items LIMIT 0")
def t_empty(t: Tables) -> DataFrame:
    return ids(t["items"].limit(0))


# ---------------------------------------------------------------- windows and set operations

@query("SELECT item_id, key_id, key_kind FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(text) DESC, key_id) AS r FROM keys) WHERE r = 1")
def w_distinct_on(t: Tables) -> DataFrame:
    best = F.max_by(F.struct("key_id", "key_kind"), F.struct(F.length("text"), -F.col("key_id")))
    return t["keys"].groupBy("item_id").agg(best.alias("k")).select("item_id", "k.key_id", "k.key_kind")


@query(f"SELECT i.item_id, count(*) OVER () AS total, sum(i.value_number) OVER (PARTITION BY i.kind) AS kind_sum FROM items i WHERE {SCOPE} AND i.workspace_id = 3")
def w_count_over(t: Tables) -> DataFrame:
    rows = fl.scoped(t["items"], Access(3)).select("item_id", "kind", "value_number")
    sums = rows.groupBy("kind").agg(F.sum("value_number").alias("kind_sum"))
    return rows.join(F.broadcast(sums), "kind").crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select("item_id", "total", "kind_sum")


@query("SELECT item_id, arg_min(text, struct_pack(a := created_at, b := item_id)) AS first_text FROM items GROUP BY item_id")
def w_first_scalar(t: Tables) -> DataFrame:
    return t["items"].groupBy("item_id").agg(F.min_by("text", F.struct("created_at", "item_id")).alias("first_text"))


@query("SELECT dst AS item_id FROM links WHERE link_type = 'because' UNION SELECT src FROM links WHERE link_type = 'because'")
def u_union_distinct(t: Tables) -> DataFrame:
    edges = t["links"].where("link_type = 'because'")
    return edges.select(F.col("dst").alias("item_id")).union(edges.select("src")).distinct()


@query("SELECT item_id FROM access WHERE cited INTERSECT SELECT item_id FROM item_entities WHERE role = 'at'")
def u_intersect_ids(t: Tables) -> DataFrame:
    return t["access"].where("cited").select("item_id").intersect(t["item_entities"].where("role = 'at'").select("item_id"))


@query("SELECT subtype, item_id, r FROM (SELECT subtype, item_id, row_number() OVER (PARTITION BY subtype ORDER BY md5('7:' || item_id::VARCHAR)) AS r FROM items WHERE subtype IS NOT NULL) WHERE r <= 5")
def s_stratified(t: Tables) -> DataFrame:
    n = F.row_number().over(W.partitionBy("subtype").orderBy(F.md5(F.concat(F.lit("7:"), F.col("item_id").cast("string")))))
    return t["items"].where("subtype is not null").withColumn("r", n.cast("bigint")).where("r <= 5").select("subtype", "item_id", "r")
