"""Queries over the write operations, each over a whole table of operations."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import tables as ft
from palimpsest.operators import lifecycle as lc
from palimpsest.operators import validity as va
from palimpsest.queries.reads import stored
from palimpsest.queries.registry import Tables, query
from palimpsest.sources import storage as st
from palimpsest.sources.storage import shared_dir
from palimpsest.streaming import jobs

#: Unique numbers of operations: two lines of an order can bear one number.
_SEQ = "(l_orderkey % 8 * 8 + l_linenumber) * 100000000000000 + l_partkey * 100000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq"
_OP = f"l_orderkey // 8 AS turn_id, {_SEQ}"
_SPARK_OP = ("l_orderkey DIV 8 AS turn_id", _SEQ)


def _ops(t: Tables, *columns: str, where: str = "true") -> DataFrame:
    return t["lineitem"].where(where).selectExpr(*_SPARK_OP, *columns)


_KINDS = {k: s for k, s in (("fact", "('current', 'superseded')"), ("preference", "('current', 'superseded')"), ("episode", "('happened')"), ("plan", "('scheduled', 'happened', 'moved', 'cancelled')"),
                            ("task", "('open', 'done', 'dropped')"), ("intention", "('wanted', 'active', 'fulfilled', 'dropped')"), ("resource", "('saved', 'consumed')"), ("note", "('current')"))}


def _legal(kind: str, state: str) -> str:
    return "coalesce(" + " OR ".join(f"({kind} = '{k}' AND {state} IN {s})" for k, s in _KINDS.items()) + ", FALSE)"


# ---------------------------------------------------------------- items

_NEW_ID = "CASE WHEN l_partkey % 9 = 0 THEN l_orderkey ELSE 100000000 + l_partkey * 3 + l_suppkey END AS item_id"
_NEW_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'task' ELSE 'note' END AS kind"
_NEW_STATE = "CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 1 THEN 'open' ELSE 'current' END AS state"
_END = "CASE WHEN l_quantity > 48 THEN 99999999 ELSE 10000000 + l_suppkey END"
_CREATE = (f"WITH o AS (SELECT {_OP}, {_NEW_ID}, {_NEW_KIND}, {_NEW_STATE}, {_END} AS entity_id FROM lineitem), "
           f"b AS (SELECT o.*, NOT {_legal('kind', 'state')} OR entity_id NOT IN (SELECT entity_id FROM entities) AS bad FROM o), "
           "c AS (SELECT *, CASE WHEN bad THEN 'rejected' WHEN item_id IN (SELECT item_id FROM items) OR row_number() OVER (PARTITION BY item_id, bad ORDER BY turn_id, seq) > 1 THEN 'skipped' ELSE 'applied' END AS outcome FROM b)")


def _created(t: Tables) -> DataFrame:
    ends = f"array(named_struct('entity_id', CAST({_END} AS BIGINT), 'role', 'with')) AS ends"
    return lc.create(_ops(t, _NEW_ID, _NEW_KIND, _NEW_STATE, ends), t["items"], t["entities"])


@query(f"{_CREATE} SELECT turn_id, seq, item_id, outcome FROM c")
def c_create(t: Tables) -> DataFrame:
    return _created(t).select("turn_id", "seq", "item_id", "outcome")


@query(f"{_CREATE} SELECT turn_id, seq, 'item' AS target_type, item_id AS target_id, item_id FROM c WHERE outcome = 'applied' UNION ALL SELECT turn_id, seq, 'item_entity', entity_id, item_id FROM c WHERE outcome = 'applied'")
def c_create_log(t: Tables) -> DataFrame:
    return lc.created_rows(_created(t))


def _changes(name: str, ops: str, stored: str, legal: str) -> str:
    """SQL of one row a changed field: ops(turn_id, seq, item_id, field, after), one field an operation."""
    return (f"WITH o AS ({ops}), s AS ({stored}), j AS (SELECT o.*, s.was, s.item_id IS NOT NULL AS there, {legal} AS fine FROM o LEFT JOIN s ON s.item_id = o.item_id AND s.field = o.field), "
            "a AS (SELECT turn_id, seq, item_id, field, after, was, lag(struct_pack(v := after)) OVER (PARTITION BY item_id, field ORDER BY turn_id, seq) AS last FROM j WHERE there AND fine) "
            f"SELECT turn_id, seq, item_id AS {name}, field, CASE WHEN last IS NOT NULL THEN last.v ELSE was END AS before, after, 'applied' AS outcome FROM a "
            "UNION ALL SELECT turn_id, seq, item_id, NULL, NULL, NULL, CASE WHEN there THEN 'rejected' ELSE 'skipped' END FROM j WHERE NOT (there AND fine)")


_EDITED = "CASE WHEN l_partkey % 50 = 0 THEN 200000000 + l_partkey ELSE l_orderkey + l_linenumber % 3 END"
_FIELD = "CASE l_linenumber % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'category' WHEN 2 THEN 'subtype' ELSE 'colour' END"
_VALUE = "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag || CAST(l_linenumber AS STRING) END"
_STORED = "SELECT item_id, 'title' AS field, title AS was FROM items UNION ALL SELECT item_id, 'category', category FROM items UNION ALL SELECT item_id, 'subtype', subtype FROM items UNION ALL SELECT item_id, 'colour', NULL FROM items"


@query(_changes("item_id", f"SELECT {_OP}, {_EDITED} AS item_id, {_FIELD} AS field, {_VALUE} AS after FROM lineitem", _STORED, "o.field <> 'colour'"))
def c_update(t: Tables) -> DataFrame:
    return lc.change(_ops(t, f"{_EDITED} AS item_id", f"map({_FIELD}, {_VALUE}) AS changes"), t["items"])


_STATE_OP = "CASE l_linenumber % 3 WHEN 0 THEN 'set_state' WHEN 1 THEN 'delete' ELSE 'restore' END"
_TO = "CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'superseded' ELSE 'cancelled' END"


@query(_changes("item_id", f"SELECT {_OP}, {_EDITED} AS item_id, CASE l_linenumber % 3 WHEN 0 THEN 'state' ELSE 'status' END AS field, CASE l_linenumber % 3 WHEN 0 THEN {_TO} WHEN 1 THEN 'deleted' ELSE 'active' END AS after FROM lineitem",
                "SELECT item_id, kind, 'state' AS field, state AS was FROM items UNION ALL SELECT item_id, kind, 'status', status FROM items", f"o.field = 'status' OR {_legal('s.kind', 'o.after')}"))
def c_set_state(t: Tables) -> DataFrame:
    return lc.change(lc.as_changes(_ops(t, f"{_STATE_OP} AS op", f"{_EDITED} AS item_id", f"{_TO} AS state")), t["items"])


@query(_changes("trigger_id", f"SELECT {_OP}, l_orderkey AS item_id, 'state' AS field, CASE l_returnflag WHEN 'A' THEN 'fired' ELSE 'cancelled' END AS after FROM lineitem", "SELECT trigger_id AS item_id, 'state' AS field, state AS was FROM triggers", "TRUE"))
def c_trigger_update(t: Tables) -> DataFrame:
    ops = _ops(t, "l_orderkey AS trigger_id", "map('state', CASE l_returnflag WHEN 'A' THEN 'fired' ELSE 'cancelled' END) AS changes")
    return lc.change(ops, t["triggers"], "trigger_id", lc.TRIGGER_FIELDS)


_CLOSE_OP = "CASE l_linenumber % 3 WHEN 0 THEN 'supersede' WHEN 1 THEN 'correct' ELSE 'fulfil' END AS op"
_CLOSE_TO = "CASE l_linenumber % 3 WHEN 0 THEN 'superseded' WHEN 2 THEN 'fulfilled' END AS state"


@query(f"WITH o AS (SELECT {_OP}, {_CLOSE_OP}, l_orderkey + l_linenumber AS old_id, l_orderkey AS new_id, {_CLOSE_TO} FROM lineitem), "
       "j AS (SELECT o.*, a.state AS was, a.status AS old_status, coalesce(a.status <> 'deleted' AND b.status <> 'deleted' AND CASE op WHEN 'supersede' THEN a.valid_to IS NULL AND a.state IN ('current', 'scheduled') "
       "WHEN 'correct' THEN a.status = 'active' ELSE a.state NOT IN ('fulfilled', 'dropped') END, FALSE) AS fit FROM o LEFT JOIN items a ON a.item_id = o.old_id LEFT JOIN items b ON b.item_id = o.new_id) "
       "SELECT turn_id, seq, op, old_id, new_id, CASE op WHEN 'correct' THEN 'status' ELSE 'state' END AS field, CASE op WHEN 'correct' THEN old_status ELSE was END AS before, CASE op WHEN 'correct' THEN 'archived' ELSE state END AS after, "
       "CASE op WHEN 'supersede' THEN 'supersedes' WHEN 'correct' THEN 'corrects' ELSE 'fulfils' END AS link_type, CASE WHEN fit AND row_number() OVER (PARTITION BY old_id, op, fit ORDER BY turn_id, seq) = 1 THEN 'applied' ELSE 'skipped' END AS outcome FROM j")
def c_supersede(t: Tables) -> DataFrame:
    return lc.close(_ops(t, _CLOSE_OP, "l_orderkey + l_linenumber AS old_id", "l_orderkey AS new_id", _CLOSE_TO), t["items"])


# ---------------------------------------------------------------- edges, entities

def _edges(ops: str, stored: str, src: str, dst: str) -> str:
    return (f"WITH o AS ({ops}), k AS ({stored}), f AS (SELECT *, op = 'remove' OR (src IN ({src}) AND dst IN ({dst})) AS fine FROM o), "
            "p AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY edge_id, fine ORDER BY turn_id, seq) = 'add', edge_id IN (SELECT edge_id FROM k)) AS present FROM f), "
            "d AS (SELECT turn_id, seq, op, edge_id, src, \"type\", dst, CASE WHEN NOT fine OR present = (op = 'add') THEN 'skipped' ELSE 'applied' END AS outcome FROM p)")


_ADD = "CASE WHEN l_returnflag = 'A' THEN 'remove' ELSE 'add' END AS op"
_LINK_OPS = f"{_ADD}, (l_orderkey + l_linenumber) * 10 + l_suppkey % 3 AS edge_id, l_orderkey + l_linenumber AS src, 'related' AS `type`, l_orderkey + l_suppkey % 40 AS dst"
_LINKED = "SELECT src * 10 AS edge_id, src, link_type AS `type`, dst FROM links WHERE link_type = 'because'"
_LIVE = "SELECT item_id FROM items WHERE status <> 'deleted'"
_LINK_SQL = _edges(f"SELECT {_OP}, {_LINK_OPS} FROM lineitem".replace("`type`", '"type"'), _LINKED.replace("`type`", '"type"'), _LIVE, _LIVE)


def _linked(t: Tables) -> tuple[DataFrame, DataFrame]:
    stored = t["links"].where("link_type = 'because'").selectExpr("src * 10 AS edge_id", "src", "link_type AS type", "dst")
    live = t["items"].where("status <> 'deleted'").select(F.col("item_id").alias("id"))
    return stored, lc.edges(t["lineitem"].selectExpr(*_SPARK_OP, *_LINK_OPS.split(", ")), stored, live, live)


@query(f"{_LINK_SQL} SELECT * FROM d")
def c_link(t: Tables) -> DataFrame:
    return _linked(t)[1]


@query(f"{_LINK_SQL}, z AS (SELECT edge_id, arg_max(struct_pack(op := op, src := src, t := \"type\", dst := dst), struct_pack(a := turn_id, b := seq)) AS x FROM d WHERE outcome = 'applied' GROUP BY 1) "
       "SELECT edge_id, src, \"type\", dst FROM k WHERE edge_id NOT IN (SELECT edge_id FROM z) UNION ALL SELECT edge_id, x.src, x.t, x.dst FROM z WHERE x.op = 'add'")
def c_link_after(t: Tables) -> DataFrame:
    return lc.edges_after(*_linked(t))


_ATTACH_OPS = f"{_ADD}, l_orderkey * 100 + l_suppkey % 4 AS edge_id, l_orderkey + l_partkey % 5 AS src, 'about' AS `type`, 10000000 + l_suppkey % 130 AS dst"


@query(_edges(f"SELECT {_OP}, {_ATTACH_OPS} FROM lineitem".replace("`type`", '"type"'), "SELECT item_id * 100 AS edge_id FROM item_entities WHERE role = 'about'", "SELECT item_id FROM items", "SELECT entity_id FROM entities") + " SELECT * FROM d")
def c_attach(t: Tables) -> DataFrame:
    stored = t["item_entities"].where("role = 'about'").selectExpr("item_id * 100 AS edge_id")
    ops = t["lineitem"].selectExpr(*_SPARK_OP, *_ATTACH_OPS.split(", "))
    return lc.edges(ops, stored, t["items"].selectExpr("item_id AS id"), t["entities"].selectExpr("entity_id AS id"))


_RELATE_OPS = f"{_ADD}, l_partkey AS edge_id, 10000000 + l_suppkey AS src, 'supplies' AS `type`, l_partkey % 2000 AS dst"


@query(_edges(f"SELECT {_OP}, {_RELATE_OPS} FROM lineitem".replace("`type`", '"type"'), "SELECT src AS edge_id FROM relations WHERE relation = 'lives_in'", "SELECT entity_id FROM entities", "SELECT entity_id FROM entities") + " SELECT * FROM d")
def c_relate(t: Tables) -> DataFrame:
    stored = t["relations"].where("relation = 'lives_in'").selectExpr("src AS edge_id")
    ends = t["entities"].selectExpr("entity_id AS id")
    return lc.edges(t["lineitem"].selectExpr(*_SPARK_OP, *_RELATE_OPS.split(", ")), stored, ends, ends)


_WHO = "CASE WHEN l_partkey % 7 = 0 THEN 0 WHEN l_partkey % 3 = 0 THEN 300000000 + l_suppkey ELSE l_partkey END AS entity_id"
_WHAT = "CASE l_returnflag WHEN 'A' THEN 'create' WHEN 'N' THEN 'update' ELSE 'delete' END AS op"


@query(f"WITH o AS (SELECT {_OP}, {_WHAT}, {_WHO}, 'name ' || CAST(l_orderkey AS STRING) AS name FROM lineitem), e AS (SELECT entity_id, kind, name FROM entities WHERE entity_id <> 0 UNION ALL SELECT 0, 'self', 'me'), "
       "j AS (SELECT o.*, e.kind AS was_kind, e.name AS was, e.kind IS NOT NULL OR coalesce(bool_or(op = 'create') OVER b, FALSE) AS present FROM o LEFT JOIN e ON e.entity_id = o.entity_id WINDOW b AS (PARTITION BY o.entity_id ORDER BY turn_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
       "s AS (SELECT *, present = (op = 'create') OR (op = 'delete' AND coalesce(was_kind = 'self', FALSE)) AS skip FROM j), n AS (SELECT *, CASE WHEN NOT skip AND op <> 'delete' THEN name END AS named FROM s) "
       "SELECT turn_id, seq, op, entity_id, CASE WHEN op <> 'create' THEN coalesce(last_value(named IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY turn_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), was) END AS before, "
       "CASE WHEN op <> 'delete' THEN name END AS after, CASE WHEN skip THEN 'skipped' ELSE 'applied' END AS outcome FROM n")
def c_entity_upsert(t: Tables) -> DataFrame:
    me = t.spark.createDataFrame([(0, "self", "me")], "entity_id bigint, kind string, name string")
    known = t["entities"].where("entity_id <> 0").select("entity_id", "kind", "name").unionByName(me)
    return lc.entity_ops(_ops(t, _WHAT, _WHO, "'name ' || CAST(l_orderkey AS STRING) AS name"), known)


# ---------------------------------------------------------------- what follows from the log

_TARGET = "CASE l_linenumber % 6 WHEN 0 THEN 'item' WHEN 1 THEN 'entity' WHEN 2 THEN 'link' WHEN 3 THEN 'item_entity' WHEN 4 THEN 'relation' ELSE 'trigger' END"


@query(f"WITH l AS (SELECT {_TARGET} AS kind, l_partkey AS id, l_orderkey AS src, l_suppkey AS dst, l_orderkey + 1 AS item FROM lineitem) "
       "SELECT id AS item_id FROM l WHERE kind = 'item' UNION SELECT src FROM l WHERE kind = 'link' UNION SELECT dst FROM l WHERE kind = 'link' UNION SELECT item FROM l WHERE kind = 'item_entity'")
def c_track(t: Tables) -> DataFrame:
    return lc.track(_ops(t, f"{_TARGET} AS target_type", "l_partkey AS target_id", "l_orderkey AS src", "l_suppkey AS dst", "l_orderkey + 1 AS item_id"))


_BEFORE = "CASE WHEN l_returnflag <> 'A' THEN map('state', l_linestatus, 'status', CASE l_partkey % 3 WHEN 0 THEN 'deleted' ELSE 'active' END, 'title', CAST(l_partkey AS STRING), 'secret', 'a') END AS before"
_AFTER = "CASE WHEN l_returnflag <> 'R' THEN map('state', 'O', 'status', CASE l_suppkey % 3 WHEN 0 THEN 'deleted' ELSE 'active' END, 'title', CAST(l_suppkey AS STRING), 'secret', 'b', 'kind', CASE l_suppkey % 2 WHEN 0 THEN 'self' ELSE 'person' END) END AS after"


def _log(t: Tables) -> DataFrame:
    return _ops(t, f"{_TARGET} AS target_type", "l_partkey AS target_id", _BEFORE, _AFTER)


_HAS = (f"WITH l AS (SELECT {_OP}, {_TARGET} AS target_type, l_partkey AS target_id, l_returnflag <> 'A' AS b, l_returnflag <> 'R' AS a, l_linestatus AS state, CASE l_partkey % 3 WHEN 0 THEN 'deleted' ELSE 'active' END AS status, CAST(l_partkey AS STRING) AS title, "
        "CASE l_suppkey % 3 WHEN 0 THEN 'deleted' ELSE 'active' END AS status2, CAST(l_suppkey AS STRING) AS title2, CASE l_suppkey % 2 WHEN 0 THEN 'self' ELSE 'person' END AS kind2 FROM lineitem)")


@query(f"{_HAS}, f AS (SELECT turn_id, seq, target_id, 'state' AS field, CASE WHEN b THEN state END AS before, CASE WHEN a THEN 'O' END AS after FROM l UNION ALL SELECT turn_id, seq, target_id, 'title', CASE WHEN b THEN title END, CASE WHEN a THEN title2 END FROM l "
       "UNION ALL SELECT turn_id, seq, target_id, 'kind', NULL, CASE WHEN a THEN kind2 END FROM l) SELECT * FROM f WHERE before IS DISTINCT FROM after")
def c_diff(t: Tables) -> DataFrame:
    return lc.shown_diff(_log(t))


@query(f"{_HAS}, m AS (SELECT l.*, EXISTS (SELECT 1 FROM l x WHERE x.turn_id > 5 AND x.target_type = l.target_type AND x.target_id = l.target_id) AS conflict FROM l WHERE turn_id = 5), "
       "o AS (SELECT *, CASE target_type WHEN 'item' THEN CASE WHEN NOT b THEN 'delete' WHEN a AND status = 'active' AND status2 = 'deleted' THEN 'restore' WHEN a AND status = 'deleted' AND status2 = 'active' THEN 'delete' ELSE 'update' END "
       "WHEN 'entity' THEN CASE WHEN NOT b AND kind2 = 'self' THEN NULL WHEN NOT b THEN 'delete' ELSE 'update' END WHEN 'link' THEN CASE WHEN b THEN 'link' ELSE 'unlink' END WHEN 'item_entity' THEN CASE WHEN b THEN 'attach' ELSE 'detach' END "
       "WHEN 'relation' THEN CASE WHEN b THEN 'relate' ELSE 'unrelate' END ELSE CASE WHEN b THEN 'update' ELSE 'cancel' END END AS op FROM m) "
       "SELECT row_number() OVER (ORDER BY seq DESC, target_type, target_id) AS place, op, target_type, target_id, conflict FROM o WHERE op IS NOT NULL")
def c_undo_ops(t: Tables) -> DataFrame:
    return lc.inverse(_log(t), 5).drop("changes").withColumn("place", F.col("place").cast("bigint"))


@query("SELECT l_orderkey AS turn_id, l_linenumber AS seq, CASE WHEN o.o_orderkey IS NULL OR o_custkey % 4 = 0 THEN 'held' WHEN o_custkey % 2 = 1 THEN 'confirmed' ELSE 'rejected' END AS status FROM lineitem LEFT JOIN orders o ON o_orderkey = l_orderkey")
def c_confirm(t: Tables) -> DataFrame:
    held = t["lineitem"].selectExpr("l_orderkey AS turn_id", "l_linenumber AS seq")
    said = t["orders"].where("o_custkey % 4 <> 0").selectExpr("o_orderkey AS turn_id", "1 AS at", "o_custkey % 2 = 1 AS confirm")
    return lc.decide(held, said.unionByName(said.withColumn("at", F.lit(2)).withColumn("confirm", ~F.col("confirm"))))


@query("WITH f AS (SELECT o_orderkey AS item_id, 400000000 + o_orderkey AS new_id, trim('right  ' || o_orderstatus) AS text FROM orders WHERE o_orderkey % 3 <> 0), e AS (SELECT item_id, string_agg(entity_id::VARCHAR || ':' || role, ',' ORDER BY entity_id, role) AS ends FROM item_entities GROUP BY 1) "
       "SELECT 'create' AS op, f.new_id AS item_id, f.item_id AS other_id, kind, state, regexp_replace(f.text, ' +', ' ', 'g') AS text, coalesce(e.ends, '') AS ends FROM f JOIN items i ON i.item_id = f.item_id LEFT JOIN e ON e.item_id = f.item_id "
       "UNION ALL SELECT 'correct', f.item_id, f.new_id, kind, state, NULL, '' FROM f JOIN items i ON i.item_id = f.item_id")
def c_correction_fix(t: Tables) -> DataFrame:
    fixes = t["orders"].selectExpr("o_orderkey AS item_id", "400000000 + o_orderkey AS new_id", "CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE concat('right  ', o_orderstatus, ' ') END AS text")
    out = lc.wrong_value(fixes, t["items"], t["item_entities"])
    return out.withColumn("ends", F.array_join(F.transform("ends", lambda x: F.concat(x["entity_id"].cast("string"), F.lit(":"), x["role"])), ","))


@query("SELECT 'add' AS op, c_custkey AS src, 'works_at' AS relation, 20000000 + c_nationkey::BIGINT AS dst FROM customer UNION ALL SELECT 'remove', src, relation, dst FROM relations WHERE relation = 'lives_in' AND NOT ended AND (src % 2 = 0 OR src % 4 = 1)")
def c_relation_fix(t: Tables) -> DataFrame:
    fixes = t["customer"].selectExpr("c_custkey AS a", "20000000 + CAST(c_nationkey AS BIGINT) AS b", "CASE c_custkey % 4 WHEN 1 THEN 'lives_in' WHEN 3 THEN 'friend_of' END AS wrong", "'works_at' AS right")
    return lc.relation_fix(fixes, t["relations"])


@query("SELECT item_id, entity_id, role FROM item_entities UNION ALL SELECT l_orderkey, l_partkey, 'made' FROM lineitem")
def sink_insert(t: Tables) -> DataFrame:
    table = stored(t, t["item_entities"], ["item_id"])
    new = t["lineitem"].selectExpr("l_orderkey AS item_id", "l_partkey AS entity_id", "'made' AS role")
    table.insert(new, 1)
    table.insert(new, 1)  # a batch that comes again is there once
    return table.read()


# ---------------------------------------------------------------- facts with two times

def _timeline_sql(known: str = "TRUE") -> str:
    """Intervals between all starts and ends of a key, the last learnt fact of each, neighbours of one fact joined."""
    return (f"f AS (SELECT * FROM facts WHERE {known}), t AS (SELECT subject_id, predicate, valid_from AS t FROM f UNION SELECT subject_id, predicate, valid_to FROM f WHERE valid_to IS NOT NULL), "
            "s AS (SELECT *, lead(t) OVER (PARTITION BY subject_id, predicate ORDER BY t) AS z FROM t), "
            "w AS (SELECT s.subject_id, s.predicate, s.t, s.z, arg_max(f.fact_id, struct_pack(a := f.learnt_at, b := f.fact_id)) AS fact_id, max(f.learnt_at) AS learnt_at FROM s JOIN f ON f.subject_id = s.subject_id AND f.predicate = s.predicate "
            "AND f.valid_from <= s.t AND (f.valid_to IS NULL OR f.valid_to > s.t) GROUP BY 1, 2, 3, 4), "
            "b AS (SELECT *, CASE WHEN lag(fact_id) OVER k = fact_id AND lag(z) OVER k = t THEN 0 ELSE 1 END AS new FROM w WINDOW k AS (PARTITION BY subject_id, predicate ORDER BY t)), "
            "g AS (SELECT *, sum(new) OVER (PARTITION BY subject_id, predicate ORDER BY t) AS n FROM b), "
            "line AS (SELECT subject_id, predicate, fact_id, min(t) AS valid_from, arg_max(z, t) FILTER (WHERE z IS NOT NULL) AS z, bool_or(z IS NULL) AS open, max(learnt_at) AS learnt_at FROM g GROUP BY subject_id, predicate, n, fact_id) ")


_LINES = "SELECT subject_id, predicate, fact_id, epoch(valid_from)::BIGINT AS valid_from, CASE WHEN NOT open THEN epoch(z)::BIGINT END AS valid_to, epoch(learnt_at)::BIGINT AS learnt_at FROM line"


def _seconds(lines: DataFrame) -> DataFrame:
    return lines.select("subject_id", "predicate", "fact_id", *[F.unix_seconds(c).alias(c) for c in ("valid_from", "valid_to", "learnt_at")])


@query(f"WITH {_timeline_sql()} {_LINES}")
def v_timeline(t: Tables) -> DataFrame:
    """What holds when, of all facts."""
    return _seconds(va.timeline(t["facts"]))


@query("WITH " + _timeline_sql("learnt_at <= TIMESTAMP '1997-01-01'") + _LINES)
def v_timeline_known(t: Tables) -> DataFrame:
    """What held when, as it was known at the start of a year."""
    return _seconds(va.timeline(t["facts"], datetime(1997, 1, 1)))


@query("SELECT subject_id, predicate, arg_max(fact_id, struct_pack(a := learnt_at, b := fact_id)) AS fact_id FROM facts WHERE learnt_at <= TIMESTAMP '1998-06-01' AND valid_from <= TIMESTAMP '1996-03-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-03-01') GROUP BY 1, 2")
def v_as_of(t: Tables) -> DataFrame:
    """What held at one time, as it was known at another."""
    return va.as_of(t["facts"], datetime(1996, 3, 1), datetime(1998, 6, 1))


@query(f"WITH {_timeline_sql()} {_LINES}")
def st_late_data(t: Tables) -> DataFrame:
    """The same timeline from a stream that brings half of the facts, with those learnt last among them, before the others."""
    base = f"{shared_dir(t.spark)}/palimpsest/late-{uuid.uuid4().hex}"
    for half in (1, 0):
        t["facts"].where(F.col("fact_id") % 2 == half).write.parquet(f"{base}/in/half{half}")
        lines = va.late_facts(jobs.read_table(t.spark, f"{base}/in"), f"{base}/job")
    return _seconds(lines)


@query("WITH " + _timeline_sql() + "SELECT subject_id, predicate, fact_id, epoch(valid_from)::BIGINT AS start, CASE WHEN NOT open THEN epoch(z)::BIGINT END AS stop FROM line")
def f_fact_lines(t: Tables) -> DataFrame:
    """The timeline by a table function over a partitioned table, in SQL."""
    ft.register(t.spark)
    facts = t["facts"].select("subject_id", "predicate", "fact_id", *[F.unix_seconds(c).alias(a) for c, a in (("valid_from", "start"), ("valid_to", "stop"), ("learnt_at", "learnt"))])
    return t.spark.sql("SELECT * FROM fact_lines(TABLE(SELECT * FROM {f}) PARTITION BY (subject_id, predicate) ORDER BY (start, learnt, fact_id))", f=facts)


@query()
def f_chunks(t: Tables) -> DataFrame:
    """Chunks of all documents by a lateral table function."""
    ft.register(t.spark)
    return t.spark.sql("SELECT d.doc_id, c.position, c.chunk FROM {d} d, LATERAL chunks(d.text, 300) c", d=t["documents"])


@query()
def f_snippets(t: Tables) -> DataFrame:
    """Snippets of all that was said by a lateral table function."""
    ft.register(t.spark)
    return t.spark.sql("SELECT s.turn_id, s.seq, c.position, c.snippet FROM {s} s, LATERAL snippets(s.text, 1200) c", s=t["said"])
