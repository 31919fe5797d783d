"""Memory tables derived from the driver's star schema.

Each table is one SELECT that Spark and DuckDB both read, so a query and its oracle see the same rows. ``{name}`` is a
base table or another derived one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

MODEL: dict[str, str] = {}

MODEL["items"] = """
SELECT o_orderkey AS item_id, CAST(o_custkey % 4 AS INT) AS workspace_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'fact' WHEN 1 THEN 'episode' WHEN 2 THEN 'plan' WHEN 3 THEN 'task' WHEN 4 THEN 'intention'
    WHEN 5 THEN 'resource' ELSE 'preference' END AS kind,
  CASE WHEN o_orderkey % 7 IN (0, 6) THEN CASE WHEN (o_orderkey + o_custkey) % 4 = 3 THEN 'superseded' ELSE 'current' END
    WHEN o_orderkey % 7 = 1 THEN 'happened'
    WHEN o_orderkey % 7 = 2 THEN CASE (o_orderkey + o_custkey) % 4 WHEN 2 THEN 'moved' WHEN 3 THEN 'cancelled' ELSE 'scheduled' END
    WHEN o_orderkey % 7 = 3 THEN CASE (o_orderkey + o_custkey) % 4 WHEN 2 THEN 'done' WHEN 3 THEN 'dropped' ELSE 'open' END
    WHEN o_orderkey % 7 = 4 THEN CASE (o_orderkey + o_custkey) % 4 WHEN 0 THEN 'wanted' WHEN 1 THEN 'active' WHEN 2 THEN 'fulfilled' ELSE 'dropped' END
    ELSE CASE WHEN (o_orderkey + o_custkey) % 4 IN (0, 1) THEN 'saved' ELSE 'consumed' END END AS state,
  CASE WHEN o_orderkey % 13 = 0 THEN 'archived' WHEN o_orderkey % 37 = 0 THEN 'deleted' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN 'sensitive' WHEN o_orderkey % 23 = 0 THEN 'secret' ELSE 'normal' END AS sensitivity,
  CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE lower(substr(o_orderpriority, 3)) END AS subtype,
  'Item ' || CAST(o_orderkey % 500 AS STRING) AS title,
  'Item ' || CAST(o_orderkey AS STRING) || ' of customer ' || CAST(o_custkey AS STRING) || ' was ' || lower(substr(o_orderpriority, 3)) AS text,
  o_custkey AS subject_entity_id, 'p' || CAST(o_orderkey % 5 AS STRING) AS predicate,
  CAST(o_totalprice AS DOUBLE) AS value_number,
  CASE o_orderkey % 4 WHEN 0 THEN 'km' WHEN 1 THEN 'h' WHEN 2 THEN 'kg' ELSE NULL END AS value_unit,
  CASE WHEN o_orderkey % 3 = 0 THEN '{{"type": "Running"}}' WHEN o_orderkey % 6 = 1 THEN
      '{{"distance": "' || CAST(o_orderkey % 50 AS STRING) || '", "type": " run"}}'
    WHEN o_orderkey % 6 = 2 THEN '{{"distance": "about 5", "type": "walks"}}' ELSE '{{}}' END AS attributes,
  CASE WHEN o_orderkey % 7 IN (1, 2) THEN CAST(o_orderdate AS TIMESTAMP) END AS occurred_start,
  CASE WHEN o_orderkey % 7 IN (1, 2) AND o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '26' HOUR END AS occurred_end,
  CASE WHEN o_orderkey % 7 = 3 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '5' DAY END AS due_at,
  CAST(o_orderdate AS TIMESTAMP) AS valid_from,
  CASE WHEN o_orderkey % 7 IN (0, 6) AND (o_orderkey + o_custkey) % 4 = 3 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '30' DAY END AS valid_to,
  CAST(o_orderdate AS TIMESTAMP) - INTERVAL '1' DAY AS mentioned_at, CAST(o_orderdate AS TIMESTAMP) AS created_at,
  CASE WHEN o_orderkey % 7 = 2 AND o_orderkey % 5 = 0 THEN
    CASE WHEN o_orderkey % 2 = 0 THEN 'FREQ=WEEKLY;BYDAY=MO,TH' ELSE 'FREQ=DAILY;INTERVAL=3' END END AS rrule,
  CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'datetime' END AS precision,
  CASE o_orderkey % 5 WHEN 0 THEN 'work' WHEN 1 THEN 'work/projects' WHEN 2 THEN 'workshop' WHEN 3 THEN 'home/garden' ELSE 'health' END AS category,
  (o_orderkey % 10 = 0) AS in_core, (o_orderkey % 4 = 0) AS confirmed
FROM {orders}
"""

MODEL["routines"] = """
SELECT o_orderkey AS item_id,
  CASE o_orderkey % 16
    WHEN 0 THEN 'FREQ=MONTHLY;BYDAY=1MO'
    WHEN 1 THEN 'FREQ=MONTHLY;BYMONTHDAY=-1'
    WHEN 2 THEN 'FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU'
    WHEN 3 THEN 'FREQ=DAILY;BYHOUR=7,19;BYMINUTE=30'
    WHEN 4 THEN 'FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1'
    WHEN 5 THEN 'FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,MO'
    WHEN 6 THEN 'FREQ=MONTHLY;INTERVAL=3;BYMONTHDAY=15,-2'
    WHEN 7 THEN 'FREQ=YEARLY;BYYEARDAY=100,-270'
    WHEN 8 THEN 'FREQ=WEEKLY;COUNT=300;BYDAY=TU,TH'
    WHEN 9 THEN 'FREQ=YEARLY;BYWEEKNO=12;BYDAY=WE'
    WHEN 10 THEN 'FREQ=DAILY;INTERVAL=5;UNTIL=19980401T000000'
    WHEN 11 THEN 'FREQ=MONTHLY'
    WHEN 12 THEN 'FREQ=YEARLY;BYDAY=13MO'
    WHEN 13 THEN 'FREQ=HOURLY;INTERVAL=9;BYDAY=SA'
    WHEN 14 THEN 'FREQ=MONTHLY;BYDAY=2FR,-1FR;COUNT=70'
    WHEN 15 THEN 'FREQ=WEEKLY;WKST=SU;INTERVAL=3' END AS rrule,
  CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL '1' HOUR AS occurred_start, CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'datetime' END AS precision
FROM {orders}
"""

MODEL["entities"] = """
SELECT c_custkey AS entity_id, 'person' AS kind, c_name AS name, CASE WHEN c_custkey % 17 = 0 THEN 'archived' ELSE 'active' END AS status FROM {customer}
UNION ALL SELECT 10000000 + s_suppkey, 'organisation', s_name, 'active' FROM {supplier}
UNION ALL SELECT 20000000 + n_nationkey, 'place', n_name, 'active' FROM {nation}
UNION ALL SELECT 30000000 + r_regionkey, 'place', r_name, 'active' FROM {region}
"""

MODEL["relations"] = """
SELECT c_custkey AS src, 'lives_in' AS relation, 20000000 + CAST(c_nationkey AS BIGINT) AS dst, (c_custkey % 9 = 0) AS ended FROM {customer}
UNION ALL SELECT 10000000 + s_suppkey, 'located_in', 20000000 + CAST(s_nationkey AS BIGINT), FALSE FROM {supplier}
UNION ALL SELECT 20000000 + CAST(n_nationkey AS BIGINT), 'part_of', 30000000 + CAST(n_regionkey AS BIGINT), FALSE FROM {nation}
"""

MODEL["item_entities"] = """
SELECT o_orderkey AS item_id, o_custkey AS entity_id, 'about' AS role FROM {orders} WHERE o_orderkey % 2 = 0
UNION ALL SELECT l_orderkey, 10000000 + l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'with' ELSE 'at' END FROM {lineitem} WHERE l_linenumber <= 2
"""

MODEL["ends"] = """
SELECT i.item_id, i.entity_id, i.role, e.kind FROM {item_entities} i JOIN {entities} e ON e.entity_id = i.entity_id
UNION ALL SELECT o_orderkey, 20000000 + o_custkey % 25, 'at', 'place' FROM {orders} WHERE o_orderkey % 3 = 1
"""

MODEL["drafts"] = """
SELECT i.item_id AS draft_id, i.kind, i.subtype, i.subject_entity_id, i.predicate, i.value_number, i.attributes, i.occurred_start, i.precision, e.embedding
FROM {items} i LEFT JOIN {embeddings} e ON e.vec_id = i.item_id % 500
"""

MODEL["facts"] = """
SELECT o_orderkey AS fact_id, o_custkey % 100 AS subject_id, 'p' || CAST(o_orderkey % 5 AS STRING) AS predicate, CAST(o_orderdate AS TIMESTAMP) AS valid_from,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + (o_orderkey * 13 % 400 + 1) * INTERVAL '1' DAY END AS valid_to,
  CAST(o_orderdate AS TIMESTAMP) + (o_orderkey * 37 % 900) * INTERVAL '1' DAY AS learnt_at
FROM {orders}
"""

MODEL["links"] = """
SELECT item_id AS src, 'supersedes' AS link_type, prev AS dst FROM (
  SELECT o_orderkey AS item_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}) t
WHERE prev IS NOT NULL AND item_id % 3 = 0
UNION ALL SELECT o_orderkey, 'because', o_orderkey - 4 FROM {orders} WHERE o_orderkey % 9 = 0 AND o_orderkey >= 4
"""

MODEL["triggers"] = """
SELECT o_orderkey AS trigger_id, o_orderkey AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'time' WHEN 1 THEN 'person' ELSE 'topic' END AS kind,
  o_custkey AS entity_id, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '3' DAY AS fires_at,
  CASE WHEN o_orderkey % 4 = 0 THEN 'fired' ELSE 'pending' END AS state
FROM {orders} WHERE o_orderkey % 8 IN (0, 1, 2)
"""

MODEL["ledger"] = """
SELECT l_orderkey AS turn_id, l_linenumber AS seq, CAST(l_suppkey % 20 AS INT) AS workspace_id,
  CASE l_returnflag WHEN 'A' THEN 'plan' WHEN 'N' THEN 'answer' ELSE 'rerank' END AS step,
  CASE l_linestatus WHEN 'O' THEN 'alpha' ELSE 'beta' END AS provider, 'm' || CAST(l_partkey % 3 AS STRING) AS model,
  CAST(l_quantity AS BIGINT) * 100 AS input_tokens, CAST(l_quantity AS BIGINT) * 10 AS cached_tokens, CAST(l_linenumber AS BIGINT) * 25 AS output_tokens,
  CAST(l_extendedprice AS DOUBLE) / 10.0 AS latency_ms, (l_partkey % 4 = 0) AS cache_hit,
  CAST(l_shipdate AS TIMESTAMP) AS at, (l_linenumber % 5 = 0) AS system
FROM {lineitem}
"""

MODEL["workspaces"] = """
SELECT DISTINCT CAST(s_suppkey % 20 AS INT) AS workspace_id, CAST(s_suppkey % 10 AS INT) AS owner_id,
  CASE CAST(s_suppkey % 10 AS INT) WHEN 0 THEN 'guest' WHEN 1 THEN 'guest' WHEN 2 THEN 'owner' ELSE 'member' END AS tier FROM {supplier}
"""

MODEL["access"] = """
SELECT event_id AS access_id, CAST(user_id AS BIGINT) AS item_id, CAST(floor(event_id / 3.0) AS BIGINT) AS turn_id, CAST(ts AS TIMESTAMP) AS at,
  (event_type IN ('click', 'purchase')) AS cited FROM {events}
"""

MODEL["turn_events"] = """
SELECT event_id, CAST(user_id AS BIGINT) AS turn_id, CAST(ts AS TIMESTAMP) AS at, event_type AS kind, CAST(value AS DOUBLE) AS value, props FROM {events}
"""

MODEL["keys"] = """
SELECT d.doc_id AS key_id, CAST(floor(d.doc_id / 2.0) AS BIGINT) AS item_id, CASE WHEN d.doc_id % 3 = 0 THEN 'chunk' ELSE 'text' END AS key_kind,
  d.text AS text, e.embedding AS embedding
FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id
"""

MODEL["said"] = """
SELECT c.conv_id AS turn_id, c.turn AS seq, c.role AS role, c.text AS text, e.embedding AS embedding
FROM {conversations} c LEFT JOIN {embeddings} e ON e.vec_id = c.conv_id * 4 + c.turn
"""


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table read from Parquet, or a derived one."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = MODEL[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in _names(sql)})


def oracle(sql: str) -> str:
    """The SQL of a query with the derived tables that it names as common table expressions, for DuckDB."""
    used: dict[str, str] = {}

    def need(text: str) -> None:
        for n in MODEL:
            if n not in used and re.search(rf"\b{n}\b", text):
                body = MODEL[n]
                need(" ".join(x for x in _names(body) if x in MODEL))
                for base in _names(body):
                    body = body.replace("{" + base + "}", base)
                used[n] = body.replace("{{", "{").replace("}}", "}")
    need(sql)
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE", sql) else ""
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql)
    head = ", ".join(f"{n} AS ({body})" for n, body in used.items())
    if not head:
        return sql
    return f"WITH {recursive}{head}" + (", " + rest if rest != sql else " " + sql)
