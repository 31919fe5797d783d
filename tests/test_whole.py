import pandas as pd
from pyspark.sql import functions as F

from palimpsest.operators import filters as fl
from palimpsest.queries.all_queries import QUERIES
from palimpsest.sources.derived import load

SF = "/root/testdata/sf0.001"


def test_a_question_word_after_2000_characters_is_found(spark, tmp_path):
    texts = ["zebra " * 400 + "thing", "zebra " * 400 + "nothing", "things zebra, thing"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0], 0)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.key_id: r.score for r in QUERIES["r_lexical"](spark, str(tmp_path)).collect()}
    assert got == {0: round(1 / 11, 6), 2: round(2 / 12, 6)}  # places over places and ten
    # equal prefixes are not equal texts, and the longest text of an item is told beyond the prefix
    assert QUERIES["r_embed_cache"](spark, str(tmp_path)).count() == 0
    assert {r.item_id: r.key_id for r in QUERIES["w_distinct_on"](spark, str(tmp_path)).collect()} == {0: 1, 1: 2}


def test_every_line_is_an_operation(spark):
    got = QUERIES["c_edited_bulk"](spark, SF).toPandas()
    lines = pd.read_parquet(f"{SF}/lineitem.parquet")
    assert len(got) == len(lines) and set(got.turn_id) == set(lines.l_orderkey // 2)
    assert set(got.outcome) == {"applied", "held", "rejected"}
    # a share of the orders in every tenth of them has an operation that stands
    log = QUERIES["c_commit"](spark, SF).toPandas()
    assert len(set(log.item_id * 10 // (lines.l_orderkey.max() + 1))) == 10 and log.version.max() > 1


def test_every_scoped_item_is_hydrated(spark):
    scoped = {r.item_id for r in fl.scoped(load(spark, SF, "items"), fl.Access()).collect()}
    assert max(scoped) >= 200
    assert {r.item_id for r in QUERIES["p_hydrate"](spark, SF).collect()} == scoped


def test_no_mention_item_or_message_is_left_out(spark):
    orders = load(spark, SF, "orders")
    n = orders.count()
    for name in ("c_resolve_entity", "c_reconcile"):
        assert QUERIES[name](spark, SF).count() == n
    assert QUERIES["c_keys_rebuild"](spark, SF).where("key_kind = 'text'").count() == n
    # every message counts: the first of a person fires, whatever its number
    first = {r.o_custkey: r.m for r in orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("m")).collect()}
    waiting = load(spark, SF, "triggers").where("state = 'pending' and kind = 'person'").collect()
    got = {r.trigger_id: r.message_id for r in QUERIES["r_trigger_person"](spark, SF).collect()}
    assert got == {r.trigger_id: first[r.entity_id] for r in waiting}


def _most_rows(plan):
    """The largest number of rows that an operator of a plan that has run made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    made = plan.metrics().get("numOutputRows")
    kids = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([made.get().value() if made.isDefined() else 0, *map(_most_rows, kids)])


def test_a_spelling_that_many_share_is_counted_once(spark):
    """Mentions of a name that many bear meet the counts of its bearers, not each of them."""
    from palimpsest.operators import entities as en

    known = spark.range(400).selectExpr("id AS entity_id", "'person' AS kind", "'Ann' AS name", "array('Annie') AS aliases", "array('sister') AS labels", "'active' AS status", "id % 7 AS updated_at")
    said = spark.range(400).selectExpr("id AS mention_id", "'my sister' AS mention", "'ann' AS name", "'sister' AS label", "'person' AS kind")
    got = en.resolve(said, known)
    assert {(r.outcome, r.entity_id, r.how, r.n_candidates) for r in got.collect()} == {("ambiguous", 6, "name", 400)}
    assert _most_rows(got._jdf.queryExecution().executedPlan()) <= 400 * 6


def test_words_of_messages_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Many names meet the words of messages by a shuffle, few ones are sent to them; both find the same."""
    from palimpsest.functions import text as tx

    said = spark.createDataFrame([(1, "Ann Lee met Bo in New York"), (2, "new york, new york"), (3, "nobody"), (4, None)], "message_id bigint, text string")
    names = spark.createDataFrame([(1, "Ann Lee"), (2, "Bo"), (3, "New York"), (4, "York Bo"), (5, "")], "entity_id bigint, name string")
    for few in (0, 10):
        monkeypatch.setattr(tx, "FEW_NAMES", few)
        got = tx.mentions(said, names)
        assert {(r.message_id, r.entity_id) for r in got.collect()} == {(1, 1), (1, 2), (1, 3), (2, 3)}
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert ("BroadcastHashJoin" in plan, "BuildLeft" in plan) == (few > 0, False)


def test_drafts_with_one_vector_ask_once(spark, monkeypatch):
    """Copies of a vector are one question, and each draft gets its answer; blocks of vectors are not sent to all tasks."""
    from palimpsest.operators import writes as wr

    drafts = spark.range(60).selectExpr("id AS draft_id", "CASE id % 3 WHEN 0 THEN array(1f, 0f) WHEN 1 THEN array(0f, 1f) END AS embedding")
    stored = spark.range(100, 104).selectExpr("id AS item_id", "IF(id = 103, 'deleted', 'active') AS status")
    keys = spark.createDataFrame([(100, [1.0, 0.1]), (101, [0.0, 2.0]), (102, [1.0, 0.0]), (103, [1.0, 0.0])], "item_id bigint, embedding array<float>")
    asked = []
    real = wr.nearest
    monkeypatch.setattr(wr, "nearest", lambda questions, *a: asked.append(questions.count()) or real(questions, *a))
    got = wr.similar_items(drafts, stored, keys)
    assert asked == [2]
    assert {(r.draft_id, r.item_id, r.place) for r in got.collect()} == {(d, *x) for d in range(60) for x in ([(102, 1), (100, 2)], [(101, 1)], [])[d % 3]}
    assert "BroadcastHashJoin" not in real(drafts.selectExpr("draft_id AS question_id", "embedding AS vector"), keys.selectExpr("item_id AS id", "embedding AS vector"), 2)._jdf.queryExecution().sparkPlan().toString()


def test_triggers_are_asked_by_the_earliest_messages_alone(spark, tmp_path, monkeypatch):
    """Of many messages with one vector or one person only the first meets the triggers."""
    from palimpsest.streaming import jobs
    from palimpsest.streaming import state as sst

    rows = spark.range(40).selectExpr("id AS message_id", "timestamp_seconds(100 - id) AS at", "id % 2 AS user", "IF(id % 4 = 0, NULL, array(1f, CAST(id % 2 AS FLOAT))) AS vector")
    rows.write.parquet(f"{tmp_path}/in")
    triggers = spark.createDataFrame([(1, 11, "person", 0, "pending"), (2, 12, "topic", None, "pending"), (3, 13, "person", 1, "fired")], "trigger_id bigint, item_id bigint, kind string, entity_id bigint, state string")
    cues = spark.createDataFrame([(2, [1.0, 1.0])], "trigger_id bigint, vector array<float>")
    counts, real = [], sst.hits
    monkeypatch.setattr(sst, "hits", lambda messages, people, *a: counts.append((messages.count(), people.count())) or real(messages, people, *a))
    got = sst.fire_once(jobs.read_table(spark, f"{tmp_path}/in"), lambda m: m.select("message_id", m["user"].alias("entity_id")), triggers, cues, f"{tmp_path}/job", 0.9)
    assert {(r.trigger_id, r.item_id, r.message_id, r.why) for r in got.collect()} == {(1, 11, 38, "person"), (2, 12, 39, "topic")}
    assert counts == [(2, 2)]
