"""What a query holds and ships does not grow faster than its tables: files it writes, batches of Python, columns that are sorted."""

import hashlib
import random
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.functions import pages as pg
from palimpsest.functions import stems as st
from palimpsest.functions import text as tx
from palimpsest.operators import keys as ky
from palimpsest.operators import lexicon as lx
from palimpsest.operators import lifecycle as lc
from palimpsest.queries import lifecycle, plans, rest, words
from palimpsest.queries.registry import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_question_writes_no_index(spark, monkeypatch):
    def no_write(*_):
        raise AssertionError("an index of all places was written")

    monkeypatch.setattr(lx.Lexicon, "_write", no_write)
    t = Tables(spark, SF)
    assert rest.r_collapse(t).count() and rest.r_lexical(t).count() and rest.j_full_rrf(t).count()


def test_only_places_of_the_question_leave_python(spark):
    rows = spark.createDataFrame([(1, "the cats ran to a cat"), (2, "dogs")], "key_id int, text string")
    assert [(r.key_id, r.stem, r.places) for r in lx.postings(rows, only=["cat"]).collect()] == [(1, "cat", [2, 6])]
    assert lx.Texts(rows, ["key_id"]).scores("of the").count() == 0


def test_pools_of_texts_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lx, "BLOCK", 40)
    monkeypatch.setattr(lx, "CELLS", 64)
    rng = random.Random(9)
    said = lambda n: " ".join(rng.choice("ant bee cats dogs elk fox gnus hen ibis the".split()) for _ in range(n))
    texts = [(i, i // 2, said(rng.randrange(30))) for i in range(300)] + [(7, 3, "bee bee ant")]  # a key that comes twice counts once with both
    asked = [(q, said(3)) for q in range(20)] + [(20, "the"), (21, "zebra"), (22, None)]
    rows = spark.createDataFrame(texts, "key_id bigint, item_id bigint, text string")
    questions = spark.createDataFrame(asked, "question_id bigint, text string")
    want = set()
    for q, question in asked:
        stems, n = set(st.places(question or "")), {}
        for key, item, text in texts:
            hits = sum(len(x) for s, x in st.places(text).items() if s in stems)
            n[key, item] = n.get((key, item), 0) + hits
        best = sorted(((-round(k / (k + 10), 6), key, item) for (key, item), k in n.items() if k))[:25]
        want |= {(q, key, item, -score, place) for place, (score, key, item) in enumerate(best, 1)}
    got = lx.scores_of_all(lx.Texts(rows, ["key_id"]), questions, pool=25)
    assert {(r.question_id, r.key_id, r.item_id, r.score, r.place) for r in got.collect()} == want
    # a block hands on pools, not every text that a question meets
    assert "FlatMapCoGroupsInArrow" in plan(got)


def test_texts_go_to_blocks_as_they_are(spark):
    rows = spark.createDataFrame([(1, "cats ran"), (2, "dogs")], "key_id bigint, text string")
    asked = spark.createDataFrame([(1, "cat"), (1, "cats"), (2, None)], "question_id int, text string")
    got = lx.scores_of_all(lx.Texts(rows, ["key_id"]), asked)
    assert [tuple(r) for r in got.collect()] == [(1, 1, round(1 / 11, 6), 1)]  # a question that comes twice asks for a stem once
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # places of the questions' words only


def test_a_block_hands_on_no_more_than_pools():
    texts = pa.table({"key_id": [*range(40, 0, -1), None], "words": ["bee bee"] * 39 + ["ant"] * 2})
    got = lx._pools(["key_id"], 5)(texts, pa.table({"question_id": [1, 2, 2], "stem": ["bee", "bee", "ant"]})).to_pylist()
    assert [(r["question_id"], r["key_id"], r["n"]) for r in got] == [(q, k, 2) for q in (1, 2) for k in range(2, 7)]
    assert lx._pools(["key_id"], 5)(texts.slice(0, 0), pa.table({"question_id": [1], "stem": ["bee"]})).num_rows == 0


def test_batches_of_pages_and_texts_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.createDataFrame([("<p>a page</p>",)], "html string")
    for made in (lambda: rows.select(pg.page_record(F.col("html"))), lambda: tx.chunks(rows, "html")):
        spark.conf.unset(name)
        assert made().count() == 1 and int(spark.conf.get(name).removesuffix("b")) <= 2 << 20


def test_cases_are_dealt_to_all_cores(spark):
    t = Tables(spark, SF)
    for made in (words.d_window, words.d_window_future, words.x_paywall):
        assert "RoundRobin" not in plan(made(t)) and made(t).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_words_go_on_once_a_task_in_small_batches(spark, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(lx, "TOLD", 3)
    rows = spark.createDataFrame([(f"cats w{i % 7} The", ) for i in range(400)] + [(None,)], "text string")
    got = lx.vocabulary(rows)
    assert {tuple(r) for r in got.collect()} == {("cats", "cat"), *((f"w{i}", f"w{i}") for i in range(7))} and got.count() == 8
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 2 << 20 and "MapInArrow" in plan(got)


def test_a_word_goes_to_python_once(spark):
    odd = "Straße İstanbul ΣΑΣ ñandú x² Ⅷ \U00031350\u0870 e\u0301 a_b it's 3rd 中文 ١٢"
    rows = spark.createDataFrame([(f"cats {odd} w{i % 7} The",) for i in range(400)] + [(None,), ("",), ("the _",)], "text string").repartition(4)
    got = lx.vocabulary(rows)
    want = {w for r in rows.collect() for w in st.words(r.text or "")}
    assert sorted(tuple(r) for r in got.collect()) == sorted((w, st.stem(w)) for w in want)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("MapInArrow") < text.index("Aggregate")  # the texts' words are made distinct before Python sees them


def test_turns_are_indexed_with_few_sorts(spark):
    turns = spark.createDataFrame([(1, " a  b ", "x\n\n- y\n- z"), (2, None, "late"), (3, "asked", None), (4, "", " "), (None, "who", "me")], "turn_id bigint, input string, output string")
    old = spark.createDataFrame([(1, "user", 0, "a", "old"), (None, "user", 0, "a", "old")], "turn_id bigint, role string, seq int, text string, hash string")
    rows = lambda df: sorted(map(repr, df.drop("hash").collect()))
    said = [(1, "user", 0, "a b"), (1, "assistant", 0, "x"), (1, "assistant", 1, "y"), (1, "assistant", 2, "z"), (2, "assistant", 0, "late"), (3, "user", 0, "asked"), (None, "user", 0, "who"), (None, "assistant", 0, "me")]
    frame = lambda x: spark.createDataFrame(x, "turn_id bigint, role string, seq int, text string")
    assert rows(ky.said_rows(turns)) == rows(frame(said))
    assert rows(ky.index_turns(turns, old, only_missing=True)) == rows(frame([r[:4] for r in ((1, "user", 0, "a"), (None, "user", 0, "a"), *said[4:])]))
    assert rows(ky.index_turns(turns, old)) == rows(frame([(None, "user", 0, "a"), *said]))
    text = plan(plans.c_conv_backfill(Tables(spark, SF)))
    # texts are sorted in the parts that they are dealt to, not a file at once, and no vector is joined
    assert text.count("SortMergeJoin") <= 1 and text.count("REPARTITION_BY_NUM") == 3 and "vec_id" not in text and "min_by" not in text


def test_keys_are_rebuilt_without_shipping_hashes(spark):
    at = datetime(2024, 5, 1)
    items = spark.createDataFrame([(1, "episode", "happened", "t", " a  b", None, None, at), (2, "episode", "happened", "t", "a b", None, None, at), (3, "task", "done", "t", None, None, None, at), (4, "fact", "current", "t", "c", "p", None, at)],
                                  "item_id bigint, kind string, state string, title string, text string, predicate string, occurred_start timestamp, mentioned_at timestamp")
    links = spark.createDataFrame([(2, "supersedes", 4), (2, "supersedes", 1), (3, "because", 1), (4, "supersedes", 9)], "src bigint, link_type string, dst bigint")
    stored = spark.createDataFrame([(7, "a b ", [7.0]), (5, "a\tb", [5.0]), (4, "a b", None), (6, None, [6.0]), (8, "other", [8.0])], "key_id bigint, text string, embedding array<float>")
    touched = spark.createDataFrame([(1,), (2,), (2,), (3,), (8,)], "item_id bigint")
    want = [(1, "text", " a  b", [5.0]), (1, "verbal", "It happened:  a  b.", None), (2, "text", "a b", [5.0]), (2, "verbal", "It happened: a b.", None), (2, "change", "Changed on 2024-05-01: a b; before that, a b.", None),
            (3, "text", None, None), (3, "verbal", "Done: .", None)]
    fold = lambda x: x and hashlib.sha256(" ".join(x.split()).encode()).hexdigest()
    for keys in (stored, stored.select("key_id", ky.digest(F.col("text")).alias("digest"), "embedding")):
        got = ky.rebuild(touched, items, keys, links)
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((i, k, x, fold(x), v)) for i, k, x, v in want)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate") < text.index("LeftSemi")  # items are dealt, not their keys
    assert "hash#" not in text.split("Join", 1)[1]  # a text travels with 8 bytes of its hash


def test_operations_are_dealt_to_many_tasks(spark):
    t = Tables(spark, SF)
    many = 16 * spark.sparkContext.defaultParallelism
    for made in (lifecycle.c_trigger_update, lifecycle.c_link_after, lifecycle.c_create, lifecycle.c_correction_fix, lifecycle.c_entity_upsert):
        assert made(t).rdd.getNumPartitions() >= many


def test_a_change_is_sorted_without_the_stored_fields(spark):
    stored = spark.createDataFrame([(1, "a", "t"), (2, None, "u")], "item_id int, state string, title string")
    ops = spark.createDataFrame([(1, 1, 1, {"state": "b", "title": None}), (1, 2, 1, {"state": "c"}), (1, 3, 2, {"state": "x"}), (1, 4, 3, {"state": "x"}), (1, 5, 1, {"colour": "x"}), (1, 6, 1, {}), (1, 7, 1, None)],
                                "turn_id int, seq int, item_id int, changes map<string,string>")
    got = lc.change(ops, stored, fields=("state", "title"))
    assert {tuple(r) for r in got.select("seq", "item_id", "field", "before", "after", "outcome").collect()} == {
        (1, 1, "state", "a", "b", "applied"), (1, 1, "title", "t", None, "applied"), (2, 1, "state", "b", "c", "applied"), (3, 2, "state", None, "x", "applied"),
        (4, 3, None, None, None, "skipped"), (5, 1, None, None, None, "rejected")}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1 and "Union" not in text


def test_parts_of_an_entity_with_many_operations_see_those_before(spark, monkeypatch):
    monkeypatch.setattr(lc, "HEAVY", 7)
    rng = random.Random(3)
    ops = [(rng.randrange(40), seq, rng.choice(("create", "update", "delete")), rng.choice((0, 1, 1, 2, 2, 2, 3, None)), rng.choice((None, f"n{seq}"))) for seq in range(400)]
    known = {0: ("self", "me"), 1: ("person", "old")}
    want, there, name = set(), set(known), {k: v[1] for k, v in known.items()}
    for turn, seq, op, who, said in sorted(ops, key=lambda x: x[:2]):
        skip = (who in there) == (op == "create") or (op == "delete" and who == 0)
        want.add((turn, seq, op, who, name.get(who) if op != "create" else None, said if op != "delete" else None, "skipped" if skip else "applied"))
        if op == "create":
            there.add(who)
        if not skip and op != "delete" and said is not None:
            name[who] = said
    rows = spark.createDataFrame(ops, "turn_id bigint, seq bigint, op string, entity_id bigint, name string")
    got = lc.entity_ops(rows, spark.createDataFrame([(k, *v) for k, v in known.items()], "entity_id bigint, kind string, name string"))
    assert {tuple(r) for r in got.collect()} == want


def test_operations_get_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(lc, "DEALT", 20)
    t = Tables(spark, SF)
    got = lifecycle.c_entity_upsert(t)
    assert got.rdd.getNumPartitions() >= t["lineitem"].count() / 20
    # entities are counted by hashing; rows are sorted only for those with many operations, to find their first
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in text and not any("count(1)" in x and "min(" in x for x in text.splitlines())


def test_edges_after_keep_what_was_stored_twice(spark):
    stored = spark.createDataFrame([(1, 1, "t", 2), (1, 1, "t", 3), (2, 5, "t", 6), (2, 5, "t", 7), (3, 8, "t", 9)], "edge_id int, src int, type string, dst int")
    done = spark.createDataFrame([(1, 1, "add", 2, 5, "t", 8, "applied"), (1, 2, "remove", 3, 8, "t", 9, "applied"), (1, 3, "add", 4, 1, "t", 1, "skipped")], "turn_id int, seq int, op string, edge_id int, src int, type string, dst int, outcome string")
    assert sorted(tuple(r) for r in lc.edges_after(stored, done).collect()) == [(1, 1, "t", 2), (1, 1, "t", 3), (2, 5, "t", 8)]
