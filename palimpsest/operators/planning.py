"""Question plans as rows: checks, fallback, defaults and routing, as columns of a plan table.

A plan row is one sub-query: (question_id, n, shape, question, topic, op, field, set_op, set_entity, times, slugs, hops).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import words
from palimpsest.schema import STATES

PLAN_SCHEMA = ("question_id bigint, n int, shape string, question string, topic string, op string, field string, set_op string, set_entity string, "
               "times array<string>, slugs array<string>, hops int")
MAX_SUB_QUERIES = 6
# Tools that answer a shape. Fixed values.
SHAPE_TOOLS: dict[str, tuple[str, ...]] = {
    "exact": ("lookup",), "list": ("lookup",), "latest": ("lookup", "history"), "history": ("history",), "time_window": ("timeline", "search"),
    "order": ("timeline",), "count": ("aggregate",), "set": ("lookup",), "entity": ("entity", "lookup"), "semantic": ("search",), "why": ("history",),
    "situational": ("lookup", "timeline"), "conversation": ("conversation",),
}
# Where a turn goes by its intent; others are answered directly. Fixed values.
INTENT_NODE = {"save": "ingest", "save_and_recall": "ingest", "recall": "recall", "correct": "correct"}
# Everyday words for a state and the states of each kind they mean. Fixed values.
STATE_WORDS: dict[str, dict[str, tuple[str, ...]]] = {
    "open": {"task": ("open",), "intention": ("wanted", "active"), "plan": ("scheduled",)},
    "done": {"task": ("done",), "intention": ("fulfilled",), "resource": ("consumed",), "plan": ("happened",)},
    "current": {"fact": ("current",), "preference": ("current",), "note": ("current",), "intention": ("wanted", "active"), "task": ("open",)},
}
STATE_ALIASES = {
    "pending": "open", "todo": "open", "to_do": "open", "to-do": "open", "planned": "open", "wanted": "open", "unwatched": "open", "unread": "open",
    "queued": "open", "completed": "done", "complete": "done", "finished": "done", "watched": "done", "read": "done", "fulfilled": "done",
    "consumed": "done", "active": "current",
}


# What is said of a plan that may not run. Fixed values.
SAID = {
    "none": "a plan needs at least one sub-query", "blank": "question and topic are required", "count": "a count needs an aggregate", "field": "the aggregate needs a field",
    "set": "a set question needs a set operation", "shared": "shared_with needs an entity", "hops": "relation paths are at most 2 hops", "time": "time not in the question: ", "slug": "not a slug: ",
}


def _named(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def tools(shape: Column, has_topic: Column, missing_entity: Column) -> Column:
    """Tools of a sub-query: a time window without a topic isn't searched, and an entity that isn't known rules out tools that filter by it."""
    out = F.split(_named(shape, {k: ",".join(v) for k, v in SHAPE_TOOLS.items()}), ",")
    return F.filter(out, lambda t: ~((shape == "time_window") & ~has_topic & (t == "search")) & ~(missing_entity & t.isin("entity", "lookup", "aggregate")))


def spoken(text: Column) -> Column:
    return F.array_join(words(text), " ")


def validate(plans: DataFrame, heard: DataFrame) -> DataFrame:
    """(question_id, errors): what is wrong with each plan, against the words heard(question_id, text); no errors is an empty list.

    A plan has one to six sub-queries, each with a question and a topic; a count has an aggregate, another aggregate a
    field, a set question its operation and ``shared_with`` an entity; times are copied from what was said; paths have
    two hops at most; slugs are slugs.
    """
    said = heard.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list(spoken(F.col("text")))), " ").alias("said"))
    rows = plans.join(said, "question_id", "left")
    where = F.concat(F.lit("sub-query "), F.col("n").cast("string"), F.lit(": "))
    bad = lambda test, words_: F.when(F.coalesce(test, F.lit(False)), F.concat(where, F.lit(words_)))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    single = F.array_compact(F.array(
        bad(blank(F.col("question")) | blank(F.col("topic")), SAID["blank"]),
        bad((F.col("shape") == "count") & F.col("op").isNull(), SAID["count"]),
        bad((F.col("op") != "count") & blank(F.col("field")), SAID["field"]),
        bad((F.col("shape") == "set") & F.col("set_op").isNull(), SAID["set"]),
        bad((F.col("set_op") == "shared_with") & blank(F.col("set_entity")), SAID["shared"]),
        bad(F.col("hops") > 2, SAID["hops"])))
    copied = F.transform(F.filter("times", lambda x: ~F.coalesce(F.col("said"), F.lit("")).contains(spoken(x)) | blank(x)), lambda x: F.concat(where, F.lit(SAID["time"]), x))
    slugs = F.transform(F.filter("slugs", lambda x: ~F.lower(x).rlike(r"^[a-z0-9][a-z0-9_\- /]*$")), lambda x: F.concat(where, F.lit(SAID["slug"]), x))
    none = F.array().cast("array<string>")
    rows = rows.select("question_id", F.concat(single, F.coalesce(copied, none), F.coalesce(slugs, none)).alias("e"))
    per = rows.groupBy("question_id").agg(F.count("*").alias("k"), F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    many = F.when(F.col("k") > MAX_SUB_QUERIES, F.array(F.lit(f"at most {MAX_SUB_QUERIES} sub-queries"))).otherwise(none)
    out = heard.select("question_id").distinct().join(per, "question_id", "left")
    return out.select("question_id", F.when(F.col("k").isNull(), F.array(F.lit(SAID["none"]))).otherwise(F.concat(many, F.col("e"))).alias("errors"))


def fallback(plans: DataFrame, errors: DataFrame, messages: DataFrame) -> DataFrame:
    """Plans that may run: those without errors, and for other questions one semantic sub-query over the message(question_id, text)."""
    fine = plans.join(errors.where(F.size("errors") == 0).select("question_id"), "question_id", "left_semi").select("question_id", "n", "shape", "question", "topic")
    rest = messages.join(fine.select("question_id"), "question_id", "left_anti")
    return fine.unionByName(rest.select("question_id", F.lit(1).alias("n"), F.lit("semantic").alias("shape"), F.col("text").alias("question"), F.col("text").alias("topic")))


def looks_ahead(question: Column, direction: Column) -> Column:
    return F.when(direction == "any", F.lower(question).rlike(r"\b(next|upcoming|coming|until|will|soon)\b")).otherwise(direction == "future")


def default_window(shape: Column, question: Column, direction: Column, now: datetime) -> Column:
    """(start, end) of a timeline that names none: order questions look ahead or back from now, time windows 30 days ahead."""
    at, none = F.lit(now).cast("timestamp"), F.lit(None).cast("timestamp")
    ahead = looks_ahead(question, direction)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when((shape == "order") & ahead, span(at, none)).when(shape == "order", span(none, at)).when(shape == "time_window", span(at, at + F.expr("INTERVAL '30' DAY")))


def route(intent: Column) -> Column:
    return F.coalesce(_named(intent, INTENT_NODE), F.lit("answer"))


def state_synonyms(asked: DataFrame) -> DataFrame:
    """(word, kind, state): states that asked(word, kind) mean; a null kind asks for all kinds."""
    rows = [(w, k, s, list(STATES).index(k)) for w, kinds in STATE_WORDS.items() for k, states in kinds.items() for s in states]
    table = asked.sparkSession.createDataFrame(rows, "base string, k string, state string, place int")
    base = F.lower(F.trim("word"))
    key = asked.withColumn("base", F.coalesce(_named(base, STATE_ALIASES), base))
    return key.join(F.broadcast(table), "base").where(F.col("kind").isNull() | (F.col("kind") == F.col("k"))).select("word", F.col("k").alias("kind"), "state")


def booked(plans: DataFrame, window: str) -> DataFrame:
    """Sub-queries added to situational ones that have a window: what is already planned in it."""
    due = plans.where((F.col("shape") == "situational") & F.col(window).isNotNull())
    return due.select("question_id", F.lit("time_window").alias("shape"), F.concat(F.lit("What is already planned "), F.col(window), F.lit("?")).alias("question"),
                      F.concat(F.lit("plans "), F.col(window)).alias("topic"))


def unread(questions: DataFrame, items: DataFrame, shown: int = 5) -> DataFrame:
    """(question_id, item_id): for each situational question(question_id, workspace_id, shape) the newest saved, unread resources of its workspace."""
    rows = items.where("kind = 'resource' AND state = 'saved' AND status = 'active' AND sensitivity = 'normal'")
    newest = F.row_number().over(W.partitionBy("workspace_id").orderBy(F.col("created_at").desc(), F.col("item_id").desc()))
    rows = rows.withColumn("__n", newest).where(F.col("__n") <= shown).select("workspace_id", "item_id")
    return questions.where("shape = 'situational'").join(rows, "workspace_id").select("question_id", "item_id")
