"""Streams with state that outlives a run: events numbered in order, spend counters with resets, triggers that fire once.

A job lives in a folder: Spark's checkpoint, what it wrote, and, where a micro-batch is merged into a table, that table by
batch. A batch that runs again after a failure reads the table of the batch before it and writes its own anew, so it counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from palimpsest.operators.nearest import within

#: Seconds that the counters of a day and of a month are kept after they last grew. Fixed values.
DAY_KEPT, MONTH_KEPT = 3 * 86_400, 40 * 86_400
#: Cosine from which a message meets a topic. Fixed value.
TOPIC_AT = 0.6
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


STORE = "spark.sql.streaming.stateStore.providerClass"


def run_job(stream: DataFrame, base: str, batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over what is there and has not been read by this job before. State is kept by RocksDB, which timers and lists need."""
    conf = stream.sparkSession.conf
    store = conf.get(STORE)
    conf.set(STORE, ROCKSDB)  # the query takes the settings of its start
    try:
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        query = (writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", f"{base}/out")).start()
    finally:
        conf.set(STORE, store)
    query.awaitTermination()


# ---------------------------------------------------------------- numbers of events

class Numbering(StatefulProcessor):
    """Holds the events of a turn until the watermark has passed them, then gives them the next numbers, by time and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id bigint, ms bigint")
        self.last = handle.getValueState("last", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendList([(int(e), int(m)) for e, m in zip(part["event_id"], part["ms"], strict=True)])
            first = min(int(part["ms"].min()), first or 1 << 62)
        self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(((m, e) for e, m in self.waiting.get()))
        due = [x for x in held if x[0] < now]
        if not due:
            return
        n = self.last.get()[0] if self.last.exists() else 0
        self.last.update((n + len(due),))
        self.waiting.clear()
        if len(due) < len(held):
            self.waiting.put([(e, m) for m, e in held[len(due):]])
            self.handle.registerTimer(held[len(due)][0])
        yield pd.DataFrame({"turn_id": [key[0]] * len(due), "event_id": [e for _, e in due], "seq": range(n + 1, n + len(due) + 1)})

    def close(self) -> None:
        pass


def numbered(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(turn_id, event_id, seq): events(turn_id, event_id, ts) with numbers from 1 without gaps in each turn, in order of time.

    An event gets its number when the watermark, ``delay`` behind the latest event of all, has passed it; one that comes later than that
    is not numbered. What waits and the last number of each turn are the state.
    """
    rows = events.select("turn_id", "event_id", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", delay)
    return rows.groupBy("turn_id").transformWithStateInPandas(Numbering(), "turn_id bigint, event_id bigint, seq bigint", "Append", "EventTime")


# ---------------------------------------------------------------- tables by batch

class Versions:
    """A table of which each micro-batch writes a version of its own."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType | str) -> None:
        self.spark, self.base, self.schema = spark, base, schema

    def _folder(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def known(self) -> list[int]:
        path, files = self._folder()
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}/_SUCCESS")))

    def before(self, batch: int) -> DataFrame:
        """The version of the last batch before ``batch``; empty if there is none."""
        earlier = [b for b in self.known() if b < batch]
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/batch={earlier[-1]}") if earlier else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        return self.before(1 << 62)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Write the version of a batch, and drop those that no batch can ask for any more."""
        rows.write.mode("overwrite").parquet(f"{self.base}/batch={batch}")
        path, files = self._folder()
        for b in [b for b in self.known() if b < batch][:-1]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/batch={b}"), True)


# ---------------------------------------------------------------- spend

COUNTERS = "owner_id bigint, scope string, name string, amount bigint, reset_at timestamp, latest timestamp"


def _spent(calls: DataFrame) -> DataFrame:
    """(owner_id, scope, name, amount, latest) that calls(owner_id, at, provider, cost) add to counters of a day, a month and a provider."""
    names = {"day": F.date_format("at", "yyyy-MM-dd"), "month": F.date_format("at", "yyyy-MM"), "provider": F.col("provider")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scope"), v.alias("name")) for k, v in names.items()]))
    return calls.select("owner_id", "cost", "at", each.alias("x")).groupBy("owner_id", "x.scope", "x.name").agg(F.sum("cost").alias("amount"), F.max("at").alias("latest"))


def merged_spend(before: DataFrame, batch: DataFrame) -> DataFrame:
    """Counters after a batch of calls and resets (columns kind, owner_id, at, provider, cost, totals array of (scope, name, amount)).

    A reset says what the ledger holds up to its time: of an owner with a newer reset all counters become its totals, and calls
    before that time, in this batch or later, are no news. A counter of a day or month goes when the owner's latest call or reset is ``DAY_KEPT`` or ``MONTH_KEPT``
    after its own. Costs are whole numbers of a small unit.
    """
    resets = batch.where("kind = 'reset'").groupBy("owner_id").agg(F.max_by(F.struct("at", "totals"), "at").alias("r"))
    resets = resets.select("owner_id", F.col("r.at").alias("new_at"), F.col("r.totals").alias("totals"))
    old = before.groupBy("owner_id").agg(F.max("reset_at").alias("old_at"))
    since = resets.join(old, "owner_id", "full").withColumn("fresh", F.coalesce(F.col("new_at") > F.col("old_at"), F.col("new_at").isNotNull()))
    since = since.withColumn("reset_at", F.when(F.col("fresh"), F.col("new_at")).otherwise(F.col("old_at")))
    calls = batch.where("kind = 'call'").join(since.select("owner_id", "reset_at"), "owner_id", "left").where("reset_at IS NULL OR at >= reset_at")
    kept = before.join(since.where("fresh").select("owner_id"), "owner_id", "left_anti").select("owner_id", "scope", "name", "amount", "latest")
    set_ = since.where("fresh").select("owner_id", F.explode("totals").alias("t"), F.col("new_at").alias("latest")).select("owner_id", "t.scope", "t.name", "t.amount", "latest")
    marks = since.where("fresh").select("owner_id", F.lit("reset").alias("scope"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("amount"), F.col("new_at").alias("latest"))
    rows = kept.unionByName(set_).unionByName(marks).unionByName(_spent(calls))
    rows = rows.groupBy("owner_id", "scope", "name").agg(F.sum("amount").alias("amount"), F.max("latest").alias("latest"))
    rows = rows.join(since.select("owner_id", "reset_at"), "owner_id", "left")
    ends = rows.groupBy("owner_id").agg(F.max("latest").alias("end"))
    kept_for = F.when(F.col("scope") == "day", DAY_KEPT).when(F.col("scope") == "month", MONTH_KEPT)
    fresh = kept_for.isNull() | (F.unix_seconds("end") - F.unix_seconds("latest") < kept_for)
    return rows.join(ends, "owner_id").where(fresh).select("owner_id", "scope", "name", "amount", "reset_at", "latest")


def spend_counters(stream: DataFrame, base: str) -> DataFrame:
    """Run a stream of calls and resets into counters (``merged_spend``), and return them."""
    versions = Versions(stream.sparkSession, f"{base}/counters", COUNTERS)
    run_job(stream, base, lambda rows, batch: versions.write(merged_spend(versions.before(batch), rows), batch))
    return versions.latest()


# ---------------------------------------------------------------- triggers

FIRED = "trigger_id bigint, item_id bigint, message_id bigint, why string, score double"


def hits(messages: DataFrame, people: DataFrame, waiting: DataFrame, cues: DataFrame, floor: float = TOPIC_AT) -> DataFrame:
    """(trigger_id, item_id, message_id, why, score) of messages(message_id, at, vector) that meet waiting triggers(trigger_id, item_id, kind, entity_id).

    A person is met when people(message_id, entity_id) name them, a topic by a cosine of ``floor`` or more to one of its cues(trigger_id, vector).
    """
    person = waiting.where("kind = 'person'").join(people, "entity_id").select("trigger_id", "item_id", "message_id", F.lit("person").alias("why"), F.lit(None).cast("double").alias("score"))
    topics = waiting.where("kind = 'topic'").select("trigger_id", "item_id")
    near = within(messages.select(F.col("message_id").alias("question_id"), "vector"), cues.join(topics.select("trigger_id"), "trigger_id", "left_semi").select(F.col("trigger_id").alias("id"), "vector"), floor)
    topic = near.join(topics, near["id"] == topics["trigger_id"]).select("trigger_id", "item_id", F.col("question_id").alias("message_id"), F.lit("topic").alias("why"), "score")
    return person.unionByName(topic)


def fire_once(stream: DataFrame, people: Callable[[DataFrame], DataFrame], triggers: DataFrame, cues: DataFrame, base: str, floor: float = TOPIC_AT) -> DataFrame:
    """Run a stream of messages over pending triggers; each fires at its earliest message (ties: the least id) of the first batch that meets it, never again.

    ``people`` gives the entities that messages name. What has fired is the state.
    """
    versions = Versions(stream.sparkSession, f"{base}/fired", FIRED)

    def step(rows: DataFrame, batch: int) -> None:
        done = versions.before(batch)
        waiting = triggers.where("state = 'pending'").join(done.select("trigger_id"), "trigger_id", "left_anti")
        # of the messages that name one entity, or have one vector, only the earliest can be the first
        earliest = F.min(F.struct("at", "message_id")).alias("m")
        asked = rows.where("vector is not null").groupBy("vector").agg(earliest).select("m.message_id", "m.at", "vector")
        named = people(rows).hint("merge").join(rows.select("message_id", "at"), "message_id").groupBy("entity_id").agg(earliest).select("m.message_id", "m.at", "entity_id")
        at = asked.select("message_id", "at").unionByName(named.select("message_id", "at")).distinct()
        found = hits(asked, named.drop("at"), waiting, cues, floor).join(at, "message_id")
        first = found.groupBy("trigger_id").agg(F.min_by(F.struct("item_id", "message_id", "why", "score"), F.struct("at", "message_id")).alias("h"))
        versions.write(done.unionByName(first.select("trigger_id", "h.*")), batch)

    run_job(stream, base, step)
    return versions.latest()
