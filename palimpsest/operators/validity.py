"""Facts with two times: when they hold and when they were learnt. Facts that come late split what was believed before.

Of facts about one subject and predicate that hold at the same time, the one learnt last counts (ties: the greatest id). The log of
facts is the truth; everything here follows from it, so facts may arrive in any order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.streaming.state import Versions, run_job

KEY = ("subject_id", "predicate")
FACT = "fact_id bigint, subject_id bigint, predicate string, valid_from timestamp, valid_to timestamp, learnt_at timestamp"
OPEN = (1 << 63) - 1
LINE = "subject_id bigint, predicate string, fact_id bigint, valid_from timestamp, valid_to timestamp, learnt_at timestamp"


def _usable(facts: DataFrame, known_at: Column | None) -> DataFrame:
    rows = facts.where("valid_from IS NOT NULL AND learnt_at IS NOT NULL AND fact_id IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)")
    return rows if known_at is None else rows.where(F.col("learnt_at") <= known_at)


def as_of(facts: DataFrame, valid_at: Column | datetime, known_at: Column | datetime | None = None) -> DataFrame:
    """(subject_id, predicate, fact_id): what held at one time, as it was known at another; one aggregate, however many facts a key has."""
    at = valid_at if isinstance(valid_at, Column) else F.lit(valid_at)
    known = known_at if known_at is None or isinstance(known_at, Column) else F.lit(known_at)
    rows = _usable(facts, known).where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return rows.groupBy(*KEY).agg(F.max_by("fact_id", F.struct("learnt_at", "fact_id")).alias("fact_id"))


def _sweep(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted facts (microseconds) to intervals: the open facts of one key lie in a heap, the one learnt last on top."""
    key, heap, now, line, out = None, [], None, None, []

    def put(fact: int, learnt: int, start: int, end: int) -> None:
        """What holds from ``start`` to ``end``; joined to the line before it if that is the same fact."""
        nonlocal line
        if line and line[2] == fact and line[4] == start:
            line = (*line[:4], end, learnt)
            return
        if line:
            out.append(line)
        line = (*key, fact, start, end, learnt)

    def advance(to: int | None) -> None:
        """Go on to a time, or to the end: whenever the top fact ends, the next below it holds."""
        nonlocal now
        while heap and (to is None or now < to):
            learnt, _, fact, end = heap[0]
            if end <= now:
                heapq.heappop(heap)
                continue
            stop = end if to is None else min(to, end)
            put(fact, -learnt, now, stop)
            if stop == OPEN:
                return
            now = stop
        now = to

    def close() -> None:
        nonlocal line
        advance(None)
        heap.clear()
        if line:
            out.append(line)
        line = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*[(*r[:4], None if r[4] == OPEN else r[4], r[5]) for r in rows], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for x in batch.to_pylist():
            this = (x["subject_id"], x["predicate"])
            if this != key or now is None:
                if key is not None:
                    close()
                key, now = this, x["start"]
            advance(x["start"])
            heapq.heappush(heap, (-x["learnt"], -x["fact_id"], x["fact_id"], OPEN if x["stop"] is None else x["stop"]))
        if len(out) > 4096:
            yield batch_of(out)
            out = []
    if key is not None:
        close()
    if out:
        yield batch_of(out)


def timeline(facts: DataFrame, known_at: Column | datetime | None = None) -> DataFrame:
    """(subject_id, predicate, fact_id, valid_from, valid_to, learnt_at): intervals that don't overlap, of what holds when, as known at a time.

    A fact whose middle a later one takes has two intervals. Facts of a key are swept in order of their start, as they stream by; the facts
    that are open at one time are held. Facts without start, time of learning or id, and those that end before they start, are left out.
    """
    known = known_at if known_at is None or isinstance(known_at, Column) else F.lit(known_at)
    micros = lambda c: F.unix_micros(c).alias
    rows = _usable(facts, known).select(*KEY, "fact_id", micros("valid_from")("start"), micros("valid_to")("stop"), micros("learnt_at")("learnt"))
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "start", "learnt", "fact_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = pa.timestamp("us", tz="UTC")
        yield from _sweep(batches, pa.schema([("subject_id", pa.int64()), ("predicate", pa.string()), ("fact_id", pa.int64()), ("valid_from", stamp), ("valid_to", stamp), ("learnt_at", stamp)]))

    return rows.mapInArrow(run, LINE)


def late_facts(stream: DataFrame, base: str) -> DataFrame:
    """Run a stream of facts into a timeline, and return it: only keys that a micro-batch touches are swept anew, over all their facts."""
    spark = stream.sparkSession
    log, lines = Versions(spark, f"{base}/facts", FACT), Versions(spark, f"{base}/lines", LINE)

    def step(rows: DataFrame, batch: int) -> None:
        new = rows.select(*[f.name for f in StructType.fromDDL(FACT)])
        log.write(log.before(batch).unionByName(new).dropDuplicates(["fact_id"]), batch)
        same = lambda x, y: [x[c].eqNullSafe(y[c]) for c in KEY]
        touched, known, before = new.select(*KEY).distinct(), log.before(batch + 1), lines.before(batch)
        lines.write(before.join(touched, same(before, touched), "left_anti").unionByName(timeline(known.join(touched, same(known, touched), "left_semi"))), batch)

    run_job(stream, base, step)
    return lines.latest()
