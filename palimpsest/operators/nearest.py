"""Exact vector search for many questions at once: blocks of questions meet blocks of stored vectors as matrix products.

Each pair of blocks is one row of an ordinary join and one product in one task, of bounded size on both sides. A block gives
at most ``k`` items a question, which are merged afterwards; nothing is skipped, so results are those of comparing all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of the vectors of one block, about.
BLOCK_BYTES = 2 << 20


def _pack(table: pa.Table) -> pa.Table:
    """One row of a block: its number, its ids, and its vectors of length 1 as one matrix."""
    vectors = table["vector"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    unit = flat.reshape(len(vectors), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", unit, unit))
    fine = np.isfinite(norms) & (norms > 0)
    ids = table["id"].to_numpy()[fine]
    order = np.argsort(ids, kind="stable")
    unit = (unit[fine] / norms[fine, None])[order]
    return pa.table([table["block"][:1], pa.array([ids[order].tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], ["block", "ids", "unit"])


def blocks(rows: DataFrame, dims: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Rows(id, vector) as (block, ids, unit), and the number of blocks. Rows of one id share a block; vectors that are null, zero, of another
    length or hold null or infinite components are left out."""
    fine = rows.where(F.col("id").isNotNull() & (F.size("vector") == dims) & ~F.exists("vector", lambda x: x.isNull()))
    fine = fine.select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = max(1, -(-fine.count() * dims * 8 // block_bytes))
    at = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")
    return fine.select(at, "id", "vector").groupBy("block").applyInArrow(_pack, "block int, ids binary, unit binary"), n


def _products(k: int | None, floor: float | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                asked, ids = np.frombuffer(x["asked"], np.int64), np.frombuffer(x["ids"], np.int64)
                if not asked.size or not ids.size:
                    continue
                questions = np.frombuffer(x["questions"]).reshape(asked.size, -1)
                score = np.round(questions @ np.frombuffer(x["unit"]).reshape(ids.size, -1).T, 6)
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                score, names = np.maximum.reduceat(score, first, axis=1), ids[first]  # the best vector of each id
                keep = np.ones(score.shape, bool) if floor is None else score >= floor
                if k is not None and names.size > k:
                    keep &= score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]  # ties of the last place stay for now
                q, s = np.nonzero(keep)
                for i in range(0, q.size, 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q[part]]), pa.array(names[s[part]]), pa.array(score[q[part], s[part]])], ["question_id", "id", "score"])

    return run


def _met(questions: DataFrame, stored: DataFrame, k: int | None, floor: float | None, block_bytes: int) -> DataFrame:
    head = questions.where("vector is not null").select(F.size("vector")).first()
    dims = head[0] if head else 1
    left, n = blocks(questions.select(F.col("question_id").cast("bigint").alias("id"), "vector"), dims, block_bytes)
    right, m = blocks(stored.select(F.col("id").cast("bigint").alias("id"), "vector"), dims, block_bytes)
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    a = left.select(F.col("block").alias("q"), every(m).alias("s"), F.col("ids").alias("asked"), F.col("unit").alias("questions"))
    b = right.select(every(n).alias("q"), F.col("block").alias("s"), "ids", "unit")
    # each block is there many times, which Spark does not foresee when it looks for a side to broadcast
    return a.join(b.hint("merge"), ["q", "s"]).select("asked", "questions", "ids", "unit").mapInArrow(_products(k, floor), "question_id bigint, id bigint, score double")


def nearest(questions: DataFrame, stored: DataFrame, k: int, floor: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(question_id, id, score, place): the ``k`` ids nearest to each of questions(question_id, vector) by cosine, among stored(id, vector).

    An id counts by the best of its vectors. Cosines are rounded to six places, ties go to the least id; with ``floor``, lower ones are
    left out. Ids are integers. A question without a usable vector has no rows.
    """
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.col("score").desc(), "id"))
    return _met(questions, stored, k, floor, block_bytes).withColumn("place", place).where(F.col("place") <= k)


def within(questions: DataFrame, stored: DataFrame, floor: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(question_id, id, score): all ids whose best cosine is ``floor`` or more."""
    return _met(questions, stored, None, floor, block_bytes)
