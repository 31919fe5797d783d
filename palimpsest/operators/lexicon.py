"""A positional index of texts by stem, and ranking by cover density.

Postings lie in folders hashed by stem, so a question reads those of its own stems, however many texts there are. New
texts are appended; what they replace is noted beside them. Writing an index pays if it is asked often: ``Texts`` answers as
it does from the texts alone, read once.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions import stems as st
from palimpsest.functions.batches import bound_batches, slices
from palimpsest.schema import POOL

#: Folders that stems are hashed to; a folder of a large index has many files, each sorted by stem.
SHARDS = 64
#: What one cover weighs whose words stand side by side.
WEIGHT = 0.1
#: Words that a task remembers.
TOLD = 200_000
#: Texts of a block that meets many questions at once, their characters, and sums of texts by questions that it works out at once.
BLOCK, BLOCK_CHARS, CELLS = 8192, 16 << 20, 1 << 20


def shard(stem: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.crc32(stem), F.lit(shards)).cast("int")


def postings(rows: DataFrame, text: str = "text", only: list[str] | None = None) -> DataFrame:
    """The other columns of ``rows`` with stem and places, one row for each stem of a text, or of those in ``only``; words are counted from 1, those left out too."""
    keys = [c for c in rows.columns if c != text]
    bound_batches(rows.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):  # what is worked out at once stays small
            owners, stems, sizes, flat = [], [], [], []
            for x in part.column(len(keys)).to_pylist():
                found = st.places(x, only)
                owners.append(len(found))
                stems += found
                for at in found.values():
                    sizes.append(len(at))
                    flat += at
            rows_of = pa.array(np.repeat(np.arange(part.num_rows), owners))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows_of) for k in range(len(keys))), pa.array(stems, pa.string()), lists], [*keys, "stem", "places"])

    known = rows.where(F.col(text).isNotNull()).select(*keys, text)
    schema = StructType([*known.schema.fields[:-1], *StructType.fromDDL("stem string, places array<int>")])
    return known.mapInArrow(split, schema)


def vocabulary(rows: DataFrame, text: str = "text") -> DataFrame:
    """(word, stem) of every word of the texts that searches look for. Spark finds the distinct words; only these go to Python, once each."""
    bound_batches(rows.sparkSession)
    words = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(st.java_word()), F.lit(0))).alias("word"))
    own = st.stem.__wrapped__  # no word comes twice, so none is remembered

    def stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(own, part.column(0).to_pylist()), pa.string())], ["word", "stem"])

    return words.where(~F.col("word").isin(*st.STOP)).distinct().mapInArrow(stemmed, "word string, stem string")


class Lexicon:
    """Postings of texts that columns ``key`` name, in a folder. Other columns are kept beside the key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], shards: int = SHARDS) -> None:
        self.spark, self.path, self.schema, self.key, self.shards = spark, path, schema, key, shards

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], text: str = "text", shards: int = SHARDS) -> Lexicon:
        schema = postings(rows, text).schema
        out = cls(rows.sparkSession, path, schema, key, shards)
        out._write(rows, text, time.time_ns())
        return out

    def _write(self, rows: DataFrame, text: str, batch: int) -> None:
        found = postings(rows, text).withColumns({"batch": F.lit(batch), "shard": shard(F.col("stem"), self.shards)})
        found = found.repartition("shard", F.pmod(F.xxhash64(*self.key), F.lit(8)))  # a stem that most texts hold is dealt over several files
        found.sortWithinPartitions("shard", "stem").write.mode("append").partitionBy("shard").parquet(f"{self.path}/postings")

    def extend(self, rows: DataFrame, text: str = "text") -> None:
        """Append texts; those of keys that are there replace them. Nothing that is there is read or written again."""
        batch = time.time_ns()
        rows.select(*self.key).distinct().withColumn("until", F.lit(batch)).write.mode("append").parquet(f"{self.path}/replaced")
        self._write(rows, text, batch)

    def stored(self) -> DataFrame:
        """All postings that hold: those of replaced texts are left out."""
        found = self.spark.read.schema(f"{self.schema.toDDL()}, batch bigint, shard int").parquet(f"{self.path}/postings")
        replaced = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/replaced")
        if replaced.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(replaced):
            later = self.spark.read.parquet(f"{self.path}/replaced").groupBy(*self.key).agg(F.max("until").alias("until"))
            same = [found[k].eqNullSafe(later[k]) for k in self.key]
            found = found.join(later, [*same, later["until"] > found["batch"]], "left_anti")
        return found.drop("batch")

    def postings(self, stems: list[str]) -> DataFrame:
        """Postings of stems: only their folders are listed and read, and in these the row groups that may hold them."""
        if not stems:
            return self.stored().where(F.lit(False)).drop("shard")
        shards = sorted({zlib.crc32(s.encode()) % self.shards for s in stems})
        return self.stored().where(F.col("shard").isin(*shards) & F.col("stem").isin(*stems)).drop("shard")

    def scores(self, question: str, every: bool = False) -> DataFrame:
        stems = st.question_stems(question)
        return ranked(self.postings(stems), len(stems), every)


def density(places: list[list[int]]) -> float:
    """Sum over the shortest covers, the runs that hold every stem and no shorter run that does, of WEIGHT / (1 + other words in between)."""
    entries = sorted((p, k) for k, list_ in enumerate(places) for p in list_)
    last, total, counted = [-1] * len(places), 0.0, -1
    for i, (_, k) in enumerate(entries):
        last[k] = i
        first = min(last)
        if first > counted:  # all stems seen; the cover from ``first`` to here is new at its left end
            counted = first
            total += WEIGHT / (1 + entries[i][0] - entries[first][0] - (i - first))
    return total


def ranked(found: DataFrame, stems: int, every: bool = False) -> DataFrame:
    """Postings as (key columns, score): cover density r over r + 1.

    With ``every`` a text must hold all stems, and its covers are the shortest runs that do. Otherwise one is enough: every
    place of any stem is a cover, and the density is their number times ``WEIGHT``.
    """
    keys = [c for c in found.columns if c not in ("stem", "places")]
    if not every:
        n = F.sum(F.size("places"))
        return found.groupBy(*keys).agg(F.round(n / (n + F.lit(round(1 / WEIGHT))), 6).alias("score"))

    @F.pandas_udf("double")
    def dense(lists: pd.Series) -> pd.Series:
        return pd.Series([density([list(p) for p in x]) for x in lists], dtype="float64")

    full = found.groupBy(*keys).agg(F.collect_list("places").alias("__p")).where(F.size("__p") == stems)
    full = full.withColumn("__r", dense("__p")).where("__r > 0")
    return full.select(*keys, F.round(F.col("__r") / (F.col("__r") + 1), 6).alias("score"))


def scan(rows: DataFrame, question: str, text: str = "text", every: bool = False) -> DataFrame:
    """As ``Lexicon.scores`` for texts that have no index: all of them are read."""
    stems = st.question_stems(question)
    return ranked(postings(rows if stems else rows.limit(0), text, stems), len(stems), every)


class Texts:
    """Texts that are asked as a ``Lexicon`` is but have no index: a question reads them once, and only places of its stems go on from there."""

    def __init__(self, rows: DataFrame, key: list[str], text: str = "text") -> None:
        self.rows, self.key, self.text = rows, key, text

    def scores(self, question: str, every: bool = False) -> DataFrame:
        return scan(self.rows, question, self.text, every)


def best(scores: DataFrame, order: list[str], pool: int = POOL) -> DataFrame:
    """The pool of the highest scores, ties in ``order``."""
    return scores.orderBy(F.col("score").desc(), *order).limit(pool)


def _pools(keys: list[str], pool: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of texts(keys, words) and all questions' stems: (question_id, keys, n), the pool of each question in the block; ``keys`` begin with the order of ties.

    ``words`` are texts, or their stems with numbers of places. Rows of one key count together.
    """

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        texts = texts.take(pc.sort_indices(texts, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start"))
        new = np.zeros(texts.num_rows, bool)
        new[:1] = True
        for k in keys:
            code = texts.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        first_row = np.flatnonzero(new)
        ids, stems = (asked.column(c).combine_chunks().dictionary_encode() for c in ("question_id", "stem"))
        order = np.argsort(stems.indices.to_numpy(), kind="stable")
        of_stem = ids.indices.to_numpy()[order]  # questions, those of one stem side by side
        first = np.searchsorted(stems.indices.to_numpy()[order], np.arange(len(stems.dictionary) + 1))
        number = {x: i for i, x in enumerate(stems.dictionary.to_pylist())}
        questions = len(ids.dictionary)
        known: dict[str, int | None] = {}

        def counted(x: str | list[dict]) -> Iterator[tuple[int, int]]:
            if not isinstance(x, str):
                yield from ((number[y["stem"]], y["n"]) for y in x if y["stem"] in number)
                return
            for word, n in st.counts(x).items():
                if word not in known:
                    if len(known) > TOLD:
                        known.clear()
                    known[word] = number.get(st.stem(word))
                if known[word] is not None:
                    yield known[word], n

        bar = np.full(questions, -1.0)  # what the last place of a full pool has
        kept = [np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)]  # questions, keys, sums

        def score(sums: np.ndarray) -> np.ndarray:
            return np.round(sums / (sums + round(1 / WEIGHT)), 6)

        def cut(found: list[list[np.ndarray]]) -> list[np.ndarray]:
            hit, owner, sums = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((owner, -score(sums), hit))
            hit, owner, sums = hit[order], owner[order], sums[order]
            begin = np.searchsorted(hit, np.arange(questions + 1))
            full = np.flatnonzero(np.diff(begin) >= pool)
            bar[full] = score(sums[begin[full] + pool - 1])
            inside = np.arange(len(hit)) - begin[hit] < pool
            return [hit[inside], owner[inside], sums[inside]]

        waiting: list[list[np.ndarray]] = []
        step = max(1, CELLS // max(1, questions))
        for start in range(0, len(first_row) if questions else 0, step):
            ends = np.append(first_row[start : start + step + 1], texts.num_rows)
            rows = texts.column("words").slice(ends[0], ends[min(step, len(ends) - 1)] - ends[0])
            size = len(ends[: step + 1]) - 1
            owners, places, ns = [], [], []
            for at, x in zip(np.searchsorted(ends[1:size], np.arange(ends[0], ends[0] + len(rows)), "right").tolist(), (y.as_py() for y in rows), strict=True):
                for k, n in counted(x):
                    owners.append(at)
                    places.append(k)
                    ns.append(n)
            word = np.array(places, int)
            width = first[word + 1] - first[word]
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[word], width)
            n = np.bincount(np.repeat(np.array(owners, int), width) * questions + of_stem[at], np.repeat(np.array(ns, int), width), size * questions).astype(np.int64)
            cell = np.flatnonzero(n)
            cell = cell[score(n[cell]) > bar[cell % questions]]  # keys come in the order of ties
            waiting.append([cell % questions, start + cell // questions, n[cell]])
            if sum(len(x[0]) for x in waiting) > CELLS:
                kept, waiting = cut([kept, *waiting]), []
        hit, owner, sums = cut([kept, *waiting])
        found = texts.select(keys).take(pa.array(first_row[owner]))
        return pa.Table.from_arrays([ids.dictionary.take(pa.array(hit)), *found.columns, pa.array(sums, pa.int64())], ["question_id", *keys, "n"])

    return run


def scores_of_all(index: Lexicon | Texts, questions: DataFrame, pool: int = POOL) -> DataFrame:
    """(question_id, key columns, score, place): the pool of each of many questions(question_id, text) in one plan.

    Texts, or what an index holds of them, are dealt once to blocks, each of which meets all questions and hands on the pools of
    its own; folders of an index that no question needs are pruned at run time.
    """
    asked = postings(questions.select("question_id", "text")).select("question_id", "stem").distinct()
    if isinstance(index, Lexicon):
        found = index.stored().join(F.broadcast(asked.select("stem").distinct().withColumn("shard", shard(F.col("stem"), index.shards))), ["shard", "stem"], "left_semi").drop("shard")
        others = [c for c in found.columns if c not in ("stem", "places", *index.key)]
        texts = found.groupBy(*index.key, *others).agg(F.collect_list(F.struct("stem", F.size("places").alias("n"))).alias("words"))
        total, chars = index.stored().select(*index.key).distinct().count(), 0
    else:
        others = [c for c in index.rows.columns if c not in (index.text, *index.key)]
        texts = index.rows.where(F.col(index.text).isNotNull()).select(*index.key, *others, F.col(index.text).alias("words"))
        total, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    keys = [*index.key, *others]
    bound_batches(texts.sparkSession)
    blocks = max(-(-total // BLOCK), -(-chars // BLOCK_CHARS), min(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-total // 256)), 1)
    texts = texts.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    every = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = StructType([every.schema["question_id"], *texts.select(*keys).schema.fields, *StructType.fromDDL("n bigint").fields])
    best_of = texts.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_pools(keys, pool), schema)
    scored = best_of.select("question_id", *keys, F.round(F.col("n") / (F.col("n") + F.lit(round(1 / WEIGHT))), 6).alias("score"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.col("score").desc(), *index.key))
    return scored.withColumn("place", place).where(F.col("place") <= pool)
