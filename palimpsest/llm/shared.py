"""Helpers shared by the operators of this subpackage: shared-storage tables, graph components, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that goes to a Python worker, and rows whose derived arrays it holds at once.
ARROW_BYTES = 2 << 20
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables as of ``materialize`` that are deleted when the block ends: nothing that outlives it may read them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths.append(path)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound the bytes of one Arrow batch, unless the session's bound is lower: batches of long texts get fewer rows.

    The plan reads this setting when it runs, so it stays set; batches of short rows are as before.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")  # a user's own bound in other units stays
    if now.isdigit() and int(now) > size:
        spark.conf.set(name, f"{size}b")


def pieces(batches: Iterator[pd.DataFrame], rows: int = ARROW_ROWS) -> Iterator[pd.DataFrame]:
    """Arrow batches cut to so many rows. A batch is bounded by bytes (``bound_batches``), what is worked out from it by rows."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star steps.

    Returns (node, root) for every node of an edge, root being the smallest node of its component. Each round is
    two joins on the node and ends in a written table; nothing is collected but a checksum. Rounds go on until
    nothing changes. Self loops, repeated edges and an empty frame are allowed.
    """
    with Scratch(edges.sparkSession) as tmp:
        cur = tmp.write(
            edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
        )
        before = None
        while True:
            both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
            )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            cur = tmp.write(small)
            row = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if row == before:
                break
            before = row
        return materialize(cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
            cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        ))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9FB21C651E98DF25  # base of the positional hash; odd, so its powers never vanish


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _ODD, np.uint64)]).cumprod(dtype=np.uint64)


_POW = _powers(4096)


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word of a text, words being runs of bytes other than ASCII white space."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not raw.size:
        return np.empty(0, np.uint64)
    word = ~_SPACE[raw]
    at = np.flatnonzero(word)
    if not at.size:
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    lengths = np.diff(np.append(first, at.size))
    place = np.arange(at.size) - np.repeat(first, lengths)
    pw = _POW if lengths.max() <= _POW.size else _powers(int(lengths.max()))
    sums = np.add.reduceat(_BYTE[raw[at]] * pw[place], first)
    return mix64(sums + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text is one shingle of all its words, an empty one has none."""
    n = words.size
    if not n:
        return np.empty(0, np.uint64)
    k = min(width, n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(_ODD) + words[j : n - k + 1 + j]
        return mix64(out + np.uint64(k))
