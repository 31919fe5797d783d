"""Operator 3: line dedup by site-relative frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import materialize

#: Share of a host's pages above which a line is boilerplate, and the pages that it must stand on at least.
RATIO, MIN_PAGES = 0.08, 5
#: Boilerplate hashes that are broadcast at most (8 bytes each); beyond, the hosts are joined by shuffle.
MAX_BROADCAST_HASHES = 500_000


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has boilerplate: (host, pages, drop), drop being the hashes of its boilerplate lines.

    A line counts once a page. Lines are counted per (host, 64-bit line hash) with partial sums, so a hot host is
    spread over all tasks. A host has at most its mean lines a page divided by ``ratio`` such lines.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.trim(x)) > 0)
    pages = docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(lines, _line_hash))).alias("h"))
    counts = pages.groupBy("host", "h").count().where(F.col("count") >= min_pages)
    totals = docs.groupBy(F.col(host).alias("t_host")).agg(F.count("*").alias("pages"))
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("t_host"))).where(F.col("count") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list("h").alias("drop"))


def drop_boilerplate(
    docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, out: str = "line_dedup",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``out`` (n_lines, n_dropped).

    A line is boilerplate at a host if more than ``ratio`` of the host's pages, and at least ``min_pages``, hold it
    (compared without outer spaces). Blank lines stay. Null texts stay null with no lines; an empty text has one
    blank line. A null host is a host of its own. Every page counts, repeated rows too, so ties need no order. A
    page made of boilerplate only becomes empty and stays. Very long texts are split whole. Extra columns are kept, one
    named ``out`` is replaced; an empty table gives no rows.
    """
    known = materialize(boilerplate(docs, text, host, ratio, min_pages))
    n = known.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0]
    known = known.select(F.struct(F.col("host").alias("k"), "drop").alias("__palimpsest_known"))
    known = F.broadcast(known) if n <= MAX_BROADCAST_HASHES else known
    found = docs.join(known, F.col(host).eqNullSafe(F.col("__palimpsest_known.k")), "left")
    lines = F.split(F.col(text), "\n")
    found = found.withColumn("__palimpsest_kept", F.when(
        F.col("__palimpsest_known.drop").isNull(), lines
    ).otherwise(F.filter(lines, lambda x: ~((F.length(F.trim(x)) > 0) & F.array_contains(F.col("__palimpsest_known.drop"), _line_hash(x))))))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    n_kept = F.when(F.col(text).isNull(), 0).otherwise(F.size("__palimpsest_kept"))
    found = found.withColumn(out, F.struct(n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped")))
    kept = F.when(F.col(f"{out}.n_dropped") == 0, F.col(text)).otherwise(F.array_join("__palimpsest_kept", "\n"))
    return found.withColumn(text, kept).drop("__palimpsest_kept", "__palimpsest_known")
