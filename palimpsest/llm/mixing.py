"""Operator 8: mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import Scratch, materialize

#: The per-source table is broadcast up to this many rows (about 200 bytes each), joined by shuffle beyond.
MAX_BROADCAST_SOURCES = 20_000
#: Seed of the documents' coins, and the values that a coin has.
SEED, STEPS = 0, 4096
#: A document is of a later tier for each of these multiples of its source's mean size that it is smaller than.
TIERS = (4.0, 2.0, 1.0, 0.5, 0.25)
#: Standard deviations of a surplus that the probabilities of smaller documents leave room for.
DEVIATIONS = 4.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text: runs other than space, tab and the line-break controls; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(per: DataFrame, by: str) -> DataFrame:
    """``per`` with ``rank`` from 1 in order of ``by``, null last: ranges are ranked apart and moved by what comes before."""
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(per.repartitionByRange(n, F.col(by).asc_nulls_last()).withColumn("__palimpsest_range", F.spark_partition_id()))
    counts = rows.groupBy("__palimpsest_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__palimpsest_range").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    counts = counts.select("__palimpsest_range", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("__palimpsest_range").orderBy(F.col(by).asc_nulls_last()))
    return rows.join(F.broadcast(counts), "__palimpsest_range").withColumn("rank", own + F.col("before")).drop("__palimpsest_range", "before")


def source_targets(
    sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """One row per source: its documents, size, weight, target and repetition rate.

    Sources in code-point order (null last) take the weights in turn and share ``share`` times all sizes. A target
    stops at ``cap`` times its source's size; the excess is shared anew by weight until none is above. That is the
    level L with sum(min(cap * size, L * weight)) = total: it rises from total / all weights as the sources that
    would be above their cap leave, round by round, and each round is one aggregate over the sources.
    """
    per = ranked(sized.groupBy(source).agg(F.sum(size).alias("source_size"), F.count("*").alias("n_docs")), source)
    picks = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(picks, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    per = materialize(per.withColumn("limit", F.col("source_size") * F.lit(cap)))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("limit") < F.lit(level) * F.col("weight")
        n, full_size, open_weight = per.agg(F.count_if(full), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped:
            break
        capped, level = n, (total - (full_size or 0.0)) / open_weight if open_weight else float("inf")
    target = F.least("limit", F.lit(level) * F.col("weight")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.withColumn("target", target).select(source, "n_docs", "source_size", "weight", "target", rate.alias("rate"))


def coin(key: Column, text: Column, seed: int = SEED) -> Column:
    """A whole number from 0 to ``STEPS`` - 1: 12 bits of md5 over seed, key and digest of the text; the same ones always draw the same."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(said), 1, 3), 16, 10).cast("int")


def _tier(size: Column, n: Column, total: Column) -> Column:
    """How many of TIERS x the mean size of the source the document is smaller than."""
    out = F.lit(0)
    for c in TIERS:
        out = out + (size * n < F.lit(c) * total).cast("int")
    return out


def draw_cuts(sized: DataFrame, per: DataFrame) -> DataFrame:
    """``per`` with ``cuts``: for each tier of sizes, the coins below which a document gets its extra copy.

    The largest documents draw with the fraction f of the rate. A later tier's probability is f less a share of what the
    tiers before it took beyond f of their words, spread over the words of this tier and the later ones: smaller
    documents make good what larger ones draw too much or too little. That surplus is zero on average, and the share is
    fixed before any coin falls, so small that the probability stays within 0 and 1 for every surplus that can occur (or
    that is within DEVIATIONS standard deviations): so every document has its copy with probability f, up to the
    rounding to 1 / ``STEPS`` and to rarer surpluses. Coins of a source are summed by tier and coin first: its row in
    the end gathers ``STEPS`` sums a tier at most, however hot the source.
    """
    both = sized.join(per, sized["source"].eqNullSafe(per["source"])).select(
        per["source"], "coin", "size", _tier(F.col("size"), F.col("n_docs"), F.col("source_size")).alias("tier"))
    square = F.sum(F.col("size").cast("decimal(20,0)") * F.col("size")).cast("decimal(38,0)")
    sums = both.groupBy("source", "tier", "coin").agg(F.sum("size").alias("w"), square.alias("q"))
    tiers = sums.groupBy("source", "tier").agg(F.sum("w").alias("words"), F.sum("q").cast("double").alias("squares"), F.collect_list(F.struct("coin", "w")).alias("coins"))
    drawn = tiers.groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list(F.struct("tier", "words", "squares", "coins"))).alias("tiers"))
    fraction = F.col("rate") - F.floor("rate")

    def step(acc: Column, t: Column) -> Column:
        f, rest, spread = acc["f"], acc["rest"], F.lit(DEVIATIONS) * F.sqrt(acc["var"])
        share = F.when((acc["var"] > 0) & (rest > 0), F.least(
            F.lit(1.0), f * rest / F.least((F.lit(1.0) - f) * acc["before"], spread), (F.lit(1.0) - f) * rest / F.least(f * acc["before"], spread))).otherwise(0.0)
        words = lambda cut: F.aggregate(F.filter(t["coins"], lambda x: x["coin"] < cut), F.lit(0).cast("long"), lambda n, x: n + x["w"])

        # an array of one binds a value, which is else worked out again wherever it is named
        def with_share(share: Column) -> Column:
            p = F.when(share > 0, F.greatest(F.least(f - share * (acc["taken"] - f * acc["before"]) / rest, F.lit(1.0)), F.lit(0.0))).otherwise(f)
            kept = F.when(rest > 0, F.lit(1.0) - share * t["words"] / rest).otherwise(1.0)
            return F.transform(F.array(F.floor(p * STEPS + 0.5).cast("int")), lambda cut: F.struct(
                f.alias("f"), (acc["taken"] + words(cut)).alias("taken"), (acc["before"] + t["words"]).alias("before"), (rest - t["words"]).alias("rest"),
                (acc["var"] * kept * kept + f * (F.lit(1.0) - f) * t["squares"]).alias("var"),
                F.concat(acc["cuts"], F.array(F.struct(t["tier"].alias("tier"), cut.alias("cut")))).alias("cuts")))[0]

        return F.transform(F.array(share), with_share)[0]

    zero = F.lit(0).cast("long")
    start = F.struct(fraction.alias("f"), zero.alias("taken"), zero.alias("before"), F.col("source_size").alias("rest"), F.lit(0.0).alias("var"),
                     F.array().cast("array<struct<tier:int,cut:int>>").alias("cuts"))
    both = per.join(drawn, per["source"].eqNullSafe(drawn["s"]))
    return both.withColumn("cuts", F.map_from_entries(F.aggregate("tiers", start, step)["cuts"])).drop("s", "tiers")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, cap: float = 2.0, out: str = "mix",
) -> DataFrame:
    """Every document with its copies in the mix: all columns of ``docs`` and ``out`` (size, source_size, target, rate, copies).

    A document of a source with rate r is emitted floor(r) times and once more if its hash-seeded coin is under the
    cut of its size (``draw_cuts``), so the decision needs neither a shuffle of the texts nor a sort inside a hot
    source; only word counts are summed per source, with partial sums first.

    Null or empty texts have size 0. A null source is a source of its own, the last. Rows with equal key and text draw
    the same coin, null keys by their texts. Sources without words have target and rate 0. An empty frame gives no
    rows. Very long texts are counted whole. Extra columns are kept; one named ``out`` is replaced.
    """
    sized = docs.select(F.col(source).alias("source"), coin(F.col(key), F.col(text)).alias("coin"), word_count(F.col(text)).alias("size"))
    with Scratch(docs.sparkSession) as tmp:
        sized = tmp.write(sized)
        per = tmp.write(source_targets(sized, weights=weights, share=share, cap=cap))
        small = per.count() <= MAX_BROADCAST_SOURCES
        per = materialize(draw_cuts(sized, F.broadcast(per) if small else per))
    per = per.select(F.struct(F.col("source").alias("s"), "n_docs", "source_size", "target", "rate", "cuts").alias("__palimpsest_per"))
    per = F.broadcast(per) if small else per
    rows = docs.withColumn("__palimpsest_size", word_count(F.col(text))).join(per, F.col(source).eqNullSafe(F.col("__palimpsest_per.s")), "left")
    rate, size = F.coalesce(F.col("__palimpsest_per.rate"), F.lit(0.0)), F.col("__palimpsest_size")
    cut = F.col("__palimpsest_per.cuts")[_tier(size, F.col("__palimpsest_per.n_docs"), F.col("__palimpsest_per.source_size"))]
    copies = F.floor(rate) + F.coalesce((coin(F.col(key), F.col(text)) < cut).cast("long"), F.lit(0))
    return rows.withColumn(out, F.struct(
        size.alias("size"), F.col("__palimpsest_per.source_size").alias("source_size"), F.col("__palimpsest_per.target").alias("target"),
        rate.alias("rate"), copies.alias("copies"),
    )).drop("__palimpsest_size", "__palimpsest_per")


def repeat_rows(mixed: DataFrame, mix: str = "mix", out: str = "mix_copy") -> DataFrame:
    """The mix itself: every document as often as it has copies, numbered from 1 in ``out``."""
    n = F.col(f"{mix}.copies").cast("int")
    return mixed.where(n > 0).withColumn(out, F.explode(F.sequence(F.lit(1), n))).drop(mix)
