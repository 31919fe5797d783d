"""Usage accounting and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The value at place round(q (n - 1)), half to even, of each group's sorted values.

    Values are counted first, so the running count goes over distinct values and not over rows.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    run = n.withColumn("upto", F.sum("c").over(W.partitionBy(*by).orderBy(value))).join(n.groupBy(*by).agg(F.sum("c").alias("n")), by)
    hit = run.where(F.col("upto") > F.bround(F.lit(q) * (F.col("n") - 1)))
    return hit.groupBy(*by).agg(F.min(value).alias(name))


def cost(input_tokens: Column, output_tokens: Column, price_in: float, price_out: float) -> Column:
    """Price of a call at prices per million tokens, to 8 places, half to even."""
    total = input_tokens * F.lit(price_in).cast("decimal(10,4)") + output_tokens * F.lit(price_out).cast("decimal(10,4)")
    return F.bround((total / 1_000_000).cast("decimal(38,12)"), 8)


def call_cost(tokens: tuple[Column, Column, Column], prices: tuple[float, float, float]) -> Column:
    """Price of (input, cached, output) tokens at prices per million, to 8 places, half to even."""
    total = sum((n * F.lit(p).cast("decimal(10,4)") for n, p in zip(tokens, prices, strict=True)), F.lit(0).cast("decimal(10,4)"))
    return F.bround((total / 1_000_000).cast("decimal(38,12)"), 8)


def weight(price: tuple[Column, Column], base: tuple[float, float], places: int = 4) -> Column:
    """How many tokens of the base model one token of a model counts as, three of input to one of output, half up."""
    ratio = (price[0] * 3 + price[1]).cast("decimal(20,6)") / F.lit(3 * base[0] + base[1]).cast("decimal(20,6)")
    return F.round(ratio, places)


def charged(tokens: Column, weight_: Column) -> Column:
    return F.round(tokens * weight_, 0).cast("bigint")


def spend(ledger: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Cost and tokens of each owner's own calls; the system's calls don't count against an owner."""
    own = ledger.where(~F.col("system")).join(workspaces, "workspace_id")
    tokens = F.col("input_tokens") + F.col("cached_tokens") + F.col("output_tokens")
    return own.groupBy("owner_id", "tier").agg(F.sum(cost(F.col("input_tokens"), F.col("output_tokens"), 0.25, 1.25)).alias("cost"), F.sum(tokens).alias("tokens"))


def gate(day_spend: DataFrame, daily_cap: float, warn_at: float = 0.8) -> DataFrame:
    """Per (owner, day): blocked over the cap, warned from a share of it on, and whether the warning is the first of the month."""
    state = F.when(F.col("cost") >= daily_cap, "blocked").when(F.col("cost") >= daily_cap * warn_at, "warned").otherwise("fine")
    rows = day_spend.withColumn("state", state)
    n = F.row_number().over(W.partitionBy("owner_id", "state", F.substring("day", 1, 7)).orderBy("day"))
    return rows.withColumn("say", (F.col("state") == "warned") & (n == 1))


def step_timings(calls: DataFrame) -> DataFrame:
    """Per step: median and p95 of calls not answered from a cache, and how many were left out."""
    fresh = calls.where(~F.col("cache_hit"))
    out = nearest_rank(fresh, ["step"], "latency_ms", 0.5, "p50").join(nearest_rank(fresh, ["step"], "latency_ms", 0.95, "p95"), "step")
    counts = calls.groupBy("step").agg(F.count_if(~F.col("cache_hit")).alias("n"), F.count_if("cache_hit").alias("left_out"))
    return out.join(counts, "step")


def line_fit(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least squares slope and intercept; slope 0 and the mean where x is constant."""
    got = df.groupBy(by).agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.avg(y).alias("m"))
    return got.select(by, F.coalesce("s", F.lit(0.0)).alias("slope"), F.coalesce("i", "m").alias("intercept"))


def retrieval_scores(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """hit@5 and mean reciprocal rank by shape: ranked(case_id, item_id, rank), gold(case_id, shape, item_id)."""
    found = gold.join(ranked, ["case_id", "item_id"], "left").groupBy("case_id", "shape").agg(F.min("rank").alias("rank"))
    hit = F.avg(F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0)))
    return found.groupBy("shape").agg(F.round(hit, 6).alias("hit5"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("cases"))
