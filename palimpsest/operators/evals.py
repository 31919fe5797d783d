"""Evaluation runs as rows: shares, per-field and per-label scores, chains, reranking, headline, pins and case selection.

A case row has (run_id, case_id, passed, scores map<string,double>); a call row (case_id, step, latency_ms, cost, cache_hit, output_tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.metrics import line_fit, nearest_rank, step_timings

# Steps of the recall chain, and score from which a reranked memory is kept. Fixed values.
RECALL_CHAIN = ("intent", "plan", "embed", "rerank", "answer")
KEEP_SCORE = 0.5
CHARS_PER_TOKEN, TOKENS_PER_MESSAGE = 3.5, 8


def _score(name: str) -> Column:
    return F.coalesce(F.col("scores")[name], F.lit(0.0))


def quality(cases: DataFrame) -> DataFrame:
    """One row: accuracy of answers that must abstain, share of selected memories found by meaning alone, share of relaxed turns."""
    must = _score("must_abstain") > 0
    got = cases.agg(
        F.count_if(must).alias("must_abstain"), F.count_if(must & (_score("abstained") > 0)).alias("abstained"), F.sum(_score("selected")).alias("selected"),
        F.sum(_score("soft_only")).alias("soft"), F.count_if(_score("relaxed") > 0).alias("relaxed"), F.count("*").alias("cases"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return got.select("must_abstain", "cases", share("abstained", "must_abstain").alias("no_answer_accuracy"), share("soft", "selected").alias("soft_share"), share("relaxed", "cases").alias("relaxed_share"))


def field_scores(cases: DataFrame) -> DataFrame:
    """(field, passed, total) summed over maps of cases(passed_by map<string,int>, total_by map<string,int>)."""
    rows = cases.select(F.explode("total_by").alias("field", "total"), "passed_by").select("field", "total", F.coalesce(F.col("passed_by")[F.col("field")], F.lit(0)).alias("passed"))
    return rows.groupBy("field").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))


def label_accuracy(cases: DataFrame, label: str = "expected") -> DataFrame:
    return cases.groupBy(label).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def cost_by_step(calls: DataFrame) -> DataFrame:
    """(step, cost_per_case, calls), dearest first."""
    n = calls.agg(F.countDistinct("case_id").alias("cases"))
    per = calls.groupBy("step").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls")).crossJoin(F.broadcast(n))
    return per.select("step", F.round(F.col("cost") / F.col("cases"), 8).alias("cost_per_case"), "calls").orderBy(F.col("cost_per_case").desc(), "step")


def chain(calls: DataFrame, steps: tuple[str, ...] = RECALL_CHAIN) -> DataFrame:
    """(step, p50, chain_p50, share): medians of the chain's steps, their sum and each one's share of it."""
    rows = step_timings(calls.where(F.col("step").isin(*steps))).select("step", "p50")
    total = rows.agg(F.sum("p50").alias("chain_p50"))
    return rows.crossJoin(F.broadcast(total)).select("step", "p50", F.round("chain_p50", 4).alias("chain_p50"), F.round(F.col("p50") / F.col("chain_p50"), 6).alias("share"))


def rerank_anatomy(scores: DataFrame, calls: DataFrame, depths: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row over rerank scores(call_id, place, score) and their calls(call_id, output_tokens, latency_ms, cache_hit).

    Calls, those that judged one memory and kept it, the median number judged, the line of time over output tokens of
    fresh calls, and for each depth how many calls kept a memory beyond it.
    """
    kept = F.col("score") >= KEEP_SCORE
    per = scores.groupBy("call_id").agg(F.count("*").alias("judged"), F.max(F.when(kept, F.col("place")).otherwise(0)).alias("deepest"))
    row = per.agg(F.count("*").alias("calls"), F.count_if(F.col("judged") == 1).alias("single"), F.count_if((F.col("judged") == 1) & (F.col("deepest") > 0)).alias("single_kept"),
                  *[F.count_if(F.col("deepest") > d).alias(f"beyond_{d}") for d in depths])
    half = nearest_rank(per.withColumn("all", F.lit(1)), ["all"], "judged", 0.5, "judged_p50").drop("all")
    fresh = calls.join(per.select("call_id"), "call_id", "left_semi").where(~F.col("cache_hit"))
    fit = line_fit(fresh.withColumn("all", F.lit(1)).withColumn("output_tokens", F.col("output_tokens").cast("double")), "all", "output_tokens", "latency_ms").drop("all")
    return row.crossJoin(F.broadcast(half)).crossJoin(F.broadcast(fit))


def headline(runs: DataFrame, cases: DataFrame, minimum: int) -> DataFrame:
    """(suite, run_id, passed, cases) of each suite's latest live, complete run(run_id, suite, mode, status, started_at) of ``minimum`` cases or more."""
    n = cases.groupBy("run_id").agg(F.count_if("passed").alias("passed"), F.count("*").alias("cases"))
    fit = runs.where("mode = 'live' AND status = 'complete'").join(n, "run_id").where(F.col("cases") >= minimum)
    last = fit.groupBy("suite").agg(F.max(F.struct("started_at", "run_id", "passed", "cases")).alias("r"))
    return last.select("suite", "r.run_id", "r.passed", "r.cases")


def merge_pins(pins: DataFrame) -> DataFrame:
    """The first score of each (turn_id, match, state) stands, in order of call and place."""
    n = F.row_number().over(W.partitionBy("turn_id", "match", "state").orderBy("call", "place"))
    return pins.withColumn("__n", n).where("__n = 1").drop("__n")


def select_cases(cases: DataFrame, wanted: list[str]) -> DataFrame:
    """Cases(case_id, tags) by id, by a prefix that only one id has, or by tag."""
    names = cases.sparkSession.createDataFrame([(w,) for w in wanted], "want string")
    pairs = cases.join(F.broadcast(names), F.col("case_id").startswith(F.col("want")) | F.array_contains("tags", F.col("want")))
    exact, tagged = F.col("case_id") == F.col("want"), F.array_contains("tags", F.col("want"))
    per = pairs.where(~tagged).groupBy("want").agg(F.count("*").alias("n"), F.max(exact.cast("int")).alias("named"))
    kept = pairs.join(F.broadcast(per), "want", "left").where(tagged | exact | ((F.col("n") == 1) & (F.col("named") == 0)))
    return cases.join(kept.select("case_id").distinct(), "case_id", "left_semi")


def cache_key(*fields: Column) -> Column:
    """sha-256 of a request's fields as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def estimated_tokens(chars: Column, messages: Column) -> Column:
    return (F.ceil(chars / F.lit(CHARS_PER_TOKEN)) + messages * TOKENS_PER_MESSAGE).cast("bigint")
