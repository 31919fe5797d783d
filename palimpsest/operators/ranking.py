"""Search and ranking: lexical and dense halves, reciprocal rank fusion, demotion, selection and relaxation.

The lexical half is cover density over a positional index of stems (``lexicon``). Dense search is exact.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.filters import Access, Filters, Window, apply
from palimpsest.operators.lexicon import Lexicon, Texts, best
from palimpsest.schema import ANSWER_TOP, COUNT_CHECK, HISTORY_DEMOTION, HISTORY_STATES, LIST_MAX, POOL, RERANK_MIN, RRF_K, SOFT_EXTRAS


def lexical(scores: DataFrame, pool: int = POOL) -> DataFrame:
    """The best ``pool`` of scored keys (key_id, item_id, key_kind, score)."""
    return best(scores, ["item_id", "key_id"], pool)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine to a fixed vector, whose length is known: one fold over the column."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    both = F.zip_with(a, q, lambda p, w: F.struct((p.cast("double") * w).alias("d"), (p.cast("double") * p.cast("double")).alias("n")))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"))
    norm2 = sum(float(x) * float(x) for x in vector)
    return F.aggregate(both, start, lambda s, x: F.struct((s["d"] + x["d"]).alias("d"), (s["n"] + x["n"]).alias("n")), lambda s: s["d"] / F.sqrt(s["n"] * norm2))


def dense(keys: DataFrame, vector: list[float], pool: int = POOL) -> DataFrame:
    """(key_id, item_id, key_kind, score) of the ``pool`` keys nearest to a vector by cosine, over all vectors."""
    rows = keys.where("embedding is not null").select("key_id", "item_id", "key_kind", F.round(cosine_to(F.col("embedding"), vector), 6).alias("score"))
    return rows.orderBy(F.col("score").desc(), "item_id", "key_id").limit(pool)


def collapse(hits: DataFrame) -> DataFrame:
    """The best key of each item with the item's rank; the pool bounds what the one window sorts."""
    first = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), "key_id"))
    best = hits.withColumn("__n", first).where("__n = 1").drop("__n")
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "item_id")))


def rrf_pair(lex: DataFrame, den: DataFrame, limit: int = 50, k: int = RRF_K) -> DataFrame:
    """Two ranked halves as one: (item_id, rrf, key_id), the key coming from the better-ranked half, ties to the lexical."""
    a = lex.select("item_id", F.col("rank").alias("l"), F.col("key_id").alias("lk"))
    b = den.select("item_id", F.col("rank").alias("d"), F.col("key_id").alias("dk"))
    both = a.join(b, "item_id", "full")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    key = F.when(F.col("d").isNull() | (F.col("l") <= F.col("d")), F.col("lk")).otherwise(F.col("dk"))
    return both.select("item_id", F.round(part("l") + part("d"), 9).alias("rrf"), key.alias("key_id")).orderBy(F.col("rrf").desc(), "item_id").limit(limit)


def search(keys: DataFrame, index: Lexicon | Texts, items: DataFrame, question: str, vector: list[float], filters: Filters, access: Access, limit: int = 50) -> DataFrame:
    """Hybrid search over the keys of eligible items and the index of their texts; filters come before the pools are cut."""
    eligible = apply(items, filters, access).select("item_id")
    words, vectors = (x.join(eligible, "item_id", "left_semi") for x in (index.scores(question), keys))
    return rrf_pair(collapse(lexical(words)), collapse(dense(vectors, vector)), limit)


def fuse(hits: DataFrame, items: DataFrame, shape: str, k: int = RRF_K, demotion: float = HISTORY_DEMOTION) -> DataFrame:
    """Hits(channel, item_id, rank) fused per item: (item_id, fused, channels, best, demoted), and with the columns lexical, dense and key_id
    the best scores of both kinds and the key that matched.

    ``fused`` is the sum of 1 / (k + rank) over all hits, halved for what no longer holds unless the shape asks for it; ``best`` the least rank. The key is that
    of the best hit by meaning (channel ``soft``), else of the first channel that has one.
    """
    extra = [c for c in ("lexical", "dense") if c in hits.columns]
    aggs = [F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("s"), F.countDistinct("channel").alias("channels"), F.min("rank").alias("best"), *[F.max(c).alias(c) for c in extra]]
    if "key_id" in hits.columns:
        order = F.struct(F.col("channel") != "soft", "channel", "rank", "key_id")
        aggs.append(F.min_by("key_id", F.when(F.col("key_id").isNotNull(), order)).alias("key_id"))
        extra.append("key_id")
    per = hits.groupBy("item_id").agg(*aggs)
    past = F.col("state").isin(*HISTORY_STATES) | F.col("valid_to").isNotNull()
    factor = F.lit(1.0) if shape in ("history", "why") else F.when(past, demotion).otherwise(1.0)
    return per.join(items.select("item_id", "state", "valid_to"), "item_id").select("item_id", F.round(F.col("s") * factor, 9).alias("fused"), "channels", "best", *extra, past.alias("demoted"))


def select_ranked(rows: DataFrame, top: int = ANSWER_TOP, floor: float = RERANK_MIN) -> DataFrame:
    """Rows(question_id, item_id, score, demoted) that answer: score at least ``floor``, demoted ones only if there are no others, best first."""
    fine = rows.where(F.col("score") >= floor)
    fresh = fine.groupBy("question_id").agg(F.max((~F.col("demoted")).cast("int")).alias("fresh"))
    fine = fine.join(fresh, "question_id").where((F.col("fresh") == 0) | ~F.col("demoted"))
    n = F.row_number().over(W.partitionBy("question_id").orderBy(F.col("score").desc(), "item_id"))
    return fine.withColumn("place", n).where(F.col("place") <= top).select("question_id", "item_id", "place")


def select_list(rows: DataFrame, cap: int = LIST_MAX, extras: int = SOFT_EXTRAS) -> DataFrame:
    """Rows(question_id, item_id, soft, place) of a list answer: the first ``cap`` filtered hits and up to ``extras`` soft ones; ``more`` counts the rest."""
    n = F.row_number().over(W.partitionBy("question_id").orderBy("place", "item_id"))
    first = lambda soft, k: rows.where(F.col("soft") if soft else ~F.col("soft")).withColumn("n", n).where(F.col("n") <= k)
    total = rows.where(~F.col("soft")).groupBy("question_id").agg(F.count("*").alias("total"))
    out = first(False, cap).unionByName(first(True, extras)).join(total, "question_id", "left")
    return out.select("question_id", "item_id", "soft", F.greatest(F.lit(0), F.coalesce("total", F.lit(0)) - cap).alias("more"))


def look_alikes(soft: DataFrame, counted: DataFrame, floor: float = COUNT_CHECK) -> DataFrame:
    """Soft hits at or above the floor that a count did not count."""
    return soft.where(F.col("score") >= floor).join(counted, ["question_id", "item_id"], "left_anti")


def month_window(w: Window, pad: int, timezone: str) -> Window:
    """A window widened to whole local months and by ``pad`` months on either side; an open end stays open."""
    zone = ZoneInfo(timezone)

    def first_of(at: datetime, months: int) -> datetime:
        local = at.replace(tzinfo=UTC).astimezone(zone)
        n = local.year * 12 + local.month - 1 + months
        return datetime(n // 12, n % 12 + 1, 1, tzinfo=zone).astimezone(UTC).replace(tzinfo=None)

    return Window(w.clock, w.start and first_of(w.start, -pad), w.end and first_of(w.end - timedelta(microseconds=1), 1 + pad))


def ladder(filters: Filters, timezone: str = "UTC", missing_entity: bool = False) -> list[tuple[str, Filters]]:
    """What is asked, then the steps that loosen it, of those that change something: without category, subtypes, states, by the whole month,
    by a month more on either side, without entities (unless the one asked for isn't known)."""
    steps, cur = [("asked", filters)], filters
    for name, step in (("category", "category"), ("subtypes", "subtype"), ("states", "state")):
        if getattr(cur, name):
            cur = cur.without(name)
            steps.append((step, cur))
    if cur.window is not None:
        for pad, step in ((0, "window_month"), (1, "window_wide")):
            cur = replace(cur, window=month_window(cur.window, pad, timezone))
            steps.append((step, cur))
    if cur.entity_ids and not missing_entity:
        steps.append(("entity", cur.without("entity_ids", "roles")))
    return steps


def relax(items: DataFrame, filters: Filters, access: Access, item_entities: DataFrame | None = None, timezone: str = "UTC", missing_entity: bool = False) -> DataFrame:
    """(item_id, step): the hits of the first step of the ``ladder`` that has any.

    Steps add up. All are branches of one plan, and the first that has rows stays, so nothing is collected to decide.
    """
    out = None
    for i, (name, f) in enumerate(ladder(filters, timezone, missing_entity)):
        part = apply(items, f, access, item_entities).select("item_id", F.lit(i).alias("n"), F.lit(name).alias("step"))
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(out.agg(F.min("n").alias("n"))), "n").select("item_id", "step")  # one row is broadcast


#: Shapes whose answer is a list; settings of the answer. Fixed values.
LIST_LIKE, PASSAGE_FLOOR = ("list", "set", "time_window", "situational"), 0.4


def select(candidates: DataFrame, questions: DataFrame, counted: DataFrame, top: int = ANSWER_TOP, cap: int = LIST_MAX, floor: float = RERANK_MIN) -> DataFrame:
    """(question_id, item_id, n, why, more): what reaches the answer of each question, in order, by the shape of the question.

    Candidates(question_id, item_id, place, filtered, soft_only, lexical, rerank, passage, demoted, occurred_start, due_at, mentioned_at);
    questions(question_id, shape, missing_entity, by_code, reranked, start, end). A question for an unknown entity has none. A count cites
    what was counted(question_id, item_id, n), in that order. A list has its first ``cap`` filtered hits, none that no longer hold if others do, and ``top`` extras found
    by meaning alone that pass the bar, which a set has none of and a time window only from its period; ``more`` counts what the cap left out. Others have the
    ``top`` best by the judge's score at ``floor`` or more, else by place if filtered or sharing words; of these, what no longer holds only if nothing else is there.
    """
    rows = candidates.join(questions, "question_id").where("NOT missing_entity")
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rerank")))
    lifted = F.col("passage") & (F.coalesce("lexical", F.lit(0.0)) > 0) & (clamped.isNull() | (clamped < PASSAGE_FLOOR))
    rows = rows.withColumn("score", F.when(F.col("reranked"), F.when(lifted, F.lit(PASSAGE_FLOOR)).otherwise(clamped)))
    words = F.coalesce("lexical", F.lit(0.0)) > 0
    rows = rows.withColumn("passes", F.when(F.col("score").isNotNull(), F.col("score") >= floor).otherwise(words))
    by = W.partitionBy("question_id")
    cut = lambda df, n, *order: df.withColumn("n", F.row_number().over(by.orderBy(*order))).where(F.col("n") <= n)
    result = lambda df, why, more=F.lit(0): df.select("question_id", "item_id", F.col("n").cast("bigint").alias("n"), F.lit(why).alias("why"), more.cast("bigint").alias("more"))
    count = rows.where("shape = 'count'").join(counted.withColumnRenamed("n", "at"), ["question_id", "item_id"]).withColumn("n", F.row_number().over(by.orderBy("at", "item_id")))
    listed = rows.where((F.col("shape") != "count") & (F.col("shape").isin(*LIST_LIKE) | F.col("by_code")))
    base = current_first(listed.where("filtered"))
    total = base.groupBy("question_id").agg(F.count("*").alias("total"))
    kept = cut(base, cap, "place", "item_id").join(total, "question_id")
    extra = listed.where(F.col("soft_only") & F.col("passes") & (F.col("shape") != "set") & ((F.col("shape") != "time_window") | in_period(F.col("start"), F.col("end"))))
    extra = cut(extra.where(~(F.col("filtered"))), top, "place", "item_id").withColumn("n", F.col("n") + cap)
    others = rows.where((F.col("shape") != "count") & ~F.col("shape").isin(*LIST_LIKE) & ~F.col("by_code"))
    fine = others.where(F.when(F.col("reranked"), F.coalesce(F.col("score") >= floor, F.lit(False))).otherwise(F.col("filtered") | words))
    ranked = current_first(cut(fine, top, F.when(F.col("reranked"), F.col("score")).desc(), "place", "item_id"))
    out = result(count, "counted").unionByName(result(kept, "listed", F.greatest(F.lit(0), F.col("total") - cap)))
    return out.unionByName(result(extra, "extra")).unionByName(result(ranked, "ranked"))


def conversation(said: DataFrame, index: Lexicon | Texts, question: str, vector: list[float], role: str | None = None, exclude: int | None = None, limit: int = 10, k: int = RRF_K) -> DataFrame:
    """(turn_id, role, seq, rrf): the best snippet of each (turn, role) of what was said, by both halves of search, best first."""
    def asked(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("role") == role) if role else rows
        return rows if exclude is None else rows.where(F.col("turn_id") != exclude)

    order = [F.col("score").desc(), "turn_id", "seq", "role"]
    place = lambda df, name: df.orderBy(*order).limit(POOL).select("turn_id", "role", "seq", F.row_number().over(W.orderBy(*order)).alias(name))
    lex = place(asked(index.scores(question)), "l")
    den = place(asked(said).where("embedding is not null").select("turn_id", "role", "seq", F.round(cosine_to(F.col("embedding"), vector), 6).alias("score")), "d")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    both = lex.join(den, ["turn_id", "role", "seq"], "full").withColumn("rrf", F.round(part("l") + part("d"), 9))
    best = both.groupBy("turn_id", "role").agg(F.max(F.struct("rrf", (-F.col("seq")).alias("m"))).alias("b"))
    best = best.select("turn_id", "role", (-F.col("b.m")).alias("seq"), F.col("b.rrf").alias("rrf"))
    return best.orderBy(F.col("rrf").desc(), F.col("turn_id").desc(), "role").limit(limit)


def when() -> Column:
    """The moment that an item is ordered by: when it happened, else from when it holds, is due, was told."""
    return F.coalesce("occurred_start", "valid_from", "due_at", "mentioned_at")


def fused_order(fused: DataFrame, items: DataFrame) -> DataFrame:
    """``fused`` with ``place``: best first, then the later moment, then the title, then the id."""
    rows = fused.join(items.select("item_id", when().alias("__when"), F.lower("title").alias("__title")), "item_id")
    order = W.partitionBy("question_id").orderBy(F.col("fused").desc(), F.col("__when").desc(), "__title", "item_id")
    return rows.withColumn("place", F.row_number().over(order)).drop("__when", "__title")


def reranked(rows: DataFrame) -> DataFrame:
    """Rows(question_id, item_id, score, place) in order of a judge's score, ties by their fused place, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.col("score").desc(), "place", "item_id")))


def in_period(start: Column, end: Column) -> Column:
    """Whether an item happened, is due or was told in [start, end); an open end doesn't bound."""
    inside = lambda c: F.coalesce((start.isNull() | (F.col(c) >= start)) & (end.isNull() | (F.col(c) < end)) & F.col(c).isNotNull(), F.lit(False))
    return inside("occurred_start") | inside("due_at") | inside("mentioned_at")


def current_first(rows: DataFrame) -> DataFrame:
    """Rows(question_id, demoted) without the demoted ones of a question that has others."""
    fresh = rows.groupBy("question_id").agg(F.bool_or(~F.col("demoted")).alias("__fresh"))
    return rows.join(fresh, "question_id").where(~F.col("__fresh") | ~F.col("demoted")).drop("__fresh")


def passage_floor(score: Column, passage: Column, demoted: Column, floor: float = 0.4) -> Column:
    """A judge's score within 0 to 1; a current passage gets ``floor`` at least."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.when(passage & ~demoted, F.greatest(clamped, F.lit(floor))).otherwise(clamped)


def closest(items: DataFrame, at: Column, by: str) -> DataFrame:
    """(by, item_id): of each group the item that happened nearest to an instant; ties go to the least id."""
    far = F.struct(F.abs(F.unix_timestamp("occurred_start") - F.unix_timestamp(at)), F.col("item_id"))
    return items.where("occurred_start IS NOT NULL").groupBy(by).agg(F.min_by("item_id", far).alias("item_id"))


def dedupe_ordered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order, as a list that keeps its order would."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
