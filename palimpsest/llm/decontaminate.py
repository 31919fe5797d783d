"""Operator 1: benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import bound_batches, materialize

#: Edits (words put in, left out or replaced) that a copy may differ by, as a share of the item's words.
ERROR_RATE = 0.15
#: Items and characters of one block, about: a block's items are broadcast, a larger benchmark takes several.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
_GAP = re.compile(r"[\W_]+")


def normalize(text: str) -> str:
    """Lower-case words between single spaces, with one at either end; just one space if there are none."""
    return f" {_GAP.sub(' ', text.lower()).strip()} ".replace("  ", " ")


def pieces(words: list[str], budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 runs of words, as even as can be, with the place of each: an item with that many edits keeps one."""
    n, k = len(words), budget + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, f" {' '.join(words[a:b])} ") for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[str], text: list[str]) -> int:
    """Fewest edits that turn the pattern into a run of the text (bit-parallel, one big integer for the pattern)."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1  # the pattern may begin anywhere: no carry into the first row
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        best = min(best, score)
    return best


class Matcher:
    """The pieces of a block of items in one automaton, and the words to verify against."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items: list[tuple[int, list[str], int]] = []
        found: dict[str, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words = normalize(text).split()
            if not words:
                continue
            budget = int(error_rate * len(words))
            for at, piece in pieces(words, budget):
                found.setdefault(piece, []).append((len(self.items), at, len(piece)))
            self.items.append((item_id, words, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, owners)
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[int]:
        """Ids of the items that the text holds within their error budgets, sorted."""
        if not text or not self.items:
            return []
        body = normalize(text)
        done: set[int] = set()
        seen: set[tuple[int, int]] = set()
        words: list[str] | None = None
        place, counted = 0, 0  # words before character ``counted``
        for end, owners in self.automaton.iter(body):
            for item, at, length in owners:
                if item in done:
                    continue
                item_id, pattern, budget = self.items[item]
                if words is None:
                    words = body.split()
                start = end - length + 1
                if start >= counted:
                    place += body.count(" ", counted, start)
                    counted, word = start, place
                else:
                    word = place - body.count(" ", start, counted)
                diagonal = word - at
                if (item, diagonal) in seen:
                    continue
                seen.add((item, diagonal))
                window = words[max(0, diagonal - budget) : diagonal + len(pattern) + budget]
                if myers(pattern, window) <= budget:
                    done.add(item)
        return sorted(self.items[i][0] for i in done)


def _finder(block: Broadcast, error_rate: float):  # noqa: ANN202
    @F.pandas_udf("array<bigint>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block.value, error_rate)
        for batch in batches:
            yield pd.Series([matcher.matches(x) for x in batch], dtype=object)

    return find


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "bench_items", item_id: str = "item_id", item_text: str = "text",
    error_rate: float = ERROR_RATE, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with ``out``: the benchmark items that each document holds; a clean document has an empty list.

    An item of n words may be copied with e = floor(n x error_rate) word edits. Of any split into e + 1 pieces one
    then stands in the copy unchanged: an automaton finds such pieces in the whole text, and Myers' bit-parallel
    distance of the item to the words around a hit decides. Case, punctuation and white space don't count.

    A benchmark of up to ``block_items`` items and ``block_chars`` characters is broadcast; a larger one is cut into
    blocks of about that size by hash, each of which takes a pass over the documents and leaves a table of the texts (by digest)
    that hold some of it, so neither the driver nor a worker ever holds more than one block, and documents are shuffled once. Null and empty texts hold nothing, very long ones
    are searched whole; null or wordless items match nothing; items with equal texts are all reported; repeated rows
    get equal answers; empty tables are allowed on either side; an extra column named ``out`` is replaced.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    bound_batches(docs.sparkSession)
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    broadcast = lambda rows: docs.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in rows.collect()])
    if blocks == 1:
        return docs.withColumn(out, _finder(broadcast(items), error_rate)(F.col(text)))
    hits = []
    for k in range(blocks):
        block = broadcast(items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k))
        found = docs.select(F.md5(text).alias("__text"), _finder(block, error_rate)(F.col(text)).alias("__held")).where(F.size("__held") > 0)
        hits.append(materialize(found.groupBy("__text").agg(F.first("__held").alias("__held"))))
        block.destroy()
    held = reduce(DataFrame.unionByName, hits).groupBy("__text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__held")))).alias("__held"))
    kept = [docs[c] for c in docs.columns if c != out]
    joined = docs.join(held, F.md5(docs[text]) == held["__text"], "left")
    return joined.select(*kept, F.coalesce(held["__held"], F.array().cast("array<bigint>")).alias(out))
