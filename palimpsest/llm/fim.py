"""Operator 12: fill-in-the-middle transformation by a scan for sparse events."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import bound_batches

#: Prefix, suffix and middle marks; a text that holds one of them stays as it is.
PRE, SUF, MID = "<P>", "<S>", "<M>"
SPACES = " \t\n\v\f\r"
_EVENT = np.dtype([("at", np.int64), ("mark", np.int64)])


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in SPACES:
        out.add_word(c, 0)
    for mark in (PRE, SUF, MID):
        out.add_word(mark, 1)
    out.make_automaton()
    return out


def units(text: str, automaton: ahocorasick.Automaton) -> tuple[np.ndarray, bool]:
    """Where the units of a text end, and whether it holds a mark.

    One pass of the automaton gives the places of white space and marks, nothing else of the text is looked at. A
    stretch between neighbouring white-space places is a word if it has any length; its unit, which takes in the white
    space before it, ends with it. White space at the end is a unit of its own.
    """
    events = np.fromiter(automaton.iter(text), _EVENT)
    spaces = events["at"][events["mark"] == 0]
    stops = np.append(spaces, len(text))
    gaps = np.diff(stops, prepend=-1) - 1
    ends = stops[gaps > 0]
    if spaces.size and spaces[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, bool(events["mark"].any())


def cut(text: str | None, draws: tuple[int, int, int, int], automaton: ahocorasick.Automaton, rate: int = 50, spm: int = 80) -> tuple[int, str, str, int | None, int | None]:
    """(units, form, output, prefix characters, middle characters) of one text; see ``transform``."""
    text = text or ""
    ends, marked = units(text, automaton)
    n = len(ends)
    if not text or marked or draws[2] % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", f"{SUF}{suffix}{PRE}{prefix}{MID}{middle}", a, b - a
    return n, "psm", f"{PRE}{prefix}{SUF}{suffix}{MID}{middle}", a, b - a


def draw(doc_id: Column, k: int, seed: int = 42) -> Column:
    """The k-th of eight numbers of 32 bits that a document draws, by its id alone; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "fim", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with ``out``: struct of n, form, output, prefix_chars and middle_chars.

    A text of n units (a word with the white space before it; white space at the end) is cut at two of its n + 1 unit
    borders, drawn by the document's id. ``rate`` of 100 texts become ``<S>suffix<P>prefix<M>middle`` (form ``spm``,
    ``spm`` of 100) or ``<P>prefix<S>suffix<M>middle`` (``psm``). The others, empty and null texts (as empty) and texts that hold
    a mark are ``plain``: output is the text, the counts of characters are null. Only borders of units are cut, so code points
    and words stay whole; ``restore`` gives the exact text back.

    A map over rows: nothing is shuffled. Long texts are cut whole, in memory in proportion to one text. Repeated rows
    get equal results, an empty table gives none, an extra column named ``out`` is replaced.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("n bigint, form string, output string, prefix_chars bigint, middle_chars bigint")
    def cuts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for texts, *draws in batches:
            rows = [cut(t, d, automaton, rate, spm) for t, d in zip(texts, zip(*draws, strict=True), strict=True)]
            frame = pd.DataFrame(rows, columns=["n", "form", "output", "prefix_chars", "middle_chars"])
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(out, cuts(F.col(text), *[draw(F.col(doc_id), k, seed) for k in range(4)]))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of: marks are found by their first places, as no text inside holds one."""
    def between(after: str, before: str) -> Column:
        start = F.locate(after, output) + len(after)
        return F.substring(output, start, F.locate(before, output) - start)

    middle = F.substring(output, F.locate(MID, output) + len(MID), F.length(output))
    return (
        F.when(form == "psm", F.concat(between(PRE, SUF), middle, between(SUF, MID)))
        .when(form == "spm", F.concat(between(PRE, MID), middle, between(SUF, PRE))).otherwise(output)
    )
