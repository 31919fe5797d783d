"""Table functions for SQL, after ``register(spark)``: ``chunks`` and ``snippets`` of a text, and ``fact_lines`` of a partitioned table.

``SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 300) c``;
``SELECT * FROM fact_lines(TABLE(f) PARTITION BY subject_id, predicate ORDER BY start)``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from palimpsest.functions.text import pack


@udtf(returnType="position int, chunk string")
class Chunks:
    """Chunks of a text of at most about so many tokens; a null text has none."""

    def eval(self, text: str, tokens: int) -> Iterator[tuple]:
        yield from enumerate(pack(text, tokens))


_ITEM = re.compile(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+")


@udtf(returnType="position int, snippet string")
class Snippets:
    """A reply as snippets of at most so many characters: one a paragraph, and one a list item where a paragraph is a list."""

    def eval(self, text: str, cap: int) -> Iterator[tuple]:
        blocks = re.split(r"\n\s*\n", (text or "").strip(" "))
        parts = (re.sub(r"\s+", " ", p).strip(" ")[:cap] for b in blocks for p in _ITEM.split(b))
        yield from enumerate(p for p in parts if p)


@udtf(returnType="subject_id bigint, predicate string, fact_id bigint, start bigint, stop bigint")
class FactLines:
    """Of facts of one key in order of their start, what holds when: the fact learnt last counts. Rows have subject_id, predicate, fact_id, start, stop and learnt in numbers; the open facts of a key are held."""

    def __init__(self) -> None:
        self.heap: list[tuple] = []
        self.key: tuple | None = None
        self.now = self.line = None

    def _to(self, end: float) -> Iterator[tuple]:
        while self.heap and self.now < end:
            learnt, fact, _, stop = self.heap[0]
            if stop <= self.now:
                heapq.heappop(self.heap)
                continue
            until = min(stop, end)
            if self.line and self.line[0] == -fact and self.line[2] == self.now:
                self.line = (-fact, self.line[1], until)
            else:
                yield from self._flush()
                self.line = (-fact, self.now, until)
            self.now = until
        self.now = end

    def _flush(self) -> Iterator[tuple]:
        if self.line:
            fact, start, stop = self.line
            yield (*self.key, fact, start, None if stop == float("inf") else stop)
        self.line = None

    def eval(self, row: Row) -> Iterator[tuple]:
        self.key = (row["subject_id"], row["predicate"])
        if self.now is None:
            self.now = row["start"]
        yield from self._to(row["start"])
        heapq.heappush(self.heap, (-row["learnt"], -row["fact_id"], len(self.heap), float("inf") if row["stop"] is None else row["stop"]))

    def terminate(self) -> Iterator[tuple]:
        if self.key is not None:
            yield from self._to(float("inf"))
            yield from self._flush()


def register(spark: SparkSession) -> None:
    for name, function in (("chunks", Chunks), ("snippets", Snippets), ("fact_lines", FactLines)):
        spark.udtf.register(name, function)
