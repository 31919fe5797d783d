"""Operator 11: repair of the structure of conversations by least edits, over a DAG of tight arcs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from palimpsest.llm.shared import bound_batches, materialize

#: Rows and characters of one block of a conversation.
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20
#: Costs of the edits; what a truncated row adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
#: States between turns: at the start, behind a system turn, a user turn, an assistant turn. The first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT_USER, NEXT_ASSISTANT = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), ((USER, ASSISTANT),)
INSERTS = NEXT_USER + NEXT_ASSISTANT
Vector = tuple[int, int, int, int]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after damage: a twentieth of the rows is dropped, emptied, stripped of full stops, doubled or said by a user.

    Dropped rows stay as marks, so that no conversation is lost. Null roles and texts are one space, and count as one
    where a row's number is drawn.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20)).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("dropped"), F.explode(copies).alias("copy"),
    ).drop("copy")


# ---------------------------------------------------------------- the graph

@lru_cache(64)
def arcs(kind: str) -> dict[str, tuple[tuple[int, int, int], ...]]:
    """(from, to, cost) of each edit of a row, by letter in ASCII order. A row's kind is its role's initial, capital if truncated, or ``x`` if it must go."""
    out = {"D": tuple((q, q, DELETE) for q in range(4))}
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        keep = {"s": ((START, SYSTEM),), "u": NEXT_USER, "a": NEXT_ASSISTANT}.get(kind.lower(), ())
        out["K"] = tuple((q, r, more) for q, r in keep)
        out["R"] = tuple((q, r, REROLE + more) for q, r in INSERTS)
    return out


def inserted(cost: Vector, back: bool = False) -> Vector:
    """Least costs with any turns put in at this place; two are enough, as a third leads back."""
    out = list(cost)
    for _ in range(2):
        for q, r in INSERTS:
            q, r = (r, q) if back else (q, r)
            out[r] = min(out[r], out[q] + INSERT)
    return tuple(out)


def forward(cost: Vector, kind: str) -> Vector:
    """Least costs behind a row of the least costs before it."""
    before, out = inserted(cost), [FAR] * 4
    for moves in arcs(kind).values():
        for q, r, w in moves:
            out[r] = min(out[r], before[q] + w)
    return tuple(out)


def backward(cost: Vector, kind: str) -> Vector:
    """Least costs to the end from before a row, of those from behind it."""
    out = [FAR] * 4
    for moves in arcs(kind).values():
        for q, r, w in moves:
            out[q] = min(out[q], cost[r] + w)
    return inserted(tuple(out), back=True)


AT_START: Vector = (0, FAR, FAR, FAR)
AT_END: Vector = inserted(tuple(0 if q in ENDS else FAR for q in range(4)), back=True)


@lru_cache(1 << 14)
def onwards(kinds: str, cost: Vector) -> Vector:
    for k in kinds:
        cost = forward(cost, k)
    return cost


@lru_cache(1 << 14)
def backwards(kinds: str, cost: Vector) -> Vector:
    for k in reversed(kinds):
        cost = backward(cost, k)
    return cost


@lru_cache(1 << 14)
def walk(kinds: str, states: tuple[int, ...], before: Vector, behind: Vector, total: int, last: bool) -> tuple[str, tuple[int, ...]]:
    """Edit letters of a block, and the states behind it.

    ``before`` and ``behind`` are least costs from the start to the block and from its end to the conversation's end. An arc is
    tight if it lies on a way of the least total. The frontier of states takes, at each step, the least letter that a
    tight arc has, with all its arcs.
    """
    ahead = [inserted(before)]
    for k in kinds:
        ahead.append(inserted(forward(ahead[-1], k)))
    rest = [behind]
    for k in reversed(kinds):
        rest.append(backward(rest[-1], k))
    rest.reverse()
    letters, i, frontier = [], 0, set(states)
    while True:
        if i == len(kinds) and (not last or any(ahead[i][q] == total for q in frontier & {*ENDS})):
            return "".join(letters), tuple(sorted(frontier))
        moves = {"I": tuple((q, r, INSERT) for q, r in INSERTS)} | (arcs(kinds[i]) if i < len(kinds) else {})
        for letter in sorted(moves):
            j = i + (letter != "I")
            found = {r for q, r, w in moves[letter] if q in frontier and ahead[i][q] + w + rest[j][r] == total}
            if found:
                letters.append(letter)
                i, frontier = j, found
                break
        else:
            raise AssertionError("no tight arc")


def apply(letters: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired (role, text) rows of a block."""
    out, i = [], 0
    for letter in letters:
        if letter != "D":
            role = "assistant" if state == USER else "user"
            if letter == "K":
                role = roles[i]
            out.append((role, "" if letter == "I" else texts[i]))
            state = SYSTEM if letter == "K" and role[0] == "s" else ASSISTANT if state == USER else USER
        i += letter != "I"
    return out


# ---------------------------------------------------------------- streams of blocks

STATS = ("blank", "duplicate", "truncated", "illegal")
#: ``alone`` is the kind of a block's first row if its mark may have ended the task before; ``open`` says that a mark ends the block.
SMALL = "kinds string, alone string, open boolean, first string, last string, turns bigint, low bigint, high bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with what ``_blocks`` needs, and a mark before the first row of each role and text of a conversation."""
    letter = r"[^\x20\x09-\x0D]"
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.sha2("text", 256).alias("key"), F.lit(True).alias("row"), "text",
                       ~F.col("text").rlike(letter), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "dropped").toDF(
        "conv_id", "turn", "role", "key", "row", "text", "blank", "open", "dropped")
    first = F.when(~F.max(F.col("turn").isNull()), F.min("turn"))
    marks = rows.where("not dropped").groupBy("conv_id", "role", "key").agg(first.alias("turn"))
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("text", "blank", "open", "dropped")]
    return rows.unionByName(marks.select("conv_id", "turn", "role", "key", F.lit(False).alias("row"), *nothing))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows: roles and texts, and what the graph and the counts need of them."""
    task, n, now, seen, mark = TaskContext.get().partitionId() << 32, 0, None, None, None
    before = schema = None
    head = True  # no row of the task's first conversation has come, so its mark may be in the task before

    def close() -> pa.RecordBatch:
        now["open"] = mark is not None
        return pa.RecordBatch.from_pylist([now], schema)

    for batch in batches:
        schema = schema or pa.schema([
            pa.field("conv_id", batch.schema.field("conv_id").type), ("block", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
            ("kinds", pa.string()), ("alone", pa.string()), ("open", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
            *[(s, pa.int64()) for s in STATS],
        ])
        for x in batch.to_pylist():
            if now is None or x["conv_id"] != now["conv_id"] or len(now["roles"]) >= BLOCK_ROWS or size > BLOCK_CHARS:
                if now is not None:
                    yield close()
                if now is None or x["conv_id"] != now["conv_id"]:
                    before, mark, head = None, None, now is None
                now = {"conv_id": x["conv_id"], "block": task + n, "roles": [], "texts": [], "kinds": "", "alone": None, "first": None, "last": None, "turns": 0, "low": None, "high": None,} | dict.fromkeys(STATS, 0)
                n, size, seen = n + 1, 0, None
            same = (x["turn"], x["role"], x["key"])
            if not x["row"]:
                mark, head = same, False
                continue
            if x["dropped"]:
                continue
            first, mark = mark == same, None
            fault = "blank" if x["blank"] else "duplicate" if not first else "truncated" if x["open"] else None
            if fault:
                now[fault] += 1
            initial = x["role"][:1]
            kind = initial if initial in ("s", "u", "a") else "o"
            if head and fault == "duplicate":
                now["alone"] = kind.upper() if x["open"] else kind
            head = False
            now["kinds"] += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
            if now["first"] is None:
                now["first"] = initial
            elif before + initial not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["last"] = before = initial
            if x["turn"] is not None:
                if seen is None or x["turn"] != seen:
                    now["turns"] += 1
                if now["low"] is None:
                    now["low"] = x["turn"]
                seen = now["high"] = x["turn"]
            now["roles"].append(x["role"])
            now["texts"].append(x["text"])
            size += len(x["text"])
    if now is not None:
        yield close()


def _vectors(name: str, ahead: bool):  # noqa: ANN202
    """Adds to each block of a conversation the least costs before it (``ahead``) or behind it; one vector is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, cost, new = None, None, True
        for batch in batches:
            costs, ends = [], []
            for c, kinds in zip(batch["conv_id"].to_pylist(), batch["kinds"].to_pylist(), strict=True):
                ends.append(new or c != conv)
                if ends[-1]:
                    cost = AT_START if ahead else AT_END
                conv, new = c, False
                costs.append(list(cost))
                cost = onwards(kinds, cost) if ahead else backwards(kinds, cost)
            out = batch.append_column(name, pa.array(costs, pa.list_(pa.int64())))
            yield out if ahead else out.append_column("ends", pa.array(ends, pa.bool_()))

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations in order: a row whose mark ended an earlier task is no duplicate."""
    conv, was_open = None, False
    for batch in batches:
        rows = batch.to_pylist()
        for x in rows:
            was_open, conv = was_open and x["conv_id"] == conv, x["conv_id"]
            if was_open and x["alone"] is not None:
                x["kinds"] = x["alone"] + x["kinds"][1:]
                x["duplicate"] -= 1
                x["truncated"] += x["alone"].isupper()
            was_open = x["open"] or (was_open and not x["kinds"])
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def _sorted(blocks: DataFrame, *order: Column) -> DataFrame:
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str, list[tuple[str, str]]]]:
    """Each block with its letters and repaired rows, conversation by conversation; one block is held."""
    new, conv, states, total = True, None, (START,), 0
    for batch in batches:
        for x in batch.to_pylist():
            if x["kinds"] is not None:
                x["new"] = new or x["conv_id"] != conv
                if x["new"]:
                    conv, new, states = x["conv_id"], False, (START,)
                    total = backwards(x["kinds"], tuple(x["behind"]))[START]
                x["total"], info = total, x
                continue
            state = states[0]  # letters fix the states: no two ways with the same letters differ in theirs
            letters, states = walk(info["kinds"], states, tuple(info["before"]), tuple(info["behind"]), total, info["ends"])
            yield info, letters, apply(letters, state, x["roles"], x["texts"])


def _emit(schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, letters, rows in _repaired(batches):
            yield pa.RecordBatch.from_pylist([{"conv_id": x["conv_id"], "block": x["block"], "audit": letters, "turns": [{"role": r, "text": t} for r, t in rows]}], schema)

    return run


def _digest(schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def close() -> pa.RecordBatch:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            row = now | {"gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([{f.name: row[f.name] for f in schema}], schema)

        for x, letters, rows in _repaired(batches):
            if x["new"]:
                if now:
                    yield close()
                now = {"conv_id": x["conv_id"], "audit": [], "sha": hashlib.sha256(), "some": False, "turns": 0, "low": None, "high": None, "last": None, "cost": x["total"]} | dict.fromkeys(STATS, 0)
            for s in STATS:
                now[s] += x[s]
            if x["first"] is not None:
                now["illegal"] += now["last"] is not None and now["last"] + x["first"] not in ("su", "ua", "au")
                now["last"] = x["last"]
            if x["low"] is not None:
                now["turns"] += x["turns"] - (now["high"] == x["low"])
                now["low"], now["high"] = x["low"] if now["low"] is None else now["low"], x["high"]
            now["audit"].append(letters)
            for role, text in rows:
                now["sha"].update((("\n" if now["some"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                now["some"] = True
        if now:
            yield close()

    return run


def _stream(rows: DataFrame, run, result: str) -> DataFrame:  # noqa: ANN001
    """Blocks with their costs and texts, each conversation in order in one task, through ``run``."""
    bound_batches(rows.sparkSession)
    keyed = _keyed(rows)
    conv = keyed.schema["conv_id"]
    kind = lambda ddl: StructType([StructField("conv_id", conv.dataType), *StructType.fromDDL(ddl)])
    order = ("conv_id", "turn", "role", "key", "row")
    blocks = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, kind(f"block bigint, roles array<string>, texts array<string>, {SMALL}")))
    small = blocks.drop("roles", "texts")
    small = _sorted(small, F.asc("block")).mapInArrow(_paired, kind(f"block bigint, {SMALL}")).mapInArrow(_vectors("before", True), kind(f"block bigint, {SMALL}, before array<bigint>"))
    small = _sorted(small, F.desc("block")).mapInArrow(_vectors("behind", False), kind(f"block bigint, {SMALL}, before array<bigint>, behind array<bigint>, ends boolean"))
    both = small.unionByName(blocks.select("conv_id", "block", "roles", "texts"), allowMissingColumns=True)
    out = kind(result)
    schema = to_arrow_schema(out)
    return _sorted(both, F.asc("block"), F.col("kinds").isNull().asc()).mapInArrow(run(schema), out)


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations of rows (conv_id, turn, role, text, dropped) in blocks: (conv_id, block, audit, turns array of (role, text)).

    Rows go by turn (null first), then role and a digest of the text; blocks go by ``block``, and ``audit`` are the letters
    of a block's edits. A blank row and one whose role and text were there before must go; a truncated one (its last
    character that is not white space is none of ``.!?``) may stay at a price. The edits are Keep, Rerole, Delete and Insert (of an
    empty turn); behind them initials of roles read: perhaps a system turn, then turns of user and assistant, or
    nothing. Of the cheapest edits those with the least letters are taken. A role without characters cannot be kept; null
    roles and texts should be filled before (``damage`` does). Other columns are ignored, an empty table gives no rows,
    a conversation of nothing but dropped rows an empty block.

    A conversation may be of any length. Its blocks, cut from rows in order over all tasks, pass by three times: least costs from
    the start, least costs from the end, then the walk over tight arcs. One block and a few numbers are held each time.
    """
    return _stream(rows, _emit, "block bigint, audit string, turns array<struct<role: string, text: string>>")


def digests(rows: DataFrame) -> DataFrame:
    """One row a conversation: what was found, the cost and letters of its repair (see ``repair``), and a digest of the repaired text.

    ``gaps`` are turn numbers that lie between others and have no row; ``illegal`` counts neighbours whose initials are
    none of su, ua, au. The text is digested as it streams by; only the letters, one for each edit, are held.
    """
    return _stream(rows, _digest, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
