"""Operator 7: chat formatting by event-sourced reconstruction (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer common chat templates; none survives unescaped inside a role or text. Fixed values.
CONTROLS = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
ESC = "␛"
#: Turns of one block of a conversation, by turn number: what one task renders and reads back at a time.
BLOCK = 256
KINDS = ("message", "delta", "edit", "regenerate")


def _sub(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    """ESC becomes ESC 0; a control string gets ESC 1 behind its first character. ``unescape`` undoes it exactly."""
    c = _sub(c, ESC, ESC + "0")
    for s in CONTROLS:
        c = _sub(c, s, f"{s[0]}{ESC}1{s[1:]}")
    return c


def escape_role(c: Column) -> Column:
    """As ``escape``; a line break, which ends the role in the template, becomes ESC 2."""
    return _sub(escape(c), "\n", ESC + "2")


def unescape(c: Column) -> Column:
    return _sub(_sub(_sub(c, ESC + "1", ""), ESC + "2", "\n"), ESC + "0", ESC)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, msg, role, text) of an event log (conv_id, seq, kind, turn, role, text).

    Kinds: ``message`` opens a message at its turn with its text; ``delta`` appends to the turn's latest message;
    ``edit`` replaces its text; ``regenerate`` empties it (its own text, if any, starts the new one). An edit or a
    regeneration also discards what was said before it at later turns. Events apply in order of ``seq``; ties go by
    kind (message first), role and text. A delta without message opens one. Null texts are empty; a null kind is a
    message, rows of any other kind are no events and go; null turns and null conversations are values of their own,
    sorted first. Repeated rows of kind message are messages of their own. Very long texts are folded whole. An empty
    log gives no rows; extra columns are ignored.

    No step needs one conversation in one task: later edits are looked up through minima of blocks of 4096 sequence
    numbers, and messages are folded per (conversation, turn).
    """
    kind = F.coalesce(F.lower("kind"), F.lit("message"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    ev = events.select("conv_id", "seq", kind.alias("kind"), order.alias("ord"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")).where("ord > 0")
    cut = F.when(F.col("kind").isin("edit", "regenerate"), F.col("turn"))
    ev = ev.withColumn("span", F.floor(F.col("seq") / 4096)).withColumn("cut", cut)
    cuts = ev.where("cut is not null").groupBy("conv_id", "span").agg(F.min("cut").alias("low"))
    ev = _after_cuts(ev, cuts)
    within = Window.partitionBy("conv_id", "turn").orderBy("seq", "ord", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("msg", F.sum((F.col("kind") == "message").cast("long")).over(within))
    got = ev.groupBy("conv_id", "turn", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", "ord", "role", "text"))).alias("e"))
    # position of the last event that sets the text, counted from the end
    back = F.array_position(F.transform(F.reverse("e"), lambda x: x["ord"] != 2), True)
    start = F.when(back > 0, F.size("e") - back + 1).otherwise(F.lit(1)).cast("int")
    text = F.array_join(F.transform(F.slice("e", start, F.size("e")), lambda x: x["text"]), "")
    role = F.coalesce(F.element_at("e", 1)["role"], F.lit(""))
    return got.select("conv_id", "turn", "msg", role.alias("role"), text.alias("text"))


def _after_cuts(ev: DataFrame, cuts: DataFrame) -> DataFrame:
    """Drop events that a later edit or regeneration at an earlier turn discards."""
    later_spans = Window.partitionBy("conv_id").orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    spans = ev.select("conv_id", "span").distinct()
    low = spans.join(cuts, spans["conv_id"].eqNullSafe(cuts["conv_id"]) & spans["span"].eqNullSafe(cuts["span"]), "left")
    low = low.select(spans["conv_id"], spans["span"], "low").withColumn("low", F.min("low").over(later_spans)).where("low is not null")
    low = low.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "low")
    # spans that hold a cut themselves are looked at event by event; the others need only the minimum of later spans
    own = cuts.select(F.col("conv_id").alias("c2"), F.col("span").alias("s2"), F.lit(True).alias("own"))
    ev = ev.join(low, ev["conv_id"].eqNullSafe(low["c"]) & ev["span"].eqNullSafe(low["s"]), "left")
    ev = ev.join(own, ev["conv_id"].eqNullSafe(own["c2"]) & ev["span"].eqNullSafe(own["s2"]), "left").drop("c", "s", "c2", "s2")
    later = Window.partitionBy("conv_id", "span").orderBy("seq", "ord", "role", "text").rowsBetween(1, Window.unboundedFollowing)
    quiet = ev.where("own is null").withColumn("near", F.lit(None).cast(ev.schema["turn"].dataType))
    busy = ev.where("own is not null").withColumn("near", F.min("cut").over(later))
    first = F.least("low", "near")
    return quiet.unionByName(busy).where(first.isNull() | F.col("turn").isNull() | (F.col("turn") <= first)).drop("low", "near", "own", "cut", "span")


def rows_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished rows (conv_id, turn, role, text) as a log with one ``message`` event a row."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text"
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Blocks of formatted conversations: (conv_id, block, n_turns, formatted, loss).

    A conversation is its blocks in order of ``block`` (``BLOCK`` turn numbers each), one after the other with
    nothing between. A turn is START role, line break, text, END, line break. ``loss`` has (start, length) in code
    points of the block for each text of ``loss_role``.
    """
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    one = messages.select(
        "conv_id", F.floor(F.col("turn") / BLOCK).cast("long").alias("block"), "turn", "msg",
        F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n")).alias("out"),
        (F.lit(len(START) + 1) + F.length(role)).cast("long").alias("head"), F.length(text).cast("long").alias("body"),
        (F.col("role") == loss_role).alias("loss"),
    ).withColumn("chars", F.col("head") + F.col("body") + F.lit(len(END) + 1))
    got = one.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("turn", "msg", "chars", "head", "body", "loss", "out"))).alias("t")
    )
    before = lambda i: F.aggregate(F.slice("t", F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x["chars"])
    spans = F.transform("t", lambda x, i: F.struct((before(i) + x["head"]).alias("start"), x["body"].alias("length"), x["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return got.select(
        "conv_id", "block", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"), spans.alias("loss"),
    )


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold an event log into final messages and render them: see ``fold_events`` and ``render``."""
    return render(fold_events(events), loss_role)


def read_back(blocks: DataFrame) -> DataFrame:
    """What the formatted blocks say: (conv_id, block, turns array of (role, text), loss array of texts), unescaped."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>")))

    def turn(x: Column) -> Column:
        at = F.locate("\n", x)
        body = F.substring(x, at + 1, F.length(x) - at - F.lit(len(END) + 1))
        return F.struct(unescape(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return blocks.select("conv_id", "block", F.length("formatted").cast("long").alias("chars"), F.transform(parts, turn).alias("turns"), loss.alias("loss"))


def digests(blocks: DataFrame) -> DataFrame:
    """One row a conversation, read back from its blocks: counts and sha-256 digests of turns and loss texts."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    per = read_back(blocks).select("conv_id", "block", "chars", F.size("turns").cast("long").alias("n"), said.alias("said"), F.array_join("loss", "").alias("loss"))
    got = per.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("block", "said", "loss"))).alias("b"),
    )
    said = F.array_join(F.transform("b", lambda x: x["said"]), "")
    loss = F.array_join(F.transform("b", lambda x: x["loss"]), "")
    return got.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
