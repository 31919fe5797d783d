"""Operator 6: near-duplicate documents by BagMinHash signatures, banding and verified multiset overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import Scratch, bound_batches, components, materialize, mix64, pieces, shingle_hashes, word_hashes

WIDTH, SIMILARITY = 5, 0.8
#: 24 bands of 6 registers: a pair of similarity 0.8 shares a band with probability 0.9993.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Members of a bucket that one not linked with the bucket's lead is verified against first.
PIVOTS = 4
#: Buckets of so many members are paired by a join; larger ones are compared in blocks of so many by their sketches.
SMALL_BUCKET, BLOCK = 16, 128
#: Names of texts of a repeated doc_id beside its first one start here.
OWN_NAMES = 1 << 62
#: Classes of shingles that a sketch counts.
CLASSES = 256
_G = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def _exp(h: np.ndarray) -> np.ndarray:
    """Unit exponential numbers from hashes."""
    return -np.log(((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of weighted sets (element hashes, whole weights): one row of ``registers`` floats each; inf if empty.

    Weights lie on the levels 0, 1, 2, ... For each element a Poisson process of rate 1 runs over every unit of
    weight, and each point falls on one register, which keeps its least point. Two bags agree on a register with
    probability equal to their weighted Jaccard similarity. The units are not walked one by one: the blocks [0, 1),
    [1, 2), [2, 4), [4, 8), ... each start with the first point of their summed process, and a block is halved (its
    first point goes to one half by a coin, the other half draws its own) only while that point is below the largest
    register and the half begins below the element's weight.
    """
    out = np.full((len(bags), registers), np.inf)
    sizes = np.array([len(e) for e, _ in bags])
    # few elements need many points each to fill the registers, many elements few
    for low, high, burst in ((1, 16, 96), (16, 128, 16), (128, 1 << 62, 3)):
        ids = np.flatnonzero((sizes >= low) & (sizes < high))
        if ids.size:
            out[ids] = _run([bags[i] for i in ids], registers, burst)
    return out


def _run(bags: list[tuple[np.ndarray, np.ndarray]], registers: int, burst: int) -> np.ndarray:
    doc = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    element = np.concatenate([e for e, _ in bags])
    weight = np.concatenate([w for _, w in bags]).astype(np.int64)
    procs = []
    with np.errstate(over="ignore"):
        for j in range(int(weight.max()).bit_length() + 1):
            lo, width = (0, 1) if j == 0 else (1 << (j - 1), 1 << (j - 1))
            on = weight > lo
            if not on.any():
                break
            seed = mix64(element[on] + np.uint64(j + 1) * _G)
            n = int(on.sum())
            procs.append((doc[on], seed, np.full(n, lo), np.full(n, width), weight[on], _exp(mix64(seed ^ _G)) / width, np.zeros(n, np.int64)))
        doc, seed, lo, width, weight, x, step = (np.concatenate(c) for c in zip(*procs, strict=True))
        h = np.full((len(bags), registers), np.inf)
        flat = h.reshape(-1)
        while doc.size:
            wide = width > 1
            if wide.any():  # halve blocks until only units are left
                d, s, a, b, w, p = (v[wide] for v in (doc, seed, lo, width, weight, x))
                b = b >> 1
                left = (mix64(s + _LEFT) & np.uint64(1)).astype(bool)
                other = p + _exp(mix64(s + _RIGHT)) / b
                halves = [
                    (d, mix64(s ^ _LEFT), a, b, w, np.where(left, p, other), np.zeros(d.size, np.int64)),
                    (d, mix64(s ^ _RIGHT), a + b, b, w, np.where(left, other, p), np.zeros(d.size, np.int64)),
                ]
                units = [v[~wide] for v in (doc, seed, lo, width, weight, x, step)]
                doc, seed, lo, width, weight, x, step = (np.concatenate(c) for c in zip(units, *halves, strict=True))
            else:
                # the current point and the next ones of every unit, in order
                turn = (step[:, None] + np.arange(burst)).astype(np.uint64)
                draw = mix64(seed[:, None] + (turn + np.uint64(1)) * _G)
                points = np.empty((doc.size, burst + 1))
                points[:, 0] = x
                points[:, 1:] = _exp(mix64(draw ^ _RIGHT))
                points = np.add.accumulate(points, axis=1)
                np.minimum.at(flat, (doc[:, None] * registers + (draw % np.uint64(registers)).astype(np.int64)).ravel(), points[:, :burst].ravel())
                x, step = points[:, burst], step + burst
            keep = (x <= h.max(1)[doc]) & (lo < weight)
            doc, seed, lo, width, weight, x, step = (v[keep] for v in (doc, seed, lo, width, weight, x, step))
    return h


def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(words, WIDTH), return_counts=True)


def band_keys(h: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature, as signed numbers."""
    bits = h.view(np.uint64).reshape(len(h), BANDS, ROWS)
    key = np.zeros((len(h), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix64(key * np.uint64(31) + bits[:, :, i])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(int(a[1].sum() + b[1].sum()) - both, 1)


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tx, same, n, bands) of every row: hash of its text, digest of its words, number of shingles, band keys (empty if wordless)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            words = [word_hashes(t) if t else np.empty(0, np.uint64) for t in batch["text"]]
            bags = [bag(w) for w in words]
            keys = band_keys(signatures(bags))
            yield pd.DataFrame({
                "doc": batch["doc"].astype("Int64"), "tx": batch["tx"], "same": [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words],
                "n": [int(c.sum()) for _, c in bags], "bands": [k if len(b[0]) else k[:0] for k, b in zip(keys, bags, strict=True)],
            })

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("tx"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc bigint, tx bigint, same binary, n bigint, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose texts' bags overlap enough."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, held = None, None
        for ids, first, second in batches:
            out = []
            for i, x, y in zip(ids, first, second, strict=True):
                if i != last:  # pairs of one leader come together
                    last, held = i, bag(word_hashes(x))
                out.append(overlap(held, bag(word_hashes(y))) >= similarity)
            yield pd.Series(out)

    two = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    two = two.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    return two.where(near("a", "ta", "tb")).select("a", "b")


def sketch(b: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Number of shingles in each of ``CLASSES`` classes, by hash."""
    counts = np.bincount((b[0] % np.uint64(CLASSES)).astype(np.int64), weights=b[1], minlength=CLASSES)
    return np.minimum(counts, 65535).astype(np.uint16).tobytes()


def _possible(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members(band, h, rep, n, root, c, main, others) of one bucket and different roots that may overlap enough.

    Two bags share at most the sum of the smaller counts of each class, so no pair is lost. Only members outside the
    bucket's largest component (``main``) ask, and all members answer: ``others`` askers and c members are cut into
    blocks by hash, and each pair of blocks is one group; only the pairs that pass leave it.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.DataFrame({"doc": batch["doc"], "sketch": [sketch(bag(word_hashes(t))) for t in batch["text"]]})

    ids = members.select("rep").distinct()
    sketches = texts.join(ids, texts["doc"] == ids["rep"], "left_semi").select("doc", "text").mapInPandas(draw, "doc bigint, sketch binary")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    drawn = members.join(sketches, F.col("rep") == F.col("doc"))
    cells = lambda asks, i, j: (
        "band", "h", i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"), "rep", "n", "root", (F.col("root") == F.col("main")).alias("in_main"), "sketch")
    answer = drawn.select(*cells(False, every("others"), own("c")))
    ask = drawn.where("root <> main").select(*cells(True, own("others"), every("c")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group["asks"]], group[~group["asks"]]
        counts = [np.frombuffer(b"".join(g["sketch"]), np.uint16).reshape(-1, CLASSES) for g in (x, y)]
        xr, yr, xn, yn, xd, yd = (g[c].to_numpy() for c in ("root", "n", "rep") for g in (x, y))
        alone = y["in_main"].to_numpy()  # does not ask itself
        out = []
        for k in range(len(x)):
            most = np.minimum(counts[0][k], counts[1]).sum(1, dtype=np.int64)
            fits = (most * (1 + similarity) >= similarity * (xn[k] + yn) - 1e-6) | (np.maximum(xn[k], yn) > 65535)
            fits &= (xr[k] != yr) & (np.minimum(xn[k], yn) >= similarity * np.maximum(xn[k], yn)) & (alone | (xd[k] < yd))
            out += [(min(xd[k], d), max(xd[k], d)) for d in yd[fits]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    # dealt by pair of blocks: a bucket's own partitioning would put all of it into one task
    return ask.unionByName(answer).repartition("band", "h", "i", "j").groupBy("band", "h", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def _classes(docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """One row per row of ``docs``: (doc, tx, class_id, kept); see ``near_duplicates``."""
    bound_batches(docs.sparkSession)
    signed = materialize(sign(docs, key, text))
    # a doc_id with several texts: all but one are nodes under names of their own
    several = signed.where("doc is not null").groupBy("doc").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi")
    several = materialize(several.select(F.col("doc").alias("doc2"), "lo"))
    own_name = F.shiftright(F.xxhash64("doc", "same"), 2) + F.lit(OWN_NAMES + (OWN_NAMES >> 1))
    node = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("lo").isNull() | (F.col("lo") == F.col("same")), F.col("doc")).otherwise(own_name)
    named = signed.join(several, F.col("doc") == F.col("doc2"), "left").withColumn("node", node.cast("bigint")).drop("doc2", "lo")
    reps = named.where("n > 0 and node is not null").groupBy("same").agg(
        F.min(F.struct("node", "doc", "tx")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialize(reps.select("same", "first.*", "n", "bands").withColumnRenamed("node", "rep"))
    with Scratch(docs.sparkSession) as tmp:
        slots = reps.select("rep", "n", F.posexplode("bands").alias("band", "h"))
        sizes = slots.groupBy("band", "h").agg(F.count("*").alias("c")).where("c > 1")
        shared = tmp.write(slots.join(sizes.hint("merge"), ["band", "h"]))  # sorted at every size: a hot bucket can be split
        # a document that meets many others is close to most of them: the best one of each hash class is a pivot of its bucket
        score = shared.groupBy("rep").agg(F.sum("c").alias("score"))
        top = F.max(F.struct("score", (-F.col("rep")).alias("m"), "n"))
        pivots = shared.join(score, "rep").groupBy("band", "h", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("s")).agg(top.alias("top"))
        pivots = tmp.write(pivots)
        leads = pivots.groupBy("band", "h").agg(F.max("top").alias("top")).select("band", "h", (-F.col("top.m")).alias("lead"), F.col("top.n").alias("lead_n"))
        close = lambda m, n: F.least(m, n) >= F.lit(similarity) * F.greatest(m, n)
        stars = tmp.write(shared.join(leads, ["band", "h"]).select("band", "h", "rep", "n", "lead", "lead_n"))
        pairs = stars.where((F.col("rep") != F.col("lead")) & close(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
        ids = reps.select("rep", F.col("doc").alias("doc2"), F.col("tx").alias("tx2")).join(stars.select("rep").distinct(), "rep", "left_semi")
        texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("tx"), F.col(text).alias("text")).where("text is not null")
        texts = texts.join(ids.hint("merge"), (F.col("doc") == F.col("doc2")) & (F.col("tx") == F.col("tx2")))
        texts = tmp.write(texts.select(F.col("rep").alias("doc"), "text").dropDuplicates(["doc"]))
        links = tmp.write(_verified(pairs, texts, similarity))
        apart = stars.where("rep <> lead").join(links.select(F.col("a").alias("lead"), F.col("b").alias("rep")), ["lead", "rep"], "left_anti")
        others = pivots.select("band", "h", (-F.col("top.m")).alias("pivot"), F.col("top.n").alias("pivot_n"))
        pairs = apart.join(others, ["band", "h"]).where("pivot <> rep and pivot <> lead").where(close(F.col("n"), F.col("pivot_n")))
        pairs = pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        links = tmp.write(links.unionByName(_verified(pairs, texts, similarity)))
        roots = components(links)
        of = lambda c, out: roots.select(F.col("node").alias(c), F.col("root").alias(out))
        held = tmp.write(stars.join(of("rep", "root"), "rep", "left").select("band", "h", "rep", "n", F.coalesce("root", "rep").alias("root")))
        per_root = held.groupBy("band", "h", "root").agg(F.count("*").alias("k"))
        mixed = per_root.groupBy("band", "h").agg(F.count("*").alias("roots"), F.sum("k").alias("c"), F.max(F.struct("k", "root")).alias("m")).where("roots > 1")
        mixed = mixed.select("band", "h", "c", F.col("m.root").alias("main"), (F.col("c") - F.col("m.k")).alias("others"))
        held = tmp.write(held.join(mixed, ["band", "h"]))
        few = held.where(F.col("c") <= SMALL_BUCKET).select("band", "h", "rep", "n", "root")
        two = few.join(few.toDF("band", "h", "u", "un", "ur"), ["band", "h"]).where("root <> ur and rep < u").where(close(F.col("n"), F.col("un")))
        more = two.select(F.col("rep").alias("a"), F.col("u").alias("b")).unionByName(_possible(held.where(F.col("c") > SMALL_BUCKET), texts, similarity))
        more = tmp.write(_verified(more.distinct(), texts, similarity))
        roots = components(links.unionByName(more)) if not more.isEmpty() else roots
    of_same = reps.join(roots, reps["rep"] == roots["node"], "left").select("same", F.coalesce("root", "rep").alias("root"))
    out = named.select("doc", "tx", "same", "n", "node").join(of_same, "same", "left")
    cls = F.when((F.col("n") == 0) | F.col("node").isNull(), F.col("node")).otherwise(F.col("root"))
    return out.select("doc", "tx", cls.alias("class_id"), F.coalesce(F.col("node") == cls, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, kept).

    Two documents are linked if the weighted Jaccard similarity of their bags of five-word shingles is at least
    ``similarity`` (words: runs between ASCII white space; a shorter text is one shingle). ``class_id`` is the least
    doc_id reachable by links; ``kept`` marks it. Texts with the same words are one class from the start, so any
    number of copies costs one representative.

    Representatives that share a band are candidates. In a band's bucket each member is verified against the
    bucket's lead, the one that meets most others; those not linked with it are verified against ``PIVOTS`` further
    ones. Where a bucket still holds several components, members of different ones are compared, in large buckets by
    an upper bound of their overlap first (``_possible``), and what is left is verified. Members of one component need
    no further check, so no bucket is expanded into all pairs and no link between components is lost.

    Null, empty and blank texts have no shingles, link with nothing and are kept. Null doc_ids have a null class and
    are kept. Rows with equal doc_id and words count as one document. Other texts of a repeated doc_id are documents of
    their own: the one whose words have the least digest bears the doc_id, the others numbers of ``OWN_NAMES`` and more,
    and so does a class that has no other member. An empty table gives no rows; extra columns are ignored.
    """
    rows = _classes(docs, key, text, similarity)
    return rows.select(F.col("doc").alias("doc_id"), "class_id", "kept")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``; rows without doc_id all stay.

    Of rows that agree in doc_id and words one stays, the one with the least hash of its columns.
    """
    rows = materialize(_classes(docs, key, text, similarity).where("kept and doc is not null"))
    chosen = rows.groupBy("class_id").agg(F.min(F.struct("doc", "tx")).alias("k"), F.count("*").alias("n"))
    chosen = materialize(chosen.select(F.struct(F.col("k.doc").alias("doc"), F.col("k.tx").alias("tx"), (F.col("n") > 1).alias("again")).alias("__palimpsest_chosen")))
    some = docs.join(chosen, (F.col(key).cast("bigint") == F.col("__palimpsest_chosen.doc")) & (F.xxhash64(text) == F.col("__palimpsest_chosen.tx")))
    one = some.where(~F.col("__palimpsest_chosen.again")).drop("__palimpsest_chosen")
    if not chosen.where("__palimpsest_chosen.again").isEmpty():  # only rows of which there are several are sorted
        order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
        first = F.row_number().over(Window.partitionBy("__palimpsest_chosen").orderBy(order))
        one = one.unionByName(some.where("__palimpsest_chosen.again").withColumn("__palimpsest_n", first).where("__palimpsest_n = 1").drop("__palimpsest_n", "__palimpsest_chosen"))
    return one.unionByName(docs.where(F.col(key).isNull()))
