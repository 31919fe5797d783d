"""Operator 4: quality classifier by nearest-neighbour voting among latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import Scratch, bound_batches

BITS, RANK, NEIGHBOURS = 11, 48, 15
#: Labelled documents whose vectors are broadcast, at most about (a hash picks them): 2500 x 48 numbers.
TRAIN_ROWS = 2_500
#: Documents whose cosines are computed in one block, and code points that are counted at once.
BLOCK, CHUNK = 128, 1 << 20
#: Decimals of a cosine that count when neighbours are ranked.
DECIMALS = 9
#: Weights of the two parts of a vector: letter-class trigrams, character trigrams.
PARTS = (1.0, 0.6)
_SIZE = 1 << BITS
WIDTH = 2 * _SIZE
#: What stands for a character of each general category in letter-class trigrams; others stand for themselves.
_CLASS = {"Ll": "a", "Lu": "A", "Lt": "A", "Lm": "a", "Lo": "o", "Nd": "0", "Nl": "0", "No": "0", "Mn": "m", "Mc": "m"}


@cache
def _class_table() -> np.ndarray:
    """The class of each code point of the basic plane."""
    return np.array([ord(_CLASS.get(category(chr(c)), chr(c))) for c in range(1 << 16)], np.uint32)


def _classes(chars: np.ndarray) -> np.ndarray:
    """Letters of any script as a, A or o (scripts without case), digits as 0; the rest stands for itself."""
    basic = chars < 1 << 16
    return np.where(basic, _class_table()[np.where(basic, chars, 0)], chars)


def _trigrams(c: np.ndarray) -> np.ndarray:
    if c.size < 3:
        c = np.concatenate([c, np.full(3 - c.size, 32, np.uint32)])
    h = ((c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA77) + c[2:]) * np.uint32(0xC2B2AE3D)
    return np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), minlength=_SIZE)


def features(text: str | None) -> np.ndarray:
    """Counts over a whole text: hashed letter-class trigrams, then character trigrams."""
    out = np.zeros(WIDTH, np.float32)
    if not text or text.isspace():
        return out
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, max(chars.size - 2, 1), CHUNK):
        c = chars[start : start + CHUNK + 2]  # trigrams that begin in this chunk
        out[:_SIZE] += _trigrams(_classes(c))
        out[_SIZE:] += _trigrams(c)
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # (WIDTH, rank)
    vectors: np.ndarray  # labelled documents, unit rows
    labels: np.ndarray

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = weighted(x, self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(texts) if k else 0, BLOCK):
            x = np.array([features(t) for t in texts[start : start + BLOCK]])
            cos = np.round(self.embed(x) @ self.vectors.T, DECIMALS)
            near = nearest(cos, k)
            w = (np.maximum(cos, 0.0) ** 8 + 1e-9) * near
            out[start : start + BLOCK] = np.where(x.any(1), (w @ self.labels) / w.sum(1), 0.0)
        return np.clip(out, 0.0, 1.0)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Which columns of each row are its ``k`` largest; of equal ones the first."""
    least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
    above, equal = cos > least, cos == least
    return above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows: root frequencies times idf, each of the two parts scaled to its own length."""
    out = np.sqrt(x, dtype=np.float64) * idf
    for part, (a, b) in zip(PARTS, ((0, _SIZE), (_SIZE, WIDTH)), strict=True):
        out[:, a:b] *= part / np.maximum(np.linalg.norm(out[:, a:b], axis=1, keepdims=True), 1e-12)
    return out


def latent_basis(x: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors by randomised range finding with two power steps."""
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], min(rank + 8, *x.shape)))
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank]


def fit_sample(sample: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Basis and labelled vectors from rows (label, key, places, counts), in any order; vectors stand in order of key."""
    sample = sorted(sample, key=lambda r: (r[1], r[0], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    x = np.zeros((len(sample), WIDTH), np.float32)
    for i, (_, _, at, n) in enumerate(sample):
        x[i, at] = n
    x = weighted(x, idf)
    basis = latent_basis(x)
    v = x @ basis
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return Model(idf, basis, v, np.array([r[0] for r in sample], float))


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on documents with a label for which ``learn`` holds.

    Document frequencies count all documents of ``docs``, in one pass that also takes the counts of about
    ``train_rows`` labelled documents, picked by a hash of ``key``. Several labels of a key count as their mean,
    rounded. Labels or keys that are null don't count, nor do texts that are null, empty or blank. The bounded sample is
    fitted in one task (``train_rows`` x ``WIDTH`` numbers); the driver gets basis and vectors.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & learn)
    n = known.count()
    cut = int(1e9 * min(1.0, train_rows / max(n, 1)))
    known = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(4)), F.lit(1_000_000_000)) < F.lit(cut))
    known = known.groupBy(F.col(key).alias("k")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    shared = spark.sparkContext.broadcast({r.k: r.label for r in known.limit(2 * train_rows).collect()})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(WIDTH, np.int64)
        n = 0
        for batch in batches:
            out = []
            for k, text in zip(batch["k"], batch["text"], strict=True):
                x = features(text)
                df += x > 0
                n += bool(x.any())
                if not pd.isna(k) and int(k) in shared.value and x.any():
                    at = np.flatnonzero(x)
                    out.append((shared.value[int(k)], int(k), at.astype(np.int32), x[at].astype(np.int64)))
            if out:
                yield pd.DataFrame(out, columns=["label", "k", "at", "n"])
        if n:
            at = np.flatnonzero(df)
            yield pd.DataFrame([(None, None, np.append(at, -1).astype(np.int32), np.append(df[at], n))], columns=["label", "k", "at", "n"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    with Scratch(spark) as tmp:
        got = tmp.write(rows.mapInPandas(count, "label int, k bigint, at array<int>, n array<bigint>"))
        shared.destroy()
        sums = got.where("label is null").select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n"))
        df, total = np.zeros(WIDTH), 0
        for r in sums.collect():  # one row for each place at most
            if r["at"] < 0:
                total = r["n"]
            else:
                df[r["at"]] = r["n"]
        idf = np.log((1 + total) / (1 + df)) + 1

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sample = [(int(r.label), int(r.k), r.at, r.n) for batch in batches for r in batch.itertuples(index=False)]
            if sample:
                model = fit_sample(sample, idf)
                yield pd.DataFrame({"part": "basis", "i": range(WIDTH), "v": list(model.basis), "label": 0.0})
                yield pd.DataFrame({"part": "vector", "i": range(len(sample)), "v": list(model.vectors), "label": model.labels})

        sample = got.where("label is not null").limit(2 * train_rows)
        fitted = sample.coalesce(1).mapInPandas(fit, "part string, i int, v array<double>, label double").toArrow()
    if not fitted.num_rows:
        return Model(idf, np.zeros((WIDTH, 1)), np.zeros((0, 1)), np.zeros(0))
    fitted = fitted.to_pandas()
    basis, vectors = (fitted[fitted["part"] == x].sort_values("i") for x in ("basis", "vector"))
    return Model(idf, np.vstack(basis["v"].to_numpy()), np.vstack(vectors["v"].to_numpy()), vectors["label"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with ``out``: the similarity-weighted share of label 1 among the nearest labelled documents (0 to 1).

    Exact cosines to every labelled vector, in blocks of documents. Null, empty and blank texts score 0, as does
    everything if no document is labelled. Neighbours rank by cosine, rounded to ``DECIMALS`` places, then by key. Very
    long texts count in parts of ``CHUNK`` code points, whole. Repeated rows get equal answers; an empty table gives no
    rows; an extra column named ``out`` is replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.score(list(batch)))

    return docs.withColumn(out, vote(F.col(text)))
