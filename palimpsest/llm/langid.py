"""Operator 2: language identification by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import Scratch, bound_batches

BITS = 14
#: Labelled texts that the classifier is fitted and calibrated on, at most about (a hash picks them).
TRAIN_ROWS = 3_000
#: Code points that are counted at once, so that a very long text needs little memory.
CHUNK = 1 << 20
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of the 1-, 2- and 3-grams of the lower-cased whole text, hashed into 2**bits places."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for start in range(0, chars.size, CHUNK):
        n = min(CHUNK, chars.size - start)
        c = chars[start : start + n + 2]  # grams that begin in this chunk
        h = c * _MULT[0]
        one = h[:n]
        h2 = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULT[1] + c[1:]
        h2 *= _MULT[2]
        h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * _MULT[1] + c[2:]
        h3 *= _MULT[0]
        for x in (one, h2[:n], h3[:n]):
            total += np.bincount(x >> shift, minlength=1 << bits)
    return total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (2**bits, langs)
    bias: np.ndarray
    temperature: float = 1.0
    bits: int = BITS

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _unit(counts, self.idf[at]) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        counts = ngram_counts(text, self.bits)
        at = np.flatnonzero(counts)
        p = softmax(self.logits(at, counts[at]) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf
    return v / max(np.linalg.norm(v), 1e-12)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, alpha: float = 1.0, beta: float = 1.0,
    l1: float = 0.02, l2: float = 0.002, epochs: int = 3, seed: int = 11,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal) for softmax regression: ``rows`` are (places, values, class).

    Per-coordinate steps; ``l1`` and ``l2`` are the elastic net, ``l1`` keeping most weights at zero. The bias is the
    last coordinate, without penalty on its size but the same steps.
    """
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, size), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni, l1)
            w[-1] = weights(zi[-1], ni[-1], 0.0)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            root = np.sqrt(ni + g * g)
            z[at] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = weights(z, n, l1)
    return w[:-1], weights(z[-1], n[-1], 0.0)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on held-back rows (golden-section search on its log)."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit_sample(sample: list[tuple[str, int, np.ndarray, np.ndarray]], idf: np.ndarray, bits: int = BITS) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, weights, biases and temperature from rows (language, fold, places, counts), in any order.

    Fold 0 of five is held back for the temperature, the others fit the weights.
    """
    langs = sorted({r[0] for r in sample})
    index = {x: i for i, x in enumerate(langs)}
    sample = sorted(sample, key=lambda r: (r[0], r[1], len(r[2]), int(np.sum(r[3])), r[2].tobytes()))
    data = [(np.asarray(at, np.int32), _unit(np.asarray(n, float), idf[at]), index[lang], part) for lang, part, at, n in sample]
    w, bias = fit_ftrl([x[:3] for x in data if x[3]] or [x[:3] for x in data], 1 << bits, len(langs))
    held = [x for x in data if not x[3]]
    logits = np.array([v @ w[a] + bias for a, v, _, _ in held]).reshape(len(held), len(langs))
    return langs, w, bias, calibrate(logits, np.array([x[2] for x in held], int))


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """Fit on the rows of ``docs`` for which ``learn`` holds and text and language are not null.

    Document frequencies count all these rows, in one pass that also takes the n-gram counts of about ``train_rows``
    rows, picked by a hash of ``key``; four fifths of them fit the weights, one fifth the temperature. That bounded
    sample is fitted in one task (at most 2 x ``train_rows`` x 2**``bits`` places and counts, however long the texts);
    the driver sees document frequencies and weights, never texts or rows of the sample. Rows whose key is null fall
    into one hash and are learned from or not as one.
    """
    bound_batches(docs.sparkSession)
    base = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = base.count()
    if not n:
        return Model([], np.ones(1 << bits), np.zeros((1 << bits, 0)), np.zeros(0), bits=bits)
    cut = int(1e9 * min(1.0, train_rows / n))
    picked = F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(1_000_000_000)) < F.lit(cut)
    rows = base.select(F.col(text).alias("text"), F.when(picked, F.col(lang)).alias("lang"), F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(5)).alias("part"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(1 << bits, np.int64)
        for batch in batches:
            out = []
            for text, lang, part in zip(batch["text"], batch["lang"], batch["part"], strict=True):
                counts = ngram_counts(text, bits)
                at = np.flatnonzero(counts)
                df[at] += 1
                if lang is not None:
                    out.append((lang, part, at.astype(np.int32), counts[at]))
            if out:
                yield pd.DataFrame(out, columns=["lang", "part", "at", "n"])
        at = np.flatnonzero(df)
        if at.size:
            yield pd.DataFrame([(None, None, at.astype(np.int32), df[at])], columns=["lang", "part", "at", "n"])

    with Scratch(docs.sparkSession) as tmp:
        got = tmp.write(rows.mapInPandas(count, "lang string, part bigint, at array<int>, n array<int>"))
        df = np.zeros(1 << bits)
        sums = got.where("lang is null").select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n"))
        for r in sums.collect():  # one row for each of 2**bits places at most
            df[r["at"]] = r["n"]
        idf = np.log((1 + n) / (1 + df)) + 1

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sample = [(r.lang, r.part, r.at, r.n) for batch in batches for r in batch.itertuples(index=False)]
            if sample:
                langs, weights, bias, temperature = fit_sample(sample, idf, bits)
                places = [np.flatnonzero(weights[:, k]) for k in range(len(langs))]
                yield pd.DataFrame({
                    "lang": langs, "bias": bias, "temperature": temperature, "at": [p.astype(np.int32) for p in places],
                    "w": [weights[p, k] for k, p in enumerate(places)],
                })

        # one task holds the bounded sample; the driver gets the weights only
        sample = got.where("lang is not null").limit(2 * train_rows)
        fitted = sample.coalesce(1).mapInPandas(fit, "lang string, bias double, temperature double, at array<int>, w array<double>").collect()
    fitted.sort(key=lambda r: r.lang)
    w = np.zeros((1 << bits, len(fitted)))
    for k, r in enumerate(fitted):
        w[r["at"], k] = r["w"]
    return Model([r.lang for r in fitted], idf, w, np.array([r.bias for r in fitted]), fitted[0].temperature if fitted else 1.0, bits)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_id") -> DataFrame:
    """``docs`` with ``out``: (lang, score) of each whole text.

    Null texts, texts without a letter, and a model that saw no rows give ``und`` with score 0. Repeated rows get
    equal answers; an empty table gives no rows; an extra column named ``out`` is replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([shared.value.predict(x) for x in batch], columns=["lang", "score"])

    return docs.withColumn(out, predict(F.col(text)))
