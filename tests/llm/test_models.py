"""The fitted operators against plain loops and on held-out rows."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from palimpsest.llm import langid, quality, queries, urlfilter

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string"


# ---------------------------------------------------------------- language

def ftrl_by_loops(rows, size, classes, alpha, beta, l1, l2, epochs, seed):
    z = [[0.0] * classes for _ in range(size + 1)]
    n = [[0.0] * classes for _ in range(size + 1)]

    def weight(i, k):
        free = 0.0 if i == size else l1
        if abs(z[i][k]) <= free:
            return 0.0
        return -(z[i][k] - math.copysign(free, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            feats = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in feats for k in range(classes)}
            score = [sum(v * w[i, k] for i, v in feats) for k in range(classes)]
            e = [math.exp(s - max(score)) for s in score]
            for i, v in feats:
                for k in range(classes):
                    g = v * (e[k] / sum(e) - (k == y))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha
                    z[i][k] += g - sigma * w[i, k]
                    n[i][k] += g * g
    return np.array([[weight(i, k) for k in range(classes)] for i in range(size)]), np.array([weight(size, k) for k in range(classes)])


def test_ftrl_is_the_plain_loop():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4), int(rng.integers(3))) for _ in range(60)]
    w, bias = langid.fit_ftrl(rows, 12, 3, alpha=0.5, beta=1.0, l1=0.3, l2=0.05, epochs=2, seed=4)
    want, want_bias = ftrl_by_loops(rows, 12, 3, 0.5, 1.0, 0.3, 0.05, 2, 4)
    assert np.allclose(w, want) and np.allclose(bias, want_bias)
    assert (w == 0).any() and (w != 0).any()


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 400)
    logits = 6 * rng.normal(size=(400, 4)) + 9 * (np.arange(4) == y[:, None])

    def loss(t):
        s = logits / t
        return np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(400), y])

    got = langid.calibrate(logits, y)
    assert loss(got) <= min(loss(t) for t in np.geomspace(0.05, 19, 300)) + 1e-6
    assert langid.calibrate(np.zeros((0, 4)), np.zeros(0, int)) == 1.0


def test_ngrams_of_long_texts_are_counted_whole(monkeypatch):
    text = "".join(random.Random(3).choices("abcdeé ", k=5_000))
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert (langid.ngram_counts(text) == whole).all() and whole.sum() == 3 * 5_000 - 3


def test_language_scores_are_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, F.col("doc_id") % 3 != 0)
    for r in langid.identify(docs, model).select("text", "lang_id").collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert tuple(r.lang_id) == ("und", 0.0)
            continue
        counts = langid.ngram_counts(r.text)
        v = [(1 + math.log(c)) * model.idf[i] if c else 0.0 for i, c in enumerate(counts.tolist())]
        norm = math.sqrt(sum(x * x for x in v))
        logit = (np.array(v) / norm @ model.weights + model.bias) / model.temperature
        p = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        assert r.lang_id.lang == model.langs[int(p.argmax())] and abs(r.lang_id.score - p.max()) < 1e-9
    n = docs.where("doc_id % 3 <> 0 and text is not null and lang is not null").count()
    assert model.idf.max() <= np.log(1 + n) + 1 and model.idf.min() >= 1


# ---------------------------------------------------------------- quality

def test_neighbours_are_sorted_by_cosine_then_key():
    rng = np.random.default_rng(5)
    cos = np.round(rng.random((40, 30)), 1)  # many ties
    for k in (1, 7, 30):
        got = quality.nearest(cos, k)
        for row, picked in zip(cos, got, strict=True):
            assert sorted(np.flatnonzero(picked)) == sorted(sorted(range(30), key=lambda i: (-row[i], i))[:k])


def test_quality_votes_are_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    learned = labels.where("doc_id % 5 <> 0 and quality is not null").join(docs.where("trim(text) <> ''"), "doc_id").select("doc_id").distinct().count()
    assert len(model.labels) == learned
    seen = sum(1 for r in docs.collect() if r.text and not r.text.isspace())
    assert model.idf.max() <= np.log(1 + seen) + 1
    for r in quality.score(docs, model).collect():
        x = quality.features(r.text)
        if not x.any():
            assert r.quality_score == 0.0
            continue
        v = np.sqrt(x.astype(float)) * model.idf
        half = len(v) // 2
        v = np.concatenate([v[:half] / np.linalg.norm(v[:half]), 0.6 * v[half:] / np.linalg.norm(v[half:])]) @ model.basis
        v /= np.linalg.norm(v)
        cos = [round(float(v @ y), quality.DECIMALS) for y in model.vectors]
        near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[: quality.NEIGHBOURS]
        weight = [max(cos[i], 0.0) ** 8 + 1e-9 for i in near]
        vote = sum(w * model.labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight)
        assert abs(r.quality_score - vote) < 1e-6


def test_quality_edge_cases(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "some words here"), (5, "word " * 60_000), (6, "Some other words."), (6, "Some other words."), (7, "語 と 字 。")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("quality_score", F.lit("x"))
    labels = spark.createDataFrame([(5, 0), (6, 1), (6, 1), (7, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, F.lit(True))
    assert model.labels.tolist() == [0.0, 1.0, 1.0]
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "quality_score"]
    score = {(r.doc_id, r.text): r.quality_score for r in got.collect()}
    assert len(score) == 7 and all(score[k] == 0.0 for k in ((1, None), (2, ""), (3, " \n"))) and all(0 <= x <= 1 for x in score.values())
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs, quality.train(docs.limit(0), labels, F.lit(True))).where("quality_score <> 0").count() == 0
    whole = quality.features("word. Other " * 500)
    monkeypatch.setattr(quality, "CHUNK", 50)
    assert (quality.features("word. Other " * 500) == whole).all()


# ---------------------------------------------------------------- urls

def test_trees_on_hosts_that_they_never_saw(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, _ = urlfilter.host_path(F.col("url"))
    rows = pages.withColumn("label", urlfilter.word_label(host)).withColumn("part", F.pmod(F.crc32(host), F.lit(4)))
    got = pd.concat([urlfilter.judge(rows.where(F.col("part") == k), rows.where(F.col("part") != k), []).select("label", "verdict").toPandas() for k in range(4)])
    blocked = got.verdict == "block"
    assert len(got) == pages.count() and got.label.sum() > 50
    assert ((got.label == 1) == blocked).mean() > 0.95
    assert blocked[got.label == 1].mean() > 0.8 and blocked[got.label == 0].mean() < 0.02


URL = "page_id bigint, url string"


def test_rules_by_join_are_rules_by_expression(spark, monkeypatch):
    rng = random.Random(6)
    hosts = ["com", "net", "a.com", "b.a.com", "x.net", "", "a.b.c.d.net"]
    paths = ["", "a", "a/", "a/b", "b/c/d", "ab"]
    rules = [(rng.choice(["allow", "block"]), r) for r in {f"{rng.choice(hosts)}/{rng.choice(paths)}" for _ in range(60)}]
    rules += [({"allow": "block", "block": "allow"}[v], r) for v, r in rng.sample(rules, 15)]  # listed twice, the last counts
    urls = [(i, f"http://{rng.choice(['', 'w.', 'b.'])}{rng.choice(hosts)}{rng.choice(['', '/'])}{rng.choice(paths)}?q") for i in range(300)] + [(999, None), (1000, "no scheme")]
    df = spark.createDataFrame(urls, URL)
    none = df.where("false").withColumn("label", F.lit(1.0))
    key = lambda r: (r.page_id, r.host, r.path, r.rule, r.verdict)
    one = sorted(map(key, urlfilter.judge(df, none, rules).collect()))
    monkeypatch.setattr(urlfilter, "MAX_RULES", 3)
    assert sorted(map(key, urlfilter.judge(df, none, rules).collect())) == one
    for _, h, p, rule, verdict in one:
        fits = [(len(r), r, i, v) for i, (v, r) in enumerate(rules) if (h == r.partition("/")[0] or h.endswith("." + r.partition("/")[0])) and p.startswith("/" + r.partition("/")[2])]
        assert (rule, verdict) == ((max(fits)[1], max(fits)[3]) if fits else (None, "allow"))


def test_url_query_is_brute_force_but_for_the_trees(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = queries.op10_urlfilter(spark, SF).toPandas().set_index("page_id")
    assert sorted(got.index) == sorted(pages.page_id)
    for i, url in zip(pages.page_id, pages.url, strict=True):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            ends = [rest.index(c) for c in "/?#" if c in rest]
            host = rest[: min(ends, default=len(rest))].lower()
            path = rest[len(host):].split("?")[0].split("#")[0]
        r = got.loc[i]
        assert (r.host, r.path) == (host, path)
        fits = [(len(x), x, v) for v, x in queries.URL_RULES if (host == x.partition("/")[0] or host.endswith("." + x.partition("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        assert (r["rule"], r.verdict) == max(fits)[1:] if fits else r["rule"] is None and r.verdict == ("block" if r.block_score >= 0.5 else "allow")


def test_url_edge_cases(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "x"), (4, "http://a.com/" + "y" * 200_000), (5, "http://b.org/1"), (5, "http://b.org/1"), (None, "http://ads.net/2?a=1&b=2")]
    df = spark.createDataFrame(rows, URL).withColumn("host", F.lit(7)).withColumn("entropy", F.lit("own")).withColumn("label", F.lit("own"))
    for labels, want in (([], 0.0), ([("http://a.com/", 1.0)], 1.0), ([("http://a.com/", 0.0), ("http://b.com/", None)], 0.0)):
        known = spark.createDataFrame(labels, "url string, label double")
        got = urlfilter.judge(df, known, []).collect()
        assert len(got) == 7 and all(r.block_score == want and r.entropy == r.label == "own" for r in got)
    both = spark.createDataFrame([(f"http://{'ads-' * (i % 2)}x{i}.com/{i}", float(i % 2)) for i in range(60)], "url string, label double")
    wide = {(r.page_id, r.url): r.block_score for r in urlfilter.judge(df, both, []).collect()}
    monkeypatch.setattr(urlfilter, "MAX_BROADCAST_SUFFIXES", 0)
    assert {(r.page_id, r.url): r.block_score for r in urlfilter.judge(df, both, []).collect()} == wide
    assert urlfilter.judge(df.limit(0), both, queries.URL_RULES).count() == 0
