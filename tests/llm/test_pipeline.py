"""Every stage of the corpus pipeline against a brute-force version on its own input, and the whole run."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid
from palimpsest.llm.shared import materialize

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of each stage over the documents with odd rows beside them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", None), (9002, "", "en", None, 0), (9003, "12 34 !", None, None, 7), (9004, "The words of that thing are here and there. " * 4000, "en", "src1", 0),
                                 (9005, "The words of that thing.", "en", "src2", 1), (9005, "The words of that thing.", "en", "src2", 1), (9005, "Other words for the same number, and more of them.", "en", "src2", 1), (None, "The words of nobody.", "en", None, 1)], docs.schema)
    docs, out = docs.unionByName(odd).withColumn("mix", F.lit("own")).withColumn("__kept", F.lit(1)), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF))
        out.append((name, before.toPandas(), docs.toPandas(), before))
    return {name: rest for name, *rest in out}


def keys(df):
    return sorted(str((i, t)) for i, t in zip(df.doc_id, df.text, strict=True))


def test_columns_stay(stages):
    for name, (before, after, _) in stages.items():
        assert list(after.columns) == list(before.columns) + (["mix_copy"] if name == "mixing" else []), name
        assert name == "mixing" or set(after.mix) == {"own"}


def test_language_id(spark, stages):
    before, after, frame = stages["language_id"]
    model = langid.train(frame, F.lit(True))
    kept = before[[lang != "und" and p >= corpus_pipeline.MIN_SCORE for lang, p in map(model.predict, before.text)]]
    assert keys(after) == keys(kept)
    gone = set(before.doc_id.dropna()) - set(after.doc_id.dropna())
    assert {9001, 9002, 9003} <= gone
    # documents of a known language and of some length are left alone
    clean = before[before.lang.notna() & (before.text.fillna("").str.split().str.len() >= 30)]
    assert len(set(clean.doc_id) & set(after.doc_id)) >= 0.99 * clean.doc_id.nunique()


def test_line_dedup(stages):
    before, after, _ = stages["line_dedup"]
    pages, seen = {}, {}
    for source, text in zip(before.source, before.text, strict=True):
        pages[source] = pages.get(source, 0) + 1
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            seen[source, line] = seen.get((source, line), 0) + 1
    drop = {k for k, n in seen.items() if n >= 5 and n > 0.08 * pages[k[0]]}
    want = ["\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop) for s, t in zip(before.source, before.text, strict=True)]
    assert keys(after) == keys(before.assign(text=want))
    assert all(n == len(t) for n, t in zip(after.n_chars, after.text, strict=True))


def bag(text):
    w = text.split()
    return pd.Series([" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))]).value_counts().to_dict() if w else {}


def test_near_dedup(stages):
    before, after, _ = stages["near_dedup"]
    rows = before[before.doc_id.notna()].drop_duplicates(["doc_id", "text"]).reset_index(drop=True)
    bags, root = [bag(t) for t in rows.text], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                both = sum(min(n, bags[j].get(k, 0)) for k, n in bags[i].items())
                if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                    root[find(i)] = find(j)
    kept = set(keys(after[after.doc_id.notna()]))
    classes = {}
    for i, r in rows.iterrows():
        classes.setdefault(find(i), []).append(str((r.doc_id, r.text)))
    assert all(len(kept & set(members)) == 1 for members in classes.values()) and len(kept) == len(classes)
    assert after.doc_id.isna().sum() == before.doc_id.isna().sum()
    assert (after.doc_id == 9005).sum() == 2


def test_decontamination(stages):
    before, after, _ = stages["decontamination"]
    bench = [re.sub(r"[\W_]+", " ", t.lower()).split() for t in pd.read_parquet(f"{SF}/benchmark.parquet").text.dropna()]

    def holds(text):
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        for p in filter(None, bench):
            row = [0] * (len(words) + 1)
            for i, w in enumerate(p, 1):
                new = [i]
                for j, x in enumerate(words, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
                row = new
            if min(row) <= int(0.15 * len(p)):
                return True
        return False

    short = before[before.text.str.len() < 3000]  # the plain table is slow
    assert keys(after[after.text.str.len() < 3000]) == keys(short[[not holds(t) for t in short.text]])


def test_mixing(stages):
    before, after, _ = stages["mixing"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    copies = after.groupby(["doc_id", "text"], dropna=False).mix_copy.agg(["size", "max"])
    assert (copies["size"] == copies["max"]).all() and copies["max"].max() <= 2
    assert set(keys(after)) <= set(keys(before))
    words = sum(map(size, before.text))
    assert sum(map(size, after.text)) <= 2 * words


def test_run_and_empty_tables(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_copy"] and 0 < out.count() < 1000
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
