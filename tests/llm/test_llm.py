import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bagminhash, chatformat, decontaminate, embeddup, htmltext, langid, linededup, mixing, quality, queries, urlfilter
from tests.compare import connect, same

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n ", None, None), (3, "   \n ", None, None), (None, "some words here", None, None), (5, "word " * 60_000, "en", "a")]


# ---------------------------------------------------------------- 1

def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, w in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_decontamination_is_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 25)))) for i in range(15)]
    docs = []
    for d in range(60):
        words = items[d % 15][1].split()
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 1))
        docs.append((d, " ".join(rng.choices(vocab, k=20) + words + rng.choices(vocab, k=20)), None, None))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r.bench_items for r in decontaminate.decontaminate(frame(spark, docs), bench, block_items=4).collect()}
    for d, text, _, _ in docs:
        want = [i for i, t in items if edit_distance(t.split(), text.split()) <= int(0.15 * len(t.split()))]
        assert got[d] == want
    odd = decontaminate.decontaminate(frame(spark, ODD).withColumn("bench_items", F.lit(1)), bench)
    assert odd.count() == len(ODD) and odd.where(F.size("bench_items") > 0).count() == 0
    assert decontaminate.decontaminate(frame(spark, ODD), bench.limit(0)).where(F.size("bench_items") > 0).count() == 0
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


# ---------------------------------------------------------------- 2 and 4

def test_language_of_held_out_texts(spark):
    got = queries.op2_langid(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    model = langid.train(frame(spark, ODD), F.lit(True))
    rows = langid.identify(frame(spark, [*ODD, (9, "123 !", None, None)]).withColumn("lang_id", F.lit(1)), model).collect()
    und = [r for r in rows if r.lang_id.lang == "und"]
    assert len(rows) == 7 and {r.doc_id for r in und} == {1, 2, 3, 9} and all(r.lang_id.score == 0 for r in und)
    none = langid.train(frame(spark, []), F.lit(True))
    assert langid.identify(frame(spark, ODD), none).where("lang_id.lang <> 'und'").count() == 0


def test_quality_of_held_out_texts(spark):
    got = queries.op4_quality(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.train(frame(spark, ODD), labels, F.lit(True))
    assert [r.quality_score for r in quality.score(frame(spark, ODD), model).collect()] == [0.0] * len(ODD)


# ---------------------------------------------------------------- 3

def test_boilerplate_lines(spark):
    rows = [(i, f"menu\nown line {i}\n\n menu ", None, "a" if i % 2 else None) for i in range(40)]
    out = linededup.drop_boilerplate(frame(spark, rows)).collect()
    assert all(r.text == f"own line {r.doc_id}\n" and r.line_dedup.n_dropped == 2 for r in out)
    odd = linededup.drop_boilerplate(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) and {r.doc_id: r.text for r in odd}[1] is None
    assert linededup.drop_boilerplate(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 5

def test_html_regions():
    page = ("<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>Head &amp; more</h1><p>First  long\n paragraph of the article text.</p>"
            "<p>Second paragraph, also of some length.</p><div class='ad'>buy</div></article><footer>foot</footer></body></html>")
    assert htmltext.main_text(page) == "Head & more\nFirst long paragraph of the article text.\nSecond paragraph, also of some length."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p>") == ""


def test_html_keeps_all_content():
    par = lambda n, c: (c * 9 + " ") * (n // 10)
    tidy = lambda *x: "\n".join(y.strip() for y in x)
    quote = f"<h1>T</h1><p>{par(300, 'a')}</p><blockquote><p>{par(3000, 'b')}</p></blockquote><p>{par(300, 'c')}</p>"
    for around in ("article", "div", "main", "body"):
        assert htmltext.main_text(f"<{around}>{quote}</{around}>") == tidy("T", par(300, "a"), par(3000, "b"), par(300, "c"))
    assert htmltext.main_text(quote.replace("blockquote", "table")) == tidy("T", par(300, "a"), par(3000, "b"), par(300, "c"))
    rest = [par(300, chr(97 + i % 26)) for i in range(20)]
    skew = f"<div><p>{par(60_000, 'x')}</p></div><div>{''.join(f'<p>{x}</p>' for x in rest)}</div>"
    for around in ("article", "div", "body"):
        assert htmltext.main_text(f"<{around}>{skew}</{around}>") == tidy(par(60_000, "x"), *rest)
    # what is no content and stands outside stays away
    assert htmltext.main_text(f"<body><div>a b</div><article>{quote}</article></body>") == tidy("T", par(300, "a"), par(3000, "b"), par(300, "c"))


def test_html_goes_on_after_a_broken_declaration():
    for odd in ("<![foo[x]]>", "<![ endif]>", "<![endif]-->", "<![CDATA[x]]>", "<![if IE]>", "<!x>", "<!>", "<!doctype>", "<![", "<![ "):
        got = htmltext.main_text(f"<article><p>First paragraph.</p>{odd}<p>Second paragraph.</p></article>").split("\n")
        assert got[0] == "First paragraph." and got[-1] == "Second paragraph.", odd


# ---------------------------------------------------------------- 6

def bags(text):
    w = text.split()
    return pd.Series([" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))]).value_counts() if w else pd.Series(dtype=int)


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(3, 150))
        for _ in range(5):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 12])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    b = [bags(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = np.minimum(b[i], b[j].reindex(b[i].index).fillna(0)).sum()
            if both / (b[i].sum() + b[j].sum() - both) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(root))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(bagminhash, "BLOCK", 7)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 7)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    many = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(rows).collect()}
    b = [bags(t) for t in texts]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            both = np.minimum(b[i], b[j].reindex(b[i].index).fillna(0)).sum()
            if both / (b[i].sum() + b[j].sum() - both) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert many == dict(enumerate(root))


def test_near_duplicate_edge_cases(spark):
    got = bagminhash.near_duplicates(frame(spark, ODD).withColumn("kept", F.lit(1))).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got)
    assert bagminhash.keep_one(frame(spark, ODD)).count() == len(ODD) - 1
    assert bagminhash.near_duplicates(frame(spark, [])).count() == 0


def test_no_text_of_a_repeated_key_is_lost(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (1, two), (1, two), (2, two), (3, three), (3, None), (4, one + " "), (5, three), (None, one)]
    got = [(r.doc_id, r.text) for r in bagminhash.keep_one(frame(spark, [(i, t, None, None) for i, t in rows])).collect()]
    # each text without a near copy stays once, a null text and a null key stay
    assert sorted((t or "").split()[:1] for i, t in got if i is not None) == [[], ["a0"], ["b0"], ["c0"]]
    assert (3, None) in got and (None, one) in got and len(got) == 5 and set(got) <= set(rows)


# ---------------------------------------------------------------- 7

def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "␛1 ␛0 ␛", "<<SYS>><s>", "", None, "a\nb"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(said)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    blocks = chatformat.format_conversations(chatformat.rows_as_events(table))
    whole = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows)
    got = chatformat.digests(blocks).first()
    assert got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got.n_turns == len(said)
    assert "</s>" not in blocks.first().formatted


def test_event_folding(spark):
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, "assistant", "he"), (1, 3, "delta", 1, "assistant", "llo"),
           (1, 4, "message", 2, "user", "later"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "new"), (1, 7, "edit", 0, "user", "hey")]
    events = spark.createDataFrame(log, "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string")
    got = [(r.turn, r.text) for r in chatformat.fold_events(events).orderBy("turn").collect()]
    assert got == [(0, "hey")]
    assert [(r.turn, r.text) for r in chatformat.fold_events(events.where("seq < 7")).orderBy("turn").collect()] == [(0, "hi"), (1, "new")]


# ---------------------------------------------------------------- 8, 9, 10

def test_mixing_edge_cases(spark):
    out = mixing.mix(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(0 <= r.mix.copies <= 2 for r in out)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_vector_edge_cases(spark):
    v = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddup.link_vectors(spark.createDataFrame(v, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 10: (3, 1), **{i: (0, i) for i in (4, 5, 6, 7, 8, 9)}}


def test_probes_hold_no_array_of_batch_lists_and_dims():
    x = np.random.default_rng(5).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddup.Index.fit(x, 200, 0.98)
    tracemalloc.start()
    got = index.probes(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 200 * 64 * 8 / 10
    c = index.centroids
    for v, lists in zip(x[:300], got[:300], strict=True):
        d = ((v - c) ** 2).sum(1)
        own = d.argmin()
        near = d - d[own] <= index.reach * np.sqrt(((c - c[own]) ** 2).sum(1)) + 1e-9
        assert lists[0] == own and sorted(lists) == np.flatnonzero(near).tolist()


def test_url_rules(spark):
    urls = [(1, "http://a.example.com/en/x"), (2, "http://www.example.com/en/x"), (3, "HTTP://B.NET/fr/?q"), (4, None), (5, "no scheme"), (6, "http://notexample.com/en/")]
    df = spark.createDataFrame(urls, "page_id bigint, url string")
    host, _ = urlfilter.host_path(F.col("url"))
    got = {r.page_id: r for r in urlfilter.judge(df, df.select("url", urlfilter.word_label(host).alias("label")), queries.URL_RULES).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 6)] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/fr/", "block"), ("com/", "allow")]
    assert got[3].host == "b.net" and got[4].host == got[5].path == "" and got[4].rule is None
