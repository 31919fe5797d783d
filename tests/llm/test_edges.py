"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, and every branch beyond a bound."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bagminhash, chatformat, decontaminate, embeddup, htmltext, langid, linededup, mixing, shared

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string"
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n ", None, None), (3, "   \n ", None, None), (None, "some words here", None, None), (5, "word " * 60_000, "en", "a")]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- shared

def test_scratch_tables_go_and_others_stay(spark):
    import os
    with shared.Scratch(spark) as tmp:
        kept, gone = shared.materialize(spark.range(3)), tmp.write(spark.range(4))
        assert gone.count() == 4
        path = tmp.paths[0].removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_components_are_those_of_a_plain_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in shared.components(frame(spark, edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in edges)}
    assert shared.components(frame(spark, [], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- 1, 2

def test_benchmark_in_blocks_is_the_benchmark_whole(spark):
    items = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(9))) for i in range(40)] + [(None, "x y"), (99, None), (98, "  ")]
    bench = frame(spark, items, "item_id bigint, text string")
    docs = frame(spark, [(d, f"before {items[d][1]} after", None, None) for d in range(40)] + ODD)
    one = {(r.doc_id, r.text): r.bench_items for r in decontaminate.decontaminate(docs, bench).collect()}
    many = {(r.doc_id, r.text): r.bench_items for r in decontaminate.decontaminate(docs, bench, block_chars=400).collect()}
    clash = decontaminate.decontaminate(docs.selectExpr("*", "text AS __text", "doc_id AS __held"), bench, block_chars=400)
    assert clash.columns == [*docs.columns, "__text", "__held", "bench_items"] and clash.count() == docs.count()
    assert one == many and all(d in one[d, f"before {items[d][1]} after"] for d in range(40))


def test_long_texts_are_read_whole(spark):
    tail = frame(spark, [(1, "x " * 200_000 + "eins zwei drei", None, None)])
    bench = frame(spark, [(7, "eins zwei drei")], "item_id bigint, text string")
    assert decontaminate.decontaminate(tail, bench).first().bench_items == [7]
    model = langid.train(frame(spark, [(2 * i + k, t, lang, None) for i in range(20) for k, (t, lang) in enumerate((("the words of that thing", "en"), ("die Wörter von diesem Ding", "de")))]), F.lit(True))
    rows = frame(spark, [(1, "die Wörter von diesem Ding " * 60_000, None, None), (2, "the words of that thing", None, None)])
    assert [r.lang_id.lang for r in langid.identify(rows, model).orderBy("doc_id").collect()] == ["de", "en"]


# ---------------------------------------------------------------- 3

def test_line_dedup_beyond_the_broadcast_bound_and_clashes(spark, monkeypatch):
    rows = frame(spark, [(i, f"menu\nown {i}\n\n{'x' * (i % 3)}", None, f"h{i % 2}") for i in range(60)]).withColumn("line_dedup", F.lit("own")).withColumn("drop", F.lit("d"))
    small = sorted((r.doc_id, r.text, r.drop) for r in linededup.drop_boilerplate(rows).collect())
    monkeypatch.setattr(linededup, "MAX_BROADCAST_HASHES", 0)
    assert sorted((r.doc_id, r.text, r.drop) for r in linededup.drop_boilerplate(rows).collect()) == small
    assert linededup.drop_boilerplate(rows, out="other").first().line_dedup == "own"
    long = frame(spark, [(i, f"menu\n{i}" + "y" * 300_000, None, "a") for i in range(6)])
    assert all(r.text == f"{r.doc_id}" + "y" * 300_000 for r in linededup.drop_boilerplate(long).collect())


# ---------------------------------------------------------------- 5

def test_pages_as_a_table(spark):
    rows = [(1, None), (2, ""), (3, "<p>one</p>"), (3, "<p>one</p>"), (None, "<article><p>two &lt; three</p></article>"), (5, "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "<p>" + "long " * 100_000 + "</p>")]
    pages = frame(spark, rows, "page_id bigint, html string").withColumn("text", F.lit("own"))
    got = sorted(((r.page_id or 0), r.text) for r in htmltext.extract(pages).collect())
    assert got == [(0, "two < three"), (1, ""), (2, ""), (3, "one"), (3, "one"), (5, "deep"), (6, ("long " * 100_000).strip())]
    assert htmltext.extract(pages.limit(0)).count() == 0


def tree_text(html):
    """The article of a page of the test tables, read by its tags with plain string functions."""
    import html as h
    import re
    body = re.search(r"(?s)<article>(.*)</article>", html)[1]
    body = re.sub(r"<br>", " ", body)
    blocks = re.split(r"</?(?:p|h1|h2|ul|li|div|article)\b[^>]*>", body)
    return "\n".join(t for b in blocks if (t := " ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split())))


def test_every_page_is_read_as_by_a_tree(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert got == {i: tree_text(h) if h else "" for i, h in zip(pages.page_id, pages.html, strict=True)}


def test_no_character_of_an_article_is_lost():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgé&<", k=rng.randint(1, 9)))
    import html as h
    for _ in range(150):
        blocks = [" ".join(word() for _ in range(rng.choice([1, 3, 30, 120]))) for _ in range(rng.randint(1, 15))]
        def tagged(b):
            e, inner = h.escape(b), rng.choice(["{}", "<b>{}</b>", "<i>{}</i>", "<math><mi>{}</mi></math>", "<a href=x>{}</a>"])
            tag = rng.choice(["p", "p", "p", "h2", "blockquote", "section", "li", "pre"])
            return f"<{tag}>{inner.format(e)}" + rng.choice([f"</{tag}>", f"</{tag}>", "" if tag in ("p", "li") else f"</{tag}>"])
        junk = rng.choice(["", "<!-- c -->", "<![foo bar]>", "</span>", "<script>var x = '<p>no</p>'</script>", "<!x>"])
        page = f"<html><body><nav><a>home</a></nav><article>{junk.join(map(tagged, blocks))}</article><footer>end</footer></body></html>"
        assert htmltext.main_text(page) == "\n".join(blocks), page


def test_clusters_choose_the_region_without_names():
    para = "Words of a paragraph that goes on for a while, as they do, and then on. " * 3
    menu = "".join(f"<li><a href=x>item {i}</a></li>" for i in range(12))
    story = f"<h1>Title</h1><p>{para}</p><p>Short.</p><p>{para}</p>"
    want = "\n".join(["Title", para.strip(), "Short.", para.strip()])
    for page in (f"<body><ul>{menu}</ul><div>{story}</div><ul>{menu}</ul></body>", f"<div><div><ul>{menu}</ul></div><div>{story}</div><div><ul>{menu}</ul></div></div>",
                 f"<table><tr><td>{menu}<td>{story}<td>{menu}</table>"):
        assert htmltext.main_text(page) == want, htmltext.main_text(page)


PROSE = "A paragraph of prose that goes on for a while, long enough to be taken for a part of the story."


@pytest.mark.parametrize("part, want", [
    ('<pre><span class="hljs-comment"># set x</span> y</pre>', ["# set x y"]), ('<section id="related-work"><h2>Related work</h2><p>' + PROSE + "</p></section>", ["Related work", PROSE]),
    ('<figure class="banner"><img><figcaption>cap</figcaption></figure>', ["cap"]), ('<p>see <span class="popup">the popup</span></p>', ["see the popup"]), ('<p class="social">Social words.</p>', ["Social words."]),
    ('<section class="social-history"><h3>Social history</h3><p>' + PROSE + "</p></section>", ["Social history", PROSE]), ('<div class="notice-board"><h4>The board</h4><p>' + PROSE + "</p></div>", ["The board", PROSE]),
    ('<div id="userComments"><h3>All</h3><p>' + PROSE + "</p></div>", []), ('<ol class="commentsList"><li>' + PROSE + "</li></ol>", []), ('<div class="ad">buy</div>', []), ('<p class="ad">buy</p>', []),
    ('<div class="cookieNotice">we use them</div>', []), ('<div class="related"><h3>Related</h3><ul><li><a>x</a></li></ul></div>', []), ('<div class="newsletter"><h3>Sign up</h3><p>' + PROSE + "</p></div>", []),
    ('<div class="popup">over <div class="related">inner</div></div>', []), ('<div class="popup">never closed', []),
])
def test_names_only_count_on_blocks_without_story(part, want):
    first, last = f"{PROSE} {PROSE}", f"{PROSE} End."
    page = f"<body><nav><a>home</a></nav><article><h1>T</h1><p>{first}</p>{part}<p>{last}</p></article><footer>f</footer></body>"
    got = htmltext.main_text(page).split("\n")
    assert got == ["T", first, *want, last] if "never" not in part else got == ["T", first]


def test_what_ends_or_heads_the_story_stays():
    page = f"<body><ul><li><a>m</a></li></ul><div><h1>T</h1><p>{PROSE * 9}</p><ul><li><a>one</a></li><li><a>two and more</a></li></ul><p>Closing words.</p></div><p>Imprint</p></body>"
    assert htmltext.main_text(page) == "\n".join(["T", PROSE * 9, "Closing words."])
    assert htmltext.main_text(f"<body><p>x</p><h1>Head</h1><article><p>{PROSE}</p></article></body>") == f"Head\n{PROSE}"
    assert htmltext.main_text(f"<body><h1>Site</h1><article><h2>Own</h2><p>{PROSE}</p></article></body>") == f"Own\n{PROSE}"


def test_html_time_is_linear():
    import time
    def took(n):
        began = time.perf_counter()
        htmltext.main_text("<div>" * n + "x" + "<b>" * n + "<hr>" * n + "</i>" * n)
        return time.perf_counter() - began
    took(500)
    assert took(16_000) < 40 * took(1_000) + 0.5


# ---------------------------------------------------------------- 6

def test_recall_on_documents(spark):
    """All against all: links found by comparing bags, and classes that hold them."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    bag, holds = {}, {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        if t and t.split():
            w = t.split()
            bag[i] = pd.Series([" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))]).value_counts().to_dict()
            for k in bag[i]:
                holds.setdefault(k, set()).add(i)
    cls = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    links = found = 0
    for i in bag:
        for j in set().union(*(holds[k] for k in bag[i])) - {i}:
            both = sum(min(n, bag[j].get(k, 0)) for k, n in bag[i].items())
            if both / (sum(bag[i].values()) + sum(bag[j].values()) - both) >= 0.8:
                links, found = links + 1, found + (cls[i] == cls[j])
    assert links > 20 and found == links


def test_texts_of_a_repeated_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, b), (4, c), (4, None), (None, a)]
    got = [tuple(r) for r in bagminhash.near_duplicates(frame(spark, [(i, t, None, None) for i, t in rows])).collect()]
    assert len(got) == len(rows)
    of = {}
    for (i, _), (d, k, kept) in zip(sorted(rows, key=str), sorted(got, key=str), strict=False):
        of.setdefault(d, set()).add(k)
    assert of[4] == {4} or all(k == 4 or k >= bagminhash.OWN_NAMES for k in of[4])
    assert of[None] == {None} and of[2] != of[3] and len(of[1]) == 2
    assert sorted(k for ks in of.values() for k in ks if k is not None) == sorted(k for ks in of.values() for k in ks if k is not None)
    again = [tuple(r) for r in bagminhash.near_duplicates(frame(spark, [(i, t, None, None) for i, t in reversed(rows)])).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)


# ---------------------------------------------------------------- 7

EVENTS = "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string"


def test_odd_events(spark):
    long = "word " * 60_000
    log = frame(spark, [(1, 0, "message", 0, "user", "hi"), (1, 1, "typing", 0, "user", "no event"), (1, 2, None, 1, "assistant", long), (None, 0, "message", 0, "user", "lost"), (None, 0, "message", 0, "user", "lost"),
                        (2, 0, "delta", 0, None, "alone"), (3, 0, "message", None, "user", None)], EVENTS).withColumn("msg", F.lit("own"))
    got = sorted(((r.conv_id or 0), (r.turn if r.turn is not None else -1), r.text) for r in chatformat.fold_events(log).collect())
    assert got == [(0, 0, "lost"), (0, 0, "lost"), (1, 0, "hi"), (1, 1, long), (2, 0, "alone"), (3, -1, "")]
    assert chatformat.digests(chatformat.format_conversations(log)).count() == 4
    assert chatformat.format_conversations(log.limit(0)).count() == 0


def test_folding_is_a_plain_loop(spark):
    rng = random.Random(9)
    log = [(c, s, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.randrange(5), "assistant", f"t{c}.{s} ") for c in range(6) for s in range(40)]
    want = {}
    for c, s, kind, turn, role, text in log:
        turns = want.setdefault(c, {})
        if kind in ("edit", "regenerate"):
            for t in [t for t in turns if t > turn]:
                del turns[t]
        said = turns.setdefault(turn, [])
        if kind == "message" or not said:
            said.append(text)
        else:
            said[-1] = said[-1] + text if kind == "delta" else text
    got = {}
    for r in chatformat.fold_events(frame(spark, log, EVENTS)).orderBy("conv_id", "turn", "msg").collect():
        got.setdefault(r.conv_id, {}).setdefault(r.turn, []).append(r.text)
    assert got == want


# ---------------------------------------------------------------- 8

def test_each_document_is_copied_with_the_fraction_of_its_rate(spark):
    n = 1500
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", int(rng.integers(mixing.STEPS)), size) for i in range(n) for size in (100, 30)]
    for rate in (0.3, 0.55, 1.7):
        per = frame(spark, [(f"s{i}", 2, 130, 130 * rate, rate) for i in range(n)], "source string, n_docs bigint, source_size bigint, target double, rate double")
        cuts = {r.source: r.cuts for r in mixing.draw_cuts(frame(spark, rows, "source string, coin int, size bigint"), per).collect()}
        tier = {100: sum(100 * 2 < c * 130 for c in mixing.TIERS), 30: sum(30 * 2 < c * 130 for c in mixing.TIERS)}
        for size in (100, 30):
            share = np.mean([coin < cuts[s].get(tier[size], 0) for s, coin, x in rows if x == size])
            assert abs(share - rate % 1) < 0.045, (rate, size, share)


def test_sources_come_near_their_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("source").agg(
        F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.first("mix.target").alias("target"), F.max("mix.copies").alias("most")).collect()
    assert all(abs(r.taken - r.target) < 0.03 * r.target and r.most <= 2 for r in got)


def test_mixing_beyond_the_broadcast_bound_and_clashes(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("mix", F.lit("own")).withColumn("cuts", F.lit(1))
    small = sorted((r.doc_id, r.mix.copies, r.cuts) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.mix.copies, r.cuts) for r in mixing.mix(docs).collect()) == small
    assert mixing.mix(docs, out="other").first().mix == "own"
    assert mixing.repeat_rows(mixing.mix(docs)).count() == sum(n for _, n, _ in small)


def test_levels_are_those_of_a_plain_loop(spark):
    rng = random.Random(5)
    sizes = {f"s{i:02}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(23)} | {None: 77}
    sized = frame(spark, [(s, n) for s, n in sizes.items()], "source string, size bigint")
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            break
        want |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


# ---------------------------------------------------------------- 9

VECTORS = "vec_id bigint, embedding array<double>, label int"


def test_vectors_with_null_or_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (9, [0.01, 1.0], 1), (7, [1.0, 0.01], 1), (7, [1.0, 0.01], 1), (8, [], 1), (6, [1.0], 1)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddup.link_vectors(frame(spark, rows, VECTORS).withColumn("root", F.lit("own"))).collect())
    # a row of id 5 for each of its vectors, each with its own links
    assert got == sorted([("None", 0, None, True), ("5", 2, 5, True), ("5", 1, 5, True), ("9", 1, 5, False), ("7", 2, 5, False), ("7", 2, 5, False), ("8", 0, 8, True), ("6", 0, 6, True)])
    assert embeddup.link_vectors(frame(spark, [], VECTORS)).count() == 0


def test_links_in_many_blocks_and_lists_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "BLOCK", 16)
    monkeypatch.setattr(embeddup, "PER_LIST", 25)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    x = np.repeat(centres, 8, axis=0) + rng.normal(size=(320, 12)) * 0.11
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embeddup.link_vectors(frame(spark, rows, VECTORS)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(320)[:, None] % 2 == np.arange(320)[None] % 2) & ~np.eye(320, dtype=bool)
    assert near.sum() > 100 and got == dict(enumerate(near.sum(1).tolist()))


@pytest.mark.parametrize(("dims", "flat"), [(3, 1024), (8, 1024), (64, 1024), (64, 4)])
def test_codes_never_hide_a_link(monkeypatch, dims, flat):
    monkeypatch.setattr(embeddup, "FLAT_LISTS", flat)
    rng = np.random.default_rng(dims)
    x = embeddup._unit(rng.normal(size=(2000, dims)))
    y = embeddup._unit(x + rng.normal(size=x.shape) * 0.15 / np.sqrt(dims))
    index = embeddup.Index.fit(x, 20, 0.98)
    px, py = (index.stack(pd.Series(list(v))) for v in (x, y))
    own = np.array([p[0] for p in index.probes(py)])
    codes, error = index.encode(py, own)
    linked = (x * y).sum(1) >= 0.98
    assert linked.sum() > 500
    for at in range(len(index.centroids)):
        k = np.flatnonzero(own == at)
        assert index.near(px[k].astype(np.float32).astype(float), at, codes[k], error[k])[np.arange(k.size), np.arange(k.size)][linked[k]].all()
