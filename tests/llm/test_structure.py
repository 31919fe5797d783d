"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import heapq
import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chatrepair, fim, queries, substrings
from tests.compare import connect, same

SPACE = r"[\x20\x09-\x0D]"
SF = "/root/testdata/sf0.01"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_chatrepair", "op12_fim", "op13_substrings"])
def test_same_as_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


# ---------------------------------------------------------------- 11

def cheapest(rows, limit=60):
    """Least (cost, letters) over all edit scripts, by search in order of cost and letters; rows are (kind, initial)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, said = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", said):
            return cost, letters
        if (i, said[-2:], len(said) > 0, letters) in done or not re.fullmatch(r"s?(ua)*u?", said) or cost > limit:
            continue
        done.add((i, said[-2:], len(said) > 0, letters))
        moves = [("I", 3, i, "u"), ("I", 3, i, "a")]
        if i < len(rows):
            fault, initial = rows[i]
            moves.append(("D", 4, i + 1, ""))
            if fault not in ("blank", "duplicate"):
                t = 3 if fault == "truncated" else 0
                moves += [("K", t, i + 1, initial), ("R", 3 + t, i + 1, "u"), ("R", 3 + t, i + 1, "a")]
        for letter, w, j, c in moves:
            if letter != "K" or c:
                heapq.heappush(heap, (cost + w, letters + letter, j, said + c))
    raise AssertionError


def judged(rows):
    """Fault and initial of each (turn, role, text), sorted as the operator sorts."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    out, seen = [], set()
    for _, role, text in rows:
        last = re.sub(rf"{SPACE}+\Z", "", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((fault, role[:1]))
    return rows, out


def mended(rows, letters):
    out, i, said = [], 0, ""
    for letter in letters:
        if letter == "D":
            i += 1
            continue
        role = rows[i][1] if letter == "K" else "assistant" if said.endswith("u") else "user"
        out.append(f"{role}:{'' if letter == 'I' else rows[i][2]}")
        said += role[0]
        i += letter != "I"
    assert re.fullmatch(r"(s?(ua)+)?", said) and i == len(rows)
    return "\n".join(out)


def expected(rows):
    rows, faults = judged(rows)
    cost, letters = cheapest(faults)
    turns = sorted({r[0] for r in rows if r[0] is not None})
    initials = [f[1] for f in faults]
    return {
        "gaps": turns[-1] - turns[0] + 1 - len(turns) if turns else 0, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": letters, "repaired_sha256": sha(mended(rows, letters)), **{k: sum(f[0] == k for f in faults) for k in ("blank", "duplicate", "truncated")},
    }


ROLES = ["user", "assistant", "system", "tool", "", "usher", "U"]
TEXTS = ["Yes.", "no", "", " \t\n", "Why? ", "Fine!\n", "é…", "a.b", " ", "ok.", "go.", "x."]


@pytest.mark.parametrize("block", [256, 2])
def test_repairs_are_the_cheapest_of_all(spark, monkeypatch, block):
    monkeypatch.setattr(chatrepair, "BLOCK_ROWS", block)
    rng = random.Random(block)
    convs = {c: [(rng.choice([None, *range(6)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(6))] for c in [None, *range(120)]}
    convs[500] = [(i, ("user", "assistant")[i % 2], f"{i}.") for i in range(40)]
    rows = [(c, *r, False, "x") for c, rs in convs.items() for r in rs] + [(c, 9, "user", "gone.", True, "y") for c in convs]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, dropped boolean, block string")
    if block == 2:  # block numbers come from tasks; workers read the module, so cut blocks by characters there
        frame = frame.repartition(3)
    got = {r.conv_id: r.asDict() for r in chatrepair.digests(frame).collect()}
    assert got.keys() == convs.keys()
    for c, rs in convs.items():
        row = got[c]
        row.pop("conv_id")
        assert row == expected(rs), (c, rs)
    turns = {}
    for b in sorted(chatrepair.repair(frame).collect(), key=lambda b: b.block):
        turns.setdefault(b.conv_id, []).extend(f"{t.role}:{t.text}" for t in b.turns)
    assert all(sha("\n".join(turns[c])) == got[c]["repaired_sha256"] for c in convs)


@pytest.mark.parametrize("parts", [3, 40])
def test_repairs_do_not_depend_on_the_tasks(spark, parts):
    """Each row may be the last of its task, so that the mark of a first row and the row itself are parted."""
    rng = random.Random(parts)
    convs = {c: [(rng.choice([None, *range(4)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(1, 9))] for c in range(12)}
    convs[3] = [(None, "user", "Yes.")] * 5
    rows = [(c, *r, False) for c, rs in convs.items() for r in rs] + [(c, r[0], r[1], r[2], True) for c in (3, 4) for r in convs[c]]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, dropped boolean")
    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.conv_id: r.asDict() for r in chatrepair.digests(frame).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for c, rs in convs.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == expected(rs), (c, rs)


def test_walk_in_blocks_is_the_walk_at_once():
    rng = random.Random(5)
    for _ in range(300):
        kinds = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(12)))
        faults = [("blank" if k == "x" else "truncated" if k.isupper() else None, k.lower()) for k in kinds]
        total = chatrepair.backwards(kinds, chatrepair.AT_END)[0]
        cost, letters = cheapest(faults, 99)
        assert total == cost
        cut = rng.randrange(len(kinds) + 1)
        states, out, before = (0,), "", chatrepair.AT_START
        for part, rest, last in ((kinds[:cut], kinds[cut:], False), (kinds[cut:], "", True)):
            got, states = chatrepair.walk(part, states, before, chatrepair.backwards(rest, chatrepair.AT_END), total, last)
            out, before = out + got, chatrepair.onwards(part, before)
            assert len(states) == 1
        assert out == letters


def test_damage_and_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chatrepair.digests(chatrepair.damage(empty)).count() == 0
    rows = [(c, t, None if c % 7 == 0 else "user", None if t == 3 else "A.b!") for c in range(40) for t in (*range(5), None)]
    got = chatrepair.damage(spark.createDataFrame(rows, empty.schema)).groupBy("conv_id", "turn").agg(F.collect_list(F.struct("role", "text", "dropped")).alias("r")).collect()
    import zlib
    kinds = set()
    for r in got:
        k = zlib.crc32(f"{r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = " " if r.conv_id % 7 == 0 else "user", " " if r.turn == 3 else "A.b!"
        text = "" if k == 1 else text.replace(".", "").replace("!", "") if k == 2 else text
        assert [tuple(x) for x in r.r] == [("user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
        kinds.add(k)
    assert kinds >= {0, 1, 2, 3, 4}


# ---------------------------------------------------------------- 12

TOKEN = re.compile(rf"{SPACE}*[^\x20\x09-\x0D]+|{SPACE}+")
ODD_TEXTS = [None, "", " ", "\t\n a", "a", "a b ", "  a b c \n", "<P> x", "x <M", "<S>", "naïve 😀 text of words\n\n", "word " * 50_000]


def fim_expected(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n, h = len(tokens), sha(f"42:{'' if doc_id is None else doc_id}")
    d = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or d[2] % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if d[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fim_is_brute_force_and_comes_back(spark):
    rng = random.Random(3)
    rows = [(i, t, "kept") for i, t in enumerate(ODD_TEXTS * 4)] + [(None, "some text here", None), (7, "a b", "x"), (7, "a b", "x")]
    rows += [(1000 + i, "".join(rng.choice("ab \n\té<PSM>") for _ in range(rng.randrange(40))), "n") for i in range(300)]
    out = fim.transform(spark.createDataFrame(rows, "doc_id bigint, text string, fim string"))
    got = out.withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(rows) and {r.fim.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert tuple(r.fim) == fim_expected(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert fim.transform(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---------------------------------------------------------------- 13

def kept_words(docs, width=13):
    first = {}
    for doc_id, words in docs:
        for i in range(len(words) - width + 1):
            if doc_id is not None:
                w = tuple(words[i : i + width])
                first[w] = min(first.get(w, doc_id), doc_id)
    for doc_id, words in docs:
        gone = set()
        for i in range(len(words) - width + 1):
            if doc_id is not None and first[tuple(words[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        yield gone


@pytest.mark.parametrize("sizes", [(None, None), (400, 7), (1, 1)])
def test_repeats_are_brute_force(spark, sizes):
    rng = random.Random(9)
    parts = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    texts = [" é ".join(" ".join(rng.choice(parts)) for _ in range(rng.randrange(5))) + rng.choice(["", " \n", "\x0b"]) for _ in range(90)]
    docs = [(rng.choice([None, -(1 << 63), (1 << 63) - 1, *range(60)]), t, "kept", None) for t in texts] + [(3, None, "n", None), (3, "", "n", None), (5, " \t ", "n", None)]
    docs += [(2, texts[0], "again", None), (2, texts[0], "again", None), (70, "long " * 30_000, "x", None), (71, "long " * 13, "x", None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, row string, substring_dedup string").repartition(3)
    got = substrings.drop_repeats(frame, chunk_bytes=sizes[0], buckets=sizes[1])
    assert got.columns == ["doc_id", "text", "row", "substring_dedup"]
    rows = got.collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.row) for r in rows])) == sorted(map(str, [d[:3] for d in docs]))
    words = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    for r, (_, w), gone in zip(rows, words, kept_words(words), strict=True):
        s = r.substring_dedup
        assert (s.n_words, s.n_removed) == (len(w), len(gone))
        assert s.text == " ".join(x for i, x in enumerate(w) if i not in gone)
        spans = [i for x in s.spans for i in range(x.start, x.start + x.length)]
        assert spans == sorted(gone) and all(a.start + a.length < b.start for a, b in zip(s.spans, s.spans[1:]))
    assert any(r.substring_dedup.n_removed for r in rows)


def test_no_documents_and_short_ones(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = substrings.drop_repeats(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.substring_dedup.n_words, r.substring_dedup.n_removed, r.substring_dedup.text) for r in rows) == [(1, 2, 0, "a b"), (2, 2, 0, "a b"), (3, 0, 0, "")]


@pytest.mark.parametrize("piece", [1 << 18, 16])
def test_words_in_slices_are_words_of_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(substrings, "SLICE", piece)
    texts = [b"ab cd", b"", b"  ", b"x", b"one-very-long-word-that-no-slice-holds " * 3, "é 😀".encode(), b"ab cd", b"abcd"]
    h, owner = substrings.words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    words = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    assert owner.tolist() == [i for i, _ in words]
    by_word = {}
    for (_, w), x in zip(words, h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_window_hashes_of_stretches_are_those_of_one_run(monkeypatch):
    words = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint64)
    whole = substrings.windows(words, 3, substrings._POWERS[1])
    monkeypatch.setattr(substrings, "STRETCH", 7)
    assert (substrings.windows(words, 3, substrings._POWERS[1]) == whole).all()
    kinds = {}
    for i, h in enumerate(whole.tolist()):
        assert kinds.setdefault(tuple(words[i : i + 3]), h) == h
    assert len(set(kinds.values())) == len(kinds) == len(set(product(range(5), repeat=3)) & set(kinds))


def test_chunks_and_buckets_grow_with_the_root():
    for size in (10**9, 10**11, 10**13, 10**15):
        chunk, buckets = substrings.sizes(size)
        hashes = size / 6
        assert (chunk / 6) / buckets >= 32 and hashes / buckets <= max(substrings.BUCKET_HASHES, 8 * hashes**0.5) * 1.01
