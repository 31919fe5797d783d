"""The stem index: stems, covers, partitions that a question reads, and texts that come later."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import stems as st
from palimpsest.operators import lexicon as lx

#: Words and their stems as the algorithm's authors publish them.
KNOWN = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist
consolation consol consolations consol consolatory consolatori console consol consolidate consolid consolidating consolid consonant conson conspicuously conspicu
conspiracy conspiraci conspirators conspir constable constabl constancy constanc knackeries knackeri knavish knavish kneeling kneel knightly knight knitted knit
knives knive knocker knocker generally general generate generat communism communism happiness happi relational relat conditional condit hopping hop hoping hope
agreed agre feed feed cries cri tie tie dying die inning inning proceed proceed gas gas gaps gap sky sky say say cry cri by by troubled troubl sized size""".split()


def test_stems_are_the_published_ones():
    assert {w: st.stem(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2]))
    assert st.places("The cats, and a cat") == {"cat": [2, 5]} and st.question_stems("Who was the Élan?") == ["lan"]


def brute_density(places):
    """All intervals that hold every stem and lose one when cut at either end."""
    entries = sorted((p, k) for k, x in enumerate(places) for p in x)
    total = 0.0
    for i, j in product(range(len(entries)), repeat=2):
        holds = lambda a, b: len({k for _, k in entries[a : b + 1]}) == len(places)
        if i <= j and holds(i, j) and not holds(i + 1, j) and not holds(i, j - 1):
            total += 0.1 / (1 + entries[j][0] - entries[i][0] - (j - i))
    return total


def test_covers_are_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        places = [[] for _ in range(rng.randrange(1, 4))]
        for p in range(rng.randrange(1, 30)):
            if rng.random() < 0.5:
                rng.choice(places).append(p)
        assert lx.density(places) == pytest.approx(brute_density(places))


ROWS = [(1, 10, "Running shoes, and a run."), (2, 10, "the the"), (3, 11, None), (4, 11, "shoes that ran; a runner's run of shoes"), (5, 12, "nothing")]


@pytest.fixture
def index(spark, tmp_path):
    return lx.Lexicon.create(spark.createDataFrame(ROWS, "key_id bigint, item_id bigint, text string"), str(tmp_path), ["key_id"], shards=16)


def test_index_is_a_scan(spark, index):
    rows = spark.createDataFrame(ROWS, "key_id bigint, item_id bigint, text string")
    for question in ("runs", "the shoe runs", "of the", "absent", "shoes nothing"):
        for every in (False, True):
            got = {r.key_id: r.score for r in index.scores(question, every).collect()}
            assert got == {r.key_id: r.score for r in lx.scan(rows, question, every=every).collect()}
    assert {r.key_id for r in index.scores("run shoe", every=True).collect()} == {1, 4}
    many = lx.scores_of_all(index, spark.createDataFrame([(1, "runs"), (2, "of"), (3, "a shoe")], "question_id int, text string"))
    assert {(r.question_id, r.key_id, r.score) for r in many.collect()} == {(q, r.key_id, r.score) for q, x in ((1, "runs"), (3, "a shoe")) for r in index.scores(x).collect()}


def test_a_question_reads_the_folders_of_its_stems(index):
    plan = index.scores("running")._jdf.queryExecution().executedPlan().toString()
    import zlib
    assert f"shard#" in plan and "PartitionFilters: [isnotnull(shard" in plan and f"= {zlib.crc32(b'run') % 16})" in plan and "EqualTo(stem,run)" in plan
    files = index.postings(["run"]).inputFiles()
    assert files and all("/shard=" in f for f in files)


def test_later_texts_replace_and_extend(spark, index, tmp_path):
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    index.extend(spark.createDataFrame([(1, 10, "a bicycle"), (9, 13, "run run run")], "key_id bigint, item_id bigint, text string"))
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    assert {r.key_id: r.score for r in index.scores("run").collect()} == {4: round(1 / 11, 6), 9: round(3 / 13, 6)}
    assert [r.key_id for r in index.scores("bicycles").collect()] == [1]
    assert index.stored().where(F.col("key_id") == 1).count() == 1
