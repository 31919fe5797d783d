"""Writes touch the buckets of their keys only, and count once."""

import re

from palimpsest.sources.buckets import BucketTable

SCHEMA = "k bigint, v string, n bigint"


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("part-*.parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_writes_touch_only_their_buckets(spark, tmp_path):
    tmp_path = tmp_path / "table"
    start = [(i, "a", i) for i in range(200)] + [(None, "null", 0)]
    table = BucketTable.create(spark.createDataFrame(start, SCHEMA), str(tmp_path), ["k"], 32)
    before = files(tmp_path)
    assert len({f.split("/")[0] for f in before}) == 32 and rows(table) == sorted(start, key=str)
    # an insert adds files and leaves all others
    new = spark.createDataFrame([(3, "b", 1), (500, "b", 2)], SCHEMA)
    table.insert(new, 7)
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items()) and 1 <= len(after) - len(before) <= 2
    table.insert(new, 7)
    want = sorted([*start, (3, "b", 1), (500, "b", 2)], key=str)
    assert rows(table) == want
    # an upsert of two keys rewrites two buckets at most, and none of them twice
    kept = files(tmp_path)
    for _ in range(2):
        table.upsert_missing(spark.createDataFrame([(3, "c", 9), (501, "c", 9), (501, "b", 9)], SCHEMA), 8)
        assert rows(table) == sorted([*want, (501, "b", 9)], key=str)
    assert len({f.split("/")[0] for f in kept if files(tmp_path).get(f) != kept[f]}) <= 2
    # sets and rows
    table.replace_sets(spark.createDataFrame([(3, "s", 1), (3, "t", 2), (600, "u", 3)], SCHEMA), 9)
    now = [r for r in rows(table) if r[0] in (3, 600)]
    assert now == [(3, "s", 1), (3, "t", 2), (600, "u", 3)] and len(rows(table)) == len(want) + 1 - 2 + 2 + 1
    table.replace_rows(spark.createDataFrame([(10, "new", -1)], SCHEMA), 10, ["n"])
    assert (10, "new", 10) in rows(table) and (10, "a", 10) not in rows(table)
    plan = table.read([(10,), (11,)])
    assert sorted(map(tuple, plan.collect())) == [(10, "new", 10), (11, "a", 11)]
    assert re.search(r"PartitionFilters: \[(isnotnull\(__bucket#\d+\), )?\(?__bucket#\d+ (IN|=)", plan._jdf.queryExecution().executedPlan().toString())
    assert rows(table)[-1] == (None, "null", 0)


def test_no_rows(spark, tmp_path):
    table = BucketTable.create(spark.createDataFrame([(1, "a", 1)], SCHEMA), f"{tmp_path}/t", ["k"], 4)
    none = spark.createDataFrame([], SCHEMA)
    for write in (table.insert, table.upsert_missing, table.replace_sets):
        write(none, 3)
    assert rows(table) == [(1, "a", 1)]
