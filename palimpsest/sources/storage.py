"""Scans and sinks: point reads, keyset pages, upserts, set replacement, versioned rows, purge and template copy."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame into the shared folder and read it back, which ends its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job writes for itself; they are deleted when the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/palimpsest/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.base}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{self.n}")

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tasks for each core that rows are dealt to before wide joins and windows.
TASKS = 16


def dealt(rows: DataFrame, *keys: str, tasks: int = 0) -> DataFrame:
    """Rows by keys in many tasks, ``tasks`` at least, a number that adaptive execution leaves: joins and windows by these keys keep it.

    What a task sorts is several times larger in memory than what is shuffled, by which adaptive execution joins partitions.
    """
    spark = rows.sparkSession
    return rows.repartition(max(tasks, TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def by_ids(df: DataFrame, ids: list[int], key: str = "item_id") -> DataFrame:
    """Rows with one of the ids; an empty list gives none."""
    return df.where(F.col(key).isin(*ids)) if ids else df.limit(0)


class Reader:
    """What one scope may read: its items, and of links and ends only those that touch them."""

    def __init__(self, items: DataFrame, links: DataFrame, item_entities: DataFrame) -> None:
        self.items, self._links, self._ends = items, links, item_entities

    def by_ids(self, ids: list[int]) -> DataFrame:
        return by_ids(self.items, ids)

    def newest(self, limit: int = 200) -> DataFrame:
        return newest(self.items, limit)

    def page(self, before: int | None, limit: int) -> DataFrame:
        return page_before(self.items, "item_id", before, limit)

    def links(self) -> DataFrame:
        return touching(self._links, self.items.select(F.col("item_id").alias("node")))

    def ends(self) -> DataFrame:
        return self._ends.join(self.items.select("item_id"), "item_id", "left_semi")


def newest(df: DataFrame, limit: int = 200) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col("item_id").desc()).limit(limit)


def page_before(df: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """A keyset page of time-ordered ids, newest first."""
    df = df if before is None else df.where(F.col(key) < before)
    return df.orderBy(F.col(key).desc()).limit(limit)


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end in ``nodes(node)``."""
    n = nodes.select("node").distinct()
    a = edges.join(n, F.col("src") == F.col("node"), "left_semi")
    return a.unionByName(edges.join(n, F.col("dst") == F.col("node"), "left_semi")).distinct()


def upsert_missing(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert what is not there by key, leave what is; of new rows with one key the least stays."""
    first = new.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key])))
    return stored.unionByName(first.where("__n = 1").drop("__n").join(stored, key, "left_anti"))


def replace_sets(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the keys that ``new`` has are replaced by its rows as a set."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def replace_rows(stored: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Replace whole rows by key, but never the columns in ``keep``, which stay as stored."""
    old = stored.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in keep])
    merged = new.join(old, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).select(*stored.columns)
    return stored.join(new, key, "left_anti").unionByName(merged)


def latest_version(log: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The current row of each key of an append-only log."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.col(version).desc()))
    return log.withColumn("__n", n).where("__n = 1").drop("__n")


def ledger_rows(calls: DataFrame, workspaces: DataFrame, turns: DataFrame) -> DataFrame:
    """Model calls with the owner of their workspace; a call is the system's if flagged so or made in a system turn."""
    out = calls.join(workspaces.select("workspace_id", "owner_id"), "workspace_id").join(turns.select("turn_id", F.col("kind").alias("turn_kind")), "turn_id", "left")
    return out.withColumn("system", F.col("system") | F.coalesce(F.col("turn_kind") == "system", F.lit(False))).drop("turn_kind")


def access_counters(access: DataFrame) -> DataFrame:
    """(item_id, access_count, last_accessed_at, cited_count) from the append-only access log."""
    return access.groupBy("item_id").agg(F.count("*").alias("access_count"), F.max("at").alias("last_accessed_at"), F.sum(F.col("cited").cast("bigint")).alias("cited_count"))


def purge(tables: dict[str, DataFrame], expired: DataFrame, keep: tuple[str, ...] = ("ledger",)) -> dict[str, DataFrame]:
    """Every table without the rows of expired workspaces, but for those in ``keep``."""
    return {n: df if n in keep else df.join(expired.select("workspace_id"), "workspace_id", "left_anti") for n, df in tables.items()}


def shifted(at: Column, days: Column | int, rrule: Column) -> Column:
    """A time moved by whole days; routines move by whole weeks, so that their weekday stays."""
    days = F.lit(days) if isinstance(days, int) else days
    n = F.when(rrule.isNotNull(), F.floor(days / 7) * 7).otherwise(days).cast("int")
    return at + F.make_dt_interval(n)


def copy_template(items: DataFrame, links: DataFrame, item_entities: DataFrame, template: int, target: int, days: int) -> dict[str, DataFrame]:
    """Clone a workspace: ids are mapped, times move by ``days``, edges follow the new ids, ends outside are dropped."""
    if days < 0:
        raise ValueError("a template is never moved into the past")
    if template == target:
        raise ValueError("a workspace is not copied onto itself")
    rows = items.where(F.col("workspace_id") == template)
    new_id = lambda c: F.xxhash64(F.lit(target), c).bitwiseAND(F.lit(2**62 - 1))
    ids = rows.select(F.col("item_id").alias("old"), new_id(F.col("item_id")).alias("new"))
    times = [c for c, t in items.dtypes if t == "timestamp"]
    moved = rows.withColumns({c: shifted(F.col(c), days, F.col("rrule")) for c in times})
    moved = moved.withColumns({"item_id": new_id(F.col("item_id")), "workspace_id": F.lit(target).cast("int")})
    two = links.join(ids, links["src"] == ids["old"]).select(F.col("new").alias("src"), "link_type", "dst")
    two = two.join(ids, two["dst"] == ids["old"]).select("src", "link_type", F.col("new").alias("dst"))
    ends = item_entities.join(ids, item_entities["item_id"] == ids["old"]).select(F.col("new").alias("item_id"), "entity_id", "role")
    return {"items": moved, "links": two, "item_entities": ends}


def series(spark: SparkSession, name: str, count: int, start: str, every_days: int, vary: dict[str, list[str]]) -> DataFrame:
    """Rows of a declared series: ``count`` of them, ``every_days`` apart, each varied field cycling through its values."""
    rows = spark.range(count).withColumn("key", F.concat(F.lit(f"{name}_"), (F.col("id") + 1).cast("string")))
    rows = rows.withColumn("at", F.lit(start).cast("timestamp") + F.make_dt_interval((F.col("id") * every_days).cast("int")))
    for field, values in vary.items():
        rows = rows.withColumn(field, F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int")))
    return rows.drop("id")


def seed_time(text: Column, now: Column, timezone: str) -> Column:
    """Times of a seed as UTC instants: ``-12d 07:30``, ``+3d``, local ISO, or ISO with Z."""
    days = F.regexp_extract(text, r"^([+-]\d+)d", 1)
    clock = F.regexp_extract(text, r"(\d{1,2}:\d{2})$", 1)
    day = F.date_add(F.to_date(F.from_utc_timestamp(now, timezone)), F.when(days != "", days.cast("int")))
    local = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.when(clock == "", "00:00").otherwise(clock)))
    iso = F.to_timestamp(F.regexp_replace(F.regexp_replace(text, "Z$", ""), "T", " "))
    return F.when(days != "", F.to_utc_timestamp(local, timezone)).when(text.endswith("Z"), iso).otherwise(F.to_utc_timestamp(iso, timezone))


def run_cases(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Cases of evaluation runs kept as JSON files, one row a case, with the fields of their run; a file is one run, or one a line."""
    schema = ("run_id string, suite string, mode string, status string, started_at string, cases array<struct<id:string,"
              "passed:boolean,latency_ms:double,cost_usd:double,scores:map<string,double>,calls:array<struct<step:string,cost_usd:double,latency_ms:double,cache_hit:boolean>>>>")
    return spark.read.schema(schema).json(path, multiLine=multiline).select("run_id", "suite", "mode", "status", F.explode("cases").alias("case"))


def pending_since(jobs: DataFrame, before: Column, limit: int = 50) -> DataFrame:
    """Jobs(link_id, status, pending_since) that wait since before an instant, oldest first: what a sweep takes up again."""
    return jobs.where((F.col("status") == "pending") & (F.col("pending_since") < before)).orderBy("pending_since", "link_id").limit(limit)


def count_sources(sources: DataFrame, workspace_id: int) -> DataFrame:
    """One row: how many sources a workspace has."""
    return sources.where(F.col("workspace_id") == workspace_id).agg(F.count("*").alias("n"))


def public_reads(items: DataFrame, entities: DataFrame, said: DataFrame, workspace_id: int, now: Column) -> dict[str, DataFrame]:
    """What a reader of a workspace sees: its active items of normal sensitivity, active entities, turns, and what is still to come."""
    mine = items.where((F.col("workspace_id") == workspace_id) & (F.col("status") == "active") & (F.col("sensitivity") == "normal"))
    ahead = mine.withColumn("at", F.coalesce("due_at", "occurred_start")).where(F.col("at") >= now)
    return {"item": mine, "entity": entities.where("status = 'active'"), "turn": said.select("turn_id").distinct(), "upcoming": ahead}
