"""Files read by format, in several tasks, the unreadable ones as rows with an error."""

import json

from pyspark.sql import functions as F

from palimpsest.functions.pages import read_page
from palimpsest.sources import files


def test_pages_as_files(spark, tmp_path):
    files.register(spark)
    words = "word " * 60
    for i in range(12):
        (tmp_path / f"p{i:02}.html").write_bytes(f"<html lang=fr><head><meta charset=latin-1><title>é {i}</title></head><body><article><p>{words}{i}</p></article></body></html>".encode("latin-1"))
    (tmp_path / "empty.htm").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    rows = spark.read.format("page_files").option("split", "20000").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 1
    got = {r.path.split("/")[-1]: r for r in rows.collect()}
    assert len(got) == 13 and got["p03.html"].title == "é 3" and got["p03.html"].words == 61 and got["empty.htm"].method == "none"
    assert got["p07.html"].text == read_page((tmp_path / "p07.html").read_bytes().decode("latin-1"))["text"]


def test_runs_by_file_and_by_line(spark, tmp_path):
    files.register(spark)
    runs = [{"run_id": f"r{i}", "suite": "recall", "cases": [{"id": f"c{k}", "passed": k % 2 == 0, "latency_ms": k, "calls": [{}] * k} for k in range(i % 5)]} for i in range(200)]
    want = sorted((r["run_id"], c["id"], c["passed"], float(c["latency_ms"]), len(c["calls"])) for r in runs for c in r["cases"])
    (tmp_path / "lines").mkdir()
    body = "\n".join(map(json.dumps, runs)) + "\nnot json\n\n{\"run_id\": \"x\"}\n"
    (tmp_path / "lines" / "a.jsonl").write_text(body)
    for split in ("100", "997", "100000"):  # lines that cross the ends of stretches are read once
        rows = spark.read.format("run_files").option("lines", "true").option("split", split).load(f"{tmp_path}/lines")
        assert sorted((r.run_id, r.case_id, r.passed, r.latency_ms, r.calls) for r in rows.where("error IS NULL").collect()) == want
        assert sorted(r.error[:9] for r in rows.where("error IS NOT NULL").collect()) == ["JSONDecod", "KeyError:"]
    (tmp_path / "whole").mkdir()
    for i, r in enumerate(runs[:20]):
        (tmp_path / "whole" / f"{i}.json").write_text(json.dumps(r, indent=1))
    (tmp_path / "whole" / "bad.json").write_text("{")
    rows = spark.read.format("run_files").load(f"file:{tmp_path}/whole")
    assert rows.where("error IS NULL").count() == sum(len(r["cases"]) for r in runs[:20]) and rows.where(F.col("error").startswith("JSON")).count() == 1


def test_series_of_specifications(spark, tmp_path):
    files.register(spark)
    (tmp_path / "a.yaml").write_text("series:\n - name: run\n   start: 2026-01-30\n   count: 4\n   every_days: 2\n   fields: {kind: episode}\n   vary: {km: [5, 7, 10]}\n - name: once\n   start: 2026-02-01\n")
    (tmp_path / "b.json").write_text(json.dumps({"name": "swim", "start": "2026-03-01", "count": 2, "vary": {"km": ["1"], "other": ["x"]}}))
    (tmp_path / "c.yml").write_text("a: [unclosed")
    (tmp_path / "d.yml").write_text("name: no start\ncount: 1\n")
    rows = spark.read.format("spec_files").load(str(tmp_path))
    assert rows.columns == ["path", "key", "at", "kind", "km", "error"]
    assert sorted((r.key, r.at[:10], r.kind, r.km) for r in rows.where("error IS NULL").collect()) == [
        ("once_1", "2026-02-01", None, None), ("run_1", "2026-01-30", "episode", "5"), ("run_2", "2026-02-01", "episode", "7"), ("run_3", "2026-02-03", "episode", "10"), ("run_4", "2026-02-05", "episode", "5"),
        ("swim_1", "2026-03-01", None, "1"), ("swim_2", "2026-03-02", None, "1")]
    assert {r.path[-5:] for r in rows.where("error IS NOT NULL").collect()} == {"c.yml", "d.yml"}
