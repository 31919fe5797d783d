"""Files as tables: pages, evaluation runs and seed specifications by ``spark.read.format``, after ``register(spark)``.

Files are listed once and dealt to tasks by size, files of lines also by ranges of bytes. They are opened where they lie, by their URI
(local, HDFS, object stores). What can't be read is a row with ``error``, never the end of the job.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from itertools import groupby

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from palimpsest.functions.pages import decode_bytes, read_page

#: Bytes that one task reads, about.
SPLIT = 16 << 20


@dataclass
class Part(InputPartition):
    """Stretches (path, start, end) of files; the end is -1 for whole files."""

    stretches: list[tuple[str, int, int]]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


def _listed(uri: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files at a path, with their sizes, in order; hidden ones and marks of writers are none."""
    system, path = _open(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((p, n) for p, n in names if not endings or p.lower().endswith(endings))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], endings: tuple[str, ...], lines: bool, parse, width: int) -> None:  # noqa: ANN001
        self.uri, self.split = options["path"], int(options.get("split", SPLIT))
        self.endings, self.lines, self.parse, self.width = endings, lines, parse, width

    def partitions(self) -> list[Part]:
        stretches = []
        for path, size in _listed(self.uri, self.endings):
            step = self.split if self.lines else max(size, 1)
            stretches += [(path, i, min(i + step, size) if self.lines else -1, min(step, size - i)) for i in range(0, max(size, 1), step)]
        total, numbered = 0, []
        for *s, size in stretches:
            numbered.append((total // self.split, tuple(s)))
            total += max(size, 4096)
        return [Part([s for _, s in group]) for _, group in groupby(numbered, key=lambda x: x[0])]

    def _lines(self, path: str, start: int, end: int) -> Iterator[bytes]:
        """Lines that begin in a stretch."""
        with _open(self.uri)[0].open_input_file(path) as file, io.BufferedReader(file, 1 << 20) as raw:
            raw.seek(max(start - 1, 0))
            at = raw.tell()
            if start:
                at += len(raw.readline())  # to the end of a line that began before
            while at < end:
                line = raw.readline()
                if not line:
                    return
                at += len(line)
                if line.strip():
                    yield line

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, start, end in partition.stretches:
            try:
                if self.lines:
                    bodies: Iterator[bytes] = self._lines(path, start, end)
                else:
                    with _open(self.uri)[0].open_input_file(path) as raw:
                        bodies = iter([raw.read()])
                for body in bodies:
                    try:
                        yield from ((path, *row, None) for row in self.parse(body))
                    except (ValueError, KeyError, TypeError, AttributeError) as e:
                        yield (path, *[None] * self.width, f"{type(e).__name__}: {e}"[:200])
            except OSError as e:
                yield (path, *[None] * self.width, f"{type(e).__name__}: {e}"[:200])


class _Files(DataSource):
    endings: tuple[str, ...] = ()
    fields = ""

    def schema(self) -> str:
        return f"path string, {self.fields}, error string"

    def _reader(self, schema: StructType, parse, lines: bool) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options), self.endings, lines, parse, len(schema) - 2)


class PageFiles(_Files):
    """One row a page: what ``read_page`` finds in a file of HTML. Option ``charset``: the encoding that the server said."""

    endings = (".html", ".htm")
    fields = "title string, lang string, text string, words int, method string, paywall boolean, script_only boolean"

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def reader(self, schema: StructType) -> Reader:
        names, charset = schema.names[1:-1], self.options.get("charset")

        def parse(body: bytes) -> Iterator[tuple]:
            page = read_page(decode_bytes(body, charset))
            yield tuple(page[n] for n in names)

        return self._reader(schema, parse, lines=False)


class RunFiles(_Files):
    """One row a case of an evaluation run. A file is one run, or with option ``lines`` it has one a line."""

    endings = (".json", ".jsonl")
    fields = "run_id string, suite string, mode string, status string, case_id string, passed boolean, latency_ms double, cost_usd double, calls int"

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def reader(self, schema: StructType) -> Reader:
        def parse(body: bytes) -> Iterator[tuple]:
            run = json.loads(body)
            for case in run["cases"]:
                number = lambda k, c=case: None if c.get(k) is None else float(c[k])
                yield (*(run.get(k) for k in ("run_id", "suite", "mode", "status")), case["id"], case.get("passed"), number("latency_ms"), number("cost_usd"), len(case.get("calls") or ()))

        return self._reader(schema, parse, lines=self.options.get("lines", "false") == "true")


def expanded(spec: dict) -> Iterator[dict]:
    """Rows of a declared series: ``count`` of them, ``every_days`` apart from ``start`` on, each field of ``vary`` cycling through its values."""
    start = spec["start"] if isinstance(spec["start"], date) else date.fromisoformat(spec["start"])
    for i in range(spec.get("count", 1)):
        varied = {k: v[i % len(v)] for k, v in (spec.get("vary") or {}).items()}
        at = datetime(start.year, start.month, start.day) + timedelta(days=i * spec.get("every_days", 1))
        yield {**(spec.get("fields") or {}), **varied, "key": f"{spec['name']}_{i + 1}", "at": at.isoformat()}


def specs_of(body: bytes) -> list[dict]:
    """The series of a file: JSON, or YAML where that can be read; one, or a list under ``series``."""
    try:
        found = json.loads(body)
    except ValueError:
        import yaml
        try:
            found = yaml.safe_load(body)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e
    found = found.get("series", found) if isinstance(found, dict) else found
    return found if isinstance(found, list) else [found]


class SpecFiles(_Files):
    """One row for each row of the declared series. The columns beside key and at are the fields that the first file names."""

    endings = (".yaml", ".yml", ".json", ".txt")

    @classmethod
    def name(cls) -> str:
        return "spec_files"

    def schema(self) -> str:
        names: set[str] = set()
        for path, _ in _listed(self.options["path"], self.endings)[:1]:
            with _open(self.options["path"])[0].open_input_file(path) as file, io.BufferedReader(file) as raw:
                for spec in specs_of(raw.readline() if self.options.get("lines", "false") == "true" else raw.read()):
                    names |= {*(spec.get("fields") or {}), *(spec.get("vary") or {})}
        return ", ".join(["path string, key string, at string", *[f"`{n}` string" for n in sorted(names)], "error string"])

    def reader(self, schema: StructType) -> Reader:
        names = schema.names[1:-1]

        def parse(body: bytes) -> Iterator[tuple]:
            for spec in specs_of(body):
                for row in expanded(spec):
                    yield tuple(None if row.get(n) is None else str(row[n]) for n in names)

        return self._reader(schema, parse, lines=self.options.get("lines", "false") == "true")


def register(spark: SparkSession) -> None:
    for source in (PageFiles, RunFiles, SpecFiles):
        spark.dataSource.register(source)
