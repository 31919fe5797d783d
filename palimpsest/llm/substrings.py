"""Operator 13: substring dedup by Rabin-Karp hashes of token windows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from palimpsest.llm.shared import bound_batches, materialize, mix64

WIDTH = 13
#: Least bytes of text of one chunk of documents, and least window hashes that one bucket holds, about; see ``sizes``.
CHUNK_BYTES, BUCKET_HASHES = 6 << 20, 512 << 10
#: Bytes that are hashed at once.
SLICE = 1 << 18
#: Odd, so they have inverses modulo 2^64: bytes of a word, words of a window, words of a window for its bucket. Fixed values.
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            n = max(n, 2 * self.up.size)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up, self.down


_POWERS = [_Powers(b) for b in BASES]
#: Windows that are hashed at once.
STRETCH = 1 << 16


def windows(word: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Hashes of all windows of ``width`` words, stretch by stretch: running sums and powers stay short."""
    out = np.empty(max(word.size - width + 1, 0), np.uint64)
    for i in range(0, out.size, STRETCH):
        at = np.arange(min(STRETCH, out.size - i))
        out[i : i + at.size] = runs(word[i : i + at.size + width - 1], at, at + width, powers)
    return out


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Rabin-Karp hashes of ``values[start:end]``: differences of one running sum, shifted back by the power of the start."""
    up, down = powers(values.size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: values.size], dtype=np.uint64)])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def words(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of joined texts, and the text it is of. Words are runs of bytes other than ASCII white space."""
    hashes, owner = [], []
    at = 0
    while at < raw.size:
        stop = min(at + SLICE, raw.size)
        while stop < raw.size:  # a slice ends behind white space or a text
            spaces = np.flatnonzero(_SPACE[raw[at:stop]])
            edge = edges[np.searchsorted(edges, stop, "right") - 1]
            end = max(int(edge), at + int(spaces[-1]) + 1 if spaces.size else at)
            if end > at:
                stop = end
                break
            stop = min(2 * stop - at, raw.size)
        part = raw[at:stop]
        word = ~_SPACE[part]
        cut = np.zeros(part.size + 1, bool)
        cut[[0, -1]] = True
        cut[edges[np.searchsorted(edges, at) : np.searchsorted(edges, stop)] - at] = True
        before = np.concatenate([[False], word[:-1]]) & ~cut[:-1]
        after = np.concatenate([word[1:], [False]]) & ~cut[1:]
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        hashes.append(runs(_BYTE[part], starts, ends, _POWERS[0]))
        owner.append((np.searchsorted(edges, starts + at, "right") - 1).astype(np.int32))
        at = stop
    return (np.concatenate(hashes), np.concatenate(owner)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int32))


class Windows:
    """The windows of a chunk of documents (id, row): the hash, bucket and document of each, and what asks about them.

    Equal windows of a chunk ask once, for the least id that has them.
    """

    def __init__(self, table: pa.Table, text: int, buckets: int, width: int = WIDTH) -> None:
        known = table["id"].is_valid().to_numpy()
        ids = pc.fill_null(table["id"], 0).to_numpy()
        hashes, owners, self.texts = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], []
        for batch in table["row"].chunks:  # batch by batch: what is worked out from bytes stays small
            column = pc.fill_null(batch.field(text), "").cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            h, owner = words(raw, offsets - offsets[0])
            hashes.append(h)
            owners.append(owner + np.int32(sum(map(len, self.texts))))
            self.texts.append(column)
        word, self.owner, self.width = np.concatenate(hashes), np.concatenate(owners), width
        n = max(word.size - width + 1, 0)
        self.at = np.flatnonzero((self.owner[:n] == self.owner[word.size - n :]) & known[self.owner[:n]]).astype(np.int32)
        self.hash = windows(word, width, _POWERS[1])[self.at]
        bucket = ((windows(word, width, _POWERS[2])[self.at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        own = ids[self.owner[self.at]]
        by_id = np.argsort(own, kind="stable").astype(np.int32)
        self.order = by_id[np.argsort(self.hash[by_id], kind="stable")]
        h, b = self.hash[self.order], bucket[self.order]
        new = np.ones(self.order.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        del h, b, by_id, word
        self.kind = np.cumsum(new, dtype=np.int32) - np.int32(1)
        first = self.order[new]  # of each kind of window, one in the least id
        self.later = own[self.order] > own[first][self.kind]
        self.asked = np.lexsort((own[first], bucket[first])).astype(np.int32)  # kinds as they ask: by bucket, then id
        self.asks = first[self.asked]
        self.ids, self.buckets = own[self.asks], bucket[self.asks]

    def questions(self) -> Iterator[tuple[int, bytes, int, bytes, bytes]]:
        """(bucket, hashes, number of ids, ids, hashes of each id) of each bucket that is asked; many hashes share an id."""
        new = np.ones(self.asks.size, bool)
        new[1:] = (self.ids[1:] != self.ids[:-1]) | (self.buckets[1:] != self.buckets[:-1])
        heads = np.flatnonzero(new)
        counts = np.diff(heads, append=self.asks.size).astype(np.int32)
        found, at = np.unique(self.buckets, return_index=True)
        at = np.append(at, self.asks.size)
        for b, i, j in zip(found, at[:-1], at[1:], strict=True):
            x, y = np.searchsorted(heads, [i, j])
            yield int(b), self.hash[self.asks[i:j]].tobytes(), int(y - x), _packed(np.diff(self.ids[heads[x:y]], prepend=0)), _packed(counts[x:y])

    def covered(self, answers: dict[int, bytes]) -> np.ndarray:
        """Of each word of the chunk, whether a window covers it that starts in a document with a smaller id, too."""
        yes = np.zeros(self.asks.size, bool)
        found, at = np.unique(self.buckets, return_index=True)
        at = np.append(at, self.asks.size)
        for b, i, j in zip(found, at[:-1], at[1:], strict=True):
            yes[self.asked[i:j]] = np.unpackbits(np.frombuffer(answers[int(b)], np.uint8), count=j - i).astype(bool)
        gone = self.at[self.order[yes[self.kind] | self.later]]
        n = self.owner.size
        return np.cumsum(np.bincount(gone, minlength=n + 1)[:n] - np.bincount(gone + self.width, minlength=n + 1)[:n]) > 0

    def results(self, covered: np.ndarray) -> pa.StructArray:
        """n_words, n_removed, spans and text of each document of the chunk; the text of one without is empty."""
        n = sum(map(len, self.texts))
        ends = np.searchsorted(self.owner, np.arange(n), "right")
        starts = np.append(0, ends[:-1]) if n else ends
        head = covered & ~(np.append(False, covered[:-1]) & (self.owner == np.append(-1, self.owner[:-1])))
        at = np.flatnonzero(head)
        tail = covered & ~(np.append(covered[1:], False) & (self.owner == np.append(self.owner[1:], -1)))
        lengths = np.flatnonzero(tail) + 1 - at
        spans = pa.StructArray.from_arrays([pa.array(at - starts[self.owner[at]], pa.int64()), pa.array(lengths, pa.int64())], ["start", "length"])
        offsets = np.append(0, np.searchsorted(self.owner[at], np.arange(n), "right"))
        running = np.append(0, np.cumsum(covered))
        removed = running[ends] - running[starts]
        texts = [b" ".join(compress(t.split(), ~covered[a:b]) if r else t.split()) for t, a, b, r in zip((t.as_buffer().to_pybytes() for column in self.texts for t in column), starts, ends, removed, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array(ends - starts, pa.int64()), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pa.array(texts, pa.binary()).cast(pa.string())],
            ["n_words", "n_removed", "spans", "text"],
        )


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _chunks(size: int):  # noqa: ANN202
    """Rows (id, row) as chunks of about ``size`` bytes: each a compressed stream of its rows, as they came."""
    def write(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for x in rows:
                stream.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.nbytes for x in held) >= size:
                yield write(held)
                held = []
        if held:
            yield write(held)

    return pack


def _read(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_all()


def _ask(text: int, buckets: int, width: int):  # noqa: ANN202
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["rows"], strict=True):
                rows = list(Windows(_read(blob.as_buffer()), text, buckets, width).questions())
                for i in range(0, len(rows), 64):
                    b, hashes, n, ids, counts = zip(*rows[i : i + 64], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b, pa.int32()), pa.array([chunk] * len(b)), pa.array(hashes, pa.binary()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                        ["bucket", "chunk", "hashes", "n_ids", "ids", "counts"],
                    )

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """All that asks one bucket: for each hash one bit, whether anybody has it in a smaller id."""
    hashes, ids, sizes = [], [], []
    for h, n, i, c in zip(*[table[x] for x in ("hashes", "n_ids", "ids", "counts")], strict=True):
        hashes.append(np.frombuffer(h.as_buffer(), np.uint64))
        sizes.append(hashes[-1].size)
        ids.append(np.repeat(np.cumsum(_unpacked(i.as_buffer(), np.int64, n.as_py())), _unpacked(c.as_buffer(), np.int32, n.as_py())))
    all_hashes, all_ids = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(all_hashes)
    h, i = all_hashes[order], all_ids[order]
    new = np.append(True, h[1:] != h[:-1])
    smaller = np.zeros(h.size, bool)
    smaller[order] = np.minimum.reduceat(i, np.flatnonzero(new))[np.cumsum(new) - 1] < i
    bits = [np.packbits(x).tobytes() for x in np.split(smaller, np.cumsum(sizes)[:-1])]
    return pa.table([table["bucket"], table["chunk"], pa.array(bits, pa.binary())], ["bucket", "chunk", "bits"])


def _take(text: int, buckets: int, width: int):  # noqa: ANN202
    def take(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _read(chunk["rows"][0].as_buffer())
        windows = Windows(rows, text, buckets, width)
        found = windows.results(windows.covered(dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True))))
        return pa.table([rows["row"], found], ["row", "found"])

    return take


def sizes(text_bytes: int) -> tuple[int, int]:
    """Bytes of a chunk, and buckets: a full chunk asks a bucket about some 64 hashes at least, at any size.

    Chunks times buckets grow with the square of the input, so both get larger with its root: beyond some 30 GB of text
    a task holds more, 4 GB at 100 TB.
    """
    hashes = text_bytes / 6
    side = math.sqrt(64 * hashes)
    return int(max(CHUNK_BYTES, 6 * side)), max(1, math.ceil(hashes / max(BUCKET_HASHES, side)))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "substring_dedup", width: int = WIDTH, chunk_bytes: int | None = None, buckets: int | None = None) -> DataFrame:
    """``docs`` with ``out``: struct of n_words, n_removed, spans (array of start, length in words) and text.

    Words are runs of characters other than ASCII white space. A window is ``width`` words of one document that follow
    each other. A word goes if a window covers it whose words also follow each other in a document with a smaller id;
    ``spans`` are the maximal runs of such words, ``text`` the others, one space between. Windows are those of the
    input: what was removed elsewhere still counts.

    Chunks of documents are written as a table. Each hashes its windows (two Rabin-Karp hashes: 64 bits and a bucket)
    and asks each bucket about its kinds of windows, each kind once, so a passage that a third of all documents share is
    asked about once a chunk. A bucket counts: is the window in a smaller id? Its answers, one bit each, meet the
    chunk again. Hashes are shuffled once, chunks once, compressed. ``chunk_bytes`` and ``buckets`` follow from the bytes of all texts
    (``sizes``). Two different windows must agree in 64 bits inside one bucket to be taken for each other: windows x bucket /
    2^65 of them are expected, far below one up to terabytes and a few at 100 TB.

    Ids are integers; rows with null ids neither lose words nor make others lose them. Null texts have no words and an empty text;
    empty, blank and short ones have no window. Rows of one id are no earlier ones to each other; repeated rows get
    equal results. Long texts are read whole, in memory in proportion to one text. An empty table gives no rows; extra
    columns stay, whatever their names; one named ``out`` is replaced.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(out)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
    chunk, parts = sizes(total)
    chunk, parts = chunk_bytes or chunk, buckets or parts
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    at = docs.columns.index(text)
    chunks = materialize(rows.mapInArrow(_chunks(chunk), "chunk string, rows binary"))
    asked = chunks.mapInArrow(_ask(at, parts, width), "bucket int, chunk string, hashes binary, n_ids int, ids binary, counts binary")
    said = asked.groupBy("bucket").applyInArrow(_answer, "bucket int, chunk string, bits binary")
    found = StructType.fromDDL("n_words bigint, n_removed bigint, spans array<struct<start: bigint, length: bigint>>, text string")
    result = StructType([StructField("row", rows.schema["row"].dataType), StructField("found", found)])
    got = chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(_take(at, parts, width), result)
    return got.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)], F.col("found").alias(out))
