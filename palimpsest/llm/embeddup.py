"""Operator 9: embedding near-dedup by inverted lists with product-quantised residuals and exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import Scratch, components, materialize

COSINE = 0.98
#: Vectors that centroids and codebooks are fitted on, about: so many, or four a list if that is more (a hash picks them,
#: one task fits them); every vector is indexed.
TRAIN_ROWS, TRAIN_PER_LIST = 8_000, 4
#: Vectors for each inverted list aimed at, lists at most (their centroids are broadcast: 32 MB at 64 dimensions), subspaces
#: and codewords of a residual, vectors of a block.
PER_LIST, MAX_LISTS, SUBSPACES, CODES, BLOCK = 400, 65_536, 8, 64, 512
#: Lists that are fitted at once; more are fitted within clusters of the sample.
FLAT_LISTS = 1_024
#: Distances that are held at once.
CELLS = 1 << 22
#: What rounding to single precision can add to a distance of unit vectors, with room to spare.
SLACK = 1e-5


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach_of(cosine: float) -> float:
    """The largest distance of two unit vectors with that cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half, rows = 0.5 * (c**2).sum(1), max(1, CELLS // len(c))
    return np.concatenate([(x[i : i + rows] @ c.T - half).argmax(1) for i in range(0, len(x), rows)] or [np.zeros(0, int)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _coarse(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids, about; many of them are those of clusters within clusters, so the work is rows x root of k."""
    if k <= FLAT_LISTS:
        return _kmeans(x, k, rng)
    top = _kmeans(x, int(np.sqrt(k)), rng)
    a = _nearest(x, top)
    return np.vstack([_kmeans(own, max(1, round(k * len(own) / len(x))), rng) for own in (x[a == i] for i in range(len(top))) if len(own)])


@dataclass
class Index:
    """Coarse centroids and codebooks of residuals, both of fixed size."""

    centroids: np.ndarray  # (lists, dims)
    books: np.ndarray  # (subspaces, codes, dims / subspaces)
    reach: float  # largest distance of two unit vectors that are linked

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, cosine: float, seed: int = 3) -> Index:
        rng = np.random.default_rng(seed)
        pad = -sample.shape[1] % SUBSPACES
        x = np.pad(_unit(sample), ((0, 0), (0, pad)))
        c = _coarse(x, lists, rng)
        res = x - c[_nearest(x, c)]
        parts = res.reshape(len(x), SUBSPACES, -1)
        books = [_kmeans(parts[:, s], CODES, rng) for s in range(SUBSPACES)]
        n = min(map(len, books))
        return cls(c, np.array([b[:n] for b in books]), reach_of(cosine))

    def stack(self, vectors: pd.Series) -> np.ndarray:
        """Vectors as rows in double precision, filled up with zeros to the width of the centroids."""
        out = np.zeros((len(vectors), self.centroids.shape[1]))
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
        return out

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists to search for each unit vector, its own first.

        For linked x and y with nearest centroids c and d, the gaps |x-d|^2 - |x-c|^2 and |y-c|^2 - |y-d|^2 sum to
        2 (x-y).(d-c), at most 2 reach |c-d|: so one of the two has a gap of reach |c-d| at most, and a search of all
        lists within that gap finds every link from one side or the other.
        """
        out: list[np.ndarray] = []
        c, c2 = self.centroids, (self.centroids**2).sum(1)
        rows = max(1, min(256, CELLS // len(c)))
        for s in range(0, len(x), rows):
            d2 = c2 - 2 * x[s : s + rows] @ c.T
            own, at = d2.argmin(1), np.arange(len(d2))
            lists, back = np.unique(own, return_inverse=True)
            between = np.sqrt(np.maximum(c2[lists, None] - 2 * c[lists] @ c.T + c2, 0.0))
            near = d2 - d2[at, own][:, None] <= self.reach * between[back] + 1e-7
            near[at, own] = False
            out += [np.concatenate([[o], np.flatnonzero(n)]).astype(np.int32) for o, n in zip(own, near, strict=True)]
        return out

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to the vectors' lists, and the distance between vector and decoded vector."""
        parts = (x - self.centroids[own]).reshape(len(x), SUBSPACES, -1)
        codes, error = np.zeros((len(x), SUBSPACES), np.uint8), np.zeros(len(x))
        for s in range(SUBSPACES):
            d = (parts[:, s] ** 2).sum(1)[:, None] - 2 * parts[:, s] @ self.books[s].T + (self.books[s] ** 2).sum(1)
            codes[:, s] = d.argmin(1)
            error += ((parts[:, s] - self.books[s][codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def near(self, q: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which coded vectors of list ``at`` may be linked with each exact query: asymmetric distances summed from lookup tables.

        A vector lies within its error of the decoded one, so no link is lost.
        """
        parts = (q - self.centroids[at]).reshape(len(q), SUBSPACES, -1)
        total = np.zeros((len(q), len(codes)))
        for s in range(SUBSPACES):
            table = ((parts[:, s, None, :] - self.books[s]) ** 2).sum(2)
            total += table[:, codes[:, s]]
        return total <= (self.reach + error[None, :] + SLACK) ** 2


def _star(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of the edges (a, b): (node, least node)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        u, v = find(u), find(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
    return [(x, find(x)) for x in list(parent) if find(x) != x]


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per row of ``vectors``: (vec_id, n_links, component_id, kept).

    Vectors of equal non-null label and equal length are linked if their cosine, in double precision, is at least
    ``cosine``. ``n_links`` counts the other rows linked directly; ``component_id`` is the least vec_id reachable by
    links, the row's own included; ``kept`` marks it. Vectors that are null, empty or zero, or hold null, NaN or
    infinite components, and those without label, link with nothing. Rows with equal label and components are one
    class, compared once and counted as often as they occur. Rows with a null vec_id link with nothing and are kept. A
    vec_id that occurs with several vectors names a row of its own each time. An empty table gives no rows; extra columns
    are ignored.

    Every class is put into the list of its nearest centroid, coded once with its error, and searches the lists within a
    proven margin, so recall is complete (``Index.probes``). Lists are cut into blocks of ``BLOCK`` vectors by hash, and
    pairs of blocks are dealt to tasks one by one, however hot a list is. The table lookups leave the few vectors that
    may be linked; these alone fetch their exact components, block by block, for the cosines. A task returns a count for
    each query and a star for each component, never the pairs.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    largest = F.aggregate("v", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("v").isNotNull() & finite & (largest > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # scaled by the largest component first, so that squares neither vanish nor overflow
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.transform("v", lambda x: x / largest)))
    rows = materialize(rows.withColumn("v", F.when(F.col("v").isNotNull(), F.transform("v", lambda x: x / F.sqrt(norm2)))))
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("vec"), F.count("*").alias("m"))
    with Scratch(spark) as first:
        classes = first.write(classes.withColumn("h", F.xxhash64("label", "v")))
        # of the classes that share their least vec_id all but one are nodes under a number of their own
        twice = classes.groupBy(F.col("vec").alias("vec2")).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
        node = F.when(F.col("lo").isNull() | (F.col("h") == F.col("lo")), F.col("vec")).otherwise(F.shiftright("h", 2) + F.lit(1 << 62))
        classes = materialize(classes.join(twice, F.col("vec") == F.col("vec2"), "left").select("label", "v", "vec", "m", node.alias("id")))
    lone = rows.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    n, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()  # vectors of other lengths are filled up with zeros
    if not n:
        return lone.withColumn("kept", F.lit(True))
    lists = int(min(MAX_LISTS, max(1, n // PER_LIST)))
    wanted = max(train_rows, TRAIN_PER_LIST * lists)
    cut = int(1e9 * min(1.0, wanted / n))
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < F.lit(max(cut, 1))).select("v").limit(2 * wanted)
    sample = classes.select("v").limit(1) if sample.isEmpty() else sample

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = pd.concat([batch["v"] for batch in batches])
        x = np.zeros((len(vectors), dims))
        for row, v in zip(x, vectors, strict=True):
            row[: len(v)] = v
        index = Index.fit(x[np.lexsort(x.T)], min(lists, len(x)), cosine)
        yield pd.DataFrame({"book": -1, "v": list(index.centroids)})
        for s, book in enumerate(index.books):
            yield pd.DataFrame({"book": s, "v": list(book)})

    fitted = sample.coalesce(1).mapInPandas(fit, "book int, v array<double>").toArrow().to_pandas()
    centroids, *books = (np.vstack(fitted["v"][fitted["book"] == s].to_numpy()) for s in range(-1, SUBSPACES))
    shared = spark.sparkContext.broadcast(Index(centroids, np.array(books), reach_of(cosine)))

    @F.pandas_udf("probes array<int>, codes binary, error double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            x = index.stack(batch)
            lists = index.probes(x)
            codes, error = index.encode(x, np.array([p[0] for p in lists], int))
            yield pd.DataFrame({"probes": lists, "codes": [c.tobytes() for c in codes], "error": error})

    with Scratch(spark) as tmp:
        placed = classes.withColumn("d", F.size("v")).withColumn("p", place("v")).select("label", "v", "vec", "m", "id", "d", "p.*")
        placed = tmp.write(placed)
        asks = placed.select("label", "d", F.posexplode("probes").alias("pos", "at"))
        counts = asks.groupBy("label", "d", "at").agg(F.sum((F.col("pos") == 0).cast("long")).alias("nb"), F.count("*").alias("nq"))
        counts = counts.where("nb > 0 and nq > 1").withColumns({c: F.ceil(F.col(c) / BLOCK).cast("int") for c in ("nb", "nq")})
        list_key, cell = ["label", "d", "at"], ["label", "d", "at", "bb", "qb"]
        block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        base = placed.select("label", "d", F.element_at("probes", 1).alias("at"), "id", "codes", "error").join(counts, list_key)
        base = base.select(*list_key, block("nb").alias("bb"), every("nq").alias("qb"), F.lit(True).alias("base"), "id", "codes", "error", F.lit(None).cast("array<float>").alias("q"))
        query = placed.select("label", "d", F.explode("probes").alias("at"), "id", F.col("v").cast("array<float>").alias("q")).join(counts, list_key)
        query = query.select(*list_key, every("nb").alias("bb"), block("nq").alias("qb"), F.lit(False).alias("base"), "id", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), "q")

        def look(group: pd.DataFrame) -> pd.DataFrame:
            index, base = shared.value, group["base"].to_numpy()
            b, q = group[base], group[~base]
            kept = np.zeros(len(group), bool)
            if len(b) and len(q):
                codes = np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), SUBSPACES)
                near = index.near(index.stack(q["q"]), int(group["at"].iloc[0]), codes, b["error"].to_numpy())
                near &= q["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
                kept[np.flatnonzero(base)], kept[np.flatnonzero(~base)] = near.any(0), near.any(1)
            return group.loc[kept, [*cell, "base", "id"]]

        left = base.unionByName(query).repartition(*cell).groupBy(*cell).applyInPandas(look, base.select(*cell, "base", "id").schema)
        left = tmp.write(left)

        def search(group: pd.DataFrame) -> pd.DataFrame:
            index, at = shared.value, int(group["at"].iloc[0])
            b, q = group[group["base"]], group[~group["base"]]
            out: list[tuple[int, int, int | None]] = []
            i, j = np.nonzero(index.stack(q["v"]) @ index.stack(b["v"]).T >= cosine)
            qi, bi = q["id"].to_numpy()[i], b["id"].to_numpy()[j]
            i, j, qi, bi = (z[qi != bi] for z in (i, j, qi, bi))
            if i.size:
                ids, where = np.unique(qi, return_inverse=True)
                sums = np.bincount(where, weights=b["m"].to_numpy()[j])
                count = {int(k): int(c) for k, c in zip(ids, sums, strict=True)}
                # the other direction counts here only where that vector doesn't search this query's own list
                n_lists = len(index.centroids)
                searched = np.concatenate([row * n_lists + p.astype(np.int64) for row, p in enumerate(b["probes"])])
                own = np.array([p[0] for p in q["probes"]], np.int64)[i]
                on = (own != at) & ~np.isin(j * n_lists + own, searched)
                ids, where = np.unique(bi[on], return_inverse=True)
                for k, c in zip(ids, np.bincount(where, weights=q["m"].to_numpy()[i[on]]), strict=True):
                    count[int(k)] = count.get(int(k), 0) + int(c)
                out += [(k, c, None) for k, c in count.items()]
                out += [(a, 0, r) for a, r in _star(qi, bi)]
            return pd.DataFrame(out, columns=["id", "n", "root"]).astype({"id": "int64", "n": "int64", "root": "Int64"})

        exact = left.join(placed.select("id", "v", "m", "probes"), "id").repartition(*cell).groupBy(*cell).applyInPandas(search, "id bigint, n bigint, root bigint")
        found = materialize(exact)
        roots = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    ids = classes.select("id", "vec", "m")
    named = ids.join(roots, F.col("id") == F.col("node"), "left").select("id", "vec", "m", F.coalesce("root", "id").alias("root"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("vec").alias("component_id"))
    per = named.join(least, F.col("root") == F.col("r")).join(sums, "id", "left")
    per = per.select("id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    per = classes.select("id", F.col("label").alias("l"), F.col("v").alias("w")).join(per, "id")
    linked = rows.where("v is not null").join(per, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("vec_id", "n_links", "component_id")
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
