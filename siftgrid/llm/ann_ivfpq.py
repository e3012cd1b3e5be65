"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and code books are fitted on at most `sample_rows` vectors, the
ones of smallest id hash (a documented bound). Every valid vector is then coded by
the list of its nearest centroid and the code of its residual, with its coding error:
its distance from what the code stands for.

A query goes to the lists of its nearest centroids, as many as hold `cover` of the
true neighbours of sampled queries inside the sample, and further ones until they
hold enough vectors for k answers. Vectors are shuffled once, by list, and queries
once for each list they probe. A long list is dealt by hash into parts of about
`part_rows` vectors, the queries of a list into blocks, so a task holds one part and
one block however many rows or queries share a list.

In a task a query's distance table is looked up for the codes. By the triangle
inequality a true distance differs from the looked-up one by the coding error at
most; so every vector that may be among the part's nearest k is measured exactly, in
double precision on the original vectors, without a bound on how many those are. A
last aggregation keeps the nearest k of all parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrid.llm.common import cut, table

FOUND = "query_id long, vec_id long, score double"
#: Cells of a table of queries by vectors, and numbers in a table of exact differences, that are held at a time.
CELLS, NUMBERS = 1 << 20, 1 << 21


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances up to a constant of each row of x."""
    return (c * c).sum(axis=1) - 2 * (x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    rows = max(1, CELLS // len(c))
    return np.concatenate([np.argmin(squared(x[i : i + rows], c), axis=1) for i in range(0, len(x), rows)] or [np.empty(0, np.int64)])


def kmeans(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(steps):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    center: np.ndarray  # taken off every vector first, so far-off data lose no digits
    centroids: np.ndarray  # lists x dimension
    books: list[np.ndarray]  # for each part of a vector: up to 256 x its width
    edges: list[int]
    probes: int

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each row; x is off the center."""
        at = nearest(x, self.centroids)
        rest = x - self.centroids[at]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            a, b = self.edges[m], self.edges[m + 1]
            codes[:, m] = nearest(rest[:, a:b], book)
            rest[:, a:b] -= book[codes[:, m]]
        return at, codes, np.sqrt((rest * rest).sum(axis=1))

    def routes(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[np.ndarray]:
        """The lists that each query probes."""
        order = np.argsort(squared(q, self.centroids), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        needed = np.minimum((held < enough).sum(axis=1) + 1, len(sizes))
        return [row[: max(self.probes, n)] for row, n in zip(order, needed, strict=True)]

    def looked_up(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries from what the codes of one list (a row a part) stand for, by tables of the parts of a distance."""
        rest, total = q - self.centroids[at], np.zeros((len(q), codes.shape[1]), np.float32)
        found = np.empty_like(total)
        for m, book in enumerate(self.books):
            part = rest[:, None, self.edges[m] : self.edges[m + 1]] - book[None]
            np.take((part * part).sum(axis=2).astype(np.float32), codes[m], axis=1, out=found, mode="clip")
            total += found
        return np.sqrt(total)


def valid(vectors: pd.Series, dimension: int | None = None) -> np.ndarray:
    """Which vectors take part: not null, no null or non-finite component, not zero, of the dimension."""

    def fine(v: object) -> bool:
        if v is None or np.ndim(v) != 1:
            return False
        a = np.asarray(v, float)
        return len(a) > 0 and (dimension is None or len(a) == dimension) and bool(np.isfinite(a).all()) and bool(a.any())

    return np.array([fine(v) for v in vectors], bool)


def fit(
    vectors: DataFrame, sample_rows: int = 16_384, lists: int | None = None, width: int = 2, cover: float = 0.97, seed: int = 3
) -> Index | None:
    """An index from a bounded sample of vectors (vec_id, vector), one row an id; None if no vector is valid.

    The dimension is the commonest one of the sample; vectors of another take no part.
    """
    n = vectors.count()
    share = min(1.0, 2 * sample_rows / max(1, n))
    some = vectors.where((F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("vector").isNotNull())
    drawn = some.orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)), "vec_id").limit(sample_rows).toPandas()["vector"]
    drawn = drawn[valid(drawn)]
    if not len(drawn):
        return None
    dimension = int(drawn.map(len).mode().min())
    x = np.stack([np.asarray(v, float) for v in drawn if len(v) == dimension])
    center = x.mean(axis=0)
    x -= center
    rng = np.random.default_rng(seed)
    k = lists or int(min(max(1, sample_rows // 16), max(1, 2 ** round(math.log2(math.sqrt(n) / 2 + 1)))))
    centroids = kmeans(x, k, 10, rng)
    near = nearest(x, centroids)
    rest = x - centroids[near]
    edges = [*range(0, dimension, width), dimension]
    part = rest[rng.choice(len(rest), min(len(rest), 8192), replace=False)]
    books = [kmeans(part[:, a:b], min(256, len(part)), 6, rng) for a, b in zip(edges, edges[1:], strict=False)]
    asked = rng.choice(len(x), min(len(x), 256), replace=False)
    rank = np.argsort(np.argsort(squared(x[asked], centroids), axis=1), axis=1)
    far = squared(x[asked], x)
    far[np.arange(len(asked)), asked] = np.inf
    best = np.argpartition(far, min(10, len(x) - 1), axis=1)[:, :10] if len(x) > 10 else np.tile(np.arange(len(x)), (len(asked), 1))
    needed = np.sort(rank[np.arange(len(asked))[:, None], near[best]].ravel())
    return Index(center, centroids, books, edges, int(needed[math.ceil(cover * len(needed)) - 1]) + 1)


def coded(vectors: DataFrame, index: Index) -> DataFrame:
    """vec_id, vec (bytes, as precise as the column), list, code, error of every valid vector."""
    kind = "<f8" if "double" in dict(vectors.dtypes)["vector"] else "<f4"
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for b in batches:
            b = b[valid(b["vector"], ix.dimension) & b["vec_id"].notna().to_numpy()]
            for i in range(0, len(b), 4096):
                part = b.iloc[i : i + 4096]
                x = np.stack([np.asarray(v, kind) for v in part["vector"]])
                at, codes, error = ix.code(x - ix.center)
                yield pd.DataFrame({"vec_id": part["vec_id"].astype("int64"), "vec": [v.tobytes() for v in x], "list": at, "code": [c.tobytes() for c in codes], "error": error})

    return vectors.mapInPandas(run, "vec_id long, vec binary, list int, code binary, error double")


def nearest_in(part: pd.DataFrame, asked: pd.DataFrame, index: Index, kind: str, k: int) -> pd.DataFrame:
    """The exact k nearest rows of one list for each query: query_id, vec_id, score."""
    part = part.sort_values("vec_id")
    ids, error, at = part["vec_id"].to_numpy(), part["error"].to_numpy(), int(part["list"].iloc[0])
    x = np.frombuffer(b"".join(part["vec"]), kind).reshape(len(part), -1)
    codes = np.ascontiguousarray(np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1).T, np.intp)
    who = asked["query_id"].to_numpy()
    q = np.frombuffer(b"".join(asked["vec"]), kind).reshape(len(asked), -1).astype(float)
    out, rows, pairs = [], max(1, CELLS // max(len(part), 256 * 8)), max(1, NUMBERS // x.shape[1])
    for i in range(0, len(q), rows):
        near = index.looked_up(q[i : i + rows] - index.center, at, codes)
        slack = 1e-5 * near + 1e-9  # for rounding
        most = near + error + slack
        own = ids[None] == who[i : i + rows, None]
        most[own] = np.inf
        reach = np.partition(most, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(near), np.inf)
        a, b = np.nonzero((near - error - slack <= reach[:, None]) & ~own)
        exact = np.empty(len(a))
        for j in range(0, len(a), pairs):
            d = x[b[j : j + pairs]].astype(float) - q[i + a[j : j + pairs]]
            exact[j : j + pairs] = np.sqrt((d * d).sum(axis=1))
        order = np.lexsort((ids[b], exact, a))
        a, b, exact = a[order], b[order], exact[order]
        first = np.searchsorted(a, a)
        kept = np.arange(len(a)) - first < k
        out.append(pd.DataFrame({"query_id": who[i + a[kept]], "vec_id": ids[b[kept]], "score": exact[kept]}))
    return pd.concat(out)


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    part_rows: int = 16_384,
    block_rows: int = 4096,
    **settings,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row of vectors (vec_id, vector) that `queries` holds for.

    Rows repeated under one id are one vector (of several under an id, the
    smallest). Null, zero, non-finite and differently long vectors and rows
    without an id take no part, as query or candidate. A query has k answers, or
    all candidates if there are fewer. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    once = cut(vectors.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    index = fit(once, **settings)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "<f8" if "double" in dict(once.dtypes)["vector"] else "<f4"
    rows = cut(coded(once, index))
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vec")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in rows.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    shared = spark.sparkContext.broadcast(index)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i : i + 1024]
                if len(part):
                    q = np.frombuffer(b"".join(part["vec"]), kind).reshape(len(part), -1) - ix.center
                    lists = ix.routes(q, sizes, k + 1)
                    n = [len(x) for x in lists]
                    yield pd.DataFrame({"query_id": part["query_id"].repeat(n), "vec": part["vec"].repeat(n), "list": np.concatenate(lists)})

    sent = cut(asked.mapInPandas(routed, "query_id long, vec binary, list int"))
    # Parts of a list's vectors and blocks of its queries, as many as keep a task small; one row a list.
    probing = {r["list"]: r["count"] for r in sent.groupBy("list").count().collect()}
    split = spark.createDataFrame([(i, max(1, math.ceil(n / part_rows)), max(1, math.ceil(probing.get(i, 0) / block_rows))) for i, n in enumerate(sizes.tolist())], "list int, parts int, blocks int")
    split = F.broadcast(split)  # at most sample_rows / 16 rows
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = rows.join(split, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("block", upto("blocks"))
    blocked = sent.join(split, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", upto("parts"))

    def find(key: tuple, part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return nearest_in(part, asked, shared.value, kind, k)

    by = ["list", "part", "block"]
    found = dealt.select(*by, "vec_id", "vec", "code", "error").groupBy(*by).cogroup(blocked.select(*by, "query_id", "vec").groupBy(*by)).applyInPandas(find, FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search(vectors, F.col("vec_id") % 100 == 0)
