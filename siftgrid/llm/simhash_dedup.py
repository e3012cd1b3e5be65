"""SimHash near-duplicates: segment counts, a grid range join, an exact check.

A fingerprint is cut into 32 segments of two bits; the bit count of each is a
coordinate. Flipping a bit of the fingerprint moves one coordinate by one, so the
Manhattan distance of two points never exceeds the Hamming distance of their
fingerprints, and a pair farther apart than `radius` can be dropped unseen.

The range join deals the coordinates into `blocks` blocks. Two points within
`radius` agree in all but `radius` blocks at least, so they share a grid cell over
some choice of `blocks - radius` blocks; each point goes into its cell under every
choice, and an equi-join on (choice, cell) brings together all pairs within the
radius. The join condition then applies the Manhattan bound and the exact
Hamming distance, and keeps a pair under the first choice it shares only. The
number of blocks trades copies of a point against chance meetings and is picked
from the number of fingerprints; every setting gives the same links.

Copies with equal fingerprints are one point. Components come from alternating
large-star and small-star steps over the links, each step two shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.llm import common
from siftgrid.llm.common import cut, done, lower_words, table

EVEN = 0x5555555555555555


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """64 bits, unsigned: a bit is set if over half of the shingle hashes have it."""
    found = lower_words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str = "text", shingle: int = 4) -> Column:
    """The fingerprint of a text column as a signed long; null and wordless texts have 0."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def embed(fp: Column) -> Column:
    """All 32 segment counts in one long, each as that many ones: two such longs differ in as many bits as the counts differ."""
    high = F.shiftrightunsigned(fp, 1)
    even = F.lit(EVEN).cast("long")
    return fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))


def choices(blocks: int, radius: int) -> list[int]:
    """Bit masks of the coordinates in each choice of blocks, as signed longs."""
    edges = [round(32 * b / blocks) for b in range(blocks + 1)]
    block = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = (sum(block[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def best_blocks(points: int, radius: int) -> int:
    """The number of blocks with the least work: copies of points, each worth about 20 comparisons, and chance meetings."""

    def work(blocks: int) -> float:
        cells = math.comb(blocks, radius)
        met = cells * 0.375 ** (32 * (blocks - radius) / blocks)
        return 20.0 * cells * points + met * points * points / 2

    return min(range(radius + 2, radius + 6), key=work)


def links(points: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct values in `fp` that differ in at most `radius` bits, each once."""
    masks = choices(blocks or best_blocks(points.count(), radius), radius)
    cells = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("u").bitwiseAND(F.lit(m).cast("long")).alias("cell")) for k, m in enumerate(masks)])
    placed = points.select("fp", embed(F.col("fp")).alias("u")).select("fp", F.inline(cells))
    a, b = placed.alias("a"), placed.alias("b")
    moved = embed(F.col("a.fp")).bitwiseXOR(embed(F.col("b.fp")))
    first = F.lit(len(masks))
    for k in reversed(range(len(masks))):
        first = F.when(moved.bitwiseAND(F.lit(masks[k]).cast("long")) == 0, k).otherwise(first)
    near = (
        (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(moved) <= radius)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
        & (first == F.col("a.choice"))
    )
    return a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node that it reaches.

    Large stars, then small stars, until nothing moves. While the edges are few, counted, the table of
    each node's least neighbour is broadcast, so a node with very many edges meets in no task; beyond
    that Spark splits the joins' skewed sides.
    """
    edges = cut(edges.select("a", "b"))
    known, n = None, edges.count()
    while True:
        whole = F.broadcast if 64 * n <= common.SENT_BYTES else (lambda df: df)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(whole(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(whole(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        done(before, large)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == known:
            break
        known, n = state, state["n"]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def group(docs: DataFrame, radius: int = 4, shingle: int = 4, blocks: int | None = None, row_key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (signed long), component_id of all rows of docs.

    Null and wordless texts have fingerprint 0 and are linked as any other.
    Repeated rows and copies keep a row each. component_id is the smallest
    doc_id of the component; a null doc_id counts only where there is no other.
    With row_key, columns that tell rows apart, these and `first` come too: the
    component's row of smallest doc_id and then key, a null doc_id last.
    Other columns are ignored; an empty table gives no rows.
    """
    marked = cut(docs.select("doc_id", *row_key, fingerprint("text", shingle).alias("fp")))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *row_key) if row_key else F.col("doc_id")
    points = cut(marked.groupBy("fp").agg(F.min(row).alias("first")))
    rooted = cut(components(links(points, radius, blocks)))
    named = points.join(rooted, points["fp"] == rooted["node"]).groupBy("root").agg(F.min("first").alias("least"))
    member = rooted.join(named, "root").select(F.col("node").alias("fp"), "least")
    classes = points.join(member, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))
    found = marked.join(classes, "fp")
    if row_key:
        return found.select("doc_id", *row_key, "fp", F.col("first.doc_id").alias("component_id"), "first")
    return found.select("doc_id", "fp", F.col("first").alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
