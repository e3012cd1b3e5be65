"""Merkle manifest of a dataset in a van Emde Boas layout.

Rows are leaves; each tree (a language, a source, a shard) has its own root, and the
roots form one more tree. Leaves get their rank by a range sort and a small table of
counts by task. Aligned subtrees of 2**HEIGHT leaves become blocks, one row each, whose
nodes are stored by recursive splits at half height: the upper half first, then each
lower subtree, laid out alike. `address` finds any node of a block by arithmetic, so
building, sibling retrieval and proofs need no pointers, and a walk from leaf to root
touches few stretches of memory whatever the size of a cache line. Block roots are the
leaves of the next layer, until a tree fits one block.

A proof is read top down: the siblings above each block are found once for the block
and handed to its children, so a leaf's proof needs its own block and one short path.
No node list, and nothing that grows with the rows, reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrid.llm.common import cut, done, sent_whole, table

#: A block holds the subtree over 2**HEIGHT leaves.
HEIGHT = 8
#: Bytes of a digest.
DIGEST = 32


def address(levels: int, depth: int, index: np.ndarray | int) -> np.ndarray | int:
    """Where the nodes `index` of a depth stand in a complete tree of so many levels."""
    at = index * 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        at = at + ((1 << top) - 1) + (index >> depth) * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return at


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_height(total: int) -> int:
    """Levels of hashing in the blocks of a layer of `total` nodes: all that are left, HEIGHT at most."""
    return min(HEIGHT, (int(total) - 1).bit_length())


def built(digests: list[str], height: int) -> bytes:
    """The nodes over the digests, in layout order; places of absent nodes are zero."""
    nodes = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
    level = digests
    for depth in range(height, -1, -1):
        nodes[address(height + 1, depth, np.arange(len(level)))] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
        if depth:
            level = [sha(level[i] + level[i + 1]) if i + 1 < len(level) else sha(level[i]) for i in range(0, len(level), 2)]
    return nodes.tobytes()


def path(nodes: bytes, leaves: int, height: int, leaf: int) -> bytes:
    """Siblings of a leaf, bottom up: L or R by the side it stands on, then the digest; N where there is none."""
    out = []
    for level in range(height):
        own = leaf >> level
        other = own ^ 1
        if other < (leaves + (1 << level) - 1) >> level:
            at = address(height + 1, height - level, other) * DIGEST
            out.append((b"L" if own & 1 else b"R") + nodes[at : at + DIGEST])
        else:
            out.append(b"N")
    return b"".join(out)


def steps(proof: bytes) -> Iterator[tuple[str, str]]:
    """(side, digest as hex text or nothing) of each level of a path."""
    at = 0
    while at < len(proof):
        side = chr(proof[at])
        size = 0 if side == "N" else DIGEST
        yield side, proof[at + 1 : at + 1 + size].hex()
        at += 1 + size


def folded(digest: str, proof: bytes) -> str:
    """The root that a leaf's digest and its path give."""
    for side, other in steps(proof):
        digest = sha(other + digest if side == "L" else digest + other)
    return digest


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value: no two rows give one text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def tree_name(value: Column) -> Column:
    """A text that orders trees: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `rank` (from 0, in its tree) and `total` (rows of the tree), by the column tree and the order given; equal rows take any order.

    Rows are dealt by ranges of the whole order, so a tree that holds most rows is spread like any other.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = cut(sorted_rows.select("*", F.spark_partition_id().alias("part_"), place.alias("place_")))
    counts = placed.groupBy("tree", "part_").agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    before = Window.partitionBy("tree").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        counts.select(
            "tree", "part_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("offset_"), F.sum("n_").over(Window.partitionBy("tree")).alias("total")
        )
    )
    found = placed.join(sent_whole(offsets, F.octet_length("tree") + 24), ["tree", "part_"])
    return found.select(*rows.columns, (F.col("offset_") + F.col("place_")).alias("rank"), "total")


BLOCKS = "tree string, block long, total long, leaves int, nodes binary, root string"


def blocks(nodes: DataFrame) -> DataFrame:
    """The blocks over nodes (tree, rank, digest, total)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        total = int(rows["total"].iloc[0])
        stored = built(rows["digest"].tolist(), block_height(total))
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "block": [int(rows["block"].iloc[0])], "total": [total], "leaves": [len(rows)], "nodes": [stored], "root": [stored[:DIGEST].hex()]})

    return nodes.select("tree", F.shiftright("rank", HEIGHT).alias("block"), "rank", "digest", "total").groupBy("tree", "block").applyInPandas(build, BLOCKS)


def layers(nodes: DataFrame) -> list[DataFrame]:
    """Written block tables, the one over the given nodes first. A tree's last layer has one block of it."""
    out = []
    most = 2
    while most > 1:
        out.append(cut(blocks(nodes)))
        left = out[-1].where(F.col("total") > 1 << HEIGHT)
        nodes = left.select("tree", F.col("block").alias("rank"), F.col("root").alias("digest"), F.expr(f"(total + {(1 << HEIGHT) - 1}) div {1 << HEIGHT}").alias("total"))
        most = nodes.agg(F.max("total")).first()[0] or 0
    return out


def tops(found: list[DataFrame]) -> DataFrame:
    """tree, root of every tree."""
    out = None
    for layer in found:
        top = layer.where(F.col("total") <= 1 << HEIGHT).select("tree", "root")
        out = top if out is None else out.unionByName(top)
    return out


def descended(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, block, above (binary) for the blocks of the first layer: the path from each block's root up; above has (tree, above) of the trees' roots."""

    def hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                height = block_height(r.total)
                yield pd.DataFrame(
                    {
                        "tree": r.tree,
                        "block": (int(r.block) << HEIGHT) + np.arange(r.leaves),
                        "above": [path(r.nodes, r.leaves, height, i) + r.above for i in range(r.leaves)],
                    }
                )

    known = None
    for k in reversed(range(len(found))):
        # A tree begins at the layer where one block holds it.
        start = found[k].where(F.col("total") <= 1 << HEIGHT).select("tree", "block").join(above, "tree")
        known = start if known is None else start.unionByName(known)
        if k:
            rows = found[k].select("tree", "block", "total", "leaves", "nodes").join(known, ["tree", "block"])
            known = rows.where("leaves > 0").mapInPandas(hand_down, "tree string, block long, above binary")
    return known


@dataclass
class Manifest:
    """leaves: (tree, digest, total, rank and what else the leaves had); subtrees, roots: block tables by layer; above: (tree, subroot, above); root."""

    leaves: DataFrame
    subtrees: list[DataFrame]
    roots: list[DataFrame]
    above: DataFrame
    root: str | None


def manifest(leaves: DataFrame, *order: str) -> Manifest:
    """The manifest of leaves (tree, digest, the order columns and any others). No leaves: no blocks, and root is None."""
    placed = cut(ranked(leaves, *order))
    subtrees = layers(placed)
    names = cut(ranked(tops(subtrees).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), "name"))
    roots = layers(names)
    first = tops(roots).first()
    over = descended(roots, roots[0].sparkSession.createDataFrame([("", bytearray())], "tree string, above binary"))
    return Manifest(placed, subtrees, roots, cut(paths(roots[0], over, names.withColumnRenamed("digest", "subroot"), ["name", "subroot"])), first["root"] if first else None)


def paths(lowest: DataFrame, above: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep and `above`, the whole path, of rows (tree, rank, ...): siblings by address in the row's block of the lowest layer, then what stands above the block."""
    names = dict(rows.dtypes)
    types = [names[c] for c in keep]
    texts = rows.select("tree", F.shiftright("rank", HEIGHT).alias("block"), "rank", *(F.col(c).cast("string").alias(f"k{i}_") for i, c in enumerate(keep)))

    def look_up(wanted: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = wanted[[f"k{i}_" for i in range(len(keep))]].copy()
        if len(block):
            b = block.iloc[0]
            height = block_height(b["total"])
            out["above"] = [path(b["nodes"], int(b["leaves"]), height, int(r) & ((1 << HEIGHT) - 1)) + b["above"] for r in wanted["rank"]]
        else:
            out["above"] = pd.Series(dtype=object)
        return out

    stored = lowest.select("tree", "block", "total", "leaves", "nodes").join(above, ["tree", "block"])
    found = texts.groupBy("tree", "block").cogroup(stored.groupBy("tree", "block")).applyInPandas(look_up, ", ".join(f"k{i}_ string" for i in range(len(keep))) + ", above binary")
    # Ids pass as text, so that nulls stay apart and no digit is lost.
    return found.select(*(F.col(f"k{i}_").cast(t).alias(c) for i, (c, t) in enumerate(zip(keep, types, strict=True))), "above")


def proofs(found: Manifest, keep: list[str]) -> DataFrame:
    """keep (columns of the leaves), tree, subroot and `above` of every leaf: its whole path to the root."""
    tree_paths = found.above.select(F.col("name").alias("tree"), "subroot", "above")
    below = descended(found.subtrees, tree_paths.select("tree", "above"))
    of = paths(found.subtrees[0], below, found.leaves, ["tree", *keep])
    return of.join(sent_whole(tree_paths.select("tree", "subroot"), F.octet_length("tree") + 64), "tree")


def fold(digest: Column, above: str = "above") -> Column:
    """The root that a digest and a path give."""

    @F.pandas_udf("string")
    def of(digests: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([folded(d, p) for d, p in zip(digests, paths, strict=True)], dtype=object)

    return of(digest, above)


def path_digest(above: str = "above") -> Column:
    """H of the siblings of a path."""

    @F.pandas_udf("string")
    def of(paths: pd.Series) -> pd.Series:
        return pd.Series([sha("".join(other for _, other in steps(p))) for p in paths], dtype=object)

    return of(above)


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (doc_id, source, lang, n_chars, text).

    One tree a lang, null first; leaves by doc_id, a null one first, and by their digest among equal ids. Tampering
    adds 1 to n_chars where 7 divides the id's crc32: not for a null n_chars or id. Repeated rows are leaves each,
    and their proofs are dealt among them; texts of any length, null and empty ones are told apart; other columns
    are ignored; an empty table gives no rows.
    """
    values = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = values | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)")}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(tree_name(F.col("lang")).alias("tree"), "doc_id", leaf(*values.values()).alias("digest"), F.when(hit, leaf(*more.values())).alias("tampered"))
    found = manifest(leaves, "doc_id", "digest")
    rows = proofs(found, ["doc_id", "digest", "tampered"])
    root = F.lit(found.root)
    out = rows.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        path_digest().alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(({c})::varchar)) || ':' || ({c})::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP11_SQL = rf"""
with recursive crcs as (
  select doc_id, coalesce('=' || lang, '') as tree, {_leaf("n_chars")} as leaf, {_leaf("n_chars + 1")} as other, n_chars,
    list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i + 1, 1))::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from documents
), leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from crcs
), nodes as (
  select tree, 0 as level, idx, leaf as h, n from leaves
  union all
  select tree, level + 1, idx >> 1, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from nodes where n > 1 group by tree, level, idx >> 1, n
), subroots as (
  select tree, level as height, h, row_number() over (order by tree) - 1 as idx, count(*) over () as n from nodes where n = 1
), upper_nodes as (
  select 0 as level, idx, h, n from subroots
  union all
  select level + 1, idx >> 1, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from upper_nodes where n > 1 group by level, idx >> 1, n
), top as (
  select level as height, h from upper_nodes where n = 1
), sides as (
  select l.doc_id, l.leaf, l.tree, l.idx, u.level, case when s.h is null then 'N' when (l.idx >> u.level) & 1 = 1 then 'L' || s.h else 'R' || s.h end as side
  from leaves l join subroots r on l.tree = r.tree, unnest(range(r.height)) u(level)
  left join nodes s on s.tree = l.tree and s.level = u.level and s.idx = xor(l.idx >> u.level, 1)
), upper_sides as (
  select r.tree, u.level, case when s.h is null then 'N' when (r.idx >> u.level) & 1 = 1 then 'L' || s.h else 'R' || s.h end as side
  from subroots r, top t, unnest(range(t.height)) u(level) left join upper_nodes s on s.level = u.level and s.idx = xor(r.idx >> u.level, 1)
), lower_paths as (select tree, idx, list(side order by level) as sides from sides group by all),
upper_paths as (select tree, list(side order by level) as sides from upper_sides group by all),
proofs as (
  select l.doc_id, l.leaf, r.h as subroot, t.h as root, case when xor(l.crc, 4294967295) % 7 = 0 and l.n_chars is not null then l.other else l.leaf end as shown,
    list_concat(coalesce(p.sides, []::varchar[]), coalesce(q.sides, []::varchar[])) as sides
  from leaves l join subroots r on l.tree = r.tree cross join top t left join lower_paths p on l.tree = p.tree and l.idx = p.idx left join upper_paths q on l.tree = q.tree
), folds as (
  select *, list_reduce(list_prepend(shown, sides), lambda h, s: sha256(case when s[1] = 'L' then s[2:] || h else h || s[2:] end)) as folded_root from proofs
)
select doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(sides, lambda s: s[2:]), 'string_agg', ''), '')) as proof_sha256,
  folded_root, folded_root = root as verified from folds
"""
