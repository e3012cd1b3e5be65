"""op11 against plain Python, the layout's addresses, and odd rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siftgrid.llm import entry_queries, merkle

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The root, and for each leaf its siblings as (side, digest)."""
    above, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            above[i].append(("L" if k & 1 else "R", level[other]) if other < len(level) else ("N", ""))
            at[i] = k >> 1
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], above


def plain(rows):
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        shown = plain_leaf(doc_id, source, lang, n_chars + 1, text) if hit else plain_leaf(doc_id, source, lang, n_chars, text)
        trees.setdefault(lang, []).append((doc_id, plain_leaf(doc_id, source, lang, n_chars, text), shown))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    roots, inner = [], {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        root, inner[name] = plain_tree([r[1] for r in trees[name]])
        roots.append(root)
    top, outer = plain_tree(roots)
    out = []
    for name, subroot, over in zip(names, roots, outer, strict=True):
        for (doc_id, leaf, shown), own in zip(trees[name], inner[name], strict=True):
            h = shown
            for side, other in own + over:
                h = sha(other + h if side == "L" else h + other)
            out.append((doc_id, leaf, subroot, top, sha("".join(x[1] for x in own + over)), h, h == top))
    return out


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, source, lang, n_chars, text from '{SF}/documents.parquet'").fetchall()
    found = [tuple(r) for r in entry_queries.queries()["op11_merkle"](spark, SF).collect()]
    assert Counter(found) == Counter(plain(rows))
    assert {r[6] for r in found} == {True, False}


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int, total string, above string, digest int"


def odd_rows(n):
    rows = [(i * 3 - 50, f"s{i % 4}", None if i % 3 else "", i, f"text {i}") for i in range(n)]
    rows += [(None, None, None, None, None), (None, "s", None, 5, ""), (7, None, "é", None, "-"), (7, "", "é", 9, None), (7, "", "é", 9, None), (2**62 + 1, "s", "z", 2**63 - 1, "word " * 100_000), (2**62 + 2, "s", "Z", 0, " \n\t")]
    return rows + [(i, "x", f"lang{i:04d}", 1, "one") for i in range(600)]


@pytest.mark.parametrize("n", [0, 1, 700])
def test_edges(spark, n):
    """Nulls, empty and long texts, repeated rows, ties, clashing columns, hundreds of trees of one leaf beside a large one."""
    rows = odd_rows(n)
    docs = spark.createDataFrame([(*r, "t", 1, "x", "y", 2) for r in rows], SCHEMA).repartition(5)
    found = [tuple(r) for r in merkle.verified(docs).collect()]
    assert Counter(found) == Counter(plain(rows))


def test_empty(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_addresses():
    """Each place of a block is used once; a subtree of the recursive split fills one stretch, its root first."""
    for levels in range(1, 13):
        at = np.concatenate([merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)])
        assert sorted(at) == list(range((1 << levels) - 1)) and at[0] == 0
        top = levels // 2
        if levels > 1:
            for sub in range(1 << top):
                own = sorted(int(merkle.address(levels, top + d, (sub << d) + i)) for d in range(levels - top) for i in range(1 << d))
                assert own == list(range(own[0], own[0] + (1 << (levels - top)) - 1))
                assert own[0] == merkle.address(levels, top, sub)


def test_paths_of_all_sizes():
    for n in [*range(1, 40), 255, 256]:
        leaves = [sha(str(i)) for i in range(n)]
        height = merkle.block_height(n)
        nodes = merkle.built(leaves, height)
        root, above = plain_tree(leaves)
        assert nodes[:32].hex() == root
        for i in range(n):
            found = merkle.path(nodes, n, height, i)
            assert list(merkle.steps(found)) == above[i] and merkle.folded(leaves[i], found) == root
