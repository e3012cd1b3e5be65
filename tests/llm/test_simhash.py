"""op7 against a brute force of its own: fingerprints, links and components."""

import re
import zlib
from itertools import combinations

import duckdb
import xxhash

from siftgrid.llm import entry_queries, simhash_dedup

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {f: f for f in prints}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            root[top(a)] = top(b)
    return {f: top(f) for f in prints}


def test_query(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    want = {d: plain_fingerprint(t) for d, t in texts.items()}
    top = plain_components(sorted(set(want.values())))
    least = {}
    for d, f in want.items():
        least[top[f]] = min(d, least.get(top[f], d))
    found = entry_queries.queries()["op7_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {d: (f"{f:016x}", least[top[f]]) for d, f in want.items()}


def test_links_at_every_setting(spark):
    """Chains, dense groups and chance neighbours: the same links whatever the number of blocks."""
    base = [zlib.crc32(str(i).encode()) << 32 | zlib.crc32(str(-i).encode()) for i in range(60)]
    prints = {b ^ sum(1 << (i * k * 7 + k) % 64 for k in range(n)) for i, b in enumerate(base) for n in range(8)}
    prints |= {base[0] ^ 1 << i for i in range(64)} | {base[1] ^ 1 << i ^ 1 << j for i in range(10) for j in range(10)}
    want = {(a, b) for a, b in combinations(sorted(prints, key=lambda f: f - (f >> 63 << 64)), 2) if (a ^ b).bit_count() <= 4}
    points = spark.createDataFrame([(f - (f >> 63 << 64),) for f in prints], "fp long")
    for blocks in (6, 7, 8):
        found = [tuple(x % (1 << 64) for x in r) for r in simhash_dedup.links(points, 4, blocks).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    edges = simhash_dedup.links(points)
    tops = plain_components(sorted(prints))
    got = {r["node"] % (1 << 64): r["root"] for r in simhash_dedup.components(edges).collect()}
    assert all((got[a] == got[b]) == (tops[a] == tops[b]) for a, b in combinations(got, 2))
