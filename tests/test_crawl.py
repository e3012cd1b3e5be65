"""The crawl against a plain breadth-first search with a queue, budgets and the guard; scoped links; skipped paths."""

import random
from collections import deque

import pytest

from siftgrid.operators import crawl, paths, site


def key(url):
    return url.split("#")[0].split("?")[0].rstrip("/")


def plain(links, roots, most, depth):
    """(url, domain, depth, pos), one queue a domain."""
    domain = lambda u: ".".join(u.split("/")[2].split(".")[-2:])
    fine = lambda u: u.startswith("http") and not u.split("/")[2].startswith("10.") and u.split("/")[2] != ""
    out = []
    for d in sorted({domain(r) for r, _ in roots}):
        seen, queue = {}, deque()
        for r, _ in sorted(roots, key=lambda x: x[1]):
            if domain(r) == d and key(r) not in seen and len(seen) < most:
                seen[key(r)] = 0
                queue.append(key(r))
        while queue:
            url = queue.popleft()
            if depth is not None and seen[url] >= depth:
                continue
            for a, _, b in sorted((x for x in links if x[0] and key(x[0]) == url), key=lambda x: x[1]):
                if len(seen) < most and b and fine(b) and domain(b) == d and key(b) not in seen:
                    seen[key(b)] = seen[url] + 1
                    queue.append(key(b))
        out += [(u, d, k, i) for i, (u, k) in enumerate(seen.items())]
    return out


@pytest.mark.parametrize(("most", "depth"), [(1000, None), (25, None), (40, 3), (3, 2)])
def test_equals_a_plain_search(spark, most, depth):
    draw = random.Random(most)
    nodes = [f"https://h{draw.randrange(5)}.{d}.com/p{i}" for d in ("one", "two") for i in range(60)]
    links, at = [], {}
    for _ in range(220):
        a, b = draw.choice(nodes), draw.choice([*nodes, "http://10.0.0.1/x", "ftp://h1.one.com/f", "https:///none", None, "https://other.org/"])
        at[a] = at.get(a, 0) + 1
        links.append((a + draw.choice(["", "/", "?q=1", "#top"]), float(at[a]), b and b + draw.choice(["", "/", "?x#y"])))
    links += [(None, 1.0, nodes[0])] + links[:5]
    roots = [(nodes[0], 1), (nodes[3] + "/", 2), (nodes[0], 3), (nodes[61], 0), (None, 5)]
    want = plain(links, [r for r in roots if r[0]], most, depth)
    found = crawl.frontier(spark.createDataFrame(links, "a string, ord double, link string"), spark.createDataFrame(roots, "url string, ord long"), most, depth)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 3


def test_a_chain_to_its_end(spark):
    """Any depth, a few rows a level, with the level sent whole or shuffled."""
    links = [(f"http://a.com/{i}", 1, f"http://a.com/{i + 1}") for i in range(12)] + [("http://a.com/12", 1, "http://a.com/0")]
    roots = spark.createDataFrame([("http://a.com/0", 1)], "url string, ord long")
    found = crawl.frontier(spark.createDataFrame(links, "a string, ord long, link string"), roots)
    assert sorted((r["depth"], r["url"]) for r in found.collect()) == [(i, f"http://a.com/{i}") for i in range(13)]
    none = crawl.frontier(spark.createDataFrame([], "a string, ord long, link string"), roots.limit(0))
    assert none.collect() == []


def test_scoped_links(spark):
    links = ["https://x.one.com/a/", "http://[::1]/a", "https://x.one.com/a?again", "https://two.com/", "HTTPS://y.one.com/B;v=1", "mailto:x@one.com", "https://one.com", "https://z.one.com/c", None]
    rows = [("p", "one.com", i, u) for i, u in enumerate(links)] + [("q", "one.com", 0, "https://z.one.com/c")]
    df = spark.createDataFrame(rows, "page string, domain string, ord int, link string")
    seen = spark.createDataFrame([("https://one.com",)], "url string")
    found = sorted((r["page"], r["place"], r["url"]) for r in site.scoped_links(df, 2, seen).collect())
    assert found == [("p", 1, "https://x.one.com/a"), ("p", 2, "https://y.one.com/B"), ("q", 1, "https://z.one.com/c")]


def test_skipped_paths(spark):
    kept = ["build/a.js", ".venv/x.py", ".svn/e", "a/.cache/b", "lib/a.min.js", "venv", "docs/dist", "my-dist/a", "lib/patterns.js"]
    gone = ["dist/a", "a/node_modules/b/c.js", "x\\venv\\y", ".ruff_cache/z", ".git/config", "q/extension/lib/patterns.js", None]
    df = spark.createDataFrame([(p,) for p in kept + gone], "path string")
    assert sorted(r[0] for r in paths.pruned(df).collect()) == sorted(kept)
