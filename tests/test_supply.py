"""Lockfiles, split keys, worm shapes and near copies of a corpus against brute force."""

import random
import re
from itertools import product

import pytest

from siftgrid.functions import rules
from siftgrid.operators import feeds, similar
from siftgrid.operators import supply_chain as S


def plain_matches(files, listed):
    out = set()
    for file, text in files:
        for name, package, ecosystem, versions in listed:
            if not text or not package:
                continue
            p, eco = re.escape(package), ecosystem or "npm"
            if not versions and re.search(rf'"{p}"\s*:\s*"', text, re.I):
                out.add((file, name, package, eco, None))
            for v in versions or []:
                pattern = rf'"{p}"[\s\S]{{0,80}}"version"\s*:\s*"(?:{re.escape(v)})"' if eco.lower() == "npm" else rf"\b{p}\b[\s,=<>:@]+(?:{re.escape(v)})\b"
                if re.search(pattern, text, re.I):
                    out.add((file, name, package, eco, v))
    return out


def test_lockfiles(spark):
    draw = random.Random(6)
    names = ["left-pad", "@scope/kit", "a.b", "group:art", "Flask", "x", "x-y", "pad", "kit"]
    versions = ["1.0", "1.0.1", "2.0-rc.1", "10", "0.1b"]
    listed = [(f"MAL-{i}", draw.choice(names), draw.choice(["npm", "PyPI", "Maven", None]), draw.choice([None, [], ["1.0"], ["1.0.1", "10"], ["2.0-rc.1", "0.1b"]])) for i in range(25)]
    pieces = [
        lambda: f'"{draw.choice(names)}": {{{" " * draw.choice([0, 5, 75, 90])}"version": "{draw.choice(versions)}"}}', lambda: f'"{draw.choice(names)}" : "^{draw.choice(versions)}"',
        lambda: f"{draw.choice(names)}{draw.choice(['==', ' = ', '@', ':', ' >=', ', ', '!'])}{draw.choice(versions)}{draw.choice(['', '.5', 'x', '; y', '-z'])}", lambda: f'name = "{draw.choice(names)}"\nversion = "{draw.choice(versions)}"', lambda: draw.choice(["\n", ",", "{", '"', "=", "x-"]),
    ]
    files = [(i, "".join(draw.choice([str.upper, str, str])(draw.choice(pieces)()) + draw.choice(["", " ", "\n", ",\n"]) for _ in range(draw.randrange(1, 9)))) for i in range(250)] + [(900, None), (901, "")]
    found = feeds.lockfile_matches(spark.createDataFrame(files, "file long, text string"), spark.createDataFrame([*listed, ("MAL-n", None, None, None)], "id string, package string, ecosystem string, versions array<string>"))
    got, want = {tuple(r) for r in found.collect()}, plain_matches(files, listed)
    assert got == want and len({r[4] for r in want}) > 4 and any(r[4] is None for r in want)


def test_split_keys_gives_every_pair(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh0123") for _ in range(14))
    files = [(repo, f"f{i}", "\n".join(draw.choice(["ghp_", "", "", "sk-"]) + word() for _ in range(40 if repo == 1 else 3))) for repo in (1, 2) for i in range(12)]
    files += [(3, "a", "no lead " + word()), (3, "b", word()), (4, "a", None)]
    want = set()
    parts = [(repo, file, k, m) for repo, file, text in files for k, line in enumerate((text or "").split("\n"), 1) for m in re.findall(S.FRAGMENT, line)]
    for a, b in product(parts, parts):
        if a[0] == b[0] and a[1] != b[1] and re.match(S.PREFIX, a[3]):
            want.add((a[0], a[1], a[2], b[1], b[2], next(p for p in rules.KEY_PREFIXES if a[3].startswith(p)), (a[3] + b[3])[:80]))
    df = spark.createDataFrame(files, "repo long, file string, text string")
    for cell in (2000, 37):
        found = [tuple(r) for r in S.split_keys(df, cell).collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 50_000


def plain_worm(hits, span):
    by = {k: sorted({line for rule, line in hits if rule == k}) for k in ("env_read", "net_egress", "persistence_write")}
    fits = (t for t in product(*by.values()) if max(t) - min(t) <= span)
    return min(fits, default=None)


@pytest.mark.parametrize("span", [0, 3, 40])
def test_worm_lines(spark, span):
    draw = random.Random(span)
    kinds = ["env_read", "net_egress", "persistence_write"]
    sources = {s: [(draw.choice(kinds), draw.randrange(1, 120)) for _ in range(draw.randrange(1, 30))] for s in range(60)}
    found = S.worm_lines(spark.createDataFrame([(s, *h) for s, hits in sources.items() for h in hits], "source long, rule string, line int"), span)
    want = {(s, *best) for s, hits in sources.items() if (best := plain_worm(hits, span))}
    assert {tuple(r) for r in found.collect()} == want


def test_worm_in_a_large_source(spark):
    """A hundred thousand hits that are all near each other take a sort."""
    rows = spark.range(100_000).selectExpr("0L as source", "case when id % 3 = 0 then 'env_read' when id % 3 = 1 then 'net_egress' else 'persistence_write' end as rule", "cast(id + 1 as int) as line")
    assert [tuple(r) for r in S.worm_lines(rows).collect()] == [(0, 1, 2, 3)]


def test_fuzzy_both_ways(spark):
    draw = random.Random(3)
    word = lambda: draw.choice("alpha beta gamma delta let var = ( ) { } return x1 y2 zz".split())
    corpus = [(i, " ".join(word() for _ in range(draw.randrange(1, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "ab")]
    docs = [(i, t if draw.random() < 0.2 else " ".join(w if draw.random() > 0.06 else word() for w in (t or "").split(" "))) for i, (_, t) in enumerate(corpus * 4)] + [(900, None), (901, "other text entirely"), (None, corpus[0][1] + " x")]
    d, c = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(corpus, "item_id long, text string")
    rows = lambda df: sorted((str(r["doc_id"]), r["item_id"], round(r["score"], 9)) for r in df.collect())
    found = rows(similar.probed(d, c, 0.7))
    assert found == rows(similar.joined(d, c, 0.7)) and len(found) > 30
    assert similar.fuzzy(d, c.limit(0)).collect() == [] == similar.fuzzy(d.limit(0), c).collect()
