"""Digest trees over findings, and chains of reports that go on."""

import hashlib

from pyspark.sql import functions as F

from siftgrid.operators import reports

SCHEMA = "source string, ord long, type string, line int, value string"


def rows(changed=()):
    out = [(s, i, f"t{i % 3}", i % 7, f"v{i}") for s, n in (("a", 900), ("b", 130), ("c", 1)) for i in range(n) if i % 50 != 7]
    return [(s, i, t, line, "other" if (s, i) in changed else v) for s, i, t, line, v in out]


def test_a_change_is_located_and_leaves_are_checked(spark):
    one = spark.createDataFrame(rows(), SCHEMA)
    two = spark.createDataFrame([*(r for r in rows({("a", 333), ("a", 5)}) if not ("b" == r[0] and r[1] >= 120)), ("d", 3, "t", 1, "v")], SCHEMA)
    kw = {"fan": 3}
    before, after = reports.digest_tree(one, 10, **kw), reports.digest_tree(two.repartition(5), 10, **kw)
    assert reports.digest_tree(one.orderBy(F.desc("ord")), 10, **kw).exceptAll(before).isEmpty()
    assert {tuple(r) for r in reports.changed_leaves(before, after, **kw).collect()} == {("a", 33, "changed"), ("a", 0, "changed"), ("b", 12, "gone"), ("d", 0, "new")}
    assert reports.changed_leaves(before, before, **kw).isEmpty()
    top = before.agg(F.max("level")).first()[0]
    roots = before.where(F.col("level") == top).select("source", "digest")
    assert roots.count() == 3
    shown = two.where("source = 'a' and (ord between 330 and 349) or source = 'b' and ord between 20 and 29 or source = 'd'")
    found = {(r["source"], r["node"]): r["intact"] for r in reports.checked(shown, before, roots, 10, **kw).collect()}
    assert found == {("a", 33): False, ("a", 34): True, ("b", 2): True, ("d", 0): False}
    # A leaf that the tree doesn't have fits no root.
    extra = spark.createDataFrame([("b", 139, "t", 1, "v")], SCHEMA)
    assert [r["intact"] for r in reports.checked(extra, before, roots, 10, **kw).collect()] == [False]
    assert reports.digest_tree(one.limit(0)).collect() == []


def test_chains_go_on(spark):
    made = [(t, f"2024-01-{d:02d}", f"s{d % 2}", f"d{d}{t}") for t in ("x", "y") for d in range(1, 30 if t == "x" else 4)] + [("z", "2024-02-01", None, "dz")]
    df = spark.createDataFrame(made, "target string, at string, signer string, digest string")
    whole = {tuple(r) for r in reports.envelopes(df).collect()}
    want, last = set(), {}
    for target, at, signer, digest in sorted(made, key=lambda r: r[:2]):
        prev = last.get(target, "")
        own = hashlib.sha256("|".join(x for x in (prev, digest, at, signer) if x is not None).encode()).hexdigest()
        want.add((target, at, signer, digest, prev, own))
        last[target] = own
    assert whole == want
    early = reports.envelopes(df.where("at <= '2024-01-10'"))
    assert {tuple(r) for r in early.unionByName(reports.appended(early, df.where("at > '2024-01-10'"))).collect()} == want
