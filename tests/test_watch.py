"""Streams that follow files and users' decisions, against batch forms and plain simulations."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from siftgrid.streaming import decisions, watch

RULES = {"token": r"tok_(\w{6,})", "host": r"host=\S+"}


def fed(spark, tmp_path, schema, batches):
    """A stream of one file a batch, in order."""
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    watch.prepare(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_files_follow_their_last_version(spark, tmp_path):
    draw = random.Random(4)
    version, batches = 0, []
    lines = ["tok_abcdef1", "host=a.b", "nothing", "tok_zzzzzz9 tok_zzzzzz9", "x host=c"]
    for _ in range(5):
        batch = []
        for _ in range(8):
            version += 1
            # Some rows come late: their version lies behind.
            v = version if draw.random() < 0.7 else max(1, version - draw.randrange(12)) * 100 + draw.randrange(1, 99)
            batch.append((f"p{draw.randrange(5)}", v if v >= 100 else v * 100, draw.random() < 0.2, draw.choice([None, "", "\n".join(draw.choice(lines) for _ in range(draw.randrange(1, 6)))])))
        batches.append(batch)
    batches[-1] += [(None, 5, False, "tok_abcdef1"), ("p9", None, False, "tok_abcdef1")] + batches[0][:2]
    # One row a version: what a version holds doesn't change.
    seen, clean = {}, []
    for batch in batches:
        clean.append([seen.setdefault((r[0], r[1]), r) for r in batch])
    stream = watch.follow(fed(spark, tmp_path, watch.FILES, clean), RULES, None, remembered=None)
    q = watch.written(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    assert q.awaitTermination(120)
    out = spark.read.schema(watch.CHANGES).parquet(str(tmp_path / "out"))
    found = Counter(tuple(r) for r in watch.standing(out).select("path", "rule", "value", "line").collect())
    batch = watch.standing_in(spark.createDataFrame([r for b in clean for r in b], watch.FILES), RULES, None)
    assert found == Counter(tuple(r) for r in batch.select("path", "rule", "value", "line").collect()) and found
    assert out.where("sign < 0").count() > 0


def test_changed_snapshots(spark):
    a = spark.createDataFrame([("same", 1), ("mod", 1), ("gone", 1), ("nul", None), ("was", 3)], "path string, mtime long")
    b = spark.createDataFrame([("same", 1), ("mod", 2), ("new", 1), ("nul", None), ("was", None)], "path string, mtime long")
    assert {tuple(r) for r in watch.changed(a, b).collect()} == {("mod", "modified"), ("gone", "deleted"), ("new", "new"), ("was", "modified")}


def plain(batches, ring, live_s, late_s):
    out, users = [], {}
    for batch in batches:
        for user, ts, seq, kind, name in sorted(batch, key=lambda r: (r[0], r[1], r[2])):
            s = users.setdefault(user, {"ring": [], "newest": datetime(1970, 1, 1), "live": {}})
            if (s["newest"] - ts).total_seconds() > late_s:
                continue
            s["newest"] = max(s["newest"], ts)
            s["live"] = {k: t for k, t in s["live"].items() if (s["newest"] - t).total_seconds() <= live_s}
            if kind == "suppress":
                if name not in s["ring"]:
                    s["ring"] = (s["ring"] + [name])[-ring:]
                if name in s["live"]:
                    del s["live"][name]
                    out.append((user, seq, -1, name))
            elif name not in s["ring"]:
                if name not in s["live"]:
                    out.append((user, seq, 1, name))
                s["live"][name] = max(ts, s["live"].get(name, ts))
    return out


def test_decisions_apply_to_live_findings(spark, tmp_path):
    draw = random.Random(8)
    at, batches, seq = datetime(2024, 1, 1), [], 0
    for k in range(5):
        batch = []
        for _ in range(40):
            seq += 1
            late = timedelta(minutes=draw.choice([0, 0, 0, 30, 200]))
            batch.append((draw.randrange(3), at + timedelta(minutes=seq) - late, seq, "suppress" if draw.random() < 0.25 else "finding", f"f{draw.randrange(9)}"))
        batches.append(batch)
    stream = decisions.hidden_live(fed(spark, tmp_path, decisions.ROWS, batches), ring=3, live="40 minutes", late="1 hour", idle=None)
    q = watch.written(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    assert q.awaitTermination(120)
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "seq", "sign", "id").collect()]
    want = plain(batches, 3, 2400, 3600)
    assert Counter(found) == Counter(want) and any(s < 0 for _, _, s, _ in want)


def test_shown(spark):
    draw = random.Random(2)
    at = datetime(2024, 1, 1)
    made = [(draw.randrange(4), at, k, f"f{draw.randrange(6 if k % 2 else 2)}") for k in range(60)]
    rings = {u: decisions.Ring([], 3) for u in range(5)}
    for user, _, _, name in made:
        rings[user].add(name)
    findings = [(u, f"f{i}", i) for u in range(5) for i in range(7)]
    found = decisions.shown(spark.createDataFrame(findings, "user_id long, id string, n int"), spark.createDataFrame(made, "user_id long, ts timestamp, seq long, id string"), 3)
    assert {tuple(r) for r in found.select("user_id", "id", "n").collect()} == {f for f in findings if f[1] not in rings[f[0]].known}
