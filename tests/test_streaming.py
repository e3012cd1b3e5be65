"""Streams give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from siftgrid.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", F.col("props").cast("string"))
    e.orderBy("event_id").repartition(3).write.parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    if not q.awaitTermination(60):
        q.stop()
        pytest.fail("the stream did not end")
    return df.sparkSession.table(name)


def test_counters(spark, events_dir, tmp_path):
    got = {}
    for r in run(jobs.counters(stream(spark, events_dir), "4000 days", "4000 days"), "c", "update", tmp_path).collect():
        key = (r["user_id"], r["event_type"])
        got[key] = max(got.get(key, (0, 0.0)), (r["n"], r["total"]))
    want = spark.read.schema(jobs.EVENTS).parquet(events_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()
    assert {k: v[0] for k, v in got.items()} == {(r["user_id"], r["event_type"]): r["n"] for r in want} and got
    assert all(abs(got[r["user_id"], r["event_type"]][1] - r["total"]) < 1e-6 for r in want)


def test_dedup(spark, events_dir, tmp_path):
    got = run(jobs.dedup(stream(spark, events_dir), ["user_id", "event_type"], "4000 days"), "d", "append", tmp_path).collect()
    keys = [(r["user_id"], r["event_type"]) for r in got]
    batch = spark.read.schema(jobs.EVENTS).parquet(events_dir).select("user_id", "event_type").distinct().count()
    assert len(keys) == len(set(keys)) == batch


def last_lists(out):
    """Of each user the list that was sent last."""
    lists = {}
    for r in out.collect():
        lists.setdefault(r["user_id"], {}).setdefault(r["seen"], []).append((r["event_id"], r["value"]))
    return {user: sorted(by_seen[max(by_seen)], key=lambda x: (-x[1], x[0])) for user, by_seen in lists.items()}


def test_top_by_value(spark, events_dir, tmp_path):
    got = last_lists(run(jobs.top_by_value(stream(spark, events_dir), 3, idle="4000 days", late="4000 days"), "t", "update", tmp_path))
    rows = {}
    for r in spark.read.schema(jobs.EVENTS).parquet(events_dir).collect():
        rows.setdefault(r["user_id"], []).append((r["event_id"], r["value"]))
    assert got == {user: sorted(all_rows, key=lambda x: (-x[1], x[0]))[:3] for user, all_rows in rows.items()}


def test_reset_empties_the_list(spark, tmp_path):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    for k, batch in enumerate(([(1, "a", 9.0), (2, "a", 5.0)], [(3, "a", 8.0), (4, "reset", 0.0), (5, "a", 1.0)], [(6, "a", 4.0)])):
        rows = [(i, at + timedelta(minutes=i), 7, kind, v, "") for i, kind, v in batch]
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    q = jobs.top_by_value(spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), 3, idle="10 days", late="10 days")
    assert last_lists(run(q, "r", "update", tmp_path)) == {7: [(6, 4.0), (5, 1.0)]}


def test_probe_budget(spark, events_dir, tmp_path):
    got = {}
    for r in run(jobs.probe_budget(stream(spark, events_dir), 2, "4000 days", "4000 days"), "p", "append", tmp_path).collect():
        got.setdefault(r["user_id"], []).append(r["event_type"])
    kinds = {}
    for r in spark.read.schema(jobs.EVENTS).parquet(events_dir).collect():
        kinds.setdefault(r["user_id"], set()).add(r["event_type"])
    assert all(len(v) == len(set(v)) == min(2, len(kinds[u])) and set(v) <= kinds[u] for u, v in got.items()) and got.keys() == kinds.keys()


def test_scan_and_suppress(spark, tmp_path):
    text = "x\nkey ghp_" + "a1" * 18 + " here"
    spark.createDataFrame([(1, "a.txt", text), (2, "b.txt", "nothing")], "doc_id long, source string, content string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, source string, content string").parquet(str(tmp_path / "in"))
    found = jobs.scan(docs, {"github_pat": r"ghp_[0-9a-zA-Z]{36}"}).withColumn("id", F.col("doc_id"))
    hidden = spark.createDataFrame([(9,)], "id long")
    got = run(jobs.suppressed(found, hidden), "s", "append", tmp_path).collect()
    assert [(r["doc_id"], r["rule"], r["line"]) for r in got] == [(1, "github_pat", 2)]
    q = jobs.file_watch(docs, str(tmp_path / "out"), str(tmp_path / "w"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1
