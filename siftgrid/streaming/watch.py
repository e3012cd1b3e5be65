"""Files watched as a stream: findings follow the last version of each file.

The state of a path is its version and its findings. A newer version takes back the
findings that are gone and gives those that are new; a deletion takes back all. The
sum of what was given and taken back is, at any time, what a scan of the files'
last versions finds. Rows that come late, or twice, change nothing.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftgrid.functions import guards
from siftgrid.functions.text import group_of
from siftgrid.operators.rulebook import Matcher

FILES = "path string, version long, deleted boolean, content string"
CHANGES = "path string, version long, sign int, rule string, value string, line int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Keyed processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def found_in(files: DataFrame, patterns: dict[str, str], harmless: Callable[[Column], Column] | None = guards.app_value) -> DataFrame:
    """path, version, deleted, found (array of rule, value, line) of files (FILES): one row each, so a file without a match is there too."""
    names = list(patterns)
    rules = [(patterns[n], group_of(patterns[n])) for n in names]
    kind = "array<struct<rule:string,value:string,line:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(rules)
        for b in batches:
            found = []
            for deleted, content in zip(b["deleted"], b["content"], strict=True):
                text = "" if deleted is True or not isinstance(content, str) else content
                found.append([{"rule": names[k], "value": value, "line": text.count("\n", 0, start) + 1} for k, value, start, _ in matcher.matches(text)])
            yield b[["path", "version", "deleted"]].assign(found=pd.Series(found, dtype=object))

    out = files.select("path", F.col("version").cast("long").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "content")
    scanned = out.mapInPandas(run, f"path string, version long, deleted boolean, found {kind}")
    if harmless is None:
        return scanned
    return scanned.withColumn("found", F.filter("found", lambda f: ~harmless(f["value"])))


class Follow(StatefulProcessor):
    """Of one path: the last version, and its findings with their numbers as JSON."""

    def __init__(self, remembered_ms: int | None):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version long, found string")
        self.gone = handle.getValueState("gone", "version long", self.remembered_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for b in rows:
            for version, deleted, found in zip(b["version"], b["deleted"], b["found"], strict=True):
                # Of two rows of a version the deletion counts, then the greater findings: the order in which they come doesn't.
                if newest is None or (version, bool(deleted), found) > newest:
                    newest = (int(version), bool(deleted), found)
        known, before = -(1 << 62), Counter()
        if self.last.exists():
            known, held = self.last.get()
            before = Counter({tuple(x): n for *x, n in json.loads(held)})
        elif self.gone.exists():
            known = self.gone.get()[0]
        if newest is None or newest[0] <= known:
            return
        version, deleted, found = newest
        after = Counter() if deleted else Counter((f["rule"], f["value"], f["line"]) for f in json.loads(found))
        if deleted:
            self.last.clear()
            self.gone.update((version,))
        else:
            self.gone.clear()
            self.last.update((version, json.dumps([[*x, n] for x, n in after.items()])))
        out = [(key[0], version, sign, *x) for sign, changed in ((-1, before - after), (1, after - before)) for x, n in sorted(changed.items()) for _ in range(n)]
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def follow(files: DataFrame, patterns: dict[str, str], harmless: Callable[[Column], Column] | None = guards.app_value, remembered: str | None = "7 days") -> DataFrame:
    """CHANGES of a stream of files: findings given (sign 1) and taken back (-1).

    State is one row a living path; that a path was deleted is remembered for `remembered`, so that older rows
    of it don't bring it back; with None for good. Times run by the clock, so a stream with one never is at its end.
    A null path or version is left out. Call `prepare` before the stream starts.
    """
    rows = found_in(files.where("path is not null and version is not null"), patterns, harmless).withColumn("found", F.to_json("found"))
    return rows.groupBy("path").transformWithStateInPandas(Follow(milliseconds(remembered)), CHANGES, "append", "ProcessingTime" if remembered else "None")


def milliseconds(time: str | None) -> int | None:
    return None if time is None else int(pd.Timedelta(time).total_seconds() * 1000)


def standing(changes: DataFrame) -> DataFrame:
    """path, rule, value, line: what of CHANGES is given and not taken back, as often as it is found."""
    left = changes.groupBy("path", "rule", "value", "line").agg(F.sum("sign").cast("int").alias("n")).where("n > 0")
    return left.select("path", "rule", "value", "line", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")


def last_versions(files: DataFrame) -> DataFrame:
    """The last version of each path of files (FILES), if it is not deleted."""
    newest = files.where("path is not null and version is not null").groupBy("path").agg(F.max_by(F.struct("version", F.coalesce("deleted", F.lit(False)).alias("deleted"), "content"), "version").alias("f"))
    return newest.select("path", "f.*").where("not deleted")


def standing_in(files: DataFrame, patterns: dict[str, str], harmless: Callable[[Column], Column] | None = guards.app_value) -> DataFrame:
    """The batch form: path, rule, value, line of the last versions of files."""
    return found_in(last_versions(files), patterns, harmless).select("path", F.inline("found"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (new, modified, deleted) between two snapshots (path, mtime); a null mtime is a value of its own."""
    both = before.select("path", F.struct("mtime").alias("was")).join(after.select("path", F.struct("mtime").alias("now")), "path", "full")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("was.mtime").eqNullSafe(F.col("now.mtime")), "modified")
    return both.select("path", kind.alias("change")).where("change is not null")


def written(changes: DataFrame, path: str, checkpoint: str):
    """A stream of CHANGES kept in a folder; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
