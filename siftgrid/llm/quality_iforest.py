"""Quality rules: an isolation forest on rule statistics.

The statistics of every text are counted over the whole text. Each tree splits a
small subsample at random features and places; a document that few splits set
apart has a short path and a high score. The forest is drawn from at most
`sample_rows` rows of smallest id hash (a documented bound). The threshold comes
from all labelled rows: scores are counted by label in bins, and the bin is taken
that tells bad from good best while it rejects at most `max_false` of the good
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.llm.common import cut, table, words

SYMBOLS = "#*$%&|<>"
BINS = 2000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_marks", "n_distinct")
STATS = ", ".join(f"{c} long" for c in BASE + MORE)


def repeated(found: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words inside windows of `width` words that occur twice or more, and distinct words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in found], np.int64)
    if len(ids) < width + 1:
        return 0, len(number)
    windows = len(ids) - width + 1
    key = ids[:windows]
    for k in range(1, width):
        if k > 1:  # renumbered, a key stays below the square of the text's length
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[k : windows + k]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(width):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum()), len(number)


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of BASE and MORE; a null text counts as empty."""
    text = text or ""
    found = words(text)
    raw = np.frombuffer(text.encode(), np.uint8)
    spaces = int((raw == 32).sum() + ((raw >= 9) & (raw <= 13)).sum())
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    again, distinct = repeated(found)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    marks = int(((raw >= 33) & (raw <= 47)).sum() + ((raw >= 58) & (raw <= 64)).sum() + ((raw >= 91) & (raw <= 96)).sum() + ((raw >= 123) & (raw <= 126)).sum())
    return len(found), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, upper, marks, distinct


def measured(text: str = "text") -> Column:
    @F.pandas_udf(STATS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=BASE + MORE, dtype="int64")

    return of(text)


def features(s: pd.DataFrame) -> np.ndarray:
    """Ratios that don't depend on a text's length; repeats are left to the base rules."""
    w, c = np.maximum(1, s["n_words"].to_numpy(float)), np.maximum(1, s["word_chars"].to_numpy(float))
    return np.column_stack(
        [
            s["n_symbols"] / c,
            s["n_upper"] / c,
            s["n_marks"] / c,
            # Distinct words fall with length; this ratio stays level over plain prose.
            np.log(np.maximum(1, s["n_distinct"])) / np.log(np.maximum(2, w)),
            c / w,
        ]
    ).astype(np.float32)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a random tree over n rows ends."""
    n = np.asarray(n, float)
    big = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(np.maximum(big - 1, 1)) + 0.5772156649) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), place, left and right child, path length at a leaf."""

    trees: list[tuple[np.ndarray, ...]]
    subsample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; higher is more anomalous."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, place, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                go = x[inner, f[inner]] < place[at[inner]]
                at[inner] = np.where(go, left[at[inner]], right[at[inner]])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, float(mean_path(self.subsample))))


def grow(x: np.ndarray, trees: int = 128, subsample: int = 128, seed: int = 8) -> Forest:
    rng, out = np.random.default_rng(seed), []
    size = min(subsample, len(x))
    depth = int(np.ceil(np.log2(max(2, size))))
    for _ in range(trees if size > 1 else 0):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, d: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, d + float(mean_path(len(rows)))])
            low, high = rows.min(axis=0), rows.max(axis=0)
            able = np.flatnonzero(high > low)
            if d < depth and len(rows) > 1 and len(able):
                f = int(rng.choice(able))
                place = np.float32(rng.uniform(low[f], high[f]))
                left = rows[:, f] < place
                if left.any() and not left.all():
                    nodes[me][0], nodes[me][1] = f, float(place)
                    nodes[me][2] = split(rows[left], d + 1)
                    nodes[me][3] = split(rows[~left], d + 1)
            return me

        split(x[rng.choice(len(x), size, replace=False)], 0)
        a = np.array(nodes)
        out.append((a[:, 0].astype(np.int64), a[:, 1].astype(np.float32), a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return Forest(out, size)


def fit(stats: DataFrame, sample_rows: int = 8192, **settings) -> Forest:
    """A forest from at most sample_rows rows of stats (doc_id and the statistics)."""
    h = F.pmod(F.xxhash64("doc_id", *BASE), F.lit(1 << 30))
    # A share by hash first, so that few rows of each task meet; of those the first by hash.
    share = min(1.0, 4 * sample_rows / max(1, stats.count()))
    first = stats.where((F.col("n_words") >= 50) & (h < int(share * (1 << 30)))).orderBy(h, "doc_id", *BASE).limit(sample_rows)
    return grow(features(first.select(*BASE, *MORE).toPandas()), **settings)


def anomaly(forest: Forest, spark: SparkSession, stats: str = "") -> Column:
    """The forest's score of the statistics, which are columns or, with `stats`, fields of that column."""
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(shared.value.score(features(pd.concat(columns, axis=1, keys=BASE + MORE))))

    return of(*(f"{stats}.{c}" if stats else c for c in BASE + MORE))


def base_failed(stats: str = "") -> Column:
    n, again = (F.col(f"{stats}.{c}" if stats else c) for c in ("n_words", "n_repeat_words"))
    return (n < 50) | (100 * again > 50 * n)


def threshold(scored: DataFrame, labels: DataFrame, max_false: float = 0.002, default: float = 0.65) -> float:
    """The score above which a document is rejected, from all labelled rows that pass the base rules."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    bins = (
        scored.where(~base_failed())
        .join(known, "doc_id")
        .groupBy(F.floor(F.col("anomaly") * BINS).alias("bin"))
        .agg(F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") > 0, 0).otherwise(1)).alias("bad"))
        .toPandas()
    )
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    good[bins["bin"].to_numpy(int)], bad[bins["bin"].to_numpy(int)] = bins["good"].to_numpy(), bins["bad"].to_numpy()
    if not good.sum() or not bad.sum():
        return default
    # Rejected from bin k on: shares of the good and of the bad rows.
    false, true = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(false <= max_false, true - false, -1.0)
    best = np.flatnonzero(gain == gain.max())  # bins without labelled rows do equally well: take their middle
    return float(best[0] + best[-1]) / 2 / BINS


def fitted(stats: DataFrame, labels: DataFrame, **settings) -> tuple[Forest, float]:
    forest = fit(stats, **settings)
    return forest, threshold(stats.withColumn("anomaly", anomaly(forest, stats.sparkSession)), labels)


def verdict(stats: DataFrame, forest: Forest, limit: float) -> DataFrame:
    """stats with anomaly, base_failed and kept."""
    return (
        stats.withColumn("anomaly", anomaly(forest, stats.sparkSession))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))
    )


def statistics_table(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", measured().alias("s")).select("doc_id", "s.*")


def judge(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, the statistics, anomaly, base_failed and kept of every row of docs.

    A null text counts as empty and fails the base rules, as any text of under
    50 words. Repeated rows are judged each and alike; a document labelled twice
    counts as bad if one label says so. Without labelled rows of both kinds the
    threshold is a default. Columns other than doc_id and text are ignored.
    """
    stats = cut(statistics_table(docs))
    return verdict(stats, *fitted(stats, labels, **settings))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")
