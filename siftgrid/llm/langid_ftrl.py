"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 characters of the lower-cased text, hashed to
`buckets` numbers. The term frequency is the share of the text's n-grams, so a
text's score is the mean of its n-grams' weights and a text of any length is read
whole in one pass. Document frequencies come from all learning rows: each task
sums its own texts' flags, so a row of sums a task and at most `buckets` numbers
meet.

The classifier is fitted on at most `sample_rows` learning rows and `sample_bytes`
of text, the ones of smallest hash in each language (documented bounds; languages
share them equally). Their feature counts are made on the executors; the fit is
follow-the-regularised-leader with an elastic net on the driver. One row in five
of the sample is left out of it and sets the softmax temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrid.llm.common import fold, free_name, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Characters of a text that are hashed at a time; a text of any length is read in such stretches.
STRETCH = 1 << 18
UNDECIDED = "und"


def grams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    overlap = max(ORDERS) - 1
    for at in range(0, max(1, len(points)), STRETCH):
        part = points[max(0, at - overlap) : at + STRETCH].astype(np.uint64)
        seen = at - max(0, at - overlap)
        for n in ORDERS:
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h[max(0, seen - n + 1) :] % np.uint64(buckets)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, idf included
    bias: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in grams(text, len(self.weights)):
            total += np.bincount(part, minlength=len(self.weights)) @ self.weights if len(part) > len(self.weights) else self.weights[part].sum(axis=0)
            n += len(part)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDECIDED, 0.0
        p = softmax(self.scores(text)[None] / self.temperature)[0]
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequency(texts: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """How many rows hold each bucket, over all rows, and how many rows there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, rows = np.zeros(buckets, np.int64), 0
        for b in batches:
            for text in b["text"]:
                flags = np.zeros(buckets, bool)
                for part in grams(text, buckets):
                    flags[part] = True
                df += flags
                rows += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], rows)})

    got = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(buckets, np.int64)
    inside = got[got["bucket"] >= 0]
    df[inside["bucket"].to_numpy()] = inside["n"].to_numpy()
    return df, int(got.loc[got["bucket"] == -1, "n"].sum())


def sample(learning: DataFrame, languages: dict[str, int], sample_rows: int, sample_bytes: int) -> DataFrame:
    """Rows of smallest hash of id and text: about sample_rows, spread over the languages, as far as their texts take sample_bytes.

    Only sizes meet here; equal rows have equal hashes, so they are numbered and count once.
    """
    share = max(1, sample_rows // max(1, len(languages)))
    many = spread_over(learning.sparkSession, {name: min(1.0, 2 * share / n) for name, n in languages.items()})
    keyed = learning.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))).join(many, "lang").where(F.col("h") < F.col("share") * (1 << 40))
    each = keyed.groupBy("lang", "h").agg(F.min(F.length("text")).alias("size"))
    first = Window.partitionBy("lang").orderBy("h")
    ranked = each.withColumn("k", F.row_number().over(first)).where(F.col("k") <= share).withColumn("upto", F.sum("size").over(first))
    fits = ranked.where((F.col("upto") <= sample_bytes / max(1, len(languages))) | (F.col("k") == 1))
    ends = fits.groupBy("lang").agg(F.max("h").alias("last"))
    taken = keyed.join(F.broadcast(ends), "lang").where(F.col("h") <= F.col("last"))
    return taken.select("doc_id", "lang", "text", "h")


def spread_over(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    """lang, share: a row a language."""
    return F.broadcast(spark.createDataFrame(list(shares.items()), "lang string, share double"))


def featurised(rows: DataFrame, buckets: int) -> list:
    """Feature shares of each distinct row of the sample."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int]] = set()
        for b in batches:
            for lang, text, h in zip(b["lang"], b["text"], b["h"], strict=True):
                if (lang, h) in seen:  # a copy of a row
                    continue
                seen.add((lang, h))
                n = np.zeros(buckets, np.int64)
                for part in grams(text, buckets):
                    n += np.bincount(part, minlength=buckets)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": [lang], "h": [h], "at": [at.astype("<i4").tobytes()], "tf": [(n[at] / max(1, n.sum())).astype("<f4").tobytes()]})

    found = rows.select("lang", "text", "h").mapInPandas(counts, "lang string, h long, at binary, tf binary")
    return found.groupBy("lang", "h").agg(F.min(F.struct("at", "tf")).alias("f")).select("lang", "f.at", "f.tf").collect()


def ftrl(rows: list, buckets: int, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal, one coordinate rate each; rows: (indices, values, class)."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, k = rows[i]
            at, x = np.append(at, buckets), np.append(x, 1.0)
            w = solve(z[at], n[at])
            p = softmax((x @ w)[None])[0]
            p[k] -= 1.0
            g = x[:, None] * p[None]
            g2 = g * g
            sigma = (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g2
    w = solve(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss on rows that the fit didn't see."""
    if not len(classes):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(classes)), classes] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(
    learning: DataFrame,
    sample_rows: int = 4000,
    sample_bytes: int = 64 << 20,
    buckets: int = BUCKETS,
    most_weights: int = 1 << 23,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-4,
    l2: float = 1e-6,
) -> Model:
    """learning: doc_id, text, lang. Rows without a language or a text don't count.

    The driver holds a weight for each bucket and language: with more languages than
    most_weights / buckets there are fewer buckets. It also holds the features of the
    sample, which are no more than sample_bytes of text give.
    """
    learning = learning.where("lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    languages = {r["lang"]: r["n"] for r in learning.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0)
    names = list(languages)
    while buckets * len(names) > most_weights and buckets > 1024:
        buckets //= 2
    df, rows = document_frequency(learning, buckets)
    idf = np.log((1 + rows) / (1 + df)) + 1.0
    taken = [
        (at := np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["tf"], "<f4") * idf[at], names.index(r["lang"]))
        for r in sorted(featurised(sample(learning, languages, sample_rows, sample_bytes), buckets), key=lambda r: (r["lang"], r["at"], r["tf"]))
    ]
    # One scale for all rows keeps a score linear in the shares; it brings their length near one.
    scale = 1.0 / max(1e-9, float(np.median([np.sqrt((x * x).sum()) for _, x, _ in taken]))) if taken else 1.0
    taken = [(at, x * scale, k) for at, x, k in taken]
    held = [r for i, r in enumerate(taken) if i % 5 == 4]
    w, bias = ftrl([r for i, r in enumerate(taken) if i % 5 != 4], buckets, len(names), epochs, alpha, beta, l1, l2)
    logits = np.array([x @ w[at] + bias for at, x, _ in held]).reshape(len(held), len(names))
    t = temperature(logits, np.array([k for *_, k in held], dtype=int))
    return Model(names, (w * (idf * scale)[:, None]).astype(np.float32), bias, t)


def predict(docs: DataFrame, model: Model) -> Column:
    """struct<lang_pred, score> of the column text; `und` with score 0 for a null text or one without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    return of("text")


def identify(docs: DataFrame, learning: DataFrame, **settings) -> DataFrame:
    """docs with lang_pred and score, from a model learned on `learning`.

    Repeated rows are predicted each; an empty `learning` makes every text
    `und`; ties go to the language that sorts first. docs keeps its other columns.
    """
    name = free_name(docs, "prediction")
    found = docs.withColumn(name, predict(docs, train(learning, **settings)))
    return found.select(*(f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")), f"{name}.lang_pred", f"{name}.score")


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 4) == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
