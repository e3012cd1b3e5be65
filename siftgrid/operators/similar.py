"""Texts that equal or resemble those of a corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftgrid.functions import urls


def exact(docs: DataFrame) -> DataFrame:
    """doc_id, first_id of docs (doc_id, text) whose text, normalised as code, is that of a document of smaller id, the least of them; null texts equal nothing.

    The hashes are dealt by themselves once, and the least id of each is a window over them: texts are read once.
    A hash that very many documents have is sorted with its ids in one task, sixteen bytes each.
    """
    h = docs.where("text is not null").select("doc_id", F.unhex(F.sha2(urls.normalize_code(F.col("text")), 256)).alias("h"))
    first = h.withColumn("first_id", F.min("doc_id").over(Window.partitionBy("h")))
    return first.where("doc_id <> first_id").select("doc_id", "first_id")


#: A corpus of at most so many characters is sent whole, with its index.
SENT_CHARACTERS = 8_000_000
SIZE = 8


def fuzzy(docs: DataFrame, corpus: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, item_id, score: docs (doc_id, text) and corpus texts (item_id, text) that share at least `least` of the 8-character shingles of both, equal ones left out.

    Texts are normalised as code; null ones, and texts without an id, match nothing. A corpus of at most SENT_CHARACTERS, measured, is sent
    to the documents with an index of its rare shingles, and nothing of a document is exchanged; a larger one is
    met by a shuffle of rare shingles. Both give the same rows.
    """
    small = (corpus.agg(F.sum(F.length("text"))).first()[0] or 0) <= SENT_CHARACTERS
    return probed(docs, corpus, least) if small else joined(docs, corpus, least)


def shingle_set(text: str) -> set[str]:
    return {text[i : i + SIZE] for i in range(len(text) - SIZE + 1)} if len(text) >= SIZE else {text}


def probed(docs: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """fuzzy with the corpus sent whole: a document reads its shingles against an index of the corpus' rarest, and what it meets is measured at once.

    A text that shares enough with one of the corpus has one of any (1 - least) share of its shingles and one more.
    """
    spark = docs.sparkSession
    items = corpus.where("text is not null").select("item_id", urls.normalize_code(F.col("text")).alias("t")).collect()
    sets = [shingle_set(r["t"]) for r in items]
    count = Counter(g for s in sets for g in s)
    index: dict[str, list[int]] = {}
    for k, s in enumerate(sets):
        for g in sorted(s, key=lambda g: (count[g], g))[: len(s) - ceil(len(s) * least) + 1]:
            index.setdefault(g, []).append(k)
    low, high = min(map(len, sets), default=0), max(map(len, sets), default=0)
    sent = spark.sparkContext.broadcast(([r["t"] for r in items], sets, index))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, known, by_shingle = sent.value
        for batch in batches:
            out = []
            for at, t in enumerate(batch["t"]):
                if least * low > max(len(t) - SIZE + 1, 1):
                    continue
                own = shingle_set(t)
                if not least * low <= len(own) <= high / least:
                    continue
                for k in {k for g in own if g in by_shingle for k in by_shingle[g]}:
                    both = len(own & known[k])
                    score = both / (len(own) + len(known[k]) - both)
                    if score >= least and t != texts[k]:
                        out.append((at, k, score))
            rows, ks, scores = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[list(rows)] if rows else pd.Series(dtype=object), "k_": pd.Series(ks, dtype="int32"), "score": pd.Series(scores, dtype="float64")})

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), urls.normalize_code(F.col("text")).alias("t"))
    named = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(items)], f"k_ int, item_id {dict(corpus.dtypes)['item_id']}")
    found = rows.mapInPandas(measure, "doc_id string, k_ int, score double")
    return found.join(F.broadcast(named), "k_").select(F.col("doc_id").cast(kind).alias("doc_id"), "item_id", "score")


def joined(docs: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """fuzzy by a shuffle.

    A document whose number of shingles rules out every corpus text goes before anything is exchanged. Of the rest,
    shingles that the corpus hasn't come first, then its rarest; a text needs only its first (1 - least) share to meet
    any match, and only that is joined. Candidates are measured exactly.
    """
    cut = lambda df, key: df.where("text is not null").select(key, urls.normalize_code(F.col("text")).alias("t")).withColumn("gs", urls.shingles(F.col("t"))).withColumn("n", F.size("gs"))
    c = cut(corpus, "item_id")
    bounds = c.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    d = cut(docs, "doc_id").crossJoin(F.broadcast(bounds)).where((F.col("n") >= least * F.col("lo")) & (F.col("n") * least <= F.col("hi"))).drop("lo", "hi")  # one row of bounds
    df = c.select(F.explode("gs").alias("g")).groupBy("g").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame, key: str) -> DataFrame:
        each = side.select(key, "n", F.explode("gs").alias("g")).join(df, "g", "left")
        ranked = each.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "g")))
        return ranked.where((F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & F.col("df").isNotNull()).select(key, "g")

    pairs = prefix(d, "doc_id").join(prefix(c, "item_id"), "g").select("doc_id", "item_id").distinct()
    sides = lambda side, key: side.select(key, F.col("t").alias(f"{key}_t"), F.col("gs").alias(f"{key}_gs"))
    met = pairs.join(sides(d, "doc_id"), "doc_id").join(sides(c, "item_id"), "item_id").where("doc_id_t <> item_id_t")
    both = F.size(F.array_intersect("doc_id_gs", "item_id_gs"))
    score = both / (F.size("doc_id_gs") + F.size("item_id_gs") - both)
    return met.withColumn("score", score).where(F.col("score") >= least).select("doc_id", "item_id", "score")
