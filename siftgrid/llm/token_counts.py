"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens where a run of spaces begins. No piece of the
vocabulary has a space mark after another character, so no merge crosses such
a cut and the counts of the pre-tokens add up to the count of the text
(`separable` checks the vocabulary; the call fails if it doesn't hold).

Tier one is a broadcast table from frequent pre-tokens to their lengths, with at
most `table_size` entries of at most `max_key` characters, taken from a sample
of about `sample_docs` texts. It only saves work: any table gives the same counts.
Tier two encodes what the table misses and keeps it in a cache of the worker, of
at most `cache_size` entries. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: A run of spaces and all up to the next space. The library reads its own space mark as a space.
PRE_TOKEN = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")

_loaded: dict[str, object] = {}


def processor(model: str):
    if model not in _loaded:
        import sentencepiece

        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _loaded[model]


def separable(model: str) -> bool:
    """No piece has the space mark after another character, and texts aren't normalised."""
    sp = processor(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    probe = " a  ﬁ\t①\n é "
    return not any(SPACE in p.lstrip(SPACE) for p in pieces) and sp.normalize(probe) in (probe.replace(" ", SPACE), SPACE + probe.replace(" ", SPACE))


def measured(sp, keys: list[str]) -> list[int]:
    """Tokens of each pre-token inside a text.

    The library puts one space before whatever it encodes, so a pre-token gives
    up one of its own first; a single space alone is one token.
    """
    got = sp.encode([k[1:] if k[0] in (" ", SPACE) else k for k in keys], num_threads=1)
    return [len(ids) or 1 for ids in got]


class Counts:
    """Lengths of pre-tokens: the broadcast table, then the cache, then the library."""

    def __init__(self, model: str, frequent: dict[str, int], cache_size: int):
        self.sp, self.frequent, self.size = processor(model), frequent, cache_size
        self.known = dict(frequent)

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        found = PRE_TOKEN.findall(" " + text)
        got = list(map(self.known.get, found))
        if None in got:
            missed = list({k for k, n in zip(found, got, strict=True) if n is None})
            if len(self.known) + len(missed) > len(self.frequent) + self.size:
                self.known = dict(self.frequent)
                return self._apart(found)
            self.known.update(zip(missed, measured(self.sp, missed), strict=True))
            got = map(self.known.__getitem__, found)
        return sum(got)

    def _apart(self, found: list[str]) -> int:
        """After the cache was emptied: one text's own lengths, kept only as far as they fit."""
        own = Counter(found)
        missed = [k for k in own if k not in self.frequent]
        lengths = dict(zip(missed, measured(self.sp, missed), strict=True))
        if len(lengths) <= self.size:
            self.known.update(lengths)
        return sum(n * (lengths[k] if k in lengths else self.frequent[k]) for k, n in own.items())


def frequent_table(docs: DataFrame, model: str, sample_docs: int, table_size: int, max_key: int) -> dict[str, int]:
    """Lengths of the commonest pre-tokens of a sample of about sample_docs distinct texts; which ones only changes how fast counting is."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(k for k in PRE_TOKEN.findall(" " + text) if len(k) <= max_key)
                if len(seen) > 8 * table_size:
                    seen = Counter(dict(seen.most_common(table_size)))
        yield pd.DataFrame(seen.most_common(table_size), columns=["key", "n"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    # Drawn by hash, wherever the rows are: copies are drawn together, and each task counts its own.
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)
    sample = docs.where(drawn & (F.length("text") > 0)).select("text")
    counted = sample.mapInPandas(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = [r["key"] for r in counted.orderBy(F.desc("n"), "key").limit(table_size).collect()]
    return dict(zip(keys, measured(processor(model), keys), strict=True))


def token_count(
    docs: DataFrame,
    model: str | None = None,
    sample_docs: int = 2000,
    table_size: int = 100_000,
    max_key: int = 32,
    cache_size: int = 400_000,
) -> Column:
    """A Column: the tokens of the column `text` of docs, as the library counts them without added tokens.

    A null or empty text has 0 tokens. Repeated rows are counted each; other columns don't matter.
    """
    model = model or public_tokenizers.path(MODEL)
    if not separable(model):
        raise ValueError("this vocabulary merges across spaces, so its pre-tokens can't be counted one by one")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, model, sample_docs, table_size, max_key))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = Counts(model, shared.value, cache_size)
        for texts in batches:
            yield pd.Series([counts.of(t) for t in texts], dtype="int64")

    return count("text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(docs).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > 4096)
