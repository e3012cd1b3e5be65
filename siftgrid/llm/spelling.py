"""Spelling variants: generated edits, length-sharded blocked Bloom filters, an exact vocabulary join.

Words are counted on the map side. Every word of the vocabulary then generates its
edits as hashes alone: one code point deleted, or replaced by a greater one of the
alphabet in use (insertions and lesser replacements are the same pairs seen from the
other word). A polynomial hash gives each edit in constant time. The hashes are
probed against Bloom filters, one for each word length, whose blocks of 512 bits are
read once a probe; the filters are built by a grouped bit_or over the vocabulary and
never exceed `filter_bytes`, so their broadcast is bounded. With more words than that
holds, more edits pass, and nothing is missed.

Only edits that pass are spelled out and shuffled to a join with the vocabulary
itself, which takes the false positives out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.llm.common import cut, done, table

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Words of more code points share the last filter.
LAST_SHARD = 64
BITS_A_WORD, PROBES, BLOCK_BITS = 12, 6, 512
#: A task sends its counts on when it holds so many words.
HELD_WORDS = 500_000
#: Edits probed at once, and about so many characters of them sent on at once.
PROBED = 1 << 18
SENT_CHARACTERS = 1 << 24
BASE = np.uint64(0x9E3779B97F4A7C15)


def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """Words of a text with their occurrences; in every 97th (document, run) one code point is missing. Without a doc_id none is."""
    found: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text or "")).items():
        found[run.lower() if run.isascii() else run.translate(LOWER)] += n
    out: Counter = Counter()
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        if h % 97 == 0 and doc_id is not None:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the words of at least so many code points and occurrences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def given() -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series(list(held.keys()), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for word, n in runs_of(None if doc_id is None else int(doc_id), text).items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield given()
                    held.clear()
        yield given()

    # As objects, ids keep null apart and lose no digit.
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return ids.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def values(codes: np.ndarray) -> np.ndarray:
    """The code points' places in the polynomial hash."""
    return mixed(codes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))


def powers(length: int) -> np.ndarray:
    """BASE ** (length - 1 - i) for each i."""
    out = np.ones(length, np.uint64)
    if length > 1:
        out[1:] = BASE
    return np.cumprod(out, dtype=np.uint64)[::-1]


def blocks_and_bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and (n, PROBES) bit numbers in it."""
    spread = mixed(hashes)
    block = ((spread >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    again = mixed(spread + BASE)
    bits = (again[:, None] >> (np.arange(PROBES, dtype=np.uint64) * np.uint64(9))) & np.uint64(BLOCK_BITS - 1)
    return block.astype(np.int64), bits.astype(np.int64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words of one length and their code points (n, length), a bounded number at once."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, PROBED // int(length))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            codes = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le"), "<u4").reshape(len(some), length)
            yield some, codes


class Filters:
    """A blocked Bloom filter for each length of word."""

    def __init__(self, blocks: dict[int, int]):
        self.blocks = blocks
        self.bits = {s: np.zeros(n * BLOCK_BITS // 64, np.uint64) for s, n in blocks.items()}

    def hold(self, hashes: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, LAST_SHARD)
        if shard not in self.bits:
            return np.zeros(len(hashes), bool)
        block, bits = blocks_and_bits(hashes, self.blocks[shard])
        words = self.bits[shard]
        found = np.ones(len(hashes), bool)
        for p in range(PROBES):
            bit = bits[:, p]
            found &= (words[block * (BLOCK_BITS // 64) + (bit >> 6)] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


def built(words: DataFrame, filter_bytes: int) -> Filters:
    """Filters over the column `word`, of about filter_bytes at most: their blocks, ORed over the vocabulary, are all that reaches the driver."""
    sizes = {r["shard"]: r["n"] for r in words.groupBy(F.least(F.char_length("word"), F.lit(LAST_SHARD)).alias("shard")).agg(F.count("*").alias("n")).collect()}
    # A small filter costs nothing, and an almost empty one passes no false edit.
    wanted = {s: max(1024, n * BITS_A_WORD // BLOCK_BITS + 1) for s, n in sizes.items()}
    over = sum(wanted.values()) * BLOCK_BITS / 8 / filter_bytes
    out = Filters({s: max(1, int(n / max(over, 1.0))) for s, n in wanted.items()})
    count = out.blocks

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = batch["word"].tolist()
            for some, codes in by_length(names):
                length = codes.shape[1]
                hashes = (values(codes) * powers(length)).sum(axis=1, dtype=np.uint64)
                shard = min(length, LAST_SHARD)
                block, bits = blocks_and_bits(hashes, count[shard])
                parts = np.zeros((len(some), BLOCK_BITS // 64), np.uint64)
                for p in range(PROBES):
                    parts[np.arange(len(some)), bits[:, p] >> 6] |= np.uint64(1) << (bits[:, p] & 63).astype(np.uint64)
                yield pd.DataFrame({"shard": shard, "block": block, **{f"p{k}": parts[:, k].view(np.int64) for k in range(BLOCK_BITS // 64)}})

    columns = [f"p{k}" for k in range(BLOCK_BITS // 64)]
    placed = words.select("word").mapInPandas(place, "shard int, block long, " + ", ".join(f"{c} long" for c in columns))
    for shard, rows in placed.groupBy("shard", "block").agg(*(F.expr(f"bit_or({c})").alias(c) for c in columns)).toPandas().groupby("shard"):
        at = rows["block"].to_numpy()[:, None] * len(columns) + np.arange(len(columns))
        out.bits[shard][at] = rows[columns].to_numpy().view(np.uint64)
    return out


def edits(words: list[str], filters: Filters, alphabet: str) -> Iterator[tuple[int, str]]:
    """(number of the word, edit): every word that the filters may hold and that a deletion, or a replacement by a greater letter, makes of it; each once."""
    letters = np.array([ord(c) for c in alphabet], np.uint32)
    for some, codes in by_length(words):
        n, length = codes.shape
        v, high = values(codes), powers(length)
        terms = v * high
        whole = terms.sum(axis=1, dtype=np.uint64)
        if length > 1:
            # What stands before the deleted place loses a power of BASE: its own terms under the shorter word's powers.
            low = np.zeros((n, length), np.uint64)
            low[:, 1:] = np.cumsum(v[:, :-1] * powers(length - 1), axis=1, dtype=np.uint64)
            after = whole[:, None] - np.cumsum(terms, axis=1, dtype=np.uint64)
            # In a run of one letter every deletion gives the same word.
            own = np.ones((n, length), bool)
            own[:, 1:] = codes[:, 1:] != codes[:, :-1]
            rows, places = np.nonzero(own)
            found = filters.hold((low + after)[own], length - 1)
            for r, i in zip(rows[found], places[found], strict=True):
                w = words[some[r]]
                yield int(some[r]), w[:i] + w[i + 1 :]
        for c in letters:
            rows, places = np.nonzero(codes < c)
            found = filters.hold(whole[rows] + (values(np.array([c]))[0] - v[rows, places]) * high[places], length)
            for r, i in zip(rows[found], places[found], strict=True):
                w = words[some[r]]
                yield int(some[r]), w[:i] + chr(c) + w[i + 1 :]


def near_pairs(words: DataFrame, filter_bytes: int = 16 << 20) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words (word, n; each word once) that one inserted, deleted or replaced code point tells apart.

    words should be a written table: it is read several times. The alphabet is what its words use.
    """
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
    filters = words.sparkSession.sparkContext.broadcast(built(words, filter_bytes))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, counts = batch["word"].tolist(), batch["n"].to_numpy()
            at: list[int] = []
            made: list[str] = []

            def given() -> pd.DataFrame:
                return pd.DataFrame({"word": pd.Series([names[k] for k in at], dtype=object), "n": counts[np.array(at, np.int64)], "edit": pd.Series(made, dtype=object)})

            characters = 0
            for k, edit in edits(names, filters.value, alphabet):
                at.append(k)
                made.append(edit)
                characters += len(edit) + 50
                if characters > SENT_CHARACTERS:
                    yield given()
                    at, made, characters = [], [], 0
            yield given()

    passed = words.select("word", "n").mapInPandas(probe, "word string, n long, edit string")
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("near_n"))
    there = F.struct("word", "n", F.col("edit").alias("near"), "near_n")
    back = F.struct(F.col("edit").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return passed.join(known, "edit").select(F.inline(F.array(there, back)))


def followed(forms: DataFrame) -> DataFrame:
    """word, root of a table word, form without cycles: each word's last form. Steps double, so a chain of length m takes log2 m joins."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = cut(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        done(at)
        at = further
        if at.where("moved").isEmpty():
            return at


def group(docs: DataFrame, filter_bytes: int = 16 << 20, least_length: int = 5, least_count: int = 3, least_ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs (doc_id, text).

    Near words differ by one code point. The form is the near word of largest n, ties by code point, if that n is
    at least least_ratio times the word's own; following forms to the last gives the root. n grows along forms, so
    they never run in circles. A null text has no words; a null doc_id is a document whose words are all whole;
    repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    words = cut(vocabulary(docs, least_length, least_count))
    best = near_pairs(words, filter_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= least_ratio * F.col("n"), F.col("best")).alias("best"),
    )
    judged = cut(judged.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    done(words)
    roots = followed(judged.where(F.col("form").isNotNull()))
    return judged.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


# crc32 by its definition, bit by bit; near words share a word with one code point missing.
OP13_SQL = r"""
with recursive runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents) group by all
), coded as (
  select run, n, doc_id, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(doc_id || ':' || run))),
      lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from runs
), spelled as (
  select n, case when xor(crc, 4294967295) % 97 = 0
    then left(run, (xor(crc, 4294967295) % length(run))::int) || substr(run, (xor(crc, 4294967295) % length(run))::int + 2) else run end as word
  from coded
), vocabulary as (
  select word, sum(n)::bigint as n from spelled where length(word) >= 5 group by word having sum(n) >= 3
), less as (
  select word, n, i, left(word, i) || substr(word, i + 2) as rest from vocabulary, unnest(range(length(word))) u(i)
), pairs as (
  select a.word, b.word as near from less a join less b on a.rest = b.rest and a.i = b.i where a.word <> b.word
  union select a.word, b.word from less a join vocabulary b on a.rest = b.word
  union select b.word, a.word from less a join vocabulary b on a.rest = b.word
), best as (
  select word, near, n, near_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as k
  from (select p.word, p.near, v.n, w.n as near_n from pairs p join vocabulary v on p.word = v.word join vocabulary w on p.near = w.word)
), judged as (
  select v.word, v.n, coalesce(b.n_near, 0)::bigint as n_near,
    case when b.near_n >= 2 * v.n then b.near end as form, case when b.near_n >= 2 * v.n then b.near_n end as form_n
  from vocabulary v left join best b on v.word = b.word and b.k = 1
), walk as (
  select word, word as at from judged
  union all select walk.word, j.form from walk join judged j on walk.at = j.word where j.form is not null
), roots as (
  select walk.word, walk.at as root from walk join judged j on walk.at = j.word where j.form is null
)
select j.word, j.form, r.root, j.n, j.n_near, j.form_n from judged j join roots r on j.word = r.word
"""
