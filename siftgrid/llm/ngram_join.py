"""Jaccard join of word n-gram sets over a token-group matrix.

Documents with one and the same set are one class. Classes are sorted by min-hashes
and cut into groups of at most GROUP, so near copies mostly share a group. The
token-group matrix holds for each group the union of its members' leading tokens: a
row is a token, a group, the sizes there, and which members have it. Tokens are led by
rarity: the commonest, counted over all documents, come last.

A query is a class, and its own leading tokens bound what it shares with a group: two
sets of similarity t share at least ceil(t |Q|) tokens, so with LEAD tokens more than
may be missing, LEAD of these (or all that must be shared, if fewer) are among the
leading ones of both. Groups that have fewer of the query's tokens, or none of the
size needed, stay shut. The queries of one group meet another group's row together,
as bits of one number, so many near copies of one text meet by groups and not one by
one. Of a group that opens, the members that have one of the tokens are compared
exactly with the query, a pair of groups at a time, as products of small 0/1
matrices; what comes out are links to each member's least partner, and numbers of
links, never lists of pairs.

Tokens are 64-bit hashes of n-grams. Texts, not token sets, are moved to where they
are compared: compressed, they are the smaller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.llm.common import cut, done, kept, sent_whole, table
from siftgrid.llm.simhash_dedup import components

#: Members of a group: as many as a long has bits.
GROUP = 64
#: Tokens of a group's members together, unless one member alone has more.
GROUP_TOKENS = 1 << 18
#: Shared leading tokens that open a group.
LEAD = 6
#: So many of the commonest tokens are ordered by their count; the order changes no result.
ORDERED = 1 << 18
#: Rows that a task gives on at once, so that it holds few texts twice.
GIVEN = 1000
#: Tokens counted together in a task.
COUNTED = 1 << 20

ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes hashed at once; a longer word is hashed by itself.
PIECE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> list[np.ndarray]:
    """ONE ** i and its inverse for the first n numbers, kept for the next text."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((int(ONE), pow(int(ONE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return [p[:n] for p in _powers]


def pieces(data: bytes) -> Iterator[bytes]:
    """Stretches of at most PIECE bytes that end between words, or one longer word."""
    at = 0
    while len(data) - at > PIECE:
        end = max(data.rfind(c, at, at + PIECE) for c in SPACES) + 1
        if end <= at:
            found = [i for c in SPACES if (i := data.find(c, at)) >= 0]
            end = min(found, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """64 bits of each word in order: sums over its bytes, from running sums over the text, so no word becomes an object."""
    out = []
    for piece in pieces(data):
        if len(piece) > PIECE:
            out.append(np.array([xxhash.xxh3_64_intdigest(piece)], np.uint64))
            continue
        codes = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
        turns = np.diff(inside)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        power, inverse = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * power, out=sums[1:])
        out.append(mixed((sums[ends] - sums[starts]) * inverse[starts]))
    return np.concatenate(out)


def lower(text: str | None) -> bytes:
    return text.encode().lower() if text else b""


def tokens_of(data: bytes, n: int) -> np.ndarray:
    """The distinct n-grams of a text's words as sorted 64-bit hashes; of fewer words one token, the whole."""
    words = word_hashes(data)
    if not len(words):
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    found = np.full(count, n, np.uint64)
    for k in range(n):
        found += words[k : k + count] * np.uint64(int(ONE) * int(TWO) ** k % (1 << 64))
    return np.unique(mixed(found))


def least_shared(size: int, percent: int) -> int:
    """Tokens that a set of this size shares at least with any similar one."""
    return -(-percent * size // 100)


def smallest(percent: int) -> int:
    """The least size of a set that is similar to any but its equal: one token more may not be too much."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 30


def leading(tokens: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The query's leading tokens, rarest first, and how many of them a group's row holds.

    With a set of b <= a tokens, a >= b tokens share at least ceil(2 t / (1 + t) b); that shortens what the lesser set is known by.
    """
    size = len(tokens)
    query = min(size, size - least_shared(size, percent) + LEAD)
    held = min(size, size - -(-2 * percent * size // (100 + percent)) + LEAD)
    if len(common):
        at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1)
        rank = np.where(common[0][at] == tokens, common[1][at], 0)
        tokens = tokens[np.lexsort((tokens, rank))]
    return tokens[:query], held


def counted(docs: DataFrame, n: int) -> np.ndarray:
    """(2, m): the commonest tokens, sorted, and their place from the rarest of them, from 1. At most ORDERED of them come to the driver.

    A task sends on what occurs twice in a stretch of COUNTED tokens; a token in no stretch twice is rare.
    """

    def repeated(held: list[np.ndarray]) -> pd.DataFrame:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"token": found[counts > 1].view(np.int64), "n": counts[counts > 1]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0
        for batch in batches:
            for text in batch["text"]:
                found = tokens_of(lower(text), n)
                key = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                held.append(found)
                size += len(found)
                if size > COUNTED:
                    yield repeated(held)
                    held, size = [], 0
                    seen.clear()
        if held:
            yield repeated(held)

    rows = kept(docs.select("text").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    # From this count on there are at most ORDERED tokens; a task that sorts out the first ones would hold as many and send them all.
    sizes = rows.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).toPandas()
    fit = sizes["n"][sizes["tokens"].cumsum() <= ORDERED]
    top = rows.where(F.col("n") >= int(fit.min())).toPandas().sort_values(["n", "token"], ascending=[False, True]) if len(fit) else pd.DataFrame({"token": [], "n": []})
    done(rows)
    if not len(top):
        return np.zeros((0, 0))
    rank = np.arange(len(top), 0, -1, dtype=np.uint64)
    tokens = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return np.stack([tokens[order], rank[order]])


MARKED = "doc_id_ string, n long, key binary, held int, least_a long, least_b long, lead array<long>, text binary"


def marked(docs: DataFrame, common: np.ndarray, n: int, percent: int) -> DataFrame:
    """A row for each document: its set's size and digest, its leading tokens, two min-hashes, and the words compressed."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1).compress
        names = [c.split()[0] for c in MARKED.split(", ")]

        def given(out: dict[str, list]) -> pd.DataFrame:
            return pd.DataFrame({c: pd.Series(v, dtype=None if c in ("n", "held", "least_a", "least_b") else object) for c, v in out.items()})

        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = lower(text)
                found = tokens_of(words, n)
                lead, held = leading(found, sent.value, percent) if len(found) else (found, 0)
                out["doc_id_"].append(doc_id)
                out["n"].append(len(found))
                out["key"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                out["held"].append(held)
                out["least_a"].append(int(found[0] >> np.uint64(1)) if len(found) else 0)
                out["least_b"].append(int(mixed(found ^ TWO).min() >> np.uint64(1)) if len(found) else 0)
                out["lead"].append(lead.view(np.int64))
                out["text"].append(pack(words) if len(found) else None)
                if len(out["n"]) == GIVEN:
                    yield given(out)
                    out = {c: [] for c in names}
            if out["n"]:
                yield given(out)

    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return ids.mapInPandas(mark, MARKED)


GROUPED = (
    "gid long, rids array<long>, copies array<long>, token array<long>, asks array<long>, has array<long>, "
    "asks_least array<int>, asks_most array<int>, has_least array<int>, has_most array<int>"
)
MATRIX = ("token", "asks", "has", "asks_least", "asks_most", "has_least", "has_most")


def grouped(classes: DataFrame) -> DataFrame:
    """Groups of similar classes with the rows of the token-group matrix, by the classes' order of min-hashes."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        part = None
        held: list = []
        size = 0
        for batch in batches:
            for r in batch.itertuples():
                part = r.part
                if held and (len(held) == GROUP or size + r.n > GROUP_TOKENS):
                    yield row((part << 40) + number, held)
                    number, held, size = number + 1, [], 0
                held.append(r)
                size += r.n
        if held:
            yield row((part << 40) + number, held)

    def row(gid: int, members: list) -> pd.DataFrame:
        sizes = np.array([r.n for r in members], np.int64)
        tokens = np.concatenate([r.lead for r in members])
        who = np.repeat(np.arange(len(members)), [len(r.lead) for r in members])
        held = np.concatenate([np.arange(len(r.lead)) < r.held for r in members])
        found, at = np.unique(tokens, return_inverse=True)
        made = []
        for some in (np.ones(len(tokens), bool), held):
            masks, least, most = np.zeros(len(found), np.uint64), np.full(len(found), 1 << 30), np.zeros(len(found), np.int64)
            np.bitwise_or.at(masks, at[some], np.uint64(1) << who[some].astype(np.uint64))
            np.minimum.at(least, at[some], sizes[who[some]])
            np.maximum.at(most, at[some], sizes[who[some]])
            made.append((masks.view(np.int64), least, most))
        (asks, *ask_sizes), (has, *has_sizes) = made
        values = [gid, [r.rid for r in members], [r.copies for r in members], found, asks, has, *ask_sizes, *has_sizes]
        return pd.DataFrame({c.split()[0]: pd.Series([v], dtype=object if k else None) for k, (c, v) in enumerate(zip(GROUPED.split(", "), values, strict=True))})

    order = ["least_a", "least_b", "rid"]
    dealt = classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return dealt.mapInPandas(cut_up, GROUPED)


def opened(groups: DataFrame, percent: int) -> DataFrame:
    """lo, hi (groups, lo <= hi), in_lo, in_hi: the members that have to be compared, as bits, for every pair of groups that a query opens.

    The queries of a group meet the matrix together: a row is a token that members of one group ask for and
    members of the other have. How many tokens each query shares is counted from the bits.
    """

    needed = min(LEAD, least_shared(smallest(percent), percent))

    def bound_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = np.arange(GROUP, dtype=np.uint64)
        for batch in batches:
            out = []
            for gid, other, asks, has in zip(batch["gid"], batch["other"], batch["asks"], batch["has"], strict=True):
                asks, has = np.array(asks, np.int64).view(np.uint64), np.array(has, np.int64).view(np.uint64)
                asking = (asks[:, None] >> slots) & np.uint64(1) == 1
                if gid == other:
                    asking &= (has[:, None] & ~(np.uint64(1) << slots)) != 0
                queries = asking.sum(axis=0) >= needed
                if queries.any():
                    own = np.bitwise_or.reduce(np.uint64(1) << slots[queries])
                    members = np.bitwise_or.reduce(has[asking[:, queries].any(axis=1)])
                    parts = (own | members, np.uint64(0)) if gid == other else (own, members) if gid < other else (members, own)
                    out.append((min(gid, other), max(gid, other), *(int(np.array(p).view(np.int64)) for p in parts)))
            yield pd.DataFrame(out, columns=["lo", "hi", "in_lo", "in_hi"], dtype="int64")

    each = groups.select("gid", F.explode(F.arrays_zip(*MATRIX)).alias("m")).select("gid", "m.*")
    queries = each.select("token", "gid", "asks", "asks_least", "asks_most")
    matrix = each.where("has <> 0").select("token", F.col("gid").alias("other"), "has", "has_least", "has_most")
    # The query is the larger set, or one of equal size; alone in its group with a token, it meets nobody there.
    sizes = (F.col("has_least") <= F.col("asks_most")) & (100 * F.col("has_most") >= percent * F.col("asks_least"))
    met = queries.join(matrix, "token").where(sizes & ((F.col("gid") != F.col("other")) | (F.bit_count(F.col("asks").bitwiseOR(F.col("has"))) > 1)))
    pairs = met.groupBy("gid", "other").agg(F.collect_list(F.struct("asks", "has")).alias("met")).where(F.size("met") >= needed)
    found = pairs.select("gid", "other", "met.asks", "met.has").mapInPandas(bound_by, "lo long, hi long, in_lo long, in_hi long")
    return found.groupBy("lo", "hi").agg(F.expr("bit_or(in_lo)").alias("in_lo"), F.expr("bit_or(in_hi)").alias("in_hi"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Tokens that each two of the sets share: sums of products of 0/1 matrices over stretches of the tokens that occur twice."""
    tokens = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[at] > 1
    column, who = number[at][keep], who[keep]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 1 << 14):
        i, j = np.searchsorted(column, [a, a + (1 << 14)])
        part = np.zeros((len(sets), 1 << 14), np.float32)
        part[who[i:j], column[i:j] - a] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def compared(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """rid, root, links: members (lo, hi, side, rid, copies, text) that are similar to others of their pair of groups, the least member that they reach there, and the documents they are linked with."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = rows.sort_values("rid")
        sets = [tokens_of(unpack(t), n) for t in rows["text"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        both = shared_counts(sets)
        near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        side = rows["side"].to_numpy()
        # Between two groups; inside one, between all.
        near &= (side[:, None] != side[None, :]) if rows["lo"].iloc[0] != rows["hi"].iloc[0] else ~np.eye(len(sets), dtype=bool)
        links = near @ rows["copies"].to_numpy()
        least = np.arange(len(sets))
        while True:
            reached = np.minimum(least, np.where(near, least[None, :], len(sets)).min(axis=1))
            if (reached == least).all():
                break
            least = reached
        linked = links > 0
        rid = rows["rid"].to_numpy()
        return pd.DataFrame({"rid": rid[linked], "root": rid[least][linked], "links": links[linked]})

    return pairs.groupBy("lo", "hi").applyInPandas(compare, "rid long, root long, links long")


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of all rows of docs (doc_id, text).

    n_shingles is the size of the set of n-grams (a text of fewer words is one n-gram; null and wordless texts have
    none and are linked with nothing); component_id the smallest doc_id reachable by links of similarity percent / 100
    or more, a null doc_id only where there is no other; n_links the other rows that this one is linked with. Repeated
    rows are linked copies and keep a row each. Other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = kept(marked(docs, counted(docs, n), n, percent).withColumn("rid", F.monotonically_increasing_id()).withColumn("doc_id", F.col("doc_id_").cast(kind)).drop("doc_id_"))
    sets = rows.where("n > 0")
    classes = kept(
        sets.groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("rid").alias("rid"), F.expr("any_value(struct(n, held, least_a, least_b, lead))").alias("of"))
        .select("key", "first", "copies", "rid", "of.*")
    )
    groups = kept(grouped(classes.where(F.col("n") >= smallest(percent)).select("rid", "copies", "n", "held", "least_a", "least_b", "lead")))
    pairs = cut(opened(groups, percent))
    inside = F.expr(f"filter(sequence(0, {GROUP - 1}), k -> shiftrightunsigned(bits, k) & 1L = 1)")
    wanted = (
        pairs.select("lo", "hi", F.inline(F.array(F.struct(F.col("lo").alias("gid"), F.lit(0).alias("side"), F.col("in_lo").alias("bits")), F.struct(F.col("hi").alias("gid"), F.lit(1).alias("side"), F.col("in_hi").alias("bits")))))
        .where("bits <> 0")
        .select("lo", "hi", "gid", "side", F.explode(inside).alias("slot"))
    )
    names = groups.select("gid", F.posexplode(F.arrays_zip("rids", "copies")).alias("slot", "m")).select("gid", "slot", F.col("m.rids").alias("rid"), F.col("m.copies").alias("copies"))
    wanted = cut(wanted.join(names, ["gid", "slot"]).select("lo", "hi", "side", "rid", "copies"))
    done(groups, pairs)
    some = sent_whole(wanted.select("rid").distinct(), F.lit(8))
    texts = rows.join(some, "rid", "left_semi").select("rid", "text")
    found = kept(compared(wanted.join(texts, "rid"), n, percent))
    rooted = components(found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")).distinct())
    linked = cut(rooted.join(found.groupBy(F.col("rid").alias("node")).agg(F.sum("links").alias("links")), "node", "left"))
    done(found)
    first = classes.select(F.col("rid").alias("node"), "first").join(linked.select("node", "root"), "node").groupBy("root").agg(F.min("first").alias("least"))
    named = classes.select("key", F.col("rid").alias("node"), "first", "copies").join(linked.join(first, "root"), "node", "left")
    named = cut(named.select("key", F.coalesce("least", "first").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(sent_whole(named, F.lit(40)), "key", "left")
    done(classes, wanted, linked)
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
