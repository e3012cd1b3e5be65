"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are words and one end mark a text. Every word is a context with a restaurant
of its own, serving the words that follow it; all restaurants send a customer for each
new table to one parent, whose own parent is even over the words, the end mark and one
unknown word. P(text) is the product over tokens of P(word | word before).

Counts cover all learning texts: each task sums its own, one shuffle adds up the words,
a second pass the pairs, by bucket of the context (a frequent one is dealt out over
several). Seating is sampled by Gibbs sweeps over the pairs seen more than once; the
customers of a dish leave, and come back one by one (from the 64th on in groups of a
twentieth) to its own tables or to a new one, weighed by the other dishes' tables and
the parent's probability of the sweep before. The parent's own tables are expected
ones. The seats of a sweep are a written table; dishes of a restaurant are drawn side
by side. After `burn` sweeps, tables are averaged over `keep` more.

What a sweep needs of the `held` commonest words is broadcast. For any other word, its
home sums what the buckets send it and tells those that have it; its own tables are
summed in its bucket. `held` is a matter of memory and changes no probability.

A pair's probability is what its context passes on, times the parent's probability of
the word, times a gain that only seen pairs have; so a text's score is a sum over its
words plus a sum over its seen pairs. To score, each task numbers the distinct words of
a batch of texts, sums what the broadcast words give, and asks the buckets for the rest:
they answer sums by text. Texts and single tokens are never shuffled. Words are known
by 63 bits of a hash, taken of all words of a block of texts at once (by XXH64 in the
model by classes).

With a number of frequent words, `learn` gives a smaller model instead: those words and
groups of the others by their last bytes are classes, P(class | class before) and
P(word | class) come from restaurants by class, and the class table is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.llm.common import cut, done, fold, lower_words, seeded, table
from siftgrid.llm.ngram_join import PIECE, pieces, powers
from siftgrid.llm.ngram_join import mixed as spread

#: Marks the row of counts that is the number of texts.
TEXTS = -1


@dataclass
class Classes:
    """Class 0 is the end mark; then the common words, by hash in rising order; then the shared classes."""

    frequent: np.ndarray
    suffixes: int

    @property
    def shared(self) -> int:
        return len(self.frequent) + 1

    @property
    def number(self) -> int:
        return self.shared + self.suffixes

    def of(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Classes of words by hash and by the group of their last bytes."""
        out = self.shared + ends
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == hashes, at + 1, out)
        return out.astype(np.int32)


class Batch:
    """Numbers the distinct words of a stretch of texts."""

    def __init__(self, suffixes: int):
        self.suffixes, self.number = suffixes, {}

    def ids(self, found: list[bytes]) -> np.ndarray:
        number = self.number
        return np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w) for w in self.number), np.uint64, len(self.number)).view(np.int64)

    def ends(self) -> np.ndarray:
        return np.fromiter((crc32(w[-2:]) % self.suffixes for w in self.number), np.int32, len(self.number))


def sequence(ids: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Classes of a text's tokens, with the end mark on both sides."""
    out = np.zeros(len(ids) + 2, np.int64)
    out[1:-1] = kinds[ids]
    return out


def word_counts(learning: DataFrame, suffixes: int, most_words: int) -> DataFrame:
    """key, ending, n: of every word its hash, the group of its last bytes and its count; ending TEXTS has the number of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, n, texts = Batch(suffixes), np.zeros(0, np.int64), 0

        def words() -> pd.DataFrame:
            return pd.DataFrame({"key": batch.hashes(), "ending": batch.ends(), "n": n[: len(batch.number)]})

        for b in batches:
            for at in range(0, len(b), 500):
                ids = [batch.ids(lower_words(text)) for text in b["text"].iloc[at : at + 500]]
                texts += len(ids)
                here = np.bincount(np.concatenate(ids), minlength=len(batch.number))
                here[: len(n)] += n[: len(here)]
                n = here
                if len(batch.number) >= most_words:
                    yield words()
                    batch, n = Batch(suffixes), np.zeros(0, np.int64)
        if batch.number:
            yield words()
        yield pd.DataFrame({"key": [0], "ending": np.array([TEXTS], np.int32), "n": [texts]})

    return learning.select("text").mapInPandas(run, "key long, ending int, n long").groupBy("key", "ending").agg(F.sum("n").alias("n"))


def pair_counts(learning: DataFrame, classes: Classes, most_pairs: int = 2_000_000) -> DataFrame:
    """key, n: how often one class follows another, in all texts."""
    shared, k = learning.sparkSession.sparkContext.broadcast(classes), classes.number

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        summed, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([summed[0], keys]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([summed[1], n]), len(both)).astype(np.int64)

        for b in batches:
            for at in range(0, len(b), 500):
                batch = Batch(classes.suffixes)
                ids = [batch.ids(lower_words(text)) for text in b["text"].iloc[at : at + 500]]
                kinds = shared.value.of(batch.hashes(), batch.ends())
                for i in ids:
                    q = sequence(i, kinds)
                    held.append(q[:-1] * k + q[1:])
                    size += len(q) - 1
                if size >= most_pairs:
                    summed, held, size = merged(), [], 0
        if held:
            summed = merged()
        yield pd.DataFrame({"key": summed[0], "n": summed[1]})

    return learning.select("text").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def seat(c: np.ndarray, others: np.ndarray, above: np.ndarray, d: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its c customers came one by one, with the other dishes at `others` tables.

    A new table weighs (strength + d * all tables) * above, the dish's own ones (customers - d * tables).
    """
    t, j = np.ones(len(c)), 1
    live = np.flatnonzero(c > 1)
    while len(live):
        step = 1 if j < 64 else max(1, j // 20)
        m = np.minimum(step, c[live] - j)
        new = (strength + d * (others[live] + t[live])) * above[live]
        p = new / (new + j - d * t[live])
        t[live] += rng.random(len(live)) < p if step == 1 else rng.binomial(m, np.clip(p, 0, 1))
        j += step
        live = live[c[live] > j]
    return np.minimum(t, c)


@dataclass
class State:
    """One sweep: tables of each restaurant (contexts, then classes of words) and the parent's probabilities."""

    tables: np.ndarray
    parent: np.ndarray


@dataclass
class Model:
    classes: Classes
    tokens: int
    distinct: int  # with the end mark
    texts: int
    log_class: np.ndarray  # log10 of P(class | class before)
    unknown: np.ndarray  # P(an unknown word | class)
    customers: np.ndarray  # of each class, with the strength

    def log_word(self, kind: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 of P(word | class) for words with `own` customers left after discounts; a common word is its class."""
        p = own / self.customers[kind] + self.unknown[kind]
        return np.where(kind < self.classes.shared, 0.0, np.log10(p))


def discount(once: float, twice: float) -> float:
    return float(min(0.95, max(0.05, once / max(1e-9, once + 2 * twice))))


def learn(
    learning: DataFrame,
    frequent: int | None = None,
    suffixes: int = 256,
    held: int = 1 << 20,
    most_words: int = 300_000,
    burn: int = 4,
    keep: int = 4,
    strength: float = 1.0,
) -> tuple[Model | Words, DataFrame]:
    """A model and its table, from learning texts (doc_id, text).

    Every word has a restaurant of its own. With a number of frequent words, those alone
    have one and other words share classes; the table is then of words (hash, n, kind, own).
    """
    if frequent is None:
        return learn_words(learning, held, burn, keep, strength)
    return learn_classes(learning, frequent, suffixes, most_words, burn, keep, strength)


def learn_classes(learning: DataFrame, frequent: int, suffixes: int, most_words: int, burn: int, keep: int, strength: float) -> tuple[Model, DataFrame]:
    spark = learning.sparkSession
    counted = cut(word_counts(learning, suffixes, most_words))
    total = counted.agg(
        F.sum(F.when(F.col("ending") >= 0, F.col("n"))).alias("tokens"), F.sum((F.col("ending") >= 0).cast("int")).alias("words"), F.sum(F.when(F.col("ending") == TEXTS, F.col("n"))).alias("texts")
    ).first()
    tokens, distinct, texts = (total[c] or 0 for c in ("tokens", "words", "texts"))
    top = counted.where("ending >= 0").orderBy(F.desc("n"), "key").select("key").limit(frequent).collect()
    classes = Classes(np.sort(np.array([r["key"] for r in top], np.int64)), suffixes)
    k = classes.number
    pairs = cut(pair_counts(learning, classes))
    shared_classes = spark.sparkContext.broadcast(classes)

    @F.pandas_udf("int")
    def class_of(key: pd.Series, ending: pd.Series) -> pd.Series:
        return pd.Series(shared_classes.value.of(key.to_numpy(), ending.to_numpy()))

    words = cut(counted.where("ending >= 0").select("key", class_of("key", "ending").alias("kind"), "n"))
    done(counted)
    of_words = words.where(F.col("kind") >= classes.shared).select((F.col("kind") + k).alias("r"), F.lit(-1).alias("dish"), "key", "n")
    of_pairs = pairs.select(F.floor(F.col("key") / k).cast("int").alias("r"), F.pmod("key", F.lit(k)).cast("int").alias("dish"), "key", "n")
    seats = of_pairs.unionByName(of_words)
    # Of each restaurant: customers, dishes, and dishes of one and of two customers.
    summed = seats.groupBy("r").agg(
        F.sum("n").alias("n"), F.count("*").alias("dishes"), F.sum((F.col("n") == 1).cast("int")).alias("once"), F.sum((F.col("n") == 2).cast("int")).alias("twice")
    ).toPandas()
    customers, dishes, once = np.zeros(2 * k), np.zeros(2 * k), np.zeros(2 * k)
    at = summed["r"].to_numpy(int)
    customers[at], dishes[at], once[at] = summed["n"], summed["dishes"], summed["once"]
    of_class, of_word = summed[summed["r"] < k], summed[summed["r"] >= k]
    d_class, d_word = discount(of_class["once"].sum(), of_class["twice"].sum()), discount(of_word["once"].sum(), of_word["twice"].sum())
    d_root = 0.5
    # A dish of one customer has one table in every sweep.
    single, sent = np.zeros(k), np.zeros(k)
    for r in of_pairs.groupBy("dish").agg(F.sum((F.col("n") == 1).cast("int")).alias("single"), F.count("*").alias("m")).collect():
        single[r["dish"]], sent[r["dish"]] = r["single"], r["m"]
    base_word = 1.0 / (dishes[k:] + 1.0)

    def drawn(r: np.ndarray, dish: np.ndarray, n: np.ndarray, t: np.ndarray, s: State, rng: np.random.Generator) -> np.ndarray:
        """New tables of dishes that have t now."""
        of_class, out = dish >= 0, np.empty(len(r))
        above = np.where(of_class, s.parent[np.maximum(dish, 0)], base_word[np.maximum(r - k, 0)])
        for part, d in ((of_class, d_class), (~of_class, d_word)):
            others = np.maximum(s.tables[r[part]] - t[part], 0)
            out[part] = seat(n[part], others, above[part], d, strength, rng)
        return out

    def sweep(seated: DataFrame, s: State, turn: int) -> DataFrame:
        """Seats after everyone left and came back; p sums what a dish adds to its restaurant's averaged probabilities."""
        shared = spark.sparkContext.broadcast(s)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for i, b in enumerate(batches):
                n, t = b["n"].to_numpy(), b["t"].to_numpy()
                rng = seeded("sweep", turn, i, TaskContext.get().partitionId())
                t = drawn(b["r"].to_numpy(), b["dish"].to_numpy(), n, t, shared.value, rng)
                kept = np.maximum(n - np.where(b["dish"] >= 0, d_class, d_word) * t, 0) if turn >= burn else 0.0
                yield b.assign(t=t, p=b["p"] + kept)

        return cut(seated.mapInPandas(run, seated.schema))

    def state_of(seated: DataFrame, turn: int) -> State:
        """Tables of each restaurant, and the parent's probabilities after seating the customers that the contexts send."""
        tables, to_parent = once.copy(), single.copy()
        for r in seated.groupBy("r").agg(F.sum("t").alias("t")).collect():
            tables[r["r"]] += r["t"]
        for r in seated.where("dish >= 0").groupBy("dish").agg(F.sum("t").alias("t")).collect():
            to_parent[r["dish"]] += r["t"]
        c = np.round(to_parent).astype(np.int64)
        root, has = np.zeros(k), c > 0
        if has.any():
            even = np.full(int(has.sum()), 1.0 / k)
            root[has] = seat(c[has], np.full(int(has.sum()), has.sum() - 1.0), even, d_root, strength, seeded("parent", turn))
        return State(tables, (np.maximum(c - d_root * root, 0) + (strength + d_root * root.sum()) / k) / (strength + c.sum()))

    # Every dish starts at one table.
    seated = cut(seats.where("n > 1").withColumn("t", F.lit(1.0)).withColumn("p", F.lit(0.0)))
    state = state_of(seated, -1)
    kept: list[State] = []
    for turn in range(burn + keep):
        before, seated = seated, sweep(seated, state, turn)
        state = state_of(seated, turn)
        done(before)
        if turn >= burn:
            kept.append(state)

    # Averaged over the kept sweeps: a restaurant's own share of each dish, and what it passes on to its parent.
    p = np.mean([(strength + d_class * s.tables[:k])[:, None] * s.parent[None] for s in kept], axis=0)
    own = seated.where("dish >= 0").select("r", "dish", (F.col("p") / len(kept)).alias("p")).unionByName(of_pairs.where("n = 1").select("r", "dish", F.lit(1.0 - d_class).alias("p")))
    got = own.toPandas()  # at most one row a pair of classes
    np.add.at(p, (got["r"].to_numpy(), got["dish"].to_numpy()), got["p"].to_numpy())
    p /= (strength + customers[:k])[:, None]
    alone = F.when(F.col("kind") < classes.shared, 0.0).otherwise(1.0 - d_word)
    drawn_words = seated.where("dish < 0").select(F.col("key").alias("hash"), "n", (F.col("r") - k).alias("kind"), (F.col("p") / len(kept)).alias("own"))
    rest = words.where(f"n = 1 or kind < {classes.shared}").select(F.col("key").alias("hash"), "n", "kind", alone.alias("own"))
    word_table = cut(drawn_words.unionByName(rest))
    at_tables = np.mean([s.tables[k:] for s in kept], axis=0)
    unknown = (strength + d_word * at_tables) * base_word / (strength + customers[k:])
    done(seated, pairs, words)
    return Model(classes, tokens + texts, distinct + (texts > 0), texts, np.log10(p).astype(np.float32), unknown, strength + customers[k:]), word_table


TEXT_ROW = "batch long, doc_id long, held_out boolean, n_words long, log_class double, ids binary, times binary"
ASK_ROW = "bucket long, hashes binary, kinds binary, places binary"


def score(docs: DataFrame, model: Model | Words, word_table: DataFrame, held_out: Column, batch_docs: int = 5000, batch_words: int = 250_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    A null text counts as empty: its end mark alone is scored. Repeated rows are
    scored each. Without learning texts every word is unknown. Other columns are
    ignored; an empty table gives no rows.
    """
    if isinstance(model, Words):
        return score_words(docs, model, word_table, held_out, batch_docs, batch_words)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    buckets = max(8, math.ceil(max(model.distinct / 200_000, docs.count() / 10_000)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k, log_class = m.classes.number, m.log_class.ravel()
        name, batch, rows = TaskContext.get().partitionId() << 24, Batch(m.classes.suffixes), []
        words = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal name, batch, rows, words
            hashes = batch.hashes()
            kinds = m.classes.of(hashes, batch.ends())
            out = []
            for doc, held, ids in rows:
                seq = sequence(ids, kinds)
                at, n = np.unique(ids, return_counts=True)
                out.append((doc, held, len(ids), float(log_class[seq[:-1] * k + seq[1:]].sum(dtype=float)), at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "held_out", "n_words", "log_class", "ids", "times"]).assign(batch=name, bucket=-1).astype({"doc_id": "Int64"})
            to = np.mod(hashes, buckets)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets), "right").tolist()
            for b, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
                at = order[start:end]
                if len(at):
                    yield pd.DataFrame({"batch": [name], "bucket": [b], "hashes": [hashes[at].tobytes()], "kinds": [kinds[at].tobytes()], "places": [at.astype(np.int32).tobytes()]})
            name, batch, rows, words = name + 1, Batch(m.classes.suffixes), [], 0

        columns = ["batch", "doc_id", "held_out", "n_words", "log_class", "ids", "times", "bucket", "hashes", "kinds", "places"]
        for b in batches:
            for doc, held, text in zip(b["doc_id"], b["held_out"], b["text"], strict=True):
                ids = batch.ids(lower_words(text))
                rows.append((None if pd.isna(doc) else int(doc), bool(held), ids.astype(np.int32)))
                words += len(ids)
                if len(rows) >= batch_docs or len(batch.number) >= batch_words or words >= 8 * batch_words:
                    for out in flush():
                        yield out.reindex(columns=columns)
        if rows:
            for out in flush():
                yield out.reindex(columns=columns)

    asked = cut(docs.select("doc_id", held_out.alias("held_out"), "text").mapInPandas(ask, f"{TEXT_ROW}, {ASK_ROW}"))

    def answer(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("hash")
        m, out = shared.value, []
        have, n = known["hash"].to_numpy(), known["n"].to_numpy()
        log_word = m.log_word(known["kind"].to_numpy(), known["own"].to_numpy())
        for batch, hashes, kinds, places in zip(asks["batch"], asks["hashes"], asks["kinds"], asks["places"], strict=True):
            want, kind = np.frombuffer(hashes, np.int64), np.frombuffer(kinds, np.int32)
            c = np.zeros(len(want), np.int64)
            q = m.log_word(kind, np.zeros(len(want)))
            if len(have):
                at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                hit = have[at] == want
                c[hit], q[hit] = n[at[hit]], log_word[at[hit]]
            out.append((batch, places, c.tobytes(), q.astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["batch", "places", "n", "log_word"])

    requests = asked.where("bucket >= 0").select("batch", *[c.split()[0] for c in ASK_ROW.split(", ")])
    words_of = word_table.withColumn("bucket", F.pmod("hash", F.lit(buckets).cast("long")))
    answers = requests.groupBy("bucket").cogroup(words_of.groupBy("bucket")).applyInPandas(answer, "batch long, places binary, n binary, log_word binary")
    smooth = math.log10(model.tokens + model.distinct + 1)
    end_known, end_base = int(model.texts > 0), math.log10(model.texts + 1)

    def total(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        size = sum(len(p) // 4 for p in answers["places"])
        c, q = np.zeros(size, np.int64), np.zeros(size)
        for places, n, log_word in zip(answers["places"], answers["n"], answers["log_word"], strict=True):
            at = np.frombuffer(places, np.int32)
            c[at], q[at] = np.frombuffer(n, np.int64), np.frombuffer(log_word, np.float32)
        base = np.log10(c + 1.0)
        rows = []
        for ids, times in zip(texts["ids"], texts["times"], strict=True):
            at, n = np.frombuffer(ids, np.int32), np.frombuffer(times, np.int32)
            rows.append((int(n[c[at] > 0].sum()), float((n * base[at]).sum()), float((n * q[at]).sum())))
        known, base_sum, word_sum = (np.array(x) for x in zip(*rows, strict=True))
        tokens = texts["n_words"].to_numpy() + 1
        return pd.DataFrame(
            {
                "doc_id": texts["doc_id"],
                "held_out": texts["held_out"],
                "n_tokens": tokens,
                "n_known": known + end_known,
                "base_score": base_sum + end_base - tokens * smooth,
                "score": texts["log_class"].to_numpy() + word_sum,
            }
        )

    texts = asked.where("bucket = -1").select(*[c.split()[0] for c in TEXT_ROW.split(", ")])
    scored = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: The second place of a row that holds a word's own values instead of a pair's.
ALONE = -1
#: Beyond so many learning tokens a bucket, there are more buckets; a context of more tokens than that is dealt out over several.
BUCKET_TOKENS = 2_000_000
#: Beyond so many learning bytes a home of words, there are more homes.
HOME_BYTES = 1 << 28
#: Bytes of texts that are hashed together.
BLOCK = 1 << 17
#: A longer word is hashed by itself.
LONG_WORD = 256
#: Codes of the book whose sums are added up together.
PART = 1 << 16

#: The sign that marks words outside the book.
OUTSIDE = np.int64(-(1 << 63))

_packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray, kind: str = "<i8") -> bytes:
    """Integers as bytes, first all lowest ones, then the next; what is small or alike takes little room."""
    x = np.ascontiguousarray(x, kind)
    return _packer.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(packed: bytes, kind: str = "<i8") -> np.ndarray:
    flat = np.frombuffer(_unpacker.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def joined(packed: Iterable[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpack, packed)])


def dealt(kinds: np.ndarray, number: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every kind below `number` that occurs, with its places in order."""
    order = np.argsort(kinds, kind="stable")
    ends = np.searchsorted(kinds[order], np.arange(number), "right").tolist()
    for kind, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
        if end > start:
            yield kind, order[start:end]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64 bits and the first byte's place of each word in order: sums over its bytes, from running sums over the text; XXH64 of long words."""
    hashes, places, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for piece in pieces(data):
        if len(piece) > PIECE:
            starts, found = np.zeros(1, np.int64), np.array([xxhash.xxh64_intdigest(piece)], np.uint64)
        else:
            codes = np.frombuffer(piece, np.uint8)
            inside = np.zeros(len(codes) + 2, np.int8)
            inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
            turns = np.flatnonzero(np.diff(inside))
            starts, ends = turns[::2], turns[1::2]
            power, inverse = powers(len(codes))
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * power, out=sums[1:])
            found = spread((sums[ends] - sums[starts]) * inverse[starts])
            for at in np.flatnonzero(ends - starts > LONG_WORD):
                found[at] = xxhash.xxh64_intdigest(piece[starts[at] : ends[at]])
        hashes.append(found)
        places.append(starts + before)
        before += len(piece)
    return np.concatenate(hashes).view(np.int64), np.concatenate(places)


def stretches(batches: Iterator[pd.DataFrame], most_words: int, most_rows: int = 1 << 40) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows of a text until they have so many words: their other columns, the hashes of all words in order, and the number of words of each row."""
    rows, hashes, lengths, words, number = [], [], [], 0, 0

    def taken() -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """What was gathered; only who takes it keeps it."""
        nonlocal words, number
        out = pd.concat(rows, ignore_index=True), np.concatenate(hashes), np.concatenate(lengths)
        for x in (rows, hashes, lengths):
            x.clear()
        words, number = 0, 0
        return out

    for b in batches:
        texts, others, at = b["text"].to_numpy(), b.drop(columns="text"), 0
        while at < len(texts):
            block, size = [], 0
            for text in texts[at : at + most_rows - number]:
                block.append(text.encode().lower() if text else b"")
                size += len(block[-1]) + 1
                if size >= BLOCK:
                    break
            found, places = word_hashes(b"\n".join(block))
            rows.append(others.iloc[at : at + len(block)])
            hashes.append(found)
            lengths.append(np.diff(np.searchsorted(places, np.cumsum([len(x) + 1 for x in block])), prepend=0))
            words, number, at = words + len(found), number + len(block), at + len(block)
            if words >= most_words or number >= most_rows:
                yield taken()
    if number:
        yield taken()


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number in 32 bits, and the distinct words by number."""
    ids, words = pd.factorize(hashes)
    return ids.astype(np.int32), words


def followed(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all tokens the one before and the token, in the same memory; 0 is the end mark, word i is i + 1."""
    tokens, inside = np.zeros(1 + len(ids) + len(lengths), np.int32), np.ones(1 + len(ids) + len(lengths), bool)
    inside[0] = inside[np.cumsum(lengths + 1)] = False
    tokens[inside] = ids + 1
    return tokens[:-1], tokens[1:]


def paired(before: np.ndarray, after: np.ndarray | int) -> np.ndarray:
    """Two numbers of 32 bits as one of 64."""
    keys = before.astype(np.int64)
    keys <<= 32
    keys |= after
    return keys


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Places where another value begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def mixed(u: np.ndarray, w: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two codes."""
    x = u.astype(np.int64, copy=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += np.asarray(w, np.int64).view(np.uint64)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Book:
    """Codes of words: 0 is the end mark, then come the commonest words by falling count; any other word's code is its hash with the sign set."""

    hashes: np.ndarray  # of the commonest words with the sign set, rising
    rank: np.ndarray
    parts: np.ndarray  # by code, of the contexts that are dealt out over several buckets: over how many
    buckets: int
    number: int  # of contexts: all words, the end mark and one for unknown words

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        out = hashes | OUTSIDE
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, out), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == out, self.rank[at] + 1, out)
        return out

    def bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        sub = np.zeros(len(u), np.int64)
        at = np.flatnonzero((u >= 0) & (u < len(self.parts)))
        sub[at] = (mixed(w[at], 0) % self.parts[u[at]]).astype(np.int64)
        return (mixed(u, sub) % np.uint64(self.buckets)).astype(np.min_scalar_type(self.buckets))

    def parcels(self, u: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes, bytes]]:
        """bucket, rows, their u and w, packed, of every bucket that has any; rows of one u should come together."""
        for b, at in dealt(self.bucket(u, w), self.buckets):
            yield b, at, pack(np.diff(u[at], prepend=0)), pack(w[at])


def unparcel(u: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpack(u)), unpack(w)


COUNT_ROW = "home int, w binary, n binary"
PAIR_ROW = "bucket int, u binary, w binary, n binary"
SEAT_ROW = f"{PAIR_ROW}, t binary, kept binary"
OUTER_ROW = f"{SEAT_ROW}, as_u binary, as_w binary"
TABLE_ROW = "bucket int, u binary, w binary, value binary, n binary"


def fields(row: str) -> list[str]:
    return [c.split()[0] for c in row.split(", ")]


def home_of(codes: np.ndarray, homes: int) -> np.ndarray:
    return (mixed(codes, 0) % np.uint64(homes)).astype(np.int32)


def word_totals(learning: DataFrame, homes: int, most_words: int = 2_000_000) -> DataFrame:
    """Of every home of words their codes outside any book, rising, and counts, packed; with the numbers of words and tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, hashes, _ in stretches(batches, most_words):
            ids, words = numbered(hashes)
            del hashes
            n, words = np.bincount(ids, minlength=len(words)), words | OUTSIDE
            del ids
            yield pd.DataFrame([(home, pack(words[at]), pack(n[at])) for home, at in dealt(home_of(words, homes), homes)], columns=["home", "w", "n"])
            del n, words

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        w, at = np.unique(joined(rows["w"]), return_inverse=True)
        n = np.bincount(at, joined(rows["n"])).astype(np.int64)
        return pd.DataFrame({"home": rows["home"].iloc[:1], "w": [pack(w)], "n": [pack(n)], "words": [len(w)], "tokens": [n.sum()]})

    return learning.select("text").mapInPandas(run, COUNT_ROW).groupBy("home").applyInPandas(added, f"{COUNT_ROW}, words long, tokens long")


def word_pairs(learning: DataFrame, book: Book, most_words: int = 2_000_000) -> DataFrame:
    """How often one word follows another in all texts: a row a bucket, of packed u, w and n, with the number of pairs seen once and twice."""
    shared = learning.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, hashes, lengths in stretches(batches, most_words):
            ids, words = numbered(hashes)
            del hashes
            codes = np.concatenate([[0], shared.value.codes(words)])
            keys = paired(*followed(ids, lengths))
            del ids, words
            keys.sort()
            first = firsts(keys)
            n = np.diff(first, append=len(keys))
            keys = keys[first]
            del first
            u, w = codes[keys >> 32], codes[keys & 0xFFFFFFFF]
            del keys, codes
            yield pd.DataFrame([(b, pu, pw, pack(n[at])) for b, at, pu, pw in shared.value.parcels(u, w)], columns=["bucket", "u", "w", "n"])
            del u, w, n

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        u, w, n = (np.concatenate([*x]) for x in (map(np.cumsum, map(unpack, rows["u"])), map(unpack, rows["w"]), map(unpack, rows["n"])))
        key = mixed(u, w)
        order = np.argsort(key)
        key = key[order]
        first = firsts(key)
        del key
        n, at = np.add.reduceat(n[order], first), order[first]
        del order, first
        u, w = u[at], w[at]
        by = np.argsort(u)
        u, w, n = u[by], w[by], n[by]
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "u": [pack(np.diff(u, prepend=0))], "w": [pack(w)], "n": [pack(n)], "once": [(n == 1).sum()], "twice": [(n == 2).sum()]})

    return learning.select("text").mapInPandas(run, PAIR_ROW).groupBy("bucket").applyInPandas(merged, f"{PAIR_ROW}, once long, twice long")


def parent_tables(c: np.ndarray, others: float, even: float, d: float, strength: float) -> np.ndarray:
    """Expected tables of dishes of the parent restaurant after c customers, where all dishes have `others` tables."""
    t, j = np.minimum(c, 1.0).astype(float), 1.0
    live = np.flatnonzero(c > 1)
    while len(live):
        step = 1.0 if j < 64 else j // 20
        new = (strength + d * (others - 1 + t[live])) * even
        t[live] += np.minimum(step, c[live] - j) * new / (new + j - d * t[live])
        j += step
        live = live[c[live] > j]
    return t


@dataclass
class Parent:
    """What gives the parent's probability of a word from its customers there."""

    others: float
    at_root: float  # tables in all
    served: float  # customers in all
    even: float
    d: float
    strength: float

    def above(self, c: np.ndarray) -> np.ndarray:
        values, at = np.unique(c, return_inverse=True)
        root = parent_tables(values, self.others, self.even, self.d, self.strength)
        return ((values - self.d * root + (self.strength + self.d * self.at_root) * self.even) / (self.strength + self.served))[at]


@dataclass
class Sweep:
    """By code, `share` times: tables of the book's contexts, and customers of its words in the parent; packed, because every worker gets them in every sweep."""

    share: float
    tables: bytes
    sent: bytes
    parent: Parent

    def opened(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables of contexts and the parent's probabilities of words."""
        return unpack(self.tables) * self.share, self.parent.above(unpack(self.sent) * self.share)


@dataclass
class Words:
    """The model of word pairs; what concerns words outside the book and seen pairs is in the table beside it."""

    classes: Book
    tokens: int
    distinct: int  # with the end mark
    texts: int
    n: bytes  # by code: occurrences, packed
    log_word: np.ndarray  # by code: log10 of what a context passes on to its parent, plus that of the parent's probability
    log_unknown: float


def learn_words(learning: DataFrame, held: int, burn: int, keep: int, strength: float) -> tuple[Words, DataFrame]:
    """A model with a restaurant for every word, and its table of buckets (u, w, value, n).

    A bucket has all pairs of a context outside the book, so its tables are summed there. What buckets send to a word
    outside the book is summed in the word's home, which tells those that ask. Both get packed columns, not rows.
    """
    spark = learning.sparkSession
    texts, text_bytes = learning.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    homes = max(32, (text_bytes or 0) // HOME_BYTES)
    counted = cut(word_totals(learning, homes))
    tokens, distinct = (x or 0 for x in counted.agg(F.sum("tokens"), F.sum("words")).first())

    def times(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
        for b in batches:
            for packed in b[column]:
                yield pd.DataFrame(dict(zip(("n", "words"), np.unique(unpack(packed), return_counts=True), strict=True)))

    def histogram(df: DataFrame, column: str) -> dict[int, int]:
        """How many words have each number in a packed column."""
        rows = df.select(column).mapInPandas(lambda batches: times(batches, column), "n long, words long")
        return {r["n"]: r["words"] for r in rows.groupBy("n").agg(F.sum("words").alias("words")).collect()}

    least = 1
    if distinct > held:
        seen = 0
        for least, words in sorted(histogram(counted, "n").items(), reverse=True):
            seen += words
            if seen >= held:
                break

    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pw, pn in zip(b["w"], b["n"], strict=True):
                n = unpack(pn)
                yield pd.DataFrame({"key": unpack(pw)[n >= least], "n": n[n >= least]})

    top = counted.select("w", "n").mapInPandas(common, "key long, n long").orderBy(F.desc("n"), "key").limit(held).toArrow()
    keys, counts = top["key"].to_numpy(), np.concatenate([[texts], top["n"].to_numpy()])
    rank = np.argsort(keys, kind="stable")
    size, outside = len(counts), distinct > len(keys)
    parts = (1 + counts // BUCKET_TOKENS).astype(np.uint64)
    book = Book(keys[rank], rank.astype(np.int32), parts[: 1 + np.max(np.flatnonzero(parts > 1), initial=-1)], max(32, (tokens + texts) // BUCKET_TOKENS), distinct + 2)
    even, d_root = 1.0 / book.number, 0.5
    shared = spark.sparkContext.broadcast(book)
    pairs = cut(word_pairs(learning, book))
    once, twice = pairs.agg(F.sum("once"), F.sum("twice")).first()
    d = discount(once or 0, twice or 0)

    def opened(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
        """bucket, u, w and other packed columns of each row."""
        for b in batches:
            for row in b[["bucket", "u", "w", *columns]].itertuples(index=False):
                yield row[0], *unparcel(row[1], row[2]), *map(unpack, row[3:])

    def closed(bucket: int, u: np.ndarray, *values: np.ndarray) -> list:
        return [bucket, pack(np.diff(u, prepend=0)), *map(pack, values)]

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Seats of the pairs inside the book that need sweeps; every dish starts at one table."""
        for bucket, u, w, n in opened(batches, "n"):
            at = np.flatnonzero((u >= 0) & (w >= 0) & (n > 1))
            yield pd.DataFrame([closed(bucket, u[at], w[at], n[at], np.ones(len(at)), np.zeros(len(at)))], columns=fields(SEAT_ROW))

    def book_sums(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
        """What the seats in a column, or pairs seen once, give to the book's contexts and words, by part of their codes."""
        both = np.zeros((2, size))
        for _, u, w, x in opened(batches, column):
            x = x == 1 if column == "n" else x
            for of, code in enumerate((u, w)):
                both[of] += np.bincount(code[code >= 0], x[code >= 0], size)
        for of in (0, 1):
            at = np.flatnonzero(both[of])
            for part, here in dealt(at // PART, 1 + size // PART):
                yield pd.DataFrame([(2 * part + of, pack(at[here]), pack(both[of, at[here]]))], columns=["part", "code", "n"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        return pd.DataFrame([(part, pack(np.bincount(joined(rows["code"]) - part // 2 * PART, joined(rows["n"]))))], columns=["part", "n"])

    def summed(seats: DataFrame, column: str) -> np.ndarray:
        both = np.zeros((2, size), np.int64)
        rows = seats.select("bucket", "u", "w", column).mapInPandas(lambda batches: book_sums(batches, column), "part int, code binary, n binary")
        for part, packed in rows.groupBy("part").applyInPandas(added, "part int, n binary").collect():
            n = unpack(packed)
            both[part % 2, part // 2 * PART :][: len(n)] += n
        return both

    once_sums = summed(pairs, "n")
    inner = cut(pairs.select("bucket", "u", "w", "n").mapInPandas(several, SEAT_ROW))
    outer, flat = None, {}
    if outside:
        outer, known_words = outer_seats(pairs, counted, shared, homes)
        # How many words outside the book are sent so many customers by pairs seen once.
        flat = histogram(known_words, "as_w")
    done(counted)

    def sent(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
        """To the homes of words outside the book, what a bucket's seats give them."""
        for bucket, u, w, as_w, t in opened(batches, "as_w", column):
            words, first, at = np.unique(w[w < 0], return_index=True, return_inverse=True)
            t, as_w = np.bincount(at, t[w < 0], len(words)), as_w[w < 0][first]
            yield pd.DataFrame([(home, bucket, pack(words[i]), pack(t[i]), pack(as_w[i])) for home, i in dealt(home_of(words, homes), homes)], columns=["home", "bucket", "w", "t", "as_w"])

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        """Customers of words to each bucket that has them, and in a row of no bucket how many words have so many."""
        asked = [unpack(x) for x in rows["w"]]
        words, first, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        t, as_w = np.bincount(at, joined(rows["t"])).astype(np.int64), joined(rows["as_w"])[first]
        out = [(bucket, pack(w), pack(as_w[i]), pack(t[i]), None) for bucket, w, i in zip(rows["bucket"], asked, (np.searchsorted(words, w) for w in asked), strict=True)]
        both, n = np.unique(np.stack([as_w, t]), axis=1, return_counts=True)
        return pd.DataFrame([*out, (-1, None, pack(both[0]), pack(both[1]), pack(n))], columns=["bucket", "w", "as_w", "t", "words"])

    def state_of(column: str, others: float, share: float = 1.0) -> tuple[Sweep, DataFrame | None]:
        """The state that the seats in a column give, each counted by its share, and what the homes tell."""
        both, told = once_sums * round(1 / share) + summed(inner, column), None
        hist = {(c, 0): m for c, m in flat.items()}
        if outer is not None:
            both += summed(outer, column)
            rows = outer.select("bucket", "u", "w", "as_w", column).mapInPandas(lambda batches: sent(batches, column), "home int, bucket int, w binary, t binary, as_w binary")
            told = cut(rows.groupBy("home").applyInPandas(tell, "bucket int, w binary, as_w binary, t binary, words binary"))
            for r in told.where("bucket < 0").collect():
                for c, t, m in zip(*(unpack(r[x]).tolist() for x in ("as_w", "t", "words")), strict=True):
                    hist[c, 0] -= m
                    hist[c, t] = hist.get((c, t), 0) + m
        # Words in the parent by their customers there.
        c, m = np.unique(both[1], return_counts=True)
        c, m = np.concatenate([c * share, [x + t * share for x, t in hist]]), np.concatenate([m, list(hist.values())])
        at_root = (parent_tables(c, others, even, d_root, strength) * m).sum()
        return Sweep(share, pack(both[0]), pack(both[1]), Parent(others, at_root, (c * m).sum(), even, d_root, strength)), told

    def drawn(n: np.ndarray, t: np.ndarray, kept: np.ndarray, tables: np.ndarray, above: np.ndarray, turn: int, *stretch: int) -> tuple[np.ndarray, np.ndarray]:
        """New tables of dishes that have t now, and the sum of those that are kept."""
        t = seat(n, np.maximum(tables - t, 0), above, d, strength, seeded("sweep", turn, *stretch)).astype(np.int64)
        return t, kept + t * (turn >= burn)

    def sweep(s: Sweep, told: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame | None]:
        """Seats after everyone left and came back."""
        state = spark.sparkContext.broadcast(s)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables, parent = state.value.opened()
            for bucket, u, w, n, t, kept in opened(batches, "n", "t", "kept"):
                yield pd.DataFrame([closed(bucket, u, w, n, *drawn(n, t, kept, tables[u], parent[w], turn, bucket))], columns=fields(SEAT_ROW))

        def run_outer(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            in_book, parent = state.value.opened()
            have, c = joined(answers["w"]), joined(answers["as_w"]) + joined(answers["t"])
            order, out = np.argsort(have), []
            for bucket, u, w, n, t, kept, as_u, as_w in opened([rows], "n", "t", "kept", "as_u", "as_w"):
                tables, above, far = np.zeros(len(u)), np.zeros(len(u)), w < 0
                tables[u >= 0] = in_book[u[u >= 0]]
                _, at = np.unique(u[u < 0], return_inverse=True)
                tables[u < 0] = as_u[u < 0] + np.bincount(at, t[u < 0])[at]
                above[~far] = parent[w[~far]]
                above[far] = state.value.parent.above(c[order[np.searchsorted(have, w[far], sorter=order)]].astype(float))
                out.append(closed(bucket, u, w, n, *drawn(n, t, kept, tables, above, turn, bucket, -1), as_u, as_w))
            return pd.DataFrame(out, columns=fields(OUTER_ROW))

        out = cut(inner.mapInPandas(run, SEAT_ROW)), None
        if outer is not None:
            out = out[0], cut(outer.groupBy("bucket").cogroup(told.where("bucket >= 0").groupBy("bucket")).applyInPandas(run_outer, OUTER_ROW))
        state.destroy()
        return out

    state, told = state_of("t", float(distinct + (texts > 0)))
    for turn in range(burn + keep):
        before = [x for x in (inner, outer, told) if x is not None]
        inner, outer = sweep(state, told, turn)
        done(*before)
        if turn < burn + keep - 1:
            state, told = state_of("t", state.parent.at_root)

    # Means over the kept sweeps: what a context passes on, the parent's probabilities, and a pair's own share.
    mean, told = state_of("kept", state.parent.at_root, 1 / keep)
    unknown = math.log10(mean.parent.above(np.zeros(1))[0])
    tables, parent = mean.opened()
    log_word = np.log10((strength + d * tables) / (strength + counts)) + np.log10(parent)
    known = spark.sparkContext.broadcast(mean)

    def gain(n: np.ndarray, kept: np.ndarray, passed: np.ndarray, above: np.ndarray) -> np.ndarray:
        return np.log10(1 + (n - d * kept / keep) / (passed * above)).astype(np.float32)

    def valued(batches: Iterator[pd.DataFrame], once: bool) -> Iterator[pd.DataFrame]:
        """Pairs inside the book with their values; a dish of one customer has one table in every sweep."""
        tables, parent = known.value.opened()
        for bucket, u, w, n, *kept in opened(batches, "n", *([] if once else ["kept"])):
            if once:
                at = np.flatnonzero((u >= 0) & (w >= 0) & (n == 1))
                u, w, n, kept = u[at], w[at], n[at], [np.full(len(at), keep)]
            v = gain(n, kept[0], strength + d * tables[u], parent[w])
            yield pd.DataFrame([(bucket, pack(np.diff(u, prepend=0)), pack(w), v.tobytes(), pack(n))], columns=fields(TABLE_ROW))

    table = pairs.select("bucket", "u", "w", "n").mapInPandas(lambda batches: valued(batches, True), TABLE_ROW)
    table = table.unionByName(inner.select("bucket", "u", "w", "n", "kept").mapInPandas(lambda batches: valued(batches, False), TABLE_ROW))
    if outer is not None:

        def wanted(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
            """To the homes, the words outside the book that a bucket's pairs have, with the customers of the kept sweeps."""
            for bucket, u, w, x in opened(batches, column):
                mine = (w < 0) & (x == 1) if column == "n" else w < 0
                words, at = np.unique(w[mine], return_inverse=True)
                t = np.zeros(len(words)) if column == "n" else np.bincount(at, x[mine], len(words))
                yield pd.DataFrame([(home, bucket, pack(words[i]), pack(t[i])) for home, i in dealt(home_of(words, homes), homes)], columns=["home", "bucket", "w", "t"])

        def placed(words: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            """The parent's probabilities of a home's words, to the buckets that ask and, with counts, to the words' own."""
            have, n, c = joined(words["w"]), joined(words["n"]), joined(words["as_w"]).astype(float)
            asked = [np.searchsorted(have, unpack(x)) for x in asks["w"]]
            for at, t in zip(asked, map(unpack, asks["t"]), strict=True):
                c[at] += t / keep
            above = known.value.parent.above(c) if len(c) else c
            out = [(bucket, w, above[at].tobytes(), None) for bucket, w, at in zip(asks["bucket"], asks["w"], asked, strict=True)]
            out += [(bucket, pack(have[at]), above[at].tobytes(), pack(n[at])) for bucket, at in dealt(shared.value.bucket(have, have), shared.value.buckets)]
            return pd.DataFrame(out, columns=["bucket", "w", "above", "n"])

        def valued_outer(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            in_book, parent = known.value.opened()
            u, w, n, kept = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*(x[1:] for x in opened([rows], "n", "kept")), strict=True)) if len(rows) else [np.zeros(0, np.int64)] * 4
            have, far_above = joined(answers["w"]), np.frombuffer(b"".join(answers["above"]))
            own = answers[answers["n"].notna()]
            words, of_words, n_words = joined(own["w"]), np.frombuffer(b"".join(own["above"])), joined(own["n"])
            # All pairs of a context outside the book are here, and words are contexts of their own.
            far = u < 0
            contexts, at = np.unique(np.concatenate([words, u[far]]), return_inverse=True)
            passed_far = strength + d * np.bincount(at, np.concatenate([np.zeros(len(words)), kept[far] / keep]), len(contexts))
            passed, above = np.zeros(len(u)), np.zeros(len(u))
            passed[far], passed[~far] = passed_far[at[len(words) :]], strength + d * in_book[u[~far]]
            far, order = w < 0, np.argsort(have)
            above[far], above[~far] = far_above[order[np.searchsorted(have, w[far], sorter=order)]], parent[w[~far]]
            of_word = np.log10(passed_far[at[: len(words)]] / (strength + n_words)) + np.log10(of_words) - unknown
            value = np.concatenate([gain(n, kept, passed, above), of_word.astype(np.float32)])
            u, w, n = np.concatenate([u, words]), np.concatenate([w, np.full(len(words), ALONE)]), np.concatenate([n, n_words])
            bucket = int((rows if len(rows) else answers)["bucket"].iloc[0])
            return pd.DataFrame([(bucket, pack(np.diff(u, prepend=0)), pack(w), value.tobytes(), pack(n))], columns=fields(TABLE_ROW))

        def once_outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for bucket, u, w, n in opened(batches, "n"):
                at = np.flatnonzero(((u < 0) | (w < 0)) & (n == 1))
                yield pd.DataFrame([closed(bucket, u[at], w[at], n[at], np.full(len(at), keep))], columns=["bucket", "u", "w", "n", "kept"])

        ASK = "home int, bucket int, w binary, t binary"
        asks = pairs.select("bucket", "u", "w", "n").mapInPandas(lambda batches: wanted(batches, "n"), ASK).unionByName(outer.select("bucket", "u", "w", "kept").mapInPandas(lambda batches: wanted(batches, "kept"), ASK))
        answers = known_words.groupBy("home").cogroup(asks.groupBy("home")).applyInPandas(placed, "bucket int, w binary, above binary, n binary")
        seen = pairs.select("bucket", "u", "w", "n").mapInPandas(once_outside, "bucket int, u binary, w binary, n binary, kept binary").unionByName(outer.select("bucket", "u", "w", "n", "kept"))
        table = table.unionByName(seen.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(valued_outer, TABLE_ROW))
        done(told)
    return Words(book, tokens + texts, distinct + (texts > 0), texts, pack(counts), log_word.astype(np.float32), unknown), table


def outer_seats(pairs: DataFrame, counted: DataFrame, shared: Broadcast, homes: int) -> tuple[DataFrame, DataFrame]:
    """Seats of the pairs with a word outside the book that need sweeps, and by home the words outside, with the customers that pairs seen once send them."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """To the homes, a bucket's words outside the book, how many pairs seen once each has, and whether others have it."""
        for b in batches:
            for bucket, pu, pw, pn in zip(b["bucket"], b["u"], b["w"], b["n"], strict=True):
                w, n = unpack(pw), unpack(pn)
                words, at = np.unique(w[w < 0], return_inverse=True)
                once, several = (np.bincount(at, x[w < 0], len(words)) for x in (n == 1, n > 1))
                yield pd.DataFrame(
                    [(home, bucket, pack(words[i]), pack(once[i]), pack(several[i] > 0)) for home, i in dealt(home_of(words, homes), homes)], columns=["home", "bucket", "w", "once", "several"]
                )

    def homed(words: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        """A home's row of words, and to the buckets the customers of words that sweeps need."""
        have, n = joined(words["w"]), joined(words["n"])
        mine = shared.value.codes(have) < 0
        have, n = have[mine], n[mine]
        places = [np.searchsorted(have, unpack(w)) for w in sent["w"]]
        as_w = np.zeros(len(have), np.int64)
        for at, once in zip(places, sent["once"], strict=True):
            as_w[at] += unpack(once)
        out = [(int(words["home"].iloc[0]), None, pack(have), pack(n), pack(as_w))] if len(words) else []
        for bucket, at, several in zip(sent["bucket"], places, sent["several"], strict=True):
            at = at[unpack(several) > 0]
            if len(at):
                out.append((None, bucket, pack(have[at]), None, pack(as_w[at])))
        return pd.DataFrame(out, columns=["home", "bucket", "w", "n", "as_w"]).astype({"home": "Int32", "bucket": "Int32"})

    def seated(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        have, as_have = joined(answers["w"]), joined(answers["as_w"])
        order, out = np.argsort(have), []
        for bucket, pu, pw, pn in zip(rows["bucket"], rows["u"], rows["w"], rows["n"], strict=True):
            (u, w), n = unparcel(pu, pw), unpack(pn)
            at = np.flatnonzero((u < 0) | (w < 0))
            u, w, n = u[at], w[at], n[at]
            _, context = np.unique(u, return_inverse=True)
            as_u, as_w = np.bincount(context, n == 1)[context], np.zeros(len(u), np.int64)
            u, w, n, as_u, as_w = (x[n > 1] for x in (u, w, n, as_u, as_w))
            as_w[w < 0] = as_have[order[np.searchsorted(have, w[w < 0], sorter=order)]]
            out.append((bucket, pack(np.diff(u, prepend=0)), pack(w), pack(n), pack(np.ones(len(u))), pack(np.zeros(len(u))), pack(as_u), pack(as_w)))
        return pd.DataFrame(out, columns=fields(OUTER_ROW))

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bucket, pu, pw, pn in zip(b["bucket"], b["u"], b["w"], b["n"], strict=True):
                (u, w), n = unparcel(pu, pw), unpack(pn)
                at = np.flatnonzero((u < 0) | (w < 0))
                yield pd.DataFrame([(bucket, pack(np.diff(u[at], prepend=0)), pack(w[at]), pack(n[at]))], columns=fields(PAIR_ROW))

    rows = pairs.select("bucket", "u", "w", "n")
    asked = rows.mapInPandas(split, "home int, bucket int, w binary, once binary, several binary")
    told = cut(counted.select("home", "w", "n").groupBy("home").cogroup(asked.groupBy("home")).applyInPandas(homed, "home int, bucket int, w binary, n binary, as_w binary"))
    outer = cut(rows.mapInPandas(outside, PAIR_ROW).groupBy("bucket").cogroup(told.where("bucket is not null").groupBy("bucket")).applyInPandas(seated, OUTER_ROW))
    return outer, told.where("home is not null").select("home", "w", "n", "as_w")


TEXT = np.dtype([("doc_id", "<i8"), ("null", "?"), ("held_out", "?"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
REQUEST = "batch long, bucket int, u binary, w binary, times binary, docs binary, texts binary"
ANSWER = "batch long, texts binary, docs binary, value binary, word_docs binary, known binary, base binary"


def request(m: Words, log_n: np.ndarray, rows: pd.DataFrame, ids: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the book gives of each text, and what the buckets are asked: u and w of each distinct pair and word outside the book, the texts that have them, and how many of these each has."""
    codes = np.concatenate([[0], m.classes.codes(words)])
    mine, at = codes >= 0, np.maximum(codes, 0)
    of_base, of_score = np.where(mine, log_n[at], 0.0), np.where(mine, m.log_word[at].astype(float), m.log_unknown)
    before, token = followed(ids, lengths)
    place = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    texts = np.zeros(len(rows), TEXT)
    texts["null"] = rows["doc_id"].isna()
    texts["doc_id"], texts["held_out"], texts["tokens"] = rows["doc_id"].fillna(0).astype(np.int64), rows["held_out"].astype(bool), lengths + 1
    for column, of in (("known", of_base > 0), ("base", of_base), ("score", of_score)):
        texts[column] = np.bincount(place, of[token], len(rows))
    other = np.flatnonzero(~mine[token])
    keys = np.concatenate([paired(before, token), paired(token[other], 0xFFFFFFFF)])
    place = np.concatenate([place, place[other]])
    del before, token, other
    order = np.argsort(keys)
    keys, place = keys[order], place[order]
    del order
    first = firsts(keys)
    times, keys = np.diff(first, append=len(keys)), keys[first]
    del first
    u, w = codes[keys >> 32], keys & 0xFFFFFFFF
    alone = w == 0xFFFFFFFF
    w[alone] = 0
    w = codes[w]
    w[alone] = ALONE
    return texts, u, w, place, times


def score_words(docs: DataFrame, model: Words, table: DataFrame, held_out: Column, batch_docs: int = 5000, batch_words: int = 250_000) -> DataFrame:
    """As `score`. Each task sums what the book gives of a text; pairs and other words are asked for by bucket, with the texts that have them, and a bucket answers sums by text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, name = shared.value, TaskContext.get().partitionId() << 24
        log_n = np.log10(unpack(m.n) + 1.0)
        for rows, hashes, lengths in stretches(batches, 4 * batch_words, batch_docs):
            ids, words = numbered(hashes)
            del hashes
            texts, u, w, place, times = request(m, log_n, rows, ids, words, lengths)
            del rows, ids, words, lengths
            first = np.cumsum(times) - times
            out = []
            for b, at, pu, pw in m.classes.parcels(u, w):
                several = times[at]
                inside = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
                out.append((name, b, pu, pw, pack(several), pack(place[np.repeat(first[at], several) + inside], "<i4"), None))
            del u, w, place, times, first
            out.append((name, name % m.classes.buckets, None, None, None, None, texts.tobytes()))
            yield pd.DataFrame(out, columns=fields(REQUEST))
            name += 1

    def answer(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        have, value, n = np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.int64)
        if len(known):
            have = np.concatenate([mixed(*unparcel(u, w)) for u, w in zip(known["u"], known["w"], strict=True)])
            value = np.concatenate([np.frombuffer(x, np.float32) for x in known["value"]])
            n = np.concatenate([unpack(x) for x in known["n"]])
            order = np.argsort(have)
            have, value, n = have[order], value[order], n[order]
        out = []
        for batch, pu, pw, times, docs, texts in zip(asks["batch"], asks["u"], asks["w"], asks["times"], asks["docs"], asks["texts"], strict=True):
            if texts is not None:
                out.append((batch, texts, None, None, None, None, None))
            elif len(have):
                u, w = unparcel(pu, pw)
                key = mixed(u, w)
                at = np.minimum(np.searchsorted(have, key), len(have) - 1)
                hit = have[at] == key
                times, docs = unpack(times), unpack(docs, "<i4")
                sums = np.bincount(docs, np.repeat(np.where(hit, value[at], 0), times))
                of = np.flatnonzero(sums)
                word = np.repeat(hit & (w == ALONE), times)
                c = np.repeat(n[at], times)[word]
                seen = np.bincount(docs[word])
                of_word = np.flatnonzero(seen)
                base = np.bincount(docs[word], np.log10(c + 1.0))
                out.append((batch, None, pack(of, "<i4"), sums[of].astype(np.float32).tobytes(), pack(of_word, "<i4"), pack(seen[of_word]), base[of_word].tobytes()))
        return pd.DataFrame(out, columns=fields(ANSWER))

    smooth, end = math.log10(model.tokens + model.distinct + 1), int(model.texts > 0)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        texts = np.frombuffer(rows["texts"].dropna().iloc[0], TEXT).copy()
        for docs, value, word_docs, known, base in rows.loc[rows["texts"].isna(), ["docs", "value", "word_docs", "known", "base"]].itertuples(index=False):
            texts["score"][unpack(docs, "<i4")] += np.frombuffer(value, np.float32)
            at = unpack(word_docs, "<i4")
            texts["known"][at] += unpack(known)
            texts["base"][at] += np.frombuffer(base)
        ids = pd.Series(texts["doc_id"], dtype="Int64").mask(texts["null"])
        return pd.DataFrame(
            {"doc_id": ids, "held_out": texts["held_out"], "n_tokens": texts["tokens"], "n_known": texts["known"], "base_score": texts["base"] - texts["tokens"] * smooth, "score": texts["score"]}
        )

    asked = docs.select("doc_id", held_out.alias("held_out"), "text").mapInPandas(ask, REQUEST)
    answers = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInPandas(answer, ANSWER)
    scored = answers.groupBy("batch").applyInPandas(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 7) == 2, F.lit(False))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *learn(docs.where(~held_out())), held_out())
