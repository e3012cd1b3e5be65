"""op10 against a plain sampler that moves one customer at a time."""

import random
import tracemalloc
from collections import Counter, defaultdict
from math import log10
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from siftgrid.llm import lm_hpy

SUFFIXES, FREQUENT = 3, 4


def corpus():
    draw = random.Random(4)
    words = [f"w{i}{e}" for i in range(12) for e in ("ab", "cd", "ef")]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = []
    for _ in range(40):
        text, last = [], 0
        for _ in range(draw.randint(3, 25)):
            last = draw.choices(range(len(words)), weights)[0] if draw.random() < 0.5 else (last * 7 + 1) % len(words)
            text.append(words[last])
        texts.append(" ".join(text))
    return texts


class Restaurant:
    """Customers of each dish at its tables, seated one at a time."""

    def __init__(self, d, strength, above, up=None):
        self.d, self.strength, self.above, self.up = d, strength, above, up
        self.tables = defaultdict(list)

    def p(self, dish):
        t = self.tables.get(dish, [])
        n, k = sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))
        return (sum(t) - self.d * len(t) + (self.strength + self.d * k) * self.above(dish)) / (self.strength + n)

    def sit(self, dish, draw):
        t, k = self.tables[dish], sum(map(len, self.tables.values()))
        at = draw.choices(range(len(t) + 1), [c - self.d for c in t] + [(self.strength + self.d * k) * self.above(dish)])[0]
        if at < len(t):
            t[at] += 1
        else:
            t.append(1)
            if self.up:
                self.up.sit(dish, draw)

    def leave(self, dish, draw):
        t = self.tables[dish]
        at = draw.choices(range(len(t)), t)[0]
        t[at] -= 1
        if not t[at]:
            del t[at]
            if self.up:
                self.up.leave(dish, draw)


def plain_scores(texts, classes, sweeps=60, burn=20):
    def kind(word):
        h = np.array([xxhash.xxh64_intdigest(word.encode())], np.uint64).view(np.int64)
        return int(classes.of(h, np.array([crc32(word.encode()[-2:]) % SUFFIXES]))[0])

    k, shared = classes.number, classes.shared
    sequences = [[0, *map(kind, t.split()), 0] for t in texts]
    pairs = [(a, b) for q in sequences for a, b in zip(q, q[1:])]
    words = [(kind(w), w) for t in texts for w in t.split() if kind(w) >= shared]

    def discount(counts):
        n = Counter(counts)
        return lm_hpy.discount(n[1], n[2])

    d_class, d_word = discount(Counter(pairs).values()), discount(Counter(words).values())
    distinct = Counter(c for c, _ in set(words))
    root = Restaurant(0.5, 1.0, lambda _: 1 / k)
    contexts = [Restaurant(d_class, 1.0, root.p, root) for _ in range(k)]
    own = {c: Restaurant(d_word, 1.0, lambda _, c=c: 1 / (distinct[c] + 1)) for c in range(shared, k)}
    draw = random.Random(9)
    for a, b in pairs:
        contexts[a].sit(b, draw)
    for c, w in words:
        own[c].sit(w, draw)
    p_class, p_word = np.zeros((k, k)), Counter()
    for turn in range(sweeps):
        for a, b in pairs:
            contexts[a].leave(b, draw)
            contexts[a].sit(b, draw)
        for c, w in words:
            own[c].leave(w, draw)
            own[c].sit(w, draw)
        if turn >= burn:
            p_class += [[contexts[a].p(b) / (sweeps - burn) for b in range(k)] for a in range(k)]
            for c, w in set(words):
                p_word[c, w] += own[c].p(w) / (sweeps - burn)
    scores = []
    for q, t in zip(sequences, texts):
        scores.append(sum(log10(p_class[a, b]) for a, b in zip(q, q[1:])) + sum(log10(p_word[kind(w), w]) for w in t.split() if kind(w) >= shared))
    return np.array(scores)


def test_scores_equal_a_plain_sampler(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, words = lm_hpy.learn(docs, frequent=FREQUENT, suffixes=SUFFIXES, burn=4, keep=12)
    found = {r["doc_id"]: r["score"] for r in lm_hpy.score(docs, model, words, F.lit(False)).collect()}
    want = plain_scores(texts, model.classes)
    got = np.array([found[i] for i in range(len(texts))])
    assert np.abs(got / want - 1).max() < 0.03 and abs(got.sum() / want.sum() - 1) < 0.01


def test_contexts_grow_with_the_corpus(spark):
    small = spark.createDataFrame([(0, " ".join(f"x{i}" for i in range(100)))], "doc_id long, text string")
    large = spark.createDataFrame([(0, " ".join(f"x{i}" for i in range(40_000)))], "doc_id long, text string")
    sizes = [lm_hpy.learn(d, burn=0, keep=1)[0].classes.number for d in (small, large)]
    assert sizes[1] > sizes[0]


@pytest.mark.parametrize("held", [5, 1000])
def test_every_word_is_a_context(spark, held):
    """With few words held in memory, the others go through joins; both give the scores of a plain sampler over all pairs of words."""
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = np.sort(np.array([xxhash.xxh64_intdigest(w.encode()) for w in {w for t in texts for w in t.split()}], np.uint64).view(np.int64))
    model, table = lm_hpy.learn(docs, held=held, burn=4, keep=12)
    found = {r["doc_id"]: r for r in lm_hpy.score(docs, model, table, F.lit(False), batch_docs=7).collect()}
    want = plain_scores(texts, lm_hpy.Classes(hashes, 1))
    got = np.array([found[i]["score"] for i in range(len(texts))])
    assert np.abs(got / want - 1).max() < 0.08 and abs(got.sum() / want.sum() - 1) < 0.02
    assert all(found[i]["n_known"] == found[i]["n_tokens"] == len(t.split()) + 1 for i, t in enumerate(texts))


def test_rare_words_differ_as_contexts(spark):
    """3,000 words that end alike follow one another in a ring, far more than ever had a context of their own: each knows its follower."""
    n = 3000
    follow = [f"w{i}s w{(i + 1) % n}s" for i in range(n)]
    learning = spark.createDataFrame([(i, t) for i, t in enumerate(follow * 2)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "w2900s w2901s"), (1, "w2900s w2950s"), (2, "w2901s w2900s")], "doc_id long, text string")
    for held in (100, 5000):
        found = {r["doc_id"]: r["score"] for r in lm_hpy.score(asked, *lm_hpy.learn(learning, held=held), F.lit(False)).collect()}
        assert found[0] > found[1] + 1 and found[0] > found[2] + 1


def test_words_outside_the_book_meet_no_join(spark):
    """Pairs of words that aren't held in memory are met by bucket and home; joins of single pairs took most of the time."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    model, table = lm_hpy.learn(docs, held=5, burn=1, keep=1)
    for df in (table, lm_hpy.score(docs, model, table, F.lit(False))):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    rows = table.collect()
    pairs = {(u, w) for r in rows for u, w in zip(*map(np.ndarray.tolist, lm_hpy.unparcel(r["u"], r["w"])))}
    sequences = [[None, *t.split(), None] for t in corpus()]
    words = {w for q in sequences for w in q if w}
    assert len(pairs) == len({p for q in sequences for p in zip(q, q[1:])}) + len(words) - 5


def test_hashes_are_of_the_words_in_order():
    long = "x" * 300
    texts = ["one Two  two", None, "", " \t\n", f"{long} a\x1cb é é", "y" * (2 << 20), f"two {'z ' * (1 << 20)}{long}"]
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    for most_words, most_rows in ((1, 1), (1 << 30, 2), (1 << 30, 1 << 30)):
        parts = list(lm_hpy.stretches(iter([frame[:3], frame[3:]]), most_words, most_rows))
        hashes, lengths = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        words = [lm_hpy.lower_words(t) for t in texts]
        assert [i for p in parts for i in p[0]["doc_id"]] == list(range(len(texts))) and lengths.tolist() == list(map(len, words))
        ids = {w: h for q in [[w for t in words for w in t]] for w, h in zip(q, hashes.tolist(), strict=True)}
        assert [ids[w] for t in words for w in t] == hashes.tolist() and len(set(ids.values())) == len(ids)


def test_a_task_takes_little_memory_a_word(spark, monkeypatch):
    """What one stretch of words needed was kept while the next was read, and a batch's texts were held twice; workers took over 430 MB."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    model, table = lm_hpy.learn(docs, burn=1, keep=1)
    tasks, plain = [], type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, *schema: (tasks.append(f), plain(self, f, *schema))[1])
    monkeypatch.setattr(lm_hpy, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = 400_000
    lm_hpy.word_totals(docs, 8, words)
    lm_hpy.word_pairs(docs, model.classes, words)
    lm_hpy.score(docs, model, table, F.lit(False), batch_words=words // 4)
    drawn = np.random.default_rng(5).zipf(1.3, (300, 4000)) % 50_000
    frame = pd.DataFrame({"doc_id": range(300), "text": [" ".join(map("w{}".format, row)) for row in drawn.tolist()], "held_out": False})
    for task, most in zip(tasks, (85, 95, 140), strict=True):
        tracemalloc.start()
        try:
            assert sum(1 for _ in task(iter([frame]))) == 3
            assert tracemalloc.get_traced_memory()[1] < most * words, task.__qualname__
        finally:
            tracemalloc.stop()
