"""op12 against a brute force of its own: sets, links, components, at group bounds and with odd rows."""

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from siftgrid.llm import entry_queries, ngram_join

SF = "/root/testdata/sf0.01"


def grams(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else []))


def plain(rows, percent=90):
    """(doc_id, n, component, links) of each row; ids are numbers or None."""
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            continue
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            root[top(i)] = top(j)
            links[i] += 1
            links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows))


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = plain(rows)
    assert sum(n for (d, _, c, _), n in want.items() if d != c) > 20
    assert Counter(tuple(r) for r in entry_queries.queries()["op12_ngram_join"](spark, SF).collect()) == want


def edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        at = draw.randrange(len(words))
        if draw.random() < 0.3:
            del words[at]
        else:
            words[at] = f"new{draw.randrange(40)}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [90, 80])
def test_clusters(spark, percent):
    """Several groups of near copies of one text, short sets at the bound, a passage that all share, exact copies."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(900)}" for _ in range(140)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [edited(draw, base, draw.randrange(7)) for _ in range(220)]
    texts += [passage + " " + " ".join(f"v{draw.randrange(5000)}" for _ in range(draw.randrange(200))) for _ in range(150)]
    texts += [" ".join(f"s{k + d}" for k in range(length)) for length in range(1, 24) for d in (0, 1)]
    texts += texts[:30] * 2 + ["x " * 50, "x " * 51, "", None, "A b", "a B", "a"]
    rows = [(i, t) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    want = plain(rows, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ngram_join.join(docs, percent=percent).collect()
    assert Counter(tuple(r) for r in found) == want


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, ids under which texts differ, clashing columns, an empty table."""
    long = " ".join(f"l{i * i % 7919}" for i in range(60_000))
    rows = [(1, None), (1, None), (None, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, long), (5, long + " more"), (None, long), (6, "one two"), (6, "one two"), (None, "no id here at all"), (None, "no id here at all"), (7, "one two three"), (7, "é①  漢字🙂\x00 x"), (2**62, "é①  漢字🙂\x00 X")]
    schema = "doc_id long, text string, n int, key string, rid int, lead string, first int, gid int"
    docs = spark.createDataFrame([(*r, 1, "k", 2, "l", 3, 4) for r in rows], schema).repartition(3)
    assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == plain(rows)
    assert ngram_join.join(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in ngram_join.join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1, 0)]


def test_leading_tokens_meet():
    """Any two similar sets share LEAD of their leading tokens, or all that they must share, whatever the order."""
    draw = np.random.default_rng(3)
    universe = draw.integers(0, 2**63, 400).astype(np.uint64)
    for trial in range(1500):
        percent = (90, 80, 50)[trial % 3]
        size = int(draw.integers(1, 200))
        a = draw.choice(universe, size, replace=False)
        b = np.union1d(a[draw.random(size) > draw.random() * 0.15], draw.choice(universe, int(draw.integers(0, 1 + size // 8)), replace=False))
        a = np.sort(a)
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        known = np.sort(draw.choice(universe, 60, replace=False))
        common = np.stack([known, draw.permutation(60).astype(np.uint64) + np.uint64(1)])
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        query, _ = ngram_join.leading(large, common, percent)
        lead, held = ngram_join.leading(small, common, percent)
        assert len(np.intersect1d(query, lead[:held])) >= min(ngram_join.LEAD, ngram_join.least_shared(len(large), percent))


def test_hashes_follow_words(monkeypatch):
    """Equal words have equal hashes wherever they stand and however a long text is cut, and different ones different hashes."""
    draw = random.Random(9)
    words = ["".join(draw.choice("abé漢") for _ in range(draw.randrange(1, 12))) for _ in range(400)] + ["y" * 3000, "y" * 2999, "z" * 70]
    text = "".join(w + draw.choice([" ", "\n", "\t\t", "\x0b", " \r\n"]) for w in (draw.choice(words) for _ in range(3000)))
    plain = text.encode().split()
    for piece in (1 << 20, 64, 1000):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        found = ngram_join.word_hashes(text.encode()).tolist()
        assert len(found) == len(plain)
        assert len(set(found)) == len(set(plain)) == len(set(zip(found, plain, strict=True)))
    assert ngram_join.word_hashes(b"").tolist() == ngram_join.word_hashes(b" \n").tolist() == []


def test_texts_and_sets_make_no_files(spark, monkeypatch):
    """A table of texts in the shared folder has a file a task, and a local folder starts two processes for each beside the executor's memory."""
    files = []
    cut = ngram_join.cut

    def counted(df):
        out = cut(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "cut", counted)
    draw = random.Random(5)
    base = [draw.choice("abcdefgh") * draw.randrange(1, 9) for _ in range(60)]
    rows = [(i, " ".join(edited(draw, base, 1) if i % 3 else base) if i % 2 else f"text {i} " * (i % 5)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == plain(rows)
    assert sum(files) < 40


def test_commonest_tokens_are_no_more_than_asked_for(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c d" + " e f g" * (i % 3) + f" {i} {i} {i}") for i in range(30)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(ngram_join, "ORDERED", 4)
    found = ngram_join.counted(docs, 3)
    assert 0 < found.shape[1] <= 4 and sorted(found[1]) == list(range(1, found.shape[1] + 1))
    monkeypatch.setattr(ngram_join, "ORDERED", 0)
    assert ngram_join.counted(docs, 3).size == 0
