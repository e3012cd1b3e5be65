"""op13 against a brute force of its own, the size of the filters, chains of forms and odd rows."""

import re
import zlib
from collections import Counter

import duckdb
import pytest

from siftgrid.llm import entry_queries, spelling

SF = "/root/testdata/sf0.001"


def plain_words(rows, length=5, count=3):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= count}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words = plain_words(rows)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    form, out = {}, {}
    for w, n in words.items():
        near = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if is_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = (n, len(near))
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), *out[w], words[form[w]] if form[w] else None) for w in words}


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = [tuple(r) for r in entry_queries.queries()["op13_spelling"](spark, SF).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows)


CHAIN = ["wordy", "wordys", "wordyst", "wordystx", "wordystxz"]
ROWS = [(i, " ".join(w for k, w in enumerate(CHAIN) for _ in range(3 * 2**k))) for i in range(2)]
ROWS += [(5, "Ürbän ürbän ürbän urban urban urban URBAN urban urbans Urbans; urbans' aaaaa aaaa aaaaaa aaaaaa aaaaaa aaaaa aaaaa"), (6, None), (7, ""), (8, " \t\n 123 ①"), (None, "nobody nobody nobody nobodx nobodx nobodx"), (None, None)]
ROWS += [(9, "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 4999)] * 3 + [(10, "long lines of prose " * 20_000)]


@pytest.mark.parametrize("filter_bytes", [1, 16 << 20])
def test_edges(spark, filter_bytes):
    """Nulls, empty and long texts, repeated rows, clashing columns; a filter so small that it lets most edits pass changes nothing."""
    rows = ROWS if filter_bytes > 1 else [r for r in ROWS if r[0] != 9]
    docs = spark.createDataFrame([(*r, 1, "e", "w", 0) for r in rows], "doc_id long, text string, n int, edit string, word string, shard int").repartition(3)
    found = [tuple(r) for r in spelling.group(docs, filter_bytes).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows)
    roots = {r[0]: r[2] for r in found}
    assert all(roots.get(w) == CHAIN[-1] for w in CHAIN if w in roots)


def test_empty(spark):
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.group(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect() == []


def test_filters_hold_all_words_and_few_others():
    pairs = sorted({(k, e) for k, e in spelling.edits(["abcd", "aabb"], everything(), "abc")})
    want = {(k, e) for k, w in enumerate(["abcd", "aabb"]) for e in [w[:i] + w[i + 1 :] for i in range(4)] + [w[:i] + c + w[i + 1 :] for i in range(4) for c in "abc" if c > w[i]]}
    assert set(pairs) == want


def everything():
    full = spelling.Filters({n: 1 for n in range(1, 10)})
    for bits in full.bits.values():
        bits[:] = ~bits
    return full
