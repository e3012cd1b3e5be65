"""Cost-balanced packing of tokenised documents into sequences.

A document costs `linear * n + quadratic * n * n` (attention inside the
document). In a window of documents, full stretches of `capacity` ids become
sequences of their own; what remains is taken in descending cost and goes to
the sequence of the lowest cost so far that has room for it. If none has room it
is cut, again into the sequences of lowest cost. A window opens as many
sequences as its ids fill: all of `capacity` ids, then one for each binary digit
of the rest, so each sequence is full or a power of two long and nothing is
padded.

The work is on the map side: a window is a stretch of at most `window_docs`
documents of one input partition (and about `window_ids` ids), so there is no
shuffle and memory is bounded by the window and the longest document. A worker
keeps the vocabulary from task to task and nothing that grows with the texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
#: The letters of the texts that are cut here: Latin, without the letters that are also numbers or marks.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ȷ"
#: The public pre-token pattern of this byte-level vocabulary, for texts of PLAIN characters.
PRE_TOKEN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
#: No other character here is a number or white space.
PLAIN = re.compile(f"[\t\n\r\x20-\x7e{LETTERS}¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€]*+")
#: No pre-token goes on over such a place: white space never follows another character inside one.
BREAK = re.compile("(?<=[!-~])(?=[ \n])")
#: Longer runs of white space than the regex engine behind the fast path can step back over.
LONG_RUN = re.compile(r"\s{100000}")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Ids by the bytes of their tokens, if merging by id gives the library's ids; None for other vocabularies.

    It does for a byte-level vocabulary without other steps whose merges come in
    the order of their ids and where every token, merged from its single bytes by
    lowest id, ends with the merge that is listed for it: then no text ever
    merges two tokens that the library wouldn't merge at that point.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, cutter = whole["model"], whole["pre_tokenizer"] or {}
    simple = not whole["normalizer"] and not whole["truncation"] and not whole["padding"] and all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    exact = all(not t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex") or not simple or not exact:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in whole["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [tuple(bytes(byte[c] for c in part) for part in pair) for pair in pairs]
    order = [ranks[a + b] for a, b in merges]
    if order != sorted(set(order)) or len(order) + 256 != len(ranks) or any(merged(a + b, ranks) != [a, b] for a, b in merges):
        return None
    return ranks


def merged(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The token's parts before its last merge."""
    parts, top = [bytes([b]) for b in token], ranks[token]
    while len(parts) > 1:
        at = [ranks.get(a + b, top) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(at)
        if least >= top:
            break
        i = at.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Encoder:
    """Ids of whole texts, as the library gives them; a special string inside a text becomes its special id, its default."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self._library, self.fast = path, None, None
        if ranks is not None:
            import tiktoken

            with open(path, encoding="utf-8") as f:
                self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def library(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4")

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.fast is None:
            return self.library(text)
        if self.cut is None or not any(s in text for s in self.special):
            return self._stretch(text)
        parts = (np.array([self.special[p]], "<u4") if p in self.special else self._stretch(p) for p in self.cut.split(text) if p)
        return np.concatenate([*parts])

    def _simple(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and (len(text) < 100_000 or LONG_RUN.search(text) is None)

    def _stretch(self, text: str) -> np.ndarray:
        if self._simple(text):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False)
        groups: list[tuple[bool, list[str]]] = []
        for piece in BREAK.split(text):
            simple = self._simple(piece)
            if not groups or groups[-1][0] != simple:
                groups.append((simple, []))
            groups[-1][1].append(piece)
        return np.concatenate([self.fast.encode_to_numpy("".join(g)).astype("<u4", copy=False) if simple else self.library("".join(g)) for simple, g in groups])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str, ranks: dict[bytes, int] | None) -> Encoder:
    """The worker's encoder; it holds the vocabulary alone."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, ranks)
    return _encoders[path]


def assign(sizes: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """For each document the pieces (start, length, sequence, offset); sequences count from 0."""
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    sequences = 0
    rest: list[tuple[int, int]] = []
    for i, n in enumerate(sizes):
        whole, left = divmod(n, capacity)
        for k in range(whole):
            pieces[i].append((k * capacity, capacity, sequences, 0))
            sequences += 1
        if left:
            rest.append((left, i))
    full, tail = divmod(sum(n for n, _ in rest), capacity)
    room = np.array([capacity] * full + [1 << b for b in range(capacity.bit_length(), -1, -1) if tail >> b & 1], dtype=np.int64)
    used = np.zeros_like(room)
    cost = np.zeros(len(room))
    for left, i in sorted(rest, key=lambda x: (-x[0], x[1])):
        start = sizes[i] - left
        while left:
            free = room - used
            fits = free >= left
            at = int(np.argmin(np.where(fits if fits.any() else free > 0, cost, np.inf)))
            n = int(min(left, free[at]))
            pieces[i].append((start, n, sequences + at, int(used[at])))
            used[at] += n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    window_docs: int = 4096,
    window_ids: int = 2_000_000,
    out_ids: int = 250_000,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    A null text counts as empty and gives the end id alone. Repeated rows are
    packed each. Columns other than doc_id and text are ignored; an empty table
    gives no pieces. sequence_id holds the partition in its upper bits. Any
    tokenizer of the library will do; `ranks_of` says which ones are merged faster.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path, ranks.value), np.array([end_id], "<u4")
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, np.ndarray]] = []
        ids = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, ids
            rows, size, top = [], 0, -1
            for (doc, found), pieces in zip(held, assign([len(x) for _, x in held], capacity, linear, quadratic), strict=True):
                for start, n, at, offset in pieces:
                    rows.append((doc, start, n, found[start : start + n].tobytes(), len(found), sequence + at, offset))
                    size, top = size + n, max(top, at)
                    if size >= out_ids:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)
            sequence += top + 1
            held.clear()
            ids = 0

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                held.append((doc.as_py(), np.concatenate([encoder.of(text.as_py()), end])))
                ids += len(held[-1][1])
                if len(held) >= window_docs or ids >= window_ids:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack(table(spark, sf_dir, "documents")))
