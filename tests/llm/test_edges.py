"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftgrid.llm import ann_ivfpq, chat_format, common, html_wrapper, langid_ftrl, lm_hpy, mixing, packing, quality_iforest, simhash_dedup, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, bin int, target string, stats string, n long, key string, p string, n_words int, kept string, row string, row_a_ int, copies int, first string"
WORDS = "the cat and dog ran over old red hills then slept near two rivers until dawn came again with cold rain falling down on stones".split()


def rows():
    prose = [" ".join(WORDS[(i * 7 + k * (i % 5 + 1)) % len(WORDS)] + ("" if k % 9 else ".") for k in range(60 + i)) for i in range(30)]
    out = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    out += [(100, None, None, None, None), (101, "", "en", None, 0), (102, " \t\n\x0b\x0c\r ", None, "s1", 7), (103, "é①  漢字🙂\x00 <|endoftext|> <s>", "de", "s2", 9)]
    out += [(104, "word " * 30_000, "en", "s0", 150_000), (105, prose[3], "en", "s9", None), (105, prose[3], "en", "s9", None), (None, "a null id", None, "s1", 1), (None, None, None, None, None)]
    return [(*r, "x", 1, "y", "z", 2, "k", "p", 3, "kept", "r", 4, 5, "f") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same_rows(found):
    return len(found) == len(rows()) and sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows())


def test_mixing(spark, docs, none):
    found = mixing.mix(docs).collect()
    assert same_rows(found)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    size, taken, target = {}, {}, {}
    for r in found:
        s = r["source"]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    assert size[None] == target[None] == 0
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix(none).collect() == []


def test_html(spark):
    schema = "page_id long, url string, html string, host string, blocks int, tells string"
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><main><h1>Head</h1><p>A &amp; b<p>c   d<br>e</main><footer>f</footer>"
    found = html_wrapper.extract(
        spark.createDataFrame(
            [(1, "http://a.b/x", page, "h", 1, "t"), (1, "http://a.b/x", page, "h", 1, "t"), (2, None, None, None, None, None), (3, "not a url", "", "", 0, ""), (None, "http://a.b", "<p>" * 5000 + "deep", "", 0, ""), (4, "http://A.B/", "plain <b>text</b> only </p> <", "", 0, "")],
            schema,
        )
    ).collect()
    got = sorted((str(r["page_id"]), r["text"]) for r in found)
    assert got == [("1", "Head\nA & b\nc d e"), ("1", "Head\nA & b\nc d e"), ("2", ""), ("3", ""), ("4", "plain text only\n<"), ("None", "deep")]
    assert html_wrapper.extract(spark.createDataFrame([], schema)).collect() == []


def test_template_is_dropped(spark):
    def page(i):
        own = " ".join(WORDS[(i * 5 + k * (i + 1)) % len(WORDS)] for k in range(12))
        return f"<body><div class=x><p>Welcome to the site</p><div><h1>{i} {own}</h1><p>{own} {i}</p></div></div></body>"

    made = spark.createDataFrame([(i, f"http://h.com/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert not any("Welcome" in r["text"] for r in html_wrapper.extract(made).collect())


PROSE = "Rain fell on the old hills for three days before the river rose again."
REGIONS = [
    (f'<div style="overflow:hidden"><article><p>{PROSE}</p></article></div>', PROSE),
    (f'<body style="overflow:hidden"><p>{PROSE}</p></body>', PROSE),
    (f'<div title="a hidden place"><p>{PROSE}</p></div>', PROSE),
    (f'<div data-url="x?a=1 id=promo"><p>{PROSE}</p></div>', PROSE),
    *((f'<div class="{c}"><p>{PROSE}</p></div>', PROSE) for c in ("no-sidebar", "has-sidebar", "layout with-nav", "article-share", "hasSidebar")),
    *((f"<{t}><article><p>{PROSE}</p></article></div>", PROSE) for t in ("div class=sidebar", "form", "div id=banner")),
    (f"<article><p>Teaser</p></article><div><p>{PROSE}</p><p>{PROSE}</p></div>", f"Teaser\n{PROSE}\n{PROSE}"),
    (f"<main><p>{PROSE}</p></main><div><p>Small print</p></div>", PROSE),
    *((f"<{t}><p>Out</p></div></nav></aside><p>{PROSE}</p>", PROSE) for t in ("div hidden", "div class='x ad'", "div class=site-nav", "div id=sideBar", "div class=cookie-banner", "nav", "aside", "div role=search")),
    (f"<article><p>{PROSE}</p><div class=share><p>Out</p></div></article><div class=related><article><p>Out {PROSE} {PROSE}</p></article></div>", PROSE),
    (f"<article><p>{PROSE}</p></article><div class=sidebar><article><p>Out</p></article></div>", PROSE),
]


def test_regions_in_extract(spark):
    made = spark.createDataFrame([(i, "no host", page) for i, (page, _) in enumerate(REGIONS)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_wrapper.extract(made).collect()} == {i: text for i, (_, text) in enumerate(REGIONS)}


def test_neighbours(spark):
    schema = "vec_id long, vector array<float>, query_id long, list int, code string"
    vectors = [(i, [float(i % 7 + 1), float(i % 3), 1.0]) for i in range(60)]
    vectors += [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, float("nan"), 0.0]), (400, [1.0, None, 1.0]), (500, [1.0]), (0, [1.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in vectors], schema)
    found = ann_ivfpq.search(df, F.col("vec_id") % 20 == 0).collect()
    import math

    fine = {i: v for i, v in vectors[:60]}
    for q in (0, 20, 40):
        want = sorted((math.dist(fine[q], fine[i]), i) for i in fine if i != q)[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [(r[1], r[2]) for r in got] == [(i, d) for d, i in want]
    assert {r["query_id"] for r in found} == {0, 20, 40}
    assert ann_ivfpq.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, vector array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann_ivfpq.search(few, F.col("vec_id") == 0).collect()] == [(0, 1)]


def test_token_counts(docs, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    for r in docs.withColumn("tokens", token_counts.token_count(docs)).collect():
        assert r["tokens"] == len(sp.encode(r["text"] or ""))
    assert none.withColumn("tokens", token_counts.token_count(none)).collect() == []


def test_language(docs, none):
    found = langid_ftrl.identify(docs, docs).collect()
    assert same_rows(found) and {*docs.columns, "lang_pred", "score"} == found[0].asDict().keys()
    for r in found:
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"]))
        assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in langid_ftrl.identify(docs, none).collect()} == {"und"}
    assert langid_ftrl.identify(none, docs).collect() == []


def test_packing(docs, none):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    found = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    texts = {r[0]: r[1] for r in rows()}
    for doc, pieces in by_doc.items():
        if doc in (105, None):
            continue
        pieces.sort(key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == [*t.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(none).collect() == []


def test_simhash(docs, none):
    found = simhash_dedup.group(docs).collect()
    assert same_rows(found)
    prints = [r["fp"] & (1 << 64) - 1 for r in found]
    root = list(range(len(found)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[top(i)] = top(j)
    for i, r in enumerate(found):
        ids = [found[j]["doc_id"] for j in range(len(found)) if top(j) == top(i) and found[j]["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert all(r["fp"] == 0 for r in found if r["doc_id"] in (100, 101, 102))
    assert simhash_dedup.group(none).collect() == []


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(30)] + [(None, 1, 0), (1, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality_iforest.judge(docs, labels).collect()
    assert same_rows(found)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    long = next(r for r in found if r["doc_id"] == 104)
    assert (long["n_words"], long["n_repeat_words"], long["word_chars"]) == (30_000, 30_000, 120_000)
    assert quality_iforest.judge(none, labels).collect() == []
    assert same_rows(quality_iforest.judge(docs, labels.limit(0)).collect())


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, example int, turns string"
    data = [
        (1, 0, "user", "a\\<|im_end|>"), (1, 1, "assistant", None), (1, 2, "user\nx", "b"), (1, 2, "assistant", "<|im_start|>assistant"), (1, 3, "user", "last"),
        (2, 0, "user", "no reply"), (3, None, None, "x\\\\"), (3, 0, "assistant", "y"), (None, 1, "assistant", "z"), (4, 0, "assistant", "w" * 200_000), (5, 0, "assistant", "twice"), (5, 0, "assistant", "twice"),
    ]
    df = spark.createDataFrame([(*r, 1, "t") for r in data], schema)
    examples = chat_format.expand(df)
    import hashlib

    found = {r["conv_id"]: r for r in chat_format.digest(examples).collect()}
    for conv in (1, 2, 3, 4, 5, None):
        turns = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in data if r[0] == conv))
        r = found[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        loss = "".join(t for _, a, t in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len([r for r in examples.collect() if r["conv_id"] == 1]) == 3
    assert chat_format.digest(chat_format.expand(spark.createDataFrame([], schema))).collect() == []


def test_language_model(docs, none):
    found = lm_hpy.score(docs, *lm_hpy.learn(docs, frequent=20, suffixes=8), F.col("doc_id") % 7 == 2).collect()
    assert same_rows(found)
    for r in found:
        assert r["score"] < 0 and r["base_score"] < 0 and r["n_known"] == r["n_tokens"]
    assert {r["n_tokens"] for r in found if r["doc_id"] in (100, 101, 102)} == {1}
    model, words = lm_hpy.learn(none)
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in lm_hpy.score(docs, model, words, F.lit(False)).collect())
    assert lm_hpy.score(none, model, words, F.lit(False)).collect() == []


def test_class_probabilities_sum_to_one(docs):
    import numpy as np

    model, words = lm_hpy.learn(docs, frequent=20, suffixes=8)
    assert np.allclose((10.0 ** model.log_class.astype(float)).sum(axis=1), 1, atol=1e-4)
    table = words.toPandas()
    for kind in range(model.classes.shared, model.classes.number):
        own = table[table["kind"] == kind]
        known = 10.0 ** model.log_word(own["kind"].to_numpy(), own["own"].to_numpy())
        assert abs(known.sum() + model.unknown[kind] - 1) < 1e-4


@pytest.mark.parametrize("most", [common.SENT_BYTES, -1], ids=["sent", "shuffled"])
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_pipeline_stage(spark, docs, none, stage, most, monkeypatch):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table, stage by stage, with tables sent whole and shuffled."""
    import tempfile

    monkeypatch.setattr(common, "SENT_BYTES", most)

    name, function = stage
    sf = tempfile.mkdtemp()
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    found, empty = function(spark, docs, sf), function(spark, none, sf)
    assert empty.columns == found.columns and empty.count() == 0
    got = Counter(map(tuple, found.collect()))
    if name == "sequence_packing":
        assert {r[0] for r in got} == {r[0] for r in rows()}
        return
    given = Counter(rows())
    assert found.columns == docs.columns and set(got) <= set(given)
    texts = Counter({r: n for r, n in given.items() if r[1] and any(map(str.isalpha, r[1]))})
    if name == "language_id":
        assert all(n == texts[r] for r, n in got.items())
    elif name == "quality_rules":
        assert all(n == given[r] and len(r[1].split()) >= 50 for r, n in got.items())
    elif name == "simhash_near_dedup":
        assert all(n == 1 for n in got.values()) and sum(not (r[1] or "").split() for r in got) == 1
        assert {r[1] for r in got if r[0] is None or r[0] < 30} >= {"a null id"}
    else:
        assert all(0 < n <= 2 * given[r] for r, n in got.items())
        assert {r[0] for r in got} >= {100, 103, 104}


def test_encoder_equals_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    ranks = packing.ranks_of(path)
    encoder, library, draw = packing.Encoder(path, ranks), Tokenizer.from_file(path), random.Random(5)
    assert ranks is not None and packing.ranks_of(public_tokenizers.path("word_bpe_49k.json")) is None
    parts = ["a", "Éa", "don't", "'ll", " ", "  ", "\n", "\r\n", "\t", "12", "٣", "é", "é", "漢字", "🙂", " ", " ", "½", "…", "—", "€", "ß", "ŉ", "<|endoftext|>", "<|endof", "text|>", "_", "#!", "\x00", "\x0b", "\x85", "the", " of", "'s", "İ", "ª"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert encoder.of(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in (" " * 250_000 + "é x", "ab" * 60_000, "x\n" * 50_000 + "漢" + " y" * 50_000):
        assert encoder.of(text).tolist() == library.encode(text, add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")
    assert packing.Encoder(other, None).of("Some Words 12").tolist() == Tokenizer.from_file(other).encode("Some Words 12", add_special_tokens=False).ids
