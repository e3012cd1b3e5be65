"""The template decides: pages without telling tags, several layouts on a host, odd and very large pages."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from siftgrid.llm import common, html_wrapper

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def truth(raw):
    article = re.search(r"<article>(.*?)(?:</article>|$)", raw, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(p for p in parts if p)


def test_without_telling_tags(spark):
    """With nav, article, footer, h1 and the advert's class gone, only the template tells; without it most pages come out wrong."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("url", F.lit("http://h.com/x"))
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    bare = F.regexp_replace(F.regexp_replace("html", r"<(/?)(nav|article|footer|h1|ul)\b[^>]*>", "<$1div>"), '<div class="ad">', "<div>")
    found = html_wrapper.extract(pages.withColumn("html", bare)).collect()
    assert sum(r["text"] != want[r["page_id"]] for r in found) <= 0.01 * len(found)
    alone = html_wrapper.extract(pages.withColumn("html", bare).withColumn("url", F.lit("none"))).collect()
    assert sum(r["text"] != want[r["page_id"]] for r in alone) > 0.9 * len(alone)


def test_layouts_of_a_host(spark):
    """A host with two layouts and some error pages: each layout's fixed and outer text goes, and error pages stay apart."""
    body = lambda i: "".join(f"<p>words{i} {'more ' * (i % 7)}{k}x{i}</p>" for k in range(2 + i % 3))
    one = [f"<div><div><p>Big offer {i}</p></div><div><h2>T{i}</h2><p>Always here</p>{body(i)}</div></div>" for i in range(30)]
    two = [f"<section><div><h2>U{i}</h2>{body(i)}</div><div>Note {i}</div></section>" for i in range(30)]
    pages = [f"<body>{x}</body>" for x in [*one, *two]] + ["<body><b>Error</b></body>"] * 5
    want = [f"T{i}\n" + "\n".join(re.findall(r"<p>(.*?)</p>", body(i))) for i in range(30)] + [f"U{i}\n" + "\n".join(re.findall(r"<p>(.*?)</p>", body(i))) for i in range(30)] + ["Error"] * 5
    made = spark.createDataFrame([(i, "http://h.com/", p) for i, p in enumerate(pages)], SCHEMA)
    assert {r["page_id"]: r["text"] for r in html_wrapper.extract(made).collect()} == dict(enumerate(want))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    """Pivots and templates sent whole or joined by a shuffle."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("url", F.lit("http://h.com/x"))
    sent = html_wrapper.extract(pages).collect()
    monkeypatch.setattr(common, "SENT_BYTES", -1)
    assert sorted(map(str, html_wrapper.extract(pages).collect())) == sorted(map(str, sent))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<video-js><p>a</p></video-js><p>b", "a\nb"), ("<p>a</p><svg/><p>b</p>", "a\nb"), ("<p>a</p><iframe/><p>b</p>", "a\nb"), ("<p>a</p><datalist><option>x<option>y</datalist><p>b", "a\nb"),
        ('<div class="content has-sidebar"><p>a</p></div>', "a"), ('<article class="post comments-open"><p>a</p></article>', "a"), ('<h1 id="search-results">a</h1>', "a"), ("<p><a>x</p><p>a</p><p>b", "x\na\nb"),
        ('<p title=5">Hello', "Hello"), ("<a <a <a ", ""), ("a < b <3 c", "a < b <3 c"), ("<p>a<textarea>b<p>c", "a b\nc"), ("<p>a<!-- b", "a"), ("</p>x</div>y", "x\ny"), ("<svg><p>no</svg><p>a", "a"), ("<head><title>t</title><p>a", "a"),
    ],
)
def test_odd_pages(page, want):
    blocks = [b for b in html_wrapper.aligned(page, {}, "")[2] if b[4] == html_wrapper.CLEAR and not (b[6] and not b[5])]
    assert "\n".join(b[0] for b in blocks) == want


def test_large_pages_end():
    began = time.time()
    for page in ("<a " * 800_000, "<p title='" * 80_000, "<textarea>" * 80_000, "<div>" * 50_000 + "</p>" * 50_000 + "x", "<" * 300_000, "<p " + " " * 500_000 + "x"):
        html_wrapper.parse(page)
    mixed = lambda k: "".join(f"<{('div', 'section', 'table')[(i * i + k * i) % 3]}>" for i in range(5000)) + "x"
    wide = lambda k: "".join(f"<div><p>w{i * k}</p></div>" for i in range(10_000))
    for a, b in ((mixed(1), mixed(2)), ("<div>" * 5000 + "x", "<div>" * 4000 + "x"), (wide(1), wide(2)), (wide(1), "<p>x")):
        pivot = html_wrapper.restored(html_wrapper.skeleton(html_wrapper.parse(b)))
        html_wrapper.aligned(a, {html_wrapper.outline(html_wrapper.parse(a)): pivot}, "")
    assert time.time() - began < 60


def test_matching_equals_plain_recursion():
    import random

    def matched(a, b):
        if a.label != b.label:
            return 0
        if a.label == "#":
            return 1 + (a.text == b.text)
        row = [0] * (len(b.kids) + 1)
        for x in a.kids:
            before, row = row, [0]
            for j, y in enumerate(b.kids):
                row.append(max(before[j + 1], row[j], before[j] + matched(x, y)))
        return row[-1] + 1

    draw = random.Random(2)

    def tree(d):
        return str(draw.randint(0, 3)) if not d else "".join(f"<{(t := draw.choice(['div', 'ul', 'section']))}>{tree(d - 1)}</{t}>" for _ in range(draw.randint(0, 3)))

    for _ in range(200):
        a, b = (html_wrapper.parse(tree(3)) for _ in range(2))
        html_wrapper.measured(a), html_wrapper.measured(b)
        found = html_wrapper.Alignment(a, b)
        assert found.matched(a, b) == matched(a, b)
        assert all(x == 0 or found.to[x].label == html_wrapper.measured(a)[x].label for x in found.to)
