"""Rules as rows: the shipped rules give what they give elsewhere, and users' fields decide."""

import random
import re

import pytest

from siftgrid.operators import detect, rulebook
from siftgrid.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_shipped_rules_find_the_same(spark):
    docs = T.planted(spark, SF)
    columns = ("doc_id", "source", "redacted", "line", "severity", "start", "value", "snippet")
    want = sorted((*(str(r[c]) for c in columns), r["rule"]) for r in detect.core_findings(docs).collect())
    found = sorted((*(str(r[c]) for c in columns), r["detector_id"].split(".", 1)[1]) for r in rulebook.findings(docs, rulebook.shipped(spark)).collect())
    assert found == want and len(found) > 100


def book(spark, rows):
    return spark.createDataFrame(rows, "id string, pattern string, min_length int, capture_group int, min_entropy double, pack string, severity string, aliases array<string>, finding_type string")


def test_fields_of_a_rule(spark):
    rules = book(
        spark,
        [
            ("plain", r"key=(\w+)", None, None, None, None, None, None, None),
            ("long", r"key=(\w+)", 12, None, None, "api", "critical", ["older", "oldest"], "long_key"),
            ("dense", r"key=(\w+)", None, 0, 3.1, "authn", "high", None, None),
            ("second", r"(\w+) pair (\w+)", None, 2, None, "recon", "low", None, None),
            ("nameless", r"(?:zz(\d+)|yy\w{9})", None, None, None, "client", "info", None, None),
        ],
    )
    docs = spark.createDataFrame(
        [(1, "a.js", "key=q7Zp2Lm9x\nKEY=aabbccddaabbcc"), (2, "a.js", "firstword pair secondword9"), (3, "a.js", None), (4, "a.js", ""), (5, "a.js", "key=q7Zp2Lm9x " * 3), (6, "a.js", "YYabcdefghi"), (7, "a.js", "éé\nſ İ key=éüöäßáàâ1")],
        "doc_id long, source string, content string",
    )
    found = {(r["doc_id"], r["detector_id"], r["type"], r["severity"], r["line"], r["value"]) for r in rulebook.findings(docs, rules).collect()}
    a, b, c = "q7Zp2Lm9x", "aabbccddaabbcc", "éüöäßáàâ1"
    want = {(1, "leak.plain", "plain", "medium", 1, a), (1, "leak.plain", "plain", "medium", 2, b), (5, "leak.plain", "plain", "medium", 1, a), (7, "leak.plain", "plain", "medium", 2, c)}
    want |= {(1, "api.long", "long_key", "critical", 2, b)}
    want |= {(1, "authn.dense", "dense", "high", 1, a), (5, "authn.dense", "dense", "high", 1, a), (7, "authn.dense", "dense", "high", 2, c)} | {(2, "recon.second", "second", "low", 1, "secondword9")}
    # The group of `nameless` takes no part in its match: an empty value is no finding.
    assert found == want
    names = {r["name"]: r["detector_id"] for r in rulebook.by_name(rules).collect()}
    assert names["api.oldest"] == names["api.older"] == names["api.long"] == "api.long" and len(names) == 7
    old = spark.createDataFrame([("api.older", 1), ("leak.plain", 2), ("gone.rule", 3), (None, 4)], "detector_id string, n int")
    assert {tuple(r) for r in rulebook.resolved(old, rules).collect()} == {("api.long", 1), ("leak.plain", 2), ("gone.rule", 3), (None, 4)}
    picked = rulebook.chosen(rules, ["api", "leak"])
    assert {r["id"] for r in picked.collect()} == {"plain", "long"}
    assert {r["id"] for r in rulebook.chosen(rulebook.shipped(spark), ["leak"], ["mcp"]).collect()} >= {"openai_api_key"}
    with pytest.raises(ValueError, match="unknown packs"):
        rulebook.chosen(rules, ["nothing"])


@pytest.mark.parametrize(
    ("rows", "said"),
    [
        ([("a", "x(", None, None, None, None, None, None, None)], "a: "),
        ([("a", "x", None, None, None, None, "huge", None, None)], "unknown severity"),
        ([("a", "x", None, None, None, "nopack", None, None, None)], "unknown pack"),
        ([("a", "x", None, None, None, None, None, ["b"], None), ("b", "y", None, None, None, None, None, None, None)], "twice"),
        ([(None, "x", None, None, None, None, None, None, None)], "needs an id"),
    ],
)
def test_bad_rules(spark, rows, said):
    with pytest.raises(ValueError, match=said):
        rulebook.findings(spark.createDataFrame([(1, "s", "t")], "doc_id long, source string, content string"), book(spark, rows))


def test_empty_book(spark):
    docs = T.planted(spark, SF)
    assert rulebook.findings(docs, rulebook.shipped(spark).limit(0)).collect() == []


def test_many_rules_match_as_one_by_one():
    draw = random.Random(3)
    letters = "abcxyz0189"
    patterns = [("".join(draw.choice(letters) for _ in range(4)) + r"[-_]?(\d{2,})", 0) for _ in range(800)]
    patterns += [(rf"(?:{a}|{b})\w+", 0) for a, b in (("".join(draw.choice(letters) for _ in range(3)) for _ in range(2)) for _ in range(100))] + [(r"\b\d{6}\b", 0), (r"[xyz]{5}", 0)]
    matcher = rulebook.Matcher(patterns)
    tried = 0
    for _ in range(300):
        text = "".join(draw.choice(letters + " -_İK") for _ in range(400))
        want = sorted((k, m.start(), m.end(), m.group(1) if re.compile(p).groups else m.group(0)) for k, (p, _) in enumerate(patterns) for m in re.finditer(p, text, re.I | re.M))
        assert sorted((k, a, b, v) for k, v, a, b in matcher.matches(text)) == want
        tried += len(matcher.tried(text))
    assert tried / 300 < 200
