"""Expressions against plain Python."""

import hashlib
import hmac
import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftgrid.functions import identity, text

SET = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
texts = st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=20)


def column(spark, values, make):
    return [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(make(F.col("x")).alias("y")).collect()]


@SET
@given(texts)
def test_hmac(spark, values):
    key = b"k" * 70
    assert column(spark, values, lambda c: identity.hmac_sha256(key, c)) == [hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in values]


@SET
@given(texts)
def test_entropy(spark, values):
    for v, got in zip(values, column(spark, values, text.entropy), strict=True):
        assert math.isclose(got, -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()), abs_tol=1e-9)


@SET
@given(texts)
def test_fnv_over_utf16_units(spark, values):
    def fnv(v):
        h, raw = 2166136261, v.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    assert column(spark, values, identity.fnv_id) == [fnv(v) for v in values]


@SET
@given(st.lists(st.text("ab1.\né ", max_size=30), min_size=1, max_size=20))
def test_match_offsets_and_lines(spark, values):
    import re

    got = column(spark, values, lambda c: F.transform(text.matches(c, "a+b?(1)?", 0), lambda m: F.struct(m["value"], m["start"], m["stop"], m["line"])))
    for v, rows in zip(values, got, strict=True):
        assert [tuple(r) for r in rows] == [(m[0], m.start(), m.end(), v.count("\n", 0, m.start()) + 1) for m in re.finditer("a+b?(1)?", v)]


def test_redaction_leaks_nothing(spark):
    values = ["abcd", "abcdefghij", "a" * 16, "0123456789abcdefghij", "  ", ""]
    assert column(spark, values, identity.redact_mask) == ["[redacted]", "ab...[redacted]", "aa...[redacted]", "012345...[redacted]...ghij", "", ""]


def test_scrub_is_idempotent_and_keeps_tokens(spark):
    values = ["mail a.b@c.org or +1 555-123-4567", "sk_live_4242424242424242", "12 Long Hill Road, 4111 1111 1111 1111"]
    once = column(spark, values, identity.pii_scrub)
    assert once == ["mail [email] or [phone]", "sk_live_4242424242424242", "[addr], [card-or-num]"]
    assert column(spark, once, identity.pii_scrub) == once


def test_difference_with_itself_is_empty(spark):
    from siftgrid.operators import findings
    from siftgrid.plans.finding_queries import named

    f = named(spark, "/root/testdata/sf0.001")
    assert findings.difference(f, f).count() == 0


def test_inline_source_maps_carry_whole_texts(spark, tmp_path):
    from siftgrid.plans import registry

    rows = [(1, "short"), (2, "line 1\r\n\"é漢🙂\" \\ " * 5000), (3, ""), (4, None), (5, "//# sourceMappingURL=data:application/json;base64,AAAA\n" * 9), (2, "a" * 81)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["src_sourcemap_inline"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted((i, f"a{i}.js", t) for i, t in rows if t is not None)
