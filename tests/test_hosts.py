"""Hosts, the guard against internal addresses, and registrable domains."""

import ipaddress
import os
import random

import pytest
from pyspark.sql import functions as F

from siftgrid.functions import hosts, suffixes

INTERNAL = "localhost LOCALHOST a.localhost 127.0.0.1 127.255.0.9 10.0.0.1 0.0.0.0 169.254.169.254 192.168.1.1 172.16.0.1 172.31.255.255 100.64.0.1 100.127.9.9 999.1.1.1 1.2.3.256 ::1 [::1] :: fe80::1 [fe80::1] fc00::1 fd12:3456::1 fc::1 ::ffff:127.0.0.1 ::ffff:a9fe:a9fe [::ffff:169.254.169.254] ::ffff:0:10.0.0.1 64:ff9b::10.0.0.1 64:ff9b::a00:1 ::ffff:1.2.3.999".split() + ["", None]
OUTSIDE = "example.com fc-barcelona.com fd-foo.io 8.8.8.8 172.15.0.1 172.32.0.1 100.63.0.1 100.128.0.1 169.253.1.1 192.169.0.1 2001:db8::1 [2606:4700::1111] ::ffff:8.8.8.8 64:ff9b::808:808 localhost.com notlocalhost 1.2.3 fe81::1".split()


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


def test_internal(spark):
    found = column(spark, INTERNAL + OUTSIDE, hosts.internal)
    assert found == [True] * len(INTERNAL) + [False] * len(OUTSIDE)


@pytest.mark.parametrize(
    ("url", "host"),
    [
        ("http://2130706433/", "127.0.0.1"), ("http://0x7f.1/", "127.0.0.1"), ("http://0177.0.0.01/", "127.0.0.1"), ("http://127.1", "127.0.0.1"), ("http://127.0.0.1./x", "127.0.0.1"), ("http://0/", "0.0.0.0"),
        ("http://256.1.1.1/", None), ("http://1.2.3.4.5/", None), ("http://4294967296/", None), ("http://08.1.1.1/", None), ("http://1.2.3.0x/", "1.2.3.0"), ("http://a.0x/", None), ("http://99999999999999999999/", None),
        ("https://[::FFFF:169.254.169.254]/latest", "::ffff:a9fe:a9fe"), ("http://[0:0:0:0:0:0:0:1]:8080/", "::1"), ("http://[fe80::0001]/", "fe80::1"), ("http://[2001:db8:0:0:1:0:0:1]/", "2001:db8::1:0:0:1"), ("http://[1::2::3]/", None), ("http://[::1", None),
        ("http://[12345::]/", None), ("http://[1:2:3:4:5:6:7:8]/", "1:2:3:4:5:6:7:8"), ("http://[1:2:3:4:5:6:7]/", None), ("http://[::]/", "::"), ("http://user:pw@ExAmple.COM:81/p", "example.com"), ("http://a@b@c.org/", "c.org"),
        ("  https:\\\\127.0.0.1\\x", "127.0.0.1"), ("http:127.0.0.1", "127.0.0.1"), ("ht\ntp://local\thost/", "localhost"), ("http://%31%32%37.0.0.1/", "127.0.0.1"), ("http://a b/", None), ("ftp://a.org/", None), ("//a.org/", None), ("http://", None), ("http://a.org:99999/", None), ("http://a.org:x/", None), (None, None),
    ],
)
def test_host_of_an_address(spark, url, host):
    assert column(spark, [url], lambda v: hosts.authority(v)["host"]) == [host]


def test_ipv6_texts_and_bits(spark):
    draw = random.Random(1)
    values = ["".join(draw.choice("000f1") for _ in range(32)) for _ in range(300)]
    values = [ipaddress.IPv6Address(int(v, 16)) for v in values]
    spelled = [draw.choice([str(v), v.exploded, str(v).upper(), f"[{v.exploded}]"]) for v in values]
    assert column(spark, spelled, lambda v: hosts.text6(hosts.address6(v))) == [str(v) if "." not in str(v) else None for v in values]
    bits = column(spark, spelled, hosts.address6)
    assert [(r["hi"] % 2**64) << 64 | r["lo"] % 2**64 for r in bits] == [int(v) for v in values]


def test_allowed(spark):
    cases = [
        ("https://example.org/a", None, True), ("ftp://example.org/a", None, False), ("http://127.0.0.1:8080/app.js.map", None, False),
        ("http://127.0.0.1:8080/app.js", "http://127.0.0.1:8080/index", True), ("http://127.0.0.1:6379/", "http://127.0.0.1:8080/index", False), ("https://localhost/x", "http://localhost/", False),
        ("http://localhost:80/x", "http://localhost/", True), ("http://0x7f000001/x", "http://127.0.0.1/", True), ("http://[::ffff:7f00:1]/", "https://example.org", False), ("http://10.0.0.1/", "not an address", False), ("nothing", "nothing", False), (None, None, False),
    ]
    df = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(cases)], "i int, u string, p string")
    found = [r[0] for r in df.select("i", hosts.allowed(F.col("u"), F.col("p")).alias("out")).orderBy("i").select("out").collect()]
    assert found == [want for _, _, want in cases]
    assert column(spark, ["https://a.org", "http://10.1.1.1"], hosts.allowed) == [True, False]


# The published test cases of the algorithm, for rules that the common list has.
PUBLISHED = """null null|COM null|example.COM example.com|WwW.example.COM example.com|.com null|.example null|.example.com null|.example.example null|biz null|domain.biz domain.biz|b.domain.biz domain.biz|a.b.domain.biz domain.biz
com null|example.com example.com|b.example.com example.com|a.b.example.com example.com|uk.com null|example.uk.com example.uk.com|b.example.uk.com example.uk.com|a.b.example.uk.com example.uk.com
mm null|c.mm null|b.c.mm b.c.mm|a.b.c.mm b.c.mm|jp null|test.jp test.jp|www.test.jp test.jp|ac.jp null|test.ac.jp test.ac.jp|www.test.ac.jp test.ac.jp|kyoto.jp null|test.kyoto.jp test.kyoto.jp|ide.kyoto.jp null|b.ide.kyoto.jp b.ide.kyoto.jp|a.b.ide.kyoto.jp b.ide.kyoto.jp
c.kobe.jp null|b.c.kobe.jp b.c.kobe.jp|a.b.c.kobe.jp b.c.kobe.jp|city.kobe.jp city.kobe.jp|www.city.kobe.jp city.kobe.jp|ck null|test.ck null|b.test.ck b.test.ck|a.b.test.ck b.test.ck|www.ck www.ck|www.www.ck www.ck
us null|test.us test.us|www.test.us test.us|ak.us null|test.ak.us test.ak.us|www.test.ak.us test.ak.us|k12.ak.us null|test.k12.ak.us test.k12.ak.us|www.test.k12.ak.us test.k12.ak.us""".replace("\n", "|")


def test_published_cases(spark):
    pairs = [[None if x == "null" else x for x in case.split()] for case in PUBLISHED.split("|")]
    assert column(spark, [a for a, _ in pairs], suffixes.DEFAULT.registrable) == [b for _, b in pairs]


def test_rules_against_plain_python(spark):
    draw = random.Random(2)
    names = "a b c d".split()
    rules = {".".join(draw.choice(names) for _ in range(draw.randrange(1, 4))) for _ in range(12)}
    rules |= {"*." + ".".join(draw.choice(names) for _ in range(draw.randrange(1, 3))) for _ in range(3)} | {"!" + ".".join(draw.choice(names) for _ in range(3)) for _ in range(3)}
    hosts_ = sorted({".".join(draw.choice([*names, "x"]) for _ in range(draw.randrange(1, 7))) for _ in range(400)})

    def plain(host, unknown):
        labels = host.split(".")
        tails = [".".join(labels[-k:]) for k in range(1, len(labels) + 1)]
        best = [k - 1 for k, t in enumerate(tails, 1) if "!" + t in rules][-1:]
        if not best:
            fits = [k for k, t in enumerate(tails, 1) if t in rules or (k > 1 and "*." + tails[k - 2] in rules)]
            best = [max(fits, default=unknown)]
        n = best[0]
        return ".".join(labels[-n - 1 :]) if 0 < n < len(labels) else None

    for unknown in (True, False):
        known = suffixes.Suffixes.of(["// a comment", "", *sorted(rules)], unknown)
        assert column(spark, hosts_, known.registrable) == [plain(h, int(unknown)) for h in hosts_]


def test_registrable_of_addresses_and_bare_names(spark):
    assert column(spark, ["127.0.0.1", "::1", "co.uk", "box", "Shop.Example.co.uk", None], suffixes.registrable) == ["127.0.0.1", "::1", "co.uk", "box", "example.co.uk", None]


FULL = "/usr/share/publicsuffix/public_suffix_list.dat"


@pytest.mark.skipif(not os.path.exists(FULL), reason="no full list here")
def test_full_list(spark):
    full = suffixes.Suffixes.read(spark, FULL)
    found = column(spark, ["a.b.ide.kyoto.jp", "www.city.kobe.jp", "x.y.gov.uk", "www.www.ck", "a.b.c.d.github.io", "only"], full.registrable)
    assert found == ["b.ide.kyoto.jp", "city.kobe.jp", "y.gov.uk", "www.ck", "d.github.io", None]
