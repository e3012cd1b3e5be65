"""Redaction, personal-data masks and identities of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgrid.functions import rules
from siftgrid.functions.text import as_re2


def redact_mask(value: Column, keep_start: int = 6, keep_end: int = 4) -> Column:
    text = F.trim(F.coalesce(value, F.lit("")))
    n = F.length(text)
    return (
        F.when(n == 0, "")
        .when(n <= 4, "[redacted]")
        .when(n <= keep_start + keep_end + 6, F.concat(F.substring(text, 1, 2), F.lit("...[redacted]")))
        .otherwise(F.concat(F.substring(text, 1, keep_start), F.lit("...[redacted]..."), F.right(text, F.lit(keep_end))))
    )


def redact_ends(value: Column, start: int = 12, end: int = 6) -> Column:
    """Values of up to `start + end + 6` characters stay whole."""
    return F.when(F.length(value) <= start + end + 6, value).otherwise(F.concat(F.substring(value, 1, start), F.lit("..."), F.right(value, F.lit(end))))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex of HMAC-SHA256, from two SHA-256 calls."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.unhex(F.lit(inner.hex())), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(first)), 256)


def redact_hmac(value: Column, salt: bytes) -> Column:
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.length(text) == 0, "").otherwise(F.concat(F.lit("[redacted:"), F.substring(hmac_sha256(salt, text), 1, 8), F.lit("]")))


def redact_url(url: Column) -> Column:
    """The values of secret query keys masked, the rest of the URL as it is."""
    pairs = F.regexp_extract_all(url, F.lit(r"[?&][^=&]+=[^&#]+"), F.lit(0))
    gaps = F.split(url, r"[?&][^=&]+=[^&#]+", -1)

    def masked(pair: Column) -> Column:
        name = F.regexp_extract(pair, r"^([?&][^=&]+=)", 1)
        secret = F.lower(F.regexp_extract(pair, r"^[?&]([^=&]+)=", 1)).isin(rules.SECRET_QUERY_KEYS)
        return F.when(secret, F.concat(name, redact_mask(F.regexp_extract(pair, r"(?s)^[?&][^=&]+=(.*)$", 1)))).otherwise(pair)

    rebuilt = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(masked(F.try_element_at(pairs, i + 1)), F.lit("")))), "")
    return F.when(F.length(F.coalesce(url, F.lit(""))) == 0, "").otherwise(rebuilt)


def redact_snippet(snippet: Column, value: Column, redacted: Column) -> Column:
    return F.when(F.length(value) > 0, F.replace(snippet, value, redacted)).otherwise(snippet)


def pii_scrub(text: Column) -> Column:
    """Personal data masked. Words are of ASCII letters; phone numbers are sought twice, for those that stand right behind another."""
    for pattern, mask in rules.PII_MASKS:
        for _ in range(2 if mask == "[phone]" else 1):
            text = F.regexp_replace(text, as_re2(pattern), mask)
    return text


def pii_scrub_preserve(snippet: Column, kept: Column) -> Column:
    """Masks around one protected string."""
    guard = F.lit("\x01kept\x01")
    return F.when(F.length(kept) > 0, F.replace(pii_scrub(F.replace(snippet, kept, guard)), guard, kept)).otherwise(pii_scrub(snippet))


def stable_id(*parts: Column, prefix: str = "finding") -> Column:
    text = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 16))


def fnv_id(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as 8 hex digits."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    value = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def fingerprint(key: bytes, *parts: Column) -> Column:
    """Identity of a finding that doesn't depend on its line; empty without a key."""
    if not key:
        return F.lit("")
    text = F.concat_ws("\x00", F.lit("v1"), *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit("fp1_"), F.substring(hmac_sha256(key, text), 1, 24))


def signature(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def severity_rank(severity: Column) -> Column:
    """info 0 to critical 4; unknown counts as info."""
    out = F.lit(0)
    for rank, name in enumerate(rules.SEVERITIES):
        out = F.when(F.lower(severity) == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, rules.SEVERITIES)), (rank + 1).cast("int"))


def confidence(severity: Column, source: Column) -> Column:
    return (
        F.when(severity.isin("critical", "high"), 0.9)
        .when(severity == "medium", 0.7)
        .when(source.isin("url", "header"), 0.65)
        .otherwise(0.55)
    )
