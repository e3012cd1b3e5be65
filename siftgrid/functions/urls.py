"""URL, address, version and token scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def host(url: Column) -> Column:
    """Host of an explicit http(s) URL, lower-cased, an IPv6 address without its brackets; else null."""
    found = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1))
    return F.when(found != "", F.regexp_replace(found, r"^\[|\]$", ""))


def crawl_key(url: Column) -> Column:
    """What a crawl compares pages by: scheme, host and path, without parameters of the last segment, query, fragment and final slashes."""
    plain = F.regexp_replace(F.regexp_replace(url, r"[?#][\s\S]*$", ""), r";[^/]*$", "")
    return F.rtrim(F.concat(F.lower(F.regexp_extract(plain, r"^([A-Za-z]+:)", 1)), F.regexp_replace(plain, r"^[A-Za-z]+:", "")), F.lit("/"))


def normalize(url: Column) -> Column:
    """Scheme, host and path without query, fragment and final slashes."""
    return F.rtrim(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/"))


def resolve(reference: Column, base: Column) -> Column:
    """A reference against the address it stands in: whole, without a scheme, from the root, or beside the base."""
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(plain.rlike("^[a-z]+://[^/]+/"), F.regexp_replace(plain, "[^/]*$", "")).otherwise(F.concat(plain, F.lit("/")))
    return (
        F.when(reference.rlike("^[a-z]+://"), reference)
        .when(reference.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), reference))
        .when(reference.startswith("/"), F.concat(F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1), reference))
        .otherwise(F.concat(folder, reference))
    )


def query_params(url: Column) -> Column:
    """array<struct<name, value>> of the query, blanks kept."""
    text = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(text, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.split(p, "=", 2)[0].alias("name"), F.coalesce(F.try_element_at(F.split(p, "=", 2), F.lit(2)), F.lit("")).alias("value")))


def object_id(segment: Column) -> Column:
    """Digits, a UUID, or 16 to 32 hex digits."""
    return segment.rlike(r"(?i)^(?:\d+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16,32})$")


def version(text: Column) -> Column:
    """struct<major, minor, patch> of a loose version; null where a component is empty."""
    head = F.regexp_extract(F.regexp_replace(F.trim(text), "^[vV]+", ""), r"^([0-9.]*)", 1)
    part = lambda i: F.coalesce(F.try_element_at(F.split(head, r"\."), F.lit(i)), F.lit("0")).cast("int")
    fine = head.rlike(r"^[0-9]+(\.[0-9]+){0,2}(\.|$)") & ~head.rlike(r"^[0-9]+(\.[0-9]+){0,1}\.(\.|$)")
    return F.when(fine, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def jwt_payload(token: Column) -> Column:
    """JSON text of a three-part token's payload; null if it has another shape."""
    body = F.translate(F.split(token, r"\.")[1], "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(F.size(F.split(token, r"\.")) == 3, F.decode(F.unbase64(padded), "utf-8"))


def normalize_code(text: Column) -> Column:
    """Without comments, string contents, case and runs of white space."""
    out = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    out = F.regexp_replace(out, r"(?m)(?://|#)[^\n]*$", " ")
    out = F.regexp_replace(out, r"\"[^\"\n]*\"|'[^'\n]*'", '""')
    return F.trim(F.regexp_replace(F.lower(out), "[ \\t\\n\\x0b\\f\\r]+", " "))


def shingles(text: Column, size: int = 8, piece: int = 256) -> Column:
    """Distinct stretches of `size` characters; a shorter text is one. They are cut from pieces of the text, so time is in proportion to it."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)), F.lit(piece))
    pieces = F.transform(starts, lambda i: F.substring(text, i, F.lit(piece + size - 1)))
    cut = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - size + 1), lambda i: F.substring(p, i, F.lit(size))))
    return F.when(n < size, F.array(text)).otherwise(F.array_distinct(F.flatten(cut)))