"""Predicates that tell placeholders and harmless values from secrets. A null value counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgrid.functions import rules
from siftgrid.functions.text import contains_any, entropy, quoted


def _plain(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _starts(c: Column, prefixes: list[str]) -> Column:
    return c.rlike("^(?:" + "|".join(map(quoted, prefixes)) + ")")


def _ends(c: Column, ends: list[str]) -> Column:
    return c.rlike("(?:" + "|".join(map(quoted, ends)) + r")\z")


def placeholder(value: Column, min_length: int | Column = 8) -> Column:
    raw = _plain(value)
    text = F.lower(F.trim(raw))
    tokens = F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")
    alnum = F.regexp_replace(text, "[^a-z0-9]", "")
    commonest = F.array_max(F.transform(F.array_distinct(F.split(alnum, "")), lambda c: F.length(alnum) - F.length(F.replace(alnum, c, F.lit("")))))
    return _any(
        [
            F.length(text) < min_length,
            text.isin(rules.PLACEHOLDER_WORDS),
            _starts(text, rules.PLACEHOLDER_PREFIXES),
            (F.size(tokens) > 0) & (F.size(F.array_except(tokens, F.array(*map(F.lit, rules.PLACEHOLDER_WORDS)))) == 0),
            _any([text.contains(w) & (F.length(text) - len(w) < 20) for w in rules.PLACEHOLDER_PARTS]),
            (F.length(alnum) >= 8) & (F.coalesce(commonest, F.lit(0)) >= 0.5 * F.length(alnum)),
            raw.rlike("^[A-Z][A-Z_]*$") & raw.contains("_"),
            raw.isin(rules.PLACEHOLDER_NAMES),
            raw.rlike(r"^\{[A-Z_][A-Z_0-9]*\}$"),
        ]
    )


def low_entropy(value: Column, least: float | Column) -> Column:
    return entropy(_plain(value)) < least


def placeholder_db_url(value: Column) -> Column:
    pattern = r"(?i)^(?:postgres(?:ql)?|mysql2?|mongodb(?:\+srv)?|redis)://([^:@/\s]+):([^@/\s]+)@([^:/?\s]+)"
    text = F.trim(_plain(value))
    user, password = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    low = F.lower(password)
    shouting = lambda c: c.rlike("^_*[A-Z][A-Z_]*$")
    return text.rlike(pattern) & _any(
        [
            contains_any(password, rules.TEMPLATE_MARKERS),
            contains_any(F.lower(user), rules.TEMPLATE_MARKERS),
            password.rlike(r"\{[A-Z_][A-Z_0-9]*\}"),
            user.rlike(r"\{[A-Z_][A-Z_0-9]*\}"),
            shouting(user),
            shouting(password),
            low.isin(rules.DB_PASSWORDS),
            _ends(low, rules.DB_PASSWORD_ENDS),
            F.lower(user) == low,
        ]
    )


def local_url(value: Column) -> Column:
    return _plain(value).contains("://") & _plain(value).rlike(rules.LOCAL_HOST)


def local_basic_auth(value: Column) -> Column:
    text = F.lower(F.trim(_plain(value)))
    user = F.regexp_extract(text, r"https?://([^:@/\s]+):", 1)
    local = lambda c: c.isin(rules.LOCAL_USERS) | _ends(c, rules.LOCAL_ENDS)
    return local(text) | local(user)


def template_marker(value: Column) -> Column:
    return contains_any(_plain(value), rules.TEMPLATE_MARKERS)


def public_prefix(value: Column) -> Column:
    text = F.regexp_replace(F.lower(F.trim(_plain(value))), r"^(?:bearer |authorization: bearer |bearer:)\s*", "")
    return text.rlike("^(?:" + "|".join(map(quoted, rules.PUBLIC_PREFIXES)) + ")")


def client_side(text: Column) -> Column:
    """Whether a document has a mark of code that runs in browsers."""
    return contains_any(F.lower(_plain(text)), [m.lower() for m in rules.CLIENT_KEY_MARKERS])


def app_value(value: Column) -> Column:
    """Whether a value of the broad rules is no secret."""
    text = F.trim(_plain(value))
    low = F.lower(text)
    parts = F.split(text, "\\.")
    ip = text.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    return _any(
        [
            F.length(_plain(value)) == 0,
            contains_any(low, rules.APP_WORDS),
            (F.length(text) < 10) | (F.length(text) > 1000),
            text.rlike(r"^[\p{L}\p{N}]+$") & (F.size(F.array_distinct(F.split(text, ""))) < 5),
            text.rlike("|".join(rules.APP_SHAPES)),
            contains_any(low, rules.APP_STYLE_WORDS),
            ip & text.rlike(r"(^|\.)0\d"),
            ip & F.try_element_at(parts, F.lit(1)).isin([str(n) for n in rules.APP_RESERVED_OCTETS]),
            text.rlike("(?i)" + "|".join(rules.APP_PLACEHOLDERS)),
            text.rlike("^[A-Z]{2,3}-[A-Z]{3}-[A-Z]{3}$"),
            contains_any(F.translate(low, "_-", ""), rules.APP_BUILTINS),
            (F.length(text) < 30) & text.rlike("^[a-z][a-zA-Z0-9]*(?:" + "|".join(rules.APP_VARIABLE_ENDS) + ")$"),
            text.rlike("^[0-9]{1,2}-[0-9A-Za-z_]{40}$"),
        ]
    )


def ext_value(value: Column) -> Column:
    """The extension's variant: whole words instead of parts, and shapes of versions, ids, package names and short codes."""
    t = F.trim(value)
    low = F.lower(t)
    few = t.rlike(r"^(?:\d+|[a-zA-Z]+)$") & (F.size(F.array_distinct(F.split(t, ""))) < 5)
    octet = F.split(t, r"\.")[0].try_cast("int").isin(rules.APP_RESERVED_OCTETS) & t.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    short = [t.rlike(p) & (F.length(t) < n) for p, n in rules.EXT_SHORT]
    found = [
        (F.length(t) < 10) | (F.length(t) > 1000), low.isin(rules.APP_WORDS), few, *[t.rlike(p) for p in rules.APP_SHAPES], contains_any(low, rules.APP_STYLE_WORDS),
        contains_any(F.replace(F.replace(low, F.lit("_"), F.lit("")), F.lit("-"), F.lit("")), rules.APP_BUILTINS), *[t.rlike("(?i)" + p) for p in rules.APP_PLACEHOLDERS], octet, *[t.rlike(p) for p in rules.EXT_SHAPES], *short,
    ]
    out = F.lit(False)
    for f in found:
        out = out | F.coalesce(f, F.lit(False))
    return out


def skips(page: Column, source: Column, content: Column, first_party: list[str] = rules.FIRST_PARTY) -> dict[str, Column]:
    """By name whether a finding is skipped for where it was found: its page, its source and the scanned content."""
    p, s, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (page, source, content))
    internal = s.contains("devtools://")
    for scheme in rules.INTERNAL_SCHEMES:
        internal = internal | s.startswith(scheme)
    return {
        "first_party": contains_any(p, first_party),
        "browser_internal": internal,
        "own_auth_header": s.contains("request header") & (s.contains("authorization") | s.contains("cookie")),
        "service_token": contains_any(s, rules.SERVICE_TOKENS),
        "infra_header": s.contains("header") & contains_any(s, rules.INFRA_HEADERS),
        "vendor_script": contains_any(s, rules.VENDOR_SCRIPTS),
        "signed_url": contains_any(s, rules.SIGNED_URL_SOURCES) | contains_any(c, rules.SIGNED_URL_MARKS) | contains_any(s, rules.SIGNED_URL_MARKS),
        "azure_sas": c.rlike(rules.AZURE_SAS),
    }
