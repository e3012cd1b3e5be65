"""Captured HTTP exchanges and browser events: what of them is scanned, and what they show by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrid.functions import rules, urls
from siftgrid.functions.text import contains_any

MOST_BODY, MOST_EVENT = 10 * 1024 * 1024, 2 * 1024 * 1024
TEXT_MIMES = ["text/", "json", "javascript", "xml", "html", "x-www-form-urlencoded", "graphql", "ecmascript"]


def header(headers: Column, name: str) -> Column:
    """A header's value by name in any case, empty if there is none."""
    return F.coalesce(F.get(F.filter(F.map_entries(headers), lambda h: F.lower(h["key"]) == name), F.lit(0))["value"], F.lit(""))


def surfaces(exchanges: DataFrame) -> DataFrame:
    """id, kind, content of exchanges (id, url, headers, body): URL, each header, query, form, JSON body and whole body.

    An exchange whose body is larger than 10 MiB gives nothing.
    """
    one = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    mime = F.lower(header(F.col("headers"), "content-type"))
    query = F.array_join(F.transform(urls.query_params(F.col("url")), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    heads = F.transform(F.map_entries("headers"), lambda h: one("header", F.concat(h["key"], F.lit(": "), h["value"])))
    full = F.length("body") > 0
    rest = F.array(
        one("url", F.col("url")),
        F.when(query != "", one("query", query)),
        F.when(full & mime.contains("x-www-form-urlencoded"), one("form", F.col("body"))),
        F.when(full & mime.contains("application/json") & F.try_parse_json("body").isNotNull(), one("json", F.col("body"))),
        F.when(full, one("body", F.col("body"))),
    )
    kept = exchanges.where(F.coalesce(F.octet_length("body"), F.lit(0)) <= MOST_BODY)
    return kept.select("id", F.inline(F.concat(F.array_compact(rest), heads)))


def events(captured: DataFrame) -> DataFrame:
    """id, kind, url, content of captured events (id, kind, request_id, url, mime, opcode, encoded, payload) that are scanned.

    A body (kind `body`) takes address and type from the response of its request. Bodies need a
    text type or none, and an http or ws address; encoded ones are decoded; above 2 MiB they go.
    Frames need text (opcode 1). Console and log lines come as they are.
    """
    answered = captured.where("kind = 'response'").select("request_id", F.col("url").alias("at"), F.col("mime").alias("type")).dropDuplicates(["request_id"])
    bodies = captured.where("kind = 'body'").join(answered, "request_id")
    fine = F.col("at").rlike(r"^(?:https?|wss?)://[^/?#]") & ((F.col("type") == "") | contains_any(F.lower("type"), TEXT_MIMES))
    # Four characters of base64 are three bytes: the size is known before decoding.
    bytes_ = F.when(F.col("encoded"), F.floor(F.length(F.rtrim("payload", F.lit("="))) * 3 / 4)).otherwise(F.octet_length("payload"))
    content = F.when(F.col("encoded"), F.decode(F.unbase64("payload"), "utf-8")).otherwise(F.col("payload"))
    body = bodies.where(fine & (bytes_ <= MOST_EVENT)).select("id", "kind", F.col("at").alias("url"), content.alias("content"))
    frames = captured.where((F.col("kind") == "frame") & (F.col("opcode") == 1) & (F.octet_length("payload") <= MOST_EVENT))
    lines = captured.where(F.col("kind").isin("console", "log"))
    return body.unionByName(frames.unionByName(lines).select("id", "kind", "url", F.col("payload").alias("content"))).where("content <> ''")


def dangerous_params(found: DataFrame) -> DataFrame:
    """host, path, params, severity: parameters that feed commands, by endpoint of URLs (url)."""
    named = found.select(urls.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1).alias("path"), F.explode(urls.query_params(F.col("url"))).alias("p"))
    by_end = named.where(F.lower("p.name").isin(rules.DANGEROUS_PARAMS)).groupBy("host", "path").agg(F.sort_array(F.collect_set(F.lower("p.name"))).alias("params"))
    worse = F.lower("path").rlike(r"\.(aspx|asp|jsp|php|cgi|do|action)$") & F.arrays_overlap("params", F.array(*map(F.lit, rules.COMMAND_PARAMS)))
    return by_end.withColumn("severity", F.when(worse, "high").otherwise("medium"))


def takeover(body: Column) -> Column:
    """The first service in rule order one of whose marks stands in the body; null for none. A chain of literals, so no join."""
    service = F.lit(None).cast("string")
    for name, marks in reversed(rules.TAKEOVER):
        service = F.when(F.greatest(*[F.contains(body, F.lit(m)) for m in marks], F.lit(False)), name).otherwise(service)
    return service


TECH_HEADERS = ["Server", "X-Powered-By", "X-AspNet-Version", "X-Generator"]
GENERATOR = r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']"""


def technology(exchanges: DataFrame) -> DataFrame:
    """id, kind, value: headers and the generator tag (within 50,000 characters) that name software."""
    pair = lambda k, v: F.when(v != "", F.struct(F.lit(k).alias("kind"), v.alias("value")))
    found = [pair(h, header(F.col("headers"), h.lower())) for h in TECH_HEADERS]
    generator = F.trim(F.regexp_extract(F.left("body", F.lit(50_000)), GENERATOR, 1))
    return exchanges.select("id", F.inline(F.array_compact(F.array(*found, pair("generator", generator)))))


def access_control(exchanges: DataFrame) -> DataFrame:
    """id, value, severity, authenticated of exchanges (id, method, url, headers, status) for objects of sensitive resources.

    Without a login, or by a caller whose ids are known and aren't the object's. Objects come from the
    path (an id and the segment before it) and the query; callers from a bearer token's claims, headers and the query.
    """
    path = F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    before = F.concat(F.array(F.lit("")), F.transform(parts, lambda s: F.lower(s)))
    pair = lambda resource, i: F.struct(resource.alias("resource"), i.alias("id"))
    in_path = F.filter(F.zip_with(F.slice(before, F.lit(1), F.size(parts)), parts, pair), lambda c: urls.object_id(c["id"]))
    params = F.filter(urls.query_params(F.col("url")), lambda p: p["value"] != "")

    def resource(name: Column) -> Column:
        return F.when(name.endswith("_id"), F.left(name, F.length(name) - 3)).when(name.isin("userid", "uid"), "user").otherwise(name)

    named = F.filter(params, lambda p: F.lower(p["name"]).endswith("id") & urls.object_id(p["value"]))
    in_query = F.transform(named, lambda p: pair(resource(F.lower(p["name"])), p["value"]))
    sensitive = F.filter(F.concat(in_path, in_query), lambda c: c["resource"].isin(rules.SENSITIVE_RESOURCES))
    has_auth = F.exists(F.map_keys("headers"), lambda h: F.lower(h).isin(rules.AUTH_HEADERS)) | F.exists(params, lambda p: p["name"].isin(rules.AUTH_QUERY_KEYS))
    bearer = header(F.col("headers"), "authorization")
    claims = F.when(bearer.rlike("(?i)^bearer "), urls.jwt_payload(F.trim(F.substring(bearer, 8, 1_000_000))))
    mine = [F.get_json_object(claims, f"$.{c}") for c in rules.SUBJECT_CLAIMS] + [F.nullif(F.trim(header(F.col("headers"), h)), F.lit("")) for h in rules.SUBJECT_HEADERS]
    from_query = F.transform(F.filter(params, lambda p: p["name"].isin(rules.SUBJECT_QUERY_KEYS)), lambda p: F.trim(p["value"]))
    known = exchanges.select(
        "id", F.upper("method").alias("method"), path.alias("path"), "status", has_auth.alias("authenticated"), sensitive.alias("objects"),
        F.concat(F.array_compact(F.array(*mine)), from_query).alias("subjects"),
    )
    other = F.size(F.array_except(F.transform("objects", lambda c: c["id"]), "subjects")) > 0
    asked = known.where((F.size("objects") > 0) & F.col("method").isin("GET", "POST", "PUT", "PATCH", "DELETE") & F.col("status").isNotNull())
    hit = asked.where(~F.col("authenticated") | (F.col("authenticated") & (F.col("status") < 400) & (F.size("subjects") > 0) & other))
    score = (
        F.when(F.col("method").isin("PUT", "PATCH", "DELETE"), 2).when(F.col("method") == "POST", 1).otherwise(0)
        + F.when(F.col("status").between(200, 299), 2).otherwise(0)
        + F.when(F.col("authenticated"), 2).otherwise(1)
    )
    return hit.select("id", F.concat_ws(" ", "method", "path").alias("value"), F.when(score >= 5, "high").otherwise("medium").alias("severity"), "authenticated")


SAMPLE, SIMILAR = 5000, 0.85


def same_bodies(answers: DataFrame) -> DataFrame:
    """url, similarity: object URLs that users A and B of answers (url, user, status, body) both got with all but the same body.

    The similarity is the share of matching blocks in the first 5,000 characters; pairs with equal samples, and
    pairs whose letters alone rule it out, skip the matching.
    """
    ok = answers.where(F.col("status").between(200, 299)).select("url", "user", F.left(F.coalesce("body", F.lit("")), F.lit(SAMPLE)).alias("body"))
    a, b = (ok.where(F.col("user") == u).groupBy("url").agg(F.min("body").alias(u)) for u in ("a", "b"))

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                m = SequenceMatcher(None, x, y)
                out.append(1.0 if x == y else m.ratio() if m.quick_ratio() >= SIMILAR else 0.0)
            yield pd.Series(out, dtype="float64")

    return a.join(b, "url").select("url", ratio("a", "b").alias("similarity")).where(F.col("similarity") >= SIMILAR)
