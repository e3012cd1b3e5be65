"""What fetched pages, scripts and certificates of a site show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrid.functions import urls
from siftgrid.functions.text import contains_any
from siftgrid.operators import crawl

# Security headers, exposed paths with a mark of their content, admin paths, outdated software.
HEADERS = {"strict-transport-security": "medium", "content-security-policy": "medium", "x-frame-options": "low", "x-content-type-options": "low", "referrer-policy": "low", "permissions-policy": "low"}
EXPOSED = [("/.env", "critical", "="), ("/.git/HEAD", "high", "ref:"), ("/.git/config", "high", "[core]"), ("/backup.zip", "high", ""), ("/backup.tar.gz", "high", ""), ("/db.sql", "critical", "CREATE TABLE")]
ADMIN = ["/admin", "/administrator", "/login", "/dashboard", "/wp-admin", "/phpmyadmin", "/server-status"]
OUTDATED = [(r"Apache/2\.2", "high"), (r"nginx/1\.(?:0|1[0-7])\b", "medium"), (r"PHP/5\.", "high"), (r"OpenSSL/1\.0\.", "medium"), (r"Microsoft-IIS/6\.", "high")]
LISTING = ["index of /", "directory listing for", "directory listing"]
# Library, introduced, below, severity, identifiers.
LIBRARY_RULES = [
    ("jquery", (0, 0, 0), (1, 9, 0), "high", ["CVE-2012-6708"]), ("jquery", (0, 0, 0), (3, 0, 0), "high", ["CVE-2015-9251"]), ("jquery", (0, 0, 0), (3, 4, 0), "high", ["CVE-2019-11358"]),
    ("jquery", (0, 0, 0), (3, 5, 0), "high", ["CVE-2020-11022", "CVE-2020-11023"]), ("bootstrap", (0, 0, 0), (3, 4, 1), "medium", ["CVE-2018-14041", "CVE-2019-8331"]),
    ("bootstrap", (4, 0, 0), (4, 1, 2), "medium", ["CVE-2018-14041"]), ("bootstrap", (4, 0, 0), (4, 3, 1), "medium", ["CVE-2019-8331"]), ("bootstrap", (4, 0, 0), (4, 6, 3), "medium", ["CVE-2024-6531"]),
]
LIBRARY = r"(jquery|bootstrap)[-@/]v?([0-9][0-9.]*[0-9]|[0-9])"
OBJECT_URL = r"(?:/(?:users?|accounts?|customers?|tenants?|organizations?|orgs?|projects?|orders?)/[0-9a-fA-F-]{6,}|[?&](?:user|account|customer|tenant|organization|project|order)[_-]?id=[0-9a-fA-F-]{6,})"


def missing_headers(responses: DataFrame) -> DataFrame:
    """responses (have: names of headers) once for each security header they lack: header, severity. A literal list, so no join."""
    need = F.array(*[F.struct(F.lit(h).alias("header"), F.lit(s).alias("severity")) for h, s in HEADERS.items()])
    have = F.transform("have", lambda h: F.lower(h))
    rest = [c for c in responses.columns if c != "have"]
    return responses.select(*rest, F.inline(F.filter(need, lambda r: ~F.array_contains(have, r["header"]))))


#: Characters of an exposed file that are looked at.
SAMPLE = 2048


def exposed_paths(fetched: DataFrame) -> DataFrame:
    """fetched (path, status, content_type, body) answered with the file itself, no HTML, and holding its mark in the first SAMPLE characters: severity. A missing content type is none of HTML."""
    hit, severity = F.lit(False), F.lit(None).cast("string")
    low = F.lower(F.left(F.coalesce("body", F.lit("")), F.lit(SAMPLE)))
    for path, level, mark in EXPOSED:
        own = (F.col("path") == path) & F.contains(low, F.lit(mark.lower()))
        hit, severity = hit | own, F.when(own, level).otherwise(severity)
    fine = F.col("status").isin(200, 206) & ~F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("text/html"))
    return fetched.where(fine & hit).withColumn("severity", severity)


def admin_endpoints(fetched: DataFrame) -> DataFrame:
    """fetched (path, status) that is an admin page, open or behind a login: severity."""
    f = fetched.where(F.col("path").isin(ADMIN) & F.col("status").isin(200, 204, 301, 302, 401, 403))
    return f.withColumn("severity", F.when(F.col("status").isin(200, 204), "medium").otherwise("low"))


def lists_directory(body: Column, content_type: Column) -> Column:
    """Whether an HTML answer's first 4,096 characters say that they list a folder."""
    html = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))
    return html & contains_any(F.lower(F.left(F.coalesce(body, F.lit("")), F.lit(4096))), LISTING)


def outdated(answers: DataFrame, text: str) -> DataFrame:
    """answers once for each outdated software that the text column names: pattern, severity."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("severity"))) for p, s in OUTDATED]))
    return answers.select(*answers.columns, F.inline(hits))


def expiring(certificates: DataFrame, now: str, days: int = 30) -> DataFrame:
    """certificates (not_after) that have ended or end within `days`: severity."""
    today = F.lit(now).cast("date")
    return certificates.where(F.datediff("not_after", today) < days).withColumn("severity", F.when(F.col("not_after") < today, "high").otherwise("medium"))


def libraries(scripts: DataFrame) -> DataFrame:
    """scripts (src) that name a library: name, version."""
    named = scripts.withColumns({"name": F.regexp_extract("src", LIBRARY, 1), "version": F.regexp_extract("src", LIBRARY, 2)})
    return named.where("name <> ''").drop("src")


def vulnerable(used: DataFrame) -> DataFrame:
    """name, version, cves, severe of libraries (name, version): a range join on versions; those in use are made distinct first."""
    once = used.select("name", "version").distinct().withColumn("v", urls.version(F.col("version"))).where("v is not null")
    schema = "name string, lo struct<major:int,minor:int,patch:int>, hi struct<major:int,minor:int,patch:int>, severity string, cves array<string>"
    table = F.broadcast(used.sparkSession.createDataFrame(LIBRARY_RULES, schema))
    met = (once["name"] == table["name"]) & (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi"))
    hit = once.join(table, met).select(once["name"], "version", "severity", F.explode("cves").alias("cve"))
    return hit.groupBy("name", "version").agg(F.sort_array(F.collect_set("cve")).alias("cves"), F.max(F.col("severity") == "high").alias("severe"))


def scoped_links(links: DataFrame, most: int = 20, seen: DataFrame | None = None, guarded: bool = True) -> DataFrame:
    """page, domain, url, place of links (page, domain, ord, link): the first `most` new pages of each page's links, in their order, from 1.

    In scope are explicit http(s) addresses of the page's registrable domain that lead to no internal host (if guarded).
    What `seen` (url) has, and a page's second link to an address, take no place.
    """
    new = links.where(crawl.in_scope(F.col("link"), F.col("domain"), guarded)).select("page", "domain", "ord", urls.crawl_key(F.col("link")).alias("url"))
    new = new.groupBy("page", "domain", "url").agg(F.min("ord").alias("ord"))
    new = new if seen is None else new.join(seen.select("url"), "url", "left_anti")
    place = F.row_number().over(Window.partitionBy("page").orderBy("ord"))
    return new.withColumn("place", place).where(F.col("place") <= most).select("page", "domain", "url", "place")


def object_urls(found: DataFrame) -> DataFrame:
    """Distinct http(s) addresses (url) that look like one object of many."""
    return found.select("url").where(F.col("url").rlike("^https?://[^/?#]") & F.col("url").rlike(OBJECT_URL)).distinct()


# Where a host's name may come from, best first.
PRIORITY = ["archive", "dns", "crawl"]


def best_origin(candidates: DataFrame) -> DataFrame:
    """host, origin of candidates (host, origin): the best origin of each host."""
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("origin"))
    return candidates.where("host is not null").groupBy("host").agg(F.min_by("origin", place).alias("origin"))


def first_hosts(candidates: DataFrame, most: int = 50) -> DataFrame:
    """host, origin, place of the first `most` hosts that resolve, from 1: by their best origin, then by name; candidates: host, origin, resolved.

    The limit is the feature; only that many rows are sorted together, each task's first ones.
    """
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("origin"))
    each = candidates.where("host is not null").groupBy("host").agg(F.min_by("origin", place).alias("origin"), F.max("resolved").alias("resolved")).where("resolved")
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("origin"))
    first = each.select("host", "origin", order.alias("o_")).orderBy("o_", "host").limit(most)
    return first.select("host", "origin", F.row_number().over(Window.orderBy("o_", "host")).alias("place"))


def page_links(pages: DataFrame) -> DataFrame:
    """The other columns of pages (html), kind (anchor, script) and link: addresses of anchors and of scripts that a page loads, in double or single quotes for scripts; a script without one is none."""
    rest = [c for c in pages.columns if c != "html"]
    one = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("link")))
    anchors = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\shref="([^"]*)"'), F.lit(1))
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<script\b[^>]*>"), F.lit(0))
    sources = F.filter(F.transform(tags, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r'(?i)\ssrc="([^"]*)"', 1), F.lit("")), F.regexp_extract(t, r"(?i)\ssrc='([^']*)'", 1))), lambda x: x != "")
    return pages.select(*rest, F.inline(F.concat(one("anchor", anchors), one("script", sources))))


def by_origin(candidates: DataFrame) -> DataFrame:
    """origin, candidates, hosts of candidates (host, origin)."""
    return candidates.groupBy("origin").agg(F.count("*").alias("candidates"), F.count_distinct("host").alias("hosts"))


def claim_flags(claims: Column, now: int) -> Column:
    """What a token's claims (JSON) give away: roles, admin flag, scopes, expiry. Scopes may be a text or a list, under either name; a zero expiry is none."""
    get = lambda k: F.get_json_object(claims, f"$.{k}")
    role, exp = F.coalesce(get("role"), F.lit("")), F.nullif(get("exp").try_cast("double").cast("long"), F.lit(0))
    flag = lambda k: F.coalesce(get(k) == "true", F.lit(False)) & ~claims.rlike(rf'"{k}"\s*:\s*"')
    empty = lambda c: F.when(c.isin("", "[]", "null", "false", "0"), F.lit(None)).otherwise(c)
    given = F.coalesce(empty(get("scope")), empty(get("scp")), F.lit(""))
    scopes = F.when(given.startswith("["), F.array_join(F.from_json(given, "array<string>"), " ")).otherwise(given)
    broad = F.filter(F.array(*map(F.lit, BROAD)), lambda w: F.contains(F.lower(scopes), w))
    return F.array_compact(
        F.array(
            F.when(role.contains("service_role"), "service_role").when(F.lower(role).rlike("admin|superuser|root"), "elevated"),
            F.when(flag("is_admin") | flag("admin"), "admin_flag"),
            F.when(F.size(broad) > 0, F.concat(F.lit("broad_scope: "), F.array_join(broad, ", "))),
            F.when(exp.isNull(), "no_expiry").when(exp < now, "expired").when(exp - now > 31536000, "long_lived"),
        )
    )


# Parts of scopes that allow much.
BROAD = ["admin", "write", "delete", "manage"]
