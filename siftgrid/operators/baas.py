"""Backend services that a page's scripts name, and what captured answers of them show.

Inputs are tables of scripts, requests and probe answers; nothing is requested here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrid.functions import rules, urls


def page_scripts(scripts: DataFrame) -> DataFrame:
    """page, script: all script texts of a page (page, ord, text) in order, joined by newlines."""
    ordered = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return scripts.groupBy("page").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("script"))


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The pattern's first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def names(text: Column, pattern: str) -> Column:
    """Distinct values of the pattern's first group, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def config(pages: DataFrame) -> DataFrame:
    """page, provider, project_url, api_key, tables, rpcs, buckets, channels of each page (page, script) that names a service.

    One service with both an address and a key comes first, then the others in a fixed order.
    A signed key counts only within 1,000 characters after the address.
    """
    t = F.col("script")
    address = first(t, rules.SUPABASE_URL)
    near = F.substring(t, F.instr(t, address), F.lit(1000))
    key = F.coalesce(first(t, rules.SUPABASE_PUBLIC_KEY), F.when(address.isNotNull(), first(near, rules.SUPABASE_JWT)))
    fire_key = F.coalesce(first(t, rules.FIREBASE_CONFIG, 1), first(t, rules.FIREBASE_KEY))
    fire_url = F.coalesce(first(t, rules.FIREBASE_CONFIG, 2), first(t, rules.FIREBASE_URL))
    bucket = F.when(t.rlike(rules.FIREBASE_CONFIG), first(t, rules.FIREBASE_CONFIG, 3)).otherwise(first(t, rules.FIREBASE_BUCKET))
    endpoint, pocket = first(t, rules.APPWRITE_ENDPOINT, 1), first(t, rules.POCKETBASE_URL, 1)
    none = F.array().cast("array<string>")

    def row(provider: str, url: Column, api_key: Column, tables: Column = none, rpcs: Column = none, buckets: Column = none) -> Column:
        return F.struct(F.lit(provider).alias("provider"), url.alias("project_url"), F.coalesce(api_key, F.lit("")).alias("api_key"), tables.alias("tables"), rpcs.alias("rpcs"), buckets.alias("buckets"))

    found = (
        F.when(address.isNotNull() & key.isNotNull(), row("supabase", address, key, names(t, rules.BAAS_TABLE), names(t, rules.BAAS_RPC), names(t, rules.BAAS_BUCKET)))
        .when(fire_url.isNotNull(), row("firebase", fire_url, fire_key, buckets=F.array_compact(F.array(bucket))))
        .when(endpoint.isNotNull(), row("appwrite", endpoint, first(t, rules.APPWRITE_PROJECT, 1)))
        .when(pocket.isNotNull(), row("pocketbase", pocket, F.lit("")))
    )
    return pages.select("page", found.alias("f"), names(t, rules.BAAS_CHANNEL).alias("channels")).where("f is not null").select("page", "f.*", "channels")


def classify_requests(requests: DataFrame) -> DataFrame:
    """Columns provider, kind, base_url, endpoint, api_key for requests (url, headers) to a known service; other requests go."""
    key = F.coalesce(F.get(F.filter(F.map_entries("headers"), lambda h: F.lower(h["key"]) == "apikey"), F.lit(0))["value"], F.lit(""))
    chosen = F.lit(None)
    for provider, kind, pattern, base, endpoint, keyed in reversed(rules.BAAS_REQUESTS):
        part = lambda x: F.regexp_extract("url", pattern, x) if isinstance(x, int) else F.lit(x)  # noqa: B023, E731
        one = F.struct(F.lit(provider).alias("provider"), F.lit(kind).alias("kind"), part(base).alias("base_url"), part(endpoint).alias("endpoint"), (key if keyed else F.lit("")).alias("api_key"))
        chosen = F.when(F.col("url").rlike(pattern), one).otherwise(chosen)
    return requests.withColumn("r", chosen).where("r is not null").select(*requests.columns, "r.*")


def table_severity(name: Column) -> Column:
    return F.when(F.lower(name).rlike(rules.SENSITIVE_TABLE), "critical").otherwise("high")


def body_rows(body: Column) -> Column:
    """Elements of a JSON array, null for any other body."""
    return F.json_array_length(F.when(F.ltrim(body).startswith("["), body))


def open_tables(probes: DataFrame, named: DataFrame, views: DataFrame) -> DataFrame:
    """probes (project, target, status, body) whose answer has rows: severity, confidence, validation_status, relation, n_rows.

    A table that the client's scripts (named: project, target) don't name is a lead, one step
    less severe. An empty array is a protected table. views (project, target) can't take row policies.
    """
    n = body_rows(F.col("body"))
    hit = probes.withColumn("n_rows", n).where((F.col("status") == 200) & (F.col("n_rows") >= 1))
    known = named.select("project", "target").distinct().withColumn("named", F.lit(True))
    shown = views.select("project", "target").distinct().withColumn("view", F.lit(True))
    both = hit.join(known, ["project", "target"], "left").join(shown, ["project", "target"], "left")
    base = table_severity(F.col("target"))
    lower = F.when(base == "critical", "high").otherwise("medium")
    is_named = F.coalesce("named", F.lit(False))
    return both.select(
        *probes.columns, "n_rows", F.when(is_named, base).otherwise(lower).alias("severity"), F.when(is_named, 0.95).otherwise(0.6).alias("confidence"),
        F.when(is_named, "confirmed").otherwise("lead").alias("validation_status"), F.when(F.coalesce("view", F.lit(False)), "view").otherwise("table").alias("relation"),
    )


def probe_order(named: DataFrame, enumerated: DataFrame, most: int = 50) -> DataFrame:
    """project, target, place: names of the client in order (project, ord, target), then those only the service lists; sensitive ones first, `most` a project."""
    mine = named.groupBy("project", "target").agg(F.min("ord").alias("ord"))
    only = enumerated.select("project", "target").distinct().join(mine, ["project", "target"], "left_anti")
    both = mine.select("project", "target", F.lit(0).alias("part"), "ord").unionByName(only.select("project", "target", F.lit(1).alias("part"), F.lit(0).cast("long").alias("ord")))
    order = Window.partitionBy("project").orderBy(table_severity(F.col("target")) != "critical", "part", "ord", "target")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("project", "target", "place")


def writable(writes: DataFrame, opened: DataFrame, most: int = 20) -> DataFrame:
    """project, target, http_status, severity: open tables that answered an insert with 400, 201 or 409; of a project the first `most` are asked."""
    asked = opened.groupBy("project", "target").agg(F.min("ord").alias("ord"))
    asked = asked.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy("ord", "target"))).where(F.col("k") <= most)
    taken = writes.where(F.col("status").isin(400, 201, 409)).join(asked.select("project", "target"), ["project", "target"], "left_semi")
    return taken.groupBy("project", "target").agg(F.min("status").alias("http_status")).withColumn("severity", F.lit("critical"))


def storage(listings: DataFrame, named: DataFrame, most: int = 10) -> DataFrame:
    """project, bucket, severity, confidence: public buckets of a project's listing (project, body), and named ones (project, ord, bucket, status) that list without being listed."""
    shape = "array<struct<name:string,id:string,public:boolean>>"
    listed = listings.select("project", F.posexplode(F.slice(F.from_json("body", shape), 1, most)).alias("k", "b"))
    listed = listed.select("project", F.coalesce(F.nullif("b.name", F.lit("")), F.col("b.id"), F.lit("")).alias("bucket"), F.coalesce("b.public", F.lit(False)).alias("public")).where("bucket <> ''")
    public = listed.where("public").select("project", "bucket").distinct()
    own = named.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy("ord"))).where((F.col("k") <= most) & (F.col("status") == 200))
    lists = own.select("project", "bucket").distinct().join(listed, ["project", "bucket"], "left_anti")
    level = lambda df, severity, sure: df.withColumn("severity", F.lit(severity)).withColumn("confidence", F.lit(sure))
    return level(public, "high", 0.95).unionByName(level(lists, "medium", 0.85))


def first_names(configs: DataFrame, column: str, name: str, most: int = 20) -> DataFrame:
    """page, ord, name: the first `most` entries of an array column of config(); the limit is the feature."""
    return configs.select("page", F.posexplode(F.slice(column, 1, most)).alias("ord", name))


def channels(configs: DataFrame, most: int = 20) -> DataFrame:
    """page, channel: channels among the first ones of a page whose names follow a user."""
    return first_names(configs, "channels", "channel", most).where(F.col("channel").rlike(rules.USER_CHANNEL)).select("page", "channel")


def auth_posture(projects: DataFrame, now: int) -> DataFrame:
    """project, type, severity, confidence of what the key, the settings and the headers of a project show.

    projects: project, api_key, key_status, cors, settings_status, settings (JSON). A project whose
    key isn't accepted has that one finding.
    """
    claims = urls.jwt_payload(F.col("api_key"))
    role, expires = F.get_json_object(claims, "$.role"), F.get_json_object(claims, "$.exp").cast("double")
    accepted = F.col("key_status") == 200
    one = lambda kind, severity, sure, when: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence")))
    found = F.array(
        one("baas_key_invalid", "info", 0.8, ~accepted),
        one("baas_cors_wildcard", "low", 0.8, accepted & (F.col("cors") == "*")),
        one("baas_service_role_exposed", "critical", 1.0, accepted & (role == "service_role")),
        one("baas_long_lived_key", "low", 0.8, accepted & (expires - now > 365 * 24 * 3600)),
        one("baas_no_email_confirmation", "medium", 0.85, accepted & (F.col("settings_status") == 200) & (F.get_json_object("settings", "$.mailer_autoconfirm") == "true")),
    )
    return projects.select("project", F.inline(F.array_compact(found)))


def other_providers(probes: DataFrame, most: int = 50) -> DataFrame:
    """project, provider, type, target, severity, confidence of probes (project, provider, kind, ord, target, status, body) of services without row policies.

    Database reads of one provider are open with any answer but null; storage, collections and
    records are open when answered, the first `most` of a project.
    """
    kept = probes.withColumn("k", F.row_number().over(Window.partitionBy("project", "provider", "kind").orderBy("ord"))).where((F.col("k") <= most) & (F.col("status") == 200))
    body = F.trim(F.coalesce("body", F.lit("null")))
    one = lambda kind, severity, sure: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"))
    p, k = F.col("provider"), F.col("kind")
    found = (
        F.when((p == "firebase") & (k == "database") & ~body.isin("null", '"null"'), one("baas_open_table", "critical", 0.95))
        .when((p == "firebase") & (k == "storage") & (F.col("k") <= 10), one("baas_open_storage", "high", 0.9))
        .when(p.isin("appwrite", "pocketbase") & (k == "collection") & (F.col("target") != ""), one("baas_open_table", "high", 0.9))
    )
    return kept.withColumn("f", found).where("f is not null").select("project", "provider", "target", "f.*")
