"""Relational work on findings: dedup, suppression, difference, summaries, chains.

A findings table has ord, type, severity, category, validation_status, source,
line, value, url. `ord` is the order of appearance; "first" always means it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrid.functions import identity, rules
from siftgrid.functions.identity import severity_rank
from siftgrid.functions.text import contains_any
from siftgrid.sources.scratch import Scratch


def rank() -> Column:
    return severity_rank(F.col("severity"))


def first_of(findings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order; an aggregation, so rows of a key combine on the map side."""
    rest = [c for c in findings.columns if c not in keys]
    ordered = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("f")).select(*keys, *[f"f.{c}" for c in rest])


def dedup_exact(findings: DataFrame) -> DataFrame:
    """First finding of each (type, source, redacted value, line)."""
    return first_of(findings.withColumn("redacted", identity.redact_mask(F.col("value"))), ["type", "source", "redacted", "line"], [F.col("ord")])


def dedup_best(findings: DataFrame) -> DataFrame:
    """One finding of each (value, source, line): two named types first, then the more severe, then the earlier."""
    first = F.when(F.col("type").isin("google_api_key", "oauth_token"), 1).otherwise(999)
    return first_of(findings, ["value", "source", "line"], [first, -rank(), F.col("ord")])


def cap_per_block(findings: DataFrame, block: str = "source", most: int = 50) -> DataFrame:
    """At most `most` findings a block after dedup by (type, value): the limit is the feature."""
    once = first_of(findings, [block, "type", "value"], [F.col("ord")])
    return once.withColumn("k", F.row_number().over(Window.partitionBy(block).orderBy("ord"))).where(F.col("k") <= most).drop("k")


#: So many parts of sources are tested as patterns; more are joined. So many rules are sent whole.
MOST_PARTS, CHUNK, SENT_RULES = 5000, 500, 500_000


def listed_parts(parts: DataFrame) -> list[str] | None:
    """The parts (part), if there are few enough to test them as patterns."""
    found = [r[0] for r in parts.select("part").distinct().limit(MOST_PARTS + 1).collect()]
    return sorted(found) if len(found) <= MOST_PARTS else None


def hidden_sources(findings: DataFrame, parts: DataFrame) -> DataFrame:
    """source, part: the distinct sources that hold one of the parts (part, lower-cased). Distinct sources meet the parts, not findings, and few parts meet them as one list, without a join."""
    sources = findings.select("source").distinct()
    known = listed_parts(parts)
    if known is None:
        return sources.join(parts, F.contains(F.lower("source"), F.col("part"))).select("source", "part")
    met = F.filter(F.array(*map(F.lit, known)).cast("array<string>"), lambda p: F.contains(F.lower("source"), p))
    return sources.select("source", F.explode(met).alias("part"))


def suppress(findings: DataFrame, suppressions: DataFrame, fixtures: list[str] | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Findings that no (kind, value) rule hits: by id, fingerprint, detector or an alias of it, type, signature, or part of the source in any case.

    aliases: (alias, detector). The rules are written once and counted; few enough are sent whole, so findings stay
    where they are, and parts of sources are a few patterns. More rules are joined by a shuffle. A null key is hit by no rule.
    """
    rules_ = suppressions
    if aliases is not None:
        old = suppressions.where("kind = 'detector'").join(aliases, F.col("value") == F.col("alias")).select("kind", F.col("detector").alias("value"))
        rules_ = rules_.unionByName(old)
    scratch = Scratch(findings.sparkSession)
    rules_ = scratch.keep(rules_.where(F.col("value") != "").select("kind", "value").distinct(), "rules")
    sizes = {r["kind"]: r["n"] for r in rules_.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    out = findings
    for kind in ("id", "fingerprint", "detector", "type", "signature"):
        if sizes.get(kind):
            rule = rules_.where(F.col("kind") == kind).select(F.col("value").alias(kind))
            out = out.join(F.broadcast(rule) if sizes[kind] <= SENT_RULES else rule, kind, "left_anti")
    parts = rules_.where(F.col("kind") == "source_contains").select(F.lower("value").alias("part")).distinct()
    known = listed_parts(parts) if sizes.get("source_contains") else []
    if known is None:
        out = out.join(hidden_sources(findings, parts).select("source").distinct(), "source", "left_anti")
        known = []
    known = sorted({*known, *(p.lower() for p in fixtures or ())})
    for i in range(0, len(known), CHUNK):
        out = out.where(~F.coalesce(contains_any(F.lower("source"), known[i : i + CHUNK]), F.lit(False)))
    return out.select(*findings.columns)


def self_shield(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings that an added allow-list entry (id, detector, type, source_contains) would hide, once an entry: entry columns and the finding's.

    An entry with a source part counts on matching paths alone; there it hides by any of its fields.
    """
    fields = ("id", "detector", "type")
    e = entries.select(*(F.coalesce(F.trim(c), F.lit("")).alias(f"entry_{c}") for c in fields), F.lower(F.coalesce(F.trim("source_contains"), F.lit(""))).alias("part")).distinct()
    own = findings.select("ord", *fields, "source")
    matched = [own.join(e.where(f"part = '' and entry_{c} <> ''"), F.col(c) == F.col(f"entry_{c}")) for c in fields]
    # On a path that holds the entry's part every finding is hidden by that part.
    where = hidden_sources(findings, e.where("part <> ''").select("part").distinct())
    by_part = own.join(where, "source").join(e.where("part <> ''"), "part")
    columns = ["ord", "id", "source", "entry_id", "entry_detector", "entry_type", "part"]
    return reduce(DataFrame.unionByName, [m.select(*columns) for m in (*matched, by_part)]).distinct().withColumn("severity", F.lit("critical"))


def difference(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Findings of `current` that share neither id nor non-empty fingerprint with `baseline`."""
    keys = baseline.select(F.explode(F.array("id", "fingerprint")).alias("key")).where("key <> ''").distinct()
    by_id = current.join(keys, current["id"] == keys["key"], "left_anti")
    return by_id.join(keys, by_id["fingerprint"] == keys["key"], "left_anti")


def merge_provenance(findings: DataFrame) -> DataFrame:
    """One finding of each (type, redacted value), the first, with the sorted distinct URLs of all."""
    marked = findings.withColumn("redacted", identity.redact_mask(F.col("value")))
    return marked.groupBy("type", "redacted").agg(
        F.min("ord").alias("ord"), F.min_by("severity", "ord").alias("severity"), F.sort_array(F.collect_set(F.when(F.col("url") != "", F.col("url")))).alias("urls")
    )


def severity_counts(*extra: Column) -> list[Column]:
    return [*extra, F.count("severity").alias("total"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in rules.SEVERITIES]]


def verdict(findings: DataFrame, *by: str) -> DataFrame:
    """Status and reason from severities, for all findings or by the given columns."""
    severe = F.col("severity").isin("critical", "high")
    counted = findings.groupBy(*by).agg(
        F.count(F.when(severe, 1)).alias("blocking"),
        F.count(F.when(severe & (F.col("validation_status") == "confirmed"), 1)).alias("confirmed"),
        F.count(F.when(F.col("severity") == "medium", 1)).alias("medium"),
    )
    b, c = F.col("blocking"), F.col("confirmed")
    split = (
        F.when((c > 0) & (b > c), F.concat(c, F.lit(rules.VERDICT["confirmed"] + ", "), b - c, F.lit(rules.VERDICT["static"])))
        .when(c > 0, F.concat(F.lit("all "), c, F.lit(rules.VERDICT["confirmed"])))
        .otherwise(rules.VERDICT["unverified"])
    )
    status = F.when(b > 0, "BLOCK_SHIP").when(F.col("medium") > 0, "REVIEW").otherwise("SAFE_TO_SHIP")
    reason = (
        F.when(b > 0, F.concat(b, F.lit(rules.VERDICT["block"]), split, F.lit(rules.VERDICT["fix"])))
        .when(F.col("medium") > 0, rules.VERDICT["review"])
        .otherwise(rules.VERDICT["safe"])
    )
    return counted.select(*by, status.alias("status"), reason.alias("reason"))


def chains(findings: DataFrame, table: list[tuple] = rules.CHAINS, most: int = 100) -> DataFrame:
    """Attack chains: id, rule, host, severity, confidence, members (the first finding of each leg).

    findings need a `host`, empty where there is none; a rule whose legs must share a host looks
    at each host, another one at all findings. table: rows of rules.CHAINS; the legs of a rule
    have no type in common. Severity is the highest of the rule and its members, high at most
    without a confirmed member. Of chains of a rule with equal members one stays; `most` are reported.
    """
    # Every type knows its legs, so one pass and one aggregation find the first finding of each.
    by_type: dict[str, list[Column]] = {}
    for rule, severity, legs, same_host in table:
        for leg, types in enumerate(legs):
            one = F.struct(F.lit(rule).alias("rule"), F.lit(rules.SEVERITIES.index(severity)).alias("top"), F.lit(len(legs)).alias("legs"), F.lit(leg).alias("leg"), F.lit(same_host).alias("same"))
            for kind in types:
                by_type.setdefault(kind, []).append(one)
    legs_of = F.lit(None).cast("array<struct<rule:string,top:int,legs:int,leg:int,same:boolean>>")
    for kind, ones in by_type.items():
        legs_of = F.when(F.col("type") == kind, F.array(*ones)).otherwise(legs_of)
    hits = findings.where(F.col("type").isin(list(by_type))).select(
        "ord", "id", "validation_status", rank().alias("rank"), F.col("host").alias("own_"), F.inline(legs_of)
    )
    hits = hits.withColumn("host", F.when(F.col("same"), F.col("own_")).otherwise("")).where("not same or own_ <> ''")
    first = F.min_by(F.struct("id", "validation_status", "rank"), "ord").alias("m")
    parts = hits.groupBy("rule", "top", "legs", "leg", "host").agg(first).select("rule", "top", "legs", "host", "m.*")
    met = parts.groupBy("rule", "host", "top", "legs").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("members"), F.max("rank").alias("rank"), F.max((F.col("validation_status") == "confirmed").cast("int")).alias("confirmed")
    )
    level = F.greatest("rank", "top")
    full = met.where("n = legs").withColumn("rank", F.when(F.col("confirmed") == 1, level).otherwise(F.least(level, F.lit(3))))
    once = full.groupBy("rule", "members").agg(F.min_by(F.struct("host", "rank", "confirmed"), "host").alias("c"))
    top = once.select("rule", "members", "c.*").orderBy(F.desc("rank"), F.desc(F.size("members")), "rule", "host").limit(most)
    key = F.concat("rule", F.lit("|"), F.array_join("members", "|"))
    return top.select(F.concat(F.lit("chain_"), identity.fnv_id(key)).alias("id"), "rule", "host", identity.severity_name(F.col("rank")).alias("severity"), F.when(F.col("confirmed") == 1, "confirmed").otherwise("lead").alias("confidence"), "members")
