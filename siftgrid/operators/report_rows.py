"""Saved reports and loose findings to rows of one schema, with the defaults of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrid.functions import identity, rules

EVIDENCE = "struct<source:string,snippet:string,line:int,request_url:string,response_status:int,redacted_value:string>"
SAVED = (
    f"type string, severity string, confidence double, detector_id string, source string, evidence {EVIDENCE}, redacted_value string, risk_reason string, remediation string, "
    "category string, pack string, references array<string>, validation_status string, id string, fingerprint string"
)


def filled(value: Column, *others: Column | str) -> Column:
    """The first of the values that is neither null nor empty."""
    out = F.nullif(value, F.lit(""))
    for o in others:
        out = F.coalesce(out, F.nullif(F.lit(o) if isinstance(o, str) else o, F.lit("")))
    return F.coalesce(out, F.lit(""))


def severity(value: Column) -> Column:
    """In lower case; info for an unknown or missing one."""
    low = F.lower(F.coalesce(value, F.lit("info")))
    return F.when(low.isin(rules.SEVERITIES), low).otherwise("info")


def finding(f: Column) -> Column:
    """A saved finding (a struct of SAVED) with every default: empty texts count as missing."""
    e = f["evidence"]
    source = filled(e["source"], f["source"])
    evidence = F.struct(
        source.alias("source"), filled(e["snippet"]).alias("snippet"), e["line"].alias("line"), filled(e["request_url"]).alias("request_url"), e["response_status"].alias("response_status"), filled(e["redacted_value"], f["redacted_value"]).alias("redacted_value"),
    )
    return F.struct(
        filled(f["type"], "unknown").alias("type"), severity(f["severity"]).alias("severity"), F.coalesce(f["confidence"], F.lit(0.55)).alias("confidence"), filled(f["detector_id"], "runtime:unknown").alias("detector_id"), filled(f["source"], source, "unknown").alias("source"),
        evidence.alias("evidence"), filled(f["risk_reason"]).alias("risk_reason"), filled(f["remediation"]).alias("remediation"), filled(f["validation_status"], "lead").alias("validation_status"), filled(f["category"], f["pack"]).alias("category"),
        F.coalesce(f["references"], F.array().cast("array<string>")).alias("references"), filled(f["id"]).alias("id"), filled(f["fingerprint"]).alias("fingerprint"),
    )


def reports(saved: DataFrame, column: str = "json", now: str = "") -> DataFrame:
    """saved (JSON texts of reports) with target, scan_mode, generated_at, retest_command and place and f, one row a finding, in order; a report without findings has one row with null f.

    A missing generated_at is `now`. A text that is no JSON object is a report without anything.
    """
    r = F.from_json(F.col(column), f"target string, scan_mode string, generated_at string, retest_command string, findings array<struct<{SAVED.replace(' ', ':').replace(',:', ',')}>>")
    rest = [c for c in saved.columns if c != column]
    read = saved.withColumn("r_", r)
    head = read.select(
        *rest, filled(F.col("r_.target")).alias("target"), filled(F.col("r_.scan_mode"), "runtime").alias("scan_mode"), filled(F.col("r_.generated_at"), now).alias("generated_at"), filled(F.col("r_.retest_command")).alias("retest_command"),
        F.posexplode_outer(F.transform(F.col("r_.findings"), finding)).alias("place", "f"),
    )
    return head


def confidence(level: Column, source: Column) -> Column:
    return F.when(level.isin("critical", "high"), 0.9).when(level == "medium", 0.7).when(F.lower(source).isin("url", "request header", "response header"), 0.65).otherwise(0.55)


def normalized(loose: DataFrame, prefix: str = "runtime") -> DataFrame:
    """loose findings to one schema: type, severity, confidence, detector_id, source, redacted_value, snippet, request_url, category, validation_status replace type, severity, source, category, pack, value, match, context, details, detector_id, confidence, url, validation_status.

    Missing columns are null. A type without a name is unknown, a category missing from both columns is leak, or
    access-control for access_control_issue; values and addresses are redacted.
    """
    used = "type severity source category pack value match context_lines context details detector_id confidence url validation_status".split()
    get = lambda c: F.col(c) if c in loose.columns else F.lit(None).cast("double" if c == "confidence" else "string")
    rest = [c for c in loose.columns if c not in used]
    kind, level, source = filled(get("type"), "unknown"), severity(F.nullif(get("severity"), F.lit(""))), filled(get("source"), "unknown")
    category = filled(get("category"), get("pack"), F.when(kind == "access_control_issue", "access-control").otherwise("leak"))
    return loose.select(
        *rest, kind.alias("type"), level.alias("severity"), F.coalesce(get("confidence"), confidence(level, source)).alias("confidence"), filled(get("detector_id"), F.concat(F.lit(prefix + ":"), kind)).alias("detector_id"), source.alias("source"),
        identity.redact_mask(F.coalesce(get("value"), get("match"), F.lit(""))).alias("redacted_value"), filled(get("context_lines"), get("context"), get("details")).alias("snippet"), identity.redact_url(F.coalesce(get("url"), F.lit(""))).alias("request_url"), category.alias("category"),
        filled(get("validation_status"), "lead").alias("validation_status"),
    )


def remediation(description: Column, scenario: Column, advice: Column) -> Column:
    """struct<what_leaked, why_it_matters, fix_steps, verify_command>: the scenario, or the description without one; the advice by sentences, or whole where it has none."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    steps = F.filter(F.transform(F.split(F.coalesce(advice, F.lit("")), r"\. ", -1), plain), lambda s: s != "")
    whole = F.when((F.size(steps) == 0) & (F.coalesce(advice, F.lit("")) != ""), F.array(plain(advice))).otherwise(steps)
    why = F.when(F.coalesce(scenario, F.lit("")) != "", plain(scenario)).otherwise(plain(description))
    return F.struct(plain(description).alias("what_leaked"), why.alias("why_it_matters"), whole.alias("fix_steps"), F.lit("").alias("verify_command"))


def surface_findings(hosts: DataFrame) -> DataFrame:
    """Findings of hosts (host, url, findings: array of structs) as rows of `normalized`: what a finding lacks comes from its host.

    The source is `Attack Surface: host`, or the address, or attack-surface; the category access-control; the state lead.
    """
    name = filled(F.col("host"), F.col("url"), "attack-surface")
    rest = [c for c in hosts.columns if c not in ("host", "url", "findings")]
    each = hosts.select(*rest, name.alias("host_"), F.coalesce("url", F.lit("")).alias("url_"), F.explode("findings").alias("f"))
    fields = {f.name for f in hosts.schema["findings"].dataType.elementType}
    get = lambda c, other: F.coalesce(F.col(f"f.{c}"), other) if c in fields else other
    own = [F.col(f"f.{c}").alias(c) for c in sorted(fields - {"source", "url", "category", "validation_status"})]
    rows = each.select(
        *rest, *own, get("source", F.concat(F.lit("Attack Surface: "), "host_")).alias("source"), get("url", F.col("url_")).alias("url"), get("category", F.lit("access-control")).alias("category"), get("validation_status", F.lit("lead")).alias("validation_status")
    )
    return normalized(rows, "attack-surface")


def added_entries(base: DataFrame, head: DataFrame) -> DataFrame:
    """head's entries whose (id, detector, type, source_contains) base doesn't have; a missing field and an empty one are the same, rows of head stay as often as they are there."""
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"{c}_") for c in ("id", "detector", "type", "source_contains")]
    names = ["id_", "detector_", "type_", "source_contains_"]
    return head.select("*", *key).join(base.select(*key).distinct(), names, "left_anti").select(*head.columns)
