"""Findings to reports and back: JSON, SARIF and text, digests and their chains, contacts and suppression files.

A report belongs to a `source`. Nothing gathers all findings of a source in one row:
long reports are rows of lines, and digests are taken over stretches first.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrid.functions import identity, rules
from siftgrid.operators.findings import rank, severity_counts, verdict
from siftgrid.sources.scratch import Scratch


def level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results, one a finding (ord, detector, severity, reason, source, line, id, fingerprint, category), and rules, one a detector (with type, remediation)."""
    results = findings.select(
        "ord", F.col("detector").alias("rule_id"), level(F.col("severity")).alias("level"), F.col("reason").alias("message"), F.col("source").alias("uri"), F.coalesce("line", F.lit(1)).alias("start_line"),
        F.col("id").alias("finding_id"), F.nullif("fingerprint", F.lit("")).alias("finding_fingerprint"), F.coalesce("category", F.lit("")).alias("category"),
    )
    first = F.min_by(F.struct("type", "reason", "remediation", F.coalesce("category", F.lit("")).alias("category")), "ord")
    rules_ = findings.groupBy(F.col("detector").alias("rule_id")).agg(first.alias("r"))
    return results, rules_.select("rule_id", F.col("r.type").alias("name"), F.col("r.reason").alias("description"), F.col("r.remediation").alias("help"), F.col("r.category").alias("category"))


SARIF = (
    "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,name:string,help:struct<text:string>>>>>,"
    "results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>,"
    "partialFingerprints:struct<findingId:string,findingFingerprint:string>,properties:struct<category:string>>>>>"
)


def from_sarif(files: DataFrame) -> DataFrame:
    """file, id, fingerprint, type, severity, detector, source, line, reason, remediation, category of files (file, text).

    A rule's name and help come from the file's own rules, the last of an id.
    """
    runs = files.select("file", F.explode(F.from_json("text", SARIF)["runs"]).alias("run"))
    listed = runs.select("file", F.posexplode("run.tool.driver.rules").alias("k", "rule")).where("rule.id <> ''").groupBy("file", F.col("rule.id").alias("detector")).agg(F.max_by("rule", "k").alias("rule"))
    results = runs.select("file", F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = results.select(
        "file", text(F.col("r.partialFingerprints.findingId")).alias("id"), text(F.col("r.partialFingerprints.findingFingerprint")).alias("fingerprint"), F.coalesce(F.nullif("r.ruleId", F.lit("")), F.lit("sarif:unknown")).alias("detector"),
        F.lower("r.level").alias("level"), text(place["artifactLocation"]["uri"]).alias("source"), place["region"]["startLine"].alias("line"), text(F.col("r.message.text")).alias("reason"), text(F.col("r.properties.category")).alias("category"),
    )
    severity = F.when(F.col("level") == "error", "high").when(F.col("level") == "warning", "medium").otherwise("low")
    joined = rows.join(listed, ["file", "detector"], "left").withColumn("severity", severity)
    return joined.select("file", "id", "fingerprint", F.coalesce(F.nullif("rule.name", F.lit("")), "detector").alias("type"), "severity", "detector", "source", "line", "reason", text(F.col("rule.help.text")).alias("remediation"), "category")


def summary(findings: DataFrame) -> DataFrame:
    """source, counts by severity, verdict and its reason."""
    counted = findings.groupBy("source").agg(*severity_counts())
    return counted.join(verdict(findings, "source"), "source")


def json_report(findings: DataFrame) -> DataFrame:
    """source, part, ord, json: a head (target without secrets, verdict, summary) and a line a finding, values masked."""
    s = summary(findings)
    head = F.to_json(F.struct(identity.redact_url(F.col("source")).alias("target"), F.struct(F.col("status"), F.col("reason")).alias("verdict"), F.struct("total", *rules.SEVERITIES).alias("summary")))
    lines = F.to_json(F.struct("ord", "type", "severity", "category", "validation_status", "line", identity.redact_mask(F.col("value")).alias("redacted")))
    first = s.select("source", F.lit("report").alias("part"), F.lit(-1).cast("long").alias("ord"), head.alias("json"))
    return first.unionByName(findings.select("source", F.lit("finding").alias("part"), "ord", lines.alias("json")))


def text_report(findings: DataFrame, most: int = 10) -> DataFrame:
    """source, text: counts, verdict, the first `most` findings by severity, and how many more there are; the limit is the feature."""
    order = Window.partitionBy("source").orderBy(rank().desc(), "ord")
    line = F.concat(F.lit("- "), F.upper("severity"), F.lit(" "), "type", F.lit(" at "), "source", F.lit(": "), identity.redact_mask(F.col("value")))
    top = findings.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("top"))
    s = summary(findings).join(top, "source")
    counts = F.concat_ws(", ", *[F.concat(F.col(x).cast("string"), F.lit(f" {x}")) for x in ("critical", "high", "medium", "low")])
    more = F.when(F.col("total") > most, F.concat(F.lit("... "), F.col("total") - most, F.lit(" more findings")))
    return s.select("source", F.concat_ws("\n", F.concat("status", F.lit(": "), counts), "reason", F.transform("top", lambda t: t["line"]), more).alias("text"))


def digests(findings: DataFrame, stretch: int = 1000) -> DataFrame:
    """source, digest, n: SHA-256 over a source's findings in order, by stretches of `stretch` numbers first."""
    text = F.concat_ws("|", F.lpad(F.col("ord").cast("string"), 12, "0"), "type", F.col("line").cast("string"), "value")
    parts = findings.groupBy("source", F.floor(F.col("ord") / stretch).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(text)), ","), 256).alias("d"), F.count("*").alias("n"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ",")
    return parts.groupBy("source").agg(F.sha2(joined, 256).alias("digest"), F.sum("n").alias("n"))


def seal(prev: Column, digest: Column, at: Column, signer: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, digest, at, signer), 256)


#: Children of a node, and numbers of findings in a leaf, of a digest tree.
FAN, LEAF = 16, 64


def leaf_digests(findings: DataFrame, leaf: int = LEAF) -> DataFrame:
    """source, level (0), node, digest, n: SHA-256 over each stretch of `leaf` numbers of a source's findings, in order."""
    text = F.concat_ws("|", F.lpad(F.col("ord").cast("string"), 12, "0"), "type", F.col("line").cast("string"), "value")
    return findings.groupBy("source", F.floor(F.col("ord") / leaf).alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(text)), ","), 256).alias("digest"), F.count("*").alias("n")).select("source", F.lit(0).alias("level"), "node", "digest", "n")


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The nodes one level up: a digest over the children's numbers and digests."""
    children = F.sort_array(F.collect_list(F.struct("node", "digest")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
    up = nodes.groupBy("source", "level", F.floor(F.col("node") / fan).alias("parent")).agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("n"))
    return up.select("source", (F.col("level") + 1).alias("level"), F.col("parent").alias("node"), "digest", "n")


def digest_tree(findings: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """source, level, node, digest, n of a tree over each source's findings (source, ord, type, line, value), written level by level; all sources have the same height.

    A leaf is a stretch of numbers, so a finding that is added, changed or gone changes its own leaf and the path above it alone.
    """
    scratch = Scratch(findings.sparkSession)
    level = scratch.keep(leaf_digests(findings, leaf), "tree/part=0")
    k = 0
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        k += 1
        level = scratch.keep(parents(level, fan), f"tree/part={k}")
    return findings.sparkSession.read.parquet(f"{scratch.root}/tree").drop("part")


def changed_leaves(before: DataFrame, after: DataFrame, fan: int = FAN) -> DataFrame:
    """source, node, change (new, gone, changed) of the leaves in which two digest trees differ, found from the top: only what stands below a difference is compared.

    Trees of different height are compared from the lower one's top.
    """
    top = min(t.agg(F.max("level")).first()[0] or 0 for t in (before, after))
    open_ = None
    for k in range(top, -1, -1):
        at = lambda t, name: t.where(F.col("level") == k).select("source", "node", F.col("digest").alias(name))  # noqa: B023, E731
        a, b = at(before, "was"), at(after, "now")
        if open_ is not None:
            under = lambda t: t.withColumn("up", F.floor(F.col("node") / fan)).join(open_, ["source", "up"], "left_semi").drop("up")  # noqa: B023, E731
            a, b = under(a), under(b)
        both = a.join(b, ["source", "node"], "full").where(~F.col("was").eqNullSafe(F.col("now")))
        if k:
            open_ = both.select("source", F.col("node").alias("up"))
    return both.select("source", "node", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed").alias("change"))


def checked(shown: DataFrame, tree: DataFrame, roots: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """source, node, intact: whether the findings shown, whole leaves of a source, are those that the root (source, digest) was made of.

    Only the shown findings are read: their digests take their place among the tree's nodes, level by level.
    """
    now = leaf_digests(shown, leaf).withColumn("leaf_", F.col("node"))
    for k in range(1, (tree.agg(F.max("level")).first()[0] or 0) + 1):
        own = now.withColumn("up", F.floor(F.col("node") / fan)).withColumnsRenamed({"node": "own_", "digest": "mine_"}).drop("n", "level")
        beside = tree.where(F.col("level") == k - 1).withColumn("up", F.floor(F.col("node") / fan)).select("source", "up", "node", "digest")
        others = F.collect_list(F.when(F.col("node") != F.col("own_"), F.struct("node", "digest")))
        children = F.sort_array(F.concat(others, F.array(F.struct(F.col("own_").alias("node"), F.col("mine_").alias("digest")))))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
        met = own.join(beside, ["source", "up"], "left").groupBy("source", "leaf_", "up", "own_", "mine_").agg(F.sha2(text, 256).alias("digest"))
        now = met.select("source", "leaf_", F.col("up").alias("node"), "digest", F.lit(0).alias("n"), F.lit(k).alias("level"))
    return now.join(roots.select("source", F.col("digest").alias("root_")), "source", "left").select("source", F.col("leaf_").alias("node"), F.coalesce(F.col("digest") == F.col("root_"), F.lit(False)).alias("intact"))


SEALED = "target string, at string, signer string, digest string, prev_hash string, self_hash string"


def envelopes(reports: DataFrame) -> DataFrame:
    """target, at, signer, digest, prev_hash, self_hash: each report (target, at, signer, digest) sealed over the one before it."""
    return appended(reports.sparkSession.createDataFrame([], SEALED), reports)


def appended(chain: DataFrame, reports: DataFrame) -> DataFrame:
    """The envelopes of later reports, to be added to a chain: each target goes on from its last hash, and what is sealed is not read but for that.

    A target's new reports are sealed in order of (at, signer, digest), a few hashes each, in time linear in their number.
    """
    last = chain.groupBy("target").agg(F.max_by("self_hash", "at").alias("last_"))
    rows = reports.select("target", "at", "signer", "digest").join(last, "target", "left").withColumn("last_", F.coalesce("last_", F.lit("")))

    def add(r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values(["at", "signer", "digest"])
        prev, before, own = r["last_"].iloc[0], [], []
        for at, signer, digest in zip(r["at"], r["signer"], r["digest"], strict=True):
            before.append(prev)
            prev = hashlib.sha256("|".join(x for x in (prev, digest, at, signer) if x is not None).encode()).hexdigest()
            own.append(prev)
        return r[["target", "at", "signer", "digest"]].assign(prev_hash=before, self_hash=own)

    return rows.groupBy("target").applyInPandas(add, SEALED)


def verified(chain: DataFrame, reports: DataFrame) -> DataFrame:
    """target, at, intact: whether an envelope's hash, its link to the one before and its digest (of reports: target, at, digest) hold; no walk along the chain."""
    before = F.coalesce(F.lag("self_hash").over(Window.partitionBy("target").orderBy("at")), F.lit(""))
    own = chain.withColumn("linked", F.col("prev_hash") == before)
    known = reports.select("target", "at", F.col("digest").alias("now"))
    fine = F.col("linked") & (F.col("self_hash") == seal(*map(F.col, ("prev_hash", "digest", "at", "signer")))) & F.coalesce(F.col("now") == F.col("digest"), F.lit(False))
    return own.join(known, ["target", "at"], "left").select("target", "at", fine.alias("intact"))


NO_CONTACT = "(no contact mapping; consult vendor documentation)"


def disclosures(findings: DataFrame, contacts: DataFrame) -> DataFrame:
    """ord, id, detector, severity, source, redacted, contact, form of findings; contacts: detector, contact, form."""
    both = findings.join(contacts, "detector", "left")
    return both.select("ord", "id", "detector", "severity", "source", identity.redact_mask(F.col("value")).alias("redacted"), F.coalesce("contact", F.lit(NO_CONTACT)).alias("contact"), "form")


KINDS = ["id", "fingerprint", "detector", "type", "signature", "source_contains"]
LINE_KEYS = {"id": "id", "detector": "detector", "type": "type", "source": "source_contains", "signature": "signature"}


def suppression_lines(files: DataFrame) -> DataFrame:
    """file, kind, value of files (file, text) of lines `key: value`; a bare value is an id, # begins a comment, an unknown key is an error."""
    line = files.select("file", F.explode(F.split("text", "\n")).alias("line")).select("file", F.trim("line").alias("line")).where("line <> '' and line not like '#%'")
    key = F.when(F.col("line").contains(":"), F.lower(F.trim(F.split("line", ":", 2)[0]))).otherwise("")
    kind = F.when(key == "", "id")
    for k, name in LINE_KEYS.items():
        kind = kind.when(key == k, name)
    value = F.when(key == "", F.col("line")).otherwise(F.trim(F.try_element_at(F.split("line", ":", 2), F.lit(2))))
    return line.select("file", kind.otherwise(F.raise_error(F.concat(F.lit("unknown key "), key))).alias("kind"), value.alias("value"))


LISTS = {"id": ["ids", "finding_ids"], "fingerprint": ["fingerprints"], "detector": ["detector_ids"], "type": ["types"], "signature": ["signatures"], "source_contains": ["source_contains", "sources"]}


def suppression_json(files: DataFrame) -> DataFrame:
    """file, kind, value of JSON files (file, text) with lists by kind; the first list of a kind that isn't empty counts."""
    shape = ", ".join(f"{k} array<string>" for ks in LISTS.values() for k in ks)
    j = F.from_json("text", shape)
    pick = lambda ks: F.coalesce(*[F.when(F.size(j[k]) > 0, j[k]) for k in ks], F.array().cast("array<string>"))
    tagged = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    rows = F.flatten(F.array(*[tagged(kind, pick(ks)) for kind, ks in LISTS.items()]))
    return files.select("file", F.inline(rows)).distinct()


def suppression_entries(entries: DataFrame, today: str) -> DataFrame:
    """kind, value of allow-list entries (id, fingerprint, detector, type, source_contains, signature, reason, owner, expires_at) that are in force.

    An expired entry goes. One without an expiry date, and one in force without a reason, an owner or
    anything that it hides, is an error.
    """
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = F.when(missing("expires_at"), "expires_at")
    late = F.col("expires_at") < today
    bad = bad.when(~late & missing("reason"), "reason").when(~late & missing("owner"), "owner").when(~late & missing("id") & missing("fingerprint") & missing("detector") & missing("type") & missing("source_contains"), "what it hides")
    checked = entries.withColumn("expires_at", F.when(bad.isNull(), F.col("expires_at")).otherwise(F.raise_error(F.concat(F.lit("allow-list entry without "), bad))))
    live = checked.where(F.col("expires_at") >= today)
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(k).alias("value")) for k in KINDS])
    return live.select(F.inline(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))).distinct()


# Counters of what was looked at, and what each covers.
SURFACES = {
    "requests": "headers and URLs", "bodies": "fetch/XHR bodies", "externalScripts": "external scripts", "sourceMaps": "source maps", "scripts": "inline scripts", "dataAttrs": "data attributes", "metaTags": "meta tags",
    "storage": "browser storage", "libraries": "JS library versions", "websockets": "WebSocket messages", "eventStreams": "EventSource/SSE messages", "devtoolsBodies": "DevTools network bodies",
}


def coverage(stats: DataFrame) -> DataFrame:
    """id, covered, level of stats (id, counts: map of counters): strong from four surfaces on, partial from one, else waiting."""
    covered = F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)) > 0, v) for k, v in SURFACES.items()]))
    n = F.size("covered")
    return stats.select("id", covered.alias("covered")).withColumn("level", F.when(n >= 4, "strong").when(n > 0, "partial").otherwise("waiting"))
