"""Packs, profiles and bundles of rules; rules for browsers, and what forbids a rule there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrid.functions import rules
from siftgrid.operators import rulebook

# Packs that need a repository, packs by profile and surface, and bundles with phases and whether they probe.
REPO_ONLY = ["correctness", "housekeeping"]
WIDE = ["leak", "appsec", "access-control", "baas"]
PROFILES = {
    "local": {"launch-gate": ["leak"], "local-dev": ["leak"], "bug-bounty": WIDE, "ci": WIDE, "full": rules.PACKS},
    "extension": {"launch-gate": WIDE, "local-dev": WIDE, "bug-bounty": WIDE, "ci": WIDE, "full": WIDE},
    "web": {"launch-gate": ["leak"], "local-dev": ["leak"], "bug-bounty": WIDE, "ci": WIDE, "full": WIDE},
}
RUNTIME = sorted(p for p in rules.PACKS if p not in REPO_ONLY)
BUNDLES = {
    "secrets": (["leak"], ["passive"], False),
    "quick": (["leak", "headers", "client"], ["passive", "crawl"], False),
    "baas": (["baas"], ["passive", "baas_probe"], True),
    "authz": (["access-control", "authn", "api", "baas"], ["passive", "authz_diff", "baas_probe"], True),
    "injection": (["injection", "api"], ["passive", "crawl", "forms", "fuzz"], True),
    "recon": (["recon", "leak", "headers"], ["passive", "subdomain", "crawl", "probe"], True),
    "deep": (RUNTIME, ["passive", "subdomain", "crawl", "probe", "forms", "fuzz", "authz_diff", "baas_probe", "mitm"], True),
}
# What Python's patterns have and JavaScript's don't, with the reason.
NOT_IN_BROWSERS = [
    (r"\(\?P[<=!]", "named/Python-style group syntax (?P<name>...) is Python-only"),
    (r"\(\?#", "Python inline comment groups (?#...) are not JS"),
    (r"\\A", "Python \\A start-of-string anchor is not JS"),
    (r"\\Z", "Python \\Z end-of-string anchor is not JS"),
    (r"\(\?\(", "Python conditional group (?(...)...) is not JS"),
    (r"\(\?[smix-]+\)", "Python inline flag groups (?s), (?i), (?m) are Python-only — use flags arg in JS instead"),
]
BROWSER_FLAGS = "gim"


def profile_table(spark) -> DataFrame:
    """surface, profile, place, pack."""
    return spark.createDataFrame([(s, p, k, pack) for s, by in PROFILES.items() for p, packs in by.items() for k, pack in enumerate(packs)], "surface string, profile string, place int, pack string")


def selected_packs(scans: DataFrame) -> DataFrame:
    """The scans' other columns with packs (array) or error: scans (packs array<string>, profile, surface).

    Packs that are asked for by name count, trimmed, in lower case, each once; without any, the profile's: an empty
    profile is launch-gate, and so is an unknown one, of the local surface. An unknown pack is an error, and so is a
    pack that needs a repository on the web or in a browser.
    """
    asked = F.array_distinct(F.filter(F.transform(F.coalesce("packs", F.array().cast("array<string>")), lambda p: F.lower(F.trim(p))), lambda p: p != ""))
    surface = F.when(F.col("surface").isin("extension", "web"), F.col("surface")).otherwise("local")
    profile = F.lower(F.trim(F.coalesce(F.nullif("profile", F.lit("")), F.lit("launch-gate"))))
    by_profile = F.lit(None).cast("array<string>")
    for s, profiles in PROFILES.items():
        for p, packs in profiles.items():
            by_profile = F.when((surface == s) & (profile == p), F.array(*map(F.lit, packs))).otherwise(by_profile)
    chosen = F.when(F.size(asked) > 0, asked).otherwise(F.coalesce(by_profile, F.array(*map(F.lit, PROFILES["local"]["launch-gate"]))))
    unknown = F.array_except("chosen_", F.array(*map(F.lit, rules.PACKS)))
    repo = F.filter("chosen_", lambda p: p.isin(REPO_ONLY))
    error = F.when(F.size(unknown) > 0, F.concat(F.lit("Unknown detector pack(s): "), F.array_join(unknown, ", "))).when(
        (surface != "local") & (F.size(repo) > 0), F.concat(F.lit("Repo-only detector pack(s): "), F.array_join(repo, ", "))
    )
    rest = [c for c in scans.columns if c not in ("packs", "profile", "surface")]
    out = scans.withColumn("chosen_", chosen).withColumn("error", error)
    return out.select(*rest, F.when(F.col("error").isNull(), F.col("chosen_")).alias("packs"), "error")


def bundle_packs(scans: DataFrame, book: DataFrame, column: str = "bundle") -> DataFrame:
    """The scans' columns with pack, runnable (the rule book has a rule of it), sends_requests and probing, a row each pack of the bundle; error for an unknown bundle."""
    spark = scans.sparkSession
    sends = lambda phases: any(p != "passive" for p in phases)
    table = spark.createDataFrame([(b, k, pack, sends(phases), probing) for b, (packs, phases, probing) in BUNDLES.items() for k, pack in enumerate(packs)], "b_ string, place int, pack string, sends_requests boolean, probing boolean")
    have = rulebook.completed(book).select("pack").distinct().withColumn("runnable", F.lit(True))
    known = table.join(have, "pack", "left").withColumn("runnable", F.coalesce("runnable", F.lit(False)))
    key = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    found = scans.withColumn("b_", key).join(F.broadcast(known), "b_", "left")
    return found.select(*scans.columns, "pack", "runnable", "sends_requests", "probing", F.when(F.col("pack").isNull(), F.concat(F.lit("Unknown scan bundle "), F.coalesce(F.col(column), F.lit("")))).alias("error"))


def browser_problem(pattern: Column) -> Column:
    """Why a pattern is none for browsers: the first reason, or null."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(NOT_IN_BROWSERS):
        out = F.when(pattern.rlike(test), F.lit(reason)).otherwise(out)
    return out


def exported(book: DataFrame, packs: list[str] | None = None) -> DataFrame:
    """What browsers get of a rule book, with the reason where a pattern may not go: id, detector_id, finding_type, pattern, flags, severity, pack, category, categories, min_match_length, capture_group, validation_status, references, problem.

    Without packs, those of the browser's launch gate. Entropy, aliases and the like stay out.
    """
    some = rulebook.chosen(book, packs or PROFILES["extension"]["launch-gate"])
    return some.select(
        "id", F.concat_ws(".", "pack", "id").alias("detector_id"), F.coalesce("finding_type", "id").alias("finding_type"), "pattern", F.lit(BROWSER_FLAGS).alias("flags"), "severity", "pack", F.col("pack").alias("category"), "categories",
        F.col("min_length").alias("min_match_length"), "capture_group", "validation_status", "references", browser_problem(F.col("pattern")).alias("problem"),
    )
