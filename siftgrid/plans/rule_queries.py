"""Queries that choose, search and explain rules for rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgrid.functions import rules
from siftgrid.operators import packs, rulebook
from siftgrid.plans.core_queries import listed, rlike
from siftgrid.plans.registry import query
from siftgrid.plans.web_queries import doc_values, values_sql
from siftgrid.sources import tables as T
from siftgrid.sources.tables import sql_text
from siftgrid.streaming import watch

#: What scans ask for: packs, profile, surface.
ASKED = ["|ci|local", "|full|web", "|FULL |local", "||extension", "|nothing|local", "Leak, baas,leak|ci|local", "leak,dead-pack|ci|web", "correctness,leak|ci|web", "correctness|ci|local", "housekeeping|x|extension", "|launch-gate|web", " ,|local-dev|extension"]
_asked = "list_distinct(list_filter(list_transform(string_split(split_part(value, '|', 1), ','), lambda p: lower(trim(p))), lambda p: p <> ''))"
PROFILE_SQL = "p(surface, profile, packs) as (values " + ", ".join(f"('{s}', '{p}', {packs_})" for s, by in packs.PROFILES.items() for p, packs_ in by.items()) + ")"


@query(
    "select_packs",
    f"""with {values_sql(ASKED)}, {PROFILE_SQL}, a as (select doc_id, value, {_asked} as asked, split_part(value, '|', 3) as surface, lower(trim(coalesce(nullif(split_part(value, '|', 2), ''), 'launch-gate'))) as profile from v),
    c as (select a.doc_id, a.surface, case when len(asked) > 0 then list_transform(list_filter(list_transform(string_split(split_part(value, '|', 1), ','), lambda p: lower(trim(p))), lambda p: p <> ''), lambda p: p) else coalesce(p.packs, ['leak']) end as chosen from a left join p on p.surface = a.surface and p.profile = a.profile),
    o as (select doc_id, surface, chosen, unnest(chosen) as pack, generate_subscripts(chosen, 1) as k from c), d as (select doc_id, any_value(surface) as surface, pack, min(k) as k from o group by doc_id, pack), l as (select doc_id, any_value(surface) as surface, string_agg(pack, ',' order by k) as packs, string_agg(pack, ', ' order by k) filter (where pack not in {listed(rules.PACKS)}) as unknown, string_agg(pack, ', ' order by k) filter (where pack in ('correctness', 'housekeeping')) as repo from d group by doc_id)
    select doc_id, case when unknown is null and (surface = 'local' or repo is null) then packs end as packs, case when unknown is not null then 'Unknown detector pack(s): ' || unknown when surface <> 'local' and repo is not null then 'Repo-only detector pack(s): ' || repo end as error from l""",
)
def select_packs(spark, sf_dir):
    """Packs of each scan by what it asks for, its profile and its surface, or what is wrong with it."""
    part = lambda i: F.split_part("value", F.lit("|"), F.lit(i))
    scans = doc_values(spark, sf_dir, ASKED).select("doc_id", F.split(part(1), ",").alias("packs"), part(2).alias("profile"), part(3).alias("surface"))
    return packs.selected_packs(scans).select("doc_id", F.array_join("packs", ",").alias("packs"), "error")


NAMES = [*packs.BUNDLES, " Deep ", "everything", ""]
BUNDLE_SQL = "b(name, pack, sends_requests, probing) as (values " + ", ".join(f"('{b}', '{p}', {str(phases != ['passive']).lower()}, {str(probing).lower()})" for b, (ps, phases, probing) in packs.BUNDLES.items() for p in ps) + ")"
RUNNABLE = sorted({d[1] for d in rules.DETECTORS})


@query("select_bundle", f"with {values_sql(NAMES, 'bundle')}, {BUNDLE_SQL} select doc_id, bundle, pack, case when pack is not null then pack in {listed(RUNNABLE)} end as runnable, sends_requests, probing, case when pack is null then 'Unknown scan bundle ' || bundle end as error from v left join b on b.name = lower(trim(bundle))")
def select_bundle(spark, sf_dir):
    return packs.bundle_packs(doc_values(spark, sf_dir, NAMES, "bundle"), rulebook.shipped(spark))


RULES_SQL = "r(id, pack, severity, status, least, pattern) as (values " + ", ".join(f"('{d[0]}', '{d[1]}', '{d[2]}', '{d[3]}', {d[4]}, {sql_text(d[6])})" for d in rules.DETECTORS) + ")"


@query(
    "rule_export",
    f"""with {T.FINDINGS_SQL}, n as (select type as id, count(*) as findings from findings group by type), {RULES_SQL} select r.id, pack || '.' || r.id as detector_id, r.id as finding_type, pattern, 'gim' as flags, r.severity, pack, least as min_match_length, status as validation_status,
    case {' '.join(f"when {rlike('pattern', test)} then {sql_text(why)}" for test, why in packs.NOT_IN_BROWSERS)} end as problem, coalesce(findings, 0) as findings from r left join n using (id) where pack in {listed(packs.WIDE)}""",
)
def rule_export(spark, sf_dir):
    """What browsers get of the shipped rules, with how often each was found."""
    n = T.findings(spark, sf_dir).groupBy(F.col("type").alias("id")).agg(F.count("*").alias("findings"))
    out = packs.exported(rulebook.shipped(spark)).join(n, "id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return out.select("id", "detector_id", "finding_type", "pattern", "flags", "severity", "pack", "min_match_length", "validation_status", "problem", "findings")


LINTED = [r"(?P<name>x{n})", r"(?P=name)", r"(?#remark)a", r"\Astart", r"end\Z", r"(a)?(?(1)b|c)", r"(?i)x{n}", r"(?s-i)x", r"plain{n}", r"(?:a|b)(?=c)(?<!d)", r"(?i:x)y", r"\\A"]


@query("rule_lint", f"with {values_sql(LINTED)} select doc_id, value, case {' '.join(f'when {rlike("value", test)} then {sql_text(why)}' for test, why in packs.NOT_IN_BROWSERS)} end as problem from v")
def rule_lint(spark, sf_dir):
    return doc_values(spark, sf_dir, LINTED).withColumn("problem", packs.browser_problem(F.col("value")))


WATCHED = rules.APP_PATTERNS["slack_webhook"]


@query(
    "stream_file_watch",
    f"with {T.PLANTED_SQL}, l as (select source, arg_max(content, doc_id) as content, arg_max(doc_id % 11 = 0, doc_id) as deleted from planted group by source) select source as path, unnest(regexp_extract_all(content, {sql_text('(?i)' + WATCHED)})) as value from l where not deleted",
)
def stream_file_watch(spark, sf_dir):
    """Batch form of streaming.watch.follow: findings of the last version of each path; every eleventh row is a deletion."""
    files = T.planted(spark, sf_dir).select(F.col("source").alias("path"), F.col("doc_id").alias("version"), (F.pmod("doc_id", F.lit(11)) == 0).alias("deleted"), "content")
    return watch.standing_in(files, {"slack_webhook": WATCHED}, None).select("path", "value")
