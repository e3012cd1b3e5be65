"""Queries on findings that Spark derives from documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftgrid.functions import identity, rules
from siftgrid.operators import detect, report_rows
from siftgrid.operators import findings as O
from siftgrid.plans.core_queries import SALT, hmac_sql, id_sql, listed, mask_sql
from siftgrid.plans.registry import query
from siftgrid.sources import tables as T

W = f"with {T.FINDINGS_SQL}"
RANK = T.SEVERITY_CASE
COUNTS = "count(severity) as total, " + ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in rules.SEVERITIES)
IDS = f"ids as (select *, concat(category, '.', type) as detector, {id_sql('type', 'source', 'line', 'url', 'value')} as id, concat(type, '|', source, '|', line, '|', url, '|', {mask_sql('value')}) as signature, 'fp1_' || left({hmac_sql(SALT, "concat('v1', chr(0), type, chr(0), source, chr(0), url, chr(0), value)")}, 24) as fingerprint from findings)"


def named(spark, sf_dir):
    """Findings with detector, id, signature and fingerprint."""
    f = T.findings(spark, sf_dir).withColumn("detector", F.concat_ws(".", "category", "type"))
    cols = lambda *c: [F.col(x) for x in c]
    return (
        f.withColumn("id", identity.stable_id(*cols("type", "source", "line", "url", "value")))
        .withColumn("signature", identity.signature(*cols("type", "source", "line", "url"), identity.redact_mask(F.col("value"))))
        .withColumn("fingerprint", identity.fingerprint(SALT, *cols("type", "source", "url", "value")))
    )


@query("dedup_exact", f"{W} select type, source, line, {mask_sql('value')} as redacted, min(ord) as ord from findings group by all")
def dedup_exact(spark, sf_dir):
    return O.dedup_exact(T.findings(spark, sf_dir)).select("type", "source", "line", "redacted", "ord")


@query("dedup_best", f"{W} select value, source, line, type, severity, ord from findings qualify row_number() over (partition by value, source, line order by case when type in ('google_api_key', 'oauth_token') then 1 else 999 end, {RANK} desc, ord) = 1")
def dedup_best(spark, sf_dir):
    return O.dedup_best(T.findings(spark, sf_dir)).select("value", "source", "line", "type", "severity", "ord")


@query("cap_per_block", f"{W}, once as (select source, type, value, min(ord) as ord from findings group by all) select * from once qualify row_number() over (partition by source order by ord) <= 50")
def cap_per_block(spark, sf_dir):
    return O.cap_per_block(T.findings(spark, sf_dir)).select("source", "type", "value", "ord")


@query("sort_severity", f"{W} select ord, type, severity, row_number() over (partition by source order by {RANK} desc, ord) as place from findings")
def sort_severity(spark, sf_dir):
    """Places by severity inside each source; a global sort is orderBy(rank desc, ord)."""
    w = Window.partitionBy("source").orderBy(O.rank().desc(), "ord")
    return T.findings(spark, sf_dir).select("ord", "type", "severity", F.row_number().over(w).cast("long").alias("place"))


@query("topk_findings", f"{W} select ord, type, severity, source from findings order by {RANK} desc, ord limit 10")
def topk_findings(spark, sf_dir):
    return T.findings(spark, sf_dir).orderBy(O.rank().desc(), "ord").limit(10).select("ord", "type", "severity", "source")


@query("severity_buckets", f"{W} select ord, severity, type from findings where severity in ('critical', 'high')")
def severity_buckets(spark, sf_dir):
    return T.findings(spark, sf_dir).where(F.col("severity").isin("critical", "high")).select("ord", "severity", "type")


@query("severity_filter", f"{W} select ord, severity from findings where severity in ('low', 'medium')")
def severity_filter(spark, sf_dir):
    return T.findings(spark, sf_dir).where(F.col("severity").isin("low", "medium")).select("ord", "severity")


@query("finding_lookup", f"{W}, {IDS} select id, ord, type, source from ids where id in (select id from ids where ord = 7)")
def finding_lookup(spark, sf_dir):
    f = named(spark, sf_dir)
    return f.join(f.where("ord = 7").select("id"), "id", "left_semi").select("id", "ord", "type", "source")


@query("fail_threshold", f"{W} select source, max({RANK}) >= 3 as failed from findings group by source")
def fail_threshold(spark, sf_dir):
    return T.findings(spark, sf_dir).groupBy("source").agg((F.max(O.rank()) >= 3).alias("failed"))


@query("severity_summary", f"{W} select {COUNTS} from findings")
def severity_summary(spark, sf_dir):
    return T.findings(spark, sf_dir).agg(*O.severity_counts())


@query(
    "attack_surface_summary",
    f"{W} select source, count(*) as total, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity not in ('critical', 'high', 'medium')) as low from findings group by source",
)
def attack_surface_summary(spark, sf_dir):
    """Anything but the three upper severities counts as low."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    s = F.col("severity")
    return T.findings(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), *[n(s == x, x) for x in ("critical", "high", "medium")], n(~s.isin("critical", "high", "medium"), "low"))


PACKS_SQL = "packs as (select unnest([" + ", ".join(f"'{p}'" for p in rules.PACKS) + "]) as category)"


@query("pack_summary", f"{W}, {PACKS_SQL} select category, {COUNTS} from packs left join findings using (category) group by category")
def pack_summary(spark, sf_dir):
    """Counts of every pack, zeros kept; the findings are summed before they meet the packs."""
    f = T.findings(spark, sf_dir).groupBy("category").agg(*O.severity_counts())
    packs = spark.createDataFrame([(p,) for p in rules.PACKS], "category string")
    return packs.join(f, "category", "left").fillna(0)


@query("active_packs", f"{W} select category, min(ord) as first_ord from findings group by category")
def active_packs(spark, sf_dir):
    return T.findings(spark, sf_dir).groupBy("category").agg(F.min("ord").alias("first_ord"))


VERDICT_SQL = """select source, case when b > 0 then 'BLOCK_SHIP' when m > 0 then 'REVIEW' else 'SAFE_TO_SHIP' end as status,
 case when b > 0 then concat(b, ' high/critical exposure(s); ', case when c > 0 and b > c then concat(c, ' confirmed by active probe, ', b - c, ' static detection(s) to verify') when c > 0 then concat('all ', c, ' confirmed by active probe') else 'static detections — verify before relying on them' end, '. Fix before release.')
 when m > 0 then 'Potential exposures or hardening issues need human review.' else 'No medium, high, or critical findings were detected in this scan.' end as reason from v"""


@query(
    "verdict",
    f"{W}, v as (select source, count(*) filter (where severity in ('critical', 'high')) as b, count(*) filter (where severity in ('critical', 'high') and validation_status = 'confirmed') as c, count(*) filter (where severity = 'medium') as m from findings group by source) {VERDICT_SQL}",
)
def verdict(spark, sf_dir):
    return O.verdict(T.findings(spark, sf_dir), "source")


# Rows of the lead matrix and their packs.
HEATMAP = {
    "sql_injection": "appsec", "xss": "appsec", "auth_bypass": "appsec", "idor": "access-control", "missing_tenant_check": "access-control", "secret_in_logs": "leak", "n_plus_one_query": "correctness",
    "regression": "correctness", "off_by_one": "correctness", "timezone_date_bug": "correctness", "env_config_bug": "correctness", "test_missing": "housekeeping", "dead_code": "housekeeping", "stale_doc": "housekeeping",
}


@query("heatmap_rows", f"{W}, h(type, pack) as (values {', '.join(f"('{k}', '{v}')" for k, v in HEATMAP.items())}) select h.type, pack, count(ord) as n from h left join findings f on f.type = h.type group by all")
def heatmap_rows(spark, sf_dir):
    n = T.findings(spark, sf_dir).where(F.col("type").isin(list(HEATMAP))).groupBy("type").agg(F.count("*").alias("n"))
    return spark.createDataFrame(list(HEATMAP.items()), "type string, pack string").join(n, "type", "left").fillna(0)


# --- suppression, difference, provenance, chains ---------------------------------------------------

@query("diff_reports", f"{W}, {IDS}, old as (select * from ids where ord % 2 = 0), k as (select id as key from old union select fingerprint from old) select ord, id, type from ids where ord % 2 = 1 and id not in (select key from k) and fingerprint not in (select key from k)")
def diff_reports(spark, sf_dir):
    f = named(spark, sf_dir)
    return O.difference(f.where("ord % 2 = 0"), f.where("ord % 2 = 1")).select("ord", "id", "type")


@query("merge_provenance", f"{W} select type, {mask_sql('value')} as redacted, min(ord) as ord, arg_min(severity, ord) as severity, coalesce(list_sort(list(distinct url) filter (where url <> '')), []) as urls from findings group by all")
def merge_provenance(spark, sf_dir):
    return O.merge_provenance(T.findings(spark, sf_dir))


#: Loose findings as scanners give them.
LOOSE = [
    '{"type":"aws_key","severity":"HIGH","source":"a.js","value":"AKIA{h}{n}","context":"c{n}","url":"http://x.example/?token=abc{h}&a=1"}', '{"severity":"Odd","pack":"baas"}', '{"type":"access_control_issue","details":"d{n}","match":"m{h}"}',
    '{"type":"t{n}","severity":"medium","confidence":0.25,"detector_id":"own:id","category":"recon","pack":"leak","validation_status":"confirmed"}', '{"type":"","severity":"low","source":"Request Header","value":"","context_lines":"3: x","context":"y"}', '{"severity":"critical","url":"not a url {n}"}',
]
LOOSE_SHAPE = "type string, severity string, source string, category string, pack string, value string, match string, context_lines string, context string, details string, detector_id string, confidence double, url string, validation_status string"
_l = lambda k: f"nullif(json_extract_string(j, '$.{k}'), '')"


@query(
    "normalize_finding",
    f"""with v as (select doc_id, {T.pick_sql(LOOSE, 'doc_id')} as j from documents), r as (select doc_id, j, coalesce({_l('type')}, 'unknown') as type, case when lower({_l('severity')}) in {listed(rules.SEVERITIES)} then lower({_l('severity')}) else 'info' end as severity, coalesce({_l('source')}, 'unknown') as source, coalesce(json_extract_string(j, '$.value'), json_extract_string(j, '$.match'), '') as value from v)
    select doc_id, type, severity, coalesce(json_extract_string(j, '$.confidence')::double, case when severity in ('critical', 'high') then 0.9 when severity = 'medium' then 0.7 when lower(source) in ('url', 'request header', 'response header') then 0.65 else 0.55 end) as confidence, coalesce({_l('detector_id')}, 'runtime:' || type) as detector_id, source, {mask_sql('value')} as redacted_value,
      coalesce({_l('context_lines')}, {_l('context')}, {_l('details')}, '') as snippet, coalesce({_l('category')}, {_l('pack')}, case when type = 'access_control_issue' then 'access-control' else 'leak' end) as category, coalesce({_l('validation_status')}, 'lead') as validation_status from r""",
)
def normalize_finding(spark, sf_dir):
    """Loose findings to one schema with all defaults."""
    loose = T.read(spark, sf_dir, "documents").select("doc_id", F.from_json(T.pick(LOOSE, F.col("doc_id")), LOOSE_SHAPE).alias("f")).select("doc_id", "f.*")
    return report_rows.normalized(loose).drop("request_url")


@query("severity_shift", f"{W} select ord, list_extract({rules.SEVERITIES}, greatest({RANK} - 1, 0) + 1) as lower, list_extract({rules.SEVERITIES}, least({RANK}, 3) + 1) as capped from findings")
def severity_shift(spark, sf_dir):
    return T.findings(spark, sf_dir).select("ord", identity.severity_name(F.greatest(O.rank() - 1, F.lit(0))).alias("lower"), identity.severity_name(F.least(O.rank(), F.lit(3))).alias("capped"))


ADVICE = ["Rotate the key. Remove it from history. Check usage", "Enable row policies.  Test them. ", "Review", "", ". . ", "One step.No blank. Two"]
SCENARIOS = ["", "Anyone can read it. ", " A stolen key works."]


@query(
    "remediation_card",
    f"""with a as (select doc_id, {T.pick_sql(ADVICE, 'doc_id')} as advice, {T.pick_sql(SCENARIOS, '(doc_id // 6)')} as scenario, ' Key ' || doc_id || ' exposed. ' as description from documents), s as (select *, list_filter(list_transform(string_split(advice, '. '), lambda x: trim(x)), lambda x: x <> '') as steps from a)
    select doc_id, trim(description) as what_leaked, trim(case when scenario <> '' then scenario else description end) as why_it_matters, case when len(steps) = 0 and advice <> '' then [trim(advice)] else steps end as fix_steps, '' as verify_command from s""",
)
def remediation_card(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").select("doc_id", T.pick(ADVICE, F.col("doc_id")).alias("advice"), T.pick(SCENARIOS, F.floor(F.col("doc_id") / 6)).alias("scenario"), F.concat(F.lit(" Key "), F.col("doc_id").cast("string"), F.lit(" exposed. ")).alias("description"))
    return d.select("doc_id", report_rows.remediation(F.col("description"), F.col("scenario"), F.col("advice")).alias("r")).select("doc_id", "r.*")


#: Saved reports: whole, with fields missing at every level, empty, and no JSON.
REPORTS = [
    '{"target":"t{n}","scan_mode":"local","generated_at":"2024-01-02","findings":[{"type":"k","severity":"HIGH","confidence":0.8,"detector_id":"leak.k","source":"a.js","evidence":{"source":"b.js","snippet":"s","line":4,"redacted_value":"r{n}"},"id":"i{n}","category":"leak","references":["x"]},{"severity":"strange","redacted_value":"old","pack":"baas"}]}',
    '{"target":"","findings":[{"type":"","evidence":{"source":"only{n}"},"confidence":0,"validation_status":"confirmed"}],"extra":1}', '{"scan_mode":"web","findings":[]}', '{}', "no json {n}", '{"findings":[{"source":"x{n}","evidence":{"redacted_value":"new"},"redacted_value":"old"}]}',
]
_r = lambda k: f"nullif(json_extract_string(j, '$.{k}'), '')"
_f = lambda k: f"nullif(json_extract_string(f, '$.{k}'), '')"


@query(
    "src_report_json",
    f"""with v as (select doc_id, {T.pick_sql(REPORTS, 'doc_id')} as t from documents), p as (select doc_id, case when json_valid(t) then t else '{{}}' end as j from v), c as (select doc_id, j, coalesce(json_array_length(j, '$.findings'), 0)::bigint as n from p),
    e as (select doc_id, j, unnest(case when n > 0 then range(n) else [null::bigint] end) as place from c), r as (select doc_id, j, place, case when place is not null then json_extract(j, '$.findings[' || place || ']')::varchar end as f from e)
    select doc_id, coalesce({_r('target')}, '') as target, coalesce({_r('scan_mode')}, 'runtime') as scan_mode, coalesce({_r('generated_at')}, 'now') as generated_at, place::int as place, case when f is not null then coalesce({_f('type')}, 'unknown') end as type,
      case when f is null then null when lower({_f('severity')}) in {listed(rules.SEVERITIES)} then lower({_f('severity')}) else 'info' end as severity, case when f is not null then coalesce({_f('confidence')}::double, 0.55) end as confidence, case when f is not null then coalesce({_f('detector_id')}, 'runtime:unknown') end as detector_id,
      case when f is not null then coalesce({_f('source')}, {_f('evidence.source')}, 'unknown') end as source, case when f is not null then coalesce({_f('evidence.source')}, {_f('source')}, '') end as evidence_source, case when f is not null then coalesce({_f('evidence.redacted_value')}, {_f('redacted_value')}, '') end as redacted_value, {_f('evidence.line')}::int as line,
      case when f is not null then coalesce({_f('category')}, {_f('pack')}, '') end as category, case when f is not null then coalesce({_f('validation_status')}, 'lead') end as validation_status, case when f is not null then coalesce({_f('id')}, '') end as id from r""",
)
def src_report_json(spark, sf_dir):
    """Saved reports read back with every default of the report, its findings and their evidence."""
    saved = T.read(spark, sf_dir, "documents").select("doc_id", T.pick(REPORTS, F.col("doc_id")).alias("json"))
    return report_rows.reports(saved, now="now").select("doc_id", "target", "scan_mode", "generated_at", "place", "f.type", "f.severity", "f.confidence", "f.detector_id", "f.source", F.col("f.evidence.source").alias("evidence_source"), "f.evidence.redacted_value", "f.evidence.line", "f.category", "f.validation_status", "f.id")


@query("union_surfaces", "select 'document' as surface, count(*) as n from documents union all select 'conversation', count(*) from conversations union all select 'page', count(*) from pages")
def union_surfaces(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").select(F.lit("document").alias("surface"), F.col("text").alias("content"))
    c = T.read(spark, sf_dir, "conversations").select(F.lit("conversation").alias("surface"), F.col("text").alias("content"))
    p = T.read(spark, sf_dir, "pages").select(F.lit("page").alias("surface"), F.col("html").alias("content"))
    return d.unionByName(c).unionByName(p).groupBy("surface").agg(F.count("*").alias("n"))


@query("merge_rules", f"{W}, i as (select distinct type as name, 'imported' as origin from findings), c as (select distinct type as name, 'custom' as origin from findings where severity = 'medium') select name, origin from i where name not in (select name from c) union all select * from c")
def merge_rules(spark, sf_dir):
    """Imported rules, overridden by custom ones of the same name."""
    f = T.findings(spark, sf_dir)
    rows = lambda d, o: d.select(F.col("type").alias("name"), F.lit(o).alias("origin")).distinct()
    imported, custom = rows(f, "imported"), rows(f.where("severity = 'medium'"), "custom")
    return imported.join(custom.select("name"), "name", "left_anti").unionByName(custom)


@query("enumerated_only", f"{W} select distinct value from findings where ord % 3 = 0 except select value from findings where ord % 90 < 30")
def enumerated_only(spark, sf_dir):
    f = T.findings(spark, sf_dir)
    return f.where("ord % 3 = 0").select("value").subtract(f.where("ord % 90 < 30").select("value"))


@query("changed_snapshot", "with a as (select doc_id as path, n_chars as mtime from documents where doc_id % 5 <> 0), b as (select doc_id as path, n_chars + case when doc_id % 7 = 0 then 1 else 0 end as mtime from documents where doc_id % 3 <> 0) select coalesce(a.path, b.path) as path, case when a.path is null then 'new' when b.path is null then 'deleted' else 'modified' end as change from a full join b on a.path = b.path where a.mtime is distinct from b.mtime")
def changed_snapshot(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    a = d.where("doc_id % 5 <> 0").select("doc_id", F.col("n_chars").alias("before"), F.lit(True).alias("had"))
    b = d.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("after"), F.lit(True).alias("has"))
    both = a.join(b, "doc_id", "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(F.col("doc_id").alias("path"), F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "deleted").otherwise("modified").alias("change"))


_entry = "select {0} as id, case when ord % 4 = 1 then '' else type end as detector, nullif(type, 'xss') as type, nullif(source, 'Dockerfile') as source_contains, ord from findings where ord % 2 = {1}"


@query("added_allowlist_entries", f"{W}, h as ({_entry.format("case when ord % 6 = 1 then 'id' || (ord % 50) end", 1)}), b as ({_entry.format("case when ord % 6 = 4 then 'id' || (ord % 50) else '' end", 0)}) select h.* from h where (coalesce(h.id, ''), coalesce(h.detector, ''), coalesce(h.type, ''), coalesce(h.source_contains, '')) not in (select (coalesce(id, ''), coalesce(detector, ''), coalesce(type, ''), coalesce(source_contains, '')) from b)")
def added_allowlist_entries(spark, sf_dir):
    """Entries of the later list that the earlier one hasn't, by id, detector, type and scope."""
    f, n = T.findings(spark, sf_dir), F.col("ord")
    entry = lambda side, name: f.where(n % 2 == side).select(name.alias("id"), F.when(n % 4 == 1, "").otherwise(F.col("type")).alias("detector"), F.nullif("type", F.lit("xss")).alias("type"), F.nullif("source", F.lit("Dockerfile")).alias("source_contains"), "ord")
    numbered = F.concat(F.lit("id"), (n % 50).cast("string"))
    return report_rows.added_entries(entry(0, F.when(n % 6 == 4, numbered).otherwise("")), entry(1, F.when(n % 6 == 1, numbered)))


@query("allowlist_expiry", "with a as (select doc_id, strftime(date '2024-01-01' + (doc_id % 400)::int, '%Y-%m-%d') as expires_at from documents) select doc_id, expires_at from a where expires_at < '2024-07-01'")
def allowlist_expiry(spark, sf_dir, today: str = "2024-07-01"):
    d = T.read(spark, sf_dir, "documents").select("doc_id", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int")), "yyyy-MM-dd").alias("expires_at"))
    return d.where(F.col("expires_at") < today)
