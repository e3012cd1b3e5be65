"""Queries of suppression, chains and reports over findings that Spark derives from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgrid.functions import rules
from siftgrid.operators import findings as O
from siftgrid.operators import reports
from siftgrid.plans.core_queries import listed, mask_sql, rlike
from siftgrid.plans.finding_queries import COUNTS, IDS, RANK, VERDICT_SQL, W, named
from siftgrid.plans.registry import query
from siftgrid.plans.web_queries import doc_values, values_sql
from siftgrid.sources import tables as T
from siftgrid.sources.tables import pick, pick_sql, sql_text

SUPPRESS_SQL = "s as (select 'id' as kind, id as value from ids where ord % 50 = 1 union all select 'fingerprint', fingerprint from ids where ord % 45 = 2 union all select 'detector', 'appsec.xss' union all select 'detector', 'old.dead' union all select 'type', 'private_ip' union all select 'signature', signature from ids where ord % 40 = 3 union all select 'source_contains', 'BUNDLE1')"
_hits = " and ".join(f"{k} not in (select value from s where kind = '{k}')" for k in ("id", "fingerprint", "type", "signature"))
_fixtures = "|".join(p.lower().replace(".", "\\.") for p in rules.FIXTURE_PARTS)


@query(
    "suppress_findings",
    f"{W}, {IDS}, {SUPPRESS_SQL} select ord, id, type, source from ids where {_hits} and detector not in (select value from s where kind = 'detector') and detector <> 'housekeeping.dead_code' and not contains(lower(source), 'bundle1') and not {rlike('lower(source)', _fixtures)}",
)
def suppress_findings(spark, sf_dir):
    f = named(spark, sf_dir)
    kind = lambda k, c: f.where(c).select(F.lit(k).alias("kind"), F.col(k).alias("value"))
    fixed = spark.createDataFrame([("detector", "appsec.xss"), ("detector", "old.dead"), ("type", "private_ip"), ("source_contains", "BUNDLE1")], "kind string, value string")
    rows = kind("id", "ord % 50 = 1").unionByName(kind("fingerprint", "ord % 45 = 2")).unionByName(kind("signature", "ord % 40 = 3")).unionByName(fixed)
    aliases = spark.createDataFrame([("old.dead", "housekeeping.dead_code")], "alias string, detector string")
    return O.suppress(f, rows, rules.FIXTURE_PARTS, aliases).select("ord", "id", "type", "source")


ENTRIES_SQL = "e as (select distinct case when ord % 33 = 0 then id else '' end as entry_id, case when ord % 33 = 11 then detector else '' end as entry_detector, case when ord % 33 = 22 then type else '' end as entry_type, case when ord % 66 = 0 then lower(source) else '' end as part from ids where ord % 11 = 0)"


@query(
    "self_shield",
    f"{W}, {IDS}, {ENTRIES_SQL} select ord, f.id, f.source, entry_id, entry_detector, entry_type, part, 'critical' as severity from ids f join e on case when part <> '' then contains(lower(f.source), part) else (entry_id <> '' and f.id = entry_id) or (entry_detector <> '' and f.detector = entry_detector) or (entry_type <> '' and f.type = entry_type) end",
)
def self_shield(spark, sf_dir):
    """Findings that newly added allow-list entries would hide."""
    f = named(spark, sf_dir)
    n = F.col("ord") % 33
    e = f.where("ord % 11 = 0").select(F.when(n == 0, F.col("id")).alias("id"), F.when(n == 11, F.col("detector")).alias("detector"), F.when(n == 22, F.col("type")).alias("type"), F.when(F.col("ord") % 66 == 0, F.col("source")).alias("source_contains"))
    return O.self_shield(f, e)


HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


def _legs_sql() -> str:
    out = []
    for rule, severity, legs, same in rules.CHAINS:
        for types in legs:
            host, where = ("host", "and host <> ''") if same else ("''", "")
            out.append(f"select '{rule}' as rule, {rules.SEVERITIES.index(severity)} as top, {len(legs)} as legs, {host} as host, arg_min(id, ord) as id, arg_min(validation_status, ord) as st, arg_min({RANK}, ord) as rk from hosted where type in {listed(types)} {where} group by {host}")
    return " union all ".join(out)


@query(
    "chain_correlation",
    f"""{W}, {IDS}, hosted as (select *, {HOST} as host from ids), legs as ({_legs_sql()}), c as (select rule, host, list_sort(list(id)) as members, greatest(max(rk), any_value(top)) as lv, bool_or(st = 'confirmed') as ok from legs group by rule, host, top, legs having count(*) = any_value(legs)),
    o as (select * from c qualify row_number() over (partition by rule, members order by host) = 1) select rule, host, list_extract({rules.SEVERITIES}, (case when ok then lv else least(lv, 3) end)::int + 1) as severity, case when ok then 'confirmed' else 'lead' end as confidence, members from o order by case when ok then lv else least(lv, 3) end desc, len(members) desc, rule, host limit 100""",
)
def chain_correlation(spark, sf_dir):
    """Their ids are tested against plain code: SQL lacks the hash."""
    return O.chains(named(spark, sf_dir).withColumn("host", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)))).drop("id")


CONTACTS = [("leak.openai_api_key", "security@ai.example", "https://ai.example/report"), ("baas.supabase_url", "security@baas.example", None)]


@query(
    "vendor_contacts",
    f"{W}, {IDS} select ord, id, detector, severity, source, {mask_sql('value')} as redacted, case detector when 'leak.openai_api_key' then 'security@ai.example' when 'baas.supabase_url' then 'security@baas.example' else {sql_text(reports.NO_CONTACT)} end as contact, case detector when 'leak.openai_api_key' then 'https://ai.example/report' end as form from ids",
)
def vendor_contacts(spark, sf_dir):
    return reports.disclosures(named(spark, sf_dir), spark.createDataFrame(CONTACTS, "detector string, contact string, form string"))


def explained(spark, sf_dir):
    return named(spark, sf_dir).withColumns({"reason": F.concat(F.lit("found "), "type"), "remediation": F.concat(F.lit("fix "), "type")})


@query(
    "sink_sarif",
    f"{W}, {IDS} select 'result' as part, detector as rule_id, case when severity in ('critical', 'high') then 'error' when severity = 'medium' then 'warning' else 'note' end as level, 'found ' || type as text, source as uri, coalesce(line, 1) as start_line, id as finding_id, fingerprint as finding_fingerprint, category from ids union all select distinct 'rule', detector, type, 'fix ' || type, null, null, null, null, category from ids",
)
def sink_sarif(spark, sf_dir):
    """Results and rules; in a rule's rows level holds its name and text its help."""
    results, listed_rules = reports.sarif(explained(spark, sf_dir))
    a = results.select(F.lit("result").alias("part"), "rule_id", "level", F.col("message").alias("text"), "uri", "start_line", "finding_id", "finding_fingerprint", "category")
    b = listed_rules.select(F.lit("rule").alias("part"), "rule_id", F.col("name").alias("level"), F.col("help").alias("text"), "category")
    return a.unionByName(b, allowMissingColumns=True)


SARIF_FILES = [
    '{"runs":[{"tool":{"driver":{"rules":[{"id":"r{n}","name":"key","help":{"text":"fix it"}},{"id":"r{n}","name":"token"}]}},"results":[{"ruleId":"r{n}","level":"Error","message":{"text":"bad {n}"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a{n}.py"},"region":{"startLine":3}}}],"partialFingerprints":{"findingId":"f{n}"},"properties":{"category":"leak"}},{"ruleId":"other","level":"warning","message":{"text":"m"}}]}]}',
    '{"runs":[{"results":[{"level":"note","locations":[]}]},{"tool":{"driver":{"rules":[]}},"results":[{"ruleId":"x","level":"error","partialFingerprints":{"findingFingerprint":"fp{h}"}}]}]}',
    '{"runs":[]}',
]
_js = lambda p: f"coalesce(json_extract_string(r, '{p}'), '')"


@query(
    "src_report_sarif",
    f"""with {values_sql(SARIF_FILES, 'text')}, runs as (select doc_id as file, unnest(json_extract(text, '$.runs[*]')) as run from v), ru as (select file, json_extract_string(x, '$.id') as detector, json_extract_string(x, '$.name') as name, json_extract_string(x, '$.help.text') as help from (select file, k, unnest(json_extract(run, '$.tool.driver.rules[*]')) as x, generate_subscripts(json_extract(run, '$.tool.driver.rules[*]'), 1) as i from (select *, 0 as k from runs)) qualify row_number() over (partition by file, json_extract_string(x, '$.id') order by i desc) = 1),
    r as (select file, unnest(json_extract(run, '$.results[*]')) as r from runs), f as (select file, {_js('$.partialFingerprints.findingId')} as id, {_js('$.partialFingerprints.findingFingerprint')} as fingerprint, coalesce(json_extract_string(r, '$.ruleId'), 'sarif:unknown') as detector, lower(json_extract_string(r, '$.level')) as level, {_js('$.locations[0].physicalLocation.artifactLocation.uri')} as source, json_extract_string(r, '$.locations[0].physicalLocation.region.startLine')::int as line, {_js('$.message.text')} as reason, {_js('$.properties.category')} as category from r)
    select f.file, id, fingerprint, coalesce(name, f.detector) as type, case level when 'error' then 'high' when 'warning' then 'medium' else 'low' end as severity, f.detector, source, line, reason, coalesce(help, '') as remediation, category from f left join ru on ru.file = f.file and ru.detector = f.detector""",
)
def src_report_sarif(spark, sf_dir):
    return reports.from_sarif(doc_values(spark, sf_dir, SARIF_FILES, "text").withColumnRenamed("doc_id", "file"))


@query(
    "sink_findings_json",
    f"""{W}, n as (select source, {COUNTS} from findings group by source), v as (select source, count(*) filter (where severity in ('critical', 'high')) as b, count(*) filter (where severity in ('critical', 'high') and validation_status = 'confirmed') as c, count(*) filter (where severity = 'medium') as m from findings group by source), s as ({VERDICT_SQL})
    select source, 'report' as part, -1::bigint as ord, to_json(struct_pack(target := source, verdict := struct_pack(status := status, reason := reason), summary := struct_pack(total := total, {', '.join(f'{x} := {x}' for x in rules.SEVERITIES)})))::varchar as json from n join s using (source)
    union all select source, 'finding', ord, to_json(struct_pack(ord := ord, type := type, severity := severity, category := category, validation_status := validation_status, line := line, redacted := {mask_sql('value')}))::varchar from findings""",
)
def sink_findings_json(spark, sf_dir):
    """A head and a line a finding for each source; write(..) of the findings partitions them by category."""
    return reports.json_report(T.findings(spark, sf_dir))


@query(
    "sink_text_report",
    f"""{W}, n as (select source, {COUNTS} from findings group by source), v0 as (select source, count(*) filter (where severity in ('critical', 'high')) as b, count(*) filter (where severity in ('critical', 'high') and validation_status = 'confirmed') as c, count(*) filter (where severity = 'medium') as m from findings group by source), v as (select * from v0), s as ({VERDICT_SQL}),
    l as (select source, string_agg('- ' || upper(severity) || ' ' || type || ' at ' || source || ': ' || {mask_sql('value')}, chr(10) order by k) as top from (select *, row_number() over (partition by source order by {RANK} desc, ord) as k from findings) where k <= 10 group by source)
    select source, status || ': ' || critical || ' critical, ' || high || ' high, ' || medium || ' medium, ' || low || ' low' || chr(10) || reason || chr(10) || top || case when total > 10 then chr(10) || '... ' || (total - 10) || ' more findings' else '' end as text from n join s using (source) join l using (source)""",
)
def sink_text_report(spark, sf_dir):
    return reports.text_report(T.findings(spark, sf_dir))


DIGEST_SQL = "d as (select source, ord // 1000 as part, sha256(string_agg(concat_ws('|', lpad(ord::varchar, 12, '0'), type, line, value), ',' order by ord)) as d, count(*) as n from findings group by all), g as (select source, sha256(string_agg(d, ',' order by part)) as digest, sum(n)::bigint as n from d group by source)"


@query(
    "findings_digest",
    f"""{W}, {DIGEST_SQL}, r as (select source as target, k, '2024-01-0' || k as at_, 'signer' || k as signer, digest from g, (values (1), (2), (3)) t(k)), c1 as (select *, '' as prev_hash, sha256('|' || digest || '|' || at_ || '|' || signer) as self_hash from r where k = 1),
    c2 as (select r.*, c1.self_hash as prev_hash, sha256(c1.self_hash || '|' || r.digest || '|' || r.at_ || '|' || r.signer) as self_hash from r join c1 using (target) where r.k = 2), c3 as (select r.*, c2.self_hash as prev_hash, sha256(c2.self_hash || '|' || r.digest || '|' || r.at_ || '|' || r.signer) as self_hash from r join c2 using (target) where r.k = 3),
    u as (select * from c1 union all select * from c2 union all select * from c3) select target, at_ as at, u.digest, self_hash, n, k <> 2 or target not like '%.md' as intact from u join g on g.source = u.target""",
)
def findings_digest(spark, sf_dir):
    """Each source's findings sealed in three reports, and the chain checked; the second report of some sources was changed since."""
    d = reports.digests(T.findings(spark, sf_dir))
    r = d.select(F.col("source").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "digest", "n")
    r = r.select("target", F.concat(F.lit("2024-01-0"), "k").alias("at"), F.concat(F.lit("signer"), "k").alias("signer"), "digest", "n", "k")
    # The first two reports are sealed together, the third is added to their chain.
    first = reports.envelopes(r.where("k < 3"))
    chain = first.unionByName(reports.appended(first, r.where("k = 3")))
    now = r.withColumn("digest", F.when((F.col("k") == 2) & F.col("target").endswith(".md"), "changed").otherwise(F.col("digest")))
    return chain.join(reports.verified(chain, now), ["target", "at"]).join(d.select(F.col("source").alias("target"), "n"), "target").select("target", "at", "digest", "self_hash", "n", "intact")


LINES = ["id: f{n}\n# note\n\nsource: tests/", "bare-{h}\ntype: xss\n  detector :  leak.a{n} ", "signature: a|b|{n}"]
JSONS = ['{"ids":["a{n}","b"],"detector_ids":["leak.x"]}', '{"ids":[],"finding_ids":["c{n}"],"sources":["docs/"],"types":["xss","xss"]}', '{"fingerprints":["fp{h}"],"source_contains":["a"],"sources":["b"]}']
DATES = ["2024-01-15", "2024-08-01", "2024-07-01", "2023-12-31"]
_known = "case k when '' then 'id' when 'source' then 'source_contains' else k end"


def _lists_sql() -> str:
    got = lambda k: f"coalesce(json_extract(text, '$.{k}')::varchar[], [])"
    one = lambda kind, ks: f"select doc_id as file, '{kind}' as kind, unnest(" + (got(ks[0]) if len(ks) == 1 else f"case when len({got(ks[0])}) > 0 then {got(ks[0])} else {got(ks[1])} end") + ") as value from j"
    return " union ".join(one(kind, ks) for kind, ks in reports.LISTS.items())


@query(
    "src_suppressions",
    f"""with v as (select doc_id, {pick_sql(LINES, 'doc_id')} as text from documents), l as (select doc_id as file, trim(unnest(string_split(text, chr(10)))) as line from v), p as (select file, line, case when contains(line, ':') then lower(trim(split_part(line, ':', 1))) else '' end as k from l where line <> '' and not starts_with(line, '#')),
    j as (select doc_id, {pick_sql(JSONS, 'doc_id')} as text from documents), e as (select doc_id, {pick_sql(DATES, 'doc_id')} as expires_at from documents)
    select 'lines' as form, file, {_known} as kind, case when k = '' then line else trim(substring(line, strpos(line, ':') + 1)) end as value from p union all select 'json', * from ({_lists_sql()})
    union all select 'entries', null, 'detector', 'leak.d' || doc_id from e where expires_at >= '2024-07-01' union all select 'entries', null, 'source_contains', 's' || doc_id from e where expires_at >= '2024-07-01' and doc_id % 2 = 0""",
)
def src_suppressions(spark, sf_dir, today: str = "2024-07-01"):
    """Rules from files of lines and of JSON, and from allow-list entries that haven't expired."""
    files = lambda xs: doc_values(spark, sf_dir, xs, "text").withColumnRenamed("doc_id", "file")
    n = F.col("doc_id")
    blank = F.lit(None).cast("string")
    entries = T.read(spark, sf_dir, "documents").select(
        blank.alias("id"), blank.alias("fingerprint"), F.concat(F.lit("leak.d"), n).alias("detector"), blank.alias("type"), F.when(n % 2 == 0, F.concat(F.lit("s"), n)).alias("source_contains"), blank.alias("signature"),
        F.lit("known").alias("reason"), F.lit("@me").alias("owner"), pick(DATES, n).alias("expires_at"),
    )
    tag = lambda df, form: df.withColumn("form", F.lit(form))
    found = tag(reports.suppression_lines(files(LINES)), "lines").unionByName(tag(reports.suppression_json(files(JSONS)), "json"))
    return found.unionByName(tag(reports.suppression_entries(entries, today), "entries"), allowMissingColumns=True)


_n = [("requests", 2), ("bodies", 3), ("scripts", 5), ("storage", 7), ("websockets", 4)]


@query("coverage_level", "with c as (select doc_id as id, list_filter([" + ", ".join(f"case when doc_id % {m} = 0 then {sql_text(reports.SURFACES[k])} end" for k, m in _n) + "], lambda x: x is not null) as covered from documents) select id, covered, case when len(covered) >= 4 then 'strong' when len(covered) > 0 then 'partial' else 'waiting' end as level from c")
def coverage_level(spark, sf_dir):
    counts = F.create_map(*[x for k, m in _n for x in (F.lit(k), (F.col("doc_id") % m == 0).cast("int"))])
    return reports.coverage(T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), counts.alias("counts")))
