"""Queries of captured traffic, code, manifests, feeds and rule tables; inputs are derived from documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgrid.functions import rules, urls
from siftgrid.operators import feeds, ownership, report_rows, similar
from siftgrid.plans.core_queries import any_of, listed
from siftgrid.plans.registry import query
from siftgrid.plans.web_queries import CODE_SQL, HOST_SQL, doc_values, pages, values_sql
from siftgrid.sources import tables as T
from siftgrid.sources.tables import pick, pick_sql, sql_text
from siftgrid.streaming import decisions

STORAGE = ["authToken={h}", "theme=dark", "lang=en-{n}-a-long-value-here", "refresh={h}secret", "key=short"]


@query("src_browser_storage", f"with {values_sql(STORAGE)} select doc_id, value from v where length(value) >= 20 and {any_of('lower(value)', feeds.STORED)}")
def src_browser_storage(spark, sf_dir):
    return feeds.stored_values(doc_values(spark, sf_dir, STORAGE))


@query("src_sourcemap_inline", "select doc_id, 'a' || doc_id || '.js' as path, text as content from documents where text is not null")
def src_sourcemap_inline(spark, sf_dir):
    """Inline maps made of documents and read back: one row for each source with content."""
    d = T.read(spark, sf_dir, "documents")
    sources = F.array(F.concat(F.lit("a"), F.col("doc_id"), F.lit(".js")), F.lit("b.js"))
    bundle = F.concat(F.lit("code\n//# sourceMappingURL=data:application/json;base64,"), F.translate(F.base64(F.encode(F.to_json(F.struct(sources.alias("sources"), F.array(F.col("text"), F.lit(None).cast("string")).alias("sourcesContent"))), "utf-8")), "\r\n", ""))
    return feeds.inline_maps(d.select("doc_id", bundle.alias("bundle")))


RULE_FILES = ["[[rules]]\nid = \"My-Key{n}\"\nregex = '''k{n}-[a-z]+'''\n[[rules]]\nid = \"Other\"\nregex = '''o[0-9]+'''", "title = {n}"]


@query("src_rules_toml", f"with {values_sql(RULE_FILES)}, b as (select doc_id, unnest(string_split(value, '[[rules]]')[2:]) as block from v) select doc_id, replace(lower(regexp_extract(block, 'id = \"([^\"]+)\"', 1)), '-', '_') as id, regexp_extract(block, '''''''(.*?)''''''', 1) as pattern from b")
def src_rules_toml(spark, sf_dir):
    return feeds.toml_rules(doc_values(spark, sf_dir, RULE_FILES, "text"))


FEED = ['{"id":"MAL-{n}","affected":[{"package":{"name":"bad{n}","ecosystem":"npm"},"versions":["1.0","1.1"]}]}', '{"id":"MAL-all{n}","affected":[{"package":{"name":"bad{n}","ecosystem":"npm"},"versions":[]}]}', '{"id":"CVE-{n}","affected":[{"package":{"name":"x","ecosystem":"npm"},"versions":[]}]}']
FEED_SQL = f"{values_sql(FEED, 'j')}, a as (select json_extract_string(j, '$.id') as id, json_extract_string(j, '$.affected[0].package.name') as package, json_extract_string(j, '$.affected[0].package.ecosystem') as ecosystem, json_extract(j, '$.affected[0].versions')::varchar[] as versions from v where starts_with(json_extract_string(j, '$.id'), 'MAL-'))"


def feed(spark, sf_dir):
    return feeds.malicious(doc_values(spark, sf_dir, FEED, "text"))


@query("src_ioc_feed", f"with {FEED_SQL} select id, package, ecosystem, versions from a")
def src_ioc_feed(spark, sf_dir):
    return feed(spark, sf_dir)


LISTED = FEED[:2] + ['{"id":"MAL-py{n}","affected":[{"package":{"name":"wheel-{n}","ecosystem":"PyPI"},"versions":["2.0","2.0.1"]}]}']
LISTED_SQL = FEED_SQL.replace(values_sql(FEED, "j"), values_sql(LISTED, "j"))
#: Lockfiles in their forms: a listed version, one that isn't, one too far from its package, keys alone, names that only begin or end alike.
LOCKS = [
    '{"packages":{"bad{n}":{"version":"1.0","dev":true}}}', '{"bad{n}": {\n  "resolved": "https://r.example/x.tgz",\n  "version": "1.1"\n}}', '{"bad{n}":{"version":"9.9"}}',
    '{"bad{n}": {"resolved": "https://registry.example.org/a/very/long/path/that/goes/on/and/on/to/some/file.tgz", "version": "1.0"}}', '{"dependencies":{"BAD{n}": "^2.0.0"}}', 'wheel-{n}==2.0\nother==1.0', 'wheel-{n} == 2.0.1 ; python', 'x-wheel-{n}@2.0',
    'wheel-{n}x==2.0', 'wheel-{n}>=2.0.5', 'Wheel-{n}:  2.0-rc1', '"wheel-{n}": "2.0"', '{"notbad{n}":{"version":"1.0"}}', '[[package]]\nname = "wheel-{n}"\nversion = "2.0"',
]
LOCKS_SQL = f"locks as (select doc_id as file, {pick_sql(LOCKS, '(doc_id // 2)')} as text from documents)"


@query(
    "ioc_package_match",
    f"""with {LISTED_SQL}, {LOCKS_SQL}, near as (select * from locks join a on contains(lower(text), lower(package))), each as (select *, unnest(versions) as version from near)
    select distinct file, id, package, ecosystem, version from each where regexp_matches(text, case when ecosystem = 'npm' then '(?i)"' || package || '"[\\s\\S]{{0,80}}"version"\\s*:\\s*"' || replace(version, '.', '\\.') || '"' else '(?i)\\b' || package || '\\b[\\s,=<>:@]+' || replace(version, '.', '\\.') || '\\b' end)
    union select file, id, package, ecosystem, null from near where len(versions) = 0 and regexp_matches(text, '(?i)"' || package || '"\\s*:\\s*"')""",
)
def ioc_package_match(spark, sf_dir):
    """Lockfiles of three forms against listed packages: the texts are read once, and what they name meets the list by equi-joins."""
    locks = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), pick(LOCKS, F.floor(F.col("doc_id") / 2)).alias("text"))
    return feeds.lockfile_matches(locks, feeds.malicious(doc_values(spark, sf_dir, LISTED, "text")))


OPENAPI = ['{"definitions":{"users":{},"t{n}":{}},"paths":{"/":{},"/orders":{"get":{},"post":{}},"/v_sales":{"get":{}},"/rpc/f":{},"/a/b":{"get":{}},"/{id}":{"get":{}},"/w{n}/":{"GET":{},"POST":{}}}}', '{"paths":{"/only":{"get":{}}}}']


@query("src_openapi_tables", f"with {values_sql(OPENAPI, 'j')}, t as (select doc_id, unnest(json_keys(j, '$.definitions')) as name from v union select doc_id, substring(p, 2) from (select doc_id, unnest(json_keys(j, '$.paths')) as p from v) where regexp_matches(p, '^/[^/{{]+/?$')) select doc_id, trim(name, '/') as name from t")
def src_openapi_tables(spark, sf_dir):
    return feeds.api_tables(doc_values(spark, sf_dir, OPENAPI, "text"))


@query("src_openapi_views", f"with {values_sql(OPENAPI, 'j')} select doc_id, substring(e.key, 2) as name from v, json_each(v.j, '$.paths') e where len(json_keys(e.value)) > 0 and not list_contains(list_transform(json_keys(e.value), lambda k: lower(k)), 'post') and regexp_matches(e.key, '^/[^/{{]+/?$')")
def src_openapi_views(spark, sf_dir):
    return feeds.api_views(doc_values(spark, sf_dir, OPENAPI, "text"))


#: Files of repositories: owners in one of three places or none, some of what needs one named.
OWNED = [".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS", "README.md", "src/CODEOWNERS", "CODEOWNERS"]
OWNERS = ["* @all", "/.github/workflows/ @a\n/core/ @b\npyproject.toml @c", "core/ @b\n# pyproject.toml", "", "/.github/workflows/x.yml @a\ncore pyproject.toml @c"]
NEED_OWNER = [".github/workflows", "core", "pyproject.toml"]


@query(
    "required_coverage",
    f"""with f as (select doc_id // 3 as repo, {pick_sql(OWNED, '(doc_id * 5 // 3)')} as path, {pick_sql(OWNERS, 'doc_id')} as text, doc_id from documents), o as (select * from (select distinct repo from f) r left join (select repo, path, text from f where path in {listed(ownership.PLACES)} qualify row_number() over (partition by repo order by list_position({ownership.PLACES}, path), text) = 1) using (repo)),
    m as (select repo, path, case when path is null then {NEED_OWNER} else list_filter({NEED_OWNER}, lambda p: not contains(text, p)) end as missing from o)
    select repo, case when path is null then 'codeowners_missing' else 'codeowners_incomplete' end as type, case when path is null then 'medium' else 'low' end as severity, coalesce(path, '.github/CODEOWNERS') as source, missing from m where len(missing) > 0""",
)
def required_coverage(spark, sf_dir):
    """Ownership files of repositories of three files each; of two files at one place the lesser text counts."""
    n = F.col("doc_id")
    f = T.read(spark, sf_dir, "documents").select(F.floor(n / 3).alias("repo"), pick(OWNED, F.floor(n * 5 / 3)).alias("path"), pick(OWNERS, n).alias("text"))
    return ownership.coverage(f.groupBy("repo", "path").agg(F.min("text").alias("text")), NEED_OWNER)


_norm = CODE_SQL
# Every eighth stretch from each of eight places: one pass each.
_cuts = ", ".join(f"regexp_extract_all(substring(t, {o + 1}), '(?s).{{{{8}}}}')" for o in range(8))
_shingled = f"select distinct id, unnest(case when length(t) < 8 then [t] else flatten([{_cuts}]) end) as g from {{t}}"


@query(
    "fingerprint_fuzzy",
    f"""with d as (select doc_id as id, {_norm} as t from documents where text is not null), c as (select item_id as id, {_norm} as t from benchmark where text is not null), ds as ({_shingled.format(t="d")}), cs as ({_shingled.format(t="c")}),
    dn as (select id, count(*) as n from ds group by id), cn as (select id, count(*) as n from cs group by id), m as (select ds.id as doc_id, cs.id as item_id, count(*) as met from ds join cs using (g) group by all)
    select doc_id, item_id, met::double / (x.n + y.n - met) as score from m join dn x on x.id = doc_id join cn y on y.id = item_id join d on d.id = doc_id join c on c.id = item_id where met >= 0.7 * (x.n + y.n - met) and d.t <> c.t""",
)
def fingerprint_fuzzy(spark, sf_dir):
    """Documents that all but repeat a passage of benchmark."""
    return similar.fuzzy(T.read(spark, sf_dir, "documents").select("doc_id", "text"), T.read(spark, sf_dir, "benchmark").select("item_id", "text"))


#: What was found on a host: with and without a source, a category, a state; none.
ON_HOSTS = ['[{"type":"open_port","severity":"HIGH","value":"p{n}-{h}"}]', '[{"type":"banner","source":"tls","category":"recon","details":"d{n}"},{"severity":"odd","validation_status":"confirmed","url":"http://x.example/?token=abc{h}&a=1"}]', '[]', '[{"type":"access_control_issue","category":"","confidence":0.3}]']
_get = lambda k: f"json_extract_string(f, '$.{k}')"


@query(
    "attack_surface_fold",
    f"""with h as (select page_id, url, {HOST_SQL} as host, {pick_sql(ON_HOSTS, 'page_id')} as found from pages), e as (select page_id, url, coalesce(host, nullif(url, ''), 'attack-surface') as host, unnest(json_extract(found, '$[*]')) as f from h),
    r as (select page_id, coalesce(nullif({_get('type')}, ''), 'unknown') as type, case when lower({_get('severity')}) in {listed(rules.SEVERITIES)} then lower({_get('severity')}) else 'info' end as severity, coalesce(nullif({_get('source')}, ''), case when {_get('source')} = '' then 'unknown' else 'Attack Surface: ' || host end) as source, {_get('category')} as category, {_get('validation_status')} as st, {_get('details')} as details, {_get('confidence')}::double as confidence from e)
    select page_id, type, severity, coalesce(confidence, case when severity in ('critical', 'high') then 0.9 when severity = 'medium' then 0.7 else 0.55 end) as confidence, 'attack-surface:' || type as detector_id, source,
      case when category is null then 'access-control' when category <> '' then category when type = 'access_control_issue' then 'access-control' else 'leak' end as category, coalesce(st, 'lead') as validation_status, coalesce(details, '') as snippet from r""",
)
def attack_surface_fold(spark, sf_dir):
    """Per-host arrays of findings as findings of the one schema."""
    shape = "array<struct<type:string,severity:string,source:string,category:string,validation_status:string,url:string,value:string,details:string,confidence:double>>"
    h = pages(spark, sf_dir).select("page_id", "url", urls.host(F.col("url")).alias("host"), F.from_json(pick(ON_HOSTS, F.col("page_id")), shape).alias("findings"))
    return report_rows.surface_findings(h).select("page_id", "type", "severity", "confidence", "detector_id", "source", "category", "validation_status", "snippet")


@query(
    "stream_suppress",
    """with e as (select event_id, user_id, ts, event_type || '-' || (event_id % 5) as id, event_id % 4 = 0 as decision from events),
    hidden as (select distinct user_id, id from e where decision) select event_id, user_id, id from e where not decision and (user_id, id) not in (select user_id, id from hidden)""",
)
def stream_suppress(spark, sf_dir):
    """Batch form of streaming.decisions.hidden_live: every fourth event is a decision of its user to hide what it names; the others are findings.

    No user can name more different ids than a ring holds here, so each decision counts.
    """
    e = T.read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_id").alias("seq"), F.concat_ws("-", "event_type", F.pmod("event_id", F.lit(5))).alias("id"))
    decided = F.pmod("event_id", F.lit(4)) == 0
    return decisions.shown(e.where(~decided).select("event_id", "user_id", "id"), e.where(decided).select("user_id", "ts", "seq", "id")).select("event_id", "user_id", "id")


@query("stream_scan", f"with {T.PLANTED_SQL} select doc_id, unnest(regexp_extract_all(content, 'https://hooks\\.slack\\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+')) as value from planted")
def stream_scan(spark, sf_dir):
    """Batch form of streaming.scan."""
    from siftgrid.streaming import jobs

    return jobs.scan(T.planted(spark, sf_dir), {"slack_webhook": rules.APP_PATTERNS["slack_webhook"]}).select("doc_id", "value")
