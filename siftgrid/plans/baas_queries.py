"""Queries of backend services: scripts, requests and probe answers derived from documents, three to a page or project."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgrid.functions import rules
from siftgrid.operators import baas
from siftgrid.plans.core_queries import rlike
from siftgrid.plans.registry import query
from siftgrid.plans.web_queries import NOW, doc_values, values_sql
from siftgrid.sources import tables as T
from siftgrid.sources.tables import pick, pick_sql, sql_text

SCRIPTS = [
    "const c = createClient('https://abcdefghijklmnopqrst.supabase.co', 'sb_publishable_{h}');",
    "c.from('orders_{n}').select('*'); c.from('users').insert(x); c.from('payments'); c.rpc('do_{n}', {a: 1}); c.rpc(\"sync_all\"); c.from('users')",
    "c.storage.from('pics-{n}').list(); c.storage.from('docs'); c.channel('user-{n}'); c.channel('room'); c.channel(\"chat-id\")",
    "var firebaseConfig = {apiKey: 'AIza{h}abc', databaseURL: 'https://p{n}.firebaseio.com', storageBucket: 'p{n}.appspot.com'}",
    "new Client().setEndpoint('https://cloud.example.io/v1').setProject('proj{n}')",
    "const pb = new PocketBase('https://pb{n}.example.io')",
    "nothing here {n}",
    "x('https://zyxwvutsrqponmlkjihg{n}.supabase.co', 'eyJhbGciOiJIUzI1NiJ9{h}.eyJyb2xlIjoiYW5vbiJ9{h}.{h}')",
    "fetch('https://db{n}.firebaseio.com/x.json?key=AIza{h}xyz'); gs = 'b{n}.appspot.com'",
]


def configs(spark, sf_dir):
    scripts = doc_values(spark, sf_dir, SCRIPTS, "text").select(F.floor(F.col("doc_id") / 3).alias("page"), F.col("doc_id").alias("ord"), "text")
    return baas.config(baas.page_scripts(scripts))


def _first(pattern: str, group: int = 0, text: str = "t") -> str:
    return f"nullif(regexp_extract({text}, {sql_text(pattern)}, {group}), '')"


def _names(pattern: str) -> str:
    found = f"regexp_extract_all(t, {sql_text(pattern)}, 1)"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


_R = rules
CONFIG_SQL = f"""{values_sql(SCRIPTS, 'text')}, s as (select doc_id // 3 as page, string_agg(text, chr(10) order by doc_id) as t from v group by 1),
  a as (select *, {_first(_R.SUPABASE_URL)} as su, {_first(_R.SUPABASE_PUBLIC_KEY)} as pk, coalesce({_first(_R.FIREBASE_CONFIG, 1)}, {_first(_R.FIREBASE_KEY)}) as fk, coalesce({_first(_R.FIREBASE_CONFIG, 2)}, {_first(_R.FIREBASE_URL)}) as fu,
    case when {rlike('t', _R.FIREBASE_CONFIG)} then {_first(_R.FIREBASE_CONFIG, 3)} else {_first(_R.FIREBASE_BUCKET)} end as fb, {_first(_R.APPWRITE_ENDPOINT, 1)} as ae, {_first(_R.APPWRITE_PROJECT, 1)} as ap, {_first(_R.POCKETBASE_URL, 1)} as pb, {_names(_R.BAAS_CHANNEL)} as channels from s),
  b as (select *, coalesce(pk, case when su is not null then {_first(_R.SUPABASE_JWT, 0, 'substring(t, strpos(t, su), 1000)')} end) as sk from a),
  configs as (select page, case when su is not null and sk is not null then 'supabase' when fu is not null then 'firebase' when ae is not null then 'appwrite' when pb is not null then 'pocketbase' end as provider,
    case when su is not null and sk is not null then su when fu is not null then fu when ae is not null then ae else pb end as project_url,
    coalesce(case when su is not null and sk is not null then sk when fu is not null then fk when ae is not null then ap end, '') as api_key,
    case when su is not null and sk is not null then {_names(_R.BAAS_TABLE)} else [] end as tables, case when su is not null and sk is not null then {_names(_R.BAAS_RPC)} else [] end as rpcs,
    case when su is not null and sk is not null then {_names(_R.BAAS_BUCKET)} when fu is not null and fb is not null then [fb] else [] end as buckets, channels from b where (su is not null and sk is not null) or fu is not null or ae is not null or pb is not null)"""


@query("baas_config_extract", f"with {CONFIG_SQL} select page, provider, project_url, api_key, tables, rpcs, buckets, channels from configs")
def baas_config_extract(spark, sf_dir):
    return configs(spark, sf_dir)


@query("baas_rpcs", f"with {CONFIG_SQL} select page, generate_subscripts(rpcs[:20], 1) - 1 as ord, unnest(rpcs[:20]) as name from configs")
def baas_rpcs(spark, sf_dir):
    """Functions that a page's scripts call, as leads; they are never called here."""
    return baas.first_names(configs(spark, sf_dir), "rpcs", "name").withColumn("ord", F.col("ord").cast("long"))


@query("baas_channels", f"with {CONFIG_SQL}, c as (select page, unnest(channels[:20]) as channel from configs) select page, channel from c where {rlike('channel', _R.USER_CHANNEL)}")
def baas_channels(spark, sf_dir):
    return baas.channels(configs(spark, sf_dir))


REQUESTS = [
    "https://abcdefghijklmnopqrst.supabase.co/rest/v1/orders_{n}?select=*", "https://abcdefghijklmnopqrst.supabase.co/rest/v1/rpc/do_it", "https://p{n}.firebaseio.com/users.json", "https://x.example.com/{n}",
    "https://abcdefghijklmnopqrst.supabase.co/storage/v1/object/public/pics/a", "https://firebasestorage.googleapis.com/v0/b/p{n}.appspot.com/o", "https://abcdefghijklmnopqrst.supabase.co/rest/v1/Orders",
]


def _request_sql() -> str:
    part = lambda p, x: f"regexp_extract(value, {sql_text(p)}, {x})" if isinstance(x, int) else sql_text(x)
    whens = " ".join(f"when {rlike('value', p)} then [{sql_text(provider)}, {sql_text(kind)}, {part(p, base)}, {part(p, end)}, {'k' if keyed else sql_text('')}]" for provider, kind, p, base, end, keyed in rules.BAAS_REQUESTS)
    return f"with {values_sql(REQUESTS)}, k as (select *, case when doc_id % 2 = 0 then 'key-' || doc_id else '' end as k from v), c as (select doc_id, case {whens} end as r from k) select doc_id, r[1] as provider, r[2] as kind, r[3] as base_url, r[4] as endpoint, r[5] as api_key from c where r is not null"


@query("baas_request_classify", _request_sql())
def baas_request_classify(spark, sf_dir):
    header = F.when(F.col("doc_id") % 2 == 0, F.lit("ApiKey")).otherwise(F.lit("Accept"))
    r = doc_values(spark, sf_dir, REQUESTS, "url").withColumn("headers", F.create_map(header, F.concat(F.lit("key-"), "doc_id")))
    return baas.classify_requests(r).select("doc_id", "provider", "kind", "base_url", "endpoint", "api_key")


NAMES = ["users", "audit_log", "payments", "password_resets", "posts", "api_tokens", "secret-notes", "invoices_{n}", "authors", "Admin"]
SEVERITY = f"case when {rlike('lower({t})', rules.SENSITIVE_TABLE)} then 'critical' else 'high' end"


def severity_sql(name: str) -> str:
    return SEVERITY.replace("{t}", name)


@query("table_sensitivity", f"with {values_sql(NAMES)} select doc_id, value, {severity_sql('value')} as severity from v")
def table_sensitivity(spark, sf_dir):
    return doc_values(spark, sf_dir, NAMES).withColumn("severity", baas.table_severity(F.col("value")))


TABLES = ["users", "orders", "payments", "v_sales", "tokens", "logs", "admin_notes"]
BODIES = ['[{"id":{n}}]', "[]", '[{"id":1},{"id":{n}}]', '{"message":"denied"}', "not json"]
STATUS = ["200", "200", "401", "200", "404", "400", "201", "409", "403", "200", "500"]
PROBES_SQL = f"pr as (select doc_id // 3 as project, doc_id as ord, {pick_sql(TABLES, 'doc_id')} as target, {pick_sql(STATUS, 'doc_id')}::int as status, {pick_sql(BODIES, 'doc_id')} as body from documents), nm as (select project, ord, target from pr where ord % 2 = 0), vw as (select distinct project, target from pr where target = 'v_sales'), en as (select project + 1 as project, target from pr where ord % 5 <> 0)"
ROWS_SQL = "case when starts_with(ltrim(body), '[') then json_array_length(body) end"
OPEN_SQL = f"op as (select project, ord, target, status, {ROWS_SQL} as n_rows from pr where status = 200 and {ROWS_SQL} >= 1)"


def probes(spark, sf_dir):
    n = F.col("doc_id")
    return T.read(spark, sf_dir, "documents").select(F.floor(n / 3).alias("project"), n.alias("ord"), pick(TABLES, n).alias("target"), pick(STATUS, n).cast("int").alias("status"), pick(BODIES, n).alias("body"))


def named(p):
    return p.where("ord % 2 = 0").select("project", "ord", "target")


@query(
    "baas_open_tables",
    f"with {PROBES_SQL}, {OPEN_SQL}, n as (select distinct project, target, true as named from nm), w as (select project, target, true as vw from vw) select project, ord, target, n_rows::int as n_rows, case when named then {severity_sql('target')} when {severity_sql('target')} = 'critical' then 'high' else 'medium' end as severity, case when named then 0.95::double else 0.6::double end as confidence, case when named then 'confirmed' else 'lead' end as validation_status, case when vw then 'view' else 'table' end as relation from op left join n using (project, target) left join w using (project, target)",
)
def baas_open_tables(spark, sf_dir):
    p = probes(spark, sf_dir)
    return baas.open_tables(p, named(p), p.where("target = 'v_sales'")).drop("status", "body")


@query(
    "baas_probe_order",
    f"with {PROBES_SQL}, m as (select project, target, 0 as part, min(ord) as ord from nm group by all), e as (select distinct project, target, 1 as part, 0 as ord from en where (project, target) not in (select (project, target) from m)), b as (select * from m union all select * from e) select project, target, row_number() over (partition by project order by {severity_sql('target')} <> 'critical', part, ord, target)::int as place from b qualify place <= 50",
)
def baas_probe_order(spark, sf_dir):
    p = probes(spark, sf_dir)
    return baas.probe_order(named(p), p.where("ord % 5 <> 0").select((F.col("project") + 1).alias("project"), "target"))


@query(
    "baas_writable",
    f"with {PROBES_SQL}, {OPEN_SQL}, wr as (select project - 1 as project, target, status from pr), g as (select project, target, min(ord) as ord from op group by all), a as (select * from g qualify row_number() over (partition by project order by ord, target) <= 20) select project, target, min(status) as http_status, 'critical' as severity from wr where status in (400, 201, 409) and (project, target) in (select (project, target) from a) group by all",
)
def baas_writable(spark, sf_dir):
    p = probes(spark, sf_dir)
    opened = baas.open_tables(p, named(p), p.where("target = 'v_sales'"))
    return baas.writable(p.select((F.col("project") - 1).alias("project"), "target", "status"), opened)


LISTED = ['[{"name":"pub{n}","public":true},{"id":"priv","public":false}]', '[{"name":"docs","public":false}]', "[]", '[{"name":"pics"}]']
OWN = ["docs", "pics", "priv", "extra{n}"]
LISTING_SQL = f"li as (select doc_id // 3 as project, {pick_sql(LISTED, 'doc_id')} as body from documents where doc_id % 3 = 0), l as (select project, coalesce(nullif(json_extract_string(b, '$.name'), ''), json_extract_string(b, '$.id'), '') as bucket, coalesce(json_extract_string(b, '$.public') = 'true', false) as public from (select project, unnest(json_extract(body, '$[*]')[:10]) as b from li)), ow as (select doc_id // 3 as project, doc_id as ord, {pick_sql(OWN, 'doc_id')} as bucket, {pick_sql(STATUS, 'doc_id')}::int as status from documents qualify row_number() over (partition by doc_id // 3 order by doc_id) <= 10)"


@query(
    "baas_storage",
    f"with {LISTING_SQL} select distinct project, bucket, 'high' as severity, 0.95::double as confidence from l where public and bucket <> '' union all select distinct project, bucket, 'medium', 0.85::double from ow where status = 200 and (project, bucket) not in (select (project, bucket) from l where bucket <> '')",
)
def baas_storage(spark, sf_dir):
    d, n = T.read(spark, sf_dir, "documents"), F.col("doc_id")
    listings = d.where(n % 3 == 0).select(F.floor(n / 3).alias("project"), pick(LISTED, n).alias("body"))
    return baas.storage(listings, d.select(F.floor(n / 3).alias("project"), n.alias("ord"), pick(OWN, n).alias("bucket"), pick(STATUS, n).cast("int").alias("status")))


KEYS = ['{"role":"service_role","exp":{n}}', '{"role":"anon","exp":1900000000}', '{"role":"anon","exp":1750000100}', '{"exp":2000000000.5}']
CORS = ["*", "https://a.example", ""]
SETTINGS = ['{"mailer_autoconfirm":true}', '{"mailer_autoconfirm":false}', "{}"]
_claim = lambda k: f"json_extract_string(c, '$.{k}')"
AUTH_SQL = f"pj as (select doc_id as project, {pick_sql(KEYS, 'doc_id')} as c, case when doc_id % 7 = 0 then 401 else 200 end as ks, {pick_sql(CORS, 'doc_id')} as cors, case when doc_id % 5 = 0 then 500 else 200 end as ss, {pick_sql(SETTINGS, 'doc_id')} as st from documents)"


@query(
    "baas_auth_posture",
    f"""with {AUTH_SQL} select project, 'baas_key_invalid' as type, 'info' as severity, 0.8::double as confidence from pj where ks <> 200 union all select project, 'baas_cors_wildcard', 'low', 0.8 from pj where ks = 200 and cors = '*'
    union all select project, 'baas_service_role_exposed', 'critical', 1.0 from pj where ks = 200 and {_claim('role')} = 'service_role' union all select project, 'baas_long_lived_key', 'low', 0.8 from pj where ks = 200 and {_claim('exp')}::double - {NOW} > 31536000
    union all select project, 'baas_no_email_confirmation', 'medium', 0.85 from pj where ks = 200 and ss = 200 and json_extract_string(st, '$.mailer_autoconfirm') = 'true'""",
)
def baas_auth_posture(spark, sf_dir):
    n = F.col("doc_id")
    token = F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), F.rtrim(F.translate(F.base64(F.encode(pick(KEYS, n), "utf-8")), "+/", "-_"), F.lit("=")), F.lit(".sig"))
    p = T.read(spark, sf_dir, "documents").select(
        n.alias("project"), token.alias("api_key"), F.when(n % 7 == 0, 401).otherwise(200).alias("key_status"), pick(CORS, n).alias("cors"),
        F.when(n % 5 == 0, 500).otherwise(200).alias("settings_status"), pick(SETTINGS, n).alias("settings"),
    )
    return baas.auth_posture(p, NOW)


SERVICES = ["firebase database /", "firebase storage b{n}.appspot.com", "appwrite collection c{n}", "pocketbase collection users", "pocketbase collection "]
ANSWERS = ['{"users":true}', "null", '"null"', "[]"]
SERVICE_SQL = f"o as (select doc_id // 3 as project, doc_id as ord, string_split({pick_sql(SERVICES, 'doc_id')}, ' ') as s, {pick_sql(STATUS, 'doc_id')}::int as status, {pick_sql(ANSWERS, 'doc_id')} as body from documents), q as (select project, ord, s[1] as provider, s[2] as kind, s[3] as target, status, body, row_number() over (partition by project, s[1], s[2] order by ord) as k from o)"


@query(
    "baas_other_providers",
    f"with {SERVICE_SQL} select project, provider, target, case when kind = 'storage' then 'baas_open_storage' else 'baas_open_table' end as type, case when kind = 'database' then 'critical' else 'high' end as severity, case when kind = 'database' then 0.95::double else 0.9::double end as confidence from q where status = 200 and k <= 50 and ((kind = 'database' and body not in ('null', '\"null\"')) or (kind = 'storage' and k <= 10) or (kind = 'collection' and target <> ''))",
)
def baas_other_providers(spark, sf_dir):
    n = F.col("doc_id")
    s = F.split(pick(SERVICES, n), " ")
    p = T.read(spark, sf_dir, "documents").select(F.floor(n / 3).alias("project"), n.alias("ord"), s[0].alias("provider"), s[1].alias("kind"), s[2].alias("target"), pick(STATUS, n).cast("int").alias("status"), pick(ANSWERS, n).alias("body"))
    return baas.other_providers(p)
