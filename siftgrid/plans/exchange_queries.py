"""Queries of captured exchanges and events, derived from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgrid.functions import rules, urls
from siftgrid.operators import exchange
from siftgrid.plans.core_queries import any_of, listed, rlike
from siftgrid.plans.registry import query
from siftgrid.plans.web_queries import HOST_SQL, ID_SHAPE, SERVERS, pages
from siftgrid.sources.tables import pick, pick_sql, sql_text

MIMES = ["text/html; charset=utf-8", "application/json", "application/x-www-form-urlencoded", ""]
FORMS = ["a=1&b={n}", '{"page":{n},"key":"{h}"}', "not json {n}", "x={h}"]
SURFACE_SQL = f"e as (select page_id as id, url, {pick_sql(MIMES, 'page_id')} as mime, case when page_id % 4 = 0 then html else {pick_sql(FORMS, 'page_id // 4')} end as body from pages), k as (select * from e where octet_length(encode(body)) <= 10485760)"


@query(
    "src_http_surfaces",
    f"with {SURFACE_SQL} select id, 'url' as kind, url as content from k union all select id, 'header', 'Content-Type: ' || mime from k union all select id, 'header', 'X-Page: ' || id from k union all select id, 'query', array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''), '&') from k where regexp_matches(url, '^[^?#]*\\?[^#]') union all select id, 'form', body from k where contains(mime, 'x-www-form') union all select id, 'json', body from k where contains(mime, 'json') and json_valid(body) union all select id, 'body', body from k",
)
def src_http_surfaces(spark, sf_dir):
    n = F.col("page_id")
    heads = F.create_map(F.lit("Content-Type"), pick(MIMES, n), F.lit("X-Page"), n.cast("string"))
    body = F.when(n % 4 == 0, F.col("html")).otherwise(pick(FORMS, F.floor(n / 4).cast("long")))
    return exchange.surfaces(pages(spark, sf_dir).select(n.alias("id"), "url", heads.alias("headers"), body.alias("body")))


KINDS = ["response", "body", "console", "frame"]
EVENT_MIMES = ["text/html", "image/png", "", "application/json"]
EVENTS_SQL = f"""c as (select page_id as id, {pick_sql(KINDS, 'page_id')} as kind, page_id // 4 as rid, case when page_id % 4 = 0 then case when page_id % 24 = 0 then 'data:x' else url end else '' end as url,
  case when page_id % 4 = 0 then {pick_sql(EVENT_MIMES, 'page_id // 4')} else '' end as mime, page_id // 4 % 2 + 1 as opcode, page_id % 3 = 0 as encoded, case when page_id % 4 = 1 and page_id % 3 = 0 then to_base64(encode(html)) else html end as payload from pages), a as (select rid, min(url) as place, min(mime) as type from c where kind = 'response' group by rid)"""


@query(
    "src_capture_events",
    f"with {EVENTS_SQL} select id, kind, place as url, case when encoded then decode(from_base64(payload)) else payload end as content from c join a using (rid) where kind = 'body' and regexp_matches(place, '^(https?|wss?)://[^/?#]') and (type = '' or {any_of('lower(type)', exchange.TEXT_MIMES)}) and octet_length(case when encoded then from_base64(payload) else encode(payload) end) <= 2097152 union all select id, kind, url, payload from c where kind = 'frame' and opcode = 1 and octet_length(encode(payload)) <= 2097152 union all select id, kind, url, payload from c where kind = 'console'",
)
def src_capture_events(spark, sf_dir):
    n = F.col("page_id")
    four, encoded = F.floor(n / 4).cast("long"), n % 3 == 0
    answer = n % 4 == 0
    c = pages(spark, sf_dir).select(
        n.alias("id"), pick(KINDS, n).alias("kind"), four.alias("request_id"), F.when(answer, F.when(n % 24 == 0, "data:x").otherwise(F.col("url"))).otherwise("").alias("url"),
        F.when(answer, pick(EVENT_MIMES, four)).otherwise("").alias("mime"), (four % 2 + 1).alias("opcode"), encoded.alias("encoded"),
        F.when((n % 4 == 1) & encoded, F.base64(F.encode("html", "utf-8"))).otherwise(F.col("html")).alias("payload"),
    )
    return exchange.events(c)


TARGETS = ["?cmd=ls&x=1", ".php?exec=a&ref=b", "?page=2", ".jsp?code=1#x", "?ping=1&RUN=2", ".do?ref=1&shell=a"]
DANGER_SQL = f"t as (select regexp_replace(url, '[?#].*$', '') || {pick_sql(TARGETS, 'page_id')} as url from pages)"


@query(
    "dangerous_url_params",
    f"with {DANGER_SQL}, p as (select {HOST_SQL} as host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) as pair from t), n as (select host, path, lower(split_part(pair, '=', 1)) as name from p), k as (select host, path, list_sort(list(distinct name)) as params from n where name in ('cmd', 'command', 'exec', 'execute', 'shell', 'system', 'run', 'code', 'func', 'function', 'ping') group by all) select host, path, params, case when {rlike('lower(path)', r'\.(aspx|asp|jsp|php|cgi|do|action)$')} and list_has_any(params, ['cmd', 'command', 'exec', 'execute', 'shell', 'system', 'run']) then 'high' else 'medium' end as severity from k",
)
def dangerous_url_params(spark, sf_dir):
    t = pages(spark, sf_dir).select(F.concat(F.regexp_replace("url", r"[?#].*$", ""), pick(TARGETS, F.col("page_id"))).alias("url"))
    return exchange.dangerous_params(t)


ANSWERS = ["<Code>NoSuchBucket</Code>", "No such app, Repository not found", "all fine {n}", "project not found", "Fastly error: unknown domain {h}", "404 Web Site not found", "Please renew your subscription", "The requested URL was not found on this server", "see herokucdn.com/error-pages/no-such-app.html"]
_service = "case " + " ".join(f"when {any_of('body', marks)} then {sql_text(s)}" for s, marks in rules.TAKEOVER) + " end"


@query("takeover_match", f"with a as (select page_id, {HOST_SQL} as host, {pick_sql(ANSWERS, 'page_id')} as body from pages), s as (select page_id, host, {_service} as service from a) select * from s where service is not null")
def takeover_match(spark, sf_dir):
    a = pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"), pick(ANSWERS, F.col("page_id")).alias("body"))
    return a.select("page_id", "host", exchange.takeover(F.col("body")).alias("service")).where("service is not null")


POWERED = ["PHP/5.{n}", "", "Express"]
METAS = ['<meta charset=x><META name="generator" content="Site {n} ">', "<p>", "<meta name='generator' content='Press 5'>"]
TECH_SQL = f"e as (select page_id as id, {pick_sql(SERVERS, 'page_id')} as server, {pick_sql(POWERED, 'page_id')} as powered, {pick_sql(METAS, 'page_id')} || html as body from pages)"


@query("tech_fingerprint", f"with {TECH_SQL}, g as (select id, trim(regexp_extract(left(body, 50000), {sql_text(exchange.GENERATOR)}, 1)) as v from e) select id, 'Server' as kind, server as value from e union all select id, 'X-Powered-By', powered from e where powered <> '' union all select id, 'generator', v from g where v <> ''")
def tech_fingerprint(spark, sf_dir):
    n = F.col("page_id")
    heads = F.create_map(F.lit("server"), pick(SERVERS, n), F.lit("X-POWERED-BY"), pick(POWERED, n))
    return exchange.technology(pages(spark, sf_dir).select(n.alias("id"), heads.alias("headers"), F.concat(pick(METAS, n), F.col("html")).alias("body")))


CALLS = ["/api/users/{n}", "/orders/12{n}/items", "/about?x={n}", "/a?user_id={n}&account_id=7", "/v1/invoices/{h}?token=t", "/users/me", "/p?uid={n}", "/accounts/{h}/users/5?userid=5", "/admin/9?order_id=x1"]
METHODS = ["GET", "post", "PUT", "DELETE", "OPTIONS"]
STATUS = ["200", "403", "201", "500", "204", "302", "404"]
CALLERS = ["", "x-user-id: 5", "cookie: a=b", "x-account-id: 7"]
_params = "list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: strpos(p, '=') > 0 and split_part(p, '=', 2) <> '')"
_name, _value = "split_part(p, '=', 1)", "split_part(p, '=', 2)"
_resource = f"case when ends_with(lower({_name}), '_id') then left(lower({_name}), length({_name}) - 3) when lower({_name}) in ('userid', 'uid') then 'user' else lower({_name}) end"
ACCESS_SQL = f"""r as (select page_id as id, upper({pick_sql(METHODS, 'page_id')}) as method, 'https://h.example.net' || {pick_sql(CALLS, 'page_id')} as url, {pick_sql(STATUS, 'page_id // 3')}::int as status, {pick_sql(CALLERS, 'page_id // 2')} as caller from pages),
  p as (select *, regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) as path, list_filter(string_split(regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as parts, {_params} as params from r),
  o as (select *, list_concat(list_filter(list_transform(parts, lambda s, i: [case when i = 1 then '' else lower(parts[i - 1]) end, s]), lambda c: regexp_matches(c[2], {sql_text(ID_SHAPE)})), list_transform(list_filter(params, lambda p: ends_with(lower({_name}), 'id') and regexp_matches({_value}, {sql_text(ID_SHAPE)})), lambda p: [{_resource}, {_value}])) as found,
    caller like 'cookie%' or len(list_filter(params, lambda p: {_name} in {listed(rules.AUTH_QUERY_KEYS)})) > 0 as authed, list_concat(case when caller like 'x-%' then [trim(split_part(caller, ':', 2))] else [] end, list_transform(list_filter(params, lambda p: {_name} in {listed(rules.SUBJECT_QUERY_KEYS)}), lambda p: {_value})) as subjects from p),
  s as (select *, list_transform(list_filter(found, lambda c: c[1] in {listed(rules.SENSITIVE_RESOURCES)}), lambda c: c[2]) as objects from o)"""


@query(
    "access_control_requests",
    f"with {ACCESS_SQL}, h as (select *, (case when method in ('PUT', 'PATCH', 'DELETE') then 2 when method = 'POST' then 1 else 0 end) + (case when status between 200 and 299 then 2 else 0 end) + (case when authed then 2 else 1 end) as score from s where len(objects) > 0 and method in ('GET', 'POST', 'PUT', 'PATCH', 'DELETE') and (not authed or (status < 400 and len(subjects) > 0 and len(list_filter(objects, lambda x: not list_contains(subjects, x))) > 0))) select id, method || ' ' || path as value, case when score >= 5 then 'high' else 'medium' end as severity, authed as authenticated from h",
)
def access_control_requests(spark, sf_dir):
    n = F.col("page_id")
    caller = F.split(pick(CALLERS, F.floor(n / 2).cast("long")), ": ")
    heads = F.when(F.size(caller) == 2, F.create_map(caller[0], F.try_element_at(caller, F.lit(2)))).otherwise(F.create_map().cast("map<string,string>"))
    r = pages(spark, sf_dir).select(n.alias("id"), pick(METHODS, n).alias("method"), F.concat(F.lit("https://h.example.net"), pick(CALLS, n)).alias("url"), heads.alias("headers"), pick(STATUS, F.floor(n / 3).cast("long")).cast("int").alias("status"))
    return exchange.access_control(r)


@query("two_user_compare")
def two_user_compare(spark, sf_dir):
    """Object URLs whose bodies are all but the same for two users."""
    n = F.col("page_id")
    p = pages(spark, sf_dir).select(F.concat_ws("#", "url", n.cast("string")).alias("url"), "html", n.alias("n"))
    b = F.when(F.col("n") % 3 == 0, F.col("html")).when(F.col("n") % 3 == 1, F.concat(F.left("html", F.lit(4500)), F.reverse("html"))).otherwise(F.upper("html"))
    answer = lambda user, body, status: p.select("url", F.lit(user).alias("user"), status.alias("status"), body.alias("body"))
    return exchange.same_bodies(answer("a", F.col("html"), F.lit(200)).unionByName(answer("b", b, F.when(F.col("n") % 7 == 0, 403).otherwise(200))))
