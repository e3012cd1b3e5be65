"""Queries of what stands around a match of the broad rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgrid.functions import rules, text
from siftgrid.operators import detect
from siftgrid.plans.core_queries import SIMPLE, any_of, app_value_sql, listed, rlike, severity_sql
from siftgrid.plans.registry import query
from siftgrid.sources import tables as T
from siftgrid.sources.tables import pick, pick_sql, sql_text

PATHS = ["a{n}.js", "b.py", "c.txt", "d{n}.tsx"]


def lines_of(spark, sf_dir, choices):
    """doc_id, source, content: one short text a document."""
    n = F.col("doc_id")
    return T.read(spark, sf_dir, "documents").select("doc_id", pick(PATHS, n * 3 + F.floor(n / 7).cast("long")).alias("source"), pick(choices, n).alias("content"))


def found_sql(choices: list[str], names: list[str]) -> str:
    """Tables t (the texts) and m (rule, value, whole, start): for texts of one line with one match a rule at most."""
    one = lambda n: f"select doc_id, source, content, '{n}' as rule, regexp_extract(content, {sql_text('(?i)' + rules.APP_PATTERNS[n])}) as whole, regexp_extract(content, {sql_text('(?i)' + rules.APP_PATTERNS[n])}, {text.group_of(rules.APP_PATTERNS[n])}) as value, {'true' if text.group_of(rules.APP_PATTERNS[n]) else 'false'} as has_group from t where {rlike('content', '(?i)' + rules.APP_PATTERNS[n])}"
    return f"t as (select doc_id, {pick_sql(PATHS, '(doc_id * 3 + doc_id // 7)')} as source, {pick_sql(choices, 'doc_id')} as content from documents), m0 as ({' union all '.join(map(one, names))}), m as (select *, strpos(content, whole) - 1 as start, strpos(whole, value) - 1 as lead from m0 where not {app_value_sql('value')})"


def window_sql(before: int, after: int) -> str:
    return f"substring(content, greatest(start - {before}, 0) + 1, least(start, {before}) + length(whole) + {after})"


_before = lambda k: f"substring(content, greatest(start - {k}, 0) + 1, least(start, {k}))"


_lines = "lines as (select doc_id, unnest(string_split(content, chr(10))) as txt, generate_subscripts(string_split(content, chr(10)), 1) as line from planted)"
_hits = " union all ".join(f"select doc_id, '{n}' as rule, line, txt, regexp_extract_all(txt, {sql_text('(?i)' + p)}) as w, regexp_split_to_array(txt, {sql_text('(?i)' + p)}) as g from lines where {rlike('txt', '(?i)' + p)}" for n, p in SIMPLE.items())
_len = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"


@query(
    "context_lines",
    f"""with {T.PLANTED_SQL}, {_lines}, h as ({_hits}), e as (select *, generate_subscripts(w, 1) as k from h), p as (select doc_id, rule, line, k, {_len('g[1:k]')} + {_len('w[1:k - 1]')} as col from e),
    n as (select p.*, l.line as other, case when length(l.txt) <= 200 then l.txt when l.line = p.line then (case when col > 50 then '...' else '' end) || substring(l.txt, (greatest(col - 50, 0) + 1)::int, (least(length(l.txt), col + 100) - greatest(col - 50, 0))::int) || (case when col + 100 < length(l.txt) then '...' else '' end) else left(l.txt, 200) || '...' end as shown from p join lines l on l.doc_id = p.doc_id and l.line between p.line - 2 and p.line + 2)
    select doc_id, rule, line::int as line, string_agg(other || ': ' || shown, chr(10) order by other) as context from n group by doc_id, rule, line, k""",
)
def context_lines(spark, sf_dir):
    """The line of each match and two on either side, numbered; of long lines the part around the match, or the beginning."""
    found = detect.scan(T.planted(spark, sf_dir), SIMPLE, lines=2)
    return found.select("doc_id", "rule", "line", detect.context().alias("context"))


COMMENTS = [
    "x = 1 // api_key={h}{n}", "/* apikey: '{h}' */ y", "plain {h}", "# api_secret = \"{h}\"", "y = 'api-token={h}'", "z // key-{h}", "# npm_{h}abcd", "api_key:{h} // x", "s = \"key-{h}\" # n", "// session_id={h}",
]
COMMENT_RULES = ["api_key", "mailgun_api_key", "npm_token", "session_id"]
_part = "case when has_group then case when lead > 0 then left(content, greatest(0, length(content) - lead)) else '' end else left(content, start) end"


@query(
    "in_comment_flag",
    f"with {found_sql(COMMENTS, COMMENT_RULES)}, c as (select *, case when {rlike('source', r'\.(?:js|jsx|ts|tsx)$')} then contains({_part}, '//') or contains({_part}, '/*') when ends_with(source, '.py') then contains({_part}, '#') else false end as in_comment from m) select doc_id, rule, source, in_comment, case when in_comment and {rlike('rule', 'key|secret|token|password')} then 'critical' else {severity_sql('rule')} end as severity from c",
)
def in_comment_flag(spark, sf_dir):
    found = detect.app_report(lines_of(spark, sf_dir, COMMENTS), {n: rules.APP_PATTERNS[n] for n in COMMENT_RULES})
    return found.select("doc_id", "rule", "source", "in_comment", "severity")


OAUTH = ["x7-{h}abcdefghy", "token 7-{h}abcdefgh here", "see 12-{h}abcdefgh.", "a123-{h}abcdefghZ9 " + "x" * 60 + " oauth", "api 345-{h}abcdefghb", "_678-{h}abcdefgh_", "auth" + " " * 48 + "z901-{h}abcdefghz"]
_near = any_of(f"lower({window_sql(50, 50)})", rules.CREDENTIAL_WORDS)


@query(
    "finding_context_oauth",
    f"with {found_sql(OAUTH, ['oauth_token'])} select doc_id, value from m where {_near} or not ({rlike(_before(1), r'^[\p{L}\p{N}_]$')} and {rlike('substring(content, (start + length(whole) + 1)::int, 1)', r'^[\p{L}\p{N}_]$')})",
)
def finding_context_oauth(spark, sf_dir):
    """Inside an identifier and without a credential word within 50 characters it is no token."""
    return detect.app_report(lines_of(spark, sf_dir, OAUTH), {"oauth_token": rules.APP_PATTERNS["oauth_token"]}).select("doc_id", "value")


COOKIES = ["cookie: setCookie and some more text", "Cookie=sid={h}; a=b", "run( cookie: abc def {h}", "set-cookie: id={n} {h}", "f (cookie={h}{h}", "set-cookie: short=%20 value {h}"]


@query(
    "finding_context_cookie",
    f"with {found_sql(COOKIES, ['cookie_header'])} select doc_id, value from m where value not in {listed(rules.COOKIE_FUNCTIONS)} and length(value) >= 15 and not {rlike(_before(30), rules.OPEN_CALL)}",
)
def finding_context_cookie(spark, sf_dir):
    """Function names, arguments of calls and short values are no cookies."""
    return detect.app_report(lines_of(spark, sf_dir, COOKIES), {"cookie_header": rules.APP_PATTERNS["cookie_header"]}).select("doc_id", "value")


CREDS = [
    "password = 'Zx9-{h}'", "let secret = 'camelCaseName'", "call(secret = '{h}.x')", "a.token = '{h}.x'", "x = 1; secret = '{h}.y' + f(2)", "var password: 'plainwordonly'", "user '{h}@{n}.x'", "this.key = 'someShortName'", "token = '{h}.z' ; " + "q" * 60 + " g(1)",
]


@query(
    "finding_context_creds",
    f"with {found_sql(CREDS, ['hardcoded_creds'])} select doc_id, value from m where not (({rlike('value', '^[a-z][a-zA-Z0-9]*$')} and length(value) < 25 and {rlike(_before(20), rules.DECLARATION)}) or {rlike(window_sql(30, 50), rules.CALL)} or {rlike(window_sql(20, 50), rules.PROPERTY)})",
)
def finding_context_creds(spark, sf_dir):
    """Hard-coded credentials that aren't declarations, calls or properties."""
    return detect.app_report(lines_of(spark, sf_dir, CREDS), {"hardcoded_creds": rules.APP_PATTERNS["hardcoded_creds"]}).select("doc_id", "value")


def case_sql(expr: str, table: dict[str, str], default: str) -> str:
    return f"case {expr} " + " ".join(f"when {sql_text(k)} then {sql_text(v)}" for k, v in table.items()) + f" else {sql_text(default)} end"


TYPES = [*rules.ADVICE, "unknown_type", "idor"]


@query("recommend_by_type", f"with v as (select doc_id, {pick_sql(TYPES, 'doc_id')} as type from documents) select doc_id, type, {case_sql('type', rules.ADVICE, rules.DEFAULT_ADVICE)} as recommendation from v")
def recommend_by_type(spark, sf_dir):
    v = T.read(spark, sf_dir, "documents").select("doc_id", pick(TYPES, F.col("doc_id")).alias("type"))
    return v.withColumn("recommendation", F.coalesce(text.lookup("type", rules.ADVICE), F.lit(rules.DEFAULT_ADVICE)))
