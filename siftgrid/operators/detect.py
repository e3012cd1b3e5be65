"""Rule-driven extraction.

Every active rule is one literal test over the text, so its pattern is compiled
once a task and a text without a match costs no more than the test. The few
(text, rule) pairs that match go on, and one expression takes values and offsets
with the pattern as a column. A scan reads the text once and has no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrid.functions import guards, identity, rules
from siftgrid.functions.text import FLAGS, bound, group_of, lookup, matches, required, snippet, sql_literal


MATCH = ("value", "start", "stop", "line", "column", "before", "whole", "after", "more")


def scan(docs: DataFrame, patterns: dict[str, str], text: str = "content", around: int = 0, lines: int = 0, keep_text: bool = False, case: bool = False, dotall: bool = False) -> DataFrame:
    """docs with one row a match: rule, value, start, stop, line, column, before, whole, after, more (see functions.text.matches).

    With lines, `near` holds the match's line and up to that many on both sides, and
    `from_line` the number of the first of them. A rule that needs some fixed string is tried only on texts that hold it. The text
    itself stays only with keep_text: it would be repeated for every match. Case counts with
    `case`, and a dot stands for line ends too with `dotall`.
    """
    q, flags = sql_literal, ("(?m)" if case else FLAGS) + ("(?s)" if dotall else "")

    def test(p: str) -> str:
        first = " or ".join(f"contains(lower_, {q(w)})" for w in required(p))
        return f"({first}) and `{text}` rlike {q(flags + p)}" if first else f"`{text}` rlike {q(flags + p)}"

    tests = ", ".join(f"case when {test(p)} then struct({q(name)} as rule, {q(flags + p)} as pattern_, {group_of(p)} as group_) end" for name, p in patterns.items())
    hits = docs.withColumn("lower_", F.lower(text)).select(*docs.columns, F.expr(f"inline(array_compact(array({tests})))"))
    found = matches(F.col(text), F.col("pattern_"), F.col("group_"), around)
    if lines:
        found = bound(F.split(text, "\n"), lambda split: F.transform(found, lambda m: with_lines(m, split, lines)))
    return hits.withColumn("m", F.explode(found)).select(*(c for c in docs.columns if keep_text or c != text), "rule", "m.*")


def with_lines(m: Column, split: Column, lines: int) -> Column:
    first = F.greatest(F.lit(1), m["line"] - lines)
    near = F.slice(split, first, F.least(F.size(split), m["line"] + lines) - first + 1)
    return F.struct(*(m[c].alias(c) for c in MATCH), first.alias("from_line"), near.alias("near"))


def app_findings(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Matches of the broad rules that aren't known to be harmless, with line and severity."""
    active = patterns or {n: p for n, p in rules.APP_PATTERNS.items() if n not in rules.NEVER_KEPT}
    return scan(docs, active).where(~guards.app_value(F.col("value"))).withColumn("severity", app_severity("rule"))


def app_report(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Findings of the broad rules with what stands around them taken into account: context, in_comment, severity, recommendation.

    A match in a comment is critical if its rule is about a key, secret, token or password.
    """
    active = patterns or {n: p for n, p in rules.APP_PATTERNS.items() if n not in rules.NEVER_KEPT}
    found = scan(docs, active, around=100, lines=2).where(~guards.app_value(F.col("value")) & in_context())
    comment = in_comment(F.col("source"), lookup("rule", {n: group_of(p) for n, p in active.items()}) > 0)
    known = found.withColumn("in_comment", comment).withColumn("context", context())
    severity = F.when(F.col("in_comment") & F.col("rule").rlike("key|secret|token|password"), "critical").otherwise(app_severity("rule"))
    advice = F.coalesce(lookup("rule", rules.ADVICE), F.lit(rules.DEFAULT_ADVICE))
    return known.withColumn("severity", severity).withColumn("recommendation", advice).drop("before", "whole", "after", "more", "near", "from_line", "column")


def in_context() -> Column:
    """Whether a match of the broad rules is one by what stands around it (columns of scan with around >= 100)."""
    before, whole, after, value = (F.col(c) for c in ("before", "whole", "after", "value"))
    window = lambda b, a: F.concat(F.right(before, F.lit(b)), whole, F.left(after, F.lit(a)))
    inside = F.right(before, F.lit(1)).rlike(r"^[\p{L}\p{N}_]$") & F.left(after, F.lit(1)).rlike(r"^[\p{L}\p{N}_]$")
    oauth = ~(inside & ~F.lower(window(50, 50)).rlike("|".join(rules.CREDENTIAL_WORDS)))
    declared = value.rlike("^[a-z][a-zA-Z0-9]*$") & (F.length(value) < 25) & F.right(before, F.lit(20)).rlike(rules.DECLARATION)
    creds = ~(declared | window(30, 50).rlike(rules.CALL) | window(20, 50).rlike(rules.PROPERTY))
    cookie = ~(value.isin(rules.COOKIE_FUNCTIONS) | F.right(before, F.lit(30)).rlike(rules.OPEN_CALL)) & (F.length(value) >= 15)
    return F.when(F.col("rule") == "oauth_token", oauth).when(F.col("rule") == "hardcoded_creds", creds).when(F.col("rule") == "cookie_header", cookie).otherwise(True)


def own_line() -> Column:
    return F.element_at("near", (F.col("line") - F.col("from_line") + 1).cast("int"))


def in_comment(source: Column, has_group: Column) -> Column:
    """Whether a comment mark stands in the part of the line that is looked at.

    With a group that is the line without as many last characters as stand between the match's and
    the group's begin (nothing, if there are none); without one, as much of the line as the match's offset.
    """
    line, lead = own_line(), F.instr("whole", F.col("value")) - 1
    part = F.when(has_group, F.when(lead > 0, F.left(line, F.greatest(F.lit(0), F.length(line) - lead))).otherwise("")).otherwise(F.left(line, F.col("start")))
    return F.when(source.rlike(r"\.(?:js|jsx|ts|tsx)$"), part.rlike(r"//|/\*")).when(source.endswith(".py"), part.contains("#")).otherwise(False)


def context(longest: int = 200) -> Column:
    """The match's line and its neighbours, numbered; of a longer line a window around the match, or its beginning."""
    line, at = F.col("line"), F.col("column")

    def shown(s: Column, i: Column) -> Column:
        first, last = F.greatest(F.lit(0), at - 50), F.least(F.length(s), at + 100)
        middle = F.concat(F.when(first > 0, "...").otherwise(""), F.substring(s, first + 1, last - first), F.when(last < F.length(s), "...").otherwise(""))
        cut = F.when(F.length(s) <= longest, s).when(F.col("from_line") + i == line, middle).otherwise(F.concat(F.left(s, F.lit(longest)), F.lit("...")))
        return F.concat((F.col("from_line") + i).cast("string"), F.lit(": "), cut)

    return F.array_join(F.transform("near", shown), "\n")


def js_findings(docs: DataFrame) -> DataFrame:
    """Hard-coded keys and decryption in scripts (doc_id, source, content), known harmless values left out: rule, value, line, severity."""
    return scan(docs.where(F.col("source").rlike(rules.JS_SUFFIX)), rules.JS_PATTERNS, case=True, dotall=True).where(~guards.app_value(F.col("value"))).withColumn("severity", F.lit("high"))


def comment_credentials(docs: DataFrame) -> DataFrame:
    """Credentials in comments of code (doc_id, source, content): rule, value (key=value), line, severity."""
    found = scan(docs.where(F.col("source").rlike(rules.CODE_PARTS)), rules.COMMENT_PATTERNS, dotall=True)
    # The key is the pattern's first group; the second is taken from the whole match.
    second = F.lit(None).cast("string")
    for name, p in rules.COMMENT_PATTERNS.items():
        second = F.when(F.col("rule") == name, F.regexp_extract("whole", "(?is)" + p, 2)).otherwise(second)
    kept = found.withColumn("secret", F.trim(second)).where(~guards.app_value(F.col("secret")))
    return kept.withColumn("value", F.concat(F.lower("value"), F.lit("="), "secret")).withColumn("severity", F.lit("critical")).drop("secret")


def app_severity(column: str) -> Column:
    return F.coalesce(lookup(column, {k: level for level, kinds in rules.APP_SEVERITY.items() for k in kinds}), F.lit("info"))


def detectors(packs: list[str] | None = None, ids: list[str] | None = None) -> list[tuple]:
    """Active rules: of the packs, or of all; an unknown pack is an error."""
    unknown = set(packs or ()) - set(rules.PACKS)
    if unknown:
        raise ValueError(f"unknown packs: {sorted(unknown)}")
    return [d for d in rules.DETECTORS if (packs is None or d[1] in packs) and (ids is None or d[0] in ids)]


def core_findings(docs: DataFrame, active: list[tuple] | None = None) -> DataFrame:
    """Findings of the precise rules after all guards, first of each (rule, source, redacted value, line)."""
    active = detectors() if active is None else active
    known = docs.withColumn("client_side", guards.client_side(F.col("content")))
    found = scan(known, {d[0]: d[6] for d in active}, around=80)
    value, rule = F.col("value"), F.col("rule")
    table = lambda i: lookup("rule", {d[0]: d[i] for d in active})
    harmless = (
        guards.placeholder(value, table(4))
        | ((rule == "database_url") & guards.placeholder_db_url(value))
        | guards.local_url(value)
        | F.coalesce(guards.low_entropy(value, table(5).cast("double")), F.lit(False))
        | ((rule == "http_basic_auth") & (guards.local_basic_auth(value) | guards.template_marker(value)))
        | (rule.isin("bearer_token", "openai_api_key", "stripe_secret_key") & guards.public_prefix(value))
    )
    severity = table(2)
    kept = (
        found.where(~harmless)
        .withColumn("redacted", identity.redact_mask(value))
        .withColumn("severity", F.when((rule == "gemini_api_key") & F.col("client_side"), "medium").otherwise(severity))
        .withColumn("snippet", identity.pii_scrub_preserve(identity.redact_snippet(snippet(F.struct("start", "before", "whole", "after", "more")), value, F.col("redacted")), F.col("redacted")))
    )
    first = kept.groupBy("doc_id", "rule", "source", "redacted", "line").agg(F.min_by(F.struct("severity", "snippet", "start", "value"), "start").alias("f"))
    return first.select("doc_id", "rule", "source", "redacted", "line", "f.severity", "f.snippet", "f.start", "f.value")
