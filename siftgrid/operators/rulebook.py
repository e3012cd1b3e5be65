"""Rules as rows: a table of rules drives a scan and its guards.

The rule table is small by nature and checked (`MOST_RULES`); it is read once and
sent to the tasks, and joined back to the matches for the guards. A task builds one
automaton over the fixed strings that the rules need and reads each text once with
it; only rules whose strings are there are tried, so the cost of a text hardly
depends on the number of rules. A rule's pattern is compiled when a task first needs
it, once. Patterns have Python's syntax, matched without case and line by line.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.functions import guards, identity, rules
from siftgrid.functions.text import required, snippet

RULE = (
    "id string, pattern string, severity string, pack string, finding_type string, categories array<string>, min_length int, "
    "capture_group int, min_entropy double, validation_status string, references array<string>, aliases array<string>, description string"
)
#: A rule table has at most so many rows.
MOST_RULES = 50_000
#: What a column without a value means.
DEFAULTS = {"severity": "medium", "pack": "leak", "min_length": 8, "capture_group": 0, "validation_status": "validated"}


def shipped(spark: SparkSession) -> DataFrame:
    """The precise rules as rows."""
    rows = [
        (name, pattern, severity, pack, None, rules.DETECTOR_CATEGORIES.get(name, "").split(), shortest, 0, entropy, status, [], [], None)
        for name, pack, severity, status, shortest, entropy, pattern in rules.DETECTORS
    ]
    return spark.createDataFrame(rows, RULE)


def completed(book: DataFrame) -> DataFrame:
    """A rule table with every column of RULE; only id and pattern are needed, the rest has defaults."""
    columns = []
    for name, kind in (x.rsplit(" ", 1) for x in RULE.split(", ")):
        value = F.col(name).cast(kind) if name in book.columns else F.lit(None).cast(kind)
        if name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]).cast(kind))
        elif kind.startswith("array"):
            value = F.coalesce(value, F.array().cast(kind))
        columns.append(value.alias(name))
    return book.select(*columns)


def checked(book: DataFrame) -> list:
    """The rules, or an error: no two of a pack may share an id or an alias, and each pattern must compile."""
    found = completed(book).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names: set[str] = set()
    for r in found:
        if not r["id"] or not r["pattern"]:
            raise ValueError("a rule needs an id and a pattern")
        if r["severity"] not in rules.SEVERITIES:
            raise ValueError(f"{r['id']}: unknown severity {r['severity']}")
        if r["pack"] not in rules.PACKS:
            raise ValueError(f"{r['id']}: unknown pack {r['pack']}")
        for name in {f"{r['pack']}.{x}" for x in (r["id"], *r["aliases"])}:
            if name in names:
                raise ValueError(f"{name} is given twice")
            names.add(name)
        try:
            re.compile(r["pattern"], re.IGNORECASE | re.MULTILINE)
        except re.error as e:
            raise ValueError(f"{r['id']}: {e}") from e
    return found


#: Letters that the case-blind patterns take for ASCII ones, and lower() doesn't.
ALIKE = {"İ": "i", "ı": "i", "ſ": "s", "K": "k"}


class Matcher:
    """Compiled rules of a task."""

    def __init__(self, patterns: list[tuple[str, int]]):
        self.patterns, self.compiled = patterns, {}
        self.always: list[int] = []
        self.automaton = ahocorasick.Automaton()
        by_word: dict[str, list[int]] = {}
        for k, (pattern, _) in enumerate(patterns):
            words = required(pattern)
            if not words:
                self.always.append(k)
            for w in words:
                by_word.setdefault(w, []).append(k)
        for w, ks in by_word.items():
            self.automaton.add_word(w, (len(w), ks))
        if by_word:
            self.automaton.make_automaton()

    def tried(self, text: str) -> list[int]:
        """Numbers of the rules that may match."""
        lower = text
        if not text.isascii():
            for odd, plain in ALIKE.items():
                if odd in lower:
                    lower = lower.replace(odd, plain)
        found = set(self.always)
        if len(self.automaton):
            for _, (_, ks) in self.automaton.iter(lower.lower()):
                found.update(ks)
        return sorted(found)

    def matches(self, text: str) -> Iterator[tuple[int, str | None, int, int]]:
        """(rule, value, start, stop) of all matches; the value is the capture group, or the first group, or all."""
        for k in self.tried(text):
            pattern, group = self.patterns[k]
            if k not in self.compiled:
                self.compiled[k] = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
            regex = self.compiled[k]
            number = (group or 1) if regex.groups else 0
            for m in regex.finditer(text):
                yield k, m.group(number), m.start(), m.end()


def scan(docs: DataFrame, book: DataFrame, text: str = "content", around: int = 80) -> DataFrame:
    """docs without the text, with one row a match: rule (its row in `book`, as a struct), value, start, stop, line, before, whole, after, more.

    A null text has no matches; a group that takes no part gives a null value. An empty book gives no rows.
    """
    found = checked(book)
    kept = [c for c in docs.columns if c != text]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast([(r["pattern"], r["capture_group"]) for r in found])
    types = dict(docs.dtypes)
    fields = [f"`{c}` {types[c]}" for c in kept] + ["rule_no_ int", "value string", "start int", "stop int", "line int", "before string", "whole string", "after string", "more boolean"]
    names = [*kept, "rule_no_", "value", "start", "stop", "line", "before", "whole", "after", "more"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(sent.value)
        for batch in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for i, content in enumerate(batch[text]):
                if not isinstance(content, str):
                    continue
                ends: list[int] | None = None
                for k, value, start, stop in matcher.matches(content):
                    if ends is None:
                        ends = [m.start() for m in re.finditer("\n", content)]
                    rows.append(i)
                    out.append((k, value, start, stop, bisect.bisect_left(ends, start) + 1, content[max(0, start - around) : start], content[start:stop], content[stop : stop + around], stop + around < len(content)))
            if out:
                given = batch[kept].iloc[rows].reset_index(drop=True)
                for name, values in zip(names[len(kept) :], zip(*out, strict=True), strict=True):
                    given[name] = pd.Series(values, dtype=object if name in ("value", "before", "whole", "after") else None)
                yield given

    hits = docs.select(*kept, text).mapInPandas(run, ", ".join(fields))
    if not found:
        return hits.select(*kept, F.lit(None).cast(f"struct<{RULE.replace(' ', ':').replace(',:', ',')}>").alias("rule"), *names[len(kept) + 1 :])
    numbered = spark.createDataFrame([(k, r) for k, r in enumerate(found)], f"rule_no_ int, rule struct<{', '.join(x.replace(' ', ':', 1) for x in RULE.split(', '))}>")
    return hits.join(F.broadcast(numbered), "rule_no_").select(*kept, "rule", *names[len(kept) + 1 :])


def harmless(rule: Column, value: Column) -> Column:
    """Whether a match is no finding, by the rule's own least length and entropy and the guards that hold for some rules alone."""
    name = rule["id"]
    return (
        guards.placeholder(value, rule["min_length"])
        | ((name == "database_url") & guards.placeholder_db_url(value))
        | guards.local_url(value)
        | F.coalesce(guards.low_entropy(value, rule["min_entropy"]), F.lit(False))
        | ((name == "http_basic_auth") & (guards.local_basic_auth(value) | guards.template_marker(value)))
        | (name.isin("bearer_token", "openai_api_key", "stripe_secret_key") & guards.public_prefix(value))
    )


def findings(docs: DataFrame, book: DataFrame) -> DataFrame:
    """Findings of docs (doc_id, source, content) by the rules of a book: the first of each (rule, source, redacted value, line).

    detector_id is pack.id; type the rule's finding_type or id. doc_id, detector_id, type, severity, category,
    validation_status, source, line, redacted, snippet, start, value.
    """
    known = docs.select("doc_id", "source", "content", guards.client_side(F.col("content")).alias("client_side"))
    rule, value = F.col("rule"), F.col("value")
    found = scan(known, book).where(~harmless(rule, value)).withColumn("redacted", identity.redact_mask(value))
    cut_out = identity.redact_snippet(snippet(F.struct("start", "before", "whole", "after", "more")), value, F.col("redacted"))
    severity = F.when((rule["id"] == "gemini_api_key") & F.col("client_side"), "medium").otherwise(rule["severity"])
    kept = found.select(
        "doc_id", "source", "line", "redacted", F.concat_ws(".", rule["pack"], rule["id"]).alias("detector_id"),
        F.struct(
            "start", F.coalesce(rule["finding_type"], rule["id"]).alias("type"), severity.alias("severity"), rule["pack"].alias("category"), rule["validation_status"].alias("validation_status"),
            identity.pii_scrub_preserve(cut_out, F.col("redacted")).alias("snippet"), "value",
        ).alias("f"),
    )
    first = kept.groupBy("doc_id", "detector_id", "source", "redacted", "line").agg(F.min_by("f", "f.start").alias("f"))
    return first.select("doc_id", "detector_id", "f.type", "f.severity", "f.category", "f.validation_status", "source", "line", "redacted", "f.snippet", "f.start", "f.value")


def chosen(book: DataFrame, packs: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Rules of any of the packs, or all, that look at any of the categories, or all."""
    out = completed(book)
    if packs is not None:
        unknown = set(packs) - set(rules.PACKS)
        if unknown:
            raise ValueError(f"unknown packs: {sorted(unknown)}")
        out = out.where(F.col("pack").isin(packs))
    if categories:
        out = out.where(F.arrays_overlap("categories", F.array(*(F.lit(c.strip().lower()) for c in categories))))
    return out


def by_name(book: DataFrame) -> DataFrame:
    """name, detector_id, id: every pack.id and pack.alias with the rule it stands for."""
    each = completed(book).select("id", "pack", F.explode(F.concat(F.array("id"), "aliases")).alias("any"))
    return each.select(F.concat_ws(".", "pack", "any").alias("name"), F.concat_ws(".", "pack", "id").alias("detector_id"), "id")


def resolved(rows: DataFrame, book: DataFrame, column: str = "detector_id") -> DataFrame:
    """rows with old names in a column replaced by the rule's present one; names of no rule stay."""
    names = by_name(book).select(F.col("name").alias(column), F.col("detector_id").alias("now_"))
    joined = rows.join(F.broadcast(names), column, "left")
    return joined.select(*(F.coalesce("now_", column).alias(c) if c == column else c for c in rows.columns))
