"""Queries of rules as rows."""

from __future__ import annotations

from siftgrid.operators import rulebook
from siftgrid.plans.core_queries import ENTROPY_SQL, lines_sql, mask_sql, placeholder_sql
from siftgrid.plans.registry import query
from siftgrid.sources import tables as T
from siftgrid.sources.tables import sql_text

#: A user's own rules: id, pattern, severity, pack, type, shortest value, group, least entropy, old names.
MINE = [
    ("my_token", r"token = \"([0-9a-f]{40})", "high", "leak", "internal_token", 20, 1, 3.0, ["old_token"]),
    ("my_bearer", r"bearer ([0-9a-f]{32})\.([0-9a-f]{32})", "critical", "authn", None, 8, 2, 3.7, []),
    ("my_host", r"host (192\.168\.\d+\.\d+)", "low", "recon", None, 13, 0, None, []),
]
MINE_SCHEMA = "id string, pattern string, severity string, pack string, finding_type string, min_length int, capture_group int, min_entropy double, aliases array<string>"


def mine_sql() -> str:
    parts = []
    for name, pattern, severity, pack, kind, least, group, entropy, _ in MINE:
        dense = f" and {ENTROPY_SQL} >= {entropy} - 1e-12" if entropy else ""
        parts.append(
            f"select distinct doc_id, '{pack}.{name}' as detector_id, '{kind or name}' as type, '{severity}' as severity, '{pack}' as category, line::int as line, {mask_sql('value')} as redacted "
            f"from (select doc_id, line, unnest(regexp_extract_all(txt, {sql_text('(?i)' + pattern)}, {group or 1})) as value from lines) where not {placeholder_sql(least)}{dense}"
        )
    return " union all ".join(parts)


@query("udf_detector", f"with {T.PLANTED_SQL}, {lines_sql('planted')} {mine_sql()}")
def udf_detector(spark, sf_dir):
    """A user's rules are rows beside the shipped ones; each has its own least length and entropy, group, type and old names."""
    mine = spark.createDataFrame(MINE, MINE_SCHEMA)
    found = rulebook.findings(T.planted(spark, sf_dir), rulebook.completed(mine))
    return found.select("doc_id", "detector_id", "type", "severity", "category", "line", "redacted")
