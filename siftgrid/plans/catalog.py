"""Imports every module that registers queries."""

from siftgrid.plans import baas_queries, capture_queries, context_queries, core_queries, exchange_queries, finding_queries, report_queries, rule_queries, rulebook_queries, supply_queries, web_queries  # noqa: F401
