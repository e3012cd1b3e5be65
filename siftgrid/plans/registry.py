"""Collects the queries of every module that registers some."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Decorator: register fn(spark, sf_dir) under `name`, with its DuckDB SQL if there is one."""

    def keep(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return keep


def _load() -> None:
    from siftgrid.plans import catalog  # noqa: F401  registers on import


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_ORACLES)
