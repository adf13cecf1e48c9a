"""All queries over the driver's tables, with the SQL that each must agree with."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with the oracle's SQL over ``{views}``."""
    from .views import oracle

    def keep(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return keep


for _module in ("quality", "text", "script", "audio", "state", "html", "streams"):
    import_module(f"{__package__}.{_module}_queries")
