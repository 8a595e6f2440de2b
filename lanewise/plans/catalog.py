"""Registry of the engine's queries and their oracle SQL, gathered from the query modules beside it."""

from __future__ import annotations

import importlib
import pkgutil

from lanewise import plans


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            yield importlib.import_module(f"{plans.__name__}.{info.name}")


def queries() -> dict:
    """All queries: name to callable of (spark, sf_dir)."""
    out: dict = {}
    for module in _modules():
        out |= {name: query for name, (query, _) in module.QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    """Oracle SQL of the queries that have one."""
    out: dict[str, str] = {}
    for module in _modules():
        out |= {name: sql for name, (_, sql) in module.QUERIES.items() if sql}
    return out
