"""Registry of named queries and their DuckDB oracles.

Each query module registers ``name -> fn(spark, sf_dir) -> DataFrame`` and,
where the semantics are expressible in SQL, the equivalent oracle SQL (built
lazily). ``__spark_entry__`` only exposes this registry.
"""

from __future__ import annotations

import importlib
from typing import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, Callable[[], str]] = {}

MODULES = [
    "tessera.plans.q_clean",
    "tessera.plans.q_quality",
    "tessera.plans.q_corrupt",
    "tessera.plans.q_enrich",
    "tessera.plans.q_weak",
    "tessera.plans.q_text",
    "tessera.plans.q_trajectory",
    "tessera.plans.q_standardize",
    "tessera.plans.q_streaming",
    "tessera.plans.q_extensions",
    "tessera.plans.q_demonstrations",
]


def register(name: str, sql: Callable[[], str] | str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql if callable(sql) else (lambda s=sql: s)
        return fn
    return deco


def load_all() -> None:
    for m in MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: f() for k, f in ORACLE.items()}
