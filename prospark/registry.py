"""Name -> query, and name -> the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


from .plans import accounts, audience, contacts, crm, establishments, identity, prospects, quotas, register, sector, store, texts, values  # noqa: E402, F401
from .streaming import audience as _streams  # noqa: E402, F401
from .sinks import rollup as _rollup  # noqa: E402, F401
from .streaming import presence as _presence  # noqa: E402, F401
