"""Registry of checked queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the given tables
(or frames Spark derives from them).  Oracle SQL runs in DuckDB on the same parquet files;
column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder under ``name`` with its oracle SQL (``None`` = rows-only check)."""
    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from . import queries_profile  # noqa: F401
    from . import queries_clean  # noqa: F401
    from . import queries_features  # noqa: F401
    from . import queries_eval  # noqa: F401
    from . import queries_text  # noqa: F401
    from . import queries_io_models  # noqa: F401
    from . import queries_checks  # noqa: F401
