"""Registry of checked queries: name -> (Spark callable(spark, sf_dir), oracle SQL or None).

Each query reads the driver tables through ``spotframe.sources.adapter`` and runs
library operators over the whole tables.  Double outputs are rounded to six
digits on both sides so order-insensitive value hashes are stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (value-hash stability)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> dict[str, tuple[Callable, str | None]]:
    # importing the modules fills REGISTRY
    from spotframe.plans import (  # noqa: F401
        relational_queries, marker_queries, slide_queries, lr_queries,
        composition_queries, iterative_queries, transport_queries, model_queries, graph_queries)
    return REGISTRY
