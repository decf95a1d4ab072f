"""Name -> query and name -> oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = (
    "catalog", "text", "numeric", "text_features", "vectors", "labels", "probabilities",
    "models", "evaluation", "experiments", "pixels", "scoring", "fusion",
)


def query(name: str, oracle: str | None = None, ints: Iterable[str] = (), longs: Iterable[str] = ()):
    """Register a query; without an oracle only its rows are checked.

    ``ints`` and ``longs`` name oracle columns that are cast to the width Spark returns.
    """
    casts = [f'"{c}"::INTEGER AS "{c}"' for c in ints] + [f'"{c}"::BIGINT AS "{c}"' for c in longs]
    if oracle is not None and casts:
        oracle = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({oracle})"

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"merchlens.plans.{module}")
