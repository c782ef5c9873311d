"""All queries of the library outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import advice_queries, document_queries, features, layout_queries, mart_queries, model_queries, rating_queries, registry_queries, scalar_queries, source_queries, text_queries, training_queries

_ALL = {**features.QUERIES, **scalar_queries.QUERIES, **mart_queries.QUERIES, **text_queries.QUERIES, **rating_queries.QUERIES, **document_queries.QUERIES, **layout_queries.QUERIES, **registry_queries.QUERIES, **source_queries.QUERIES, **training_queries.QUERIES, **advice_queries.QUERIES, **model_queries.QUERIES}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: text for name, (_, text) in _ALL.items() if text}
FLAGSHIP = "rating_features"
