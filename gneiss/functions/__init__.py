"""Scalar functions of the engine: column expressions that run in the JVM."""

from gneiss.operators.text import (
    asks_for_tests,
    heuristic_tokens,
    index_terms,
    intent_score,
    is_code,
    is_container_kind,
    is_declared_kind,
    is_function_kind,
    is_test_path,
    is_test_symbol,
    language_of,
    node_id,
    node_type,
    path_prior,
)
from gneiss.operators.vectors import dot, parsed_vector

__all__ = [
    "asks_for_tests",
    "dot",
    "heuristic_tokens",
    "index_terms",
    "intent_score",
    "is_code",
    "is_container_kind",
    "is_declared_kind",
    "is_function_kind",
    "is_test_path",
    "is_test_symbol",
    "language_of",
    "node_id",
    "node_type",
    "parsed_vector",
    "path_prior",
]
