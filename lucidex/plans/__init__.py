"""Registered queries and their SQL."""

from . import body, catalogue, graph, records, retrieval, text  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return QUERIES


def sql() -> dict:
    return SQL
