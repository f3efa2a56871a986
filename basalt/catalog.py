"""Registered queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.plans import addresses, candidates, documents, hosts, intake, keyed, labels, models, modules, reads, scans, sessions, source_maps, specs, technologies, views

Query = Callable[[SparkSession, str], DataFrame]

_ALL = scans.QUERIES | models.QUERIES | labels.QUERIES | reads.QUERIES | intake.QUERIES | technologies.QUERIES | specs.QUERIES | modules.QUERIES | keyed.QUERIES | source_maps.QUERIES | addresses.QUERIES | documents.QUERIES | candidates.QUERIES | views.QUERIES | hosts.QUERIES | sessions.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _ALL.items() if text}
