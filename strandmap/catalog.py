"""Registry of the engine's queries over the test tables and of their SQL."""

from __future__ import annotations

from strandmap import adapters
from strandmap.queries import extras, lookups, parsers, relations, retrieval, rollups

QUERIES: dict = lookups.QUERIES | relations.QUERIES | rollups.QUERIES | retrieval.QUERIES | parsers.QUERIES | extras.QUERIES
ORACLE_SQL: dict = lookups.ORACLE_SQL | relations.ORACLE_SQL | rollups.ORACLE_SQL | retrieval.ORACLE_SQL | parsers.ORACLE_SQL | extras.ORACLE_SQL


def flagship(spark, sf_dir: str):
    """Who uses each object, by owner: links, two partial aggregations, bounded samples."""
    return QUERIES["usages_by_owner"](spark, sf_dir)


def prepare(spark, sf_dir: str) -> None:
    """Build the stored forms that several queries read; without it the first query that needs one builds it."""
    for build in (adapters.objects, adapters.links, adapters.object_names, adapters.object_substrings, adapters.document_substrings, retrieval.documents_index, retrieval.vectors_index):
        build(spark, sf_dir)
