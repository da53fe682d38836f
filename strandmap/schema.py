"""Schemas of the engine's frames. Strings are never null: an empty string means absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECTS = T.StructType.fromDDL("entity_id long, path string, kind string, name string, synonym string, comment string, belong string, source_rel string, content_hash string, parse_gen long, props map<string,array<string>>")
LINKS = T.StructType.fromDDL("entity_id long, from_path string, to_ref string, link_type string")
METHODS = T.StructType.fromDDL("path string, parent_path string, module_role string, name string, kind string, export boolean, signature string, comment string, body string, region string, line int, end_line int")
HITS = T.StructType.fromDDL("context string, path string, kind string, name string, raw_score double, score double, rank int")


def no_nulls(df: DataFrame) -> DataFrame:
    """Empty strings for null ones, at the boundary of the engine."""
    return df.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields))
