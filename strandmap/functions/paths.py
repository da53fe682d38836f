"""Dotted paths as Column expressions: Head.Name(.Segment.Name)*."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def depth(path: Column) -> Column:
    """Number of dots."""
    return F.length(path) - F.length(F.replace(path, F.lit("."), F.lit("")))


def owner(path: Column) -> Column:
    """The first two segments."""
    return F.substring_index(path, ".", 2)


def head(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def parent(path: Column) -> Column:
    """The path without its last segment; empty for a single segment."""
    return F.regexp_replace(path, r"(^|\.)[^.]*$", "")


def is_root(path: Column) -> Column:
    return depth(path) == 1


def under(path: Column, prefix: str) -> Column:
    """Equal to the prefix or below it; never a sibling that starts alike."""
    return (path == prefix) | path.startswith(prefix + ".")


def strictly_under(path: Column, prefix: str) -> Column:
    """Below the prefix; pushed to Parquet as a prefix filter."""
    return path.startswith(prefix + ".")


def ancestors(path: Column) -> Column:
    """The path and all that stand above it, the nearest last."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def relative(path: Column, base: Column) -> Column:
    """What follows base and its dot; empty if the path is not below it."""
    return F.when(F.startswith(path, F.concat(base, F.lit("."))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(F.lit(""))


def help_owner(path: Column, heads: list[str]) -> Column:
    """Owner of a help page Help.A.B...: A.B where A is a known head, else empty."""
    parts = F.split(path, r"\.")
    return F.when((parts[0] == "Help") & F.get(parts, F.lit(1)).isin(heads) & F.get(parts, F.lit(2)).isNotNull(), F.concat_ws(".", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).otherwise(F.lit(""))


def method_parent(path: Column, marker: str = "Методы") -> Column:
    """What stands before the methods marker, else the path without its last segment."""
    cut = F.substring_index(path, f".{marker}.", 1)
    return F.when(cut != path, cut).otherwise(parent(path))


@F.pandas_udf(T.StringType())
def nfc(path: pd.Series) -> pd.Series:
    """Names of files in composed form, in which exports and file systems agree; Spark has no function for it."""
    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", p))
