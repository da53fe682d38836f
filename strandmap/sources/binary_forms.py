"""Binary form files: the module text among container bytes."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEYWORDS = re.compile(r"(?i)процедура|функция|procedure|function|#область|#region")


def _fragments(raw: bytes):
    for piece in re.split(rb"\x00+", raw):
        for encoding in ("utf-8-sig", "cp1251"):
            try:
                yield piece.decode(encoding)
                break
            except UnicodeDecodeError:
                continue


def module_text(raw: bytes) -> str:
    """The longest fragment with keywords, without the binary tail; deflated content is tried where there is none."""
    found = [f for f in _fragments(raw) if _KEYWORDS.search(f)]
    if not found:
        for start in (0, 2, 16):
            try:
                found = [f for f in _fragments(zlib.decompressobj(-15 if start else 15).decompress(raw[start:])) if _KEYWORDS.search(f)]
            except zlib.error:
                continue
            if found:
                break
    text = max(found, key=len, default="")
    return re.split("[\x01-\x08\x0e-\x1f]", text)[0].strip("﻿\r\n ")


@F.pandas_udf(T.StringType())
def extracted(raw: pd.Series) -> pd.Series:
    """The module text of each binary form; empty if there is none."""
    return raw.map(lambda r: module_text(bytes(r or b"")))
