"""Embeddings for passages: any function from texts to vectors, by default one that hashes words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandmap.session import ship

#: Texts that a function gets at a time.
REQUEST = 256


def hashed(texts: list[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of signed, hashed word counts: no model, no network, the same everywhere; zeros for no words."""
    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        for word in re.findall(r"[^\W_]+", text.lower()):
            h = hashlib.blake2b(word.encode(), digest_size=8).digest()
            out[i, int.from_bytes(h[:4], "big") % size] += 1 if h[4] & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def embed(passages: DataFrame, text: str = "text", function: Callable[[list[str]], list[list[float]]] = hashed, prefix: str = "") -> DataFrame:
    """``passages`` with embedding; the function runs in the tasks, at most ``REQUEST`` texts a call, failures tried thrice."""
    ship(passages.sparkSession)
    schema = T.StructType(list(passages.schema.fields)).add("embedding", T.ArrayType(T.FloatType()))

    def run(batches):
        for batch in batches:
            texts = [prefix + (t or "") for t in batch.column(text).to_pylist()]
            vectors = []
            for i in range(0, len(texts), REQUEST):
                for attempt in range(3):
                    try:
                        vectors += function(texts[i : i + REQUEST])
                        break
                    except OSError:
                        if attempt == 2:
                            raise
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return passages.mapInArrow(run, schema)
