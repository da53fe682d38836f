"""Hybrid search: full text, vectors and lanes in one pool, re-ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import paths
from strandmap.plans.index import TextIndex
from strandmap.plans.lanes import lane_of
from strandmap.plans.vector_index import VectorIndex
from strandmap.plans.retrieval import RankProfile, bm25, cosine, fuse, query_terms, rerank, top

#: Hits that each leg gives to the pool.
POOL = 200
_META = ("context", "path", "kind", "name", "synonym", "comment")


def keyed(corpus: DataFrame) -> DataFrame:
    """A corpus with the key of its objects; an index of one chunk an object may have it too."""
    return corpus.withColumn("_key", F.concat_ws("\n", "context", "path"))


def _best_chunk(hits: DataFrame) -> DataFrame:
    """(_key, _row, raw_score): of each object its best chunk alone, the first of equals, so that objects of many chunks gather no ranks."""
    best = F.min_by(F.struct("_row", "raw_score"), F.struct(-F.col("raw_score"), F.col("_row"))).alias("_best")
    return hits.groupBy("_key").agg(best).select("_key", "_best._row", "_best.raw_score")


def search(corpus: DataFrame | TextIndex, query: str, k: int = 20, vector: list[float] | None = None, prefix: str | None = None, kind: str | None = None, contexts: list[str] | None = None, profile: RankProfile | None = None, pool: int = POOL, with_lanes: bool = True, expand_from: int | None = 6, vectors: VectorIndex | None = None) -> DataFrame:
    """Hybrid search over passages (context, path, kind, name, synonym, comment, text and, with a vector, embedding), or over an index of them.

    A passage is a chunk of the object that context and path name; an object
    takes the rank of its best chunk in each leg. Filters come before any top-k.
    The full-text and the vector leg give a pool of objects each, fused by
    reciprocal ranks; what lanes find by names and tokens joins the pool whole,
    without a raw score. All of it is re-ranked and the best k are numbered.
    Words of ``expand_from`` letters or more match as prefixes. An index has to
    carry context, kind and path. With ``vectors``, an index with the same keys,
    the vector leg reads candidates there.
    """
    profile = profile or RankProfile()
    index = corpus if isinstance(corpus, TextIndex) else None
    where = F.lit(True)
    if contexts is not None:
        where &= F.col("context").isin(contexts)
    if kind is not None:
        where &= F.col("kind") == kind
    if prefix is not None:
        where &= paths.under(F.col("path"), prefix)
    filtered = contexts is not None or kind is not None or prefix is not None
    terms = query_terms(query, expand_from=expand_from, aliases=profile.aliases)
    # keyed() replaces a key of the corpus itself, so a corpus and an index of it agree.
    identity = lambda df: keyed(df.withColumn("_row", F.col(index.key) if index else F.concat_ws("\n", "context", "path")))
    if index is None:
        rows = identity(corpus).where(where)
        lexical = bm25(rows, terms)
    else:
        rows = identity(index.docs).where(where)
        lexical = identity(index.bm25(terms, where if filtered else None))
    legs = [top(_best_chunk(lexical), pool, "_row")]
    if vector is not None:
        if vectors is None:
            near = cosine(rows, vector)
        else:
            # A vector that stands for none of the rows takes no place in the pool.
            found = vectors.search(vector, pool, rows.select(F.col("_row").alias(vectors.key)))
            near = rows.join(F.broadcast(found.withColumnRenamed(vectors.key, "_row")), "_row")  # the pool's rows
        legs.append(top(_best_chunk(near), pool, "_row"))
    fused = F.broadcast(fuse(legs, "_key", pool, tie="_row"))  # some hundred rows
    lane = lane_of(query, prefix, profile)[0] if with_lanes else F.lit(None).cast("string")
    hits = rows.select("_key", "_row", *_META, lane.alias("lane")).join(fused, "_key", "left").where(F.col("score").isNotNull() | F.col("lane").isNotNull())
    first = F.min_by(F.struct(*_META, "lane", "score", "_row"), F.struct(F.col("lane").isNull(), F.col("_row"))).alias("_first")
    hits = hits.groupBy("_key").agg(first).select("_key", "_first.*").withColumn("raw_score", F.coalesce("score", F.lit(0.0))).drop("score")
    out = rerank(hits, query, profile, help_owners=kind is None).orderBy(F.desc("score"), F.desc("raw_score"), "_row").limit(k)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("raw_score"), "_row"))).drop("_key", "_row")
