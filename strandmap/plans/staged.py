"""Recall in stages: cheap lanes first, costlier ones only while there are too few strong hits.

A stage is a filter over rows; it runs when all cheaper ones have left fewer
than ``enough`` strong hits. Help pages are the last stage, so a question that
names objects well never reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.functions import paths
from strandmap.operators import lookup, relations
from strandmap.plans import lanes, query_text
from strandmap.plans.retrieval import RankProfile, rerank
from strandmap.session import cut


@dataclass(frozen=True)
class Stage:
    name: str
    cost: int
    find: Callable[[], DataFrame]  # rows with lane and raw_score


@dataclass(frozen=True)
class Recall:
    """hits of the stages that ran, each path by its first stage; stages names them, skipped those that weren't needed."""

    hits: DataFrame
    stages: tuple[str, ...]
    skipped: tuple[str, ...]


def run(stages: list[Stage], strong: Callable[[DataFrame], int], enough: int) -> Recall:
    """Run stages by rising cost until ``enough`` strong hits are found; the hits of each are kept, so later ones don't read for them again."""
    found: list[DataFrame] = []
    order = sorted(stages, key=lambda s: s.cost)
    for i, stage in enumerate(order):
        found.append(cut(stage.find()))
        if strong(found[-1] if len(found) == 1 else relations.prefer_first(*found)) >= enough:
            return Recall(relations.prefer_first(*found), tuple(s.name for s in order[: i + 1]), tuple(s.name for s in order[i + 1 :]))
    return Recall(relations.prefer_first(*found), tuple(s.name for s in order), ())


def recall(objects: DataFrame, query: str, kind: str | None = None, prefix: str | None = None, profile: RankProfile | None = None, kinds: Mapping[str, str] | None = None, help_pages: DataFrame | None = None, enough: int = 2) -> Recall:
    """Objects (path, kind, name, synonym, comment) that lanes find for a question, and help pages where these are too few.

    ``kinds`` maps beginnings of words to kinds: a quoted name behind such a word
    is looked for outright. A question for reports without a prefix looks below
    all reports and keeps their roots. A strong hit is a root that covers two
    content words or more, or the only one there is.
    """
    kind, prefix, roots = lookup.report_scope(kind, prefix)
    rows = lookup.filter_objects(objects, kind=kind, prefix=prefix)
    rows = rows.where(paths.is_root(F.col("path"))) if roots else rows
    lane, score = lanes.lane_of(query, prefix, profile)
    laned = rows.withColumn("lane", lane).withColumn("raw_score", score)
    typed = query_text.typed_entities(query, kinds or {})
    named_outright = reduce(lambda a, b: a | b, ((F.col("kind") == k) & (F.col("name") == n) for k, n in typed), F.lit(False))

    def in_lanes(*names: str) -> Callable[[], DataFrame]:
        return lambda: laned.where(F.col("lane").isin(*names))

    def names() -> DataFrame:
        outright = rows.where(named_outright).withColumn("lane", F.lit("identifier")).withColumn("raw_score", F.lit(5.0))
        return relations.prefer_first(outright, laned.where(F.col("lane").isin("identifier", "name")))

    stages = [Stage("names", 1, names), Stage("stems", 2, in_lanes("stem", "inside")), Stage("tokens", 4, in_lanes("tokens"))]
    if help_pages is not None and kind in (None, "Help"):
        stages.append(Stage("help", 8, lambda: lanes.lanes(help_pages, query, None, profile)))
    return run(stages, lambda hits: lanes.strong_hits(hits, query, enough), enough)


def search(objects: DataFrame, query: str, limit: int = 20, **how) -> DataFrame:
    """The best of what ``recall`` finds, re-ranked, with the stages that ran."""
    found = recall(objects, query, **how)
    best = rerank(found.hits, query, how.get("profile")).orderBy(F.desc("score"), "path").limit(limit)
    return best.withColumn("stages", F.lit(",".join(found.stages)))
