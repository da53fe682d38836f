"""The substring index against plain filters."""

import random

import pytest
from pyspark.sql import functions as F

from strandmap.operators import lookup
from strandmap.plans import cards, segments, substring_index


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice("abcАБё. 漢😀\n") for _ in range(rng.randint(0, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, body string")


NEEDLES = ["abc", "ABC", "ёАб", "abca", "a", "ab", "漢😀", "😀漢a", "c.c", "zzz", "абё", "a" * 12, "bca ", "\n"]


def hits(df, needle):
    return sorted(r.id for r in df.where(F.lower("body").contains(needle.lower())).select("id").collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = rows_of(800) + [(900, None), (901, ""), (902, "abcabcabc" * 50), (903, "a" * 40)]
    return rows, substring_index.build(frame(spark, rows), str(tmp_path_factory.mktemp("s") / "i"), "id", F.col("body"), ["body"])


@pytest.mark.parametrize("needle", NEEDLES)
def test_candidates_lose_nothing(spark, built, needle):
    rows, index = built
    assert hits(index.likely([needle]), needle) == hits(frame(spark, rows), needle)
    assert sorted(r.id for r in lookup.with_substring(index, "body", needle).collect()) == sorted(i for i, b in rows if b and needle in b)


def test_several_needles_are_met_together(spark, built):
    rows, index = built
    want = sorted(i for i, b in rows if b and "abc" in b.lower() and "漢" in b and "бё" in b.lower())
    test = F.lower("body").contains("abc") & F.col("body").contains("漢") & F.lower("body").contains("бё")
    assert sorted(r.id for r in index.containing(["abc", "漢", "бё"], test).collect()) == want
    assert index.likely(["nowhere", "abc"]).count() == 0


def test_references_from_candidates(spark, built):
    rows, index = built
    pick = lambda df: sorted(map(tuple, df.select("id", "nth", "line").collect()))
    assert pick(cards.references(index, "abc", "id", "body")) == pick(cards.references(frame(spark, rows), "abc", "id", "body"))


def test_blocks_without_candidates_are_not_read(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would make one block of so few rows
    try:
        index = substring_index.build(frame(spark, [(i, f"common text {'needle' if i == 7 else i}") for i in range(400)]), str(tmp_path / "i"), "id", F.col("body"), ["body"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.live.read("rows").select("block").distinct().count() > 1
    ((_, keys),) = index.candidates(["needle"])
    assert [(r.id) for r in keys.collect()] == [7]
    text = index.likely(["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in text and "EqualTo" not in text.split("DataFilters")[0]
    assert len(index._rarest(substring_index.grams("common text").tolist())[0]) == substring_index.MOST_GRAMS


def test_edits_and_compaction(spark, built, monkeypatch):
    rows, index = built
    changed = [(1, "fresh abc"), (2, "gone"), (950, "new needle abc")]
    later = substring_index.update(index, F.col("body"), frame(spark, changed), spark.createDataFrame([(902,)], "id long"))
    live = [r for r in rows if r[0] not in (1, 2, 902)] + changed
    monkeypatch.setattr(segments, "MERGE_SHARE", 0.0)
    merged = substring_index.compact(later)
    assert merged.live.total("rows") == len(live) and len(merged.live.state["segments"]) == 1
    for needle in NEEDLES[:5] + ["needle"]:
        want = hits(frame(spark, live), needle)
        assert hits(later.likely([needle]), needle) == want and hits(merged.likely([needle]), needle) == want
    assert hits(substring_index.load(spark, index.live.root, 1).likely(["abc"]), "abc") == hits(frame(spark, rows), "abc")


def test_empty(spark, tmp_path):
    index = substring_index.build(frame(spark, []), str(tmp_path / "i"), "id", F.col("body"), ["body"])
    assert index.likely(["abc"]).count() == 0 and index.likely(["a"]).count() == 0
