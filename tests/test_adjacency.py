"""Walks over bucketed links against walks over plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from strandmap import adapters, store
from strandmap.catalog import QUERIES
from strandmap.functions import paths
from strandmap.plans import adjacency, graph

LINKS = "from_path string, to_path string, link_type string"


def random_links(n=160, objects=40, seed=2):
    rng = random.Random(seed)
    name = lambda: f"A.N{rng.randrange(objects)}"
    return sorted({(name() + rng.choice(["", ".R.F", ".T.S.R.G"]), name(), rng.choice(["type", "calls"])) for _ in range(n)})


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = random_links()
    path = str(tmp_path_factory.mktemp("adjacency") / "l")
    plain = spark.createDataFrame(rows, LINKS)
    adjacency.build(plain, path, buckets=4)
    return rows, plain, adjacency.load(spark, path)


@pytest.mark.parametrize("literals", [256, 2])
def test_walks_agree(stored, monkeypatch, literals):
    monkeypatch.setattr(adjacency, "LITERALS", literals)
    _, plain, near = stored
    pick = lambda df: sorted(map(tuple, df.collect()))
    for start in ("A.N7",):
        assert pick(graph.impact(near, start, 3)) == pick(graph.impact(plain, start, 3))
        assert pick(graph.impact(near, start, 2, down=False)) == pick(graph.impact(plain, start, 2, down=False))
        assert pick(graph.reach(near, start, 4)) == pick(graph.reach(plain, start, 4))
        assert pick(graph.reach(near, start, 3, callers=True, link_type="calls")) == pick(graph.reach(plain.where("link_type = 'calls'"), start, 3, callers=True))
    assert graph.impact(near, "A.N1", 0).count() == 0 and graph.reach(near, "A.Nowhere", 3).count() == 0


def test_short_frontiers_read_their_buckets(spark, stored):
    _, _, near = stored
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # pruned either way, but only then told by the plan
    try:
        text = near.met(spark.createDataFrame([("A.N1",)], "node string"), "to_path")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in text


def test_long_frontiers_join_by_bucket(spark, stored, monkeypatch):
    monkeypatch.setattr(adjacency, "LITERALS", 1)
    _, _, near = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = near.of_owners(spark.range(40).select(F.concat(F.lit("A.N"), "id").alias("node")), "to_path")
        text = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Links, which stand first, are read bucket by bucket; what is shuffled is the frontier.
    assert "SelectedBucketsCount: 4 out of 4" in text and "Exchange" not in text[: text.index("SelectedBucketsCount")]


def brute_length(rows, source, target):
    own = lambda p: ".".join(p.split(".")[:2])
    edges = {}
    for a, b, _ in rows:
        edges.setdefault(own(a), set()).add(own(b))
        edges.setdefault(own(b), set()).add(own(a))
    frontier, seen, n = {source}, {source}, 0
    while frontier:
        if target in frontier:
            return n
        frontier = {y for x in frontier for y in edges.get(x, ())} - seen
        seen |= frontier
        n += 1
    return None


def test_paths_between_objects(spark, stored):
    rows, plain, near = stored
    told = {(a, b, t) for a, b, t in rows}
    own = lambda p: ".".join(p.split(".")[:2])
    for source, target in (("A.N1", "A.N2"), ("A.N3", "A.N30"), ("A.N11", "A.N29")):
        found = graph.path_between(near, source, target, most=8).orderBy("hop").collect()
        assert len(found) == brute_length(rows, source, target)
        at = source
        for r in found:
            assert r.from_object == at and (r.from_path, r.to_path, r.link_type) in told
            ends = (own(r.from_path), own(r.to_path))
            assert (r.from_object, r.to_object) == (ends if r.direction == "forward" else ends[::-1])
            at = r.to_object
        assert at == target
        assert [tuple(r) for r in graph.path_between(plain, source, target, most=8).orderBy("hop").collect()] == [tuple(r) for r in found]
    assert graph.path_between(near, "A.N1", "A.N1").count() == 0 and graph.path_between(near, "A.N1", "B.Nowhere").count() == 0


def test_a_path_may_be_too_long(spark):
    chain = spark.createDataFrame([(f"A.N{i}", f"A.N{i + 1}", "type") for i in range(5)], LINKS)
    assert graph.path_between(chain, "A.N0", "A.N5", most=4).count() == 0 and graph.path_between(chain, "A.N5", "A.N0", most=5).count() == 5


def test_fallbacks_and_containers(spark):
    links = spark.createDataFrame([("A.X.ТабличныеЧасти.Rows.Реквизиты.Item", "A.Y", "type"), ("A.X.Реквизиты.Owner", "A.Y", "type"), ("A.Y.Реквизиты.Z", "A.Z", "type")], LINKS)
    found = graph.query_paths(links, links, "A.X", ["A.Y", "A.Z", "A.W"])
    assert {(r.field, r.container) for r in found["A.Y"].collect()} == {("ТабличныеЧасти.Rows.Реквизиты.Item", "Rows"), ("Реквизиты.Owner", "")}
    assert [(r.from_object, r.to_object, r.direction) for r in found["A.Z"].orderBy("hop").collect()] == [("A.X", "A.Y", "forward"), ("A.Y", "A.Z", "forward")]
    assert found["A.W"].count() == 0


def headed(links):
    return adjacency.Derived(links.withColumns({"from_head": paths.head(F.col("from_path")), "to_head": paths.head(F.col("to_path"))}))


@pytest.mark.parametrize(("literals", "broadcast"), [(256, 100_000), (2, 100_000), (2, 2)])
def test_walks_over_derived_links_agree(stored, monkeypatch, literals, broadcast):
    monkeypatch.setattr(adjacency, "LITERALS", literals)
    monkeypatch.setattr(adjacency, "BROADCAST_NODES", broadcast)
    _, plain, _ = stored
    made = headed(plain)
    pick = lambda df: sorted(map(tuple, df.collect()))
    assert pick(graph.impact(made, "A.N7", 3)) == pick(graph.impact(plain, "A.N7", 3))
    assert pick(graph.impact(made, "A.N7", 2, down=False)) == pick(graph.impact(plain, "A.N7", 2, down=False))
    assert pick(graph.reach(made, "A.N7", 3, callers=True, link_type="calls")) == pick(graph.reach(plain, "A.N7", 3, callers=True, link_type="calls"))
    assert pick(graph.path_between(made, "A.N3", "A.N30", most=8)) == pick(graph.path_between(plain, "A.N3", "A.N30", most=8))
    assert graph.impact(made, "A.N1", 0).count() == 0 and graph.reach(made, "B.Nowhere", 3).count() == 0


def test_null_paths_meet_nothing(spark, tmp_path):
    plain = spark.createDataFrame([("A.X", "A.Y", "type"), ("A.X", None, "type"), ("A.Y", "A.Z", "type"), (None, "A.Z", "type")], LINKS)
    adjacency.build(plain, str(tmp_path / "l"), buckets=2)
    want = {("A.Y", 1), (None, 1), ("A.Z", 2)}
    for links in (plain, headed(plain), adjacency.load(spark, str(tmp_path / "l"))):
        assert {(r.path, r.depth) for r in graph.impact(links, "A.X", 3, down=False).collect()} == want


def test_buckets_grow_with_the_links(spark, stored, tmp_path, monkeypatch):
    rows, plain, _ = stored
    monkeypatch.setattr(adjacency, "BUCKET_LINKS", 4, raising=False)
    adjacency.build(plain, str(tmp_path / "l"))
    files = {f.name.split("_")[-1] for f in (tmp_path / "l" / "leaving").glob("part-*")}
    assert len(rows) > 120 and len(files) > 16


@pytest.mark.parametrize("name", ["impact_up", "impact_bfs", "call_chain_bfs", "path_over_objects"])
def test_one_walk_stores_no_links(spark, sf, tmp_path, name):
    (tmp_path / "sf").symlink_to(sf)
    d = str(tmp_path / "sf")
    QUERIES[name](spark, d).count()
    assert not {key for key in store._BUILT if key[1] == d}


def test_a_step_reads_the_kinds_of_its_frontier(spark, sf):
    frontier = spark.createDataFrame([("Customer.Customer#000000001",), ("Nation.NATION_1",)], "node string")
    near = adapters.walkable_links(spark, sf)
    plan = near.met(frontier, "from_path")._jdf.queryExecution().optimizedPlan().toString()
    assert "c_name" in plan and "n_name" in plan and "l_orderkey" not in plan and "o_orderkey" not in plan
    plan = near.met(frontier, "to_path")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" in plan and "s_name" in plan and "l_orderkey" not in plan
