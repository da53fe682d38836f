"""Plans that the design promises: pushed filters, pruned columns, few exchanges."""

from pyspark.sql import functions as F

from strandmap import adapters
from strandmap.operators import intervals, lookup, ranking, rollups
from strandmap.plans import retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_reaches_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "o")
    spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("Customer."), "c_name").alias("path"), F.lit("Customer").alias("kind"), F.col("c_mktsegment").alias("comment")).write.parquet(path)
    text = plan(lookup.filter_objects(spark.read.parquet(path), prefix="Customer.X", kind="Customer").select("path"))
    assert "StringStartsWith(path,Customer.X.)" in text and "EqualTo(kind,Customer)" in text and "comment" not in text


def test_bm25_shuffles_nothing(spark, sf):
    hits = retrieval.bm25(spark.read.parquet(f"{sf}/documents.parquet"), retrieval.query_terms("than heon"))
    assert "Exchange" not in plan(hits.select("doc_id", "raw_score")) and "Generate" not in plan(hits)


def test_interval_join_is_an_equi_join(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    text = plan(intervals.within(e, e.withColumnRenamed("event_id", "other"), ["user_id"], "at", 1000))
    assert "NestedLoop" not in text and "Cartesian" not in text and "_bucket" in text


def test_rollup_aggregates_before_it_shuffles(spark, sf):
    stats = rollups.tool_stats(spark.read.parquet(f"{sf}/events.parquet"), "event_type", F.col("value") > 400, "value")
    assert plan(stats).count("partial_count") >= 1 and plan(stats).count("Exchange") == 1


def test_context_cap_hands_on_first_hits_only(spark, sf):
    hits = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    assert "WindowGroupLimit" in plan(ranking.cap_contexts(hits, "lang", 20, 4, F.desc("n_chars"), F.col("doc_id"), key="doc_id"))


def test_stored_objects_are_pruned_by_kind_and_path(spark, sf):
    text = plan(lookup.filter_objects(adapters.objects(spark, sf), kind="Customer", prefix="Customer.C").select("path"))
    assert "PartitionFilters: [isnotnull(kind" in text and "StringStartsWith(path,Customer.C.)" in text and "comment" not in text


def test_names_are_pruned_by_their_folded_form(spark, sf):
    text = plan(lookup.exact_names(adapters.object_names(spark, sf), ["germany", "FRANCE"]).select("path"))
    assert "In(folded, [france,germany])" in text and "In(name, [" in text and "comment" not in text
    text = plan(lookup.identifier(adapters.objects(spark, sf), "Nation.PERU", adapters.object_names(spark, sf)).select("path"))
    assert "EqualTo(folded,nation.peru)" in text and "EqualTo(path,Nation.PERU)" in text


def test_first_values_are_bounded(spark):
    rows = spark.range(3000).selectExpr("id % 2 AS g", "concat('v', id % 500) AS v")
    found = rollups.with_first(rows, ["g"], "v", 3)
    assert {(r.g, r.n, tuple(r["first"])) for r in found.collect()} == {(0, 1500, ("v0", "v10", "v100")), (1, 1500, ("v1", "v101", "v103"))}
    assert "WindowGroupLimit" in plan(found)


def test_whole_searches_store_nothing(spark, sf, monkeypatch):
    """One pass over all objects or links reads the tables; stored forms would cost more than the search."""
    from strandmap import catalog, store

    monkeypatch.setattr(store, "once", lambda *a: 1 / 0)
    for name in ("token_search_short", "token_and_search_middle", "orphan_links_anti", "token_and_search", "links_semi", "usage_histogram"):
        assert catalog.QUERIES[name](spark, sf).columns


def test_lines_without_a_whole_key_count_once(spark, sf, tmp_path):
    """Links are distinct as paths, also where a key is null."""
    import os

    for t in ("region", "nation", "customer", "supplier", "orders"):
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    lines = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    spark.createDataFrame([(None, 1, 5, 1), (None, 2, 5, 1), (7, 1, 5, 1), (7, 1, 5, 1)], lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    made = adapters.made_links(spark, str(tmp_path)).where("to_path = 'Part.5'").collect()
    assert sorted(str(r.from_path) for r in made) == ["None", "Order.7.Lines.1"]
