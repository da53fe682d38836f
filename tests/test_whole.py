"""Queries and operators that have to do the whole job."""

from pyspark.sql import functions as F

from strandmap import catalog, ingest
from strandmap.functions import text


def test_tags_read_all_events(spark, sf):
    tags = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type").collect():
        if r.event_type in ("error", "purchase"):
            tags.setdefault(r.user_id, set()).add(r.event_type)
    want = {user: len(t) for user, t in tags.items()}
    assert dict(map(tuple, catalog.QUERIES["tags_any"](spark, sf).select("user_id", "n_tags").collect())) == want
    assert dict(map(tuple, catalog.QUERIES["tags_all"](spark, sf).select("user_id", "n_tags").collect())) == {user: n for user, n in want.items() if n == 2}


def test_windows_cover_the_text(spark):
    long = "".join(chr(97 + i % 23) for i in range(40_000))
    df = spark.createDataFrame([("A", "A", "", "", long), ("B", "B", "", "", ""), ("C", "C", "", "", None)], "path string, name string, synonym string, comment string, body string")
    pieces = df.where("path = 'A'").select(text.windows(F.col("body"), 1100, 130).alias("w")).first().w
    assert pieces[0] + "".join(p[130:] for p in pieces[1:]) == long
    got = {(r.path, r.ord): r.text for r in ingest.passages(df).collect()}
    assert {p: sum(q == p for q, _ in got) for p in "ABC"} == {"A": len(pieces), "B": 1, "C": 1}
    assert all(got["A", i].endswith(p) for i, p in enumerate(pieces))
    assert ingest.passages(df.where("path = 'A'"), most=3).count() == 3
