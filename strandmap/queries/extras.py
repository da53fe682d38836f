"""Interval joins, index upkeep, clones and lanes over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strandmap import ingest, store
from strandmap.adapters import OBJECTS_SQL, made_links, objects, table
from strandmap.functions import embed, text
from strandmap.operators import intervals, relations
from strandmap.plans import graph, lanes
from strandmap.sources import layout, sinks
from strandmap.streaming import stateful, telemetry

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    """SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type
AND epoch_us(b.ts) >= epoch_us(a.ts) AND epoch_us(b.ts) <= epoch_us(a.ts) + 600000000"""
)
def fan_out_pairs(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    right = e.select("user_id", "at", F.col("event_id").alias("second_id"), F.col("event_type").alias("second_type"))
    pairs = intervals.within(e, right, ["user_id"], "at", 600_000_000, F.col("event_type") != F.col("second_type"))
    return pairs.select(F.col("event_id").alias("first_id"), "second_id")


@query("SELECT doc_id::VARCHAR AS path, 0 AS ord FROM documents WHERE doc_id % 5 = 0")
def stale_passages(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("ord"), "text", "doc_id")
    indexed = docs.select("path", "ord", F.sha2("text", 256).alias("h"))
    now = docs.where("doc_id % 5 <> 0").select("path", "ord", "text")
    return ingest.pending_passages(now, indexed)[1].select("path", "ord")


@query("SELECT 9::BIGINT AS entity_id, count(*) AS n, count(DISTINCT doc_id) AS n_paths FROM documents WHERE lang = 'en'")
def clone_entity(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("lang") == "en", 1).otherwise(2).cast("long").alias("entity_id"), "doc_id")
    return sinks.clone(docs, 1, 9).groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_paths"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def insert_ignore(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    closed = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return sinks.insert_new(t.join(closed, "l_orderkey", "left_semi"), t, ["l_orderkey", "l_linenumber"])


@query("SELECT CASE WHEN p_type LIKE 'PROMO%' THEN '#aabbcc' WHEN p_size > 25 THEN '#0f0f0f' ELSE '#888888' END AS colour, count(*) AS n FROM part GROUP BY 1")
def colours(spark, d):
    raw = F.when(F.col("p_type").startswith("PROMO"), " #ABC ").when(F.col("p_size") > 25, "#0F0F0F").otherwise("none")
    return table(spark, d, "part").groupBy(text.colour(raw).alias("colour")).agg(F.count("*").alias("n"))


@query(f"WITH {OBJECTS_SQL} SELECT kind, count(*) AS n FROM objects WHERE kind IN ('Customer', 'Region') OR path IN (SELECT 'Nation.' || n_name FROM nation WHERE n_regionkey = 2) GROUP BY kind")
def candidate_union(spark, d):
    o = objects(spark, d)
    nations = table(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("Nation."), F.col("n_name")).alias("path"))
    a = o.where(F.col("kind").isin("Customer", "Region"))
    b = o.join(nations, "path", "left_semi")
    return relations.prefer_first(a, b).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {OBJECTS_SQL}, h AS (SELECT path, kind, name, contains(lower(name || '  ' || comment || ' ' || path), 'customer')::INT + contains(lower(name || '  ' || comment || ' ' || path), 'building')::INT AS n
    FROM objects WHERE starts_with(path, 'Customer.') AND length(path) - length(replace(path, '.', '')) = 1 AND (starts_with(lower(name), 'custom') OR starts_with(lower(name), 'buildi')))
SELECT path, 'stem' AS lane, round(4.0::DOUBLE * (n / 2.0::DOUBLE + CASE WHEN n = 2 THEN 0.35::DOUBLE + least(length(name), 80) / 200.0::DOUBLE WHEN n / 2.0::DOUBLE >= 0.5 THEN 0.15::DOUBLE * n / 2.0::DOUBLE ELSE 0 END)
    + 0.45::DOUBLE + CASE WHEN n >= 2 THEN 1.25::DOUBLE ELSE 0 END + CASE WHEN n = 0 THEN -2.6::DOUBLE ELSE 0 END + 1.3::DOUBLE + 1.0::DOUBLE, 6) AS score FROM h ORDER BY score DESC, path LIMIT 20"""
)
def lane_search(spark, d):
    o = objects(spark, d).withColumn("synonym", F.lit(""))
    return lanes.find(o, "customer building", prefix="Customer").select("path", "lane", F.round("score", 6).alias("score"))


@query("SELECT item_id, 64 AS n, 1.0::DOUBLE AS norm FROM benchmark WHERE regexp_matches(text, '[\\p{L}\\p{N}]') UNION ALL SELECT item_id, 64, 0.0 FROM benchmark WHERE NOT regexp_matches(text, '[\\p{L}\\p{N}]')".replace("\\\\", "\\"))
def embedded_passages(spark, d):
    rows = embed.embed(table(spark, d, "benchmark"), function=embed.hashed)
    return rows.select("item_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))


@query("SELECT n_from, count(*) AS n FROM (SELECT to_path, count(*) AS n_from FROM (SELECT 'Customer.' || c_name AS from_path, 'Nation.' || n_name AS to_path FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY to_path) GROUP BY n_from")
def usage_histogram(spark, d):
    e = made_links(spark, d).where(F.col("from_path").startswith("Customer."))
    return e.groupBy("to_path").agg(F.count("*").alias("n_from")).groupBy("n_from").agg(F.count("*").alias("n"))


@query(
    f"""WITH {OBJECTS_SQL} SELECT name, path FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY length(path) - length(replace(path, '.', '')), length(path), path) AS i
FROM objects WHERE name IN (SELECT p_name FROM part WHERE p_size < 10 UNION ALL SELECT n_name FROM nation)) WHERE i = 1"""
)
def path_by_name(spark, d):
    part = table(spark, d, "part").where("p_size < 10").select(F.col("p_name").alias("name"))
    return graph.resolve_name(objects(spark, d), part.unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"))))


_FILES = (
    ("Catalogs/P", ".xml", "object", "Справочники.P", ""), ("Catalogs/P", "/Forms/F/Ext/Form.xml", "form", "Справочники.P", ".Формы.F"), ("Reports/P", "/Templates/T/Ext/Template.xml", "template", "Отчеты.P", ".Макеты.T"),
    ("Documents/P", "/Ext/Help/ru.html", "help", "Документы.P", ""), ("CommonModules/P", "/Ext/Module.bsl", "module", "ОбщиеМодули.P", ""),
)


@query("SELECT a || p_partkey || b AS rel, class, p || p_partkey || q AS path FROM part, (VALUES " + ", ".join(map(str, _FILES)) + ") t(a, b, class, p, q) UNION ALL SELECT p_partkey || '.png', 'other', '' FROM part")
def file_classes(spark, d):
    """Classes and owners of six files a part."""
    key = F.col("p_partkey").cast("string")
    rels = F.array(*(F.concat(F.lit(a), key, F.lit(b)) for a, b, *_ in _FILES), F.concat(key, F.lit(".png")))
    rows = table(spark, d, "part").select(F.explode(rels).alias("rel"))
    return rows.select("rel", layout.file_class(F.col("rel")).alias("class"), layout.owner_path(F.col("rel")).alias("path"))


def _replayed(spark, d, name, job):
    """A job over the events as a stream of their files, kept as Parquet; what the last watermark hasn't passed is still to come."""

    def run(path):
        schema = table(spark, d, "events").schema
        # A pattern, as the table may be one file: a source without one has to be a folder.
        stateful.drain(spark, lambda: job(telemetry.events(spark, f"{d}/events.parque[t]", schema, files_per_trigger=64)), path, f"{path}-state")

    return spark.read.parquet(store.once(spark, d, name, run))


@query(
    """WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), n AS (
SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM e WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM e))
SELECT event_id, nth::INTEGER AS nth, CASE WHEN nth <= 8 THEN 'shown' ELSE 'suppressed' END AS state FROM n WHERE nth <= 9"""
)
def error_suppression_stream(spark, d):
    found = _replayed(spark, d, "suppressed", lambda s: stateful.suppress_repeats(s.where("event_type = 'error'"), ["user_id"]))
    return found.select("event_id", "nth", "state")


@query(
    """WITH k AS (SELECT unnest(['click', 'error', 'view']) AS event_type), f AS (SELECT * FROM events JOIN k USING (event_type) WHERE ts >= TIMESTAMP '2024-01-05'),
b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', (SELECT date_trunc('minute', max(ts) - INTERVAL 10 MINUTE) - INTERVAL 1 MINUTE FROM f), INTERVAL 1 MINUTE)) AS bucket),
e AS (SELECT date_trunc('minute', ts) AS bucket, event_type, count(*) AS n FROM f GROUP BY ALL)
SELECT bucket::TIMESTAMP AS bucket, event_type, coalesce(n, 0)::BIGINT AS n FROM b CROSS JOIN k LEFT JOIN e USING (bucket, event_type)"""
)
def timeline_stream(spark, d):
    job = lambda s: stateful.filled_timeline(s, "event_type", ["click", "error", "view"], dt.datetime(2024, 1, 5))
    return _replayed(spark, d, "minutes", job).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
