"""Aggregations, windows, pages and telemetry over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strandmap.adapters import LINKS_SQL, links, table
from strandmap.functions import text
from strandmap.operators import ranking, rollups

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_L = f"WITH {LINKS_SQL} "
_OWNER = "array_to_string(string_split(from_path, '.')[1:2], '.')"


@query(
    _L
    + f""", u AS (SELECT *, {_OWNER} AS owner FROM links WHERE starts_with(to_path, 'Nation.') OR starts_with(to_path, 'Supplier.')),
t AS (SELECT owner, link_type, count(*) AS n FROM u GROUP BY ALL),
s AS (SELECT owner, string_agg(from_path, ',' ORDER BY from_path) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY from_path) AS i
      FROM (SELECT DISTINCT owner, from_path FROM u WHERE from_path <> owner)) WHERE i <= 3 GROUP BY owner)
SELECT owner, sum(n)::BIGINT AS n, string_agg(link_type || '=' || n, ',' ORDER BY link_type) AS types, coalesce(any_value(samples), '') AS samples
FROM t LEFT JOIN s USING (owner) GROUP BY owner"""
)
def usages_by_owner(spark, d):
    found = links(spark, d).where(F.col("to_path").startswith("Nation.") | F.col("to_path").startswith("Supplier."))
    return rollups.by_owner(found)


@query(_L + "SELECT link_type, count(*) AS n FROM links WHERE starts_with(to_path, 'Part.') OR starts_with(to_path, 'Nation.') GROUP BY link_type")
def usage_by_type(spark, d):
    found = links(spark, d).where(F.col("to_path").startswith("Part.") | F.col("to_path").startswith("Nation."))
    return found.groupBy("link_type").agg(F.count("*").alias("n"))


@query("SELECT lang AS context, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def method_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("context")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


@query(
    """SELECT o_orderpriority AS kind, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus <> 'O') AS done,
greatest(0, count(*) - count(*) FILTER (o_orderstatus = 'O')) AS target FROM orders GROUP BY ALL"""
)
def conditional_split(spark, d):
    is_open = F.col("o_orderstatus") == "O"
    out = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count_if(is_open).alias("pending"), F.count_if(~is_open).alias("done"), F.count("*").alias("n"))
    return out.select("kind", "pending", "done", F.greatest(F.lit(0), F.col("n") - F.col("pending")).cast("long").alias("target"))


@query("SELECT lang AS tag, count(DISTINCT source) AS n_members, string_agg(DISTINCT source, ',' ORDER BY source) AS members FROM documents GROUP BY lang")
def context_groups(spark, d):
    return rollups.tag_groups(table(spark, d, "documents"), "lang", "source").withColumnRenamed("lang", "tag")


_TAGS = "SELECT user_id, count(DISTINCT event_type) AS n_tags FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id"


@query(_TAGS)
def tags_any(spark, d):
    return rollups.with_tags(table(spark, d, "events"), "event_type", "user_id", ["error", "purchase"], all_of=False)


@query(_TAGS + " HAVING count(DISTINCT event_type) = 2")
def tags_all(spark, d):
    return rollups.with_tags(table(spark, d, "events"), "event_type", "user_id", ["error", "purchase"], all_of=True)


@query("SELECT n_name AS tag, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
def tag_usage_count(spark, d):
    used = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, d, "nation").join(used, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select(F.col("n_name").alias("tag"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT p_brand AS region, count(*) AS n, count(*) FILTER (p_size > 25) AS exported FROM part WHERE p_type <> 'x' GROUP BY ALL")
def region_counts(spark, d):
    return table(spark, d, "part").where("p_type <> 'x'").groupBy(F.col("p_brand").alias("region")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("exported"))


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value >= 300 THEN 'slow' ELSE 'info' END AS tier, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY tier")
def log_counts_by_tier(spark, d):
    tier = F.when(F.col("event_type") == "error", "error").when(F.col("value") >= 300, "slow").otherwise("info")
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value > 400) AS errors, round_even(avg(CASE WHEN value > 0 THEN value END), 1) AS avg_ms FROM events GROUP BY event_type")
def tool_stats(spark, d):
    return rollups.tool_stats(table(spark, d, "events"), "event_type", F.col("value") > 400, "value")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_contexts(spark, d):
    return table(spark, d, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("SELECT source, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 0) AS share FROM documents GROUP BY source")
def usage_share(spark, d):
    docs = table(spark, d, "documents")
    total = docs.count()
    return docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("share", F.bround(F.lit(100.0) * F.col("n") / total, 0))


@query(
    """WITH b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-05 23:59:00', INTERVAL 1 MINUTE)) AS bucket),
k AS (SELECT unnest(['click', 'error', 'view']) AS event_type),
e AS (SELECT date_trunc('minute', ts) AS bucket, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' GROUP BY ALL)
SELECT bucket::TIMESTAMP AS bucket, event_type, coalesce(n, 0)::BIGINT AS n FROM b CROSS JOIN k LEFT JOIN e USING (bucket, event_type)"""
)
def timeline_minute(spark, d):
    return rollups.timeline(table(spark, d, "events"), "ts", "event_type", ["click", "error", "view"], dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6))


@query("SELECT CASE WHEN url LIKE '%.org%' THEN 'org' WHEN url LIKE '%.net%' THEN 'net' WHEN url LIKE '%.com%' THEN 'com' ELSE 'other' END AS class, count(*) AS n, sum(length(html))::BIGINT AS size FROM pages GROUP BY class")
def stamp_class_counts(spark, d):
    u = F.col("url")
    kind = F.when(u.contains(".org"), "org").when(u.contains(".net"), "net").when(u.contains(".com"), "com").otherwise("other")
    return table(spark, d, "pages").groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.sum(F.length("html")).cast("long").alias("size"))


@query(
    """SELECT event_id, nth::INTEGER AS nth, CASE WHEN nth <= 8 THEN 'shown' ELSE 'suppressed' END AS state FROM (
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'error') WHERE nth <= 9"""
)
def error_suppression(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return ranking.suppress_repeats(e, ["user_id"], F.col("ts"), F.col("event_id")).select("event_id", "nth", "state")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS first_ts, max(ts)::TIMESTAMP AS last_ts, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_rollup(spark, d):
    return rollups.sessions(table(spark, d, "events"), ["user_id"], "ts", "30 minutes")


@query("SELECT event_id, ts::TIMESTAMP AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_retention(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return ranking.retain(e, "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 500, F.desc("ts"), F.desc("event_id"))


@query("SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS i FROM documents) WHERE i = 1")
def dedupe_best(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("text_key"))
    return ranking.best_per(docs, ["text_key"], F.desc("n_chars"), F.col("doc_id")).select("text_key", "doc_id")


@query("SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS i FROM documents) WHERE i = 1")
def dedupe_context(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return ranking.best_per(docs, ["lang", "source"], F.desc("n_chars"), F.col("doc_id")).select("lang", "source", "doc_id")


@query(
    """WITH h AS (SELECT 'A.B.C.' || p_name AS path, p_partkey, p_retailprice AS score FROM part UNION ALL SELECT 'Part.' || p_partkey, p_partkey, p_retailprice FROM part)
SELECT path, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN starts_with(path, 'A.') THEN lower(string_split(path, '.')[-1]) ELSE path END ORDER BY score DESC, p_partkey) AS i FROM h) WHERE i = 1"""
)
def leaf_diversify(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("score"))
    deep = part.select(F.concat(F.lit("A.B.C."), F.col("p_name")).alias("path"), "p_partkey", "score")
    flat = part.select(F.concat(F.lit("Part."), F.col("p_partkey").cast("string")).alias("path"), "p_partkey", "score")
    return ranking.one_per_leaf(deep.unionByName(flat), F.desc("score"), F.col("p_partkey")).select("path", "p_partkey")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) > 5 AS overflow FROM documents")
def context_cap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return ranking.cap_contexts(docs, "lang", 20, 4, F.desc("n_chars"), F.col("doc_id"), key="doc_id").select("doc_id", "lang", "overflow")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 70 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 50")
def paginate(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ranking.page(orders, 20, 50, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "total", "truncated")


@query(_L + "SELECT from_path, link_type FROM links WHERE to_path = 'Supplier.Supplier#000000003' ORDER BY CASE link_type WHEN 'type' THEN 0 WHEN 'movements' THEN 1 ELSE 2 END, from_path LIMIT 50")
def usage_order(spark, d):
    place = F.when(F.col("link_type") == "type", 0).when(F.col("link_type") == "movements", 1).otherwise(2)
    return links(spark, d).where("to_path = 'Supplier.Supplier#000000003'").orderBy(place, "from_path").limit(50).select("from_path", "link_type")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def log_newest(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


@query(
    """SELECT event_id, CASE WHEN value < 60 THEN '~' || floor(value)::BIGINT || ' s' WHEN value < 3600 THEN '~' || ceil(value / 60)::BIGINT || ' min' ELSE '~' || ceil(value / 3600)::BIGINT || ' h' END AS eta,
round(greatest(10.0::DOUBLE, least(90.0::DOUBLE, 10.0::DOUBLE + 80.0::DOUBLE * least(value, 300.0::DOUBLE) / 300.0::DOUBLE)), 6) AS percent FROM events"""
)
def eta_and_percent(spark, d):
    v = F.col("value")
    percent = text.phase_percent(F.lit(10.0), F.lit(90.0), v, F.lit(300.0))
    return table(spark, d, "events").select("event_id", text.eta(v).alias("eta"), F.round(percent, 6).alias("percent"))
