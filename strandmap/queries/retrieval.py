"""Text functions, search, graph and card queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap.adapters import LINKS_SQL, OBJECTS_SQL, document_substrings, links, objects, table, walkable_links
from strandmap.functions import paths, text
from strandmap import store
from strandmap.plans import cards, graph, index, retrieval, search, staged, vector_index

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_L, _O = f"WITH {LINKS_SQL} ", f"WITH {OBJECTS_SQL} "
_TOKENS = r"regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\p{L}\p{N}]+')"


@query(f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, len(list_distinct({_TOKENS}))::BIGINT AS n_distinct, array_to_string({_TOKENS}[1:5], ' ') AS head, list_max(list_transform({_TOKENS}, lambda t: substring(t, 1, greatest(6, length(t) - 2)))) AS last_stem FROM documents")
def token_text(spark, d):
    t = F.col("t")
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.array_join(F.slice(t, 1, 5), " ").alias("head"), F.array_max(F.transform(t, lambda x: text.stem(x))).alias("last_stem"))


@query(
    r"""WITH p AS (SELECT p_partkey, replace(p_brand, '#', '') || 'Of' || regexp_replace(p_name, '[^A-Za-z]', '', 'g') AS name FROM part), s AS (SELECT p_partkey, regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g') AS t FROM p)
SELECT p_partkey, t[1] || lower(t[2:]) AS spaced, length(t)::BIGINT AS n FROM s"""
)
def humanised_names(spark, d):
    name = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("Of"), F.regexp_replace("p_name", "[^A-Za-z]", ""))
    return table(spark, d, "part").select("p_partkey", text.humanise(name).alias("spaced")).withColumn("n", F.length("spaced").cast("long"))


_PLACE = "strpos(lower(text), 'license')"


@query(
    f"""SELECT doc_id, (length(text[:{_PLACE} - 1]) - length(replace(text[:{_PLACE} - 1], chr(10), '')) + 1)::INTEGER AS line,
CASE WHEN {_PLACE} > 41 THEN '…' ELSE '' END || substring(text, greatest(1, {_PLACE} - 40), least(length(text) + 1, {_PLACE} + 87) - greatest(1, {_PLACE} - 40)) ||
CASE WHEN {_PLACE} + 87 <= length(text) THEN '…' ELSE '' END AS snippet FROM documents WHERE {_PLACE} > 0"""
)
def snippet_line(spark, d):
    place = F.instr(F.lower("text"), "license")
    docs = table(spark, d, "documents").where(F.lower("text").contains("license"))
    return docs.select("doc_id", text.line_of(F.col("text"), place).cast("int").alias("line"), text.snippet(F.col("text"), place, 7).alias("snippet"))


@query(
    """WITH p AS (SELECT doc_id, text, string_split(lower(text), 'the') AS s FROM documents),
e AS (SELECT doc_id, text, unnest(range(1, len(s)))::INTEGER AS nth, s FROM p)
SELECT doc_id, nth, (1 + length(left(text, pos)) - length(replace(left(text, pos), chr(10), '')))::INTEGER AS line FROM (
    SELECT doc_id, text, nth, list_sum(list_transform(s[1:nth], lambda x: length(x)))::BIGINT + (nth - 1) * 3 AS pos FROM e)"""
)
def code_references(spark, d):
    return cards.references(document_substrings(spark, d), "the", "doc_id").select("doc_id", "nth", F.col("line").cast("int").alias("line"))


@query("SELECT page_id, type_list, preview FROM (SELECT page_id, array_to_string(string_split(url, '/')[1:3], ', ') || CASE WHEN len(string_split(url, '/')) > 3 THEN ', …' ELSE '' END AS type_list, CASE WHEN length(f) > 60 THEN rtrim(substring(f, 1, 60)) || '…' ELSE f END AS preview FROM (SELECT *, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS f FROM pages))".replace("\\\\", "\\"))
def type_format(spark, d):
    return table(spark, d, "pages").select("page_id", text.type_list(F.split("url", "/"), 3).alias("type_list"), text.preview(F.col("html"), 60).alias("preview"))


_COVER = """WITH n AS (SELECT doc_id, source, lang, text, CASE WHEN length(text) <= 1100 THEN 1 ELSE ceil((length(text) - 1100) / 970.0)::BIGINT + 1 END AS k FROM documents),
c AS (SELECT doc_id, source, lang, text, unnest(range(0, k)) AS ord FROM n)"""


@query(_COVER + " SELECT doc_id, ord::INTEGER AS ord, length(substring(text, ord * 970 + 1, 1100))::INTEGER AS n, md5(substring(text, ord * 970 + 1, 1100)) AS h FROM c")
def chunk_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(text.windows(F.col("text"), 1100, 130)).alias("ord", "piece"))
    return docs.select("doc_id", "ord", F.length("piece").alias("n"), F.md5("piece").alias("h"))


@query(_COVER + " SELECT doc_id || CASE WHEN ord = 0 THEN '' ELSE '#' || ord END AS id, md5(concat_ws(' | ', 'Doc.' || doc_id, nullif(source, ''), nullif(lang, '')) || chr(10) || substring(text, ord * 970 + 1, 1100)) AS h FROM c")
def passages(spark, d):
    docs = table(spark, d, "documents")
    meta = text.meta_text(F.concat(F.lit("Doc."), F.col("doc_id").cast("string")), F.col("source"), F.col("lang"))
    each = docs.select("doc_id", meta.alias("meta"), F.posexplode(text.windows(F.col("text"), 1100, 130)).alias("ord", "piece"))
    suffix = F.when(F.col("ord") == 0, "").otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))
    return each.select(F.concat(F.col("doc_id").cast("string"), suffix).alias("id"), F.md5(F.concat_ws("\n", "meta", "piece")).alias("h"))


def _bm25_sql(words: list[str], prefix: tuple[str, ...] = (), where: str = "true") -> str:
    tf = [f"len(list_filter(t, lambda x: {'starts_with(x, ' + repr(w) + ')' if w in prefix else 'x = ' + repr(w)}))" for w in words]
    cols = ", ".join(f"{e}::DOUBLE AS tf{i}" for i, e in enumerate(tf))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    parts = " + ".join(f"ln(1::DOUBLE + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))" for i in range(len(words)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""d AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE {where}), c AS (SELECT doc_id, len(t)::DOUBLE AS l, {cols} FROM d),
s AS (SELECT count(*) AS n, avg(l) AS a, {dfs} FROM c),
bm AS (SELECT doc_id, {parts} AS raw FROM c, s WHERE {some})"""


_WORDS = ["than", "heon", "thing"]


def _corpus(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("Help."), F.col("source"), F.lit("."), F.col("doc_id").cast("string"))
    rows = docs.select(F.col("lang").alias("context"), path.alias("path"), F.lit("Help").alias("kind"), F.concat(F.lit("Doc"), F.col("doc_id").cast("string")).alias("name"), F.lit("").alias("synonym"), text.clip(F.col("text"), 200).alias("comment"), "text", "doc_id")
    return rows


def documents_index(spark, d) -> index.TextIndex:
    """The full-text index of all documents, built by the first query that asks for it."""
    path = store.once(spark, d, "documents-index", lambda p: index.build(_corpus(spark, d), p, "doc_id", carry=("context", "kind", "path")))
    return index.load(spark, path)


def vectors_index(spark, d) -> vector_index.VectorIndex:
    """The vector index of all embeddings, likewise."""
    vectors = lambda: table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vector_index.load(spark, store.once(spark, d, "embeddings-index", lambda p: vector_index.build(vectors(), p, "doc_id")))


@query(f"WITH {_bm25_sql(_WORDS)} SELECT doc_id, round(raw, 6) AS raw_score FROM bm ORDER BY raw DESC, doc_id LIMIT 25")
def bm25_topk(spark, d):
    hits = documents_index(spark, d).bm25(retrieval.query_terms("Than heon thing"))
    return retrieval.top(hits, 25, "doc_id").select("doc_id", F.round("raw_score", 6).alias("raw_score"))


@query(f"WITH {_bm25_sql(['thatha', 'on'], ('thatha',))} SELECT doc_id, round(raw, 6) AS raw_score FROM bm ORDER BY raw DESC, doc_id LIMIT 25")
def bm25_prefix_expand(spark, d):
    hits = documents_index(spark, d).bm25(retrieval.query_terms("thatha on", expand_from=6))
    return retrieval.top(hits, 25, "doc_id").select("doc_id", F.round("raw_score", 6).alias("raw_score"))


@query(f"WITH {_bm25_sql(['th', 'on'], ('th',))} SELECT doc_id, round(raw, 6) AS raw_score FROM bm ORDER BY raw DESC, doc_id LIMIT 40")
def bm25_short_prefix(spark, d):
    """A prefix of two letters, which is many ranges of the dictionary."""
    hits = documents_index(spark, d).bm25([retrieval.Term("th", prefix=True), retrieval.Term("on")])
    return retrieval.top(hits, 40, "doc_id").select("doc_id", F.round("raw_score", 6).alias("raw_score"))


_EDITED = """documents AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 10 = 3 THEN 'heon than ' || coalesce(text, '') ELSE text END AS text FROM main.documents WHERE doc_id % 10 <> 4 OR doc_id IS NULL)"""


def _edited_index(spark, d, p) -> None:
    """The index of all documents, then an edit of a tenth of them and the removal of another tenth."""
    corpus = _corpus(spark, d)
    built = index.build(corpus, p, "doc_id", carry=("context", "kind", "path"))
    changed = corpus.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("heon than "), F.coalesce("text", F.lit(""))))
    index.update(built, changed, corpus.where("doc_id % 10 = 4").select("doc_id"))


@query(f"WITH {_EDITED}, {_bm25_sql(_WORDS)} SELECT doc_id, round(raw, 6) AS raw_score FROM bm ORDER BY raw DESC, doc_id LIMIT 40")
def bm25_after_edits(spark, d):
    """Full text over an index that has been edited: base, a segment of changes, tombstones."""
    path = store.once(spark, d, "documents-edited-index", lambda p: _edited_index(spark, d, p))
    hits = index.load(spark, path, 2).bm25(retrieval.query_terms("Than heon thing"))
    return retrieval.top(hits, 40, "doc_id").select("doc_id", F.round("raw_score", 6).alias("raw_score"))


@query(f"WITH {_EDITED}, {_bm25_sql(_WORDS)} SELECT doc_id, round(raw, 6) AS raw_score FROM bm ORDER BY raw DESC, doc_id LIMIT 40")
def bm25_after_compaction(spark, d):
    """The same when the segments have been merged."""
    path = store.once(spark, d, "documents-edited-index", lambda p: _edited_index(spark, d, p))
    merged = store.once(spark, d, "documents-merged", lambda p: spark.createDataFrame([(index.compact(index.load(spark, path, 2)).live.generation,)], "g int").write.parquet(p))
    hits = index.load(spark, path, spark.read.parquet(merged).first().g).bm25(retrieval.query_terms("Than heon thing"))
    return retrieval.top(hits, 40, "doc_id").select("doc_id", F.round("raw_score", 6).alias("raw_score"))


def _chunks(spark, d):
    docs = _corpus(spark, d).where("text IS NOT NULL")
    pieces = docs.select("context", "path", "kind", "name", "synonym", "doc_id", F.posexplode(text.windows(F.col("text"), 1100, 130)).alias("ord", "text"))
    return pieces.withColumn("chunk", F.col("doc_id") * 10_000 + F.col("ord")).withColumn("comment", F.lit("")).drop("ord", "doc_id")


@query(
    f"""WITH {_COVER[5:]}, d AS (SELECT doc_id, doc_id * 10000 + ord AS chunk, regexp_extract_all(replace(lower(substring(text, ord * 970 + 1, 1100)), 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+') AS t FROM c WHERE text IS NOT NULL),
f AS (SELECT doc_id, chunk, len(t)::DOUBLE AS l, len(list_filter(t, lambda x: starts_with(x, 'heon')))::DOUBLE AS tf0, len(list_filter(t, lambda x: starts_with(x, 'th')))::DOUBLE AS tf1 FROM d),
s AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM f),
bm AS (SELECT doc_id, chunk, ln(1::DOUBLE + (n - df0 + 0.5::DOUBLE) / (df0 + 0.5::DOUBLE)) * tf0 * 2.2::DOUBLE / (tf0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) + ln(1::DOUBLE + (n - df1 + 0.5::DOUBLE) / (df1 + 0.5::DOUBLE)) * tf1 * 2.2::DOUBLE / (tf1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) AS raw FROM f, s WHERE tf0 > 0 OR tf1 > 0),
best AS (SELECT doc_id, chunk, raw FROM bm QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, chunk) = 1),
hits AS (SELECT doc_id, chunk, raw, row_number() OVER (ORDER BY raw DESC, chunk) AS r FROM best QUALIFY r <= 50)
SELECT r::INTEGER AS rank, 'Help.' || source || '.' || doc_id AS path, round(-2.6::DOUBLE + (1.0::DOUBLE / (60 + r)) / max(1.0::DOUBLE / (60 + r)) OVER (), 6) AS score FROM hits JOIN documents USING (doc_id) WHERE r <= 20"""
)
def chunked_search(spark, d):
    """Search over windows of the texts: an object has the rank of its best chunk, and prefixes may have two letters."""
    path = store.once(spark, d, "chunks-index", lambda p: index.build(_chunks(spark, d), p, "chunk", carry=("context", "kind", "path")))
    hits = search.search(index.load(spark, path), "heon th", k=20, pool=50, with_lanes=False, expand_from=2, profile=retrieval.RankProfile(kind_boost={}))
    return hits.select("rank", "path", F.round("score", 6).alias("score"))


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


_COS = "cos AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS raw FROM embeddings)"


@query(f"WITH {_COS} SELECT vec_id, round(raw, 6) AS raw_score FROM cos ORDER BY raw DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    hits = vectors_index(spark, d).search(_query_vector(spark, d), 20)
    return hits.select(F.col("doc_id").alias("vec_id"), F.round("raw_score", 6).alias("raw_score"))


@query(f"WITH {_COS} SELECT vec_id, round(raw, 6) AS raw_score FROM cos ORDER BY raw DESC, vec_id LIMIT 20")
def cosine_scan(spark, d):
    """The same without an index, over all vectors."""
    hits = retrieval.cosine(table(spark, d, "embeddings"), _query_vector(spark, d))
    return retrieval.top(hits, 20, "vec_id").select("vec_id", F.round("raw_score", 6).alias("raw_score"))


@query(
    f"""WITH {_bm25_sql(_WORDS)}, {_COS},
l1 AS (SELECT doc_id, row_number() OVER (ORDER BY raw DESC, doc_id) AS r FROM bm QUALIFY r <= 80),
l2 AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY raw DESC, vec_id) AS r FROM cos QUALIFY r <= 80)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY doc_id"""
)
def rrf_hybrid(spark, d):
    lexical = documents_index(spark, d).bm25(retrieval.query_terms("than heon thing"))
    vector = vectors_index(spark, d).search(_query_vector(spark, d), 80)
    return retrieval.fuse([lexical, vector], "doc_id", 80).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(_WORDS)} SELECT doc_id, round(raw, 6) AS raw_score FROM bm ORDER BY raw DESC, doc_id LIMIT 25")
def bm25_scan(spark, d):
    """The same without an index, over the texts themselves."""
    hits = retrieval.bm25(table(spark, d, "documents"), retrieval.query_terms("Than heon thing"))
    return retrieval.top(hits, 25, "doc_id").select("doc_id", F.round("raw_score", 6).alias("raw_score"))


@query(
    _O
    + """, h AS (SELECT path, kind, name, lower(name || '  ' || comment || ' ' || path) AS hay, (length(path) % 5 + 1)::DOUBLE AS raw FROM objects WHERE kind IN ('Customer', 'Supplier', 'Region')),
c AS (SELECT *, contains(hay, 'customer')::INT + contains(hay, 'building')::INT AS n FROM h)
SELECT path, round(4.0::DOUBLE * (n / 2.0::DOUBLE + CASE WHEN n = 2 THEN 0.35::DOUBLE + least(length(name), 80) / 200.0::DOUBLE WHEN n / 2.0::DOUBLE >= 0.5 THEN 0.15::DOUBLE * n / 2.0::DOUBLE ELSE 0 END)
    + CASE WHEN kind = 'Customer' THEN 1.2::DOUBLE ELSE 0 END + 0.45::DOUBLE + CASE WHEN n >= 2 THEN 1.25::DOUBLE ELSE 0 END + CASE WHEN n = 0 THEN -2.6::DOUBLE ELSE 0 END + raw / 5.0::DOUBLE, 6) AS score FROM c"""
)
def rerank_coverage(spark, d):
    hits = objects(spark, d).where(F.col("kind").isin("Customer", "Supplier", "Region")).withColumn("synonym", F.lit("")).withColumn("raw_score", (F.length("path") % 5 + 1).cast("double"))
    profile = retrieval.RankProfile(kind_boost={"Customer": 1.2})
    return retrieval.rerank(hits, "customer building", profile).select("path", F.round("score", 6).alias("score"))


def _search_sql(words: list[str], columns: str, where: str = "true", vector: bool = False, k: int = 20) -> str:
    """Hybrid search in SQL: two legs of 200, reciprocal ranks, the lane of all tokens, and the terms of the re-ranking that can hold for help pages."""
    n = len(words)
    every = " AND ".join(f"contains(h3, '{w}')" for w in words)
    covers = " + ".join(f"contains(hay, '{w}')::INT" for w in words)
    second = "UNION ALL SELECT doc_id, row_number() OVER (ORDER BY raw DESC, doc_id) AS r FROM cos JOIN corpus ON vec_id = doc_id QUALIFY r <= 200" if vector else ""
    return f"""WITH {_bm25_sql(words, where=where)}, {_COS},
corpus AS (SELECT doc_id, lang AS context, 'Help.' || source || '.' || doc_id AS path, 'Doc' || doc_id AS name, substring(text, 1, 200) AS comment FROM documents WHERE {where}),
legs AS (SELECT doc_id, row_number() OVER (ORDER BY raw DESC, doc_id) AS r FROM bm QUALIFY r <= 200 {second}),
fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS raw FROM legs GROUP BY doc_id),
folded AS (SELECT *, replace(lower(name || chr(10) || comment || chr(10) || path), 'ё', 'е') AS h3, replace(lower(name || '  ' || comment || ' ' || path), 'ё', 'е') AS hay FROM corpus),
pool AS (SELECT context, path, doc_id, name, coalesce(raw, 0::DOUBLE) AS raw, {covers} AS n FROM folded LEFT JOIN fused USING (doc_id) WHERE raw IS NOT NULL OR ({every})),
scored AS (SELECT *, 4.0::DOUBLE * (n / {n}.0::DOUBLE + CASE WHEN n = {n} THEN 0.35::DOUBLE + least(length(name), 80) / 200.0::DOUBLE WHEN n / {n}.0::DOUBLE >= 0.5 THEN 0.15::DOUBLE * n / {n}.0::DOUBLE ELSE 0 END)
    + CASE WHEN n >= 2 THEN 1.25::DOUBLE + least(0.35::DOUBLE * (n - 2), 0.7::DOUBLE) ELSE 0 END + CASE WHEN n = 0 THEN -2.6::DOUBLE ELSE 0 END
    + CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0 END AS score FROM pool)
SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY score DESC, raw DESC, doc_id)::INTEGER AS rank FROM scored) WHERE rank <= {k}"""


@query(_search_sql(_WORDS, "rank, context, path, round(score, 6) AS score", vector=True))
def semantic_search(spark, d):
    hits = search.search(documents_index(spark, d), "than heon thing", k=20, vector=_query_vector(spark, d), vectors=vectors_index(spark, d))
    return hits.select("rank", "context", "path", F.round("score", 6).alias("score"))


@query(_search_sql(_WORDS, "rank, path, round(score, 6) AS score", where="source = 'src3'"))
def help_search(spark, d):
    return search.search(documents_index(spark, d), "than heon thing", k=20, prefix="Help.src3", kind="Help").select("rank", "path", F.round("score", 6).alias("score"))


@query(_search_sql(["than", "heon", "la"], "rank, context, path, round(score, 6) AS score", where="lang IN ('en', 'fr')"))
def federated_search(spark, d):
    hits = search.search(documents_index(spark, d), "than heon la", k=20, contexts=["en", "fr"])
    return hits.select("rank", "context", "path", F.round("score", 6).alias("score"))


def _bfs_sql(start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {LINKS_SQL}, f(node, d) AS (
    SELECT '{start}', 0
    UNION SELECT array_to_string(string_split(l.from_path, '.')[1:2], '.'), f.d + 1 FROM f JOIN links l ON l.to_path = f.node WHERE f.d < {depth}),
firsts AS (SELECT node, min(d) AS d FROM f GROUP BY node)
SELECT l.from_path AS path, l.link_type, (min(f.d) + 1)::INTEGER AS depth FROM firsts f JOIN links l ON l.to_path = f.node WHERE f.d < {depth} GROUP BY ALL"""


@query(_bfs_sql("Region.EUROPE", 3))
def impact_bfs(spark, d):
    return graph.impact(walkable_links(spark, d), "Region.EUROPE", 3)


@query(
    f"""WITH RECURSIVE {LINKS_SQL}, f(node, d) AS (SELECT 'Order.1', 0 UNION SELECT l.to_path, f.d + 1 FROM f JOIN links l ON l.from_path = f.node WHERE f.d < 4)
SELECT node AS path, min(d)::INTEGER AS depth FROM f WHERE node <> 'Order.1' GROUP BY node"""
)
def call_chain_bfs(spark, d):
    return graph.reach(walkable_links(spark, d), "Order.1", 4)


@query(
    f"""WITH RECURSIVE {LINKS_SQL}, f(node, d) AS (SELECT 'Customer.Customer#000000001', 0 UNION SELECT l.to_path, f.d + 1 FROM f JOIN links l ON l.from_path = f.node WHERE f.d < 3),
firsts AS (SELECT node, min(d) AS d FROM f GROUP BY node)
SELECT l.to_path AS path, l.link_type, (min(f.d) + 1)::INTEGER AS depth FROM firsts f JOIN links l ON l.from_path = f.node WHERE f.d < 3 GROUP BY ALL"""
)
def impact_up(spark, d):
    return graph.impact(walkable_links(spark, d), "Customer.Customer#000000001", 3, down=False)


@query(
    f"""WITH {LINKS_SQL}, one AS (SELECT n_name AS n, r_name AS r, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS i FROM nation JOIN region ON n_regionkey = r_regionkey),
pair AS (SELECT a.n AS a, b.n AS b, a.r FROM one a JOIN one b ON a.r = b.r AND a.i = 1 AND b.i = 2 WHERE a.r = 'ASIA')
SELECT 1::INTEGER AS hop, 'Nation.' || a AS from_object, 'Region.' || r AS to_object, 'composition' AS link_type, 'forward' AS direction FROM pair
UNION ALL SELECT 2, 'Region.' || r, 'Nation.' || b, 'composition', 'backward' FROM pair"""
)
def path_over_objects(spark, d):
    """A path of two hops between objects that no link joins."""
    region = table(spark, d, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    a, b = (r.n_name for r in table(spark, d, "nation").join(region, "n_regionkey").orderBy("n_name").select("n_name").limit(2).collect())
    found = graph.path_between(walkable_links(spark, d), f"Nation.{a}", f"Nation.{b}")
    return found.select("hop", "from_object", "to_object", "link_type", "direction")


@query(_L + "SELECT from_path, to_path, link_type AS types, substring(from_path, 9) AS field FROM links WHERE starts_with(from_path, 'Order.1.') AND to_path = (SELECT min(to_path) FROM links WHERE starts_with(from_path, 'Order.1.') AND link_type = 'movements')")
def query_path(spark, d):
    e = links(spark, d)
    target = e.where(F.col("from_path").startswith("Order.1.") & (F.col("link_type") == "movements")).agg(F.min("to_path")).first()[0]
    return graph.join_paths(e, "Order.1", target or "").select("from_path", "to_path", "types", "field")


@query(_O + "SELECT array_to_string(string_split(path, '.')[1:2], '.') AS owner, count(*) AS n_children, min(path) AS first, max(path) AS last FROM objects WHERE kind = 'Line' GROUP BY owner")
def structure_children(spark, d):
    return cards.children(objects(spark, d), paths.owner(F.col("path")))


@query(
    f"WITH {OBJECTS_SQL}, {LINKS_SQL}"
    + """ SELECT 'children' AS section, kind AS item, count(*) AS n FROM objects WHERE starts_with(path, 'Order.5.') GROUP BY kind
UNION ALL SELECT 'outgoing', link_type, count(*) FROM links WHERE from_path = 'Order.5' OR starts_with(from_path, 'Order.5.') GROUP BY link_type
UNION ALL SELECT 'incoming', link_type, count(*) FROM links WHERE to_path = 'Order.5' GROUP BY link_type"""
)
def dossier(spark, d):
    return cards.dossier(objects(spark, d), links(spark, d), "Order.5")


_STRUCT = """items AS (SELECT DISTINCT 'Документы.O' || l_orderkey || '.Реквизиты.' || l_returnflag AS path, l_returnflag AS name FROM lineitem
UNION SELECT DISTINCT 'Документы.O' || l_orderkey || '.ТабличныеЧасти.L' || l_linenumber, 'L' || l_linenumber FROM lineitem
UNION SELECT DISTINCT 'Документы.O' || l_orderkey || '.ТабличныеЧасти.L' || l_linenumber || '.Реквизиты.' || l_linestatus, l_linestatus FROM lineitem)"""


def _items(spark, d):
    t = table(spark, d, "lineitem")
    base = F.concat(F.lit("Документы.O"), F.col("l_orderkey").cast("string"))
    line = F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))
    a = t.select(F.concat(base, F.lit(".Реквизиты."), F.col("l_returnflag")).alias("path"), F.col("l_returnflag").alias("name"))
    b = t.select(F.concat(base, F.lit(".ТабличныеЧасти."), line).alias("path"), line.alias("name"))
    c = t.select(F.concat(base, F.lit(".ТабличныеЧасти."), line, F.lit(".Реквизиты."), F.col("l_linestatus")).alias("path"), F.col("l_linestatus").alias("name"))
    return a.unionByName(b).unionByName(c).distinct()


@query(f"WITH {_STRUCT} SELECT CASE WHEN path LIKE '%.Реквизиты.%' AND path LIKE '%.ТабличныеЧасти.%' THEN 'column' WHEN path LIKE '%.ТабличныеЧасти.%' THEN 'section' ELSE 'attribute' END AS role, CASE WHEN path LIKE '%.ТабличныеЧасти.%' THEN string_split(path, '.')[4] ELSE '' END AS section, name, path FROM items WHERE starts_with(path, 'Документы.O1.')")
def structure_pivot(spark, d):
    return cards.structure(_items(spark, d), "Документы.O1")


@query(
    f"""WITH {_STRUCT}, s AS (SELECT string_split(path, '.')[2] AS o, CASE WHEN path LIKE '%.Реквизиты.%' AND path LIKE '%.ТабличныеЧасти.%' THEN 'column' WHEN path LIKE '%.ТабличныеЧасти.%' THEN 'section' ELSE 'attribute' END AS role,
CASE WHEN path LIKE '%.ТабличныеЧасти.%' THEN string_split(path, '.')[4] ELSE '' END AS section, name FROM items WHERE starts_with(path, 'Документы.O1.') OR starts_with(path, 'Документы.O2.'))
SELECT role, section, name, CASE WHEN count(*) = 2 THEN 'both' WHEN min(o) = 'O1' THEN 'only_a' ELSE 'only_b' END AS place FROM s GROUP BY role, section, name"""
)
def compare_objects(spark, d):
    return cards.compare(_items(spark, d), "Документы.O1", "Документы.O2")


def _staged(spark, d, query: str):
    o = objects(spark, d).withColumn("synonym", F.lit(""))
    pages = _corpus(spark, d).select("path", "kind", "name", "comment", "synonym")
    found = staged.recall(o, query, help_pages=pages)
    return found.hits.select("path", "lane").withColumn("stages", F.lit(",".join(found.stages)))


@query(_O + "SELECT path, 'stem' AS lane, 'names,stems' AS stages FROM objects WHERE length(path) - length(replace(path, '.', '')) = 1 AND (starts_with(lower(name), 'custom') OR starts_with(lower(name), '000000'))")
def staged_without_help(spark, d):
    """A question that names enough roots: token search and help pages are skipped."""
    return _staged(spark, d, "customer 00000001")


@query(
    f"""WITH {OBJECTS_SQL}, help AS (SELECT 'Help.' || source || '.' || doc_id AS path, replace(lower('Doc' || doc_id || chr(10) || substring(text, 1, 200) || chr(10) || 'Help.' || source || '.' || doc_id), 'ё', 'е') AS hay FROM documents),
named AS (SELECT path, replace(lower(name || chr(10) || comment || chr(10) || path), 'ё', 'е') AS hay FROM objects)
SELECT path, 'tokens' AS lane, 'names,stems,tokens,help' AS stages FROM (SELECT * FROM help UNION ALL SELECT * FROM named) WHERE contains(hay, 'heon') AND contains(hay, 'than')"""
)
def staged_with_help(spark, d):
    """A question whose words no object has: all stages run, help pages last."""
    return _staged(spark, d, "heon than")
