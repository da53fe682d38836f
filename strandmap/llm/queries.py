"""The queries over the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.llm import alignment, ann, bpe, decision_list, embedding_join, licenses, minhash, mixing, pii, quality, toxicity, warc, whitening
from strandmap.llm.common import shared_path, table


def op1_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings by a cosine of 0.95 or more."""
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode it again, and return digests of both."""
    v = bpe.load_vocabulary(vocabulary_path())
    back = bpe.round_trip(table(spark, sf_dir, "documents"), v, keep=["doc_id"])
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four words a shingle, similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages as ARC, convert the archives to WARC, and read those back."""
    arc, archive = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arc)
    warc.arc_to_warc(spark, arc, archive)
    return warc.read_warc(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def quality_ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings (doc_id, grade) from labels: 0 rejected, 1 accepted but toxic, 2 accepted and not toxic."""
    rating = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", rating.alias("grade")).dropna()


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of usefulness of every document, and the chance of grade 1 or better.

    The labels have no grades of their own, so they are made of quality and
    toxicity: see ``quality_ratings``. Rows of the held-out fold teach nothing.
    """
    docs = table(spark, sf_dir, "documents")
    ratings = quality_ratings(table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return quality.grade(docs, quality.fit(docs, ratings, n_grades=3), wanted=1, least=0.5, keep=["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weigh 5, 2, 1 in turn and share 150 % of all words, 200 % of a source at most."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; predicted from 0.7 on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_from_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in every document: the best match, and the number of different licenses found.

    ``spark.strandmap.licenseTexts`` may name a folder with the texts of more licenses.
    """
    folder = spark.conf.get("spark.strandmap.licenseTexts", None)
    templates = licenses.TEMPLATES | (licenses.folder_templates(folder) if folder else {})
    found = licenses.scan(table(spark, sf_dir, "documents"), templates, least=0.8, keep=["doc_id"])
    best = F.try_element_at("matches", F.lit(1))
    names = F.array_distinct(F.transform("matches", lambda m: licenses.license_of(m["license"])))
    return found.select("doc_id", licenses.license_of(best["license"]).alias("license"), best["dice"].alias("dice"), F.size(names).alias("n_licenses"))


_KEYS: dict[str, bytes] = {}


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret key of the surrogates: the session's ``spark.strandmap.surrogateKey``.

    Where that is unset, a random key is drawn for the application, so nobody
    can try out originals; its surrogates don't match those of other runs.
    """
    told = spark.conf.get("spark.strandmap.surrogateKey", None)
    return told.encode() if told else _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark)).select("doc_id", "n_entities", "text")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours of every vector whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def quality_rules(spark: SparkSession, sf_dir: str) -> decision_list.DecisionList:
    """The decision list of all documents, learned from the quality labels; rows of the held-out fold teach nothing."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return decision_list.learn(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, label="quality")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every whole text, the base rules, and the verdict of learned rules."""
    return decision_list.judge(table(spark, sf_dir, "documents"), quality_rules(spark, sf_dir), keep=["doc_id"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level and of a piece tokenizer aligned in every document, with counts of linked ids over all documents."""
    found = alignment.align(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"), keep=["doc_id"])
    return alignment.with_counts(found)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four leading components of the distinct quantised vectors, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), keep=["vec_id"], components=4)


QUERIES = {
    "op1_embedding_join": op1_embedding_join,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op10_pii": op10_pii,
    "op9_ann": op9_ann,
    "op2_bpe": op2_bpe,
    "op3_minhash": op3_minhash,
    "op11_quality_rules": op11_quality_rules,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op1_embedding_join": """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings
    UNION
    SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN low ON low.x = e.vec_id
""",
    "op3_minhash": r"""
WITH RECURSIVE words AS (
    SELECT doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
grams AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                        WHEN len(w) < 4 THEN [array_to_string(w, chr(31))]
                        ELSE list_distinct([array_to_string(w[i:i + 3], chr(31)) FOR i IN range(1, len(w) - 2)]) END AS g
    FROM words
),
sizes AS (SELECT doc_id, len(g)::BIGINT AS n FROM grams),
items AS (SELECT doc_id, unnest(g) AS s FROM grams),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
    FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY ALL
),
links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * k >= 80 * (p.n + q.n - k)
),
reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sizes
    UNION
    SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sizes s JOIN reach r ON r.x = s.doc_id
GROUP BY s.doc_id, s.n
""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
groups AS (SELECT page_id, ('0x' || substring(h, 5 * g + 1, 5))::BIGINT AS n, g FROM p, range(8) r(g)),
digests AS (SELECT page_id, string_agg(
        substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31)::INT + 1, 1) || substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31)::INT + 1, 1) ||
        substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31)::INT + 1, 1) || substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31)::INT + 1, 1), '' ORDER BY g) AS payload_digest
    FROM groups GROUP BY page_id),
latest AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, true AS digest_ok
FROM p JOIN digests USING (page_id) JOIN latest USING (html)
""",
}
