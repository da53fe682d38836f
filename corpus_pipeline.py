"""A training corpus from raw documents, in five stages.

Each stage takes the documents that its predecessor kept and is written as
Parquet before the next one reads it. All stages take null and empty texts,
null and repeated doc_ids, null sources, repeated rows and empty tables, from
which they return empty ones; what each makes of them is told with the stage.
Columns beyond those of documents stay, whatever their names, up to the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.llm import bpe, minhash, mixing, pii, queries, toxicity
from strandmap.llm.common import drop, free_name, scratch, shared_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.7 or more; the model learns from the labels of the documents left here.

    Every row is scored on its own, so repeated rows go or stay together. Null
    and empty texts have the score of a text without toxic words. A table that
    holds none of the labelled toxic documents loses nothing.
    """
    model = toxicity.fit_from_labels(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    mark = free_name(docs, "_score")  # the operator would replace a column named score
    scored = toxicity.score(docs.withColumnsRenamed({"score": mark}), model).where("score < 0.7").drop("score")
    return scored.withColumnsRenamed({mark: "score"}).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate group (five words, 0.8).

    Null, empty and blank texts are in no group and stay, as do rows with a
    null doc_id. Rows that repeat the doc_id that stays are one document and
    stay too.
    """
    return minhash.keep_first(docs, width=5, percent=80).select(*(F.col(f"`{c}`") for c in docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates for personal data; n_chars follows the new text.

    A null text stays null, with a null n_chars; rows are kept, repeated ones
    with the same new text. The key is the session's: see ``queries.surrogate_key``.
    """
    taken = {"n_entities", "entities"} & set(docs.columns)
    names = {c: free_name(docs, f"_{c}") for c in taken}
    replaced = pii.replace(docs.withColumnsRenamed(names), queries.surrogate_key(spark)).drop("n_entities", "entities").withColumnsRenamed({v: k for k, v in names.items()})
    return replaced.select(*(F.col(f"`{c}`") for c in docs.columns)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to their target weights: a document appears as often as the mix takes it.

    A null source is a source of its own, the last. Null and empty texts have
    no words and appear as their source's rate says. Rows with a null doc_id
    and repeated rows have copies of their own.
    """
    return mixing.repeat(docs, mixing.mix(docs, weights=[5, 2, 1], share=1.5, cap=2.0))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, packed, with their number and the digest of the decoded text.

    Null and empty texts have no tokens and the digest of the empty text.
    """
    v = bpe.load_vocabulary(queries.vocabulary_path())
    back = bpe.round_trip(docs, v, keep=["doc_id", "lang", "source"])
    return back.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: The models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``.

    What a stage stores meanwhile goes when it is written, and its input with
    it, so a run leaves the last stage alone.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop(spark, before)
        before = path
    return docs
