"""A full-text index in segments: a sorted dictionary leads to the blocks of postings that hold a query's terms.

Postings are sorted by term and cut into blocks of about one size; a common
word runs over many blocks. The dictionary has, for each term and block, how
many documents hold the term there, so equal words, prefixes of any length and
words of one stem become a few blocks to read. Segments and edits: see
``segments``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.functions import stemmer, text
from strandmap.plans import segments
from strandmap.plans.retrieval import Term, okapi
from strandmap.plans.segments import Folder, Segments, Writer
from strandmap.session import ship


def _test(term: Term, stems: bool) -> Column:
    """Whether a row of the dictionary answers a term of the query."""
    if term.prefix:
        return F.startswith(F.col("term"), F.lit(term.word))
    if stems:
        return F.col("stem") == stemmer.russian(term.word)
    return F.col("term") == term.word


@dataclass
class TextIndex:
    """docs: all columns of the live documents but their text, with doc_len; postings: block, term, stem, key, tf, doc_len and the carried columns."""

    live: Segments

    @property
    def key(self) -> str:
        return self.live.key

    @property
    def carried(self) -> list[str]:
        return [self.key, *self.live.state["carry"]]

    @property
    def docs(self) -> DataFrame:
        return self.live.read("docs")

    def blocks(self, terms: list[Term]) -> tuple[dict[str, list[int]], list[int]]:
        """Blocks by segment that hold some term, and the documents of each term over all segments, hidden ones too.

        Only rows of the dictionary that answer the terms are read; what comes back has a row for each block.
        """
        stems = self.live.state["stems"]
        tests = [_test(t, stems) for t in terms]
        found = {}
        df = [0] * len(terms)
        rows = []
        for segment, dictionary in self.live.parts_of("terms"):
            rows.append(dictionary.where(reduce(lambda a, b: a | b, tests, F.lit(False))).withColumn("_segment", F.lit(segment["path"])))
        whole = reduce(DataFrame.unionByName, rows)
        for r in whole.groupBy("_segment", "block").agg(*(F.sum(F.when(t, F.col("df")).otherwise(0)).alias(f"df{i}") for i, t in enumerate(tests))).collect():
            found.setdefault(r["_segment"], []).append(r["block"])
            df = [n + r[f"df{i}"] for i, n in enumerate(df)]
        return {k: sorted(v) for k, v in found.items()}, df

    def postings(self, terms: list[Term], where: Column | None = None, blocks: dict[str, list[int]] | None = None) -> DataFrame:
        """Live postings of the terms; other blocks are not read."""
        blocks = self.blocks(terms)[0] if blocks is None else blocks
        test = reduce(lambda a, b: a | b, (_test(t, self.live.state["stems"]) for t in terms), F.lit(False))

        def narrow(rows: DataFrame, segment: dict) -> DataFrame:
            rows = rows.where(F.col("block").isin(blocks.get(segment["path"], [])) & test)
            return rows if where is None else rows.where(where)

        return self.live.read("postings", narrow)

    def bm25(self, terms: list[Term], where: Column | None = None) -> DataFrame:
        """(key, carried columns, raw_score) of the documents with some term; ``where`` may use carried columns and counts before everything.

        Numbers and lengths of all documents come from the manifest, and where
        nothing is hidden or filtered the documents of a plain term come from the
        dictionary; else they are counted over the terms' own postings.
        """
        state, spark = self.live.state, self.live.spark
        if where is None:
            n = self.live.total("rows")
            average = self.live.total("length") / max(n, 1)
        else:
            stats = self.docs.where(where).agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg")).first()
            n, average = stats["n"], stats["avg"]
        if not terms:
            return self.docs.select(*self.carried, F.lit(0.0).alias("raw_score")).limit(0)
        blocks, df = self.blocks(terms)
        tests = [_test(t, state["stems"]) for t in terms]
        found = self.postings(terms, where, blocks)
        others = [F.first(c).alias(c) for c in state["carry"]]
        counted = found.groupBy(self.key).agg(F.first("doc_len").alias("_len"), *others, *(F.sum(F.when(t, F.col("tf")).otherwise(0)).alias(f"_tf{i}") for i, t in enumerate(tests)))
        if where is not None or state["tombstones"] or state["stems"] or any(t.prefix for t in terms):
            row = counted.agg(*(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
            df = [row[f"df{i}"] for i in range(len(terms))]
        return counted.select(*self.carried, okapi(int(n), float(average or 1.0), df).alias("raw_score"))


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < tasks:  # a small table in few splits would be taken apart by as few tasks
        docs = docs.repartition(tasks)
    return _with_length(docs, text_col)


def _with_length(docs: DataFrame, text_col: str) -> DataFrame:
    length = F.regexp_count(F.col(text_col), F.lit(r"[\p{L}\p{N}]+")).cast("long")
    return docs.withColumn("doc_len", F.coalesce(length, F.lit(0)))


def _counts(docs: DataFrame, key: str, text_col: str, carry: list[str]) -> DataFrame:
    """(term, key, doc_len, carried columns, tf): texts are dealt by key, so their words are counted where they are and aren't shuffled one by one.

    Carried columns follow from the key and are grouped by, as texts kept as first values would have every word sorted.
    """
    dealt = _with_length(docs.select(key, text_col, *carry).repartition(F.col(key)), text_col)
    words = dealt.select(key, "doc_len", *carry, F.explode(text.tokens(F.col(text_col))).alias("term"))
    return words.groupBy("term", key, "doc_len", *carry).agg(F.count("*").alias("tf"))


def _store(docs: DataFrame, counts: DataFrame, folder: Folder, key: str, stems: bool) -> dict:
    """Write a segment: documents, postings in blocks, the dictionary of the blocks."""
    stored = folder.put("docs", docs)
    # The key parts a common word over blocks; a block is one task's range.
    ranged = counts.repartitionByRange(F.col("term"), F.col(key)).sortWithinPartitions("term", key)
    if stems:
        ship(docs.sparkSession)
        ranged = ranged.withColumn("stem", stemmer.stem_of("term"))
    written = folder.put("postings", ranged.withColumn("block", F.spark_partition_id()), by="block")
    order = ["stem", "term"] if stems else ["term"]  # words of a stem lie together where stems are asked for
    dictionary = written.groupBy(*order, "block").agg(F.count("*").alias("df"))
    folder.put("terms", dictionary.repartitionByRange(*map(F.col, order), F.col("block")).sortWithinPartitions(*order))
    return _facts(stored)


def _facts(docs: DataFrame) -> dict[str, int]:
    return docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length")).first().asDict()


def _writer(docs: DataFrame, key: str, text_col: str, carry: list[str], stems: bool) -> Writer:
    whole = _measured(docs, text_col)
    return lambda folder: _store(whole.drop(text_col), _counts(docs, key, text_col, carry), folder, key, stems)


def build(docs: DataFrame, path: str, key: str, text_col: str = "text", carry: tuple[str, ...] = (), stems: bool = False) -> TextIndex:
    """Write an index of ``docs``, whose keys are distinct; columns ``carry`` are kept with each posting, so that filters on them need no join.

    With ``stems``, words match all words of their Russian stem.
    """
    others = [c for c in carry if c != key]
    return TextIndex(segments.create(docs.sparkSession, path, key, _writer(docs, key, text_col, others, stems), carry=others, text=text_col, stems=stems))


def update(index: TextIndex, changed: DataFrame | None = None, removed: DataFrame | None = None) -> TextIndex:
    """A generation in which documents are replaced or added (``changed``, as they were built) or gone (keys ``removed``).

    The work grows with the edit: a segment of the changed documents, and
    tombstones of all keys told, whether the index had them or not.
    """
    now, key = index.live, index.key
    told = [df.select(key) for df in (changed, removed) if df is not None]
    keys = reduce(DataFrame.unionByName, told).distinct()
    hidden = _facts(index.docs.join(keys, key, "left_semi"))
    state = now.state
    return TextIndex(segments.change(now, keys, hidden, None if changed is None else _writer(changed, key, state["text"], state["carry"], state["stems"])))


def compact(index: TextIndex) -> TextIndex:
    """Merge segments that are due (see ``Segments.due``): live postings are sorted again, texts are not read."""
    now = index.live

    def rewrite(due: list[dict], folder: Folder) -> dict:
        postings = now.read("postings", of=due).drop("block", "stem")
        return _store(now.read("docs", of=due), postings, folder, index.key, now.state["stems"])

    return TextIndex(segments.compact(now, rewrite))


def load(spark: SparkSession, path: str, generation: int | None = None) -> TextIndex:
    """An index as its newest generation has it, or a pinned one."""
    return TextIndex(segments.load(spark, path, generation))
