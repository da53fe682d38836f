"""The full-text and the vector index: segments, edits, compaction, pinned generations, pruning, exactness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap import manifest, store
from strandmap.functions import stemmer
from strandmap.plans import index, retrieval, search, segments, vector_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(n, shift=0):
    words = ["alpha", "alps", "beta", "betray", "gamma", "the", "omega", "a"]
    return [(i, " ".join(words[(i * 7 + j * (j + shift)) % 8] for j in range(i % 9)) + " the", f"s{i % 3}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, source string")


def scores(hits):
    return sorted((r.id, round(r.raw_score, 9)) for r in hits.select("id", "raw_score").collect())


@pytest.fixture(scope="module")
def edited(spark, tmp_path_factory):
    """An index of 60 documents, edited twice, with the rows that are live in each generation."""
    root = str(tmp_path_factory.mktemp("index") / "i")
    rows = {r[0]: r for r in texts(60)}
    states = {1: dict(rows)}
    made = index.build(frame(spark, list(rows.values())), root, "id", carry=("source",))
    changed = [(i, "alpha brand new", "s9") for i in (3, 7, 200, 201)]
    made = index.update(made, frame(spark, changed), spark.createDataFrame([(5,), (6,), (999,)], "id long"))
    rows = {i: r for i, r in rows.items() if i not in (5, 6)} | {r[0]: r for r in changed}
    states[2] = dict(rows)
    made = index.update(made, frame(spark, [(200, "beta again", "s1"), (6, "alpha returns", "s0")]))
    rows |= {200: (200, "beta again", "s1"), 6: (6, "alpha returns", "s0")}
    states[3] = dict(rows)
    made = index.update(made, None, spark.createDataFrame([(7,)], "id long"))
    states[4] = {i: r for i, r in rows.items() if i != 7}
    return root, states


QUERIES = [[retrieval.Term("alpha")], [retrieval.Term("al", True), retrieval.Term("beta")], [retrieval.Term("a", True)], [retrieval.Term("zebra")], [retrieval.Term("the"), retrieval.Term("the", True)]]


@pytest.mark.parametrize("generation", [1, 2, 3, 4])
def test_every_generation_equals_a_scan(spark, edited, generation):
    root, states = edited
    live = frame(spark, list(states[generation].values()))
    built = index.load(spark, root, generation)
    assert built.live.total("rows") == len(states[generation])
    for terms in QUERIES:
        assert scores(built.bm25(terms)) == scores(retrieval.bm25(live, terms))
        where = F.col("source") == "s1"
        assert scores(built.bm25(terms, where)) == scores(retrieval.bm25(live.where(where), terms))
    assert built.bm25([]).count() == 0


@pytest.mark.parametrize("n", range(1, 13))
def test_prefixes_of_any_length(spark, edited, n):
    root, states = edited
    terms = [retrieval.Term("betrayalpha"[:n] if n < 7 else "betray" + "x" * (n - 6), prefix=True)]
    assert scores(index.load(spark, root).bm25(terms)) == scores(retrieval.bm25(frame(spark, list(states[4].values())), terms))


def test_compaction(spark, edited, monkeypatch):
    root, states = edited
    monkeypatch.setattr(segments, "MERGE_SHARE", 0.0)
    before = index.load(spark, root, 4)
    after = index.compact(before)
    assert after.live.generation == 5 and len(after.live.state["segments"]) == 1 and not after.live.state["tombstones"] and after.live.state["hidden"]["rows"] == 0
    assert after.live.total("rows") == len(states[4]) and after.live.total("length") == before.live.total("length")
    for terms in QUERIES:
        assert scores(after.bm25(terms)) == scores(before.bm25(terms))
    assert index.compact(after).live.generation == 5  # nothing is due
    # Earlier generations stay readable, and a writer that began from one of them loses.
    assert scores(index.load(spark, root, 2).bm25(QUERIES[0])) == scores(retrieval.bm25(frame(spark, list(states[2].values())), QUERIES[0]))
    with pytest.raises(FileExistsError):
        index.update(before, None, spark.createDataFrame([(1,)], "id long"))


def test_small_segments_are_due_and_large_ones_are_not(spark):
    def due(rows, hidden=0):
        state = {"key": "id", "generation": 9, "segments": [{"generation": i, "rows": n} for i, n in enumerate(rows)], "tombstones": [], "hidden": {"rows": hidden}}
        return [s["generation"] for s in segments.Segments(spark, "", state).due()]

    assert due([1000, 10]) == [] and due([1000, 100, 90]) == [1, 2] and due([1000, 500, 300]) == [0, 1, 2] and due([1000, 10], hidden=300) == [0, 1] and due([5]) == []


def test_a_query_reads_its_own_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        built = index.build(frame(spark, texts(400)), str(tmp_path / "i"), "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks, df = built.blocks([retrieval.Term("gamma")])
    assert df == [sum("gamma" in t.split() for _, t, _ in texts(400))]
    every = [r.block for r in built.live.read("postings").select("block").distinct().collect()]
    assert len(every) > 1 and len(next(iter(blocks.values()))) < len(every)
    text = plan(built.postings([retrieval.Term("gamma")]))
    assert "PartitionFilters: [block" in text.replace("isnotnull(block#", "block#") or "PartitionFilters: [isnotnull(block" in text
    assert "EqualTo(term,gamma)" in text
    # A word of all documents runs over several blocks.
    assert len(next(iter(built.blocks([retrieval.Term("the")])[0].values()))) > 1


def test_empty_tables_and_null_texts(spark, tmp_path):
    none = index.build(frame(spark, []), str(tmp_path / "none"), "id")
    assert scores(none.bm25(QUERIES[1])) == [] and index.update(none, frame(spark, [(1, "alpha", "s")])).bm25(QUERIES[0]).count() == 1
    some = index.build(frame(spark, [(1, None, "s"), (2, "", None), (3, "alpha", "s")]), str(tmp_path / "some"), "id")
    assert some.live.total("rows") == 3 and [i for i, _ in scores(some.bm25(QUERIES[0]))] == [3]


# Words and stems of the public sample vocabulary of the Snowball stemmer.
GOLDEN = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагонов вагон важная важн важнее важн важнейшие важн важнейшими важн важничал важнича важно важн важного важн
важности важност важностью важност важную важн вазах ваз вакса вакс валандался валанда валентина валентин валериановых валерианов валерию валер валетами валет п п па па пава пав
павильонам павильон павлиний павлин павлиньим павлин павловна павловн падает пада падай пада падаль падал падать пада падаю пада падающего пада падение паден падением паден падений паден
паденье паден падет падет падут падут падучая падуч падчерица падчериц падшая падш падшему падш паек паек пазухи пазух пай па"""


def test_stems():
    words = GOLDEN.split()
    assert stemmer.stems(words[::2]) == words[1::2]
    assert [stemmer.russian(w) for w in words[::2]] == words[1::2]
    assert stemmer.stems(["hello", "", "ъ", "документ7", "я" * 70]) == ["hello", "", "ъ", "документ7", "я" * 70] and stemmer.stems([]) == []


def test_search_finds_inflected_forms(spark, tmp_path):
    rows = [(1, "отчет о продажах товаров", "s"), (2, "Продажа товара", "s"), (3, "закупка", "s"), (4, "продажи и продажами", "s"), (5, "продать", "s")]
    plain, stemmed = (index.build(frame(spark, rows), str(tmp_path / str(i)), "id", stems=bool(i)) for i in (0, 1))
    find = lambda made, q: {r.id for r in made.bm25(retrieval.query_terms(q)).collect()}
    assert find(plain, "продажа") == {2} and find(stemmed, "продажа") == {1, 2, 4} and find(stemmed, "товаром") == {1, 2}
    counts = {r.id: r.raw_score for r in stemmed.bm25(retrieval.query_terms("продажа")).collect()}
    assert counts[4] > counts[1]  # both forms count
    later = index.update(stemmed, frame(spark, [(3, "закупка и продаже", "s")]))
    assert find(later, "продажа") == {1, 2, 3, 4}


def test_objects_take_the_rank_of_their_best_chunk(spark):
    rows = [("c", "A.Many", f"alpha beta {'x ' * i}", i) for i in range(1, 4)] + [("c", "A.Best", "alpha", 10), ("c", "A.Other", "beta", 11)]
    corpus = spark.createDataFrame(rows, "context string, path string, text string, n int").select("context", "path", F.lit("Catalog").alias("kind"), F.substring_index("path", ".", -1).alias("name"), F.lit("").alias("synonym"), F.lit("").alias("comment"), "text")
    out = search.search(corpus, "alpha", k=9, with_lanes=False).collect()
    assert [r.path for r in out] == ["A.Best", "A.Many"]


# Vectors


def clustered(n=1500, width=24, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [(i, v.tolist()) for i, v in enumerate(centres[np.arange(n) % groups] + rng.normal(scale=0.3, size=(n, width)))]


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = clustered()
    return rows, vector_index.build(vector_frame(spark, rows), str(tmp_path_factory.mktemp("v") / "i"), "id", lists=24)


def exact(spark, rows, q, k):
    return [(r.id, round(r.raw_score, 9)) for r in retrieval.top(retrieval.cosine(vector_frame(spark, rows), q), k, "id").collect()]


def found(hits):
    return [(r.id, round(r.raw_score, 9)) for r in hits.orderBy(F.desc("raw_score"), "id").collect()]


def test_exact_search_prunes_lists_and_codes(spark, vectors):
    rows, built = vectors
    for i in (0, 17):
        assert found(built.search(rows[i][1], 20)) == exact(spark, rows, rows[i][1], 20)
    q = vector_index._direction(rows[0][1])
    bound = built._bound(q, built.lists_for(rows[0][1])[:2], None, 20)
    centres = np.sqrt(vector_index._squares(q[None], built.quantiser.centres)[0])
    read = [i for i, (radius, _) in built.lists.items() if centres[i] - radius <= bound]
    assert len(read) < len(built.lists) / 2
    assert built._scored(q, read, None).where(F.col("low") <= bound).count() < 100  # of 1,500
    text = plan(built._scored(q, read, None))
    assert "PartitionFilters: [list" in text and "vector" not in text


def test_recall_of_few_lists(spark, vectors):
    rows, built = vectors
    hit = 0
    queries = rows[:: len(rows) // 12]
    for _, q in queries:
        hit += len({i for i, _ in found(built.search(q, 10, probes=4))} & {i for i, _ in exact(spark, rows, q, 10)})
    assert hit >= 0.9 * 10 * len(queries)
    assert len(built.lists_for(rows[0][1], 4)) == 4


def test_search_among_some_keys(spark, vectors):
    rows, built = vectors
    among = spark.range(0, 1500, 7).withColumnRenamed("id", "id")
    assert found(built.search(rows[3][1], 15, among)) == exact(spark, [r for r in rows if r[0] % 7 == 0], rows[3][1], 15)


def test_odd_vectors_edits_and_compaction(spark, tmp_path, monkeypatch):
    rows = clustered(80, 5, 4) + [(900, [0.0] * 5), (901, None), (902, []), (903, [float("nan")] * 5), (904, [1.0, 2.0]), (905, [None] * 5)]
    built = vector_index.build(vector_frame(spark, rows), str(tmp_path / "i"), "id")
    live = [r for r in rows if r[0] < 901]
    q = rows[2][1]
    assert built.live.total("rows") == 81 and found(built.search(q, 81)) == exact(spark, live, q, 81)
    assert found(built.search([0.0] * 5, 3)) == exact(spark, live, [0.0] * 5, 3) and built.search([1.0, 2.0], 3).count() == 0
    built = vector_index.update(built, vector_frame(spark, [(2, rows[40][1]), (950, q)]), spark.createDataFrame([(5,), (6,)], "id long"))
    live = [r for r in live if r[0] not in (2, 5, 6)] + [(2, rows[40][1]), (950, q)]
    assert found(built.search(q, 30)) == exact(spark, live, q, 30)
    monkeypatch.setattr(segments, "MERGE_SHARE", 0.0)
    merged = vector_index.compact(built)
    assert merged.live.total("rows") == len(live) and len(merged.live.state["segments"]) == 1
    assert found(merged.search(q, 30)) == found(vector_index.load(spark, built.live.root, 2).search(q, 30))
    with pytest.raises(ValueError):
        vector_index.build(vector_frame(spark, rows[81:]).limit(0), str(tmp_path / "none"), "id")


# What is stored notices change.


def test_manifests(spark, tmp_path):
    root = str(tmp_path)
    assert manifest.read(spark, root) is None and manifest.generations(spark, root) == []
    manifest.commit(spark, root, {"a": 1}, 1)
    with pytest.raises(FileExistsError):
        manifest.commit(spark, root, {"a": 2}, 1)
    manifest.commit(spark, root, {"a": 3}, 2)
    assert manifest.read(spark, root) == {"a": 3, "generation": 2} and manifest.read(spark, root, 1)["a"] == 1 and manifest.read(spark, root, 7) is None


def test_stored_forms_follow_their_source(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.range(25).write.parquet(source)
    count = lambda: spark.read.parquet(store.once(spark, source, "copy", lambda p: spark.read.parquet(source).write.parquet(p))).count()
    assert count() == 25 and store.once(spark, source, "copy", lambda p: 1 / 0)
    spark.range(3).write.mode("overwrite").parquet(source)
    assert count() == 3


def test_crowded_values_are_many_files(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).selectExpr("'type' AS kind", "'same' AS target", "concat('n', id) AS origin")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together
    try:
        store.write_sorted(rows, str(tmp_path / "l"), "kind", "target", "origin")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "l/kind=type").glob("*.parquet"))) > 1


def test_words_are_counted_where_their_text_is(spark):
    """Texts are shuffled once by key; words are neither shuffled before they are counted nor sorted."""
    docs = spark.createDataFrame([(1, "a b a", "x"), (2, None, "y"), (3, "b", None)], "doc_id long, text string, kind string")
    counts = index._counts(docs, "doc_id", "text", ["kind"])
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1 and "SortAggregate" not in text
    assert {tuple(r[c] for c in ("term", "doc_id", "tf", "doc_len", "kind")) for r in counts.collect()} == {("a", 1, 2, 3, "x"), ("b", 1, 1, 3, "x"), ("b", 3, 1, 1, None)}
