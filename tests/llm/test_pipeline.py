import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandmap import session
from strandmap.llm import queries
from strandmap.llm.common import shared_dir
from tests.llm.test_operators import bpe_expected, brute_near
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == docs.columns
        rows = out.collect()
        before = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in queries.op7_toxicity(spark, sf).collect()}
            assert {r.doc_id for r in rows} == {i for i, p in scores.items() if not p}
            assert all(r == before[r.doc_id] for r in rows)
        elif name == "near_duplicates":
            _, comp = brute_near([(i, r.text) for i, r in before.items()], 5)
            assert {r.doc_id for r in rows} == set(comp.values()) and len(rows) == len(set(comp.values()))
        elif name == "personal_data":
            assert len(rows) == len(before)
            for r in rows:
                assert r.n_chars == len(r.text) and r.lang == before[r.doc_id].lang
                old = re.findall(r"[\w.]+@[\w.]+\w|\b\d{16}\b|[0-9a-fA-F]{40}|\+1 \(\d{3}\) 555-\d{4}", before[r.doc_id].text)
                assert not any(x in r.text for x in old) and (old or r.text == before[r.doc_id].text or re.search(r"\d", before[r.doc_id].text))
        elif name == "mixing":
            size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in before.items()}
            copies = {}
            for r in rows:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            assert max(copies.values()) <= 2 and all(r.text == before[r.doc_id].text for r in rows)
            assert abs(sum(size[i] * n for i, n in copies.items()) / (1.5 * sum(size.values())) - 1) < 0.02
        else:
            tokenizer = Tokenizer.from_file(queries.vocabulary_path())
            assert len(rows) == docs.count()
            for r in rows:
                assert np.frombuffer(r.ids, "<u4").tolist() == bpe_expected(tokenizer, before[r.doc_id].text)[0]
        kept[name] = len(rows)
        if name != "tokens":
            docs = spark.createDataFrame(rows, docs.schema)
    assert kept["toxicity"] < 1000 and kept["near_duplicates"] < kept["toxicity"]


def test_run_equals_its_stages(spark, sf):
    folder = Path(shared_dir(spark)) / "strandmap"
    before = set(folder.glob("*"))
    spark.conf.set("spark.strandmap.surrogateKey", "k")
    try:
        out = corpus_pipeline.run(spark, sf)
        assert [p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before] == ["stage-tokens"]
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs.limit(0), sf).schema)
        row = lambda r: (r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.ids))
        assert sorted(map(row, out.collect())) == sorted(map(row, docs.collect()))
    finally:
        spark.conf.unset("spark.strandmap.surrogateKey")


def test_stages_on_odd_rows(spark, sf):
    """Nulls everywhere, empty and blank and very long texts, repeated rows, clashing columns, and the empty table."""
    long = "word " * 40_000
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, "a b c d e f", None, None, None), (3, None, None, None, None), (None, None, None, None, None), (4, "", "en", "s", 0), (5, "  ", "en", None, 2), (6, long, "en", "t", len(long)), (7, "Mr Smith x@y.org", "en", "t", 16)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = plain.withColumns({c: F.lit(c) for c in ("score", "_score", "_gone", "_text", "_hash", "_copies", "n_entities", "entities", "_row", "ids", "n_tokens")})
    want = {"toxicity": 10, "near_duplicates": 9, "personal_data": 10}
    for df in (plain, clashing):
        for name, stage in corpus_pipeline.STAGES:
            out, none = stage(spark, df, sf), stage(spark, df.limit(0), sf)
            got = out.collect()
            assert none.count() == 0 and none.columns == out.columns
            if name != "tokens":
                assert out.columns == df.columns and (name not in want or len(got) == want[name])
                assert df is plain or all(r.score == "score" and r.n_entities == "n_entities" and r["_hash"] == "_hash" for r in got)
            else:
                assert len(got) == 10 and sum(r.n_tokens == 0 for r in got) >= 3
            if name == "near_duplicates":
                assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 1, 3, 4, 5, 6, 7]
            elif name == "personal_data":
                assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got) and not any("Smith" in (r.text or "") for r in got)
            elif name == "mixing":
                assert max(got.count(r) for r in got) <= 4 and any(r.doc_id is None and r.text for r in got)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)
