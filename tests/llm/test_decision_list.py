import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandmap.llm import decision_list, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= {i, i + 1, i + 2}
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


TEXTS = [None, "", " \n\t ", "a", "a b", "a a a a", "x y z x y z", "one\n\none\n one\none \n", "naïve # 漢字 <b>|</b>\x1c x", "\r\na\r\na\n", "a b c " * 30, "é" * 2000]


def test_statistics_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decision_list, "_PIECE", 7)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aab \n#é|") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "old", i) for i, t in enumerate(texts)] + [(None, "a", "old", 1), (3, "a", "old", 2)], "doc_id long, text string, n_words string, extra long")
    out = decision_list.statistics(df)
    assert out.columns == ["doc_id", "text", "extra", *decision_list.STATISTICS]
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert tuple(r)[3:] == brute(r.text)
    assert decision_list.statistics(df.limit(0)).count() == 0


def test_repeated_windows_with_many_distinct_words():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 30, 400)
    assert decision_list._repeated(ids, 2**22) == decision_list._repeated(ids, 30)


def test_base_rules(spark):
    texts = {1: " ".join(f"w{i}" for i in range(50)), 2: " ".join(f"w{i}" for i in range(49)), 3: " ".join(f"w{i}" for i in range(30)) + " a b c" * 10, 4: " ".join(f"w{i}" for i in range(29)) + " a b c" * 10, 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: (r.base_failed, r.kept) for r in decision_list.judge(df, decision_list.DecisionList(), keep=["doc_id"]).collect()}
    assert out == {1: (False, True), 2: (True, False), 3: (False, True), 4: (True, False), 5: (True, False)}


def planted(n=3000, noise=0.02, seed=5):
    """Class 0 where (a > 0.7 and b <= 0.4) or c > 0.9; labels turned over at times."""
    rng = np.random.default_rng(seed)
    x = {k: np.round(rng.random(n), 3) for k in "abc"}
    y = 1 - (((x["a"] > 0.7) & (x["b"] <= 0.4)) | (x["c"] > 0.9)).astype(int)
    return x, np.where(rng.random(n) < noise, 1 - y, y), y


def test_planted_rules_are_found(spark):
    x, noisy, y = planted()
    found = decision_list.learn_rows(x, noisy, np.arange(len(y)) * 7919 % 1000)
    test, _, truth = planted(seed=6)
    frame = spark.createDataFrame([tuple(map(float, row)) for row in zip(*(test[k] for k in "abc"), strict=True)], "a double, b double, c double")
    by_column = [r.v for r in frame.select(found.column({k: F.col(k) for k in "abc"}).alias("v")).collect()]
    by_sql = [r.v for r in frame.selectExpr(f"{found.sql()} AS v").collect()]
    assert by_column == by_sql and np.mean(np.array(by_column) == truth) > 0.97
    assert found.default == 1 and 2 <= len(found.rules) <= 6 and all(r.verdict == 0 and len(r.conditions) <= decision_list.MOST_CONDITIONS for r in found.rules)
    # Rules hold in their order: the first that covers a row decides.
    ordered = decision_list.DecisionList((decision_list.Rule((decision_list.Condition("a", True, 0.5),), 7), decision_list.Rule((decision_list.Condition("a", True, 0.1),), 8)), 9)
    assert [r.v for r in spark.createDataFrame([(0.6,), (0.3,), (0.1,), (None,)], "a double").select(ordered.column({"a": F.col("a")}).alias("v")).collect()] == [7, 8, 9, 9]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, label int")
    for left in (labels, labels.limit(0)):
        assert decision_list.learn(docs, left) == decision_list.DecisionList((), 1)
    one = decision_list.learn_rows({"a": np.arange(4.0)}, np.zeros(4, int), np.arange(4))
    assert one == decision_list.DecisionList((), 0) and one.sql() == "0"
    assert not decision_list.learn_rows({"a": np.ones(40)}, np.arange(40) % 2, np.arange(40) // 2).rules  # nothing tells the classes apart


def test_op11_keeps_clean_and_rejects_junk(spark):
    d = "/root/testdata/sf0.01"
    rules = queries.quality_rules(spark, d)
    assert rules.rules and rules == queries.quality_rules(spark, d)
    out = {r.doc_id: r for r in queries.op11_quality_rules(spark, d).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert set(out) == set(texts)
    held = [(r.quality, out[r.doc_id]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good = [o for q, o in held if q == 1 and not o.base_failed]
    bad = [o for q, o in held if q == 0 and not o.base_failed]
    assert np.mean([o.kept for o in good]) > 0.98 and np.mean([not o.kept for o in bad]) > 0.9
    for i in list(texts)[:40]:
        o = out[i]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == brute(texts[i])
        assert o.base_failed == (o.n_words < 50 or 100 * o.n_repeat_words > 50 * o.n_words) and not (o.base_failed and o.kept)
