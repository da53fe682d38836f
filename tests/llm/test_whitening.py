import math

import numpy as np
import pytest

from strandmap.llm import queries, whitening


def brute(rows, k=4):
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [(i, [math.floor(256 * c) + 0 for c in v]) for i, v in fine]
    fit = sorted({tuple(v) for _, v in x})
    n, width = len(fit), len(fit[0])
    s = [sum(v[d] for v in fit) for d in range(width)]
    centred = np.array([[v[d] - s[d] / n for d in range(width)] for v in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, v in x:
        z = (np.array(v) - np.array(s) / n) @ vectors
        out.setdefault(i, []).append((n, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), z, values, values / np.trace(cov)))
    return out


def agrees(rows, found, k=4):
    want = brute(rows, k)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, []).append(r)
    assert {i: len(v) for i, v in got.items()} == {i: len(v) * min(k, len(v[0][2])) for i, v in want.items()}
    sign = {}
    for i, rs in sorted(got.items(), key=lambda x: (x[0] is None, x[0])):
        for r in rs:
            n, deviation, z, values, explained = want[i][0] if len(want[i]) == 1 else min(want[i], key=lambda w: w[1] != r.deviation)
            c = r.component - 1
            assert r.n == n and r.deviation == deviation and abs(r.explained - explained[c]) <= 1e-9 and r.identity_error <= 1e-9
            w = z[c] / math.sqrt(values[c])
            if abs(w) > 1e-3:
                assert sign.setdefault(c, math.copysign(1, w * r.whitened)) == math.copysign(1, w * r.whitened)
            assert abs(abs(w) - abs(r.whitened)) < 1e-8


@pytest.mark.parametrize("block", [None, 2, 3])
def test_whitening_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(80, 7)) * [1, 3, 0.5, 2, 0.1, 4, 1.5]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, base[0].tolist()) for i in range(20)] + [(3, base[5].tolist())]
    rows += [(200, None), (201, []), (202, [float("nan")] * 7), (203, [None] + [1.0] * 6), (204, [float("-inf")] * 7), (205, [-0.0] * 7), (None, base[1].tolist()), (206, [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "old") for i, v in rows], "vec_id long, embedding array<double>, n string").repartition(3)
    out = whitening.whitened(df, block=block)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agrees(rows, out.collect())
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.where("vec_id between 200 and 204")).count() == 0


def test_op13_on_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    agrees(rows, queries.op13_whitening(spark, sf).collect())


def test_vectors_that_hardly_vary(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    out = whitening.whitened(df.where("vec_id < 3")).collect()
    assert len(out) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error == 0 for r in out)
    # Of two widths with as many distinct vectors the smaller one counts.
    assert {r.vec_id for r in whitening.whitened(df).collect()} == {1, 2}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    rows = {(r.vec_id, r.component): r for r in whitening.whitened(line).collect()}
    assert rows[0, 2].whitened is None and abs(rows[0, 1].explained - 1) < 1e-12 and abs(abs(rows[0, 1].whitened) - math.sqrt(2)) < 1e-12


def test_large_entries(spark):
    df = spark.createDataFrame([(1, [3e15, 0.0]), (2, [-1e300, 1.0]), (3, [5e15, -2.0])], "vec_id long, embedding array<double>")
    out = whitening.whitened(df).collect()
    assert len(out) == 6 and all(r.deviation is None for r in out) and all(r.whitened is not None for r in out if r.component == 1)
    mid = spark.createDataFrame([(i, [2.0**20 * i, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    agrees([(r.vec_id, r.embedding) for r in mid.collect()], whitening.whitened(mid, components=1).collect(), k=1)


def test_sums_are_exact(spark):
    x = whitening.quantised(spark.createDataFrame([(i, [2.0**54 + 2**20 * i, -(2.0**54)]) for i in range(40)], "vec_id long, embedding array<double>"))
    distinct, width, n = whitening.fit_list(x)
    assert (width, n) == (2, 40)
    assert whitening.column_sums(distinct, width).tolist() == [sum(2**62 + 2**28 * i for i in range(40)), -40 * 2**62]
