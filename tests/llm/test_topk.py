import math
import random

import pytest

from timberline.llm import topk


def brute(rows, asked, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, q in fine:
        if asked(i):
            queries[i] = min(queries.get(i, q), q)
    out = []
    for i, q in queries.items():
        found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in fine if j != i and len(c) == len(q))[:k]
        out += [(i, n, j, max(min(-s, (1 << 63) - 1), -(1 << 63))) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, asked, k=5):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, block int")
    return sorted(map(tuple, topk.top_k(df, df.filter(asked), k).collect()))


@pytest.mark.parametrize("dims", [1, 5, 16, 40])
def test_all_scores_are_exact(spark, dims, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES", 6)
    draw = random.Random(dims)
    rows = [(i, [draw.choice((draw.gauss(0, 0.2), 0.5)) for _ in range(dims)]) for i in range(300)]
    assert run(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i % 10 == 0, 5)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e16])
def test_wide_values_are_bounded_and_exact(size, monkeypatch):
    import numpy as np

    draw = np.random.default_rng(int(size) % 97)
    raw = np.floor(draw.normal(0, size, (40, 400))).astype(np.int64)
    raw[:, 7] = raw[:, 3]
    ids = np.arange(400)
    block = topk.Block(40, True, ids.tobytes(), np.ascontiguousarray(raw).tobytes())
    best = topk.Best(topk.Block(40, True, ids[:9].tobytes(), np.ascontiguousarray(raw[:, :9]).tobytes()), 5)
    scored, exact = [], topk._exact
    monkeypatch.setattr(topk, "_exact", lambda v, c: scored.append(c.shape[1]) or exact(v, c))
    topk.search(best, block)
    for q, (scores, found) in enumerate(best.found):
        want = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(raw[:, q], raw[:, j])), topk.LOW), topk.HIGH), j) for j in range(400) if j != q)[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores, found)] == want
    assert size > 1e9 or sum(scored) < 9 * 200  # most candidates are never scored in full


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, []), (8, [1.0]), (9, [3.0, -1.0]), (9, [3.0, -1.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [1e9, 2.0]), (12, [1e9, -2e9]), (13, [-1e12, 1e12])]
    assert run(spark, rows, "true", 3) == brute(rows, lambda i: True, 3)


def test_no_rows_and_no_queries(spark):
    assert run(spark, [], "true") == []
    assert run(spark, [(1, [1.0])], "vec_id = 5") == []
    assert run(spark, [(1, [1.0])], "true") == []
