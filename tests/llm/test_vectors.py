"""Whitening and exact top-k search against brute force in plain numpy and Python numbers."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetide.llm import topk, vectors, whitening

SMALLEST = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")

#: Nulls, lengths that differ, repeated rows and ids, ties, vectors that take no part.
AWKWARD = [
    (0, [0.5, -0.25, 1.0]), (0, [0.5, -0.25, 1.0]), (1, None), (2, [0.1, None, 0.2]), (3, [NAN, 0.0, 0.0]),
    (4, [INF, 0.0, 0.0]), (None, [0.75, 0.5, -1.0]), (5, []), (6, [1.0]), (7, [0.001, 0.0, 0.0]), (50, [2.0, -3.0, 0.5]),
    (100, [-0.001, 0.25, 0.125]), (150, [0.5, -0.25, 1.0]), (200, [0.0, 0.0, 0.0]), (None, None), (8, [1e4, -1e4, 3.0]),
]


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SMALLEST}/embeddings.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    frame = spark.createDataFrame(AWKWARD, "vec_id long, embedding array<double>")
    clash = ("vector", "row", "block", "kind", "score", "n", "component", "position", "rank", "cell", "id")
    return frame.withColumns({c: F.lit("extra") for c in clash})


def numbers(rows, scale=256):
    """(id, exact vector) of the rows that take part, all of one length."""
    good = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    return [(i, v + [0] * (width - len(v))) for i, v in good]


def table(frame):
    return [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in frame.select("vec_id", "embedding").collect()]


def test_packing_round_trip():
    x = np.array([[1, 0, 0], [0, 0, 0], [300, -1, 2], [70_000, 0, 0], [2**40, 5, 0], [-128, 127, 1]])
    column = pa.array(vectors.packed(x), pa.binary())
    assert (vectors.unpacked(column, 3) == x).all()
    assert (vectors.unpacked(column.slice(2, 2)) == x[2:4, :2 + 1]).all()
    assert vectors.packed(np.zeros((2, 0), np.int64)) == [b"\1", b"\1"]
    assert vectors.packed(np.array([[7]])) == vectors.packed(np.array([[7, 0, 0]]))


def test_products_are_exact_at_every_size():
    for top in (10, 10**5, 10**8, 2**61):
        x = np.array([[top, -top + 1], [3, top]])
        want = [[int(a) * int(c) + int(b) * int(d) for c, d in x.tolist()] for a, b in x.tolist()]
        assert vectors.exact_products(x, x.T, 2 * top * top).tolist() == want


# --- whitening ---------------------------------------------------------------------------------

def brute_whitening(rows, k=4):
    good = numbers(rows)
    fit = sorted({tuple(v) for _, v in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)]) \
        if d <= 4 else np.cov(np.array(fit, float).T, bias=True)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return good, n, sums, values, axes, np.trace(v)


@pytest.mark.parametrize("source", ["embeddings", "awkward"])
def test_whitening_equals_brute_force(request, source):
    frame = request.getfixturevalue(source)
    rows = table(frame)
    good, n, sums, values, axes, trace = brute_whitening(rows)
    k = len(values)
    got = whitening.whiten(frame).collect()
    assert len(got) == k * len(good)
    assert {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error}
    assert got[0].identity_error < 1e-7  # the awkward rows span nine powers of ten
    want = sorted(([i if i is not None else -1, sum((n * a - s) ** 2 for a, s in zip(x, sums))], x) for i, x in good)
    found = {}
    for r in got:
        found.setdefault(r.component, []).append(((r.vec_id if r.vec_id is not None else -1, int(r.deviation)), r.whitened, r.explained))
    for c in range(1, k + 1):
        mine = sorted(found[c])
        assert [list(a) for a, _, _ in mine] == [a for a, _ in want]
        exact = np.array([(np.array(x) - np.array(sums) / n) @ axes[:, c - 1] / np.sqrt(values[c - 1]) for _, x in want])
        have = np.array([w for _, w, _ in mine])
        sign = np.sign(exact @ have)
        # Rows of one (id, deviation) may stand in another order, so whole sorted lists are compared.
        assert np.allclose(np.sort(have), np.sort(sign * exact), atol=1e-6)
        assert abs(mine[0][2] - values[c - 1] / trace) < 1e-12


def test_factor_and_rotations_on_hard_matrices():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (8, 3), (12, 12), (7, 0)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-4, 5, size=rank)
        v = b @ b.T
        factor = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v, atol=1e-12 * max(1.0, np.abs(v).max()))
        values, vectors_ = whitening.eigen(v)
        want = np.linalg.eigvalsh(v)[::-1][:len(values)]
        assert len(values) <= rank + 1 and np.allclose(values, want, rtol=1e-9, atol=1e-13 * max(1.0, np.abs(v).max()))
        assert np.allclose(vectors_.T @ vectors_, np.eye(len(values)), atol=1e-9)
    graded = np.diag([1e12, 1.0, 1e-4])
    assert np.allclose(whitening.eigen(graded)[0], [1e12, 1.0, 1e-4][:len(whitening.eigen(graded)[0])], rtol=1e-12)


def test_the_fitted_model_does_not_depend_on_partitions(embeddings):
    one, many = (whitening.fit(whitening.fit_list(f)) for f in (embeddings.coalesce(1), embeddings.repartition(7)))
    assert (one.n, one.sums, one.trace) == (many.n, many.sums, many.trace)
    assert (one.components == many.components).all() and (one.eigenvalues == many.eigenvalues).all()


def test_whitening_without_variance_or_rows(spark, awkward):
    assert whitening.whiten(awkward.limit(0)).collect() == []
    assert whitening.whiten(awkward.where("embedding is null")).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert len(got) == 6 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, 0.0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    by = {c: [r for r in whitening.whiten(line).collect() if r.component == c] for c in (1, 2, 3)}
    assert all(r.whitened is not None and abs(r.explained - 1) < 1e-12 for r in by[1])
    assert all(r.whitened is None and r.explained == 0 for c in (2, 3) for r in by[c])
    assert by[1][0].identity_error < 1e-12


def test_deviation_beyond_64_bits(spark):
    big = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    good, n, sums, *_ = brute_whitening(table(big))
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in good}
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(big).collect()}
    assert got == want and max(want.values()) > 2**63


# --- exact top-k search ------------------------------------------------------------------------

def brute_top(rows, k, every=50):
    good = numbers(rows)
    out = []
    for n, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j if j is not None else 0)
                        for m, (j, x) in enumerate(good) if m != n)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found_top(frame, k, every=50, **options):
    got = topk.top_k(frame, F.col("vec_id") % every == 0, k, **options)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()), key=str)


def test_top_k_equals_brute_force(embeddings):
    rows = table(embeddings)
    assert found_top(embeddings, 5) == brute_top(rows, 5)
    assert found_top(embeddings, 7, 20, block_rows=60, sample=30, pivots=5) == brute_top(rows, 7, 20)


def test_top_k_on_awkward_rows(awkward):
    rows = table(awkward)
    for k, sample in ((1, 4), (5, 1024), (100, 3)):
        assert found_top(awkward, k, sample=sample) == brute_top(rows, k)
    assert found_top(awkward.limit(0), 5) == []
    assert found_top(awkward.where("vec_id = 0").limit(1), 5) == []


def test_top_k_with_clusters_copies_and_large_numbers(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 40
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(600)]
    rows += [(600 + i, centres[0].tolist()) for i in range(300)]  # a third are copies
    rows += [(1000 + i, (rng.normal(size=8) * 3e4).tolist()) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found_top(frame, 5, 10, block_rows=50, sample=100) == brute_top(rows, 5, 10)


def test_bounds_rule_out_most_clustered_candidates():
    rng = np.random.default_rng(2)
    x = (np.repeat(rng.normal(size=(8, 16)) * 300, 512, axis=0) + rng.normal(size=(4096, 16)) * 3).astype(np.int64)
    pivots = topk.choose_pivots(x[::41], 8)
    block = topk._Block([np.arange(4096)], [pa.array(range(4096))], [pa.array(vectors.packed(x), pa.binary())], pivots)
    scored = []
    products = topk.exact_products
    topk.exact_products = lambda a, b, bound: scored.append(a.shape[0] * b.shape[1]) or products(a, b, bound)
    try:
        query, place, score = block.search(x[:64], np.arange(64), np.full(64, topk._NONE), pivots, 5)
    finally:
        topk.exact_products = products
    full = x[:64] @ x.T
    np.fill_diagonal(full, -(2**60))
    for q in range(64):
        want = sorted(zip((-full[q]).tolist(), range(4096)))[:5]
        assert [(-s, block.at[p]) for s, p in zip(score[query == q], place[query == q])] == want
    assert sum(scored) < 64 * 4096 / 3
