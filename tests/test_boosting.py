"""Leaf-wise boosting against a plain grower in Python, and everything read off its trees."""

import math
import threading
import time
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.functions.numeric import standardise
from pricetide.operators import boosting, demand, pricing

FEATURES = ["a", "b", "c"]
OPTIONS = boosting.Options(rounds=12, learning_rate=0.3, leaves=7, least_rows=3, seed=5)


def sample(n=400, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n).round(1), rng.integers(0, 5, n).astype(float), rng.uniform(size=n)
    y = np.maximum(0, np.round(10 + 4 * a + (b == 2) * 6 - 8 * (c > 0.7)))
    a[rng.uniform(size=n) < 0.1] = math.nan
    y[np.isnan(a)] += 15
    return [(int(i), float(a[i]), float(b[i]), float(c[i]), float(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(sample(), "i long, a double, b double, c double, y double").repartition(5)


@pytest.fixture(scope="module")
def model(rows):
    return boosting.fit(rows, FEATURES, "y", F.col("i"), OPTIONS)


def same(a, b):
    return a.base == b.base and len(a.trees) == len(b.trees) and all(
        x.features.tolist() == y.features.tolist() and x.bins.tolist() == y.bins.tolist() and x.values.tolist() == y.values.tolist()
        and x.missing_left.tolist() == y.missing_left.tolist() for x, y in zip(a.trees, b.trees))


def leaf(tree, codes):
    """The leaf of one row by walking down."""
    at = 0 if len(tree.features) else -1
    while at >= 0:
        code = codes[tree.features[at]]
        left = tree.missing_left[at] if code == boosting.MISSING else code <= tree.bins[at]
        at = int(tree.left[at] if left else tree.right[at])
    return -1 - at


def plain_tree(codes, residual, o):
    """Best-first growth over all rows and features, one leaf at a time."""
    sign = -np.sign(residual)

    def worth(rows):
        return max(abs(sign[rows].sum()) - o.l1, 0) ** 2 / (len(rows) + o.l2)

    def best(rows):
        found = (0.0, None)
        for missing_left in (False, True):
            for f in range(len(codes)):
                for b in range(boosting.MISSING):
                    code = codes[f][rows]
                    left = (code <= b) | ((code == boosting.MISSING) & missing_left) if missing_left else code <= b
                    l, r = rows[left], rows[~left]
                    if min(len(l), len(r)) < o.least_rows:
                        continue
                    gain = worth(l) + worth(r) - worth(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, (l, r))
        return found

    leaves = [(best(r), r) for r in [np.arange(len(residual))]]
    while len(leaves) < o.leaves:
        k = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
        if leaves[k][0][1] is None:
            break
        leaves[k:k + 1] = [(best(r), r) for r in leaves[k][0][1]]
    return [(set(r.tolist()), o.learning_rate * float(np.sort(residual[r])[(len(r) - 1) // 2])) for _, r in leaves]


def test_trees_equal_a_plain_grower():
    data = np.array([r[1:4] for r in sample(150)]).T
    y = np.array([r[4] for r in sample(150)], np.float32)
    model = boosting.BoostedTrees(FEATURES, [np.unique(d[~np.isnan(d)])[:62] for d in data], 0.0)
    codes = model.codes(data)
    options = boosting.Options(learning_rate=0.5, leaves=6, feature_fraction=1, row_fraction=1, least_rows=5)
    trainer = boosting.Trainer(boosting._Group(1), codes, y, np.arange(150, dtype=np.uint32), options)
    score = np.full(150, trainer.base())
    assert score[0] == np.sort(y)[74]
    for number in range(4):
        residual = y - score.astype(np.float32)
        want = plain_tree(codes, residual, options)
        tree = trainer.round(number, score)
        found = {}
        for i in range(150):
            found.setdefault(leaf(tree, codes[:, i]), set()).add(i)
        assert sorted((sorted(r), v) for r, v in want) == sorted((sorted(r), tree.values[k]) for k, r in found.items())
        assert np.allclose(score - (y - residual), [tree.values[leaf(tree, codes[:, i])] for i in range(150)], atol=1e-4)


def test_the_same_trees_from_any_number_of_tasks(rows, model):
    few = replace(OPTIONS, rounds=2)  # an exchange between tasks takes a second
    assert same(boosting.fit(rows, FEATURES, "y", F.col("i"), few), boosting.fit(rows, FEATURES, "y", F.col("i"), few, rows_a_task=150))
    assert len(model.trees) == 12 and max(len(t.values) for t in model.trees) == 7


def test_the_same_trees_from_any_number_of_processes(rows, model):
    for least in (40, 150, 1 << 15):  # four processes, two, one
        assert same(model, boosting.fit(rows, FEATURES, "y", F.col("i"), OPTIONS, rows_a_process=least))


def test_processes_add_up_and_a_failure_ends_them():
    group = boosting._Processes(3, 8)
    assert group.run(lambda place: [group.total(np.arange(6).reshape(2, 3) * (place + 1) + n).tolist() for n in range(5)]) == [
        (np.arange(6).reshape(2, 3) * 6 + 3 * n).tolist() for n in range(5)]

    def fails(place):
        if place == 1:
            raise ValueError("lost")
        return group.total(np.zeros(2, np.int64))

    group = boosting._Processes(2, 8)
    with pytest.raises(threading.BrokenBarrierError):
        group.run(fails)


def test_more_than_a_million_rows_need_no_barrier(spark, monkeypatch):
    """Beside a barrier each exchange takes a second: 2,000 trees would take hours."""
    jobs, job = [], boosting._job
    monkeypatch.setattr(boosting, "_job", lambda *args: jobs.append(args[3:5]) or job(*args))
    many = spark.range(1_100_000).selectExpr("id i", "double(id % 9) a", "double(id % 9 + id % 2) y")
    assert len(boosting.fit(many, ["a"], "y", F.col("i"), boosting.Options(rounds=1)).trees) == 1
    assert jobs == [(1, 4)]


def test_parts_of_rounds_give_the_same_trees(rows, model, monkeypatch):
    monkeypatch.setattr(boosting, "ROUNDS_A_JOB", 5)
    parts = boosting.fit(rows, FEATURES, "y", F.col("i"), OPTIONS)
    assert parts.base == model.base and [t.bins.tolist() for t in parts.trees] == [t.bins.tolist() for t in model.trees]


def test_medians_are_exact():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), -rng.uniform(size=100) * 1e-30, [0.0, -0.0, 1e30, -1e30]]).astype(np.float32)
    which = rng.integers(0, 9, len(values))
    which[which == 4] = 3
    got = boosting.medians(boosting._Group(1), values, which, 9)
    for k in range(9):
        mine = np.sort(values[which == k])
        assert got[k] == (mine[(len(mine) - 1) // 2] if len(mine) else 0)


def test_errors_fall_and_missing_values_have_a_side(rows, model):
    error = {}
    for n in (0, 4, 12):
        part = boosting.BoostedTrees(model.features, model.edges, model.base, model.trees[:n])
        scored = rows.withColumn("p", boosting.scores(part, [F.col(c) for c in FEATURES]))
        error[n] = scored.agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]
    assert error[12] < error[4] < error[0]
    absent = rows.where(F.isnan("a")).withColumn("p", boosting.scores(model, [F.col(c) for c in FEATURES])).agg(F.avg("p")).first()[0]
    there = rows.where(~F.isnan("a")).withColumn("p", boosting.scores(model, [F.col(c) for c in FEATURES])).agg(F.avg("p")).first()[0]
    assert absent > there + 5


def test_scores_walk_down_the_trees(rows, model):
    scored = rows.withColumn("p", boosting.scores(model, [F.col(c) for c in FEATURES])).collect()
    for r in scored[:80]:
        codes = model.codes(np.array([[r.a], [r.b], [r.c]]))[:, 0]
        assert r.p == pytest.approx(model.base + sum(t.values[leaf(t, codes)] for t in model.trees))
    nulls = rows.limit(5).withColumn("a", F.lit(None).cast("double"))
    nans = nulls.withColumn("a", F.lit(math.nan))
    p = [f.withColumn("p", boosting.scores(model, [F.col(c) for c in FEATURES])).orderBy("i").collect() for f in (nulls, nans)]
    assert [r.p for r in p[0]] == [r.p for r in p[1]]


def test_responses_equal_full_predictions(rows, model):
    at = [F.lit(v) for v in (-9.0, -0.3, 0.0, 0.35, 9.0)] + [F.col("a"), F.lit(None).cast("double")]
    df = rows.withColumn("r", boosting.responses(model, [F.col(c) for c in FEATURES], "a", at))
    for k, value in enumerate(at):
        df = df.withColumn(f"full{k}", boosting.scores(model, [value, F.col("b"), F.col("c")]))
    for r in df.collect():
        assert list(r.r) == pytest.approx([r[f"full{k}"] for k in range(len(at))])


def test_price_steps_and_the_best_price(spark, rows, model):
    stats = spark.createDataFrame([("a", "standard", 20.0, 4.0)], "column string, kind string, center double, scale double")
    priced = rows.withColumns({"price": F.col("i") % 17 + 12.0, "unit_cost": F.lit(11.5)})
    df = demand.price_steps(priced, model, stats, F.col("price") * 0.8, F.col("price") * 1.2, price="a")
    df = pricing.best_price_on_steps(df)
    grid = [0.8 + 0.4 * k / 400 for k in range(1, 400)]
    center, scale = F.lit(20.0), F.lit(4.0)
    df = df.withColumn("dense", boosting.responses(model, [F.col(c) for c in FEATURES], "a",
                                                   [standardise(F.col("price") * g, center, scale) for g in grid]))
    for r in df.collect():
        ends = [s.upper for s in r.price_steps]
        assert ends == sorted(ends) and ends[-1] == r.price * 1.2
        for g, dense in zip(grid, r.dense):
            step = next(s for s in r.price_steps if r.price * g <= s.upper * (1 + 1e-12))
            near = any(abs(r.price * g - e) < 1e-9 for e in ends)
            assert near or step.units == pytest.approx(dense)
        gains = [(s.upper - 11.5) * round(max(s.units, 0.0)) for s in r.price_steps]
        assert r.best_profit == pytest.approx(max(gains))
        assert r.best_profit >= max((r.price * g - 11.5) * round(max(d, 0.0)) for g, d in zip(grid, r.dense)) - 1e-9
    out = demand.price_steps(priced.limit(2), model, stats, F.lit(None).cast("double"), F.lit(3.0), price="a")
    assert [r.best_price for r in pricing.best_price_on_steps(out).collect()] == [None, None]


def test_stored_model(spark, rows, model, tmp_path):
    boosting.save(spark, model, str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"))
    assert same(model, again) and again.features == FEATURES
    assert all((x == y).all() for x, y in zip(again.edges, model.edges))


def test_constant_target_and_constant_features(spark):
    flat = spark.createDataFrame([(i, 1.0, 7.0) for i in range(60)], "i long, a double, y double")
    model = boosting.fit(flat, ["a"], "y", F.col("i"), boosting.Options(rounds=3))
    assert model.base == 7 and all(len(t.values) == 1 for t in model.trees)
    assert {r.p for r in flat.withColumn("p", boosting.scores(model, [F.col("a")])).collect()} == {7.0}
    absent = spark.createDataFrame([(i, None, float(i)) for i in range(60)], "i long, a double, y double")
    assert boosting.fit(absent, ["a"], "y", F.col("i"), boosting.Options(rounds=2)).base == 29


def test_tasks_with_a_shared_folder_do_not_wait_for_the_barrier(rows, model):
    """Twelve trees in three tasks: by the barrier alone, a second an exchange, they took two minutes."""
    begin = time.monotonic()
    assert same(model, boosting.fit(rows, FEATURES, "y", F.col("i"), OPTIONS, rows_a_task=150))
    assert time.monotonic() - begin < 45


def test_a_file_half_written_is_not_read(tmp_path):
    """The turn is new, but its size, checksum and counts are still those of the turn before last."""
    group = boosting._Group(1)
    group.size, group.context, group.name, group.place = 2, "two tasks", str(tmp_path / "x"), 0
    path, body = tmp_path / "x-1-1", b"<i1" + bytes([1, 2])
    old = boosting._HEAD.pack(1, len(body), zlib.crc32(body, 1)) + body
    path.write_bytes(boosting._HEAD.pack(3, 0, 0)[:8] + old[8:])
    group.turn = 3
    new = b"<i1" + bytes([5, 6])
    timer = threading.Timer(0.3, lambda: path.write_bytes(boosting._HEAD.pack(3, len(new), zlib.crc32(new, 3)) + new))
    timer.start()
    assert group._told(str(path)).tolist() == [5, 6]


def test_counts_kept_over_turned_signs_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(2)
    codes = np.stack([rng.integers(0, n, 3000) for n in (62, 62, 7, 2, 31)]).astype(np.uint8)
    codes[0][rng.uniform(size=3000) < 0.1] = boosting.MISSING
    trainer = boosting.Trainer(boosting._Group(1), codes, rng.normal(size=3000), np.arange(3000, dtype=np.uint32), OPTIONS)
    for few in (1, 1 << 13):  # in sets of features, and row by row
        monkeypatch.setattr(boosting, "FEW", few)
        trainer._sign(residual := rng.normal(size=3000).round())
        for found, rows in ((trainer.everything, np.arange(3000)), (trainer._histogram(np.arange(0, 3000, 7)), np.arange(0, 3000, 7))):
            for f in range(5):
                assert found[0, f].tolist() == np.bincount(codes[f][rows], minlength=64).tolist()
                assert found[1, f].tolist() == np.bincount(codes[f][rows], -np.sign(residual[rows]), 64).tolist()


def test_prices_are_answered_over_the_bins_that_are_asked(model, monkeypatch):
    """Step functions over all bins, for every row, took most of the time of a price query."""
    codes = model.codes(np.array([r[1:4] for r in sample(60)]).T)
    whole = model.response(codes, 0)
    assert np.allclose(whole[:, 20:31], model.response(codes, 0, 20, 30))
    assert np.allclose(whole[:, 40], model.score(np.concatenate([np.full((1, 60), 40, np.uint8), codes[1:]])))
