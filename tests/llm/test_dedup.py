import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricetide.llm import exact_dedup, sharding, shingle_join
from pricetide.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


def test_exact_duplicates_match_brute_force(docs):
    texts = rows_of(docs)
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    for r in exact_dedup.exact_duplicates(docs).collect():
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))


def test_heavy_digests_are_settled_like_the_rest(spark):
    frame = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(300)], "doc_id long, text string")
    a = {tuple(r) for r in exact_dedup.exact_duplicates(frame, counters=5).collect()}
    b = {tuple(r) for r in exact_dedup.exact_duplicates(frame, counters=100_000).collect()}
    assert a == b and len(a) == 300 and sum(r[3] for r in a) == len({t for _, t in rows_of(frame)})


def test_misra_gries_keeps_what_is_frequent():
    import pyarrow as pa

    values = [b"a"] * 40 + [bytes([i]) for i in range(60)]
    out = list(exact_dedup._misra_gries(4)(iter([pa.RecordBatch.from_pydict({"digest": pa.array(values, pa.binary())})])))[0]
    low = dict(zip(out["digest"].to_pylist(), out["low"].to_pylist()))
    assert 40 - 100 / 5 <= low[b"a"] <= 40 and out["seen"].to_pylist()[-1] == 100 and len(low) <= 5


def test_exact_edge_cases(awkward, empty):
    found = exact_dedup.exact_duplicates(awkward).collect()
    assert len(found) == 11 and exact_dedup.exact_duplicates(empty).count() == 0
    same = [r for r in found if r.group_size == 4]
    assert len(same) == 4 and all(r.keep_id == 2 for r in same) and sum(r.kept for r in same) == 1
    blank = [r for r in found if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id for r in blank} == {3, 4, None} and {r.keep_id for r in blank} == {4}
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in found)


def test_repeated_rows_leave_one(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sum(r.kept for r in exact_dedup.exact_duplicates(frame).collect()) == 2
    assert exact_dedup.drop_exact_duplicates(frame).count() == 2


def check_shards(found, n, shards):
    counts = Counter(r.shard for r in found)
    assert len(found) == n and set(counts) <= set(range(shards))
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))


def test_shards_are_even_and_keep_groups_together(docs):
    found = sharding.shard_documents(docs, shards=6).collect()
    check_shards(found, docs.count(), 6)
    assert all(len({r.shard for r in found if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in found if r.group_size > 1})


def test_a_group_larger_than_a_shard_is_split_evenly(spark):
    frame = spark.createDataFrame([(i, "hot" if i < 100 else f"t{i // 2}") for i in range(240)], "doc_id long, text string")
    found = sharding.shard_documents(frame, shards=8).collect()
    check_shards(found, 240, 8)
    cut = Counter(len({r.shard for r in found if r.text_crc32 == c}) for c in {r.text_crc32 for r in found if r.group_size == 2})
    assert cut[1] >= 0.8 * sum(cut.values())


def test_shard_edge_cases(awkward, empty):
    found = sharding.shard_documents(awkward).collect()
    check_shards(found, 11, 24)
    assert {r["size"] for r in found if r.text_crc32 == 0} == {8} and sharding.shard_documents(empty).count() == 0


def brute_components(texts):
    sets = []
    for _, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    names = {r: min((texts[i][0] for i in range(len(texts)) if root[i] == r and texts[i][0] is not None), default=None) for r in root}
    return Counter((t[0], len(s), names[r]) for t, s, r in zip(texts, sets, root))


def test_near_duplicates_match_brute_force(docs):
    assert Counter(map(tuple, shingle_join.near_duplicates(docs).collect())) == brute_components(rows_of(docs))


@pytest.mark.parametrize("light", [2, 8])
def test_a_large_near_group_and_small_sets(spark, monkeypatch, light):
    monkeypatch.setattr(shingle_join, "LIGHT", light)
    monkeypatch.setattr(shingle_join, "BLOCK", 7)
    rng, base = np.random.default_rng(3), [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        own = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            own[k] = f"x{rng.integers(1000)}"
        texts.append((i, " ".join(own)))
    texts += [(100 + i, " ".join(base[:rng.integers(1, 12)])) for i in range(40)]
    texts += [(200 + i, " ".join(f"p{k}" for k in range(20)) + " " + " ".join(f"q{i}{k}" for k in range(rng.integers(2, 30)))) for i in range(30)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(map(tuple, shingle_join.near_duplicates(frame).collect())) == brute_components(texts)


def test_near_edge_cases(awkward, empty):
    texts = rows_of(awkward)
    found = shingle_join.near_duplicates(awkward)
    expected = brute_components([t for t in texts if (t[1] or "").strip()])
    assert Counter(tuple(r) for r in found.collect() if r.n_shingles) == expected
    assert all(r.component_id == r.doc_id for r in found.collect() if not r.n_shingles)
    assert shingle_join.near_duplicates(empty).count() == 0
    kept = shingle_join.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, None])


def test_the_class_number_is_that_of_the_tasks(spark):
    from pyspark.sql import functions as F

    for raw in (bytes(range(16)), bytes([255] * 16), bytes([0, 0, 0, 0, 0, 0, 0, 200, *range(8)])):
        frame = spark.createDataFrame([(bytearray(raw),)], "digest binary")
        assert frame.select(shingle_join._class_of(F.col("digest"))).first()[0] == int.from_bytes(raw[:8], "little", signed=True)


def test_sifting_loses_no_id(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SIFT", 1 << 16)
    texts = spark.createDataFrame([(i, f"t{i}") for i in [*range(3000), None]], "id long, text string")
    left = spark.createDataFrame([(i,) for i in [*range(0, 3000, 7), None]], "first_id long")
    found = {r.id for r in shingle_join._sifted(texts, left).collect()}
    assert found >= {*range(0, 3000, 7), None} and len(found) < 600
    assert shingle_join._sifted(texts, left.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 30)] + [(50, 50)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {found[i] for i in range(100, 141)} == {100} and {found[i] for i in range(5, 30)} == {5}
