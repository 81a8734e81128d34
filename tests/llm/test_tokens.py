import base64
import itertools
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from pricetide.llm import bpe, packing, token_files
from pricetide.llm.common import map_arrow

CODEC = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    with open(CODEC[0], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encoding_equals_the_library_and_round_trips(docs, awkward, library):
    for frame in (docs, awkward):
        texts = Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())
        expected = Counter()
        for (i, t), n in texts.items():
            expected[i, tuple(library.encode_ordinary(t or "")), (t or "").encode()] += n
        for made in bpe.decode(bpe.encode(frame, *CODEC), *CODEC), bpe.round_trip(frame, *CODEC):
            assert set(made.columns) == (set(frame.columns) - {"text"}) | {"ids", "decoded"}
            assert Counter((r.doc_id, tuple(ids_of(r.ids)), bytes(r.decoded)) for r in made.collect()) == expected


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (200, 50)])
def test_stitched_chunks_equal_the_whole(spark, library, chunk, overlap):
    rng = random.Random(1)
    letters = "  \n\t\r\x85\xa0\x1c 'sStreveLld0١²½aéßΣİ_-,.!€漢字 Ⅷ"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([5, 90, 400, 900])))) for i in range(80)]
    texts += [(900, "x" * 700), (901, " " * 500 + "a"), (902, "don't we'll " * 90)]
    made = bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), *CODEC, chunk=chunk, overlap=overlap)
    found = {r.doc_id: ids_of(r.ids) for r in made.collect()}
    assert found == {i: library.encode_ordinary(t) for i, t in texts}


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (200, 50)])
def test_runs_longer_than_an_overlap_keep_their_end(spark, library, chunk, overlap):
    lengths = [chunk * m + r for m in (2, 3) for r in (0, 1, overlap // 2, overlap - 1, overlap, overlap + 1)]
    texts = [(i, ("a" * n + " end.")[-n:]) for i, n in enumerate(lengths)]
    texts += [(100 + i, "漢" * n) for i, n in enumerate(lengths)] + [(200 + i, " " * n) for i, n in enumerate(lengths)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    made = bpe.round_trip(frame, *CODEC, chunk=chunk, overlap=overlap).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in made} == dict(texts)
    assert {r.doc_id: ids_of(r.ids) for r in made} == {i: library.encode_ordinary(t) for i, t in texts}


def test_encoding_keeps_columns_and_takes_empty_tables(awkward, empty):
    made = bpe.encode(awkward, *CODEC)
    assert set(made.columns) == (set(awkward.columns) - {"text"}) | {"ids"}
    assert bpe.encode(empty, *CODEC).count() == 0


@pytest.mark.parametrize("block", [3, 64, 1 << 18])
def test_counts_in_flat_files(spark, docs, awkward, block):
    for frame in (docs.limit(60), awkward):
        encoded = bpe.encode(frame.select("doc_id", "text"), *CODEC)
        lengths = Counter((r.doc_id, len(r.ids) // 4) for r in encoded.collect())
        if sum(n for (_, n) in lengths) > 100_000 and block == 3:
            continue
        files = token_files.write_blocks(encoded, 50256, block_tokens=block).persist()
        counts = token_files.named(token_files.count_tokens(files, 50256), files)
        assert Counter((r.doc_id, r.n_tokens) for r in counts.collect()) == lengths
        write = (lambda branch: token_files.block_writer(50256, block, branch, 2), token_files.block_schema("bigint"))
        files = bpe.encode(frame.select("doc_id", "text"), *CODEC, then=write).persist()
        counts = token_files.named(token_files.count_tokens(files, 50256), files)
        assert Counter((r.doc_id, r.n_tokens) for r in counts.collect()) == lengths


def test_real_files_open_ends_and_two_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 2)
    rng, expected = random.Random(2), set()
    for name in ("a", "b", "c"):
        tokens, ordinal, start = [], 0, 0
        for _ in range(rng.randrange(5, 30)):
            n = rng.choice([0, 1, 5, 40])
            expected.add((name, ordinal, start, n, True))
            tokens += [rng.randrange(9) for _ in range(n)] + [9]
            ordinal, start = ordinal + 1, len(tokens)
        if name == "b":
            tokens += [1, 2, 3]
            expected.add((name, ordinal, start, 3, False))
        (tmp_path / f"{name}.bin").write_bytes(np.array(tokens, "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_files.read_blocks(spark, f"{tmp_path}/*.bin", width=2, block_tokens=4)
    found = token_files.count_tokens(blocks, 9, width=2).collect()
    assert {(r.file.rsplit("/")[-1][:-4], r.ordinal, r.start, r.n_tokens, r.closed) for r in found} == expected


def test_counts_from_flat_files_on_disk(spark, docs, awkward, tmp_path):
    for k, frame in enumerate((docs.limit(60), awkward)):
        lengths = Counter((r.doc_id, len(r.ids) // 4) for r in bpe.encode(frame.select("doc_id", "text"), *CODEC).collect())
        folder = tmp_path / str(k)
        folder.mkdir()
        write = (lambda branch: token_files.file_writer(f"file:{folder}", 50256, 2, 64, branch, 2),  # noqa: B023
                 token_files.manifest_schema("bigint"))
        for which in "long", "short":
            bpe.encode(frame.select("doc_id", "text"), *CODEC, then=write, which=(which,)).write.mode("append").parquet(
                f"{tmp_path}/manifest{k}")
        manifest = spark.read.parquet(f"{tmp_path}/manifest{k}")
        files = token_files.listed(spark, f"{folder}/*.bin")
        assert files.agg({"length": "sum"}).first()[0] == 2 * sum((n + 1) * c for (_, n), c in lengths.items())
        sizes = manifest.groupBy("file").agg({"size": "sum"}).toDF("file", "length")
        counts = token_files.named(token_files.count_files(sizes, 50256, 2, 64), manifest)
        assert Counter((r.doc_id, r.n_tokens) for r in counts.collect()) == lengths


def test_a_file_beyond_the_size_of_a_cell_is_counted(spark, tmp_path):
    places = [5, (1 << 30) - 1, (1 << 30) + 100]
    with open(tmp_path / "large.bin", "wb") as out:  # Over 2 GB, nearly all of it a hole.
        out.truncate(2 * (1 << 30) + 1000)
        for at in places:
            out.seek(2 * at)
            out.write(np.array([9], "<u2").tobytes())
    files = token_files.listed(spark, f"{tmp_path}/*.bin")
    found = token_files.count_files(files, 9, 2, 1 << 24).orderBy("ordinal").collect()
    starts = [0, *[at + 1 for at in places]]
    assert [(r.start, r.n_tokens, r.closed) for r in found] == [
        (a, b - a, b in places) for a, b in zip(starts, [*places, (1 << 30) + 500])]


def check_packing(counts, capacity, patterns):
    used = Counter()
    for times, lengths in patterns:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    return sum(n for n, _ in patterns)


@pytest.mark.parametrize("seed", range(8))
def test_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(2, 12) for _ in range(9)]

    def least(left, rooms):
        if not left:
            return len(rooms)
        best = 99
        for k in sorted({*rooms}):
            if k >= left[0]:
                rest = list(rooms)
                rest.remove(k)
                best = min(best, least(left[1:], [*rest, k - left[0]]))
        return min(best, least(left[1:], [*rooms, 12 - left[0]])) if len(rooms) < 9 else best

    counts = Counter(sizes)
    assert check_packing(counts, 12, packing.complete(counts, 12)) == least(sorted(sizes, reverse=True), [])


def test_completion_beats_best_fit():
    rng = random.Random(1)
    [rng.randint(1, 10) for _ in range(30)]
    counts = Counter(rng.randint(20, 70) for _ in range(200))
    start = np.zeros(101, np.int64)
    for x, n in counts.items():
        start[x] = n
    bound = -(-sum(x * n for x, n in counts.items()) // 100)
    made = check_packing(counts, 100, packing.complete(counts, 100))
    assert bound <= made <= check_packing(counts, 100, packing._best_fit(start, 100))
    assert packing.complete({}) == []


def test_every_maximal_filling_is_enumerated():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.randint(8, 30)
        counts = Counter(rng.randint(1, 9) for _ in range(rng.randint(1, 9)))
        left = packing._Left(np.array([counts.get(x, 0) for x in range(capacity + 1)]))
        have, want = sorted(counts.elements()), set()
        for n in range(len(have) + 1):
            for some in itertools.combinations(have, n):
                rest = Counter(have) - Counter(some)
                if sum(some) <= capacity and not any(sum(some) + x <= capacity for x in rest):
                    want.add(tuple(sorted(some, reverse=True)))
        assert {f for f in packing._all(left, capacity, {}) if f is not None} == want


def test_lower_bound_and_what_best_fit_misses():
    counts = np.zeros(101, np.int64)
    counts[[60, 55, 34]] = [5, 5, 3]  # no two of the large ones share a sequence, a 34 fits beside one
    assert packing.lower_bound(counts, 100) == 10
    counts[[60, 55, 34, 46]] = [0, 5, 0, 5]  # 55 + 46 is too much: 55 alone, 46 in pairs
    assert packing.lower_bound(counts, 100) == 8
    rng, better, at_bound = random.Random(8), 0, 0
    for _ in range(30):
        sizes = Counter(rng.randint(15, 60) for _ in range(40))
        start = np.array([sizes.get(x, 0) for x in range(101)])
        made, fit = check_packing(sizes, 100, packing.complete(sizes, 100)), sum(n for n, _ in packing._best_fit(start, 100))
        assert packing.lower_bound(start, 100) <= made <= fit
        better, at_bound = better + (made < fit), at_bound + (made == packing.lower_bound(start, 100))
    assert better >= 3 and at_bound >= 20


def test_memory_of_the_search_does_not_grow_with_its_patterns():
    rng, peaks = random.Random(2), []
    for n in (2_000, 40_000):
        counts = Counter(min(4095, int(rng.lognormvariate(6, 1.1)) + 1) for _ in range(n))
        tracemalloc.start()
        patterns = packing.complete(counts)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        check_packing(counts, 4096, patterns)
    assert peaks[1] < 20e6


def test_long_texts_are_cut_at_spaces_only(monkeypatch):
    library, rng = Tokenizer.from_file(WORDS), random.Random(6)
    library.encode_special_tokens = True
    monkeypatch.setattr(packing, "SPAN", 64)
    encoder = packing.WordEncoder(WORDS)
    for _ in range(20):
        text = "".join(rng.choice("ab1 'sé_,\n ") for _ in range(700)) + "x" * 200
        assert ids_of(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids
    strange = "word " * 50 + "漢字 ok"
    assert ids_of(encoder.encode(strange)) == library.encode(strange, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "REMEMBERED", 10)  # the table starts anew again and again
    text = " ".join(f"{a}{b}" for a in "abcdefg" for b in "hijklmn")
    for _ in range(3):
        assert ids_of(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_packed_documents(docs, awkward, empty):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    for frame in (docs, awkward):
        found = packing.pack(frame, WORDS).collect()
        expected = Counter()
        for i, t in [tuple(r) for r in frame.select("doc_id", "text").collect()]:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            for k, at in enumerate(range(0, len(ids), 4096)):
                part = ids[at:at + 4096]
                expected[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
        for s in {r.sequence_id for r in found}:
            at = 0
            for r in sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096
    assert packing.pack(empty, WORDS).count() == 0


def test_word_ids_equal_the_library():
    library, own, rng = Tokenizer.from_file(WORDS), packing.WordEncoder.of(WORDS), random.Random(5)
    library.encode_special_tokens = True
    letters = "  \n\t\x85\xa0 '’sStreveLlDd0١²½aéßΣİ_-,.!€漢か́​ⅧÅ<|endoftext|>"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 60])))
        assert ids_of(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, text


def test_words_go_to_the_tokenizer_in_bounded_numbers(monkeypatch):
    encoder = packing.WordEncoder(WORDS)
    asked, library = [], encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, words, **options):
            asked.append(len(words))
            return library.encode_batch_fast(words, **options)

    encoder.tokenizer = Counting()
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9000))
    ids = np.frombuffer(encoder.encode(text), np.uint32).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert sum(asked) == 9000 and max(asked) <= packing.ASKED


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    long = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) text")
    found = [r.n for r in map_arrow(long, sizes, "n long").collect()]
    assert sum(found) >= 40_000_000 and max(found) <= 10_000_000
