"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text up to `CHUNK` characters is pre-tokenised and encoded where it lies. A longer one is cut into chunks that
overlap by `OVERLAP` characters and are dealt over the tasks:

1. Every chunk is pre-tokenised on its own. A chunk's last few matches may be wrong (the text goes on), and so may
   its first (it starts inside a match).
2. Two neighbours are stitched at the first place in their overlap where both have a boundary: the pattern looks
   only forward, so from there on both find the same matches. The seams are a window over the short lists of
   boundaries in the overlaps, ordered by chunk.
3. Each chunk encodes its piece between two seams, and a document's ids are joined in chunk order.

A document whose chunks nowhere resynchronise (one match longer than an overlap) is encoded in one piece instead.
Pieces are merged by the ranks with the tokenizer library's merge routine, each distinct piece once per worker.
Ids travel as packed little-endian unsigned 32-bit integers; decoding concatenates the ids' raw bytes.

Edge cases: a null text counts as empty and has no ids. Repeated rows and null ids are rows like others. An id
without a rank fails the decoding. Extra columns are kept; those named like a result column are replaced by it.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import free_name, map_arrow, materialize

CHUNK = 32_768
OVERLAP = 1_024
#: No match that ends this close to a chunk's end is trusted: contractions look two characters ahead.
MARGIN = 3
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 100_000
#: Texts that are encoded at a time.
ROWS = 512

#: Characters on which the standard library's classes equal the pattern's Unicode classes; texts with others
#: take the slower module.
_OTHERS = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
#: The white space of the Unicode property, as the tokenizer library has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class _Pieces(dict):
    """Packed ids of a piece, worked out on first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[piece] = array("I", self.merge(piece.encode())).tobytes()
        return made


class Codec:
    """Pattern, merges and byte strings of one rank file."""

    known: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = _Pieces(ranks, pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(
            r"\p{N}", r"\d")
        exact = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(
            r"\s", f"[{_SPACE}]")
        self.plain, self.exact = re.compile(plain), regex.compile(exact)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls.known:
            cls.known[path, pattern] = cls(path, pattern)
        return cls.known[path, pattern]

    def split(self, text: str, start: int = 0) -> list[str]:
        return (self.exact if _OTHERS.search(text) else self.plain).findall(text, start)

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _encode_whole(path: str, pattern: str, then: Callable | None = None):
    """Ids of the texts in the last column; ``then`` goes on with the batches in the same worker."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                ids = [codec.encode(codec.split(t or "")) for t in some.column(some.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(ids, pa.binary())],
                                                 names=[*some.schema.names[:-1], "ids"])

    return encode if then is None else lambda batches: then(encode(batches))


def _pretokenise(path: str, pattern: str, chunk: int, overlap: int):
    """The boundaries in the overlaps: ``head`` with the chunk before, ``tail`` (trusted) with the one after."""

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            heads, tails = [], []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("part").to_pylist()):
                ends = np.cumsum([0, *map(len, codec.split(text))])
                trusted = ends[ends <= len(text) - MARGIN]
                heads.append((ends[(ends > 0) & (ends < overlap)] + k * chunk).tolist())
                tails.append((trusted[trusted > chunk] + k * chunk).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("k"), batch.column("n"), pa.array(heads, pa.list_(pa.int64())),
                 pa.array(tails, pa.list_(pa.int64()))], names=["row", "k", "n", "head", "tail"])

    return pretokenise


def _encode_pieces(path: str, pattern: str, chunk: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            made = []
            for k, text, start, stop in zip(*(batch.column(c).to_pylist() for c in ("k", "part", "start", "stop"))):
                pieces = codec.split(text, start - k * chunk)
                if stop is not None:
                    ends = np.cumsum(list(map(len, pieces)))
                    pieces = pieces[:int(np.searchsorted(ends, stop - start)) + 1]
                made.append(codec.encode(pieces))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(made, pa.binary())],
                                             names=["row", "k", "ids"])

    return encode


def _join_ids(group):
    group = group.sort_values("k")
    return group.iloc[:1].assign(ids=b"".join(group["ids"]))[["row", "ids"]]


def _join_text(group):
    return group.iloc[:1].assign(text="".join(group.sort_values("k")["part"]))[["row", "text"]]


def encode_long(parts: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, ids) of texts given as overlapping chunks: row, k, n, part. ``parts`` is read more than once."""
    pre = map_arrow(parts, _pretokenise(path, pattern, chunk, overlap),
                    "row long, k int, n int, head array<long>, tail array<long>")
    in_order = Window.partitionBy("row").orderBy("k")
    seams = pre.withColumn("stop", F.array_min(
        F.array_intersect("tail", F.lead("head").over(in_order)))).withColumn(
        "start", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.lag("stop").over(in_order)))
    seams = materialize(seams.select("row", "k", "n", "start", "stop"))
    lost = seams.filter("k < n - 1 and stop is null").select("row").distinct()
    pieces = parts.select("row", "k", "part").join(
        seams.join(lost, "row", "left_anti").select("row", "k", "start", "stop"), ["row", "k"])
    stitched = map_arrow(pieces, _encode_pieces(path, pattern, chunk), "row long, k int, ids binary").groupBy(
        "row").applyInPandas(_join_ids, "row long, ids binary")
    # A text's last chunk has no successor that repeats its end, so it goes in whole.
    own = F.when(F.col("k") < F.col("n") - 1, F.substring("part", 1, chunk)).otherwise(F.col("part"))
    whole = parts.join(lost, "row", "left_semi").select("row", "k", own.alias("part"))
    whole = whole.groupBy("row").applyInPandas(_join_text, "row long, text string")
    return stitched.unionByName(map_arrow(whole, _encode_whole(path, pattern), "row long, ids binary"))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK,
           overlap: int = OVERLAP, then: tuple[Callable, object] | None = None,
           which: tuple[str, ...] = ("short", "long")) -> DataFrame:
    """The columns of ``docs`` without the text, and ``ids``: packed ids of the whole text by the rank file ``path``.

    ``then`` is (function, schema): what should be done with the encoded batches in the worker that made them, so
    that a task needs one Python process. The function is called with 0 for the short and 1 for the long texts, and
    gives a `mapInArrow` function; its rows of ``schema`` are the result. ``which`` texts: those encoded where they lie
    (short), those cut into chunks (long), or both; two calls with one each do the same as one call.
    """
    kept = [c for c in docs.columns if c not in (text_col, "ids")]
    text = free_name(docs, "text_read")
    wide = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    short = wide.filter(F.length(text) <= chunk + overlap)
    function, schema = then or (lambda _: None, short.drop(text).schema.add("ids", "binary"))
    at_once = map_arrow(short, _encode_whole(path, pattern, function(0)), schema)
    if "long" not in which:
        return at_once
    long = wide.filter(F.length(text) > chunk + overlap).select(
        F.struct(*kept).alias("kept"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    count = F.ceil((F.length("text") - overlap) / F.lit(chunk)).cast("int")
    cut = long.select("kept", "row", "text", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    # Dealt over the tasks before they are written: the chunks of one text lie in one task until then.
    parts = materialize(cut.select(
        F.when(F.col("k") == 0, F.col("kept")).alias("kept"), "row", "n", "k",
        F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("part")).repartition("row", "k"))
    made = encode_long(parts.select("row", "k", "n", "part"), path, pattern, chunk, overlap)
    made = parts.filter("k = 0").select("kept", "row").join(made, "row").select("kept.*", "ids")
    if then is not None:
        made = map_arrow(materialize(made), function(1), schema)
    return at_once.unionByName(made) if "short" in which else made


def _decoder(path: str, pattern: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            raw = [None if x is None else codec.decode(x) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())],
                                             names=[*batch.schema.names, out])

    return run


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``, the raw bytes of its packed ids."""
    kept = [c for c in encoded.columns if c not in (ids_col, out)]
    schema = encoded.select(*kept).schema.add(ids_col, "binary").add(out, "binary")
    return map_arrow(encoded.select(*kept, ids_col), _decoder(path, pattern, out), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "decoded", **sizes) -> DataFrame:
    """`encode` and `decode` in one pass: the columns of ``docs`` without the text, ``ids`` and ``out``."""
    docs = docs.drop(*{"ids", out} - {text_col})
    schema = docs.drop(text_col).schema.add("ids", "binary").add(out, "binary")
    return encode(docs, path, pattern, text_col, then=(lambda _: _decoder(path, pattern, out), schema), **sizes)
