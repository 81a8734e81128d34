"""Near duplicates by Jaccard similarity of word shingles: a size-aware heavy-light join.

A document's set is its distinct 5-word shingles, hashed to 64 bits. Documents with equal sets form a class; one
representative of each class takes part in the join. Two classes link when they share 75 % of their union.

Filter. In any fixed order of the shingles, two linked sets share at least k shingles among their first
n - ceil(0.75 n) + k. Tasks send the first shingles (k = n / 8) of their sets, in hash order and packed, to a few
hash ranges; each range finds the shingles that two classes have. A class with too few of those has no partner and
is done, which leaves a small part of most corpora. Shingles that several classes of one task have are settled
there, so a passage in every document sends one entry per task.

Join of what is left. Shingles are ordered by the number of classes that have them, the rarest first.
* Small sets (up to a boundary) are matched by enumerating the 2-subsets of their first n - ceil(0.75 n) + 2
  shingles: linked small sets have one in common.
* Large sets are matched by the inverted lists of their first n - ceil(0.75 n) + 1 shingles, in which small sets
  near the boundary are entered too.
The boundary is where the subsets would cost more than scanning the lists, by sums over the sizes.

Groups. Only components are asked for, so no list of classes is expanded into all its pairs. First every class
meets the centres of some of its lists, and what links becomes a component. After that only pairs across components
matter: lists of up to `LIGHT` classes give those as rows; longer ones are united to clusters, whose classes are
cut into blocks of `BLOCK` and compared block by block in the tasks, leaving out blocks of one component. Every
comparison that could add a link between components is made, and each is exact on the whole sets.

Edge cases: a text with fewer than five words has its whole sequence as one shingle; one without words has no set
and is its own component, as is a row without an id and partners. Repeated rows are one class. Ids are compared as
they are; the component is named by its smallest id, nulls aside. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import free_name, map_arrow, materialize, numbered, ship
from pricetide.llm.components import components
from pricetide.llm.textbuf import Words, mixed, shingles, slices
from pricetide.session import release

WORDS = 5
PERCENT = 75
#: Classes in a list up to which pairs across components become rows.
LIGHT = 8
#: Classes in a block of a cluster.
BLOCK = 256
#: Lists whose centres a class meets at first.
MEETINGS = 4
#: Shingles in a hash range of the filter.
RANGE = 1_500_000
#: Bits of the bitmap that sifts ids: 4 MB, whatever the input.
SIFT = 1 << 25
#: Entries that a task collects before it sends them off.
FLUSH = 1_000_000

_U = np.uint64


def _sets(column, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text."""
    for first, body, at in slices(column):
        found, made = shingles(Words(body, at), words)
        ends = np.cumsum(made)
        for i, (stop, n) in enumerate(zip(ends.tolist(), made.tolist())):
            yield first + i, np.unique(found[stop - n:stop])


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _least(n):
    """Shingles that a set of ``n`` shares at least with a linked one (also for columns)."""
    return -(-n * PERCENT // 100)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for i, tokens in _sets(batch.column(1), words):
                n[i] = len(tokens)
                digest[i] = _digest(tokens) if len(tokens) else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(digest, pa.binary())],
                names=["id", "mark", "n", "digest"])

    return run


def _packed(ranges: int, words: int):
    """First shingles by hash range: (range, keys, classes); under range -1 (counts, classes) settled here."""

    def flush(tokens: list[np.ndarray], classes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, own = np.concatenate(tokens), np.concatenate(classes)
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
        token, own = token[new], own[new]
        same = token[1:] == token[:-1]
        shared = np.zeros(len(token), bool)
        shared[1:] = same
        shared[:-1] |= same
        known, counts = np.unique(own[shared], return_counts=True)
        head = shared.copy()
        head[1:] &= ~same
        out = [(-1, counts.astype(np.uint32), known)] if len(known) else []
        token, own = np.concatenate([token[~shared], token[head]]), np.concatenate([own[~shared], np.zeros(int(head.sum()), _U)])
        spread = mixed(token + _U(0x5851F42D4C957F2D))
        part = ((spread >> _U(32)) % _U(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, key, own = part[order], (spread[order] & _U(0xFFFFFFFF)).astype(np.uint32), own[order]
        edges = np.searchsorted(part, np.arange(ranges + 1))
        out += [(r, key[a:b], own[a:b]) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([x[0] for x in out], pa.int32()), "keys": pa.array([x[1].tobytes() for x in out], pa.binary()),
            "classes": pa.array([x[2].tobytes() for x in out], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes, held = [], [], 0
        for batch in batches:
            for _, found in _sets(batch.column(0), words):
                n = len(found)
                if n < 2:
                    continue  # a set of one shingle links with no other set
                take = min(n, n - _least(n) + max(1, n // 8))
                tokens.append(found[:take])
                classes.append(np.full(take, np.frombuffer(_digest(found)[:8], _U)[0]))
                held += take
                if held >= FLUSH:
                    yield from flush(tokens, classes)
                    tokens, classes, held = [], [], 0
        if held:
            yield from flush(tokens, classes)

    return run


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """(class, n): how many of a range's shingles a class has in common with another; class 0 stands for several."""
    key = np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"]])
    own = np.concatenate([np.frombuffer(x, _U) for x in group["classes"]])
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.repeat(np.minimum.reduceat(own, change) != np.maximum.reduceat(own, change), np.diff([*change, len(key)]))
    several |= np.repeat(np.minimum.reduceat(own, change) == 0, np.diff([*change, len(key)]))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    known, n = np.unique(own[several & new & (own != 0)], return_counts=True)
    return pd.DataFrame({"class": known.view(np.int64), "n": n})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(known, np.int64)),
                                              pa.array(np.frombuffer(counts, np.uint32).astype(np.int64))], names=["class", "n"])


def _class_of(digest):
    """The first 8 bytes of the digest as the tasks' little-endian long."""
    turned = F.concat(*[F.substring(digest, i, 1) for i in range(8, 0, -1)])
    return F.conv(F.hex(turned), 16, -10).cast("long")


def _sifted(texts: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id may be in ``left``: most others are gone before the join deals them out.

    A bitmap of `SIFT` bits has a bit for the hash of each id, so what is broadcast has a fixed size.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(SIFT))
    sieve = left.select(bit("first_id").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    at = F.bitmap_bit_position(bit("id"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = texts.withColumn("bucket", F.bitmap_bucket_number(bit("id"))).join(F.broadcast(sieve), "bucket")
    return met.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select("id", "text")


def candidates(docs: DataFrame, classes: DataFrame, total: int, id_col: str, text_col: str, words: int) -> DataFrame:
    """(cid, digest, n, tokens) of the classes that may have a partner; ``total`` is the number of all shingles."""
    spark = docs.sparkSession
    ranges = max(16, -(-int(total * 0.4) // RANGE))
    sent = map_arrow(docs.select(F.col(text_col).cast("string")), _packed(ranges, words),
                     "part int, keys binary, classes binary")
    ship(spark)
    # Written once: both uses below read it, and neither computes the texts' sets again.
    sent = materialize(sent)
    counts = sent.filter("part >= 0").groupBy("part").applyInPandas(_shared, "class long, n long").unionByName(
        map_arrow(sent.filter("part < 0").select("keys", "classes"), _unpacked, "class long, n long"))
    counts = counts.groupBy("class").agg(F.sum("n").alias("shared"))
    least = F.greatest(F.lit(1), F.floor(_ceil_share(F.col("n")) / 8))
    # A job of its own: its shuffles and the packed shingles are gone before the texts are dealt.
    left = materialize(classes.withColumn("class", _class_of(F.col("digest"))).join(counts, "class").filter(
        (F.col("n") > 1) & (F.col("shared") >= least)).select("digest", "first_id"))
    release(spark, sent)
    texts = _sifted(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), left)
    read = texts.join(left, texts["id"].eqNullSafe(left["first_id"])).select("digest", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            found = [(d, t) for d, (_, t) in zip(wanted, _sets(batch.column(1), words)) if _digest(t) == d]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in found], pa.binary()), pa.array([len(t) for _, t in found], pa.int32()),
                 pa.array([t.tobytes() for _, t in found], pa.binary())], names=["digest", "n", "tokens"])

    made = map_arrow(read, shingled, "digest binary, n int, tokens binary").dropDuplicates(["digest"])
    return materialize(made.withColumn("cid", F.monotonically_increasing_id()))


def _ceil_share(n):
    return F.ceil(n * PERCENT / F.lit(100.0)).cast("int")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("n").to_numpy()
        step = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + 1, 500_000))
        for a, b in zip(step, [*step[1:], len(sizes)]):
            if b > a:
                tokens = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("tokens")[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("cid").to_numpy()[a:b], sizes[a:b])),
                     pa.array(np.repeat(sizes[a:b], sizes[a:b])), pa.array(tokens)], names=["cid", "n", "token"])


def prefixes(sets: DataFrame) -> DataFrame:
    """(cid, n, token, df, place): each set's first n - ceil(0.75 n) + 2 shingles, without those of one class only."""
    tokens = map_arrow(sets.select("cid", "n", "tokens"), _exploded, "cid long, n int, token long")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("cid")
    ranked = tokens.join(common, "token").withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own)).withColumn(
        "place", F.col("alone") + F.row_number().over(own.orderBy("df", "token")))
    return materialize(ranked.filter(F.col("place") <= F.col("n") - _ceil_share(F.col("n")) + 2).select(
        "cid", "n", "token", "df", F.col("place").cast("int").alias("place")))


def boundary(first: DataFrame) -> int:
    """The size up to which enumerating 2-subsets costs less than scanning the lists, over all sets up to it.

    A subset costs a row. Scanning a list costs a row for each of its classes, but no more than `LIGHT`: longer
    lists are compared in blocks, which takes no row for each pair.
    """
    one = F.col("place") <= F.col("n") - _ceil_share(F.col("n")) + 1
    by_set = first.groupBy("cid", "n").agg(F.count(F.lit(1)).alias("m"), F.sum(F.when(one, F.least("df", F.lit(LIGHT))).otherwise(0)).alias("scan"))
    step = F.floor(F.log2("n") * 8).cast("int")  # sizes within 9 % count as one: some 150 rows at most
    rows = sorted(by_set.groupBy(step.alias("step")).agg(
        F.max("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2), F.sum("scan")).collect())
    best, at, subsets, lists = 0.0, 1, 0.0, 0.0
    for _, n, subset, scan in rows:
        subsets, lists = subsets + subset, lists + scan
        if subsets - lists < best:
            best, at = subsets - lists, n
    return at


def keys(first: DataFrame, limit: int) -> DataFrame:
    """(key, cid, n, members): lists that two classes at least are in, for sets up to ``limit`` by 2-subsets."""
    one = F.col("place") <= F.col("n") - _ceil_share(F.col("n")) + 1
    near = F.col("n") * 100 >= PERCENT * F.lit(limit + 1)
    lists = first.filter(one & near).select("token", "cid", "n").withColumn("kind", F.lit(1))
    small = first.filter(F.col("n") <= limit).select("cid", "n", "token", "place")
    other = small.select("cid", F.col("token").alias("token2"), F.col("place").alias("place2"))
    # Within one set of at most ``limit`` shingles, not within a group of documents.
    pairs = small.join(other, "cid").filter("place < place2").select(
        F.xxhash64(F.least("token", "token2"), F.greatest("token", "token2")).alias("token"), "cid", "n").withColumn("kind", F.lit(2))
    listed = lists.unionByName(pairs).select(F.xxhash64("kind", "token").alias("key"), "cid", "n")
    members = listed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return materialize(listed.join(members, "key").select("key", "cid", "n", "members"))


def _near_sizes(a: str, b: str):
    return (F.col(a) * 100 >= PERCENT * F.col(b)) & (F.col(b) * 100 >= PERCENT * F.col(a))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of cids whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(np.frombuffer(x, _U), np.frombuffer(y, _U)) for x, y in
                    zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, name: sets.select(F.col("cid").alias(c), F.col("tokens").alias(name))
    return map_arrow(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y"), check,
                     "a long, b long")


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def meetings(listed: DataFrame, most: int = MEETINGS) -> DataFrame:
    """(a, b): every class with the centres of its ``most`` shortest lists; a list's centre is drawn by hash."""
    centres = listed.groupBy("key").agg(F.max(F.struct(F.xxhash64("cid", "key").alias("draw"), "cid", "n")).alias("c")).select(
        "key", F.col("c.cid").alias("centre"), F.col("c.n").alias("size"))
    met = listed.join(centres, "key").filter((F.col("cid") != F.col("centre")) & _near_sizes("n", "size"))
    turn = F.row_number().over(Window.partitionBy("cid").orderBy("members", "key"))
    return _pair(met.withColumn("turn", turn).filter(F.col("turn") <= most), "cid", "centre").distinct()


def _labelled(df: DataFrame, found: DataFrame) -> DataFrame:
    return df.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))


def _mixed_lists(listed: DataFrame) -> DataFrame:
    """Lists whose classes are of more than one component."""
    open_ = listed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return listed.join(open_.select("key"), "key", "left_semi")


def light_pairs(listed: DataFrame) -> DataFrame:
    """(a, b) across components of the lists of up to `LIGHT` classes."""
    light = listed.filter(F.col("members") <= LIGHT).select("key", "cid", "n", "component")
    other = light.select("key", F.col("cid").alias("cid2"), F.col("n").alias("n2"), F.col("component").alias("component2"))
    met = light.join(other, [light["key"] == other["key"], F.col("component") < F.col("component2"), _near_sizes("n", "n2")])
    return _pair(met, "cid", "cid2").distinct()


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links across components within a block or between two, thinned to those that join components."""
    sets = [np.frombuffer(x, _U) for x in group["tokens"]]
    n, side = np.array(list(map(len, sets))), (group["block"] == group["low"]).to_numpy()
    cid, part = group["cid"].to_numpy(), group["component"].to_numpy()
    token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, col, count = np.unique(token, return_inverse=True, return_counts=True)
    held = count[col] > 1
    row, col = row[held], np.unique(col[held], return_inverse=True)[1] if held.any() else col[held]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = int(col.max()) + 1 if len(col) else 0
    for start in range(0, width, 4096):  # the product of a slice of columns at a time
        here = (col >= start) & (col < start + 4096)
        m = np.zeros((len(sets), min(4096, width - start)), np.float32)
        m[row[here], col[here] - start] = 1
        both += m @ m.T
    linked = 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)
    linked &= (part[:, None] != part[None, :]) & np.triu(np.ones_like(linked), 1)
    if (group["low"] != group["high"]).iloc[0]:
        linked &= side[:, None] != side[None, :]
    out, root = [], {p: p for p in part.tolist()}

    def top(p):
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    for i, j in zip(*np.nonzero(linked)):
        a, b = top(int(part[i])), top(int(part[j]))
        if a != b:
            root[a] = b
            out.append((cid[i], cid[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def heavy_links(listed: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join components within the lists of more than `LIGHT` classes, block by block."""
    heavy = listed.filter(F.col("members") > LIGHT)
    least = heavy.groupBy("key").agg(F.min("cid").alias("b"))
    clusters = components(heavy.join(least, "key").select(F.col("cid").alias("a"), "b"))
    own = materialize(heavy.select("cid", "component").distinct().join(
        clusters.select(F.col("node").alias("cid"), F.col("component").alias("cluster")), "cid"))
    # Components lie together, the many classes of one first: their blocks need not be compared with each other.
    sizes = own.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"))
    in_order = Window.partitionBy("cluster").orderBy(F.desc("size"), "component").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    placed = numbered(own, ["cluster", "component"], "cid", "nth", own.count()).join(starts, ["cluster", "component"])
    placed = materialize(placed.select(
        "cid", "cluster", "component", F.floor((F.col("start") + F.col("nth")) / BLOCK).cast("int").alias("block")))
    blocks = placed.groupBy("cluster", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    low = blocks.select("cluster", F.col("block").alias("low"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    high = blocks.select("cluster", F.col("block").alias("high"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # Pairs of blocks, not of classes; two blocks of the same single component are left out.
    work = low.join(high, "cluster").filter("low <= high and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
    work = work.select("cluster", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    dealt = work.join(placed, ["cluster", "block"]).join(sets.select("cid", "tokens"), "cid")
    ship(sets.sparkSession)
    return dealt.groupBy("cluster", "low", "high").applyInPandas(_block_links, "a long, b long")


def _placed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, mark, n, component_id) of every row; ``mark`` is a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    rows = materialize(map_arrow(texts, _signatures(words), f"id {kind}, mark long, n long, digest binary"))
    classes = materialize(rows.filter("n > 0").groupBy("digest").agg(
        F.min("id").alias("first_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    sets = candidates(docs, classes, total, id_col, text_col, words)
    listed = keys(first := prefixes(sets), boundary(first))
    links = materialize(verified(meetings(listed), sets))
    found = components(links)
    open_ = materialize(_mixed_lists(_labelled(listed, found)))
    links = materialize(links.unionByName(verified(light_pairs(open_), sets)).unionByName(heavy_links(open_, sets)))
    found = components(links)
    members = classes.join(sets.select("digest", "cid").join(
        found.withColumnRenamed("node", "cid"), "cid"), "digest", "left")
    grouped = members.filter("component is not null")
    names = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(members.filter("component is null").select("digest", "size", F.col("first_id").alias("component_id")).unionByName(
        grouped.select("digest", "size", "component").join(names, "component").select("digest", "size", "component_id")))
    # A class with more than a thousandth of the rows is broadcast: at most a thousand of them.
    big = named.filter(F.col("size") * 1000 > rows.count())
    some = rows.filter("n > 0")
    placed = some.join(F.broadcast(big), "digest").unionByName(
        some.join(F.broadcast(big), "digest", "left_anti").join(named, "digest"))
    return placed.select("id", "mark", "n", "component_id").unionByName(
        rows.filter("n = 0").select("id", "mark", "n", F.col("id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    return _placed(docs, id_col, text_col, words).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; documents without words all stay.

    Of rows that repeat both id and text one stays.
    """
    row_id, mark, size = (free_name(docs, x) for x in ("row_id", "mark", "size"))
    stay = _placed(docs, id_col, text_col, words).filter((F.col("n") == 0) | F.col("id").eqNullSafe(F.col("component_id")))
    stay = stay.groupBy(F.struct(F.col("id").alias(id_col)).alias(row_id), F.col("mark").alias(mark)).agg(F.max("n").alias(size))
    marked = docs.withColumns({row_id: F.struct(F.col(id_col)), mark: F.xxhash64(F.col(text_col).cast("string"))}).join(
        stay, [row_id, mark])
    none, some = marked.filter(F.col(size) == 0), marked.filter(F.col(size) > 0)
    return none.unionByName(some.dropDuplicates([row_id, mark])).select(*docs.columns)
