"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with the same link key (here: equal texts) are linked. The operator puts every document into one of
``shards`` shards whose row counts differ by one at most, and cuts as few links as it can:

1. Keys with one document have no links; those documents wait and fill up the shards at the end.
2. Linked documents start dealt evenly. In each round a key's documents are counted by shard (combined on the
   map side); the key's target is its fullest shard, or its k fullest if it cannot fit into fewer. Documents
   elsewhere ask to move to a target, which moves them towards most of their neighbours.
3. Quotas bound the moves: between two shards as many go one way as the other, and beyond that a shard takes
   only what its capacity has free. Requests with the largest gain in neighbours go first. So no round ever
   breaks the balance. Rounds go on as long as they cut fewer links: until nobody asks, nobody's move is granted, or
   a round keeps no more links together than the one before, whose places then stand.
4. Linked documents are numbered within their shard and the waiting ones fill the rest, which makes the counts
   exact.

Scale: the text is read once; afterwards rows are a few dozen bytes. A key may hold any share of the rows: all
joins on a key are on (key, salt) with `SALTS` salts per key, per-key state is one count for each shard, and
numbering is by hash buckets (`numbered`). Broadcast are only the quotas: one row for each pair of shards and
gain level, 64 * shards**2 rows at most. Tables between rounds are written to the shared folder.

Edge cases: a null or empty text has size 8 and crc 0, and null equals empty. Repeated rows and null ids are rows of
their own. Ties between shards and between requests are settled by hashes. Long texts are only hashed and measured, on
the JVM. Fewer rows than shards leave shards empty. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import materialize, numbered, salt

SHARDS = 24
SALTS = 64
#: Of a shard's capacity, what a key too large for one shard counts on having in each of its targets.
FILL = 0.8


def _at(values: list[int], index: str) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])[F.col(index)]


def _counts(df: DataFrame, shards: int) -> list[int]:
    found = dict(df.groupBy("shard").count().collect())  # one row for each shard
    return [found.get(s, 0) for s in range(shards)]


def link_groups(rows: DataFrame) -> DataFrame:
    """(key, group_size, salts) of keys with two rows at least."""
    return rows.groupBy("key", "salt").count().groupBy("key").agg(
        F.sum("count").alias("group_size"), F.collect_list("salt").alias("salts")).filter("group_size > 1")


def kept_together(placed: DataFrame) -> int:
    """Pairs of rows of one key in one shard, each row with itself included; twice the links not cut, plus the rows."""
    n = F.count(F.lit(1)).cast("decimal(19,0)")
    return int(placed.groupBy("key", "shard").agg(n.alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)


def _requests(placed: DataFrame, groups: DataFrame, capacity: int, turn: int) -> DataFrame:
    """(row, source, shard, level): rows that want to move, with the order of magnitude of their gain."""
    by_shard = placed.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.size("by_shard"), F.ceil(F.col("group_size") / F.lit(max(1, int(FILL * capacity)))).cast("int"))
    ranked = F.array_sort(F.transform("by_shard", lambda x: F.struct(
        (-x["n"]).alias("less"), F.xxhash64(F.col("key"), x["shard"]).alias("tie"), x["shard"].alias("shard"))))
    targets = by_shard.groupBy("key").agg(F.collect_list(F.struct("shard", "n")).alias("by_shard")).join(
        groups, "key").select("key", F.explode("salts").alias("salt"),
                              F.map_from_entries("by_shard").alias("counts"),
                              F.transform(F.slice(ranked, F.lit(1), wanted), lambda x: x["shard"]).alias("targets"))
    chosen = F.col("targets")[F.pmod(F.xxhash64("row", F.lit(turn)), F.size("targets")).cast("int")]
    gain = F.col("counts")[F.col("shard")] - F.col("counts")[F.col("source")] + 1
    return placed.withColumnRenamed("shard", "source").join(targets, ["key", "salt"]).filter(
        ~F.array_contains("targets", F.col("source"))).withColumn("shard", chosen).withColumn("gain", gain).filter(
        "gain > 0").select("row", "source", "shard", F.floor(F.log2("gain")).cast("int").alias("level"))


def _quotas(requests: DataFrame, free: list[int]) -> DataFrame:
    """(source, shard, level, before, quota): how many may move, and how many with a larger gain are ahead."""
    levels = requests.groupBy("source", "shard", "level").agg(F.count(F.lit(1)).alias("n"))
    pairs = levels.groupBy("source", "shard").agg(F.sum("n").alias("asked"))
    back = pairs.select(F.col("source").alias("shard"), F.col("shard").alias("source"), F.col("asked").alias("back"))
    into = Window.partitionBy("shard").orderBy(F.desc("over"), "source").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.join(back, ["source", "shard"], "left").withColumn(
        "swapped", F.least("asked", F.coalesce("back", F.lit(0)))).withColumn("over", F.col("asked") - F.col("swapped"))
    room = _at(free, "shard") - (F.sum("over").over(into) - F.col("over"))
    pairs = pairs.withColumn("quota", F.col("swapped") + F.greatest(F.lit(0), F.least("over", room)))
    ahead = Window.partitionBy("source", "shard").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumn("before", F.sum("n").over(ahead) - F.col("n")).join(
        pairs.select("source", "shard", "quota"), ["source", "shard"])


def propagate(linked: DataFrame, groups: DataFrame, rows: int, capacities: list[int]) -> DataFrame:
    """(row, key, salt, shard) of the linked rows; no shard gets more of them than its capacity."""
    shards = len(capacities)
    placed = materialize(numbered(linked.select("row", "key", "salt"), [], "row", "number", rows).select(
        "row", "key", "salt", F.pmod("number", F.lit(shards)).cast("int").alias("shard")))
    together, turn = kept_together(placed), 0
    while True:
        requests = materialize(_requests(placed, groups, min(c for c in capacities), turn))
        asked = requests.count()
        if not asked:
            return placed
        free = [c - n for c, n in zip(capacities, _counts(placed, shards))]
        quotas = materialize(_quotas(requests, free))
        granted = numbered(requests, ["source", "shard", "level"], "row", "number", asked).join(
            F.broadcast(quotas), ["source", "shard", "level"]).filter("before + number < quota").select(
            "row", F.col("shard").alias("to"))
        moved = materialize(placed.join(granted, "row", "left").select(
            "row", "key", "salt", F.coalesce("to", "shard").alias("shard")))
        now = kept_together(moved)
        if now <= together:  # nothing was granted, or it did not help
            return placed
        placed, together, turn = moved, now, turn + 1


def balanced_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (unique row long, key) with shard int and slot long, gapless from 0 in each shard."""
    keyed = materialize(rows.withColumn("salt", salt(F.col("row"), SALTS)))
    groups = materialize(link_groups(keyed))
    marked = materialize(keyed.join(
        groups.select("key", F.explode("salts").alias("salt"), "group_size"), ["key", "salt"], "left"))
    total, linked = marked.count(), marked.filter("group_size is not null").count()
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    placed = propagate(marked.filter("group_size is not null"), groups, linked, capacities)
    held = _counts(placed, shards)
    starts = [sum(c - n for c, n in zip(capacities[:s], held)) for s in range(shards)]
    alone = numbered(marked.filter("group_size is null"), [], "row", "number", total - linked)
    into = sum(((F.col("number") >= s).cast("int") for s in starts[1:]), F.lit(0))
    alone = alone.withColumn("shard", into).withColumn(
        "slot", _at(held, "shard") + F.col("number") - _at(starts, "shard")).drop("number")
    settled = numbered(placed.select("row", "shard"), ["shard"], "row", "slot", linked)
    return marked.join(settled, "row").select(*rows.columns, "group_size", "shard", "slot").unionByName(
        alone.withColumn("group_size", F.lit(1)).select(*rows.columns, "group_size", "shard", "slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size, text_crc32, shard, slot and group_size of every document; documents of equal text are linked."""
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"))
    return balanced_shards(rows, shards).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", F.col("group_size").cast("long").alias("group_size"))
