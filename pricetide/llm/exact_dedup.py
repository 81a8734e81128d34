"""Exact deduplication with a heavy-hitter split.

1. Every text becomes a SHA-256 digest, once; later steps read the stored digests only.
2. Misra-Gries: each task keeps at most ``counters`` counters over its digests. Adding the tasks' counters up
   gives for every digest a count that is low by at most n / (counters + 1), so each digest with more than
   2 n / (counters + 1) rows is among those whose sum exceeds n / (counters + 1): at most ``counters`` of them.
3. A counting pass over those candidates alone, combined on the map side, verifies them: exact group sizes and
   the row that stays. The verified winners are broadcast (``counters`` rows at most, whatever the input) and
   their rows are settled where they lie. A text with a third of all rows is never shuffled.
4. The remaining digests take the ordinary way: a grouped aggregate and a join on the digest.

Edge cases: a null text counts as empty. Rows without a doc_id lose to any row with one. Of repeated rows (same
doc_id and text) exactly one stays. An empty table gives no rows. `exact_duplicates` gives its five columns and no
others; `drop_exact_duplicates` keeps all columns of the rows that stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import free_name, map_arrow, materialize

COUNTERS = 1000

_SUMMARY = "digest binary, low long, seen long"


def _misra_gries(counters: int):
    """Per task: its digests' Misra-Gries counters, and one row with the number of rows seen."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        seen = 0
        for batch in batches:
            counts = batch.column(0).value_counts()
            seen += batch.num_rows
            for digest, n in zip(counts.field(0).to_pylist(), counts.field(1).to_numpy()):
                held[digest] = held.get(digest, 0) + int(n)
            if len(held) > counters:
                # Take the (counters+1)-th largest count off all; what reaches zero goes.
                values = np.fromiter(held.values(), np.int64, len(held))
                cut = int(np.partition(values, -counters - 1)[-counters - 1])
                held = {d: n - cut for d, n in held.items() if n > cut}
        yield pa.RecordBatch.from_pydict({
            "digest": pa.array([*held, None], pa.binary()),
            "low": pa.array([*held.values(), 0], pa.int64()),
            "seen": pa.array([*[0] * len(held), seen], pa.int64())})

    return summarise


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, group_size, keep_row): each digest of more than 2 n / (counters + 1) rows, with exact figures.

    ``digests`` has digest binary and row struct(doc_id, ...), ordered so that the greatest row stays. At most
    ``counters`` rows come back.
    """
    summary = map_arrow(digests.select("digest"), _misra_gries(counters), _SUMMARY)
    sums = materialize(summary.groupBy("digest").agg(F.sum("low").alias("low"), F.sum("seen").alias("seen")))
    rows = sums.agg(F.sum("seen")).first()[0] or 0
    error = rows / (counters + 1)
    candidates = sums.filter(F.col("digest").isNotNull() & (F.col("low") > error)).select("digest")
    counted = digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("row").alias("keep_row"))
    return counted.filter(F.col("group_size") > 2 * error)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     counters: int = COUNTERS) -> DataFrame:
    """Every row's id with keep_id, group_size, kept and text_sha256; the row with the largest id stays."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digests = materialize(docs.select(
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
        F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("place")).alias("row")))
    heavy = F.broadcast(materialize(heavy_digests(digests, counters)))
    settled = digests.join(heavy, "digest")
    rest = digests.join(heavy.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("row").alias("keep_row"))
    return settled.unionByName(rest.join(groups, "digest")).select(
        F.col("row.id").alias(id_col),
        F.col("keep_row.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows (same id and text) any one."""
    row_id, digest = free_name(docs, "row_id"), free_name(docs, "digest")
    stay = exact_duplicates(docs, id_col, text_col, counters).filter("kept").select(
        F.struct(F.col(id_col)).alias(row_id), F.col("text_sha256").alias(digest))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumns({row_id: F.struct(F.col(id_col)), digest: F.sha2(F.encode(text, "UTF-8"), 256)})
    # Both steps work on one partitioning by (row_id, digest); an id inside a struct also matches when null.
    return marked.join(stay, [row_id, digest], "left_semi").dropDuplicates([row_id, digest]).select(*docs.columns)
