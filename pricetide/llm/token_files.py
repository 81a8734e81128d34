"""Token counts of the documents in flat token files by scanning for separators.

A flat file is a run of fixed-width token ids in which each document ends with an end-of-document id; there is no
index. Files are read as blocks (file, block, data): byte ranges of fixed size, each opened, sought and read by the
task that searches it, so that a file of any size is dealt over many tasks. Each block is searched for separators in one vector
comparison; what is known of a block is then its size, its separators, and nothing about the blocks before. A
prefix scan over the blocks of a file stitches them: running sums give each block's place and the number of
documents that ended before it, a running maximum gives the last separator before it, which is where the document
that reaches into the block began. The scan has two levels (blocks in groups of `GROUP`, then groups), so a file
of any size makes no large window.

Edge cases: an empty file has no documents; adjacent separators are empty documents; a document may span any
number of blocks; one that the file ends without a separator is reported with ``closed`` false. A block whose
length is no multiple of the width fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.llm.common import map_arrow, materialize

GROUP = 1_024
BLOCK_TOKENS = 1 << 18
#: Blocks that one task reads at most.
TASK_BLOCKS = 64


def _store(file: str):
    """The store that holds ``file`` and the path as that store takes it, for use in tasks."""
    from pyarrow import fs

    if "://" not in file or file.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", file)
    return fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", file), safe=":/@"))


def byte_ranges(files: DataFrame, width: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, at, size) of the blocks of ``files`` (file, length in bytes), dealt over tasks."""
    spark, size = files.sparkSession, width * block_tokens
    n = F.ceil(F.col("length") / size).cast("long")
    total = files.agg(F.sum(n)).first()[0] or 0
    tasks = max(1, min(total, spark.sparkContext.defaultParallelism), -(-total // TASK_BLOCKS))
    cut = files.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    at = F.col("block") * size
    return cut.select("file", "block", at.alias("at"), F.least(F.lit(size).cast("long"), F.col("length") - at).alias("size")).repartition(
        tasks, "file", "block")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of byte ranges, one at a time."""
    for batch in batches:
        for row in batch.to_pylist():
            store, path = _store(row["file"])
            with store.open_input_file(path) as source:
                source.seek(row["at"])
                data = source.read(row["size"])
            if len(data) != row["size"]:
                raise OSError(f"{row['file']} ends within block {row['block']}")
            yield pa.RecordBatch.from_pydict({"file": pa.array([row["file"]]), "block": pa.array([row["block"]], pa.int64()),
                                              "data": pa.array([data], pa.binary())})


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files that ``path`` matches; none is opened."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def read_blocks(spark: SparkSession, path: str, width: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file string, block long, data) of the flat files that ``path`` matches, of any size."""
    return map_arrow(byte_ranges(listed(spark, path), width, block_tokens), _read, "file string, block long, data binary")


def block_schema(kind: str) -> str:
    return f"file long, block long, data binary, first long, ids array<{kind}>"


def block_writer(separator: int, block_tokens: int = BLOCK_TOKENS, branch: int = 0, branches: int = 1):
    """Batches of (id, packed ids) to blocks of one file a task; tasks of different branches write different files."""
    size = 4 * block_tokens

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, first = TaskContext.get().partitionId() * branches + branch, 0, 0
        end, held, names = np.array([separator], "<u4").tobytes(), bytearray(), []
        like = None
        for batch in batches:
            like = batch.column(0).type
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held += (ids or b"") + end
                names.append((name, len(held)))
                while len(held) >= size:
                    done = [n for n, at in names if at <= size]
                    names = [(n, at - size) for n, at in names if at > size]
                    yield _block(file, block, bytes(held[:size]), first, done, like)
                    del held[:size]
                    block, first = block + 1, first + len(done)
        if held:
            yield _block(file, block, bytes(held), first, [n for n, _ in names], like)

    return write


def manifest_schema(kind: str) -> str:
    return f"file string, size long, first long, ids array<{kind}>"


def file_writer(folder: str, separator: int, width: int, block_tokens: int = BLOCK_TOKENS, branch: int = 0, branches: int = 1):
    """Batches of (id, packed ids) to one flat file a task in ``folder``, and to its manifest, a row for each block.

    The file's name has the task's attempt in it: the manifest names the files of the attempts that counted.
    """
    blocks, most = block_writer(separator, block_tokens, branch, branches), (1 << 8 * width) - 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, out = TaskContext.get(), None
        name = f"{folder}/part-{branch}-{context.partitionId()}-{context.taskAttemptId()}.bin"
        store, path = _store(name)
        try:
            for made in blocks(batches):
                tokens = np.frombuffer(made.column("data")[0].as_py(), "<u4")
                if tokens.max() > most:
                    raise ValueError(f"token {tokens.max()} needs more than {width} bytes")
                data = tokens.astype(f"<u{width}").tobytes()
                out = out or store.open_output_stream(path)
                out.write(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([len(data)], pa.int64()), made.column("first"), made.column("ids")],
                    names=["file", "size", "first", "ids"])
        finally:
            if out is not None:
                out.close()

    return write


def write_blocks(encoded: DataFrame, separator: int, id_col: str = "doc_id", ids_col: str = "ids",
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One flat file for each task: (file, block, data, first, ids) from packed 32-bit ids.

    ``ids`` are the ids of the documents that end in the block and ``first`` how many ended before: the manifest,
    which the scan does not look at.
    """
    return map_arrow(encoded.select(id_col, ids_col), block_writer(separator, block_tokens),
                     block_schema(encoded.schema[id_col].dataType.simpleString()))


def _block(file, block, data, first, ids, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()),
        "data": pa.array([data], pa.binary()), "first": pa.array([first], pa.int64()),
        "ids": pa.array([ids], pa.list_(kind))})


def _search(separator: int, width: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x, f"<u{width}") for x in batch.column("data").to_pylist()]
            ends = [np.flatnonzero(t == separator) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(list(map(len, tokens)), pa.int64()),
                 pa.array([e.tolist() for e in ends], pa.list_(pa.int64()))], names=["file", "block", "size", "ends"])

    return search


def stitched(found: DataFrame) -> DataFrame:
    """Per block: ``place`` of its first token, ``before`` (documents ended so far), ``opened`` (end of the last one)."""
    part = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = found.select("file", "block", "size", F.size("ends").cast("long").alias("n"),
                          F.array_max("ends").alias("last"),
                          F.floor(F.col("block") / GROUP).alias("part"))
    inner = blocks.withColumn("place", none(F.sum("size").over(part))).withColumn(
        "before", none(F.sum("n").over(part))).withColumn("end", F.col("place") + F.col("last") + 1).withColumn(
        "opened", F.max("end").over(part))
    parts = inner.groupBy("file", "part").agg(F.sum("size").alias("p_size"), F.sum("n").alias("p_n"), F.max("end").alias("p_end"))
    parts = parts.withColumn("p_place", none(F.sum("p_size").over(whole))).withColumn(
        "p_before", none(F.sum("p_n").over(whole))).withColumn(
        "p_opened", none(F.max(F.col("p_place") + F.col("p_end")).over(whole)))
    return inner.join(parts.select("file", "part", "p_place", "p_before", "p_opened"), ["file", "part"]).select(
        "file", "block", "size", (F.col("place") + F.col("p_place")).alias("place"),
        (F.col("before") + F.col("p_before")).alias("before"),
        F.coalesce(F.col("opened") + F.col("p_place"), F.col("p_opened")).alias("opened"))


def count_tokens(blocks: DataFrame, separator: int, width: int = 4) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the files, the separator not counted."""
    kind = blocks.schema["file"].dataType.simpleString()
    return _counted(map_arrow(blocks.select("file", "block", "data"), _search(separator, width), _found(kind)))


def count_files(files: DataFrame, separator: int, width: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """`count_tokens` of ``files`` (file, length in bytes), which are read and searched in the same worker."""
    search = _search(separator, width)
    return _counted(map_arrow(byte_ranges(files, width, block_tokens), lambda ranges: search(_read(ranges)), _found("string")))


def _found(kind: str) -> str:
    return f"file {kind}, block long, size long, ends array<long>"


def _counted(found: DataFrame) -> DataFrame:
    found = materialize(found)
    placed = materialize(stitched(found).join(found.select("file", "block", "ends"), ["file", "block"]))
    ended = placed.select("file", "place", "before", "opened", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("before") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("opened")).otherwise(
            F.col("place") + F.col("ends")[F.col("i") - 1] + 1).alias("start"),
        (F.col("place") + F.col("end")).alias("stop"), F.lit(True).alias("closed"))
    files = placed.groupBy("file").agg(
        F.sum(F.size("ends")).cast("long").alias("ordinal"), F.sum("size").alias("stop"),
        F.coalesce(F.max(F.col("place") + F.array_max("ends") + 1), F.lit(0).cast("long")).alias("start"))
    open_ends = files.filter("start < stop").select("file", "ordinal", "start", "stop", F.lit(False).alias("closed"))
    return ended.unionByName(open_ends).select(
        "file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def named(counts: DataFrame, files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``counts`` with the ids that the writer's manifest gives to a file's documents."""
    manifest = files.select("file", "first", F.posexplode("ids").alias("i", id_col)).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), id_col)
    return manifest.join(counts, ["file", "ordinal"]).select(id_col, "n_tokens", "file", "ordinal", "start")
