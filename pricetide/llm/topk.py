"""Exact search for the largest inner products, with candidates eliminated by a table of pivot distances.

Vectors are whole numbers (`vectors`). Distances of every vector to up to `PIVOTS` pivots are computed once. By the
triangle inequality |d(q, p) - d(c, p)| is a lower bound of d(q, c) for each pivot p, and the largest of them gives
2 q.c = |q|^2 + |c|^2 - d^2 <= |q|^2 + |c|^2 - bound^2: an upper bound of the score.

1. Pivots are taken from a sample of at most `SAMPLE` vectors, each the farthest from those before. The sample's own
   scores give every query a first threshold: its k-th best score there, its own row set aside, is not above the k-th
   best of all. Pivots and sample only steer the elimination; they don't change results.
2. Each vector goes to the cell of its nearest pivot; cells are dealt by hash into blocks of at most ``block_rows``
   rows, so a cell (a group of equal vectors, say) may hold any share of the rows. Per cell and pivot the least and
   largest distance are kept: a query is sent only to blocks of cells whose bound reaches its threshold.
3. A task holds one block at a time and streams the queries sent to it. The block's rows are cut into pages by
   distance to the cell's pivot. Pages are taken in the order of their bound, until no page's bound reaches the k-th
   best score so far. In a page, candidates are eliminated one by one by their own bounds from all pivots, and what is
   left is scored exactly.
4. The best k of every block meet in a window per query row (k rows a block at most).

Products are exact: in single precision where Cauchy's inequality keeps sums below 2^24, in double below 2^53, in
whole numbers beyond. Bounds have a slack above their rounding, and a tie with the threshold is never eliminated.
Where nothing can be eliminated (directions without structure in many dimensions) all pairs of queries and rows are
scored, a block at a time; queries are sent once per block, at most (rows / block_rows + cells) times each.

Edge cases: rows whose vector is null or holds a null, infinite or undefined component take no part, neither as
queries nor as candidates. A query leaves out its own row only: another row with its id is a candidate. Ties go to the
smaller id, null ids last. A row asks if the condition ``asks`` is true for it, not if it is null. Fewer candidates
than k give fewer rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import map_arrow, materialize, sampled
from pricetide.llm.vectors import exact_products, packed, peak, unpacked, whole_numbers

SCALE = 256.0
PIVOTS = 32
SAMPLE = 1_024
#: Rows of a block: a thirty-second of the table, but no more than this.
BLOCK_ROWS = 1 << 18
PAGE = 256
CHUNK = 128
#: Rounding of the bounds, as a share of the squared norms.
SLACK = 1e-7

_NONE = -(2**62)


def _squares(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide * wide).sum(axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float64), pivots.astype(np.float64)
    gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(gap, 0.0))


def _bound(x: np.ndarray, y: np.ndarray) -> int:
    """No sum of absolute products of a row of ``x`` and one of ``y`` is above this (Cauchy's inequality)."""
    most = float(np.sqrt(_squares(x).max(initial=0.0) * _squares(y).max(initial=0.0)))
    return int(most * (1 + 1e-9)) + 1


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it, the longest first; no two are equal."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax(_squares(sample)))]
    near = _distances(sample, sample[chosen])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class _Block:
    """Candidates of one block: pages by distance to the cell's pivot, and their table of pivot distances."""

    def __init__(self, rows: list[np.ndarray], ids: list[pa.Array], vectors: list[pa.Array], pivots: np.ndarray):
        x = np.vstack([unpacked(v, pivots.shape[1]) for v in vectors])
        self.ids, rows = pa.concat_arrays(ids), np.concatenate(rows)
        rank = np.empty(len(x), np.int64)
        rank[pc.sort_indices(self.ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(x))
        table = _distances(x, pivots)
        order = np.argsort(table[:, int(np.argmin(table.mean(axis=0)))], kind="stable") if len(pivots) else np.arange(len(x))
        self.at, self.x, self.table, self.rank = order, x[order], table[order], rank[order]
        self.squares = _squares(self.x)
        self.single = self.x.astype(np.float32)
        starts = np.arange(0, len(x), PAGE)
        self.pages = [(int(a), int(min(a + PAGE, len(x)))) for a in starts]
        self.low, self.high = np.minimum.reduceat(self.table, starts), np.maximum.reduceat(self.table, starts)
        self.peaks = np.maximum.reduceat(self.squares, starts)
        by_row = np.argsort(rows[order], kind="stable")
        self.sorted_rows, self.place = rows[order][by_row], by_row

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where these rows stand in the block; -1 if they are in another."""
        k = np.minimum(np.searchsorted(self.sorted_rows, rows), len(self.sorted_rows) - 1)
        return np.where(self.sorted_rows[k] == rows, self.place[k], -1)

    def search(self, q: np.ndarray, rows: np.ndarray, floor: np.ndarray, pivots: np.ndarray, k: int):
        """(query, place, score) of each query's best k here, left out what can't be among the best k of all."""
        table, squares, own = _distances(q, pivots), _squares(q), self.places(rows)
        bound = _bound(q, self.x)
        queries = q.astype(np.float32) if bound < 1 << 24 else q
        candidates = self.single if bound < 1 << 24 else self.x
        slack = SLACK * (squares[:, None] + self.peaks) + 1.0
        gap = np.zeros((len(q), len(self.pages)))
        for p in range(len(pivots)):
            gap = np.maximum(gap, np.maximum(self.low[:, p] - table[:, p:p + 1], table[:, p:p + 1] - self.high[:, p]))
        reach = squares[:, None] + self.peaks - gap * gap + slack  # twice the best score a page may hold
        least, last = floor.astype(object) if bound >= 1 << 62 else floor.copy(), np.full(len(q), len(self.x), np.int64)
        best = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, object if bound >= 1 << 62 else np.int64)]
        order = np.argsort(-reach.max(axis=0), kind="stable")
        for page in order.tolist():
            twice = 2.0 * least.astype(np.float64)
            asking = np.flatnonzero(reach[:, page] >= twice)
            if not len(asking):
                if not (reach.max(axis=0)[order] >= twice.min(initial=np.inf)).any():
                    break
                continue
            a, b = self.pages[page]
            low = np.abs(table[asking, :1] - self.table[a:b, 0]) if len(pivots) else np.zeros((len(asking), b - a))
            for p in range(1, len(pivots)):
                np.maximum(low, np.abs(table[asking, p:p + 1] - self.table[a:b, p]), out=low)
            alive = squares[asking, None] + self.squares[a:b] - low * low + slack[asking, page][:, None] >= twice[asking, None]
            inside = (own[asking] >= a) & (own[asking] < b)
            alive[np.flatnonzero(inside), own[asking][inside] - a] = False
            some, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(some):
                continue
            if bound < 1 << 24:
                scores = (queries[asking[some]] @ candidates[a:b][cols].T).astype(np.int64)
            else:
                scores = exact_products(queries[asking[some]], candidates[a:b][cols].T, bound)
            who = asking[some]
            rank = self.rank[a:b][cols]
            better = (scores > least[who, None]) | ((scores == least[who, None]) & (rank < last[who, None]))
            i, j = np.nonzero(better & alive[np.ix_(some, cols)])
            if not len(i):
                continue
            query = np.concatenate([best[0], who[i]])
            place = np.concatenate([best[1], a + cols[j]])
            score = np.concatenate([best[2], scores[i, j]])
            keep = np.lexsort((self.rank[place], -score, query))
            query, place, score = query[keep], place[keep], score[keep]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            full = np.flatnonzero(nth == k - 1)
            least[query[full]], last[query[full]] = score[full], self.rank[place[full]]
            best = [v[nth < k] for v in (query, place, score)]
        return best


def top_k(df: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which ``asks`` holds."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_numbers(batch.column(2), scale):
                yield pa.RecordBatch.from_arrays(
                    [c.take(pa.array(rows)) for c in batch.columns[:2]] + [pa.array(packed(x), pa.binary())],
                    names=["id", "asks", "vector"])

    whole = materialize(map_arrow(source, pack, f"id {kind}, asks boolean, vector binary").withColumn(
        "row", F.monotonically_increasing_id()))
    total = whole.count()
    seen = pa.array([bytes(r.vector) for r in sampled(whole.select("row", "vector"), ["row"], sample).collect()], pa.binary())
    dims = whole.agg(F.max((F.length("vector") - 1) / F.ascii(F.substring("vector", 1, 1).cast("string")))).first()[0]
    dims = int(dims or 0)
    seeds = unpacked(seen, dims)
    points = choose_pivots(seeds, pivots)
    n_cells = max(1, len(points))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell of every row, and per task what its cells span."""
        count, top = np.zeros(n_cells, np.int64), np.zeros(n_cells)
        low, high = np.full((n_cells, len(points)), np.inf), np.full((n_cells, len(points)), -np.inf)
        for batch in batches:
            x = unpacked(batch.column(0), dims)
            table = _distances(x, points)
            cell = table.argmin(axis=1) if len(points) else np.zeros(len(x), np.int64)
            np.add.at(count, cell, 1)
            np.maximum.at(top, cell, _squares(x))
            np.minimum.at(low, cell, table)
            np.maximum.at(high, cell, table)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), pa.array(top[used]), pa.array(low[used].tolist(), pa.list_(pa.float64())),
             pa.array(high[used].tolist(), pa.list_(pa.float64()))], names=["cell", "n", "top", "low", "high"])

    spans = map_arrow(whole.select("vector"), place, "cell long, n long, top double, low array<double>, high array<double>")
    each = [F.min(F.element_at("low", p + 1)).alias(f"low_{p}") for p in range(len(points))] + \
        [F.max(F.element_at("high", p + 1)).alias(f"high_{p}") for p in range(len(points))]
    spans = {r.cell: r for r in spans.groupBy("cell").agg(F.sum("n").alias("n"), F.max("top").alias("top"), *each).collect()}
    room = max(1, min(block_rows, -(-total // 32)))
    parts = np.array([-(-spans[c].n // room) if c in spans else 0 for c in range(n_cells)], np.int64)
    first = np.cumsum(parts) - parts
    low = np.array([[spans[c][f"low_{p}"] if c in spans else 0.0 for p in range(len(points))] for c in range(n_cells)])
    high = np.array([[spans[c][f"high_{p}"] if c in spans else 0.0 for p in range(len(points))] for c in range(n_cells)])
    tops = np.array([spans[c].top if c in spans else 0.0 for c in range(n_cells)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(2), dims)
            cell = _distances(x, points).argmin(axis=1) if len(points) else np.zeros(len(x), np.int64)
            part = batch.column(3).to_numpy() % np.maximum(parts[cell], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[cell] + part), pa.array(np.zeros(len(x), np.int32)), batch.column(0), batch.column(1),
                 batch.column(2), pa.nulls(len(x), pa.int64())], names=["block", "kind", "row", "id", "vector", "least"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query, with its first threshold, to every block of the cells that its bounds don't rule out."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                piece = batch.slice(begin, 1024)
                x = unpacked(piece.column(2), dims)
                least = np.full(len(x), _NONE, np.int64)
                if len(seeds) > k:  # the (k + 1)-th, as the query's own row may be in the sample
                    scores = exact_products(x, seeds.T, _bound(x, seeds))
                    nth = np.sort(scores, axis=1)[:, -(k + 1)]
                    least = np.array([max(_NONE, min(int(v), 2**62)) for v in nth], np.int64)
                table, squares = _distances(x, points), _squares(x)
                gap = np.zeros((len(x), n_cells))
                for p in range(len(points)):
                    gap = np.maximum(gap, np.maximum(low[:, p] - table[:, p:p + 1], table[:, p:p + 1] - high[:, p]))
                sums = squares[:, None] + tops
                go = (sums - gap * gap + SLACK * sums + 1.0 >= 2.0 * least[:, None]) & (parts > 0)
                query, cell = np.nonzero(go)
                copies = parts[cell]
                query, cell = np.repeat(query, copies), np.repeat(cell, copies)
                part = np.arange(len(cell)) - np.repeat(np.cumsum(copies) - copies, copies)
                at = pa.array(query)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[cell] + part), pa.array(np.ones(len(cell), np.int32)), piece.column(0).take(at),
                     piece.column(1).take(at), piece.column(2).take(at), pa.array(least[query])],
                    names=["block", "kind", "row", "id", "vector", "least"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                run, number = batch.slice(a, b - a), int(key[a]) // 2
                if number != current:
                    current, held, block = number, [], None
                if key[a] % 2 == 0:
                    held.append(run)
                    continue
                if block is None and not held:
                    continue  # the hash left this block without candidates
                if block is None:
                    block = _Block([r.column(2).to_numpy() for r in held], [r.column(3) for r in held],
                                   [r.column(4) for r in held], points if len(points) else np.zeros((0, dims), np.int64))
                    held = []
                for begin in range(0, b - a, CHUNK):
                    piece = run.slice(begin, CHUNK)
                    query, spot, score = block.search(
                        unpacked(piece.column(4), dims), piece.column(2).to_numpy(), piece.column(5).to_numpy(), points, k)
                    at = pa.array(query)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(2).take(at), piece.column(3).take(at), block.ids.take(pa.array(block.at[spot])),
                         pa.array(score.astype(np.int64))], names=["row", "query_id", "vec_id", "score"])

    columns = f"block long, kind int, row long, id {kind}, vector binary, least long"
    candidates = map_arrow(whole.select("id", "asks", "vector", F.pmod(F.xxhash64("row"), F.lit(1 << 40)).alias("deal"), "row")
                           .select("row", "id", "vector", "deal"), deal, columns)
    queries = map_arrow(whole.where("asks").select("row", "id", "vector"), send, columns)
    stream = candidates.unionByName(queries).repartition(max(1, int(parts.sum())), "block").sortWithinPartitions("block", "kind")
    found = map_arrow(stream, search, f"row long, query_id {kind}, vec_id {kind}, score long")
    place_in = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(place_in)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
