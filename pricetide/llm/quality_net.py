"""A byte-level convolutional quality classifier in numpy.

A document is the bytes of its whole text, cut into chunks of `WINDOWS` window starts; neighbouring chunks overlap
by a filter's width less one, so every window of the text lies in exactly one chunk. Each of `FILTERS` learned
filters is a table of a value per offset and byte (a convolution over one-hot bytes); its largest response in a
chunk is kept (max-pooling), a hidden layer and one output make the chunk's logit, and the chunks' logits, averaged
by their number of windows, give the document's one probability.

Learning runs in numpy on the driver, over at most `TRAIN_ROWS` labelled documents of each label (by hash of the id)
and all chunks of each; a document's chunks share its weight. Scoring covers every row and every byte, over Arrow
batches, without a shuffle. At most `SLICE` bytes are taken at a time, and responses made for `BLOCK` window starts: a
longer text is taken in parts of whole chunks, whose sums are carried, so memory does not grow with the text beyond the
text itself.

Edge cases: a null or empty text is one window of padding. Without labels of both classes the score is the share of
good labels (1/2 without any). Repeated labels of an id count as the lowest. Null ids and labels are never learned
from. Extra columns are kept (see `toxicity.with_score`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import map_arrow, sampled
from pricetide.llm.textbuf import slices
from pricetide.llm.toxicity import held_out

WIDTH = 6
FILTERS = 24
HIDDEN = 16
WINDOWS = 506
TRAIN_ROWS = 1_500
EPOCHS = 8
#: Bytes of text taken at a time.
SLICE = 1 << 17
#: Window starts whose responses are held at once, of 4 * FILTERS bytes each.
BLOCK = 1 << 11

_CHUNK = WINDOWS + WIDTH - 1


@dataclass
class Net:
    """Filter tables (WIDTH, 256, FILTERS), their biases, hidden layer and output."""

    tables: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def pooled(self, body: np.ndarray, at: np.ndarray, after: np.ndarray = np.zeros(0, np.uint8)
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(largest responses, windows, text) of each chunk of the texts of a slice; ``after`` are the bytes that follow
        the last of them, where that is a part of a text."""
        sizes = np.diff(at)
        lengths = np.maximum(sizes, 1)
        room = lengths + WIDTH - 1
        begin = np.cumsum(room) - room
        padded = np.zeros(int(room.sum()), np.uint8)
        padded[np.repeat(begin, sizes) + np.arange(len(body)) - np.repeat(at[:-1], sizes)] = body
        if len(after):
            padded[len(padded) - WIDTH + 1:len(padded) - WIDTH + 1 + len(after)] = after
        chunks = -(-lengths // WINDOWS)
        text = np.repeat(np.arange(len(lengths)), chunks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        windows = np.minimum(WINDOWS, lengths[text] - nth * WINDOWS)
        starts = begin[text] + nth * WINDOWS
        return self._largest(padded, starts, starts + windows), windows, text

    def _largest(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The largest responses to the windows from each start to its end, which follow one another.

        Responses are made for `BLOCK` window starts at a time, in two buffers that stay in the processor's cache; a
        chunk that lies in several blocks has the largest of its parts.
        """
        total = int(ends[-1])
        cuts = np.unique(np.concatenate([starts, ends[:-1], np.arange(0, total, BLOCK)]))
        edges = np.searchsorted(cuts, np.arange(0, total + BLOCK, BLOCK))
        parts = np.empty((len(cuts), FILTERS), np.float32)
        made, more = (np.empty((min(BLOCK, total), FILTERS), np.float32) for _ in range(2))
        for at, low, high in zip(range(0, total, BLOCK), edges[:-1], edges[1:]):
            n = min(BLOCK, total - at)
            response, other = made[:n], more[:n]
            np.take(self.tables[0], padded[at:at + n], axis=0, out=response, mode="clip")
            for j in range(1, WIDTH):
                np.take(self.tables[j], padded[at + j:at + j + n], axis=0, out=other, mode="clip")
                response += other
            parts[low:high] = np.maximum.reduceat(response, cuts[low:high] - at, axis=0)
        # Between two texts lie windows over both: the parts after a chunk's end that are no chunk's.
        bounds = np.searchsorted(cuts, np.stack([starts, ends], 1).ravel())
        if bounds[-1] == len(parts):
            bounds = bounds[:-1]
        found = np.maximum.reduceat(parts, bounds, axis=0)
        own = np.zeros(len(bounds), bool)
        own[::2] = True
        return found[own]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        active = np.maximum(pooled + self.bias, 0)
        return np.maximum(active @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def scores(self, column) -> np.ndarray:
        made = np.empty(len(column))
        for first, body, at in slices(column, SLICE):
            n = len(at) - 1
            if len(body) > SLICE:
                made[first] = self._long(body)
                continue
            pooled, windows, text = self.pooled(body, at)
            sums = np.bincount(text, self.logits(pooled) * windows, n)
            made[first:first + n] = sums / np.bincount(text, windows, n)
        return 1 / (1 + np.exp(-np.clip(made, -500, 500)))

    def _long(self, body: np.ndarray) -> float:
        """The logit of one text, by parts of whole chunks."""
        total, step = 0.0, max(1, SLICE // WINDOWS) * WINDOWS
        for begin in range(0, len(body), step):
            part = body[begin:begin + step]
            after = body[begin + step:begin + step + WIDTH - 1]
            pooled, windows, _ = self.pooled(part, np.array([0, len(part)]), after)
            total += float(self.logits(pooled) @ windows)
        return total / len(body)


@dataclass(frozen=True)
class Constant:
    value: float

    def scores(self, column) -> np.ndarray:
        return np.full(len(column), self.value)


def fit(chunks: np.ndarray, valid: np.ndarray, good: np.ndarray, weight: np.ndarray | None = None, epochs: int = EPOCHS,
        rate: float = 0.01, batch: int = 64, seed: int = 11) -> Net:
    """A net for chunks (n, _CHUNK) of bytes with ``valid`` window starts each, by Adam on the logistic loss.

    ``weight`` is a chunk's share in its document; every chunk comes up once in an epoch and counts by its weight.
    """
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
              rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
              rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32), 0.0)
    weights = {k: np.atleast_1d(np.asarray(v, np.float32)) for k, v in vars(net).items()}
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in weights.items()}
    weight = np.ones(len(good)) if weight is None else weight
    share = min(max(float(good @ weight / weight.sum()), 1e-6), 1 - 1e-6)
    balance = (np.where(good > 0, 0.5 / share, 0.5 / (1 - share)) * weight / weight.mean()).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(good))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            x, y = chunks[own], good[own]
            longest = int(valid[own].max())
            response = weights["tables"][0][x[:, :longest]]
            for j in range(1, WIDTH):
                response += weights["tables"][j][x[:, j:j + longest]]
            response[np.arange(longest)[None, :] >= valid[own][:, None]] = -np.inf
            where = response.argmax(1)
            pooled = np.take_along_axis(response, where[:, None, :], 1)[:, 0]
            active = np.maximum(pooled + weights["bias"], 0)
            inner = np.maximum(active @ weights["hidden"] + weights["hidden_bias"], 0)
            z = inner @ weights["out"] + weights["out_bias"]
            error = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * balance[own] / len(own)).astype(np.float32)
            d_inner = error[:, None] * weights["out"] * (inner > 0)
            d_active = d_inner @ weights["hidden"].T * (active > 0)
            g = {"out": inner.T @ error, "out_bias": error.sum(keepdims=True), "hidden": active.T @ d_inner,
                 "hidden_bias": d_inner.sum(0), "bias": d_active.sum(0), "tables": np.zeros_like(weights["tables"])}
            rows = np.arange(len(own))[:, None]
            for j in range(WIDTH):
                np.add.at(g["tables"][j], (x[rows, where + j], np.arange(FILTERS)[None, :]), d_active)
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * step * batch / (epochs * len(order) + batch)))
            for k in weights:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.999 * v2[k] + 0.001 * g[k] * g[k]
                weights[k] = weights[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return Net(*(weights[k] for k in ("tables", "bias", "hidden", "hidden_bias", "out")), float(weights["out_bias"][0]))


def _training_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, weight, parts = [], [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            count = max(1, -(-len(raw) // WINDOWS))
            for k in range(count):
                good.append(label)
                weight.append(1 / count)
                parts.append(raw[k * WINDOWS:k * WINDOWS + _CHUNK])
        # The last chunk's windows end with the text; inner chunks have WINDOWS of them.
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.float64()), pa.array(weight, pa.float64()), pa.array(parts, pa.binary())],
                                         names=["good", "weight", "chunk"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = TRAIN_ROWS) -> Net | Constant:
    """A net of the labelled rows that are not held out (remainder 1 of 3)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1)).groupBy(
        id_col).agg(F.min(label_col).cast("double").alias("good"))
    first = lambda x: sampled(known.filter(F.col("good") == x), [id_col], rows)
    sample = first(0).unionByName(first(1))  # at most ``rows`` ids of each label
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), id_col)
    held = map_arrow(texts.select("good", "text"), _training_chunks, "good double, weight double, chunk binary").orderBy(
        F.xxhash64("chunk"), "chunk", "good", "weight").toPandas()
    good = held["good"].to_numpy(float)
    if not len(good) or not 0 < good.mean() < 1:
        return Constant(float(good.mean()) if len(good) else 0.5)
    chunks = np.zeros((len(good), _CHUNK), np.uint8)
    for i, raw in enumerate(held["chunk"]):
        chunks[i, :len(raw)] = np.frombuffer(raw, np.uint8)
    return fit(chunks, np.clip(held["chunk"].map(len).to_numpy(), 1, WINDOWS), good, held["weight"].to_numpy(float))
