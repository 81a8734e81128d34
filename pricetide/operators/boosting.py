"""Gradient boosting with leaf-wise trees over byte bins, trained by a group of tasks.

Features are cut once into at most 63 bins by quantiles, with a bin of its own for missing values; a row is then one
byte a feature. Tasks of one barrier stage hold their rows' bytes and grow the trees together: each counts its rows and
gradient signs per leaf, feature and bin, the counts are added up over the tasks, and every task draws the same split
from the sums. A leaf's histogram is its parent's less its sibling's, so only the smaller side of a split is counted.
The tree grows at the leaf of the largest gain; the children of all leaves that may still be split are counted in one
exchange, so a tree takes about as many exchanges as it is deep. Leaf values are medians of residuals, found by four
rounds of counts over the bits of single-precision numbers.

All sums are of whole numbers: the same rows give the same trees however they are dealt. Row samples are hashes of row
key and round, feature samples are drawn from the round. What an exchange moves depends on leaves, features and bins,
not on rows. Trees come back in parts of `ROUNDS_A_JOB` rounds; a lost executor costs the part it was in.

A task deals its rows over as many processes as its executor has cores: they add up their counts in shared memory, which
takes a fraction of a millisecond. Rows that fit one task are trained in one. Tasks of several executors add up theirs
through small files in the shared folder, in about a millisecond; Spark's barrier, which takes a second an exchange and
a tree needs twenty, starts them together and serves where there is no such folder.

A tree sends a row to its leaf by one table a feature: each bin has a bit mask of the leaves that stay possible, and the
lowest bit of the masks' intersection is the leaf. Trees are scored side by side, the masks of 64 trees in a table's row.
With the price's table left out, the same masks give the ensemble as a step function of price.
"""

from __future__ import annotations

import base64
import math
import mmap
import multiprocessing
import os
import re
import struct
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, release, shared_folder, ship

BINS = 64
#: The bin of missing values.
MISSING = BINS - 1
#: Rows that one task holds where exchanges between tasks are dear, at about 200 bytes each while trees grow.
ROWS_A_TASK = 1 << 22
#: Rows for which another executor is worth its exchanges, where they are cheap.
ROWS_WORTH_A_TASK = 1 << 19
#: Rows that a process of a task holds at least; fewer are not worth their exchanges.
ROWS_A_PROCESS = 1 << 15
#: Seconds after which a process takes the others for lost.
PATIENCE = 900
#: Looks after which a process that waits for the others goes to sleep.
LOOKS = 200
#: Rows that are counted at once.
PIECE = 1 << 16
#: Rows from which sets of features are counted at once, and cells that such a set has at most.
FEW, CELLS = 1 << 13, 1 << 12
#: Rows of a leaf, times the processes, up to which it is counted before it is known that it will be split.
AHEAD = 1 << 12
#: Of the splits to come, the part that is counted ahead whatever the size.
AHEAD_SHARE = 2
#: Rows and trees that are scored at once.
SCORED, PACK = 1 << 10, 64
ROUNDS_A_JOB = 1000

TREE_SCHEMA = ("tree int, features array<int>, bins array<int>, missing_left array<boolean>, left array<int>, "
               "right array<int>, values array<double>")


@dataclass(frozen=True)
class Options:
    rounds: int = 2000
    learning_rate: float = 0.01
    leaves: int = 31
    feature_fraction: float = 0.8
    row_fraction: float = 0.8
    l1: float = 0.1
    l2: float = 0.1
    least_rows: int = 20
    seed: int = 42


@dataclass
class Tree:
    """Inner nodes by number: tests feature <= bin; children are nodes, or leaves as -1 - leaf, leaves left to right."""

    features: np.ndarray
    bins: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray


class _Pack:
    """Trees side by side: for each feature and bin the masks of the leaves that stay possible, a number a tree."""

    def __init__(self, trees: list[Tree], n_features: int):
        many, leaves = len(trees), max(len(t.values) for t in trees)
        self.kind, self.real, self.whole, self.shift, self.zero = (
            (np.uint32, np.float32, np.int32, 23, 127) if leaves <= 32 else (np.uint64, np.float64, np.int64, 52, 1023))
        self.values = np.zeros((many, leaves))
        for k, tree in enumerate(trees):
            self.values[k, :len(tree.values)] = tree.values
        self.begins = np.arange(many, dtype=np.int64) * leaves - self.zero
        depth = max(len(t.features) for t in trees)

        def side_by_side(name: str, empty: int) -> np.ndarray:
            out = np.full((depth, many), empty, np.int64)
            for k, tree in enumerate(trees):
                out[:len(tree.features), k] = getattr(tree, name)
            return out

        features, bins, left, right = (side_by_side(n, e) for n, e in (("features", -1), ("bins", 0), ("left", -1), ("right", -1)))
        missing_left, one, each = side_by_side("missing_left", 0) > 0, self.kind(1), np.arange(many)
        below, none = np.zeros((depth + 1, many), self.kind), ~self.kind(0)

        def bits(child: np.ndarray) -> np.ndarray:
            return np.where(child < 0, one << np.maximum(-1 - child, 0).astype(self.kind), below[np.maximum(child, 0), each])

        self.tables = np.full((n_features, BINS, many), none)
        place = np.arange(BINS)[None, :]
        for k in reversed(range(depth)):  # children come after their parents
            to_left = bits(left[k])
            below[k] = to_left | bits(right[k])
            here = np.flatnonzero(features[k] >= 0)
            off = np.where(place == MISSING, ~missing_left[k, here, None], place > bins[k, here, None])
            self.tables[features[k, here], :, here] &= np.where(off, ~to_left[here, None], none)
        # A tree's leaves are numbered from its lowest bit on, so bits beyond them never are the lowest.

    def masks(self, codes: np.ndarray, without: int | None = None) -> np.ndarray:
        """Leaves that stay possible: a row a row, a column a tree."""
        mask = np.full((codes.shape[1], self.tables.shape[2]), ~self.kind(0))
        found = np.empty_like(mask)
        for f, table in enumerate(self.tables):
            if f != without:
                table.take(codes[f], axis=0, out=found, mode="clip")
                mask &= found
        return mask

    def at(self, masks: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Values of the lowest leaves of masks; ``trees`` are their columns' trees."""
        lowest = masks & (~masks + self.kind(1))
        leaf = lowest.astype(self.real).view(self.whole) >> self.shift  # the exponent of a power of two
        return self.values.ravel().take(leaf + (self.begins if trees is None else self.begins[trees]))

    def steps(self, rest: np.ndarray, feature: int, first: int, last: int) -> np.ndarray:
        """What the sum of the trees changes by at each bin of a feature, by the masks of all others."""
        table, out = self.tables[feature], np.zeros((len(rest), last - first + 1))
        start = self.at(rest & table[first])
        out[:, 0] = start.sum(axis=1)
        bins, trees = np.nonzero(table[first + 1:last + 1] != table[first:last])
        if len(bins):
            values = np.concatenate([start, self.at(rest.take(trees, axis=1) & table[bins + first + 1, trees], trees)], axis=1)
            order = np.argsort(trees, kind="stable")  # by tree, then by bin
            before, sorted_ = np.empty(len(bins), np.int64), trees[order]
            before[order] = np.where(np.append(True, sorted_[1:] != sorted_[:-1]), sorted_, np.append(0, order[:-1]) + len(table[0]))
            changes = values[:, len(table[0]):] - values.take(before, axis=1)
            which, begins = np.unique(bins, return_index=True)
            out[:, which + 1] = np.add.reduceat(changes, begins, axis=1)
        return out


@dataclass
class BoostedTrees:
    """A fitted ensemble: inputs in trained order, their bins' upper edges, and the trees."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Bins of a matrix of values, one row a feature; NaN is missing."""
        out = np.empty(values.shape, np.uint8)
        for k, edges in enumerate(self.edges):
            out[k] = np.where(np.isnan(values[k]), MISSING, np.searchsorted(edges, values[k], "left"))
        return out

    @cached_property
    def packs(self) -> list[_Pack]:
        return [_Pack(self.trees[begin:begin + PACK], len(self.features)) for begin in range(0, len(self.trees), PACK)]

    def score(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(codes.shape[1], self.base)
        for rows in _chunks(codes.shape[1]):
            part, some = codes[:, rows].astype(np.int64), out[rows]
            for pack in self.packs:
                for values in pack.at(pack.masks(part)).T:  # in the order of training
                    some += values
        return out

    def response(self, codes: np.ndarray, feature: int, first: int = 0, last: int = MISSING - 1) -> np.ndarray:
        """For each row (the other features as they are) the score by bin of ``feature`` from ``first`` to ``last``."""
        part, steps = codes.astype(np.int64), np.zeros((codes.shape[1], last - first + 1))
        steps[:, 0] = self.base
        for pack in self.packs:
            steps += pack.steps(pack.masks(part, feature), feature, first, last)
        return np.cumsum(steps, axis=1)


# --- training ----------------------------------------------------------------------------------

#: A file's turn, the bytes that follow and the checksum of both: a reader may see a part of it new and the rest old.
_HEAD = struct.Struct("<qqI")


class _Group:
    """The tasks of a barrier stage; alone, nothing is exchanged.

    With a ``folder`` that all tasks see, counts go through small files there: each task writes over a file of its own
    and reads those of the others once they tell the same turn and are whole. Two files a task are written by turns: when
    all have written one, the other has been read by all. Without such a folder they go through Spark's barrier.
    """

    def __init__(self, size: int, folder: str | None = None):
        self.size, self.context, self.name, self.turn = size, None, None, 0
        if size > 1:
            from pyspark import BarrierTaskContext

            self.context = BarrierTaskContext.get()
            self.place = self.context.partitionId()
            if folder:
                self._agree(folder)
        self.dear = size > 1 and self.name is None

    def _agree(self, folder: str) -> None:
        """A name for the files of this attempt, if every task sees what the others write."""
        mine = uuid.uuid4().hex
        try:
            with open(f"{folder}/{mine}", "wb"):
                pass
        except OSError:
            pass
        known = self.context.allGather(mine)
        for _ in range(100):
            seen = all(os.path.exists(f"{folder}/{name}") for name in known)
            if seen:
                break
            time.sleep(0.05)
        if all(told == "yes" for told in self.context.allGather("yes" if seen else "no")):
            self.name = f"{folder}/{known[0]}"

    def neighbours(self) -> int:
        """Tasks of the stage on this executor, this one included."""
        if self.context is None:
            return 1
        where = [info.address for info in self.context.getTaskInfos()]
        return where.count(where[self.place])

    def total(self, counts: np.ndarray) -> np.ndarray:
        """Sum of whole numbers over the tasks."""
        if self.context is None:
            return counts
        peak = int(np.abs(counts).max(initial=0))
        kind = "<i1" if peak < 128 else "<i2" if peak < 1 << 15 else "<i4" if peak < 1 << 31 else "<i8"
        out = np.zeros(counts.size, np.int64)
        if self.name is None:
            sent = kind + base64.b64encode(zlib.compress(counts.astype(kind).tobytes(), 1)).decode()
            for text in self.context.allGather(sent):
                out += np.frombuffer(zlib.decompress(base64.b64decode(text[3:])), text[:3])
            return out.reshape(counts.shape)
        self.turn += 1
        body = kind.encode() + counts.astype(kind).tobytes()
        # Written in place: a file that replaces another is forced to the disk by some file systems.
        file = os.open(f"{self.name}-{self.place}-{self.turn & 1}", os.O_WRONLY | os.O_CREAT)
        try:
            os.pwrite(file, _HEAD.pack(self.turn, len(body), zlib.crc32(body, self.turn)) + body, 0)
        finally:
            os.close(file)
        for place in range(self.size):
            out += counts.ravel() if place == self.place else self._told(f"{self.name}-{place}-{self.turn & 1}")
        return out.reshape(counts.shape)

    def lead(self, counts: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """What ``work`` makes of the sums."""
        return work(self.total(counts))

    def _told(self, path: str) -> np.ndarray:
        begin = time.monotonic()
        while True:
            try:
                file = os.open(path, os.O_RDONLY)
            except FileNotFoundError:
                pass
            else:
                try:
                    head = os.pread(file, _HEAD.size, 0)
                    turn, size, check = _HEAD.unpack(head) if len(head) == _HEAD.size else (0, 0, 0)
                    if turn == self.turn:
                        body = os.pread(file, size, _HEAD.size)
                        if len(body) == size and zlib.crc32(body, turn) == check:
                            return np.frombuffer(body, body[:3].decode(), offset=3)
                finally:
                    os.close(file)
            waited = time.monotonic() - begin
            if waited > PATIENCE:
                raise threading.BrokenBarrierError
            time.sleep(0 if waited < 1e-3 else min(2e-3, waited / 8))


class _Processes:
    """The processes of one task, which add up whole numbers in memory they share. The first one exchanges the sums
    with other tasks and tells the others what follows from them, so that it is worked out once.

    A process writes to two places by turns: when all have met, it may write to the other one while some still read.
    """

    def __init__(self, size: int, most: int, outer: _Group | None = None):
        self.size, self.place, self.turn, self.phase, self.outer = size, 0, 0, 0, outer
        self.dear = outer is not None and outer.dear
        self.fork = multiprocessing.get_context("fork")
        self.gates = [[self.fork.Semaphore(0) for _ in range(size)] for _ in range(2)]
        room = np.frombuffer(mmap.mmap(-1, ((2 * size + 1) * most + 8) * 8), np.int64)
        self.failed, self.shape, self.answer = room[:1], room[1:8], room[8:8 + most].view(np.float64)
        self.shared = room[8 + most:].reshape(2, size, most)

    def _meet(self) -> None:
        """Goes on when all processes have come. Two sets of gates by turns: one may be ahead by one meeting."""
        gates, self.phase = self.gates[self.phase], self.phase ^ 1
        for place, gate in enumerate(gates):
            if place != self.place:
                gate.release()
        mine, looks = gates[self.place], LOOKS
        for _ in range(self.size - 1):
            while looks and not (come := mine.acquire(block=False)):  # to sleep and be woken takes longer than most waits
                looks -= 1
                os.sched_yield()
            if not (looks and come or mine.acquire(timeout=PATIENCE)) or self.failed[0]:
                raise threading.BrokenBarrierError

    def _abort(self) -> None:
        self.failed[0] = 1
        for gate in self.gates[0] + self.gates[1]:
            for _ in range(self.size):
                gate.release()

    def total(self, counts: np.ndarray) -> np.ndarray:
        """Sum of whole numbers over the processes, and those of the other tasks."""
        return self.lead(counts, lambda sums: sums).astype(np.int64).reshape(counts.shape)

    def lead(self, counts: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """What the first process's ``work`` makes of the sums; numbers that doubles hold exactly."""
        self.turn ^= 1
        held = self.shared[self.turn, :, :counts.size]
        held[self.place] = counts.ravel()
        self._meet()
        if self.place == 0:
            sums = held.sum(axis=0).reshape(counts.shape)
            answer = work(sums if self.outer is None else self.outer.total(sums))
            self.shape[:] = *answer.shape, *[-1] * (len(self.shape) - answer.ndim)
            self.answer[:answer.size] = answer.ravel()
        self._meet()
        shape = self.shape[self.shape >= 0].astype(np.int64)
        return self.answer[:int(shape.prod())].reshape(shape).copy()

    def run(self, work: Callable[[int], list]) -> list:
        """Every process does ``work`` with its place; the outcome of the first, which is this one."""
        def other(place: int) -> None:
            self.place = place
            try:
                work(place)
            except threading.BrokenBarrierError:
                pass  # the one that failed tells
            except BaseException:
                self._abort()
                raise

        others = [self.fork.Process(target=other, args=(k,), daemon=True) for k in range(1, self.size)]
        for process in others:
            process.start()
        try:
            return work(0)
        except BaseException:
            self._abort()
            raise
        finally:
            for process in others:
                process.join(PATIENCE)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Single-precision numbers as whole numbers in the same order."""
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _number(order: np.ndarray) -> np.ndarray:
    order = order.astype(np.uint32)
    return np.where(order >> 31, order & np.uint32(0x7FFFFFFF), ~order).astype(np.uint32).view(np.float32)


def medians(group: _Group, values: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Lower median of each of ``n`` classes over all tasks, exact in single precision; 0 for an empty class."""
    return _medians(group, [values[which == k] for k in range(n)])


def _medians(group: _Group, parts: list[np.ndarray]) -> np.ndarray:
    keys, n = [_ordered(part) for part in parts], len(parts)
    sizes = rank = None
    prefix = np.zeros(n, np.int64)
    bits = 8
    for shift in (24, 16, 8, 0):
        digits = [(k >> np.uint32(shift)) & np.uint32((1 << bits) - 1) for k in keys]

        def picked(counts: np.ndarray) -> np.ndarray:
            """The digit of each class's median, the rows before it, and the class's size."""
            sums = np.cumsum(counts, axis=1)
            want = np.maximum(sums[:, -1] - 1, 0) // 2 if rank is None else rank
            pick = np.minimum((sums <= want[:, None]).sum(axis=1), (1 << bits) - 1)
            return np.stack([pick, np.where(pick > 0, sums[np.arange(n), np.maximum(pick - 1, 0)], 0), sums[:, -1]])

        pick, before, whole = group.lead(np.stack([np.bincount(d, minlength=1 << bits) for d in digits]), picked).astype(np.int64)
        if rank is None:
            sizes, rank = whole, np.maximum(whole - 1, 0) // 2
        rank, prefix = rank - before, prefix << bits | pick
        keys = [k.take(np.flatnonzero(d == p)) for k, d, p in zip(keys, digits, pick)]
    return np.where(sizes > 0, _number(prefix), np.float32(0)).astype(np.float64)


class _Node:
    """Rows here, and what all know: the best split with the rows that go left by it. Who leads has the counts as well."""

    def __init__(self, rows: np.ndarray, size: int, found: np.ndarray | None = None):
        self.rows, self.size, self.found = rows, size, found
        self.children: tuple[_Node, _Node] | None = None
        self.gain, self.feature, self.bin, self.missing_left, self.n_left = 0.0, 0, 0, False, 0

    def split_by(self, told: np.ndarray) -> None:
        self.gain = float(told[0])
        self.feature, self.bin, self.missing_left, self.n_left = int(told[1]), int(told[2]), told[3] > 0, int(told[4])


def _together(sizes: list[int]) -> list[list[int]]:
    """Features in sets whose numbers of bins multiply to `CELLS` at most; the largest first, into the fullest set."""
    sets: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        fitting = [(cells, k) for k, (cells, _) in enumerate(sets) if cells * sizes[f] <= CELLS]
        if fitting:
            cells, k = max(fitting)
            sets[k] = cells * sizes[f], [*sets[k][1], f]
        else:
            sets.append((sizes[f], [f]))
    return [members for _, members in sets]


def _records(table: np.ndarray) -> np.ndarray:
    """The rows of a matrix as single values, filled up to a power of two of bytes, which are gathered fastest."""
    width = table.shape[1] * table.itemsize
    full = 1 << (width - 1).bit_length()
    out = np.zeros((len(table), full // table.itemsize), table.dtype)
    out[:, :table.shape[1]] = table
    return out.view(f"V{full}").ravel()


def _fields(records: np.ndarray) -> np.ndarray:
    """Records of two-byte numbers as a matrix again, the same memory."""
    return records.view(np.uint16).reshape(len(records), records.dtype.itemsize // 2)


class Trainer:
    """One task's rows and what all tasks agree on.

    A row's bins are held by column, by row, and as places: sets of features whose bins multiply to few cells are counted
    at once, one number a set. Numbers by row also tell the sign of the row's gradient. Signs seldom change from one tree to the
    next, so the counts over all rows are kept and brought up to date by the rows whose sign did.
    """

    def __init__(self, group: _Group, codes: np.ndarray, target: np.ndarray, keys: np.ndarray, options: Options,
                 ahead: int = AHEAD):
        self.group, self.codes, self.options, self.ahead = group, codes, options, ahead
        self.target, self.keys = target.astype(np.float32), keys
        n = len(self.target)
        used = [np.bincount(column, minlength=BINS)[:MISSING] for column in codes]
        self.sizes = [int(np.flatnonzero(u)[-1]) + 2 if u.any() else 2 for u in used]  # the last bin: missing values
        self.sets = _together(self.sizes)
        self.cells = np.array([math.prod(self.sizes[f] for f in members) for members in self.sets])
        self.signs, places = np.zeros(n, np.int8), np.empty((n, len(self.sets)), np.uint16)
        # A feature has three planes of bins, by sign; 1 is none.
        self.slots = _records(codes.T + ((np.arange(len(codes), dtype=np.uint16) * 3 + 1) * BINS))
        for k, members in enumerate(self.sets):
            place = np.ones(n, np.uint16)
            for f in members:
                place = place * np.uint16(self.sizes[f]) + np.minimum(codes[f], self.sizes[f] - 1)
            places[:, k] = place
        self.places = _records(places)
        self.everything = self._histogram(np.arange(n))

    def base(self) -> float:
        return float(medians(self.group, self.target, np.zeros(len(self.target), np.int64), 1)[0])

    def _sampled(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that a tree is grown on, and the others."""
        share = self.options.row_fraction
        if share >= 1:
            return np.arange(len(self.target)), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h = (self.keys ^ np.uint32((number * 2654435761 + self.options.seed) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
        inside = h < np.uint32(share * 2**32)
        return np.flatnonzero(inside), np.flatnonzero(~inside)

    def _sign(self, residual: np.ndarray) -> None:
        """Bring signs, places and the counts over all rows up to date."""
        signs = (residual < 0).view(np.int8) - (residual > 0).view(np.int8)
        turned = np.flatnonzero(signs != self.signs)
        self.everything -= self._histogram(turned)
        slots, places = _fields(self.slots), _fields(self.places)
        for begin in range(0, len(turned), PIECE):
            some = turned[begin:begin + PIECE]
            by = (signs.take(some) - self.signs.take(some)).astype(np.int32)
            slots[some, :len(self.codes)] += (by * BINS).astype(np.uint16)[:, None]
            places[some, :len(self.cells)] += (by[:, None] * self.cells).astype(np.uint16)
        self.signs = signs
        self.everything += self._histogram(turned)

    def _histogram(self, rows: np.ndarray, features: np.ndarray | None = None) -> np.ndarray:
        """Rows and sums of gradient signs by feature (all, if not told) and bin."""
        n = len(self.codes)
        if len(rows) < FEW:
            slots = _fields(self.slots.take(rows))[:, :n]
            found = np.bincount(slots.ravel(), minlength=n * 3 * BINS).reshape(n, 3, BINS)
        else:
            wanted = set(range(n) if features is None else features.tolist())
            tables = [np.zeros(3 * cells if wanted.intersection(members) else 0, np.int64)
                      for cells, members in zip(self.cells, self.sets)]
            for begin in range(0, len(rows), PIECE):
                some = _fields(self.places.take(rows[begin:begin + PIECE]))
                for k, table in enumerate(tables):
                    if len(table):
                        table += np.bincount(some[:, k], minlength=len(table))
            found = np.zeros((n, 3, BINS), np.int64)
            for table, members in zip(tables, self.sets):
                for k, f in enumerate(members):
                    if f in wanted:
                        others = tuple(j + 1 for j in range(len(members)) if j != k)
                        by = table.reshape(3, *(self.sizes[m] for m in members)).sum(axis=others)
                        found[f, :, :self.sizes[f] - 1], found[f, :, MISSING] = by[:, :-1], by[:, -1]
        if features is not None:
            found = found[features]
        return np.stack([found.sum(axis=1), found[:, 2] - found[:, 0]])

    def _splits(self, found: np.ndarray) -> np.ndarray:
        """The best split of each node (gain, feature, bin, missing side, rows to the left): the largest gain, then the
        first in order of missing side, feature and bin."""
        o = self.options
        found = found.astype(np.float64)[:, None]
        used = np.flatnonzero(found[..., :MISSING].any(axis=(0, 1, 2, 3)))
        width = int(used[-1]) + 1 if len(used) else 1  # bins that no row is in cost nothing to leave out
        absent, whole = found[..., MISSING:], found[:, :, :, :1].sum(axis=4, keepdims=True)
        low = found[..., :width].cumsum(axis=4)
        if absent.any():
            low = np.concatenate([low, low + absent], axis=1)
        high = whole - low

        def worth(part: np.ndarray) -> np.ndarray:
            pull = np.abs(part[:, :, 1])
            pull -= o.l1
            np.maximum(pull, 0.0, out=pull)
            pull *= pull
            pull /= part[:, :, 0] + o.l2
            return pull

        gain = worth(low)
        gain += worth(high)
        gain -= worth(whole)
        gain[np.minimum(low[:, :, 0], high[:, :, 0]) < o.least_rows] = -np.inf
        flat = gain.reshape(len(found), -1)
        at, nodes = flat.argmax(axis=1), np.arange(len(found))
        side, feature, bin_ = np.unravel_index(at, gain.shape[1:])
        best = flat[nodes, at]
        return np.stack([np.where(np.isfinite(best), best, 0.0), feature, bin_, side, low[nodes, side, 0, feature, bin_]], axis=1)

    def _parted(self, feature: int, bin_: int, missing_left: bool, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that go left, and the others."""
        codes = self.codes[feature].take(rows)
        left = codes <= bin_
        if missing_left:
            left |= codes == MISSING
        return rows.take(np.flatnonzero(left)), rows.take(np.flatnonzero(~left))  # a mask as index is slower by far

    def _expand(self, nodes: list[_Node]) -> None:
        """Children of the nodes: the smaller ones are counted, in one exchange, the others are what is left."""
        parts = [self._parted(self.chosen[x.feature], x.bin, x.missing_left, x.rows) for x in nodes]
        smaller = [0 if 2 * x.n_left <= x.size else 1 for x in nodes]
        for node, part in zip(nodes, parts):
            node.children = _Node(part[0], node.n_left), _Node(part[1], node.size - node.n_left)

        def splits(counts: np.ndarray) -> np.ndarray:
            for node, s, found in zip(nodes, smaller, counts):
                node.children[s].found, node.children[1 - s].found = found, node.found - found
            return self._splits(np.stack([child.found for node in nodes for child in node.children]))

        told = self.group.lead(np.stack([self._histogram(p[s], self.chosen) for p, s in zip(parts, smaller)]), splits)
        for child, split in zip((child for node in nodes for child in node.children), told):
            child.split_by(split)

    def round(self, number: int, score: np.ndarray) -> Tree:
        """One tree for the residuals of ``score``, which it brings up to date."""
        o = self.options
        residual = self.target - score.astype(np.float32)
        n_features = len(self.codes)
        draw = np.random.default_rng([o.seed, number])
        self.chosen = np.sort(draw.permutation(n_features)[:max(1, round(o.feature_fraction * n_features))])
        self._sign(residual)
        rows, out = self._sampled(number)
        root = _Node(rows, 0)

        def splits(counts: np.ndarray) -> np.ndarray:
            root.found = counts
            return np.append(self._splits(counts[None])[0], counts[0, 0].sum())

        told = self.group.lead(self.everything[:, self.chosen] - self._histogram(out, self.chosen), splits)
        root.split_by(told)
        root.size = int(told[5])
        leaves = [root]
        split: set[int] = set()
        while len(leaves) < o.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i].gain)
            node = leaves[k]
            if not node.gain > 0:
                break
            if node.children is None:
                open_ = sorted((leaf for leaf in leaves if leaf.children is None and leaf.gain > 0), key=lambda x: -x.gain)
                # Where exchanges are cheap, large leaves are counted ahead only if they will probably be split.
                left = o.leaves - len(leaves)
                self._expand([x for i, x in enumerate(open_[:left]) if self.group.dear or i <= left // AHEAD_SHARE or x.size <= self.ahead])
            split.add(id(node))
            node.rows = None
            leaves[k:k + 1] = node.children
        lists: list[list] = [[], [], [], [], []]

        def write(node: _Node) -> int:
            if id(node) not in split:
                return -1 - next(i for i, leaf in enumerate(leaves) if leaf is node)
            at = len(lists[0])
            for values, v in zip(lists, (int(self.chosen[node.feature]), node.bin, node.missing_left, 0, 0)):
                values.append(v)
            lists[3][at], lists[4][at] = write(node.children[0]), write(node.children[1])
            return at

        write(root)
        values = o.learning_rate * _medians(self.group, [residual.take(leaf.rows) for leaf in leaves])
        for leaf, value in zip(leaves, values):
            score[leaf.rows] += value
        tree = Tree(*(np.array(v, t) for v, t in zip(lists, (np.int64, np.int64, bool, np.int64, np.int64))), values)
        self._add(tree, out, score)
        return tree

    def _add(self, tree: Tree, rows: np.ndarray, score: np.ndarray) -> None:
        """Add the tree's values to the scores of the rows."""
        todo = [(0 if len(tree.features) else -1, rows)]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                score[rows] += tree.values[-1 - at]
            elif len(rows):
                parts = self._parted(tree.features[at], tree.bins[at], tree.missing_left[at], rows)
                todo += zip((int(tree.left[at]), int(tree.right[at])), parts)


def bin_edges(rows: DataFrame, features: list[str], error: float = 1e-3) -> list[np.ndarray]:
    """Upper edges of each feature's bins: its distinct quantiles over all rows, in one pass. Missing values have none."""
    clean = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in features])
    shares = [(k + 1) / (BINS - 1) for k in range(BINS - 2)]
    found = clean.approxQuantile(features, shares, error)
    return [np.unique(np.array(values, np.float64)) for values in found]


def fit(rows: DataFrame, features: list[str], target: str, key: Column, options: Options = Options(),
        rows_a_task: int = ROWS_A_TASK, rows_a_process: int = ROWS_A_PROCESS) -> BoostedTrees:
    """Fit on rows with double ``features`` (NULL or NaN: missing) and a target; ``key`` tells rows apart for sampling."""
    spark = rows.sparkSession
    ship(spark)
    if options.leaves > 64:
        raise ValueError("a tree has 64 leaves at most")
    model = BoostedTrees(list(features), bin_edges(rows, features), 0.0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, targets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                body = model.codes(_matrix(batch.columns[2:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.num_rows], pa.int64()), *(pa.array([part.tobytes()], pa.binary()) for part in (keys, targets, body))],
                    names=["n", "keys", "targets", "codes"])

    plain = rows.where(F.col(target).isNotNull()).select(
        F.xxhash64(key).alias("_key"), F.col(target).cast("float").alias("_target"), *[F.col(c).cast("double") for c in features])
    stored = materialize(plain.mapInArrow(cut, "n long, keys binary, targets binary, codes binary"))  # a batch a row
    n = stored.agg(F.sum("n")).first()[0] or 0
    tasks, folder = _tasks(spark, n, rows_a_task)
    dealt = stored.coalesce(1) if tasks == 1 else stored.repartition(tasks)
    done = 0
    while done < options.rounds:
        until = min(done + ROUNDS_A_JOB, options.rounds)
        processes = max(1, min(_cores(spark), n // tasks // rows_a_process))
        found = dealt.mapInArrow(_job(model, done, until, tasks, processes, options, folder), TREE_SCHEMA, barrier=tasks > 1).collect()
        for r in sorted(found, key=lambda r: r.tree):
            if r.tree < 0:
                model.base = r["values"][0]
            else:
                model.trees.append(_tree(r))
        done = until
    release(spark, stored)
    return model


def _tasks(spark: SparkSession, n: int, rows_a_task: int) -> tuple[int, str | None]:
    """Number of training tasks, and the folder for their counts if ``spark.checkpoint.dir`` is a mounted one. With it
    every executor trains; without it, as few tasks as hold the rows, as an exchange takes a second."""
    least, slots = max(1, -(-n // rows_a_task)), spark.sparkContext.defaultParallelism
    many = min(max(least, min(_executors(spark), n // ROWS_WORTH_A_TASK)), slots)
    if many > 1 and (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local[")):
        folder = shared_folder(spark)
        if folder.startswith("file:"):
            dynamic = spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"  # there, a barrier is refused
            return (min(least, slots) if dynamic else many), re.sub("^file:/+", "/", folder)
    return min(least, slots), None


def _executors(spark: SparkSession) -> int:
    """Executors beside the driver; in a local session it is the one executor."""
    return max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)


def _cores(spark: SparkSession) -> int:
    """Cores of an executor; the driver is the one executor of a local session."""
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    told = spark.conf.get("spark.executor.cores", None) if executors else None
    return int(told) if told else max(1, spark.sparkContext.defaultParallelism // max(1, executors))


def _job(model: BoostedTrees, first: int, until: int, tasks: int, processes: int, options: Options,
         folder: str | None = None) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, targets, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros((len(model.features), 0), np.uint8)]
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(1, 4))):
                for held, kind, part in zip((keys, targets, codes), (np.int64, np.float32, np.uint8), row):
                    held.append(np.frombuffer(part.as_buffer(), kind))
                codes[-1] = codes[-1].reshape(len(model.features), -1)
        codes, keys, targets = np.concatenate(codes, axis=1), np.concatenate(keys), np.concatenate(targets)
        keys = (keys ^ (keys >> 32)).astype(np.uint32)
        most = options.leaves * max(1 << 8, 2 * BINS * len(codes))
        outer = _Group(tasks, folder)
        here = max(1, processes // outer.neighbours())
        group = _Processes(here, most, outer if tasks > 1 else None) if here > 1 else outer

        def grow(place: int) -> list[tuple[int, Tree]]:
            mine = slice(place * len(keys) // here, (place + 1) * len(keys) // here)
            part = np.ascontiguousarray(codes[:, mine])
            trainer = Trainer(group, part, targets[mine], keys[mine], options, AHEAD * tasks * processes)
            made: list[tuple[int, Tree]] = []
            base = model.base
            if not first:
                base = trainer.base()
                made.append((-1, Tree(*[np.zeros(0, np.int64)] * 5, np.array([base]))))
            score = model.score(part) if first else np.full(part.shape[1], base)
            for number in range(first, until):
                made.append((number, trainer.round(number, score)))
            return made

        made = group.run(grow) if here > 1 else grow(0)
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0:  # all tasks have the same trees
            yield _batch(made)

    return train


def _batch(made: list[tuple[int, Tree]]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in made], pa.int32()),
         *(pa.array([getattr(t, name).tolist() for _, t in made], kind) for name, kind in (
             ("features", ints), ("bins", ints), ("missing_left", pa.list_(pa.bool_())), ("left", ints), ("right", ints),
             ("values", pa.list_(pa.float64()))))],
        names=["tree", "features", "bins", "missing_left", "left", "right", "values"])


def _tree(r) -> Tree:
    return Tree(np.array(r.features, np.int64), np.array(r.bins, np.int64), np.array(r.missing_left, bool),
                np.array(r.left, np.int64), np.array(r.right, np.int64), np.array(r["values"], np.float64))


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    """Doubles, one row a column; NULL becomes NaN."""
    return np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])


# --- scoring -----------------------------------------------------------------------------------

def scores(model: BoostedTrees, inputs: list[Column]) -> Column:
    """The ensemble at a row's inputs, in trained order."""
    def score(*columns: pa.Array) -> pa.Array:
        return pa.array(model.score(model.codes(_matrix(columns))))

    return F.arrow_udf(score, "double")(*[c.cast("double") for c in inputs])


def responses(model: BoostedTrees, inputs: list[Column], feature: str, at: list[Column]) -> Column:
    """The ensemble at several values of one feature, the others as they are: an array in the order of ``at``.

    The row's step function is made once; a value more is one look-up.
    """
    place = model.features.index(feature)

    def answer(*columns: pa.Array) -> pa.Array:
        values = _matrix(columns)
        codes, prices = model.codes(values[:len(model.features)]), values[len(model.features):]
        absent = np.isnan(prices)
        asked = np.where(absent, MISSING, np.searchsorted(model.edges[place], prices, "left"))
        low = np.minimum(asked.min(axis=0), MISSING - 1)
        high = np.maximum(np.where(absent, 0, asked).max(axis=0), low)
        out = np.empty((codes.shape[1], len(asked)))
        for rows in _near(low):
            first = int(low[rows[0]])
            found = model.response(codes[:, rows], place, first, int(high[rows].max()))
            out[rows] = np.take_along_axis(found, np.where(absent, low, asked)[:, rows].T - first, axis=1)
        for k in np.flatnonzero(absent.any(axis=1)):
            some = np.flatnonzero(absent[k])
            missing = codes[:, some].copy()
            missing[place] = MISSING
            out[some, k] = model.score(missing)
        return _lists(np.full(len(out), len(asked)), pa.array(out.ravel()))

    return F.arrow_udf(answer, "array<double>")(*[c.cast("double") for c in [*inputs, *at]])


def _chunks(n: int, size: int | None = None) -> Iterator[slice]:
    size = size or SCORED
    for begin in range(0, n, size):
        yield slice(begin, min(n, begin + size))


def _near(low: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in chunks of nearly the same lowest bin, so that few bins beyond a row's own are answered."""
    order = np.argsort(low, kind="stable")
    for rows in _chunks(len(low)):
        yield order[rows]


def _lists(sizes: np.ndarray, items: pa.Array, valid: np.ndarray | None = None) -> pa.ListArray:
    ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, items, mask=None if valid is None else pa.array(~valid))


def price_steps(model: BoostedTrees, inputs: list[Column], feature: str, low: Column, high: Column) -> Column:
    """The step function of one feature between two of its values: an array of (upper, value), rising; the value holds
    up to and with ``upper``. Steps of one value are joined. NULL where a bound is missing or they are out of order."""
    place = model.features.index(feature)
    edges = model.edges[place]

    def steps(*columns: pa.Array) -> pa.Array:
        values = _matrix(columns)
        codes, bounds = model.codes(values[:-2]), values[-2:]
        valid = bounds[0] <= bounds[1]
        first, last = np.searchsorted(edges, bounds, "left")
        first, last = np.minimum(first, MISSING - 1), np.minimum(last, MISSING - 1)
        ends = np.append(edges, np.full(MISSING - len(edges), np.inf))
        sizes, parts = np.zeros(codes.shape[1], np.int64), []
        known = np.flatnonzero(valid)
        for near in _near(first[known]):
            rows = known[near]
            begin, end = int(first[rows[0]]), int(last[rows].max())
            found = model.response(codes[:, rows], place, begin, end)
            bins, at_end = np.arange(begin, end + 1)[None, :], last[rows][:, None]
            changes = np.append(found[:, 1:] != found[:, :-1], np.ones((len(rows), 1), bool), axis=1)
            keep = (bins >= first[rows][:, None]) & (bins <= at_end) & (changes | (bins == at_end))
            upper = np.where(bins == at_end, bounds[1][rows][:, None], ends[begin:end + 1][None, :])
            sizes[rows] = keep.sum(axis=1)
            parts.append((np.repeat(rows, sizes[rows]), upper[keep], found[keep]))
        parts = [np.concatenate(columns) for columns in zip(*parts)] or [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        order = np.argsort(parts[0], kind="stable")
        items = pa.StructArray.from_arrays([pa.array(parts[1][order]), pa.array(parts[2][order])], ["upper", "value"])
        return _lists(sizes, items, valid)

    return F.arrow_udf(steps, "array<struct<upper: double, value: double>>")(*[c.cast("double") for c in [*inputs, low, high]])


# --- stored models -----------------------------------------------------------------------------

def save(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    """Two small tables: inputs with their edges, and trees."""
    inputs = [(k, name, [float(e) for e in edges], float(model.base)) for k, (name, edges) in enumerate(zip(model.features, model.edges))]
    spark.createDataFrame(inputs, "place int, feature string, edges array<double>, base double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/inputs")
    trees = [(n, t.features.tolist(), t.bins.tolist(), t.missing_left.tolist(), t.left.tolist(), t.right.tolist(), t.values.tolist())
             for n, t in enumerate(model.trees)]
    spark.createDataFrame(trees, TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")


def load(spark: SparkSession, path: str) -> BoostedTrees:
    inputs = sorted(spark.read.parquet(f"{path}/inputs").collect(), key=lambda r: r.place)
    trees = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r.tree)
    return BoostedTrees([r.feature for r in inputs], [np.array(r.edges, np.float64) for r in inputs],
                        inputs[0].base, [_tree(r) for r in trees])
