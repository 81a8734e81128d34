"""Packing documents into sequences by bin completion.

Tokens are made once, in parallel; what is packed is the pieces' lengths. Any packing depends only on how many
pieces there are of each length, and there are at most ``capacity`` lengths, so the search works on a histogram of
bounded size however many documents there are, and its outcome is a list of patterns (the lengths in a sequence)
with multiplicities.

Bin completion: take the largest piece left and enumerate the undominated ways of filling the rest of its sequence (a
filling is dominated if one of its lengths, or two together, can give way to a single larger piece that is left).
Fillings are made one at a time: of up to three lengths beside a greedy core, first those without waste, then all
others; none is left out. A pattern is applied as often as the histogram allows, or once. The search goes depth first on one table of
pieces left, which a step changes and its undoing restores; a step keeps its pattern and those tried before it, so
memory is a few hundred bytes a step. A branch is pruned when its waste, with all left packed without any, would
not beat the incumbent. Best-fit decreasing gives the first incumbent, every better solution replaces it. The search
ends when the incumbent meets `lower_bound`, when nothing is left to try (then it is optimal), or after `NODES` steps,
which is its one limit.

Words are looked up many at a time: classes of the code points give the words' edges, a hash of its code points names a
word, and a table of hashes gives the ids; only words that a worker has not met go to the tokenizer. Two words would
have to share a 64-bit hash to be mixed up. Texts with characters outside the tables go to the tokenizer whole.

Back in Spark, pieces are numbered within their length (`numbered`, so one length may hold any share of the rows),
and a piece's number says which pattern slot is its own: a join with the table of slots, which is broadcast
(at most a few slots per length and pattern: bounded by the capacity, not by the input).

Edge cases: a null or empty text is one token (the end id). A text of exactly ``capacity`` tokens is one piece.
Repeated rows and null ids are documents like others. An empty table gives no rows. Extra columns are ignored. Long
texts are read a few MB at a time, cut at spaces, which are edges of words anyway.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import map_arrow, materialize, numbered
from pricetide.llm.textbuf import run_hashes, text_bytes

CAPACITY = 4096
NODES = 20_000
#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Bytes of text that are looked up at once, at about 150 bytes of memory each.
SPAN = 1 << 18
#: Words that the tokenizer gets at once; what it returns takes about a kilobyte a word.
ASKED = 1 << 11

Pattern = tuple[int, tuple[int, ...]]

#: Characters for which lower case, normal form and classes are those of the tokenizer file; texts with others are
#: encoded by the library as a whole.
_OTHERS = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")

_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASSES = ((_OTHER, _OTHERS), (_LETTER, re.compile(r"[^\W\d_]")), (_DIGIT, re.compile(r"\d")), (_MARK, re.compile(r"[^\s\w]|_")))
_LAST = 0x20ac
_CLASS = np.array([next((k for k, rule in _CLASSES if rule.match(chr(c))), _SPACE) for c in range(_LAST + 1)] + [_OTHER], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if _CLASS[c] != _OTHER else c for c in range(_LAST + 1)] + [0], np.uint32)

#: Letters that stay with an apostrophe before them.
_AFTER_APOSTROPHE = "s t re ve m ll d".split()


def _words(codes: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lowered code points: runs of letters, single digits, runs of marks; an
    apostrophe alone takes some letters after it."""
    edge = np.zeros(len(codes) + 1, bool)
    edge[at] = True
    step = np.ones(len(codes) + 1, bool)
    step[1:-1] = kinds[1:] != kinds[:-1]
    step |= edge
    single = kinds == _DIGIT
    inside = kinds != _SPACE
    starts = np.flatnonzero(inside & (step[:-1] | single))
    ends = np.flatnonzero(inside & (step[1:] | single)) + 1
    lone = np.flatnonzero((codes[starts] == 39) & (ends - starts == 1))
    lone = lone[lone + 1 < len(starts)]
    lone = lone[(starts[lone + 1] == ends[lone]) & (kinds[starts[lone + 1]] == _LETTER) & ~edge[ends[lone]]]
    if len(lone):
        room = ends[lone + 1] - starts[lone + 1]
        first, second = codes[ends[lone]], codes[np.minimum(ends[lone] + 1, len(codes) - 1)]
        taken = np.zeros(len(lone), np.int64)
        for letters in _AFTER_APOSTROPHE:
            fits = (first == ord(letters[0])) & (room >= len(letters))
            if len(letters) == 2:
                fits &= second == ord(letters[1])
            taken[fits] = len(letters)
        ends[lone] += taken
        starts[lone + 1] += taken
        full = starts < ends
        starts, ends = starts[full], ends[full]
    return starts, ends


class _Known:
    """Ids of words by the words' hashes: an open-addressed table, filled as words are met."""

    def __init__(self, slots: int):
        self.keys, self.places = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.mask, self.n = np.uint64(slots - 1), 0
        self.first, self.length, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the words; -1 where one is not known."""
        out = np.full(len(keys), -1, np.int32)
        slot = (keys & self.mask).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            here = self.keys[slot[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (here != 0)]
            slot[open_] = (slot[open_] + 1) & int(self.mask)
        return out

    def add(self, key: int, ids: list[int]) -> None:
        slot = key & int(self.mask)
        while self.keys[slot]:
            slot = (slot + 1) & int(self.mask)
        if self.n == len(self.first):
            self.first, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.keys[slot], self.places[slot] = key, self.n
        self.first[self.n], self.length[self.n] = self.used, len(ids)
        self.pool[self.used:self.used + len(ids)] = ids
        self.n, self.used = self.n + 1, self.used + len(ids)


class WordEncoder:
    """Ids of the word tokenizer file ``path``; every distinct word goes to the library's model once."""

    known: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.table = _Known(1 << (2 * REMEMBERED - 1).bit_length())

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def encode(self, text: str) -> bytes:
        body = np.frombuffer(text.encode(), np.uint8)
        return next(iter(self.encode_texts(body, np.array([0, len(body)])))).tobytes()

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_texts(self, body: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each of the texts that lie one after the other in ``body``."""
        first, n = 0, len(at) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + SPAN, "right")) - 1)
            if at[last] - at[first] <= SPAN:
                yield from self._span(body[at[first]:at[last]], at[first:last + 1] - at[first])
            else:
                yield self._long(body[at[first]:at[last]])
            first = last

    def _long(self, body: np.ndarray) -> np.ndarray:
        text = body.tobytes().decode("utf-8", "replace")
        if _OTHERS.search(text):
            return self._library(text)
        del text
        spaces, begin, made = np.flatnonzero(body == 32), 0, []
        while begin < len(body):
            k = int(np.searchsorted(spaces, begin + SPAN, "right"))
            end = int(spaces[k - 1]) if k and spaces[k - 1] > begin else int(spaces[k]) if k < len(spaces) else len(body)
            if len(body) - begin <= SPAN:
                end = len(body)
            made += self._span(body[begin:end], np.array([0, end - begin]))
            begin = end
        return np.concatenate(made)

    def _span(self, body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        try:
            text = body.tobytes().decode()
        except UnicodeDecodeError:
            parts = [body[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            text, at = "".join(parts), np.cumsum([0, *map(len, parts)])
        else:
            whole = np.zeros(len(body) + 1, np.int64)
            np.cumsum((body & 0xC0) != 0x80, out=whole[1:])
            at = whole[at]
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        known = np.minimum(raw, _LAST + 1)
        kinds, codes = _CLASS[known], _LOWER[known]
        strange = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(kinds == _OTHER, out=strange[1:])
        outside = strange[at[1:]] > strange[at[:-1]]
        for i in np.flatnonzero(outside).tolist():
            kinds[at[i]:at[i + 1]] = _SPACE
        starts, ends = _words(codes, at, kinds)
        number = self._numbers(codes, starts, ends)
        lengths = self.table.length[number]
        stop = np.cumsum(lengths)
        ids = self.table.pool[np.repeat(self.table.first[number] - stop + lengths, lengths) + np.arange(int(stop[-1]) if len(stop) else 0)]
        edges = np.concatenate([[0], stop])[np.searchsorted(starts, at)].tolist()
        return [self._library(text[at[i]:at[i + 1]]) if outside[i] else ids[a:b]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]

    def _numbers(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = run_hashes(codes, starts, ends)
        keys[keys == 0] = 1
        number = self.table.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            made, where = np.unique(keys[new], return_index=True)
            if self.table.n + len(made) > REMEMBERED:
                self.table = _Known(1 << (2 * max(REMEMBERED, len(keys)) - 1).bit_length())
                new = np.arange(len(keys))
                made, where = np.unique(keys, return_index=True)
            pick = new[where]
            for begin in range(0, len(pick), ASKED):
                some = pick[begin:begin + ASKED]
                words = [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[some].tolist(), ends[some].tolist())]
                found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
                for key, word in zip(made[begin:begin + ASKED].tolist(), found):
                    self.table.add(key, word.ids)
            number[new] = self.table.find(keys[new])
        return number


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(row, id, piece, start, length, ids_crc32): each document's ids and the end id, cut at ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = WordEncoder.of(path), array("I", [end_id]).tobytes()
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode_texts(*text_bytes(batch.column(1)))):
                total = len(ids) + 1
                for k, begin in enumerate(range(0, total, capacity)):
                    part = zlib.crc32(ids[begin:begin + capacity])
                    at.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(min(capacity, total - begin))
                    crc.append(zlib.crc32(end, part) if begin + capacity >= total else part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"])

    made = map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), cut,
                     f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("row", F.monotonically_increasing_id())


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by the pieces that can't share a sequence.

    For each k up to half the capacity, pieces above capacity - k take a sequence of their own and those above half
    one each; pieces of k and more must go into the rooms of the latter or into new sequences.
    """
    lengths = np.arange(len(counts))
    volume = np.concatenate([[0], np.cumsum(counts * lengths)])
    number = np.concatenate([[0], np.cumsum(counts)])
    half = capacity // 2
    best = -(-int(volume[-1]) // capacity)
    for k in range(1, half + 1):
        alone = number[-1] - number[capacity - k + 1]
        shared = number[capacity - k + 1] - number[half + 1]
        room = int(shared) * capacity - int(volume[capacity - k + 1] - volume[half + 1])
        rest = int(volume[half + 1] - volume[k]) - room
        best = max(best, int(alone + shared) + max(0, -(-rest // capacity)))
    return best


class _Left:
    """Pieces left by length."""

    def __init__(self, counts: np.ndarray):
        self.counts: list[int] = counts.tolist()
        self.lengths = np.flatnonzero(counts).tolist()  # those of which any are left, rising

    def change(self, pattern: tuple[int, ...], times: int) -> None:
        """Take the pattern ``times`` times, or put it back if that is negative."""
        for length in pattern:
            before = self.counts[length]
            self.counts[length] = after = before - times
            if after == 0:
                del self.lengths[bisect_right(self.lengths, length) - 1]
            elif before == 0:
                insort(self.lengths, length)

    def fitting(self, room: int, used: dict[int, int]) -> int:
        """The largest length up to ``room`` of which one is left beside those ``used``; 0 if there is none."""
        k = bisect_right(self.lengths, room) - 1
        while k >= 0:
            length = self.lengths[k]
            if self.counts[length] > used.get(length, 0):
                return length
            k -= 1
        return 0


def _count(lengths: tuple[int, ...] | list[int]) -> dict[int, int]:
    found: dict[int, int] = {}
    for x in lengths:
        found[x] = found.get(x, 0) + 1
    return found


def _dominated(left: _Left, filling: tuple[int, ...], waste: int, used: dict[int, int]) -> bool:
    """Whether a single piece that is left could take the place of one or two pieces of the filling."""
    distinct = sorted(set(filling))
    if waste and any(left.fitting(x + waste, used) > x for x in distinct):
        return True
    for i, x in enumerate(distinct):
        for y in distinct[i:]:
            if (x != y or filling.count(x) > 1) and left.fitting(x + y + waste, used) >= x + y:
                return True
    return False


def _near(left: _Left, room: int, used: dict[int, int], exact: bool) -> Iterator[tuple[int, ...] | None]:
    """Fillings of one, two and three lengths beside a greedy core: those without waste, or the others, pairs by rising
    waste. None at each step of the search for three."""
    core: list[int] = []
    taken = dict(used)
    while (x := left.fitting(room, taken)) and room > 3 * x:
        n = min(left.counts[x] - taken.get(x, 0), room // x - 2)
        core += [x] * n
        taken[x] = taken.get(x, 0) + n
        room -= n * x
    if (x == room) == exact:
        yield (*core, x) if x else tuple(core)
    if not x:
        return
    lengths = np.array(left.lengths)
    lengths = lengths[lengths <= room]

    def pairs(limit: int, top: int, before: tuple[int, ...], beside: dict[int, int]) -> Iterator[tuple[int, ...]]:
        firsts = lengths[(lengths < limit) & (lengths <= top)]
        if not len(firsts):
            return
        place = np.searchsorted(lengths, np.minimum(limit - firsts, firsts), "right") - 1
        fits = place >= 0
        firsts, seconds = firsts[fits], lengths[place[fits]]
        wasted = limit - firsts - seconds
        wanted = np.flatnonzero((wasted == 0) == exact)
        wanted = wanted[np.lexsort((-firsts[wanted], wasted[wanted]))]
        for a, b in zip(firsts[wanted].tolist(), seconds[wanted].tolist()):
            if left.counts[a] <= beside.get(a, 0):
                continue
            beside[a] = beside.get(a, 0) + 1
            b = left.fitting(b, beside)
            beside[a] -= 1
            if b:
                yield (*before, a, b)

    yield from pairs(room, room, tuple(core), dict(taken))
    for a in lengths[::-1].tolist():
        if left.counts[a] > taken.get(a, 0) and room > a:
            yield None
            yield from pairs(room - a, a, (*core, a), taken | {a: taken.get(a, 0) + 1})


def _all(left: _Left, room: int, used: dict[int, int]) -> Iterator[tuple[int, ...] | None]:
    """Every filling that nothing can be added to, larger lengths first; None at each step on the way."""
    chosen: list[int] = []
    limit = room
    while True:
        yield None
        x = left.fitting(min(room, limit), used)
        if x:
            chosen.append(x)
            used[x] = used.get(x, 0) + 1
            room, limit = room - x, x
            continue
        if not left.fitting(room, used):
            yield tuple(chosen)
        if not chosen:
            return
        x = chosen.pop()
        used[x] -= 1
        room, limit = room + x, x - 1


def _steps(left: _Left, top: int, capacity: int, spare: int) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """(times, pattern) of every undominated filling beside ``top`` that wastes no more than ``spare`` in all; None
    for a step of the enumeration."""
    room, seen = capacity - top, set()
    often: list[tuple[int, ...]] = []
    for source in (_near(left, room, {top: 1}, True), _near(left, room, {top: 1}, False), _all(left, room, {top: 1})):
        for filling in source:
            if filling is None:
                yield None
                continue
            filling = tuple(sorted(filling, reverse=True))
            waste = room - sum(filling)
            if waste > spare or filling in seen:
                continue
            seen.add(filling)
            pattern = (top, *filling)
            need = _count(pattern)
            if _dominated(left, filling, waste, need):
                continue
            times = min(left.counts[x] // n for x, n in need.items())
            if waste:
                times = min(times, spare // waste)
            if times > 1:
                often.append(pattern)
            yield times, pattern
    for pattern in often:
        yield 1, pattern


def _best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: each piece, the largest first, into the fullest sequence it fits."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        for room in sorted(r for r in rooms if r >= length):
            for pattern in list(rooms.get(room, ())):
                while n and (open_ := rooms.get(room, {}).get(pattern)):
                    per = min(room // length, n)
                    times = min(open_, n // per)
                    rooms[room][pattern] -= times
                    if not rooms[room][pattern]:
                        del rooms[room][pattern]
                    into = rooms.setdefault(room - per * length, {})
                    grown = (*pattern, *[length] * per)
                    into[grown] = into.get(grown, 0) + times
                    n -= times * per
        while n:
            per = min(capacity // length, n)
            times = n // per
            into = rooms.setdefault(capacity - per * length, {})
            into[(length,) * per] = into.get((length,) * per, 0) + times
            n -= times * per
    return [(times, pattern) for held in rooms.values() for pattern, times in held.items()]


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns (times, lengths) that pack every piece of the histogram into few sequences of ``capacity``."""
    start = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        start[length] += n
    full = [(int(start[capacity]), (capacity,))] if start[capacity] else []
    start[capacity] = 0
    volume = int((start * np.arange(capacity + 1)).sum())
    bound = lower_bound(start, capacity)
    best = _best_fit(start, capacity)
    best_n = sum(n for n, _ in best)
    left = _Left(start)
    made: list[tuple[int, tuple[int, ...], int, list]] = []  # times, pattern, waste, what was tried in its place before
    wasted = sequences = 0
    tried: list[tuple[int, tuple[int, ...]]] = []
    while best_n > bound and nodes > 0:
        nodes -= 1
        step = None
        if not left.lengths:
            best, best_n = [(times, pattern) for times, pattern, _, _ in made], sequences
        else:
            spare = (best_n - 1) * capacity - volume - wasted  # what may still be wasted to beat the incumbent
            if spare >= 0:
                for found in _steps(left, left.lengths[-1], capacity, spare):
                    if found is None:
                        nodes -= 1
                        if nodes <= 0:
                            break
                    elif found not in tried:
                        step = found
                        break
        if step is not None:
            times, pattern = step
            waste = times * (capacity - sum(pattern))
            left.change(pattern, times)
            made.append((times, pattern, waste, [*tried, step]))
            sequences, wasted, tried = sequences + times, wasted + waste, []
        elif nodes > 0:
            if not made:
                break  # all branches are tried
            times, pattern, waste, tried = made.pop()
            left.change(pattern, -times)
            sequences, wasted = sequences - times, wasted - waste
    return full + sorted(best, key=lambda p: (-p[1][0], p[1]))


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, sequence, place): pieces of a length numbered low to high-1 go to sequence, sequence+1, ..."""
    out, used, sequence = [], {}, 0
    for times, pattern in patterns:
        place = 0
        for length in pattern:
            low = used.get(length, 0)
            out.append((length, low, low + times, sequence, place))
            used[length] = low + times
            place += length
        sequence += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (tokens before it in its sequence)."""
    made = materialize(pieces(docs, path, capacity, end_id, id_col, text_col))
    counts = {int(k): int(n) for k, n in made.groupBy("length").count().collect()}  # capacity rows at most
    plan = slots(complete(counts, capacity, nodes))
    table = docs.sparkSession.createDataFrame(plan, "length long, low long, high long, first long, offset long")
    ranked = numbered(made, ["length"], "row", "rank", sum(counts.values()))
    # Slots of one length are ranges of ranks, so each piece meets exactly one.
    return ranked.join(F.broadcast(table), "length").filter("rank >= low and rank < high").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
