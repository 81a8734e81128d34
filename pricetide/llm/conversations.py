"""Repair of conversations: the cheapest edits that leave the roles ``(s?(ua)+)?``.

Rows of a conversation, in the order of their turns, are kept, given another role, deleted, or get turns without text
before them. A row that is blank or repeats an earlier one must go. The search is a shortest path over four states
(nothing yet, after the system turn, after a user, after an assistant): for every place between rows a vector holds
what the rest costs from each state.

Block tables (the method of the four Russians): less their minimum, the vectors that can occur are few. For each of
them and for each block of `BLOCK` row symbols (ten symbols: role initial and truncation, must go, padding) a table
gives the vector before the block and what is added to the minimum. A conversation is read from its end, one look-up
a block, and only the vector at each block's right edge is kept. Then every block is expanded backward from that edge
by the table of single symbols, which gives the vector behind each row, and edits are read off forward: of those that
keep the cost, the one with the least initial comes first (Delete, Insert, Keep, Rerole), so that of all cheapest edit
strings the ASCII-least is found. Conversations of a batch go through all of this side by side in numpy.

Work on Spark: the first of equal rows is found by a grouped minimum of (conversation, role, text) digests with
partial sums, then joined to the rows, so copies within one conversation may be any share of the table. Light rows
without text are dealt by conversation, sorted and streamed; a conversation is held as one byte a row until its edits
are read off (these are one cell of the result). The texts are dealt once, sorted the same way behind their
conversation's edits, and streamed through the hash or into repaired rows; no text but the current row's batch is held.
A conversation's text hash is a chain, so its rows pass one task, whatever the method.

Edge cases: a null role or text counts as one space, which is no role's initial and a blank text. Null turns come
first; all turns null: no gaps. Rows of one turn stand by role and then by digest. A null conversation id is a
conversation of its own. Equal rows of one turn are the same row repeated: all but one are duplicates. Equal rows are
told by 128-bit digests of id, role and text. An empty table gives no rows; extra columns are ignored. Roles count by
their first character, case included.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import map_arrow
from pricetide.llm.textbuf import text_bytes

#: Row symbols that one table look-up covers.
BLOCK = 4

#: Costs of the edits; a truncated row that stays costs one more.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

#: White space as words are told apart by: space and the controls tab to carriage return.
WHITE = "\t\n\x0b\x0c\r "

# States: nothing yet, after the system turn, after a user, after an assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after a turn made up or given another role: a user's, but an assistant's after a user's.
_MADE = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: By role initial (s, u, a, any other) and state: the state after keeping the row, -1 where that is not allowed.
_KEPT = ((_SYSTEM, -1, -1, -1), (_USER, _USER, -1, _USER), (-1, -1, _ASSISTANT, -1), (-1, -1, -1, -1))

_PADDING, _GONE, _FIRST_KEPT, _SYMBOLS = 0, 1, 2, 10

#: For each role initial as a byte, its number in `_KEPT`.
_INITIALS = {"s": 0, "u": 1, "a": 2}


def _closed(raw: list[int]) -> tuple[int, ...]:
    """Costs with any number of inserted turns before what comes next."""
    found = list(raw)
    for _ in range(4):
        found = [min(f, INSERT + found[_MADE[s]]) for s, f in enumerate(found)]
    return tuple(found)


def _edits(symbol: int, after: tuple[int, ...]) -> list[list[tuple[str, int, int]]]:
    """For each state the row's edits but insertion: (initial, cost with what follows, state after)."""
    if symbol == _PADDING:
        return [[("", after[s], s)] for s in range(4)]
    out = []
    kind, cut = divmod(symbol - _FIRST_KEPT, 2)
    for s in range(4):
        edits = [("D", DELETE + after[s], s)]
        if symbol != _GONE:
            if _KEPT[kind][s] >= 0:
                edits.append(("K", TRUNCATED * cut + after[_KEPT[kind][s]], _KEPT[kind][s]))
            edits.append(("R", REROLE + TRUNCATED * cut + after[_MADE[s]], _MADE[s]))
        out.append(edits)
    return out


class Tables:
    """Transitions of normalised cost vectors for single symbols and for every block, and the edits they stand for."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = _closed([0, 1 << 20, 1 << 20, 0])
        number, vectors = {end: 0}, [end]
        step, add = [], []
        for vector in vectors:  # grows while it is read: every vector that can occur
            step.append([])
            add.append([])
            for symbol in range(_SYMBOLS):
                before = _closed([min(cost for _, cost, _ in edits) for edits in _edits(symbol, vector)])
                least = min(before)
                normal = tuple(f - least for f in before)
                if normal not in number:
                    number[normal] = len(vectors)
                    vectors.append(normal)
                step[-1].append(number[normal])
                add[-1].append(least)
        self.vectors = np.array(vectors, np.int64)
        self.step, self.add = np.array(step, np.int32).T.copy(), np.array(add, np.int32).T.copy()  # [symbol, vector]
        self.block_step, self.block_add = np.arange(len(vectors), dtype=np.int32)[None], np.zeros((1, len(vectors)), np.int32)
        for _ in range(block):  # a symbol more in front
            inner = self.block_step
            self.block_add = (self.block_add[None] + self.add[:, inner]).reshape(-1, len(vectors))
            self.block_step = self.step[:, inner].reshape(-1, len(vectors))
        strings: dict[str, int] = {}
        self.edit = np.zeros((_SYMBOLS, len(vectors), 4), np.int32)
        self.state = np.zeros((_SYMBOLS, len(vectors), 4), np.int32)
        for symbol in range(_SYMBOLS):
            for v, after in enumerate(vectors):
                edits = _edits(symbol, after)
                before = _closed([min(cost for _, cost, _ in e) for e in edits])
                for s in range(4):
                    text, now = "", s
                    while True:
                        options = {i: (n, t) for i, n, t in edits[now]}
                        options["I"] = (INSERT + before[_MADE[now]], _MADE[now])
                        if symbol == _PADDING:
                            del options["I"]  # insertions go before rows and at the end
                        chosen = min(i for i, (n, _) in options.items() if n == before[now])
                        text, now = text + chosen, options[chosen][1]
                        if chosen != "I":
                            break
                    self.edit[symbol, v, s] = strings.setdefault(text, len(strings))
                    self.state[symbol, v, s] = now
        self.strings = np.array(list(strings), "S")
        self.ends = [b"", b"II", b"I", b""]

    def solve(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Costs and edit strings of conversations whose rows' symbols stand one after the other."""
        t = self.block
        blocks = -(-counts // t)
        first = np.cumsum(blocks) - blocks
        padded = np.zeros((int(blocks.sum()), t), np.int64)
        begin = np.cumsum(counts) - counts
        shift = first * t + blocks * t - counts - begin  # padding stands in front
        padded.ravel()[np.arange(len(symbols)) + np.repeat(shift, counts)] = symbols
        codes = padded @ _SYMBOLS ** np.arange(t - 1, -1, -1)
        order = np.argsort(-blocks, kind="stable")
        longest = blocks[order]
        vector, cost = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.int64)
        right = np.zeros((len(codes), t), np.int32)
        for k in range(int(longest[0]) if len(longest) else 0):
            some = order[:int(np.searchsorted(-longest, -k, "left"))]  # those with more than k blocks
            at = first[some] + blocks[some] - 1 - k
            v = vector[some]
            right[at, t - 1] = v
            cost[some] += self.block_add[codes[at], v]
            vector[some] = self.block_step[codes[at], v]
        cost += self.vectors[vector, _START]
        for j in range(t - 1, 0, -1):  # every block at once, backward from its right edge
            right[:, j - 1] = self.step[padded[:, j], right[:, j]]
        state, edits = np.zeros(len(counts), np.int32), np.zeros((len(codes), t), np.int32)
        for k in range(int(longest[0]) if len(longest) else 0):
            some = order[:int(np.searchsorted(-longest, -k, "left"))]
            at = first[some] + k
            s = state[some]
            for j in range(t):
                edits[at, j] = self.edit[padded[at, j], right[at, j], s]
                s = self.state[padded[at, j], right[at, j], s]
            state[some] = s
        texts = []
        for a, n, s in zip(first.tolist(), blocks.tolist(), state.tolist()):
            made = self.strings[edits[a:a + n].ravel()].tobytes().replace(b"\0", b"")
            texts.append((made + self.ends[s]).decode("ascii"))
        return cost, texts


@functools.cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn``; a dropped row stays with ``gone`` true.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it and 4 makes it
    the user's. Nulls count as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.pmod(F.crc32(key), F.lit(20))
    words = F.coalesce(F.col(text).cast("string"), space)
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role).cast("string"), space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(words, ".!?", "")).otherwise(words).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("col")


def _rows(df: DataFrame, gone: str | None) -> DataFrame:
    """conv_id, turn, role, text, gone and what the light stream needs: symbol parts, digest, blank."""
    mark = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    space = F.lit(" ")
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                     F.coalesce(F.col("text").cast("string"), space).alias("text"), mark.alias("gone"))
    name = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length(name), F.octet_length("role"), name, F.col("role"), F.col("text"))))
    ends = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.withColumns({"digest": digest, "kind": kind.cast("byte"), "blank": ends == "",
                             "cut": ~ends.isin(".", "!", "?")})


def plan(df: DataFrame, gone: str | None = None) -> DataFrame:
    """Per conversation: gaps, counts of blank, duplicate, truncated and illegal, the cost and the edits.

    ``df`` has conv_id, turn, role and text. Rows for which the column ``gone`` is true only name their conversation.
    """
    rows = _rows(df, gone)
    light = rows.select("conv_id", "turn", "role", "digest", "kind", "blank", "cut", "gone")
    repeated = light.where("NOT gone AND NOT blank").groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("first_null"), F.min("turn").alias("first_turn")
    ).where("n > 1").select("digest", "first_null", "first_turn")
    later = F.when(F.col("first_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    light = light.join(repeated, "digest", "left").withColumn("later", F.coalesce(later, F.lit(False)))
    ordered = light.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "digest").select(
        "conv_id", "turn", "digest", "kind", "blank", "cut", "gone", "later")
    kind = df.schema["conv_id"].dataType.simpleString()
    return map_arrow(ordered, _planned, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, "
                                        "illegal long, cost long, audit string")


_SUMS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task, sorted; of a conversation that goes on only symbols and sums are held."""
    held: dict | None = None
    previous = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0)
        starts = _changes(ids)
        goes_on = held is not None and _same(held["id"], ids[0])
        if not goes_on:
            previous = None
        conv = np.cumsum(starts) - 1
        flag = lambda k: batch.column(k).to_numpy(zero_copy_only=False).astype(bool)
        alive = np.flatnonzero(~flag(6))
        row = conv[alive]
        null = np.asarray(batch.column(1).is_null())[alive]
        turn = pc.fill_null(batch.column(1), 0).to_numpy()[alive]
        digest = text_bytes(batch.column(2))[0].reshape(-1, 16).view(np.uint64)[alive]
        kind = batch.column(3).to_numpy()[alive].astype(np.int64)
        blank, cut, later = flag(4)[alive], flag(5)[alive], flag(7)[alive]
        if len(alive):
            before = {"row": row, "null": null, "turn": turn, "digest": digest, "kind": kind}
            # The row before each, which for the first is the last one of the conversation in the batch before.
            last = {k: np.roll(v, 1, axis=0) for k, v in before.items()}
            last["row"][0] = -1
            if previous is not None and row[0] == 0:
                for k, v in previous.items():
                    last[k][0] = v
                last["row"][0] = 0
            follows = last["row"] == row
            same_turn = follows & (last["null"] == null) & (last["turn"] == turn)
            duplicate = ~blank & (later | (same_turn & (last["digest"] == digest).all(axis=1)))
            illegal = follows & ~_LEGAL[last["kind"], kind]
            new_turn = ~null & ~(same_turn & follows)
            truncated = cut & ~blank & ~duplicate
            symbol = np.where(blank | duplicate, _GONE, _FIRST_KEPT + 2 * kind + truncated).astype(np.int8)
            previous = {k: v[-1] for k, v in before.items() if k != "row"} if row[-1] == conv[-1] else (
                None if conv[-1] > 0 or not goes_on else previous)
        else:
            blank = duplicate = truncated = illegal = new_turn = np.zeros(0, bool)
            symbol = np.zeros(0, np.int8)
            previous = previous if goes_on and conv[-1] == 0 else None
        total = int(conv[-1]) + 1
        count = lambda which: np.bincount(row[which], minlength=total)
        sums = np.stack([np.bincount(row, minlength=total)] + [count(w) for w in (blank, duplicate, truncated, illegal, new_turn)], axis=1)
        low, high = np.full(total, np.iinfo(np.int64).max), np.full(total, np.iinfo(np.int64).min)
        np.minimum.at(low, row[~null], turn[~null])
        np.maximum.at(high, row[~null], turn[~null])
        first = np.flatnonzero(starts)
        found = {"ids": ids.take(pa.array(first)), "sums": sums, "low": low, "high": high,
                 "symbols": np.split(symbol, np.searchsorted(row, np.arange(1, total)))}
        if goes_on:
            held["symbols"].append(found["symbols"][0])
            held["sums"] = held["sums"] + sums[0]
            held["low"], held["high"] = min(held["low"], low[0]), max(held["high"], high[0])
        elif held is not None:
            yield _solved([held])
            held = None
        at = 1 if goes_on else 0
        if total > at:
            done = [held] if goes_on else []
            done += [_one(found, k) for k in range(at, total - 1)]
            if done:
                yield _solved(done)
            held = _one(found, total - 1)
    if held is not None:
        yield _solved([held])


def _one(found: dict, k: int) -> dict:
    return {"id": found["ids"][k], "ids": found["ids"].slice(k, 1), "symbols": [found["symbols"][k]], "sums": found["sums"][k],
            "low": int(found["low"][k]), "high": int(found["high"][k])}


def _changes(ids: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; true for the first. Nulls are equal."""
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    differ = np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
    return np.concatenate([[True], differ.astype(bool)])


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _solved(done: list[dict]) -> pa.RecordBatch:
    symbols = [s for d in done for s in d["symbols"]]
    sums = np.stack([d["sums"] for d in done]).astype(np.int64)
    cost, texts = tables().solve(np.concatenate(symbols).astype(np.int64), sums[:, 0])
    turns = sums[:, 5]
    gaps = [d["high"] - d["low"] + 1 - int(t) if t else 0 for d, t in zip(done, turns)]
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([d["ids"] for d in done]), pa.array(gaps, pa.int64()), *(pa.array(sums[:, k]) for k in range(1, 5)),
         pa.array(cost), pa.array(texts, pa.string())],
        names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


class _Repair:
    """Applies a conversation's edits to its rows as they come: gives (role, text, edit) of every turn that is left."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.row = audit, 0, _START, 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _MADE[self.state]
            yield _ROLE[self.state], "", "I"

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEPT[_INITIALS[role[:1]]][self.state]
            yield role, text, "K"
        elif edit == "R":
            self.state = _MADE[self.state]
            yield _ROLE[self.state], text, "R"

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_REPORT_TYPES = dict.fromkeys(_REPORT[:-1], "long") | {"audit": "string"}


def _with_texts(df: DataFrame, planned: DataFrame, gone: str | None) -> DataFrame:
    """A conversation's plan and texts in one task: the plan first, then the rows in order."""
    report = F.struct(*_REPORT)
    fields = ", ".join(f"{k}: {v}" for k, v in _REPORT_TYPES.items()).replace("long", "bigint")
    heads = planned.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                           F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), report.alias("report"))
    rows = _rows(df, gone).where("NOT gone").select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text",
                                                    F.lit(None).cast(f"struct<{fields}>").alias("report"))
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "part", "role", "text", "report")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, object]]:
    """('start', id, plan), ('turn', id, (role, text, edit)) and ('end', id, plan) of the conversations of one task."""
    repair = name = report = None
    for batch in batches:
        for conv, part, role, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            if part == 0:
                if repair is not None:
                    for turn in repair.end():
                        yield "turn", name, turn
                    yield "end", name, report
                repair, name, report = _Repair(found["audit"]), conv, found
                yield "start", name, report
            else:
                for turn in repair.take(role, text):
                    yield "turn", name, turn
    if repair is not None:
        for turn in repair.end():
            yield "turn", name, turn
        yield "end", name, report


class _Table:
    """Rows gathered into batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types, self.rows, self.size = names, types, [], 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """Whether the batch is full."""
        self.rows.append(row)
        self.size += size
        return len(self.rows) >= 10_000 or self.size > 1 << 22

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(self.names)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], names=self.names)


def _id_type(df: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repaired(df: DataFrame, planned: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, position, role, text, edit): the turns that are left, from 0, with the edit each comes from."""
    kind, arrow = _id_type(df)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Table(["conv_id", "position", "role", "text", "edit"], [arrow, pa.int64(), *[pa.string()] * 3])
        position = 0
        for event, name, turn in _streamed(batches):
            if event == "start":
                position = 0
            elif event == "turn":
                if out.add((name, position, *turn), len(turn[1])):
                    yield out.batch()
                position += 1
        yield out.batch()

    return map_arrow(_with_texts(df, planned, gone), rows, f"conv_id {kind}, position long, role string, text string, edit string")


def digested(df: DataFrame, planned: DataFrame, gone: str | None = None) -> DataFrame:
    """The plan with ``repaired_sha256``, the hash of the repaired turns as ``role:text`` lines."""
    kind, arrow = _id_type(df)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Table(["conv_id", *_REPORT, "repaired_sha256"], [arrow, *[pa.int64()] * (len(_REPORT) - 1), pa.string(), pa.string()])
        chain, first = hashlib.sha256(), True
        for event, name, found in _streamed(batches):
            if event == "start":
                chain, first = hashlib.sha256(), True
            elif event == "turn":
                chain.update(f"{'' if first else chr(10)}{found[0]}:{found[1]}".encode())
                first = False
            elif out.add((name, *(found[k] for k in _REPORT), chain.hexdigest()), len(found["audit"])):
                yield out.batch()
        yield out.batch()

    fields = ", ".join(f"{k} {v}" for k, v in _REPORT_TYPES.items())
    return map_arrow(_with_texts(df, planned, gone), hashes, f"conv_id {kind}, {fields}, repaired_sha256 string")
