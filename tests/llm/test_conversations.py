"""Conversation repair against plain Python: damage, faults, and a search over whole edit strings."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import conversations, queries

SMALLEST = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
COLUMNS = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    """{conv_id: [(turn, role, text)]} after damage; conversations that lost all rows stay, empty."""
    out = {}
    for conv, turn, role, text in rows:
        conv_rows = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        conv_rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_search(symbols):
    """(cost, edits) least in that order: all edit strings, kept per state as the least (cost, string)."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    made = lambda s: "a" if s == "u" else "u"

    def inserted(best):
        for _ in range(4):
            for s, (c, e) in list(best.items()):
                new = (c + 2, e + "I")
                if new < best.get(made(s), (1 << 60, "")):
                    best[made(s)] = new
        return best

    best = inserted({"": (0, "")})
    for must_go, initial, cut in symbols:
        after = {}
        for s, (c, e) in best.items():
            moves = [(s, c + 3, "D")]
            if not must_go:
                moves += [(made(s), c + 2 + cut, "R")] + ([(initial, c + cut, "K")] if (s, initial) in legal else [])
            for t, cost, edit in moves:
                if (cost, e + edit) < after.get(t, (1 << 60, "")):
                    after[t] = (cost, e + edit)
        best = inserted(after)
    return min(best[s] for s in best if s in ("", "a"))


def brute_report(rows):
    """The report of one conversation's rows, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, faults, symbols = set(), [], []
    for turn, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        symbols.append((fault in ("blank", "duplicate"), role[:1], int(fault == "truncated")))
    cost, audit = brute_search(symbols)
    lines, left, state = [], iter(rows), ""
    for edit in audit:
        if edit != "I":
            _, role, text = next(left)
        if edit in "IR":
            role = "assistant" if state == "u" else "user"
        if edit != "D":
            lines.append(f"{role}:{'' if edit == 'I' else text}")
            state = role[:1]
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reports(frame):
    got = frame.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in got}


def test_tables_agree_with_the_search_over_strings():
    rng = np.random.default_rng(5)
    kinds = [(True, "u", 0)] + [(False, i, c) for i in "suax" for c in (0, 1)]
    for block in (1, 3, 4):
        tables = conversations.Tables(block)
        cases = [list(c) for n in range(3) for c in itertools.product(range(9), repeat=n)]
        cases += [rng.integers(0, 9, int(rng.integers(3, 30))).tolist() for _ in range(400)]
        cost, edits = tables.solve(np.array([s + 1 for c in cases for s in c], np.int64), np.array([len(c) for c in cases]))
        for case, c, e in zip(cases, cost.tolist(), edits):
            assert (c, e) == brute_search([kinds[s] for s in case]), case
        assert len(tables.vectors) < 100  # few vectors occur, whatever the symbols


def test_all_edit_strings_of_short_conversations():
    """The search itself against every edit string with up to two insertions at each place."""
    kinds = [(True, "u", 0)] + [(False, i, c) for i in "suax" for c in (0, 1)]
    made = lambda s: "a" if s == "u" else "u"
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def score(case, edits):
        state, cost, row = "", 0, 0
        for e in edits:
            if e == "I":
                state, cost = made(state), cost + 2
                continue
            must_go, initial, cut = case[row]
            row += 1
            if e == "D":
                cost += 3
            elif must_go or (e == "K" and (state, initial) not in legal):
                return None
            else:
                state, cost = (initial, cost + cut) if e == "K" else (made(state), cost + 2 + cut)
        return (cost, edits) if state in ("", "a") else None

    for n in range(3):
        strings = ["".join(p) for p in itertools.product(*[[f"{'I' * i}{e}" for i in range(3) for e in "DKR"]] * n, ["", "I", "II"])]
        for case in itertools.product(kinds, repeat=n):
            assert brute_search(case) == min(s for s in (score(case, e) for e in strings) if s)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALLEST}/conversations.parquet").select(*COLUMNS.replace(" long", "").replace(
        " string", "").split(", ")).collect()]
    want = {c: brute_report(r) for c, r in brute_damage(rows).items()}
    assert reports(queries.op12_conversations(spark, SMALLEST)) == want


def awkward_rows():
    rng = np.random.default_rng(9)
    texts = ["Yes.", "No", "", None, " \t\n", "Why?! ", "a.b", "x" * 50_000 + " " * 30_000, "Ünï漢.", "!", "a\x0bb\x0c"]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "a", "s"]
    rows = []
    for conv in range(80):
        for turn in range(int(rng.integers(1, 12))):
            rows.append((conv, turn * int(rng.integers(1, 3)) * 100 + turn, roles[rng.integers(0, 9) if conv % 2 else rng.integers(0, 3)],
                         texts[rng.integers(0, 11)]))
    rows += [(900, 0, "user", "Yes."), (900, 0, "user", "Yes."), (900, None, "user", "Yes."), (900, None, "user", "Yes.")]
    rows += [(None, n, ("user", "assistant")[n % 2], f"{n}.") for n in range(30)] + [(None, None, None, None)]
    rows += [(901, None, "system", "A."), (902, -5, "assistant", "B."), (902, 2**40, "user", "C")]
    rows += [(903, n, "user", "Same.") for n in range(3000)]  # one conversation, a third of all rows and more
    return rows


def test_awkward_conversations(spark):
    rows = awkward_rows()
    clash = ("gone", "later", "digest", "kind", "blank", "cut", "audit", "part", "col", "n", "report")
    frame = spark.createDataFrame(rows, COLUMNS).repartition(7).withColumns({c: F.lit("extra") for c in clash})
    want = {c: brute_report(r) for c, r in brute_damage(rows).items()}
    damaged = conversations.damaged(frame)
    assert reports(conversations.digested(damaged, conversations.plan(damaged, "gone"), "gone")) == want
    undamaged = reports(conversations.digested(frame, conversations.plan(frame)))
    plain = {}
    for conv, turn, role, text in rows:
        plain.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert undamaged == {c: brute_report(r) for c, r in plain.items()}


def test_small_batches_and_long_conversations(spark):
    """Conversations over many Arrow batches give what they give in one."""
    rows = awkward_rows()
    frame = conversations.damaged(spark.createDataFrame(rows, COLUMNS))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = reports(conversations.digested(frame, conversations.plan(frame, "gone"), "gone"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {c: brute_report(r) for c, r in brute_damage(rows).items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Q?"), (1, 2, "user", "Q?"), (1, 3, "assistant", "A."), (2, 0, "user", "")]
    frame = spark.createDataFrame(rows, COLUMNS)
    planned = conversations.plan(frame)
    got = sorted(tuple(r) for r in conversations.repaired(frame, planned).collect())
    audit = {r.conv_id: r.audit for r in planned.collect()}
    assert audit == {1: "IKKDK", 2: "D"}
    assert got == [(1, 0, "user", "", "I"), (1, 1, "assistant", "Hi.", "K"), (1, 2, "user", "Q?", "K"), (1, 3, "assistant", "A.", "K")]


def test_empty_table(spark):
    frame = spark.createDataFrame([], COLUMNS)
    damaged = conversations.damaged(frame)
    assert conversations.digested(damaged, conversations.plan(damaged, "gone"), "gone").collect() == []
    assert conversations.repaired(frame, conversations.plan(frame)).collect() == []


def test_null_conversation_id_as_text(spark):
    frame = spark.createDataFrame([(None, 0, "user", "A."), ("n", 0, "user", "A."), ("", 0, "user", "A.")],
                                  COLUMNS.replace("conv_id long", "conv_id string"))
    got = reports(conversations.digested(frame, conversations.plan(frame)))
    assert len(got) == 3 and {v[2] for v in got.values()} == {0}
