"""Quality rules: statistics of every text, and a decision list learned from labelled statistics.

`with_statistics` adds word, symbol, line and repetition counts to each document (numpy over Arrow batches, no
shuffle). `learn_rules` learns from labelled statistics by sequential covering: a rule is a conjunction of
thresholds, grown by information gain on two thirds of the rows (once from each feature) and pruned on the rest;
of those that are precise enough the one that rejects most is kept, the rows that it covers leave, and the next rule
is grown on what remains. `verdict` turns the ordered rules
into one Spark CASE expression, so applying them costs nothing beyond the statistics.

Learning runs on the driver over at most `TRAIN_ROWS` labelled ids, a dozen numbers each, chosen by hash of the
id; statistics and verdicts cover every row.

Edge cases: a null text has no words. A text without words has ratios of 0. Without labels, or with labels of one
class only, the list is empty and keeps everything that passes the base rules. Repeated labels of one id count
as the lowest. Null ids and null labels are never learned from. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import free_name, map_arrow, sampled
from pricetide.llm.textbuf import Words, mixed, slices

TRAIN_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_twice",
          "n_stops")

#: What rules may test: each a ratio of two counts (or a count), so that long and short texts compare.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "twice_share": ("n_twice", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*b"#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOPS = np.zeros(256, bool)
_STOPS[[*b".?!"]] = True
_BLANKS = b" \t\n\x0b\x0c\r"


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _counts(body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """`COUNTS` of each text of a slice."""
    words = Words(body, at, lower=False)
    h, first, text_of = words.hashes(), words.first, words.text_of
    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        begin = np.flatnonzero(text_of[2:] == text_of[:-2])
        window = mixed(h[begin] + h[begin + 1] * np.uint64(0x9E3779B97F4A7C15)
                       + h[begin + 2] * np.uint64(0xC2B2AE3D27D4EB4F)) + mixed(text_of[begin].astype(np.uint64))
        order = np.argsort(window)
        equal = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(begin), bool)
        twice[order[1:]] = equal
        twice[order[:-1]] |= equal
        for i in range(3):
            repeated[begin[twice] + i] = True
    adjacent = np.zeros(len(h), bool)
    adjacent[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    raw = body.tobytes()
    lines = np.zeros((words.n_texts, 2), np.int64)
    for i in range(words.n_texts):
        full = [x for x in raw[at[i]:at[i + 1]].split(b"\n") if x.strip(_BLANKS)]
        lines[i] = len(full), len(full) - len(set(full))
    return [words.counts, _per_text(words.inside & (body & 0xC0 != 0x80), at), _per_text(_SYMBOLS[body], at),
            lines[:, 1], _per_text(repeated, first), lines[:, 0], _per_text(_UPPER[body], at),
            _per_text(adjacent, first), _per_text(_STOPS[body], at)]


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) and `COUNTS`, named with ``prefix``; a column named like one of
    these, in any case, is replaced by it."""
    names = [f"{prefix}{c}" for c in COUNTS]
    taken = {name.lower() for name in names}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    text = free_name(docs, "text_read")
    wide = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    schema = wide.drop(text).schema
    for name in names:
        schema = schema.add(name, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.zeros(batch.num_rows, np.int64) for _ in COUNTS]
            for first, body, at in slices(batch.column(batch.num_columns - 1)):
                for out, values in zip(made, _counts(body, at)):
                    out[first:first + len(at) - 1] = values
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, made)],
                                             names=[*batch.schema.names[:-1], *names])

    return map_arrow(wide, count, schema)


def features(prefix: str = "") -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(prefix + b) > 0, F.col(prefix + a) / F.col(prefix + b)).otherwise(0.0)
    return {name: share(*parts) for name, parts in FEATURES.items()}


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or more than half of the words in repeated 3-word windows."""
    words = F.col(f"{prefix}n_words")
    return (words < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * words)


@dataclass(frozen=True)
class Rule:
    """Rejects where every test (feature, at_least, threshold) holds."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, at_least, threshold in self.tests:
            hit &= x[name] >= threshold if at_least else x[name] < threshold
        return hit

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, at_least, threshold in self.tests:
            out &= values[name] >= threshold if at_least else values[name] < threshold
        return out


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Midpoints between neighbouring distinct values, thinned evenly to ``most``."""
    u = np.unique(values)
    mids = (u[1:] + u[:-1]) / 2
    return mids if len(mids) <= most else mids[np.linspace(0, len(mids) - 1, most).astype(int)]


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int, first: tuple[str, bool]) -> Rule:
    """The conjunction whose tests each gain most information about ``bad`` rows among those still covered.

    The first test is the best one of the feature and direction ``first``.
    """
    tests: list[tuple[str, bool, float]] = []
    live = np.ones(len(bad), bool)
    while len(tests) < most_tests and (~bad[live]).any():
        p0, n0 = bad[live].sum(), live.sum()
        best = (1e-9, None)
        for name, values in x.items():
            if not tests and name != first[0]:
                continue
            here, is_bad = values[live], bad[live]
            order = np.argsort(here, kind="stable")
            ranked, worse = here[order], np.concatenate([[0], np.cumsum(is_bad[order])])
            for cut in _cuts(here):
                k = int(np.searchsorted(ranked, cut, "left"))
                for at_least, n, p in ((True, n0 - k, p0 - worse[k]), (False, k, worse[k])):
                    if p and n < n0 and (tests or at_least == first[1]):
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0]:
                            best = (gain, (name, at_least, float(cut)))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= Rule((best[1],)).covers(x)
    return Rule(tuple(tests))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule's tests with the best margin of bad over good rows on rows it was not grown on."""
    best, worth = rule, -2.0
    for k in range(1, len(rule.tests) + 1):
        shorter = Rule(rule.tests[:k])
        hit = shorter.covers(x)
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        score = (p - n) / (p + n) if p + n else -1.0
        if score > worth + 1e-9:
            best, worth = shorter, score
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, most_rules: int = 16,
                most_tests: int = 4, least_covered: int = 3, seed: int = 7) -> list[Rule]:
    """Ordered rules that reject ``bad`` rows; a rule stays if ``precision`` of what it covers is bad."""
    if not len(bad) or bad.all() or not bad.any():
        return []
    grown_on = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    live, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and bad[live & grown_on].any():
        part, rest = {k: v[live & grown_on] for k, v in x.items()}, live & ~grown_on
        pruned_on = {k: v[rest] for k, v in x.items()}
        best = (0, 0, None)
        for first in [(name, side) for name in x for side in (True, False)]:
            rule = _grow(part, bad[live & grown_on], most_tests, first)
            if rule.tests and bad[rest].any():
                rule = _prune(rule, pruned_on, bad[rest])
            hit = rule.covers(x) & live
            p, n = int((bad & hit).sum()), int(hit.sum())
            if rule.tests and p >= max(least_covered, precision * n) and (p, -n) > best[:2]:
                best = (p, -n, rule)
        if best[2] is None:
            break
        rules.append(best[2])
        live &= ~best[2].covers(x)
    return rules


def labelled_sample(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                    rows: int = TRAIN_ROWS, prefix: str = "") -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and badness of at most ``rows`` labelled documents that pass the base rules, chosen by hash of
    the id (rows that repeat an id each count)."""
    label = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(label_col).alias("_label"))
    label = sampled(label, [id_col], rows)
    picked = statistics.filter(~base_failed(prefix)).join(label, id_col).select(
        *[c.alias(n) for n, c in features(prefix).items()], "_label", F.col(id_col).alias("_id")).toPandas()
    picked = picked.sort_values(["_id", *FEATURES], ignore_index=True)
    return {n: picked[n].to_numpy(float) for n in FEATURES}, (picked["_label"] == 0).to_numpy(bool)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True where the list keeps: the first rule that covers a row rejects it, the default keeps."""
    values, out = features(prefix), None
    for rule in rules:
        out = F.when(rule.column(values), False) if out is None else out.when(rule.column(values), False)
    return F.lit(True) if out is None else out.otherwise(True)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass the base rules and the learned list, with their columns unchanged."""
    rules = learn_rules(*labelled_sample(
        with_statistics(docs.join(labels.select(id_col).distinct(), id_col, "left_semi"), text_col, keep=[id_col]),
        labels, id_col))
    prefix = "stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return with_statistics(docs, text_col, prefix).filter(~base_failed(prefix) & verdict(rules, prefix)).select(
        *docs.columns)
