"""A toxicity classifier with counterfactual regularisation.

A text's features are its distinct words and their beginnings (3 to 6 bytes), hashed. The weights are a logistic
regression on the labelled rows with one more penalty: in labelled sentences that mention a group, the mention is
swapped for every other one of its kind and number, and the squared change of the score is added to the loss. A group's name
that happens to stand in many toxic examples so gets no weight of its own, and neutral mentions are not flagged.

Learning: Spark counts each feature by label over a sample of at most `TRAIN_ROWS` labelled rows (by hash of
the id) and ranks them; the driver gets the best `VOCABULARY` features and the sample in terms of these, packed by the
tasks as 32-bit numbers.
Scoring covers every row and whole texts, with numpy over Arrow batches and no shuffle.

Edge cases: a null or empty text has no features and scores the model's base rate. Without labels of both classes
the score is the share of toxic labels (0 without any). Repeated labels of an id count as the highest. Null ids and
labels are never learned from. Extra columns are kept; those named like a result column,
in any case, are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import free_name, map_arrow, materialize, sampled
from pricetide.llm.textbuf import punctuated, slices, word_hash

TRAIN_ROWS = 20_000
VOCABULARY = 4_096
PAIRS = 20_000
#: Entries of the training lists that are added up at once.
ENTRIES = 1 << 18
PREFIXES = (None, 3, 4, 5, 6)
#: Chi-square of a feature against the labels below which it counts as noise.
STRENGTH = 15.0

#: Group mentions by language (words as they stand in a text, lower case), in sets of one kind and number: a mention
#: is swapped for the others of its set, so that the sentence stays one.
IDENTITY_TERMS = {
    "en": (
        ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
        ("black", "white", "asian", "latino", "hispanic", "african", "arab"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
        ("muslim", "christian", "jewish", "jew", "hindu", "buddhist", "sikh", "atheist"),
        ("gay", "lesbian", "bisexual", "transgender", "straight"), ("gays", "lesbians", "heterosexuals"),
        ("immigrants", "refugees", "migrants", "foreigners"), ("immigrant", "refugee", "migrant", "foreigner"),
        ("disabled", "deaf", "blind", "autistic"), ("elderly", "young"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "atheisten"),
        ("muslim", "christ", "jude", "atheist"), ("schwule", "lesben"), ("flüchtlinge", "ausländer", "einwanderer"),
        ("behinderte", "gehörlose", "blinde"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"),
        ("musulmans", "chrétiens", "juifs", "athées"), ("musulman", "chrétien", "juif", "athée"),
        ("homosexuels", "lesbiennes"), ("immigrés", "réfugiés", "étrangers"), ("handicapés", "sourds", "aveugles"),
    ),
    "es": (
        ("mujeres", "hombres", "chicas", "chicos"), ("mujer", "hombre", "chica", "chico"),
        ("musulmanes", "cristianos", "judíos", "ateos"), ("musulmán", "cristiano", "judío", "ateo"),
        ("homosexuales", "lesbianas"), ("inmigrantes", "refugiados", "extranjeros"), ("discapacitados", "sordos", "ciegos"),
    ),
}


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """True for the rows whose labels must not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def text_features(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct feature of each text of a slice."""
    words = punctuated(body, at)
    texts, found = [], []
    for prefix in PREFIXES:
        h = words.hashes(prefix)
        here = h != 0
        texts.append(words.text_of[here])
        found.append(h[here])
    text, feature = np.concatenate(texts), np.concatenate(found)
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    return text[new], feature[new]


def _feature_lists(column) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, body, at in slices(column):
        text, feature = text_features(body, at)
        out += np.split(feature.view(np.int64), np.searchsorted(text, np.arange(1, len(at) - 1)))
    return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


_OTHERS = {lang: {term: [t for t in terms if t != term] for terms in sets for term in terms}
           for lang, sets in IDENTITY_TERMS.items()}
_MENTION = {lang: re.compile(rf"\b(?:{'|'.join(others)})\b") for lang, others in _OTHERS.items()}


def _swapped(text: str) -> Iterator[tuple[str, str]]:
    """(sentence, the sentence with one group mention swapped) for every mention and every other term of its set."""
    text = text.lower()
    for lang, mention in _MENTION.items():
        if mention.search(text):
            for sentence in re.split(r"[.!?\n]", text):
                for term in dict.fromkeys(mention.findall(sentence)):
                    for other in _OTHERS[lang][term]:
                        yield sentence, re.sub(rf"\b{term}\b", other, sentence)


def _as_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_feature_lists(batch.column(1)))],
                                         names=["toxic", "features"])


def _as_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [p for text in batch.column(1).to_pylist() for p in _swapped(text or "")]
        if pairs:
            own, other = (_feature_lists(pa.array(side)) for side in zip(*pairs))
            yield pa.RecordBatch.from_arrays([_lists(own), _lists(other)], names=["own", "other"])


@dataclass(frozen=True)
class Model:
    """Sorted features (as unsigned 64-bit), their weights, and the score without any."""

    features: np.ndarray
    weights: np.ndarray
    base: float

    def scores(self, column) -> np.ndarray:
        out = np.full(len(column), self.base)
        if len(self.features):
            likely = np.zeros(1 << 20, bool)
            likely[self.features >> np.uint64(44)] = True
            for first, body, at in slices(column):
                words = punctuated(body, at)
                hits = []
                for prefix in PREFIXES:
                    h = words.hashes(prefix)
                    maybe = np.flatnonzero(likely[h >> np.uint64(44)])
                    place = np.minimum(np.searchsorted(self.features, h[maybe]), len(self.features) - 1)
                    sure = self.features[place] == h[maybe]
                    hits.append(words.text_of[maybe[sure]] * len(self.features) + place[sure])
                seen = np.unique(np.concatenate(hits))
                out[first:first + len(at) - 1] += np.bincount(
                    seen // len(self.features), self.weights[seen % len(self.features)], len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _entries(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(list, number) of every number in the lists."""
    row = np.repeat(np.arange(len(lists), dtype=np.int32), list(map(len, lists)))
    return row, np.concatenate([*lists, np.zeros(0, np.int32)], dtype=np.int32, casting="unsafe")


def _added(to: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sums of ``values[of]`` by ``to``, over some entries at a time."""
    out = np.zeros(n)
    for at in range(0, len(to), ENTRIES):
        out += np.bincount(to[at:at + ENTRIES], values[of[at:at + ENTRIES]], n)
    return out


def fit(lists: list[np.ndarray], toxic: np.ndarray, own: list[np.ndarray], other: list[np.ndarray], n: int,
        ridge: float = 2e-5, fairness: float = 1.0, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights of ``n`` features and the base: logistic loss, ridge, and the squared change under swaps (Adam)."""
    row, col = _entries(lists)
    own_row, own_col = _entries(own)
    other_row, other_col = _entries(other)
    w, share = np.zeros(n + 1), np.clip(toxic.mean(), 1e-3, 1 - 1e-3)
    w[n] = np.log(share / (1 - share))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = w[n] + _added(row, w, col, len(lists))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) / len(lists)
        g = np.append(_added(col, error, row, n) + ridge * w[:n], error.sum())
        if len(own):
            change = _added(other_row, w, other_col, len(own)) - _added(own_row, w, own_col, len(own))
            g[:n] += 2 * fairness / len(own) * (_added(other_col, change, other_row, n) - _added(own_col, change, own_row, n))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY,
          fairness: float = 1.0) -> Model:
    """A model of the labelled rows that are not `held_out`."""
    sample = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
        id_col).agg(F.max(label_col).cast("double").alias("toxic"))
    sample = sampled(sample, [id_col], rows)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), id_col).select("toxic", "text")  # at most ``rows`` ids and labels
    seen = materialize(map_arrow(texts, _as_features, "toxic double, features array<long>"))
    totals = seen.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    bad, n = totals[0] or 0.0, totals[1]
    none = np.zeros(0, np.uint64)
    if not 0 < bad < n:
        share = min(max(bad / max(n, 1), 1e-9), 1 - 1e-9)
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))))
    ranked = seen.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("k")).filter(f"k >= {max(2, min(5, n // 100))}")
    expected = F.col("k") * F.lit(bad / n)
    strength = (F.col("a") - expected) ** 2 / (expected * (1 - F.lit(bad / n)))
    best = [r[0] for r in ranked.withColumn("strength", strength).filter(F.col("strength") >= STRENGTH).orderBy(
        F.desc("strength"), "feature").select("feature").limit(vocabulary).collect()]
    named = {word_hash(t, p) for others in _OTHERS.values() for t in others for p in PREFIXES} - {0}
    features = np.unique(np.concatenate([np.array(best, np.int64).view(np.uint64), np.array(sorted(named), np.uint64)]))
    held = in_terms(seen.select("features", "toxic"), features, 1).toPandas()
    pairs = map_arrow(texts, _as_pairs, "own array<long>, other array<long>").distinct()
    pairs = in_terms(sampled(pairs, ["own", "other"], PAIRS), features, 2).toPandas()
    lists = lambda column: [np.frombuffer(x, np.int32) for x in column]
    weights, base = fit(lists(held["features"]), held["toxic"].to_numpy(float), lists(pairs["own"]), lists(pairs["other"]),
                        len(features), fairness=fairness)
    return Model(features, weights, base)


def in_terms(frame: DataFrame, features: np.ndarray, lists: int) -> DataFrame:
    """``frame`` with its first ``lists`` columns, lists of features, as the places of these in ``features``.

    Places are packed as 32-bit numbers, and features that are not there are left out, in the tasks: the driver gets a
    few bytes a feature and no object for each.
    """
    names = frame.columns
    schema = ", ".join(f"{c} binary" if i < lists else f"{c} {frame.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def packed(column) -> pa.Array:
        values = column.flatten().to_numpy().view(np.uint64)
        place = np.minimum(np.searchsorted(features, values), len(features) - 1)
        kept = features[place] == values
        ends = np.concatenate([[0], np.cumsum(kept)])[np.cumsum([0, *column.value_lengths().to_pylist()])]
        body = place[kept].astype(np.int32)
        return pa.array([body[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [packed(c) if i < lists else c for i, c in enumerate(batch.columns)], names=names)

    return map_arrow(frame, run, schema)


def with_score(docs: DataFrame, model, text_col: str = "text", out: str = "score",
               keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``out``, the model's score of each whole text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    text = free_name(docs, "text_read")
    wide = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    schema = wide.drop(text).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(model.scores(batch.column(batch.num_columns - 1)))],
                names=[*batch.schema.names[:-1], out])

    return map_arrow(wide, run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with their columns unchanged."""
    score = free_name(docs, "toxicity")
    return with_score(docs, train(docs, labels, id_col, text_col), text_col, score).filter(
        F.col(score) < threshold).select(*docs.columns)
