"""Toxicity scores by a counterfactual-regularised classifier.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``;
its features are the counts, up to ``MOST``, of hashed words and of their beginnings of
``PREFIXES`` code points, so that inflected and compound forms share weight. A logistic
model is fitted on a bounded sample of labelled texts. For every labelled text
with an identity term, ``SWAPS`` counterfactual texts are made: each term is replaced by
another term of its group (the next ones in cyclic order, every group with a neutral
member). The loss is ::

    sum weight(y) log-loss(y, z(x)) + PENALTY / SWAPS * sum (z(x) - z(x swapped))^2 + L2 / 2 * |w|^2

with z the log odds, so a group's mention alone cannot move a score, and a neutral mention
of a group that toxic texts often name is not held against it. weight is 1 for a clean text
and (clean texts / toxic texts) ** ``BALANCE`` for a toxic one. Features in fewer than
``MIN_TEXTS`` texts of the sample have no weight.

The sample are the labelled rows with the least hashes of doc_id, at most ``MAX_ROWS``; only
their feature columns reach the driver. Labels, lang, source and doc_id are never features.
Scoring is one pass without a shuffle; the weights (``COLUMNS`` floats, 1 MB) are broadcast.

Results. Null and empty texts have the score of no feature, the intercept's. Whole texts are
read; memory follows the longest text. Several labels of one doc_id count as their greatest;
a null label is no label; without any label all scores are 0, so that nothing is accused
unseen. Repeated rows each get a row, equal texts equal scores. An empty table gives no
rows. A column of ``docs`` named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BYTE_CODE, bytes_of, lower_ascii, mix, pieces, span_hashes, split_words

COLUMNS = 1 << 18
MAX_ROWS = 8_192
PREFIXES = (3, 4, 5, 6, 7)
MOST = 4
MIN_TEXTS = 3
SWAPS = 3
PENALTY = 1.0
L2 = 0.5
BALANCE = 1.0
STEPS = 60

# fixed values: identity terms by group; the last word of each group is neutral
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "jew", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists", "believers"),
    ("black", "white", "asian", "african", "arab", "latino", "hispanic", "european", "american", "indigenous", "foreign"),
    ("immigrants", "refugees", "africans", "asians", "arabs", "latinos", "europeans", "americans", "foreigners", "people"),
    ("gay", "lesbian", "bisexual", "homosexual", "heterosexual", "straight", "queer", "transgender", "trans", "single"),
    ("woman", "man", "girl", "boy", "female", "male", "person"),
    ("women", "men", "girls", "boys", "females", "males", "persons"),
    ("old", "young", "elderly", "teenage", "adult"),
    ("blind", "deaf", "disabled", "autistic", "paralyzed", "able"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "menschen"),
    ("frauen", "männer", "mädchen", "jungen", "personen"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "gens"),
    ("femmes", "hommes", "filles", "garçons", "personnes"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "gente"),
    ("mujeres", "hombres", "niñas", "niños", "personas"),
)

_PACKED = pa.list_(pa.struct([("columns", pa.binary()), ("counts", pa.binary())]))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class Words:
    """The words of texts as hashes: ``forms`` has one row for whole words and one for each
    beginning (0 where a word is not longer); ``text`` is the text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        plain = lower_ascii(data)
        start, end, first = split_words(plain, offsets, _SEPARATOR)
        self.texts = len(offsets) - 1
        self.text = np.repeat(np.arange(self.texts), np.diff(first))
        codes = BYTE_CODE[plain]
        lead = (plain & 0xC0) != 0x80  # first byte of a code point
        points = np.append(np.flatnonzero(lead), np.full(1 + max(PREFIXES), len(plain)))
        at = (np.cumsum(lead) - lead)[start]
        self.forms = np.zeros((1 + len(PREFIXES), len(start)), np.uint64)
        self.forms[0] = span_hashes(codes, start, end)
        for k, size in enumerate(PREFIXES, 1):
            stop = points[at + size]
            longer = stop < end
            self.forms[k, longer] = span_hashes(codes, start[longer], stop[longer])

    def cells(self, columns: int) -> np.ndarray:
        """text * columns + column of every feature occurrence."""
        out = []
        for k, form in enumerate(self.forms):
            some = form != 0
            half = np.uint64(columns // 2)
            out.append(self.text[some] * columns + (mix(form[some], 61 + k) % half + half * np.uint64(k > 0)).astype(np.int64))
        return np.concatenate(out)

    def changed(self, at: np.ndarray, forms: np.ndarray) -> Words:
        other = copy(self)
        other.forms = self.forms.copy()
        other.forms[:, at] = forms
        return other


def features(words: Words, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, count up to MOST) of the features present, by text and column."""
    cells, n = np.unique(words.cells(columns), return_counts=True)
    return cells // columns, cells % columns, np.minimum(n, MOST)


def forms_of(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)])).forms[:, 0]


class Swapper:
    """Replaces identity terms, given by word hashes, by others of their group."""

    def __init__(self, groups: Sequence[Sequence[str]]):
        self._group = [np.stack([forms_of(w) for w in g], 1) for g in groups if len(g) > 1]
        terms = [(int(h), g, i) for g, forms in enumerate(self._group) for i, h in enumerate(forms[0])]
        terms = sorted({h: (h, g, i) for h, g, i in reversed(terms)}.values())  # a word of two groups is of the first
        self._terms = np.array([h for h, _, _ in terms], np.uint64)
        self._at = [(g, i) for _, g, i in terms]

    def swapped(self, words: Words) -> list[Words]:
        """The texts with every term moved by 1 to ``SWAPS`` places in its group; none without a term."""
        own = words.forms[0]
        if not len(self._terms) or not len(own):
            return []
        at = np.minimum(np.searchsorted(self._terms, own), len(self._terms) - 1)
        found = np.flatnonzero(self._terms[at] == own)
        out = []
        for shift in range(1, SWAPS + 1) if len(found) else ():
            new = np.empty((len(words.forms), len(found)), np.uint64)
            for k, word in enumerate(found.tolist()):
                group, i = self._at[at[word]]
                size = self._group[group].shape[1]
                step = 1 + (shift - 1) % (size - 1)  # never round to the term itself
                new[:, k] = self._group[group][:, (i + step) % size]
            out.append(words.changed(found, new))
        return out


@dataclass(frozen=True)
class Rows:
    """Sparse rows: those of row i are ``columns[start[i]:start[i + 1]]`` and ``values``."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, columns: list[np.ndarray], values: list[np.ndarray]) -> Rows:
        start = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in columns], dtype=np.int64)])
        return cls(start, np.concatenate([np.empty(0, np.int32), *columns]), np.concatenate([np.empty(0, np.uint8), *values]))

    def __len__(self) -> int:
        return len(self.start) - 1

    def times(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1), np.cumsum(weights[self.columns] * self.values)])
        return np.diff(total[self.start])

    def back(self, values: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(values, np.diff(self.start)) * self.values, columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit(texts: Rows, labels: np.ndarray, swapped: Rows, of: np.ndarray, columns: int = COLUMNS, penalty: float = PENALTY, l2: float = L2, swaps: int = SWAPS, balance: float = BALANCE) -> np.ndarray:
    """Weights and, last, the intercept. ``of``: the text of each swapped row."""
    if not len(texts):
        return np.append(np.zeros(columns), -np.inf)
    seen = np.bincount(texts.columns, minlength=columns)
    used = np.flatnonzero(seen >= MIN_TEXTS)
    dense = np.full(columns, len(used))  # the others share a column without weight
    dense[used] = np.arange(len(used))
    x, c = Rows(texts.start, dense[texts.columns], texts.values), Rows(swapped.start, dense[swapped.columns], swapped.values)
    n = len(used)

    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(labels > 0, (1 / rate - 1) ** balance, 1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        own = np.append(w[:n], 0.0)
        z = x.times(own) + w[n]
        moved = x.times(own)[of] - c.times(own)
        value = weight @ (np.logaddexp(0.0, z) - labels * z) + penalty / swaps * (moved @ moved) + l2 / 2 * (w[:n] @ w[:n])
        each = weight * (sigmoid(z) - labels)
        pull = 2 * penalty / swaps * moved
        slope = x.back(each + np.bincount(of, pull, len(x)), n + 1)[:n] - c.back(pull, n + 1)[:n] + l2 * w[:n]
        return float(value), np.append(slope, each.sum())

    w = minimise(loss, np.append(np.zeros(n), np.log(rate / (1 - rate))))
    out = np.zeros(columns + 1)
    out[used], out[-1] = w[:n], w[n]
    return out


def minimise(loss, w: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = slope.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            q -= a * y
            used.append(a)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, np.sqrt(slope @ slope))
        for (s, y, r), a in zip(past, reversed(used), strict=True):
            q += (a - r * (y @ q)) * s
        step, down = 1.0, slope @ q
        while step > 1e-8:
            new, grown = loss(w - step * q)
            if new <= value - 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, y = -step * q, grown - slope
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1.0 / (s @ y))]
        done = value - new < 1e-6 * max(1.0, abs(value))
        w, value, slope = w + s, new, grown
        if done:
            break
    return w


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for a, b in pieces(offsets):
            cells = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).cells(len(self.weights))
            cells = cells[self.weights[cells % len(self.weights)] != 0]
            codes, distinct = pd.factorize(cells)
            n = np.minimum(np.bincount(codes, minlength=len(distinct)), MOST)
            order = np.argsort(distinct)  # equal texts are summed in the same order
            text, column = distinct[order] // len(self.weights), distinct[order] % len(self.weights)
            out[a:b] = sigmoid(np.bincount(text, self.weights[column] * n[order], b - a) + self.intercept)
        return out


def labelled_rows(docs: DataFrame, labels: DataFrame, eligible: Column, groups: Sequence[Sequence[str]], max_rows: int, columns: int) -> DataFrame:
    """``order, label, texts`` of the sample: features of each text and then of its swaps."""
    chosen = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & eligible)
        .groupBy("doc_id")
        .agg(F.max("label").cast("double").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(max_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swapper = Swapper(groups)
        for batch in batches:
            for row in range(batch.num_rows):
                words = Words(*bytes_of(batch.column(2).slice(row, 1)))
                found = [features(w, columns)[1:] for w in (words, *swapper.swapped(words))]
                packed = [{"columns": c.astype("<i4").tobytes(), "counts": n.astype(np.uint8).tobytes()} for c, n in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([packed], _PACKED)],
                    names=["order", "label", "texts"],
                )

    # max_rows rows bound this broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "label", F.col("text").cast("string"))
    return texts.mapInArrow(run, "`order` bigint, label double, texts array<struct<columns binary, counts binary>>").orderBy("order", "texts").limit(max_rows)


def train(
    docs: DataFrame,
    labels: DataFrame,
    eligible: Column,
    groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
    penalty: float = PENALTY,
    max_rows: int = MAX_ROWS,
    columns: int = COLUMNS,
) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label); ``eligible`` is a
    condition on doc_id."""
    own, swapped, marks, of = ([], []), ([], []), [], []
    for i, r in enumerate(labelled_rows(docs, labels, eligible, groups, max_rows, columns).toLocalIterator()):  # max_rows rows at most
        marks.append(r["label"])
        for k, x in enumerate(r["texts"]):
            of.extend([i] if k else [])
            for held, raw, kind in zip(swapped if k else own, (x["columns"], x["counts"]), ("<i4", np.uint8), strict=True):
                held.append(np.frombuffer(raw, kind))
    fitted = fit(Rows.of(*own), np.array(marks, np.float64), Rows.of(*swapped), np.array(of, np.int64), columns, penalty)
    return Model(fitted[:-1].astype(np.float32), float(fitted[-1]))


def score_documents(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the score column appended (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name != output]
    at_text = [f.name for f in keep].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = known.score(*bytes_of(batch.column(at_text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*(f.name for f in keep), output])

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, T.StructType([*keep, T.StructField(output, T.DoubleType())]))
