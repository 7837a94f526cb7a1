"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Features are hashed counts of words and of word shapes (runs of upper case, lower case,
digits and each punctuation mark) as log(1 + count), and the share of words that repeat
the word before (in ``REPEAT_COLUMNS`` columns, so that it can outweigh a long text);
they are scaled by inverse document frequency (over all documents) and length. A truncated singular value
decomposition of a bounded sample of labelled rows gives the latent space; the sample's
latent vectors and labels are broadcast (``MAX_REFERENCES`` x ``RANK`` floats, and the
``FEATURES`` x ``RANK`` projection: about 2 MB whatever the input). Every document is then
compared with every reference by exact cosine products in blocks; its score is the
similarity-weighted mean label of the ``NEIGHBOURS`` most similar references.

The sample are the labelled rows with the least hashes of doc_id, at most
``MAX_REFERENCES``; label, language, source and doc_id are never features. Several labels
of one doc_id count as their least. A null label is no label. Texts without features
(null, empty or white space) and all texts when there are no usable labels get the mean
label of the sample (1.0 without any label, so that nothing is rejected unseen). Ties
among neighbours go to the reference with the lesser hash. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BYTE_CODE, bytes_of, mix, span_hashes, split_words

FEATURES = 4096
RANK = 64
MAX_REFERENCES = 4096
NEIGHBOURS = 31
BLOCK = 256
REPEAT_COLUMNS, REPEAT_WEIGHT = 16, 6.0

_SHAPE = np.zeros(256, np.uint64)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 1, 2, 3, 2
_PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_SHAPE[_PUNCTUATION] = np.array(_PUNCTUATION, np.uint64)


def counts(data: np.ndarray, offsets: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """A dense block of log(1 + count) features, one row per text."""
    texts = len(offsets) - 1
    start, end, first = split_words(data, offsets)
    text = np.repeat(np.arange(texts), np.diff(first))
    words = span_hashes(BYTE_CODE[data], start, end)
    # shapes: bytes whose class differs from the byte before, within the word
    kind = _SHAPE[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[start] = True
    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(change)])
    shapes = span_hashes(mix(kind[change], 3), kept[start], kept[end])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    width = np.uint64(features // 2)
    column = [(words % width).astype(np.int64), (mix(shapes, 4) % (width - np.uint64(REPEAT_COLUMNS))).astype(np.int64) + features // 2]
    cells = np.concatenate([text * features + column[0], text * features + column[1]])
    block = np.log1p(np.bincount(cells, minlength=texts * features).reshape(texts, features).astype(np.float32))
    share = np.bincount(text[again], minlength=texts) / (10.0 + np.diff(first))
    block[:, -REPEAT_COLUMNS:] = REPEAT_WEIGHT * share[:, None]
    return block


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    projection: np.ndarray
    references: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def latent(self, block: np.ndarray) -> np.ndarray:
        x = unit(block * self.idf)
        return unit(x @ self.projection)

    def score(self, block: np.ndarray) -> np.ndarray:
        """Scores of a block of count features."""
        if not len(self.labels):
            return np.full(len(block), self.prior)
        vectors = self.latent(block)
        cosine = vectors @ self.references.T
        k = min(self.neighbours, cosine.shape[1])
        if k < cosine.shape[1]:
            least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k]
            weight = np.where(cosine > least[:, None], cosine, 0.0)
            tied = cosine == least[:, None]
            room = k - (cosine > least[:, None]).sum(1)
            weight = np.where(tied & (np.cumsum(tied, 1) <= room[:, None]), cosine, weight)
        else:
            weight = cosine
        weight = np.maximum(weight, 0.0).astype(np.float64) ** 4
        total = weight.sum(1)
        voted = (weight @ self.labels + 1e-9 * self.prior) / (total + 1e-9)
        return np.where(np.abs(vectors).sum(1) > 0, voted, self.prior)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Sample:
    """Sparse count rows; only a block of them is dense at a time."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], features: int = FEATURES):
        self._rows, self._features = rows, features

    def __len__(self) -> int:
        return len(self._rows)

    def blocks(self, idf: np.ndarray) -> Iterator[np.ndarray]:
        """Unit rows after scaling by ``idf``."""
        for at in range(0, len(self._rows), BLOCK):
            part = self._rows[at : at + BLOCK]
            block = np.zeros((len(part), self._features), np.float32)
            for i, (columns, values) in enumerate(part):
                block[i, columns] = values
            yield unit(block * idf)


def fit(sample: Sample, labels: np.ndarray, texts: int, texts_with: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Latent space and reference vectors of a bounded sample (randomised SVD, fixed seed).
    ``texts_with``: in how many of all ``texts`` each column occurs."""
    features = len(texts_with)
    if not len(labels):
        return Model(np.zeros(features, np.float32), np.zeros((features, 1), np.float32), np.zeros((0, 1), np.float32), labels, 1.0, neighbours)
    idf = np.log((1.0 + texts) / (1.0 + texts_with)).astype(np.float32) + np.float32(0.1)
    rank = min(rank, len(sample), features)
    basis = np.random.Generator(np.random.PCG64(7)).standard_normal((features, min(features, rank + 16))).astype(np.float32)
    for _ in range(4):
        image = np.zeros_like(basis)
        for x in sample.blocks(idf):
            image += x.T @ (x @ basis)
        basis, _ = np.linalg.qr(image)
    _, _, right = np.linalg.svd(np.concatenate([x @ basis for x in sample.blocks(idf)]), full_matrices=False)
    projection = (basis @ right.T)[:, :rank].astype(np.float32)
    references = np.concatenate([unit(x @ projection) for x in sample.blocks(idf)])
    return Model(idf, projection, references, labels.astype(np.float64), float(labels.mean()), neighbours)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts and, for each column, of those that have it; over all of ``docs``.
    A task sends one row per column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = counts(*bytes_of(batch.column(0).slice(at, BLOCK)))
                total += (block > 0).sum(0)
                texts += len(block)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(total[found], texts), pa.int64())], names=["column", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "column int, n bigint").groupBy("column").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    found = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        found[r["column"]] = r["n"]
    return int(found[-1]), found[:-1]


def train(docs: DataFrame, labels: DataFrame, eligible, max_references: int = MAX_REFERENCES, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label); ``eligible``
    is a condition on doc_id. At most ``max_references`` rows reach the driver."""
    chosen = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & eligible)
        .groupBy("doc_id")
        .agg(F.min("label").cast("double").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(max_references)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                block = counts(*bytes_of(part.column(2)))
                rows, columns = np.nonzero(block)
                cut = np.searchsorted(rows, np.arange(1, len(block)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([c.astype("<i4").tobytes() for c in np.split(columns, cut)], pa.binary()),
                        pa.array([v.astype("<f4").tobytes() for v in np.split(block[rows, columns], cut)], pa.binary()),
                    ],
                    names=["order", "label", "columns", "counts"],
                )

    # max_references rows bound this broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "label", F.col("text").cast("string"))
    rows = texts.mapInArrow(run, "`order` bigint, label double, columns binary, counts binary").orderBy("order", "columns").limit(max_references).collect()
    sample = Sample([(np.frombuffer(r["columns"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in rows])
    return fit(sample, np.array([r["label"] for r in rows], np.float64), *document_frequencies(docs), rank, neighbours)


def score_documents(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the score column appended (a column of that name is replaced). One
    pass, no shuffle; the model goes to the executors as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name != output]
    source = docs.select(*[F.col(f"`{f.name}`") for f in keep])
    at_text = [f.name for f in keep].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.column(at_text).slice(at, BLOCK)
                scores[at : at + len(part)] = known.score(counts(*bytes_of(part)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*(f.name for f in keep), output])

    return source.mapInArrow(run, T.StructType([*keep, T.StructField(output, T.DoubleType())]))
