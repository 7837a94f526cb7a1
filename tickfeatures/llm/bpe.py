"""BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a run of texts are laid out as one linked list of byte
symbols. An index maps each adjacent pair that has a merge rank to all its positions.
Active ranks are taken in ascending order from a heap; all positions of a pair merge at
once, and the pairs that the merge creates enter the index. A merge only creates pairs of
a higher rank (each token is made by one merge after its parts exist; checked when the
vocabulary is read), so one ascending pass gives the same ids as merging word by word.

Results: a null or empty text has no ids and decodes to the empty text; equal texts have
equal ids; the file's special tokens in a text become their ids. Texts of any length are
taken whole; memory is bounded by the run size, one longest text and the word cache.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import Vocabulary, encoder, ranges, vocabulary

MAX_SYMBOLS = 1_500_000


class PairIndex:
    """Merges all words of a list at once."""

    def __init__(self, vocab: Vocabulary):
        key = vocab.left.astype(np.int64) << 32 | vocab.right
        order = np.argsort(key)
        self._keys, self._ranks = key[order], order.astype(np.int32)
        self._vocab = vocab
        born = np.full(vocab.size, -1, np.int64)
        born[vocab.merged] = np.arange(len(key))
        if len(np.unique(vocab.merged)) != len(key) or (np.maximum(born[vocab.left], born[vocab.right]) >= np.arange(len(key))).any():
            raise ValueError("merges are not in the order in which their parts are made")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per word; long lists are taken in parts."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids, lengths, at, size = [], [], 0, 0
        for i, w in enumerate(raw):
            size += len(w)
            if size >= MAX_SYMBOLS or i + 1 == len(raw):
                got = self._merge(raw[at : i + 1])
                ids.append(got[0])
                lengths.append(got[1])
                at, size = i + 1, 0
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.empty(0, np.int32), np.empty(0, np.int64))

    def _merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self._vocab.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbol)
        # linked list; position n stands for "no neighbour"
        symbol = np.append(symbol, np.int32(-1))
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        starts = np.cumsum(size) - size
        ends = np.cumsum(size) - 1
        before[starts[size > 0]] = n
        after[ends[size > 0]] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            rank = self._rank(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, positions in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(heap, r)

        has_next = np.flatnonzero(after[:n] != n).astype(np.int32)
        add(has_next)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            left, right, made = self._vocab.left[r], self._vocab.right[r], self._vocab.merged[r]
            at = np.unique(np.concatenate(lists))
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if left == right and len(at) > 1:
                at = self._leftmost(at, after)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = made
            symbol[gone] = -1
            then = after[gone]
            after[at] = then
            inner = then != n
            before[then[inner]] = at[inner]
            ahead = before[at]
            ahead = ahead[ahead != n]
            add(np.concatenate([ahead, at[inner]]))
        alive = symbol[:n] >= 0
        ids = symbol[:n][alive]
        count = np.concatenate([np.zeros(1, np.int64), np.cumsum(alive)])
        return ids, count[starts + size] - count[starts]

    @staticmethod
    def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences of a pair of equal symbols, every second one from the left."""
        chained = np.zeros(len(at), bool)
        chained[1:] = after[at[:-1]] == at[1:]
        head = np.flatnonzero(~chained)
        place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        return at[place % 2 == 0]


class Decoder:
    """Ids back to bytes."""

    def __init__(self, vocab: Vocabulary):
        self._bytes = np.frombuffer(b"".join(vocab.spelled), np.uint8)
        size = np.fromiter(map(len, vocab.spelled), np.int64, len(vocab.spelled))
        self._begin, self._size = np.cumsum(size) - size, size

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
        """UTF-8 of each text; ids that do not form UTF-8 give replacement characters."""
        size = self._size[ids]
        data = self._bytes[ranges(self._begin[ids], size)].tobytes()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[np.cumsum(lengths)].tolist()
        at = 0
        for end in ends:
            yield data[at:end]
            at = end


#: rows of a batch that are Python strings at once
ROWS = 256

#: columns that ``encode_documents`` can append
OUTPUTS = {
    "ids": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Columns of ``docs`` but the text, then ``n_tokens`` and the ``outputs``: the ids, the
    decoded text, and lowercase hex SHA-256 of the ids (little-endian unsigned 32-bit) and of
    the decoded UTF-8. Columns of these names in ``docs`` are replaced. One pass, no shuffle."""
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    keep = [f for f in docs.schema.fields if f.name != text and f.name not in {"n_tokens", *outputs}]
    made = [T.StructField("n_tokens", T.LongType()), *(T.StructField(o, T.ArrayType(T.IntegerType()) if o == "ids" else T.StringType()) for o in outputs)]
    names = [*(f.name for f in keep), *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer_path)
        coder, decoder = encoder(tokenizer_path, "pair index", lambda: PairIndex(vocab).encode), Decoder(vocab)
        for batch in batches:
            at = 0
            texts = (t for first in range(0, batch.num_rows, ROWS) for t in batch.column(0).slice(first, ROWS).to_pylist())
            for n, ids, lengths in coder.encode(texts):
                columns = [batch.column(i + 1).slice(at, n) for i in range(len(keep))]
                columns += [pa.array(lengths, pa.int64()), *(_output(o, ids, lengths, decoder) for o in outputs)]
                at += n
                yield pa.RecordBatch.from_arrays(columns, names=names)
                del columns
                pa.default_memory_pool().release_unused()

    return docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, T.StructType([*keep, *made]))


def _output(name: str, ids: np.ndarray, lengths: np.ndarray, decoder: Decoder) -> pa.Array:
    if name == "ids":
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
    if name == "ids_sha256":
        ends = np.cumsum(lengths).tolist()
        raw = ids.astype("<u4").tobytes()
        return pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.string())
    decoded = decoder.decode(ids, lengths)
    if name == "decoded":
        return pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())
    return pa.array([hashlib.sha256(d.decode("utf-8", "replace").encode()).hexdigest() for d in decoded], pa.string())
