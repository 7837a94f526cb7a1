"""Order MinHash fingerprints (sensitive to edit distance).

A text is a sequence of k-mers, each numbered by its occurrence. For each of ``m`` hash
functions the ``l`` numbered k-mers with the least hashes are selected and hashed as a
tuple in their text order; the ``m`` tuple hashes (32 bits each, hex) are the
fingerprint. The likeness of two texts is the share of equal components: unlike MinHash
it falls when the same k-mers come in another order.

Here the letters of a k-mer are words (runs without white space), k = 2. A text with
fewer words than k has its whole word sequence as its one k-mer, a text without words an
empty sequence; fewer than l k-mers make shorter tuples. All texts are taken whole.

Equal texts have equal fingerprints. A null text counts as empty. Repeated rows each give
a row. ``next`` follows descending doc_id (ties: ascending hash of the text; null doc_id
last); the last document's next is the first. A single document is its own next. Very long
texts are taken whole. An empty table gives no rows. Further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BYTE_CODE, bytes_of, mix, pieces, span_hashes, split_words

K, L, M = 2, 2, 32
#: rows whose keys bound the ranges of the order; more ranges than this are not told apart
SAMPLE = 65_536
_POSITION_BITS = 24


class OrderMinHash:
    def __init__(self, k: int = K, l: int = L, m: int = M):
        self.k, self.l, self.m = k, l, m

    def signatures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of m 32-bit components for each text."""
        out = [np.empty((0, self.m), np.uint32)]
        for a, b in pieces(offsets):
            out.append(self._piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        return np.concatenate(out)

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start, end, first = split_words(data, offsets)
        words = span_hashes(BYTE_CODE[data], start, end)
        texts = len(offsets) - 1
        n_words = np.diff(first)
        n_kmers = np.where(n_words >= self.k, n_words - self.k + 1, np.minimum(n_words, 1))
        # k-mer j of a text begins at its word j
        text = np.repeat(np.arange(texts), n_kmers)
        begin = np.cumsum(n_kmers) - n_kmers
        place = np.arange(len(text)) - begin[text]
        at = first[:-1][text] + place
        kmers = np.zeros(len(text), np.uint64)
        for j in range(self.k):
            has = j < n_words[text]
            kmers = np.where(has, mix(kmers ^ words[np.minimum(at + j, max(0, len(words) - 1))], j + 1), kmers) if len(words) else kmers
        kmers = mix(kmers + self._occurrence(kmers, text).astype(np.uint64), 50)
        return self._select(kmers, place, begin, n_kmers)

    @staticmethod
    def _occurrence(kmers: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How often each k-mer came before in its text."""
        key = mix(kmers + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 49)
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        out = np.empty(len(key), np.int64)
        out[order] = np.arange(len(key)) - head
        return out

    def _select(self, kmers: np.ndarray, place: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        texts = len(n)
        result = np.zeros((texts, self.m), np.uint32)
        full = np.flatnonzero(n > 0)
        if not len(full):
            result[:] = mix(np.arange(self.m, dtype=np.uint64), 60).astype(np.uint32)
            return result
        starts = begin[full]
        top = np.uint64(2**64 - 1)
        # a hash's low bits hold the place, so one minimum gives both; texts beyond 2**24 k-mers keep ties by place modulo that
        low = np.uint64((1 << _POSITION_BITS) - 1)
        places = place.astype(np.uint64) & low
        for j in range(self.m):
            h = kmers * np.uint64(2 * int(mix(np.array([j], np.uint64), 61)[0] >> np.uint64(1)) % 2**64 + 1)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h &= ~low
            h |= places
            chosen = np.zeros((len(full), self.l), np.int64)
            for i in range(self.l):
                least = np.minimum.reduceat(h, starts)
                at = starts + (least & low).astype(np.int64)
                if int(n.max()) > int(low):
                    at = self._find(h, least, starts, n[full])
                chosen[:, i] = np.where(n[full] > i, at, np.iinfo(np.int64).max)
                h[at[n[full] > i]] = top
            chosen.sort(axis=1)
            tuple_hash = np.full(len(full), j, np.uint64)
            for i in range(self.l):
                has = chosen[:, i] != np.iinfo(np.int64).max
                tuple_hash[has] = mix(tuple_hash[has] ^ kmers[chosen[has, i]], 70 + i)
            result[full, j] = (tuple_hash >> np.uint64(32)).astype(np.uint32)
            result[n == 0, j] = np.uint32(mix(np.array([j], np.uint64), 60)[0] & np.uint64(0xFFFFFFFF))
        return result

    @staticmethod
    def _find(h: np.ndarray, least: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.array([s + int(np.argmin(h[s : s + k])) for s, k in zip(starts.tolist(), n.tolist(), strict=True)])


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _order_key(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and their place in the order: ``desc`` (ascending where doc_id
    descends, null last) and ``tie``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    last = F.lit(2**63 - 1).cast("bigint")
    return docs.select("*", F.coalesce(F.bitwise_not("doc_id"), last).alias("desc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))


def _edges(keyed: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """Keys of rows that begin the buckets, ascending; the first is the least key of all.
    They come from the distinct keys whose hash lies in a share of its range that holds
    ``SAMPLE`` of all rows, so what reaches the driver does not grow with the input."""
    keys = keyed.select("desc", "tie")
    least, n = keys.agg(F.min(F.struct("desc", "tie")), F.count(F.lit(1))).first()
    if least is None:
        return []
    bound = -(2**63) + (2**64 * min(SAMPLE, n) // n) - 1
    rows = keys.where(F.xxhash64("desc", "tie", F.lit(9)) <= F.lit(bound)).distinct().collect()  # about SAMPLE rows at most
    found = sorted((r.desc, r.tie) for r in rows)
    return sorted({(least.desc, least.tie), *(found[i * len(found) // buckets] for i in range(1, buckets) if found)})


def _bucket_of(edges: list[tuple[int, int]], desc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last edge that is not above each key, and whether the key is that edge."""
    e = np.array(edges, np.int64).reshape(-1, 2)
    at = np.searchsorted(e[:, 0], desc, "right") - 1
    for i in np.flatnonzero(e[at, 0] == desc).tolist():  # an edge with the same doc_id: compare the ties
        while at[i] > 0 and e[at[i], 0] == desc[i] and e[at[i], 1] > tie[i]:
            at[i] -= 1
    return at, (e[at, 0] == desc) & (e[at, 1] == tie)


def with_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows with the ``bucket`` (a range of the order) that they belong to; the first row
    of each bucket comes once more, ``borrowed`` by the bucket before it (by the last one
    for the very first row), so that each row's next is in its bucket."""
    keyed = _order_key(docs)
    edges = _edges(keyed, buckets)
    n = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, head = _bucket_of(edges, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            lent = np.flatnonzero(head)
            rows = np.concatenate([np.arange(batch.num_rows), lent])
            bucket = np.concatenate([at, (at[lent] - 1) % n])
            borrowed = np.concatenate([np.zeros(batch.num_rows, bool), np.ones(len(lent), bool)])
            taken = [c.take(pa.array(rows)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(bucket, pa.int32()), pa.array(borrowed)], names=[*batch.schema.names, "bucket", "borrowed"])

    return keyed.mapInArrow(run, "doc_id bigint, text string, desc bigint, tie bigint, bucket int, borrowed boolean")


def fingerprint_documents(docs: DataFrame, k: int = K, l: int = L, m: int = M, parts: int | None = None) -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. One shuffle of the texts, in ranges of the order."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, l, m)
        run_rows: list[tuple[int, int | None, str, bool]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                run_rows.append(row)
                size += len(row[2])
                if size >= 1_000_000:
                    yield from _compare(sketch, run_rows)
                    run_rows, size = run_rows[-1:], len(run_rows[-1][2])
        if run_rows:
            yield from _compare(sketch, run_rows)

    ordered = (
        with_buckets(docs, 4 * parts)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "borrowed", "desc", "tie")
        .select("bucket", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "borrowed")
    )
    return ordered.mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _compare(sketch: OrderMinHash, rows: list[tuple[int, int | None, str, bool]]) -> Iterator[pa.RecordBatch]:
    """Results for all rows that are followed by their next; the last row only serves as one."""
    pairs = [i for i in range(len(rows) - 1) if not rows[i][3]]
    if not pairs:
        return
    texts = [r[2] for r in rows]
    changed = [edited(texts[i], texts[i + 1]) for i in pairs]
    own = sketch.signatures(*bytes_of(pa.array(texts, pa.large_string())))
    new = sketch.signatures(*bytes_of(pa.array(changed, pa.large_string())))
    at = np.array(pairs)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][1] for i in pairs], pa.int64()),
            pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([own[i].astype(">u4").tobytes().hex() for i in pairs], pa.string()),
            pa.array([s.astype(">u4").tobytes().hex() for s in new], pa.string()),
            pa.array((own[at] == new).mean(1), pa.float64()),
            pa.array((own[at] == own[at + 1]).mean(1), pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
