"""Language-model scoring by deleted interpolation.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token
per text. The model mixes maximum-likelihood estimates of three orders and a uniform one::

    P(w | u, v) = l3[b] * c(u, v, w) / c(u, v) + l2[b] * c(v, w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1)

where b is the bucket of the frequency of the longest context that was seen: of (u, v), else
of v, else 0 (a bucket is 1 + floor(log2 count)). Two start marks stand before a text.
Counts come from all training texts. The weights are learned by expectation-maximisation
on counts held out from them: a tenth of the training texts (by doc_id) is deleted from the
counts, and the weights of each bucket maximise the likelihood of the deleted texts.

Execution. Documents are taken in *chunks* of at least ``chunk_bytes`` of text, cut by
running bytes in file order (``from_files``) or, after a shuffle, in doc_id order. Each
chunk sends, per range of key hashes (*bucket*), its sorted distinct uni-, bi- and trigram
keys (64-bit hashes, as differences) and its training counts: one exchange, combined on the
map side, so a word in every text is one entry per chunk. A bucket sums the keys of all
chunks and answers each chunk with the totals in the chunk's own key order, so no key
travels back. The answers are written to the shared folder; then texts meet their chunk's
answers and are scored whole. EM sums run as aggregations over distinct estimates. Only
these sums, the totals N and V and the number of text bytes reach the driver.

Memory of a task: the words of two open chunks (``chunk_bytes`` and one text more, whatever
the size of a file block) or one bucket's keys (``bucket_bytes`` of text; the number of
buckets and of tasks grows with the text). A row is exchanged per chunk and bucket, so for
very large corpora raise both sizes with the executors' memory.

Results. Null and empty texts are the end token alone. Very long texts are scored whole, in
a chunk of their own. Repeated rows each count and each get a row; ties do not occur. A null
doc_id is not held out and is learned from. An empty table gives no rows. Further columns
are ignored, whatever their names. Without training texts all counts are 0 and the weights
are the start values. Two different keys share a 64-bit hash with probability about
n^2 / 2^65 for n distinct keys. ``from_files`` needs the same file blocks in each pass over
the texts; where they changed in between, the job ends with an error instead of a wrong score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickfeatures.session import materialize

from .dac import new_folder
from .text import bytes_of, mix, pieces, word_hashes

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
TASK_BYTES = 64 << 20
HELD_OUT_TENTHS = 1
MAX_ROUNDS = 30
TOLERANCE = 1e-3
START_WEIGHTS = (0.3, 0.4, 0.2, 0.1)
#: buckets of one context's frequency; those of pairs follow those of words
FREQUENCIES = 66
CONTEXT_BUCKETS = 2 * FREQUENCIES

_U = np.uint64
_BEGIN, _END = _U(0x5B5E0C1D2F3A4B59), _U(0xE4D0F7A8B9C3D2E1)
_ODD = _U(1)
BEGIN_KEY = int(mix(np.array([_BEGIN], np.uint64), 11)[0]) & ~1
BEGIN_PAIR = int(mix(mix(np.array([_BEGIN], np.uint64), 12) ^ _BEGIN, 13)[0]) | 1


def _remainder(divisor: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def marked(docs: DataFrame, held_out: Column, from_files: bool, parts: int) -> DataFrame:
    """``doc_id, text, held_out, deleted, block``. The rows of a block are in one task and in
    one order: a block of a file if ``docs`` is a plain file scan, else a hash class by a shuffle.
    Blocks are named by hashes, so that the chunks counted up from them do not meet."""
    deleted = ~held_out & (F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5), F.lit(10)) < HELD_OUT_TENTHS)
    text = F.col("text").cast("string")
    own = F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64(text))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(deleted, F.lit(False)).alias("deleted"),
        (F.xxhash64(F.input_file_name(), F.input_file_block_start()) if from_files else F.xxhash64(F.pmod(own, F.lit(parts)))).alias("block"),
    )
    return rows if from_files else rows.repartition(parts, "block").sortWithinPartitions("block", "doc_id", F.xxhash64("text"), "held_out", "deleted")


class Cutter:
    """Numbers the chunks of a task's rows: a chunk is closed once it has ``chunk_bytes`` of
    text. Deleted texts have chunks of their own."""

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes = chunk_bytes
        self.block: int | None = None
        self.open = [0, 0]
        self.size = [0, 0]

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """The chunk of each row of ``text, block, deleted, ...``."""
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
        out = np.empty(batch.num_rows, np.int64)
        rows = zip(sizes, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        for i, (size, block, deleted) in enumerate(rows):
            if block != self.block:
                self.block, self.open, self.size = block, [0, 1], [0, 0]
            out[i] = _wrap(block + self.open[deleted])
            self.size[deleted] += size
            if self.size[deleted] >= self.chunk_bytes:
                self.open[deleted] += 2
                self.size[deleted] = 0
        return out

    def is_open(self, chunk: int) -> bool:
        return self.block is not None and chunk in (_wrap(self.block + o) for o in self.open)


def _wrap(value: int) -> int:
    return (value + 2**63) % 2**64 - 2**63


def with_chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """``text, block, deleted, held_out, doc_id, chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(chunk_bytes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cutter(batch), pa.int64())], names=[*batch.schema.names, "chunk"])

    return rows.select("text", "block", "deleted", "held_out", "doc_id").mapInArrow(run, "text string, block bigint, deleted boolean, held_out boolean, doc_id bigint, chunk bigint")


def pack(values: np.ndarray) -> bytes:
    """The bytes of all values by significance, so that equal high bytes stand together."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unpack(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


class ChunkKeys:
    """Tokens and keys of a chunk's texts."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        """texts: (word hashes, first word of each text) runs."""
        current, previous, sizes = [], [], []
        for words, first in texts:
            current.append(np.insert(words, first[1:], _END))
            previous.append(np.insert(words, first[:-1], _BEGIN))
            sizes.append(np.diff(first) + 1)
        self.sizes = np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        cur, prev = np.concatenate(current), np.concatenate(previous)
        single = mix(cur, 11) & ~_ODD
        double = mix(mix(prev, 12) ^ cur, 13) | _ODD
        triple = mix(mix(self._before(double, _U(BEGIN_PAIR)), 14) ^ cur, 15) | _ODD
        del cur, prev, current, previous
        codes, distinct = pd.factorize(np.concatenate([np.array([BEGIN_KEY, BEGIN_PAIR], np.uint64), single, double, triple]))
        order = np.argsort(distinct)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.keys = distinct[order]
        codes = place[codes]
        n = len(single)
        self.begin, self.begin_pair = codes[:2]
        self.word, self.pair, self.triple = codes[2 : n + 2], codes[n + 2 : 2 * n + 2], codes[2 * n + 2 :]
        self.context, self.pair_context = self._before(self.word, self.begin), self._before(self.pair, self.begin_pair)

    def _before(self, values: np.ndarray, at_start: int) -> np.ndarray:
        """The value of the token before each token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = at_start
        return out

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """Training count of every key; learn: one flag per text."""
        token = np.repeat(learn, self.sizes)
        out = sum(np.bincount(codes[token], minlength=len(self.keys)) for codes in (self.word, self.pair, self.triple))
        out[[self.begin, self.begin_pair]] += int(learn.sum())
        return out.astype(np.int64)

    def estimates(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per token its bucket, the estimates from three and two words, and the word's count."""
        context, pair_context = counts[self.context], counts[self.pair_context]
        bucket = np.where(pair_context > 0, FREQUENCIES + frequency_bucket(pair_context), frequency_bucket(context))
        return bucket, counts[self.triple] / np.maximum(pair_context, 1), counts[self.pair] / np.maximum(context, 1), counts[self.word]


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = bytes_of(texts)
    for a, b in pieces(offsets):
        yield word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def forward(rows: DataFrame, buckets: int, chunk_bytes: int) -> DataFrame:
    """``bucket, chunk, deleted, keys, counts``: each chunk's keys by range of hash."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def flush(chunk: int, deleted: bool, words: list, learn: list) -> Iterator[pa.RecordBatch]:
        own = ChunkKeys(words)
        counts = own.counts(np.concatenate(learn)).astype(np.uint32)
        cut = [0, *np.searchsorted(own.keys, edges).tolist(), len(own.keys)]
        filled = [i for i in range(buckets) if cut[i + 1] > cut[i]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(filled, pa.int32()),
                pa.array([chunk] * len(filled), pa.int64()),
                pa.array([deleted] * len(filled)),
                pa.array([pack_sorted(own.keys[cut[i] : cut[i + 1]]) for i in filled], pa.binary()),
                pa.array([pack(counts[cut[i] : cut[i + 1]]) for i in filled], pa.binary()),
            ],
            names=["bucket", "chunk", "deleted", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(chunk_bytes)
        held: dict[int, tuple[bool, list, list]] = {}
        for batch in batches:
            chunks = cutter(batch)
            learn = ~batch.column(3).to_numpy(zero_copy_only=False)
            _, first = np.unique(chunks, return_index=True)
            for at in np.sort(first).tolist():
                mine = np.flatnonzero(chunks == chunks[at])
                _, words, flags = held.setdefault(int(chunks[at]), (batch.column(2)[at].as_py(), [], []))
                words.extend(_words(batch.column(0).take(pa.array(mine))))
                flags.append(learn[mine])
                for closed in [c for c in held if not cutter.is_open(c)]:
                    # a chunk that this batch closed may still wait for its rows of this batch
                    if closed == chunks[at] or not (chunks == closed).any():
                        yield from flush(closed, *held.pop(closed))
        for chunk in list(held):
            yield from flush(chunk, *held.pop(chunk))

    return rows.select("text", "block", "deleted", "held_out").mapInArrow(run, "bucket int, chunk bigint, deleted boolean, keys binary, counts binary")


def _answer(rows: pa.Table) -> pa.Table:
    """Sums of one bucket's keys, in the key order of each chunk; and one row of totals."""
    keys = [unpack_sorted(b) for b in rows["keys"].to_pylist()]
    counts = [unpack(b, np.uint32) for b in rows["counts"].to_pylist()]
    deleted = rows["deleted"].to_pylist()
    lengths = [len(k) for k in keys]
    codes, distinct = pd.factorize(np.concatenate(keys))
    flat = np.concatenate(counts)
    every = _sum(codes, flat, len(distinct))
    kept = _sum(codes, np.where(np.repeat(np.array(deleted), lengths), 0, flat), len(distinct))
    words = ((distinct & _ODD) == 0) & (distinct != _U(BEGIN_KEY))
    cut = np.cumsum(lengths)[:-1]
    n = len(keys)
    none = [None] * n
    totals = [int(every[words].sum()), int((every[words] > 0).sum()), int(kept[words].sum()), int((kept[words] > 0).sum())]
    return pa.table(
        {
            "chunk": pa.array([*rows["chunk"].to_pylist(), None], pa.int64()),
            "bucket": pa.array([*rows["bucket"].to_pylist(), None], pa.int32()),
            "deleted": pa.array([*deleted, None], pa.bool_()),
            "every": pa.array([*(pack(a) for a in np.split(every[codes], cut)), None], pa.binary()),
            "kept": pa.array([*((pack(a) if d else None) for a, d in zip(np.split(kept[codes], cut), deleted, strict=True)), None], pa.binary()),
            **{name: pa.array([*none, t], pa.int64()) for name, t in zip(("n", "v", "kept_n", "kept_v"), totals, strict=True)},
        }
    )


ANSWER = "chunk bigint, bucket int, deleted boolean, every binary, kept binary, n bigint, v bigint, kept_n bigint, kept_v bigint"


def _sum(codes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(codes, values, n).astype(np.int64)  # exact below 2**53


def _counts_of(own: ChunkKeys, answers: pa.Table, column: str) -> np.ndarray:
    """The answered counts in the chunk's key order."""
    parts = sorted(zip(answers["bucket"].to_pylist(), answers[column].to_pylist(), strict=True))
    counts = np.concatenate([unpack(b, np.int64) for _, b in parts])
    if len(counts) != len(own.keys) or len({b for b, _ in parts}) != len(parts):
        raise RuntimeError("a chunk's texts were not in one task; call with from_files=False")
    return counts


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count))."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(np.float64))[1], 0).astype(np.int64)


def _combinations(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Distinct (bucket, estimate from three words, from two words, word count) of deleted
    tokens, by counts from the kept texts."""
    own = ChunkKeys(list(_words(texts["text"])))
    columns = own.estimates(_counts_of(own, answers, "kept"))
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    head = np.ones(len(order), bool)
    head[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(head)
    return pa.table({**{name: pa.array(c[at]) for name, c in zip(("b", "p3", "p2", "word"), columns, strict=True)}, "n": pa.array(np.diff(np.append(at, len(order))), pa.int64())})


def learn_weights(found: DataFrame, n: int, v: int, start: tuple[float, ...] = START_WEIGHTS) -> np.ndarray:
    """Weights (l3, l2, l1, l0) of every context bucket by EM over distinct estimates."""
    weights = np.tile(np.array(start), (CONTEXT_BUCKETS, 1))
    estimates = (F.col("p3"), F.col("p2"), F.col("word") / F.lit(float(max(1, n))), F.lit(1.0 / (v + 1)))
    for _ in range(MAX_ROUNDS):
        part = [F.element_at(F.array(*map(F.lit, weights[:, i].tolist())), F.col("b").cast("int") + 1) * p for i, p in enumerate(estimates)]
        shares = found.select("b", "n", *[x.alias(f"x{i}") for i, x in enumerate(part)]).withColumn("t", F.col("x0") + F.col("x1") + F.col("x2") + F.col("x3"))
        sums = shares.groupBy("b").agg(*[F.sum(F.col("n") * F.col(f"x{i}") / F.col("t")).alias(f"s{i}") for i in range(4)]).collect()  # one row per bucket, 132 at most
        new = weights.copy()
        for r in sums:
            s = np.maximum(np.array([r[f"s{i}"] for i in range(4)], np.float64), 0) + np.array([0.0, 0.0, 0.0, 1e-6])
            new[r["b"]] = s / s.sum()
        moved = np.abs(new - weights).max()
        weights = new
        if moved < TOLERANCE:
            break
    return weights


def score_documents(docs: DataFrame, held_out: Column | None = None, from_files: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``. ``from_files``: docs is a plain scan of files."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held_out = _remainder(5) == 1 if held_out is None else held_out
    size = docs.select(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    buckets, tasks = max(partitions, -(-size // bucket_bytes)), max(partitions, -(-size // TASK_BYTES))
    rows = marked(docs, F.coalesce(held_out, F.lit(False)), from_files, tasks)
    folder = new_folder(spark, "lm-counts")
    sums = forward(rows, buckets, chunk_bytes).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWER)
    sums.write.option("compression", "zstd").parquet(folder)
    stored = spark.read.schema(ANSWER).parquet(folder)
    total = stored.where("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "kept_n", "kept_v")]).first()
    answers = stored.where("chunk is not null").select("chunk", "bucket", "deleted", "every", "kept")
    texts = with_chunks(rows, chunk_bytes)

    found = (
        texts.where("deleted").select("chunk", "text").groupBy("chunk").cogroup(answers.where("deleted").select("chunk", "bucket", "kept").groupBy("chunk"))
        .applyInArrow(_combinations, "b bigint, p3 double, p2 double, word bigint, n bigint")
        .groupBy("b", "p3", "p2", "word")
        .agg(F.sum("n").alias("n"))
    )
    weights = learn_weights(materialize(found), total["kept_n"], total["kept_v"])
    n, v = total["n"], total["v"]

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        own = ChunkKeys(list(_words(texts["text"])))
        bucket, p3, p2, word = own.estimates(_counts_of(own, counts, "every"))
        w = weights[bucket]
        p = w[:, 0] * p3 + w[:, 1] * p2 + w[:, 2] * word / max(1, n) + w[:, 3] / (v + 1)
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "held_out": texts["held_out"],
                "n_tokens": pa.array(own.sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), own.starts), pa.int64()),
                "train_tokens": pa.array(np.full(len(own.sizes), n), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, own.starts)),
                "score": pa.array(np.add.reduceat(np.log10(p), own.starts)),
            }
        )

    return (
        texts.select("chunk", "doc_id", "held_out", "text").repartition(tasks, "chunk").groupBy("chunk")
        .cogroup(answers.select("chunk", "bucket", "every").repartition(tasks, "chunk").groupBy("chunk"))
        .applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    )
