"""Token ids in files of directly addressable codes.

A segment stores the ids of consecutive documents. Ids are cut into 8-bit chunks, lowest
first; level k holds the k-th chunk of every id that has one, and a bitmap says which of
them continue on the next level. A rank directory (set bits before every 512th bit) maps
a position to its position on the next level, so any id, and any range, is read without
decoding the ids before it.

Segment layout (little endian): ``b"DAC1"``, uint32 levels, uint64 ids; then per level
uint64 chunks, the chunks, the bitmap padded to whole 64-byte blocks, and uint32 ranks
(one per block). The last level has no continuing chunk.

Files are Parquet rows written and read by Spark (one row is one segment), so that they
live in any store Spark writes to. Rows are ordered by (part, segment); within them the
documents ascend by (doc_id, hash of the text), a null doc_id first. Equal rows are each
written. A null or empty text is written as its end id alone. A very long text is encoded
whole: a segment ends only after a run of whole documents, so it may pass ``SEGMENT_IDS`` by
one run, and a task holds one segment. Documents of equal doc_id and text are
interchangeable; equal text hashes of one doc_id keep the order that the sort gives them. An
empty table gives an empty file set and no result rows. Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickfeatures.session import ensure_checkpoint_dir

from .pretokens import encoder

BLOCK_BITS = 512
SEGMENT_IDS = 1_000_000
FILE_SCHEMA = (
    "part int, segment int, first_doc_id bigint, n_documents bigint, n_ids bigint, doc_ids binary, doc_null binary, doc_lengths binary, payload binary"
)


def pack(ids: np.ndarray) -> bytes:
    """The segment of these ids."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = -(-len(more) // BLOCK_BITS)
        bits = np.concatenate([bits, np.zeros(blocks * BLOCK_BITS // 8 - len(bits), np.uint8)])
        counts = np.bitwise_count(bits).reshape(blocks, BLOCK_BITS // 8).sum(1, dtype=np.uint32)
        ranks = np.cumsum(counts, dtype=np.uint32) - counts
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint64(255)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> np.uint64(8)
        if not len(rest):
            return struct.pack("<4sIQ", b"DAC1", len(levels), len(ids)) + b"".join(levels)


class Segment:
    """Random access to a packed segment."""

    def __init__(self, raw: bytes):
        magic, levels, self.size = struct.unpack_from("<4sIQ", raw)
        if magic != b"DAC1":
            raise ValueError("not a segment")
        at, self._levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            blocks = -(-n // BLOCK_BITS)
            at += 8
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += n
            bits = np.frombuffer(raw, np.uint8, blocks * BLOCK_BITS // 8, at)
            at += len(bits)
            ranks = np.frombuffer(raw, "<u4", blocks, at)
            at += 4 * blocks
            self._levels.append((chunks, bits, ranks))

    def _rank(self, level: int, position: int) -> int:
        """Set bits before a position of a level's bitmap."""
        _, bits, ranks = self._levels[level]
        if not len(ranks):
            return 0
        block = min(position // BLOCK_BITS, len(ranks) - 1)
        n = int(ranks[block]) + int(np.bitwise_count(bits[block * BLOCK_BITS // 8 : position // 8]).sum())
        if position % 8:
            n += (int(bits[position // 8]) & ((1 << position % 8) - 1)).bit_count()
        return n

    def access(self, position: int) -> int:
        """The id at a position."""
        if not 0 <= position < self.size:
            raise IndexError(position)
        value = 0
        for k, (chunks, bits, _) in enumerate(self._levels):
            value |= int(chunks[position]) << 8 * k
            if not bits[position // 8] >> position % 8 & 1:
                break
            position = self._rank(k, position)
        return value

    def read(self, begin: int, end: int) -> np.ndarray:
        """The ids of a range; only the ranges that belong to it are touched on each level."""
        out = np.zeros(max(0, end - begin), np.uint64)
        where = np.arange(len(out))
        for k, (chunks, bits, _) in enumerate(self._levels):
            if not len(where):
                break
            out[where] |= chunks[begin:end].astype(np.uint64) << np.uint64(8 * k)
            more = np.unpackbits(bits[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 : begin % 8 + end - begin].astype(bool)
            where = where[more]
            begin, end = self._rank(k, begin), self._rank(k, end)
        return out.astype(np.int64)


def library_encoder(path: str):
    """Ids of separate pre-tokens by the tokenizers library."""
    library = Tokenizer.from_file(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, lengths = [], []
        for at in range(0, len(words), 20_000):
            got = [e.ids for e in library.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            found.append(np.fromiter((i for x in got for i in x), np.int32, int(n.sum())))
            lengths.append(n)
        return (np.concatenate(found), np.concatenate(lengths)) if found else (np.empty(0, np.int32), np.empty(0, np.int64))

    return encode


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 2, parts: int | None = None) -> None:
    """Encode ``doc_id, text`` rows and write their segments to ``folder``.

    One range shuffle orders the documents; the range key includes the text's hash, so
    that even one repeated doc_id is spread over parts."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, "tokenizers", lambda: library_encoder(tokenizer_path))
        part, segment = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            at = 0
            for n, ids, lengths in coder.encode(batch.column(1).to_pylist()):
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                held.append((batch.column(0).slice(at, n), ids, lengths))
                at += n
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield _segment_row(part, segment, held)
                    held, size, segment = [], 0, segment + 1
        if held:
            yield _segment_row(part, segment, held)

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "_tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(folder)


def _segment_row(part: int, segment: int, held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys = pa.concat_arrays([h[0] for h in held])
    ids = np.concatenate([h[1] for h in held])
    lengths = np.concatenate([h[2] for h in held])
    row = {
        "part": pa.array([part], pa.int32()),
        "segment": pa.array([segment], pa.int32()),
        "first_doc_id": pa.array([keys[0].as_py()], pa.int64()),
        "n_documents": pa.array([len(keys)], pa.int64()),
        "n_ids": pa.array([len(ids)], pa.int64()),
        "doc_ids": pa.array([keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
        "doc_null": pa.array([np.packbits(keys.is_null().to_numpy(zero_copy_only=False)).tobytes()], pa.binary()),
        "doc_lengths": pa.array([lengths.astype("<i8").tobytes()], pa.binary()),
        "payload": pa.array([pack(ids)], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(row)


def _directory(batch: pa.RecordBatch, row: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_id, first position and number of ids of a segment's documents."""
    ids, null, lengths = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("doc_ids", "<i8"), ("doc_null", np.uint8), ("doc_lengths", "<i8")))
    unknown = np.unpackbits(null)[: len(lengths)].astype(bool)
    return pa.array(ids, pa.int64(), mask=unknown), np.cumsum(lengths) - lengths, lengths


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the documents in the files whose doc_id is among ``wanted`` (doc_id; a
    null asks for null ids), a row for each such document; ids asked for twice count once.

    First the documents' places are found without reading a payload; then only the segments
    asked for are read, and in them only the range of each document, through the rank
    directories. A segment's list of places is never longer than its documents. Further
    columns of ``wanted`` are not read; an id that no file has gives no row."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    place = "part int, segment int, doc_id bigint, begin bigint, n bigint"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, begins, lengths = _directory(batch, row)
                at = [pa.array(np.full(len(ids), batch.column(c)[row].as_py()), pa.int32()) for c in ("part", "segment")]
                yield pa.RecordBatch.from_arrays([*at, ids, pa.array(begins, pa.int64()), pa.array(lengths, pa.int64())], names=["part", "segment", "doc_id", "begin", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                stored, hits = Segment(batch.column("payload")[row].as_buffer().to_pybytes()), batch.column("hits")[row].as_py()
                found = [stored.read(h["begin"], h["begin"] + h["n"]).astype(np.int32) for h in hits]
                yield pa.RecordBatch.from_arrays([pa.array([h["doc_id"] for h in hits], pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    asked = wanted.select(F.col("doc_id").cast("bigint").alias("asked")).distinct()
    held = files.select("part", "segment", "doc_ids", "doc_null", "doc_lengths").mapInArrow(places, place)
    hits = held.join(asked, F.col("doc_id").eqNullSafe(F.col("asked"))).groupBy("part", "segment").agg(F.sort_array(F.collect_list(F.struct("begin", "n", "doc_id"))).alias("hits"))
    return files.select("part", "segment", "payload").join(hits, ["part", "segment"]).select("payload", "hits").mapInArrow(read, "doc_id bigint, ids array<int>")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids before it), ``n_tokens``,
    ``ids_crc32`` and, on request, ``ids``. Segments are read whole, as every document is
    asked for; ``lookup`` reads some of them by their ranges. Only one row per segment takes part in the running sum, first within a part and
    then over the parts' totals; the payload is not shuffled."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part")).join(totals, "part")
    starts = starts.select("part", "segment", (F.col("part_start") + F.col("in_part")).alias("base"))

    schema = "part int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {k: batch.column(i)[row] for i, k in enumerate(batch.schema.names)}
                stored = Segment(get["payload"].as_buffer().to_pybytes())
                lengths = np.frombuffer(get["doc_lengths"].as_buffer(), "<i8")
                n = len(lengths)
                null = np.unpackbits(np.frombuffer(get["doc_null"].as_buffer(), np.uint8))[:n].astype(bool)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                whole = stored.read(0, stored.size).astype("<u4")  # all documents of the segment are asked for
                ids = [whole[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(n, get["part"].as_py()), pa.int32()),
                    pa.array(np.full(n, get["segment"].as_py()), pa.int32()),
                    pa.array(np.frombuffer(get["doc_ids"].as_buffer(), "<i8"), pa.int64(), mask=null),
                    pa.array(begins, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    found = files.select("part", "segment", "doc_ids", "doc_null", "doc_lengths", "payload").mapInArrow(run, schema)
    return found.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
