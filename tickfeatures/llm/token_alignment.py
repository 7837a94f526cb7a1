"""Alignment of two tokenizers' ids, with corpus-wide counts of linked id pairs.

Side A is a byte-level BPE vocabulary (``tokenizers`` file) over a blank and the text; side
B is a piece vocabulary (``sentencepiece`` file), which adds that blank itself. A token is
the bytes it stands for; both sides cut the same bytes, so every stretch between two
neighbouring token ends of either side lies in one A and one B token: a *link*. Offsets
where tokens of both sides end cut the text into *groups*. Special tokens inside a text are
plain text. A text whose tokens do not spell it again has no tokens, like an empty one.

Counting. The first pass aligns every document and writes, per task and *shard* (a hash of
the A id), the distinct pairs and the number of documents that have each. A tree of unions
(``FAN_IN`` rows a node) gives each shard's distinct pairs, which get a minimal perfect
hash. A second tree turns the tasks' rows into dense count vectors indexed by the hash and
sums them. A shard's table keeps its pairs in slot order, so each lookup verifies its key;
all pairs of an A id lie in one shard, so its highest count is known there. The second pass
aligns the documents again and looks the counts up.

Scale. A shard has at most (A ids x B ids) / ``SHARDS`` pairs, whatever the input; common
pairs are one entry per task before any shuffle. The table is broadcast if it has at most
``MAX_BROADCAST_PAIRS`` pairs (34 MB); a larger one stays distributed: documents are dealt
into chunks of ``CHUNK_BYTES``, each chunk asks every shard for its distinct pairs and the
answers meet the chunk again. Both ways give the same rows (tested).

Results. Null and empty texts, and those not spelled again, have zero counts and empty
``groups``. Texts are taken whole: memory follows the longest text, a run of ``RUN_CHARS``
code points otherwise. Repeated rows each count as a document and each get a row; ties for
the highest count all count as best. A null doc_id stays null. An empty table gives no
rows. Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfeatures.session import materialize

from .dac import library_encoder, new_folder
from .folders import delete_folder
from .minimal_hash import MinimalHash
from .pretokens import Splitter, WordCache, ranges, vocabulary
from .text import code_hashes, mix, span_hashes

SHARDS = 64
FAN_IN = 16
RUN_CHARS = 2_000_000
MAX_HELD_PAIRS = 2_000_000
MAX_BROADCAST_PAIRS = 2_000_000
CHUNK_BYTES = 8 << 20

_PIECE_BLANK = "▁"
SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
TABLE = "shard int, hash binary, keys binary, counts binary, best binary"


class BytePieces:
    """Side A: pre-tokens of a byte-level BPE file, without special tokens."""

    def __init__(self, path: str):
        vocab = vocabulary(path)
        self.spelled, self.size = vocab.spelled, vocab.size
        self.starts = Splitter(path).starts
        self.cache = WordCache(library_encoder(path))


class BlankPieces:
    """Side B: pieces of a sentencepiece file. No piece has a blank behind another
    character (checked), so a text is cut before each run of blanks."""

    def __init__(self, path: str):
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._library.vocab_size()
        pieces = [self._library.id_to_piece(i) for i in range(self.size)]
        if any(_PIECE_BLANK in p.lstrip(_PIECE_BLANK) for p in pieces):
            raise ValueError(f"{path}: a piece spans a word end")
        self._blank = self._library.piece_to_id(_PIECE_BLANK)
        self.spelled = [bytes([int(p[3:5], 16)]) if self._library.is_byte(i) else p.replace(_PIECE_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.cache = WordCache(self._encode)

    @staticmethod
    def starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        blank = points == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        return start

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts a blank before a non-empty text
        found = [x if w != " " else [self._blank] for w, x in zip(words, self._library.encode([w[1:] for w in words], num_threads=1), strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(n.sum())), n


class Side:
    """Ids and byte lengths of a run of texts."""

    def __init__(self, pieces: BytePieces | BlankPieces):
        self._pieces = pieces
        self._bytes = np.frombuffer(b"".join(pieces.spelled), np.uint8)
        self._size = np.fromiter(map(len, pieces.spelled), np.int64, len(pieces.spelled))
        self._begin = np.cumsum(self._size) - self._size

    def encode(self, whole: str, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text."""
        at = np.flatnonzero(self._pieces.starts(points, offsets)) if len(points) else np.empty(0, np.int64)
        if not len(at):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(at[1:], len(points))
        ids, n = self._pieces.cache.lookup(span_hashes(code_hashes(points), at, ends), lambda some: [whole[a:b] for a, b in zip(at[some].tolist(), ends[some].tolist(), strict=True)])
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        return ids, np.diff(total[np.searchsorted(at, offsets)])

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self._size[ids]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self._bytes[ranges(self._begin[ids], self._size[ids])]


@dataclass
class Run:
    """Aligned texts: per text counts, and per link its text and pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    codes: np.ndarray
    pairs: np.ndarray  # distinct keys, uint64; codes index them
    text_of_link: np.ndarray
    ids: list[np.ndarray]  # of each side
    ending: np.ndarray  # of each side and link: its token ends with the link


def _sums(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    return np.diff(total[np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])])


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        a, b = BytePieces(byte_path), BlankPieces(piece_path)
        self._a, self._b, self.b_ids = Side(a), Side(b), b.size
        decimals = [b"%d," % i for i in range(max(a.size, b.size))]
        self._decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self._width = np.fromiter(map(len, decimals), np.int64, len(decimals))
        self._at = np.cumsum(self._width) - self._width

    def runs(self, texts: list[str | None]) -> Iterator[tuple[int, Run]]:
        """(rows, their alignment) for runs of rows of bounded size."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(" " + t if t else "")
            size += len(held[-1])
            if size >= RUN_CHARS:
                yield len(held), self._align(held)
                held, size = [], 0
        if held:
            yield len(held), self._align(held)

    def _align(self, texts: list[str]) -> Run:
        n = len(texts)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, texts), np.int64, n))])
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(whole.encode(), np.uint8)
        wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        size = _sums(wide, np.diff(offsets))
        ids, per_text = zip(*(s.encode(whole, points, offsets) for s in (self._a, self._b)), strict=True)
        good = self._spelled_again(raw, size, ids, per_text)
        if not good.all():
            ids = [i[np.repeat(good, p)] for i, p in zip(ids, per_text, strict=True)]
            per_text = [np.where(good, p, 0) for p in per_text]
            size = np.where(good, size, 0)
        ends = [np.cumsum(s.sizes(i)) for s, i in zip((self._a, self._b), ids, strict=True)]
        total = int(size.sum())
        marks = np.zeros((2, total + 1), bool)
        marks[0][ends[0]] = True
        marks[1][ends[1]] = True
        links = np.flatnonzero(marks[0] | marks[1])
        ending = marks[:, links]
        # a link lies in the token behind the ends before it
        token = [np.cumsum(e) - e for e in ending]
        key = ids[0][token[0]].astype(np.uint64) * np.uint64(self.b_ids) + ids[1][token[1]].astype(np.uint64)
        codes, pairs = pd.factorize(key)
        last = np.cumsum(size)
        n_groups, n_links = (np.diff(np.searchsorted(where, last, "right"), prepend=0) for where in (links[ending.all(0)], links))
        return Run(per_text[0], per_text[1], n_groups, n_links, codes, pairs, np.repeat(np.arange(n), n_links), ids, ending)

    def _spelled_again(self, raw: np.ndarray, size: np.ndarray, ids: tuple, per_text: tuple) -> np.ndarray:
        """Of each text: both sides' tokens join to its bytes."""
        good = np.ones(len(size), bool)
        stop = np.cumsum(size)
        for side, i, p in zip((self._a, self._b), ids, per_text, strict=True):
            spelled, own = side.spell(i), _sums(side.sizes(i), p)
            good &= own == size
            if len(spelled) == len(raw) and good.all():
                wrong = np.flatnonzero(spelled != raw)
                good[np.searchsorted(stop, wrong, "right")] = False
            else:
                to = np.cumsum(own)
                for k in np.flatnonzero(good).tolist():
                    good[k] = np.array_equal(spelled[to[k] - own[k] : to[k]], raw[stop[k] - size[k] : stop[k]])
        return good

    def groups(self, run: Run) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids of the groups' A and B tokens in order."""
        both = run.ending.all(0)
        done = np.cumsum(both) - both
        tokens = [np.cumsum(e)[both] for e in run.ending]  # up to each group's end
        group = [done[e] for e in run.ending]  # of each token
        before = np.concatenate([np.zeros(1, np.int64), tokens[0]]), np.concatenate([np.zeros(1, np.int64), tokens[1]])
        spelling = np.empty(len(run.ids[0]) + len(run.ids[1]), np.int64)
        spelling[np.arange(len(run.ids[0])) + before[1][group[0]]] = run.ids[0]
        spelling[np.arange(len(run.ids[1])) + before[0][group[1] + 1]] = run.ids[1]
        width = self._width[spelling]
        text = self._decimals[ranges(self._at[spelling], width)]
        stop = np.cumsum(width)
        text[stop[tokens[0] + before[1][:-1] - 1] - 1] = ord("|")
        text[stop[tokens[0] + tokens[1] - 1] - 1] = ord(";")
        whole = text.tobytes().decode("ascii")
        ends = np.concatenate([np.zeros(1, np.int64), stop])[np.cumsum(run.n_a + run.n_b)].tolist()
        return [whole[a : b - 1] if b > a else "" for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """This worker's aligner; tasks of a reused worker share its word caches."""
    if (byte_path, piece_path) not in _aligners:
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


def shard_of(pairs: np.ndarray, b_ids: int, shards: int) -> np.ndarray:
    return (mix(pairs // np.uint64(b_ids), 41) % np.uint64(shards)).astype(np.int64)


def by_shard(pairs: np.ndarray, b_ids: int, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in ``pairs``) of the shards that occur."""
    shard = shard_of(pairs, b_ids, shards)
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, order[at[k] : at[k + 1]]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(code, np.concatenate(counts), len(distinct)).astype(np.int64)


def document_counts(run: Run) -> np.ndarray:
    """In how many texts of the run each pair is linked."""
    cells = pd.unique(run.text_of_link.astype(np.int64) * max(1, len(run.pairs)) + run.codes)
    return np.bincount(cells % max(1, len(run.pairs)), minlength=len(run.pairs)).astype(np.int64)


def first_pass(docs: DataFrame, byte_path: str, piece_path: str, shards: int) -> DataFrame:
    """``shard, task, keys, counts``: distinct pairs of each task, sorted, and their documents."""

    def flush(keys: np.ndarray, counts: np.ndarray, b_ids: int) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for shard, at in by_shard(keys, b_ids, shards):
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "task": pa.array([task], pa.int64()), "keys": pa.array([keys[at].tobytes()], pa.binary()), "counts": pa.array([counts[at].tobytes()], pa.binary())}
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_path, piece_path)
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, found in tool.runs(batch.column(0).to_pylist()):
                keys.append(found.pairs.astype(np.uint64))
                counts.append(document_counts(found))
                held += len(found.pairs)
                if held > MAX_HELD_PAIRS:
                    k, c = merged(keys, counts)
                    if 2 * len(k) > MAX_HELD_PAIRS:
                        yield from flush(k, c, tool.b_ids)
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [c], len(k)
        if held:
            yield from flush(*merged(keys, counts), tool.b_ids)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "shard int, task bigint, keys binary, counts binary")


def _column(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table[name].to_pylist()]


def _tree(rows: DataFrame, tasks: int, column: str, join: Callable[[list[np.ndarray]], np.ndarray], kind: str) -> DataFrame:
    """``shard, task, column`` rows joined ``FAN_IN`` at a time until each shard has one."""

    def node(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), column: pa.array([join(_column(table, column, kind)).tobytes()], pa.binary())})

    while True:
        tasks = -(-tasks // FAN_IN)
        rows = rows.select("shard", F.expr(f"task div {FAN_IN}").alias("task"), column).groupBy("shard", "task").applyInArrow(node, f"shard int, task bigint, {column} binary")
        if tasks <= 1:
            return rows


def _spread(shards: DataFrame, branches: int) -> DataFrame:
    """Each shard's row once per branch."""
    return shards.withColumn("branch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(branches - 1).cast("bigint"))))


def piece_ids(path: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()


def pair_shards(docs: DataFrame, byte_path: str, piece_path: str, shards: int = SHARDS) -> tuple[DataFrame, int]:
    """The distributed pair table (one row per shard) and its number of pairs."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-pairs")
    first_pass(docs, byte_path, piece_path, shards).write.parquet(folder)
    partial = spark.read.schema("shard int, task bigint, keys binary, counts binary").parquet(folder)
    tasks = (partial.agg(F.max("task")).first()[0] or 0) + 1

    def union(keys: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate(keys))

    def hashed(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(table["keys"][0].as_py(), np.uint64)
        perfect = MinimalHash.build(keys)
        ordered = np.empty_like(keys)
        ordered[perfect.slots(keys)] = keys
        return pa.table({"shard": table["shard"], "hash": pa.array([perfect.to_bytes()], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary())})

    hashes = materialize(_tree(partial.drop("counts"), tasks, "keys", union, "<u8").groupBy("shard").applyInArrow(hashed, "shard int, hash binary, keys binary"))
    branches = -(-tasks // FAN_IN)

    def dense(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        """One branch's rows as a count vector in slot order."""
        if not rows.num_rows:  # the shard's hash went to a branch without rows of it
            return pa.table({"shard": pa.array([], pa.int32()), "task": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        perfect = MinimalHash.from_bytes(known["hash"][0].as_py())
        vector = np.zeros(perfect.size, np.int64)
        for keys, counts in zip(_column(rows, "keys", "<u8"), _column(rows, "counts", "<i8"), strict=True):
            vector[perfect.slots(keys)] += counts  # a row's keys are distinct
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([vector.tobytes()], pa.binary())})

    branched = partial.withColumn("branch", F.expr(f"task div {FAN_IN}")).groupBy("shard", "branch")
    vectors = branched.cogroup(_spread(hashes.select("shard", "hash"), branches).groupBy("shard", "branch")).applyInArrow(dense, "shard int, task bigint, counts binary")
    if branches > 1:
        vectors = _tree(vectors, branches, "counts", lambda found: np.sum(found, axis=0), "<i8")
    b_ids = piece_ids(piece_path)

    def finished(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = _column(known, "keys", "<u8")[0], _column(rows, "counts", "<i8")[0]
        a = keys // np.uint64(b_ids)
        order = np.argsort(a, kind="stable")
        edge = np.flatnonzero(np.concatenate([np.ones(1, bool), a[order][1:] != a[order][:-1]]))
        highest = np.empty(len(a), np.int64)
        highest[order] = np.repeat(np.maximum.reduceat(counts[order], edge), np.diff(np.append(edge, len(a))))
        return pa.table({"shard": known["shard"], "hash": known["hash"], "keys": known["keys"], "counts": rows["counts"], "best": pa.array([(counts == highest).tobytes()], pa.binary())})

    table = materialize(vectors.groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(finished, TABLE))
    delete_folder(spark, folder)
    return table, int(table.agg(F.sum(F.octet_length("counts"))).first()[0] or 0) // 8


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``a, b, n_documents, best`` of every pair linked in ``docs``."""
    table, _ = pair_shards(docs, byte_path, piece_path)
    b_ids = piece_ids(piece_path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in pa.Table.from_batches([batch]).to_pylist():
                keys = np.frombuffer(shard["keys"], "<u8").astype(np.int64)
                yield pa.RecordBatch.from_pydict({"a": keys // b_ids, "b": keys % b_ids, "n_documents": np.frombuffer(shard["counts"], "<i8"), "best": pa.array(np.frombuffer(shard["best"], bool))})

    return table.mapInArrow(rows, "a bigint, b bigint, n_documents bigint, best boolean")


class PairTable:
    """Counts of pairs by minimal perfect hash, from some or all shards."""

    def __init__(self, rows: list[dict], b_ids: int, shards: int):
        self._b_ids, self._shards = b_ids, shards
        self._raw = {r["shard"]: r for r in rows}
        self._ready: dict[int, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    def _shard(self, shard: int) -> tuple:
        if shard not in self._ready:
            r = self._raw[shard]
            self._ready[shard] = (MinimalHash.from_bytes(r["hash"]), np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["best"], bool))
        return self._ready[shard]

    def lookup(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and best mark of each pair; every key is verified."""
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        for shard, at in by_shard(pairs, self._b_ids, self._shards):
            perfect, keys, counts, marks = self._shard(shard)
            slot = perfect.slots(pairs[at])
            if (slot < 0).any() or (keys[slot] != pairs[at]).any():
                raise KeyError("a pair is not in the table: the documents changed between the passes")
            count[at], best[at] = counts[slot], marks[slot]
        return count, best


def _rows(tool: Aligner, found: Run, doc_ids: pa.Array, count: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    n = len(found.n_a)
    of_link = found.text_of_link
    per_text = [np.bincount(of_link, x, n).astype(np.int64) for x in (best[found.codes], count[found.codes])]  # exact below 2**53
    columns = [doc_ids, *(pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links, *per_text)), pa.array(tool.groups(found), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, shards: int = SHARDS, max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups``. n_best: links whose pair has the highest count of its A id."""
    table, pairs = pair_shards(docs, byte_path, piece_path, shards)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    b_ids = piece_ids(piece_path)
    if pairs > max_broadcast:
        return _by_exchange(rows, table, byte_path, piece_path, b_ids, shards)
    # at most max_broadcast pairs of 17 bytes and their hash
    shared = docs.sparkSession.sparkContext.broadcast(PairTable([r.asDict() for r in table.collect()], b_ids, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = aligner(byte_path, piece_path), shared.value
        for batch in batches:
            at = 0
            for n, found in tool.runs(batch.column(1).to_pylist()):
                yield _rows(tool, found, batch.column(0).slice(at, n), *known.lookup(found.pairs.astype(np.uint64)))
                at += n

    return rows.mapInArrow(run, SCHEMA)


def _by_exchange(rows: DataFrame, table: DataFrame, byte_path: str, piece_path: str, b_ids: int, shards: int) -> DataFrame:
    """The second pass against a table that stays distributed. Equal rows are taken once."""
    distinct = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(-(-size // CHUNK_BYTES)) or 1
    dealt = distinct.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def aligned(texts: pa.Table) -> list[tuple[int, Run]]:
        ordered = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return list(aligner(byte_path, piece_path).runs(ordered["text"].to_pylist()))

    def asked(found: list[tuple[int, Run]]) -> np.ndarray:
        return np.unique(np.concatenate([f.pairs.astype(np.uint64) for _, f in found]))

    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        pairs = asked(aligned(texts))
        parts = list(by_shard(pairs, b_ids, shards))
        n = len(parts)
        return pa.table({"chunk": pa.array([key[0].as_py()] * n, pa.int64()), "shard": pa.array([k for k, _ in parts], pa.int32()), "keys": pa.array([pairs[at].tobytes() for _, at in parts], pa.binary())})

    def answer(asks: pa.Table, shard: pa.Table) -> pa.Table:
        if not asks.num_rows:  # the table's shard went to a branch that does not ask it
            return pa.table({"chunk": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("keys", "counts", "best")}})
        known = PairTable(shard.to_pylist(), b_ids, shards)
        found = [known.lookup(k) for k in _column(asks, "keys", "<u8")]
        return pa.table({"chunk": asks["chunk"], "keys": asks["keys"], "counts": pa.array([c.tobytes() for c, _ in found], pa.binary()), "best": pa.array([b.tobytes() for _, b in found], pa.binary())})

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tool = aligner(byte_path, piece_path)
        keys = np.concatenate([np.empty(0, np.uint64), *_column(answers, "keys", "<u8")])
        counts = np.concatenate([np.empty(0, np.int64), *_column(answers, "counts", "<i8")])
        best = np.concatenate([np.empty(0, bool), *_column(answers, "best", "?")])
        order = np.argsort(keys)
        ordered = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        out, at = [], 0
        for n, found in aligned(texts):
            place = order[np.searchsorted(keys, found.pairs, sorter=order)] if len(keys) else np.empty(0, np.int64)
            out.append(_rows(tool, found, ordered["doc_id"].combine_chunks().slice(at, n), counts[place], best[place]))
            at += n
        return pa.Table.from_batches(out).append_column("copies", ordered["copies"].combine_chunks())

    asks = materialize(dealt.select("chunk", "doc_id", "text").groupBy("chunk").applyInArrow(ask, "chunk bigint, shard int, keys binary"))
    branched = asks.withColumn("branch", F.expr(f"chunk div {SHARDS}"))  # at most SHARDS chunks ask one task
    answers = branched.groupBy("shard", "branch").cogroup(_spread(table, -(-chunks // SHARDS)).groupBy("shard", "branch")).applyInArrow(answer, "chunk bigint, keys binary, counts binary, best binary")
    done = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, SCHEMA + ", copies bigint")
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies", "copy")

