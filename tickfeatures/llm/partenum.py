"""Exact Jaccard self-join of shingle sets by PartEnum signatures.

Two texts link when the Jaccard similarity of their sets of five-word shingles is at
least 0.8 (``PERCENT * union <= 100 * intersection``).

Signatures. Set sizes are cut into bands. In the instance of a band meet all sets of the
band and the greater sets (up to the next sizes / 0.8) that a set of the band can link
to, so linked sets of any sizes meet in one instance. There they differ in at most k
shingles (k follows from the threshold and the instance's greatest sizes). The shingle
domain is cut by a hash into n1 partitions and each of these into n2 parts; for each
partition every subset of n2 - k2 parts (k2 = 1) gives one signature: a hash of the set's
shingles in those parts. With d differing shingles in a partition at least 2 - d of its
signatures agree, so two sets that differ in at most k shingles share at least
2 * n1 - k signatures, and n1 > k / 2.

Empty projections. A signature of no shingle would be shared by unrelated sets and is
left out. A set with E empty signatures still shares ``need = 2 * n1 - k - E`` others with
each linked set. Where that is less than one, the set also emits the signatures of the
next of ``FAMILIES`` independent hash families, and those of the last family with the
empty ones. Of two linked sets, the one that stops first has its guarantee in a family
that both emit; so no link is lost.

Filter. A set whose shared signatures in an instance number less than its ``need`` has no
link there (exact, since signatures shared with a linked set are shared signatures).

Rare shingles. Sets with a few frequent passages in common (a repeated line, a licence)
share signatures enough for the filter, and all of a corpus hang together by them. So the
shingles of the sets that are left are ordered by the number of these sets that have them;
linked sets share one of the rarest shingles of either (the prefix filter of set joins,
exact). Frequent passages come last in this order, so only near copies are kept together.

Verification. Sets that share a rare shingle form candidate families (connected
components). Each family is cut by hash into blocks of about ``BLOCK`` sets or
``BLOCK_ELEMENTS`` shingles, whichever is less; each pair of blocks that share a rare shingle
is compared at once by a product of incidence matrices,
which gives exact intersections. Only links' spanning edges and link counts come out, so
no pair list is made; a large group of near copies is spread over many block pairs.

Copies. Equal shingle sets are one set from the start: a task emits a set's signatures
once however many copies it reads, and verification reads each set once.

Results. A null or empty text, or one without words, has the empty set, which links with
nothing. Rows are numbered by doc_id: repeated rows each get a row with the same class;
a row with a null doc_id gets the class of its set (null if no member has a doc_id).
A very long text is one set, whole; one beyond ``BLOCK_ELEMENTS`` has a block of its own, so
a task holds two such sets at most. Ties do not change classes, as the least doc_id names
them; ``one_per_class`` takes the least text hash among rows of one doc_id. An empty table
gives no rows. ``jaccard_classes`` ignores further columns, ``one_per_class`` keeps them,
whatever their names. Sets are equal by a 64-bit key of their shingles, so of n distinct
sets about n^2 / 2^65 pairs are taken for copies wrongly.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickfeatures.session import materialize, release

from .components import components
from .folders import unused
from .pretokens import ranges
from .text import bytes_of, mix, mix_int, pieces, set_key, shingle_sets, to_signed, word_hashes

PERCENT = 80
GROWTH = 1.6
FAMILIES = 6
BLOCK = 1536
BLOCK_ELEMENTS = 600_000
#: rows that signatures or shingles leave Python by
ROWS = 200_000
#: extra partitions, as a share of k: a linked pair then shares several signatures, not just one
SLACK = 0.08

_U = np.uint64


@lru_cache(maxsize=None)
def band(index: int) -> tuple[int, int]:
    """Least and greatest size of a band. Sets of fewer than 4 shingles only link when equal."""
    if index == 0:
        return 4, 5
    low = band(index - 1)[1] + 1
    return low, max(low + 1, int(low * GROWTH) - 1)


@lru_cache(maxsize=None)
def scheme(index: int) -> tuple[int, int, int, tuple[tuple[int, ...], ...]]:
    """k, n1, n2 and the subsets of parts for the instance of a band."""
    least = band(index)[1]
    greatest = 100 * least // PERCENT
    # |A ^ B| <= (100 - p) / (100 + p) * (|A| + |B|)
    k = (100 - PERCENT) * (least + greatest) // (100 + PERCENT)
    n2 = 3 if k <= 8 else 2
    n1 = k // 2 + 1 + int(SLACK * k)
    return k, n1, n2, tuple(itertools.combinations(range(n2), n2 - 1))


@lru_cache(maxsize=4096)
def instances(size: int) -> tuple[int, ...]:
    """The instances in which a set of this size takes part."""
    if size < 4:
        return ()
    own = 0
    while band(own)[1] < size:
        own += 1
    return tuple(i for i in range(max(0, own - 1), own + 1) if i == own or PERCENT * size <= 100 * band(i)[1])


class Projector:
    """Signature hashes of one set in any instance and family."""

    def __init__(self, elements: np.ndarray):
        self._elements = elements
        value = mix(elements, 2000)
        self._low, self._high = (value & _U(0xFFFFFFFF)).astype(np.float64), (value >> _U(32)).astype(np.float64)
        self._places: dict[int, np.ndarray] = {}

    def __call__(self, index: int, family: int) -> tuple[np.ndarray, np.ndarray]:
        """The signatures, and whether each is of no shingle."""
        _, n1, n2, subsets = scheme(index)
        parts = n1 * n2
        if family not in self._places:
            self._places[family] = mix(self._elements, 1000 + family) >> _U(32)
        part = (self._places[family] * _U(parts) >> _U(32)).astype(np.int64)
        # sums of up to 2**21 halves are exact in a double
        low = np.bincount(part, self._low, parts).astype(np.uint64).reshape(n1, n2)
        high = np.bincount(part, self._high, parts).astype(np.uint64).reshape(n1, n2)
        count = np.bincount(part, minlength=parts).reshape(n1, n2)
        found, empty = [], []
        for i, subset in enumerate(subsets):
            x = sum(low[:, j] for j in subset) * _U(0x9E3779B97F4A7C15) + sum(high[:, j] for j in subset)
            found.append(mix(x ^ salts(index, family, i), 6000))
            empty.append(sum(count[:, j] for j in subset) == 0)
        return np.concatenate(found), np.concatenate(empty)


@lru_cache(maxsize=4096)
def salts(index: int, family: int, subset: int) -> np.ndarray:
    """A salt for each partition of an instance, family and subset."""
    n1 = scheme(index)[1]
    return mix(np.arange(n1, dtype=np.uint64) + _U(mix_int((index * FAMILIES + family) * 8 + subset, 4000)), 5000)


def signatures(elements: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(tag, signatures) of a set; tag = instance * 2**20 + need, need 0 where no filter holds."""
    project = Projector(elements)
    for index in instances(len(elements)):
        k, n1, _, _ = scheme(index)
        for family in range(FAMILIES):
            found, empty = project(index, family)
            need = 2 * n1 - k - int(empty.sum())
            last = family + 1 == FAMILIES and need < 1
            yield (index << 20) + (max(0, need) if family == 0 else 0), found if last else found[~empty]
            if need >= 1:
                break


def _freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives the memory of its batches back: it idles beside
    later stages of its executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = bytes_of(texts)
    for a, b in pieces(offsets):
        words, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield from shingle_sets(words, first)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tie``: the tie tells apart texts of a repeated doc_id."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("tie", F.coalesce(F.xxhash64("text"), F.lit(0)))


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, n_shingles, set_id`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_key(s)) for s in _sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([n for n, _ in sets], pa.int64()), pa.array([k for _, k in sets], pa.int64())],
                names=["doc_id", "tie", "n_shingles", "set_id"],
            )

    return _keyed(docs).mapInArrow(_freed(run), "doc_id bigint, tie bigint, n_shingles bigint, set_id bigint")


def signature_rows(docs: DataFrame) -> DataFrame:
    """``sig, set_id, tag``; each task emits a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        owners: list[tuple[int, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = [o[2] for o in owners]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(sigs).view(np.int64)),
                    pa.array(np.repeat(np.array([o[0] for o in owners], np.int64), n)),
                    pa.array(np.repeat(np.array([o[1] for o in owners], np.int32), n)),
                ],
                names=["sig", "set_id", "tag"],
            )

        for batch in batches:
            for elements in _sets(batch.column(0)):
                key = set_key(elements)
                if len(elements) < 4 or key in seen:
                    continue
                seen.add(key)
                for tag, found in signatures(elements):
                    sigs.append(found)
                    owners.append((key, tag, len(found)))
                    size += len(found)
                if size >= ROWS:
                    yield flush()
                    sigs, owners, size = [], [], 0
        if owners:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_freed(run), "sig bigint, set_id bigint, tag int")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of signatures that at least two sets have, with the least such set."""
    by = Window.partitionBy("sig")
    return rows.withColumn("lo", F.min("set_id").over(by)).withColumn("hi", F.max("set_id").over(by)).where("lo <> hi").drop("hi")


def candidates(docs: DataFrame) -> DataFrame:
    """``sig, set_id, lo`` rows of sets that may link (checkpointed).

    Three exchanges: by signature, by set for the filter, by signature again; copies from
    several tasks are dropped inside the signature's partition."""
    live = materialize(_shared(signature_rows(docs)).drop("lo").dropDuplicates(["sig", "set_id", "tag"]))
    release(docs.sparkSession)  # the signatures' exchange is the largest
    need = F.col("tag").bitwiseAND(F.lit((1 << 20) - 1))
    kept = live.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("set_id", "tag"))).where(F.col("n") >= need)
    return materialize(_shared(kept.select("sig", "set_id")).dropDuplicates(["sig", "set_id"]))


class Block:
    """Sets of a block: a dictionary of their distinct shingles and, for each set in turn,
    the places of its shingles in the dictionary."""

    def __init__(self, dictionary: np.ndarray, places: np.ndarray, sizes: np.ndarray):
        self.dictionary, self.places, self.sizes = dictionary, places, sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Block:
        dictionary, places = np.unique(np.concatenate(sets), return_inverse=True)
        return cls(dictionary, places.astype(np.int32), np.array([len(s) for s in sets], np.int32))

    def columns(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, column) of the shingles at the wanted places of the dictionary, by column."""
        number = np.full(len(self.dictionary), -1, np.int64)
        number[wanted] = np.arange(len(wanted))
        column = number[self.places]
        kept = column >= 0
        owner, column = self.owner[kept], column[kept]
        order = np.argsort(column, kind="stable")
        return owner[order], column[order]


class Incidence:
    """(set, column) entries of the shared shingles of a block, by column."""

    def __init__(self, block: Block, places: np.ndarray):
        self.sets = len(block.sizes)
        self.owner, self.column = block.columns(places)
        self.count = np.bincount(self.column, minlength=len(places))
        self.start = np.cumsum(self.count) - self.count

    def dense(self, columns: np.ndarray) -> np.ndarray:
        length = self.count[columns]
        entries = ranges(self.start[columns], length)
        m = np.zeros((self.sets, len(columns)), np.float32)
        m[self.owner[entries], np.repeat(np.arange(len(columns)), length)] = 1.0
        return m


#: columns whose entries make more pairs than this go through a matrix product, the others are counted pair by pair
DENSE_PAIRS, DENSE_WIDTH, COUNTED_PAIRS = 4000, 1024, 1_000_000


def intersections(a: Incidence, b: Incidence) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks."""
    pairs = a.count * b.count
    total = np.zeros((a.sets, b.sets), np.float32)
    heavy = np.flatnonzero(pairs > DENSE_PAIRS)
    for at in range(0, len(heavy), DENSE_WIDTH):
        columns = heavy[at : at + DENSE_WIDTH]
        x = a.dense(columns)
        total += x @ (x if a is b else b.dense(columns)).T  # whole numbers below 2**24: exact
    light = np.flatnonzero((pairs > 0) & (pairs <= DENSE_PAIRS))
    for columns in np.split(light, np.searchsorted(np.cumsum(pairs[light]), np.arange(COUNTED_PAIRS, int(pairs[light].sum()), COUNTED_PAIRS))):
        mine = ranges(a.start[columns], a.count[columns])
        others = b.count[a.column[mine]]
        theirs = ranges(b.start[a.column[mine]], others)
        cell = np.repeat(a.owner[mine], others) * b.sets + b.owner[theirs]
        if 8 * len(cell) < total.size:
            np.add.at(total.reshape(-1), cell, np.float32(1))
        else:
            total += np.bincount(cell, minlength=total.size).reshape(total.shape)
    return total.astype(np.int64)


def linked_pairs(a: Block, b: Block | None) -> np.ndarray:
    """Index pairs (i, j) of linked sets of two blocks; i < j within one block (b None)."""
    if b is None:
        shared = np.flatnonzero(np.bincount(a.places, minlength=len(a.dictionary)) > 1)
        x = y = Incidence(a, shared)
    else:
        _, in_a, in_b = np.intersect1d(a.dictionary, b.dictionary, assume_unique=True, return_indices=True)
        x, y = Incidence(a, in_a), Incidence(b, in_b)
    common = intersections(x, y)
    union = a.sizes[:, None].astype(np.int64) + (a if b is None else b).sizes[None, :] - common
    linked = 100 * common >= PERCENT * union
    return np.argwhere(np.triu(linked, 1) if b is None else linked)


def _spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that join different parts, in order: a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in pairs:
        if (rx := find(x)) != (ry := find(y)):
            root[rx] = ry
            kept.append((x, y))
    return kept


BLOCK_ROW = "block bigint, set_ids array<bigint>, copies array<bigint>, dictionary binary, places binary, sizes binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from their lists of sets."""
    for batch in batches:
        for row in range(batch.num_rows):
            sets = batch.column(1)[row].values
            made = Block.of([np.frombuffer(e.as_buffer(), np.uint64) for e in sets.field("elements")])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, 1),
                    pa.ListArray.from_arrays([0, len(sets)], sets.field("set_id")),
                    pa.ListArray.from_arrays([0, len(sets)], sets.field("copies")),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (made.dictionary, made.places, made.sizes)),
                ],
                names=[c.split()[0] for c in BLOCK_ROW.split(", ")],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, links): a spanning link, or (x, null, links): copies of the texts that
    set x links with in this pair of blocks."""

    def read(row: dict | None) -> Block | None:
        if row is None:
            return None
        return Block(np.frombuffer(row["dictionary"], np.uint64), np.frombuffer(row["places"], np.int32), np.frombuffer(row["sizes"], np.int32))

    for batch in batches:
        x, y, n = [], [], []
        for i in range(batch.num_rows):
            a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            found = linked_pairs(read(a), read(b))
            if not len(found):
                continue
            b = b or a
            ia, ib = found[:, 0], found[:, 1]
            keys_a, keys_b = np.array(a["set_ids"]), np.array(b["set_ids"])
            for p, q in _spanning(list(zip(keys_a[ia].tolist(), keys_b[ib].tolist(), strict=True))):
                x.append(p)
                y.append(q)
                n.append(0)
            for keys, at, other in ((keys_a, ia, np.array(b["copies"])[ib]), (keys_b, ib, np.array(a["copies"])[ia])):
                links = np.bincount(at, other, len(keys)).astype(np.int64)
                for p in np.flatnonzero(links).tolist():
                    x.append(int(keys[p]))
                    y.append(None)
                    n.append(int(links[p]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64())], names=["x", "y", "links"])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a < b of blocks that share a rare shingle, from (sig, block) rows in order of
    sig; each pair once per task."""
    seen: set[tuple[int, int]] = set()
    sig, blocks = None, []

    def pairs() -> pa.RecordBatch:
        new = [p for p in itertools.combinations(sorted(blocks), 2) if p not in seen]
        seen.update(new)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])

    for batch in batches:
        for s, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != sig:
                if len(blocks) > 1:
                    yield pairs()
                sig, blocks = s, []
            blocks.append(block)
    if len(blocks) > 1:
        yield pairs()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(_sets(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "elements"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, set_id, n): each shingle of each set, with the set's size."""
    for batch in batches:
        keys, sizes = batch.column(0).to_numpy(), pc.binary_length(batch.column(1)).to_numpy() // 8
        for a, b in pieces(np.append(0, np.cumsum(sizes, dtype=np.int64)), ROWS):
            found = np.concatenate([np.frombuffer(e.as_buffer(), np.int64) for e in batch.column(1)[a:b]])
            of = np.repeat(np.arange(a, b), sizes[a:b])
            for at in range(0, len(found), ROWS):  # several times for a very long text
                own = of[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + ROWS]), pa.array(keys[own]), pa.array(sizes[own])], names=["sig", "set_id", "n"])


def rare_shingles(sets: DataFrame) -> DataFrame:
    """``sig, set_id, lo``: the shingles by which sets (set_id, elements) can link, and the
    least set that has each as such (checkpointed).

    Shingles are ordered by the number of sets that have them, the rarest first. Linked sets
    share at least ``PERCENT`` of each of them, so they share one of the first
    n - ceil(n * PERCENT / 100) + 1 of either; a shingle of one set only takes a place but
    links nothing. Sets that have no more in common than frequent passages part here."""
    n_sets = F.count(F.lit(1)).over(Window.partitionBy("sig"))
    known = sets.mapInArrow(_freed(_shingles), "sig bigint, set_id bigint, n int").withColumn("sets", n_sets).where("sets > 1")
    own = Window.partitionBy("set_id")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("sets", "sig"))
    first = known.withColumn("place", place).where(F.col("place") <= F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100") + 1)
    return materialize(_shared(first.select("sig", "set_id")))


def verified(docs: DataFrame, owners: DataFrame, shared: DataFrame) -> DataFrame:
    """``x, y, links`` rows (see ``_verify``) for all candidates, checkpointed."""
    # one document per set gives its shingles
    chosen = owners.join(shared.select("set_id").distinct(), "set_id").select(F.coalesce("owner.doc_id", F.lit(0)).alias("doc_id"), "owner.tie", "set_id")
    texts = _keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    sets = materialize(texts.join(chosen, ["doc_id", "tie"]).select("set_id", "text").dropDuplicates(["set_id"]).mapInArrow(_freed(_elements), "set_id bigint, elements binary"))
    release(docs.sparkSession)  # the exchange of the texts
    rare = rare_shingles(sets)
    release(docs.sparkSession)
    family = components(rare.select(F.col("set_id").alias("a"), F.col("lo").alias("b")))
    family = family.withColumnRenamed("node", "set_id").join(owners.select("set_id", "n_shingles"), "set_id")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_ELEMENTS))
    size = family.groupBy("component").agg(parts.alias("parts"))
    blocks = materialize(
        family.join(size, "component").select(
            "set_id", F.xxhash64("component", F.pmod(F.xxhash64("set_id"), "parts")).alias("block")
        )
    )
    grouped = materialize(
        sets.join(owners.select("set_id", "copies").join(blocks, "set_id"), "set_id")
        .groupBy("block")
        .agg(F.collect_list(F.struct("set_id", "copies", "elements")).alias("sets"))
        .mapInArrow(_freed(_pack), BLOCK_ROW)
    )
    members = rare.select("sig", "set_id").join(blocks, "set_id").select("sig", "block").repartition("sig").dropDuplicates(["sig", "block"])
    pairs = members.sortWithinPartitions("sig").mapInArrow(_freed(_block_pairs), "a bigint, b bigint").distinct()
    whole = F.struct("set_ids", "copies", "dictionary", "places", "sizes")
    left = grouped.select(F.col("block").alias("a"), whole.alias("block_a"))
    right = grouped.select(F.col("block").alias("b"), whole.alias("block_b"))
    between = pairs.join(left, "a").join(right, "b").select("block_a", "block_b")
    within = left.select("block_a", F.lit(None).cast(right.schema["block_b"].dataType).alias("block_b"))
    return materialize(within.union(between).mapInArrow(_freed(_verify), "x bigint, y bigint, links bigint"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one with the least doc_id (null last; then
    the least hash of the text), same columns. Texts without words are classes of their own."""
    last = F.lit(2**63 - 1).cast("bigint")
    rows = _classes(docs).withColumn("key", F.struct(F.coalesce("doc_id", last).alias("id"), "tie"))
    first = rows.where("n_shingles > 0").groupBy("component").agg(F.min("key").alias("first"))
    of, tie, empty, place = unused(docs.columns, "of", "tie", "empty", "place")
    gone = rows.join(first, "component").where(F.col("key") != F.col("first")).select(F.col("key.id").alias(of), F.col("key.tie").alias(tie)).distinct()
    no_word = F.size(F.array_remove(F.split(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")) == 0
    keyed = docs.withColumn(of, F.coalesce(F.col("doc_id").cast("bigint"), last)).withColumn(tie, F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)))
    kept = keyed.join(gone, [of, tie], "left_anti")
    # equal rows of one doc_id are one class too; the window uses the join's partitioning
    order = Window.partitionBy(of, tie).orderBy(of)
    kept = kept.withColumn(empty, no_word).withColumn(place, F.row_number().over(order)).where((F.col(place) == 1) | F.col(empty))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_shingles, component_id`` (the least
    doc_id reachable by links) and ``n_links`` (linked rows, copies included)."""
    return _classes(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def _classes(docs: DataFrame) -> DataFrame:
    sets = materialize(document_sets(docs))
    owners = sets.where("n_shingles > 0").groupBy("set_id").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "tie")).alias("owner"), F.min("doc_id").alias("least"))
    found = verified(docs, owners, candidates(docs))
    release(docs.sparkSession)
    classes = components(found.where("y is not null").select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = found.groupBy("x").agg(F.sum("links").alias("links"))
    by_set = (
        owners.select("set_id", "copies", "least")
        .join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
        .join(links.withColumnRenamed("x", "set_id"), "set_id", "left")
        .select("set_id", "least", F.coalesce("component", "set_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    by_class = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = by_set.join(by_class, "component").select("set_id", "component", "component_id", "n_links")
    return sets.join(by_set, "set_id", "left").select(
        "doc_id",
        "tie",
        "component",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n_shingles") == 0, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
    )
