"""Cheapest repair of conversations by Four-Russians block tables.

A conversation's rows, by turn, are edited until their role initials match
``(s?(ua)+)?``: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty
user or assistant row) 5; a truncated row that is not deleted adds 5; blank and duplicate
rows must be deleted. Among the cheapest edits the least string of initials (D < I < K < R)
is taken.

Method. A row is one of nine symbols (initial s, u, a or other, truncated or not; or "must
go"). The cost of finishing from each of the pattern's four states is a vector; less its
least entry it is one of a few dozen normalised vectors, found by closure. Tables give, for
every such vector and every block of ``BLOCK`` symbols, the vector before the block and the
cost that it adds. A conversation is solved from its end, a lookup per block; then it is
traced from its start: each block is expanded backward from the vector behind it, and at
each row the least letter that keeps the cost is taken, so ties are decided as asked.

Scale. Equal rows are counted before any shuffle. Rows are range-partitioned by
(conversation, turn) and cut into segments of at most ``SEGMENT_ROWS`` rows and about
``SEGMENT_BYTES`` of text, so one conversation may span many tasks. A segment of such a
conversation also gives its tables for all vectors and states; one small row per segment is
folded per conversation, and each segment is then traced on its own. Only the final hash
of a conversation's rows runs in one stream, segment by segment.

Results. Null roles, texts, conversation ids and turns: see ``repair``. Of equal rows and
of rows of one turn, the order is (turn, null first; role; text, by UTF-8 bytes). A row is
a duplicate if the same role and text stood earlier, which equal rows after the first
always are. An empty table has no results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dac import new_folder

BLOCK = 4
SEGMENT_ROWS = 65_536
SEGMENT_BYTES = 4 << 20

# fixed values: what each edit costs
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
GOOD_ENDS = ".!?"

#: states of (s?(ua)+)?: start, after s, after u, after ua
STATES, START, ENDS = 4, 0, (0, 3)
INITIALS = "sua"
OTHER, MUST_GO, PAD, SYMBOLS = 3, 8, 9, 10
_STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, initial) -> state
_NEXT = (2, 2, 3, 2)  # where a user or assistant row leads
_LEGAL = {"su", "ua", "au"}


def _closed(h: list[int]) -> list[int]:
    """Costs to go when rows may also be inserted first."""
    two, three = min(h[2], INSERT + h[3]), min(h[3], INSERT + h[2])
    return [min(h[0], INSERT + two), min(h[1], INSERT + two), two, three]


_FAR = 10**6
_AT_END = tuple(_closed([0 if q in ENDS else _FAR for q in range(STATES)]))


def _options(symbol: int, after: tuple[int, ...], q: int) -> dict[str, tuple[int, int]]:
    """Letter -> (cost to go, next state) of the edits that use up a row in state q."""
    out = {"D": (DELETE + after[q], q)}
    if symbol < MUST_GO:
        extra = TRUNCATED if symbol > OTHER else 0
        if (q, symbol % 4) in _STEP:
            to = _STEP[q, symbol % 4]
            out["K"] = (extra + after[to], to)
        out["R"] = (extra + REROLE + after[_NEXT[q]], _NEXT[q])
    return out


def _before(symbol: int, after: tuple[int, ...]) -> list[int]:
    if symbol == PAD:
        return list(after)
    return _closed([min(c for c, _ in _options(symbol, after, q).values()) for q in range(STATES)])


def _letters(symbol: int, after: tuple[int, ...], q: int) -> tuple[str, int]:
    """The least letters from state q up to the row's own, and the state behind it."""
    before, letters = _before(symbol, after), ""
    while True:
        options = _options(symbol, after, q) | {"I": (INSERT + before[_NEXT[q]], _NEXT[q])}
        letter = min(x for x, (cost, _) in options.items() if cost == before[q])
        q, letters = options[letter][1], letters + letter
        if letter != "I":
            return letters, q


class Tables:
    """Normalised vectors, their one-symbol and block transitions, and the trace choices."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        number, todo = {_AT_END: 0}, [_AT_END]
        step: list[list[tuple[int, int]]] = []
        for h in todo:
            row = []
            for symbol in range(SYMBOLS):
                found = _before(symbol, h)
                least = min(found)
                new = tuple(x - least for x in found)
                if new not in number:
                    number[new] = len(todo)
                    todo.append(new)
                row.append((number[new], least))
            step.append(row)
        self.vectors = todo
        one = np.array(step, np.int64)
        self.next, self.cost = one[:, :, 0], one[:, :, 1]
        to, cost = self.next, self.cost  # blocks of one symbol
        for _ in range(block - 1):  # put a symbol before every shorter block
            longer = self.next[to].transpose(0, 2, 1).reshape(len(to), -1)
            cost = (cost[:, None, :] + self.cost[to].transpose(0, 2, 1)).reshape(len(to), -1)
            to = longer
        self.block_next, self.block_cost = to, cost
        self.choice = [[[_letters(s, h, q) for q in range(STATES)] for s in range(MUST_GO + 1)] for h in todo]
        self.exit = np.array([[[q for q in range(STATES)] if s == PAD else [self.choice[v][s][q][1] for q in range(STATES)] for s in range(SYMBOLS)] for v in range(len(todo))])

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of the blocks, padded in front."""
        padded = np.concatenate([np.full(-len(symbols) % self.block, PAD), symbols]).reshape(-1, self.block)
        return padded @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))

    def solve(self, symbols: np.ndarray, vector: int = 0) -> tuple[list[int], int, int]:
        """The vectors behind each block, the one before all, and the cost added."""
        behind, cost = [], 0
        for code in self.blocks(symbols)[::-1].tolist():
            behind.append(vector)
            cost += int(self.block_cost[vector, code])
            vector = int(self.block_next[vector, code])
        return behind[::-1], vector, cost

    def trace(self, symbols: np.ndarray, behind: list[int], state: int) -> tuple[list[str], int]:
        """Each row's letters from the state on, and the state at the end."""
        letters = []
        pad = -len(symbols) % self.block
        own = symbols.tolist()
        for k, vector in enumerate(behind):
            inner = own[max(0, k * self.block - pad) : (k + 1) * self.block - pad]
            after = [vector]
            for symbol in inner[:0:-1]:  # expand the block backward
                after.append(int(self.next[after[-1], symbol]))
            for symbol, v in zip(inner, reversed(after), strict=True):
                word, state = self.choice[v][symbol][state]
                letters.append(word)
        return letters, state

    def function(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every vector behind the symbols: the vector before them, the cost added, and
        the state behind them for each state before."""
        codes = self.blocks(symbols)
        now, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        behind = np.empty((len(codes), len(now)), np.int64)
        for k in range(len(codes) - 1, -1, -1):
            behind[k] = now
            cost += self.block_cost[now, codes[k]]
            now = self.block_next[now, codes[k]]
        padded = np.concatenate([np.full(-len(symbols) % self.block, PAD), symbols]).reshape(-1, self.block).tolist()
        state = np.tile(np.arange(STATES), (len(now), 1))
        for vectors, block in zip(behind, padded, strict=True):
            after = [vectors]
            for symbol in block[:0:-1]:
                after.append(self.next[after[-1], symbol])
            for symbol, v in zip(block, reversed(after), strict=True):
                state = self.exit[v[:, None], symbol, state]
        return now, cost, state


@cache
def tables() -> Tables:
    return Tables()


_TAIL = {0: "", 1: "II", 2: "I", 3: ""}  # inserted behind the last row


def edited(letters: list[str], kept: Iterator[tuple[str, str]], symbols: list[int], state: int) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the edits in order; role and text are empty for a deletion."""
    for word, symbol in zip(letters, symbols, strict=True):
        own = next(kept) if symbol != MUST_GO else ("", "")
        for letter in word:
            if letter == "D":
                yield letter, "", ""
            elif letter == "K":
                state = _STEP[state, symbol % 4]
                yield letter, *own
            else:
                state = _NEXT[state]
                yield letter, "assistant" if state == 3 else "user", own[1] if letter == "R" else ""


# -- rows and segments --------------------------------------------------------------------

SEGMENT = (
    "conv_id bigint, part int, seg int, closed boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, "
    "first_turn bigint, last_turn bigint, least_turn bigint, turns bigint, symbols binary, before binary, cost binary, exits binary, roles array<string>, texts array<string>"
)
_SLIM = [c.split()[0] for c in SEGMENT.split(", ")][:-3]
OUTPUT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv_id bigint, place bigint, edit string, role string, text string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _marked(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, fault`` of distinct rows; fault is of the first copy."""
    one_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), one_blank("role"), one_blank("text"))
    # a digest stands for (role, text) in the search for earlier rows
    plain = plain.withColumn("mark", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    distinct = plain.groupBy("conv_id", "turn", "role", "text", "mark").agg(F.count(F.lit(1)).alias("copies"))
    first = plain.groupBy(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    both = distinct.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark")))
    words = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (
        F.when(words == "", "b")
        .when(~F.col("turn").eqNullSafe(F.col("first.turn")), "d")
        .when(~F.right(words, F.lit(1)).isin(*GOOD_ENDS), "t")
        .otherwise("")
    )
    return both.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


class Segment:
    """Rows of one conversation, as far as they are held."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.roles, self.texts = conv_id, [], [], []
        self.count = dict.fromkeys(_COUNTS, 0)
        self.first_role = self.last_role = None
        self.first_turn = self.last_turn = self.least_turn = None
        self.turns = self.size = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> None:
        if not self.symbols:
            self.first_role, self.first_turn = role[:1], turn
        else:
            self.count["illegal"] += self.last_role + role[:1] not in _LEGAL
        self.count["illegal"] += (copies - 1) * (2 * role[:1] not in _LEGAL)
        if turn is not None and (turn != self.last_turn or not self.symbols):
            self.turns += 1
            self.least_turn = turn if self.least_turn is None else self.least_turn
        self.last_role, self.last_turn = role[:1], turn
        again = copies
        if fault in ("", "t"):
            at = INITIALS.find(role[:1]) if role else -1
            self.symbols.append((OTHER if at < 0 else at) + 4 * (fault == "t"))
            self.roles.append(role)
            self.texts.append(text)
            self.count["truncated"] += fault == "t"
            again, fault = copies - 1, "d"
            self.size += len(text)
        self.count["blank" if fault == "b" else "duplicate"] += again
        self.symbols.extend([MUST_GO] * again)

    def row(self, part: int, seg: int, closed: bool) -> dict:
        symbols = np.array(self.symbols, np.uint8)
        own = dict(conv_id=self.conv_id, part=part, seg=seg, closed=closed, **self.count, first_role=self.first_role, last_role=self.last_role)
        own |= dict(first_turn=self.first_turn, last_turn=self.last_turn, least_turn=self.least_turn, turns=self.turns, symbols=symbols.tobytes(), roles=self.roles, texts=self.texts)
        before, cost, exits = (None, None, None) if closed else (x.tobytes() for x in tables().function(symbols))
        return own | dict(before=before, cost=cost, exits=exits)


_ARROW = pa.schema(
    [
        (name, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[kind])
        for name, kind in (c.split() for c in SEGMENT.split(", "))
    ]
)


def _segments(marked: DataFrame, parts: int) -> DataFrame:
    """One row per segment. A conversation is ``closed`` if it is one segment that neither
    begins nor ends its partition."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, open_, first, out, size = TaskContext.get().partitionId(), 0, None, True, [], 0

        def emit(segment: Segment, closed: bool) -> None:
            nonlocal seg, size
            out.append(segment.row(part, seg, closed))
            size += segment.size + 10 * len(segment.symbols)
            seg += 1

        for batch in batches:
            for conv_id, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        emit(open_, not first)
                        first = False
                    open_ = Segment(conv_id)
                while copies:
                    if len(open_.symbols) >= SEGMENT_ROWS or open_.size >= SEGMENT_BYTES:
                        emit(open_, False)
                        open_, first = Segment(conv_id), True
                    n = min(copies, SEGMENT_ROWS - len(open_.symbols))
                    open_.add(turn, role, text, n, fault)
                    copies, fault = copies - n, "b" if fault == "b" else "d"
                if size > SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out, size = [], 0
        if open_ is not None:
            emit(open_, False)
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    ordered = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "turn", "role", "text", "copies", "fault").mapInArrow(run, SEGMENT)


def _gaps(least: int | None, last: int | None, turns: int) -> int:
    return 0 if least is None else last - least + 1 - turns


def _fold(rows: pa.Table) -> pa.Table:
    """One conversation's segments: the vector behind each, the state before it, and the
    conversation's totals on its last segment."""
    parts = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["seg"]))
    vector, cost, behind = 0, 0, []
    for r in reversed(parts):
        behind.append(vector)
        cost += int(np.frombuffer(r["cost"], np.int64)[vector])
        vector = int(np.frombuffer(r["before"], np.int64)[vector])
    cost += tables().vectors[vector][START]
    state, entry = START, []
    for r, v in zip(parts, reversed(behind), strict=True):
        entry.append(state)
        state = int(np.frombuffer(r["exits"], np.int64).reshape(-1, STATES)[v, state])
    total = {c: sum(r[c] for r in parts) for c in _COUNTS}
    least, turns = None, 0
    for before, r in zip([None, *parts], parts):
        turns += r["turns"]
        if before is not None:
            turns -= r["first_turn"] is not None and before["last_turn"] == r["first_turn"]
            total["illegal"] += before["last_role"] + r["first_role"] not in _LEGAL
        least = r["least_turn"] if least is None else least
    n = len(parts)
    gaps = _gaps(least, parts[-1]["last_turn"], turns)
    whole = {"gaps": gaps, **total, "total": cost}
    return pa.table(
        {
            "conv_id": pa.array([r["conv_id"] for r in parts], pa.int64()),
            "part": pa.array([r["part"] for r in parts], pa.int32()),
            "seg": pa.array([r["seg"] for r in parts], pa.int32()),
            "vector": pa.array(behind[::-1], pa.int32()),
            "entry": pa.array(entry, pa.int32()),
            "last": pa.array([i == n - 1 for i in range(n)]),
            **{k: pa.array([v] * n, pa.int64()) for k, v in whole.items()},
        }
    )


_FOLDED = "conv_id bigint, part int, seg int, vector int, entry int, last boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, total bigint"


def _traced(symbols: np.ndarray, vector: int, entry: int, last: bool, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    known = tables()
    behind, _, _ = known.solve(symbols, vector)
    letters, state = known.trace(symbols, behind, entry)
    yield from edited(letters, zip(roles, texts, strict=True), symbols.tolist(), entry)
    for letter in _TAIL[state] if last else "":
        state = _NEXT[state]
        yield letter, "assistant" if state == 3 else "user", ""


class Digest:
    """Audit and hash of a conversation, fed segment by segment."""

    def __init__(self):
        self._audit, self._hash, self._empty = [], hashlib.sha256(), True

    def add(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for letter, role, text in edits:
            self._audit.append(letter)
            if letter != "D":
                self._hash.update(("" if self._empty else "\n").encode() + f"{role}:{text}".encode())
                self._empty = False

    def values(self) -> tuple[str, str]:
        return "".join(self._audit), self._hash.hexdigest()


def _batches(rows: Iterator[tuple], schema: str, at_most: int = 20_000) -> Iterator[pa.RecordBatch]:
    fields = [(n, {"bigint": pa.int64(), "string": pa.string()}[k]) for n, k in (c.split() for c in schema.split(", "))]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 1 + len(row[-1]) // 200
        if size >= at_most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])


def _of_closed(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            (r,) = batch.slice(row, 1).to_pylist()
            symbols = np.frombuffer(r["symbols"], np.uint8).astype(np.int64)
            edits = _traced(symbols, 0, START, True, r["roles"], r["texts"])
            if turns:
                yield from ((r["conv_id"], place, *e) for place, e in enumerate(edits))
                continue
            _, vector, cost = tables().solve(symbols)
            digest = Digest()
            digest.add(edits)
            yield r["conv_id"], _gaps(r["least_turn"], r["last_turn"], r["turns"]), *(r[c] for c in _COUNTS), cost + tables().vectors[vector][START], *digest.values()


def _of_many(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple]:
    """Segments of whole conversations in order."""
    digest, place = Digest(), 0
    for batch in batches:
        for row in range(batch.num_rows):
            (r,) = batch.slice(row, 1).to_pylist()
            symbols = np.frombuffer(r["symbols"], np.uint8).astype(np.int64)
            edits = _traced(symbols, r["vector"], r["entry"], r["last"], r["roles"], r["texts"])
            if turns:
                for e in edits:
                    yield r["conv_id"], place, *e
                    place += 1
            else:
                digest.add(edits)
                if r["last"]:
                    yield r["conv_id"], r["gaps"], *(r[c] for c in _COUNTS), r["total"], *digest.values()
            if r["last"]:
                digest, place = Digest(), 0


def _solved(rows: DataFrame, turns: bool, parts: int | None) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "conversation-segments")
    _segments(_marked(rows), parts).write.parquet(folder)
    segments = spark.read.schema(SEGMENT).parquet(folder)
    schema = TURNS if turns else OUTPUT
    closed = segments.where("closed").mapInArrow(lambda batches: _batches(_of_closed(batches, turns), schema), schema)
    # the first and last conversation of a partition, and those of several segments
    rest = segments.where("not closed")
    folded = rest.select(*_SLIM, "exits").groupBy("conv_id").applyInArrow(_fold, _FOLDED)
    ready = rest.select("part", "seg", "symbols", "roles", "texts").join(folded, ["part", "seg"])
    ready = ready.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seg")
    many = ready.mapInArrow(lambda batches: _batches(_of_many(batches, turns), schema), schema)
    return closed.unionByName(many)


def repair(conversations: DataFrame, rows: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Per conv_id of ``conversations`` (conv_id, turn, role, text): ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256``. ``rows``: what is left of
    it, if rows were lost; a conv_id without rows has zeros, no audit and the hash of nothing.

    Null roles and texts are one blank; a null turn comes first and is no gap; rows with a
    null conv_id are one conversation."""
    found = _solved(conversations if rows is None else rows, False, parts)
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    named = found.withColumnRenamed("conv_id", "_found")
    empty: dict[str, Column] = {c: F.lit(0).cast("bigint") for c in ("gaps", *_COUNTS, "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    joined = every.join(named, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    return joined.select("conv_id", *[F.coalesce(F.col(c), x).alias(c) for c, x in empty.items()])


def repaired_turns(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``conv_id, turn, role, text, edit`` of the repaired conversations; turn counts from 0."""
    edits = _solved(rows, True, parts).where("edit <> 'D'")
    numbered = Window.partitionBy("conv_id").orderBy("place")
    return edits.select("conv_id", (F.row_number().over(numbered) - 1).cast("bigint").alias("turn"), "role", "text", "edit")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20: 0 lost, 1 emptied, 2 without
    sentence ends, 3 twice, 4 from the user. Nulls are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", GOOD_ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
