"""Benchmark decontamination: SimHash windows, Hamming blocks, exact verification.

Texts are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and hashed as
five-word shingles. For an item of n words the windows of a document are n words long.
Only windows that can reach the threshold are fingerprinted. A window that starts at a
shared shingle (one that the document has in common with an item of that size) is at least
as similar as the windows that start after the shared shingle before it: sliding right to
it loses no shared shingle. So windows start at every shared shingle (clipped to the text),
wherever it stands in the item, and those with too few shared shingles for the threshold
are dropped by an exact count. Windows that start where a shared shingle stands as it does
in the item add nothing to the similarity; they are kept because their place is the one
reported. A document shorter than the item has one window, its whole text.

Fingerprints are 64-bit SimHashes of the window's shingles, each weighted by its number
of occurrences. They are cut into 8 blocks of 8 bits. Two fingerprints within
``RADIUS`` = 23 = 8 * 3 - 1 bits have a block in which they differ by 2 bits at most, so
joining each window's blocks with the 37 variants of each item block finds every pair of
equal size within the radius (shingle sets with similarity 0.8 differ in about 10 bits,
2.9 standard deviation). The full distance is then checked, and the exact weighted
Jaccard similarity of the shingle occurrences, sum(min) / sum(max), must be at least
``THRESHOLD``.

Everything is DataFrame functions. Documents are not shuffled: only the rows that share a
shingle with an item leave the scan. The items' shingles are broadcast only if there are
at most ``MAX_BROADCAST`` (counted first); otherwise both sides are joined by a shuffle.
Each place of a shared shingle carries one window (as long as the item) out of the scan;
what is gathered per document are whole numbers only, so a text that repeats an item from
end to end costs memory and time in proportion to its length.

Results. Items with fewer than five words cannot match; nor can null or empty texts.
Repeated rows of a document (same doc_id and text hash) are compared once and each get the
result rows: a place found by several equal rows counts them. Repeated
items count under each item_id, rows with a null item_id are ignored. A null doc_id stays null.
An empty benchmark or an empty table finds nothing. Columns other than doc_id and text are
not read; ``clean`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickfeatures.session import materialize

from .folders import unused

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
MAX_BROADCAST = 1_000_000
#: places of a text that go through the search in one row, with an item's length on both sides
SEGMENT = 512


def words(text: Column) -> Column:
    """Lower-cased words; null and empty texts have none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.array_remove(F.split(plain, " "), "")


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, in order. The words are bound by a lambda
    variable, so the text is cut once wherever Catalyst moves the expression."""

    def of(tokens: Column) -> Column:
        starts = F.when(F.size(tokens) >= SHINGLE, F.sequence(F.lit(0), F.size(tokens) - SHINGLE)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(SHINGLE)]))

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def simhash(grams: Column) -> Column:
    """64-bit SimHash of shingle hashes; each occurrence votes once on each bit."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.when(
            F.aggregate(grams, F.lit(0), lambda votes, g: votes + F.when(F.getbit(g, b) == 1, 1).otherwise(-1)) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
        ).otherwise(F.lit(0).cast("bigint")),
    )
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda value, bit: value.bitwiseOR(bit))


def _block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("bigint")).cast("int")


def _variants() -> list[int]:
    """All changes of a block by at most BLOCK_RADIUS bits."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def item_table(benchmark: DataFrame) -> DataFrame:
    """``item_id, size`` (shingles), ``grams`` of the items that can match."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", shingles(F.col("text")).alias("grams"))
    return items.where(F.size("grams") > 0).select("item_id", F.size("grams").alias("size"), "grams").distinct()


def _starting(p: Column, n: Column, size: Column) -> Column:
    """The start of the window from p on, moved back to where it still lies in the text."""
    return F.greatest(F.lit(0), F.least(p, n - size))


def marks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, tie, n, size, p, at, standing, window, rows``: windows at each place p of a
    shared shingle, and (p null, standing) those in which it stands as in the item; each once,
    with the number of rows that gave it. Only places leave the scan, each with its window."""
    anchors = items.select(F.posexplode("grams").alias("q", "gram"), "size").groupBy("gram", "size").agg(F.collect_set("q").alias("qs"))
    n_anchors, longest = anchors.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    if n_anchors <= MAX_BROADCAST:
        anchors = F.broadcast(anchors)
    texts = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), shingles(F.col("text")).alias("own"))

    def segment(start: Column) -> Column:
        first = F.greatest(F.lit(0), start - longest)
        return F.struct(start.alias("start"), first.alias("first"), F.slice("own", first + 1, F.lit(SEGMENT + 2 * longest)).alias("part"))

    # a text's rows hold a stretch of it each, never the whole; the outer form keeps Catalyst
    # from computing the shingles twice, for an inferred filter too
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("own") - 1), F.lit(SEGMENT))
    cut = texts.select("doc_id", "tie", F.size("own").alias("n"), F.explode_outer(F.transform(starts, segment)).alias("s")).select("doc_id", "tie", "n", "s.start", "s.first", "s.part")
    own = cut.select("doc_id", "tie", "n", "start", "first", "part", F.posexplode(F.slice("part", F.col("start") - F.col("first") + 1, F.lit(SEGMENT))).alias("i", "gram"))
    found = own.join(anchors, "gram").withColumn("place", F.col("start") + F.col("i"))

    def mark(start: Column, place: Column, standing: bool) -> Column:
        at = _starting(start, F.col("n"), F.col("size"))
        return F.struct(place.alias("p"), at.alias("at"), F.lit(standing).alias("standing"), F.slice("part", at - F.col("first") + 1, F.col("size")).alias("window"))

    there = F.transform("qs", lambda q: mark(F.col("place") - q, F.lit(None).cast("int"), True))
    each = found.select("doc_id", "tie", "n", "size", F.explode(F.concat(F.array(mark(F.col("place"), F.col("place"), False)), there)).alias("x"))
    rows = each.select("doc_id", "tie", "n", "size", "x.p", "x.at", "x.standing", "x.window")
    return rows.groupBy("doc_id", "tie", "n", "size", "p", "at", "standing").agg(F.first("window").alias("window"), F.count("*").alias("rows"))


def hits(marked: DataFrame) -> DataFrame:
    """``doc_id, tie, n, size, hits, copies``: the sorted places of shared shingles (whole
    numbers only, one array per document and size), and how many equal rows have them."""
    places = marked.where("not standing").groupBy("doc_id", "tie", "n", "size")
    return places.agg(F.sort_array(F.collect_list("p")).alias("hits"), F.first("rows").alias("copies"))


def enough(found: DataFrame) -> DataFrame:
    """``doc_id, tie, size, at`` of the windows from a shared shingle on that hold enough of
    them. Hits ascend, so one comparison tells: with the hit ``need`` - 1 places on, or, in
    the text's last window, with the need-th last hit."""
    length = F.least(F.col("n"), F.col("size"))
    need = F.ceil(F.lit(THRESHOLD / (1 + THRESHOLD)) * (F.col("size") + length) - 1e-9).cast("int")

    def kept(places: Column) -> Column:
        def full(p: Column, i: Column) -> Column:
            at = _starting(p, F.col("n"), F.col("size"))
            return F.when(p == at, F.get(places, i + need - 1) < at + length).otherwise(F.get(places, F.size(places) - need) >= at)

        return F.array_distinct(F.transform(F.filter(places, full), lambda p: _starting(p, F.col("n"), F.col("size"))))

    return found.select("doc_id", "tie", "size", F.explode(F.get(F.transform(F.array("hits"), kept), F.lit(0))).alias("at"))


def windows(marked: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, tie, at, size, standing, window`` of documents that share shingles with an
    item; ``standing``: a shared shingle stands in the window as it does in an item."""
    full = enough(found).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "tie", "size", "at")])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tie") == F.col("_tie")) & (F.col("size") == F.col("_size")) & (F.col("at") == F.col("_at"))
    kept = marked.where("standing").unionByName(marked.where("not standing").join(full, same, "left_semi"))
    return kept.groupBy("doc_id", "tie", "at", "size").agg(F.max("standing").alias("standing"), F.first("window").alias("window"))


def near_pairs(found: DataFrame, items: DataFrame) -> DataFrame:
    """Windows and items of the same size whose fingerprints are within the radius."""
    left = found.withColumn("print", simhash(F.col("window")))
    left = left.select("*", F.posexplode(F.array(*[_block(F.col("print"), i) for i in range(BLOCKS)])).alias("block", "value"))
    right = items.select("item_id", "size", F.col("grams"), simhash(F.col("grams")).alias("item_print"))
    right = right.select("*", F.posexplode(F.array(*[_block(F.col("item_print"), i) for i in range(BLOCKS)])).alias("block", "own"))
    right = right.select("item_id", "size", "item_print", "block", F.explode(F.transform(F.array(*map(F.lit, _variants())), lambda m: m.bitwiseXOR(F.col("own")))).alias("value"))
    pairs = left.join(right, ["size", "block", "value"]).where(hamming(F.col("print"), F.col("item_print")) <= RADIUS)
    return pairs.select("doc_id", "tie", "at", "size", "standing", "item_id", "window").dropDuplicates(["doc_id", "tie", "at", "size", "item_id"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, tie, item_id, at`` (first word of the best window; if tied, of the first
    that is standing, else of the first) and ``similarity``, for each document and item that
    reach the threshold; one row for each equal row of ``docs``."""
    items = item_table(benchmark)
    marked = materialize(marks(docs, items))
    found = hits(marked)
    pairs = near_pairs(windows(marked, found), items)
    key = ["doc_id", "tie", "item_id", "at", "size", "standing", "length"]
    own = pairs.withColumn("length", F.size("window")).select(*key, F.explode("window").alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias("n"))
    theirs = items.select("item_id", F.explode("grams").alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("m"))
    shared = own.join(theirs, ["item_id", "gram"]).groupBy(*key).agg(F.sum(F.least("n", "m")).alias("least"))
    scored = shared.withColumn("similarity", F.col("least") / (F.col("size") + F.col("length") - F.col("least")))
    best = scored.where(F.col("similarity") >= THRESHOLD).groupBy("doc_id", "tie", "item_id")
    best = best.agg(F.max(F.struct("similarity", "standing", (-F.col("at")).alias("before"))).alias("best"))
    copies = found.groupBy(F.col("doc_id").alias("_doc_id"), F.col("tie").alias("_tie")).agg(F.max("copies").alias("copies"))
    each = best.join(copies, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tie") == F.col("_tie")))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return each.select("doc_id", "tie", "item_id", (-F.col("best.before")).alias("at"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item, same columns."""
    doc_id, tie = unused(docs.columns, "doc_id", "tie")
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(doc_id), F.col("tie").alias(tie)).distinct()
    match = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col(tie))
    return docs.join(found, match, "left_anti")
