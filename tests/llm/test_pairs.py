"""op4: PartEnum join against brute force."""

import collections
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import near_copies, shingle_set
from tickfeatures.llm import partenum as P
from tickfeatures.llm.components import components


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
            links[a] += 1
            links[b] += 1
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return collections.Counter((i, len(s), (least.get(find(a)) if s else i), links[a]) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("block", [1536, 5])
def test_join_equals_brute_force(spark, edge_docs, block, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = list(enumerate(near_copies(block), 100)) + [(r.doc_id, r.text) for r in edge_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter(tuple(r) for r in P.jaccard_classes(docs).collect())
    want = brute(rows)
    assert sum(want.values()) == len(rows) and max(k[3] for k in want) > 3
    assert got == want


def test_frequent_passages_join_no_family(spark, monkeypatch):
    """Texts that share repeated lines only are never compared, whatever their number."""
    r = random.Random(3)
    lines = [" ".join(f"line{k}w{j}" for j in range(10)) for k in range(12)]
    own = [[" ".join(f"u{r.randrange(10**7)}" for _ in range(8)) for _ in range(14)] for _ in range(60)]
    texts = [r.sample(lines, 6) + x for x in own]
    texts += [texts[k][:-1] + ["an end of its own"] for k in range(4)]
    rows = [(i, "\n".join(x)) for i, x in enumerate(texts)]
    found = []

    def spied(edges):
        found.append(components(edges))
        return found[-1]

    monkeypatch.setattr(P, "components", spied)
    got = P.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert collections.Counter(tuple(x) for x in got) == brute(rows)
    assert sorted(x["count"] for x in found[0].groupBy("component").count().collect()) == [2, 2, 2, 2]


def test_long_sets_leave_in_parts(monkeypatch):
    monkeypatch.setattr(P, "ROWS", 50)
    sets = {7: np.arange(120, dtype=np.uint64), -3: np.array([2**63 + 5], np.uint64), 9: np.arange(1000, 1030, dtype=np.uint64)}
    batch = pa.RecordBatch.from_arrays([pa.array(list(sets)), pa.array([x.tobytes() for x in sets.values()], pa.binary())], names=["set_id", "elements"])
    parts = list(P._shingles([batch.slice(0, 0), batch, batch.slice(1)]))
    assert max(p.num_rows for p in parts) <= 50
    got = collections.Counter((r["sig"], r["set_id"], r["n"]) for p in parts for r in p.to_pylist())
    want = [(int(e), k, len(x)) for k, x in sets.items() for e in x.view(np.int64)]
    assert got == collections.Counter(want + [w for w in want if w[1] != 7])


def test_pair_of_full_blocks_in_bounded_memory():
    """A worker and another beside it compare their blocks within an executor's memory."""
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 100_000, dtype=np.uint64)
    sets = [np.unique(r.choice(base, P.BLOCK_ELEMENTS // P.BLOCK)) for _ in range(2 * P.BLOCK)]
    a, b = P.Block.of(sets[: P.BLOCK]), P.Block.of(sets[P.BLOCK :])
    tracemalloc.start()
    pairs = P.linked_pairs(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 0 and peak < 130e6


def test_join_of_empty_table(no_docs):
    assert P.jaccard_classes(no_docs).collect() == []
    assert P.one_per_class(no_docs).collect() == []


def test_one_per_class_keeps_columns_and_least_id(edge_docs):
    kept = P.one_per_class(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert [i for i, _ in rows] == [-1, 1, 2, 3, 4, 5, 7, 8, 9]


def test_linked_sets_share_enough_signatures():
    """The guarantee: two linked sets share a signature that both emit, and each passes its filter."""
    r = np.random.default_rng(5)
    checked = 0
    for size in [*range(4, 40), 77, 180, 500]:
        for _ in range(6):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            b = a.copy()
            while True:
                c = b.copy()
                if r.random() < 0.5 or len(c) < 5:
                    c = np.append(c, r.integers(0, 2**63, 1, dtype=np.uint64))
                else:
                    c = np.delete(c, r.integers(len(c)))
                inter = len(np.intersect1d(a, c))
                if 100 * inter < 80 * (len(a) + len(c) - inter):
                    break
                b = c
            checked += 1
            sa, sb = list(P.signatures(a)), list(P.signatures(b))
            ok = False
            for tag, found in sa:
                other = [f for t, f in sb if t >> 20 == tag >> 20]
                n = sum(len(np.intersect1d(found, f)) for f in other)
                ok = ok or (n > 0 and n >= tag & (1 << 20) - 1)
            assert ok, size
    assert checked > 200


def test_bands_cover_all_linked_sizes():
    for n in range(4, 400):
        for m in range(n, n * 100 // P.PERCENT + 1):
            assert set(P.instances(n)) & set(P.instances(m)), (n, m)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (7, 7), (200, 200), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[90] == got[80] == 80 and got[200] == 200
    assert components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [0, 3, 10**9])
def test_intersections_of_blocks(limit, monkeypatch):
    """Counted pairs and matrix products give the same sizes."""
    monkeypatch.setattr(P, "DENSE_PAIRS", limit)
    monkeypatch.setattr(P, "DENSE_WIDTH", 5)
    monkeypatch.setattr(P, "COUNTED_PAIRS", 40)
    r = np.random.default_rng(limit)
    one, two = ([np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(n)] for n in (17, 23))
    a, b = P.Block.of(one), P.Block.of(two)
    want = {(i, j) for i, x in enumerate(one) for j, y in enumerate(two) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    assert {tuple(p) for p in P.linked_pairs(a, b).tolist()} == want
    want = {(i, j) for i, x in enumerate(one) for j, y in enumerate(one) if i < j and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    assert {tuple(p) for p in P.linked_pairs(a, None).tolist()} == want
    _, in_a, in_b = np.intersect1d(a.dictionary, b.dictionary, assume_unique=True, return_indices=True)
    got = P.intersections(P.Incidence(a, in_a), P.Incidence(b, in_b))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in two] for x in one]


def test_one_per_class_keeps_columns_with_helper_names(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, 7, "t", True, 3), (2, text, 8, "u", False, 4), (3, "", 9, "v", None, 5)], "doc_id bigint, text string, of int, tie string, empty boolean, place int")
    kept = P.one_per_class(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, text, 7, "t", True, 3), (3, "", 9, "v", None, 5)]
