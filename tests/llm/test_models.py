"""op8, op9, op10 and the pipeline: brute force and held-out accuracy."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.conftest import shingle_set, words_of
from tests.llm.test_native import brute_leaks
from tickfeatures.llm import interpolated_lm as lm
from tickfeatures.llm import knn_quality, order_minhash, queries
from tickfeatures.llm.text import bytes_of

# ---- op8


def brute_scores(rows):
    """rows: (doc_id, text). The model in plain Python."""
    texts = [(i, words_of(t) + [None]) for i, t in rows]
    crc = {i: zlib.crc32(str(i).encode()) if i is not None else None for i, _ in rows}
    held = {i: c is not None and c % 5 == 1 for i, c in crc.items()}
    deleted = {i: c is not None and not held[i] and c // 5 % 10 < 1 for i, c in crc.items()}

    def before(w):
        """The two tokens before each token; start marks stand before the text."""
        marks = [("<s>",), ("<s>",), *w]
        return list(zip(marks, marks[1:]))

    def count(which):
        c = collections.Counter()
        for i, w in texts:
            if which(i):
                c.update(w)
                c.update([("<s>",), (("<s>",), ("<s>",))])
                for (u, v), x in zip(before(w), w):
                    c.update([(v, x), (u, v, x)])
        singles = [c[k] for k in c if not isinstance(k, tuple)]
        return c, sum(singles), len(singles)

    def estimates(c, u, v, x):
        pair, single = c[u, v], c[v]
        bucket = lm.FREQUENCIES + pair.bit_length() if pair else single.bit_length()
        return bucket, c[u, v, x] / max(1, pair), c[v, x] / max(1, single), c[x]

    kept, kept_n, kept_v = count(lambda i: not held[i] and not deleted[i])
    combos = collections.Counter()
    for i, w in texts:
        if deleted[i]:
            combos.update(estimates(kept, u, v, x) for (u, v), x in zip(before(w), w))
    weights = np.tile(np.array(lm.START_WEIGHTS), (lm.CONTEXT_BUCKETS, 1))
    for _ in range(lm.MAX_ROUNDS):
        sums = np.zeros_like(weights)
        for (b, p3, p2, word), n in combos.items():
            x = weights[b] * np.array([p3, p2, word / max(1, kept_n), 1 / (kept_v + 1)])
            sums[b] += n * x / x.sum()
        new = weights.copy()
        for b in {k[0] for k in combos}:
            s = sums[b] + np.array([0, 0, 0, 1e-6])
            new[b] = s / s.sum()
        moved = np.abs(new - weights).max()
        weights = new
        if moved < lm.TOLERANCE:
            break
    counts, n, size = count(lambda i: not held[i])
    out = []
    for i, w in texts:
        base = score = known = 0
        for (u, v), x in zip(before(w), w):
            b, p3, p2, c = estimates(counts, u, v, x)
            score += math.log10(weights[b] @ np.array([p3, p2, c / max(1, n), 1 / (size + 1)]))
            base += math.log10((c + 0.5) / (n + 0.5 * (size + 1)))
            known += c > 0
        out.append((i if i is not None else -1, held[i], len(w), known, n, round(base, 6), round(score, 6)))
    return sorted(out)


def rounded(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) <= 2e-6 + 1e-9 * abs(b[5]) and abs(a[6] - b[6]) <= 2e-6 + 1e-9 * abs(b[6])


def test_model_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = rounded(queries.QUERIES["op8_interpolated_lm"](spark, SF_SMALL).collect())
    close(got, brute_scores(rows))
    held = [r for r in got if r[1]]
    assert len(held) > 20 and sum(r[6] for r in held) > sum(r[5] for r in held)  # better than the unigram base on unseen texts


def test_model_on_hard_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    close(rounded(lm.score_documents(edge_docs).collect()), brute_scores(rows))
    assert lm.score_documents(no_docs).collect() == []


@pytest.mark.parametrize("from_files", [True, False])
def test_many_chunks_and_buckets(spark, from_files):
    """Chunks cut inside file blocks and more buckets than partitions give the same scores."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    want = rounded(queries.QUERIES["op8_interpolated_lm"](spark, SF_SMALL).collect())
    close(rounded(lm.score_documents(docs, from_files=from_files, chunk_bytes=20_000, bucket_bytes=10_000).collect()), want)


def test_cutter_bounds_chunks():
    """A chunk ends with the row that fills it; deleted rows and blocks have their own."""
    cutter = lm.Cutter(10)
    rows = [("a" * 6, 5, False), ("b" * 6, 5, False), ("c" * 6, 5, True), (None, 5, False), ("d" * 30, 5, False), ("e", 5, False), ("f", 2**63 - 1, True)]
    text, block, deleted = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(text), pa.array(block, pa.int64()), pa.array(deleted)], names=["text", "block", "deleted"])
    assert cutter(batch).tolist() == [5, 5, 6, 7, 7, 9, -(2**63)]
    assert cutter.is_open(-(2**63)) and not cutter.is_open(9)


def test_packed_numbers_come_back():
    keys = np.sort(np.array([0, 1, 2**63, 2**64 - 1, 77], np.uint64))
    assert lm.unpack_sorted(lm.pack_sorted(keys)).tolist() == keys.tolist()
    assert lm.unpack(lm.pack(np.array([3, 2**40, 0])), np.int64).tolist() == [3, 2**40, 0]
    assert lm.unpack(lm.pack(np.array([], np.uint32)), np.uint32).tolist() == []


def test_model_without_training_texts(spark, edge_docs):
    from pyspark.sql import functions as F

    rows = lm.score_documents(edge_docs, held_out=F.lit(True)).collect()
    assert len(rows) == edge_docs.count() and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


# ---- op9


def test_fingerprints_on_hard_rows(edge_docs, no_docs):
    rows = order_minhash.fingerprint_documents(edge_docs).collect()
    source = sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(rows) == len(source)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for (i, text), (_, following) in zip(source, source[1:] + source[:1]):
        if len(by_id[i]) == 1 and len([1 for j, _ in source if j == i - 1]) == 1 if i and i > 1 else i == 1:
            r = by_id[i][0]
            changed = order_minhash.edited(text, following)
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
    assert {(r.fingerprint, r.n_chars) for r in by_id[8]} == {(by_id[8][0].fingerprint, 150_000)}
    assert by_id[1][0].fingerprint == by_id[2][0].fingerprint == by_id[3][0].fingerprint != by_id[4][0].fingerprint
    assert order_minhash.fingerprint_documents(no_docs).collect() == []


def test_edited_texts_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    rows = queries.QUERIES["op9_order_minhash"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    own = {r.doc_id: r.fingerprint for r in rows}
    for r in rows:
        text, after = texts[r.doc_id], texts[following[r.doc_id]]
        half = len(text) // 2
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        a, b = own[r.doc_id], own[following[r.doc_id]]
        assert r.near_next == sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / order_minhash.M
    assert np.mean([r.near_edited for r in rows]) > 5 * np.mean([r.near_next for r in rows])


def brute_signature(text, sketch):
    """Order MinHash by sorting all numbered k-mers of one text."""
    from tickfeatures.llm.text import BYTE_CODE, mix, span_hashes, split_words

    data, offsets = bytes_of(pa.array([text]))
    start, end, _ = split_words(data, offsets)
    words = span_hashes(BYTE_CODE[data], start, end)
    kmers, seen = [], collections.Counter()
    count = len(words) - sketch.k + 1 if len(words) >= sketch.k else min(1, len(words))
    for i in range(count):
        h = np.zeros(1, np.uint64)
        for j, w in enumerate(words[i : i + sketch.k]):
            h = mix(h ^ np.array([w], np.uint64), j + 1)
        number = seen[int(h[0])]
        seen[int(h[0])] += 1
        kmers.append(mix(h + np.uint64(number), 50)[0])
    out = []
    for j in range(sketch.m):
        odd = np.uint64(2 * int(mix(np.array([j], np.uint64), 61)[0] >> np.uint64(1)) % 2**64 + 1)
        keyed = []
        for place, k in enumerate(kmers):
            h = np.array([k], np.uint64) * odd
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            keyed.append((int(h[0]) >> 24, place, k))
        chosen = sorted(sorted(keyed)[: sketch.l], key=lambda x: x[1])
        t = np.full(1, j, np.uint64)
        for i, (_, _, k) in enumerate(chosen):
            t = mix(t ^ np.array([k], np.uint64), 70 + i)
        out.append(int(t[0] >> np.uint64(32)) if chosen else int(mix(np.array([j], np.uint64), 60)[0] & np.uint64(0xFFFFFFFF)))
    return out


def test_signatures_equal_brute_force():
    sketch = order_minhash.OrderMinHash(m=8)
    texts = ["", "a", "a b", "a a a a a", "the cat sat on the mat the cat sat", "x y x y x y x", "é 你 a b c d e f g h i j k"]
    got = sketch.signatures(*bytes_of(pa.array(texts)))
    assert got.tolist() == [brute_signature(t, sketch) for t in texts]


def test_order_matters():
    """Blocks in another order keep the k-mers but lose likeness."""
    sketch = order_minhash.OrderMinHash()
    words = [f"w{i}" for i in range(400)]
    blocks = [words[i : i + 40] for i in range(0, 400, 40)]
    texts = [" ".join(words), " ".join(sum(reversed(blocks), [])), " ".join(words[:200] + ["new"] + words[201:])]
    a, b, c = sketch.signatures(*bytes_of(pa.array(texts)))
    assert (a == c).mean() > 0.9 and (a == b).mean() < 0.3


# ---- op10


def test_range_edges_are_bounded_and_cover_ties(spark, monkeypatch):
    """Ties and repeated rows: each row has its successor in the whole order, few rows are collected."""
    rows = [(i % 7 if i % 5 else None, f"text number {i % 11} of the rows") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    monkeypatch.setattr(order_minhash, "SAMPLE", 20)
    assert len(order_minhash._edges(order_minhash._order_key(docs), 9)) <= 9
    keyed = sorted((r["desc"], r["tie"], r["text"]) for r in order_minhash._order_key(docs).collect())
    half = lambda a, b: a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    want = sorted(hashlib.sha256(half(a[2], b[2]).encode()).hexdigest() for a, b in zip(keyed, keyed[1:] + keyed[:1]))
    got = order_minhash.fingerprint_documents(docs, parts=3).collect()
    assert sorted(r["edited_sha256"] for r in got) == want


def test_quality_votes_on_held_out_rows(spark):
    rows = queries.QUERIES["op10_knn_quality"](spark, SF_MID).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    right = [r.predicted == labels[r.doc_id] for r in tested]
    clean = [r.predicted for r in tested if labels[r.doc_id] == 1]
    assert len(tested) > 60 and np.mean(right) > 0.97 and np.mean(clean) > 0.98


def test_quality_edges(spark, edge_docs, no_docs):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (None, 1), (6, None), (77, 1)], "doc_id bigint, label int")
    model = knn_quality.train(edge_docs, labels, F.lit(True))
    assert sorted(model.labels.tolist()) == [0.0, 1.0] and model.prior == 0.5
    scored = knn_quality.score_documents(edge_docs, model)
    assert sorted(scored.columns) == sorted(edge_docs.columns)
    by = {r.doc_id: r.score for r in scored.collect()}
    assert by[1] == by[2] == by[3] == 0.5 and by[4] < 0.5 < by[5]
    blind = knn_quality.train(edge_docs, labels.limit(0), F.lit(True))
    assert {r.score for r in knn_quality.score_documents(edge_docs, blind).collect()} == {1.0}
    assert knn_quality.score_documents(no_docs, model).collect() == []


def test_votes_equal_brute_force():
    r = np.random.default_rng(1)
    refs = knn_quality.unit(r.standard_normal((50, 4)).astype(np.float32))
    labels = r.integers(0, 2, 50).astype(float)
    model = knn_quality.Model(np.ones(4, np.float32), np.eye(4, dtype=np.float32), refs, labels, 0.3, neighbours=7)
    x = r.random((20, 4)).astype(np.float32)
    got = model.score(x)
    for row, score in zip(knn_quality.unit(x), got):
        cosine = (refs @ row).astype(np.float64)
        near = np.argsort(-cosine, kind="stable")[:7]
        weight = np.maximum(cosine[near], 0) ** 4
        assert abs(score - (weight @ labels[near] + 1e-9 * 0.3) / (weight.sum() + 1e-9)) < 1e-4


# ---- pipeline


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF_SMALL).cache())
    return out


def test_pipeline_stages(spark, stages):
    docs, good, single, clean, encoded = stages
    assert good.columns == single.columns == clean.columns == docs.columns
    scores = {r.doc_id: r.score for r in queries.QUERIES["op10_knn_quality"](spark, SF_SMALL).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.5}
    kept = sorted((r.doc_id, shingle_set(r.text)) for r in good.collect())
    parent = {i: i for i, _ in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(kept):
        for j, b in kept[:n]:
            if a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in single.collect()} == {i for i, _ in kept if find(i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in single.collect()]
    leaks = {i for i, _ in brute_leaks(rows, items)}
    assert leaks and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - leaks
    texts = dict(rows)
    for r in encoded.collect():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_run_equals_stages(spark, stages):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "ids_sha256").collect())
    assert got == sorted(tuple(r) for r in stages[-1].select("doc_id", "ids_sha256").collect())


def test_pipeline_stages_take_empty_and_hard_tables(spark, edge_docs):
    hard = edge_docs.selectExpr("doc_id", "text", "lang", "source", "cast(n_tokens as bigint) as n_chars")
    for docs in (hard, hard.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, SF_SMALL)
            if "ids" not in docs.columns:
                assert docs.columns == columns
        docs.collect()
