import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickfeatures.llm import token_alignment as ta
from tickfeatures.llm.minimal_hash import MinimalHash
from tickfeatures.llm.pretokens import byte_letters

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokens_of(text, libraries):
    """(id, bytes) of both sides by the libraries, on the whole text; none if not spelled again."""
    a, b = libraries
    if not text:
        return [], []
    to_byte = {c: i for i, c in enumerate(byte_letters())}
    left = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], []
    return left, right


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows, libraries):
    """All overlaps by comparing every A token with every B token of a document."""
    linked, counts = [], Counter()
    for _, text in rows:
        a, b = map(spans, tokens_of(text, libraries))
        links = [(x, y) for x, s, e in a for y, p, q in b if s < q and p < e]
        linked.append((a, b, links))
        counts.update(set(links))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, _), (a, b, links) in zip(rows, linked):
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        text = ";".join("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts))
        out.append((doc_id, len(a), len(b), len(cuts), len(links), sum(counts[x] == highest[x[0]] for x in links), sum(counts[x] for x in links), text))
    return out


def hard_texts():
    r = random.Random(4)
    bits = ["the", "stop", "a", " ", "  ", "\n", "\t", "é", "你", "😀", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "'s", "x\u0000y", "12", "...", "Über", " "]
    texts = [None, "", " ", "   ", "a ", "▁", "a ▁ b", "<unk> x", "plain words here", "plain words here"]
    return texts + ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(1, 30))) for _ in range(60)]


@pytest.fixture(scope="module")
def rows():
    texts = hard_texts()
    ids = [None if i == 3 else i // 2 if i < 12 else i for i in range(len(texts))]
    return list(zip(ids, texts)) + [(9, "plain words here"), (9, "plain words here")]


def key(row):
    return tuple((x is None, x) if not isinstance(x, str) else x for x in row)


@pytest.mark.parametrize("max_broadcast", [ta.MAX_BROADCAST_PAIRS, 0])
def test_equals_brute_force(spark, rows, libraries, max_broadcast):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_a int").repartition(5)
    got = [tuple(r) for r in ta.align_documents(docs, BYTES, PIECES, shards=4, max_broadcast=max_broadcast).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, libraries), key=key)


def test_more_tasks_than_a_tree_node(spark, rows, libraries, monkeypatch):
    monkeypatch.setattr(ta, "FAN_IN", 2)
    monkeypatch.setattr(ta, "CHUNK_BYTES", 200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    want = sorted(brute(rows, libraries), key=key)
    for most in (10**6, 0):
        got = [tuple(r) for r in ta.align_documents(docs, BYTES, PIECES, shards=3, max_broadcast=most).collect()]
        assert sorted(got, key=key) == want


def test_long_text_and_pair_counts(spark, libraries):
    text = "naïve cafés don't stop 12345 times\n" * 4_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, "naïve")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ta.align_documents(docs, BYTES, PIECES).collect()}
    a, b = tokens_of(text, libraries)
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
    assert (got[1]["n_a"], got[1]["n_b"], got[1]["n_links"], got[1]["n_groups"]) == (len(a), len(b), len(ends[0] | ends[1]), len(ends[0] & ends[1]))
    assert got[1]["groups"] == got[2]["groups"]
    pairs = {(r["a"], r["b"]): (r["n_documents"], r["best"]) for r in ta.pair_counts(docs, BYTES, PIECES).collect()}
    one = set()
    for x, s, e in spans(a)[:60]:
        one |= {(x, y) for y, p, q in spans(b)[:60] if s < q and p < e}
    assert one <= set(pairs) and max(n for n, _ in pairs.values()) == 3 and got[3]["n_best"] > 0


def test_empty_table(spark, no_docs):
    assert ta.align_documents(no_docs, BYTES, PIECES).collect() == []
    assert ta.align_documents(no_docs, BYTES, PIECES, max_broadcast=-1).collect() == []


def test_query(spark, libraries):
    from tickfeatures.llm.queries import op11_token_alignment

    got = {r["doc_id"]: r for r in op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(docs)
    for doc_id in sorted(docs, key=lambda d: len(docs[d] or ""))[:120]:
        a, b = tokens_of(docs[doc_id], libraries)
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts = [np.searchsorted(cuts, e) for e in ends]
        text = ";".join("|".join(",".join(str(i) for (i, _), k in zip(side, part) if k == g) for side, part in ((a, parts[0]), (b, parts[1]))) for g in range(len(cuts)))
        r = got[doc_id]
        assert (r["n_a"], r["n_b"], r["n_groups"]) == (len(a), len(b), len(cuts))
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_minimal_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    perfect = MinimalHash.from_bytes(MinimalHash.build(keys).to_bytes())
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
    strange = np.array([2**63 + 5], np.uint64)
    assert perfect.slots(strange)[0] < max(1, len(keys))


def test_minimal_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        MinimalHash.build(np.array([7, 7], np.uint64))
