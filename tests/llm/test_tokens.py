"""op3 and op7: BPE and directly addressable codes against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickfeatures.llm import bpe, dac
from tickfeatures.llm.pretokens import Encoder, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pair_index_equals_library(library):
    r = random.Random(3)
    letters = "aab'sreltdmv  \n\t é你1２²#$!😀\u0085\u00a0ᲉꟋA"
    texts = [None, "", "don't you'll''s 'sX x're'", "a" * 5000, "<|endoftext|>a<|endoftext|><|endoftext|>  b", "\n's", "''s 's's", "<|endoftext"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    vocab = vocabulary(PATH)
    decoder, at = bpe.Decoder(vocab), 0
    for n, ids, lengths in Encoder(PATH, bpe.PairIndex(vocab).encode, piece_chars=20_000).encode(texts):
        ends = np.cumsum(lengths)
        for k, decoded in enumerate(decoder.decode(ids, lengths)):
            want = library.encode(texts[at + k] or "", add_special_tokens=False).ids
            assert ids[ends[k] - lengths[k] : ends[k]].tolist() == want, repr(texts[at + k])
            assert decoded.decode() == (texts[at + k] or "")
        at += n
    assert at == len(texts)


def test_word_cache_starts_anew_when_full(library):
    coder = Encoder(PATH, bpe.PairIndex(vocabulary(PATH)).encode, piece_chars=50)
    coder._cache._limit = 20
    texts = [f"some words {i} and {i * 7}" for i in range(200)]
    got = [ids.tolist() for _, ids, _ in coder.encode(texts)]
    assert sum(got, []) == sum((library.encode(t, add_special_tokens=False).ids for t in texts), [])


def test_bpe_query_on_hard_rows(edge_docs, no_docs, library):
    rows = bpe.encode_documents(edge_docs, PATH, outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == edge_docs.count()
    texts = sorted((r.text or "") for r in edge_docs.collect())
    assert sorted(r.decoded for r in rows) == texts
    for r in rows:
        want = library.encode(r.decoded, add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.lang == "en"
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_documents(no_docs, PATH).collect() == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_segment_access(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.3, r.integers(0, 256, n), r.integers(0, 2**28, n)) if n else np.empty(0, np.int64)
    s = dac.Segment(dac.pack(ids))
    assert s.size == n and s.read(0, n).tolist() == ids.tolist()
    for i in r.integers(0, max(1, n), min(n, 60)).tolist():
        assert s.access(i) == ids[i]
        j = min(n, i + int(r.integers(0, 700)))
        assert s.read(i, j).tolist() == ids[i:j].tolist()
    with pytest.raises(IndexError):
        s.access(n)


def test_files_in_order(spark, edge_docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_IDS", 50)
    folder = dac.new_folder(spark, "test")
    dac.write_ids(edge_docs, PATH, folder, end_id=2, parts=3)
    got = sorted(dac.read_documents(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9]
    start = 0
    by_id = {(r.doc_id, r.text) for r in edge_docs.collect()}
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.ids[:-1] in [library.encode(t or "", add_special_tokens=False).ids for i, t in by_id if i == r.doc_id]
        start += r.n_tokens
    rows = [(None,), (got[-1].doc_id,), (got[-1].doc_id,), (got[len(got) // 2].doc_id,), (10**12,)]
    wanted = {r[0] for r in rows}
    some = dac.lookup(spark, folder, spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, ids string")).collect()
    by_id = lambda rs: sorted(((r.doc_id, tuple(r.ids)) for r in rs), key=repr)
    assert by_id(some) == by_id(r for r in got if r.doc_id in wanted) and 0 < len(some) < len(got)
    every = dac.lookup(spark, folder, spark.createDataFrame([(r.doc_id,) for r in got], "doc_id bigint"))
    assert by_id(every.collect()) == by_id(got)
    empty = dac.new_folder(spark, "test")
    dac.write_ids(no_docs, PATH, empty)
    assert dac.read_documents(spark, empty).collect() == []
    assert dac.lookup(spark, empty, no_docs).collect() == dac.lookup(spark, folder, no_docs).collect() == []
