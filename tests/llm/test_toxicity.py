import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickfeatures.llm import toxicity as tx
from tickfeatures.llm.queries import op13_toxicity
from tickfeatures.llm.text import bytes_of, mix

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_features(text, columns):
    """Column -> count up to MOST, form by form."""
    out = Counter()
    half = columns // 2
    for w in WORDS.findall(lower(text)):
        for k, size in enumerate((None, *tx.PREFIXES)):
            if size is None or len(w) > size:
                code = np.array([tx.forms_of(w[:size])[0]], np.uint64)
                out[int(mix(code, 61 + k)[0] % np.uint64(half)) + half * (k > 0)] += 1
    return {c: min(n, tx.MOST) for c, n in out.items()}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    bits = ["idiot", "Éclair", "naïveté", "überall", "a", "of", "clown", "MUSLIM", "women", "déjà-vu", "你好世界再见朋友们", "12345678", "x", "\n", "  ", ".", "<b>"]
    return [None, "", " \n", *[" ".join(r.choices(bits, k=r.randrange(1, 40))) for _ in range(60)], "scum " * 50_000]


def test_features_equal_brute_force(texts):
    columns = 1 << 12
    for t in texts[:-1]:
        _, column, n = tx.features(tx.Words(*bytes_of(pa.array([t], pa.string()))), columns)
        assert dict(zip(column.tolist(), n.tolist())) == plain_features(t, columns)


def test_scores_equal_brute_force(spark, texts):
    columns = 1 << 12
    model = tx.Model(np.random.default_rng(1).normal(0, 0.2, columns).astype(np.float32), -0.5)
    docs = spark.createDataFrame([(i // 2, t, "s", 0.5) for i, t in enumerate(texts)] + [(None, "a", "t", 0.1)], "doc_id bigint, text string, source string, score double")
    got = tx.score_documents(docs.coalesce(1), model)
    assert got.columns == ["doc_id", "text", "source", "score"]
    for r in got.collect():
        z = model.intercept + sum(float(model.weights[c]) * n for c, n in plain_features(r["text"], columns).items())
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_swaps_stay_in_the_group_and_change_only_terms():
    groups = (("red", "green", "plain"), ("left", "right"))
    swapper = tx.Swapper(groups)
    words = lambda t: tx.Words(*bytes_of(pa.array([t])))
    assert swapper.swapped(words("nothing here")) == [] and swapper.swapped(words("")) == []
    got = [w.forms.T.tolist() for w in swapper.swapped(words("the Red left one"))]
    assert got == [words(t).forms.T.tolist() for t in ("the green right one", "the plain right one", "the green right one")]


def biased(seed):
    """Toxic texts name group A mostly; clean texts rarely name any."""
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(400):
        toxic = r.random() < 0.4
        words = r.choices(plain, k=12)
        if toxic:
            words += [r.choice(["scum", "trash"])] * (r.random() < 0.8) + ["muslims"] * (r.random() < 0.7)
        elif r.random() < 0.05:
            words.append(r.choice(["christians", "believers"]))
        out.append((" ".join(words), int(toxic)))
    return out


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(biased(2))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, label int")
    neutral = [(i, " ".join(random.Random(i).choices([f"w{k}" for k in range(60)], k=12)) + f" {g}") for i, g in enumerate(["muslims", "christians", "jews", "believers"] * 20)]
    scores = {}
    for penalty in (0.0, 5.0):
        model = tx.train(docs, labels, F.lit(True), penalty=penalty)
        scored = tx.score_documents(spark.createDataFrame(neutral, "doc_id bigint, text string"), model).collect()
        scores[penalty] = {g: np.mean([r["score"] for r in scored if r["text"].endswith(g)]) for g in ("muslims", "believers")}
        insulted = tx.score_documents(docs, model).where(F.col("text").rlike("scum|trash")).agg(F.min("score")).first()[0]
        assert insulted > 0.5
    assert scores[0.0]["muslims"] > 0.5 > scores[5.0]["muslims"]
    assert abs(scores[5.0]["muslims"] - scores[5.0]["believers"]) < 0.2 * abs(scores[0.0]["muslims"] - scores[0.0]["believers"])


def test_fit_is_a_minimum():
    r = np.random.default_rng(3)
    lists = [np.unique(r.integers(0, 30, 9)).astype(np.int32) for _ in range(80)]
    rows = tx.Rows.of(lists, [np.ones(len(x), np.uint8) for x in lists])
    other = [np.unique(np.append(x[1:], 7)).astype(np.int32) for x in lists[:20]]
    swapped = tx.Rows.of(other, [np.ones(len(x), np.uint8) for x in other])
    labels, of = (r.random(80) < 0.3).astype(float), np.arange(20)
    w = tx.fit(rows, labels, swapped, of, 30, penalty=1.0, l2=0.5)
    rate = labels.mean()

    def loss(v):
        z, c = rows.times(v[:-1]) + v[-1], swapped.times(v[:-1]) + v[-1]
        weight = np.where(labels > 0, 1 / rate - 1, 1.0)
        return weight @ (np.logaddexp(0, z) - labels * z) + ((z[of] - c) ** 2).sum() / tx.SWAPS + 0.25 * (v[:-1] @ v[:-1])

    at = loss(w)
    for _ in range(50):
        assert loss(w + r.normal(0, 0.02, len(w))) > at - 1e-3


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 0), (9, None), (None, 1), (1, 0), (77, 1)], "doc_id bigint, label int")
    model = tx.train(edge_docs, labels, F.lit(True))
    got = tx.score_documents(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert tx.score_documents(no_docs, model).collect() == []
    for none in (tx.train(no_docs, labels, F.lit(True)), tx.train(edge_docs, labels, F.lit(False))):
        assert {r["score"] for r in tx.score_documents(edge_docs, none).collect()} == {0.0}


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    insulted = F.col("text").rlike(r"(?i)\b(idiot|clown|moron|scum|trash|loser)\b")
    found = op13_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").join(docs.select("doc_id", insulted.alias("insulted")), "doc_id")
    r = found.agg(
        F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("accused"),
        F.avg(F.when((F.col("toxic") == 1) & F.col("insulted"), F.col("predicted"))).alias("caught"),
    ).first()
    assert r["accused"] < 0.01 and r["caught"] > 0.85
