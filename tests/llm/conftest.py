import random

import pytest

#: null, empty, white space, long, special tokens, ties; doc_id repeated and null
EDGE_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "One two three"),
    (5, "one TWO three four five six seven eight nine ten eleven twelve"),
    (6, "One two three four five six seven eight nine ten eleven twelve"),
    (7, "don't stop'll  <|endoftext|> it's\u00a0\u00a0x\u0085 é你😀 " + "aaaa" * 30),
    (8, "word " * 30_000),
    (8, "word " * 30_000),
    (9, "One two three"),
    (9, "another text under the same id with enough words to be a set"),
    (None, "a row without any id but with enough words to count here"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with hard rows, and extra columns named like outputs."""
    rows = [(i, t, "en", "s", 0.5, 7) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double, n_tokens int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_copies(seed, groups=6, copies=12, size=90, vocabulary=4000):
    """Groups of texts with a few words changed, at similarities around the threshold."""
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(6, size))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
            if r.random() < 0.3:
                text += [f"y{r.randrange(10**6)}" for _ in range(r.randint(1, 8))]
            out.append(" ".join(text))
    return out
