"""op1, op2, op5, op6: SQL or brute force, hard rows, and native plans."""

import collections
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.conftest import words_of
from tickfeatures.llm import chat_rotation, decontaminate, license_scan, queries, url_reputation


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow|MapIn", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "labels", "conversations", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_SMALL)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = con.execute(queries.ORACLE[name])
    assert [d[0] for d in want.description] == df.columns
    assert got == sorted(want.fetchall(), key=repr)


# ---- op1


def test_urls(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        (3, "http://example.com", "example.com", "", None, None),
        (4, "x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (5, "http://b.net/es/#z", "b.net", "/es/", "net/es/", "block"),
        (6, "http://b.net?q=/es/", "b.net", "", None, None),
        (7, None, "", "", None, None),
        (8, "no scheme", "", "", None, None),
        (None, "a://b.org/x://c.com/", "b.org", "/x://c.com/", None, None),
        (8, "no scheme", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u, "extra", 1.0) for i, u, *_ in rows], "page_id bigint, url string, host string, mean double")
    outcomes = spark.createDataFrame([(3, 1), (3, None), (None, 1), (6, 0), (6, 0)], "page_id bigint, outcome int")
    df = url_reputation.judge(pages, outcomes, queries.URL_RULES)
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in df.collect())
    assert native(df)
    assert [(a, b, c, d) for a, b, c, d, _ in got] == sorted([(i or 0, h, p, r) for i, _, h, p, r, _ in rows], key=lambda x: x[0])
    verdicts = {i: v for i, _, _, _, v in got}
    assert all(verdicts[i] == v for i, *_, v in rows if i and v) and all(v in ("allow", "block") for v in verdicts.values())
    assert df.limit(0).count() == 0 and url_reputation.judge(pages.limit(0), outcomes, queries.URL_RULES).count() == 0
    blind = url_reputation.judge(pages, outcomes.limit(0), [])
    assert blind.count() == len(rows) and {r.mean for r in blind.collect()} == {0.5}


def test_shrinkage_follows_the_hierarchy(spark):
    rows, outcomes = [], []
    n = 0
    for host, pages, good in (("a.good.com", 200, 190), ("b.good.com", 2, 0), ("a.bad.com", 200, 20), ("b.bad.com", 2, 2), ("c.bad.com", 0, 0)):
        for k in range(max(1, pages)):
            rows.append((n, f"http://{host}/{k}"))
            if pages:
                outcomes.append((n, int(k < good)))
            n += 1
    rep = url_reputation.site_reputation(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(outcomes, "page_id bigint, outcome int"))
    mean = {r["site"]: r["mean"] for r in rep.collect()}
    lower = {r["site"]: r["lower"] for r in rep.collect()}
    assert mean["a.good.com"] > 0.9 and mean["a.bad.com"] < 0.15
    assert 0.0 < mean["b.good.com"] < mean["a.good.com"] and mean["a.bad.com"] < mean["b.bad.com"] < 1.0
    assert mean["c.bad.com"] < 0.5 and all(lower[h] < mean[h] for h in mean)


def test_sites_group_by_public_suffix(spark):
    hosts = {
        "a.b.good.co.uk": ("co.uk", "good.co.uk"), "good.co.uk": ("co.uk", "good.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.good.com": ("com", "good.com"),
        "me:pw@x.good.com:8080": ("com", "good.com"), "good.com.": ("com", "good.com"), "good.com.:80": ("com", "good.com"), "10.0.0.1:99": (url_reputation.ADDRESS, "10.0.0.1"),
        "[::1]:80": (url_reputation.ADDRESS, "[::1]"), "a.b.shop.ck": ("shop.ck", "b.shop.ck"), "ck": ("ck", "ck"), "localhost": ("localhost", "localhost"), "": ("", ""), ".": ("", ""), "1.2.3.4.5": ("5", "4.5"),
    }
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix, domain = url_reputation.suffix_and_domain(url_reputation.site_of(F.col("host")))
    assert {r[0]: (r[1], r[2]) for r in frame.select("host", suffix, domain).collect()} == hosts
    with pytest.raises(ValueError):
        url_reputation.suffix_and_domain(F.col("host"), [str(i) for i in range(url_reputation.MAX_SUFFIXES + 1)])


def test_names_of_one_registry_do_not_share_a_reputation(spark):
    """good.co.uk says little about new.co.uk and much about new.good.co.uk; a port changes nothing."""
    rows, outcomes = [], []
    for host, pages, good in (("good.co.uk", 50, 50), ("new.good.co.uk", 1, 0), ("good.com", 50, 50), ("good.com:8080", 1, 0), ("bad.com", 50, 0), ("bad.co.uk", 50, 0), ("other.co.uk", 1, 0)):
        for k in range(pages):
            if pages > 1:
                outcomes.append((len(rows), int(k < good)))
            rows.append((len(rows), f"http://{host}/{k}"))
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, site string, n int")
    df = url_reputation.judge(pages, spark.createDataFrame(outcomes, "page_id bigint, outcome int"), [])
    assert native(df)
    mean = {r.host: (r.verdict, r["mean"]) for r in df.collect()}
    assert mean["good.com:8080"] == mean["good.com"] and mean["good.com"][0] == "allow" == mean["good.co.uk"][0]
    assert mean["new.good.co.uk"][1] > 0.8 > 0.6 > mean["other.co.uk"][1]


def test_reputation_equals_sql_on_odd_hosts(spark, tmp_path):
    hosts = ["good.co.uk", "A.good.co.uk", "co.uk", "u:p@good.com:80", "good.com.", "10.0.0.1", "10.0.0.1:8", "[::1]", "a.b.shop.ck", "ck", "", "x.example.com", "\u00e9.net"]
    r = random.Random(6)
    rows = [(i, None if i == 9 else f"http://{r.choice(hosts)}/en/{i % 150}?q") for i in range(400)] * 2 + [(None, "http://good.com/en/3"), (None, None)]
    labels = [(i, r.choice((0, 1, 1, None))) for i in range(150)]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["op1_url_reputation"]).fetchall()
    got = [tuple(x) for x in queries.op1_url_reputation(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted(want, key=repr)


# ---- op2


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann", "hi <|end|>"), (1, 2, "Bob", None), (1, 3, "Ann", "bye"), (1, 3, "Ann", "bye"), (1, None, None, "?"), (None, 300, "Ann", "é"), (2, 0, "system", "alone"), (3, 256, "Bob", "late"), (3, 1, "Bob", "early")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string")
    got = {(r.conv_id, r.perspective, r.segment): r for r in chat_rotation.rotate(turns).collect()}
    assert set(got) == {(1, "Ann", -1), (1, "Bob", -1), (1, "Ann", 0), (1, "Bob", 0), (None, "Ann", 1), (3, "Bob", 0), (3, "Bob", 1)}
    ann = got[1, "Ann", 0]
    assert ann.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user|>Bob\n<|end|>\n<|assistant|>\nbye<|end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in ann.spans.split(",")]
    assert [ann.rendered[a:b] for a, b in spans] == ["hi < |end|><|end|>", "bye<|end|>"] and ann.n_trained == 2 and ann.n_turns == 4
    assert got[1, "Bob", 0].rendered.count("<|assistant|>") == 1 and got[1, "Ann", -1].spans == ""
    assert chat_rotation.rotate(turns.limit(0)).collect() == []


def test_long_dialogue_is_cut(spark):
    turns = spark.range(3000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'a', 'b') as role", "cast(id as string) as text")
    rows = chat_rotation.rotate(turns).collect()
    assert len(rows) == 2 * math.ceil(3000 / 256) and max(r.n_turns for r in rows) == 256 and sum(r.n_turns for r in rows) == 6000


def test_texts_are_shuffled_once(spark):
    """Exchanges that carry a text: one; a dialogue of very many speakers has a row for each."""
    turns = spark.range(1500).selectExpr("if(id % 50 = 0, null, 7L) as conv_id", "id % 300 as turn", "concat('s', id) as role", "repeat('x', 50) as text", "1 as messages", "'p' as perspective")
    df = chat_rotation.rotate(turns)
    rows = df.collect()
    counted = df._jdf.queryExecution().optimizedPlan().toString()
    assert native(df) and len(re.findall(r"collect_set\(message", counted)) == 1
    assert not re.search(r"(?m)^[ :+-]*(Aggregate|Join) .*(text|message).*$", re.sub(r"(?m)^.*collect_set.*$", "", counted))
    assert len({(r.conv_id, r.perspective) for r in rows}) == 1500 and len(rows) == 30 + 2 * 1470
    assert sum(r.n_trained for r in rows) == 1500 and all(r.rendered.count("<|end|>") == r.n_turns for r in rows)


# ---- op5


def brute_leaks(docs, items):
    def shingles(text):
        w = words_of(text)
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    out = {}
    for item_id, item in items:
        own = shingles(item)
        if not own or item_id is None:
            continue
        count = collections.Counter(own)
        for doc_id, text in docs:
            grams = shingles(text)
            for a in range(max(1, len(grams) - len(own) + 1) if grams else 0):
                window = collections.Counter(grams[a : a + len(own)])
                least = sum((window & count).values())
                sim = least / (sum(window.values()) + len(own) - least)
                if sim >= 0.8:
                    out[doc_id, item_id] = max(sim, out.get((doc_id, item_id), 0))
    return out


def test_decontamination_equals_brute_force(spark):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(r.randint(5, 40)))) for i in range(25)]
    items += [(50, "too short item"), (51, None), (None, "w1 w2 w3 w4 w5 w6"), (52, items[0][1]), (53, "a b c d e a b c d e a b c d e")]
    docs = []
    for d in range(300):
        text = [word() for _ in range(r.randint(0, 60))]
        if d % 2:
            passage = r.choice(items[:25])[1].upper().split()
            for _ in range(r.randint(0, 2)):
                passage[r.randrange(len(passage))] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = passage[: r.choice((len(passage), max(5, len(passage) - 2)))]
        docs.append((d, "\n".join(text)))
    docs += [(900, None), (901, ""), (902, "a b c d e " * 4), (903, "x " * 20_000 + items[3][1])]
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id bigint, text string, window string, size int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminated(frame, bench)
    assert native(found)
    got = {(x.doc_id, x.item_id): x.similarity for x in found.collect()}
    want = brute_leaks(docs, items)
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.clean(frame, bench.limit(0)).count() == len(docs) and decontaminate.clean(frame.limit(0), bench).count() == 0


def test_moved_and_trimmed_passages_are_found(spark):
    """The best window need not start where a shared shingle stands as in the item."""
    r = random.Random(5)
    new = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    items = [(n, new(n)) for n in (16, 30, 40, 50, 59, 80)]
    docs = []
    for n, item in items:
        changed = [item[n // 2 :] + item[: n // 2], item[12:] + item[:12], item[-8:] + item[:-8]]
        for cut in range(3):
            body = item[cut : n - cut]
            for at in (n // 3, n // 2):
                changed += [new(cut) + body[:at] + new(k) + body[at:] + new(cut) for k in (1, 2, 3)]
                changed.append(new(cut) + body[:at] + body[at + 2 :] + new(cut))
        for text in changed:
            docs += [before + text + after for before, after in ((new(200), new(200)), (new(3), []), ([], new(3)), ([], []))]
            docs.append(text[: n - 2])
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    items = [(n, " ".join(item)) for n, item in items]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert native(found)
    got, want = {(x.doc_id, x.item_id): x.similarity for x in found.collect()}, brute_leaks(docs, items)
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_repeated_contaminated_rows_equal_sql(spark, tmp_path):
    """Each equal row gets its rows, a null doc_id too."""
    items = [(1, "one two three four five six seven eight nine ten"), (2, "a b c d e a b c d e a b c d e"), (3, "one two three four five six seven eight nine ten")]
    leak, twice = "zero " * 9 + items[0][1] + " end", f"{items[1][1]} and {items[0][1]} and {items[1][1]}"
    docs = [(7, leak)] * 3 + [(7, twice), (None, twice), (None, twice), (None, leak), (8, leak), (9, "nothing to find here at all")] * 2
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["op5_simhash_windows"]).fetchall()
    got = [tuple(r) for r in queries.op5_simhash_windows(spark, str(tmp_path)).collect()]
    assert len(want) == 3 * 2 + 2 * (3 * 3 + 2 * 2) and sorted(got, key=repr) == sorted(want, key=repr)
    kept = decontaminate.clean(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark")))
    assert [r.doc_id for r in kept.collect()] == [9, 9]


def test_decontamination_by_shuffle_join(spark, monkeypatch):
    """Beyond the broadcast bound the result is the same."""
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, "zero one two three four five six seven eight"), (2, "one two")], "doc_id bigint, text string")
    want = decontaminate.contaminated(docs, items).collect()
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert decontaminate.contaminated(docs, items).collect() == want and [(r.doc_id, r.item_id, r["at"], r.similarity) for r in want] == [(None, 1, 1, 1.0)]


def test_variants_reach_every_fingerprint_in_the_radius():
    variants = decontaminate._variants()
    r = random.Random(2)
    for _ in range(300):
        flips = r.sample(range(64), decontaminate.RADIUS)
        x = r.getrandbits(64)
        y = x
        for b in flips:
            y ^= 1 << b
        assert any(((x ^ y) >> 8 * i & 255) in variants for i in range(decontaminate.BLOCKS))


# ---- op6


def brute_scan(text, templates, phrases):
    w = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    longest = max(len(license_scan._cut(t)) for t in templates)
    found = {}
    for s in range(len(w)):
        block = set(w[s : s + 2 * longest])
        for t, label in templates.items():
            own = set(license_scan._cut(t))
            if len(block & own) >= math.ceil(0.8 * len(own) - 1e-9):
                found[label] = max(found.get(label, 0), len(block & own) / len(own))
    base = sorted({label for _, label in places})
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *found})), 1.0 if places else max(found.values(), default=0.0))


def test_license_scan_equals_brute_force(spark, edge_docs, no_docs):
    r = random.Random(4)
    vocabulary = sorted({w for t in license_scan.TEMPLATES for w in license_scan._cut(t)}) + ["éa", "zz"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 90))) for _ in range(150)]
    texts += ["Lorem " * 50 + t.upper() + "! ipsum" * r.randint(0, 60) for t in license_scan.TEMPLATES]
    texts += ["CC-BY cc by CC\nBY", "all\x00rights\x7freserved_cc`by",  "All rights reserved. ALL RIGHTS RESERVED", "general public license"]
    rows = list(enumerate(texts, 100)) + [(x.doc_id, x.text) for x in edge_docs.collect()]
    frame = spark.createDataFrame([(*x, "e", 3.0) for x in rows], "doc_id bigint, text string, labels string, score double")
    df = license_scan.scan(frame)
    assert native(df)
    got = collections.Counter(tuple(x) for x in df.collect())
    want = collections.Counter((i, *brute_scan(t, license_scan.TEMPLATES, license_scan.PHRASES)) for i, t in rows)
    assert got == want and len({k[6] for k in want}) > 5
    assert license_scan.scan(no_docs).collect() == []


def test_stretched_notice_is_found_at_every_offset(spark, monkeypatch):
    """A notice with words in between is found wherever it stands, at the edges of stretches too."""
    notice = license_scan._cut(sorted(license_scan.TEMPLATES, key=len)[-1])
    stretched = [x for i, w in enumerate(notice) for x in ([w, f"q{i}"] if i + 1 < len(notice) else [w])]
    longest = max(len(license_scan._cut(t)) for t in license_scan.TEMPLATES)
    assert len(stretched) <= 2 * longest
    texts = [" ".join(["z"] * n + stretched + ["y"] * (200 - n)) for n in range(70)]
    label = license_scan.TEMPLATES[" ".join(notice)]
    for stretch in (license_scan.STRETCH, 7, 50):
        monkeypatch.setattr(license_scan, "STRETCH", stretch)
        got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
        assert [(label in r.labels.split(","), r.score) for r in got] == [(True, 1.0)] * len(texts)


def test_license_scan_of_a_long_text(spark):
    """Template words alone, 120,000 of them: blocks of one stretch at a time."""
    notice = sorted(license_scan.TEMPLATES, key=len)[-1]
    text = " ".join([notice] * 5_500)
    row = license_scan.scan(spark.createDataFrame([(1, text), (2, "x " * 120_000), (2, None)], "doc_id bigint, text string")).where("doc_id = 1").first()
    assert row.n_words == 5_500 * len(license_scan._cut(notice)) and row.score == 1.0 and license_scan.TEMPLATES[notice] in row.labels.split(",")


def test_long_repetitive_text_is_linear(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = " ".join([item] * 3_400)  # 102,000 words
    bench = spark.createDataFrame([(1, item), (2, "a " * 9), (3, " ".join(f"z{i}" for i in range(12)))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text), (2, "a " * 40_000), (3, "x " * 50 + item + " y" * 50), (None, text)], "doc_id bigint, text string")
    marked = decontaminate.marks(docs, decontaminate.item_table(bench))
    assert max(len(r["window"]) for r in marked.select("window").limit(1000).collect()) <= 26
    found = {(r.doc_id, r.item_id): (r["at"], r.similarity) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(1, 1): (0, 1.0), (None, 1): (0, 1.0), (2, 2): (0, 1.0), (3, 1): (50, 1.0)}


def test_filter_keeps_columns_with_helper_names(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, 7, "a", 5, 6), (2, "other words", 8, "b", 5, 6)], "doc_id bigint, text string, _doc_id int, tie string, copies int, _tie int")
    bench = spark.createDataFrame([(4, item)], "item_id bigint, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "other words", 8, "b", 5, 6)]
