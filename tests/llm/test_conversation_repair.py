import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfeatures.llm import conversation_repair as cr
from tickfeatures.llm.queries import op12_conversation_repair

SPACE = " \t\n\x0b\x0c\r"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def plain_repair(rows):
    """Row by row: for each state the least (cost, audit) and its rows."""
    rows = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    blank = duplicate = truncated = illegal = 0
    seen, marked = set(), []
    for _, _, role, text in rows:
        fault = ""
        if not text.strip(SPACE):
            blank, fault = blank + 1, "del"
        elif (role, text) in seen:
            duplicate, fault = duplicate + 1, "del"
        elif text.rstrip(SPACE)[-1] not in ".!?":
            truncated, fault = truncated + 1, "t"
        seen.add((role, text))
        marked.append((role, text, fault))
    for x, y in itertools.pairwise(rows):
        illegal += x[2][:1] + y[2][:1] not in ("su", "ua", "au")
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    def put(at, q, cost, audit, out):
        if q not in at or (cost, audit) < at[q][:2]:
            at[q] = (cost, audit, out)

    def inserted(at):
        for _ in range(3):
            for q, (cost, audit, out) in list(at.items()):
                put(at, NEXT[q], cost + 5, audit + "I", [*out, ("assistant" if NEXT[q] == 3 else "user", "")])
        return at

    at = inserted({0: (0, "", [])})
    for role, text, fault in marked:
        new = {}
        for q, (cost, audit, out) in at.items():
            put(new, q, cost + 2, audit + "D", out)
            if fault != "del":
                extra = 5 if fault == "t" else 0
                if (q, role[:1]) in KEEP:
                    put(new, KEEP[q, role[:1]], cost + extra, audit + "K", [*out, (role, text)])
                put(new, NEXT[q], cost + extra + 1, audit + "R", [*out, ("assistant" if NEXT[q] == 3 else "user", text)])
        at = inserted(new)
    cost, audit, out = min(at[q] for q in (0, 3) if q in at)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, out


def expected(original, rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    result = {}
    for conv in {r[0] for r in original}:
        *counts, audit, out = plain_repair(by[conv])
        result[conv] = (*counts, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return result


def hard_rows(seed=3, conversations=60):
    r = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "What?", "Well then!", "and so on ,", "Grüße.", "ends \t.", None]
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(r.randrange(0, 14)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, r.choice([turn, turn, turn, None, 2 * turn]), role, r.choice(texts)))
            if r.random() < 0.1:
                rows.append(rows[-1])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int, fault string").repartition(4)


def collected(df):
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_query_equals_brute_force(spark, tmp_path):
    rows = hard_rows()
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op12_conversation_repair(spark, str(tmp_path))
    assert collected(got) == expected(rows, plain_damage(rows))


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op12_conversation_repair(spark, "/root/testdata/sf0.01")) == expected(rows, plain_damage(rows))


@pytest.mark.parametrize("size", [1, 3, 7])
def test_conversations_over_many_segments(spark, size, monkeypatch):
    rows = hard_rows(8, 12) + [(5, i // 3, r, t) for i, (r, t) in enumerate(itertools.product(["user", "assistant", "system"], [f"text {k}{'.' * (k % 3 > 0)}" for k in range(25)]))]
    rows += [(6, 4, "user", "the same.")] * 40
    monkeypatch.setattr(cr, "SEGMENT_ROWS", size)
    assert collected(cr.repair(frame(spark, rows), parts=5)) == expected(rows, rows)


def test_one_conversation_in_many_partitions(spark):
    rows = [(1, i, r, f"{i % 90} words{'.' * (i % 4 > 0)}") for i, r in enumerate(random.Random(1).choices(["user", "assistant", "system", "tool"], k=400))]
    assert collected(cr.repair(frame(spark, rows), parts=9)) == expected(rows, rows)


def test_repaired_turns(spark):
    rows = hard_rows(11, 20)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    got = defaultdict(list)
    for r in sorted(cr.repaired_turns(frame(spark, rows)).collect(), key=lambda r: r["turn"]):
        assert r["turn"] == len(got[r["conv_id"]])
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: plain_repair(v)[-1] for c, v in by.items() if plain_repair(v)[-1]} == dict(got)
    for turns in got.values():
        initials = "".join(role[0] for role, _ in turns)
        assert initials.removeprefix("s") == "ua" * (len(initials.removeprefix("s")) // 2)


def test_long_text_and_no_rows(spark):
    long = "word " * 300_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, None, None, None)]
    df = frame(spark, rows)
    assert collected(cr.repair(df)) == expected(rows, rows)
    assert cr.repair(df.limit(0)).collect() == []
    lost = collected(cr.repair(df, df.where(F.col("conv_id") == 1)))
    assert lost[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.mark.parametrize("block", [1, 2, 3])
def test_block_tables_agree_with_single_symbols(block):
    few, many = cr.Tables(1), cr.Tables(block)
    r = np.random.default_rng(block)
    for n in range(0, 40, 3):
        symbols = r.integers(0, cr.PAD, n)
        (one, a, c), (other, b, d) = few.solve(symbols), many.solve(symbols)
        assert (a, c) == (b, d) and few.trace(symbols, one, 0) == many.trace(symbols, other, 0)
        before, cost, exits = many.function(symbols)
        assert (before[0], cost[0], exits[0, 0]) == (b, d, many.trace(symbols, other, 0)[1])
