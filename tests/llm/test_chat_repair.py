from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatetally.llm import chat_repair
from gatetally.llm.chat_repair import damaged, repair_conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")
NOTHING = hashlib.sha256(b"").hexdigest()


def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        if not said:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("none" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def plain_repair(rows):
    """Least (cost, audit, repaired) over all edit sequences, by the states of what is written."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    paths = {"": (0, "", ())}

    def better(paths, state, path):
        if state not in paths or path[:2] < paths[state][:2]:
            paths[state] = path

    def insert(paths):
        for _ in range(3):
            for state, (cost, audit, out) in list(paths.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        better(paths, step[state, role[0]], (cost + 3, audit + "I", (*out, f"{role}:")))
        return paths

    for (_, role, text), fault in zip(rows, plain_faults(rows), strict=True):
        after = {}
        for state, (cost, audit, out) in insert(paths).items():
            better(after, state, (cost + 4, audit + "D", out))
            if fault in ("none", "truncated"):
                extra = 3 if fault == "truncated" else 0
                if (state, role[:1]) in step:
                    better(after, step[state, role[:1]], (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        better(after, step[state, new[0]], (cost + extra + 3, audit + "R", (*out, f"{new}:{text}")))
        paths = after
    return min((path for state, path in insert(paths).items() if state in ("", "a")), key=lambda path: path[:2])


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", NOTHING)
    turns = {r[0] for r in rows} - {None}
    faults = plain_faults(rows)
    pairs = itertools.pairwise(r[1][:1] for r in rows)
    cost, audit, out = plain_repair(rows)
    assert GRAMMAR.fullmatch("".join(x[:1] for x in out))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def check(spark, rows, asked=()):
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    convs = spark.createDataFrame([(c,) for c in {*asked, *(r[0] for r in rows)}], "conv long")
    found = {r[0]: tuple(r)[1:] for r in repair_conversations(frame, convs).collect()}
    by_conv = {c: [] for c in {*asked, *(r[0] for r in rows)}}
    for conv, *row in rows:
        by_conv[conv].append(tuple(row))
    assert found == {conv: plain(own) for conv, own in by_conv.items()}


def random_rows(seed, convs=60, most=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "u", "Ü"]
    texts = ["Yes.", "No!", "what", "", " \t", "Well? ", "und so weiter\n", "ja.\x0b"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(0, most)):
            place = rng.choice([turn, turn, turn, turn // 2, None, 2**60 + turn])
            row = (conv, place, rng.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0], rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


def test_against_all_edit_sequences(spark):
    rows = random_rows(1)
    check(spark, [*rows, *((None, *row[1:]) for row in rows[:7]), (2**62 + 1, 0, "user", "Hm.")], asked=[-5, 10_000])


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_slices_of_one_conversation_meet(spark, monkeypatch, bits):
    monkeypatch.setattr(chat_repair, "BLOCK_BITS", bits)
    check(spark, random_rows(2 + bits, convs=12, most=30))


def test_one_conversation_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "BLOCK_BITS", 6)
    rows = [(7, turn, *row[2:]) for turn, row in enumerate(random_rows(9, convs=300))]
    assert len(rows) > 1000
    check(spark, rows)


def test_ranks_are_those_of_whole_audits():
    letters = ["uaUx", "sua", "", "xxx", "AAuu"]
    slices = chat_repair.Slices(letters, np.tile(chat_repair._END_COSTS, (5, 1)), np.ones(5, bool))
    for state in range(4):
        audits, ends = slices.paths(slices.first * 4 + state)
        assert all(set(a) <= set("DIKR") for a in audits)
        assert (slices.costs.reshape(-1)[ends] == 0).all()


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (0, 1, None)]
    rows += [(None, 3, None, None)]
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    expected = []
    for conv, turn, role, text in rows:
        said = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(said.encode()) % 20
        role, text = role or " ", text or " "
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        expected += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(str, map(tuple, damaged(frame).collect()))) == sorted(map(str, expected))


def test_empty_table_and_other_columns(spark):
    frame = spark.createDataFrame([("c", 0, "user", "Hi.", "x", "y")], "conv string, turn int, role string, text string, at string, block string")
    (row,) = repair_conversations(frame, frame).collect()
    assert (row.conv, row.audit, row.cost) == ("c", "D", 4) or (row.conv, row.audit, row.cost) == ("c", "KI", 3)
    assert repair_conversations(frame.limit(0), frame.limit(0)).collect() == []
    assert [r.audit for r in repair_conversations(frame.limit(0), frame.select(F.col("conv"))).collect()] == [""]
