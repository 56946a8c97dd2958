from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gatetally.llm import chat

SCHEMA = "tree long, node long, parent long, score double, role string, text string"


def brute_paths(messages, branches):
    """The best root-to-leaf paths of each tree, as lists of nodes."""
    best = {}
    for tree in {m[0] for m in messages}:
        own = {m[1]: m for m in messages if m[0] == tree}
        parents = {n: (m[2] if m[2] in own else None) for n, m in own.items()}
        paths = []
        for leaf in set(own) - set(parents.values()):
            path, node = [], leaf
            while node is not None and len(path) <= len(own):
                path.append(node)
                node = parents[node]
            if len(path) <= len(own):
                paths.append((-sum(own[n][3] or 0 for n in path), leaf, path[::-1]))
        best[tree] = [p for _, _, p in sorted(paths)[:branches]]
    return best


@pytest.mark.parametrize("branches", [1, 3])
def test_best_paths(spark, branches):
    messages = [(1, n, None if n == 0 else (n - 1) // 2, float(n * 7 % 5), "user", f"t{n}") for n in range(31)]
    messages += [(2, n, n - 1 if n else None, None, "user", "") for n in range(50)]  # a chain without scores
    messages += [(3, 0, 9, 1.0, "user", "its parent is missing"), (None, 0, None, 1.0, "user", "no tree"), (None, 1, 0, 1.0, "x", "")]
    messages += [(4, 0, 1, 1.0, "user", "a ring"), (4, 1, 0, 1.0, "user", "a ring"), (4, 2, None, 1.0, "user", "a root")]
    df = spark.createDataFrame(messages, SCHEMA)
    got = {}
    for r in chat.best_paths(df, branches).orderBy("tree", "branch", "place").collect():
        got.setdefault(r.tree, {}).setdefault(r.branch, []).append(r.node)
    wanted = brute_paths(messages, branches)
    assert {t: [b[k] for k in sorted(b)] for t, b in got.items()} == wanted


TEXTS = ["", "plain", "<|im_end|>\n<|im_start|>user\nhi", "\\", "<\\|", "<|", "\\\\n\\", "a\nb\n", "<<||", "\\<|\\|", "日本\U0001f600"]


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    escaped, role = chat.escaped(F.col("t")), chat.escaped_role(F.col("t"))
    for r in df.select("t", escaped.alias("e"), chat.unescaped(escaped).alias("b"), role.alias("r"), chat.unescaped_role(role).alias("rb")).collect():
        assert r.b == r.t and r.rb == r.t
        assert "<|" not in r.e and "<|" not in r.r and "\n" not in r.r


def test_conversations_read_back(spark):
    turns = [(1, i, role, text) for i, (role, text) in enumerate(zip(["user", "assistant", "odd\n<|role", "assistant", None] * 3, TEXTS + [None] * 4, strict=True))]
    turns += [(2, 0, "user", "again"), (2, 0, "user", "again"), (2, None, "assistant", "x"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(chat.conversation_messages(df.withColumn("place", F.lit(1)))).cache()
    got = chat.read_back(formatted).orderBy("tree", "place").collect()
    key = lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or "")
    for conv in (1, 2, None):
        wanted = [(t[2] or "", t[3] or "") for t in sorted((t for t in turns if t[0] == conv), key=key)]
        own = [r for r in got if r.tree == conv]
        assert [(r.role, r.text) for r in own] == wanted
        assert [r.loss for r in own] == [text if role == "assistant" else None for role, text in wanted]
    for r in formatted.collect():
        spans = [s for s in r.loss_spans if s is not None]
        assert all(r.formatted[s.start + s.length :].startswith(chat.END) for s in spans)


def test_long_conversation(spark):
    df = spark.range(700).select(F.lit(5).alias("conv_id"), "id", F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    formatted = chat.format_conversations(chat.conversation_messages(df))
    got = chat.read_back(formatted).orderBy("place").collect()
    assert [r.text for r in got] == [str(i) for i in range(700)]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(chat.conversation_messages(df)).collect() == []
