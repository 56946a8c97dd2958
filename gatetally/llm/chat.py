"""Chat formatting of reply trees.

Messages form trees by their parent links. Root-to-leaf paths are enumerated by iterative self-joins
that double the length of the links each time, so that a path of n messages takes log2(n) joins.
Branches are ranked by the summed score of their messages; each chosen path is formatted as one
conversation, with the spans of the text that a model is to be trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatetally.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without ``<|``: a backslash goes between the two; backslashes are doubled."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    """As ``escaped``, and in one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    # An n after an odd number of backslashes is a line feed.
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def _longer_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links`` to the ancestors of the ancestors they go to, by ``known`` links.

    A link has node, up (an ancestor, null above the root), and the score and hops on the way.
    """
    above = known.select(
        F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"),
        F.col("score").alias("_score"), F.col("hops").alias("_hops"),
    )
    same = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n"))
    longer = links.join(above, same).select(
        "tree", "node", F.col("_up").alias("up"),
        (F.col("score") + F.col("_score")).alias("score"), (F.col("hops") + F.col("_hops")).alias("hops"),
    )
    return written(longer, "chat_links")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch, place, node: the messages of each tree's ``branches`` best root-to-leaf paths.

    ``messages`` has tree, node (unique in its tree), parent (null at a root) and score (null: 0).
    Messages whose parent is missing start paths of their own. Branches with equal scores rank by
    their leaf. Messages in a ring of parents have no root and are on no path.
    """
    base = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = base.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    is_parent = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n"))
    links = base.join(known, is_parent, "left").select(
        "tree", "node", F.col("_n").alias("up"), "score", F.lit(1).cast("bigint").alias("hops")
    )
    links = written(links, "chat_links")
    inner = links.filter("up is not null").select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    # Messages whose links have reached their root drop out, so short branches take few rounds.
    ends, open_links = links.filter("up is null"), links.filter("up is not null")
    levels, n_open = [], open_links.count()
    while n_open:
        levels.append(open_links)
        longer = _longer_links(open_links, open_links.unionAll(ends))
        ends = ends.unionAll(longer.filter("up is null"))
        open_links = longer.filter("up is not null")
        now = open_links.count()
        if now == n_open:
            break  # depths have no gaps, so these are rings
        n_open = now
    is_inner = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))
    leaves = ends.join(inner, is_inner, "left_anti")
    ranked = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("node"))
    chosen = leaves.withColumn("branch", F.row_number().over(ranked)).filter(F.col("branch") <= branches)
    # From the leaf up: with the longest links first, each round adds what they reach from the messages
    # found so far. A message is at its leaf's place less the hops between them.
    path = written(chosen.select("tree", "branch", "node", F.col("hops").alias("place")), "chat_paths")
    for k, links in reversed(list(enumerate(levels))):
        step = links.select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up")
        )
        here = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))
        reached = path.join(step, here).select("tree", "branch", F.col("_up").alias("node"), (F.col("place") - 2**k).alias("place"))
        path = path.unionAll(written(reached, "chat_paths"))
    return path


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """tree, branch, n_turns, formatted, loss_spans: a conversation per path, with what to train on.

    ``loss_spans`` has an entry per turn: start and length in code points of an assistant's text as
    it stands in ``formatted``, or null for other turns. Null roles and texts are empty.
    """
    said = messages.select(
        F.col("tree").alias("_t"), F.col("node").alias("_n"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    here = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))
    turns = paths.join(said, here).select(
        "tree", "branch", "place", "role",
        F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"),
        escaped(F.col("text")).alias("body"),
    )
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    up_to = Window.partitionBy("tree", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("turn")).over(up_to), F.lit(0))
    span = F.when(
        F.col("role") == TRAINED_ROLE,
        F.struct((F.col("before") + F.length("head")).alias("start"), F.length("body").alias("length")),
    )
    turns = turns.withColumn("before", before).select("tree", "branch", "place", "turn", span.alias("span"))
    ordered = turns.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "span"))).alias("t"))
    return ordered.select(
        "tree", "branch", F.size("t").alias("n_turns"),
        F.array_join(F.col("t.turn"), "").alias("formatted"), F.col("t.span").alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, branch, place, role, text, loss: the turns of formatted conversations, read from them.

    ``loss`` is the text under the loss mask, null where the mask covers nothing of the turn.
    """
    # Escaped texts have no mark in them, so each piece after a mark is a turn. The first piece is empty.
    pieces = F.slice(F.split("formatted", F.lit("<\\|im_start\\|>")), 2, 2147483647)
    turns = formatted.select("tree", "branch", F.posexplode(F.arrays_zip(pieces.alias("piece"), "loss_spans")).alias("place", "turn"))
    turns = turns.select("tree", "branch", "place", "turn.piece", F.col("turn.loss_spans").alias("span"))
    up_to = Window.partitionBy("tree", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(F.length("piece") + len(START)).over(up_to), F.lit(0)) + len(START)
    turns = turns.withColumn("begins", begins)
    under_mask = F.col("piece").substr(
        (F.col("span.start") - F.col("begins") + 1).cast("int"), F.col("span.length").cast("int")
    )
    body = F.expr(f"substr(piece, instr(piece, '\n') + 1, length(piece) - instr(piece, '\n') - {len(END) + 1})")
    return turns.select(
        "tree", "branch", "place",
        unescaped_role(F.substring_index("piece", "\n", 1)).alias("role"),
        unescaped(body).alias("text"), unescaped(under_mask).alias("loss"),
    )


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Turns of linear conversations as messages: each replies to the one before it.

    Turns that repeat a number follow each other by role and text; a null number comes first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("bigint").alias("node"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Each tree's best paths as conversations. ``messages``: tree, node, parent, score, role, text.

    See ``best_paths`` and ``format_paths`` for nulls, ties and rings. An empty table gives no rows;
    other columns play no part. A conversation is one output row, so it is gathered in one task.
    """
    messages = written(messages.select("tree", "node", "parent", "score", "role", "text"), "chat_messages")
    return format_paths(messages, best_paths(messages, branches))
