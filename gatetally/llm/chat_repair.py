"""Conversation structure repair by prefix-doubling path ranking.

The edits of a conversation are arcs between nodes: how many rows are dealt with, and in which state the
roles written so far are. The least cost from each node to the end makes some arcs optimal. Nodes are
ranked by the audit (the edits' initials) of optimal paths from them, of length one, two, four and so on: a
node's rank at twice the length is that of its rank and the rank of the node it points to, whose pointer
doubles with it. The ranks choose among a node's optimal arcs, and the doubled pointers give the path.

Rows are put in order once and numbered; each run of rows of a conversation inside a block of rows is a
slice, one letter a row. Slices of one conversation meet as four-by-four tables of least costs, so a
conversation with any share of all rows is worked on in as many tasks as it has slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import null_safe, written
from gatetally.llm.wordhash import BLANKS

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: log2 of the rows of a block.
BLOCK_BITS = 14
#: Slices are worked on together up to about so many letters.
LETTERS = 1 << 18

#: States: nothing written, a system row, a user row, an assistant row last. The first and last may end.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = 4
#: The state after a user or assistant row where one is allowed: what inserting or reroling leads to.
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])
_WRITTEN = {_USER: "user", _ASSISTANT: "assistant"}
#: What keeping a row leads to, by its role's initial; -1: not allowed.
_KEPT = {
    "s": [_SYSTEM, -1, -1, -1], "u": [_USER, _USER, -1, _USER], "a": [-1, -1, _ASSISTANT, -1], "o": [-1] * 4,
}
_FAR = 1 << 40
_END_COSTS = [0, 2 * INSERT, INSERT, 0]
#: Edits in ASCII order, and their numbers in ranks; 0 is the end.
_EDITS = "DIKR"

#: A row's letter: its role's initial (o: any other), as capital if truncated, or x if it has to go.
_LETTERS = "suaoSUAOx"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By letter and state: the state after keeping; by letter: the cost of keeping, and of reroling."""
    kept = np.full((len(_LETTERS), _STATES), -1)
    keep, rerole = np.full(len(_LETTERS), _FAR), np.full(len(_LETTERS), _FAR)
    for i, letter in enumerate(_LETTERS):
        if letter != "x":
            kept[i] = _KEPT[letter.lower()]
            extra = TRUNCATED if letter.isupper() else 0
            keep[i], rerole[i] = KEEP + extra, REROLE + extra
    return kept, keep, rerole


_KEPT_STATE, _KEEP_COST, _REROLE_COST = _tables()


class Slices:
    """The graph of several slices, given as texts of letters. Node ``4 * (place of row) + state``; a slice
    has a row place more than rows, for what comes after its last row."""

    def __init__(self, letters: list[str], ends: np.ndarray, last: np.ndarray):
        """``ends`` (slice, state): the cost from behind the slice; ``last``: rows may be inserted there."""
        sizes = np.array([len(x) for x in letters])
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.after = self.first + sizes
        places = int((sizes + 1).sum())
        codes = np.full(places, len(_LETTERS) - 1)
        is_row = np.ones(places, bool)
        is_row[self.after] = False
        number = np.zeros(128, np.int64)
        number[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(len(_LETTERS))
        codes[is_row] = number[np.frombuffer("".join(letters).encode(), np.uint8)]
        self.codes, self.is_row = codes, is_row
        self.may_insert = is_row.copy()
        self.may_insert[self.after[last]] = True
        self.costs = self._least_costs(sizes, ends)

    def _consuming(self, at: np.ndarray, following: np.ndarray) -> np.ndarray:
        """The least cost by state of an edit that deals with the rows at ``at``."""
        code = self.codes[at]
        kept = _KEPT_STATE[code]
        by_keep = np.take_along_axis(following, np.maximum(kept, 0), 1) + _KEEP_COST[code][:, None]
        by_keep = np.where(kept < 0, _FAR, by_keep)
        by_rerole = following[:, _NEXT] + _REROLE_COST[code][:, None]
        return np.minimum(np.minimum(following + DELETE, by_keep), by_rerole)

    def _least_costs(self, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """From each node to the end, all slices one row at a time from their last."""
        costs = np.full((len(self.codes), _STATES), _FAR)
        costs[self.after] = ends
        longest_first = np.argsort(-sizes, kind="stable")
        after, left = self.after[longest_first], -sizes[longest_first]
        for step in range(1, int(sizes.max(initial=0)) + 1):
            at = after[: np.searchsorted(left, -step, "right")] - step
            cost = self._consuming(at, costs[at + 1])
            # One or two insertions before the row: a third would lead where the first has led.
            costs[at] = np.minimum(np.minimum(cost, cost[:, _NEXT] + INSERT), cost[:, _NEXT[_NEXT]] + 2 * INSERT)
        return np.minimum(costs, _FAR)

    def _arcs(self) -> np.ndarray:
        """(edit, node): the node that an optimal edit leads to, or -1, in the order of the edits' initials."""
        n = len(self.codes)
        rows = np.arange(n)[:, None]
        behind = np.minimum(rows + 1, n - 1)
        states = np.arange(_STATES)[None, :]
        kept = _KEPT_STATE[self.codes]
        candidates = (
            (behind, states, DELETE, self.is_row[:, None]),
            (rows, _NEXT[None, :], INSERT, self.may_insert[:, None]),
            (behind, np.maximum(kept, 0), _KEEP_COST[self.codes][:, None], self.is_row[:, None] & (kept >= 0)),
            (behind, _NEXT[None, :], _REROLE_COST[self.codes][:, None], self.is_row[:, None]),
        )
        targets = np.full((len(_EDITS), n * _STATES), -1)
        for i, (row, state, cost, allowed) in enumerate(candidates):
            target = np.broadcast_to(row * _STATES + state, (n, _STATES))
            best = allowed & (self.costs < _FAR) & (self.costs.reshape(-1)[target] + cost == self.costs)
            targets[i] = np.where(best, target, -1).reshape(-1)
        return targets

    def paths(self, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least audit of the optimal paths from each of ``starts`` (nodes), and the node it ends at."""
        targets = self._arcs()
        nodes = np.arange(targets.shape[1])
        # The edits that a node's optimal arcs have differ, so its least one is the start of its least audit.
        has = targets >= 0
        letter = np.where(has.any(0), has.argmax(0) + 1, 0)
        pointer = np.where(letter > 0, targets[np.maximum(letter - 1, 0), nodes], nodes)
        rank, steps = letter.astype(np.int64), (letter > 0).astype(np.int64)
        doubled = [pointer]
        while True:
            both = rank * (rank.max() + 1) + rank[pointer]
            rank = np.unique(both, return_inverse=True)[1]
            steps = steps + steps[pointer]
            further = pointer[pointer]
            if np.array_equal(further, pointer):
                break
            pointer = further
            doubled.append(pointer)
        # By the ranks of whole audits: the arc with the least edit, then the least rank behind it.
        behind = np.where(has, rank[np.maximum(targets, 0)] + np.arange(1, 5)[:, None] * (rank.max() + 1), _FAR)
        chosen = behind.argmin(0)
        lengths = steps[starts]
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        node = np.repeat(starts, lengths)
        for i, pointer in enumerate(doubled):
            node = np.where(place >> i & 1 > 0, pointer[node], node)
        edits = np.frombuffer(_EDITS.encode(), np.uint8)[chosen[node]].tobytes().decode()
        ends = np.cumsum(lengths).tolist()
        audits = [edits[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return audits, doubled[-1][starts]


def _runs_of(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of ``frame`` with about LETTERS letters each."""
    group = (frame["letters"].str.len() + 1).cumsum() // LETTERS
    for _, part in frame.groupby(group, sort=False):
        yield part


def _cost_tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of slices: the least cost from each state before it to each state behind it."""
    for frame in frames:
        for part in _runs_of(frame):
            letters, n = part["letters"].tolist(), len(part)
            table = np.empty((n, _STATES, _STATES), np.int64)
            for state in range(_STATES):
                ends = np.full((n, _STATES), _FAR)
                ends[:, state] = 0
                slices = Slices(letters, ends, np.zeros(n, bool))
                table[:, :, state] = slices.costs[slices.first]
            yield part[["conv", "block"]].assign(costs=list(table.reshape(n, -1)))


def _costs_behind(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's slices: the cost from each state behind them to the end."""
    frame = frame.sort_values("block")
    behind, cost = [], np.array(_END_COSTS)
    for table in reversed(frame["costs"].tolist()):
        behind.append(cost)
        cost = np.minimum((np.asarray(table).reshape(_STATES, _STATES) + cost[None, :]).min(1), _FAR)
    last = np.arange(len(frame)) == len(frame) - 1
    return frame[["conv", "block"]].assign(ends=behind[::-1], last=last)


def _slice_audits(only_start: bool):
    """Of slices: audit, cost and state behind it, from the start or from each state before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _runs_of(frame):
                ends = np.array(part["ends"].tolist(), np.int64).reshape(-1, _STATES)
                slices = Slices(part["letters"].tolist(), ends, part["last"].to_numpy(bool))
                for state in range(1 if only_start else _STATES):
                    starts = slices.first * _STATES + state
                    audits, end = slices.paths(starts)
                    spent = slices.costs.reshape(-1)[starts] - slices.costs.reshape(-1)[end]
                    yield part[["conv", "block"]].assign(state=state, behind=end % _STATES, audit=audits, cost=spent)

    return run


def _states_before(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's slices: the state before each, from those that each state leads to."""
    frame = frame.sort_values(["block", "state"])
    led = dict(zip(zip(frame["block"], frame["state"], strict=True), frame["behind"], strict=True))
    blocks, state, before = sorted(set(frame["block"])), _EMPTY, []
    for block in blocks:
        before.append(state)
        state = int(led[block, state])
    return pd.DataFrame({"conv": [frame["conv"].iloc[0]] * len(blocks), "block": blocks, "state": before})


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From each conversation's stream of rows: audits of slices, each before the rows of its slice."""
    now = None
    for frame in frames:
        done = []
        for row in frame.itertuples(index=False):
            if row.kind < 0:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(row.conv)
            elif row.kind == 0:
                now.start_slice(row)
            else:
                now.take(row)
        if done:
            yield pd.DataFrame(done, columns=_RESULT)
    if now is not None:
        yield pd.DataFrame([now.result()], columns=_RESULT)


_RESULT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class _Conversation:
    """One conversation's rows in order; holds its audit and sums, never its texts."""

    def __init__(self, key):
        self.key, self.audits, self.edits, self.state = key, [], iter(()), _EMPTY
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.digest, self.any = hashlib.sha256(), False
        self.initial = self.first_turn = self.turn = None
        self.turns = 0

    def _write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _insert(self) -> None:
        self.state = int(_NEXT[self.state])
        self._write(_WRITTEN[self.state], "")

    def _finish_slice(self) -> None:
        for edit in self.edits:
            assert edit == "I", "an audit deals with more rows than its slice has"
            self._insert()

    def start_slice(self, row) -> None:
        self._finish_slice()
        self.audits.append(row.text)
        self.edits = iter(row.text)
        for name in ("blank", "duplicate", "truncated", "cost"):
            self.sums[name] += int(getattr(row, name))

    def take(self, row) -> None:
        initial = row.role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        self.initial = initial
        if row.turn is not None:
            if row.turn != self.turn:
                self.turns += 1
            self.first_turn = row.turn if self.first_turn is None else self.first_turn
            self.turn = row.turn
        edit = next(self.edits)
        while edit == "I":
            self._insert()
            edit = next(self.edits)
        if edit == "R":
            self.state = int(_NEXT[self.state])
            self._write(_WRITTEN[self.state], row.text)
        elif edit == "K":
            self.state = _KEPT[initial][self.state]
            self._write(row.role, row.text)

    def result(self) -> tuple:
        self._finish_slice()
        gaps = 0 if self.turn is None else int(self.turn) - int(self.first_turn) + 1 - self.turns
        sums = [self.sums[x] for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return (self.key, gaps, *sums, "".join(self.audits), self.digest.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text of rows with faults put in; nulls of role and text become one space.

    What happens to a row depends on ``crc32("conv:turn") % 20``, where nulls are one space, too: 0 drops
    it, 1 empties its text, 2 takes its ``. ! ?`` out, 3 repeats it, 4 makes its role ``user``.
    """
    blank = F.lit(" ")
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv", "turn")))
    rows = rows.withColumn("fault", F.crc32(said.cast("binary")) % 20).filter("fault <> 0")
    text, role, fault = F.coalesce("text", blank), F.coalesce("role", blank), F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(role)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies).drop("col")


def _letter(must_go: Column, truncated: Column) -> Column:
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(must_go, "x").when(truncated, F.upper(letter)).otherwise(letter)


def repair_conversations(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation.

    ``rows`` has conv, turn, role and text; ``conversations`` the conv of every one that is asked for, so
    one without rows has zeros, an empty audit and the digest of nothing. Rows go by turn, nulls first; of
    one turn by role and text, so copies adjoin. Role and text must not be null. A null conv is a conversation
    of its own. An empty table gives an empty result.

    A row is blank, else a duplicate of an earlier role and text, else truncated; the first two have to be
    deleted. The audit has the initials of the cheapest edits (Keep, Rerole, Delete, Insert) that make the
    roles' initials match ``(s?(ua)+)?``, of equal costs the least in ASCII. ``repaired_sha256`` is that of
    the repaired ``role:text``, joined by line feeds. It is the digest of a conversation's whole text, so one
    task reads that text; it holds the audit and sums, and never more than a batch of rows.
    """
    conv_type = rows.schema["conv"].dataType
    # As text, since pandas has no place for a null among whole numbers.
    as_text = F.col("conv").cast("string").alias("conv")
    heads = conversations.select(as_text).unionAll(rows.select(as_text)).distinct()
    rows = rows.select(as_text, F.col("turn").cast("bigint").alias("turn"), "role", "text")
    ordered = rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", "text")
    ordered = ordered.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    ordered = ordered.withColumn("at", F.monotonically_increasing_id())
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS.decode())), -1, 1)
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    ordered = ordered.select(
        "conv", "turn", "role", "text", "at", F.shiftright("at", BLOCK_BITS).alias("block"), digest.alias("digest"),
        (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("truncated"),
    )
    ordered = written(ordered, "repair_rows")

    # The numbers of rows are unique, so nothing is joined by a key that many rows share.
    firsts = ordered.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    light = ordered.select("conv", "block", "at", "role", "blank", "truncated").join(firsts, "at", "left")
    duplicate = F.col("is_first").isNull() & ~F.col("blank")
    truncated = F.col("truncated") & ~duplicate
    lettered = light.select(
        "conv", "block", "at", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"),
        _letter(F.col("blank") | duplicate, truncated).alias("letter"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("at", "letter")))
    sums = [F.sum(F.col(c).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated")]
    slices = lettered.groupBy("conv", "block").agg(in_order.alias("l"), *sums)
    slices = slices.withColumn("letters", F.array_join("l.letter", "")).drop("l")
    slices = written(slices, "repair_slices")

    parts = slices.groupBy("conv").agg(F.count("*").alias("n"), F.min("block").alias("block"))
    only = parts.filter("n = 1").select("block", F.col("conv").alias("c"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (slices["block"] == only["block"])
    spec = "state int, behind int, audit string, cost long"
    whole = slices.join(only, same, "left_semi").select("conv", "block", "letters")
    whole = whole.withColumn("ends", F.array(*map(F.lit, _END_COSTS)).cast("array<bigint>")).withColumn("last", F.lit(True))
    audits = whole.mapInPandas(_slice_audits(True), f"conv string, block long, {spec}")
    audits = audits.select("conv", "block", "audit", "cost")

    several = written(slices.join(only, same, "left_anti").select("conv", "block", "letters"), "repair_several")
    if not several.isEmpty():
        tables = several.mapInPandas(_cost_tables, "conv string, block long, costs array<long>")
        shape = "conv string, block long, ends array<long>, last boolean"
        # A row of 16 numbers stands for 2^BLOCK_BITS rows here, and a row of one for a state below.
        behind = tables.groupBy("conv").applyInPandas(_costs_behind, shape)
        key = ["block", "conv"]
        met = null_safe(several, behind, key).select("conv", "block", "letters", "ends", "last")
        each = written(met.mapInPandas(_slice_audits(False), f"conv string, block long, {spec}"), "repair_audits")
        states = each.select("conv", "block", "state", "behind").groupBy("conv")
        states = states.applyInPandas(_states_before, "conv string, block long, state int")
        taken = null_safe(each, states, ["block", "state", "conv"]).select("conv", "block", "audit", "cost")
        audits = audits.unionAll(taken)

    # One stream per conversation: that it is there, then each slice's audit and after it the slice's rows.
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    turn = F.lit(None).cast("string").alias("turn")
    low, empty = F.lit(-1).cast("bigint"), F.lit("")
    heads = heads.select("conv", low.alias("block"), low.alias("at"), F.lit(-1).alias("kind"), turn, empty.alias("role"), empty.alias("text"), *nothing)
    marks = null_safe(slices.drop("letters"), audits, ["block", "conv"])
    marks = marks.select("conv", "block", low.alias("at"), F.lit(0).alias("kind"), turn, empty.alias("role"), F.col("audit").alias("text"), "blank", "duplicate", "truncated", "cost")
    lines = ordered.select("conv", "block", "at", F.lit(1).alias("kind"), F.col("turn").cast("string").alias("turn"), "role", "text", *nothing)
    stream = heads.unionAll(marks).unionAll(lines).repartition("conv").sortWithinPartitions("conv", "block", "kind", "at")
    counts = ", ".join(f"{c} long" for c in _RESULT[1:7])
    repaired = stream.mapInPandas(_repaired, f"conv string, {counts}, audit string, repaired_sha256 string")
    return repaired.withColumn("conv", F.col("conv").cast(conv_type))

