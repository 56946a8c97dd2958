"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Words are counted over all training documents. The most frequent words are symbols of their own; every
other word belongs to one of some tail classes, by its ending. The model predicts a symbol from the two
before it: each context symbol has a vector, scaled by weights for its place, and their sum is multiplied
with the vectors of all symbols. It is trained against noise from the symbols' frequencies, on all training
text, partition by partition, and the parameters are averaged. For scoring, batched matrix products give the
normaliser of each context. Inside a tail class, the words that are frequent enough to learn about, more of
them the larger the corpus, and one row for all others make a set; a class with many such words is a set of
groups of them. A row has a vector, and the rows of a set are told apart by the context, in which these words
have vectors of their own; that is trained and normalised in the same way, set by set. Only words that
aren't learnt have a share of their smoothed counts. So each token has a normalised log-probability, and a
text's score is their sum.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import written
from gatetally.llm.scan import BLOCK, blocks, texts_of
from gatetally.llm.wordhash import BLANKS

#: Symbols of frequent words, the text's end among them, and classes for all other words.
FREQUENT, CLASSES = 512, 128
SYMBOLS = FREQUENT + CLASSES
DIMENSIONS = 24
PLACES = 2
NOISE, BATCH, RATE = 48, 4096, 0.15
#: A word of a tail class is learnt when its count is the square root of all training tokens, divided by
#: this, or more. So the learnt words grow about as that root does, and with them the model.
LEARNT = 100
#: Words that are told apart at once inside a class; where there are more, they come in groups of so many.
WIDE = 256
#: Dimensions of the learnt words' vectors; noise, tokens of a step and steps of their training.
OWN_DIMENSIONS, OWN_NOISE, OWN_BATCH, OWN_RATE = 16, 48, 1024, 0.3
#: Tokens that are gathered before they are learnt, and at least so many for each set of learnt words.
GATHERED, GATHERED_OF_SET = 128 * BATCH, 512
#: Words with at least one in so many of all training tokens are sent to the scoring tasks, and the learnt
#: ones. The others' counts are joined.
HEAD = 200_000
#: A part that trains by itself has about so many tokens at least, however many files or splits there are.
PART_TOKENS = 2_000_000
#: Bytes of text whose words a task counts before they are handed on.
COUNTED = 1 << 24
#: Bytes of text whose words are looked up at once, at least, for each word that they are looked for among: those
#: are hashed anew each time.
LOOKED_UP = 8

#: Stands for the end of a text; no word contains a line feed.
END = b"\n"
_LOG10 = 1 / np.log(10)


def word_class(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-3:]) % CLASSES


#: Whether a byte is part of a word; what a byte does to a CRC-32.
_IN_WORD = bytes(b not in BLANKS for b in range(256))
_CRC = np.array([zlib.crc32(bytes([b ^ 0xFF])) for b in range(256)], np.uint32) ^ np.uint32(0xFF000000)


@dataclass
class Tokens:
    """The tokens of texts, one behind the other, as ``data`` cut at ``cuts``; a text's own go up to its one of
    ``stops``. They are runs of bytes other than space and 9 to 13, with A-Z in lower case, and an end."""

    data: np.ndarray
    cuts: np.ndarray
    stops: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Tokens:
        joined = b"".join((b" ", *chain.from_iterable((text, b" \n ") for text in texts))).lower()
        inside = np.frombuffer(bytearray(joined.translate(_IN_WORD)), bool)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 3) - 1
        inside[ends] = True
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts = turns[::2]
        cuts = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(turns[1::2] - starts, dtype=np.int32, out=cuts[1:])
        return Tokens(np.frombuffer(joined, np.uint8)[inside], cuts, np.searchsorted(starts, ends) + 1)

    def words(self) -> pa.Array:
        buffers = [None, pa.py_buffer(self.cuts), pa.py_buffer(self.data)]
        return pa.Array.from_buffers(pa.binary(), len(self.cuts) - 1, buffers)

    def among(self, known: pa.Array) -> np.ndarray:
        """Which of ``known`` each token is; -1 for none."""
        return pc.index_in(self.words(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)

    def classes(self, at: np.ndarray) -> np.ndarray:
        """``word_class`` of the tokens there."""
        ends = self.cuts.take(at + 1).astype(np.int64)
        lengths, crc = ends - self.cuts.take(at), np.full(len(at), 0xFFFFFFFF, np.uint32)
        for k in (3, 2, 1):
            # A word that is shorter starts later; what is read in its place is left out again.
            after = _CRC.take((crc ^ self.data.take(np.maximum(ends - k, 0))) & np.uint32(0xFF)) ^ (crc >> np.uint32(8))
            crc = np.where(lengths >= k, after, crc)
        return FREQUENT + (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % CLASSES


def _runs(columns: Iterator[pa.Array], n_known: int = 0) -> Iterator[list[bytes]]:
    """All texts, in runs to work on at once where words are looked for among ``n_known``."""
    return blocks(chain.from_iterable(map(texts_of, columns)), max(BLOCK, LOOKED_UP * n_known))


def _class_column(word: Column) -> Column:
    ending = F.substring(word, F.greatest(F.octet_length(word) - 2, F.lit(1)), F.lit(3))
    return (F.lit(FREQUENT) + F.crc32(ending) % CLASSES).cast("int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Array] = []

    def out() -> pa.RecordBatch:
        counts = pa.chunked_array(waiting, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "c"])

    size = 0
    for texts in _runs(batch.column(0) for batch in batches):
        waiting.append(Tokens.of(texts).words())
        size += sum(map(len, texts))
        if size > COUNTED:
            yield out()
            waiting, size = [], 0
    yield out()


def learnt_from(total: int) -> int:
    """The count from which on a word is learnt."""
    return max(2, math.ceil(math.sqrt(total) / LEARNT))


@dataclass
class Model:
    """Parameters: symbol vectors as context and as target, weights by place, biases."""

    context: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.place, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        shapes = [(SYMBOLS, DIMENSIONS), (SYMBOLS, DIMENSIONS), (PLACES, DIMENSIONS), (SYMBOLS,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        parts = np.split(flat.astype(np.float32), ends[:-1])
        return Model(*(p.reshape(s) for p, s in zip(parts, shapes, strict=True)))

    @staticmethod
    def start(frequency: np.ndarray) -> Model:
        """Small random vectors; biases that give the symbols their frequencies."""
        rnd = np.random.default_rng(6)
        vectors = rnd.normal(0, 0.1, (2, SYMBOLS, DIMENSIONS)).astype(np.float32)
        place = np.ones((PLACES, DIMENSIONS), np.float32)
        return Model(vectors[0], vectors[1], place, np.log(frequency).astype(np.float32))

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """The vector that each context (rows of PLACES symbols) predicts."""
        return _weighted([self.context.take(contexts[:, j], axis=0) for j in range(PLACES)], self.place)

    def normalisers(self, contexts: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all symbols, per context; by matrix products."""
        out = np.empty(len(contexts), np.float32)
        for i in range(0, len(contexts), 4096):
            scores = self.predicted(contexts[i : i + 4096]) @ self.target.T + self.bias
            top = scores.max(axis=1)
            out[i : i + 4096] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return out

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """What a context symbol in each place adds to each symbol's score (biases with the first), and the
        normalisers of all contexts: a sum of powers of sums is a matrix product of powers."""
        parts = [(self.context * self.place[j]).astype(np.float64) @ self.target.T for j in range(PLACES)]
        parts[0] += self.bias
        tops = [part.max(axis=1) for part in parts]
        powers = [np.exp(part - top[:, None]) for part, top in zip(parts, tops, strict=True)]
        masses = powers[0] @ powers[1].T
        far = np.argwhere(masses < 1e-280)  # too far apart for the product
        masses[far[:, 0], far[:, 1]] = 1
        normalisers = np.log(masses) + tops[0][:, None] + tops[1]
        normalisers[far[:, 0], far[:, 1]] = self.normalisers(far)
        return [part.astype(np.float32) for part in parts], normalisers.astype(np.float32)


def _weighted(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The sum of the places' rows, each scaled by its place's weights."""
    out = rows[0] * weights[0]
    for x, w in zip(rows[1:], weights[1:], strict=True):
        out += x * w
    return out


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of ``at`` (0 or more), how often each is there, and the sums of their rows, which
    have an even length."""
    # A value and its position are sorted as one number; that is faster than an order of the values.
    bits = int(len(at)).bit_length()
    packed = at.astype(np.int32 if int(at.max()) >> (31 - bits) == 0 else np.int64)
    packed <<= bits
    packed |= np.arange(len(at), dtype=packed.dtype)
    packed.sort()
    at = packed >> bits
    starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    packed &= (1 << bits) - 1
    # Numbers are added two by two, as the parts of complex ones.
    pairs = rows.take(packed, axis=0).view(np.complex64)
    return at[starts], np.diff(starts, append=len(at)), np.add.reduceat(pairs, starts, axis=0).view(np.float32)


def _odds_below(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place; 0 where the power is too large."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation with adaptive steps. Noise symbols are drawn once per batch."""

    def __init__(self, model: Model, frequency: np.ndarray):
        self.model, self.log_noise = model, np.log(NOISE * frequency).astype(np.float32)
        self.spread = np.cumsum(frequency)
        self.seen = [np.full(a.shape, 1e-3, np.float32) for a in model.arrays()]
        self.random = np.random.default_rng(1)

    def learn(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        """One step on a batch: tell the targets from the noise."""
        m, n = self.model, len(targets)
        noise = np.minimum(np.searchsorted(self.spread, self.random.random(NOISE)), SYMBOLS - 1)
        predicted = m.predicted(contexts)
        hit, false_rows = m.target.take(targets, axis=0), m.target[noise]
        real = np.einsum("ij,ij->i", predicted, hit)
        real += (m.bias - self.log_noise).take(targets)
        false = predicted @ -false_rows.T
        false -= (m.bias - self.log_noise)[noise]
        d_real, d_false = _odds_below(real), _odds_below(false)  # the steps away from the noise are -d_false
        hit *= d_real[:, None]
        d_predicted = np.subtract(hit, d_false @ false_rows, out=hit)
        gradients = [np.zeros_like(a) for a in m.arrays()]
        np.subtract.at(gradients[1], noise, d_false.T @ predicted)
        predicted *= d_real[:, None]
        different, _, sums = _summed(targets, predicted)
        gradients[1][different] += sums
        gradients[3] += np.bincount(targets, d_real, SYMBOLS).astype(np.float32)
        np.subtract.at(gradients[3], noise, d_false.sum(axis=0))
        for j in range(PLACES):
            different, _, sums = _summed(contexts[:, j], d_predicted)
            gradients[0][different] += sums * m.place[j]
            gradients[2][j] = np.einsum("ij,ij->j", sums, m.context[different])
        for a, g, s in zip(m.arrays(), gradients, self.seen, strict=True):
            g /= n
            s += g * g
            a += RATE * g / np.sqrt(s)


@dataclass
class Tree:
    """The learnt words below the classes. Units are the symbols and then the learnt words. A class is a set
    of its learnt words and one row for all its others; where that were more than WIDE words, it is a set of
    groups of words of similar counts, and each group a set. ``row`` has the rows of a unit, -1 for
    none, ``first`` where each set's rows start, and ``share`` each row's part of its set's counts."""

    symbol: np.ndarray
    row: np.ndarray
    first: np.ndarray
    share: np.ndarray
    bias: np.ndarray
    place: np.ndarray
    context: np.ndarray
    node: np.ndarray

    @staticmethod
    def of(classes: list[int], counts: list[float], rest: np.ndarray) -> Tree:
        """From the learnt words' classes and counts, the most frequent ones first, and the other words' mass
        in each class. Rows start with their shares of the counts."""
        symbol = np.concatenate((np.arange(SYMBOLS), np.array(classes, np.int64))).astype(np.uint16)
        row = np.full((len(symbol), 2), -1, np.int32)
        weight, first, shares = np.array(counts, np.float64), [0], [np.zeros(0)]

        def add(weights: np.ndarray) -> np.ndarray:
            shares.append(weights / weights.sum())
            first.append(first[-1] + len(weights))
            return np.arange(first[-2], first[-1])

        order = np.argsort(symbol[SYMBOLS:], kind="stable")
        ends = np.searchsorted(symbol[SYMBOLS:][order], np.arange(FREQUENT, SYMBOLS + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[k] : ends[k + 1]]
            groups = np.array_split(own, -(-len(own) // WIDE)) if len(own) > WIDE else own[:, None]
            rows = add(np.array([rest[k], *(weight[g].sum() for g in groups)]))
            row[FREQUENT + k, 0] = rows[0]
            for g, r in zip(groups, rows[1:], strict=True):
                row[SYMBOLS + g, 0] = r
                if len(own) > WIDE:
                    row[SYMBOLS + g, 1] = add(weight[g])
        empty, share = np.zeros((0, OWN_DIMENSIONS), np.float32), np.concatenate(shares)
        return Tree(symbol, row, np.array(first), share, np.log(share).astype(np.float32), empty, empty, empty)

    def started(self) -> Tree:
        """With the vectors that training starts from, the same in all tasks."""
        context = np.random.default_rng(8).normal(0, 0.3, (len(self.symbol), OWN_DIMENSIONS)).astype(np.float32)
        place = np.ones((PLACES, OWN_DIMENSIONS), np.float32)
        node = np.zeros((len(self.bias), OWN_DIMENSIONS), np.float32)
        return replace(self, bias=self.bias.copy(), place=place, context=context, node=node)

    def by_set(self, units: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Sets, with the positions of units that choose a row in it and these rows, up to ``most`` at once."""
        number = np.arange(len(self.first) - 1, dtype=np.uint16 if len(self.first) < 1 << 16 else np.int32)
        set_of, found = np.repeat(number, np.diff(self.first)), []
        for level in self.row.T:
            rows = level.take(units)
            at = np.flatnonzero(rows >= 0)
            found.append((at.astype(np.int32), rows.take(at)))
        at, rows = (np.concatenate(x) for x in zip(*found, strict=True))
        sets = set_of.take(rows)
        order = np.argsort(sets, kind="stable")
        at, rows, sets = at.take(order), rows.take(order), sets.take(order)
        changes = np.flatnonzero(sets[1:] != sets[:-1]) + 1
        for start, end in zip([0, *changes.tolist()], [*changes.tolist(), len(at)], strict=True):
            for i in range(start, end, most):
                yield int(sets[start]), at[i : min(i + most, end)], rows[i : min(i + most, end)]

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return _weighted([self.context.take(contexts[:, j], axis=0) for j in range(PLACES)], self.place)

    def logs(self, contexts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The log-probabilities of units inside their classes, normalised by matrix products per set."""
        out = np.zeros(len(units))
        if not len(self.bias):
            return out
        for i in range(0, len(units), 1 << 18):
            before, own = contexts[i : i + (1 << 18)], out[i : i + (1 << 18)]
            for k, at, rows in self.by_set(units[i : i + (1 << 18)], 2048):
                members = slice(self.first[k], self.first[k + 1])
                node, bias, predicted = self.node[members], self.bias[members], self.predicted(before.take(at, axis=0))
                scores = predicted @ node.T
                hit = scores[np.arange(len(at)), rows - self.first[k]]
                # No score is above the product of the longest vectors, nor any bias below the rarest row's.
                longest = [np.einsum("ij,ij->i", x, x).max() for x in (predicted, node)]
                if math.sqrt(longest[0] * longest[1]) + np.abs(bias).max() > 40:  # else no power is too large or too small
                    scores += bias
                    top = scores.max(axis=1)
                    scores -= top[:, None]
                    hit, masses = hit - top, np.exp(scores, out=scores).sum(axis=1)
                else:
                    masses = np.exp(scores, out=scores) @ np.exp(bias)
                own[at] += hit + self.bias.take(rows) - np.log(masses)
        return out


class TreeTrainer:
    """Noise-contrastive estimation inside the sets, with steps adaptive by row. The noise is the rows' shares;
    as a set is narrow, it is taken as it is expected, over all rows of the set, instead of being drawn."""

    def __init__(self, tree: Tree):
        self.tree, self.random = tree, np.random.default_rng(2)
        # The last column of a node's row is its bias.
        self.node = np.concatenate((tree.node, tree.bias[:, None]), axis=1)
        self.noise = (OWN_NOISE * tree.share).astype(np.float32)
        self.seen_node, self.seen_context = np.ones(len(self.node), np.float32), np.ones(len(tree.context), np.float32)
        self.seen_place = np.ones_like(tree.place)
        self.met_node, self.met_context = np.zeros(len(self.node), np.int64), np.zeros(len(tree.context), np.int64)

    def learn(self, contexts: np.ndarray, units: np.ndarray) -> None:
        """Steps on tokens in random order, set by set in random order."""
        parts = list(self.tree.by_set(units, OWN_BATCH)) if len(self.node) else []
        for i in self.random.permutation(len(parts)).tolist():
            k, at, rows = parts[i]
            members = slice(self.tree.first[k], self.tree.first[k + 1])
            self.tell(members, contexts.take(at, axis=0), rows - self.tree.first[k])

    def tell(self, members: slice, contexts: np.ndarray, rows: np.ndarray) -> None:
        """One step: tell the rows of a set from its noise."""
        t, node = self.tree, self.node[members]
        own = [t.context.take(contexts[:, j], axis=0) for j in range(PLACES)]
        predicted = np.ones((len(rows), OWN_DIMENSIONS + 1), np.float32)
        predicted[:, :-1] = _weighted(own, t.place)
        noise = self.noise[members]
        against = -node
        against[:, -1] += np.log(noise)
        # The noise's expected part of each row's step, as a share of the noise; a token's own row has one more.
        d = _odds_below(predicted @ against.T)
        hit = np.arange(len(rows)), rows
        odds = d[hit]
        d[hit] = odds - (1 - odds) / noise.take(rows)
        noise = -noise[:, None]
        d_predicted, place = d @ (noise * node[:, :-1]), t.place.copy()
        for j in range(PLACES):
            g = np.einsum("ij,ij->j", d_predicted, own[j])
            self.seen_place[j] += g * g
            t.place[j] += OWN_RATE * g / np.sqrt(self.seen_place[j])
        both = (d_predicted * place[:, None, :]).reshape(-1, OWN_DIMENSIONS)
        self._step(self.node, self.seen_node, self.met_node, members, len(rows), noise * (d.T @ predicted))
        self._step(t.context, self.seen_context, self.met_context, *_summed(contexts.T.ravel(), both))

    @staticmethod
    def _step(to: np.ndarray, seen: np.ndarray, met: np.ndarray, at, n, g: np.ndarray) -> None:
        met[at] += n
        now = seen[at]
        now += np.einsum("ij,ij->i", g, g) / g.shape[1]
        seen[at] = now
        g *= (OWN_RATE / np.sqrt(now))[:, None]
        g += to[at]
        to[at] = g


#: A trained part comes as rows of so many numbers.
_WIDTH = OWN_DIMENSIONS + 1


def _learnt_rows(trainer: Trainer, below: TreeTrainer, n: int) -> Iterator[pa.RecordBatch]:
    """i, w, x0 and so on: rows of the model, of the tree's places, nodes and contexts, each with its
    weight. Rows of the tree that the part's text didn't meet are left out."""
    flat = trainer.model.flat()
    rows = [np.resize(np.append(flat, np.zeros(-len(flat) % _WIDTH, np.float32)), (-(-len(flat) // _WIDTH), _WIDTH))]
    rows += [np.pad(below.tree.place, ((0, 0), (0, 1))), below.node, np.pad(below.tree.context, ((0, 0), (0, 1)))]
    weights = np.concatenate((np.full(len(rows[0]) + PLACES, n, np.int64), below.met_node, below.met_context))
    ends = np.cumsum([0, *map(len, rows)])
    for x, start in zip(rows, ends, strict=False):
        w = weights[start : start + len(x)]
        met = np.flatnonzero(w)
        for i in range(0, len(met), 10_000):
            at = met[i : i + 10_000]
            columns = [pa.array(start + at, pa.int64()), pa.array(w[at]), *(pa.array(c) for c in x[at].T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "w", *(f"x{k}" for k in range(_WIDTH))])


def _contexts(symbols: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The PLACES symbols, or units, before each one; before a text's first there are ends."""
    contexts = np.full((len(symbols), PLACES), end, np.int32)
    for j in range(PLACES):
        contexts[j + 1 :, j] = symbols[: -(j + 1)]
        for k in range(j + 1):
            # Positions whose j+1-th predecessor lies in the text before.
            at = starts + k
            contexts[at[at < len(symbols)], j] = end
    return contexts


def _unit_trainer(own: dict[bytes, int], tree: Tree, model: Model, frequency: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n = Trainer(Model.of(model.flat()), frequency), 0
        below = TreeTrainer(tree.started())
        end, rest, waiting = own[END], [], 0
        known, units_of = pa.array(list(own), pa.binary()), np.array([*own.values(), -1], np.int32)
        gathered = max(GATHERED, GATHERED_OF_SET * len(tree.first))

        def steps(run_units: list[np.ndarray]) -> None:
            lengths = np.fromiter(map(len, run_units), np.int64, len(run_units))
            units = np.concatenate(run_units)
            starts = np.cumsum(lengths) - lengths
            contexts = _contexts(units, starts, end)
            order = trainer.random.permutation(len(units))
            contexts, units = contexts.take(order, axis=0), units.take(order)
            before, targets = tree.symbol.take(contexts), tree.symbol.take(units)
            for i in range(0, len(order), BATCH):
                trainer.learn(before[i : i + BATCH], targets[i : i + BATCH])
            below.learn(contexts, units)

        for texts in _runs((batch.column(0) for batch in batches), len(own)):
            tokens = Tokens.of(texts)
            found = units_of.take(tokens.among(known))  # the last one for other words
            others = np.flatnonzero(found < 0)
            found[others] = tokens.classes(others)
            n += len(found)
            for units in np.split(found, tokens.stops[:-1]):
                rest.append(units)
                waiting += len(units)
                if waiting > gathered:
                    steps(rest)
                    rest, waiting = [], 0
        if rest:
            steps(rest)
        yield from _learnt_rows(trainer, below, n)

    return run


@dataclass
class Scorer:
    """What the scoring tasks need: head words with symbols and counts, the model, the classes' sums
    (of words that are not learnt), and the learnt words with their units."""

    head: list[bytes]
    counts: np.ndarray
    frequent: dict[bytes, int]
    model: Model | None
    class_mass: np.ndarray
    learnt: dict[bytes, int] = field(default_factory=dict)
    tree: Tree | None = None

    def ready(self) -> Scorer:
        self.words = pa.array(self.head, pa.binary())
        known = self.frequent | self.learnt
        self.units = np.array([u if (u := known.get(w)) is not None else word_class(w) for w in self.head], np.int32)
        self.log_count = np.log10(self.counts + 1.0)
        self.log_mass = np.zeros(SYMBOLS)
        self.log_mass[FREQUENT:] = np.log10(self.class_mass)
        self.symbol = np.arange(SYMBOLS, dtype=np.uint16) if self.tree is None else self.tree.symbol
        units = np.arange(len(self.symbol))
        self.is_class = (units >= FREQUENT) & (units < SYMBOLS)
        if self.model is not None:
            self.added, self.normalisers = self.model.tables()
        return self

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Per text: tokens, known head tokens, the sum of their log counts, the model's log-probability
        but for the counts of other words, and a list of these words with how often they are there."""
        tokens = Tokens.of(texts)
        lengths = np.diff(tokens.stops, prepend=0)
        starts, total = tokens.stops - lengths, int(tokens.stops[-1])
        at = tokens.among(self.words)
        missing = at < 0
        units = self.units[at] if len(self.units) else np.zeros(total, np.int32)
        log_count = np.where(missing, 0.0, self.log_count[at]) if len(self.log_count) else np.zeros(total)
        rare = np.flatnonzero(missing)
        units[rare] = tokens.classes(rare)
        others = _counted(tokens.words().take(pa.array(rare)), np.searchsorted(tokens.stops, rare, "right"), len(texts))
        sums = lambda x: np.add.reduceat(x, starts)
        if self.model is None:
            model_log = np.zeros(total)
        else:
            before = _contexts(units, starts, self.frequent[END])
            symbols, contexts = self.symbol.take(units), self.symbol.take(before)
            raw = sum(added[contexts[:, j], symbols] for j, added in enumerate(self.added))
            raw -= self.normalisers[contexts[:, 0], contexts[:, 1]]
            model_log = raw.astype(np.float64)
            if self.tree is not None:
                model_log += self.tree.logs(before, units)
            model_log *= _LOG10
            model_log += np.where(self.is_class[units], log_count - self.log_mass[symbols], 0.0)
        return lengths, sums((~missing).astype(np.int64)), sums(log_count), sums(model_log), others


_PAIR = pa.struct([("word", pa.binary()), ("n", pa.int64())])


def _counted(words: pa.Array, owner: np.ndarray, n_owners: int) -> pa.Array:
    """The different words of each owner and how often they are there, as a list for each."""
    found = words.dictionary_encode()
    size = max(1, len(found.dictionary))
    keys, n = np.unique(owner * size + found.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(keys, np.arange(n_owners + 1) * size).astype(np.int32)
    pairs = [found.dictionary.take(pa.array(keys % size)), pa.array(n, pa.int64())]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(pairs, fields=list(_PAIR)))


@lru_cache(maxsize=1)
def _ready(packed: bytes) -> Scorer:
    return pickle.loads(packed).ready()


_SCORED = "n_tokens bigint, n_head bigint, head_log double, model_log double, others array<struct<word:binary,n:bigint>>"


def _score(text: Column, packed: bytes) -> Column:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(_PAIR))
    names = ["n_tokens", "n_head", "head_log", "model_log", "others"]
    kind = pa.struct(list(zip(names, kinds, strict=True)))

    @F.arrow_udf(_SCORED)
    def run(texts: pa.Array) -> pa.Array:
        scorer, parts = _ready(packed), [pa.array([], kind)]
        for run_of_texts in _runs(iter([texts]), len(scorer.head)):
            *numbers, others = scorer.score(run_of_texts)
            columns = [pa.array(x).cast(kind.field(j).type) for j, x in enumerate(numbers)]
            parts.append(pa.StructArray.from_arrays([*columns, others], names))
        return pa.concat_arrays([p.cast(kind) for p in parts])

    return run(text)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c: tokens of all ``texts`` (a binary column), ends among them. Counted before the shuffle."""
    partial = texts.mapInArrow(_count, "word binary, c bigint")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


def train(
    texts: DataFrame, total: int, own: dict[bytes, int], tree: Tree, frequency: np.ndarray
) -> tuple[Model, Tree]:
    """The model and the tree after one pass over all ``texts`` (``total`` tokens): a part each, averaged by
    their tokens; a row of the tree by the tokens that met it. Parts are partitions, put together where they
    are so small that they would hardly learn."""
    texts = texts.coalesce(max(1, total // PART_TOKENS))
    model, names = Model.start(frequency), [f"x{k}" for k in range(_WIDTH)]
    kind = ", ".join(["i bigint", "w bigint", *(f"{x} float" for x in names)])
    learnt = texts.mapInArrow(_unit_trainer(own, tree, model, frequency), kind)
    # Summed where they are; as many numbers come back as the model has.
    sums = [(F.sum(F.col(x) * F.col("w")) / F.sum("w")).cast("float").alias(x) for x in names]
    got = learnt.groupBy("i").agg(*sums).toArrow()
    at, rows = got["i"].to_numpy(), np.stack([got[x].to_numpy() for x in names], axis=1)
    tree, flat = tree.started(), model.flat()
    n_model = -(-len(flat) // _WIDTH)
    start = [np.zeros((n_model + PLACES, _WIDTH)), np.concatenate((tree.node, tree.bias[:, None]), axis=1)]
    every = np.concatenate([*start, np.pad(tree.context, ((0, 0), (0, 1)))]).astype(np.float32)
    every[at] = rows
    _, place, node, context = np.split(every, np.cumsum([n_model, PLACES, len(tree.bias)]))
    tree.place, tree.context = place[:, :-1].copy(), context[:, :-1].copy()
    tree.node, tree.bias = node[:, :-1].copy(), node[:, -1].copy()
    return Model.of(every[:n_model].ravel()[: len(flat)]), tree


def lm_scores(docs: DataFrame, is_training: Column, text_col: str = "text") -> DataFrame:
    """All columns but the text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The tokens of a text are its words in lower case (A-Z only) and one end. Rows where
    ``is_training`` are learnt from; all are scored. ``base_score`` sums log10((c + 1) / (N + V + 1));
    ``score`` is the model's log10 probability. A null or empty text is its end alone; texts are taken whole,
    and rows that repeat a text count each. Without training tokens nothing is known and both scores are 0. An
    empty table gives an empty result. Columns named like the five are replaced; others may have any names.

    Parts of the training text learn by themselves from the same start, so ``score``, and nothing else,
    depends a little on how the text is split into partitions; with the same splits reruns agree.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c not in (*added, text_col)]
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    training = docs.filter(is_training).select(text.alias("text"))
    counts = written(word_counts(training), "lm_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head_from = max(1, min(-(-total // HEAD), learnt_from(total)))
    head = counts.filter(F.col("c") >= head_from).toArrow()  # few rows beside the corpus: see LEARNT and HEAD
    ranked = sorted(zip(head["c"].to_pylist(), head["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    scorer = Scorer([w for _, w in ranked], np.array([c for c, _ in ranked], np.float64), {}, None, np.ones(CLASSES))
    if total:
        ends = docs.filter(is_training).count()
        frequent = [END, *(w for _, w in ranked if w != END)][:FREQUENT]
        scorer.frequent = {w: i for i, w in enumerate(frequent)}
        # A class's sum has its words' counts, one more for each, and one for words that were never seen.
        # The sums are taken over all words, and the frequent ones' parts taken off again.
        by_class = counts.groupBy(_class_column(F.col("word")).alias("class")).agg(F.sum(F.col("c") + 1).alias("mass"))
        mass = np.ones(SYMBOLS)
        for row in by_class.collect():  # a row per class
            mass[row["class"]] += row["mass"]
        frequency = np.zeros(SYMBOLS)
        count_of = {w: c for c, w in ranked} | {END: ends}
        for w, i in scorer.frequent.items():
            mass[word_class(w)] -= count_of[w] + 1
            frequency[i] = count_of[w]
        frequency[FREQUENT:] = mass[FREQUENT:]
        frequency = np.maximum(frequency, 1e-3)
        frequency /= frequency.sum()
        # The learnt words' parts are taken off what is left of a class for its other words.
        least = learnt_from(total)
        learnt = [w for c, w in ranked if c >= least and w not in scorer.frequent]
        classes = [word_class(w) for w in learnt]
        np.subtract.at(mass, classes, [count_of[w] + 1 for w in learnt])
        scorer.class_mass = mass[FREQUENT:]
        scorer.learnt = {w: SYMBOLS + i for i, w in enumerate(learnt)}
        tree = Tree.of(classes, [count_of[w] + 1.0 for w in learnt], scorer.class_mass)
        scorer.model, scorer.tree = train(training, total, scorer.frequent | scorer.learnt, tree, frequency)
    packed = pickle.dumps(scorer)

    # Other columns travel in one struct, so that none of their names can clash.
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others))
    scored = docs.select(rest.alias("rest"), _score(text, packed).alias("_s"))
    scored = scored.select("*", F.monotonically_increasing_id().alias("_row"))
    scored = written(scored, "lm_scored")  # from here on the row numbers are fixed
    # The counts of all other words, where there are any.
    rare = scored.select("_row", F.explode("_s.others").alias("o")).select("_row", "o.word", "o.n")
    rare = rare.join(counts.filter(F.col("c") < head_from), "word").groupBy("_row").agg(
        F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("_log")
    )
    joined = scored.join(rare, "_row", "left")
    rare_log = F.coalesce("_log", F.lit(0.0))
    per_token = F.lit(float(np.log10(total + distinct + 1)))
    score = F.col("_s.model_log") + rare_log if total else F.lit(0.0)
    return joined.select(
        *(F.col("rest")[c].alias(c) for c in others), F.col("_s.n_tokens").alias("n_tokens"),
        (F.col("_s.n_head") + F.coalesce("_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("_s.head_log") + rare_log - F.col("_s.n_tokens") * per_token).alias("base_score"),
        score.alias("score"),
    )
