"""Personal data by weak supervision.

Strict patterns find the certain spans. Wider ones find candidates that may be personal data as well.
Labelers (patterns, word lists, context) vote on each span. Expectation-maximisation over the counts of all
vote combinations of the corpus estimates how reliable they are, with the certain spans as known examples.
What it believes of each candidate trains the final span classifier, which doesn't see the votes: it learns,
in parts of the corpus, from hashed features of the span's own form and of the words around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import free_name, text_or_empty, written
from gatetally.llm.quality import BITS, Leader
from gatetally.llm.scan import texts_of

KINDS = ("email", "ip", "card", "phone")

# Fixed values of the contract's patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The classifier learns in at most so many parts, in one more for each so many spans; of a part's spans it sees
#: the first so many several times.
PARTS, PART_SPANS = 8, 5000
AGAIN, PASSES = 20_000, 4

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        free = at + 1
        if local and (domain := _DOMAIN.match(text, at + 1)):
            yield at - local, 0, domain.end()
            free = domain.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The spans of the strict patterns, leftmost and without overlap per kind, by start and kind."""
    found = list(_emails(text))
    if _SOME_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_SOME_DIGIT = re.compile(r"[0-9]")

# Wider patterns, one per kind. Repetition is bounded or possessive, so they take linear time.
_WIDE = (
    re.compile(
        r"(?<![\w.%+-])[\w.%+-]{1,64}(?:@| ?[\[(]at[\])] ?| at )[\w-]{1,63}"
        r"(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]{1,63}){1,4}",
        re.I,
    ),
    re.compile(r"(?<![\w.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}){3}(?![\w.])"),
    re.compile(r"(?<!\w)[0-9](?:[ ./_-]?[0-9]){12,18}(?!\w)"),
    re.compile(r"(?<!\w)(?:\(?00[0-9]{1,3}\)?[ ./-]?)?\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,4}){1,4}(?!\w)"),
)
_HINTS = (re.compile(r"@|[\[(]at[\])]| at ", re.I), _SOME_DIGIT, _SOME_DIGIT, _SOME_DIGIT)

# Word lists: what stands before such data in the usual languages, and ends of host names.
_CUES = (
    ("mail", "contact", "correo", "courriel", "write", "kontakt"),
    ("ip", "host", "server", "address", "adresse", "dirección"),
    ("card", "visa", "karte", "carte", "tarjeta", "credit", "mastercard", "amex"),
    ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
)
_HOST_ENDS = frozenset(("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "eu", "io", "info"))
_CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
_CODE = ("token", "key", "id", "sha", "hash", "version", "no.", "=")

N_LABELERS = 5


def _form(kind: int, said: str) -> int:
    """1: it looks like the kind; -1: it can't be of the kind; 0: no opinion."""
    digits = _digits(said)
    if kind == 0:
        return 1 if "@" in said or re.search(r"[\[(](at|dot)[\])]", said, re.I) else 0
    if kind == 1:
        parts = [int(p) for p in re.findall(r"[0-9]+", said)]
        return 1 if len(parts) == 4 and max(parts) <= 255 else -1
    if kind == 2:
        return 1 if luhn(digits) else -1
    return 1 if 9 <= len(digits) <= 15 else -1 if len(digits) < 7 else 0


def _listed(kind: int, said: str) -> int:
    digits = _digits(said)
    if kind == 0:
        return 1 if re.split(r"\W+", said.lower())[-1] in _HOST_ENDS else -1
    if kind == 1:
        return -1 if digits.strip("0") == "" else 0
    if kind == 2:
        return 1 if digits.startswith(_CARD_STARTS) and len(digits) >= 14 else 0
    return 1 if said.startswith(("(", "00")) else -1 if re.fullmatch(r"(19|20)[0-9]{2}[ ./-].*", said) else 0


def _votes(kind: int, text: str, start: int, end: int) -> tuple[int, ...]:
    """What each labeler says of a candidate: its form, word lists, cue words, code around it, its size."""
    said, before = text[start:end], text[max(0, start - 30) : start].lower()
    cue = 1 if any(c in before for c in _CUES[kind]) else 0
    code = -1 if any(c in before[-12:] for c in _CODE) or text[end : end + 1] in "=/_" != "" else 0
    length = len(_digits(said)) if kind else len(said)
    sized = (6, 1, 14, 10)[kind] <= length <= (80, 12, 16, 13)[kind]
    return _form(kind, said), _listed(kind, said), cue, code, 1 if sized else -1


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, int]]:
    """Wider spans that touch no base span: start, kind, end, and their votes as a number to base 3."""
    covered: list[list[int]] = []  # by base spans, without overlap
    for start, _, end in base:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    found: list[tuple[int, int, int, int]] = []
    for kind, (hint, wide) in enumerate(zip(_HINTS, _WIDE, strict=True)):
        if not hint.search(text):
            continue
        for m in wide.finditer(text):
            # The last covered stretch that starts before the candidate's end.
            before = bisect_left(covered, [m.end()]) - 1
            if before >= 0 and covered[before][1] > m.start():
                continue
            votes = _votes(kind, text, m.start(), m.end())
            found.append((m.start(), kind, m.end(), _code(votes)))
    return found


def span_features(kind: int, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a span: its form, ends and length, and what stands before and behind it."""
    said = text[start:end]
    form = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", said))
    digits = _digits(said)
    before = re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-2:]
    behind = re.findall(r"\w+", text[end : end + 40].lower())[:2]
    own = (
        f"form {form if len(form) <= 24 else ''}", f"runs {re.sub(r'(.)\1+', r'\1', form)[:40]}", f"digits {len(digits)}",
        f"length {min(len(said), 64) // 4}", f"starts {digits[:2]}", f"ends {re.split(r'\W+', said.lower())[-1] if kind == 0 else ''}",
        f"next {text[max(0, start - 1) : start]}_{text[end : end + 1]}",
    )
    around = [f"before {w}" for w in before] + [f"behind {w}" for w in behind]
    # Words around mean the same for all kinds; what a span looks like is of its kind.
    told = [f"{kind} {x}" for x in (*own, *around)] + around
    return [max(1, zlib.crc32(x.encode()) >> (32 - BITS)) for x in told]


def scan(text: Column) -> Column:
    """start, kind, end, base, votes and features of each span of a text."""
    names = ("start", "kind", "end", "base", "votes", "features")
    types = (pa.int32(), pa.int8(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32()))
    kind = pa.list_(pa.struct(list(zip(names, types, strict=True))))

    @F.arrow_udf("array<struct<start:int,kind:tinyint,end:int,base:boolean,votes:int,features:array<int>>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts_of(texts):
            base = base_spans(t)
            found = [(s, k, e, True, _code(_votes(k, t, s, e))) for s, k, e in base]
            found += [(s, k, e, False, code) for s, k, e, code in candidates(t, base)]
            found.sort(key=lambda x: x[:2])
            rows.append([dict(zip(names, (*x, span_features(x[1], t, x[0], x[2])), strict=True)) for x in found])
        return pa.array(rows, kind)

    return run(text)


def _code(votes: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def _matrix(codes: np.ndarray) -> np.ndarray:
    """Votes -1, 0, 1 of each combination, a column per labeler."""
    return np.stack([codes // 3**i % 3 - 1 for i in range(N_LABELERS)], axis=1)


def all_in_favour(votes: np.ndarray) -> np.ndarray:
    """Form and size are right, a word list or a word before it speaks for it, and nothing against it."""
    return (votes[:, 0] == 1) & (votes[:, 4] == 1) & (votes[:, 1:3].max(axis=1) == 1) & (votes.min(axis=1) >= 0)


def estimate(
    votes: np.ndarray,
    counts: np.ndarray,
    kinds: np.ndarray | None = None,
    known: np.ndarray | None = None,
    certain: np.ndarray | None = None,
    rounds: int = 200,
) -> np.ndarray:
    """The probability that each vote combination is personal data.

    A naive Bayes model of the votes, with a table per labeler of what it says of true and of other
    candidates, is fitted by expectation-maximisation. The tables are shared by all ``kinds``; each has its
    own share of true candidates. Combinations that are ``known`` are true throughout; of these, the
    ``certain`` ones aren't candidates and say nothing of that share. It starts from the majority.

    A labeler's vote for a candidate never counts against it, nor the other way round.
    """
    kinds = np.zeros(len(counts), int) if kinds is None else kinds
    known = np.zeros(len(counts), bool) if known is None else known
    open_counts = np.where(np.zeros(len(counts), bool) if certain is None else certain, 0, counts)
    believed = np.where(known, 1.0, 1 / (1 + np.exp(-2.0 * (votes.sum(axis=1) - 1.5))))
    for _ in range(rounds):
        true, other = counts * believed, counts * (1 - believed)
        log = np.empty(len(counts))
        for kind in np.unique(kinds):
            own = kinds == kind
            sums = ((open_counts * p)[own].sum() for p in (believed, 1 - believed))
            log[own] = np.log((next(sums) + 1) / (next(sums) + 1))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                # Pseudo-counts say that labelers are better than chance.
                likely = (true[at].sum() + (1, 2, 3)[v + 1]) / (true.sum() + 6)
                unlikely = (other[at].sum() + (3, 2, 1)[v + 1]) / (other.sum() + 6)
                ratio = np.log(likely / unlikely)
                log[at] += ratio if not v else max(ratio, 0) if v > 0 else min(ratio, 0)
        now = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(log, -35, 35))))
        if np.abs(now - believed).max() < 1e-9:
            break
        believed = now
    return believed


def beliefs(counts: DataFrame) -> dict[int, float]:
    """What is believed of a kind and vote combination, by ``kind * 3^5 + votes``.

    ``counts`` has a row per kind, combination and whether the span is certain: 8 * 3^5 at most, whatever the
    corpus.
    """
    rows = sorted((r["kind"], r["votes"], r["base"], r["n"]) for r in counts.collect())
    if not rows:
        return {}
    kinds, codes, certain, n = (np.array(column) for column in zip(*rows, strict=True))
    votes = _matrix(codes)
    believed = estimate(votes, n.astype(float), kinds, certain | all_in_favour(votes), certain)
    return {
        int(kind) * 3**N_LABELERS + int(code): float(p)
        for kind, code, base, p in zip(kinds, codes, certain, believed, strict=True)
        if not base
    }


def _learn(believed: dict[int, float]):
    """Weights of the classifier from the spans of each part, in order of parts."""

    def fitted(leader: Leader, again: list, n: int) -> pd.DataFrame:
        for k in range(1, PASSES):
            for i in np.random.default_rng(k).permutation(len(again)):
                leader.learn(*again[i])
        return pd.DataFrame({"n": [n], "w": [leader.weights().astype(np.float32).tobytes()]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, leader, again, n = None, Leader(), [], 0
        for frame in frames:
            for now, told, base, found in zip(frame["part"], frame["told"], frame["base"], frame["features"], strict=True):
                if now != part and n:
                    yield fitted(leader, again, n)
                    leader, again, n = Leader(), [], 0
                part, at = now, np.concatenate(([0], np.unique(found)))
                row = (at, np.ones(len(at)), 1.0 if base else believed[told])
                leader.learn(*row)
                n += 1
                if len(again) < AGAIN:
                    again.append(row)
        if n:
            yield fitted(leader, again, n)

    return run


def train(spans: DataFrame, believed: dict[int, float]) -> np.ndarray:
    """The span classifier's weights, learnt from all spans: the certain ones as personal data, the candidates
    as far as is believed. Each part learns by itself, and their weights are averaged.

    All spans are learnt from once; the first AGAIN of each part, which come in the order of a hash, again.
    """
    count = spans.count()
    parts = min(PARTS, 1 + count // PART_SPANS)
    at_random = F.xxhash64("features", "told", "base")
    rows = spans.select("told", "base", "features", F.pmod(at_random, F.lit(parts)).alias("part"), at_random.alias("place"))
    rows = rows.repartition(4 * PARTS, "part").sortWithinPartitions("part", "place")
    weights = np.zeros(1 << BITS)
    for r in rows.mapInPandas(_learn(believed), "n bigint, w binary").collect():  # a row for each of PARTS
        weights += r["n"] / count * np.frombuffer(r["w"], np.float32)
    return weights.astype(np.float32)


def _stays(spans: Column, weights: np.ndarray, threshold: float) -> Column:
    """Whether each span of an array is personal data."""
    codes = np.arange(len(KINDS) * 3**N_LABELERS) % 3**N_LABELERS
    votes = _matrix(codes)
    # A labeler that says a span can't be of its kind isn't overruled, nor are all that speak for it.
    never, always = votes[:, 0] < 0, all_in_favour(votes)

    @F.arrow_udf("array<boolean>")
    def run(arrays: pa.Array) -> pa.Array:
        lengths = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        every = arrays.flatten()
        told = every.field("kind").to_numpy().astype(np.int64) * 3**N_LABELERS + every.field("votes").to_numpy()
        features = every.field("features")
        sizes = features.value_lengths().to_numpy()
        which = np.repeat(np.arange(len(sizes)), sizes)
        margin = weights[0] + np.bincount(which, weights[features.flatten().to_numpy()], len(sizes))
        base = every.field("base").to_numpy(zero_copy_only=False)
        stays = base | always[told] | ((1 / (1 + np.exp(-margin)) >= threshold) & ~never[told])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(stays))

    return run(spans)


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns but the text, with ``spans``: array of start, kind, end, base, by start and kind.

    Offsets are code points, ends exclusive. Base spans are always there. A candidate is there if the
    classifier gives it ``threshold`` and its form can be that of its kind; or if all labelers that have an
    opinion speak for it (``all_in_favour``), however much other text there is. A null or empty text has none;
    texts are taken whole. Statistics are taken from all rows, and rows that repeat a text count each. An
    empty table gives an empty result. A column of ``docs`` named ``spans`` is replaced; others may have any
    names.
    """
    others = [c for c in docs.columns if c not in (text_col, "spans")]
    scanned = docs.select(*(F.col(f"`{c}`") for c in others), scan(text_or_empty(text_col)).alias("spans"))
    scanned = written(scanned, "pii_spans")
    found = scanned.select(F.explode("spans").alias("s")).select("s.*")
    believed = beliefs(found.groupBy("kind", "votes", "base").agg(F.count("*").alias("n")))
    told = (F.col("kind") * F.lit(3**N_LABELERS) + F.col("votes")).cast("int").alias("told")
    weights = train(found.select(told, "base", "features"), believed) if believed else np.zeros(1 << BITS, np.float32)
    stay = free_name(scanned, "stay")
    judged = scanned.withColumn(stay, _stays(F.col("spans"), weights, threshold))
    spans = F.transform(
        F.filter("spans", lambda s, i: F.get(F.col(stay), i)),
        lambda s: F.struct(
            s.start.alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s.kind.cast("int") + 1).alias("kind"),
            s.end.alias("end"), s.base.alias("base"),
        ),
    )
    return judged.withColumn("spans", spans).drop(stay)


def said(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
