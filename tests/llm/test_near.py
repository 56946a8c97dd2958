from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import ROWS, WORD, awkward, empty
from gatetally.llm import fingerprints as prints
from gatetally.llm import ngram_join as module
from gatetally.llm.components import components
from gatetally.llm.fingerprints import SAMPLES, fingerprints
from gatetally.llm.ngram_join import least_matches, ngram_join


def ngrams(text, n=5):
    words = WORD.findall((text or "").lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else None


def brute_join(rows):
    """doc_id -> (class_id, copy_id, n_copies, n_links)."""
    classes = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        classes[ngrams(text) or i].append(doc_id)
    sets = {min(ids): s for s, ids in classes.items() if isinstance(s, frozenset)}
    links, parent = Counter(), {min(ids): min(ids) for ids in classes.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {
        doc_id: (root(min(ids)), min(ids), len(ids), links[min(ids)]) for ids in classes.values() for doc_id in ids
    }


def joined(df):
    return {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in ngram_join(df).collect()}


def near_rows(groups=40, large=150):
    """Copies and near copies in small groups, one large group of near copies, and texts of their own."""
    rnd, rows = random.Random(8), []
    words = [f"w{i}" for i in range(3000)]

    def changed(text, k):
        own = text.split()
        for _ in range(k):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        return " ".join(own)

    for _ in range(groups):
        base = " ".join(rnd.choices(words, k=rnd.randint(4, 200)))
        rows += [base, base.upper(), *(changed(base, rnd.randint(0, 8)) for _ in range(rnd.randint(1, 5)))]
    base = " ".join(rnd.choices(words, k=120))
    rows += [changed(base, rnd.randint(0, 4)) for _ in range(large)]
    rows += [" ".join(rnd.choices(words, k=60)) for _ in range(100)]
    rnd.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("block", [512, 20])
def test_join_equals_brute_force(spark, monkeypatch, block):
    """In the second case the large group's buckets are cut into many blocks."""
    monkeypatch.setattr(module, "BLOCK", block)
    rows = near_rows()
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_join(rows)


def test_join_of_awkward_rows(spark):
    got = ngram_join(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    wanted = brute_join([r[:2] for r in ROWS])
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in got} == wanted
    assert ngram_join(empty(spark)).collect() == []
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "x")], "doc_id long, text string")
    assert [(r.class_id, r.n_links) for r in ngram_join(nulls).collect()] == [(None, 0)] * 3


def test_pruning_loses_hardly_any_pair_at_the_threshold():
    rnd = np.random.default_rng(9)
    equal = rnd.random((200_000, module.HASHES)) < module.THRESHOLD
    kept = np.ones(len(equal), bool)
    for k, bound in enumerate(least_matches()):
        kept &= equal[:, : (k + 1) * module.STEP].sum(axis=1) >= bound
    assert 1 - kept.mean() < 1e-4
    far = rnd.random((20_000, module.HASHES)) < 0.4
    assert (far[:, : module.STEP].sum(axis=1) >= least_matches()[0]).mean() < 0.5
    assert (far.sum(axis=1) >= least_matches()[-1]).mean() == 0


@pytest.mark.parametrize("n_pairs", [10, 500])
def test_exact_check_of_pairs(n_pairs):
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 300, rnd.integers(1, 250)).astype(np.uint64)) for _ in range(60)]
    a, b = rnd.integers(0, 60, (2, n_pairs))
    got = module._links_in(np.arange(60), sets, a, b)
    for i, j, linked in zip(a, b, got, strict=True):
        x, y = set(sets[i].tolist()), set(sets[j].tolist())
        assert linked == (len(x & y) * 100 >= 80 * len(x | y))


def test_components_equal_brute_force(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    links += [(500, i) for i in range(501, 600)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and u != v:
            x, y = sorted((root(u), root(v)))
            parent[y] = x
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.id: r.component for r in got} == {x: root(x) for x in parent}
    assert len(got) == len(parent)


# --- fingerprints


def brute_edits(rows):
    """(id, n_chars, edited text, own text, next text) of each row."""
    key = lambda row: (row[0] is not None, 0 if row[0] is None else row[0], hashlib.sha256((row[1] or "").encode()).hexdigest())
    order = [(i, text or "") for i, text in sorted(rows, key=key, reverse=True)]
    edits = []
    for k, (doc_id, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(text) // 3
        edits.append((doc_id, len(text), text[: len(text) - m] + after[:m], text, after))
    return edits


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_fingerprints(spark, which):
    if which == "awkward":
        docs, rows = awkward(spark), [r[:2] for r in ROWS]
    else:
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
    edits, got = brute_edits(rows), fingerprints(docs).collect()
    told = lambda doc_id, n, sha: (doc_id is not None, doc_id, n, sha)
    got.sort(key=lambda r: told(r.doc_id, r.n_chars, r.edited_sha256))
    edits.sort(key=lambda e: told(*e[:2], hashlib.sha256(e[2].encode()).hexdigest()))
    assert len(got) == len(edits)
    errors, by_text = [], {}
    for r, (doc_id, n_chars, edited, own, after) in zip(got, edits, strict=True):
        assert (r.doc_id, r.n_chars) == (doc_id, n_chars)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            errors.append(near - jaccard(own, other))
        for text, print_ in ((own, r.fingerprint), (edited, r.edited_fingerprint)):
            assert by_text.setdefault(text, print_) == print_
            assert len(print_) == (8 * SAMPLES if WORD.search(text) else 0)
    if which == "documents":
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1


def test_fingerprints_of_few_rows(spark):
    assert fingerprints(empty(spark)).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {None, 5}
    assert len({r.fingerprint for r in got}) == 1 and {r.near_next for r in got} == {1.0}


def test_samples_weigh_repeats(spark):
    """Against the exact generalised similarity, which plain sets of words would miss."""
    a, b = "x " * 30 + "y " * 10, "x " * 10 + "y " * 30
    rows = []
    for i in range(60):
        rows += [(2 * i + 1, a.replace("x", f"x{i}").replace("y", f"y{i}")), (2 * i, b.replace("x", f"x{i}").replace("y", f"y{i}"))]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.col("doc_id") % 2 == 1).collect()
    assert np.mean([r.near_next for r in got]) == pytest.approx(20 / 60, abs=0.03)


def test_likeness_of_near_copies_is_close(spark):
    """Pairs that share 8 of 10 words; with 32 samples the standard error would be 0.071."""
    rows = []
    for i in range(500):
        common = " ".join(f"c{i}_{k}" for k in range(8))
        rows += [(2 * i + 1, f"{common} a{i}"), (2 * i, f"{common} b{i}")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.col("doc_id") % 2 == 1).collect()
    near = [r.near_next for r in got]
    assert np.mean(near) == pytest.approx(0.8, abs=0.01) and np.std(near) < 0.064


def test_rows_that_share_an_id_keep_their_rows(spark):
    rows = [(None, "a b c"), (None, "d e"), (7, "x y"), (7, "z w v u"), (7, "x y"), (7, "x y"), (8, "q")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in rows)
    assert len({r.fingerprint for r in got}) == 5
    expected = Counter((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _, _ in brute_edits(rows))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    # Of three equal rows two are followed by their equal.
    assert sorted(r.near_next for r in got if r.doc_id == 7 and r.n_chars == 3)[-2:] == [1.0, 1.0]


def test_sample_equals_logarithms_of_its_own(spark):
    """Variates from the table, which is worked out once, give the ranks that logarithms for each term would."""
    rnd = random.Random(4)
    rows = [(rnd.getrandbits(63), float(np.log(rnd.choice([1, 1, 2, 7, 5000])))) for _ in range(2000)]
    terms = spark.createDataFrame(rows, "term long, log_weight double").withColumn("hash", F.xxhash64("term", F.lit(3)))
    terms = terms.crossJoin(prints._exponentials(spark))
    got = terms.select("log_weight", "hash", prints._sampled(*map(F.col, ("term", "log_weight", "exponentials")), 3).alias("s"))
    for r in got.collect():
        fields = [(r.hash >> 13 * i & 8191) + 0.5 for i in range(4)]
        gamma, c = (-np.log(fields[i] * fields[i + 1] / 2.0**26) for i in (0, 2))
        beta = ((r.hash >> 52 & 4095) + 0.5) / 4096
        level = np.floor(r.log_weight / gamma + beta)
        rank = np.log(c) - gamma * (level - beta) - gamma
        assert (r.s >> 31) / 2.0**25 - 64 == pytest.approx(max(rank, -64), abs=2.0**-24)


def test_fingerprints_of_text_ids(spark):
    rows = [("b", "x y z w"), (None, "q r s"), ("a", "u v"), ("0", "t")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    expected = Counter((i, hashlib.sha256(e.encode()).hexdigest()) for i, _, e, _, _ in brute_edits([(i or "", t) for i, t in rows]))
    assert Counter((r.doc_id or "", r.edited_sha256) for r in got) == expected
    assert [r.doc_id for r in got if r.fingerprint and r.n_chars == 5] == [None]
