"""Divergence audit, clustering and the tokenization automaton against brute force, with nulls, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evspark.llm import bpe_automaton, centroid_codes, divergence
from evspark.llm.bpe_automaton import Automaton, AutomatonTokenizer
from evspark.llm.common import default_tokenizer

R = random.Random(7)
ODD = "lang string, source string, text string, term string, n long, number int, `share` double, doc_id long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- divergence


def brute_audit(rows, least, top):
    terms = [(lang or "", source or "", TERM.findall(lowered(text))) for lang, source, text in rows]
    groups = sorted({(a, b) for a, b, _ in terms})
    out = set()
    for lang in {a for a, _ in groups}:
        seen = Counter(t for a, _, w in terms if a == lang for t in set(w))
        kept = [t for t, k in seen.items() if k >= least]
        sources = [b for a, b in groups if a == lang]
        count = {s: Counter(t for a, b, w in terms if (a, b) == (lang, s) for t in w if t in set(kept)) for s in sources}
        whole = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in sources:
            pairs = [(-sum(abs(share(count[s], t) - share(count[o], t)) for t in kept), o.encode()) for o in sources if o != s]
            words = [(share(whole, t) - share(count[s], t), t.encode()) for t in kept if count[s][t] and share(count[s], t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", words)):
                for i, (v, item) in enumerate(sorted(found)):
                    if part == "pair" or i < top:
                        out.add((lang, s, part, item.decode(), -v, i + 1))
    return out


LONG_WORD = "é" * 40 + "z" * 30
VOCABULARY = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefgz", "Éa", "éa", "naïve", LONG_WORD, LONG_WORD + "q", LONG_WORD[:-2], "x" * 64, "x" * 65, "x" * 72, "日本", "日本語"]


def audit_rows():
    rows = []
    for i in range(150):
        words = [R.choice(VOCABULARY) + R.choice([" ", ", ", "-", "1", "\n", "_"]) for _ in range(R.randint(0, 12))]
        rows.append((R.choice(["en", "de", None, ""]), R.choice(["s1", "s2", "é", None, "Z"]), "".join(words)))
    return rows + [("fr", "only", None), ("fr", "two", ""), ("xx", None, "lonely"), (None, None, None), rows[0], rows[0]]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 50, "block": 2, "rows_a_shard": 7, "cells": 9}])
def test_audit(spark, sizes):
    rows = audit_rows()
    docs = spark.createDataFrame([(a, b, t, "x", 1, 2, 0.5, None) for a, b, t in rows], ODD).repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, least_docs=6, top=4, **sizes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 6, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], ODD)).count() == 0
    blank = spark.createDataFrame([(None,) * 8, (None,) * 8], ODD)
    assert divergence.audit(blank).count() == 0
    two = spark.createDataFrame([("en", s, None, "", 0, 0, 0.0, 1) for s in "ab"], ODD)
    assert {tuple(r) for r in divergence.audit(two).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


@pytest.mark.parametrize("seed", range(5))
def test_runs_are_sorted_words(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice([*VOCABULARY, "A", "Z", " ", " ", "7", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(8)] + ["", "a" * 5000, "a" * 5000, "b" * 20]
    got = divergence.shard_counts(pa.array(texts), ["l"] * len(texts), ["s"] * len(texts)).to_pylist()
    words = [TERM.findall(lowered(t)) for t in texts]
    want = Counter(w for ws in words for w in ws)
    assert [x["term"] for x in got[:-1]] == sorted(want, key=str.encode)
    assert all(x["n"] == want[x["term"]] and x["docs"] == sum(x["term"] in ws for ws in words) for x in got[:-1])
    sliced = divergence.shard_counts(pa.array(["zz", *texts]).slice(1), ["l"] * len(texts), ["s"] * len(texts)).to_pylist()
    assert sliced == got


# --- clustering


def brute_clusters(rows, k, rounds, dims=64):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in good]
        for n in range(len(at)):
            mine = [v for (_, v), m in zip(good, near, strict=True) if m == n]
            if mine:
                at[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in good]
    return Counter(
        (i, n, d, sum(e for _, m, e in found if m == n), sum(e for *_, e in found), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, n, d in found
    )


VECTORS = "vec_id long, embedding array<float>, ids string, cluster int, distance string, codes int"


def vectors(n, spread=1.0):
    rows = [(i, [float(np.float32(R.gauss(0, spread))) for _ in range(64)]) for i in range(n)]
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [math.nan] + [0.5] * 63), (906, [math.inf] * 64), (907, [-math.inf] * 64)]
    return rows + bad + [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (910, [0.0] * 64), (911, [-0.0] * 64), (912, [-0.001] * 64), (913, [1000.0] * 64)]


@pytest.mark.parametrize("n, options", [(60, {}), (60, {"width": 3, "group": 7}), (60, {"width": 64}), (5, {}), (0, {"group": 1})])
def test_clusters(spark, n, options):
    rows = vectors(n) if n else vectors(5)[5:13]
    df = spark.createDataFrame([(*r, "x", 9, "y", 3) for r in rows], VECTORS).repartition(3)
    found, centroids = centroid_codes.cluster(df, **options)
    got = centroid_codes.with_digest(found, centroids)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, 16, 3)


def test_one_vector_many_times(spark):
    rows = [(i, [0.25] * 64) for i in range(40)] + [(99, [0.5] * 64)]
    df = spark.createDataFrame([(*r, "x", 9, "y", 3) for r in rows], VECTORS)
    got = centroid_codes.with_digest(*centroid_codes.cluster(df, group=10))
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, 16, 3)


# --- automaton


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


SIGNS = [
    *"abzABZéÉİıßǅΣς.,!?:;'\"-1½٣你😀ﬁŉⅧªa ", *" \n\t\r  ", *"̱́̇̈̊", "H", "T", "W", "ẞ", "ÿ", "×", "÷",
    "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "\x85", " ", "\x1c", "\x0b", "\x00", "\xa0", "​", "~~~", "......",
]


def test_automaton_equals_the_library(library):
    own = AutomatonTokenizer(default_tokenizer(), limit=500)
    texts = ["".join(R.choice(SIGNS) for _ in range(R.randint(0, 30))) for _ in range(6000)]
    texts += ["".join(R.choice("etaoinshrdlu") for _ in range(R.randint(1, 25))) for _ in range(6000)]
    texts += ["aé" * 20_000, "=" * 5000, "", " ", "The bridges of the town, 1999."]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def explicit_automaton(alphabet, merges):
    """States with all their arcs, by gadgets: (start, arcs)."""
    arcs = [{s: 0 for s in alphabet}]
    for a, b in merges:
        if not any(a in x and b in arcs[x[a]] for x in arcs):
            continue
        q = next(x[a] for x in arcs if a in x)
        led = arcs[q][b]
        arcs.append({t: to for t, to in arcs[q].items() if t != b})
        new = len(arcs) - 1
        for x in arcs:
            if a in x:
                x[a] = new
        for x in arcs:
            if a in x:
                x[a + b] = led
    return arcs


def merged(word, merges):
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_gadgets(seed):
    r = random.Random(seed)
    alphabet, merges = list("abc"), []
    while len(merges) < 14:
        labels = alphabet + [a + b for a, b in merges]
        pair = (r.choice(labels), r.choice(labels))
        if "".join(pair) not in labels and len("".join(pair)) < 9:
            merges.append(pair)
    vocabulary = {t: i for i, t in enumerate([*alphabet, *[a + b for a, b in merges]])}
    own, arcs = Automaton(vocabulary, merges), explicit_automaton(alphabet, merges)
    state = {t: to for x in arcs for t, to in x.items()}
    label = {i: t for t, i in vocabulary.items()}
    for u in state:
        assert {label[w] for w in own.width if own.follows(vocabulary[u], w)} == set(arcs[state[u]])
    for _ in range(300):
        word = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert [label[w] for w in own.encode(word)] == merged(word, merges)


def test_encode_and_decode(spark, library):
    texts = [None, "", "  \n", "Hello wörld's <|endoftext|>", "x" * 100_000, "again", "again"]
    schema = "doc_id long, text string, ids string, n_tokens string, decoded int, automaton string"
    docs = spark.createDataFrame([(i if i else None, t, "a", "b", 1, "c") for i, t in enumerate(texts)], schema).repartition(2)
    rows = bpe_automaton.decode(bpe_automaton.encode(docs)).collect()
    short = {r.doc_id: r for r in bpe_automaton.digests(docs).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id or 0] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert (np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded, r.automaton) == (want, len(want), text, "c")
        s = short[r.doc_id]
        assert (s.n_tokens, s.ids_sha256, s.decoded_sha256) == (len(want), hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_automaton.digests(docs.limit(0)).count() == 0
