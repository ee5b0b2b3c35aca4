"""The suffix tree over tokens against a version that counts with dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evspark.llm import suffix_tree_lm as lm
from tests.llm.test_operators import TEXTS, lowered, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OPTIONS = {"head_share": 0.004, "gram_share": 0.0015, "divergence": 3.0, "prior": 0.5, "follower": 2}


def tokens_of(text):
    return [*WORD.findall(lowered(text)), "<end>"]


class Force:
    """The model of the docstring, spelled out; ``rows`` are (text, group)."""

    def __init__(self, rows, groups, head_share, gram_share, divergence, prior, follower):
        self.rows, self.groups = [(tokens_of(t), g) for t, g in rows], groups
        self.c = [Counter() for _ in range(groups)]
        for tokens, g in self.rows:
            self.c[g].update(tokens)
        self.all = sum(self.c, Counter())
        n = sum(self.all.values())
        self.per = [sum(c.values()) for c in self.c]
        self.members = [sum(1 for _, g in self.rows if g == k) for k in range(groups)]
        least, enough = max(2, math.ceil(n * head_share)), max(2, math.ceil(n * gram_share))
        self.head = {w for w in self.all if self.all[w] >= least or w == "<end>"}
        rare = max(math.log10(least - 0.5) - math.log10(self.per[g] + 0.5 * (len(self.c[g]) + 1)) for g in range(groups))
        most = lambda w: min(0.0, max(self.root(g, w) for g in range(groups)) if w in self.head else rare)
        pairs, triples = defaultdict(Counter), defaultdict(Counter)
        for tokens, _ in self.rows:
            for i in range(1, len(tokens)):
                pairs[tokens[i - 1]][tokens[i]] += 1
                if i > 1:
                    triples[tokens[i - 2], tokens[i - 1]][tokens[i]] += 1
        frequent = {(a, w) for a in pairs if a in self.head for w, k in pairs[a].items() if w in self.head and k >= enough}
        self.states = {}
        for a, following in pairs.items():
            kept = {w: k for w, k in following.items() if ((a, w) in frequent if a in self.head else k >= follower)}
            self.settle((a,), kept, self.all[a], {w: most(w) for w in kept}, divergence, prior)
        for (a, b), following in triples.items():
            if b in self.head:
                if (a, b) not in frequent:
                    continue
                kept = {w: k for w, k in following.items() if (b, w) in frequent and k >= enough}
                occurrences = pairs[a][b]
            else:
                kept = {w: k for w, k in following.items() if k >= follower}
                occurrences = sum(following.values())
            self.settle((a, b), kept, occurrences, {w: most(w) + self.step((b,), w) for w in kept}, divergence, prior)

    def root(self, g, w):
        return math.log10((self.c[g][w] + 0.5) / (self.per[g] + 0.5 * (len(self.c[g]) + 1)))

    def settle(self, context, kept, occurrences, parent, divergence, prior):
        if not kept or sum(k * (math.log(k / occurrences) - parent[w] * math.log(10)) for w, k in kept.items()) < divergence:
            return
        b = prior * len(kept)
        a = occurrences - sum(kept.values()) + b
        gain = {w: math.log10(1 + k / (a * 10 ** parent[w])) for w, k in kept.items()}
        self.states[context] = (math.log10(a / (occurrences + b)), gain)

    def step(self, context, w):
        lost, gain = self.states.get(context, (0.0, {}))
        return lost + gain.get(w, 0.0)

    def score(self, text):
        tokens, factor = tokens_of(text), 0.0
        for i, w in enumerate(tokens):
            if i:
                factor += self.step((tokens[i - 1],), w)
            if i > 1:
                factor += self.step((tokens[i - 2], tokens[i - 1]), w)
        n = sum(self.members)
        sums = [math.log10((self.members[g] + 0.5) / (n + 0.5 * self.groups)) + sum(self.root(g, w) for w in tokens) for g in range(self.groups)]
        top = max(sums)
        return top + math.log10(sum(10 ** (x - top) for x in sums)) + factor


def corpus():
    r = random.Random(3)
    frequent, rare = [f"w{i}" for i in range(40)], [f"r{i}" for i in range(150)]
    out = []
    for i in range(60):
        words = [r.choice(frequent) if r.random() < 0.7 else r.choice(rare) for _ in range(r.randint(5, 90))]
        for k in range(2, len(words), 9):
            words[k : k + 3] = ["of", "the", "House"] if i % 2 else ["de", "la", "r1"]
        out.append((i, " ".join(words), "en" if i % 2 else "fr"))
    return [*out, (60, out[7][1], "en"), (61, None, None), (62, " \n", "fr"), (None, "of the r3", "en"), (63, out[8][1] + " unheard of", "xx"), (63, "zz", None)]


def test_scores_equal_those_by_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, lang string, `group` int, kind string").repartition(3)
    learns = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    got = lm.score(docs, learns, group_col="lang", **OPTIONS).collect()
    train = [(t, lang) for i, t, lang in rows if i is None or i % 5 != 1]
    sizes = Counter(lang for _, lang in train)
    names = sorted((k for k in sizes if k and sizes[k] >= 0.02 * len(train)), key=lambda k: (-sizes[k], k))
    other = len(names) if sum(sizes.values()) - sum(sizes[k] for k in names) >= 0.02 * len(train) else 0
    force = Force([(t, names.index(g) if g in names else other) for t, g in train], len(names) + (other > 0), **OPTIONS)
    assert any(len(c) == 2 for c in force.states) and any(c[-1] not in force.head for c in force.states) and any(c[-1] in force.head for c in force.states)
    want = Counter((i, round(force.score(t), 3)) for i, t, _ in rows)
    assert Counter((r.doc_id, round(r.score, 3)) for r in got) == want


def test_distributions_sum_to_one(spark):
    rows = corpus()
    force = Force([(t, 0) for _, t, _ in rows], 1, **OPTIONS)
    for context in force.states:
        total = 10 ** (math.log10(0.5 / (force.per[0] + 0.5 * (len(force.all) + 1))) + force.step(context[-1:], "?") + (force.step(context, "?") if len(context) > 1 else 0))
        for w in force.all:
            total += 10 ** (force.root(0, w) + force.step(context[-1:], w) + (force.step(context, w) if len(context) > 1 else 0))
        assert total <= 1 + 1e-9 and (total > 0.2 or any(w not in force.head for w in force.states[context][1]))


def test_unigram_figures_and_odd_tables(spark):
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate([*TEXTS, TEXTS[4]])] + [(None, "x y", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learns = F.col("doc_id") % 2 == 0
    got = lm.score(docs, learns, group_col="lang", head_share=0.01).collect()
    tokens = [w for i, t, _ in rows if i is not None and i % 2 == 0 for w in tokens_of(t)]
    c = Counter(tokens)
    n, v = len(tokens), len(c)
    want = Counter()
    for i, t, _ in rows:
        own = tokens_of(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[i, len(own), sum(c[w] > 0 for w in own), n, round(base, 6)] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 for r in got)
    assert lm.score(docs.limit(0), learns).count() == 0
    none = lm.score(docs, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.n_known == 0 and r.score <= 0 for r in none)


def test_words_across_slabs(monkeypatch):
    text = prose(3000, 1) + " " + "é" * 700 + "\x0b\x1c " + prose(50, 2)
    whole, size = lm.tokens([text, "", None, "a"])
    words = text.encode().lower().split()
    assert size.tolist() == [len(words) + 1, 1, 1, 2]
    assert whole[: len(words)].tolist() == [lm.word_hash(w) for w in words] and whole[-1] == lm.END
    monkeypatch.setattr(lm, "SLAB", 500)
    assert lm.tokens([text, "", None, "a"])[0].tolist() == whole.tolist()
    r = random.Random(1)
    many = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    assert len(set(lm.tokens([" ".join(many)])[0].tolist())) == len(set(many)) + 1


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packed_columns(n):
    import numpy as np

    a, b = np.sort(np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64)), np.arange(n, dtype=np.uint8)
    x, y = lm.unpack(lm.pack(lm._steps(a), b), "<u8", "<u1")
    assert np.cumsum(x, dtype=np.uint64).tolist() == a.tolist() and y.tolist() == b.tolist()


class Whole(Force):
    """Every context keeps every follower seen ``follower`` times, whatever its last word and the follower are."""

    def __init__(self, rows, groups, head_share, divergence, prior, follower):
        super().__init__(rows, groups, head_share, 1.0, divergence, prior, follower)
        n = sum(self.all.values())
        rare = max(math.log10(max(2, math.ceil(n * head_share)) - 0.5) - math.log10(self.per[g] + 0.5 * (len(self.c[g]) + 1)) for g in range(groups))
        most = {w: min(0.0, max(self.root(g, w) for g in range(groups)) if w in self.head else rare) for w in self.all}
        self.states, self.counts = {}, {}
        for length in (1, 2):
            found = defaultdict(Counter)
            for tokens, _ in self.rows:
                for i in range(length, len(tokens)):
                    found[tuple(tokens[i - length : i])][tokens[i]] += 1
            for context, following in found.items():
                kept = {w: k for w, k in following.items() if k >= follower}
                parent = {w: most[w] + (self.step(context[1:], w) if length > 1 else 0.0) for w in kept}
                self.counts[context] = sum(following.values())
                self.settle(context, kept, self.counts[context], parent, divergence, prior)


def test_no_follower_of_a_frequent_context_is_dropped(spark):
    """Rare followers and counts of two, in light and in heavy contexts."""
    options = {"head_share": 0.004, "divergence": 3.0, "prior": 0.5, "follower": 2}
    more = lambda i: f" aa mid bb aa mid bb odd{i % 7} aa mid u{i}" if i % 2 else f" cc mid dd cc mid dd odd{i % 7} cc mid u{i}"
    rows = [(i, t and t.replace("w3 ", f"w3 odd{i % 7} ") + more(i), lang) for i, t, lang in corpus() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") % 5 != 1, heavy_share=0.005, **options).collect() if r.doc_id != 63}
    force = Whole([(t, 0) for i, t, _ in rows if i % 5 != 1], 1, **options)
    n = sum(force.all.values())
    frequent = {c: gain for c, (_, gain) in force.states.items() if c[-1] in force.head}
    assert any(len(c) == k and w not in force.head for c, gain in frequent.items() for w in gain for k in (1, 2))
    assert {force.counts[c] >= 0.005 * n for c in frequent if len(c) == 2} == {True, False}
    bounded = Force([(t, 0) for i, t, _ in rows if i % 5 != 1], 1, gram_share=0.0015, **options)
    assert any(abs(force.score(t) - bounded.score(t)) > 0.1 for _, t, _ in rows)
    for i, t, _ in rows:
        if i != 63:
            assert got[i] == pytest.approx(force.score(t), abs=1e-3)
    for context in force.states:
        rest, two = (context[-1:], context) if len(context) > 1 else (context, ())
        total = sum(10 ** (force.root(0, w) + force.step(rest, w) + (force.step(two, w) if two else 0.0)) for w in force.all)
        assert total <= 1 + 1e-9
