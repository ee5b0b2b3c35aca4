"""Toxicity scores from a classifier that is regularised by counterfactuals.

Features are the distinct words of a text with their leading and closing letters. In labelled
texts that name a group, the name is swapped for another one; training penalises the squared change of
the score, next to the logistic loss and an L1 term that keeps chance words at zero weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import id_and_text, to_id, written

_LETTERS = re.compile(r"[^\W\d_]+")
#: Fixed list of names of groups that are swapped for one another.
IDENTITY_TERMS = (
    "women men girls boys gay lesbian straight transgender black white asian african european latino arab "
    "jewish muslim christian hindu buddhist atheist immigrant refugee disabled deaf blind old young "
    "femmes hommes juif musulman chrétien immigré frauen männer juden muslime christen ausländer "
    "mujeres hombres judío musulmán cristiano inmigrante"
).split()


def features_of(word: str) -> list[str]:
    """The word, its openings of three to six letters and its endings of four and five."""
    out = ["=" + word]
    out += ["^" + word[:k] for k in (3, 4, 5, 6) if len(word) > k]
    out += ["$" + word[-k:] for k in (4, 5) if len(word) > k]
    return out


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, logit: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(logit + self.bias, -40, 40))))


def all_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def swapped(words: set[str], terms=IDENTITY_TERMS) -> list[set[str]]:
    """The words with each name of a group changed for another one, in two ways; none where no group is named."""
    place = {t: i for i, t in enumerate(terms)}
    named = sorted(words & place.keys())
    if not named:
        return []
    return [(words - set(named)) | {terms[(place[t] + step) % len(terms)] for t in named} for step in (1, len(terms) // 2)]


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the set features."""
    size = np.array([len(f) for f in found], np.int64)
    return np.repeat(np.arange(len(found)), size), np.array([c for f in found for c in f], np.int64)


def fit(
    names: list[str], rows: list[list[int]], labels: list[int], swaps: list[list[int]], origin: list[int], *,
    l1: float = 2e-5, swap_penalty: float = 1.0, rounds: int = 400,
) -> Classifier:
    """Proximal gradient steps with momentum on logistic loss, swap penalty and L1.

    ``rows`` and ``swaps`` hold numbers of features; ``origin`` tells the row that each swap comes from.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        rate = y.mean() if len(y) else 0.0
        return Classifier({}, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    (r, c), (rs, cs) = _flat(rows), _flat(swaps)
    origin = np.array(origin, np.int64)
    n, m = len(rows), len(names)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))  # both labels count alike
    w, b = np.zeros(m), 0.0
    v, vb, t = w.copy(), b, 1.0
    size = np.bincount(r, minlength=n)
    step = 1.0 / (0.25 * float((weight * (size + 1)).sum()) / 4 + 1e-9)
    for _ in range(rounds):
        z = np.bincount(r, v[c], n) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = weight * (p - y)
        grad, gb = np.bincount(c, g[r], m), g.sum()
        if len(origin):
            zs = np.bincount(rs, v[cs], len(swaps)) + vb
            ps = 1 / (1 + np.exp(-np.clip(zs, -40, 40)))
            d = 2 * swap_penalty / len(origin) * (ps - p[origin])
            back = np.bincount(origin, -d * (p * (1 - p))[origin], n)
            grad += np.bincount(cs, (d * ps * (1 - ps))[rs], m) + np.bincount(c, back[r], m)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    keep = np.flatnonzero(w)
    return Classifier({names[i]: float(w[i]) for i in keep}, float(b))


def train(labelled: DataFrame, *, sample: int = 12_000, least_df: int = 6, evidence: float = -2.0, terms=IDENTITY_TERMS, **options) -> Classifier:
    """Fit on about ``sample`` rows (key, text, label), chosen by a hash of the key; all if there are fewer.

    Only features enter whose split between the labels is beyond chance, given how many there are: their
    log-likelihood ratio exceeds the logarithm of the number of features by ``evidence``. Features are counted
    and rows turned into numbers of features by tasks; texts never reach the driver. Rows without a label
    are left out; null texts have no features; without rows, or with one label alone, the score is constant.
    """
    spark = labelled.sparkSession
    labelled = labelled.where(F.col("label").isNotNull())
    total = labelled.count()
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    rows = labelled.where(unit < (1 << 20) * min(1.0, sample / max(total, 1)))
    rows = rows.select(F.col("key").cast("string").alias("key"), F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        hit: Counter = Counter()
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                found = all_features(words_of(text))
                df.update(found)
                if label:
                    hit.update(found)
        yield pd.DataFrame({"name": list(df), "n": list(df.values()), "hits": [hit[f] for f in df]}).astype({"name": object, "n": "int64", "hits": "int64"})

    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") != 0, 1).otherwise(0)).alias("hits")).first()
    rate = (sizes["hits"] or 0) / max(sizes["n"], 1)
    names: list[str] = []
    if 0 < rate < 1:
        counted = written(rows.mapInPandas(count, "name string, n long, hits long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")))
        least = np.log(counted.count()) + evidence
        p, q = F.col("hits") / F.col("n"), 1 - F.col("hits") / F.col("n")
        part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
        beyond = F.col("n") * (part(p, F.lit(rate)) + part(q, F.lit(1 - rate))) >= float(least)
        names = sorted(r["name"] for r in counted.where((F.col("n") >= least_df) & beyond).select("name").collect())
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = index.value
        ids = lambda words: sorted(known[f] for f in all_features(words) if f in known)
        for pdf in batches:
            sets = [words_of(t) for t in pdf["text"]]
            swaps = [[ids(x) for x in swapped(s, terms)] for s in sets]
            yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "own": [ids(s) for s in sets], "swaps": swaps})

    got = rows.mapInPandas(numbered, "key string, label int, own array<int>, swaps array<array<int>>").toPandas()
    each = sorted(
        (key or "", label, list(map(int, own)), [list(map(int, x)) for x in swaps])
        for key, label, own, swaps in zip(got["key"], got["label"].tolist(), got["own"], got["swaps"], strict=True)
    )
    changed = [(i, x) for i, (_, _, _, swaps) in enumerate(each) for x in swaps]
    return fit(names, [own for _, _, own, _ in each], [label for _, label, _, _ in each], [x for _, x in changed], [i for i, _ in changed], **options)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 200_000) -> DataFrame:
    """(id, score, words): the probability of label 1 for every whole text.

    ``model`` is a broadcast Classifier. A null or empty text has no words and gets the bias alone; texts
    of any length are read whole; repeated rows and null ids are scored row by row; an empty table gives no
    rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Classifier = model.value
        cache: dict[str, tuple[str, ...]] = {}
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = words_of(text)
                if len(cache) > limit:
                    cache.clear()
                for w in words.difference(cache):
                    cache[w] = tuple(f for f in features_of(w) if f in m.weights)
                found = sorted(set().union(*[cache[w] for w in words if cache[w]]))
                total = sum([m.weights[f] for f in found])
                rows.append((to_id(doc_id), m.score(total), len(words)))
            out = pd.DataFrame(rows, columns=["doc_id", "score", "words"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, score double, words long")
