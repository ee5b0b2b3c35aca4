"""Similarity join on word n-grams by chosen paths.

Every set of n-grams walks down a random tree: at each level it goes on along the tokens whose hash, under
the path so far, is below 1 / (threshold * size), so similar sets choose common tokens and
dissimilar ones part. Sets at the same leaf form a bucket; the walk is repeated until the target recall.
Inside a bucket all pairs are compared by sketches; what may be similar is joined into components, and within
these all pairs of sets are compared exactly, in blocks of bounded size. Equal sets count as one
throughout, and what leaves a task is a spanning forest and link counts, never all pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import ascii_lower, checkpoint, written
from evspark.llm.components import components

_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Odd 64-bit multipliers of the mixing steps.
M1, M2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BINS = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of all words where there are fewer."""
    words = _WORD.findall(ascii_lower(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * BASE + h[j : j + len(out)]
    return np.unique(mix(out + np.uint64(k)))


def paths(tokens: np.ndarray, runs: int, depth: int, threshold: float) -> np.ndarray:
    """Leaf keys of a set in all runs."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    limit = np.uint64(min(1.0, 1.0 / (threshold * len(tokens))) * (2.0**64 - 2048))
    at = mix((np.arange(runs, dtype=np.uint64) + np.uint64(1)) * BASE)
    step = max(1, 2_000_000 // len(tokens))
    for level in range(depth):
        found = []
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            chosen = mix(part[:, None] ^ (tokens[None, :] * (BASE + np.uint64(2 * level + 2)))) <= limit
            i, j = np.nonzero(chosen)
            found.append(mix(part[i] * M1 + tokens[j]))
        at = np.concatenate(found)
    return np.unique(at)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of BINS ranges of the hash a byte of its least token; 0 if there is none."""
    edges = np.searchsorted(tokens, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    out = np.zeros(BINS, np.uint8)
    nxt = np.append(edges[1:], len(tokens))
    full = nxt > edges
    out[full] = (mix(tokens[edges[full]] * M2) % np.uint64(255)).astype(np.uint8) + 1
    return out


def features(docs: DataFrame, n: int, runs: int, depth: int, threshold: float) -> DataFrame:
    """(id, sig, size, sketch, keys) for rows of id and text; and ``row`` where they have it."""
    more = [c for c in docs.columns if c == "row"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part, rows = pdf.iloc[lo : lo + 500], []
                for i, text in zip(part["id"], part["text"], strict=True):
                    s = ngram_set(text, n)
                    rows.append((i, xxhash.xxh128_digest(s.tobytes()), len(s), sketch(s).tobytes(), paths(s, runs, depth, threshold).view(np.int64)))
                found = pd.DataFrame(rows, columns=["id", "sig", "size", "sketch", "keys"])
                yield found.assign(**{c: part[c].to_numpy() for c in more})

    return docs.mapInPandas(run, ", ".join(["id long, sig binary, size long, sketch binary, keys array<long>", *[f"{c} long" for c in more]]))


def _groups(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work(frame) -> list of rows for each run of equal keys; groups are of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        rest, out = None, []
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            codes = pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(codes)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                out += work(pdf.iloc[a:b])
            rest = pdf.iloc[starts[-1] :] if len(starts) else None
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if rest is not None and len(rest):
            out += work(rest)
        yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _in_blocks(rows: DataFrame, key: str, most: int, most_tokens: int) -> DataFrame:
    """Rows of a key dealt into blocks; each row goes to the groups (key, p, q) of its block p or q."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("t"))
    sizes = sizes.select(F.col(key), F.greatest(F.ceil(F.col("m") / most), F.ceil(F.col("t") / most_tokens), F.lit(1)).cast("int").alias("nb"))
    dealt = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("nb", "other")


def _forest(similar_of, m: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest; similar_of(i, others) masks the others that are similar to i."""
    open_, edges = np.arange(m), []
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            i = front.pop()
            hit = similar_of(i, open_)
            new = open_[hit]
            edges += [(i, j) for j in new]
            front += new.tolist()
            open_ = open_[~hit]
    return edges


def _bucket_edges(frame: pd.DataFrame, least: float, threshold: float) -> list[tuple[bytes, bytes]]:
    s = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, BINS)
    size, sig = frame["size"].to_numpy(), frame["sig"].to_numpy()

    def similar(i, others):
        a, b = s[others], s[i]
        same = ((a == b) & (a > 0)).sum(1)
        either = ((a > 0) | (b > 0)).sum(1)
        lengths = np.minimum(size[others], size[i]) >= threshold * np.maximum(size[others], size[i]) - 1e-9
        return (same >= least * either) & lengths

    return [(sig[i], sig[j]) for i, j in _forest(similar, len(s))]


def _exact_links(frame: pd.DataFrame, threshold: float) -> list[tuple[bytes, bytes | None, int]]:
    """Spanning edges and link counts among sets; across two blocks only pairs from both."""
    sets = [np.frombuffer(b, np.uint64) for b in frame["tokens"]]
    sig, copies, own = frame["sig"].to_numpy(), frame["copies"].to_numpy(), frame["own"].to_numpy()
    across = frame["p"].iloc[0] != frame["q"].iloc[0]
    size = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    similar = np.zeros((len(sets), len(sets)), bool)
    for i in range(len(sets)):
        mine = codes[starts[i] : starts[i] + size[i]]
        mark[mine] = 1
        common = np.add.reduceat(mark[codes], starts)
        mark[mine] = 0
        similar[i] = common >= threshold * (size + size[i] - common) - 1e-9
        similar[i, i] = False
        if across:
            similar[i] &= own != own[i]
    links = similar @ copies
    out = [(sig[i], None, int(n)) for i, n in enumerate(links) if n]
    return out + [(sig[i], sig[j], 0) for i, j in _forest(lambda i, others: similar[i, others], len(sets))]


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with the given chance.

    At the threshold a pair shares one child on average; a Poisson number of them survives ``depth``
    levels with chance s, s <- 1 - exp(-s) from 1.
    """
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.99999,
    depth: int = 2,
    sketch_slack: float = 0.24,
    bucket: int = 2048,
    block: int = 256,
    block_tokens: int = 2_000_000,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: id, class_id (least id of all that links reach) and n_links (other documents
    whose n-gram sets have Jaccard similarity of ``threshold`` or more).

    Words are as in decontamination. A text of fewer than ``n`` words is one n-gram; texts without
    words (null, empty) are equal sets and so one class; equal texts link to each other; a row with a
    null id has a null class and no links; rows that repeat an id are each counted; an empty table
    gives no rows; other columns are ignored; texts of any length are read whole. Buckets and
    components of any size are compared in blocks, so nothing is capped. A column ``row_col`` of longs is
    carried along, to tell rows of one id apart, and a column class_key tells classes apart, as two of them may
    have the same least id where ids are repeated; it is null for a null id.
    """
    more = [] if row_col is None else ["row"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(row_col).cast("long").alias(c) for c in more]
    )
    named = rows.where(F.col("id").isNotNull())
    runs = runs_for(recall, depth)
    feats = written(features(named, n, runs, depth, threshold))
    reps = feats.groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    one = feats.join(reps.select(F.col("sig").alias("s"), "rep"), (F.col("sig") == F.col("s")) & (F.col("id") == F.col("rep")))
    one = written(one.select("sig", "rep", "size", "sketch", "keys").dropDuplicates(["sig"]))

    keyed = one.select("sig", F.explode("keys").alias("key"))
    same = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(7))).alias("y")
    )
    shared = same.where(F.col("m") > 1).groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key")  # buckets with equal members once
    members = keyed.join(shared, "key").join(one.select("sig", "size", "sketch"), "sig")
    pairs = _groups(
        _in_blocks(members, "key", bucket, 1 << 60), ["key", "p", "q"], lambda f: _bucket_edges(f, threshold - sketch_slack, threshold), "a binary, b binary"
    )
    near = checkpoint(components(pairs.distinct()).select(F.col("node").alias("sig"), F.col("root").alias("comp")))

    wanted = near.join(one.select("sig", "rep"), "sig").join(reps.select("sig", "copies"), "sig")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                found = [ngram_set(t, n) for t in part["text"]]
                out = part[["comp", "sig", "copies"]].assign(size=[len(s) for s in found], tokens=[s.tobytes() for s in found])
                yield out[[xxhash.xxh128_digest(t) == s for t, s in zip(out["tokens"], out["sig"], strict=True)]]

    got = named.join(wanted, F.col("id") == F.col("rep")).select("comp", "sig", "copies", "text")
    got = got.mapInPandas(sets, "comp binary, sig binary, copies long, size long, tokens binary").dropDuplicates(["sig"])
    got = written(got)
    compared = written(
        _groups(_in_blocks(got, "comp", block, block_tokens), ["comp", "p", "q"], lambda f: _exact_links(f, threshold), "sig binary, peer binary, links long")
    )
    linked = compared.where(F.col("peer").isNull()).groupBy("sig").agg(F.sum("links").alias("links"))
    roots = components(compared.where(F.col("peer").isNotNull()).select(F.col("sig").alias("a"), F.col("peer").alias("b")))
    roots = roots.select(F.col("node").alias("sig"), "root")
    info = reps.join(linked, "sig", "left").join(roots, "sig", "left")
    info = info.withColumn("root", F.coalesce("root", "sig"))
    classes = info.groupBy("root").agg(F.min("rep").alias("class_id"))
    info = info.join(classes, "root").select(
        "sig", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.xxhash64("root").alias("class_key")
    )
    more += ["class_key"] if more else []
    found = feats.select("id", "sig", *more[:1]).join(info, "sig").select("id", "class_id", "n_links", *more)
    none = F.lit(None).cast("long")
    lost = rows.where(F.col("id").isNull()).select("id", none.alias("class_id"), F.lit(0).cast("long").alias("n_links"), *more[:1], *[none.alias(c) for c in more[1:]])
    out = found.union(lost).withColumnRenamed("id", id_col)
    return out.withColumnRenamed("row", row_col) if more else out
