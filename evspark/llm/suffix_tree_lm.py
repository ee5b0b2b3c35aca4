"""Language-model scores from a probabilistic suffix tree over the token stream.

Symbols are words, known by 64-bit hashes, and an end after each text. A context is a run of tokens of the
same text; it becomes a state if its next-symbol distribution diverges from that of its longest proper
suffix by ``divergence`` nats over its repeated followers. Each token is scored in the longest state that is a suffix of
what precedes it. A state s with n(s) occurrences keeps the followers that come often enough and gives
P(w | s) = (n(s, w) + a P(w | suffix of s)) / (n(s) + b): b is ``prior`` for each kept follower, and a is
b plus all occurrences whose follower is not kept, so that each state's distribution sums to one.

The root is a unigram with half a count for each symbol and one unknown one. Training rows may come in
groups (languages): each has a root of its own, and a text's probability is the sum over the groups
of their shares times what they give it. A state multiplies the roots of all groups by the same
factor, worked out for the group in which the follower is likeliest, so that no group's distribution exceeds one.

Every context of one or two words keeps every follower seen ``follower`` times; the divergence decides. Where
the last word of a context is rare (below ``head_share`` of all tokens), a shuffle by that word brings its
occurrences together. Where it is frequent, a shuffle by pair counts the pairs, and sums of each word's followers
decide on its state; then the contexts of two words are shuffled, with what their pairs are known to give. Of these,
the ones with ``heavy_share`` of all tokens go by context and follower, and again their sums decide. What is
broadcast is bounded: roots and sums of frequent words, sums of heavy contexts. Rows of a shuffle are packed columns of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import checkpoint, written

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
END = np.uint64(xxhash.xxh64_intdigest(b" end"))  # no word has a blank
SECOND = np.uint64(44)  # bits of the other symbol in a pair's number, before which a frequent one's id stands
FAR = np.uint64(1 << 43)  # marks the 43 bits of hash of a symbol that is not frequent
FINE = float(1 << 20)  # sums over shuffled parts are of integers, as their order is left to chance
RARE = np.uint32(1 << 31)  # marks the hash of a symbol that is not frequent
SLAB, FLUSH = 1 << 22, 1_000_000
HELD_OUT = 255
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(SLAB + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(BASE), _powers(INVERSE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, begin) of the words of a byte array that ends in a blank; of words beyond a slab by themselves."""
    blank = _BLANK[data]
    turn = np.flatnonzero(np.diff(blank, prepend=True))
    begin, stop = turn[::2], turn[1::2]
    if len(data) > SLAB:
        raw = data.tobytes()
        return np.array([word_hash(raw[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.uint64), begin
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _DOWN[: len(data)], out=sums[1:])
    return _mix((sums[stop] - sums[begin]) * _UP[begin] + (stop - begin).astype(np.uint64)), begin


def word_hash(word: bytes) -> int:
    """Hash of one word, as of all words of a text."""
    h = 0
    for i, b in enumerate(word):
        h += (b + 1) * pow(BASE, -i, 1 << 64)
    return int(_mix(np.array([(h + len(word)) & ((1 << 64) - 1)], np.uint64))[0])


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens of each text): words with A-Z lower-cased, and an end after each text."""
    blobs = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = b"\n".join(blobs) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    found, begins, at = [], [], 0
    while at < len(data):
        stop = min(at + SLAB, len(data))
        if stop < len(data):  # cut at a blank
            blanks = np.flatnonzero(_BLANK[data[at:stop]])
            while not len(blanks):
                stop = min(stop + SLAB, len(data))
                blanks = np.flatnonzero(_BLANK[data[at:stop]])
            stop = at + int(blanks[-1]) + 1
        h, begin = _word_hashes(data[at:stop])
        found.append(h)
        begins.append(begin + at)
        at = stop
    words, begin = np.concatenate(found), np.concatenate(begins)
    edge = np.cumsum([0, *[len(b) + 1 for b in blobs]])
    count = np.diff(np.searchsorted(begin, edge))
    out = np.full(len(words) + len(texts), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), count)] = words
    return out, count + 1


def _slabs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in runs of about a slab of text."""
    for pdf in batches:
        size = np.cumsum([len(t or "") + 1 for t in pdf["text"]]) // (SLAB // 2)
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield pdf.iloc[lo:hi]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as byte planes, which a shuffle compresses well."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns]
    return np.array([len(columns[0])], "<i8").tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, "<i8", 1)[0]), 0, []
    raw = pa.decompress(blob[8:], n * sum(np.dtype(k).itemsize for k in kinds), "zstd", asbytes=True)
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind)[:, 0] if n else np.zeros(0, kind))
        at += size * n
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned numbers; ``np.cumsum`` brings them back."""
    return np.diff(values, prepend=values[:1] - values[:1])


def _by_key(rows: DataFrame, parts: int, work, schema: str) -> DataFrame:
    """work(kind, key, blobs) for each (kind, key); a partition holds its keys one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        now = None
        for pdf in batches:
            for kind, key, blob in zip(pdf["kind"].tolist(), pdf["key"].tolist(), pdf["blob"], strict=True):
                if (kind, key) != now:
                    if held:
                        yield from work(*now, held)
                    now, held = (kind, key), []
                held.append(blob)
        if held:
            yield from work(*now, held)

    return rows.repartition(parts, "kind", "key").sortWithinPartitions("kind", "key").mapInPandas(run, schema)


PACKED = "kind int, key long, blob binary"


def _summed(rows: DataFrame, keys_of, groups: int, buckets: int) -> DataFrame:
    """(kind 0, bucket, blob) of sorted (key, a count for each group), summed within a task before the shuffle.

    ``keys_of(frame)`` gives evenly spread unsigned keys and the group of each; the bucket is their high part.
    """
    width = np.uint64(-(-(1 << 64) // buckets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            key, n = _merged(held)
            bucket = (key // width).astype(np.int64)
            edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            out = [(0, int(bucket[x]), pack(_steps(key[x:y]), *n[x:y].T.astype("<u4"))) for x, y in zip(edge[:-1], edge[1:], strict=True)]
            return pd.DataFrame(out, columns=["kind", "key", "blob"])

        for pdf in _slabs(batches):
            key, group = keys_of(pdf)
            key, at = np.unique(key, return_inverse=True)
            held.append((key, np.bincount(at * groups + group, minlength=len(key) * groups).reshape(-1, groups)))
            if sum(len(k) for k, _ in held) > 2 * FLUSH:
                held = [_merged(held)]
                if len(held[0][0]) > FLUSH:
                    yield flush()
                    held = []
        if sum(len(k) for k, _ in held):
            yield flush()

    return rows.mapInPandas(run, PACKED)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    n = np.concatenate([n for _, n in held])
    return key, np.stack([np.bincount(at, n[:, g], len(key)) for g in range(n.shape[1])], 1).astype(np.int64)


def _totals(blobs: list[bytes], groups: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(b, "<u8", *["<u4"] * groups) for b in blobs]
    return _merged([(np.cumsum(k, dtype=np.uint64), np.stack(n, 1)) for k, *n in parts])


@dataclass
class Model:
    """What is broadcast first: the roots."""

    groups: int
    tokens: int  # all training tokens, and of each group
    per: np.ndarray
    distinct: int
    kinds: np.ndarray  # distinct tokens of each group
    log_prior: np.ndarray
    head: np.ndarray  # sorted hashes of the frequent symbols; ids count from 1
    counts: np.ndarray  # (head, groups)
    least: int  # occurrences from which a symbol is frequent
    divergence: float
    prior: float
    follower: int  # occurrences from which a follower is kept
    enough: int  # the same for contexts that end in a frequent symbol
    near_only: bool  # whether those keep frequent followers only
    heavy: int  # occurrences from which a context of two is spread over its followers

    def __post_init__(self):
        self.floor = math.log10(self.tokens + 0.5 * (self.distinct + 1))
        self.floors = np.log10(self.per + 0.5 * (self.kinds + 1))
        self.base = np.log10(np.concatenate([[0.5], self.counts.sum(1) + 0.5])) - self.floor
        self.root = (np.log10(np.concatenate([np.full((1, self.groups), 0.5), self.counts + 0.5])) - self.floors).astype(np.float32)
        best = self.root.max(1).astype(float)
        best[0] = (math.log10(max(self.least - 1, 0) + 0.5) - self.floors).max()  # the most that a rare symbol can have
        self.most = np.minimum(best, 0.0)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of frequent symbols, 0 for others."""
        if not len(self.head):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return np.where(self.head[at] == hashes, at + 1, 0)

    def kept(self, symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether followers (0: not frequent) seen n times in frequent symbols are kept."""
        return (n >= self.enough) & (symbol > 0) if self.near_only else n >= self.enough

    def split(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id of the frequent symbol, id of the other one or 0) of pairs' numbers."""
        other = numbers & np.uint64((1 << 44) - 1)
        return (numbers >> SECOND).astype(np.int64), np.where(other < FAR, other, 0).astype(np.int64)


@dataclass
class Contexts:
    """Contexts known by their sums: log10 of what other followers lose, 0 where no state; and the share's a."""

    lost: np.ndarray
    a: np.ndarray

    def factor(self, context: np.ndarray, n: np.ndarray, parent: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """log10 factor over the parent of followers seen n times."""
        lost = self.lost[context]
        return lost + np.where(kept & (lost != 0), np.log10(1.0 + n / (self.a[context] * 10.0**parent)), 0.0)


def states(occurrences: np.ndarray, all_: np.ndarray, apart: np.ndarray, kept: np.ndarray, divergence: float, prior: float) -> Contexts:
    """From the occurrences of contexts and of their kept followers, the divergences and numbers of these."""
    b = prior * kept
    is_state = (apart >= divergence) & (b > 0)
    a = np.where(is_state, np.maximum(occurrences - all_, 0) + b, 1.0)
    return Contexts(np.where(is_state, np.log10(a / np.where(is_state, np.maximum(occurrences, all_) + b, 1.0)), 0.0), a)


def settle(context: np.ndarray, n: np.ndarray, parent: np.ndarray, occurrences: np.ndarray, divergence: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(log10 loss of each context, 0 where it is no state; log10 gain of each kept follower over the parent).

    ``context`` numbers each kept follower's context, ``n`` counts it, ``parent`` is log10 of what the parent gives it.
    """
    size = len(occurrences)
    all_ = np.bincount(context, n, size)
    apart = np.bincount(context, n * (np.log(n / np.maximum(occurrences[context], 1)) - parent * math.log(10)), size)
    found = states(occurrences, all_, apart, np.bincount(context, minlength=size), divergence, prior)
    gain = np.where(found.lost[context] != 0, np.log10(1.0 + n / (found.a[context] * 10.0**parent)), 0.0)
    return found.lost, gain


def _learn(rows: DataFrame, groups: int, parts: int, head_share: float, gram_share: float | None, heavy_share: float, follower: int, **options) -> Model:
    """The roots of rows of text and group."""

    def words(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        h, size = tokens(pdf["text"].tolist())
        return h, np.repeat(pdf["group"].to_numpy(), size)

    def counted(kind: int, key: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        h, n = _totals(blobs, groups)
        some = (n.sum(1) > 1) | (h == END)
        row = (n.sum(0).tolist(), (n > 0).sum(0).tolist(), len(h), pack(h[some], *n[some].T.astype("<i8")))
        yield pd.DataFrame([row], columns=["per", "kinds", "distinct", "blob"])

    table = _by_key(_summed(rows, words, groups, 2 * parts), parts, counted, "per array<long>, kinds array<long>, distinct long, blob binary")
    table = checkpoint(table)
    sums = table.agg(
        *[F.sum(F.get(c, F.lit(g))).alias(f"{c}{g}") for c in ("per", "kinds") for g in range(groups)], F.sum("distinct").alias("distinct")
    ).first()
    per = np.array([sums[f"per{g}"] or 0 for g in range(groups)])
    all_ = int(per.sum())
    least = max(2, math.ceil(all_ * head_share))

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["blob"]:
                h, *n = unpack(blob, "<u8", *["<i8"] * groups)
                n = np.stack(n, 1)
                some = (n.sum(1) >= least) | (h == END)
                yield pd.DataFrame({"h": h[some].view(np.int64), "n": pd.Series(list(n[some]), dtype=object)})

    head = table.select("blob").mapInPandas(frequent, "h long, n array<long>").toPandas()
    found = dict(zip(head["h"].to_numpy().view(np.uint64).tolist(), head["n"], strict=True))
    found.setdefault(int(END), np.zeros(groups, np.int64))
    order = sorted(found)
    counts = np.array([np.asarray(found[h], np.int64) for h in order]).reshape(-1, groups)
    members = found[int(END)]
    return Model(
        groups, all_, per, int(sums["distinct"] or 0), np.array([sums[f"kinds{g}"] or 0 for g in range(groups)]),
        np.log10((np.asarray(members) + 0.5) / (np.sum(members) + 0.5 * groups)), np.array(order, np.uint64), counts, least, **options,
        follower=follower, enough=max(1, follower) if gram_share is None else max(2, math.ceil(all_ * gram_share)),
        near_only=gram_share is not None, heavy=max(least, math.ceil(all_ * heavy_share)),
    )


def _rare(m: Model, c: np.ndarray, following: np.ndarray, before: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, counts of c by group, log10 factor of what follows) for occurrences of words that are not frequent.

    All occurrences of such a word are here, so its counts, its contexts of one and two words and their
    followers are known; ``group`` is HELD_OUT for those that are scored only.
    """
    order = np.lexsort((before, following, c))
    c, following, before, group = c[order], following[order], before[order], group[order].astype(np.int64)
    learns = (group != HELD_OUT).astype(float)
    new = np.diff(c, prepend=~c[:1]) != 0
    word = np.cumsum(new) - 1
    counts = np.bincount(word * m.groups + np.where(learns > 0, group, 0), learns, (int(word[-1]) + 1) * m.groups).reshape(-1, m.groups).astype(np.int64)

    new[1:] |= following[1:] != following[:-1]
    pair = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    n, context = np.bincount(pair, learns), word[at]
    symbol = np.where(following[at] >= RARE, 0, following[at])
    parent = m.most[symbol]
    some = n >= m.follower
    lost, gained = settle(context[some], n[some], parent[some], counts.sum(1).astype(float), m.divergence, m.prior)
    factor = lost[context]
    factor[some] += gained
    parent = parent + factor

    new[1:] |= before[1:] != before[:-1]
    triple = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    n = np.bincount(triple, learns)
    _, context = np.unique((word[at].astype(np.uint64) << np.uint64(32)) | before[at], return_inverse=True)
    some = (n >= m.follower) & (before[at] != 0)
    lost, gained = settle(context[some], n[some], parent[pair[at]][some], np.bincount(context, n), m.divergence, m.prior)
    longer = lost[context]
    longer[some] += gained
    return order, counts[word], factor[pair] + longer[triple]


def _chunks(batches: Iterator[pd.DataFrame], m: Model) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, rows, hashes, ids and texts' lengths in tokens) for runs of rows; a partition is cut alike each time."""
    chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
    for pdf in _slabs(batches):
        h, n = tokens(pdf["text"].tolist())
        held.append((pdf[["doc_id", "group"]], h, n))
        size += len(h) + 10 * len(n)
        if size > 2 * FLUSH:
            rows, h, n = zip(*held, strict=True)
            yield chunk, pd.concat(rows), (h := np.concatenate(h)), m.ids(h), np.concatenate(n)
            chunk, held, size = chunk + 1, [], 0
    if held:
        rows, h, n = zip(*held, strict=True)
        yield chunk, pd.concat(rows), (h := np.concatenate(h)), m.ids(h), np.concatenate(n)


def _learning(rows: pd.DataFrame) -> np.ndarray:
    group = rows["group"].to_numpy()
    return np.where(group < 0, HELD_OUT, group).astype(np.uint8)


def _place(size: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _pairs(ids: np.ndarray, other: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens that follow a frequent one, sorted distinct spread numbers of these pairs, number of each token's)."""
    at = np.flatnonzero(np.concatenate([[0], ids[:-1]]) * (place > 0))
    key, index = np.unique(((ids[at - 1].astype(np.uint64) << SECOND) | other[at]) * np.uint64(BASE), return_inverse=True)
    return at, key, index


def _dealt(kind: int, bucket: np.ndarray, chunk: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows of packed columns for each run of a bucket; the first column is sorted within it."""
    edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    head = np.array([chunk], "<i8").tobytes()
    return [(kind, int(bucket[x]), head + pack(_steps(columns[0][x:y]), *[c[x:y] for c in columns[1:]])) for x, y in zip(edge[:-1], edge[1:], strict=True)]


def _gathered(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    """The chunk of each row and the columns of what was dealt."""
    parts = [unpack(b[8:], *kinds) for b in blobs]
    chunk = np.repeat([int(np.frombuffer(b, "<i8", 1)[0]) for b in blobs], [len(x[0]) for x in parts])
    return [chunk, np.concatenate([np.cumsum(x[0], dtype=kinds[0]) for x in parts]), *[np.concatenate([x[i] for x in parts]) for i in range(1, len(kinds))]]


def _added(chunk: np.ndarray, doc: np.ndarray, factor: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (kind 0, chunk) of what is added to the scores of its texts."""
    some = np.flatnonzero(factor)
    some = some[np.lexsort((doc[some], chunk[some]))]
    chunk, doc, factor = chunk[some], doc[some], factor[some]
    first = np.flatnonzero((np.diff(chunk, prepend=-1) != 0) | (np.diff(doc.astype(np.int64), prepend=-1) != 0))
    total = np.add.reduceat(factor, first) if len(first) else factor
    chunk, doc = chunk[first], doc[first]
    edge = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk))
    return [(0, int(chunk[x]), b"s" + pack(_steps(doc[x:y]), total[x:y].astype("<f4"))) for x, y in zip(edge[:-1], edge[1:], strict=True)]


def _packed(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "key", "blob"])


def _context_sums(context: np.ndarray, n: np.ndarray, occurrences: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, their occurrences, kept followers' occurrences, divergences in fine steps, number of these)."""
    apart = np.rint(n * (np.log(n / np.maximum(occurrences, 1)) - parent * math.log(10)) * FINE)
    found, first, index = np.unique(context, return_index=True, return_inverse=True)
    return found, np.stack([occurrences[first], *[np.bincount(index, w, len(found)) for w in (n, apart)], np.bincount(index, minlength=len(found))]).astype("<i8")


def _collected(rows: DataFrame, m: Model) -> tuple[np.ndarray, Contexts]:
    """(sorted contexts, what they are) from rows of kind 3, which hold sums of each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["blob"]:
                context, *sums = unpack(blob, "<u8", *["<i8"] * 4)
                yield pd.DataFrame({"context": context.view(np.int64), **dict(zip(("occurrences", "n", "apart", "kept"), sums, strict=True))})

    found = rows.where("kind = 3").select("blob").mapInPandas(run, "context long, occurrences long, n long, apart long, kept long")
    found = found.groupBy("context").agg(F.max("occurrences").alias("occurrences"), *[F.sum(c).alias(c) for c in ("n", "apart", "kept")]).toPandas()
    context = found["context"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(context)
    occurrences, n, apart, kept = (found[c].to_numpy()[order].astype(float) for c in ("occurrences", "n", "apart", "kept"))
    return context[order], states(occurrences, n, apart / FINE, kept, m.divergence, m.prior)


def _scored(docs: DataFrame, model, parts: int) -> DataFrame:
    sc, m = docs.sparkSession.sparkContext, model.value
    groups = m.groups
    # a chunk is the same whenever the rows are read, whatever order a shuffle before them had
    docs = docs.sortWithinPartitions("doc_id", F.xxhash64("text"), "group")
    buckets = 1 << max(1, (max(2 * parts, m.tokens >> 22) - 1).bit_length())
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def other_of(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.where(ids > 0, ids.astype(np.uint64), (h >> np.uint64(21)) | FAR)

    def code_of(other: np.ndarray) -> np.ndarray:
        return np.where(other < FAR, other.astype(np.uint32), ((other & ~FAR) >> np.uint64(12)).astype(np.uint32) | RARE)

    def rare_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, rows, h, ids, size in _chunks(batches, model.value):
            code = code_of(other_of(h, ids))
            before = np.where(_place(size) > 0, np.concatenate([code[:1], code[:-1]]), np.uint32(0))
            at = np.flatnonzero(ids == 0)
            at = at[np.argsort(h[at], kind="stable")]
            doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)[at]
            following = code[np.minimum(at + 1, len(h) - 1)]
            yield _packed(_dealt(1, (h[at] >> shift).astype(np.int64), chunk, h[at], following, before[at], _learning(rows)[doc], doc))

    def rare_settled(kind: int, key: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        chunk, c, following, before, group, doc = _gathered(blobs, "<u8", "<u4", "<u4", "<u1", "<u4")
        order, counts, factor = _rare(model.value, c, following, before, group)
        chunk, doc = chunk[order], doc[order]
        by = np.lexsort((doc, chunk))
        chunk, doc, counts, factor = chunk[by], doc[by], counts[by], factor[by].astype("<f4")
        edge = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk))
        yield _packed([(0, int(chunk[x]), b"r" + pack(_steps(doc[x:y]), factor[x:y], *counts[x:y].T.astype("<u4"))) for x, y in zip(edge[:-1], edge[1:], strict=True)])

    def pairs_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, rows, h, ids, size in _chunks(batches, model.value):
            at, key, index = _pairs(ids, other_of(h, ids), _place(size))
            learns = np.repeat(_learning(rows) != HELD_OUT, size)[at]
            n = np.bincount(index, learns, len(key)).astype("<u4")
            yield _packed(_dealt(1, (key >> shift).astype(np.int64), chunk, key, n))

    def pairs_counted(kind: int, key: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        chunk, number, n = _gathered(blobs, "<u8", "<u4")
        number, index = np.unique(number, return_inverse=True)
        n = np.bincount(index, n, len(number)).astype(np.int64)
        edge = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk))
        head = b"p" + np.array([key], "<i8").tobytes()
        out = [(0, int(chunk[x]), head + pack(n[index[x:y]].astype("<u4"))) for x, y in zip(edge[:-1], edge[1:], strict=True)]
        u, w = m.split(number * np.uint64(INVERSE))
        some = m.kept(w, n)
        u, n, w = u[some], n[some], w[some]
        found, sums = _context_sums(u, n, m.counts.sum(1)[u - 1], m.most[w])
        yield _packed([*out, (3, key, pack(found.astype("<u8"), *sums))])

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        seen = np.concatenate([[False], m.counts.sum(1) > 0])
        for chunk, rows, h, ids, size in _chunks(batches, m):
            doc, frequent = np.repeat(np.arange(len(size)), size), ids > 0
            sums = [np.bincount(doc, np.where(frequent, m.root[ids, g], 0.0), len(size)) for g in range(groups)]
            known = np.bincount(doc, seen[ids], len(size)).astype(np.int64)
            base = np.bincount(doc, np.where(frequent, m.base[ids], 0.0), len(size))
            null = rows["doc_id"].isna().to_numpy()
            key = np.array([0 if i is None else int(i) for i in rows["doc_id"].where(~null, None)], np.int64)
            own = pack(key, null.astype(np.uint8), size.astype(np.int64), known, base, *sums, _learning(rows))
            yield _packed([(0, chunk, b"o" + own), (0, chunk, b"i" + pack(ids.astype("<u4"))), (0, chunk, b"h" + pack(h[~frequent] >> np.uint64(21)))])

    own_kinds = ["<i8", "<u1", "<i8", "<i8", "<f8", *["<f8"] * groups, "<u1"]

    def contexts_seen(kind: int, chunk: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        own, ids, far = (next(b for b in blobs if b[:1] == k) for k in (b"o", b"i", b"h"))
        columns = unpack(own[1:], *own_kinds)
        size, learns = columns[2], columns[-1]
        ids = unpack(ids[1:], "<u4")[0].astype(np.int64)
        other = ids.astype(np.uint64)
        other[ids == 0] = unpack(far[1:], "<u8")[0] | FAR
        at, key, index = _pairs(ids, other, place := _place(size))
        total = sorted((int(np.frombuffer(b, "<i8", 1, 1)[0]), b) for b in blobs if b[:1] == b"p")
        n = np.zeros(len(ids), np.int64)  # of the pair that ends at each token
        if len(at):
            n[at] = np.concatenate([unpack(b[9:], "<u4")[0] for _, b in total])[index]
        doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
        kept = m.kept(ids, n)
        factor = words.value.factor(ids[at - 1], n[at], m.most[ids[at]], kept[at])
        out = [(0, chunk, b"o" + own[1:]), *_added(np.full(len(at), chunk), doc[at], factor)]
        at = at[place[at] > 1]
        likely = kept[at - 1] & (ids[at - 2] > 0)  # others were seen too rarely to keep a follower
        at = at[likely if m.near_only else likely | (ids[at - 2] == 0)]
        context = ((ids[at - 1].astype(np.uint64) << SECOND) | other[at - 2]) * np.uint64(BASE)
        code = np.where(kept[at], code_of(other[at]), 0).astype("<u4")
        heavy = (ids[at - 2] > 0) & (n[at - 1] >= m.heavy)
        pair, learns = np.where(kept[at], n[at], 0).astype("<u4"), (learns != HELD_OUT)[doc[at]].astype("<u1")
        for kind, some in ((1, np.flatnonzero(~heavy)), (2, np.flatnonzero(heavy))):
            c = context[some]
            bucket = c if kind == 1 else _mix(c + np.where(code[some] > 0, code[some], doc[at[some]]).astype(np.uint64))
            bucket = (bucket >> shift).astype(np.int64)
            by = np.lexsort((doc[at[some]], c, bucket))
            some, c, bucket = some[by], c[by], bucket[by]
            of_context = [n[at[some] - 1].astype("<u4")] if kind == 2 else []
            out += _dealt(kind, bucket, chunk, c, code[some], pair[some], learns[some], doc[at[some]], *of_context)
        yield _packed(out)

    def contexts_settled(kind: int, key: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        if kind == 0:
            yield _packed([(0, key, b) for b in blobs])
            return
        chunk, context, code, pair, learns, doc, *of_context = _gathered(blobs, "<u8", "<u4", "<u4", "<u1", "<u4", *["<u4"] * (kind == 2))
        order = np.lexsort((code, context))
        chunk, context, code, pair, doc, learns = chunk[order], context[order], code[order], pair[order], doc[order], learns[order].astype(float)
        new = np.diff(context, prepend=~context[:1]) != 0
        which = np.cumsum(new) - 1
        occurrences = np.bincount(which, learns)
        new[1:] |= code[1:] != code[:-1]
        triple, at = np.cumsum(new) - 1, np.flatnonzero(new)
        n = np.bincount(triple, learns)
        u, _ = m.split(context[at] * np.uint64(INVERSE))
        w = np.where(code[at] < RARE, code[at], 0).astype(np.int64)
        parent = m.most[w] + words.value.factor(u, pair[at], m.most[w], code[at] > 0)
        some = (code[at] > 0) & (n >= m.enough)
        if kind == 1:
            lost, gained = settle(which[at][some], n[some], parent[some], occurrences, m.divergence, m.prior)
            factor = lost[which[at]]
            factor[some] += gained
            yield _packed(_added(chunk, doc, factor[triple]))
            return
        found, sums = _context_sums(context[at][some], n[some], of_context[0][order][at][some].astype(float), parent[some])
        kept = np.where(some, n, 0).astype("<u4")
        yield _packed([(3, key, pack(found, *sums)), (2, key, pack(chunk, doc, context, kept[triple], parent[triple]))])

    def heavy_settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, found = heavy.value
        for pdf in batches:
            for blob in pdf["blob"] if len(known) else []:
                chunk, doc, context, n, parent = unpack(blob, "<i8", "<u4", "<u8", "<u4", "<f8")
                at = np.minimum(np.searchsorted(known, context), len(known) - 1)
                factor = np.where(known[at] == context, found.factor(at, n, parent, n > 0), 0.0)
                yield _packed(_added(chunk, doc, factor))

    def summed(kind: int, key: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        own = next(b for b in blobs if b[:1] == b"o")
        ids, null, size, known, base, *sums, _ = unpack(own[1:], *own_kinds)
        known, base, factor, sums = known.copy(), base.copy(), np.zeros(len(ids)), [x.copy() for x in sums]
        rows = len(ids)
        for b in blobs:
            if b[:1] == b"o":
                continue
            doc, gained, *counts = unpack(b[1:], "<u4", "<f4", *["<u4"] * (groups if b[:1] == b"r" else 0))
            doc = np.cumsum(doc, dtype=np.uint32)
            factor += np.bincount(doc, gained, rows)
            if counts:
                n = np.sum(counts, 0, dtype=np.int64)
                known += np.bincount(doc, n > 0, rows).astype(np.int64)
                base += np.bincount(doc, np.log10(n + 0.5) - m.floor, rows)
                for g in range(groups):
                    sums[g] += np.bincount(doc, np.log10(counts[g] + 0.5) - m.floors[g], rows)
        each = np.stack(sums, 1) + m.log_prior
        most = each.max(1)
        score = most + np.log10((10.0 ** (each - most[:, None])).sum(1)) + factor
        out = {"n_tokens": size, "n_known": known, "train_tokens": np.full(len(ids), m.tokens), "base_score": base, "score": score}
        yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), **out}).assign(doc_id=pd.Series(pd.array(ids, "Int64")).mask(null.astype(bool)))

    counted = written(_by_key(docs.mapInPandas(pairs_seen, PACKED), parts, pairs_counted, PACKED))
    u, found = _collected(counted, m)
    lost, a = np.zeros(len(m.head) + 1), np.ones(len(m.head) + 1)
    lost[u.astype(np.int64)], a[u.astype(np.int64)] = found.lost, found.a
    words = sc.broadcast(Contexts(lost, a))
    seen = _by_key(docs.mapInPandas(texts, PACKED).union(counted.where("kind = 0")), parts, contexts_seen, PACKED)
    settled = written(_by_key(seen, parts, contexts_settled, PACKED))
    heavy = sc.broadcast(_collected(settled, m))
    rare = _by_key(docs.mapInPandas(rare_words, PACKED), parts, rare_settled, PACKED)
    replies = settled.where("kind = 0").union(settled.where("kind = 2").select("blob").mapInPandas(heavy_settled, PACKED)).union(rare)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _by_key(replies, parts, summed, schema)


def score(
    docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, *,
    head_share: float = 2e-6, gram_share: float | None = None, heavy_share: float = 1e-4, group_share: float = 0.02, divergence: float = 6.0, prior: float = 0.5, follower: int = 2,
) -> DataFrame:
    """Log10 probability of every whole text of ``docs``, with unigram figures beside it.

    The model learns from the rows where ``learns`` is true. Tokens are the words and one end for each text.
    ``group_col`` names the groups; those with less than ``group_share`` of the training rows, and nulls, are
    one group, or part of the largest one where together they have less. A null or empty text is its end
    alone; texts of any length are scored whole; an empty table gives no rows; without training rows every
    word is unknown; repeated rows and null ids are scored row by row; other columns are ignored.

    Frequent symbols number at most 1 / head_share, heavy contexts of two at most 1 / heavy_share; both are broadcast.
    Occurrences of a word that is not frequent, and of a context of two that is not heavy, are gathered in one group, which
    is at most that share of the corpus. With ``gram_share``, contexts that end in a frequent word are smaller: they
    keep frequent followers with that share of all tokens, and a context of two is one whose pair and whose last pair are kept.
    """
    spark = docs.sparkSession
    if head_share < 2.0**-19:
        raise ValueError("head_share: ids of frequent symbols have 20 bits")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.lit(None).cast("string") if group_col is None else F.col(group_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), name.alias("name"), F.coalesce(learns, F.lit(False)).alias("learns")
    )
    sizes = rows.where("learns").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("name").isNotNull() & (F.col("n") >= group_share * total)).orderBy(F.desc("n"), "name").collect()
    rest = total - sum(r["n"] for r in large)
    group = F.lit(len(large) if not large or rest >= group_share * total else 0)
    groups = len(large) + (not large or rest >= group_share * total)
    for i, r in enumerate(large):
        group = F.when(F.col("name") == r["name"], i).otherwise(group)
    rows = rows.select("doc_id", "text", F.when(F.col("learns"), group).otherwise(-1).cast("int").alias("group"))
    model = _learn(
        rows.where(F.col("group") >= 0).select("text", "group"), groups, parts, head_share, gram_share, heavy_share, follower,
        divergence=divergence, prior=prior,
    )
    return _scored(rows, spark.sparkContext.broadcast(model), parts).withColumnRenamed("doc_id", id_col)
