"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Every string of ``span`` bytes has an anchor, the place within it whose ``gram`` bytes hash least, so equal
strings have equal anchors. The strings of a document fall into segments of one anchor each. Only
anchors that more than one document has are looked at further: whole segments that are equal settle
each other by hash (40 bits of the anchor's, 40 of the segment's, its length and the anchor's place in it; these
bytes are not compared); the others are fetched from the texts, and around each anchor their suffixes are
sorted by mergesort. Two suffixes are compared by the longest common extension, which binary search finds
on prefix polynomial hashes; strings that come out equal are verified byte by byte. Segments of an anchor
that very many segments have are cut into their single strings, which go on by hashes of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import column, with_columns, written
from evspark.llm.jaccard import mix

#: Odd base of the polynomial hashes, its inverse modulo 2**64, and the id that stands for null.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NULL_ID = (1 << 63) - 1
HALF, KEPT = np.uint64(32), np.uint64(0xFFFFFFFFFF000000)  # the bits of hashes that are kept
MOST = 1_000_000  # bytes of text whose suffixes are sorted at once
PLACE = np.uint64(28)  # low bits of a rank that hold the place in the text


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefixes:
    """Polynomial hash of any part of a byte array in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(INVERSE, n), out=self.sums[1:])
        self.up = _powers(BASE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]


def segments(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first window, windows) for runs of windows with one anchor."""
    n = len(data) - span + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < gram:  # hashes of 1, 2, 4 ... gram bytes
        step = min(size, gram - size)
        h = h[: len(h) - step] * np.uint64(pow(BASE, size, 1 << 64)) + h[step:]
        size += step
    h = mix(h)
    rank = ((h >> PLACE) << PLACE) | np.arange(len(h), dtype=np.uint64)
    width, size, least = span - gram + 1, 1, rank
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    place = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, n))
    return h[place[first]], place[first], first, count


PACKED = "bucket int, blob binary"
_ROW = np.dtype([("a", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("count", "u1"), ("left", "u1")])


def _pack(rows: np.ndarray) -> bytes:
    """The columns one after another, ids as steps: what a shuffle compresses well."""
    step = np.diff(rows["doc"], prepend=rows["doc"][:1])
    wide = bool(len(step) and (np.abs(step).max() >= 1 << 31))
    head = np.array([len(rows), wide, rows["doc"][0] if len(rows) else 0], "<i8")
    high = [_planes(rows[c])[3:].tobytes() for c in ("a", "g")]  # 40 bits
    steps = _planes(step.astype("<i8" if wide else "<i4")).tobytes()
    rest = [_planes(rows[c]).tobytes() for c in ("row", "start", "count", "left")]
    return b"".join([head.tobytes(), *high, zstd.compress(steps + b"".join(rest), 1)])


def _planes(column: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones, and so on: zeros come together."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(-1, column.dtype.itemsize).T


def _unpack(blob: bytes) -> np.ndarray:
    n, wide, first = np.frombuffer(blob, "<i8", 3).tolist()
    out, at = np.zeros(n, _ROW), 0
    blob = blob[24 : 24 + 10 * n] + zstd.decompress(blob[24 + 10 * n :])
    for name, kind, low in (("a", "<u8", 3), ("g", "<u8", 3), ("doc", "<i8" if wide else "<i4", 0), ("row", "<i8", 0), ("start", "<i4", 0), ("count", "u1", 0), ("left", "u1", 0)):
        size = np.dtype(kind).itemsize
        planes = np.zeros((size, n), np.uint8)
        planes[low:] = np.frombuffer(blob, np.uint8, (size - low) * n, at).reshape(-1, n)
        at += (size - low) * int(n)
        part = np.ascontiguousarray(planes.T).view(kind)[:, 0]
        out[name] = first + np.cumsum(part, dtype=np.int64) if name == "doc" else part
    return out


def _settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows still open, rows whose whole segment stands in a smaller document).

    Of equal segments those in the least document stay open.
    """
    kind = (rows["count"].astype(np.uint64) << np.uint64(8)) | rows["left"]
    rows = rows[np.argsort((rows["a"] >> HALF << HALF) ^ mix(rows["g"] ^ kind) >> HALF)]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["g"][1:] != rows["g"][:-1])
    new[1:] |= (rows["count"][1:] != rows["count"][:-1]) | (rows["left"][1:] != rows["left"][:-1])
    run = np.cumsum(new) - 1
    least = np.minimum.reduceat(rows["doc"], np.flatnonzero(new))[run] if len(rows) else rows["doc"]
    later = rows["doc"] > least
    return rows[~later], rows[later]


def _content(p: Prefixes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of a range, by which a row of its id is known to hold it."""
    return mix(p.of(start, end)) & KEPT


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start and end in one number that sorts as both."""
    return (start.astype(np.int64) << 32) | end.astype(np.int64)


def _held(data: bytes, place: list[int], content: list[int]) -> np.ndarray:
    """Which of the ranges stand in these bytes."""
    place, content = np.array(place, np.int64), np.array(content, np.int64)
    start, end = place >> 32, place & 0xFFFFFFFF
    p = Prefixes(np.frombuffer(data, np.uint8))
    ok = end <= len(data)
    ok[ok] = _content(p, start[ok], end[ok]) == content[ok].view(np.uint64)
    return ok


def _spans(rows: np.ndarray, span: int, left: np.ndarray, anchor: np.ndarray) -> pd.DataFrame:
    """Bytes of the whole segments and their hash; left is -1 where they are settled."""
    place = _ranges(rows["start"], rows["start"] + rows["count"].astype(np.int32) + span - 1)
    return pd.DataFrame({"doc": rows["doc"], "row": rows["row"], "place": place, "content": rows["g"].view(np.int64), "mark": _mark(left, anchor)})


def _mark(left: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The anchor's kept bits and, in the low ones it has free, left, and 128 for a hot anchor; -1 for settled ranges."""
    return np.where(left < 0, -1, anchor.view(np.int64) | left)


def _anchored(docs: DataFrame, span: int, gram: int, buckets: int, piece: int) -> DataFrame:
    """(bucket, blob) of segments, and with bucket -1 spans that are settled within a batch."""

    shift = np.uint64(64 - (buckets - 1).bit_length())

    def packed(found: list[np.ndarray]) -> pd.DataFrame:
        open_, done = _settle(np.concatenate(found))
        bucket = (open_["a"] >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(open_), np.int64)
        by = np.lexsort((open_["start"], open_["row"], open_["doc"], bucket))
        open_, bucket = open_[by], bucket[by]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        stop = np.append(edge[1:], len(bucket))
        out = [(int(bucket[x]), _pack(open_[x:y])) for x, y in zip(edge, stop, strict=True) if y > x]
        if len(done):
            out.append((-1, _pack(done)))
        return pd.DataFrame(out, columns=["bucket", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for pdf in batches:
            for doc, row, text in zip(pdf["doc"].to_numpy(), pdf["row"].to_numpy(), pdf["text"], strict=True):
                whole = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                for lo in range(0, len(whole) - span + 1, piece):
                    data = whole[lo : lo + piece + span - 1]
                    a, place, first, count = segments(data, span, gram)
                    rows = np.zeros(len(a), _ROW)
                    rows["a"], rows["doc"], rows["row"] = a & KEPT, doc, row
                    rows["start"], rows["count"], rows["left"] = first + lo, count, place - first
                    rows["g"] = mix(Prefixes(data).of(first, first + count + span - 1)) & KEPT
                    found.append(rows)
                    held += len(a)
                    if held >= 400_000:
                        yield packed(found)
                        found, held = [], 0
        if found:
            yield packed(found)

    return docs.mapInPandas(run, PACKED)


def _by_bucket(rows: DataFrame, work, schema: str, parts: int) -> DataFrame:
    """work(bucket's blobs) for each bucket; a partition holds its buckets one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        now = None
        for pdf in batches:
            for bucket, blob in zip(pdf["bucket"], pdf["blob"], strict=True):
                if bucket != now and held:
                    yield from work(held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from work(held)

    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(run, schema)


def _shared(span: int, hot_rows: int):
    """Blobs of a bucket -> (doc, open rows) for anchors of several documents, and settled spans."""

    def work(blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        open_, done = _settle(np.concatenate([_unpack(b) for b in blobs]))
        open_ = open_[np.argsort(open_["a"], kind="stable")]
        a = open_["a"]
        new = np.concatenate([[True], a[1:] != a[:-1]])
        run = np.cumsum(new) - 1
        low = np.minimum.reduceat(open_["doc"], np.flatnonzero(new))[run]
        high = np.maximum.reduceat(open_["doc"], np.flatnonzero(new))[run]
        some = low < high
        hot = np.where(np.bincount(run)[run] > hot_rows, 128, 0)[some]
        rows = open_[some]
        settled = np.full(len(done), -1)
        yield _spans(done, span, settled, done["a"].copy())
        yield _spans(rows, span, rows["left"] | hot, rows["a"].copy())

    return work


def common_extension(p: Prefixes, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i and j, up to ``most``."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = p.of(i, i + mid) == p.of(j, j + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(data: np.ndarray, p: Prefixes, at: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at`` (of given lengths) by group, then bytes; bottom-up mergesort.

    ``group`` is sorted. In each round every element finds its rank in the sibling run by binary search.
    """
    n = len(at)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    base = np.repeat(first, size)
    total = np.repeat(size, size)
    width = 1
    while n and width < size.max():
        live = np.flatnonzero(total > width)
        k = live - base[live]  # place within the group
        run = k // width
        mine, is_left = run * width, run % 2 == 0
        other = np.where(is_left, mine + width, mine - width)
        low = np.minimum(other, total[live])
        high = np.minimum(other + width, total[live])
        begin, me = low.copy(), order[live]
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, begin - begin)
            peer = order[base[live] + np.minimum(mid, total[live] - 1)]
            x, y = at[peer], at[me]
            most = np.minimum(length[peer], length[me])
            same = common_extension(p, x, y, most)
            ended = same == most
            a = data[np.minimum(x + same, len(data) - 1)]
            b = data[np.minimum(y + same, len(data) - 1)]
            less = np.where(ended, length[peer] < length[me], a < b)
            equal = ended & (length[peer] == length[me])
            before = less | (equal & ~is_left)  # equal ones of the left run come first
            low = np.where(open_ & before, mid + 1, low)
            high = np.where(open_ & ~before, mid, high)
        rank = low - begin
        start = np.where(is_left, mine, other)
        fresh = order.copy()
        fresh[base[live] + start + (k - mine) + rank] = me
        order = fresh
        width *= 2
    return order


def repeated_windows(
    data: np.ndarray, base: np.ndarray, count: np.ndarray, left: np.ndarray, doc: np.ndarray, group: np.ndarray, span: int, gram: int
) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) for windows that also stand in a segment of a smaller document.

    Segments of ``data`` begin at ``base``, hold ``count`` windows and their anchor ``left`` bytes on;
    ``group`` (sorted) tells anchors apart.
    """
    p = Prefixes(data)
    at, length = base + left, count - 1 + span - left
    order = suffix_sort(data, p, at, length, group)
    at, length, count, left, doc, group = at[order], length[order], count[order], left[order], doc[order], group[order]
    near = np.zeros(len(at), np.int64)
    if len(at) > 1:
        near[1:] = common_extension(p, at[:-1], at[1:], np.minimum(length[:-1], length[1:]))
        near[1:][group[1:] != group[:-1]] = -1
    if len(at):
        near[0] = -1
    segs, wins = [], []
    for right in range(gram, span + 1):
        before = span - right
        own = np.flatnonzero((length >= right) & (left >= before))
        if len(own) < 2:
            continue
        klass = np.cumsum(near < right)[own]
        key = p.of(at[own] - before, at[own])
        by = np.lexsort((doc[own], key, klass))
        own, klass, key = own[by], klass[by], key[by]
        new = np.concatenate([[True], (klass[1:] != klass[:-1]) | (key[1:] != key[:-1])])
        lead = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.flatnonzero(doc[own] > doc[lead])
        if not len(later):
            continue
        mine, least = own[later], lead[later]
        reach = np.arange(span)
        ok = np.ones(len(mine), bool)
        for lo in range(0, len(mine), 20_000):
            x, y = (at[mine[lo : lo + 20_000]] - before)[:, None] + reach, (at[least[lo : lo + 20_000]] - before)[:, None] + reach
            ok[lo : lo + 20_000] = (data[x] == data[y]).all(1)
        if not ok.all():  # hashes collided: compare the bytes themselves
            start = at[own] - before
            whole = np.ascontiguousarray(data[start[:, None] + reach]).view(f"V{span}")[:, 0]
            _, code = np.unique(whole, return_inverse=True)
            low = np.full(code.max() + 1, NULL_ID)
            np.minimum.at(low, code, doc[own])
            mine = own[doc[own] > low[code]]
        else:
            mine = mine[ok]
        segs.append(order[mine])
        wins.append(left[mine] - before)
    if not segs:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(segs), np.concatenate(wins)


_OPEN = np.dtype([("a", "<i8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("count", "<i4"), ("left", "<i4")])


_RANGE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("place", "<i8"), ("content", "<i8")])


def _single(table: np.ndarray, base: np.ndarray, data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strings, their places in data, ranges): segments of hot anchors as single strings with anchors of their own.

    Strings that stand in a smaller document among these, byte by byte, are ranges already; of equal ones
    that of the least document stays.
    """
    n = table["count"].astype(np.int64)
    seg = np.repeat(np.arange(len(table)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = base[seg] + step
    p = Prefixes(data)
    h = mix(p.of(at, at + span)) & KEPT
    by = np.lexsort((table["doc"][seg], h))
    seg, step, at, h = seg[by], step[by], at[by], h[by]
    doc = table["doc"][seg]
    lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1]
    later = doc > doc[lead]
    reach = np.arange(span)
    for lo in range(0, len(at), 20_000):  # hashes may collide: then both go on
        x, y = at[lo : lo + 20_000, None] + reach, at[lead[lo : lo + 20_000], None] + reach
        later[lo : lo + 20_000] &= (data[x] == data[y]).all(1)
    out = np.zeros(len(at), _OPEN)
    out["a"], out["doc"], out["row"] = h.view(np.int64), doc, table["row"][seg]
    out["start"], out["count"] = table["start"][seg] + step, 1
    done = out[later]
    ranges = np.zeros(len(done), _RANGE)
    ranges["doc"], ranges["row"], ranges["place"] = done["doc"], done["row"], _ranges(done["start"], done["start"] + np.int64(span))
    ranges["content"] = _content(p, at[later], at[later] + span).view(np.int64)
    return out[~later], at[~later], ranges


def _fetched(joined: DataFrame, text_col: str, span: int, buckets: int) -> DataFrame:
    """(bucket, blob) of open segments with their bytes; and with buckets below 0 ranges that are settled here."""
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def dealt(table: np.ndarray, at: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, bytes]]:
        bucket = (table["a"].view(np.uint64) >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(table), np.int64)
        by = np.argsort(bucket, kind="stable")
        table, bucket, at = table[by], bucket[by], at[by]
        size = table["count"].astype(np.int64) - 1 + span
        edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            n = size[x:y]
            own = data[np.repeat(at[x:y] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            yield int(bucket[x]), b"o" + np.array([y - x], "<i8").tobytes() + zstd.compress(table[x:y].tobytes() + own.tobytes(), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                rows, hot, bytes_ = [], [], []
                part = pdf.iloc[lo : lo + 1000]
                for doc, row, text, open_ in zip(part["__doc"], part["__row"], part[text_col], part["__open"], strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    held = _held(data, [x["place"] for x in open_], [x["content"] for x in open_])
                    for x, ok in zip(open_, held.tolist(), strict=True):
                        if ok:  # else it is a range of another row with this id
                            start, end = x["place"] >> 32, x["place"] & 0xFFFFFFFF
                            rows.append((x["mark"] & ~0xFF, doc, row, start, end - start - span + 1, x["mark"] & 0x7F))
                            hot.append(bool(x["mark"] & 0x80))
                            bytes_.append(data[start:end])
                if not rows:
                    continue
                table, hot, data = np.array(rows, _OPEN), np.array(hot), np.frombuffer(b"".join(bytes_), np.uint8)
                size = table["count"].astype(np.int64) - 1 + span
                base = np.cumsum(size) - size
                out = list(dealt(table[~hot], base[~hot], data))
                if hot.any():
                    single, at, ranges = _single(table[hot], base[hot], data, span)
                    out += dealt(single, at, data)
                    out.append((-1 - zlib.crc32(ranges.tobytes()) % 997, b"d" + ranges.tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "blob"])

    return joined.mapInPandas(run, PACKED)


def _compared(span: int, gram: int):
    def work(blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        if blobs[0][:1] == b"d":
            for b in blobs:
                ranges = np.frombuffer(b, _RANGE, -1, 1)
                yield pd.DataFrame({c: ranges[c] for c in _RANGE.names})
            return
        tables, datas = [], []
        for b in blobs:
            n, b = int(np.frombuffer(b, "<i8", 1, 1)[0]), zstd.decompress(b[9:])
            tables.append(np.frombuffer(b, _OPEN, n))
            datas.append(np.frombuffer(b, np.uint8, -1, n * _OPEN.itemsize))
        t, data = np.concatenate(tables), np.concatenate(datas)
        size = t["count"].astype(np.int64) - 1 + span
        base = np.cumsum(size) - size
        order = np.argsort(t["a"], kind="stable")
        t, base, size = t[order], base[order], size[order]
        first = np.flatnonzero(np.concatenate([[True], t["a"][1:] != t["a"][:-1]]))
        ends = np.append(np.cumsum(size), 0)
        cuts = [0]
        for f in first[1:].tolist():  # whole anchors, about a megabyte of text at a time
            if ends[f - 1] - (ends[cuts[-1] - 1] if cuts[-1] else 0) >= MOST:
                cuts.append(f)
        for lo, hi in zip(cuts, [*cuts[1:], len(t)], strict=True):
            own, n = t[lo:hi], size[lo:hi]
            at = np.cumsum(n) - n
            part = data[np.repeat(base[lo:hi] - at, n) + np.arange(int(n.sum()))]
            seg, win = repeated_windows(part, at, own["count"].astype(np.int64), own["left"].astype(np.int64), own["doc"], own["a"], span, gram)
            if not len(seg):
                continue
            by = np.lexsort((win, seg))
            seg, win = seg[by], win[by]
            new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (win[1:] > win[:-1] + span)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(seg)) - 1
            seg, win, end = seg[first], win[first], win[last] + span
            content = _content(Prefixes(part), at[seg] + win, at[seg] + end)
            start = own["start"][seg].astype(np.int64)
            place = _ranges(start + win, start + end)
            yield pd.DataFrame({"doc": own["doc"][seg], "row": own["row"][seg], "place": place, "content": content.view(np.int64)})

    return work


def repeated_spans(keyed: DataFrame, text_col: str, *, span: int, gram: int, hot_rows: int, piece: int) -> DataFrame:
    """(__doc, __row, __spans): the byte ranges [start, end) to remove, not yet merged; ``keyed`` has __doc and __row.

    Documents are compared by __doc, but ranges belong to (__doc, __row) and are marked by a hash of their
    bytes, so that a range is never taken for one of another row with the same id. Both here and where the
    ranges are applied, all of ``keyed`` is joined by these two, so that its texts are shuffled once.
    """
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts
    key = [F.col("doc").alias("__doc"), F.col("row").alias("__row")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = _anchored(keyed.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), text.alias("text")).where(F.octet_length("text") >= span), span, gram, buckets, piece)
    settled_or_open = _by_bucket(_spread(packed), _any(span, hot_rows), "doc long, row long, place long, content long, mark long", parts)
    found = written(settled_or_open)
    done = found.where(F.col("mark") == -1).select("doc", "row", "place", "content")
    # equal rows of one id have equal segments: a set keeps them once
    open_ = found.where(F.col("mark") != -1).groupBy(*key).agg(F.collect_set(F.struct("place", "content", "mark")).alias("__open"))
    fetched = _fetched(keyed.join(open_, ["__doc", "__row"]), text_col, span, buckets)
    compared = _by_bucket(fetched, _compared(span, gram), "doc long, row long, place long, content long", parts)
    return done.union(compared).groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("place", "content"))).alias("__spans"))


def _spread(packed: DataFrame) -> DataFrame:
    """Settled spans (bucket -1) are dealt out at random among negative buckets."""
    return packed.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("blob"), F.lit(997))).otherwise(F.col("bucket")).cast("int")).withColumn(
        "blob", F.concat(F.when(F.col("bucket") < 0, F.lit(b"d")).otherwise(F.lit(b"o")), F.col("blob"))
    )


def _any(span: int, hot_rows: int):
    shared = _shared(span, hot_rows)

    def work(blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        if blobs[0][:1] == b"o":
            yield from shared([b[1:] for b in blobs])
            return
        for b in blobs:
            rows = _unpack(b[1:])
            yield _spans(rows, span, np.full(len(rows), -1), rows["a"].copy())

    return work


def _cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs)."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    held = _held(text, [s["place"] for s in spans], [s["content"] for s in spans])
    for s, ok in zip(spans, held.tolist(), strict=True):
        if not ok:  # a range of another row with this id
            continue
        a, b = s["place"] >> 32, s["place"] & 0xFFFFFFFF
        if a > end:
            kept.append(text[max(at, 0) : a])
            runs += 1
        if b > at:
            removed += b - max(a, at)
            at = b
        end = max(end, b)
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, span: int = 50, gram: int = 24, hot_rows: int = 4096, piece: int = 1 << 26, kept: str | None = "bytes"
) -> DataFrame:
    """The documents with a struct ``removal`` of n_bytes, n_removed, n_spans, kept_sha256 and what ``kept`` asks for:
    kept (the bytes), kept_text (without characters of which only a part was kept), or neither for None.

    Each byte covered by a string of ``span`` bytes that also starts in a document with a smaller id is
    removed. Null and empty texts keep nothing and lose nothing; a null id counts as larger than all
    others; rows of one id, or without one, never cut each other, as no id is smaller, and each loses only
    ranges whose bytes it holds; an empty table gives no rows; other columns are carried along, but for one named
    removal, which is replaced; names that begin with two underscores are reserved; texts are read whole, ``piece``
    bytes at a time. An anchor of more than ``hot_rows`` unsettled segments goes on as single strings, so that
    no task holds more of it than equal strings, one for each batch of texts.
    """

    fields = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    fields |= {"bytes": {"kept": "binary"}, "text": {"kept_text": "string"}, None: {}}[kept]

    def removal(part):
        import pyarrow as pa

        rows = []
        for text, ranges in zip(column(part, "__text").to_pylist(), column(part, "__spans").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            rest, removed, runs = _cut(data, ranges) if ranges is not None else (data, 0, 0)
            row = [len(data), removed, runs, hashlib.sha256(rest).hexdigest()]
            rows.append(row + ([rest] if kept == "bytes" else [rest.decode("utf-8", "ignore")] if kept else []))
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        arrays = [pa.array([r[i] for r in rows], kinds[kind]) for i, kind in enumerate(fields.values())]
        return {"removal": pa.StructArray.from_arrays(arrays, list(fields))}

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn("__row", F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long")))
    joined = keyed.join(repeated_spans(keyed, text_col, span=span, gram=gram, hot_rows=hot_rows, piece=piece), ["__doc", "__row"], "left")
    return with_columns(joined.withColumn("__text", text), removal, f"removal struct<{','.join(map(':'.join, fields.items()))}>").drop("__doc", "__row", "__spans", "__text")


def kept_text(kept: str = "removal.kept") -> Column:
    """The kept bytes as text; a character of which only a part was kept goes."""

    @F.pandas_udf("string")
    def decoded(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return decoded(F.col(kept))
