"""Packing of documents into fixed windows by order-preserving dynamic programming.

Tokens of the documents form one stream in row order. Windows are cut where the sum of padding and
truncation penalties is least: a cut at a document's end costs nothing, one at a sentence's end a
little, one inside a sentence more. The best predecessor of a cut is the front of a monotone queue
over the last ``window`` tokens; windows whose length is a listed power of two need no padding and
are looked up one by one.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from evspark.llm.common import ID_MASK, SENTENCE_END, chunk_tokens, default_tokenizer, id_and_text, to_id

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def choose_cuts(
    positions: list[int], penalties: list[float], window: int, exact: tuple[int, ...]
) -> list[int]:
    """Cut positions (last included) of least cost; ``positions`` rise from 0 by at most ``window``."""
    n = len(positions)
    cost, back = [0.0] * n, [0] * n
    exact = tuple(e for e in exact if e < window)  # the queue's front gives a full window without padding
    span = max(exact, default=0)
    place = [-1] * (span + positions[-1] + 1)  # the candidate at each position, shifted by span
    for i, p in enumerate(positions):
        place[p + span] = i
    shifts = [span - e for e in exact]
    queue: deque[tuple[int, float, int]] = deque([(0, 0.0, 0)])
    for j in range(1, n):
        p = positions[j]
        low = p - window
        while queue[0][0] < low:
            queue.popleft()
        _, best, i = queue[0]
        best += window - p
        for e in shifts:
            k = place[p + e]
            if k >= 0 and cost[k] < best:
                best, i = cost[k], k
        best += penalties[j]
        cost[j], back[j] = best, i
        value = best + p
        while queue and queue[-1][1] >= value:
            queue.pop()
        queue.append((p, value, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(positions[j])
        j = back[j]
    return cuts[::-1]


class _Packer:
    """Packs a stream of documents; holds the open window and at most one block of tokens."""

    def __init__(self, window, exact, sentence_penalty, split_penalty, stride, block):
        self.window, self.exact, self.block, self.stride = window, exact, block, stride
        self.sentence_penalty, self.split_penalty = sentence_penalty, split_penalty
        self.ids: list[np.ndarray] = []  # flagged ids still to be packed
        self.docs: list[tuple[object, int, int]] = []  # (doc_id, ids already packed, all ids)
        self.held, self.sequence = 0, 0

    def add(self, doc_id, flagged: np.ndarray) -> pd.DataFrame | None:
        self.ids.append(flagged)
        self.docs.append((doc_id, 0, len(flagged)))
        self.held += len(flagged)
        return self.flush(False) if self.held >= self.block else None

    def flush(self, last: bool) -> pd.DataFrame | None:
        if not self.held:
            return None
        flagged = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        sentence = np.flatnonzero(flagged & SENTENCE_END) + 1
        penalty = np.full(len(flagged) + 1, self.split_penalty, np.float32)
        known = np.zeros(len(flagged) + 1, bool)
        known[0] = True
        known[sentence] = True
        penalty[sentence] = self.sentence_penalty
        known[ends] = True
        penalty[ends] = 0
        at = np.flatnonzero(known)
        gaps = np.diff(at)
        for i in np.flatnonzero(gaps > self.stride):  # long sentences may be cut inside
            known[at[i] : at[i + 1] : self.stride] = True
        at = np.flatnonzero(known)
        cuts = choose_cuts(at.tolist(), penalty[at].tolist(), self.window, self.exact)
        if not last and len(cuts) > 1:
            cuts.pop()  # the open window goes on with the next block
        elif not last:
            return None
        ids = flagged & ID_MASK
        cuts = np.array([0, *cuts])
        edges = np.unique(np.concatenate([cuts, ends[ends <= cuts[-1]]]))
        begin, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, begin, "right")
        window = np.searchsorted(cuts, begin, "right") - 1
        first = np.concatenate([[0], ends[:-1]])
        raw = ids.astype("<u4").tobytes()
        blobs = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        packed = np.array([d[1] for d in self.docs])
        out = pd.DataFrame(
            {
                "doc_id": pd.array([self.docs[d][0] for d in doc], "Int64"),
                "start": packed[doc] + begin - first[doc],
                "length": stop - begin,
                "ids_crc32": [zlib.crc32(b) for b in blobs],
                "doc_tokens": np.array([d[2] for d in self.docs])[doc],
                "sequence_id": window + self.sequence,
                "offset": begin - cuts[window],
                "ids": blobs,
            }
        )
        self.sequence += len(cuts) - 1
        done = int(np.searchsorted(ends, cuts[-1], "right"))
        rest_ids, rest_docs = self.ids[done:], self.docs[done:]
        if rest_ids:
            used = int(cuts[-1] - first[done])
            rest_ids[0] = rest_ids[0][used:]
            d = rest_docs[0]
            rest_docs[0] = (d[0], d[1] + used, d[2])
        self.ids, self.docs = rest_ids, rest_docs
        self.held = int(sum(len(x) for x in rest_ids))
        return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str | None = None,
    end_id: int = 1,
    window: int = 2048,
    exact: tuple[int, ...] = (2048, 1024, 512, 256),
    sentence_penalty: float = 4.0,
    split_penalty: float = 24.0,
    stride: int = 64,
    block: int = 1 << 20,
    known_chunks: int = 800_000,
) -> DataFrame:
    """Pack every document, in row order within each input partition, into windows of ``window`` ids.

    Returns one row per piece with its ids (little-endian uint32) and its place: ``sequence_id`` and
    the gapless ``offset`` there. Null and empty texts become the single ``end_id``; texts of any
    length are cut, repeated rows are packed once each, a null id is kept; an empty table gives no
    rows; other columns are ignored. No row moves between partitions: a partition is solved in blocks
    of about ``block`` tokens, the open window of a block being carried into the next one. A worker keeps the
    ids of at most twice ``known_chunks`` chunks.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = chunk_tokens(path, known_chunks)
        packer = _Packer(window, exact, sentence_penalty, split_penalty, stride, block)
        base = TaskContext.get().partitionId() << 36
        end = np.array([end_id], np.uint32) | SENTENCE_END
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                flagged = cache.flagged([t or "" for t in part["text"]])
                for doc_id, ids in zip(part["doc_id"], flagged, strict=True):
                    out = packer.add(to_id(doc_id), np.concatenate([ids, end]))
                    if out is not None:
                        yield out.assign(sequence_id=out["sequence_id"] + base)
        while (out := packer.flush(True)) is not None:
            yield out.assign(sequence_id=out["sequence_id"] + base)

    return id_and_text(docs, id_col, text_col).mapInPandas(run, SCHEMA)
