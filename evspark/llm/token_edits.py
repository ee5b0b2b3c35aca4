"""Token counts that survive edits: a sum tree over runs of pre-tokens, kept for each document.

``count_trees`` encodes every text once and writes its tree as columns: the lengths of the leaves in
code points and the sums of tokens in heap order. ``apply_edits`` takes such rows and edits, encodes
the touched leaves again, mends the sums above them and returns the new text and tree, so that counts
after any further edit come from the kept sums alone.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import ChunkTokens, checkpoint, chunk_tokens, column, default_tokenizer, split_chunks, with_columns

#: Fixed patterns of personal data, what replaces them, and characters of which every match has one.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>", "@"),
    (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", "<ip>", "."),
    (r"(?<![\w+])\+?\d[\d ()-]{7,}\d(?!\w)", "<phone>", None),
)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
TREE = "n_chunks long, leaf_chars array<int>, sums array<int>"
EDITS = "array<struct<start:int,stop:int,new:string>>"


class CountTree:
    """Sums of one text's tokens over a binary tree of leaves.

    A leaf is a run of white-space delimited chunks with the white space after each. ``sums`` is a heap:
    entry 1 is the whole, the last half are the leaves.
    """

    def __init__(self, chars: np.ndarray, sums: np.ndarray):
        self.chars, self.sums = chars, sums

    @classmethod
    def of_chunks(cls, chunks: list[str], sizes: np.ndarray, leaf: int) -> CountTree:
        """From the chunks of a text and the number of tokens of each."""
        chars = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1  # the blank after a chunk
        chars -= np.fromiter([c[-1:] == "\n" for c in chunks], bool, len(chunks))  # a line end stands in it
        chars[-1] -= chunks[-1][-1:] != "\n"
        at = np.arange(0, len(chunks), leaf)
        size = 1 << (len(at) - 1).bit_length()
        sums = np.zeros(2 * size, np.int64)
        sums[size : size + len(at)] = np.add.reduceat(sizes, at)
        level = size
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2
        return cls(np.add.reduceat(chars, at), sums)

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def _set(self, leaf: int, chars: int, count: int) -> None:
        i = leaf + len(self.sums) // 2
        change = count - self.sums[i]
        self.chars[leaf] = chars
        while i:
            self.sums[i] += change
            i //= 2

    def apply(self, text: str, edits: list[tuple[int, int, str]], cache: ChunkTokens) -> tuple[str, int]:
        """(text after the edits, chunks encoded again).

        An edit replaces [start, stop) of the text before all edits; edits neither overlap nor come twice.
        The leaves that an edit touches are encoded again as one, with the neighbour on a side where it reaches
        their edge; edits that touch common leaves go together.
        """
        ends = np.cumsum(self.chars)
        begins, last = ends - self.chars, int(np.flatnonzero(self.chars)[-1]) if self.chars.any() else 0
        regions: list[tuple[int, int, list]] = []
        for start, stop, new in sorted(edits):
            a = min(int(np.searchsorted(ends, start, "right")), last)
            b = max(a, int(np.searchsorted(begins, stop, "left")) - 1)
            a -= bool(a and start == begins[a])
            b += bool(b < last and stop == ends[b])
            while a and not self.chars[a]:  # leaves that earlier edits emptied
                a -= 1
            while b < last and not self.chars[b]:
                b += 1
            if regions and a <= regions[-1][1]:
                a0, b0, group = regions.pop()
                a, b, group = min(a, a0), max(b, b0), [*group, (start, stop, new)]
                regions.append((a, b, group))
            else:
                regions.append((a, b, [(start, stop, new)]))
        pieces, at, again = [], 0, 0
        for a, b, group in regions:
            pieces.append(text[at : begins[a]])
            fresh, at = [], int(begins[a])
            for start, stop, new in group:
                fresh += [text[at:start], new]
                at = max(at, stop)
            fresh.append(text[at : ends[b]])
            at = int(ends[b])
            part = "".join(fresh)
            # a leaf's last blank belongs to it, so what follows it is a chunk of the next leaf
            chunks = split_chunks(part)
            ids = cache.lookup(chunks)
            again += len(chunks)
            for i in range(a + 1, b + 1):
                self._set(i, 0, 0)
            self._set(a, len(part), sum([len(ids[c]) for c in chunks]) // 4)
            pieces.append(part)
        pieces.append(text[at:])
        return "".join(pieces), again


def _addresses(text: str):
    """(start, stop) of e-mail addresses as the first rule finds them, outwards from each "@", in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _spans(pattern: str, text: str):
    return _addresses(text) if pattern == REDACTIONS[0][0] else (m.span() for m in re.finditer(pattern, text))


def redaction_edits(text: str, rules=REDACTIONS) -> list[tuple[int, int, str]]:
    """Edits for each match of the rules; where two overlap, the earlier one, then the longer one, stays."""
    found = [(*span, new) for pattern, new, has in rules if not has or any(c in text for c in has) for span in _spans(pattern, text)]
    kept: list[tuple[int, int, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def redactions(text: Column, rules=REDACTIONS) -> Column:
    """The edits that redact a text, as an array of (start, stop, new); none for null."""

    @F.pandas_udf(EDITS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "stop": b, "new": n} for a, b, n in redaction_edits(t or "", rules)])

    return found(text.cast("string"))


def count_trees(docs: DataFrame, text_col: str = "text", *, tokenizer: str | None = None, leaf: int = 16) -> DataFrame:
    """The rows with the kept tree of their text: n_chunks, leaf_chars and sums.

    The number of tokens of the whole text is ``sums[1]``. Null and empty texts have one empty leaf; texts of any
    length are encoded whole; repeated rows and null ids have a tree each; an empty table gives no rows;
    other columns are carried along, but for those three, which are replaced.
    """
    path = tokenizer or default_tokenizer()

    def work(part):
        import pyarrow as pa

        cache = chunk_tokens(path)
        split = [split_chunks(t or "") for t in column(part, text_col).to_pylist()]
        ids = cache.lookup([c for chunks in split for c in chunks])
        trees = [CountTree.of_chunks(c, np.fromiter([len(ids[x]) for x in c], np.int64, len(c)) // 4, leaf) for c in split]
        return {
            "n_chunks": pa.array([len(c) for c in split], pa.int64()),
            "leaf_chars": pa.array([t.chars.astype(np.int32) for t in trees], pa.list_(pa.int32())),
            "sums": pa.array([t.sums.astype(np.int32) for t in trees], pa.list_(pa.int32())),
        }

    return with_columns(docs, work, TREE)


def apply_edits(trees: DataFrame, edits_col: str = "edits", text_col: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """Rows of ``count_trees`` after the edits of a column: text and tree are the new ones.

    ``edits_col`` holds an array of (start, stop, new), places counted in code points of the text as it is; edits
    may not overlap. ``n_reencoded`` counts the chunks that were encoded again, ``n_chunks`` those before the
    first edit. Rows with no or null edits pass unchanged; a null text is empty once it is edited; only touched
    leaves are read and encoded; other columns are carried along.
    """
    path = tokenizer or default_tokenizer()

    def work(part):
        import pyarrow as pa

        cache = chunk_tokens(path)
        texts, edits = column(part, text_col), column(part, edits_col).to_pylist()
        chars, sums, again = column(part, "leaf_chars"), column(part, "sums"), np.zeros(len(edits), np.int64)
        changed = [i for i, e in enumerate(edits) if e]
        if changed:
            texts, chars, sums = texts.to_pylist(), chars.to_pylist(), sums.to_pylist()
            for i in changed:
                tree = CountTree(np.array(chars[i], np.int64), np.array(sums[i], np.int64))
                texts[i], again[i] = tree.apply(texts[i] or "", [(e["start"], e["stop"], e["new"] or "") for e in edits[i]], cache)
                chars[i], sums[i] = tree.chars, tree.sums
            texts, chars, sums = pa.array(texts, pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int32()))
        return {text_col: texts, "leaf_chars": chars, "sums": sums, "n_reencoded": pa.array(again)}

    return with_columns(trees, work, "n_reencoded long")


def edit_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, rules=REDACTIONS, leaf: int = 16
) -> DataFrame:
    """Tokens of every text before and after redacting it, counted anew only where edits fall.

    The trees of all texts are written as a table without the texts; the edits of the texts that have some are
    joined to them by id and a hash of the text. Null and empty texts have no tokens and no edits; a text without edits keeps its count; repeated rows and null
    ids are counted once each; an empty table gives no rows; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    kept = checkpoint(count_trees(rows, tokenizer=tokenizer, leaf=leaf).drop("text"))
    # equal rows of one id have equal edits; only texts with edits are shuffled
    edits = rows.withColumn("edits", redactions(F.col("text"), rules)).where(F.size("edits") > 0).dropDuplicates(["doc_id", "hash"])
    edits = edits.select(F.col("doc_id").alias("of_doc"), F.col("hash").alias("of_hash"), "text", "edits")
    joined = kept.join(edits, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("hash") == F.col("of_hash")), "left")
    total = F.get("sums", F.lit(1)).cast("long")
    edited = apply_edits(joined.drop("of_doc", "of_hash").withColumn("n_tokens", total), tokenizer=tokenizer)
    n_edits = F.coalesce(F.size("edits"), F.lit(0)).cast("long")
    return edited.select("doc_id", "n_tokens", n_edits.alias("n_edits"), total.alias("n_tokens_edited"), "n_chunks", "n_reencoded")
