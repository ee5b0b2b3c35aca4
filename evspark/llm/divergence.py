"""How the sources of a language differ in their words, from sorted pointers to word starts.

A shard is a slice of an Arrow column of texts. Pointers to the starts of its words are sorted by the bytes that follow,
up to the word's end, by multikey quicksort with digits of eight bytes: a slice of words that are equal so far is sorted by the
next digit, as long as one of its words goes on; slices of one word are done. A run of equal words then gives the number of its
occurrences and documents for each source. Only these counts leave a shard.

Counts are added up by language, source and word; words in enough documents of a language are kept. Shares are exact
integers. The distance between two sources of a language is summed over blocks of words: only words that occur in
either source are looked at, as all others add the same known difference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.llm.common import column, written

COUNTS = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, a int, b int, value long"
_BYTES = np.arange(256)
#: Letters A-Z and a-z, and all bytes of other letters and signs beyond ASCII.
IN_TERM = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Digits of eight bytes after which the few slices that are left are sorted as byte strings.
DIGITS = 8


def word_places(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each word in documents that end at ``ends`` in the bytes ``text``."""
    inside = np.zeros(len(text) + 1, bool)
    inside[:-1] = IN_TERM[text]
    before = np.zeros(len(text) + 1, bool)
    before[1:] = inside[:-1]
    edge = np.zeros(len(text) + 1, bool)
    edge[ends] = True  # a word ends with its document
    starts = np.flatnonzero(inside & (~before | edge))
    stops = np.flatnonzero(before & (~inside | edge))
    return starts, stops - starts, np.searchsorted(ends, starts, "right")


def sorted_runs(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): pointers in order of their words' bytes, and where in it each run of equal words begins."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    at = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(text) + 1, 8), (1, 1))
    order = np.arange(n)
    begins = np.zeros(n + 1, bool)  # where a slice begins, in terms of order
    begins[[0, n]] = True
    active = np.arange(n)  # places in order whose slice still has to be sorted
    for depth in range(0, 8 * DIGITS, 8):
        pointers = order[active]
        left = np.clip(lengths[pointers] - depth, 0, 8)
        place = np.minimum(starts[pointers] + depth, len(text))
        digit = np.ascontiguousarray(at[place]).view(">u8").reshape(-1).astype(np.uint64)
        digit &= np.where(left > 0, np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64)), np.uint64(0))
        piece = np.cumsum(begins[active])
        found = np.argsort(digit, kind="quicksort") if depth == 0 else np.lexsort((digit, piece))
        order[active] = pointers[found]
        digit, piece = digit[found], piece[found]
        begins[active[1:]] |= (digit[1:] != digit[:-1]) | (piece[1:] != piece[:-1])
        piece = np.cumsum(begins[active]) - 1
        goes_on = np.bincount(piece, lengths[order[active]] > depth + 8) > 0
        active = active[(goes_on & (np.bincount(piece) > 1))[piece]]
        if not len(active):
            break
    if len(active):
        _sort_rest(text, starts, lengths, order, begins, active)
    return order, np.flatnonzero(begins[:-1])


def _sort_rest(text, starts, lengths, order, begins, active) -> None:
    """The slices of words that are equal over all digits: sorted by the bytes that are left.

    A word that ended with the last digit has none and comes first.
    """
    first = np.flatnonzero(begins)
    for k in np.unique(np.searchsorted(first, active, "right") - 1):
        lo, hi = first[k], first[k + 1]
        rest = [text[starts[p] + 8 * DIGITS : starts[p] + lengths[p]].tobytes() if lengths[p] > 8 * DIGITS else b"" for p in order[lo:hi]]
        by = sorted(range(hi - lo), key=rest.__getitem__)
        order[lo:hi] = order[lo:hi][by]
        for i in range(1, hi - lo):
            begins[lo + i] = rest[by[i]] != rest[by[i - 1]]


def shard_counts(texts, langs: list[str], sources: list[str]):
    """A record batch of COUNTS for a slice of an Arrow column of texts; an empty term has the slice's documents."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    text = LOWER[raw]
    starts, lengths, doc = word_places(text, offsets[1:] - offsets[0])
    order, first = sorted_runs(text, starts, lengths)
    groups = {g: i for i, g in enumerate(sorted(set(zip(langs, sources, strict=True))))}
    of_doc = np.array([groups[g] for g in zip(langs, sources, strict=True)], np.int64)
    names = list(groups)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    key = run * len(groups) + of_doc[doc[order]]
    pairs, n = np.unique(key, return_counts=True)
    seen = np.unique(run * len(of_doc) + doc[order])
    docs = np.bincount(np.searchsorted(pairs, seen // len(of_doc) * len(groups) + of_doc[seen % len(of_doc)]), minlength=len(pairs))
    held, at = text.tobytes(), order[first]
    terms = [held[s : s + k].decode("utf-8", "replace") for s, k in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
    found = [(*names[p % len(groups)], terms[p // len(groups)]) for p in pairs.tolist()] + [(*g, "") for g in names]
    langs, sources, terms = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()),
            pa.array(sources, pa.string()),
            pa.array(terms, pa.string()),
            pa.array([*n.tolist(), *np.bincount(of_doc).tolist()], pa.int64()),
            pa.array([*docs.tolist(), *np.bincount(of_doc).tolist()], pa.int64()),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def word_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, shard_bytes: int) -> DataFrame:
    """(lang, source, term, n, docs) over all documents; the empty term counts a group's documents.

    A shard ends with the document that fills ``shard_bytes``.
    """

    def run(batches):
        for batch in batches:
            texts = column(batch, "text")
            langs, sources = column(batch, "lang").to_pylist(), column(batch, "source").to_pylist()
            size = np.cumsum(np.array(column(batch, "size").to_pylist(), np.int64))
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + shard_bytes, "right")))
                yield shard_counts(texts.slice(lo, hi - lo), langs[lo:hi], sources[lo:hi])
                lo = hi

    none = F.lit("")
    text = F.coalesce(F.col(text_col).cast("string"), none)
    given = docs.select(
        text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), none).alias("lang"), F.coalesce(F.col(source_col).cast("string"), none).alias("source")
    ).withColumn("size", F.octet_length("text").cast("long"))
    parts = given.mapInArrow(run, COUNTS)
    return written(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, all_n: Column, v: Column, weight: int, scale: int) -> Column:
    """1 + floor(scale * (n + weight) / (all + weight * v)), exactly."""
    top = F.lit(scale).cast("decimal(10,0)") * (n + weight).cast("decimal(20,0)")
    return (F.call_function("div", top, (all_n + weight * v).cast("decimal(20,0)")) + 1).cast("long")


def _pair_sums(rows: pd.DataFrame, groups: pd.DataFrame, cells: int) -> pd.DataFrame:
    """Distances between a language's sources over one shard of its words; ``rows`` has a share for each word and source.

    Shard 0 adds what all words would differ by, were they in neither source; words that occur change that.
    """
    lang, shard, p, q = (groups[c].iloc[0] for c in ("lang", "shard", "p", "q"))
    number, block = groups["number"].to_numpy(), groups["block"].to_numpy()
    none, v = groups["none"].to_numpy(np.int64), int(groups["v"].iloc[0])
    total = np.zeros((len(number), len(number)), np.int64)
    apart = np.abs(none[:, None] - none[None, :])
    if shard == 0:
        total += v * apart
    if len(rows):
        by_number = np.argsort(number)
        col = by_number[np.searchsorted(number[by_number], rows["number"].to_numpy())]
        _, term = np.unique(rows["term"].to_numpy().astype(object), return_inverse=True)
        n_terms, value = int(term.max()) + 1, rows["share"].to_numpy(np.int64)
        by_term = np.argsort(term, kind="stable")
        term, col, value = term[by_term], col[by_term], value[by_term]
        step = max(1, cells // len(number))
        for lo in range(0, n_terms, step):
            a, b = np.searchsorted(term, [lo, lo + step])
            shares = np.tile(none, (min(step, n_terms - lo), 1))
            shares[term[a:b] - lo, col[a:b]] = value[a:b]
            for i in range(len(number)):
                total[i] += np.abs(shares - shares[:, i : i + 1]).sum(0)
            total -= len(shares) * apart
    i, j = np.nonzero(number[:, None] < number[None, :])
    if p != q:
        across = block[i] != block[j]
        i, j = i[across], j[across]
    return pd.DataFrame({"lang": lang, "a": number[i], "b": number[j], "value": total[i, j]})


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    *,
    least_docs: int = 30,
    top: int = 50,
    weight: int = 5,
    scale: int = 1_000_000_000,
    shard_bytes: int = 1 << 23,
    block: int = 256,
    rows_a_shard: int = 100_000,
    cells: int = 2_000_000,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others and from the language.

    Part pair has a row for each other source with the sum of differences of shares over the language's kept words;
    part term has the ``top`` words whose share is above the language's, by that difference. Ties are ranked by item.

    Null texts, languages and sources are empty ones; rows repeat as often as they come; texts of any length are read
    whole; a group without words has the least shares; a language without kept words has pairs of value 0; an empty table
    gives no rows; other columns are ignored.
    """
    counts = word_counts(docs, text_col, lang_col, source_col, shard_bytes)
    words = counts.where(F.col("term") != "")
    of_word = W.partitionBy("lang", "term")
    kept = (
        words.withColumn("lang_docs", F.sum("docs").over(of_word))
        .withColumn("lang_n", F.sum("n").over(of_word))
        .withColumn("first", (F.row_number().over(of_word.orderBy("source")) == 1).cast("int"))
        .where(F.col("lang_docs") >= least_docs)
    )
    kept = written(kept.select("lang", "source", "term", "n", "lang_n", "first"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("all_n"), F.sum("first").alias("firsts"))
    groups = counts.where(F.col("term") == "").select("lang", "source").join(sums, ["lang", "source"], "left")
    of_lang = W.partitionBy("lang")
    zero = F.lit(0).cast("long")
    groups = groups.select(
        "lang",
        "source",
        F.coalesce("all_n", zero).alias("all_n"),
        F.coalesce(F.sum("firsts").over(of_lang), zero).alias("v"),
        F.coalesce(F.sum("all_n").over(of_lang), zero).alias("lang_all"),
        F.row_number().over(of_lang.orderBy("source")).cast("int").alias("number"),
    )
    groups = groups.withColumn("none", F.when(F.col("v") > 0, share(zero, F.col("all_n"), F.col("v"), weight, scale)).otherwise(zero))
    groups = written(groups.withColumn("block", F.floor((F.col("number") - 1) / block).cast("int")))

    # a source may hold a third of the words: its words are dealt over copies of its row
    salts = 16
    salted = groups.select("lang", "source", "number", "block", "all_n", "v", "lang_all", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    shared = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "source", "salt"])
    shared = shared.withColumn("share", share(F.col("n"), F.col("all_n"), F.col("v"), weight, scale))

    above = F.col("share") - share(F.col("lang_n"), F.col("lang_all"), F.col("v"), weight, scale)
    terms = shared.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).where(F.col("value") > 0)
    ranked = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    shards = max(1, -(-kept.count() // rows_a_shard))
    blocks = F.sequence(F.lit(0), F.col("last"))
    last = F.max("block").over(of_lang).alias("last")

    def met(rows: DataFrame) -> DataFrame:
        """Each row once for every block that its own is compared with."""
        rows = rows.withColumn("other", F.explode(blocks))
        return rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))

    numbered = groups.select("lang", "number", "block", "none", "v", last)
    right = met(numbered.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    left = shared.select(
        "lang", "number", "block", "term", "share", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "v"
    )
    if groups.agg(F.max("block")).first()[0]:  # more sources in a language than one block holds
        of_langs = groups.groupBy("lang").agg(F.max("block").alias("last"))
        copies = of_langs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        left = met(left.join(copies, ["lang", "shard"]))
    else:
        left = left.withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    keys = ["lang", "shard", "p", "q"]
    partial = (
        left.select(*keys, "number", "term", "share")
        .groupBy(*keys)
        .cogroup(right.select(*[F.col(c).alias(c) for c in (*keys, "number", "block", "none", "v")]).groupBy(*keys))
        .applyInPandas(lambda rows, of: _pair_sums(rows, of, cells), PARTIAL)
    )
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = groups.select("lang", F.col("number").alias("a"), "source")
    items = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    pairs = both.join(named, ["lang", "a"]).join(items, ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.union(terms)
