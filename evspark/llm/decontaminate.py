"""Benchmark decontamination with DataFrame functions only.

The n-grams of the benchmark's normalised words become a set of hashes. Every window of every
document is hashed and looked up in that set, which is broadcast while it stays under a stated number
of bytes and joined by a shuffle beyond it; hits are then verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of memory that a hash of a window takes in a broadcast table, with room to spare.
HASH_BYTES = 64
#: Fixed word pattern: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """The text, null as empty, with A-Z lower-cased."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(item, length, gram): each run of ``n`` words of an item; a shorter item is one window."""
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    return (
        items.select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at"), F.lit(n)).alias("gram"))
        .select("item", F.size("gram").alias("length"), "gram")
        .distinct()
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    n: int = 10,
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per key, item and place: (key, item, at, length), ``at`` counting words from 1.

    ``id_col`` should tell texts apart. The lengths of the windows are at most ``n`` different numbers, so they
    are read to the driver. Only hashes are broadcast, never words.
    """
    windows = item_windows(benchmark, item_col, item_text_col, n).withColumn("hash", F.xxhash64("gram"))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    small = windows.count() * HASH_BYTES <= max_broadcast_bytes
    shape = "array<struct<length:int,hash:bigint>>"
    rows = docs.select(F.col(id_col).alias("key"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    at = rows.select("key", "words", F.posexplode("words").alias("at", "word")).withColumn("at", F.col("at") + 1)
    if len(lengths) == 1:
        at = at.where(F.col("at") <= F.size("words") - lengths[0] + 1)
        at = at.withColumn("length", F.lit(lengths[0])).withColumn("hash", F.xxhash64(F.slice("words", F.col("at"), F.lit(lengths[0]))))
    else:
        each = [
            F.struct(F.lit(k).alias("length"), F.when(F.col("at") <= F.size("words") - k + 1, F.xxhash64(F.slice("words", F.col("at"), F.lit(k)))).alias("hash"))
            for k in lengths
        ]
        each = F.array(*each) if each else F.array().cast(shape)
        at = at.select("key", "words", "at", F.explode(each).alias("w")).select("key", "words", "at", "w.length", "w.hash")
    hashes, grams = windows.select("hash", "length").distinct(), windows.select("hash", "gram", "item")
    if small:
        found = at.join(F.broadcast(hashes), ["hash", "length"])
    else:  # only places are shuffled; the words are joined again to the few that hit
        found = at.select("key", "at", "length", "hash").join(hashes, ["hash", "length"])
        found = found.alias("f").join(rows.hint("merge").alias("r"), F.col("f.key").eqNullSafe(F.col("r.key"))).select("f.*", "r.words")
    found = found.select("key", "at", "length", "hash", F.slice("words", F.col("at"), F.col("length")).alias("found"))
    hits = found.join(grams, "hash").where(F.col("found") == F.col("gram"))
    return hits.select("key", "item", "at", "length")


def _covered(spans: Column) -> Column:
    """Words under the union of sorted (at, length) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc, s):
        end = s["at"] + s["length"]
        return F.struct(
            (acc["n"] + F.greatest(end - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(spans, start, step)["n"]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    n: int = 10,
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """Per row: id, text_hash, n_words, n_hit (words inside any occurring window), items (sorted ids as
    text), spans (sorted (at, length)) and contaminated.

    A null or empty text has no words and no hits; items without words have no windows; an empty
    benchmark contaminates nothing. Rows are told apart by id and a hash of the text, so rows that repeat an
    id, or have none, are each judged by their own text. Repeated items, and items of one id, count once by
    that id; an empty table gives no rows; other columns are ignored. Texts are scanned whole.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text.cast("string")).alias("hash"), text.alias("text"))
    keyed = rows.select(F.struct("id", "hash").alias("key"), "text")
    hits = find_hits(keyed, benchmark, "key", "text", item_col, item_text_col, n=n, max_broadcast_bytes=max_broadcast_bytes)
    per = hits.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("at", "length"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    per = per.select(F.col("key.id").alias("of_id"), F.col("key.hash").alias("of_hash"), "spans", "items")
    counted = rows.select("id", "hash", F.regexp_count(lowered(F.col("text")), F.lit(WORD)).cast("long").alias("n_words"))
    both = counted.join(per, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return both.select(
        F.col("id").alias(id_col),
        F.col("hash").alias("text_hash"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,length:int>>")).alias("spans"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    Every row is judged by its own text: rows are told apart by id and a hash of the text, so a row with a
    null or repeated id stays if it is clean, whatever the others hold. Null and empty texts stay; an empty table
    gives no rows; names that begin with two underscores are reserved. Texts are scanned whole.
    """
    text = F.col(options.get("text_col", "text")).cast("string")
    keyed = docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")))
    hit = find_hits(keyed, benchmark, "__row", **options).select(F.col("key").alias("__row")).distinct()
    return keyed.join(hit, "__row", "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the words (and what stands between them) of the spans that ``decontaminate`` found.

    Rows are matched by id and hash of the text, null ids too, so equal rows lose the same spans and others of that
    id lose none. A text without spans, null or empty included, stays as it is; between kept words the text is
    unchanged; other columns are kept; names that begin with two underscores are reserved.
    """
    spans = found.where(F.size("spans") > 0).select(F.col(id_col).alias("__key"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    same = F.col(id_col).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hash"))
    joined = docs.join(spans.dropDuplicates(["__key", "__hash"]), same, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(ANY_CASE), F.lit(0))
    gaps = F.split(text, ANY_CASE)  # one more than there are words
    merged = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"), F.get(gaps, i + 1).alias("gap"))),
        lambda x: ~F.exists("__spans", lambda s: (s["at"] <= x["i"] + 1) & (x["i"] + 1 < s["at"] + s["length"])),
    )
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(merged, lambda x: F.concat(x["w"], x["gap"])), ""))
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut)).drop("__key", "__hash", "__spans")
