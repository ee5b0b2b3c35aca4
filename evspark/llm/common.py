"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bit set on the last id of a chunk that closes a sentence or a line.
SENTENCE_END = np.uint32(1 << 31)
ID_MASK = np.uint32((1 << 31) - 1)
_CLOSES = re.compile(r"""(?:[.!?]["')\]»”’]*|\n)$""")
#: Small Latin letters that stay as they are, and a mark; the dotted I is out, as its small form has a loose dot.
_CLOSING = re.compile(r"([a-zÀ-ÖØ-öø-įı-ɏ]+)([.,!?;:]?)\n?")
#: Marks that make one sign with some small letters but not with their capitals (h, j, t, w, y).
_SMALL_ONLY = "\u0331\u030c\u0308\u030a"
#: Words that the tokenizer's normalizer and splitter leave whole: small letters of one code point, up to U+00FF.
_WORD = re.compile(r"[a-zß-öø-ÿ]+")
_ENDS = frozenset(".!?\"')]»”’\n")
_MARKS = frozenset(".,!?;:\n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id is in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the cluster's shared checkpoint folder.

    A folder of our own is used only under a local master whose session names none, as in tests; elsewhere
    that is an error, as executors would not see each other's files.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def written(df: DataFrame) -> DataFrame:
    """Like ``checkpoint``, but as a Parquet table in that folder, which is much smaller for tables of numbers."""
    checkpoint_dir(df.sparkSession)
    place = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def with_columns(rows: DataFrame, work, columns: str, step: int = 256) -> DataFrame:
    """rows with the columns of the schema ``columns``, from work(record batch) -> their arrays by name.

    ``work`` sees ``step`` rows at a time; other columns pass unchanged, columns of these names are replaced.
    """
    new = StructType.fromDDL(columns)
    schema = StructType([f for f in rows.schema.fields if f.name not in new.names] + new.fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                found = work(part)
                yield pa.RecordBatch.from_arrays([found[n] if n in found else column(part, n) for n in schema.names], schema.names)

    return rows.mapInArrow(run, schema)


def column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only, as bytes do."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as text (so that nulls and long ids pass through pandas unchanged) and the text."""
    return df.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def to_id(value: str | None) -> int | None:
    return None if value is None else int(value)


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level tokens: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _closed(ids: bytes) -> bytes:
    """The ids with the last one marked as closing a sentence."""
    if not ids:
        return ids
    out = np.frombuffer(ids, np.uint32).copy()
    out[-1] |= SENTENCE_END
    return out.tobytes()


class ChunkTokens:
    """Ids of white-space delimited chunks under a public tokenizer, as little-endian uint32 bytes.

    The tokenizer never joins across white space, so a text's ids are those of its chunks. What is learnt
    is kept in two generations of at most ``limit`` chunks: when the younger is full it becomes the older
    one, so that chunks in use stay and others go.
    """

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.marks, self.signs = Tokenizer.from_file(path), limit, {}, byte_signs()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lookup(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """A table that holds every one of the chunks, for use until the next call."""
        young = self.young
        missing = set(chunks).difference(young)
        if not missing:
            return young
        if len(young) + len(missing) > self.limit:
            self.old, self.young = young, {}
            young, missing = self.young, set(chunks)
        if self.old:
            old = self.old
            known = {c: old[c] for c in old.keys() & missing}
            young.update(known)
            missing.difference_update(known)
        # a run of letters and the mark or line end after it are split by the tokenizer in any case
        plain = {c: m for c in missing if c and c[-1] in _MARKS and (m := _CLOSING.fullmatch(c))}
        fresh = {c for c in missing if c not in plain}
        fresh.update(b for m in plain.values() if (b := m[1]) not in young)
        words = [c for c in fresh if _WORD.fullmatch(c)]
        fresh.difference_update(words)
        self._encode_words(words)
        fresh = list(fresh)
        for i in range(0, len(fresh), 512):
            self._encode(fresh[i : i + 512])
        for c, m in plain.items():
            young[c] = young[m[1]] + self._mark(m[2], c[-1] == "\n") if m[2] else _closed(young[m[1]])
        return young

    def _mark(self, mark: str, line_end: bool) -> bytes:
        if (mark, line_end) not in self.marks:
            ids = np.array(self.tokenizer.encode(mark, add_special_tokens=False).ids, np.uint32).tobytes()
            self.marks[mark, line_end] = _closed(ids) if line_end or _CLOSES.search(mark) else ids
        return self.marks[mark, line_end]

    def _encode_words(self, words: list[str]) -> None:
        """Words go to the model at once, with its sign for each byte."""
        young, tokenize, signs = self.young, self.tokenizer.model.tokenize, self.signs
        for w in words:
            spelled = w if w.isascii() else w.encode().decode("latin-1").translate(signs)
            young[w] = array("I", [t.id for t in tokenize(spelled)]).tobytes()

    def _encode(self, chunks: list[str]) -> None:
        """One call for many chunks, joined by blanks; a token belongs to the chunk in which it starts."""
        starts = np.cumsum([0, *[len(c) + 1 for c in chunks]])
        got = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        at = np.searchsorted(starts, np.array([o[0] for o in got.offsets], np.int64), "right") - 1
        edge = np.searchsorted(at, np.arange(len(chunks) + 1))
        last = edge[1:] - 1
        closing = np.array([c[-1:] in _ENDS and bool(_CLOSES.search(c)) for c in chunks]) & (edge[1:] > edge[:-1])
        ids[last[closing]] |= SENTENCE_END
        raw, edge = ids.tobytes(), (4 * edge).tolist()
        self.young.update(zip(chunks, [raw[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)], strict=True))

    def flagged(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with SENTENCE_END set where a sentence or line ends."""
        split = [split_chunks(t) for t in texts]
        ids = self.lookup(list(chain.from_iterable(split))).__getitem__
        return [np.frombuffer(b"".join(map(ids, chunks)), np.uint32) for chunks in split]


def split_chunks(text: str) -> list[str]:
    """Chunks between blanks, tabs and line ends; a chunk before a line end keeps it.

    A-Z are lower-cased, as the tokenizer would, but not where its special tokens may stand, nor where a mark may make one
    sign with a small letter that it does not make with the capital, as the tokenizer composes letters first.
    """
    kept = "<|" in text or (not text.isascii() and any(m in text for m in _SMALL_ONLY))
    return (text if kept else ascii_lower(text)).replace("\t", " ").replace("\r", " ").replace("\n", "\n ").split(" ")


_LOADED: dict[tuple[str, int], ChunkTokens] = {}


def chunk_tokens(path: str, limit: int = 200_000) -> ChunkTokens:
    """One cache for each tokenizer file, limit and Python worker."""
    if (path, limit) not in _LOADED:
        _LOADED[path, limit] = ChunkTokens(path, limit)
    return _LOADED[path, limit]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
