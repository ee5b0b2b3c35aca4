"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts (up to ``order`` bytes back, within a word) holds the counts
of the next byte. Under frozen statistics a byte costs -log2 of its probability in the longest known
context; unseen bytes pay the escape of each context they fall through, with exclusion of the bytes
seen there. Each language has an automaton over its own contexts, so a batch of distinct words is
scored column by column. The model's size is in proportion to the languages and has a stated limit.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import id_and_text, to_id

END = b" "  # closes every word
SCHEMA = "doc_id long, lang_pred string, score double, bits array<double>"


def count_contexts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, context, next byte, n) over rows of lang and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counter] = defaultdict(Counter)
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for word, n in Counter((text or "").lower().split()).items():
                    total[lang][word] += n
        for lang, words in total.items():
            counts: Counter = Counter()
            for word, n in words.items():
                b = END + word.encode("utf-8", "surrogatepass") + END
                for i in range(1, len(b)):
                    for d in range(min(order, i) + 1):
                        counts[b[i - d : i], b[i]] += n
            yield pd.DataFrame([(lang, c, s, n) for (c, s), n in counts.items()], columns=["lang", "context", "symbol", "n"])

    return rows.mapInPandas(run, "lang string, context binary, symbol int, n long").groupBy("lang", "context", "symbol").agg(F.sum("n").alias("n"))


class ByteModel:
    """For each language costs in bits and next states, by automaton state and byte class."""

    def __init__(self, counts: pd.DataFrame, order: int, max_bytes: int = 1 << 30):
        self.langs = sorted(counts["lang"].unique())
        seen = sorted(set(counts["symbol"].tolist()) | {END[0]})
        self.classes = np.full(256, len(seen), np.int32)  # the last class: bytes never seen
        self.classes[seen] = np.arange(len(seen))
        k = len(seen) + 1
        self.rare = 256 - len(seen)
        size = 8 * k * (counts.drop_duplicates(["lang", "context"]).shape[0] + 2 * len(self.langs))
        if size > max_bytes:
            raise ValueError(f"the model takes {size} bytes, more than {max_bytes}: choose a smaller order")
        self.tables = [self._language(counts[counts["lang"] == lang], seen, order) for lang in self.langs]

    def _language(self, own: pd.DataFrame, seen: list[int], order: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(bits, next state, start); the state is the longest context of the language that ends what was read."""
        k = len(seen) + 1
        table: dict[bytes, np.ndarray] = {}
        for c, s, n in zip(own["context"], own["symbol"], own["n"], strict=True):
            table.setdefault(c, np.zeros(k))[self.classes[s]] = n
        contexts = sorted({*table, b"", END[:order]}, key=lambda c: (len(c), c))
        index = {c: i for i, c in enumerate(contexts)}
        bits, following = np.zeros((len(contexts), k), np.float32), np.zeros((len(contexts), k), np.int32)
        weight = np.ones(k)
        weight[-1] = self.rare
        for i, c in enumerate(contexts):
            p, open_, left = np.zeros(k), np.ones(k, bool), 1.0
            for d in range(len(c), -1, -1):
                row = table.get(c[len(c) - d :])
                if row is None:
                    continue
                new = (row > 0) & open_
                if distinct := int(new.sum()):
                    total = row[new].sum()
                    p[new] += left * row[new] / (total + distinct)
                    left *= distinct / (total + distinct)
                    open_ &= ~new
            p[open_] += left / max(weight[open_].sum(), 1)  # the share of one byte of the class
            bits[i] = -np.log2(p)
            for s, byte in enumerate(seen):
                t = (c + bytes([byte]))[-order:] if order else b""
                while t not in index:
                    t = t[1:]
                following[i, s] = index[t]
        return bits, following, index[END[:order]]

    def cost(self, words: list[str]) -> np.ndarray:
        """Code length in bits of each word with its end, by language."""
        blobs = [w.encode("utf-8", "surrogatepass") + END for w in words]
        length = np.array([len(b) for b in blobs], np.int64)
        order = np.argsort(-length, kind="stable")
        flat = self.classes[np.frombuffer(b"".join(blobs), np.uint8)]
        start = (np.cumsum(length) - length)[order]
        length = length[order]
        alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")  # words longer than i
        found = np.zeros((len(words), len(self.langs)), np.float64)
        for a, (bits, following, begin) in enumerate(self.tables):
            state, out = np.full(len(words), begin, np.int32), np.zeros(len(words))
            for i, n in enumerate(alive.tolist()):
                s = flat[start[:n] + i]
                out[:n] += bits[state[:n], s]
                state[:n] = following[state[:n], s]
            found[order, a] = out
        return found


def train(rows: DataFrame, *, order: int = 3, sample: int = 1500, max_languages: int = 500, max_bytes: int = 1 << 30) -> ByteModel:
    """A model of about ``sample`` rows (key, lang, text) for each language, chosen by a hash of the key.

    Rows without a language or text are left out; without rows the model knows ``und`` alone. The driver
    receives counts of contexts of at most ``order`` bytes of that sample. More than ``max_languages``
    languages, or a model of more than ``max_bytes``, is an error.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    share = F.create_map([x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))]) if sizes else F.create_map().cast("map<string,double>")
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    counts = count_contexts(rows.where(unit < (1 << 20) * share[F.col("lang")]).select("lang", "text"), order).toPandas()
    if counts.empty:
        counts = pd.DataFrame({"lang": ["und"], "context": [b""], "symbol": [END[0]], "n": [1]})
    return ByteModel(counts.assign(context=[bytes(c) for c in counts["context"]]), order, max_bytes)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 200_000) -> DataFrame:
    """Most likely language of every whole text, its posterior probability and the code lengths.

    ``model`` is a broadcast ByteModel. A null text, or one without a letter, is ``und`` with score 0;
    ties go to the first language by name; texts of any length are read whole; repeated rows and null ids
    are judged row by row; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: ByteModel = model.value
        index: dict[str, int] = {}
        costs = np.zeros((0, len(m.langs)))
        for pdf in batches:
            rows = []
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                split = [(t or "").lower().split() for t in part["text"]]
                missing = list(set().union(*split).difference(index))
                if len(index) + len(missing) > limit:
                    index.clear()
                    costs = costs[:0]
                    missing = list(set().union(*split))
                if missing:
                    index.update(zip(missing, range(len(index), len(index) + len(missing)), strict=True))
                    costs = np.concatenate([costs, m.cost(missing)])
                for doc_id, text, words in zip(part["doc_id"], part["text"], split, strict=True):
                    bits = costs[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(0)
                    if text is None or not any(map(str.isalpha, text)):
                        rows.append((to_id(doc_id), "und", 0.0, bits.tolist()))
                        continue
                    best = int(bits.argmin())
                    with np.errstate(over="ignore", under="ignore"):
                        score = 1.0 / np.exp2(bits[best] - bits).sum()
                    rows.append((to_id(doc_id), m.langs[best], float(score), bits.tolist()))
            out = pd.DataFrame(rows, columns=["doc_id", "lang_pred", "score", "bits"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return id_and_text(docs, id_col, text_col).mapInPandas(run, SCHEMA)
