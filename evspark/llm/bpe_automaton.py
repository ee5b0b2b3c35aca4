"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton accepts, among all ways to spell a word as tokens, the one that the merges produce. It starts with one
state that has an arc for every symbol of the alphabet. Merge k, (a, b) -> ab, inserts a gadget: the state that arcs
labelled a lead to is copied without its b arc, a arcs now lead to the copy, and every state with an a arc gets an ab
arc to where b led from the old state. All arcs of one label lead to one state, so a state is a label and a time,
and a gadget adds one state at most.

A vocabulary of 49,000 tokens makes about as many states with about as many arcs each, so copies share their arcs:
kept are, for each label, when it was born and from which two, and the time at which an arc was cut. An arc is found
by going back through copies and gadgets; what is found is kept as a row of the transition table.

A word is read from left to right: a trie over the labels finds those that start at a place, the table says which may
follow the state there, and the longest is tried first. As every prefix has one spelling, a place is reached in one
state at most. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame

from evspark.llm.common import byte_signs, column, default_tokenizer, with_columns

#: The pre-split of printable ASCII and Latin letters of one code point: contractions, letters, single digits, other signs.
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN_CHUNK = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


class Automaton:
    """States and arcs of a merge list; ``suffix`` marks the last symbol of a word.

    ``vocabulary`` maps labels to ids; the labels that no merge makes are the alphabet. A merge whose gadget finds
    no b arc changes nothing.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", table_rows: int = 4_000_000):
        size = max(vocabulary.values(), default=-1) + 1
        self.size, self.suffix, self.table_rows = size, suffix, table_rows
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        made = {a + b for a, b in merges}
        alphabet = {t for t in vocabulary if t not in made}
        self.width = {vocabulary[t]: 1 for t in alphabet}
        self.trie: dict = {}
        self._symbols = {vocabulary[t]: (t,) for t in alphabet}
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocabulary[a], vocabulary[b], vocabulary[a + b])
        for token, symbols in self._symbols.items():
            node = self.trie
            for s in symbols[:-1]:
                node = node.setdefault(s, [-1, {}])[1]
            node.setdefault(symbols[-1], [-1, {}])[0] = token
        del self._symbols

    def _gadget(self, k: int, a: int, b: int, ab: int) -> None:
        if a not in self.width or b not in self.width or ab in self.width or not self.arc(a, k - 1, b):
            return
        self.cut[a * self.size + b] = k
        self.born[ab], self.left[ab], self.right[ab] = k, a, b
        self.width[ab] = self.width[a] + self.width[b]
        self._symbols[ab] = self._symbols[a] + self._symbols[b]

    def arc(self, u: int, time: int, w: int) -> bool:
        """Whether the state that u arcs led to at ``time`` has a w arc."""
        size, born, cut = self.size, self.born, self.cut
        while True:
            if cut.get(u * size + w, time + 1) <= time:
                return False
            if born[w] > born[u]:  # the arc came with the gadget of w, where an arc of its left part was
                time, w = min(time, born[w]), self.left[w]
            elif born[u] >= 0:  # u leads to where its right part led before the gadget of u
                time, u = born[u] - 1, self.right[u]
            else:
                return True

    def follows(self, u: int, w: int) -> bool:
        """The finished automaton's table: whether w may follow u."""
        key = u * self.size + w
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= self.table_rows:
                self.table.clear()
            known = self.table[key] = self.arc(u, 1 << 60, w)
        return known

    def encode(self, word: str) -> list[int]:
        """The tokens of a word whose letters are symbols of the alphabet.

        From each place the longest label that may follow is taken. Where none leads on, the place is given up for
        good, as no other arc reaches it in a different state; so no place is looked at twice.
        """
        if not word:
            return []
        symbols = [*word[:-1], word[-1] + self.suffix]
        n, width, follows, dead = len(symbols), self.width, self.follows, set()
        at, u, path, open_ = 0, -1, [], [self._starting(symbols, 0)]
        while at < n:
            options = open_[-1]
            while options:
                w = options.pop()
                if (u < 0 or follows(u, w)) and at + width[w] not in dead:
                    path.append(w)
                    at, u = at + width[w], w
                    open_.append(self._starting(symbols, at))
                    break
            else:
                dead.add(at)
                open_.pop()
                at -= width[path.pop()]
                u = path[-1] if path else -1
        return path

    def _starting(self, symbols: list[str], at: int) -> list[int]:
        """The tokens that are spelled from a place on, shortest first."""
        found, node = [], self.trie
        for j in range(at, len(symbols)):
            step = node.get(symbols[j])
            if step is None:
                break
            w, node = step
            if w >= 0:
                found.append(w)
        return found


class AutomatonTokenizer:
    """A tokenizers file with byte-level symbols, encoded by an automaton.

    Its normalizer and pre-splitter cut texts into words, its special tokens are matched in the raw text. Ids of
    white-space delimited chunks and of words, of up to ``longest`` characters, are kept: about ``limit`` of each.
    """

    def __init__(self, path: str, limit: int = 400_000, longest: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.signs = byte_signs()
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.limit, self.longest, self.known, self.known_words = limit, longest, {}, {}

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, with a sign for each byte."""
        if _PLAIN_CHUNK.fullmatch(chunk):
            words = _PLAIN_WORD.findall(chunk.lower())
            return words if chunk.isascii() else [w.encode().decode("latin-1").translate(self.signs) for w in words]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def _word(self, word: str) -> bytes:
        ids = self.known_words.get(word)
        if ids is None:
            ids = array("I", self.automaton.encode(word)).tobytes()
            if len(word) <= self.longest:
                if len(self.known_words) >= self.limit:
                    self.known_words.clear()
                self.known_words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():  # a run of letters, or one and a sign after it
            if chunk.isalpha():
                return self._word(chunk.lower())
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return self._word(chunk[:-1].lower()) + self._word(chunk[-1])
        out, at = [], 0
        for m in self.special_at.finditer(chunk):
            out += map(self._word, self.words(chunk[at : m.start()]))
            out.append(array("I", [self.special[m[0]]]).tobytes())
            at = m.end()
        out += map(self._word, self.words(chunk[at:]))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") for t in texts]
        wanted = set().union(*split)
        known = self.known
        missing = wanted.difference(known)
        if len(known) + len(missing) > self.limit:
            known.clear()
            missing = wanted
        for c in missing:
            known[c] = self._chunk(c)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for c in missing:
            if len(c) > self.longest:
                del known[c]
        return out

    def decode(self, ids: bytes) -> str:
        """The labels of the ids, joined by blanks, as a file without a decoder has it."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, AutomatonTokenizer] = {}


def automaton_tokenizer(path: str) -> AutomatonTokenizer:
    """One automaton for each tokenizer file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = AutomatonTokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, text_col: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """docs with the columns n_tokens and ids (little-endian uint32), as the tokenizer file gives them.

    No row moves. Null and empty texts have no ids; texts of any length are encoded whole, in time linear in
    their length; repeated rows are encoded each; an empty table gives no rows; columns of these names are
    replaced, all others kept.
    """
    path = tokenizer or default_tokenizer()

    def work(batch):
        import pyarrow as pa

        automaton = automaton_tokenizer(path)
        ids = automaton.encode([t or "" for t in column(batch, text_col).to_pylist()])
        return {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

    return with_columns(docs, work, "n_tokens long, ids binary")


def decode(rows: DataFrame, ids_col: str = "ids", *, tokenizer: str | None = None) -> DataFrame:
    """rows with the column decoded: the labels of the ids, joined by blanks; null ids give an empty text.

    No row moves; a column of that name is replaced, all others are kept.
    """
    path = tokenizer or default_tokenizer()

    def work(batch):
        import pyarrow as pa

        automaton = automaton_tokenizer(path)
        return {"decoded": pa.array([automaton.decode(x or b"") for x in column(batch, ids_col).to_pylist()], pa.string())}

    return with_columns(rows, work, "decoded string")


def digests(docs: DataFrame, text_col: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the decoded text.

    Equal to hashing what ``encode`` and then ``decode`` give, so that neither leaves the worker;
    rows are treated as there.
    """
    path = tokenizer or default_tokenizer()

    def work(batch):
        import pyarrow as pa

        automaton = automaton_tokenizer(path)
        n, ids_sha, decoded_sha = [], [], []
        for ids in automaton.encode([t or "" for t in column(batch, text_col).to_pylist()]):
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}

    return with_columns(docs, work, "n_tokens long, ids_sha256 string, decoded_sha256 string")
