"""BPE by a segment tree over the ranks of adjacent pairs.

The tree's leaves are the places of a word's symbols; a leaf holds the rank of the
pair that starts there.  The root yields the least rank and its leftmost place;
a merge changes three leaves, so it costs logarithmic time.  The trees of many words
take their merges side by side.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import operator
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from sensorloom.llm import common

# A worker forgets its words' tokens when the words have more bytes than this.
KEPT_LETTERS = 1 << 22
# Leaves of the trees that take their merges together.
TOGETHER = 1 << 15

# First and last of letters that every Unicode version classes alike; texts with others are split by the library.
SETTLED = (
    (0x0000, 0x052F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2C65, 0x2C66), (0x3000, 0x30FF), (0x4E00, 0x9FEF),
    (0xAC00, 0xD7A3),
)


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 stands for itself, the rest counts up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def settled_class(kind: str) -> str:
    """Inside of a character class: the settled letters of a regex class, as ranges."""
    fits, ranges = regex.compile(kind).match, []
    for first, last in SETTLED:
        for code in range(first, last + 1):
            if fits(chr(code)):
                if ranges and ranges[-1][1] == code - 1:
                    ranges[-1][1] = code
                else:
                    ranges.append([code, code])
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in ranges)


class PairTrees:
    """Segment trees over the pair ranks of many words of at most ``width`` symbols.

    Row r of ``least`` is the tree of word r: its root at 1, its leaves from
    ``width`` on.  All words take one merge at a time together; each costs a walk
    down from the root and three walks up from the changed leaves.
    """

    def __init__(self, symbols: list[list[int]], width: int, pairs: Pairs):
        count = len(symbols)
        self.width, self.pairs = width, pairs
        # One place more on either side stands for "no symbol".
        self.symbols = np.full((count, width + 2), -1, dtype=np.int64)
        lengths = np.fromiter(map(len, symbols), dtype=np.int64, count=count)
        inside = np.arange(width) < lengths[:, None]
        self.symbols[:, 1:-1][inside] = np.fromiter(itertools.chain.from_iterable(symbols), dtype=np.int64, count=int(lengths.sum()))
        self.after = np.tile(np.arange(1, width + 3), (count, 1))
        self.after[:, 1:-1][np.arange(1, width + 1) >= lengths[:, None]] = width + 1
        self.before = np.tile(np.arange(-1, width + 1), (count, 1))
        leaves = pairs.ranks(self.symbols[:, 1:-1], self.symbols[:, 2:])
        levels = [leaves]
        while levels[0].shape[1] > 1:
            levels.insert(0, np.minimum(levels[0][:, ::2], levels[0][:, 1::2]))
        self.least = np.concatenate([leaves[:, :1], *levels], axis=1)

    def put(self, rows: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
        """Point update of one leaf of each row."""
        least, node = self.least, places - 1 + self.width
        least[rows, node] = ranks
        while (node := node >> 1)[0]:
            least[rows, node] = np.minimum(least[rows, 2 * node], least[rows, 2 * node + 1])

    def leftmost(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The root's rank and the leftmost place that has it."""
        rank, node = self.least[rows, 1], np.ones(len(rows), dtype=np.int64)
        for _ in range(self.width.bit_length() - 1):
            node = 2 * node + (self.least[rows, 2 * node] != rank)
        return rank, node - self.width + 1

    def merge(self) -> list[np.ndarray]:
        """Symbols of each word when no pair can be merged any more."""
        symbols, after, before, none = self.symbols, self.after, self.before, self.pairs.none
        rows = np.flatnonzero(self.least[:, 1] < none)
        while len(rows):
            rank, at = self.leftmost(rows)
            gone = after[rows, at]
            follow = after[rows, gone]
            symbols[rows, at], symbols[rows, gone] = self.pairs.merged[rank], -1
            after[rows, at], before[rows, follow] = follow, at
            prior = before[rows, at]
            self.put(rows, gone, np.full(len(rows), none))
            self.put(rows, at, self.pairs.ranks(symbols[rows, at], symbols[rows, follow]))
            left = prior > 0
            if left.any():
                some, prior, at = rows[left], prior[left], at[left]
                self.put(some, prior, self.pairs.ranks(symbols[some, prior], symbols[some, at]))
            rows = rows[self.least[rows, 1] < none]
        return [row[row >= 0] for row in symbols]


class Pairs:
    """Rank and result of every pair of symbols that can be merged."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]]):
        self.scale, self.none = len(vocabulary), len(merges)
        left, right, self.merged = (
            np.array([vocabulary[f(m)] for m in merges], dtype=np.int64)
            for f in (operator.itemgetter(0), operator.itemgetter(1), "".join)
        )
        keys = left * self.scale + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.scale + right
        at = np.minimum(np.searchsorted(self.keys, keys), self.none - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == keys), self.order[at], self.none)


def lowered(text: str) -> str:
    """Lower case letter by letter: a capital sigma becomes the same letter anywhere."""
    return text.replace("Σ", "σ").lower()


class WordBpe:
    """Encoder and decoder of a tokenizers file of lower-cased words with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        spec = data["model"]
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The standard library's classes are the faster ones; settled letters mean the same in both.
        letters, numbers, spaces = (settled_class(kind) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        for kind, members in ((r"[\p{L}]", f"[{letters}]"), (r"[\p{N}]", f"[{numbers}]"),
                              (r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")):
            split = split.replace(kind, members)
        self.words = re.compile(split).findall
        self.settled = re.compile("[" + settled_class(r"(?s:.)") + "]*").fullmatch
        self.end = spec["end_of_word_suffix"]
        self.vocabulary = spec["vocab"]
        self.pairs = Pairs(self.vocabulary, spec["merges"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.texts = {i: t for t, i in (self.vocabulary | self.special).items()}
        self.letters = byte_letters()
        self.bytes = {letter: b for b, letter in enumerate(self.letters)}
        library = tokenizers.Tokenizer.from_file(path)
        self.normalise, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.inner = [self.vocabulary[letter] for letter in self.letters]
        self.last = [self.vocabulary[letter + self.end] for letter in self.letters]
        self.kept: dict[str, tuple[bytes, str]] = {}
        self.forget()

    def forget(self) -> None:
        """Special tokens are kept like words; the pattern never yields one."""
        self.kept = {content: (struct.pack("<I", i), content) for content, i in self.special.items()}
        self.held = 0

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not kept; of each width all together, as many as fill ``TOGETHER`` leaves."""
        by_width: dict[int, list[str]] = {}
        for word in words:
            by_width.setdefault(1 << (len(word.encode("utf-8", "surrogatepass")) - 1).bit_length(), []).append(word)
        for width, members in by_width.items():
            step = max(1, TOGETHER // width)
            for start in range(0, len(members), step):
                self._learn(members[start : start + step], width)

    def _learn(self, words: list[str], width: int) -> None:
        rows = []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            rows.append([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])
            self.held += len(raw)
        texts = self.texts
        for word, ids in zip(words, PairTrees(rows, width, self.pairs).merge(), strict=True):
            self.kept[word] = (ids.astype("<u4").tobytes(), " ".join([texts[i] for i in ids.tolist()]))

    def plain_words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if text.isascii():
            return self.words(text.lower())
        if self.settled(text) and self.settled(lower := lowered(unicodedata.normalize("NFC", text))):
            return self.words(lower)
        found = self.pieces(self.normalise(text))
        return [bytes(map(self.bytes.__getitem__, piece)).decode("utf-8") for piece, _ in found]

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if "<|" not in text:
            return self.plain_words(text)
        out = []
        for piece in self.cut(text):
            out += [piece] if piece in self.special else self.plain_words(piece)
        return out

    def parts(self, texts: list[str]) -> Iterator[list[tuple[bytes, str]]]:
        """For every text the ids, as bytes, and the decoded text of each of its words."""
        split = [self.split(text) for text in texts]
        if self.held > KEPT_LETTERS:
            self.forget()
        kept = self.kept
        self.learn(word for word in set().union(*split) if word not in kept)
        for words in split:
            yield [kept[word] for word in words]

    def encode(self, text: str) -> list[int]:
        joined = b"".join([p[0] for p in next(self.parts([text]))])
        return list(struct.unpack(f"<{len(joined) // 4}I", joined))

    def decode(self, ids: list[int]) -> str:
        """Tokens' texts joined by spaces, special ones included."""
        return " ".join(self.texts[i] for i in ids if i in self.texts)


@functools.cache
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text of ``docs (doc_id, text)``."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return common.texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``ids (doc_id, ids)``; null ids are no ids."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts = pa.array([bpe.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: one row per row of ``docs (doc_id, text)``.

    Each distinct word is merged once by a worker; ids and decoded text of a
    document are the joined parts of its words.  A null text is the empty one,
    without tokens.  Repeated rows are each reported, no rows give no rows, other
    columns are not read.
    """

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            counts, ids, texts = [], [], []
            for parts in bpe.parts(batch.column("text").to_pylist()):
                joined = b"".join([p[0] for p in parts])
                counts.append(len(joined) // 4)
                ids.append(hashlib.sha256(joined).hexdigest())
                texts.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.texts(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
