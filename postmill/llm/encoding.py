"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern; the words not yet known to the task are merged together:
the symbols of all words lie in one flat array, each round finds every word's lowest-ranked adjacent pair by
binary search over the sorted pair keys and merges it, until no word has a pair left. Word ids are kept per
task, so a word costs its merges once. Null and empty texts get the empty list.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files of public tokenizers lie; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
#: Word pattern of the public byte-level tokenizers. Fixed value.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a task remembers before it starts anew; only speed depends on it.
MAX_WORDS = 1_000_000
_NONE = np.iinfo(np.int64).max


class Bpe:
    """Byte-level BPE from a file of ranks (base64 token, id per line)."""

    def __init__(self, path: str, pattern: str = WORD_PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.size = max(ranks.values()) + 1
        pairs = [(ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array([k for k, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array([r for _, r in pairs], dtype=np.int64)[order]
        self._bytes = np.zeros(self.size, dtype=np.int64)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each (non-empty) word, all words merged side by side."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), _NONE)
            if len(sym) > 1:
                same = word[1:] == word[:-1]
                rank[:-1] = np.where(same, self._rank(sym[:-1], sym[1:]), _NONE)
            lowest = np.minimum.reduceat(rank, first)
            counts = np.diff(np.r_[first, len(sym)])
            done = lowest == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[word[first[k]]] = sym[first[k] : first[k] + counts[k]].astype(np.int32)
                keep = np.repeat(~done, counts)
                sym, word, rank = sym[keep], word[keep], rank[keep]
                lowest, counts = lowest[~done], counts[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, counts)
            # neighbours that both hit share a symbol (as in "aaa"): every second one of such a run merges
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            odd = (np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))) % 2
            at = at[odd == 0]
            sym[at] = rank[at]
            gone = np.zeros(len(sym), dtype=bool)
            gone[at + 1] = True
            sym, word = sym[~gone], word[~gone]
        return out

    def _learn(self, words: Iterable[str]) -> None:
        new = list(words)
        for w, ids in zip(new, self.merge([w.encode() for w in new])):
            n = len(self.index)
            if n == len(self.start):
                self.start, self.length = np.resize(self.start, 2 * n), np.resize(self.length, 2 * n)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[n], self.length[n] = self.used, len(ids)
            self.used += len(ids)
            self.index[w] = n

    def _codes(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of all texts, the code of each and the number of words of each text."""
        per = [self.split(t) if t else [] for t in texts]
        words = [w for ws in per for w in ws]
        if len(self.index) > MAX_WORDS:
            self._reset()
        self._learn({w: None for w in words if w not in self.index})
        return words, np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words)), np.array([len(p) for p in per], dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets: text i has ids[offsets[i]:offsets[i + 1]])."""
        _, codes, per = self._codes(texts)
        sizes = self.length[codes]
        total = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(self.start[codes] - total[:-1], sizes) + np.arange(total[-1])] if len(codes) else np.empty(0, dtype=np.int32)
        return ids, total[np.r_[0, np.cumsum(per)]]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        _, codes, per = self._codes(texts)
        return np.diff(np.r_[0, np.cumsum(self.length[codes])][np.r_[0, np.cumsum(per)]])

    def encoded_over(self, texts: list[str | None], limit: int) -> list[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """(index, words, tokens of each word, ids) of the texts with more than `limit` tokens; every text is cut into words once."""
        words, codes, per = self._codes(texts)
        sizes = self.length[codes]
        ends = np.cumsum(per)
        total = np.r_[0, np.cumsum(sizes)]
        out = []
        for i in np.flatnonzero(total[ends] - total[ends - per] > limit):
            a, b = ends[i] - per[i], ends[i]
            begin = np.repeat(self.start[codes[a:b]] - (total[a:b] - total[a]), sizes[a:b])
            out.append((int(i), words[a:b], sizes[a:b], self.flat[begin + np.arange(total[b] - total[a])]))
        return out

    def byte_lengths(self) -> np.ndarray:
        """Bytes of each token, by id."""
        return self._bytes

    def words(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words of one text and the number of tokens of each."""
        words, codes, _ = self._codes([text])
        return words, self.length[codes]


def tokenizer_path(name: str, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


#: One tokenizer per worker process and file.
_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


#: Characters encoded at once; bounds the memory of a task, whatever the batch size of Arrow.
CHUNK_CHARS = 4_000_000


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_CHARS together; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, key: str, text: str, path: str, out: str = "ids") -> DataFrame:
    """(key, out array<int>): the token ids of every row's whole text, without special tokens.

    A map without shuffle. Null and empty texts give []; strings of special tokens in a text are ordinary text.
    Other columns are dropped, whatever their names.
    """
    source = df.select(df[key].alias("__key"), df[text].alias("__text"))
    schema = T.StructType([T.StructField(key, source.schema["__key"].dataType), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, offsets = bpe.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, out])

    return source.mapInArrow(run, schema)


def with_token_counts(df: DataFrame, text: str, path: str, out: str = "n_tokens") -> DataFrame:
    """`df` with the number of tokens of each text (0 for null and empty)."""
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for values in batches:
            texts = [x if isinstance(x, str) else None for x in values]
            yield pd.Series(np.concatenate([bpe.count(texts[a:b]) for a, b in chunks(texts)]) if texts else [], dtype="int64")

    return df.withColumn(out, count(F.col(text)))
