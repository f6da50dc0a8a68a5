"""Oversized texts cut into ordered pieces under a token limit, at natural boundaries, with overlap.

Lexical-cohesion segmentation: the text is cut into sentences; at every gap the words of the sentences before and
after it are compared (cosine of their counts), and a gap's depth is how far its similarity lies below the peaks on
both sides. Within the window of sizes allowed for a piece the deepest valley is the cut. A piece starts
`overlap` tokens before the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postmill.llm.encoding import Bpe, chunks, load

#: Sentences of a block compared at a gap, and the smallest piece as a share of the limit.
BLOCK = 6
LEAST_FILL = 0.5
#: What a blank line or a line end adds to the depth of a valley.
BLANK_LINE, LINE_END = 0.3, 0.1

_SENTENCE = re.compile(r"\n[^\S\n]*\n\s*|\n+|(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])")
_BLANK_LINE, _LINE = re.compile(r"\n[^\S\n]*\n\s*$"), re.compile(r"\n$")
#: Terms a task remembers before it starts anew; only speed depends on it.
MAX_TERMS = 1_000_000


class Terms:
    """Numbers of words by their lower-case letters; -1 for what holds no letter."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.of) > MAX_TERMS:
            self.of.clear()
        for w in {*words} - self.of.keys():
            t = w.strip().lower()
            self.of[w] = self.of.setdefault(t, len(self.of)) if t.isalpha() else -1
        return np.fromiter(map(self.of.__getitem__, words), dtype=np.int64, count=len(words))


def similarities(term: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """Cosine of the word counts of the BLOCK sentences before and after each of the n - 1 gaps between n sentences.

    `term`, `sentence`: the words' numbers and places. Products of sentences at most 2 * BLOCK - 1 apart make up all blocks' products: a word's
    sentences are sorted and met with their next ones, and the sums over blocks are differences of running sums.
    """
    reach = 2 * BLOCK - 1
    key, count = np.unique(term * n + sentence, return_counts=True)
    word, place = key // n, key % n
    count = count.astype(np.float64)
    band = np.zeros((reach + 1, n))
    band[0] = np.bincount(place, count * count, n)
    for k in range(1, min(reach, len(key) - 1) + 1):
        apart = place[k:] - place[:-k]
        near = (word[k:] == word[:-k]) & (apart <= reach)
        if not near.any():
            break
        np.add.at(band, (apart[near], place[:-k][near]), count[k:][near] * count[:-k][near])
    run = np.concatenate([np.zeros((reach + 1, 1)), np.cumsum(band, axis=1)], axis=1)
    g = np.arange(n - 1)

    def between(d: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        low, high = np.clip(low, 0, n), np.clip(high + 1, 0, n)
        return run[d][np.maximum(high, low)] - run[d][low]

    dot = sum(between(d, np.maximum(g + 1 - d, g - BLOCK + 1), np.minimum(g, g + BLOCK - d)) for d in range(1, reach + 1))
    # a pair that reaches over the block's first sentence counts in no block: windows are cut off at both ends of the text
    left = sum((1 + (d > 0)) * between(d, g - BLOCK + 1, g - d) for d in range(BLOCK))
    right = sum((1 + (d > 0)) * between(d, g + 1, g + BLOCK - d) for d in range(BLOCK))
    norm = np.sqrt(left * right)
    return np.divide(dot, norm, out=np.zeros(n - 1), where=norm > 0)


def gaps(text: str, words: list[str], word_char: np.ndarray, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(character offsets of the gaps between sentences, depth of the valley at each); `word_char` holds where the words begin."""
    at = np.unique(np.array([m.end() for m in _SENTENCE.finditer(text) if 0 < m.end() < len(text)], dtype=np.int64))
    if not len(at):
        return at, np.empty(0)
    code = terms.codes(words)
    # a word belongs to the sentence in which it ends: the pattern puts a blank at the head of the next word
    sentence = np.searchsorted(at, word_char[1:] - 1, side="right")
    similar = similarities(code[code >= 0], sentence[code >= 0], len(at) + 1)
    depth = np.zeros(len(at))
    for sign in (1, -1):
        s = similar[::sign]
        # the peak before a gap: where the similarity last began to fall towards it
        rising = np.r_[True, s[1:] >= s[:-1]]
        depth[::sign] += s[np.maximum.accumulate(np.where(rising, np.arange(len(s)), 0))] - s
    tails = [text[max(0, x - 8) : x] for x in at]
    return at, depth + np.array([BLANK_LINE if _BLANK_LINE.search(t) else LINE_END if _LINE.search(t) else 0.0 for t in tails])


def split_text(text: str, bpe: Bpe, max_tokens: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """Pieces of one text as split_encoded gives them; [] when the text fits."""
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("the overlap must be less than half of max_tokens")
    return [p for _, *rest in bpe.encoded_over([text], max_tokens) for p in split_encoded(text, *rest, bpe, max_tokens, overlap, Terms())]


def split_encoded(text: str, words: list[str], sizes: np.ndarray, ids: np.ndarray, bpe: Bpe, max_tokens: int, overlap: int, terms: Terms) -> list[tuple[int, int, int, int, str]]:
    """Pieces (first token, end token, tokens, shared with the piece before, text) of a text with its words, their tokens and its ids.

    Every piece has at most max_tokens tokens of the text and at most max_tokens when encoded by itself.
    Neighbours share exactly `overlap` tokens; the text of a piece whose first token lies inside a character begins with
    that character. Where a window has no gap the cut falls between words, within a word longer than the window
    between characters. A limit that not even a piece just longer than the overlap keeps is an error.
    """
    data = text.encode()
    total = int(sizes.sum())
    lengths = bpe.byte_lengths()[ids]
    token_byte = np.r_[0, np.cumsum(lengths)]
    word_token = np.r_[0, np.cumsum(sizes)]
    word_char = np.r_[0, np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))]
    at, depth = gaps(text, words, word_char, terms)
    # a gap counts at the word that begins at or before it: the pattern puts a blank at the head of the next word
    slot = np.searchsorted(word_char, at, side="right") - 1
    gap_token = word_token[slot]
    raw = np.frombuffer(data, dtype=np.uint8)

    def begins_char(token: int) -> bool:
        b = token_byte[token]
        return b >= len(raw) or (raw[b] & 0xC0) != 0x80

    def piece(start: int, end: int) -> str:
        b = int(token_byte[start])
        while b > 0 and (raw[b] & 0xC0) == 0x80:
            b -= 1
        return data[b : int(token_byte[end])].decode()

    def begins_anywhere(k: int) -> bool:
        """Whether a word begins at the k-th word in any text around it: one blank between a character that is none and one that is none."""
        return 0 < k < len(words) and len(words[k]) > 1 and words[k][0] == " " and not words[k][1].isspace() and not words[k - 1][-1].isspace()

    def own_tokens(start: int, end: int, body: str) -> int:
        """Tokens of a piece encoded by itself: those of the text, but for its head if that begins inside a word, and its end if that is blank."""
        last = int(np.searchsorted(word_token, end))
        if word_token[last] == end and not body[-1].isspace():
            k = int(np.searchsorted(word_token, start))
            if word_token[k] == start:
                return end - start
            while k < last and not begins_anywhere(k):
                k += 1
            if k < last:
                return int(bpe.count([piece(start, int(word_token[k]))])[0]) + end - int(word_token[k])
        return int(bpe.count([body])[0])

    def cut(start: int, limit: int) -> int:
        """Where the piece from `start` ends."""
        if total - start <= limit:
            return total
        low, high = start + max(int(limit * LEAST_FILL), overlap + 1), start + limit
        first, last = np.searchsorted(gap_token, (low, high + 1))
        if first < last:
            inside = depth[first:last]
            return int(gap_token[last - 1 - int(inside[::-1].argmax())])
        end = int(word_token[int(np.searchsorted(word_token, high, side="right")) - 1])
        if end < low:
            end = high
            while end > low and not begins_char(end):
                end -= 1
        return end

    out: list[tuple[int, int, int, int, str]] = []
    start, limit = 0, max_tokens
    while True:
        end = cut(start, limit)
        body = piece(start, end)
        over = own_tokens(start, end, body) - max_tokens
        if over > 0:  # cut apart from its neighbours the text may need more tokens: try a shorter piece
            if limit <= overlap + 1:
                raise ValueError(f"no piece of {max_tokens} tokens at token {start} is longer than the overlap")
            limit = max(limit - over, overlap + 1)
            continue
        out.append((start, end, end - start, overlap if out else 0, body))
        if end >= total:
            return out
        start, limit = end - overlap, max_tokens


def split_oversized(df: DataFrame, key: str, text: str, path: str, max_tokens: int, overlap: int) -> DataFrame:
    """(key, piece_no, first_token, end_token, n_tokens, shared_tokens, text) for every row over the limit.

    A map without shuffle; rows that fit, null and empty texts give no row. Other columns are dropped.
    """
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("the overlap must be less than half of max_tokens")
    source = df.select(df[key].alias("__key"), df[text].alias("__text"))
    fields = [("piece_no", T.IntegerType()), ("first_token", T.LongType()), ("end_token", T.LongType()), ("n_tokens", T.LongType()), ("shared_tokens", T.LongType()), ("text", T.StringType())]
    schema = T.StructType([T.StructField(key, source.schema["__key"].dataType), *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, terms = load(path), Terms()
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                rows, owners = [], []
                for i, *rest in bpe.encoded_over(texts[a:b], max_tokens):
                    for n, p in enumerate(split_encoded(texts[a + i], *rest, bpe, max_tokens, overlap, terms)):
                        rows.append((n + 1, *p))
                        owners.append(a + i)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *columns], names=schema.names)

    return source.mapInArrow(run, schema)
