"""The language of documents and of each segment of mixed ones, by a byte-level convolutional network.

The network embeds nothing: a filter of width w is w tables of 256 entries, one per byte value, summed along the
window; the maximum over the window (max pooling) of all filters of all widths feeds a softmax. It is trained in numpy on a
bounded sample of labelled texts and applied to all windows of all texts, paragraph by paragraph. Labels of the
training texts may be wrong: after a first round the samples on which the network disagrees with confidence are
dropped and training goes on.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Languages told apart, by their two-letter code, with their three-letter codes.
LANGUAGES = {"vi": ("vie",), "en": ("eng",), "ja": ("jpn",), "ko": ("kor",), "fr": ("fra", "fre"), "de": ("deu", "ger")}
WINDOW = 128
#: Filters per width.
FILTERS = {2: 8, 3: 24, 4: 32}
#: Bounds of the labelled sample: texts per language, windows per text.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 500, 4
#: Texts of the sample have at least SHORTEST characters; OVERDRAWN times SAMPLE_TEXTS hashes are ranked.
SHORTEST, OVERDRAWN = 40, 3
EPOCHS, BATCH, RATE, SEED = 10, 128, 0.004, 7
#: Windows classified at once; bounds the memory of a task.
CHUNK_WINDOWS = 32


def canonical_label(label: Column) -> Column:
    """The two-letter code a label means, null if it means none: case, region and three-letter codes are forms of it."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_][a-z0-9]+)*$", 1)
    return reduce(lambda out, x: F.when(base.isin(x[0], *x[1]), F.lit(x[0])).otherwise(out), LANGUAGES.items(), F.lit(None).cast("string"))


_BLANK_LINE = re.compile(r"\n(?:[^\S\n]*\n)+")
#: A word: two or more letters that stand free of digits, underscores and hyphens, or a letter of a script without blanks.
_WORD = re.compile(r"(?<![\w-])[^\W\d_]{2,}(?![\w-])|[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")


_TABLE = bytes.maketrans(b"123456789\t", b"000000000 ")
_RUNS = re.compile(rb"([0 ])\1+")


def paragraphs(text: str) -> list[str]:
    """Non-blank stretches between blank lines, in order; any kind of line end counts."""
    t = re.sub(r"\r\n?|[\x0b\x0c\x85\u2028\u2029]", "\n", text)
    return [p for p in _BLANK_LINE.split("\n\n" + t + "\n\n") if p.strip()]


def plain(text: str) -> bytes:
    """What the network reads of a text: UTF-8 of its composed lower-case form, digits as 0, runs of blanks or digits as one."""
    t = text.lower()
    if not t.isascii() and not unicodedata.is_normalized("NFC", t):
        t = unicodedata.normalize("NFC", t)
    return _RUNS.sub(rb"\1", t.encode().translate(_TABLE))


def cut(data: bytes) -> bytes:
    """All of `data` as consecutive windows end to end: the last one aligned to its end, a short text padded with zeros."""
    n = len(data)
    if n <= WINDOW:
        return data.ljust(WINDOW, b"\0")
    return data[: n - n % WINDOW] + data[-WINDOW:] if n % WINDOW else data


def windows(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW bytes."""
    return np.frombuffer(cut(plain(text)), dtype=np.uint8).reshape(-1, WINDOW)


class ByteConv:
    """Multi-width byte filters, max pooling and softmax."""

    def __init__(self, n_classes: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, 256, f)).astype(np.float32) for w, f in FILTERS.items()}
        self.bias = {w: np.zeros(f, dtype=np.float32) for w, f in FILTERS.items()}
        self.out = rng.normal(0, 0.1, (sum(FILTERS.values()), n_classes)).astype(np.float32)
        self.out_bias = np.zeros(n_classes, dtype=np.float32)

    def _pool(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, at = [], []
        for w, table in self.tables.items():
            n = x.shape[1] - w + 1
            s = table[0][x[:, :n]]
            for k in range(1, w):
                s += table[k][x[:, k : k + n]]
            if where:
                at.append(s.argmax(axis=1))
            pooled.append(s.max(axis=1) + self.bias[w])
        return np.concatenate(pooled, axis=1), at

    def freeze(self) -> None:
        """Sum the tables of neighbouring bytes once for all byte pairs, so that a window needs one look-up per position.

        Call it when training is over: _pool_frozen gives what _pool gives, in fewer steps.
        """
        two, three, four = (self.tables[w] for w in (2, 3, 4))
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(256 * 256, -1)
        self.pairs = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])], axis=1)
        self.third = three[2]
        self.frozen_bias = np.concatenate([self.bias[w] for w in (2, 3, 4)])

    def _pool_frozen(self, x: np.ndarray) -> np.ndarray:
        # positions come first, so that the maximum runs over whole contiguous rows
        a, b, c = (FILTERS[w] for w in (2, 3, 4))
        xt = np.ascontiguousarray(x.T)
        g = self.pairs.take(xt[:-1].astype(np.int64) * 256 + xt[1:], axis=0, mode="clip")
        three = g[:-1, :, a : a + b] + self.third.take(xt[2:].astype(np.int64), axis=0, mode="clip")
        four = g[:-2, :, a + b : a + b + c] + g[2:, :, a + b + c :]
        return np.concatenate([g[:, :, :a].max(axis=0), three.max(axis=0), four.max(axis=0)], axis=1) + self.frozen_bias

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, classes) of natural logarithms."""
        rows = []
        pool = self._pool_frozen if hasattr(self, "pairs") else lambda part: self._pool(part)[0]
        for b in range(0, len(x), CHUNK_WINDOWS):
            h = np.maximum(pool(x[b : b + CHUNK_WINDOWS]), 0)
            z = h @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            rows.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(rows) if rows else np.zeros((0, len(self.out_bias)), dtype=np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        """Adam on the weighted cross-entropy, whole batches in an order drawn from `rng`."""
        params = [*self.tables.values(), *self.bias.values(), self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            rate = RATE * (0.5 if epoch >= epochs // 2 else 1)
            for b in range(0, len(order), BATCH):
                pick = order[b : b + BATCH]
                xb, yb, wb = x[pick], y[pick], weight[pick]
                h0, at = self._pool(xb, True)
                h = np.maximum(h0, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                g = (p * (wb / wb.sum())[:, None]).astype(np.float32)
                gh = (g @ self.out.T) * (h0 > 0)
                grads_t, grads_b, left = [], [], 0
                for (w, table), a in zip(self.tables.items(), at):
                    f = table.shape[2]
                    part = gh[:, left : left + f]
                    left += f
                    gt = np.zeros_like(table)
                    cols = np.broadcast_to(np.arange(f), a.shape)
                    for k in range(w):
                        byte = np.take_along_axis(xb, a + k, axis=1)
                        gt[k] = np.bincount((byte.astype(np.int64) * f + cols).ravel(), part.ravel(), 256 * f).reshape(256, f)
                    grads_t.append(gt)
                    grads_b.append(part.sum(axis=0))
                grads = [*grads_t, *grads_b, h.T @ g, g.sum(axis=0)]
                step += 1
                for p_, g_, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g_ - m)
                    v += 0.001 * (g_ * g_ - v)
                    p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit(texts: list[str], labels: list[str]) -> ByteConv:
    """Train on labelled texts, some of whose labels are wrong; classes weigh alike however many texts they have."""
    rng = np.random.default_rng(SEED)
    codes = {c: i for i, c in enumerate(LANGUAGES)}
    xs, ys = [], []
    for t, lab in zip(texts, labels):
        for p in paragraphs(t)[:SAMPLE_WINDOWS]:
            if len(_WORD.findall(p)) >= 3:
                w = windows(p)
                xs.append(w[rng.integers(len(w))])
                ys.append(codes[lab])
                # a short stretch as well: headings and remarks are that short
                if w[0].all():
                    cut = np.zeros(WINDOW, dtype=np.uint8)
                    n = int(rng.integers(24, 72))
                    cut[:n] = w[0][:n]
                    xs.append(cut)
                    ys.append(codes[lab])
    model = ByteConv(len(LANGUAGES))
    if not xs:
        return model
    x, y = np.stack(xs), np.array(ys)

    def weights(keep: np.ndarray) -> np.ndarray:
        n = np.bincount(y[keep], minlength=len(LANGUAGES))
        return (1 / np.maximum(n, 1))[y] * keep

    # a wrong label is rare among all texts of its true language but may be common among those of a rare label:
    # the first network sees the sample as it is, and only samples whose label it would give are kept
    everything = np.ones(len(y), dtype=bool)
    model.train(x, y, np.ones(len(y)), EPOCHS // 2, rng)
    for epochs in (EPOCHS // 2, EPOCHS):
        trusted = model.log_probabilities(x).argmax(axis=1) == y
        if len(np.unique(y[trusted])) < len(np.unique(y)):
            trusted = everything
        model = ByteConv(len(LANGUAGES))
        model.train(x[trusted], y[trusted], weights(trusted)[trusted], epochs, rng)
    return model


def labelled_sample(texts: DataFrame, text: str, label: str) -> DataFrame:
    """(text, lang): of each language the SAMPLE_TEXTS different labelled texts with the smallest hashes, all where there are fewer.

    Copies of a text count once. The hashes are cut at a bound that leaves about OVERDRAWN times as many before they are ranked, so that no more
    than that reaches one task; a label without enough texts is not cut. Texts under SHORTEST characters teach nothing.
    """
    known = texts.select(F.col(text).alias("text"), canonical_label(F.col(label)).alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") >= SHORTEST))
    hashed = known.withColumn("h", F.xxhash64("text"))
    n = {r[0]: r[1] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}  # at most one row per language
    top = reduce(lambda out, x: F.when(F.col("lang") == x[0], F.lit(min(2**64 - 1, 2**64 * OVERDRAWN * SAMPLE_TEXTS // max(x[1], 1)) - 2**63)).otherwise(out), n.items(), F.lit(2**63 - 1))
    rows = hashed.filter(F.col("h") <= top).groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.filter(F.col("k") <= SAMPLE_TEXTS).select("text", "lang")


#: Networks already fitted in this process, by sample and parameters.
_fitted: dict[str, ByteConv] = {}


def fitted(rows: list[tuple[str, str]]) -> ByteConv:
    """The network of a sample (text, lang), fitted once per process; the order of the sample doesn't matter."""
    rows = sorted(rows)
    key = hashlib.sha256(repr((rows, WINDOW, FILTERS, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE, SEED)).encode()).hexdigest()
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = fit([t for t, _ in rows], [x for _, x in rows])
    return _fitted[key]


PARAGRAPH = T.StructType([T.StructField("para_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_chars", T.IntegerType())])


def segments(rows: DataFrame, model: ByteConv) -> DataFrame:
    """`rows` with text, its last column, replaced by parts: an array of (para_no, lang, confidence, n_chars).

    Stretches without words have a null lang; null texts have no parts. Paragraphs are classified batch by batch,
    the parts leave as flat arrays.
    """
    shared = (model.tables, model.bias, model.out, model.out_bias)
    names = list(LANGUAGES)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("parts", T.ArrayType(PARAGRAPH))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteConv(len(names))
        net.tables, net.bias, net.out, net.out_bias = shared
        net.freeze()
        for batch in batches:
            offsets, para, chars, worded = [0], [], [], []
            waiting: list[bytes] = []
            best: list[np.ndarray] = []
            sure: list[np.ndarray] = []
            size = 0

            def flush() -> None:
                nonlocal size
                counts = np.array([len(w) // WINDOW for w in waiting])
                lp = net.log_probabilities(np.frombuffer(b"".join(waiting), dtype=np.uint8).reshape(-1, WINDOW))
                mean = np.add.reduceat(lp, np.r_[0, np.cumsum(counts)[:-1]], axis=0)
                best.append(mean.argmax(axis=1))
                sure.append(np.round(1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1), 6))
                waiting.clear()
                size = 0

            for t in batch.column(batch.num_columns - 1).to_pylist():
                ps = paragraphs(t) if t else []
                for k, p in enumerate(ps, 1):
                    para.append(k)
                    chars.append(len(p))
                    word = _WORD.search(p) is not None
                    worded.append(word)
                    if word:
                        waiting.append(cut(plain(p)))
                        size += len(waiting[-1])
                        if size > 32 * CHUNK_WINDOWS * WINDOW:
                            flush()
                offsets.append(len(para))
            if waiting:
                flush()
            has = np.array(worded, dtype=bool)
            code, confidence = np.zeros(len(has), dtype=np.int32), np.zeros(len(has))
            if best:
                code[has], confidence[has] = np.concatenate(best), np.concatenate(sure)
            lang = pa.array(np.array(names, dtype=object)[code], pa.string(), mask=~has)
            parts = pa.StructArray.from_arrays([pa.array(para, pa.int32()), lang, pa.array(confidence, mask=~has), pa.array(chars, pa.int32())], names=["para_no", "lang", "confidence", "n_chars"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def languages_of(texts: DataFrame, model: ByteConv, field: str = "field", item: str = "item_id", text: str = "text", label: str = "label") -> DataFrame:
    """(field, item, label, main, main_confidence, mixed, parts) of every text that has a word; a map without shuffle.

    parts: array of (para_no, lang, confidence, n_chars). main is the language with most characters, ties by code;
    mixed is whether two paragraphs differ. Null, blank and wordless texts give no row.
    """
    rows = segments(texts.select(F.col(field).alias("field"), F.col(item).alias("item_id"), canonical_label(F.col(label)).alias("label"), F.col(text).alias("text")), model)
    worded = F.filter("parts", lambda p: p["lang"].isNotNull())

    def total(code: str) -> Column:
        return F.struct(F.aggregate("parts", F.lit(0), lambda a, p: a + F.when(p["lang"] == code, p["n_chars"]).otherwise(0)).alias("n"), F.lit(code).alias("lang"))

    rows = rows.filter(F.exists("parts", lambda p: p["lang"].isNotNull()))
    rows = rows.withColumn("top", F.array_max(F.array(*(total(c) for c in LANGUAGES)))).withColumn("main", F.col("top.lang"))
    sure = F.aggregate(F.filter("parts", lambda p: p["lang"] == F.col("main")), F.lit(0.0), lambda a, p: a + p["confidence"] * p["n_chars"]) / F.col("top.n")
    return rows.select("field", "item_id", "label", "main", F.round(sure, 6).alias("main_confidence"), (F.size(F.array_distinct(F.transform(worded, lambda p: p["lang"]))) > 1).alias("mixed"), "parts")
