"""How often items stand together, and how much more often than by chance.

Baskets are turned into binary sparse item blocks; every task sums the products of the transposed blocks over its
record blocks (a blocked Gram matrix) and emits each non-zero pair once, so that what is shuffled is bounded by the
item pairs per task and not by the records. Counts are then normalised by the expected marginals, which are the matrix's diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import checkpointed

#: Records of a block; different items up to which a block's product is taken with dense columns; products formed at once.
RECORD_BLOCK, DENSE_ITEMS, PRODUCTS = 8192, 1024, 4_000_000
#: Different pairs a task holds before it emits what it has.
HELD_PAIRS = 4_000_000


def _products(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair codes, counts) of the transposed product of one block: `flat` holds the records' items end to end.

    A code is item_a << 32 | item_b with item_a <= item_b. Few different items: one dense product. Many: the non-zero products of the
    sparse columns, at most PRODUCTS at once whatever the length of a record, summed by sorting.
    """
    items, code = np.unique(flat, return_inverse=True)
    if len(items) <= DENSE_ITEMS:
        x = np.zeros((len(sizes), len(items)), dtype=np.float32)
        x[np.repeat(np.arange(len(sizes)), sizes), code] = 1
        m = x.T @ x  # sums of at most RECORD_BLOCK ones are exact
        a, b = np.nonzero(np.triu(m))
        yield items[a] << 32 | items[b], m[a, b].astype(np.int64)
        return
    order = np.lexsort((flat, np.repeat(np.arange(len(sizes)), sizes)))
    flat = flat[order]
    ends = np.repeat(np.cumsum(sizes), sizes)
    follow = ends - np.arange(len(flat))  # partners from the item itself to the end of its record
    cuts = np.cumsum(follow)
    begin = 0
    while begin < len(flat):
        done = cuts[begin - 1] if begin else 0
        end = max(int(np.searchsorted(cuts, done + PRODUCTS, side="right")), begin + 1)
        left = np.repeat(np.arange(begin, end), follow[begin:end])
        right = left + np.arange(len(left)) - np.repeat(cuts[begin:end] - follow[begin:end] - done, follow[begin:end])
        yield np.unique(flat[left] << 32 | flat[right], return_counts=True)
        begin = end


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def gram(baskets: DataFrame, items: str = "items") -> DataFrame:
    """(item_a, item_b, n): records with both items, item_a <= item_b; the diagonal holds the item counts.

    `baskets` has one array<int> of distinct non-negative items per record; null and empty arrays count nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            codes, n = parts[0]
            return pa.RecordBatch.from_arrays([pa.array(codes >> 32, pa.int32()), pa.array(codes & 0xFFFFFFFF, pa.int32()), pa.array(n)], names=["item_a", "item_b", "n"])

        for batch in batches:
            lists = batch.column(0)
            for begin in range(0, len(lists), RECORD_BLOCK):
                part = lists.slice(begin, RECORD_BLOCK)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for codes, n in _products(flat, sizes) if len(flat) else ():
                    parts.append((codes, n))
                    held += len(codes)
                    if held > HELD_PAIRS or len(parts) > 64:
                        parts[:] = [_summed(parts)]
                        held = len(parts[0][0])
                        if held > HELD_PAIRS // 2:
                            yield emit()
                            parts.clear()
                            held = 0
        if parts:
            parts[:] = [_summed(parts)]
            yield emit()

    partial = baskets.select(items).mapInArrow(run, "item_a int, item_b int, n long")
    return partial.groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def associations(baskets: DataFrame, items: str = "items", least: int = 1, least_share: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift) for all pairs item_a < item_b in at least `least` records and `least_share` of all.

    n counts the rows of `baskets`, those without items included. lift is n * n_ab / (n_a * n_b), how many times as often as if the
    items were independent. Items too rare for any such pair leave the baskets before products are formed. The matrix is formed
    once, pairs and marginals are read from it.
    """
    n = baskets.count()
    bound = max(least, int(np.ceil(least_share * n - 1e-9)))
    kept = baskets
    if bound > 1:
        counts = baskets.select(F.explode(items).alias("item")).groupBy("item").count().filter(F.col("count") >= bound)
        # with a share, at most (mean size of a basket) / least_share items are frequent; without one the list may be long
        frequent = counts.agg(F.array_sort(F.collect_list("item")).alias("f")) if least_share > 0 else None
        if frequent is not None:
            kept = baskets.select(F.array_intersect(items, frequent.scalar()).alias(items))
    found = checkpointed(gram(kept, items))
    single = found.filter(F.col("item_a") == F.col("item_b"))
    pairs = found.filter((F.col("item_a") < F.col("item_b")) & (F.col("n") >= bound)).withColumnRenamed("n", "n_ab")
    return (
        pairs.join(single.select("item_a", F.col("n").alias("n_a")), "item_a")
        .join(single.select("item_b", F.col("n").alias("n_b")), "item_b")
        .withColumn("n", F.lit(n).cast("long"))
        .withColumn("lift", F.col("n") * F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b")))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift")
    )


def baskets_of(mentions: DataFrame, record: str, item: str) -> DataFrame:
    """(items): one array of distinct items per record, from rows (record, item); null and 0 items are left out, null records too.

    A record without items has an empty array. Repeats are dropped before the shuffle, so a record that holds a third of all rows leaves a
    task with at most as many items as there are.
    """
    items: Column = F.collect_set(F.when(F.col(item) > 0, F.col(item)))
    return mentions.filter(F.col(record).isNotNull()).groupBy(F.col(record).alias("record")).agg(items.alias("items")).select("items")
