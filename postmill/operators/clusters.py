"""Average-linkage clustering of vectors with a distance threshold.

Two clusters can only merge below the threshold if some pair of their members is that close, so every cluster lies
in one connected component of the graph of close pairs. Pairs are found by blocked products, components by label
propagation, and each component is clustered exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import checkpointed, round_checkpointed

#: Vectors per block of the pairwise products.
BLOCK = 512
#: Components above this size are clustered from sums of vectors: their distance matrix would not fit a task.
MAX_MATRIX = 4_000


def close_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, distance) with a < b and cosine distance below `threshold`; zero and null vectors have no pairs.

    Blocks of rows meet each other once: each block is sent to the block pairs it belongs to, and one task
    multiplies two blocks. That is quadratic work, the price of exact pairs; use it on distinct names, not on
    mentions.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("blk"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = rows.select("id", "v", "blk", others).select("id", "v", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        ids, blk = pdf["id"].to_numpy(), pdf["blk"].to_numpy()
        left, right = blk == lo, blk == hi
        d = 1 - x[left] @ x[right].T
        i, j = np.nonzero(d < threshold)
        a, b = ids[left][i], ids[right][j]
        keep = (a < b) if lo == hi else (a != b)
        keep &= (norm[left][i, 0] > 0) & (norm[right][j, 0] > 0)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "distance": d[i, j][keep]})

    return sent.groupBy("lo", "hi").applyInPandas(product, "a long, b long, distance double")


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable by edges (a, b); ids without an edge are their own component.

    Label propagation with a jump to the label's own label in each round, so chains close in logarithmic rounds. Rounds go on
    until no label changes.
    """
    both = round_checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = round_checkpointed(ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        seen = both.join(now, both["b"] == now["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = now.join(seen, now["id"] == seen["a"], "left").select("id", F.least("component", F.coalesce("near", "component")).alias("label"), F.col("component").alias("before"))
        jump = now.select(F.col("id").alias("label"), F.col("component").alias("further"))
        new = round_checkpointed(step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("component"), "before"))
        now = new.select("id", "component")
        if new.filter("component < before").isEmpty():
            return now


def average_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster labels (smallest member position) of merges strictly below `threshold`; ties go to the smaller positions."""
    n = len(distance)
    d = distance.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, dtype=bool)
    nearest, nearest_d = d.argmin(axis=1), d.min(axis=1)
    for _ in range(n - 1):
        i = int(np.argmin(np.where(alive, nearest_d, np.inf)))
        if not nearest_d[i] < threshold:
            break
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        merged[[i, j]] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == label[j]] = label[i]
        stale = alive & ((nearest == i) | (nearest == j) | (np.arange(n) == i))
        for k in np.flatnonzero(stale):
            nearest[k], nearest_d[k] = d[k].argmin(), d[k].min()
        closer = alive & (d[i] < nearest_d)
        nearest[closer], nearest_d[closer] = i, d[i][closer]
    return label


def average_linkage_by_sums(x: np.ndarray, threshold: float) -> np.ndarray:
    """Like average_linkage for normalised vectors, without their distance matrix; equal distances may merge in another order.

    The average cosine distance of two clusters is 1 - (sum of one) . (sum of the other) / (sizes), so the sums are
    all that is kept. Nearest-neighbour chain: the order of merges doesn't change average linkage, and a cluster
    whose nearest is not below the threshold never gets a nearer one, so it is done.
    """
    label = np.arange(len(x))
    ids, sums, size = label.copy(), x.astype(np.float64), np.ones(len(x))
    active = np.ones(len(x), dtype=bool)
    chain: list[int] = []
    left = len(x)
    while left:
        if 2 * left < len(ids):  # forget what is merged or done
            place = np.cumsum(active) - 1
            chain = [int(place[k]) for k in chain]
            ids, sums, size = ids[active], sums[active], size[active]
            active = np.ones(left, dtype=bool)
        if not chain:
            chain.append(int(active.argmax()))
        i = chain[-1]
        d = 1 - (sums @ sums[i]) / (size * size[i])
        d[~active] = np.inf
        d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and (d[chain[-2]] <= d[j] or j in chain):
            j = chain[-2]
        if not d[j] < threshold:
            active[i] = False
            chain.pop()
        elif len(chain) > 1 and j == chain[-2]:
            del chain[-2:]
            i, j = (i, j) if ids[i] < ids[j] else (j, i)
            sums[i] += sums[j]
            size[i] += size[j]
            active[j] = False
            label[label == ids[j]] = ids[i]
        else:
            chain.append(j)
            continue
        left -= 1
    return label


def cluster(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster_id): average-linkage clusters by cosine distance, cluster_id the smallest member.

    Equal to clustering all vectors at once. A component is one task: its time is quadratic in its members, its
    memory in proportion to them above MAX_MATRIX.
    """
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    comp = checkpointed(components(close_pairs(vectors, threshold, id_col, vector), ids))
    rows = comp.join(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")), "id")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids_ = pdf["id"].to_numpy()
        if len(ids_) == 1:
            return pd.DataFrame({"id": ids_, "cluster_id": ids_})
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        label = average_linkage(1 - x @ x.T, threshold) if len(x) <= MAX_MATRIX else average_linkage_by_sums(x, threshold)
        return pd.DataFrame({"id": ids_, "cluster_id": ids_[label]})

    return rows.groupBy("component").applyInPandas(link, "id long, cluster_id long")


def short_names(names: DataFrame, threshold: int = 5, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(short, long): names of up to `threshold` characters, which cluster by equality only, and the others."""
    return names.filter(F.length(name) <= threshold), names.filter(F.length(name) > threshold)
