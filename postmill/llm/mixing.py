"""Sources mixed to target weights.

The largest mixture is built in which every source has its share and no document is used more often than its source
allows. The order is a Pfair schedule: a source of weight w has its block j released at slot floor(j / w) with
deadline ceil((j + 1) / w), and the released block with the earliest deadline goes next, so that at every moment a
source is less than one block away from its share.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.session import checkpointed

#: Sources read to the driver, blocks of the schedule (slots), and documents of a hash bucket on average.
MAX_SOURCES, BLOCKS, BUCKET_DOCUMENTS = 1000, 4096, 50_000
_HASH = 1 << 40


@dataclass(frozen=True)
class Share:
    """What one source gives: its tokens, quota, whole passes and the rest of the quota after them."""

    source: str
    target: float
    max_repeats: int
    available: int
    quota: float

    @property
    def passes(self) -> int:
        return min(self.max_repeats, int(self.quota // self.available)) if self.available else 0

    @property
    def rest(self) -> float:
        return 0.0 if self.passes == self.max_repeats else self.quota - self.passes * self.available


def plan(weights: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None) -> list[Share]:
    """Quotas of all sources. Sources without tokens or weight give nothing, the others keep their proportions.

    The total is the largest that respects every source's cap, or `total` if that is smaller.
    """
    live = {s: w for s, w, r in weights if w > 0 and r > 0 and available.get(s, 0) > 0}
    norm = sum(live.values())
    most = min((available[s] * r * norm / live[s] for s, _, r in weights if s in live), default=0.0)
    size = most if total is None else min(most, total)
    return [Share(s, w, r, available.get(s, 0), size * live[s] / norm if s in live else 0.0) for s, w, r in weights]


def pfair(shares: dict[str, float], n_blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) by earliest deadline first among the released blocks; idle slots are skipped over.

    `shares` are the weights (their sum at most 1); ties in the deadline go to the smaller weight, then the name.
    """
    order: list[tuple[str, int, int]] = []
    waiting = [(0, s, 0) for s in sorted(shares) if n_blocks.get(s, 0) > 0]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, float, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((j + 1) / shares[s] - 1e-9), shares[s], s, j))
        _, w, s, j = heapq.heappop(ready)
        order.append((s, j, slot))
        if j + 1 < n_blocks[s]:
            heapq.heappush(waiting, (math.floor((j + 1) / w + 1e-9), s, j + 1))
        slot += 1
    return order


def canonical_source(source: Column) -> Column:
    """Lower case, trimmed, with runs of blanks and hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def available_tokens(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Tokens per source and of the largest document; at most MAX_SOURCES rows come to the driver, `docs` holds sources of the weights only."""
    rows = docs.groupBy("source").agg(F.sum("n_tokens"), F.max("n_tokens")).collect()
    return {r[0]: r[1] for r in rows}, max((r[2] for r in rows), default=1)


def mixture(docs: DataFrame, shares: list[Share], largest: int, key: str = "doc_id", blocks: int = BLOCKS) -> DataFrame:
    """(slot, position, source, key, copy, n_tokens): every used copy of every document, in schedule order.

    `docs`: key, source, n_tokens (rows with 0 tokens or another source give nothing). Within a source documents
    stand in an order drawn from the hash of their key; a whole pass uses all of them once, the last pass those that lie wholly within the
    rest of the quota, and then the one further document that comes nearest to what is still missing, if that is nearer than none. position counts
    the tokens of the source before the copy. A block has at least the size of the largest document. Sums run over hash buckets of about
    BUCKET_DOCUMENTS documents, so no source passes through one task.
    """
    spark = docs.sparkSession
    live = [s for s in shares if s.quota > 0]
    size = sum(s.quota for s in live)
    counts = dict(docs.filter(F.col("n_tokens") > 0).groupBy("source").count().collect())  # one number per source
    rows = [(s.source, s.passes, float(s.rest), s.available, -(-counts.get(s.source, 1) // BUCKET_DOCUMENTS)) for s in live]
    about = F.broadcast(spark.createDataFrame(rows, "source string, passes int, rest double, available long, buckets long"))  # at most MAX_SOURCES rows
    h = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(_HASH))
    used = docs.filter(F.col("n_tokens") > 0).select(key, "source", "n_tokens").join(about, "source").withColumn("h", h).withColumn("bucket", F.floor(F.col("h").cast("double") / _HASH * F.col("buckets")).cast("long"))
    totals = used.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = totals.withColumn("before", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = used.join(before.drop("in_bucket"), ["source", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = checkpointed(placed.drop("before", "bucket", "buckets"))
    end = F.col("start") + F.col("n_tokens")
    filled = placed.filter(end <= F.col("rest")).groupBy("source").agg(F.max(end).alias("filled"))
    missing = about.join(filled, "source", "left").select("source", F.coalesce("filled", F.lit(0)).cast("long").alias("filled"), (F.col("rest") - F.coalesce("filled", F.lit(0))).alias("missing"))
    off = F.abs(F.col("n_tokens") - F.col("missing"))
    last = placed.filter(end > F.col("rest")).join(F.broadcast(missing), "source").filter(off < F.col("missing")).groupBy("source", "filled").agg(F.min_by(key, F.struct(off, "h", key)).alias("__last"))
    chosen = placed.join(F.broadcast(last), "source", "left").withColumn("extra", F.coalesce(F.col(key) == F.col("__last"), F.lit(False)) & (end > F.col("rest")))
    copies = F.col("passes") + ((end <= F.col("rest")) | F.col("extra")).cast("int")
    at = F.when(F.col("extra") & (F.col("copy") > F.col("passes")), F.col("filled")).otherwise(F.col("start"))
    each = chosen.withColumn("copies", copies).filter("copies > 0").select(key, "source", "n_tokens", "available", "start", "extra", "passes", "filled", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    each = each.select(key, "source", "n_tokens", "available", at.alias("start"), "copy")
    block_size = max(size / blocks, largest, 1.0)
    each = each.withColumn("position", (F.col("copy") - 1) * F.col("available") + F.col("start")).withColumn("block", F.floor((F.col("position") + F.col("n_tokens") / 2) / F.lit(block_size)).cast("int"))
    n_blocks = {s.source: int(s.quota / block_size) + 2 for s in live}
    order = pfair({s.source: s.quota / size for s in live}, n_blocks)
    slots = F.broadcast(spark.createDataFrame(order, "source string, block int, slot int"))
    # the last document of a source may begin in a block past its quota: it goes with the source's last block
    final = F.broadcast(spark.createDataFrame([(s, n - 1) for s, n in n_blocks.items()], "source string, last int"))
    return each.join(final, "source").withColumn("block", F.least("block", "last")).join(slots, ["source", "block"]).select("slot", "position", "source", key, "copy", "n_tokens")


def report(mixed: DataFrame, shares: list[Share], key: str = "doc_id") -> DataFrame:
    """One row per source: target and actual share, tokens available and used, documents and the most repeats."""
    spark = mixed.sparkSession
    rows = [(s.source, float(s.target), int(s.max_repeats), int(s.available)) for s in shares]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum((F.col("copy") == 1).cast("long")).alias("documents"), F.max("copy").alias("most_repeats"))
    total = got.agg(F.sum("tokens"))
    out = targets.join(F.broadcast(got), "source", "left").select("source", "target_share", "max_repeats", "available_tokens", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_repeats")))
    return out.withColumn("actual_share", F.round(F.try_divide(F.col("tokens"), total.scalar()), 6))
