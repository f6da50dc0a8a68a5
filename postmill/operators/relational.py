"""Relational building blocks: deduplication with an order, patches, keys, profiles, samples and checks."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.session import checkpointed


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise MissingColumns(f"missing columns: {', '.join(lacking)}")
    return df


def keep_available(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of `names` that exist, in that order, with a warning that names the others."""
    if lacking := [n for n in names if n not in df.columns]:
        warnings.warn(f"missing columns: {', '.join(lacking)}", stacklevel=2)
    return df.select(*(n for n in names if n in df.columns))


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`. Nulls are a key like any other.

    A hash aggregate on the smallest row, so a hot key is combined before the shuffle instead of filling one
    window partition. `order` must tell all rows of a key apart, or an arbitrary one of the tied is kept.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*((F.col(c) if c in keys else F.col("__row")[c]).alias(c) for c in df.columns))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in `order`."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*((F.col(c) if c in keys else F.col("__row")[c]).alias(c) for c in df.columns))


def number_rows(df: DataFrame, order: list[str], name: str = "job_id", start: int = 1) -> DataFrame:
    """Consecutive numbers in the order of the columns, without a single-partition window.

    Rows are sorted into range partitions; their counts, one per partition, come to the driver as offsets, and each partition
    numbers its rows as they stand. Equal rows are numbered in any order.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in ranged.groupBy("__part").count().collect()}
    offsets, total = {}, start
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]
    kept = [i for i, c in enumerate(ranged.columns) if c not in ("__part", name)]
    fields = [f for f in ranged.schema.fields if f.name not in ("__part", name)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows:
                first = offsets[batch.column(batch.num_columns - 1)[0].as_py()] + seen
                seen += batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(np.arange(first, first + batch.num_rows))], names=[*(batch.schema.names[i] for i in kept), name])

    return ranged.mapInArrow(number, T.StructType([*fields, T.StructField(name, T.LongType())]))


def patch(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`base` with `columns` overwritten, with nulls too, where `updates` has the key; `updates` must be unique by it."""
    new = updates.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__new_{c}") for c in columns), F.lit(True).alias("__hit"))
    joined = base.join(new, base[key] == F.col("__key"), "left")
    return joined.select(*((F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(base[c]).alias(c) if c in columns else base[c]) for c in base.columns))


def unprocessed(base: DataFrame, log: DataFrame, key: str, failed: Column, force: DataFrame | None = None) -> DataFrame:
    """Rows whose key has no success in the log, and those of `force` in any case."""
    done = log.filter(~F.coalesce(failed, F.lit(False))).select(key).distinct()
    if force is not None:
        done = done.join(force.select(key).distinct(), key, "left_anti")
    return base.join(done, key, "left_anti")


def enrich_titles(base: DataFrame, answers: DataFrame, key: str = "url") -> DataFrame:
    """`base` with standardized_title and status from the last answer per key.

    status: "no_title" (blank title, dropped by callers), "no_answer" (none or an error: title ""), "invalid"
    (the answer says it is no job, dropped by callers), else "ok".
    """
    a = answers.select(F.col(key).alias("__key"), F.col("standardized_title").alias("__title"), "is_valid_job", "error", F.lit(True).alias("__hit"))
    j = base.join(a, base[key] == F.col("__key"), "left")
    status = (
        F.when(base["job_title"].isNull() | ~base["job_title"].rlike(r"\S"), "no_title").when(F.col("__hit").isNull() | F.col("error").isNotNull(), "no_answer").when(~F.col("is_valid_job"), "invalid").otherwise("ok")
    )
    return j.select(*(base[c] for c in base.columns), F.when(status == "ok", F.coalesce("__title", F.lit(""))).otherwise("").alias("standardized_title"), status.alias("status"))


def halves(df: DataFrame, order: str) -> DataFrame:
    """`df` with column half (1 or 2): the first floor(n / 2) rows in `order` and the rest."""
    numbered = number_rows(df, [order], "__n")
    n = df.count()
    return numbered.withColumn("half", F.when(F.col("__n") <= n // 2, 1).otherwise(2)).drop("__n")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """`df` with batch_id: consecutive groups of `size` rows from 0."""
    return number_rows(df, order, "__n").withColumn("batch_id", F.floor((F.col("__n") - 1) / size)).drop("__n")


def value_counts(df: DataFrame, column: str, with_null: bool = True) -> DataFrame:
    """(column, count, pct): pct of the counted rows, rounded to two places."""
    rows = df if with_null else df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).count()
    total = rows.agg(F.count("*"))
    return counts.withColumn("pct", F.round(F.try_divide(F.col("count") * 100.0, total.scalar()), 2))


def missing_profile(df: DataFrame, list_columns: tuple[str, ...] = (), digit_columns: tuple[str, ...] = ()) -> DataFrame:
    """(column, missing, pct) of columns with missing values: null or blank; lists also "[]" and lists of empty strings; digit columns lack a digit.

    One pass over the table, unpivoted afterwards.
    """

    def absent(c: str) -> Column:
        x = F.col(c).cast("string")
        none = x.isNull() | ~x.rlike(r"\S")
        if c in list_columns:
            return none | x.isin("[]", "['']", '[""]')
        return none | ~x.rlike(r"\d") if c in digit_columns else none

    counts = df.agg(F.count("*").alias("__n"), *(F.count_if(absent(c)).alias(c) for c in df.columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = counts.selectExpr("__n", f"stack({len(df.columns)}, {pairs}) as (column, missing)")
    return long.filter("missing > 0").select("column", "missing", F.round(F.col("missing") * 100.0 / F.col("__n"), 2).alias("pct"))


def collisions(df: DataFrame, column: str) -> DataFrame:
    """(folded, n, spellings): values that differ only by case or blanks at their ends."""
    key = F.lower(F.trim(column))
    return df.filter(F.col(column).isNotNull()).groupBy(key.alias("folded")).agg(F.countDistinct(column).alias("n"), F.array_sort(F.collect_set(column)).alias("spellings")).filter("n > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns...): distinct rows that only one of two tables has."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows, the same for the same keys and seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def calibration_sample(df: DataFrame, title: str, key: str, size: int = 50, major: int = 10, seed: int = 42) -> DataFrame:
    """One row of each title with at least `major` rows, filled up to `size` with one row of other titles.

    With more than `size` major titles a sample of them is taken. The choice is by hash of seed and key.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    one = df.filter(F.col(title).isNotNull()).groupBy(title).agg(F.count("*").alias("__n"), F.min(F.struct(h.alias("h"), F.col(key).alias("key"))).alias("x"))
    picked = one.orderBy((F.col("__n") < major).cast("int"), F.xxhash64(F.lit(seed), F.col(title)), title).limit(size)
    return picked.select(title, F.col("x.key").alias(key), F.col("__n").alias("title_rows"))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns of `names`; those it lacks are ignored."""
    return df.drop(*names)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """`df` with columns renamed by `names`; those it lacks are ignored. A new name that another column keeps is an error."""
    new = [names.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"names would stand twice: {', '.join(sorted({c for c in new if new.count(c) > 1}))}")
    return df.toDF(*new)


def first_value(df: DataFrame, by: str, value: str, order: list[Column]) -> DataFrame:
    """(by, value): the first non-null value of each group in `order`, null where a group has none."""
    return df.groupBy(by).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def counts_with_first(df: DataFrame, by: str, value: str, order: list[Column]) -> DataFrame:
    """(by, n, value): rows per group with its first non-null value, in one aggregate."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def first_appearance_ids(df: DataFrame, value: str, order: str, name: str = "id", start: int = 0) -> DataFrame:
    """(value, id): distinct non-null values numbered from `start` by where they first appear in `order`."""
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("__first"))
    return number_rows(first, ["__first", value], name, start).drop("__first")


def overlap(a: Column, b: Column) -> Column:
    """struct(both, either): the sorted intersection and union of two arrays, a null array as an empty one."""
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in (a, b))
    return F.struct(F.array_sort(F.array_intersect(x, y)).alias("both"), F.array_sort(F.array_union(x, y)).alias("either"))


def flat_pieces(joined: Column, mark: str = "|") -> Column:
    """The distinct non-empty pieces of an array of joined texts, in order."""
    pieces = F.flatten(F.transform(joined, lambda t: F.split(F.coalesce(t, F.lit("")), "[" + mark + "]", -1)))
    return F.array_distinct(F.filter(pieces, lambda p: p != ""))


def joined_keys(counts: Column) -> Column:
    """The keys of a map in order, joined by ", "."""
    return F.array_join(F.array_sort(F.map_keys(counts)), ", ")


def job_url(url: Column) -> Column:
    """Whether a URL ends in a hyphen and a job number of three to five digits."""
    return F.coalesce(url.rlike(r"-\d{3,5}$"), F.lit(False))
