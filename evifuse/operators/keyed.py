"""Per-key ordered work that survives one key holding a large part of all rows.

Two tools cover every rule of this library:

* ``latest`` answers unbounded questions ("the last value at or before t", "the next one after", "how many so far"). Cold
  keys are one window group each. The rows of hot keys, however many, are dealt by range of (key, order) into slices of
  about equal size, ties included; what a slice leaves behind is one small row, carried over the slices after it.
* ``into_slices`` answers *bounded* questions ("within W of t") by cutting time into slices and copying the rows near a slice
  edge into the neighbour slice.

A null key is a key like any other.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.session import cut

HOUR = 3_600_000_000
MINUTE = 60_000_000

# A key with more rows than this is cut into slices of about so many.
HOT_ROWS = 2_000_000
SLICE_ROWS = 500_000


def same_keys(keys: list[str], prefix: str = "_k_") -> Column:
    """Null-safe equality of ``keys`` with the columns of the same name and prefix."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def split_hot(
    df: DataFrame, keys: list[str], order: list[str], min_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of cold keys, rows of hot keys with ``_slice``); None where no key has more than ``min_rows`` rows.

    Slices are ranges of (keys, order), written once, so that no slice is much larger than ``slice_rows`` whatever
    the order's values.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot")).where(F.col("_hot") > min_rows)
    total = counts.agg(F.sum("_hot")).first()[0]
    if not total:
        return df, None
    hot = cut(counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_hot"), "hot-keys")
    marked = df.join(hot, same_keys(keys), "left").drop(*[f"_k_{k}" for k in keys])
    dealt = marked.where("_hot is not null").drop("_hot").repartitionByRange(max(1, -(-total // slice_rows)), *keys, *order)
    return marked.where("_hot is null").drop("_hot"), cut(dealt.withColumn("_slice", F.spark_partition_id()), "slices")


def latest(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    back: dict[str, Column] | None = None,
    ahead: dict[str, Column] | None = None,
    counts: dict[str, Column] | None = None,
    strict: bool = False,
    min_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Running values of each row's key, in ascending ``order``, as columns with the given names.

    ``back``: the last non-null value up to the row, ``ahead``: the first one from the row on, ``counts``: the number of non-null
    values up to the row. With ``strict`` the row itself is left out.
    """
    back, ahead, counts = back or {}, ahead or {}, counts or {}
    d = df
    for name, value in {**back, **ahead, **counts}.items():
        d = d.withColumn(f"_v_{name}", value)
    near = -1 if strict else 0

    def running(frame: DataFrame, group: list[str]) -> DataFrame:
        asc = Window.partitionBy(*group).orderBy(*map(F.asc, order)).rowsBetween(Window.unboundedPreceding, near)
        desc = Window.partitionBy(*group).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, near)
        return frame.select(
            "*",
            *[F.last(f"_v_{n}", ignorenulls=True).over(asc).alias(f"_l_{n}") for n in back],
            *[F.count(f"_v_{n}").over(asc).alias(f"_l_{n}") for n in counts],
            *[F.last(f"_v_{n}", ignorenulls=True).over(desc).alias(f"_l_{n}") for n in ahead],
        )

    names = [*back, *ahead, *counts]
    cold, hot = split_hot(d, keys, order, min_rows, slice_rows)
    plain = running(cold, keys).select(*df.columns, *[F.col(f"_l_{n}").alias(n) for n in names])
    if hot is None:
        return plain
    place = F.struct(*order)
    at = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), place)
    ends = hot.groupBy(*keys, "_slice").agg(
        *[F.max_by(f"_v_{n}", at(n)).alias(f"_e_{n}") for n in back],
        *[F.min_by(f"_v_{n}", at(n)).alias(f"_e_{n}") for n in ahead],
        *[F.count(f"_v_{n}").alias(f"_e_{n}") for n in counts],
    )
    # One row per slice; a key has as many as its rows fill.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = cut(
        ends.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k__slice"),
            *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in back],
            *[F.last(f"_e_{n}", ignorenulls=True).over(after).alias(f"_c_{n}") for n in ahead],
            *[F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in counts],
        ),
        "carry",
    )
    whole = running(hot, [*keys, "_slice"]).join(carry, same_keys([*keys, "_slice"]), "left")
    return plain.unionByName(whole.select(
        *df.columns,
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in (*back, *ahead)],
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in counts],
    ))


def last_before(
    df: DataFrame, key: str, order: list[str], values: dict[str, Column], min_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """For each row, the last non-null of each value among the key's earlier rows; ``order`` is unique within the key."""
    return latest(df, [key], order, back=values, strict=True, min_rows=min_rows, slice_rows=slice_rows)


def into_slices(df: DataFrame, first_us: Column, last_us: Column, slice_us: int) -> DataFrame:
    """One copy of each row for every slice that [first_us, last_us] touches."""
    return df.withColumn(
        "_slice",
        F.explode(F.sequence(F.floor(first_us / slice_us), F.floor(last_us / slice_us))),
    )


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by aggregation, so hot keys combine map-side."""
    rest = [c for c in df.columns if c != key and c not in order]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest)])
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each key with their 1-based rank.

    The rank filter is pushed below the shuffle as a per-task group limit, so a hot
    key sends at most k rows per task. Larger k than that limit allows is reduced
    per task group first.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if k > 1000:
        parts = df.withColumn("_p", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
        wp = Window.partitionBy(*keys, "_p").orderBy(*order)
        df = parts.withColumn("_pr", F.row_number().over(wp)).where(F.col("_pr") <= k).drop("_p", "_pr")
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)
