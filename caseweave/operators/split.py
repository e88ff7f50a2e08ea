"""Ordered per-group work that no single task has to hold.

A plain window puts a whole group into one task. Here a group is cut into buckets along
its own order: each bucket is worked on alone, one small row per bucket is aggregated
(map-side combined), and a window over those small rows carries the running value into
each bucket. The result is exact for any ``bucket`` expression that never falls along
the order. ``order`` is a list of ascending columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TMP = ["_k", "_b", "_carry"]


def _keyed(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    # Structs, so that null keys and null buckets join like any other value.
    k = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return df.withColumns({"_k": k, "_b": F.struct(bucket.alias("b"))})


def _carried(d: DataFrame, per_bucket: Column, over: Column) -> DataFrame:
    sums = d.groupBy("_k", "_b").agg(per_bucket.alias("_v"))
    return d.join(sums.select("_k", "_b", over.alias("_carry")), ["_k", "_b"])


def _before() -> Window:
    return Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def _after() -> Window:
    return Window.partitionBy("_k").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)


def _local(order: list[Column]):
    return Window.partitionBy("_k", "_b").orderBy(*order)


def split_row_number(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str = "rn") -> DataFrame:
    d = _keyed(df, keys, bucket)
    d = _carried(d, F.count(F.lit(1)), F.coalesce(F.sum("_v").over(_before()), F.lit(0)))
    return d.withColumn(out, F.row_number().over(_local(order)) + F.col("_carry")).drop(*_TMP)


def split_running_sum(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str = "total"
) -> DataFrame:
    d = _keyed(df, keys, bucket).withColumn("_x", value)
    d = _carried(d, F.sum("_x"), F.coalesce(F.sum("_v").over(_before()), F.lit(0)))
    w = _local(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.coalesce(F.sum("_x").over(w), F.lit(0)) + F.col("_carry")).drop("_x", *_TMP)


def split_running_max(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Largest value of the rows strictly before the current one."""
    d = _keyed(df, keys, bucket).withColumn("_x", value)
    d = _carried(d, F.max("_x"), F.max("_v").over(_before()))
    w = _local(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(out, F.greatest(F.max("_x").over(w), F.col("_carry"))).drop("_x", *_TMP)


def split_last(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str) -> DataFrame:
    """Last non-null value strictly before the current row."""
    d = _keyed(df, keys, bucket).withColumn("_x", value)
    last = F.max_by(F.col("_x"), F.when(F.col("_x").isNotNull(), F.struct(*order)))
    d = _carried(d, last, F.last("_v", ignorenulls=True).over(_before()))
    w = _local(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(out, F.coalesce(F.last("_x", ignorenulls=True).over(w), F.col("_carry"))).drop("_x", *_TMP)


def split_next(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str) -> DataFrame:
    """First non-null value strictly after the current row."""
    d = _keyed(df, keys, bucket).withColumn("_x", value)
    first = F.min_by(F.col("_x"), F.when(F.col("_x").isNotNull(), F.struct(*order)))
    d = _carried(d, first, F.first("_v", ignorenulls=True).over(_after()))
    w = _local(order).rowsBetween(1, Window.unboundedFollowing)
    return d.withColumn(out, F.coalesce(F.first("_x", ignorenulls=True).over(w), F.col("_carry"))).drop("_x", *_TMP)


def in_parts(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, item: Column, size: int = 1000, out: str = "items"
) -> DataFrame:
    """Ordered arrays of at most ``size`` items: keys, part, array. The parts hold every row."""
    d = split_row_number(df.withColumn("_item", item), keys, order, bucket, "_rn")
    d = d.withColumn("part", F.floor((F.col("_rn") - 1) / size))
    packed = F.array_sort(F.collect_list(F.struct("_rn", "_item")))
    return d.groupBy(*keys, "part").agg(F.transform(packed, lambda s: s["_item"]).alias(out))


def text_parts(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, line: Column, sep: str = "\n", size: int = 1000
) -> DataFrame:
    """Ordered text per key in parts of at most ``size`` lines: keys, part, n_lines, text."""
    d = in_parts(df, keys, order, bucket, line, size, "_lines")
    return d.select(*keys, "part", F.size("_lines").alias("n_lines"), F.array_join("_lines", sep).alias("text"))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rn") -> DataFrame:
    """At most ``n`` rows per key; the limit is applied map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def char_budget(
    df: DataFrame, keys: list[str], order: list[Column], line: Column, n: int, mode: str = "stop_before", out: str = "total",
    parts: int = 64,
) -> DataFrame:
    """Lines while the running length stays within ``n``; ``_rn`` is their number from 1.

    ``stop_before`` drops the line that goes over; ``cut_after`` keeps it (the text is cut
    later). Null and empty lines go. A key is first dealt to ``parts`` by a hash of its
    ascending order columns: the running length in a part never exceeds that in the key, so what
    starts beyond ``n`` in its part is dropped there, and the window over the whole key sees no
    more than ``parts`` times the budget.
    """
    d = df.withColumn("_len", F.length(line)).filter(F.col("_len") > 0).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    part = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("_len").over(part), F.lit(0))).filter(F.col("_before") <= n).drop("_part", "_before")
    whole = Window.partitionBy(*keys).orderBy(*order)
    d = d.withColumns({"_rn": F.row_number().over(whole), out: F.sum("_len").over(whole.rowsBetween(Window.unboundedPreceding, 0))})
    keep = F.col(out) <= n if mode == "stop_before" else (F.col(out) - F.col("_len")) <= n
    return d.filter(keep).drop("_len")
