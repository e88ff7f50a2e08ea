"""Work tables, bounded samples, hashed folds and links to components."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.session import work_path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    It cuts the lineage, survives lost executors and keeps statistics for the joins after it.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds`` (null key: the crc of the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by the hash of ``key``; a table with fewer rows is taken whole.

    The same keys are chosen in every run. Rows that repeat a key are chosen together, so the
    caller limits what it collects, after it has cut the rows down to what it needs.
    """
    n = df.count()
    if n > rows:
        df = df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    return df


def class_sample(df: DataFrame, key: str, label: str, rows: int, least: int | None = None) -> tuple[DataFrame, dict]:
    """A sample like ``hash_sample`` in which every value of ``label`` has about ``least`` rows, or all it has; and the rates by value.

    Without ``least``, half as many rows again as ``rows`` are dealt evenly, 20 a value at least. Null labels go.
    """
    df = df.where(F.col(label).isNotNull())
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    if n <= rows:
        return df, dict.fromkeys(counts, 1.0)
    least = least or max(20, rows // (2 * len(counts)))
    rates = {v: min(1.0, max(rows / n, least / c)) for v, c in counts.items()}
    wanted = df.sparkSession.createDataFrame([(v, int((1 << 30) * r)) for v, r in rates.items()], f"sample_label {df.schema[label].dataType.simpleString()}, sample_below long")
    chosen = df.join(F.broadcast(wanted), F.col(label) == F.col("sample_label"))  # as many rows as values
    return chosen.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < F.col("sample_below")).drop("sample_label", "sample_below"), rates


class Forest:
    """Union of links among the positions 0..n-1, folded array by array; roots are the smallest positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to ``(id, root)``, for every id that has a link; equal roots mean reachable.

    Each round maps every id to the first of itself and its neighbours in a random order and
    carries the links over, so the graph shrinks by a constant factor whatever its shape. All
    steps are joins and grouped minima; nothing is collected.
    """
    spark = links.sparkSession
    links = kept(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        seed = len(maps)

        def place(c: str) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("v"))  # noqa: B023

        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("m"))
        step = kept(first.select(F.col("a").alias("id"), F.least("m", place("a"))["v"].alias("root")), "step")
        maps.append(step)
        left, right = step.select(F.col("id").alias("a"), F.col("root").alias("ra")), step.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where("ra <> rb")
        links = kept(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not maps:
        return spark.createDataFrame([], "id long, root long")
    chain = maps[0]
    for m in maps[1:]:
        up = m.select(F.col("id").alias("root"), F.col("root").alias("above"))
        chain = chain.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    return chain


def paired_blocks(df: DataFrame, sizes: DataFrame, keys: list[str], block: int, spread_by: Column) -> DataFrame:
    """Deal the rows of each group to pairs of blocks, so that every two rows of a group meet exactly once.

    ``sizes`` holds ``keys`` and the group's row count ``n``. A group of up to ``block`` rows is one
    pair (0, 0). A larger one is cut into blocks by the hash ``spread_by``; block pairs (i, j) with
    i <= j become tasks of their own, each of about twice ``block`` rows however large the group
    is. Adds ``own`` (the row's block), ``bi`` and ``bj``.
    """
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    return (
        df.join(sizes, keys)
        .withColumn("n_blocks", n_blocks)
        .withColumn("own", F.pmod(spread_by, F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("bi", F.least("own", "other"))
        .withColumn("bj", F.greatest("own", "other"))
        .drop("n", "n_blocks", "other")
    )


def valid_vectors(df: DataFrame, vec_col: str) -> Column:
    """The vector as array<double>; null if it is null, empty, zero, or holds a null or non-finite component."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(good, v)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column without nulls as rows of ``width``, shorter vectors filled up with zeros."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(-1, width).astype(float)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out
