"""Unions with precedence, key differences and array algebra."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.split import first_rows


def merge_refs(keys: list[str], *groups: DataFrame, ident: Column | None = None) -> DataFrame:
    """Union of reference lists; the first list, then the first position, wins per identity."""
    rows = None
    for i, g in enumerate(groups):
        d = g.withColumn("list_no", F.lit(i))
        rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
    key = ident if ident is not None else F.coalesce("clause_key", F.col("ref_id").cast("string"), "label", "snippet")
    d = rows.withColumn("_ident", key).filter(F.coalesce("_ident", F.lit("")) != "")
    return first_rows(d, [*keys, "_ident"], [F.col("list_no"), F.col("ord")], 1, "_rn").drop("_rn", "_ident")


def with_direct_hits(scored: DataFrame, direct: DataFrame, score: float = 10.0) -> DataFrame:
    """Scored references plus direct code matches that are not among them, at a fixed score."""
    extra = direct.join(scored.select("case_id", "chunk_id"), ["case_id", "chunk_id"], "left_anti")
    return scored.unionByName(extra.withColumn("score", F.lit(score)), allowMissingColumns=True)


def stale_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only: change is ``stale`` (old only) or ``new``. A key with a null matches no other.

    One grouping over both sides: each is read once, and a task holds one row per key.
    """
    side = lambda d, is_old: d.select(*keys, F.lit(is_old).alias("_old"), F.lit(not is_old).alias("_new"))
    d = side(old, True).unionByName(side(new, False)).groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    alone = F.lit(False)
    for k in keys:
        alone = alone | F.col(k).isNull()
    stale = F.when(F.col("_old") & (~F.col("_new") | alone), "stale")
    fresh = F.when(F.col("_new") & (~F.col("_old") | alone), "new")
    return d.select(*keys, F.explode(F.array_compact(F.array(stale, fresh))).alias("change"))


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def union_fields(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))
