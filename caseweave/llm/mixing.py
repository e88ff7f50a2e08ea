"""Mixing sources to target weights by nested hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which the running sum passes the
budget is refined by the next bits of the hash, and only its rows are read again. Three levels
of 10 bits fix a threshold per source; a document is taken if its hash lies below it. Nothing is
sorted, and a hot source is only ever summed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import kept

LEVELS, BITS = 3, 10
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(key: str) -> Column:
    """30 hash bits of the key as text (null: of the empty text)."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 2)


def targets(sizes: DataFrame, weights: list[int], most: float) -> DataFrame:
    """``sizes`` (source, source_size) to ``target``: shares by weight, at most ``most`` times the size.

    Filling in the order of the cap per weight reaches the state in which no source is above its
    cap and all others share the rest by weight. One row per source passes this window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*map(F.lit, weights))
    w = sizes.withColumn("w", F.element_at(weight, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("key", F.col("cap") / F.col("w"))
    fill = Window.orderBy("key", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    w = w.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))).alias("rest"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))).alias("w_left"),
    ).withColumn("level", F.col("rest") / F.col("w_left"))
    level = F.min_by("level", F.when(F.col("key") >= F.col("level"), F.col("key"))).over(whole)
    w = w.withColumn("fill", level)
    return w.select("source", "source_size", F.when(F.col("key") < F.col("fill"), F.col("cap")).otherwise(F.col("w") * F.col("fill")).alias("target"))


def thresholds(rows: DataFrame, weights: list[int], most: float) -> DataFrame:
    """``rows`` (source, size, h) to one row per source: source_size, target, whole copies, threshold ``below``."""
    first = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    state = kept(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("int")
    state = state.withColumn("copies", copies)
    state = state.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        s = state.select(F.col("source").alias("s"), "prefix", "need").where("need > 0")
        inside = rows.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix"))).select("source", "need", "prefix", "size", F.shiftright("h", shift).alias("bucket"))
        sums = inside.groupBy("source", "need", "prefix", "bucket").agg(F.sum("size").alias("m"))
        run = sums.withColumn("before", F.coalesce(F.sum("m").over(first), F.lit(0)))
        edge = run.where("before < need and before + m >= need")
        if level == LEVELS - 1:
            nearer = F.col("before") + F.col("m") - F.col("need") < F.col("need") - F.col("before")
            edge = edge.select(F.col("source").alias("e"), (F.col("bucket") + nearer.cast("long")).alias("to"), F.lit(0.0).alias("open"))
        else:
            edge = edge.select(F.col("source").alias("e"), F.col("bucket").alias("to"), (F.col("need") - F.col("before")).alias("open"))
        # with no edge nothing is open: the prefix stays where the sums before it have met the need
        low = F.col("prefix") * (1 << BITS)
        low = low if level else F.lit(0).cast("long")
        state = kept(
            state.join(edge, F.col("source").eqNullSafe(F.col("e")), "left").select(
                "source", "source_size", "target", "copies", F.coalesce("open", F.lit(0.0)).alias("need"), F.coalesce("to", low).alias("prefix")
            ),
            "state",
        )
    return state.select("source", "source_size", "target", "copies", F.col("prefix").alias("below"))


def mix(docs: DataFrame, weights: list[int], most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    A null text has size 0; a null source is a source of its own, the last one; a null id is
    hashed as the empty text; rows that repeat an id are taken together. A source without words
    has target 0. An empty table gives an empty result; other columns are not read.
    """
    rows = kept(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), key_hash(id_col).alias("h")), "sizes")
    state = thresholds(rows, weights, most).withColumnRenamed("source", "s")
    copies = F.col("copies") + (F.col("h") < F.col("below")).cast("int")
    out = rows.join(state, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: list[int], most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated as often as it takes them; columns as in ``docs``."""
    rows = kept(docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"), key_hash(id_col).alias("h")), "sizes")
    state = thresholds(rows, weights, most).select(F.col("source").alias("mix_source"), F.col("copies").alias("mix_copies"), F.col("below").alias("mix_below"))
    times = F.col("mix_copies") + (key_hash(id_col) < F.col("mix_below")).cast("int")
    taken = docs.join(state, F.col(source_col).eqNullSafe(F.col("mix_source"))).withColumn("mix_times", times).where("mix_times > 0")
    return taken.withColumn("mix_times", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*docs.columns)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
        source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / w AS k,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (SELECT arg_min(level, k) FROM f WHERE k >= level) AS fill FROM f),
t AS (SELECT source, source_size, CASE WHEN k < fill THEN cap ELSE w * fill END AS target FROM g),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS copies FROM t),
n AS (SELECT *, target - copies * source_size AS need FROM c),
b AS (SELECT source, h, sum(size) AS m FROM d GROUP BY source, h),
r AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
e AS (SELECT r.source, CASE WHEN before + m - need < need - before THEN h + 1 ELSE h END AS below
      FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source WHERE need > 0 AND before < need AND before + m >= need)
SELECT d.doc_id, d.size, n.source_size, n.target,
       CAST((n.copies + CASE WHEN d.h < coalesce(e.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS copies,
       CAST((n.copies + CASE WHEN d.h < coalesce(e.below, 0) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
