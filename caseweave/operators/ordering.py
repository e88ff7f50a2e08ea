"""Sort keys of the listings, all ascending, and the paged listing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions.extract import fact_time_key, page_info
from caseweave.functions.text import label_map
from caseweave.operators.split import split_row_number
from caseweave.sources.pages import sequence_key


def rank_of(c: Column, ranks: dict[str, int], other: int) -> Column:
    m = F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv])
    return F.coalesce(F.try_element_at(m, F.coalesce(c, F.lit(""))), F.lit(other))


def with_fact_order(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Adds the time key once; order: time, precision, type, role, first page, id."""
    d = df.withColumn("_key", fact_time_key(F.col("fact_date")))
    return d, [
        F.col("_key.sort"), F.col("_key.precision"), rank_of(F.col("fact_type"), fixed.FACT_TYPE_RANK, 999),
        rank_of(F.col("fact_role"), fixed.EVENT_RANK, 999), F.coalesce(F.array_min("source_pages"), F.lit(fixed.NO_PAGE)), F.col("fact_id"),
    ]


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, keep: list[Column], out: str = "pos") -> DataFrame:
    """Position of each row in the order of its key, from 1; ``bucket`` never falls along the order.

    Only the keys, ``keep`` and the order travel, and a hot key is numbered bucket by bucket.
    """
    slim = df.select(*keys, *keep, *[o.alias(f"_o{i}") for i, o in enumerate(order)], bucket.alias("_at"))
    cols = [F.col(f"_o{i}") for i in range(len(order))]
    return split_row_number(slim, keys, cols, F.col("_at"), out).drop("_at", *[f"_o{i}" for i in range(len(order))])


def time_bucket(order: list[Column]) -> Column:
    """A bucket for orders that begin with a time text: its month."""
    return F.substring(order[0], 1, 7)


def page_bucket(order: list[Column]) -> Column:
    """A bucket for ``page_order``: a thousand parsed numbers of a prefix, or a thousand pages of the rest."""
    parsed = order[0] == 0
    return F.struct(
        order[0].alias("a"), order[1].alias("b"), F.when(parsed, F.floor(order[2] / 1000)).otherwise(order[2]).alias("c"),
        F.when(parsed, 0).otherwise(F.floor(order[3] / 1000)).alias("d"),
    )


def page_order(*names: Column, page: Column, ident: Column) -> list[Column]:
    return sequence_key(page_info(*names), page, ident)


def event_order(date: Column, kind: Column, ident: Column) -> list[Column]:
    """Day, type rank, raw date, id; a blank date comes last."""
    raw = F.coalesce(F.nullif(date, F.lit("")), F.lit(fixed.NO_TIME))
    return [F.substring(raw, 1, 10), rank_of(F.coalesce(F.nullif(kind, F.lit("")), F.lit("other")), fixed.EVENT_RANK, 100), raw, ident]


NO_REPORT_TIME = "9999-12-31T23:59:59"


def report_order(datetime: Column, ident: Column) -> list[Column]:
    return [F.coalesce(F.nullif(datetime, F.lit("")), F.lit(NO_REPORT_TIME)), ident]


def report_order_nulls_last(datetime: Column, date: Column, ident: Column) -> list[Column]:
    """Missing times come last; "~" sorts after every sign of an ISO time."""
    return [F.coalesce(datetime, F.concat(F.lit("~"), F.coalesce(date, F.lit("~")))), F.coalesce(date, F.lit("~")), ident]


def list_page(df: DataFrame, newest: Column, ident: Column, skip: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(newest.desc(), ident.desc()).offset(skip).limit(limit)
