"""Numbering, top-k, fallback by scope, adjacency and sequence features."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.operators.split import first_rows, split_last, split_row_number, split_running_max, split_running_sum


def renumber(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str = "page_number") -> DataFrame:
    """Pages of a group numbered 1..n; a hot group is cut along its order."""
    return split_row_number(df, keys, order, bucket, "_n").withColumn(out, F.col("_n")).drop("_n")


def islands(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, page: Column, gap: int = 1, out: str = "island") -> DataFrame:
    """Runs of pages whose distance is at most ``gap``, numbered from 1."""
    d = split_last(df.withColumn("_p", page), keys, order, bucket, F.col("_p"), "_q")
    new = F.when(F.col("_q").isNull() | F.col("_p").isNull() | (F.col("_p") - F.col("_q") > gap), 1).otherwise(0)
    d = d.withColumn("_new", new)
    return split_running_sum(d, keys, order, bucket, F.col("_new"), out).drop("_p", "_q", "_new")


EVENT_COLS = ["surgery", "diagnosis", "findings", "treatment"]
CHUNK = 256


def merge_adjacent(df: DataFrame, keys: list[str], default_title: str = "手术记录", chunk: int = CHUNK) -> DataFrame:
    """Adjacent pages of one event folded: first non-null field wins, signature pages tagged.

    Columns: keys, page_id (unique in its group), page_number, surgery, diagnosis, findings,
    treatment, date, signature. A page next to the last page of the running event belongs to it
    if it is a signature page or shares title or date with its first page; any other page with
    fields begins the next event. ``event_heads`` gives each page the first page of its event.
    """
    # Pages without a number go last, each as an event of its own.
    at = F.struct(F.coalesce("page_number", F.lit(2**31 - 1)), "page_id")
    filled = F.lit(False)
    for c in EVENT_COLS:
        filled = filled | F.col(c).isNotNull()
    title = F.regexp_replace(F.coalesce("surgery", F.lit(default_title)), r"\s+", "")
    d = df.withColumns({"_title": title, "_date": F.coalesce("date", F.lit("")), "_filled": filled, "_at": at})
    d = d.join(event_heads(d, keys, chunk), [*keys, "page_id"])
    first, tagged = F.col("_head") == F.col("page_id"), F.col("signature")
    own = first | ~tagged  # a signature page brings its number, not its fields

    def earliest(c: Column) -> Column:
        return F.min_by(c, F.when(own & (F.coalesce(c, F.lit("")) != ""), F.col("_at")))

    body = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("treatment", "findings", "diagnosis")))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "page_id", "page_number")))
    e = d.groupBy(*keys, "_head").agg(
        F.max(F.when(first, F.col("surgery"))).alias("surgery"),
        F.max(F.when(first, F.col("date"))).alias("date"),
        *[earliest(F.col(c)).alias(c) for c in EVENT_COLS[1:]],
        earliest(F.coalesce(body, F.when(first, F.col("surgery")))).alias("quote"),
        ordered.alias("_l"),
        F.max(tagged & ~first).alias("signature_merged"),
    )
    known = (F.coalesce("date", F.lit("")) != "") & (F.coalesce("surgery", F.lit("")) != "")
    return e.select(
        *keys, F.coalesce(F.nullif("surgery", F.lit("")), F.lit(default_title)).alias("title"), "date", *EVENT_COLS, "quote", F.col("_l.page_id").alias("source_ids"),
        F.array_compact(F.col("_l.page_number")).alias("source_pages"), F.when(known, 84).otherwise(68).alias("confidence"), "signature_merged",
    )


_STATE = "struct<head:bigint,title:string,date:string,page:int>"
_ARROW_STATE = pa.struct([("head", pa.int64()), ("title", pa.string()), ("date", pa.string()), ("page", pa.int32())])


def event_heads(d: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """keys, page_id, _head: the first page of each page's event; pages of no event are left out.

    Columns: keys, page_id, page_number, _title, _date, signature, _filled. A group is cut into
    chunks of ``chunk`` page numbers, so that no row holds more pages than share those numbers.
    What a chunk makes of the event that enters it depends on few titles and dates
    (``entry_table``); a run over several chunks is chained over those small tables, and then every
    chunk is walked on its own with the event that enters it.
    """
    page = F.struct(F.col("page_number").cast("int").alias("page"), F.col("page_id").cast("bigint").alias("page_id"), F.col("_title").alias("title"), F.col("_date").alias("date"), "signature", F.col("_filled").alias("filled"))
    place = F.floor(F.col("page_number") / chunk).alias("_chunk")
    chunks = d.filter("page_number is not null").groupBy(*keys, place).agg(F.array_sort(F.collect_list(page)).alias("_pages"))
    ends = chunks.select(*keys, "_chunk", "_pages", F.col("_pages")[0]["page"].alias("_low"), F.element_at("_pages", -1)["page"].alias("_high"))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    before, after = F.coalesce(F.lag("_high").over(w) == F.col("_low") - 1, F.lit(False)), F.coalesce(F.lead("_low").over(w) == F.col("_high") + 1, F.lit(False))
    small = ends.select(*keys, "_chunk", "_low", "_high").withColumns({"_before": before, "_after": after})
    small = small.withColumn("_chain", F.sum((~F.col("_before")).cast("int")).over(w)).filter("_before or _after")
    linked = small.select(*keys, "_chunk", "_low", "_chain", "_after").join(chunks, [*keys, "_chunk"])
    at_key = [f for f in linked.schema if f.name in keys]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at_key)
    tables = linked.mapInArrow(_tables(keys), f"{names}, _chunk bigint, _low int, _chain bigint, leaves array<struct<title:string,date:string,out:{_STATE}>>, fresh {_STATE}")
    entries = tables.groupBy(*keys, "_chain").applyInArrow(_chained(keys), f"{names}, _chunk bigint, _entry {_STATE}")
    walked = chunks.join(entries, [*keys, "_chunk"], "left").select(*keys, F.explode(_heads(F.col("_pages"), F.col("_entry"))).alias("_m"))
    alone = d.filter("page_number is null and _filled").select(*keys, "page_id", F.col("page_id").cast("bigint").alias("_head"))
    return walked.filter("_m.head is not null").select(*keys, F.col("_m.page_id").alias("page_id"), F.col("_m.head").alias("_head")).unionByName(alone)


def _heads(pages: Column, entry: Column) -> Column:
    """Ordered pages of a chunk to (page_id, head), by one fold from the event that enters it; no head: no event."""
    mark = "array<struct<page_id:bigint,head:bigint>>"

    def step(s: Column, x: Column) -> Column:
        near = F.coalesce(x["page"] - s["page"] <= 1, F.lit(False))
        joins = near & (x["signature"] | (x["title"] == s["title"]) | (x["date"] == s["date"]))
        begins = ~joins & x["filled"]
        head = F.when(begins, x["page_id"]).otherwise(s["head"])
        one = F.struct(x["page_id"].alias("page_id"), F.when(joins | begins, head).alias("head"))
        return F.struct(
            head.alias("head"), F.when(begins, x["title"]).otherwise(s["title"]).alias("title"), F.when(begins, x["date"]).otherwise(s["date"]).alias("date"),
            F.when(joins | begins, x["page"]).otherwise(s["page"]).alias("page"), F.concat(s["marks"], F.array(one)).alias("marks"),
        )

    start = F.struct(*(entry[n].alias(n) for n in ("head", "title", "date", "page")), F.array().cast(mark).alias("marks"))
    return F.aggregate(pages, start, step, lambda s: s["marks"])


def last_event(pages: list[dict], start: int = 0) -> dict | None:
    """The event that runs after the last page, if none runs before page ``start``."""
    now = None
    for x in pages[start:]:
        if now and x["page"] - now["page"] <= 1 and (x["signature"] or x["title"] == now["title"] or x["date"] == now["date"]):
            now["page"] = x["page"]
        elif x["filled"]:
            now = {"head": x["page_id"], "title": x["title"], "date": x["date"], "page": x["page"]}
    return now


def entry_table(pages: list[dict], start: int = 0, title: str | None = None, date: str | None = None, last: int | None = None):
    """What the chunk makes of an event that enters it: (title, date, event afterwards), the first match holds.

    None for a title or date stands for any. Afterwards an event without a head is the entering
    one with a new last page. A page that asks for a title or date left open splits the case into
    those that have its title, those that have its date, and the rest; with both fixed nothing is
    left to split, so a chunk has about five cases, however many pages it has.
    """
    last = pages[0]["page"] - 1 if last is None else last
    for i in range(start, len(pages)):
        x = pages[i]
        if x["page"] - last <= 1:
            if x["signature"] or x["title"] == title or x["date"] == date:
                last = x["page"]
                continue
            if title is None:
                yield from entry_table(pages, i + 1, x["title"], date, x["page"])
            if date is None:
                yield from entry_table(pages, i + 1, title, x["date"], x["page"])
        if x["filled"]:
            yield title, date, last_event(pages, i)
            return
    yield title, date, {"page": last}


def _tables(keys: list[str]):
    leaf = pa.struct([("title", pa.string()), ("date", pa.string()), ("out", _ARROW_STATE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves, fresh = [], []
            for pages, needed in zip(b.column("_pages"), b.column("_after").to_pylist()):
                pages = pages.as_py() if needed else []  # the last chunk of a chain hands nothing on
                leaves.append([{"title": t, "date": d, "out": out} for t, d, out in entry_table(pages)] if needed else None)
                fresh.append(last_event(pages))
            kept = [*keys, "_chunk", "_low", "_chain"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(leaves, pa.list_(leaf)), pa.array(fresh, _ARROW_STATE)], [*kept, "leaves", "fresh"])

    return run


def _chained(keys: list[str]):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_chunk")
        now, entries = None, []
        for low, leaves, fresh in zip(t.column("_low").to_pylist(), t.column("leaves"), t.column("fresh")):
            entries.append(now)
            if now is None or now["page"] < low - 1:
                now = fresh.as_py()
                continue
            for leaf in leaves.as_py() or []:
                if leaf["title"] in (None, now["title"]) and leaf["date"] in (None, now["date"]):
                    out = leaf["out"]
                    now = {**now, "page": out["page"]} if out["head"] is None else out
                    break
        kept = [*keys, "_chunk"]
        return pa.Table.from_arrays([*(t.column(n) for n in kept), pa.array(entries, _ARROW_STATE)], [*kept, "_entry"])

    return run


def top_evidence(df: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Best ``k`` per key by score, input order on ties."""
    return first_rows(df, keys, [F.col("score").desc(), F.col("ord")], k)


ROLE_LIMITS = {"primary": 10, "supporting": 5, "candidate": 4}


def limit_by_role(df: DataFrame, keys: list[str], limits: dict[str, int] = ROLE_LIMITS) -> DataFrame:
    """Per role the best rows up to its limit; ``rank`` orders by role, then score."""
    d = first_rows(df.filter(F.col("role").isin(*limits)), [*keys, "role"], [F.col("score").desc(), F.col("ord")], max(limits.values()), "_rn")
    cap, start, seen = F.lit(0), F.lit(0), 0
    for i, (role, n) in enumerate(limits.items()):
        cap = F.when(F.col("role") == role, n).otherwise(cap)
        start = F.when(F.col("role") == role, i * 1000).otherwise(start)
    return d.filter(F.col("_rn") <= cap).withColumn("rank", start + F.col("_rn")).drop("_rn")


def trusted_or_all(df: DataFrame, keys: list[str], types: list[str] | None = None, null_is_excluded: bool = False) -> DataFrame:
    """Active rows of the scope; only the trusted ones where the scope has any.

    The flag per scope is one pre-aggregated row, joined back, so a hot scope is never
    collected into one task.
    """
    d = df if types is None else df.filter(F.col("fact_type").isin(*types))
    active = (F.col("review_status") != "excluded") & (F.col("importance") != "excluded")
    d = d.filter(active if null_is_excluded else F.coalesce(F.col("review_status"), F.lit("")).isin("excluded").__invert__() & F.coalesce(F.col("importance") != "excluded", F.lit(True)))
    trusted = F.coalesce(F.col("review_status").isin("confirmed", "system_verified"), F.lit(False))
    scopes = d.filter(trusted).select(*keys).distinct().withColumn("_any", F.lit(True))
    return d.join(scopes, keys, "left").filter(trusted | F.col("_any").isNull()).drop("_any")


def latest(df: DataFrame, keys: list[str], date: Column, ord: Column) -> DataFrame:
    """The row with the greatest text date; the first one on ties."""
    return first_rows(df, keys, [F.coalesce(date, F.lit("")).desc(), ord], 1, "_rn").drop("_rn")


def preferred_source(df: DataFrame, keys: list[str], priority: dict[str, int]) -> DataFrame:
    """Source page by subtype priority, then page, then id."""
    rank = F.lit(99)
    for name, n in priority.items():
        rank = F.when(F.col("subtype") == name, n).otherwise(rank)
    order = [rank, F.coalesce("page_number", F.lit(fixed.NO_PAGE)), F.col("page_id")]
    return first_rows(df, keys, order, 1, "_rn").drop("_rn")


def capped_topk(df: DataFrame, keys: list[str], limit: int = 8, cap: int = 3, backfill: bool = True) -> DataFrame:
    """Best rows with at most ``cap`` per document, then the rest by score; adds ``rank``.

    No more than cap + limit rows of a document can ever be chosen, so that many are kept
    map-side before the final order.
    """
    best = [F.col("score").desc(), F.col("chunk_id").desc()]
    d = first_rows(df, [*keys, "doc_id"], best, cap + limit if backfill else cap, "_doc")
    order = [(F.col("_doc") > cap).cast("int"), *best]
    return first_rows(d, keys, order, limit, "rank").drop("_doc")


def recent(df: DataFrame, keys: list[str], order: Column, n: int = 20) -> DataFrame:
    return first_rows(df, keys, [order.desc()], n, "_rn").drop("_rn")


def dedupe_first(df: DataFrame, keys: list[str], ord: list[Column]) -> DataFrame:
    """First row per identity in input order."""
    return first_rows(df, keys, ord, 1, "_rn").drop("_rn")


def sequence_features(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, kind: str, stage: Column) -> DataFrame:
    """Previous type, whether the type was seen before, whether the stage falls back."""
    d = df.withColumns({"_s": stage, "_at": F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])})
    d = split_last(d, keys, order, bucket, F.col(kind), "previous")
    d = split_running_max(d, keys, order, bucket, F.col("_s"), "_top")
    first = d.groupBy(*keys, kind).agg(F.min("_at").alias("_first"))
    d = d.join(first, [*keys, kind], "left")
    return d.withColumns(
        {"seen_before": F.coalesce(F.col("_first") < F.col("_at"), F.lit(False)), "regression": F.coalesce(F.col("_top") > F.col("_s"), F.lit(False))}
    ).drop("_s", "_at", "_top", "_first")
