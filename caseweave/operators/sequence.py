"""Order-dependent correction of page predictions inside a file.

Every row looks at the state left by the corrected rows before it, so the state must be
walked in order. The walk only needs the type of the last firm page, the set of types seen
and the set of types closed; that state is small and finite. A large file is therefore cut
into chunks: each chunk is reduced, on its own task, to a table "state in -> state out",
the tables of a file are chained to get the state at the start of each chunk, and the
chunks are then walked in parallel. Everything else (look-ahead, inherited values) is
native. No text travels to Python: a page is one small integer there.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave import vocabulary as v
from caseweave.functions.classify import PREDICTION
from caseweave.functions.predicates import has_title, is_soft
from caseweave.functions.text import compact_text, label_of
from caseweave.operators.split import split_last, split_next, split_row_number
from caseweave.session import cut_lineage

# Type codes 1..7 in stage order; 0 is no type. The first five are one-shot types.
TYPES = list(fixed.STAGE_ORDER)
ONE_SHOT = len(fixed.CLOSING_TYPES)
RECORD, EXAM = TYPES.index("medical_record") + 1, TYPES.index("imaging_report") + 1
NO_STAGE = 99
# bits of a page code: type, next firm type, soft, keywords, continuation, own title
NEXT, SOFT, WORDS, CONT, TITLE = 8, 64, 128, 256, 512


class Walk:
    """The transition tables, made per page code on first use."""

    def __init__(self, look_ahead: bool = True):
        self.look_ahead = look_ahead
        s = np.arange(8 * 128 * 32)
        prev, seen, closed = s >> 12, (s >> 5) & 127, s & 31
        ok = ((closed & ~seen) == 0) & ((prev == 0) | ((seen >> np.maximum(prev - 1, 0)) & 1 == 1))
        self.states = s[ok]
        self.index = np.full(len(s), -1, dtype=np.int16)
        self.index[self.states] = np.arange(len(self.states), dtype=np.int16)
        self.prev, self.seen, self.closed = prev[ok], seen[ok], closed[ok]
        self.start = int(self.index[0])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        """(state out, rule used) for every state in."""
        if code in self.tables:
            return self.tables[code]
        kind, ahead = code & 7, (code >> 3) & 7
        soft, words, cont, title = (bool(code & b) for b in (SOFT, WORDS, CONT, TITLE))
        prev, seen, closed = self.prev, self.seen, self.closed
        stage = np.where(prev == 0, NO_STAGE, prev)
        own = kind or NO_STAGE
        bit = 1 << (kind - 1) if kind else 0
        some = prev > 0
        exam_in_record = (kind == EXAM) & (prev == RECORD) & (not title)
        rules = [
            (closed & bit > 0) & (stage > own),
            (prev == ahead) & (prev != kind) & (soft | (own < stage) | exam_in_record) & self.look_ahead,
            np.full(len(prev), cont and soft),
            exam_in_record,
            (seen & bit > 0) & (own < stage) & (not title),
        ]
        rule = np.zeros(len(prev), dtype=np.int8)
        for i in range(len(rules), 0, -1):
            rule = np.where(some & rules[i - 1], i, rule)
        fixed_row = rule > 0
        firm = np.where(fixed_row, words, kind > 0 and not soft)
        now = np.where(fixed_row, prev, kind)
        # a firm page closes the one-shot types seen so far that come before its stage
        before = (1 << np.minimum(np.maximum(now - 1, 0), ONE_SHOT)) - 1
        new_closed = np.where(firm, closed | (seen & before & 31), closed)
        new_seen = np.where(firm, seen | (1 << np.maximum(now - 1, 0)), seen)
        new_prev = np.where(firm, now, prev)
        out = self.index[(new_prev << 12) | (new_seen << 5) | new_closed]
        self.tables[code] = (out, rule.astype(np.int8))
        return self.tables[code]


@functools.lru_cache(maxsize=2)
def walk(look_ahead: bool = True) -> Walk:
    return Walk(look_ahead)


def type_code(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.coalesce(c, F.lit(""))), F.lit(0)).cast("int")


def page_features(df: DataFrame, text: str = "text", titles: dict = v.STANDALONE_TITLES) -> DataFrame:
    """page_id, file, page_number, prediction and the parts of the page code; the text stays behind."""
    p = F.col("prediction")
    d = df.withColumn("_t", compact_text(F.col(text), heading_marks=False))
    d = d.withColumns({"_soft": is_soft(p), "_title": has_title(F.col("_t"), p["type"], titles)})
    d = d.select("page_id", "file", "page_number", "prediction", "_soft", "_title")
    return d.withColumn("_kind", type_code(p["type"]))


def page_code(ahead: Column) -> Column:
    p = F.col("prediction")
    flag = lambda c, b: F.when(F.coalesce(c, F.lit(False)), b).otherwise(0)
    return (
        F.col("_kind") + ahead * NEXT + flag(F.col("_soft"), SOFT) + flag(F.size(p["keywords"]) > 0, WORDS)
        + flag(p["continuation"], CONT) + flag(F.col("_title"), TITLE)
    ).cast("int")


_ORDER = ["page_number", "page_id"]


def _order() -> list[Column]:
    return [F.coalesce("page_number", F.lit(0)), F.col("page_id")]


def next_strong(df: DataFrame, bucket: Column, out: str = "next_type") -> DataFrame:
    """Type of the next firm page of the file."""
    firm = (F.col("_kind") > 0) & ~F.col("_soft")
    return split_next(df, ["file"], _order(), bucket, F.when(firm, F.col("_kind")), out)


def correct_sequence(df: DataFrame, text: str = "text", titles: dict = v.STANDALONE_TITLES, chunk: int = 65_536) -> DataFrame:
    """page_id, file, page_number, prediction (corrected) and rule (0: untouched)."""
    bucket = F.floor(F.coalesce("page_number", F.lit(0)) / 10_000)
    d = next_strong(page_features(df, text, titles), bucket, "_ahead")
    d = d.withColumn("_code", page_code(F.coalesce("_ahead", F.lit(0))))
    d = split_row_number(d, ["file"], _order(), bucket, "_rn").withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk))
    # Read three times below (tables, walk, inherited values): kept once, without any text.
    d = cut_lineage(d)

    # Rows come sorted by file, chunk and place: chunks are walked one after the other, with no table of their own.
    def reduce_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = walk()
        key, m = None, None  # of a first chunk only the state it ends in matters

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind_type, pa.int64(), pa.binary()))], ["file", "_chunk", "_map"])

        rows = []
        for b in batches:
            kind_type = b.schema.field("file").type
            for f, c, code in zip(*(b.column(n).to_pylist() for n in ("file", "_chunk", "_code")), strict=True):
                if (f, c) != key:
                    if key:
                        rows.append((*key, m.tobytes()))
                    key, m = (f, c), np.array([w.start], dtype=np.int16) if c == 0 else np.arange(len(w.states), dtype=np.int16)
                m = w.table(code)[0][m]
                if len(rows) == 4096:
                    yield batch(rows)
                    rows = []
        if key:
            yield batch([*rows, (*key, m.tobytes())])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sorted by file and chunk: one table at a time, only the state is kept.
        w = walk()
        file, state = None, w.start
        for pdf in batches:
            rows = []
            for f, c, m in zip(pdf["file"], pdf["_chunk"], pdf["_map"]):
                if f != file:
                    file, state = f, w.start
                rows.append((f, c, state))
                m = np.frombuffer(m, dtype=np.int16)
                state = int(m[state if c else 0])
            yield pd.DataFrame(rows, columns=["file", "_chunk", "_state"])

    def walk_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = walk()
        key, state = None, w.start
        for b in batches:
            rules = []
            for f, c, code, begin in zip(*(b.column(n).to_pylist() for n in ("file", "_chunk", "_code", "_state")), strict=True):
                if (f, c) != key:
                    key, state = (f, c), w.start if begin is None else begin
                out, rule = w.table(code)
                rules.append(int(rule[state]))
                state = int(out[state])
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("page_id"), pa.array(rules, pa.int32())], ["file", "page_id", "_rule"])

    codes = d.select("file", "page_id", "_rn", "_chunk", "_code")
    # Only files of several chunks need tables.
    big = codes.groupBy("file").agg(F.max("_chunk").alias("_last")).filter(F.col("_last") > 0).select("file")
    kind = dict(codes.dtypes)["file"]
    maps = codes.join(big, "file", "left_semi").repartition("file", "_chunk").sortWithinPartitions("file", "_chunk", "_rn").mapInArrow(reduce_chunks, f"file {kind}, _chunk long, _map binary")
    states = maps.repartition("file").sortWithinPartitions("file", "_chunk").mapInPandas(chain, f"file {kind}, _chunk long, _state int")
    ready = codes.join(states, ["file", "_chunk"], "left")
    page = dict(codes.dtypes)["page_id"]
    rules = ready.repartition("file", "_chunk").sortWithinPartitions("file", "_chunk", "_rn").mapInArrow(walk_chunks, f"file {kind}, page_id {page}, _rule int")
    return inherit(d.join(rules, ["file", "page_id"]), bucket)


REASONS = [
    lambda cur, prev: F.concat(label_of(F.coalesce(cur, F.lit("")), fixed.PAGE_TYPES), F.lit("已在前序材料结束，当前页按所在连续材料校正")),
    lambda cur, prev: F.concat(F.lit("根据前后页均为"), label_of(prev, fixed.PAGE_TYPES), F.lit("校正")),
    lambda cur, prev: F.concat(F.lit("根据前页材料连续性校正："), label_of(prev, fixed.PAGE_TYPES)),
    lambda cur, prev: F.lit("病历连续页中出现检查/影像词，按前页病历材料校正"),
    lambda cur, prev: F.lit("根据材料顺序已进入后续类别，按前页连续材料校正"),
]


def inherit(d: DataFrame, bucket: Column) -> DataFrame:
    """Values of the corrected rows: type, subtype and confidence of the last untouched firm
    page; the organisation of the row itself, else the last one along the chain."""
    p = F.col("prediction")
    touched = F.col("_rule") > 0
    anchor = ~touched & (F.col("_kind") > 0) & ~F.col("_soft")
    base = F.when(anchor, F.struct(p["type"].alias("type"), p["subtype"].alias("subtype"), p["confidence"].alias("confidence")))
    own = F.nullif(p["group"], F.lit(""))
    firm_fixed = touched & (F.size(p["keywords"]) > 0) & own.isNotNull()
    group = F.when(anchor | firm_fixed, F.struct(own.alias("g")))
    d = split_last(d, ["file"], _order(), bucket, F.struct(base.alias("b")).alias("x")["b"], "_base")
    d = split_last(d, ["file"], _order(), bucket, group, "_group")
    reason = F.lit(None).cast("string")
    for i, r in enumerate(REASONS):
        reason = F.when(F.col("_rule") == i + 1, r(p["type"], F.col("_base.type"))).otherwise(reason)
    conf = F.least(F.greatest(F.coalesce("_base.confidence", F.lit(0.78)), F.lit(0.78)), F.lit(0.88))
    made = F.struct(
        F.col("_base.type").alias("type"), F.col("_base.subtype").alias("subtype"), F.coalesce(own, F.col("_group.g")).alias("group"),
        conf.alias("confidence"), reason.alias("reason"), F.coalesce(p["keywords"], F.array().cast("array<string>")).alias("keywords"),
        F.lit(True).alias("continuation"),
    )
    return d.select("page_id", "file", "page_number", F.when(touched, made).otherwise(p.cast(PREDICTION)).alias("prediction"), F.col("_rule").alias("rule"))
