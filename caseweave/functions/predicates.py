"""Keyword tests, quality flags and gates as boolean or array columns."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave import vocabulary as v
from caseweave.functions.text import let, squeeze, strip, strip_artifacts, sub

def no() -> Column:
    return F.lit(False)



def words(ws: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")


def contains_any(c: Column, ws: list[str] | Column) -> Column:
    """Any word literally inside ``c``; null text holds nothing."""
    if isinstance(ws, Column):
        return F.coalesce(F.exists(ws, lambda w: F.contains(c, w)), no())
    if not ws:
        return no()
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in ws]), no())


def matched_keywords(c: Column, ws: list[str] | Column, n: int | None = None) -> Column:
    """The words found, in the order of the list, at most ``n``."""
    bank = ws if isinstance(ws, Column) else words(ws)
    hit = F.filter(bank, lambda w: F.coalesce(F.contains(c, w), no()))
    return hit if n is None else F.slice(hit, 1, n)


def quality_flags(c: Column, script: str = r"一-鿿") -> Column:
    raw = F.coalesce(c, F.lit(""))

    def flags(x: Column) -> Column:
        share = F.length(sub(x, f"[^{script}]")) / F.greatest(F.length(x), F.lit(1))
        return F.array_compact(
            F.array(
                F.when(F.length(x) < 80, "文字过少"),
                F.when(raw.rlike(r"(?i)<div|!\[|\]\(|☐|☑|🔄"), "存在图片或复选框残留"),
                F.when(F.contains(raw, F.lit("�")), "存在替换字符"),
                F.when((x != "") & (share < 0.2), "中文占比偏低"),
                F.when(x.rlike(r"[0-9]\s+[0-9]\s+[0-9]\s+[0-9]"), "疑似表格识别错位"),
            )
        )

    return let(strip_artifacts(raw), flags)


def is_signature_page(c: Column, boilerplate: str = v.SIGNATURE_BOILERPLATE, signs: list[str] = v.SIGNATURE_WORDS) -> Column:
    return let(
        squeeze(F.coalesce(c, F.lit(""))),
        lambda x: (F.length(x) < 120) | (contains_any(x, signs) & (F.length(sub(x, boilerplate)) < 80)),
    )


def is_continuation(compact: Column, titles: list[str] = v.CONTINUATION_TITLES) -> Column:
    """For compacted text: no title word near the start; empty text is no continuation."""
    return (compact != "") & ~contains_any(F.substring(compact, 1, 120), titles)


def has_title(compact: Column, kind: Column, titles: dict[str, list[str]] = v.STANDALONE_TITLES) -> Column:
    head = F.substring(compact, 1, 360)
    return reduce(lambda a, kv: a | ((kind == kv[0]) & contains_any(head, kv[1])), titles.items(), no())


def looks_like_lab(compact: Column, titles=v.LAB_TITLES, evidence=v.LAB_EVIDENCE, items=v.LAB_ITEMS) -> Column:
    return contains_any(F.substring(compact, 1, 260), titles) | (
        contains_any(compact, evidence) & contains_any(compact, items)
    )


def looks_like_exam(
    compact: Column, subtype: Column, modality=v.MODALITY_WORDS, default=v.MODALITY_DEFAULT,
    structure=v.REPORT_STRUCTURE, film: str = "imaging_film",
) -> Column:
    head = F.substring(compact, 1, 360)
    parts = F.size(matched_keywords(compact, structure))

    def test(ws):
        return (contains_any(head, ws) & (parts >= 1)) | (contains_any(compact, ws) & (parts >= 2))

    out = F.when(subtype == film, F.lit(True))
    for kind, ws in modality.items():
        out = out.when(subtype == kind, test(ws))
    return F.coalesce((compact != "") & out.when(subtype.isNotNull(), test(default)), no())


def is_weak(p: Column, default_type: str = "imaging_report", default_subtype: str = "other_imaging_report") -> Column:
    """``p``: struct with type, subtype, confidence, keywords, continuation."""
    no_type = F.coalesce(p["type"], F.lit("")) == ""
    vague = (
        (p["type"] == default_type) & (p["subtype"] == default_subtype)
        & (F.coalesce(p["confidence"], F.lit(0.0)) <= 0.75) & (F.coalesce(F.size(p["keywords"]), F.lit(0)) <= 0)
    )
    return no_type | F.coalesce(vague, no())


def is_soft(p: Column, **kw) -> Column:
    low = F.coalesce(p["confidence"], F.lit(0.0)) < 0.66
    loose = F.coalesce(p["continuation"], no()) & (F.coalesce(F.size(p["keywords"]), F.lit(0)) <= 0)
    return is_weak(p, **kw) | low | loose


def is_weak_finding(
    text: Column, flags: Column, positive=v.POSITIVE_WORDS, hedging=v.HEDGING_WORDS,
    generic=("lab_report", "generic_exam_part"),
) -> Column:
    return F.coalesce(F.arrays_overlap(flags, words(list(generic))), no()) | (
        ~contains_any(text, positive) & contains_any(text, hedging)
    )


def has_positive_hit(c: Column, patterns: list[str], negatives: list[str], window: int = 12) -> Column:
    """A pattern hit with no negative word within ``window`` characters of it.

    The windows of hits overlap, which a regex that consumes its context cannot see. The places
    of a pattern's hits follow from the hits and the texts between them, in one fold that
    looks at each hit's window by itself. A pattern must not match the empty text.
    """
    x = squeeze(F.coalesce(c, F.lit("")))

    def clear(t: Column, pattern: str) -> Column:
        hits = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit"))
        start = F.struct(F.lit(0).alias("at"), no().alias("clear"))

        def step(s: Column, h: Column) -> Column:
            begin = s["at"] + F.length(h["gap"])
            end = begin + F.length(h["hit"])
            first = F.greatest(begin - window, F.lit(0))
            around = F.substr(t, first + 1, end + window - first)
            return F.struct(end.alias("at"), (s["clear"] | ~contains_any(around, negatives)).alias("clear"))

        return F.aggregate(F.filter(hits, lambda h: h["hit"].isNotNull()), start, step, lambda s: s["clear"])

    hit = lambda t: reduce(lambda a, b: a | b, [clear(t, p) for p in patterns], no())
    found = lambda t: t.rlike("|".join(f"(?:{p})" for p in patterns))
    return let(x, lambda t: F.when(contains_any(t, negatives), hit(t)).otherwise(found(t)))


def has_sign(c: Column, positive: list[str], negative: list[str]) -> Column:
    x = squeeze(F.coalesce(c, F.lit("")))
    return let(x, lambda t: ~contains_any(t, negative) & contains_any(t, positive))


def has_procedure(
    c: Column, act: str, subjects: list[str], direct: list[str], excluded: str, unless: list[str], gap: int = 12
) -> Column:
    """An act next to one of its subjects, unless only the excluded phrase carries it."""
    near = "(?:" + "|".join(re.escape(s) for s in subjects) + ")[^。；;，,]{0," + str(gap) + "}" + re.escape(act)

    def test(x: Column) -> Column:
        barred = F.contains(x, F.lit(excluded)) & ~contains_any(x, unless)
        return F.contains(x, F.lit(act)) & ~barred & (contains_any(x, direct) | x.rlike(near))

    return let(squeeze(F.coalesce(c, F.lit(""))), test)


def request_flags(c: Column, topics: dict = v.REQUEST_TOPICS) -> Column:
    return F.struct(
        *[(contains_any(c, yes) & ~contains_any(c, no)).alias(name) for name, (yes, no) in topics.items()]
    )


def has_work_trace(c: Column, bad: list[str] = v.TRACE_WORDS, opening: str = v.REQUIRED_OPENING) -> Column:
    x = squeeze(F.coalesce(c, F.lit("")))
    return let(x, lambda t: (t == "") | contains_any(t, bad) | ~F.startswith(t, F.lit(opening)))


def text_len(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit(""))))


CORE_FIELDS = ["complaint", "history", "exam", "diagnosis_in", "diagnosis_out", "orders"]


def needs_refresh(df: DataFrame, present: str = "record_id", core: list[str] = CORE_FIELDS) -> Column:
    """Column for records left-joined to their groups: no record means refresh."""
    missing = reduce(lambda a, b: a + b, [(text_len(F.col(f)) == 0).cast("int") for f in core])
    dated = (F.coalesce(F.col("date_in"), F.lit("")) != "") | (F.coalesce(F.col("date_out"), F.lit("")) != "")
    thin = (missing >= 3) | ~dated | (text_len(F.col("exam")) < 20) | (text_len(F.col("orders")) < 20)
    return (
        F.when(F.col(present).isNull(), True)
        .when(F.col("review_status") == "confirmed", False)
        .otherwise(thin)
    )


def filter_status(df: DataFrame, status: str | None, col: str = "status", done: str = "completed") -> DataFrame:
    if not status:
        return df
    return df.filter(F.col(col) != done) if status == "draft" else df.filter(F.col(col) == status)


def needs_second_opinion(p: Column, threshold: float = 0.80) -> Column:
    return (F.coalesce(p["type"], F.lit("")) == "") | (F.coalesce(p["confidence"], F.lit(0.0)) < threshold)


def split_for_second_opinion(df: DataFrame, p: str = "prediction", threshold: float = 0.80) -> tuple[DataFrame, DataFrame]:
    slow = needs_second_opinion(F.col(p), threshold)
    return df.filter(slow), df.filter(~slow)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.65, "medium").otherwise("low")


def needs_ocr(chars: Column, pages: Column, per_page: int = 30) -> Column:
    return (pages > 0) & (chars < pages * per_page)


PAGE_NAME = r"(?i)^case[0-9]+_[A-Za-z0-9]+-[0-9]+\.(?:png|jpg|jpeg)$"


def valid_page_name(c: Column) -> Column:
    return F.coalesce(c.rlike(PAGE_NAME), no())


def valid_prefix(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^case[0-9]+_[A-Za-z0-9]+$"), no())


def group_check(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Disposition of the group named by each row: none, ok, unknown or wrong_type."""
    g = groups.select(
        F.col("group_id"), F.col("case_id").alias("_case"), F.col("type").alias("_type")
    )
    same = rows.join(g, "group_id", "left")
    found = F.col("_case").eqNullSafe(F.col("case_id"))
    state = (
        F.when(F.col("group_id").isNull(), "none")
        .when(~found, "unknown")
        .when(F.col("_type") != F.col("type"), "wrong_type")
        .otherwise("ok")
    )
    return same.withColumn("group_state", state).drop("_case", "_type")


def import_state(c: Column, minimum: int = 30) -> Column:
    return F.when(text_len(c) >= minimum, "ok").otherwise("too_short")
