"""Text cleaning columns. All native expressions; one Arrow function for rare entities."""
from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave import fixed

# Blanks as a Unicode-aware engine sees them (the plain \s misses the wide blank).
WS_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
WS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same blanks for Java: single signs below 256 are one table look-up, signs beyond U+3000 leave at once.
FAST_WS = (
    r"[\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
TAG = r"<[^>]+>"
# '&amp;' goes last so that a doubly escaped entity is opened only once.
COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}
_RARE_ENTITY = r"&(?!(?:lt|gt|quot|nbsp|copy|middot|amp|#39);)[#a-zA-Z]"


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def let(c: Column, fn) -> Column:
    """Evaluate ``c`` once and hand it to ``fn``; keeps chained expressions small."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def strip(c: Column, chars: str = WS_CHARS) -> Column:
    return F.btrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """Runs of blanks to one blank, ends trimmed."""
    return strip(sub(c, FAST_WS + "+", " "))


def squeeze(c: Column) -> Column:
    """All blanks removed."""
    return sub(c, FAST_WS + "+")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


@F.pandas_udf(T.StringType())
def _unescape_rare(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if v is not None else None)


def unescape_html(c: Column, rare: bool = True) -> Column:
    """Entities to characters. Only rows with a rare entity travel to Python."""
    opened = reduce(
        lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), COMMON_ENTITIES.items(), c
    )
    marked = F.contains(c, F.lit("&"))
    native = F.when(marked, opened).otherwise(c)
    if not rare:
        return native
    return F.coalesce(_unescape_rare(F.when(marked & c.rlike(_RARE_ENTITY), c)), native)


def clean_ocr(c: Column, rare: bool = True) -> Column:
    x = unescape_html(F.coalesce(c, F.lit("")), rare)
    # Images and tags are looked for only where their first sign is.
    x = let(x, lambda y: F.when(F.contains(y, F.lit("![")), sub(y, IMAGE, " ")).otherwise(y))
    x = let(x, lambda y: F.when(F.contains(y, F.lit("<")), sub(y, TAG, " ")).otherwise(y))
    return collapse(F.replace(x, F.lit("|"), F.lit(" ")))


def compact_text(c: Column, keep_space: bool = False, heading_marks: bool = True) -> Column:
    x = F.replace(F.coalesce(c, F.lit("")), F.lit("<nl>"), F.lit("\n"))
    x = sub(x, IMAGE, " " if keep_space else " 图片 ")
    x = sub(x, TAG, " ")
    if keep_space:
        x = F.replace(x, F.lit("&nbsp;"), F.lit(" "))
    if heading_marks:
        x = sub(x, "#+", " ")
    return collapse(x) if keep_space else squeeze(x)


def normalize_text(c: Column) -> Column:
    x = sub(F.coalesce(c, F.lit("")), r"\r\n|\r|\f", "\n")
    x = sub(x, r"[ \t]+", " ")
    x = sub(x, r"\n{3,}", "\n\n")
    x = sub(x, rf"(?md)^[—\-－]{WS}*[0-9]+{WS}*[—\-－]{WS}*$")
    return strip(x)


def strip_artifacts(c: Column) -> Column:
    x = normalize_text(c)
    x = sub(x, rf"(?i)<div[^>]*>{WS}*{IMAGE}{WS}*</div>")
    x = sub(x, IMAGE)
    x = sub(x, "[☐☑🔄]")
    x = sub(x, r"[ \t]*\n[ \t]*", "\n")
    return strip(sub(x, r"\n{3,}", "\n\n"))


def trim_phrase(c: Column) -> Column:
    x = compact_text(c)
    return F.rtrim(F.ltrim(x, F.lit("：:；;，,。、" + WS_CHARS)), F.lit("；;，,。、" + WS_CHARS))


def clip_ellipsis(c: Column, n: int) -> Column:
    x = strip(F.coalesce(c, F.lit("")))
    cut = F.rtrim(F.substring(x, 1, n), F.lit(WS_CHARS))
    return F.when(F.length(x) <= n, x).otherwise(F.concat(cut, F.lit("...")))


def clip_or_null(c: Column, n: int) -> Column:
    x = F.nullif(strip(collapse(c), " ：:;；。"), F.lit(""))
    return strip(F.substring(x, 1, n))


def clip_hard(c: Column, n: int) -> Column:
    return F.substring(collapse(F.coalesce(c, F.lit(""))), 1, n)


def join_sentences(*parts: Column) -> Column:
    kept = F.filter(F.array(*[blank_to_null(p) for p in parts]), lambda p: p.isNotNull())
    ended = F.transform(
        kept, lambda p: F.when(F.right(p, F.lit(1)).isin("。", "；", ";"), p).otherwise(F.concat(p, F.lit("。")))
    )
    return F.array_join(ended, "")


def join_nonempty(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[blank_to_null(p) for p in parts])


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def title_from_filename(c: Column) -> Column:
    x = sub(file_name(c), r"^(.+)\.[^.]+$", "$1")
    x = strip(F.replace(x, F.lit("+"), F.lit(" ")))
    x = sub(sub(x, rf"^[0-9]+\.{WS}*"), rf"{WS}*1$")
    return strip(F.replace(x, F.lit("_"), F.lit(" ")))


def clean_generated(c: Column, openers: list[str]) -> Column:
    """Model answer to plain text. ``openers`` are patterns of a known first sentence."""
    first = "(?s)((?:" + "|".join(openers) + ").*)$"

    def without_open_block(x: Column) -> Column:
        return F.when(x.rlike(r"(?i)<think\b"), strip(F.regexp_extract(x, first, 1))).otherwise(x)

    def without_fence(x: Column) -> Column:
        body = sub(sub(x, r"^```[^\n]*(?:\n|$)"), rf"(?:^|\n){WS}*```$")
        return F.when(F.startswith(x, F.lit("```")), strip(body)).otherwise(x)

    x = strip(sub(F.coalesce(c, F.lit("")), r"(?is)<think\b[^>]*>.*?</think>"))
    x = let(let(x, without_open_block), without_fence)
    x = sub(x, rf"(?md)^{WS}*[-*]{WS}+")
    return strip(sub(x, r"\n{3,}", "\n\n"))


def replace_aliases(c: Column, aliases: Column, canonical: Column) -> Column:
    """Replace every alias of three or more characters, longest first."""
    usable = F.filter(aliases, lambda a: (F.length(a) >= 3) & (a != canonical))
    keyed = F.array_sort(
        F.transform(F.array_distinct(usable), lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))
    )
    return F.aggregate(keyed, c, lambda acc, s: F.replace(acc, s["a"], canonical))


def normalize_summary(c: Column) -> Column:
    x = F.replace(c, F.lit("住院病案"), F.lit("住院病历"))
    x = sub(x, rf"（{WS}*来源页{WS}*[:：][^）]*）")
    x = sub(x, rf"\({WS}*来源页{WS}*[:：][^)]*\)")
    return F.when(x.rlike("^据[^\n]+?住院病历"), F.concat(F.lit("（一）"), x)).otherwise(x)


def drop_blocks(c: Column, terms: list[str], allowed: Column) -> Column:
    """struct(text, dropped): numbered blocks from 3 on that mention a term are removed."""
    hits = lambda s: reduce(lambda a, t: a | F.contains(s, F.lit(t)), terms, F.lit(False))
    run = ~F.coalesce(allowed, F.lit(False)) & hits(c)
    blocks = F.filter(
        F.transform(F.split(c, rf"(?md)(?=^{WS}*[0-9]+\.{WS}*)"), lambda x: strip(x)), lambda b: b != ""
    )

    def topical(b: Column) -> Column:
        number = F.regexp_extract(b, r"^([0-9]+)\.", 1)
        from_three = (F.length(F.ltrim(number, F.lit("0"))) > 1) | (F.ltrim(number, F.lit("0")) >= "3")
        return (number != "") & from_three & hits(b)

    def build(bs: Column) -> Column:
        kept = F.filter(bs, lambda b: ~topical(b))
        text = F.when(run & (F.size(kept) > 0), F.array_join(kept, "\n\n")).otherwise(c)
        return F.struct(text.alias("text"), (run & (F.size(kept) < F.size(bs))).alias("dropped"))

    return let(blocks, build)


def label_map(labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])


def label_of(c: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(label_map(labels), c), c)


def normalize_request(c: Column, person: Column) -> Column:
    generic = F.lit(fixed.DEFAULT_PERSON)
    who = F.coalesce(blank_to_null(person), generic)
    named = who != generic
    parties = "(?:申请人|被鉴定人|伤者|原告)"

    def with_name(x: Column) -> Column:
        # The name is put in by a literal replace, so a name may hold any character.
        marked = sub(sub(x, f"对{parties}", "对\u0001"), f"{parties}的", "\u0001的")
        return F.when(named, F.replace(marked, F.lit("\u0001"), who)).otherwise(x)

    def with_start(x: Column) -> Column:
        return (
            F.when(F.startswith(x, F.lit("对")), x)
            .when(F.startswith(x, who), F.concat(F.lit("对"), x))
            .when(named, F.concat(F.lit("对"), who, F.lit("的"), x))
            .otherwise(F.concat(F.lit("对"), x))
        )

    def with_end(x: Column) -> Column:
        return F.when(F.endswith(x, F.lit("鉴定")), x).otherwise(
            F.concat(F.rtrim(x, F.lit("。；;，,、")), F.lit("进行鉴定"))
        )

    def build(x: Column) -> Column:
        y = x
        for filler in ("请求委托鉴定机构", "请求依法委托鉴定机构", "请求"):
            y = F.replace(y, F.lit(filler), F.lit(""))
        made = let(let(let(y, with_name), with_start), with_end)
        return F.when(x == "", F.concat(F.lit("对"), who, F.lit("进行鉴定"))).otherwise(made)

    return let(trim_phrase(c), build)


def split_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[；;，,、]"), lambda x: strip(x)), lambda x: x != "")


def to_numeral(c: Column) -> Column:
    words = F.array(*[F.lit(w) for w in fixed.FORMAL_NUMERALS])
    return F.coalesce(F.get(words, c.cast("int")), c.cast("string"))


def section_no(c: Column) -> Column:
    words = F.array(*[F.lit(w) for w in fixed.SECTION_NUMERALS])
    return F.coalesce(F.get(words, c.cast("int") - 1), F.concat(F.lit("（"), c.cast("string"), F.lit("）")))


CLAUSE_LABEL = (
    r"^((?:附录" + WS + r"*)?[A-ZＡ-Ｚ]?[0-9]+(?:\.[0-9]+)+|附录" + WS + r"*[A-ZＡ-Ｚ]\.[0-9]+)" + WS + "*(.*)$"
)


def split_clause_label(c: Column) -> Column:
    code = squeeze(F.regexp_extract(c, CLAUSE_LABEL, 1))
    title = F.nullif(strip(F.regexp_extract(c, CLAUSE_LABEL, 2)), F.lit(""))
    return F.struct(F.nullif(code, F.lit("")).alias("code"), F.coalesce(title, c).alias("title"))


def display_date(c: Column) -> Column:
    """``2024-03-05 08:00`` to ``2024年03月05日``; other forms stay as they are."""
    p = F.split(F.get(F.split(c, " "), F.lit(0)), "-")
    at = lambda i: F.get(p, F.lit(i))
    shown = F.concat(at(0), F.lit("年"), at(1), F.lit("月"), at(2), F.lit("日"))
    return F.when(F.size(p) == 3, shown).otherwise(c)


def birth_text(c: Column) -> Column:
    x = sub(sub(c, "^([^-]*)-", "$1年"), "^([^-]*)-", "$1月")
    return F.when(F.endswith(x, F.lit("日")), x).otherwise(F.concat(x, F.lit("日")))


def public_path(c: Column, marker: str = "/uploads/") -> Column:
    x = F.replace(c, F.lit("\\"), F.lit("/"))
    at = F.instr(x, marker)
    return (
        F.when(at > 0, F.substring(x, at, F.length(x)))
        .when(F.startswith(x, F.lit(marker.lstrip("/"))), F.concat(F.lit("/"), x))
    )


def effective_text(status: Column, reviewed: Column, raw: Column) -> Column:
    ok = status.isin("completed", "needs_review") & (reviewed != "")
    return F.when(ok, reviewed).otherwise(F.coalesce(raw, F.lit("")))


def truncate_input(c: Column, n: int) -> Column:
    """struct(text, truncated); n <= 0 means no limit."""
    x = strip(F.coalesce(c, F.lit("")))
    if n <= 0:
        return F.struct(x.alias("text"), F.lit(False).alias("truncated"))
    long = F.length(x) > n
    cut = F.concat(F.substring(x, 1, n), F.lit(fixed.TRUNCATION_MARK))
    return F.struct(F.when(long, cut).otherwise(x).alias("text"), long.alias("truncated"))


def first_name(*candidates: Column, default: str = fixed.DEFAULT_PERSON) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(default))
