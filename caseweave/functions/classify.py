"""Rule classification: ordered keyword rules as one cascade of native expressions."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave import vocabulary as v
from caseweave.functions.extract import extract_org
from caseweave.functions.predicates import (
    contains_any, is_continuation, looks_like_exam, looks_like_lab, matched_keywords,
)
from caseweave.functions.text import blank_to_null, compact_text, label_of, squeeze, strip, sub

PREDICTION = (
    "struct<type:string,subtype:string,group:string,confidence:double,reason:string,"
    "keywords:array<string>,continuation:boolean>"
)


@dataclass
class Rules:
    """The rule tables of the classifier. The defaults are the fixed word lists."""

    subtypes: dict = field(default_factory=lambda: v.SUBTYPE_RULES)
    defaults: dict = field(default_factory=lambda: v.SUBTYPE_DEFAULTS)
    header: list = field(default_factory=lambda: v.HEADER_RULES)
    lab: tuple = (v.LAB_TITLES, v.LAB_EVIDENCE, v.LAB_ITEMS)
    lab_hits: list = field(default_factory=lambda: v.LAB_HITS)
    medical_hits: list = field(default_factory=lambda: v.MEDICAL_HITS)
    imaging_hits: list = field(default_factory=lambda: v.IMAGING_HITS)
    modality: dict = field(default_factory=lambda: v.MODALITY_WORDS)
    modality_default: list = field(default_factory=lambda: v.MODALITY_DEFAULT)
    structure: list = field(default_factory=lambda: v.REPORT_STRUCTURE)
    continuation: list = field(default_factory=lambda: v.CONTINUATION_TITLES)
    letter: list = field(default_factory=lambda: v.LETTER_WORDS)
    ident: list = field(default_factory=lambda: v.ID_WORDS)
    litigation: list = field(default_factory=lambda: v.LITIGATION_WORDS)
    certificate: tuple = (v.CERTIFICATE_WORDS, v.CERTIFICATE_FACTS, v.CERTIFICATE_LAW)
    application: list = field(default_factory=lambda: v.APPLICATION_WORDS)
    application_opening: str = "申请"
    org_suffixes: list = field(default_factory=lambda: fixed.ORG_SUFFIXES)
    org_chars: str = r"一-龥"


def _first_rule(text: Column, rules: list) -> Column:
    out = F.lit(None).cast("string")
    for name, ws in reversed(rules):
        out = F.when(contains_any(text, ws), F.lit(name)).otherwise(out)
    return out


def classify_subtype(kind: Column, compact: Column, rules: Rules | None = None) -> Column:
    """First matching rule of the type wins, then the default of the type."""
    r = rules or Rules()
    out = F.lit(None).cast("string")
    for t, rows in r.subtypes.items():
        found = F.coalesce(_first_rule(compact, rows), F.lit(r.defaults[t]))
        if t == "imaging_report":
            found = F.when(looks_like_lab(compact, *r.lab), F.lit("lab_report")).otherwise(found)
        out = F.when(kind == t, found).otherwise(out)
    return F.when(compact != "", out)


def header_subtype(compact: Column, rules: Rules | None = None) -> Column:
    return _first_rule(F.substring(compact, 1, 220), (rules or Rules()).header)


def classify_page(df: DataFrame, text: str = "text", rules: Rules | None = None, out: str = "prediction") -> DataFrame:
    """Page type, subtype, organisation, confidence, reason and keywords as one struct.

    Every test is evaluated once in a wide projection; the cascade then only reads flags.
    """
    r = rules or Rules()
    t = F.col("_t")
    head = F.substring(t, 1, 320)
    hit = lambda ws: matched_keywords(t, ws)
    d = df.withColumn("_t", compact_text(F.col(text)))
    d = d.withColumns(
        {
            "_header": header_subtype(t, r),
            "_lab": looks_like_lab(t, *r.lab),
            "_med": classify_subtype(F.lit("medical_record"), t, r),
            "_img": classify_subtype(F.lit("imaging_report"), t, r),
            "_k_letter": hit(r.letter),
            "_k_ident": hit(r.ident),
            "_k_suit": hit(r.litigation),
            "_k_cert": hit(r.certificate[0]),
            "_k_app": hit(r.application),
            "_k_lab": hit(r.lab_hits),
            "_k_med": hit(r.medical_hits),
            "_k_img": hit(r.imaging_hits),
            "_org": extract_org(F.col(text), r.org_suffixes, r.org_chars),
            "_cont": is_continuation(t, r.continuation),
        }
    )
    has = lambda ws: contains_any(t, ws)
    suit_title = F.contains(head, F.lit(r.litigation[0]))
    suit_parties = F.contains(t, F.lit(r.litigation[1])) & has(r.litigation[2:5])
    cert_title = F.contains(F.substring(t, 1, 120), F.lit(r.certificate[0][0]))
    cert_body = has(r.certificate[1]) & has(r.certificate[2])
    app_title = F.contains(head, F.lit(r.application[0]))
    app_opening = F.startswith(t, F.lit(r.application_opening)) & F.contains(t, F.lit(r.application[-1]))
    app_count = (F.size("_k_app") >= 3) & ~F.contains(F.substring(t, 1, 500), F.lit(r.litigation[1]))
    med, img = F.col("_med"), F.col("_img")
    strong_med = med != r.defaults["medical_record"]
    vague_img = img.isin("imaging_film", r.defaults["imaging_report"])
    exam = (img != r.defaults["imaging_report"]) & looks_like_exam(t, img, r.modality, r.modality_default, r.structure)
    # (condition, type, subtype, confidence, keywords, organisation kept)
    none = F.lit(None).cast("string")
    steps = [
        (F.col("_header").isNotNull(), "medical_record", F.col("_header"), 0.94, "_k_med", True),
        (F.col("_lab"), "imaging_report", F.lit("lab_report"), 0.86, "_k_lab", True),
        (F.contains(head, F.lit(r.letter[0])) | (F.size("_k_letter") >= 2), "entrustment_letter", none, 0.98, "_k_letter", False),
        (F.contains(t, F.lit(r.ident[0])) & has(r.ident[1:]), "id_card", none, 0.98, "_k_ident", False),
        (suit_title, "litigation_material", none, 0.96, "_k_suit", False),
        (suit_parties | (F.size("_k_suit") >= 3), "litigation_material", none, 0.88, "_k_suit", False),
        (cert_title, "traffic_accident_cert", none, 0.98, "_k_cert", False),
        (cert_body, "traffic_accident_cert", none, 0.92, "_k_cert", False),
        (app_title, "appraisal_application", none, 0.96, "_k_app", False),
        (app_opening, "appraisal_application", none, 0.86, "_k_app", False),
        (app_count, "appraisal_application", none, 0.88, "_k_app", False),
        (strong_med & (vague_img | (med != "lab_report")), "medical_record", med, 0.88, "_k_med", True),
        (exam & (img != "imaging_film"), "imaging_report", img, 0.90, "_k_img", True),
        (exam, "imaging_report", img, 0.72, "_k_img", True),
        (img == r.defaults["imaging_report"], "imaging_report", img, 0.70, "_k_img", True),
        (med == r.defaults["medical_record"], "medical_record", med, 0.60, "_k_med", True),
    ]
    pick = F.lit(None).cast("int")
    for i in reversed(range(len(steps))):
        pick = F.when(steps[i][0], F.lit(i)).otherwise(pick)
    d = d.withColumn("_i", F.when(t != "", pick))

    def choose(values, otherwise):
        out = otherwise
        for i in reversed(range(len(steps))):
            out = F.when(F.col("_i") == i, values[i]).otherwise(out)
        return out

    d = d.withColumns(
        {
            "_type": choose([F.lit(s[1]) for s in steps], none),
            "_sub": choose([s[2] for s in steps], none),
            "_conf": choose([F.lit(s[3]) for s in steps], F.lit(0.0)),
            "_kw": choose([F.col(s[4]) for s in steps], F.array().cast("array<string>")),
            "_grp": choose([F.col("_org") if s[5] else none for s in steps], F.when(t != "", F.col("_org"))),
        }
    )
    reason = F.concat_ws(
        "；",
        F.when(F.size("_kw") > 0, F.concat(F.lit("命中关键词："), F.array_join(F.slice("_kw", 1, 5), "、"))),
        F.when(F.col("_sub").isNotNull(), F.concat(F.lit("判断子类型为"), label_of(F.col("_sub"), fixed.SUBTYPES))),
    )
    named = F.coalesce(F.nullif(reason, F.lit("")), F.concat(F.lit("判断为"), label_of(F.col("_type"), fixed.PAGE_TYPES)))
    why = F.when(t == "", "无 OCR 文本").when(F.col("_i").isNull(), "未命中明确分类关键词").otherwise(named)
    made = F.struct(
        F.col("_type").alias("type"), F.col("_sub").alias("subtype"), F.col("_grp").alias("group"),
        F.col("_conf").alias("confidence"), why.alias("reason"), F.slice("_kw", 1, 8).alias("keywords"),
        F.col("_cont").alias("continuation"),
    )
    return d.withColumn(out, made).drop(*[c for c in d.columns if c.startswith("_")])


def normalize_prediction(
    answer: Column, types: list[str] = list(fixed.PAGE_TYPES), subtypes: list[str] = list(fixed.SUBTYPES)
) -> Column:
    """A model answer (JSON text) as a prediction struct; null when the type is not known."""
    get = lambda k: F.get_json_object(answer, f"$.{k}")
    real = lambda c: F.when(~c.isin("", "null", "None"), c)
    kind, sub_kind, group = real(get("material_type")), real(get("material_subtype")), real(get("group_name"))
    number = F.coalesce(strip(get("confidence")).try_cast("double"), F.lit(0.0))
    number = F.when(number > 1, number / 100).otherwise(number)
    listed = F.from_json(get("matched_keywords"), "array<string>")
    single = F.when(F.coalesce(get("matched_keywords"), F.lit("")) != "", F.array(get("matched_keywords")))
    is_object = F.startswith(get("matched_keywords"), F.lit("{"))
    kws = F.coalesce(listed, F.when(~is_object, single), F.array().cast("array<string>"))
    return F.when(
        kind.isNull() | kind.isin(*types),
        F.struct(
            kind.alias("type"),
            F.when(sub_kind.isin(*subtypes), sub_kind).alias("subtype"),
            strip(group).alias("group"),
            F.greatest(F.lit(0.0), F.least(number, F.lit(0.98))).alias("confidence"),
            strip(F.coalesce(F.nullif(get("reason"), F.lit("")), F.lit("LLM 兜底分类"))).alias("reason"),
            F.slice(kws, 1, 8).alias("keywords"),
            F.coalesce(get("is_continuation") == "true", F.lit(False)).alias("continuation"),
        ),
    )


def reclassify(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Recognised rows whose subtype comes out different: adds new_subtype."""
    d = df.filter((F.col("status") == "completed") & (F.col("text") != ""))
    d = d.withColumn("_t", compact_text(F.col("text")))
    new = classify_subtype(F.col("type"), F.col("_t"), rules)
    # Not a filter: Catalyst moves it below the projection and cleans the text for every word again.
    changed = F.filter(F.array(new), lambda n: n.isNotNull() & ~n.eqNullSafe(F.col("subtype")))
    return d.withColumn("new_subtype", F.explode(changed)).drop("_t")


def backfill_subtype(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    d = df.withColumn("_t", compact_text(F.col("text")))
    new = classify_subtype(F.col("type"), F.col("_t"), rules)
    return d.withColumn("subtype", F.coalesce(F.nullif(F.col("subtype"), F.lit("")), new)).drop("_t")


def importance(role: Column, text: Column, core_roles=fixed.CORE_ROLES, core_words=v.CORE_WORDS) -> Column:
    core = F.coalesce(role.isin(*core_roles), F.lit(False)) | contains_any(text, core_words)
    return F.when(core, "core").otherwise("supporting")


def exam_importance(review_status: Column, text: Column, core_words=v.CORE_WORDS) -> Column:
    return (
        F.when(review_status == "excluded", "excluded").when(contains_any(text, core_words), "core").otherwise("supporting")
    )


def import_status(failed: Column, pending: Column, chunks: Column) -> Column:
    return (
        F.when((chunks > 0) & (failed == 0) & (pending == 0), "imported")
        .when(chunks > 0, "partial_failed")
        .when(pending > 0, "needs_ocr")
        .otherwise("failed")
    )


def proofread_decision(
    cleaned: Column, flags: Column, answered: Column | None = None, answer_text: Column | None = None,
    answer_status: Column | None = None, answer_confidence: Column | None = None, max_chars: int = 6000,
) -> Column:
    """struct(text, status, confidence, flags). ``answered``: null no model, false failed, true answered."""
    yes = answered if answered is not None else F.lit(None).cast("boolean")
    text = strip(F.coalesce(answer_text, F.lit(""))) if answer_text is not None else F.lit("")
    status = strip(F.coalesce(answer_status, F.lit(""))) if answer_status is not None else F.lit("")
    given = answer_confidence.try_cast("double").cast("int") if answer_confidence is not None else F.lit(None).cast("int")
    n = F.length(cleaned)
    base = F.when(F.size(flags) == 0, 92).otherwise(78)
    use = yes.isNotNull() & (n > 0)
    tried = use & (n <= max_chars)
    accept = tried & yes & (text != "") & (F.length(text) >= F.greatest(F.lit(40), F.floor(n * 0.75)))
    too_long = use & (n > max_chars)
    case = lambda acc, short, fail, long, empty, rest: (
        F.when(accept, acc).when(tried & yes, short).when(tried, fail).when(too_long, long).when(n == 0, empty).otherwise(rest)
    )
    review = F.lit("needs_review")
    extra = case(None, "LLM返回文本明显短于原文，已保留规则清理文本", "LLM校对失败", "页面文本过长，未进行LLM全文改写", "无可校对文本", None)
    conf = case(
        F.coalesce(given, base), F.least(base, F.lit(55)), F.least(base, F.lit(60)), F.least(base, F.lit(70)), F.lit(0), base
    )
    state = case(F.when(status == "needs_review", review).otherwise("completed"), review, review, review, F.lit("failed"), F.lit("completed"))
    return F.struct(
        F.when(accept, text).otherwise(cleaned).alias("text"),
        state.alias("status"),
        F.greatest(F.lit(0), F.least(F.lit(100), conf)).alias("confidence"),
        F.array_distinct(F.array_compact(F.concat(flags, F.array(extra)))).alias("flags"),
    )


REFERENCE_RULES = {
    # role, words in the document name, request topics that make it so
    "primary": [
        (["人体损伤致残程度分级"], ["disability"]),
        (["误工期"], ["work_loss", "nursing", "nutrition"]),
        (["护理依赖"], ["nursing_dependency"]),
        (["因果关系"], ["causation"]),
    ],
    "supporting": ["法医影像学", "影像学检验", "法医临床检验"],
    "special": (["听觉功能障碍", "视觉功能障碍"], ["听觉", "听力", "耳", "视觉", "视力", "眼"]),
}


def reference_role(doc: Column, flags: Column, context: Column, rules: dict = REFERENCE_RULES) -> Column:
    """struct(role, reason) of a reference: primary, supporting or candidate."""
    made = lambda role, reason: F.struct(F.lit(role).alias("role"), F.lit(reason).alias("reason"))
    out = None
    for ws, topics in rules["primary"]:
        asked = flags[topics[0]]
        for k in topics[1:]:
            asked = asked | flags[k]
        step = (contains_any(doc, ws) & asked, made("primary", f"requested:{'|'.join(topics)}"))
        out = F.when(*step) if out is None else out.when(*step)
    special, context_words = rules["special"]
    out = out.when(contains_any(doc, rules["supporting"]), made("supporting", "examination method"))
    out = out.when(contains_any(doc, special) & contains_any(context, context_words), made("supporting", "special function"))
    out = out.when(contains_any(doc, special), made("candidate", "special function, weakly related"))
    return out.otherwise(made("candidate", "keyword hit, check by hand"))
