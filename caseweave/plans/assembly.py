"""Text per case from rows: drafts, sentences, sections. Long texts come in parts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions.extract import elapsed_phrase
from caseweave.functions.text import birth_text, blank_to_null, clip_hard, display_date, join_nonempty, normalize_request, normalize_summary, section_no, strip
from caseweave.operators.split import split_row_number, text_parts


def _has(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def page_list(c: str = "source_pages") -> Column:
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(F.col(c).cast("array<string>"), ", "))


def summary_draft(facts: DataFrame, numbers: DataFrame | None = None, size: int = 1000) -> DataFrame:
    """Draft per case in parts: a numbered section per organisation in order of first mention.

    facts: case_id, ord (fact order), org, fact_date, title, summary, source_pages. Lines are
    numbered over all tasks, so a case of any size is cut into parts of ``size`` lines.
    """
    d = facts.withColumn("org", F.coalesce(F.nullif("org", F.lit("")), F.lit("相关医院")))
    firsts = d.groupBy("case_id", "org").agg(F.min("ord").alias("_first"))
    firsts = split_row_number(firsts, ["case_id"], [F.col("_first"), F.col("org")], F.floor(F.col("_first") / 100_000), "_no")
    d = d.filter(_has("summary"))
    used = d.select("case_id", "org").distinct()
    heads = firsts.join(used, ["case_id", "org"], "left_semi")
    number = F.lit("")
    if numbers is not None:
        heads = heads.join(numbers, ["case_id", "org"], "left")
        number = F.when(_has("number"), F.concat(F.lit("（住院号："), "number", F.lit("）"))).otherwise("")
    head = F.concat(section_no(F.col("_no")), F.lit("据"), "org", F.lit("住院病历"), number, F.lit("记载："))
    heads = heads.select("case_id", "_no", F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("_kind"), F.concat(F.when(F.col("_no") > 1, "\n").otherwise(""), head).alias("line"))
    body = F.concat(F.coalesce(F.nullif("fact_date", F.lit("")), F.lit(fixed.UNDATED)), F.lit("，"), F.coalesce(F.nullif("title", F.lit("")), F.lit("病历事实")), F.lit("："), strip(F.col("summary")))
    body = F.concat(body, F.coalesce(F.concat(F.lit("（来源页："), page_list(), F.lit("）")), F.lit("")))
    lines = d.join(firsts.select("case_id", "org", "_no"), ["case_id", "org"]).select("case_id", "_no", "ord", F.lit(1).alias("_kind"), body.alias("line"))
    order = [F.col("_no"), F.col("_kind"), F.col("ord")]
    return text_parts(heads.unionByName(lines), ["case_id"], order, F.struct("_no", "_kind", F.floor(F.col("ord") / 100_000).alias("o")), F.col("line"), "\n", size)


def _sentence(c: Column) -> Column:
    x = F.btrim(c, F.lit(" \n\t。；;,，"))
    return F.when(x == "", "").when(F.right(x, F.lit(1)).isin("！", "？"), x).otherwise(F.concat(x, F.lit("。")))


def record_sentence(no: Column) -> Column:
    """Summary sentence of a stay record; clauses without a value are left out."""
    part = lambda c, a, b: F.when(_has(c), F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b)))
    dates = F.nullif(F.concat_ws("，", part("date_in", "", "入院"), part("date_out", "", "出院"), F.when(F.coalesce(F.col("days"), F.lit(0)) != 0, part("days", "住院", "天"))), F.lit(""))
    return F.concat_ws(
        "", section_no(no), F.lit("据"), F.coalesce(F.nullif("org", F.lit("")), F.lit("某医院")), F.lit("住院病案"), part("number", "（住院号：", "）"), F.lit("记载："),
        F.concat(dates, F.lit("。")), part("complaint", "入院时以“", "”为主诉。"), part("diagnosis_in", "入院诊断为：", "。"),
        F.when(_has("treatment"), _sentence(F.concat(F.lit("住院期间予以"), "treatment"))), part("diagnosis_out", "出院诊断为：", "。"), part("orders", "出院医嘱：", "。"),
    )


def case_narrative(cases: DataFrame, orgs: DataFrame, inline: int = 1000) -> DataFrame:
    """Accident text, visited organisations, closing request sentence.

    cases: case_id, description, entrusting_unit, request, person; orgs: case_id, org, ord
    (distinct, see ordered_distinct). Names beyond ``inline`` follow in further parts.
    """
    n = orgs.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    parts = text_parts(orgs, ["case_id"], [F.col("ord")], F.floor(F.col("ord") / 100_000), F.col("org"), "、", inline)
    last = parts.groupBy("case_id").agg(F.max("part").alias("_last"))
    d = cases.join(n, "case_id", "left").join(parts, "case_id", "left").join(last, "case_id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
    who = F.coalesce(F.nullif("person", F.lit("")), F.lit(fixed.DEFAULT_PERSON))
    first, end = F.col("part") == 0, F.col("part") == F.coalesce("_last", F.lit(0))
    visit = F.concat(who, F.lit("伤后"), F.when(F.col("_n") > 1, "先后").otherwise(""), F.lit("就诊于"))
    seen = F.col("text").isNotNull()
    close = F.concat(F.lit("现为处理案件需要，"), F.coalesce(F.nullif("entrusting_unit", F.lit("")), F.lit("委托单位")), F.lit("特委托我鉴定中心"), normalize_request(F.coalesce("request", F.lit("")), who), F.lit("。"))
    text = F.concat_ws("", F.when(first, F.col("description")), F.when(first & seen, visit), F.when(~first, "、"), F.when(seen, F.col("text")), F.when(seen & end, "。"), F.when(end, close))
    return d.select("case_id", "part", text.alias("narrative"))


def review_line(person: Column) -> Column:
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = F.when(_has("film_no"), F.concat(F.lit("（号"), "film_no", F.lit("）"))).otherwise("")
    return F.concat(F.lit("复阅"), e("date"), e("org"), person, e("part"), e("kind"), F.lit("片"), number, F.lit("示："), F.substring(e("content"), 1, 150), F.lit("。"))


def review_lines(reports: DataFrame, size: int = 1000) -> DataFrame:
    """Review lines per case in time order (ord), in parts."""
    return text_parts(reports.withColumn("_line", review_line(F.col("person"))), ["case_id"], [F.col("ord")], F.col("bucket"), F.col("_line"), "\n", size)


NORM_CLINICAL = "按照《法医临床检验规范》（SF/Z JD0103003-2011）"
NORM_IMAGING = "和《法医临床影像学检验实施规范》（SF/Z JD0103006-2014）"


def procedure_text(d: DataFrame) -> Column:
    """cases: person, exam_date, accident_date, clinical, has_exams, review (may be null)."""
    who = F.coalesce(F.nullif("person", F.lit("")), F.lit(fixed.DEFAULT_PERSON))
    opening = F.concat(F.lit(NORM_CLINICAL), F.when(F.col("has_exams"), NORM_IMAGING).otherwise(""), F.lit("对"), who, F.lit("进行法医临床学检查。"))
    shown = display_date(F.coalesce("exam_date", F.lit("")))
    since = F.when(_has("accident_date") & _has("exam_date"), elapsed_phrase(F.col("accident_date"), F.col("exam_date"))).otherwise("")
    date_line = F.concat(F.when(shown != "", F.concat(shown, F.lit("，"))).otherwise(""), F.when(since != "", F.concat(F.lit("即被鉴定人"), who, since, F.lit("。"))).otherwise(""))
    return F.concat_ws("\n\n", opening, F.nullif(date_line, F.lit("")), blank_to_null(F.col("clinical")), F.nullif("review", F.lit("")))


FIRST_LINE = "根据委托单位提供的现有材料，结合本鉴定中心检验所见，现分析如下："
NOTHING_YET = "现有已采信事实尚不足以直接形成伤残等级或三期结论，需结合临床检查及规范条款进一步核对。"


def standard_sentence(ref: Column) -> Column:
    name = F.coalesce(F.nullif(ref["doc_title"], F.lit("")), F.lit("相关标准"))
    grade = F.when(F.coalesce(ref["grade"], F.lit("")) != "", F.concat(F.lit("（"), ref["grade"], F.lit("）"))).otherwise("")
    label = F.coalesce(F.nullif(ref["label"], F.lit("")), F.lit(""))
    full = F.concat(F.lit("《"), name, F.lit("》"), grade, F.when(label != "", F.concat(F.lit("中关于“"), label, F.lit("”的规定"))).otherwise("相关规定"))
    return F.when(ref.isNull(), "相关规定并结合临床资料综合评定").otherwise(full)


def analysis_text(cases: DataFrame, cands: DataFrame) -> DataFrame:
    """Conservative text per case: two fixed lines, then the accepted candidates the request
    asks for. cases: case_id, person, accident, diagnoses, flags (struct); cands: case_id, ord,
    title, category, decision, status, reason, grade, suggestion, standard (struct)."""
    who = F.coalesce(F.nullif("person", F.lit("")), F.lit(fixed.DEFAULT_PERSON))
    f = F.col("flags")
    c = cands.filter((F.col("decision") == "met") & (F.col("status") == "accepted")).join(cases.select("case_id", "person", "flags"), "case_id")
    periods = f["work_loss"] | f["nursing"] | f["nutrition"]
    rank = F.when((F.col("category") == "伤残等级") & f["disability"], 0).when((F.col("category") == "三期") & periods, 1)
    c = c.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    c = split_row_number(c, ["case_id"], [F.col("_rank"), F.col("ord")], F.col("_rank"), "_i")
    std = standard_sentence(F.col("standard"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("相关损伤"))
    reason = F.rtrim(F.coalesce("reason", F.lit("")), F.lit("。"))
    reason = F.when(reason != "", F.concat(reason, F.lit("。"))).otherwise("")
    grade = F.coalesce(F.nullif("grade", F.lit("")), F.lit("相应等级"))
    suggestion = F.rtrim(F.coalesce(F.nullif("suggestion", F.lit("")), F.nullif("grade", F.lit("")), F.lit("在相应期限范围内综合评定")), F.lit("。"))
    first = F.concat(F.lit("被鉴定人"), who, title, F.lit("。"), reason, F.lit("有鉴于此，参照"), std, F.lit("，被鉴定人"), who, title, F.lit("应评为"), grade, F.lit("伤残。"))
    second = F.concat(
        F.lit("被鉴定人"), who, F.lit("因本次外伤接受临床治疗，伤情稳定恢复。因此，根据其损伤情况，结合其年龄、自身情况、临床治疗经过、目前恢复情况，参照"), std, F.lit("有关规定，"), suggestion, F.lit("。")
    )
    c = c.withColumn("_line", F.concat((F.col("_i") + 2).cast("string"), F.lit(". "), F.when(F.col("_rank") == 0, first).otherwise(second)))
    lines = c.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda s: s["_line"]).alias("_lines"))
    cause = F.when(F.contains(F.coalesce("accident", F.lit("")), F.lit("交通事故")) | F.contains(F.coalesce("accident", F.lit("")), F.lit("道路交通")), "道路交通事故").otherwise("本次事故")
    one = F.concat(F.lit("1. 被鉴定人"), who, F.lit("外伤史确切，系"), cause, F.lit("所致。"))
    two = F.when(_has("diagnoses"), F.concat(F.lit("2. 被鉴定人"), who, F.lit("外伤致"), "diagnoses", F.lit("等诊断明确（经病历、影像学检查及手术等证实）。"))).otherwise(
        F.concat(F.lit("2. 被鉴定人"), who, F.lit("本次外伤后相关损伤诊断明确（经病历及检查材料证实）。"))
    )
    rest = F.coalesce(F.array_join("_lines", "\n\n"), F.lit("3. " + NOTHING_YET))
    return cases.join(lines, "case_id", "left").select("case_id", F.concat_ws("\n\n", F.lit(FIRST_LINE), one, two, rest).alias("text"))


def evidence_brief(e: Column) -> Column:
    pages = F.when(F.coalesce(F.size(e["source_pages"]), F.lit(0)) > 0, F.concat(F.lit("页码"), F.array_join(e["source_pages"].cast("array<string>"), ","))).otherwise("页码未明")
    date = F.when(F.coalesce(e["date"], F.lit("")) != "", F.concat(e["date"], F.lit(" "))).otherwise("")
    quote = F.coalesce(F.nullif(e["quote"], F.lit("")), e["summary"], F.lit(""))
    return F.concat(date, F.coalesce(F.nullif(e["title"], F.lit("")), e["kind"], F.lit("来源")), F.lit("（"), pages, F.lit("）："), clip_hard(quote, 80))


def candidate_context(cands: DataFrame) -> DataFrame:
    """Context text per candidate with its first five evidence rows and its warnings."""
    ev = F.nullif(F.array_join(F.transform(F.slice("evidence", 1, 5), evidence_brief), "；"), F.lit(""))
    more = F.when(F.col("status").isin("excluded", "needs_review"), F.array(F.lit("该候选未被采信，正文不得写成正式结论。"))).otherwise(F.array().cast("array<string>"))
    warn = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), more)
    return cands.withColumn("context", F.concat_ws(
        "\n", F.concat(F.lit("- ["), "decision", F.lit("; status="), "status", F.lit("] "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("  类别："), F.coalesce("category", F.lit(""))), F.concat(F.lit("  来源："), F.coalesce(ev, F.lit("未列出来源"))),
        F.when(F.size(warn) > 0, F.concat(F.lit("  风险提示："), F.array_join(warn, "；"))),
    ))


def report_rows(cases: DataFrame, persons: DataFrame, reports: DataFrame, summaries: DataFrame, location: str = "") -> DataFrame:
    """The whole report as one row per case, with fallbacks and placeholders."""
    d = cases.join(persons, "case_id", "left").join(reports, "case_id", "left").join(summaries, "case_id", "left")
    p = fixed.PLACEHOLDERS
    born = F.when(_has("birth_date"), F.concat(birth_text(F.col("birth_date")), F.lit("生"))).otherwise("")
    ident = F.nullif(F.concat(born, F.when(_has("id_number"), F.concat(F.lit("（"), "id_number", F.lit("）"))).otherwise("")), F.lit(""))
    person = F.concat_ws("，", F.coalesce(F.nullif("name", F.lit("")), F.lit("待填写")), F.nullif("gender", F.lit("")), ident, F.when(_has("address"), F.concat(F.lit("住"), "address")))
    pick = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return d.select(
        "case_id", F.coalesce(pick("entrusting_unit"), F.lit(p["entrusting_unit"])).alias("entrusting_unit"), F.coalesce(pick("request"), F.lit(p["request"])).alias("request"),
        person.alias("person"), F.coalesce(pick("case_facts", "description"), F.lit(p["case_facts"])).alias("case_facts"),
        F.coalesce(pick("material_summary", "record_summary"), F.lit(p["material_summary"])).alias("material_summary"),
        *[F.coalesce(pick(c), F.lit(p[c])).alias(c) for c in ("appraisal_process", "analysis", "opinion")],
    )


SUMMARY_FORM = "据.+?(病历|住院|医院).*记载"


def accept_or_draft(drafts: DataFrame, generated: DataFrame, form: str = SUMMARY_FORM) -> DataFrame:
    """The supplied summary where it has the required form, else the draft; ``method`` says which."""
    d = drafts.join(generated.select("case_id", normalize_summary(strip(F.col("text"))).alias("_g")), "case_id", "left")
    ok = F.coalesce(F.col("_g").rlike(form), F.lit(False))
    return d.select("case_id", F.when(ok, F.col("_g")).otherwise(normalize_summary(F.col("draft"))).alias("text"), F.when(ok, "supplied").otherwise("draft").alias("method"))
