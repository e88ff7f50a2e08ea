"""Counters, progress and summary rows: one pass of conditional aggregates each."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.text import blank_to_null

SECTIONS = ["case_facts", "material_summary", "appraisal_process", "analysis", "opinion"]


def _count_if(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0))


def readiness(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """Failed checks per case: basics, record facts, exam facts, report sections."""
    active = facts.filter((F.col("review_status") != "excluded") & (F.col("importance") != "excluded"))
    record = F.col("fact_type").isin("hospital_record", "medical_event")
    exam = F.col("fact_type") == "imaging_report"
    open_ = ~F.coalesce(F.col("review_status").isin("confirmed", "system_verified"), F.lit(False))
    per = active.groupBy("case_id").agg(
        _count_if(record).alias("n_record"), _count_if(record & open_).alias("n_record_open"),
        _count_if(exam).alias("n_exam"), _count_if(exam & open_).alias("n_exam_open"),
    )
    d = cases.join(per, "case_id", "left").fillna(0, ["n_record", "n_record_open", "n_exam", "n_exam_open"])

    def filled(*names):
        out = F.lit(True)
        for n in names:
            out = out & (F.coalesce(F.col(n), F.lit("")) != "")
        return out

    checks = {
        "basics": filled("entrusting_unit", "request", "person_name"),
        "record_facts": (F.col("n_record") > 0) & (F.col("n_record_open") == 0),
        "exam_facts": (F.col("n_exam") > 0) & (F.col("n_exam_open") == 0),
        "sections": filled("entrusting_unit", "person_name", *SECTIONS),
    }
    return d.withColumn("failed", F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()])))


def status_counts(df: DataFrame, keys: list[str], statuses: list[str], col: str = "status") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[_count_if(F.col(col) == s).alias(s) for s in statuses]
    )


def fact_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Review states (null is pending, an unknown one is not counted) and importance."""
    state = F.coalesce(F.nullif("review_status", F.lit("")), F.lit("pending"))
    states = ["confirmed", "system_verified", "pending", "needs_edit", "excluded"]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[_count_if(state == s).alias(s) for s in states],
        *[_count_if(F.col("importance") == s).alias(s) for s in ("core", "supporting")],
    )


def doc_progress(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Recognition and review counters per document; documents without pages stay."""
    review = F.coalesce(F.nullif("review_status", F.lit("")), F.lit("pending"))
    per = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_rows"),
        *[_count_if(F.col("status") == s).alias(s) for s in ("completed", "processing", "failed", "pending")],
        *[_count_if(review == s).alias(f"proofread_{s}") for s in ("completed", "processing", "failed", "pending", "needs_review")],
    )
    return docs.join(per, "doc_id", "left").fillna(0, [c for c in per.columns if c != "doc_id"])


def protection(docs: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Work that must not be overwritten; pages and chunks are aggregated before the join."""
    p = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        _count_if(F.col("status") == "completed").alias("ocr_completed"),
        _count_if(F.coalesce("reviewed", F.lit("")) != "").alias("proofread_count"),
        _count_if(F.col("review_status").isin("completed", "needs_review")).alias("proofread_confirmed"),
    )
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    counts = ["page_count", "ocr_completed", "proofread_count", "proofread_confirmed", "chunk_count"]
    d = docs.join(p, "doc_id", "left").join(c, "doc_id", "left").fillna(0, counts)
    work = F.col("ocr_completed") + F.col("proofread_count") + F.col("proofread_confirmed") + F.col("chunk_count")
    return d.withColumn("protected", work > 0)


def edit_stats(df: DataFrame, sections: dict[str, str]) -> DataFrame:
    """Edits per known section that has any, and the grand total (section null)."""
    from caseweave.functions.text import label_of

    per = df.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    rows = per.filter(F.col("section").isin(*sections)).select(label_of(F.col("section"), sections).alias("section"), "n")
    return rows.unionByName(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(None).cast("string").alias("section"), "n"))


def dashboard(df: DataFrame, first_n: int | None = None, done: str = "completed", latest: int = 8) -> tuple[DataFrame, DataFrame]:
    """(counts by status with total and draft, the latest rows). ``first_n`` counts the newest rows only."""
    base = df if first_n is None else df.orderBy(F.col("created_at").desc(), F.col("case_id").desc()).limit(first_n)
    per = base.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    extra = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("status") != done, F.col("n"))), F.lit(0)).alias("draft")
    ).select(F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in ("all", "draft")])))
    return per.unionByName(extra), df.orderBy(F.col("created_at").desc(), F.col("case_id").desc()).limit(latest)


def queue_counts(df: DataFrame, statuses: list[str], col: str = "review_status") -> DataFrame:
    """One row per status, also where the queue is empty."""
    per = df.groupBy(F.coalesce(F.nullif(col, F.lit("")), F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(per, "status", "full").fillna(0, ["n"])


def run_summary(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    done = F.col("status").isin("completed", "imported", "success")
    kept = F.col("status").isin("skipped", "protected")
    return results.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total"), _count_if(done).alias("succeeded"), _count_if(kept).alias("skipped"), _count_if(F.col("status") == "failed").alias("failed")
    )


GROUP_TEXT_MARK = "\n\n[... 文本过长，已截断 ...]"


def concat_group_text(pages: DataFrame, n: int = 12000) -> DataFrame:
    """Text of a group with page headers in page order, cut at ``n``.

    Only pages that can reach into the first ``n`` characters are collected.
    """
    from caseweave.operators.split import char_budget, first_rows
    from caseweave.functions.text import strip

    order = [F.col("page_number"), F.col("page_id")]
    d = pages.filter((F.col("status") == "completed") & (F.col("text") != ""))
    # Every page adds a header of more than twenty characters.
    d = first_rows(d, ["group_id"], order, n // 20 + 2, "_i")
    line = F.concat(
        F.lit("\n\n===== 第"), F.col("_i").cast("string"), F.lit("页 ("), F.coalesce("file_name", F.lit("None")), F.lit(") =====\n"), F.substring("text", 1, n + 2)
    )
    d = char_budget(d.withColumn("_line", line), ["group_id"], [F.col("_i")], F.col("_line"), n + 2, mode="cut_after")
    parts = F.array_sort(F.collect_list(F.struct("_i", "_line")))
    text = d.groupBy("group_id").agg(strip(F.array_join(F.transform(parts, lambda p: p["_line"]), "")).alias("text"))
    cut = F.length("text") > n
    return text.select("group_id", F.when(cut, F.concat(F.substring("text", 1, n), F.lit(GROUP_TEXT_MARK))).otherwise(F.col("text")).alias("text"), cut.alias("truncated"))


def case_terms(df: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """Distinct terms per key; the vocabulary bounds each set."""
    return df.select(*keys, F.explode(terms).alias("term")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def ordered_distinct(df: DataFrame, key: str, value: str, ord: Column, invalid: list[str] = ()) -> DataFrame:
    """First position of each distinct value: key, value, ord (one small row per value)."""
    v = blank_to_null(F.col(value))
    d = df.select(key, v.alias(value), ord.alias("ord")).filter(F.col(value).isNotNull())
    if invalid:
        d = d.filter(~F.col(value).isin(*invalid))
    return d.groupBy(key, value).agg(F.min("ord").alias("ord"))


LIST_WORDS = {
    "entrustment_letter": "司法鉴定委托书原件壹份",
    "id_card": "居民身份证复印件壹份",
    "traffic_accident_cert": "道路交通事故认定书复印件壹份",
    "suit": "民事起诉状",
}


def material_list(cases: DataFrame, pages: DataFrame, records: DataFrame, reports: DataFrame) -> DataFrame:
    """Numbered list items per case: case_id, no, item.

    cases: case_id, person_name. Items keep their form: letter, identity, certificate,
    application and suit, other suit papers, one line per organisation of the records, one
    line per organisation of the examinations with film sums.
    """
    from caseweave.functions.text import to_numeral
    from caseweave.operators.split import split_row_number

    has = lambda t: F.coalesce(F.max(F.col("type") == t), F.lit(False)).alias(t)
    suit_text = F.concat_ws(" ", "description", "file_name", "text")
    flags = pages.groupBy("case_id").agg(
        *[has(t) for t in ("entrustment_letter", "id_card", "traffic_accident_cert", "appraisal_application", "litigation_material", "medical_record", "imaging_report")],
        F.coalesce(F.max((F.col("type") == "litigation_material") & F.contains(suit_text, F.lit(LIST_WORDS["suit"]))), F.lit(False)).alias("suit"),
    )
    org = F.coalesce(F.nullif("org", F.lit("")), F.lit("某医院"))
    kind = F.coalesce(F.nullif("exam_type", F.lit("")), F.lit("影像学检查"))
    film = F.when(F.coalesce("film_count", F.lit(0)) == 0, 1).otherwise(F.col("film_count"))
    stays = records.groupBy("case_id", org.alias("org")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("ord"))
    per_kind = reports.groupBy("case_id", org.alias("org"), kind.alias("kind")).agg(F.sum(film).alias("n"), F.min("report_id").alias("ord"))
    shown = F.concat("kind", to_numeral(F.col("n")), F.lit("张"))
    exams = per_kind.groupBy("case_id", "org").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("s")))), lambda x: x["s"]), "、").alias("s"), F.min("ord").alias("ord")
    )
    n_orgs = exams.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_orgs"))
    stay_cases = stays.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_stays"))
    f = cases.join(flags, "case_id").join(n_orgs, "case_id", "left").join(stay_cases, "case_id", "left")
    app, suit = F.col("appraisal_application"), F.col("suit")
    line = lambda rank, cond, text: F.when(cond, F.struct(F.lit(rank).alias("rank"), F.lit(0).cast("bigint").alias("ord"), text.alias("item")))
    fixed_lines = [
        line(1, F.col("entrustment_letter"), F.lit(LIST_WORDS["entrustment_letter"])),
        line(2, F.col("id_card"), F.concat(F.coalesce("person_name", F.lit("")), F.lit(LIST_WORDS["id_card"]))),
        line(3, F.col("traffic_accident_cert"), F.lit(LIST_WORDS["traffic_accident_cert"])),
        line(4, app & suit, F.lit("民事起诉状、鉴定申请书复印件各壹份")),
        line(4, app & ~suit, F.lit("鉴定申请书复印件壹份")),
        line(4, ~app & suit, F.lit("民事起诉状复印件壹份")),
        line(5, F.col("litigation_material") & ~suit, F.lit("诉讼材料复印件壹份")),
        line(6, F.col("n_stays").isNull() & F.col("medical_record"), F.lit("住院病历复印件壹份")),
        line(7, F.col("n_orgs").isNull() & F.col("imaging_report"), F.lit("影像学资料（待提取详情）")),
    ]
    items = f.select("case_id", F.inline(F.array_compact(F.array(*fixed_lines))))
    seen = f.select("case_id", "n_orgs")
    stay_items = stays.join(seen, "case_id").select("case_id", F.lit(6).alias("rank"), "ord", F.concat("org", F.lit("住院病历复印件"), to_numeral(F.col("n")), F.lit("份")).alias("item"))
    alone = (F.col("n_orgs") == 1) & (F.col("org") == "某医院")
    exam_items = exams.join(seen, "case_id").select("case_id", F.lit(7).alias("rank"), "ord", F.concat(F.when(alone, "影像学资料").otherwise(F.col("org")), "s").alias("item"))
    rows = items.unionByName(stay_items).unionByName(exam_items)
    d = split_row_number(rows, ["case_id"], [F.col("rank"), F.col("ord"), F.col("item")], F.struct("rank", F.floor(F.col("ord") / 100_000).alias("o")), "no")
    return d.select("case_id", "no", F.concat(F.col("no").cast("string"), F.lit(". "), "item").alias("item"))


def diagnosis_list(records: DataFrame, evidence: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` distinct diagnoses of a case, else the first evidence summaries.

    records: case_id, record_id, diagnosis_out, diagnosis_in; evidence: case_id, ord, summary.
    """
    from caseweave.functions.text import strip
    from caseweave.operators.split import first_rows

    parts = F.filter(
        F.transform(F.split(F.concat_ws("\n", "diagnosis_out", "diagnosis_in"), "[；;。\n]+"), lambda x: F.btrim(strip(x), F.lit(" ，,、"))), lambda x: x != ""
    )
    d = records.select("case_id", "record_id", F.posexplode(parts).alias("pos", "piece"))
    d = d.groupBy("case_id", "piece").agg(F.min(F.struct("record_id", "pos")).alias("at"))
    e = evidence.select("case_id", blank_to_null(F.col("summary")).alias("piece"), "ord").filter(F.col("piece").isNotNull())
    e = e.groupBy("case_id", "piece").agg(F.min(F.struct(F.col("ord").alias("record_id"), F.lit(0).alias("pos"))).alias("at"))
    e = e.join(d.select("case_id").distinct(), "case_id", "left_anti")
    top = first_rows(d.unionByName(e), ["case_id"], [F.col("at")], n)
    joined = F.array_sort(F.collect_list(F.struct("rn", "piece")))
    return top.groupBy("case_id").agg(F.array_join(F.transform(joined, lambda s: s["piece"]), "、").alias("diagnoses"))


def merge_records(df: DataFrame, keys: list[str], ord: Column, cols: list[str]) -> DataFrame:
    """Rows of one business key folded: the latest non-empty value of each column."""
    real = lambda c: F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "null"), ord)
    return df.groupBy(*keys).agg(*[F.max_by(c, real(c)).alias(c) for c in cols], F.count(F.lit(1)).alias("n_merged"))


def term_weights(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """term, df, weight: max(1 / (df + 1), 0.3); 0.5 where no body holds the term."""
    low = F.lower(F.coalesce("text", F.lit("")))
    counts = chunks.agg(*[_count_if(F.contains(low, F.lit(w.lower()))).alias(f"c{i}") for i, w in enumerate(terms)])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(w.lower()).alias("term"), F.col(f"c{i}").alias("df")) for i, w in enumerate(terms)])))
    return rows.withColumn("weight", F.when(F.col("df") == 0, 0.5).otherwise(F.greatest(1 / (F.col("df") + 1), F.lit(0.3))))


def case_warnings(cases: DataFrame, facts: DataFrame, events: DataFrame, reports: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings per case from existence tests. candidates: case_id, decision, evidence array."""
    f = facts.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_f"), _count_if(F.col("fact_type") == "medical_event").alias("_fe"), _count_if(F.col("fact_type") == "imaging_report").alias("_fi")
    )
    e = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("_e"))
    r = reports.groupBy("case_id").agg(F.count(F.lit(1)).alias("_r"))
    c = candidates.groupBy("case_id").agg(
        _count_if(F.col("decision") == "met").alias("_met"),
        F.sum(F.size(F.filter("evidence", lambda x: F.coalesce(x["review_status"] == "pending", F.lit(False))))).alias("_open"),
    )
    d = cases
    for part in (f, e, r, c):
        d = d.join(part, "case_id", "left")
    d = d.fillna(0, ["_f", "_fe", "_fi", "_e", "_r", "_met", "_open"])
    facts_used = F.col("_f") > 0
    warn = F.array_compact(
        F.array(
            F.when(F.coalesce("request", F.lit("")) == "", "委托事项为空，分析说明无法判断哪些损伤应进入正式结论。"),
            F.when(facts_used & (F.col("_fe") == 0), "统一事实库中缺少病历事件型事实，建议先建立或确认病历事实。"),
            F.when(facts_used & (F.col("_fi") == 0), "统一事实库中缺少检查事实，影像依据不足。"),
            F.when(~facts_used & (F.col("_e") == 0), "尚无病历事件型事实，分析说明只能依赖病历汇总字段，来源页精度会降低。"),
            F.when(~facts_used & (F.col("_r") == 0), "尚无检查事实，影像依据不足。"),
            F.when(F.col("_met") == 0, "未形成 decision=met 的伤残候选，正式伤残结论需人工核对。"),
            F.when(F.col("_open") > 0, F.concat(F.lit("有 "), F.col("_open").cast("string"), F.lit(" 条候选来源事实尚未人工确认。"))),
        )
    )
    return d.withColumn("warnings", warn).drop("_f", "_fe", "_fi", "_e", "_r", "_met", "_open")


def docs_with_text(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("status") == "completed") & F.col("text").isNotNull()).select("doc_id").distinct()


def usage_totals(attempts: DataFrame, keys: list[str] = ["task"]) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), s("prompt_tokens"), s("completion_tokens"), s("total_tokens"))


def case_query(parts: DataFrame, n: int = 6000) -> DataFrame:
    """Search text per case: non-empty fields in order, joined by line and cut at ``n``.

    parts: case_id, rank (table), ord (row), pos (field), value. Only the rows that reach
    into the first ``n`` characters are collected.
    """
    from caseweave.operators.split import char_budget

    d = parts.filter(F.coalesce("value", F.lit("")) != "").withColumn("_v", F.substring("value", 1, n))
    order = [F.col("rank"), F.col("ord"), F.col("pos")]
    d = char_budget(d, ["case_id"], order, F.col("_v"), n, mode="cut_after")
    lines = F.array_sort(F.collect_list(F.struct("_rn", "_v")))
    return d.groupBy("case_id").agg(F.substring(F.btrim(F.array_join(F.transform(lines, lambda s: s["_v"]), "\n"), F.lit(" \n\t")), 1, n).alias("query"))


def toc(chunks: DataFrame, docs: DataFrame, preview: int = 200, size: int = 1000) -> DataFrame:
    """Sections per document in parts: doc_id, part, sections(code, title, preview)."""
    from caseweave.functions.text import collapse
    from caseweave.operators.split import in_parts

    item = F.struct(
        F.coalesce("code", F.lit("")).alias("code"), F.coalesce("title", F.lit("")).alias("title"), collapse(F.substring("text", 1, preview)).alias("preview")
    )
    d = chunks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return in_parts(d, ["doc_id"], [F.col("chunk_id")], F.floor(F.col("chunk_id") / 10_000), item, size, "sections")


def review_targets(pages: DataFrame, retry_failed: bool = True, retry_review: bool = False) -> DataFrame:
    """Adds ``target``: null, empty, pending and processing always, others by option."""
    wanted = ["pending", "processing"] + (["failed"] if retry_failed else []) + (["needs_review"] if retry_review else [])
    state = F.coalesce(F.nullif("review_status", F.lit("")), F.lit("pending"))
    base = pages.filter((F.col("status") == "completed") & F.col("text").isNotNull())
    return base.withColumn("target", state.isin(*wanted))


def review_run(targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counters per document. decisions: page_id, status (the outcome of each target)."""
    d = targets.join(decisions.select("page_id", F.col("status").alias("_out")), "page_id", "left")
    hit = lambda s: _count_if(F.col("target") & (F.col("_out") == s))
    return d.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), _count_if(F.col("target")).alias("target_pages"),
        hit("completed").alias("completed"), hit("needs_review").alias("needs_review"),
        _count_if(F.col("target") & ~F.coalesce(F.col("_out").isin("completed", "needs_review"), F.lit(False))).alias("failed"),
        _count_if(~F.col("target")).alias("skipped"),
    )


def recognition_status(cases: DataFrame, pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Case status, page counters and task counters in one row per case."""
    counts = status_counts(pages, ["case_id"], ["pending", "processing", "completed", "failed"])
    d = cases.join(counts, "case_id", "left").fillna(0, ["total", "pending", "processing", "completed", "failed"])
    return d.join(tasks, "case_id", "left")
