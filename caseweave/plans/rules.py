"""Rule candidates from evidence: corpus, decisions, warnings, references, text checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions.extract import has_item_combo, max_item_count, max_range_count
from caseweave.functions.predicates import contains_any, has_positive_hit, has_procedure, has_sign
from caseweave.functions.text import clip_hard, join_nonempty, squeeze
from caseweave.operators.joins import default_status, match_evidence
from caseweave.operators.split import first_rows
from caseweave.operators.windows import dedupe_first, top_evidence, trusted_or_all
from caseweave.plans.corpus import evidence_score

EVIDENCE_COLS = ["case_id", "kind", "id", "date", "org", "title", "summary", "quote", "text", "source_pages", "review_status"]


def _or(*cols) -> Column:
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols], F.lit(""))


def fact_corpus(facts: DataFrame) -> DataFrame:
    d = facts.withColumn("text", join_nonempty("\n", *[F.col(c) for c in ("org", "fact_date", "fact_type", "fact_role", "title", "summary", "quote")]))
    return d.select(
        "case_id", _or("source_kind", "fact_type").alias("kind"), F.coalesce("source_id", "fact_id").alias("id"), F.coalesce("fact_date", F.lit("")).alias("date"), F.coalesce("org", F.lit("")).alias("org"),
        _or("title", "fact_role", "fact_type").alias("title"), clip_hard(_or("summary", "quote", "text"), 260).alias("summary"), clip_hard(_or("quote", "summary", "text"), 180).alias("quote"),
        "text", "source_pages", "review_status",
    )


def raw_corpus(records: DataFrame, events: DataFrame, reports: DataFrame) -> DataFrame:
    none = F.array().cast("array<int>")
    own = lambda *cs: join_nonempty("\n", *[F.col(c) for c in cs])
    r = records.withColumn("text", own("org", "complaint", "history", "exam", "diagnosis_in", "treatment", "diagnosis_out", "orders")).select(
        "case_id", F.lit("hospital_record").alias("kind"), F.col("record_id").alias("id"), _or("date_in", "date_out").alias("date"), F.coalesce("org", F.lit("")).alias("org"),
        F.concat(F.coalesce("org", F.lit("")), F.lit("住院病历")).alias("title"), clip_hard(F.col("text"), 260).alias("summary"), clip_hard(_or("treatment", "diagnosis_out", "text"), 180).alias("quote"),
        "text", none.alias("source_pages"), "review_status",
    )
    e = events.withColumn("text", own("org", "type", "date", "title", "summary", "diagnosis", "findings", "treatment", "quote")).select(
        "case_id", F.lit("medical_event").alias("kind"), F.col("event_id").alias("id"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("org", F.lit("")).alias("org"),
        _or("title", "type", F.lit("病历事实")).alias("title"), clip_hard(_or("summary", "treatment", "findings", "text"), 260).alias("summary"), clip_hard(_or("quote", "summary", "text"), 180).alias("quote"),
        "text", F.coalesce("source_pages", none).alias("source_pages"), "review_status",
    )
    x = reports.withColumn("text", own("org", "date", "exam_type", "exam_part", "film_no", "content")).select(
        "case_id", F.lit("imaging_report").alias("kind"), F.col("report_id").alias("id"), _or("datetime", "date").alias("date"), F.coalesce("org", F.lit("")).alias("org"),
        F.trim(F.concat_ws(" ", _or("exam_type", F.lit("检查")), F.coalesce("exam_part", F.lit("")))).alias("title"), clip_hard(_or("content", "text"), 260).alias("summary"), clip_hard(_or("content", "text"), 180).alias("quote"),
        "text", F.coalesce("source_pages", none).alias("source_pages"), "review_status",
    )
    return r.unionByName(e).unionByName(x)


def build_corpus(facts: DataFrame, records: DataFrame, events: DataFrame, reports: DataFrame) -> DataFrame:
    """Evidence rows from the trusted facts of a case, else from its raw tables."""
    managed = list(fixed.FACT_TYPE_RANK)
    used = trusted_or_all(facts, ["case_id"], managed, null_is_excluded=True)
    with_facts = used.select("case_id").distinct()
    rest = lambda d: d.join(with_facts, "case_id", "left_anti")
    return fact_corpus(used).unionByName(rest(raw_corpus(records, events, reports)))


# --- candidates --------------------------------------------------------------

_TEXTS = ("grade", "suggestion", "reason")
SPEC = (
    "struct<title:string,category:string,kind:string,include:array<string>,met_any:array<string>,threshold:int,conf_met:int,conf_uncertain:int,suffix:string,"
    + ",".join(f"{c}_{o}:string" for c in _TEXTS for o in ("met", "uncertain"))
    + ",clause_keys:array<string>,special_keys:array<string>,must_mention:array<string>>"
)


def _spec_row(s: dict) -> Column:
    """The values of one spec; a text that is not given for an outcome falls back to the general one."""
    kind = s.get("kind", "default")
    least = {"count": 6, "items": 7}.get(kind, 0)
    met = int(s.get("conf_met", s.get("conf_uncertain", 60) if kind == "uncertain" else 80))
    plain = dict(fixed.CANDIDATE_DEFAULTS, **({"grade": fixed.PERIOD_GRADE} if kind == "default" else {}))
    said = {f"{c}_{o}": s.get(f"{c}_{o}") or s.get(c) or s.get(f"{c}_uncertain") or plain[c] for c in _TEXTS for o in ("met", "uncertain")}
    must = s.get("must_mention") or (fixed.PERIOD_TERMS if s.get("category") == fixed.PERIOD_CATEGORY else [])
    keys = s.get("clause_keys") or []
    values = [
        s.get("title"), s.get("category") or "", kind, s["include"], s.get("met_any") or [], int(s.get("threshold", least)), met, int(s.get("conf_uncertain", 60)), s.get("suffix", "_open"),
        *said.values(), keys, s.get("special_keys") or keys, must,
    ]
    return F.struct(*[F.array(*map(F.lit, x)) if isinstance(x, list) and x else F.array().cast("array<string>") if isinstance(x, list) else F.lit(x) for x in values]).cast(SPEC)


def spec_of(specs: list[dict], ident: Column) -> Column:
    """A spec's values by its id: one literal map, so expressions do not grow with the specs."""
    return F.element_at(F.create_map(*[c for s in specs for c in (F.lit(s["spec_id"]), _spec_row(s))]), ident)


def decide(corpus: DataFrame, specs: list[dict], k: int = 10, requests: DataFrame | None = None) -> DataFrame:
    """One candidate per (case, spec) with evidence: candidate_key, title, category, decision,
    confidence, grade, suggestion, reason, clause_keys, must_mention, evidence and warnings.

    Only the ``k`` best evidence rows of a spec are kept, map-side, before anything is
    collected. The kind of a spec says how the joined texts decide: ``count``, ``items``,
    ``any_term``, ``two_conditions``, ``uncertain``, ``variant``, ``repair``, ``deformity`` or
    default (met). A ``repair`` spec keeps only the evidence that passes its procedure test, a
    ``deformity`` spec the evidence with a hit that is not negated. "{n}" in a suggestion is the
    number found. A spec with ``asked`` needs one of those words in the case's request
    (``requests``: case_id, request). Evidence of one kind and id is named once.
    """
    sid, t = F.col("spec_id"), F.col("text")
    by_text = evidence_score(t, F.col("kind"), F.col("source_pages"), F.col("review_status"), [], fixed.EVIDENCE_BONUS, max_range_count(t))
    # What depends on the text alone is counted once a text, before the rows of its specs.
    d = match_evidence(corpus.withColumn("_points", F.when(contains_any(t, sorted({w for s in specs for w in s["include"]})), by_text)), specs)
    include = spec_of(specs, sid)["include"]
    score = F.col("_points") + F.aggregate(include, F.lit(0), lambda n, w: n + F.when(F.contains(t, w), F.length(w)).otherwise(0))
    asked = [s for s in specs if s.get("asked")]
    if asked:
        if requests is None:
            raise ValueError("specs with asked words need the requests")
        d = d.join(requests.select("case_id", F.coalesce("request", F.lit("")).alias("_request")), "case_id", "left")
        for s in asked:
            d = d.filter((sid != s["spec_id"]) | contains_any(F.col("_request"), s["asked"]))
    d = top_evidence(d.withColumns({"score": score, "ord": F.struct("kind", "id")}).drop("_points"), ["case_id", "spec_id"], k)
    for s in specs:
        own = F.when(sid == s["spec_id"], t)
        if s.get("kind") == "repair":
            d = d.filter((sid != s["spec_id"]) | has_procedure(own, **s["procedure"]))
        if s.get("kind") == "deformity":
            d = d.filter((sid != s["spec_id"]) | has_positive_hit(own, **s["positive"]))
    # Rows and texts are collected in one list; ``rn`` orders it, as no two rows of a spec share one.
    ev = ["rn", *[c for c in EVIDENCE_COLS if c not in ("case_id", "text")]]
    g = d.groupBy("case_id", "spec_id").agg(F.array_sort(F.collect_list(F.struct(*ev, "text"))).alias("_l"))
    g = g.select("case_id", "spec_id", F.transform("_l", lambda x: F.struct(*[x[c].alias(c) for c in ev])).alias("evidence"), F.array_join("_l.text", " ").alias("text"))
    counted = (F.col("_s.kind") == "count") | F.contains("_s.suggestion_met", F.lit("{n}")) | F.contains("_s.suggestion_uncertain", F.lit("{n}"))
    g = g.withColumn("_s", spec_of(specs, sid)).withColumns({"_n": F.when(counted, max_range_count(t)), "_hit": contains_any(t, F.col("_s.met_any"))})
    kind, hit, s = F.col("_s.kind"), F.col("_hit"), F.col("_s")
    signs = F.lit(False)
    for x in [x for x in specs if x.get("kind") == "two_conditions"]:
        signs = F.when(sid == x["spec_id"], has_sign(t, x["signs"], x.get("no_signs", []))).otherwise(signs)
    met = (
        F.when(kind == "count", F.col("_n") >= s["threshold"])
        .when(kind == "items", (max_item_count(t) >= s["threshold"]) | has_item_combo(t))
        .when(kind.isin("any_term", "deformity"), hit).when(kind == "two_conditions", hit & signs)
        .when(kind == "uncertain", False).otherwise(True)
    )
    g = g.withColumn("_met", F.coalesce(met, F.lit(False)))
    sure = F.when(kind.isin("uncertain", "variant"), hit).otherwise(F.col("_met"))
    said = {c: F.when(F.col("_met"), s[f"{c}_met"]).otherwise(s[f"{c}_uncertain"]) for c in _TEXTS}
    said["suggestion"] = F.replace(said["suggestion"], F.lit("{n}"), F.when(F.col("_n") > 0, F.col("_n").cast("string")).otherwise(fixed.COUNT_UNKNOWN))
    special = (kind == "variant") & hit
    first = F.filter("evidence", lambda e, i: ~F.exists(F.slice("evidence", 1, i), lambda o: o["kind"].eqNullSafe(e["kind"]) & o["id"].eqNullSafe(e["id"])))
    g = g.withColumns(
        {
            "candidate_key": F.concat("spec_id", F.when(special, s["suffix"]).otherwise("")), "title": s["title"], "category": s["category"],
            "decision": F.when(F.col("_met"), "met").otherwise("uncertain"), "confidence": F.when(sure, s["conf_met"]).otherwise(s["conf_uncertain"]),
            **said, "clause_keys": F.when(special, s["special_keys"]).otherwise(s["clause_keys"]), "must_mention": s["must_mention"], "evidence": first,
        }
    )
    return g.withColumn("warnings", candidate_warnings(F.col("decision"), F.col("evidence"))).drop("_s", "_n", "_hit", "_met", "text")


def candidate_warnings(decision: Column, evidence: Column) -> Column:
    ok = ["confirmed", "system_verified", ""]
    open_ = F.exists(evidence, lambda e: ~F.coalesce(e["review_status"], F.lit("")).isin(*ok))
    paged = F.exists(evidence, lambda e: F.coalesce(F.size(e["source_pages"]), F.lit(0)) > 0)
    return F.array_compact(F.array(F.when(decision == "uncertain", fixed.WARN_UNCERTAIN), F.when(open_, fixed.WARN_UNREVIEWED), F.when(~F.coalesce(paged, F.lit(False)), fixed.WARN_NO_PAGES)))


def accepted(decision: Column, status: Column, confidence: Column) -> Column:
    return (decision == "met") & (F.coalesce(F.nullif(status, F.lit("")), default_status(decision, confidence)) == "accepted")


def collect_refs(cands: DataFrame, refs: str = "standards") -> DataFrame:
    """References of met and accepted candidates, the first per clause key, id or label.

    cands: case_id, ord, decision, status, confidence, standards (clause_key, ref_id, label)."""
    d = cands.filter(accepted(F.col("decision"), F.col("status"), F.col("confidence"))).select("case_id", "ord", F.posexplode(refs).alias("pos", "ref"))
    d = d.withColumn("ident", F.coalesce("ref.clause_key", F.col("ref.ref_id").cast("string"), "ref.label"))
    return dedupe_first(d, ["case_id", "ident"], [F.col("ord"), F.col("pos")]).select("case_id", "ident", "ord", "pos", "ref")


def validate_text(texts: DataFrame, cands: DataFrame, persons: DataFrame | None = None, genders: tuple[str, str] = ("男", "女"), conflicts=fixed.CODE_CONFLICTS) -> DataFrame:
    """Warnings per case (long form). texts: case_id, text; cands: case_id, candidate_key, title,
    decision, status, confidence, must_mention. ``conflicts``: (candidate, code, word, warning)
    for a text that cites the code beside the word although the candidate is accepted."""
    good = cands.filter(accepted(F.col("decision"), F.col("status"), F.col("confidence")))
    d = good.filter(F.size("must_mention") > 0).select("case_id", "title", "must_mention").join(texts, "case_id")
    clash = F.array_compact(F.array(*[
        F.when((F.col("candidate_key") == key) & F.contains("text", F.lit(code)) & F.contains("text", F.lit(word)), F.lit(said)) for key, code, word, said in conflicts
    ]))
    clash = good.select("case_id", "candidate_key").join(texts, "case_id").select("case_id", F.explode(clash).alias("warning")).distinct()
    miss = d.filter(~contains_any(F.col("text"), F.col("must_mention"))).select("case_id", F.concat(F.lit("分析说明可能遗漏已满足候选："), "title", F.lit("。")).alias("warning")).unionByName(clash)
    if persons is None:
        return miss
    p = texts.join(persons.filter((F.col("name") != "") & F.col("gender").isin(*genders)), "case_id")
    wrong = F.when(F.col("gender") == genders[0], genders[1]).otherwise(genders[0])
    compact = squeeze(F.col("text"))
    bad = F.regexp_like(compact, F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E[，,、:：]*(?:现年[0-9]+岁)?"), wrong))
    return miss.unionByName(p.filter(bad).select("case_id", F.concat(F.lit("分析说明中可能出现被鉴定人性别错误，应以基本情况中的“"), "gender", F.lit("”为准。")).alias("warning")))


def repair_text(texts: DataFrame, cands: DataFrame, candidate: str, fixes: list[tuple[str, str]]) -> DataFrame:
    """Replace wrong citations where the given candidate is met and accepted."""
    ok = cands.filter((F.col("candidate_key") == candidate) & accepted(F.col("decision"), F.col("status"), F.col("confidence"))).select("case_id").distinct()
    d = texts.join(ok.withColumn("_ok", F.lit(True)), "case_id", "left")
    fixed_text = F.col("text")
    for pattern, to in fixes:
        fixed_text = F.regexp_replace(fixed_text, pattern, to)
    return d.withColumn("text", F.when(F.col("_ok"), fixed_text).otherwise(F.col("text"))).drop("_ok")


def analysis_payload(cases: DataFrame, counts: dict[str, DataFrame], cands: DataFrame, refs: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row per case: context, evidence counts, candidates, references, warnings.

    The number of candidates of a case is bounded by the number of specs.
    """
    d = cases.select("case_id", F.struct(*[c for c in cases.columns if c != "case_id"]).alias("context"))
    for name, rows in counts.items():
        d = d.join(rows.groupBy("case_id").agg(F.count(F.lit(1)).alias(f"_{name}")), "case_id", "left")
    d = d.withColumn("evidence_counts", F.struct(*[F.coalesce(F.col(f"_{n}"), F.lit(0)).alias(n) for n in counts])).drop(*[f"_{n}" for n in counts])
    c = cands.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("candidate_key", "decision", "confidence", "status"))).alias("candidates"))
    r = refs.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "ident"))).alias("references"))
    return d.join(c, "case_id", "left").join(r, "case_id", "left").join(warnings.select("case_id", "warnings"), "case_id", "left")
