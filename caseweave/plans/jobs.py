"""Jobs made of the operators: page analysis with reuse and the guarded analysis text."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions.classify import PREDICTION, Rules, classify_page
from caseweave.functions.predicates import has_work_trace, request_flags
from caseweave.functions.text import clean_generated, drop_blocks
from caseweave.operators.joins import canonicalize
from caseweave.operators.merge import sync_candidates
from caseweave.operators.sequence import correct_sequence
from caseweave.plans.assembly import analysis_text
from caseweave.plans.rules import collect_refs, repair_text, validate_text
from caseweave.session import cut_lineage

def analyse_pages(
    pages: DataFrame, cache: DataFrame, version: str, aliases: DataFrame, confirmed: DataFrame, answers: DataFrame | None = None,
    rules: Rules | None = None, force: bool = False, sequence: bool = True, grouped=("medical_record", "imaging_report"),
) -> DataFrame:
    """Predictions of all pages: page_id, file, page_number, prediction, source, rule.

    pages: page_id, case_id, file, page_number, text. cache: page_id, version, has_text,
    prediction. answers: page_id, prediction (second opinions). A fresh cache row is reused
    unless ``force``; a page without text is kept as failed. source: cache, new or failed.
    """
    fresh = cache.filter((F.col("version") == version) & F.col("has_text")).select("page_id", F.col("prediction").cast(PREDICTION).alias("_cached"))
    if force:
        fresh = fresh.limit(0)
    todo = classify_page(pages.join(fresh, "page_id", "left_anti"), rules=rules).withColumn(
        "source", F.when(F.coalesce("text", F.lit("")) != "", "new").otherwise("failed")
    )
    if answers is not None:
        low = (F.coalesce(F.col("prediction.type"), F.lit("")) == "") | (F.col("prediction.confidence") < 0.80)
        a = answers.select("page_id", F.col("prediction").cast(PREDICTION).alias("_a"))
        use = low & F.col("_a.type").isNotNull() & (F.col("source") == "new")
        todo = todo.join(a, "page_id", "left").withColumn("prediction", F.when(use, F.col("_a")).otherwise(F.col("prediction").cast(PREDICTION))).drop("_a")
    else:
        todo = todo.withColumn("prediction", F.col("prediction").cast(PREDICTION))
    reused = pages.join(fresh, "page_id").withColumn("prediction", F.col("_cached")).withColumn("source", F.lit("cache")).drop("_cached")
    d = cut_lineage(todo.unionByName(reused).withColumn("name", F.col("prediction.group")))
    d = canonicalize(d, aliases, confirmed)
    named = F.col("prediction.type").isin(*grouped)
    swap = named & (F.col("matched") | (F.col("source") == "new"))
    d = d.withColumn("prediction", F.when(F.coalesce(swap, F.lit(False)), F.col("prediction").withField("group", F.col("canonical"))).otherwise(F.col("prediction")))
    d = d.select("page_id", "file", "page_number", "text", "prediction", "source")
    if not sequence:
        return d.drop("text").withColumn("rule", F.lit(0))
    d = cut_lineage(d)
    fixed_rows = correct_sequence(d).select("page_id", F.col("prediction").alias("_p"), "rule")
    return d.drop("text").join(fixed_rows, "page_id").withColumn("prediction", F.col("_p")).drop("_p")


def analysis_counters(analysed: DataFrame) -> DataFrame:
    hit = lambda c, n: F.coalesce(F.count_if(c), F.lit(0)).alias(n)
    s = F.col("source")
    return analysed.agg(hit(s == "new", "analysed"), hit(s == "cache", "reused"), hit(s == "failed", "failed"), hit(F.col("rule") > 0, "adjusted"))


def analyse(
    cases: DataFrame, cands: DataFrame, generated: DataFrame | None = None, fixes: list[tuple[str, str]] = (), fix_for: str = "",
    openers: list[str] = fixed.OPENERS, terms: list[str] = fixed.FOLLOWUP_TERMS, trace: dict | None = None, stored: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Guarded text per case. The supplied text is cleaned, repaired, rid of blocks that were
    not asked for and checked; where it fails, the conservative text takes its place.

    cases: case_id, person, request, accident, diagnoses; cands as for analysis_text, with
    candidate_key, confidence, must_mention and, if their references are wanted, standards.
    With ``stored`` (saved candidates) the candidates are synced first, so a saved status
    stands. Answers ``texts`` (text, method, dropped), ``warnings`` (distinct), ``candidates``
    and, with standards, ``references``.
    """
    if stored is not None:
        cands = cut_lineage(sync_candidates(stored, cands))
    c = cases.withColumn("flags", request_flags(F.coalesce("request", F.lit(""))))
    safe = analysis_text(c, cands).withColumnRenamed("text", "_safe")
    d = c.select("case_id", "flags").join(safe, "case_id")
    if generated is not None:
        g = generated.select("case_id", clean_generated(F.col("text"), openers).alias("text"))
        g = repair_text(g, cands, fix_for, list(fixes)) if fixes else g
        d = d.join(g, "case_id", "left")
    else:
        d = d.withColumn("text", F.lit(None).cast("string"))
    d = d.withColumn("_r", drop_blocks(F.coalesce("text", F.lit("")), terms, F.col("flags.followup_cost")))
    d = d.withColumn("_bad", has_work_trace(F.col("_r.text"), **(trace or {})))
    texts = d.select(
        "case_id", F.when(F.col("_bad"), F.col("_safe")).otherwise(F.col("_r.text")).alias("text"), F.when(F.col("_bad"), "fallback").otherwise("supplied").alias("method"),
        F.col("_r.dropped").alias("dropped"), (F.col("_bad") & (F.coalesce("text", F.lit("")) != "")).alias("_replaced"),
    )
    notes = texts.filter("dropped").select("case_id", F.lit("已移除未在委托事项中的后续治疗费/后期医疗费用段落。").alias("warning"))
    notes = notes.unionByName(texts.filter("_replaced").select("case_id", F.lit(fixed.FALLBACK_WARNING).alias("warning")))
    texts = texts.drop("_replaced")
    out = {"texts": texts, "candidates": cands, "warnings": validate_text(texts.select("case_id", "text"), cands).unionByName(notes).distinct()}
    if "standards" in cands.columns:
        out["references"] = collect_refs(cands)
    return out
