"""Look-ups, source resolution, fuzzy names, nested assembly.

Sides are not broadcast by hand: Catalyst broadcasts by measured size and AQE splits
skewed partitions. Where one group would meet many rows of another table, the look-up
side is first cut to what the answer can use.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions.extract import core_similarity, fact_day, name_core, name_key, similarity_bounds
from caseweave.functions.predicates import contains_any
from caseweave.functions.text import blank_to_null, file_name
from caseweave.operators.keywords import grams, match_terms
from caseweave.operators.split import first_rows, in_parts
from caseweave.sources.pages import sequence_key


def join_dealt(d: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Left join on ``key``. Rows without a key match nothing; a hash of ``by`` deals them to all tasks instead of one."""
    dealt = d.withColumn("_deal", F.when(F.col(key).isNull(), F.xxhash64(*by)).otherwise(F.xxhash64(key)))
    return dealt.join(right.withColumn("_deal", F.xxhash64(key)), [key, "_deal"], "left").drop("_deal")


def canonical_name(df: DataFrame, groups: DataFrame) -> DataFrame:
    """The name of the group when it has one, else the own name, else empty."""
    g = groups.select("group_id", F.col("name").alias("_group_name"))
    return (
        df.join(g, "group_id", "left")
        .withColumn("org", F.coalesce(F.nullif("_group_name", F.lit("")), F.col("org"), F.lit("")))
        .drop("_group_name")
    )


def page_bucket(c: Column, width: int = 10_000) -> Column:
    return F.floor(c / width)


def group_sources(pages: DataFrame, size: int = 1000) -> DataFrame:
    """All pages of a group in order, in parts: group_id, part, page_ids, page_numbers."""
    last = F.coalesce(F.col("page_number"), F.lit(2**31 - 1))
    order = [last, F.col("page_id")]
    d = in_parts(
        pages.filter(F.col("group_id").isNotNull()), ["group_id"], order, page_bucket(last),
        F.struct("page_id", "page_number"), size,
    )
    return d.select("group_id", "part", F.col("items.page_id").alias("page_ids"), F.col("items.page_number").alias("page_numbers"))


def resolve_sources(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds source_scope, n_sources, source_ids and source_pages to facts.

    Explicit ids go first, then all pages of the group, whatever their number, then the single
    page. ``group_sources`` gives the list of a group once, in parts.
    """
    none = F.array().cast("array<bigint>")
    f = facts.withColumns(
        {
            "source_ids": F.coalesce(F.array_distinct("source_ids"), none),
            "source_pages": F.coalesce(F.array_distinct("source_pages"), F.array().cast("array<int>")),
        }
    )
    own = F.when(F.size("source_ids") > 0, F.col("source_ids")).when(
        F.col("group_id").isNull() & F.col("page_id").isNotNull(), F.array("page_id")
    )
    f = f.withColumn("_own", own)
    wanted = f.select("fact_id", F.posexplode("_own").alias("_pos", "page_id"))
    found = wanted.join(pages.select("page_id", "page_number"), "page_id")
    by_id = found.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "page_id", "page_number"))).alias("_hits"))
    sizes = pages.filter(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.struct(F.col("page_number").isNull().alias("null_last"), "page_number", "page_id")
    lists = pages.filter(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.array_sort(F.collect_list(rank)).alias("_list"))
    groups = sizes.join(lists, "group_id")
    d = join_dealt(f.join(by_id, "fact_id", "left"), groups, "group_id", ["fact_id"])
    explicit = F.size(F.col("source_ids")) > 0
    by_group = ~explicit & F.col("group_id").isNotNull()
    ids = (
        F.when(explicit, F.col("source_ids"))
        .when(by_group & F.col("_n").isNull(), none)
        .when(by_group, F.col("_list.page_id"))
        .otherwise(F.coalesce(F.col("_hits.page_id"), none))
    )
    numbers = F.when(by_group & F.col("_n").isNotNull(), F.col("_list.page_number")).otherwise(
        F.coalesce(F.col("_hits.page_number"), F.array().cast("array<int>"))
    )
    return d.withColumns(
        {
            "source_scope": F.when(explicit, "ids").when(by_group, "group").when(F.col("page_id").isNotNull(), "page").otherwise("none"),
            "source_pages": F.when(F.size("source_pages") > 0, F.col("source_pages")).otherwise(F.array_compact(numbers)),
            "source_ids": ids,
            "n_sources": F.when(by_group, F.coalesce(F.col("_n"), F.lit(0))).otherwise(F.size(ids)),
        }
    ).drop("_own", "_hits", "_n", "_list")


def related_reports(events: DataFrame, reports: DataFrame, k: int = 3) -> DataFrame:
    """Adds ``related``: the best ``k`` reports of the case that share a term, as text.

    events: event_id, case_id, org, day, terms. reports: report_id, case_id, org, day,
    title, terms, pages. Same organisation unless one is blank; same day first, then day,
    then title. Events never meet all reports of a case: the best ``k`` reports are kept per
    (case, term, organisation or any, day or any), and those lists hold every possible answer.
    """
    any_ = F.lit("*")
    pick = F.struct(F.coalesce(F.nullif("day", F.lit("")), F.lit(fixed.NO_DAY)).alias("day"), "title", "report_id", "pages")
    r = reports.select("case_id", F.explode(F.array_distinct("terms")).alias("term"), F.coalesce("org", F.lit("")).alias("_org"), F.coalesce("day", F.lit("")).alias("_day"), pick.alias("pick"))
    r = r.withColumn("osel", F.explode(F.array(F.concat(F.lit("="), "_org"), any_)))
    r = r.withColumn("dsel", F.explode(F.when(F.col("_day") == "", F.array(any_)).otherwise(F.array(F.col("_day"), any_))))
    keys = ["case_id", "term", "osel", "dsel"]
    order = [F.col("pick.day"), F.col("pick.title"), F.col("pick.report_id")]
    best = first_rows(r, keys, order, k, "_rn").groupBy(*keys).agg(F.collect_list("pick").alias("picks"))
    own = F.coalesce("org", F.lit(""))
    osel = F.when(own == "", F.array(any_)).otherwise(F.array(F.concat(F.lit("="), own), F.lit("=")))
    dsel = F.when(F.coalesce("day", F.lit("")) == "", F.array(any_)).otherwise(F.array(F.col("day"), any_))
    e = events.select("event_id", "case_id", F.col("day").alias("_eday"), F.explode(F.array_distinct("terms")).alias("term"), osel.alias("osel"), dsel.alias("dsel"))
    e = e.withColumn("osel", F.explode("osel")).withColumn("dsel", F.explode("dsel"))
    hits = e.join(best, keys).groupBy("event_id").agg(F.first("_eday").alias("_eday"), F.array_distinct(F.flatten(F.collect_list("picks"))).alias("picks"))
    ranked = F.slice(
        F.array_sort(F.transform("picks", lambda p: F.struct((p["day"] != F.coalesce(F.col("_eday"), F.lit(""))).alias("other_day"), p["day"].alias("day"), p["title"].alias("title"), p["report_id"].alias("report_id"), p["pages"].alias("pages")))),
        1, k,
    )
    def shown(p: Column) -> Column:
        pages = F.when(F.size(p["pages"]) > 0, F.concat(F.lit("（来源页"), F.array_join(p["pages"].cast("array<string>"), ", "), F.lit("）"))).otherwise("")
        return F.concat(F.when(p["day"] == fixed.NO_DAY, "").otherwise(p["day"]), p["title"], pages)

    text = hits.select("event_id", F.array_join(F.transform(ranked, shown), "；").alias("related"))
    return events.join(text, "event_id", "left").fillna("", ["related"])


def core_grams(core: Column) -> Column:
    """Pairs of neighbouring characters of a name's core, and the core itself: similar names share one."""
    return F.array_append(grams(core, 2), core)


def canonicalize(
    df: DataFrame, aliases: DataFrame, confirmed: DataFrame, suffixes: list[str] = fixed.ORG_SUFFIXES, chars: str = r"一-龥",
    accept: float = 0.82, name: str = "name",
) -> DataFrame:
    """Adds canonical and matched: exact alias first, else the best confirmed name of the case.

    aliases: case_id, alias, canonical; confirmed: case_id, name, ord. Only distinct names
    that share two neighbouring characters with a confirmed name of their case are scored:
    a score that is accepted always comes with such a pair.
    """
    d = df.withColumn("_raw", F.coalesce(blank_to_null(F.col(name)), F.lit(fixed.UNKNOWN_ORG)))
    known = aliases.groupBy("case_id", F.col("alias").alias("_raw")).agg(F.min("canonical").alias("_alias"))
    names = d.select("case_id", "_raw").distinct().filter(F.col("_raw") != fixed.UNKNOWN_ORG)
    open_names = names.join(known, ["case_id", "_raw"], "left_anti").withColumn("_core", name_core(F.col("_raw"), suffixes, chars))
    good = confirmed.withColumn("_key", name_key(F.col("name"))).filter(F.col("_key") != "")
    good = good.groupBy("case_id", "_key").agg(F.min_by("name", "ord").alias("_good"), F.min("ord").alias("_ord"))
    good = good.withColumn("_gcore", name_core(F.col("_good"), suffixes, chars)).drop("_key")

    left = open_names.withColumn("_gram", F.explode(core_grams(F.col("_core"))))
    right = good.withColumn("_gram", F.explode(core_grams(F.col("_gcore"))))
    pairs = left.join(right, ["case_id", "_gram"]).select("case_id", "_raw", "_core", "_good", "_gcore", "_ord").distinct()
    pairs = pairs.withColumn("_bounds", similarity_bounds(F.col("_core"), F.col("_gcore"), suffixes)).filter(F.col("_bounds.high") >= accept)
    scored = pairs.withColumn("_score", core_similarity(F.col("_core"), F.col("_gcore"), suffixes, F.col("_bounds")))
    best = scored.groupBy("case_id", "_raw").agg(F.max_by(F.struct("_good", "_score"), F.struct("_score", -F.col("_ord"))).alias("_best"))
    suffixed = contains_any(F.col("_raw"), suffixes) | contains_any(F.col("_best._good"), suffixes)
    best = best.filter((F.col("_best._score") >= accept) & suffixed).select("case_id", "_raw", F.col("_best._good").alias("_fuzzy"))
    out = d.join(known, ["case_id", "_raw"], "left").join(best, ["case_id", "_raw"], "left")
    hit = F.when(F.col("_raw") != fixed.UNKNOWN_ORG, F.coalesce("_alias", "_fuzzy"))
    return out.withColumn("canonical", F.coalesce(hit, F.col("_raw"))).withColumn("matched", hit.isNotNull()).drop("_raw", "_alias", "_fuzzy")


def match_evidence(corpus: DataFrame, specs: list[dict], text: str = "text") -> DataFrame:
    """One row per (text, spec) that matches; the specs are literals, no join is made.

    A spec has spec_id, include (any must occur) and require_any (any, if given).
    """
    t = F.col(text)
    hits = [
        F.when(
            contains_any(t, s["include"]) & (contains_any(t, s["require_any"]) if s.get("require_any") else F.lit(True)),
            F.lit(s["spec_id"]),
        )
        for s in specs
    ]
    return corpus.withColumn("spec_id", F.explode(F.array_compact(F.array(*hits))))


def match_evidence_table(corpus: DataFrame, specs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same for a spec table of any size: (key, spec_id). specs: spec_id, include, require_any."""
    inc = specs.select("spec_id", F.explode("include").alias("term"))
    req = specs.select("spec_id", F.explode("require_any").alias("term"))
    hit = lambda ws: match_terms(corpus, key, text, ws).join(ws, "term").select(key, "spec_id").distinct()
    found = hit(inc)
    free = specs.filter(F.coalesce(F.size("require_any"), F.lit(0)) <= 0).select("spec_id")
    return found.join(free, "spec_id", "left_semi").unionByName(found.join(free, "spec_id", "left_anti").join(hit(req), [key, "spec_id"], "left_semi"))


def map_items_to_docs(items: DataFrame, mapping: list[tuple[str, list[str]]], docs: DataFrame) -> DataFrame:
    """(item, doc_id) through keyword -> title words; an unmapped item keeps a null document."""
    distinct = items.select("item").distinct()
    title_words = sorted({w for _, ws in mapping for w in ws if w})
    wanted = [F.when(F.contains("item", F.lit(k)), F.array(*[F.lit(w) for w in ws])) for k, ws in mapping if ws]
    asked = distinct.select("item", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*wanted))))).alias("_word"))
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("file_name", F.lit("")))
    has = F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(w)), F.lit(w)) for w in title_words]))
    offered = docs.select("doc_id", F.explode(has).alias("_word"))
    pairs = asked.join(offered, "_word").select("item", "doc_id").distinct()
    return distinct.join(pairs, "item", "left")


def resolve_clause(clauses: list[dict], chunks: DataFrame) -> DataFrame:
    """Best chunk per catalog clause: clause_key, label, chunk_id (null when none), score.

    One pass over the chunks: 12 per search term, 5 for the grade, best score, lowest id.
    """
    def score(c: dict) -> Column:
        text = F.coalesce("text", F.lit(""))
        points = [F.when(F.contains(text, F.lit(t)), 12).otherwise(0) for t in c["terms"] if t]
        if c.get("grade"):
            points.append(F.when(F.contains(text, F.lit(c["grade"])), 5).otherwise(0))
        return reduce(lambda a, b: a + b, points) if points else F.lit(0)

    hits = [
        F.when(F.contains("doc_title", F.lit(c["name"])), F.struct(F.lit(c["key"]).alias("clause_key"), score(c).alias("score")))
        for c in clauses if c.get("name") and c.get("terms")
    ]
    d = chunks.select("chunk_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).filter(F.col("h.score") > 0)
    best = d.groupBy(F.col("h.clause_key").alias("clause_key")).agg(F.max(F.struct(F.col("h.score"), -F.col("chunk_id"))).alias("b"))
    rows = chunks.sparkSession.createDataFrame([(c["key"], c.get("label", "")) for c in clauses], "clause_key string, label string")
    return rows.join(best, "clause_key", "left").select(
        "clause_key", "label", (-F.col("b.col2")).alias("chunk_id"), F.coalesce("b.score", F.lit(0)).alias("score")
    )


def review_pages(pages: DataFrame, docs: DataFrame, status: str = "needs_review", n: int = 200) -> DataFrame:
    p = pages if status == "all" else pages.filter(F.col("review_status") == status)
    return p.join(docs, "doc_id").orderBy("doc_id", "page_number").limit(n)


def case_detail(cases: DataFrame, children: dict[str, tuple[DataFrame, list[Column], Column]], size: int = 1000) -> DataFrame:
    """Nested rows per case. ``children``: name -> (rows, order, bucket).

    Part 0 holds the case with the first ``size`` children of each kind; a larger case goes
    on in parts 1, 2, ... so that no row and no task holds an unbounded list.
    """
    out = None
    for name, (rows, order, bucket) in children.items():
        item = F.struct(*[c for c in rows.columns if c != "case_id"])
        d = in_parts(rows, ["case_id"], order, bucket, item, size, name)
        out = d if out is None else out.join(d, ["case_id", "part"], "full")
    heads = cases.withColumn("part", F.lit(0).cast("bigint"))
    return heads.join(out, ["case_id", "part"], "left").unionByName(
        out.filter(F.col("part") > 0).join(cases.select("case_id"), "case_id", "left_semi"), allowMissingColumns=True
    )


def grouped_pages(pages: DataFrame, groups: DataFrame, size: int = 1000) -> DataFrame:
    """Files per case, type and group in parts; sort_order -1 is the bucket of orphans."""
    g = groups.select("group_id", F.col("case_id").alias("_case"), F.col("type").alias("_type"), F.col("name").alias("group_name"), "sort_order")
    d = pages.join(g, "group_id", "left")
    fits = F.coalesce((F.col("_case") == F.col("case_id")) & (F.col("_type") == F.col("type")), F.lit(False))
    d = d.withColumns(
        {
            "group_id": F.when(fits, F.col("group_id")),
            "group_name": F.when(fits, F.col("group_name")),
            "sort_order": F.when(fits, F.col("sort_order")).otherwise(-1),
        }
    )
    last = F.coalesce(F.col("page_number"), F.lit(2**31 - 1))
    return in_parts(d, ["case_id", "type", "sort_order", "group_id", "group_name"], [last, F.col("page_id")], page_bucket(last), F.col("page_id"), size, "files")


def not_imported(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages whose file name is not at the end of any imported path."""
    done = rows.select(file_name(F.col("path")).alias("file_name")).distinct()
    return pages.join(done, "file_name", "left_anti")


def event_lists(records: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of a record: those that name it, or its group.

    A group may hold many records and many events, so the pairs are not written out. The
    first table gives the one or two lists of each record (record_id, list_key); the second
    holds each event under its lists in event order, skipping the group entry of an event
    in the list of the record it names.
    """
    rec = lambda c: F.concat(F.lit("record:"), F.col(c).cast("string"))
    grp = lambda c: F.concat(F.lit("group:"), F.col(c).cast("string"))
    links = records.select("record_id", F.explode(F.array_compact(F.array(rec("record_id"), grp("group_id")))).alias("list_key"))
    home = records.select(F.col("record_id"), F.col("group_id").alias("_home"))
    e = join_dealt(events, home, "record_id", events.columns)
    inside = F.col("_home").eqNullSafe(F.col("group_id")) & F.col("group_id").isNotNull()
    keys = F.array_compact(F.array(F.when(F.col("record_id").isNotNull() & ~inside, rec("record_id")), grp("group_id")))
    return links, e.withColumn("list_key", F.explode(keys)).drop("_home")


def events_per_record(records: DataFrame, events: DataFrame) -> DataFrame:
    """Number of events and first event date of every record, from pre-aggregated lists."""
    links, lists = event_lists(records, events)
    per = lists.groupBy("list_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.nullif("date", F.lit(""))).alias("first_date"))
    d = links.join(per, "list_key", "left").groupBy("record_id")
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.min("first_date").alias("first_date"))


def first_attr(facts: DataFrame, records: DataFrame, attr: str = "number", key: str = "org") -> DataFrame:
    """First non-empty attribute of the records behind the facts of a key (fact order ``ord``)."""
    f = facts.filter((F.col("fact_type") == "hospital_record") & F.col("source_id").isNotNull())
    r = records.select(F.col("record_id").alias("source_id"), blank_to_null(F.col(attr)).alias("_a"))
    return f.join(r.filter(F.col("_a").isNotNull()), "source_id").groupBy("case_id", key).agg(F.min_by("_a", "ord").alias(attr))


def source_pages(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Source pages of each fact in sequence order, with their number; ids bound the lists."""
    wanted = facts.select("fact_id", F.explode(F.array_distinct("source_ids")).alias("page_id"))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sequence_key(F.col("_info"), F.col("page_number"), F.col("page_id")))])
    from caseweave.functions.extract import page_info

    p = pages.select("page_id", "page_number", page_info(F.col("file_name")).alias("_info"))
    found = wanted.join(p, "page_id").groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), "page_id"))).alias("_l"))
    return facts.join(found, "fact_id", "left").withColumn("page_ids", F.coalesce(F.col("_l.page_id"), F.array().cast("array<bigint>"))).withColumn("n_pages", F.size("page_ids")).drop("_l")


def default_status(decision: Column, confidence: Column) -> Column:
    return (
        F.when((decision == "met") & (F.coalesce(confidence, F.lit(0)) >= 80), "accepted")
        .when(decision == "uncertain", "needs_review").otherwise("pending")
    )


def overlay_saved(cands: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved status and note win over the default status."""
    s = saved.select("case_id", "candidate_key", F.col("status").alias("_status"), F.col("review_note").alias("review_note"), F.lit(True).alias("_saved"))
    d = cands.join(s, ["case_id", "candidate_key"], "left")
    fresh = default_status(F.col("decision"), F.col("confidence"))
    return d.withColumn("status", F.when(F.col("_saved"), F.col("_status")).otherwise(fresh)).drop("_status", "_saved")


def group_status(groups: DataFrame, pages: DataFrame, records: DataFrame, kind: str = "medical_record") -> DataFrame:
    """Pages, recognised pages and record per group; a row without group where a case has none."""
    g = groups.filter(F.col("type") == kind)
    done = F.col("status") == "completed"
    full = done & (F.coalesce("text", F.lit("")) != "")
    per = pages.filter(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(full).alias("n_completed"))
    rec = records.groupBy("case_id", "group_id").agg(F.min("record_id").alias("record_id"))
    rows = (
        g.select("case_id", "group_id", F.col("name").alias("group_name"), "sort_order")
        .join(per, "group_id", "left").join(rec, ["case_id", "group_id"], "left")
        .fillna(0, ["n_pages", "n_completed"])
    )
    loose = pages.filter(F.col("group_id").isNull() & (F.col("type") == kind)).join(g.select("case_id"), "case_id", "left_anti")
    loose = loose.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(done).alias("n_completed"))
    loose = loose.withColumn("group_name", F.lit("未分组的病历"))
    return rows.unionByName(loose, allowMissingColumns=True).withColumn("has_record", F.col("record_id").isNotNull())
