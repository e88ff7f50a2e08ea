"""Merges, guarded updates and state changes, each as one join that yields a new snapshot."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions.classify import Rules, classify_subtype
from caseweave.functions.extract import core_similarity, name_core, similarity_bounds
from caseweave.functions.text import blank_to_null, compact_text, let
from caseweave.operators.joins import canonicalize, core_grams
from caseweave.operators.split import first_rows, split_row_number

LEGACY_TYPES = ["case_basic", "case_facts", "clinical_exam"]
MANAGED_TYPES = list(fixed.FACT_TYPE_RANK)
REVIEW_COLS = ["review_status", "importance", "review_note"]


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def row_id(*cols: str) -> Column:
    """Deterministic id of a new row, 63 hash bits of its natural key, the same on every retry."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(2**63 - 1))


def merge_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshot after a sync of all cases: one full outer join on (case_id, fact_key).

    New rows with neither summary nor quote are not written, yet they keep their key alive.
    Managed rows without a new row go, legacy types always go. Review columns stay where a
    person has set them or left a note on a pending row.
    """
    data = [c for c in new.columns if c not in ("case_id", "fact_key")]
    for c in REVIEW_COLS:
        if c not in new.columns:
            data.append(c)
    o = old.select("case_id", "fact_key", F.struct(*[c for c in old.columns if c not in ("case_id", "fact_key")]).alias("o"))
    n = new if "review_note" in new.columns else new.withColumn("review_note", F.lit(None).cast("string"))
    n = n.select("case_id", "fact_key", F.struct(*[c for c in n.columns if c not in ("case_id", "fact_key")]).alias("n"))
    d = o.join(n, ["case_id", "fact_key"], "full")
    had, has = F.col("o").isNotNull(), F.col("n").isNotNull()
    legacy = F.coalesce(F.col("o.fact_type").isin(*LEGACY_TYPES), F.lit(False))
    managed = F.coalesce(F.col("o.fact_type").isin(*MANAGED_TYPES), F.lit(False))
    usable = has & (_filled(F.col("n.summary")) | _filled(F.col("n.quote")))
    # A legacy row is gone before the new row is looked at.
    base = had & ~legacy
    d = d.filter(usable | (base & (has | ~managed)))
    note = F.col("o.review_note")
    keep_review = base & (
        F.coalesce(F.col("o.review_status").isin(*fixed.MANUAL_REVIEW), F.lit(False))
        | ((F.col("o.review_status") == "pending") & _filled(note))
    )
    out = []
    for c in data:
        oldv = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        newv = F.col(f"n.{c}")
        if c == "review_note" and c not in new.columns:
            out.append(oldv.alias(c))
        elif c in REVIEW_COLS:
            out.append(F.when(usable & ~F.coalesce(keep_review, F.lit(False)), newv).otherwise(oldv).alias(c))
        else:
            out.append(F.when(usable, newv).otherwise(oldv).alias(c))
    ident = F.coalesce(F.when(base, F.col("o.fact_id")), row_id("case_id", "fact_key")).alias("fact_id")
    rest = [F.when(base, F.col(f"o.{c}")).alias(c) for c in old.columns if c not in data and c not in ("case_id", "fact_key", "fact_id")]
    return d.select("case_id", "fact_key", ident, *out, *rest)


def rebuild_events(old: DataFrame, proposals: DataFrame, ident: str = "identity") -> DataFrame:
    """All rows with an ``action``: deleted (automatic, not confirmed), preserved, created, duplicate."""
    auto = F.coalesce(F.array_contains("flags", fixed.AUTO_FLAG), F.lit(False))
    gone = auto & ~F.col("review_status").eqNullSafe("confirmed")
    kept = old.withColumn("action", F.when(gone, "deleted").otherwise("preserved"))
    known = kept.filter(F.col("action") == "preserved").select("group_id", ident).distinct().withColumn("_known", F.lit(True))
    p = proposals.join(known, ["group_id", ident], "left")
    p = p.withColumn("action", F.when(F.col("_known"), "duplicate").otherwise("created")).drop("_known")
    return kept.unionByName(p, allowMissingColumns=True)


def rebuild_counts(actions: DataFrame) -> DataFrame:
    hit = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.groupBy("group_id").agg(*[hit(a) for a in ("created", "deleted", "preserved", "duplicate")])


LOST_REASON = "当前统一事实库已不再支持该候选；如需恢复，请在事实库中重新确认相关事实后刷新候选。"
LOST_WARNING = "当前事实库已排除或未保留该候选所需证据。"


def sync_candidates(old: DataFrame, new: DataFrame, producer: str = "analysis") -> DataFrame:
    """Candidates after a refresh. A valid saved status stays; a lost candidate is excluded
    and stays excluded when its support returns."""
    from caseweave.operators.joins import default_status

    cols = ["title", "category", "decision", "confidence", "grade", "suggestion", "reason"]
    cols = [c for c in cols if c in new.columns]
    o = old.select("case_id", "candidate_key", F.struct(*[c for c in old.columns if c not in ("case_id", "candidate_key")]).alias("o"))
    n = new.select("case_id", "candidate_key", F.struct(*[c for c in new.columns if c not in ("case_id", "candidate_key")]).alias("n"))
    d = o.join(n, ["case_id", "candidate_key"], "full")
    has = F.col("n").isNotNull()
    lost = ~has & (F.col("o.source") == producer)
    valid = F.coalesce(F.col("o.status").isin(*fixed.CANDIDATE_STATUS), F.lit(False))
    fresh = default_status(F.col("n.decision"), F.col("n.confidence"))
    out = []
    for c in cols:
        v = F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}") if c in old.columns else F.lit(None))
        if c == "decision":
            v = F.when(lost, F.lit("not_met")).otherwise(v)
        elif c == "reason":
            v = F.when(lost, F.lit(LOST_REASON)).otherwise(v)
        out.append(v.alias(c))
    status = F.when(lost, "excluded").when(has & ~valid, fresh).otherwise(F.col("o.status"))
    extra = []
    for c in [c for c in new.columns if c not in (*cols, "case_id", "candidate_key", "warnings")]:
        extra.append(F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}") if c in old.columns else F.lit(None)).alias(c))
    if "warnings" in new.columns:
        w = F.when(has, F.col("n.warnings")).otherwise(F.col("o.warnings") if "warnings" in old.columns else F.lit(None))
        extra.append(F.when(lost, F.array(F.lit(LOST_WARNING))).otherwise(w).alias("warnings"))
    note = F.col("o.review_note").alias("review_note") if "review_note" in old.columns else F.lit(None).cast("string").alias("review_note")
    source = F.when(has, F.lit(producer)).otherwise(F.col("o.source")).alias("source")
    return d.select("case_id", "candidate_key", *out, *extra, status.alias("status"), note, source)


def guarded(old: Column, new: Column, confirmed: Column, name: str) -> Column:
    locked = F.coalesce(F.array_contains(confirmed, name), F.lit(False))
    return F.when(locked | ~_filled(new.cast("string")), old).otherwise(new)


def guarded_merge(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """New non-empty values go in unless the column is confirmed; ``applied`` names the changed ones."""
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols])
    d = old.join(n, key, "left")
    done = lambda c: _filled(F.col(f"_n_{c}").cast("string")) & ~F.coalesce(F.array_contains("confirmed_fields", c), F.lit(False))
    applied = F.array_compact(F.array(*[F.when(done(c), F.lit(c)) for c in cols]))
    d = d.withColumn("applied", applied)
    return d.withColumns({c: guarded(F.col(c), F.col(f"_n_{c}"), F.col("confirmed_fields"), c) for c in cols}).drop(*[f"_n_{c}" for c in cols])


EDITABLE = [
    "entrusting_unit", "request", "accident_date", "accident_location", "description", "acceptance_date", "appraisal_location",
    "on_site_personnel", "material_list", "person_name", "examination_date", "clinical_examination",
]


def apply_edits(rows: DataFrame, edits: DataFrame, key: str = "case_id", editable: list[str] = EDITABLE) -> DataFrame:
    """edits: key, changes (map of the fields that were sent; a field may be sent as null)."""
    d = rows.join(edits.select(key, "changes"), key, "left")
    names = F.coalesce(F.map_keys("changes"), F.array().cast("array<string>"))
    sent = lambda c: F.array_contains(names, c)
    value = lambda c: F.try_element_at("changes", F.lit(c))
    fields = F.array(*[F.lit(c) for c in editable])
    marked = F.filter(fields, lambda c: _filled(F.try_element_at(F.col("changes"), c)))
    edited = F.arrays_overlap(names, fields)
    acceptance = _filled(value("acceptance_date"))
    out = {c: F.when(sent(c), value(c)).otherwise(F.col(c)) for c in rows.columns if c not in (key, "status", "confirmed_fields", "appraisal_date")}
    if "appraisal_date" in rows.columns:
        out["appraisal_date"] = F.when(acceptance, value("acceptance_date")).when(sent("appraisal_date"), value("appraisal_date")).otherwise(F.col("appraisal_date"))
    none = F.array().cast("array<string>")
    out["confirmed_fields"] = F.when(F.col("changes").isNull(), F.col("confirmed_fields")).otherwise(F.array_union(F.coalesce("confirmed_fields", none), F.coalesce(marked, none)))
    back = edited & ~sent("status") & F.col("status").isin("pending_review", "pending_confirm")
    out["status"] = F.when(sent("status"), value("status")).when(back, "reviewing").otherwise(F.col("status"))
    return d.withColumns(out).drop("changes")


def real_value(c: Column) -> Column:
    return F.when(~c.cast("string").isin("", "null"), c)


def overlay_nonempty(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str], ints: list[str] = ()) -> DataFrame:
    """Null, empty and the text ``null`` never overwrite; a number that is none is ignored."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in [*cols, *ints]])
    d = old.join(n, keys, "full")
    out = {c: F.coalesce(real_value(F.col(f"_n_{c}")), F.col(c)) for c in cols}
    out |= {c: F.coalesce(F.col(f"_n_{c}").cast("string").try_cast("int"), F.col(c)) for c in ints}
    return d.withColumns(out).drop(*[f"_n_{c}" for c in [*cols, *ints]])


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest canonical name per (case, alias); blank or equal names are ignored. new has ``ord``."""
    a, c = blank_to_null(F.col("alias")), blank_to_null(F.col("canonical"))
    n = new.select("case_id", a.alias("alias"), c.alias("canonical"), "ord").filter(F.col("alias") != F.col("canonical"))
    rows = old.select("case_id", "alias", "canonical", F.lit(None).cast(dict(n.dtypes)["ord"]).alias("ord")).unionByName(n)
    return rows.groupBy("case_id", "alias").agg(F.max_by("canonical", F.struct(F.col("ord").isNotNull().alias("is_new"), "ord")).alias("canonical"))


def ensure_groups(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """Groups plus the wanted (case_id, type, name, ord, confirmed) that do not exist yet."""
    w = wanted.groupBy("case_id", "type", "name").agg(F.min("ord").alias("ord"), F.max("confirmed").alias("is_confirmed"))
    w = w.join(groups.select("case_id", "type", "name"), ["case_id", "type", "name"], "left_anti")
    base = groups.groupBy("case_id", "type").agg(F.count(F.lit(1)).alias("_base"))
    w = split_row_number(w, ["case_id", "type"], [F.col("ord"), F.col("name")], F.floor(F.col("ord") / 100_000), "_rn")
    w = w.join(base, ["case_id", "type"], "left")
    w = w.withColumn("sort_order", (F.col("_rn") + F.coalesce("_base", F.lit(0))).cast("int")).withColumn("group_id", row_id("case_id", "type", "name"))
    return groups.unionByName(w.select("group_id", "case_id", "type", "name", "sort_order", "is_confirmed"), allowMissingColumns=True)


def replace_pairs(c: Column, pairs: Column) -> Column:
    """pairs: array of struct(alias, canonical); aliases of three or more characters, longest first."""
    usable = F.filter(pairs, lambda p: (F.length(p["alias"]) >= 3) & (p["alias"] != p["canonical"]))
    ordered = F.array_sort(F.transform(usable, lambda p: F.struct((-F.length(p["alias"])).alias("n"), p["alias"].alias("a"), p["canonical"].alias("c"))))
    return F.coalesce(F.aggregate(ordered, c, lambda acc, p: F.replace(acc, p["a"], p["c"])), c)


def name_mapping(groups: DataFrame, requests: DataFrame, suffixes=fixed.ORG_SUFFIXES, chars: str = r"一-龥", accept: float = 0.82) -> DataFrame:
    """group_id, target_id, case_id, type, alias, canonical for the groups touched by the requests.

    requests: group_id, canonical. The target is the group that has the name already, else the
    group itself; unconfirmed groups of the case and type with a similar name join in.
    """
    g = groups.select("group_id", "case_id", "type", F.col("name").alias("alias"), "is_confirmed")
    r = requests.join(g.drop("is_confirmed"), "group_id")
    same = g.groupBy("case_id", "type", F.col("alias").alias("canonical")).agg(F.min("group_id").alias("_has"))
    r = r.join(same, ["case_id", "type", "canonical"], "left").withColumn("target_id", F.coalesce("_has", "group_id")).drop("_has")
    goal = r.select("case_id", "type", "canonical", "target_id", F.col("group_id").alias("_own"), name_core(F.col("canonical"), suffixes, chars).alias("_goal"))
    others = g.filter(~F.coalesce("is_confirmed", F.lit(False))).withColumn("_core", name_core(F.col("alias"), suffixes, chars))
    # Only names that share two neighbouring characters, or the whole core, can be similar.
    left = others.withColumn("_gram", F.explode(core_grams(F.col("_core"))))
    near = left.join(goal.withColumn("_gram", F.explode(core_grams(F.col("_goal")))), ["case_id", "type", "_gram"]).drop("_gram").distinct()
    near = near.filter((F.col("group_id") != F.col("target_id")) & (F.col("group_id") != F.col("_own")))
    near = near.withColumn("_b", similarity_bounds(F.col("_core"), F.col("_goal"), suffixes)).filter(F.col("_b.high") >= accept)
    near = near.withColumn("_s", core_similarity(F.col("_core"), F.col("_goal"), suffixes, F.col("_b"))).drop("_b").filter(F.col("_s") >= accept)
    best = near.groupBy("group_id").agg(F.max_by(F.struct("case_id", "type", "canonical", "target_id", "alias"), F.struct("_s", -F.col("target_id"))).alias("b"))
    cols = ["group_id", "target_id", "case_id", "type", "alias", "canonical"]
    return r.select(*cols).unionByName(best.join(r, "group_id", "left_anti").select("group_id", *[f"b.{c}" for c in cols[1:]]))


def confirm_group_name(tables: dict[str, DataFrame], requests: DataFrame, suffixes=fixed.ORG_SUFFIXES, chars: str = r"一-龥", accept: float = 0.82) -> dict[str, DataFrame]:
    """All tables after the names are confirmed: groups merged, aliases kept, names and texts
    rewritten, pages renumbered. tables: groups, aliases, pages, and any of records, events,
    reports, facts (org; facts also title, summary, quote), texts (case_id and text columns)."""
    from caseweave.operators.windows import renumber

    m = name_mapping(tables["groups"], requests, suffixes, chars, accept)
    targets = m.groupBy("target_id").agg(F.min_by("canonical", "group_id").alias("canonical"))
    out = dict(tables)
    g = tables["groups"].join(m.filter(F.col("group_id") != F.col("target_id")).select("group_id"), "group_id", "left_anti")
    g = g.join(targets.withColumnRenamed("target_id", "group_id"), "group_id", "left")
    hit = F.col("canonical").isNotNull()
    out["groups"] = g.withColumn("name", F.coalesce("canonical", "name")).withColumn("is_confirmed", hit | F.coalesce("is_confirmed", F.lit(False))).drop("canonical")
    out["aliases"] = upsert_aliases(tables["aliases"], m.select("case_id", "alias", "canonical", F.col("group_id").alias("ord")))
    stored = tables["aliases"].join(m.select("case_id", "canonical").distinct(), ["case_id", "canonical"], "left_semi").select("case_id", "alias", "canonical")
    pairs = m.select("case_id", "alias", "canonical").unionByName(stored).distinct()
    by_case = pairs.filter((F.length("alias") >= 3) & (F.col("alias") != F.col("canonical"))).groupBy("case_id").agg(F.collect_set(F.struct("alias", "canonical")).alias("_pairs"))
    move = m.select("group_id", "target_id", F.col("canonical").alias("_name"), F.col("case_id").alias("_case"))
    p = tables["pages"].join(move.drop("_case"), "group_id", "left").join(by_case, "case_id", "left")
    touched = F.col("target_id").isNotNull()
    p = p.withColumn("text", F.when(touched, replace_pairs(F.col("text"), F.col("_pairs"))).otherwise(F.col("text")))
    p = p.withColumn("group_id", F.coalesce("target_id", "group_id")).drop("target_id", "_name", "_pairs")
    last = F.coalesce(F.col("page_number"), F.lit(2**31 - 1))
    done = p.join(targets.select(F.col("target_id").alias("group_id")), "group_id", "left_semi")
    done = renumber(done, ["group_id"], [last, F.col("page_id")], F.floor(last / 10_000)).withColumn("page_number", F.col("page_number").cast("int"))
    out["pages"] = p.join(targets.select(F.col("target_id").alias("group_id")), "group_id", "left_anti").unionByName(done)
    goals = m.select("case_id", "canonical").distinct().withColumn("_goal", name_core(F.col("canonical"), suffixes, chars))
    for name in ("records", "events", "reports", "facts"):
        if name not in tables:
            continue
        d = tables[name]
        orgs = d.select("case_id", "org").distinct().filter(_filled(F.col("org")))
        exact = pairs.select("case_id", F.col("alias").alias("org"), "canonical").unionByName(goals.select("case_id", F.col("canonical").alias("org"), "canonical"))
        exact = exact.join(goals.select("case_id", "canonical"), ["case_id", "canonical"], "left_semi").distinct()
        exact = orgs.join(exact, ["case_id", "org"]).select("case_id", "org", "canonical", F.lit(2.0).alias("_s"))
        left = orgs.withColumn("_core", name_core(F.col("org"), suffixes, chars)).withColumn("_gram", F.explode(core_grams(F.col("_core"))))
        near = left.join(goals.withColumn("_gram", F.explode(core_grams(F.col("_goal")))), ["case_id", "_gram"]).select("case_id", "org", "_core", "canonical", "_goal").distinct()
        near = near.withColumn("_b", similarity_bounds(F.col("_core"), F.col("_goal"), suffixes)).filter(F.col("_b.high") >= accept)
        orgs = exact.unionByName(near.select("case_id", "org", "canonical", core_similarity(F.col("_core"), F.col("_goal"), suffixes, F.col("_b")).alias("_s")))
        names = orgs.filter(F.col("_s") >= accept).groupBy("case_id", "org").agg(F.max_by("canonical", F.struct("_s", "canonical")).alias("_new"))
        d = d.join(names, ["case_id", "org"], "left")
        if "group_id" in d.columns:
            d = d.join(move.drop("_case"), "group_id", "left").withColumn("group_id", F.coalesce("target_id", "group_id"))
            d = d.withColumn("org", F.coalesce("_name", "_new", "org")).drop("target_id", "_name", "_new")
        else:
            d = d.withColumn("org", F.coalesce("_new", "org")).drop("_new")
        if name == "facts":
            d = d.join(by_case, "case_id", "left").withColumns({c: replace_pairs(F.col(c), F.col("_pairs")) for c in ("title", "summary", "quote") if c in d.columns}).drop("_pairs")
        out[name] = d.select(*tables[name].columns)
    if "texts" in tables:
        t = tables["texts"]
        text_cols = [f.name for f in t.schema.fields if f.dataType.simpleString() == "string"]
        d = t.join(by_case, "case_id", "left").withColumns({c: replace_pairs(F.col(c), F.col("_pairs")) for c in text_cols})
        out["texts"] = d.select(*t.columns)
    return out


# (action, from state or None for any but the target, to state)
TRANSITIONS = [
    ("submit", "reviewing", "pending_confirm"),
    ("confirm", None, "completed"),
    ("reopen", "completed", "pending_upload"),
]


def apply_transitions(rows: DataFrame, requests: DataFrame, rules: list[tuple] = TRANSITIONS, states: list[str] = list(fixed.CASE_STATUS)) -> DataFrame:
    """Final state of each row after its requests (case_id, action, ord) in order, with the
    number accepted and rejected. ``opinion_ok`` of the row bars ``confirm`` when false.

    A long request list is cut into parts; each part is folded to a table "state in ->
    (state out, accepted)" natively and the tables of a row are chained.
    """
    from caseweave.operators.split import in_parts

    actions = sorted({a for a, _, _ in rules})
    nxt = []
    for a in actions:
        row = []
        for s in states:
            to = [t for (x, f, t) in rules if x == a and (f == s or (f is None and s != t))]
            row.append(states.index(to[0]) if to else -1)
        nxt.append(row)
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in nxt])
    code = F.array_position(F.array(*[F.lit(a) for a in actions]), F.col("action")) - 1
    ok = rows.select("case_id", F.coalesce("opinion_ok", F.lit(True)).alias("_ok")) if "opinion_ok" in rows.columns else rows.select("case_id", F.lit(True).alias("_ok"))
    q = requests.join(ok, "case_id").withColumn("_a", F.when((F.col("action") == "confirm") & ~F.col("_ok"), -1).otherwise(code).cast("int"))
    parts = in_parts(q, ["case_id"], [F.col("ord")], F.floor(F.col("ord") / 100_000), F.col("_a"), 10_000, "acts")
    start = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(0).cast("bigint").alias("n")) for i in range(len(states))])

    def one(acc: Column, a: Column) -> Column:
        return F.transform(
            acc,
            lambda e: let(
                F.when(a < 0, F.lit(-1)).otherwise(F.get(F.get(table, a), e["s"])),
                lambda t: F.struct(F.when(t >= 0, t).otherwise(e["s"]).alias("s"), (e["n"] + F.when(t >= 0, 1).otherwise(0)).cast("bigint").alias("n")),
            ),
        )

    maps = parts.select("case_id", "part", F.aggregate("acts", start, one).alias("m"), F.size("acts").alias("k"))
    per = maps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("ms"), F.sum("k").alias("requests"))
    names = F.array(*[F.lit(s) for s in states])
    d = rows.join(per, "case_id", "left")
    first = F.struct((F.array_position(names, F.col("status")) - 1).cast("int").alias("s"), F.lit(0).cast("bigint").alias("n"))
    end = F.aggregate("ms", first, lambda acc, p: let(F.get(p["m"], acc["s"]), lambda e: F.struct(e["s"].alias("s"), (acc["n"] + e["n"]).alias("n"))))
    d = d.withColumn("_end", end)
    return d.withColumns(
        {
            "status": F.coalesce(F.get(names, F.col("_end.s")), F.col("status")),
            "accepted": F.coalesce(F.col("_end.n"), F.lit(0)),
            "rejected": F.coalesce(F.col("requests") - F.col("_end.n"), F.lit(0)),
        }
    ).drop("_end", "ms", "requests")


GROUPED_TYPES = ["medical_record", "imaging_report"]


def auto_import(
    pages: DataFrame, imported: DataFrame, groups: DataFrame, aliases: DataFrame, confirmed: DataFrame, min_confidence: float = 0.5,
    rules: Rules | None = None, types: list[str] = list(fixed.PAGE_TYPES), suffixes=fixed.ORG_SUFFIXES, chars: str = r"一-龥",
) -> tuple[DataFrame, DataFrame]:
    """(pages with outcome, reason, type, subtype, group_id, page_number; groups with the new ones).

    pages: case_id, file_name, ord (position in the listing), page_number, text, prediction.
    imported: file_name and, if known, group_id of the pages that are there. Groups are made in
    the order of their first page. A grouped page without a number gets its position among the
    pages of its group, those that are there first.
    """
    least = min_confidence or 0.5
    p = F.col("prediction")
    seen = imported.select("file_name").distinct().withColumn("_seen", F.lit(True))
    kind, conf = p["type"], F.coalesce(p["confidence"], F.lit(0.0))
    d = pages.join(seen, "file_name", "left")
    reason = (
        F.when(F.col("_seen"), "已导入")
        .when(~_filled(kind), "未识别出材料类型")
        .when(~kind.isin(*types), F.concat(F.lit("无效材料类型: "), kind))
        .when(conf < least, F.concat(F.lit("置信度过低: "), F.format_string("%.2f", conf)))
    )
    d = d.withColumn("reason", reason).withColumn(
        "outcome", F.when(F.col("_seen"), "skipped").when(F.col("reason").isNotNull(), "failed").otherwise("imported")
    ).drop("_seen")
    named = d.filter((F.col("outcome") == "imported") & kind.isin(*GROUPED_TYPES)).select("case_id", "file_name", "ord", kind.alias("type"), p["group"].alias("name"))
    named = canonicalize(named, aliases, confirmed, suffixes, chars)
    wanted = named.select("case_id", "type", F.col("canonical").alias("name"), "ord", F.col("matched").alias("confirmed"))
    all_groups = ensure_groups(groups, wanted)
    ids = all_groups.groupBy("case_id", "type", "name").agg(F.min("group_id").alias("group_id"))
    named = named.join(ids, [named["case_id"] == ids["case_id"], named["type"] == ids["type"], named["canonical"] == ids["name"]]).select(named["case_id"], named["file_name"], named["ord"], "group_id")
    named = split_row_number(named, ["group_id"], [F.col("ord"), F.col("file_name")], F.floor(F.col("ord") / 100_000), "_at").drop("ord")
    if "group_id" in imported.columns:
        there = imported.filter(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.count(F.lit(1)).alias("_there"))
        named = named.join(there, "group_id", "left").withColumn("_at", F.col("_at") + F.coalesce("_there", F.lit(0))).drop("_there")
    d = d.join(named, ["case_id", "file_name"], "left").withColumn("_t", compact_text(F.col("text")))
    d = d.withColumn("page_number", F.coalesce("page_number", F.col("_at").cast("int"))).drop("_at")
    sub = F.coalesce(F.nullif(p["subtype"], F.lit("")), F.when(F.col("_t") != "", classify_subtype(kind, F.col("_t"), rules)))
    take = F.col("outcome") == "imported"
    return d.withColumns({"type": F.when(take, kind), "subtype": F.when(take, sub), "status": F.when(take, F.when(_filled(F.col("text")), "completed").otherwise("pending"))}).drop("_t"), all_groups


def reset_stuck(pages: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    stuck = F.coalesce(F.col("status") == "processing", F.lit(False))
    p = pages.withColumn("text", F.when(stuck, F.lit("")).otherwise(F.col("text"))).withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))
    return p, cases.withColumn("status", F.when(F.col("status") == "recognizing", "pending_upload").otherwise(F.col("status")))


PATCHABLE = ["review_status", "importance", "review_note", "summary", "title", "org", "fact_date"]


def patch_facts(rows: DataFrame, patches: DataFrame, key: str = "fact_id") -> DataFrame:
    """patches: key, changes (map). Unknown columns and invalid codes are ignored."""
    d = rows.join(patches.select(key, "changes"), key, "left")
    names = F.coalesce(F.map_keys("changes"), F.array().cast("array<string>"))
    valid = {"review_status": fixed.REVIEW_STATUS, "importance": fixed.IMPORTANCE}
    out = {}
    for c in [c for c in PATCHABLE if c in rows.columns]:
        v = F.try_element_at("changes", F.lit(c))
        use = F.array_contains(names, c)
        if c in valid:
            use = use & F.coalesce(v.isin(*valid[c]), F.lit(False))
        out[c] = F.when(use, v).otherwise(F.col(c))
    d = d.withColumns(out)
    patched = F.col("changes").isNotNull() & (F.col("review_status") == "excluded")
    return d.withColumn("importance", F.when(patched, "excluded").otherwise(F.col("importance"))).drop("changes")


def move_pages(rows: DataFrame, moves: DataFrame, groups: DataFrame, rules: Rules | None = None, types: list[str] = list(fixed.PAGE_TYPES), grouped: list[str] = GROUPED_TYPES) -> DataFrame:
    """Pages after the moves (page_id, to_type, to_group, ord); ``moved`` says what became of each.

    A moved page gets the next number of its new group; the group must be of the new type.
    """
    g = groups.select(F.col("group_id").alias("to_group"), F.col("type").alias("_gtype"), F.col("case_id").alias("_gcase"))
    m = moves.join(g, "to_group", "left")
    d = rows.join(m, "page_id", "left")
    needs = F.col("to_type").isin(*grouped)
    good = F.coalesce((F.col("_gtype") == F.col("to_type")) & (F.col("_gcase") == F.col("case_id")), F.lit(False))
    state = F.when(F.col("to_type").isNull(), F.lit(None)).when(~F.col("to_type").isin(*types), "bad_type").when(needs & ~good, "bad_group").otherwise("moved")
    d = d.withColumn("moved", state)
    moving = F.col("moved").eqNullSafe("moved")
    stay = d.filter(~moving)
    go = d.filter(moving)
    leavers = go.select("page_id")
    base = rows.join(leavers, "page_id", "left_anti").groupBy(F.col("group_id").alias("to_group"), F.col("type").alias("to_type")).agg(F.count(F.lit(1)).alias("_base"))
    go = split_row_number(go, ["to_type", "to_group"], [F.col("ord"), F.col("page_id")], F.floor(F.col("ord") / 100_000), "_rn").join(base, ["to_group", "to_type"], "left")
    inside = F.col("to_type").isin(*grouped)
    go = go.withColumn("_t", compact_text(F.col("text")))
    go = go.withColumns(
        {
            "type": F.col("to_type"), "group_id": F.when(inside, F.col("to_group")),
            "page_number": F.when(inside, F.col("_rn") + F.coalesce("_base", F.lit(0))).cast("int"),
            "subtype": F.when(_filled(F.col("text")), classify_subtype(F.col("to_type"), F.col("_t"), rules)),
        }
    )
    cols = [*rows.columns, "moved"]
    return stay.select(*cols).unionByName(go.select(*cols))


def apply_review(pages: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with the reviews saved, documents to rebuild). reviews: page_id, status, and
    reviewed / confidence / notes, null where not sent."""
    r = reviews.select("page_id", F.coalesce(F.nullif("status", F.lit("")), F.lit("completed")).alias("_s"), F.col("reviewed").alias("_x"), F.col("confidence").alias("_c"), F.col("notes").alias("_n"))
    d = pages.join(r.filter(F.col("_s").isin(*fixed.PROOFREAD_STATUS)), "page_id", "left")
    hit, done = F.col("_s").isNotNull(), F.col("_s") == "completed"
    d = d.withColumns(
        {
            "reviewed": F.coalesce("_x", "reviewed"),
            "review_status": F.coalesce("_s", "review_status"),
            "confidence": F.when(~hit, F.col("confidence")).when(F.col("_c").isNotNull(), F.col("_c")).when(done, F.greatest(F.coalesce("confidence", F.lit(0)), F.lit(95))).otherwise(F.col("confidence")),
            "notes": F.when(~hit, F.col("notes")).when(F.col("_n").isNotNull(), F.col("_n")).when(done, "人工核验通过").otherwise(F.col("notes")),
        }
    )
    touched = d.filter(hit).select("doc_id").distinct()
    return d.drop("_s", "_x", "_c", "_n"), touched


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame, links: dict[str, str]) -> dict[str, DataFrame]:
    """Rows whose link column is among the keys leave every table. links: table -> column."""
    one = keys.columns[0]
    return {n: d.join(keys.select(F.col(one).alias(links[n])).distinct(), links[n], "left_anti") if n in links else d for n, d in tables.items()}


def undo_import(pages: DataFrame, names: DataFrame) -> DataFrame:
    return pages.join(names.select("file_name").distinct(), "file_name", "left_anti")


def apply_text(pages: DataFrame, fixes: DataFrame, rules: Rules | None = None) -> DataFrame:
    """fixes: page_id, new_text. Text in, status completed, subtype recomputed."""
    d = pages.join(fixes.select("page_id", "new_text"), "page_id", "left").withColumn("_t", compact_text(F.col("new_text")))
    hit = F.col("new_text").isNotNull()
    return d.withColumns(
        {
            "text": F.coalesce("new_text", "text"),
            "status": F.when(hit, "completed").otherwise(F.col("status")),
            "subtype": F.when(hit, classify_subtype(F.col("type"), F.col("_t"), rules)).otherwise(F.col("subtype")),
        }
    ).drop("new_text", "_t")


RECORD_FIELDS = ["org", "number", "complaint", "history", "exam", "diagnosis_in", "treatment", "diagnosis_out", "orders", "date_in", "date_out"]
REPORT_FIELDS = ["date", "org", "exam_type", "exam_part", "film_no", "content"]
CERTIFICATE_FIELDS = {"accident_date": "accident_date", "accident_location": "accident_location", "accident_description": "description"}
PERSON_FIELDS = ["name", "gender", "birth_date", "id_number", "address"]


def _field(name: str) -> Column:
    return real_value(F.try_element_at("fields", F.lit(name)))


def _last(name: str, types: list[str]) -> Column:
    v = F.when(F.col("type").isin(*types), _field(name))
    return F.max_by(v, F.when(v.isNotNull(), F.col("ord")))


def route_fields(extracted: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Extracted fields into their tables, by page type, with the guards of each.

    extracted: page_id, case_id, type, ord, group_id, group_name (null unless confirmed), fields.
    tables: cases, persons, records, reports. Several pages of a case are folded first, so each
    table is joined once. ``outcome`` tells what became of each page.
    """
    e = extracted
    out = {}
    letter, ident, cert, app = "entrustment_letter", "id_card", "traffic_accident_cert", "appraisal_application"
    name = F.when(F.col("type") == letter, _field("person_name")).when(F.col("type") == ident, _field("name"))
    asked = F.when(F.col("type") == app, _field("appraisal_items"))
    per_case = e.groupBy("case_id").agg(
        _last("entrusting_unit", [letter, app]).alias("entrusting_unit"),
        _last("entrustment_matter", [letter]).alias("_letter"),
        F.min_by(asked, F.when(asked.isNotNull(), F.col("ord"))).alias("_app"),
        F.max_by(name, F.when(name.isNotNull(), F.col("ord"))).alias("person_name"),
        *[_last(k, [cert]).alias(v) for k, v in CERTIFICATE_FIELDS.items()],
    )
    cases = tables["cases"]
    mine = cases.select("case_id", F.col("request").alias("_request"))
    per_case = per_case.join(mine, "case_id").withColumn("request", F.coalesce("_letter", F.when(~_filled(F.col("_request")), F.col("_app"))))
    out["cases"] = guarded_merge(cases, per_case, "case_id", [c for c in ("entrusting_unit", "request", "person_name", *CERTIFICATE_FIELDS.values()) if c in cases.columns]).drop("applied")
    p = e.filter(F.col("type") == ident).groupBy("case_id").agg(*[_last(c, [ident]).alias(c) for c in PERSON_FIELDS])
    persons = tables["persons"]
    have = [c for c in PERSON_FIELDS if c in persons.columns]
    merged = guarded_merge(persons, p, "case_id", have).drop("applied")
    out["persons"] = merged.unionByName(p.join(persons, "case_id", "left_anti").select("case_id", *have), allowMissingColumns=True)

    m = e.filter(F.col("type") == "medical_record")
    number = F.coalesce(_field("number"), F.lit(""))
    m = m.withColumn("_num", number).withColumn("_key", F.when(number != "", F.concat(F.lit("n:"), number)).otherwise(F.concat(F.lit("p:"), F.col("page_id").cast("string"))))
    days = F.try_element_at("fields", F.lit("days")).try_cast("int")
    fold = m.groupBy("case_id", "_key").agg(
        *[_last(c, ["medical_record"]).alias(c) for c in RECORD_FIELDS], F.max_by(days, F.when(days.isNotNull(), F.col("ord"))).alias("days"),
        F.max_by("group_id", F.when(F.col("group_id").isNotNull(), F.col("ord"))).alias("group_id"),
        F.max_by("group_name", F.when(F.col("group_name").isNotNull(), F.col("ord"))).alias("_gname"), F.min_by("page_id", "ord").alias("page_id"),
    )
    fold = fold.withColumn("org", F.coalesce("_gname", "org")).drop("_gname")
    r = tables["records"]
    first = r.filter(_filled(F.col("number"))).groupBy("case_id", "number").agg(F.min("record_id").alias("record_id"))
    fold = fold.join(first.select("case_id", F.concat(F.lit("n:"), "number").alias("_key"), "record_id"), ["case_id", "_key"], "left")
    known = fold.filter(F.col("record_id").isNotNull())
    rec_cols = [c for c in (*RECORD_FIELDS, "group_id") if c in r.columns]
    out["records"] = _overlay_left(r, known, "record_id", [*rec_cols, "days"])
    fresh = fold.filter(F.col("record_id").isNull()).withColumn("record_id", row_id("case_id", "_key")).drop("_key")
    out["records"] = out["records"].unionByName(fresh.select(*[c for c in fresh.columns if c in r.columns]), allowMissingColumns=True)

    x = e.filter(F.col("type") == "imaging_report")
    film = F.coalesce(F.try_element_at("fields", F.lit("film_count")).try_cast("int"), F.lit(1))
    x = x.groupBy("case_id", "page_id").agg(
        *[_last(c, ["imaging_report"]).alias(c) for c in REPORT_FIELDS], F.max_by(film, F.col("ord")).alias("film_count"),
        F.max_by("group_id", F.col("ord")).alias("group_id"), F.max_by("group_name", F.col("ord")).alias("_gname"),
    )
    x = x.withColumn("org", F.coalesce("_gname", "org")).drop("_gname")
    rep = tables["reports"]
    ids = rep.groupBy("case_id", "page_id").agg(F.min("report_id").alias("report_id"))
    x = x.join(ids, ["case_id", "page_id"], "left")
    rep_cols = [c for c in (*REPORT_FIELDS, "film_count", "group_id") if c in rep.columns]
    out["reports"] = _overlay_left(rep, x.filter(F.col("report_id").isNotNull()), "report_id", rep_cols)
    new = x.filter(F.col("report_id").isNull()).withColumn("report_id", row_id("case_id", "page_id"))
    out["reports"] = out["reports"].unionByName(new.select(*[c for c in new.columns if c in rep.columns]), allowMissingColumns=True)
    known_types = [letter, ident, cert, app, "medical_record", "imaging_report"]
    out["outcome"] = e.select("page_id", "case_id", "type", F.when(F.col("type") == "litigation_material", "skipped").when(F.col("type").isin(*known_types), "completed").otherwise("failed").alias("outcome"))
    return out


def _overlay_left(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    cols = [c for c in cols if c in old.columns and c in new.columns]
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols])
    d = old.join(n, key, "left").withColumns({c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in cols})
    return d.select(*old.columns)


def apply_group_records(groups: DataFrame, extracted: DataFrame, records: DataFrame) -> DataFrame:
    """One record per group: extracted values over the saved ones, the group name always wins.

    extracted: case_id, group_id, fields. A group without a record gets one.
    """
    g = groups.select("case_id", "group_id", F.col("name").alias("_gname"))
    n = extracted.join(g, ["case_id", "group_id"]).select(
        "case_id", "group_id", "_gname", F.lit(True).alias("_new"), *[_field(c).alias(f"_n_{c}") for c in RECORD_FIELDS if c != "org"],
        F.try_element_at("fields", F.lit("days")).try_cast("int").alias("_n_days"),
    )
    one = first_rows(records, ["case_id", "group_id"], [F.col("record_id")], 1, "_rn").drop("_rn")
    rest = records.join(one.select("record_id"), "record_id", "left_anti")
    d = one.join(n, ["case_id", "group_id"], "full")
    cols = [c for c in RECORD_FIELDS if c != "org" and c in records.columns] + (["days"] if "days" in records.columns else [])
    d = d.withColumns({c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in cols})
    d = d.withColumns({"org": F.coalesce("_gname", "org"), "record_id": F.coalesce("record_id", row_id("case_id", "group_id"))})
    return d.select(*records.columns).unionByName(rest.select(*records.columns))
