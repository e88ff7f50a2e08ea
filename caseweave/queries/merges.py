"""D01-D21, U01, G03-G05 and G08 over the given tables."""
from collections.abc import Mapping

from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions import extract as ex
from caseweave.functions import predicates as pr
from caseweave.operators import merge as me
from caseweave.plans import facts as fa
from caseweave.queries.extract import work_table
from caseweave.queries.groups import LABELLED, labelled
from caseweave.queries.predicates import COMPACT, RULES, any_of, subtype_sql
from caseweave.queries.registry import query

C = F.col
S = lambda x: F.lit(x)
NULL = lambda k: F.lit(None).cast(k)


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def joined(c, sep=","):
    return F.array_join(c.cast("array<string>"), sep)


# --- D01 ---------------------------------------------------------------------


def fact_versions(t):
    """Old rows: labelled documents; new rows: documents in three languages."""
    d = labelled(t)
    old = d.filter(C("quality").isNotNull()).select(
        C("source").alias("case_id"), text("f", C("doc_id")).alias("fact_key"), C("doc_id").alias("fact_id"),
        F.when(C("lang") == "es", "manual").when(C("toxic") == 1, "case_basic").otherwise("medical_event").alias("fact_type"), S("old").alias("summary"), S("").alias("quote"),
        F.when(C("n_chars") > 3000, "confirmed").otherwise("pending").alias("review_status"), S("supporting").alias("importance"), F.when(C("n_chars") < 500, "note").alias("review_note"),
    )
    new = d.filter(C("lang").isin("en", "fr")).select(
        C("source").alias("case_id"), text("f", C("doc_id")).alias("fact_key"), S("medical_event").alias("fact_type"), F.when(C("n_chars") % 3 != 0, text("new ", C("lang"))).alias("summary"),
        F.when(C("n_chars") % 3 == 1, "q").otherwise("").alias("quote"), S("pending").alias("review_status"), S("core").alias("importance"),
    )
    return old, new


@query("d01_merge_facts", f"""
WITH d AS (SELECT * FROM {LABELLED}),
o AS (SELECT source, doc_id, CASE WHEN lang='es' THEN 'manual' WHEN toxic=1 THEN 'case_basic' ELSE 'medical_event' END ty, CASE WHEN n_chars > 3000 THEN 'confirmed' ELSE 'pending' END rs, CASE WHEN n_chars < 500 THEN 'note' END note FROM d WHERE quality IS NOT NULL),
n AS (SELECT source, doc_id, CASE WHEN n_chars % 3 <> 0 THEN 'new ' || lang END sm, CASE WHEN n_chars % 3 = 1 THEN 'q' ELSE '' END qu FROM d WHERE lang IN ('en','fr')),
j AS (SELECT COALESCE(o.source, n.source) source, COALESCE(o.doc_id, n.doc_id) doc_id, o.doc_id IS NOT NULL had, n.doc_id IS NOT NULL has, COALESCE(ty = 'case_basic', false) legacy, COALESCE(ty = 'medical_event', false) managed, ty, rs, note, sm, qu,
 n.doc_id IS NOT NULL AND (COALESCE(sm,'') <> '' OR COALESCE(qu,'') <> '') usable FROM o FULL JOIN n ON o.doc_id = n.doc_id),
k AS (SELECT *, had AND NOT legacy AND (rs = 'confirmed' OR (rs = 'pending' AND COALESCE(note,'') <> '')) keep FROM j WHERE usable OR (had AND NOT legacy AND (has OR NOT managed)))
SELECT source AS case_id, 'f' || doc_id AS fact_key, CASE WHEN usable THEN 'medical_event' ELSE ty END AS fact_type, CASE WHEN usable THEN sm ELSE 'old' END AS summary,
 CASE WHEN usable AND NOT keep THEN 'pending' ELSE rs END AS review_status, CASE WHEN usable AND NOT keep THEN 'core' ELSE 'supporting' END AS importance FROM k""")
def _(t):
    return me.merge_facts(*fact_versions(t)).select("case_id", "fact_key", "fact_type", "summary", "review_status", "importance")


VOCAB, PARENTS = ["tion", "ment", "lich", "aux", "the", "word"], {"ment": "word", "the": "tion"}


@query("d02_verify_facts", f"""
WITH f AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'hospital_record' WHEN 'fr' THEN 'medical_event' ELSE 'imaging_report' END ty, n_chars > 700 core, quality, text, n_chars % 5 <> 0 pages FROM {LABELLED}),
g AS (SELECT *, pages AND quality IS DISTINCT FROM 0 AND contains(text,'er') AND NOT (ty = 'imaging_report' AND n_chars_weak) good FROM (SELECT *, NOT contains(text,'er') AND contains(text,'que') n_chars_weak FROM f)),
w AS (SELECT doc_id, source, ty, unnest(list_distinct(list_filter([{', '.join(f"CASE WHEN contains(text,'{w}') THEN '{w}' END" for w in VOCAB)}, CASE WHEN contains(text,'ment') THEN 'word' END, CASE WHEN contains(text,'the') THEN 'tion' END], lambda k: k IS NOT NULL))) term FROM g WHERE good),
s AS (SELECT DISTINCT source, ty = 'imaging_report' ex, term FROM w)
SELECT g.doc_id, CASE WHEN good AND core AND EXISTS (SELECT 1 FROM w JOIN s ON s.source = w.source AND s.term = w.term AND s.ex <> (w.ty = 'imaging_report') WHERE w.doc_id = g.doc_id)
  THEN 'system_verified' WHEN quality = 0 THEN 'confirmed' ELSE 'pending' END AS review_status FROM g""")
def _(t):
    f = labelled(t).select(
        "doc_id", C("source").alias("case_id"), F.when(C("lang") == "en", "hospital_record").when(C("lang") == "fr", "medical_event").otherwise("imaging_report").alias("fact_type"), S("exam").alias("fact_role"),
        S("").alias("title"), C("text").alias("summary"), NULL("string").alias("quote"), S("").alias("org"), F.array().cast("array<string>").alias("flags"),
        F.when(C("n_chars") > 700, "core").otherwise("supporting").alias("importance"), F.when(C("quality") == 0, "confirmed").otherwise("pending").alias("review_status"),
        F.when(C("n_chars") % 5 != 0, F.array(S(1))).alias("source_pages"),
    )
    return fa.verify_facts(f, VOCAB, PARENTS, ["er"], ["que"]).select("doc_id", "review_status")


@query("d03_rebuild_events", f"""
WITH d AS (SELECT * FROM {LABELLED}),
o AS (SELECT source, lang || n_chars id, NOT (lang = 'en' AND COALESCE(quality,0) <> 1) kept FROM d WHERE toxic IS NULL OR quality = 1),
p AS (SELECT source, lang || n_chars id FROM d WHERE lang <> 'fr'),
a AS (SELECT source, CASE WHEN kept THEN 'preserved' ELSE 'deleted' END act FROM o UNION ALL
 SELECT p.source, CASE WHEN EXISTS (SELECT 1 FROM o WHERE kept AND o.source = p.source AND o.id = p.id) THEN 'duplicate' ELSE 'created' END FROM p)
SELECT source AS group_id, count(*) FILTER (WHERE act='created') AS created, count(*) FILTER (WHERE act='deleted') AS deleted, count(*) FILTER (WHERE act='preserved') AS preserved, count(*) FILTER (WHERE act='duplicate') AS duplicate FROM a GROUP BY 1""")
def _(t):
    d = labelled(t).withColumn("identity", ex.event_identity(C("lang"), C("n_chars").cast("string"), S(""), F.array().cast("array<bigint>")))
    old = d.filter(C("toxic").isNull() | (C("quality") == 1)).select(
        C("source").alias("group_id"), "identity", F.when(C("lang") == "en", F.array(S(fixed.AUTO_FLAG))).otherwise(F.array(S("manual"))).alias("flags"),
        F.when(C("quality") == 1, "confirmed").alias("review_status"),
    )
    new = d.filter(C("lang") != "fr").select(C("source").alias("group_id"), "identity")
    return me.rebuild_counts(me.rebuild_events(old, new))


@query("d04_sync_candidates", f"""
WITH d AS (SELECT * FROM {LABELLED}),
o AS (SELECT source, doc_id, CASE WHEN quality = 1 THEN 'accepted' WHEN toxic = 1 THEN 'odd' ELSE 'excluded' END st, CASE lang WHEN 'es' THEN 'manual' ELSE 'analysis' END src FROM d WHERE quality IS NOT NULL),
n AS (SELECT source, doc_id, CASE WHEN lang = 'en' THEN 'met' ELSE 'uncertain' END de, n_chars c FROM d WHERE lang IN ('en','fr'))
SELECT COALESCE(o.source, n.source) AS case_id, COALESCE(o.doc_id, n.doc_id) AS candidate_key, CASE WHEN n.doc_id IS NOT NULL THEN de WHEN src = 'analysis' THEN 'not_met' ELSE 'old' END AS decision,
 CASE WHEN n.doc_id IS NULL THEN CASE WHEN src = 'analysis' THEN 'excluded' ELSE st END WHEN st IN ('accepted','excluded') THEN st WHEN de = 'met' AND c >= 80 THEN 'accepted' WHEN de = 'uncertain' THEN 'needs_review' ELSE 'pending' END AS status
FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def _(t):
    d = labelled(t)
    old = d.filter(C("quality").isNotNull()).select(
        C("source").alias("case_id"), C("doc_id").alias("candidate_key"), S("old").alias("decision"), F.when(C("quality") == 1, "accepted").when(C("toxic") == 1, "odd").otherwise("excluded").alias("status"),
        F.when(C("lang") == "es", "manual").otherwise("analysis").alias("source"),
    )
    new = d.filter(C("lang").isin("en", "fr")).select(C("source").alias("case_id"), C("doc_id").alias("candidate_key"), F.when(C("lang") == "en", "met").otherwise("uncertain").alias("decision"), C("n_chars").alias("confidence"))
    return me.sync_candidates(old, new).select("case_id", "candidate_key", "decision", "status")


def customer_pair(t):
    old = t.customer.select(
        C("c_custkey").alias("case_id"), C("c_name").alias("name"), C("c_mktsegment").alias("unit"),
        F.when(C("c_nationkey") < 10, F.array(S("name"))).when(C("c_nationkey") < 15, F.array(S("unit"), S("x"))).alias("confirmed_fields"),
    )
    new = t.customer.filter(C("c_acctbal") > 1000).select(C("c_custkey").alias("case_id"), F.upper("c_name").alias("name"), F.when(C("c_nationkey") % 2 == 0, "").otherwise("NEW").alias("unit"))
    return old, new


@query("d05_guarded_merge", """
SELECT c_custkey AS case_id, CASE WHEN c_acctbal > 1000 AND c_nationkey >= 10 THEN upper(c_name) ELSE c_name END AS name,
 CASE WHEN c_acctbal > 1000 AND c_nationkey % 2 = 1 AND NOT (c_nationkey BETWEEN 10 AND 14) THEN 'NEW' ELSE c_mktsegment END AS unit,
 concat_ws('|', CASE WHEN c_acctbal > 1000 AND c_nationkey >= 10 THEN 'name' END, CASE WHEN c_acctbal > 1000 AND c_nationkey % 2 = 1 AND NOT (c_nationkey BETWEEN 10 AND 14) THEN 'unit' END) AS applied FROM customer""")
def _(t):
    old, new = customer_pair(t)
    return me.guarded_merge(old, new, "case_id", ["name", "unit"]).select("case_id", "name", "unit", joined(C("applied"), "|").alias("applied"))


@query("d06_apply_edits", """
SELECT c_custkey AS case_id, CASE WHEN e = 1 THEN 'unit ' || c_name ELSE c_mktsegment END AS entrusting_unit, CASE WHEN e = 2 THEN NULL ELSE 'req' END AS request, CASE WHEN e = 2 THEN '2024-05-01' ELSE 'none' END AS appraisal_date,
 CASE WHEN e IN (1,2) AND s IN ('pending_review','pending_confirm') THEN 'reviewing' WHEN e = 3 THEN 'recognizing' ELSE s END AS status,
 CASE e WHEN 1 THEN 'request|entrusting_unit' WHEN 2 THEN 'request|acceptance_date' WHEN 3 THEN 'request|entrusting_unit' ELSE 'request' END AS confirmed
FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN c_nationkey % 4 ELSE 0 END e, CASE c_mktsegment WHEN 'BUILDING' THEN 'pending_review' WHEN 'MACHINERY' THEN 'pending_confirm' ELSE 'completed' END s FROM customer)""".replace(
    "CASE WHEN e = 1 THEN 'unit ' || c_name ELSE", "CASE WHEN e = 1 THEN 'unit ' || c_name WHEN e = 3 THEN 'u3' ELSE"))
def _(t):
    rows = t.customer.select(
        C("c_custkey").alias("case_id"), C("c_mktsegment").alias("entrusting_unit"), S("req").alias("request"), S("none").alias("appraisal_date"), S("").alias("acceptance_date"),
        F.when(C("c_mktsegment") == "BUILDING", "pending_review").when(C("c_mktsegment") == "MACHINERY", "pending_confirm").otherwise("completed").alias("status"), F.array(S("request")).alias("confirmed_fields"),
    )
    k = C("c_nationkey") % 4
    changes = (
        F.when(k == 1, F.create_map(S("entrusting_unit"), text("unit ", C("c_name"))))
        .when(k == 2, F.create_map(S("request"), NULL("string"), S("acceptance_date"), S("2024-05-01")))
        .when(k == 3, F.create_map(S("entrusting_unit"), S("u3"), S("status"), S("recognizing")))
    )
    edits = t.customer.filter((C("c_acctbal") > 5000) & (k > 0)).select(C("c_custkey").alias("case_id"), changes.alias("changes"))
    r = me.apply_edits(rows, edits)
    return r.select("case_id", "entrusting_unit", "request", "appraisal_date", "status", joined(C("confirmed_fields"), "|").alias("confirmed"))


@query("d07_overlay_nonempty", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'late' ELSE o_orderstatus END AS org, CASE o_orderpriority WHEN '1-URGENT' THEN 7::BIGINT WHEN '5-LOW' THEN 1::BIGINT ELSE 1::BIGINT END AS days FROM orders""")
def _(t):
    p = C("o_orderpriority")
    old = t.orders.select("o_orderkey", C("o_orderstatus").alias("org"), S(1).alias("days"))
    new = t.orders.filter(p != "2-HIGH").select("o_orderkey", F.when(p == "1-URGENT", "late").when(p == "3-MEDIUM", "null").when(p == "5-LOW", "").alias("org"), F.when(p == "1-URGENT", "7").when(p == "5-LOW", "many").alias("days"))
    return me.overlay_nonempty(old, new, ["o_orderkey"], ["org"], ["days"])


@query("d08_upsert_aliases", """
WITH n AS (SELECT s_nationkey::BIGINT k, 'a' || (s_suppkey % 3) a, s_name c, s_suppkey o FROM supplier WHERE s_acctbal > 2000),
l AS (SELECT k, a, c, row_number() OVER (PARTITION BY k, a ORDER BY o DESC) rn FROM n)
SELECT COALESCE(l.k, b.k) AS case_id, COALESCE(l.a, b.a) AS alias, COALESCE(l.c, b.c) AS canonical FROM (SELECT * FROM l WHERE rn = 1) l FULL JOIN (SELECT n_nationkey::BIGINT k, 'a1' a, n_name c FROM nation) b ON l.k = b.k AND l.a = b.a""")
def _(t):
    old = t.nation.select(C("n_nationkey").alias("case_id"), S("a1").alias("alias"), C("n_name").alias("canonical"))
    new = t.supplier.filter(C("s_acctbal") > 2000).select(C("s_nationkey").alias("case_id"), text(" a", C("s_suppkey") % 3).alias("alias"), C("s_name").alias("canonical"), C("s_suppkey").alias("ord"))
    same = t.supplier.select(C("s_nationkey").alias("case_id"), C("s_name").alias("alias"), C("s_name").alias("canonical"), C("s_suppkey").alias("ord"))
    return me.upsert_aliases(old, new.unionByName(same))


@query("d09_ensure_groups", """
WITH g AS (SELECT n_nationkey k, 'BUILDING' nm, 5 so FROM nation),
w AS (SELECT c_nationkey k, c_mktsegment nm, min(c_custkey) o FROM customer GROUP BY 1, 2),
f AS (SELECT w.k, w.nm, row_number() OVER (PARTITION BY w.k ORDER BY o, w.nm) rn FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = w.k AND g.nm = w.nm))
SELECT k::BIGINT AS case_id, nm AS name, so::BIGINT AS sort_order FROM g UNION ALL SELECT k::BIGINT, nm, rn + 1 FROM f""")
def _(t):
    groups = t.nation.select(C("n_nationkey").cast("bigint").alias("group_id"), C("n_nationkey").alias("case_id"), S("medical_record").alias("type"), S("BUILDING").alias("name"), S(5).alias("sort_order"), S(False).alias("is_confirmed"))
    wanted = t.customer.select(C("c_nationkey").alias("case_id"), S("medical_record").alias("type"), C("c_mktsegment").alias("name"), C("c_custkey").alias("ord"), S(False).alias("confirmed"))
    return me.ensure_groups(groups, wanted).select("case_id", "name", "sort_order")


def named_groups(t):
    """Suppliers as groups of the case given by their nation; one name in five is noisy."""
    name = F.when(C("s_suppkey") % 5 == 0, text("东城", C("s_nationkey"), "区县中心医院")).when(C("s_suppkey") % 5 == 1, text("西城东城", C("s_nationkey"), "区县中心 医院")).otherwise(text("诊所", C("s_suppkey")))
    return t.supplier.select(C("s_suppkey").alias("group_id"), C("s_nationkey").alias("case_id"), S("medical_record").alias("type"), name.alias("name"), C("s_suppkey").cast("int").alias("sort_order"), S(False).alias("is_confirmed"))


@query("d10_confirm_group_name", """
WITH g AS (SELECT s_suppkey, s_nationkey n, s_suppkey % 5 m FROM supplier), r AS (SELECT n, min(s_suppkey) tgt FROM g WHERE m = 0 GROUP BY 1),
mp AS (SELECT g.s_suppkey, g.n, g.m, CASE WHEN g.m IN (0,1) AND r.tgt IS NOT NULL THEN r.tgt ELSE g.s_suppkey END tgt, g.m IN (0,1) AND r.tgt IS NOT NULL hit FROM g LEFT JOIN r ON g.n = r.n),
p AS (SELECT c_custkey, mp.tgt, mp.hit, c_nationkey, mp.n, mp.m FROM customer JOIN mp ON mp.s_suppkey = c_custkey % 100)
SELECT c_custkey AS page_id, tgt AS group_id, CASE WHEN hit THEN row_number() OVER (PARTITION BY tgt ORDER BY c_custkey) ELSE c_custkey END AS page_number,
 CASE WHEN hit THEN '就诊于东城' || n || '区县中心医院' || c_custkey WHEN m = 1 THEN '就诊于西城东城' || n || '区县中心 医院' || c_custkey ELSE '就诊于诊所' || (c_custkey % 100) || c_custkey END AS text FROM p""")
def _(t):
    groups = named_groups(t)
    reqs = groups.filter(C("group_id") % 5 == 0).groupBy("case_id", "name").agg(F.min("group_id").alias("group_id")).select("group_id", C("name").alias("canonical"))
    g = groups.select("group_id", C("name").alias("gname"), "case_id")
    pages = t.customer.select(C("c_custkey").alias("page_id"), (C("c_custkey") % 100).alias("group_id"), C("c_custkey").cast("int").alias("page_number")).join(g, "group_id")
    pages = pages.withColumn("text", F.concat(S("就诊于"), "gname", C("page_id").cast("string"))).drop("gname")
    aliases = groups.select("case_id", C("name").alias("alias"), C("name").alias("canonical")).limit(0)
    out = me.confirm_group_name({"groups": groups, "aliases": aliases, "pages": pages}, reqs)
    return out["pages"].select("page_id", "group_id", "page_number", "text")


@query("d11_apply_transitions", """
WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'reviewing' WHEN 'O' THEN 'completed' ELSE 'pending_upload' END s, CASE o_orderpriority WHEN '1-URGENT' THEN 'submit' WHEN '2-HIGH' THEN 'confirm' WHEN '3-MEDIUM' THEN 'reopen' WHEN '4-NOT SPECIFIED' THEN 'confirm2' END a, o_custkey % 2 = 0 ok FROM orders),
x AS (SELECT *, CASE WHEN a = 'submit' THEN s = 'reviewing' WHEN a IN ('confirm','confirm2') THEN s <> 'completed' AND ok WHEN a = 'reopen' THEN s = 'completed' END hit FROM o)
SELECT o_orderkey AS case_id, CASE WHEN a = 'confirm2' THEN CASE WHEN hit OR s = 'completed' THEN 'pending_upload' ELSE s END WHEN hit THEN CASE a WHEN 'submit' THEN 'pending_confirm' WHEN 'confirm' THEN 'completed' ELSE 'pending_upload' END ELSE s END AS status,
 CASE WHEN a IS NULL THEN 0 WHEN a = 'confirm2' THEN hit::INT + (hit OR s = 'completed')::INT ELSE hit::INT END::BIGINT AS accepted, CASE WHEN a IS NULL THEN 0 WHEN a = 'confirm2' THEN 2 - hit::INT - (hit OR s = 'completed')::INT ELSE 1 - hit::INT END::BIGINT AS rejected FROM x""")
def _(t):
    p = C("o_orderpriority")
    rows = t.orders.select(C("o_orderkey").alias("case_id"), F.when(C("o_orderstatus") == "F", "reviewing").when(C("o_orderstatus") == "O", "completed").otherwise("pending_upload").alias("status"), (C("o_custkey") % 2 == 0).alias("opinion_ok"))
    acts = F.when(p == "1-URGENT", F.array(S("submit"))).when(p == "2-HIGH", F.array(S("confirm"))).when(p == "3-MEDIUM", F.array(S("reopen"))).when(p == "4-NOT SPECIFIED", F.array(S("confirm"), S("reopen")))
    reqs = t.orders.select(C("o_orderkey").alias("case_id"), F.posexplode(acts).alias("ord", "action"))
    return me.apply_transitions(rows, reqs).select("case_id", "status", "accepted", "rejected")


@query("d12_auto_import", f"""
WITH d AS (SELECT d.doc_id, source, lang, n_chars, (doc_id % 50) / 50.0 conf, {COMPACT} x, l.toxic FROM documents d LEFT JOIN (SELECT doc_id k, toxic FROM labels WHERE toxic = 1) l ON k = doc_id),
o AS (SELECT *, CASE WHEN toxic = 1 THEN '已导入' WHEN lang = 'es' THEN '未识别出材料类型' WHEN lang = 'de' AND n_chars > 2000 THEN '无效材料类型: odd' WHEN conf < 0.5 THEN '置信度过低: ' || printf('%.2f', conf) END reason FROM d),
g AS (SELECT *, reason IS NULL AND lang IN ('en','fr') AS grouped, CASE lang WHEN 'fr' THEN 'orgfr' || (doc_id % 3) ELSE 'orgen' END nm FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY source, nm, grouped ORDER BY doc_id) rn, count(*) FILTER (WHERE toxic = 1) OVER (PARTITION BY source) n FROM g),
so AS (SELECT source k1, nm k2, 1 + row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) place FROM g WHERE grouped AND lang = 'fr' GROUP BY 1, 2)
SELECT doc_id, CASE WHEN toxic = 1 THEN 'skipped' WHEN reason IS NOT NULL THEN 'failed' ELSE 'imported' END AS outcome, reason, CASE WHEN reason IS NULL THEN CASE lang WHEN 'fr' THEN 'given' WHEN 'en' THEN {subtype_sql('medical_record')} END END AS subtype,
 grouped, CASE WHEN n_chars % 2 = 1 THEN doc_id WHEN grouped THEN rn + CASE WHEN lang = 'en' THEN n ELSE 0 END END AS page_number,
 CASE WHEN grouped THEN CASE WHEN lang = 'en' THEN 1 ELSE place END END::BIGINT AS sort_order FROM r LEFT JOIN so ON source = k1 AND nm = k2""")
def _(t):
    kind = F.when(C("lang") == "es", "").when((C("lang") == "de") & (C("n_chars") > 2000), "odd").when(C("lang") == "de", "id_card").otherwise("medical_record")
    p = F.struct(kind.alias("type"), F.when(C("lang") == "fr", "given").otherwise("").alias("subtype"), text("org", C("lang"), F.when(C("lang") == "fr", (C("doc_id") % 3).cast("string")).otherwise("")).alias("group"), ((C("doc_id") % 50) / 50.0).cast("double").alias("confidence"))
    pages = t.documents.select("doc_id", C("source").alias("case_id"), text("p", C("doc_id")).alias("file_name"), C("doc_id").alias("ord"), F.when(C("n_chars") % 2 == 1, C("doc_id")).cast("int").alias("page_number"), "text", p.alias("prediction"))
    groups = t.documents.groupBy(C("source").alias("case_id")).agg(F.min("doc_id").alias("group_id"))
    groups = groups.select("group_id", "case_id", S("medical_record").alias("type"), S("orgen").alias("name"), S(1).alias("sort_order"), S(False).alias("is_confirmed"))
    done = t.labels.filter(C("toxic") == 1).join(t.documents, "doc_id").join(groups, C("source") == C("case_id")).select(text("p", C("doc_id")).alias("file_name"), "group_id")
    aliases = groups.select("case_id", C("name").alias("alias"), C("name").alias("canonical")).filter(S(False))
    confirmed = groups.select("case_id", S("甲乙丙医院").alias("name"), S(1).alias("ord"))
    r, g = me.auto_import(pages, done, groups, aliases, confirmed, 0, rules=RULES)
    r = r.join(g.select("group_id", "sort_order"), "group_id", "left")
    return r.select("doc_id", "outcome", "reason", "subtype", C("group_id").isNotNull().alias("grouped"), "page_number", "sort_order")


@query("d13_reset_stuck", """
SELECT 'page' AS kind, l_orderkey AS k, CASE WHEN l_returnflag='N' THEN 'pending' ELSE l_returnflag END AS status, CASE WHEN l_returnflag='N' THEN '' ELSE l_linestatus END AS text FROM lineitem
UNION ALL SELECT 'case', o_orderkey, CASE WHEN o_orderstatus='P' THEN 'pending_upload' ELSE o_orderstatus END, NULL FROM orders""")
def _(t):
    pages = t.lineitem.select(C("l_orderkey").alias("k"), F.when(C("l_returnflag") == "N", "processing").otherwise(C("l_returnflag")).alias("status"), C("l_linestatus").alias("text"))
    cases = t.orders.select(C("o_orderkey").alias("k"), F.when(C("o_orderstatus") == "P", "recognizing").otherwise(C("o_orderstatus")).alias("status"))
    p, c = me.reset_stuck(pages, cases)
    return p.select(S("page").alias("kind"), "k", "status", "text").unionByName(c.select(S("case").alias("kind"), "k", "status", NULL("string").alias("text")))


@query("d14_patch_facts", f"""
SELECT doc_id AS fact_id, CASE WHEN quality = 1 THEN 'excluded' ELSE 'pending' END AS review_status, CASE WHEN quality = 1 THEN 'excluded' WHEN toxic = 1 THEN 'core' ELSE 'supporting' END AS importance, CASE WHEN toxic = 1 THEN NULL ELSE lang END AS title FROM {LABELLED}""")
def _(t):
    rows = t.documents.select(C("doc_id").alias("fact_id"), S("pending").alias("review_status"), S("supporting").alias("importance"), C("lang").alias("title"), C("source"))
    q = F.when(C("quality") == 1, "excluded").otherwise("odd")
    changes = F.when(C("toxic") == 1, F.create_map(S("review_status"), q, S("importance"), S("core"), S("title"), NULL("string"))).otherwise(F.create_map(S("review_status"), q, S("source"), S("hacked")))
    patches = t.labels.select(C("doc_id").alias("fact_id"), changes.alias("changes"))
    return me.patch_facts(rows, patches).select("fact_id", "review_status", "importance", "title")


@query("d15_move_pages", f"""
WITH r AS (SELECT doc_id, source, lang, n_chars, {COMPACT} x FROM documents),
m AS (SELECT r.*, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN 'odd' WHEN l.quality = 1 THEN 'imaging_report' ELSE 'letter' END END tt FROM r LEFT JOIN labels l ON r.doc_id = l.doc_id),
s AS (SELECT *, CASE WHEN tt IS NULL THEN NULL WHEN tt = 'odd' THEN 'bad_type' WHEN tt = 'imaging_report' AND lang = 'es' THEN 'bad_group' ELSE 'moved' END mv FROM m),
b AS (SELECT source, count(*) n FROM s WHERE COALESCE(mv,'') <> 'moved' AND lang = 'en' GROUP BY 1)
SELECT doc_id AS page_id, mv AS moved, CASE WHEN mv = 'moved' THEN tt WHEN lang = 'en' THEN 'imaging_report' ELSE 'medical_record' END AS type,
 CASE WHEN mv = 'moved' THEN CASE WHEN tt = 'imaging_report' THEN row_number() OVER (PARTITION BY s.source, mv, tt ORDER BY doc_id) + COALESCE(b.n,0) END ELSE n_chars END AS page_number,
 CASE WHEN mv = 'moved' THEN CASE WHEN tt = 'imaging_report' THEN {subtype_sql('imaging_report')} END ELSE 'kept' END AS subtype FROM s LEFT JOIN b ON s.source = b.source""")
def _(t):
    src = F.substring("source", 4, 9).cast("bigint")
    rows = t.documents.select(
        C("doc_id").alias("page_id"), C("source").alias("case_id"), F.when(C("lang") == "en", src).alias("group_id"), F.when(C("lang") == "en", "imaging_report").otherwise("medical_record").alias("type"),
        C("n_chars").cast("int").alias("page_number"), S("kept").alias("subtype"), "text",
    )
    moves = t.labels.join(t.documents, "doc_id").select(
        C("doc_id").alias("page_id"), F.when(C("toxic") == 1, "odd").when(C("quality") == 1, "imaging_report").otherwise("letter").alias("to_type"),
        F.when(C("lang") == "es", S(-1).cast("bigint")).otherwise(src).alias("to_group"), C("doc_id").alias("ord"),
    )
    groups = t.documents.select(src.alias("group_id"), C("source").alias("case_id"), S("imaging_report").alias("type")).distinct()
    r = me.move_pages(rows, moves, groups, RULES, ["imaging_report", "medical_record", "letter"])
    return r.select("page_id", "moved", "type", "page_number", "subtype")


@query("d16_apply_review", f"""
SELECT doc_id AS page_id, CASE WHEN quality = 1 THEN 'completed' WHEN toxic = 1 THEN 'pending' WHEN quality = 0 THEN 'needs_review' ELSE 'pending' END AS review_status,
 CASE WHEN quality = 1 THEN CASE WHEN lang='en' THEN 50 ELSE greatest(n_chars % 100, 95) END ELSE n_chars % 100 END::BIGINT AS confidence, CASE WHEN quality = 1 THEN '人工核验通过' ELSE 'none' END AS notes, quality IS NOT NULL AND (quality = 1 OR toxic = 0) AS touched FROM {LABELLED}""")
def _(t):
    pages = t.documents.select(C("doc_id").alias("page_id"), C("doc_id"), S("").alias("reviewed"), S("pending").alias("review_status"), (C("n_chars") % 100).cast("int").alias("confidence"), S("none").alias("notes"))
    reviews = labelled(t).filter(C("quality").isNotNull()).select(
        C("doc_id").alias("page_id"), F.when(C("quality") == 1, "").when(C("toxic") == 1, "bad").otherwise("needs_review").alias("status"), S("x").alias("reviewed"),
        F.when((C("lang") == "en") & (C("quality") == 1), 50).alias("confidence"), NULL("string").alias("notes"),
    )
    p, touched = me.apply_review(pages, reviews)
    return p.join(touched.withColumn("touched", S(True)), "doc_id", "left").select("page_id", "review_status", "confidence", "notes", F.coalesce("touched", S(False)).alias("touched"))


def order_texts(t):
    """Line items as the recognised pages of an order, with labelled fields in their text."""
    l = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("part"), F.max("l_quantity").cast("int").alias("q"), F.max("l_shipdate").alias("d"), F.max("o_orderstatus").alias("s"), F.max("l_returnflag").alias("r")
    )
    return l.select(
        (C("l_orderkey") * 10 + C("l_linenumber")).alias("page_id"), C("l_orderkey").alias("group_id"), C("l_linenumber").alias("page_number"), C("part"), C("q"), C("d"), C("r"),
        S("completed").alias("status"), S("medical_record").alias("type"),
        F.when(C("l_linenumber") == 1, "medical_home_page").when(C("r") == "A", "admission_record").when(C("r") == "N", "discharge_record").otherwise("operation_record").alias("subtype"),
        F.when(C("r") == "A", text("| 主诉：痛", C("part"), " 现病史：伤", C("q"), "<br>入院诊断：骨折", C("part"), " 入院日期：", F.date_format("d", "yyyy年M月d日"), " 住院天数：", C("q"), "天"))
        .when(C("r") == "N", text("出院诊断：愈", C("part"), " 出院医嘱：休息", C("q"), "天 出院日期：", F.date_format("d", "yyyy-MM-dd"), " 8:05"))
        .otherwise(text("手术名称：术", C("part") % 3, " 术中所见：见", C("q"), " 手术日期：", F.date_format("d", "yyyy-MM"), "-01")).alias("text"),
    )


# The text columns the SQL twin reads from: one row per page of an order.
PG = "pg AS (SELECT l_orderkey g, l_linenumber n, max(l_partkey) part, max(l_quantity)::INT q, max(l_shipdate) d, max(l_returnflag) r FROM lineitem GROUP BY 1, 2)"


def order_groups(t):
    return t.orders.select(C("o_orderkey").alias("group_id"), C("o_custkey").alias("case_id"), S("medical_record").alias("type"), text("医院", C("o_custkey") % 7).alias("name"), S(1).alias("sort_order"), S(False).alias("is_confirmed"))


RECORD_COLS = ["number", "complaint", "history", "exam", "diagnosis_in", "treatment", "diagnosis_out", "orders", "date_in", "date_out"]


def order_records(t):
    d = t.orders.filter(C("o_orderstatus") == "F")
    return d.select(
        C("o_orderkey").alias("record_id"), C("o_custkey").alias("case_id"), C("o_orderkey").alias("group_id"), NULL("bigint").alias("page_id"), S("old").alias("org"),
        *[S("旧").alias(c) if c == "complaint" else NULL("string").alias(c) for c in RECORD_COLS], NULL("int").alias("days"),
        F.when(C("o_orderpriority") == "1-URGENT", "confirmed").otherwise("pending").alias("review_status"), S(50).alias("confidence"),
        F.when(C("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.array(S(fixed.FALLBACK_FLAG))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


@query("d17_fallback_records", f"""
WITH {PG},
a AS (SELECT g, arg_min(part, n) FILTER (WHERE r='A') part, arg_min(q, n) FILTER (WHERE r='A') q, arg_min(d, n) FILTER (WHERE r='A') din, arg_min(part, n) FILTER (WHERE r='N') po, arg_min(d, n) FILTER (WHERE r='N') dout,
  arg_min(g*10+n, CASE WHEN n = 1 THEN 0 WHEN r='A' THEN 1000 WHEN r='N' THEN 2000 ELSE 99000 END + n) src, max(n) last FROM pg GROUP BY 1),
o AS (SELECT *, o_orderstatus = 'F' has, o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' auto FROM orders),
j AS (SELECT o.*, a.*, (NOT has OR auto) AND a.g IS NOT NULL AND (din IS NOT NULL OR dout IS NOT NULL) made FROM o LEFT JOIN a ON a.g = o_orderkey)
SELECT o_orderkey AS group_id, CASE WHEN made THEN '医院' || (o_custkey % 7) ELSE 'old' END AS org, CASE WHEN made THEN '痛' || part ELSE '旧' END AS complaint, CASE WHEN made THEN '愈' || po END AS diagnosis_out,
 CASE WHEN made THEN strftime(din,'%Y-%m-%d') END AS date_in, CASE WHEN made THEN strftime(dout,'%Y-%m-%d') || ' 08:05' END AS date_out, CASE WHEN made THEN q END::BIGINT AS days, CASE WHEN made THEN 70 ELSE 50 END::BIGINT AS confidence,
 CASE WHEN made THEN src END AS page_id FROM j WHERE has OR made""")
def _(t):
    x = fact_tables(t)
    r = fa.fallback_records(x["groups"], x["pages"], stored(t, "plain_records", lambda: order_records(t)))
    return r.select("group_id", "org", "complaint", "diagnosis_out", "date_in", "date_out", "days", "confidence", "page_id")


@query("d18_delete_cascade", """
WITH k AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM k))
SELECT 'orders' AS t, count(*) AS n FROM o UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k))
UNION ALL SELECT 'undo', count(*) FROM orders WHERE o_orderpriority <> '5-LOW'""")
def _(t):
    keys = t.customer.filter(C("c_mktsegment") == "BUILDING").select(C("c_custkey").alias("case_id"))
    lines = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select("o_custkey", "l_partkey")
    out = me.delete_cascade({"orders": t.orders, "lines": lines}, keys, {"orders": "o_custkey", "lines": "o_custkey"})
    undone = me.undo_import(t.orders.select(text(C("o_orderkey")).alias("file_name")), t.orders.filter(C("o_orderpriority") == "5-LOW").select(text(C("o_orderkey")).alias("file_name")))
    n = lambda d, k: d.agg(F.count(S(1)).alias("n")).select(S(k).alias("t"), "n")
    return n(out["orders"], "orders").unionByName(n(out["lines"], "lines")).unionByName(n(undone, "undo"))


@query("d19_apply_text", f"""
WITH a AS (SELECT d.doc_id, lang, CASE WHEN quality = 1 THEN text ELSE NULL END t, text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), b AS (SELECT doc_id, t IS NOT NULL hit, {COMPACT} x FROM a)
SELECT doc_id AS page_id, CASE WHEN hit THEN 'completed' ELSE 'failed' END AS status, CASE WHEN hit THEN {subtype_sql('medical_record')} ELSE 'old' END AS subtype FROM b""")
def _(t):
    pages = t.documents.select(C("doc_id").alias("page_id"), S("bad").alias("text"), S("failed").alias("status"), S("medical_record").alias("type"), S("old").alias("subtype"))
    fixes = t.labels.filter(C("quality") == 1).join(t.documents, "doc_id").select(C("doc_id").alias("page_id"), C("text").alias("new_text"))
    return me.apply_text(pages, fixes, RULES).select("page_id", "status", "subtype")


def routed(t):
    p, k = C("o_orderpriority"), C("o_orderkey")
    kind = F.when(p == "1-URGENT", "entrustment_letter").when(p == "2-HIGH", "medical_record").when(p == "3-MEDIUM", "imaging_report").when(p == "4-NOT SPECIFIED", "appraisal_application").otherwise(F.when(C("o_orderstatus") == "P", "litigation_material").otherwise("id_card"))
    fields = (
        F.when(p == "1-URGENT", F.create_map(S("entrusting_unit"), text("unit", k), S("entrustment_matter"), F.when(C("o_orderstatus") == "F", text("req", k)), S("person_name"), S("null")))
        .when(p == "2-HIGH", F.create_map(S("number"), F.when(C("o_orderstatus") == "F", "N1").otherwise(""), S("complaint"), text("c", k), S("days"), F.when(C("o_totalprice") > 200000, "12").otherwise("x")))
        .when(p == "3-MEDIUM", F.create_map(S("exam_type"), S("CT"), S("film_count"), F.when(C("o_totalprice") > 200000, "3").otherwise("many")))
        .when(p == "4-NOT SPECIFIED", F.create_map(S("appraisal_items"), text("app", k), S("entrusting_unit"), S("")))
        .otherwise(F.create_map(S("name"), text("n", k), S("gender"), S("男")))
    )
    e = t.orders.select(C("o_orderkey").alias("page_id"), C("o_custkey").alias("case_id"), kind.alias("type"), C("o_orderkey").alias("ord"), NULL("bigint").alias("group_id"), F.when(C("o_orderstatus") == "O", "G").alias("group_name"), fields.alias("fields"))
    cases = t.customer.select(
        C("c_custkey").alias("case_id"), S("u0").alias("entrusting_unit"), F.when(C("c_nationkey") < 5, "r0").alias("request"), S("p0").alias("person_name"),
        F.when(C("c_nationkey") > 20, F.array(S("entrusting_unit"))).alias("confirmed_fields"),
    )
    persons = t.customer.filter(C("c_acctbal") > 5000).select(C("c_custkey").alias("case_id"), S("x").alias("name"), NULL("string").alias("gender"), F.array(S("name")).alias("confirmed_fields"))
    records = t.customer.filter(C("c_acctbal") > 0).select(C("c_custkey").alias("record_id"), C("c_custkey").alias("case_id"), NULL("bigint").alias("page_id"), NULL("bigint").alias("group_id"), S("H").alias("org"), S("N1").alias("number"), S("old").alias("complaint"), S(1).alias("days"))
    reports = t.orders.filter((p == "3-MEDIUM") & (C("o_orderstatus") == "F")).select((k + 7).alias("report_id"), C("o_custkey").alias("case_id"), k.alias("page_id"), NULL("bigint").alias("group_id"), S("H").alias("org"), S("DR").alias("exam_type"), S("leg").alias("exam_part"), S(9).alias("film_count"))
    return me.route_fields(e, {"cases": cases, "persons": persons, "records": records, "reports": reports})


@query("d20_route_cases", """
WITH c AS (SELECT o_custkey k, arg_max('unit' || o_orderkey, o_orderkey) FILTER (WHERE o_orderpriority='1-URGENT') u, arg_max('req' || o_orderkey, o_orderkey) FILTER (WHERE o_orderpriority='1-URGENT' AND o_orderstatus='F') r,
 arg_min('app' || o_orderkey, o_orderkey) FILTER (WHERE o_orderpriority='4-NOT SPECIFIED') a, arg_max('n' || o_orderkey, o_orderkey) FILTER (WHERE o_orderpriority='5-LOW' AND o_orderstatus <> 'P') p FROM orders GROUP BY 1)
SELECT c_custkey AS case_id, CASE WHEN c_nationkey > 20 THEN 'u0' ELSE COALESCE(u,'u0') END AS entrusting_unit, COALESCE(r, CASE WHEN c_nationkey < 5 THEN 'r0' ELSE a END) AS request, COALESCE(p,'p0') AS person_name FROM customer LEFT JOIN c ON k = c_custkey""")
def _(t):
    return routed(t)["cases"].select("case_id", "entrusting_unit", "request", "person_name")


@query("d20_route_persons", """
WITH p AS (SELECT o_custkey k, arg_max('n' || o_orderkey, o_orderkey) n FROM orders WHERE o_orderpriority='5-LOW' AND o_orderstatus <> 'P' GROUP BY 1)
SELECT COALESCE(c_custkey, k) AS case_id, CASE WHEN c_custkey IS NOT NULL THEN 'x' ELSE n END AS name, CASE WHEN k IS NOT NULL THEN '男' END AS gender FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN p ON k = c_custkey""")
def _(t):
    return routed(t)["persons"].select("case_id", "name", "gender")


@query("d20_route_records", """
WITH m AS (SELECT o_custkey c, CASE WHEN o_orderstatus='F' THEN 'N1' ELSE 'p' || o_orderkey END k, max(o_orderkey) o, max(CASE WHEN o_orderstatus='O' THEN 'G' END) g, max(CASE WHEN o_totalprice > 200000 THEN 12 END) d FROM orders WHERE o_orderpriority='2-HIGH' GROUP BY 1, 2),
r AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT c_custkey AS case_id, 'N1' AS number, COALESCE('c' || o, 'old') AS complaint, COALESCE(g,'H') AS org, COALESCE(d,1)::BIGINT AS days FROM r LEFT JOIN m ON c = c_custkey AND k = 'N1'
UNION ALL SELECT c, CASE WHEN k = 'N1' THEN 'N1' END, 'c' || o, g, d::BIGINT FROM m WHERE NOT (k = 'N1' AND c IN (SELECT c_custkey FROM r))""")
def _(t):
    return routed(t)["records"].select("case_id", "number", "complaint", "org", "days")


@query("d20_route_reports", """
SELECT o_orderkey AS page_id, CASE WHEN o_orderstatus='F' THEN 'leg' END AS exam_part, 'CT' AS exam_type, CASE WHEN o_orderstatus='O' THEN 'G' WHEN o_orderstatus='F' THEN 'H' END AS org, CASE WHEN o_totalprice > 200000 THEN 3 ELSE 1 END::BIGINT AS film_count FROM orders WHERE o_orderpriority='3-MEDIUM'""")
def _(t):
    return routed(t)["reports"].select("page_id", "exam_part", "exam_type", "org", "film_count")


@query("d20_route_outcome", "SELECT CASE WHEN o_orderpriority='5-LOW' AND o_orderstatus='P' THEN 'skipped' ELSE 'completed' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return routed(t)["outcome"].groupBy("outcome").agg(F.count(S(1)).alias("n"))


@query("d21_group_records", """
SELECT o_orderkey AS group_id, '医院' || (o_custkey % 7) AS org, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 100000 THEN 'c' || o_orderkey ELSE '旧' END ELSE CASE WHEN o_totalprice > 100000 THEN 'c' || o_orderkey END END AS complaint,
 CASE WHEN o_orderkey % 2 = 0 THEN 12 END::BIGINT AS days FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey, 'old', '旧', NULL FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'""")
def _(t):
    e = t.orders.filter(C("o_orderpriority") != "5-LOW").select(
        C("o_custkey").alias("case_id"), C("o_orderkey").alias("group_id"),
        F.create_map(S("org"), S("said"), S("complaint"), F.when(C("o_totalprice") > 100000, text("c", C("o_orderkey"))).otherwise("null"), S("days"), F.when(C("o_orderkey") % 2 == 0, "12").otherwise("about")).alias("fields"),
    )
    return me.apply_group_records(order_groups(t), e, order_records(t)).select("group_id", "org", "complaint", "days")


# --- the fact table ----------------------------------------------------------


_STORED: dict[tuple, str] = {}


def stored(t, name, make):
    """A table rendered from the given ones, written once to the shared folder and read back,
    as the tables of a case base are."""
    key = (t.spark.sparkContext.applicationId, t.path, name)
    if key not in _STORED:
        _STORED[key] = work_table(t, make(), name)
    return t.spark.read.parquet(_STORED[key])


class FactTables(Mapping):
    """The tables of a case base by name; a table is rendered and stored when it is first read."""

    NAMES = ("groups", "pages", "events", "reports", "records", "facts", "cases")

    def __init__(self, t):
        self.t, self.made = t, {}

    def _make(self, name):
        if not self.made:
            self.made = render_fact_tables(self.t)
        return self.made[name]

    def __getitem__(self, name):
        return stored(self.t, name, lambda: self._make(name))

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self):
        return len(self.NAMES)


def fact_tables(t):
    return FactTables(t)


def render_fact_tables(t):
    """Orders as groups and records, line items as pages, events and reports."""
    pages = order_texts(t).drop("part", "q", "d", "r")
    case = t.orders.select(C("o_orderkey").alias("group_id"), C("o_custkey").alias("case_id"))
    pages = pages.join(case, "group_id").withColumn("file_name", text("p", C("page_id")))
    l = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    l = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("o_custkey").alias("c"), F.max("l_partkey").alias("part"), F.max("l_quantity").cast("int").alias("q"), F.max("l_shipdate").alias("d"), F.max("l_returnflag").alias("r"))
    ident = (C("l_orderkey") * 10 + C("l_linenumber")).alias("id")
    l = l.withColumn("id", C("l_orderkey") * 10 + C("l_linenumber"))
    words = F.when(C("part") % 3 == 0, "肋骨骨折").when(C("part") % 3 == 1, "胫骨骨折").otherwise("常规")
    events = l.filter(C("r") == "A").select(
        C("id").alias("event_id"), C("c").alias("case_id"), C("l_orderkey").alias("group_id"), NULL("bigint").alias("record_id"), S("乙").alias("org"),
        F.when(C("q") > 25, "exam").otherwise("progress").alias("type"), F.date_format("d", "yyyy-MM-dd").alias("date"), F.when(C("q") > 10, text("事", C("q"))).alias("title"), words.alias("summary"), NULL("string").alias("diagnosis"), NULL("string").alias("findings"),
        NULL("string").alias("treatment"), S("").alias("quote"), F.array("id").alias("source_ids"), NULL("array<int>").alias("source_pages"), S("pending").alias("review_status"), S(60).alias("confidence"), F.array(S("manual")).alias("flags"),
    )
    reports = l.filter(C("r") == "R").select(
        C("id").alias("report_id"), C("c").alias("case_id"), C("l_orderkey").alias("group_id"), C("id").alias("page_id"), S("丙").alias("org"), F.date_format("d", "yyyy-MM-dd").alias("date"), NULL("string").alias("datetime"),
        F.when(C("q") > 25, "CT").otherwise("").alias("exam_type"), NULL("string").alias("exam_part"), F.when(C("q") > 40, text("X", C("q"))).alias("film_no"), S(1).alias("film_count"), words.alias("content"),
        F.when(C("q") > 45, "excluded").otherwise("pending").alias("review_status"), F.array().cast("array<string>").alias("flags"), NULL("array<bigint>").alias("source_ids"), NULL("array<int>").alias("source_pages"),
    )
    records = order_records(t).withColumn("date_in", S("2024-01-02"))
    facts = t.orders.filter(C("o_orderpriority") == "3-MEDIUM").select(
        C("o_orderkey").alias("fact_id"), C("o_custkey").alias("case_id"), text("hospital_record:", C("o_orderkey")).alias("fact_key"),
        F.when(C("o_orderstatus") == "P", "clinical_exam").otherwise("hospital_record").alias("fact_type"), S("admission").alias("fact_role"), S("").alias("fact_date"), S("").alias("org"), S("t").alias("title"), S("旧事").alias("summary"), S("").alias("quote"),
        S("hospital_record").alias("source_kind"), C("o_orderkey").alias("source_id"), F.array().cast("array<bigint>").alias("source_ids"), F.array().cast("array<int>").alias("source_pages"), S("confirmed").alias("review_status"), S("excluded").alias("importance"),
        S(1).alias("confidence"), F.array().cast("array<string>").alias("flags"), S("note").alias("review_note"),
    )
    return {"groups": order_groups(t), "pages": pages, "events": events, "reports": reports, "records": records, "facts": facts, "cases": t.customer.select(C("c_custkey").alias("case_id"))}


WORDS = "CASE WHEN part % 3 = 0 THEN '肋骨骨折' WHEN part % 3 = 1 THEN '胫骨骨折' ELSE '常规' END"


@query("u01_build_facts", f"""
WITH {PG}, p AS (SELECT pg.*, o_custkey c, o_orderstatus s FROM pg JOIN orders ON g = o_orderkey)
SELECT 'hospital_record:' || o_orderkey AS fact_key, o_custkey AS case_id, 'admission' AS fact_role, '2024-01-02' AS fact_date, '医院' || (o_custkey % 7) AS org, '医院' || (o_custkey % 7) || '入院及住院病历' AS title, 'core' AS importance,
 COALESCE((SELECT string_agg(n::VARCHAR, ',' ORDER BY n) FROM pg WHERE g = o_orderkey),'') AS pages, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'rule_fallback_from_ocr' ELSE '' END AS flags FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'medical_event:' || (g*10+n), c, CASE WHEN q > 25 THEN 'exam' ELSE 'progress' END, strftime(d,'%Y-%m-%d'), '医院' || (c % 7), CASE WHEN q > 10 THEN '事' || q ELSE CASE WHEN q > 25 THEN '检查' ELSE '病程' END END,
 CASE WHEN q > 25 OR part % 3 < 2 THEN 'core' ELSE 'supporting' END, n::VARCHAR, 'manual' FROM p WHERE r = 'A'
UNION ALL SELECT 'imaging_report:' || (g*10+n), c, 'imaging', strftime(d,'%Y-%m-%d'), '医院' || (c % 7), CASE WHEN part % 3 = 0 THEN '肋骨' WHEN part % 3 = 1 THEN '胫腓骨' ELSE CASE WHEN q > 25 THEN 'CT' ELSE '检查报告' END END || CASE WHEN part % 3 < 2 AND q > 25 THEN 'CT' ELSE '' END,
 CASE WHEN q > 45 THEN 'excluded' WHEN part % 3 < 2 THEN 'core' ELSE 'supporting' END, n::VARCHAR, CASE WHEN part % 3 < 2 THEN '' ELSE 'generic_exam_part' END FROM p WHERE r = 'R'""")
def _(t):
    x = fact_tables(t)
    d = fa.build_facts(x["records"], x["events"], x["reports"], x["pages"], x["groups"])
    return d.select("fact_key", "case_id", "fact_role", "fact_date", "org", "title", "importance", joined(C("source_pages")).alias("pages"), joined(C("flags"), "|").alias("flags"))


@query("g03_rule_tables", "SELECT doc_id, CASE WHEN contains(text,'token') THEN 'MACHINERY' WHEN contains(text,'lich') THEN 'BUILDING' END AS subtype FROM documents WHERE contains(text,'token') OR contains(text,'lich')")
def _(t):
    from caseweave.plans.specs import first_rule

    rules = t.customer.select(C("c_mktsegment").alias("name")).distinct().select(
        F.when(C("name") == "MACHINERY", 1).otherwise(2).alias("priority"), "name",
        F.when(C("name") == "MACHINERY", F.array(S("token"), S("zzzz"))).when(C("name") == "BUILDING", F.array(S("lich"))).otherwise(F.array(S("\u0001none"))).alias("keywords"),
    )
    return first_rule(t.documents, "doc_id", "text", rules).select("doc_id", C("name").alias("subtype"))


@query("g04_propose_events", f"""
WITH {PG}, h AS (SELECT g, bool_or(r='A' AND n > 1) adm FROM pg GROUP BY 1),
ap AS (SELECT pg.*, adm FROM pg JOIN h USING (g) WHERE CASE WHEN adm THEN r='A' AND n > 1 ELSE n = 1 END),
a AS (SELECT g, string_agg((g*10+n)::VARCHAR, ',' ORDER BY n) ids, arg_min(part, n) FILTER (WHERE r='A') part, arg_min(d, n) FILTER (WHERE r='A') d FROM ap GROUP BY 1),
b AS (SELECT g, string_agg((g*10+n)::VARCHAR, ',' ORDER BY n) ids, arg_min(part, n) part, arg_min(d, n) d FROM pg WHERE r='N' AND n > 1 GROUP BY 1)
SELECT o_orderkey AS group_id, 'admission' AS type, CASE WHEN o_orderstatus='F' THEN '2024-01-02' ELSE strftime(d,'%Y-%m-%d') END AS date, ids, CASE WHEN o_orderstatus='F' THEN NULL ELSE '骨折' || part END AS diagnosis FROM a JOIN orders ON g = o_orderkey WHERE o_orderstatus='F' OR part IS NOT NULL
UNION ALL SELECT o_orderkey, 'discharge', strftime(d,'%Y-%m-%d') || ' 08:05', ids, CASE WHEN o_orderstatus='F' THEN NULL ELSE '愈' || part END FROM b JOIN orders ON g = o_orderkey""")
def _(t):
    x = fact_tables(t)
    d = fa.propose_events(x["groups"], x["pages"], x["records"])
    return d.filter(C("type").isin("admission", "discharge")).select("group_id", "type", "date", joined(C("source_ids")).alias("ids"), "diagnosis")


@query("g04_surgery_events")
def _(t):
    x = fact_tables(t)
    return fa.propose_events(x["groups"], x["pages"], x["records"]).filter(C("type") == "surgery").select("group_id", "title", "date", joined(C("source_ids")).alias("ids"), "confidence", joined(C("flags"), "|").alias("flags"))


@query("g05_build_fact_library")
def _(t):
    out = fa.build_fact_library(fact_tables(t))
    return out["counts"].select("case_id", "total", "confirmed", "system_verified", "pending", "core", "supporting")


@query("g08_facts_or_sync")
def _(t):
    return fa.facts_or_sync(fact_tables(t)).groupBy("fact_type", "review_status").agg(F.count(S(1)).alias("n"))
