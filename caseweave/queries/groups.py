"""A01-A22, W01-W14, O01-O06 and U02-U04 over the given tables."""
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions import extract as ex
from caseweave.functions import predicates as pr
from caseweave.functions.classify import PREDICTION
from caseweave.functions.text import strip
from caseweave.operators import aggregates as ag
from caseweave.operators import ordering as od
from caseweave.operators import sequence as sq
from caseweave.operators import sets as st
from caseweave.operators import windows as wi
from caseweave.operators.split import char_budget, text_parts
from caseweave.queries.predicates import any_of
from caseweave.queries.registry import query

C = F.col
S = lambda x: F.lit(x)


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def joined(c, sep=","):
    return F.array_join(c.cast("array<string>"), sep)


LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(t):
    return t.documents.join(t.labels, "doc_id", "left")


# --- aggregations ------------------------------------------------------------


@query("a01_status_counts", "SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus='O') AS \"O\", count(*) FILTER (WHERE o_orderstatus='F') AS \"F\", count(*) FILTER (WHERE o_orderstatus='P') AS \"P\" FROM orders GROUP BY 1")
def _(t):
    return ag.status_counts(t.orders, ["o_custkey"], ["O", "F", "P"], "o_orderstatus")


REVIEW = "CASE quality WHEN 1 THEN 'confirmed' WHEN 0 THEN CASE toxic WHEN 1 THEN 'excluded' ELSE 'system_verified' END END"


def review():
    return F.when(C("quality") == 1, "confirmed").when(C("toxic") == 1, "excluded").when(C("quality") == 0, "system_verified")


@query("a02_fact_counts", f"""
WITH a AS (SELECT source, {REVIEW} s, CASE WHEN lang = 'en' THEN 'core' WHEN lang = 'fr' THEN 'supporting' ELSE 'excluded' END i FROM {LABELLED})
SELECT source, count(*) AS total, count(*) FILTER (WHERE s='confirmed') AS confirmed, count(*) FILTER (WHERE s='system_verified') AS system_verified, count(*) FILTER (WHERE s IS NULL) AS pending,
 0::BIGINT AS needs_edit, count(*) FILTER (WHERE s='excluded') AS excluded, count(*) FILTER (WHERE i='core') AS core, count(*) FILTER (WHERE i='supporting') AS supporting FROM a GROUP BY 1""")
def _(t):
    d = labelled(t).select("source", review().alias("review_status"), F.when(C("lang") == "en", "core").when(C("lang") == "fr", "supporting").otherwise("excluded").alias("importance"))
    return ag.fact_counts(d, ["source"])


@query("a03_doc_progress", f"""
WITH a AS (SELECT source, CASE WHEN n_chars > 1000 THEN 'completed' WHEN n_chars > 300 THEN 'failed' ELSE 'pending' END s, CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'needs_review' ELSE 'pending' END r FROM {LABELLED})
SELECT 'src' || i AS doc_id, count(s) AS page_rows, count(*) FILTER (WHERE s='completed') AS completed, 0::BIGINT AS processing, count(*) FILTER (WHERE s='failed') AS failed, count(*) FILTER (WHERE s='pending') AS pending,
 count(*) FILTER (WHERE r='completed') AS proofread_completed, 0::BIGINT AS proofread_processing, 0::BIGINT AS proofread_failed, count(*) FILTER (WHERE r='pending') AS proofread_pending, count(*) FILTER (WHERE r='needs_review') AS proofread_needs_review
FROM (SELECT n_nationkey i FROM nation) LEFT JOIN a ON source = 'src' || i GROUP BY 1""")
def _(t):
    pages = labelled(t).select(
        C("source").alias("doc_id"), F.when(C("n_chars") > 1000, "completed").when(C("n_chars") > 300, "failed").otherwise("pending").alias("status"),
        F.when(C("quality") == 1, "completed").when(C("quality") == 0, "needs_review").when(C("lang") == "fr", "").alias("review_status"),
    )
    return ag.doc_progress(t.nation.select(text("src", C("n_nationkey")).alias("doc_id")), pages)


@query("a04_protection", f"""
WITH p AS (SELECT source s, count(*) n, count(*) FILTER (WHERE n_chars > 20000) c, count(*) FILTER (WHERE toxic = 1) r, count(*) FILTER (WHERE quality = 0 AND lang='es') f FROM {LABELLED} GROUP BY 1),
b AS (SELECT 'src' || (item_id // 8) s, count(*) n FROM benchmark GROUP BY 1)
SELECT p.s AS doc_id, p.n AS page_count, p.c AS ocr_completed, p.r AS proofread_count, p.f AS proofread_confirmed, COALESCE(b.n,0) AS chunk_count, (p.c + p.r + p.f + COALESCE(b.n,0)) > 0 AS protected FROM p LEFT JOIN b ON p.s = b.s""")
def _(t):
    pages = labelled(t).select(
        C("source").alias("doc_id"), F.when(C("n_chars") > 20000, "completed").otherwise("pending").alias("status"), F.when(C("toxic") == 1, "x").otherwise("").alias("reviewed"),
        F.when((C("quality") == 0) & (C("lang") == "es"), "needs_review").alias("review_status"),
    )
    chunks = t.benchmark.select(text("src", F.floor(C("item_id") / 8)).alias("doc_id"))
    return ag.protection(t.documents.select(C("source").alias("doc_id")).distinct(), pages, chunks)


@query("a05_edit_stats", "SELECT CASE event_type WHEN 'click' THEN 'Clicks' ELSE 'Views' END AS section, count(*) AS n FROM events WHERE event_type IN ('click','view') GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events")
def _(t):
    return ag.edit_stats(t.events.select(C("event_type").alias("section")), {"click": "Clicks", "view": "Views", "none": "None"})


@query("a06_dashboard", """
SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM orders UNION ALL SELECT 'draft', count(*) FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'latest', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8)""")
def _(t):
    counts, newest = ag.dashboard(t.orders.select(C("o_orderkey").alias("case_id"), C("o_orderstatus").alias("status"), C("o_orderdate").alias("created_at")), done="F")
    return counts.unionByName(newest.select(S("latest").alias("status"), C("case_id").alias("n")))


@query("a07_queue_counts", """
SELECT s AS status, count(l.doc_id) AS n FROM (VALUES ('pending'),('completed'),('needs_review'),('failed')) v(s) LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'completed' WHEN toxic = 1 THEN 'needs_review' ELSE 'pending' END r FROM labels) l ON r = s GROUP BY 1""")
def _(t):
    d = t.labels.select(F.when(C("quality") == 1, "completed").when(C("toxic") == 1, "needs_review").alias("review_status"))
    return ag.queue_counts(d, ["pending", "completed", "needs_review", "failed"])


@query("a08_run_summary", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus='F') AS succeeded, count(*) FILTER (WHERE o_orderstatus='P') AS skipped, count(*) FILTER (WHERE o_orderstatus='O') AS failed FROM orders GROUP BY 1")
def _(t):
    d = t.orders.select("o_orderpriority", F.when(C("o_orderstatus") == "F", "completed").when(C("o_orderstatus") == "P", "skipped").otherwise("failed").alias("status"))
    return ag.run_summary(d, ["o_orderpriority"])


@query("a09_concat_group_text", """
WITH a AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) i FROM documents WHERE lang <> 'de'),
b AS (SELECT source, trim(string_agg(chr(10)||chr(10)||'===== 第'||i||'页 ('||'d'||doc_id||') ====='||chr(10)||text, '' ORDER BY i), '@WC@') x FROM a GROUP BY 1)
SELECT source, length(x) > 12000 AS truncated, md5(CASE WHEN length(x) > 12000 THEN substring(x,1,12000)||chr(10)||chr(10)||'[... 文本过长，已截断 ...]' ELSE x END) AS digest FROM b""")
def _(t):
    pages = t.documents.select(C("source").alias("group_id"), C("doc_id").alias("page_number"), C("doc_id").alias("page_id"), "text", F.when(C("lang") != "de", "completed").otherwise("failed").alias("status"), text("d", C("doc_id")).alias("file_name"))
    return ag.concat_group_text(pages).select(C("group_id").alias("source"), "truncated", F.md5("text").alias("digest"))


@query("a10_case_terms", f"""
WITH a AS (SELECT source, lang, unnest(list_filter([{', '.join(f"CASE WHEN contains(text,'{w}') THEN '{w}' END" for w in ('tion', 'ment', 'lich', 'ción', 'token'))}], lambda k: k IS NOT NULL)) term FROM documents)
SELECT source, lang, string_agg(DISTINCT term, '|' ORDER BY term) AS terms FROM a GROUP BY 1, 2""")
def _(t):
    return ag.case_terms(t.documents, ["source", "lang"], pr.matched_keywords(C("text"), ["tion", "ment", "lich", "ción", "token"])).select("source", "lang", joined(C("terms"), "|").alias("terms"))


@query("a11_ordered_distinct", """
WITH a AS (SELECT user_id, event_type, min(event_id) o FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, '、' ORDER BY o) AS visited FROM a GROUP BY 1""")
def _(t):
    d = ag.ordered_distinct(t.events, "user_id", "event_type", C("event_id"), ["error"])
    return text_parts(d, ["user_id"], [C("ord")], F.floor(C("ord") / 100_000), C("event_type"), "、").select("user_id", C("text").alias("visited"))


NUM = "COALESCE(['零','壹','贰','叁','肆','伍','陆','柒','捌','玖','拾'][{0} + 1], {0}::VARCHAR)"


@query("a12_material_list", f"""
WITH l AS (SELECT o_custkey k, l_orderkey, l_returnflag, l_linestatus, l_quantity, l_linenumber, o_orderpriority p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fl AS (SELECT k, bool_or(l_returnflag='A') a, bool_or(l_returnflag='N') n, bool_or(l_returnflag='R') r FROM l GROUP BY 1),
st AS (SELECT o_custkey k, 'H' || o_orderpriority org, count(*) n, min(o_orderkey) ord FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
ek AS (SELECT k, 'H' || p org, l_linestatus kind, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber END)::BIGINT n, min(l_orderkey) ord FROM l WHERE l_quantity > 40 GROUP BY 1, 2, 3),
ex AS (SELECT k, org, string_agg(kind || {NUM.format('n')} || '张', '、' ORDER BY ord, kind || {NUM.format('n')} || '张') s, min(ord) ord FROM ek GROUP BY 1, 2),
it AS (SELECT k, 2 rank, 0::BIGINT ord, c_name || '居民身份证复印件壹份' item FROM fl JOIN customer ON c_custkey = k WHERE n
 UNION ALL SELECT k, 4, 0, '民事起诉状、鉴定申请书复印件各壹份' FROM fl WHERE a AND r UNION ALL SELECT k, 4, 0, '鉴定申请书复印件壹份' FROM fl WHERE a AND NOT r UNION ALL SELECT k, 4, 0, '民事起诉状复印件壹份' FROM fl WHERE r AND NOT a
 UNION ALL SELECT st.k, 6, ord, org || '住院病历复印件' || {NUM.format('st.n')} || '份' FROM st JOIN fl ON fl.k = st.k UNION ALL SELECT ex.k, 7, ord, org || s FROM ex)
SELECT k AS case_id, row_number() OVER (PARTITION BY k ORDER BY rank, ord, item) AS no, row_number() OVER (PARTITION BY k ORDER BY rank, ord, item) || '. ' || item AS item FROM it""")
def _(t):
    l = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    pages = l.select(
        C("o_custkey").alias("case_id"), F.when(C("l_returnflag") == "A", "appraisal_application").when(C("l_returnflag") == "N", "id_card").otherwise("litigation_material").alias("type"),
        S("民事起诉状").alias("description"), S("").alias("file_name"), F.lit(None).cast("string").alias("text"),
    )
    records = t.orders.filter(C("o_orderstatus") == "F").select(C("o_custkey").alias("case_id"), C("o_orderkey").alias("record_id"), text("H", C("o_orderpriority")).alias("org"))
    reports = l.filter(C("l_quantity") > 40).select(
        C("o_custkey").alias("case_id"), C("l_orderkey").alias("report_id"), text("H", C("o_orderpriority")).alias("org"), C("l_linestatus").alias("exam_type"),
        F.when(C("l_linenumber") == 1, 0).otherwise(C("l_linenumber")).alias("film_count"),
    )
    cases = t.customer.select(C("c_custkey").alias("case_id"), C("c_name").alias("person_name"))
    return ag.material_list(cases, pages, records, reports)


@query("a13_diagnosis_list", """
WITH r AS (SELECT source, doc_id, trim(trim(x, '@WC@'), ' ，,、') piece, pos FROM (SELECT source, doc_id, unnest(l) x, unnest(range(0, len(l))) pos FROM
  (SELECT source, doc_id, regexp_split_to_array(source || ' 甲；' || lang || chr(10) || text, '[；;。\\n]+') l FROM documents WHERE source < 'src2'))),
d AS (SELECT source, piece, min((doc_id, pos)) p0 FROM r WHERE piece <> '' GROUP BY 1, 2),
e AS (SELECT source, trim(text,'@WC@') piece, min((doc_id, 0::BIGINT)) p0 FROM documents WHERE source >= 'src2' GROUP BY 1, 2),
n AS (SELECT source, piece, row_number() OVER (PARTITION BY source ORDER BY p0) rn FROM (SELECT * FROM d UNION ALL SELECT * FROM e))
SELECT source, md5(string_agg(piece, '、' ORDER BY rn)) AS digest FROM n WHERE rn <= 8 GROUP BY 1""")
def _(t):
    records = t.documents.filter(C("source") < "src2").select(C("source").alias("case_id"), C("doc_id").alias("record_id"), text(C("source"), " 甲；", C("lang")).alias("diagnosis_out"), C("text").alias("diagnosis_in"))
    evidence = t.documents.select(C("source").alias("case_id"), C("text").alias("summary"), C("doc_id").alias("ord"))
    return ag.diagnosis_list(records, evidence).select(C("case_id").alias("source"), F.md5("diagnoses").alias("digest"))


@query("a14_merge_records", """
SELECT l_orderkey, count(*) AS n_merged, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) FILTER (WHERE l_returnflag = 'A') AS part, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_partkey)) FILTER (WHERE l_quantity > 25) AS state FROM lineitem GROUP BY 1""")
def _(t):
    d = t.lineitem.select(
        "l_orderkey", F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("ord"), F.when(C("l_returnflag") == "A", C("l_partkey")).alias("part"),
        F.when(C("l_quantity") > 25, C("l_linestatus")).when(C("l_quantity") > 10, "null").otherwise("").alias("state"),
    )
    r = ag.merge_records(d, ["l_orderkey"], C("ord"), ["part", "state"])
    return r.select("l_orderkey", "n_merged", "part", F.when(~C("state").isin("null", ""), C("state")).alias("state"))


TERMS = ["tion", "inha", "zzzz", "eron"]


@query("a15_term_weights", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{w}' term, count(*) FILTER (WHERE contains(lower(text),'{w}')) df FROM benchmark" for w in TERMS) + ") SELECT term, df, round(CASE WHEN df = 0 THEN 0.5 ELSE greatest(1.0/(df+1), 0.3) END::DOUBLE, 6) AS weight FROM c")
def _(t):
    return ag.term_weights(t.benchmark, TERMS).withColumn("weight", F.round("weight", 6))


@query("a16_case_warnings", """
WITH f AS (SELECT l_orderkey k, count(*) n, count(*) FILTER (WHERE l_returnflag='N') e, count(*) FILTER (WHERE l_returnflag='R') i FROM lineitem WHERE l_linestatus='F' GROUP BY 1),
c AS (SELECT l_orderkey k, count(*) FILTER (WHERE l_quantity > 48) met, 2*count(*) FILTER (WHERE l_returnflag='A') p, count(*) n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS case_id, concat_ws('|', CASE WHEN o_orderpriority='5-LOW' THEN '委托事项为空，分析说明无法判断哪些损伤应进入正式结论。' END,
 CASE WHEN f.n > 0 AND e = 0 THEN '统一事实库中缺少病历事件型事实，建议先建立或确认病历事实。' END, CASE WHEN f.n > 0 AND i = 0 THEN '统一事实库中缺少检查事实，影像依据不足。' END,
 CASE WHEN f.n IS NULL AND c.n IS NULL THEN '尚无病历事件型事实，分析说明只能依赖病历汇总字段，来源页精度会降低。' END, CASE WHEN f.n IS NULL AND o_orderstatus <> 'F' THEN '尚无检查事实，影像依据不足。' END,
 CASE WHEN COALESCE(met,0) = 0 THEN '未形成 decision=met 的伤残候选，正式伤残结论需人工核对。' END, CASE WHEN COALESCE(p,0) > 0 THEN '有 ' || p || ' 条候选来源事实尚未人工确认。' END) AS warnings
FROM orders LEFT JOIN f ON f.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey""")
def _(t):
    k = C("l_orderkey").alias("case_id")
    cases = t.orders.select(C("o_orderkey").alias("case_id"), F.when(C("o_orderpriority") != "5-LOW", "r").alias("request"))
    facts = t.lineitem.filter(C("l_linestatus") == "F").select(k, F.when(C("l_returnflag") == "N", "medical_event").when(C("l_returnflag") == "R", "imaging_report").otherwise("hospital_record").alias("fact_type"))
    reports = t.orders.filter(C("o_orderstatus") == "F").select(C("o_orderkey").alias("case_id"))
    state = F.when(C("l_returnflag") == "A", "pending")
    cands = t.lineitem.select(k, F.when(C("l_quantity") > 48, "met").otherwise("uncertain").alias("decision"), F.array(F.struct(state.alias("review_status")), F.struct(state.alias("review_status")), F.struct(S("confirmed").alias("review_status"))).alias("evidence"))
    return ag.case_warnings(cases, facts, t.lineitem.select(k), reports, cands).select("case_id", joined(C("warnings"), "|").alias("warnings"))


@query("a17_docs_with_text", "SELECT DISTINCT source AS doc_id FROM documents WHERE lang = 'es' AND text IS NOT NULL")
def _(t):
    return ag.docs_with_text(t.documents.select(C("source").alias("doc_id"), "text", F.when(C("lang") == "es", "completed").otherwise("failed").alias("status")))


@query("a18_usage_totals", "SELECT role AS task, count(*) AS attempts, CAST(sum(turn) AS BIGINT) AS prompt_tokens, CAST(COALESCE(sum(CASE WHEN turn > 2 THEN length(text) END),0) AS BIGINT) AS completion_tokens, CAST(sum(length(text)) AS BIGINT) AS total_tokens FROM conversations GROUP BY 1")
def _(t):
    return ag.usage_totals(t.conversations.select(C("role").alias("task"), C("turn").alias("prompt_tokens"), F.when(C("turn") > 2, F.length("text")).alias("completion_tokens"), F.length("text").alias("total_tokens")))


@query("a19_case_query", """
WITH p AS (SELECT source, 0 r, 0::BIGINT o, 'query of ' || source v FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT source, 1, doc_id, text FROM documents),
a AS (SELECT source, string_agg(v, chr(10) ORDER BY r, o) x FROM p GROUP BY 1)
SELECT source, md5(substring(trim(x, ' ' || chr(10) || chr(9)),1,6000)) AS digest FROM a""")
def _(t):
    head = t.documents.select("source").distinct().select(C("source").alias("case_id"), S(0).alias("rank"), F.lit(0).cast("bigint").alias("ord"), S(0).alias("pos"), text("query of ", C("source")).alias("value"))
    body = t.documents.select(C("source").alias("case_id"), S(1).alias("rank"), C("doc_id").alias("ord"), S(0).alias("pos"), C("text").alias("value"))
    return ag.case_query(head.unionByName(body)).select(C("case_id").alias("source"), F.md5("query").alias("digest"))


@query("a20_toc", """
WITH a AS (SELECT item_id // 8 d, item_id, item_id::VARCHAR c, trim(regexp_replace(substring(text,1,200),'@WS@+',' ','g'),'@WC@') p, row_number() OVER (PARTITION BY item_id // 8 ORDER BY item_id) - 1 rn FROM benchmark)
SELECT d AS doc_id, rn // 3 AS part, md5(string_agg(c || ':' || p, '|' ORDER BY item_id)) AS digest FROM a GROUP BY 1, 2""")
def _(t):
    chunks = t.benchmark.select(F.floor(C("item_id") / 8).alias("doc_id"), C("item_id").alias("chunk_id"), C("item_id").cast("string").alias("code"), F.lit(None).cast("string").alias("title"), "text")
    r = ag.toc(chunks, chunks.select("doc_id"), size=3)
    return r.select("doc_id", "part", F.md5(F.array_join(F.transform("sections", lambda s: F.concat(s["code"], S(":"), s["preview"])), "|")).alias("digest"))


@query("a21_review_run", f"""
WITH a AS (SELECT source, CASE WHEN quality = 1 THEN 'completed' WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'needs_review' END s, n_chars n FROM {LABELLED}),
b AS (SELECT *, s IS NULL OR s = 'failed' tg FROM a)
SELECT source AS doc_id, count(*) AS total_pages, count(*) FILTER (WHERE tg) AS target_pages, count(*) FILTER (WHERE tg AND n > 1000) AS completed, count(*) FILTER (WHERE tg AND n BETWEEN 301 AND 1000) AS needs_review,
 count(*) FILTER (WHERE tg AND n <= 300) AS failed, count(*) FILTER (WHERE NOT tg) AS skipped FROM b GROUP BY 1""")
def _(t):
    pages = labelled(t).select(
        C("source").alias("doc_id"), C("doc_id").alias("page_id"), "text", S("completed").alias("status"),
        F.when(C("quality") == 1, "completed").when(C("toxic") == 1, "failed").when(C("quality") == 0, "needs_review").when(C("lang") == "fr", "").alias("review_status"),
    )
    out = t.documents.select(C("doc_id").alias("page_id"), F.when(C("n_chars") > 1000, "completed").when(C("n_chars") > 300, "needs_review").otherwise("failed").alias("status"))
    return ag.review_run(ag.review_targets(pages), out)


@query("a22_recognition_status", """
SELECT o_orderkey AS case_id, o_orderstatus AS status, count(l_orderkey) AS total, count(*) FILTER (WHERE l_returnflag='A') AS pending, 0::BIGINT AS processing, count(*) FILTER (WHERE l_returnflag='N') AS completed, count(*) FILTER (WHERE l_returnflag='R') AS failed,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'running' END AS task FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority""")
def _(t):
    cases = t.orders.select(C("o_orderkey").alias("case_id"), C("o_orderstatus").alias("status"))
    pages = t.lineitem.select(C("l_orderkey").alias("case_id"), F.when(C("l_returnflag") == "A", "pending").when(C("l_returnflag") == "N", "completed").otherwise("failed").alias("status"))
    tasks = t.orders.filter(C("o_orderpriority") == "1-URGENT").select(C("o_orderkey").alias("case_id"), S("running").alias("task"))
    return ag.recognition_status(cases, pages, tasks)


# --- windows -----------------------------------------------------------------


@query("w01_renumber", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS page_number FROM documents")
def _(t):
    return wi.renumber(t.documents, ["source"], [C("n_chars"), C("doc_id")], F.floor(C("n_chars") / 500)).select("doc_id", "page_number")


ROLE_TYPE = {"user": "medical_record", "assistant": "imaging_report", "system": "entrustment_letter"}


def conversation_pages(t):
    """Turns as pages: the role is the predicted type."""
    role = C("role")
    kind = F.when(role == "user", ROLE_TYPE["user"]).when(role == "assistant", ROLE_TYPE["assistant"]).otherwise(ROLE_TYPE["system"])
    p = F.struct(
        kind.alias("type"), F.lit(None).cast("string").alias("subtype"), F.when(F.length("text") > 300, text("org", C("turn"))).alias("group"),
        F.when(F.length("text") % 3 == 0, 0.5).otherwise(0.9).alias("confidence"), S("").alias("reason"), pr.matched_keywords(C("text"), ["ment", "tion"]).alias("keywords"),
        F.contains("text", S("e")).alias("continuation"),
    )
    return t.conversations.select(
        (C("conv_id") * 1000 + C("turn")).alias("page_id"), C("conv_id").alias("file"), C("turn").cast("int").alias("page_number"), "text", p.cast(PREDICTION).alias("prediction")
    )


@query("w02_next_strong", """
WITH a AS (SELECT conv_id, turn, CASE WHEN NOT (length(text) % 3 = 0 OR (contains(text,'e') AND NOT contains(text,'ment') AND NOT contains(text,'tion'))) THEN CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 1 END END k FROM conversations)
SELECT conv_id * 1000 + turn AS page_id, first_value(k IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)::BIGINT AS next_type FROM a""")
def _(t):
    d = sq.page_features(conversation_pages(t))
    return sq.next_strong(d, F.floor(C("page_number") / 2)).select("page_id", "next_type")


@query("w03_correct_sequence")
def _(t):
    p = C("prediction")
    return sq.correct_sequence(conversation_pages(t), chunk=3).select("page_id", "rule", p["type"].alias("type"), p["group"].alias("group"), p["confidence"].alias("confidence"))


@query("w04_islands", """
WITH a AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) p FROM events)
SELECT user_id, event_id, sum(CASE WHEN p IS NULL OR event_id - p > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS island FROM a""")
def _(t):
    return wi.islands(t.events, ["user_id"], [C("event_id")], F.floor(C("event_id") / 500), C("event_id"), 40).select("user_id", "event_id", "island")


@query("w04_merge_adjacent", """
WITH RECURSIVE p AS (SELECT conv_id AS group_id, conv_id * 1000 + turn AS page_id, turn AS page, CASE WHEN role = 'user' THEN split_part(text, ' ', 1) END AS surgery,
 CASE WHEN role = 'assistant' THEN substr(text, 1, 20) END AS diagnosis, CASE WHEN length(text) > 400 THEN text END AS treatment, CASE WHEN length(text) % 2 = 0 THEN '2024-01-01' END AS date, length(text) < 120 AS signature FROM conversations),
o AS MATERIALIZED (SELECT *, regexp_replace(COALESCE(surgery, '手术记录'), '\\s+', '', 'g') AS t, COALESCE(date, '') AS d, COALESCE(surgery, diagnosis, treatment) IS NOT NULL AS filled, row_number() OVER (PARTITION BY group_id ORDER BY page, page_id) AS i FROM p),
w AS (SELECT group_id, 0::BIGINT AS i, NULL::BIGINT AS head, NULL::VARCHAR AS t, NULL::VARCHAR AS d, NULL::BIGINT AS page, NULL::BIGINT AS page_id, false AS used FROM (SELECT DISTINCT group_id FROM p)
 UNION ALL SELECT group_id, i, CASE WHEN begins THEN id ELSE head END, CASE WHEN begins THEN nt ELSE t END, CASE WHEN begins THEN nd ELSE d END, CASE WHEN begins OR joins THEN np ELSE page END, id, begins OR joins
 FROM (SELECT *, NOT joins AND filled AS begins FROM (SELECT w.group_id, o.i, w.head, w.t, w.d, w.page, o.page_id AS id, o.page::BIGINT AS np, o.t AS nt, o.d AS nd, o.filled,
  COALESCE(o.page - w.page <= 1 AND (o.signature OR o.t = w.t OR o.d = w.d), false) AS joins FROM w JOIN o ON o.group_id = w.group_id AND o.i = w.i + 1))),
m AS (SELECT o.*, w.head, w.head = o.page_id AS first, w.head = o.page_id OR NOT o.signature AS own FROM w JOIN o USING (group_id, i) WHERE w.used)
SELECT group_id, COALESCE(NULLIF(max(surgery) FILTER (WHERE first), ''), '手术记录') AS title, max(date) FILTER (WHERE first) AS date, max(surgery) FILTER (WHERE first) AS surgery,
 arg_min(diagnosis, i) FILTER (WHERE own AND diagnosis <> '') AS diagnosis, arg_min(treatment, i) FILTER (WHERE own AND treatment <> '') AS treatment,
 arg_min(COALESCE(NULLIF(treatment, ''), NULLIF(diagnosis, ''), CASE WHEN first THEN surgery END), i) FILTER (WHERE own AND COALESCE(NULLIF(treatment, ''), NULLIF(diagnosis, ''), CASE WHEN first THEN surgery END) <> '') AS quote,
 string_agg(page_id::VARCHAR, ',' ORDER BY i) AS ids, string_agg(page::VARCHAR, ',' ORDER BY i) AS numbers,
 CASE WHEN COALESCE(max(date) FILTER (WHERE first), '') <> '' AND COALESCE(max(surgery) FILTER (WHERE first), '') <> '' THEN 84::BIGINT ELSE 68 END AS confidence, bool_or(signature AND NOT first) AS signature_merged
FROM m GROUP BY group_id, head""")
def _(t):
    d = t.conversations.select(
        C("conv_id").alias("group_id"), (C("conv_id") * 1000 + C("turn")).alias("page_id"), C("turn").cast("int").alias("page_number"),
        F.when(C("role") == "user", F.substring_index("text", " ", 1)).alias("surgery"), F.when(C("role") == "assistant", F.substring("text", 1, 20)).alias("diagnosis"),
        F.lit(None).cast("string").alias("findings"), F.when(F.length("text") > 400, C("text")).alias("treatment"), F.when(F.length("text") % 2 == 0, "2024-01-01").alias("date"),
        (F.length("text") < 120).alias("signature"),
    )
    r = wi.merge_adjacent(d, ["group_id"])
    return r.select("group_id", "title", "date", "surgery", "diagnosis", "treatment", "quote", joined(C("source_ids")).alias("ids"), joined(C("source_pages")).alias("numbers"), "confidence", "signature_merged")


@query("w05_top_evidence", """
WITH a AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) rn FROM documents)
SELECT source, lang, doc_id, rn FROM a WHERE rn <= 10""")
def _(t):
    return wi.top_evidence(t.documents.select("source", "lang", "doc_id", C("n_chars").alias("score"), C("doc_id").alias("ord")), ["source", "lang"]).select("source", "lang", "doc_id", "rn")


@query("w06_limit_by_role", """
WITH a AS (SELECT source, doc_id, n_chars, CASE lang WHEN 'en' THEN 'primary' WHEN 'fr' THEN 'supporting' ELSE 'candidate' END role FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source, role ORDER BY n_chars DESC, doc_id) rn FROM a)
SELECT source, doc_id, role, rn + CASE role WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1000 ELSE 2000 END AS rank FROM b WHERE rn <= CASE role WHEN 'primary' THEN 10 WHEN 'supporting' THEN 5 ELSE 4 END""")
def _(t):
    d = t.documents.select("source", "doc_id", C("n_chars").alias("score"), C("doc_id").alias("ord"), F.when(C("lang") == "en", "primary").when(C("lang") == "fr", "supporting").otherwise("candidate").alias("role"))
    return wi.limit_by_role(d, ["source"]).select("source", "doc_id", "role", "rank")


@query("w07_trusted_or_all", f"""
WITH a AS (SELECT source, doc_id, lang, {REVIEW} s FROM {LABELLED} WHERE lang <> 'en'), b AS (SELECT * FROM a WHERE s IS DISTINCT FROM 'excluded'),
c AS (SELECT *, bool_or(COALESCE(s IN ('confirmed','system_verified'), false)) OVER (PARTITION BY source, lang) tr FROM b)
SELECT source, doc_id FROM c WHERE NOT tr OR s IN ('confirmed','system_verified')""")
def _(t):
    d = labelled(t).select("source", "lang", "doc_id", C("lang").alias("fact_type"), review().alias("review_status"), S("core").alias("importance"))
    return wi.trusted_or_all(d, ["source", "lang"], ["fr", "de", "es"]).select("source", "doc_id")


@query("w08_char_budget", """
WITH a AS (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) tot, length(text) n FROM documents)
SELECT source, doc_id, CAST(tot AS BIGINT) AS total, CASE WHEN tot <= 8000 THEN 'both' ELSE 'cut_after' END AS kept FROM a WHERE tot - n <= 8000""")
def _(t):
    d = t.documents.select("source", "doc_id", "text")
    a = char_budget(d, ["source"], [C("doc_id")], C("text"), 8000, "cut_after")
    b = char_budget(d, ["source"], [C("doc_id")], C("text"), 8000, "stop_before").select("doc_id", S("both").alias("k"))
    return a.join(b, "doc_id", "left").select("source", "doc_id", "total", F.coalesce("k", S("cut_after")).alias("kept"))


@query("w09_latest", """
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts,'%Y-%m-%d') END DESC, event_id) rn FROM events)
SELECT user_id, event_id FROM a WHERE rn = 1""")
def _(t):
    return wi.latest(t.events, ["user_id"], F.when(C("event_type") != "error", F.date_format("ts", "yyyy-MM-dd")), C("event_id")).select("user_id", "event_id")


@query("w10_preferred_source", """
WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'es' THEN 1 ELSE 99 END, CASE WHEN n_chars > 500 THEN n_chars ELSE 999999 END, doc_id) rn FROM documents)
SELECT source, doc_id FROM a WHERE rn = 1""")
def _(t):
    d = t.documents.select("source", C("doc_id").alias("page_id"), C("lang").alias("subtype"), F.when(C("n_chars") > 500, C("n_chars")).alias("page_number"))
    return wi.preferred_source(d, ["source"], {"de": 0, "es": 1}).select("source", C("page_id").alias("doc_id"))


@query("w11_capped_topk", """
WITH a AS (SELECT lang, source, doc_id, n_chars % 97 s, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars % 97 DESC, doc_id DESC) rd FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN rd > 3 THEN 1 ELSE 0 END, s DESC, doc_id DESC) rank FROM a)
SELECT lang, doc_id, rank FROM b WHERE rank <= 80""")
def _(t):
    d = t.documents.select("lang", C("source").alias("doc_id"), C("doc_id").alias("chunk_id"), (C("n_chars") % 97).alias("score"))
    return wi.capped_topk(d, ["lang"], 80, 3).select("lang", C("chunk_id").alias("doc_id"), "rank")


@query("w12_recent", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn <= 20")
def _(t):
    return wi.recent(t.events, ["user_id"], C("event_id")).select("user_id", "event_id")


@query("w13_dedupe_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def _(t):
    d = t.documents.select(F.sha2("text", 256).alias("h"), "lang", "doc_id")
    return wi.dedupe_first(d, ["h", "lang"], [C("doc_id")]).select("doc_id")


@query("w14_sequence_features", """
WITH a AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 10 WHEN 'user' THEN 60 ELSE 70 END s FROM conversations)
SELECT conv_id, turn, lag(role) OVER w AS previous, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen_before,
 COALESCE(max(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s, false) AS regression FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(t):
    stage = F.when(C("role") == "system", 10).when(C("role") == "user", 60).otherwise(70)
    return wi.sequence_features(t.conversations, ["conv_id"], [C("turn")], F.floor(C("turn") / 2), "role", stage).select("conv_id", "turn", "previous", "seen_before", "regression")


# --- orders ------------------------------------------------------------------


ROLE_SQL = "CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 30 WHEN 'purchase' THEN 40 ELSE {0} END"


@query("o01_fact_order", f"""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 80 THEN '9999-99-99 99:99' WHEN value > 20 THEN strftime(ts,'%Y-%m-%d') || ' 23:59' ELSE strftime(ts,'%Y-%m-%d %H:%M') END,
 CASE WHEN value > 80 THEN 9 WHEN value > 20 THEN 1 ELSE 0 END, {ROLE_SQL.format(999)}, CASE WHEN event_type = 'view' THEN event_id % 7 ELSE 999999 END, event_id) AS pos FROM events""")
def _(t):
    role = F.when(C("event_type") == "click", "admission").when(C("event_type") == "view", "exam").when(C("event_type") == "purchase", "surgery").otherwise("x")
    date = F.when(C("value") > 80, " ").when(C("value") > 20, F.date_format("ts", "yyyy/M/d")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    d = t.events.select("user_id", C("event_id").alias("fact_id"), date.alias("fact_date"), S("medical_event").alias("fact_type"), role.alias("fact_role"),
                        F.when(C("event_type") == "view", F.array(S(500), (C("event_id") % 7).cast("int"))).alias("source_pages"))
    d, order = od.with_fact_order(d)
    return od.numbered(d, ["user_id"], order, od.time_bucket(order), [C("fact_id").alias("event_id")])


@query("o02_page_order", """
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, CASE WHEN lang = 'en' THEN 'case1_' || (doc_id % 3) ELSE '' END, CASE WHEN lang = 'en' THEN doc_id ELSE CASE WHEN lang = 'fr' THEN 1 ELSE 0 END END,
 CASE WHEN lang IN ('de','es') THEN n_chars ELSE 0 END, doc_id) AS pos FROM documents""")
def _(t):
    name = F.when(C("lang") == "en", text("case1_", C("doc_id") % 3, "-", C("doc_id"), ".png")).otherwise("scan.tif")
    page = F.when(C("lang") != "fr", C("n_chars"))
    order = od.page_order(name, page=page, ident=C("doc_id"))
    return od.numbered(t.documents, ["source"], order, od.page_bucket(order), [C("doc_id")])


@query("o03_event_order", f"""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY substring(d,1,10), {ROLE_SQL.format(100)}, d, event_id) AS pos FROM (SELECT *, CASE WHEN value > 60 THEN '9999-99-99 99:99' ELSE strftime(ts,'%Y-%m-%d %H:%M') END d FROM events)""")
def _(t):
    role = F.when(C("event_type") == "click", "admission").when(C("event_type") == "view", "exam").when(C("event_type") == "purchase", "surgery").otherwise("")
    date = F.when(C("value") <= 60, F.date_format("ts", "yyyy-MM-dd HH:mm"))
    order = od.event_order(date, role, C("event_id"))
    return od.numbered(t.events, ["user_id"], order, od.time_bucket(order), [C("event_id")])


@query("o04_report_order", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus='P' THEN '9999-12-31T23:59:59' ELSE strftime(o_orderdate,'%Y-%m-%d') END, o_orderkey) AS pos,
 row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus='F' THEN strftime(o_orderdate,'%Y-%m-%d') END NULLS LAST, CASE WHEN o_orderstatus='O' THEN strftime(o_orderdate,'%Y-%m-%d') END NULLS LAST, o_orderkey) AS pos2 FROM orders""")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    a = od.report_order(F.when(C("o_orderstatus") == "P", "").otherwise(day), C("o_orderkey"))
    b = od.report_order_nulls_last(F.when(C("o_orderstatus") == "F", day), F.when(C("o_orderstatus") == "O", day), C("o_orderkey"))
    first = od.numbered(t.orders, ["o_custkey"], a, od.time_bucket(a), [C("o_orderkey")])
    return first.join(od.numbered(t.orders, ["o_custkey"], b, od.time_bucket(b), [C("o_orderkey")], "pos2"), ["o_custkey", "o_orderkey"])


@query("o05_list_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def _(t):
    return od.list_page(pr.filter_status(t.orders, "draft", "o_orderstatus", "F"), C("o_orderdate"), C("o_orderkey"), 100, 50).select("o_orderkey", "o_orderstatus")


@query("o06_bounded_slices", f"""
WITH a AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN contains(text,'{w}') THEN '{w}' END" for w in 'abcdefghijklmnop')}], lambda k: k IS NOT NULL) l FROM documents)
SELECT doc_id, array_to_string(l[1:8],'') AS eight, array_to_string(l[1:4],'') AS four FROM a""")
def _(t):
    d = t.documents.select("doc_id", pr.matched_keywords(C("text"), list("abcdefghijklmnop")).alias("l"))
    return d.select("doc_id", F.array_join(F.slice("l", 1, 8), "").alias("eight"), F.array_join(F.slice("l", 1, 4), "").alias("four"))


# --- sets --------------------------------------------------------------------


@query("u02_merge_refs", """
WITH a AS (SELECT 0 l, 'k' || (item_id % 9) k, item_id FROM benchmark WHERE contains(text,'inha') UNION ALL SELECT 1, CASE WHEN contains(text,'The') THEN 'k' || (item_id % 13) ELSE item_id::VARCHAR END, item_id FROM benchmark),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l, item_id) rn FROM a)
SELECT l::BIGINT AS list_no, item_id AS ref_id FROM b WHERE rn = 1""")
def _(t):
    b = t.benchmark.withColumn("g", S(0))
    none = F.lit(None).cast("string")
    a = b.filter(F.contains("text", S("inha"))).select("g", text("k", C("item_id") % 9).alias("clause_key"), C("item_id").alias("ref_id"), none.alias("label"), none.alias("snippet"), C("item_id").alias("ord"))
    c = b.select("g", F.when(F.contains("text", S("The")), text("k", C("item_id") % 13)).alias("clause_key"), C("item_id").alias("ref_id"), none.alias("label"), none.alias("snippet"), C("item_id").alias("ord"))
    return st.merge_refs(["g"], a, c).select("list_no", "ref_id")


@query("u02_direct_hits", """
SELECT item_id AS chunk_id, length(text)::DOUBLE AS score FROM benchmark WHERE contains(text,'tion') UNION ALL SELECT item_id, 10.0::DOUBLE FROM benchmark WHERE contains(text,'The') AND NOT contains(text,'tion')""")
def _(t):
    b = t.benchmark.select(S(1).alias("case_id"), C("item_id").alias("chunk_id"), "text")
    scored = b.filter(F.contains("text", S("tion"))).withColumn("score", F.length("text").cast("double"))
    return st.with_direct_hits(scored, b.filter(F.contains("text", S("The")))).select("chunk_id", "score")


@query("u03_stale_keys", """
SELECT l_orderkey AS k, 'stale' AS change FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag='A' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus='F')
UNION ALL SELECT o_orderkey, 'new' FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus='F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag='A')""")
def _(t):
    old = t.lineitem.filter(C("l_returnflag") == "A").select(C("l_orderkey").alias("k"))
    return st.stale_keys(old, t.orders.filter(C("o_orderstatus") == "F").select(C("o_orderkey").alias("k")), ["k"])


@query("u04_array_sets", f"""
SELECT doc_id, ({any_of('text', ['tion'])} AND lang = 'en') OR ({any_of('text', ['lich'])} AND lang = 'de') AS overlap, concat_ws('|', lang, source, CASE WHEN contains(text,'tion') THEN 'tion' END) AS fields FROM documents""")
def _(t):
    found = pr.matched_keywords(C("text"), ["tion"])
    mine = F.when(C("lang") == "en", F.array(S("tion"))).when(C("lang") == "de", F.array(S("lich")))
    return t.documents.select("doc_id", st.overlaps(pr.matched_keywords(C("text"), ["tion", "lich"]), mine).alias("overlap"),
                              joined(st.union_fields(F.array("lang", "source"), F.concat(F.array("source"), found)), "|").alias("fields"))
