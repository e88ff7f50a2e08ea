"""R01-R08, E01-E07, T01-T10, G06-G07 and Q01-Q04 over the given tables."""

from pyspark.sql import functions as F

from caseweave.functions import predicates as pr
from caseweave.functions.classify import PREDICTION, classify_page
from caseweave.operators import aggregates as ag
from caseweave.operators import merge as me
from caseweave.operators import sequence as sq
from caseweave.operators.ordering import event_order
from caseweave.plans import assembly as asm
from caseweave.plans import corpus as co
from caseweave.plans import jobs
from caseweave.plans import rules as ru
from caseweave.queries.extract import work_table
from caseweave.queries.groups import LABELLED, conversation_pages, labelled, review
from caseweave.queries.merges import fact_tables
from caseweave.queries.predicates import RULES, any_of, class_sql
from caseweave.queries.registry import query
from caseweave.session import work_path
from caseweave.streaming import snapshots, streams

C = F.col
S = lambda x: F.lit(x)
NULL = lambda k: F.lit(None).cast(k)


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def joined(c, sep=","):
    return F.array_join(c.cast("array<string>"), sep)


# --- corpus ------------------------------------------------------------------


# Sections of DOCS (doc_id, x), line by line.
SECTIONS = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(x, '\\r\\n|\\r|\\f', chr(10), 'g') AS x FROM (DOCS)),
n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)^[—\\-－]@WS@*[0-9]+@WS@*[—\\-－]@WS@*$', '', 'g'), '@WC@') AS x FROM t),
u AS (SELECT doc_id, unnest(range(0, len(string_split(x, chr(10))))) AS p, string_split(x, chr(10)) AS ls FROM n),
l AS (SELECT doc_id, trim(ls[p + 1], '@WC@') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM u WHERE trim(ls[p + 1], '@WC@') <> ''),
r AS (SELECT *, length(line) <= 120 AND regexp_matches(line, '^[0-9]+(\\.[0-9]+){0,5}@WS@+.+$') AND length(trim(regexp_extract(line, '^[0-9]+(\\.[0-9]+){0,5}@WS@+(.+)$', 2), '@WC@')) <= 90 AS h FROM l),
h AS MATERIALIZED (SELECT doc_id, i, line, h, CASE WHEN h THEN regexp_extract(line, '^[0-9]+(\\.[0-9]+){0,5}') END AS hc, CASE WHEN h THEN trim(regexp_extract(line, '^[0-9]+(\\.[0-9]+){0,5}@WS@+(.+)$', 2), '@WC@') END AS ht FROM r),
w AS (SELECT doc_id, 0::BIGINT AS i, '' AS body, '' AS code, '' AS title, NULL::VARCHAR AS done, '' AS dcode, '' AS dtitle FROM n
 UNION ALL SELECT doc_id, i, CASE WHEN length(b) >= 1200 THEN '' ELSE b END, c, t, CASE WHEN ends THEN body WHEN length(b) >= 1200 THEN b END, CASE WHEN ends THEN code ELSE c END, CASE WHEN ends THEN title ELSE t END
 FROM (SELECT w.doc_id, h.i, w.body, w.code, w.title, h.h AND w.body <> '' AS ends, CASE WHEN h.h OR w.body = '' THEN h.line ELSE w.body || chr(10) || h.line END AS b, COALESCE(h.hc, w.code) AS c, COALESCE(h.ht, w.title) AS t
  FROM w JOIN h ON h.doc_id = w.doc_id AND h.i = w.i + 1)),
s AS (SELECT doc_id, i, dcode AS code, dtitle AS title, done AS text FROM w WHERE length(done) >= 80
 UNION ALL SELECT doc_id, 1000000000, arg_max(code, i), arg_max(title, i), arg_max(body, i) FROM w GROUP BY doc_id HAVING length(arg_max(body, i)) >= 80),
c AS (SELECT doc_id, i, NULLIF(code, '') AS code, NULLIF(title, '') AS title, unnest(range(0, length(text), 2400)) AS o, text, 2400 AS size FROM s
 UNION ALL SELECT doc_id, 0, NULL, NULL, unnest(range(0, length(x), 1200)), x, 1200 FROM n WHERE doc_id NOT IN (SELECT doc_id FROM s)),
e AS (SELECT doc_id, i, o, code, title, size, CASE WHEN size = 1200 THEN trim(substr(text, o + 1, size), '@WC@') ELSE substr(text, o + 1, size) END AS text FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, o) - 1 AS pos, code, title, md5(text) AS digest FROM e WHERE size = 2400 OR length(text) >= 80"""
OLD = "CASE WHEN lang = 'es' THEN replace(text, chr(10), ' ') ELSE replace(text, chr(10), chr(10) || '3.1 ') END"


def numbered_docs(t):
    """Each line a heading; one language comes as one long line each, so that sections go over their longest."""
    line = F.when(C("lang") == "es", F.replace("text", S("\n"), S(" "))).otherwise(F.regexp_replace("text", "\n", "\n3.1 "))
    return t.documents.select("doc_id", C("source").alias("doc_title"), line.alias("text"))


@query("r01_chunk_documents", SECTIONS.replace("DOCS", f"SELECT doc_id, {OLD} AS x FROM documents"))
def _(t):
    return co.chunk_documents(numbered_docs(t)).select("doc_id", "pos", "code", "title", F.md5("text").alias("digest"))


@query("d16_rebuild_chunks", SECTIONS.replace("DOCS", f"SELECT doc_id, CASE WHEN quality = 1 THEN text ELSE {OLD} END AS x FROM {LABELLED}"))
def _(t):
    """Saved reviews name the documents whose chunks are made anew; all other chunks stay as they were."""
    pages = t.documents.select(C("doc_id").alias("page_id"), "doc_id", S("").alias("reviewed"), S("pending").alias("review_status"), S(0).alias("confidence"), S("").alias("notes"))
    reviews = t.labels.select(
        C("doc_id").alias("page_id"), F.when(C("quality") == 1, "completed").otherwise("unknown").alias("status"), S("x").alias("reviewed"), NULL("int").alias("confidence"), NULL("string").alias("notes")
    )
    _, touched = me.apply_review(pages, reviews)
    now = t.documents.select("doc_id", C("source").alias("doc_title"), "text")
    return co.rebuild_chunks(co.chunk_documents(numbered_docs(t)), now, touched).select("doc_id", "pos", "code", "title", F.md5("text").alias("digest"))


BANK = ["tion", "inha", "rest", "eron"]
BRULES, BSPECIAL = [(["inha"], ["doc1"])], [(["doc2"], ["rest"], False, -20.0), (["doc3"], ["eron"], True, 18.0)]
QSQL = """q AS (SELECT p_partkey qid, p_name || ' ' || CASE p_type WHEN 'PROMO' THEN 'tion inha' WHEN 'SMALL' THEN 'rest' ELSE 'eron tion' END q, p_size FROM part),
c AS (SELECT item_id, item_id // 8 d, lower('doc' || (item_id // 8) || chr(10) || chr(10) || chr(10) || text) h, lower(text) b FROM benchmark)"""
BOOST = "(CASE WHEN contains(q,'inha') AND d = 1 THEN 8 ELSE 0 END + CASE WHEN d = 2 AND NOT contains(q,'rest') THEN -20 ELSE 0 END + CASE WHEN d = 3 AND contains(q,'eron') THEN 18 ELSE 0 END)"
POINTS = " + ".join(f"CASE WHEN contains(q,'{w}') THEN least((length(h)-length(replace(h,'{w}','')))//{len(w)}, 6) ELSE 0 END" for w in BANK)


def corpus_tables(t):
    tail = F.when(C("p_type") == "PROMO", "tion inha").when(C("p_type") == "SMALL", "rest").otherwise("eron tion")
    queries = t.part.select(C("p_partkey").alias("query_id"), text(C("p_name"), " ", tail).alias("query"), C("p_size"))
    chunks = t.benchmark.select(C("item_id").alias("chunk_id"), F.floor(C("item_id") / 8).alias("doc_id"), text("doc", F.floor(C("item_id") / 8)).alias("doc_title"), NULL("string").alias("code"), NULL("string").alias("title"), "text")
    return queries, chunks


@query("r02_doc_boost", f"WITH {QSQL} SELECT qid AS query_id, d AS doc_id, CAST({BOOST} AS DOUBLE) AS boost FROM q, (SELECT unnest([0, 1, 2, 3, 4])::BIGINT d)")
def _(t):
    q, _ = corpus_tables(t)
    doc = C("doc_id")
    q = q.withColumn("doc_id", F.explode(F.array(*map(F.lit, range(5)))))
    return q.select("query_id", "doc_id", co.doc_boost(C("query"), text("doc", doc), BRULES, BSPECIAL).alias("boost"))


@query("r03_score_chunks", f"WITH {QSQL}, s AS (SELECT qid, item_id, CAST({POINTS} + {BOOST} AS DOUBLE) score FROM q, c) SELECT qid AS query_id, item_id AS chunk_id, score FROM s WHERE score > 0")
def _(t):
    q, c = corpus_tables(t)
    return co.score_chunks(q, c, BANK, BRULES, BSPECIAL).select("query_id", "chunk_id", "score")


@query("r04_search", f"""
WITH {QSQL}, s AS (SELECT qid, item_id, d, CAST({POINTS} + {BOOST} AS DOUBLE) score FROM q, c),
a AS (SELECT *, row_number() OVER (PARTITION BY qid, d ORDER BY score DESC, item_id DESC) rd FROM s WHERE score > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rd > 3 THEN 1 ELSE 0 END, score DESC, item_id DESC) rank FROM a)
SELECT qid AS query_id, item_id AS chunk_id, score, rank FROM b WHERE rank <= 8""")
def _(t):
    q, c = corpus_tables(t)
    return co.search(q, c, 8, 3, bank=BANK, rules=BRULES, specials=BSPECIAL).select("query_id", "chunk_id", "score", "rank")


@query("r05_search_in_docs", """
WITH k AS (SELECT p_partkey qid, p_size % 5 d, unnest(['tion','inha','zz','er']) t, unnest([true,true,false,false]) core FROM part),
c AS (SELECT item_id, item_id // 8 d, lower('doc' || (item_id // 8) || chr(10) || chr(10) || chr(10) || text) h, lower(text) b FROM benchmark),
m AS (SELECT qid, item_id, c.d, t, core, least((length(h)-length(replace(h,t,'')))//length(t), 6) hits, contains(b,t) ib FROM k JOIN c ON k.d = c.d WHERE contains(h,t)),
f AS (SELECT qid, t, count(*) df FROM m WHERE ib AND core GROUP BY 1, 2),
s AS (SELECT m.qid, item_id, d, sum(CASE WHEN core THEN hits * greatest(1.0::DOUBLE/(df+1), 0.3::DOUBLE) * 3 ELSE 0.5 END)::DOUBLE score FROM m LEFT JOIN f ON m.qid = f.qid AND m.t = f.t GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, d ORDER BY round(score,9) DESC, item_id DESC) rn FROM s)
SELECT qid AS query_id, item_id AS chunk_id, rn FROM r WHERE rn <= 5""")
def _(t):
    _, c = corpus_tables(t)
    d = t.part
    scope = d.select(C("p_partkey").alias("query_id"), (C("p_size") % 5).cast("bigint").alias("doc_id"))
    return co.search_in_docs(d.select(C("p_partkey").alias("query_id"), S("Tion inha zz er").alias("keywords")), scope, c).select("query_id", "chunk_id", "rn")


SCORE = "(4*contains(text,'tion')::INT + 4*contains(text,'ment')::INT + CASE lang WHEN 'en' THEN 8 WHEN 'fr' THEN 5 ELSE -4 END + CASE WHEN n_chars > 500 THEN 4 ELSE 0 END + CASE quality WHEN 1 THEN 3 ELSE CASE WHEN quality = 0 AND toxic = 0 THEN 2 ELSE 0 END END + 14*contains(text,'lich')::INT)"


def evidence_rows(t):
    kind = F.when(C("lang") == "en", "medical_event").when(C("lang") == "fr", "imaging_report").otherwise("hospital_record")
    return labelled(t).select(
        "doc_id", C("source").alias("case_id"), kind.alias("kind"), C("doc_id").alias("id"), S("2024-01-02").alias("date"), C("lang").alias("org"), text("t", C("doc_id")).alias("title"), F.substring("text", 1, 40).alias("summary"),
        S("").alias("quote"), "text", F.when(C("n_chars") > 500, F.array(S(1), S(2))).alias("source_pages"), review().alias("review_status"), "lang", "n_chars",
    )


@query("r06_evidence_score", f"SELECT doc_id, ({SCORE})::BIGINT AS score FROM {LABELLED}")
def _(t):
    d = evidence_rows(t)
    return d.select("doc_id", co.evidence_score(C("text"), C("kind"), C("source_pages"), C("review_status"), ["tion", "ment"], [(["lich"], 14)]).alias("score"))


@query("r07_select_clauses", """
WITH k AS (SELECT p_partkey qid, unnest(['tion','er']) t, unnest([true,false]) core FROM part WHERE p_type = 'SMALL'),
c AS (SELECT item_id, item_id // 8 d, lower('doc' || (item_id // 8) || chr(10) || chr(10) || chr(10) || text) h, lower(text) b FROM benchmark WHERE item_id // 8 IN (1,2)),
m AS (SELECT qid, item_id, d, t, core, least((length(h)-length(replace(h,t,'')))//length(t), 6) hits, contains(b,t) ib FROM k, c WHERE contains(h,t)),
f AS (SELECT qid, t, count(*) df FROM m WHERE ib AND core GROUP BY 1, 2),
s AS (SELECT m.qid, item_id, d, sum(CASE WHEN core THEN hits * greatest(1.0::DOUBLE/(df+1), 0.3::DOUBLE) * 3 ELSE 0.5 END)::DOUBLE score FROM m LEFT JOIN f ON m.qid = f.qid AND m.t = f.t GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, d ORDER BY round(score,9) DESC, item_id DESC) rn FROM s)
SELECT qid AS case_id, item_id AS chunk_id FROM r WHERE rn <= 5""")
def _(t):
    _, c = corpus_tables(t)
    d = t.part
    req = d.select(C("p_partkey").alias("case_id"), F.when(C("p_type") == "SMALL", "level").otherwise("other").alias("item"))
    choices = d.select(C("p_partkey").alias("case_id"), S("tion er").alias("keywords"), F.array(S("9.9")).alias("codes"))
    docs = c.select("doc_id", C("doc_title").alias("title"), NULL("string").alias("file_name")).distinct()
    return co.select_clauses(req, [("level", ["doc1", "doc2"]), ("other", ["none"])], choices, docs, c).select("case_id", "chunk_id")


@query("r08_reference_context", """
WITH a AS (SELECT item_id % 3 k, item_id, CASE WHEN contains(text,'inha') THEN 'supporting' ELSE 'primary' END role, trim(regexp_replace(text,'@WS@+',' ','g'),'@WC@') x FROM benchmark),
b AS (SELECT *, '[' || row_number() OVER (PARTITION BY k, role ORDER BY item_id) || '] 《b》' || chr(10) || x line FROM a),
c AS (SELECT *, sum(length(line)) OVER (PARTITION BY k, role ORDER BY item_id) tot FROM b),
g AS (SELECT k, role, string_agg(line, chr(10)||chr(10) ORDER BY item_id) FILTER (WHERE tot <= CASE role WHEN 'primary' THEN 4200 ELSE 1600 END) t FROM c GROUP BY 1, 2)
SELECT ks.k AS case_id, md5('【拟引用规范依据】（正式结论只能引用本栏条款，不得引用未列出的条款号）' || chr(10) || COALESCE(p.t,'未检索到拟引用条款，正式结论应采用审慎表述。') ||
 CASE WHEN s.k IS NULL THEN '' ELSE chr(10) || chr(10) || '【辅助判断依据】（只用于影像复核、事实判断，不得直接写成伤残等级或三期条款依据）' || chr(10) || COALESCE(s.t,'') END) AS digest
FROM (SELECT DISTINCT k FROM a) ks LEFT JOIN g p ON p.k = ks.k AND p.role = 'primary' LEFT JOIN g s ON s.k = ks.k AND s.role = 'supporting'""")
def _(t):
    refs = t.benchmark.select((C("item_id") % 3).alias("case_id"), C("item_id").alias("ord"), F.when(F.contains("text", S("inha")), "supporting").otherwise("primary").alias("role"), S("b").alias("doc_title"), S("").alias("code"), S("").alias("title"), "text")
    return co.reference_context(refs).select("case_id", F.md5("context").alias("digest"))


# --- rules -------------------------------------------------------------------


@query("e01_build_corpus", f"""
WITH f AS (SELECT source, doc_id, CASE quality WHEN 1 THEN 'confirmed' WHEN 0 THEN CASE toxic WHEN 1 THEN 'excluded' ELSE 'system_verified' END END s FROM {LABELLED} WHERE lang IN ('de','en')),
u AS (SELECT * FROM f WHERE s IN ('confirmed','system_verified'))
SELECT source AS case_id, 'medical_event' AS kind, doc_id AS id FROM u
UNION ALL SELECT source, 'imaging_report', doc_id FROM documents WHERE lang NOT IN ('de','en') AND source NOT IN (SELECT source FROM u)
UNION ALL SELECT o_custkey::VARCHAR, 'hospital_record', o_orderkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_custkey::VARCHAR, 'medical_event', l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber HAVING max(l_returnflag) = 'A'""")
def _(t):
    d = labelled(t)
    facts = d.filter(C("lang").isin("de", "en")).select(
        C("source").alias("case_id"), C("doc_id").alias("fact_id"), C("doc_id").alias("source_id"), S("medical_event").alias("source_kind"), S("medical_event").alias("fact_type"), S("exam").alias("fact_role"), S("").alias("fact_date"), S("").alias("org"),
        C("lang").alias("title"), F.substring("text", 1, 50).alias("summary"), S("").alias("quote"), F.array(S(1)).alias("source_pages"), review().alias("review_status"), S("core").alias("importance"),
    )
    x = fact_tables(t)
    other = d.filter(~C("lang").isin("de", "en")).select(
        C("source").alias("case_id"), C("doc_id").alias("report_id"), S("o").alias("org"), S("2024").alias("date"), NULL("string").alias("datetime"), S("CT").alias("exam_type"), S("p").alias("exam_part"), S("").alias("film_no"), C("text").alias("content"),
        F.array(S(1)).alias("source_pages"), S("pending").alias("review_status"),
    )
    as_text = lambda r: r.withColumn("case_id", C("case_id").cast("string"))
    return ru.build_corpus(facts, as_text(x["records"]), as_text(x["events"]), other).select("case_id", "kind", "id")


SPECS = [
    {"spec_id": "a", "kind": "any_term", "include": ["tion", "ment"], "require_any": [], "met_any": ["lich", "aux"], "conf_met": 88, "conf_uncertain": 62, "title": "A", "category": "x"},
    {"spec_id": "b", "kind": "uncertain", "include": ["ción"], "require_any": ["que"], "met_any": ["osta"], "conf_met": 66, "conf_uncertain": 55, "title": "B", "category": "y"},
    {"spec_id": "c", "kind": "variant", "include": ["lich"], "met_any": ["token"], "conf_met": 84, "conf_uncertain": 78, "suffix": "_open", "title": "C", "category": "y"},
]


def spec_sql():
    base = "CASE lang WHEN 'en' THEN 8 WHEN 'fr' THEN 5 ELSE -4 END + CASE WHEN n_chars > 500 THEN 4 ELSE 0 END + CASE WHEN quality = 1 THEN 3 WHEN quality = 0 AND toxic = 0 THEN 2 ELSE 0 END"
    rows = []
    for s in SPECS:
        own = " + ".join(f"{len(w)}*contains(text,'{w}')::INT" for w in s["include"])
        req = f" AND {any_of('text', s['require_any'])}" if s.get("require_any") else ""
        rows.append(f"SELECT '{s['spec_id']}' sp, source, doc_id, text, {any_of('text', s['met_any'])} hit, {base} + {own} sc, CASE lang WHEN 'en' THEN 'medical_event' WHEN 'fr' THEN 'imaging_report' ELSE 'hospital_record' END kind FROM {LABELLED} WHERE {any_of('text', s['include'])}{req}")
    return "m AS (" + " UNION ALL ".join(rows) + "), r AS (SELECT *, row_number() OVER (PARTITION BY source, sp ORDER BY sc DESC, kind, doc_id) rn FROM m), g AS (SELECT source, sp, bool_or(hit) hit, string_agg(doc_id::VARCHAR, ',' ORDER BY rn) ids FROM r WHERE rn <= 10 GROUP BY 1, 2)"


@query("e02_decide", f"""
WITH {spec_sql()} SELECT source AS case_id, sp || CASE WHEN sp = 'c' AND hit THEN '_open' ELSE '' END AS candidate_key, CASE WHEN sp = 'c' OR (sp = 'a' AND hit) THEN 'met' ELSE 'uncertain' END AS decision,
 CASE sp WHEN 'a' THEN CASE WHEN hit THEN 88 ELSE 62 END WHEN 'b' THEN CASE WHEN hit THEN 66 ELSE 55 END ELSE CASE WHEN hit THEN 84 ELSE 78 END END::BIGINT AS confidence, ids FROM g""")
def _(t):
    return ru.decide(evidence_rows(t), SPECS).select("case_id", "candidate_key", "decision", "confidence", joined(C("evidence.id")).alias("ids"))


@query("e02_rule_kinds", """
WITH r AS (SELECT l_orderkey k, l_linenumber n, l_quantity::INT q, l_partkey p, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity::INT > 25 THEN 5 ELSE 0 END + CASE WHEN l_linenumber > 6 THEN 15 ELSE 0 END DESC, l_partkey) rn FROM lineitem),
c AS (SELECT k, max(n) n, max(q) q, count(DISTINCT p) ids, count(DISTINCT CASE WHEN q > 25 THEN p END) big FROM r WHERE rn <= 10 GROUP BY 1),
d AS (SELECT k, 'ribs' AS candidate_key, n > 6 AS met, 88 a, 62 b, CASE WHEN n > 6 THEN '已识别约' ELSE '需核对，约' END || CASE WHEN n > 1 THEN (n - 1)::VARCHAR ELSE '不明' END || '根' suggestion, '' must, ids FROM c
 UNION ALL SELECT k, 'teeth', n > 6, 82, 55, '需人工核对', '', ids FROM c
 UNION ALL SELECT k, 'brain', true, 84, 62, '需人工核对', '误工|护理|营养', ids FROM c WHERE k % 2 = 0
 UNION ALL SELECT k, 'spleen', true, 82, 60, '可按候选处理', '修补', big FROM c WHERE q > 25
 UNION ALL SELECT k, 'pelvis', true, 84, 68, '需人工核对', '', big FROM c WHERE q > 25)
SELECT k AS case_id, candidate_key, CASE WHEN met THEN 'met' ELSE 'uncertain' END AS decision, CASE WHEN met THEN a ELSE b END::BIGINT AS confidence, suggestion, must AS must_mention, ids AS n_evidence,
 CASE WHEN met THEN '' ELSE '该候选证据不足或条款映射未稳定，不能直接写成正式结论。|' END || '部分来源事实尚未人工确认。' AS warnings FROM d""")
def _(t):
    n, q = C("l_linenumber"), C("l_quantity").cast("int")
    d = t.lineitem.select(
        C("l_orderkey").alias("case_id"), S("medical_event").alias("kind"), C("l_partkey").alias("id"), S("").alias("date"), S("").alias("org"), S("").alias("title"), S("").alias("summary"), S("").alias("quote"),
        text("肋骨骨折：右第2-", n, "肋；牙齿缺失", n, "枚，肌力", q, "级。脾", F.when(q > 25, "破裂修补").otherwise("正常"), "；软化灶。", F.when(q > 25, "骨盆骨折，畸形愈合").otherwise("未见骨盆骨折")).alias("text"), F.array(S(1)).alias("source_pages"), S("pending").alias("review_status"),
    )
    repair = {"act": "修补", "subjects": ["脾"], "direct": ["脾破裂修补"], "excluded": "肠系膜修补", "unless": ["胃修补"]}
    specs = [
        {"spec_id": "ribs", "kind": "count", "include": ["肋骨骨折"], "conf_met": 88, "conf_uncertain": 62, "suggestion_met": "已识别约{n}根", "suggestion_uncertain": "需核对，约{n}根"},
        {"spec_id": "teeth", "kind": "items", "include": ["牙"], "conf_met": 82, "conf_uncertain": 55},
        {"spec_id": "brain", "kind": "two_conditions", "include": ["软化灶"], "met_any": ["软化灶"], "signs": ["肌力"], "no_signs": ["肌力正常"], "conf_met": 84, "conf_uncertain": 62, "category": "三期", "asked": ["误工"]},
        {"spec_id": "spleen", "kind": "repair", "include": ["脾"], "procedure": repair, "conf_met": 82, "suggestion": "可按候选处理", "must_mention": ["修补"]},
        {"spec_id": "pelvis", "kind": "deformity", "include": ["骨盆"], "met_any": ["畸形愈合"], "positive": {"patterns": ["骨盆骨折"], "negatives": ["未见"], "window": 2}, "conf_met": 84, "conf_uncertain": 68},
    ]
    asked = t.orders.select(C("o_orderkey").alias("case_id"), F.when(C("o_orderkey") % 2 == 0, "误工期").otherwise("伤残等级").alias("request"))
    r = ru.decide(d, specs, requests=asked)
    return r.select("case_id", "candidate_key", "decision", "confidence", "suggestion", joined(C("must_mention"), "|").alias("must_mention"), F.size("evidence").alias("n_evidence"), joined(C("warnings"), "|").alias("warnings"))


@query("e03_candidate_warnings", """
SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderstatus = 'F' THEN '该候选证据不足或条款映射未稳定，不能直接写成正式结论。' END, CASE WHEN o_orderpriority = '5-LOW' THEN '部分来源事实尚未人工确认。' END, CASE WHEN o_totalprice < 100000 THEN '部分来源缺少页码，建议回到原图核对。' END) AS warnings FROM orders""")
def _(t):
    e = lambda s, p: F.struct(s.alias("review_status"), p.alias("source_pages"))
    ev = F.array(e(S("confirmed"), F.array().cast("array<int>")), e(F.when(C("o_orderpriority") == "5-LOW", "pending"), F.when(C("o_totalprice") >= 100000, F.array(S(1)))))
    return t.orders.select("o_orderkey", joined(ru.candidate_warnings(F.when(C("o_orderstatus") == "F", "uncertain").otherwise("met"), ev), "|").alias("warnings"))


@query("e04_collect_refs", """
WITH a AS (SELECT l_orderkey, l_linenumber o, unnest(['k' || (l_partkey % 4), l_suppkey::VARCHAR]) id, unnest([0,1]) pos, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 20),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, id ORDER BY o, l_partkey, pos) rn FROM a) SELECT l_orderkey AS case_id, id AS ident FROM b WHERE rn = 1""")
def _(t):
    r = lambda k, i: F.struct(k.alias("clause_key"), i.alias("ref_id"), NULL("string").alias("label"))
    d = t.lineitem.select(
        C("l_orderkey").alias("case_id"), F.struct("l_linenumber", "l_partkey").alias("ord"), F.when(C("l_returnflag") == "A", "met").otherwise("uncertain").alias("decision"), F.when(C("l_quantity") < 20, "excluded").alias("status"), S(90).alias("confidence"),
        F.array(r(text("k", C("l_partkey") % 4), NULL("bigint")), r(NULL("string"), C("l_suppkey"))).alias("standards"),
    )
    return ru.collect_refs(d).select("case_id", "ident")


@query("e05_validate_text", """
SELECT conv_id * 1000 + turn AS case_id, '分析说明可能遗漏已满足候选：r' || role || '。' AS warning FROM conversations WHERE role <> 'system' AND NOT contains(text,'tion') AND NOT contains(text,'lich')
UNION ALL SELECT conv_id * 1000 + turn, '分析说明中可能出现被鉴定人性别错误，应以基本情况中的“男”为准。' FROM conversations WHERE role = 'user' AND turn > 2
UNION ALL SELECT DISTINCT conv_id * 1000 + turn, '髋关节置换候选已满足，但文本中出现 5.9.2，请人工核对条款号是否误引。' FROM conversations WHERE role = 'assistant'""")
def _(t):
    key = (C("conv_id") * 1000 + C("turn")).alias("case_id")
    texts = t.conversations.select(key, text(C("text"), F.when(C("role") == "assistant", "髋 5.9.2").otherwise(""), F.when(C("turn") > 2, "张三. 张三(a)，现年30岁 女").otherwise("")).alias("text"))
    cands = t.conversations.select(key, S("hip_joint_replacement").alias("candidate_key"), text("r", C("role")).alias("title"), F.when(C("role") == "system", "uncertain").otherwise("met").alias("decision"), NULL("string").alias("status"), S(85).alias("confidence"), F.array(S("tion"), S("lich")).alias("must_mention"))
    persons = t.conversations.filter(C("role") == "user").select(key, S("张三(a)").alias("name"), S("男").alias("gender"))
    return ru.validate_text(texts, cands, persons)


@query("e06_repair_text", "SELECT conv_id * 1000 + turn AS case_id, md5(CASE WHEN role = 'user' THEN replace(text,'tion','TION') ELSE text END) AS digest FROM conversations")
def _(t):
    key = (C("conv_id") * 1000 + C("turn")).alias("case_id")
    cands = t.conversations.select(key, F.when(C("role") == "user", "hip").otherwise("x").alias("candidate_key"), S("met").alias("decision"), S("accepted").alias("status"), S(1).alias("confidence"))
    return ru.repair_text(t.conversations.select(key, "text"), cands, "hip", [("tion", "TION")]).select("case_id", F.md5("text").alias("digest"))


@query("e07_analysis_payload", """
SELECT c_custkey AS case_id, c_name AS person, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_records, COALESCE((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'),'') AS cands FROM customer""")
def _(t):
    cases = t.customer.select(C("c_custkey").alias("case_id"), C("c_name").alias("person"))
    o = t.orders.withColumn("case_id", C("o_custkey"))
    cands = o.filter(C("o_orderstatus") == "P").select("case_id", C("o_orderkey").alias("candidate_key"), S("met").alias("decision"), S(1).alias("confidence"), S("accepted").alias("status"))
    refs = o.filter(C("o_orderstatus") == "P").select("case_id", C("o_orderkey").alias("ord"), S(0).alias("pos"), S("i").alias("ident"))
    warn = cases.select("case_id", F.array(S("w")).alias("warnings"))
    r = ru.analysis_payload(cases, {"records": o.select("case_id")}, cands, refs, warn)
    return r.select("case_id", C("context.person").alias("person"), C("evidence_counts.records").alias("n_records"), F.coalesce(joined(C("candidates.candidate_key")), S("")).alias("cands"))


# --- texts -------------------------------------------------------------------


@query("t01_fact_lines", """
WITH a AS (SELECT source, doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 999999 END pg, '日期未明 | ' || lang || ' | t' || doc_id || ' | ' || trim(text,'@WC@') || CASE WHEN lang = 'en' THEN ' | 依据：q' ELSE '' END || CASE WHEN n_chars > 500 THEN ' | 来源页：1, 2' ELSE '' END x FROM documents),
b AS (SELECT source, string_agg(x, chr(10) ORDER BY pg, doc_id) y FROM a GROUP BY 1) SELECT source AS case_id, md5(substring(y,1,8000)) AS digest FROM b""")
def _(t):
    from caseweave.plans.facts import fact_lines

    d = t.documents.select(
        C("source").alias("case_id"), C("doc_id").alias("fact_id"), S("").alias("fact_date"), S("medical_event").alias("fact_type"), S("exam").alias("fact_role"), C("lang").alias("org"), text("t", C("doc_id")).alias("title"), C("text").alias("summary"),
        F.when(C("lang") == "en", "q").alias("quote"), F.when(C("n_chars") > 500, F.array(S(1), S(2))).otherwise(F.array(S(1)).cast("array<int>")).alias("source_pages"),
    ).withColumn("source_pages", F.when(F.size("source_pages") == 2, C("source_pages")))
    return fact_lines(d).select("case_id", F.md5("text").alias("digest"))


@query("t02_summary_draft", """
WITH a AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN '相关医院' ELSE event_type END org, strftime(ts,'%Y-%m-%d') || '，病历事实：' || props || '（来源页：' || event_id || '）' line FROM events),
f AS (SELECT user_id, org, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) no FROM a GROUP BY 1, 2),
l AS (SELECT user_id, no, 0 k, 0::BIGINT o, CASE WHEN no > 1 THEN chr(10) ELSE '' END || ['（一）','（二）','（三）','（四）','（五）'][no] || '据' || org || '住院病历记载：' line FROM f UNION ALL SELECT a.user_id, no, 1, event_id, line FROM a JOIN f ON a.user_id = f.user_id AND a.org = f.org),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY no, k, o) - 1 rn FROM l)
SELECT user_id AS case_id, rn // 30 AS part, md5(string_agg(line, chr(10) ORDER BY rn)) AS digest FROM n GROUP BY 1, 2""")
def _(t):
    d = t.events.select(C("user_id").alias("case_id"), C("event_id").alias("ord"), F.when(C("event_type") != "error", C("event_type")).alias("org"), F.date_format("ts", "yyyy-MM-dd").alias("fact_date"), S("").alias("title"), C("props").alias("summary"), F.array("event_id").alias("source_pages"))
    return asm.summary_draft(d, size=30).select("case_id", "part", F.md5("text").alias("digest"))


@query("t03_record_sentence", """
SELECT o_orderkey, '（' || (o_orderkey + 11) || '）据某医院住院病案（住院号：' || o_custkey || '）记载：' || CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate,'%Y-%m-%d') || '入院，住院5天。' ELSE '' END || CASE WHEN o_orderpriority = '5-LOW' THEN '住院期间予以药！' ELSE '' END || '出院医嘱：休。' AS sentence FROM orders""")
def _(t):
    d = t.orders.select(
        "o_orderkey", S("").alias("org"), C("o_custkey").alias("number"), F.when(C("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_in"), S("").alias("date_out"), F.when(C("o_orderstatus") == "F", 5).alias("days"),
        S("").alias("complaint"), NULL("string").alias("diagnosis_in"), F.when(C("o_orderpriority") == "5-LOW", " 药！").alias("treatment"), S("").alias("diagnosis_out"), S("休").alias("orders"),
    ).withColumn("treatment", F.trim("treatment"))
    return d.select("o_orderkey", asm.record_sentence(C("o_orderkey") + 11).alias("sentence"))


@query("t04_case_narrative", """
WITH v AS (SELECT o_custkey k, o_orderpriority p, min(o_orderkey) o FROM orders GROUP BY 1, 2), g AS (SELECT k, count(*) n, string_agg(p, '、' ORDER BY o) s FROM v GROUP BY 1)
SELECT c_custkey AS case_id, '事。' || CASE WHEN n IS NULL THEN '' ELSE c_name || '伤后' || CASE WHEN n > 1 THEN '先后' ELSE '' END || '就诊于' || s || '。' END || '现为处理案件需要，' || c_mktsegment || '特委托我鉴定中心对' || c_name || '的伤残等级进行鉴定。' AS narrative FROM customer LEFT JOIN g ON k = c_custkey""")
def _(t):
    cases = t.customer.select(C("c_custkey").alias("case_id"), S("事。").alias("description"), C("c_mktsegment").alias("entrusting_unit"), S("伤残等级").alias("request"), C("c_name").alias("person"))
    orgs = ag.ordered_distinct(t.orders.withColumn("case_id", C("o_custkey")), "case_id", "o_orderpriority", C("o_orderkey")).withColumnRenamed("o_orderpriority", "org")
    return asm.case_narrative(cases, orgs).select("case_id", "narrative")


@query("t05_review_lines", """
SELECT o_custkey AS case_id, string_agg('复阅' || strftime(o_orderdate,'%Y-%m-%d') || 'H张三' || o_orderstatus || 'CT片' || CASE WHEN o_totalprice > 200000 THEN '（号' || o_orderkey || '）' ELSE '' END || '示：' || o_orderpriority || '。', chr(10) ORDER BY o_orderdate, o_orderkey) AS lines FROM orders GROUP BY 1""")
def _(t):
    d = t.orders.select(
        C("o_custkey").alias("case_id"), F.struct("o_orderdate", "o_orderkey").alias("ord"), F.year("o_orderdate").alias("bucket"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), S("H").alias("org"), S("张三").alias("person"), C("o_orderstatus").alias("part"),
        S("CT").alias("kind"), F.when(C("o_totalprice") > 200000, C("o_orderkey").cast("string")).alias("film_no"), C("o_orderpriority").alias("content"),
    )
    return asm.review_lines(d).select("case_id", C("text").alias("lines"))


@query("t06_procedure_text", """
SELECT o_orderkey, concat_ws(chr(10)||chr(10), '按照《法医临床检验规范》（SF/Z JD0103003-2011）' || CASE WHEN o_orderstatus = 'F' THEN '和《法医临床影像学检验实施规范》（SF/Z JD0103006-2014）' ELSE '' END || '对张三进行法医临床学检查。',
 CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate,'%Y年%m月%d日') || '，即被鉴定人张三伤后' || CASE o_orderstatus WHEN 'P' THEN '10日' ELSE '1个月余' END || '。' END, CASE WHEN o_orderstatus = 'O' THEN '查体' END) AS text FROM orders""")
def _(t):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    d = t.orders.select(
        "o_orderkey", S("张三").alias("person"), F.when(C("o_orderpriority") != "5-LOW", iso(C("o_orderdate"))).alias("exam_date"),
        F.date_format(C("o_orderdate") - F.when(C("o_orderstatus") == "P", F.expr("interval 10 days")).otherwise(F.expr("interval 40 days")), "yyyy年M月d日").alias("accident_date"),
        F.when(C("o_orderstatus") == "O", " 查体 ").alias("clinical"), (C("o_orderstatus") == "F").alias("has_exams"), NULL("string").alias("review"),
    )
    return d.select("o_orderkey", asm.procedure_text(d).alias("text"))


TEXT7 = """'根据委托单位提供的现有材料，结合本鉴定中心检验所见，现分析如下：' || chr(10) || chr(10) || '1. 被鉴定人' || c_name || '外伤史确切，系本次事故所致。' || chr(10) || chr(10) || '2. 被鉴定人' || c_name || '本次外伤后相关损伤诊断明确（经病历及检查材料证实）。' || chr(10) || chr(10)"""


@query("t07_analysis_text", f"""
WITH o AS (SELECT o_custkey k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) i FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment <> 'BUILDING'),
g AS (SELECT k, string_agg((i+2) || '. 被鉴定人' || c_name || '伤' || o_orderkey || '。有鉴于此，参照相关规定并结合临床资料综合评定，被鉴定人' || c_name || '伤' || o_orderkey || '应评为十级伤残。', chr(10)||chr(10) ORDER BY i) t FROM o JOIN customer ON c_custkey = k GROUP BY 1)
SELECT c_custkey AS case_id, md5({TEXT7} || COALESCE(t, '3. 现有已采信事实尚不足以直接形成伤残等级或三期结论，需结合临床检查及规范条款进一步核对。')) AS digest FROM customer LEFT JOIN g ON k = c_custkey""")
def _(t):
    flags = pr.request_flags(F.when(C("c_mktsegment") == "BUILDING", "x").otherwise("伤残等级"))
    cases = t.customer.select(C("c_custkey").alias("case_id"), C("c_name").alias("person"), S("").alias("accident"), NULL("string").alias("diagnoses"), flags.alias("flags"))
    std = "struct<doc_title:string,grade:string,label:string>"
    cands = t.orders.select(
        C("o_custkey").alias("case_id"), C("o_orderkey").alias("ord"), text("伤", C("o_orderkey")).alias("title"), S("伤残等级").alias("category"), S("met").alias("decision"), F.when(C("o_orderstatus") == "F", "accepted").otherwise("pending").alias("status"),
        S("").alias("reason"), S("十级").alias("grade"), S("").alias("suggestion"), NULL(std).alias("standard"),
    )
    return asm.analysis_text(cases, cands).select("case_id", F.md5("text").alias("digest"))


@query("t08_candidate_context", """
SELECT o_orderkey, '- [met; status=' || CASE WHEN o_orderstatus='F' THEN 'excluded' ELSE 'accepted' END || '] ' || o_orderpriority || chr(10) || '  类别：c' || chr(10) || '  来源：2024 t（页码1,2）：q' || o_custkey || '；k（页码未明）：s' || CASE WHEN o_orderstatus='F' THEN chr(10) || '  风险提示：该候选未被采信，正文不得写成正式结论。' ELSE '' END AS context FROM orders""")
def _(t):
    e = lambda d, ti, k, q, s, p: F.struct(d.alias("date"), ti.alias("title"), k.alias("kind"), q.alias("quote"), s.alias("summary"), p.alias("source_pages"))
    none = F.array().cast("array<int>")
    ev = F.array(e(S("2024"), S("t"), S("k"), text("q", C("o_custkey")), S("s"), F.array(S(1), S(2))), e(S(""), S(""), S("k"), S(""), S("s"), none))
    d = t.orders.select("o_orderkey", S("met").alias("decision"), F.when(C("o_orderstatus") == "F", "excluded").otherwise("accepted").alias("status"), C("o_orderpriority").alias("title"), S("c").alias("category"), ev.alias("evidence"), NULL("array<string>").alias("warnings"))
    return asm.candidate_context(d).select("o_orderkey", "context")


@query("t09_report_rows", """
SELECT c_custkey AS case_id, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '待填写' END AS entrusting_unit, CASE WHEN c_nationkey < 10 THEN c_name || '，男，2000年01月02日生（' || c_custkey || '），住x' ELSE '待填写' END AS person,
 CASE WHEN c_nationkey % 2 = 0 THEN 'facts' ELSE 'desc' END AS case_facts, CASE WHEN c_nationkey % 3 = 0 THEN 'sum' ELSE '待根据病历材料填写...' END AS material_summary, '【鉴定意见由鉴定人根据分析说明和专业标准填写】' AS opinion FROM customer""")
def _(t):
    k = C("c_custkey").alias("case_id")
    cases = t.customer.select(k, F.when(C("c_acctbal") > 0, C("c_mktsegment")).alias("entrusting_unit"), S("r").alias("request"), S("desc").alias("description"))
    persons = t.customer.filter(C("c_nationkey") < 10).select(k, C("c_name").alias("name"), S("男").alias("gender"), S("2000-01-02").alias("birth_date"), C("c_custkey").cast("string").alias("id_number"), S("x").alias("address"))
    reports = t.customer.filter(C("c_nationkey") % 2 == 0).select(k, S("facts").alias("case_facts"), S("").alias("material_summary"), NULL("string").alias("appraisal_process"), S("a").alias("analysis"), S("").alias("opinion"))
    summaries = t.customer.filter(C("c_nationkey") % 3 == 0).select(k, S("sum").alias("record_summary"))
    return asm.report_rows(cases, persons, reports, summaries).select("case_id", "entrusting_unit", "person", "case_facts", "material_summary", "opinion")


@query("t10_accept_or_draft", """
SELECT conv_id * 1000 + turn AS case_id, CASE role WHEN 'assistant' THEN 'supplied' ELSE 'draft' END AS method, md5(CASE role WHEN 'assistant' THEN '（一）据甲住院病历记载' || trim(text,'@WC@') ELSE 'draft ' || role END) AS digest FROM conversations""")
def _(t):
    key = (C("conv_id") * 1000 + C("turn")).alias("case_id")
    gen = t.conversations.filter(C("role") != "system").select(key, F.when(C("role") == "assistant", text("据甲住院病案记载", F.btrim("text"))).otherwise(C("text")).alias("text"))
    return asm.accept_or_draft(t.conversations.select(key, text("draft ", C("role")).alias("draft")), gen).select("case_id", "method", F.md5("text").alias("digest"))


# --- jobs and streams --------------------------------------------------------


@query("g06_analyse")
def _(t):
    k = C("c_custkey").alias("case_id")
    cases = t.customer.select(k, C("c_name").alias("person"), S("伤残等级").alias("request"), S("道路交通事故").alias("accident"), C("c_mktsegment").alias("diagnoses"))
    cands = t.orders.select(
        C("o_custkey").alias("case_id"), C("o_orderkey").alias("ord"), S("hip").alias("candidate_key"), text("伤", C("o_orderkey")).alias("title"), S("伤残等级").alias("category"), S("met").alias("decision"), F.when(C("o_orderstatus") == "F", "accepted").otherwise("pending").alias("status"),
        S("").alias("reason"), S("十级").alias("grade"), S("").alias("suggestion"), NULL("struct<doc_title:string,grade:string,label:string>").alias("standard"), S(90).alias("confidence"), F.array(C("o_orderpriority")).alias("must_mention"),
    )
    gen = t.customer.filter(C("c_nationkey") < 15).select(k, F.when(C("c_nationkey") < 8, text("<think>x</think>根据委托单位提供的现有材料，", C("c_name"), "\n3. 后续治疗费 1\n4. 第5.9.2条")).otherwise("让我先整理").alias("text"))
    out = jobs.analyse(cases, cands, gen, [("第5\\.9\\.2条", "该条")], "hip")
    n = out["warnings"].groupBy("case_id").agg(F.count(S(1)).alias("n_warnings"))
    return out["texts"].join(n, "case_id", "left").select("case_id", "method", "dropped", F.coalesce("n_warnings", S(0)).alias("n_warnings"))


@query("g07_analyse_pages", """
SELECT count(*) FILTER (WHERE l.doc_id IS NULL AND lang <> 'es') AS analysed, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS reused, count(*) FILTER (WHERE l.doc_id IS NULL AND lang = 'es') AS failed FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id""")
def _(t):
    pages = t.documents.select(C("doc_id").alias("page_id"), C("source").alias("case_id"), C("source").alias("file"), C("doc_id").cast("int").alias("page_number"), F.when(C("lang") == "es", "").otherwise(C("text")).alias("text"))
    p = F.struct(S("medical_record").alias("type"), S("home").alias("subtype"), S("甲").alias("group"), S(0.9).alias("confidence"), S("").alias("reason"), F.array(S("k")).alias("keywords"), S(False).alias("continuation"))
    cache = t.labels.select(C("doc_id").alias("page_id"), F.when(C("quality") == 1, "v2").otherwise("v1").alias("version"), S(True).alias("has_text"), p.cast(PREDICTION).alias("prediction"))
    aliases = t.documents.select(C("source").alias("case_id"), S("甲").alias("alias"), S("甲医院").alias("canonical")).distinct()
    confirmed = aliases.select("case_id", C("canonical").alias("name"), S(1).alias("ord"))
    return jobs.analysis_counters(jobs.analyse_pages(pages, cache, "v2", aliases, confirmed, rules=RULES)).select("analysed", "reused", "failed")


def run_stream(t, df, name, start):
    """Run a stream over what is there now; its checkpoint lies in the shared folder."""
    folder = work_path(t.spark, name)
    q = start(df.writeStream.option("checkpointLocation", folder + "-state").trigger(availableNow=True), folder)
    q.awaitTermination()
    return folder


def as_stream(t, df, name):
    path = work_table(t, df, name)
    return t.spark.readStream.schema(df.schema).parquet(path)


@query("q01_stream_classify", class_sql() + " SELECT doc_id, type, subtype, COALESCE(conf, CAST(0 AS DOUBLE)) AS confidence FROM d")
def _(t):
    s = streams.stream_classify(as_stream(t, t.documents.select("doc_id", "text"), "pages_in"), RULES)
    folder = run_stream(t, s, "classified", lambda w, f: w.format("parquet").outputMode("append").start(f))
    p = C("prediction")
    return t.spark.read.parquet(folder).select("doc_id", p["type"].alias("type"), p["subtype"].alias("subtype"), p["confidence"].alias("confidence"))


@query("q02_stream_counts", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type='click') AS click, count(*) FILTER (WHERE event_type='error') AS error FROM events GROUP BY 1")
def _(t):
    s = streams.stream_counts(as_stream(t, t.events.select("user_id", "event_type"), "events_in"), ["user_id"], ["click", "error"], "event_type")

    def start(w, f):
        return w.outputMode("complete").foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(f)).start()

    return t.spark.read.parquet(run_stream(t, s, "counts", start))


@query("q03_stream_correct")
def _(t):
    s = streams.stream_correct(as_stream(t, conversation_pages(t), "turns_in"))
    folder = run_stream(t, s, "corrected", lambda w, f: w.format("parquet").outputMode("append").start(f))
    return t.spark.read.parquet(folder).select("file", "page_id", "rule", "type")


@query("q04_stream_merge", """
SELECT source AS case_id, 'f' || doc_id AS fact_key, CASE WHEN lang = 'en' THEN 'v2' ELSE 'v1' END AS summary FROM documents WHERE lang <> 'es'""")
def _(t):
    base = t.documents.select(
        C("source").alias("case_id"), text("f", C("doc_id")).alias("fact_key"), S("medical_event").alias("fact_type"), F.when(C("lang") != "es", "v1").alias("summary"), S("").alias("quote"), S("pending").alias("review_status"), S("core").alias("importance"), S(1).alias("ord"), C("lang")
    )
    rows = base.unionByName(base.filter(C("lang") == "en").withColumn("summary", S("v2")).withColumn("ord", S(2))).drop("lang")
    s = as_stream(t, rows, "facts_in")

    def start(w, f):
        return w.foreachBatch(snapshots.stream_merge(f, 16)).start()

    return snapshots.read_snapshot(t.spark, run_stream(t, s, "snapshots", start)).select("case_id", "fact_key", "summary")
