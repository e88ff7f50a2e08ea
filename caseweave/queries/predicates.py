"""F01-F19 and C01-C09 over the given tables."""
from pyspark.sql import functions as F

from caseweave.functions import classify as cl
from caseweave.functions import predicates as pr
from caseweave.functions.text import compact_text, squeeze
from caseweave.queries.registry import query

C = F.col
LATIN = r"A-Za-zÀ-ÿ"

# A small rule table over the words of the given texts, in place of the default lists.
RULES = cl.Rules(
    subtypes={
        "medical_record": [("home", ["token", "secret"]), ("admission", ["ment"]), ("operation", ["license"]), ("lab_report", ["lich"])],
        "imaging_report": [("mri", ["###"]), ("ct", ["ción"]), ("other_imaging", ["aux"]), ("imaging_film", ["%%%"])],
    },
    defaults={"medical_record": "other_medical", "imaging_report": "other_imaging"},
    header=[("home", ["THE!!"]), ("admission", ["Onretion"])],
    lab=(["Ander"], ["gen", "ung"], ["sch"]),
    lab_hits=["gen", "ung", "sch"],
    medical_hits=["ment", "lich", "tion"],
    imaging_hits=["###", "ción", "aux"],
    modality={"mri": ["###"], "ct": ["ción"]},
    modality_default=["zzz"],
    structure=["ll", "sta", "que"],
    continuation=["The", "Le", "Der"],
    letter=["Whsh", "nterth", "ingon"],
    ident=["heheed", "ndth", "anth"],
    litigation=["Rewh", "whes", "ninger", "onnd", "stou", "rebl"],
    certificate=(["Edon", "bleth"], ["bleth", "tionle"], ["herer"]),
    application=["Anat", "hand", "thed", "then"],
    application_opening="It",
    org_suffixes=["tion"],
    org_chars="a-z",
)
COMPACT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]+\\)', ' 图片 ', 'g'), '<[^>]+>', ' ', 'g'), '#+', ' ', 'g'), '@WS@+', '', 'g')"


def any_of(col, ws):
    return "(" + " OR ".join(f"contains({col},'{w}')" for w in ws) + ")"


def hits_of(col, ws):
    inner = ", ".join(f"CASE WHEN contains({col},'{w}') THEN '{w}' END" for w in ws)
    return f"list_filter([{inner}], lambda k: k IS NOT NULL)"


KW = ["tion", "ment", "lich", "ción", "license", "token"]


@query("f01_matched_keywords", f"SELECT doc_id, {any_of('text', KW)} AS hit, array_to_string(({hits_of('text', KW)})[1:3],'|') AS found FROM documents")
def _(t):
    return t.documents.select("doc_id", pr.contains_any(C("text"), KW).alias("hit"), F.array_join(pr.matched_keywords(C("text"), KW, 3), "|").alias("found"))


@query("f02_quality_flags", f"""
WITH a AS (SELECT doc_id, text || CASE lang WHEN 'de' THEN ' ☐' WHEN 'es' THEN ' �' WHEN 'fr' THEN ' 1 2 3 4' ELSE '' END raw FROM documents),
b AS (SELECT doc_id, raw, trim(regexp_replace(regexp_replace(raw,'[ \\t]+',' ','g'),'\\n{{3,}}',chr(10)||chr(10),'g'),'@WC@') x FROM a),
c AS (SELECT doc_id, raw, trim(regexp_replace(regexp_replace(x,'[☐☑🔄]','','g'),'[ \\t]*\\n[ \\t]*',chr(10),'g'),'@WC@') x FROM b)
SELECT doc_id, concat_ws('|', CASE WHEN length(x) < 80 THEN '文字过少' END, CASE WHEN regexp_matches(raw,'(?i)<div|!\\[|\\]\\(|☐|☑|🔄') THEN '存在图片或复选框残留' END,
 CASE WHEN contains(raw,'�') THEN '存在替换字符' END,
 CASE WHEN x <> '' AND length(regexp_replace(x,'[^{LATIN}]','','g')) / greatest(length(x),1) < 0.2 THEN '中文占比偏低' END,
 CASE WHEN regexp_matches(x,'[0-9]\\s+[0-9]\\s+[0-9]\\s+[0-9]') THEN '疑似表格识别错位' END) AS flags FROM c""")
def _(t):
    raw = F.concat(C("text"), F.when(C("lang") == "de", " ☐").when(C("lang") == "es", " �").when(C("lang") == "fr", " 1 2 3 4").otherwise(""))
    return t.documents.select("doc_id", F.array_join(pr.quality_flags(raw, script=LATIN), "|").alias("flags"))


@query("f03_signature_page", """
SELECT doc_id, length(regexp_replace(text,'@WS@+','','g')) < 120 OR (length(regexp_replace(regexp_replace(text,'@WS@+','','g'),'(?:the|tion|[a-f])','','g')) < 80
 AND contains(regexp_replace(text,'@WS@+','','g'),'est')) AS signature FROM documents""")
def _(t):
    return t.documents.select("doc_id", pr.is_signature_page(C("text"), "(?:the|tion|[a-f])", ["est"]).alias("signature"))


@query("f04_continuation_title", f"""
WITH a AS (SELECT doc_id, lang, {COMPACT} x FROM documents)
SELECT doc_id, x <> '' AND NOT {any_of('substring(x,1,120)', ['The', 'Le', 'Der'])} AS continuation,
 (lang = 'en' AND {any_of('substring(x,1,360)', ['tion', 'ing'])}) OR (lang = 'fr' AND {any_of('substring(x,1,360)', ['aux'])}) AS titled FROM a""")
def _(t):
    x = compact_text(C("text"))
    return t.documents.select(
        "doc_id", pr.is_continuation(x, ["The", "Le", "Der"]).alias("continuation"),
        pr.has_title(x, C("lang"), {"en": ["tion", "ing"], "fr": ["aux"]}).alias("titled"),
    )


@query("f05_lab_exam_tests", f"""
WITH a AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'ct' WHEN lang = 'fr' THEN 'mri' WHEN lang = 'de' THEN 'imaging_film' END kind, {COMPACT} x FROM documents),
b AS (SELECT *, CAST(contains(x,'ll') AS INT) + CAST(contains(x,'sta') AS INT) + CAST(contains(x,'que') AS INT) n FROM a)
SELECT doc_id, {any_of('substring(x,1,260)', ['Ander'])} OR ({any_of('x', ['gen', 'ung'])} AND contains(x,'sch')) AS lab,
 COALESCE(x <> '' AND CASE kind WHEN 'imaging_film' THEN true WHEN 'mri' THEN (contains(substring(x,1,360),'on') AND n >= 1) OR (contains(x,'on') AND n >= 2)
  WHEN 'ct' THEN (contains(substring(x,1,360),'ción') AND n >= 1) OR (contains(x,'ción') AND n >= 2) END, false) AS exam FROM b""")
def _(t):
    x = compact_text(C("text"))
    kind = F.when(C("lang") == "es", "ct").when(C("lang") == "fr", "mri").when(C("lang") == "de", "imaging_film")
    return t.documents.select(
        "doc_id", pr.looks_like_lab(x, ["Ander"], ["gen", "ung"], ["sch"]).alias("lab"),
        pr.looks_like_exam(x, kind, {"mri": ["on"], "ct": ["ción"]}, ["zzz"], ["ll", "sta", "que"]).alias("exam"),
    )


def prediction():
    """A prediction struct rendered from the columns of documents."""
    return F.struct(
        F.when(C("lang") != "es", F.when(C("lang") == "de", "imaging_report").otherwise("medical_record")).alias("type"),
        F.when(C("lang") == "de", "other_imaging_report").alias("subtype"),
        F.lit(None).cast("string").alias("group"),
        ((C("doc_id") % 50) / 50.0 + 0.25).cast("double").alias("confidence"),
        F.lit("").alias("reason"),
        pr.matched_keywords(C("text"), ["aux", "tion"]).alias("keywords"),
        F.contains("text", F.lit("ent")).alias("continuation"),
    )


WEAK = "(lang = 'es' OR (lang = 'de' AND conf <= 0.75 AND NOT kw))"
PRED = "WITH a AS (SELECT doc_id, lang, (doc_id % 50) / 50.0 + 0.25 conf, (contains(text,'aux') OR contains(text,'tion')) kw, contains(text,'ent') cont FROM documents)"


@query("f06_weak_soft", f"{PRED} SELECT doc_id, {WEAK} AS weak, {WEAK} OR conf < 0.66 OR (cont AND NOT kw) AS soft FROM a")
def _(t):
    d = t.documents.withColumn("p", prediction())
    return d.select("doc_id", pr.is_weak(C("p")).alias("weak"), pr.is_soft(C("p")).alias("soft"))


@query("f07_weak_finding", f"SELECT doc_id, source IN ('src1','src2') OR (NOT {any_of('text', ['ment', 'lich'])} AND {any_of('text', ['the', 'para'])}) AS weak FROM documents")
def _(t):
    flags = F.array(C("source"), C("lang"))
    return t.documents.select("doc_id", pr.is_weak_finding(C("text"), flags, ["ment", "lich"], ["the", "para"], ("src1", "src2")).alias("weak"))


F08 = " UNION ALL ".join(
    f"SELECT doc_id, x, unnest(regexp_extract_all(x, '{p}')) m, generate_subscripts(regexp_extract_all(x, '{p}'), 1) i, string_split_regex(x, '{p}') g, {k} p FROM x" for k, p in enumerate(["th[^.,]{0,4}ti", "en[^.,]{0,4}er"])
)


@query("f08_positive_hit", f"""
WITH x AS (SELECT doc_id, regexp_replace(text,'@WS@+','','g') x FROM documents), h AS ({F08}),
s AS (SELECT doc_id, x, length(m) n, sum(length(g[i])) OVER w + sum(length(m)) OVER w - length(m) a FROM h WINDOW w AS (PARTITION BY doc_id, p ORDER BY i)),
t AS (SELECT doc_id, x[greatest(a - 12, 0)::BIGINT + 1 : (a + n + 12)::BIGINT] u FROM s),
o AS (SELECT doc_id, bool_or(NOT {any_of('u', ['and', 'is', 'que'])}) hit FROM t GROUP BY 1)
SELECT doc_id, coalesce(hit, false) AS hit FROM documents LEFT JOIN o USING (doc_id)""")
def _(t):
    return t.documents.select("doc_id", pr.has_positive_hit(C("text"), ["th[^.,]{0,4}ti", "en[^.,]{0,4}er"], ["and", "is", "que"]).alias("hit"))


@query("f09_has_sign", f"WITH a AS (SELECT doc_id, regexp_replace(text,'@WS@+','','g') x FROM documents) SELECT doc_id, NOT {any_of('x', ['lich', 'token'])} AND {any_of('x', ['tion', 'aux'])} AS sign FROM a")
def _(t):
    return t.documents.select("doc_id", pr.has_sign(C("text"), ["tion", "aux"], ["lich", "token"]).alias("sign"))


@query("f10_has_procedure", f"""
WITH a AS (SELECT doc_id, regexp_replace(text,'@WS@+','','g') x FROM documents)
SELECT doc_id, contains(x,'tion') AND NOT (contains(x,'anttion') AND NOT {any_of('x', ['hertion', 'ention'])})
 AND ({any_of('x', ['thtion', 'edtion'])} OR regexp_matches(x, '(?:the|une)[^。；;，,]{{0,12}}tion')) AS done FROM a""")
def _(t):
    return t.documents.select("doc_id", pr.has_procedure(C("text"), "tion", ["the", "une"], ["thtion", "edtion"], "anttion", ["hertion", "ention"]).alias("done"))


@query("f11_request_flags", f"SELECT doc_id, {any_of('text', ['tion', 'aux'])} AS care, contains(text,'ment') AND NOT contains(text,'ments') AS food FROM documents")
def _(t):
    d = t.documents.select("doc_id", pr.request_flags(C("text"), {"care": (["tion", "aux"], []), "food": (["ment"], ["ments"])}).alias("r"))
    return d.select("doc_id", "r.care", "r.food")


@query("f12_work_trace", f"WITH a AS (SELECT conv_id, turn, regexp_replace(text,'@WS@+','','g') x FROM conversations) SELECT conv_id, turn, x = '' OR {any_of('x', ['secret', 'token'])} OR NOT starts_with(x,'L') AS bad FROM a")
def _(t):
    return t.conversations.select("conv_id", "turn", pr.has_work_trace(C("text"), ["secret", "token"], "L").alias("bad"))


@query("f13_needs_refresh", """
WITH r AS (SELECT c.c_custkey, o.o_orderkey, o.o_orderstatus, o.o_orderpriority p, o.o_totalprice > 100000 dated FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey)
SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN true WHEN o_orderstatus = 'F' THEN false
 ELSE NOT dated OR p IN ('1-URGENT','2-HIGH') OR (p = '5-LOW') END AS refresh FROM r""")
def _(t):
    p = C("o_orderpriority")
    text = F.lit("a text of more than twenty chars")
    full = F.when(p.isin("1-URGENT", "2-HIGH"), " ").otherwise(text)
    d = t.customer.join(t.orders, C("c_custkey") == C("o_custkey"), "left").select(
        "c_custkey", "o_orderkey", C("o_orderkey").alias("record_id"),
        F.when(C("o_orderstatus") == "F", "confirmed").otherwise("pending").alias("review_status"),
        full.alias("complaint"), full.alias("history"), text.alias("diagnosis_in"), text.alias("diagnosis_out"),
        F.when(p == "5-LOW", "short").otherwise(full).alias("exam"), text.alias("orders"),
        F.when(C("o_totalprice") > 100000, "2024-01-01").alias("date_in"), F.lit("").alias("date_out"),
    )
    return d.select("c_custkey", "o_orderkey", pr.needs_refresh(d).alias("refresh"))


@query("f14_filter_status", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    return pr.filter_status(t.orders, "draft", "o_orderstatus", "F").select("o_orderkey", "o_orderstatus")


@query("f15_second_opinion", f"{PRED} SELECT doc_id, CASE WHEN lang = 'es' OR conf < 0.80 THEN 'model' ELSE 'rule' END AS route FROM a")
def _(t):
    slow, quick = pr.split_for_second_opinion(t.documents.withColumn("prediction", prediction()))
    return slow.select("doc_id", F.lit("model").alias("route")).unionByName(quick.select("doc_id", F.lit("rule").alias("route")))


@query("f16_readiness", """
WITH f AS (SELECT l_orderkey k, count(*) FILTER (WHERE kind IN ('A','N')) h, count(*) FILTER (WHERE kind IN ('A','N') AND l_linestatus <> 'F') hp,
  count(*) FILTER (WHERE kind = 'R') g, count(*) FILTER (WHERE kind = 'R' AND l_linestatus <> 'F') gp
 FROM (SELECT *, l_returnflag kind FROM lineitem WHERE l_quantity <= 45) GROUP BY 1)
SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderpriority = '5-LOW' THEN 'basics' END, CASE WHEN NOT (COALESCE(h,0) > 0 AND COALESCE(hp,0) = 0) THEN 'record_facts' END,
 CASE WHEN NOT (COALESCE(g,0) > 0 AND COALESCE(gp,0) = 0) THEN 'exam_facts' END, CASE WHEN o_orderstatus <> 'F' THEN 'sections' END) AS failed
FROM orders LEFT JOIN f ON o_orderkey = k""")
def _(t):
    from caseweave.operators.aggregates import readiness

    cases = t.orders.select(
        C("o_orderkey").alias("case_id"), F.lit("unit").alias("entrusting_unit"), F.when(C("o_orderpriority") != "5-LOW", "request").alias("request"),
        F.lit("name").alias("person_name"), *[F.when(C("o_orderstatus") == "F", "text").alias(s) for s in ("case_facts", "material_summary", "appraisal_process", "analysis", "opinion")],
    )
    facts = t.lineitem.select(
        C("l_orderkey").alias("case_id"),
        F.when(C("l_returnflag") == "A", "hospital_record").when(C("l_returnflag") == "N", "medical_event").otherwise("imaging_report").alias("fact_type"),
        F.when(C("l_linestatus") == "F", "confirmed").otherwise("pending").alias("review_status"),
        F.when(C("l_quantity") > 45, "excluded").otherwise("core").alias("importance"),
    )
    return readiness(cases, facts).select(C("case_id").alias("o_orderkey"), F.array_join("failed", "|").alias("failed"))


@query("f17_confidence_band", "SELECT doc_id, CASE WHEN (doc_id % 50) / 50.0 >= 0.85 THEN 'high' WHEN (doc_id % 50) / 50.0 >= 0.65 THEN 'medium' ELSE 'low' END AS band FROM documents")
def _(t):
    return t.documents.select("doc_id", pr.confidence_band((C("doc_id") % 50) / 50.0).alias("band"))


@query("f18_needs_ocr", "SELECT doc_id, n_chars < length(source) * 100 * 3 AS ocr FROM documents")
def _(t):
    return t.documents.select("doc_id", pr.needs_ocr(C("n_chars"), F.length("source") * 10).alias("ocr"))


@query("f19_name_checks", """
WITH a AS (SELECT page_id, 'case' || page_id || '_' || regexp_extract(url,'//([a-z]+)',1) || CASE WHEN url LIKE 'https%' THEN '-' || page_id || '.PNG' ELSE '.pdf' END f FROM pages)
SELECT page_id, regexp_matches(f,'(?i)^case[0-9]+_[A-Za-z0-9]+-[0-9]+\\.(?:png|jpg|jpeg)$') AS page_name, regexp_matches(f,'^case[0-9]+_[A-Za-z0-9]+$') AS prefix FROM a""")
def _(t):
    f = F.concat(F.lit("case"), C("page_id").cast("string"), F.lit("_"), F.regexp_extract("url", "//([a-z]+)", 1),
                 F.when(C("url").like("https%"), F.concat(F.lit("-"), C("page_id").cast("string"), F.lit(".PNG"))).otherwise(".pdf"))
    return t.pages.select("page_id", pr.valid_page_name(f).alias("page_name"), pr.valid_prefix(f).alias("prefix"))


@query("f19_group_check", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' WHEN c_custkey IS NULL OR c_nationkey <> o_orderkey % 25 THEN 'unknown' WHEN c_mktsegment <> 'BUILDING' THEN 'wrong_type' ELSE 'ok' END AS state
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(t):
    rows = t.orders.select("o_orderkey", F.when(C("o_orderstatus") != "P", C("o_custkey")).alias("group_id"), (C("o_orderkey") % 25).alias("case_id"), F.lit("BUILDING").alias("type"))
    groups = t.customer.select(C("c_custkey").alias("group_id"), C("c_nationkey").alias("case_id"), C("c_mktsegment").alias("type"))
    return pr.group_check(rows, groups).select("o_orderkey", C("group_state").alias("state"))


def subtype_sql(kind, x="x"):
    rules = RULES.subtypes[kind]
    lab = f"WHEN {any_of(f'substring({x},1,260)', RULES.lab[0])} OR ({any_of(x, RULES.lab[1])} AND {any_of(x, RULES.lab[2])}) THEN 'lab_report' " if kind == "imaging_report" else ""
    return f"CASE WHEN {x} = '' THEN NULL {lab}" + " ".join(f"WHEN {any_of(x, ws)} THEN '{n}'" for n, ws in rules) + f" ELSE '{RULES.defaults[kind]}' END"


@query("c01_classify_subtype", f"WITH a AS (SELECT doc_id, lang, {COMPACT} x FROM documents) SELECT doc_id, CASE lang WHEN 'en' THEN {subtype_sql('medical_record')} WHEN 'es' THEN {subtype_sql('imaging_report')} WHEN 'fr' THEN {subtype_sql('imaging_report')} END AS subtype FROM a")
def _(t):
    kind = F.when(C("lang") == "en", "medical_record").when(C("lang").isin("es", "fr"), "imaging_report").otherwise("letter")
    d = t.documents.select("doc_id", kind.alias("kind"), compact_text(C("text")).alias("x"))
    return d.select("doc_id", cl.classify_subtype(C("kind"), C("x"), RULES).alias("subtype"))


@query("c02_header_subtype", f"WITH a AS (SELECT doc_id, substring({COMPACT},1,220) x FROM documents) SELECT doc_id, CASE WHEN contains(x,'THE!!') THEN 'home' WHEN contains(x,'Onretion') THEN 'admission' END AS subtype FROM a")
def _(t):
    d = t.documents.select("doc_id", compact_text(C("text")).alias("x"))
    return d.select("doc_id", cl.header_subtype(C("x"), RULES).alias("subtype"))


def count_of(ws):
    return " + ".join(f"CAST(contains(x,'{w}') AS INT)" for w in ws)


def class_sql():
    r = RULES
    exam = "(" + " OR ".join(
        f"(img = '{k}' AND (({any_of('substring(x,1,360)', ws)} AND ns >= 1) OR ({any_of('x', ws)} AND ns >= 2)))" for k, ws in r.modality.items()
    ) + " OR img = 'imaging_film' OR (img NOT IN ('mri','ct','imaging_film') AND ((contains(substring(x,1,360),'zzz') AND ns >= 1) OR (contains(x,'zzz') AND ns >= 2))))"
    return f"""WITH a AS (SELECT doc_id, source, {COMPACT} x FROM documents),
b AS (SELECT *, {subtype_sql('medical_record')} med, {subtype_sql('imaging_report')} img, {count_of(r.structure)} ns, substring(x,1,320) h FROM a),
c AS (SELECT *, CASE WHEN x = '' THEN 99
 WHEN {any_of('substring(x,1,220)', ['THE!!', 'Onretion'])} THEN 0
 WHEN {any_of('substring(x,1,260)', r.lab[0])} OR ({any_of('x', r.lab[1])} AND {any_of('x', r.lab[2])}) THEN 1
 WHEN contains(h,'{r.letter[0]}') OR {count_of(r.letter)} >= 2 THEN 2
 WHEN contains(x,'{r.ident[0]}') AND {any_of('x', r.ident[1:])} THEN 3
 WHEN contains(h,'{r.litigation[0]}') THEN 4
 WHEN (contains(x,'{r.litigation[1]}') AND {any_of('x', r.litigation[2:5])}) OR {count_of(r.litigation)} >= 3 THEN 5
 WHEN contains(substring(x,1,120),'{r.certificate[0][0]}') THEN 6
 WHEN {any_of('x', r.certificate[1])} AND {any_of('x', r.certificate[2])} THEN 7
 WHEN contains(h,'{r.application[0]}') THEN 8
 WHEN starts_with(x,'It') AND contains(x,'{r.application[-1]}') THEN 9
 WHEN {count_of(r.application)} >= 3 AND NOT contains(substring(x,1,500),'{r.litigation[1]}') THEN 10
 WHEN med <> 'other_medical' AND (img IN ('imaging_film','other_imaging') OR med <> 'lab_report') THEN 11
 WHEN img <> 'other_imaging' AND {exam} AND img <> 'imaging_film' THEN 12
 WHEN img <> 'other_imaging' AND {exam} THEN 13
 WHEN img = 'other_imaging' THEN 14 WHEN med = 'other_medical' THEN 15 ELSE 99 END i FROM b),
d AS (SELECT doc_id, source, x, CASE WHEN i IN (0,11,15) THEN 'medical_record' WHEN i IN (1,12,13,14) THEN 'imaging_report' WHEN i = 2 THEN 'entrustment_letter' WHEN i = 3 THEN 'id_card'
   WHEN i IN (4,5) THEN 'litigation_material' WHEN i IN (6,7) THEN 'traffic_accident_cert' WHEN i IN (8,9,10) THEN 'appraisal_application' END AS type,
 CASE i WHEN 0 THEN CASE WHEN contains(substring(x,1,220),'THE!!') THEN 'home' ELSE 'admission' END WHEN 1 THEN 'lab_report' WHEN 11 THEN med WHEN 12 THEN img WHEN 13 THEN img WHEN 14 THEN img WHEN 15 THEN med END AS subtype,
 CAST([0.94,0.86,0.98,0.98,0.96,0.88,0.98,0.92,0.96,0.86,0.88,0.88,0.90,0.72,0.70,0.60][i+1] AS DOUBLE) conf FROM c)"""


@query("c03_classify_page", class_sql() + f" SELECT doc_id, type, subtype, COALESCE(conf, CAST(0 AS DOUBLE)) AS confidence, x <> '' AND NOT {any_of('substring(x,1,120)', RULES.continuation)} AS continuation FROM d")
def _(t):
    d = cl.classify_page(t.documents.select("doc_id", "text"), rules=RULES)
    p = C("prediction")
    return d.select("doc_id", p["type"].alias("type"), p["subtype"].alias("subtype"), p["confidence"].alias("confidence"), p["continuation"].alias("continuation"))


@query("m0_class_bands_by_source", class_sql() + """ SELECT source, COALESCE(type,'none') AS type, CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.65 THEN 'medium' ELSE 'low' END AS band, count(*) AS n_pages
FROM d GROUP BY ALL""")
def _(t):
    d = cl.classify_page(t.documents.select("source", "text"), rules=RULES)
    p = C("prediction")
    return d.groupBy("source", F.coalesce(p["type"], F.lit("none")).alias("type"), pr.confidence_band(p["confidence"]).alias("band")).agg(F.count(F.lit(1)).alias("n_pages"))


@query("c04_normalize_prediction", """
SELECT event_id, event_type IN ('click','view','error') AS kept,
 CASE WHEN event_type IN ('click','view') THEN event_type END AS type, CASE WHEN event_type IN ('click','view','error') THEN CASE WHEN event_type = 'click' THEN 'sub' END END AS subtype,
 CASE WHEN event_type IN ('click','view','error') THEN least(CASE WHEN k > 1 THEN k / 100.0 ELSE k END, 0.98) END AS confidence,
 CASE WHEN event_type IN ('click','view') THEN event_type WHEN event_type = 'error' THEN '' END AS keywords
FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE) k FROM events)""")
def _(t):
    k = F.get_json_object("props", "$.k")
    kind = F.when(C("event_type") == "error", "null").otherwise(C("event_type"))
    kws = F.when(C("event_type") == "click", '["click"]').when(C("event_type") == "view", '"view"').otherwise("null")
    sub_kind = F.when(C("event_type") == "click", "sub").otherwise("unknown")
    answer = F.concat(F.lit('{"material_type":"'), kind, F.lit('","material_subtype":"'), sub_kind, F.lit('","confidence":"'), k, F.lit('","matched_keywords":'), kws, F.lit("}"))
    d = t.events.select("event_id", cl.normalize_prediction(answer, ["click", "view"], ["sub"]).alias("p"))
    p = C("p")
    return d.select("event_id", p.isNotNull().alias("kept"), p["type"].alias("type"), p["subtype"].alias("subtype"), p["confidence"].alias("confidence"), F.array_join(p["keywords"], "|").alias("keywords"))


@query("c05_reclassify", f"""
WITH a AS (SELECT d.doc_id, {subtype_sql('medical_record')} n, CASE l.quality WHEN 1 THEN 'admission' WHEN 0 THEN 'other_medical' END o
 FROM (SELECT doc_id, {COMPACT} x FROM documents WHERE lang <> 'de') d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, o AS subtype, n AS new_subtype FROM a WHERE n IS NOT NULL AND n IS DISTINCT FROM o""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "text", F.lit("medical_record").alias("type"), F.when(C("lang") != "de", "completed").otherwise("failed").alias("status"),
        F.when(C("quality") == 1, "admission").when(C("quality") == 0, "other_medical").alias("subtype"),
    )
    return cl.reclassify(d, RULES).select("doc_id", "subtype", "new_subtype")


@query("c05_backfill_subtype", f"""
SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'admission' ELSE {subtype_sql('medical_record')} END AS subtype
FROM (SELECT doc_id, {COMPACT} x FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "text", F.lit("medical_record").alias("type"), F.when(C("quality") == 1, "admission").when(C("quality") == 0, "").alias("subtype")
    )
    return cl.backfill_subtype(d, RULES).select("doc_id", "subtype")


REF_RULES = {"primary": [(["tion"], ["care"]), (["ment"], ["food", "care"])], "supporting": ["with"], "special": (["that"], ["and"])}


@query("c06_reference_role", """
SELECT item_id, CASE WHEN contains(text,'tion') AND care THEN 'primary' WHEN contains(text,'ment') AND (food OR care) THEN 'primary' WHEN contains(text,'with') THEN 'supporting'
 WHEN contains(text,'that') AND contains(text,'and') THEN 'supporting' ELSE 'candidate' END AS role
FROM (SELECT *, contains(text,'The') care, contains(text,'ing') food FROM benchmark)""")
def _(t):
    flags = pr.request_flags(C("text"), {"care": (["The"], []), "food": (["ing"], [])})
    return t.benchmark.select("item_id", cl.reference_role(C("text"), flags, C("text"), REF_RULES)["role"].alias("role"))


@query("c07_importance", f"SELECT doc_id, CASE WHEN lang IN ('fr','es') OR {any_of('text', ['ndth', 'lich'])} THEN 'core' ELSE 'supporting' END AS importance, CASE WHEN lang = 'es' THEN 'excluded' WHEN {any_of('text', ['ndth', 'lich'])} THEN 'core' ELSE 'supporting' END AS exam FROM documents")
def _(t):
    state = F.when(C("lang") == "es", "excluded").otherwise("pending")
    return t.documents.select("doc_id", cl.importance(C("lang"), C("text"), ["fr", "es"], ["ndth", "lich"]).alias("importance"), cl.exam_importance(state, C("text"), ["ndth", "lich"]).alias("exam"))


@query("c08_import_status", """
WITH a AS (SELECT source, count(*) FILTER (WHERE toxic = 1) f, count(*) FILTER (WHERE quality IS NULL AND lang = 'es') p, count(*) FILTER (WHERE quality = 1) c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
SELECT source, CASE WHEN c > 0 AND f = 0 AND p = 0 THEN 'imported' WHEN c > 0 THEN 'partial_failed' WHEN p > 0 THEN 'needs_ocr' ELSE 'failed' END AS status FROM a""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(
        F.count_if(C("toxic") == 1).alias("f"), F.count_if(C("quality").isNull() & (C("lang") == "es")).alias("p"), F.count_if(C("quality") == 1).alias("c")
    )
    return d.select("source", cl.import_status(C("f"), C("p"), C("c")).alias("status"))


@query("c09_proofread_decision", """
WITH a AS (SELECT d.doc_id, trim(d.text,'@WC@') x, lang, l.quality q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT *, length(x) n, CASE WHEN q = 1 THEN x || ' fixed' WHEN q = 0 THEN substring(x,1,30) END ans, CASE WHEN lang = 'de' THEN 0 ELSE 1 END nf,
  CASE WHEN lang = 'de' THEN 92 ELSE 78 END base FROM a),
c AS (SELECT *, CASE WHEN q IS NULL THEN 'rule' WHEN n > 6000 THEN 'long' WHEN ans <> '' AND length(ans) >= greatest(40, floor(n * 0.75)) THEN 'accept' ELSE 'short' END s FROM b)
SELECT doc_id, CASE s WHEN 'rule' THEN 'completed' WHEN 'accept' THEN CASE WHEN lang = 'fr' THEN 'needs_review' ELSE 'completed' END ELSE 'needs_review' END AS status,
 CAST(CASE s WHEN 'rule' THEN base WHEN 'accept' THEN CASE WHEN lang = 'es' THEN 88 ELSE base END WHEN 'short' THEN 55 ELSE 70 END AS BIGINT) AS confidence,
 CAST(nf + CASE WHEN s IN ('long','short') THEN 1 ELSE 0 END AS BIGINT) AS n_flags, md5(CASE WHEN s = 'accept' THEN trim(ans,'@WC@') ELSE x END) AS digest FROM c""")
def _(t):
    from caseweave.functions.text import strip

    d = t.documents.join(t.labels, "doc_id", "left").withColumn("x", strip(C("text")))
    flags = F.when(C("lang") == "de", F.array().cast("array<string>")).otherwise(F.array(F.lit("f")))
    ans = F.when(C("quality") == 1, F.concat("x", F.lit(" fixed"))).when(C("quality") == 0, F.substring("x", 1, 30))
    r = cl.proofread_decision(C("x"), flags, C("quality").isNotNull() | F.lit(None), ans, F.when(C("lang") == "fr", "needs_review"), F.when(C("lang") == "es", "88.6"))
    d = d.select("doc_id", r.alias("r"))
    return d.select("doc_id", "r.status", "r.confidence", F.size("r.flags").alias("n_flags"), F.md5("r.text").alias("digest"))
