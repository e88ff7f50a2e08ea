"""X01-X23 and S01-S09 over the given tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions import extract as ex
from caseweave.functions.text import truncate_input
from caseweave.queries.predicates import any_of, hits_of
from caseweave.queries.registry import query
from caseweave.session import work_path
from caseweave.sources import pages as sp
from caseweave.sources.logs import read_log_tail

C = F.col
S = lambda x: F.lit(x)


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- extraction --------------------------------------------------------------


@query("x01_extract_label", """
SELECT doc_id, CASE WHEN v = '' THEN NULL ELSE trim(substring(v,1,300),'@WC@') END AS value FROM (
 SELECT doc_id, trim(trim(regexp_replace(string_split(text, chr(10))[1],'@WS@+',' ','g'),'@WC@'),' ：:;；。') v FROM documents)""")
def _(t):
    x = text("甲：", F.split("text", "\n")[0], "　乙： ", C("lang"), "\n丙")
    return t.documents.select("doc_id", ex.extract_label(x, ["无", "甲"], ["甲", "乙"], 300).alias("value"))


@query("x02_extract_datetime", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate,'%Y-%m-%d') || ' 08:05' WHEN '2-HIGH' THEN strftime(o_orderdate,'%Y-%m-%d') || ' 09:00'
 WHEN '5-LOW' THEN NULL ELSE strftime(o_orderdate,'%Y-%m-%d') END AS found FROM orders""")
def _(t):
    day = F.date_format("o_orderdate", "yyyy年M月d日")
    other = F.date_format("o_orderdate", "yyyy.MM.dd")
    p = C("o_orderpriority")
    fine = F.when(p == "1-URGENT", text("时间 ", F.date_format("o_orderdate", "yyyy-M-d"), " 8:5")).when(p == "2-HIGH", text("时间：", day, " 9时")).otherwise("")
    rough = F.when(p == "5-LOW", text("日 ", day)).otherwise(text("时间:", other))
    return t.orders.select("o_orderkey", ex.extract_datetime(F.array(rough, fine), ["时间"]).alias("found"))


@query("x03_extract_days", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS days FROM lineitem")
def _(t):
    x = F.when(C("l_returnflag") == "A", "无").when(C("l_returnflag") == "N", text("住院天数：", C("l_quantity").cast("int"), "天")).otherwise(text("实际住院 ", C("l_quantity").cast("int")))
    return t.lineitem.select("l_orderkey", "l_linenumber", ex.extract_days(F.array(S("x"), x)).alias("days"))


@query("x04_extract_org", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '原阳县人民医院' ELSE '东城' || CASE WHEN c_nationkey < 10 THEN '中医院' ELSE '卫生院' END END AS org,
 CASE c_mktsegment WHEN 'BUILDING' THEN CAST(0 AS BIGINT) WHEN 'MACHINERY' THEN CAST(2 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS n_orgs FROM customer""")
def _(t):
    kind = F.when(C("c_nationkey") < 10, "中医院").otherwise("卫生院")
    x = (
        F.when(C("c_mktsegment") == "BUILDING", text("某 ", C("c_name"), "医院"))
        .when(C("c_mktsegment") == "MACHINERY", text("<b>阳县人民医院</b>, 原阳县 ；西城医院"))
        .otherwise(text("# ", C("c_name"), "东 城", kind, "（", C("c_name"), "）西城医院"))
    )
    from caseweave.functions.text import compact_text

    fix = {"阳县人民医院": ("原阳县", "原阳县人民医院")}
    return t.customer.select("c_custkey", ex.extract_org(x, repairs=fix).alias("org"), F.size(ex.extract_orgs(compact_text(x))).alias("n_orgs"))


@query("x05_extract_request", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '伤残' || o_orderkey || '等级' WHEN o_orderstatus = 'O' THEN '护理期' || o_orderkey ELSE '' END AS request FROM orders")
def _(t):
    k = C("o_orderkey")
    x = (
        F.when(C("o_orderstatus") == "F", text("鉴定要求：甲诉乙一案 联系人 委托事项： 伤残", k, "等级，现将材料移交"))
        .when(C("o_orderstatus") == "O", text("鉴定事项；护理期", k, "。2024年1月2日"))
        .otherwise(text("无 ", k))
    )
    return t.orders.select("o_orderkey", ex.extract_request(x).alias("request"))


@query("x06_numbered_items", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '整项' || o_orderkey WHEN 'F' THEN '甲项；乙项' || o_orderkey ELSE '' END AS items FROM orders")
def _(t):
    k = C("o_orderkey")
    x = (
        F.when(C("o_orderstatus") == "P", text("申请事项：整项", k, "。事实与理由 略"))
        .when(C("o_orderstatus") == "F", text("申请事项: 1、甲项； 2．乙项", k, "，\n此致 法院"))
        .otherwise("事项")
    )
    return t.orders.select("o_orderkey", ex.extract_numbered_items(x).alias("items"))


@query("x07_range_count", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(greatest(CASE WHEN q >= n THEN q - n + 1 ELSE 0 END, CASE WHEN l_returnflag = 'A' THEN n ELSE 0 END, CASE WHEN n = 3 THEN 1 ELSE 2 END) AS BIGINT) AS ribs
FROM (SELECT *, l_linenumber n, CAST(l_quantity AS INT) % 12 q FROM lineitem)""")
def _(t):
    n, q = C("l_linenumber"), C("l_quantity").cast("int") % 12
    x = text("左第", n, F.when(n > 3, "－").otherwise("至"), q, "肋骨折，右第3肋、第 ", n, " 肋。", F.when(C("l_returnflag") == "A", text("肋骨骨折 ", n, "根以上")).otherwise(""))
    return t.lineitem.select("l_orderkey", "l_linenumber", ex.max_range_count(x).alias("ribs"))


@query("x08_item_count", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CASE WHEN l_returnflag = 'A' THEN greatest(n, q) WHEN l_returnflag = 'N' THEN q % 10 ELSE 0 END AS BIGINT) AS teeth,
 l_linestatus = 'F' AND CASE WHEN l_returnflag = 'A' THEN greatest(n, q) WHEN l_returnflag = 'N' THEN q % 10 ELSE 0 END >= 4 AS combo
FROM (SELECT *, l_linenumber n, CAST(l_quantity AS INT) q FROM lineitem)""")
def _(t):
    n, q = C("l_linenumber"), C("l_quantity").cast("int")
    base = F.when(C("l_linestatus") == "F", "牙槽骨。").otherwise("")
    x = F.when(C("l_returnflag") == "A", text("牙齿缺失约 ", n, " 枚，", q, "颗牙折断")).when(C("l_returnflag") == "N", text("缺牙", q, "个")).otherwise("牙齿完好")
    x = F.concat(base, x)
    return t.lineitem.select("l_orderkey", "l_linenumber", ex.max_item_count(x).alias("teeth"), ex.has_item_combo(x).alias("combo"))


VOCAB = ["tion", "ment", "lich", "aux", "the", "word"]
PARENTS = {"ment": "word", "aux": "word", "the": "tion"}


@query("x09_term_sets", f"""
WITH a AS (SELECT doc_id, {hits_of('text', VOCAB)} f, contains(text,'ment') OR contains(text,'aux') OR contains(text,'word') w, contains(text,'the') OR contains(text,'tion') n FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(f || CASE WHEN w THEN ['word'] ELSE [] END || CASE WHEN n THEN ['tion'] ELSE [] END)),'|') AS terms,
 concat_ws('|', CASE WHEN n THEN 'tion' END, CASE WHEN list_contains(f,'lich') THEN 'lich' END, CASE WHEN w THEN 'word' END) AS ordered FROM a""")
def _(t):
    return t.documents.select(
        "doc_id", F.array_join(F.array_sort(ex.term_set(C("text"), VOCAB, PARENTS)), "|").alias("terms"),
        F.array_join(ex.ordered_terms(C("text"), VOCAB, PARENTS), "|").alias("ordered"),
    )


@query("x10_exam_titles", """
WITH a AS (SELECT *, CASE WHEN p_size > 40 THEN p_brand ELSE concat_ws('、', CASE WHEN contains(p_name,'ring') THEN 'ring' END, CASE WHEN contains(p_name,'bolt') THEN 'bolt' END) END part0 FROM part),
b AS (SELECT *, CASE WHEN part0 <> '' THEN part0 WHEN contains(p_name,'anvil') THEN '检验报告' ELSE '检查报告' END part1 FROM a),
c AS (SELECT *, CASE WHEN part1 = '检验报告' THEN '检验' WHEN p_type IN ('LARGE','SMALL') THEN p_type WHEN contains(p_name,'red') THEN 'R' WHEN contains(p_name,'blue') THEN 'blue' ELSE CASE WHEN p_type = 'PROMO' THEN '影像学检查' ELSE '检查报告' END END kind FROM b)
SELECT p_partkey, part1 AS part, kind, CASE WHEN part1 = '检验报告' THEN part1 WHEN part1 = '检查报告' THEN kind ELSE part1 || CASE WHEN kind IN ('检查报告','检验') THEN '' ELSE kind END END AS title FROM c""")
def _(t):
    kind = F.when(C("p_type").isin("LARGE", "SMALL"), C("p_type")).when(C("p_type") == "PROMO", "影像学检查").otherwise(" ")
    d = t.part.withColumn("kind0", kind).withColumn("part", ex.infer_part(F.when(C("p_size") > 40, C("p_brand")), C("kind0"), F.lit(None).cast("string"), C("p_name"), ["ring", "bolt"], {}, ["anvil"]))
    d = d.withColumn("kind", ex.normalize_type(C("kind0"), C("p_name"), C("part"), ["red", "blue"], {"red": "R"}))
    return d.select("p_partkey", "part", "kind", ex.compose_title(C("part"), C("kind")).alias("title"))


@query("x11_merge_flags", "SELECT doc_id, concat_ws('|', lang, source, CASE WHEN lang <> 'en' THEN 'en' END) AS flags FROM documents")
def _(t):
    r = ex.merge_flags(F.array(C("lang"), F.lit("")), F.array(C("source"), C("lang"), F.lit(None)), F.lit(None).cast("array<string>"), F.array(F.lit("en")))
    return t.documents.select("doc_id", F.array_join(r, "|").alias("flags"))


@query("x12_bank_keywords", f"SELECT item_id, array_to_string(({hits_of('lower(text)', ['the', 'tion', 'inha', 'rest'])})[1:3],'|') AS found FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.array_join(ex.bank_keywords(C("text"), ["the", "tion", "inha", "rest"], 3), "|").alias("found"))


@query("x13_fact_time_key", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 1 WHEN '4-NOT SPECIFIED' THEN 8 ELSE 9 END AS BIGINT) AS prec,
 CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate,'%Y-%m-%d') || ' 08:05' WHEN '2-HIGH' THEN strftime(o_orderdate,'%Y-%m-%d') || ' 23:59'
 WHEN '3-MEDIUM' THEN strftime(o_orderdate,'%Y-%m-%d') || ' 23:59' WHEN '4-NOT SPECIFIED' THEN '约' || year(o_orderdate) || '-02-30' ELSE '9999-99-99 99:99' END AS sort FROM orders""")
def _(t):
    d, p = C("o_orderdate"), C("o_orderpriority")
    x = (
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd'T'08：05:30")).when(p == "2-HIGH", F.date_format(d, "yyyy年M月d日"))
        .when(p == "3-MEDIUM", F.date_format(d, "yyyyMMdd")).when(p == "4-NOT SPECIFIED", text("约", F.year(d), "-02-30")).otherwise(" ")
    )
    r = t.orders.select("o_orderkey", ex.fact_time_key(x).alias("k"))
    return r.select("o_orderkey", C("k.precision").alias("prec"), C("k.sort").alias("sort"))


@query("x14_age_on", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(year(l_shipdate) + 28 - year(o_orderdate) - CASE WHEN (month(l_shipdate), day(l_shipdate)) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END AS BIGINT) AS age
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    d = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    born = ex.extract_date(text("生于", F.year("o_orderdate"), F.date_format("o_orderdate", "年M月d日")))
    seen = ex.extract_date(text(F.year("l_shipdate") + 28, F.date_format("l_shipdate", "-MM-dd")))
    return d.select("l_orderkey", "l_linenumber", ex.age_on(born, seen).alias("age"))


@query("x15_elapsed_phrase", """
WITH a AS (SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN d < 0 THEN '' WHEN d < 30 THEN '伤后' || d || '日' WHEN d % 30 < 25 THEN '伤后' || (d // 30) || '个月余' ELSE '伤后' || (d // 30 + 1) || '个月' END AS phrase FROM a""")
def _(t):
    d = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    return d.select("l_orderkey", "l_linenumber", ex.elapsed_phrase(F.date_format("o_orderdate", "yyyy年M月d日"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("phrase"))


@query("x16_extract_json", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) END AS k,
 CASE event_type WHEN 'signup' THEN '模型输出不是 JSON 对象' ELSE 'status' END AS missing FROM events""")
def _(t):
    e, p = C("event_type"), C("props")
    x = F.when(e == "click", p).when(e == "view", text("Answer:\n```json\n", p, "\n``` {")).when(e == "error", text("so ", p, " it is")).when(e == "purchase", text("```", p, "```")).otherwise("no { answer }")
    d = t.events.select("event_id", ex.extract_json(x).alias("j"))
    return d.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"), F.array_join(ex.missing_fields(C("j"), ["k", "status"]), "|").alias("missing"))


@query("x17_int_list", """
SELECT event_id, CASE event_type WHEN 'click' THEN k || ',' || (CAST(k AS BIGINT) + 1) WHEN 'view' THEN k ELSE '' END AS ids FROM (SELECT *, regexp_extract(props,'([0-9]+)',1) k FROM events)""")
def _(t):
    k = F.get_json_object("props", "$.k")
    x = (
        F.when(C("event_type") == "click", text("[", k, ',"', k, '","x",null,', k.cast("bigint") + 1, "]"))
        .when(C("event_type") == "view", text("[", k, "]")).when(C("event_type") == "error", "bad").when(C("event_type") == "signup", C("props"))
    )
    return t.events.select("event_id", F.array_join(ex.int_list(x).cast("array<string>"), ",").alias("ids"))


@query("x18_truncate_input", """
WITH a AS (SELECT doc_id, trim(text,'@WC@') x FROM documents)
SELECT doc_id, length(x) > 4000 AS truncated, md5(CASE WHEN length(x) > 4000 THEN substring(x,1,4000) || chr(10) || chr(10) || '[... 输入过长，已截断 ...]' ELSE x END) AS digest FROM a""")
def _(t):
    d = t.documents.select("doc_id", truncate_input(C("text"), 4000).alias("r"))
    return d.select("doc_id", "r.truncated", F.md5("r.text").alias("digest"))


@query("x19_name_core", "SELECT s_suppkey, '阜' || regexp_replace(s_name,'[^A-Za-z0-9]','','g') || '县人民医院' AS key, '东阜县人民医院' AS core FROM supplier")
def _(t):
    key = ex.name_key(text(" 皋", C("s_name"), "*县 人民医院 "))
    core = ex.name_core(text("西医院", C("s_name"), "|东皋县人民 医院", C("s_nationkey")))
    return t.supplier.select("s_suppkey", key.alias("key"), core.alias("core"))


@query("x20_name_similarity", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(1 AS DOUBLE) WHEN 'O' THEN round(0.68 + 0.28 * 5 / 6, 9) ELSE CAST(0 AS DOUBLE) END AS score FROM orders""")
def _(t):
    a = text(C("o_orderkey"), " 东城县人民医院")
    b = F.when(C("o_orderstatus") == "F", "东城县人民 医院").when(C("o_orderstatus") == "O", "南县人民医院").otherwise(" ")
    return t.orders.select("o_orderkey", F.round(ex.name_similarity(a, b), 9).alias("score"))


@query("x21_page_info", """
SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'case1_ab' ELSE 'scan-2' END AS prefix, page_id AS number FROM pages""")
def _(t):
    first = F.when(C("url").like("https%"), text("case1_ab-", C("page_id"), ".PNG")).otherwise(C("url"))
    d = t.pages.select("page_id", ex.page_info(first, F.lit("x.png"), text("/data/up-1/scan-2-", C("page_id"), ".jpeg")).alias("r"))
    return d.select("page_id", "r.prefix", "r.number")


@query("x22_parse_heading", """
WITH a AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) i, string_split(text, chr(10)) l, lang FROM documents),
b AS (SELECT doc_id, i, lang, trim(l[i+1],'@WC@') x FROM a WHERE trim(l[i+1],'@WC@') <> ''),
c AS (SELECT doc_id, i, CASE lang WHEN 'en' THEN '5.' || i || '  ' || x WHEN 'fr' THEN '第3章 ' || x ELSE x END x, lang, x y FROM b)
SELECT doc_id, i AS pos, CASE WHEN length(x) > 120 THEN NULL WHEN lang = 'en' AND length(y) <= 90 THEN '5.' || i WHEN lang = 'fr' THEN '第3章' END AS code,
 CASE WHEN length(x) > 120 THEN NULL WHEN lang = 'en' AND length(y) <= 90 THEN y WHEN lang = 'fr' THEN y END AS title FROM c""")
def _(t):
    d = sp.explode_paragraphs(t.documents.select("doc_id", "lang", "text"))
    line = F.when(C("lang") == "en", text("5.", C("pos"), "  ", C("paragraph"))).when(C("lang") == "fr", text("第3章 ", C("paragraph"))).otherwise(C("paragraph"))
    d = d.select("doc_id", "pos", ex.parse_heading(line).alias("h"))
    return d.select("doc_id", "pos", "h.code", "h.title")


@query("x23_event_identity", """
SELECT doc_id, sha256(concat_ws(chr(1), lang, '', regexp_replace(substring(text,1,200),'@WS@+','','g')[1:80], source || ',' || doc_id)) AS identity FROM documents""")
def _(t):
    ids = F.array(C("source"), C("doc_id").cast("string"))
    return t.documents.select("doc_id", ex.event_identity(C("lang"), F.lit(None).cast("string"), F.substring("text", 1, 200), ids).alias("identity"))


# --- sources -----------------------------------------------------------------


@query("s01_scan_pages", "SELECT doc_id, length(text) AS chars FROM documents WHERE lang IN ('fr','de') AND text <> '' AND n_chars > 100")
def _(t):
    d = t.documents.select(C("doc_id").alias("page_id"), C("lang").alias("type"), "text", F.when(C("n_chars") > 100, "completed").otherwise("failed").alias("status"))
    return sp.scan_pages(d, ["fr", "de"]).select(C("page_id").alias("doc_id"), F.length("text").alias("chars"))


def work_table(t, df, name, fmt="parquet", keys=None):
    """A work table in the shared folder (a fresh one per run)."""
    path = work_path(t.spark, name)
    if keys:
        sp.write_partitioned(df, path, keys, fmt)
    else:
        df.write.format(fmt).save(path)
    return path


@query("s02_page_analysis", """
SELECT event_id, event_type <> 'error' AS has_text, CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE CAST(length('p' || user_id) AS BIGINT) END AS text_length,
 event_type AS kind, CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE) / 100 AS confidence FROM events""")
def _(t):
    side = t.events.select(
        C("event_id").cast("string").alias("classifier_version"), F.when(C("event_type") != "error", text("p", C("user_id"))).alias("ocr_text"),
        F.struct(C("event_type").alias("type"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence")).alias("prediction"),
    )
    # A side-car is one JSON document; here each holds the pages of 500 numbers.
    cars = side.groupBy(F.floor(C("classifier_version").cast("bigint") / 500).alias("car")).agg(F.to_json(F.collect_list(F.struct(*side.columns))).alias("value"))
    d = sp.read_page_analysis(t.spark, work_table(t, cars, "analysis", "text", ["car"]))
    return d.select(C("classifier_version").cast("bigint").alias("event_id"), "has_text", "text_length", C("prediction.type").alias("kind"), C("prediction.confidence").alias("confidence"))


@query("s03_list_pages", """
WITH f AS (SELECT page_id, 'case' || (page_id % 7) || '_' || regexp_extract(url,'/([a-z][a-z])/',1) p, 'case' || (page_id % 7) || '_' || regexp_extract(url,'/([a-z][a-z])/',1) || '-' || page_id || '.png' f FROM pages WHERE url LIKE 'https%')
SELECT f AS file_name, p AS prefix, page_id AS page_number, CASE WHEN contains(p,'_en') THEN 'scan' END AS source_type, l.doc_id IS NOT NULL AS imported, l.doc_id AS page_id
FROM f LEFT JOIN labels l ON l.doc_id = f.page_id""")
def _(t):
    lang = F.regexp_extract("url", "/([a-z][a-z])/", 1)
    name = lambda i: text("case", i % 7, "_", lang, "-", i, F.when(C("url").like("https%"), ".png").otherwise(".txt"))
    files = t.pages.select(name(C("page_id")).alias("file_name"))
    meta = t.pages.select(text("case", C("page_id") % 7, "_", lang).alias("prefix")).distinct().filter(F.contains("prefix", S("_en"))).withColumn("source_type", S("scan"))
    done = t.labels.join(t.pages, C("doc_id") == C("page_id")).select(name(C("page_id")).alias("file_name"), "page_id")
    return sp.list_pages(files, meta, done).select("file_name", "prefix", "page_number", "source_type", "imported", "page_id")


@query("s04_import_library", """
WITH f AS (SELECT d.doc_id, lang, n_chars, l.quality q, toxic, lang = 'de' doc FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang <> 'es')
SELECT CASE WHEN q IS NOT NULL AND q = 1 THEN 'protected' WHEN q IS NOT NULL THEN 'skipped' WHEN NOT doc AND n_chars < 300 THEN 'needs_ocr' WHEN n_chars > 1200 THEN 'imported' ELSE 'failed' END AS status,
 doc_id || CASE WHEN doc THEN '.docx' ELSE '.PDF' END AS file_name, CASE WHEN q IS NOT NULL THEN doc_id END AS doc_id FROM f""")
def _(t):
    ext = F.when(C("lang") == "de", "docx").when(C("lang") == "es", "txt").otherwise("PDF")
    d = t.documents.withColumn("path", text("/lib/", C("source"), "/", C("doc_id"), ".", ext))
    files = d.select("path", F.lit(10).alias("pages"), C("n_chars").alias("chars"), F.floor(C("n_chars") / 1201).alias("chunks"))
    known = d.join(t.labels, "doc_id").select(
        "doc_id", F.when(C("toxic") == 1, S("/moved")).otherwise(C("path")).alias("path"), text(C("doc_id"), ".", ext).alias("file_name")
    )
    stats = t.labels.select("doc_id", (C("quality") == 1).alias("protected"))
    return sp.import_library(files, known, stats).select("file_name", "doc_id", "status")


@query("s05_round_trip", "SELECT lang, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def _(t):
    path = work_table(t, t.documents, "by_lang", "parquet", ["lang"])
    sp.write_partitioned(t.documents.filter(C("lang") == "de"), path, ["lang"])
    return t.spark.read.parquet(path).groupBy("lang", "source").agg(F.count(S(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s06_tail_log", """
WITH a AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 400)
SELECT event_id AS line_no, strftime(ts,'%Y-%m-%d %H:%M:%S') AS logged_at, 'ERROR' AS level, 'user.' || user_id AS logger, props AS message FROM a WHERE event_type = 'error'""")
def _(t):
    level = F.when(C("event_type") == "error", "ERROR").otherwise("INFO")
    line = text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " [", level, "] user.", C("user_id"), ": ", C("event_id"), " ", C("props"))
    path = work_table(t, t.events.repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")), "log", "text")
    d = sp.tail_log(read_log_tail(t.spark, path, 400), 400, "error")
    number = F.substring_index("message", " ", 1)
    return d.select(number.cast("bigint").alias("line_no"), "logged_at", "level", "logger", F.substr("message", F.length(number) + 2).alias("message"))


@query("s07_pivot_settings", """
SELECT max(CASE WHEN n_name = 'NATION_3' THEN r_name END) AS "NATION_3", max(CASE WHEN n_name = 'NATION_7' THEN 'changed' END) AS "NATION_7", '' AS other FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    kv = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).select(C("n_name").alias("key"), C("r_name").alias("value"))
    new = kv.filter(C("key") == "NATION_7").select("key", S("changed").alias("value"))
    return sp.pivot_settings(sp.upsert_settings(kv, new), ["NATION_3", "NATION_7", "other"])


@query("s08_append_numbered", """
WITH e AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_orderkey k, count(*) n FROM e GROUP BY 1),
n AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) rn FROM lineitem WHERE l_returnflag <> 'A')
SELECT l_orderkey, l_partkey, CAST(NULL AS BIGINT) AS page_number, NULL::VARCHAR AS description FROM e
UNION ALL SELECT l_orderkey, l_partkey, rn + COALESCE(b.n,0), '第' || (rn + COALESCE(b.n,0)) FROM n LEFT JOIN b ON k = l_orderkey""")
def _(t):
    cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]
    old = t.lineitem.filter(C("l_returnflag") == "A").select(*cols)
    new = t.lineitem.filter(C("l_returnflag") != "A").select(*cols)
    order = [C("l_linenumber"), C("l_partkey"), C("l_extendedprice")]
    r = sp.append_numbered(old, new, ["l_orderkey"], order, C("l_linenumber"), label="第")
    return r.select("l_orderkey", "l_partkey", "page_number", "description")


@query("s09_list_children", """
SELECT l_orderkey, l_partkey, l_shipdate::DATE::VARCHAR AS shipped FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(t):
    rows = t.lineitem.select(C("l_orderkey").alias("case_id"), C("l_returnflag").alias("type"), "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    wanted = t.orders.filter(C("o_orderpriority") == "1-URGENT").select(C("o_orderkey").alias("case_id"))
    return sp.list_children(rows, wanted, kind="R", order=[C("case_id"), C("shipped"), C("l_partkey")]).select(C("case_id").alias("l_orderkey"), "l_partkey", "shipped")
