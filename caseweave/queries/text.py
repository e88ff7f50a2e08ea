"""P01-P24 over the given tables."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions import text as tx
from caseweave.functions.extract import int_list, page_info
from caseweave.plans.facts import fact_output
from caseweave.queries.registry import query
from caseweave.sources.pages import source_payload

C = F.col


def digest(c, name="digest"):
    return [F.md5(c).alias(name), F.length(c).cast("bigint").alias("chars")]


UNESC = "replace(replace(replace(replace(replace(replace(replace(replace(html,'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&nbsp;',' '),'&copy;','©'),'&middot;','·'),'&amp;','&')"


@query("p01_clean_ocr", f"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace({UNESC}, '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '<[^>]+>', ' ', 'g') x FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace(x,'|',' '), '@WS@+', ' ', 'g'), '@WC@') x FROM a)
SELECT page_id, md5(x) AS digest, length(x) AS chars FROM b""")
def _(t):
    return t.pages.select("page_id", tx.clean_ocr(C("html")).alias("x")).select("page_id", *digest(C("x")))


@query("p02_compact_text", """
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(replace(html,'<nl>',chr(10)), '!\\[[^\\]]*\\]\\([^)]+\\)', ' 图片 ', 'g'), '<[^>]+>', ' ', 'g') x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '#+', ' ', 'g'), '@WS@+', '', 'g') x,
 trim(regexp_replace(regexp_replace(replace(x,'&nbsp;',' '), '#+', ' ', 'g'), '@WS@+', ' ', 'g'), '@WC@') y FROM a)
SELECT page_id, md5(x) AS digest, length(x) AS chars, md5(y) AS spaced FROM b""")
def _(t):
    d = t.pages.select("page_id", tx.compact_text(C("html")).alias("x"), tx.compact_text(C("html"), keep_space=True).alias("y"))
    return d.select("page_id", *digest(C("x")), F.md5("y").alias("spaced"))


@query("p03_normalize_text", """
WITH a AS (SELECT doc_id, source || chr(13) || chr(10) || '- 12 -' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || text x FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '\\r\\n|\\r|\\f', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10)||chr(10), 'g') x FROM a),
c AS (SELECT doc_id, trim(regexp_replace(x, '(?m)^[—\\-－]@WS@*[0-9]+@WS@*[—\\-－]@WS@*$', '', 'g'), '@WC@') x FROM b)
SELECT doc_id, md5(x) AS digest, length(x) AS chars FROM c""")
def _(t):
    x = F.concat(C("source"), F.lit("\r\n- 12 -\r\n\n\n\n"), C("text"))
    return t.documents.select("doc_id", tx.normalize_text(x).alias("x")).select("doc_id", *digest(C("x")))


@query("p04_strip_artifacts", """
WITH a AS (SELECT page_id, '<DIV class="i"> ![f](a.png) </DIV>☐ ' || html || ' ![g](b.png)' || chr(10) || ' ☑ 🔄 end' x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '\\r\\n|\\r|\\f', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10)||chr(10), 'g') x FROM a),
c AS (SELECT page_id, trim(regexp_replace(x, '(?m)^[—\\-－]@WS@*[0-9]+@WS@*[—\\-－]@WS@*$', '', 'g'), '@WC@') x FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<div[^>]*>@WS@*!\\[[^\\]]*\\]\\([^)]+\\)@WS@*</div>', '', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g') x FROM c),
e AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '[☐☑🔄]', '', 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{3,}', chr(10)||chr(10), 'g'), '@WC@') x FROM d)
SELECT page_id, md5(x) AS digest, length(x) AS chars FROM e""")
def _(t):
    x = F.concat(F.lit('<DIV class="i"> ![f](a.png) </DIV>☐ '), C("html"), F.lit(" ![g](b.png)\n ☑ 🔄 end"))
    return t.pages.select("page_id", tx.strip_artifacts(x).alias("x")).select("page_id", *digest(C("x")))


@query("p05_trim_phrase", """
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('：、' || text || '；。 ', '!\\[[^\\]]*\\]\\([^)]+\\)', ' 图片 ', 'g'), '<[^>]+>', ' ', 'g'), '#+', ' ', 'g'), '@WS@+', '', 'g') x FROM documents),
b AS (SELECT doc_id, rtrim(ltrim(x, '：:；;，,。、'), '；;，,。、') x FROM a)
SELECT doc_id, md5(x) AS digest, length(x) AS chars FROM b""")
def _(t):
    x = F.concat(F.lit("：、"), C("text"), F.lit("；。 "))
    return t.documents.select("doc_id", tx.trim_phrase(x).alias("x")).select("doc_id", *digest(C("x")))


@query("p06_clip_variants", """
WITH a AS (SELECT doc_id, trim(text,'@WC@') s, trim(regexp_replace(text,'@WS@+',' ','g'),'@WC@') k FROM documents),
b AS (SELECT doc_id, CASE WHEN length(s) <= 600 THEN s ELSE rtrim(substring(s,1,600),'@WC@') || '...' END e,
 trim(substring(nullif(trim(k,' ：:;；。'),''),1,260),'@WC@') n, substring(k,1,180) h FROM a)
SELECT doc_id, md5(e) AS ellipsis_digest, md5(n) AS or_null_digest, md5(h) AS hard_digest, length(e) AS chars FROM b""")
def _(t):
    d = t.documents.select("doc_id", tx.clip_ellipsis(C("text"), 600).alias("e"), tx.clip_or_null(C("text"), 260).alias("n"), tx.clip_hard(C("text"), 180).alias("h"))
    return d.select("doc_id", F.md5("e").alias("ellipsis_digest"), F.md5("n").alias("or_null_digest"), F.md5("h").alias("hard_digest"), F.length("e").alias("chars"))


@query("p07_join_parts", """
WITH a AS (SELECT doc_id, lang p1, trim(text,'@WC@') p2, source || ';' p3 FROM documents)
SELECT doc_id, md5(p1 || '。' || CASE WHEN p2 = '' THEN '' WHEN right(p2,1) IN ('。','；',';') THEN p2 ELSE p2 || '。' END || p3) AS sentences,
 md5(concat_ws(chr(10), p1, nullif(p2,''), p3)) AS lines FROM a""")
def _(t):
    parts = [C("lang"), F.lit("  "), C("text"), F.concat(C("source"), F.lit("; "))]
    return t.documents.select("doc_id", F.md5(tx.join_sentences(*parts)).alias("sentences"), F.md5(tx.join_nonempty("\n", *parts)).alias("lines"))


@query("p08_title_from_filename", """
WITH a AS (SELECT page_id, regexp_extract('/lib/12. ' || regexp_replace(url, '[^a-z0-9]+', '_', 'g') || '+v 1.pdf', '([^/\\\\]*)$', 1) f FROM pages),
b AS (SELECT page_id, trim(replace(regexp_replace(f, '^(.+)\\.[^.]+$', '\\1'), '+', ' '), '@WC@') x FROM a)
SELECT page_id, trim(replace(regexp_replace(regexp_replace(x, '^[0-9]+\\.@WS@*', ''), '@WS@*1$', ''), '_', ' '), '@WC@') AS title FROM b""")
def _(t):
    f = F.concat(F.lit("/lib/12. "), F.regexp_replace("url", "[^a-z0-9]+", "_"), F.lit("+v 1.pdf"))
    return t.pages.select("page_id", tx.title_from_filename(f).alias("title"))


@query("p09_clean_generated", """
WITH a AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '<think a="1">plan' || chr(10) || 'x</think>' || chr(10) || '```md' || chr(10) || '- ' || text || chr(10) || '```'
  WHEN 'user' THEN '<think>open ' || text || ' OPEN: ' || text ELSE '* ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'end' END x, role FROM conversations),
b AS (SELECT conv_id, turn, role, trim(regexp_replace(x, '(?is)<think\\b[^>]*>.*?</think>', '', 'g'), '@WC@') x FROM a),
c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim(regexp_extract(x, '(?s)(OPEN:.*)$', 1), '@WC@')
   WHEN x LIKE '```%' THEN trim(regexp_replace(regexp_replace(x, '^```[^\\n]*(?:\\n|$)', ''), '(?:^|\\n)@WS@*```$', ''), '@WC@') ELSE x END x FROM b),
d AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '(?m)^@WS@*[-*]@WS@+', '', 'g'), '\\n{3,}', chr(10)||chr(10), 'g'), '@WC@') x FROM c)
SELECT conv_id, turn, md5(x) AS digest, length(x) AS chars FROM d""")
def _(t):
    x = (
        F.when(C("role") == "assistant", F.concat(F.lit('<think a="1">plan\nx</think>\n```md\n- '), C("text"), F.lit("\n```")))
        .when(C("role") == "user", F.concat(F.lit("<think>open "), C("text"), F.lit(" OPEN: "), C("text")))
        .otherwise(F.concat(F.lit("* "), C("text"), F.lit("\n\n\n\nend")))
    )
    d = t.conversations.select("conv_id", "turn", tx.clean_generated(x, ["OPEN:"]).alias("x"))
    return d.select("conv_id", "turn", *digest(C("x")))


@query("p10_replace_aliases", """
SELECT doc_id, md5(replace(replace(replace(text,'erent','NAME'),'tion','NAME'),'the','NAME')) AS digest,
 length(replace(replace(replace(text,'erent','NAME'),'tion','NAME'),'the','NAME')) AS chars FROM documents""")
def _(t):
    aliases = F.array(*[F.lit(a) for a in ("the", "tion", "erent", "is", "NAME")])
    return t.documents.select("doc_id", tx.replace_aliases(C("text"), aliases, F.lit("NAME")).alias("x")).select("doc_id", *digest(C("x")))


@query("p11_normalize_summary", """
SELECT doc_id, md5('（一）据' || source || '住院病历记载：' || text || lang) AS digest FROM documents""")
def _(t):
    x = F.concat(F.lit("据"), C("source"), F.lit("住院病案记载："), C("text"), F.lit("（ 来源页：1, 2）(来源页: 3)"), C("lang"))
    return t.documents.select("doc_id", F.md5(tx.normalize_summary(x)).alias("digest"))


@query("p12_drop_blocks", """
SELECT p_partkey, CASE WHEN p_size > 40 OR p_type <> 'PROMO'
  THEN '1. ' || p_name || chr(10) || '2. extra cost ' || p_brand || chr(10) || '3. ' || CASE p_type WHEN 'PROMO' THEN 'extra cost ' ELSE 'none ' END || p_name || chr(10) || '4. end'
  ELSE '1. ' || p_name || chr(10) || chr(10) || '2. extra cost ' || p_brand || chr(10) || chr(10) || '4. end' END AS kept,
 (p_size <= 40 AND p_type = 'PROMO') AS dropped
FROM part WHERE p_size > 40 OR p_type = 'PROMO'
UNION ALL
SELECT p_partkey, '1. ' || p_name || chr(10) || chr(10) || '2. extra cost ' || p_brand || chr(10) || chr(10) || '3. none ' || p_name || chr(10) || chr(10) || '4. end', false
FROM part WHERE p_size <= 40 AND p_type <> 'PROMO'""")
def _(t):
    x = F.concat(F.lit("1. "), C("p_name"), F.lit("\n2. extra cost "), C("p_brand"), F.lit("\n3. "),
                 F.when(C("p_type") == "PROMO", "extra cost ").otherwise("none "), C("p_name"), F.lit("\n4. end"))
    d = t.part.select("p_partkey", tx.drop_blocks(x, ["extra cost"], C("p_size") > 40).alias("r"))
    return d.select("p_partkey", C("r.text").alias("kept"), C("r.dropped").alias("dropped"))


@query("p13_explode_paragraphs", """
WITH a AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents),
b AS (SELECT doc_id, l, unnest(range(0, len(l))) i FROM a)
SELECT doc_id, i AS pos, md5(trim(l[i+1], '@WC@')) AS digest FROM b WHERE trim(l[i+1], '@WC@') <> ''""")
def _(t):
    from caseweave.sources.pages import explode_paragraphs

    return explode_paragraphs(t.documents.select("doc_id", "text")).select("doc_id", "pos", F.md5("paragraph").alias("digest"))


@query("p14_with_label", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS label FROM orders")
def _(t):
    return t.orders.select("o_orderkey", tx.label_of(C("o_orderstatus"), {"O": "open", "F": "finished"}).alias("label"))


@query("p15_normalize_request", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '对' || c_name || '的伤残等级进行鉴定'
 WHEN c_mktsegment = 'MACHINERY' THEN '对' || c_name || '进行鉴定'
 WHEN c_mktsegment = 'FURNITURE' THEN '对' || c_name || '的护理期限鉴定'
 ELSE '对' || c_name || '的' || lower(c_mktsegment) || '进行鉴定' END AS request FROM customer""")
def _(t):
    x = (
        F.when(C("c_mktsegment") == "BUILDING", F.lit("请求委托鉴定机构对申请人的伤残等级进行鉴定。"))
        .when(C("c_mktsegment") == "MACHINERY", F.lit(" ；"))
        .when(C("c_mktsegment") == "FURNITURE", F.lit("伤者的护理期限鉴定"))
        .otherwise(F.lower("c_mktsegment"))
    )
    return t.customer.select("c_custkey", tx.normalize_request(x, C("c_name")).alias("request"))


@query("p16_split_items", """
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_items, md5(array_to_string(l, '|')) AS digest FROM (
 SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[；;，,、]'), lambda x: trim(x, '@WC@')), lambda x: x <> '') l FROM documents)""")
def _(t):
    return t.documents.select("doc_id", tx.split_items(C("text")).alias("l")).select("doc_id", F.size("l").alias("n_items"), F.md5(F.array_join("l", "|")).alias("digest"))


@query("p17_numerals", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS qty,
 COALESCE(['零','壹','贰','叁','肆','伍','陆','柒','捌','玖','拾'][CAST(l_quantity AS INT) + 1], CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS numeral,
 COALESCE(['（一）','（二）','（三）','（四）','（五）','（六）','（七）','（八）','（九）','（十）'][CAST(l_quantity AS INT)], '（' || CAST(l_quantity AS INT) || '）') AS section FROM lineitem""")
def _(t):
    q = C("l_quantity").cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", q.alias("qty"), tx.to_numeral(q).alias("numeral"), tx.section_no(q).alias("section"))


@query("p18_split_clause_label", """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN '附录A.' || p_size ELSE '5.' || p_size || '.' || p_partkey END AS code,
 p_name AS title FROM part""")
def _(t):
    x = (
        F.when(C("p_type") == "PROMO", C("p_name"))
        .when(C("p_type") == "SMALL", F.concat(F.lit("附录 A."), C("p_size").cast("string"), F.lit(" "), C("p_name")))
        .otherwise(F.concat(F.lit("5."), C("p_size").cast("string"), F.lit("."), C("p_partkey").cast("string"), F.lit("  "), C("p_name")))
    )
    d = t.part.select("p_partkey", tx.split_clause_label(x).alias("r"))
    return d.select("p_partkey", C("r.code").alias("code"), C("r.title").alias("title"))


@query("p19_display_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y年%m月%d日') AS shown, strftime(o_orderdate, '%Y年%m月%d日') AS birth FROM orders")
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", tx.display_date(F.concat(iso, F.lit(" 08:30"))).alias("shown"), tx.birth_text(iso).alias("birth"))


@query("p20_public_path", "SELECT page_id, CASE WHEN position('/example' IN replace(url,'.','/')) > 0 THEN substring(replace(url,'.','/'), position('/example' IN replace(url,'.','/'))) END AS path FROM pages")
def _(t):
    return t.pages.select("page_id", tx.public_path(F.translate("url", ".", "\\"), "/example").alias("path"))


@query("p21_effective_text", """
SELECT d.doc_id, md5(CASE WHEN l.quality = 1 THEN 'reviewed ' || d.lang ELSE COALESCE(d.text,'') END) AS digest
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    status = F.when(C("quality") == 1, "completed").when(C("quality") == 0, "failed")
    return d.select("doc_id", F.md5(tx.effective_text(status, F.concat(F.lit("reviewed "), C("lang")), C("text"))).alias("digest"))


@query("p22_source_payload", """
WITH s AS (SELECT source, doc_id, 'case' || substring(source,4) || '_' || lang || '-' || doc_id || '.png' AS fname, n_chars,
  row_number() OVER (PARTITION BY source ORDER BY 'case' || substring(source,4) || '_' || lang, doc_id) rn, count(*) OVER (PARTITION BY source) n FROM documents)
SELECT source, doc_id AS source_id, fname AS source_file, doc_id AS original_page, '/uploads/' || fname AS url, n AS source_count FROM s WHERE rn = 1""")
def _(t):
    pages = t.documents.select(
        C("doc_id").alias("page_id"), C("source").alias("group_id"), F.lit(None).cast("int").alias("page_number"),
        F.concat(F.lit("case"), F.substring("source", 4, 9), F.lit("_"), C("lang"), F.lit("-"), C("doc_id").cast("string"), F.lit(".png")).alias("file_name"),
    ).withColumn("path", F.concat(F.lit("C:\\data\\uploads\\"), C("file_name"))).withColumn("path", F.translate("path", "\\", "/"))
    groups = t.documents.select(C("source").alias("group_id")).distinct()
    r = source_payload(groups, pages)
    return r.select(C("group_id").alias("source"), "source_id", "source_file", "original_page", "url", "source_count")


@query("p23_first_name", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority WHEN c.c_mktsegment = 'BUILDING' THEN '被鉴定人' ELSE c.c_name END AS name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def _(t):
    d = t.orders.join(t.customer, C("o_custkey") == C("c_custkey"), "left")
    given = F.when(C("o_orderpriority") == "1-URGENT", C("o_orderpriority")).otherwise(" ")
    person = F.when(C("c_mktsegment") != "BUILDING", C("c_name"))
    return d.select("o_orderkey", tx.first_name(given, person, F.lit("")).alias("name"))


@query("p24_fact_output", """
SELECT event_id AS id, event_type AS fact_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR) AS pages, 1 AS n_flags FROM events""".replace("1 AS n_flags", "CAST(1 AS BIGINT) AS n_flags"))
def _(t):
    k = F.get_json_object("props", "$.k")
    facts = t.events.select(
        C("event_id").alias("fact_id"), C("user_id").alias("case_id"), C("event_type").alias("fact_type"),
        F.concat(F.lit("["), k, F.lit(',"x",'), k, F.lit("]")).alias("source_pages"), F.lit("not json").alias("source_ids"),
        F.lit('["auto"]').alias("flags"), C("ts").alias("created_at"),
    )
    r = fact_output(facts)
    return r.select(C("fact_id").alias("id"), "fact_type", "created_at", F.array_join(C("source_pages").cast(T.ArrayType(T.StringType())), ",").alias("pages"), F.size("flags").alias("n_flags"))
