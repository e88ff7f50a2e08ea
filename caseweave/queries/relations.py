"""J01-J16 over the given tables."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.operators import joins as jo
from caseweave.operators.keywords import match_terms
from caseweave.queries.predicates import any_of
from caseweave.queries.registry import query

C = F.col
S = lambda x: F.lit(x)
BIGS = T.ArrayType(T.LongType())


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def joined(c, sep=","):
    return F.array_join(c.cast("array<string>"), sep)


@query("j01_canonical_name", """
SELECT o_orderkey, COALESCE(CASE WHEN c.c_mktsegment = 'BUILDING' THEN NULL ELSE c.c_name END, o_orderpriority) AS org FROM orders LEFT JOIN customer c ON o_custkey = c_custkey""")
def _(t):
    rows = t.orders.select("o_orderkey", C("o_custkey").alias("group_id"), C("o_orderpriority").alias("org"))
    groups = t.customer.select(C("c_custkey").alias("group_id"), F.when(C("c_mktsegment") == "BUILDING", "").otherwise(C("c_name")).alias("name"))
    return jo.canonical_name(rows, groups).select("o_orderkey", "org")


def order_pages(t):
    """Line items as pages: page id from the two keys, number null for one line status."""
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_linestatus").alias("s")).select(
        (C("l_orderkey") * 10 + C("l_linenumber")).alias("page_id"), C("l_orderkey").alias("group_id"), F.when(C("s") == "O", C("l_linenumber")).alias("page_number"), "q"
    )


PAGES = "pg AS (SELECT l_orderkey * 10 + l_linenumber page_id, l_orderkey g, CASE WHEN max(l_linestatus) = 'O' THEN l_linenumber END num FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("j02_resolve_sources", f"""
WITH {PAGES},
byg AS (SELECT g, count(*) n, string_agg(page_id::VARCHAR, ',' ORDER BY num NULLS LAST, page_id) ids, string_agg(num::VARCHAR, ',' ORDER BY num NULLS LAST, page_id) nums FROM pg GROUP BY g),
ids AS (SELECT o_orderkey, unnest([o_orderkey*10+3, o_orderkey*10+1, -1]) id, unnest([0,1,2]) pos FROM orders WHERE o_orderstatus = 'F'),
byid AS (SELECT o_orderkey, string_agg(num::VARCHAR, ',' ORDER BY pos) nums FROM ids JOIN pg ON id = page_id GROUP BY 1)
SELECT o.o_orderkey AS fact_id, CASE o_orderstatus WHEN 'F' THEN 'ids' WHEN 'O' THEN 'group' ELSE 'page' END AS scope,
 CASE o_orderstatus WHEN 'F' THEN (o.o_orderkey*10+3) || ',' || (o.o_orderkey*10+1) || ',-1' WHEN 'O' THEN COALESCE(byg.ids,'') ELSE COALESCE(p.page_id::VARCHAR,'') END AS ids,
 COALESCE(CASE o_orderstatus WHEN 'F' THEN byid.nums WHEN 'O' THEN byg.nums ELSE p.num::VARCHAR END,'') AS pages,
 CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN COALESCE(byg.n,0) ELSE CASE WHEN p.page_id IS NULL THEN 0 ELSE 1 END END::BIGINT AS n_sources
FROM orders o LEFT JOIN byg ON g = o.o_orderkey LEFT JOIN byid ON byid.o_orderkey = o.o_orderkey LEFT JOIN pg p ON p.page_id = o.o_orderkey*10+2""")
def _(t):
    k, s = C("o_orderkey"), C("o_orderstatus")
    facts = t.orders.select(
        k.alias("fact_id"), F.when(s == "F", F.array(k * 10 + 3, k * 10 + 1, k * 10 + 3, S(-1).cast("bigint"))).alias("source_ids"),
        F.lit(None).cast("array<int>").alias("source_pages"), F.when(s == "O", k).alias("group_id"), (k * 10 + 2).alias("page_id"),
    )
    r = jo.resolve_sources(facts, order_pages(t))
    return r.select("fact_id", C("source_scope").alias("scope"), joined(C("source_ids")).alias("ids"), joined(C("source_pages")).alias("pages"), "n_sources")


@query("j02_group_sources", f"""
WITH {PAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY num NULLS LAST, page_id) - 1 rn FROM pg)
SELECT g AS group_id, rn // 2 AS part, string_agg(page_id::VARCHAR, ',' ORDER BY rn) AS ids FROM r GROUP BY 1, 2""")
def _(t):
    return jo.group_sources(order_pages(t), size=2).select("group_id", "part", joined(C("page_ids")).alias("ids"))


@query("j03_related_reports", """
WITH e AS (SELECT event_id, user_id, event_type, strftime(ts,'%Y-%m-%d') d, CASE WHEN value > 60 THEN 'org' || (event_id % 3) ELSE '' END org FROM events),
r AS (SELECT event_id rid, user_id, event_type, CASE WHEN event_type = 'error' THEN '' ELSE d END d, org, 'T' || (rid % 4) title FROM e WHERE event_type <> 'click'),
m AS (SELECT e.event_id, r.d rd, r.title, r.rid, row_number() OVER (PARTITION BY e.event_id ORDER BY CASE WHEN r.d = e.d THEN 0 ELSE 1 END, CASE WHEN r.d = '' THEN '9999-99-99' ELSE r.d END, r.title, r.rid) rn
 FROM e JOIN r ON e.user_id = r.user_id AND (e.event_type = r.event_type OR (e.event_type = 'click' AND r.event_type IN ('view','error'))) AND (e.org = '' OR r.org = '' OR e.org = r.org))
SELECT e.event_id, COALESCE(string_agg(m.rd || m.title || '（来源页' || m.rid || '）', '；' ORDER BY rn),'') AS related FROM e LEFT JOIN m ON e.event_id = m.event_id AND rn <= 3 GROUP BY 1""")
def _(t):
    e = t.events.select(
        "event_id", C("user_id").alias("case_id"), F.when(C("value") > 60, text("org", C("event_id") % 3)).otherwise("").alias("org"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(C("event_type") == "click", F.array(S("view"), S("error"))).otherwise(F.array("event_type")).alias("terms"), "event_type",
    )
    r = e.filter(C("event_type") != "click").select(
        C("event_id").alias("report_id"), "case_id", "org", F.when(C("event_type") == "error", "").otherwise(C("day")).alias("day"), text("T", C("event_id") % 4).alias("title"),
        F.array(C("event_type")).alias("terms"), F.array(C("event_id")).alias("pages"),
    )
    return jo.related_reports(e, r).select("event_id", "related")


@query("j04_canonicalize", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '未识别医院' WHEN o_orderpriority = '2-HIGH' THEN '甲' || n_name WHEN o_orderpriority = '3-MEDIUM' THEN '东城' || (c_nationkey % 5) || '区县中心医院'
  WHEN o_orderpriority = '5-LOW' THEN '诊所' || c_custkey ELSE '东城' || (c_nationkey % 5) || '区县中心医院' END AS canonical,
 o_orderpriority IN ('2-HIGH','3-MEDIUM','4-NOT SPECIFIED') AS matched
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    d = t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).join(t.nation, C("c_nationkey") == C("n_nationkey"))
    p, good = C("o_orderpriority"), text("东城", C("c_nationkey") % 5, "区县中心医院")
    name = (
        F.when(p == "1-URGENT", S(" ")).when(p == "2-HIGH", text("甲别名", C("n_nationkey"))).when(p == "3-MEDIUM", text("西城|", C("c_nationkey") % 5, "区县中心 医院"))
        .when(p == "5-LOW", text("诊所", C("c_custkey"))).otherwise(good)
    )
    rows = d.select("o_orderkey", C("n_nationkey").alias("case_id"), name.alias("name"))
    aliases = t.nation.select(C("n_nationkey").alias("case_id"), text("甲别名", C("n_nationkey")).alias("alias"), text("甲", C("n_name")).alias("canonical"))
    confirmed = t.nation.select(C("n_nationkey").alias("case_id"), text("东城", C("n_nationkey") % 5, "区县中心医院").alias("name"), S(2).alias("ord")).unionByName(
        t.nation.select(C("n_nationkey").alias("case_id"), S("丙丁卫生院").alias("name"), S(1).alias("ord"))
    )
    return jo.canonicalize(rows, aliases, confirmed).select("o_orderkey", "canonical", "matched")


SPECS = [
    {"spec_id": "a", "include": ["tion", "lich"], "require_any": ["the", "und"]},
    {"spec_id": "b", "include": ["aux"], "require_any": []},
    {"spec_id": "c", "include": ["ción", "ment"], "require_any": ["que"]},
]
J05 = "\nUNION ALL ".join(
    f"SELECT doc_id, '{s['spec_id']}' AS spec_id FROM documents WHERE {any_of('text', s['include'])}" + (f" AND {any_of('text', s['require_any'])}" if s["require_any"] else "") for s in SPECS
)


@query("j05_match_evidence", J05)
def _(t):
    return jo.match_evidence(t.documents, SPECS).select("doc_id", "spec_id")


@query("j05_match_spec_table", "SELECT d.doc_id, n_name AS spec_id FROM documents d JOIN nation ON contains(d.text, n_regionkey || (n_nationkey % 7)::VARCHAR) AND (n_nationkey > 12 OR contains(d.text, '.' || n_regionkey::VARCHAR))")
def _(t):
    specs = t.nation.select(
        C("n_name").alias("spec_id"), F.array(text(C("n_regionkey"), C("n_nationkey") % 7)).alias("include"),
        F.when(C("n_nationkey") > 12, F.array().cast("array<string>")).otherwise(F.array(text(".", C("n_regionkey")))).alias("require_any"),
    )
    return jo.match_evidence_table(t.documents, specs, "doc_id")


MAPPING = [("tion", ["That", "Inha"]), ("ment", []), ("the", ["inenan"]), ("lich", ["zzz"])]


@query("j06_map_items", """
WITH i AS (SELECT DISTINCT p_name || ' ' || CASE p_type WHEN 'PROMO' THEN 'tion' WHEN 'SMALL' THEN 'the ment' WHEN 'LARGE' THEN 'lich' ELSE 'x' END item FROM part),
m AS (SELECT item, item_id FROM i JOIN benchmark ON (contains(item,'tion') AND (contains(text,'That') OR contains(text,'Inha'))) OR (contains(item,'the') AND contains(text,'inenan')))
SELECT i.item, item_id AS doc_id FROM i LEFT JOIN m ON i.item = m.item""")
def _(t):
    tail = F.when(C("p_type") == "PROMO", "tion").when(C("p_type") == "SMALL", "the ment").when(C("p_type") == "LARGE", "lich").otherwise("x")
    items = t.part.select(text(C("p_name"), " ", tail).alias("item"))
    docs = t.benchmark.select(C("item_id").alias("doc_id"), C("text").alias("title"), F.lit(None).cast("string").alias("file_name"))
    return jo.map_items_to_docs(items, MAPPING, docs)


CLAUSES = [
    {"key": "k1", "name": "doc1", "terms": ["tion", "inha", "rest"], "grade": "the", "label": "first"},
    {"key": "k2", "name": "doc", "terms": ["whst", "zzz"], "grade": "", "label": "second"},
    {"key": "k3", "name": "doc9", "terms": ["tion"], "grade": "", "label": "third"},
]


@query("j07_resolve_clause", """
WITH c AS (SELECT item_id, 'doc' || (item_id // 8) d, text FROM benchmark),
s AS (SELECT 'k1' k, item_id, 12*(contains(text,'tion')::INT + contains(text,'inha')::INT + contains(text,'rest')::INT) + 5*contains(text,'the')::INT score FROM c WHERE contains(d,'doc1')
 UNION ALL SELECT 'k2', item_id, 12*contains(text,'whst')::INT FROM c),
b AS (SELECT k, item_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, item_id) rn FROM s WHERE score > 0)
SELECT l.k AS clause_key, l.label, b.item_id AS chunk_id, COALESCE(b.score, 0)::BIGINT AS score FROM (VALUES ('k1','first'),('k2','second'),('k3','third')) l(k,label) LEFT JOIN b ON b.k = l.k AND rn = 1""")
def _(t):
    chunks = t.benchmark.select(C("item_id").alias("chunk_id"), text("doc", F.floor(C("item_id") / 8)).alias("doc_title"), "text")
    return jo.resolve_clause(CLAUSES, chunks)


@query("j08_review_pages", """
SELECT source AS doc_id, d.doc_id AS page_number, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0 ORDER BY source, d.doc_id LIMIT 100""")
def _(t):
    pages = t.labels.join(t.documents, "doc_id").select(C("source").alias("doc_id"), C("doc_id").alias("page_number"), F.when(C("quality") == 0, "needs_review").otherwise("completed").alias("review_status"), "n_chars")
    docs = t.documents.select(C("source").alias("doc_id")).distinct()
    return jo.review_pages(pages, docs, "needs_review", 100).select("doc_id", "page_number", "n_chars")


@query("j09_case_detail", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 rn FROM orders),
l AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
op AS (SELECT o_custkey k, rn // 5 part, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) ids FROM o GROUP BY 1, 2),
lp AS (SELECT o_custkey k, rn // 5 part, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) ids FROM l GROUP BY 1, 2),
u AS (SELECT COALESCE(op.k, lp.k) k, COALESCE(op.part, lp.part) part, op.ids o, lp.ids l FROM op FULL JOIN lp ON op.k = lp.k AND op.part = lp.part)
SELECT c_custkey AS case_id, c_name AS title, 0::BIGINT AS part, o AS orders, l AS lines FROM customer LEFT JOIN u ON k = c_custkey AND part = 0
UNION ALL SELECT k, NULL, part, o, l FROM u WHERE part > 0""")
def _(t):
    orders = t.orders.select(C("o_custkey").alias("case_id"), "o_orderkey", "o_orderdate")
    lines = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(C("o_custkey").alias("case_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    r = jo.case_detail(
        t.customer.select(C("c_custkey").alias("case_id"), C("c_name").alias("title")),
        {
            "orders": (orders, [C("o_orderdate"), C("o_orderkey")], F.year("o_orderdate")),
            "lines": (lines, [C("l_orderkey"), C("l_linenumber"), C("l_partkey"), C("l_extendedprice")], F.floor(C("l_orderkey") / 10_000)),
        },
        size=5,
    )
    return r.select("case_id", "title", "part", joined(C("orders.o_orderkey")).alias("orders"), joined(C("lines.l_partkey")).alias("lines"))


@query("j10_grouped_pages", """
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END g, c_nationkey case_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'BUILDING' ELSE c_mktsegment END ty, c_mktsegment gt FROM orders JOIN customer ON o_custkey = c_custkey),
q AS (SELECT case_id, ty, CASE WHEN g IS NOT NULL AND ty = gt THEN g END gg, o_orderkey FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, ty, gg ORDER BY o_orderkey) - 1 rn FROM q)
SELECT case_id::BIGINT AS case_id, ty AS type, gg AS group_id, CASE WHEN gg IS NULL THEN -1 ELSE gg % 10 END AS sort_order, rn // 50 AS part, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) AS files FROM r GROUP BY ALL""")
def _(t):
    d = t.orders.join(t.customer, C("o_custkey") == C("c_custkey"))
    pages = d.select(
        C("o_orderkey").alias("page_id"), F.when(C("o_orderstatus") != "P", C("o_custkey")).alias("group_id"), C("c_nationkey").alias("case_id"),
        F.when(C("o_orderpriority") == "5-LOW", "BUILDING").otherwise(C("c_mktsegment")).alias("type"), C("o_orderkey").alias("page_number"),
    )
    groups = t.customer.select(C("c_custkey").alias("group_id"), C("c_nationkey").alias("case_id"), C("c_mktsegment").alias("type"), C("c_name").alias("name"), (C("c_custkey") % 10).alias("sort_order"))
    return jo.grouped_pages(pages, groups, 50).select("case_id", "type", "group_id", "sort_order", "part", joined(C("files")).alias("files"))


@query("j11_not_imported", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    name = lambda c: text("case1_x-", c, ".png")
    pages = t.orders.select("o_orderkey", name(C("o_orderkey")).alias("file_name"))
    rows = t.lineitem.filter(C("l_returnflag") == "R").select(text("/up/1/pdf_pages/", name(C("l_orderkey"))).alias("path"))
    return jo.not_imported(pages, rows).select("o_orderkey")


@query("j12_events_per_record", """
WITH e AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_orderkey END rec, CASE WHEN l_returnflag <> 'A' THEN o_custkey END grp, strftime(l_shipdate,'%Y-%m-%d') d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT o.o_orderkey, e.d FROM orders o JOIN e ON e.rec = o.o_orderkey OR e.grp = o.o_custkey)
SELECT o.o_orderkey AS record_id, count(m.d) AS n_events, min(m.d) AS first_date FROM orders o LEFT JOIN m ON o.o_orderkey = m.o_orderkey GROUP BY 1""")
def _(t):
    events = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(
        F.when(C("l_returnflag") != "N", C("l_orderkey")).alias("record_id"), F.when(C("l_returnflag") != "A", C("o_custkey")).alias("group_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")
    )
    records = t.orders.select(C("o_orderkey").alias("record_id"), C("o_custkey").alias("group_id"))
    return jo.events_per_record(records, events)


@query("j13_first_attr", """
WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, p_brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) rn FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND p_type <> 'PROMO')
SELECT l_suppkey AS case_id, p_brand AS number FROM f WHERE rn = 1""")
def _(t):
    facts = t.lineitem.select(
        C("l_suppkey").alias("case_id"), S("o").alias("org"), F.when(C("l_returnflag") == "A", "hospital_record").otherwise("x").alias("fact_type"), C("l_partkey").alias("source_id"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("ord"),
    )
    records = t.part.select(C("p_partkey").alias("record_id"), F.when(C("p_type") == "PROMO", " ").otherwise(C("p_brand")).alias("number"))
    return jo.first_attr(facts, records).select("case_id", "number")


@query("j14_source_pages", f"""
WITH {PAGES}, f AS (SELECT o_orderkey k, unnest([o_orderkey*10+5, o_orderkey*10+1, o_orderkey*10+2]) id FROM orders)
SELECT o_orderkey AS fact_id, count(page_id) AS n_pages, COALESCE(string_agg(page_id::VARCHAR, ',' ORDER BY CASE WHEN page_id % 10 = 2 THEN 0 ELSE 1 END, num IS NULL, COALESCE(num,0), page_id),'') AS ids
FROM orders LEFT JOIN (SELECT * FROM f JOIN pg ON id = page_id) ON k = o_orderkey GROUP BY 1""")
def _(t):
    k = C("o_orderkey")
    facts = t.orders.select(k.alias("fact_id"), F.array(k * 10 + 5, k * 10 + 1, k * 10 + 2, k * 10 + 1).alias("source_ids"))
    pages = order_pages(t).withColumn("file_name", F.when(C("page_id") % 10 == 2, text("case1_a-", C("page_id"), ".png")).otherwise(text(C("page_id"))))
    return jo.source_pages(facts, pages).select("fact_id", "n_pages", joined(C("page_ids")).alias("ids"))


@query("j15_overlay_saved", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE l.quality WHEN 1 THEN 'accepted' ELSE 'excluded' END WHEN lang = 'en' AND n_chars >= 80 THEN 'accepted' WHEN lang = 'fr' THEN 'needs_review' ELSE 'pending' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    cands = t.documents.select(C("source").alias("case_id"), C("doc_id").alias("candidate_key"), F.when(C("lang") == "en", "met").when(C("lang") == "fr", "uncertain").otherwise("not_met").alias("decision"), C("n_chars").alias("confidence"))
    saved = t.labels.join(t.documents, "doc_id").select(C("source").alias("case_id"), C("doc_id").alias("candidate_key"), F.when(C("quality") == 1, "accepted").otherwise("excluded").alias("status"), S("n").alias("review_note"))
    return jo.overlay_saved(cands, saved).select(C("candidate_key").alias("doc_id"), "status")


@query("j16_group_status", """
WITH g AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 20),
p AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey % 120 END grp, c_nationkey, c_acctbal > 0 done, c_mktsegment <> 'MACHINERY' has FROM customer),
a AS (SELECT grp, count(*) n, count(*) FILTER (WHERE done AND has) c FROM p WHERE grp IS NOT NULL GROUP BY 1)
SELECT s_nationkey::BIGINT AS case_id, s_suppkey AS group_id, COALESCE(n,0) AS n_pages, COALESCE(c,0) AS n_completed, r.o IS NOT NULL AS has_record FROM g LEFT JOIN a ON grp = s_suppkey
 LEFT JOIN (SELECT o_orderkey % 300 k, min(o_orderkey) o FROM orders GROUP BY 1) r ON 2 * r.k = s_suppkey
UNION ALL SELECT c_nationkey::BIGINT, NULL, count(*), count(*) FILTER (WHERE done), false FROM p WHERE grp IS NULL AND c_nationkey NOT IN (SELECT s_nationkey FROM g) GROUP BY 1""")
def _(t):
    groups = t.supplier.select(C("s_nationkey").alias("case_id"), C("s_suppkey").alias("group_id"), C("s_name").alias("name"), S(1).alias("sort_order"), F.when(C("s_nationkey") < 20, "medical_record").otherwise("x").alias("type"))
    pages = t.customer.select(
        C("c_nationkey").alias("case_id"), F.when(C("c_mktsegment") != "BUILDING", C("c_custkey") % 120).alias("group_id"), S("medical_record").alias("type"),
        F.when(C("c_acctbal") > 0, "completed").otherwise("failed").alias("status"), F.when(C("c_mktsegment") == "MACHINERY", "").otherwise("t").alias("text"),
    )
    records = t.orders.select((C("o_orderkey") % 300 * 2).alias("group_id"), C("o_orderkey").alias("record_id"))
    records = records.join(t.supplier.select(C("s_suppkey").alias("group_id"), C("s_nationkey").alias("case_id")), "group_id")
    return jo.group_status(groups, pages, records).select("case_id", "group_id", "n_pages", "n_completed", "has_record")
