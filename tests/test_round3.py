"""Findings of round 3 on small hand-made tables."""
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions import extract as ex
from caseweave.operators import aggregates as ag
from caseweave.operators.sets import stale_keys
from caseweave.queries import merges, registry
from caseweave.session import cut_lineage


def table(folder, name, df):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_stale_keys_reads_each_side_once(spark):
    """one grouping over both sides; a null key matches no other, as in a join."""
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k long, x string")
    new = spark.createDataFrame([(2, "b"), (3, "b"), (3, "b"), (None, "c")], "k long, x string")
    d = stale_keys(old, new, ["k"])
    assert sorted((r.k or 0, r.change) for r in d.collect()) == [(0, "new"), (0, "stale"), (1, "stale"), (3, "new")]
    two = stale_keys(old, new, ["k", "x"])
    assert sorted((r.k or 0, r.x, r.change) for r in two.collect()) == [(0, "c", "new"), (0, "c", "stale"), (1, "a", "stale"), (3, "b", "new")]
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_name_similarity_works_out_a_core_once(spark):
    """each core is one expression of the plan; scores are those of the cores, null for a null core only."""
    random.seed(3)
    signs = "东城县南皋阜人民中医院所"
    names = ["".join(random.choice(signs) for _ in range(random.randint(1, 9))) for _ in range(60)] + ["", "东阜县人民医院", " 东皋县 人民医院"]
    d = spark.createDataFrame([(a, b) for a in names for b in names[::3]], "a string, b string")
    d = d.withColumns({"p": ex.name_core(F.col("a")), "q": ex.name_core(F.col("b")), "score": ex.name_similarity(F.col("a"), F.col("b"))})

    def ratio(p, q):
        return 1.0 if p == q else SequenceMatcher(None, p, q).ratio()

    for r in d.withColumn("m", ex.similarity_bounds(F.col("p"), F.col("q"))).collect():
        low, high = r.m.low, r.m.high
        wanted = max(low, ratio(r.p, r.q)) if high > low else low
        assert abs(r.score - wanted) < 1e-12, (r.a, r.b)
    one = spark.range(1).select(ex.name_similarity(F.lit("x").substr(1, 1), F.lit("y").substr(1, 1)).alias("s"))
    assert one._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2


def test_review_run_counts_every_page(spark, tmp_path):
    """every labelled document is a recognised page; the operator leaves out pending pages only."""
    documents = [(1, "a", "es", "s", 1200), (2, "b", "en", "s", 400), (3, "c", "es", "s", 100), (4, "d", None, "s", 100)]
    table(tmp_path, "documents", spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long"))
    table(tmp_path, "labels", spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"))
    run, sql = registry.REGISTRY["a21_review_run"]
    assert [tuple(r) for r in run(spark, str(tmp_path)).collect()] == [("s", 4, 3, 1, 0, 2, 1)]
    assert "lang <>" not in sql
    pages = spark.createDataFrame([(1, 1, "x", "pending", None), (1, 2, "x", "completed", None)], "doc_id long, page_id long, text string, status string, review_status string")
    assert [r.page_id for r in ag.review_targets(pages).collect()] == [2]


def test_cut_lineage_writes_compressed_files(spark):
    """what is kept between steps is Parquet, not the rows of a checkpoint."""
    d = cut_lineage(spark.range(1000).select(F.col("id"), F.lit(fixed.AUTO_FLAG).alias("flag"), F.array("id").alias("ids")))
    assert d.count() == 1000 and not d.rdd.isCheckpointed()
    assert all(f.endswith(".zstd.parquet") for f in d.inputFiles())


def test_only_tables_that_are_read_are_rendered(spark, tmp_path):
    """a query that reads records and events does not write pages, reports or facts."""
    order = [(1, 7, "F", 10.0, "1-URGENT")]
    table(tmp_path, "orders", spark.createDataFrame(order, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"))
    line = spark.createDataFrame([(1, 1, 3, 26.0, "2024-01-02", "A")], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_shipdate string, l_returnflag string")
    table(tmp_path, "lineitem", line.withColumn("l_shipdate", F.col("l_shipdate").cast("date")))
    table(tmp_path, "customer", spark.createDataFrame([(7,)], "c_custkey long"))
    before = set(merges._STORED)
    x = merges.fact_tables(registry.Tables(spark, str(tmp_path)))
    assert [x["records"].count(), x["events"].count()] == [1, 1]
    assert {k[2] for k in set(merges._STORED) - before} == {"records", "events"}
    assert sorted(x) == sorted(["groups", "pages", "events", "reports", "records", "facts", "cases"])


def test_rows_without_a_key_are_dealt_to_all_tasks(spark):
    """rows with a null join key went to one task; they are dealt, and answers stay the same."""
    from caseweave.operators.joins import events_per_record, join_dealt

    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        d = spark.range(1000).select(F.when(F.col("id") < 3, F.col("id")).alias("k"), F.col("id").alias("x"))
        right = spark.createDataFrame([(0, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
        out = join_dealt(d, right, "k", ["x"]).withColumn("task", F.spark_partition_id())
        assert out.filter("k is null").select("task").distinct().count() == 8
        assert out.count() == 1001 and out.columns[:3] == ["k", "x", "v"]
        assert sorted((r.k, r.v) for r in out.filter("v is not null").collect()) == [(0, "a"), (2, "b"), (2, "c")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    records = spark.createDataFrame([(1, 10), (2, 10), (3, None)], "record_id long, group_id long")
    events = spark.createDataFrame([(1, 10, "b"), (None, 10, "a"), (None, 10, "a"), (3, None, "c"), (None, None, "z"), (1, None, "")], "record_id long, group_id long, date string")
    got = {r.record_id: (r.n_events, r.first_date) for r in events_per_record(records, events).collect()}
    assert got == {1: (4, "a"), 2: (3, "a"), 3: (1, "c")}


def test_shuffles_are_sized_by_the_tables(spark, tmp_path):
    """the number of shuffle partitions follows the bytes of the tables that are read."""
    from caseweave import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    table(tmp_path, "orders", spark.range(200_000).select(F.xxhash64("id").alias("o_orderkey")))
    whole, session.TASK_BYTES = session.TASK_BYTES, 10_000
    try:
        t = registry.Tables(spark, str(tmp_path))
        t.orders
        assert int(spark.conf.get(key)) >= 100
    finally:
        session.TASK_BYTES = whole
    registry.Tables(spark, str(tmp_path)).orders
    assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reclassify_cleans_a_text_once(spark):
    """F16: the filter on the new subtype moved below the cleaning and repeated it for every word."""
    from caseweave.functions import classify as cl

    rules = cl.Rules(subtypes={"medical_record": [("a", ["ment"]), ("b", ["lich"])]}, defaults={"medical_record": "c"})
    rows = [(1, "x # ment", "completed", None), (2, "ment", "completed", "a"), (3, "lich", "failed", None), (4, "", "completed", None), (5, " ", "completed", None), (6, "zz", "completed", "b"), (1, "x # ment", "completed", None)]
    d = spark.createDataFrame(rows, "id long, text string, status string, subtype string").withColumn("type", F.when(F.col("id") != 9, "medical_record"))
    out = cl.reclassify(d, rules)
    assert sorted((r.id, r.subtype, r.new_subtype) for r in out.collect()) == [(1, None, "a"), (1, None, "a"), (6, "b", "c")]
    assert plan_of(out).count("regexp_replace") == 4


def test_page_sequence_walks_chunks_in_one_pass(spark):
    """every chunk was a pandas group of its own; chunks now follow each other in a task, over any batches."""
    from caseweave.operators import sequence as sq
    from caseweave.queries.groups import conversation_pages

    rnd = random.Random(4)
    rows = [(c, n, rnd.choice(["user", "assistant", "system"]), rnd.choice(["e", "ment", "tion xx", "e" * 301])) for c in range(6) for n in range(rnd.randint(1, 40))]

    class T:
        conversations = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "2")
        out = sq.correct_sequence(conversation_pages(T), chunk=3)
        got = sorted((r.page_id, r.rule, r.prediction.type) for r in out.collect())
    finally:
        spark.conf.set(key, old)
    assert "FlatMapGroupsInPandas" not in plan_of(out)
    assert len(got) == len(rows) and got == sorted((r.page_id, r.rule, r.prediction.type) for r in sq.correct_sequence(conversation_pages(T)).collect())


def test_decide_counts_a_text_once(spark):
    """the ranges in a text were counted again for each of its specs."""
    from caseweave.plans import rules as ru

    rows = [(1, "m", 1, "", "", "", "", "", "第2-8肋，第3肋骨骨折", [1], "pending"), (1, "m", 2, "", "", "", "", "", "第1肋", [1], "pending"), (2, "m", 3, "", "", "", "", "", None, [1], "pending")]
    d = spark.createDataFrame(rows, "case_id long, kind string, id long, date string, org string, title string, summary string, quote string, text string, source_pages array<int>, review_status string")
    specs = [{"spec_id": k, "kind": kind, "include": ["肋"], "suggestion": "约{n}根" if k == "a" else "无"} for k, kind in (("a", "count"), ("b", "any_term"), ("c", "default"))]
    out = ru.decide(d, specs)
    got = {r.candidate_key: (r.decision, r.suggestion, [e.id for e in r.evidence]) for r in out.collect()}
    assert got == {"a": ("met", "约7根", [1, 2]), "b": ("uncertain", "无", [1, 2]), "c": ("met", "无", [1, 2])}
    below = plan_of(out).split("explode")[-1]
    assert "[-~]" in below


def test_range_counts(spark):
    texts = ["第2-5肋，3~9肋", "右第2—4肋骨折 第7肋 第7 肋", "肋骨骨折 8 根以上", "9-2肋", "第2-5", "肋", "", None, "12 至 15 肋"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", ex.max_range_count(F.col("t")))
    assert [r.n for r in d.orderBy("i").collect()] == [7, 3, 8, 0, 0, 0, 0, 0, 4]


def test_fallback_records_clean_pages_once(spark):
    """the order, the texts and those that follow cleaned the pages again each."""
    from caseweave.plans import facts as fa

    groups = spark.createDataFrame([(1, 7, "院")], "group_id long, case_id long, name string")
    pages = spark.createDataFrame([(11, 1, 1, "admission_record", "主诉：<b>痛</b> 现病史：伤"), (12, 1, 2, "discharge_record", "出院诊断：愈")], "page_id long, group_id long, page_number int, subtype string, text string")
    records = merges.order_records(type("T", (), {"orders": spark.createDataFrame([(5, 7, "F", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")}))
    out = fa.fallback_records(groups, pages, records, rare=False)
    assert sorted((r.group_id, r.org, r.complaint, r.diagnosis_out) for r in out.collect()) == [(1, "院", "痛", "愈"), (5, "old", "旧", None)]
    assert "<[^>]+>" not in plan_of(out)
