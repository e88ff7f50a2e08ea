"""Jobs and budgets against small hand-made tables."""
from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.operators import merge as me
from caseweave.operators.split import char_budget
from caseweave.plans import facts as fa

RECORD = "record_id long, case_id int, group_id long, page_id long, org string, number string, complaint string, history string, exam string, diagnosis_in string, treatment string, diagnosis_out string, orders string, date_in string, date_out string, days int, review_status string, confidence int, flags array<string>"
EVENT = "event_id long, case_id int, group_id long, record_id long, org string, type string, date string, title string, summary string, diagnosis string, findings string, treatment string, quote string, source_ids array<long>, source_pages array<int>, review_status string, confidence int, flags array<string>"
REPORT = "report_id long, case_id int, group_id long, page_id long, org string, date string, datetime string, exam_type string, exam_part string, film_no string, film_count int, content string, review_status string, flags array<string>, source_ids array<long>, source_pages array<int>"
FACT = "fact_id long, case_id int, fact_key string, fact_type string, fact_role string, fact_date string, org string, title string, summary string, quote string, source_kind string, source_id long, source_ids array<long>, source_pages array<int>, review_status string, importance string, confidence int, flags array<string>, review_note string"


def rows(spark, schema, *given):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], schema)


def library(spark):
    event = {"case_id": 7, "type": "other", "date": "2024-01-01", "title": "旧", "summary": "骨折", "review_status": "pending", "flags": [fixed.AUTO_FLAG], "confidence": 60}
    record = {"case_id": 7, "org": "甲医院", "complaint": "痛", "history": "伤", "exam": "肿", "diagnosis_in": "骨折", "date_in": "2024-01-02", "review_status": "confirmed", "flags": []}
    page = {"case_id": 7, "type": "medical_record", "status": "completed"}
    return {
        "groups": rows(spark, "group_id long, case_id int, type string, name string, sort_order int, is_confirmed boolean", *({"group_id": g, "case_id": 7, "type": "medical_record", "name": "甲医院", "sort_order": g} for g in (1, 2, 3))),
        "pages": rows(
            spark, "page_id long, group_id long, page_number int, case_id int, type string, status string, subtype string, text string, file_name string",
            {**page, "page_id": 11, "group_id": 1, "page_number": 1, "subtype": "admission_record", "text": "主诉：痛 入院日期：2024年1月2日"},
            {**page, "page_id": 21, "group_id": 2, "page_number": 1, "subtype": "admission_record", "text": "主诉：痛", "status": "pending"},
            {**page, "page_id": 31, "group_id": 3, "page_number": 1, "subtype": "operation_record", "text": "手术名称：复位术 手术日期：2024-01-03"},
        ),
        "records": rows(spark, RECORD, {**record, "record_id": 101, "group_id": 1}, {**record, "record_id": 102, "group_id": 2}),
        "events": rows(spark, EVENT, *({**event, "event_id": e, "group_id": g} for e, g in ((201, 1), (202, 2), (203, 3), (204, None))), {**event, "event_id": 205, "group_id": 1, "review_status": "confirmed", "title": "真"}),
        "reports": rows(spark, REPORT), "facts": rows(spark, FACT),
    }


def test_library_rebuilds_only_read_groups_with_a_record(spark):
    """Group 2 has no recognised page and group 3 no record: both keep their automatic events."""
    out = fa.build_fact_library(library(spark))
    events = [(r.event_id, r.group_id, r.type) for r in out["events"].collect()]
    assert sorted(e for e, _, _ in events if e < 1000) == [202, 203, 204, 205]
    assert [(g, k) for e, g, k in events if e > 1000] == [(1, "admission")]
    state = {r.group_id: (r.rebuilt, r.has_record, r.created, r.deleted, r.preserved) for r in out["groups"].collect()}
    assert state == {1: (True, True, 1, 1, 1), 2: (False, True, 0, 0, 0), 3: (False, False, 0, 0, 0)}
    assert out["facts"].count() == 2 + 5 and out["counts"].first().total == 7


def test_import_numbers_and_orders(spark):
    prediction = "struct<type:string,subtype:string,group:string,confidence:double>"
    p = lambda g, kind="medical_record": (kind, "x", g, 0.9)
    pages = spark.createDataFrame(
        [(1, "f3", 3, None, "t", p("乙院")), (1, "f1", 1, None, "t", p("丙院")), (1, "f2", 2, 9, "t", p("乙院")), (1, "f4", 4, None, "t", p("甲院")), (1, "f5", 5, None, "t", p("乙院")), (1, "f6", 6, None, "t", p("", "id_card")), (1, "old", 0, None, "t", p("甲院"))],
        f"case_id int, file_name string, ord long, page_number int, text string, prediction {prediction}",
    )
    groups = spark.createDataFrame([(50, 1, "medical_record", "甲院", 1, True)], "group_id long, case_id int, type string, name string, sort_order int, is_confirmed boolean")
    imported = spark.createDataFrame([("old", 50), ("older", 50)], "file_name string, group_id long")
    none = spark.createDataFrame([], "case_id int, alias string, canonical string")
    got, after = me.auto_import(pages, imported, groups, none, spark.createDataFrame([], "case_id int, name string, ord int"))
    names = {r.group_id: (r.name, r.sort_order) for r in after.collect()}
    assert sorted(names.values()) == [("丙院", 2), ("乙院", 3), ("甲院", 1)]
    found = {r.file_name: (r.outcome, names.get(r.group_id, (None,))[0], r.page_number) for r in got.collect()}
    assert found == {
        "f1": ("imported", "丙院", 1), "f2": ("imported", "乙院", 9), "f3": ("imported", "乙院", 2), "f5": ("imported", "乙院", 3),
        "f4": ("imported", "甲院", 3), "f6": ("imported", None, None), "old": ("skipped", None, None),
    }


def test_budget_meets_only_what_can_fit(spark):
    """Every part cuts its own rows before the whole key meets: 64 parts, budget 9, one sign a line."""
    d = spark.range(20_000).select(F.lit(1).alias("k"), "id", F.lit("x").alias("t"))
    got = char_budget(d, ["k"], [F.col("id")], F.col("t"), 9)
    assert sorted((r.id, r._rn, r.total) for r in got.collect()) == [(i, i + 1, i + 1) for i in range(9)]
    assert sorted(r.id for r in char_budget(d, ["k"], [F.col("id")], F.col("t"), 9, "cut_after").collect()) == list(range(10))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") >= 2
