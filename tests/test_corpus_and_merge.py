import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import merge as me
from caseweave.operators.windows import capped_topk
from caseweave.plans import corpus as co


def _sections(spark, text, longest=co.LONGEST):
    row = spark.createDataFrame([(text,)], "text string").select(co.sections(F.col("text"), longest).alias("s")).first()
    return [tuple(x) for x in row.s]


def test_sections(spark):
    long = "甲" * 100
    got = _sections(spark, f"1 总则\n{long}\n2.1 范围\n{long}\n短")
    assert [(c, t) for c, t, _ in got] == [("1", "总则"), ("2.1", "范围")]
    assert got[0][2] == f"1 总则\n{long}"
    assert _sections(spark, "短") == []
    whole = _sections(spark, "\n".join(["乙" * 400] * 7))
    assert sum(len(b.replace("\n", "")) for _, _, b in whole) == 2800 and max(len(b) for _, _, b in whole) <= 2400


def test_sections_by_rows(spark):
    """Every branch: blanks, a heading first and after text, a full section, short rests, overlong lines, no section."""
    a, b = "甲" * 90, "乙" * 1300
    assert _sections(spark, f"{a}\n\n第一章 总则\n{a}") == [(None, None, a), ("第一章", "总则", f"第一章 总则\n{a}")]
    assert _sections(spark, f"2 标题\n{b}\n{a}\n短") == [("2", "标题", f"2 标题\n{b}"), ("2", "标题", f"{a}\n短")]
    assert _sections(spark, f"{'丙' * 3000}") == [(None, None, "丙" * 2400), (None, None, "丙" * 600)]
    assert _sections(spark, f"1 总则\n{'丙' * 2395}") == [("1", "总则", f"1 总则\n{'丙' * 2395}")]
    assert _sections(spark, f"1 总则\n{'丙' * 2396}\n{a}") == [("1", "总则", f"1 总则\n{'丙' * 2395}"), ("1", "总则", "丙"), ("1", "总则", a)]
    assert _sections(spark, f"{'丙' * 3000}", None) == [(None, None, "丙" * 3000)]
    assert _sections(spark, f"短\n3 范围\n{a}") == [("3", "范围", f"3 范围\n{a}")]
    assert _sections(spark, "\n".join(f"{i} 题" for i in range(40))) == [(None, None, "\n".join(f"{i} 题" for i in range(40)))]


def test_query_terms_strips(spark):
    q = spark.createDataFrame([(1, "  没有词 "), (2, "   ")], "query_id int, query string")
    assert [(r.query_id, r.terms) for r in co.query_terms(q, ["词典"]).collect()] == [(1, ["没有词"])]


def test_default_parts_hold_the_spleen(spark):
    from caseweave import vocabulary as v

    assert {"脾", "下腹部"} <= set(v.BODY_PARTS)


def test_merge_facts(spark):
    cols = "case_id int, fact_key string, fact_id long, fact_type string, summary string, quote string, review_status string, importance string, review_note string"
    old = spark.createDataFrame([
        (1, "a", 1, "medical_event", "o", "", "confirmed", "core", "n"), (1, "b", 2, "medical_event", "o", "", "pending", "core", "note"), (1, "c", 3, "medical_event", "o", "", "pending", "core", None),
        (1, "d", 4, "medical_event", "o", "", "pending", "core", None), (1, "e", 5, "case_basic", "o", "", "pending", "core", None), (1, "f", 6, "manual", "o", "", "pending", "core", None), (1, "g", 7, "medical_event", "o", "", "pending", "core", None),
    ], cols)
    new = spark.createDataFrame([
        (1, k, "medical_event", s, "", "system_verified", "supporting") for k, s in (("a", "n"), ("b", "n"), ("c", "n"), ("d", ""), ("h", "n"), ("i", ""))
    ], "case_id int, fact_key string, fact_type string, summary string, quote string, review_status string, importance string")
    once = me.merge_facts(old, new)
    got = {r.fact_key: (r.summary, r.review_status, r.importance) for r in once.collect()}
    assert got == {
        "a": ("n", "confirmed", "core"), "b": ("n", "pending", "core"), "c": ("n", "system_verified", "supporting"), "d": ("o", "pending", "core"),
        "f": ("o", "pending", "core"), "h": ("n", "system_verified", "supporting"),
    }
    twice = me.merge_facts(once.select(*old.columns), new)
    assert {r.fact_key: (r.summary, r.review_status, r.importance) for r in twice.collect()} == got


def test_candidates_stay_excluded(spark):
    key = "case_id int, candidate_key string, decision string, confidence int"
    new = spark.createDataFrame([(1, "k", "met", 90)], key)
    empty = new.limit(0)
    old = spark.createDataFrame([(1, "k", "met", "accepted", "analysis")], "case_id int, candidate_key string, decision string, status string, source string")
    lost = me.sync_candidates(old, empty)
    assert lost.first().status == "excluded"
    back = me.sync_candidates(lost.select(*old.columns), new).first()
    assert (back.status, back.decision) == ("excluded", "met")


@pytest.mark.parametrize("k, cap", [(8, 3), (2, 1), (5, 5)])
def test_search_bounds_leave_out_nothing(spark, k, cap):
    rnd = random.Random(k)
    words = ["aa", "bb", "cc", "dd"]
    rules, specials = [(["bb"], ["north"])], [(["south"], ["cc"], False, -20.0), (["north"], ["dd"], True, 18.0)]
    chunks = [(i, i // 12, f"{rnd.choice(['plain', 'plain', 'north', 'south'])} {i // 12}" if i % 12 == 0 else None, rnd.choice(["", "aa", "cc dd"]), " ".join(rnd.choices([*words, "x", "y"], k=rnd.randint(0, 25)))) for i in range(360)]
    names = {c[1]: c[2] for c in chunks if c[2]}
    d = spark.createDataFrame([(i, doc, names[doc], "", title, body) for i, doc, _, title, body in chunks], "chunk_id long, doc_id long, doc_title string, code string, title string, text string")
    queries = [(i, " ".join(rnd.sample(words, rnd.randint(1, 4)))) for i in range(30)] + [(99, "zz none of the words")]
    q = spark.createDataFrame(queries, "query_id long, query string")
    every = co.score_chunks(q, d, words, rules, specials)
    want = capped_topk(every, ["query_id"], k, cap).selectExpr("query_id", "chunk_id", "rank", "round(score, 2) score").collect()
    got = co.search(q, d, k, cap, words, rules, specials).select("query_id", "chunk_id", "rank", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.query_id for r in want}) == 30
