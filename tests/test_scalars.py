"""Hand-derived cases of the scalar functions."""
import random
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from caseweave.functions import classify as cl
from caseweave.functions import extract as ex
from caseweave.functions import predicates as pr
from caseweave.functions import text as tx


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row.asDict(recursive=True)


L = lambda x: F.lit(x)


def test_text_and_labels(spark):
    texts = F.array(L("时间：2024年3月5日"), L("时间：2024-3-6 8:05"))
    r = one(
        spark,
        label=ex.extract_label(L("甲：一二 乙：三"), ["甲"], ["甲", "乙"]),
        newline=ex.extract_label(L("甲：一二\n丙"), ["甲"], ["甲", "乙"]),
        fine=ex.extract_datetime(texts, ["时间"]),
        unchecked=ex.extract_datetime(F.array(L("时间：2024年2月30日")), ["时间"]),
        days=ex.extract_days(F.array(L("住院天数：12天"))),
        entity=tx.clean_ocr(L("a&eacute;&amp;lt;b | <p>c&ltd</p>")),
        clip=tx.clip_ellipsis(L("ab cd"), 3), null=tx.clip_or_null(L("ab cd"), 3), hard=tx.clip_hard(L("ab cd"), 3),
        joined=tx.join_sentences(L("甲"), L(" "), L("乙；")),
    )
    assert r["label"] == "一二" and r["newline"] is None
    assert r["fine"] == "2024-03-06 08:05" and r["unchecked"] == "2024-02-30" and r["days"] == 12
    assert r["entity"] == "aé&lt;b c"
    assert (r["clip"], r["null"], r["hard"]) == ("ab...", "ab", "ab ")
    assert r["joined"] == "甲。乙；"


def test_time_key(spark):
    def key(x):
        k = one(spark, k=ex.fact_time_key(L(x)))["k"]
        return k["precision"], k["sort"]

    assert key("2024年3月5日") == (1, "2024-03-05 23:59")
    assert key("2024-03-05T08:05:00") == (0, "2024-03-05 08:05")
    assert key("") == (9, "9999-99-99 99:99")
    assert key("约春季") == (8, "约春季")
    assert key("2024-02-30") == (8, "2024-02-30")
    assert key("202403050805") == (0, "2024-03-05 08:05")


def test_counts_and_negation(spark):
    def hit(x):
        return one(spark, h=pr.has_positive_hit(L(x), ["A[^。]{0,4}B"], ["未见"]))["h"]

    assert [hit("未见AB"), hit("AB"), hit("未见AB" + "甲" * 20 + "AB"), hit("无")] == [False, True, True, False]
    r = one(
        spark, a=ex.max_range_count(L("第3-8肋骨折")), b=ex.max_range_count(L("第3肋、第4肋、第4肋")), c=ex.max_range_count(L("肋骨骨折7根以上")),
        items=ex.max_item_count(L("牙齿脱落3枚，8颗牙折断")),
    )
    assert (r["a"], r["b"], r["c"], r["items"]) == (6, 2, 7, 8)


def test_dates_and_json(spark):
    d = lambda s: F.to_date(L(s))
    r = one(
        spark,
        short=ex.elapsed_phrase(L("2024-01-01"), L("2024-01-20")), long=ex.elapsed_phrase(L("2024-01-01"), L("2024-03-05")), round=ex.elapsed_phrase(L("2024-01-01"), L("2024-02-28")),
        legacy=ex.elapsed_phrase(L("2024年12月11日"), L("2024-12-20"), legacy_slice=True),
        young=ex.age_on(d("2000-02-29"), d("2024-02-28")), old=ex.age_on(d("2000-02-29"), d("2024-02-29")),
        ints=ex.int_list(L('[3,"4","x",3]')), bad=ex.int_list(L("bad")), obj=ex.int_list(L('{"a":1}')),
        json=ex.extract_json(L('so {"a": {"b": 1}} end')), none=ex.extract_json(L("no braces")),
        missing=ex.missing_fields(L('{"a":1}'), ["a", "b"]),
    )
    assert (r["short"], r["long"], r["round"], r["legacy"]) == ("伤后19日", "伤后2个月余", "伤后2个月", "")
    assert (r["young"], r["old"]) == (23, 24)
    assert (r["ints"], r["bad"], r["obj"]) == ([3, 4], [], [])
    assert r["json"] == '{"a": {"b": 1}}' and r["none"] is None and r["missing"] == ["b"]


def test_names(spark):
    s = lambda a, b: one(spark, s=ex.name_similarity(L(a), L(b)))["s"]
    assert s("原阳县人民医院", "|原阳县 人民医院") == 1.0
    assert s("甲乙卫生院南", "甲乙卫生院") >= 0.82
    assert s("甲乙公司", "丙丁诊所") < 0.82


def test_name_bounds_and_negation_equal_loops(spark):
    rnd = random.Random(3)
    suffixes = ["医院", "诊所"]
    name = lambda: "".join(rnd.choices(["东", "城", "县", "人民", "医院", "诊所", "x", "医"], k=rnd.randint(0, 6)))
    rows = [(i, name(), name()) for i in range(300)] + [(300, "", "东"), (301, None, "东"), (302, "东城医院", "东城医院")]
    d = spark.createDataFrame(rows, "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = d.select("i", ex.common_run(a, b).alias("run"), ex.shared_signs(a, b).alias("shared"), ex.similarity_bounds(a, b, suffixes).alias("m"), ex.core_similarity(a, b, suffixes).alias("s")).collect()
    for (_, x, y), r in zip(rows, sorted(got, key=lambda r: r.i)):
        if x is None:
            assert r.s is None
            continue
        run = max((n for n in range(len(x) + 1) if any(x[i : i + n] in y for i in range(len(x) - n + 1))), default=0)
        assert (r.run, r.shared) == (run, sum((Counter(x) & Counter(y)).values()))
        ratio = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        assert r.m.low <= r.s <= r.m.high and r.s == max(r.m.low, ratio if x and y else 0.0)
        if x and y and x != y:
            floors = [0.0]
            if run >= 4 and (x in y or y in x):
                floors.append(0.82)
            if run >= 3 and {s for s in suffixes if s in x} & {s for s in suffixes if s in y}:
                floors.append(0.86)
            if run >= 4 and any(s in x + "|" + y for s in suffixes):
                floors.append(min(0.96, 0.68 + 0.28 * run / min(len(x), len(y))))
            assert abs(r.m.low - max(floors)) < 1e-12

    texts = ["".join(rnd.choices(["A", "B", "未见", "甲", "乙", "AB", "A甲B"], k=rnd.randint(0, 30))) for _ in range(300)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    patterns, negatives = ["A[^。]{0,2}B", "乙+"], ["未见", "甲甲"]
    got = d.select("i", pr.has_positive_hit(F.col("t"), patterns, negatives, 5).alias("h")).collect()
    for r in got:
        t = texts[r.i] or ""
        assert r.h == any(not any(n in t[max(0, m.start() - 5) : m.end() + 5] for n in negatives) for p in patterns for m in re.finditer(p, t)), t


def test_default_rules(spark):
    rows = [
        (1, "住院病案首页 医疗付费方式"), (2, "司法鉴定委托书 委托贵机构予以鉴定"), (3, "居民身份证 公民身份号码"), (4, "民事起诉状 原告 被告"),
        (5, "CT检查报告 影像表现：肋骨骨折 诊断意见 东城人民医院"), (6, ""), (7, "无关的文字"),
    ]
    d = cl.classify_page(spark.createDataFrame(rows, "page_id int, text string"))
    got = {r["page_id"]: r["prediction"] for r in d.collect()}
    assert (got[1]["type"], got[1]["subtype"], got[1]["confidence"]) == ("medical_record", "medical_home_page", 0.94)
    assert (got[2]["type"], got[2]["confidence"]) == ("entrustment_letter", 0.98)
    assert got[3]["type"] == "id_card" and got[4]["confidence"] == 0.96
    assert (got[5]["type"], got[5]["subtype"], got[5]["confidence"]) == ("imaging_report", "ct_report", 0.90)
    assert got[5]["reason"].startswith("命中关键词：CT、") and got[5]["group"] == "东城人民医院" or got[5]["group"].endswith("东城人民医院")
    assert got[6]["type"] is None and got[6]["reason"] == "无 OCR 文本" and got[6]["continuation"] is False
    assert (got[7]["type"], got[7]["confidence"]) == ("imaging_report", 0.70)
