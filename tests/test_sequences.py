"""Order-dependent operators against plain row loops."""
import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from caseweave import fixed
from caseweave.functions.classify import PREDICTION
from caseweave.operators import sequence as sq
from caseweave.operators import split as sp
from caseweave.operators import automaton
from caseweave.operators.automaton import find_terms
from caseweave.operators.keywords import match_terms
from caseweave.operators.windows import entry_table, last_event, merge_adjacent

TYPES = list(fixed.STAGE_ORDER)
ORDER = fixed.STAGE_ORDER


def soft(p):
    if not p["type"]:
        return True
    if p["type"] == "imaging_report" and p["subtype"] == "other_imaging_report" and p["confidence"] <= 0.75 and not p["keywords"]:
        return True
    return p["confidence"] < 0.66 or (p["continuation"] and not p["keywords"])


def by_hand(pages):
    """The row loop: answers (type, subtype, group, confidence, touched) per page."""
    out, prev, seen, closed = [], None, set(), set()
    rank = lambda t: ORDER.get(t or "", 999)
    for i, page in enumerate(pages):
        cur = dict(page)
        t = cur["type"]
        ahead = next((q["type"] for q in pages[i + 1:] if q["type"] and not soft(q)), None)
        hit = False
        if prev:
            pt = prev["type"]
            exam = pt == "medical_record" and t == "imaging_report" and not page["title"]
            hit = (
                (t in closed and rank(pt) > rank(t))
                or (pt == ahead and t != pt and (soft(cur) or rank(t) < rank(pt) or exam))
                or (cur["continuation"] and soft(cur))
                or exam
                or (t in seen and rank(t) < rank(pt) and not page["title"])
            )
        if hit:
            cur.update(type=prev["type"], subtype=prev["subtype"], group=cur["group"] or prev["group"], confidence=min(max(prev["confidence"], 0.78), 0.88), continuation=True)
        out.append((cur["type"], cur["subtype"], cur["group"], round(cur["confidence"], 6), hit))
        if cur["type"] and not soft(cur):
            closed |= {s for s in seen if s in fixed.CLOSING_TYPES and rank(s) < rank(cur["type"])}
            prev = cur
            seen.add(cur["type"])
    return out


def test_correct_sequence_equals_row_loop(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for f in range(25):
        pages = []
        for n in range(rnd.randint(1, 30)):
            t = rnd.choice([None, *TYPES, "medical_record", "imaging_report"])
            pages.append({
                "type": t, "subtype": rnd.choice(["s1", "s2", "other_imaging_report", None]), "group": rnd.choice([None, "g1", "g2"]),
                "confidence": rnd.choice([0.5, 0.7, 0.9, 0.98]), "keywords": rnd.choice([[], ["k"]]), "continuation": rnd.random() < 0.5, "title": False,
            })
        for n, p in enumerate(pages):
            titled = p["type"] is not None and rnd.random() < 0.3
            p["title"] = titled
            text = {"entrustment_letter": "司法鉴定委托书", "id_card": "居民身份证", "traffic_accident_cert": "道路交通事故认定书", "litigation_material": "民事起诉状",
                    "appraisal_application": "鉴定申请书", "medical_record": "入院记录", "imaging_report": "影像表现"}.get(p["type"], "") if titled else "文"
            rows.append((f * 1000 + n, f"f{f}", n + 1, text, (p["type"], p["subtype"], p["group"], p["confidence"], "", p["keywords"], p["continuation"])))
        for n, w in enumerate(by_hand(pages)):
            want[f * 1000 + n] = w
    df = spark.createDataFrame(rows, f"page_id long, file string, page_number int, text string, prediction {PREDICTION}")
    for chunk in (4, 65_536):
        got = {
            r["page_id"]: (r["prediction"]["type"], r["prediction"]["subtype"], r["prediction"]["group"], round(r["prediction"]["confidence"], 6), r["rule"] > 0)
            for r in sq.correct_sequence(df, chunk=chunk).collect()
        }
        assert got == want


def test_split_windows_equal_plain_ones(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice([None, rnd.randint(0, 9)])) for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    b, o = F.floor(F.col("i") / 7), [F.col("i")]
    d = sp.split_row_number(df, ["k"], o, b, "rn")
    d = sp.split_running_sum(d, ["k"], o, b, F.col("v"), "tot")
    d = sp.split_last(d, ["k"], o, b, F.col("v"), "last")
    d = sp.split_next(d, ["k"], o, b, F.col("v"), "next")
    got = {(r.k, r.i): (r.rn, r.tot, r.last, r.next) for r in d.collect()}
    for k in ("a", "b", None):
        vs = [v for kk, _, v in rows if kk == k]
        for i in range(60):
            last = next((v for v in reversed(vs[:i]) if v is not None), None)
            nxt = next((v for v in vs[i + 1:] if v is not None), None)
            assert got[(k, i)] == (i + 1, sum(v or 0 for v in vs[: i + 1]), last, nxt)


def test_merge_adjacent(spark):
    cols = "group_id int, page_id long, page_number int, surgery string, diagnosis string, findings string, treatment string, date string, signature boolean"
    rows = [
        (1, 1, 1, "a", None, None, None, "d1", False), (1, 2, 2, "a", "x", None, None, "d2", False), (1, 3, 3, None, None, None, None, None, True),
        (1, 5, 5, "a", None, "f", None, "d1", False), (1, 6, 6, "b", None, None, "t", "d9", False), (1, 7, 7, None, None, None, None, None, False),
    ]
    got = {tuple(r.source_ids): r for r in merge_adjacent(spark.createDataFrame(rows, cols), ["group_id"]).collect()}
    assert set(got) == {(1, 2, 3), (5,), (6,)}
    assert got[(1, 2, 3)].signature_merged and got[(1, 2, 3)].diagnosis == "x" and got[(1, 2, 3)].confidence == 84


EVENT_PAGES = "group_id int, page_id long, page_number int, surgery string, diagnosis string, findings string, treatment string, date string, signature boolean"


def events_by_rows(rows):
    """The rule read row by row: (page ids, diagnosis) of every event."""
    out, head = [], None
    for r in sorted(rows, key=lambda r: (r[0], r[2] is None, r[2] or 0, r[1])):
        filled, title, date = any(x is not None for x in r[3:7]), r[3] or "手术记录", r[7] or ""
        near = head is not None and head["group"] == r[0] and None not in (r[2], head["at"]) and r[2] - head["at"] <= 1
        if near and (r[8] or title == head["title"] or date == head["date"]):
            head["ids"].append(r[1])
            head["at"] = r[2]
            head["diagnosis"] = head["diagnosis"] or (None if r[8] else r[4])
        elif filled:
            head = {"group": r[0], "ids": [r[1]], "at": r[2], "title": title, "date": date, "diagnosis": r[4]}
            out.append(head)
    return {tuple(e["ids"]): e["diagnosis"] for e in out}


@pytest.mark.parametrize("chunk, dates, steps", [(256, "12", (1, 1, 1, 1, 2)), (3, "12", (0, 1, 1, 1, 1, 2)), (1, "123456", (1, 1, 1, 1)), (4, "123", (0, 0, 1, 1)), (7, "1", (1,))])
def test_merge_adjacent_by_rows(spark, chunk, dates, steps):
    """Random pages, some with equal numbers or none, in groups that chunks cut at many places."""
    rnd = random.Random(chunk)
    pick = lambda *x: rnd.choice(x)
    rows = []
    for g in range(12):
        page = -3
        for i in range(60):
            page += pick(*steps)
            rows.append((g, g * 1000 + i, None if rnd.random() < 0.03 else page, pick(None, None, "a", "b"), pick(None, None, "x"), pick(None, None, None, "f"), pick(None, None, None, "t"), pick(None, *dates), rnd.random() < 0.2))
    got = merge_adjacent(spark.createDataFrame(rows, EVENT_PAGES), ["group_id"], chunk=chunk).collect()
    assert {tuple(r.source_ids): r.diagnosis for r in got} == events_by_rows(rows)


def test_entry_table_has_few_cases():
    """What a chunk makes of any entering event equals a walk, from a table that does not grow with its pages."""
    rnd = random.Random(3)
    for n in (1, 2, 5, 40, 400):
        pages = [{"page": i, "page_id": i, "title": rnd.choice("abc"), "date": rnd.choice("123"), "signature": rnd.random() < 0.2, "filled": rnd.random() < 0.8} for i in range(n)]
        table = list(entry_table(pages))
        assert len(table) <= 7
        for title in "abcz":
            for date in "1239":
                head = {"page": -1, "page_id": -1, "title": title, "date": date, "signature": False, "filled": True}
                want = last_event([head, *pages])
                out = next(o for t, d, o in table if t in (None, title) and d in (None, date))
                assert (out if "head" in out else {**want, "head": -1, "page": out["page"]}) == want


def test_a_hundred_thousand_pages_of_one_run(spark):
    """One group, one run of numbers; events of a few pages, and one that spans many chunks."""
    n = 100_000
    d = spark.range(n).select(
        F.lit(1).alias("group_id"), F.col("id").alias("page_id"), F.col("id").cast("int").alias("page_number"),
        F.when(F.col("id").between(40_000, 70_000), "long").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 3))).alias("surgery"),
        *[F.lit(None).cast("string").alias(c) for c in ("diagnosis", "findings", "treatment")],
        F.concat(F.lit("d"), "id").alias("date"), (F.col("id") % 3 == 2).alias("signature"),
    )
    got = merge_adjacent(d, ["group_id"]).select(F.size("source_ids").alias("n"), F.element_at("source_ids", 1).alias("first")).collect()
    rows = [(1, i, i, "long" if 40_000 <= i <= 70_000 else f"t{i // 3}", None, None, None, f"d{i}", i % 3 == 2) for i in range(n)]
    assert {(r.first, r.n) for r in got} == {(ids[0], len(ids)) for ids in events_by_rows(rows)} and max(r.n for r in got) > 30_000


def test_terms_in_texts(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("abcde é") for _ in range(rnd.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "ab" * 9000)]
    words = {"".join(rnd.choice("abcde é") for _ in range(rnd.randint(1, 5))) for _ in range(30)}
    texts = spark.createDataFrame(rows, "id int, text string").repartition(4)
    terms = spark.createDataFrame([(w,) for w in [*words, *list(words)[:3], "", None]], "term string")
    want = {(i, w, t.count(w)) for i, t in rows if t for w in words if w in t}
    assert {tuple(r) for r in find_terms(texts, "id", "text", terms).collect()} == want and want
    assert {tuple(r) for r in find_terms(texts, "id", "text", terms, parts=3).collect()} == want
    assert {tuple(r) for r in match_terms(texts, "id", "text", terms).collect()} == {w[:2] for w in want}
    assert find_terms(texts, "id", "text", terms.limit(0)).count() == 0
    with pytest.raises(Exception, match="more than 5 bytes"):
        find_terms(texts, "id", "text", terms, most_bytes=5).collect()


@pytest.mark.parametrize("table", [4 << 20, 40])
def test_automaton_equals_a_loop(monkeypatch, table):
    monkeypatch.setattr(automaton, "TABLE", table)
    rnd = random.Random(table)
    for signs in ("ab", "abé医 "):
        for _ in range(20):
            words = sorted({"".join(rnd.choices(signs, k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, 30))})
            texts = ["".join(rnd.choices(signs, k=rnd.choice([0, 1, 5, 40, 3000]))) for _ in range(8)]
            a = automaton.Automaton(words)
            text, word, n = a.counts(pa.array(["pad", *texts]).slice(1))
            assert {*zip(text.tolist(), word.tolist(), n.tolist())} == {(i, k, t.count(w)) for i, t in enumerate(texts) for k, w in enumerate(words) if w in t}
            text, word, place = a.matches(pa.array(texts))
            every = sorted((i, len((t[:p] + w).encode()), k) for i, t in enumerate(texts) for k, w in enumerate(words) for p in range(len(t)) if t.startswith(w, p))
            assert [*zip(text.tolist(), place.tolist(), word.tolist())] == every


def test_ten_thousand_terms(spark):
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choices("abcdefgh", k=rnd.randint(3, 7))) for _ in range(10_000)})
    rows = [(i, "".join(rnd.choices("abcdefgh ", k=200))) for i in range(40)]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    for some in (words, words[:10]):
        got = {tuple(r) for r in match_terms(spark.createDataFrame(rows, "id int, text string"), "id", "text", terms.filter(terms.term.isin(some)) if len(some) < 20 else terms).collect()}
        assert got == {(i, w) for i, t in rows for w in some if w in t}
