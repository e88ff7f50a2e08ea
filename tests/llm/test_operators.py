"""The training-data operators against brute force and on nulls, empty and odd texts, ties, repeats and clashing names."""
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from caseweave.llm import language, main_text, mixing, neighbours, pii, pq_join, sampling, simhash, token_store, toxicity
from caseweave.llm.common import class_sample
from caseweave.llm.queries import PIECE_MODEL, PQ_SQL, WORD_TOKENIZER, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, component_id long, fp string"
WORDS = "red green blue cyan plum rose gold gray navy teal lime pink sand mint rust jade".split()


def table(spark, texts, ids=None, langs=None, sources=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""), 1, "x", 2, "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n ", "one", "a b", "Same Words here now", "same words  HERE now", "x" * 5000, " ".join(WORDS * 300)]


def slow_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [8192, 3])
def test_simhash(spark, block):
    rnd = random.Random(1)
    texts = ODD + [" ".join(rnd.choices(WORDS[:4], k=rnd.randint(3, 6))) for _ in range(120)]
    ids = [7, 3, *range(10, 10 + len(texts) - 3), None]
    got = simhash.simhash_groups(table(spark, texts, ids), block=block).collect()
    prints = [slow_print(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((i for i, x in zip(ids, group) if x == g and i is not None), default=None) for g in group}
    want = sorted((i is None, i or 0, p, least[g]) for i, p, g in zip(ids, prints, group))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash.simhash_groups(table(spark, [])).count() == 0


def test_drop_near_copies(spark):
    kept = simhash.drop_near_copies(table(spark, ["a b c d", "a b c d", "A b c d", "other words go here", "a b c d"], [5, 2, 9, 4, 2])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 4]


def test_drop_near_copies_of_repeated_ids(spark):
    copy, lone, none = "a b c d", "quite other words stand here alone", "and a third text without any id"
    d = table(spark, [copy, copy, lone, none, none, copy, lone], [2, 5, 5, None, None, None, 7])
    want = [(2, copy), (5, lone), (None, none)]
    for k in (1, 3, 7):
        assert sorted(((r.doc_id, r.text) for r in simhash.drop_near_copies(d.repartition(k)).collect()), key=str) == want


def test_bk_forest_finds_all():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 4096, 900)).astype(np.uint64)
    tree = simhash.BKForest(values, np.zeros(len(values)))
    found = {(int(a), int(b)) for q, n in tree.search(values, np.full(len(values), tree.root[0]), 2) for a, b in zip(q, n)}
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 2
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


@pytest.mark.parametrize("sizes", [dict(), dict(block=7, list_rows=10)])
def test_pq_groups(spark, sizes):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 20))
    x = np.vstack([base[rng.integers(0, 6, 90)] + 0.12 * rng.normal(size=(90, 20)), np.repeat(base[:1], 5, 0), -base[:2]])
    rows = [(i, [float(v) for v in r], int(i % 2)) for i, r in enumerate(x.astype(np.float32))]
    rows += [(200, None, 1), (201, [0.0] * 20, 1), (202, [float("nan")] * 20, 1), (203, [1.0, None], 1), (204, rows[0][1], None), (205, [2.0 * v for v in rows[0][1]], 0), (206, [], 0), (207, [1.0, 1.0], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = pq_join.pq_groups(e.selectExpr("*", "1 as node", "2 as n_links", "3 as v"), **sizes).toPandas().sort_values("vec_id").reset_index(drop=True)
    c = duckdb.connect()
    embeddings = e.toPandas()
    c.execute("create table embeddings(vec_id bigint, embedding float[], label int)")
    c.executemany("insert into embeddings values (?, ?, ?)", [(i, v, lab) for i, v, lab in rows])
    want = c.execute(PQ_SQL).df().sort_values("vec_id").reset_index(drop=True)
    assert len(got) == len(embeddings) and got.n_links.sum() > 50
    for col in ("n_links", "component_id", "kept"):
        assert got[col].tolist() == want[col].tolist()
    assert pq_join.pq_groups(e.limit(0)).count() == 0


def test_nearest_rows(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 12)), np.repeat(rng.normal(size=(1, 12)), 60, 0), np.eye(12)[[0] * 30]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (420, [0.0] * 12), (440, [float("inf")] * 12), (None, rows_0 := [1.0] * 12), (5, [float(v) for v in x[5]])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest_rows(e.selectExpr("*", "1 as rank", "'a' as score")).collect()
    s = x.astype(float) @ x.astype(float).T
    assert rows_0 and {r.query_id for r in got} == set(range(0, 390, 20))
    for q in range(0, 390, 20):
        want = sorted((i for i in range(390) if i != q), key=lambda i: (-round(s[q, i], 9), i))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and [r.vec_id for r in mine] == want
        assert np.allclose([r.score for r in mine], s[q, want], rtol=1e-12)
    few = neighbours.nearest_rows(e.where("vec_id in (0, 1, 2, 400)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2)] and neighbours.nearest_rows(e.limit(0)).count() == 0


def test_mix_equals_sql(spark):
    rnd = random.Random(5)
    texts = [None, ""] + [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 30))) for _ in range(400)]
    sources = [rnd.choice(["a", "b", "é", "z", None, "tiny"] if k % 40 == 0 else ["a", "a", "a", "b", "z", None]) for k in range(len(texts))]
    d = table(spark, texts, [k // 2 if k > 390 else k for k in range(len(texts))], sources=sources)
    got = mixing.mix(d, [5, 2, 1]).toPandas()
    c = duckdb.connect()
    documents = d.toPandas()[["doc_id", "text", "source"]]
    c.register("documents", documents)
    want = c.execute(mixing.MIX_SQL).df()
    cols = ["doc_id", "size", "source_size", "target", "copies", "taken"]
    assert got[cols].sort_values(cols).values.tolist() == want[cols].sort_values(cols).values.tolist()
    assert (got.taken <= 3 * got["size"]).all()
    for (_, target), taken in got.groupby(["source_size", "target"]).taken.sum().items():
        assert abs(taken - target) <= 40
    assert mixing.mix(d.limit(0), [5, 2, 1]).count() == 0
    assert mixing.mixed(d, [5, 2, 1]).columns == d.columns and mixing.mixed(d, [5, 2, 1]).count() == int(got.copies.sum())


def test_pack_round_trip():
    rng = np.random.default_rng(6)
    for n in (0, 1, 1023, 1024, 1025, 9000):
        v = rng.integers(0, 1 << 15, n).astype(np.uint32)
        v[: n // 50] = rng.integers(0, 2**32, n // 50, dtype=np.uint32)
        assert np.array_equal(token_store.unpack(token_store.pack(v))[0], v)
    v = np.full(5000, 3, np.uint32)
    assert len(token_store.pack(v)) < 200


def test_samples_do_not_depend_on_the_words_met_before(monkeypatch):
    monkeypatch.setattr(sampling, "KEPT_EDGES", 300)
    rnd = random.Random(4)
    v = sampling.Vocabulary(tokenizer_path(PIECE_MODEL))
    texts = [" ".join(rnd.choices([*WORDS, "naïve", "日本", "𠀀x", "▁"], k=rnd.randint(0, 12))) for _ in range(40)]
    keys = np.arange(40).astype(np.uint64) * np.uint64(31)
    kept, met = sampling.Words(v), []
    for a in range(0, 40, 5):
        met += sampling.sample_texts(kept, texts[a : a + 5], keys[a : a + 5], 3)
    for t, k, samples in zip(texts, keys, met):
        alone = sampling.sample_texts(sampling.Words(v), [t], np.array([k]), 3)[0]
        assert [(tuple(x[0]), *np.round(x[1:], 9)) for x in samples] == [(tuple(x[0]), *np.round(x[1:], 9)) for x in alone]
        assert len({tuple(x[0]) for x in samples}) == len(samples)


def test_token_store(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    texts = ODD + ["It's THEY'LL naïve ÀÉ ½ ²", "İstanbul ΣΑΣ 日本語 é", "a<|endoftext|>b", "tab\tnul\x00 \x1f x\xa0y", "\xad--'s 12345"]
    d = table(spark, texts, [None, 50, *range(len(texts) - 2)])
    got = sorted(token_store.token_store(d, tokenizer_path(WORD_TOKENIZER)).collect(), key=lambda r: r.start)
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in d.collect())
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.token_store(d.limit(0), tokenizer_path(WORD_TOKENIZER)).count() == 0


def test_sampled_segmentations(spark):
    model = tokenizer_path(PIECE_MODEL)
    v = sampling.Vocabulary(model)
    words = sampling.Words(v)
    lattice = sampling.Lattice(v, ["▁the"])

    def paths(state):
        if state < 0:
            return {(): 1.0}
        return {(e, *rest): lattice.prob[e] * p for e in range(lattice.first[state], lattice.first[state + 1]) for rest, p in paths(int(lattice.dest[e])).items()}

    exact = {tuple(lattice.ids(np.array(e))): p for e, p in paths(0).items()}
    assert math.isclose(sum(exact.values()), 1)
    drawn = sampling.sample_texts(words, ["the"] * 4000, np.arange(4000).astype(np.uint64) * np.uint64(977), 2)
    for place, share in ((0, lambda s: exact[s]), (1, lambda s: sum(p * exact[s] / (1 - p) for o, p in exact.items() if o != s))):
        for s in exact:
            assert abs(sum(tuple(d[place][0]) == s for d in drawn) / 4000 - share(s)) < 0.03
    assert all(tuple(d[0][0]) != tuple(d[1][0]) and math.isclose(exact[tuple(d[0][0])], math.exp(d[0][1])) for d in drawn)
    every = sampling.sample_texts(words, ["the"], np.array([5], np.uint64), 100)[0]
    assert {tuple(s[0]) for s in every} == set(exact) and all(s[3] == 1 for s in every)
    d = table(spark, ODD + ["日本 \n\t x  y", "▁a ▁", " lead"])
    got = sampling.segmentations(d, model, digest=True).collect()
    assert all(r.round_trip for r in got) and {r.doc_id for r in got} == set(range(len(ODD) + 3))
    again = sampling.segmentations(d.repartition(3), model, digest=True).collect()
    assert {(r.doc_id, r.sample, r.ids_crc32) for r in got} == {(r.doc_id, r.sample, r.ids_crc32) for r in again}
    ids = sampling.segmentations(d, model).where("doc_id = 4 and sample = 1").first().ids
    assert v.decode(ids) == "a b" and sampling.segmentations(d.limit(0), model).count() == 0


def test_toxicity(spark):
    rnd = random.Random(7)
    bad = [k % 4 == 0 for k in range(1200)]
    texts = [" ".join(rnd.choices(WORDS, k=20) + (["vilest"] if b else [])) for b in bad]
    d = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([*((k, int(b)) for k, b in enumerate(bad)), (99999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels).toPandas().set_index("doc_id")
    held = got[got.held_out].loc[lambda g: g.index < 1200]
    assert (held.predicted == [int(bad[i]) for i in held.index]).mean() > 0.98
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all() and got.score.between(0, 1).all()
    assert got.score[1200] == got.score[1201]
    flat = toxicity.toxicity(d, labels.limit(0)).toPandas()
    assert flat.score.nunique() == 1 and toxicity.toxicity(d.limit(0), labels).count() == 0


def test_language(spark):
    rnd = random.Random(8)
    alphabets = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "áéíóúñü"}
    rows = [("".join(rnd.choices(alphabets[lang] + " ", k=rnd.randint(20, 600))), lang) for lang in alphabets for _ in range(60)]
    texts, langs = [t for t, _ in rows] + [None, "", "123 !", "½²"], [lang for _, lang in rows] + ["aa", None, None, None]
    d = table(spark, texts, langs=langs)
    got = language.languages(d).toPandas().set_index("doc_id").sort_index()
    held = got[got.held_out & (got.index < 180)]
    assert (held.lang_pred == [langs[i] for i in held.index]).mean() > 0.95
    assert got.lang_pred[180:].tolist() == ["und"] * 4 and got.score.between(0, 1).all()
    assert language.languages(d.limit(0)).count() == 0
    kept = language.known_language(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(180))


def test_unlearned_languages_go(spark):
    rnd = random.Random(18)
    alphabets = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "áéíóúñü"}
    text = lambda signs, n: "".join(rnd.choices(signs + " ", k=n))
    rows = [(text(alphabets[lang], rnd.randint(20, 600)), lang) for lang in alphabets for _ in range(60)]
    planted = [text(signs, n) for signs in ("абвгдежз", "αβγδεζη", "漢字假名交文", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "acegmoqs") for n in (60, 200, 600)]
    d = table(spark, [t for t, _ in rows] + planted, langs=[lang for _, lang in rows] + [None] * len(planted))
    assert {r.doc_id for r in language.known_language(d).collect()} == set(range(180))


def test_rare_classes_are_sampled(spark):
    langs = ["aa"] * 900 + ["bb"] * 6
    d = table(spark, ["abc abd" if lang == "aa" else "xyz xyw" for lang in langs], langs=langs)
    net = language.train(d, max_rows=30)
    assert net.classes == ["aa", "bb"]
    texts = [f"{' '.join(WORDS[k % 7 : k % 7 + 5])} {'vilest' if k % 100 == 0 else 'mild'}" for k in range(3000)]
    labels = spark.createDataFrame([(k, int(k % 100 == 0)) for k in range(3000)], "doc_id long, toxic int")
    chosen, rates = class_sample(labels, "doc_id", "toxic", 200, 40)
    n = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    assert n[1] == 30 and 150 < n[0] < 250 and rates[1] == 1
    used, weights, bias = toxicity.train(table(spark, texts), labels, max_rows=400)
    assert np.isfinite(bias)


@pytest.mark.parametrize("chunk", [1 << 20, 1])
def test_main_text(spark, chunk):
    top, end = "all of these pages begin with the very same long line of words", "and every one of them ends in this legal line nobody reads"
    pages = [(i, f"http://h.example/{i}", f"<div>{top}<br></div><p>{i} alpha &amp; <b>be</b>ta {i}</p><div>{end}</div>") for i in range(5)]
    pages += [(5, "http://o.example/x", f"<p>{top}</p>"), (6, None, None), (7, "", ""), (8, "http://h.example/8", f"<article><h1>T</h1><p>{top}<nav>n</nav></article><footer>{end}")]
    pages += [(9, "http://p.example/a", f"<p>copy {top}"), (10, "http://p.example/b", f"<p>copy {top}")]
    d = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in main_text.main_texts(d, chunk=chunk).collect()}
    assert all(got[i] == f"{i} alpha & beta {i}" for i in range(5))
    assert (got[5], got[6], got[7], got[8]) == (top, "", "", f"T {top}") and got[9] == got[10] == f"copy {top}"
    assert main_text.main_texts(d.limit(0)).count() == 0


def test_page_markup():
    f = main_text.blocks_of
    page = '<title>t</title><style>p{}</style><script>"</p>"</script><!-- x > --><body><ul class="top-nav"><li>m</ul><div class="ad">a<article><p>one<br>two &eacute;&#33;</p><aside>s</aside>'
    assert f(page + '<form><p>f</form><section id="comments"><article>c</article></section></article><footer>z') == (["one", "two é!"], True)
    assert f("<main>a&am")[0] == ["a&am"] and f('<main>a<a href="/x')[0] == ["a"] and f("<main>a < b</main>")[0] == ["a < b"] and f("<main>a<")[0] == ["a"]
    assert f('<div class="has-sidebar">a<div class="sidebar">b<div>c</div></div>d</div>')[0] == ["a", "d"]


def test_open_pages(spark):
    story = "<div id=content><p>the story stands in a plain element and is told here at some length</p></div>"
    told = "the story stands in a plain element and is told here at some length"
    f = main_text.blocks_of
    assert f(story + '<article class="comment">first!</article>') == ([told], False)
    assert f("<!-- <main> -->" + story) == f("<script>var a = '<article >'</script>" + story) == f('<a title="<main>"></a>' + story) == ([told], False)
    assert f(story + "<article>card</article>") == ([told, "card"], False) and f(story + "<main></main>") == ([told], False)
    assert f("<div>odd line</div><article>" + story + "</article>") == ([told], True)
    top = "all of these pages begin with the very same long line of words"
    d = spark.createDataFrame([(i, "http://h.example/", f'<p>{top}</p><p>{i} x</p><article class="comment">c</article>') for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in main_text.main_texts(d).collect()} == {f"{i} x" for i in range(5)}


@pytest.mark.parametrize("chunk", [1 << 20, 120, 1])
def test_boilerplate_share(spark, chunk):
    rnd = random.Random(12)
    notice, quote = "this notice of ours stands under every single article on the whole site", "a passage that two pages quote from elsewhere is told in many words here"
    own = [" ".join(f"{w}{i}" for w in rnd.choices(WORDS, k=30)) for i in range(16)]
    pages = [(i, "http://a.example/", f"<article><p>{own[i]}<p>{quote if i < 2 else ''}<p>{notice}</article>") for i in range(8)]
    pages += [(i, "http://o.example/", f"<p>{own[i]}<p>{quote if i < 10 else ''}<p>{notice}") for i in range(8, 16)]
    pages += [(16, "http://o.example/", f"<article>{notice}</article>"), (17, "http://c.example/", "<p>a b c")]
    got = {r.page_id: r.text for r in main_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string"), chunk=chunk).collect()}
    assert got == {i: own[i] + (f" {quote}" if i in (0, 1, 8, 9) else "") for i in range(16)} | {16: notice, 17: "a b c"}


def test_unclosed_elements():
    f = lambda page: main_text.blocks_of(page)[0]
    assert f('<article><p class="notice">x<p>real<p>text</article><footer>z</footer><article>more</article>') == ["real", "text", "more"]
    assert f("<article><ul><li class=ad>x<li>a</ul><div><aside>y<p>z</div>b</article><article>c</article>") == ["a", "b", "c"]
    assert f("<main><table><tr><td class=ad>x<td>a<tr class=ad><td>y<tr><td>b</table><dl><dt class=ad>x<dd>c</dl></main>") == ["a", "b", "c"]
    assert f('<article>a <span class="ad">x <span>y</span> z</span> b <span class="ad"><div>x</span> c</article>') == ["a b c"]
    assert f("<article>a<table class=ad><tr><td>x</article><article>b</article>") == ["a", "b"]
    assert f("<article>" + "<div>" * 50_000 + "</section>" * 50_000 + "a</article>") == ["a"]
    assert f('<article><div class="ad"><div>x</div>y<br/><div class="q"/>z</div>a<nav>x<ul><li>y</nav>b</article>') == ["a", "b"]
    kept = '<section id="discussion">a</section><p class="social-policy">b</p><div class="ad-free">c</div><h2 id="search">d</h2>'
    assert f(f"<article>{kept}</article>") == ["a", "b", "c", "d"] and f('<article class="ad-free post">a</article>') == ["a"]
    assert f('<article>a<div class="related-posts">x</div><div class="ad">x</div><div class="newsletter-signup">x</div><div id="comments">x</div></article>') == ["a"]


def slow_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_pii(spark):
    rnd = random.Random(9)
    for _ in range(5000):
        t = "".join(rnd.choices("a.@-+ 1204(9)é", k=40))
        assert pii.base_spans(t) == slow_spans(t)
    card = "4532015112830366"
    texts = [f"w {rnd.choice(WORDS)} {card} x{k} {rnd.randint(10**11, 10**12)} a{k}@b.co" for k in range(300)]
    texts += [None, "", f"two {card} {card} end", "plain words only", f"ip 10.0.0.{255} and 1.2.3.999 tel +49 (30) 1234-567"]
    d = table(spark, texts)
    got = {r.doc_id: r for r in pii.pii_spans(d.withColumn("spans", d.text)).collect()}
    assert got[300].spans == got[301].spans == got[303].spans == "" and got[303].n_added == 0
    assert got[302].n_card == 0 and got[302].spans == "card:4:20,card:21:37"
    assert got[304].spans == pii.written(slow_spans(texts[304])) == "ip:3:13,phone:32:49" and (got[304].n_ip, got[304].n_phone) == (1, 1)
    clean = {r.doc_id: r for r in pii.redacted(d).collect()}
    assert clean[304].text == "ip [IP] and 1.2.3.999 tel [PHONE]" and clean[304].n_chars == len(clean[304].text) and clean[300].text is None
    assert pii.pii_spans(d.limit(0)).count() == 0


def private_texts(rnd, n):
    """Texts with personal data as the base rules know it, between invented words."""
    out = []
    for _ in range(n):
        card = [str(rnd.randint(3, 6)), *(str(rnd.randint(0, 9)) for _ in range(14))]
        card = next("".join(card) + d for d in "0123456789" if pii.luhn("".join(card) + d))
        data = [
            f"{rnd.choice(WORDS)}.{rnd.randint(0, 99)}@mail{rnd.randint(1, 9)}.example.{rnd.choice(['com', 'org', 'net'])}",
            ".".join(str(rnd.randint(1, 255)) for _ in range(4)),
            card,
            f"+{rnd.randint(1, 99)} ({rnd.randint(100, 999)}) 555-{rnd.randint(0, 9999):04}",
        ]
        out.append(" ".join(x for d in data for x in [*rnd.choices(WORDS, k=4), d]) + " end.")
    return out


def test_pii_learns_from_all_candidates(spark, monkeypatch):
    """More candidates than the 30,000 that a sample held: all are learnt from or held out."""
    texts = private_texts(random.Random(8), 1800)
    seen = []
    monkeypatch.setattr(pii.Trees, "fit", lambda self, rows: seen.append(rows.count()) or self)
    monkeypatch.setattr(pii, "calibrate", lambda scores, ok, n, *a: seen.append(n.sum()))
    pii.train(table(spark, texts).select("doc_id", "text"))
    assert len(seen) == 2 and sum(seen) == sum(len(pii.examples(t)[1]) for t in texts) > 30_000


def test_pii_trees(spark, monkeypatch):
    """Leaves agree with sums over all rows, and do not depend on the number of tasks."""
    own, right = zip(*(pii.examples(t) for t in private_texts(random.Random(8), 150)))
    x, y = np.array([r for rows in own for r in rows]), np.array([r for ys in right for r in ys])
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int").cache()
    trees = pii.Trees(rounds=3).fit(rows)
    feature, cut, value = trees.trees[0]
    leaf = pii._reached(x, feature, cut, 3) - 7
    slow = [0.3 * (y[leaf == k] - 0.5).sum() / ((leaf == k).sum() / 4 + 1) for k in range(8)]
    assert np.allclose(value, slow, atol=1 / 1024) and np.abs(value).max() > 0.1
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.8
    monkeypatch.setattr(pii.Trees, "TASK_ROWS", 500)
    again = pii.Trees(rounds=3).fit(rows)
    assert all(np.array_equal(a, b) for s, t in zip(trees.trees, again.trees) for a, b in zip(s, t))


def test_added_spans(spark):
    rnd = random.Random(6)
    planted = {
        "call me on 796-555-0716 now": "796-555-0716",
        "reach (796) 555-0716 today": "(796) 555-0716",
        "dial 0049 796 555 0717 now": "0049 796 555 0717",
        "write jo.81 [at] mail7 [dot] example.com soon": "jo.81 [at] mail7 [dot] example.com",
        "write jo.81(at)mail7.example.com soon": "jo.81(at)mail7.example.com",
        "use 4475.3837.7016.0990 here": "4475.3837.7016.0990",
        "room 1234 4475383770160990 here": "4475383770160990",
        "host 210[.]112[.]33[.]174 is down": "210[.]112[.]33[.]174",
        "host 999.210.112.33.174 is down": "210.112.33.174",
        "from +1 (796) 555-0716 2024 1234567 on": "+1 (796) 555-0716",
    }
    alike = ["born 1999-12-31 there", "on 31.12.1999 we met", "we meet (at) noon.Then we go", "use 4475.3837.7016.0991 here", "version 2024.3.14.7.2 is out", "room 1234 4475383770160991 here"]
    texts = [*planted, *alike, *private_texts(rnd, 700), *(" ".join(rnd.choices(WORDS, k=60)) for _ in range(100))]
    got = {r.doc_id: r for r in pii.pii_spans(table(spark, texts)).collect()}
    for i, (t, want) in enumerate(planted.items()):
        at = t.index(want)
        assert got[i].n_added >= 1 and f":{at}:{at + len(want)}" in got[i].spans, t
    assert all(got[len(planted) + i].n_added == 0 for i in range(len(alike)))
    clean = [r.n_added for i, r in got.items() if i >= len(planted) + len(alike)]
    assert sum(clean) <= 0.005 * 4 * 700


def test_taken_spans_and_long_runs():
    rnd = random.Random(2)
    taken, slow = pii.Taken([(5, 9), (7, 12), (30, 31)]), [(5, 9), (7, 12), (30, 31)]
    for _ in range(500):
        a = rnd.randint(0, 300)
        b = a + rnd.randint(1, 6)
        meets = any(x < b and a < y for x, y in slow)
        assert taken.meets(a, b) == meets
        if not meets:
            taken.add(a, b)
            slow.append((a, b))
    zeros = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(zeros) == [(1, 0, len(zeros))]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == [] and pii.base_spans("1" * 40 + "+" + "0" * 9000) == []
