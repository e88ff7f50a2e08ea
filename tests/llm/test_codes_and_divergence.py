"""Part codes and source divergence against plain loops, on odd rows, ties and repeats."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from caseweave.llm import divergence, part_codes, words

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, vector string"


def slow_codes(rows):
    """(id, label, code, error) of each valid row and the codebooks, by full search."""
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v], la) for i, v, la in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(16, -(-max((len(v) for _, v, _ in rows), default=0) // 16) * 16)
    rows = [(i, v + [0] * (width - len(v)), la) for i, v, la in rows]
    step = width // 16
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))[:64]
    books = [[r[1][p * step : (p + 1) * step] for r in first] for p in range(16)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            of = {}
            for _, v, _ in rows:
                x = v[p * step : (p + 1) * step]
                of.setdefault(near(p, x)[1], []).append(x)
            for k, xs in of.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, la in rows:
        found = [near(p, v[p * step : (p + 1) * step]) for p in range(16)]
        out.append((i, la, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("width", [64, 24, 5])
def test_part_codes(spark, width):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=width) * 0.1], int(i) % 3 or None) for i in rng.permutation(150)]
    rows += [(900, None, 1), (901, [float("nan")] * width, 1), (902, [None] * width, 1), (903, [float("inf")] * width, 1), (904, [0.0] * width, 2)]
    rows += [(905, rows[0][1], 2), (906, rows[0][1], 2), (907, [0.5, -0.5], 7), (908, [], 7), (None, rows[1][1], None)]
    got = part_codes.part_codes(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)).collect()
    want, digest = slow_codes(rows)
    label_error = Counter()
    for _, la, _, e in want:
        label_error[la] += e
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(((i, c, e, label_error[la]) for i, la, c, e in want), key=str)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_part_codes_of_few_rows(spark):
    assert part_codes.part_codes(spark.createDataFrame([], VECTORS)).count() == 0
    huge = [(1, [3e38] * 16, 1, "", 0, ""), (2, [-3e38] * 16, 1, "", 0, "")]
    got = part_codes.part_codes(spark.createDataFrame(huge, VECTORS)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, "00" * 16, 0), (2, "01" * 16, 0)]


@pytest.mark.parametrize("bound", [1 << 16, 40])
def test_cells_equal_a_full_search(bound):
    rng = np.random.default_rng(4)
    for spread in (1, 30, 4000):
        book = (rng.normal(size=(64, 4)) * spread).astype(np.int64)
        cells = part_codes.Cells(book, bound)
        for _ in range(3):
            x = (rng.normal(size=(2000, 4)) * spread * 1.5).astype(np.int64)
            code, error = cells.nearest(x)
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    assert np.diff(cells.start).mean() < 40  # cells leave entries out


def test_equal_hashes_of_unequal_cells():
    book = np.array([[0, 0], [100, 0], [0, 100], [100, 100]])
    cells = part_codes.Cells(book)
    cells.mix = np.zeros(2, np.int64)
    x = np.array([[1, 2], [99, 3], [2, 98], [97, 97], [1, 1]])
    assert cells.nearest(x)[0].tolist() == [0, 1, 2, 3, 0]


def test_words_of():
    texts = ["", "A b", "b", " x\ty ", "Éa É", "..", "long" * 50, "end", "\x00q"]
    for cls, pattern in ((words.WORDS, r"[^\x20\x09-\x0D]+"), (words.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        for column in (pa.array(texts), pa.array(["pad", *texts]).slice(1), pa.array([], pa.string())):
            found, sizes = words.words_of(column, cls)
            low = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in column.to_pylist()]
            assert found.to_pylist() == [w for ws in low for w in ws] and sizes.tolist() == [len(ws) for ws in low]


def test_text_slices():
    batch = pa.RecordBatch.from_pydict({"t": ["aa", "", "bbbbbbbbbb", "c", "d", ""]})
    parts = [p.column(0).to_pylist() for p in words.text_slices(batch, 0, 4)]
    assert sum(parts, []) == batch.column(0).to_pylist() and len(parts) > 2
    assert list(words.text_slices(batch.slice(0, 0), 0)) == []


def slow_divergence(rows, least=3, ranks=200):
    low = [(t or "", la or "", s or "") for t, la, s in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in low]
    out = set()
    for la in {x[1] for x in low}:
        here = [(x[2], ws) for x, ws in zip(low, terms) if x[1] == la]
        docs = Counter(w for _, ws in here for w in set(ws))
        kept = [w for w, n in docs.items() if n >= least]
        counts = {s: Counter(w for s2, ws in here if s2 == s for w in ws if docs[w] >= least) for s in {s for s, _ in here}}
        whole = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(sum((p(c, w) - p(o, w)) ** 2 // p(o, w) for w in kept), s2) for s2, o in counts.items() if s2 != s]
            found = [((p(c, w) - p(whole, w)) ** 2 // p(whole, w), w) for w in kept if c[w] > 0 and p(c, w) > p(whole, w)]
            for part, items, most in (("pair", pairs, None), ("term", found, ranks)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(la, s, part, item, v, k) for k, (v, item) in enumerate(ordered, 1)}
    return out


@pytest.mark.parametrize("ranks", [200, 4])
def test_source_divergence(spark, ranks, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 200)
    rng = np.random.default_rng(ranks)
    bank = ["red", "Blue", "étoile", "zoë", "Gray", "x", "ßig", "navy", "teal", "lime", "pink", "\U00020000", "sand", "mint"]
    rows = [(" ".join(rng.choice(bank, rng.integers(0, 12), p=None)) + "1,2", str(rng.choice(["en", "fr"])), str(rng.choice(["a", "b", "c", "é"], p=[0.6, 0.2, 0.1, 0.1]))) for _ in range(90)]
    rows += rows[:4] + [(None, "en", "a"), ("", None, None), ("red red", None, "a"), ("red", "de", "a"), (None, "it", None), ("one " * 3000, "en", "only")]
    table = spark.createDataFrame([(*r, 1, "t", 2, "p", 3) for r in rows], "text string, lang string, source string, rank int, term string, value long, part string, count long").repartition(5)
    got = [tuple(r) for r in divergence.source_divergence(table, ranks=ranks).collect()]
    want = slow_divergence(rows, ranks=ranks)
    assert len(got) == len(want) and set(got) == want
    assert divergence.source_divergence(table.limit(0)).count() == 0
