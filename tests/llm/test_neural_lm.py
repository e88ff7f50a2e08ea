"""The language model: counts against plain loops, gradients, normalisation, held-out gain, odd rows."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from caseweave.llm import neural_lm

DOCS = "doc_id long, text string, lang string, n long, row long, word string, rest double, base double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "w", 0.5, 0.5) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def slow_base(rows):
    """(id, held out, tokens, known, N, base) of each row."""
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(words(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        own = [*words(t), None]
        out.append((i, held(i), len(own), sum(c[w] > 0 for w in own), n, math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    return out


def corpus(n=300, seed=1):
    """Texts in which each word mostly fixes the next."""
    rng = np.random.default_rng(seed)
    bank = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        at, text = int(rng.integers(60)), []
        for _ in range(int(rng.integers(5, 120))):
            at = (7 * at + 3) % 60 if rng.random() < 0.8 else int(rng.integers(60))
            text.append(bank[at] if rng.random() < 0.97 else f"rare{rng.integers(10**6)}")
        rows.append((i, " ".join(text)))
    return rows


def test_base_scores_and_odd_rows(spark):
    rows = corpus(120) + [(500, None), (501, ""), (502, " \n\t"), (503, "W1 w1 \x00 É é"), (504, "z" * 100_000), (505, "z" * 100_000 + " w1"), (506, "w5 " * 30_000), (7, "w1 again"), (7, "w1 again"), (None, "w2 nobody knows this")]
    got = neural_lm.score_texts(table(spark, rows).repartition(5), head_words=40).collect()
    want = sorted(slow_base(rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-11, atol=1e-9)
    assert all(math.isfinite(g[6]) and g[6] <= 0 for g in got)
    again = neural_lm.score_texts(table(spark, rows).repartition(5), head_words=40).collect()
    assert sorted(round(r.score, 9) for r in again) == sorted(round(g[6], 9) for g in got)


def test_tables_without_training_rows(spark):
    assert neural_lm.score_texts(table(spark, [])).count() == 0
    lone = next(i for i in range(100) if held(i))
    r = neural_lm.score_texts(table(spark, [(lone, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score <= 0


def test_better_than_single_words_on_unseen_texts(spark, monkeypatch):
    monkeypatch.setattr(neural_lm, "BATCH", 128)
    rows = corpus(600)
    got = neural_lm.score_texts(table(spark, rows).coalesce(2)).where("held_out").collect()
    assert len(got) > 50
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)  # nearer to 0


def model(k=9, d=4, seed=0):
    rng = np.random.default_rng(seed)
    share = rng.random(k)
    m = neural_lm.Model.start(share / share.sum(), d, seed)
    return neural_lm.Model(*(x.astype(float) for x in (m.near, m.far, m.out)), m.bias.astype(float), m.share)


def test_probabilities_add_up_to_one():
    m = model()
    batch = pa.RecordBatch.from_arrays([pa.array(range(9))], ["id"])

    class Given:
        value = m

    z = np.zeros((9, 9))
    for b in neural_lm._normalisers(Given)([batch]):
        z[b.column(0)[0].as_py()] = b.column(1)[0].as_py()
    y = np.arange(9)
    for near in range(9):
        for far in range(9):
            p = np.exp(neural_lm.log_probs(m, z, y, np.full(9, near), np.full(9, far)))
            assert abs(p.sum() - 1) < 1e-6


def test_gradients():
    m, rng = model(), np.random.default_rng(3)
    y, near, far, noise = (rng.integers(0, 9, n) for n in (20, 20, 20, 6))
    t = neural_lm.Trainer(m, 0)
    t.log_noise = t.log_noise.astype(float)

    def loss():
        r = t.m.near[near] + t.m.far[far]
        s = (r * t.m.out[y]).sum(1) + t.m.bias[y] - t.log_noise[y]
        n = r @ t.m.out[noise].T + t.m.bias[noise] - t.log_noise[noise]
        return (np.log1p(np.exp(-s)).sum() + np.log1p(np.exp(n)).sum()) / len(y)

    g_row, g_out, g_bias, _ = t.gradients(y, near, far, noise)
    g_near, g_far = np.zeros_like(m.near), np.zeros_like(m.far)
    np.add.at(g_near, near, g_row)
    np.add.at(g_far, far, g_row)
    for x, g in ((t.m.near, g_near), (t.m.far, g_far), (t.m.out, g_out), (t.m.bias, g_bias)):
        for at in map(tuple, rng.integers(0, x.shape, (8, x.ndim))):
            old, e = x[at], 1e-5
            x[at] = old + e
            up = loss()
            x[at] = old - e
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 1e-6
