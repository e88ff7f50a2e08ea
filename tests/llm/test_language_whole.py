"""F8 of round 4: the language stage of the pipeline learns from all documents, not from a sample."""
import random
from zlib import crc32

import numpy as np

from caseweave.llm import language
from test_operators import table


def test_learns_from_every_window(spark, monkeypatch):
    rnd = random.Random(5)
    alphabets = {"aa": "abcdefg", "bb": "mnopqrs"}
    langs = [rnd.choice(["aa", "bb"]) for _ in range(10_000)]
    texts = ["".join(rnd.choices(alphabets[lang] + " ", k=rnd.randint(30, 60))) for lang in langs]
    texts[7] = "".join(rnd.choices(alphabets[langs[7]], k=256 * 20))
    d = table(spark, texts, langs=langs).repartition(3)
    wanted = np.zeros((2, 1 << 16))
    held = [crc32(str(i).encode()) % 4 == 2 for i in range(10_000)]
    for i, text in enumerate(texts):
        for at in range(0, 0 if held[i] else len(text), 256):
            raw = text[at : at + 256].encode()
            for a, b in zip(raw, raw[1:]):
                wanted[["aa", "bb"].index(langs[i]), a << 8 | b] += 1
    net, pairs = language.train_all(d)
    assert (pairs == wanted).all() and net.classes == ["aa", "bb"] and all(np.isfinite(v).all() for v in net.p.values())
    tables = net.folded()
    assert np.mean([net.classes[int(net.document(t, tables).argmax())] == lang for t, lang in zip(texts[:300], langs)]) > 0.98
    measured, calibrate = [], language.Gate.calibrate

    def counted(self, measures, quantile=0.002):
        measured.extend(tuple(r) for r in measures.collect())
        return calibrate(self, measures, quantile)

    monkeypatch.setattr(language.Gate, "calibrate", counted)
    judge = language.gate(d, net, pairs)
    assert len(measured) == sum(held)
    assert abs(judge.score - np.quantile([s for s, _ in measured], 0.002) + 0.3) < 1e-12
    assert abs(judge.typical - np.quantile([t for _, t in measured], 0.002) + 2.0) < 1e-9
