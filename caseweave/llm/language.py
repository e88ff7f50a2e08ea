"""Language by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's
maximum over the window is kept, and a softmax names the language. When applied, embedding and
filters are folded into one table per filter offset, so a convolution is a sum of table rows.
A document's probabilities are the mean over its windows, weighted by their length.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import class_sample, crc_fold, kept

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 12
LETTER = regex.compile(r"\p{L}")


def windows(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last one filled up with zeros."""
    raw = text.encode("utf-8", "replace")
    out = np.zeros(-(-len(raw) // WINDOW) * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1, WINDOW)


class Adam:
    """Adam over a net's arrays, changed in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.steps = p, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k, v in g.items():
            self.m[k] += 0.1 * (v - self.m[k])
            self.s[k] += 0.01 * (v * v - self.s[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.s[k] / (1 - 0.99**self.steps)) + 1e-7)


class ByteNet:
    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes)))
        self.p["c"] = np.zeros(len(classes))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 6) -> ByteNet:
        """Adam on batches drawn evenly from the classes; every step follows from the seed."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(y == k) for k in range(len(self.classes))]
        adam = Adam(self.p)
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(r, -(-batch // len(by_class))) for r in by_class])
            adam.step(self._gradient(x[rows], y[rows]), rate * (1 - step / (steps + 1)))
        return self

    def fit_all(self, x: np.ndarray, y: np.ndarray, shown: np.ndarray, adam: Adam, rng: np.random.Generator, batch: int = 64, rate: float = 0.002) -> int:
        """Adam over all given windows in random order, each shown ``shown[class]`` times on average and once at least; how many were shown."""
        often = shown[y]
        rows = rng.permutation(np.repeat(np.arange(len(x)), np.maximum(1, (often + rng.random(len(x))).astype(int))))
        for at in range(0, len(rows), batch):
            take = rows[at : at + batch]
            adam.step(self._gradient(x[take], y[take]), rate / (1 + adam.steps / 200) ** 0.5)
        return len(rows)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        emb = p["e"][x]
        spread, pooled, where = {}, [], {}
        for w in WIDTHS:
            spread[w] = np.concatenate([emb[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            out = spread[w] @ p[f"f{w}"] + p[f"b{w}"]
            where[w] = out.argmax(1)
            pooled.append(np.take_along_axis(out, where[w][:, None], 1)[:, 0])
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        logit = hidden @ p["o"] + p["c"]
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        d = prob / n
        g = {"o": hidden.T @ d, "c": d.sum(0), "e": np.zeros_like(p["e"])}
        back = (d @ p["o"].T) * (hidden > 0)
        for k, w in enumerate(WIDTHS):
            dw = back[:, k * FILTERS : (k + 1) * FILTERS]
            seen = spread[w][np.arange(n)[:, None], where[w]]
            g[f"f{w}"] = np.einsum("nfd,nf->df", seen, dw)
            g[f"b{w}"] = dw.sum(0)
            to = np.einsum("df,nf->nfd", p[f"f{w}"], dw).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], where[w] + j], to[:, :, j])
        return g

    def folded(self) -> list[list[np.ndarray]]:
        """For each width, one 256-row table per offset; the bias is in the first."""
        out = []
        for w in WIDTHS:
            parts = self.p[f"f{w}"].reshape(w, EMBED, FILTERS)
            tables = [np.ascontiguousarray(self.p["e"] @ part, dtype=np.float32) for part in parts]
            tables[0] += self.p[f"b{w}"]
            out.append(tables)
        return out

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pooled = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            n = WINDOW - w + 1
            out = np.take(parts[0], x[:, :n], axis=0)
            for k in range(1, w):
                out += np.take(parts[k], x[:, k : n + k], axis=0)
            pooled.append(out.max(1))
        logit = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["o"] + self.p["c"]
        prob = np.exp(logit - logit.max(1, keepdims=True))
        return prob / prob.sum(1, keepdims=True)

    def document(self, text: str, tables: list[list[np.ndarray]], at_once: int = 64) -> np.ndarray:
        x = windows(text)
        weight = np.full(len(x), WINDOW, float)
        weight[-1] = np.count_nonzero(x[-1]) or 1
        prob = np.concatenate([self.probabilities(x[k : k + at_once], tables) for k in range(0, len(x), at_once)])
        return weight @ prob / weight.sum()


def labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang and text of the documents with a language."""
    return docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def train(docs: DataFrame, max_rows: int = 6_000, per_doc: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> ByteNet | None:
    """Learn from evenly spaced windows of about 1.5 x ``max_rows`` documents outside the held-out fold.

    Half of ``max_rows`` is dealt evenly to the languages of all rows, so a rare one is learned
    however large the table is. The network sees ``per_doc`` windows of a training document; predictions read whole texts.
    None if no document has a language. ``train_all`` goes on from here with every window.
    """
    known = labelled(docs, id_col, text_col, lang_col).where((crc_fold("doc_id", folds) != held_out) & (F.length("text") > 0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = []
            for t in b.column(2):
                rows = windows(t.as_py())
                x.append(rows[np.unique(np.linspace(0, len(rows) - 1, per_doc).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    chosen, rates = class_sample(known, "doc_id", "lang", max_rows)
    most = 2 * max(max_rows, 20 * len(rates))  # ids that repeat are chosen together
    got = chosen.select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, lang string, x binary").limit(most).toPandas().sort_values(["doc_id", "lang", "x"], kind="stable")
    if got.empty:
        return None
    classes = sorted(got.lang.unique())
    parts = [np.frombuffer(x, np.uint8).reshape(-1, WINDOW) for x in got.x]
    y = np.repeat(got.lang.map(classes.index).to_numpy(), [len(p) for p in parts])
    return ByteNet(classes).fit(np.concatenate(parts), y)


def train_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, at_once: int = 8_192) -> tuple[ByteNet, np.ndarray] | None:
    """Learn from all windows of all documents outside the held-out fold: the net, and byte pairs counted by class.

    The net of ``train`` is where the tasks begin. Each shows it every window of its documents, those of rare
    languages oftener (half of all showings are dealt evenly to the languages), and the nets of the tasks are
    averaged by what they saw. Only sums leave the executors. None if no document has a language.
    """
    net = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, folds=folds, held_out=held_out)
    if net is None:
        return None
    known = labelled(docs, id_col, text_col, lang_col).where((crc_fold("doc_id", folds) != held_out) & F.col("lang").isin(net.classes) & (F.length("text") > 0))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("n")).collect()}
    shown = np.array([0.5 + 0.5 * sum(sizes.values()) / (len(net.classes) * sizes[c]) for c in net.classes])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet(net.classes)
        own.p = {k: v.copy() for k, v in net.p.items()}
        adam, rng = Adam(own.p), np.random.default_rng([7, TaskContext.get().partitionId()])
        pairs, seen, held, n = np.zeros((len(net.classes), 1 << 16), np.int64), 0, [], 0

        def take() -> int:
            x, y = np.concatenate([w for w, _ in held]), np.repeat([k for _, k in held], [len(w) for w, _ in held])
            held.clear()
            for k in np.unique(y):
                pairs[k] += pair_counts(x[y == k])
            return own.fit_all(x, y, shown, adam, rng)

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                held.append((windows(text.as_py()), net.classes.index(lang.as_py())))
                n += len(held[-1][0])
                if n >= at_once:
                    seen, n = seen + take(), 0
        if held:
            seen += take()
        if seen:
            flat = np.concatenate([own.p[k].ravel() for k in own.p]).astype(float)
            at, code = pairs.nonzero()
            out = {
                "kind": np.concatenate([[-2], np.full(len(flat), -1), at]), "i": np.concatenate([[0], np.arange(len(flat)), code]),
                "v": np.concatenate([[float(seen)], flat * seen, pairs[at, code].astype(float)]),
            }
            yield pa.RecordBatch.from_arrays([pa.array(out["kind"], pa.int32()), pa.array(out["i"], pa.int32()), pa.array(out["v"], pa.float64())], ["kind", "i", "v"])

    sums = known.select("lang", "text").mapInArrow(learn, "kind int, i int, v double").groupBy("kind", "i").agg(F.sum("v").alias("v")).toPandas()
    flat = sums[sums.kind == -1].sort_values("i").v.to_numpy() / sums[sums.kind == -2].v.item()
    for k, v in net.p.items():
        net.p[k], flat = flat[: v.size].reshape(v.shape).astype(np.float32), flat[v.size :]
    pairs, own = np.zeros((len(net.classes), 1 << 16)), sums[sums.kind >= 0]
    pairs[own.kind.to_numpy(), own.i.to_numpy()] = own.v.to_numpy()
    return net, pairs


def pair_counts(x: np.ndarray) -> np.ndarray:
    """How often each pair of neighbouring bytes stands in the windows."""
    w = x.astype(np.int32)
    return np.bincount((w[:, :-1] << 8 | w[:, 1:])[(w[:, :-1] > 0) & (w[:, 1:] > 0)], minlength=1 << 16)


class Gate:
    """What labelled documents outside the training sample look like to the network and to its training bytes.

    A softmax must name some language, so its score alone does not tell that a text is in none.
    Beside it stands the mean log-probability of a text's byte pairs in the training windows of the
    named language. A text passes if its score reaches the low ``quantile`` of the held-out
    documents' scores for their own language less 0.3, and its pairs' mean, above that language's
    expected one, theirs less 2; short texts have the more room. Without held-out documents everything passes.
    """

    def __init__(self, net: ByteNet, pairs: np.ndarray):
        self.net, self.pairs, self.usual, self.score, self.typical = net, [], [], 0.0, -np.inf
        for counts in pairs:
            p = counts + 0.05
            p /= p.sum()
            self.pairs.append(np.log(p).astype(np.float32))
            self.usual.append(float(p @ np.log(p)))

    def measure(self, text: str, tables: list[list[np.ndarray]], k: int | None = None) -> tuple[float, float]:
        """Score and typicality of ``text`` for language ``k``, or for the one that the network names."""
        p = self.net.document(text, tables)
        k = int(p.argmax()) if k is None else k
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int32)
        if len(raw) < 2:
            return float(p[k]), 0.0
        # the room of a short text: pairs spread by about 2 around their mean, which makes 4 / sqrt(n)
        return float(p[k]), float(self.pairs[k][raw[:-1] << 8 | raw[1:]].mean()) - self.usual[k] + 4 / (len(raw) - 1) ** 0.5

    def calibrate(self, measures: DataFrame, quantile: float = 0.002) -> Gate:
        """The low ends of all ``measures`` (score, typical); only values up to their quantile are collected."""
        place = quantile * (measures.count() - 1)

        def low(name: str) -> float:
            values = [r[0] for r in measures.select(name).orderBy(name).limit(int(place) + 2).collect()]
            return values[int(place)] + (values[min(int(place) + 1, len(values) - 1)] - values[int(place)]) * (place - int(place))

        if place >= 0:
            self.score, self.typical = low("score") - 0.3, low("typical") - 2.0
        return self

    def passes(self, text: str, tables: list[list[np.ndarray]], min_score: float) -> bool:
        score, typical = self.measure(text, tables)
        return score >= max(min_score, self.score) and typical >= self.typical


def gate(docs: DataFrame, net: ByteNet, pairs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> Gate:
    """The network's gate, calibrated on all labelled documents of the held-out fold, whole texts."""
    known = labelled(docs, id_col, text_col, lang_col).where((crc_fold("doc_id", folds) == held_out) & F.col("lang").isin(net.classes) & F.col("text").rlike(r"\p{L}"))
    out = Gate(net, pairs)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = out.net.folded()
        for b in batches:
            rows = [out.measure(t, tables, out.net.classes.index(k)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1)], ["score", "typical"])

    return out.calibrate(kept(known.select("lang", "text").mapInArrow(measured, "score double, typical double"), "measures"))


def predictor(net: ByteNet | None):
    """Pandas UDF: text to (lang, score); ``und`` with score 0 if null, without a letter, or nothing was learned."""
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predict(text: pd.Series) -> pd.DataFrame:
        tables = net.folded() if net else []
        rows = []
        for t in text:
            if net is None or not t or not LETTER.search(t):
                rows.append(("und", 0.0))
                continue
            p = net.document(t, tables)
            rows.append((net.classes[int(p.argmax())], min(1.0, float(p.max()))))
        return pd.DataFrame(rows, columns=["lang", "score"])

    return predict


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null, empty and letterless texts are ``und`` with score 0. Rows that repeat an id are
    predicted each; equal probabilities go to the language that sorts first. Other columns are
    not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    predict = predictor(train(slim))
    out = slim.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def known_language(docs: DataFrame, min_score: float = 0.3, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those that are in no learned language: without a letter, or turned away by the gate or by ``min_score``."""
    learned = train_all(docs, id_col, text_col, lang_col)
    if learned is None:
        return docs.limit(0)
    judge = gate(docs, *learned, id_col, text_col, lang_col)

    @F.pandas_udf(T.BooleanType())
    def known(text: pd.Series) -> pd.Series:
        tables = judge.net.folded()
        return pd.Series([bool(t and LETTER.search(t)) and judge.passes(t, tables, min_score) for t in text], dtype=bool)

    return docs.where(known(F.col(text_col)))
