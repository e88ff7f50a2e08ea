"""A log-bilinear language model: trained by noise-contrastive estimation, scored with exact normalisation.

The words of all training documents are counted; the most frequent ones are the model's own
outputs and contexts, all others are one output, within which a word has its smoothed share of
the counts. A context is the two words before: it is the sum of their position vectors, and a word's score is the
product with its own vector and a bias.

Training is data-parallel. Every task walks its documents with noise words drawn from the counts
and shared by a batch, so a step is a few matrix products; a round ends in the average of all
tasks' parameters, weighted by their words, and each round takes other documents until all have
been used once. The normaliser of every possible context is then tabulated by matrix products,
one row of contexts a time, so a text's log-probabilities cost a product and a look-up a word.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import crc_fold, kept
from caseweave.llm.words import WORDS, coded, text_slices, words_of

FOLDS, HELD = 7, 2
OUTPUTS, WIDTH = 1024, 16
HEAD, HEAD_BYTES = 1 << 16, 64
ROUNDS, BATCH, NOISE, RATE = 2, 2048, 64, 0.3
OTHER, END = 0, 1
SLICE = 32 << 20
FIXED = 1 << 24
LN10 = np.log(10.0)


@dataclass
class Head:
    """The most frequent words, at most ``HEAD`` of at most ``HEAD_BYTES`` bytes, with their counts; the first are outputs."""

    words: pa.StringArray
    counts: np.ndarray
    outputs: int

    def find(self, distinct: pa.StringArray) -> np.ndarray:
        """Each word's place in the head, -1 outside."""
        return pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def output(self, at: np.ndarray) -> np.ndarray:
        return np.where((at >= 0) & (at < self.outputs - 2), at + 2, OTHER).astype(np.int16)


@dataclass
class Model:
    """Vectors of the word before and the one before that, output vectors and biases (float32), and the outputs' shares."""

    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    share: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, width: int, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        draw = [(rng.normal(size=(len(share), width)) * 0.1).astype(np.float32) for _ in range(3)]
        return cls(*draw, np.log(share).astype(np.float32), share)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.far.ravel(), self.out.ravel(), self.bias])

    def filled(self, flat: np.ndarray) -> Model:
        k, d = self.near.shape
        a = flat[: 3 * k * d].astype(np.float32).reshape(3, k, d)
        return Model(a[0], a[1], a[2], flat[3 * k * d :].astype(np.float32), self.share)


def sequences(texts: pa.StringArray, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """Outputs of all words and ends in order, the text of each, each word's place in the head (an end's: -2), its number, and the distinct words."""
    words, sizes = words_of(texts, WORDS)
    code, distinct = coded(words)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    end = np.cumsum(sizes + 1) - 1
    is_word = np.ones(len(doc), bool)
    is_word[end] = False
    at = np.full(len(doc), -2, np.int64)
    at[is_word] = head.find(distinct)[code]
    ids = head.output(at)
    ids[end] = END
    number = np.full(len(doc), -1, np.int64)
    number[is_word] = code
    return ids, doc, at, number, is_word, distinct


def contexts(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the one before that; before a text stand ends."""
    near, far = np.full(len(ids), END, np.int16), np.full(len(ids), END, np.int16)
    near[1:] = np.where(doc[1:] == doc[:-1], ids[:-1], END)
    far[2:] = np.where(doc[2:] == doc[:-2], ids[:-2], END)
    return near, far


def _scatter(place: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places and the sums of their rows."""
    order = np.argsort(place, kind="stable")
    s = place[order]
    first = np.flatnonzero(np.diff(s, prepend=-1))
    return s[first], np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Noise-contrastive steps with per-coordinate rates (Adagrad) from given parameters."""

    def __init__(self, model: Model, seed: int):
        self.m = Model(model.near.copy(), model.far.copy(), model.out.copy(), model.bias.copy(), model.share)
        self.rng = np.random.default_rng(seed)
        self.upto = np.cumsum(model.share)
        self.log_noise = np.log(NOISE * model.share).astype(np.float32)
        self.past = [np.full_like(x, 1e-3) for x in (model.near, model.far, model.out, model.bias)]
        self.words = 0

    def gradients(self, y: np.ndarray, near: np.ndarray, far: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean loss -log P(data) - sum of log P(noise): by context row, output vectors, biases."""
        m = self.m
        r = m.near[near] + m.far[far]
        mine, theirs = m.out[y], m.out[noise]
        g_data = 1 / (1 + np.exp(-((r * mine).sum(1) + m.bias[y] - self.log_noise[y]))) - 1
        g_noise = 1 / (1 + np.exp(-(r @ theirs.T + (m.bias[noise] - self.log_noise[noise]))))
        g_row = (g_data[:, None] * mine + g_noise @ theirs) / len(y)
        g_out, g_bias = np.zeros_like(m.out), np.bincount(y, g_data, len(m.bias)).astype(np.float32)
        at, sums = _scatter(y, g_data[:, None] * r)
        g_out[at] = sums
        np.add.at(g_out, noise, g_noise.T @ r)
        np.add.at(g_bias, noise, g_noise.sum(0))
        return g_row, g_out / len(y), g_bias / len(y), r

    def step(self, y: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.upto) - 1)
        g_row, g_out, g_bias, _ = self.gradients(y, near, far, noise)
        for x, past, place in ((self.m.near, self.past[0], near), (self.m.far, self.past[1], far)):
            at, g = _scatter(place, g_row)
            past[at] += g * g
            x[at] -= RATE * g / np.sqrt(past[at])
        for x, past, g in ((self.m.out, self.past[2], g_out), (self.m.bias, self.past[3], g_bias)):
            past += g * g
            x -= RATE * g / np.sqrt(past)

    def learn(self, ids: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        order = self.rng.permutation(len(ids))
        for a in range(0, len(ids), BATCH):
            part = order[a : a + BATCH]
            self.step(ids[part], near[part], far[part])
        self.words += len(ids)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: texts to (word, n); the row without a word counts the texts."""
    for batch in batches:
        for part in text_slices(batch, 0, SLICE):
            code, distinct = coded(words_of(part.column(0), WORDS)[0])
            n = np.append(np.bincount(code, minlength=len(distinct)), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([distinct, pa.nulls(1, pa.string())]), pa.array(n)], ["word", "n"])


def _trained(head, model, seed: int):
    """Arrow function: texts to (pos, x): the parameters after this task's texts in fixed point, times its weight, and last the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trainer(model.value, seed)
        for batch in batches:
            for part in text_slices(batch, 0):
                ids, doc, *_ = sequences(part.column(0), head.value)
                own.learn(ids, *contexts(ids, doc))
        if own.words:
            weight = 1 + own.words // BATCH
            x = np.append(np.rint(own.m.flat().astype(float) * FIXED).astype(np.int64) * weight, weight)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["pos", "x"])

    return run


def _normalisers(model):
    """Arrow function: words before to the log-sums over all outputs, for every word before that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for near in batch.column(0).to_pylist():
                s = (m.near[near] + m.far) @ m.out.T + m.bias
                top = s.max(1)
                z = np.log(np.exp(s - top[:, None]).sum(1)) + top
                yield pa.RecordBatch.from_arrays([pa.array([near]), pa.array([z.tolist()], pa.list_(pa.float32()))], ["near", "z"])

    return run


def log_probs(model: Model, table: np.ndarray, ids: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of the outputs after their contexts."""
    out = np.empty(len(ids))
    for a in range(0, len(ids), 1 << 16):
        y, n, f = ids[a : a + (1 << 16)], near[a : a + (1 << 16)], far[a : a + (1 << 16)]
        out[a : a + (1 << 16)] = ((model.near[n] + model.far[f]) * model.out[y]).sum(1) + model.bias[y] - table[n, f]
    return out


SCORED = "row long, doc_id long, held_out boolean, n_words long, known long, base double, model double, word string, rows array<long>, times array<long>"


def _scored(head, model, table, log_all: float, log_other: float):
    """Arrow function: (doc_id, held_out, text) to a row per text, and a row per word outside the head with the texts that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, m, z = head.value, model.value, table.value
        log_count = np.log10(h.counts + 1.0)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [c.split(" ")[0] for c in SCORED.split(", ")]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in text_slices(batch, 2):
                ids, doc, at, number, is_word, distinct = sequences(part.column(2), h)
                n = part.num_rows

                def by_text(weights: np.ndarray, doc: np.ndarray = doc, n: int = n) -> np.ndarray:
                    return np.bincount(doc, weights, n)

                in_head = at >= 0
                own = log_count[at[in_head]]
                base, within = np.zeros(len(ids)), np.zeros(len(ids))
                base[in_head], within[in_head] = own - log_all, own - log_other
                p = log_probs(m, z, ids, *contexts(ids, doc)) / LN10 + np.where(ids == OTHER, within, 0.0)
                whole = [by_text(x).astype(np.int64) for x in (is_word, in_head)]
                rows = np.arange(row, row + n)
                cols = [rows, part.column(0), part.column(1), *whole, by_text(base), by_text(p)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols] + [pa.nulls(n, k) for k in kinds[7:]], names)
                rest = np.flatnonzero(is_word & (at == -1))
                if len(rest):
                    pairs, times = np.unique(number[rest] * n + doc[rest], return_counts=True)
                    word, text = np.divmod(pairs, n)
                    first = np.flatnonzero(np.diff(word, prepend=-1))
                    ends = pa.array(np.append(first, len(word)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (text + row, times)]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(first), k) for k in kinds[:7]] + [distinct.take(pa.array(word[first])), *lists], names)
                row += n

    return run


def frequent(counts: DataFrame, words: int, outputs: int) -> Head:
    """The head of ``counts`` (word, n): whole classes of counts (64 to an octave) from the top, as many as fit ``words``."""
    short = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("class", F.floor(F.log2("n") * 64).cast("int"))
    per_class = sorted(((r["class"], r["count"]) for r in short.groupBy("class").count().collect()), reverse=True)  # some thousand rows at most
    low, n = None, 0
    for c, k in per_class:
        if n + k > words:
            break
        low, n = c, n + k
    found = [] if low is None else sorted(((r.n, r.word) for r in short.where(F.col("class") >= low).collect()), key=lambda x: (-x[0], x[1]))
    return Head(pa.array([w for _, w in found], pa.string()), np.array([c for c, _ in found], np.int64), min(outputs, len(found) + 2))


def train(spark: SparkSession, docs: DataFrame, head, start: Model) -> Model:
    """``docs`` (doc_id, text) once over, in rounds of other documents; the average over the tasks after each."""
    for k in range(ROUNDS):
        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == k).select("text")
        given = spark.sparkContext.broadcast(start)
        sums = part.mapInArrow(_trained(head, given, k), "pos int, x long").groupBy("pos").agg(F.sum("x").alias("x")).collect()  # a row per parameter
        if sums:
            x = np.zeros(len(sums))
            x[[r.pos for r in sums]] = [float(r.x) for r in sums]
            start = start.filled(x[:-1] / x[-1] / FIXED)
    return start


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: int = OUTPUTS, width: int = WIDTH, head_words: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of ``docs``.

    Learned from rows whose crc32 of the id as text (null: empty) mod 7 is not 2. A null text is
    empty and has its end alone. Rows that repeat an id are scored each by its own text and learned
    from as often as they occur. Without training rows all counts are 0 and the model is the
    uniform one it starts from. A word, and a text, may be of any length. An empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_fold(id_col, FOLDS) == HELD).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learned = slim.where("not held_out")
    counts = kept(learned.select("text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word is not null")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("ends")).first()

    found = frequent(words, head_words, outputs)
    own = found.counts[: found.outputs - 2]
    n_other, v_other = total.n - total.ends - int(own.sum()), max(0, total.v - (total.ends > 0) - len(own))
    share = np.concatenate([[n_other, total.ends], own]) + 1.0
    head = sc.broadcast(found)
    model = train(spark, learned.select("doc_id", "text"), head, Model.start(share / share.sum(), width))
    given = sc.broadcast(model)
    lines = spark.range(found.outputs).repartition(min(found.outputs, 4 * sc.defaultParallelism)).mapInArrow(_normalisers(given), "near long, z array<float>")
    table = np.zeros((found.outputs, found.outputs), np.float32)
    for r in lines.collect():  # outputs x outputs numbers
        table[r.near] = r.z
    log_all, log_other, log_end = (float(np.log10(x + 1.0)) for x in (total.n + total.v, n_other + v_other, total.ends))
    scored = kept(slim.mapInArrow(_scored(head, given, sc.broadcast(table), log_all, log_other), SCORED), "scored")

    outside = scored.where("word is not null").select("word", "rows", "times").join(words, "word", "left")
    own, times = F.log10(F.coalesce("n", F.lit(0)) + 1), F.col("e.times")
    outside = outside.select(own.alias("own"), F.col("n").isNotNull().cast("int").alias("in_training"), F.explode(F.arrays_zip("rows", "times")).alias("e"))
    rest = outside.groupBy(F.col("e.rows").alias("row")).agg(
        F.sum((F.col("own") - log_all) * times).alias("rest_base"), F.sum((F.col("own") - log_other) * times).alias("rest_model"), F.sum(F.col("in_training") * times).alias("rest_known")
    )
    texts = scored.where("word is null").drop("word", "rows", "times").join(rest, "row", "left").na.fill(0, ["rest_base", "rest_model", "rest_known"])
    return texts.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.col("rest_known") + int(total.ends > 0)).alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest_base") + (log_end - log_all)).alias("base_score"),
        (F.col("model") + F.col("rest_model")).alias("score"),
    )
