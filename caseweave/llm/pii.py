"""Personal data: rule spans, and more spans chosen by boosted trees among overlapping candidates.

The base rules give spans that always stay. High-recall generators propose further, overlapping
spans: digit groups inside number runs that the rules dropped, four parts of longer dotted runs,
bracketed dots, card numbers with other separators, phone numbers without a plus sign, addresses
written with bracketed "at" and "dot". Boosted trees that know format and context score them; a
proposal is taken if its score reaches its kind's calibrated threshold and it overlaps no span
already taken.

There are no labels for such formats, so they are made: what the rules accept is written anew in
the generators' formats where it stands, and as often as a look-alike of the same shape (dates,
section numbers, wrong check digits, sentences around a bracketed "at").
"""
from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import kept, matrix

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, GROUP, AT = re.compile(r"[0-9]"), re.compile(r"[0-9]+"), re.compile(r"[\[(]at[\])]", re.I)
LOOSE_PHONE = re.compile(r"(?:(?<![0-9+])[0-9]|\((?=[0-9]))[0-9]{1,3}\)?(?:[-. ]{1,2}[0-9]{2,4}){2,4}(?![0-9])")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+", re.I)
DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){4,}")
DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])", re.I)
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:(?:[./]| ?[-/.] ?|  )[0-9]{4}){2}(?:[./]| ?[-/.] ?|  )[0-9]{1,7}(?![0-9])")
NEAR = [re.compile(p, re.I) for p in (r"mail|contact|write", r"tel|phone|call|fax|mobil", r"card|visa|pay|iban", r"\bip\b|host|server|addr")]
REST = frozenset(" -")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_part(p: str) -> bool:
    """At most 255, however many zeros come first."""
    p = p.lstrip("0")
    return len(p) < 3 or (len(p) == 3 and p <= "255")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest run of local signs before an @ that a domain follows, found from the @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, valid) of every match of the base patterns."""
    for s, e in _emails(text):
        yield 0, s, e, True
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        yield 1, m.start(), m.end(), all(map(_is_part, m.group().split(".")))
    for m in CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        yield 2, m.start(), m.end(), 12 <= len(d) <= 19 and luhn(d)
    for m in PHONE.finditer(text):
        n = sum(map(len, GROUP.findall(m.group())))
        yield 3, m.start(), m.end(), 9 <= n <= 15


def base_spans(text: str, found: list | None = None) -> list[Span]:
    return sorted(((k, s, e) for k, s, e, ok in (matches(text) if found is None else found) if ok), key=lambda x: (x[1], x[0]))


class Taken:
    """Disjoint intervals; overlaps are found by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.at: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if self.at and s < self.at[-1][1]:
                self.at[-1] = (self.at[-1][0], max(e, self.at[-1][1]))
            else:
                self.at.append((s, e))

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.at, (e, -1)) - 1  # the last interval that begins before e
        return k >= 0 and self.at[k][1] > s

    def add(self, s: int, e: int) -> None:
        insort(self.at, (s, e))


def proposals(text: str, found: list | None = None) -> list[Span]:
    """Overlapping candidates beyond the base spans; their number is in proportion to the text."""
    found = list(matches(text)) if found is None else found
    out: list[Span] = []
    for k, s, e, ok in found:
        if ok or k not in (2, 3):
            continue
        groups = [(m.start() + s, m.end() + s) for m in GROUP.finditer(text[s:e])]
        for i, (a, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                if k == 2 and n >= 12 and (i or j < len(groups) - 1):
                    out.append((2, a, groups[j][1]))
                if k == 3 and 9 <= n <= 15 and not i:  # a number after the phone was taken with it
                    out.append((3, s, groups[j][1]))
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            parts = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m.group())]
            fit = [e - s <= 3 and _is_part(text[s:e]) for s, e in parts]
            out += [(1, parts[i][0], parts[i + 3][1]) for i in range(len(parts) - 3) if all(fit[i : i + 4])]
        out += [(1, m.start(), m.end()) for m in DEFANGED.finditer(text) if all(map(_is_part, GROUP.findall(m.group())))]
        out += [(2, m.start(), m.end()) for m in LOOSE_CARD.finditer(text)]
        out += [(3, m.start(), m.end()) for m in LOOSE_PHONE.finditer(text)]
    if AT.search(text):
        out += [(0, m.start(), m.end()) for m in SPELLED.finditer(text)]
    taken = Taken([(s, e) for _, s, e, ok in found if ok])
    return [x for x in dict.fromkeys(out) if not taken.meets(*x[1:])]


DOT_BEFORE, DOT_AFTER = re.compile(r"([0-9]+)\.$"), re.compile(r"\.([0-9]+)")
DATE = re.compile(r"(?:[0-9]{4}[-. ][01][0-9][-. ][0-3][0-9]|[0-3][0-9][-. ][01][0-9][-. ](?:[0-9]{2}){1,2})(?:[-. ]{1,2}[0-9]{2}){0,2}")
PHONE_SHAPE = re.compile(r"[0-9]{3}\)?[-. ]{1,2}[0-9]{3}[-. ][0-9]{4}$")


def _sign(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, s, e = span
    body = text[s:e]
    d = _digits(body)
    groups = [g.end() - g.start() for g in GROUP.finditer(body)] or [0]
    before = text[max(0, s - 32) : s]
    rest = before.rstrip(" -(")
    after = text[e : e + 3].lstrip(" -)")
    parts = body.split(".")
    name = re.split(r"[.\])]", body)[-1].strip()
    dots = (DOT_BEFORE.search(before), DOT_AFTER.match(text, e))
    return [
        *(float(kind == k) for k in range(4)),
        len(body), len(d), len(groups), max(groups), min(groups), len(set(d)),
        body.count(" "), body.count("-"), body.count("."), float(body.startswith("+")), float("@" in body),
        float(12 <= len(d) <= 19 and luhn(d)), float(len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)),
        _sign(before[-1:]), _sign(text[e : e + 1]), _sign(rest[-1:]), _sign(after[:1]),
        *(float(bool(p.search(before))) for p in NEAR),
        body.count("["), body.count("("), len(name), float(name.islower()), float(body[:1] in "3456"), float(body[:2] in ("19", "20")),
        *((0.0 if m is None else 1.0 if _is_part(m.group(1)) else 3.0 if m.group(1)[:2] in ("19", "20") and len(m.group(1)) == 4 else 2.0) for m in dots),
        float(bool(DATE.fullmatch(body))), int(d[:4] or 0), float(bool(PHONE_SHAPE.search(body))),
    ]


WIDTH = len(describe("0", (1, 0, 1)))


class Trees:
    """Boosted trees of a fixed depth for the log-odds, on quantile bins of all rows.

    A level is one pass over the coded rows: every task sums gradients by node, feature and bin, Spark adds
    these sums, and the driver picks the splits from them. Sums are whole numbers of 1 / ``UNIT`` and leaves
    whole numbers of 1 / ``GRID``, so results do not depend on the order or the number of the tasks.
    """

    UNIT, GRID, TASK_ROWS = 1 << 24, 1 << 10, 100_000

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, rows: DataFrame) -> Trees:
        """``rows``: x (features), y (0 or 1)."""
        probs = F.array(*[F.lit(k / self.bins) for k in range(1, self.bins)])
        n, *found = rows.agg(F.count("y"), *[F.percentile(F.col("x")[f], probs) for f in range(WIDTH)]).first()
        cuts = [np.unique(c) for c in found]
        fits = np.arange(self.bins)[None, :] < np.array([len(c) for c in cuts])[:, None]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code = np.column_stack([np.searchsorted(q, c) for q, c in zip(cuts, matrix(b.column(0), WIDTH).T, strict=True)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in code], pa.binary()), b.column(1)], ["code", "y"])

        coded = kept(rows.select("x", "y").repartition(n // self.TASK_ROWS + 1).mapInArrow(encode, "code binary, y int"), "coded")
        grown = Trees(self.rounds, self.depth, self.rate, self.bins)  # the same trees on codes
        for _ in range(self.rounds):
            feature, cut, at = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, nodes = 2**level - 1, np.arange(2**level)
                g, h = grown._sums(coded, (feature, at), level)
                gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
                gt, ht = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
                gain = np.where(fits, gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 0.0).reshape(len(nodes), -1)
                best = gain.argmax(1)
                split = gain[nodes, best] > 1e-6
                f, k = np.divmod(best, self.bins)
                for i in np.flatnonzero(split):
                    feature[first + i], at[first + i], cut[first + i] = f[i], k[i], cuts[f[i]][k[i]]
            left = [np.where(split, part[nodes, f, k], total[:, 0, 0]) for part, total in ((gl, gt), (hl, ht))]
            gs, hs = (np.column_stack([part, total[:, 0, 0] - part]).ravel() for part, total in zip(left, (gt, ht), strict=True))
            value = np.rint(self.rate * gs / (hs + 1) * self.GRID) / self.GRID
            grown.trees.append((feature, at, value))
            self.trees.append((feature, cut, value))
        return self

    def _sums(self, coded: DataFrame, tree: tuple, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and their slopes by node of ``level``, feature and bin, over all rows."""
        shape = (2**level, WIDTH, self.bins + 1)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, np.prod(shape)), np.int64)
            for b in batches:
                code = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH)
                p = 1 / (1 + np.exp(-self.odds(code)))
                node = _reached(code, *tree, level) - (2**level - 1)
                cell = ((node[:, None] * WIDTH + np.arange(WIDTH)) * shape[2] + code).ravel()
                for k, v in enumerate((b.column(1).to_numpy() - p, p * (1 - p))):
                    total[k] += np.bincount(cell, np.repeat(np.rint(v * self.UNIT), WIDTH), total.shape[1]).astype(np.int64)
            hit = np.flatnonzero(total.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[0, hit]), pa.array(total[1, hit])], ["cell", "g", "h"])

        out = np.zeros((2, np.prod(shape)))
        for r in coded.mapInArrow(add, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[:, r.cell] = r.g, r.h
        return tuple((out / self.UNIT).reshape(2, *shape))

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, value in self.trees:
            out += value[_reached(x, feature, cut, self.depth) - (2**self.depth - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x)))


def _reached(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    node, rows = np.zeros(len(x), int), np.arange(len(x))
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node


def graded(rows: DataFrame, trees: Trees) -> pd.DataFrame:
    """kind, odds (in 1 / ``GRID``), n and ok (right ones) of all ``rows``; as many as different odds, however many rows."""

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0), WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, :4].argmax(1)), pa.array(np.rint(trees.odds(x) * trees.GRID).astype(np.int64)), b.column(1)], ["kind", "odds", "y"])

    d = rows.select("x", "y").mapInArrow(grade, "kind long, odds long, y int")
    return d.groupBy("kind", "odds").agg(F.count("y").alias("n"), F.sum("y").alias("ok")).toPandas()


def calibrate(scores: np.ndarray, right: np.ndarray, n: np.ndarray, kinds: np.ndarray, precision: float, least: int = 20) -> list[float]:
    """Per kind the lowest threshold whose held-out precision reaches ``precision`` on ``least`` rows; above 1 if none does.

    ``scores`` differ within a kind; ``n`` rows have each, ``right`` of them are right. The
    threshold lies half way to the next lower score, and at 0.5 at least.
    """
    out = []
    for k in range(4):
        order = np.argsort(-scores[kinds == k], kind="stable")
        s, ok, rows = scores[kinds == k][order], right[kinds == k][order].cumsum(), n[kinds == k][order].cumsum()
        reached = np.flatnonzero((ok / np.maximum(rows, 1) >= precision) & (rows >= least))
        below = np.append(s, 0.0)[1:]
        out.append(max(0.5, float(s[reached[-1]] + below[reached[-1]]) / 2) if len(reached) else 2.0)
    return out


def rewritten(kind: int, body: str, pick: int) -> tuple[str, str]:
    """What the rules accept in a format of the generators, and a look-alike of that format; ``pick`` chooses among them."""
    if kind == 0:
        local, domain = body.split("@", 1)
        at = [" [at] ", "(at)", " (at) ", "[at]"][pick % 4]
        dot = ["." if pick % 3 else " [dot] ", ".", " (dot) "][pick % 3]
        words = re.split(r"[^A-Za-z]+", domain + " noon")
        return local + at + domain.replace(".", dot), f"{words[0]} (at) {words[-1]}.{words[0].title()}" + ("" if pick % 2 else f".{words[-1].title()}")
    if kind == 1:
        dot = ["[.]", "(.)", "[dot]"][pick % 3]
        parts = [p.lstrip("0")[-3:] or "0" for p in body.split(".")]
        stamp = f"{1990 + pick % 45}.{pick % 12 + 1}.{pick % 28 + 1}.{pick % 24}.{pick % 60}"
        return dot.join(parts) if pick % 2 else f"{300 + pick % 600}." + ".".join(parts), stamp
    d = _digits(body)
    if kind == 2:
        cut = [d[i : i + 4] for i in range(0, len(d), 4)]
        wrong = d[:-1] + str((int(d[-1]) + 1 + pick % 8) % 10)
        sep = [".", "/", " - ", "  "][pick % 4]
        if pick % 2:
            return sep.join(cut), sep.join(wrong[i : i + 4] for i in range(0, len(wrong), 4))
        return f"{1000 + pick % 9000} {d}", f"{1000 + pick % 9000} {wrong}"
    tail, sep = d[-10:].rjust(9, "5"), [" ", "-", "."][pick % 3]
    area, mid, end = tail[:-7], tail[-7:-4], tail[-4:]
    right = [f"({area}) {mid}-{end}", sep.join([area, mid, end]), sep.join([d[:-10] or "49", area, mid, end]), sep.join(["00" + (d[:-10] or "49"), area, mid, end])][pick % 4]
    year, month, day = 1950 + pick % 90, pick % 12 + 1, pick % 28 + 1
    date = [f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{year} {month:02} {day:02}", f"{year}-{month:02}-{day:02} {pick % 24:02}", f"{pick % 900 + 100} {pick % 800 + 100} {pick % 700 + 200}"]
    return right, date[pick % 5]


def examples(text: str) -> tuple[list[list[float]], list[int]]:
    """Described candidates and weak labels: matches the rules accept and drop, cut-off pieces of accepted ones, and rewritten ones with their look-alikes.

    A rewritten one counts as every generator offers it: its own span is right, other spans that
    meet it are wrong.
    """
    rows, right = [], []
    for k, s, e, ok in matches(text):
        rows.append(describe(text, (k, s, e)))
        right.append(int(ok))
        if not ok:
            continue
        if e - s > 6:
            rows += [describe(text, (k, s, e - 2)), describe(text, (k, s + 2, e))]
            right += [0, 0]
        before, after = text[max(0, s - 40) : s], text[e : e + 8]
        pick = zlib.crc32(f"{s}:{text[s:e]}".encode("utf-8", "replace"))
        for label, body in zip((1, 0), rewritten(k, text[s:e], pick), strict=True):
            own = before + body + after
            whole = (len(before), len(before) + len(body))
            for j, a, b in proposals(own):
                if a < whole[1] and b > whole[0]:
                    true = label and j == k and b == whole[1] and (a == whole[0] or _digits(body[: a - whole[0]]) == body[: a - whole[0]].strip(" .") != "")
                    rows.append(describe(own, (j, a, b)))
                    right.append(int(bool(true)))
    return rows, right


def train(docs: DataFrame, precision: float = 0.995, id_col: str = "doc_id", text_col: str = "text"):
    """Trees and thresholds from the weak labels of all documents; (None, thresholds above 1) without both labels.

    A quarter of the candidates, by their hash, is held out for the thresholds. Candidates stay in
    Spark; sums by node and bin, and counts by score, reach the driver.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(rows, pa.list_(pa.float64())), pa.array(right, pa.int32())], ["doc_id", "x", "y"])

        key, rows, right = [], [], []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, ok = examples(t)
                key += [i] * len(own)
                rows += own
                right += ok
                if len(rows) >= 8192:
                    yield batch()
                    key, rows, right = [], [], []
        yield batch()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    found = texts.mapInArrow(extract, "doc_id long, x array<double>, y int")
    found = kept(found.select("x", "y", (F.pmod(F.xxhash64("doc_id", "x"), F.lit(4)) == 0).alias("held")), "candidates")
    counts = {(r.held, r.y): r["count"] for r in found.groupBy("held", "y").count().collect()}
    if not any(held for held, _ in counts) or {y for held, y in counts if not held} != {0, 1}:
        return None, [2.0] * 4
    trees = Trees().fit(found.where(~F.col("held")))
    got = graded(found.where("held"), trees)
    return trees, calibrate(1 / (1 + np.exp(-got.odds.to_numpy() / trees.GRID)), got.ok.to_numpy(), got.n.to_numpy(), got.kind.to_numpy(), precision)


def find_spans(text: str, model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and kind."""
    found = list(matches(text))
    base = base_spans(text, found)
    trees, thresholds = model
    offered = proposals(text, found) if trees else []
    if not offered:
        return base, base
    score = trees.scores(np.array([describe(text, s) for s in offered]))
    every, taken = list(base), Taken([(s, e) for _, s, e in base])
    for i in sorted(range(len(offered)), key=lambda i: (-score[i], offered[i][1], offered[i][0], offered[i][2])):
        k, s, e = offered[i]
        if score[i] >= thresholds[k] and not taken.meets(s, e):
            every.append((k, s, e))
            taken.add(s, e)
    return base, sorted(every, key=lambda x: (x[1], x[0], x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Offsets are code points, end exclusive. Null and empty texts have no spans: counts 0, the
    sha256 of the empty text, spans "". Rows that repeat an id are searched each; a text of any
    length is searched whole, in time in proportion to it. Without matches to learn from nothing is
    added. An empty table gives no rows. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(slim)
    names = [f"n_{k}" for k in KINDS]
    kind = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    @F.pandas_udf(kind)
    def find(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            base, every = find_spans(t or "", model)
            count = [sum(k == j for k, _, _ in base) for j in range(4)]
            rows.append((*count, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
        return pd.DataFrame(rows, columns=kind.names)

    return slim.select("doc_id", find("text").alias("p")).select("doc_id", "p.*")


def redact(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the found spans redacted and the length column (if any) set anew; null texts stay null."""
    model = train(docs, id_col=id_col, text_col=text_col)

    @F.pandas_udf(T.StringType())
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, find_spans(t, model)[1]) for t in text], dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
