"""Vector codes by part codebooks, with memoised grid cells.

Vectors become integers and are cut into equal parts; each part position has a codebook of its
own. A part's nearest entry is found through its grid cell: the cell's box gives every entry a
least and a greatest possible distance, entries whose least lies above the smallest greatest are
dominated all over the box, and the rest is remembered for the cell. Only the remembered entries
of a part's cell are evaluated, in whole numbers, so the answer is exactly that of a full search.

Training reads all rows in every round; a task returns the sums of its parts by entry, so what
reaches the driver is the codebooks' fixed size and never the data.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import kept

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELLS = 1 << 16


class Cells:
    """The nearest entry of one codebook (entries x width, whole numbers), by remembered grid cells.

    ``cells`` bounds how many cells are remembered; beyond it the memory starts anew. A cell is
    found by the hash of its coordinates and then compared, so equal hashes do no harm.
    """

    def __init__(self, book: np.ndarray, cells: int = CELLS):
        self.book, self.bound = book, cells
        self.bits = max(1, int(len(book) - 1).bit_length())
        spread = float(np.mean(np.std(book.astype(float), axis=0))) if book.size else 1.0
        self.shift = max(0, int(np.round(np.log2(max(spread, 1.0)))) - 1)  # a cell is about half a standard deviation wide
        rng = np.random.default_rng(7)
        self.mix = rng.integers(1, 1 << 62, max(1, book.shape[1]), dtype=np.int64) | 1
        self._forget()

    def _forget(self) -> None:
        width = self.book.shape[1]
        self.hash, self.cell = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        self.start, self.open = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, cells: np.ndarray) -> None:
        """Remember the entries that are not dominated over each cell's box; ``hashes`` are new and ascending."""
        if len(self.hash) + len(hashes) > self.bound:
            self._forget()
        counts, found = [], []
        for a in range(0, len(cells), 4096):
            low = cells[a : a + 4096, None, :] << self.shift
            below, above = self.book[None] - low, low + ((1 << self.shift) - 1) - self.book[None]
            outside = np.maximum(np.maximum(-below, -above), 0)
            least = (outside * outside).sum(2)
            far = np.maximum(np.abs(below), np.abs(above))
            ok = least <= (far * far).sum(2).min(1)[:, None]
            counts.append(ok.sum(1))
            found.append(np.nonzero(ok)[1])
        sizes = np.concatenate([np.diff(self.start), *counts])
        opens = np.concatenate([self.open, *found])
        all_hash = np.concatenate([self.hash, hashes])
        order = np.argsort(all_hash, kind="stable")
        at = (np.cumsum(sizes) - sizes)[order]
        size = sizes[order]
        start = np.concatenate([[0], np.cumsum(size)])
        self.open = opens[np.repeat(at - start[:-1], size) + np.arange(start[-1])]
        self.hash, self.cell, self.start = all_hash[order], np.concatenate([self.cell, cells])[order], start

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``; ties go to the lower entry."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), 8192):  # as many rows as the memory holds cells, at the most
            code[a : a + 8192], error[a : a + 8192] = self._some(x[a : a + 8192])
        return code, error

    def _some(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = x >> self.shift
        with np.errstate(over="ignore"):
            hashes = (cells * self.mix[: x.shape[1]]).sum(1)
        at = np.searchsorted(self.hash, hashes)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == hashes[known]
        if not known.all():
            new, first = np.unique(hashes[~known], return_index=True)
            fresh = cells[~known][first]
            if len(self.hash) + len(new) > self.bound:
                new, first = np.unique(hashes, return_index=True)
                fresh = cells[first]
            self._learn(new, fresh)
            at = np.searchsorted(self.hash, hashes)
        same = (self.cell[at] == cells).all(1)
        size = np.where(same, np.diff(self.start)[at], len(self.book))  # another cell of the same hash: all entries
        row = np.repeat(np.arange(len(x)), size)
        begin = np.cumsum(size) - size
        step = np.arange(len(row)) - np.repeat(begin, size)
        entry = np.where(same[row], self.open[np.minimum(self.start[at][row] + step, max(len(self.open) - 1, 0))] if len(self.open) else 0, step)
        gap = x[row] - self.book[entry]
        best = np.minimum.reduceat(((gap * gap).sum(1) << self.bits) | entry, begin)
        return best & ((1 << self.bits) - 1), best >> self.bits


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of a list column as rows of ``width``; shorter vectors are filled with zeros.

    Components are held within the bound that keeps every sum of squares in 64 bits, at 4
    components a part 262,144 on either side.
    """
    n = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    most = float(1 << (27 - int(np.ceil(np.log2(max(width // PARTS, 1)) / 2))))
    whole = np.clip(np.floor(flat * SCALE), -most, most - 1).astype(np.int64)
    if (n == width).all():
        return whole.reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = whole
    return out


def _sums(books: np.ndarray, width: int):
    """Arrow function: vectors to (part, entry, count, sums) of a task's parts by their nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Cells(b) for b in books]
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x = whole_numbers(batch.column(0), width).reshape(batch.num_rows, PARTS, -1)
            for p, cells in enumerate(near):
                code, _ = cells.nearest(x[:, p])
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                used = code[order][first]
                count[p] += np.bincount(code, minlength=books.shape[1])
                if books.shape[2] and len(code):
                    total[p][used] += np.add.reduceat(x[order, p], first, axis=0)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": count[part, entry], "sums": pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))})

    return run


def _codes(books: np.ndarray, width: int):
    """Arrow function: (vec_id, vector, label key) to (vec_id, code, error, label key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Cells(b) for b in books]
        for batch in batches:
            x = whole_numbers(batch.column(1), width).reshape(batch.num_rows, PARTS, -1)
            found = [cells.nearest(x[:, p]) for p, cells in enumerate(near)]
            raw = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex() if batch.num_rows else ""
            texts = [raw[i : i + 2 * PARTS] for i in range(0, len(raw), 2 * PARTS)]
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(error, pa.int64()), batch.column(2)], ["vec_id", "code", "error", "label"])

    return run


def finite(vec_col: str) -> Column:
    """True for vectors that are not null and hold no null or non-finite component."""
    v = F.col(vec_col).cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def train(rows: DataFrame, width: int) -> np.ndarray:
    """Codebooks (part x entry x component) of ``rows`` (vec_id, vector)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()  # 64 rows
    if not first:
        return np.zeros((PARTS, 0, width // PARTS), np.int64)
    start = pa.array([r.vector for r in first], pa.list_(pa.float64()))
    books = whole_numbers(start, width).reshape(len(first), PARTS, width // PARTS).swapaxes(0, 1).copy()
    for _ in range(ROUNDS):
        sums = rows.select("vector").mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<long>")
        total = sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in total.collect():  # at most a row for each component of the codebooks
            books[r.part, r.entry, r.pos] = int(r.x) // r.n
    return books


def part_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per valid vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out; a zero vector and
    the empty vector are vectors like any other. Shorter vectors, and widths that 16 does not
    divide, are filled with zeros. Rows with equal ids are rows of their own (the first codebooks
    take them in the order of their vectors, null ids last); with fewer than 64 rows the
    codebooks have as many entries. Null labels are one label. An empty table gives no rows;
    other columns are not read.
    """
    valid = df.where(finite(vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    longest = valid.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    books = train(valid, width)
    text = ",".join(map(str, books.ravel().tolist()))
    coded = kept(valid.mapInArrow(_codes(books, width), f"vec_id long, code string, error long, label {df.schema[label_col].dataType.simpleString()}"), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    joined = coded.join(by_label.withColumnRenamed("label", "other"), F.col("label").eqNullSafe(F.col("other")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


#: A full search by plain sums, for vectors of 64 components with unique ids.
CODES_SQL = (
    """
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, p.part, w[4 * p.part + 1 : 4 * p.part + 4] AS v FROM e CROSS JOIN (SELECT unnest(range(16)) AS part) p),
b0 AS (SELECT part, entry, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT 64) USING (vec_id)),"""
    + "".join(
        f"""
a{k} AS (SELECT vec_id, part, min(d) % 64 AS entry, min(d) // 64 AS d FROM (
    SELECT x.vec_id, x.part, 64 * ((x.v[1]-b.v[1])*(x.v[1]-b.v[1]) + (x.v[2]-b.v[2])*(x.v[2]-b.v[2]) + (x.v[3]-b.v[3])*(x.v[3]-b.v[3]) + (x.v[4]-b.v[4])*(x.v[4]-b.v[4])) + b.entry AS d
    FROM x JOIN b{k} b USING (part)) GROUP BY vec_id, part)"""
        + (
            f""",
n{k} AS (SELECT a.part, a.entry, [floor(sum(x.v[1]) / count(*))::BIGINT, floor(sum(x.v[2]) / count(*))::BIGINT, floor(sum(x.v[3]) / count(*))::BIGINT, floor(sum(x.v[4]) / count(*))::BIGINT] AS v
    FROM a{k} a JOIN x USING (vec_id, part) GROUP BY a.part, a.entry),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN n{k} n USING (part, entry)),"""
            if k < ROUNDS
            else ""
        )
        for k in range(ROUNDS + 1)
    )
    + f""",
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY e.label))::BIGINT AS label_error, h.codebooks_sha256
FROM c JOIN e USING (vec_id) CROSS JOIN h
"""
)
