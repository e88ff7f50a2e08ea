"""SimHash near-duplicates: fingerprints, shards of equal bands, one BK-tree per shard.

Two 64-bit fingerprints that differ in at most ``radius`` bits agree in at least one of
``radius`` + 1 bands, so the fingerprints that share a band's value form a shard and no link is
lost between shards. Each shard is a BK-tree whose children are keyed by their integer Hamming
distance to the parent; a search follows only the edges within the radius. A shard that is
larger than a block is cut into trees of one block each and searched block by block, so a task
never holds more than two blocks. The trees travel by the shuffle: a broadcast would have to
pass every fingerprint through the driver.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import Forest, components, kept, paired_blocks

BLOCK = 8192
FRONTIER = 1 << 19


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``; null, empty or blank text gives 0."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return text.map(fingerprint, na_action=None).astype("int64")


class BKForest:
    """BK-trees over ``values``, one for each run of equal ``shard`` numbers, built level by level.

    All values that stand at a node are compared at once; the first of each distance becomes the
    child under that distance and the others go on below it: the tree of inserting one by one.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values
        _, first, tree = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first
        at, left = first[tree], np.ones(len(values), bool)
        left[first] = False
        rows = np.flatnonzero(left)
        at = at[rows]
        keys, children = [], []
        while len(rows):
            edge = at * 65 + np.bitwise_count(values[rows] ^ values[at])
            uniq, chosen, group = np.unique(edge, return_index=True, return_inverse=True)
            child = rows[chosen]
            keys.append(uniq)
            children.append(child)
            stay = np.ones(len(rows), bool)
            stay[chosen] = False
            rows, at = rows[stay], child[group][stay]
        edge = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], (np.concatenate(children) if children else edge)[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query position, node) within ``radius``; ``roots`` names each query's tree."""
        todo = [(np.arange(len(queries)), roots)]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right") - lo
            if total := int(n.sum()):
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                todo.append((np.repeat(q, n), self.child[np.repeat(lo, n) + step]))


def _linked(rows: pa.Table, radius: int) -> pa.RecordBatch:
    """Spanning links of the block pairs in ``rows`` (sorted by shard and block pair)."""
    keys = np.column_stack([rows[c].to_numpy() for c in ("band", "value", "bi", "bj")])
    group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
    values, own = rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy()
    nodes, asks = np.flatnonzero(own == keys[:, 2]), np.flatnonzero(own == keys[:, 3])
    tree = BKForest(values[nodes], group[nodes])
    root = np.full(group[-1] + 1, -1)
    root[group[nodes][tree.root]] = tree.root
    asks = asks[root[group[asks]] >= 0]
    forest = Forest(len(values))
    for q, node in tree.search(values[asks], root[group[asks]], radius):
        forest.link(asks[q], nodes[node])
    moved = np.flatnonzero(forest.parent != np.arange(len(values)))
    fps = values.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[forest.parent[moved]])], ["a", "b"])


def shard_links(radius: int, at_once: int = 1 << 16):
    """Arrow function: sorted rows of block pairs to links; holds whole block pairs, ``at_once`` rows or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= at_once:
                rows = pa.concat_tables(held).combine_chunks()
                keys = np.column_stack([rows[c].to_numpy() for c in ("band", "value", "bi", "bj")])
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
                if len(cuts):
                    yield _linked(rows.slice(0, cuts[-1] + 1), radius)
                    rows = rows.slice(cuts[-1] + 1)
                held, n = [rows], rows.num_rows
        if n:
            yield _linked(pa.concat_tables(held).combine_chunks(), radius)

    return run


def fingerprint_links(prints: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` of ``prints`` within ``radius`` bits."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).alias("value")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))
    rows = prints.select("fp", F.explode(bands).alias("s")).select("s.band", "s.value", "fp")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    keys = ["band", "value", "bi", "bj"]
    dealt = paired_blocks(rows, sizes, ["band", "value"], block, F.xxhash64("fp"))
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(shard_links(radius), "a long, b long")


def _rooted(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """The distinct fingerprints of ``rows`` (doc_id, fp) with their smallest id and their group: fp, first_id, root."""
    prints = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(fingerprint_links(prints, radius, block)).select(F.col("id").alias("fp"), "root")
    return prints.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (signed long) and ``component_id``.

    ``component_id`` is the smallest id that links of at most ``radius`` bits reach. Null, empty
    and blank texts have fingerprint 0 and link like any other; repeated rows stay repeated; rows
    without an id take part but name no group; other columns are not read. An empty table gives an
    empty result.
    """
    udf = fingerprint_udf if words == 3 else F.pandas_udf(lambda s: s.map(lambda t: fingerprint(t, words)).astype("int64"), T.LongType())
    rows = kept(docs.select(F.col(id_col).cast("long").alias("doc_id"), udf(F.col(text_col)).alias("fp")), "prints")
    rooted = _rooted(rows, radius, block)
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, of these the one with the smallest row hash.

    Ids may repeat with other texts; each row stands in its own text's group. Rows without an id
    come last in theirs. Equal rows leave one. The same rows stay in every run.
    """
    columns = [c for c, kind in docs.dtypes if "map<" not in kind]
    hashes = [F.xxhash64(F.lit(k), *columns).alias(f"llm_row{k}") for k in (0, 1)]
    rows = kept(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp"), *hashes), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "llm_row0", "llm_row1")
    first = rows.join(_rooted(rows, radius, BLOCK).select("fp", "root"), "fp").groupBy("root").agg(F.min(place).alias("m"))
    keys = ["llm_row0", "llm_row1"]
    return docs.select("*", *hashes).join(first.select("m.llm_row0", "m.llm_row1"), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
