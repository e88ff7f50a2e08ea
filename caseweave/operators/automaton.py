"""Many words in many texts: one goto/fail/output automaton as flat arrays, run over Arrow batches.

A batch's texts are one buffer of UTF-8 bytes, cut into lanes that overlap by the longest word;
all lanes take a step at a time, so the walk is a few array operations a byte column however
many words there are. Edges lie in one open hash table, which keeps the automaton in proportion
to the words' bytes; the states nearest to the root, in which nearly all steps are taken, also
have their next states in one array.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE, SLICE_BYTES = 1024, 8 << 20
MOST_BYTES = 16 << 20
TABLE = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Goto, fail and output links of distinct non-empty words."""

    def __init__(self, words: list[str]):
        self.words = words
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        self.longest = max(map(len, raw), default=1)
        edges: dict[int, int] = {}
        ends = [-1]
        depth = [0]
        for k, word in enumerate(raw):
            at = 0
            for c in word:
                to = edges.setdefault(at * 256 + c, len(ends))
                if to == len(ends):
                    ends.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            ends[at] = k
        self.size = np.array([len(w) for w in raw], np.int64)
        order = np.argsort(np.array(depth), kind="stable")  # states are numbered by depth
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.ends, depths = np.array(ends)[order], np.array(depth)[order]
        keys, to = (np.fromiter(x, np.int64, len(edges)) for x in (edges, edges.values()))
        keys, to = number[keys >> 8] * 256 + (keys & 255), number[to]
        self._hash(keys, to)
        self._classes(keys)
        self._link(keys, to, depths)

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> None:
        self.bits = max(8, int(4 * len(keys) + 1).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.key[at[left]] < 0
            self.key[at[left[free]]] = keys[left[free]]
            done = self.key[at[left]] == keys[left]
            self.to[at[left[done]]] = to[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def goto(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states along words, -1 where there is none."""
        key = state * 256 + byte
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.to[at], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def _classes(self, keys: np.ndarray) -> None:
        """Bytes that no word holds are one class; the array holds as many states as fit ``TABLE`` entries."""
        self.byte_of = np.append(np.unique(keys & 255), 255)
        self.cls = np.full(256, len(self.byte_of) - 1, np.int64)
        self.cls[self.byte_of] = np.arange(len(self.byte_of))
        self.table = np.zeros((min(len(self.ends), max(1, TABLE // len(self.byte_of))), len(self.byte_of)), np.int64)

    def after(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """``next`` by classes of bytes, from the array where it has the state."""
        near = state < len(self.table)
        if near.all():
            return self.table[state, cls]
        out = np.empty(len(state), np.int64)
        out[near] = self.table[state[near], cls[near]]
        out[~near] = self.next(state[~near], self.byte_of[cls[~near]])
        return out

    def next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after a byte: along a word, else along the fail links."""
        out = self.goto(state, byte)
        left = np.flatnonzero((out < 0) & (state > 0))
        state = state[left]
        while len(left):
            state = self.fail[state]
            to = self.goto(state, byte[left])
            out[left] = to
            on = (to < 0) & (state > 0)
            left, state = left[on], state[on]
        return np.maximum(out, 0)

    def _link(self, keys: np.ndarray, to: np.ndarray, depth: np.ndarray) -> None:
        """Fail links and, along them, each state's nearest shorter word (0: none), level by level."""
        self.fail, self.shorter = np.zeros(len(depth), np.int64), np.zeros(len(depth), np.int64)
        order = np.argsort(depth[to], kind="stable")
        levels = np.searchsorted(depth[to][order], np.arange(1, self.longest + 2))
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            e = order[a:b]
            parent, byte, child = keys[e] >> 8, keys[e] & 255, to[e]
            up = parent > 0
            self.fail[child[up]] = self.next(self.fail[parent[up]], byte[up])
            f = self.fail[child]
            self.shorter[child] = np.where(self.ends[f] >= 0, f, self.shorter[f])
        known = np.arange(len(self.byte_of) - 1)
        for a in range(0, len(self.table), 1 << 14):
            state = np.arange(a, min(len(self.table), a + (1 << 14)))
            to_all = self.next(np.repeat(state, len(known)), np.tile(self.byte_of[:-1], len(state)))
            self.table[state[:, None], known] = to_all.reshape(len(state), -1)
        self.speaks = (self.ends >= 0) | (self.shorter > 0)

    def matches(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, byte after the match within the text) of every occurrence, in the order of texts and places."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        lane = max(LANE, 8 * self.longest)
        n, over = -(-len(data) // lane), self.longest - 1
        wide = np.full(n * lane + over, 255, np.uint8)  # 255 is in no UTF-8 text
        wide[over : over + len(data)] = data
        cls = self.cls.astype(np.uint8)[wide]
        columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(cls, (n, lane + over), (lane, 1)).T)
        state = np.zeros(n, np.int64)
        places, states = [], []
        for j, byte in enumerate(columns):
            state = self.after(state, byte)
            if j >= over:
                said = np.flatnonzero(self.speaks[state])
                if len(said):
                    places.append(said * lane + (j - over))
                    states.append(state[said])
        place, state = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, states))
        found_place, found_word = [], []
        while len(state):
            word = self.ends[state]
            own = word >= 0
            found_place.append(place[own])
            found_word.append(word[own])
            state, on = self.shorter[state], self.shorter[state] > 0
            place, state = place[on], state[on]
        place, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_place, found_word))
        text = np.searchsorted(ends, place, "right") - 1
        inside = (place < len(data)) & (place + 1 - self.size[word] >= ends[text])
        text, word, place = text[inside], word[inside], place[inside] + 1 - ends[text[inside]]
        order = np.lexsort((word, place, text))
        return text[order], word[order], place[order]


    def counts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, n): occurrences that do not overlap, taken from the left, as replacing counts them."""
        text, word, place = self.matches(texts)
        pair = text * max(1, len(self.words)) + word
        order = np.lexsort((place, pair))
        pair, place = pair[order], place[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        n = np.diff(np.append(first, len(pair)))
        close = np.flatnonzero((np.diff(pair, prepend=-1) == 0) & (np.diff(place, prepend=0) < self.size[pair % max(1, len(self.words))]))
        for g in np.unique(np.searchsorted(first, close, "right") - 1).tolist():  # words that overlap themselves
            size, done, taken = int(self.size[pair[first[g]] % len(self.words)]), 0, 0
            for at in place[first[g] : first[g] + n[g]].tolist():
                if at - size >= done:
                    done, taken = at, taken + 1
            n[g] = taken
        return *np.divmod(pair[first], max(1, len(self.words))), n


_built: dict[tuple[str, ...], Automaton] = {}


def automaton_of(words: list[str]) -> Automaton:
    """The last few automata of a worker process are kept between its tasks."""
    key = tuple(words)
    if key not in _built:
        if len(_built) >= 4:
            _built.clear()
        _built[key] = Automaton(words)
    return _built[key]


def word_list(terms: DataFrame, term: str, most_bytes: int) -> Column:
    """All distinct non-empty words as one value, found when the query runs; an error if they hold more than ``most_bytes``."""
    words = terms.select(F.col(term).alias("w")).where(F.col("w") != "").distinct()
    bytes_ = F.coalesce(F.sum(F.octet_length("w")), F.lit(0))
    said = F.lit(f"the words hold more than {most_bytes} bytes: give more parts")
    all_ = F.when(bytes_ <= most_bytes, F.array_sort(F.collect_list("w"))).otherwise(F.raise_error(said).cast("array<string>"))
    return words.agg(all_.alias("words")).scalar()


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``SLICE_BYTES`` of text."""
    ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1].astype(np.int64)
    part = (ends[1:] - ends[0] - 1) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: (key, text, words in the partition's first row) to (key, term, n)."""
    automaton = None
    for batch in batches:
        if batch.num_rows and automaton is None:
            automaton = automaton_of(batch.column(2)[0].as_py())
            names = pa.array(automaton.words, pa.string())
        for part in _slices(batch, 1) if batch.num_rows and automaton.words else ():
            text, word, n = automaton.counts(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), names.take(pa.array(word)), pa.array(n)], ["key", "term", "n"])


def find_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", parts: int = 1, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, term, n): how often every term occurs in the text without overlapping itself, for those that do.

    The term table may be of any shape and is read when the query runs; it reaches each task once,
    in the first row of its partition. ``parts`` deals the terms to as many automata, each of at
    most ``most_bytes`` bytes of words, for tables that are larger. Null texts hold nothing;
    empty and null terms are left out; rows that repeat a key are searched each.
    """
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for p in range(parts):
        own = terms if parts == 1 else terms.where(F.pmod(F.xxhash64(term), F.lit(parts)) == p)
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        slim = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        given = slim.withColumn("words", F.when(first, word_list(own, term, most_bytes)))
        found = given.mapInArrow(_found, f"key {kind}, term string, n long").withColumnRenamed("key", key)
        out = found if out is None else out.unionByName(found)
    return out
