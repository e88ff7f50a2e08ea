"""Distinct sampled segmentations of SentencePiece text: Gumbel top-k without replacement.

A text's segmentations form a lattice over the vocabulary; a path's probability is the product
of its pieces' weights, normalised over all paths. No piece crosses from a word into the next
blank, so the lattice is a chain of word lattices, and equal words share one. Backward sums turn
edge weights into conditional probabilities, which makes the search for the paths of largest
perturbed log-probability a perturbed A-star search with an exact bound: a node's bound is its
own Gumbel maximum, drawn top-down. Along a path the bound stays that of the root, and every
node beside it waits in the queue with a Gumbel cut off at its parent's. The next sample leaves
the queue at its maximum, keeps the path up to there and draws the rest anew. After ``k`` samples
the queue's maximum is the threshold of the inclusion scores.

All random numbers are hashes of the row key, the sample, the word and the step.
"""
from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = re.compile("▁+[^▁]*|[^▁]+")
BATCH_CHARS = 1 << 19
KEPT_EDGES = 1 << 20
FAINT = 60.0
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_one(x: int) -> U:
    """``mix64`` of one number."""
    x &= 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return U(x ^ (x >> 31))


def uniform(seed: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) fixed by a 64-bit seed and two counters."""
    h = mix64(seed + np.asarray(a).astype(U) * U(0x9E3779B97F4A7C15))
    h = mix64(h + np.asarray(b).astype(U) * U(0xD1342543DE82EF95) + U(1))
    return ((h >> U(11)).astype(float) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces, weights and a trie of a SentencePiece model.

    A unigram model's scores are its log-probabilities. A BPE model's scores are merge ranks;
    they become log-probabilities by Zipf's law over the rank. A sign without a piece of its own
    is written as its bytes, or as the unknown piece if the model has no bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        usual = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        if score[usual].max() <= 0 and np.all(score == np.round(score)):
            score = -np.log(2.7 - score)
        self.weight = score - np.log(np.exp(score[usual]).sum())
        self.byte = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.rare = float(self.weight[usual].min()) - 1
        self.unknown = sp.unk_id()
        self.raw = [bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else names[i].replace("▁", " ").encode() if usual[i] else (" ⁇ ".encode() if i == self.unknown else b"") for i in range(n)]
        self.code = np.zeros(0x110000, np.int32)
        signs = sorted({c for i in range(n) if usual[i] for c in names[i]})
        for k, c in enumerate(signs, 1):
            self.code[ord(c)] = k
        self.width = len(signs) + 1
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i in range(n):
            if usual[i]:
                if re.search("[^▁]▁", names[i]):
                    raise ValueError(f"piece {i} reaches into the next word")
                at = 0
                for c in names[i]:
                    step = (at, int(self.code[ord(c)]))
                    if step not in nodes:
                        nodes[step] = len(piece)
                        piece.append(-1)
                    at = nodes[step]
                piece[at] = i
        self.piece = np.array(piece, np.int32)
        self.depth = max(map(len, (names[i] for i in range(n) if usual[i])))
        self.key, self.next = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, np.int64)
        while 4 * len(nodes) > len(self.key):
            self.key, self.next = np.full(2 * len(self.key), -1, np.int64), np.zeros(2 * len(self.key), np.int64)
        for (a, c), to in nodes.items():
            key = a * self.width + c
            at = int(self._slot(np.array([key]))[0])
            while self.key[at] >= 0:
                at = (at + 1) % len(self.key)
            self.key[at], self.next[at] = key, to
        self.raw_size = np.array([len(r) for r in self.raw], np.int32)
        self.raw_start = np.cumsum(self.raw_size, dtype=np.int32) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) % len(self.key)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's next nodes, -1 where there is none (a hash table with linear probing)."""
        key = node * self.width + code
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.next[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.key)
            found = self.key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.next[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.raw_size[ids]
        end = np.cumsum(size, dtype=np.int32)
        at = np.arange(end[-1] if len(end) else 0, dtype=np.int32) + np.repeat(self.raw_start[ids] - end + size, size)
        return self.raw_bytes[at].tobytes()[1:]

    def decode(self, ids) -> str:
        """Text of token ids, without the blank that encoding puts in front."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def chunks_of(text: str) -> list[str]:
    """The text's words, each with the blanks before it."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or "▁" in text or not text:
        return CHUNK.findall(normalized(text))
    return text.split(" ")


def normalized(text: str) -> str:
    return "▁" + text.replace(" ", "▁")


class Lattice:
    """The lattices of distinct words side by side; a state is a sign's position, edges are pieces."""

    GROWS = {"start": np.int64, "src": np.int64, "piece": np.int32, "dest": np.int64, "log_prob": float, "prob": float, "upto": float, "rare_size": np.int64, "rare_ids": np.int32}

    def __init__(self, vocabulary: Vocabulary, words: list[str] = ()):
        self.vocabulary, self.first = vocabulary, np.zeros(1, np.int64)
        for name, kind in self.GROWS.items():
            setattr(self, name, np.zeros(0, kind))
        if words:
            self.add(words)

    def add(self, words: list[str]) -> None:
        """Set the lattices of more words beside those that are there."""
        states, edges, rare = len(self.first) - 1, len(self.src), len(self.rare_size)
        more = self._built(words)
        more["start"] += states
        more["src"] += states
        more["dest"][more["dest"] >= 0] += states
        more["piece"][more["piece"] < 0] -= rare
        self.first = np.concatenate([self.first, more.pop("first")[1:] + edges])
        for name, x in more.items():
            setattr(self, name, np.concatenate([getattr(self, name), x.astype(self.GROWS[name], copy=False)]))

    def _built(self, words: list[str]) -> dict[str, np.ndarray]:
        v = self.vocabulary
        signs = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<i4")
        size = np.fromiter(map(len, words), np.int32, len(words))
        start = np.cumsum(size, dtype=np.int64) - size
        left = np.repeat((start + size).astype(np.int32), size) - np.arange(len(signs), dtype=np.int32)
        code = v.code[signs]
        pos, node = np.arange(len(signs), dtype=np.int32), np.zeros(len(signs), np.int64)
        starts, lengths, pieces = [], [], []
        depth = 0
        while len(pos):
            if depth:
                ok = left[pos] > depth
                pos, node = pos[ok], node[ok]
            node = v.step(node, code[pos + depth])
            ok = node >= 0
            pos, node = pos[ok], node[ok]
            depth += 1
            piece = v.piece[node]
            ok = piece >= 0
            starts.append(pos[ok])
            pieces.append(piece[ok])
            lengths.append(np.full(len(starts[-1]), depth, np.int32))
        single = np.zeros(len(signs), bool)
        if starts:
            single[starts[0]] = True
        rare = np.flatnonzero(~single).astype(np.int32)
        src, length, piece = (np.concatenate(x) for x in ([rare, *starts], [np.ones(len(rare), np.int32), *lengths], [-1 - np.arange(len(rare), dtype=np.int32), *pieces]))
        order = np.argsort(src, kind="stable")  # merges the runs of each length
        src, length, piece = src[order], length[order], piece[order]
        # written as bytes, or the unknown piece
        coded = [[v.byte[b] for b in chr(c).encode("utf-8", "replace")] if v.byte else [v.unknown] for c in signs[rare].tolist()]
        rare_size = np.array([len(c) for c in coded], np.int64)
        rare_ids = np.array([i for c in coded for i in c], np.int32)
        weight = v.weight[piece]
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            which = -1 - piece[odd]
            weight[odd] = v.rare * rare_size[which]
            starts_at = np.cumsum(rare_size) - rare_size
            one = rare_size[which] == 1  # a single byte is an id like any other
            piece[odd[one]] = rare_ids[starts_at[which[one]]]
        row = left[src]
        order = np.argsort(row.astype(np.uint16) if len(row) and row.max() < 1 << 16 else row, kind="stable")
        beta = np.zeros(len(signs) + 1)
        total = np.empty(len(src))
        by_row = row[order]
        cuts = np.flatnonzero(np.diff(by_row, prepend=0))
        for a, b in zip(cuts, [*cuts[1:], len(src)], strict=True):
            e = order[a:b]
            s, n = src[e], length[e]
            x = weight[e] + np.where(n == by_row[a], 0.0, beta[np.minimum(s + n, len(signs))])
            total[e] = x
            heads = np.flatnonzero(np.diff(s, prepend=-1))
            top = np.maximum.reduceat(x, heads)
            beta[s[heads]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff([*heads, b - a]))), heads))
        dest = np.where(length == row, -1, src + length).astype(np.int64)
        log_prob = total - beta[src]
        prob = np.exp(log_prob)
        first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(signs)))])
        up = np.concatenate([[0.0], np.cumsum(prob)])
        base = up[first[src]]
        upto = (up[1:] - base) / np.maximum(up[first[src + 1]] - base, 1e-300)
        if len(src):
            upto[first[1:] - 1] = 2.0  # a state's last edge takes what is left
        return {"start": start, "src": src.astype(np.int64), "piece": piece, "dest": dest, "log_prob": log_prob, "prob": prob, "upto": upto, "first": first, "rare_size": rare_size, "rare_ids": rare_ids}

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.first[state]
        on = np.flatnonzero(self.upto[e] <= u)
        while len(on):
            e[on] += 1
            on = on[self.upto[e[on]] <= u[on]]
        return e

    def walk(self, state: np.ndarray, seed: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled paths from each state to its word's end: (row, edge), ordered by row and step."""
        rows, edges, step = [], [], 0
        row = np.arange(len(state), dtype=np.int32)
        while len(row):
            e = self.draw(state, uniform(seed[row], word[row], step))
            rows.append(row)
            edges.append(e)
            state = self.dest[e]
            on = state >= 0
            row, state, step = row[on], state[on], step + 1
        rows, edges = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, edges))
        order = np.argsort(rows, kind="stable")
        return rows[order], edges[order]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        piece = self.piece[edges]
        if (piece >= 0).all():
            return piece.astype(np.int32)
        rare = -1 - np.minimum(piece, -1)
        size = np.where(piece >= 0, 1, self.rare_size[rare])
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = (np.cumsum(self.rare_size) - self.rare_size)[rare]
        known = np.repeat(piece, size)
        return np.where(known >= 0, known, self.rare_ids[np.minimum(np.repeat(start, size) + at, len(self.rare_ids) - 1)]).astype(np.int32)


def cut_gumbel(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at ``location``, conditioned to lie below ``most``."""
    with np.errstate(divide="ignore", over="ignore"):
        return location - np.logaddexp(location - most, np.log(-np.log(u)))


class Paths:
    """The search of one text: its samples so far and the queue of nodes beside them."""

    def __init__(self, lattice: Lattice, state: np.ndarray, seed: int):
        self.lattice, self.state, self.seed = lattice, state, seed
        self.samples: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # edges, word of each, log p, perturbed
        self.queue: list[tuple[np.ndarray, int]] = []  # bounds beside a sample's steps from some step on
        self.again: list[tuple[float, int, int, frozenset]] = []  # bound, sample, step, edges that are used up

    def _u(self, k: int, what: int, n: int) -> np.ndarray:
        return uniform(np.full(n, mix_one(self.seed + k * 8 + what)), np.arange(n), 0)

    def add(self, edges: np.ndarray, word: np.ndarray, perturbed: float, since: int) -> None:
        """A new sample whose steps from ``since`` on are fresh; the nodes beside those join the queue.

        A node's mass falls with every step before it. Those that come after a path's first
        e^-60 of mass are left out: no double holds them beside the others.
        """
        lat = self.lattice
        log_p = lat.log_prob[edges]
        done = np.cumsum(log_p)
        n = max(since, int(np.searchsorted(-done, FAINT)) + 1)
        e, log_q = edges[since:n], log_p[since:n]
        with np.errstate(divide="ignore"):
            beside = np.log(np.maximum(1 - np.exp(log_q), 0)) + done[since:n] - log_q
        beside[lat.first[lat.src[e] + 1] - lat.first[lat.src[e]] == 1] = -np.inf
        bound = cut_gumbel(beside, np.full(len(e), perturbed), self._u(len(self.samples), 1, len(e) + since)[since:])
        bound[~np.isfinite(beside)] = -np.inf
        self.samples.append((edges, word, float(done[-1]) if len(done) else 0.0, perturbed))
        self.queue.append((bound, since))

    def best(self) -> tuple[float, int, int, frozenset]:
        """The queue's maximum: (bound, sample, step, used edges); bound -inf if no path is left."""
        top = max(self.again, default=(-np.inf, -1, -1, frozenset()), key=lambda x: x[0])
        for k, (bound, since) in enumerate(self.queue):
            if len(bound) and (b := bound[i := int(bound.argmax())]) > top[0]:
                top = (float(b), k, i + since, frozenset([int(self.samples[k][0][i + since])]))
        return top

    def pick(self, top: tuple[float, int, int, frozenset]) -> tuple[int, int, U]:
        """Leave the queue at ``top``: another edge there, the state it leads to and the seed of the rest of its word."""
        bound, k, step, used = top
        old = self.samples[k][0]
        new = len(self.samples)
        lat = self.lattice
        at = int(lat.src[old[step]])
        edges = np.arange(lat.first[at], lat.first[at + 1])
        p = lat.prob[edges]
        p[[e - edges[0] for e in used]] = 0.0
        u = self._u(new, 2, 1)[0]
        e = int(edges[min(np.searchsorted(np.cumsum(p), u * p.sum(), "right"), np.flatnonzero(p)[-1])])
        if k < len(self.queue) and step >= self.queue[k][1] and len(used) == 1:
            self.queue[k][0][step - self.queue[k][1]] = -np.inf
        self.again = [a for a in self.again if not (a[1] == k and a[2] == step)]
        rest = float(p.sum() - lat.prob[e])
        if len(used) + 1 < len(edges) and rest > 1e-12:
            before = float(lat.log_prob[old[:step]].sum())
            g = cut_gumbel(np.array([before + np.log(rest)]), np.array([bound]), self._u(new, 3, 1))[0]
            self.again.append((float(g), k, step, used | {e}))
        return e, int(lat.dest[e]), mix_one(self.seed + new * 8 + 4)

    def branch(self, top: tuple[float, int, int, frozenset], e: int, tail: np.ndarray, fresh: tuple[np.ndarray, np.ndarray]) -> None:
        """The path up to ``top``, the picked edge, the ``tail`` of its word and the ``fresh`` words after it."""
        bound, k, step, _ = top
        old, word, _, _ = self.samples[k]
        path = np.concatenate([old[:step], [e], tail, fresh[1]])
        words = np.concatenate([word[:step], np.full(1 + len(tail), word[step]), fresh[0]])
        self.add(path, words, bound, step + 1)


class Words:
    """The lattices of the words met so far, up to about ``KEPT_EDGES`` edges; then only those that came again."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._start({})

    def _start(self, words: dict[str, int]) -> None:
        self.plain = Numbers((w, i) for i, w in enumerate(words))  # words after one blank are numbered without it
        self.uses = np.zeros(0, np.int64)
        self.lattice = Lattice(self.vocabulary, [w if w[:1] == "▁" else "▁" + w for w in words])

    def numbered(self, texts: list[str]) -> list[list[int]]:
        """Each text's words as numbers; their lattices are there afterwards."""
        if len(self.lattice.src) > KEPT_EDGES:
            again = self.uses > 2
            self._start(dict.fromkeys(w for w, i in self.plain.items() if again[i]) if again.sum() * 2 < len(again) else {})
        known = len(self.plain)
        chunks = [list(map(self.plain.__getitem__, chunks_of(t))) for t in texts]
        if new := list(itertools.islice(self.plain, known, None)):
            self.lattice.add([w if w[:1] == "▁" else "▁" + w for w in new])
        return chunks

    def used(self, flat: np.ndarray) -> None:
        n = np.bincount(flat, minlength=len(self.plain))
        n[: len(self.uses)] += self.uses
        self.uses = n


def sample_texts(words: Words, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct samples: (ids, log-probability, perturbed, inclusion), best first.

    ``keys`` are 64-bit seeds. The result for a text depends on its key and itself alone.
    """
    chunks = words.numbered(texts)
    lattice = words.lattice
    size = np.array([len(c) for c in chunks])
    flat = np.fromiter(itertools.chain.from_iterable(chunks), np.int64, size.sum())
    words.used(flat)
    begin = np.cumsum(size) - size
    word = np.arange(len(flat)) - np.repeat(begin, size)
    state = lattice.start[flat]
    searches: list[Paths] = []
    keys = keys.astype(U)
    tops: list = []
    wanted = np.arange(len(flat))
    for j in range(k):
        if j:
            tops = [s.best() for s in searches]
            last = np.array([int(s.samples[t[1]][1][t[2]]) if t[0] > -np.inf else len(flat) for s, t in zip(searches, tops, strict=True)])
            wanted = np.flatnonzero(word > np.repeat(last, size))  # the words after the branch are drawn anew
        rows, edges = lattice.walk(state[wanted], mix64(np.repeat(keys, size)[wanted] + U(j * 8 + 5)), word[wanted])
        rows = wanted[rows]
        cuts = np.searchsorted(rows, np.append(begin, len(flat)))
        picks = {t: searches[t].pick(top) for t, top in enumerate(tops) if top[0] > -np.inf}
        tails = dict.fromkeys(picks, np.zeros(0, np.int64))
        if going := [t for t, (_, state_after, _) in picks.items() if state_after >= 0]:
            states, seeds = (np.array([picks[t][i] for t in going]) for i in (1, 2))
            of, more = lattice.walk(states, seeds, np.zeros(len(going), np.int64))
            tails |= dict(zip(going, np.split(more, np.searchsorted(of, np.arange(1, len(going)))), strict=True))
        for t in range(len(texts)):
            a, b = cuts[t], cuts[t + 1]
            own = word[rows[a:b]]
            if not j:
                s = Paths(lattice, state, int(keys[t]))
                searches.append(s)
                g = -np.log(-np.log(s._u(0, 0, 1)[0]))
                s.add(edges[a:b], own, float(g), 0)
            elif tops[t][0] > -np.inf:
                searches[t].branch(tops[t], picks[t][0], tails[t], (own, edges[a:b]))
    out = []
    for s in searches:
        threshold = s.best()[0]
        with np.errstate(over="ignore"):
            out.append([(lattice.ids(e), lp, g, float(-np.expm1(-np.exp(lp - threshold)))) for e, _, lp, g in s.samples])
    return out


_words: dict[str, Words] = {}


def sampler(model: str, k: int, digest: bool):
    """Arrow function (doc_id, seed, text) to one row per sample; ``digest`` gives a crc and a round trip for the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _words:  # one per worker process, kept between tasks
            _words[model] = Words(Vocabulary(model))
        own_words = _words[model]
        v = own_words.vocabulary

        def flush(ids, seeds, texts) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for key, text, samples in zip(ids, texts, sample_texts(own_words, texts, np.array(seeds, np.int64).view(U), k), strict=True):
                want = text.replace("▁", " ").encode("utf-8", "replace") if digest else b""
                for rank, (tokens, lp, g, q) in enumerate(samples, 1):
                    own = (zlib.crc32(tokens.astype("<u4").tobytes()), v.decode_bytes(tokens) == want) if digest else (tokens,)
                    for c, value in zip(cols, (key, rank, len(tokens), lp, g, q, own), strict=True):
                        c.append(value)
            named = {"doc_id": pa.array(cols[0], pa.int64()), "sample": pa.array(cols[1], pa.int32()), "n_pieces": pa.array(cols[2], pa.int64())}
            named |= {n: pa.array(c, pa.float64()) for n, c in zip(("log_prob", "perturbed", "inclusion"), cols[3:6], strict=True)}
            if digest:
                named |= {"ids_crc32": pa.array([o[0] for o in cols[6]], pa.int64()), "round_trip": pa.array([o[1] for o in cols[6]], pa.bool_())}
            else:
                flat = np.concatenate([o[0] for o in cols[6]]) if cols[6] else np.zeros(0, np.int32)
                named["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[2])]).astype(np.int32)), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_pydict(named)

        for b in batches:
            ids, seeds, texts, n = [], [], [], 0
            for key, seed, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                ids.append(key)
                seeds.append(seed)
                texts.append(text or "")
                n += len(texts[-1])
                if n >= BATCH_CHARS:
                    yield flush(ids, seeds, texts)
                    ids, seeds, texts, n = [], [], [], 0
            if ids:
                yield flush(ids, seeds, texts)

    return run


def segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 0, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``k`` distinct sampled segmentations per row of ``docs``, in the order of their perturbed scores.

    Columns doc_id, sample (from 1), n_pieces, log_prob, perturbed, inclusion and ids, or, with
    ``digest``, ids_crc32 and round_trip (decoding gives the text; a text's own "▁" reads as a
    blank). A null text is empty; the empty text has one segmentation, the lone front blank; a text with fewer than ``k``
    segmentations gets all it has, with inclusion 1. Rows that repeat a key and a text get equal
    samples. Other columns are not read.
    """
    shape = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, " + ("ids_crc32 long, round_trip boolean" if digest else "ids array<int>")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("seed"), F.col(text_col).alias("text"))
    return slim.mapInArrow(sampler(model, k, digest), shape)
