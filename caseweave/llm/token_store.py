"""Token ids in binary files of patched frame-of-reference blocks.

A file is a run of segments, each with a length before it, and a footer with the start and the
first id position of every segment. A segment holds the document ids, their lengths and the
token ids; lengths and token ids are blocks of 1024 numbers: the block's minimum is subtracted,
the rest is packed at the width that a given percentile of the block needs, and what does not
fit lies in an exception list (position in the block, bits above the width). The index of a
section holds every block's minimum, width, start and exception count, so one block can be read
alone.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import kept, work_path
from caseweave.llm.words import WORDS, coded, text_slices, words_of

BLOCK, PERCENTILE, SEGMENT = 1024, 0.9, 1 << 20
MAGIC = b"PFR1"


def pack(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Unsigned 32-bit numbers to one section."""
    n = len(values)
    blocks = -(-n // BLOCK)
    v = np.empty(blocks * BLOCK, np.uint32)
    v[:n] = values
    v[n:] = values[-1] if n else 0
    v = v.reshape(blocks, BLOCK)
    low = v.min(1) if blocks else np.zeros(0, np.uint32)
    v -= low[:, None]
    bits = np.frexp(v.astype(np.float32 if not blocks or v.max() < 1 << 24 else np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint8)
    where, pos = np.nonzero(bits > width[:, None])
    high = v[where, pos] >> width[where]
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(start[-1], np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        raw = v[rows].astype("<u4").view(np.uint8).reshape(-1, 4)[:, : -(-int(w) // 8)]
        kept_bits = np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little")[:, : int(w)] if w else np.zeros((0, 0), np.uint8)
        body[start[rows][:, None] + np.arange(int(w) * BLOCK // 8)] = np.packbits(kept_bits.ravel(), bitorder="little").reshape(len(rows), -1) if w else 0
    counts = np.bincount(where, minlength=blocks).astype("<u2")
    parts = [low.astype("<u4"), width, start.astype("<u8"), counts, body, pos.astype("<u2"), high.astype("<u4")]
    return struct.pack("<QQQ", n, len(body), len(pos)) + b"".join(p.tobytes() for p in parts)


def unpack(data: bytes, offset: int = 0) -> tuple[np.ndarray, int]:
    """One section at ``offset`` to its numbers and the offset after it."""
    n, n_body, n_out = struct.unpack_from("<QQQ", data, offset)
    offset += 24
    blocks = -(-n // BLOCK)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal offset
        out = np.frombuffer(data, kind, count, offset)
        offset += out.nbytes
        return out

    low, width, start, counts = take("<u4", blocks), take("u1", blocks), take("<u8", blocks + 1).astype(np.int64), take("<u2", blocks)
    body, pos, high = take("u1", n_body), take("<u2", n_out), take("<u4", n_out)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in map(int, np.unique(width)):
        if w:
            rows = np.flatnonzero(width == w)
            raw = body[start[rows][:, None] + np.arange(w * BLOCK // 8)]
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(-1, w)
            wide = np.zeros((len(bits), 4), np.uint8)
            wide[:, : -(-w // 8)] = np.packbits(bits, axis=1, bitorder="little")
            v[rows] = wide.view("<u4").reshape(len(rows), BLOCK)
    where = np.repeat(np.arange(blocks), counts)
    v[where, pos] |= high << width[where]
    v += low[:, None]
    return v.ravel()[:n], offset


#: Texts with these signs go through the library as a whole: special tokens, and controls that are white space to some and signs to others.
ODD = r"<\||[\x00\x1c-\x1f]"


#: A letter is 1, a digit 2, any other sign 3.
KIND = np.full(256, 3, np.uint8)
KIND[[c for c in range(128) if chr(c).isalpha()]] = 1
KIND[ord("0") : ord("9") + 1] = 2


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, number) of each and all ids."""
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.cumsum(n) - n, n, np.frombuffer(b"".join(ids), "<u4")


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of runs of ``n``, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class WordIds(dict):
    """Word -> its token ids as little-endian bytes; ``encode`` is that of the tokenizers library.

    Texts are cut at ASCII white space, which the tokenizer drops, and their distinct words are
    encoded once a slice, by their distinct pieces; all texts' ids are then gathers. Words of ASCII and Latin-1 letters and
    signs need only lower-casing, so their pieces go to the library's BPE model directly; every
    other word, and every text with control or special-token signs, goes through the whole
    library. The words seen are kept up to a bound, then forgotten.
    """

    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed value: the file's own split

    def __init__(self, path: str, bound: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.bound, self.pieces = Tokenizer.from_file(path), bound, {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as themselves
        rest = [b for b in range(256) if b not in set(plain)]
        self.shown = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + k) for k, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            shown = piece if piece.isascii() else "".join(self.shown[b] for b in piece.encode())
            ids = self.pieces[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        latin = word.isascii() or max(word) < "Ā"
        ids = b"".join(map(self.piece, self.PIECE.findall(word.lower()))) if latin else self.whole(word)
        self[word] = ids
        return ids

    def of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first id, number of ids) of each word within all ids, and those.

        The pieces of ASCII words without apostrophes are runs of letters, single digits and runs
        of other signs; they are found in the buffer. Other words are looked up one by one.
        """
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        hard = np.logical_or.reduceat((data > 127) | (data == ord("'")), ends[:-1] - ends[0]) if len(words) else np.zeros(0, bool)
        plain = words.filter(pa.array(~hard))
        ends = np.frombuffer(plain.buffers()[1], np.int32)[: len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[: ends[-1]]
        kind = KIND[data]
        begin = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))[: len(data)]
        begin[ends[:-1]] = True
        starts = np.append(np.flatnonzero(begin), len(data)).astype(np.int32)
        piece, distinct = coded(pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))))
        first, n, ids = _joined(list(map(self.piece, distinct.to_pylist())))
        upto = np.concatenate([[0], np.cumsum(n[piece])])
        ids = ids[_spread(first[piece], n[piece])]
        at = np.searchsorted(starts[:-1], ends)
        more_first, more_n, more = _joined(list(map(self.__getitem__, words.filter(pa.array(hard)).to_pylist())))
        all_first, all_n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        all_first[~hard], all_n[~hard] = upto[at[:-1]], np.diff(upto[at])
        all_first[hard], all_n[hard] = more_first + len(ids), more_n
        return all_first, all_n, np.concatenate([ids, more])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids) of a column without nulls."""
        if len(self) > self.bound or len(self.pieces) > self.bound:
            self.clear()
            self.pieces.clear()
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        words, sizes = words_of(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, WORDS)
        code, distinct = coded(words)
        first, n, ids = self.of_words(distinct)
        if odd.any():  # such a text is one word of its own
            at = np.flatnonzero(odd)
            code = np.insert(code, np.cumsum(sizes)[at], len(n) + np.arange(len(at)))
            sizes[at] += 1
            whole = _joined([self.whole(texts[int(i)].as_py()) for i in at])
            first, n, ids = np.append(first, whole[0] + len(ids)), np.append(n, whole[1]), np.concatenate([ids, whole[2]])
        upto = np.concatenate([[0], np.cumsum(n[code])])
        return np.diff(upto[np.concatenate([[0], np.cumsum(sizes)])]), ids[_spread(first[code], n[code])]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One per worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _open(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs, inner


def write_parts(folder: str, tokenizer: str, end_id: int):
    """Arrow function: sorted (doc_id, text) of one partition to one file and one manifest row.

    The file's name is new for every attempt, and only the rows of successful attempts name
    files, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        out, path, index, at, first = None, "", [], 0, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        keys: list[pa.Array] = []
        n_docs = n_ids = n_held = 0

        def flush() -> None:
            nonlocal held, keys, at, n_held, n_ids
            key = pa.concat_arrays(keys)
            lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            body = pc.fill_null(key, 0).to_numpy().astype("<i8").tobytes() + key.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() + pack(lengths) + pack(ids)
            index.append((at, n_ids))
            out.write(struct.pack("<QQ", len(body), len(key)) + body)
            at += 16 + len(body)
            n_ids += n_held
            held, keys, n_held = [], [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, inner = _open(folder)
                fs.create_dir(inner, recursive=True)
                path = f"{folder}/{uuid.uuid4().hex}.pfr"
                out = fs.open_output_stream(_open(path)[1], compression=None)
                out.write(MAGIC)
                at, first = len(MAGIC), batch.column(0)[0].as_py()
            for part in text_slices(batch, 1):
                n, ids = ids_of.encode(part.column(1))
                held.append(((n + 1).astype(np.uint32), np.insert(ids, np.cumsum(n), end_id).astype(np.uint32, copy=False)))
                keys.append(part.column(0))
                n_held += len(held[-1][1])
                n_docs += part.num_rows
                if n_held >= SEGMENT:
                    flush()
        if out is not None:
            if keys:
                flush()
            out.write(np.array(index, "<u8").tobytes() + struct.pack("<QQ", len(index), at) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_id": pa.array([first], pa.int64()), "n_docs": [n_docs], "n_ids": [n_ids]})

    return run


def read_segments(path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, token ids) of each segment of a file."""
    fs, inner = _open(path)
    with fs.open_input_file(inner) as f:
        size = f.size()
        n, end = struct.unpack("<QQ", f.read_at(20, size - 20)[:16])
        for start, _ in np.frombuffer(f.read_at(16 * n, end), "<u8").reshape(-1, 2):
            length, docs = struct.unpack("<QQ", f.read_at(16, int(start)))
            body = f.read_at(length, int(start) + 16)
            keys = [k if named else None for k, named in zip(np.frombuffer(body, "<i8", docs).tolist(), body[8 * docs : 9 * docs], strict=True)]
            lengths, at = unpack(body, 9 * docs)
            yield keys, lengths, unpack(body, at)[0]


def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: manifest rows (path, base) to one row per document of the files."""
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for keys, lengths, ids in read_segments(path):
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "start": base + ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})
                base += int(ends[-1])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into files under ``folder`` in ascending id order; returns the manifest.

    Manifest: path, base (ids before the file), n_docs, n_ids. Null ids come first, repeated ids
    side by side in the order of their texts; a null or empty text holds the end id alone. Other
    columns are not read. An empty table writes no file.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = kept(ordered.mapInArrow(write_parts(folder, tokenizer, end_id), "path string, first_id long, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_docs", "n_ids")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of ``manifest``."""
    parts = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.select("path", "base").repartition(parts).mapInArrow(read_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    return read_tokens(kept(write_tokens(docs, work_path(docs.sparkSession, "tokens"), tokenizer, end_id), "bases"))
