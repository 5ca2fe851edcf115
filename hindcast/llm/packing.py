"""Packing token ids into windows: best-fit decreasing over a segment tree indexed by remaining capacity.

Each task tokenizes the documents it reads and packs them in groups of about ``group_tokens`` ids, so
memory is bounded and nothing is shuffled. In a group, overlong documents are first cut into full
windows; the rests, longest first, each go to the tightest open window that holds them, found by one
descent of a segment tree over capacities 0..window. Then the emptiest windows are cut into the gaps
of over ``min_gap`` ids that the others have, and the last partial window into runs whose lengths are
powers of two, which need no padding.

Sequence ids are unique and repeatable: the task's partition number, then a running number.
Defined results: null text is empty, and an empty document is its end id alone; an empty table gives
an empty table; repeated rows are packed each on its own; extra columns are ignored, as the result is
one row per piece.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table

WINDOW = 4096
END_ID = 2


class Capacity:
    """Counts of open windows by remaining capacity, as a segment tree: ``tightest(n)`` is the least capacity >= n."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.leaves
        while i:
            self.any[i] += 1
            i >>= 1

    def take(self, room: int) -> int:
        i = room + self.leaves
        while i:
            self.any[i] -= 1
            i >>= 1
        return self.open[room].pop()

    def tightest(self, need: int) -> int:
        """The least capacity >= need with an open window; -1 if there is none."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit(sizes: list[int], window: int = WINDOW, min_gap: int = 32) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (document, start, length); every id of every document lies in one piece."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(sizes):
        whole = n // window
        full += [[(d, k * window, window)] for k in range(whole)]
        if n % window:
            rest.append((d, whole * window, n % window))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree, bins, room = Capacity(window), [], []
    for piece in rest:
        at = tree.tightest(piece[2])
        if at < 0:
            w = len(bins)
            bins.append([])
            room.append(window)
            at = window
        else:
            w = tree.take(at)
        bins[w].append(piece)
        room[w] = at - piece[2]
        if room[w]:
            tree.put(room[w], w)
    return full + fill(bins, room, min_gap)


def fill(bins: list[list[tuple[int, int, int]]], room: list[int], min_gap: int) -> list[list[tuple[int, int, int]]]:
    """Cut the emptiest windows into the gaps of the fullest; at most one stays partial, and is cut into powers of two."""
    order = sorted(range(len(bins)), key=lambda w: (room[w], w))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, frm = order[lo], order[hi]
        if room[to] <= min_gap:
            lo += 1
            continue
        d, start, n = bins[frm].pop()
        m = min(n, room[to])
        bins[to].append((d, start, m))
        room[to] -= m
        room[frm] += m
        if m < n:
            bins[frm].append((d, start + m, n - m))
        if not bins[frm]:
            hi -= 1
    out: list[list[tuple[int, int, int]]] = []
    for w in order:
        if bins[w]:
            out += [bins[w]] if room[w] <= min_gap else powers(bins[w])
    return out


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a partial window into sequences whose lengths are powers of two, the largest first."""
    out, left = [], sum(p[2] for p in pieces)
    queue = list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        seq, need = [], size
        while need:
            d, start, n = queue.pop()
            m = min(n, need)
            seq.append((d, start, m))
            if m < n:
                queue.append((d, start + m, n - m))
            need -= m
        out.append(seq)
        left -= size
    return out


class WordIds(dict):
    """Token ids of each word (little-endian 32-bit bytes), looked up once per task and distinct word.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids. A
    word of Latin letters and a last run of ASCII signs is the letters' ids and the signs' ids: its
    pattern splits there, and the letters go straight to the BPE model. Other words take the whole way.
    The cache holds about ``most`` bytes and starts anew when full; words of over LONGEST bytes are not kept.
    """

    LONGEST, ENTRY = 256, 200  # bytes; what an entry takes besides its word and ids

    SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, most: int = 200 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.most, self.held = Tokenizer.from_file(path), most, 0
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_names = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(128)} | {
            b: level.pre_tokenize_str(bytes(t).decode())[0][0][k] for t in _utf8_samples() for k, b in enumerate(t)
        }

    def whole(self, text: str) -> bytes:
        return little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(self.SIGNS)
        # Latin letters: composed, and lower case is one to one
        if core.isalpha() and (core.isascii() or max(core) < "\u0250" and "\u0130" not in core):
            names = core.lower()
            if not core.isascii():
                names = names.encode().decode("latin-1").translate(self.byte_names)
            ids = little([t.id for t in self.model.tokenize(names)])
            if signs := word[len(core.encode()) :]:
                ids += self._signs(signs)
        else:
            ids = self.whole(text)
        if len(word) <= self.LONGEST:
            self.held += len(word) + len(ids) + self.ENTRY
            if self.held > self.most:
                self.forget()
                self.held = len(word) + len(ids) + self.ENTRY
            self[word] = ids
        return ids

    def forget(self) -> None:
        """Drop the words; a worker lives on after its task and serves other jobs."""
        self.clear()
        self.held = 0

    def _signs(self, run: bytes) -> bytes:
        return self[run] if len(run) < 8 else self.whole(run.decode())

    def of(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes."""
        return [b"".join(map(self.__getitem__, t.encode().split())) for t in texts]


def little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _utf8_samples() -> list[bytes]:
    """Two-byte characters that between them hold every byte of U+0080..U+024F."""
    return [chr(c).encode() for c in range(0x80, 0x250)]


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, group_tokens: int = 2_000_000, slice_bytes: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also the piece's token ids."""
    schema = OUT + (", ids array<int>" if with_ids else "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import text_slices

        words, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        toks: list[bytes] = []
        held, sequence = 0, TaskContext.get().partitionId() << 40

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            bins = best_fit([len(t) // 4 for t in toks], window)
            rows: list[tuple] = []
            cut: list[np.ndarray] = []
            for pieces in bins:
                at = 0
                for d, start, n in pieces:
                    part = toks[d][4 * start : 4 * (start + n)]
                    rows.append((ids[d], start, n, zlib.crc32(part), len(toks[d]) // 4, sequence, at))
                    if with_ids:
                        cut.append(np.frombuffer(part, "<u4").astype(np.int32))
                    at += n
                sequence += 1
            names = [c.split()[0] for c in OUT.split(", ")]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if with_ids:
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int32), pa.array(np.concatenate(cut)))
                names, cols = [*names, "ids"], [*cols, lists]
            ids.clear()
            toks.clear()
            held = 0
            yield pa.RecordBatch.from_arrays(cols, names)

        try:
            for batch in batches:
                for b in text_slices(batch, text_col, slice_bytes):
                    for i, t in zip(b.column(id_col).to_pylist(), words.of([t or "" for t in b.column(text_col).to_pylist()]), strict=True):
                        ids.append(i)
                        toks.append(t + end)
                        held += len(t) // 4 + 1
                    if held >= group_tokens:
                        yield from emit()
            if toks:
                yield from emit()
        finally:
            words.forget()

    return docs.select(id_col, text_col).mapInArrow(each, schema)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    return packed(docs, public_tokenizer())
