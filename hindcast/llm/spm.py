"""SentencePiece encoding and decoding with a max-plus scan over chunks of giant documents.

A text is a lattice of piece occurrences, and its encoding the best path. Unigram models score each
piece. For BPE models the path is the one whose neighbours are all compatible: two pieces are, if merging
their joined characters gives just these two. A sequence is what the merge rule yields exactly if all its
neighbours are compatible, so BPE is the case of weights 0 and minus infinity, and ids equal the
SentencePiece library's for either kind of model.

Ordinary texts are encoded where they are read. No piece crosses the start of a word (a space after
another character), so a text's path is its words' paths, and each distinct word is solved once per
worker. A giant text is cut into chunks of ``chunk_chars`` anywhere. The state at a cut is the piece
occurrence that covers the character before it: how far it reaches back and ahead. Each chunk yields a
max-plus matrix from entry to exit states. The product of matrices is associative, so they are combined
in rounds: blocks of BLOCK neighbours become one matrix each, until one is left for a text. Then the best
states at the cuts are pushed down, round by round, and each chunk is traced back on its own between its
two states. Between a chunk's first and last word start the path is fixed, so those ids are found along with
the matrix, and only the texts at its two ends wait for the states.

A task holds a slice of about a megabyte of texts or chunks (one at least) at a time; its caches of solved words are
bounded in bytes, and words of over LONG characters are not kept.

Defined results: null text stays null and has no ids; an empty text has no ids; repeated rows get equal
results; empty tables stay empty; a very long text is cut into chunks, whose results do not depend on the
cuts; extra columns pass through: where ``docs`` has a column ``ids``, the new one gets an underscore, and
``decoded`` reads the last column unless told another. Decoding gives back the text, but for the word mark
U+2581 inside it, which decodes to a space.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small_batches, spare, table, written
from .words import gather, text_slices

MARK = "▁"
NEVER = float("-inf")
LONG = 64
BLOCK = 16
#: The registered query cuts texts of more characters, so that the longest ones (7 in 100) go through the scan.
CHUNK = 8192
#: Bytes that a worker's cache of solved units, and that of compatible neighbours, may take before it starts anew.
CACHE_BYTES = 64 << 20
#: Two tables of so many places hold the pairs that can be joined; a pair that finds both its places taken stands in a list.
PLACE_BITS = 20
PLACE_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Pieces:
    """The pieces of a model file and the best paths of units (runs that no piece leaves)."""

    def __init__(self, path: str, bpe: bool | None = None, cache_bytes: int = CACHE_BYTES) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): float(sp.get_score(i)) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = min(self.score.values()) - 10.0
        self.longest = max(map(len, self.ids))
        #: In a merge model, scores fall with the id; those of a unigram model do not.
        self.bpe = bpe if bpe is not None else all(self.score[sp.id_to_piece(a)] >= self.score[sp.id_to_piece(b)] for a, b in zip(plain[:-1], plain[1:], strict=True) if self.score[sp.id_to_piece(a)] > -1e8)
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("a piece crosses the start of a word or a line")
        self.output = [b""] * n
        for piece, i in self.ids.items():
            self.output[i] = piece.replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.output[i] = bytes([value])
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.fits: dict[str, bool] = {}
        self.fits_bytes = 0
        self.cache_bytes = cache_bytes
        self.units = Units(self)
        self.joins: np.ndarray | None = None

    # ---- the rule -----------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The merge rule as stated: join the best-scored neighbours, the leftmost of equals, until none can be."""
        parts, score = list(text), self.score.get
        gain = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while gain and (best := max(gain)) > NEVER:
            at = gain.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gain[at]
            if at:
                gain[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(gain):
                gain[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def step(self, before: str | None, piece: str) -> float:
        """Weight of ``piece`` after ``before`` (None: at the start of a unit)."""
        if not self.bpe:
            return self.score.get(piece, self.unknown)
        key = f"{before or ''}\n{piece}"  # no piece of two characters holds a line end
        ok = self.fits.get(key)
        if ok is None:
            ok = self.merged((before or "") + piece) == ([before] if before else []) + [piece]
            self.fits_bytes += 2 * len(key) + 200
            if self.fits_bytes > self.cache_bytes:
                self.fits.clear()
                self.fits_bytes = 0
            self.fits[key] = ok
        return 0.0 if ok else NEVER

    # ---- many words at once --------------------------------------------------------------------------

    def _tables(self) -> None:
        """Symbols are piece ids, and n + code point for a character that is no piece. Pairs of symbols that can be joined, sorted."""
        n = len(self.output)
        self.symbols = np.arange(n, n + 0x110000, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        symbol = lambda x: self.ids.get(x, int(self.symbols[ord(x)]) if len(x) == 1 else None)
        rows = [(symbol(p[:k]), symbol(p[k:]), i, self.score[p]) for p, i in self.ids.items() for k in range(1, len(p))]
        rows = [(a << 24 | b, i, score) for a, b, i, score in rows if a is not None and b is not None]
        # One more row, which no pair equals: an empty place leads to it.
        self.joins, self.joined = (np.array([r[k] for r in rows] + [-1 << 48], np.int64) for k in (0, 1))
        self.gains = np.array([r[2] for r in rows] + [NEVER], np.float32)  # as the model file holds them
        self.places = [np.full(1 << PLACE_BITS, len(rows), np.int32) for _ in range(2)]
        left = np.arange(len(rows))
        for places, odd in zip(self.places, PLACE_ODD, strict=True):
            places[self._place(self.joins[left], odd)] = left
            left = left[places[self._place(self.joins[left], odd)] != left]
        order = np.argsort(self.joins[left])
        self.rest = self.joins[left][order], left[order]

    @staticmethod
    def _place(key: np.ndarray, odd: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)

    def _join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol that pairs of symbols are joined to, and the score of it (NEVER: they cannot be)."""
        key = (a << 24) | b
        at = self.places[0][self._place(key, PLACE_ODD[0])]
        held = self.joins[at]
        other = np.flatnonzero((held != key) & (held != self.joins[-1]))  # another pair has the place
        if len(other):
            k = key[other]
            at[other] = self.places[1][self._place(k, PLACE_ODD[1])]
            keys, rows = self.rest  # the few pairs without a place in either table
            if len(keys):
                i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                at[other] = np.where(keys[i] == k, rows[i], at[other])
            at[self.joins[at] != key] = len(self.joins) - 1
        return self.joined[at], self.gains[at]

    def merged_rows(self, ids: np.ndarray) -> np.ndarray:
        """The merge rule on each row of symbols (padded with -1): all rows take their best merge in the same step.

        The symbol that a merge takes in becomes -1. Neighbours are linked by place, so that a merge moves no other symbol.
        """
        n, width = ids.shape
        edge = np.full((n, 1), -1, np.int64)
        flat = np.concatenate((edge, ids, edge), axis=1).ravel()
        width += 2
        place = np.arange(n * width)
        before, after = place - 1, place + 1
        made, gain = self._join(flat, np.append(flat[1:], -1))
        rows, held = np.arange(n), gain.reshape(n, width)  # the rows that are still merged, and their gains
        while len(rows):
            best = held.argmax(axis=1)
            go = held[np.arange(len(rows)), best] > NEVER
            if 4 * np.count_nonzero(go) < 3 * len(rows):  # leave the finished rows
                rows, best, held, go = rows[go], best[go], held[go], go[go]
            live = np.flatnonzero(go)
            at = rows[live] * width + best[live]
            taken, own = after[at], live * width + best[live]  # in all rows, and in those held
            beyond, left = after[taken], before[at]
            flat[at], flat[taken] = made[at], -1
            after[at], before[beyond] = beyond, at
            shift = own - at
            values = held.reshape(-1)
            values[taken + shift] = NEVER
            made[at], values[own] = self._join(flat[at], flat[beyond])
            made[left], values[left + shift] = self._join(flat[left], flat[at])
        return flat.reshape(n, width)[:, 1:-1]

    def solve_many(self, units: list[str]) -> None:
        """Put the ids of units of at most LONG characters into the cache."""
        if self.joins is None:
            self._tables()
        size = np.fromiter(map(len, units), np.int64, len(units))
        codes = self.symbols[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.cumsum(size) - size
        for lo, hi in zip((0, 4, 8, 12, 16, 32), (4, 8, 12, 16, 32, LONG), strict=True):
            for rows in np.array_split(x := np.flatnonzero((size > lo) & (size <= hi)), len(x) // 8192 + 1):
                inside = np.arange(hi) < size[rows, None]
                ids = np.full(inside.shape, -1, np.int64)
                ids[inside] = codes[(start[rows, None] + np.arange(hi))[inside]]
                done = self.merged_rows(ids)
                raw = done[done >= 0].astype(np.int32).tobytes()
                end = 4 * np.cumsum((done >= 0).sum(axis=1))
                plain = (done < len(self.output)).all(axis=1)
                raws = [raw[z - k : z] for z, k, ok in zip(end.tolist(), (4 * (done >= 0).sum(axis=1)).tolist(), plain.tolist(), strict=True) if ok]
                rows = rows[plain]
                self.units.update(zip([units[row] for row in rows.tolist()], raws, strict=True))
                self.units.bytes += 2 * int(size[rows].sum()) + sum(map(len, raws)) + 200 * len(raws)

    def at(self, text: str, start: int) -> Iterator[str]:
        """Pieces that occur at ``start``; a character that is no piece stands for itself."""
        ids = self.ids
        for end in range(start + 1, min(start + self.longest, len(text)) + 1):
            piece = text[start:end]
            if piece in ids or end == start + 1:
                yield piece

    def solved(self, unit: str) -> list[str]:
        """The best path of a whole unit; of equal paths, the one whose last piece starts first."""
        n, step, ids = len(unit), self.step, self.ids
        if self.bpe and n <= LONG:  # merging costs n times the merges, which pays for ordinary words
            return self.merged(unit)
        if self.bpe:  # each prefix has one last piece
            last: list[str | None] = [None] * (n + 1)
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    piece = unit[start:end]
                    if (piece in ids or end == start + 1) and (start == 0 or last[start] is not None) and step(last[start], piece) == 0.0:
                        last[end] = piece
                        break
        else:
            best, last = [0.0] + [NEVER] * n, [None] * (n + 1)
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    piece = unit[start:end]
                    if (piece in ids or end == start + 1) and best[start] + step(None, piece) > best[end]:
                        best[end], last[end] = best[start] + step(None, piece), piece
        out, end = [], n
        while end:
            if last[end] is None:
                return self.merged(unit)  # equal scores in the merge order
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        return out

    def run(self, key: str) -> bytes:
        """Ids of a run of characters that no piece leaves."""
        numbers = self.numbers(self.solved(key))
        return struct.pack(f"<{len(numbers)}i", *numbers)

    # ---- whole texts --------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes. Units that are new are solved together."""
        return self.ids_of([UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts])

    def ids_of(self, found: list[list[str]]) -> list[bytes]:
        """Ids of each list of units."""
        if self.bpe:
            units = [u for u in set().union(*found) if len(u) <= LONG]
            new = [u for u in units if u not in self.units]
            if self.units.make_room(new):
                new = units
            if new:
                self.solve_many(new)
        return [b"".join(map(self.units.__getitem__, x)) for x in found]

    # ---- chunks -------------------------------------------------------------------------------------

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(back, ahead) of the occurrences that cover the character before ``cut``."""
        return [
            (cut - s, s + len(p) - cut)
            for s in range(max(0, cut - self.longest), cut)
            for p in self.at(text, s)
            if s + len(p) >= cut
        ]

    def walk(self, text: str, entries: list[tuple[int, str | None]], stop: int, starts_unit: set[int]) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
        """Best scores from each entry (end, last piece) to each occurrence (start, piece), and the occurrence before it.

        Occurrences start before ``stop``. Scores are vectors over the entries. An occurrence at the start
        of a unit does not depend on the piece before it.
        """
        n = len(entries)
        ends: dict[int, list[tuple[tuple[int, str | None], np.ndarray]]] = {}
        for k, (end, piece) in enumerate(entries):
            one = np.full(n, NEVER)
            one[k] = 0.0
            ends.setdefault(end, []).append(((-1, piece), one))
        found: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        for s in sorted(range(min(ends), stop)):
            if s not in ends:
                continue
            for piece in self.at(text, s):
                if any(u in starts_unit for u in range(s + 1, s + len(piece))):
                    continue
                score, back = np.full(n, NEVER), np.full(n, -1, np.int64)
                for k, ((_, before), value) in enumerate(ends[s]):
                    w = self.step(None if s in starts_unit else before, piece)
                    better = value + w > score
                    score[better], back[better] = (value + w)[better], k
                if (score > NEVER).any():
                    found[s, piece] = (score, back)
                    ends.setdefault(s + len(piece), []).append(((s, piece), score))
        self.last_ends = ends
        return found

    def matrix(self, text: str, lo: int, hi: int, first: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
        """Entry states at ``lo``, exit states at ``hi`` and the best score between each two."""
        entries = [(0, 0)] if first else self.states(text, lo)
        exits = self.states(text, hi)
        score = np.full((len(entries), len(exits)), NEVER)
        found = self.walk(text, self._entries(text, lo, entries), hi, self._units(text))
        for j, (back, ahead) in enumerate(exits):
            s = hi - back
            if s < lo:  # one occurrence covers the whole chunk
                for i, (b, a) in enumerate(entries):
                    if lo - b == s and lo + a == hi + ahead:
                        score[i, j] = 0.0
            elif (s, text[s : hi + ahead]) in found:
                score[:, j] = found[s, text[s : hi + ahead]][0]
        return entries, exits, score

    def _entries(self, text: str, lo: int, entries: list[tuple[int, int]]) -> list[tuple[int, str | None]]:
        return [(lo + a, text[lo - b : lo + a] if b + a else None) for b, a in entries]

    @staticmethod
    def _units(text: str) -> set[int]:
        return {m.start() for m in UNIT.finditer(text)} - {0}

    def traced(self, text: str, lo: int, hi: int, entry: tuple[int, int], leave: tuple[int, int]) -> list[str]:
        """The pieces that start in lo..hi-1, on the best path between two states."""
        s, end = hi - leave[0], hi + leave[1]
        if s < lo:
            return []
        found = self.walk(text, self._entries(text, lo, [entry]), hi, self._units(text))
        ends, out, here = self.last_ends, [], (s, text[s:end])
        while here[0] >= lo:
            out.append(here[1])
            k = int(found[here][1][0])
            (s, piece), _ = ends[here[0]][k]
            if s < 0:
                break
            here = (s, piece)
        return out[::-1]


class Units(dict):
    """Ids of units, solved on first sight. A unit is cut where its two neighbours are together in no piece."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces, self.bytes = pieces, 0

    def __missing__(self, unit: str) -> bytes:
        p = self.pieces
        cuts = [0, *[i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in p.pairs], len(unit)]
        ids = b"".join([p.run(unit[a:b]) for a, b in zip(cuts, cuts[1:])])
        if len(unit) <= LONG:
            self.make_room([unit])
            self.keep(unit, ids)
        return ids

    def make_room(self, units: list[str]) -> bool:
        """Start anew if ``units`` do not fit in; True if so."""
        full = self.bytes + 2 * sum(map(len, units)) + 240 * len(units) > self.pieces.cache_bytes
        if full:
            self.clear()
            self.bytes = 0
        return full

    def keep(self, unit: str, ids: bytes) -> None:
        self.bytes += 2 * len(unit) + len(ids) + 200
        self[unit] = ids


UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_WORKER: dict[tuple, Pieces] = {}
_OUTPUTS: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def pieces_of(path: str, bpe: bool | None = None) -> Pieces:
    if (path, bpe) not in _WORKER:
        _WORKER[path, bpe] = Pieces(path, bpe)
    return _WORKER[path, bpe]


def times(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-plus product and, for each entry and exit, the state between that attains it."""
    both = a[:, :, None] + b[None, :, :]
    return both.max(axis=1), both.argmax(axis=1)


def encoded(docs: DataFrame, model: str, text_col: str = "text", out: str = "ids", chunk_chars: int = 1 << 16, bpe: bool | None = None, slice_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with a last column ``out``: the ids of each text."""
    text = F.col(text_col)
    out, key = spare(docs, out), spare(docs, "key")
    giant = F.coalesce(F.length(text) > chunk_chars, F.lit(False))

    @F.arrow_udf("array<int>")
    def ids_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces_of(model, bpe)
        for column in columns:
            for b in text_slices(pa.RecordBatch.from_arrays([column], ["t"]), "t", slice_bytes):
                raw = p.encode(b.column(0).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))

    small = docs.where(~giant).withColumn(out, ids_of(text))
    large = docs.where(giant).withColumn(key, F.sha2(text, 256))
    ids = giant_ids(large.select(F.col(key).alias("key"), text.alias("text")), model, chunk_chars, bpe)
    large = large.join(ids.select(F.col("key").alias(key), F.col("ids").alias(out)), key, "left").select(*docs.columns, out)
    return small.unionByName(large)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other, so that one chunk at a time is a Python object."""
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}


def _one(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema)


_KEY = [("key", pa.string()), ("k", pa.int32())]
WINDOWS = pa.schema([*_KEY, ("lo", pa.int32()), ("hi", pa.int32()), ("window", pa.binary())])
MATRICES = pa.schema([*_KEY, ("entry", pa.list_(pa.int32())), ("leave", pa.list_(pa.int32())), ("score", pa.list_(pa.float64()))])
STATES = pa.schema([*_KEY, *[(c, pa.int32()) for c in ("b0", "a0", "b1", "a1")]])
MATRIX_DDL = "key string, k int, entry array<int>, leave array<int>, score array<double>"
STATE_DDL = "key string, k int, b0 int, a0 int, b1 int, a1 int"


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _product(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The max-plus product of neighbouring matrices, and for each cut between them the best state for each entry and exit."""
    total, backs, order = None, [], None
    for r in rows:
        entry, leave = _pairs(r["entry"]), _pairs(r["leave"])
        m = np.array(r["score"]).reshape(len(entry), len(leave))
        if total is None:
            total = m
        else:
            at = {s: i for i, s in enumerate(entry)}
            total, back = times(total, m[[at[s] for s in order]])
            backs.append(back)
        order = leave
    return total, backs


def combined(group: pa.Table) -> pa.Table:
    """One matrix for a block of neighbours."""
    rows = sorted(group.to_pylist(), key=lambda r: r["k"])
    total, _ = _product(rows)
    out = {"key": rows[0]["key"], "k": rows[0]["k"] // BLOCK, "entry": rows[0]["entry"], "leave": rows[-1]["leave"], "score": total.ravel().tolist()}
    return pa.Table.from_pylist([out], MATRICES)


def pushed(group: pa.Table) -> pa.Table:
    """The states at both ends of each matrix of a block, from those at the ends of the block (b0, a0, b1, a1)."""
    rows = sorted(group.to_pylist(), key=lambda r: r["k"])
    _, backs = _product(rows)
    i, j = _pairs(rows[0]["entry"]).index((rows[0]["b0"], rows[0]["a0"])), _pairs(rows[-1]["leave"]).index((rows[0]["b1"], rows[0]["a1"]))
    chosen = [j]
    for back in reversed(backs):
        chosen.append(int(back[i, chosen[-1]]))
    out, before = [], (rows[0]["b0"], rows[0]["a0"])
    for r, j in zip(rows, reversed(chosen), strict=True):
        state = _pairs(r["leave"])[j]
        out.append({"key": r["key"], "k": r["k"], "b0": before[0], "a0": before[1], "b1": state[0], "a1": state[1]})
        before = state
    return pa.Table.from_pylist(out, STATES)


def scanned(matrices: DataFrame, last: int) -> DataFrame:
    """(key, k, b0, a0, b1, a1): the best path's states at both ends of each chunk; ``last`` is the greatest k.

    Up: blocks of BLOCK matrices become one, until each text has one. Down: a text's best end gives the states at the ends
    of its blocks, and so on to its chunks. No group holds more than BLOCK matrices. ``matrices`` are read twice.
    """
    levels = [matrices]
    while last:
        block = levels[-1].withColumn("g", F.floor(F.col("k") / BLOCK))
        levels.append(written(block.groupBy("key", "g").applyInArrow(lambda t: combined(t.drop_columns("g")), MATRIX_DDL), "matrices"))
        last //= BLOCK

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            leave = _pairs(r["leave"])
            score = np.array(r["score"]).reshape(-1, len(leave))
            j = max((j for j, s in enumerate(leave) if s[1] == 0), key=lambda j: score[0, j])
            yield _one({"key": r["key"], "k": 0, "b0": 0, "a0": 0, "b1": leave[j][0], "a1": 0}, STATES)

    states = levels[-1].mapInArrow(best, STATE_DDL)
    for level in levels[-2::-1]:
        ends = states.withColumnRenamed("k", "g")
        block = level.withColumn("g", F.floor(F.col("k") / BLOCK)).join(ends, ["key", "g"])
        states = block.groupBy("key", "g").applyInArrow(lambda t: pushed(t), STATE_DDL)
    return states


def giant_ids(texts: DataFrame, model: str, chunk_chars: int, bpe: bool | None = None, slice_chars: int = 1 << 20) -> DataFrame:
    """(key, ids) of giant texts (key, text; equal rows count once) by the scan.

    The windows of chunks are dealt out once, packed. Where a chunk lies, its matrix and the ids of its fixed middle are found;
    the states then meet the short texts at its two ends only.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, z, seen = pieces_of(model, bpe).longest + 1, zstandard.ZstdCompressor(level=1), set()
        for r in rows_of(batches):
            if r["key"] in seen:
                continue
            seen.add(r["key"])
            t, n = r["text"], len(r["text"]) + 1
            for k, lo in enumerate(range(0, n, chunk_chars)):  # the marked text is a mark and then the text
                hi = min(lo + chunk_chars, n)
                a, e = max(0, lo - margin), min(n, hi + margin)
                window = (MARK * (a == 0) + t[max(a - 1, 0) : e - 1]).replace(" ", MARK)
                yield _one({"key": r["key"], "k": k, "lo": lo - a, "hi": hi - a, "window": z.compress(window.encode())}, WINDOWS)

    kind = "smallint" if len(outputs_of(model)[0]) <= 1 << 15 else "int"
    parts_of = pa.schema([*MATRICES, ("head", pa.string()), ("lo", pa.int32()), ("stop", pa.int32()), ("tail", pa.string()), ("end", pa.int32()), ("ids", pa.list_(pa.int16() if kind == "smallint" else pa.int32()))])
    ids_of = pa.schema([*_KEY, parts_of.field("ids")])
    n_parts = partitions(texts.sparkSession)
    chunks = texts.mapInArrow(cut, "key string, k int, lo int, hi int, window binary").repartition(n_parts, "key", "k").dropDuplicates(["key", "k"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, z, at_once = pieces_of(model, bpe), zstandard.ZstdDecompressor(), max(1, slice_chars // chunk_chars)
        for b in (x.slice(i, at_once) for x in batches for i in range(0, x.num_rows, at_once)):
            rows = b.to_pylist()
            windows = [z.decompress(r["window"]).decode() for r in rows]
            inner = [_inner(p, w, r["lo"], r["hi"]) for w, r in zip(windows, rows, strict=True)]
            middles = p.ids_of([UNIT.findall(w[i[0] : i[1]]) if i else [] for w, i in zip(windows, inner, strict=True)])
            out = []
            for r, w, i, ids in zip(rows, windows, inner, middles, strict=True):
                entry, leave, score = chunk_matrix(p, w, r["lo"], r["hi"], r["k"] == 0, i)
                ends = {"head": w[: i[0] + 1], "stop": i[0], "tail": w[i[1] :], "end": r["hi"] - i[1]} if i else {"head": w, "stop": r["hi"], "tail": None, "end": 0}
                matrix = {"entry": [x for s in entry for x in s], "leave": [x for s in leave for x in s], "score": score.ravel().tolist()}
                out.append({"key": r["key"], "k": r["k"], "lo": r["lo"], "ids": np.frombuffer(ids, np.int32)} | matrix | ends)
            yield pa.RecordBatch.from_pylist(out, parts_of)

    parts = written(chunks.mapInArrow(solved, f"{MATRIX_DDL}, head string, lo int, stop int, tail string, end int, ids array<{kind}>"), "chunks")
    last = parts.agg(F.max("k")).first()[0] or 0
    states = scanned(parts.select("key", "k", "entry", "leave", "score"), last)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model, bpe)
        for r in rows_of(batches):
            head, tail = chunk_ends(p, r["head"], r["lo"], r["stop"], r["tail"], r["end"], (r["b0"], r["a0"]), (r["b1"], r["a1"]))
            yield pa.RecordBatch.from_pylist([{"key": r["key"], "k": 3 * r["k"], "ids": head}, {"key": r["key"], "k": 3 * r["k"] + 2, "ids": tail}], ids_of)

    traced = parts.select("key", "k", "head", "lo", "stop", "tail", "end").join(states, ["key", "k"]).mapInArrow(trace, f"key string, k int, ids array<{kind}>")
    pieces = traced.union(parts.select("key", (3 * F.col("k") + 1).alias("k"), "ids"))
    return pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda s: s["ids"])).cast("array<int>").alias("ids"))


def _inner(p: Pieces, text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last unit start strictly inside lo..hi (None if there are not two): between them the path is fixed."""
    first = next((m.start() for m in UNIT.finditer(text, max(lo - 1, 0)) if m.start() > lo and _starts(text, m.start())), None)
    if first is None or first >= hi:
        return None
    last = hi - 1
    while last > first and not _starts(text, last):
        last -= 1
    return (first, last) if last > first else None


def _starts(text: str, at: int) -> bool:
    """Does a unit start here, whatever came before the window?"""
    return at > 0 and (text[at] == "\n" or text[at - 1] == "\n" or text[at] == MARK and text[at - 1] != MARK)


def chunk_matrix(p: Pieces, text: str, lo: int, hi: int, first: bool, inner: tuple[int, int] | None) -> tuple[list, list, np.ndarray]:
    """A chunk's matrix. Two unit starts inside make it a rank-one matrix: head, fixed middle, tail."""
    if inner is None:
        return p.matrix(text, lo, hi, first)
    a, z = inner
    entry, at_a, head = p.matrix(text[: a + 1], lo, a, first)
    into = head[:, [j for j, s in enumerate(at_a) if s[1] == 0]].max(axis=1)
    _, leave, tail = p.matrix(text[z:], 0, hi - z, True)
    middle = 0.0 if p.bpe else sum(p.step(None, x) for u in UNIT.findall(text[a:z]) for x in p.solved(u))
    return entry, leave, into[:, None] + middle + tail


def chunk_ends(p: Pieces, head: str, lo: int, stop: int, tail: str | None, end: int, entry: tuple[int, int], leave: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Ids of the pieces that start before and after a chunk's fixed middle; all are before it where there is none (no ``tail``)."""
    if tail is None:
        return p.numbers(p.traced(head, lo, stop, entry, leave)), []
    _, at_a, score = p.matrix(head, lo, stop, entry == (0, 0))
    entries = [(0, 0)] if entry == (0, 0) else p.states(head, lo)
    i = entries.index(entry)
    j = max((j for j, s in enumerate(at_a) if s[1] == 0), key=lambda j: score[i, j])
    return p.numbers(p.traced(head, lo, stop, entry, at_a[j])), p.numbers(p.traced(tail, 0, end, (0, 0), leave))


def decoded(rows: DataFrame, model: str, ids_col: str | None = None, out: str = "decoded", slice_ids: int = 1 << 18) -> DataFrame:
    """``rows`` with ``out``: the text of the ids (null where the ids are null) in ``ids_col``, the last column if it is not given."""
    ids_col, out = ids_col or rows.columns[-1], spare(rows, out)

    @F.arrow_udf("string")
    def text_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        start, size, pool = outputs_of(model)
        for column in columns:
            for b in text_slices(pa.RecordBatch.from_arrays([column], ["ids"]), "ids", slice_ids):
                lists = b.column(0)
                ids = np.asarray(pc.list_flatten(lists))
                ends = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))))
                data, offsets = gather(pool, start[ids], size[ids])
                raw, at = data.tobytes(), offsets[ends]
                texts = [raw[x + 1 : y].decode("utf-8", "replace") if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pc.if_else(pc.is_valid(lists), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))

    return rows.withColumn(out, text_of(F.col(ids_col)))


def outputs_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each id's bytes start, their number, and the bytes of all ids."""
    if path not in _OUTPUTS:
        output = Pieces(path).output
        size = np.array([len(x) for x in output], np.int64)
        _OUTPUTS[path] = np.cumsum(size) - size, size, np.frombuffer(b"".join(output), np.uint8)
    return _OUTPUTS[path]


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids' number and SHA-256 (decimal, joined by commas), and whether decoding them gives the text."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decoded(encoded(docs, public_model(), chunk_chars=CHUNK), public_model())
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        (F.coalesce("text", F.lit("")) == F.coalesce("decoded", F.lit(""))).alias("round_trip"),
    )
