"""N-gram Jaccard join with signature trees: exact links between texts whose shingle sets are alike.

Two documents link when 100 * |x & y| >= percent * |x | y| over their distinct word shingles. The result
is each document's set size and the least document id of its connected group.

1. One pass turns texts into shingle hashes. It keeps per document the set's size, a 128-bit sum that
   identifies the set, MINIMA minima, a token bitmap of 4 to 8 bits a token, and its index hashes (below).
2. Equal sets are copies of their smallest document, and only that one goes on. Documents that share
   two minima with the smallest of their bucket are compared with it: this collapses large groups of
   near copies in linear work, and it only ever saves work, as every link is verified.
3. The tree. Documents that met in step 2, linked or not, form one root; under it lie leaves of about
   LEAF documents and LEAF_TOKENS tokens, of one linked group where that group is large. A node holds
   the OR of its documents' bitmaps and their size range. A document that met nobody is a root alone.
4. The walk. Two roots are a pair if they can hold a link: if two sets link, their first (p + l - 1)
   hashes in any common order share at least l, where p = n - ceil(percent * n / 100) + 1; these are its
   index hashes, and the order puts frequent ones last. Leaves of one root are paired by the same index, so a
   template that many texts share gives no pairs by itself. A join takes each pair of roots to the pairs
   of their leaves, without those that lie in one linked group, whose sizes are too far apart, or whose
   bitmaps share too few bits for the greatest possible overlap. Only then do texts travel, leaves in
   cells of 8 x 8 so that a leaf is sent once to a row of cells and not once to each partner. In a cell
   the walk goes on below the leaves: the two trees are walked together from the leaves to single sets,
   and a pair of nodes is dropped when no pair of their documents can overlap enough. Pairs of
   documents that survive, and are not yet linked by others, are intersected in full.

Frequent hashes come from one in SAMPLE of the documents. At most OFTEN of them, the most frequent, set a
bit of a bitmap of OFTEN_BITS bits each, so what is broadcast has a fixed size; they change only the
order and so the work, not the links.

Defined results: null and empty texts have no shingles and link with nothing; rows without id have no
component; equal rows share a component; rows that repeat an id with another text are documents of
their own, of which the one with the least text hash has the id's place in the order and the others come
last; a very long text is one leaf; empty tables give empty tables; extra columns pass through
``without_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, light_batches, partitions, spare, table, written
from .components import components
from .words import GRAM, grams, mix, text_bytes, text_slices, whole, words_of

WIDTH, PERCENT = 4, 85
MINIMA = 6
LEAF, LEAF_TOKENS = 64, 1 << 16
CELL = 8
SAMPLE, OFTEN, OFTEN_BITS = 32, 1 << 20, 26
#: Bitmaps of single documents and of leaves have a power of two of bits, at least 64 and at most MOST_BITS.
MOST_BITS, FOLDS = 1 << 20, 4
#: Ids that may be broadcast (about 32 MB as a hash relation).
BROADCAST_ROWS = 1_000_000
#: Rows of node pairs that a task holds before it adds up and sends them on.
HELD = 1 << 19


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    w = words_of(*text_bytes(texts), lower=True)
    h, n_docs = w.hashes(), len(texts)
    ok = whole(w.first, len(h), width)[: max(len(h) - width + 1, 0)]
    at = np.flatnonzero(ok)
    token = grams(h, width)[at]
    doc = np.searchsorted(w.first, at, side="right") - 1
    for n in range(1, width):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(n << 32)) | np.uint64(1)
            value = sum((h[w.first[short] + j] * salt[j] for j in range(n)), np.uint64(0))
            token, doc = np.concatenate((token, mix(value))), np.concatenate((doc, short))
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(n_docs + 1))


def prefix_sizes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index size, least number of shared index hashes) for sets of size n."""
    p = n - -(-percent * n // 100) + 1
    least = 1 + p // 4
    return np.minimum(p + least - 1, n), least


def _reduce(f, values: np.ndarray, first: np.ndarray, default: int) -> np.ndarray:
    out = np.full(len(first) - 1, default, values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = f.reduceat(values, first[full])
    return out


def index_places(token: np.ndarray, first: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Each hash's place in its set's order: frequent ones (a bit set in ``often``) last, each kind by value."""
    at = token >> np.uint64(64 - OFTEN_BITS)
    late = (often[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = np.concatenate(([0], np.cumsum(late)))  # frequent hashes before each
    lates = before[:-1] - before[first[:-1]][doc]
    place = np.arange(len(token)) - first[:-1][doc]
    return np.where(late, (np.diff(first) - np.diff(before[first]))[doc] + lates, place - lates)


def signatures(docs: DataFrame, often: np.ndarray, width: int, percent: int, slice_bytes: int = 3 << 20) -> DataFrame:
    """(row's first columns, n, k1, k2, keys, index, bits) per row of ``docs`` (id, its text's hash, text)."""
    names = docs.columns
    salts = GRAM[:MINIMA]
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, names[2], slice_bytes):
                token, first = shingle_sets(b.column(2), width)
                n = np.diff(first)
                k1 = _reduce(np.add, mix(token ^ GRAM[20]), first, 0)
                k2 = _reduce(np.add, mix(token ^ GRAM[21]), first, 0)
                keys = np.stack([*[_reduce(np.minimum, mix(token ^ s), first, 0) for s in salts], mix(k1 ^ k2)], axis=1)
                index = index_places(token, first, sent.value) < np.repeat(prefix_sizes(n, percent)[0], n)
                ends = np.concatenate(([0], np.cumsum(index)))[first]
                i64 = lambda a: pa.array(a.astype(np.int64))
                lists = lambda o, v: pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), i64(v))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), i64(n), i64(k1), i64(k2), lists(np.arange(len(n) + 1) * (MINIMA + 1), keys.ravel()), lists(ends, token[index]), bitmaps(token, first)],
                    ["id", "h", "n", "k1", "k2", "keys", "index", "bits"],
                )

    return docs.mapInArrow(each, "id long, h long, n long, k1 long, k2 long, keys array<long>, index array<long>, bits binary")


def bitmaps(token: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each set's token bitmap: bit (hash modulo bits), bits the power of two that gives a token 4 to 8 of them."""
    n = np.diff(first)
    bits = np.clip(np.exp2(np.ceil(np.log2(np.maximum(4 * n, 1)))).astype(np.int64), 64, MOST_BITS)
    start = np.concatenate(([0], np.cumsum(bits)))
    flags = np.zeros(int(start[-1]), bool)
    flags[(token & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(start[:-1], n)] = True
    data = np.packbits(flags, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(data)])


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (64-bit words) on fewer words: its halves, quarters, ... OR-combined."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def node_of(bits: list[bytes], n: list[int]) -> tuple[bytes, list[int]]:
    """A node over sets: the OR of their bitmaps on the least size, and its spills.

    A spill is the most tokens that a set below the node has beyond its set bits: tokens that share a
    bit. It is kept for the node's size and each of FOLDS - 1 halvings.
    """
    words = [np.frombuffer(b, np.uint64) for b in bits]
    size = min(map(len, words))
    spill = [max(k - int(np.bitwise_count(folded(w, size >> f)).sum()) for w, k in zip(words, n, strict=True)) for f in range(FOLDS) if size >> f]
    return np.bitwise_or.reduce([folded(w, size) for w in words]).tobytes(), spill


def nodes_may_link(low_a: int, bits_a: bytes, spill_a: list[int], low_b: int, bits_b: bytes, spill_b: list[int], percent: int) -> bool:
    """Is the greatest overlap of a set below one node and one below the other enough for a link?"""
    a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    size = min(len(a), len(b))
    fold_a, fold_b = (len(a) // size).bit_length() - 1, (len(b) // size).bit_length() - 1
    if fold_a >= len(spill_a) or fold_b >= len(spill_b):
        return True
    most = int(np.bitwise_count(folded(a, size) & folded(b, size)).sum()) + min(spill_a[fold_a], spill_b[fold_b])
    return (100 + percent) * most >= percent * (low_a + low_b)


def alike(x: str, y: str, percent: int):
    """Can sets of these sizes link at all?"""
    return F.least(F.col(x), F.col(y)) * 100 >= F.greatest(F.col(x), F.col(y)) * percent


# ---- signature trees -------------------------------------------------------------------------------


class Tree:
    """A signature tree over sets (sorted hash arrays), eight children to a node, level by level.

    ``levels[0]`` are the sets. A node's ``spill`` is the most tokens that a set below it has beyond its
    set bits: tokens that share a bit.
    """

    FAN = 8

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0] if len(sets[i]) else 0))
        self.sets, self.place = [sets[i] for i in order], order
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for row, s in zip(maps, self.sets, strict=True):
            raw = np.zeros(bits, np.uint8)
            raw[(s % np.uint64(bits)).astype(np.int64)] = 1
            row[:] = np.packbits(raw)
        maps = maps.view(np.uint64)
        size = np.array([len(s) for s in self.sets], np.int64)
        spill = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, spill)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), self.FAN)
            maps = np.bitwise_or.reduceat(maps, cut, axis=0)
            _, low, high, spill = self.levels[-1]
            self.levels.append((maps, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spill, cut)))

    def children(self, level: int, node: int) -> range:
        return range(node * self.FAN, min((node + 1) * self.FAN, len(self.levels[level - 1][0])))


def may_link(a: Tree, la: int, i: int, b: Tree, lb: int, j: int, percent: int) -> bool:
    """Is the greatest overlap of a set below (la, i) and one below (lb, j) enough for a link?"""
    map_a, low_a, high_a, spill_a = (x[i] for x in a.levels[la])
    map_b, low_b, high_b, spill_b = (x[j] for x in b.levels[lb])
    if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
        return False
    most = int(np.bitwise_count(map_a & map_b).sum()) + min(spill_a, spill_b)
    return (100 + percent) * most >= percent * (low_a + low_b)


def bottom(a: Tree, la: int, i: int, b: Tree, lb: int, j: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The same test for all pairs of sets below two nodes at once."""
    x = np.arange(i * a.FAN**la, min((i + 1) * a.FAN**la, len(a.sets)))
    y = np.arange(j * b.FAN**lb, min((j + 1) * b.FAN**lb, len(b.sets)))
    map_a, size_a, _, spill_a = (v[x] for v in a.levels[0])
    map_b, size_b, _, spill_b = (v[y] for v in b.levels[0])
    most = np.minimum(spill_a[:, None], spill_b[None, :])
    for r in range(len(x)):
        most[r] += np.bitwise_count(map_a[r] & map_b).sum(axis=1, dtype=np.int64)
    low, high = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
    at, to = np.nonzero((100 * low >= percent * high) & ((100 + percent) * most >= percent * (low + high)))
    return x[at], y[to]


def dual_walk(a: Tree, b: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of places (in the lists the trees were built from) that may link."""
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if not may_link(a, la, i, b, lb, j, percent):
            continue
        if la <= 1 and lb <= 1:
            x, y = bottom(a, la, i, b, lb, j, percent)
            yield from ((a.place[p], b.place[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True))
        elif la >= lb:
            stack += [(la - 1, c, lb, j) for c in a.children(la, i)]
        else:
            stack += [(la, i, lb - 1, c) for c in b.children(lb, j)]


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class Side:
    """Documents of one node with their sets, and a tree over them for each bitmap size asked for."""

    def __init__(self, ids: list[int], groups: list[int], sets: list[np.ndarray]) -> None:
        full = [k for k, s in enumerate(sets) if len(s)]
        self.ids, self.groups, self.sets = [ids[k] for k in full], [groups[k] for k in full], [sets[k] for k in full]
        self.most = max(map(len, self.sets), default=0)
        self.trees: dict[int, Tree] = {}

    def tree(self, bits: int) -> Tree:
        if bits not in self.trees:
            self.trees[bits] = Tree(self.sets, bits)
        return self.trees[bits]


def tree_join(left: Side, right: Side, percent: int) -> list[tuple[int, int]]:
    """Links between the documents of two nodes, without those that groups or other links already imply."""
    if not left.sets or not right.sets:
        return []
    bits = max(512, 1 << (8 * max(left.most, right.most) - 1).bit_length())
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    found = []
    for i, j in dual_walk(left.tree(bits), right.tree(bits), percent):
        u, v = root(left.groups[i]), root(right.groups[j])
        if u != v and links(left.sets[i], right.sets[j], percent):
            parent[u] = v
            found.append((left.ids[i], right.ids[j]))
    return found


def sets_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    token, first = shingle_sets(texts, width)
    return [token[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def pair_links(pairs: DataFrame, members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the documents of node pairs (cell, a, b); ``members``: (node, doc, comp, n); ``docs``: (doc, text).

    A cell's nodes meet in one task, each with its texts once; cells are dealt in groups of a bounded number of tokens.
    Up to BROADCAST_ROWS ids are broadcast, so that other texts are not shuffled; beyond that all texts are.
    """
    asked = pairs.select("cell", F.col("a").alias("node")).unionByName(pairs.select("cell", F.col("b").alias("node"))).distinct()
    sent = written(asked.join(members, "node").select("cell", "node", "doc", "comp", "n"), "sent")
    tokens, rows = sent.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if rows <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(sent.select("doc").distinct()), "doc", "left_semi")
    g = F.pmod(F.xxhash64("cell", F.lit(3)), F.lit(max(2 * partitions(docs.sparkSession), tokens >> 19)))
    full = sent.join(docs, "doc").select(g.alias("g"), "cell", "node", "doc", "comp", "text")
    wanted = pairs.select(g.alias("g"), "cell", "a", "b")

    def decide(texts: pa.Table, asks: pa.Table) -> pa.Table:
        cell, node, doc, comp = (np.asarray(texts.column(c)) for c in ("cell", "node", "doc", "comp"))
        order = np.lexsort((doc, node, cell))
        cell, node = cell[order], node[order]
        cut = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])))) if len(order) else np.zeros(0, np.int64)
        place = {(int(cell[i]), int(node[i])): order[i:j] for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True)}
        column, found = texts.column("text").combine_chunks(), []
        at, sides = None, {}
        for c, a, b in sorted(zip(*(asks.column(x).to_pylist() for x in ("cell", "a", "b")), strict=True)):
            if c != at:
                at, sides = c, {}
            for x in (a, b):
                if x not in sides:
                    rows = place.get((c, x), order[:0])
                    sides[x] = Side(doc[rows].tolist(), comp[rows].tolist(), sets_of(column.take(pa.array(rows)), width) if len(rows) else [])
            found += tree_join(sides[a], sides[b], percent)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return full.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(lambda t, p: decide(t, p), "a long, b long")


def star_links(stars: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among candidate pairs, most of which share few b: cells of about LEAF partners of one b."""
    many = written(stars.groupBy("b").agg(F.count(F.lit(1)).alias("many")), "many")
    units = F.ceil(F.col("many") / LEAF)
    placed = stars.join(many, "b").select(F.xxhash64(F.lit("star"), "b", F.pmod(F.xxhash64("a"), units)).alias("cell"), "a", "b")
    pairs = placed.select("cell", F.col("cell").alias("a"), "b").distinct()
    nodes = placed.select(F.col("cell").alias("node"), F.col("a").alias("doc")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("doc")).distinct())
    members = nodes.join(sizes, "doc").select("node", "doc", F.col("doc").alias("comp"), "n")
    return pair_links(written(pairs, "pairs"), written(members, "members"), docs, width, percent)


def frequent(docs: DataFrame, width: int, slice_bytes: int = 3 << 20) -> np.ndarray:
    """A bitmap over hashes (by their first OFTEN_BITS bits): those of the at most OFTEN hashes that most documents of a sample hold, 4 at least."""
    names = docs.columns

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, names[2], slice_bytes):
                value, c = np.unique(shingle_sets(b.column(2), width)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(c.astype(np.int64))], ["token", "c"])

    sample = docs.where(F.pmod(F.xxhash64(names[0], names[1]), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(tokens, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where("c >= 4")
    counts = written(counts.withColumn("power", F.floor(F.log2("c"))), "frequent")
    least, total = 0, 0
    for r in sorted(counts.groupBy("power").count().collect(), reverse=True):  # at most 64 rows
        total += r["count"]
        least = r["power"] + 1 if total > OFTEN else least
        if total > OFTEN:
            break
    found = counts.where(F.col("power") >= least).select("token").toArrow().column("token")
    at = np.unique(np.asarray(found, np.int64).astype(np.uint64) >> np.uint64(64 - OFTEN_BITS)).astype(np.int64)
    out = np.zeros(1 << (OFTEN_BITS - 3), np.uint8)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    dropped(counts)
    return out


def index_rows(rows: DataFrame, percent: int) -> DataFrame:
    """(token, root, comp, least, low, high) for the index hashes of each row; ``least`` is that of the root's smallest set, low..high the root's sizes."""
    p = f"(low - ceil({percent} * low / 100) + 1)"
    least = F.expr(f"cast(1 + {p} div 4 as int)")
    return rows.select(F.explode("index").alias("token"), least.alias("least"), "root", "comp", "low", "high")


def _added_up(rows: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, least, count) with one row for each a and b."""
    rows = np.concatenate(rows)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
    return np.column_stack((rows[first, :2], np.minimum.reduceat(rows[:, 2], first), np.add.reduceat(rows[:, 3], first)))


def root_pairs(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): roots of different groups that share enough index hashes.

    Streams over hashes sorted in each partition; a task adds up the pairs it meets and never holds more than
    about 2 * HELD of them.
    """
    spread = index.repartition(partitions(index.sparkSession), "token").sortWithinPartitions("token", "root")

    def met(token, root, comp, least, low, high) -> Iterator[np.ndarray]:
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (root[1:] != root[:-1])
        token, root, comp, least, low, high = (x[keep] for x in (token, root, comp, least, low, high))
        run = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        long = np.diff(np.append(run, len(token)))
        mixed = np.repeat(np.minimum.reduceat(comp, run) != np.maximum.reduceat(comp, run), long)
        left = np.repeat(run + long, long) - np.arange(len(token)) - 1  # rows of the run after this one
        at, step = np.flatnonzero(mixed & (left >= 1)), 1
        while len(at):
            for lo in range(0, len(at), HELD):
                x = at[lo : lo + HELD]
                y = x + step
                fits = (comp[x] != comp[y]) & (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
                x, y = x[fits], y[fits]
                if len(x):
                    yield np.column_stack((root[x], root[y], np.minimum(least[x], least[y]), np.ones(len(x), np.int64)))
            step += 1
            at = at[left[at] >= step]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(c), np.int64) for c in ("token", "root", "comp", "least", "low", "high")]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield from met(*[c[:last] for c in cols])
            kept = [c[last:] for c in cols]
        if kept is not None and len(kept[0]):
            yield from met(*kept)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fresh, size = np.zeros((0, 4), np.int64), [], 0

        def sent(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[lo : lo + (1 << 16)].T], ["a", "b", "least", "c"])

        for rows in runs(batches):
            fresh.append(rows)
            size += len(rows)
            if size >= HELD:
                total, fresh, size = _added_up([total, *fresh]), [], 0
                if len(total) >= HELD:
                    yield from sent(total)
                    total = total[:0]
        if fresh:
            total = _added_up([total, *fresh])
        yield from sent(total)

    found = spread.mapInArrow(each, "a long, b long, least long, c long")
    return found.groupBy("a", "b").agg(F.min("least").alias("least"), F.sum("c").alias("c")).where("c >= least").select("a", "b")


def leaf_pairs(pairs: DataFrame, inner: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(cell, a, b): the leaves below pairs of roots, and pairs of leaves of one root (``inner``), that may still link.

    ``nodes``: (leaf, root, cell, low, high, comp, mixed, bits, spill). A leaf of several groups is paired with itself.
    """
    side = lambda s: nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("leaf", "root", "cell", "low", "high", "comp", "mixed", "bits", "spill")])
    both = pairs.join(side("a"), F.col("a") == F.col("root_a")).join(
        side("b"), (F.col("b") == F.col("root_b")) & F.expr(f"low_a * {percent} <= high_b * 100 and low_b * {percent} <= high_a * 100 and comp_a <> comp_b")
    )
    same = F.expr(f"low_a * {percent} <= high_b * 100 and low_b * {percent} <= high_a * 100 and comp_a <> comp_b")
    both = both.unionByName(inner.join(side("a"), F.col("a") == F.col("leaf_a")).join(side("b"), (F.col("b") == F.col("leaf_b")) & same))
    alone = nodes.where("mixed and leaf <> root")
    twice = alone.select(F.col("leaf").alias("a"), F.col("leaf").alias("b"), *[F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("leaf", "root", "cell", "low", "high", "comp", "mixed", "bits", "spill")])
    both = both.unionByName(twice)
    asked = ["leaf_a", "leaf_b", "cell_a", "cell_b", "root_a", "root_b", *[f"{c}_{s}" for s in "ab" for c in ("low", "bits", "spill")]]

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                sides = zip(*[b.column(f"{c}_{s}").to_pylist() for s in "ab" for c in ("low", "bits", "spill")], strict=True)
                same = np.asarray(b.column("leaf_a")) == np.asarray(b.column("leaf_b"))
                keep = same | np.array([nodes_may_link(*x, percent) for x in sides], bool)
                yield b.select(asked[:6]).filter(pa.array(keep))

    left = written(both.select(*asked).mapInArrow(pruned, ", ".join(f"{c} long" for c in asked[:6])), "kept-pairs")
    # documents alone that are paired with leaves of one root go in cell rows of that root
    many, few = (F.when(F.col("leaf_a") == F.col("root_a"), F.col(x)).otherwise(F.col(y)) for x, y in (("root_b", "root_a"), ("leaf_a", "leaf_b")))
    uneven = left.where("(leaf_a = root_a) <> (leaf_b = root_b)").withColumns({"many": many, "few": few})
    units = written(uneven.select("many", "few").distinct().groupBy("many").agg(F.ceil(F.count(F.lit(1)) / (CELL * LEAF)).alias("units")), "units")
    row = F.xxhash64(F.lit("by"), "many", F.pmod(F.xxhash64("few", F.lit(2)), "units"))
    uneven = uneven.join(units, "many").select("leaf_a", "leaf_b", row.alias("cell_a"), F.when(F.col("few") == F.col("leaf_a"), F.col("cell_b")).otherwise(F.col("cell_a")).alias("cell_b"))
    left = left.where("(leaf_a = root_a) = (leaf_b = root_b)").select("leaf_a", "leaf_b", "cell_a", "cell_b").unionByName(uneven)
    return left.select(F.xxhash64(F.least("cell_a", "cell_b"), F.greatest("cell_a", "cell_b")).alias("cell"), F.col("leaf_a").alias("a"), F.col("leaf_b").alias("b"))


def leaves_of(slim: DataFrame, clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc, n, root, leaf, cell, comp) per document of ``slim`` (doc, n).

    ``clusters`` (doc, cluster): documents that met; ``groups`` (id, component): linked groups. A group with many documents
    of a cluster has leaves of its own; a leaf belongs to the cell row of its eight neighbours.
    """
    named = written(
        slim.join(clusters, "doc", "left").join(groups.withColumnRenamed("id", "doc"), "doc", "left").select("doc", "n", "cluster", F.coalesce("component", "doc").alias("comp")),
        "named",
    )
    alone = named.where("cluster is null").select("doc", "n", F.col("doc").alias("root"), F.col("doc").alias("leaf"), F.col("doc").alias("cell"), "comp")
    met = named.where("cluster is not null")
    counts = met.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("tokens"))
    counts = written(counts.withColumn("part", F.when(F.col("many") >= LEAF // 4, F.xxhash64("cluster", "comp")).otherwise(F.xxhash64(F.lit("rest"), "cluster"))), "counts")
    units = counts.groupBy("part").agg(F.greatest(F.ceil(F.sum("many") / LEAF), F.ceil(F.sum("tokens") / LEAF_TOKENS), F.lit(1)).alias("units"))
    parts = written(counts.join(units, "part").select("cluster", "comp", "part", "units"), "parts")
    block = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("units"))
    placed = met.join(parts, ["cluster", "comp"]).select(
        "doc", "n", F.xxhash64(F.lit("root"), "cluster").alias("root"), F.xxhash64(F.lit("leaf"), "part", block).alias("leaf"),
        F.xxhash64(F.lit("cell"), "part", F.floor(block / CELL)).alias("cell"), "comp",
    )
    return alone.unionByName(placed)


def tree_nodes(placed: DataFrame, bits: DataFrame) -> DataFrame:
    """One row per leaf: (leaf, root, cell, low, high, comp, mixed, bits, spill). A leaf of several groups is a group of its own."""
    full = placed.join(bits, "doc").select("leaf", "root", "cell", "comp", "n", "bits")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [node_of([x], [n])[1] for x, n in zip(b.column("bits").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.int64()))], [*b.schema.names, "spill"])

    def joined(group: pa.Table) -> pa.Table:
        n, comp = group.column("n").to_pylist(), group.column("comp").to_pylist()
        bits, spill = node_of(group.column("bits").to_pylist(), n)
        mixed = min(comp) != max(comp)
        return group.slice(0, 1).select(["leaf", "root", "cell"]).append_column("low", pa.array([min(n)])).append_column("high", pa.array([max(n)])).append_column(
            "comp", pa.array([group.column("leaf")[0].as_py() if mixed else comp[0]], pa.int64())
        ).append_column("mixed", pa.array([mixed])).append_column("bits", pa.array([bits], pa.binary())).append_column("spill", pa.array([spill], pa.list_(pa.int64())))

    schema = "leaf long, root long, cell long, low long, high long, comp long, mixed boolean, bits binary, spill array<long>"
    one = full.where("leaf = root").select("leaf", "root", "cell", F.col("n").alias("low"), F.col("n").alias("high"), "comp", F.lit(False).alias("mixed"), "bits")
    one = one.withColumn("n", F.col("low")).mapInArrow(alone, "leaf long, root long, cell long, low long, high long, comp long, mixed boolean, bits binary, n long, spill array<long>").drop("n")
    return one.unionByName(full.where("leaf <> root").groupBy("leaf").applyInArrow(lambda t: joined(t), schema))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """((id, h, n, doc) per row of ``docs``, (doc, component, least) per linked document).

    ``h`` is a hash of the text, and ``doc`` names the document: its id, or a number from 1 << 61 on for rows
    that repeat an id with another text; the component is the least doc, ``least`` the least id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    with light_batches(docs.sparkSession):  # texts, bitmaps and index hashes are wide
        return _linked(docs, width, percent)


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    sets = written(signatures(docs, frequent(docs, width), width, percent), "sets")
    again = written(sets.where("id is not null").groupBy("id").agg(F.min("h").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").select("id", "first"), "again")
    repeated = again.limit(1).count() > 0

    def named(rows: DataFrame) -> DataFrame:
        other = F.lit(1 << 61) + F.pmod(F.xxhash64("id", "h"), F.lit(1 << 61))
        return rows.join(again, "id", "left").withColumn("doc", F.when(F.col("first") != F.col("h"), other).otherwise(F.col("id"))).drop("first")

    sets, texts = named(sets), named(docs.where("id is not null and text is not null")).select("doc", "text")
    some = sets.where("n > 0 and doc is not null")
    if repeated:
        some, texts = written(some.dropDuplicates(["doc"]), "some"), texts.dropDuplicates(["doc"])

    # copies, and near copies of the smallest document of a bucket
    keyed = some.select("doc", "n", "k1", "k2", F.posexplode("keys").alias("j", "key"))
    heads = keyed.groupBy("j", "key").agg(F.min(F.struct("doc", "n", "k1", "k2")).alias("head"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    met = written(
        keyed.join(heads, ["j", "key"]).where(F.col("doc") != F.col("head.doc")).select(
            "j", "doc", "n", F.col("head.doc").alias("to"), F.col("head.n").alias("to_n"),
            ((F.col("k1") == F.col("head.k1")) & (F.col("k2") == F.col("head.k2")) & (F.col("n") == F.col("head.n"))).alias("same"),
        ),
        "met",
    )
    copies = written(met.where((F.col("j") == MINIMA) & F.col("same")).select(F.col("doc").alias("a"), F.col("to").alias("b")), "copies")
    gone = copies.select(F.col("a").alias("doc"))
    slim = written(some.select("doc", "n").join(gone, "doc", "left_anti"), "slim")
    originals = written(met.where((F.col("j") < MINIMA) & ~F.col("same") & alike("n", "to_n", percent)).select("j", "doc", "to").join(gone, "doc", "left_anti"), "originals")
    stars = written(originals.groupBy(F.col("doc").alias("a"), F.col("to").alias("b")).agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("a", "b"), "stars")
    near = written(star_links(stars, slim, texts, width, percent), "links")
    dropped(met)

    # the tree: documents that met, and those that share two minima with documents of one such cluster
    first = written(components(stars).select(F.col("id").alias("doc"), F.col("component").alias("cluster")), "clusters")
    late = originals.join(first, "doc", "left_anti").join(first.withColumnRenamed("doc", "to"), "to").groupBy("doc", "cluster").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    late = late.groupBy("doc").agg(F.max_by("cluster", F.struct("c", "cluster")).alias("cluster"))
    clusters = written(first.unionByName(late), "clusters")
    placed = written(leaves_of(slim, clusters, components(near)), "placed")
    nodes = written(tree_nodes(placed, some.select("doc", "bits")), "nodes")
    roots = nodes.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    roots = roots.select("root", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), F.when(F.col("c0") == F.col("c1"), F.col("c0")).otherwise(F.col("root")).alias("comp"))
    roots = written(roots, "roots")
    owner = written(placed.select("doc", "root").join(roots, "root"), "owner")
    pairs = root_pairs(index_rows(some.select("doc", "index").join(owner, "doc"), percent), percent)
    pairs = written(pairs, "root-pairs")
    # inside a root its leaves ask the same index, under the root's own hashes
    within = nodes.where("leaf <> root").groupBy("root").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("root")
    leafed = placed.where("leaf <> root").join(within, "root", "left_semi").select("doc", "root", "leaf").join(nodes.select("leaf", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), "comp"), "leaf")
    own = some.select("doc", "index").join(leafed, "doc").select(F.transform("index", lambda t: F.xxhash64(t, F.col("root"))).alias("index"), F.col("leaf").alias("root"), "comp", "low", "high")
    inner = written(root_pairs(index_rows(own, percent), percent), "inner-pairs")
    todo = written(leaf_pairs(pairs, inner, nodes, percent), "leaf-pairs")
    crossed = written(pair_links(todo, placed.select(F.col("leaf").alias("node"), "doc", "comp", "n"), texts, width, percent), "crossed")
    dropped(nodes, originals, slim, first, clusters, placed, owner, roots, pairs, inner, todo)
    groups = components(copies.unionByName(near).unionByName(crossed)).withColumnRenamed("id", "doc")
    found = sets.select("id", "h", "n", "doc")
    if not repeated:
        return found, groups.withColumn("least", F.col("component"))
    groups = written(groups, "groups")
    least = written(groups.join(found.where("doc is not null").select("doc", "id").distinct(), "doc").groupBy("component").agg(F.min("id").alias("least")), "least")
    return found, groups.join(least, "component").select("doc", "component", "least")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The smallest document of each group, with all columns; rows without id stay; of equal texts of one id one row stays."""
    found, groups = near_copies(docs, id_col, text_col, width, percent)
    gone = groups.where("doc <> component").join(found, "doc").select(F.col("id").alias(i := spare(docs, "id")), F.col("h").alias(h := spare(docs, "h"))).distinct()
    place = spare(docs, "place")
    named = docs.where(F.col(id_col).isNotNull()).withColumns({i: F.col(id_col).cast("long"), h: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    kept = named.join(gone, [i, h], "left_anti")
    others = [F.col(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    first = Window.partitionBy(i, h).orderBy(F.xxhash64(*others))
    kept = kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, groups = near_copies(table(spark, sf_dir, "documents"))
    return found.join(groups.select("doc", "least"), "doc", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
