"""Phrase collocations by vertical partitioning of suffixes (after ERA).

The corpus is one string of words, cut into pieces at punctuation. The words with enough occurrences are found first.
Then the suffixes, cut to ``longest`` words and before the first rarer word, are dealt to groups by their first word;
a word with more occurrences than a group's memory budget is split by its second word, and so on (counted by cells of
hashes, so what is counted is bounded too). Each group
sorts its suffixes and reads its subtree from them: a node of depth d is a run of suffixes with the same d words, and
its count is the total of its leaves. Nodes above the split points get their parts from several groups, which are added.
Scores, cuts and coverage are joins between nodes.

Equal suffixes of one slice of text travel as one with their number, so a passage that every document holds is shipped
once a slice. A bitmap of the frequent words (at most 2^28 bits, whatever their number) tells which suffixes to send; a
bit that is set by chance costs a row and no result. Words are told apart by 64-bit hashes of language and word; frequent
words are checked for equal hashes, and another seed is taken if there are any.

Defined results: null texts are empty; a null language is ``und``; documents without words add nothing; repeated rows count
again; rows need no id; equal scores and counts are ordered by the phrase's bytes; a very long text is cut into runs of a
million words; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, written
from .prefixes import budget_of, cell_bits, group_of, packed, sums
from .words import GRAM, Words, gather, mix, text_bytes, text_slices, words_of

LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
SLICE = 8 << 20
RUN = 1 << 20
#: Suffixes that a group's task sorts at once: 36 bytes each, and as much again for the sort.
GROUP_SUFFIXES = 2_000_000
#: Smaller groups are not worth their own counts.
LEAST_SUFFIXES = 32_768

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True


def hashed(batch: pa.RecordBatch, seed: int) -> tuple[Words, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words of a batch (text, lang), their hashes, the piece of each, the languages and the language of each word."""
    w = words_of(*(at := text_bytes(batch.column("text"))), lower=True, gaps=GAP)
    lang = pc.dictionary_encode(batch.column("lang").cast(pa.string()).fill_null("und"))
    salt = np.array([int.from_bytes(hashlib.blake2b(f"{seed} {x}".encode(), digest_size=8).digest(), "little") for x in lang.dictionary.to_pylist()] or [0], np.uint64)
    of = np.repeat(np.asarray(lang.indices, np.int64), w.counts)
    h = mix(w.hashes() ^ salt[of])
    h[h == 0] = 1
    rows = np.repeat(np.arange(len(at[1]) - 1), w.counts)
    return w, h, np.searchsorted(np.flatnonzero(BREAK[w.buf]), w.start) + rows, lang.dictionary, of


def prefix_hashes(cols: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the first 1, 2, ... words of each suffix; ``cols`` has a row for each depth (0: no word)."""
    p = cols[0]
    yield p
    for j in range(1, len(cols)):
        p = mix(p * GRAM[0] + cols[j] * GRAM[j])
        yield p


def split(p: np.ndarray, d: int, hot: list[np.ndarray]) -> np.ndarray:
    """Which prefixes of ``d`` + 1 words are over the budget? Those whose cell is; a lighter one there is split with it."""
    if d >= len(hot):
        return np.zeros(len(p), bool)
    return hot[d][(p >> np.uint64(65 - len(hot[d]).bit_length())).astype(np.int64)]


def routes(cols: np.ndarray, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the shortest prefix of each suffix that is not split, and whether it has all words that are looked at."""
    live, out = np.ones(cols.shape[1], bool), None
    for d, p in enumerate(prefix_hashes(cols)):
        out = p if out is None else np.where(live, p, out)
        if d == len(hot):
            break
        live &= split(p, d, hot)
    return out, live


def suffixes(batch: pa.RecordBatch, seed: int, bits: int, bitmap: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Suffixes of two and more frequent words, a column each, in runs of a million positions."""
    _, h, piece, _, _ = hashed(batch, seed)
    for lo in range(0, len(h), RUN):
        x, at, own = h[lo : lo + RUN + longest], piece[lo : lo + RUN + longest], min(RUN, len(h) - lo)
        cell = x >> np.uint64(64 - bits)
        ok = (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        cols, live = np.zeros((longest, own), np.uint64), ok[:own].copy()
        cols[0] = x[:own]
        for j in range(1, longest):
            m = min(own, len(x) - j)
            live[max(m, 0) :] = False
            if m > 0:
                live[:m] &= ok[j : j + m] & (at[j : j + m] == at[:m])
                cols[j, :m][live[:m]] = x[j : j + m][live[:m]]
        yield cols[:, cols[1] != 0]


def runs(cols: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted suffixes, their weights, and for each depth whether a suffix differs from the one before in its first words."""
    order = np.lexsort(cols[::-1])
    cols, weight = cols[:, order], weight[order]
    new, out = np.zeros(cols.shape[1], bool), []
    new[:1] = True
    for c in cols:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        out.append(new)
    return cols, weight, out


def subtree(cols: np.ndarray, weight: np.ndarray, least: int, hot: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and count of each node of two and more words: those with ``least`` occurrences, and parts of split ones."""
    cols, weight, new = runs(cols, weight)
    for d, p in enumerate(prefix_hashes(cols)):
        if d == 0 or not len(weight):
            continue
        start = np.flatnonzero(new[d])
        total = np.add.reduceat(weight, start)
        keep = (cols[d, start] != 0) & ((total >= least) | split(p[start], d, hot))
        yield cols[: d + 1, start[keep]], total[keep]


def vocabulary(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """(h, lang, word, f): words with ``least`` occurrences, and for each language a row without word, the number of all."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in text_slices(x, "text", SLICE)):
            w, h, _, langs, of = hashed(b, seed)
            value, first, n = np.unique(h, return_index=True, return_counts=True)
            data, offsets = gather(w.buf, w.start[first], (w.end - w.start)[first])
            word = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            cols = [pa.array(value.view(np.int64)), langs.take(pa.array(of[first])), word, pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "lang", "word", "f"])
            all_of = np.bincount(of, minlength=len(langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(langs), np.int64)), langs, pa.nulls(len(langs), pa.string()), pa.array(all_of)], ["h", "lang", "word", "f"])

    found = docs.mapInArrow(counts, "h long, lang string, word string, f long").groupBy("h", "lang", "word").agg(F.sum("f").alias("f"))
    return written(found.where((F.col("f") >= least) | F.col("word").isNull()), "vocabulary")


def bitmap_of(known: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A bitmap with the leading bits of each hash of ``known``: 16 bits a word, 2^28 at most."""
    bits = min(28, max(15, (16 * n).bit_length()))
    at = F.expr(f"shiftrightunsigned(h, {64 - bits})") + 1
    rows = known.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((1 << bits >> 15, 4096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return bits, out.reshape(-1)


def nodes(docs: DataFrame, known: DataFrame, seed: int, least: int, longest: int) -> DataFrame:
    """(key, f): the hashes of the words of each phrase of 2 to ``longest`` words with ``least`` occurrences, and their number."""
    spark = docs.sparkSession
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("f")).first()
    total = int(size["f"])
    budget = budget_of(spark, total, GROUP_SUFFIXES, LEAST_SUFFIXES)
    sent = spark.sparkContext.broadcast(bitmap_of(known, size["n"]))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in (s for x in batches for s in text_slices(x, "text", SLICE)):
            yield from suffixes(b, seed, *sent.value, longest)

    # Vertical partitioning: what is over the budget is counted one word deeper, by cells of prefix hashes; a task sends its sums.
    bits = cell_bits(budget, max(total, 1))
    cells = sums(known.select(F.expr(f"shiftrightunsigned(h, {64 - bits})").alias("cell"), F.col("f").alias("n")), bits)
    load, hot = np.zeros(1 << bits, np.int64), []
    while len(hot) < longest - 1 and (cells > budget).any():
        hot.append(cells > budget)
        load += np.where(hot[-1], 0, cells)

        def deeper(batches: Iterator[pa.RecordBatch], above: list[np.ndarray] = list(hot)) -> Iterator[pa.RecordBatch]:
            met = np.zeros(1 << bits, np.int64)
            for cols in slices(batches):
                p, live = routes(cols, above)
                met += np.bincount((p[live] >> np.uint64(64 - bits)).astype(np.int64), minlength=len(met))
            some = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(met[some])], ["cell", "n"])

        cells = sums(docs.mapInArrow(deeper, "cell long, n long"), bits)
    shift, starts = 64 - bits, packed(load + cells, budget)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each run and group: equal suffixes once with their number; columns one after the other."""
        for cols in slices(batches):
            group = group_of(routes(cols, hot)[0], shift, starts)
            order = np.lexsort((*cols[::-1], group))
            cols, group = cols[:, order], group[order]
            if not len(group):
                continue
            new = np.ones(len(group), bool)
            new[1:] = (group[1:] != group[:-1]) | (cols[:, 1:] != cols[:, :-1]).any(axis=0)
            first = np.flatnonzero(new)
            weight = np.diff(np.append(first, len(group))).astype(np.uint64)
            cols, group = np.vstack([cols[:, first], weight]), group[first]
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            rows = np.diff(np.append(start, len(group)))
            depth = len(cols)
            out, within = np.empty(cols.size, np.uint64), np.arange(len(group)) - np.repeat(start, rows)
            for j, c in enumerate(cols):
                out[np.repeat(start * depth + j * rows, rows) + within] = c
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(group)) * depth * 8), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(group[start].astype(np.int32)), blobs], ["group", "blob"])

    def grow(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_buffer(), np.uint64).reshape(longest + 1, -1) for b in t.column("blob").combine_chunks()]
        cols = np.concatenate(parts, axis=1)
        keys, counts = [], []
        for words, n in subtree(cols[:-1], cols[-1].astype(np.int64), least, hot):
            keys.append(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(words)), pa.array(np.ascontiguousarray(words.T).reshape(-1).view(np.int64))))
            counts.append(pa.array(n))
        kind = pa.schema([("key", pa.list_(pa.int64())), ("f", pa.int64())])
        return pa.Table.from_arrays([pa.chunked_array(keys, kind.field("key").type), pa.chunked_array(counts, pa.int64())], schema=kind)

    grown = docs.mapInArrow(ship, "group int, blob binary").groupBy("group").applyInArrow(grow, "key array<long>, f long")
    return written(grown.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "nodes")


def over(a: Column, by: Column, times: int) -> Column:
    """floor(times * a / by), exact beyond 64 bits."""
    return F.call_function("div", F.lit(times).cast("decimal(10,0)") * a.cast("decimal(20,0)"), by.cast("decimal(20,0)"))


def scored(found: DataFrame, known: DataFrame) -> DataFrame:
    """Each phrase with a, l, r, score of its lowest-scoring cut (ties after flooring: the first)."""
    size = F.size("key")
    part = lambda at, n: F.expr(f"slice(key, {at}, {n})")
    cuts = found.select("key", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = cuts.select(
        "key", "a", "k", F.inline(F.array(F.struct(F.lit(True).alias("left"), part("1", "k").alias("part")), F.struct(F.lit(False).alias("left"), part("k + 1", "size(key) - k").alias("part"))))
    )
    counts = known.select(F.array("h").alias("part"), "f").unionByName(found.select(F.col("key").alias("part"), "f"))
    met = sides.join(counts, "part").groupBy("key", "a").agg(F.collect_list(F.struct("k", "left", "f")).alias("sides"))  # six at most for four words
    of = lambda k, left: F.array_max(F.transform(F.filter("sides", lambda s: (s["k"] == k) & (s["left"] == left)), lambda s: s["f"]))
    at = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), of(k, F.lit(True)).alias("l"), of(k, F.lit(False)).alias("r")))
    all_cuts = F.transform(at, lambda c: F.struct(over(F.col("a"), c["l"] + c["r"], 2_000_000).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    return met.withColumn("cut", F.array_min(all_cuts)).select("key", "a", "cut.score", "cut.l", "cut.r")


def covered(found: DataFrame) -> DataFrame:
    """(key, longer): for each phrase that lies inside longer ones, the largest count of these."""
    inside = "flatten(transform(sequence(2, size(key) - 1), n -> transform(sequence(1, size(key) - n + 1), i -> slice(key, i, n))))"
    longer = found.where(F.size("key") > 2).select(F.explode(F.expr(inside)).alias("key"), "f")
    return longer.groupBy("key").agg(F.max("f").alias("longer"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, percent: int = COVERED, top: int | None = TOP
) -> DataFrame:
    """The best ``top`` phrases of each language (None: all): lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    for seed in count():
        words = vocabulary(docs, least, seed)
        known = words.where(F.col("word").isNotNull())
        if not known.groupBy("h").count().where("count > 1").limit(1).count():
            break
        dropped(words)
    found = nodes(docs, known, seed, least, longest)
    inner = covered(found).withColumnRenamed("key", "inner")
    wide = lambda c, times: F.col(c).cast("decimal(20,0)") * times
    hidden = inner.join(found, F.col("inner") == F.col("key")).where(wide("longer", 100) >= wide("f", percent)).select("key")
    best = scored(found, known).join(hidden, "key", "left_anti")
    first = known.select(F.col("h").alias("h1"), "lang")
    best = best.join(first, F.element_at("key", 1) == F.col("h1")).drop("h1")
    if top is not None:
        by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        best = best.withColumn("place", F.rank().over(by)).where(F.col("place") <= top).drop("place")
    spelt = best.select("key", F.posexplode("key").alias("pos", "h")).join(known.select("h", "word"), "h")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    totals = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = best.join(spelt, "key").join(totals, "lang").withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = """
WITH p AS (SELECT row_number() OVER () AS pid, lang, w FROM (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, array_to_string(w[i:i+k-1], ' ') AS phrase, k, count(*) AS f FROM i, range(1, 5) AS r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS x FROM g WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, q.f AS r, (2000000::HUGEINT * c.f) // (l.f + q.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.x[1:j], ' ') JOIN g q ON q.lang = c.lang AND q.phrase = array_to_string(c.x[j+1:], ' ')),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
hid AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, f, k, x, unnest(range(2, k)) AS m FROM c WHERE k > 2) b, range(1, 4) AS t(o), s
  WHERE o + m - 1 <= b.k AND s.lang = b.lang AND s.phrase = array_to_string(b.x[o:o+m-1], ' ') AND 100::HUGEINT * b.f >= 80::HUGEINT * s.a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT s.*, n.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM s JOIN n USING (lang) ANTI JOIN hid USING (lang, phrase)) WHERE rank <= 2000
"""
