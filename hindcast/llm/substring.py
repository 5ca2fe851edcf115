"""Substring dedup with super-k-mers: drop words covered by a window that also starts in a smaller document.

A window is ``width`` consecutive words of one text. Its minimiser is the least hash of its word pairs.
Consecutive windows that share a minimiser travel as one packed string (a super-k-mer) to the
minimiser's bucket, so a word is shipped about three times and not ``width`` times; strings of one
bucket and input slice travel compressed together. In its bucket every window is counted exactly:
windows are sorted by hash, and equal hashes are compared byte by byte.

Skew. Equal strings of one input slice are met there: all but those of the smallest document are
judged on the spot and not shipped, so copies do not pile up. Minimisers that a sample shows to fill
more than a bucket's share are split: their windows travel singly, by the hash of the window. Of these a
task remembers up to REMEMBERED with the smallest document it has met, and judges later ones against it, so
a window that every document holds is shipped a few times by a task and not once by each slice. The sample
decides only where windows meet, never a result. The number of buckets follows the bytes of the texts.

Defined results: null text has no words; rows without a document id are kept whole and remove nothing;
repeated rows (same id and text) get the same result; rows with one id and different texts are judged
apart (the texts of such an id are numbered); ties do not arise, as only smaller ids count; a very long
text is one slice of its task, whose memory is in proportion to it; an empty table gives an empty table;
extra columns pass through, and a new column gets underscores where the table has its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, spare, table, written
from .words import Words, blocks, gather, grams, mix, text_bytes, text_slices, whole, words_of

WIDTH = 13
PAIR = 2
LONGEST = 64
BUCKET_BYTES = 6 << 20
REMEMBERED = 100_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def equal_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Are the byte ranges a..a+size_a and b..b+size_b equal, pair by pair?"""
    same = size_a == size_b
    fits = np.flatnonzero(same)
    for lo, hi in blocks(size_a[fits]):
        at = fits[lo:hi]
        left, offsets = gather(buf, a[at], size_a[at])
        right, _ = gather(buf, b[at], size_a[at])
        differs = np.concatenate(([0], np.cumsum(left != right)))
        same[at] = differs[offsets[1:]] == differs[offsets[:-1]]
    return same


def super_kmers(w: Words, width: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, key, does it travel singly) of each super-k-mer of the texts in ``w``."""
    n = len(w.start) - width + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty.astype(np.uint64), empty.astype(bool)
    h = w.hashes()
    least = sliding_min(grams(h, PAIR), width - PAIR + 1)[:n]
    ok = whole(w.first, len(w.start), width)[:n]
    cut = ok.copy()
    cut[1:] &= ~(ok[:-1] & (least[1:] == least[:-1]))
    key, single = least, np.zeros(n, bool)
    if len(hot):
        single = ok & np.isin(least, hot)
        if single.any():
            cut |= single
            key = np.where(single, grams(h, width), least)
    begun = np.maximum.accumulate(np.where(cut, np.arange(n), -1))
    cut |= ok & ((np.arange(n) - begun) % LONGEST == 0)
    first = np.flatnonzero(cut)
    if not len(first):
        return empty, empty, empty.astype(np.uint64), empty.astype(bool)
    count = np.add.reduceat(ok, first, dtype=np.int64)
    return first, count, key[first], single[first]


def _doc_of(w: Words, word: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, word, side="right") - 1


def _blob(kind: int, *arrays: np.ndarray) -> bytes:
    parts = [np.array([kind, len(arrays[0])], np.int64).tobytes()]
    for a in arrays:
        parts += [np.array([a.nbytes], np.int64).tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unblob(blob: bytes, dtypes: dict[int, tuple]) -> tuple[int, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    kind, _ = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for t in dtypes[int(kind)]:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return int(kind), out


#: Blob kinds: 0 strings (id steps, tag, first window, windows, bytes of the string; the strings), 1 ranges already judged.
_TYPES = {0: (np.int64, np.int32, np.int32, np.uint8, np.int32, np.uint8), 1: (np.int64, np.int32, np.int32, np.int32)}


def _shipped(batch: pa.RecordBatch, width: int, buckets: int, hot: np.ndarray, met: dict[int, tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    ids = np.asarray(batch.column(0), np.int64)
    tags = np.asarray(batch.column(1), np.int32)
    w = words_of(*text_bytes(batch.column(2)))
    first, count, key, single = super_kmers(w, width, hot)
    if not len(first):
        return
    packed, word_at = w.joined()
    doc = _doc_of(w, first)
    begin = word_at[first]
    size = word_at[first + count + width - 1] - 1 - begin
    # equal strings of this slice: those of larger documents are judged here
    same = mix(key + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    order = np.lexsort((ids[doc], same))
    new = np.concatenate(([True], same[order][1:] != same[order][:-1]))
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = ids[doc[order]] > ids[doc[lead]]
    a, b = order[later], lead[later]
    equal = equal_bytes(packed, begin[a], begin[b], size[a], size[b])
    judged = np.zeros(len(first), bool)
    judged[a[equal]] = True
    for k in np.flatnonzero(single & ~judged).tolist():  # windows of hot minimisers: against the smallest document met so far
        own, name, window = int(ids[doc[k]]), int(same[k]), packed[begin[k] : begin[k] + size[k]].tobytes()
        least, known = met.get(name, (own, window))
        judged[k] = known == window and own > least
        if known == window and (name in met or len(met) < REMEMBERED):
            met[name] = (min(own, least), window)
    bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
    if judged.any():
        j = np.flatnonzero(judged)
        at = first[j] - w.first[doc[j]]
        yield int(bucket[j[0]]), _blob(1, ids[doc[j]], tags[doc[j]], at.astype(np.int32), (at + count[j] + width - 1).astype(np.int32))
    left = np.flatnonzero(~judged)
    left = left[np.argsort(bucket[left], kind="stable")]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket[left])) + 1, [len(left)]))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        x = left[lo:hi]
        if len(x):
            text, _ = gather(packed, begin[x], size[x])
            yield int(bucket[x[0]]), _blob(
                0, np.diff(ids[doc[x]], prepend=np.int64(0)), tags[doc[x]], (first[x] - w.first[doc[x]]).astype(np.int32),
                count[x].astype(np.uint8), size[x].astype(np.int32), text,
            )


def repeated_windows(ids: np.ndarray, count: np.ndarray, size: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """For each window of the packed strings: does its word sequence also start in a smaller document?"""
    begin = np.cumsum(size) - size
    w = words_of(text, np.concatenate((begin, [len(text)])))
    h = grams(w.hashes(), width)
    lead = np.cumsum(count) - count
    inside = np.arange(int(count.sum())) - np.repeat(lead, count)
    at = np.repeat(w.first[:-1], count) + inside
    owner = np.repeat(ids, count)
    win = h[at]
    a, z = w.start[at], w.end[at + width - 1]
    order = np.argsort(win, kind="stable")
    new = np.concatenate(([True], win[order][1:] != win[order][:-1]))
    run = np.flatnonzero(new)
    head = order[np.repeat(run, np.diff(np.append(run, len(order))))]
    follows = np.flatnonzero(~new)
    x, y = order[follows], head[follows]
    same = equal_bytes(text, a[x], a[y], z[x] - a[x], z[y] - a[y])
    group = np.cumsum(new) - 1
    if not same.all():  # two sequences with one hash: number the sequences of those runs one by one
        number, group = {}, group.astype(np.int64)
        for k in np.flatnonzero(np.isin(group, group[follows[~same]])):
            i = order[k]
            group[k] = number.setdefault(text[a[i] : z[i]].tobytes(), len(order) + len(number))
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
        new = np.concatenate(([True], group[1:] != group[:-1]))
        run = np.flatnonzero(new)
    smallest = np.minimum.reduceat(owner[order], run)
    out = np.zeros(len(win), bool)
    out[order] = owner[order] > np.repeat(smallest, np.diff(np.append(run, len(order))))
    return out


def _judge(group: pa.Table, width: int) -> pa.Table:
    cols: list[list[np.ndarray]] = [[], [], [], []]
    kept: list[list[np.ndarray]] = []
    for blob in group.column("blob").to_pylist():
        kind, arrays = _unblob(blob, _TYPES)
        if kind == 1:
            for c, a in zip(cols, arrays, strict=True):
                c.append(a)
        else:
            arrays[0] = np.cumsum(arrays[0])
            kept.append(arrays)
    if kept:
        ids, tags, first, count, size, text = (np.concatenate(x) for x in zip(*kept, strict=True))
        count, size = count.astype(np.int64), size.astype(np.int64)
        hit = repeated_windows(ids, count, size, text, width)
        kmer = np.repeat(np.arange(len(ids)), count)
        lead = np.cumsum(count) - count
        place = np.arange(len(hit)) - lead[kmer]
        begins = hit & ~(np.concatenate(([False], hit[:-1])) & (place > 0))
        ends = hit & ~(np.concatenate((hit[1:], [False])) & (place < count[kmer] - 1))
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        k = kmer[b]
        for c, a in zip(cols, (ids[k], tags[k], first[k] + place[b], first[k] + place[e] + width), strict=True):
            c.append(a)
    out = [np.concatenate(c) if c else np.zeros(0) for c in cols]
    return pa.table({"d": pa.array(out[0].astype(np.int64)), "t": pa.array(out[1].astype(np.int32)), "a": pa.array(out[2].astype(np.int32)), "b": pa.array(out[3].astype(np.int32))})


def repeated_ranges(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, slice_bytes: int = 4 << 20) -> DataFrame:
    """(d, t, a, b): word ranges a..b-1 that repeated windows cover; ``docs`` is id, tag, text without null ids."""
    spark = docs.sparkSession
    names = docs.columns
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(names[2]))).first()[0] or 0
        buckets = max(4 * partitions(spark), -(-size // BUCKET_BYTES))

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, names[2], slice_bytes):
                _, _, key, _ = super_kmers(words_of(*text_bytes(b.column(2))), width, np.zeros(0, np.uint64))
                value, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], ["key", "n"])

    # At most ``buckets`` keys can each hold more than a bucket's share of the sample.
    sample = docs.where(F.pmod(F.xxhash64(F.col(names[0])), F.lit(16)) == 0)
    counts = sample.mapInArrow(minimisers, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    share = counts.agg(F.sum("n").alias("all")).withColumn("least", F.greatest(F.lit(64), F.col("all") / F.lit(buckets)))
    hot = np.sort(np.array([r["key"] for r in counts.join(F.broadcast(share), F.col("n") > F.col("least")).select("key").collect()], np.int64).astype(np.uint64))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            for b in text_slices(batch, names[2], slice_bytes):
                rows = list(_shipped(b, width, buckets, hot, met))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    return docs.mapInArrow(ship, "bucket int, blob binary").groupBy("bucket").applyInArrow(lambda t: _judge(t, width), "d long, t int, a int, b int")


def numbered(docs: DataFrame, id_col: str, text_col: str, tag: str) -> DataFrame:
    """``docs`` with ``tag``: 0, or a number from 1 on where the rows of one id have different texts."""
    i, h = spare(docs, "i"), spare(docs, "h")
    named = docs.withColumns({i: F.col(id_col).cast("long"), h: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    texts = named.where(F.col(i).isNotNull()).select(F.col(i).alias("i"), F.col(h).alias("h")).distinct()
    many = texts.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i")
    tags = written(texts.join(many, "i", "left_semi").withColumn("t", F.row_number().over(Window.partitionBy("i").orderBy("h"))), "tags")
    if not tags.limit(1).count():
        return docs.withColumn(tag, F.lit(0))
    tags = tags.select(*[F.col(c).alias(f"__{tag}{c}") for c in ("i", "h", "t")])
    joined = named.join(tags, (F.col(i) == F.col(f"__{tag}i")) & (F.col(h) == F.col(f"__{tag}h")), "left")
    return joined.select(*docs.columns, F.coalesce(F.col(f"__{tag}t"), F.lit(0)).alias(tag))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and, with ``keep_text``, kept_text (kept words joined by one space)."""
    tag, packed = spare(docs, "tag"), spare(docs, "packed")
    tagged = numbered(docs, id_col, text_col, tag)
    ranges = repeated_ranges(tagged.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.col(tag).alias("t"), F.col(text_col).alias("x")), width)
    others = [c for c in docs.columns if c != text_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in (s for x in batches for s in text_slices(x, text_col, 1 << 20)):
            small = pa.array([None if t is None else z.compress(t.encode()) for t in b.column(text_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [*others, tag]], small], [*[f"c{i}" for i in range(len(others))], "tag", "packed"])

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"c{i} {types[c]}" for i, c in enumerate(others)], "tag int", "packed binary"])
    small = tagged.select(*others, tag, text_col).mapInArrow(pack, schema)
    gathered = ranges.groupBy("d", "t").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    joined = small.join(gathered, (F.col(f"c{others.index(id_col)}") == F.col("d")) & (F.col("tag") == F.col("t")), "left").drop("d", "t", "tag")
    taken, found = docs, []
    for name in ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text:
        found.append(spare(taken, f"{prefix}{name}"))
        taken = taken.withColumn(found[-1], F.lit(None))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for x in batches for b in text_slices(x, "packed", 1 << 20)):
            n_words, n_removed, digests, texts = [], [], [], []
            z = zstandard.ZstdDecompressor()
            plain = [None if t is None else z.decompress(t) for t in batch.column("packed").to_pylist()]
            column = pa.array(plain, pa.large_binary()).cast(pa.large_string())
            w = words_of(*text_bytes(column))
            cover = np.zeros(len(w.start) + 1, np.int64)
            for name, step in (("a", 1), ("b", -1)):
                lists = batch.column(name)
                at = np.asarray(pc.list_flatten(lists), np.int64) + w.first[np.asarray(pc.list_parent_indices(lists), np.int64)]
                np.add.at(cover, at, step)
            keep = np.cumsum(cover)[:-1] <= 0
            kept_before = np.concatenate(([0], np.cumsum(keep)))[w.first]
            out, at = Words(w.buf, w.start[keep], w.end[keep], kept_before).joined()
            for i, n in enumerate(w.counts):
                lo, hi = kept_before[i], kept_before[i + 1]
                text = out[at[lo] : max(at[hi] - 1, at[lo])].tobytes()
                n_words.append(int(n))
                n_removed.append(int(n - (hi - lo)))
                digests.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    texts.append(None if plain[i] is None else text.decode())
            cols = [batch.column(f"c{i}") for i in range(len(others))]
            cols += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            cols += [pa.array(plain, pa.binary()).cast(pa.string())]
            if keep_text:
                cols.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*[f"c{i}" for i in range(len(others))], "f0", "f1", "f2", "original", *["f3"] * keep_text])

    schema = ", ".join([*[f"c{i} {types[c]}" for i, c in enumerate(others)], "f0 long, f1 long, f2 string, original string", *["f3 string"] * keep_text])
    done = joined.mapInArrow(finish, schema)
    place = {c: f"c{i}" for i, c in enumerate(others)} | {text_col: "original"}
    return done.select(*[F.col(place[c]).alias(c) for c in docs.columns], *[F.col(f"f{k}").alias(name) for k, name in enumerate(found)])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, keep_text=False).drop("text")


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS g
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
hit AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT rid, i + k AS i FROM hit, range(0, 13) AS r(k)),
word AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
