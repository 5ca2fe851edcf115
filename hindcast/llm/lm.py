"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(hash | class, history) * P(word | class, hash). Both factors
with a history are softmaxes over sums of weights of hashed features: the last word, the last two, the word
before the last (skip), and the last three classes; those of the second are hashed together with the class.
A word counts by one of WITHIN hashes in its class, and among the words of its class and hash it has its
add-one share of the training tokens, one unseen word included. So the model is a distribution over the
vocabulary and one unseen word of each class and hash.

Classes are formed from the training tokens: the last two bytes of words, in the order of the last byte, are
cut into ranges of about equal numbers of tokens, so an unseen word has a class too; the end of a text has
its own, of which it is the only word.

Training is distributed: in each round every task runs minibatch gradient steps over its share of the
training texts and ships the change of the weight rows, in blocks and half precision; a row's changes are
averaged over the tasks that touched it. The weights are tables of fixed size. Changes are added up in the
order of the tasks, so the same input in the same splits gives the same scores, also after a lost executor;
other splits give slightly other weights.

Counts are exact and distributed: texts meet in chunks, a chunk asks for each of its distinct words
once, where a word's rows meet they are added up (one window, no join), and each goes back to its chunk. So what is shuffled follows the vocabulary of chunks and
not the number of tokens. Words are told apart by 64-bit hashes.

Defined results: null text is empty, and an empty text is its end token; a null id is in training;
repeated rows are texts of their own; a very long text is a chunk of its own, whose task's memory is in
proportion to it; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .words import GRAM, mix, text_bytes, text_slices, words_of

CLASSES, WITHIN = 16, 16
#: Weight rows of the two factors; a place takes 16 bits, which sort fast.
ROWS, ROWS_WITHIN = 1 << 15, 1 << 16
FEATURES = 4
END = np.uint64(0x2545F4914F6CDD1D)
#: The last two bytes of a word, the last first; one more for the end of a text.
SUFFIXES = (1 << 16) + 1
BLOCKS = 32
#: Sums of weights are held between -MOST and MOST, so that their powers need no scaling.
MOST = 30.0


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix) of each token, the end of each text included; and where each text's tokens begin."""
    w = words_of(*text_bytes(texts), lower=True)
    last = w.buf[w.end - 1].astype(np.int32)
    before = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(np.int32)
    n_docs, n = len(texts), len(w.start)
    first = w.first + np.arange(n_docs + 1)
    at = np.arange(n) + np.repeat(np.arange(n_docs), w.counts)
    token, suffix = np.full(n + n_docs, END, np.uint64), np.full(n + n_docs, SUFFIXES - 1, np.int32)
    token[at], suffix[at] = w.hashes(), 256 * last + before
    return token, suffix, first


def class_table(mass: np.ndarray) -> np.ndarray:
    """The class of each suffix: ranges of suffixes with about equal ``mass`` (training tokens), and one for the end."""
    mass = mass[:-1].astype(np.float64) + 1e-3
    middle = np.cumsum(mass) - mass / 2
    return np.append((middle * (CLASSES - 1) / mass.sum()).astype(np.int32), np.int32(CLASSES - 1))


def within_of(token: np.ndarray) -> np.ndarray:
    """The hash that a word counts by in its class."""
    return ((token >> np.uint64(40)) % np.uint64(WITHIN)).astype(np.int32)


def features(token: np.ndarray, cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of each token's history for both factors (FEATURES each); histories do not cross texts."""
    n = len(token)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))

    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        if n > k:
            out[k:] = x[:-k]
        out[place < k] = 0
        return out

    w1, w2 = back(token, 1), back(token, 2)
    c = cls.astype(np.uint64) + np.uint64(1)
    classes = (back(c, 1) * np.uint64(CLASSES + 1) + back(c, 2)) * np.uint64(CLASSES + 1) + back(c, 3)
    keys = (w1 * GRAM[40], w1 * GRAM[41] + w2 * GRAM[42], w2 * GRAM[43], classes * GRAM[44])
    hashed = [mix(k + np.uint64(i)) for i, k in enumerate(keys)]
    own = (c * GRAM[45]) >> np.uint64(7)
    place = lambda h, rows: (h % np.uint64(rows)).astype(np.uint16)
    return np.stack([place(h, ROWS) for h in hashed]), np.stack([place(mix(h ^ own), ROWS_WITHIN) for h in hashed])


def probabilities(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax over the columns of ``weights``; its last row is the bias. ``rows``: FEATURES lists of row numbers."""
    z = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0)
    z += weights[-1]
    np.clip(z, -MOST, MOST, out=z)
    np.exp(z, out=z)
    z /= z @ np.ones((z.shape[1], 1), np.float32)
    return z


def row_sums(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ``row`` and the sum of the rows of ``g`` at each; most occur once or twice, and these are only taken."""
    order = np.argsort(row, kind="stable")
    r = np.take(row, order)
    begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    size = np.diff(begin, append=len(r))
    out = np.take(g, np.take(order, begin), axis=0)
    two, more = np.flatnonzero(size == 2), np.flatnonzero(size > 2)
    out[two] += np.take(g, order[begin[two] + 1], axis=0)
    if len(more):
        n = size[more]
        out[more] = np.add.reduceat(np.take(g, order[np.repeat(size > 2, size)], axis=0), np.cumsum(n) - n, axis=0)
    return r[begin].astype(np.intp), out


def descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, cls: np.ndarray, rate: float) -> None:
    """One step on a minibatch: each touched row moves against its summed gradient, scaled by its past size."""
    g = probabilities(weights, rows)
    g[np.arange(len(cls)), cls] -= 1
    for row in rows:
        at, step = row_sums(g, row)
        size = squares[at] + np.einsum("ij,ij->i", step, step) / np.float32(g.shape[1])
        squares[at] = size
        step *= (rate / np.sqrt(size + 1e-3))[:, None]
        weights[at] = np.take(weights, at, axis=0) - step
    step = g.sum(axis=0)
    squares[-1] += (step * step).mean()
    weights[-1] -= rate * step / np.sqrt(squares[-1] + 1e-3)


def _summed(group: pa.Table) -> pa.Table:
    """The sum of a block's changes, in the order of their tasks."""
    group = group.sort_by("task")
    change, touched = (sum(np.frombuffer(b, np.float16).astype(np.float32) for b in group.column(c).to_pylist()) for c in ("change", "touched"))
    one = lambda c: pa.array([group.column(c)[0].as_py()], pa.int32())
    return pa.table({"task": one("part"), "part": pa.array([0], pa.int32()), "block": one("block"), "change": pa.array([change.astype(np.float32).tobytes()], pa.binary()), "touched": pa.array([touched.astype(np.float32).tobytes()], pa.binary())})


def _total(group: pa.Table) -> pa.Table:
    group = group.sort_by("task")
    change, touched = (sum(np.frombuffer(b, np.float32) for b in group.column(c).to_pylist()) for c in ("change", "touched"))
    return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "change": pa.array([change.tobytes()], pa.binary()), "touched": pa.array([touched.tobytes()], pa.binary())})


SHAPES = ((ROWS + 1, CLASSES), (ROWS_WITHIN + 1, WITHIN))
Weights = tuple[np.ndarray, np.ndarray]


def learned(weights: Weights, squares: Weights, token: np.ndarray, cls: np.ndarray, first: np.ndarray, rate: float, batch_tokens: int) -> None:
    """Minibatch steps on both factors over a slice of texts."""
    rows, own = features(token, cls, first)
    within = within_of(token)
    for at in range(0, len(cls), batch_tokens):
        to = slice(at, at + batch_tokens)
        descend(weights[0], squares[0], rows[:, to], cls[to], rate)
        words = np.flatnonzero(cls[to] != CLASSES - 1) + at  # the end is the only word of its class
        if len(words):
            descend(weights[1], squares[1], own[:, words], within[words], rate)


def trained(texts: DataFrame, classes: np.ndarray, rounds: int = 2, rate: float = 0.15, batch_tokens: int = 1 << 14) -> Weights:
    """The weights of both factors, learned from all of ``texts`` (text, part: the round that learns from it)."""
    weights = tuple(np.zeros(s, np.float32) for s in SHAPES)
    spark = texts.sparkSession
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((weights, classes))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, table = sent.value  # noqa: B023
            own, squares = tuple(w.copy() for w in start), tuple(np.zeros(len(w), np.float32) for w in start)
            for batch in batches:
                for b in text_slices(batch, "text", 2 << 20):
                    token, suffix, first = tokens_of(b.column("text"))
                    learned(own, squares, token, table[suffix], first, rate, batch_tokens)
            task = TaskContext.get().partitionId()
            for k, (w, was, size) in enumerate(zip(own, start, squares, strict=True)):
                touched = (size > 0).astype(np.float16)
                if not touched.any():
                    continue
                per = -(-len(w) // BLOCKS)
                cut = range(0, len(w), per)
                change = (w - was).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(cut), pa.int32()), pa.array([task % 64] * len(cut), pa.int32()), pa.array([k * BLOCKS + i for i in range(len(cut))], pa.int32()), pa.array([change[i : i + per].tobytes() for i in cut], pa.binary()), pa.array([touched[i : i + per].tobytes() for i in cut], pa.binary())],
                    ["task", "part", "block", "change", "touched"],
                )

        ddl = "task int, part int, block int, change binary, touched binary"
        sums = texts.where(F.col("part") == r).select("text").mapInArrow(learn, ddl).groupBy("part", "block").applyInArrow(lambda t: _summed(t), ddl)
        weights = tuple(w.copy() for w in weights)
        for row in sums.groupBy("block").applyInArrow(lambda t: _total(t), "block int, change binary, touched binary").collect():
            w = weights[row["block"] // BLOCKS]
            touched = np.frombuffer(row["touched"], np.float32)
            change = np.frombuffer(row["change"], np.float32).reshape(len(touched), w.shape[1])
            at = (row["block"] % BLOCKS) * -(-len(w) // BLOCKS)
            w[at : at + len(touched)] += change / np.maximum(touched, 1)[:, None]
        sent.unpersist()
    return weights


def history_log10(weights: Weights, token: np.ndarray, cls: np.ndarray, first: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """log10 of P(class | history) * P(hash | class, history) of each token."""
    rows, own = features(token, cls, first)
    within, out = within_of(token), np.empty(len(cls))
    for at in range(0, len(cls), step):
        to = slice(at, at + step)
        pick = lambda w, r, k: probabilities(w, r)[np.arange(r.shape[1]), k]
        p = pick(weights[0], rows[:, to], cls[to]).astype(np.float64)
        p *= np.where(cls[to] == CLASSES - 1, 1.0, pick(weights[1], own[:, to], within[to]))
        out[to] = np.log10(np.maximum(p, 1e-30))
    return out


def scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """Per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``held_out`` is a Column."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in (s for x in batches for s in text_slices(x, "text", 1 << 20)):
            small = pa.array([z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("doc_id"), b.column("held"), small], ["chunk", "doc_id", "held", "packed"])

    base = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).mapInArrow(pack, "chunk int, doc_id long, held boolean, packed binary")

    def unpacked(group: pa.Table) -> pa.Array:
        z = zstandard.ZstdDecompressor()
        return pa.array([z.decompress(t) for t in group.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())

    def distinct(group: pa.Table) -> pa.Table:
        token, suffix, first = tokens_of(unpacked(group))
        learn = np.repeat(~np.asarray(group.column("held").combine_chunks().to_numpy(zero_copy_only=False), bool), np.diff(first))
        word, at, inverse = np.unique(token, return_index=True, return_inverse=True)
        c = np.bincount(inverse, weights=learn, minlength=len(word)).astype(np.int64)
        chunk = np.full(len(word), group.column("chunk")[0].as_py(), np.int32)
        return pa.table({"chunk": chunk, "word": word.astype(np.int64), "c": c, "suffix": suffix[at]})

    asked = base.groupBy("chunk").applyInArrow(lambda t: distinct(t), "chunk int, word long, c long, suffix int")
    same = Window.partitionBy("word")  # a row for each chunk that holds the word
    answers = asked.select("chunk", "word", F.sum("c").over(same).alias("c"), "suffix", (F.min("chunk").over(same) == F.col("chunk")).alias("lead"))
    answers = written(answers, "answers")
    counts = answers.where("lead")
    suffixes = np.zeros(SUFFIXES)
    for r in counts.groupBy("suffix").agg(F.sum("c").alias("n")).where("n > 0").collect():  # at most SUFFIXES rows
        suffixes[r["suffix"]] = r["n"]
    classes = class_table(suffixes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.asarray(b.column("c"))
            cell = classes[np.asarray(b.column("suffix"))] * WITHIN + within_of(np.asarray(b.column("word")).astype(np.uint64))
            n, v = (np.bincount(cell, weights=x, minlength=CLASSES * WITHIN).astype(np.int64) for x in (c, c > 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(v)], ["cell", "n", "v"])

    known = counts.select("word", "c", "suffix").mapInArrow(cells, "cell int, n long, v long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    mass = np.ones((CLASSES, WITHIN))
    for r in known:
        mass[divmod(r["cell"], WITHIN)] += r["n"] + r["v"]
    train_tokens = sum(r["n"] for r in known)
    all_mass = train_tokens + sum(r["v"] for r in known) + 1
    weights = trained(docs.where("not held").select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).alias("part")), classes)
    sent = spark.sparkContext.broadcast((weights, mass, classes))

    def score(texts: pa.Table, answer: pa.Table) -> pa.Table:
        weights, mass, table = sent.value
        word = np.asarray(answer.column("word")).astype(np.uint64)
        c = np.asarray(answer.column("c"))
        order = np.argsort(word)
        word, c = word[order], c[order]
        plain = pa.RecordBatch.from_arrays([unpacked(texts)], ["text"])
        parts = []
        for b in text_slices(plain, "text", 1 << 20):
            token, suffix, first = tokens_of(b.column("text"))
            n, cls = c[np.searchsorted(word, token)], table[suffix]
            full = history_log10(weights, token, cls, first) + np.log10((n + 1) / mass[cls, within_of(token)])
            parts.append([np.diff(first), np.add.reduceat((n > 0).astype(np.int64), first[:-1]), np.add.reduceat(np.log10((n + 1) / all_mass), first[:-1]), np.add.reduceat(full, first[:-1])])
        n_tokens, n_known, base_score, model = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held"), "n_tokens": n_tokens.astype(np.int64), "n_known": n_known,
            "train_tokens": np.full(len(n_tokens), train_tokens, np.int64), "base_score": base_score, "score": model,
        })

    return base.groupBy("chunk").cogroup(answers.select("chunk", "word", "c").groupBy("chunk")).applyInArrow(
        lambda a, b: score(a, b), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return scores(table(spark, sf_dir, "documents"), held_out)
