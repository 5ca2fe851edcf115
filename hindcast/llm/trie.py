"""Conversation prefix trie with double arrays.

Turns become 128-bit digests of role and text, so a conversation is a row of digests and word counts. Equal conversations
are met first: one of them (the smallest id) goes on, with the number of all. The sequences are dealt to shards by
their first turn; a first turn under which more turns lie than a shard's memory budget is split by the first two turns, then by
four, eight and so on. Each shard numbers its turns densely and packs its trie into two arrays: the child of state s by turn t
is slot ``BASE[s] + t``, if ``CHECK`` of that slot is s. Walking the sequences through the arrays gives the nodes; counts go
up from the deepest level. Nodes above the split points occur in several shards: their parts are added globally, and what
the upper nodes add themselves (their own leaves and savings) goes up along their paths, which are short unless very many
different conversations share a long beginning.

The digest of the ids that end at a node reads them in order, once: SHA-256 cannot be split. Ids are sorted by Spark, which
spills, and streamed, so a node where a third of all conversations end takes time and no memory.

Defined results: null roles and texts are empty; rows without conversation id are left out; turns go by number (null first),
then by role, the first 64 characters of the text and its digest; repeated rows are turns of their own; a conversation is one
row of digests, so a very long one takes 20 bytes a turn; an empty table gives no nodes, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written
from .prefixes import budget_of, group_of, grouped

#: Turns that a shard packs at once.
SHARD_TURNS = 500_000
FREE = -1
NOBODY = hashlib.sha256(b"").hexdigest()


def digest_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def sequences(rows: DataFrame) -> DataFrame:
    """(conv, turns): the turns of each conversation in order, as structs of digest and words. ``rows``: conv, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = rows.where("conv IS NOT NULL").select(
        "conv",
        F.struct(
            "turn", role.alias("role"), F.left(text, F.lit(64)).alias("head"), digest_of(F.concat(F.length(role), F.lit(":"), role, text)).alias("digest"),
            F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"),
        ).alias("turn"),
    )
    ordered = F.sort_array(F.collect_list("turn"))
    return light.groupBy("conv").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``own`` with the first h turns taken from the conversation at the last multiple of ``every``; h = crc32(id) % ``most``."""
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    first = own.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    joined = own.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % every}).join(first, "base", "left")
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return joined.select("conv", F.when(F.col("first").isNull(), rest).otherwise(F.concat(F.expr("slice(first, 1, h)"), rest)).alias("turns"))


def copies(named: DataFrame) -> DataFrame:
    """(key, n, least, ends): for each key its number of conversations, the smallest, and the digest of all of them in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, least, digest = None, 0, 0, None
        for batch in batches:
            out: list[tuple] = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, n, least, digest.hexdigest()))
                    key, n, least, digest = k, 1, c, hashlib.sha256(b"%d" % c)
                else:
                    n += 1
                    digest.update(b",%d" % c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip((key, n, least, digest.hexdigest()), kinds, strict=True)], names)

    names, kinds = ["key", "n", "least", "ends"], [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    return named.select("key", "conv").repartition("key").sortWithinPartitions("key", "conv").mapInArrow(read, "key binary, n long, least long, ends string")


class DoubleArray:
    """A trie in two arrays: the child of state ``s`` by symbol ``c`` is ``base[s] + c``, where ``check`` is ``s``."""

    TRIES = 1 << 20

    def __init__(self) -> None:
        self.base = np.zeros(1, np.int64)
        self.check = np.zeros(1, np.int64)  # the root is its own parent
        self.free = np.zeros(0, np.int64)  # slots that may be free

    def _grow(self, size: int, used: np.ndarray) -> None:
        top = len(self.check)
        if size > top:
            self.base = np.concatenate((self.base, np.zeros(size - top, np.int64)))
            self.check = np.concatenate((self.check, np.full(size - top, FREE, np.int64)))
            self.free = np.concatenate((self.free, np.setdiff1d(np.arange(top, size), used)))

    def _take(self, n: int) -> np.ndarray:
        got = [self.free[:0]]
        while n and len(self.free):
            part, self.free = self.free[:n], self.free[n:]
            part = part[self.check[part] == FREE]
            got.append(part)
            n -= len(part)
        new = np.arange(len(self.check), len(self.check) + n)
        self._grow(len(self.check) + n, new)
        return np.concatenate((*got, new))

    def add(self, parent: np.ndarray, symbol: np.ndarray) -> None:
        """Pack the children of states that have none yet; pairs are distinct and sorted."""
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)
        number = np.diff(np.append(first, len(parent)))
        for a, n in zip(first[number > 1].tolist(), number[number > 1].tolist(), strict=True):
            c, top = symbol[a : a + n], len(self.check)
            tried = self.free[: max(1, min(4096, self.TRIES // n))]
            at = tried[:, None] - c[0] + c
            fits = np.flatnonzero(((at >= top) | (self.check[np.minimum(at, top - 1)] == FREE)).all(axis=1))
            base = (int(tried[fits[0]]) if len(fits) else top) - int(c[0])
            self._grow(base + int(c[-1]) + 1, base + c)
            self.base[parent[a]] = base
            self.check[base + c] = parent[a]
        alone = first[number == 1]
        slot = self._take(len(alone))
        self.base[parent[alone]] = slot - symbol[alone]
        self.check[slot] = parent[alone]

    def child(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        to = self.base[state] + symbol
        assert (self.check[to] == state).all()
        return to


def dense(digests: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A number from 0 for each of the distinct digests (two words each), in the order of their first depth."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (digests[order[1:]] != digests[order[:-1]]).any(axis=1)
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    level = np.argsort(depth, kind="stable")
    _, first = np.unique(same[level], return_index=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[same]


SHARD = pa.schema([
    ("key", pa.binary()), ("parent_key", pa.binary()), ("path", pa.list_(pa.binary())), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("words", pa.int64()),
])


def shard(t: pa.Table) -> pa.Table:
    """All nodes of a group of sequences (depth, conv, n, ends, digests, words). Nodes above ``depth`` have a key and hold a part."""
    t = t.combine_chunks().sort_by([("size", "descending")])
    lists = t.column("digests").combine_chunks()
    size = np.asarray(pc.list_value_length(lists), np.int64)
    flat = pc.list_flatten(lists)
    raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: 16 * (flat.offset + len(flat))][16 * flat.offset :] if len(flat) else np.zeros(0, np.uint8)
    digests = raw.view(np.uint64).reshape(-1, 2)
    words = np.asarray(pc.list_flatten(t.column("words").combine_chunks()), np.int64)
    start = np.cumsum(size) - size
    at_depth = np.arange(len(words)) - np.repeat(start, size)
    ids = dense(digests, at_depth) if len(words) else at_depth
    conv, n, split = (np.asarray(t.column(c), np.int64) for c in ("conv", "n", "depth"))

    trie, state, levels = DoubleArray(), np.zeros(len(size), np.int64), []
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # sequences longer than d
    for d, m in enumerate(active.tolist()):
        symbol = ids[start[:m] + d]
        pair, one = np.unique(state[:m] * (len(words) + 1) + symbol, return_index=True)
        parent = pair // (len(words) + 1)
        trie.add(parent, pair % (len(words) + 1))
        state[:m] = trie.child(state[:m], symbol)
        levels.append((state[one], parent, one, d))

    top = len(trie.check)
    low, convs, kids, leaves, saved, word, depth, shared, ends = (np.zeros(top, np.int64) for _ in range(9))
    low += np.iinfo(np.int64).max
    ends -= 1
    state[:] = 0
    shared[0], low[0], convs[0] = 1, conv.min(), n.sum()
    for d, m in enumerate(active.tolist()):
        state[:m] = trie.child(state[:m], ids[start[:m] + d])
        np.minimum.at(low, state[:m], conv[:m])
        np.add.at(convs, state[:m], n[:m])
    ends[state] = np.arange(len(size))
    for slot, parent, one, d in levels:
        word[slot], depth[slot], shared[slot] = words[start[one] + d], d + 1, d + 1 < split[one]
        np.add.at(kids, parent, 1 - shared[slot])
    for slot, parent, _, _ in reversed(levels):
        own = shared[slot] == 0
        leaves[slot] += own & (kids[slot] == 0)
        saved[slot] += np.where(own, (convs[slot] - 1) * word[slot], 0)
        np.add.at(leaves, parent, leaves[slot])
        np.add.at(saved, parent, saved[slot])

    nodes = np.concatenate([np.zeros(1, np.int64), *[x[0] for x in levels]])
    parents = np.concatenate([np.zeros(1, np.int64), *[x[1] for x in levels]])
    key: dict[int, bytes] = {0: b""}
    path: dict[int, list[bytes]] = {0: []}
    for slot, parent, one, d in levels:
        for i in np.flatnonzero(shared[slot]).tolist():
            s, p, at = int(slot[i]), int(parent[i]), int(start[one[i]] + d)
            key[s] = hashlib.sha256(key[p] + digests[at].tobytes()).digest()[:16]
            path[s] = [*path[p], key[p]]
    lower = shared[nodes] == 0
    own_parent = lower & (shared[parents] == 0)
    some = lambda x, ok: pa.array(x, mask=~ok)
    columns = [
        pa.array([key.get(s) for s in nodes.tolist()], pa.binary()),
        pa.array([None if i == 0 else key.get(p) for i, p in enumerate(parents.tolist())], pa.binary()),
        pa.array([path.get(s) for s in nodes.tolist()], pa.list_(pa.binary())),
        pa.array(low[nodes]), pa.array(depth[nodes]), some(low[parents], own_parent), pa.array(convs[nodes]), pa.array(kids[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]),
        t.column("ends").combine_chunks().take(some(ends[nodes], ends[nodes] >= 0)), pa.array(word[nodes]),
    ]
    return pa.Table.from_arrays(columns, schema=SHARD)


def dealt(unique: DataFrame, shard_turns: int) -> DataFrame:
    """``unique`` with ``depth``, above which nodes are shared by groups, and its ``group``."""
    spark = unique.sparkSession
    weight = F.col("size") + 1
    size = unique.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("longest")).first()
    budget = budget_of(spark, int(size["n"]), shard_turns)
    hashed = lambda d: F.xxhash64(F.slice("digests", 1, d))
    out, d, weights, tables = unique.withColumns({"depth": F.lit(1), "p": hashed(1)}), 1, None, []
    while True:
        met = written(out.where(F.col("depth") == d).groupBy("p").agg(F.sum(weight).alias("n"), F.count(F.lit(1)).alias("rows")), "prefixes")
        tables.append(met)
        over = (F.col("n") > budget) & (F.col("rows") > 1) & F.lit(d < size["longest"])
        rest = met.where(~over).select("p", "n")
        weights = rest if weights is None else weights.unionByName(rest)
        if not met.where(over).limit(1).count():
            break
        hot = F.col("hot").isNotNull() & (F.col("depth") == d)  # read from a small table: Spark broadcasts it, or splits the skew
        out = out.join(met.where(over).select("p", F.lit(True).alias("hot")), "p", "left").withColumns(
            {"p": F.when(hot, hashed(2 * d)).otherwise(F.col("p")), "depth": F.when(hot, 2 * d).otherwise(F.col("depth"))}
        ).drop("hot")
        d *= 2
    shift, starts = grouped(weights, budget, max(int(size["n"]), 1))

    @F.pandas_udf("int")
    def group(p: pd.Series) -> pd.Series:
        return pd.Series(group_of(p.to_numpy(np.int64).view(np.uint64), shift, starts).astype(np.int32))

    out = written(out.withColumn("group", group("p")).drop("p"), "dealt")
    dropped(*tables)
    return out


def merged(parts: DataFrame) -> DataFrame:
    """One row a node: nodes of a single shard as they are, shared ones added up and completed from below."""
    shared = parts.where("key IS NOT NULL")
    upper = shared.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("depth", "words", "ends_sha256", "parent_key")], *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.first("path").alias("path")
    )
    children = upper.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    upper = written(upper.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"), "upper")
    own = upper.select(
        F.explode(F.concat("path", F.array("key"))).alias("key"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    own = own.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    names = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("upper_conv"))
    whole = upper.join(own, "key").withColumns({"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("saved")})
    columns = ["conv_id", "depth", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = parts.where("key IS NULL").select(*columns).unionByName(whole.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    known = rows.where("parent_key IS NULL").drop("parent_key")
    asked = rows.where("parent_key IS NOT NULL").join(names, "parent_key").withColumn("parent_conv_id", F.col("upper_conv")).drop("parent_key", "upper_conv")
    return known.unionByName(asked).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))


def prefix_nodes(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each distinct beginning of the conversations in ``convs`` (conv, turns as ``sequences`` gives them)."""
    named = written(convs.withColumn("key", digest_of(F.concat_ws("", F.transform("turns", lambda t: F.hex(t["digest"]))))), "conversations")
    met = written(copies(named), "copies")
    unique = named.drop("key").join(met.drop("key").withColumnRenamed("least", "conv"), "conv").select(
        "conv", "n", "ends", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"), F.size("turns").alias("size")
    )
    unique = written(unique, "unique")
    groups = dealt(unique, shard_turns)
    schema = (
        "key binary, parent_key binary, path array<binary>, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long"
    )
    parts = written(groups.groupBy("group").applyInArrow(shard, schema), "nodes")
    dropped(named, met, unique, groups)
    return merged(parts)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv", "cast(turn as long) turn", "role", "text")
    return prefix_nodes(rebuilt(sequences(rows)))


OP11_SQL = """
WITH t AS (SELECT conv_id::BIGINT AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'k': sha256(len(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))}
  ORDER BY turn NULLS FIRST, role, text[1:64], sha256(len(role) || ':' || role || text)) AS s FROM t GROUP BY c),
hc AS (SELECT c, s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ord((c::VARCHAR)[i])::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS h FROM own),
r AS (SELECT hc.c, list_concat(coalesce(b.s, [])[1:hc.h], hc.s[hc.h+1:]) AS s FROM hc LEFT JOIN own b ON b.c = hc.c - hc.c % 20),
m AS (SELECT c, len(s) AS size, d, list_transform(s[1:d], lambda x: x.k) AS p, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, coalesce(string_agg(CASE WHEN size = d THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM m GROUP BY p, d),
k AS (SELECT p[1:d-1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
sub AS (SELECT a.p, sum((b.n_children = 0)::BIGINT) AS n_leaves, sum((b.n_convs - 1) * b.w) AS saved
  FROM x b, range(0, 4000) AS r(i), x a WHERE i <= b.d AND a.d = i AND a.p = b.p[1:i] GROUP BY a.p)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN sub USING (p) LEFT JOIN x u ON x.d > 0 AND u.p = x.p[1:x.d-1]
"""
