"""Chat formatting from reply trees.

Messages form trees by parent id. Iterative self-joins climb from every leaf to its root: each round
doubles the hop, so a chain of n replies takes log2(n) joins. Branches of a tree are ranked by their
mean message score (ties: the smaller leaf id), and each chosen path is formatted as one conversation.

The template marks turns: ``<|turn|>role<|text|>text<|end|>``, one after the other. Control strings
inside roles and texts are broken by a backslash after their first character, and backslashes are
doubled, so the text can be read back exactly and never holds a control string.

Defined results: null roles and texts are empty; ties in turn order go by role, then text; repeated
rows are turns of their own; rows without conversation form a conversation of their own (null id); a
missing score counts as none (branches without any come last, by leaf id); a very long conversation takes
work in proportion to its length (its one formatted text has to fit in a task); an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .quality import bind

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of public chat templates, broken wherever they occur inside a text.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    """Drop each backslash and keep the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, up): every ancestor of every leaf with its distance, the leaf itself at 0.

    ``messages`` has ``id`` and ``parent`` (null at roots; unknown parents count as roots). A message
    that is its own ancestor has no root; such cycles are left out.
    """
    nodes = messages.select("id", "parent")
    parents = nodes.select(F.col("parent").alias("id")).where("id is not null").distinct()
    hops = nodes.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.col("parent").alias("to"))
    hops = written(hops, "hops")
    found = written(
        nodes.join(parents, "id", "left_anti").select(F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("long").alias("up")),
        "paths",
    )
    step = 1
    while hops.limit(1).count():
        more = found.join(hops, found["node"] == hops["id"]).select("leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        found = written(found.unionByName(more), "paths")
        again = hops.alias("a").join(hops.alias("b"), F.col("a.to") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.to").alias("to"))
        hops = written(again.where(F.col("id") != F.col("to")), "hops")
        step *= 2
    return found


def ranked(found: DataFrame, messages: DataFrame, branches: int | None = None) -> DataFrame:
    """``found`` for the chosen leaves, with their ``rank`` in their tree by mean score: the best ``branches`` (None: all of them)."""
    scored = found.join(messages.select(F.col("id").alias("node"), "score"), "node")
    leaves = scored.groupBy("leaf").agg(
        F.avg("score").alias("score"), F.max("up").alias("depth"), F.max_by("node", "up").alias("root")
    )
    best = Window.partitionBy("root").orderBy(F.col("score").desc_nulls_last(), F.col("leaf"))
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    return found.join(leaves.select("leaf", "root", "depth", "rank"), "leaf")


def formatted(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: root, leaf, rank, ``formatted`` and ``loss``, the mask of assistant texts.

    A span of the mask has its code points (``start``, ``end``) in the whole, and its ``turn`` (0 first) and the ``offset`` in
    what stands after that turn's mark, so that it can be read without counting from the start. ``messages``: id, parent,
    role, text, score.
    """
    chosen = ranked(paths(messages), messages, branches)
    turns = messages.select(
        F.col("id").alias("node"),
        F.concat(F.lit(TURN), escaped(F.coalesce("role", F.lit(""))), F.lit(TEXT)).alias("head"),
        escaped(F.coalesce("text", F.lit(""))).alias("body"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("learn"),
    )
    size = F.length("head") + F.length("body") + F.lit(len(END))
    before = Window.partitionBy("root", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    at = chosen.join(turns, "node").withColumn("at", F.col("depth") - F.col("up"))
    at = at.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long")) + F.length("head"))
    turn = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), "start", (F.col("start") + F.length("body")).alias("end"), (F.length("head") - len(TURN)).cast("long").alias("offset"), "learn")
    placed = at.groupBy("root", "leaf").agg(F.first("rank").alias("rank"), F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.transform(
        F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["at"].alias("turn"), t["offset"].alias("offset"))
    )
    return placed.select("root", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def masked(text: Column, loss: Column) -> Column:
    """The text under the loss mask of a formatted conversation, unescaped: its turns are split once."""

    def under(parts: Column) -> Column:
        part = lambda s: F.get(parts, (s["turn"] + 1).cast("int"))
        return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(part(s), (s["offset"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")

    return bind(F.split(text, r"<\|turn\|>"), under)


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    return F.transform(
        F.filter(F.split(text, r"<\|turn\|>"), lambda p: p != ""),
        lambda p: F.struct(
            unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def as_replies(rows: DataFrame, conv: str = "conv_id", score: Column | None = None) -> DataFrame:
    """Turn rows as messages: each turn replies to the one before it in its conversation; ``score`` rates a turn.

    Ids number the rows of a conversation by turn, role and text; one conversation's rows are sorted by
    one window, which Spark spills, so a huge conversation needs disk and not memory.
    """
    order = Window.partitionBy(conv).orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = F.row_number().over(order).cast("long")
    return rows.withColumn("n", n).select(
        F.struct(F.col(conv).alias("conv"), F.col("n").alias("n")).alias("id"),
        F.when(F.col("n") > 1, F.struct(F.col(conv).alias("conv"), (F.col("n") - 1).alias("n"))).alias("parent"),
        "role",
        "text",
        (F.lit(None) if score is None else score).cast("double").alias("score"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    probe = spark.sql(
        "SELECT -7L conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    out = formatted(as_replies(rows.unionByName(probe)), branches=1)
    turns = read_back(F.col("formatted"))
    learned = masked(F.col("formatted"), F.col("loss"))
    return (
        out.withColumns({"turns": turns, "learned": learned})
        .select(
            F.col("leaf")["conv"].alias("conv_id"),
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            F.col("rank").cast("long").alias("branch_rank"),
        )
    )


def _sql_escape(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


OP1_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(a, b, c, d)),
a AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
  sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(TURN + TEXT + END)}) AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, 1::BIGINT AS branch_rank FROM a
"""
