"""Quality rules as a short-circuit cascade, in Spark expressions only.

A rule is a Column that is true where a document fails. On a bounded sample of the documents, drawn by a
hash of their texts, the cascade measures per rule how many documents it rejects (selectivity) and how long
its expression takes (cost: the rule over REPEATS copies of the sample, less the same job without it, the
least of two runs), orders the rules by rejection per cost, and evaluates them as one CASE expression:
Spark stops at the first rule that fires. The order never changes a verdict, only the work. Where only the
verdict is asked for (``keep_good``), the base rules are rules of the cascade too, so the dear count of
repeated windows is made for those documents alone that nothing cheaper has rejected.

Defined results: null text has no words and fails; empty and blank texts fail; repeated rows are
judged each on its own; a very long text is judged whole, in n log n; an empty table gives an empty table;
extra columns pass through, and a new column gets underscores where the table has its name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table

#: Fixed by the contract: word separators, and the characters that count as symbols.
WORD_GAPS = "\x20\x09\x0a\x0b\x0c\x0d"
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS, REPEATS = 256, 16
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found at least twice in the text, the first included.

    Windows are compared by the 64-bit hash of their words. Texts without a repeat stop at one
    hash-set pass; the others sort (hash, position) once, so a long text costs n log n.
    """
    n = F.size(w)
    hashed = F.transform(w, lambda x: F.xxhash64(x))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), n - F.lit(width))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(width)]))

    def covered(win: Column) -> Column:
        placed = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            F.transform(
                s,
                lambda e, j: F.when(
                    (e["h"] == F.get(s, j + F.lit(1))["h"]) | (e["h"] == F.get(s, j - F.lit(1))["h"]), e["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        at = bind(placed, lambda s: F.array_sort(twice(s)))
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
            lambda acc, i: F.struct(
                (acc["n"] + F.lit(width) - F.greatest(acc["end"] - i, F.lit(0))).alias("n"),
                (i + F.lit(width)).alias("end"),
            ),
            lambda acc: acc["n"],
        )

    def counted(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(covered(win))

    return F.when(n < width + 1, F.lit(0).cast("long")).otherwise(bind(hashed, lambda h: bind(windows(h), counted)))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a let expression)."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: without(x, WORD_GAPS) != "")


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules; each is a share unless it says otherwise."""

    min_words: int = 20
    repeat_percent: int = 30
    symbols_per_word: float = 0.3
    duplicate_lines: float = 0.5
    dominant_case: float = 0.8
    min_word_chars: float = 2.2
    max_word_chars: float = 14.0
    distinct_words: float = 0.08


def names_in(docs: DataFrame, prefix: str = "", more: tuple[str, ...] = ()) -> dict[str, str]:
    """The names that MEASURES and ``more`` get in a table with the columns of ``docs``."""
    return {m: spare(docs, f"{prefix}{m}") for m in (*MEASURES, *more)}


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "", only: tuple[str, ...] = MEASURES) -> DataFrame:
    """Add the counts the rules read (MEASURES, under ``names_in``), or ``only`` some of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name, w, lines = names_in(docs, prefix), spare(docs, "_w"), spare(docs, "_lines")
    counts = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(without(text, WORD_GAPS)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long"),
        "n_repeat_words": repeated_words(F.col(w)),
        "n_lines": F.size(lines).cast("long"),
    }
    out = docs.withColumns({w: words(text), lines: lines_with_words(text)})
    return out.withColumns({name[m]: counts[m] for m in only}).drop(w, lines)


def rules(text: Column, c: Callable[[str], Column], t: Thresholds = Thresholds()) -> dict[str, Column]:
    """The cascade's rules beyond the base; each true where a document fails. They read measures (``c`` by name) and the text."""
    text = F.coalesce(text, F.lit(""))
    return {
        "symbols": c("n_symbols") > t.symbols_per_word * c("n_words"),
        "duplicate_lines": (c("n_lines") >= 4) & (c("n_dup_lines") > t.duplicate_lines * c("n_lines")),
        "word_length": (c("word_chars") < t.min_word_chars * c("n_words"))
        | (c("word_chars") > t.max_word_chars * c("n_words")),
        "shouting": (c("n_words") >= 1)
        & (F.length(F.regexp_replace(text, "[^\\p{Lu}]", "")) > t.dominant_case * c("word_chars")),
        "few_distinct": (c("n_words") >= 50)
        & (F.size(F.array_distinct(words(F.lower(text)))) < t.distinct_words * c("n_words")),
    }


def drawn(docs: DataFrame, rows: int) -> DataFrame:
    """``rows`` rows of ``docs`` (one text column), those of the least hash: the same in every run.

    Only about one row in n / (4 * rows) is ordered, so that what tasks send does not grow with their number. Cached, so
    that no projection comes between the order and the limit.
    """
    text = docs.columns[0]
    one_in = max(1, docs.count() // (4 * rows))
    some = docs.where(F.pmod(F.xxhash64(text, F.lit(9)), F.lit(one_in)) == 0)
    return some.orderBy(F.xxhash64(text)).limit(rows).cache()


def ordered(sample: DataFrame, found: dict[str, Column]) -> list[str]:
    """Rule names by rejection per cost, measured on ``sample`` (bounded rows, cached by the caller)."""
    if not found:
        return []
    rows = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in found.items()]).first()
    many = sample.withColumn(spare(sample, "copy"), F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(rule: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.sum(F.coalesce(rule, F.lit(False)).cast("int"))).first()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds(F.col(spare(sample, "copy")) < 0)
    ratio = {k: ((rows[k] or 0) / max(rows["n"], 1)) / max(seconds(c) - idle, 1e-4) for k, c in found.items()}
    return sorted(found, key=lambda k: (-ratio[k], k))


def verdict(found: dict[str, Column], order: list[str]) -> Column:
    """True where no rule fires; one CASE, so evaluation stops at the first that does."""
    case = None
    for name in order:
        fires = F.coalesce(found[name], F.lit(False))
        case = F.when(fires, F.lit(False)) if case is None else case.when(fires, F.lit(False))
    return F.lit(True) if case is None else case.otherwise(F.lit(True))


def base_rules(c: Callable[[str], Column], repeats: Column, t: Thresholds = Thresholds()) -> dict[str, Column]:
    return {"few_words": c("n_words") < t.min_words, "repeats": F.lit(100) * repeats > F.lit(t.repeat_percent) * c("n_words")}


def judged(docs: DataFrame, text_col: str = "text", t: Thresholds = Thresholds(), sample_rows: int = SAMPLE_ROWS, prefix: str = "") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``. ``sample_rows`` bounds the sample that orders the rules."""
    name = names_in(docs, prefix, ("base_failed", "kept"))
    count = lambda m: F.col(name[m])
    found = rules(F.col(text_col), count, t)
    first = drawn(docs.select(text_col), sample_rows)
    sample = measured(first.select(text_col, *[F.lit(None).alias(c) for c in docs.columns if c != text_col]), text_col, prefix).cache()
    try:
        order = ordered(sample, found)
    finally:
        sample.unpersist()
        first.unpersist()
    base = base_rules(count, count("n_repeat_words"), t)
    failed = F.col(name["base_failed"])
    return measured(docs, text_col, prefix).withColumn(name["base_failed"], base["few_words"] | base["repeats"]).withColumn(
        name["kept"], F.when(failed, F.lit(False)).otherwise(verdict(found, order))
    )


def keep_good(docs: DataFrame, text_col: str = "text", t: Thresholds = Thresholds(), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def cascade(w: Column, c: Callable[[str], Column]) -> dict[str, Column]:
        """All rules; the dear counts stand inside them, so they are made only where the rules before have let a document pass."""
        dear = lambda x: (F.size(x) >= 4) & (F.size(x) - F.size(F.array_distinct(x)) > t.duplicate_lines * F.size(x))
        found = rules(F.col(text_col), c, t)
        found["duplicate_lines"] = bind(lines_with_words(text), dear)
        return found | base_rules(c, repeated_words(w), t)

    cheap = {
        "n_words": lambda w: F.size(w).cast("long"),
        "word_chars": lambda w: F.length(without(text, WORD_GAPS)).cast("long"),
        "n_symbols": lambda w: (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_lines": lambda w: F.lit(0),  # read by the rule that stands above in another form
        "n_dup_lines": lambda w: F.lit(0),
    }
    first = drawn(docs.select(text_col), sample_rows)
    sample = first.withColumn("_w", words(text)).withColumns({k: f(F.col("_w")) for k, f in cheap.items()}).cache()
    try:
        order = ordered(sample, cascade(F.col("_w"), F.col))
    finally:
        sample.unpersist()
        first.unpersist()
    # bound and not columns: a filter is moved below a projection and would count once for each use
    judge = lambda w: bind(F.struct(*[f(w).alias(k) for k, f in cheap.items()]), lambda m: verdict(cascade(w, lambda k: m[k]), order))
    return docs.where(bind(words(text), judge))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_W} AS w FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
win AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY rid),
f AS (SELECT d.rid, doc_id, text, w, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
      len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(lw.n_lines, 0) AS n_lines, coalesce(lw.n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
      len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_distinct,
      len(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper
      FROM d LEFT JOIN lw USING (rid) LEFT JOIN cov USING (rid)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.3::DOUBLE * n_words OR (n_lines >= 4 AND n_dup_lines > 0.5::DOUBLE * n_lines)
    OR word_chars < 2.2::DOUBLE * n_words OR word_chars > 14.0::DOUBLE * n_words
    OR (n_words >= 1 AND n_upper > 0.8::DOUBLE * word_chars)
    OR (n_words >= 50 AND n_distinct < 0.08::DOUBLE * n_words)) AS kept
FROM g
"""
