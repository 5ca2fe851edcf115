"""URL filters: given host and path rules first, then rules that FP-growth mines from labelled pages.

A URL's items are its words with their place: labels of the host, words of the path, of the query and the fragment. Of the labelled
pages each distinct (id, url) is a transaction, with its label as one more item. Items that occur in exactly the same transactions are
one item for the miner, so long URLs that are repeated do not multiply its item sets; a rule asks for all of them. Rules whose
consequent is the bad label are kept if enough pages support them with enough confidence. A page is bad if a rule's items are all
among its own.

Matching is one join with an inverted index: a mined rule stands under its rarest item alone, a given rule under its host. A page asks
for its items and for the last suffixes of its host (as many as the longest given host has), checks what it meets in place, and
its verdicts are put together by a number of the row. The index is a written table, so Spark broadcasts it if its size allows.

Defined results: a null URL and one without ``://`` have an empty host and path and no items, so no rule fits and they are allowed;
an empty path starts with no rule's path; rows without page id are judged, but teach nothing; repeated rows get equal results; a
page with several labels is bad if one is; labels with nothing but nulls are none; without labelled pages nothing is mined; given rules
of equal length on one URL are ordered by their text (the last wins); very long URLs are judged whole; an empty table gives an empty
table; extra columns pass through, and a new column gets underscores where the table has its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, spare, table, written

BAD, GOOD = "label bad", "label good"
#: A mined rule holds on this many labelled pages and this share of them, and this share of the pages it fits is bad.
LEAST_PAGES, LEAST_SHARE, CONFIDENCE = 4, 0.002, 0.5
#: The given rules as (verdict, host, path).
GIVEN = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Url:
    """The parts of a URL column."""

    url: Column

    @property
    def _rest(self) -> Column:
        return F.when(F.contains(self.url, F.lit("://")), F.substr(self.url, F.locate("://", self.url) + 3)).otherwise("")

    @property
    def host(self) -> Column:
        return _lower(F.regexp_extract(self._rest, r"^[^/?#]*", 0))

    @property
    def path(self) -> Column:
        return F.regexp_extract(self._rest, r"^[^/?#]*([^?#]*)", 1)

    @property
    def tail(self) -> Column:
        return F.regexp_extract(self._rest, r"(?s)^[^?#]*(.*)", 1)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def items(url: Url) -> Column:
    """Distinct words of a URL with their place."""

    def of(place: str, text: Column) -> Column:
        return F.transform(F.filter(F.split(_lower(text), r"[^\p{L}\p{N}-]+"), lambda w: w != ""), lambda w: F.concat(F.lit(place), w))

    return F.array_distinct(F.concat(of("h ", url.host), of("p ", url.path), of("q ", url.tail)))


def labelled(pages: DataFrame, labels: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(t, items, bad): the labelled pages, repeated rows once."""
    worst = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.coalesce("toxic", "quality").isNotNull(), 0))
    known = labels.groupBy(F.col("doc_id").alias("page")).agg(worst.alias("bad")).where("bad IS NOT NULL")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    return rows.join(known, "page").select(F.xxhash64("page", "url").alias("t"), items(Url(F.col("url"))).alias("items"), "bad")


def mined(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, key, support, confidence): the rules for bad pages; ``key`` is the rarest of a rule's items."""
    spark = pages.sparkSession
    learn = written(labelled(pages, labels, id_col, url_col), "labelled")
    n = learn.count()
    least = max(least_pages, int(-(-n * least_share // 1)))
    # The set of transactions of an item, as a sum and an exclusive or of their hashes: equal sets are one item for the miner.
    each = learn.select("t", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("t").alias("x"), F.bit_xor(F.xxhash64("t")).alias("y"))
    classes = written(each.where(F.col("n") >= least).groupBy("n", "x", "y").agg(F.min("token").alias("item"), F.collect_set("token").alias("tokens")).drop("x", "y"), "classes")
    kept = learn.select("t", "bad", F.explode_outer("items").alias("item")).join(classes.select("item"), "item", "left_semi")
    rows = kept.groupBy("t").agg(F.collect_set("item").alias("items"), F.max("bad").alias("bad"))
    rows = rows.select(F.concat("items", F.array(F.when(F.col("bad") == 1, F.lit(BAD)).otherwise(F.lit(GOOD)))).alias("items"))
    rows = written(rows, "transactions")
    n_rows = rows.count()
    kinds = "tokens array<string>, key string, support double, confidence double"
    if not n_rows:
        return spark.createDataFrame([], kinds)
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (least - 0.5) / n_rows)), minConfidence=confidence, numPartitions=partitions(spark)).fit(rows)
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select("antecedent", "support", "confidence")
    parts = rules.select("*", F.explode("antecedent").alias("item")).join(classes, "item")
    return parts.groupBy("antecedent", "support", "confidence").agg(F.array_sort(F.flatten(F.collect_set("tokens"))).alias("tokens"), F.min_by("item", F.struct("n", "item")).alias("key")).select("tokens", "key", "support", "confidence")


def filtered(pages: DataFrame, rules: DataFrame, given: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules`` as ``mined`` gives them; ``given``: verdict, host, path."""
    name = {}
    for c in ("host", "path", "rule", "verdict"):
        name[c] = spare(pages.select("*", *[F.lit(1).alias(x) for x in name.values()]), c)
    row, asked, keys, at = (spare(pages, f"__{c}") for c in ("row", "items", "keys", "at"))
    index = given.select(
        F.concat(F.lit("s "), "host").alias("_key"), F.lit(None).cast("array<string>").alias("_tokens"), F.col("path").alias("_path"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict")
    ).unionByName(rules.select(F.col("key").alias("_key"), F.col("tokens").alias("_tokens"), F.lit(None).cast("string").alias("_path"), F.lit(None).cast("string").alias("_rule"), F.lit("block").alias("_verdict")))
    index = written(index.where("_key IS NOT NULL"), "index")
    most = index.where("_rule IS NOT NULL").agg(F.coalesce(F.max(F.size(F.split("_key", r"\."))), F.lit(0))).first()[0]

    url = Url(F.col(url_col))
    labels = F.slice(F.reverse(F.split(F.col(name["host"]), r"\.")), 1, most) if most else F.array().cast("array<string>")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("s "), F.array_join(F.reverse(F.slice(labels, 1, n)), "."))) if most else labels
    judged = pages.withColumns({name["host"]: url.host, name["path"]: url.path, asked: items(url), row: F.monotonically_increasing_id()})
    wide = judged.withColumn(keys, F.concat(F.col(asked), suffixes))
    each = wide.select(*judged.columns, F.posexplode_outer(keys).alias(at, "_asked"))
    fits = F.coalesce(F.startswith(F.col(name["path"]), F.col("_path")), F.size(F.array_except("_tokens", asked)) == 0, F.lit(False))
    met = each.join(index, F.col("_asked") == F.col("_key"), "left").withColumn("_fits", fits).where(F.col("_fits") | (F.coalesce(F.col(at), F.lit(0)) == 0))
    best = F.max(F.when(F.col("_fits") & F.col("_rule").isNotNull(), F.struct(F.length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))))
    found = F.max(F.col("_fits") & F.col("_rule").isNull())
    rest = [*pages.columns, name["host"], name["path"]]
    put = met.groupBy(row).agg(*[F.first(c).alias(c) for c in rest], best.alias("_best"), found.alias("_found"))
    return put.select(
        *rest, F.col("_best.rule").alias(name["rule"]), F.coalesce(F.col("_best.verdict"), F.when(F.col("_found"), F.lit("block")).otherwise(F.lit("allow"))).alias(name["verdict"])
    )


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    given = spark.createDataFrame(GIVEN, "verdict string, host string, path string")
    rules = mined(pages, table(spark, sf_dir, "labels"))
    return filtered(pages, rules, given).select("page_id", "host", "path", "rule", "verdict")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEMS = "list_transform(regexp_extract_all(" + _LOWER + ", '[\\p{{L}}\\p{{N}}-]+'), lambda w: '{} ' || w)"
OP12_SQL = f"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
b AS (SELECT *, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*(.*)', 1) AS tail FROM a),
p AS (SELECT rid, page_id, url, host, path, list_distinct(list_concat({_ITEMS.format('host', 'h')}, {_ITEMS.format('path', 'p')}, {_ITEMS.format('tail', 'q')})) AS items FROM b),
lab AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN coalesce(toxic, quality) IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
tr AS (SELECT row_number() OVER () AS t, * FROM (SELECT DISTINCT page_id, url, items, bad FROM p JOIN lab ON page_id = doc_id WHERE bad IS NOT NULL AND url IS NOT NULL)),
lim AS (SELECT greatest({LEAST_PAGES}, ceil(count(*) * {LEAST_SHARE}::DOUBLE)) AS least FROM tr),
it AS (SELECT token, count(*) AS n, string_agg(t, ',' ORDER BY t) AS sig FROM (SELECT t, unnest(items) AS token FROM tr) GROUP BY token HAVING count(*) >= (SELECT least FROM lim)),
cl AS (SELECT min(token) AS item, list(token) AS tokens FROM it GROUP BY sig),
k AS (SELECT t, bad, list(item ORDER BY item) AS items FROM (SELECT t, bad, unnest(items) AS item FROM tr) JOIN cl USING (item) GROUP BY t, bad),
sub AS (SELECT bad, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT *, unnest(range(1, (1::BIGINT << len(items)))) AS m FROM k)),
ru AS (SELECT s FROM sub GROUP BY s HAVING sum(bad) >= (SELECT least FROM lim) AND sum(bad) / count(*)::DOUBLE >= {CONFIDENCE}),
rt AS (SELECT r.s, flatten(list(cl.tokens)) AS tokens FROM (SELECT s, unnest(s) AS item FROM ru) r JOIN cl USING (item) GROUP BY r.s),
g AS (SELECT * FROM (VALUES {', '.join(f"('{v}', '{h}', '{q}')" for v, h, q in GIVEN)}) g(verdict, host, path)),
best AS (SELECT p.rid, g.host || g.path AS rule, g.verdict FROM p JOIN g ON (p.host = g.host OR ends_with(p.host, '.' || g.host)) AND starts_with(p.path, g.path)
  QUALIFY row_number() OVER (PARTITION BY p.rid ORDER BY len(g.host || g.path) DESC) = 1),
hit AS (SELECT DISTINCT rid FROM p JOIN rt ON list_has_all(p.items, rt.tokens))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN hit.rid IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN best USING (rid) LEFT JOIN hit USING (rid)
"""
