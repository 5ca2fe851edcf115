"""Format-preserving pseudonyms for personal data, in Spark expressions only.

One regular expression finds candidates; each kind is validated (Luhn, mod-97, octets, calendar) and
then permuted by a keyed Feistel network within its own format: a card stays a Luhn-valid card of the
same length and separators, a date stays a date in the same notation, an address stays an address. A
permutation maps equal values to equal pseudonyms in every document and different values to different
ones, so records stay linked. Candidates that fail validation are left as they are.

The network is additive: steps a = (a + F(b)) mod A and b = (b + F(a)) mod B in turn, so it permutes
the pairs (a, b) for any two moduli, and whole value ranges split into A x B need no cycle walking.
F is SHA-256 of key, kind, step and the other half.

Left in clear, as nothing validates them: ten digits without separators, slashed or dotted dates with the month first, IPv6
addresses, names, and postal addresses.

Mail addresses have no numeric format: their local part becomes a keyed 16-letter name at example.org.

Every repeat in a pattern is bounded (a local part has at most 64 characters, a host at most 127 labels of
at most 63), so a match takes bounded work and stack wherever it starts, and a very long text takes time
in proportion to its length.

Defined results: null text stays null and an empty one empty; repeated rows get equal results; a very long
text is searched whole; empty tables stay empty; extra columns pass through (``pii`` gets an underscore
where the table has it). Dates of the years 0001 to 9999 are moved, those of 1800-2199 among themselves;
a year 0000 is no date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table
from .quality import bind

STEPS = 8
#: Fixed formats, tried in this order where they start at the same place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9]|\.[0-9])|(?<![0-9])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9]| [0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())
#: Cheap, and found in every text that holds one of FORMATS: texts without it are not searched.
WORTH = "[0-9][0-9()./ -]{5}|@|[A-Z]{2}[0-9]{2} ?[A-Z0-9]"
#: Days from 0001-01-01: those of 1800-2199 (146,097 days = 189 x 773) and all others up to 9999-12-31 (3,505,962 = 642 x 5461).
FIRST_DAY, COMMON_DAY, COMMON_HALVES, OTHER_HALVES = "0001-01-01", 657071, (189, 773), (642, 5461)
#: Areas 001-899 without 666, groups 01-99, serials 0001-9999.
SSN_HALVES = (898 * 99, 9999)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, kind: str) -> Column:
    """The keyed permutation of pairs (a mod mod_a, b mod mod_b), as a struct (a, b)."""

    def noise(half: Column, step: Column) -> Column:
        return F.conv(F.substring(_digest(F.lit(key), F.lit(kind), step, half), 1, 15), 16, 10).cast("long")

    def turn(acc: Column, step: Column) -> Column:
        even = step % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["a"] + F.pmod(noise(acc["b"], step), mod_a), mod_a)).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + F.pmod(noise(acc["a"], step), mod_b), mod_b)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string (2 to 36 digits) permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    pair = feistel(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1), _power(half), _power(rest), key, kind)
    return bind(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, "0"), F.lpad(p["b"].cast("string"), rest, "0")))


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def remasked(original: Column, digits: Column) -> Column:
    """``original`` with its digits replaced in turn by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    return F.aggregate(
        F.split(original, ""),
        start,
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(digits, acc["i"], F.lit(1))).alias("out"), (acc["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i"))
        ),
        lambda acc: acc["out"],
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counted once."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def card(s: Column, key: str) -> Column:
    """First digit kept, the middle permuted, the check digit computed anew; null where the Luhn sum fails."""

    def new(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return bind(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return bind(_only_digits(s), lambda d: F.when(luhn_sum(d) % 10 == 0, remasked(s, new(d))))


def phone(s: Column, key: str) -> Column:
    """Up to the last ten digits permuted; a longer number's first digits (the country) stay."""

    def new(d: Column) -> Column:
        tail = F.least(F.length(d), F.lit(10))
        return F.concat(F.substr(d, F.lit(1), F.length(d) - tail), permuted_digits(F.substr(d, F.length(d) - tail + 1), key, "phone"))

    return bind(_only_digits(s), lambda d: F.when(F.length(d).between(7, 15), remasked(s, new(d))))


def address(s: Column, key: str) -> Column:
    """An IPv4 address permuted among all of them; null where an octet is over 255."""
    octet = lambda o, k: F.get(o, F.lit(k)).cast("int")

    def new(o: Column) -> Column:
        pair = feistel(octet(o, 0) * 256 + octet(o, 1), octet(o, 2) * 256 + octet(o, 3), F.lit(65536), F.lit(65536), key, "ip")
        return bind(pair, lambda p: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(p[h] / 256), p[h] % 256)]))

    return bind(F.split(s, r"\."), lambda o: F.when(~F.exists(o, lambda x: x.cast("int") > 255), new(o)))


def ssn(s: Column, key: str) -> Column:
    n = lambda at, size: F.substring(s, at, size).cast("int")
    area, group, serial = n(1, 3), n(5, 2), n(8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))) * 99 + (group - 1)
    pair = feistel(index, serial - 1, F.lit(SSN_HALVES[0]), F.lit(SSN_HALVES[1]), key, "ssn")

    def shown(p: Column) -> Column:
        i = F.floor(p["a"] / 99)
        a = i + F.when(i >= 665, F.lit(2)).otherwise(F.lit(1))
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return F.when(valid, bind(pair, shown))


def date(s: Column, key: str) -> Column:
    """A valid date permuted in its notation (year first, or day first): of 1800-2199 among these years, others among the others."""
    iso = F.when(s.rlike("^[0-9]{4}-"), s).otherwise(F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2)))
    day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
    many = COMMON_HALVES[0] * COMMON_HALVES[1]

    def moved(d: Column, halves: tuple[int, int]) -> Column:
        a, b = halves
        return bind(feistel(F.floor(d / b), d % b, F.lit(a), F.lit(b), key, "date"), lambda p: p["a"] * b + p["b"])

    def place(d: Column) -> Column:
        common = bind(d - COMMON_DAY, lambda x: moved(x, COMMON_HALVES) + COMMON_DAY)
        other = bind(moved(F.when(d < COMMON_DAY, d).otherwise(d - many), OTHER_HALVES), lambda x: F.when(x < COMMON_DAY, x).otherwise(x + many))
        return F.when((d >= COMMON_DAY) & (d < COMMON_DAY + many), common).otherwise(other)

    def shown(m: Column) -> Column:
        return F.when(s.rlike("^[0-9]{4}-"), F.date_format(m, "yyyy-MM-dd")).otherwise(
            F.concat(F.date_format(m, "dd"), F.substring(s, 3, 1), F.date_format(m, "MM"), F.substring(s, 6, 1), F.date_format(m, "yyyy"))
        )

    return bind(day, lambda d: F.when(d >= 0, bind(F.date_add(F.lit(FIRST_DAY).cast("date"), place(d).cast("int")), shown)))


def _mod97(s: Column) -> Column:
    """The remainder by 97 of an account number turned to digits (letters count 10 to 35)."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: bind(value(c), lambda v: (acc * F.when(v < 10, F.lit(10)).otherwise(F.lit(100)) + v) % 97))


def iban(s: Column, key: str) -> Column:
    """The digits after the check digits permuted, the check digits computed anew; groups of four stay apart where they were."""
    grouped = lambda x: F.regexp_replace(x, "(.{4})(?=.)", "$1 ")
    return F.when(F.contains(s, F.lit(" ")), bind(F.replace(s, F.lit(" "), F.lit("")), lambda c: grouped(_iban(c, key)))).otherwise(_iban(s, key))


def _iban(s: Column, key: str) -> Column:
    country, body = F.substring(s, 1, 2), F.substr(s, F.lit(5))

    def new(b: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)

    digits = _only_digits(body)
    # the check digits of valid numbers run from 02 to 98
    valid = (_mod97(F.concat(body, F.substring(s, 1, 4))) == 1) & (F.length(digits) >= 2) & F.substring(s, 3, 2).cast("int").between(2, 98)
    return F.when(valid, bind(remasked(body, permuted_digits(digits, key, "iban")), new))


def email(s: Column, key: str) -> Column:
    name = F.translate(F.substring(_digest(F.lit(key), F.lit("email"), F.lower(s)), 1, 16), "0123456789abcdef", "ghjkmnpqrstvwxyz")
    return F.concat(name, F.lit("@example.org"))


MAKERS = {"email": email, "iban": iban, "date": date, "ssn": ssn, "phone": phone, "ip": address, "card": card}


def replaced(match: Column, key: str) -> Column:
    """(kind, text) of a candidate: its pseudonym, or kind null and itself where it fails validation."""
    made = [
        F.when(match.rlike(f"^(?:{FORMATS[k]})$"), bind(f(match, key), lambda v, k=k: F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("text")))))
        for k, f in MAKERS.items()
    ]
    return F.coalesce(*made, F.struct(F.lit(None).cast("string").alias("kind"), match.alias("text")))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and ``found``: the kinds replaced, in order of place."""
    text, hits = F.col(text_col), spare(docs, "hits")
    worth = text.rlike(WORTH)
    none = F.array().cast("array<string>")
    out = docs.withColumn(hits, F.when(worth, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    out = out.withColumn(hits, F.transform(hits, lambda m: replaced(m, key)))
    some = F.size(hits) > 0
    pieces = F.split(text, ANY, -1)
    new = bind(pieces, lambda p: F.array_join(F.concat(F.transform(F.col(hits), lambda h, i: F.concat(F.get(p, i), h["text"])), F.array(F.element_at(p, -1))), ""))
    return out.withColumns({text_col: F.when(some, new).otherwise(text), spare(docs, found): F.filter(F.transform(hits, lambda h: h["kind"]), lambda k: k.isNotNull())}).drop(hits)


#: The key where the session names none: for tests and demonstrations, as anyone can read it here.
DEMO_KEY = "registered-query-key"
KEY_CONF = "spark.hindcast.pii.key"


def key_of(spark: SparkSession, demo: bool = False) -> str:
    """The session's secret key, ``spark.hindcast.pii.key``; with ``demo`` the key printed here where none is set."""
    key = spark.conf.get(KEY_CONF, DEMO_KEY if demo else "")
    if not key:
        raise ValueError(f"set {KEY_CONF} to a secret key")
    return key


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = lambda kind: F.size(F.filter("pii", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return pseudonymised(docs, key_of(spark, demo=True)).select("doc_id", *[n(k) for k in FORMATS], F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")
