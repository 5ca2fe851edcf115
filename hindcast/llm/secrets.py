"""Secret scan: Aho-Corasick keyword prefilter, anchored regular expressions near hits, checksum validation.

One automaton over all keywords runs over each whole text (ASCII letters folded). Only where a keyword
starts is that kind's pattern tried, anchored there, left to right and without overlaps, which gives
what a leftmost scan of the whole text gives. ``hex`` has no keyword: its class is the pattern itself,
so it is one plain scan. Kinds with an embedded checksum are reported only where it holds.

Spans are code points, end exclusive. Defined results: null text is empty; empty tables give empty
tables; repeated rows are scanned each on its own; a very long text is scanned whole, in time in proportion
to its length, as no run of characters is tried twice by one kind; extra columns pass through
(``secrets`` gets an underscore where the table has it).
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare, table
from .words import text_slices

#: Fixed order of kinds at equal starts. The first three are the base.
KINDS = ("assign", "access", "hex", "github", "pem", "slack", "jwt", "google")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_ok(token: str) -> bool:
    """The last six of a 36-character body are the base-62 CRC-32 of the rest."""
    body, tail = token[4:34], token[34:40]
    crc, digits = binascii.crc32(body.encode()), ""
    for _ in range(6):
        crc, r = divmod(crc, 62)
        digits = BASE62[r] + digits
    return digits == tail


def _jwt_ok(token: str) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        raw = binascii.a2b_base64(head.replace("-", "+").replace("_", "/") + "=" * (-len(head) % 4))
    except binascii.Error:
        return False
    return raw.lstrip().startswith(b"{") and b'"alg"' in raw


#: kind: keywords (folded), pattern tried where one starts, whether it sees the folded text, what a match must pass.
RULES = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)",
        True,
        lambda m: len(m[2]) >= 12,
    ),
    "access": (("akia",), r"AKIA[A-Z0-9]+", False, lambda m: len(m[0]) >= 18),
    "github": (
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
        False,
        lambda m: _crc_ok(m[0]),
    ),
    "pem": (("-----begin",), r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", False, lambda m: True),
    "slack": (("xox",), r"xox[abprs]-[0-9A-Za-z-]{20,}", False, lambda m: True),
    "jwt": (("eyj",), r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", False, lambda m: _jwt_ok(m[0])),
    "google": (("aiza",), r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", False, lambda m: True),
}
#: A kind whose match is refused somewhere in a run of these is refused at every later place of that run.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]*")}
HEX = re.compile(r"[0-9a-f]{16,}")
FOLD = {c: c + 32 for c in range(65, 91)}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, (keywords, _, _, _) in RULES.items():
        for k in keywords:
            a.add_word(k, (kind, len(k)))
    a.make_automaton()
    return a, {k: re.compile(v[1]) for k, v in RULES.items()}


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each secret in ``text``, by start and then kind."""
    if not text:
        return []
    automaton, patterns = _automaton()
    folded = text.translate(FOLD) if not text.isascii() else text.lower()
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in automaton.iter(folded):
        hits.setdefault(kind, []).append(last - size + 1)
    found = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        _, _, on_folded, passes = RULES[kind]
        end, within = 0, folded if on_folded else text
        for start in sorted(starts):
            if start < end:
                continue
            if m := patterns[kind].match(within, start):
                end = m.end()
                if passes(m):
                    found.append((start, kind, end))
            elif kind in RUNS:
                end = RUNS[kind].match(within, start).end()
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", slice_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with ``out``: an array of (kind, start, end). No shuffle; each text is scanned where it is read."""
    out = spare(docs, out)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, text_col, slice_bytes):
                spans = [[{"kind": k, "start": s, "end": e} for s, k, e in scan(t)] for t in b.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], [*b.schema.names, out])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(out, SPANS)]))


def _listed(spans, kinds: tuple[str, ...]):
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("secrets")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[n(k) for k in KINDS[:3]],
        F.sha2(_listed(spans, KINDS[:3]), 256).alias("base_sha256"),
        _listed(spans, KINDS).alias("spans"),
    )


