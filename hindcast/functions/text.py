"""Name folding and message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(name: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space; nothing more."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"^ | $", ""))


def rupiah(amount: Column) -> Column:
    """Whole rupiah with dots between groups of three digits."""
    return F.concat(F.lit("Rp"), F.replace(F.format_number(amount, 0), F.lit(","), F.lit(".")))


def template(text: str, values: dict[str, Column]) -> Column:
    """``text`` with each {name} replaced; a name without a value, or a null, shows as <name?>."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            gap = F.lit(f"<{name}?>")
            parts.append(F.coalesce(values[name].cast("string"), gap) if name in values else gap)
    return F.trim(F.regexp_replace(F.concat(*parts), r"\s+", " "))
