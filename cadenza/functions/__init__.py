"""Column builders that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def words(c: str | Column) -> Column:
    """The parts between runs of white space."""
    return F.filter(F.split(col(c), f"{SPACE}+"), lambda x: x != "")


def filled(c: str | Column) -> Column:
    """Null where empty."""
    return F.nullif(col(c), F.lit(""))


def r6(c: str | Column) -> Column:
    """Rounded as results are compared and ranked, free of the order of sums."""
    return F.round(col(c), 6)


def uniform(seed: str, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the seed and keys alone."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(col(k).cast("string") for k in keys)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def doubles(v: str | Column) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: str | Column) -> Column:
    """v over its length; a zero vector stays. v and its length are bound, so that neither is
    worked out anew for each part."""

    def over_length(y: Column) -> Column:
        return F.transform(F.array(norm(y)), lambda n: F.when(n > 0, F.transform(y, lambda x: x / n)).otherwise(y))[0]

    return F.transform(F.array(col(v)), over_length)[0]


def fitted(v: str | Column, size: int) -> Column:
    """v cut to size, or filled up with zeros."""
    return F.slice(F.concat(col(v), F.array_repeat(F.lit(0.0), size)), 1, size)
