"""Expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *parts: Column) -> Column:
    """A reproducible random order: hexadecimal digest of the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def draw_index(seed: int, draw: Column, place: Column, size: Column) -> Column:
    """Place that a bootstrap draw takes: the digest's first 32 bits modulo the size."""
    word = F.conv(F.substring(draw_key(seed, draw, place), 1, 8), 16, 10).cast("long")
    return F.pmod(word, size)


def t_statistic(delta: Column, se: Column, cap: float = 1e9) -> Column:
    """delta / se; 0 where both are 0, the signed cap where only the error is."""
    return F.when(se != 0, delta / se).when(delta == 0, F.lit(0.0)).otherwise(F.signum(delta) * F.lit(cap))


def text_hash64(text: Column) -> Column:
    """64-bit difference hash: 72 characters at equal steps are a 9 by 8 grid, a bit says whether the next one is larger."""
    place = lambda k, more: F.floor((9 * F.floor(k / 8) + k % 8 + more) * F.length(text) / 72).cast("int") + 1
    code = lambda k, more: F.ascii(F.substr(text, place(k, more), F.lit(1)))
    step = lambda a, k: F.shiftleft(a, 1).bitwiseOR(F.when(code(k, 1) > code(k, 0), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), step)


def framed(*columns: str) -> Column:
    """One text of several columns that tells every two rows apart: each value after its length, a null as ``~``."""
    return F.concat(*[F.when(F.col(c).isNull(), "~").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns])
