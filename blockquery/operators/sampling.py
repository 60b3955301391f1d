"""Samples that are the same in every run and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 0x5EED


def seeded_hash(seed: int, columns: list[Column]) -> Column:
    """53 bits of the MD5 of the seed and the columns as text: the same in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.shiftright(F.conv(F.substring(F.md5(text.cast("binary")), 1, 14), 16, 10).cast("bigint"), 3)


def sample(df: DataFrame, n: int, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """n records, drawn by a hash of the whole record or of the fields `by`: each task keeps its first n, and no record is moved before that.

    Records alike in what is hashed are drawn together or told apart by their other fields; such as are alike in all share a
    place, and any of them may be the last one drawn.
    """
    own = [F.col(f"`{c}`") for c in by] if by else [F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))]
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    return df.orderBy(seeded_hash(seed, own), *rest).limit(n)
