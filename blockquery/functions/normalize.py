"""The closed set of normalizers, as columns and as plain Python with the same results."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

# White space as string trimming elsewhere knows it, U+FEFF included and U+0085 not.
_SPACE = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_TRIM = f"^{_SPACE}+|{_SPACE}+$"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_BASES = {"0x": 16, "0o": 8, "0b": 2}


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def numeric(c: Column) -> Column:
    """A finite number, or null: decimal and exponent forms, and unsigned 0x, 0o and 0b integers up to 2**63."""
    t = trimmed(c.cast("string"))
    decimal = F.when(t.rlike(_DECIMAL), t).try_cast("double")
    based = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10)).when(t.rlike("^0[oO][0-7]{1,20}$"), F.conv(F.substring(t, 3, 20), 8, 10)).when(t.rlike("^0[bB][01]{1,62}$"), F.conv(F.substring(t, 3, 62), 2, 10)).try_cast("double")
    found = F.coalesce(decimal, based)
    return F.when(F.abs(found) < F.lit(float("inf")), found)


def lowercase(c: Column) -> Column:
    return F.lower(c)


def trim(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def _fold(s: str) -> str:
    bare = "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.category(ch).startswith("M"))
    return unicodedata.normalize("NFC", bare).lower()


def _fold_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(_fold, na_action="ignore")


def _fold_udf(c: Column) -> Column:
    return F.pandas_udf(_fold_series, T.StringType())(c)


def _fold_list_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda own: [_fold(x) for x in own if x is not None], na_action="ignore")


def _fold_list_udf(c: Column) -> Column:
    """Every element folded; null elements are left out."""
    return F.pandas_udf(_fold_list_series, T.ArrayType(T.StringType()))(c)


def fold(c: Column) -> Column:
    """Without accents and in lower case. Plain ASCII, by far the most, never leaves the JVM's functions for its result."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(_fold_udf(c))


COLUMNS = {"numeric": numeric, "lowercase": lowercase, "trim": trim, "fold": fold}


def _numeric(v: Any) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v) if math.isfinite(v) else None
    if not isinstance(v, str):
        return None
    t = re.sub(_TRIM, "", v)
    if re.fullmatch(_DECIMAL[1:-1], t):
        x = float(t)
        return x if math.isfinite(x) else None
    if (base := _BASES.get(t[:2].lower())) and re.fullmatch({16: "[0-9a-fA-F]{1,15}", 8: "[0-7]{1,20}", 2: "[01]{1,62}"}[base], t[2:]):
        return float(int(t[2:], base))
    return None


def normalize(using: str, value: Any) -> Any:
    """What a derived column holds for a value; None where it holds nothing. Lists go by element."""
    if using not in COLUMNS:
        raise EngineError("CONFIG", f"unknown normalizer {using!r}")
    if isinstance(value, (list, tuple)):
        return [x for x in (normalize(using, v) for v in value) if x is not None] or None
    if using == "numeric":
        return _numeric(value)
    if not isinstance(value, str):
        return None
    if using == "lowercase":
        return value.lower()
    return (re.sub(_TRIM, "", value) or None) if using == "trim" else _fold(value)


def content_hash(c: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256."""
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(16))


def trigrams(c: Column) -> Column:
    """All windows of three characters; none of shorter strings."""
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
