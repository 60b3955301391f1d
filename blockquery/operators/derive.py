"""Derived columns, by name of a normalizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.normalize import COLUMNS, _fold_list_udf
from ..plans.where import KEYS
from ..schema import CollectionSchema


def derive(df: DataFrame, schema: CollectionSchema) -> DataFrame:
    """df with every derived field. A key of the input is never overwritten; a value that normalizes to nothing leaves the key absent."""
    for f in schema.fields.values():
        if f.derive_from is None:
            continue
        if f.name in df.columns:
            raise EngineError("CONFIG", f"the input already has the derived field {f.name!r}")
        source, using = F.col(f"`{f.derive_from}`"), COLUMNS[f.derive_using]
        if schema.fields[f.derive_from].multi:
            # Python functions do not run inside lambdas: a list is folded by a function of lists
            value = _fold_list_udf(source) if f.derive_using == "fold" else F.filter(F.transform(source, using), lambda x: x.isNotNull())
            value = F.when(F.size(value) > 0, value)
        else:
            value = using(source)
        df = df.withColumn(f.name, value)
        if KEYS in df.columns:
            df = df.withColumn(KEYS, F.when(F.col(f"`{f.name}`").isNotNull(), F.array_append(KEYS, F.lit(f.name))).otherwise(F.col(KEYS)))
    return df
