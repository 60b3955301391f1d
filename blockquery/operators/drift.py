"""Data against the fixed schema, in one aggregate: missing keys, nulls and values of another kind, all reported at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DriftError
from ..plans.where import KEYS
from ..schema import CollectionSchema

#: Characters of a record that a report shows.
LONGEST = 500


def _faults(df: DataFrame, schema: CollectionSchema) -> dict[tuple[str, str], Column]:
    out: dict[tuple[str, str], Column] = {}
    for f in schema.fields.values():
        if f.derive_from is not None:
            continue
        c, keys = F.col(f"`{f.name}`"), KEYS in df.columns
        present = F.array_contains(F.col(KEYS), f.name) if keys else F.lit(True)
        wrong = F.array_contains(F.col("_bad"), f.name) if "_bad" in df.columns else F.lit(False)
        if not f.absent:
            out[f.name, "missing"] = ~present
        if not f.nullable:
            out[f.name, "null"] = present & c.isNull() & ~wrong
        out[f.name, "kind"] = wrong
    return out


def drift_report(df: DataFrame, schema: CollectionSchema) -> list[dict]:
    """A row for each field and fault that occurs, in the order of the schema: how many records have it, and the least of these as JSON with the value at fault (null where there is none)."""
    faults = _faults(df, schema)
    if not faults:
        return []
    line = F.col("_line") if "_line" in df.columns else F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in (KEYS, "_bad"))))
    value = lambda name: F.get_json_object(line, "$['" + name.replace("'", "\\'") + "']") if "_line" in df.columns else F.col(f"`{name}`").cast("string")
    # a minimum is kept of records at fault only: clean data cost a null
    aggs = [x for i, ((name, _), c) in enumerate(faults.items()) for x in (F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"n{i}"), F.min(F.when(c, F.struct(F.substring(line, 1, LONGEST).alias("record"), F.substring(value(name), 1, LONGEST).alias("value")))).alias(f"first{i}"))]
    row = df.agg(*aggs).first()
    return [{"field": name, "fault": fault, "records": row[f"n{i}"], "record": row[f"first{i}"]["record"], "value": row[f"first{i}"]["value"]} for i, (name, fault) in enumerate(faults) if row[f"n{i}"]]


_FIX = {"missing": "the key is missing; declare the field absent", "null": "the value is null; declare the field nullable", "kind": "the value is of another kind; correct the data or infer the schema again"}


def check_drift(df: DataFrame, schema: CollectionSchema) -> None:
    """All faults in one error. Its message names fields and numbers of records; the report has a record of each, which a log need not hold."""
    report = drift_report(df, schema)
    if report:
        lines = [f"{_FIX[fault]}: " + ", ".join(f"{r['field']} ({r['records']} records)" for r in report if r["fault"] == fault) for fault in _FIX if any(r["fault"] == fault for r in report)]
        raise DriftError("the data do not fit the schema. " + "; ".join(lines), report)
