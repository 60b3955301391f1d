"""Fields of a collection, the operators each allows, those that narrow the blocks to read, and the configuration's rules."""

from __future__ import annotations

import keyword
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import EngineError

KINDS = ("string", "number", "date", "boolean", "json")
FORMATS = ("ndjson", "json", "csv", "tsv", "parquet")
COMPRESSIONS = {"none": "uncompressed", "gzip": "gzip", "zstd": "zstd", "snappy": "snappy"}
NORMALIZERS = {"numeric": "number", "lowercase": "string", "trim": "string", "fold": "string"}
FORMAT_VERSION = 0
#: Blocks of 128 MiB suit Spark; a target is compared with the bytes of records as JSON.
BLOCK_BYTES = 128 << 20
MISSING_OPERATORS = ("isNull", "isAbsent", "exists")
LIST_OPERATORS = ("some", "every", "hasEvery", "isEmpty")
RANGES = ("gt", "gte", "lt", "lte")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    indexed: bool = False
    ends_with: bool = False
    contains: bool = False
    absent: bool = False
    nullable: bool = False
    multi: bool = False
    values: tuple[str, ...] | None = None
    values_type: str | None = None
    py_type: str | None = None
    derive_from: str | None = None
    derive_using: str | None = None

    def spark_type(self) -> T.DataType:
        if self.multi:
            return T.ArrayType(T.StringType())
        return {"number": T.DoubleType(), "boolean": T.BooleanType()}.get(self.kind, T.StringType())


@dataclass(frozen=True)
class CollectionSchema:
    sort_field: str
    fields: dict[str, Field] = field(default_factory=dict)
    pk: str | None = None

    def is_sort(self, name: str) -> bool:
        return name == self.sort_field

    def operators(self, name: str) -> tuple[str, ...]:
        return operators_for(self.fields[name], self.is_sort(name))

    def pruning(self, name: str) -> tuple[str, ...]:
        return pruning_for(self.fields[name], self.is_sort(name))

    def describe(self) -> dict[str, Any]:
        """Fields, kinds and operators, for building user interfaces."""
        return {
            "sortField": self.sort_field,
            "pk": self.pk,
            "fields": {n: {"kind": f.kind, "multi": f.multi, "indexed": f.indexed, "nullable": f.nullable, "absent": f.absent, "values": list(f.values) if f.values else None, "operators": list(self.operators(n)), "pruning": list(self.pruning(n))} for n, f in self.fields.items()},
        }

    def to_json(self) -> dict[str, Any]:
        return {"sort_field": self.sort_field, "pk": self.pk, "fields": [asdict(f) | {"pruning": list(self.pruning(n))} for n, f in self.fields.items()]}

    @staticmethod
    def from_json(data: dict[str, Any]) -> CollectionSchema:
        fields = {}
        for f in data["fields"]:
            if "pruning" not in f:
                raise EngineError("FORMAT_VERSION", f"field {f.get('name')} has no list of pruning operators; build the collection again")
            own = {k: v for k, v in f.items() if k != "pruning"}
            fields[own["name"]] = Field(**own | {"values": tuple(own["values"]) if own.get("values") else None})
        return CollectionSchema(data["sort_field"], fields, data["pk"])


def element_operators(f: Field) -> tuple[str, ...]:
    return ("equals", "in", "startsWith", "endsWith", "contains", "not")


def operators_for(f: Field, is_sort: bool = False) -> tuple[str, ...]:
    if f.multi:
        return LIST_OPERATORS
    own = {
        "string": ("equals", "in", *(RANGES if is_sort else ()), "startsWith", "endsWith", "contains", "not"),
        "number": ("equals", "in", *RANGES, "not"),
        "date": ("equals", "in", *RANGES, "not"),
        "boolean": ("equals", "not"),
        "json": (),
    }[f.kind]
    if is_sort:
        return own
    missing = (*(("isNull",) if f.nullable else ()), *(("isAbsent",) if f.absent else ()), *(("exists",) if f.nullable or f.absent else ()))
    return (*own, *missing)


def pruning_for(f: Field, is_sort: bool = False) -> tuple[str, ...]:
    """For a list field, the operators on its elements that an index answers."""
    if is_sort:
        return ("equals", "in", *RANGES, *(("startsWith",) if f.kind == "string" else ()))
    if not f.indexed or f.kind == "json":
        return ()
    if f.kind == "string":
        return ("equals", "in", "startsWith", *(("endsWith",) if f.ends_with else ()), *(("contains",) if f.contains else ()))
    return ("equals",) if f.kind == "boolean" else ("equals", "in", *RANGES)


# --- configuration -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    schema: CollectionSchema
    input: str = ""
    output: str = ""
    name: str = "records"
    format: str = "ndjson"
    records: str | None = None
    delimiter: str | None = None
    block_bytes: int = BLOCK_BYTES
    compression: str = "zstd"


def _bad(message: str) -> EngineError:
    return EngineError("CONFIG", message)


def validate(schema: CollectionSchema) -> CollectionSchema:
    fields, s = schema.fields, schema.sort_field
    if s not in fields:
        raise _bad(f"the sort field {s!r} is not declared")
    for f in fields.values():
        if f.kind not in KINDS:
            raise _bad(f"{f.name}: unknown kind {f.kind!r}")
    own = fields[s]
    if own.multi:
        raise _bad(f"{s}: a list cannot be the sort field")
    if own.kind not in ("number", "date", "string"):
        raise _bad(f"{s}: the sort field must be a number, date or string")
    if own.ends_with or own.contains:
        raise _bad(f"{s}: the sort field takes no endsWith or contains index")
    shared: dict[str, tuple[str, tuple[str, ...]]] = {}
    for n, f in fields.items():
        if f.kind == "json" and (f.indexed or f.ends_with or f.contains or f.multi):
            raise _bad(f"{n}: a json field is carried, not indexed")
        if f.values is not None:
            if f.kind != "string":
                raise _bad(f"{n}: only strings have a set of values")
            if not f.values or len(set(f.values)) != len(f.values):
                raise _bad(f"{n}: values must be given once each, and at least one")
        if f.values_type is not None:
            if f.values is None:
                raise _bad(f"{n}: valuesType needs values")
            if not f.values_type.isidentifier() or keyword.iskeyword(f.values_type):
                raise _bad(f"{n}: valuesType must be an identifier")
            other, values = shared.setdefault(f.values_type, (n, f.values))
            if set(values) != set(f.values):
                raise _bad(f"{n} and {other} share {f.values_type} but not its values")
        if f.py_type is not None and (f.kind != "json" or not f.py_type.strip()):
            raise _bad(f"{n}: a type name is for json fields, and not blank")
        if (f.ends_with or f.contains) and not (f.kind == "string" and f.indexed):
            raise _bad(f"{n}: endsWith and contains need an indexed string")
        if f.multi and (f.kind != "string" or not f.indexed):
            raise _bad(f"{n}: a list must hold strings and be indexed")
        if (f.derive_from is None) != (f.derive_using is None):
            raise _bad(f"{n}: derive needs from and using")
        if f.derive_from is not None:
            source = fields.get(f.derive_from)
            if f.derive_using not in NORMALIZERS:
                raise _bad(f"{n}: unknown normalizer {f.derive_using!r}")
            if f.derive_from == n or source is None:
                raise _bad(f"{n}: derive needs another declared field")
            if source.derive_from is not None:
                raise _bad(f"{n}: a derived field cannot be derived from")
            if f.kind != NORMALIZERS[f.derive_using]:
                raise _bad(f"{n}: {f.derive_using} gives a {NORMALIZERS[f.derive_using]}")
    if schema.pk is not None:
        p = fields.get(schema.pk)
        if p is None:
            raise _bad(f"the primary key {schema.pk!r} is not declared")
        if p.multi or p.absent or p.nullable:
            raise _bad(f"{p.name}: a primary key is a single value in every record")
        if not (p.indexed or schema.is_sort(p.name)):
            raise _bad(f"{p.name}: a primary key is the sort field or indexed")
    return schema


_FIELD_KEYS = {"kind": "kind", "indexed": "indexed", "endsWith": "ends_with", "contains": "contains", "absent": "absent", "nullable": "nullable", "multi": "multi", "valuesType": "values_type", "tsType": "py_type", "pyType": "py_type"}


def resolve(data: dict[str, Any]) -> Config:
    """A configuration file's content, checked, with defaults."""
    form = data.get("format", "ndjson")
    if form not in FORMATS:
        raise _bad(f"unknown format {form!r}")
    if data.get("records") is not None and form != "json":
        raise _bad("records is for json only")
    if data.get("delimiter") is not None and form not in ("csv", "tsv"):
        raise _bad("delimiter is for csv and tsv only")
    compression = data.get("compression")
    if "gzip" in data and compression is not None and (compression == "gzip") != bool(data["gzip"]):
        raise _bad("gzip and compression contradict each other")
    compression = compression or ("gzip" if data.get("gzip") else "zstd")
    if compression not in COMPRESSIONS:
        raise _bad(f"unknown compression {compression!r}: Spark writes {', '.join(COMPRESSIONS)}")
    own = data.get("schema") or {}
    if "sortField" not in own or "fields" not in own:
        raise _bad("schema needs sortField and fields")
    fields = {}
    for n, f in own["fields"].items():
        unknown = set(f) - set(_FIELD_KEYS) - {"values", "derive", "tsImport"}
        if unknown:
            raise _bad(f"{n}: unknown settings {sorted(unknown)}")
        if "tsImport" in f and "tsType" not in f:
            raise _bad(f"{n}: tsImport needs tsType")
        derive = f.get("derive") or {}
        fields[n] = Field(n, **{_FIELD_KEYS[k]: v for k, v in f.items() if k in _FIELD_KEYS}, values=tuple(f["values"]) if f.get("values") is not None else None, derive_from=derive.get("from"), derive_using=derive.get("using"))
    block = data.get("blockBytes", BLOCK_BYTES)
    if not isinstance(block, int) or block <= 0:
        raise _bad("blockBytes must be a positive number")
    schema = validate(CollectionSchema(own["sortField"], fields, own.get("pk")))
    return Config(schema, data.get("input", ""), data.get("output", ""), data.get("collection", data.get("dataset", "records")), form, data.get("records"), data.get("delimiter"), block, compression)


def with_field(schema: CollectionSchema, name: str, **changes: Any) -> CollectionSchema:
    return replace(schema, fields=schema.fields | {name: replace(schema.fields[name], **changes)})
