import pytest

from blockquery.errors import EngineError
from blockquery.schema import CollectionSchema, Field, operators_for, pruning_for, resolve, validate


def config(fields=None, sort="a", **rest):
    return {"schema": {"sortField": sort, "fields": {"a": {"kind": "number"}} | (fields or {})}} | rest


@pytest.mark.parametrize(
    "data",
    [
        config(format="xml"),
        config(records="a.b"),
        config(delimiter=";"),
        config(sort="b"),
        config({"b": {"kind": "boolean"}}, sort="b"),
        config({"b": {"kind": "string", "indexed": True, "contains": True}}, sort="b"),
        config({"b": {"kind": "string", "values": ["x"], "valuesType": "V"}, "c": {"kind": "string", "values": ["y"], "valuesType": "V"}}),
        config({"b": {"kind": "json", "indexed": True}}),
        config({"b": {"kind": "number", "values": ["x"]}}),
        config({"b": {"kind": "string", "values": []}}),
        config({"b": {"kind": "string", "values": ["x", "x"]}}),
        config({"b": {"kind": "string", "valuesType": "V"}}),
        config({"b": {"kind": "string", "values": ["x"], "valuesType": "not one"}}),
        config({"b": {"kind": "string", "tsType": "T"}}),
        config({"b": {"kind": "json", "tsType": " "}}),
        config({"b": {"kind": "json", "tsImport": "x"}}),
        config({"b": {"kind": "string", "derive": {"from": "a", "using": "shout"}}}),
        config({"b": {"kind": "number", "derive": {"from": "b", "using": "numeric"}}}),
        config({"b": {"kind": "number", "derive": {"from": "z", "using": "numeric"}}}),
        config({"b": {"kind": "string", "derive": {"from": "a", "using": "numeric"}}}),
        config({"b": {"kind": "string"}, "c": {"kind": "string", "derive": {"from": "b", "using": "trim"}}, "d": {"kind": "string", "derive": {"from": "c", "using": "trim"}}}),
        config({"b": {"kind": "string", "endsWith": True}}),
        config({"b": {"kind": "number", "indexed": True, "contains": True}}),
        config({"b": {"kind": "string", "multi": True}}),
        config({"b": {"kind": "number", "multi": True, "indexed": True}}),
        config({"b": {"kind": "string", "multi": True, "indexed": True}}, sort="b"),
        config({"b": {"kind": "string", "unheard": True}}),
        {"schema": {"sortField": "a", "pk": "z", "fields": {"a": {"kind": "number"}}}},
        {"schema": {"sortField": "a", "pk": "b", "fields": {"a": {"kind": "number"}, "b": {"kind": "string"}}}},
        {"schema": {"sortField": "a", "pk": "b", "fields": {"a": {"kind": "number"}, "b": {"kind": "string", "indexed": True, "absent": True}}}},
        config(compression="zip"),
        config(compression="none", gzip=True),
        config(blockBytes=0),
        {"format": "ndjson"},
    ],
)
def test_bad_configurations(data):
    with pytest.raises(EngineError) as e:
        resolve(data)
    assert e.value.code == "CONFIG"


def test_defaults_and_round_trip():
    c = resolve(config({"b": {"kind": "string", "indexed": True, "endsWith": True, "values": ["x", "y"], "valuesType": "V"}}))
    assert (c.format, c.compression, c.name) == ("ndjson", "zstd", "records")
    assert CollectionSchema.from_json(c.schema.to_json()) == c.schema
    with pytest.raises(EngineError) as e:
        CollectionSchema.from_json({"sort_field": "a", "pk": None, "fields": [{"name": "a", "kind": "number"}]})
    assert e.value.code == "FORMAT_VERSION"


def test_operators_and_pruning():
    ranges = {"gt", "gte", "lt", "lte"}
    number, text = Field("n", "number"), Field("s", "string")
    assert set(operators_for(number)) == {"equals", "in", "not"} | ranges and pruning_for(number) == ()
    assert set(pruning_for(Field("n", "number", indexed=True))) == {"equals", "in"} | ranges
    assert not ranges & set(operators_for(text)) and ranges <= set(operators_for(text, True))
    assert set(pruning_for(text, True)) == {"equals", "in", "startsWith"} | ranges
    assert set(pruning_for(Field("s", "string", indexed=True, ends_with=True, contains=True))) == {"equals", "in", "startsWith", "endsWith", "contains"}
    assert operators_for(Field("b", "boolean")) == ("equals", "not") and pruning_for(Field("b", "boolean", indexed=True)) == ("equals",)
    assert set(operators_for(Field("j", "json", absent=True, nullable=True))) == {"isNull", "isAbsent", "exists"}
    assert set(operators_for(Field("m", "string", multi=True, indexed=True, nullable=True))) == {"some", "every", "hasEvery", "isEmpty"}
    assert "isNull" not in operators_for(Field("n", "number", nullable=True), True)


def test_unknown_kind():
    with pytest.raises(EngineError):
        validate(CollectionSchema("a", {"a": Field("a", "decimal")}))
