import json

import pytest

from blockquery.errors import EngineError
from blockquery.functions.normalize import fold, lowercase, normalize, numeric, trigrams, trim
from blockquery.schema import CollectionSchema, Field
from blockquery.sources.readers import count_records, json_lines, ndjson_lines, read_records
from pyspark.sql import functions as F

SCHEMA = CollectionSchema("year", {"year": Field("year", "number"), "title": Field("title", "string"), "rating": Field("rating", "number", absent=True), "isClassic": Field("isClassic", "boolean", absent=True)})


def rows(df):
    return sorted((r["year"], r["title"], r["rating"], r["isClassic"], sorted(r["_keys"])) for r in df.collect())


def test_ndjson(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"year":1999,"title":"x","rating":null}\n\n   \n{"year":2000,"title":"y"}\n')
    df = read_records(spark, str(tmp_path / "*.ndjson"), "ndjson", SCHEMA)
    assert rows(df) == [(1999, "x", None, None, ["rating", "title", "year"]), (2000, "y", None, None, ["title", "year"])]
    n = count_records(ndjson_lines(spark, str(tmp_path / "a.ndjson"))).first()
    assert n["records"] == 2 and n["bytes"] > 50


def test_undeclared_keys_are_carried(spark, tmp_path):
    from blockquery.build import build
    from blockquery.client import connect

    (tmp_path / "a.ndjson").write_text('{"year":1999,"title":"x","more":{"a":[1,null]},"note":"n"}\n{"year":2000,"title":"y"}\n')
    build(read_records(spark, str(tmp_path / "a.ndjson"), "ndjson", SCHEMA), SCHEMA, str(tmp_path / "c"))
    found = connect(spark, str(tmp_path / "c")).find_many(limit=5).records
    assert found == [{"year": 1999, "title": "x", "more": {"a": [1, None]}, "note": "n"}, {"year": 2000, "title": "y"}]


def test_json_documents(spark, tmp_path):
    one, two = [{"year": 1, "title": "a"}, {"year": 2, "title": "b"}], {"k": {"year": 3, "title": "c"}}
    (tmp_path / "list.json").write_text(json.dumps(one))
    (tmp_path / "object.json").write_text(json.dumps(two))
    (tmp_path / "deep.json").write_text(json.dumps({"data": {"rows": one}}))
    read = lambda name, at=None: [r[0] for r in rows(read_records(spark, str(tmp_path / name), "json", SCHEMA, at))]
    assert read("list.json") == [1, 2] and read("object.json") == [3] and read("deep.json", "data.rows") == [1, 2]
    with pytest.raises(Exception, match="record selector"):
        json_lines(spark, str(tmp_path / "deep.json"), "data.none").collect()


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('year,title,rating,isClassic\r\n1999,"The Matrix, Reloaded",7.2,true\r\n2000,"Multi\nline ""Title""",,false\r\n')
    assert rows(read_records(spark, str(tmp_path / "a.csv"), "csv", SCHEMA)) == [
        (1999, "The Matrix, Reloaded", 7.2, True, ["isClassic", "rating", "title", "year"]),
        (2000, 'Multi\nline "Title"', None, False, ["isClassic", "title", "year"]),
    ]
    (tmp_path / "a.tsv").write_text("year\ttitle\trating\tisClassic\n1\ta,b\t2\t\n")
    assert rows(read_records(spark, str(tmp_path / "a.tsv"), "tsv", SCHEMA)) == [(1, "a,b", 2, None, ["rating", "title", "year"])]


@pytest.mark.parametrize("line", ["1999,x,1,yes", "nineteen-ninety-nine,x,1,true", "1999,x,Infinity,true", "1999,x,1d,true"])
def test_bad_cells(spark, tmp_path, line):
    (tmp_path / "b.csv").write_text("year,title,rating,isClassic\n" + line + "\n")
    with pytest.raises(Exception, match="CORRUPT_DATA"):
        read_records(spark, str(tmp_path / "b.csv"), "csv", SCHEMA).collect()


def test_patterns(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    for i, p in enumerate(("a.ndjson", "x/b.ndjson", "x/y/c.ndjson")):
        (tmp_path / p).write_text(json.dumps({"year": i, "title": p}) + "\n")
    read = lambda p: [r[0] for r in rows(read_records(spark, str(tmp_path / p), "ndjson", SCHEMA))]
    assert read("**/*.ndjson") == [0, 1, 2] and read("x/?.ndjson") == [1]
    for none in ("nothing*.ndjson", "**/nothing.ndjson"):
        with pytest.raises(EngineError) as e:
            read(none)
        assert e.value.code == "CONFIG"


SAMPLES = ["Lim-Dûl the Necromancer", "Jötun Grunt", "Æther Vial", "  Sol Ring  ", "ÉCOLE", "straße", "", "   ", "7", " -3.5 ", "1+*", "*", "∞", "Infinity", "1e3", ".5", "5.", "0x1F", "0b101", "0o17", "-0x1", "NaN", "1d", "﻿8 ", "1_000", "+4", "1e999", None]


def test_columns_agree_with_plain_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r["i"]: r for r in df.select("i", numeric(F.col("s")).alias("numeric"), lowercase(F.col("s")).alias("lowercase"), trim(F.col("s")).alias("trim"), fold(F.col("s")).alias("fold")).collect()}
    for i, s in enumerate(SAMPLES):
        for using in ("numeric", "lowercase", "trim", "fold"):
            assert got[i][using] == normalize(using, s), (using, s)


def test_normalize():
    assert normalize("fold", "Lim-Dûl") == "lim-dul" and normalize("fold", "Æther") == "æther" and normalize("fold", "ÉCOLE") == "ecole"
    assert [normalize("numeric", x) for x in ("7", " -3.5 ", "1+*", "∞", "Infinity", "", 12.5, float("nan"), True, None, "0x1F")] == [7, -3.5, None, None, None, None, 12.5, None, None, None, 31]
    assert normalize("trim", "   ") is None and normalize("trim", "﻿ a ") == "a" and normalize("lowercase", 5) is None
    assert normalize("numeric", ["1", "x"]) == [1.0] and normalize("trim", [" "]) is None
    with pytest.raises(EngineError):
        normalize("shout", "x")


def test_trigrams(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abc",), ("añ\U0001f600d",)], "s string")
    assert [r[0] for r in df.select(trigrams(F.col("s"))).collect()] == [[], [], ["abc"], ["añ\U0001f600", "ñ\U0001f600d"]]
