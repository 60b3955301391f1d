import pytest

from blockquery.errors import EngineError
from blockquery.plans.find import find, page
from blockquery.plans.planner import successor
from blockquery.plans.where import UNSET, assert_prunes, check, compact, where_prunes
from blockquery.schema import CollectionSchema, Field
from blockquery.sources.readers import from_lines

from .fixtures import COLOR_SCHEMA, COLORS, MOVIE_SCHEMA, MOVIES, TAGLINE_SCHEMA, TAGLINES, ndjson


@pytest.fixture(scope="module")
def movies(spark):
    return spark.createDataFrame([(float(y), t, r) for y, t, r in MOVIES], "year double, title string, rating double").cache()


def found(df, schema, where, **rest):
    return [r["title"] for r in find(df, schema, where, **rest).collect()]


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ({"year": {"equals": 2000}}, {"Gladiator", "Memento", "Snatch"}),
        ({"year": {"gt": 2008, "lte": 2014}}, {"Inception", "Toy Story 3", "Interstellar"}),
        ({"year": {"in": [1999, 2019]}}, {"The Matrix", "Parasite"}),
        ({"year": {"in": []}}, set()),
        ({"title": {"not": "Snatch"}, "year": {"equals": 2000}}, {"Gladiator", "Memento"}),
        ({"title": {"startsWith": "The Matrix"}}, {"The Matrix", "The Matrix Reloaded"}),
        ({"title": {"endsWith": "o"}}, {"Memento"}),
        ({"title": {"contains": "ator"}}, {"Gladiator"}),
        ({"title": {"contains": "%"}}, set()),
        ({"title": {"startsWith": "the"}}, set()),
        ({"rating": {"gte": 8.6, "lt": 8.8}}, {"The Matrix", "Interstellar", "Parasite"}),
        (None, {t for _, t, _ in MOVIES}),
    ],
)
def test_scalar_predicates(movies, where, expected):
    got = found(movies, MOVIE_SCHEMA, where)
    assert set(got) == expected and len(got) == len(expected)


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ({"tagline": {"isNull": True}}, {"Snatch"}),
        ({"tagline": {"isNull": False}}, {"The Matrix", "Gladiator", "The Dark Knight", "Inception"}),
        ({"tagline": {"isAbsent": True}}, {"Gladiator"}),
        ({"tagline": {"exists": True}}, {"The Matrix", "The Dark Knight", "Inception"}),
        ({"tagline": {"exists": False}}, {"Gladiator", "Snatch"}),
        ({"tagline": {"not": "Why So Serious?"}}, {"The Matrix", "Inception"}),
        ({"genres": {"some": "Action"}}, {"The Matrix", "Gladiator", "The Dark Knight"}),
        ({"genres": {"some": {"startsWith": "C", "endsWith": "y"}}}, {"Snatch"}),
        ({"genres": {"every": {"in": ["Action", "Crime"]}}}, {"The Dark Knight"}),
    ],
)
def test_missing_values(spark, tmp_path, where, expected):
    df = from_lines(spark.read.text(ndjson(tmp_path / "t.ndjson", TAGLINES)), TAGLINE_SCHEMA)
    assert set(found(df, TAGLINE_SCHEMA, where)) == expected


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        ({"isEmpty": True}, {"also colorless", "colorless"}),
        ({"isEmpty": False}, {"W", "U", "WU", "UW", "WUB", "B", "R"}),
        ({"every": {"in": ["W", "U"]}}, {"U", "UW", "W", "WU", "also colorless", "colorless"}),
        ({"hasEvery": ["W", "R"]}, set()),
        ({"hasEvery": ["W", "U"]}, {"WU", "UW", "WUB"}),
        ({"hasEvery": ["W", "U"], "every": {"in": ["W", "U"]}}, {"WU", "UW"}),
        ({"hasEvery": []}, {c["title"] for c in COLORS if "colors" in c}),
        ({"some": {"not": "W"}}, {"U", "WU", "UW", "WUB", "B", "R"}),
    ],
)
def test_lists(spark, tmp_path, filters, expected):
    df = from_lines(spark.read.text(ndjson(tmp_path / "c.ndjson", COLORS)), COLOR_SCHEMA)
    assert set(found(df, COLOR_SCHEMA, {"colors": filters})) == expected


def test_compact():
    assert compact(None) == {} == compact({"a": None, "b": {"equals": None}, "c": {"some": {"equals": UNSET}}})
    assert compact({"a": {"equals": 0, "not": None}, "b": {"in": []}}) == {"a": {"equals": 0}, "b": {"in": []}}


@pytest.mark.parametrize(
    "where",
    [{"nope": {"equals": 1}}, {"title": {"gt": "a"}}, {"title": {"matches": "a"}}, {"year": {"equals": "2000"}}, {"year": {"equals": True}}, {"title": {"in": "abc"}}, {"title": {"equals": 5}}, {"title": {"isNull": True}}],
)
def test_refused(where):
    with pytest.raises(ValueError):
        check(compact(where), MOVIE_SCHEMA)


RULES = CollectionSchema(
    "y",
    {
        "y": Field("y", "number"),
        "name": Field("name", "string", indexed=True, ends_with=True, contains=True),
        "plain": Field("plain", "string"),
        "tags": Field("tags", "string", indexed=True, multi=True),
        "flag": Field("flag", "boolean", indexed=True),
    },
)


@pytest.mark.parametrize(
    ("where", "prunes"),
    [
        ({}, True),
        (None, True),
        ({"plain": {"equals": "x"}}, False),
        ({"plain": {"equals": "x"}, "y": {"gt": 3}}, True),
        ({"name": {"not": "x"}}, False),
        ({"name": {"contains": "ab"}}, False),
        ({"name": {"contains": "abc"}}, True),
        ({"name": {"startsWith": ""}}, False),
        ({"name": {"endsWith": "b"}}, True),
        ({"tags": {"hasEvery": []}}, False),
        ({"tags": {"hasEvery": ["a"]}}, True),
        ({"tags": {"isEmpty": True}}, True),
        ({"tags": {"isEmpty": False}}, False),
        ({"tags": {"some": "a"}}, True),
        ({"tags": {"some": {"not": "a"}}}, False),
        ({"tags": {"every": {"in": ["a"]}}}, True),
        ({"flag": {"equals": True}}, True),
        ({"flag": {"not": True}}, False),
        ({"plain": {"equals": None}}, True),
    ],
)
def test_pruning_rule(where, prunes):
    assert where_prunes(where, RULES) is prunes
    if prunes:
        assert_prunes(compact(where), RULES)
    else:
        with pytest.raises(EngineError) as e:
            assert_prunes(compact(where), RULES)
        assert e.value.code == "NEEDS_PRUNING"
        for name, filters in where.items():
            assert name in str(e.value)
            assert not any(isinstance(v, str) and len(v) > 1 and v in str(e.value) for v in filters.values())


def test_order_and_page(movies):
    rating = lambda **k: [(r["rating"], r["title"]) for r in page(movies, MOVIE_SCHEMA, **k).collect()]
    assert rating(order_by={"rating": "desc"}, limit=3) == [(9.0, "The Dark Knight"), (8.8, "Inception"), (8.7, "The Matrix")]
    assert [t for _, t in rating(order_by=[{"rating": "asc"}, {"title": "desc"}], limit=2, offset=1)] == ["Toy Story 3", "Snatch"]
    assert [t for _, t in rating(limit=4)] == ["The Matrix", "Gladiator", "Memento", "Snatch"]
    assert rating(limit=0) == []
    for bad in ({"limit": -1}, {"offset": -1}, {"limit": True}, {"order_by": {"rating": "up"}}, {"order_by": {"nope": "asc"}}):
        with pytest.raises(ValueError):
            rating(**bad)


def test_successor():
    assert successor("abc") == "abd" and successor("") is None and successor("a\U0010ffff") == "b"
    assert successor("\U0010ffff") is None and successor("퟿".encode("utf-8", "surrogatepass").decode("utf-8", "surrogatepass")) == ""
