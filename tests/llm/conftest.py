import pytest

#: Nulls in every column, empty, blank, tiny, long and repeated texts, repeated and null ids, and columns whose names operators use themselves.
LONG = "\n".join(f"line {i} speaks of thing {i % 97} and of part {i * i % 1013} in full." for i in range(4000))
PROSE = "the quick brown fox jumps over the lazy dog and then it runs away from the old farm house near the river "
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", "en", "a", 5),
    (4, "word", None, "a", 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, PROSE * 4, "fr", None, 1),
    (7, PROSE * 4, "fr", "b", 1),
    (8, "Ünïcödé \U0001f600 ñandú\r\n" * 30, "es", "b", 1),
    (9, PROSE * 4 + "one more line of words at the very end", "fr", "b", 1),
    (9, PROSE * 4 + "one more line of words at the very end", "fr", "b", 1),
    (None, "a text without an id that is long enough to have some shingles", "en", "b", 1),
    (10, "one two three", "en", "c", 13),
    (11, "one two three", "en", "c", 13),
    (12, "one two three four five six seven", "en", "c", 13),
]
CLASHES = "size taken score row piece node component pattern held_out kept digest bands set quality n_words sequence_id offset start end __id __copies".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(*r, *(f"x{i}" for i in range(len(CLASHES)))) for r in EDGE], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def python_free(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(w in plan for w in ("Python", "Pandas", "Arrow"))
