"""Small collections with results written by hand."""

import json

from blockquery.schema import CollectionSchema, Field, validate

MOVIES = [
    (1999, "The Matrix", 8.7), (2000, "Gladiator", 8.5), (2000, "Snatch", 8.3), (2000, "Memento", 8.4), (2003, "The Matrix Reloaded", 7.2),
    (2008, "The Dark Knight", 9.0), (2010, "Inception", 8.8), (2010, "Toy Story 3", 8.3), (2014, "Interstellar", 8.6), (2019, "Parasite", 8.6),
]
MOVIE_ROWS = [{"year": y, "title": t, "rating": r} for y, t, r in MOVIES]
MOVIE_SCHEMA = validate(CollectionSchema("year", {"year": Field("year", "number"), "title": Field("title", "string", indexed=True, ends_with=True, contains=True), "rating": Field("rating", "number", indexed=True)}, "title"))

TAGLINES = [
    {"year": 1999, "title": "The Matrix", "genres": ["Sci-Fi", "Action"], "tagline": "Welcome to the Real World"},
    {"year": 2000, "title": "Gladiator", "genres": ["Action", "Drama"]},
    {"year": 2000, "title": "Snatch", "genres": ["Crime", "Comedy"], "tagline": None},
    {"year": 2008, "title": "The Dark Knight", "genres": ["Action", "Crime"], "tagline": "Why So Serious?"},
    {"year": 2010, "title": "Inception", "genres": ["Sci-Fi", "Thriller"], "tagline": "Your mind is the scene of the crime"},
]
TAGLINE_SCHEMA = validate(
    CollectionSchema("year", {"year": Field("year", "number"), "title": Field("title", "string", indexed=True), "tagline": Field("tagline", "string", indexed=True, absent=True, nullable=True), "genres": Field("genres", "string", indexed=True, multi=True)})
)

COLORS = [
    {"year": 1, "title": "colorless", "colors": []}, {"year": 2, "title": "W", "colors": ["W"]}, {"year": 3, "title": "U", "colors": ["U"]}, {"year": 4, "title": "WU", "colors": ["W", "U"]},
    {"year": 5, "title": "UW", "colors": ["U", "W"]}, {"year": 6, "title": "WUB", "colors": ["W", "U", "B"]}, {"year": 7, "title": "B", "colors": ["B"]}, {"year": 8, "title": "no colors key"},
    {"year": 9, "title": "also colorless", "colors": []}, {"year": 10, "title": "R", "colors": ["R"]},
]
COLOR_SCHEMA = validate(CollectionSchema("year", {"year": Field("year", "number"), "title": Field("title", "string"), "colors": Field("colors", "string", indexed=True, multi=True, absent=True)}))

STATS = [
    ("Grizzly Bears", "2", 1993), ("Craw Wurm", "6", 1993), ("Force of Nature", "8", 1994), ("Lord of the Pit", "7", 1994), ("Tarmogoyf", "*", 2007),
    ("Nameless Race", "*", 1994), ("Angry Mob", "2+*", 1994), ("Impervious Greatwurm", "16", 2018), ("Infinity Elemental", "∞", 2017), ("Ghalta", "12", 2018),
]


def ndjson(path, rows) -> str:
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
    return str(path)


def titles(records) -> list[str]:
    return [r["title"] for r in records]
