"""Licence scan: canonical digests of entire texts, looked up by hash join.

A text is lowered, copyright lines and title lines are dropped, everything but letters and digits becomes one space,
equivalent spellings become one, the names of holders in liability and endorsement clauses become "holder", and the SHA-256
of what is left is joined to the digests of known licences. The same digests find whole licences inside longer texts: where
the first words of a known licence stand in the canonical text, as many characters as it has are digested and compared
(`blocks`). The canonical form of single lines that speak of a licence is looked up among known one-line notices
("Licensed under the ..."). All of it is built-in functions in one pass; the known digests are a constant table.

Null text counts as empty. Repeated rows and equal ids are answered each on their own. A text that is no known licence has
a null licence; one without known blocks or notices has ''. Of known texts that tie in their canonical form the smallest
licence id answers. A very long text is made canonical in its task as a whole, some five times its length. An empty table
gives an empty result. Columns beside doc_id and text are not read. `known` replaces the table of entire texts: licence_id
and text, canonised the same way; blocks and notices keep the constant tables.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .license_digests import LONG, SHORT, described

_COPYRIGHT = r"(^|\n)[ \t*#/;-]*((copyright|©)[ \t]*(\(c\)|©|[0-9]|<|\[|by )|\(c\)[ \t]*[0-9]|(all )?rights reserved)[^\n]*"
#: A line that holds a licence's name and nothing else.
_TITLE = r"(^|\n)[ \t]*(the )?(mit|expat|isc|zlib|((new|modified|revised|simplified) )?bsd( [023]-clause)?( \"?(new|revised|simplified)\"?( or \"?(new|revised|simplified)\"?)?)?) licen[sc]e( \((mit|expat|isc|bsd)\))?[ \t:.]*(?=\r?\n|$)"
_MARKS = r"[^\p{L}\p{N}]+"
#: Spellings that mean the same in licences: parts of words, replaced in this order.
EQUIVALENT = (
    ("licenc", "licens"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"),
    ("https", "http"), (" favour", " favor"), ("behaviour", "behavior"), (" fulfil ", " fulfill "), ("wilful", "willful"), (" whilst ", " while "), ("judgement", "judgment"),
)
#: Clauses that name a holder. Each takes a bounded number of words.
HOLDERS = (
    (r" neither the names? of (\S+ ){1,24}?nor the names? of (\S+ ){1,6}?may be used ", " neither the name of holder nor the names of its contributors may be used "),
    (r" provided by (\S+ ){1,16}?as is and any ", " provided by holder as is and any "),
    (r" in no event shall (\S+ ){1,16}?be liable ", " in no event shall holder be liable "),
)
_LIABLE = " be liable "
_NOTICE_LINE = r"licen[sc]e|cc by|spdx|public domain"

_NAMES = {
    "MIT": ("MIT License", "MIT license", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2 license", "GPL version 2 license"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3 license", "GPL version 3 license"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "ISC": ("ISC License",),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "CC-BY-4.0": ("CC BY 4.0", "CC BY 4.0 license", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal license", "CC0 license"),
    "Unlicense": ("Unlicense",),
}
_LEADS = ("Released under the {}", "Licensed under the {}", "Licensed under {}", "Released under {}", "This work is licensed under the {}", "This work is licensed under {}", "This work is licensed under a {}", "This project is licensed under the {}", "This software is released under the {}", "This program is licensed under the {}", "Distributed under the {}", "License: {}")


def canonical_text(text: str) -> str:
    """The same as `canonical`, in Python: for constant tables and tests."""
    import regex

    t = regex.sub(_TITLE, "\n", regex.sub(_COPYRIGHT, "\n", text.lower()))
    t = " " + regex.sub(_MARKS, " ", t) + " "
    for a, b in EQUIVALENT:
        t = t.replace(a, b)
    if _LIABLE in t:
        for pattern, own in HOLDERS:
            t = regex.sub(pattern, own, t)
    return t.strip(" ")


def digest_text(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def _notices() -> dict[str, str]:
    found = {digest_text(lead.format(name)): spdx for spdx, names in _NAMES.items() for name in names for lead in _LEADS}
    return found | {digest_text(f"SPDX-License-Identifier: {spdx}{tail}"): spdx for spdx in _NAMES for tail in ("", "-only", "-or-later")}


NOTICES = _notices()


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, "\n"), _TITLE, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, _MARKS, " "), F.lit(" "))
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    # computed once, inside a function of an array; few texts speak of liability
    return F.trim(F.element_at(F.transform(F.array(t), lambda x: F.when(F.contains(x, F.lit(_LIABLE)), reduce(lambda c, h: F.regexp_replace(c, *h), HOLDERS, x)).otherwise(x)), 1))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def notices(text: Column) -> Column:
    """The licences named by known notice lines, sorted, joined by commas."""
    known = F.create_map(*(F.lit(x) for pair in NOTICES.items() for x in pair))
    lines = F.filter(F.split(text, "\n"), lambda line: F.lower(line).rlike(_NOTICE_LINE))
    named = F.transform(lines, lambda line: F.try_element_at(known, digest(line)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))), ",")


#: digest, licence, length and first words of every known licence, short and long.
KNOWN = sorted({described(name, text) for name, text in SHORT.items()} | set(LONG), key=lambda r: (r[1], r[2]))
DIGESTS = {d: name for d, name, *_ in KNOWN}
#: Licences by their first words.
ANCHORS: dict[str, list[tuple[str, str, int]]] = {}
for _digest, _name, _length, _anchor in KNOWN:
    ANCHORS.setdefault(_anchor, []).append((_digest, _name, _length))


def blocks(own: Column) -> Column:
    """The known licences that stand whole in a canonical text, sorted, joined by commas."""

    def found(anchor: str, known: list[tuple[str, str, int]]) -> Column:
        pieces = F.split(F.concat(F.lit(" "), own), re.escape(f" {anchor}"))  # from a word's beginning
        at = F.filter(F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))), lambda i: i <= F.size(pieces))
        # what follows each place of the anchor, and the place itself
        rest = F.transform(at, lambda i: F.concat(F.lit(anchor), F.array_join(F.slice(pieces, i, F.size(pieces)), f" {anchor}")))
        hit = lambda t, d, n: (F.sha2(F.substring(t, 1, n).cast("binary"), 256) == d) & F.substring(t, n + 1, 1).isin("", " ")
        return F.array(*(F.when(F.exists(rest, lambda t: hit(t, d, n)), F.lit(name)) for d, name, n in known))  # noqa: B023

    each = F.flatten(F.array(*(found(a, known) for a, known in ANCHORS.items())))
    names = F.array_join(F.array_sort(F.array_distinct(F.filter(each, lambda x: x.isNotNull()))), ",")
    return F.when(own.rlike("|".join(map(re.escape, ANCHORS))), names).otherwise(F.lit(""))


def known_licences(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, licence. One row for each digest: the smallest id where texts agree."""
    if known is not None:
        return known.groupBy(digest(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.min("licence_id").alias("licence"))
    return F.broadcast(spark.createDataFrame(list(DIGESTS.items()), "digest string, licence string"))  # a constant table


def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, licence, blocks, notices."""
    text = F.coalesce("text", F.lit(""))
    # one structure, so that the canonical text is computed once
    own = F.element_at(F.transform(F.array(canonical(text)), lambda c: F.struct(F.sha2(c.cast("binary"), 256).alias("digest"), blocks(c).alias("blocks"))), 1)
    found = docs.select("doc_id", own.alias("own"), notices(text).alias("notices")).select("doc_id", "own.digest", "own.blocks", "notices")
    return found.join(known_licences(docs.sparkSession, known), "digest", "left").select("doc_id", "digest", "licence", "blocks", "notices")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    t = f"' ' || regexp_replace(regexp_replace(regexp_replace(lower({x}), {_quoted(_COPYRIGHT)}, chr(10), 'g'), {_quoted(_TITLE_SQL)}, chr(10), 'g'), {_quoted(_MARKS)}, ' ', 'g') || ' '"
    for a, b in EQUIVALENT:
        t = f"replace({t}, {_quoted(a)}, {_quoted(b)})"
    own = reduce(lambda c, h: f"regexp_replace({c}, {_quoted(h[0])}, {_quoted(h[1])}, 'g')", HOLDERS, "x")
    return f"trim(list_transform([{t}], lambda x: CASE WHEN contains(x, '{_LIABLE}') THEN {own} ELSE x END)[1], ' ')"


#: RE2 has no look-ahead: the line's end is taken along, and put back as the line's end it was.
_TITLE_SQL = _TITLE.replace("(?=\\r?\\n|$)", "(\\r?(\\n)|$)")


def _oracle() -> str:
    case = f"CASE sha256({_sql_canonical('line')}) " + " ".join(f"WHEN '{d}' THEN '{n}'" for d, n in NOTICES.items()) + " END"
    whole = "CASE digest " + " ".join(f"WHEN '{d}' THEN '{n}'" for d, n in DIGESTS.items()) + " END"
    lines = f"list_filter(string_split(t, chr(10)), lambda line: regexp_matches(lower(line), '{_NOTICE_LINE}'))"
    named = f"list_filter(list_transform({lines}, lambda line: {case}), lambda x: x IS NOT NULL)"
    split = lambda a: f"string_split(' ' || c, {_quoted(' ' + a)})"
    rest = lambda a: f"list_transform(range(2, len({split(a)}) + 1), lambda i: {_quoted(a)} || array_to_string({split(a)}[i:], {_quoted(' ' + a)}))"
    hits = [f"CASE WHEN len(list_filter({rest(a)}, lambda t: sha256(substr(t, 1, {n})) = '{d}' AND substr(t, {n + 1}, 1) IN ('', ' '))) > 0 THEN '{name}' END" for a, known in ANCHORS.items() for d, name, n in known]
    inside = f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL))), ',')"
    some = " OR ".join(f"contains(c, {_quoted(a)})" for a in ANCHORS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, {_sql_canonical('t')} AS c, array_to_string(list_sort(list_distinct({named})), ',') AS notices FROM d),
f AS (SELECT doc_id, sha256(c) AS digest, CASE WHEN {some} THEN {inside} ELSE '' END AS blocks, notices FROM e)
SELECT doc_id, digest, {whole} AS licence, blocks, notices FROM f"""


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES = {"op7_license_scan": _oracle()}
