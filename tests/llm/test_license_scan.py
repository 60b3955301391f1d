import os

import duckdb
import pytest

from blockquery.llm.license_digests import LONG, SHORT, long_table
from blockquery.llm.license_scan import DIGESTS, NOTICES, ORACLES, canonical, canonical_text, digest_text, op7_license_scan, scan_licences
from pyspark.sql import functions as F

from .conftest import python_free

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
SAMPLES = [MIT, "", "  ", "Licence, LICENSE; licence\nCopyright 2001 X\nall rights reserved. more", "© 2020\n(c) 1999 me\ncopyright by Y\nThe copyright notice stays", "a—b  c\td e İstanbul ẞ", "https://x.org organisation organisation authorised\r\nend", "The BSD 3-Clause \"New\" License\r\nmit license (mit):\nthe MIT License holds", *SHORT.values()]


def test_canonical_agrees_with_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    for r in df.select("i", canonical(F.col("s")).alias("c")).collect():
        if "İ" not in SAMPLES[r["i"]]:
            assert r["c"] == canonical_text(SAMPLES[r["i"]])


@pytest.mark.parametrize(
    ("a", "same"),
    [
        (MIT.replace("2020 Some One", "1999-2024 A. N. Other <a@b.c>"), True),
        (MIT.upper().replace(",", " ,").replace("\n", "\n  * "), True),
        (MIT.replace("sublicense", "sublicence").replace("Copyright (c)", "© "), True),
        (MIT.replace("free of charge", "for a fee"), False),
        (MIT + "\nAnd one more condition.", False),
    ],
)
def test_spelling_case_and_owners_do_not_matter(a, same):
    assert (digest_text(a) == digest_text(MIT)) is same


def test_lookup_and_edges(spark, edge, nothing):
    known = spark.createDataFrame([("MIT", MIT), ("Z-again", MIT.lower()), ("Empty", None)], "licence_id string, text string")
    docs = spark.createDataFrame([(1, MIT.upper()), (2, "x " + MIT), (3, None), (4, "Released under the MIT License.\nplain line\nSPDX-License-Identifier: Apache-2.0"), (4, "SPDX-License-Identifier: Apache-2.0-only"), (None, "Licenced under the MIT License")], "doc_id bigint, text string")
    found = scan_licences(docs, known)
    assert python_free(found)
    got = sorted(((r["doc_id"] or 0, r["licence"], r["notices"]) for r in found.collect()), key=repr)
    assert got == sorted([(0, None, "MIT"), (1, "MIT", ""), (2, None, ""), (3, "Empty", ""), (4, None, "Apache-2.0"), (4, None, "Apache-2.0,MIT")], key=repr)
    assert scan_licences(edge).count() == edge.count() and scan_licences(nothing).count() == 0
    assert len(NOTICES) > 300


def test_query_against_sql(spark, small):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    sql = c.execute(ORACLES["op7_license_scan"])
    names = [d[0] for d in sql.description]
    df = op7_license_scan(spark, small)
    assert python_free(df) and sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, sql.fetchall()))


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no folder of licence texts")
def test_every_digest():
    """The table is what the script makes of the texts, and every short text answers for itself."""
    assert LONG == long_table("/usr/share/common-licenses")
    assert all(DIGESTS[digest_text(text)] == name for name, text in SHORT.items()) and len(DIGESTS) == len(LONG) + len(SHORT)


def test_holders_and_titles_do_not_matter():
    bsd = SHORT["BSD-3-Clause"]
    other = "BSD 3-Clause License\n\nCopyright (c) 2011, Some Lab\nAll rights reserved.\n\n" + bsd.replace("1. Red", "* Red").replace("2. Red", "* Red").replace("3. Neither", "* Neither")
    other = other.replace("the name of the copyright holder nor", "the name of The Regents of Some University nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "SOME LAB, INC.")
    numbered = other.replace("* Red", "1. Red", 1).replace("* Red", "2. Red", 1).replace("* Neither", "3. Neither")
    assert DIGESTS[digest_text(numbered)] == "BSD-3-Clause" and digest_text(other) != digest_text(numbered)  # numbers are text
    assert DIGESTS[digest_text("The MIT License (MIT)\n\nCopyright 2001 X\n\n" + SHORT["MIT"])] == "MIT"
    assert digest_text(bsd.replace("without specific prior", "with specific prior")) not in DIGESTS


def test_licences_planted_in_documents(spark, tmp_path):
    """Whole licences as documents and inside of them, against the SQL and what was planted."""
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    docs, want, i = [], {}, 0
    for name, text in SHORT.items():
        for shape, licence in ((text, name), (f"{name.split('-')[0]} License\nCopyright 2020 A. B.\n" + wrap(text, 9) if name in ("MIT", "ISC") else wrap(text, 9), name), ("Some words of a package.\n\n" + wrap(text.upper(), 12) + "\n\nMore words, after it.", None), (text[: len(text) - 40], None), ("x" + text + "y", None)):
            docs.append((i, shape))
            # the words around make the first or last word another one, unless the anchor or the end is a sign
            want[i] = (licence, name if licence or shape.startswith("Some words") else "")
            i += 1
    docs.append((i, SHORT["MIT"] + "\n\n" + SHORT["ISC"] + "\n\n" + SHORT["MIT"]))
    want[i] = (None, "ISC,MIT")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["licence"], r["blocks"]) for r in scan_licences(df).collect()}
    assert {k: v for k, v in got.items() if k in want and v != want[k]} == {}
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = c.execute(ORACLES["op7_license_scan"])
    names = [d[0] for d in sql.description]
    own = scan_licences(df)
    assert python_free(own) and sorted(map(repr, (tuple(r[n] for n in names) for r in own.collect()))) == sorted(map(repr, sql.fetchall()))


def test_long_texts_are_scanned_whole(spark):
    text = ("word " * 400_000) + "\n" + SHORT["ISC"] + "\n" + "word " * 400_000
    row = scan_licences(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row["blocks"] == "ISC" and row["licence"] is None and row["digest"] == digest_text(text)
