"""Licences as they stand in repositories: wrapped, titled, with notices."""

import textwrap

from weft.llm.licenses import BSD, BSD_3, ISC, KNOWN, MIT, full_texts, known_licenses, scan_licenses


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


ISC_LINES = ISC.replace("granted, provided that the above copyright notice", "granted, provided that the above\ncopyright notice")


def test_wrapped_titled_and_whole_texts(spark):
    full = full_texts()
    assert {"Apache-2.0", "GPL-2", "GPL-3", "LGPL-3", "MPL-2.0"} <= set(full) and all(len(t) > 500 for t in full.values())
    cases = [
        ("Copyright (c) 2020, Jane Doe\n\n" + ISC_LINES, "ISC"),
        ("ISC License\n\nCopyright (c) 2020, Jane Doe\n\n" + ISC_LINES, "ISC (titled)"),
        ("The MIT License (MIT)\n\nCopyright © 2020 Jane Doe\n\n" + MIT, "MIT (titled)"),
        ("Copyright (c) 2020 Jane Doe. All rights reserved. " + MIT.replace("\n\n", " "), "MIT"),
        ("Copyright Jane Doe\nAll rights reserved.\n\n" + MIT, "MIT"),
        ("BSD 3-Clause License\n\nCopyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + wrapped(BSD % BSD_3, 72), "BSD-3-Clause (titled)"),
        ("Copyright 2020 Jane Doe\n\n" + wrapped(BSD % "", 60), "BSD-2-Clause"),
        ("copyright notice and this permission notice shall appear", None),
        ("Copyright (c) 2020 Jane Doe\n\n" + MIT + "\n\nand more", None),
    ]
    cases += [(wrapped(MIT, w), "MIT") for w in range(30, 100, 7)] + [(wrapped(ISC, w), "ISC") for w in range(30, 100, 7)]
    cases += [(full[name].replace("\n", "\r\n"), name) for name in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-3", "MPL-2.0")]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in scan_licenses(docs, known_licenses(spark)).collect()}
    assert [(k, got[k]) for k in range(len(cases))] == [(k, want) for k, (_, want) in enumerate(cases)]


def test_the_sql_has_the_same_canonical_form(spark):
    """Every known text with notices, titles and wrapped lines, in Spark and in DuckDB."""
    import duckdb

    from weft.llm.queries import OP8_SQL

    texts = list((KNOWN | full_texts()).values())
    wrapped = [textwrap.fill(t, 64) for t in texts]
    noticed = ["Copyright (c) 2019 A. Person\nCopyright 2020-2021 Other Holder. All rights reserved.\n# Copyright Third Party\n\n" + t for t in wrapped]
    odd = ["The MIT License (MIT)\n\n" + wrapped[0], "Copyright (c) 2020 One. " + texts[0], "  // (c) 1999 Somebody\ncopyright notice stays\nCopyright Notice stays\nall rights reserved.\nx", None, ""]
    rows = list(enumerate(texts + wrapped + noticed + odd))
    got = {r.doc_id: (r.digest, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_licenses(spark)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    want = {d: (digest, license) for d, digest, license in con.execute(f"SELECT doc_id, digest, license FROM ({OP8_SQL})").fetchall()}
    assert {d for d in got if got[d] != want[d]} == set()
    assert sum(x[1] is not None for x in got.values()) > 2 * len(texts)


def test_licenses_of_odd_tables(spark):
    """No documents, a very long text, a licence inside one, and clashing columns."""
    known = known_licenses(spark)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string"), known).count() == 0
    long = "word " * 200_000
    rows = [(1, long, "x"), (2, long + MIT, "x"), (3, "\n\n" * 50_000 + MIT, "x")]
    got = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string"), known).collect()}
    assert got == {1: None, 2: None, 3: "MIT"}
