"""Known license texts, wrapped at many widths and signed, keep their digest."""

import re
import textwrap

from cohortloom.llm import licenses
from cohortloom.llm.queries import op6_license_scan

SIGNED = ["Copyright (c) 2020 Jane Doe", "Copyright 2019-2021 The Authors", "Copyright Jane Doe", "(c) 2001 Jane Doe", "Copyright: Jane Doe", "(C) Copyright Jane Doe", "All rights reserved."]


def wrapped(text, width):
    """Paragraphs wrapped anew, but for those with a license's own copyright line or a sample of one."""
    return "\n\n".join(p if re.search(r"(?i)copyright \(c\)|\[yyyy\]", p) else textwrap.fill(p, width) for p in text.split("\n\n"))


def found(spark, texts, rows):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    notes = licenses.known(spark, licenses.KNOWN_NOTICES)
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, licenses.known(spark, texts), notes).collect()}
    return [(name, text[:90]) for k, (name, text) in enumerate(rows) if got[k] != name]


def test_wrapped(spark):
    texts = licenses.KNOWN_TEXTS
    rows = [(name, wrapped(text, w)) for name, text in texts for w in range(30, 100)]
    rows += [(name, f"{line}\n\n{text}") for name, text in texts for line in SIGNED]
    assert found(spark, texts, rows) == []


def test_query_knows_common_licenses(spark, tmp_path):
    texts = dict(licenses.more_texts())
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0", "Zlib", "BSL-1.0"} <= set(texts)
    rows = [(name, wrapped(text, w)) for name, text in licenses.more_texts() for w in (43, 72, 80)]
    rows += [(name, f"{text}\n\n# SPDX-License-Identifier: Apache-2.0") for name, text in [(None, "x = 1"), (None, "Licensed under the MPL")]]
    rows += [(None, "Licensed under the BSD 3-Clause License\nmore text")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r for r in op6_license_scan(spark, str(tmp_path)).collect()}
    assert [(n, t[:80]) for k, (n, t) in enumerate(rows) if got[k].license_id != n] == []
    assert [got[k].notices for k in range(len(rows) - 3, len(rows))] == ["Apache-2.0", "Apache-2.0", "BSD-3-Clause"]


def test_same_as_sql_on_tables(spark, sf):
    """The SQL knows the first texts and notices only; the given tables have no others."""
    import duckdb

    from cohortloom.llm.queries import oracle_sql

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(oracle_sql()["op6_license_scan"]).fetchall()
    assert sorted(map(tuple, op6_license_scan(spark, sf).collect()), key=repr) == sorted(want, key=repr)


def test_sql_knows_the_same(spark):
    """The query's SQL and its operator, over every known text and notice, as they are, signed, and in other letters and line ends."""
    import duckdb
    import pyarrow as pa

    from cohortloom.llm import queries

    docs = [None, "", "copyright notice and permission\nfoo", "Copyright the Foo Group 2012\nMIT License", "copyright: John\nx", "copyright {name}\nx", "(c) item of list\nx", "(c) copyright foo", "  ©\tz\nx", "Copyright by law"]
    for _, t in licenses.more_texts():
        docs += [t, "Copyright (c) 2020 Foo\nCopyright 2021 by Bar\n" + t.upper(), "(c) 2019 X\n© y\nAll rights reserved.\n" + t.replace("\n", "\r\n")]
    docs += [n if k % 2 else f"x\n  {n.upper()}  \ny" for k, (_, n) in enumerate(licenses.more_notices())]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [*range(len(docs))], "text": pa.array(docs, pa.string())}))
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, text_digest, license_id, notices FROM ({queries.oracle_sql()['op6_license_scan']})").fetchall()}
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in licenses.scan_licenses(df, licenses.known(spark, licenses.more_texts()), licenses.known(spark, licenses.more_notices())).collect()}
    assert got == want and sum(r[1] is not None for r in got.values()) > 100
