"""Licence rules against a plain version."""

import re

import duckdb
from odd_rows import ROWS

from tapeworks.llm import licences, queries


def brute(text, known, rules):
    flat = [re.sub(r"[^a-z0-9.]+", " ", s).strip(" ") for s in re.split(licences.BREAK, (text or "").lower())]
    flat = [s for s in (re.sub(r"\.+(?= |$)", "", s) for s in flat) if s]
    names = {v: k for k, v in known.items()}
    found = [names[s] for s in flat if s in names]
    hits = [r for r in rules if any(tuple(found[i:i + len(r.sentences)]) == r.sentences for i in range(len(found)))]
    return len(flat), found, sorted({r.licence for r in hits}), sorted({r.kind for r in hits})


TEXTS = [
    "Some words. Licensed under the Apache License, Version 2.0.",
    "RELEASED UNDER THE MIT LICENSE.\nother text\nAll rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. "
    "Unknown between! The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. The software is provided \"as is\", without warranty of any kind, express or implied.",
    # out of order, and with a known sentence between: no match
    "You may obtain a copy of the License at: you may not use this file except in compliance with the License;\n",
    "Licensed under CC BY-NC 4.0. " * 3,
    "SPDX-License-Identifier: MIT",
    "mit license",
]


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in licences.scan(df).orderBy("doc_id").collect()]
    want = [brute(t, licences.SENTENCES, licences.RULES) for t in TEXTS]
    assert got == want
    assert [g[2] for g in got] == [["Apache-2.0"], ["MIT", "all-rights-reserved"], ["MIT"], [], ["CC-BY-NC-4.0"], [], []]


def test_order_matters(spark):
    known = {"a": "one two", "b": "three four", "c": "five"}
    rules = (licences.Rule("L", "k", ("a", "b")), licences.Rule("M", "k", ("b", "a")), licences.Rule("N", "m", ("a", "a")))
    texts = ["One two. three four.", "three, four! x. one-two.", "one two; five. three four", "one two\none two", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licences for r in licences.scan(df, known=known, rules=rules).orderBy("doc_id").collect()]
    assert got == [["L"], ["M"], [], ["N"], []]


def test_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.n_sentences, r.found) for r in licences.scan(odd).collect()), key=str)
    assert got == sorted(((i, *brute(t, licences.SENTENCES, licences.RULES)[:2]) for i, t, *_ in ROWS), key=str)
    assert licences.scan(empty).count() == 0


def test_rules_name_known_sentences():
    assert all(s in licences.SENTENCES for r in licences.RULES for s in r.sentences)


def test_documents_and_sql(spark, sf, documents):
    name = "op6_licence_rules"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in rel.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(rel.fetchall())
    want = {r.doc_id: brute(r.text, licences.SENTENCES, licences.RULES) for r in documents.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan(documents).collect()}
    assert got == want
    assert any(v[2] for v in want.values())
