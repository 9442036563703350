"""Licence scans by sentence rules.

DataFrame functions only, one pass without a shuffle. A text is cut into sentences; each is
normalised and looked up among the known licence sentences; the identifiers found, in order,
are matched against ordered rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A licence, its kind, and the sentence identifiers that must follow one another."""

    licence: str
    kind: str
    sentences: tuple[str, ...]


# Known licence sentences, normalised (lower case, letters, digits and dots
# inside words, one space), by identifier.
SENTENCES: dict[str, str] = {
    "apache2-line": "licensed under the apache license version 2.0",
    "apache2-you-may-not": "you may not use this file except in compliance with the license",
    "apache2-copy-at": "you may obtain a copy of the license at",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "mit-line": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-line": "licensed under cc by nc 4.0",
    "cc-by-line": "licensed under cc by 4.0",
    "cc-by-sa-line": "licensed under cc by sa 4.0",
    "reserved": "all rights reserved",
    "public-domain": "this work is in the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache2": "spdx license identifier apache 2.0",
    "spdx-gpl3": "spdx license identifier gpl 3.0 only",
}

# Ordered rules over the identifiers.
RULES: tuple[Rule, ...] = (
    Rule("Apache-2.0", "permissive", ("apache2-line",)),
    Rule("Apache-2.0", "permissive", ("apache2-you-may-not", "apache2-copy-at", "apache2-as-is")),
    Rule("Apache-2.0", "permissive", ("spdx-apache2",)),
    Rule("MIT", "permissive", ("mit-line",)),
    Rule("MIT", "permissive", ("mit-licensed",)),
    Rule("MIT", "permissive", ("mit-grant", "mit-notice", "as-is")),
    Rule("MIT", "permissive", ("spdx-mit",)),
    Rule("GPL-3.0", "copyleft", ("gpl3-line",)),
    Rule("GPL-3.0", "copyleft", ("spdx-gpl3",)),
    Rule("GPL", "copyleft", ("gpl-free", "gpl-hope")),
    Rule("BSD-3-Clause", "permissive", ("bsd-redistribute", "bsd-names")),
    Rule("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-line",)),
    Rule("CC-BY-4.0", "permissive", ("cc-by-line",)),
    Rule("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-line",)),
    Rule("all-rights-reserved", "reserved", ("reserved",)),
    Rule("public-domain", "permissive", ("public-domain",)),
)


@dataclass(frozen=True)
class Notice:
    """A standard notice: passages, normalised like sentences, that stand in this order in a text."""

    name: str
    licence: str
    kind: str
    passages: tuple[str, ...]


# The standard notices, which run over lines, colons and semicolons.
NOTICES: tuple[Notice, ...] = (
    Notice("notice-apache2", "Apache-2.0", "permissive", (
        "licensed under the apache license version 2.0 the license", SENTENCES["apache2-you-may-not"],
        SENTENCES["apache2-copy-at"], SENTENCES["apache2-as-is"])),
    Notice("notice-mit", "MIT", "permissive", (SENTENCES["mit-grant"], SENTENCES["mit-notice"], SENTENCES["as-is"])),
    Notice("notice-gpl", "GPL", "copyleft", (SENTENCES["gpl-free"], SENTENCES["gpl-hope"])),
    Notice("notice-bsd3", "BSD-3-Clause", "permissive", (
        SENTENCES["bsd-redistribute"],
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")),
)

# SPDX identifiers, by licence and kind.
SPDX: dict[str, tuple[str, str]] = {
    "mit": ("MIT", "permissive"),
    "apache-2.0": ("Apache-2.0", "permissive"),
    "gpl-3.0-only": ("GPL-3.0", "copyleft"),
}

#: Ends of sentences where wrapped lines are joined: end marks, and empty lines.
JOINED_BREAK = r"[.!?][\x20\x09-\x0D]+|[.!?]$|\n[\x20\x09-\x0D]*\n"
SPDX_LINE = r"spdx-license-identifier:[\x20\t]*([^\n\r]*)"
#: Ends of sentences: an end mark before white space or the end of the text, or a line end.
BREAK = r"[.!?;:][\x20\x09-\x0D]+|[.!?;:]$|\n"
#: What normalising turns into one space: all but letters, digits and dots inside numbers.
NOISE = r"[^a-z0-9.]+"


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def _normal(lower: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(lower, NOISE, " ")), r"\.+(?= |$)", "")


def sentences(text: Column, ends: str = BREAK) -> Column:
    """The normalised sentences of a text, in order, without empty ones."""
    return F.array_remove(F.transform(F.split(_lower(text), ends), _normal), "")


def _holds_any(lower: Column, sentences: list[str]) -> Column:
    """Whether a text can hold one of the normalised sentences: the longest word of one is in it."""
    words = sorted({max(s.split(" "), key=len) for s in sentences})
    return F.greatest(*[F.contains(lower, F.lit(w)) for w in words], F.lit(False), F.lit(False))


def _noticed(flat: Column, spdx: Column) -> Column:
    """(name, licence, kind) of the standard notices in a normalised text, and of SPDX identifiers."""
    found = []
    for n in NOTICES:
        at = F.lit(1)
        for p in n.passages:  # 0, where a passage is missing, stays 0
            at = F.call_function("locate", F.lit(f" {p} "), flat, at)
        found.append((at > 0, n.name, n.licence, n.kind))
    found += [(F.array_contains(spdx, i), f"spdx-{i}", *v) for i, v in SPDX.items()]
    return F.array_compact(F.array(*[F.when(c, F.struct(
        F.lit(n).alias("name"), F.lit(l).alias("l"), F.lit(k).alias("k"))) for c, n, l, k in found]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         known: dict[str, str] | None = None, rules: tuple[Rule, ...] = RULES, notices: bool = False) -> DataFrame:
    """One row per row of docs: id, n_sentences, found (identifiers in order), licences, kinds.

    A rule matches where its identifiers follow one another among those found, without another
    known sentence between them (unknown text may stand between). With notices, a rule also
    matches in the text whose wrapped lines are joined, and the standard notices and SPDX
    identifiers count, whichever way their lines are wrapped; their names follow in found.
    licences and kinds are sorted and distinct. known and rules are small tables that go into
    the plan as literals. A null or empty text has no sentences; ids may be null or repeat;
    other columns are ignored; an empty table gives no rows.
    """
    known = SENTENCES if known is None else known
    names = list(known)
    texts = F.array(*[F.lit(known[n]) for n in names])
    labels = F.array(*[F.lit(n) for n in names])

    def identifiers(s: str) -> Column:
        # a sentence that is not known has position 0
        hits = F.filter(F.transform(s, lambda x: F.array_position(texts, x).cast("int")), lambda p: p > 0)
        return F.transform(hits, lambda p: F.element_at(labels, p))

    def line(found: Column) -> Column:
        return F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    if not notices:
        df = df.select("id", sentences(F.col("t")).alias("s"))
    else:
        none = F.array().cast("array<string>")
        tags = F.flatten(F.transform(F.regexp_extract_all("l", F.lit(SPDX_LINE)), lambda x: F.split(
            F.regexp_replace(x, r"\.+(?![a-z0-9])", ""), r"[^a-z0-9.+-]+")))
        # most texts hold none of the words, and are cut once
        df = df.select("id", "t", _lower(F.col("t")).alias("l"))
        df = df.select(
            "id", sentences(F.col("t")).alias("s"),
            F.when(_holds_any(F.col("l"), list(known.values())), sentences(F.col("t"), JOINED_BREAK)).otherwise(none).alias("j"),
            F.when(_holds_any(F.col("l"), [n.passages[-1] for n in NOTICES]), F.concat(F.lit(" "), _normal(F.col("l")), F.lit(" "))).otherwise("").alias("flat"),
            F.when(F.contains("l", F.lit("spdx-license-identifier:")), tags).otherwise(none).alias("spdx"))
        df = df.select("id", "s", "j", F.when((F.col("flat") != "") | (F.size("spdx") > 0), _noticed(F.col("flat"), F.col("spdx"))).otherwise(
            F.array().cast("array<struct<name:string,l:string,k:string>>")).alias("n"))
    found = {"found": identifiers("s")} | ({"joined": identifiers("j")} if notices else {})
    df = df.select("id", F.size("s").cast("long").alias("n_sentences"), *[c.alias(n) for n, c in found.items()], *(["n"] if notices else []))
    lines = F.concat(*[line(F.col(n)) for n in found])  # "||" parts the two cuts
    given = [F.when(F.contains(lines, F.lit("|" + "|".join(r.sentences) + "|")), F.struct(F.lit(r.licence).alias("l"), F.lit(r.kind).alias("k"))) for r in rules]
    df = df.withColumn("m", F.array_compact(F.array(*given)))
    if notices:
        df = df.withColumns({"m": F.concat("m", F.transform("n", lambda x: F.struct(x["l"].alias("l"), x["k"].alias("k")))),
                             "found": F.concat("found", F.transform("n", lambda x: x["name"]))})
    return df.select(
        F.col("id").alias(id_col), "n_sentences", "found",
        F.array_sort(F.array_distinct(F.transform("m", lambda x: x["l"]))).alias("licences"),
        F.array_sort(F.array_distinct(F.transform("m", lambda x: x["k"]))).alias("kinds"),
    )
