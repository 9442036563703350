"""Standard licence notices as they are published, wrapped and unwrapped."""

import re

import pytest

from tapeworks.llm import licences, queries

MIT = """MIT License

Copyright (c) 2024 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def unwrapped(text):
    return re.sub(r"(?<!\n)\n(?!\n)\s*", " ", text)


def commented(text):
    return "/*\n" + "".join(f" * {x}\n" for x in text.split("\n")) + " */"


FORMS = [(form(text), licence) for text, licence in ((MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL, "GPL"), (GPL.replace("software:", "software;"), "GPL"), (BSD, "BSD-3-Clause"))
         for form in (str, unwrapped, commented)]
TEXTS = FORMS + [
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-only.", "GPL-3.0"), ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier: MIT-0", ""), ("an SPDX-License-Identifier:\nMIT", ""),
    ("Some words. Licensed under the\nApache License, Version 2.0. More", "Apache-2.0"), ("not released under the\nMIT license at all", ""),
    (MIT.split("The above")[0], ""), (None, ""), ("", ""),
]


@pytest.fixture(scope="module")
def answers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("notices")
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: r for r in queries.QUERIES["op6_licence_rules"](spark, str(folder)).collect()}


def test_standard_notices(answers):
    assert [answers[i].licences for i in range(len(TEXTS))] == [w for _, w in TEXTS]


def test_found_names_them(answers):
    assert answers[0].found.split(",")[-1] == "notice-mit"


def test_the_sentence_cut_stays(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    plain = {r.doc_id: r for r in licences.scan(df).collect()}
    whole = {r.doc_id: r for r in licences.scan(df, notices=True).collect()}
    for i, r in plain.items():
        assert whole[i].n_sentences == r.n_sentences and whole[i].found[:len(r.found)] == r.found
