"""Corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from cohortlake.llm.licences import scan
from cohortlake.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = QUERIES[name](spark, DATA)
    found = con.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[at[c]] for c in got.columns) for r in found.fetchall())


def test_licences(spark):
    rows = [
        (1, "Foo. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "x"),
        (2, "All rights reserved.\nReleased under the MIT License!", "x"), (3, None, "x"), (4, "", "x"), (5, "No licensed thing. " * 5000, "x"), (2, "All rights reserved.\nReleased under the MIT License!", "x"),
    ]
    got = sorted(tuple(r) for r in scan(spark.createDataFrame(rows, "doc_id long, text string, known string")).collect())
    both = (2, 2, "reserved,mit", "MIT,all-rights-reserved")
    assert got == [(1, 2, "apache2,apachefile", "Apache-2.0"), both, both, (3, 0, "", ""), (4, 0, "", ""), (5, 0, "", "")]
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = """MIT License

Copyright (c) 2019 Some Body

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """// Copyright 2020 The Authors
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License."""
BSD = """Copyright (c) 1998, The Example Board. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """3. Neither the name of the Example Board nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
NOTICES = [
    (MIT, "MIT"), (" ".join(MIT.split()), "MIT"), (APACHE, "Apache-2.0"), (BSD + NAMES, "BSD-3-Clause,all-rights-reserved"), (BSD, "BSD-2-Clause,all-rights-reserved"), (MPL, "MPL-2.0"), (GPL, "GPL-3.0-or-later"),
    (GPL.replace("version 3", "version 2").replace("software:", "software;"), "GPL-2.0-or-later"), ("Licensed under CC BY 4.0\nsome other line", "CC-BY-4.0"), ("Redistribution and use of water is permitted.", ""),
]


def test_notices_as_they_are_written(spark):
    texts = [(i, t) for i, (t, _) in enumerate(NOTICES)] + [(i + 100, t.replace("\n", "\r\n")) for i, (t, _) in enumerate(NOTICES)]
    got = {r.doc_id: tuple(r) for r in scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: got[i][3] for i in got} == {i: NOTICES[i % 100][1] for i, _ in texts}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert {r[0]: r for r in con.execute(f"SELECT doc_id, n_known, known, licences FROM ({SQL['op10_licences']})").fetchall()} == got
