
import pytest
from compare import difference, spark_rows, sql_rows

from flowtables.llm import licenses
from flowtables.llm.queries import op1_licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
CASES = [
    (MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), ("words\n" + MIT + "\nmore words. " + APACHE, ["MIT", "Apache-2.0"]),
    ("Released under the MIT License.", ["MIT"]),
    ("Some words\nLicensed under the Apache License, Version 2.0.\nAnd more", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("LICENSED!! UNDER!! CC!! BY-NC!! 4.0.!! NEXT!!", ["CC-BY-NC-4.0"]),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\n", ["GPL-2.0-or-later"]),
    ("It is not released under the MIT License.", []), ("", []), (None, []), ("A licence to walk.", []),
    ("Released under the\nMIT License.\n\nAll rights reserved.", ["MIT", "All-Rights-Reserved"]),
    ("Permission is granted.\n" * 2000 + "Released under the MIT licence", ["MIT"]),
    ("\x01 Released under the MIT License \x01", ["MIT"]),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(CASES)] + [(None, "x", 1)],
                                 "doc_id long, text string, licenses int")


def test_cases(cases):
    rows = {r.doc_id: r for r in licenses.scan(cases).collect()}
    assert len(rows) == len(CASES) + 1
    for at, (text, expected) in enumerate(CASES):
        assert rows[at].licenses == expected, (text, rows[at])
    assert rows[0].unmatched == [] and rows[0].sentences == ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]


def test_a_parted_run_is_not_the_rule(spark):
    parted = GPL.replace("This program is dist", "Unknown words. This program is dist").replace(
        "This program is free software: ", "")
    row, = licenses.scan(spark.createDataFrame([(1, "Copyright 2026 A.\n\n" + parted)], "doc_id long, text string")).collect()
    assert row.unmatched == ["GplNoWarranty"] or "GplNoWarranty" not in row.sentences


def test_every_sentence_holds_an_anchor_and_every_rule_known_sentences():
    known = {name for name, _ in licenses.SENTENCES}
    assert len(known) == len(licenses.SENTENCES)
    for name, words in licenses.SENTENCES:
        assert any(anchor in words.replace("licen[cs]e", "license") for anchor in licenses.ANCHORS), name
    assert all(set(names) <= known for _, names in licenses.RULES)


def test_sql_agrees(spark, cases, tmp_path):
    path = str(tmp_path / "documents.parquet")
    cases.where("doc_id is not null").coalesce(1).write.parquet(path)
    import duckdb
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    result = op1_licenses(spark, str(tmp_path))
    assert difference(spark_rows(result), sql_rows(connection, licenses.scan_sql("documents"))) is None


def test_empty_table(cases):
    assert licenses.scan(cases.limit(0)).count() == 0



BSD_2 = """Copyright (c) 2026 A. Owner.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
RECEIVED = """
    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL_2 = GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
AGPL = (GPL + RECEIVED).replace("General", "Affero General")
LGPL = (GPL_2 + RECEIVED).replace("General", "Lesser General").replace("program", "library").replace("version 2", "version 2.1")
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def commented(text):
    return "/*\n" + "".join(f" * {line}\n" for line in text.split("\n")) + " */"


TEXTS = [
    (BSD_2 + BSD_END, ["BSD-2-Clause"]), (BSD_3 + BSD_END, ["BSD-3-Clause"]), (commented(BSD_3 + BSD_END), ["BSD-3-Clause"]),
    (BSD_3.replace("1. ", "(a) ").replace("2. ", "b) ").replace("3. ", "* ") + BSD_END, ["BSD-3-Clause"]),
    (GPL + RECEIVED, ["GPL-3.0-or-later"]), (commented(GPL), ["GPL-3.0-or-later"]),
    ("Foo Bar" + (GPL + RECEIVED).replace("    This program is free", " is free"), ["GPL-3.0-or-later"]),
    (GPL_2 + RECEIVED, ["GPL-2.0-or-later"]), (AGPL, ["AGPL-3.0-or-later"]),
    (LGPL, ["LGPL-2.1-or-later"]), (LGPL.replace("version 2.1", "version 3"), ["LGPL-3.0-or-later"]),
    ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007",
     ["LGPL-3.0-only"]),
    (MPL, ["MPL-2.0"]), (BSD_3.replace("1. R", "Unknown. R"), []),
]
TAGS = [
    ("MIT", ["MIT"]), ("AGPL-3.0-only", ["AGPL-3.0-only"]), ("LGPL-2.1-or-later", ["LGPL-2.1-or-later"]),
    ("GPL-2.0", ["GPL-2.0-only"]), ("GPL-2.0+", ["GPL-2.0-or-later"]), ("CC-BY-SA-4.0", ["CC-BY-SA-4.0"]),
    ("MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("(MIT AND (LGPL-3.0+ OR BSD-2-Clause))", ["MIT", "LGPL-3.0-or-later", "BSD-2-Clause"]),
    ("GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only"]), ("Unknown-1.0 OR ISC", ["ISC"]),
]


def found_licenses(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {texts[r.doc_id]: r for r in rows}


def test_canonical_texts_give_their_licence_and_leave_no_sentence(spark):
    found = found_licenses(spark, [text for text, _ in TEXTS])
    for text, expected in TEXTS:
        assert found[text].licenses == expected, (text, found[text])
        assert not expected or found[text].unmatched == [], (text, found[text])


def test_spdx_tags_and_expressions(spark):
    tags = {f"# SPDX-License-Identifier: {tag}\nwords {at}": expected for at, (tag, expected) in enumerate(TAGS)}
    found = found_licenses(spark, list(tags))
    for text, expected in tags.items():
        assert sorted(found[text].licenses) == sorted(expected), (text, found[text])


def test_the_scan_knows_every_sentence_of_its_rules():
    known = dict(licenses.KNOWN)
    assert set(dict(licenses.SENTENCES)) <= set(known)
    assert all(set(names) <= set(known) for _, names in licenses.ORDERED)
    for name, words in known.items():
        assert any(anchor in words.replace("licen[cs]e", "license") for anchor in licenses.ANCHORS), name


LINES = [
    ("Released under the MIT License\nLicensed under CC BY-NC 4.0\nReleased under the MIT License",
     ["MIT", "CC-BY-NC-4.0", "MIT"]),
    ("Licensed under CC BY 4.0\nsome words\nReleased under\nthe MIT License\n# SPDX-License-Identifier: ISC OR MIT",
     ["CC-BY-4.0", "MIT", "ISC", "MIT"]),
    ("All rights reserved\nReleased under the MIT License\nAll rights reserved",
     ["All-Rights-Reserved", "MIT", "All-Rights-Reserved"]),
    ("Released under the MIT License\n" + GPL, ["MIT", "GPL-3.0-or-later"]),
    ("This program is free software:\n" + GPL[GPL.index("you can"):], ["GPL-3.0-or-later"]),
    ('Licensed under the Apache License, Version 2.0\n(the "License");\nyou may not use it', ["Apache-2.0"]),
    ("This is free and unencumbered software\nreleased into the public domain.", ["Unlicense"]),
]


def test_lines_of_one_block_are_told_in_the_order_of_the_text(spark):
    found = found_licenses(spark, [text for text, _ in LINES])
    for text, expected in LINES:
        assert found[text].licenses == expected, (text, found[text])


def test_an_unknown_line_parts_a_rule(spark):
    parted = "Released under the Apache License, Version 2.0\n{}You may not use this file except in compliance with the License"
    found = found_licenses(spark, [parted.format(""), parted.format("Other words\n")])
    assert [r.unmatched for r in found.values()] == [[], ["ApacheUse"]]


def test_sql_agrees_on_every_text_of_these_tests(spark, tmp_path):
    import duckdb
    texts = [text for text, _ in CASES + TEXTS + LINES]
    texts += [f"# SPDX-License-Identifier: {tag}\nMIT OR ISC" for tag, _ in TAGS]
    texts += ["x spdx-license-identifier: MIT OR ISC SPDX-License-Identifier: Zlib\n1. All rights reserved"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    connection = duckdb.connect()
    documents.write.parquet(str(tmp_path / "d"))
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    found = {r.doc_id: (",".join(r.sentences), ",".join(r.licenses), len(r.unmatched))
             for r in licenses.scan(documents).collect()}
    expected = {row[0]: row[1:] for row in connection.sql(licenses.scan_sql("documents")).fetchall()}
    for at, text in enumerate(texts):
        assert found[at] == expected[at], text


def test_a_long_expression_keeps_all_its_licences(spark):
    text = "# SPDX-License-Identifier: " + " OR ".join(["MIT", "ISC", "GPL-2.0+"] * 300)
    row, = found_licenses(spark, [text]).values()
    assert row.licenses == ["MIT", "ISC", "GPL-2.0-or-later"] * 300


def test_a_megabyte_of_open_lines_takes_seconds(spark):
    import time
    texts = ["the name of acme license may\n" * 36_000, "copyright the holders of license\n" * 32_000]
    found_licenses(spark, ["warm license"])
    started = time.perf_counter()
    rows = found_licenses(spark, texts)
    assert time.perf_counter() - started < 10
    assert all(r.licenses == [] for r in rows.values())


def test_every_form_of_a_sentence_holds_its_needed_word():
    assert licenses.needed_word("(a|b) of the( only)? (mit|x11) licen[cs]e .*") == "the"
    for name, words in licenses.KNOWN:
        assert licenses.needed_word(words) in words
