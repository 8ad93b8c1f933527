"""Page texts and licence scans on cases whose results are known."""

import re

import pytest
from pyspark.sql import functions as F

from roamgrid.llm import html_text, licenses, registry
from tests.llm.samples import DOCUMENTS, ODD, no_documents, odd_documents

PAGES = "page_id long, url string, html string, host string, paths string, text string"
BODY = "<p>The first paragraph of the article has a fair number of words in it.</p><p>The second   one\n goes &amp; on, with <b>bold</b> words and a <a href='/x'>link</a>.</p>"
BOILER = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><header><h2>Site name</h2></header>"
CLOSING = "<div class='comments'><p>A reader says that this is a long and friendly comment.</p></div><footer>All about us and our many friends.</footer>"
TEXT = "The first paragraph of the article has a fair number of words in it.\nThe second one goes & on, with bold words and a link."


def page(body, css="post-12"):
    return f"<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body>{BOILER}<div class='{css}'>{body}</div><aside>Read more of this.</aside><script>if (a < b) x('<p>no</p>')</script>{CLOSING}</body></html>"


def test_one_page():
    assert html_text.parse(page(BODY)).text() == TEXT
    assert html_text.parse(page(BODY)).path(html_text.parse(page(BODY)).container()) == "div.post-#"


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        (None, ""),
        ("just words", "just words"),
        ("<p>a<p>b<br>c<!-- <p>no</p> -->d", "a\nb\ncd"),
        ("<p>&lt;b&gt; &#233;&nbsp;x &unknown; &amp;amp;</p>", "<b> é x &unknown; &amp;"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<script>never closed <p>x</p>", ""),
        ("<p title='a > b'>kept</p><p title=\"it's\">too</p>", "kept\ntoo"),
        ("<p>a</p></div></div><p>b</p>", "a\nb"),
        ("<form><p>fill this in</p></form><p>text</p>", "text"),
        ("<p>open <a href='x", "open"),
    ],
)
def test_small_sources(source, text):
    assert html_text.parse(source).text() == text


def test_hosts(spark):
    urls = ["https://www.Example.com/a", "http://user@example.com:80/", "example.com/a", None, "ftp://b.org?x", "https:///x"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(html_text.host_of(F.col("url"))).collect()]
    assert got == ["example.com", "example.com", None, None, "b.org", None]


def test_the_hosts_paths_outvote_a_page(spark):
    """On one page a sidebar without telling names is longer than the article."""
    box = "<div class='x9'><p>" + "These other words stand beside the article and say a great deal. " * 5 + "</p></div>"
    layout = lambda i, extra: f"<html><body><div class='main-{i}'>{BODY}</div>{extra}</body></html>"
    rows = [(i, f"https://a.org/{i}", layout(i, ""), None, None, None) for i in range(20)] + [(99, "https://a.org/99", layout(99, box), None, None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert set(got.values()) == {TEXT}
    alone = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows[-1:], PAGES)).collect()}
    assert alone[99] != TEXT


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep down</p>"
    rows = [(1, None, page(BODY)), (1, None, page(BODY)), (None, "https://b.org/", ""), (2, "https://b.org/", None), (3, "", deep), (4, "https://b.org/", "<p>" + "long words " * 200_000)]
    got = html_text.extract(spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, len(TEXT)), (1, len(TEXT)), (0, 0), (2, 0), (3, 9), (4, 2_199_999)])
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_whole_table_has_every_page(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = registry.op4_html_text(spark, sf)
    assert got.count() == pages.count() and got.where("n_chars <> length(text)").count() == 0
    assert got.where("text <> ''").count() >= 0.8 * pages.where("length(html) > 500").count()


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_licences(spark):
    grant, notice = licenses.SENTENCES["MitGrant"][0], licenses.SENTENCES["MitNotice"][0]
    apache = ["Licensed under the Apache License, Version 2.0", licenses.SENTENCES["Apache2Only"][0], licenses.SENTENCES["Apache2Copy"][0]]
    got = scan(
        spark,
        f"Some words. {grant.upper()}: More words!\n{notice}.",
        f"{notice}. {grant}.",  # in the wrong order no rule takes them
        "\n".join(apache) + "\nAll rights reserved.",
        "Licensed under CC BY 4.0\nLicensed under CC-BY-4.0.",
        "A licence is permitted here, with no known sentence.",
        "",
        None,
    )
    assert got[0] == ("MitGrant,MitNotice", "MIT", 0)
    assert got[1] == ("MitNotice,MitGrant", "", 2)
    assert got[2] == ("Apache2Under,Apache2Only,Apache2Copy,AllRights", "Apache-2.0,Proprietary", 0)
    assert got[3] == ("CcByUnder,CcByUnder", "CC-BY-4.0", 0)
    assert got[4:] == [("", "", 0)] * 3


def test_licences_in_odd_rows(spark):
    assert licenses.scan(odd_documents(spark)).count() == len(ODD)
    assert licenses.scan(no_documents(spark)).count() == 0


def test_every_sentence_and_rule_is_reachable():
    known = licenses._known()
    assert all(s == re.sub("[^a-z0-9]+", " ", s).strip() and re.search(licenses.HINT, s) for s in known)
    assert {x for _, sequence in licenses.RULES for x in sequence} <= set(licenses.SENTENCES)


@pytest.mark.parametrize(
    "wrapper",
    ["div class='content-sidebar-wrap'", "div class='no-sidebar'", "div class='container side'", "div class='social-science'", "section class='discussion'", "div id='print-area'", "form action='/x'"],
)
@pytest.mark.parametrize("inner", ["article", "div class='text'"])
def test_marked_wrappers_hold_the_article(wrapper, inner):
    tag = wrapper.split()[0]
    source = f"<body>{BOILER}<{wrapper}><{inner}>{BODY}</{inner.split()[0]}>{CLOSING}</{tag}><div><p>Made here.</p></div></body>"
    got = html_text.parse(source).text().split("\n")
    assert all(line in got for line in TEXT.split("\n")) and not any("reader says" in line or "friends" in line for line in got)


def test_a_marked_page_is_not_empty():
    assert html_text.parse("<div class='widget'><p>One half of it.</p></div><div class='popup'><p>The other half.</p></div>").text() == "One half of it.\nThe other half."


def test_no_share_of_the_article_is_cut(spark):
    """A lead, a small second section and prose beside a table stay, though all pages of the host vote alike."""
    say = lambda n, what: "<p>" + f"{what} words go on. " * n + "</p>"
    bodies = [
        f"<article><h1>Title</h1><p class=lead>The lead.</p>{say(1, 'Lead')}<div class=body>{say(9, 'Body')}</div></article>",
        f"<main><section class=a>{say(9, 'First')}</section><section class=b>{say(2, 'Second')}</section></main>",
        f"<div class=text>{say(2, 'Prose')}<table><tr><td>{say(9, 'Table')}</td></tr></table></div>",
    ]
    wants = [["Title", "The lead.", "Lead", "Body"], ["First", "Second"], ["Prose", "Table"]]
    rows = [(10 * k + i, f"https://h{k}.org/{i}", f"<html><body>{BOILER}{body}{CLOSING}</body></html>", None, None, None) for k, body in enumerate(bodies) for i in range(4)]
    # a host's minority layout, in which the path of most pages holds a third of the article
    major, minor = f"<div class=main>{say(6, 'Major')}</div>", f"<div class=main>{say(3, 'Part')}</div><div class=more>{say(6, 'Rest')}</div>"
    rows += [(100 + i, f"https://z.org/{i}", f"<body>{minor if i < 2 else major}</body>", None, None, None) for i in range(40)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k, want in enumerate(wants):
        assert all(w in got[10 * k + i] for w in want for i in range(4))
    assert all(w in got[100 + i] for w in ("Part", "Rest") for i in range(2)) and "Major" in got[139]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """The MIT License (MIT)

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it."


def test_wrapped_licences(spark):
    lesser = GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
    affero = GPL.replace("GNU General", "GNU Affero General")
    texts = [APACHE, MIT, BSD, BSD + ENDORSE, GPL, ISC, MPL, lesser, affero, UNLICENSE, GPL.replace("version 3", "version 2")]
    want = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "ISC", "MPL-2.0", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "Unlicense", "GPL-2.0-or-later"]
    for mark in ("", " * ", "# ", "// ", ";; ", "-- "):
        got = scan(spark, *("\r\n".join(mark + line for line in t.split("\n")) for t in texts))
        assert [r[1] for r in got] == want, mark


def test_licences_in_hostile_texts(spark):
    """Long runs of line ends, blanks and marks neither exhaust the stack nor the time."""
    mit = "Released under the MIT License."
    texts = [mit + "\n" * 200_000 + "x", "x\n" + " " * 200_000 + "\n\n" + mit, "license. " * 50_000 + "\n" + mit, "*" * 200_000 + "\n" + "/ *" * 50_000 + "\r\r" + mit, "\r\n \t\r\n" * 50_000 + mit]
    assert [r[1:] for r in scan(spark, *texts)] == [("MIT", 0)] * len(texts)


def test_tags_and_more_notices(spark):
    got = scan(
        spark,
        "// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}",
        "/* SPDX-License-Identifier: MIT */\n# SPDX-License-Identifier:\n#   BSD-3-Clause",
        "//    Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)",
        "  This software is provided 'as-is', without any express or implied\n  warranty.  In no event will the authors be held liable for any damages\n  arising from the use of this software.\n\n  Permission is granted to anyone to use this software for any purpose,\n  including commercial applications, and to alter it and redistribute it\n  freely, subject to the following restrictions:",
        " * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n",
    )
    assert [set(r[1].split(",")) for r in got] == [{"GPL-2.0-or-later"}, {"MIT", "BSD-3-Clause"}, {"BSL-1.0"}, {"Zlib"}, {"EPL-2.0"}]


ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 *
 *    http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
FREE = """# {name} is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License{version}
#
# {name} is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
#
# You should have received a copy of the GNU General Public License
# along with {name}."""
LATER = " as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
HEADERS = [
    (ASF, "Apache-2.0"),
    (FREE.format(name="Foo", version=LATER), "GPL-3.0-or-later"),
    (FREE.format(name="The Bar 2 tool box", version=LATER), "GPL-3.0-or-later"),
    (FREE.format(name="This program", version=" version 2 as\n# published by the Free Software Foundation."), "GPL-2.0-only"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", "GPL-3.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
    ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", "BSD"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only"),
    ("# SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0+\nx = 1", "BSD-3-Clause,GPL-2.0-or-later,MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Linux-syscall-note OR MIT */", "GPL-2.0-or-later,MIT"),
]


def test_real_headers(spark):
    rows = spark.createDataFrame([(i, text, None, None, None) for i, (text, _) in enumerate(HEADERS)], DOCUMENTS)
    got = {r.doc_id: (",".join(sorted(r.licenses.split(","))), r.unmatched) for r in licenses.scan(rows).collect()}
    for i, (_, want) in enumerate(HEADERS):
        assert got[i][0] == want, (i, got[i])
    # the address below a copy's sentence belongs to none
    assert all(n == 0 for _, n in got.values())
