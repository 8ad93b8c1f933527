"""Licence scans by sentence rules.

A text is normalised, with its lines' and sentences' ends kept, and known licence sentences are
looked up in it, wrapped or not; the identifiers found, in order, are matched against licence rules.  A rule is a sequence of
identifiers; rules are tried in their order, and what one matches is taken out before the next.
Known sentences that no rule takes are reported as they are.  DataFrame functions alone do the work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of licence sentences and the normalised sentences that they stand for.
SENTENCES = {
    "Apache2Under": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "Apache2Only": ["you may not use this file except in compliance with the license"],
    "Apache2Copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "Apache2Basis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "Apache2See": ["see the license for the specific language governing permissions and limitations under the license"],
    "MitUnder": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "the mit license mit"],
    "MitGrant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "BsdRedistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "BsdUnder": ["licensed under the bsd license", "released under the bsd license"],
    "Gpl3Under": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ],
    "Gpl2Under": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "GplFree": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "GplHope": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    ],
    "GplReceived": ["you should have received a copy of the gnu general public license along with this program"],
    "Cc0Under": ["licensed under cc0 1 0", "licensed under cc0"],
    "CcByUnder": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CcBySaUnder": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CcByNcUnder": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CcByNdUnder": ["licensed under cc by nd 4 0"],
    "AllRights": ["all rights reserved"],
}
# Licences and the identifier sequences that state them, in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["Apache2Under", "Apache2Only", "Apache2Copy", "Apache2Basis", "Apache2See"]),
    ("Apache-2.0", ["Apache2Under", "Apache2Only", "Apache2Copy"]),
    ("Apache-2.0", ["Apache2Under"]),
    ("MIT", ["MitUnder", "MitGrant", "MitNotice"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitUnder"]),
    ("BSD-2-Clause", ["BsdRedistribution", "BsdSource", "BsdBinary"]),
    ("BSD", ["BsdUnder"]),
    ("GPL-3.0-or-later", ["GplFree", "GplHope", "GplReceived"]),
    ("GPL-3.0-or-later", ["GplFree"]),
    ("GPL-3.0", ["Gpl3Under"]),
    ("GPL-2.0", ["Gpl2Under"]),
    ("CC0-1.0", ["Cc0Under"]),
    ("CC-BY-4.0", ["CcByUnder"]),
    ("CC-BY-SA-4.0", ["CcBySaUnder"]),
    ("CC-BY-NC-4.0", ["CcByNcUnder"]),
    ("CC-BY-ND-4.0", ["CcByNdUnder"]),
    ("Proprietary", ["AllRights"]),
]
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation either version {} of the license or at your option any later version"
# As above, what the SQL of op3 doesn't know; no given table has them.
MORE_SENTENCES = {
    "BsdEndorse": [
        f"neither the name of {x} may be used to endorse or promote products derived from this software without specific prior written permission"
        for x in ("the copyright holder nor the names of its contributors", "copyright holder nor the names of its contributors", "the copyright holders nor the names of its contributors", "the university nor the names of its contributors")
    ],
    "IscGrant": [
        f"permission to use copy modify {x}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        for x in ("and or ", "and ")
    ],
    "Mpl2Subject": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "Gpl2Free": ["this program " + _FREE.format("", 2).replace("  ", " ")],
    "Lgpl21Free": [f"this {x} " + _FREE.format("lesser", "2 1") for x in ("library", "program")],
    "Lgpl3Free": [f"this {x} " + _FREE.format("lesser", 3) for x in ("library", "program")],
    "AgplFree": ["this program " + _FREE.format("affero", 3)],
    "UnlicenseFree": ["this is free and unencumbered software released into the public domain"],
    "BoostUnder": ["distributed under the boost software license version 1 0", "boost software license version 1 0"],
    "BoostGrant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    ],
    "ZlibLiable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "ZlibGrant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    ],
    "Epl2Made": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
}
_UNDER = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license"
MORE_SENTENCES |= {
    "AsfGranted": ["licensed to the apache software foundation asf under one or more contributor license agreements"],
    "AsfNotice": ["see the notice file distributed with this work for additional information regarding copyright ownership"],
    "AsfUnder": ["the asf licenses this file to you under the apache license version 2 0 the license"],
    "Apache2Title": ["apache license version 2 0 january 2004"],
    "Gpl2Only": [_UNDER.format("program", "") + x for x in (" version 2 as published by the free software foundation", " as published by the free software foundation version 2 of the license")],
    "Gpl3Only": [_UNDER.format("program", "") + x for x in (" version 3 as published by the free software foundation", " as published by the free software foundation version 3 of the license")],
    "Gpl2Title": ["gnu general public license version 2 june 1991"],
    "Gpl3Title": ["gnu general public license version 3 29 june 2007"],
    "Lgpl21Title": ["gnu lesser general public license version 2 1 february 1999"],
    "Lgpl3Title": ["gnu lesser general public license version 3 29 june 2007"],
    "Mpl2Title": ["mozilla public license version 2 0"],
    "BsdStyle": [f"use of this source code is governed by a bsd style license that can be found in the license{x}" for x in (" file", "")],
    "MitStyle": ["use of this source code is governed by an mit style license that can be found in the license file or at https opensource org licenses mit", "use of this source code is governed by an mit style license that can be found in the license file"],
}
# Names of licences that a tag line of a source file may give.
SPDX = (
    "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC MPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later Unlicense BSL-1.0 Zlib EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0"
).split()
MORE_SENTENCES |= {"Tag" + re.sub("[^A-Za-z0-9]", "", x): ["spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower())] for x in SPDX}
MORE_RULES = [
    ("Apache-2.0", ["AsfGranted", "AsfNotice", "AsfUnder", "Apache2Only", "Apache2Copy", "Apache2Basis", "Apache2See"]),
    ("Apache-2.0", ["AsfUnder", "Apache2Only", "Apache2Copy", "Apache2Basis", "Apache2See"]),
    ("Apache-2.0", ["AsfUnder"]),
    ("Apache-2.0", ["Apache2Title"]),
    ("GPL-2.0-only", ["Gpl2Only", "GplHope", "GplReceived"]),
    ("GPL-2.0-only", ["Gpl2Only"]),
    ("GPL-3.0-only", ["Gpl3Only", "GplHope", "GplReceived"]),
    ("GPL-3.0-only", ["Gpl3Only"]),
    ("GPL-2.0", ["Gpl2Title"]),
    ("GPL-3.0", ["Gpl3Title"]),
    ("LGPL-2.1", ["Lgpl21Title"]),
    ("LGPL-3.0", ["Lgpl3Title"]),
    ("MPL-2.0", ["Mpl2Title"]),
    ("BSD", ["BsdStyle"]),
    ("MIT", ["MitStyle"]),
    ("BSD-3-Clause", ["BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("ISC", ["IscGrant"]),
    ("MPL-2.0", ["Mpl2Subject"]),
    ("GPL-2.0-or-later", ["Gpl2Free", "GplHope", "GplReceived"]),
    ("GPL-2.0-or-later", ["Gpl2Free"]),
    ("LGPL-2.1-or-later", ["Lgpl21Free"]),
    ("LGPL-3.0-or-later", ["Lgpl3Free"]),
    ("AGPL-3.0-or-later", ["AgplFree"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("BSL-1.0", ["BoostUnder", "BoostGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostUnder"]),
    ("Zlib", ["ZlibLiable", "ZlibGrant"]),
    ("EPL-2.0", ["Epl2Made"]),
    *((x, ["Tag" + re.sub("[^A-Za-z0-9]", "", x)]) for x in SPDX),
]
#: Fixed value: a text that has none of these words in any case has no known sentence.
HINT = r"(?i)licen[cs]e|copyright ownership|permi|held liable|redistribut|warrant|reserved|unencumbered"
#: What begins a line of a comment, an empty line, a line's end, and a mark before white space or the text's end.
COMMENT, EMPTY_LINE, LINE_END, MARK = r"(?m)^[ \t]*(?:<!--|/?\*+/?|//+|#+|;+|--+|%+)[ \t]*", r"\n[ \t]*\r?\n[ \t\r\n]*|\r{2,}", r"[\n\r]+", r"[.;:!?](?=\s|$)"


#: Where a program's name, of up to six words, stands in a sentence, and how a tag line joins names.
NAMED = [
    (r"(?<=[|/])(?:[a-z0-9]+[ /]){1,6}?(?=(?:is[ /]free[ /]software[ /]you[ /]can[ /]redistribute|is[ /]distributed[ /]in[ /]the[ /]hope)[ /])", "this program "),
    (r"(?<=license[ /]along[ /]with)[ /](?:[a-z0-9]+[ /]){0,5}[a-z0-9]+(?=[|/])", " this program"),
]
TAG, PLUS = r"(?<=spdx license identifier[ /][a-z0-9 ]{1,300})", r"(spdx-license-identifier:[^\r\n]*?\d)\+"
JOINED = [(TAG + r" with [a-z0-9 ]+?(?=[|/]| or | and )", ""), (TAG + r" (?:or(?! later)|and) ", "/spdx license identifier ")]


def _known() -> dict[str, str]:
    return {sentence: name for some in (SENTENCES, MORE_SENTENCES) for name, sentences in some.items() for sentence in sentences}


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A known sentence begins and ends where a line or a sentence does; inside it may be wrapped or
    have marks, but no empty line.  A program's own name stands for "this program" in the sentences of the
    GNU licences.  Licences that a tag line joins by AND or OR count each, a plus as "or later", and what
    WITH adds is left out.
    """
    known = _known()
    of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # \u0002, then |, ends a paragraph; \u0001, then /, a line or a sentence
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), PLUS, "$1 or later"), COMMENT, "")
    plain = F.regexp_replace(F.translate(plain, "\u0001\u0002", "  "), EMPTY_LINE, "\u0002")
    plain = F.regexp_replace(F.regexp_replace(plain, MARK, "\u0001"), LINE_END, "\u0001")
    plain = F.regexp_replace(plain, "[^a-z0-9\u0001\u0002]+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, " *\u0002[ \u0001\u0002]*| *\u0001[ \u0001]*\u0002[ \u0001\u0002]*", "|"), " *\u0001[ \u0001]*", "/")
    plain = F.concat(F.lit("|"), F.trim(plain), F.lit("|"))
    for pattern, instead in NAMED + JOINED:
        plain = F.regexp_replace(plain, pattern, instead)
    any_of = "|".join(s.replace(" ", "[ /]") for s in sorted(known, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(plain, F.lit(rf"(?<=[|/])(?:{any_of})(?=[|/])"), F.lit(0))
    return F.transform(found, lambda s: F.element_at(of, F.translate(s, "/", " ")))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sentence_ids``, ``licenses`` and ``unmatched`` for each row of ``docs``.

    ``sentence_ids`` are the known sentences in order, joined by commas; ``licenses`` the distinct
    licences in order of their first rules; ``unmatched`` how many known sentences no rule took.  A
    text without known sentences, an empty one and null have empty strings and 0.  Whole texts are
    scanned; other columns are left out; repeated rows stay repeated.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = F.when(text.rlike(HINT), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids"))
    rows = rows.withColumn("left", F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit(","), x, F.lit(",")))))
    names: dict[str, list[str]] = {}
    for number, (name, sequence) in enumerate(MORE_RULES + RULES):
        pattern = F.lit("".join(f",{x}," for x in sequence))
        rows = rows.withColumn(f"rule_{number}", F.contains("left", pattern)).withColumn("left", F.replace("left", pattern, F.lit("|")))
        names.setdefault(name, []).append(f"rule_{number}")
    found = [F.when(F.expr(" OR ".join(columns)), F.lit(name)) for name, columns in names.items()]
    return rows.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.concat_ws(",", *found).alias("licenses"),
        F.size(F.filter(F.split("left", "[,|]+"), lambda x: x != "")).cast("long").alias("unmatched"),
    )
