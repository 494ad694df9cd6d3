"""License scan by canonical digest: whole texts are normalised and their SHA-256 is joined to the digests of known texts.

Normalising lower-cases A-Z, drops copyright lines, makes equivalent spellings one, and keeps only letters and digits with
single spaces (so comment marks and line breaks don't matter). Looked up are the document as a whole, each of its lines, and each of its
blocks of several lines (a notice at the head of a file). Known texts are ``KNOWN_TEXTS`` and the files of ``known_licenses``,
each as it is, without what follows its terms, and without its title; known notices are ``KNOWN_NOTICES``. All of these are constant, so their
broadcast has a fixed size. ``SPDX-License-Identifier`` marks are read as they are, with any identifier or expression.

Defined results: a null or empty text has no license; a text of copyright lines alone has none; repeated rows, null ids and
other columns do not matter (columns are ignored, rows are kept); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import ascii_lower, staged, table

#: Spellings that the license-matching guidelines call equivalent, after lower-casing.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "https": "http",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public license texts by SPDX id (title, copyright lines and numbering are left out or covered by a variant).
KNOWN_TEXTS: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_NO_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_NO_WARRANTY}"),
    ("0BSD", f"{_GRANT}.\n\n{_NO_WARRANTY}"),
    ("BSD-2-Clause", "\n\n".join([_BSD_HEAD, "1. " + _BSD_1, "2. " + _BSD_2, _BSD_END])),
    ("BSD-2-Clause", "\n\n".join([_BSD_HEAD, "* " + _BSD_1, "* " + _BSD_2, _BSD_END])),
    ("BSD-3-Clause", "\n\n".join([_BSD_HEAD, "1. " + _BSD_1, "2. " + _BSD_2, "3. " + _BSD_3, _BSD_END])),
    ("BSD-3-Clause", "\n\n".join([_BSD_HEAD, "* " + _BSD_1, "* " + _BSD_2, "* " + _BSD_3, _BSD_END])),
]
#: One-line notices by SPDX id.
KNOWN_NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", _MIT.split("\n\n")[0]),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies."),
    *[
        (f"{short}-{version}.0-or-later", f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.")
        for short, name, what in (("GPL", "General Public License", "program"), ("LGPL", "Lesser General Public License", "library"), ("AGPL", "Affero General Public License", "program"))
        for version, mark, comma in (("2", ";", ";"), ("3", ":", ","))
        if (short, version) != ("AGPL", "2")
    ],
]

#: Where the terms of a license end and advice on how to use it begins.
_AFTER_TERMS = ["END OF TERMS AND CONDITIONS", "APPENDIX: How to apply", "How to Apply These Terms", "ADDENDUM: How to use", "EXHIBIT A", "Exhibit A"]


def known_texts() -> list[tuple[str, str]]:
    """The known texts with their variants: without what follows the terms, without the title above the first blank line."""
    out = list(KNOWN_TEXTS)
    for file in sorted((Path(__file__).parent / "known_licenses").glob("*.txt")):
        text = file.read_text()
        ends = [len(text)]
        for mark in _AFTER_TERMS:
            at = text.find(mark)
            if at > 0:
                ends += [at, at + len(mark)]
        for end in ends:
            own = text[:end].strip()
            out += [(file.stem, own), (file.stem, own.partition("\n\n")[2] or own)]
    return out


#: A line that begins with a copyright sign or word and goes on with a year, a sign or a name in brackets.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]|<|\[|by )[^\n]*"
NOT_LETTER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F ‐-‧“-‟←-⯿]+"


def normalise(text: str) -> str:
    """The same steps as ``canonical`` for one text; used for the known texts alone."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    low = re.sub(NOT_LETTER, " ", re.sub(COPYRIGHT_LINE, r"\1", low))
    return " ".join(EQUIVALENT.get(w, w) for w in low.split(" ") if w)


def canonical(text: Column) -> Column:
    """Words of the normalised text, joined by spaces."""
    low = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "$1")
    words = F.array_remove(F.split(low, NOT_LETTER), "")
    same = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(same[w], w)), " ")


def _digest(text: str) -> str:
    return hashlib.sha256(normalise(text).encode()).hexdigest()


def known_digests() -> list[tuple[str, str]]:
    return sorted({_digest(t): x for x, t in known_texts() + KNOWN_NOTICES}.items())


#: Every known notice has one of these words; looking only at such lines and blocks saves normalising the others.
LIKELY = "(?i)licen|spdx|rights|source code|cc0|permission"
#: Between blocks: a line with nothing but comment marks.
BLANK = r"\n[ \t*#/;-]*\n"
SPDX = r"(?i)SPDX-Licen[cs]e-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?: +(?:AND|OR|WITH) +[A-Za-z0-9.+-]+)*)"


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: the license its whole text is (or null), and the licenses of its notices, sorted, with their number.

    The digests of the text, its lines and its blocks are exploded and joined to the known ones, and only those found are grouped.
    """
    known = docs.sparkSession.createDataFrame(known_digests(), "digest string, license string")  # a constant table
    rows = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    notice = lambda units: F.transform(F.filter(units, lambda x: x.rlike(LIKELY)), lambda x: F.struct(F.lit(1).alias("kind"), F.sha2(canonical(x), 256).alias("digest")))
    blocks = F.filter(F.split("text", BLANK), lambda x: F.contains(F.btrim(x, F.lit("\n")), F.lit("\n")))
    whole = F.struct(F.lit(0).alias("kind"), F.sha2(canonical(F.col("text")), 256).alias("digest"))
    units = F.explode(F.concat(F.array(whole), notice(F.split("text", "\n")), notice(blocks)))
    spdx = F.regexp_extract_all("text", F.lit(SPDX), 1)
    own = rows.select("id", "row", spdx.alias("spdx"), units.alias("u")).select("id", "row", "u.*", F.when(F.col("u.kind") == 0, F.col("spdx")).alias("spdx"))
    own = staged(own.join(F.broadcast(known), "digest", "left").where("kind = 0 OR license IS NOT NULL"), "licenses")
    notices = own.where("kind = 1").groupBy("row").agg(F.count("*").alias("n_notices"), F.collect_set("license").alias("notices"))
    out = own.where("kind = 0").drop("kind").join(notices, "row", "left")
    none = F.array().cast("array<string>")
    names = F.array_sort(F.array_distinct(F.concat(F.coalesce("notices", none), "spdx")))
    return out.select(F.col("id").alias(key), F.col("license").alias("text_license"), (F.coalesce("n_notices", F.lit(0)) + F.size("spdx")).cast("long").alias("n_notices"), names.alias("notices"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text_license", "n_notices", F.array_join("notices", ",").alias("notices"))


def oracle_sql() -> dict[str, str]:
    low = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    line = COPYRIGHT_LINE.replace("'", "''")
    marks = NOT_LETTER.replace(r" ", " ").replace(r"‐-‧", "‐-‧").replace(r"“-‟", "“-‟").replace(r"←-⯿", "←-⯿")
    same = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in EQUIVALENT.items()) + "}"
    words = f"list_filter(string_split_regex(regexp_replace({low}, '{line}', '\\1', 'g'), '{marks}'), lambda x: x <> '')"
    digest = lambda t: f"sha256(array_to_string(list_transform({words.format(t=t)}, lambda x: coalesce({same}[x], x)), ' '))"
    known = ", ".join(f"('{d}', '{x}')" for d, x in known_digests())
    notices = ", ".join(f"('{d}', '{x}')" for d, x in sorted({_digest(t): x for x, t in KNOWN_NOTICES}.items()))
    blank, spdx = BLANK, SPDX
    sql = f"""
WITH known(digest, license) AS (VALUES {known}), notice(digest, license) AS (VALUES {notices}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, license FROM (SELECT r, {digest("text")} AS digest FROM d) JOIN known USING (digest)),
u AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
  UNION ALL SELECT r, line FROM (SELECT r, unnest(string_split_regex(text, '{blank}')) AS line FROM d) WHERE contains(trim(line, chr(10)), chr(10))),
l AS (SELECT r, license FROM (SELECT r, {digest("line")} AS digest FROM u) JOIN notice USING (digest)
  UNION ALL SELECT r, unnest(regexp_extract_all(text, '{spdx}', 1)) FROM d),
n AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l GROUP BY r)
SELECT doc_id, license AS text_license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices FROM d LEFT JOIN w USING (r) LEFT JOIN n USING (r)"""
    return {"op4_license_scan": sql}
