"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, equivalent spellings made one, copyright lines
dropped, and every run of other characters than letters and digits made one blank. A copyright line
starts with "copyright", a copyright sign, "(c)" and a year, or "all rights reserved"; up to three short
lines that go on with it up to a blank line belong to it. "copyright notice", "copyright holder" and the
like are words of the text wherever its lines are broken. Who holds the rights, in the clauses of BSD
licences that name them, is an equivalent spelling. The SHA-256 of a whole canonical text is hash-joined with the digests of known licence
texts; the same form of each single line is looked up among the digests of known short notices,
which stand on lines of their own.

The known texts are a table (license_id, kind, text), in which text is a whole text (kind text), a
line (notice) or the digest of a canonical whole text (digest). The canonical forms are made by the
same functions. The table is broadcast only after its rows are counted (MAX_KNOWN); a larger one is
joined by a shuffle of digests. Up to MAX_LITERALS notices are looked for within each row, which
needs no shuffle; for more, lines are exploded and joined.

Defined results: null and empty texts have the digest of the empty text and no licence; equal
digests of several known ids give the smallest id; repeated rows give one row each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_KNOWN = 20_000
MAX_LITERALS = 500

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Public licence texts with the titles that can stand over them.
TEXTS = [
    ("MIT", _MIT_GRANT, ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"]),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_REST, ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"]),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_REST, ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"]),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License"]),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL, ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"]),
    ("Apache-2.0", _APACHE_HEADER, []),
]
#: Digests of the canonical forms of public licence texts that are too long to stand here, as they
#: are handed out: whole, and the terms alone without the notes on how to apply them.
DIGESTS = [
    ("Apache-2.0", "a4104a41a24135ce8dfc9dc56dc54cec41dab42ba12b678f3610496b122c19bc"),
    ("Apache-2.0", "f463a0c9c863e559dd4d7d502aa602aaff98541aedae3e2739c7e6b6676040ad"),
    ("Artistic-1.0-Perl", "313e762683f376abbeb26c7663f6f9c4dfbb78b057c562a9f7c3cc5932f736d3"),
    ("CC0-1.0", "62e920150e2d1bd4b328c5c3262ef18bb204ad0958eb66ea54a54ae073e919eb"),
    ("GFDL-1.2", "ef237abcb2be2056870d8b76d36198fcaacfaac4c1036e433891ad078983ce6e"),
    ("GFDL-1.3", "4372df16b6726668c5034fe0c3935b94b5053bfcf8642414e9afda627ab599cd"),
    ("GPL-1.0", "5d066e785097948c01295d2b92037d8af9b33cd7cdb0dee35d918342cfcd7f3d"),
    ("GPL-1.0", "c2562261766ab2136e20a9b4c7e25806c9ca9f663ade612fa3951f323276bed3"),
    ("GPL-2.0", "0e57f7a87329e7246bf6d2f048a709a9d36840a293b940fc82715987516c2f9e"),
    ("GPL-2.0", "dd99917a63687fa37e82a94f2eeef573940f293bcbc338a58410a41d6b4cbe5a"),
    ("GPL-3.0", "7fa88e447cd47e85d9563f7d63c3e23ade41bf5bc4c00c5ec31c6f85b3aa0bbb"),
    ("GPL-3.0", "825bbd25299c4e503eaa505c4ae12a1592e45cb9656c1a00ed622fa09290c1b6"),
    ("LGPL-2.0", "9f9deba515bf03baeb9e4f15989b3d1d7abd6c62414224c0a5fda21e6d62b273"),
    ("LGPL-2.0", "f6b5625c84368aa2d169a08c9e2a3e48fd8d090391e997c20be747c2e02e6ab4"),
    ("LGPL-2.1", "5b44f970cd10f98d9e6e02de53171649ca809fef7da08dd3761656b4cf2fde9f"),
    ("LGPL-2.1", "c07101b32732ec4a0bcf362fea6f66a402c751004740f02248c0fe93f7851cd0"),
    ("LGPL-3.0", "b04e6811100107e4ec8597ddc03f88865cb81c1d0e4ce63200e0073faf70b0a1"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "e73e7c7830a812629e7e4196181bb400dada3785e812e5f0ea9713911db2f1fe"),
    ("Unlicense", "a5969a20696c6e38b4b7aa3ae5be84a9dae9145919909a94d9b08fd287636df7"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
]
#: Ids of licences and names that short notices use for them.
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)"], "ISC": ["ISC License"], "0BSD": ["Zero-Clause BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"], "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"], "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"], "EPL-2.0": ["Eclipse Public License 2.0"], "EUPL-1.2": ["European Union Public Licence 1.2"], "BSL-1.0": ["Boost Software License 1.0"], "PSF-2.0": ["Python Software Foundation License"], "Unlicense": ["Unlicense"], "Zlib": ["zlib License"], "WTFPL": ["WTFPL"],
    "Artistic-2.0": ["Artistic License 2.0"], "CC0-1.0": ["CC0 1.0"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
#: What notices say before the name, and behind it.
_SAYS = ["Licensed under", "Released under", "Distributed under", "This project is licensed under", "This work is licensed under", "This software is licensed under"]
_FILE = "see the LICENSE file for details"


def notices() -> list[tuple[str, str, str]]:
    """Short notices of every licence: its identifier line, also of a GNU version alone or a later one, and sentences with its names."""
    out = []
    for i, names in NAMES.items():
        out += [(i, "notice", f"SPDX-License-Identifier: {i}{x}") for x in (["", "-only", "-or-later", "+"] if "GPL" in i else [""])]
        the = "" if i.startswith("CC") else "the "
        out += [(i, "notice", f"{say} {the}{name}") for name in names for say in _SAYS]
        out += [(i, "notice", f"This project is licensed under {the}{name} - {_FILE}") for name in names]
    return out


#: Whole texts and digests; notices follow by rule.
KNOWN = [(i, "text", f"{title}\n\n{text}") for i, text, titles in TEXTS for title in ["", *titles]] + [(i, "digest", d) for i, d in DIGESTS] + notices()
#: Spellings that count as equal.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"), ("cpr owner", "cpr holder"), ("organisation", "organization"), ("favour", "favor"), ("labour", "labor"), ("whilst", "while"), ("per cent", "percent")]
#: Words after "copyright" that make it a word of the text.
_PROSE = "\\bcopyright\\s+(notice|holder|owner|law|license|licence|permission|statement|interest|claim|treat|protect|disclaim|status|act\\b|and\\b|or\\b|in\\b|of\\b|to\\b|is\\b|as\\b|for\\b|on\\b|under\\b)"
_COPYRIGHT = "(?m)^[^\\p{L}\\p{N}\\n]*(?:copyright(?:[ \\t:]|$)|©|\\(c\\)[ \\t]*(?:[0-9]{4}|copyright)|all rights reserved)[^\\n]*$"
#: A copyright line with the short lines that go on with it, up to a blank one.
_BLOCK = _COPYRIGHT[:-1] + "(?:\\n[ \\t]*[^\\s][^\\n]{0,49}){1,3}\\n[ \\t\\r]*\\n"
#: Clauses of a canonical form that name who holds the rights, and how they count.
HOLDERS = [
    (words.replace(" ", "[ \\n]+"), standard)
    for words, standard in [
        ("neither the names? of(?: \\S+){1,20}? nor the names of (?:(?:its|their|the) )?contributors", "neither the name of holders nor the names of contributors"),
        ("provided by(?: \\S+){1,20}? as is", "provided by holders as is"),
        ("shall(?: \\S+){1,20}? be liable for any direct", "shall holders be liable for any direct"),
    ]
]


def canonical(text: Column) -> Column:
    """The canonical form; line ends are kept."""
    t = F.lower(F.coalesce(text, F.lit("")))
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _PROSE, "cpr $1"), _BLOCK, "\n\n"), _COPYRIGHT, "")
    t = F.when(t.contains("opyright") | t.contains("©") | t.contains("(c)") | t.contains("all rights reserved"), lines).otherwise(t)
    t = F.regexp_replace(t, "[^\\p{L}\\p{N}\\n]+", " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    named = t
    for pattern, standard in HOLDERS:
        named = F.regexp_replace(named, pattern, standard)
    return F.when(t.contains("contributors"), named).otherwise(t)


def whole(canon: Column) -> Column:
    """One line of words, from a canonical form."""
    return F.trim(F.regexp_replace(canon, "[ \\n]+", " "))


def known(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or KNOWN, "license_id string, kind string, text string")


def scan(df: DataFrame, table: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null if the whole text is no known licence), notices (ids, comma-joined)."""
    from turnloom.llm.common import checkpointed

    table = known(df.sparkSession) if table is None else table
    made = F.when(F.col("kind") == "digest", F.col("text")).otherwise(F.sha2(whole(canonical(F.col("text"))), 256))
    table = table.select("license_id", F.replace("kind", F.lit("digest"), F.lit("text")).alias("kind"), made.alias("digest"))
    digests = checkpointed(table.groupBy("kind", "digest").agg(F.min("license_id").alias("license_id")))
    small = digests.count() <= MAX_KNOWN
    docs = df.select(df[key].alias("doc_id"), canonical(df[text]).alias("canon"))
    docs = docs.select("doc_id", F.sha2(whole(F.col("canon")), 256).alias("digest"), F.filter(F.split("canon", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    docs = docs.withColumn("seen", F.array_distinct(F.transform("lines", lambda x: F.sha2(F.trim(x), 256)))).drop("lines")
    texts = digests.where("kind = 'text'").select("digest", "license_id")
    docs = docs.join(F.broadcast(texts) if small else texts, "digest", "left")
    notices = digests.where("kind = 'notice'").select(F.col("digest").alias("nd"), F.col("license_id").alias("nid"))
    if notices.count() <= MAX_LITERALS:
        pairs = [(r.nd, r.nid) for r in notices.collect()]
        ids = F.lit("")
        if pairs:
            names = F.create_map(*[F.lit(x) for p in sorted(pairs) for x in p])
            ids = F.array_join(F.array_sort(F.array_distinct(F.transform(F.array_intersect("seen", F.array(*[F.lit(p[0]) for p in pairs])), lambda d: names[d]))), ",")
        return docs.select("doc_id", "digest", "license_id", ids.alias("notices"))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    hit = rows.select("row", F.explode("seen").alias("nd")).join(F.broadcast(notices) if small else notices, "nd").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("nid")), ",").alias("notices"))
    return rows.join(hit, "row", "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
