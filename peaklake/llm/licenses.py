"""Operator 10: license scan by canonical digest lookup.

A text is brought to a canonical form (case, lines that state a copyright, equivalent spellings, punctuation and white
space), hashed whole, and hash-joined with the digests of known license texts, which went through the same form. The
same lookup is made for the lines of a document, because a notice is usually one line under other text. Only lines with a
word that some known form cannot do without are brought to the canonical form at all (``anchors``); the others match nothing.
Digests are staged beside row numbers and joined with the known ones by size; texts stay where they are.

Defined results: a null text counts as empty; empty texts and lines match nothing; null and repeated ids and repeated
rows give one row each; if two known texts share a canonical form, the alphabetically first name is reported; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peaklake.llm.common import text_or_empty, workspace

Texts = list[tuple[str, str]] | DataFrame | None

ANCHORED_FORMS = 20_000  # with more known forms than that, every line is looked up
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What follows the word in running text, as opposed to a year, a sign or a name: such lines state no copyright.
PROSE = (
    "holders?|owners?|owned|ownership|notices?|licen[cs]\\w*|laws?|acts?|statements?|interests?|protect\\w*|infring\\w*|disclaimers?"
    "|permissions?|rights?|claims?|grants?|registrations?|materials?|works?|treat(?:y|ies)|status|management"
    "|and|or|in|to|of|on|is|are|as|for|with|under|the above|this|that|which|shall|must|may|will|not|you|your|if|any|all|each|every|no|use"
)

#: Applied in this order to the lower-cased text; each is understood alike by Java and by RE2. The first marks running
#: text, so that the second takes only lines that state a copyright; the fourth joins lines, so that no later step
#: depends on line breaks; the last removes the marks.
STEPS = (
    (rf"(\bcopyright[ \t\r\n*#/;-]+|\(c\)[ \t]+)({PROSE})\b", "\x01$1$2"),
    (r"(?m)^[ \t*#/;-]*(copyright|\(c\)|©)([ \t:,\x01-]*([0-9<\[{©&]|\(c\)|\([0-9])|[ \t:]+([a-z]|[^\x00-\x7f]))[^\n]*$", ""),
    (r"(?m)^[ \t*#/;-]*all rights reserved[. ]*$", ""),
    (r"[ \t\r]*\n[ \t\r\n*#/;-]*|[ \t]{2,}", " "),
    (r"\blicen[cs](e|es|ed|ing)\b", "licens$1"),
    (r"\bsub-?licen[cs]e\b", "sublicense"),
    (r"\bcopyright (owner|holder)s?\b", "copyright holder"),
    (r"\b(organi|reali|recogni|authori)s(e|ed|ation|ing)\b", "$1z$2"),
    (r"\b(favour|behaviour|honour)\b", "$1"),
    (r"\bversion ([0-9])", "v$1"),
    (r"\bv ?([0-9]+)([.]0)?\b", "v$1"),
    (r"\bnoncommercial\b|\bnon commercial\b", "non-commercial"),
    (r"\bhttps?://(www[.])?", ""),
    (r"&", " and "),
    (r"[\x00-/:-@\[-`{-\x7f]+", " "),
)

#: Names of licenses and the forms in which notices give them.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
NOTICES = (
    "{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "Distributed under the {}",
    "This software is released under the {}", "SPDX-License-Identifier: {}",
)

#: Whole texts of short licenses.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = (
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
""",
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
""",
    """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
""",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
""",
)
_GNU = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.
You should have received a copy of the GNU {kind}General Public License along with this {what}{end}"""
_STREET = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_URL = ". If not, see <https://www.gnu.org/licenses/>."


def _bsd(clauses: int, marks: tuple[str, ...]) -> str:
    return _BSD[0] + "".join(m + " " + t for m, t in zip(marks, _BSD[1 : clauses + 1], strict=False)) + _WARRANTY


def _gnu(kind: str, version: str, what: str, end: str) -> str:
    old = end == _STREET
    return _GNU.format(kind=kind, version=version, what=what, end=end, colon=";" if old else ":", comma=";" if old else ",")


#: Further whole texts, and the standard notices of licenses whose text is long: several usual forms each.
MORE_TEXTS = (
    ("ISC", TEXTS["ISC"].replace("modify, and/or distribute", "modify, and distribute")),
    *[(f"BSD-{k}-Clause", _bsd(k, marks)) for k in (2, 3) for marks in (("1.", "2.", "3."), ("*", "*", "*"), ("(1)", "(2)", "(3)"))],
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    *[
        (name, _gnu(kind, version, what, end))
        for name, kind, version in (
            ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
        )
        for what in ("program", "library") for end in (_STREET, _URL)
    ],
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("CC0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty.
You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see
<https://creativecommons.org/publicdomain/zero/1.0/>."""),
)

#: Title lines beside the forms of ``NAMES``, each of those also with "The".
TITLES = {
    "MIT": ("The MIT License (MIT)", "MIT License (MIT)"),
    "BSD-2-Clause": ("The 2-Clause BSD License", "BSD License"),
    "BSD-3-Clause": ("The 3-Clause BSD License", "Modified BSD License", "BSD License"),
    "ISC": ("ISC License (ISC)", "The ISC License (ISC)"),
    "Zlib": ("zlib/libpng License", "The zlib/libpng License"),
}


def notices() -> list[tuple[str, str]]:
    """(license, text) of all one-line notices and the first whole texts."""
    made = [(name, notice.format(form)) for name, forms in NAMES.items() for form in forms for notice in NOTICES]
    return sorted(set(TEXTS.items()) | set(made))


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all whole texts, with and without a title line, and of all notices."""
    bodies = {*TEXTS.items(), *MORE_TEXTS}
    titled = {
        (name, f"{title}\n{body}")
        for name, body in bodies
        for title in (*TITLES.get(name, ()), *NAMES[name], *[f"The {form}" for form in NAMES[name]])
    }
    return sorted(bodies | titled | set(notices()))


def canonical(text: Column) -> Column:
    out = F.translate(text, UPPER, LOWER)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def _digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_forms(spark: SparkSession, texts: Texts = None) -> DataFrame:
    """(digest, form, license): one row per canonical form."""
    given = isinstance(texts, DataFrame)
    pairs = known_texts() if given or not texts else texts
    rows = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in pairs])
    known = spark.range(1).select(F.inline(rows))
    if given:
        known = known.unionByName(texts.select("license", "text").where(F.length(canonical(F.col("text"))) > 0))
    forms = known.select(canonical(F.col("text")).alias("form"), "license")
    return forms.groupBy("form").agg(F.min("license").alias("license")).select(F.sha2("form", 256).alias("digest"), "form", "license")


#: What a step puts into a text; words with such a piece need not stand in it as they are in the canonical form.
MADE = ("licens", "copyright", "holder", "organiz", "realiz", "recogniz", "authoriz", "fav", "behav", "hono", "non", "commercial", "and")
#: Words that do not tell a notice from other prose.
COMMON = frozenset("by the of in to for with is be this that under or an it as on at are was not from".split())


def anchors(forms: Iterable[str]) -> str | None:
    """A pattern that every lower-cased text with one of these canonical forms contains; None if there is none.

    Every form has a whole word that no step makes, or one with "licens": greedily, few long words cover all.
    """
    open_ = []
    for form in forms:
        plain = {w for w in form.split(" ") if re.fullmatch("[a-z]+[a-z0-9]+", w) and not re.fullmatch("v[0-9]+", w) and not any(m in w for m in MADE)}
        words = plain - COMMON or plain
        if "licens" in form:
            words.add("licen[cs]")
        if not words:
            return None
        open_.append(words)
    chosen = set()
    while open_:
        counts = Counter(w for words in open_ for w in words)
        chosen.add(min(counts, key=lambda w: (-counts[w] * min(len(w), 7) ** 3, w)))
        open_ = [words for words in open_ if not words & chosen]
    whole = "|".join(sorted(chosen - {"licen[cs]"}))
    parts = [f"(?<![a-z0-9])(?:{whole})(?![a-z0-9])"] * bool(whole) + ["licen[cs]"] * ("licen[cs]" in chosen)
    return "|".join(parts)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Texts = None) -> DataFrame:
    """One row per document: id, ``canonical_sha256``, ``license`` of the whole text and ``notices`` of its lines.

    ``license`` is null if the whole text is no known one; ``notices`` are the licenses named by lines, in
    alphabetical order, comma-joined, each once. A list of ``texts`` replaces the known texts; a table (license, text) comes on top of
    them, for bodies that this module does not hold. Known digests are staged and joined by their size.
    """
    work = workspace(docs.sparkSession, "licenses")
    forms = work.stage(known_forms(docs.sparkSession, texts), "known")
    known = forms.select("digest", "license")
    few = forms.limit(ANCHORED_FORMS + 1).select("form").collect()
    pattern = anchors(r["form"] for r in few) if len(few) <= ANCHORED_FORMS else None
    lines = F.filter(F.split(F.translate("t", UPPER, LOWER), "\n"), lambda line: F.length(line) > 0)
    if pattern is not None:
        lines = F.filter(lines, lambda line: line.rlike(pattern))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("t"), F.monotonically_increasing_id().alias("row"))
    found = F.array_distinct(F.transform(lines, _digest))
    rows = work.stage(rows.select("row", "id", _digest(F.col("t")).alias("canonical_sha256"), found.alias("lines")), "digests")
    named = rows.select("row", F.explode("lines").alias("digest")).join(known, "digest")
    named = named.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))  # of some tens of names
    whole = known.withColumnRenamed("digest", "canonical_sha256")
    return (
        rows.drop("lines").join(whole, "canonical_sha256", "left").join(named, "row", "left")
        .select(F.col("id").alias(id_col), "canonical_sha256", "license", F.coalesce("notices", F.lit("")).alias("notices"))
    )


def oracle_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(col: str) -> str:
        out = f"translate({col}, '{UPPER}', '{LOWER}')"
        for pattern, to in STEPS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
        return f"sha256(trim({out}))"

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known_texts())
    return f"""WITH k AS (SELECT {canon('t')} AS digest, min(n) AS license FROM (VALUES {values}) v(n, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT r, {canon('line')} AS digest FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE line <> '') JOIN k USING (digest) GROUP BY r)
SELECT doc_id, digest AS canonical_sha256, license, coalesce(notices, '') AS notices
FROM (SELECT r, doc_id, {canon('t')} AS digest FROM d) LEFT JOIN k USING (digest) LEFT JOIN n USING (r)"""
