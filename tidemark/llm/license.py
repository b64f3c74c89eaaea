"""License scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings, white space), digested, and joined with the digests of
known licence texts.  The same lookup serves single lines, for notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, as whole words of the canonical text.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("honour", "honor"),
    ("modelled", "modeled"), ("analyse", "analyze"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("merchantibility", "merchantability"), ("https", "http"),
)

_PERMISSIVE_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Known texts by SPDX identifier: public licence texts, and short notices that stand alone.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _PERMISSIVE_END),
    ("0BSD", "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _PERMISSIVE_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + "\n\n" + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Further forms: texts without their heading, and notices in other words.
_STARTS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under", "This project is licensed under")
_NAMES = (
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("MIT", "MIT License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("Zlib", "zlib License"),
    ("GPL-2.0-only", "GNU General Public License, version 2"), ("GPL-3.0-only", "GNU General Public License, version 3"), ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC0-1.0", "CC0 1.0"), ("Unlicense", "Unlicense"),
)
MORE = tuple((a, b.split("\n\n", 1)[1]) for a, b in KNOWN[:6]) + tuple((a, f"{start} {the}{b}") for a, b in _NAMES for start in _STARTS for the in ("", "the "))

#: Digests of the canonical form of whole licence texts, too long to be given here.
DIGESTS = (
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0-only", "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce"),
    ("GPL-2.0-only", "c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88"),
    ("GPL-3.0-only", "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349"),
    ("LGPL-2.0-only", "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d"),
    ("LGPL-2.1-only", "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
)

#: Any line that is a known text of the lists above matches this (tested), so only such lines are digested for them.
LINE = r"(?i)licen[cs]e|\bas[^\p{L}\p{N}]+is\b|\b(?:released|distributed)[^\p{L}\p{N}]+under\b"

#: Rows of a caller's list that are broadcast at most.
LISTED = 10_000

#: A line that only states a copyright.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    # two blanks between words, so that each has its own on both sides and equal neighbours are all respelt
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """digest, license_id: as many rows as known texts at most."""
    given = spark.createDataFrame(list(texts), "license_id string, text string")
    return given.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def listed(spark: SparkSession) -> DataFrame:
    """digest, license_id of all lists of this module."""
    whole = spark.createDataFrame([(b, a) for a, b in DIGESTS], "digest string, license_id string")
    return known(spark, KNOWN + MORE).union(whole).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, license_id (null if the whole text is no known one), notices (known licences of single lines, sorted, joined by commas).

    Null texts count as empty and match nothing; texts are digested whole; of
    licences with one digest the first by name counts; repeated rows each give a
    row, a null doc_id stays null; an empty table gives no rows; other columns
    are ignored.  A list (digest, license_id) of up to LISTED rows is broadcast
    and looked up on the map side, a longer one is joined by shuffles.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.split(text, "\n", -1)
    if licenses is not None:
        licenses = licenses.groupBy("digest").agg(F.min("license_id").alias("license_id"))
        if licenses.limit(LISTED + 1).count() > LISTED:
            return _scan_long_list(docs, licenses)
    lines = F.filter(split, lambda x: x.rlike(LINE)) if licenses is None else split
    licenses = listed(docs.sparkSession) if licenses is None else licenses
    whole = docs.select("doc_id", F.sha2(canonical(text), 256).alias("text_digest"), lines.alias("_lines"))
    found = whole.join(F.broadcast(licenses.withColumnRenamed("digest", "text_digest")), "text_digest", "left")
    table = {r["digest"]: r["license_id"] for r in licenses.collect()}
    lookup = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]) if table else F.create_map().cast("map<string,string>")
    named = F.transform("_lines", lambda x: F.try_element_at(lookup, F.sha2(canonical(x), 256)))
    return found.select("doc_id", "text_digest", "license_id", _joined(named).alias("notices"))


def _joined(names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))), ",")


def _scan_long_list(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """The same for a list of any length: whole texts and lines are joined with it by their digests, and a text's notices come back under a digest of the text as it stands."""
    text = F.coalesce(F.col("text"), F.lit(""))
    as_it_stands = F.sha2(text, 256).alias("_text")
    lines = docs.select(as_it_stands, F.explode(F.array_distinct(F.split(text, "\n", -1))).alias("_line")).select("_text", F.sha2(canonical(F.col("_line")), 256).alias("digest"))
    notices = lines.join(licenses, "digest").groupBy("_text").agg(_joined(F.collect_set("license_id")).alias("notices"))
    whole = docs.select("doc_id", as_it_stands, F.sha2(canonical(text), 256).alias("digest"))
    return whole.join(licenses, "digest", "left").join(notices, "_text", "left").select("doc_id", F.col("digest").alias("text_digest"), "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql() -> str:
    def form(x: str) -> str:
        t = f"regexp_replace(lower({x}), '{COPYRIGHT}', ' ', 'g')"
        t = rf"' ' || trim(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', '  ', 'g')) || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"sha256(trim(replace({t}, '  ', ' ')))"

    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH k AS (SELECT {form("t")} AS digest, min(id) AS license_id FROM (VALUES {rows}) AS v(id, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) AS x JOIN k ON {form("line")} = k.digest
      WHERE regexp_matches(line, '(?i)licen[cs]e') GROUP BY r),
w AS (SELECT r, doc_id, {form("text")} AS text_digest FROM d)
SELECT doc_id, text_digest, license_id, coalesce(notices, '') AS notices
FROM w LEFT JOIN k ON digest = text_digest LEFT JOIN l USING (r)
"""


SQL = _sql()
