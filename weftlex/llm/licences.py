"""Licence scan: canonical digests of entire texts, lines and paragraphs.

A text is made canonical (lower case, equivalent spellings, no copyright lines,
no punctuation, single spaces) and its SHA-256 is looked up among the digests of
known licence texts by a hash join.  Units are the entire document, its
paragraphs and its lines, and runs of paragraphs that are those of an entire
known text, so a notice or a licence inside a document is found as well as a
document that is a licence.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side

# Licence identifiers and the notices by which they are stated.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <https://unlicense.org>"
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: Licence texts and the titles under which they are found.
_TITLED: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", _MIT_GRANT, ("MIT License", "The MIT License", "The MIT License (MIT)")),
    ("ISC", _ISC_GRANT, ("ISC License", "The ISC License")),
    ("0BSD", _ISC_GRANT.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""), ("BSD Zero Clause License", "Zero-Clause BSD")),
    ("BSD-2-Clause", _BSD + _DISCLAIMER, ("BSD 2-Clause License", "The 2-Clause BSD License")),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _DISCLAIMER, ("BSD 3-Clause License", "The 3-Clause BSD License")),
    ("Zlib", _ZLIB, ("zlib License", "The zlib/libpng License")),
    ("BSL-1.0", _BOOST, ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    ("Unlicense", _UNLICENSE, ("The Unlicense",)),
    ("Apache-2.0", _APACHE_HEADER, ()),
)
#: (licence, whole text), without a title and with each.
TEXTS: tuple[tuple[str, str], ...] = tuple((name, f"{title}\n\n{text}" if title else text) for name, text, titles in _TITLED for title in ("", *titles))

#: Equivalent spellings, applied in order to lower-cased text; words wrapped at a hyphen are joined first.
SPELLINGS: tuple[tuple[str, str], ...] = (("-\n", "-"), ("licence", "license"), ("sub-license", "sublicense"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("https:", "http:"), ("&", " and "))
#: A copyright line names a year (or has a place for one), a sign, or reserves rights; prose that a wrap makes begin with the word does not.
COPYRIGHT = r"(?m)^\W*(copyright\b.*(\b[12][0-9]{3}\b|\byyyy\b|[\[<{]year|\(c\)|©|all rights reserved)|\(c\)|©|all rights reserved).*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Paragraphs are parted by blank lines.
PARAGRAPHS = r"\n[\x20\t\r]*\n"


def canonical(text: Column) -> Column:
    """Lower case, spellings, copyright lines and punctuation out; words joined by single spaces."""
    out = F.lower(text)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, COPYRIGHT, " ")
    return F.btrim(F.regexp_replace(out, PUNCTUATION, " "))


def known(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """(digest, licence), one row for each digest; ``table(licence, text)`` in place of the built-in one."""
    rows = table if table is not None else spark.createDataFrame([*NOTICES, *TEXTS], "licence string, text string")
    rows = rows.select("licence", canonical(F.col("text")).alias("c")).where("c <> ''")
    return rows.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def known_paragraphs(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """(digest, licence, text_id, at, total): the paragraphs of each known text that has several, in order."""
    rows = table if table is not None else spark.createDataFrame(list(TEXTS), "licence string, text string")
    rows = rows.select("licence", F.sha2(canonical(F.col("text")), 256).alias("text_id"), _paragraphs(F.col("text")).alias("p")).where("size(p) > 1")
    return rows.select("licence", "text_id", F.size("p").alias("total"), F.posexplode("p").alias("at", "c")).select(F.sha2("c", 256).alias("digest"), "licence", "text_id", "at", "total").distinct()


def _paragraphs(text: Column) -> Column:
    """The paragraphs of a text in canonical form; those that are empty then (copyright lines) do not count."""
    return F.filter(F.transform(F.split(text, PARAGRAPHS), canonical), lambda x: x != "")


def scan(docs: DataFrame, table: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_digest, whole_licence, licences, n_notices, n_included) for each row of ``docs``.

    text_digest is of the entire text in canonical form, whole_licence the
    licence whose digest it is (else null), licences the sorted distinct
    licences of the entire text, of known texts inside it, of its paragraphs and
    its lines, joined by commas ('' if none), n_notices the number of lines and
    paragraphs of several lines that are one, n_included that of runs of
    paragraphs that are an entire known text.  A null text counts as empty,
    which is no licence.  Repeated ids and rows stay apart; other columns are
    not read; an empty table gives no rows.  ``table(licence, text)`` takes the
    place of the built-in texts.  Digests are broadcast only if few (counted).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    digests = small_side(known(docs.sparkSession, table))
    parts = small_side(known_paragraphs(docs.sparkSession, table))

    none = F.array().cast("array<string>")
    paragraphs = F.when(F.regexp("text", F.lit(PARAGRAPHS)), F.filter(F.split("text", PARAGRAPHS), lambda x: F.contains(x, F.lit("\n")))).otherwise(none)
    units = rows.select("id", "h", F.posexplode(F.concat(F.split("text", "\n"), paragraphs)).alias("at", "unit"))
    hits = units.select("id", "h", "at", F.sha2(canonical(F.col("unit")), 256).alias("digest")).join(digests, "digest")
    # repeated rows meet here again; the position counts each unit once
    hits = hits.groupBy("id", "h").agg(F.collect_set("licence").alias("found"), F.count_distinct("at").alias("n_notices"))

    several = rows.where(F.regexp("text", F.lit(PARAGRAPHS))).select("id", "h", F.posexplode(_paragraphs(F.col("text"))).alias("pos", "c"))
    runs = several.select("id", "h", "pos", F.sha2("c", 256).alias("digest")).join(parts, "digest")
    runs = runs.groupBy("id", "h", "licence", "text_id", "total", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count_distinct("at").alias("k")).where("k = total")
    runs = runs.groupBy(F.col("id").alias("id2"), F.col("h").alias("h2")).agg(F.collect_set("licence").alias("inside"), F.count("*").alias("n_included"))

    whole = rows.select("id", "h", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(digests, "digest", "left").withColumnRenamed("licence", "whole_licence")
    out = whole.join(hits, whole["id"].eqNullSafe(hits["id"]) & (whole["h"] == hits["h"]), "left").join(runs, whole["id"].eqNullSafe(runs["id2"]) & (whole["h"] == runs["h2"]), "left")
    every = F.array_union(F.array_union(F.coalesce(hits["found"], none), F.coalesce("inside", none)), F.array_compact(F.array("whole_licence")))
    return out.select(
        whole["id"].alias(id_col),
        F.col("digest").alias("text_digest"),
        "whole_licence",
        F.array_join(F.sort_array(every), ",").alias("licences"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("n_included", F.lit(0)).cast("long").alias("n_included"),
    )


def _sql_canonical(x: str) -> str:
    x = f"lower({x})"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace(regexp_replace({x}, '{COPYRIGHT}', ' ', 'g'), '{PUNCTUATION}', ' ', 'g'), ' ')"


def sql() -> str:
    """The same in SQL, with the built-in table as literal rows."""
    rows, texts = (", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in own) for own in ((*NOTICES, *TEXTS), TEXTS))
    return f"""
WITH l(licence, text) AS (VALUES {rows}),
k AS (SELECT sha256(c) AS digest, min(licence) AS licence FROM (SELECT licence, {_sql_canonical("text")} AS c FROM l) WHERE c <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT r, unnest(list_concat(string_split(t, chr(10)), list_filter(regexp_split_to_array(t, '{PARAGRAPHS}'), lambda x: contains(x, chr(10)) AND regexp_matches(t, '{PARAGRAPHS}')))) AS unit FROM d),
h AS (SELECT r, list(DISTINCT licence) AS found, count(*) AS n FROM (SELECT r, sha256({_sql_canonical("unit")}) AS digest FROM u) JOIN k USING (digest) GROUP BY r),
x(licence, text) AS (VALUES {texts}),
q AS (SELECT licence, sha256({_sql_canonical("text")}) AS text_id, list_filter(list_transform(regexp_split_to_array(text, '{PARAGRAPHS}'), lambda y: {_sql_canonical("y")}), lambda y: y <> '') AS p FROM x),
kp AS (SELECT DISTINCT sha256(c) AS digest, licence, text_id, pos, total FROM (SELECT licence, text_id, len(p) AS total, unnest(p) AS c, unnest(range(0, len(p))) AS pos FROM q WHERE len(p) > 1)),
dp AS (SELECT r, unnest(p) AS c, unnest(range(0, len(p))) AS pos FROM (SELECT r, list_filter(list_transform(regexp_split_to_array(t, '{PARAGRAPHS}'), lambda y: {_sql_canonical("y")}), lambda y: y <> '') AS p FROM d)),
rn AS (SELECT r, licence FROM (SELECT dp.r, kp.licence, text_id, total, dp.pos - kp.pos AS b, count(DISTINCT kp.pos) AS n FROM dp JOIN kp ON sha256(dp.c) = kp.digest GROUP BY ALL) WHERE n = total),
g AS (SELECT r, list(DISTINCT licence) AS inside, count(*) AS n FROM rn GROUP BY r),
w AS (SELECT r, doc_id, sha256({_sql_canonical("t")}) AS digest FROM d)
SELECT w.doc_id, w.digest AS text_digest, k.licence AS whole_licence,
  array_to_string(list_sort(list_distinct(list_filter(list_concat(list_concat(coalesce(h.found, CAST([] AS VARCHAR[])), coalesce(g.inside, CAST([] AS VARCHAR[]))), [k.licence]), lambda x: x IS NOT NULL))), ',') AS licences, CAST(coalesce(h.n, 0) AS BIGINT) AS n_notices, CAST(coalesce(g.n, 0) AS BIGINT) AS n_included
FROM w LEFT JOIN k USING (digest) LEFT JOIN h USING (r) LEFT JOIN g USING (r)
"""
