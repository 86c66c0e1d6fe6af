"""License scans: canonical digests of whole texts, looked up by a hash join.

DataFrame functions only. A text is made canonical: lower case, no copyright lines, equivalent
spellings made one, punctuation and space runs made one space. Its SHA-256 is joined with the
digests of known licences and notices. A document's units are the whole text and each of its
lines, so both a file that *is* a licence and a file that carries a notice line are found; a
unit must equal a known text as a whole, never contain it.

Edge cases: null or blank texts have no units and no licence; two texts with one canonical form
match alike; repeated rows each get a row; very long texts are canonical as a whole; an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, applied in this order to lower-case words.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("whilst", "while"), ("https", "http"),
)
#: Lines that name an owner or a year, not terms.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*"
#: Short licences and the notices by which a text names its licence.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)


#: Identifiers whose tag line names a licence.
TAGS = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CDDL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later",
    "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT-0", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Unlicense", "WTFPL", "Zlib",
)
KNOWN += tuple((tag, f"SPDX-License-Identifier: {tag}") for tag in TAGS)


def canonical(text):
    """Canonical form with line ends kept: see the module's text."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), F.lit(COPYRIGHT), F.lit("")), F.lit(r"[^\p{L}\p{N}\n]+"), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def one_line(text):
    return F.trim(F.regexp_replace(text, F.lit(r"[ \n]+"), F.lit(" ")))


def registry(spark: SparkSession, known=KNOWN, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license) of known texts, each digest once; ``texts`` (license, text) adds whole licences, however many, such as a folder's files."""
    table = spark.createDataFrame([*known], "license string, text string")
    table = table if texts is None else table.unionByName(texts.select("license", "text").filter("text IS NOT NULL"))
    return table.groupBy(F.sha2(one_line(canonical(F.col("text"))), 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id="doc_id", text="text") -> DataFrame:
    """A row for each document: ``text_digest`` of its canonical text, ``license`` that the whole text is
    (or null), ``n_notices`` and the distinct ``notices`` of its lines, comma-joined.

    ``known`` (digest, license) is joined as it comes: Spark broadcasts it only where its size allows."""
    known = registry(docs.sparkSession) if known is None else known
    made = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), canonical(F.col(text)).alias("c"))
    whole = F.struct(F.lit(-1).alias("at"), F.sha2(one_line(F.col("c")), 256).alias("digest"))
    lines = F.filter(F.transform(F.split("c", "\n"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("digest"))), lambda x: x["digest"] != "")
    hashed = F.transform(lines, lambda x: F.struct(x["at"].alias("at"), F.sha2(x["digest"], 256).alias("digest")))
    units = made.select("doc_id", "uid", F.explode(F.concat(F.array(whole), F.coalesce(hashed, F.array().cast("array<struct<at:int,digest:string>>")))).alias("u")).select("doc_id", "uid", "u.*")
    found = units.join(known, "digest", "left")
    line = (F.col("at") >= 0) & F.col("license").isNotNull()
    blank = F.sha2(F.lit(""), 256)
    return (
        found.groupBy("uid", "doc_id")
        .agg(
            F.max(F.when(F.col("at") < 0, F.col("digest"))).alias("text_digest"),
            F.max(F.when(F.col("at") < 0, F.col("license"))).alias("license"),
            F.count_if(line).alias("n_notices"),
            F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("notices"),
        )
        .select("doc_id", F.coalesce("text_digest", blank).alias("text_digest"), "license", "n_notices", "notices")
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's licences."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _sql_one_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"


def oracle() -> str:
    known = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256({_sql_one_line(_sql_canonical("t"))}) AS digest, min(l) AS license FROM (VALUES {known}) k(l, t) GROUP BY 1
), made AS (
  SELECT doc_id, row_number() OVER () AS uid, {_sql_canonical("text")} AS c FROM documents
), units AS (
  SELECT uid, trim(u, ' ') AS u FROM (SELECT uid, unnest(string_split(c, chr(10))) AS u FROM made)
), lines AS (
  SELECT uid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM units JOIN known ON sha256(u) = digest WHERE u <> '' GROUP BY uid
)
SELECT doc_id, sha256(coalesce({_sql_one_line("c")}, '')) AS text_digest, k.license, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices
FROM made LEFT JOIN known k ON k.digest = sha256(coalesce({_sql_one_line("c")}, '')) LEFT JOIN lines USING (uid)
"""
