"""Licence scan: canonical digests of whole texts, joined to the digests of known licences.

A text is made canonical: copyright notices go, case and punctuation go, equivalent spellings become one, blanks are
single, so wrapping does not count. A notice is one line, or the rest of its paragraph where it is wrapped; a text has
a form for either, and both are looked up among the digests of known licences and licence notices, which pass through
the same expression. The same is done with every line of a document, since notices often stand alone in one. The
table of known texts is a parameter; it is joined by hash, and broadcast while it has at most so many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classlens.sources.workdir import stage

#: Spellings that count as the same word, the first one of each pair becoming the second. Fixed values, after the
#: public matching guidelines for licences.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimisation", "optimization"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilise", "utilize"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
#: (name, text): licences that are short enough to stand in full, and notices that name a licence. Fixed values.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("ISC", _ISC.format(_KEEP)),
    ("ISC", f"ISC License\n\n{_ISC.format(_KEEP)}"),
    ("0BSD", _ISC.format("")),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format(_THIRD)),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: Known texts are broadcast up to so many rows (about 60 bytes each), else joined by shuffle.
BROADCAST_TEXTS = 100_000
#: Lines left out of the digest that is returned (not of those that find a licence): any that begin like a notice.
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}©(]*(?:copyright\b|\(c\)|©|all rights reserved).*$"
#: Beginning of a notice: copyright with a sign, a year, "by" or a name; a sign with a year; or the reservation alone.
#: A line of a licence that happens to begin with "copyright holders" or "copyright notice" is none.
_NOTICE = (
    r"(?m)^[^\p{L}\p{N}©(\n]*(?:(?i:(?:portions )?copyright)[ \t:,]*(?:©|(?i:\(c\))|(?:19|20)\d\d\b|(?i:by )"
    r"|(?<=Copyright )(?!(?i:holder|owner|notice|law|licen[cs]e)s?\b)\p{Lu}\p{Ll}*)"
    r"|(?i:\(c\))[ \t]*(?:copyright[ \t]*)?(?:19|20)\d\d\b|©"
)
_RESERVED = r"|(?i:all rights reserved)[^\p{L}\p{N}\n]*$)"
NOTICE_LINE = _NOTICE + _RESERVED + r".*$"
#: The same with the lines that follow, up to one without a letter or digit.
NOTICE_PARAGRAPH = _NOTICE + _RESERVED + r".*(?:\n(?=.*[\p{L}\p{N}]).*)*"
MARKS = r"(?i)copyright|\(c\)|©|all rights"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(texts: Column) -> Column:
    """An array of texts without case, punctuation and variant spellings, words joined by one blank."""
    variants = " (?:" + "|".join(v for v, _ in SPELLINGS) + ") "

    def plain(x: Column) -> Column:
        return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), OTHER, " ")), F.lit(" "))

    def spelt(x: Column) -> Column:
        y = x
        for variant, word in SPELLINGS:
            y = F.replace(y, F.lit(f" {variant} "), F.lit(f" {word} "))
        return F.trim(F.when(x.rlike(variants), y).otherwise(x))

    return F.transform(F.transform(texts, plain), spelt)


def forms(text: Column) -> Column:
    """Canonical forms of a text: without copyright lines, then without notices by line and by paragraph.

    Only the first one if nothing looks like a notice, for then all are equal.
    """
    cut = [F.regexp_replace(text, x, " ") for x in (COPYRIGHT_LINE, NOTICE_LINE, NOTICE_PARAGRAPH)]
    return canonical(F.when(text.rlike(MARKS), F.array(*cut)).otherwise(F.array(text)))


def _without_notices(forms_: Column) -> Column:
    return F.when(F.size(forms_) > 1, F.array_distinct(F.slice(forms_, 2, 2))).otherwise(forms_)


def _digests(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.struct(F.sha2(x, 256).alias("digest"), F.char_length(x).alias("chars")))


def known_texts(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(license, text)`` of the known licences."""
    return spark.createDataFrame(KNOWN if known is None else known, "license string, text string")


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, digest, license, line_licenses, n_license_lines)`` per row.

    ``digest`` is that of the whole canonical text without any line that begins like a copyright notice. ``license`` is
    the known licence that equals the text once real notices are gone, each as a line or as a paragraph (the first by name
    if several do), or null; ``line_licenses`` are the distinct licences of its lines, joined by commas, empty
    if none. A null text counts as empty and matches nothing. Rows are numbered, so repeated rows and keys
    keep their own results. Other columns are ignored. Empty in, empty out.
    """
    known = known.select("license", F.explode(_without_notices(forms(F.col("text")))).alias("c")).where("c <> ''")
    known = known.select(F.sha2("c", 256).alias("digest"), F.char_length("c").alias("chars"), "license")
    known = stage(known.groupBy("digest", "chars").agg(F.min("license").alias("license")), "known")
    few = known.count() <= BROADCAST_TEXTS
    bare = F.transform(
        F.split("text", "\n"), lambda x: F.when(x.rlike(MARKS), F.regexp_replace(x, NOTICE_LINE, " ")).otherwise(x)
    )
    wide = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wide = wide.select("key", forms(F.col("text")).alias("forms"), canonical(bare).alias("lines"))
    wholes, lines = _without_notices(F.col("forms")), F.col("lines")
    if few:
        known = F.broadcast(known)
        # Equal digests have equal lengths, so texts and lines of any other length need no digest.
        lengths = F.lit(sorted(r["chars"] for r in known.select("chars").distinct().collect()) or [-1])
        wholes, lines = (F.filter(x, lambda y: F.array_contains(lengths, F.char_length(y))) for x in (wholes, lines))
    rows = wide.select(
        F.monotonically_increasing_id().alias("row"),
        "key",
        F.sha2(F.col("forms")[0], 256).alias("digest"),
        _digests(wholes).alias("wholes"),
        _digests(lines).alias("lines"),
    )
    rows = stage(rows, "texts")
    parts = rows.select("row", F.lit(True).alias("whole"), F.inline("wholes"))
    parts = parts.unionByName(rows.select("row", F.lit(False).alias("whole"), F.inline("lines")))
    line = F.when(~F.col("whole"), F.col("license"))
    each = parts.join(known, ["digest", "chars"]).groupBy("row").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(line)), ",").alias("line_licenses"),
        F.count(line).alias("n_license_lines"),
    )
    return rows.select("row", "key", "digest").join(each, "row", "left").select(
        F.col("key").alias(key),
        "digest",
        "license",
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        F.coalesce("n_license_lines", F.lit(0)).cast("bigint").alias("n_license_lines"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_texts(spark))
