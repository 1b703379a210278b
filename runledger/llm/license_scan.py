"""Licence scans by canonical digest lookup.

Texts are normalised (case, punctuation and white space, copyright lines,
equivalent spellings) and their SHA-256 is joined with the digests of known
licences, with and without their titles. The same lookup over single lines and
sentences finds licence notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: words that licence texts spell in several ways
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("centre", "center"), ("acknowledgement", "acknowledgment"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("per cent", "percent"))

# fixed values: whole licence texts
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n' + _WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}

# fixed values: names by which notices call licences
NAMES = {
    "MIT": ("MIT License", "MIT"), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"), "ISC": ("ISC License",), "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"), "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("GNU Lesser General Public License, version 3",), "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"), "CC-BY-4.0": ("CC BY 4.0",), "CC-BY-SA-4.0": ("CC BY-SA 4.0",), "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0",), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
NOTICES = ("licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "distributed under the {}", "this work is licensed under {}", "this work is licensed under the {}", "this software is licensed under the {}", "this project is licensed under the {}", "available under the {}")
# fixed values: title lines above whole texts
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"), "Zlib": ("zlib License", "The zlib License"),
}
MARKS = r"(?:(?://+|#+|/?\*+|;+|--+)[ \t]*)*"
SENTENCE = r"(?<=[.;!?])[ \t]+"
MOST_BROADCAST = 100_000


def canonical(text: Column) -> Column:
    """Lower case without copyright lines; words of ASCII letters and digits, single spaces, one spelling."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(out, rf"(^|\n)[ \t]*{MARKS}(copyright|\(c\)|©|portions copyright)[^\n]*", "$1")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " ")), F.lit(" "))
    # with two spaces between them neighbours have a space of their own
    out = F.replace(out, F.lit(" "), F.lit("  "))
    for spelling, plain in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {plain.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_licences(spark: SparkSession) -> DataFrame:
    """Digests of the known texts and notices: ``kind, license, digest``."""
    rows = [("text", k, v) for k, v in TEXTS.items()] + [("notice", k, form.format(name)) for k, names in NAMES.items() for name in names for form in NOTICES]
    rows += [("text", k, f"{title}\n{TEXTS[k]}") for k, titles in TITLES.items() for title in titles]
    rows += [("notice", k, f'{form.format(name)} (the "License")') for k, names in NAMES.items() for name in names for form in NOTICES]
    rows += [("notice", k, f"SPDX-License-Identifier: {k}{end}") for k in {**NAMES, **TEXTS} for end in (("", "-only", "-or-later") if "GPL" in k else ("",))]
    known = spark.createDataFrame(rows, "kind string, license string, text string")
    return known.select("kind", "license", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licence of every whole text and notices among its lines: ``doc_id, license, notices``.

    ``license`` is null where the whole text is no known licence; ``notices`` are
    the licences that its lines or their sentences name, in order, joined by commas (empty: none).
    Null and empty texts have neither. Each row is judged by itself, be its id null or repeated. Where several
    licences share a digest the first in code point order counts.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    known = known.groupBy("kind", "digest").agg(F.min("license").alias("license"))
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    piece = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole_and_lines = F.concat(F.array(piece("text", F.col("text"))), F.transform(F.split("text", "\n"), lambda line: piece("notice", line)))
    pieces = rows.select("doc_id", "row", F.explode(whole_and_lines).alias("x")).select("doc_id", "row", "x.kind", "x.text")
    sentences = F.array_distinct(F.concat(F.array("text"), F.split("text", SENTENCE)))
    pieces = pieces.select("doc_id", "row", "kind", F.explode(F.when(F.col("kind") == "text", F.array("text")).otherwise(sentences)).alias("text"))
    found = pieces.select("doc_id", "row", "kind", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(known, ["kind", "digest"], "left")
    named = lambda kind: F.when(F.col("kind") == kind, F.col("license"))
    notices = F.array_join(F.array_sort(F.collect_set(named("notice"))), ",")
    return found.groupBy("row", "doc_id").agg(F.max(named("text")).alias("license"), notices.alias("notices")).drop("row")
