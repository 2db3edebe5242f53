"""License scans by the digest of a canonical form of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small

#: Spellings that count as equal, and what stands for them.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "copyright holder": "copyright owner",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "merchantability and": "merchantability",
    "noninfringement": "non infringement",
    "organisation": "organization",
    "per cent": "percent",
    "programme": "program",
    "recognise": "recognize",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "wilful": "willful",
}
#: Lines with a copyright mark and a year or holder, and the reservation of rights.
COPYRIGHT_LINES = r"(?m)^[^a-z0-9©\n]*(copyright\b|\(c\)|©)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"

#: Texts of common licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN = {"MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD_2 + BSD_END, "BSD-3-Clause": BSD_2 + BSD_3 + BSD_END, "Zlib": ZLIB}
#: Titles that whole licence files carry, and wordings that are as usual.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "The ISC License (ISC)", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}
WORDINGS = {"ISC": [("and/or distribute", "and distribute")]}
#: Digests of ``whole_form`` of long licences, with and without what follows the end of their terms.
LONG = {
    "023f96fb12fb40659102f1ac5a680488648a960e4b5fe82f9f7e5c9a7e835af2": "Apache-2.0",
    "3242e686ae9106b8db245670f30a1f0b8000adf8e210f19d9ca88349cc4132c2": "Apache-2.0",
    "3744efb92633500841034a4b7c7e50eafa7143121049894051ac9faf36eac690": "Apache-2.0",
    "b786e4dcc533745dd6e8c7df7360071e558b3cc45fb201b53e8afb199f1cd374": "CC0-1.0",
    "49833bac94ec718bbde5230965b5282ab5eeaa9b3aa42be75ed8486097989757": "GPL-2.0",
    "b776dff4ab9b27871871335f21f13d776b18f264fe1024bcdd7d879dfc080f7a": "GPL-2.0",
    "f572127d62f35c0eaa966fcc86a1648f04bec6b79732271eaf8a8286c74c51eb": "GPL-2.0",
    "4c383cb2fc32d848a9703bd6d123e32af567e4c9722c2f5706f48b809c5ea20f": "GPL-3.0",
    "62930e1aad5a30b14b989d332ce43443b39e4d69a38d03f61d0d8013ec061f9d": "GPL-3.0",
    "6e49dd9cd417ff8fba114f8cf66466d5ef90d67a41459efbb2dc920ee3f33d38": "GPL-3.0",
    "1792972ba099e3c717a92a90df3599f920ea30dd16fccd07886e9897c0935c93": "LGPL-2.0",
    "3ab3b5c80d58992a47e1ed294a075b9687744f55a8b9795a0aa3d47deb77ed0b": "LGPL-2.0",
    "bf92e97e2d23396b834877b483fed07b7653d6abdc4d7ef73554112266df5977": "LGPL-2.0",
    "0862fa14d6a54665bbbb026a7c9ad7fc16ac95196d602c994f8c685d1938bfd3": "LGPL-2.1",
    "5d4a02ab3f15a37ecdbd547991172dff8624b2a7fe42f396e8d3defca3acfa39": "LGPL-2.1",
    "d5303d88b863820de5a27d2d9539668403bd02a10d1dca00b5dd315d0957096f": "LGPL-2.1",
    "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0": "LGPL-3.0",
    "5c0269a4931aac7ea7207dd7fd6733bf93886ff2f920b9e801acb3b6e0d15f0a": "MPL-2.0",
    "9ceffc7334827b41e43b88145636107fd3a7ff101b195d3ff37c84c1df553594": "Unlicense",
}

#: Lines with 'copyright' or a mark and then a mark, a year or its placeholder, or holders; no line of a wrapped sentence.
NOTICES = (
    r"(?m)^[^a-z0-9©\n]*(?:copyright\b[^a-z0-9©\n]*(?:\(c\)|©|[12][0-9]{3}\b|[<\[{(]\s*(?:year|yyyy))|(?:\(c\)|©)[^a-z0-9\n]*(?:copyright\b|[12][0-9]{3}\b|[<\[{(]\s*(?:year|yyyy))"
    r"|©|copyright\b(?!\s*(?:holder|owner|notice|licen|law|and\b|or\b))[^\n]*\b(?:authors|contributors|developers|inc|ltd|llc|gmbh)\b[^a-z0-9\n]*$)[^\n]*$"
    r"|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
)
#: Bullets and numbers of a list, wherever the text is wrapped.
MARKERS = r"(?<!\S)(?:\(?(?:[0-9]{1,2}|[a-z]|i{1,3}|iv|vi{0,3})[.)]|o)(?!\S)"


def whole_form(text: Column) -> Column:
    """``canonical`` for whole licence files: only notices leave, and the marks of lists, however lines are wrapped."""
    out = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOTICES, "")
    return _words(F.regexp_replace(out, MARKERS, " "))


def canonical(text: Column) -> Column:
    """Lower case without copyright lines; words of letters and digits between single blanks, in one spelling."""
    return _words(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), COPYRIGHT_LINES, ""))


def _words(out: Column) -> Column:
    """Words of letters and digits between single blanks, in one spelling. The 23 replacements run only on a text that has
    one of the other spellings."""
    wide = lambda words: words.replace(" ", "  ")
    some = " (?:" + "|".join(wide(other) for other in SPELLINGS) + ") "

    def respelled(words: Column) -> Column:
        one_way = words
        for other, one in SPELLINGS.items():
            one_way = F.replace(one_way, F.lit(f" {wide(other)} "), F.lit(f" {wide(one)} "))
        return F.when(words.rlike(some), one_way).otherwise(words)

    out = F.concat(F.lit("  "), F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F©]+", "  "), F.lit("  "))
    out = F.get(F.transform(F.array(out), respelled), F.lit(0))  # computed once, used twice
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))  # two blanks stand between words


def _registry(spark: SparkSession, texts: dict[str, str] | DataFrame) -> DataFrame:
    """``(license_id, text)`` of a dict or of a table with these columns."""
    if isinstance(texts, DataFrame):
        return texts.select(F.col("license_id").cast("string").alias("license_id"), F.col("text").cast("string").alias("text"))
    return spark.createDataFrame(list(texts.items()), "license_id string, text string")


def known_licenses(spark: SparkSession, texts: dict[str, str] | DataFrame = KNOWN) -> DataFrame:
    """``(license_digest, license_id)``; texts that come to one form share the first id in order."""
    digest = F.sha2(canonical(F.col("text")), 256)
    return _registry(spark, texts).groupBy(digest.alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def whole_licenses(spark: SparkSession, texts: dict[str, str] | DataFrame = KNOWN) -> DataFrame:
    """``(whole_digest, whole_id)`` of the texts in their usual wordings, with and without a title, and of ``LONG``."""
    each = _registry(spark, texts).select(F.col("license_id").alias("whole_id"), "text")
    for key, changes in WORDINGS.items():
        for old, new in changes:
            each = each.unionByName(each.where(F.col("whole_id") == key).withColumn("text", F.replace("text", F.lit(old), F.lit(new))))
    titles = spark.createDataFrame([(k, t) for k, of in TITLES.items() for t in of], "whole_id string, title string")
    titled = each.join(F.broadcast(titles), "whole_id").select("whole_id", F.concat("title", F.lit("\n\n"), "text").alias("text"))  # some titles
    form = whole_form(F.col("text"))
    short = each.unionByName(titled).where(form != "").select(F.sha2(form, 256).alias("whole_digest"), "whole_id")
    long = spark.createDataFrame([(d, k) for d, k in LONG.items() if texts is KNOWN], "whole_digest string, whole_id string")
    return short.unionByName(long).groupBy("whole_digest").agg(F.min("whole_id").alias("whole_id"))


def license_scan(docs: DataFrame, texts: dict[str, str] | DataFrame = KNOWN) -> DataFrame:
    """One row per document: ``doc_id, digest, license_id``; the id of the licence whose whole text the document's whole
    text is, after both are brought to one form, else null. ``digest`` is that of ``canonical``; a text that it does not
    find is looked up by ``whole_form``, which a title, list marks and wraps do not change.

    ``texts`` is the registry: a dict or a table ``(license_id, text)`` of full texts, of any size; its digests are
    broadcast while they are few. Null and empty texts, and texts of copyright lines and punctuation alone, have the
    digest of the empty form and no licence. Rows that repeat a doc_id are scanned each, a text of any length as a whole.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    forms = F.sha2(canonical(F.col("text")), 256).alias("digest"), F.sha2(whole_form(F.col("text")), 256).alias("whole")
    known = saved(known_licenses(spark, texts).where(F.col("license_digest") != F.sha2(F.lit(""), 256)), "license-digests")
    whole = saved(whole_licenses(spark, texts), "license-digests")
    rows = docs.select("doc_id", *forms).join(small(known), F.col("digest") == F.col("license_digest"), "left")
    rows = rows.join(small(whole), F.col("whole") == F.col("whole_digest"), "left")
    return rows.select("doc_id", "digest", F.coalesce("license_id", "whole_id").alias("license_id"))
