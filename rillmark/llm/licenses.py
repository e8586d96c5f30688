"""Licence scan by canonical digest: normalise, hash, and join with the digests of known texts.

What is looked up is a text as a whole and each of its lines as a whole, since a licence or its
notice is often one line of a longer text. Both sides go through one normalisation, written as
built-in column functions: lower case, equivalent spellings, copyright lines out, everything but
letters and digits to one space. A line that normalises to nothing has no digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, stored

# fixed values: pattern and replacement, applied in this order to lower-case text
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
EQUIVALENT = (
    ("licence", "license"),
    ("licens(?:or|er)", "licensor"),
    ("organis", "organiz"),
    ("merchantib", "merchantab"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("https?://", " "),
    ("whilst", "while"),
    ("&amp;|&", " and "),
)
OTHER = r"[^\p{L}\p{N}]+"

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0"
_APACHE_NOTICE = " (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_GPL_TAIL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."

# fixed values: licence, and a full text or notice that stands for it
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", f"MIT License\n{_MIT_GRANT}\n{_MIT_NOTICE}\n{_MIT_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT_GRANT}\n{_MIT_NOTICE}\n{_MIT_WARRANTY}"),
    ("MIT", f"{_MIT_GRANT}\n{_MIT_NOTICE}\n{_MIT_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT-0", f"MIT No Attribution\n{_MIT_GRANT.replace(', subject to the following conditions:', '.')}\n{_MIT_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", f"{_APACHE}{_APACHE_NOTICE}"),
    ("Apache-2.0", f"{_APACHE}."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Zlib", _ZLIB),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0-or-later", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. {_GPL_TAIL}"),
    ("GPL-3.0-or-later", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_GPL_TAIL}"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


# fixed values: licence, and the digest of its full text, for some also of what stands before its appendix
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "cad1b7ee24e79c80c246b96ab6128871a0760f54255754afa98fbe2d599a74a9"),
    ("Apache-2.0", "683ccd724dfa793ed99ecc8460babfa7ec659003496326927ad0d88261abcd71"),
    ("Artistic-1.0-Perl", "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "e340fdbffa8aad1a91ad3d07603ae56e4f976876fde20a8f60ddc2324aaafbf2"),
    ("GFDL-1.3", "24a1eee50a8a03726d0c9df2bda3fc0c810ea16c6cf6bffc69d49fd4c54a6e12"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-3.0", "72835a70e36b7216a23d7ad0423b16c131559708d367edec60d93ad91144bc26"),
    ("GPL-3.0", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.0", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-2.1", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "c3754fa3290eda10675f5ccbdf2525e4717acc479d73ef03524ab7e393bab08c"),
    ("MPL-2.0", "0a9e3d32a7f24bf01d16516a5abfba9b19d53f60aef0a720705e0580ea38d942"),
)


def normalised(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for pattern, other in EQUIVALENT:
        out = F.regexp_replace(out, pattern, other)
    return F.trim(F.regexp_replace(out, OTHER, " "))


def digest(text: Column) -> Column:
    """SHA-256 of the normal form; null if nothing is left of it."""
    form = normalised(text)
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


# a list of known texts of up to so many bytes of digests is held as a literal map
MAP_BYTES = 256 << 10


def known_digests(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """digest, license: one row for each different digest. known may be a table (license, text) too."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    out = rows.select(digest(F.col("text")).alias("digest"), "license").filter("digest is not null")
    out = out.unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    return out.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """doc_id, text_digest, license, line_licenses for each row of docs.

    license is that of the whole text, line_licenses the sorted different ones of lines that are
    known texts by themselves. Null and empty texts have neither, nor a digest. Repeated rows stay.
    known is the list or table of known texts, digests those known by their digest alone. If all digests
    have up to MAP_BYTES, lines are looked up in a literal map while they are in their row; otherwise
    the lines' digests are joined with the table, each text once.
    """
    spark = docs.sparkSession
    table = stored(known_digests(spark, known, digests), "licenses")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    # the optimiser knows the size of the written table, so it chooses between broadcasting it and a shuffle
    by_text = table.withColumnRenamed("digest", "text_digest")
    if (table.agg(F.sum(F.length("digest") + F.length("license"))).first()[0] or 0) <= MAP_BYTES:
        literal = F.create_map(*(F.lit(x) for row in table.collect() for x in (row["digest"], row["license"])))
        found = F.transform(lines, lambda x: F.try_element_at(literal, F.coalesce(digest(x), F.lit(""))))
        hits = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
        rows = docs.select("doc_id", digest(text).alias("text_digest"), F.concat_ws(",", hits).alias("line_licenses"))
        return rows.join(by_text, "text_digest", "left").select("doc_id", "text_digest", "license", "line_licenses")
    # equal normal forms may have other lines, so a text is known by its own digest here, and looked at once whatever its copies
    own = F.sha2(text.cast("binary"), 256).alias("own")
    slim = docs.select(own, digest(text).alias("text_digest"), F.array_distinct(F.filter(F.transform(lines, digest), lambda x: x.isNotNull())).alias("lines"))
    texts = stored(slim.groupBy("own").agg(F.first("text_digest").alias("text_digest"), F.first("lines").alias("lines"), F.count(F.lit(1)).alias("n")), "licenses-texts")
    each = texts.select("own", F.explode("lines").alias("digest")).join(table, "digest").groupBy("own").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    # texts without a digest have no key to be joined by
    whole = texts.filter("text_digest is not null").join(by_text, "text_digest", "left").select("own", "text_digest", "license", "n")
    whole = whole.union(texts.filter("text_digest is null").select("own", "text_digest", F.lit(None).cast("string"), "n"))
    answers = stored(whole.join(each, "own", "left").select("own", "text_digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), "n"), "licenses-found")
    return join_hot(docs.select("doc_id", own), answers, "own", "n").select("doc_id", "text_digest", "license", "line_licenses")
