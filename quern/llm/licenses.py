"""License scan by canonical digests, with DataFrame expressions only."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2.replace("\n\nTHIS SOFTWARE", """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE""")
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

""" + _ISC.split("\n\n")[1]
_MIT0 = _MIT.split(", subject to")[0] + ".\n\n" + _MIT.split("\n\n")[2]
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Known licence texts and notices: (SPDX id, text). Fixed values; about forty rows, which bounds the broadcast.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT-0", _MIT0), ("MIT-0", "MIT No Attribution\n\n" + _MIT0), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _0BSD), ("0BSD", "BSD Zero Clause License\n\n" + _0BSD), ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2), ("BSD-3-Clause", _BSD3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3),
    ("BSL-1.0", _BSL), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BSL), ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
)

#: Long licences by digest alone: (SPDX id, digest of the canonical text, digest of its first paragraph, number of paragraphs). Fixed values, of the texts as published.
LONG: tuple[tuple[str, str, str, int], ...] = (
    ("Apache-2.0", "b856d3574bf4cbf1cd7fe0d092c4af9cef0c88b6c612b4dd09bf2bd62a797baa", "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", 32),
    ("Artistic-1.0-Perl", "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915", "9fed8b0e06b2229a97a10906ed7a4e4608b849d85ed54da1ada55f2d05e8d9db", 29),
    ("CC0-1.0", "bdac2bb55c2966170c64fa0d0c4d95ead2cfec5be3272aa37b40ab984b0b0de6", "021f3f319970fcf1f6e1d478e5367d797699877f3434ad73ee1ef815fdc7cd63", 13),
    ("GFDL-1.2-only", "6929d3e413a3bfd6579b6181648becc885a8c2f68489a6b32365f95dba9bd6d5", "8d2eae4d251844e9a73f0504efb40de0122c63022a833e6e0f5caafcd8f04324", 57),
    ("GFDL-1.3-only", "9eb99dd40c7f301acecf6076e33635f8e87e2a1ab2f1b8ef5fb1bac3a1c8b53b", "f42b2e6807623175c74cf8ca228746283c01775b536214b79d00df84c9a65ffa", 67),
    ("GPL-1.0-only", "1d6943ab93a449e04c9daae8ce9ee2e125c01dac3e84e3d22faa578d72207dbd", "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", 46),
    ("GPL-2.0-only", "75ed68ba30264d34e889d8b5fcee7d7287d7c93706ecb40245b6ee307a132b79", "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", 59),
    ("GPL-3.0-only", "01b4446c6fed3b145e992fa5cd53530173c6dc98928fa22d678d8d2590581724", "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", 122),
    ("LGPL-2.0-only", "cbb16df5289976efbcc2df916ac228ea15fa11b7ed7fab410e91d0278e64b38e", "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", 74),
    ("LGPL-2.1-only", "b7e59019941b7904753535b29a06a9739f121ea13228b483013d3ba15db5e95d", "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", 76),
    ("LGPL-3.0-only", "dd538d15d532339d4a394323937d54825be6b2224b8e1985cf9c9e707c966d9c", "b1dddaf7ef2e30067896bb2f11cf3c9defcf11564304f448a9257f49502a9e85", 37),
    ("MPL-1.1", "bf9b5615278108a15f25cd55000a0250122603d41bb9ff79cb293321fa82b26f", "e8d78c7ef0b7fb5f931ba9501977c8ca266cc1ab4b95b40fea21f3a7867310ca", 73),
    ("MPL-2.0", "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61", "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", 81),
)

#: A text without any of these words in it, in lower case, holds none of the known texts.
KEYWORDS = ("licen", "software", "cc0")

#: Equivalent spellings: (word, canonical word).
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("merchantibility", "merchantability"),
             ("acknowledgement", "acknowledgment"), ("v", "version"), ("favour", "favor"), ("programme", "program"), ("organisation", "organization"), ("and or", "or"))

_COPYRIGHT = r"(?md)^[^\p{L}\n]*(copyright\b|\(c\)|©)[^\n]*(\n|\z)"
_MARKS = r"[^\p{L}\p{N}]+"
_BLANK = r"\n[ \t\r]*\n"


def canonical(text: Column) -> Column:
    """Lower case, copyright lines cut, punctuation and white space to one space, equivalent spellings made one."""
    c = F.regexp_replace(F.lower(F.replace(text, F.lit("\r\n"), F.lit("\n"))), _COPYRIGHT, "")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, _MARKS, " ")), F.lit(" "))
    for word, own in SPELLINGS:
        c = F.replace(c, F.lit(f" {word} "), F.lit(f" {own} "))
    return F.trim(c)


def paragraphs(text: Column) -> Column:
    """Canonical paragraphs, cut at blank lines; those with nothing left, as of copyright lines, are not counted."""
    return F.filter(F.transform(F.split(text, _BLANK), canonical), lambda p: p != "")


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, " "), 256)


def known_texts(spark: SparkSession) -> DataFrame:
    """(license, digest, first, parts) of all known texts, canonised by the same expressions; one row per digest."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string").select("license", paragraphs(F.col("text")).alias("p"))
    rows = rows.select("license", digest(F.col("p")).alias("digest"), F.sha2(F.get("p", F.lit(0)), 256).alias("first"), F.size("p").alias("parts"))
    rows = rows.unionByName(spark.createDataFrame(list(LONG), "license string, digest string, first string, parts int"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("first").alias("first"), F.min("parts").alias("parts"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, unit_no, license, digest): each unit of a document whose whole canonical text is a known licence.

    Units are the document, runs of neighbouring paragraphs (unit ``paragraph``, by the number
    of the first) and lines; numbers from 0, paragraphs without words not counted. A run is
    looked at where a known text's first paragraph stands, as long as that text is, so a licence
    is found with any text before and after it, and one without its title also under a title. A
    text that is one run or one line as a whole counts as the document only. Null, empty and wordless texts have no hits; repeated rows give
    repeated hits; other columns are ignored; an empty table gives no rows.

    Texts without any of ``KEYWORDS`` are passed over unread, which loses nothing. The known
    digests are a constant of the code and broadcast; documents are scanned once, unshuffled.
    """
    known = known_texts(docs.sparkSession)
    lengths: dict[str, set[int]] = defaultdict(set)
    for r in known.collect():
        lengths[r["first"]].add(r["parts"])
    by_first = F.create_map(*[x for k, v in sorted(lengths.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.lower(text)
    some = F.contains(lower, F.lit(KEYWORDS[0])) | F.contains(lower, F.lit(KEYWORDS[1])) | F.contains(lower, F.lit(KEYWORDS[2]))
    rows = docs.where(some).select("doc_id", F.split(text, "\n").alias("lines"), paragraphs(text).alias("p"))
    unit = lambda kind, no, d: F.struct(F.lit(kind).alias("unit"), no.cast("long").alias("unit_no"), d.alias("digest"))

    def runs(first: Column, i: Column) -> Column:
        inside = F.filter(F.try_element_at(by_first, F.sha2(first, 256)), lambda n: (i + n <= F.size("p")) & (n < F.size("p")))
        return F.transform(F.coalesce(inside, F.array().cast("array<int>")), lambda n: unit("paragraph", i, digest(F.slice("p", i + 1, n))))

    none = F.array().cast("array<struct<unit:string,unit_no:bigint,digest:string>>")
    units = F.concat(
        F.array(unit("document", F.lit(0), digest(F.col("p")))),
        F.flatten(F.transform("p", runs)),
        F.when(F.size("lines") > 1, F.transform("lines", lambda x, i: unit("line", i, F.sha2(canonical(x), 256)))).otherwise(none))
    found = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*")
    return found.join(F.broadcast(known.select("digest", "license")), "digest").select("doc_id", "unit", "unit_no", "license", "digest")
