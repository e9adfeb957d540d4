"""Operator 4 [native]: licence scans by canonical digests of entire texts.

A text is brought to a canonical form (lower case, copyright lines out, equivalent
spellings made one, punctuation and white space to single spaces), and the digest of the
whole of it is looked up among the digests of known licences by a hash join.  Each line is
looked up the same way, as an entire text, for notices such as "Released under the MIT
License."; one pass over a text makes both forms.  Lines whose digest begins like none of
the table's are left out before the join: the prefixes come from the table itself, so no
match is lost, whatever the table holds.

Known licences: texts and digests of texts in this module, and notices made by rule.  An
argument replaces them by a table of any size; it is broadcast up to BROADCAST_KNOWN rows,
and else joined through the distinct digests, spreading those that many rows share.

Defined cases: null or empty texts, and those of punctuation alone, have no digest and no
licence; a digest known under several names gets the first; repeated rows are looked up
each; an empty table gives an empty result; extra columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, let, spread_join

#: Rows of the known table (under 100 bytes each) that are broadcast.
BROADCAST_KNOWN = 100_000

#: Lines that only name a holder: fixed patterns, also used in the SQL.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
#: Equivalent spellings: parts of words, replaced one after another.  Some also change other
#: words ("promise"), in known texts and scanned ones alike.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("isation", "ization"),
    ("ising", "izing"),
    ("ise", "ize"),
    ("alys", "alyz"),
    ("avour", "avor"),
    ("aviour", "avior"),
    ("abour", "abor"),
    ("honour", "honor"),
    ("colour", "color"),
    ("centre", "center"),
    ("calibre", "caliber"),
    ("cancell", "cancel"),
    ("labell", "label"),
    ("modell", "model"),
    ("signall", "signal"),
    ("dgement", "dgment"),
    ("catalogue", "catalog"),
    ("analogue", "analog"),
    ("offence", "offense"),
    ("defence", "defense"),
    ("fulfilment", "fulfillment"),
    ("wilful", "willful"),
    ("artefact", "artifact"),
    ("whilst", "while"),
    ("practize", "practice"),
    ("per cent", "percent"),
    ("https://", "http://"),
]
GAP = r"[^\p{L}\p{N}]+"
#: Whose name may not be used differs from copy to copy of a text.
HOLDER = r"neither the names? of .{1,200}? nor the names? of "
ANY_HOLDER = "neither the name of the holder nor the names of "

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE_MORE = "\n\nFor more information, please refer to <https://unlicense.org>"
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def _gnu_header(program: str, name: str, version: str) -> str:
    return f"""{program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <http://www.gnu.org/licenses/>."""


#: (id, text): texts known from the start; those of MIT, ISC, Apache-2.0, BSD, Zlib, Boost,
#: Unlicense, 0BSD, MPL and GNU headers are fixed values.
TEXTS = [
    ("MIT", MIT),
    ("MIT", "The MIT License\n\n" + MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("ISC", "The ISC License\n\n" + ISC),
    ("Apache-2.0", APACHE),
    ("BSD-2-Clause", BSD_2 + BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2 + BSD_END),
    ("BSD-3-Clause", BSD_2 + BSD_NAME + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_2 + BSD_NAME + BSD_END),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + UNLICENSE_MORE),
    ("BSL-1.0", BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BOOST),
    ("0BSD", ZERO_BSD),
    ("0BSD", "BSD Zero Clause License\n\n" + ZERO_BSD),
    ("MPL-2.0", MPL_HEADER),
    *[(i, _gnu_header(p, n, v)) for p in ("This program", "This library", "This file") for i, n, v in (
        ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"),
    )],
]
#: (id, names) that notices use; a notice is made of each with each of FRAMES.
NAMES = [
    ("MIT", ["MIT License", "MIT", "Expat License"]),
    ("ISC", ["ISC License"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU General Public License version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU General Public License version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"]),
    ("LGPL-2.1", ["GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"]),
    ("EPL-2.0", ["Eclipse Public License 2.0", "EPL-2.0"]),
    ("Unlicense", ["Unlicense"]),
    ("Zlib", ["zlib License"]),
    ("BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"]),
    ("CC0-1.0", ["CC0 1.0 Universal", "CC0 1.0", "CC0"]),
    *[(f"CC-{short}-{v}", [f"CC {short} {v}", f"CC-{short}-{v}", f"Creative Commons {long} {v} International License", f"Creative Commons {long} {v} License"])
      for v in ("4.0", "3.0") for short, long in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )],
]
FRAMES = [
    "Released under {}.", "Licensed under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.",
    "This software is licensed under {}.", "SPDX-License-Identifier: {}", "License: {}",
]
NOTICES = [(i, f.format(a + n)) for i, names in NAMES for n in names for f in FRAMES for a in ("", "a " if n.startswith("Creative") else "the ")]
KNOWN = [*TEXTS, *NOTICES]
#: (id, digest) of long texts, whole and without what follows their terms: MD5 of the
#: canonical form; digest_of() gives it for further texts.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "1bf614f143a18fd0019d5a898aef134d"),
    ("Apache-2.0", "60843f5dabae20856f816de9fa144d83"),
    ("Apache-2.0", "a0d27e3b224a388011d1f42908f0ce97"),
    ("Artistic-1.0-Perl", "7bc7316d56ed232ebaad64d6e776df0e"),
    ("BSD-2-Clause", "1ccf87ef559eb09bcb6202d76aeeffed"),
    ("BSD-2-Clause", "31ee69d4c498db169543287898787329"),
    ("BSD-3-Clause", "1ec0e9fa5f8821554bdf12586e29c81d"),
    ("BSD-3-Clause", "20be2f5c4d1197d6a4a91371f100cd5a"),
    ("BSD-3-Clause", "4eedf7a9c184d447bbef86f5cf514bfc"),
    ("BSD-3-Clause", "9c6d0ba55740d758861e326d5b296f13"),
    ("CC0-1.0", "884325594650b204d94a7be714f6f6f7"),
    ("GFDL-1.2", "5076e5dcda77907ce6cc1a72232bd2f6"),
    ("GFDL-1.3", "2d996439289fbe3f28c657fb08963eda"),
    ("GPL-1.0", "b560fb6baf8ffb29f41d2650afac0ad9"),
    ("GPL-1.0", "d15cd18b7065fe7f51a7cd5573a77001"),
    ("GPL-1.0", "e984694009ec683b9400f092d323790e"),
    ("GPL-2.0", "37b88906891ab2488ca8bb0ce356420d"),
    ("GPL-2.0", "56a59efda7c2db4f568d489ec70e4d06"),
    ("GPL-2.0", "95b38e7520571bd5e63ebb7fca55dfd0"),
    ("GPL-3.0", "9ab09e42866d374928960c855bb9a912"),
    ("GPL-3.0", "9f8bacafa6a3b73e5541a2a72778754d"),
    ("GPL-3.0", "a96d3255c0b56541297e207d137110c5"),
    ("LGPL-2.0", "4878bd79f8c9efe6b903efba016cfdb5"),
    ("LGPL-2.0", "7479f36e8321bfacf0d5dcc9226c09d7"),
    ("LGPL-2.0", "7d5d6ed30a5e77e3322ac446176c7d87"),
    ("LGPL-2.1", "1d8ad21fa806cf8924adf8b808149ef4"),
    ("LGPL-2.1", "2cdb4b5020f82c55adb6967ead8e8890"),
    ("LGPL-2.1", "e70886427357cb3df23b0b14be000405"),
    ("LGPL-3.0", "d17abc7fa5e5b496ebefcb5788c4317d"),
    ("MPL-1.1", "6a7d12967f0784b610d7b6d5c8618feb"),
    ("MPL-2.0", "4dd59a3dc3fa960db55f3aa7bd0a383e"),
    ("MPL-2.0", "5b16c2d224235e7bca6641e70273179c"),
]


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines that have one."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    lines = F.transform(F.split(t, "\n"), lambda s: F.trim(F.regexp_replace(s, GAP, " ")))
    return F.filter(lines, lambda s: s != "")


def whole(lines: Column) -> Column:
    """The canonical form of an entire text from its lines'."""
    named = lambda t: F.when(F.contains(t, F.lit("neither the name")), F.regexp_replace(t, HOLDER, ANY_HOLDER)).otherwise(t)
    return let(F.array_join(lines, " "), named)


def canonical(text: Column) -> Column:
    return whole(canonical_lines(text))


def digest_of(text: Column) -> Column:
    """The digest of a text's canonical form; null if nothing is left of it."""
    return let(canonical(text), lambda c: F.when(c != "", F.md5(c)))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, digest) of the built-in table."""
    texts = spark.createDataFrame(KNOWN, "license string, text string").select("license", digest_of(F.col("text")).alias("digest"))
    return texts.unionByName(spark.createDataFrame(DIGESTS, "license string, digest string"))


def _looked_up(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """rows (with d, a digest or null) with license, null for none."""
    if small:
        return rows.join(F.broadcast(table), "d", "left")
    asked = durable(rows.where("d is not null").groupBy("d").agg(F.count("*").alias("n")).join(table, "d", "left"))
    none = rows.where("d is null").withColumn("license", F.lit(None).cast("string"))
    return spread_join(rows, asked, ["d"], "n").unionByName(none)


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, license, notices): the licence that the whole text is, and the sorted
    licences that lines of it name.  known has (license, text) or (license, digest)."""
    known = known_licenses(docs.sparkSession) if known is None else known
    if "digest" not in known.columns:
        known = known.select("license", digest_of(F.col("text")).alias("digest"))
    table = durable(known.where("digest is not null").groupBy(F.col("digest").alias("d")).agg(F.min("license").alias("license")))
    small = table.count() <= BROADCAST_KNOWN
    start = lambda d: F.conv(F.substring(d, 1, 4), 16, 10).cast("int")
    begins = bytearray(1 << 16)
    for r in table.select(start(F.col("d")).alias("b")).distinct().collect():  # 65,536 rows at most
        begins[r.b] = 1
    seen = lambda d: F.substring(F.lit(begins), start(d) + 1, F.lit(1)) == F.lit(b"\1")

    def forms(lines: Column) -> Column:
        near = F.filter(F.transform(lines, lambda s: F.md5(s)), seen)
        digest = let(whole(lines), lambda c: F.when(c != "", F.md5(c)))
        return F.struct(digest.alias("d"), F.array_distinct(near).alias("near"))

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), let(canonical_lines(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), forms).alias("f"))
    # One row per digest to look up, then one per document again: only ids and digests move.
    rows = durable(rows.select("doc_id", "f.d", "f.near").withColumn("row", F.monotonically_increasing_id()))
    rows = _looked_up(rows, table, small).withColumnRenamed("d", "digest")
    plain = rows.where(F.size("near") == 0).select("doc_id", "digest", "license", F.array().cast("array<string>").alias("notices"))
    some = rows.where(F.size("near") > 0).select("row", "doc_id", "digest", F.col("license").alias("own"), F.explode("near").alias("d"))
    some = _looked_up(some, table, small).groupBy("row", "doc_id", "digest", "own").agg(F.sort_array(F.collect_set("license")).alias("notices"))
    return plain.unionByName(some.select("doc_id", "digest", F.col("own").alias("license"), "notices"))
