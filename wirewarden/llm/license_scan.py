"""License scan by canonical digest: DataFrame functions only.

A text is normalised (ASCII case, copyright lines, punctuation, equivalent spellings, white space) and its SHA-256 digest is joined with those
of known licence texts. The known texts are a small fixed table, or the caller's; up to MAX_BROADCAST digests are broadcast, more are joined by a shuffle of
digests. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of the normal form, in order: regular expression and replacement (also valid for RE2).
COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[|by )|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
#: Equivalent spellings.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("honour", "honor"), ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"), ("utilis", "utiliz"), ("recognis", "recogniz"), ("authoris", "authoriz"), ("non commercial", "noncommercial"), ("sub license", "sublicense"),
)
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MOZILLA_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.

You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
#: Known digests that are sent to every task.
MAX_BROADCAST = 100_000
#: Names and texts of licences and of one-line notices.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n\nCopyright (c) 2000\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END), ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END), ("BSD-3-Clause", _BSD_START + _BSD_NAME + _BSD_END),
    ("Zlib", _ZLIB), ("BSL-1.0", _BOOST), ("Apache-2.0", _APACHE_NOTICE), ("MPL-2.0", _MOZILLA_NOTICE),
    ("GPL-3.0-or-later", _GNU_NOTICE.format("")), ("LGPL-3.0-or-later", _GNU_NOTICE.format("Lesser ")), ("AGPL-3.0-or-later", _GNU_NOTICE.format("Affero ")),
    ("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), COPYRIGHT, "\n")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    out = F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " ")
    for other, own in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(own))
    return F.trim(out)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).dropDuplicates(["digest"])


def scan(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs as (id, digest, license): the digest of the whole text's normal form and the licence that it is the text
    of, else null. known: (license, digest unique), by default `known_digests`. A null text has a null digest; an empty one
    that of the empty text, which is no licence. Rows that repeat are each returned; other columns are not read."""
    known = known_digests(docs.sparkSession) if known is None else known
    own = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    known = known.select("digest", "license")
    return own.join(F.broadcast(known) if known.count() <= MAX_BROADCAST else known, "digest", "left").select(id_col, "digest", "license")


def oracle(known=KNOWN) -> str:
    """The same in DuckDB SQL, over the view documents."""
    quote = lambda s: s.replace("'", "''")

    def form(x: str) -> str:
        out = f"regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '{quote(COPYRIGHT)}', chr(10), 'g')"
        out = f"regexp_replace({out}, '{quote(PUNCTUATION)}', ' ', 'g')"
        out = rf"regexp_replace({out}, '[ \t\n\x0B\f\r]+', ' ', 'g')"
        for other, own in SPELLINGS:
            out = f"replace({out}, '{other}', '{own}')"
        return f"sha256(trim({out}, ' '))"

    values = ", ".join(f"('{quote(n)}', '{quote(t)}')" for n, t in known)
    return f"""
WITH texts(license, text) AS (VALUES {values}),
known AS (SELECT {form('text')} AS digest, min(license) AS license FROM texts GROUP BY 1)
SELECT doc_id, digest, license FROM (SELECT doc_id, {form('text')} AS digest FROM documents) LEFT JOIN known USING (digest)"""
