"""License scans: whole texts, normalised and digested, against digests of known licence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read_table

#: Lines that name an owner, in lower case.
_OWNER = r"(?m)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\])|\(c\)[ \t]|©)[^\n]*$"
_RESERVED = r"(?m)^[ \t*#/;-]*all rights reserved\.?[ \t\r]*$"
#: Pairs of spellings that licence texts use for one another, after case and punctuation are gone.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"),
    ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("http ", "https "),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Known texts by licence, with and without their titles.
TEXTS = {
    "MIT": [_MIT, f"MIT License\n\n{_MIT}", f"The MIT License (MIT)\n\n{_MIT}"],
    "ISC": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"],
    "0BSD": [f"{_ISC_GRANT}.\n\n{_ISC_END}", f"BSD Zero Clause License\n\n{_ISC_GRANT}.\n\n{_ISC_END}"],
    "BSD-2-Clause": [f"{t}{_BSD_HEAD}\n\n{_BSD_END}" for t in ("", "BSD 2-Clause License\n\n")],
    "BSD-3-Clause": [f"{t}{_BSD_HEAD}\n\n{_BSD_NAMES}\n\n{_BSD_END}" for t in ("", "BSD 3-Clause License\n\n")],
    "Zlib": [_ZLIB, f"zlib License\n\n{_ZLIB}"],
    "Apache-2.0": [_APACHE_NOTICE, "Licensed under the Apache License, Version 2.0."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
}
#: Digests of the long texts in Debian's /usr/share/common-licenses, normalised as below.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "3420cffbc5a189344e1877fb60e7273e53d7e783559abf595c291da52ded4de1",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2-only": "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
    "GFDL-1.3-only": "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
    "GPL-1.0-only": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0-only": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0-only": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0-only": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1-only": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0-only": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    "MPL-2.0": "8f0473f9c917c507827dca355168119bb065ca1a9dab0e366988bcdba5fa039b",
}


def _steps(pattern, replace, lower, trim, x):
    """The normal form of a text, in whichever language the four functions write."""
    x = pattern(pattern(lower(x), _OWNER, ""), _RESERVED, "")
    x = pattern(x, r"[^\p{L}\p{N}]+", " ")
    for old, new in SPELLINGS:
        x = replace(x, old, new)
    return trim(x)


def normal(text: Column) -> Column:
    """Lower case, without owner lines and punctuation, in one spelling."""
    return _steps(F.regexp_replace, lambda x, a, b: F.replace(x, F.lit(a), F.lit(b)), F.lower, F.trim, text)


def known(spark: SparkSession) -> DataFrame:
    """(digest, licence): a fixed table, which is small enough to broadcast whatever the corpus."""
    texts = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(t).alias("text")) for k, ts in TEXTS.items() for t in ts])).alias("r"))
    rows = texts.select(F.sha2(normal(F.col("r.text")), 256).alias("digest"), "r.licence")
    if DIGESTS:
        long_ = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(k).alias("licence")) for k, d in DIGESTS.items()])).alias("r"))
        rows = rows.unionByName(long_.select("r.*"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text_digest, licence) for every row of docs: licence is that of which the whole text is a copy.

    A null text has neither; an empty one, or one of punctuation alone, has a digest and no licence.
    Rows that repeat an id each get a row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.sha2(normal(F.col("text")), 256).alias("text_digest"))
    return rows.join(F.broadcast(known(spark)), F.col("text_digest") == F.col("digest"), "left").select("doc_id", "text_digest", "licence")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, read_table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    form = _steps(lambda x, p, r: f"regexp_replace({x}, {_sql(p)}, {_sql(r)}, 'g')", lambda x, a, b: f"replace({x}, {_sql(a)}, {_sql(b)})", lambda x: f"lower({x})", lambda x: f"trim({x})", "text")
    rows = ", ".join(f"({_sql(k)}, {_sql(t)})" for k, ts in TEXTS.items() for t in ts)
    long_ = "".join(f" UNION ALL SELECT {_sql(d)}, {_sql(k)}" for k, d in DIGESTS.items())
    return f"""
WITH known AS (
  SELECT digest, min(licence) AS licence FROM (
    SELECT sha256({form}) AS digest, licence FROM (VALUES {rows}) AS t(licence, text){long_}
  ) GROUP BY digest
), docs AS (SELECT doc_id, sha256({form}) AS text_digest FROM documents)
SELECT doc_id, text_digest, licence FROM docs LEFT JOIN known ON text_digest = digest
"""


OP5_SQL = _oracle()
