"""Licence scans by canonical digest: whole texts, paragraphs and lines joined with the digests of known licence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import BROADCAST_ROWS, plain_text, row_hash

# Public licence texts and the usual one-line notices, by SPDX identifier.
KNOWN: list[tuple[str, str]] = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
]

#: Spellings that count as equal; spaces are taken out before they are looked for, so wrapping does not matter.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("version 3 0", "version 3"),
    ("v 2 0", "version 2 0"),
]

#: What follows the word in the body of a licence, where a line may happen to begin with it.
BODY = r"(?:notices?|holders?|owners?|laws?|licen[cs]es?|and|or|in|is|are|of|to|statements?|acts?|protection|interests?|permissions?|patents?|disclaimers?)"

#: Fixed value: a line that names the holder of rights, which differs from copy to copy; (c) alone also begins list items,
#: so there it takes a year or a few words only.
COPYRIGHT_LINE = (
    r"(?im)^[^\p{L}\p{N}©(\n]*(?:copyright\b(?=[^\p{L}\p{N}\n]*[\p{L}\p{N}])(?![^\p{L}\p{N}\n]*" + BODY + r"\b)"
    r"|\(c\)(?=[^\n]*\b(?:19|20)\d\d\b|(?:[^\S\n]*+\S++){1,6}+[^\S\n]*$)|©)[^\n]*$"
)


#: How many canonical characters must agree before a unit's digest is made.
_LEAD = 12


def _bare(text: Column) -> Column:
    """Without copyright lines, in lower case, letters and digits only, the line ends kept: the one pass over the text."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, F.lit(COPYRIGHT_LINE), F.lit(""))), r"[^\p{L}\p{N}\n]+", "")


def _spelt(bare: Column) -> Column:
    for spelling, usual in SPELLINGS:
        bare = F.replace(bare, F.lit(spelling.replace(" ", "")), F.lit(usual.replace(" ", "")))
    return bare


def _paragraphs(bare: str) -> Column:
    """What stands between lines without letters and digits (copyright lines are such), each without its line ends."""
    joined = F.transform(F.split(bare, "\n\n+"), lambda p: F.replace(p, F.lit("\n"), F.lit("")))
    return F.filter(joined, lambda p: p != "")


def canonical_licence(text: Column) -> Column:
    """Without copyright lines, in lower case, letters and digits only, equal spellings made one."""
    return _spelt(F.replace(_bare(text), F.lit("\n"), F.lit("")))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, digest, lead, paragraphs) of the known texts, by the same functions as the documents."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "licence string, text string").withColumn("bare", _bare(F.col("text")))
    whole = canonical_licence(F.col("text"))
    return rows.select("licence", F.sha2(whole, 256).alias("digest"), F.left(whole, F.lit(_LEAD)).alias("lead"), F.size(_paragraphs("bare")).alias("paragraphs")).distinct()


def licence_scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, licences (sorted identifiers), n_units, whole.

    Units of a document are its whole text, its lines, and from every paragraph on as many paragraphs as a known text
    has. A unit that begins like a known text is made canonical whole and its digest joined with the known digests, so it
    counts when it is an entire known text, wherever it stands. n_units counts the different known texts found, whole
    tells whether the text as a whole is one. The text is normalised once and only hits are shuffled; the list is
    broadcast behind a count of its rows and may not have more than ``BROADCAST_ROWS``.

    Defined results: null and empty texts, and units without a letter or digit, match nothing; a licence list that is
    empty gives no hit; one text listed under several names gives all of them; rows that share an id but not a text are
    judged each; an empty table gives an empty result; other columns are ignored. A very long text is normalised whole in
    one task, in memory of a few times its size.
    """
    n = known.count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"{n} known texts are more than the {BROADCAST_ROWS} that may be broadcast")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_hash(text_col).alias("text_hash"), _bare(plain_text(text_col)).alias("bare"))
    parts = rows.select("doc_id", "text_hash", _paragraphs("bare").alias("paras"), F.split("bare", "\n").alias("lines"), F.replace("bare", F.lit("\n"), F.lit("")).alias("all"))
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("at"), F.col("all").alias("unit"))),
        F.transform("paras", lambda p, i: F.struct((i + 1).alias("at"), p.alias("unit"))),
        F.transform("lines", lambda line: F.struct(F.lit(-1).alias("at"), line.alias("unit"))),
    )
    each = parts.select("doc_id", "text_hash", "paras", F.inline(units)).withColumn("lead", F.left(_spelt(F.left("unit", F.lit(4 * _LEAD))), F.lit(_LEAD)))
    near = each.join(F.broadcast(known), "lead").filter((F.col("at") >= 0) | (F.col("paragraphs") == 1))
    entire = F.when(F.col("at") > 0, F.array_join(F.slice("paras", F.greatest(F.lit(1), "at"), F.greatest(F.lit(1), "paragraphs")), "")).otherwise(F.col("unit"))
    hits = near.filter((F.length("lead") > 0) & (F.sha2(_spelt(entire), 256) == F.col("digest")))
    by_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("licence")).alias("licences"), F.count_distinct("digest").alias("n_units"), F.max(F.col("at") == 0).alias("whole")
    )
    found = by_doc.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "licences", "n_units", "whole")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    return docs.select(F.col(id_col).alias("doc_id"), row_hash(text_col).alias("text_hash")).join(found, same, "left").select(
        "doc_id",
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"),
        F.coalesce("whole", F.lit(False)).alias("whole"),
    )
