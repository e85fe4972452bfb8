"""Licence scan by canonical digest.

A text is brought to a canonical form (A-Z lower-cased, copyright lines dropped,
equivalent spellings made one, punctuation and white space made single spaces)
and the digest of the whole is hash-joined to the digests of known licences.
Each line that begins like a known text is looked up in the same way, for
notices within a text. Known texts are KNOWN and those of a folder, if one is given.
"""

from __future__ import annotations

import re
from itertools import chain
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.llm.shared import checked_broadcast, let, stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that state a copyright.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*$"
#: Spellings that mean the same, fixed values after the SPDX matching guidelines.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("favour", "favor"), ("behaviour", "behavior"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("https://", "http://"))

# Public licence texts and notices.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_PERMISSION = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
KNOWN = (
    ("MIT", f"MIT License\n\n{_PERMISSION}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT", f"{_PERMISSION}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_PERMISSION.split(', subject to')[0]}.\n\n{_WARRANTY}"),
    ("BSD-2-Clause", f"{_REDISTRIBUTION}\n\n{_BSD}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTION}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", f"This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n{_WARRANTY.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')}\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Letters and digits that a line must begin with to be digested: those of some known text.
BEGINS = 3


def canonical(text: Column) -> Column:
    """The canonical form; null gives an empty one."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT, " ")
    # White space first, so that a spelling may run over a line's end.
    out = F.regexp_replace(out, r"[ \t\n\x0b\f\r]+", " ")
    for spelled, one in SPELLINGS:
        out = F.replace(out, F.lit(spelled), F.lit(one))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def licence_texts(spark: SparkSession, folder: str) -> tuple[tuple[str, str], ...]:
    """(licence, text) of the files of a folder, one whole licence each, named by its identifier (with or without .txt).

    For the long licences, whose texts are not kept here: a folder of SPDX texts.
    A catalogue of licences is some thousand texts whatever the corpus.
    """
    names = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")
    rows = spark.read.text(folder, wholetext=True).select(names.alias("licence"), "value").collect()
    return tuple((unquote(r.licence), r.value) for r in sorted(rows))


def catalogue(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, licence) of the known texts, a row per digest."""
    table = spark.createDataFrame(list(known), "licence string, text string")
    return table.filter(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def beginnings(known=KNOWN) -> str:
    """A pattern that matches every line, in lower case, whose canonical form is that of a known text.

    A canonical form keeps a line's letters and digits in order but for the
    SPELLINGS, and these leave the first BEGINS of a word as they are.
    """
    bare = lambda x: re.sub("[^a-z0-9]+", "", x.translate(str.maketrans(UPPER, LOWER)))
    if any(bare(a)[:BEGINS] != bare(b)[:BEGINS] for a, b in SPELLINGS):
        raise ValueError(f"a spelling changes one of its first {BEGINS} letters")
    # A copyright line may stand before the text that counts.
    starts = {bare(re.sub(COPYRIGHT, " ", text.translate(str.maketrans(UPPER, LOWER))))[:BEGINS] for _, text in known} - {""}
    return "^[^a-z0-9]*(?:" + "|".join("[^a-z0-9]*".join(x) for x in sorted(starts)) + ")"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN) -> DataFrame:
    """id, digest of the whole canonical text, licence (null if the whole text is none), notices (licences of its lines, sorted, joined by commas; empty if none).

    The catalogue is a list of licences, so its side is broadcast. Null texts
    have the digest of an empty one, which is no licence. Texts and lines of any
    length are digested whole. Rows stay as they are repeated, an empty table
    stays empty, other columns are ignored.
    """
    spark = docs.sparkSession
    table = stage_table(catalogue(spark, known), "licences")
    notices = {r["digest"]: r["licence"] for r in table.collect()}
    lookup = F.create_map(*(F.lit(x) for x in chain.from_iterable(notices.items())))
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.translate(x, UPPER, LOWER).rlike(beginnings(known)))
    found = let(lines, lambda x: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(x, lambda line: F.try_element_at(lookup, digest(line)))))), ","))
    out = docs.select(id_col, digest(F.col(text_col)).alias("digest"), found.alias("notices"))
    return out.join(checked_broadcast(table), "digest", "left").select(id_col, "digest", "licence", "notices")
