"""Licence scans by canonical digest.

A text is brought to a canonical form (ASCII lower case, a title line and copyright lines dropped, equivalent spellings made one, everything
but letters and digits made single spaces) and its SHA-256 is joined with a table of known licence digests by hash.
The whole text is looked up, and so is each line that speaks of a licence, both in the same table.

Defined cases: a null text has no digest and no licence; a text without letters or digits has an empty form and no licence;
repeated rows and null ids keep a row each; other columns are ignored; an empty table of known digests finds nothing.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices as published, without their copyright lines.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution.\n"
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_AS_IS,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice "
        "may not be removed or altered from any source distribution."
    ),
    "BSD-2-Clause": _BSD + _BSD_AS_IS,
    "BSD-3-Clause": (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.\n" + _BSD_AS_IS
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
        + "For more information, please refer to <https://unlicense.org>"
    ),
}
# Digests of the canonical forms of long licence texts as published.
PUBLISHED = {
    "86b04a6e5baf211a30858c182d594e28d3b084e9bd2a4bafa3464a6a1518ef6e": "Apache-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "5d50b1d75b72aeb70d4066e47ea73f92a95bdc7a5db0c674a4f54394111bc3b6": "GFDL-1.2",
    "67a97f593c41b9a69d9e3f058a58ec91da5f9d4364f26bd470d38bf3091edc68": "GFDL-1.3",
    "9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c": "GPL-1.0",
    "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f": "GPL-2.0",
    "25c090443e3540e3493172ea88c9181108effea290e12e68da7dcd1c51b4cd7a": "GPL-3.0",
    "f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e": "LGPL-2.0",
    "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4": "LGPL-2.1",
    "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765": "LGPL-3.0",
    "64a49d83bd8fd7a03e3441cca62f1c189748f458c0dcc541f24fe62524b4d833": "MPL-1.1",
    "d0c5ff4b1b1df9ae8ac7381433e58aaf10308f4e9fd6a32597b6b0e01220a0a6": "MPL-2.0",
}
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
}
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
)
#: A line that names a holder or a year; one that goes on about the copyright notice is part of the licence.
COPYRIGHT_LINE = r"(?m)^[\x20\x09]*(copyright[^\n]*([0-9]{4}|\(c\)|©)|\(c\)|©|all rights reserved)[^\n]*$"
#: A first line that only names the licence.
TITLE_LINE = r"\A\s*[a-z0-9 ./\"'-]{0,60}licen[cs]e[a-z0-9 ().,-]{0,30}\n"
ABOUT = "licen[cs]e|released under"


def canonical(text: Column) -> Column:
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(F.regexp_replace(out, TITLE_LINE, " "), COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_text(text: str) -> str:
    """The same for a text at hand."""
    out = "".join(c.lower() if c.isascii() else c for c in text)
    out = re.sub("[^a-z0-9]+", " ", re.sub(COPYRIGHT_LINE, " ", re.sub(TITLE_LINE, " ", out))).strip(" ")
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def known_digests() -> dict[str, str]:
    """Digest of each known canonical text, and the licence it stands for."""
    known = {text: name for name, text in TEXTS.items()} | NOTICES
    return PUBLISHED | {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for t, name in known.items()}


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(known_digests().items()), "digest string, licence string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, digest of the canonical text, licence of the whole text, notices (licences of its lines,
    sorted, each once)."""
    own = known is None
    known = known_table(docs.sparkSession) if own else known.select("digest", "licence").dropDuplicates(["digest"])
    # The table of this module is as large as the module, whatever the corpus; another one is joined as Spark sees fit.
    known = F.broadcast(known) if own else known
    form = canonical(F.col(text_col))
    lines = F.filter(F.split(text_col, "\n", -1), lambda l: F.lower(l).rlike(ABOUT))
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(form != "", F.sha2(form, 256)).alias("digest"),
        F.array_distinct(F.transform(lines, lambda l: F.sha2(canonical(l), 256))).alias("lines"),
    )
    df = df.join(known, "digest", "left")
    # Lines are told apart by what they say, wherever they are: each list of lines is asked once.
    df = df.withColumn("asked", F.when(F.size("lines") > 0, F.sha2(F.array_join("lines", ","), 256)))
    asked = df.where("asked is not null").select("asked", F.explode("lines").alias("digest")).distinct()
    found = asked.join(known, "digest").groupBy("asked").agg(F.array_sort(F.collect_set("licence")).alias("notices"))
    none = F.array().cast("array<string>")
    # Documents that ask nothing are dealt by their own hash, not all to one place.
    df = df.withColumn("asked", F.coalesce("asked", F.concat(F.lit("-"), F.xxhash64("doc_id", "digest").cast("string"))))
    return df.join(found, "asked", "left").select("doc_id", "digest", "licence", F.coalesce("notices", none).alias("notices"))
