"""Licence scan: canonical digests of entire texts, hash-joined to digests of known licences.

Both sides go through one canonical form: case folded, copyright lines removed, spellings that licence guidelines hold
equivalent made one, and everything that isn't a letter or digit reduced to single spaces. Only built-in functions run.

A null or empty text, or one with nothing left in canonical form, matches nothing. Each document keeps its row, also one
that repeats another, and extra columns of any name are left out. Of licences with one canonical form the least id stays.

A copyright line starts with the word or sign, and goes on as a notice does and a sentence doesn't; the next line belongs to it
if it starts with "and" or the notice ends with a comma. A line of "all rights reserved" goes as well. Names that a BSD text
puts in place of the copyright holder count as it. Short licences are known with and without their usual titles. Not known:
texts with parts added or left out, and translations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that licence-matching guidelines treat as the same, as (written, canonical).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("wilfull", "willful"),
    ("willfull", "willful"),
)

#: Public licence texts and standard notices, by SPDX identifier.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT notice", "Released under the MIT License."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
)

#: Title lines that stand above short licences.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("ISC", "The ISC License"),
    ("Zlib", "zlib License"),
    ("Zlib", "The zlib/libpng License"),
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", "Zero-Clause BSD"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Unlicense", "The Unlicense"),
)

#: Digests of the canonical forms of longer public texts, as a Debian system has them.
DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "0d3c171c5c43c8ba6cb7c5850249fc6766dd85cca709271b31086b150e91716e"),
    ("LGPL-2.0", "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.1", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

#: Words that go on after "copyright" in a sentence and not in a notice.
_SENTENCE = "notices?|holders?|owners?|laws?|licen[cs]es?|licensees?|statements?|interests?|protection|treaty|treaties|and|or|in|of|on|to|is|are|the|as|may|has|which|that|term|status|infringement|disclaimer|rights?|permission|control|claim"
_WORDS = r"(?U)[^\p{L}\p{N}]+"


#: Words on both sides of a name that stands for the copyright holder, and what the words between them become.
_NAMED = (
    ("neither the name of", "the copyright holder", "nor the names of its contributors may be used"),
    ("this software is provided by", "the copyright holders and contributors", "as is and any express or implied warranties including"),
    ("in no event shall", "the copyright holder or contributors", "be liable for any direct indirect incidental"),
)
#: Most characters of such a name.
_NAME = 160


def canonical(text: Column, equivalent: tuple[tuple[str, str], ...] = EQUIVALENT) -> Column:
    """The canonical form; empty for a null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    start = rf"[^\p{{L}}\p{{N}}\r\n©]*(?:copyright(?![\p{{L}}\p{{N}}]|[ \t]+(?:{_SENTENCE})(?![\p{{L}}\p{{N}}]))|\(c\)[ \t]+\d{{4}}|©)"
    more = r"(?:(?<=,)[ \t]*\r?\n[^\r\n]*|\r?\n[^\p{L}\p{N}\r\n]*(?:and|&)[ \t][^\r\n]*)*"
    low = F.regexp_replace(low, rf"(?m)^{start}[^\r\n]*{more}$", " ")
    low = F.regexp_replace(low, r"(?m)^[^\p{L}\p{N}\r\n]*all[ \t]+rights[ \t]+reserved[^\p{L}\p{N}\r\n]*$", " ")
    form = F.trim(F.regexp_replace(low, _WORDS, " "))
    # few texts hold any of these spellings, so one test spares most of them the replacements; words share the blanks between them
    spelled = form
    for written, kept in equivalent:
        spelled = F.regexp_replace(spelled, f"(?<![^ ]){written}(?![^ ])", kept)
    form = F.when(form.rlike("(?<![^ ])(?:" + "|".join(w for w, _ in equivalent) + ")(?![^ ])"), spelled).otherwise(form)
    named = form
    for before, holder, after in _NAMED:
        named = F.regexp_replace(named, f"(?<![^ ]){before} .{{1,{_NAME}}}? {after}(?![^ ])", f"{before} {holder} {after}")
    return F.when(form.contains(_NAMED[1][2]), named).otherwise(form)


def license_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id) of (license_id, text)."""
    forms = licenses.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of ``KNOWN``, plain and under each title, and of ``DIGESTS``."""
    texts = dict(KNOWN)
    rows = [*KNOWN, *((k, f"{title}\n\n{texts[k]}") for k, title in TITLES)]
    made = license_digests(spark.createDataFrame(rows, "license_id string, text string"))
    every = made.unionByName(spark.createDataFrame([(d, k) for k, d in DIGESTS], "digest string, license_id string"))
    return every.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, canonical_digest, license_id): license_id is null where the whole text is no known licence.

    ``digests``: (digest, license_id), a digest once. The documents' side carries digests alone.
    """
    forms = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("__form"))
    own = forms.select(id_col, F.when(F.col("__form") != "", F.sha2("__form", 256)).alias("canonical_digest"))
    known = digests.select(F.col("digest").alias("__digest"), "license_id")
    return own.join(known, F.col("canonical_digest") == F.col("__digest"), "left").select(id_col, "canonical_digest", "license_id")
