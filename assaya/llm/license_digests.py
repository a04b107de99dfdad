"""Licence scans by canonical digests of entire texts.

A text is brought to a canonical form: lower case, lines that state a copyright
dropped, equivalent spellings made one, every run of anything but letters and
digits one blank, none at the ends. Its SHA-256 is joined to the digests of known
licence texts in the same form. The known texts are a fixed list of a few
hundred texts and digests, so that side is broadcast and documents are never shuffled.

Cases: a null text counts as empty and is no licence; texts of any length are
hashed whole; repeated rows give repeated rows; where two known texts have one
digest the first name in order is given; an empty table gives an empty result;
further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm.common import read_table

#: Spellings that count as equal, each with the one that stands for it.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sub license": "sublicense", "sub licence": "sublicense", "utilisation": "utilization", "whilst": "while",
    "wilful": "willful", "https": "http", "per cent": "percent",
}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MAY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Known licence texts and notices, by name, as the SQL twin has them; the last four are the notices of the test tables' documents.
KNOWN = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}""",
    "MIT-0": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so.
{_AS_IS}""",
    "ISC": f"""{_MAY}, provided that the above copyright notice and this permission notice appear in all copies.
{_ISC}""",
    "0BSD": f"""{_MAY}.
{_ISC}""",
    "BSD-2-Clause": _BSD + _BSD_AS_IS,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_AS_IS,
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
}
#: Further whole texts that are short.
SHORT = {
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: Titles under which files carry the texts above.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), "MIT-0": ("MIT No Attribution",),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License"),
    "zlib": ("zlib License", "The zlib License"), "Unlicense": ("The Unlicense",),
}
#: Names of licences in notices: each stands in each of the PHRASES.
NOTICES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "MIT": ("MIT License",),
    "ISC": ("ISC License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"), "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",), "BSL-1.0": ("Boost Software License, Version 1.0",), "zlib": ("zlib License",), "Unlicense": ("Unlicense",),
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"Creative Commons {n} {v} International License" if v == "4.0" else f"Creative Commons {n} {v} License")
       for v in ("3.0", "4.0")
       for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
}
PHRASES = [f"{x} {y}" for x in ("Licensed", "Released", "This work is licensed", "Distributed", "Available") for y in ("under", "under the", "under a")]
#: Canonical digests of long licence texts, of whole files (one more where Apache's copyright line is filled in, and
#: GPL-3.0 in another layout) and of the terms without the appendix on how to apply them.
DIGESTS: dict[str, str] = {
    "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3": "Apache-2.0",
    "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64": "Apache-2.0",
    "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2",
    "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e": "GFDL-1.2",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3",
    "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
    "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de": "MPL-2.0",
    "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b": "Apache-2.0",
    "e3bf3885c5430a966308347dfd1ec18e6cd9f97456f83f3341387cc29c411420": "GPL-3.0",
}


def further() -> list[tuple[str, str]]:
    """(name, text) of SHORT, of texts under their titles, and of notices."""
    texts = KNOWN | SHORT
    titled = [(k, f"{title}\n{texts[k]}") for k, titles in TITLES.items() for title in titles]
    notices = [(f"{k} notice", f"{phrase} {name}.") for k, names in NOTICES.items() for name in names for phrase in PHRASES]
    return [*SHORT.items(), *titled, *notices]


_COPYRIGHT = r"(^|\n)[^\n\p{L}\p{N}]*(copyright|\(c\)|©)[ \t]*[^\n\p{L}]*(\(c\)|©|\d)[^\n]*"
_RIGHTS = r"(^|\n)[^\n\p{L}\p{N}]*all rights reserved[^\n\p{L}\p{N}]*"


_WORDS = regex.compile(r"[\p{L}\p{N}]+").findall
_LINES = [(("copyright", "(c)", "©"), regex.compile(_COPYRIGHT)), (("all rights reserved",), regex.compile(_RIGHTS))]
_SINGLE = {k: v for k, v in SPELLINGS.items() if " " not in k}
_PHRASES = {f" {k.replace(' ', '  ')} ": f" {v.replace(' ', '  ')} " for k, v in SPELLINGS.items() if " " in k}


def canonical(low: str) -> str:
    """The canonical form of a text in lower case: words are told and their spellings looked up in one pass."""
    for marks, lines in _LINES:
        if any(m in low for m in marks):
            low = lines.sub(r"\1", low)
    words = [_SINGLE.get(w, w) for w in _WORDS(low)]
    whole = " ".join(words)
    if any(p.strip().replace("  ", " ") in whole for p in _PHRASES):
        whole = f" {'  '.join(words)} "  # doubled blanks let each word have a blank of its own on both sides
        for phrase, stands in _PHRASES.items():
            whole = whole.replace(phrase, stands)
        whole = " ".join(whole.split())
    return whole


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """canonical_sha256 and license_id of the known texts (``known`` in place of all of them), one row for each digest."""
    texts = [*KNOWN.items(), *further()] if known is None else list(known.items())
    names: dict[str, str] = dict(DIGESTS) if known is None else {}
    for name, text in texts:
        digest = hashlib.sha256(canonical(text.lower()).encode()).hexdigest()
        names[digest] = min(name, names.get(digest, name))
    return spark.createDataFrame(list(names.items()), "canonical_sha256 string, license_id string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and canonical_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hashlib.sha256(canonical(x).encode("utf-8", "surrogatepass")).hexdigest() for x in batch.column("low").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "canonical_sha256"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lower(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("low"))
    return rows.mapInArrow(run, "doc_id long, canonical_sha256 string")


def match(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id (null if none) and is_license of every document."""
    found = F.broadcast(known_digests(docs.sparkSession, known))  # as many rows as there are known texts
    out = digests(docs).join(found, "canonical_sha256", "left")
    return out.select("doc_id", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(read_table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern in (_COPYRIGHT, _RIGHTS):
        out = f"regexp_replace({out}, '{pattern}', '\\1', 'g')"
    out = rf"' ' || replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ', '  ') || ' '"
    for spelling, stands in SPELLINGS.items():
        out = f"replace({out}, ' {spelling.replace(' ', '  ')} ', ' {stands.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN.items())
    return f"""
WITH known AS (
  SELECT sha256({_sql_canonical("text")}) AS canonical_sha256, min(license_id) AS license_id
  FROM (VALUES {quoted}) AS k(license_id, text) GROUP BY 1
), t AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, t.canonical_sha256, license_id, license_id IS NOT NULL AS is_license
FROM t LEFT JOIN known ON t.canonical_sha256 = known.canonical_sha256
"""


OP3_SQL = _sql()
