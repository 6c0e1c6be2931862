"""Documents that are, as a whole, a known licence text.

Method (canonical digest lookup).  A text is brought to a canonical form: A-Z lower, copyright
notices dropped, punctuation and white space as single spaces, equivalent spellings made one.
A notice is a line that begins with "copyright" and a mark or a year, or with a mark and a
year, the first line of a text if it begins with "copyright", and the words "all rights
reserved".  Blank forms of a notice, and the notice of a licence's own publisher, which stand
inside licence texts, are found across line breaks, so that a text with other breaks has the
same form; other words after "copyright" are running text and stay.  The SHA-256 digest of the form is looked up among the digests
of known licences, which went through the same steps.  Only built-in functions are used, no
row is shuffled: the table of licences is a parameter of fixed size and is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[ \t\r\n]"
_MARK = r"(\(c\)|©)"
_FIELD = rf"([<\[{{][^>\]}}]*[>\]}}]|_+|year|yyyy|19yy|name{_GAP}+of{_GAP}+author|your{_GAP}+name)"
# What goes or is put differently, in this order, after A-Z are lower.
NOTICES = [
    (rf"copyright{_GAP}*{_MARK}?[0-9, \t\r\n-]*free{_GAP}+software{_GAP}+foundation", " free software foundation "),
    (rf"copyright{_GAP}*{_MARK}?{_GAP}*{_FIELD}({_GAP}*,?{_GAP}*{_FIELD})*", " "),
    (rf"all{_GAP}+rights{_GAP}+reserved", " "),
    (r"^[ \t\r\n]*copyright[^\n]*\n", "\n"),
    (rf"(^|\n)[ \t]*(copyright[ \t]*({_MARK}|[0-9][0-9][0-9][0-9])|{_MARK}[ \t]*(copyright[ \t]*)?[0-9][0-9][0-9][0-9])[^\n]*", "\n"),
]
BLANK = "[\\x00-/:-`{-\\x7f“”‘’«»–—…•©\u0085   -​    　﻿]+"
# Pairs of spellings that mean the same in licence texts.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("recognised", "recognized"), ("favour", "favor"), ("behaviour", "behavior"), ("honour", "honor"),
    ("judgement", "judgment"), ("fulfilment", "fulfillment"), ("per cent", "percent"),
    ("copyright holder ", "copyright owner "), ("copyright holders", "copyright owners"),
    ("https ", "http "), ("merchantibility", "merchantability"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

"""
_CLAUSES = [
    """Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    """Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
]
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd(name: str, clauses: int) -> list[str]:
    """The template with numbers or bullets, with its title or without."""
    return [
        head + _REDISTRIBUTION + "\n\n".join(f"{mark(i)} {c}" for i, c in enumerate(_CLAUSES[:clauses], 1)) + "\n\n" + _BSD_END
        for head in ("", f"BSD {clauses}-Clause License\n\n", name)
        for mark in (lambda i: f"{i}.", lambda i: "*")
    ]


def _full_texts() -> dict[str, list[str]]:
    """The files of ``licenses/``, named by licence and number.  With an appendix on how to
    apply the terms, also the text without it."""
    found: dict[str, list[str]] = {}
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        texts = found.setdefault(path.stem.split("~")[0], [])
        texts.append(text)
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        if end:
            texts += [text[: end.end()], text[: end.start()]]
    return found


# Texts of known licences.
KNOWN = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT],
    "ISC": [_ISC + "\n\n" + _AS_IS, "ISC License\n\n" + _ISC + "\n\n" + _AS_IS],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted.\n\n" + _AS_IS
    ],
    "BSD-2-Clause": _bsd("Simplified BSD License\n\n", 2),
    "BSD-3-Clause": _bsd("New BSD License\n\n", 3),
}
for _name, _texts in _full_texts().items():
    KNOWN[_name] = [*KNOWN.get(_name, []), *_texts]


def canonical_text(text: str) -> str:
    """The canonical form in plain Python; for the known texts and for tests."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    for pattern, instead in NOTICES:
        text = re.sub(pattern, instead, text)
    text = re.sub(BLANK, " ", text).strip(" ") + " "
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return text


def canonical(text: Column) -> Column:
    """The canonical form as a column."""
    text = F.translate(text, UPPER, LOWER)
    for pattern, instead in NOTICES:
        text = F.regexp_replace(text, pattern, instead)
    text = F.concat(F.btrim(F.regexp_replace(text, BLANK, " "), F.lit(" ")), F.lit(" "))
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def known_digests(known: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [
        (hashlib.sha256(canonical_text(t).encode()).hexdigest(), name) for name, texts in known.items() for t in texts
    ]


def license_scan(docs: DataFrame, known: dict[str, list[str]] = KNOWN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, digest, license`` per row; license is null where the digest is not known.

    Null text: null digest.  Empty text: a digest that no licence has.  Null and repeated
    ids: kept.  Empty table: no rows.  Other columns are not read.
    """
    rows = [*dict(known_digests(known)).items()]
    table = docs.sparkSession.createDataFrame(rows, "known string, license string")
    own = docs.select(
        F.col(doc_id).alias("doc_id"), F.sha2(canonical(F.col(text).cast("string")), 256).alias("digest")
    )
    return own.join(F.broadcast(table), own["digest"] == table["known"], "left").select("doc_id", "digest", "license")


def op4(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_sql() -> str:
    form = f"translate(text, '{UPPER}', '{LOWER}')"
    for pattern, instead in NOTICES:
        form = f"regexp_replace({form}, '{pattern}', {'chr(10)' if instead == chr(10) else repr(instead)}, 'g')"
    form = f"trim(regexp_replace({form}, '{BLANK}', ' ', 'g'), ' ') || ' '"
    for a, b in SPELLINGS:
        form = f"replace({form}, '{a}', '{b}')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in dict(known_digests(KNOWN)).items())
    return f"""
WITH known(digest, license) AS (VALUES {values}),
own AS (SELECT doc_id, sha256({form}) AS digest FROM documents)
SELECT doc_id, digest, license FROM own LEFT JOIN known USING (digest)
"""
