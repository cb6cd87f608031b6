"""License scans by canonical digest lookup.

A text is normalised (ASCII case, copyright lines, equivalent spellings, punctuation and white space) and
hashed; whole texts join the digests of known licences by hash. Single lines that mention a licence are looked up
among the same digests as well. Short licences are known under their usual titles, with and without a line that
reserves all rights, and wrapped at the usual widths (a wrapped line may start with "copyright", which the normal form
takes for a notice); long ones by the full texts in licence_texts, with and without what follows their terms.

A null text has no digest and no licence; an empty text has the digest of the empty string. Repeated
rows give repeated rows; extra columns stay; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import pkgutil
import re
import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

COPYRIGHT = r"(^|\n)[\x20\x09]*(copyright|\(c\)|©)[^\n]*"
#: Spellings taken as equal.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("https://", "http://"), ("honour", "honor"), ("favour", "favor"), ("&", " and "))
NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
MENTION = r"(?i)licen[cs]e|public domain|spdx"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_SHORT_ISC = _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END
_OWNER = _BSD_END.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")
#: Short licences: titles and bodies.
SHORT = (
    ("MIT", ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "Expat License"), (_MIT,)),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"), (_SHORT_ISC, _SHORT_ISC.replace("and/or distribute", "and distribute"))),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"), (_ISC_GRANT + ".\n\n" + _ISC_END,)),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License"), tuple(f"{_BSD2}\n\n{e}" for e in (_BSD_END, _OWNER))),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License", "The BSD License"), tuple(f"{_BSD2}\n\n{_BSD3}\n\n{e}" for e in (_BSD_END, _OWNER))),
)
#: Licences whose full texts are in licence_texts.
LONG = ("Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "BSD-3-Clause", "Unlicense")
TERMS_END = "END OF TERMS AND CONDITIONS"
RIGHTS = "All rights reserved."


def _wraps(body: str) -> list[str]:
    """The body as it stands, with and without numbers of its clauses, and wrapped at 60 to 80 characters."""
    bodies = (body, re.sub(r"(?m)^[0-9]\. ", "* ", body))
    return [*bodies, *("\n\n".join(textwrap.fill(x, w, subsequent_indent=ind, break_on_hyphens=False) for x in b.split("\n\n")) for b in bodies for w in range(60, 81) for ind in ("", "   "))]


def _short_texts():
    for name, titles, bodies in SHORT:
        forms = {normalise(w): w for body in bodies for w in _wraps(body)}
        for title, rights, body in itertools.product(("", *titles), ("", RIGHTS), forms.values()):
            yield name, "\n\n".join(x for x in (title, rights, body) if x)


def _long_texts():
    for name in LONG:
        text = pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()
        yield name, text
        head, end, _ = text.partition(TERMS_END)
        if end:
            yield name, head + end
            yield name, head
        if name == "BSD-3-Clause":  # its title and the line that reserves all rights
            yield from ((name, title + "\n\n" + body) for title in SHORT[4][1] for body in (text, text.replace(RIGHTS, "", 1)))
            yield name, text.replace(RIGHTS, "", 1)


def normalise(text: str) -> str:
    """What the column expression does, in Python."""
    t = text.translate(str.maketrans(UPPER, LOWER))
    t = re.sub(COPYRIGHT, r"\1", t)
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", t).strip(" ")


#: Known texts by licence: fixed values.
KNOWN = (
    ("MIT", _MIT), *_short_texts(), *_long_texts(), ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def canonical(col):
    """The digest of a text column's normal form."""
    t = F.regexp_replace(ascii_lower(col), COPYRIGHT, "$1")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.sha2(F.trim(F.regexp_replace(t, NOT_WORD, " ")), 256)


def known_digests(known=KNOWN) -> dict[str, str]:
    return {hashlib.sha256(normalise(text).encode()).hexdigest(): name for name, text in known}


def look_up(docs: DataFrame, text_col: str = "text", known=KNOWN) -> DataFrame:
    """docs plus digest, licence (of the whole text) and notices (of its lines, sorted, comma-joined)."""
    docs = docs.drop("digest", "licence", "notices")
    spark, digests = docs.sparkSession, known_digests(known)
    rows = ", ".join(f"('{d}', '{n}')" for d, n in digests.items())
    names = spark.sql(f"SELECT * FROM VALUES {rows} AS v(digest, licence)")  # Spark sees its size and sends it to all
    of = F.expr("str_to_map('" + ",".join(f"{d}:{n}" for d, n in digests.items()) + "')")
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike(MENTION))
    found = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(of, canonical(x))), lambda x: x.isNotNull()))), ",")
    d = docs.withColumn("digest", canonical(F.col(text_col))).withColumn("notices", F.when(F.col(text_col).rlike(MENTION), found).otherwise(""))
    return d.join(names, "digest", "left")


def op2_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_up(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "licence", "notices")


def _sql(x: str) -> str:
    t = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '\\1', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"sha256(trim(regexp_replace({t}, '{NOT_WORD}', ' ', 'g'), ' '))"


_VALUES = ", ".join(f"('{d}', '{n}')" for d, n in known_digests().items())
QUERIES = {"op2_licence_digests": op2_licence_digests}
SQL = {"op2_licence_digests": f"""
WITH known(digest, licence) AS (VALUES {_VALUES}),
d AS (SELECT row_number() OVER () AS i, doc_id, text, {_sql('text')} AS digest FROM documents),
l AS (SELECT i, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT i, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices
      FROM l JOIN known k ON k.digest = {_sql('l.line')} WHERE regexp_matches(l.line, '{MENTION}') GROUP BY i)
SELECT d.doc_id, d.digest, k.licence, coalesce(n.notices, '') AS notices FROM d LEFT JOIN known k USING (digest) LEFT JOIN n USING (i)
"""}
