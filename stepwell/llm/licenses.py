"""License scans by canonical digest.

A text is brought to a canonical form: lower case, equivalent spellings made one, lines that state a
copyright (by sign, year, "by" or a placeholder for them) dropped, punctuation and white space
reduced to single spaces. A line that merely begins with the word belongs to the text, so line ends
don't matter. Its SHA-256 is
looked up among the digests of known licences, whole text against whole text. A licence is known
with each of its published titles and without one. A document is
looked up as a whole, and each of its lines as a text of its own, so that a licence notice
standing in a longer document is found too. Lines whose canonical form is empty are not looked up.

Known digests are broadcast while they are few (``MAX_BROADCAST`` rows, counted); beyond that the
same joins are shuffled, and adaptive execution splits the digests that many documents share.

Defined cases: a null text counts as empty, whose canonical form is empty and matches nothing;
repeated rows and ids give a row each; equal canonical forms of two known licences resolve to the
smaller name; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize

MAX_BROADCAST = 100_000

#: (pattern, replacement) in order, on lower-case text. Java and RE2 read them alike.
STEPS = [
    (r"\blicence", "license"),
    (r"\bsub-license", "sublicense"),
    (r"\bnon-commercial", "noncommercial"),
    (r"\bcopyright([^\pL\pN]+)holder(s?)\b", "copyright$1owner$2"),
    (r"https?://", ""),
    (r"\(c\)|\x{a9}", " copyright "),
    (r"(^|\n)[^\pL\pN\n]*(portions )?copyright[ \t]*(copyright\b|\d|by\b|all rights reserved\b|[<\[{])[^\n]*", "$1"),
    (r"\ball rights reserved\b", " "),
    (r"[^\pL\pN\n]+", " "),
]

#: Notices looked for by default. Their published wording.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]

#: Whole short licences. Their published wording, and the titles they are published with.
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
    "OF THIS SOFTWARE."
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:\n\n1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer.\n\n2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n\n"
)
ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission.\n\n"
)
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSES = [
    (
        "MIT",
        ["MIT License", "The MIT License", "The MIT License (MIT)"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:\n\nThe "
        "above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        ["ISC License", "The ISC License"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.\n\n" + AS_IS,
    ),
    (
        "0BSD",
        ["BSD Zero Clause License", "Zero-Clause BSD"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted.\n\n" + AS_IS,
    ),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License"], REDISTRIBUTION + BSD_AS_IS),
    (
        "BSD-3-Clause",
        ["BSD 3-Clause License", "The 3-Clause BSD License"],
        REDISTRIBUTION + ENDORSEMENT + BSD_AS_IS,
    ),
    (
        "Zlib",
        ["zlib License", "The zlib License"],
        "This software is provided 'as-is', without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment "
        "in the product documentation would be appreciated but is not required.\n\n2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
]
KNOWN = [
    *NOTICES,
    *((name, f"{head}{body}") for name, titles, body in LICENSES for head in ("", *(f"{t}\n\n" for t in titles))),
]

#: Canonical digests of long licences as a whole. From their published texts.
#: Where a text ends in an appendix, also those without it, with and without its last line.
DIGESTS = [
    ("Apache-2.0", "673111ae54c4173bc8433f3200a04f229eb09a971ea46f2b7f31b4669954e9ff"),
    ("Apache-2.0", "51c053cebc5bfb1ed05e42ec4868805dd6944edf8695ebfd550d24d738df302d"),
    ("Apache-2.0", "2b84a2593e5db43b337c87c67ba24cb8a529e89f848cea869d1ae0aaa57faefc"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "785af28b53eff48966598de41137cc41ce658c639f6bd4f10247222d62a9607c"),
    ("GFDL-1.3", "59ea49d984ec132e7604fb21afcc0e9da03dc0ef48dfafcd9cc2eaa12513611a"),
    ("GPL-1.0", "0dd6055657537c68401626873e347732e284f7e1f5d33fbccd8791d47450eb38"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-1.0", "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0"),
    ("GPL-2.0", "c5626516907c9b28f97a88db36f7dbe90174e04e4e97c6c772f3a44039e7f51d"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-2.0", "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef"),
    ("GPL-3.0", "3c60f0626ebfd5047a8fecb7975a87632c398af2ffc3f654b0468267ac29a764"),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("GPL-3.0", "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.0", "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "29e875624ff654dd4ec54fe533df83df152625ff21f26f7c229917a2494754ad"),
    ("MPL-2.0", "48c053e1182a1be98be381314f1e8433c3c46bc995b108845dfce1b28ef797c4"),
]


def canonical_lines(text: Column) -> Column:
    """Canonical form that keeps line ends, so that it can be cut into lines."""
    form = F.lower(F.coalesce(text, F.lit("")))
    for pattern, replacement in STEPS:
        form = F.regexp_replace(form, pattern, replacement)
    return form


def one_line(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r" *\n[ \n]*", " "))


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form; null for the empty one, which is no licence."""
    return F.when(form != "", F.sha2(form, 256))


def known_digests(known: DataFrame) -> DataFrame:
    """``(digest, license)`` of ``known`` (license, text, and where only that is at hand the canonical
    text's digest), each digest once."""
    found = digest(one_line(canonical_lines(F.col("text"))))
    if "digest" in known.columns:
        found = F.coalesce(found, "digest")
    return (
        known.select(found.alias("digest"), "license").filter("digest is not null")
        .groupBy("digest").agg(F.min("license").alias("license"))
    )


def known_licenses(spark: SparkSession) -> DataFrame:
    rows = [(name, text, None) for name, text in KNOWN] + [(name, None, found) for name, found in DIGESTS]
    return spark.createDataFrame(rows, "license string, text string, digest string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, digest, license, notices`` per row of ``docs``: the canonical digest of the whole
    text, the licence it is (or null), and the licences found as lines, sorted and joined by ","
    (or null). ``known``: (license, text) or (license, text, digest)."""
    table = known_digests(known)
    if table.count() <= MAX_BROADCAST:
        table = F.broadcast(table)
    by_line = F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = materialize(
        docs.select("doc_id", canonical_lines(F.col("text")).alias("form"))
        .select("doc_id", one_line(F.col("form")).alias("whole"), by_line.alias("lines"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            digest(F.col("whole")).alias("digest"),
            F.transform(F.array_distinct("lines"), lambda x: F.sha2(x, 256)).alias("lines"),
        )
    )
    notices = (
        rows.select("row", F.explode("lines").alias("digest")).join(table, "digest")
        .groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    )
    return (
        rows.drop("lines").join(table, "digest", "left").join(notices, "row", "left")
        .select("doc_id", "digest", "license", "notices")
    )


def scan_sql() -> str:
    """The rows of :func:`scan` over ``documents``, as DuckDB SQL."""

    def canonical(column: str) -> str:
        form = f"lower(coalesce({column}, ''))"
        for pattern, replacement in STEPS:
            form = f"regexp_replace({form}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
        return form

    def line(form: str) -> str:
        return rf"trim(regexp_replace({form}, ' *\n[ \n]*', ' ', 'g'))"

    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    digests = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)
    return f"""WITH listed AS (
    SELECT digest, min(license) AS license
    FROM (SELECT license, sha256({line(canonical("text"))}) AS digest FROM (VALUES {rows}) AS k(license, text)
          UNION ALL SELECT * FROM (VALUES {digests}) AS d(license, digest)) a
    GROUP BY 1),
forms AS (SELECT row_number() OVER () AS r, doc_id, {canonical("text")} AS form FROM documents),
wholes AS (SELECT r, doc_id, {line("form")} AS whole FROM forms),
found AS (
    SELECT r, string_agg(license, ',' ORDER BY license) AS notices
    FROM (SELECT DISTINCT l.r, k.license
          FROM (SELECT r, trim(unnest(string_split(form, chr(10)))) AS one FROM forms) l
          JOIN listed k ON l.one <> '' AND k.digest = sha256(l.one)) m
    GROUP BY r)
SELECT w.doc_id, CASE WHEN w.whole <> '' THEN sha256(w.whole) END AS digest,
       k.license, n.notices
FROM wholes w
LEFT JOIN listed k ON w.whole <> '' AND k.digest = sha256(w.whole)
LEFT JOIN found n ON n.r = w.r"""
