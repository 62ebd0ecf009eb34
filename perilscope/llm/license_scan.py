"""Licence recognition by sentences and ordered rules.

A text is cut into sentences; each sentence is normalised (lower case, runs
of other characters than letters, digits and dots inside numbers become one
blank) and mapped to the identifiers of the known licence sentences that it
contains, in the order of the list. The text is then a sequence of identifiers; stretches of other
sentences between them are gaps. Ordered rules, most specific first, match
runs of identifiers with at most ``GAP`` other sentences between neighbours;
matched identifiers are used up, so a general rule cannot claim what a
specific one has. Identifiers that no rule uses count as unmatched.

Everything is a column expression on the row, so nothing is shuffled. Texts
without any cue word, which every known sentence has, skip the work.

A sentence that denies a licence ("not licensed under", "do not use") counts as
any other sentence.

Defined results: null and empty texts have no licences; a licence named twice
is listed twice; each known value of an SPDX line is a licence, any other one
is unmatched; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 2
CUES = ["licen", "copyright", "permission", "warrant", "redistribut", "spdx",
        "public domain", "liab", "endorse", "rights reserved", "misrepresented",
        "plainly marked", "source distribution"]

# Identifier -> phrase that the normalised sentence contains.
SENTENCES = {
    "mit-name": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "mit-notice": "the above copyright notice and this permission notice shall be included",
    "mit-asis": "the software is provided as is without warranty of any kind",
    "mit-liable": "in no event shall the authors or copyright holders be liable",
    "isc-name": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose",
    "bsd-name": "bsd license",
    "bsd-grant": "redistribution and use in source and binary forms",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "may be used to endorse or promote products derived from this software",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is",
    "bsd-liable": "in no event shall the copyright holder",
    "apache2-name": "apache license version 2.0",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-asis": "distributed under the license is distributed on an as is basis",
    "apache2-limits": "for the specific language governing permissions and limitations",
    "gpl-free": "you can redistribute it and or modify it",
    "gpl-v3": "either version 3 of the license",
    "gpl-v2": "either version 2 of the license",
    "gpl-v21": "either version 2.1 of the license",
    "lgpl21-name": "gnu lesser general public license version 2.1",
    "lgpl3-name": "gnu lesser general public license version 3",
    "lgpl-name": "gnu lesser general public license",
    "agpl-name": "gnu affero general public license",
    "gpl3-name": "gnu general public license version 3",
    "gpl2-name": "gnu general public license version 2",
    "gpl-name": "gnu general public license",
    "gpl-hope": "distributed in the hope that it will be useful but without any warranty",
    "mpl2-name": "mozilla public license v 2.0",
    "mpl2-name-long": "mozilla public license version 2.0",
    "epl2-name": "eclipse public license v 2.0",
    "epl2-name-long": "eclipse public license version 2.0",
    "epl2-name-short": "eclipse public license 2.0",
    "epl1-name": "eclipse public license v1.0",
    "epl1-name-long": "eclipse public license version 1.0",
    "boost-name": "boost software license version 1.0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization "
                   "obtaining a copy of the software and accompanying documentation covered "
                   "by this license",
    "zlib-name": "zlib license",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "zlib-altered": "altered source versions must be plainly marked as such",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "cc0-name": "licensed under cc0 1.0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4.0",
    "cc-by-nc-nd": "licensed under cc by nc nd 4.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-by-nd": "licensed under cc by nd 4.0",
    "cc-by": "licensed under cc by 4.0",
    "spdx": "spdx license identifier",
    "reserved": "all rights reserved",
}
# Licences whose SPDX values are known; a line becomes one sentence
# a value (see spdx_lines), "-only", "-or-later" and "+" left out.
SPDX = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0",
        "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0",
        "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
        "CC-BY-ND-4.0", "CC-BY-4.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Zlib"]
SENTENCES |= {f"spdx {x}": f"spdx license identifier {x.lower().replace('-', ' ')} spdx"
              for x in SPDX}
# A sentence that names the version is not also the unversioned name.
INCLUDED = {"gpl-name": ["gpl3-name", "gpl2-name"],
            "lgpl-name": ["lgpl21-name", "lgpl3-name"], "spdx": [f"spdx {x}" for x in SPDX]}

# GNU notices: the version stands before the name, or after it when a ";" cuts
# the sentence; the whole notice goes on with the warranty and the name again.
GNU = [(licence, ["gpl-free", *order, *["gpl-hope"][:rest], *[name] * (rest - 1)])
       for rest in (3, 2, 1, 0)
       for licence, version, name in (("GPL-3.0", "gpl-v3", "gpl-name"),
                                      ("GPL-2.0", "gpl-v2", "gpl-name"),
                                      ("LGPL-2.1", "gpl-v21", "lgpl-name"),
                                      ("LGPL-3.0", "gpl-v3", "lgpl-name"),
                                      ("AGPL-3.0", "gpl-v3", "agpl-name"))
       for order in ([version, name], [name, version])]
# Notices of one version only: "under the terms of the ... version 2 as published".
GNU += [(licence, ["gpl-free", name, *["gpl-hope"][:rest], *[plain] * (rest - 1)])
        for rest in (3, 2, 1, 0)
        for licence, name, plain in (("GPL-2.0", "gpl2-name", "gpl-name"),
                                     ("GPL-3.0", "gpl3-name", "gpl-name"),
                                     ("LGPL-2.1", "lgpl21-name", "lgpl-name"),
                                     ("LGPL-3.0", "lgpl3-name", "lgpl-name"))]

# Ordered rules, licence -> identifiers in order.
RULES = [
    *((x, [f"spdx {x}"]) for x in SPDX),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis"]),
    ("Apache-2.0", ["apache2-name", "apache2-use", "apache2-copy", "apache2-asis",
                    "apache2-limits"]),
    ("Apache-2.0", ["apache2-name", "apache2-use"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    *GNU,
    ("Unlicense", ["unlicense-free"]),
    ("BSL-1.0", ["boost-name"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-asis", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
    ("Zlib", ["zlib-name"]),
    ("EPL-2.0", ["epl2-name"]),
    ("EPL-2.0", ["epl2-name-long"]),
    ("EPL-2.0", ["epl2-name-short"]),
    ("EPL-1.0", ["epl1-name"]),
    ("EPL-1.0", ["epl1-name-long"]),
    ("LGPL-2.1", ["lgpl21-name"]),
    ("LGPL-3.0", ["lgpl3-name"]),
    ("LGPL", ["lgpl-name"]),
    ("AGPL", ["agpl-name"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("GPL-2.0", ["gpl2-name"]),
    ("GPL", ["gpl-name"]),
    ("MPL-2.0", ["mpl2-name"]),
    ("MPL-2.0", ["mpl2-name-long"]),
    ("Apache-2.0", ["apache2-name"]),
    ("MIT", ["mit-name"]),
    ("ISC", ["isc-name"]),
    ("BSD", ["bsd-name"]),
    ("CC0-1.0", ["cc0-name"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-4.0", ["cc-by"]),
]

CUE = "(?i)" + "|".join(c.replace(" ", r"[^A-Za-z0-9]+") for c in CUES)
# A sentence ends at a mark before white space, or at a blank line; the dot of an
# abbreviation of "version" or "number" does not end one.
SENTENCE_END = r"(?<!\b(?:v|V|ver|Ver|no|No))[.!?;:]+(?=\s|$)|\n\s*\n"
# A sentence that says this names a licence that does not hold.
DENIED = " (?:not (?:be )?(?:licensed|released|available) under|do not use|don t use) "
# "SPDX-License-Identifier:" and its values, which AND and OR connect; the
# exceptions after WITH are not licences.
SPDX_LINE = (r"(?i)(?:\bspdx[^A-Za-z0-9]+license[^A-Za-z0-9]+identifier[ \t]*:[ \t]*|(?!^)\G)"
             r"\(*([A-Za-z0-9][A-Za-z0-9.+-]*?)(?:-only|-or-later|\+)?(?![A-Za-z0-9+-]|\.[A-Za-z0-9])"
             r"\)*(?:[ \t]+(?-i:WITH)[ \t]+[A-Za-z0-9.-]+\)*)?(?:[ \t]+(?-i:AND|OR)[ \t]+)?")


def normalise(sentence: Column) -> Column:
    """Lower case; all but letters, digits and dots between digits become single
    blanks, with one blank at either end."""
    plain = F.regexp_replace(F.lower(sentence), r"(?<=\d)\.(?=\d)", "\u0001")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\u0001]+", " ")
    return F.concat(F.lit(" "), F.trim(F.translate(plain, "\u0001", ".")), F.lit(" "))


def spdx_lines(text: Column) -> Column:
    """Every value of an SPDX line as a sentence of its own."""
    return F.when(text.rlike("(?i)spdx"), F.regexp_replace(
        text, SPDX_LINE, "\n\nSPDX-License-Identifier $1 SPDX\n\n")).otherwise(text)


def identifiers(text: Column) -> Column:
    """Numbers of the known sentences in order, -1 for every other sentence."""
    number = {name: k for k, name in enumerate(SENTENCES)}

    def one(sentence: Column, spdx: bool) -> Column:
        has = {name: F.contains(normalise(sentence), F.lit(f" {phrase} "))
               for name, phrase in SENTENCES.items() if spdx or not name.startswith("spdx")}
        for name, over in INCLUDED.items():
            for x in over if name in has else []:
                has[name] = has[name] & ~has[x]
        found = F.array_compact(F.array(*[F.when(h, number[n]) for n, h in has.items()]))
        denied = normalise(sentence).rlike(DENIED)
        return F.when(denied | (F.size(found) == 0), F.array(F.lit(-1))).otherwise(found)

    # Sentences without a cue cannot be known ones.
    other = F.array(F.lit(-1))
    return F.flatten(F.transform(F.split(spdx_lines(text), SENTENCE_END), lambda s: F.when(
        s.rlike("(?i)spdx"), one(s, True)).when(s.rlike(CUE), one(s, False)).otherwise(other)))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``licenses`` (in order of the text) and ``n_unmatched``."""
    t = F.coalesce(F.col(text), F.lit(""))
    number = {name: k for k, name in enumerate(SENTENCES)}
    code = F.array_join(F.transform(identifiers(t), lambda i: F.when(
        i < 0, F.lit(".")).otherwise(F.concat(F.lit("<"), i.cast("string"), F.lit(">")))), "")
    df = docs.select(*keep, F.when(t.rlike(CUE), code).otherwise("").alias("__code"))
    out = F.col("__code")
    for k, (_, ids) in enumerate(RULES):
        rule = ("\\.{0,%d}" % GAP).join(f"<{number[i]}>" for i in ids)
        out = F.regexp_replace(out, rule, f"<={k}>")
    names = F.array(*[F.lit(n) for n, _ in RULES])
    found = F.transform(F.regexp_extract_all("__code", F.lit(r"<=(\d+)>"), F.lit(1)),
                        lambda x: F.get(names, x.cast("int")))
    return (df.withColumn("__code", out)
            .withColumn("licenses", found)
            .withColumn("n_unmatched", F.regexp_count("__code", F.lit(r"<\d+>"))
                        .cast("bigint")).drop("__code"))
