"""License scans by canonical digest, in DataFrame functions alone.

A text is normalised (lower case, no copyright lines, American spellings, runs of anything but
letters and digits as one space), hashed whole by SHA-256 and hash-joined to the digests of known license texts. The same is
done for every line, against known one-line notices, so a notice inside a longer document is found too.
The join is an equi-join whose side Spark chooses by the size of the table of licenses.

Defined cases: a null or empty text, and one of copyright lines alone, has no license; each row gives one
result; of several known texts with one digest the smallest license id counts; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import pick, row_key, text_of, written

#: Spellings that count as equal, in the order in which they are applied.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "cancelled": "canceled", "catalogue": "catalog",
    "centre": "center", "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "fulfil ": "fulfill ", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labour": "labor", "licence": "license", "merchantibility": "merchantability", "non commercial": "noncommercial", "non infringement": "noninfringement", "organisation": "organization", "per cent": "percent", "programme ": "program ",
    "recognise": "recognize", "sub license": "sublicense", "sub licence": "sublicense", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful ": "willful ",
}
#: What the operator drops: a line that begins with copyright, (c), © or "all rights reserved" and is a statement, not a line of a license text wrapped before
#: "copyright notice" or an item "(c)". A statement has a year or a sign, or "copyright" and a name, not a word of prose.
_YEAR, _SIGN = r"(?=[^\n]*\b(?:19|20)\d\d\b)", r"[ :]*(?:\(c\)|©|[0-9]|(?:by|the)\b(?=[^\n]*\b(?:19|20)\d\d\b))"
_PROSE = "a|an|and|any|applicable|are|as|assignment|at|be|by|can|claims?|disclaimers?|doctrines?|does|except|for|from|has|if|in|infringement|interests?|is|it|laws?|licen[cs]es?|licensors?|like|may|more|of|on|or|patent|permission|protection|provided|resulting|rights?|shall|statements?|status|such|that|the|then|this|those|to|treaty|under|unless|was|when|which|will|with|would|your?"
COPYRIGHT_STATEMENT = rf"(?m)^[^\S\n]*(?:copyright(?=[ :(])(?![ :]*(?:notices?|holders?|owners?|ownership)\b)(?:{_SIGN}|(?![ :]*(?:{_PROSE})\b)(?=[ :]*[\p{{L}}<\[{{]))|\(c\)(?:(?=[^\S\n]*copyright)|{_YEAR})|©|all rights reserved)[^\n]*$"

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Public license texts and notices; the query and its SQL know more_texts() and more_notices().
KNOWN_TEXTS = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _NO_WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
]
KNOWN_NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: Titles that texts above and below are found with; without a title they are found too.
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License"], "Zlib": ["zlib License", "The zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
}
#: Names by which a one-line notice calls a license.
_NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "0BSD": ["Zero-Clause BSD License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"], "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"], "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("3.0", "4.0"):
        _NAMES[f"CC-{_kind}-{_version}"] = [f"CC {_kind} {_version}", f"CC-{_kind}-{_version}"]
_FORMS = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This project is licensed under the {}.", "This software is licensed under the {}.", "This program is licensed under the {}.", "License: {}"]
_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


def more_texts() -> list[tuple[str, str]]:
    """KNOWN_TEXTS and the files of license_texts, each as it is, without its title and with other titles; Apache-2.0 without its appendix too."""
    files = []
    for name in sorted(os.listdir(_FOLDER)):
        with open(os.path.join(_FOLDER, name), encoding="utf-8") as f:
            files.append((name.removesuffix(".txt"), f.read()))
    bare = [(i, t.split("\n\n", 1)[1]) for i, t in KNOWN_TEXTS]
    bare += [(i, t) for i, t in files if i in _TITLES]
    bare += [(i, re.sub(r"(?m)^[0-9]\. ", "", t)) for i, t in bare if i.startswith("BSD-")]
    apache = [(i, t[: t.index("END OF TERMS AND CONDITIONS") + n]) for i, t in files if i == "Apache-2.0" for n in (0, 27)]
    return KNOWN_TEXTS + files + bare + apache + [(i, f"{title}\n\n{t}") for i, t in bare for title in _TITLES[i]]


def more_notices() -> list[tuple[str, str]]:
    """KNOWN_NOTICES, notices in common forms, and SPDX tags of the same licenses."""
    said = [(i, form.format(name)) for i, names in _NAMES.items() for name in names for form in _FORMS]
    tags = [(i, f"SPDX-License-Identifier: {i}{end}") for i in _NAMES for end in (["", "-only", "-or-later", "+"] if "GPL" in i else [""])]
    return KNOWN_NOTICES + said + tags


def with_canonical(rows: DataFrame, kept: str = "") -> DataFrame:
    """rows with ``text`` normalised; line ends stay if ``kept`` is a line end, and each line has a space at both ends.

    Each step is a column that the next uses more than once; Spark doesn't merge such steps, so none runs twice.
    """
    others = [c for c in rows.columns if c != "text"]
    text = F.col("text")
    lower = rows.select(*others, F.lower(text).alias("text"))
    marked = text.contains("copyright") | text.contains("(c)") | text.contains("©") | text.contains("all rights reserved")
    unsigned = F.when(marked, F.regexp_replace(text, COPYRIGHT_STATEMENT, " ")).otherwise(text)
    bare = F.regexp_replace(unsigned, rf"[^\p{{L}}\p{{N}}{kept}]+", " ")
    bare = F.replace(bare, F.lit(kept), F.lit(f" {kept} ")) if kept else F.trim(bare)
    plain = lower.select(*others, F.concat(F.lit(" "), bare, F.lit(" ")).alias("text"))
    spelled = text
    for odd, usual in SPELLINGS.items():
        spelled = F.replace(spelled, F.lit(f" {odd}"), F.lit(f" {usual}"))
    return plain.select(*others, F.when(text.rlike(" (?:" + "|".join(SPELLINGS) + ")"), spelled).otherwise(text).alias("text"))


def with_digest(rows: DataFrame, name: str) -> DataFrame:
    """rows with, instead of ``text``, the SHA-256 of the normalised text; null if nothing is left."""
    others = [c for c in rows.columns if c != "text"]
    trimmed = with_canonical(rows).select(*others, F.trim("text").alias("text"))
    return trimmed.select(*others, F.when(F.col("text") != "", F.sha2("text", 256)).alias(name))


def line_digests(rows: DataFrame) -> DataFrame:
    """rows with, instead of ``text``, the digest of each distinct normalised line that is not empty, one a row.

    Texts are normalised whole, before lines are exploded.
    """
    others = [c for c in rows.columns if c != "text"]
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda line: F.trim(line)))
    found = F.transform(F.filter(lines, lambda line: line != ""), lambda line: F.sha2(line, 256))
    return with_canonical(rows, kept="\n").select(*others, F.explode(found).alias("digest"))


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """A table of licenses: license_id, text."""
    return spark.createDataFrame(texts, "license_id string, text string")


def digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id), one row a digest; a written table, so Spark knows its size when it picks a join."""
    rows = pick(licenses, license_id="license_id", text="text")
    every = with_digest(rows.select("license_id", text_of().alias("text")), "digest").where("digest is not null")
    return written(every.groupBy("digest").agg(F.min("license_id").alias("license_id")), "license-digests")[0]


def scan_licenses(docs: DataFrame, licenses: DataFrame, notices: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text_digest, license_id (of the whole text, or null), notices (ids of notice lines, sorted and comma-joined) for every row."""
    rows = pick(docs, _id=id_column, text=text_column).select("_id", text_of().alias("text"))
    keyed = rows.select(*row_key(F.col("_id"), F.col("text")), "_id", "text")
    of_lines = line_digests(keyed.select("_k1", "_k2", "text"))
    found = of_lines.join(digests(notices), "digest").groupBy("_k1", "_k2").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = with_digest(keyed.select("_k1", "_k2", "_id", "text"), "text_digest")
    out = whole.join(digests(licenses).withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(found, ["_k1", "_k2"], "left")
    return out.select(F.col("_id").alias(id_column), "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
