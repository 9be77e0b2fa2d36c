"""Licence scans by canonical digest: texts are brought to one spelling, then hash-joined to known licence digests."""

from __future__ import annotations

import re
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm.common import Tables

# Public licence texts and notices, as (id, text). Canonical forms ignore case, punctuation and line breaks.
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_TEXTS = Path(__file__).parent / "license_texts"  # canonical texts, one file per licence; read by the driver only


def _whole_texts() -> list[tuple[str, str]]:
    """The texts of the folder: whole, without what follows their terms (how to apply them), and with or without a title."""
    out = []
    for path in sorted(_TEXTS.iterdir()):
        text = path.read_text(encoding="utf-8")
        out.append((path.name, text))
        if end := re.search(r"(?m)^.*END OF TERMS AND CONDITIONS.*$|^ADDENDUM: How to use", text):
            out += [(path.name, text[:end.start()]), (path.name, text[:end.end()])]
    mit_titles = ("The MIT License", "The MIT License (MIT)", "MIT License")
    titles = {"MIT": (mit_titles, _MIT_BODY), "ISC": (("ISC License", "The ISC License", "ISC License (ISC)"), _ISC_BODY)}
    out += [(name, f"{title}\n{body}") for name, (known, body) in titles.items() for title in known]
    bsd = (_TEXTS / "BSD-3-Clause").read_text(encoding="utf-8")
    # Lists are numbered or not; holders are named as one, several, authors or the Regents.
    for (many, one), number in product((("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"),
                                        ("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"), ("REGENTS", "REGENTS"),
                                        ("AUTHORS", "AUTHORS"), ("AUTHOR", "AUTHOR")), (True, False)):
        text = bsd.replace("COPYRIGHT HOLDERS", many).replace("COPYRIGHT HOLDER OR", f"{one} OR")
        text = text if number else re.sub(r"(?m)^[123]\. ", "* ", text)
        two = re.sub(r"(?m)^(3\.|\*) Neither[^.]*\.\n\n", "", text)
        bodies = [("BSD-2-Clause", two)] + [("BSD-3-Clause", text.replace("the copyright holder nor", f"{owner} nor")) for owner in (
            "the copyright holder", "the copyright holders", "the University", "the author", "the authors", "the project")]
        bsd_titles = {"BSD-2-Clause": ("", "BSD 2-Clause License\n", "The 2-Clause BSD License\n"),
                      "BSD-3-Clause": ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n")}
        out += [(name, title + body) for name, body in bodies for title in bsd_titles[name]]
    return out


def _names() -> dict[str, list[str]]:
    """Names by which notices call the licences, every version of a family alike."""
    out = {"MIT": ["MIT License", "Expat License"], "ISC": ["ISC License"], "Zlib": ["zlib License"],
           "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"], "Unlicense": ["Unlicense"],
           "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
           "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License",
                            "Revised BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
           "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0 License"]}
    families = {"GPL": ("1.0 2.0 3.0", "GNU General Public License", "GPL"), "AGPL": ("3.0", "GNU Affero General Public License", "AGPL"),
                "LGPL": ("2.0 2.1 3.0", "GNU Lesser General Public License", "LGPL"),
                "GFDL": ("1.1 1.2 1.3", "GNU Free Documentation License", "GFDL"),
                "MPL": ("1.0 1.1 2.0", "Mozilla Public License", "MPL"), "Apache": ("1.0 1.1 2.0", "Apache License", "Apache"),
                "EPL": ("1.0 2.0", "Eclipse Public License", "EPL"), "BSL": ("1.0", "Boost Software License", "BSL"),
                "Artistic": ("1.0 2.0", "Artistic License", "Artistic")}
    for family, (versions, long, short) in families.items():
        for version in versions.split():
            spelled = {version, version.removesuffix(".0")} if "GNU" in long else {version}
            names = [f"{long}{sign}{v}" for v in sorted(spelled) for sign in (", version ", " ", " v")]
            names += [f"{short}{sign}{v}" for v in sorted(spelled) for sign in (" ", " v", "v")]
            if "GNU" in long:
                names += [f"GNU {short} v{v}" for v in sorted(spelled)]
            if family == "LGPL" and version == "2.0":
                names += [n.replace("Lesser", "Library") for n in names if "Lesser" in n]
            out[f"{family}-{version}"] = names
            if "GNU" in long:
                out[f"{family}-{version}-or-later"] = [f"{n}{more}" for n in names if " version " in n or n.startswith(short)
                                                       for more in (" or later", " or (at your option) any later version")]
    parts = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    ports = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}
    for kind, version in product(("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ports):
        long = "Creative Commons " + "-".join(parts[p] for p in kind.split("-"))
        longs = {long, long.replace("NoDerivatives", "NoDerivs")}
        out[f"CC-{kind}-{version}"] = [f"CC {kind} {version}"] + [
            f"{n} {version}{port}" for n in sorted(longs) for port in ("", f" {ports[version]}")]
    return out


def _notices() -> list[tuple[str, str]]:
    """The usual one-line notices of every name: what is licensed, how, and under which licence."""
    subjects = ["", *(f"This {x} is " for x in "work software project program".split())]
    heads = [f"{subject}{verb} under {the}" for subject in subjects for verb in ("licensed", "released", "distributed")
             for the in ("", "the ", "the terms of the ")]
    # A trailing "License" may be missing or added, an article is as above.
    out = []
    for license_id, names in _names().items():
        out.append((license_id, f"SPDX-License-Identifier: {license_id}"))
        for name in dict.fromkeys(names):
            ends = ("",) if "License" in name or "later" in name else ("", " License")
            out += [(license_id, f"{head}{name}{end}") for head in heads for end in ends]
    return out


_NOTICES = (
    ("Apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
# Parameter: the known set. What is not in it is not found; the README lists it.
KNOWN_LICENSES = (
    ("MIT", "MIT License\nCopyright (c) <year> <holders>\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("ISC", "ISC License\nCopyright (c) <year> <holder>\n" + _ISC_BODY),
    ("ISC", _ISC_BODY),
    ("0BSD", _ISC_BODY.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
     "for any damages arising from the use of this software.\n"
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
     "it and redistribute it freely, subject to the following restrictions:\n"
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If "
     "you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
     "required.\n"
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
     "software.\n"
     "3. This notice may not be removed or altered from any source distribution."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    *_NOTICES,
    *_whole_texts(),
    *_notices(),
)

# Spellings that count as equal, as (pattern, kept form), on lower-case words with one space between.
EQUIVALENT = (
    (" sub (licen[cs]e)", " sub$1"),
    (" (sub)?licence(d|s|e|) ", " $1license$2 "),
    (" (sub)?licencing ", " $1licensing "),
    (" copyright owner ", " copyright holder "),
    # Of two words that a line break parts, the first goes to the second's line.
    (r" sub \n (licen[cs]e[a-z]*) ", " \n sub$1 "),
    (r" copyright \n owner ", " \n copyright holder "),
    (r" non \n (infringement|commercial|exclusive) ", " \n non$1 "),
    (" acknowledgement(s|) ", " acknowledgment$1 "),
    (" (unauthori|organi|reali|recogni|utili|initiali)s(e|ed|es|ing|ation|ations) ", " $1z$2 "),
    (" non (infringement|commercial|exclusive) ", " non$1 "),
    (" favour(s|) ", " favor$1 "),
    (" behaviour(s|) ", " behavior$1 "),
    (" judgement(s|) ", " judgment$1 "),
    (" fulfil ", " fulfill "),
    (" while ", " whilst "),
)
# A notice is a mark and another mark, a year, a placeholder or a holder, on a line of its own: prose may begin with
# "copyright", too, and so may a blank to be filled in within a sentence. Names have no capitals here, so a holder is known
# by "the ... authors", its legal form or rights reserved; a bare name is taken for prose.
COPYRIGHT_LINE = (
    r"(?m)^[ \t]*(©[^\n]*|(copyright[ \t]*|\(c\)[ \t]*)(\(c\)|©)[ \t:,]*([^_ \t\n][^\n]*)?|"
    r"((copyright|\(c\))[ \t:,]*)+((19|20)[0-9][0-9]|19yy|20yy|yyyy|[<\[{]+[^>\]}\n]*(year|yy|date|name|holder|owner|author|"
    r"compan|organi)[^>\]}\n]*[>\]}])[^\n]*|"
    r"(copyright|\(c\))[ \t]+(by[ \t]+)?the [^\n]{1,80} (authors|contributors|developers|team|project)[ \t\r.,]*|"
    r"(copyright|\(c\))[ \t]+[^(_ \t\n][^\n]{0,79}( inc| llc| ltd| gmbh| corp|all rights reserved)[ \t\r.,;!]*|"
    r"all rights reserved[ \t\r.,;!]*)$")
PUNCTUATION = r"[!-/:-@\[-`{-~‘’“”–—…•©]+"


def with_canonical_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by ``lines``: its lines in canonical form, empty ones included.

    Lower case; lines that are a copyright notice are emptied; punctuation is a space; spaces and tabs are one space;
    equivalent spellings have one form. Only texts with such a spelling pay for the replacements. The steps are columns
    of their own, so that each is computed once.
    """
    lines = F.regexp_replace(F.lower("text"), COPYRIGHT_LINE, "")
    lines = F.regexp_replace(F.regexp_replace(lines, PUNCTUATION, " "), r"[ \t\r\f\x0B]+", " ")
    rows = rows.withColumn("lines", F.regexp_replace(F.concat(F.lit(" "), lines, F.lit(" ")), r" ?\n ?", " \n "))
    same = F.col("lines")
    for pattern, form in EQUIVALENT:
        same = F.regexp_replace(same, pattern, form)
    variant = F.col("lines").rlike("|".join(pattern for pattern, _ in EQUIVALENT))
    return rows.withColumn("lines", F.when(variant, same).otherwise(F.col("lines"))).drop("text")


def canonical_text(lines: str) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, texts=KNOWN_LICENSES) -> DataFrame:
    """``digest, license_id`` of the known texts: as many rows as texts are given, so a broadcast of it is bounded."""
    rows = spark.createDataFrame(list(texts), "license_id string, text string")
    return (with_canonical_lines(rows).select(F.sha2(canonical_text("lines"), 256).alias("digest"), "license_id")
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, text_digest, license_id, line_licenses, n_lines`` for every row of ``docs(doc_id, text)``.

    ``license_id`` is the licence whose entire text the document is; ``line_licenses`` are those of which a single line
    is the entire known text or notice (sorted, distinct), and ``n_lines`` how many lines are such. Nothing is matched in part.

    Nulls: a null text is empty and matches nothing, as does a text without words. Rows that repeat a ``doc_id``, or have
    none, are answered each by their own text. No rows give no rows.
    """
    rows = with_canonical_lines(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("whole", canonical_text("lines"))
    # Texts are brought to their form once; what follows reads the digests.
    rows = Tables(docs.sparkSession).put("digests", rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("whole", 256).alias("text_digest"), (F.col("whole") != "").alias("full"),
        F.transform(F.split("lines", "\n"), lambda line: F.unhex(F.sha2(F.trim(line), 256))).alias("lines")))
    known = F.broadcast(known)  # as many rows as known texts
    whole = (rows.join(known, F.col("full") & (F.col("text_digest") == F.col("digest")), "left")
             .select("row", "doc_id", "text_digest", "license_id"))
    lines = rows.where("full").select("row", F.explode("lines").alias("line"))
    found = (lines.join(known, F.col("line") == F.unhex("digest"))
             .groupBy("row", "license_id").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("row").agg(F.sort_array(F.collect_list("license_id")).alias("line_licenses"),
                                    F.sum("n").alias("n_lines")))  # at most one entry per known licence
    return (whole.join(found, "row", "left")
            .select("doc_id", "text_digest", "license_id",
                    F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"),
                    F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines")))
