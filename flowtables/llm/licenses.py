"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, each sentence is normalised and mapped to the identifiers of
the known licence sentences it holds, and the sequence of identifiers is matched against
ordered rules: a rule takes away the run of identifiers it names and leaves its licence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a sentence, and what separates words. Line breaks inside a sentence
#: are kept, so that a known sentence may start and end at a line.
BLANK_LINE = r"\n[ \t\r]*\n"
SENTENCE_END = (r"([.;][^A-Za-z0-9 \t\r\n]*[ \t\r\n]|:[^A-Za-z0-9 \t\r\n]*[ \t]*[\r\n])[ \t\r\n]*")
NOT_WORD = r"[^A-Za-z0-9\n]+"
AROUND_LINE = r" *\n[ \n]*"

#: Every known sentence holds one of these.
ANCHORS = ("licen", "permission", "warrant", "redistribut", "copyright", "liab", "public domain",
           "endorse", "rights reserved")

#: Known sentences, normalised, as regular expressions; a space is a space or a line break.
SENTENCES = [
    ("MitRef", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? (mit|x11|expat) licen[cs]e"),
    ("ApacheRef", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? apache licen[cs]e version 2 0"),
    ("ApacheHead", "licensed under the apache licen[cs]e version 2 0 the licen[cs]e"),
    ("ApacheUse", "you may not use this file except in compliance with the licen[cs]e"),
    ("ApacheCopy", "you may obtain a copy of the licen[cs]e at( http.*)?"),
    ("ApacheAsIs", "(http.* )?unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("Gpl2Ref", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? gnu general public licen[cs]e version 2( 0)?"),
    ("Gpl3Ref", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? gnu general public licen[cs]e version 3( 0)?"),
    ("Lgpl21Ref", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? gnu lesser general public licen[cs]e version 2 1"),
    ("Lgpl3Ref", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? gnu lesser general public licen[cs]e version 3( 0)?"),
    ("Agpl3Ref", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? gnu affero general public licen[cs]e version 3( 0)?"),
    ("Mpl2Ref", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? mozilla public licen[cs]e version 2 0"),
    ("BsdRef", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? (bsd 3 clause|new bsd|modified bsd) licen[cs]e"),
    ("Bsd2Ref", "(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? (bsd 2 clause|simplified bsd|freebsd) licen[cs]e"),
    ("CcByRef", "(this (project|software|work|code|file|program) is )?(released |licensed |distributed |available )under( the)? (cc|creative commons) (by|attribution)( international)? 4 0( international)?( licen[cs]e)?"),
    ("CcBySaRef", "(this (project|software|work|code|file|program) is )?(released |licensed |distributed |available )under( the)? (cc|creative commons) (by sa|attribution sharealike) 4 0( international)?( licen[cs]e)?"),
    ("CcByNcRef", "(this (project|software|work|code|file|program) is )?(released |licensed |distributed |available )under( the)? (cc|creative commons) (by nc|attribution noncommercial) 4 0( international)?( licen[cs]e)?"),
    ("CcByNcSaRef", "(this (project|software|work|code|file|program) is )?(released |licensed |distributed |available )under( the)? (cc|creative commons) (by nc sa|attribution noncommercial sharealike) 4 0( international)?( licen[cs]e)?"),
    ("CcByNdRef", "(this (project|software|work|code|file|program) is )?(released |licensed |distributed |available )under( the)? (cc|creative commons) (by nd|attribution noderivatives) 4 0( international)?( licen[cs]e)?"),
    ("PublicDomain", "(this (project|software|work|code|file|program) is )?(released into|placed in|dedicated to|in) the public domain"),
    ("SpdxMit", "spdx licen[cs]e identifier mit"),
    ("SpdxApache2", "spdx licen[cs]e identifier apache 2 0"),
    ("SpdxBsd3", "spdx licen[cs]e identifier bsd 3 clause"),
    ("SpdxBsd2", "spdx licen[cs]e identifier bsd 2 clause"),
    ("SpdxGpl2", "spdx licen[cs]e identifier gpl 2 0 only"),
    ("SpdxGpl2Later", "spdx licen[cs]e identifier gpl 2 0 or later"),
    ("SpdxGpl3", "spdx licen[cs]e identifier gpl 3 0 only"),
    ("SpdxGpl3Later", "spdx licen[cs]e identifier gpl 3 0 or later"),
    ("SpdxMpl2", "spdx licen[cs]e identifier mpl 2 0"),
    ("SpdxIsc", "spdx licen[cs]e identifier isc"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("MitLiability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted( provided that the above copyright notice and this permission notice appear in all copies)?"),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("IscLiability", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "(2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdEndorse", "(3 )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdAsIs", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BsdLiability", "in no event shall the copyright (holder|owner|holders) or contributors be liable for any direct indirect incidental special exemplary or consequential damages .*"),
    ("GplFree2Later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("GplRedistribute2Later", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("GplRedistribute3Later", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("GplNoWarranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplSee", "see the gnu general public licen[cs]e for more details"),
    ("GplReceived", "you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("MplSubject", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at .*licen[cs]e.*"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibLiability", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("UnlicenseFree", "this is free and unencumbered software released into the public domain"),
    ("AllRights", "(copyright .* )?all rights reserved( copyright .*)?"),
]

#: Rules in the order they are tried; longer ones stand before their parts.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("Apache-2.0", ["ApacheHead", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheHead", "ApacheUse", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiability"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("ISC", ["IscGrant", "IscAsIs", "IscLiability"]),
    ("Zlib", ["ZlibAsIs", "ZlibLiability", "ZlibGrant"]),
    ("GPL-2.0-or-later", ["GplRedistribute2Later", "GplNoWarranty", "GplSee", "GplReceived"]),
    ("GPL-3.0-or-later", ["GplRedistribute3Later", "GplNoWarranty", "GplSee", "GplReceived"]),
    ("MPL-2.0", ["MplSubject", "MplCopy"]),
    ("MIT", ["MitGrant"]), ("ISC", ["IscGrant"]), ("Apache-2.0", ["ApacheHead"]),
    ("GPL-2.0-or-later", ["GplFree2Later"]), ("GPL-2.0-or-later", ["GplRedistribute2Later"]),
    ("GPL-3.0-or-later", ["GplRedistribute3Later"]), ("MPL-2.0", ["MplSubject"]),
    ("Unlicense", ["UnlicenseFree"]), ("MIT", ["MitRef"]), ("MIT", ["SpdxMit"]),
    ("Apache-2.0", ["ApacheRef"]), ("Apache-2.0", ["SpdxApache2"]),
    ("GPL-2.0-only", ["Gpl2Ref"]), ("GPL-3.0-only", ["Gpl3Ref"]),
    ("GPL-2.0-only", ["SpdxGpl2"]), ("GPL-2.0-or-later", ["SpdxGpl2Later"]),
    ("GPL-3.0-only", ["SpdxGpl3"]), ("GPL-3.0-or-later", ["SpdxGpl3Later"]),
    ("LGPL-2.1-only", ["Lgpl21Ref"]), ("LGPL-3.0-only", ["Lgpl3Ref"]),
    ("AGPL-3.0-only", ["Agpl3Ref"]), ("MPL-2.0", ["Mpl2Ref"]), ("MPL-2.0", ["SpdxMpl2"]),
    ("ISC", ["SpdxIsc"]), ("BSD-3-Clause", ["BsdRef"]), ("BSD-3-Clause", ["SpdxBsd3"]),
    ("BSD-2-Clause", ["Bsd2Ref"]), ("BSD-2-Clause", ["SpdxBsd2"]),
    ("CC-BY-4.0", ["CcByRef"]), ("CC-BY-SA-4.0", ["CcBySaRef"]), ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSaRef"]), ("CC-BY-ND-4.0", ["CcByNdRef"]),
    ("Public-Domain", ["PublicDomain"]), ("All-Rights-Reserved", ["AllRights"]),
]

#: A sentence that is only the mark of a numbered or lettered item, and what looks like the end of a
#: sentence and is none: the abbreviation before a version, and a mark within the GNU notices.
ITEM_MARK = r"^[^A-Za-z0-9]*([0-9]{1,2}([.][0-9]{1,2})*|[A-Za-z]|[ivxIVX]{1,4})[^A-Za-z0-9]*$"
NO_END = [(r"\b([vV])[.]([ \t]+[0-9])", "$1$2"),
          (r"(?i)(foundation)[;:]([^A-Za-z0-9]+(?:either|version)\b)", "$1,$2")]

#: An SPDX tag; each licence of the expression after it, to the end of its line, gets a tag of its
#: own, on its own line.
SPDX_TAG = "SPDX-License-Identifier:"
SPDX_PARTS = [(r"(?i)(GPL-[0-9.]+)[+]", "$1-or-later"),
              (r"(?i)[ \t)]+(OR|AND)[ \t(]+", f"\n{SPDX_TAG} ")]

#: The GNU licences as (name, words, identifier, versions with the dates of their texts).
GNU = [
    ("Gpl", "gnu general public", "GPL", [("1", "february 1989"), ("2", "june 1991"), ("3", "29 june 2007")]),
    ("Lgpl", "gnu (lesser|library) general public", "LGPL",
     [("2", "june 1991"), ("2.1", "february 1999"), ("3", "29 june 2007")]),
    ("Agpl", "gnu affero general public", "AGPL", [("3", "19 november 2007")]),
]
GNU_WORK = "(program|library|software|file|project|package|work|code)"
SPDX_IDS = ["0BSD", "Artistic-2.0", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0",
            "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0",
            "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "MIT-0", "MPL-1.1", "MS-PL", "OFL-1.1",
            "PSF-2.0", "Python-2.0", "Unlicense", "WTFPL", "Zlib"]


def added() -> tuple[list[tuple[str, str]], list[tuple[str, list[str]]]]:
    """Sentences and rules beyond ``SENTENCES`` and ``RULES``, made from their parts; a sentence of
    the same name takes the other's place, and these rules are tried first."""
    free = "([a-z0-9]+[ ]){0,7}[a-z0-9]+ is free software "  # the name of the work is on one line
    terms = "you can redistribute it and or modify it under the terms of the {} licen[cs]e "
    issued = "as published by the free software foundation"
    sentences = [
        ("GnuHope", f"this {GNU_WORK} is distributed in the hope that it will be useful but without any warranty"),
        ("GnuMerchant", "without even the implied warranty of merchantability or fitness for a particular purpose"),
        ("BsdSource", "([0-9a-z] )?redistributions? of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("BsdBinary", "([0-9a-z] )?redistributions? in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
        ("BsdEndorse", "([0-9a-z] )?(neither the names? of .* nor the names of (its|their|other) contributors may|the names? of .* may not) be used to endorse or promote products derived from this software without specific prior written permission"),
        ("BsdAsIs", "this software is provided by ([a-z0-9]+ ){1,12}as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
        ("BsdLiability", "in no event shall ([a-z0-9]+ ){1,12}be liable for any direct indirect incidental special exemplary or consequential damages .*"),
        ("ApacheTitle", "apache licen[cs]e version 2 0 january 2004( http www apache org licen[cs]es)?"),
        ("MplTitle", "mozilla public licen[cs]e version 2 0"),
    ]
    rules: list[tuple[str, list[str]]] = []
    single = [("Apache-2.0", ["ApacheTitle"]), ("MPL-2.0", ["MplTitle"])]
    known = {name for name, _ in SENTENCES}
    spdx = {words for name, words in SENTENCES if name.startswith("Spdx")}

    def tag(identifier: str, licence: str) -> None:
        words = "spdx licen[cs]e identifier " + identifier.lower().replace("-", " ").replace(".", " ")
        name = "Spdx" + "".join(c for c in identifier if c.isalnum())
        if words in spdx:  # the same with an exception
            name, = (n for n, w in SENTENCES if w == words)
        else:
            single.append((licence, [name]))
        sentences.append((name, words + "( with [a-z0-9 ]*)?"))

    for name, words, licence, versions in GNU:
        sentences += [(f"{name}See", f"see the {words} licen[cs]e for more details"),
                      (f"{name}Received", f"you should have received a copy of the {words} licen[cs]e along with this {GNU_WORK}")]
        for version, date in versions:
            spoken, short = version.replace(".", " "), version.replace(".", "")
            full = version if "." in version else version + ".0"
            number = spoken if "." in version else f"{spoken}( 0)?"
            later = f"either version {number}( of the licen[cs]e)? or at your option any later version"
            only = f"(version {number} {issued}|{issued} version {number} of the licen[cs]e)"
            own = terms.format(words)
            heads = {f"{name}Free{short}Later": (free + own + f"{issued} {later}", "or-later"),
                     f"{name}Redistribute{short}Later": (own + f"{issued} {later}", "or-later"),
                     f"{name}Terms{short}": (f"({free})?" + own + only, "only")}
            for head, (pattern, suffix) in heads.items():
                sentences.append((head, pattern))
                tail = ["GnuHope", "GnuMerchant", f"{name}See", f"{name}Received"]
                rules += [(f"{licence}-{full}-{suffix}", [head, *tail[:n]]) for n in (4, 3, 2)]
                single.append((f"{licence}-{full}-{suffix}", [head]))
            sentences.append((f"{name}Title{short}", f"{words} licen[cs]e version {spoken} {date}"))
            single.append((f"{licence}-{full}-only", [f"{name}Title{short}"]))
            reference = f"{name}{short}Ref"
            if reference not in known:
                sentences.append((reference, f"(this (project|software|work|code|file|program) is )?(released|licensed|distributed|available) under the( terms of the)? {words} licen[cs]e version {number}"))
                single.append((f"{licence}-{full}-only", [reference]))
            for suffix in ("only", "or-later"):
                tag(f"{licence}-{full}-{suffix}", f"{licence}-{full}-{suffix}")
            tag(f"{licence}-{full}", f"{licence}-{full}-only")
    for identifier in ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "ISC", *SPDX_IDS]:
        tag(identifier, identifier)
    return sentences, rules + single


ADDED_SENTENCES, ADDED_RULES = added()


def length(words: str) -> tuple[bool, int]:
    """Sorts longer sentences, counted without their optional parts, before what they may hold, and
    sentences of any length last."""
    least = re.sub(r"\((?:[^()]|\([^()]*\))*\)\?", "", words)
    while "(" in least:
        least = re.sub(r"\(([^()]*)\)", lambda group: max(group[1].split("|"), key=len), least)
    return ".*" in words, -len(least)


#: What the scan goes by; a sentence that may hold another is looked for first.
KNOWN = sorted({**dict(SENTENCES), **dict(ADDED_SENTENCES)}.items(), key=lambda known: length(known[1]))
ORDERED = ADDED_RULES + RULES

#: A sentence of unknown text in the sequence of identifiers; it interrupts a rule.
OTHER = "-"


def spaced(sentence: str) -> str:
    """The expression for a known sentence with its words on one line or several."""
    words = sentence.replace(".*", "[a-z0-9 \n]*").replace(" ?", "[ \n]?")
    out, inside = "", False
    for char in words:
        inside = char == "[" or (inside and char != "]")
        out += "[ \n]" if char == " " and not inside else char
    return out


def named_lines(sentence: str) -> str:
    """The expression for a known sentence that starts and ends with a sentence or a line."""
    return f"(?m)^(?:{spaced(sentence)})$"


def needed_word(sentence: str) -> str:
    """The longest word that every form of a known sentence holds; '' if it has none."""
    outside = sentence
    while "(" in outside:
        outside = re.sub(r"\([^()]*\)\??(\{[^}]*\})?", " ", outside)
    return max((word for word in outside.split() if word.isalnum()), key=len, default="")


def anchored(value: Column) -> Column:
    found = value.contains(ANCHORS[0])
    for anchor in ANCHORS[1:]:
        found = found | value.contains(anchor)
    return found


def identifiers(text: Column) -> Column:
    """The sequence as one string such as ``<MitGrant><MitNotice><->``; '' for null."""
    def expression(part: Column) -> Column:
        line = F.substring_index(part, "\n", 1)
        parted = line
        for found, put in SPDX_PARTS:
            parted = F.regexp_replace(parted, found, put)
        return F.concat(parted, F.substr(part, F.length(line) + 1))

    parts = F.split(text, f"(?i){SPDX_TAG}")
    tagged = F.array_join(F.transform(
        parts, lambda part, at: F.when(at == 0, part).otherwise(expression(part))), SPDX_TAG)
    whole = F.when(F.lower(text).contains(SPDX_TAG.lower()), tagged).otherwise(text)
    for found, put in NO_END:
        whole = F.regexp_replace(whole, found, put)
    cut = F.regexp_replace(F.concat(whole, F.lit(" ")), BLANK_LINE, "\x01")
    sentences = F.split(F.regexp_replace(cut, SENTENCE_END, "\x01"), "\x01")

    def normalise(sentence: Column) -> Column:
        words = F.lower(F.trim(F.regexp_replace(sentence, NOT_WORD, " ")))
        lines = F.regexp_replace(words, AROUND_LINE, "\n")
        return F.trim(F.regexp_replace(lines, "^\n|\n$", ""))

    def identify(sentence: Column) -> Column:
        # Each known sentence gives way to its name where it stands, other lines to OTHER.
        for name, words in KNOWN:
            if ".*" in words:
                # Looked for only where its longest word is: open lines without it take no time.
                sentence = F.transform(F.array(sentence), lambda s: F.when(
                    s.contains(needed_word(words)),
                    F.regexp_replace(s, named_lines(words), f"<{name}>")).otherwise(s))[0]
            else:
                sentence = F.regexp_replace(sentence, named_lines(words), f"<{name}>")
        return F.replace(F.regexp_replace(sentence, "(?m)^[a-z0-9 ]+$", f"<{OTHER}>"), F.lit("\n"), F.lit(""))

    # Texts and sentences without an anchor need no closer look.
    plain = F.transform(sentences, lambda s: F.when(anchored(F.lower(s)), normalise(s))
                        .otherwise(F.when(s.rlike("[A-Za-z0-9]") & ~s.rlike(ITEM_MARK), F.lit(OTHER))
                                   .otherwise("")))
    named = F.transform(plain, lambda s: F.when(s == OTHER, F.lit(f"<{OTHER}>"))
                        .otherwise(F.when(s == "", F.lit("")).otherwise(identify(s))))
    sequence = F.regexp_replace(F.array_join(named, ""), f"(<{OTHER}>)+", f"<{OTHER}>")
    return F.when(anchored(F.lower(text)), sequence).otherwise(F.lit(""))


def recognised(sequence: Column) -> Column:
    """The sequence with each run that a rule names replaced by its licence in brackets."""
    for licence, names in ORDERED:
        run = "".join(f"<{name}>" for name in names)
        sequence = F.replace(sequence, F.lit(run), F.lit(f"[{licence}]"))
    return sequence


def scan(documents: DataFrame, text: str = "text", sentences: str = "sentences",
         licenses: str = "licenses", unmatched: str = "unmatched") -> DataFrame:
    """``documents`` with three arrays, each in the order of the text: the identifiers of the
    known sentences, the licences that rules recognise, and known sentences that no rule took.

    A known sentence starts and ends at a line or a sentence, in any case and with any
    punctuation between its words; it may run over several lines, not over a blank one. A
    rule's sentences must follow one another; the number or letter of an item is no sentence. An
    SPDX tag gives each licence of its expression, however long, that is in the table, without
    exceptions. Null and empty texts give empty arrays; repeated
    rows and null ids pass through; a column named as a result is replaced. All work is per
    row, without a shuffle; texts without an anchor word are only searched for one.
    """
    marked = documents.withColumn("_sequence", F.coalesce(identifiers(F.col(text)), F.lit("")))
    marked = marked.withColumn("_matched", recognised(F.col("_sequence")))
    name, licence = F.lit(r"<([A-Za-z0-9]+)>"), F.lit(r"\[([^\]]+)\]")
    return marked.withColumns({
        sentences: F.regexp_extract_all("_sequence", name, F.lit(1)),
        licenses: F.regexp_extract_all("_matched", licence, F.lit(1)),
        unmatched: F.regexp_extract_all("_matched", name, F.lit(1)),
    }).drop("_sequence", "_matched")


def scan_sql(table: str) -> str:
    """The same scan as DuckDB SQL, with the arrays joined by commas."""
    def quoted(value: str) -> str:
        value = value.replace("'", "''")
        for char, code in (("\x01", 1), ("\n", 10), ("\r", 13), ("\t", 9)):
            value = value.replace(char, f"' || chr({code}) || '")
        return f"('{value}')"

    def sql_anchored(value: str) -> str:
        return "(" + " OR ".join(f"contains({value}, '{a}')" for a in ANCHORS) + ")"

    def replaced(value: str, found: str, put: str) -> str:
        put = put.replace("$", "\\")
        return f"regexp_replace({value}, {quoted(found)}, {quoted(put)}, 'g')"

    line = "split_part(x, chr(10), 1)"
    parted = line
    for found, put in SPDX_PARTS:
        parted = replaced(parted, found, put)
    whole = "t"
    for found, put in NO_END:
        whole = replaced(whole, found, put)
    names = "s"
    for name, words in KNOWN:
        names = replaced(names, named_lines(words), f"<{name}>")
    names = f"replace({replaced(names, '(?m)^[a-z0-9 ]+$', f'<{OTHER}>')}, chr(10), '')"
    matched = "sequence"
    for licence, rule in ORDERED:
        matched = f"replace({matched}, '{''.join(f'<{n}>' for n in rule)}', '[{licence}]')"
    return f"""
WITH parts AS (
  SELECT doc_id, string_split_regex(text, {quoted("(?i)" + SPDX_TAG)}) AS p
  FROM {table} WHERE {sql_anchored('lower(text)')}),
tagged AS (
  SELECT doc_id, array_to_string(list_concat(p[1:1], list_transform(p[2:],
           lambda x: {parted} || substr(x, length({line}) + 1))), '{SPDX_TAG}') AS t FROM parts),
ended AS (SELECT doc_id, {whole} || ' ' AS t FROM tagged),
sentences AS (
  SELECT doc_id, string_split({replaced(replaced("t", BLANK_LINE, chr(1)), SENTENCE_END, chr(1))}, chr(1)) AS ss
  FROM ended),
cut AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS nr FROM sentences),
plain AS (
  SELECT doc_id, nr, CASE WHEN {sql_anchored('lower(s)')}
      THEN trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(s, {quoted(NOT_WORD)}, ' ', 'g'))),
             {quoted(AROUND_LINE)}, chr(10), 'g'), {quoted("^" + chr(10) + "|" + chr(10) + "$")}, '', 'g'))
      WHEN regexp_matches(s, '[A-Za-z0-9]') AND NOT regexp_matches(s, {quoted(ITEM_MARK)}) THEN '{OTHER}'
      ELSE '' END AS s FROM cut),
named AS (
  SELECT doc_id, nr, CASE WHEN s = '{OTHER}' THEN '<{OTHER}>' WHEN s = '' THEN '' ELSE {names} END AS name
  FROM plain),
sequences AS (
  SELECT doc_id, regexp_replace(string_agg(name, '' ORDER BY nr), '(<->)+', '<->', 'g') AS sequence
  FROM named GROUP BY doc_id),
matched AS (SELECT doc_id, sequence, {matched} AS matched FROM sequences)
SELECT d.doc_id,
  coalesce(array_to_string(regexp_extract_all(sequence, '<([A-Za-z0-9]+)>', 1), ','), '') AS sentences,
  coalesce(array_to_string(regexp_extract_all(matched, '\\[([^\\]]+)\\]', 1), ','), '') AS licenses,
  coalesce(len(regexp_extract_all(matched, '<([A-Za-z0-9]+)>', 1)), 0)::BIGINT AS n_unmatched
FROM {table} d LEFT JOIN matched m USING (doc_id)
"""
