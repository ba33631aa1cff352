"""License scans by sentence rules: sentences become identifiers, and ordered rules match sequences of identifiers.

A text is cut into fragments at line ends and after ``.``, ``!``, ``?``, ``;`` or ``:`` before white space; comment marks and bullets around each
line are off. Fragments are cut further where a known sentence's first words, or a pointer to the licence's
file, stand inside a line. A sentence is the longest run of fragments of one paragraph that is known when joined and normalised (lower case, quotes, dashes and
white space made alike, end marks off), so it is found on one line, wrapped at any column, and inside comments. Blank lines and list items end a
paragraph. Known are fixed sentences, a few patterns where names, years and versions vary (at most ``LONGEST`` characters once normalised), and references by
name (``named``). An SPDX expression gives one tag for each of its licences. The identifiers of a document, in order, are matched
against the rules in their order: a rule is a sequence of identifiers, with at most ``gap`` unknown sentences between two of them (unknown lines up to
a sentence or paragraph end are one); the first rule that fits at a sentence wins, and its sentences are used up. Reserved rights are ``proprietary``
only where no licence stands within ``gap`` unknown sentences before or behind them. Words hyphenated at a line end are not joined.

Null and empty texts have no sentences. Each row is handled on its own, so repeated rows, null ids and empty tables need no rule. Other columns are not
read. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import map_batches

# Sentences of public licences, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit.ref",
    "licensed under the mit license": "mit.ref",
    "this project is licensed under the mit license": "mit.ref",
    "the mit license (mit)": "mit.title",
    "mit license": "mit.title",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'software'), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "licensed under the apache license, version 2.0": "apache2.ref",
    "licensed under the apache license, version 2.0 (the 'license')": "apache2.ref",
    "you may not use this file except in compliance with the license": "apache2.comply",
    "you may obtain a copy of the license at": "apache2.copy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an 'as is' basis, without warranties or conditions of any kind, either express or implied": "apache2.warranty",
    "this work is licensed under the gnu general public license, version 3": "gpl3.ref",
    "licensed under the gnu general public license, version 3": "gpl3.ref",
    "this program is distributed in the hope that it will be useful, but without any warranty": "gpl.warranty",
    "licensed under cc by-nc 4.0": "ccbync4.ref",
    "licensed under cc by 4.0": "ccby4.ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4.ref",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "ccbync4.ref",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd.grant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd.binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsd.advertising",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd.names",
    "bsd 2-clause license": "bsd2.title",
    "licensed under the bsd 2-clause license": "bsd2.title",
    "bsd 3-clause license": "bsd3.title",
    "licensed under the bsd 3-clause license": "bsd3.title",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'software'), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so": "mit0.grant",
    "apache license version 2.0, january 2004": "apache2.title",
    "gnu general public license version 2, june 1991": "gpl2.title",
    "gnu general public license version 3, 29 june 2007": "gpl3.title",
    "gnu lesser general public license version 2.1, february 1999": "lgpl21.title",
    "gnu lesser general public license version 3, 29 june 2007": "lgpl3.title",
    "gnu affero general public license version 3, 19 november 2007": "agpl3.title",
    "isc license": "isc.title",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0bsd.grant",
    "mozilla public license version 2.0": "mpl2.title",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "mpl2.ref",
    "this is free and unencumbered software released into the public domain": "unlicense.grant",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib.grant",
    "boost software license - version 1.0 - august 17th, 2003": "bsl1.title",
    "distributed under the boost software license, version 1.0": "bsl1.ref",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the 'software') to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following:": "bsl1.grant",
    "licensed under cc0 1.0": "cc0.ref",
    "to the extent possible under law, the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0.grant",
    "licensed under cc by-sa 4.0": "ccbysa4.ref",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "ccbysa4.ref",
    "all rights reserved": "rights.reserved",
    "the software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "mit.warranty",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "mit.liability",
    "the software is provided 'as is' and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc.warranty",
    "in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software": "isc.liability",
    "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed": "fsf.verbatim",
    "the gnu general public license is a free, copyleft license for software and other kinds of works": "gpl3.preamble",
    "the gnu affero general public license is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software": "agpl3.preamble",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl2.preamble",
    "this license, the lesser general public license, applies to some specially designated software packages--typically libraries--of the free software foundation and other authors who decide to use it": "lgpl21.preamble",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions listed below": "lgpl3.preamble",
    "terms and conditions for use, reproduction, and distribution": "apache2.terms",
    "the accompanying program is provided under the terms of this eclipse public license ('agreement')": "epl2.text",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "unlicense.anyone",
}
#: Sentences with names, years or versions in them: what their first fragment holds, the whole, and the identifier.
PATTERNS = (
    (re.compile(r"spdx-license-identifier:"), re.compile(r"spdx-license-identifier: ?(\(*[a-z0-9.+:-]+(?:\)* (?:and|or|with) \(*[a-z0-9.+:-]+)*\)*)"), "spdx"),
    (re.compile(r"(?:portions )?copyright "), re.compile(r"(?:portions )?copyright .*"), "copyright"),
    (re.compile(r"neither the name"), re.compile(r"neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission"), "bsd.names"),
    (re.compile(r"you may obtain a copy of the license at "), re.compile(r"you may obtain a copy of the license at \S+"), "apache2.copy"),
    (re.compile(r"this program and the accompanying"), re.compile(r"this program and the accompanying materials are made available under the terms of the eclipse public license(?:,? v(?:ersion|\.)?)? ?2\.0(?: which .*)?"), "epl2.ref"),
    (re.compile(r".{0,80}\bis free software\b"),
     re.compile(r".{0,80}\bis free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?P<family>|lesser |library |affero )general public license"
                r"(?:,? as published by the free software foundation[,;:] (?:either )?version (?P<later>\d(?:\.\d)?)(?: of the license)?,? or,? \(?at your option\)?,? any later version"
                r"|,? as published by the free software foundation[,;:] version (?P<of>\d(?:\.\d)?)(?: of the license)?(?: only)?"
                r"|,? version (?P<only>\d(?:\.\d)?),? as published by the free software foundation)"), "grant"),
)
#: How a sentence begins that refers to a licence by one of its names, and what may stand before the name.
REFERENCE = (re.compile(r"(?:(?:this|the|our|all) (?:[\w-]+ ){1,3}(?:is|are) )?(?:dual[- ])?(?:released|licensed|distributed|published|(?:made )?available) under "),
             re.compile(r"(?:(?:the )?terms (?:and conditions )?of )?(?:the |an? )?"))
GNU = re.compile(r"(?:gnu )?(?P<family>(?:lesser |library |affero )?general public licen[sc]e|[al]?gpl)(?: licen[sc]e)?[ ,(-]*(?:version |v\.? ?)(?P<of>[1-3](?:\.[01])?)\)?"
                 r"(?P<later>\+|-or-later|,? (?:or|and) (?:\(at your option\) )?(?:any )?(?:later|newer|above)(?: versions?)?)?(?:-only| only)?(?: licen[sc]e)?")
CC = re.compile(r"(?:creative commons|cc)[ -](?:attribution|by)(?P<with>(?:[ -](?:noncommercial|non-commercial|nc|sharealike|share-alike|sa|noderivatives|noderivs|nd))*)[ -]v?(?P<of>[1-4]\.0)"
                r"(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?(?: \(cc.*\))?")
CC_PARTS = {"noncommercial": "NC", "non-commercial": "NC", "nc": "NC", "sharealike": "SA", "share-alike": "SA", "sa": "SA",
            "noderivatives": "ND", "noderivs": "ND", "nd": "ND"}
#: Names of licences without versions or parts in words, and what stands for them in a result.
NAMED = {
    "mit": "MIT", "expat": "MIT", "mit-0": "MIT-0", "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense", "wtfpl": "WTFPL", "0bsd": "0BSD",
    "apache 2.0": "Apache-2.0", "apache 2": "Apache-2.0", "apache-2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache license, version 2.0": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0", "apache license v2.0": "Apache-2.0", "apache license v2": "Apache-2.0", "apache software license 2.0": "Apache-2.0",
    "bsd 2-clause": "BSD-2-Clause", "bsd-2-clause": "BSD-2-Clause", "2-clause bsd": "BSD-2-Clause", "simplified bsd": "BSD-2-Clause",
    "bsd 3-clause": "BSD-3-Clause", "bsd-3-clause": "BSD-3-Clause", "3-clause bsd": "BSD-3-Clause", "new bsd": "BSD-3-Clause", "modified bsd": "BSD-3-Clause",
    "mpl 2.0": "MPL-2.0", "mpl-2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0", "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license, v. 2.0": "MPL-2.0", "mozilla public license version 2.0": "MPL-2.0",
    "epl 2.0": "EPL-2.0", "epl-2.0": "EPL-2.0", "eclipse public license 2.0": "EPL-2.0", "eclipse public license v2.0": "EPL-2.0",
    "eclipse public license, version 2.0": "EPL-2.0", "bsl-1.0": "BSL-1.0", "boost software license 1.0": "BSL-1.0", "boost software license, version 1.0": "BSL-1.0",
    "cc0": "CC0-1.0", "cc0 1.0": "CC0-1.0", "cc0-1.0": "CC0-1.0", "cc0 1.0 universal": "CC0-1.0",
}
FAMILIES = {"": "GPL", "lesser ": "LGPL", "library ": "LGPL", "affero ": "AGPL"}
#: Rules in order: name, kind, and the sentences that make it up.
RULES = (
    ("MIT", "text", ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("MIT-0", "text", ("mit0.grant", "mit.warranty", "mit.liability")),
    ("ISC", "text", ("isc.grant", "isc.warranty", "isc.liability")),
    ("0BSD", "text", ("0bsd.grant", "isc.warranty", "isc.liability")),
    ("Unlicense", "text", ("unlicense.grant", "unlicense.anyone")),
    ("GPL-3.0", "text", ("gpl3.title", "copyright", "fsf.verbatim", "gpl3.preamble")),
    ("AGPL-3.0", "text", ("agpl3.title", "copyright", "fsf.verbatim", "agpl3.preamble")),
    ("LGPL-3.0", "text", ("lgpl3.title", "copyright", "fsf.verbatim", "lgpl3.preamble")),
    ("LGPL-2.1", "text", ("lgpl21.title", "copyright", "fsf.verbatim", "gpl2.preamble", "lgpl21.preamble")),
    ("LGPL-2.1", "text", ("gpl2.preamble", "lgpl21.preamble")),
    ("GPL-2.0", "text", ("gpl2.title", "copyright", "fsf.verbatim", "gpl2.preamble")),
    ("Apache-2.0", "text", ("apache2.title", "apache2.terms")),
    ("GPL-3.0", "text", ("gpl3.preamble",)),
    ("AGPL-3.0", "text", ("agpl3.preamble",)),
    ("LGPL-3.0", "text", ("lgpl3.preamble",)),
    ("EPL-2.0", "text", ("epl2.text",)),
    ("MIT", "text", ("mit.grant", "mit.notice")),
    ("Apache-2.0", "notice", ("apache2.ref", "apache2.comply", "apache2.copy", "apache2.warranty")),
    ("Apache-2.0", "notice", ("apache2.ref", "apache2.comply")),
    ("BSD-4-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.names")),
    ("BSD-3-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("MIT", "text", ("mit.grant",)),
    ("MIT-0", "text", ("mit0.grant",)),
    ("ISC", "text", ("isc.grant",)),
    ("0BSD", "text", ("0bsd.grant",)),
    ("Unlicense", "text", ("unlicense.grant",)),
    ("Zlib", "text", ("zlib.grant",)),
    ("BSL-1.0", "text", ("bsl1.grant",)),
    ("CC0-1.0", "notice", ("cc0.grant",)),
    ("MPL-2.0", "notice", ("mpl2.ref",)),
    ("EPL-2.0", "notice", ("epl2.ref",)),
    ("MIT", "reference", ("mit.title",)),
    ("MIT", "reference", ("mit.ref",)),
    ("Apache-2.0", "reference", ("apache2.ref",)),
    ("GPL-3.0-only", "reference", ("gpl3.ref",)),
    ("CC-BY-NC-4.0", "reference", ("ccbync4.ref",)),
    ("CC-BY-4.0", "reference", ("ccby4.ref",)),
    ("CC-BY-SA-4.0", "reference", ("ccbysa4.ref",)),
    ("CC0-1.0", "reference", ("cc0.ref",)),
    ("BSL-1.0", "reference", ("bsl1.ref",)),
    ("BSL-1.0", "reference", ("bsl1.title",)),
    ("BSD-2-Clause", "reference", ("bsd2.title",)),
    ("BSD-3-Clause", "reference", ("bsd3.title",)),
    ("ISC", "reference", ("isc.title",)),
    ("Apache-2.0", "reference", ("apache2.title",)),
    ("GPL-2.0", "reference", ("gpl2.title",)),
    ("GPL-3.0", "reference", ("gpl3.title",)),
    ("LGPL-2.1", "reference", ("lgpl21.title",)),
    ("LGPL-3.0", "reference", ("lgpl3.title",)),
    ("AGPL-3.0", "reference", ("agpl3.title",)),
    ("MPL-2.0", "reference", ("mpl2.title",)),
    ("proprietary", "reference", ("copyright", "rights.reserved")),
    ("proprietary", "reference", ("rights.reserved",)),
)

LINE = re.compile(r"[^\r\n]+")
#: Comment marks before the content of a line, a list mark behind them, and comment marks at its end.
BEFORE = re.compile(r"""[ \t\r\f\v\ufeff\xa0]*(?:(?:<!--+|\(\*+|/\*+!?|/{2,}|\*+|\#+!?|;+|--+|%+|>+|[|!:+_.\\-]+(?=\s)|["']{3}|(?i:dnl|@?rem)(?=\s))[ \t\r\xa0]*)*""")
ITEM = re.compile(r"(\(?(?:[0-9]{1,2}|[A-Za-z])[.)]|[•o])[ \t]+")
BEHIND = ("*/", "-->", "*)", '"""', "'''")
MARK = re.compile(r"\(?[0-9A-Za-z]{1,2}[.)]|[•o]")
RULED = re.compile(r"[\W_]*")
END = re.compile(r"(?:[.!?;]|(?<!dentifier):)(?=\s|$)")
EDGES = re.compile(r"[\s#*/\;>|%_+.-]*(?:\(?[0-9a-z]{1,2}[.)]\s+)?")
SPACE = re.compile(r"\s+")
ALIKE = str.maketrans({"“": "'", "”": "'", "‘": "'", "’": "'", '"': "'", "`": "'", "–": "-", "—": "-"})
#: No known sentence lacks all of these.
HINT = re.compile(r"(?i)licen[sc]e|rights\s+reserved|copyright|permission|redistribution|free\W+software|any\s+warranty|endorse|public\s+domain|unencumbered|advertising\s+materials|\bcc0\b|\bcc\s+by\b|without\s+fee|warranties|\bunder\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:mit|isc|zlib|wtfpl|expat|apache|[al]?gpl|gnu|mpl|epl|bsd|cc)|as\s+is\b|non-commercial|be\s+liable|conditions\W+for\W+use")
SORTED = sorted(SENTENCES)
#: Sentences with names in them (``PATTERNS``), and references, are at most this long once normalised; all others end with the table.
LONGEST, LONGEST_REFERENCE = 600, 200
#: Words of a sentence that tell where it begins inside a line.
OPENING = 3


def _openings() -> re.Pattern:
    """Where a known sentence, or a pointer to the licence's file, may begin behind other words of the same line."""
    words = {" ".join(t.split(" ")[:OPENING]) for t in SENTENCES if t.count(" ") >= OPENING}
    words |= {"neither the name", "copyright (c)", "copyright ©"}
    begin = "|".join(re.escape(w).replace("\\ ", r"\s+").replace("'", "[\"'`“”‘’]") for w in sorted(words, reverse=True))
    known = rf"(?:{begin})|(?:dual[- ])?(?:released|licensed|distributed|published|available)\s+under\b"
    pointer = r"(?:[-–—(,:]{1,3}\s{0,3})?(?:please\s{1,9})?see\s{1,9}(?:the\s{1,9})?(?:accompanying\s{1,9}|included\s{1,9})?(?:file\s{1,9})?\W{0,3}(?:licen[sc]e|copying)"
    return re.compile(rf"(?i)(?<=\s)(?<!not\s)(?<!never\s)(?<!longer\s)(?<!neither\s)(?:{known}|{pointer})")


OPENINGS = _openings()


def flat(text: str) -> str:
    """Lower case, quotes, dashes and white space made alike."""
    return SPACE.sub(" ", text.translate(ALIKE).lower()).strip()


def trimmed(text: str) -> str:
    """A flat sentence without marks at its edges."""
    return text[EDGES.match(text).end():].rstrip(" .!?;*/")


def normalised(sentence: str) -> str:
    return trimmed(flat(sentence))


def named(name: str) -> str | None:
    """The licence of a normalised name, with or without the word itself."""
    name = name.strip(" ,'()<>*_[]")
    bare = re.sub(r"(?: open source)? licen[sc]e$", "", name)
    known = NAMED.get(name) or NAMED.get(bare)
    if known:
        return known
    m = GNU.fullmatch(name) or GNU.fullmatch(re.sub(r"(?<=gpl)[- ](?=\d)", " v", name))
    if m:
        family, of = m["family"], m["of"]
        short = family.upper() if family.endswith("gpl") else FAMILIES[family[:family.index("general")]]
        return f"{short}-{of if '.' in of else of + '.0'}-{'or-later' if m['later'] else 'only'}"
    m = CC.fullmatch(name)
    if m:
        parts = re.findall("|".join(sorted(CC_PARTS, key=len, reverse=True)), m["with"])
        return "-".join(["CC-BY", *[CC_PARTS[p] for p in parts], m["of"]])
    return None


def identify(text: str) -> str | None:
    """The identifier of a normalised sentence."""
    known = SENTENCES.get(text)
    if known:
        return known
    for begin, pattern, name in PATTERNS:
        m = pattern.fullmatch(text) if begin.match(text) else None
        if m and name == "spdx":
            return f"spdx:{m[1]}"
        if m and name == "grant":
            version = m["later"] or m["of"] or m["only"]
            return f"grant:{FAMILIES[m['family']]}-{version if '.' in version else version + '.0'}-{'or-later' if m['later'] else 'only'}"
        if m:
            return name
    m = REFERENCE[0].match(text) if len(text) <= LONGEST_REFERENCE else None
    licence = named(text[REFERENCE[1].match(text, m.end()).end():]) if m else None
    return f"ref:{licence}" if licence else None


def content_end(text: str, at: int, to: int) -> int:
    """Where the content of a line ends, before comment marks and white space."""
    line = text[at:to].rstrip()
    for mark in BEHIND:
        line = line.removesuffix(mark)
    return at + len(line.rstrip(" \t\r\f\v\xa0*#|"))


def fragments(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """Start, end, whether a paragraph begins, and whether a sentence mark ends it.

    Lines without words are left out. A list mark is a fragment, as it may be a wrapped number.
    """
    fresh, last = True, 0
    for line in LINE.finditer(text):
        # Between two lines stand line ends only: \n, \r or both together.
        if line.start() - last - text.count("\r\n", last, line.start()) > 1:
            fresh = True
        last = line.end()
        at = BEFORE.match(text, line.start(), line.end()).end()
        to = content_end(text, at, line.end())
        if RULED.fullmatch(text, at, to):
            fresh = True
            continue
        item = ITEM.match(text, at, to)
        if item:
            yield at, item.end(1), fresh, True
            at, fresh = item.end(), False
        cuts = deque(m.start() for m in OPENINGS.finditer(text, at + 1, to))
        m = END.search(text, at, to)
        while at < to:
            end = m.end() if m else to
            while cuts and cuts[0] <= at:
                cuts.popleft()
            if cuts and cuts[0] < end:
                stop = content_end(text, at, cuts[0])
                if stop > at:
                    yield at, stop, fresh, False
                    fresh = False
                at = cuts[0]
                continue
            yield at, end, fresh, m is not None
            fresh = False
            while end < to and text[end].isspace():
                end += 1
            at = end
            m = END.search(text, at, to) if m else None


def sentences(text: str) -> list[tuple[int, int, int, str]]:
    """Number, start, end and identifier of the known sentences; unknown ones count in the numbers."""
    parts = list(fragments(text))
    words = [flat(text[a:b]) for a, b, _, _ in parts]
    found, number, i, going = [], 0, 0, False
    while i < len(parts):
        start, stop, fresh, ended = parts[i]
        best, joined, begun = None, "", None
        for j in range(i, len(parts)):
            a, b, new, _ = parts[j]
            if j > i and new:
                break
            joined = f"{joined} {words[j]}" if j > i else words[j]
            now = trimmed(joined)
            if not now:
                break
            if begun is None:
                varies = any(begin.match(now + " ") for begin, _, name in PATTERNS if name not in ("copyright", "spdx"))
                begun = LONGEST if varies else LONGEST_REFERENCE if REFERENCE[0].match(now + " ") else 0
            name = identify(now)
            if name and not (name == "copyright" and j > i):
                best = (j, b, name)
            at = bisect_left(SORTED, now)
            if len(now) > begun and not (at < len(SORTED) and SORTED[at].startswith(now)):
                break
        if best:
            number += 1
            found.append((number, start, best[1], best[2]))
            i, going = best[0] + 1, False
            continue
        if not (going and not fresh) and not MARK.fullmatch(text, start, stop):
            number += 1
            going = True
        if ended:
            going = False
        i += 1
    return found


def scan(text: str, gap: int = 2) -> list[tuple[str, str, int, int]]:
    """(licence, kind, start, end) of every rule that fits, in order."""
    if not HINT.search(text):
        return []
    known = sentences(text)
    found, at = [], 0
    while at < len(known):
        n, a, b, first = known[at]
        if first.startswith("spdx:"):
            names = dict.fromkeys(x.strip("()") for x in re.split(r" (?:and|or) ", first[5:]))
            found += [(x, "tag", a, b, n, n) for x in names]
            at += 1
            continue
        if first.startswith("ref:"):
            found.append((first[4:], "reference", a, b, n, n))
            at += 1
            continue
        if first.startswith("grant:"):
            more = at + 1 < len(known) and known[at + 1][3] == "gpl.warranty" and known[at + 1][0] - n <= gap + 1
            at += more
            found.append((first[6:], "notice", a, known[at][2], n, known[at][0]))
            at += 1
            continue
        for name, kind, rule in RULES:
            part = known[at: at + len(rule)]
            if tuple(p[3] for p in part) == rule and all(q[0] - p[0] <= gap + 1 for p, q in zip(part, part[1:])):
                found.append((name, kind, a, part[-1][2], n, part[-1][0]))
                at += len(rule)
                break
        else:
            at += 1
    granted = [f[0] != "proprietary" for f in found]
    before, last = [], None
    for f, real in zip(found, granted):
        before.append(last)
        last = f[5] if real else last
    behind, last = [], None
    for f, real in zip(found[::-1], granted[::-1]):
        behind.append(last)
        last = f[4] if real else last
    near = lambda f, left, right: left is not None and f[4] - left <= gap + 1 or right is not None and right - f[5] <= gap + 1
    return [f[:4] for f, real, left, right in zip(found, granted, before, behind[::-1]) if real or not near(f, left, right)]


def scan_licenses(docs: DataFrame, gap: int = 2) -> DataFrame:
    """``doc_id, n_licenses, licenses, spans`` of every row: distinct names, sorted, and ``name:kind:start:end`` in order, comma-joined."""
    def make():
        def step(batch: pa.RecordBatch):
            found = [scan(t or "", gap) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([",".join(sorted({x[0] for x in f})) for f in found], pa.string()),
                 pa.array([",".join(":".join(map(str, x)) for x in f) for f in found], pa.string())],
                ["doc_id", "n_licenses", "licenses", "spans"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make,
                       "doc_id long, n_licenses long, licenses string, spans string")
