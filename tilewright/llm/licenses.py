"""License scans: ordered signature rules behind a keyword prefilter.

A text's words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; rules see the
words joined by single spaces. A rule is a regular expression with a keyword, a priority and a label. It runs
only where its keyword occurs; of overlapping detections the one of higher priority, then the longer, then the
earlier rule stays, and one that lies within a kept one goes. The three base phrases are found first by plain
search over words; their places are all counted and their labels always stay.

Null is the empty text, which has no words: counts 0, places null, labels empty, score 0. Rows are independent:
repeated rows stay, an empty table gives an empty one. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import ALNUM, chunks, lower_ascii, row_bounds, words

#: Phrases with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Labels, names as they stand in texts (words, spaces between), and versions.
FAMILIES: list[tuple[str, list[str], list[str]]] = [
    ("gpl", ["gnu general public license", "gnu gpl", "gpl"], ["1", "2", "3"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"], ["2", "2 1", "3"]),
    ("agpl", ["gnu affero general public license", "gnu agpl", "agpl"], ["1", "3"]),
    ("fdl", ["gnu free documentation license", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("apache", ["apache license", "apache software license", "apache licence"], ["1", "1 1", "2"]),
    ("mpl", ["mozilla public license", "mpl"], ["1", "1 1", "2"]),
    ("epl", ["eclipse public license", "epl"], ["1", "2"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1", "1 1"]),
    ("eupl", ["european union public licence", "european union public license", "eupl"], ["1", "1 1", "1 2"]),
    ("afl", ["academic free license"], ["1", "2", "3"]),
    ("osl", ["open software license"], ["1", "2", "3"]),
    ("artistic", ["artistic license"], ["1", "2"]),
    ("ofl", ["sil open font license", "open font license"], ["1", "1 1"]),
    ("odbl", ["open database license", "odbl"], ["1"]),
    ("cecill", ["cecill"], ["1", "2", "2 1"]),
    ("cpl", ["common public license"], ["1"]),
    ("bsl", ["boost software license"], ["1"]),
    ("upl", ["universal permissive license"], ["1"]),
    ("ms-pl", ["microsoft public license"], []),
    ("mit", ["mit license", "mit licence", "expat license", "x11 license"], []),
    ("bsd", ["bsd license", "bsd licence", "bsd style license", "berkeley software distribution license"], []),
    ("isc", ["isc license", "isc licence"], []),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("unlicense", ["the unlicense", "unlicense org"], []),
    ("wtfpl", ["wtfpl"], []),
    ("psf", ["python software foundation license"], []),
    ("php", ["php license"], []),
    ("ruby", ["ruby license"], []),
    ("vim", ["vim license"], []),
    ("openssl", ["openssl license"], []),
]

#: Creative Commons terms.
CC = [("by", "by|attribution"), ("by-sa", "by sa|attribution share ?alike"), ("by-nd", "by nd|attribution no ?deriv(?:ative)?s"), ("by-nc", "by nc|attribution non ?commercial"), ("by-nc-sa", "by nc sa|attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd|attribution non ?commercial no ?deriv(?:ative)?s")]

#: Other statements: keyword, pattern, label, priority.
STATEMENTS = [
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 90),
    ("redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)? are permitted", "bsd", 90),
    ("permission to use", r"permission to use copy modify and or distribute this software for any purpose", "isc", 90),
    ("provided as is", r"(?:this|the) software is provided as is without (?:express or implied )?warranty", "warranty-disclaimer", 20),
    ("all rights reserved", r"all rights reserved", "all-rights-reserved", 20),
    ("public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public-domain", 60),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright-notice", 10),
    ("spdx license identifier", r"spdx license identifier (?P<id>(?!license )[a-z0-9]+(?: [0-9]+(?: [0-9]+)?)?)", "spdx", 100),
    ("cc0", r"cc0(?: 1(?: 0)?)?", "cc0", 70),
    ("creative commons zero", r"creative commons zero", "cc0", 70),
]

#: Sentences of license texts and notices as they stand in words: keyword, pattern, label, priority.
NOTICES = [
    # texts: grants
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "bsl", 92),
    ("permission is hereby granted", r"permission is hereby granted without written agreement and without license or royalty fees", "hpnd", 91),
    ("permission is hereby granted", r"permission is hereby granted (?:to use|provided that|to copy modify)", "permissive-notice", 40),
    ("permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", "hpnd", 91),
    ("permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "isc", 92),
    ("permission is granted", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "zlib", 92),
    ("permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "fdl", 92),
    ("permission is granted", r"permission is granted to make and distribute verbatim copies of this (?:manual|document)", "verbatim-copies", 60),
    ("verbatim copies of this license", r"everyone is permitted to copy and distribute verbatim copies of this license document", "gnu-license-text", 60),
    ("verbatim or modified copies of this license", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "wtfpl", 92),
    ("copyright", r"you just do what the fuck you want to|buy me a beer in return", "beerware", 90),
    ("copyright", r"each contributor (?:hereby )?grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "apache-2", 92),
    ("licen", r"each contributor (?:hereby )?grants (?:to )?you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?patent license", "apache-2", 92),
    ("copyright", r"anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 92),
    ("public domain", r"this is free and unencumbered software released into the public domain", "unlicense", 93),
    ("public domain", r"the person who associated a work with this deed has dedicated the work to the public domain", "cc0", 92),
    ("copyright", r"to the extent possible under law (?:[^ ]+ ){1,12}?has waived all copyright and related or neighboring rights", "cc0", 92),
    ("licen", r"the licensor grants you a non exclusive royalty free licence", "eupl", 60),
    ("licen", r"subject to the terms and conditions of this public license the licensor hereby grants you", "cc-license-text", 60),
    ("licen", r"by exercising the licensed rights (?:defined below )?you accept and agree to be bound by", "cc-license-text", 60),
    ("copyright", r"the contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution", "ms-pl", 92),
    ("copyright", r"each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license", "epl", 91),
    ("source code form", r"this source code form is subject to the terms of the mozilla public license", "mpl", 93),
    ("licen", r"the initial developer hereby grants you a world ?wide royalty free non exclusive license", "mpl-1.1", 91),
    ("copyright", r"to share to copy distribute and use the database", "odbl", 80),
    ("licen", r"the font software may be sold as part of a larger software package", "ofl", 91),
    ("reserved", r"with reserved font names?", "ofl", 90),
    ("licen", r"upgrades to the work or separable portions|licensing the original work under the academic free license", "afl", 90),
    ("licen", r"licensed under the open software license|external deployment of the original work", "osl", 90),
    ("copyright", r"the intent of this document is to state the conditions under which a package may be copied", "artistic-1", 92),
    ("licen", r"this license establishes the terms under which a given free software package may be copied", "artistic-2", 92),
    ("psf", r"psf is making python available to licensee on an as is basis", "psf", 92),
    # texts: conditions
    ("redistribution", r"redistributions of source code must retain the above copyright notice", "bsd", 85),
    ("redistribution", r"redistributions in binary form must reproduce the above copyright notice", "bsd", 85),
    ("endorse", r"neither the names? of (?:[^ ]+ ){1,16}?may be used to endorse or promote products", "bsd-3-clause", 91),
    ("endorse", r"the names? of the authors? may not be used to endorse or promote products", "bsd-3-clause", 91),
    ("advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause", 92),
    ("redistribution", r"redistributions of any form whatsoever must retain the following acknowledgment", "openssl", 91),
    ("openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 91),
    ("apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation", "apache", 60),
    ("copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 91),
    ("copyright", r"provided that the above copyright notice and this permission notice appear in all copies", "isc", 90),
    ("copyright", r"except as contained in this notice the names? of (?:[^ ]+ ){1,12}?shall not be used in advertising", "x11", 91),
    ("misrepresented", r"the origin of this software must not be misrepresented", "zlib", 91),
    ("licen", r"you may not use this file except in compliance with the license", "apache-2", 88),
    ("licen", r"you may obtain a copy of the license at", "license-pointer", 30),
    ("licen", r"you must cause any modified files to carry prominent notices", "apache-2", 88),
    ("licen", r"you must cause any work that you distribute or publish (?:[^ ]+ ){1,30}?to be licensed as a whole", "gpl-2", 90),
    ("licen", r"to protect your rights we need to prevent others from denying you these rights", "gpl-3", 85),
    ("copyleft", r"is a free copyleft license for software and other kinds of works", "gpl-3", 91),
    ("copyleft", r"affero general public license is a free copyleft license", "agpl-3", 93),
    ("network server", r"remote network interaction|users interacting with it remotely through a computer network", "agpl", 80),
    ("licen", r"combined work under terms of your choice|linking (?:[^ ]+ ){0,6}?statically or dynamically with other modules", "lgpl", 60),
    ("licen", r"as a special exception (?:[^ ]+ ){0,12}?permission to link", "linking-exception", 70),
    ("licen", r"as a special exception (?:[^ ]+ ){0,12}?bison", "bison-exception", 72),
    ("classpath exception", r"classpath exception", "classpath-exception", 70),
    ("invariant sections", r"with no invariant sections(?: no front cover texts)?", "fdl", 85),
    ("commercial", r"(?:for )?non ?commercial (?:use|purposes) only", "noncommercial", 65),
    ("licen", r"you may not use the (?:material|work|software) for commercial purposes", "noncommercial", 65),
    ("licen", r"if you remix transform or build upon the material you may not distribute the modified material", "no-derivatives", 65),
    ("licen", r"you must distribute your contributions under the same license", "share-alike", 65),
    ("licen", r"you must give appropriate credit provide a link to the license", "attribution", 60),
    ("licen", r"shall be used for good not evil", "json", 92),
    ("licen", r"production use of the licensed work|change license (?:[^ ]+ ){0,6}?change date", "busl", 88),
    ("licen", r"offering the program as a service|making the functionality of the program (?:[^ ]+ ){0,6}?available to third parties as a service", "sspl", 88),
    ("licen", r"commons clause license condition", "commons-clause", 90),
    ("licen", r"use restrictions (?:[^ ]+ ){0,10}?responsible ai license|responsible ai license", "rail", 88),
    # file and page notices
    ("free software", r"this (?:program|file|library|package) is free software you can redistribute it and or modify it", "free-software-notice", 50),
    ("free software foundation", r"as published by the free software foundation", "fsf-notice", 30),
    ("or at your option", r"or at your option any later version", "or-later", 25),
    ("gnu general public license", r"you should have received a copy of the gnu general public license", "gpl", 82),
    ("lesser general public license", r"you should have received a copy of the gnu lesser general public license", "lgpl", 84),
    ("affero general public license", r"you should have received a copy of the gnu affero general public license", "agpl", 84),
    ("licen", r"dual licensed under|licensed under (?:either|both) (?:of )?", "dual-license", 35),
    ("licen", r"(?:see|read) (?:the )?licen[cs]e (?:file|txt|md)(?: for (?:details|more information|the full text))?", "license-pointer", 30),
    ("licen", r"refer to (?:the )?licen[cs]e (?:file )?for (?:details|the terms)", "license-pointer", 30),
    ("licen", r"licen[cs]e that can be found in the licen[cs]e file", "license-pointer", 32),
    ("licen", r"governed by a bsd style license", "bsd", 84),
    ("licen", r"text is available under the creative commons attribution share ?alike license", "cc-by-sa", 92),
    ("licen", r"(?:except where|unless) otherwise noted (?:[^ ]+ ){0,8}?licensed under a creative commons", "creative-commons", 60),
    ("creativecommons org", r"creativecommons org licenses by [1-4] [05]", "cc-by", 90),
    ("creativecommons org", r"creativecommons org licenses by sa", "cc-by-sa", 91),
    ("creativecommons org", r"creativecommons org licenses by nd", "cc-by-nd", 91),
    ("creativecommons org", r"creativecommons org licenses by nc(?! sa| nd)", "cc-by-nc", 91),
    ("creativecommons org", r"creativecommons org licenses by nc sa", "cc-by-nc-sa", 92),
    ("creativecommons org", r"creativecommons org licenses by nc nd", "cc-by-nc-nd", 92),
    ("creativecommons org", r"creativecommons org publicdomain zero", "cc0", 92),
    ("creativecommons org", r"creativecommons org publicdomain mark", "public-domain", 92),
    ("apache org licenses", r"apache org licenses license 2 0", "apache-2", 88),
    ("opensource org licenses", r"opensource org licenses mit(?: license)?", "mit", 88),
    ("opensource org licenses", r"opensource org licenses bsd [234] clause", "bsd", 88),
    ("gnu org licenses", r"gnu org licenses", "gnu-notice", 30),
    ("mozilla org mpl", r"mozilla org mpl", "mpl", 85),
    ("licen", r"open government licence", "ogl", 80),
    ("licen", r"etalab (?:open licence|2 0)|licence ouverte", "etalab", 80),
    ("licen", r"(?:datenlizenz|data licence) (?:deutschland|germany)", "dl-de", 80),
    ("licen", r"community data license agreement", "cdla", 80),
    # rights kept
    ("copyright", r"no part of this (?:publication|book|work|document) may be reproduced", "all-rights-reserved", 55),
    ("permission", r"without (?:the )?(?:prior |express )*written permission of the (?:publisher|author|copyright (?:holder|owner)s?)", "all-rights-reserved", 50),
    ("permission", r"(?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission", "by-permission", 45),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary", 55),
    ("licen", r"this software is licensed not sold", "proprietary", 60),
    ("licen", r"end user licen[cs]e agreement", "eula", 60),
    ("reverse engineer", r"(?:may|shall|must) not (?:[^ ]+ ){0,4}?reverse engineer", "eula", 45),
    ("government", r"is a work of the (?:united states|u s) government", "public-domain", 60),
    # disclaimers
    ("warrant", r"without warranty of any kind express or implied", "warranty-disclaimer", 22),
    ("warrant", r"without even the implied warranty of merchantability or fitness for a particular purpose", "warranty-disclaimer", 22),
    ("warrant", r"without warranties or conditions of any kind", "warranty-disclaimer", 22),
    ("liab", r"in no event shall the (?:authors?|copyright (?:holders?|owners?)|regents?|contributors?) (?:[^ ]+ ){0,6}?be liable", "liability-disclaimer", 22),
]

#: Templates around a name: prefix, suffix, priority.
TEMPLATES = [
    (r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?", "", 80),
    (r"(?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?", "", 70),
    ("", "", 50),
]


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: re.Pattern
    label: str
    priority: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: those written out, then those of names by version and template."""
    out = [Rule(k, re.compile(rf"\b(?:{p})\b"), label, n) for k, p, label, n in STATEMENTS + NOTICES]

    def add(keyword: str, body: str, label: str, extra: int) -> None:
        for before, after, n in TEMPLATES:
            out.append(Rule(keyword, re.compile(rf"(?<![^ ]){before}(?:{body}){after}(?![^ ])"), label, n + extra))

    for label, names, versions in FAMILIES:
        for name in names:
            for v in versions:
                short = v + "(?: 0)?" if " " not in v else v
                add(name, rf"{re.escape(name)}(?: gpl)? (?:v|version |v )?{short}(?: or (?:any )?later)?", f"{label}-{v.replace(' ', '.')}", 5)
            if len(name) > 4 or not versions:
                add(name, re.escape(name), label, 0)
            else:  # a bare word so short is no license
                add(name, rf"{re.escape(name)} licen[cs]e", label, 0)
                for before, after, n in TEMPLATES:
                    if before:
                        out.append(Rule(name, re.compile(rf"(?<![^ ]){before}{re.escape(name)}{after}(?![^ ])"), label, n))
    for label, body in CC:
        add("cc", rf"cc (?:{body})(?: [1-4](?: [05])?)?", f"cc-{label}", 2 * label.count("-"))
        add("creative commons", rf"creative commons (?:{body})(?: (?:license )?[1-4](?: [05])?)?", f"cc-{label}", 2 * label.count("-"))
    return tuple(out)


def detections(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of what stays, over words joined by spaces."""
    found = []
    there: dict[str, bool] = {}
    for i, r in enumerate(rules()):
        if there.setdefault(r.keyword, r.keyword in text):
            found += [(m.start(), m.end(), f"spdx-{m['id'].replace(' ', '-')}" if r.label == "spdx" else r.label, r.priority, i) for m in r.pattern.finditer(text)]
    found.sort(key=lambda x: (-x[3], x[0] - x[1], x[4], x[0]))
    kept: list[tuple[int, int, str, int]] = []  # disjoint, by place
    for a, b, label, n, _ in found:
        i = bisect_left(kept, (b,))
        if not i or kept[i - 1][1] <= a:
            kept.insert(i, (a, b, label, n))
    return kept


def _base_places(text: str) -> list[tuple[int, str]]:
    """(offset, label) of every place of a base phrase as whole words."""
    out = []
    padded = f" {text} "
    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


#: A text with none of these has no detection; each keyword and base phrase contains one.
GATE = re.compile("licen|copyright|copyleft|permission|redistribution|provided as is|reserved|public domain|cc|commons|spdx|gpl|gfdl|mpl|epl|cddl|eupl|odbl|cecill|wtfpl|psf|source code form|endorse|advertising materials|openssl toolkit|software foundation|misrepresented|network server|classpath exception|invariant sections|commercial|free software|or at your option|proprietary|reverse engineer|government|warrant|liab")


def scan(text: str) -> tuple:
    """The result's columns after n_words, from the words joined by spaces."""
    if not GATE.search(text):
        return 0, None, None, "", "", 0.0
    base, more = _base_places(text), detections(text)
    at = [text.count(" ", 0, a) for a in (min(x[0] for x in base), max(x[0] for x in base))] if base else []
    labels = {label for _, label in base}
    score = max([1.0 * bool(base), *(min(1.0, n / 100) for *_, n in more)])
    return len(base), (at[0] if at else None), (at[-1] if at else None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in more})), score


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row its key and the columns of ``COLUMNS``; see the module for their meaning."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, counts = [], []
            for a, b, data, offsets in chunks(batch.column(1)):
                data = lower_ascii(data)
                starts, ends, row = words(data, offsets, ALNUM)
                counts += np.bincount(row, minlength=b - a).tolist()
                spaced = np.where(ALNUM[data], data, np.uint8(32)).tobytes()
                at = row_bounds(row, b - a)
                for i in range(b - a):
                    if at[i] == at[i + 1]:
                        got.append(scan(""))
                        continue
                    got.append(scan(_joined(spaced[offsets[i] : offsets[i + 1]])))
            cols = list(zip(*got, strict=True)) if got else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, *(c.split()[0] for c in COLUMNS.split(", "))])

    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, {COLUMNS}")


def _joined(spaced: bytes) -> str:
    """Words joined by single spaces, from bytes with blanks for all separators."""
    return b" ".join(spaced.split()).decode()  # a word's bytes are no ASCII white space
