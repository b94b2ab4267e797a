"""Operator 3: license scans by ordered signature rules.

A text becomes its words, each followed by one space. Rules are regular expressions over that string,
anchored at a word. A keyword prefilter skips texts that hold none of the rules' keywords, and a rule
is only tried where one of its own first words stands. Detections are intervals of words with a
priority: inside another one of no worse priority a detection is suppressed, and of two that overlap
otherwise the one of worse priority.

An SPDX expression labels each of its licenses and exceptions: the first one's detection begins at "SPDX",
those of later ones, after AND, OR or WITH, at themselves. Versioned identifiers count alone too, last.

Everything is per row: no shuffle, no Python. What rules see of a text is held for CHUNK places at a time
and at most REACH words each, so a long text takes memory in proportion to its words. Defined results: a
null or empty text has 0 words, no label and score 0; repeated rows give repeated results; other columns
don't matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words before lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No rule spans as many words as this; a rule sees so many words of the text from its start.
REACH = 64
#: Word counts are summed in spans of so many parts, so that running sums stay linear in a long text.
SPAN = 256
#: Places that are looked at together: what their rules see of the text is held for so many at a time.
CHUNK = 1024

#: The phrases that every scan labels, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

V2, V3 = r"(?:version |v ?)?2(?: 0)?(?: only| or later)?", r"(?:version |v ?)?3(?: 0)?(?: only| or later)?"
#: Licenses by name: label, regex of the name, regex of the SPDX identifier's words.
NAMES = [
    ("gpl-2.0", rf"gnu (?:general public licen[sc]e|gpl) {V2}", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", rf"gnu (?:general public licen[sc]e|gpl) {V3}", "gpl 3 0(?: only| or later)?"),
    ("gpl", "gnu (?:general public licen[sc]e|gpl)", "gpl 1 0(?: only| or later)?"),
    ("lgpl-2.1", r"gnu (?:lesser|library) general public licen[sc]e (?:version |v ?)?2(?: 1| 0)?(?: only| or later)?", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-3.0", rf"gnu lesser general public licen[sc]e {V3}", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "gnu (?:lesser|library) general public licen[sc]e", "lgpl"),
    ("agpl-3.0", rf"gnu affero general public licen[sc]e {V3}", "agpl 3 0(?: only| or later)?"),
    ("agpl", "gnu affero general public licen[sc]e", "agpl 1 0"),
    ("gfdl-1.3", r"gnu free documentation licen[sc]e (?:version )?1 3", "gfdl 1 3(?: only| or later)?"),
    ("gfdl", "gnu free documentation licen[sc]e", "gfdl 1 [12]"),
    ("apache-2.0", rf"apache licen[sc]e {V2}", "apache 2 0"),
    ("apache-1.1", r"apache (?:software )?licen[sc]e (?:version )?1 1", "apache 1 1"),
    ("apache", "apache (?:software |public )?licen[sc]e", "apache 1 0"),
    ("mit", "mit licen[sc]e", "mit"),
    ("mit-0", "mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("x11", "x11 licen[sc]e", "x11"),
    ("bsd-2-clause", "(?:2 clause|two clause|simplified|freebsd) bsd licen[sc]e|bsd 2 clause licen[sc]e", "bsd 2 clause"),
    ("bsd-3-clause", "(?:3 clause|three clause|new|revised|modified) bsd licen[sc]e|bsd 3 clause licen[sc]e", "bsd 3 clause"),
    ("bsd-4-clause", "(?:4 clause|four clause|original) bsd licen[sc]e|bsd 4 clause licen[sc]e", "bsd 4 clause"),
    ("0bsd", "(?:zero clause|0 clause) bsd licen[sc]e|bsd zero clause licen[sc]e", "0bsd"),
    ("bsd", "bsd (?:style )?licen[sc]e", "bsd"),
    ("isc", "isc licen[sc]e", "isc"),
    ("mpl-2.0", rf"mozilla public licen[sc]e {V2}", "mpl 2 0"),
    ("mpl-1.1", r"mozilla public licen[sc]e (?:version )?1 [01]", "mpl 1 [01]"),
    ("mpl", "mozilla public licen[sc]e", "mpl"),
    ("epl-2.0", rf"eclipse public licen[sc]e {V2}", "epl 2 0"),
    ("epl-1.0", r"eclipse public licen[sc]e (?:version |v ?)?1 0", "epl 1 0"),
    ("cddl-1.0", "common development and distribution licen[sc]e(?: version)?(?: 1 [01])?", "cddl 1 [01]"),
    ("cpl-1.0", "common public licen[sc]e(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("eupl", "european union public licen[sc]e(?: v ?| version )?(?:1 [0-2])?", "eupl 1 [0-2]"),
    ("artistic-2.0", rf"artistic licen[sc]e {V2}", "artistic 2 0"),
    ("artistic", "artistic licen[sc]e", "artistic 1 0"),
    ("bsl-1.0", "boost software licen[sc]e(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("unlicense", "the unlicense|unlicense licen[sc]e", "unlicense"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e|wtfpl licen[sc]e", "wtfpl"),
    ("python-2.0", "python software foundation licen[sc]e(?: version)?(?: 2)?|psf licen[sc]e", "psf 2 0"),
    ("php-3.01", r"php licen[sc]e(?: version)?(?: 3(?: 0\d?)?)?", "php 3 01?"),
    ("postgresql", "postgresql licen[sc]e", "postgresql"),
    ("openssl", "openssl licen[sc]e", "openssl"),
    ("ofl-1.1", "sil open font licen[sc]e(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("odbl", "open (?:data commons open )?database licen[sc]e", "odbl 1 0"),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?|creative commons zero", "cc0 1 0"),
    ("cc-by-nc-nd", "(?:cc|creative commons) by nc nd(?: [1-4] 0)?|creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc by nc nd [1-4] 0"),
    ("cc-by-nc-sa", "(?:cc|creative commons) by nc sa(?: [1-4] 0)?|creative commons attribution non ?commercial share ?alike", "cc by nc sa [1-4] 0"),
    ("cc-by-nc", "(?:cc|creative commons) by nc(?: [1-4] 0)?|creative commons attribution non ?commercial", "cc by nc [1-4] 0"),
    ("cc-by-nd", "(?:cc|creative commons) by nd(?: [1-4] 0)?|creative commons attribution no ?deriv(?:ative)?s", "cc by nd [1-4] 0"),
    ("cc-by-sa", "(?:cc|creative commons) by sa(?: [1-4] 0)?|creative commons attribution share ?alike", "cc by sa [1-4] 0"),
    ("cc-by", "(?:cc|creative commons) by(?: [1-4] 0)?|creative commons attribution", "cc by [1-4] 0"),
]
#: How a name is used: prefix in words, priority (smaller is better), confidence.
FORMS = [
    ("(?:licen[sc]ed|released|distributed|available|published|covered|provided) under (?:the )?(?:terms of )?(?:the )?", 2, 0.95),
    ("dual licen[sc]ed under (?:the )?", 2, 0.95),
    ("licen[sc]e (?:type )?(?:the )?", 3, 0.8),
    ("", 4, 0.7),
]
#: Exceptions that an SPDX expression may add to a license: label, regex of the identifier's words.
EXCEPTIONS = [("gpl-classpath-exception", "classpath exception 2 0"), ("gcc-exception", "gcc exception [23] [01]"), ("llvm-exception", "llvm exception")]
#: What may stand between "identifier" and a later license of the same SPDX expression.
BEFORE = "((?:(?:[a-z0-9]+ ){1,6}(?:and|or|with) ){1,6})"
#: Identifiers that stand for their license without any other word.
BARE = ["gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "mpl-2.0", "cc0-1.0"]
#: Sentences of license texts and notices: label, regex, confidence.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions of source code must retain the above copyright notice", 0.95),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 0.95),
    ("bsd-3-clause", "neither the name of [^ ]+(?: [^ ]+){0,12} nor the names of its contributors may be used to endorse", 1.0),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", 1.0),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 1.0),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", 0.9),
    ("apache-2.0", "you may not use this file except in compliance with the license", 0.95),
    ("apache-2.0", "www apache org licenses license 2 0", 1.0),
    ("mit", "opensource org licenses mit", 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v ?2 0", 1.0),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003", 1.0),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.8),
    ("cc-by", "creativecommons org licenses by [1-4] 0", 1.0),
    ("cc-by-sa", "creativecommons org licenses by sa [1-4] 0", 1.0),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4] 0", 1.0),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", 1.0),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.6),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 1.0),
    ("mit-0", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is", 1.0),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising", 1.0),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee|with or without fee) is hereby granted", 1.0),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies", 1.0),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 1.0),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?|freebsd project) as is and any express or implied warranties", 0.9),
    ("bsd-3-clause", "the names? of [^ ]+(?: [^ ]+){0,12} may not be used to endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "this product includes software developed by the university of california", 1.0),
    ("bsd-3-clause-clear", "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", 1.0),
    ("gpl-2.0", "under the terms of the gnu general public licen[sc]e version 2 as published by the free software foundation", 1.0),
    ("gpl-2.0", "either version 2 of the licen[sc]e or at your option any later version", 0.8),
    ("gpl-3.0", "either version 3 of the licen[sc]e or at your option any later version", 0.8),
    ("lgpl-2.1", "either version 2 1 of the licen[sc]e or at your option any later version", 0.9),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e along with this program", 1.0),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library", 1.0),
    ("agpl", "you should have received a copy of the gnu affero general public licen[sc]e along with this program", 1.0),
    ("gpl-2.0", "gnu general public licen[sc]e version 2 june 1991", 1.0),
    ("gpl-3.0", "gnu general public licen[sc]e version 3 29 june 2007", 1.0),
    ("lgpl-2.1", "gnu lesser general public licen[sc]e version 2 1 february 1999", 1.0),
    ("lgpl-3.0", "gnu lesser general public licen[sc]e version 3 29 june 2007", 1.0),
    ("agpl-3.0", "gnu affero general public licen[sc]e version 3 19 november 2007", 1.0),
    ("gpl", "the licen[sc]es for most software are designed to take away your freedom to share and change it", 1.0),
    ("gpl-3.0", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 1.0),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1.0),
    ("gpl-classpath-exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules", 1.0),
    ("gcc-exception", "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception", 1.0),
    ("apache-2.0", "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file", 1.0),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 0.95),
    ("apache-2.0", "apache licen[sc]e version 2 0 january 2004", 1.0),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 0.9),
    ("apache-2.0", "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", 1.0),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0", 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 1.0),
    ("mpl-1.1", "software distributed under the licen[sc]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[sc]e for the specific language governing rights", 0.7),
    ("epl-1.0", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0", 1.0),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2 0", 1.0),
    ("epl", "the accompanying materials are provided under the terms of this eclipse public licen[sc]e", 1.0),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 1.0),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public licen[sc]e", 1.0),
    ("eupl", "licen[sc]ed under the eupl", 0.9),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic-2.0", "this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 1.0),
    ("artistic", "under the same terms as perl itself", 0.7),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("unlicense", "unlicense org", 0.9),
    ("wtfpl", "you just do what the fuck you want to", 1.0),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", 1.0),
    ("python-2.0", "this licen[sc]e agreement is between the python software foundation psf and the individual or organization", 1.0),
    ("php-3.01", "this product includes php software freely available from", 1.0),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("openssl", "this product includes cryptographic software written by eric young", 1.0),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    ("ofl-1.1", "this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1", 1.0),
    ("ofl-1.1", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", 1.0),
    ("odbl", "this data(?:base)? is made available under the open database licen[sc]e", 1.0),
    ("pddl", "open data commons public domain dedication and licen[sc]e", 1.0),
    ("cc0-1.0", "to the extent possible under law [^ ]+(?: [^ ]+){0,12} has waived all copyright and related or neighboring rights", 1.0),
    ("cc-by", "this work is licen[sc]ed under a creative commons attribution [1-4] 0 (?:international|unported|generic) licen[sc]e", 1.0),
    ("cc-by-sa", "this work is licen[sc]ed under a creative commons attribution share ?alike [1-4] 0 (?:international|unported|generic) licen[sc]e", 1.0),
    ("cc-by-nc", "this work is licen[sc]ed under a creative commons attribution non ?commercial [1-4] 0 (?:international|unported|generic) licen[sc]e", 1.0),
    ("cc-by-nc-sa", "this work is licen[sc]ed under a creative commons attribution non ?commercial share ?alike [1-4] 0 (?:international|unported|generic) licen[sc]e", 1.0),
    ("cc-by-nd", "this work is licen[sc]ed under a creative commons attribution no ?deriv(?:ative)?s [1-4] 0 (?:international|unported|generic) licen[sc]e", 1.0),
    ("cc-by-nc-nd", "this work is licen[sc]ed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s [1-4] 0 (?:international|unported|generic) licen[sc]e", 1.0),
    ("cc-by-nd", "creativecommons org licen[sc]es by nd [1-4] 0", 1.0),
    ("cc-by-nc-sa", "creativecommons org licen[sc]es by nc sa [1-4] 0", 1.0),
    ("cc-by-nc-nd", "creativecommons org licen[sc]es by nc nd [1-4] 0", 1.0),
    ("gpl", "www gnu org licen[sc]es gpl", 0.95),
    ("lgpl", "www gnu org licen[sc]es lgpl", 0.95),
    ("agpl", "www gnu org licen[sc]es agpl", 0.95),
    ("gpl-2.0", "www gnu org licen[sc]es old licen[sc]es gpl 2 0", 1.0),
    ("bsd-3-clause", "opensource org licen[sc]es bsd 3 clause", 1.0),
    ("bsd-2-clause", "opensource org licen[sc]es bsd 2 clause", 1.0),
    ("isc", "opensource org licen[sc]es isc", 1.0),
    ("bsl-1.0", "www boost org licen[sc]e 1 0 txt", 1.0),
    ("mpl-2.0", "mozilla org mpl 2 0", 0.9),
    ("epl-2.0", "www eclipse org legal epl (?:2 0|v20)", 0.95),
    ("busl-1.1", "business source licen[sc]e 1 1", 1.0),
    ("sspl-1.0", "server side public licen[sc]e", 1.0),
    ("elastic-2.0", "elastic licen[sc]e 2 0", 1.0),
    ("ms-pl", "microsoft public licen[sc]e", 0.9),
    ("ms-rl", "microsoft reciprocal licen[sc]e", 0.9),
    ("commons-clause", "commons clause licen[sc]e condition", 1.0),
    ("ncsa", "university of illinois ncsa open source licen[sc]e", 1.0),
    ("vim", "vim licen[sc]e", 0.8),
    ("ruby", "ruby licen[sc]e|same terms as ruby", 0.8),
    ("ecl-2.0", "educational community licen[sc]e", 0.9),
    ("osl-3.0", "open software licen[sc]e", 0.8),
    ("afl-3.0", "academic free licen[sc]e", 0.9),
    ("public-domain", "this file is (?:hereby )?(?:in|released into|placed in) the public domain", 0.9),
    ("public-domain", "this code is (?:hereby )?(?:in|released into|placed in) the public domain", 0.9),
    ("public-domain", "this software is (?:hereby )?(?:in|released into|placed in) the public domain", 0.9),
    ("public-domain", "this work is (?:hereby )?(?:in|released into|placed in) the public domain", 0.9),
    ("public-domain", "this program is (?:hereby )?(?:in|released into|placed in) the public domain", 0.9),
    ("public-domain", "public domain software", 0.6),
    ("public-domain", "no copyright is claimed|no rights reserved", 0.6),
    ("proprietary", "unauthorized copying of this (?:file|software) via any medium is strictly prohibited", 1.0),
    ("proprietary", "proprietary and confidential", 0.8),
    ("proprietary", "may not be reproduced (?:or )?(?:distributed )?(?:in any form )?without (?:the )?(?:prior )?(?:express )?written permission", 0.7),
    ("proprietary", "all rights reserved", 0.5),
]
#: A text without any of these can't match a rule. They are tried on the text as it is, so each lies within one word; "cc by" has a regex.
KEYWORDS = ["licen", "permission", "permitted", "redistributions", "contributors", "advertising", "spdx", "creative", "cc0", "domain", "rights", "encumbered", "altered", "wtfpl", "gnu", "attribution", "compile", "whatever", "mozilla", "claimed", "confidential", "ruby", "typefaces", "intent", "endorse", "warrant", "cryptographic", "php", "apache", "openssl", "california", "unauthorized", "perl", "eclipse", "fuck", "gpl", "clause", "mpl"]
CC_BY = rf"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])cc{SEPARATORS}by"


def alternatives(pattern: str) -> list[str]:
    """The alternatives at the top level of a regex."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def first_words(pattern: str) -> list[str]:
    """Literal heads of each alternative, at most up to its first character that isn't a letter, digit or space."""
    heads = []
    for alternative in alternatives(pattern):
        if alternative.startswith("(?:"):
            depth = end = 0
            for end, c in enumerate(alternative):
                depth += (c == "(") - (c == ")")
                if end and not depth:
                    break
            optional = alternative[end + 1 : end + 2] == "?"
            heads += first_words(alternative[3:end]) + (first_words(alternative[end + 2 :]) if optional else [])
            continue
        head = ""
        for c in alternative:
            if not (c.isalnum() or c == " "):
                head = head[:-1] if c == "?" else head
                break
            head += c
        heads.append(head)
    return heads


def rules() -> list[tuple[str, str, int, float]]:
    """All rules in order: label, regex, priority, confidence."""
    out = [(label, rf"spdx license identifier (?:{spdx})", 0, 1.0) for label, _, spdx in NAMES]
    out += [(label, rf"spdx license identifier {BEFORE}(?:{spdx})", 0, 1.0) for label, spdx in [*((n, x) for n, _, x in NAMES), *EXCEPTIONS]]
    out += [(label, regex, 1, confidence) for label, regex, confidence in TEXTS]
    out += [(label, f"{prefix}(?:{name})", priority, confidence) for prefix, priority, confidence in FORMS for label, name, _ in NAMES]
    out += [(label, spdx, 5, 0.6) for label, _, spdx in NAMES if label in BARE]
    return out


#: Any place where a rule may begin: its form's first word, or a name's head.
STARTS = sorted({h for _, r, _, _ in rules() for h in first_words(r)} | set(BASE))


ARRAY = "array<struct<head:string,regex:string,priority:int,n:int,label:string,confidence:double>>"


def rule_table() -> Column:
    """The rules as one constant map, by the two letters that a head begins with; a rule for each head of its regex."""
    rows: dict[str, list] = {}
    for n, (label, r, p, c) in enumerate(rules()):
        for h in sorted(set(first_words(r))):
            # Group 1 is what comes before a later license of an expression; the license begins after it.
            rows.setdefault(h[:2], []).append({"head": h, "regex": f"^(?:{r}) " + ("" if BEFORE in r else "()"), "priority": p, "n": n, "label": label, "confidence": c})
    return F.from_json(F.lit(json.dumps(rows)), f"map<string,{ARRAY}>")


def word_count(spaced: Column) -> Column:
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))).cast("long")


def suppressed(found: Column) -> Column:
    """Detections of each place, without those that another one suppresses.

    One inside another of no worse priority goes (of equal intervals and priorities the later rule); of
    two that overlap in any other way the one of worse priority goes. No detection spans REACH words,
    so those that overlap one begin at most REACH places before or after it.
    """

    def beaten(d: Column, e: Column) -> Column:
        d_end, e_end = -d["minus_end"], -e["minus_end"]
        same = (d["start"] == e["start"]) & (d_end == e_end)
        inside = (e["start"] <= d["start"]) & (d_end <= e_end)
        apart = (d_end <= e["start"]) | (e_end <= d["start"])
        order = (e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (e["n"] < d["n"]))
        return ~apart & F.when(same, order).when(inside, e["priority"] <= d["priority"]).otherwise(e["priority"] < d["priority"])

    def left(place: Column, i: Column) -> Column:
        first = F.greatest(i - REACH, F.lit(0))
        near = F.flatten(F.slice(found, first + 1, i - first + 1 + REACH))
        return F.filter(place, lambda d: ~F.exists(near, lambda e: beaten(d, e)))

    return F.flatten(F.transform(found, left))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    df = docs.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    lower = F.lower("text")
    gate = F.contains(lower, F.lit("cc")) & lower.rlike(CC_BY)
    for k in KEYWORDS:
        gate = gate | F.contains(lower, F.lit(k))
    # The words of a text, each followed by a space. Those that pass are cut before each place where a rule may begin.
    df = df.select("doc_id", gate.alias("gate"), F.ltrim(F.concat(F.regexp_replace("text", GAPS, " "), F.lit(" "))).alias("words"))
    df = df.withColumn("words", F.concat(F.rtrim("words"), F.when(F.trim("words") == "", "").otherwise(" ")))
    parts = F.split(F.translate("words", UPPER, LOWER), "(?:^|(?<= ))(?=" + "|".join(STARTS) + ")")
    df = df.select("doc_id", word_count(F.col("words")).alias("n_words"), F.when(F.col("gate"), parts).otherwise(F.array().cast("array<string>")).alias("parts"))
    # Word number at which each part begins: running sums of spans of SPAN parts, and inside the part's span.
    df = df.withColumn("counts", F.transform("parts", word_count))
    total = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    spans = F.transform(F.sequence(F.lit(0), F.expr(f"size(counts) div {SPAN}")), lambda k: total(F.slice("counts", k * SPAN + 1, F.lit(SPAN))))
    df = df.withColumn("spans", F.aggregate(spans, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))))
    # A column that a lambda reads once would be computed anew for each element; read twice, it is kept.
    begun = lambda i: F.when(F.size("spans") > i, F.get("spans", i))
    begins = F.transform("counts", lambda n, i: begun(F.floor(i / SPAN).cast("int")) + total(F.slice("counts", F.floor(i / SPAN).cast("int") * SPAN + 1, i % SPAN)))
    df = df.withColumn("begins", begins)
    # A rule sees REACH words: those of its own part and, if these are fewer, of the next parts.
    df = df.withColumn("heads", F.transform("parts", lambda p: F.substring_index(p, " ", REACH + 1)))
    phrases = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(f"{phrase} ").alias("phrase")) for phrase, label in BASE.items()])
    table = rule_table()

    def looked(at: Column, rest: Column) -> Column:
        """What begins at a place: base labels, and the rules that match, as intervals of words."""
        base = F.transform(F.filter(phrases, lambda b: F.startswith(rest, b["phrase"])), lambda b: F.struct(at.alias("at"), b["label"].alias("label")))
        asked = F.coalesce(F.try_element_at(table, F.substring(rest, 1, 2)), F.array().cast(ARRAY))
        tried = F.filter(asked, lambda r: F.startswith(rest, r["head"]) & F.call_function("rlike", rest, r["regex"]))
        words = lambda r, group: word_count(F.call_function("regexp_extract", rest, r["regex"], F.lit(group)))
        begin = lambda r: F.when(words(r, 1) > 0, at + 3 + words(r, 1)).otherwise(at)
        found = F.transform(tried, lambda r: F.struct(begin(r).alias("start"), (-(at + words(r, 0))).alias("minus_end"), r["priority"], r["n"], r["label"], r["confidence"]))
        return F.struct(base.alias("base"), found.alias("found"))

    def chunk(k: Column) -> Column:
        """Places CHUNK * k to CHUNK * (k + 1) - 1 at which anything begins."""
        rests = F.transform(F.slice("heads", k * CHUNK + 1, F.lit(CHUNK)), lambda _, i: F.substring_index(F.array_join(F.slice("heads", k * CHUNK + i + 1, F.lit(REACH)), ""), " ", REACH))
        rests = F.transform(rests, lambda r: F.concat(r, F.lit(" ")))
        begins = F.when(F.size("begins") > k * CHUNK, F.slice("begins", k * CHUNK + 1, F.lit(CHUNK))).otherwise(F.array().cast("array<bigint>"))
        seen = F.zip_with(begins, rests, looked)
        return F.filter(seen, lambda p: (F.size(p["base"]) > 0) | (F.size(p["found"]) > 0))

    df = df.withColumn("seen", F.flatten(F.transform(F.sequence(F.lit(0), F.expr(f"size(heads) div {CHUNK}")), chunk)))
    found = F.filter(F.transform("seen", lambda p: p["found"]), lambda p: F.size(p) > 0)
    df = df.withColumns({"base": F.flatten(F.transform("seen", lambda p: p["base"])), "found": found}).withColumn("detections", F.array_sort(suppressed(F.col("found"))))
    base_labels, at = F.transform("base", lambda b: b["label"]), F.transform("base", lambda b: b["at"])
    labels = F.concat(base_labels, F.transform("detections", lambda d: d["label"]))
    return df.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("detections", lambda d: F.struct(d["start"], (-d["minus_end"]).alias("end"), d["label"], d["priority"])).alias("detections"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("detections")


QUERIES = {"op3_licenses": op3_licenses}
SQL: dict[str, str] = {}
