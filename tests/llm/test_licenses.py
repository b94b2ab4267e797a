"""Operator 3: base labels against brute force, rules by example."""

from __future__ import annotations

import re
from re import _parser

from strataloom.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


CASES = [
    (10, "MIT License mit license MIT LICENSE"), (11, "CC-BY"), (12, "xcc by cc byx cc   by"), (13, "éapache license Apache License."), (14, " ,GNU,general-public license version 2 or later"),
    (15, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (16, "..."), (17, "SPDX-License-Identifier: Apache-2.0 " + "mit license " * 300), (18, "Released under the MIT License"),
    (19, "Licensed under CC BY-NC 4.0, all rights reserved"), (20, "KKMIT license"),
]


def test_base_labels(table, hard):
    rows = hard + CASES
    got = licenses.scan_licenses(table(rows, extra=["words", "gate", "parts"])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.doc_id is not None) == sorted((i, *brute(t)) for i, t in rows if i is not None)


def test_rules_and_suppression(table):
    got = {r.doc_id: r for r in licenses.scan_licenses(table(CASES)).collect()}
    assert got[14].labels == "gpl,gpl-2.0" and got[15].labels == "mit" and got[15].score == 1.0
    assert got[18].labels == "mit" and len(got[18].detections) == 1  # the name inside the notice is suppressed
    assert "cc-by-nc" in got[19].labels.split(",") and got[16].score == 0.0
    assert len(licenses.rules()) > 200 and all(h for _, r, _, _ in licenses.rules() for h in licenses.first_words(r))


def own_texts(regex):
    """The shortest and the longest of the texts that a rule describes, for each of its alternatives."""

    def spelled(parsed, most):
        texts = [""]
        for kind, value in parsed:
            match str(kind):
                case "LITERAL":
                    part = [chr(value)]
                case "NOT_LITERAL":
                    part = ["w"]
                case "IN":
                    first = value[0]
                    part = ["w" if str(first[0]) == "NEGATE" else "7" if str(first[0]) == "CATEGORY" else chr(first[1] if str(first[0]) == "LITERAL" else first[1][0])]
                case "BRANCH":
                    part = [t for p in value[1] for t in spelled(p, most)]
                case "SUBPATTERN":
                    part = spelled(value[3], most)
                case "MAX_REPEAT":
                    low, high, inner = value
                    part = [t * (min(high, 2) if most else low) for t in spelled(inner, most)]
            texts = list(dict.fromkeys(a + b for a in texts for b in part))
        return texts

    return [t for most in (False, True) for t in spelled(_parser.parse(regex), most)]


def test_own_texts_pass_the_gate(table):
    own = sorted({" ".join(t.split()) for _, regex, _, _ in licenses.rules() for t in own_texts(regex) if re.fullmatch(regex, " ".join(t.split()))})
    assert all(any(re.fullmatch(regex, t) for t in own) for _, regex, _, _ in licenses.rules())
    rows = [(i, gap.join(t.split())) for i, (t, gap) in enumerate((t, gap) for t in own for gap in ("\n", " -* "))]
    got = licenses.scan_licenses(table(rows)).select("doc_id", "score").collect()
    assert [rows[r.doc_id] for r in got if not r.score] == []


def test_priority_resolves_overlaps(table):
    """An identifier beats the sentence it overlaps; names inside notices go; neighbours stay."""
    rows = [
        (1, "released under the terms of the gnu lesser general public license version 2.1 or later"),
        (2, "SPDX-License-Identifier: MIT license type the Apache License"),
        (3, "mit license and bsd license"),
        (4, "unless stated, licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ]
    got = {r.doc_id: [(d.start, d.end, d.label) for d in r.detections] for r in licenses.scan_licenses(table(rows)).collect()}
    assert got[1] == [(0, 16, "lgpl-2.1")] and got[3] == [(0, 2, "mit"), (3, 5, "bsd")]
    assert got[2] == [(0, 4, "mit"), (4, 9, "apache")]
    assert {x for _, _, x in got[4]} == {"apache-2.0"}


def test_many_places(table):
    n = 3000
    (row,) = licenses.scan_licenses(table([(1, "released under the mit license " * n)])).collect()
    assert (row.n_base, row.last_word, len(row.detections)) == (n, 5 * n - 2, n)


def test_wrapped_public_domain(table):
    rows = [(1, "dedicated to the public\ndomain"), (2, "Released in the Public-Domain."), (3, "placed  into  the  public  domain"), (4, "a domain of public interest")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(table(rows)).collect()}
    assert got == {1: ("public-domain", 0.8), 2: ("public-domain", 0.8), 3: ("public-domain", 0.8), 4: ("", 0.0)}


def test_spdx_expressions(table):
    rows = [
        (1, "SPDX-License-Identifier: MIT OR Apache-2.0"),
        (2, "SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)"),
        (3, "SPDX-License-Identifier: GPL-2.0+ AND LGPL-2.1-or-later"),
        (4, "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0"),
        (5, "SPDX-License-Identifier: MIT-0 AND (ISC OR (Zlib AND Apache-2.0 WITH LLVM-exception))"),
        (6, "files under Apache-2.0 apply"),
        (7, "SPDX-License-Identifier: MIT"),
        (8, "BSD-3-Clause"),
        (9, "a mit of an isc, with bsd and x11"),
    ]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(table(rows)).collect()}
    assert got == {1: "apache-2.0,mit", 2: "bsd-3-clause,gpl-2.0", 3: "gpl-2.0,lgpl-2.1", 4: "gpl-2.0,gpl-classpath-exception", 5: "apache-2.0,isc,llvm-exception,mit-0,zlib", 6: "apache-2.0", 7: "mit", 8: "bsd-3-clause", 9: ""}


def test_suppression_like_pairs(table):
    """Detections that stay, against all detections compared in pairs."""
    texts = ["SPDX-License-Identifier: MIT OR GPL-2.0-only license type the Apache License version 2.0", "dual licensed under the mit license or the bsd license", "released under the terms of the gnu lesser general public license version 2.1 or later", "cc by nc sa 4.0 creative commons attribution share alike"]
    starts = [(label, re.compile(r + " "), p, n) for n, (label, r, p, _) in enumerate(licenses.rules())]
    for r in licenses.scan_licenses(table(list(enumerate(texts)))).collect():
        words = re.findall("[a-z0-9]+", texts[r.doc_id].lower())
        found = []
        for i in range(len(words)):
            rest = " ".join(words[i:]) + " "
            for label, regex, p, n in starts:
                if m := regex.match(rest):
                    skip = 3 + m.group(1).count(" ") if m.re.groups and m.group(1) else 0
                    found.append((i + skip, i + m.group().count(" "), p, n, label))

        def beaten(d, e):
            if d[1] <= e[0] or e[1] <= d[0]:
                return False
            if d[:2] == e[:2]:
                return e[2:4] < d[2:4]
            return e[2] <= d[2] if e[0] <= d[0] and d[1] <= e[1] else e[2] < d[2]

        stay = sorted({(d[0], d[1], d[4]) for d in found if not any(beaten(d, e) for e in found)})
        assert sorted({(d.start, d.end, d.label) for d in r.detections}) == stay


def test_very_long_text(table):
    """A part of 40 kB between places, and many places: memory in proportion to the words."""
    block = "mit license " + "lorem ipsum " * 3400
    (row,) = licenses.scan_licenses(table([(1, block * 100 + "apache license")])).collect()
    assert (row.n_words, row.n_base, row.labels) == (6802 * 100 + 2, 101, "apache,mit")


def test_empty_table(table):
    assert licenses.scan_licenses(table([])).count() == 0
