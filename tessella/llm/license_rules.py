"""Licence recognition by sentence rules.

A text is cut into pieces at line ends and behind ".", "!", "?", ";" or ":" before white space; list marks and comment marks at a
piece's beginning belong to none. Pieces are normalised (lower case, letters and digits only, spellings made one); the longest run of
pieces within a paragraph that is a known licence sentence gets its identifier, so hard-wrapped sentences and those with
";" or ":" inside are known too. A paragraph ends at a line without letters and digits. Known sentences are fixed texts, fixed texts with a
blank ("*": 1 to 12 words, such as a holder's name) and references, which a grammar of prefixes, verbs and licence names makes.

A reference to several licences ("MIT or Apache-2.0", also as an SPDX expression) is a sentence of each, in their order; exceptions
("with ...") belong to no name.

A rule is an ordered list of identifiers; the list of a document's identifiers is matched from left to right, at each place by
the longest rule whose sentences follow one another with at most `gap` words of other text between. Texts without any of the anchor
words, of which every known sentence holds one, have no match and aren't split.

Defined results: null and empty texts have no licence; every match is told in order with its character span, repeated ones too;
at one place the rule with most sentences wins, then the one listed first; very long texts are read whole, sentences of any
length; rows that repeat a doc_id are read each by itself; extra columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame

from .common import lean, slices, worker_table

# Known licence sentences by identifier, normalised. "*" stands for 1 to 12 words.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2-title": ("apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"),
    "apache2-use": ("you may not use this file except in compliance with the license", "you may not use * except in compliance with the license"),
    "apache2-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache2-asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "mit0-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    ),
    "asis": (
        "the software is provided as is without warranty of any kind express or implied",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "mit-liable": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "in no event shall the authors or copyright holders be liable for any claim",
    ),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc-asis": (
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    "bsd-redist": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-advert": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-endorse": ("neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-asis": ("this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "zlib-asis": ("this software is provided as is without any express or implied warranty",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost-title": ("boost software license version 1 0 august 17th 2003",),
    "boost-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "boost-ref": ("distributed under the boost software license version 1 0", "use modification and distribution are subject to the boost software license version 1 0"),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "wtfpl-title": ("do what the fuck you want to public license version 2 december 2004", "do what the fuck you want to public license"),
    "gpl1-title": ("gnu general public license version 1 february 1989",),
    "gpl2-title": ("gnu general public license version 2 june 1991",),
    "gpl3-title": ("gnu general public license version 3 29 june 2007",),
    "lgpl2-title": ("gnu lesser general public license version 2 1 february 1999",),
    "lgpl3-title": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl3-title": ("gnu affero general public license version 3 19 november 2007",),
    "fsf-verbatim": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    "mpl2-title": ("mozilla public license version 2 0",),
    "mpl2-subject": ("this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    "mpl2-copy": ("if a copy of the mpl was not distributed with this file you can obtain one at", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https www mozilla org mpl 2 0"),
    "epl1-made": ("all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    "epl2-made": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0"),
    "cc0-title": ("cc0 1 0 universal", "creative commons cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"),
    "cc0-waive": ("to the extent possible under law * has waived all copyright and related or neighboring rights to *",),
    "ofl-title": ("sil open font license version 1 1 26 february 2007",),
    "ofl-ref": ("this font software is licensed under the sil open font license version 1 1",),
    "artistic2-title": ("the artistic license 2 0", "artistic license 2 0"),
    "everyone-verbatim": ("everyone is permitted to copy and distribute verbatim copies of this license document",),
}

# Names of licences in references, normalised, without a leading "the" and a closing "license".
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license v 2 0", "apache 2 0", "apache license version 2", "apache software license version 2 0"),
    "MIT": ("mit", "mit x11", "expat"),
    "MIT-0": ("mit 0", "mit no attribution"),
    "ISC": ("isc",),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd", "two clause bsd"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "three clause bsd"),
    "0BSD": ("0bsd", "zero clause bsd", "bsd zero clause"),
    "Zlib": ("zlib", "zlib libpng"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "bsl 1 0"),
    "Unlicense": ("unlicense",),
    "WTFPL": ("wtfpl", "do what the fuck you want to public"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mozilla public license v 2 0", "mpl 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v 2 0", "epl 2 0"),
    "CC0-1.0": ("cc0 1 0", "cc0", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal", "cc0 1 0 universal"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1", "ofl 1 1"),
    "Artistic-2.0": ("artistic license 2 0", "artistic 2 0"),
}
#: The GNU family: abbreviation, name without "gnu" and "license", versions.
GNU = (("GPL", "general public", ("2.0", "3.0")), ("LGPL", "lesser general public", ("2.1", "3.0")), ("LGPL", "library general public", ("2.0",)), ("AGPL", "affero general public", ("3.0",)))
#: The Creative Commons family: letters, words in between.
CC = (("BY", ()), ("BY-SA", ("sharealike", "share alike")), ("BY-NC", ("noncommercial", "non commercial")), ("BY-ND", ("noderivatives", "noderivs", "no derivatives")),
      ("BY-NC-SA", ("noncommercial sharealike", "non commercial share alike")), ("BY-NC-ND", ("noncommercial noderivatives", "noncommercial noderivs", "non commercial no derivatives")))

# Ordered rules of sentences, licence and sentence identifiers. References (a rule each) come from the names.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("apache-2.0-notice", "Apache-2.0", ("ref:Apache-2.0", "apache2-use", "apache2-copy", "apache2-asis")),
    ("apache-2.0-short-notice", "Apache-2.0", ("ref:Apache-2.0", "apache2-use")),
    ("apache-2.0-text", "Apache-2.0", ("apache2-title",)),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "asis", "mit-liable")),
    ("mit-text-short", "MIT", ("mit-grant", "mit-notice", "asis")),
    ("mit-grant", "MIT", ("mit-grant", "mit-notice")),
    ("mit-0-text", "MIT-0", ("mit0-grant", "asis")),
    ("isc-text", "ISC", ("isc-grant", "isc-asis")),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("0bsd-text", "0BSD", ("0bsd-grant", "isc-asis")),
    ("bsd-4-clause", "BSD-4-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-advert")),
    ("bsd-3-clause", "BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-2-clause", "BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("zlib-text", "Zlib", ("zlib-asis", "zlib-grant")),
    ("bsl-1.0-text", "BSL-1.0", ("boost-title", "boost-grant")),
    ("bsl-1.0-grant", "BSL-1.0", ("boost-grant",)),
    ("bsl-1.0-notice", "BSL-1.0", ("boost-ref",)),
    ("unlicense-text", "Unlicense", ("unlicense-free",)),
    ("wtfpl-text", "WTFPL", ("wtfpl-title",)),
    ("gpl-1.0-text", "GPL-1.0-only", ("gpl1-title", "fsf-verbatim")),
    ("gpl-2.0-text", "GPL-2.0-only", ("gpl2-title", "fsf-verbatim")),
    ("gpl-3.0-text", "GPL-3.0-only", ("gpl3-title", "fsf-verbatim")),
    ("lgpl-2.1-text", "LGPL-2.1-only", ("lgpl2-title", "fsf-verbatim")),
    ("lgpl-3.0-text", "LGPL-3.0-only", ("lgpl3-title", "fsf-verbatim")),
    ("agpl-3.0-text", "AGPL-3.0-only", ("agpl3-title", "fsf-verbatim")),
    ("mpl-2.0-notice", "MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("mpl-2.0-subject", "MPL-2.0", ("mpl2-subject",)),
    ("mpl-2.0-text", "MPL-2.0", ("mpl2-title",)),
    ("epl-1.0-notice", "EPL-1.0", ("epl1-made",)),
    ("epl-2.0-notice", "EPL-2.0", ("epl2-made",)),
    ("cc0-1.0-text", "CC0-1.0", ("cc0-title",)),
    ("cc0-1.0-waiver", "CC0-1.0", ("cc0-waive",)),
    ("ofl-1.1-notice", "OFL-1.1", ("ofl-ref",)),
    ("ofl-1.1-text", "OFL-1.1", ("ofl-title",)),
    ("artistic-2.0-text", "Artistic-2.0", ("artistic2-title", "everyone-verbatim")),
)
#: What a reference says of a work, before "under" or "by".
VERBS = ("licensed", "released", "distributed", "published", "available", "made available", "free software licensed", "provided", "covered")
#: Every known sentence holds one of these, before or after spellings are made one: fixed ones, and references by their verb.
ANCHORS = ("licen", "permission", "copyright", "warrant", "redistribut", "unencumbered", "advertising", "permitted", "cc0", "liable", "mpl", *VERBS)

_SPLIT = re.compile(r"\n|(?<=[.!?;:])\s")
_NOISE = re.compile(r"[^a-z0-9]+")
#: "or later" as a sign behind a version, as in "GPL-2.0+".
_PLUS = re.compile(r"(?<=\d)\+")
_MARKS = re.compile(r"[^\w(]*(?:\(?(?:\d{1,2}|[a-zA-Z]|[ivx]{1,4})[.)](?=\s|$))?[^\w(]*")
#: Spellings that are made one, in normalised text.
_SPELLINGS = ((re.compile(r"\blicence"), "license"), (re.compile(r"\bnon infringement\b"), "noninfringement"), (re.compile(r"\bsub licen[cs]e\b"), "sublicense"), (re.compile(r"\bcopyright c\b"), "copyright"))
_BLANK = r"\S+(?: \S+){0,11}"


def normalised(part: str) -> str:
    out = _NOISE.sub(" ", _PLUS.sub(" plus ", part.lower())).strip()
    for wrong, right in _SPELLINGS:
        out = wrong.sub(right, out)
    return out


def _gnu_names() -> Iterator[tuple[str, str]]:
    for short, name, versions in GNU:
        for v in versions:
            forms = {v.replace(".", " "), v.removesuffix(".0").replace(".", " ")}
            for form in sorted(forms):
                for mark in ("version ", "v", "v ", ""):
                    for whole in (f"gnu {name} license {mark}{form}", f"gnu {short.lower()} {mark}{form}", f"{short.lower()} {mark}{form}", f"{short.lower()}{mark}{form}"):
                        yield whole, f"{short}-{v}-only"
                        for later in ("or later", "or any later version", "or at your option any later version", "only"):
                            yield f"{whole} {later}", f"{short}-{v}-{'only' if later == 'only' else 'or-later'}"
                        yield f"{whole}+".replace("+", " plus"), f"{short}-{v}-or-later"


def _cc_names() -> Iterator[tuple[str, str]]:
    for letters, words in CC:
        for v in ("4.0", "3.0", "2.0"):
            form, low = v.replace(".", " "), letters.lower().replace("-", " ")
            for whole in (f"cc {low} {form}", *(f"creative commons attribution {w} {form}".replace("  ", " ") for w in words or ("",)), *(f"creative commons attribution {w} {form} international".replace("  ", " ") for w in words or ("",))):
                yield whole, f"CC-{letters}-{v}"


def names() -> dict[str, str]:
    """Normalised licence names as they stand in references, to licences."""
    plain = ((n, licence) for licence, own in NAMES.items() for n in own)
    return dict(itertools.chain(plain, _gnu_names(), _cc_names()))


def _known_names() -> dict[str, str]:
    """Names with and without a closing "license"."""
    return {n + end: licence for n, licence in names().items() for end in ("", " license")}


_WHAT = r"(?:(?:this|the|our|all) (?:\w+ ){0,2}?(?:project|software|program|library|package|work|file|files|code|source code|module|document|documentation|content|repository|font|material|text|article|tool|app|website|data|dataset) (?:is|are) |(?:it|they) (?:is|are) |\S+ is )?"
_VERB = r"(?:dual |also |hereby )?(?:" + "|".join(VERBS) + r") (?:to you )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:either (?:of )?|both )?(?:the )?"
#: Between the names of a reference to several licences.
_JOINT = r" (?:or|and|and or) (?:the )?"
_EXCEPTION = r"(?: with (?:\S+ ){1,5}?exception(?: \d+)*)?"
_FREE = r"\S+(?: \S+){0,5}? is free software you can redistribute it and or modify it under the terms of the (?P<free>gnu (?:lesser |library |affero )?general public license) as published by the free software foundation (?:either )?version (?P<v>\d(?: \d)?)(?: of the license)?(?P<later> or at your option any later version)?"


class Recogniser:
    """sentences: identifier to normalised texts; rules: (rule, licence, identifiers); gap: words between a rule's sentences."""

    def __init__(self, sentences: Mapping[str, Sequence[str]] = SENTENCES, rules: Sequence[tuple[str, str, Sequence[str]]] = RULES, gap: int = 40):
        import regex

        self.given = (sentences, rules, gap)
        self.names = _known_names()
        self.ids = {s: k for k, own in sentences.items() for s in own if "*" not in s}
        # All beginnings of fixed sentences, so that a run of pieces ends where no sentence goes on.
        self.begins = {" ".join(w[:k]) for s in self.ids if (w := s.split()) for k in range(1, len(w) + 1)}
        self.blanks = [(k, regex.compile(regex.escape(s, special_only=True).replace(r"\*", _BLANK))) for k, own in sentences.items() for s in own if "*" in s]
        name = regex.compile(r"(?:" + "|".join(sorted(map(regex.escape, self.names), key=len, reverse=True)) + ")").pattern
        spdx = r"spdx license identifier "
        one = f"(?P<name>{name}){_EXCEPTION}"
        self.reference = regex.compile(f"(?:{spdx}|{_WHAT}{_VERB}|license ){one}(?:{_JOINT}{one})*(?: the license| the \\S+ license| licenses)?")
        self.free = regex.compile(_FREE)
        self.gap = gap
        self.by_first: dict[str, list] = {}
        for rule in rules:
            self.by_first.setdefault(rule[2][0], []).append(rule)
        for own in self.by_first.values():
            own.sort(key=lambda r: -len(r[2]))
        for licence in sorted(set(self.names.values())):
            self.by_first.setdefault(f"ref:{licence}", []).append((f"{licence.lower()}-reference", licence, (f"ref:{licence}",)))
            base = licence.lower().removesuffix("-or-later")
            self.by_first.setdefault(f"free:{licence}", []).extend([(f"{base}-notice", licence, (f"free:{licence}", "gpl-hope")), (f"{base}-free", licence, (f"free:{licence}",))])

    def identify(self, run: str) -> str | None:
        """The identifier of a normalised sentence; those of a reference to several licences with "|" between."""
        known = self.ids.get(run)
        if known is None and (m := self.reference.fullmatch(run)):
            known = "|".join(dict.fromkeys("ref:" + self.names[n] for n in m.captures("name")))
        if known is None and (m := self.free.fullmatch(run)):
            short = {"gnu general public license": "GPL", "gnu affero general public license": "AGPL"}.get(m["free"], "LGPL")
            version = m["v"].replace(" ", ".")
            known = f"free:{short}-{version if '.' in version else version + '.0'}-{'or-later' if m['later'] else 'only'}"
        return known or next((k for k, form in self.blanks if form.fullmatch(run)), None)

    def goes_on(self, run: str) -> bool:
        """Whether a known sentence may begin with the run."""
        return run in self.begins or any(f.fullmatch(run, partial=True) for f in (self.reference, self.free, *(f for _, f in self.blanks)))

    def pieces(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(normalised, begin, end, whether it begins a paragraph) of every piece with letters or digits."""
        out, at, line, fresh = [], 0, True, True
        for m in itertools.chain(_SPLIT.finditer(text), [None]):
            end, after = m.span() if m else (len(text), len(text))
            begin, cut = _MARKS.match(text, at, end).end() if end > at else at, not m or m.group() == "\n"
            if norm := normalised(text[begin:end]):
                out.append((norm, begin, end, fresh))
                line, fresh = cut, False
            elif cut and not normalised(text[at:end]):
                line, fresh = True, fresh or line
            at = after
        return out

    def sentences(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(words before, words up to its end, identifier, begin, end) of the known ones."""
        pieces, found, i = self.pieces(text), [], 0
        words = [0, *itertools.accumulate(p[0].count(" ") + 1 for p in pieces)]
        while i < len(pieces):
            run, best = "", None
            for k in range(i, len(pieces)):
                part, _, end, fresh = pieces[k]
                if k > i and fresh:
                    break
                run = f"{run} {part}" if run else part
                if not self.goes_on(run):
                    break
                if (known := self.identify(run)) is not None:
                    best = (k, [(words[i], words[k + 1], one, pieces[i][1], end) for one in known.split("|")])
            if best:
                found += best[1]
            i = best[0] + 1 if best else i + 1
        return found

    def match(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """(rule, licence, begin, end) in order."""
        low = (text or "").lower()
        if not any(a in low for a in ANCHORS):
            return []
        known, out, i = self.sentences(text), [], 0
        while i < len(known):
            for rule, licence, wanted in self.by_first.get(known[i][2], ()):
                part = known[i : i + len(wanted)]
                near = all(b[0] - a[1] <= self.gap for a, b in itertools.pairwise(part))
                if near and tuple(p[2] for p in part) == tuple(wanted):
                    out.append((rule, licence, part[0][3], part[-1][4]))
                    i += len(wanted)
                    break
            else:
                i += 1
        return out


def licences(docs: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(doc_id, n_matches, licences, matches array<struct<rule, licence, begin, end>>) for every row."""
    given = recogniser.given if recogniser else (SENTENCES, RULES, 40)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        # Built once a worker: patterns of many names take a second to compile.
        rules = worker_table(("licences", repr(given)), lambda: Recogniser(*given))
        kind = pa.list_(pa.struct([("rule", pa.string()), ("licence", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for b in slices(batch):
                found = [rules.match(t.as_py()) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array([",".join(sorted({m[1] for m in f})) for f in found]),
                    pa.array([[dict(zip(("rule", "licence", "begin", "end"), m, strict=True)) for m in f] for f in found], kind),
                ], names=["doc_id", "n_matches", "licences", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_matches long, licences string, matches array<struct<rule: string, licence: string, begin: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: lean(run(batches)), schema)
