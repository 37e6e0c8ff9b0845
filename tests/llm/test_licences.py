"""Licence sentences and rules: full notices in the forms that files have them, and a brute-force recogniser over a whole table."""

import itertools
import textwrap

import pytest

pytest.importorskip("tessella.llm")
from tessella.llm import license_rules  # noqa: E402

GNU_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GNU_TEXT = "GNU {name} LICENSE\nVersion {version}\n\nCopyright (C) Free Software Foundation, Inc. <https://fsf.org/>\n\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nPreamble"
GNU_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_TAIL = '\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
MIT = """Copyright (c) 2020 Some Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{then}

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_ASIS = '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
TEXTS = {
    "MIT": MIT.format(then=", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MIT-0": MIT.format(then="."),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + ISC_ASIS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + ISC_ASIS,
    "BSD-2-Clause": BSD_HEAD + BSD_TAIL,
    "BSD-3-Clause": BSD_HEAD + "\n\n3. Neither the name of the Example Foundation nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + BSD_TAIL,
    "BSD-4-Clause": BSD_HEAD + "\n\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software." + BSD_TAIL,
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-2.0-or-later": GNU_FREE.format(name="", version=2).replace("software:", "software;") + "\n\n" + GNU_HOPE,
    "GPL-3.0-or-later": GNU_FREE.format(name="", version=3) + "\n\n" + GNU_HOPE,
    "LGPL-3.0-or-later": GNU_FREE.format(name="Lesser ", version=3) + "\n\n" + GNU_HOPE,
    "LGPL-2.1-or-later": GNU_FREE.format(name="Lesser ", version="2.1").replace("This program", "This library") + "\n\n" + GNU_HOPE.replace("This program", "This library"),
    "AGPL-3.0-or-later": GNU_FREE.format(name="Affero ", version=3) + "\n\n" + GNU_HOPE,
    "GPL-2.0-only": GNU_TEXT.format(name="GENERAL PUBLIC", version="2, June 1991"),
    "GPL-3.0-only": GNU_TEXT.format(name="GENERAL PUBLIC", version="3, 29 June 2007"),
    "LGPL-2.1-only": GNU_TEXT.format(name="LESSER GENERAL PUBLIC", version="2.1, February 1999"),
    "AGPL-3.0-only": GNU_TEXT.format(name="AFFERO GENERAL PUBLIC", version="3, 19 November 2007"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.",
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below.",
}
FORMS = {
    "lines": lambda t: t,
    "wrapped": lambda t: "\n".join("\n".join(textwrap.wrap(p, 66, break_long_words=False)) for p in t.split("\n")),
    "stars": lambda t: "/*\n" + "\n".join(f" * {line}".rstrip() for line in FORMS["wrapped"](t).split("\n")) + "\n */",
    "hashes": lambda t: "\n".join(f"# {line}".rstrip() for line in FORMS["wrapped"](t).split("\n")),
    "crlf": lambda t: FORMS["wrapped"](t).replace("\n", "\r\n"),
    "blanks": lambda t: t.replace(" ", " " * 70),
}
RULES = license_rules.Recogniser()


@pytest.mark.parametrize("form", sorted(FORMS))
@pytest.mark.parametrize("licence", sorted(TEXTS))
def test_full_texts(licence, form):
    found = RULES.match(f"Own words before it.\n\n{FORMS[form](TEXTS[licence])}\n\nmore words")
    assert [m[1] for m in found] == [licence], found


@pytest.mark.parametrize(("text", "licence"), [
    ("This project is licensed under the terms of the MIT license.", "MIT"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("License: BSD 3-Clause", "BSD-3-Clause"), ("Released under the 2-clause BSD licence.", "BSD-2-Clause"),
    ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Licensed under LGPLv3.", "LGPL-3.0-only"),
    ("The source code is available under the GNU Affero General Public License, version 3.", "AGPL-3.0-only"), ("It is distributed under the Mozilla Public License 2.0.", "MPL-2.0"),
    ("licensed under the MIT\nlicense", "MIT"),
])
def test_references(text, licence):
    assert [m[1] for m in RULES.match(f"Some title\n\n{text}\n\nsome words")] == [licence]


def test_what_is_no_licence():
    for text in ("This project is not licensed under the MIT License.", "See the LICENSE file for licences.", "The driver's license was released under protest.", "", None, "Redistribution of wealth", "Permission denied: copyright"):
        assert RULES.match(text) == []


def _brute(text):
    """Every run of pieces of a paragraph is tried, the longest first; every rule is tried at every place, in the order of its length."""
    pieces, known, i = RULES.pieces(text), [], 0
    words = [0, *itertools.accumulate(len(p[0].split()) for p in pieces)]
    while i < len(pieces):
        end = next((k for k in range(i + 1, len(pieces)) if pieces[k][3]), len(pieces))
        for k in range(min(end, i + 60), i, -1):
            name = RULES.identify(" ".join(p[0] for p in pieces[i:k]))
            if name:
                known.append((words[i], words[k], name, pieces[i][1], pieces[k - 1][2]))
                i = k - 1
                break
        i += 1
    rules = sorted(itertools.chain(*RULES.by_first.values()), key=lambda r: -len(r[2]))
    out, i = [], 0
    while i < len(known):
        for rule, licence, wanted in rules:
            part = known[i : i + len(wanted)]
            if [p[2] for p in part] == list(wanted) and all(b[0] - a[1] <= RULES.gap for a, b in zip(part, part[1:], strict=False)):
                out.append((rule, licence, part[0][3], part[-1][4]))
                i += len(wanted) - 1
                break
        i += 1
    return out


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    mixed = [(10_000 + i, f"{a}\n\n{FORMS['wrapped'](b)} {a}\n{b}") for i, (a, b) in enumerate(itertools.pairwise([*TEXTS.values(), *TEXTS.values()]))]
    odd = [(20_000, None), (20_000, ""), (20_001, "word " * 20_000 + "\nLicensed under CC BY 4.0."), (None, "Released under the MIT License.")]
    docs = docs.union(spark.createDataFrame([*mixed, *odd], "doc_id long, text string"))
    texts = {(r.doc_id, r.text): _brute(r.text or "") for r in docs.collect()}
    got = license_rules.licences(docs).collect()
    want = sorted((str(d), len(m), str([tuple(x) for x in m])) for (d, _), m in texts.items())
    assert sorted((str(r.doc_id), r.n_matches, str([tuple(m) for m in r.matches])) for r in got) == want
    assert sum(n for _, n, _ in want) > 60 and license_rules.licences(docs.limit(0)).count() == 0
