"""References that were left out: those without the word licence in them, those to several licences, "+" behind a version."""

import pytest

pytest.importorskip("tessella.llm")
from tessella.llm import license_rules  # noqa: E402

RULES = license_rules.Recogniser()


@pytest.mark.parametrize(("text", "licences"), [
    ("Released under GPLv3.", ["GPL-3.0-only"]), ("Distributed under the Apache 2.0.", ["Apache-2.0"]), ("This project is available under CC BY 4.0", ["CC-BY-4.0"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("// SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause) OR ISC", ["GPL-2.0-or-later", "BSD-3-Clause", "ISC"]),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only"]), ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]), ("Released under the LGPLv3+.", ["LGPL-3.0-or-later"]),
    ("Licensed under either of the Apache License, Version 2.0\nor the MIT license.", ["Apache-2.0", "MIT"]), ("This software is provided under the MIT and BSD 3-Clause licenses.", ["MIT", "BSD-3-Clause"]),
    ("Licensed under the GPL version 2 or later.", ["GPL-2.0-or-later"]), ("Available under the MIT or MIT license.", ["MIT"]),
])
def test_references(text, licences):
    found = RULES.match(f"Some title\n\n{text}\n\nsome words")
    assert [m[1] for m in found] == licences
    assert {(m[2], m[3]) for m in found} == {(12, 12 + len(text))} or text.startswith("//")


def test_no_known_sentence_is_filtered_out():
    """The words that a text has to hold to be split at all, against every form of reference and every fixed sentence."""
    fixed = [s.replace("*", "someone") for own in license_rules.SENTENCES.values() for s in own]
    references = [f"{head} {name}" for head in ("spdx license identifier", "license", *(f"{v} under" for v in license_rules.VERBS)) for name in ("mit", "gpl v3", "cc by 4 0", "zlib")]
    for sentence in fixed + references:
        known = RULES.sentences(sentence)
        assert known and any(a in sentence for a in license_rules.ANCHORS), sentence
        assert bool(RULES.match(sentence)) == any(k[2] in RULES.by_first and any(len(r[2]) == 1 for r in RULES.by_first[k[2]]) for k in known), sentence


def test_joint_references_in_a_table(spark):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT OR Apache-2.0"), (2, "Published under GPLv3+"), (3, "available")], "doc_id long, text string")
    got = {r.doc_id: (r.n_matches, r.licences) for r in license_rules.licences(docs).collect()}
    assert got == {1: (2, "Apache-2.0,MIT"), 2: (1, "GPL-3.0-or-later"), 3: (0, "")}
