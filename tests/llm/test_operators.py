"""The training-data operators: awkward inputs for each, brute force where SQL can't say it."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tessella.llm")
from tessella.llm import bpe_prefix, embed_dedup, exact_dedup, license_rules, line_dedup, minhash, mixture, quality_crf, token_store, toxicity_wfst  # noqa: E402

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, score double, component string, a long, kept string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1.0, "x", 1, "y") for i, t, lang, s in rows], DOC)


LONG = " ".join(f"word{i % 977}" for i in range(20000))
AWKWARD = [
    (1, None, None, None), (2, "", "en", "src0"), (3, " \n\t ", "en", "src1"), (4, "one", "en", "src2"), (5, "one", "en", "src2"), (5, "one", "en", "src2"),
    (6, LONG, "de", "src3"), (7, LONG + " tail", "de", "src3"), (None, "text without id", "fr", "src4"), (8, "naïve ßtraße 漢字 😀 \x00\x1c", "es", "host"),
]


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows", [[], AWKWARD], ids=["empty", "awkward"])
def test_every_operator_takes_awkward_rows(spark, rows):
    docs, n = _docs(spark, rows), len(rows)
    labels = _labels(spark, [(1, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1), (5, 1, 0)] if rows else [])
    assert exact_dedup.exact_groups(docs).count() == n
    assert minhash.near_duplicates(docs, minhash.Plan(words=4)).count() == n
    assert len(quality_crf.score(docs, quality_crf.fit(docs, labels)).collect()) == n
    assert len(toxicity_wfst.score(docs, toxicity_wfst.fit(docs, labels)).collect()) == n
    assert len(line_dedup.line_report(docs).collect()) == n
    assert len(license_rules.licences(docs).collect()) == n
    assert len(mixture.select(docs).collect()) == n
    assert len(bpe_prefix.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()) == n
    assert len(token_store.store_documents(docs, P.path("word_bpe_49k.json")).collect()) == n
    for kept in (exact_dedup.drop_copies(docs), minhash.drop_near_copies(docs), mixture.mixed(docs), line_dedup.without_boilerplate(docs)):
        assert kept.columns == docs.columns and kept.count() <= 2 * n


def test_exact_groups_and_colliding_identifiers(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcs \n") for _ in range(rng.choice([0, 5, 900, 3000])))) for i in range(40)]
    rows += [(100 + i, t + "  ") for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(t.split())].append((-len(t), i))
    want = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    for bits in (64, 3):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, bits).collect()}
        assert got == want


def test_minhash_finds_all_links(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 30, 120]))]
        for k in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(99))
            rows.append((len(rows) * 3 + g, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Plan(words=4, small=3, block=8)).collect()}
    sets = {i: minhash.shingle_set(t, 4) for i, t in rows}
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and minhash._similar(sets[a], sets[b], 80) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    assert got == top


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(2)
    common, x, y = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    a, b = np.unique(np.append(common, x)), np.unique(np.append(common, y))
    assert abs((minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean() - 0.6) < 0.05


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in base[i % 20] + rng.standard_normal(16) * 0.05 * (i % 3)], i % 2) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [1.0], 0), (905, rows[0][1], 0), (None, rows[0][1], 0), (906, [None] * 16, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n long")
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, embed_dedup.Codes(block=16)).collect()}
    assert len(got) == len(rows)
    sound = [(i, np.array(v) / np.linalg.norm(v), c) for i, v, c in rows if i is not None and i not in (900, 901, 902, 903, 906)]
    for i, v, c in sound:
        n = sum(j != i and c == k and len(u) == len(v) and u @ v >= 0.98 for j, u, k in sound)
        assert got[i].n_links == n
    assert all(got[i].kept and got[i].n_links == 0 for i in (900, 901, 902, 903, 906))


def test_code_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = embed_dedup.Codes()
    _, packed, factor = embed_dedup.encode(x, codes)
    found, error = embed_dedup.estimate(packed, factor, x @ embed_dedup.rotations(64, codes)[:64].T)
    off = found - x @ x.T
    np.fill_diagonal(off, 0)
    assert abs(off.mean()) < 0.01 and (np.abs(off) < 6 * error).all()


def test_line_field_learns_from_documents():
    rng = random.Random(6)
    good = lambda: "\n".join("The " + " ".join(rng.choice(["quiet", "river", "runs", "under", "old", "stone", "bridges"]) + rng.choice(["", "s"]) for _ in range(12)) + "." for _ in range(4))
    bad = lambda: "\n".join([good().split("\n")[0]] + [" ".join(["BUY!!", "NOW!!", "###"] * 8) for _ in range(4)])
    texts = [good() if i % 2 else bad() for i in range(120)]
    field = quality_crf.train(*quality_crf.measure(texts), np.array([i % 2 for i in range(120)], float))
    assert field.quality([good()])[0] > 0.8 and field.quality([bad()])[0] < 0.2
    lines = field.line_marginals(bad())
    assert lines[0] > 0.5 > max(lines[1:])


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(7)
    n, step = np.array([3, 0, 1, 4]), rng.standard_normal((2, 2))
    score = rng.standard_normal(8)
    got, at = quality_crf.marginals(score, step, n), 0
    for k in n:
        total = np.zeros(k)
        z = 0.0
        for labels in np.ndindex(*[2] * k):
            w = np.exp(sum(score[at + i] * y for i, y in enumerate(labels)) + sum(step[a, b] for a, b in zip(labels, labels[1:], strict=False))) if k else 1.0
            z += w
            total += w * np.array(labels, float)
        assert np.allclose(got[at : at + k], total / z)
        at += k


def test_clause_grammar():
    g = toxicity_wfst.Grammar({"idiot": 4.0, "scum$": 3.0})
    asserted, aimed = g.events("You are an idiot. Fine day."), g.events("you scum")
    assert asserted[0] > 0 and asserted[2] > 0 and asserted[3] == 0 and aimed[2] > 0
    assert g.events("You are not an idiot")[3] > 0 and g.events("You are not an idiot")[0] == 0
    assert g.events('he said "idiot" today')[4] > 0
    assert g.events("I will kill you and you will hurt")[5] > 0
    assert not g.events("scumble of the idioms")[:6].any() and not g.events(None).any()
    assert len(g.clauses("a. idiots here; idiot there! no")) == 2


def test_boilerplate_lines(spark):
    line = "the same line on many sites"
    rows = [(i, f"own text number {i} of this page\n {line}\nshort", "en", f"s{i % 9}") for i in range(30)] + [(99, "this line has one site only here", "en", "s1")] * 9
    got = {r.doc_id: r for r in line_dedup.line_report(_docs(spark, rows), line_dedup.Spread(sites=9)).collect()}
    assert got[3].n_removed == 1 and got[99].n_removed == 0
    assert got[3].cleaned_sha256 == hashlib.sha256(b"own text number 3 of this page\nshort").hexdigest()


def test_licence_rules():
    r = license_rules.Recogniser()
    text = "Intro.\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nmore\nReleased under the MIT License."
    assert [m[0] for m in r.match(text)] == ["apache-2.0-short-notice", "mit-reference"]
    assert [m[1] for m in r.match("x y.\nLicensed under CC BY-NC 4.0.\n")] == ["CC-BY-NC-4.0"]
    a, b = r.match(text)[1][2:]
    assert text[a:b] == "Released under the MIT License."
    assert r.match("All about licences and permission.") == [] and r.match(None) == []


def test_token_store_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(8)
    letters = "aeTOSI  \n\t.,!?'é漢😀ñß0123'll'reΣİK\x1c\xa0é"
    rows = [(i * 7 % 311, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(301)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_store.write_shards(docs, str(tmp_path / "t"), path, docs_per_shard=32)
    got = {r.doc_id: r for r in token_store.read_shards(manifest, str(tmp_path / "t")).collect()}
    start, want = 0, {}
    for i, t in sorted(rows):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want[i] = ids
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    keys = spark.createDataFrame([(5,), (17,), (5000,), (-1,)], "doc_id long")
    assert {r.doc_id: r.ids for r in token_store.lookup(spark, manifest, str(tmp_path / "t"), keys).collect()} == {5: want[5], 17: want[17]}


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(9).integers(-(2**62), 2**62, 5000))
    assert sorted(token_store.PerfectHash.build(keys).places(keys).tolist()) == list(range(len(keys)))


def test_shares_go_to_siblings_before_ancestors():
    mix = mixture.Mix(share=0.5, epochs=1, weights={("b",): 3.0})
    tokens = {("a", "en", "x"): 10, ("a", "en", "y"): 500, ("a", "de", "z"): 20, ("b", "en", "w"): 470}
    got = mixture.plan_leaves(tokens, mix)
    # b takes 375 of 500; a's 125: de can use 20, en the rest, where x holds 10.
    assert got == {("b", "en", "w"): 375, ("a", "de", "z"): 20, ("a", "en", "x"): 10, ("a", "en", "y"): 95}
    assert mixture.share_out(100, [(1, 10), (1, 20), (2, 1000), (0, 50)]) == [10, 20, 70, 0]


def test_bpe_matches_tiktoken_and_edits_match_full_encodings():
    import tiktoken

    ranks = bpe_prefix.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe_prefix.TextCodec(ranks, P.PATTERN), random.Random(10)
    letters = "aeionrst  \n\t.,!?'é漢字😀ñ0123ABCs'tllre  "
    for _ in range(600):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        assert codec.encode(t) == enc.encode_ordinary(t)
        assert codec.decode_bytes(codec.encode_bytes(t)) == t.encode()
        e = bpe_prefix.EditableText(codec, t)
        for _ in range(3):
            a = rng.randint(0, len(e.text))
            e.replace(a, rng.randint(a, min(len(e.text), a + 5)), "".join(rng.choice(letters) for _ in range(rng.randrange(5))))
            assert np.frombuffer(e.encode_bytes(), "<u4").tolist() == enc.encode_ordinary(e.text)
    piece = bpe_prefix.EditablePiece(codec.encoder, b"international")
    piece.append(b"isation")
    assert piece.tokens() == enc._encode_single_piece(b"internationalisation")


def test_pipeline_stages_keep_columns(spark):
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = cp.run(spark, "/root/testdata/sf0.001")
    ids = {r.doc_id: bytes(r.ids) for r in out.collect()}
    import public_tokenizers

    codec = bpe_prefix.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(ids) < len(texts)
    assert all(codec.decode_bytes(x).decode() == texts[i] for i, x in ids.items())


def test_vector_buckets_that_span_batches(spark):
    """A bucket longer than an Arrow batch has the links of brute force."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(3, 16))
    v = np.concatenate([c + rng.normal(size=(30, 16)) * 0.05 for c in centre])
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    finally:
        spark.conf.set(name, before)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    same = np.arange(len(v))[:, None] % 2 == np.arange(len(v))[None, :] % 2
    n = ((unit @ unit.T >= 0.98) & same).sum(1) - 1
    assert n.max() > 8
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(n.tolist()))


def test_components_of_shuffled_chains(spark):
    """Chains whose ids lie in no order settle, however long; so do stars, cycles and repeated links."""
    from tessella.llm.common import Scratch, components

    rng = np.random.default_rng(11)
    ids = rng.permutation(6000).tolist()
    chains = [ids[:4000], ids[4000:5000], ids[5000:5003]]
    links = [link for c in chains for link in zip(c, c[1:], strict=False)] + [(7000, 7000 + k) for k in range(1, 200)] + [(8001, 8000), (8002, 8001), (8000, 8002), (8000, 8001)]
    links += [(9000, 9000), (None, 9001), (9002, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "chain")).collect()}
    want = {k: min(c) for c in chains for k in c} | {k: 7000 for k in range(7000, 7200)} | {k: 8000 for k in range(8000, 8003)}
    assert got == want


FULL_NOTICES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
}
FULL_NOTICES["gpl-2.0-notice"] = FULL_NOTICES["gpl-3.0-notice"].replace("software:", "software;").replace("version 3", "version 2")
FULL_NOTICES["bsd-3-clause"] = FULL_NOTICES["bsd-2-clause"] + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


@pytest.mark.parametrize("rule", sorted(FULL_NOTICES))
@pytest.mark.parametrize("form", ["lines", "wrapped", "comment", "crlf"])
def test_full_licence_notices(rule, form):
    import textwrap

    text = FULL_NOTICES[rule]
    if form != "lines":
        text = "\n".join("\n".join(textwrap.wrap(p, 72, break_long_words=False)) for p in text.split("\n"))
    if form == "comment":
        text = "/*\n" + "\n".join(f" * {line}" for line in text.split("\n")) + "\n */"
    text = text.replace("\n", "\r\n") if form == "crlf" else text
    assert [m[0] for m in license_rules.Recogniser().match(f"Own words\n\n{text}\n\nmore words")] == [rule]
