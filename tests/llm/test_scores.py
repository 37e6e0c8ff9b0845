"""The learned scores: grammar paths by enumeration, held-out accuracy on whole tables, folds, ties and awkward rows."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tessella.llm")
from tessella.llm import quality_crf, toxicity_wfst  # noqa: E402

SF = "/root/testdata/sf0.01"


def _paths(symbols):
    """All paths through the transducers one after another, uncomposed: (weight, what goes out)."""
    live = [(0.0, tuple(t.start for t in toxicity_wfst.PARTS), ())]
    for s in symbols:
        then = []
        for weight, states, path in live:
            open_ = [(weight, (), s)]
            for t, state in zip(toxicity_wfst.PARTS, states, strict=True):
                open_ = [(w + v, (*had, to), out) for w, had, mid in open_ for to, out, v in t.arcs(state, mid)]
            then += [(w, had, (*path, out)) for w, had, out in open_]
        live = then
    return live


def test_best_path_against_enumeration():
    rng = random.Random(3)
    for _ in range(400):
        symbols = [rng.randrange(toxicity_wfst.UM + 1) for _ in range(rng.randrange(9))] + [toxicity_wfst.END]
        every = _paths(symbols)
        got = tuple(toxicity_wfst.best_path(symbols))
        best = max(w for w, _, _ in every)
        assert any(path == got and abs(w - best) < 1e-9 for w, _, path in every)


@pytest.mark.parametrize(("text", "marks"), [
    ("I will kill you", "aim meant"), ("I am killing you", "aim meant"), ("he said: you are an idiot", "rep aim"), ("not a complete and utter total idiot", "neg"),
    ("idiot, that is you", "aim"), ("ich werde dich umbringen", "aim meant"), ("ich bringe dich um", "aim meant"), ("te voy a matar", "aim meant"),
    ('he said "you idiot. you fool"', "rep aim"), ("you are an idiot, but not a liar", "aim"), ("not you but an idiot", "aim"), ("I will not hurt you", "neg aim meant"),
])
def test_marks_of_clauses(text, marks):
    g = toxicity_wfst.Grammar({"idiot": 4.0})
    names = {"neg": toxicity_wfst.NEGATED, "rep": toxicity_wfst.REPORTED, "aim": toxicity_wfst.AIMED, "meant": toxicity_wfst.MEANT}
    (_, _, clause), *_ = g.matches(text)
    assert " ".join(n for n, f in names.items() if clause[0][0] & f) == marks


def test_quotes_and_spans():
    g = toxicity_wfst.Grammar({"idiot": 4.0})
    text = 'He left. "Good day. You idiot" she said.\nYou idiot\n5" pipe. You idiot'
    found = g.matches(text)
    assert [bool(c[0][0] & toxicity_wfst.REPORTED) for _, _, c in found] == [True, False, False]
    assert [text[a:b].strip() for a, b, _ in found] == ['You idiot" she said', "You idiot", "You idiot"]
    assert len(g.matches("word " * 50_000 + "you idiot. " + "word " * 50_000)) == 1


def test_threats_count_without_labels_that_show_any():
    weights, offset = toxicity_wfst._logistic(np.zeros((50, toxicity_wfst.FEATURES)), np.zeros(50))
    assert weights[5] > 3 and offset < 0


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    value, at = np.unique(score[order], return_inverse=True)
    mean = np.bincount(at, np.arange(1, len(score) + 1)) / np.bincount(at)
    ranks = np.empty(len(score))
    ranks[order] = mean[at]
    n = label.sum()
    return (ranks[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("op", "label", "fold", "least"), [(quality_crf, "quality", (5, 0), 0.95), (toxicity_wfst, "toxic", (4, 2), 0.8)], ids=["quality", "toxicity"])
def test_queries_on_a_whole_table(spark, op, label, fold, least):
    """One row per document, the contract's folds and predictions, held-out accuracy, the same scores in a second run.

    Of the 14 held-out toxic documents of this small table 5 hold no word that any training document shows.
    """
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    score = lambda: {r.doc_id: r for r in op.score(docs, op.fit(docs, labels)).collect()}
    got, again = score(), score()
    assert len(got) == docs.count() and all(abs(again[i].score - r.score) < 1e-9 for i, r in got.items())
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % fold[0] == fold[1])
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(got[r.doc_id].score, r[label]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r[label] is not None]
    x, y = np.array(held, float).T
    assert 0 < y.sum() < len(y) and _auc(x, y) > least


@pytest.mark.parametrize("op", [quality_crf, toxicity_wfst])
def test_awkward_labels(spark, op):
    """Nulls, repeated doc_ids, labels beyond 0 and 1, one class only, no label, clashing names, empty and very long texts."""
    texts = [(1, "you idiot"), (1, "another text"), (None, "you idiot"), (2, None), (3, ""), (4, "word " * 20_000), (5, "fine words here"), (5, "fine words here")]
    docs = spark.createDataFrame([(i, t, 0.5, 1, 2) for i, t in texts], "doc_id long, text string, score double, toxic int, quality int")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows in ([], [(1, 1, 1)], [(1, None, None), (None, 1, 1)], [(i, i % 2 * 7, i % 2 * 7) for i in range(6)] + [(1, 0, 0)]):
        got = op.score(docs, op.fit(docs, make(rows))).collect()
        assert sorted((str(r.doc_id)) for r in got) == sorted(str(i) for i, _ in texts)
        twins = [r.score for r in got if r.doc_id == 5]
        assert twins[0] == twins[1] and all(0 <= r.score <= 1 for r in got)
    assert op.score(docs.limit(0), op.fit(docs.limit(0), make([]))).count() == 0
