"""Budgets and seeded prefixes against a plain reading of their definition."""

import hashlib
import random
import re

import pytest

pytest.importorskip("tessella.llm")
from tessella.llm import mixture  # noqa: E402
from tessella.llm.common import Scratch  # noqa: E402


def _trees():
    rng = random.Random(12)
    for _ in range(6):
        tokens = {(f"domain{rng.randrange(3)}", rng.choice(["en", "de", ""]), f"s{rng.randrange(6)}"): rng.choice([0, 1, 40, rng.randrange(3000)]) for _ in range(25)}
        weights = {("domain0",): rng.choice([0.0, 0.5, 3.0]), ("*", "en"): 2.0, ("domain1", "en"): 0.25, ("*", "*", "s1"): rng.choice([0.0, 5.0])}
        yield tokens, mixture.Mix(weights=weights, share=rng.choice([0.1, 0.5, 0.9, 2.5]), epochs=rng.choice([1, 3]))


def test_distributed_plan_matches_the_tree_in_memory(spark):
    for tokens, mix in _trees():
        df = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "domain string, lang string, source string, t long")
        got = {(r.domain, r.lang, r.source): r.budget for r in mixture.plan(df, mix, Scratch(spark, "plan")).collect()}
        want = mixture.plan_leaves(tokens, mix)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)
        assert sum(got.values()) <= mix.share * sum(tokens.values()) + 1


def _selected(rows, mix):
    """(key, repeats) by definition: leaf by leaf, whole epochs, then documents in the order of their keys while they fit."""
    leaves = {}
    for i, text, lang, source in rows:
        number = re.search(r"[0-9]{1,9}$", source or "")
        leaf = (f"domain{int(number[0]) % 4}" if number else "other", lang or "", source or "")
        leaves.setdefault(leaf, []).append((i, len((text or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    out = []
    for leaf, budget in mixture.plan_leaves(tokens, mix).items():
        whole = budget // tokens[leaf] if tokens[leaf] else int(mix.weight(leaf) > 0)
        rest = budget - whole * tokens[leaf]
        keyed = {}
        for i, n in leaves[leaf]:
            key = hashlib.md5(f"{mix.seed}:{whole}:{'null' if i is None else i}".encode()).hexdigest()
            keyed.setdefault(key, []).append((i, n))
        used, open_ = 0, bool(tokens[leaf]) and (rest > 0 or whole > 0)
        for key in sorted(keyed):
            used += sum(n for _, n in keyed[key])
            open_ = open_ and used <= rest
            out += [(str(i), n, whole + open_) for i, n in keyed[key]]
    return sorted(out)


@pytest.mark.parametrize("epochs", [1, 2])
def test_selection_against_its_definition(spark, epochs):
    rng = random.Random(13)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 60, 400])), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src2", "src13", "site", None])) for i in range(400)]
    rows += [(7, "a repeated id", "en", "src0"), (7, "a repeated id", "en", "src0"), (None, "no id", "de", "src1"), (900, None, "en", "src2"), (901, "", "xx", "src9"), (902, "w " * 20_000, "en", "src1")]
    docs = spark.createDataFrame([(*r, 1.0, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, whole double, cut int, domain string")
    mix = mixture.Mix(weights={("domain1",): 2.0, ("*", "en"): 4.0, ("*", "*", "src2"): 0.0}, epochs=epochs, share=0.6)
    got = mixture.select(docs, mix).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.repeats) for r in got) == _selected(rows, mix)
    mixed = mixture.mixed(docs, mix)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in got)
    assert mixture.select(docs.limit(0), mix).count() == 0
