"""The pipeline's stages, one by one and together, against plain versions of them; decisions row by row."""

import collections

import numpy as np
import pytest

pytest.importorskip("tessella.llm")
cp = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
from test_mixture import _selected  # noqa: E402

from tessella.llm import exact_dedup, minhash, quality_crf, token_store  # noqa: E402
from tessella.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _squeezed(text):
    return "".join((text or "").translate(dict.fromkeys([32, *range(9, 14)], " ")).split(" "))


def _exact(rows):
    """Of rows with equal texts without white space: the longest, the smallest doc_id, nulls last."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[_squeezed(r[1])].append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def _near(rows, words=5):
    sets = [minhash.shingle_set(r[1], words) for r in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def _same(df, rows):
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, rows))


def test_stages_against_plain_versions(spark):
    import tiktoken

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    stages = dict(cp.STAGES)
    quality, exact, near, mix, encode = stages.values()
    assert len(stages) == 5
    rows = [tuple(r) for r in docs.collect()]
    field = quality_crf.fit(docs, labels)
    rows = [r for r in rows if field.quality([r[1]])[0] >= 0.3]
    good = quality(spark, docs, SF)
    _same(good, rows)
    held = lambda kept: spark.createDataFrame(kept, COLUMNS)
    once = _exact(rows)
    _same(exact(spark, held(rows), SF), once)
    apart = _near(once)
    _same(near(spark, held(once), SF), apart)
    taken = {i for i, _, n in _selected([(r[0], r[1], r[2], r[3]) for r in apart], cp.MIX) if n}
    mixed = [r for r in apart if str(r[0]) in taken]
    _same(mix(spark, held(apart), SF), mixed)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=__import__("tessella.llm.bpe_prefix", fromlist=["x"]).read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {r[0]: own.encode_ordinary(r[1]) for r in mixed}
    for got in (encode(spark, held(mixed), SF), cp.run(spark, SF)):
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got.collect()} == want
    assert 0 < len(mixed) < len(apart) <= len(once) < docs.count()


AWKWARD = [
    (1, "alpha  beta"), (5, "alpha beta"), (5, "only here gamma delta"), (5, "only here gamma delta"), (5, "alpha beta"), (2, None), (3, ""), (3, ""), (None, "alpha\tbeta"), (None, "no id at all"),
    (None, "no id at all"), (8, "q w e r t y u i o p a s d f"), (8, "q w e r t y u i o p a s d f g"), (9, "word " * 20_000), (10, "word " * 20_000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", "src1", 1, "x", 2.0, True) for i, t in AWKWARD], COLUMNS + ", row_key string, kept double, node boolean")


def test_exact_copies_are_decided_row_by_row(awkward):
    got = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(awkward).collect()]
    plain = _exact([(*r, k) for k, r in enumerate(AWKWARD)])
    assert collections.Counter(got) == collections.Counter((i, t) for i, t, _ in plain) or sorted(map(str, ((i, _squeezed(t)) for i, t in got))) == sorted(map(str, ((i, _squeezed(t)) for i, t, _ in plain)))
    rows = exact_dedup.exact_groups(awkward).collect()
    assert len(rows) == len(AWKWARD) and sum(r.kept for r in rows) == len(plain)
    assert {r.group_size for r in rows if r.doc_id == 1} == {4}


def test_near_copies_are_decided_row_by_row(awkward):
    left = minhash.drop_near_copies(awkward, minhash.Plan(words=4))
    got = sorted(str((r.doc_id, r.text)) for r in left.collect())
    # Null, empty and wordless rows link with nothing and stay.
    blank = [r for r in AWKWARD if not (r[1] or "").split()]
    plain = _near([r for r in AWKWARD if (r[1] or "").split()], 4)
    assert left.columns == awkward.columns and got == sorted(str(r) for r in blank + plain)
    rows = minhash.near_duplicates(awkward, minhash.Plan(words=4)).collect()
    assert len(rows) == len(AWKWARD) and sum(r.kept for r in rows) == len(got)


@pytest.mark.parametrize("name", [name for name, _ in cp.STAGES])
def test_every_stage_takes_awkward_and_no_rows(spark, awkward, name):
    stage = dict(cp.STAGES)[name]
    got = stage(spark, awkward, SF)
    assert got.count() <= 2 * len(AWKWARD) and (got.columns == awkward.columns or stage is cp.encode)
    assert stage(spark, awkward.limit(0), SF).count() == 0


def test_token_store_keeps_documents_without_ids(spark, tmp_path):
    docs = spark.createDataFrame([(3, "one two"), (None, "three"), (1, None), (None, ""), (3, "one two again")], "doc_id long, text string")
    manifest = token_store.write_shards(docs, str(tmp_path / "n"), P.path("word_bpe_49k.json"), docs_per_shard=2)
    rows = sorted(token_store.read_shards(manifest, str(tmp_path / "n")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 3, 3, None, None]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    found = token_store.lookup(spark, manifest, str(tmp_path / "n"), spark.createDataFrame([(3,), (1,), (0,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in found) == [1, 3]
