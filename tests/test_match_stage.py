"""The matching stage counts pairs where they meet; before, it wrote a row for every pair."""

import duckdb
import numpy as np

from tessella.operators import similar, storage
from tessella.plans import queries


def _same_as_sql(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(queries.ORACLES["match_stage"]).fetchall())
    assert sorted((r.a, r.b, r.fused) for r in queries.match_stage(spark, str(path)).collect()) == want
    return want


def test_no_pair_is_written(spark, tmp_path, monkeypatch):
    """Small blocks, so that best rows, bins and ranks are put together from many; copies tie."""
    written = []

    def cut(df):
        written.append(storage.cut(df))
        return written[-1]

    for module in (similar, queries):
        monkeypatch.setattr(module, "cut", cut, raising=False)
    monkeypatch.setattr(similar, "BLOCK", 150)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 8)).round(3)
    v[300:330] = v[0]
    v[700:760] = v[20] * 2
    assert len(_same_as_sql(spark, tmp_path, [(k, x.tolist()) for k, x in enumerate(v)])) == 45 * 5
    # 45 * 899 pairs; five rows and the bins of each block of 7 to 150 are written at most.
    assert sum(df.where("n = 0").count() for df in written) <= 45 * 5 * 6


def test_every_cosine_is_the_same(spark, tmp_path):
    assert _same_as_sql(spark, tmp_path, [(k, [1.0, 0.0]) for k in range(50)])


def test_no_and_few_vectors(spark):
    of = lambda rows: spark.createDataFrame(rows, "id long, v array<float>")
    for rows in ([], [(20, [1.0])], [(20, None), (21, [1.0])]):
        assert similar.matched(of(rows).where("id % 20 = 0"), of(rows), 95, 5).collect() == []
    assert [tuple(r) for r in similar.matched(of([(20, [1.0, 0.0])]), of([(20, [1.0, 0.0]), (21, [1.0, 1.0])]), 95, 5).collect()] == [(20, 21, 1, 1)]
