"""Every registered query of the engine against its SQL on the smallest tables, and small exact cases."""

import os

import duckdb
import numpy as np
import pytest

from tessella.operators import kernels, ranking, series, thresholds
from tessella.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        # tests/test_puzzles.py and the cases below hold these against plain versions; here they run on whole tables.
        assert len(got) > 0 and not got.duplicated([c for c in got.columns if got[c].dtype != object]).all()
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_dtw_invariants():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.random(rng.integers(1, 30)), rng.random(rng.integers(1, 30))
        assert kernels.dtw_distance(x, x) == 0
        assert kernels.dtw_distance(x, y) == pytest.approx(kernels.dtw_distance(y, x))
    assert kernels.dtw_distance(np.array([]), np.array([1.0])) == float("inf")


def test_greedy_matching_uses_each_end_once(spark):
    rows = [("c", 1, 2, 0.9), ("c", 2, 3, 0.8), ("c", 3, 4, 0.7), ("d", 1, 2, 0.1)]
    got = ranking.greedy_matching(spark.createDataFrame(rows, "channel string, a long, b long, score double"), ["channel"])
    assert sorted(map(tuple, got.collect())) == [("c", 1, 2, 0.9), ("c", 3, 4, 0.7), ("d", 1, 2, 0.1)]


def test_degenerate_conventions(spark):
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, v double")
    assert {r.normed for r in thresholds.minmax(same, "v").collect()} == {0.0}
    assert {r.normed for r in thresholds.zscore(same, "v").collect()} == {0.5}
    assert thresholds.otsu(same, "v").first().threshold == 2.0


def test_consensus(spark):
    rows = [("v1", 1, 0.0, 0.0), ("v1", 2, 100.0, 0.0), ("v1", 3, 900.0, 0.0), ("v2", 1, 0.0, 0.0), ("v2", 2, 0.0, 200.0), ("v2", 3, 100.0, 100.0)]
    got = ranking.consensus(spark.createDataFrame(rows, "voter string, id long, x double, y double"), share=1.0)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 2)]


def test_koch_like_curves_have_a_dimension_between_one_and_two(spark):
    t = np.linspace(0, 2 * np.pi, 400)
    rows = [("circle", float(np.cos(a)), float(np.sin(a))) for a in t] + [("dot", 0.0, 0.0)]
    got = {r.series: r.fd for r in series.box_counting(spark.createDataFrame(rows, "series string, x double, y double")).collect()}
    assert got["dot"] == 1.0 and 1.0 <= got["circle"] <= 1.2


def test_streaming_summary_matches_batch(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from tessella.sources.files import read_table, write_table
    from tessella.streaming.logs import windowed_summary

    rows = [(dt.datetime(2024, 1, 1, h, m), "n", 1.0) for h in range(4) for m in (0, 30)]
    df = spark.createDataFrame(rows, "ts timestamp, name string, value double")
    write_table(df, str(tmp_path / "in"))
    stream = windowed_summary(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("summary").start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_summary(read_table(spark, str(tmp_path / "in")))
    assert sorted(spark.table("summary").collect()) == sorted(batch.collect())
    assert batch.agg(F.sum("n")).first()[0] == 8


def test_images_from_a_folder(spark, tmp_path):
    from tessella.sources.files import read_images

    (tmp_path / "fragment_12.png").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"y")
    assert [(r.fragment_id, bytes(r.content)) for r in read_images(spark, str(tmp_path)).collect()] == [(12, b"x")]


def test_whole_turns_are_compared(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    talks = [["Привет, мир", "Другая речь"], ["你好", "再見嗎"], ["café\nnoir", "cafe\nnoir", "cafe noir"], ["", ""], ["a😀b", "ab"], ["", "ñ"]]
    rows = [(c, k, "user", t) for c, talk in enumerate(talks) for k, t in enumerate(talk)] + [(99, 0, "user", None), (99, 1, "user", "é")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.similarity for r in queries.QUERIES["text_turn_similarity"](spark, str(tmp_path)).collect()}
    want = {(c, k + 1): 1.0 if not (n := max(len(a), len(b))) else 1 - distance(a, b) / n for c, talk in enumerate(talks) for k, (a, b) in enumerate(zip(talk, talk[1:], strict=False))}
    assert got == {k: round(v, 6) for k, v in want.items()}
    assert got[(0, 1)] < 0.5 and got[(1, 1)] == 0 and got[(2, 1)] < 1


def test_whole_pairs_are_all_there(spark):
    pairs = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()
    assert queries.QUERIES["whole_norm_sigmoid"](spark, SF).count() == pairs > 1560
    whole = {n for n in queries.QUERIES if n.startswith("whole_")}
    assert len(whole) == 22 and not any("% 40" in queries.ORACLES.get(n, "") for n in whole)
